
import numpy as np

from corpusq.operators import analysis, ann, model, outline, postings, rag, search, sessions, status
from corpusq.plans import catalog
from tests import doubles

CHUNK = "rowid long, chunk_id string, text string, source_file string, file_type string, chunk_index long, total_chunks long"


def file_chunks(spark, sizes, text="t"):
    rows, i = [], 0
    for f, n in sizes.items():
        for k in range(n):
            rows.append((i, f"c{i}", f"{text}{k}", f, "text", k, n))
            i += 1
    return spark.createDataFrame(rows, CHUNK)


def test_stratified_sample_may_exceed_fifty(spark):
    got = analysis.stratified_sample(file_chunks(spark, {"a": 50, "b": 51, "c": 69, "d": 200}))
    counts = {r.source_file: r["count"] for r in got.groupBy("source_file").count().collect()}
    want = {"a": 50}
    for f, n in (("b", 51), ("c", 69), ("d", 200)):
        step = max(1, (n - 30) // 20)
        want[f] = 30 + len(range(15, n - 15, step))
    assert counts == want and want["c"] == 69


def test_summary_tree_and_reduce(spark):
    calls = file_chunks(spark, {"a": 25, "b": 1, "c": 310})
    said = lambda p: f"<{p.count('t') + p.count('<')}>"
    got = {r.source_file: r.summary for r in analysis.summarise(calls, said).collect()}
    assert got == {"a": "<3>", "b": "<1>", "c": "<2>"}
    one = analysis.reduce_all(analysis.summarise(calls, said), "source_file", said, size=2).collect()
    assert len(one) == 1


def test_focus_scan_material(spark):
    c = file_chunks(spark, {"b": 2, "a": 40})
    assert analysis.batches(c, ["source_file", "chunk_index"], 10).groupBy("batch").count().orderBy("batch").collect() == [(0, 10), (1, 10), (2, 10), (3, 10), (4, 2)]
    got = analysis.focus(c, "do it", lambda p: None if "【a】" in p else p[:5], size=1).orderBy("batch").collect()
    assert [(r.files, r.answer) for r in got] == [(["a"], "(failed)"), (["b"], "do it")]
    sections = spark.createDataFrame([(1, "One"), (2, "Two")], "ord int, title string")
    hits = c.select(*[c[x] for x in ("rowid", "text", "source_file", "chunk_index")]).selectExpr("1 as ord", "*")
    report = analysis.scan_report(sections, hits, lambda p: str(len(p.split("\n\n"))), size=30).collect()
    assert [(r.ord, r.files, r.report) for r in report] == [(1, 2, "## One\n4"), (2, 0, "## Two\n")]
    report = analysis.scan_report(sections, hits, lambda p: None, size=1).collect()
    assert report[0].report == "## One\n(failed)\n\n(failed)"
    long = {r.source_file: r.content for r in analysis.file_context(c, lambda p: f"<{p.count('[Chunk')}{p.count('<')}>").collect()}
    assert long["b"].count("\n\n") == 1 and long["a"] == "<02>"
    wide = spark.createDataFrame([("w", i, i, "x" * 8000) for i in range(5)] + [("w", 5, 5, None)], "source_file string, chunk_index long, rowid long, text string")
    assert [r.content for r in analysis.file_context(wide, lambda p: f"<{p.count('x')}>").collect()] == ["<0>"]
    assert [r.content for r in analysis.file_context(wide, lambda p: None).collect()] == ["(failed)\n\n(failed)\n\n(failed)"]
    assert len(analysis.focus_report(c, "do it", lambda p: p[:5], size=1).collect()) == 1
    assert analysis.focus_report(c.limit(0), "do it", lambda p: p).collect() == []
    tree = outline.tree_sections(spark.createDataFrame([(1, "1. Aim\nnote\n1.1 Part\n2. End")], "id long, text string"))
    h = spark.createDataFrame([(1, 1, 1, "x" * 2000), (1, 1, 2, "y")], "id long, ord long, rank int, text string")
    made = analysis.material(tree, h, lambda p: str(len(p))).orderBy("ord").collect()
    assert [(r.number, r.content) for r in made] == [("1", str(len("1 Aim\nnote\n\n") + 1000 + 3)), ("2", str(len("2 End\n\n\n")))]
    assert analysis.templates({"audit a": "1", "b": "2"}, "audit") == {"audit a": "1"}


def test_outlines(spark):
    text = "intro\n第一章 总则\nline a\n\nline b\n（一）范围\nA. Latin\nx"
    flat = outline.flat_sections(spark.createDataFrame([(1, text), (2, "no headers\nat all "), (3, None)], "id long, text string")).orderBy("id", "ord").collect()
    assert [(r.id, r.ord, r.title, r.detail) for r in flat] == [(1, 1, "第一章 总则", "line a\nline b"), (1, 2, "（一）范围", ""), (1, 3, "A. Latin", "x"), (2, 1, "分析任务", "no headers\nat all"), (3, 1, "分析任务", "")]
    tree = "1.1 orphan\n1. Top\nextra one\n1.1 sub\n1.1.1 leaf\nextra two\n1.2 sub two\n2、Second\n2.1.1 lone leaf\n2.2 after"
    got = outline.tree_sections(spark.createDataFrame([(1, tree)], "id long, text string")).orderBy("ord").collect()
    assert [(r.number, r.depth, r.parent_ord, r.extra) for r in got] == [
        ("1.1", 2, None, []), ("1", 1, None, ["extra one", "extra two"]), ("1.1", 2, 2, []), ("1.1.1", 3, 3, []), ("1.2", 2, 2, []), ("2", 1, None, []), ("2.1.1", 3, None, []), ("2.2", 2, 7, [])]


def test_sessions(spark):
    events = spark.createDataFrame([(1, "a", "create", "first", 10), (2, "b", "create", "second", 20), (3, "a", "topic", "renamed", 30), (4, "b", "close", None, 40), (5, "c", "create", "gone", 50), (6, "c", "delete", None, 60), (7, "x", "topic", "never made", 70)], "seq long, session_id string, kind string, value string, at long")
    turns = spark.createDataFrame([(i, "a", "user" if i % 2 else "assistant", f"q{i} [1]", 100 + i) for i in range(1, 6)], "id long, session_id string, role string, content string, created_at long")
    now = sessions.current_sessions(events, turns)
    assert {r.id: (r.topic, r.is_active, r.updated_at, r.turn_count) for r in now.collect()} == {"a": ("renamed", 1, 105, 5), "b": ("second", 0, 40, 0)}
    assert [r.id for r in sessions.list_sessions(now).collect()] == ["a", "b"]
    assert sessions.active_session(now).first().id == "a" and sessions.active_session(now, "b").first().id == "b" and sessions.active_session(now, "z").count() == 0
    assert {r.id for r in sessions.retained_sessions(now, 1).collect()} == {"a"} and sessions.retained_sessions(now, 2).count() == 2
    assert [r.id for r in sessions.retained_turns(turns, 2).orderBy("id").collect()] == [4, 5]
    assert [r.id for r in sessions.history(turns, "a").collect()] == [1, 2, 3, 4, 5]
    assert sessions.delete_sessions(turns, spark.createDataFrame([("a",)], "x string")).count() == 0
    coded = sessions.decode_sources(turns.selectExpr("*", "if(role = 'assistant', '[{\"file\":\"f.pdf\",\"file_path\":\"/k/f.pdf\",\"snippet\":\"s\",\"score\":1.5}]', null) as sources"))
    names = rag.last_sources(coded)
    assert names.first().names == {1: "f.pdf"}
    m = rag.prompt_messages(rag.recent_history(coded, 3), names, "sys", "ask").first().messages
    assert [(x.role, x.content) for x in m] == [("system", "sys"), ("user", "q3 [1](指上轮「f.pdf」)"), ("assistant", "q4 [1]"), ("user", "q5 [1](指上轮「f.pdf」)"), ("user", "ask")]
    text = sessions.export_markdown(now.filter("id = 'b'"), coded).first().markdown
    assert text.startswith("# 审计记录\n\n- **会话ID**: b\n- **主题**: second\n") and text.endswith("- **问答轮次**: 0\n\n")
    assert "**参考资料:**\n- f.pdf\n\n" in sessions.export_markdown(now, coded).filter("id = 'a'").first().markdown


def test_sessions_from_json(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"session_id": "old", "topic": "t", "start_time": "2024-01-01 00:00:00", "turns": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo", "sources": ["a"]}]}, {"session_id": "known", "turns": []}]')
    s, t = sessions.sessions_from_json(spark, str(tmp_path), spark.createDataFrame([("known",)], "id string"))
    assert [(r.id, r.turn_count) for r in s.collect()] == [("old", 2)] and [(r.id, r.role) for r in t.orderBy("id").collect()] == [(1, "user"), (2, "assistant")]


def test_status(spark):
    files = spark.createDataFrame([(1, "/a", "h1"), (2, "/b", "h1"), (3, "/c", "h2"), (4, "/d", "new"), (5, "/e", None), (6, "/f", "h3")], "pos long, path string, hash string")
    manifest = spark.createDataFrame([("/c", "h2"), ("/d", "old"), ("/z", "h3")], "path string, hash string")
    assert {r.path: r.verdict for r in status.dedup(files, manifest).collect()} == {"/a": "new", "/b": "duplicate_in_batch", "/c": "unchanged", "/d": "changed", "/e": "new", "/f": "duplicate_of_indexed"}
    gone = status.remove_paths(manifest, spark.createDataFrame([("\\C",), ("/z/",)], "path string"))
    assert {r.path for r in gone.collect()} == {"/d", "/z"}


def test_sources_and_context(spark):
    rows = [(1, "c1", "alpha", "/k/x/same.pdf", "pdf", 0, 2, 2.0, "keyword", 1), (2, "c2", "beta", "/k/y/same.pdf", "pdf", 1, 2, 1.0, "vector", 2), (3, "c3", "gamma", "", "pdf", 0, 1, 0.5, "vector", 3), (4, "c4", "delta", "/k/x/same.pdf", "pdf", 1, 2, 0.4, "vector", 4)]
    hits = spark.createDataFrame(rows, CHUNK + ", score double, match_type string, rank int")
    s = rag.numbered_sources(hits).orderBy("number").collect()
    assert [(r.number, r.file, r.file_path, r.snippet) for r in s] == [(1, "（来源未知）", "", "gamma"), (2, "x/same.pdf", "/k/x/same.pdf", "alpha"), (3, "y/same.pdf", "/k/y/same.pdf", "beta")]
    got = rag.answer(hits, "why", doubles.echo)
    assert [x["number"] for x in got["sources"]] == [1, 2, 3]
    text = rag.context(hits, rag.numbered_sources(hits)).first().context
    assert text.split("\n\n") == ["[1] (Source: （来源未知）, Chunk 1/1)\ngamma", "[2] (Source: x/same.pdf, Chunk 1/2)\nalpha", "[2] (Source: x/same.pdf, Chunk 2/2)\ndelta", "[3] (Source: y/same.pdf, Chunk 2/2)\nbeta"]


def test_filename_targets(spark):
    names = [f"/k/report{i:02d}.pdf" for i in range(14)] + ["/k/annual plan.docx", "/k/abc.txt"]
    files = spark.createDataFrame([(n,) for n in names], "source_file string")
    got = [r.source_file for r in rag.filename_targets(files, "What does the REPORT03 and annual plan say about abc.txt?").collect()]
    want, found = [], 0
    q = "what does the report03 and annual plan say about abc.txt?"
    for n in sorted(names):
        base = n.rsplit("/", 1)[1].lower()
        stem = base.rsplit(".", 1)[0]
        exact, piece = len(stem) >= 6 and stem in q, any(base[i: i + 6] in q for i in range(len(base) - 5))
        if exact or piece:
            found += 1
            if exact or found <= 10:
                want.append(n)
    assert sorted(got) == want


def test_postings_agree_with_scan(spark):
    c = file_chunks(spark, {"/kb/one-two.pdf": 5, "/kb/three.txt": 4}, text="alpha beta gamma ")
    p = postings.build(c)
    for q in ("alpha", "beta-gamma", "gamma-beta", "pdf", "one-two", "two-pdf zzz", "???"):
        a = sorted(r.rowid for r in postings.keyword_search(c, p, q, 50).collect())
        assert a == [r.rowid for r in search.keyword_search(c, q, 50).collect()], q


def test_ann_recall(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(20, 16))
    v = centres[r.integers(0, 20, 2000)] + 0.3 * r.normal(size=(2000, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "rowid long, vector array<double>")
    c = ann.fit(df)
    indexed, hit = ann.assign(df, c).cache(), 0
    for q in range(0, 2000, 200):
        got = {x.rowid for x in ann.search(indexed, c, v[q].tolist(), 10, max(1, len(c) // 3)).collect()}
        hit += len(got & set(np.argsort(-(v @ v[q]))[:10].tolist()))
    assert hit >= 90


def test_ann_query_recall(spark):
    got = {r.rowid for r in catalog.QUERIES["ann_search"](spark, "/root/testdata/sf0.001").collect()}
    want = {r.rowid for r in catalog.QUERIES["vector_search"](spark, "/root/testdata/sf0.001").limit(20).collect()}
    assert len(got & want) >= 10


def test_patient_model():
    tries, slept = [], []

    def call(x):
        tries.append(x)
        if len(tries) < 3:
            raise OSError("busy")
        return x

    assert model.patient(call, sleep=slept.append)(7) == 7 and slept == [1.0, 2.0]
    assert model.patient(lambda: 1 / 0, sleep=slept.append)() is None
    assert model.patient(lambda: 1 / 0, retry=lambda e: False, sleep=lambda s: None)() is None
    pick = model.in_turn(["a", "b"])
    assert [pick() for _ in range(3)] == ["a", "b", "a"]


def test_session_log_limits(spark, tmp_path):
    log = sessions.SessionLog(spark, str(tmp_path / "log"))
    assert log.sessions().count() == 0 and not log.change("x", "topic", 1, "t")
    ids = [log.create(n, f"t{n}") for n in range(4)]
    assert len(ids[0]) == 12 and log.active(9) == ids[3] and log.active(9, ids[1]) == ids[1]
    for n, i in enumerate(ids[:3]):
        assert log.change(i, "close", 10 + n)
    log.add_turn(ids[0], "user", "q", 20)
    log.enforce_limits(30, keep=2)
    # the oldest inactive ones go; ids[0] has the newest turn
    assert {r.id for r in log.sessions().collect()} == {ids[0], ids[3]} and log.turns().first().content == "q"


def test_failed_files(spark, tmp_path):
    kept = status.FailedFiles(spark, str(tmp_path / "failed"))
    assert kept.load().collect() == []
    row = spark.createDataFrame([("parse_error", "a", "/K/a"), ("duplicate", "b", "/k/b")], "group string, name string, path string")
    kept.save(row)
    kept.remove(spark.createDataFrame([("\\k\\A",)], "path string"))
    assert [r.name for r in kept.load().collect()] == ["b"]
    kept.save(row.limit(0))
    assert kept.load().collect() == []
