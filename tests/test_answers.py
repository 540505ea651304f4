"""Questions from search to answer, and the comparison of texts."""

import json

from corpusq.operators import analysis, rag

CHUNKS = [(1, "alpha beta", "/k/one/plan.pdf"), (2, "alpha gamma", "/k/two/plan.pdf"), (3, "delta", "/k/other.txt")]
TURN = "session_id string, id long, role string, content string, sources array<struct<file:string,file_path:string>>"


def chunks(spark, rows=CHUNKS):
    return spark.createDataFrame([(i, f"c{i}", t, p, "pdf", 0, 1, [1.0, float(i)]) for i, t, p in rows], "rowid long, chunk_id string, text string, source_file string, file_type string, chunk_index long, total_chunks long, vector array<float>")


def test_asked_with_history(spark):
    turns = spark.createDataFrame([
        ("s", 1, "user", "first?", None), ("s", 2, "assistant", "see [1]", [("", "/old/a.pdf"), ("b.pdf", "/x/c.pdf")]), ("s", 3, "user", "and [2] or [7]?", None), ("s", 4, "system", "noise", None), ("t", 1, "user", "other", None)], TURN)
    seen = []

    def generate(prompt):
        return prompt

    got = rag.ask(chunks(spark), "alpha", lambda q: [1.0, 0.0], generate, 5, turns, "s")
    messages = json.loads(got["answer"])
    assert [m["role"] for m in messages] == ["system", "user", "assistant", "user", "user"] and seen == []
    system = messages[0]["content"]
    assert system.startswith(rag.WITH_CONTEXT) and "(Source: one/plan.pdf" in system and system.endswith("  [1] → a.pdf\n  [2] → b.pdf" + rag.LEGEND_ENDS)
    assert messages[3]["content"] == "and [2](指上轮「b.pdf」) or [7]?" and messages[4]["content"] == "alpha"
    assert {s["file"] for s in got["sources"]} >= {"one/plan.pdf", "two/plan.pdf"}


def test_asked_without_history_or_answer(spark):
    def no_service(query):
        raise TimeoutError

    got = rag.ask(chunks(spark), "alpha", no_service, lambda prompt: None)
    assert got["answer"] == rag.FAILED and [s["file"] for s in got["sources"]] == ["one/plan.pdf", "two/plan.pdf"]
    told = json.loads(rag.ask(chunks(spark), "alpha", no_service, lambda prompt: prompt, given_context="only this")["answer"])
    assert [m["content"] for m in told] == [rag.WITH_CONTEXT + "only this", "alpha"]
    none = json.loads(rag.ask(chunks(spark), "nowhere", no_service, lambda prompt: prompt)["answer"])
    assert none[0]["content"] == rag.WITHOUT_CONTEXT


def test_compared(spark):
    made = analysis.compare(chunks(spark), "alpha", lambda prompt: prompt).first()
    assert made.answer.startswith("alpha\n\n===== plan.pdf =====\n--- Chunk 1/1 ---\nalpha beta") and (made.files, made.total_hit) == (2, 2)
    some = analysis.compare(chunks(spark), "alpha delta", lambda prompt: prompt, max_files=1).first()
    assert some.answer.endswith("\n（共命中 3 个文件，此处展示最相关的 1 个）") and len(some.sources) == 1
    assert analysis.compare(chunks(spark), "alpha", lambda prompt: "").first().answer == analysis.NOT_COMPARED
    none = analysis.compare(chunks(spark), "nowhere", lambda prompt: prompt).first()
    assert (none.answer, none.files, none.total_hit, none.sources) == (analysis.NOTHING, 0, 0, [])
