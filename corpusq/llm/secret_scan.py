"""Secret scans: fixed patterns plus a linear-chain conditional random field.

The patterns (``assign``, ``access``, ``hex``) give the base spans.  The field
adds spans of kind ``crf``: the whole text is one sequence of tokens, and each
token is tagged secret begin, inside or outside from its own shape, size and word, from the
words and shapes of the three tokens before and the two after it, and from features of
the file.  The best sequence of tags is decoded by Viterbi over the whole text; no
window or trigger limits what is looked at.

The field is trained here, on lines made by a seeded generator of assignments, headers, URLs
with credentials, key blocks, keys in prose, and look-alikes (mail addresses, numbers, paths,
versions, identifiers); no text of the corpus and no label is used, so every run and
every size gets one model.  The README says what it finds and misses on formats that
the generator does not make.

Speed: a token's part of the scores of its neighbours depends on the token alone, so it
is computed once for each distinct token; Viterbi runs over blocks of the token stream side
by side, from each state that a block can be entered in, and the blocks are chained after.

Defined cases: a null text is empty and has no spans; offsets are code points,
end exclusive; rows with one doc_id are scanned each by its own text; a ``crf`` span
may overlap base spans, which always stay; empty input gives no rows; other columns are
kept (``scan``); the spans are in ``secrets``, or ``secrets_`` if the input has such a column.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm.common import free_name, give_back, table, text_batches

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so this is a run of 16 or more
MIN_ASSIGN, MIN_ACCESS = 12, 18
#: Every match of ASSIGN has one of these in lower case.
NEEDED = ("password", "passwd", "secret", "token", "apikey", "api_key")

_RUN = "A-Za-z0-9+/_.=-"
_PART = "A-Za-z0-9+/_.-"
#: A run of key characters, with = signs that end it, or a run of other characters.
TOKEN = re.compile(rf"[{_PART}]+(?:=+(?![{_RUN}]))?|[^\s{_PART}]+")
KEYWORD = re.compile(r"passw|pwd|secret|token|api_?key|access_?key|private|credential|bearer|auth|basic", re.I | re.A)

O, B, I = range(3)
OFFSETS = (-3, -2, -1, 0, 1, 2)
PAD = 3
EDGE = ("", False)
SLICE = 1 << 20
COLUMNS_AT_ONCE = 512
REMEMBERED = 200_000
#: Stands for the rest of any lower-case word that is not known.
PLAIN = "q" * 40


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if any(w in low for w in NEEDED):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def shape(token: str) -> str:
    """The kind of a token, coarse enough to be seen in training."""
    if not re.match(rf"[{_PART}]", token):
        return "other" if token.isalpha() else "mark:" + token[0] + ("+" if len(token) > 1 else "")
    core = token.strip(".-=")
    if not core:
        return "mark:" + token[0]
    digits, upper, lower = (any(f(c) for c in core) for f in (str.isdigit, str.isupper, str.islower))
    signs = sorted(set(core) & set("+/_.-="))
    if re.fullmatch(r"[0-9.-]+", core):
        return "number"
    if not digits and not signs:
        return "word" if core[1:].islower() or len(core) == 1 else "caps" if core.isupper() else "Mixed"
    if re.fullmatch(r"[0-9a-f]+", core):
        return "hex"
    if re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", core):
        return "uuid"
    if re.fullmatch(r"[A-Za-z]{2,10}(?:[_-][A-Za-z]{2,6})?[_-][A-Za-z0-9_-]{16,}", core) and digits and upper:
        return "prefixed"
    if re.fullmatch(r"[A-Za-z0-9_-]{8,}(\.[A-Za-z0-9_-]{8,}){1,2}", core) and digits and upper and lower:
        return "dotted key"
    if "." in signs or core.count("/") > 1:
        return "path:" + ("d" if digits else "") + ("u" if upper else "")
    return "run:" + "".join(k for k, on in zip("dul", (digits, upper, lower)) if on) + ("-" if set(signs) & set("-_") else "") + ("+" if set(signs) & set("+/=") else "")


def size(token: str) -> str:
    return str(sum(len(token) >= n for n in (4, 8, 12, 16, 24, 40)))


def variety(token: str) -> str:
    """How often kinds of characters change along the token, by its length."""
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in token]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    return str(min(4, int(8 * changes / max(1, len(token)))))


def token_features(token: str, glued: bool) -> list[str]:
    """Features of a token by itself; ``glued`` says that no space is before it."""
    if not token:
        return ["edge"]
    s, n = shape(token), size(token)
    out = [f"s:{s}", f"sn:{s}/{n}", f"v:{n}/{variety(token)}", f"g:{glued}", f"sg:{s}/{glued}"]
    if len(token) <= 24 and not any(map(str.isdigit, token)):
        out.append("w:" + token.lower().strip(".-_"))
    out += [f"k:{m.lower()}" for m in set(KEYWORD.findall(token))]
    return out


def file_features(text: str) -> list[str]:
    signs = sum(text.count(c) for c in "={};<>#$*")
    return [f"signs{sum(signs > t * max(1, len(text)) for t in (0.002, 0.02, 0.1))}", f"lines{min(3, len(text) // (80 * (1 + text.count(chr(10)))))}"]


def tokens_of(text: str) -> list[tuple[int, str, bool]]:
    """(start, token, glued) of a text."""
    out, end = [], -1
    for m in TOKEN.finditer(text):
        out.append((m.start(), m[0], m.start() == end))
        end = m.end()
    return out


def _lines(r: random.Random, n: int) -> Iterator[list[tuple[str, bool]]]:
    """Made-up lines with tags: lists of (piece of text, is secret)."""
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa, b64, alnum = string.digits + "abcdef", string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits
    url64 = alnum + "-_"
    syllables = "er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    glue = "the a is was of to in and for with your this my use set see new old first by from".split()

    def bare(k=4):
        return "".join(r.choice(syllables) for _ in range(r.randint(1, k)))

    def word():
        w = bare(8)
        return r.choice([w, w, w, r.choice(glue), w.capitalize(), w.upper(), w + r.choice(",.;!"), w + "!!", w + "***", w + "$$$", w + "%%%", "é" + w, w + "ü" + w])

    def mixed(k):
        """Letters of both cases and digits, all of them there."""
        while True:
            x = pick(alnum, k)
            if any(map(str.isdigit, x)) and any(map(str.isupper, x)) and any(map(str.islower, x)):
                return x

    def key():
        k = r.random()
        if k < 0.15:
            return pick(hexa, r.choice([16, 20, 32, 40, 64]))
        if k < 0.3:
            return pick(b64, r.choice([20, 24, 40, 44, 64])) + r.choice(["", "", "=", "=="])
        if k < 0.4:
            return "AKIA" + pick(string.ascii_uppercase + string.digits, 16)
        if k < 0.6:
            return r.choice([bare(2), pick(string.ascii_lowercase, r.randint(2, 4))]) + r.choice(["_", "-", "_live_", "_test_", "-proj-"]) + r.choice([mixed(r.choice([20, 24, 32, 36, 48])), f"{pick(string.digits, 12)}-{mixed(24)}"])
        if k < 0.7:
            return "AIza" + mixed(20) + "-" + mixed(14)
        if k < 0.82:
            return "eyJ" + mixed(r.randint(15, 60)) + "." + r.choice(["eyJ", ""]) + mixed(r.randint(20, 80)) + "." + pick(url64, r.randint(22, 43))
        if k < 0.88:
            return pick(string.ascii_uppercase, 2) + "." + mixed(22) + "." + pick(url64, 43)
        return mixed(r.randint(16, 40))

    def password():
        k = r.random()
        if k < 0.35:
            return "".join(pick(alnum, r.randint(1, 4)) + r.choice("$!@#%&*") for _ in range(r.randint(2, 4))) + mixed(4)
        if k < 0.7:
            return r.choice([bare().capitalize(), bare()]) + pick(string.digits, r.randint(1, 4)) + r.choice(["", "!", "#", bare(), "@" + pick(string.digits, 2)])
        return mixed(r.randint(8, 14))

    def lookalike():
        w = bare()
        return r.choice([
            f"{w}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com", f"https://www.{w}.example.org/{w}/{r.randint(1, 9999)}.html?page={r.randint(1, 9)}", f"http://{w}.example.net/{bare()}/{r.randint(1, 999999)}#top",
            f"https://{w}.example.org:{r.randint(80, 9999)}/{bare()}?q={bare()}&id={r.randint(1, 9999)}", f"{w}@{bare()}.org",
            f"+{r.randint(1, 99)} ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)}", f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}:00:00",
            f"/usr/lib/{w}-{r.randint(1, 9)}.{r.randint(0, 20)}/{w}", f"C:/{w.capitalize()}/{bare().capitalize()}/{bare()}.txt", f"{w}_{bare(8)}_{r.randint(1, 99)}", f"{w}-{w}-{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}", pick(string.digits, r.randint(9, 15)),
            f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(1, 255)}", f"{w}/{w}={w}", f"____{w}____", "=" * r.randint(12, 30), f"{w}...{w}-{w}",
            "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), w + bare().capitalize() + bare().capitalize() + r.choice(["", "2", "V1"]), f"{w.upper()}_{bare().upper()}_{bare().upper()}", f"org.{w}.{bare()}.{bare().capitalize()}{bare().capitalize()}",
            f"978-{r.randint(0, 9)}-{r.randint(1000, 9999)}-{r.randint(1000, 9999)}-{r.randint(0, 9)}", f"10.{r.randint(1000, 9999)}/{w}.{r.randint(2000, 2024)}.{r.randint(10, 99)}", f"{w} | {bare()} | {bare()}", f"{w.upper()}{r.randint(10, 999)}", "-----BEGIN CERTIFICATE REQUEST-----",
        ])

    keywords = "password passwd secret token api_key apikey API_KEY Token SECRET client_secret access_key auth_token db_password credential pwd Pwd PASSWORD pass private_key".split()
    names = [*keywords, *keywords, "key", "KEY", "PAT", "pat", "secretKey", "accessToken", "webhook_secret", "signing_key"]

    def named():
        name = r.choice(names)
        return r.choice([name, name, f"{bare()}_{name}", f"{bare().upper()}_{name.upper()}"])

    for _ in range(n):
        prose = lambda: [(" ".join(word() for _ in range(r.randint(0, 7))), False)]
        k = r.random()
        if k < 0.22:
            q = r.choice(["", '"', "'"])
            sep = r.choice([" = ", "=", ": ", " : ", q + ": ", " => ", ":"])
            mid = [(r.choice(["", "export ", "const ", "- ", "--", q]) + named() + sep + q, False), (r.choice([key, key, password])(), True), (q + r.choice(["", ",", ";", ""]), False)]
        elif k < 0.3:
            mid = [(r.choice(["Bearer ", "Authorization: Bearer ", "auth ", "Authorization: Basic ", "-H 'Authorization: Bearer "]), False), (key(), True), (r.choice(["", "'", '"']), False)]
        elif k < 0.38:
            mid = [(r.choice(["", "found ", "key ", "use ", f"{bare()} ", "("]), False), (key(), True), (r.choice(["", ")", "", ","]), False)]
        elif k < 0.46:
            mid = [(f"{r.choice(['postgres', 'mysql', 'mongodb', 'https', 'amqp', 'redis', 'ftp', bare(2)])}://{r.choice([bare(), bare(), ''])}:", False), (password().replace("@", "."), True), (f"@{bare()}.{r.choice(['internal', 'example.com', bare()])}{r.choice(['', ':5432', ':27017'])}{r.choice(['', '/' + bare()])}", False)]
        elif k < 0.52:
            lines = "\n".join(pick(b64, 64) for _ in range(r.randint(1, 4))) + "\n" + pick(b64, r.randint(8, 60)) + r.choice(["", "=", "=="])
            kind = r.choice(["RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY"])
            mid = [(f"-----BEGIN {kind}-----\n", False), ("MII" + lines, True), (f"\n-----END {kind}-----", False)]
        elif k < 0.57:
            mid = [(f"{r.choice(['curl -u ', 'wget --user ', '-u ', 'login ', 'curl --user '])}{bare()}:", False), (password(), True), (r.choice([" ", " https://" + bare() + ".example.com"]), False)]
        elif k < 0.63:
            mid = [(f"{r.choice(['Server', 'Host'])}={bare()};{r.choice(['Uid', 'User Id', 'User'])}={bare()};{r.choice(['Pwd', 'Password'])}=", False), (password().replace(";", ""), True), (r.choice([";", ""]), False)]
        elif k < 0.68:
            mid = [(f"{r.choice(['the ', 'my ', 'your ', ''])}{r.choice(['password', 'token', 'secret', 'key', 'passwd', 'pwd'])} {r.choice(['is', 'was', 'is now', 'will be'])} ", False), (r.choice([mixed(10), password(), key()]), True)]
        elif k < 0.9:
            mid = [(lookalike(), False)]
        else:
            mid = [(f"{r.choice(keywords)} {r.choice(['of', 'is', 'was', ':', '=', 'and', 'for the'])} {r.choice([word(), 'required', 'too short', 'null', 'missing', 'expired'])} {word()}", False)]
        yield [*prose(), (" ", False), *mid, (r.choice([" ", "\n"]), False), *prose()]


def tagged_line(pieces: list[tuple[str, bool]]) -> tuple[list[tuple[str, bool]], list[int], str]:
    text = "".join(p for p, _ in pieces)
    marks, at = [], 0
    for p, is_secret in pieces:
        if is_secret:
            marks.append((at, at + len(p)))
        at += len(p)
    tokens, tags, was = [], [], None
    for start, token, glued in tokens_of(text):
        inside = next((s for s in marks if start < s[1] and start + len(token) > s[0]), None)
        tokens.append((token, glued))
        tags.append(O if inside is None else I if inside == was else B)
        was = inside
    return tokens, tags, text


class ChainCRF:
    """Emission weights by offset and feature, weights of file features, transitions; exact training and decoding."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.files: dict[str, int] = {}
        self.w, self.f, self.t = np.zeros((len(OFFSETS), 1, 3)), np.zeros((0, 3)), np.zeros((3, 3))

    def known(self, token: str, glued: bool) -> list[int]:
        return [j for x in token_features(token, glued) if (j := self.index.get(x)) is not None]

    def parts(self, token: str, glued: bool) -> np.ndarray:
        """(offsets, tags): what the token adds to the scores of the tokens that it is at each offset of."""
        return self.w[:, self.known(token, glued)].sum(axis=1)

    def file_part(self, features: list[str]) -> np.ndarray:
        return self.f[[self.files[x] for x in features if x in self.files]].sum(axis=0)

    def emissions(self, tokens: list[tuple[str, bool]], file: list[str]) -> np.ndarray:
        """Scores (tokens, tags) of one sequence."""
        parts = np.stack([self.parts(*x) for x in [*[EDGE] * PAD, *tokens, *[EDGE] * PAD]])
        return sum(parts[PAD + o: PAD + o + len(tokens), j] for j, o in enumerate(OFFSETS)) + self.file_part(file)

    def fit(self, sequences: list[tuple[list[tuple[str, bool]], list[int], list[str]]], steps: int = 90, rate: float = 0.1, decay: float = 2e-4) -> ChainCRF:
        kinds: dict[tuple[str, bool], int] = {EDGE: 0}
        for tokens, _, _ in sequences:
            for x in tokens:
                kinds.setdefault(x, len(kinds))
        feats = [token_features(*x) for x in kinds]
        seen: dict[str, int] = {}
        for f in feats:
            for x in f:
                seen[x] = seen.get(x, 0) + 1
        # words of one made-up token only would be learnt by heart
        self.index = {x: j for j, x in enumerate(x for x, c in seen.items() if c > 1 or not x.startswith("w:"))}
        self.files = {x: j for j, x in enumerate(sorted({x for _, _, file in sequences for x in file}))}
        n_feats = len(self.index)
        width = max(map(len, feats))
        of = np.full((len(kinds), width), n_feats)
        for i, f in enumerate(feats):
            got = [self.index[x] for x in f if x in self.index]
            of[i, : len(got)] = got
        n, length = len(sequences), max(len(y) for _, y, _ in sequences)
        tok, tags, mask = np.zeros((n, length + 2 * PAD), int), np.zeros((n, length), int), np.zeros((n, length))
        file = np.zeros((n, len(self.files)))
        for i, (tokens, y, names) in enumerate(sequences):
            tok[i, PAD: PAD + len(y)], tags[i, : len(y)], mask[i, : len(y)] = [kinds[x] for x in tokens], y, 1
            file[i, [self.files[x] for x in names]] = 1
        ends = mask.sum(axis=1).astype(int) - 1
        n_off = len(OFFSETS)
        w, f, t = np.zeros((n_feats + 1, n_off, 3)), np.zeros((len(self.files), 3)), np.zeros((3, 3))
        gold = np.eye(3)[tags] * mask[..., None]
        pairs = mask[:, 1:] * mask[:, :-1]
        gold_t = np.zeros_like(t)
        np.add.at(gold_t, (tags[:, :-1], tags[:, 1:]), pairs)
        np.add.at(gold_t, (O, tags[:, 0]), 1.0)
        np.add.at(gold_t, (tags[np.arange(n), ends], O), 1.0)
        views = [tok[:, PAD + o: PAD + o + length] for o in OFFSETS]
        by_feature = np.argsort(of.ravel(), kind="stable")
        heads = np.searchsorted(of.ravel()[by_feature], np.arange(n_feats + 1))
        moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, f, t)]
        unit = lambda x: x / x.sum(axis=-1, keepdims=True)
        for step in range(1, steps + 1):
            by_kind = w[of].sum(axis=1)
            e = sum(by_kind[view, j] for j, view in enumerate(views)) + (file @ f)[:, None, :]
            # forward and backward in units of probability, made to sum to 1 at every place
            ex, move = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(t)
            ahead, behind = np.empty((length, n, 3)), np.empty((length, n, 3))
            ahead[0] = unit(move[O] * ex[:, 0])
            for j in range(1, length):
                ahead[j] = np.where(mask[:, j, None] > 0, unit((ahead[j - 1] @ move) * ex[:, j]), ahead[j - 1])
            behind[-1] = move[:, O]
            for j in range(length - 2, -1, -1):
                behind[j] = np.where(mask[:, j + 1, None] > 0, unit((ex[:, j + 1] * behind[j + 1]) @ move.T), move[:, O])
            node = unit((ahead * behind).transpose(1, 0, 2)) * mask[..., None]
            wrong = node - gold
            grad_kind = np.stack([np.stack([np.bincount(view.ravel(), wrong[:, :, tag].ravel(), len(kinds)) for tag in range(3)], axis=1) for view in views], axis=1)
            grad_w = np.add.reduceat(grad_kind[by_feature // width], heads, axis=0)
            edge = ahead[:-1, :, :, None] * move * (ex[:, 1:].transpose(1, 0, 2) * behind[1:])[:, :, None, :]
            edge = edge / edge.sum(axis=(2, 3), keepdims=True) * pairs.T[..., None, None]
            grad_t = edge.sum(axis=(0, 1))
            grad_t[O] += node[:, 0].sum(axis=0)
            grad_t[:, O] += node[np.arange(n), ends].sum(axis=0)
            for x, grad, (m, v) in zip((w, f, t), (grad_w, file.T @ wrong.sum(axis=1), grad_t - gold_t), moments):
                grad = grad / n + decay * x
                m += 0.1 * (grad - m)
                v += 0.001 * (grad**2 - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w[-1] = 0
        self.w, self.f, self.t = w[:-1].transpose(1, 0, 2).copy(), f, t
        return self


def viterbi(e: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The best tags for scores ``e`` (places, tags), exactly; the sequence starts and ends outside.

    The places are cut into rows of one length.  Each row is run from every state it
    can be entered in, all rows at once; then the rows are chained and traced back.
    """
    n = len(e)
    if not n:
        return np.empty(0, np.int64)
    cols = min(COLUMNS_AT_ONCE, max(1, int(n**0.5)))
    rows = -(-n // cols)
    full = np.zeros((rows * cols, 3))
    full[:n] = e
    full[n:, 1:] = -1e9  # what is filled up is outside
    full = np.ascontiguousarray(full.reshape(rows, cols, 3).transpose(1, 2, 0))
    step = t[:, :, None]
    through = np.where(np.eye(3, dtype=bool), 0.0, -1e18)[:, :, None].repeat(rows, axis=2)
    for c in range(cols):
        # (entered in, now in, row), so that each step is a few operations on long rows
        through = np.maximum(np.maximum(through[:, None, 0] + step[0], through[:, None, 1] + step[1]), through[:, None, 2] + step[2]) + full[c]
    through = through.transpose(2, 0, 1)
    entry = np.empty((rows, 3))
    now = np.array([0.0, -1e18, -1e18])
    for i in range(rows):
        entry[i] = now
        now = (now[:, None] + through[i]).max(axis=0)
    best, back = entry.T, np.empty((cols, 3, rows), np.int8)
    for c in range(cols):
        from_ = best[0] + step[0]
        back[c] = 0
        for i in (1, 2):
            other = best[i] + step[i]
            back[c][other > from_] = i
            from_ = np.maximum(from_, other)
        best = from_ + full[c]
    tags = np.empty((rows, cols), np.int64)
    last = np.empty(rows, np.int64)
    state = int((now + t[:, O]).argmax())
    for i in range(rows - 1, -1, -1):
        last[i] = state
        state = int((entry[i] + through[i, :, state]).argmax())
    at = np.arange(rows)
    for c in range(cols - 1, -1, -1):
        tags[:, c] = last
        last = back[c, last, at]
    return tags.ravel()[:n]


class Tagger:
    """Tags whole texts, many at once; remembers the scores of tokens and the tokens of words."""

    def __init__(self, crf: ChainCRF):
        self.crf = crf
        self.forget()

    def forget(self) -> None:
        self.ids: dict[tuple[str, bool], int] = {EDGE: 0}
        self.words: dict[str, list[int]] = {}
        self.rows = [self.crf.parts(*EDGE)]
        self.table = np.empty((0, len(OFFSETS), 3), np.float32)

    def token(self, token: str, glued: bool) -> int:
        if token.isalpha() and token.isascii() and (token.islower() or token.istitle()):
            low = token.lower()
            if "w:" + low not in self.crf.index and not KEYWORD.search(low):
                token = ("A" if token[0].isupper() else "a") + PLAIN[: min(len(token), 40) - 1]  # all that its features tell of it
        got = self.ids.get((token, glued))
        if got is None:
            got = self.ids[token, glued] = len(self.rows)
            self.rows.append(self.crf.parts(token, glued))
        return got

    def word(self, word: str) -> list[int]:
        got = self.words.get(word)
        if got is None:
            got = self.words[word] = [self.token(x, g) for _, x, g in tokens_of(word)]
        return got

    def tags(self, texts: list[str]) -> list[np.ndarray | None]:
        """For each text the tags of its tokens; None if all are outside."""
        import pyarrow.compute as pc

        if len(self.rows) > REMEMBERED or len(self.words) > REMEMBERED:
            self.forget()
        split = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        bounds = split.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        coded = split.flatten().dictionary_encode()
        known = [self.word(w) for w in coded.dictionary.to_pylist()]
        of = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.fromiter(map(len, known), np.int64, len(known))
        flat = np.fromiter((x for w in known for x in w), np.int64, int(sizes.sum()))
        n = sizes[of]
        upto = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(upto[-1]) + np.repeat((np.cumsum(sizes) - sizes)[of] - upto[:-1], n)
        counts = np.diff(upto[bounds])
        starts = upto[bounds[:-1]]
        stream = np.insert(flat[at], np.repeat(np.append(starts, upto[-1]), PAD), 0)
        if len(self.table) != len(self.rows):
            self.table = np.concatenate([self.table, np.stack(self.rows[len(self.table):]).astype(np.float32)])
        e = np.zeros((len(stream), 3), np.float32)
        for j, o in enumerate(OFFSETS):
            e[PAD: len(e) - PAD] += self.table[stream[PAD + o: len(stream) - PAD + o], j]
        first = starts + PAD * (1 + np.arange(len(texts)))
        bias = np.stack([self.crf.file_part(file_features(x)) for x in texts]).astype(np.float32)
        inside = np.ones(len(stream), bool)
        inside[np.add.outer(np.append(first - PAD, len(stream) - PAD), np.arange(PAD)).ravel()] = False
        e[inside] += np.repeat(bias, counts, axis=0)
        e[~inside] = (0.0, -1e9, -1e9)  # between texts all is outside, so each text is a sequence of its own
        got = viterbi(e, self.crf.t)
        hit = np.flatnonzero(got)
        marked = set(np.searchsorted(first, hit, "right") - 1)
        return [got[first[i]: first[i] + counts[i]] if i in marked else None for i in range(len(texts))]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        out = []
        for text, tags in zip(texts, self.tags(texts)):
            found: list[tuple[int, int, str]] = []
            if tags is not None:
                places = tokens_of(text)
                if len(places) != len(tags):  # white space that Arrow and Python see differently
                    places = [(s, x, g) for s, x, g in places]
                    tags = viterbi(self.crf.emissions([(x, g) for _, x, g in places], file_features(text)), self.crf.t)
                start = None
                for i, tag in enumerate([*tags, O]):
                    if tag != I and start is not None:
                        found.append((places[start][0], places[i - 1][0] + len(places[i - 1][1]), "crf"))
                        start = None
                    if tag == B or tag == I and start is None:
                        start = i
            out.append(found)
        return out


@lru_cache(maxsize=2)
def model(seed: int = 11, lines: int = 2000) -> ChainCRF:
    """The trained field; made once in each process, always the same."""
    r = random.Random(seed)
    sequences = []
    for pieces in _lines(r, lines):
        tokens, tags, _ = tagged_line(pieces)
        if tokens:
            # lines stand alone here but in long texts there: features of the file vary at random
            sequences.append((tokens, tags, [f"signs{r.choice([0, 0, 1, 1, 2, 3])}", f"lines{r.randint(0, 3)}"]))
    return ChainCRF().fit(sequences)


def spans(texts: list[str], tagger: Tagger) -> list[list[dict]]:
    """All spans of each text by start, then kind as listed in ``KINDS``."""
    out = []
    for text, more in zip(texts, tagger.spans(texts)):
        found = base_spans(text) + more
        out.append([{"kind": k, "start": a, "end": b} for a, b, k in sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))])
    return out


_TAGGERS: dict[bytes, Tagger] = {}


def _tagger(crf: ChainCRF) -> Tagger:
    """The Python worker's tagger; it serves one task after the other."""
    key = crf.t.tobytes()
    if key not in _TAGGERS:
        _TAGGERS.clear()
        _TAGGERS[key] = Tagger(crf)
    return _TAGGERS[key]


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``secrets``: an array of (kind, start, end) in order."""
    text_batches(docs.sparkSession)
    crf = model()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf("array<struct<kind:string,start:int,end:int>>")
    def find(texts: pa.Array) -> pa.Array:
        tagger, out, held, n = _tagger(crf), [], [], 0
        for text in map(pa.StringScalar.as_py, texts):
            held.append(text or "")
            n += len(held[-1])
            if n >= SLICE:
                out += spans(held, tagger)
                held, n = [], 0
        if held:
            out += spans(held, tagger)
        give_back()
        return pa.array(out, kind)

    return docs.withColumn(free_name(docs, "secrets"), find(F.col("text")))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(text(F.filter("secrets", lambda s: s["kind"] != "crf")).cast("binary"), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"), of("crf").alias("n_crf"),
    )
