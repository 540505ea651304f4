"""The full-text query language over postings: phrases, AND, OR, NOT, NEAR, prefixes, first words and columns.

``parse`` reads a query into a small tree, ``rows`` turns the tree into joins over postings (token, rowid,
part, pos): a phrase is a join of its words by place, AND an intersection, OR a union, NOT an
anti-join, NEAR one window over the places of its phrases in a text.  No text is read.

The language is that of SQLite's FTS5 (see its public documentation):

* ``word`` or ``"some words"``, ``""`` inside quotes for a quote; ``a + b`` makes one phrase of two; ``wor*`` takes any ending; ``^word`` must come first in its column.
* ``a b`` is a AND b and binds before all else; then NOT, AND, OR; parentheses.
* ``NEAR(a b c, n)``: at most n (10) words between the first and the last.
* ``text : x``, ``{text source_file} : x``, ``- text : x``: only in, or not in, the columns named.

A phrase without any word (``"???"``) is passed over beside others in ``a b`` and OR; AND with it, or it alone, finds nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions.text import python_tokens, tokens

#: Columns of the index and the ``part`` that postings have for each.
COLUMNS = {"text": "text", "source_file": "path"}
NEAR_WORDS = 10
_LEX = re.compile(r'\s+|(?P<quoted>"(?:[^"]|"")*")|(?P<word>[A-Za-z0-9_\x1a\x80-\U0010ffff]+)|(?P<sign>[(){}:+*,^-])', re.S)


class QueryError(ValueError):
    """A query that does not follow the syntax."""


@dataclass(frozen=True)
class Phrase:
    """Words in a row, each with whether it is a beginning only; ``first``: at the beginning of its column."""

    words: tuple[tuple[str, bool], ...]
    first: bool = False


@dataclass(frozen=True)
class Near:
    """All phrases in one column of those given, with at most ``apart`` words between."""

    phrases: tuple[Phrase, ...]
    apart: int
    parts: frozenset[str]


@dataclass(frozen=True)
class Both:
    """op (AND, OR, NOT) of two trees."""

    op: str
    left: Node
    right: Node


Node = Near | Both | None  # None finds nothing


class _Parser:
    def __init__(self, query: str):
        self.items: list[tuple[str, str]] = []
        at = 0
        while at < len(query):
            m = _LEX.match(query, at)
            if not m:
                raise QueryError(f"syntax error near {query[at:at + 20]!r}")
            if m.lastgroup:
                word = m.lastgroup == "word" and m[0] in ("AND", "OR", "NOT")
                self.items.append(("op" if word else m.lastgroup, m[0]))
            at = m.end()
        self.at = 0

    def peek(self, *signs: str) -> bool:
        return self.at < len(self.items) and self.items[self.at][1] in signs and self.items[self.at][0] in ("op", "sign")

    def take(self, *signs: str) -> bool:
        found = self.peek(*signs)
        self.at += found
        return found

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise self.error()

    def error(self) -> QueryError:
        return QueryError(f"syntax error near {self.items[self.at][1] if self.at < len(self.items) else ''!r}")

    def string(self) -> str | None:
        if self.at < len(self.items) and self.items[self.at][0] in ("quoted", "word"):
            kind, text = self.items[self.at]
            self.at += 1
            return text[1:-1].replace('""', '"') if kind == "quoted" else text
        return None

    def whole(self, level: int = 0, parts: frozenset[str] = frozenset(COLUMNS.values())) -> Node:
        """OR of AND of NOT of sequences."""
        if level == 3:
            return self.sequence(parts)
        op = ("OR", "AND", "NOT")[level]
        left = self.whole(level + 1, parts)
        while self.take(op):
            left = both(op, left, self.whole(level + 1, parts))
        return left

    def columns(self) -> frozenset[str] | None:
        """The columns of a filter up to its colon, or None where none begins here."""
        start = self.at
        without = self.take("-")
        if self.take("{"):
            names = []
            while not self.take("}"):
                name = self.string()
                if name is None:
                    raise self.error()
                names.append(name)
            if not names:
                raise self.error()
        else:
            names = [self.string()]
        if names == [None] or not self.take(":"):
            if without:
                raise self.error()
            self.at = start
            return None
        unknown = [n for n in names if n.lower() not in COLUMNS]
        if unknown:
            raise QueryError(f"no such column: {unknown[0]}")
        chosen = frozenset(COLUMNS[n.lower()] for n in names)
        return frozenset(COLUMNS.values()) - chosen if without else chosen

    def sequence(self, parts: frozenset[str]) -> Node:
        if self.take("("):
            inner = self.whole(0, parts)
            self.need(")")
            return inner
        out, n = None, 0
        while self.at < len(self.items) and (self.items[self.at][0] in ("quoted", "word") or self.peek("^", "-", "{")):
            chosen = self.columns()
            if chosen is not None and self.peek("("):
                if n:
                    raise self.error()
                self.take("(")
                inner = self.whole(0, parts & chosen)
                self.need(")")
                return inner
            made = self.near(parts if chosen is None else parts & chosen)
            # phrases without words are passed over here
            out, n = made if out is None else out if made is None else Both("AND", out, made), n + 1
        if not n:
            raise self.error()
        return out

    def near(self, parts: frozenset[str]) -> Node:
        first = self.take("^")
        if not first and self.at + 1 < len(self.items) and self.items[self.at + 1] == ("sign", "("):
            if self.items[self.at] != ("word", "NEAR"):
                raise self.error()
            self.at += 2
            phrases, apart = [self.phrase()], NEAR_WORDS
            while not self.peek(",", ")"):
                phrases.append(self.phrase())
            if self.take(","):
                n = self.string()
                if n is None or not n.isascii() or not n.isdigit():
                    raise QueryError(f"expected integer, got {n!r}")
                apart = int(n)
            self.need(")")
        else:
            phrases, apart = [self.phrase(first)], 0
        phrases = [p for p in phrases if p.words]
        return Near(tuple(phrases), apart, parts) if phrases else None

    def phrase(self, first: bool = False) -> Phrase:
        words: list[tuple[str, bool]] = []
        while True:
            text = self.string()
            if text is None:
                raise self.error()
            more = [(w, False) for w in python_tokens(text)]
            star = self.take("*")
            words += more[:-1] + [(more[-1][0], star)] if more else []
            if not self.take("+"):
                return Phrase(tuple(words), first)


def both(op: str, left: Node, right: Node) -> Node:
    if op == "AND":
        return None if left is None or right is None else Both(op, left, right)
    if op == "OR":
        return right if left is None else left if right is None else Both(op, left, right)
    return left if left is None or right is None else Both(op, left, right)


def parse(query: str) -> Node:
    """The tree of a query; None if it can find nothing.  Raises ``QueryError`` where the syntax is wrong."""
    p = _Parser(query)
    tree = p.whole()
    if p.at < len(p.items):
        raise p.error()
    return tree


def all_words(query: str) -> Node:
    """The tree that asks for every word of a text, in any column."""
    words = [Near((Phrase(((w, False),)),), 0, frozenset(COLUMNS.values())) for w in python_tokens(query)]
    return reduce(lambda a, b: Both("AND", a, b), words) if words else None


def postings(chunks: DataFrame) -> DataFrame:
    """token, rowid, part (text or path), pos: every word of the chunks."""
    each = lambda column, part: chunks.select("rowid", F.lit(part).alias("part"), F.posexplode(tokens(F.col(column))).alias("pos", "token"))
    return reduce(DataFrame.unionByName, [each(*c) for c in COLUMNS.items()]).select("token", "rowid", "part", "pos")


def words_of(tree: Node) -> set[tuple[str, bool]]:
    """All words of a tree, each with whether it is a beginning only."""
    if tree is None:
        return set()
    if isinstance(tree, Both):
        return words_of(tree.left) | words_of(tree.right)
    return {w for p in tree.phrases for w in p.words}


def _is(word: str, start: bool) -> Column:
    return F.col("token").startswith(word) if start else F.col("token") == word


def wanted(tree: Node) -> Column:
    """Whether a posting's token is one of the tree's."""
    return reduce(Column.__or__, [_is(*w) for w in sorted(words_of(tree))], F.lit(False))


def _places(postings: DataFrame, phrase: Phrase, parts: frozenset[str]) -> DataFrame:
    """rowid, part, at: where the phrase begins."""
    some = postings.filter(F.col("part").isin(*sorted(parts)))
    each = []
    for i, word in enumerate(phrase.words):
        found = some.filter(_is(*word)).select("rowid", "part", (F.col("pos") - i).alias("at"))
        each.append(found)
    out = reduce(lambda a, b: a.join(b, ["rowid", "part", "at"], "left_semi"), each)
    return out.filter("at = 0") if phrase.first else out


def _near(postings: DataFrame, near: Near) -> DataFrame:
    """rowid of texts with an anchor before which, not too far, every phrase begins; one window over their places."""
    if not near.parts:
        return postings.select("rowid").limit(0)
    places = [_places(postings, p, near.parts) for p in near.phrases]
    if len(places) == 1:
        return places[0].select("rowid").distinct()
    all_ = reduce(DataFrame.unionByName, [p.withColumn("phrase", F.lit(i)) for i, p in enumerate(places)])
    upto = Window.partitionBy("rowid", "part").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)  # places in one text
    close = F.lit(True)
    for i, p in enumerate(near.phrases):
        last = F.max(F.when(F.col("phrase") == i, F.col("at"))).over(upto)
        close = close & F.coalesce(last >= F.col("at") - F.lit(len(p.words) + near.apart), F.lit(False))
    return all_.withColumn("close", close).filter("close").select("rowid").distinct()


def search(chunks: DataFrame, query: str, postings_: DataFrame | None = None) -> DataFrame:
    """The chunks that match, without limit.  With stored postings no text is read but those of the result; without, all are."""
    tree = parse(query)
    found = rows(postings(chunks).filter(wanted(tree)) if postings_ is None else postings_, tree)
    return chunks.join(found, "rowid", "left_semi")


def rows(postings: DataFrame, tree: Node) -> DataFrame:
    """rowid of the chunks that match, each once."""
    if tree is None:
        return postings.select("rowid").limit(0)
    if isinstance(tree, Near):
        return _near(postings, tree)
    left, right = rows(postings, tree.left), rows(postings, tree.right)
    if tree.op == "OR":
        return left.unionByName(right).distinct()
    return left.join(right, "rowid", "left_semi" if tree.op == "AND" else "left_anti")
