"""Toxicity: a learned lexicon, matched with misspellings, weighed by context.

The lexicon is the words that mark toxic documents in a bounded sample of labelled rows (at most
about SAMPLE rows, chosen by a hash of doc_id): held by at least MIN_DOCS of the toxic ones, with a
precision whose lower confidence bound is over MIN_PRECISION. Words are matched through the product
of a Levenshtein automaton (1 edit for terms of 5 letters or more, 2 from 10 letters, none below)
and the lexicon's trie, made deterministic step by step as words are read: a state is the set of
(trie node, edits) that a prefix can be in, and an empty one ends the word. Look-alike digits and
signs count as their letters. The sample also tells which near words are words of their own: those
that clean documents hold at least as often as toxic ones are exceptions. All such terms and
exceptions are used, however many; the sample bounds them.

Each hit weighs by its spelling (exact or not), by how sure the term is and by a window of WINDOW words before it: reported
or quoted speech (a quotation mark still open, a word of saying or naming just before) lowers it,
address (a second-person word) raises it. The hits' weights add up to s, and the score is
q + (1 - q) * (1 - exp(-s)), where q is the share of toxic among the sample's documents without hits.

Defined cases: null or empty text has no hits, so its score is q; without labelled rows the lexicon
is empty and q is 0; labels that are null or whose doc_id is unknown are not used; a document with
contradicting label rows counts once as toxic; repeated rows each get a result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.llm.common import durable

SAMPLE = 20_000
MIN_DOCS, MIN_PRECISION = 5, 0.5
WINDOW = 6
EXACT, NEAR = 1.4, 0.9
QUOTED, ADDRESSED = 0.35, 1.5
CACHE = 500_000
SAYING = frozenset("said says say saying called calls quoted quote wrote writes word words term terms phrase dit dijo sagte".split())
ADDRESS = frozenset("you your youre u ur tu vous du ihr sie usted".split())
_ALIKE = str.maketrans("013457@$!", "oieastasi")
_WORD = re.compile(r"[\w@$!]*[^\W_][\w@$]*")
_OPEN = re.compile("[\"“”„«»]")
_BREAK = re.compile("\n")


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class Matcher:
    """The Levenshtein automata of all terms over their trie, as one lazily built automaton."""

    STATES = 200_000

    def __init__(self, terms: list[str], allowed: list[int] | None = None):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.most: list[int] = [0]  # edits that some term below a node allows
        self.allowed = [edits(t) for t in terms] if allowed is None else allowed
        for i, t in enumerate(terms):
            node = 0
            self.most[0] = max(self.most[0], self.allowed[i])
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], self.allowed[i])
            self.term[node] = i
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.number: dict[tuple[tuple[int, int], ...], int] = {}
        self.step: dict[tuple[int, str], int] = {}
        self.start = self._state({0: 0})

    def _state(self, found: dict[int, int]) -> int:
        """Numbers a set of (node, edits), closed under letters that a word leaves out; -1: none."""
        stack = list(found.items())
        while stack:
            node, e = stack.pop()
            if found[node] == e:
                for child in self.children[node].values():
                    if e + 1 <= self.most[child] and e + 1 < found.get(child, 99):
                        found[child] = e + 1
                        stack.append((child, e + 1))
        key = tuple(sorted(found.items()))
        if not key:
            return -1
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key]

    def _next(self, state: int, c: str) -> int:
        found: dict[int, int] = {}

        def put(node, e):
            if e <= self.most[node] and e < found.get(node, 99):
                found[node] = e

        for node, e in self.states[state]:
            put(node, e + 1)
            for label, child in self.children[node].items():
                put(child, e + (label != c))
        out = self.step[state, c] = self._state(found)
        return out

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term within its allowed edits; ties: the first term."""
        if len(self.states) > self.STATES:
            self._reset()
        state, step = self.start, self.step
        for c in word:
            got = step.get((state, c))
            state = self._next(state, c) if got is None else got
            if state < 0:
                return None
        hits = [(e, self.term[n]) for n, e in self.states[state] if self.term[n] >= 0 and e <= self.allowed[self.term[n]]]
        return min(hits)[::-1] if hits else None


class Model(NamedTuple):
    terms: tuple[str, ...] = ()
    allowed: tuple[int, ...] = ()
    sure: tuple[float, ...] = ()  # lower bounds of the terms' precisions
    exceptions: frozenset[str] = frozenset()
    base: float = 0.0


class Scorer:
    def __init__(self, model: Model):
        self.matcher, self.base, self.cache = Matcher(list(model.terms), list(model.allowed)), model.base, {}
        self.exceptions, self.sure = model.exceptions, model.sure

    def _hit(self, word: str) -> float:
        """The weight of a word's spelling; 0: no term."""
        got = self.matcher.match(word)
        if got is None and not word.isalpha():
            got = self.matcher.match(word.translate(_ALIKE))
        w = 0.0 if got is None or got[1] and word in self.exceptions else (NEAR if got[1] else EXACT) * self.sure[got[0]] ** 4
        if len(self.cache) >= CACHE:
            self.cache.clear()
        if len(word) <= 40:
            self.cache[word] = w
        return w

    def weigh(self, text: str) -> float:
        """The sum of the hits' weights."""
        text = text.lower()
        words = _WORD.findall(text)
        get, hit = self.cache.get, self._hit
        weights = [w if (w := get(x)) is not None else hit(x) for x in words]
        if not any(weights):
            return 0.0
        total = 0.0
        quotes = [m.start() for m in _OPEN.finditer(text)]
        spans = [m.start() for m in _WORD.finditer(text)] if quotes else None
        breaks = [-1, *(m.start() for m in _BREAK.finditer(text))] if quotes else []
        for i, w in enumerate(weights):
            if w:
                before = words[max(0, i - WINDOW) : i]
                near = before[-3:]
                open_ = False
                if spans:
                    line = breaks[bisect_left(breaks, spans[i]) - 1]
                    open_ = (bisect_left(quotes, spans[i]) - bisect_left(quotes, line)) % 2 == 1
                if open_ or not SAYING.isdisjoint(near):
                    w *= QUOTED
                elif not ADDRESS.isdisjoint(before):
                    w *= ADDRESSED
                total += w
        return total

    def score(self, text: str) -> float:
        return self.base + (1 - self.base) * (1 - math.exp(-self.weigh(text)))


@lru_cache(4)
def _scorer(model: Model) -> Scorer:
    return Scorer(model)


def _distinct(batches):
    """(toxic, word) for each distinct word of each labelled text, counted in the task."""
    for batch in batches:
        sums: dict[tuple[int, str], int] = {}
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            for w in {x.translate(_ALIKE) for x in _WORD.findall((text.as_py() or "").lower())}:
                sums[toxic, w] = sums.get((toxic, w), 0) + 1
        yield pa.record_batch([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], ["toxic", "word", "n"])


def fit(docs: DataFrame, labels: DataFrame, train: F.Column, sample: int = SAMPLE) -> Model:
    """The model from the label rows that train admits."""
    known = labels.where(train & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if not n:
        return Model()
    chosen = known.where((F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) / F.lit(1 << 30)) < min(1.0, sample / n))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "id").select("text", "toxic")
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad:
        return Model()
    words = durable(rows.mapInArrow(_distinct, "toxic int, word string, n long").groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).alias("b")))
    p, n_ = F.col("a") / (F.col("a") + F.col("b")), F.col("a") + F.col("b")
    low = (p + 1.92 / n_ - 1.96 * F.sqrt(p * (1 - p) / n_ + 0.96 / (n_ * n_))) / (1 + 3.84 / n_)
    terms = words.where((F.col("a") >= MIN_DOCS) & (low > MIN_PRECISION)).select("word", "a", low.alias("low")).orderBy(F.desc("a"), "word").collect()
    sure = tuple(r.low for r in terms)
    terms = tuple(r.word for r in terms)

    def near(batches):
        m = Matcher(list(terms))
        for batch in batches:
            got = [m.match(w) for w in batch.column(0).to_pylist()]
            yield batch.filter(pa.array([g is not None and g[1] > 0 for g in got], pa.bool_()))

    exceptions = words.where("b >= a").select("word").mapInArrow(near, "word string").collect()
    model = Model(terms, tuple(map(edits, terms)), sure, frozenset(r.word for r in exceptions))

    def clean(batches):
        s = _scorer(model)
        for b in batches:
            keep = [s.weigh(x.as_py() or "") == 0 for x in b.column(0)]
            yield b.filter(pa.array(keep, pa.bool_())).select([1])

    left = rows.select("text", "toxic").mapInArrow(clean, "toxic int").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    return model._replace(base=(left.t or 0) / left.n if left.n else 0.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, score."""

    def run(batches):
        s = _scorer(model)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([s.score(x.as_py() or "") for x in b.column(1)], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from the rows that are not held out."""
    found = score(docs, fit(docs, labels, ~held_out()))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
