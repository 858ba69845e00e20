"""Toxicity: a lexicon learned from labelled documents, matched exactly and through
Levenshtein automata intersected with its trie, and scored in context.

Terms are words, or stems (the first letters of many words), that toxic documents of
a labelled sample use and clean ones do not, across texts that are not copies of each
other. All terms sit in one trie; the product of that trie with the Levenshtein
automaton is determinised as words are read, so a word costs a table look-up for each
letter and most die after three. Words at a small edit distance count as misspelled
unless clean documents use them too. What surrounds a match (quotation marks, words
of reporting) tells quotation from abuse. A logistic regression weighs all of it.

Defined results: null and empty texts get the score of a text without matches;
without labels of both kinds the lexicon is empty and the score is the smoothed rate
of label 1; texts and words of any length count whole; repeated rows give repeated
results, and labels that speak against each other count as toxic; an empty table gives no
rows; extra columns are ignored by ``classify`` and kept by ``reject``.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, trimmed

#: Labelled documents that the lexicon and the weights are fitted on, about, at most.
MAX_LABELLED = 20_000
MIN_DOCS, MIN_TEXTS, MIN_WEIGHT = 6, 5, 1.5
#: Terms that weigh less than this are not looked for in misspelled form.
MIN_FUZZY = 4.0
STEM = range(4, 10)
THRESHOLD = 0.7
WINDOW = 6
#: What a worker remembers before it starts anew: words, and states of the automaton.
CACHE_WORDS, MAX_STATES = 100_000, 4_000
#: Counts of terms that a worker gathers before it passes them on.
MAX_COUNTS = 200_000

#: Words that report speech, and quotation marks.
REPORTING = frozenset("said says say quote quoted called call term word slur insult wrote".split())
QUOTES = frozenset("\"'“”„‟«»‹›‘’`")

_WORD = re.compile(r"[^\W_]+")


class Lexicon:
    """Terms with weights; a term that ends in ``*`` is a stem."""

    def __init__(self, weights: dict[str, float], clean: frozenset[str] = frozenset()):
        self.weights, self.clean = weights, clean
        self.child: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        for term in weights:
            node = 0
            for c in term.rstrip("*"):
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.term.append(None)
                    self.stem.append(None)
                node = self.child[node][c]
            (self.stem if term.endswith("*") else self.term)[node] = term
        self.edits = [0] * len(self.child)  # the most edits that a term below allows
        for node in range(len(self.child) - 1, -1, -1):
            below = [self.edits[k] for k in self.child[node].values()]
            own = self.allowed(self.term[node]) if self.term[node] else 0
            self.edits[node] = max([own, *below])
        self._reset()
        self.known: dict[str, tuple[str, int] | None] = {}

    def _reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.accept: list[tuple[str, int] | None] = []
        self.start = self._state(self._closed({(0, 0)}))
        self.dead = self._state(frozenset())

    def allowed(self, term: str) -> int:
        """The most edits that a misspelled form may have."""
        return 0 if term.endswith("*") or len(term) < 5 or self.weights[term] < MIN_FUZZY else 1 if len(term) < 9 else 2

    def _closed(self, states: set) -> frozenset:
        """With letters of terms skipped: (node, edits) reaches (child, edits + 1)."""
        todo = list(states)
        while todo:
            n, e = todo.pop()
            if n >= 0:
                for k in self.child[n].values():
                    if e < self.edits[k] and (k, e + 1) not in states:
                        states.add((k, e + 1))
                        todo.append((k, e + 1))
        return frozenset(states)

    def _state(self, states: frozenset) -> int:
        if states in self.states:
            return self.states[states]
        found = [(~n if n < 0 else n, e) for n, e in states]
        best = None
        for (n, e), (raw, _) in zip(found, states, strict=True):
            term = self.stem[n] if raw < 0 else self.term[n]
            if term and e <= (0 if raw < 0 else self.allowed(term)) and (best is None or (e, -self.weights[term], term) < (best[1], -self.weights[best[0]], best[0])):
                best = (term, e)
        self.states[states] = len(self.sets)
        self.sets.append(states)
        self.step.append({})
        self.accept.append(best)
        return len(self.sets) - 1

    def _next(self, state: int, c: str) -> int:
        out = set()
        for n, e in self.sets[state]:
            if n < 0:
                out.add((n, e))  # inside the rest of a stem's word
                continue
            k = self.child[n].get(c)
            if k is not None:
                out.add((k, e))
            if e < self.edits[n]:
                out.add((n, e + 1))  # a letter too many
                out.update((k, e + 1) for k in self.child[n].values() if e < self.edits[k])  # a wrong letter
        out |= {(~n, 0) for n, e in out if n >= 0 and e == 0 and self.stem[n]}
        to = self._state(self._closed(out))
        self.step[state][c] = to
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the best term that the word stands for."""
        if len(self.sets) > MAX_STATES:
            self._reset()
        state, dead = self.start, self.dead
        for c in word:
            nxt = self.step[state].get(c)
            state = self._next(state, c) if nxt is None else nxt
            if state == dead:
                return None
        found = self.accept[state]
        return None if found and found[1] and word in self.clean else found

    def hits(self, words: list[str]) -> dict[str, tuple[str, int]]:
        """The words that match, with their matches."""
        out = {}
        for w in set(words):
            if w in self.known:
                m = self.known[w]
            else:
                if len(self.known) >= CACHE_WORDS:
                    self.known.clear()
                m = self.known[w] = self.match(w)
            if m:
                out[w] = m
        return out


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def quoted(lower: str, start: int, end: int, near: list[str]) -> float:
    """How much a match reads like quotation: marks right beside it, or a word of
    reporting among the words near it."""
    marks = (lower[max(0, start - 2) : start].strip()[-1:] in QUOTES and start > 0) + (lower[end : end + 2].strip()[:1] in QUOTES and end < len(lower))
    return min(1.0, (0.5 if marks == 1 else 1.0 if marks == 2 else 0.0) + (0.5 if REPORTING.intersection(near) else 0.0))


FEATURES = 7


def features(lexicon: Lexicon, text: str | None) -> list[float] | None:
    """None without a match; else: one, the strongest exact and misspelled evidence, log
    counts of plain and of quoted matches, evidence of all different
    words, and plain matches per 200 words."""
    words = words_of(text)
    hits = lexicon.hits(words)
    if not hits:
        return None
    lower = text.lower()
    exact = fuzzy = plain = cited = 0.0
    for k, m in enumerate(_WORD.finditer(lower)):
        found = hits.get(words[k])
        if found is None:
            continue
        term, edits = found
        q = quoted(lower, m.start(), m.end(), words[max(0, k - WINDOW) : k] + words[k + 1 : k + 1 + WINDOW])
        w = lexicon.weights[term] * (1 - 0.5 * q) / (1 + 0.25 * edits)
        if edits:
            fuzzy = max(fuzzy, w)
        else:
            exact = max(exact, w)
        plain, cited = plain + 1 - q, cited + q
    every = sum(lexicon.weights[t] / (1 + edits) for t, edits in hits.values())
    return [1.0, exact, max(0.0, fuzzy - exact), math.log1p(plain), math.log1p(cited), min(30.0, every) / 5, math.log1p(200 * plain / len(words))]


def _terms(text: str) -> set[str]:
    words = set(words_of(text))
    return words | {w[:k] + "*" for w in words for k in STEM if k < len(w)}


def _counted(batches, most=None):
    """(t, s, n): how many texts with a signature have a term. What is held at a time is
    bounded, so a pair may come in several rows."""
    seen = Counter()

    def flush():
        terms, sigs = zip(*seen, strict=True)
        out = pa.RecordBatch.from_pydict({"t": terms, "s": pa.array(sigs, pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})
        seen.clear()
        return out

    for b in batches:
        for x in b.column(0).to_pylist():
            if x:
                s = _signature(x)
                seen.update((t, s) for t in _terms(x))
                if len(seen) >= (most or MAX_COUNTS):
                    yield flush()
    if seen:
        yield flush()


def _signature(text: str) -> int:
    """From the smallest hashes of a text's words: the same for most copies."""
    low = sorted({zlib.crc32(w.encode()) for w in words_of(text) if len(w) > 2})[:4]
    return zlib.crc32(repr(low).encode())


def _choose(pos: dict[str, tuple[int, int]], neg: dict[str, int], n_pos: int, n_neg: int) -> dict[str, float]:
    """Weights of the terms kept: rare in clean texts, found in texts that are no
    copies; a stem only if no longer stem or single word says as much; beside a stem, the
    whole words that are looked for in misspelled form."""

    def weight(t: str) -> float:
        """The log odds that a cautious reader would give the term."""
        a, b = pos[t][0] + 0.5, neg.get(t, 0) + 0.5
        return math.log(a / (n_pos + 1)) - math.log(b / (n_neg + 1)) - 1.5 * math.sqrt(1 / a + 1 / b)

    pure = {t for t in pos if pos[t][1] >= max(MIN_TEXTS, 0.004 * n_pos) and weight(t) >= MIN_WEIGHT}
    kept = {}
    for t in sorted(pure, key=lambda t: (len(t.rstrip("*")), t)):
        body = t.rstrip("*")
        if any(body[:k] + "*" in kept for k in STEM if k < len(body) + (not t.endswith("*"))):
            # a shorter stem stands for it, but only a whole word is found misspelled
            if not t.endswith("*") and len(t) >= 5 and weight(t) >= MIN_FUZZY:
                kept[t] = weight(t)
            continue
        if t.endswith("*"):
            longer = [x for x in pure if x != t and x.startswith(body)]
            if any(pos[x][0] >= 0.9 * pos[t][0] for x in longer):
                continue
        kept[t] = weight(t)
    return kept


def misspelled(lexicon: Lexicon, text: str | None) -> str:
    """A text in which every word that is a term lacks a letter, chosen by the word."""

    def shorter(m: re.Match) -> str:
        w = m.group()
        k = 1 + zlib.crc32(w.encode()) % max(1, len(w) - 1)
        return w[:k] + w[k + 1 :] if lexicon.weights.get(w) and lexicon.allowed(w) else w

    return _WORD.sub(shorter, (text or "").lower())


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray, base: float):
        self.lexicon, self.weights, self.base = lexicon, weights, base

    def score(self, text: str | None) -> float:
        x = features(self.lexicon, text)
        z = self.base if x is None else float(np.dot(self.weights, x))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, l2=1.0) -> np.ndarray:
    """Weights pulled towards "any match of weight 6 or more is toxic"; damped Newton
    steps, each of which must lower the penalised loss."""
    prior = np.array([-4.0, 0.8, 0.8, 0.5, -0.5, 0.5, 0.2])
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + l2 / 2 * ((w - prior) ** 2).sum()
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + l2 * (w - prior)
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step, now = np.linalg.solve(h, g), loss(w)
        while np.abs(step).max() > 1e-8 and loss(w - step) > now:
            step = step / 2
        w = w - step
        if np.abs(step).max() <= 1e-8:
            break
    return w


def fit(labelled: DataFrame, max_labelled=MAX_LABELLED) -> Model:
    """labelled(text, y 0/1). What reaches the driver is bounded by the sample."""
    total = labelled.count()
    share = min(1.0, max_labelled / total) if total else 0.0
    chosen = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000)
    sample = materialize(labelled.where(chosen & F.col("y").isNotNull()).select("text", "y"), "labelled")
    counts = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = counts.get(1, 0), counts.get(0, 0)
    rate = (n_pos + 0.5) / (n_pos + n_neg + 1)
    empty = Model(Lexicon({}), np.zeros(FEATURES), math.log(rate / (1 - rate)))
    if not n_pos or not n_neg:
        return empty

    found = (
        sample.where("y = 1").select("text").mapInArrow(trimmed(_counted), "t string, s long, n long")
        .groupBy("t", "s").agg(F.sum("n").alias("n"))
        .groupBy("t").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
        .where((F.col("n") >= MIN_DOCS) & (F.col("texts") >= MIN_TEXTS))
    )
    pos = {r["t"]: (r["n"], r["texts"]) for r in found.collect()}
    asked = frozenset(pos)

    def clean_terms(batches):
        seen = Counter()
        for b in batches:
            for x in b.column(0).to_pylist():
                if x:
                    seen.update(asked.intersection(_terms(x)))
        if seen:
            yield pa.RecordBatch.from_pydict({"t": list(seen), "n": pa.array(list(seen.values()), pa.int64())})

    clean = sample.where("y = 0").select("text")
    neg = {r["t"]: r["n"] for r in clean.mapInArrow(trimmed(clean_terms), "t string, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}
    lexicon = Lexicon(_choose(pos, neg, n_pos, n_neg))

    def near_words(batches):
        seen = Counter()
        for b in batches:
            for x in b.column(0).to_pylist():
                seen.update(w for w, (_, edits) in lexicon.hits(words_of(x)).items() if edits)
        if seen:
            yield pa.RecordBatch.from_pydict({"t": list(seen), "n": pa.array(list(seen.values()), pa.int64())})

    near = clean.mapInArrow(trimmed(near_words), "t string, n long").groupBy("t").agg(F.sum("n").alias("n")).where("n >= 2").collect()
    lexicon = Lexicon(lexicon.weights, frozenset(r["t"] for r in near))

    def vectors(batches):
        for b in batches:
            given = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            # toxic texts once more as they would read misspelled, of which samples have few
            got = [(features(lexicon, x), y, True) for x, y in given] + [(features(lexicon, misspelled(lexicon, x)), 1, False) for x, y in given if y == 1]
            got = [g for g in got if g[0] is not None]
            if got:
                x, y, own = zip(*got, strict=True)
                yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.list_(pa.float64())), "y": pa.array(y, pa.int32()), "own": pa.array(own)})

    rows = sample.select("text", "y").mapInArrow(trimmed(vectors), "x array<double>, y int, own boolean").collect()
    x = np.array([r["x"] for r in rows], float).reshape(-1, FEATURES)
    y = np.array([r["y"] for r in rows], float)
    own = np.array([r["own"] for r in rows], bool)
    missed = n_pos - int(y[own].sum())
    rest = (missed + 0.5) / (n_pos + n_neg - int(own.sum()) + 1)
    return Model(lexicon, _logistic(x, y), math.log(rest / (1 - rest)))


def training_rows(docs: DataFrame, labels: DataFrame, held_out: Column, id_col="doc_id", text="text", label="toxic") -> DataFrame:
    """(text, y) of labelled rows that are not held out; an id labelled twice counts as
    toxic if one label says so."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("lid")).agg(F.max(F.col(label).cast("int")).alias("y"))
    rows = docs.where(~held_out).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.join(known, F.col("id") == F.col("lid")).select("text", "y")


def with_scores(docs: DataFrame, model: Model, text="text", score="score") -> DataFrame:
    """docs with a score column added (0 to 1, higher: likelier toxic)."""
    w, base, weights, clean = model.weights, model.base, model.lexicon.weights, model.lexicon.clean
    at = docs.columns.index(text)

    def run(batches):
        m = Model(Lexicon(weights, clean), w, base)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m.score(t.as_py()) for t in b.column(at)], pa.float64())], [*b.schema.names, score])

    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField(score, DoubleType())])
    return docs.mapInArrow(trimmed(run), schema)


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, id_col="doc_id", text="text") -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    model = fit(training_rows(docs, labels, held_out, id_col, text))
    rows = docs.select(F.col(id_col), held_out.alias("held_out"), F.col(text).alias("_wm_text"))
    scored = with_scores(rows, model, "_wm_text")
    return scored.select(id_col, "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, id_col="doc_id", text="text") -> DataFrame:
    """docs without those judged toxic; all labels are learned from."""
    model = fit(training_rows(docs, labels, F.lit(False), id_col, text))
    return with_scores(docs, model, text, "_wm_score").where(F.col("_wm_score") < THRESHOLD).drop("_wm_score")
