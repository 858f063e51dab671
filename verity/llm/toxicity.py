"""Toxicity by a weighted finite-state pattern grammar.

Words are read into symbols (insult, threat, target, negation, reporting mark,
other) and run through composed transducers, clause by clause:

- negation: an insult or threat up to three words after a negation is denied;
- reporting: after a reporting verb or an opening quotation mark it is reported;
- target, read forwards and backwards: a person within four words is its target.

Each match leaves its clause as a pattern (denied, reported, targeted or plain;
insult or threat) with the weight of its lexical arc. A document is scored from
the sums of pattern weights, their density, its strongest clause and the number
of matched clauses, by logistic regression; never from isolated words.

Learned from labels (training rows alone): the insult arcs, as word beginnings
whose rows are more often labelled toxic, with log odds as weights, and the
regression. Both use at most ``TRAINING_ROWS`` labelled identifiers, taken in the
order of a hash; the lexicon has ``STEMS`` arcs at most, the size of the model.
Every document is scored whole.

Long texts are read clause by clause, whole; of rows that repeat a labelled
identifier the regression takes one, that of the smallest hash of its text, so ties
do not depend on the order of rows.

Defined results: null and empty texts get the score of a text without matches;
without usable labels the score is 0.5 everywhere; null identifiers are never
held out; repeated rows score alike; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verity.llm.shared import few_rows

TRAINING_ROWS = 30_000
STEMS = 96
STEM_LENGTHS = range(4, 10)
MIN_GAIN = 24.0
THRESHOLD = 0.7
TARGET_SPAN, NEGATION_SPAN = 4, 3

THREATS = frozenset("kill hurt destroy burn beat attack stab shoot murder strangle hunt die töten schlagen verbrennen tuer frapper brûler matar golpear quemar".split())
TARGETS = frozenset("you your yours yourself u he him she her they them their people du dich dir ihr euch sie tu toi te vous ton votre eux tú ti usted ustedes él ella ellos".split())
NEGATIONS = frozenset("not no never none nobody neither nor without isn't aren't wasn't don't doesn't didn't won't can't nicht kein keine nie niemals ne pas jamais aucun nunca ningún sin".split())
REPORTS = frozenset("said says say called calls wrote writes claimed claims reported alleged quoted quote accused sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió".split())
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“«„]")
_CLAUSE_END = re.compile(r"[.!?;\n]")
_WORD = re.compile(r"[^\W\d_]{4,}")
_LETTERS = re.compile(r"[^\W\d_]+")
PATTERNS = tuple((kind, mood) for kind in "IH" for mood in ("plain", "targeted", "denied", "reported"))

Symbol = tuple[str, frozenset]


def _mark(symbol: Symbol, mood: str) -> Symbol:
    return symbol[0], symbol[1] | {mood}


class Transducer:
    """Marks insults and threats with ``mood`` while its state is up. ``starts``
    raises the state to ``span``; any other symbol lowers it by one, or leaves it
    where ``span`` is None (up to the end of the clause)."""

    def __init__(self, starts: str, mood: str, span: int | None) -> None:
        self.starts, self.mood, self.span = starts, mood, span

    def step(self, state: int, gap: int, symbol: Symbol) -> tuple[Symbol, int]:
        """Reads ``gap`` words that are no symbol of the grammar, then ``symbol``."""
        if symbol[0] == self.starts:
            return symbol, self.span or 1
        state = state if self.span is None else max(state - gap, 0)
        return (_mark(symbol, self.mood) if state and symbol[0] in "IH" else symbol), state if self.span is None else max(state - 1, 0)


NEGATION, REPORTING = Transducer("N", "denied", NEGATION_SPAN), Transducer("R", "reported", None)
TARGETING = Transducer("T", "targeted", TARGET_SPAN)


def composed(*parts: Transducer) -> Callable[[list[tuple[int, Symbol]]], list[Symbol]]:
    """The output of each part is the input of the next, symbol by symbol; each
    symbol comes with the number of other words before it."""
    def run(symbols: list[tuple[int, Symbol]]) -> list[Symbol]:
        states, out = [0] * len(parts), []
        for gap, symbol in symbols:
            for i, part in enumerate(parts):
                symbol, states[i] = part.step(states[i], gap, symbol)
            out.append(symbol)
        return out
    return run


_FORWARD, _BACKWARD = composed(NEGATION, REPORTING, TARGETING), composed(TARGETING)


class Grammar:
    """The lexical arcs, and the search for clauses that can hold a match."""

    def __init__(self, arcs: dict[str, float]) -> None:
        self.arcs = arcs
        self.lengths = sorted({len(a) for a in arcs}, reverse=True)
        self.shortest = min(self.lengths, default=0)
        self.heads = {a[: self.shortest] for a in arcs}
        kinds = (("R", REPORTS | set("\"“«„")), ("T", TARGETS), ("N", NEGATIONS), ("H", THREATS))  # the last one counts
        self.kinds = {w: kind for kind, words in kinds for w in words}

    def stem(self, word: str) -> str | None:
        """The arc that the word begins with; no arc is the beginning of another."""
        if word[: self.shortest] not in self.heads:
            return None
        return next((word[:k] for k in self.lengths if word[:k] in self.arcs), None)

    def matches(self, clause: str) -> list[tuple[str, str, float]]:
        """(kind, mood, weight) of each insult or threat in the clause."""
        at, weights, read = [], [], []
        words = _TOKEN.findall(clause)
        for i, word in enumerate(words):
            found = self.stem(word)
            kind = "I" if found else self.kinds.get(word)
            if kind:
                at.append(i)
                weights.append(self.arcs[found] if found else 1.0)
                read.append((kind, frozenset()))
        gaps = [b - a - 1 for a, b in zip([-1, *at], at)]
        forward = _FORWARD(list(zip(gaps, read)))[::-1]
        marked = _BACKWARD(list(zip([0, *gaps[:0:-1]], forward)))[::-1]
        out = []
        for weight, (kind, moods) in zip(weights, marked):
            if kind in "IH":
                out.append((kind, next((m for m in ("denied", "reported", "targeted") if m in moods), "plain"), weight))
        return out

    def features(self, text: str) -> list[float]:
        """Sums of weights by pattern, their density, the strongest clause and the number of matched clauses."""
        low, sums, strongest, clauses = text.lower(), dict.fromkeys(PATTERNS, 0.0), 0.0, 0
        # Each different word is looked up once; clauses are read only in texts that hold a match.
        hits = {w for w in set(_LETTERS.findall(low)) if w in THREATS or self.stem(w)}
        for clause in _CLAUSE_END.split(low) if hits else ():
            if hits.isdisjoint(_LETTERS.findall(clause)):
                continue
            found = self.matches(clause)
            for kind, mood, weight in found:
                sums[kind, mood] += weight
            clauses += bool(found)
            strongest = max(strongest, sum(w for *_, w in found))
        total = sum(sums.values())
        return [*(math.log1p(s) for s in sums.values()), 30 * total / math.sqrt(len(text) + 100), strongest, math.log1p(clauses)]


def _signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other texts hold each word beginning; the null one counts texts."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in few_rows(batches):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = set(_WORD.findall((text or "").lower()))
            counts[toxic].update({w[:k] for w in words for k in STEM_LENGTHS if len(w) >= k})
            counts[toxic][""] += 1
    for toxic, found in enumerate(counts):
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array([0 if toxic else n for n in found.values()], pa.int64()),
                                              pa.array([n if toxic else 0 for n in found.values()], pa.int64())], names=["stem", "clean", "toxic"])


def _entropy(p: Column) -> Column:
    safe = lambda x: F.when((x > 0) & (x < 1), -x * F.log(x) - (1 - x) * F.log(1 - x)).otherwise(0.0)
    return safe(p)


def learn_arcs(rows: DataFrame, stems: int = STEMS) -> dict[str, float]:
    """Word beginnings that speak for toxicity, with log odds: of those with
    enough information on the label, the ``stems`` that give most evidence in all
    (toxic texts times log odds), none of them the beginning of another."""
    counts = rows.mapInArrow(_signs, "stem string, clean long, toxic long").groupBy("stem").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    whole = counts.where("stem = ''").first()
    if not whole or not whole["c"] or not whole["t"]:
        return {}
    clean, toxic = whole["c"], whole["t"]
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    n = clean + toxic
    held, rest = F.col("c") + F.col("t"), n - F.col("c") - F.col("t")
    gain = 2 * (n * _entropy(F.lit(toxic / n)) - held * _entropy(F.col("t") / held) - rest * _entropy((toxic - F.col("t")) / F.greatest(rest, F.lit(1))))
    best = counts.where("stem <> ''").select("stem", odds.alias("odds"), gain.alias("gain"), (F.col("t") * odds).alias("evidence")).where(
        (F.col("odds") > 1) & (F.col("gain") >= MIN_GAIN))
    arcs: dict[str, float] = {}
    for r in best.orderBy(F.desc("evidence"), F.desc(F.length("stem")), "stem").toLocalIterator():  # read as far as needed
        if not any(r["stem"].startswith(a) or a.startswith(r["stem"]) for a in arcs):
            arcs[r["stem"]] = r["odds"]
        if len(arcs) >= stems:
            break
    return arcs


def _with_features(grammar: Grammar, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            found = [grammar.features(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.list_(pa.float64()))], names=[*names, "found"])
    return run


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
             training_rows: int = TRAINING_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score``, ``predicted``."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    read = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    marked = labels.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("toxic")).dropna()
    marked = marked.where(fold != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(training_rows)  # so many rows at most: it may be broadcast
    training = read.join(F.broadcast(sample), "doc_id").select("doc_id", F.xxhash64("text").alias("mark"), "text", "toxic")
    grammar = Grammar(learn_arcs(training))
    read_out = training.mapInArrow(_with_features(grammar, ["doc_id", "mark", "toxic"]), "doc_id long, mark long, toxic int, found array<double>")
    seen = read_out.groupBy("doc_id").agg(F.min(F.struct("mark", "found", "toxic")).alias("row")).select("row.found", "row.toxic").toArrow()  # a row an identifier of the sample
    x, y = np.array(seen.column("found").to_pylist(), float), seen.column("toxic").to_numpy()
    weights = fit(x, y) if len(set(y.tolist())) == 2 else np.zeros(len(grammar.features("")) + 1)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _with_features(grammar, ["doc_id"])(batches):
            x = np.array(batch.column("found").to_pylist(), float).reshape(len(batch), len(weights) - 1)
            odds = np.clip(x @ weights[:-1] + weights[-1], -30, 30)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-odds)))], names=["doc_id", "score"])

    out = read.mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
