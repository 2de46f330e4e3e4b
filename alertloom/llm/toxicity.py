"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers read a clause word by word: insults, threats at targets, aim (a target shortly before), negation
and reported speech. Their composition is one deterministic machine whose state holds how long ago a target, a negation
or a threat was read and whether the clause reports speech. Its arcs say whether they complete an insult or a threat and
which of aim, negation and report scale its weight. Matched clauses are scored, not words alone: "not an idiot" and "they
said: idiot" weigh less than "you idiot". A learned stem that is also a threat word has its learned weight by itself and
the rest of a threat's where a target follows.

Insult stems and weights are learned from labelled rows: word beginnings (and whole words) that are frequent in
toxic texts and rare in others, chosen greedily by how many unexplained toxic texts they explain; a logistic fit on the
stems' counts gives their weights and the intercept, so stems that clean texts hold now and then need company. The
factors of aim, negation and report are then fitted on the matched clauses, from their declared values, which weigh as
PRIOR_MATCHES matches do. A short seed list stands in where labels are few. At most `sample_rows` labelled rows, those of
the smallest hash, are used, with all their stems.

Of one stem or threat word a text's MOST_REPEATS heaviest matches count, in learning as in scoring, so the length of a
text or its repetition makes nothing toxic by itself.

Null and empty texts get the score of a text without matches. Repeated rows get equal scores; an empty table gives an
empty result; other columns are handed on, whatever their names, but for the score's own. Texts are read whole; only
clauses that hold a learned or seed word are walked, each once, so the time is linear in the text.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, small_batches

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SEED_INSULTS = "idiot idiots moron morons scum loser losers stupid pathetic worthless disgusting trash clown imbecile dumbass".split()
SEED_THREATS = "kill hurt destroy strangle stab shoot beat murder".split()
TARGETS = "you your yourself u ur they them he she him her tu toi vous du dich ihr euch usted vosotros".split()
NEGATIONS = "not no never nobody nor isn aren wasn don doesn didn pas jamais nicht kein keine nie nunca jamas".split()
REPORTS = "said says quoted wrote writes claimed called reported cites cited dit sagte dijo".split()
#: Log-odds of a text that holds one seed insult, or one threat at a target.
SEED_ODDS = 1.5
MOST_REPEATS = 3
#: What an arc may say, as bits: an insult or a threat is complete; aim, negation and report scale it.
INSULTED, THREATENED, AIMED, NEGATED, REPORTED = 1, 2, 4, 8, 16
FACTORS = {AIMED: 1.3, NEGATED: 0.4, REPORTED: 0.5}
PRIOR_MATCHES = 20

_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE_END = re.compile(r"[.!?;\n]")
_PREFIXES = (4, 5, 6, 7, 8)


# --- the grammar -----------------------------------------------------------------------------------------------
class Transducer:
    """step(state, symbol) -> (state, bits that the arc says)."""

    start = 0

    def step(self, state, symbol):
        raise NotImplementedError


class Insult(Transducer):
    """Every insult is complete by itself."""

    def step(self, state, symbol):
        return 0, INSULTED if symbol == INSULT else 0


class Aimed(Transducer):
    """A threat is complete where a target follows within `span` words; its weight is pending until then."""

    def __init__(self, span: int):
        self.span = span

    def step(self, state, symbol):
        if symbol == THREAT:
            return self.span, 0
        if symbol == TARGET and state:
            return 0, THREATENED
        return max(0, state - 1), 0


class Recent(Transducer):
    """Says `bit` on `scaled` symbols for `span` words after `symbol`."""

    def __init__(self, symbol: int, span: int, bit: int, scaled: tuple[int, ...] = (INSULT, THREAT)):
        self.symbol, self.span, self.bit, self.scaled = symbol, span, bit, scaled

    def step(self, state, symbol):
        return (self.span if symbol == self.symbol else max(0, state - 1)), self.bit if state and symbol in self.scaled else 0


class Throughout(Transducer):
    """Says `bit` in the rest of the clause after `symbol`."""

    def __init__(self, symbol: int, bit: int):
        self.symbol, self.bit = symbol, bit

    def step(self, state, symbol):
        return int(state or symbol == self.symbol), self.bit if state and symbol in (INSULT, THREAT) else 0


def compose(parts: list[Transducer]) -> tuple[list[list[tuple[int, int]]], int]:
    """The reachable product machine as rows of (next state, bits) by symbol."""
    first = tuple(p.start for p in parts)
    known, todo, rows = {first: 0}, [first], []
    while todo:
        state = todo.pop(0)
        row = []
        for symbol in range(6):
            steps = [p.step(s, symbol) for p, s in zip(parts, state, strict=True)]
            key = tuple(t for t, _ in steps)
            if key not in known:
                known[key] = len(known)
                todo.append(key)
            row.append((known[key], reduce(or_, (bits for _, bits in steps))))
        rows.append(row)
    return rows, 0


GRAMMAR, START = compose([Insult(), Aimed(4), Recent(TARGET, 4, AIMED, (INSULT,)), Recent(NEGATION, 2, NEGATED), Throughout(REPORT, REPORTED)])
_FIXED = {w: TARGET for w in TARGETS} | {w: NEGATION for w in NEGATIONS} | {w: REPORT for w in REPORTS}


@dataclass
class Lexicon:
    """stems: word beginnings ("^abc") or whole words ("^abc$") with weights; base: score of a text without matches."""

    stems: dict[str, float]
    base: float = 0.02
    factors: dict[int, float] = field(default_factory=lambda: dict(FACTORS))
    _auto: object = field(default=None, repr=False)

    def automaton(self):
        if self._auto is None:
            a = ahocorasick.Automaton()
            for s in {x.strip("^$") for x in self.stems} | set(SEED_INSULTS) | set(SEED_THREATS):
                a.add_word(s, s)
            a.make_automaton()
            self._auto = a
        return self._auto

    def __getstate__(self):
        return self.__dict__ | {"_auto": None}

    def __post_init__(self):
        self.intercept = math.log(self.base / (1 - self.base))

    def weigh(self, word: str) -> tuple[int, str, float]:
        """(symbol, name, weight); a threat's weight is that of the threat."""
        stem = self.stem(word)
        if word in _THREAT_SET:
            return THREAT, stem or word, max(SEED_ODDS - self.intercept, self.stems.get(stem, 0.0))
        if stem:
            return INSULT, stem, self.stems[stem]
        if word in _FIXED:
            return _FIXED[word], word, 0.0
        return (INSULT, word, SEED_ODDS - self.intercept) if word in _SEED_SET else (OTHER, word, 0.0)

    def stem(self, word: str) -> str | None:
        """The heaviest, then longest, stem of a word."""
        keys = [f"^{word}$", *(f"^{word[:n]}" for n in reversed(_PREFIXES) if n <= len(word))]
        return max((k for k in keys if k in self.stems), key=self.stems.__getitem__, default=None)

    def matches(self, words: list[str]) -> Iterator[tuple[str, float, int]]:
        """(name, weight, scaling bits) of the insults and threats that a clause completes."""
        state, pending = START, ("", 0.0, 0)
        for w in words:
            symbol, name, weight = self.weigh(w)
            state, bits = GRAMMAR[state][symbol]
            scaled = bits & ~(INSULTED | THREATENED)
            if bits & INSULTED:
                yield name, weight, scaled
            if symbol == THREAT:
                own = self.stems.get(name, 0.0)
                pending = name, weight - own, scaled
                if own:
                    yield name, own, scaled
            elif bits & THREATENED and pending[1] > 0:
                yield f"{pending[0]} at", pending[1], pending[2]

    def scale(self, bits: int) -> float:
        return math.prod(f for bit, f in self.factors.items() if bits & bit)

    def clause(self, words: list[str]) -> float:
        return sum(weight * self.scale(bits) for _, weight, bits in self.matches(words))

    def clauses(self, text: str | None) -> Iterator[list[tuple[str, float, int]]]:
        """Matches of each clause that has any."""
        low, done = (text or "").lower(), 0
        for last, stem in self.automaton().iter(low) if low else ():
            at = last - len(stem) + 1
            if at < done or at and low[at - 1].isalpha():
                continue
            a = max(low.rfind(c, done, at) for c in ".!?;\n") + 1
            end = _CLAUSE_END.search(low, last + 1)
            b = end.start() if end else len(low)
            found = list(self.matches(_WORD.findall(low, max(a, done), b)))
            done = b
            if found:
                yield found

    def score(self, text: str | None) -> tuple[float, int]:
        """(score, matched clauses)."""
        best: dict[str, list[float]] = {}
        matched = 0
        for found in self.clauses(text):
            matched += 1
            for name, weight, bits in found:
                heap = best.setdefault(name, [])
                heapq.heappush(heap, weight * self.scale(bits))
                if len(heap) > MOST_REPEATS:
                    heapq.heappop(heap)
        raw = sum(map(sum, best.values()))
        return 1 / (1 + math.exp(-min(30.0, self.intercept + raw))), matched


_SEED_SET, _THREAT_SET = set(SEED_INSULTS), set(SEED_THREATS)


# --- learning --------------------------------------------------------------------------------------------------
def stems_of(text: str | None) -> set[str]:
    out = set()
    for w in set(_WORD.findall((text or "").lower())):
        if len(w) >= 4:
            out.add(f"^{w}$")
            out.update(f"^{w[:n]}" for n in _PREFIXES if n <= len(w))
    return out


def _count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        by = (Counter(), Counter())
        for t, y in zip(b.column(0), b.column(1), strict=True):
            by[y.as_py()].update(stems_of(t.as_py()))
        stems = sorted(by[0].keys() | by[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array([by[1][s] for s in stems], pa.int64()), pa.array([by[0][s] for s in stems], pa.int64())], names=["stem", "pos", "neg"])


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 15_000, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """Fit the lexicon on labels(doc_id, toxic) of `docs`; at most `sample_rows` labelled rows."""
    spark = docs.sparkSession
    small_batches(spark)
    ids = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)")
    ids = ids.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    sample = texts.join(F.broadcast(ids), "id").select("text", "toxic")  # ids: at most sample_rows rows
    sample = Scratch(spark, "toxicity").save(sample)
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_pos, n_neg = totals.get(1, 0), totals.get(0, 0)
    if not n_pos or not n_neg:
        return Lexicon({}, (n_pos + 0.5) / (n_pos + n_neg + 25))
    least = max(3, round(0.004 * n_pos))
    counts = sample.mapInArrow(_count_stems, "stem string, pos long, neg long").groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log(((F.col("pos") + 0.5) / (n_pos + 1)) / ((F.col("neg") + 0.5) / (n_neg + 1)))
    good = counts.withColumn("odds", odds).filter((F.col("pos") >= least) & (F.col("odds") > 2.5) & (4 * F.col("neg") <= F.col("pos")))
    rows = good.collect()  # each stands for `least` of the sample's toxic rows or more
    weight = {r["stem"]: r["odds"] for r in rows}

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(stems_of(t.as_py()) & weight.keys()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], names=["stems"])

    toxic = [set(r["stems"]) for r in sample.filter("toxic = 1").select("text").distinct().mapInArrow(hits, "stems array<string>").collect()]
    chosen: list[str] = []
    while toxic:
        gain = Counter(s for x in toxic for s in x)
        if not gain:
            break
        best = max(gain, key=lambda s: (gain[s] * min(weight[s], 5.0), len(s), s))
        if gain[best] < max(2, least // 2):
            break
        chosen.append(best)
        toxic = [x for x in toxic if best not in x]
    if not chosen:
        return Lexicon({}, (n_pos + 0.5) / (n_pos + n_neg + 25))

    first = Lexicon(dict.fromkeys(chosen, 1.0))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [Counter((name, bits) for c in first.clauses(t.as_py()) for name, _, bits in c if name in first.stems) for t in b.column(0)]
            parts = [[[name for name, _ in x] for x in found], [[bits for _, bits in x] for x in found], [list(x.values()) for x in found]]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(parts[0], pa.list_(pa.string())), pa.array(parts[1], pa.list_(pa.int64())), pa.array(parts[2], pa.list_(pa.int64()))], names=["toxic", "stems", "bits", "counts"])

    seen = sample.mapInArrow(tally, "toxic int, stems array<string>, bits array<long>, counts array<long>").collect()  # at most sample_rows texts' hits
    y = np.array([r["toxic"] for r in seen], float)
    hits = [list(zip(r["stems"], r["bits"], r["counts"], strict=True)) for r in seen]
    at = {s: i for i, s in enumerate(chosen)}
    weights, intercept = logistic(_design(hits, at, {}), y)
    factors = fit_factors(hits, y, at, weights, intercept)
    weights, intercept = logistic(_design(hits, at, factors), y)
    stems = {s: float(w) for s, w in zip(chosen, weights, strict=True) if w > 0}
    return Lexicon(stems, float(np.clip(1 / (1 + math.exp(-intercept)), 0.001, 0.3)), factors)


def _design(hits: list[list[tuple[str, int, int]]], at: dict[str, int], factors: dict[int, float]) -> np.ndarray:
    """For each text and stem, the sum of the factors of its MOST_REPEATS heaviest matches."""
    x = np.zeros((len(hits), len(at)))
    for i, found in enumerate(hits):
        left = dict.fromkeys((s for s, *_ in found), MOST_REPEATS)
        scaled = sorted(((math.prod(f for bit, f in factors.items() if bits & bit), s, n) for s, bits, n in found), reverse=True)
        for f, s, n in scaled:
            x[i, at[s]] += f * min(n, left[s])
            left[s] -= min(n, left[s])
    return x


def fit_factors(hits: list, y: np.ndarray, at: dict[str, int], weights: np.ndarray, intercept: float) -> dict[int, float]:
    """Each factor by a search over its logarithm, the likelihood of the texts it touches plus a prior at FACTORS."""
    factors = dict(FACTORS)
    touched = {bit: [i for i, found in enumerate(hits) if any(bits & bit for _, bits, _ in found)] for bit in FACTORS}
    for bit, rows in touched.items():
        if rows:
            some, labels = [hits[i] for i in rows], y[rows]

            def loss(log: float, some=some, labels=labels, bit=bit) -> float:
                z = np.clip(intercept + _design(some, at, factors | {bit: math.exp(log)}) @ weights, -30, 30)
                return float(np.logaddexp(0, z).sum() - labels @ z + PRIOR_MATCHES / 2 * (log - math.log(FACTORS[bit])) ** 2)

            grid = math.log(FACTORS[bit]) + np.linspace(-1.2, 1.2, 13)
            factors[bit] = math.exp(min(grid.tolist(), key=loss))
    return factors


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.03, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights (none below 0) and intercept of a ridge-penalised logistic fit, by Newton steps."""
    z = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (y - p) - penalty * w
        curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(curve, grad)
        w = w + np.clip(step, -2, 2)
        w[:-1] = np.maximum(w[:-1], 0)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


# --- scoring ---------------------------------------------------------------------------------------------------
def score_rows(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", score_col: str = "toxicity", matched_col: str | None = None) -> DataFrame:
    """The same rows with `score_col` (0 to 1) and, if named, the number of matched clauses."""
    small_batches(docs.sparkSession)
    cols = docs.columns
    if {score_col, matched_col} & set(cols):
        raise ValueError(f"{score_col} and {matched_col} must be new columns")
    at = cols.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [lexicon.score(t.as_py()) for t in b.column(at)]
            extra = [pa.array([x[0] for x in got], pa.float64())] + ([pa.array([x[1] for x in got], pa.int64())] if matched_col else [])
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, score_col, *([matched_col] if matched_col else [])])

    extra = [T.StructField(score_col, T.DoubleType())] + ([T.StructField(matched_col, T.LongType())] if matched_col else [])
    return docs.mapInArrow(rows, T.StructType([*docs.schema.fields, *extra]))
