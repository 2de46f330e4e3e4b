"""Quality rules as weak supervision.

Each rule votes good, bad or abstains on a document. The counts of the vote patterns over all documents (at most
3**rules rows) are all that expectation-maximisation needs: it estimates how often each rule's votes are right,
and the posterior of a pattern replaces an all-must-pass filter.

Null and blank texts have no words and fail the base rule. Ties and repeated rows count as rows of their own; an
empty table gives an empty result; other columns are never read, whatever their names. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytekernel as bk
from .common import Scratch, small_batches

SYMBOLS = b"#*$%&|<>"
#: (name, votes bad at or above, votes good at or below, prior accuracy); between, or where a bound is None, it abstains.
RULES = (
    ("symbols", 0.10, None, 0.97),
    ("repeats", 0.30, None, 0.90),
    ("dup_lines", 0.30, None, 0.90),
    ("long_words", 12.0, None, 0.90),
    ("capitals", 0.30, None, 0.90),
    ("exclaims", 0.10, None, 0.90),
    ("wordless", 0.20, None, 0.90),
    ("unlettered", 0.25, 0.10, 0.90),
)
GOOD, BAD, ABSTAIN = 0, 1, 2
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_ascii", "n_exclaims", "n_letters", "n_wordless")


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur at least twice."""
    order = np.argsort(keys)
    k = keys[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    out = np.zeros(len(k), bool)
    out[order] = same[1:] | same[:-1]
    return out


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """An int64 row of FEATURES for each text."""
    n = len(off) - 1
    out = np.zeros((n, len(FEATURES)), np.int64)
    if not len(data):
        return out
    starts, ends, rows = bk.words(data, off)
    hasher = bk.Hasher(data)
    out[:, 0] = np.bincount(rows, minlength=n)
    solid = ~bk.IS_SPACE[data]
    out[:, 1] = _sums(solid & ((data & 0xC0) != 0x80), off)
    out[:, 2] = _sums(_IS_SYMBOL[data], off)
    lower, upper = (data >= 97) & (data <= 122), (data >= 65) & (data <= 90)
    out[:, 6], out[:, 7], out[:, 8] = _sums(upper, off), _sums(upper | lower, off), _sums(data == 33, off)
    letter = upper | lower | (data >= 0xC0)
    out[:, 9] = _sums(letter, off)
    c = np.zeros(len(data) + 1, np.int64)
    np.cumsum(letter, out=c[1:])
    out[:, 10] = np.bincount(rows[c[ends] == c[starts]], minlength=n)

    breaks = np.flatnonzero(data == 10)
    row_of = np.searchsorted(off, breaks, "right") - 1
    full = np.flatnonzero(np.diff(off) > 0)
    begin = np.concatenate([off[full], breaks + 1])
    owner = np.concatenate([full, row_of])
    order = np.lexsort((begin, owner))
    begin, owner = begin[order], owner[order]
    end = np.empty_like(begin)
    end[:-1] = np.where(owner[1:] == owner[:-1], begin[1:] - 1, off[owner[:-1] + 1])
    end[-1:] = off[owner[-1:] + 1]
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(solid, out=filled[1:])
    some = filled[end] > filled[begin]
    begin, end, owner = begin[some], end[some], owner[some]
    out[:, 5] = np.bincount(owner, minlength=n)
    keys = bk.mix(hasher(begin, end) + owner.astype(np.uint64) * bk.MULTIPLIERS[6])
    _, first = np.unique(keys, return_index=True)
    out[:, 3] = out[:, 5] - np.bincount(owner[first], minlength=n)

    if len(rows) >= 3:
        h = hasher(starts, ends)
        w = bk.mix(h[:-2] * bk.MULTIPLIERS[0] + h[1:-1] * bk.MULTIPLIERS[1] + h[2:] * bk.MULTIPLIERS[2] + rows[2:].astype(np.uint64) * bk.MULTIPLIERS[6])
        inside = rows[2:] == rows[:-2]
        at = np.flatnonzero(inside)
        at = at[_repeated(w[at])]
        mark = np.zeros(len(rows), bool)
        for k in range(3):
            mark[at + k] = True
        out[:, 4] = np.bincount(rows[mark], minlength=n)
    return out


def votes(f: np.ndarray) -> np.ndarray:
    """A code per text: its rules' votes as digits base 3, the first rule lowest."""
    words, lines, ascii_ = np.maximum(f[:, 0], 1), np.maximum(f[:, 5], 1), np.maximum(f[:, 7], 1)
    chars = np.maximum(f[:, 1], 1)
    values = (f[:, 2] / words, f[:, 4] / words, f[:, 3] / lines, f[:, 1] / words, f[:, 6] / ascii_, f[:, 8] / words, f[:, 10] / words, 1 - f[:, 9] / chars)
    code = np.zeros(len(f), np.int64)
    for k, ((_, bad, good, _), v) in enumerate(zip(RULES, values, strict=True)):
        vote = np.full(len(f), ABSTAIN)
        if good is not None:
            vote[v <= good] = GOOD
        if bad is not None:
            vote[v >= bad] = BAD
        code += np.where(f[:, 0] > 0, vote, ABSTAIN) * 3**k
    return code


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = [features(data, off) for _, _, data, off in bk.steps(b.column(1))]
        f = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)), np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(f[:, k]) for k in range(5)), pa.array(votes(f))], names=["doc_id", *FEATURES[:5], "votes"])


def fit_votes(counts: dict[int, int], rounds: int = 500, prior_weight: float = 1.0) -> dict[int, float]:
    """Posterior chance of good quality for each vote pattern, from the patterns' counts.

    Model: a vote is right with its rule's accuracy, abstaining says nothing. Priors (a share of 0.85 is good, a rule is
    right as RULES says) weigh `prior_weight` times the rows or votes they are about: with rules that seldom meet on a
    document, the data alone would settle on "all is good and every such rule is wrong".
    """
    codes = sorted(counts)
    total = sum(counts.values())
    if not total:
        return {}
    n = np.array([counts[c] for c in codes], float)
    v = np.array([[c // 3**k % 3 for k in range(len(RULES))] for c in codes])
    sign = np.where(v == GOOD, 1.0, np.where(v == BAD, -1.0, 0.0))
    cast = (n[:, None] * (sign != 0)).sum(0)
    before = np.array([r[3] for r in RULES])
    share, right = 0.85, before
    post = np.zeros(len(codes))
    for _ in range(rounds):
        score = np.log(share / (1 - share)) + sign @ np.log(right / (1 - right))
        new = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        done = np.abs(new - post).max() < 1e-10
        post = new
        if done:
            break
        share = (n @ post + prior_weight * total * 0.85) / (total * (1 + prior_weight))
        agree = (n[:, None] * np.where(sign > 0, post[:, None], np.where(sign < 0, 1 - post[:, None], 0))).sum(0)
        right = np.clip((agree + (prior_weight * cast + 1) * before) / (cast * (1 + prior_weight) + 1), 0.5, 0.995)
    return dict(zip(codes, post.tolist(), strict=True))


def quality(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality_probability, kept)."""
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = ", ".join(f"{c} long" for c in ("doc_id", *FEATURES[:5], "votes"))
    measured = Scratch(spark, "quality").save(src.mapInArrow(_measure, fields))
    counts = {r["votes"]: r["count"] for r in measured.groupBy("votes").count().collect()}  # at most 3**rules rows
    chance = fit_votes(counts)
    known = F.create_map(*[F.lit(x) for k, p in chance.items() for x in (k, p)]) if chance else F.create_map().cast("map<long,double>")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = measured.withColumn("base_failed", failed).withColumn("quality_probability", known[F.col("votes")])
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= threshold)).drop("votes")
