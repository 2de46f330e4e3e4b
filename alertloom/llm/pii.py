"""Personal data by candidate gradient boosting, in DataFrame expressions only.

High-recall generators propose spans that may overlap: the four strict formats (e-mail, IPv4, payment card, phone
with a plus) and loose ones (other digit groups, account numbers, spelled-out addresses). Strict spans whose checks
hold (part range, Luhn, digit count) are certain. Every loose candidate is described by format features and by the text on both sides of it,
and scored by boosted trees, compiled to CASE expressions. Each loose kind has its own threshold: the lowest cut between held-out scores at
which the kind reaches PRECISION; a kind that never does is not reported. Candidates that overlap a certain span are left
out, and of loose ones that overlap each other the best-scored stays, the earlier on a tie.

The trees are fitted on the driver in about two seconds. The values of the TRAINING_ROWS examples come from a seeded generator, as no table
has labelled personal data; what stands around them is drawn from the texts themselves: words of the CONTEXT_DOCS documents
with the smallest hashes (the bound on what the driver reads, CONTEXT_CHARS each). A third of the examples is held out for the thresholds.

Spans are code points, end exclusive. Null or empty texts have no spans; repeated rows repeat their result; an empty
table gives an empty result; other columns are never read, whatever their names. Patterns use possessive quantifiers and anchors at
the start of a run, so a text of any length is scanned in one pass each, and matches are swept in order of their starts.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("digits", "account", "spelled")
KINDS = BASE_KINDS + ADDED_KINDS
#: Matches equal those of the plain forms; a run is entered at its start or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "digits": r"(?:(?<![A-Za-z0-9.+,-])|\G)\(?[0-9](?:[\x20()./-]{0,2}+[0-9]){6,}+(?![A-Za-z0-9])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "spelled": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]++)++",
}
LEFT, RIGHT = 24, 12
CUES = r"(?i)(?:phone|tel|call|mobile|cell|fax|ssn|social|passport|account|iban|card|visa|id no|contact|email|e-mail|mail)[^A-Za-z0-9]*(?:[a-z]{1,4}[^A-Za-z0-9]+)?$"
COUNTERCUES = r"(?i)(?:order|invoice|version|isbn|page|ref|total|price|sum|year|date|build|ticket|item|serial|part|model|logged|since|until)[^A-Za-z0-9]*(?:[a-z]{1,4}[^A-Za-z0-9]+)?$"
DATE = r"^(?:(?:19|20)[0-9][0-9][-./ ][0-9]{1,2}[-./ ][0-9]{1,2}(?![0-9])|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)[0-9][0-9](?![0-9]))"
COUNTRY = r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)[0-9]{2}"
#: Named patterns of a value, of its left and of its right side; each is a feature.
OF_VALUE = {"account": "^[A-Z]{2}[0-9]{2}", "country": COUNTRY, "date": DATE, "lead": r"^\(?0[1-9]", "dotted": r"[(\[]dot[)\]]", "spelled": "at"}
OF_LEFT = {"cue": CUES, "countercue": COUNTERCUES, "in_word": r"[A-Za-z0-9_#$%=:/-]$", "sum_before": r"[$€£]\x20?$"}
OF_RIGHT = {"timed": r"^:[0-9]", "runs_on": r"^[A-Za-z0-9_%=/-]", "sum_after": r"^\x20?(?:%|€|\$|EUR|USD|kg|km|ms|MB|GB)"}
COUNTS = ("digits", "groups", "length", "parens", "dashes", "dots", "slashes", "marks", "first_group", "last_group", "letters")
FEATURES = (*COUNTS, *OF_VALUE, *OF_LEFT, *OF_RIGHT)
TRAINING_ROWS, CONTEXT_DOCS, CONTEXT_CHARS = 6000, 300, 400
TREES, RATE, DEPTH, PRECISION = 40, 0.3, 3, 0.995
#: Around examples where no text is given.
PLAIN_CONTEXT = ("the", "and of", "it was", "in", "that is")
DATES = ("2024-01-31", "31.01.2024", "2023/11/05", "05-11-2023", "2019.7.4")


# --- boosting, on the driver -----------------------------------------------------------------------------------
def _digits_of(r: random.Random, sizes, sep: str) -> str:
    return sep.join("".join(r.choice("0123456789") for _ in range(n)) for n in sizes)


def _personal(r: random.Random) -> tuple[str, str, float]:
    """(kind, value, how often a cue stands before it)."""
    d = lambda *sizes, sep="": _digits_of(r, sizes, sep)
    kind = r.random()
    if kind < 0.6:
        phones = (f"({d(3)}) {d(3, 4, sep='-')}", d(3, 3, 4, sep="-"), d(3, 3, 4, sep="."), f"0{d(1)} {d(2, 2, 2, 2, sep=' ')}", f"0{d(3, r.randint(6, 8), sep='/')}", f"0{d(2, r.randint(6, 8), sep=' ')}", f"(0{d(2)}) {d(r.randint(5, 8))}", f"0{d(3)}-{d(r.randint(5, 7))}", f"0{d(3)}/{d(3, 2, 2, sep=' ')}")
        return "digits", r.choice(phones), 0.75
    if kind < 0.7:
        return "digits", d(3, 2, 4, sep="-"), 0.75
    if kind < 0.75:
        return "digits", f"0{d(r.choice([9, 10]))}", 1.0  # bare, so a cue is needed
    if kind < 0.88:
        return "account", r.choice(("DE", "FR", "ES", "GB", "NL", "AT")) + d(2) + r.choice(["", " "]) + d(4, 4, 4, 4, sep=r.choice(["", " "])), 0.5
    gap, (at, dot) = r.choice(("", " ")), r.choice((("[at]", "[dot]"), ("(at)", "(dot)")))
    return "spelled", gap.join((f"{'n' * r.randint(2, 9)}{r.choice(['', d(1)])}", at, "host", dot, "org")), 0.4


def _other(r: random.Random) -> tuple[str, str, float, str]:
    """(kind, value, how often a counter-cue stands before it, what follows)."""
    d = lambda *sizes, sep="": _digits_of(r, sizes, sep)
    kind = r.random()
    if kind < 0.3:  # dates, with a time or part of one after them
        hour = r.choice(("", "", f" {r.randint(0, 23):02d}"))
        return "digits", r.choice(DATES) + hour, 0.4, f":{d(2)}:{d(2)}" if hour else ""
    if kind < 0.45:
        return "digits", d(r.choice([7, 8, 9, 10, 12, 14, 16, 16, 20])), 0.4, r.choice(("", "", " EUR", "%"))
    if kind < 0.58:
        return "digits", _digits_of(r, [r.choice([1, 2]) for _ in range(r.randint(7, 9))], r.choice([" ", ".", "-"])), 0.3, ""
    if kind < 0.68:
        return "digits", d(4, 4, 4, 4, sep=r.choice([" ", "-"])), 0.3, ""
    if kind < 0.74:
        return "digits", _digits_of(r, [r.choice([1, 2, 3]), 3, 3], " "), 0.4, r.choice(("", " EUR", " km"))
    if kind < 0.8:
        return "digits", d(3, r.choice([1, 10]), 5, 2, sep="-"), 0.8, ""
    if kind < 0.86:  # the forms of phones in numbering
        return "digits", d(3, 3, 4, sep=r.choice("-.")), 1.0, ""
    if kind < 0.93:
        return "account", r.choice(("XK", "AB", "SN", "PN", "DE")) + d(2) + " " + " ".join(r.choice("ABCDEFGHJK") + d(3) for _ in range(3)), 0.7, ""
    return "spelled", r.choice(("look (at) this.then", "meet [at] noon.today", "come (at) once.and")), 0.1, ""


def _example(r: random.Random, words: tuple[str, ...]) -> tuple[str, list[float], int]:
    """(kind, features, whether personal) of a value among words of the texts."""
    left, right = r.choice(words) + " ", r.choice(("", ".", ",", " ")) + " " + r.choice(words)
    if r.random() < 0.45:
        kind, value, often = _personal(r)
        y = 1
        if r.random() < often:
            left += r.choice(("phone: ", "tel ", "call ", "mobile ", "contact ", "account ", "mail: ", "fax: "))
    else:
        kind, value, often, after = _other(r)
        y, right = 0, after + right
        if r.random() < often:
            left += r.choice(("order ", "version ", "ref ", "total ", "date: ", "build ", "item ", "serial no ", "logged "))
    return kind, describe(value, left[-LEFT:], right[:RIGHT]), y


def describe(v: str, left: str, right: str) -> list[float]:
    """FEATURES of a value between two sides; features_of() is the same in columns."""
    parts = re.findall("[0-9]+", v)
    counts = (sum(map(len, parts)), len(parts), len(v), v.count("("), v.count("-"), v.count("."), v.count("/"), len(set(re.sub("[0-9A-Za-z]", "", v))), len(parts[0]) if parts else 0, len(parts[-1]) if parts else 0, len(re.sub("[^A-Za-z]", "", v)))
    named = [re.search(p, x) is not None for group, x in ((OF_VALUE, v), (OF_LEFT, left), (OF_RIGHT, right)) for p in group.values()]
    return [float(x) for x in (*counts, *named)]


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A nested (feature, cut, left, right) or a leaf value, by second-order gain."""
    score = lambda s, t: s * s / (t + 1.0)
    best, at = 1e-6, None
    if depth:
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= cut
                gain = score(g[left].sum(), h[left].sum()) + score(g[~left].sum(), h[~left].sum()) - score(g.sum(), h.sum())
                if gain > best and left.sum() >= 10 and (~left).sum() >= 10:
                    best, at = gain, (f, float(cut), left)
    if at is None:
        return float(RATE * g.sum() / (h.sum() + 1.0))
    f, cut, left = at
    return f, cut, _tree(x[left], g[left], h[left], depth - 1), _tree(x[~left], g[~left], h[~left], depth - 1)


def _value(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@dataclass(frozen=True)
class Model:
    """Trees, a threshold on their sum for each loose kind (none: the kind isn't reported), and held-out (kind, score, y)."""

    trees: tuple
    thresholds: dict
    held_out: tuple

    def score(self, features: list[float]) -> float:
        return sum(_value(t, features) for t in self.trees)

    def held_out_quality(self) -> dict:
        """{kind: (precision, recall)} of the held-out examples."""
        out = {}
        for kind, cut in self.thresholds.items():
            rows = [(s, y) for k, s, y in self.held_out if k == kind]
            said = [y for s, y in rows if cut is not None and s >= cut]
            out[kind] = (sum(said) / max(1, len(said)), sum(said) / max(1, sum(y for _, y in rows)))
        return out


@lru_cache(maxsize=8)
def model(words: tuple[str, ...] = PLAIN_CONTEXT) -> Model:
    """Fitted on examples among `words`; the last third sets the thresholds."""
    r = random.Random(5)
    kinds, x, y = zip(*[_example(r, words) for _ in range(TRAINING_ROWS)], strict=True)
    x, y = np.array(x), np.array(y, float)
    n = len(x) * 2 // 3
    f, trees = np.zeros(n), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        tree = _tree(x[:n], y[:n] - p, p * (1 - p), DEPTH)
        trees.append(tree)
        f += np.array([_value(tree, row) for row in x[:n]])
    held = tuple((kinds[i], sum(_value(t, x[i]) for t in trees), int(y[i])) for i in range(n, len(x)))
    thresholds = {}
    for kind in ADDED_KINDS:
        rows = sorted(((s, v) for k, s, v in held if k == kind), reverse=True)
        right, cut = 0, None
        for i, (s, v) in enumerate(rows, 1):
            right += v
            if right >= PRECISION * i and (i == len(rows) or rows[i][0] < s):
                cut = (s + rows[i][0]) / 2 if i < len(rows) else s
        thresholds[kind] = cut
    return Model(tuple(trees), thresholds, held)


def context_words(docs: DataFrame, id_col: str, text_col: str) -> tuple[str, ...]:
    """Runs of up to three words without digits from CONTEXT_DOCS texts, in order; PLAIN_CONTEXT where there are none.

    A share of the rows by hash is ranked, about four times as many as are taken, so that no task has to send its own best.
    """
    text = F.left(F.col(text_col).cast("string"), F.lit(CONTEXT_CHARS))
    mark = F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))
    share = min(1.0, 4 * CONTEXT_DOCS / max(1, docs.count()))
    rows = docs.select(text.alias("t"), mark.alias("mark")).filter((F.length("t") > 0) & (F.pmod("mark", F.lit(1_000_000_007)) <= int(share * 1_000_000_007)))
    rows = rows.orderBy("mark", "t").limit(CONTEXT_DOCS)
    runs = F.regexp_extract_all("t", F.lit(r"[^\x09-\x0D\x200-9]{1,12}(?:\x20[^\x09-\x0D\x200-9]{1,12}){0,2}"), F.lit(0))
    words = sorted({w for r in rows.select(F.slice(runs, 1, 8).alias("w")).collect() for w in r.w})
    return tuple(words) or PLAIN_CONTEXT


# --- candidates, in columns ------------------------------------------------------------------------------------
#: Elements of an array that one inner fold takes; folds copy what they hold at each step, so none holds a whole array.
CHUNK = 64


def let(value: Column, use) -> Column:
    """use(value), the value computed once."""
    return F.transform(F.array(value), use)[0]


def scan(values: Column, zero: Column, step, emit, kind: str) -> tuple[Column, Column]:
    """A fold over an array in order, state by state: (all that emit(state, x) gave, as array<kind>; the last state).

    Chunks are folded twice: once for the states between them, once for what they emit; the time is linear in the array as long as
    it has fewer than CHUNK squared chunks.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")

    def both(x: Column) -> Column:
        n = F.ceil(F.size(x) / CHUNK).cast("int")
        chunks = F.transform(F.slice(F.sequence(F.lit(0), n), 1, n), lambda j: F.slice(x, j * CHUNK + 1, CHUNK))

        def walk(parts: Column) -> Column:
            states = F.aggregate(parts, F.array(zero), lambda acc, part: F.concat(acc, F.array(F.aggregate(part, F.element_at(acc, -1), step))))

            def write(at: Column) -> Column:
                def chunk(part: Column, j: Column) -> Column:
                    start = F.struct(F.get(at, j).alias("state"), none.alias("out"))
                    return F.aggregate(part, start, lambda a, y: F.struct(step(a["state"], y).alias("state"), F.concat(a["out"], emit(a["state"], y)).alias("out")))["out"]

                return F.struct(F.flatten(F.transform(parts, chunk)).alias("out"), F.element_at(at, -1).alias("last"))

            return let(states, write)

        return let(chunks, walk)

    got = let(values, both)
    return got["out"], got["last"]


CANDIDATE = "struct<start:int,value:string,left:string,right:string>"


def candidates(text: Column, kind: str) -> Column:
    """array<struct<start, value, left, right>> of a generator's matches; text holds neither U+0001 nor U+0002. The right side ends at
    the generator's next match."""
    pieces = F.split(F.regexp_replace(text, PATTERNS[kind], "\u0001$0\u0002"), "\u0001")
    none = F.expr(f"cast(array() as array<{CANDIDATE}>)")

    def step(state: Column, piece: Column) -> Column:
        at = state["at"] + F.length(piece) - F.when(F.instr(piece, "\u0002") > 0, 1).otherwise(0)
        return F.struct(at.alias("at"), F.right(F.replace(piece, F.lit("\u0002"), F.lit("")), F.lit(LEFT)).alias("left"))

    def emit(state: Column, piece: Column) -> Column:
        right = F.left(F.substring_index(piece, "\u0002", -1), F.lit(RIGHT))
        span = F.struct(state["at"].alias("start"), F.substring_index(piece, "\u0002", 1).alias("value"), state["left"].alias("left"), right.alias("right"))
        return F.when(F.instr(piece, "\u0002") > 0, F.array(span)).otherwise(none)

    def found(parts: Column) -> Column:
        # most texts have no match of a kind
        return F.when(F.size(parts) > 1, scan(parts, F.struct(F.lit(0).alias("at"), F.lit("").alias("left")), step, emit, CANDIDATE)[0]).otherwise(none)

    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, let(pieces, found)).otherwise(none)


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def part(i: Column) -> Column:
        v = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, v).otherwise(F.when(v > 4, v * 2 - 9).otherwise(v * 2))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), part), F.lit(0), lambda a, v: a + v) % 10 == 0


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def certain(kind: str, value: Column) -> Column:
    """The strict checks of a base kind."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3) & (F.substring(F.regexp_replace(p, "^0+(?=[0-9])", ""), 1, 3).cast("int") <= 255))
    d = _digits(value)
    if kind == "card":
        return F.length(d).between(13, 19) & luhn(d)
    return F.length(d).between(9, 15)


def features_of(value: Column, left: Column, right: Column) -> list[Column]:
    count = lambda c: F.length(value) - F.length(F.replace(value, F.lit(c), F.lit("")))
    parts = F.filter(F.split(value, "[^0-9]+"), lambda x: x != "")
    marks = F.size(F.array_distinct(F.filter(F.split(F.regexp_replace(value, "[0-9A-Za-z]", ""), ""), lambda x: x != "")))
    size = lambda i: F.coalesce(F.length(F.get(parts, i)), F.lit(0))
    counts = [F.length(_digits(value)), F.size(parts), F.length(value), count("("), count("-"), count("."), count("/"), marks, size(F.lit(0)), size(F.size(parts) - 1), F.length(F.regexp_replace(value, "[^A-Za-z]", ""))]
    return counts + [x.rlike(p).cast("int") for group, x in ((OF_VALUE, value), (OF_LEFT, left), (OF_RIGHT, right)) for p in group.values()]


def boosted(features: Column, trees: tuple) -> Column:
    """Summed tree score of a struct of FEATURES."""

    def walk(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        return F.when(features[FEATURES[tree[0]]] <= tree[1], walk(tree[2])).otherwise(walk(tree[3]))

    total = F.lit(0.0)
    for tree in trees:
        total = total + walk(tree)
    return total


SPAN = "struct<start:int,end:int,kind:int,score:double,value:string>"


def apart(loose: Column, certain_spans: Column) -> Column:
    """Loose spans that touch no certain one, and of those that overlap each other the best: three sweeps over sorted spans.

    Forward, a span must begin where no certain one reaches; backward, it must end before the next certain one begins; then each is held
    against the best span at hand.
    """
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    fixed = F.transform(certain_spans, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.lit(-1).alias("kind"), F.lit(0.0).alias("score"), F.lit("").alias("value")))
    is_loose = lambda x: x["kind"] >= 0

    reach = lambda state, x: F.when(is_loose(x), state).otherwise(F.greatest(state, x["end"]))
    free = lambda state, x: F.when(is_loose(x) & (x["start"] >= state), F.array(x)).otherwise(none)
    out, _ = scan(F.array_sort(F.concat(loose, fixed)), F.lit(0), reach, free, SPAN)

    ahead = lambda state, x: F.when(is_loose(x), state).otherwise(x["start"])
    before = lambda state, x: F.when(is_loose(x) & (x["end"] <= state), F.array(x)).otherwise(none)
    out, _ = scan(F.reverse(F.array_sort(F.concat(out, fixed))), F.lit(2147483647), ahead, before, SPAN)

    def parted(held: Column, x: Column) -> Column:
        return held.isNull() | (x["start"] >= held["end"])

    best = lambda held, x: F.when(parted(held, x) | (x["score"] > held["score"]), x).otherwise(held)
    done = lambda held, x: F.when(held.isNotNull() & parted(held, x), F.array(held)).otherwise(none)
    out, last = scan(F.reverse(out), F.expr(f"cast(null as {SPAN})"), best, done, SPAN)
    return F.concat(out, F.when(last.isNotNull(), F.array(last)).otherwise(none))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, email, ip, card, phone, digits, account, spelled): one row per input row.

    Each kind's column is an array<struct<start, end, value>>, ascending; the last three hold what the trees chose.
    """
    fitted = model(context_words(docs, id_col, text_col))
    text = F.translate(F.col(text_col).cast("string"), "\u0001\u0002", "\u0003\u0003")
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    out = out.select("doc_id", *[candidates(F.col("text"), k).alias(k) for k in KINDS])
    span = lambda c: F.struct(c["start"].alias("start"), (c["start"] + F.length(c["value"])).alias("end"), c["value"].alias("value"))

    def strict(kind: str) -> Column:
        return F.transform(F.filter(kind, lambda c: certain(kind, c["value"])), span).alias(kind)

    def described(kind: str) -> Column:
        def one(c: Column) -> Column:
            f = F.struct(*[x.cast("double").alias(n) for n, x in zip(FEATURES, features_of(c["value"], c["left"], c["right"]), strict=True)])
            return F.struct(c["start"].alias("start"), (c["start"] + F.length(c["value"])).alias("end"), F.lit(ADDED_KINDS.index(kind)).alias("kind"), f.alias("f"), c["value"].alias("value"))

        return F.transform(kind, one)

    def chosen(kind: str, cut: float) -> Column:
        scored = F.transform(described(kind), lambda c: F.struct(c["start"], c["end"], c["kind"], boosted(c["f"], fitted.trees).alias("score"), c["value"]))
        return F.filter(scored, lambda c: c["score"] >= cut)

    picked = [chosen(k, cut) for k, cut in fitted.thresholds.items() if cut is not None]
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    out = out.select("doc_id", *[strict(k) for k in BASE_KINDS], (F.concat(*picked) if picked else none).alias("loose"))
    out = out.select("doc_id", *BASE_KINDS, F.when(F.size("loose") > 0, apart(F.col("loose"), F.concat(*BASE_KINDS))).otherwise(none).alias("loose"))
    of = lambda i: F.transform(F.filter("loose", lambda c: c["kind"] == i), lambda c: F.struct(c["start"], c["end"], c["value"]))
    return out.select("doc_id", *BASE_KINDS, *[of(i).alias(kind) for i, kind in enumerate(ADDED_KINDS)])
