"""SentencePiece encoding and decoding by a shared-prefix forward pass.

Texts become marked words (one U+2581 and the characters up to the next). The distinct marked words of a batch are
sorted, which walks their trie depth first: a word keeps the forward states of the prefix it shares with the word
before and only extends them. For a unigram model the state is the Viterbi score and last piece. For a BPE model
scores of whole segmentations don't define the result; there a path is allowed where every two neighbouring pieces
are exactly what merging their concatenation gives, which singles out the library's own segmentation, so the forward
state holds the one last piece of each prefix. Both give the ids of the sentencepiece library for the same model.

Words part further where no piece of the vocabulary could join (a letter and the punctuation after it), so "word," costs
no entry of its own. Runs of spaces are merged by the model's rules and cached by length; characters outside the vocabulary fall back to
bytes. Null texts have null ids; empty texts have none. Rows are encoded one by one, so repeated rows repeat and
other columns are never read, whatever their names; an empty table gives an empty result. The word cache is bounded by `CACHE_WORDS` and refilled when full.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MARK = "▁"
CACHE_WORDS = 600_000
CACHE_PAIRS = 2_000_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """Vocabulary with scores; kind is "bpe" or "unigram"."""

    def __init__(self, pieces: list[tuple[str, float]], kind: str, bytes_at: dict[int, int], specials: set[int], unknown: int, dummy_prefix: bool = True):
        self.pieces, self.kind, self.bytes_at, self.unknown, self.dummy_prefix = pieces, kind, bytes_at, unknown, dummy_prefix
        self.ids = {p: i for i, (p, _) in enumerate(pieces) if i not in specials and i not in bytes_at.values()}
        self.pairs: dict[int, bool] = {}
        self.runs: dict[int, list[int]] = {}
        self.specials = specials
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces that join words are not supported")
        if kind == "bpe" and any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("a piece has a character that is no piece")
        self.length = [len(p) for p, _ in pieces]
        self.raw = [b""] * len(pieces)
        for b, i in bytes_at.items():
            self.raw[i] = bytes([b])
        for p, i in self.ids.items():
            self.raw[i] = p.replace(MARK, " ").encode()
        self._prepare()

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(Path(path).read_bytes())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("only identity normalisation with byte fallback is supported")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        at = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        kind = {1: "unigram", 2: "bpe"}[proto.trainer_spec.model_type]
        return cls([(sp.id_to_piece(i), sp.get_score(i)) for i in range(n)], kind, at, special, sp.unk_id(), spec.add_dummy_prefix)

    def _prepare(self) -> None:
        """Pieces the forward pass may use, their order of merging, and where each was last joined."""
        if self.kind == "bpe":
            order = sorted(self.ids.values(), key=lambda i: -self.pieces[i][1])
            self.rank = [-1] * len(self.pieces)
            for r, i in enumerate(order):
                if len(self.pieces[i][0]) > 1:
                    self.rank[i] = r
            self.left, self.right = [-1] * len(self.pieces), [-1] * len(self.pieces)
            self.usable = {}
            for p, i in self.ids.items():
                if len(p) > 1:
                    parts = self.merge(p, stop=2)
                    if len(parts) != 2 or parts[0] + parts[1] != p or len(self.merge(p)) != 1:
                        continue  # merging never makes this piece
                    self.left[i], self.right[i] = self.ids[parts[0]], self.ids[parts[1]]
                self.usable[p] = i
        else:
            self.usable = self.ids
        ends: dict[str, set[int]] = {}
        for p in self.usable:
            if len(p) >= 3:
                ends.setdefault(p[-3:], set()).add(len(p))
        #: Last three characters -> lengths of the pieces that may end so, longest first.
        self.ends = {e: (*sorted(n, reverse=True), 2, 1) for e, n in ends.items()}
        # where no piece has a character after a letter or digit, and around a line break that no piece has, words part
        joined = {b for p in self.ids for a, b in zip(p, p[1:]) if a.isalnum()}  # noqa: B905
        apart = re.escape("".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in joined))
        line = r"\n" if not any("\n" in p for p in self.ids) else ""
        w, o = r"[^\W_]", rf"(?:[^\w{MARK}{line}]|_)"
        rest = rf"(?:{w}+(?:(?:[^\w{MARK}{line}{apart}]|_){o}*{w}*)*)"
        self.unit = re.compile(rf"{MARK}+{o}*{rest}?|{o}+{rest}?|{rest}" + (r"|\n" if line else ""))

    # --- the model's merge rule on a short string
    def merge(self, text: str, stop: int = 1) -> list[str]:
        """BPE by definition: join the neighbours whose concatenation scores best, leftmost on ties, down to `stop` parts."""
        parts: list[str | None] = list(text)
        nxt, prv = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str, str]] = []
        left = len(parts)

        def offer(i: int) -> None:
            j = nxt[i]
            if j < len(parts) and (k := self.ids.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.pieces[k][1], i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap and left > stop:
            _, i, a, b = heapq.heappop(heap)
            if parts[i] != a or (j := nxt[i]) >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            left -= 1
            nxt[i] = nxt[j]
            if nxt[j] < len(parts):
                prv[nxt[j]] = i
            if prv[i] >= 0:
                offer(prv[i])
            offer(i)
        return [p for p in parts if p is not None]

    def stays(self, a: int, b: int) -> bool:
        """Whether merging the two pieces' text gives just these two pieces.

        Their joins are undone, the later one first; they part if at some point a join across the border would have
        come before the join just undone (on a tie, the one further left comes first).
        """
        rank, ids, pieces = self.rank, self.ids, self.pieces
        limit = len(pieces)
        while True:
            k = ids.get(pieces[a][0] + pieces[b][0])
            if k is not None and rank[k] < limit:
                return False
            x, y = rank[a], rank[b]
            if x > y:
                limit, a = x, self.right[a]
            elif y >= 0:
                limit, b = y + 1, self.left[b]
            else:
                return True

    # --- the forward pass
    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct marked words; a word is one MARK (or none) and other characters."""
        out: dict[str, list[int]] = {}
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        extend = self._extend_bpe if self.kind == "bpe" else self._extend_best
        before = ""
        # of each prefix of the word: the id of its last piece (-1: a character without one, -2: the beginning), and the score
        last, scores = [-2], [0.0]
        length = self.length
        for word in sorted(words):
            same, most = 0, min(len(before), len(word))
            while same < most and before[same] == word[same]:
                same += 1
            del last[same + 1 :], scores[same + 1 :]
            extend(word, same + 1, last, scores)
            got: list[int] = []
            end = len(word)
            while end:
                piece = last[end]
                if piece < 0:
                    got += [self.bytes_at[b] for b in reversed(word[end - 1].encode("utf-8", "replace"))]
                    end -= 1
                else:
                    got.append(piece)
                    end -= length[piece]
            got.reverse()
            out[word] = got
            before = word
        return out

    def _extend_bpe(self, word: str, first: int, last: list[int], scores: list[float]) -> None:
        """Forward states of the prefixes from `first` characters on: the one piece that may end each."""
        usable, ends, pairs, stays = self.usable.get, self.ends.get, self.pairs, self.stays
        size, short = len(self.pieces), (2, 1)
        for end in range(first, len(word) + 1):
            found = -1
            for n in ends(word[end - 3 : end], short) if end > 2 else short:
                if n > end:
                    continue
                piece = usable(word[end - n : end])
                if piece is not None:
                    p = last[end - n]
                    if p >= 0:
                        key = p * size + piece
                        ok = pairs.get(key)
                        if ok is None:
                            ok = pairs[key] = stays(p, piece)
                        if not ok:
                            continue
                    found = piece
                    break
            last.append(found)

    def _extend_best(self, word: str, first: int, last: list[int], scores: list[float]) -> None:
        """Viterbi scores and last pieces of the prefixes from `first` characters on."""
        for end in range(first, len(word) + 1):
            found, score = -1, scores[end - 1] - 1e3
            for n in self.ends.get(word[end - 3 : end], (2, 1)) if end > 2 else (2, 1):
                piece = self.usable.get(word[end - n : end]) if n <= end else None
                if piece is not None:
                    here = scores[end - n] + self.pieces[piece][1]
                    if found < 0 or here > score:
                        found, score = piece, here
            last.append(found)
            scores.append(score)

    def run(self, n: int) -> list[int]:
        """Ids of n marks in a row."""
        if n not in self.runs:
            if len(self.runs) > 10_000:
                self.runs.clear()
            parts = self.merge(MARK * n) if self.kind == "bpe" else self._best_run(n)
            self.runs[n] = [self.ids[p] for p in parts]
        return self.runs[n]

    def _best_run(self, n: int) -> list[str]:
        """Viterbi over marks alone."""
        sizes = [len(p) for p in self.ids if not p.strip(MARK)]
        best: list[tuple[float, int]] = [(0.0, 0)]
        for i in range(1, n + 1):
            best.append(max((best[i - k][0] + self.pieces[self.ids[MARK * k]][1], k) for k in sizes if k <= i))
        out = []
        while n:
            out.append(MARK * best[n][1])
            n -= best[n][1]
        return out[::-1]

    def encode_units(self, units: list[str]) -> dict[str, list[int]]:
        """Ids of units: any number of marks, then other characters."""
        # most units have one mark or none and are words as they are
        several = [u for u in units if u.startswith(MARK * 2) or u == MARK]
        rests = {u: u.lstrip(MARK) for u in several}
        words = set(units)
        words.difference_update(several)
        words.update(MARK + r for r in rests.values() if r)
        out = self.encode_words(list(words))
        alone = self.ids.get(MARK)
        for u, r in rests.items():
            k = len(u) - len(r)
            w = out[MARK + r] if r else []
            out[u] = self.run(k) + w[1:] if not r or w[0] == alone else self.run(k - 1) + w
        return out

    def split(self, text: str) -> list[str]:
        """Units of a text, the dummy prefix included."""
        if not text:
            return []
        return self.unit.findall((MARK if self.dummy_prefix else "") + text.replace(" ", MARK))

    def encode(self, text: str) -> list[int]:
        units = self.split(text)
        known = self.encode_units(list(set(units)))
        return [i for u in units for i in known[u]]

    def decode(self, ids) -> str:
        out = b"".join(self.raw[i] for i in ids)
        return (out[1:] if self.dummy_prefix and out[:1] == b" " else out).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _loaded(path: str) -> PieceModel:
    return PieceModel.load(path)


class _Cache:
    """Units seen so far by this worker, with their ids in one flat array."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, np.int32)
        self.start, self.size = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)
        self.used = 0

    def add(self, units: set[str]) -> None:
        if not units:
            return
        known = self.model.encode_units(list(units))
        sizes = np.fromiter(map(len, known.values()), np.int64, len(known))
        ids = np.fromiter((i for x in known.values() for i in x), np.int32, int(sizes.sum()))
        n, used = len(self.code), self.used
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(known) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[used : used + len(ids)] = ids
        self.start[n : n + len(known)] = used + np.cumsum(sizes) - sizes
        self.size[n : n + len(known)] = sizes
        self.code.update(zip(known, range(n, n + len(known)), strict=True))
        self.used += len(ids)


@lru_cache(maxsize=2)
def _cache(path: str) -> _Cache:
    return _Cache(_loaded(path))


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start[0]:start[0]+size[0]] and so on, joined."""
    ends = np.cumsum(size)
    if not len(ends):
        return flat[:0]
    return flat[np.arange(ends[-1]) + np.repeat(start - (ends - size), size)]


def encode_rows(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids array<int>, round_trip): one row per input row; round_trip: decoding gives the text back."""
    small_batches(docs.sparkSession)
    path = model_path or default_model()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = _loaded(path), _cache(path)
        lengths = np.array([len(x) for x in model.raw])
        starts = np.cumsum(lengths) - lengths
        table = np.frombuffer(b"".join(model.raw), np.uint8)
        for b in batches:
            texts = b.column(1).to_pylist()
            all_ids, counts, same, at = [], [], [], 0
            while at < len(texts):
                part, size = [], 0
                while at + len(part) < len(texts) and (not part or size < 1 << 20):
                    t = texts[at + len(part)] or ""
                    part.append(t)
                    size += len(t)
                units = [model.split(t) for t in part]
                if len(cache.code) > CACHE_WORDS:
                    cache.clear()
                cache.add({u for x in units for u in x} - cache.code.keys())
                code = cache.code
                codes = np.fromiter((code[u] for x in units for u in x), np.int64, sum(map(len, units)))
                sizes = cache.size[codes]
                ids = _gather(cache.flat, cache.start[codes], sizes)
                cut = np.concatenate([[0], np.cumsum([len(x) for x in units])])
                total = np.concatenate([[0], np.cumsum(sizes)])[cut]
                decoded = _gather(table, starts[ids], lengths[ids]).tobytes()
                ends = np.concatenate([[0], np.cumsum(lengths[ids])])[total]
                lead = 1 if model.dummy_prefix else 0
                same += [t.encode("utf-8", "surrogatepass") == decoded[a + lead * (z > a) : z] for t, a, z in zip(part, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                all_ids.append(ids)
                counts += np.diff(total).tolist()
                at += len(part)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            missing = [t is None for t in texts]
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.array([*missing, False])), pa.array(np.concatenate(all_ids) if all_ids else np.zeros(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), ids, pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids", "round_trip"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(rows, "doc_id long, n_pieces long, ids array<int>, round_trip boolean")


def decode_rows(encoded: DataFrame, model_path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the texts of ids; null ids give null."""
    small_batches(encoded.sparkSession)
    path = model_path or default_model()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else model.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(rows, "doc_id long, text string")
