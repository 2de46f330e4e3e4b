"""Address inventories of any size: blocks merged into disjoint sorted intervals, looked up by bisection.

Blocks may overlap and nest; of the blocks that hold an address the one with the smallest precedence number labels it, the earlier
in the list on a tie. The merge walks the borders once with a heap, so 100,000 blocks take about a second and give at most
twice as many intervals. Neighbouring intervals with one label are joined. Both families are one line of numbers, IPv4 behind IPv6, so
a block holds addresses of its own family only.

The intervals are sent to the executors as one broadcast, of a size that is checked (MOST_BYTES); beyond it the range join over
`frame` is the way. Addresses that don't parse, and those in no block, have the default label. Blocks that don't parse are an error.
"""

from __future__ import annotations

import heapq
import ipaddress
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where IPv4 begins on the line of numbers.
FOUR = 1 << 128
#: Bound of a broadcast, and what an interval takes in it.
MOST_BYTES, INTERVAL_BYTES = 64 << 20, 64


def number(address: str | None) -> int | None:
    """The number of an address on the line; None if it is none."""
    try:
        ip = ipaddress.ip_address((address or "").strip())
    except ValueError:
        return None
    return FOUR + int(ip) if ip.version == 4 else int(ip)


def borders(block: str) -> tuple[int, int]:
    """First and last number of a block; host bits are ignored."""
    net = ipaddress.ip_network(block.strip(), strict=False)
    add = FOUR if net.version == 4 else 0
    return add + int(net.network_address), add + int(net.broadcast_address)


@dataclass(frozen=True)
class Prefixes:
    """Disjoint intervals in order: first numbers, last numbers, labels."""

    lows: tuple[int, ...]
    highs: tuple[int, ...]
    labels: tuple[str, ...]

    @classmethod
    def of(cls, blocks: Iterable[tuple[str, str, int]]) -> Prefixes:
        """From (block, label, precedence)."""
        spans = [(*borders(b), rank, i, label) for i, (b, label, rank) in enumerate(blocks)]
        starts = sorted(spans)
        ends = sorted({s[1] + 1 for s in spans} | {s[0] for s in spans})
        lows, highs, labels, live, k = [], [], [], [], 0
        for at, following in zip(ends, ends[1:], strict=False):
            while k < len(starts) and starts[k][0] <= at:
                _, high, rank, i, label = starts[k]
                heapq.heappush(live, (rank, i, high, label))
                k += 1
            while live and live[0][2] < at:
                heapq.heappop(live)
            if not live:
                continue
            label = live[0][3]
            if lows and highs[-1] == at - 1 and labels[-1] == label:
                highs[-1] = following - 1
            else:
                lows.append(at)
                highs.append(following - 1)
                labels.append(label)
        return cls(tuple(lows), tuple(highs), tuple(labels))

    def find(self, address: str | None) -> str | None:
        n = number(address)
        i = bisect_right(self.lows, n) - 1 if n is not None else -1
        return self.labels[i] if i >= 0 and n <= self.highs[i] else None

    def label(self, spark: SparkSession, address: Column, default: str) -> Column:
        """The label of an address column; each distinct address of a batch is bisected once."""
        if len(self.lows) * INTERVAL_BYTES > MOST_BYTES:
            raise ValueError(f"{len(self.lows)} intervals are too many for a broadcast; join with frame()")
        sent = spark.sparkContext.broadcast(self)

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            table = sent.value
            for s in batches:
                codes, values = pd.factorize(s)
                found = [table.find(v) or default for v in values] + [default]  # code -1, a null, is the last
                yield pd.Series([found[c] for c in codes], dtype=object)

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "string")(address.cast("string"))

    def frame(self, spark: SparkSession) -> DataFrame:
        """(low, high, label) with 33 hex digits for each number, which sort as the numbers do."""
        return spark.createDataFrame([(f"{a:033x}", f"{b:033x}", x) for a, b, x in zip(self.lows, self.highs, self.labels, strict=True)], "low string, high string, label string")
