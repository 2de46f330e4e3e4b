"""Merged blocks against a look at every block, and a large inventory."""

import ipaddress
import random
import time

import pytest
from pyspark.sql import functions as F

from alertloom.functions import net, prefixes
from alertloom.functions.prefixes import Prefixes


def by_hand(blocks, address):
    n = prefixes.number(address)
    held = [(rank, i, label) for i, (b, label, rank) in enumerate(blocks) if n is not None and prefixes.borders(b)[0] <= n <= prefixes.borders(b)[1]]
    return min(held)[2] if held else None


@pytest.mark.parametrize("seed", range(20))
def test_equal_to_every_block(seed):
    r = random.Random(seed)
    blocks = []
    for _ in range(r.randint(0, 40)):
        if r.random() < 0.6:
            blocks.append((f"10.0.{r.randint(0, 3)}.{r.randint(0, 255)}/{r.randint(20, 32)}", r.choice("abc"), r.randint(0, 2)))
        else:
            blocks.append((f"2001:db8::{r.randint(0, 4095):x}/{r.randint(112, 128)}", r.choice("abc"), r.randint(0, 2)))
    if seed % 5 == 0:
        blocks += [("0.0.0.0/0", "all4", 5), ("::/0", "all", 9)]
    table = Prefixes.of(blocks)
    assert all(a <= b for a, b in zip(table.lows, table.highs, strict=True)) and all(b < c for b, c in zip(table.highs, table.lows[1:], strict=False))
    asked = [f"10.0.{r.randint(0, 4)}.{r.randint(0, 255)}" for _ in range(150)] + [f"2001:db8::{r.randint(0, 5000):x}" for _ in range(150)] + ["8.8.8.8", "x", "", None, "::1", "255.255.255.255", "0.0.0.0"]
    assert [table.find(a) for a in asked] == [by_hand(blocks, a) for a in asked]


def test_a_large_inventory(spark):
    r = random.Random(1)
    blocks = [(f"{r.randint(1, 223)}.{r.randint(0, 255)}.{r.randint(0, 255)}.0/{r.randint(18, 26)}", r.choice(("infrastructure", "owned", "internal")), r.randint(0, 2)) for _ in range(100_000)]
    began = time.process_time()
    table = Prefixes.of(blocks)
    assert time.process_time() - began < 20 and 10_000 < len(table.lows) <= 200_000
    asked = [str(ipaddress.ip_address(r.randrange(1 << 32))) for _ in range(3000)]
    df = spark.createDataFrame([(a,) for a in [*asked, None, "none"]], "ip string").withColumn("label", table.label(spark, F.col("ip"), "external"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CASE WHEN" not in plan and "NestedLoop" not in plan
    got = {x.ip: x.label for x in df.collect()}
    assert got == {a: table.find(a) or "external" for a in [*asked, None, "none"]}
    few = random.Random(2).sample(asked, 40)
    assert [table.find(a) for a in few] == [by_hand(blocks, a) for a in few]


def test_precedence_equals_the_context_of_small_inventories(spark, one):
    assets = net.Assets(infrastructure=("203.0.113.0/24",), owned=("192.0.2.0/24", "203.0.113.128/25"), internal=("10.0.0.0/8", "fd00::/8"))
    table = Prefixes.of(net.blocks_of(assets))
    for ip in ("203.0.113.200", "192.0.2.9", "10.1.1.1", "fd00::1", "8.8.8.8", "nonsense", "172.16.0.1", "127.0.0.1", "2001:db8::1", "fe80::1"):
        assert one(net.ip_context(F.lit(ip), assets))[0] == (table.find(ip) or "external"), ip


def test_bounds(spark, monkeypatch):
    table = Prefixes.of([("10.0.0.0/8", "a", 0)])
    monkeypatch.setattr(prefixes, "MOST_BYTES", 10)
    with pytest.raises(ValueError, match="broadcast"):
        table.label(spark, F.lit("10.0.0.1"), "x")
    assert [tuple(x) for x in table.frame(spark).collect()] == [(f"{prefixes.FOUR + (10 << 24):033x}", f"{prefixes.FOUR + (11 << 24) - 1:033x}", "a")]
    assert Prefixes.of([]).find("10.0.0.1") is None
    with pytest.raises(ValueError):
        Prefixes.of([("not a block", "a", 0)])
