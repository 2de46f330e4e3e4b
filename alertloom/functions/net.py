"""Address arithmetic, asset context, traffic direction and severity, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from ipaddress import IPv4Network, IPv6Network, ip_network
from operator import or_

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from alertloom.functions.prefixes import Prefixes

#: IPv4 blocks that are not globally reachable, with the exceptions inside 192.0.0.0/24.
NON_PUBLIC = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4")
PUBLIC_INSIDE = ("192.0.0.9/32", "192.0.0.10/32")

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


@dataclass(frozen=True)
class Assets:
    """Address inventory; a few literal ranges, so membership is a CASE and not a join."""

    infrastructure: tuple[str, ...] = ()
    owned: tuple[str, ...] = ()
    internal: tuple[str, ...] = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8")

    def summary(self) -> dict[str, list[str]]:
        """The inventory as given to a prompt: blocks in normal form, entries that don't parse left out."""
        return {"owned_cidrs": _normal(self.owned), "infrastructure_ips": sorted(_normal(self.infrastructure)), "internal_cidrs": _normal(self.internal)}

    def prompt(self) -> str:
        s = self.summary()
        return "\n".join([*(f"{title}: {', '.join(s[k])}" for title, k in INVENTORY_LINES), INVENTORY_RULE])


#: The wording of the inventory in a prompt.
INVENTORY_LINES = (("Owned protected CIDRs/IPs", "owned_cidrs"), ("Monitoring/noise infrastructure IPs", "infrastructure_ips"), ("Private/internal CIDRs", "internal_cidrs"))
INVENTORY_RULE = "Classification rule: monitoring infrastructure is noise when it is the alerting source; owned and private ranges are protected assets for inbound, outbound, and lateral movement analysis."


def _normal(blocks: Iterable[str]) -> list[str]:
    """Blocks as text in normal form; a block of one address is shown as the address."""
    nets = filter(None, map(_network, blocks))
    return [str(n.network_address) if n.num_addresses == 1 else str(n) for n in nets]


def ip_number(ip: Column) -> Column:
    """IPv4 text as a long; NULL where it isn't a dotted quad of values up to 255 without leading zeros."""
    part = lambda k: F.substring_index(F.substring_index(ip, ".", k), ".", -1).try_cast("long")
    return F.when(ip.rlike(IPV4), part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4))


def _network(cidr: str) -> IPv4Network | IPv6Network | None:
    try:
        return ip_network(cidr.strip(), strict=False)
    except ValueError:
        return None


def bounds(cidr: str) -> tuple[int, int] | None:
    """(first, last) of an IPv4 block; None for anything else."""
    net = _network(cidr)
    return (int(net.network_address), int(net.broadcast_address)) if net is not None and net.version == 4 else None


def bounds6(cidr: str) -> tuple[str, str] | None:
    """(first, last) of an IPv6 block as 32 hex digits; None for anything else."""
    net = _network(cidr)
    return (f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}") if net is not None and net.version == 6 else None


_GROUPS = "[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"
IPV6 = f"^(?:{_GROUPS})?::(?:{_GROUPS})?$|^{_GROUPS}$"


def ip6_digits(ip: Column) -> Column:
    """IPv6 text as 32 hex digits, whose order is that of the addresses; NULL where it isn't one."""
    tail = ip_number(F.substring_index(ip, ":", -1))
    low = F.lpad(F.hex(tail), 8, "0")
    dotted = F.concat(F.left(ip, F.length(ip) - F.length(F.substring_index(ip, ":", -1))), F.left(low, F.lit(4)), F.lit(":"), F.right(low, F.lit(4)))
    v = F.lower(F.when(tail.isNotNull() & F.contains(ip, F.lit(":")), dotted).otherwise(ip))
    groups = lambda half: F.filter(F.split(half, ":"), lambda x: x != "")
    short = F.contains(v, F.lit("::"))
    head = groups(F.substring_index(v, "::", 1))
    tail_groups = F.when(short, groups(F.substring_index(v, "::", -1))).otherwise(F.array().cast("array<string>"))
    missing = 8 - F.size(head) - F.size(tail_groups)
    full = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), tail_groups)
    ok = v.rlike(IPV6) & F.when(short, missing >= 1).otherwise(missing == 0)
    return F.when(ok, F.array_join(F.transform(full, lambda x: F.lpad(x, 4, "0")), ""))


def in_blocks(number: Column, blocks: Iterable[str], ip: Column | None = None) -> Column:
    """Whether an address lies in one of some blocks; IPv6 blocks are looked at where the address's text is given."""
    blocks = list(blocks)
    out = F.lit(False)
    for b in filter(None, map(bounds, blocks)):
        out = out | number.between(*b)
    six = list(filter(None, map(bounds6, blocks)))
    if ip is not None and six:
        digits = ip6_digits(ip)
        inside = F.get(F.transform(F.array(digits), lambda d: reduce(or_, [d.between(*b) for b in six])), F.lit(0))
        out = F.coalesce(out, F.lit(False)) | F.coalesce(inside, F.lit(False))
    return F.coalesce(out, F.lit(False))


def is_public(ip: Column) -> Column:
    n = ip_number(ip)
    return n.isNotNull() & (~in_blocks(n, NON_PUBLIC) | in_blocks(n, PUBLIC_INSIDE))


def ip_context(ip: Column, assets: Assets, number: Column | None = None) -> Column:
    """infrastructure, owned, internal or external; unknown for an empty value, external for one that doesn't parse.

    number: ip_number(ip), where a plan has it as a column already.
    """
    n = ip_number(ip) if number is None else number
    return (
        F.when(F.coalesce(ip, F.lit("")) == "", "unknown")
        .when(in_blocks(n, assets.infrastructure, ip), "infrastructure")
        .when(in_blocks(n, assets.owned, ip), "owned")
        .when(in_blocks(n, assets.internal, ip), "internal")
        .otherwise("external")
    )


def blocks_of(assets: Assets) -> list[tuple[str, str, int]]:
    """(block, context, precedence) of an inventory, blocks that don't parse left out."""
    kinds = ((assets.infrastructure, "infrastructure"), (assets.owned, "owned"), (assets.internal, "internal"))
    return [(b, kind, rank) for rank, (blocks, kind) in enumerate(kinds) for b in blocks if _network(b)]


def large_context(spark: SparkSession, ip: Column, assets: Assets) -> Column:
    """As ip_context(), for inventories of many blocks: a bisection instead of a CASE as long as the inventory."""
    label = Prefixes.of(blocks_of(assets)).label(spark, ip, "external")
    return F.when(F.coalesce(ip, F.lit("")) == "", "unknown").otherwise(label)


def _local(context: Column) -> Column:
    return context.isin("internal", "owned")


def direction(src: Column, dest: Column) -> Column:
    return (
        F.when(src == "infrastructure", "infrastructure")
        .when(_local(src) & (dest == "external"), "outbound")
        .when((src == "external") & _local(dest), "inbound")
        .when(_local(src) & _local(dest), "lateral")
        .when(dest == "infrastructure", "inbound")
        .when((src == "external") & (dest == "external"), "external")
        .otherwise("unknown")
    )


def threat(src: Column, dest: Column, level: Column) -> Column:
    """struct<threat_direction, confidence, is_infrastructure_alert, is_internal_threat, is_external_threat>."""
    infra = src == "infrastructure"
    inside = ~infra & _local(src) & ((dest == "external") | _local(dest))
    outside = ~infra & (src == "external") & (_local(dest) | dest.isin("infrastructure", "external"))
    confidence = F.when(infra, "low").when(level >= 12, "high").when(level >= 8, "medium").otherwise("low")
    return F.struct(direction(src, dest).alias("threat_direction"), confidence.alias("confidence"), infra.alias("is_infrastructure_alert"), inside.alias("is_internal_threat"), outside.alias("is_external_threat"))


def severity(level: Column) -> Column:
    return F.when(level >= 12, "Critical").when(level >= 8, "High").when(level >= 5, "Medium").otherwise("Low")


def safe_int(value: Column, default: int = 0) -> Column:
    """Text or number as an int; NULL and anything that doesn't parse give the default."""
    return F.coalesce(value.cast("string").try_cast("int"), F.lit(default))
