"""IP address predicates as Column expressions.

The private ranges are a fixed list of six blocks, so the test is a literal range
check on the parsed address -- no join needed, and no spelling of an address matters.
IPv4-mapped IPv6 addresses count as IPv4. Not covered (as in the reference): 0.0.0.0/8, fc00::/7, fe80::/10.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: private blocks ------------------------------------------------------------
PRIVATE_V4 = ("127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16")
V6_LOOPBACK = "::1"
# ------------------------------------------------------------------------------------------------

_V4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
_TAIL_V4 = r"^(.*:)(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})$"


def _dotted(ip: Column) -> Column:
    octs = [F.regexp_extract(ip, _V4, i).try_cast("bigint") for i in range(1, 5)]
    ok = ip.rlike(_V4) & F.greatest(*octs).between(0, 255)
    return F.when(ok, octs[0] * 16777216 + octs[1] * 65536 + octs[2] * 256 + octs[3])


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ipv6_groups(ip: Column) -> Column:
    """The eight 16-bit groups of an IPv6 address in any spelling; NULL when it is none."""
    hex4 = lambda n: F.lower(F.hex(n.cast("bigint")))
    plain = _let(_dotted(F.regexp_extract(ip, _TAIL_V4, 2)), lambda tail: F.when(tail.isNotNull(), F.concat(
        F.regexp_extract(ip, _TAIL_V4, 1), hex4(F.floor(tail / 65536)), F.lit(":"), hex4(tail % 65536))).otherwise(ip))
    part = lambda h: F.filter(F.split(h, ":"), lambda x: x != "")

    def spread(p):
        halves = F.split(p, "::")
        sides = F.struct(part(halves[0]).alias("head"), F.size(halves).alias("n"),
                         F.when(F.size(halves) == 2, part(F.try_element_at(halves, F.lit(2)))).otherwise(F.array()).alias("rest"))
        # one group at least next to each single colon, one double colon at most, and it stands for a group or more
        shape = p.rlike(r"(?i)^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?$")
        return F.when(shape, _let(sides, fill))

    def fill(s):
        gap = F.lit(8) - F.size(s["head"]) - F.size(s["rest"])
        ok = ((s["n"] == 1) & (F.size(s["head"]) == 8)) | ((s["n"] == 2) & (gap >= 1))
        groups = F.concat(s["head"], F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), s["rest"])
        return F.when(ok, F.transform(groups, lambda g: F.conv(g, 16, 10).cast("bigint")))
    return _let(plain, spread)


def _v4_of_groups(g: Column) -> Column:
    """Number of an IPv4-mapped address; NULL when it is none."""
    mapped = (F.slice(g, 1, 5) == F.array_repeat(F.lit(0).cast("bigint"), 5)) & (F.get(g, F.lit(5)) == 65535)
    return F.when(mapped, F.get(g, F.lit(6)) * 65536 + F.get(g, F.lit(7)))


def ipv4_to_long(ip: Column) -> Column:
    """Dotted IPv4 (or IPv4-mapped IPv6 in any spelling) as a number; NULL when not IPv4."""
    return F.coalesce(_dotted(ip), _v4_of_groups(ipv6_groups(ip)))


def _block(cidr: str) -> tuple[int, int]:
    base, bits = cidr.split("/")
    a, b, c, d = (int(x) for x in base.split("."))
    lo = (a << 24) | (b << 16) | (c << 8) | d
    return lo, lo + (1 << (32 - int(bits))) - 1


def is_private_ip(ip: Column) -> Column:
    def judge(a):
        v4 = F.lit(False)
        for cidr in PRIVATE_V4:
            lo, hi = _block(cidr)
            v4 = v4 | a["v4"].between(lo, hi)
        loopback = F.array(*[F.lit(0).cast("bigint")] * 7, F.lit(1).cast("bigint"))  # V6_LOOPBACK, parsed
        return F.coalesce(v4, F.lit(False)) | F.coalesce(a["v6"] == loopback, F.lit(False))
    groups = lambda g: F.struct(F.coalesce(_dotted(ip), _v4_of_groups(g)).alias("v4"), g.alias("v6"))
    return F.coalesce(_let(_let(ipv6_groups(ip), groups), judge), F.lit(False))
