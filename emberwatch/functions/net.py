"""Addresses as Column expressions: IPv4 as a long, IPv6 as 32 hex digits, both JVM-side."""

from __future__ import annotations

import ipaddress
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberwatch.functions.text import clean

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_V4_ONLY = rf"^{_V4}$"
_V4_TAIL = rf"{_V4}$"


def _let(c: Column, use) -> Column:
    """`use(c)` with c evaluated once, however often `use` names it."""
    return F.element_at(F.transform(F.array(c), use), 1)


def is_v4(c: Column) -> Column:
    return c.rlike(_V4_ONLY)


def v4_long(c: Column) -> Column:
    """The IPv4 address as a number, null for anything else."""
    part = lambda i: F.split_part(c, F.lit("."), F.lit(i)).try_cast("bigint")
    return F.when(
        is_v4(c), part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4)
    )


def _long_to_v4(n: Column) -> Column:
    return F.concat_ws(
        ".", *[(F.shiftright(n, s).bitwiseAND(F.lit(255))).cast("string") for s in (24, 16, 8, 0)]
    )


def v6_hex(c: Column) -> Column:
    """The IPv6 address as 32 lower-case hex digits (so text order is address order), null for
    anything that is not a valid IPv6 address. An IPv4 tail is accepted."""
    return F.when(c.contains(":"), _let(_without_v4_tail(c), _groups_to_hex))


def _without_v4_tail(c: Column) -> Column:
    def rewrite(number: Column) -> Column:
        pair = F.concat_ws(
            ":",
            F.lower(F.hex(F.shiftright(number, 16))),
            F.lower(F.hex(number.bitwiseAND(F.lit(65535)))),
        )
        return F.concat(F.regexp_replace(c, _V4_TAIL, ""), pair)

    number = v4_long(F.regexp_extract(c, _V4_TAIL, 0))
    return F.when(c.rlike(_V4_TAIL), _let(number, rewrite)).otherwise(F.lower(c))


def _groups_to_hex(text: Column) -> Column:
    shape = r"^(?:(?:[0-9a-f]{1,4}:)*[0-9a-f]{1,4})?(?:::(?:(?:[0-9a-f]{1,4}:)*[0-9a-f]{1,4})?)?$"
    groups = lambda t: F.filter(F.split(t, ":"), lambda g: g != "")
    missing = F.lit(8) - F.size(groups(text))
    zeros = F.array_join(F.array_repeat(F.lit("0"), missing), ":")
    filled = F.regexp_replace(text, "::", F.concat(F.lit(":"), zeros, F.lit(":")))
    ok = text.rlike(shape) & F.when(text.contains("::"), missing >= 1).otherwise(missing == 0)
    return F.when(
        ok, F.array_join(F.transform(groups(filled), lambda g: F.lpad(g, 4, "0")), "")
    )


def _hex_to_v6(h: Column) -> Column:
    """Canonical IPv6 text: no leading zeros, the first longest run of zero groups as `::`."""
    groups = F.regexp_extract_all(h, F.lit("([0-9a-f]{4})"), 1)
    text = F.array_join(F.transform(groups, lambda g: F.regexp_replace(g, "^0{1,3}", "")), ":")

    def shorten(t: Column) -> Column:
        out = t
        for n in range(2, 9):  # the longest run is tested first, so it is outermost
            run = r"(?:^|:)0" + ":0" * (n - 1) + r"(?::|$)"
            out = F.when(t.rlike(run), F.regexp_replace(t, f"^(.*?){run}(.*)$", "$1::$2")).otherwise(out)
        return out

    return _let(text, shorten)


def valid_ip(c: Column) -> Column:
    return F.coalesce(is_v4(c) | v6_hex(c).isNotNull(), F.lit(False))


def canonical_ip(c: Column) -> Column:
    """Canonical text, IPv4-mapped IPv6 as plain IPv4, null for junk."""

    def v6(h: Column) -> Column:
        mapped = F.conv(F.substring(h, 25, 8), 16, 10).cast("bigint")
        v4 = _let(mapped, _long_to_v4)
        return F.when(h.startswith("0" * 20 + "ffff"), v4).otherwise(_hex_to_v6(h))

    return F.when(is_v4(c), c).when(c.contains(":"), _let(v6_hex(c), v6))


def optional_ip(c: Column) -> Column:
    return _let(clean(c), canonical_ip)


def address_bits(c: Column) -> Column:
    """The address as 32 or 128 binary digits, null for junk."""
    word = lambda h, i: F.lpad(F.conv(F.substring(h, i, 8), 16, 2), 32, "0")
    v6 = _let(v6_hex(c), lambda h: F.concat(*[word(h, i) for i in (1, 9, 17, 25)]))
    return F.when(c.contains(":"), v6).otherwise(F.lpad(F.bin(v4_long(c)), 32, "0"))


def _v4_inside(c: Column, net: ipaddress.IPv4Network) -> Column:
    if net.prefixlen % 8 == 0 and net.prefixlen:  # whole octets: a text prefix, which scans can use
        octets = str(net.network_address).split(".")[: net.prefixlen // 8]
        prefix = ".".join(octets) + ("." if len(octets) < 4 else "")
        return (c.startswith(prefix) if len(octets) < 4 else c == prefix) & is_v4(c)
    return _let(v4_long(c), lambda n: n.between(int(net[0]), int(net[-1])))


def _v6_inside(h: Column, net: ipaddress.IPv6Network) -> Column:
    return h.between(f"{int(net[0]):032x}", f"{int(net[-1]):032x}")


def in_cidr(c: Column, network: str) -> Column:
    """Same IP version and inside the network; false for null and junk."""
    net = ipaddress.ip_network(network, strict=False)
    if net.version == 4:
        return F.coalesce(_v4_inside(c, net), F.lit(False))
    inside = c.contains(":") & _let(v6_hex(c), lambda h: _v6_inside(h, net))
    return F.coalesce(inside, F.lit(False))


def to_network(c: Column) -> Column:
    """/24 of an IPv4 address, /64 of an IPv6 address, null for junk."""
    v4 = F.concat(F.substring_index(c, ".", 3), F.lit(".0/24"))
    base = F.rpad(F.substring(v6_hex(c), 1, 16), 32, "0")
    v6 = F.concat(_let(base, _hex_to_v6), F.lit("/64"))
    return F.when(is_v4(c), v4).when(c.contains(":"), v6)


def ip_scope(c: Column, internal: list[str]) -> Column:
    """loopback, link_local, internal or external; null stays null."""
    ranges = [
        ("loopback", ["127.0.0.0/8", "::1/128"]),
        ("link_local", ["169.254.0.0/16", "fe80::/10"]),
        ("internal", internal),
    ]

    def label(test, version: int) -> Column:
        out = F.lit("external")
        for name, networks in reversed(ranges):
            nets = [n for n in map(ipaddress.ip_network, networks) if n.version == version]
            if nets:
                out = F.when(reduce(or_, [test(n) for n in nets]), F.lit(name)).otherwise(out)
        return out

    v6 = _let(v6_hex(c), lambda h: label(lambda n: _v6_inside(h, n), 6))
    return F.when(c.contains(":"), v6).when(c.isNotNull(), label(lambda n: _v4_inside(c, n), 4))
