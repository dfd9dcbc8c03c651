"""Hosts as the addresses a client would contact, compared as 128-bit numbers.

A number is 32 hexadecimal digits, whose order as text is their order as numbers; IPv4 addresses
are numbers in the mapped range.
"""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges that no public host has, by the special-purpose address registries.
LOCAL_IPV4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
LOCAL_IPV6 = ("::/127", "64:ff9b:1::/48", "100::/64", "2001:db8::/32", "fc00::/7", "fe80::/10", "fec0::/10", "ff00::/8")
# Prefixes before an embedded IPv4 address, and how many digits stand before it.
EMBEDDING = (("00000000000000000000ffff", 24), ("000000000000000000000000", 24), ("0064ff9b0000000000000000", 24), ("2002", 4))


def plain_host(host: Column) -> Column:
    """Lower case, without the dot of the root."""
    return F.regexp_replace(F.lower(host), r"\.+\z", "")


def _part(text: Column) -> Column:
    """A number in decimal, octal (leading 0) or hexadecimal (leading 0x), as URLs allow; NULL if it is none."""
    digits = F.when(text.rlike(r"^0x[0-9a-f]{0,9}\z"), F.conv(F.concat(F.lit("0"), F.substring(text, 3, 9)), 16, 10))
    digits = digits.when(text.rlike(r"^0[0-7]{1,12}\z"), F.conv(text, 8, 10))
    return digits.when(text.rlike(r"^(0|[1-9][0-9]{0,10})\z"), text).try_cast("long")


def _hex(number: Column, width: int) -> Column:
    return F.lower(F.lpad(F.hex(number), width, "0"))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ipv4_digits(host: Column) -> Column:
    """Eight digits of an address of one to four numbers, the last of which fills what is left."""

    def digits(parts: Column) -> Column:
        size = F.least(F.size(parts), F.lit(5))
        last = F.element_at(parts, -1)
        head = F.slice(parts, F.lit(1), F.size(parts) - 1)
        fits = (size <= 4) & ~F.exists(parts, lambda p: p.isNull()) & F.forall(head, lambda p: p < 256)
        room = F.element_at(F.array(*[F.lit(256**k) for k in (4, 3, 2, 1, 0)]), size)
        before = F.array_join(F.transform(head, lambda p: _hex(p, 2)), "")
        return F.when(fits & (last < room), F.concat(before, F.lpad(F.lower(F.hex(last)), 10 - 2 * size, "0")))

    return _let(F.transform(F.split(host, r"\."), _part), digits)


def _looks_numeric(host: Column) -> Column:
    """Whether clients take the host for an IPv4 address: its last label is a number."""
    return F.element_at(F.split(host, r"\."), -1).rlike(r"^([0-9]+|0x[0-9a-f]*)\z")


def ipv6_digits(host: Column) -> Column:
    """32 digits of a bracketed address, whose zone does not count; NULL if it is none."""
    text = F.regexp_replace(F.regexp_extract(host, r"^\[([0-9a-f:.]+)(%.*)?\]\z", 1), r"^\z", "-")

    def without_ipv4(text: Column) -> Column:
        tail = F.regexp_extract(text, r"([0-9.]*\.[0-9.]*)\z", 1)
        kept = F.substring(text, F.lit(1), F.length(text) - F.length(tail))
        groups = _let(ipv4_digits(tail), lambda d: F.concat(F.substring(d, 1, 4), F.lit(":"), F.substring(d, 5, 4)))
        return F.when(tail == "", text).otherwise(F.concat(kept, groups))

    def groups(side: Column) -> Column:
        return F.when(F.coalesce(side, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(side, ":"))

    def filled(sides: Column) -> Column:
        """All groups, with zeros for the gap; an array of one dash where there cannot be eight."""

        def join(both: Column) -> Column:
            count = F.size(both["l"]) + F.size(both["r"])
            gap = F.size(sides) == 2
            fits = (F.size(sides) <= 2) & F.when(gap, count <= 7).otherwise(count == 8)
            zeros = F.array_repeat(F.lit("0"), F.when(gap, F.greatest(8 - count, F.lit(0))).otherwise(0))
            return F.when(fits, F.concat(both["l"], zeros, both["r"])).otherwise(F.array(F.lit("-")))

        return _let(F.struct(groups(F.get(sides, F.lit(0))).alias("l"), groups(F.get(sides, F.lit(1))).alias("r")), join)

    def digits(groups: Column) -> Column:
        return F.when(F.forall(groups, lambda g: g.rlike(r"^[0-9a-f]{1,4}\z")), F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""))

    return _let(text, lambda t: _let(without_ipv4(t), lambda e: _let(F.split(e, "::"), lambda x: _let(filled(x), digits))))


def _inside(digits: Column, networks: tuple[str, ...], width: int) -> Column:
    def bounds(text: str) -> tuple[str, str]:
        network = ipaddress.ip_network(text)
        return tuple(f"{int(address):0{width}x}" for address in (network[0], network[-1]))

    return reduce(lambda a, b: a | b, [digits.between(*bounds(network)) for network in networks])


def is_local(host: Column) -> Column:
    """Whether the host is an address literal of a local or reserved range.

    Addresses embedded in IPv6 count as what they embed.  What stands for an address without
    being one (a bracket or a last label that is a number) is treated as local: it fails closed.
    """

    def test(host: Column) -> Column:
        return _let(F.struct(host.alias("h"), ipv4_digits(host).alias("four"), ipv6_digits(host).alias("six")), judge)

    def judge(held: Column) -> Column:
        plain, four, six = held["h"], held["four"], held["six"]
        local = F.coalesce(_inside(four, LOCAL_IPV4, 8), F.lit(False)) | F.coalesce(_inside(six, LOCAL_IPV6, 32), F.lit(False))
        for prefix, skipped in EMBEDDING:
            inner = F.when(six.startswith(prefix), F.substring(six, skipped + 1, 8))
            local = local | F.coalesce(_inside(inner, LOCAL_IPV4, 8), F.lit(False))
        return local | (_looks_numeric(plain) & four.isNull()) | (plain.startswith("[") & six.isNull())

    return F.coalesce(_let(plain_host(host), test), F.lit(False))


def is_single_label(host: Column) -> Column:
    plain = plain_host(host)
    return ~plain.contains(".") & ~plain.startswith("[")
