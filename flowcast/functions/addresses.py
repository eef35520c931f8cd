"""IP address rules as column expressions (no Python worker in the plan).

The dotted-quad rules, which nearly all rows take, are single regular expressions inside the
generated code.  IPv6 needs several steps over one value; ``_let`` names each intermediate value
once, so the expression stays small, and the ``when`` around it keeps it off the common path.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowcast import fixed_values as fv

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
V4_PATTERN = rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"
_MAPPED = "0" * 20 + "ffff"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_ipv4(address: Column) -> Column:
    return address.rlike(V4_PATTERN)


def ipv4_number(address: Column) -> Column:
    """Dotted quad -> BIGINT; NULL for anything else."""
    parts = F.split(address, r"\.")
    value = reduce(lambda acc, i: acc * 256 + parts[i].cast("bigint"), range(1, 4), parts[0].cast("bigint"))
    return F.when(is_ipv4(address), value)


def ipv4_text(number: Column) -> Column:
    """BIGINT -> dotted quad."""
    octets = [F.shiftright(number.cast("bigint"), bits).bitwiseAND(F.lit(255)).cast("string") for bits in (24, 16, 8, 0)]
    return F.concat_ws(".", *octets)


def _undotted(text: Column) -> Column:
    """A dotted tail stands for the last two groups."""

    def rewrite(tail: Column) -> Column:
        def groups(n: Column) -> Column:
            return F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(F.lit(65535)))))

        return F.concat(F.left(text, F.length(text) - F.length(tail)), _let(ipv4_number(tail), groups))

    return F.when(text.contains("."), _let(F.regexp_extract(text, "([0-9.]+)$", 1), rewrite)).otherwise(text)


def _v6_groups(address: Column) -> Column:
    """Eight lower-case hex groups of an IPv6 text, NULL when it is not one."""
    empty = F.array().cast("array<string>")

    def side(half: Column) -> Column:
        return F.when(half == "", empty).otherwise(F.split(half, ":"))

    def fill(left: Column, right: Column) -> Column:
        missing = F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0))
        return F.concat(left, F.array_repeat(F.lit("0"), missing), right)

    def expand(halves: Column) -> Column:
        shortened = F.size(halves) == 2
        right = F.when(shortened, side(F.get(halves, F.lit(1)))).otherwise(empty)

        def combine(pair: Column) -> Column:
            given = F.size(pair["left"]) + F.size(pair["right"])
            fits = F.when(shortened, given <= 7).otherwise(given == 8)
            return F.when(fits & (F.size(halves) <= 2), fill(pair["left"], pair["right"]))

        return _let(F.struct(side(halves[0]).alias("left"), right.alias("right")), combine)

    def checked(groups: Column) -> Column:
        return F.when(F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$")), groups)

    def parse(scope: Column) -> Column:
        scope_fine = (F.size(scope) == 1) | ((F.size(scope) == 2) & (F.get(scope, F.lit(1)) != ""))
        halves = F.split(_let(F.lower(scope[0]), _undotted), "::")
        return F.when(scope_fine, _let(_let(halves, expand), checked))

    return _let(F.split(address, "%"), parse)


def _hex(groups: Column) -> Column:
    """32 hex digits, which sort like the address."""
    return F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")


def _v6_text(groups: Column) -> Column:
    """Shortest text: no leading zeros, the first longest run of two or more zero groups as ``::``."""

    def shorten(padded: Column) -> Column:
        """``padded`` is the full text between two colons, so that a run is found by plain search."""
        result = None
        for length in range(8, 1, -1):
            run = ":" + "0:" * length
            at = F.instr(padded, run)
            tail = F.substr(padded, at + len(run), F.length(padded) - at - len(run))
            text = F.concat(F.substr(padded, F.lit(2), at - 2), F.lit("::"), tail)
            result = F.when(at > 0, text) if result is None else result.when(at > 0, text)
        return result.otherwise(F.btrim(padded, F.lit(":")))

    full = F.concat(F.lit(":"), F.array_join(groups, ":"), F.lit(":"))
    return _let(F.regexp_replace(full, ":0+(?=[0-9a-f])", ":"), shorten)


def _embedded_v4(digits: Column) -> Column:
    return F.conv(F.substring(digits, 25, 8), 16, 10).cast("bigint")


def canonical_ip(address: Column) -> Column:
    """Canonical v4/v6 text, NULL when the text is no address."""

    def v6(groups: Column) -> Column:
        def text(digits: Column) -> Column:
            mapped = F.concat(F.lit("::ffff:"), _let(_embedded_v4(digits), ipv4_text))
            return F.when(digits.startswith(_MAPPED), mapped).otherwise(_v6_text(groups))

        return _let(_hex(groups), text)

    scope = F.regexp_extract(address, "(%.*)$", 1)
    return F.when(is_ipv4(address), address).when(
        address.contains(":"), F.concat(_let(_v6_groups(address), v6), scope)
    )


def decimal_ipv4(value: Column, fallback: str) -> Column:
    """Integer-valued text -> dotted quad; text that is no number, or is out of range, -> ``fallback``."""
    number = F.floor(value.try_cast("double"))
    in_range = number.between(0, 2**32 - 1)
    return F.when(in_range, ipv4_text(number)).otherwise(F.lit(fallback))


def _v4_pattern(networks: Iterable[str]) -> str:
    """One regular expression that matches the dotted quads inside the networks."""
    alternatives = []
    for network in map(ipaddress.ip_network, networks):
        octets, left = [], network.prefixlen
        for octet in network.network_address.packed:
            if left <= 0:
                break
            span = 1 << max(8 - left, 0)
            octets.append("(?:" + "|".join(str(octet + i) for i in range(span)) + ")")
            left -= 8
        alternatives.append(r"\.".join(octets) + (r"\." if len(octets) < 4 else "$"))
    return "^(?:" + "|".join(alternatives) + ")"


_PRIVATE_V4 = _v4_pattern(fv.PRIVATE_V4)
_PUBLIC_V4 = _v4_pattern(fv.PUBLIC_V4)


def _private_v4(address: Column) -> Column:
    return address.rlike(_PRIVATE_V4) & ~address.rlike(_PUBLIC_V4)


def _private_v6(address: Column) -> Column:
    def within(digits: Column, networks: tuple[str, ...]) -> Column:
        bounds = [ipaddress.ip_network(n) for n in networks]
        tests = [digits.between(f"{int(n[0]):032x}", f"{int(n[-1]):032x}") for n in bounds]
        return reduce(lambda a, b: a | b, tests)

    def test(digits: Column) -> Column:
        mapped = _let(ipv4_text(_embedded_v4(digits)), _private_v4)
        inside = within(digits, fv.PRIVATE_V6) & ~within(digits, fv.PUBLIC_V6)
        return F.when(digits.startswith(_MAPPED), mapped).otherwise(inside)

    return _let(_let(_v6_groups(address), _hex), test)


def is_private_ip(address: Column) -> Column:
    """True for addresses inside the private networks; NULL when the text is no address."""
    return F.when(is_ipv4(address), _private_v4(address)).when(address.contains(":"), _private_v6(address))


def is_private_flow(address: Column) -> Column:
    """``is_private_ip`` for addresses known to be canonical, as in stored flows: one pattern less per row."""
    return F.when(address.contains(":"), _private_v6(address)).otherwise(_private_v4(address))
