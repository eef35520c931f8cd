"""Rules of an uploaded flow row.

Every rule takes text that ``stripped`` has cleaned and gives a value and an "invalid" test.
Jobs compute the stripped texts, the values and the tests in separate projections, because an
expression that mentions a costly value three times would compute it three times.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowcast import fixed_values as fv
from flowcast.functions.addresses import canonical_ip

_BLANKS = " \t\n\r\f\x0b"
_DECIMAL_CHARACTERS = "^[0-9eE.+-]+$"
_EPOCH = r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?(Z|[+-][0-9]{2}(:?[0-9]{2})?)$"
_ISO_BASIC = r"^[0-9]{8}T[0-9]{6}(Z|[+-][0-9]{4})$"
_FLAG = "(?:" + "|".join(fv.TCP_FLAGS) + ")"
_FLAG_LIST = rf"^[\s,]*{_FLAG}(?:\s*,[\s,]*{_FLAG})*[\s,]*$"
_LAST_SECOND = 253402300800  # year 10000, the end of the supported calendar


class Rule(NamedTuple):
    """``value`` of a field, and the test that tells from the computed value whether the row is invalid."""

    value: Column
    broken: Callable[[Column], Column]

    @property
    def invalid(self) -> Column:
        return self.broken(self.value)


def stripped(text: Column) -> Column:
    """Text without outer blanks; empty becomes NULL."""
    return F.nullif(F.btrim(text, F.lit(_BLANKS)), F.lit(""))


def _required(text: Column, value: Column) -> Rule:
    return Rule(value, lambda v: v.isNull())


def _optional(text: Column, value: Column) -> Rule:
    return Rule(value, lambda v: v.isNull() & text.isNotNull())


def whole_number(text: Column) -> Column:
    """Integer text -> BIGINT; ``18.0`` and other spellings are NULL."""
    return text.try_cast("bigint")


def real_number(text: Column) -> Column:
    """Decimal text -> DOUBLE.  The pattern keeps out ``1d``, ``nan`` and ``inf``, which a plain cast accepts."""
    return F.when(text.rlike(_DECIMAL_CHARACTERS), text.try_cast("double"))


def epoch_time(seconds: Column) -> Column:
    """Epoch seconds (DOUBLE) -> TIMESTAMP, microseconds rounded half-even like the input's decimal text."""
    whole = F.floor(seconds)
    micros = F.bround((seconds - whole) * 1e6).cast("bigint")
    in_range = seconds < F.lit(float(_LAST_SECOND))
    return F.when(in_range, F.timestamp_micros(whole.cast("bigint") * 1000000 + micros))


def iso_time(text: Column) -> Column:
    """ISO-8601 text that carries a zone -> TIMESTAMP; text without a zone is NULL."""
    # The usual spellings are read as they are; a comma or an offset without colon is rewritten first.
    usual = text.endswith("Z") | (F.substring(text, -3, 1) == ":")
    colon = F.concat(F.left(text, F.length(text) - 2), F.lit(":"), F.right(text, F.lit(2)))
    rewritten = F.when(usual, text).when(text.rlike("[+-][0-9]{4}$"), colon).otherwise(text)
    dotted = F.when(text.contains(","), F.replace(rewritten, F.lit(","), F.lit("."))).otherwise(rewritten)
    # A time without seconds (the zone starts at the 17th character) gets them.
    timed = F.when(F.substring(text, 17, 1) == ":", dotted).otherwise(
        F.concat(F.left(dotted, F.lit(16)), F.lit(":00"), F.substring(dotted, 17, 6))
    )
    basic = F.when(text.rlike(_ISO_BASIC), F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmssXX")))
    return F.when(text.rlike(_ISO), timed.try_cast("timestamp")).otherwise(basic)


def event_time(text: Column) -> Rule:
    """Epoch seconds or zoned ISO text -> TIMESTAMP."""
    epoch = ~text.contains(":") & text.rlike(_EPOCH)
    return _required(text, F.when(epoch, epoch_time(text.try_cast("double"))).otherwise(iso_time(text)))


def address(text: Column) -> Rule:
    return _required(text, canonical_ip(text))


def protocol(text: Column) -> Rule:
    name = F.upper(text)
    value = F.when(name.isin(*fv.PROTOCOLS), name)
    for number, known in fv.PROTOCOL_NUMBERS.items():
        value = value.when(name == number, F.lit(known))
    return _required(text, value.when(text.isNotNull(), F.lit("OTHER")))


def port(text: Column) -> Rule:
    number = whole_number(text)
    return _optional(text, F.when(number.between(0, 65535), number.cast("int")))


def count(text: Column) -> Rule:
    number = whole_number(text)
    return _required(text, F.when(number >= 0, number))


def duration(text: Column) -> Rule:
    """Milliseconds, rounded half-even; the sign is tested after rounding."""
    rounded = F.bround(real_number(text)).cast("bigint")
    return _optional(text, F.when(rounded >= 0, rounded))


def flags(text: Column) -> Rule:
    """Comma list -> upper-cased list without repeats; NONE and empty -> NULL; an unknown token is invalid."""
    text = F.upper(text)
    compact = F.btrim(F.regexp_replace(text, r"\s*,[\s,]*", ","), F.lit(","))
    value = F.when(text.rlike(_FLAG_LIST), F.array_join(F.array_distinct(F.split(compact, ",")), ","))
    return Rule(value, lambda v: v.isNull() & F.coalesce(text != "NONE", F.lit(False)))


def failed_connection(text: Column) -> Rule:
    """Failed words -> true, clean words -> false, not-applicable words and empty -> NULL."""
    word = F.lower(text)
    value = F.when(word.isin(*fv.FAILED_WORDS), True).when(word.isin(*fv.CLEAN_WORDS), False)
    known = word.isin(*fv.FAILED_WORDS, *fv.CLEAN_WORDS, *fv.NOT_APPLICABLE_WORDS)
    return Rule(value, lambda v: v.isNull() & word.isNotNull() & ~known)
