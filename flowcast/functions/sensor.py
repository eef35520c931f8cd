"""Rules of a sensor's connection log."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowcast.functions.rows import real_number


def present(text: Column) -> Column:
    """Text, or NULL for the log's spellings of "no value"."""
    return F.when(~text.isin("", "-"), text)


def whole(text: Column) -> Column:
    """Non-negative integer part; unreadable values count as 0."""
    return F.greatest(F.lit(0).cast("bigint"), F.coalesce(real_number(text).try_cast("bigint"), F.lit(0).cast("bigint")))


def optional_whole(text: Column) -> Column:
    return F.when(present(text).isNotNull(), whole(text))


def milliseconds(seconds: Column) -> Column:
    """Seconds -> whole milliseconds, truncated; NULL when there is none."""
    number = (real_number(present(seconds)) * 1000).try_cast("bigint")
    return F.when(number.isNotNull(), F.greatest(F.lit(0).cast("bigint"), number))


def history_flags(history: Column) -> Column:
    """Upper-case history letters -> flags; NULL when none is present."""
    parts = [
        F.when(history.contains(letter), flag)
        for letter, flag in (("S", "SYN"), ("A", "ACK"), ("F", "FIN"), ("R", "RST"), ("P", "PSH"))
    ]
    return F.nullif(F.concat_ws(",", *parts), F.lit(""))


def connection_state(state: Column) -> Column:
    name = F.upper(state)
    return (
        F.when(name.isin("S0", "SH", "SHR"), "SYN_NO_ACK")
        .when(name.startswith("RST") | (name == "REJ"), "RST_ABORT")
        .otherwise("CLEAN")
    )
