"""Rules of the wide labelled-dataset CSVs (one row per flow, about 85 columns)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted time formats, day-first before month-first.
TIME_FORMATS = (
    "d/M/yyyy H:mm:ss",
    "d/M/yyyy h:mm:ss a",
    "d/M/yyyy H:mm",
    "d/M/yyyy h:mm a",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy h:mm:ss a",
    "M/d/yyyy H:mm",
    "M/d/yyyy h:mm a",
    "yyyy-M-d H:m:s",
    "yyyy-M-d H:m:s.[SSSSSS][SSSSS][SSSS][SSS][SS][S]",
    "yyyy-M-d'T'H:m:s.[SSSSSS][SSSSS][SSSS][SSS][SS][S]'Z'",
    "yyyy-M-d'T'H:m:s'Z'",
)


def clean_header(name: str) -> str:
    """Header text without byte-order mark, control characters and repeated blanks."""
    text = unicodedata.normalize("NFKD", name).lstrip("﻿")
    printable = "".join(" " if ch == "\xa0" else ch for ch in text if ch == "\xa0" or unicodedata.category(ch) != "Cc")
    return " ".join(printable.split())


def unique_headers(names: Iterable[str]) -> list[str]:
    """Cleaned headers; repeats of ``x`` (also written ``x.1``) become ``x``, ``x.1``, ``x.2``..."""
    repeats: dict[str, int] = {}
    result = []
    for name in names:
        base = re.sub(r"\.\d+$", "", clean_header(name))
        repeats[base] = repeats.get(base, -1) + 1
        result.append(f"{base}.{repeats[base]}" if repeats[base] else base)
    return result


def clean_numeric(value: Column) -> Column:
    """DOUBLE; infinities, NaN, blanks and text junk become 0."""
    text = F.lower(F.btrim(value.cast("string"), F.lit(" \t\n\r\f\x0b")))
    number = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"), text.try_cast("double"))
    finite = F.abs(number) < float("inf")
    return F.when(finite, number).otherwise(F.lit(0.0))


def whole(value: Column) -> Column:
    """Cleaned number, truncated to BIGINT."""
    return clean_numeric(value).try_cast("bigint")


def duration_ms(micros: Column) -> Column:
    return F.greatest(F.lit(0.0), clean_numeric(micros) / 1000.0)


def packet_total(forward: Column, backward: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), whole(forward) + whole(backward))


def byte_total(forward: Column, backward: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), whole(forward) + whole(backward))


def clipped_port(value: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(65535).cast("bigint"), whole(value))).cast("int")


def protocol(value: Column) -> Column:
    text = F.btrim(value.cast("string"))
    return (
        F.when(text.isNull() | text.isin("6", "6.0", "TCP", "tcp"), "TCP")
        .when(text.isin("17", "17.0", "UDP", "udp"), "UDP")
        .when(text.isin("1", "1.0", "ICMP", "icmp"), "ICMP")
        .otherwise("OTHER")
    )


def flexible_time(value: Column) -> Column:
    """First format that reads the text, as UTC, whole seconds; NULL when none does."""
    text = F.btrim(F.translate(value, "\xa0", " "))
    zoned = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T.*(Z|[+-][0-9]{2}:?[0-9]{2})$")
    iso = F.when(zoned, text.try_cast("timestamp"))
    # The slash and dash families exclude each other, so a text is tried only against its own formats.
    upper = F.upper(text)
    slashed = F.coalesce(*[F.try_to_timestamp(upper, F.lit(f)) for f in TIME_FORMATS[:8]])
    dashed = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS[8:]])
    parsed = F.coalesce(iso, F.when(text.contains("/"), slashed).when(text.contains("-"), dashed))
    return F.date_trunc("second", parsed)


def synthesize_flags(counts: dict[str, Column]) -> Column:
    """Flag-count columns -> comma list in a fixed order, NONE when no flag is set."""

    def seen(*names: str) -> Column:
        present = [whole(counts[name]) > 0 for name in names if name in counts]
        hit = F.lit(False)
        for condition in present:
            hit = hit | condition
        return hit

    parts = [
        F.when(seen("SYN Flag Count"), "SYN"),
        F.when(seen("ACK Flag Count"), "ACK"),
        F.when(seen("FIN Flag Count"), "FIN"),
        F.when(seen("RST Flag Count"), "RST"),
        F.when(seen("PSH Flag Count", "Fwd PSH Flags", "Bwd PSH Flags"), "PSH"),
        F.when(seen("URG Flag Count", "Fwd URG Flags", "Bwd URG Flags"), "URG"),
        F.when(seen("ECE Flag Count"), "ECE"),
        F.when(seen("CWE Flag Count"), "CWE"),
    ]
    joined = F.concat_ws(",", *parts)
    return F.when(joined == "", "NONE").otherwise(joined)


def classify_failed(
    protocol_name: Column, rst: Column, syn: Column, ack: Column, window_fwd: Column, window_bwd: Column, milliseconds: Column
) -> Column:
    """Health of a connection; the first matching rule decides."""
    n = clean_numeric
    return (
        F.when(F.upper(protocol_name) != "TCP", "NA")
        .when(n(rst) > 0, "RST_ABORT")
        .when((n(syn) > 0) & (n(ack) == 0), "SYN_NO_ACK")
        .when((n(window_bwd) == 0) & (n(window_fwd) > 0) & (milliseconds > 1000.0), "ZERO_WIN")
        .otherwise("CLEAN")
    )
