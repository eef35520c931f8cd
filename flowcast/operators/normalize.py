"""Raw text rows -> flows, and the rows that are refused."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowcast import fixed_values as fv
from flowcast.functions import rows
from flowcast.functions.addresses import V4_PATTERN

# Columns of a raw row -> columns of a flow, each with its rule.
_RULES = {
    "observed_at": ("timestamp", rows.event_time),
    "src_ip": ("src_ip", rows.address),
    "dst_ip": ("dst_ip", rows.address),
    "src_port": ("src_port", rows.port),
    "dst_port": ("dst_port", rows.port),
    "protocol": ("protocol", rows.protocol),
    "packet_count": ("packets", rows.count),
    "byte_count": ("bytes", rows.count),
    "duration_ms": ("duration_ms", rows.duration),
    "tcp_flags": ("flags", rows.flags),
    "failed_connection": ("failed_conn_info", rows.failed_connection),
}
FLOW_COLUMNS = tuple(_RULES)


def parse_flows(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """All rows with flow columns, ``extra`` (the other non-empty columns) and ``problems``.

    ``keep`` names columns that are passed through untouched, e.g. a source id.
    """
    mapped = set(fv.REQUIRED_COLUMNS) | set(fv.OPTIONAL_COLUMNS)
    others = [c for c in raw.columns if c not in mapped and c not in keep]
    fields = {name: F.col(f"`{name}`") for name in keep}
    return _judged(raw, lambda parsed: {**fields, **parsed, "extra": _extras(others)})


def _judged(raw: DataFrame, output: Callable[[dict[str, Column]], dict[str, Column]]) -> DataFrame:
    """Parse each value once, then judge the row from the values.

    The output leaves a generator, so a later filter on ``problems`` stays above it instead of
    being pushed below and parsing every row a second time.
    """
    present = set(raw.columns)
    texts = {
        f"_{text}_text": rows.stripped(F.col(text)) if text in present else F.lit(None).cast("string")
        for text, _ in _RULES.values()
    }
    rules = {name: rule(F.col(f"_{text}_text")) for name, (text, rule) in _RULES.items()}
    valued = raw.withColumns(texts).withColumns({f"_{name}": rule.value for name, rule in rules.items()})
    values = {name: F.col(f"_{name}") for name in rules}
    problems = F.array_compact(
        F.array(*[F.when(rule.broken(values[name]), _RULES[name][0]) for name, rule in rules.items()])
    )
    columns = {**output(values), "problems": problems}
    return valued.select(F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _extras(names: Sequence[str]) -> Column:
    if not names:
        return F.create_map().cast("map<string,string>")
    entries = F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"`{n}`").cast("string").alias("value")) for n in names])
    filled = F.filter(entries, lambda e: e["value"].isNotNull() & (e["value"] != ""))
    return F.map_from_entries(filled)


def normalize_flows(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The valid rows.  A row that breaks any rule is left out, never fatal."""
    return parse_flows(raw, keep).filter(F.size("problems") == 0).drop("problems")


def quarantine_flows(raw: DataFrame) -> DataFrame:
    """The refused rows as they came, with the columns that broke a rule."""
    as_came = {c: F.col(f"`{c}`") for c in raw.columns}
    return _judged(raw, lambda _: as_came).filter(F.size("problems") > 0)


def load_counts(parsed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total, accepted and skipped rows of ``parse_flows`` output."""
    accepted = F.count_if(F.size("problems") == 0)
    return parsed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_rows"),
        accepted.alias("accepted_rows"),
        (F.count(F.lit(1)) - accepted).alias("skipped_rows"),
    )


_FLAG = "(SYN|ACK|FIN|RST|PSH|URG|ECE|CWE)"
_V6_SHAPE = r"^([0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}$"
_STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?(Z|[+-][0-9]{2}:[0-9]{2})$"


def flow_contract_violations(labeled: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Labelled 12-column rows that break the stricter exchange contract, with the columns at fault."""
    labels = ("BENIGN", *fv.LABEL_FAMILIES)

    def address(name: str) -> Column:
        return F.col(name).rlike(V4_PATTERN) | F.col(name).rlike(_V6_SHAPE)

    def whole(name: str, low: int, high: int | None = None) -> Column:
        number = rows.whole_number(rows.stripped(F.col(name).cast("string")))
        return (number >= low) if high is None else number.between(low, high)

    fine = {
        "src_ip": address("src_ip"),
        "dst_ip": address("dst_ip"),
        "src_port": whole("src_port", 0, 65535),
        "dst_port": whole("dst_port", 0, 65535),
        "protocol": F.col("protocol").isin(*fv.PROTOCOLS),
        "timestamp": F.col("timestamp").rlike(_STAMP),
        "packets": whole("packets", 1),
        "bytes": whole("bytes", 0),
        "duration_ms": rows.real_number(F.col("duration_ms").cast("string")) >= 0,
        "flags": F.col("flags").rlike(f"^(NONE|{_FLAG}(,{_FLAG})*)$"),
        "failed_conn_info": F.col("failed_conn_info").isin(*fv.CONNECTION_STATES),
        "label": F.col("label").isin(*labels),
    }
    violations = F.array_compact(
        F.array(*[F.when(~F.coalesce(condition, F.lit(False)), name) for name, condition in fine.items()])
    )
    return labeled.select(*keep, violations.alias("violations")).filter(F.size("violations") > 0)


def distinct_flows(flows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that repeat in every given column once.  Opt-in: real repeats feed ``retry_rate``."""
    return flows.dropDuplicates(list(columns) if columns else None)
