"""Queries of the row rules, lookups and contract checks, each over the whole table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from checks.testbed import events, flows, flows_sql, q6, r6
from flowcast import fixed_values as fv
from flowcast.functions import addresses, dataset, labels, risk, rows, sensor
from flowcast.operators import normalize

EV = "WITH ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, " \
     "CAST(floor(value * 100) AS BIGINT) AS cents, epoch_us(ts) AS us FROM events)"


def pick(values: list, by: str = "event_id") -> Column:
    """One of the texts per row."""
    items = [F.lit(v).cast("string") for v in values]
    return F.get(F.array(*items), (F.col(by) % len(values)).cast("int"))


def pick_sql(values: list, by: str = "event_id") -> str:
    items = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{items}])[({by} % {len(values)}) + 1]"


def sql_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def sql_map(table: dict, key: str, default: str = "NULL") -> str:
    cases = " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in table.items())
    return f"CASE {key} {cases} ELSE {default} END"


# Raw texts, made from the event so that every row differs.
def raw_time() -> Column:
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    seconds = F.unix_seconds("ts").cast("string")
    kind = F.col("event_id") % 7
    return (
        F.when(kind == 0, F.concat(stamp, F.lit("Z")))
        .when(kind == 1, seconds)
        .when(kind == 2, F.concat(seconds, F.lit(".5")))
        .when(kind == 3, stamp)
        .when(kind == 4, F.lit("bad-time"))
        .when(kind == 5, F.concat(stamp, F.lit("+05:30")))
        .otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("-02:00")))
    )


RAW_TIME = """CASE event_id % 7 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' WHEN 1 THEN CAST(us // 1000000 AS VARCHAR)
  WHEN 2 THEN CAST(us // 1000000 AS VARCHAR) || '.5' WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') WHEN 4 THEN 'bad-time'
  WHEN 5 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+05:30' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || '-02:00' END"""
TIME_SQL = """CASE WHEN regexp_full_match(t, '[0-9]+[.]?[0-9]*') THEN CAST(round(CAST(t AS DOUBLE) * 1000000) AS BIGINT)
  WHEN regexp_matches(t, '(Z|[+-][0-9]{2}:[0-9]{2})$') THEN epoch_us(TRY_CAST(replace(t, 'Z', '+00:00') AS TIMESTAMPTZ)) END"""

ADDRESSES = ["10.0.0.1", "01.2.3.4", "256.1.1.1", "8.8.4.4", "not-an-ip", "", "1.2.3", "192.168.10.5 ", "2001:db8::1", "fe80::1", "1.2.3.4.5", None]
PROTOCOLS = ["tcp", "TCP", "6", "17", "1", "UDP", "icmp", "SCTP", " tcp ", "other", "6.0", "", None]
PORTS = ["80", "65535", "65536", "-1", "", None, "http", " 443 ", "80.0", "+22"]
COUNTS = ["18", "0", "-5", "18.0", "", "abc", " 7 ", "9000000000"]
DURATIONS = ["1250.5", "1251.5", "0", "-0.4", "-0.6", "", None, "abc", "1e3", "inf", "nan", "12d"]
FLAGS = ["SYN,ACK", "psh,ack", "NONE", "", None, "BOGUS", "SYN, syn ,FIN", "SYN,,ACK", ",", "none", "ECE,CWE,URG"]
FAILED = ["CLEAN", "SYN_NO_ACK", "rst_abort", "ZERO_WIN", "NA", "n/a", "", None, "true", "0", "yes", "CORRUPT", "None", "S0"]
HISTORIES = ["ShADadFf", "S", "D", "", None, "ShAdDaR", "Pp", "sarf", "^dtt"]
CONN_STATES = ["SF", "S0", "sh", "SHR", "REJ", "RSTO", "rstr", "OTH", "", None]
JUNK = ["Infinity", "-inf", "NaN", "", None, "12.5", "abc", "-3", "1e3", "+inf", "null"]
LABELS = list(fv.LABEL_SPELLINGS) + ["Botnet - Attempted", "DoS Hulk - attempted", "PORTSCAN", "unknown thing", None, "Bot-ATTEMPTED", " DDoS "]


def query_event_time(spark, folder):
    df = events(spark, folder).withColumn("t", raw_time())
    rule = rows.event_time(rows.stripped(F.col("t")))
    return df.select("event_id", F.unix_micros(rule.value).alias("micros"), rule.invalid.alias("invalid"))


def _rule_query(values, rule, out, cast=None):
    def run(spark, folder):
        outcome = rule(rows.stripped(pick(values)))
        value = outcome.value.cast(cast) if cast else outcome.value
        return events(spark, folder).select("event_id", value.alias(out), outcome.invalid.alias("invalid"))

    return run


def query_valid_ip(spark, folder):
    rule = rows.address(rows.stripped(pick(ADDRESSES)))
    return events(spark, folder).select("event_id", rule.value.alias("address"), rule.invalid.alias("invalid"))


V4 = "([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
VALID_IP_SQL = f"""{EV} SELECT event_id, a AS address, a IS NULL AS invalid FROM (SELECT event_id,
  CASE WHEN regexp_full_match(trim(t), '{V4}([.]{V4}){{3}}') OR t IN ('2001:db8::1', 'fe80::1') THEN trim(t) END AS a
  FROM (SELECT event_id, {pick_sql(ADDRESSES)} AS t FROM ev))"""


def numbers_to_ip(by: str) -> Column:
    return ((F.col(by) * 2654435761) % 4294967296).cast("bigint")


def query_decimal_ipv4(spark, folder):
    number = numbers_to_ip("event_id")
    text = F.when(F.col("event_id") % 9 == 0, "-1").when(F.col("event_id") % 9 == 1, "junk").otherwise(number.cast("string"))
    return events(spark, folder).select("event_id", addresses.decimal_ipv4(text, "192.168.10.50").alias("address"))


NUMBER_SQL = "((event_id * 2654435761) % 4294967296)"
OCTETS_SQL = "((n >> 24) & 255) || '.' || ((n >> 16) & 255) || '.' || ((n >> 8) & 255) || '.' || (n & 255)"


# Every row gets one address next to a block boundary, spread over the blocks, and one scattered address.
EDGES = ["10.0.0.0", "9.255.255.255", "10.255.255.255", "11.0.0.0", "172.15.255.255", "172.16.0.0", "172.31.255.255", "172.32.0.0",
         "192.168.0.0", "192.169.0.0", "127.0.0.1", "169.254.1.1", "192.0.0.9", "192.0.0.10", "192.0.0.11", "192.0.0.170", "192.0.2.1",
         "198.18.0.1", "198.20.0.0", "198.51.100.7", "203.0.113.9", "239.255.255.255", "240.0.0.0", "255.255.255.255", "0.1.2.3", "1.0.0.0"]


def query_is_private(spark, folder):
    scattered = addresses.ipv4_text(numbers_to_ip("event_id"))
    address = F.when(F.col("event_id") % 2 == 0, scattered).otherwise(pick(EDGES))
    df = events(spark, folder).select("event_id", address.alias("address"))
    return df.withColumn("is_private", addresses.is_private_ip(F.col("address")))


PRIVATE_SQL = """((n BETWEEN 0 AND 16777215) OR (n BETWEEN 167772160 AND 184549375) OR (n BETWEEN 2130706432 AND 2147483647)
  OR (n BETWEEN 2851995648 AND 2852061183) OR (n BETWEEN 2886729728 AND 2887778303)
  OR (n BETWEEN 3221225472 AND 3221225727 AND n NOT IN (3221225481, 3221225482)) OR (n BETWEEN 3221225984 AND 3221226239)
  OR (n BETWEEN 3232235520 AND 3232301055) OR (n BETWEEN 3323068416 AND 3323199487) OR (n BETWEEN 3325256704 AND 3325256959)
  OR (n BETWEEN 3405803776 AND 3405804031) OR n >= 4026531840)"""


def query_map_protocol(spark, folder):
    raw = pick(PROTOCOLS)
    rule = rows.protocol(rows.stripped(raw))
    return events(spark, folder).select(
        "event_id", rule.value.alias("protocol"), rule.invalid.alias("invalid"), dataset.protocol(raw).alias("dataset_protocol")
    )


def query_parse_port(spark, folder):
    rule = rows.port(rows.stripped(pick(PORTS)))
    return events(spark, folder).select(
        "event_id", rule.value.alias("port"), rule.invalid.alias("invalid"), dataset.clipped_port(pick(PORTS)).alias("clipped")
    )


def query_parse_counts(spark, folder):
    rule = rows.count(rows.stripped(pick(COUNTS)))
    forward, backward = pick(COUNTS), pick(JUNK)
    return events(spark, folder).select(
        "event_id", rule.value.alias("count"), rule.invalid.alias("invalid"),
        dataset.packet_total(forward, backward).alias("packets"), dataset.byte_total(forward, backward).alias("bytes"),
    )


def query_parse_duration(spark, folder):
    rule = rows.duration(rows.stripped(pick(DURATIONS)))
    micros = (F.col("cents") * 37 - 5000).cast("string")
    return events(spark, folder).select(
        "event_id", rule.value.alias("duration_ms"), rule.invalid.alias("invalid"),
        r6(dataset.duration_ms(micros)).alias("dataset_ms"),
        sensor.milliseconds((F.col("cents") / 1000).cast("string")).alias("sensor_ms"),
    )


def query_synthesize_flags(spark, folder):
    names = ["SYN Flag Count", "ACK Flag Count", "FIN Flag Count", "RST Flag Count", "PSH Flag Count", "Fwd PSH Flags",
             "Bwd PSH Flags", "URG Flag Count", "Fwd URG Flags", "Bwd URG Flags", "ECE Flag Count", "CWE Flag Count"]
    counts = {n: ((F.floor(F.col("event_id") / 2**i) % 2) * (F.col("k") % 3)).cast("string") for i, n in enumerate(names)}
    return events(spark, folder).select("event_id", dataset.synthesize_flags(counts).alias("flags"))


def _bit(i: int) -> str:
    return f"((event_id // {2**i}) % 2) * (k % 3) > 0"


SYNTH_SQL = EV + """ SELECT event_id, CASE WHEN f = '' THEN 'NONE' ELSE f END AS flags FROM (SELECT event_id, concat_ws(',', """ + ", ".join(
    f"CASE WHEN {' OR '.join(_bit(i) for i in bits)} THEN '{name}' END"
    for name, bits in (("SYN", [0]), ("ACK", [1]), ("FIN", [2]), ("RST", [3]), ("PSH", [4, 5, 6]), ("URG", [7, 8, 9]), ("ECE", [10]), ("CWE", [11]))
) + ") AS f FROM ev)"


def query_classify_failed(spark, folder):
    e, k, c = F.col("event_id"), F.col("k"), F.col("cents")
    state = dataset.classify_failed(
        pick(["TCP", "UDP", "tcp"]), (k % 5 == 0).cast("int"), (k % 2).cast("int"), (e % 2).cast("int"),
        (k % 7).cast("string"), (e % 5).cast("string"), (c * 3).cast("double"),
    )
    return events(spark, folder).select("event_id", state.alias("state"))


CLASSIFY_SQL = EV + """ SELECT event_id, CASE WHEN upper((['TCP', 'UDP', 'tcp'])[(event_id % 3) + 1]) <> 'TCP' THEN 'NA'
  WHEN k % 5 = 0 THEN 'RST_ABORT' WHEN k % 2 > 0 AND event_id % 2 = 0 THEN 'SYN_NO_ACK'
  WHEN event_id % 5 = 0 AND k % 7 > 0 AND cents * 3 > 1000 THEN 'ZERO_WIN' ELSE 'CLEAN' END AS state FROM ev"""


def query_canonical_label(spark, folder):
    raw = pick(LABELS)
    known = labels.dataset_label_or_null(raw)
    return events(spark, folder).select(
        "event_id", labels.dataset_label(raw).alias("label"), known.isNull().alias("unknown_label"),
        labels.timeline_label(raw).alias("timeline_label"),
    )


def _label_sql() -> str:
    table = sql_map(fv.LABEL_SPELLINGS, "c")
    lower = sql_map(fv.LABEL_SPELLINGS, "lower(c)")
    folded = sql_map({k.lower(): v for k, v in fv.LABEL_SPELLINGS.items()}, "lower(trim(t))")
    exact = sql_map(fv.LABEL_SPELLINGS, "trim(t)")
    return f"""{EV} SELECT event_id, coalesce(known, 'BENIGN') AS label, known IS NULL AS unknown_label, timeline_label FROM (
      SELECT event_id, coalesce({table}, {lower}) AS known, coalesce({exact}, {folded}) AS timeline_label FROM (
        SELECT event_id, t, regexp_replace(trim(replace(replace(t, chr(150), '-'), '–', '-')), '\\s*-\\s*attempted$', '', 'i') AS c
        FROM (SELECT event_id, {pick_sql(LABELS)} AS t FROM ev)))"""


NAMES = ["BENIGN", *fv.LABEL_FAMILIES, "FTP-Patator", "Web Attack", "DDoS attack", "Bot", "benign ", "other", "Port Scan", "portscan"]


def query_label_family(spark, folder):
    return events(spark, folder).select("event_id", labels.label_family(pick(NAMES)).alias("family"))


def query_label_stage(spark, folder):
    stage = labels.label_stage(pick(NAMES))
    return events(spark, folder).select("event_id", stage.alias("stage"), labels.stage_name(stage).alias("stage_name"))


def _stage_sql() -> str:
    family = sql_map(fv.LABEL_FAMILIES, "trim(t)")
    by_family = sql_map(fv.FAMILY_STAGES, "fam")
    names = ", ".join(f"'{s}'" for s in fv.STAGES)
    return f"""{EV} SELECT event_id, stage, ([{names}])[stage + 1] AS stage_name FROM (SELECT event_id,
      CASE WHEN upper(trim(t)) = 'BENIGN' THEN 0 WHEN fam IS NOT NULL THEN {by_family}
        WHEN w LIKE '%portscan%' THEN 1
        WHEN w LIKE '%patator%' OR w LIKE '%web!_%' ESCAPE '!' OR w LIKE '%heartbleed%' THEN 2
        WHEN w LIKE '%infiltration%' THEN 3 WHEN w LIKE '%bot%' THEN 4 WHEN w LIKE '%dos%' THEN 5 ELSE 0 END AS stage
      FROM (SELECT event_id, t, {family} AS fam, replace(replace(lower(trim(t)), ' ', '_'), '-', '_') AS w
            FROM (SELECT event_id, {pick_sql(NAMES)} AS t FROM ev)))"""


STAGE_TEXTS = [*fv.STAGES, "Unknown stage", None]


def query_stage_attack_type(spark, folder):
    return events(spark, folder).select("event_id", labels.stage_attack_type(pick(STAGE_TEXTS)).alias("attack_type"))


def query_stage_candidates(spark, folder):
    df = events(spark, folder).select("event_id", pick(STAGE_TEXTS).alias("stage"))
    listed = F.transform(labels.stage_candidates(F.col("stage")), lambda c: F.concat_ws(":", c["label"], c["family"], c["tactic"], c["technique_id"], c["technique"]))
    return df.select("event_id", F.array_join(listed, ";").alias("candidates"))


def _candidates_sql() -> str:
    cases = []
    for stage, families in fv.STAGE_FAMILIES.items():
        text = ";".join(":".join(row) for row in fv.ATTACK_REFERENCE if row[1] in families)
        cases.append(f"WHEN '{stage}' THEN '{text}'")
    return f"{EV} SELECT event_id, CASE {pick_sql(STAGE_TEXTS)} {' '.join(cases)} ELSE '' END AS candidates FROM ev"


def query_risk_band(spark, folder):
    score = F.col("cents") % 1001 / 10.0
    return events(spark, folder).select("event_id", risk.risk_level(score).alias("level"), risk.risk_progression(score).alias("progression"))


RISK_SQL = EV + """ SELECT event_id, CASE WHEN s < 20 THEN 'low' WHEN s < 50 THEN 'medium' WHEN s < 75 THEN 'high' ELSE 'critical' END AS level,
  CASE WHEN s < 20 THEN 'S0_BENIGN_BASELINE' WHEN s < 50 THEN 'S1_RECON_PRECURSOR' WHEN s < 75 THEN 'S2_WEAPONIZATION_ESCALATION'
    ELSE 'S3_ACTIVE_PEAK' END AS progression FROM (SELECT event_id, (cents % 1001) / 10.0 AS s FROM ev)"""


# A raw upload: every column draws its text from a list of another length, so all combinations occur.
UPLOAD = {
    "src_ip": (["10.44.3.2", "10.0.0.7", "203.0.113.20", "2001:db8::1", "172.16.0.9", "192.168.77.8", "198.51.100.1", "192.0.2.9", "198.51.100.44", "10.1.1.1", "bad"]),
    "dst_ip": (["203.0.113.206", "10.0.0.50", "192.168.77.50", "192.0.2.8", "fe80::1", "198.51.100.140", "192.168.77.51", "10.0.0.1", "256.0.0.1"]),
    "src_port": (["49152", "51204", "", None, "50000", "1024", "65536", "33000", "40000", "41000", "42000", "43000", "44000"]),
    "dst_port": (["443", "53", "80", "22", None, "8080", "-1", "3389", "445", "21", "25", "110", "143", "993", "995", "587"]),
    "protocol": (["TCP", "17", "udp", "6", "SCTP", "icmp", "tcp"]),
    "packets": (["18", "2", "12", "24", "0", "18.0", "7", "9", "11", "13", "15", "17", "19", "21", "23", "25", "27"]),
    "bytes": (["4820", "148", "2400", "14200", "0", "-5", "100", "200", "300", "400", "500", "600", "700", "800", "900", "1000", "1100", "1200", "1300"]),
    "duration_ms": (["1250.5", "15.2", "", "450.0", None, "0.4", "99.9", "abc", "100", "200", "300", "400", "500", "600", "700", "800", "900", "1", "2", "3", "4", "5", "6"]),
    "flags": (["SYN,ACK", "NONE", "psh,ack", "ACK", None, "BOGUS", "FIN", "RST", "SYN", "URG,ECE", "syn", "ack", "fin", "rst", "psh", "urg", "ece", "cwe", "NONE", "ACK,ACK", "SYN", "ACK", "FIN", "RST", "PSH"]),
    "failed_conn_info": (["CLEAN", "NA", "SYN_NO_ACK", "RST_ABORT", None, "CORRUPT", "clean", "na", "1", "0", "yes", "no", "true", "false", "ZERO_WIN", "n/a", "null", "none", "CLEAN", "CLEAN", "CLEAN", "CLEAN", "CLEAN", "CLEAN", "NA", "NA", "NA", "NA", "NA"]),
    "label": (["BENIGN", "PortScan", ""]),
}


def upload(spark, folder):
    e = events(spark, folder)
    time = F.when(F.col("event_id") % 31 == 0, "bad-time").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")))
    texts = [pick(values, "mix").alias(name) for name, values in UPLOAD.items()]
    mixed = e.withColumn("mix", F.col("event_id") * 7 + F.col("k") * 131)
    return mixed.select("event_id", time.alias("timestamp"), *texts)


UPLOAD_CTE = EV + ", raw AS (SELECT event_id, CASE WHEN event_id % 31 = 0 THEN 'bad-time' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END AS time_text, us // 1000 * 1000 AS ms_us, " + ", ".join(
    f"{pick_sql(values, '(event_id * 7 + k * 131)')} AS {name}" for name, values in UPLOAD.items()
) + " FROM ev)"

_IP_OK = "(regexp_full_match({c}, '" + f"{V4}([.]{V4}){{{{3}}}}" + "') OR {c} IN ('2001:db8::1', 'fe80::1'))"
PARSED_CTE = UPLOAD_CTE + f""", parsed AS (SELECT event_id,
  CASE WHEN time_text <> 'bad-time' THEN ms_us END AS observed_us,
  CASE WHEN {_IP_OK.format(c='src_ip')} THEN src_ip END AS src_ip,
  CASE WHEN {_IP_OK.format(c='dst_ip')} THEN dst_ip END AS dst_ip,
  TRY_CAST(nullif(src_port, '') AS INTEGER) AS sp, src_port AS sp_text,
  TRY_CAST(nullif(dst_port, '') AS INTEGER) AS dp, dst_port AS dp_text,
  CASE WHEN upper(protocol) IN ('TCP', '6') THEN 'TCP' WHEN upper(protocol) IN ('UDP', '17') THEN 'UDP'
    WHEN upper(protocol) IN ('ICMP', '1') THEN 'ICMP' ELSE 'OTHER' END AS protocol,
  CASE WHEN regexp_full_match(packets, '[0-9]+') THEN CAST(packets AS BIGINT) END AS packet_count,
  CASE WHEN regexp_full_match(bytes, '[0-9]+') THEN CAST(bytes AS BIGINT) END AS byte_count,
  nullif(duration_ms, '') AS d_text, CAST(round_even(TRY_CAST(nullif(duration_ms, '') AS DOUBLE), 0) AS BIGINT) AS duration_ms,
  upper(flags) AS f_text,
  CASE WHEN upper(flags) NOT IN ('NONE', 'BOGUS') THEN CASE WHEN upper(flags) = 'ACK,ACK' THEN 'ACK' ELSE upper(flags) END END AS tcp_flags,
  failed_conn_info AS c_text,
  CASE WHEN lower(failed_conn_info) IN {sql_list(fv.FAILED_WORDS)} THEN true WHEN lower(failed_conn_info) IN {sql_list(fv.CLEAN_WORDS)} THEN false END AS failed_connection,
  label FROM raw), judged AS (SELECT *, concat_ws(',',
  CASE WHEN observed_us IS NULL THEN 'timestamp' END, CASE WHEN src_ip IS NULL THEN 'src_ip' END, CASE WHEN dst_ip IS NULL THEN 'dst_ip' END,
  CASE WHEN nullif(sp_text, '') IS NOT NULL AND (sp IS NULL OR sp NOT BETWEEN 0 AND 65535) THEN 'src_port' END,
  CASE WHEN nullif(dp_text, '') IS NOT NULL AND (dp IS NULL OR dp NOT BETWEEN 0 AND 65535) THEN 'dst_port' END,
  CASE WHEN packet_count IS NULL THEN 'packets' END, CASE WHEN byte_count IS NULL THEN 'bytes' END,
  CASE WHEN d_text IS NOT NULL AND duration_ms IS NULL THEN 'duration_ms' END,
  CASE WHEN f_text = 'BOGUS' THEN 'flags' END,
  CASE WHEN lower(c_text) = 'corrupt' THEN 'failed_conn_info' END) AS problems FROM parsed)"""


def query_normalize_flows(spark, folder):
    clean = normalize.normalize_flows(upload(spark, folder), keep=["event_id"])
    return clean.select(
        "event_id", F.unix_micros("observed_at").alias("observed_us"), "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
        "packet_count", "byte_count", "duration_ms", "tcp_flags", "failed_connection", F.try_element_at("extra", F.lit("label")).alias("label"),
    )


NORMALIZE_SQL = PARSED_CTE + """ SELECT event_id, observed_us, src_ip, dst_ip, sp AS src_port, dp AS dst_port, protocol, packet_count, byte_count,
  duration_ms, tcp_flags, failed_connection, nullif(label, '') AS label FROM judged WHERE problems = ''"""


def query_quarantine_flows(spark, folder):
    refused = normalize.quarantine_flows(upload(spark, folder))
    return refused.select("event_id", F.array_join("problems", ",").alias("problems"))


def query_flow_contract(spark, folder):
    raw = upload(spark, folder).withColumns({"flags": F.coalesce("flags", F.lit("NONE")), "protocol": F.upper("protocol")})
    found = normalize.flow_contract_violations(raw, keep=["event_id"])
    return found.select("event_id", F.array_join("violations", ",").alias("violations"))


_FLAG_LIST = sql_list(["NONE", "SYN,ACK", "ACK", "FIN", "RST", "SYN", "URG,ECE", "ACK,ACK", "PSH"])
CONTRACT_SQL = UPLOAD_CTE + f""" SELECT * FROM (SELECT event_id, concat_ws(',',
  CASE WHEN NOT (regexp_full_match(src_ip, '{V4}([.]{V4}){{3}}') OR src_ip LIKE '%:%') THEN 'src_ip' END,
  CASE WHEN NOT (regexp_full_match(dst_ip, '{V4}([.]{V4}){{3}}') OR dst_ip LIKE '%:%') THEN 'dst_ip' END,
  CASE WHEN src_port IS NULL OR src_port = '' OR CAST(src_port AS INTEGER) NOT BETWEEN 0 AND 65535 THEN 'src_port' END,
  CASE WHEN dst_port IS NULL OR CAST(dst_port AS INTEGER) NOT BETWEEN 0 AND 65535 THEN 'dst_port' END,
  CASE WHEN upper(protocol) NOT IN ('TCP', 'UDP', 'ICMP', 'OTHER') THEN 'protocol' END,
  CASE WHEN time_text = 'bad-time' THEN 'timestamp' END,
  CASE WHEN packets IN ('0', '18.0') THEN 'packets' END, CASE WHEN bytes = '-5' THEN 'bytes' END,
  CASE WHEN duration_ms IS NULL OR duration_ms IN ('', 'abc') THEN 'duration_ms' END,
  CASE WHEN coalesce(flags, 'NONE') NOT IN {_FLAG_LIST} THEN 'flags' END,
  CASE WHEN failed_conn_info IS NULL OR failed_conn_info NOT IN {sql_list(fv.CONNECTION_STATES)} THEN 'failed_conn_info' END,
  CASE WHEN label = '' THEN 'label' END) AS violations FROM raw) WHERE violations <> ''"""


def query_label_counts(spark, folder):
    from flowcast.operators.labeling import label_counts

    return label_counts(flows(spark, folder))


def query_distinct_flows(spark, folder):
    f = flows(spark, folder).withColumn("hour", F.date_trunc("hour", "observed_at"))
    columns = ["traffic_source_id", "hour", "dst_ip", "dst_port", "protocol", "tcp_flags"]
    unique = normalize.distinct_flows(f.select(*columns), columns)
    return unique.select("traffic_source_id", F.unix_seconds("hour").alias("hour"), "dst_ip", "dst_port", "protocol", "tcp_flags")


QUERIES = {
    "parse_event_time": query_event_time,
    "valid_ip": query_valid_ip,
    "decimal_ipv4": query_decimal_ipv4,
    "is_private_ip": query_is_private,
    "map_protocol": query_map_protocol,
    "parse_port": query_parse_port,
    "parse_counts": query_parse_counts,
    "parse_duration": query_parse_duration,
    "parse_flags": _rule_query(FLAGS, rows.flags, "flags"),
    "synthesize_flags": query_synthesize_flags,
    "zeek_flags": lambda s, d: events(s, d).select("event_id", sensor.history_flags(pick(HISTORIES)).alias("flags")),
    "parse_failed": _rule_query(FAILED, rows.failed_connection, "failed"),
    "classify_failed": query_classify_failed,
    "zeek_conn_state": lambda s, d: events(s, d).select("event_id", sensor.connection_state(pick(CONN_STATES)).alias("state")),
    "clean_numeric": lambda s, d: events(s, d).select("event_id", dataset.clean_numeric(pick(JUNK)).alias("number")),
    "canonical_label": query_canonical_label,
    "label_counts": query_label_counts,
    "label_family": query_label_family,
    "label_stage": query_label_stage,
    "stage_attack_type": query_stage_attack_type,
    "stage_candidates": query_stage_candidates,
    "risk_band": query_risk_band,
    "normalize_flows": query_normalize_flows,
    "quarantine_flows": query_quarantine_flows,
    "flow_contract_violations": query_flow_contract,
    "distinct_flows": query_distinct_flows,
}


def _number_case(text: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({text}), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(trim({text}) AS DOUBLE) ELSE 0.0 END"


SQL = {
    "parse_event_time": f"{EV} SELECT event_id, micros, micros IS NULL AS invalid FROM (SELECT event_id, {TIME_SQL} AS micros FROM (SELECT event_id, {RAW_TIME} AS t FROM ev))",
    "valid_ip": VALID_IP_SQL,
    "decimal_ipv4": f"{EV} SELECT event_id, CASE WHEN event_id % 9 < 2 THEN '192.168.10.50' ELSE {OCTETS_SQL} END AS address FROM (SELECT event_id, {NUMBER_SQL} AS n FROM ev)",
    "is_private_ip": f"""{EV} SELECT event_id, address, {PRIVATE_SQL} AS is_private FROM (SELECT event_id, address,
      CAST(split_part(address, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(address, '.', 2) AS BIGINT) * 65536
      + CAST(split_part(address, '.', 3) AS BIGINT) * 256 + CAST(split_part(address, '.', 4) AS BIGINT) AS n
      FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN {OCTETS_SQL} ELSE {pick_sql(EDGES)} END AS address FROM (SELECT event_id, {NUMBER_SQL} AS n FROM ev)))""",
    "map_protocol": f"""{EV} SELECT event_id, CASE WHEN p = '' OR p IS NULL THEN NULL WHEN p IN ('TCP', '6') THEN 'TCP' WHEN p IN ('UDP', '17') THEN 'UDP'
      WHEN p IN ('ICMP', '1') THEN 'ICMP' ELSE 'OTHER' END AS protocol, (p IS NULL OR p = '') AS invalid,
      CASE WHEN t IS NULL OR trim(t) IN ('6', '6.0', 'TCP', 'tcp') THEN 'TCP' WHEN trim(t) IN ('17', '17.0', 'UDP', 'udp') THEN 'UDP'
      WHEN trim(t) IN ('1', '1.0', 'ICMP', 'icmp') THEN 'ICMP' ELSE 'OTHER' END AS dataset_protocol
      FROM (SELECT event_id, t, upper(trim(t)) AS p FROM (SELECT event_id, {pick_sql(PROTOCOLS)} AS t FROM ev))""",
    "parse_port": f"""{EV} SELECT event_id, CASE WHEN n BETWEEN 0 AND 65535 THEN CAST(n AS INTEGER) END AS port,
      (t IS NOT NULL AND (n IS NULL OR n NOT BETWEEN 0 AND 65535)) AS invalid,
      CAST(greatest(0, least(65535, c)) AS INTEGER) AS clipped FROM (SELECT event_id, t,
      CASE WHEN regexp_full_match(t, '[+-]?[0-9]+') THEN CAST(t AS BIGINT) END AS n, CAST(trunc({_number_case("raw")}) AS BIGINT) AS c
      FROM (SELECT event_id, raw, nullif(trim(raw), '') AS t FROM (SELECT event_id, {pick_sql(PORTS)} AS raw FROM ev)))""",
    "parse_counts": f"""{EV} SELECT event_id, CASE WHEN n >= 0 THEN n END AS count, (n IS NULL OR n < 0) AS invalid,
      greatest(1, f + b) AS packets, greatest(0, f + b) AS bytes FROM (SELECT event_id,
      CASE WHEN regexp_full_match(trim(t), '[+-]?[0-9]+') THEN CAST(trim(t) AS BIGINT) END AS n,
      CAST(trunc({_number_case("t")}) AS BIGINT) AS f, CAST(trunc({_number_case("coalesce(j, '')")}) AS BIGINT) AS b
      FROM (SELECT event_id, {pick_sql(COUNTS)} AS t, {pick_sql(JUNK)} AS j FROM ev))""",
    "parse_duration": f"""{EV} SELECT event_id, CASE WHEN r >= 0 THEN CAST(r AS BIGINT) END AS duration_ms,
      (t IS NOT NULL AND (r IS NULL OR r < 0)) AS invalid, {q6("greatest(0.0, (cents * 37 - 5000) / 1000.0)")} AS dataset_ms,
      CAST(trunc(CAST(cents / 1000 AS DOUBLE) * 1000) AS BIGINT) AS sensor_ms
      FROM (SELECT event_id, cents, t, round_even(CASE WHEN regexp_full_match(t, '[+-]?[0-9]+[.]?[0-9]*(e[0-9]+)?') THEN CAST(t AS DOUBLE) END, 0) AS r
      FROM (SELECT event_id, cents, nullif({pick_sql(DURATIONS)}, '') AS t FROM ev))""",
    "parse_flags": f"""{EV} SELECT event_id, CASE t WHEN 'SYN,ACK' THEN 'SYN,ACK' WHEN 'psh,ack' THEN 'PSH,ACK' WHEN 'SYN, syn ,FIN' THEN 'SYN,FIN'
      WHEN 'SYN,,ACK' THEN 'SYN,ACK' WHEN 'ECE,CWE,URG' THEN 'ECE,CWE,URG' END AS flags, coalesce(t IN ('BOGUS', ','), false) AS invalid
      FROM (SELECT event_id, {pick_sql(FLAGS)} AS t FROM ev)""",
    "synthesize_flags": SYNTH_SQL,
    "zeek_flags": f"""{EV} SELECT event_id, nullif(concat_ws(',', CASE WHEN contains(t, 'S') THEN 'SYN' END, CASE WHEN contains(t, 'A') THEN 'ACK' END,
      CASE WHEN contains(t, 'F') THEN 'FIN' END, CASE WHEN contains(t, 'R') THEN 'RST' END, CASE WHEN contains(t, 'P') THEN 'PSH' END), '') AS flags
      FROM (SELECT event_id, {pick_sql(HISTORIES)} AS t FROM ev)""",
    "parse_failed": f"""{EV} SELECT event_id, CASE WHEN t IN {sql_list(fv.FAILED_WORDS)} THEN true WHEN t IN {sql_list(fv.CLEAN_WORDS)} THEN false END AS failed,
      coalesce(t <> '' AND t NOT IN {sql_list(fv.FAILED_WORDS + fv.CLEAN_WORDS + fv.NOT_APPLICABLE_WORDS)}, false) AS invalid
      FROM (SELECT event_id, lower({pick_sql(FAILED)}) AS t FROM ev)""",
    "classify_failed": CLASSIFY_SQL,
    "zeek_conn_state": f"""{EV} SELECT event_id, CASE WHEN t IN ('S0', 'SH', 'SHR') THEN 'SYN_NO_ACK' WHEN t LIKE 'RST%' OR t = 'REJ' THEN 'RST_ABORT'
      ELSE 'CLEAN' END AS state FROM (SELECT event_id, upper({pick_sql(CONN_STATES)}) AS t FROM ev)""",
    "clean_numeric": f"{EV} SELECT event_id, {_number_case('t')} AS number FROM (SELECT event_id, {pick_sql(JUNK)} AS t FROM ev)",
    "canonical_label": _label_sql(),
    "label_counts": f"WITH {flows_sql()} SELECT label, count(*) AS rows FROM flows GROUP BY label",
    "label_family": f"{EV} SELECT event_id, {sql_map(fv.LABEL_FAMILIES, 't')} AS family FROM (SELECT event_id, {pick_sql(NAMES)} AS t FROM ev)",
    "label_stage": _stage_sql(),
    "stage_attack_type": f"{EV} SELECT event_id, " + sql_map(fv.STAGE_ATTACK_TYPES, "t", "'UNKNOWN'") + f" AS attack_type FROM (SELECT event_id, {pick_sql(STAGE_TEXTS)} AS t FROM ev)",
    "stage_candidates": _candidates_sql(),
    "risk_band": RISK_SQL,
    "normalize_flows": NORMALIZE_SQL,
    "quarantine_flows": PARSED_CTE + " SELECT event_id, problems FROM judged WHERE problems <> ''",
    "flow_contract_violations": CONTRACT_SQL,
    "distinct_flows": f"WITH {flows_sql()} SELECT DISTINCT traffic_source_id, us // 3600000000 * 3600 AS hour, dst_ip, dst_port, protocol, tcp_flags FROM flows",
}
