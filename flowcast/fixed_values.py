"""Names, tables, bounds and texts that results must carry exactly.

Everything in this module is data.  The rules that use it are in ``functions`` and
``operators``.
"""

from __future__ import annotations

# --- Flow columns ---------------------------------------------------------------------
REQUIRED_COLUMNS = ("timestamp", "src_ip", "dst_ip", "protocol", "packets", "bytes")
OPTIONAL_COLUMNS = ("src_port", "dst_port", "duration_ms", "flags", "failed_conn_info")

# Header spellings with the same unit and meaning.
HEADER_ALIASES = {
    "time": "timestamp", "ts": "timestamp", "event_time": "timestamp", "flow_start": "timestamp",
    "source_ip": "src_ip", "sourceip": "src_ip", "src": "src_ip", "srcaddr": "src_ip", "id_orig_h": "src_ip",
    "destination_ip": "dst_ip", "destinationip": "dst_ip", "dst": "dst_ip", "dstaddr": "dst_ip", "id_resp_h": "dst_ip",
    "source_port": "src_port", "sourceport": "src_port", "sport": "src_port", "id_orig_p": "src_port",
    "destination_port": "dst_port", "destinationport": "dst_port", "dport": "dst_port", "id_resp_p": "dst_port",
    "proto": "protocol", "ip_protocol": "protocol",
    "packet_count": "packets", "packetcount": "packets", "total_packets": "packets",
    "byte_count": "bytes", "bytecount": "bytes", "total_bytes": "bytes",
    "duration": "duration_ms", "duration_milliseconds": "duration_ms",
    "tcp_flags": "flags", "conn_state": "failed_conn_info",
}

# Word lists of the row rules.
PROTOCOLS = ("TCP", "UDP", "ICMP", "OTHER")
PROTOCOL_NUMBERS = {"6": "TCP", "17": "UDP", "1": "ICMP"}
TCP_FLAGS = ("SYN", "ACK", "FIN", "RST", "PSH", "URG", "ECE", "CWE")
FAILED_WORDS = ("syn_no_ack", "rst_abort", "zero_win", "failed", "true", "1", "yes")
CLEAN_WORDS = ("clean", "false", "0", "no")
NOT_APPLICABLE_WORDS = ("na", "n/a", "none", "null")
CONNECTION_STATES = ("CLEAN", "SYN_NO_ACK", "RST_ABORT", "ZERO_WIN", "NA")

# Column order of a labelled flow file.
LABELED_FLOW_COLUMNS = (
    "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
    "packets", "bytes", "duration_ms", "flags", "failed_conn_info", "label",
)

# Dataset header spellings -> the long header they stand for.
DATASET_ALIASES = {
    "Src Port": "Source Port", "Dst Port": "Destination Port",
    "Total Fwd Packet": "Total Fwd Packets", "Total Bwd packets": "Total Backward Packets",
    "Total Length of Fwd Packet": "Total Length of Fwd Packets",
    "Total Length of Bwd Packet": "Total Length of Bwd Packets",
    "Src IP": "Source IP", "Dst IP": "Destination IP",
    "Tot Fwd Pkts": "Total Fwd Packets", "Tot Bwd Pkts": "Total Backward Packets",
    "TotLen Fwd Pkts": "Total Length of Fwd Packets", "TotLen Bwd Pkts": "Total Length of Bwd Packets",
}
DATASET_DEFAULT_SRC_IP = "192.168.10.50"
DATASET_DEFAULT_DST_IP = "172.16.0.1"
REPLAY_BASE = "2017-07-03 00:00:00"
ARCHIVE_DAYS = ("monday.csv", "tuesday.csv", "wednesday.csv", "thursday.csv", "friday.csv")

# --- Labels ---------------------------------------------------------------------------
# Label spellings found in the public datasets -> canonical label.
LABEL_SPELLINGS = {
    "BENIGN": "BENIGN",
    "benign": "BENIGN",
    "PortScan": "PortScan",
    "portscan": "PortScan",
    "Port Scan": "PortScan",
    "DoS Hulk": "DoS_Hulk",
    "DoS_Hulk": "DoS_Hulk",
    "dos hulk": "DoS_Hulk",
    "DoS GoldenEye": "DoS_GoldenEye",
    "DoS_GoldenEye": "DoS_GoldenEye",
    "dos goldeneye": "DoS_GoldenEye",
    "DoS slowloris": "DoS_Slowloris",
    "DoS_Slowloris": "DoS_Slowloris",
    "dos slowloris": "DoS_Slowloris",
    "DoS Slowhttptest": "DoS_Slowhttptest",
    "DoS_Slowhttptest": "DoS_Slowhttptest",
    "dos slowhttptest": "DoS_Slowhttptest",
    "Heartbleed": "Heartbleed",
    "heartbleed": "Heartbleed",
    "DDoS": "DDoS_LOIC",
    "DDoS_LOIC": "DDoS_LOIC",
    "ddos": "DDoS_LOIC",
    "FTP-Patator": "FTP_Patator",
    "FTP_Patator": "FTP_Patator",
    "ftp-patator": "FTP_Patator",
    "SSH-Patator": "SSH_Patator",
    "SSH_Patator": "SSH_Patator",
    "ssh-patator": "SSH_Patator",
    "Bot": "Botnet",
    "Botnet": "Botnet",
    "bot": "Botnet",
    "Web Attack - Brute Force": "Web_BruteForce",
    "Web Attack – Brute Force": "Web_BruteForce",
    "Web Attack \x96 Brute Force": "Web_BruteForce",
    "Web_BruteForce": "Web_BruteForce",
    "Web Attack - XSS": "Web_XSS",
    "Web Attack – XSS": "Web_XSS",
    "Web Attack \x96 XSS": "Web_XSS",
    "Web_XSS": "Web_XSS",
    "Web Attack - Sql Injection": "Web_SqlInjection",
    "Web Attack – Sql Injection": "Web_SqlInjection",
    "Web Attack \x96 Sql Injection": "Web_SqlInjection",
    "Web_SqlInjection": "Web_SqlInjection",
    "Infiltration": "Infiltration",
    "Infilteration": "Infiltration",
    "infiltration": "Infiltration",
    "infilteration": "Infiltration",
    "FTP-BruteForce": "FTP_Patator",
    "SSH-Bruteforce": "SSH_Patator",
    "Brute Force -Web": "Web_BruteForce",
    "Brute Force -XSS": "Web_XSS",
    "SQL Injection": "Web_SqlInjection",
    "DoS attacks-GoldenEye": "DoS_GoldenEye",
    "DoS attacks-Hulk": "DoS_Hulk",
    "DoS attacks-SlowHTTPTest": "DoS_Slowhttptest",
    "DoS attacks-Slowloris": "DoS_Slowloris",
    "DDOS attack-LOIC-UDP": "DDoS_LOIC",
    "DDOS attack-HOIC": "DDoS_LOIC",
}

# Canonical attack label -> family.
LABEL_FAMILIES = {
    "PortScan": "Reconnaissance",
    "DoS_Hulk": "DoS",
    "DoS_GoldenEye": "DoS",
    "DoS_Slowloris": "DoS",
    "DoS_Slowhttptest": "DoS",
    "Heartbleed": "DoS",
    "DDoS_LOIC": "DDoS",
    "FTP_Patator": "BruteForce",
    "SSH_Patator": "BruteForce",
    "Botnet": "Botnet_C2",
    "Web_BruteForce": "WebAttack",
    "Web_XSS": "WebAttack",
    "Web_SqlInjection": "WebAttack",
    "Infiltration": "Infiltration",
}

# Campaign stages 0..5, the stage of a family, the attack type of a stage.
STAGES = ("Benign", "Reconnaissance", "Initial Access", "Lateral Movement", "Command & Control", "Impact")
FAMILY_STAGES = {
    "Reconnaissance": 1, "BruteForce": 2, "WebAttack": 2,
    "Infiltration": 3, "Botnet_C2": 4, "DoS": 5, "DDoS": 5,
}
STAGE_ATTACK_TYPES = {
    "Benign": "BENIGN",
    "Reconnaissance": "Reconnaissance",
    "Initial Access": "BruteForce",
    "Lateral Movement": "Infiltration",
    "Command & Control": "Botnet_C2",
    "Impact": "DoS",
}
# Families offered as candidates for a stage.
STAGE_FAMILIES = {
    "Reconnaissance": ("Reconnaissance",),
    "Initial Access": ("BruteForce", "WebAttack", "DoS"),
    "Lateral Movement": ("Infiltration",),
    "Command & Control": ("Botnet_C2",),
    "Impact": ("DoS", "DDoS"),
}
# Label, family, ATT&CK tactic, technique id, technique.
ATTACK_REFERENCE = (
    ("PortScan", "Reconnaissance", "Discovery", "T1046", "Network Service Scanning"),
    ("FTP_Patator", "BruteForce", "Credential Access", "T1110", "Brute Force"),
    ("SSH_Patator", "BruteForce", "Credential Access", "T1110", "Brute Force"),
    ("Web_BruteForce", "WebAttack", "Credential Access", "T1110", "Brute Force"),
    ("Web_XSS", "WebAttack", "Initial Access", "T1190", "Exploit Public-Facing Application"),
    ("Web_SqlInjection", "WebAttack", "Initial Access", "T1190", "Exploit Public-Facing Application"),
    ("Heartbleed", "DoS", "Initial Access", "T1190", "Exploit Public-Facing Application"),
    ("Infiltration", "Infiltration", "Lateral Movement", "T1021", "Remote Services"),
    ("Botnet", "Botnet_C2", "Command and Control", "T1071", "Application Layer Protocol"),
    ("DoS_Hulk", "DoS", "Impact", "T1499", "Endpoint Denial of Service"),
    ("DoS_GoldenEye", "DoS", "Impact", "T1499", "Endpoint Denial of Service"),
    ("DoS_Slowloris", "DoS", "Impact", "T1499", "Endpoint Denial of Service"),
    ("DoS_Slowhttptest", "DoS", "Impact", "T1499", "Endpoint Denial of Service"),
    ("DDoS_LOIC", "DDoS", "Impact", "T1498", "Network Denial of Service"),
)

# --- Features -------------------------------------------------------------------------
FEATURE_SCHEMA_VERSION = "v1"
# The feature vector in order -- name, type, minimum, maximum.
FEATURE_SPECS = (
    ("flow_count", "integer", 0, None),
    ("packet_count", "integer", 0, None),
    ("byte_count", "integer", 0, None),
    ("avg_packets_per_flow", "number", 0, None),
    ("avg_bytes_per_flow", "number", 0, None),
    ("avg_duration_ms", "number", 0, None),
    ("packet_length_mean", "number", 0, None),
    ("packet_length_std", "number", 0, None),
    ("unique_src_ips", "integer", 0, None),
    ("unique_dst_ips", "integer", 0, None),
    ("unique_src_ports", "integer", 0, 65536),
    ("unique_dst_ports", "integer", 0, 65536),
    ("src_ip_entropy", "number", 0, 32),
    ("dst_port_entropy", "number", 0, 16),
    ("protocol_tcp_ratio", "number", 0, 1),
    ("protocol_udp_ratio", "number", 0, 1),
    ("protocol_icmp_ratio", "number", 0, 1),
    ("syn_ratio", "number", 0, 1),
    ("ack_ratio", "number", 0, 1),
    ("fin_ratio", "number", 0, 1),
    ("rst_ratio", "number", 0, 1),
    ("syn_ack_ratio", "number", 0, None),
    ("failed_conn_ratio", "number", 0, 1),
    ("short_flow_ratio", "number", 0, 1),
    ("inbound_outbound_ratio", "number", 0, None),
    ("retry_rate", "number", 0, 1),
    ("packet_rate_per_sec", "number", 0, None),
    ("byte_rate_per_sec", "number", 0, None),
    ("flow_rate_per_sec", "number", 0, None),
    ("packet_burst_score", "number", 0, None),
    ("syn_burst_score", "number", 0, None),
    ("delta_packet_rate", "number", None, None),
    ("delta_byte_rate", "number", None, None),
    ("delta_syn_ratio", "number", -1, 1),
    ("delta_failed_conn_ratio", "number", -1, 1),
    ("delta_unique_dst_ports", "integer", -65536, 65536),
    ("delta_packet_burst_score", "number", None, None),
)
FEATURE_NAMES = tuple(spec[0] for spec in FEATURE_SPECS)
SHORT_FLOW_MS = 100
BURST_LOOKBACK = 3

# Usual benign values shown beside an explanation.
BASELINE_VALUES = {
    "syn_ack_ratio": 1.0,
    "failed_conn_ratio": 0.03,
    "dst_port_entropy": 1.5,
    "src_ip_entropy": 2.0,
    "short_flow_ratio": 0.10,
    "syn_ratio": 0.30,
    "rst_ratio": 0.02,
    "retry_rate": 0.02,
    "packet_burst_score": 1.0,
    "syn_burst_score": 1.0,
    "delta_failed_conn_ratio": 0.0,
    "delta_unique_dst_ports": 0.0,
    "delta_packet_rate": 0.0,
}

# Sliding profiles -- window seconds, slide seconds, horizon seconds.
WINDOW_PROFILES = {"micro": (10, 2, 60), "standard": (30, 5, 120), "macro": (60, 10, 300)}

# --- Scoring --------------------------------------------------------------------------
# Rule terms -- feature, weight, ramp start, ramp end.
RULE_TERMS = {
    "Reconnaissance": (
        ("dst_port_entropy", 0.35, 1.8, 6.0),
        ("short_flow_ratio", 0.20, 0.3, 0.8),
        ("syn_ack_ratio", 0.25, 2.0, 10.0),
        ("delta_unique_dst_ports", 0.20, 5.0, 50.0),
    ),
    "BruteForce": (
        ("failed_conn_ratio", 0.40, 0.15, 0.70),
        ("retry_rate", 0.25, 0.10, 0.50),
        ("rst_ratio", 0.15, 0.10, 0.50),
        ("delta_failed_conn_ratio", 0.20, 0.05, 0.30),
    ),
    "DDoS": (
        ("syn_burst_score", 0.30, 1.5, 6.0),
        ("packet_burst_score", 0.25, 1.5, 6.0),
        ("syn_ratio", 0.20, 0.5, 0.9),
        ("src_ip_entropy", 0.15, 3.0, 7.0),
        ("delta_packet_rate", 0.10, 50.0, 1000.0),
    ),
}
# Sentence of a rule term -- printf pattern and the unit it is shown in.
RULE_SENTENCES = {
    "dst_port_entropy": ("Destination port entropy %.2f bits (baseline about 1.5): vertical scan pattern.", "value"),
    "short_flow_ratio": ("%.0f%% of flows are shorter than 100 ms: ephemeral probe flows.", "percent"),
    "syn_ack_ratio": ("SYN/ACK asymmetry %.1fx: many handshakes never complete.", "value"),
    "delta_unique_dst_ports": ("Distinct destination ports rose by %d since the previous window.", "whole"),
    "failed_conn_ratio": ("Failed connection ratio %.0f%% (baseline about 3%%): repeated rejected attempts.", "percent"),
    "retry_rate": ("Retry rate %.0f%%: the same source keeps re-connecting to the same service.", "percent"),
    "rst_ratio": ("RST ratio %.0f%%: connections are being aborted after authentication attempts.", "percent"),
    "delta_failed_conn_ratio": ("Failed connection ratio increased by %+.2f since the previous window.", "value"),
    "syn_burst_score": ("SYN burst score %.1fx the recent average: SYN flood build-up.", "value"),
    "packet_burst_score": ("Packet volume %.1fx the recent average: volumetric surge.", "value"),
    "syn_ratio": ("%.0f%% of flows are SYN-only: unreciprocated connection attempts.", "percent"),
    "src_ip_entropy": ("Source IP entropy %.2f bits: traffic from an unusually wide set of sources.", "value"),
    "delta_packet_rate": ("Packet rate rose by %.0f packets/s since the previous window.", "value"),
}
NO_EVIDENCE_SENTENCE = "All precursor indicators are within their benign baselines."
BENIGN_SUMMARY = "Low attack risk in the next %d seconds. Precursor indicators are within benign baselines."
# Advice per attack type.
MITIGATIONS = {
    "Reconnaissance": "Rate-limit the scanning source subnet, confirm exposed services on the probed ports, and raise logging on the targeted hosts.",
    "BruteForce": "Check failed-login bursts on the targeted service, enable account lockout or exponential back-off, and block the offending source range.",
    "DDoS": "Enable TCP SYN cookies, pre-stage upstream rate limiting, and inspect source concentration for a block list.",
    "BENIGN": "No action required. Continue monitoring.",
    "UNKNOWN": "Pattern unseen. Investigate manually and monitor the next windows before acting.",
}
RULE_MODEL_NAME = "rule-fallback"
RULE_MODEL_VERSION = "rule-fallback-v1.0.0"
LEARNED_MODEL_NAME = "world-model"
# Stage shown for a rule attack type.
RULE_TYPE_STAGES = {
    "BENIGN": "Benign", "Reconnaissance": "Reconnaissance", "BruteForce": "Initial Access",
    "DDoS": "Impact", "DoS": "Impact",
}
# Risk bands (lower bound, level, progression name), thresholds, horizons.
RISK_BANDS = (
    (0.0, "low", "S0_BENIGN_BASELINE"),
    (20.0, "medium", "S1_RECON_PRECURSOR"),
    (50.0, "high", "S2_WEAPONIZATION_ESCALATION"),
    (75.0, "critical", "S3_ACTIVE_PEAK"),
)
ALERT_THRESHOLD = 50.0
LOW_CONFIDENCE = 0.55
OOD_Z = 6.0
OOD_MIN_FEATURES = 3
HORIZONS = (60, 120, 300)
HISTORY_WINDOWS = 10
FORECAST_STEPS = 5

# --- Alerts ---------------------------------------------------------------------------
# Status -> statuses it may move to.
STATUSES = ("open", "acknowledged", "investigating", "resolved")
TRANSITIONS = {
    "open": ("acknowledged", "investigating", "resolved"),
    "acknowledged": ("investigating", "resolved", "open"),
    "investigating": ("resolved", "acknowledged"),
    "resolved": ("investigating",),
}
# Recommended actions per stage, and the notes put in front of them.
STAGE_ACTIONS = {
    "Reconnaissance": (
        "Confirm which services are exposed on the probed destination ports.",
        "Rate-limit or temporarily block the scanning source range.",
        "Raise logging verbosity on the targeted hosts.",
    ),
    "Initial Access": (
        "Review failed authentication bursts on the targeted service.",
        "Enable account lockout or exponential back-off.",
        "Check for any successful login from the offending source.",
    ),
    "Lateral Movement": (
        "Isolate the affected host and inspect east-west traffic.",
        "Review authentication events for reused credentials.",
        "Hunt for remote-execution and scheduled-task activity.",
    ),
    "Command & Control": (
        "Inspect the destination for low-jitter beaconing behaviour.",
        "Correlate with DNS and TLS SNI records for the same host.",
        "Contain the endpoint before it receives further instructions.",
    ),
    "Impact": (
        "Enable TCP SYN cookies and pre-stage upstream rate limiting.",
        "Check egress volume against the host's normal baseline.",
        "Prepare to fail over or shed load on the targeted service.",
    ),
    "Benign": ("No action required. Continue monitoring.",),
}
FALLBACK_ACTION = "This forecast came from the rule-based fallback, not the trained model. Check that the model artifact is mounted."
UNCERTAIN_ACTION = "Treat this as a lead, not a verdict: the model reports low confidence, so corroborate with endpoint and identity evidence first."
OOD_ACTION = "This traffic is unlike the model's training baseline, so a false positive is likely. Validate manually before acting."

# --- Addresses ------------------------------------------------------------------------
# Private networks and their exceptions (IANA special-purpose registries).
PRIVATE_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
)
PUBLIC_V4 = ("192.0.0.9/32", "192.0.0.10/32")
PRIVATE_V6 = (
    "::1/128", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16",
    "fc00::/7", "fe80::/10",
)
PUBLIC_V6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
