"""Fixed values that results depend on.

Everything in this module is a value that must equal the behaviour being
reproduced (lookup tables, address ranges, thresholds, label texts). They are
kept together, as plain text in their natural order, so that every operator
and every oracle query reads the same source.
"""

from __future__ import annotations

# --- fixed values: protocol number -> name (fallback "Protocol_<n>") -------
PROTOCOL_NAMES = {
    1: "ICMP",
    6: "TCP",
    17: "UDP",
    53: "DNS",
    80: "HTTP",
    443: "HTTPS",
    22: "SSH",
    21: "FTP",
    25: "SMTP",
    110: "POP3",
    143: "IMAP",
    993: "IMAPS",
    995: "POP3S",
    587: "SMTP_SUBMISSION",
    465: "SMTPS",
}
PROTOCOL_FALLBACK_PREFIX = "Protocol_"

# --- fixed values: protocol number -> rule label (fallback "PROTO_<n>") ----
RULE_PROTOCOL_LABELS = {
    1: "ICMP",
    6: "TCP",
    17: "UDP",
    53: "DNS",
    80: "HTTP",
    443: "HTTPS",
    22: "SSH",
    23: "TELNET",
    3389: "RDP",
}
RULE_PROTOCOL_FALLBACK_PREFIX = "PROTO_"

# --- fixed values: internal (private) IPv4 ranges --------------------------
PRIVATE_RANGES = [
    "10.0.0.0/8",
    "172.16.0.0/12",
    "192.168.0.0/16",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "224.0.0.0/4",
    "240.0.0.0/4",
]

# --- fixed values: flow direction labels ------------------------------------
DIR_IN_TO_EX = "Internal-to-External"
DIR_EX_TO_IN = "External-to-Internal"
DIR_IN_TO_IN = "Internal-to-Internal"
DIR_EX_TO_EX = "External-to-External"
DIRECTIONS = [DIR_IN_TO_EX, DIR_EX_TO_IN, DIR_IN_TO_IN, DIR_EX_TO_EX]
COUNTRY_INTERNAL = "Internal"
COUNTRY_UNKNOWN = "Unknown"

# --- fixed values: port severity classes for port rules ---------------------
HIGH_RISK_PORTS = [22, 23, 3389, 445, 135, 139, 1433, 3306, 5432]
MEDIUM_RISK_PORTS = [21, 25, 53, 80, 110, 143, 443, 993, 995]

# --- fixed values: (protocol number, port) policy texts ---------------------
SUSPICIOUS_COMBINATIONS = [
    (6, 53, "TCP on DNS port (53) - Suspicious"),
    (17, 80, "UDP on HTTP port (80) - Suspicious"),
    (17, 443, "UDP on HTTPS port (443) - Suspicious"),
    (6, 22, "TCP on SSH port (22) - Monitor"),
    (6, 3389, "TCP on RDP port (3389) - Monitor"),
    (6, 23, "TCP on Telnet port (23) - Suspicious"),
    (6, 21, "TCP on FTP port (21) - Monitor"),
    (17, 53, "UDP on DNS port (53) - Normal"),
    (6, 80, "TCP on HTTP port (80) - Normal"),
    (6, 443, "TCP on HTTPS port (443) - Normal"),
]

# --- fixed values: static suspicious-flow rules -----------------------------
REASON_TELNET = "Telnet usage detected"
REASON_SSH = "SSH access detected"
REASON_RDP = "RDP access detected"
REASON_DNS_TUNNEL = "Potential DNS tunneling"
REASON_HIGH_PACKETS = "Unusually high packet count"
REASON_HIGH_BYTES = "Unusually high byte count"
REASON_DYNAMIC_PORT = "High activity on dynamic port"
DNS_PACKETS_LIMIT = 1000
HIGH_PACKETS_LIMIT = 10000
HIGH_BYTES_LIMIT = 1000000
DYNAMIC_PORT_FLOOR = 49152
DYNAMIC_PORT_PACKETS_LIMIT = 1000
ML_REASON_PREFIX = "ML Rule: "
REASON_SEPARATOR = "; "

# --- fixed values: alert scoring (in tenths) --------------------------------
SCORE_SUSPICIOUS = 4
SCORE_MONITOR = 2
SCORE_TCP_UDP = 1
SCORE_EXTERNAL = 2
SCORE_NOT_INTERNAL = 1
COMMON_PORTS = [80, 443, 53]
SCORE_COMMON_PORT = -1
ADMIN_PORTS = [22, 23, 3389]
SCORE_ADMIN_PORT = 2
SEVERITY_STEPS = [(7, "HIGH"), (4, "MEDIUM"), (2, "LOW")]
SEVERITY_DEFAULT = "INFO"

# --- fixed values: threat types ---------------------------------------------
THREAT_DNS_TUNNELING = "DNS Tunneling"
THREAT_PROTOCOL_ANOMALY = "Protocol Anomaly"
THREAT_TELNET = "Telnet Usage"
THREAT_SSH = "SSH Access"
THREAT_RDP = "RDP Access"
THREAT_SUSPICIOUS = "Suspicious Protocol/Port"
THREAT_UNUSUAL = "Unusual Activity"

# --- fixed values: generated-rule families ----------------------------------
RULE_PROTOCOL = "protocol_anomaly"
RULE_PORT = "port_anomaly"
RULE_TEMPORAL = "temporal_anomaly"
RULE_BEHAVIORAL = "behavioral_anomaly"
RULE_FAMILIES = [RULE_PROTOCOL, RULE_PORT, RULE_TEMPORAL, RULE_BEHAVIORAL]
PROTOCOL_RULE_CONFIDENCE = 0.8
PORT_RULE_CONFIDENCE = 0.75
TEMPORAL_RULE_CONFIDENCE = 0.7
BEHAVIORAL_RULE_CONFIDENCE = 0.85
PORT_RULE_MIN_FLOWS = 10
STD_MULTIPLIER = 2
NO_STD_MULTIPLIER = 3
DISTINCT_MULTIPLIER = 1.5
TEMPORAL_MULTIPLIER = 1.5
TEMPORAL_DISTINCT_MULTIPLIER = 1.3
BEHAVIORAL_QUANTILE = 0.95
BEHAVIORAL_TOTAL_FACTOR = 0.8
BEHAVIORAL_MEAN_FACTOR = 1.2
BEHAVIORAL_DISTINCT_FACTOR = 0.8

# --- fixed values: model features (labelled flow CSV header names) ----------
MODEL_FEATURES = [
    "Flow Duration",
    "Total Fwd Packets",
    "Total Backward Packets",
    "Total Length of Fwd Packets",
    "Total Length of Bwd Packets",
    "Fwd Packet Length Mean",
    "Bwd Packet Length Mean",
    "Flow Bytes/s",
    "Flow Packets/s",
    "Fwd IAT Total",
    "Bwd IAT Total",
]
BENIGN_LABEL = "BENIGN"

# --- fixed values: alert-as-flow lookups (attack alerts reshaped as flows) ---
ALERT_NAME_TO_PORT = [
    ("HTTP", 80), ("HTTPS", 443), ("DNS", 53), ("SSH", 22),
    ("FTP", 21), ("SMTP", 25), ("POP3", 110), ("IMAP", 143),
]
ALERT_NAME_TO_PROTO = [
    ("TCP", 6), ("UDP", 17), ("ICMP", 1), ("DNS", 53), ("HTTP", 80), ("HTTPS", 443),
    ("SSH", 22), ("FTP", 21), ("SMTP", 25), ("POP3", 110), ("IMAP", 143),
]

# --- fixed values: CSV export header (13 columns) ---------------------------
EXPORT_COLUMNS = [
    ("alert_id", "Alert ID"), ("timestamp", "Timestamp"), ("src_ip", "Source IP"),
    ("dst_ip", "Destination IP"), ("protocol", "Protocol"), ("port", "Port"),
    ("packets", "Packets"), ("bytes", "Bytes"), ("threat_type", "Threat Type"),
    ("anomaly_score", "Anomaly Score"), ("severity", "Severity"),
    ("direction", "Direction"), ("country", "Country"),
]

# Isolation forest defaults (Liu, Ting & Zhou 2008; common library defaults).
IFOREST_TREES = 100
IFOREST_SAMPLE = 256
IFOREST_CONTAMINATION = 0.1

# Columns of the analysis frame, and text fields of the alert search.
REQUIRED_COLUMNS = [
    "src_ip", "dst_ip", "protocol_name", "direction", "is_internal_src", "is_internal_dst", "country",
    "bytes", "packets", "last_seen", "first_seen", "dst_port", "src_port", "port", "proto_num", "protocol",
]
SEARCH_FIELDS = ["alert_id", "src_ip", "dst_ip", "protocol", "threat_type", "severity",
                 "direction", "country", "suspicion_reason"]
