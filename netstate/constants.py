"""Class lists, feature names, thresholds and ratios that results depend on."""

from __future__ import annotations

# Traffic states in tie-break order, and the marker for a row that no model could score.
STATE_CLASSES = ["BENIGN", "DDoS", "DoS", "PortScan"]
ATTACK_CLASSES = ["DDoS", "DoS", "PortScan"]
ALERT_CLASSES = ["NONE", "DDoS", "DoS", "PortScan"]
INVALID_STATE = "INVALID_FEATURES"

WINDOW_SECONDS = 10
PROXY_WINDOW_ROWS = 10
SEQUENCE_LENGTH = 5
HORIZONS = 6
EMBARGO_WINDOWS = 6

TRAIN_RATIO = 0.70
VALIDATION_RATIO = 0.15
TEST_RATIO = 0.15
HOLDOUT_RATIO = 0.15
ROLLING_FOLDS = 3
SEED = 42

WARNING_THRESHOLDS = [0.50, 0.60, 0.70, 0.80, 0.90]
MAX_WARNING_FPR = 0.05
LOW_SUPPORT = 30
MIN_ATTACK_RATIO = {"DDoS": 0.20, "DoS": 0.20, "PortScan": 0.20}

ROLLOUT_STEPS = 6
ALARM_PROBABILITY = 0.60

# The 77 flow features of the per-flow classifier, in training order (leading blanks are part of the public dataset).
FLOW_FEATURES = [
    " Destination Port", " Flow Duration", " Total Fwd Packets", " Total Backward Packets",
    "Total Length of Fwd Packets", " Total Length of Bwd Packets", " Fwd Packet Length Max",
    " Fwd Packet Length Min", " Fwd Packet Length Mean", " Fwd Packet Length Std", "Bwd Packet Length Max",
    " Bwd Packet Length Min", " Bwd Packet Length Mean", " Bwd Packet Length Std", "Flow Bytes/s",
    " Flow Packets/s", " Flow IAT Mean", " Flow IAT Std", " Flow IAT Max", " Flow IAT Min", "Fwd IAT Total",
    " Fwd IAT Mean", " Fwd IAT Std", " Fwd IAT Max", " Fwd IAT Min", "Bwd IAT Total", " Bwd IAT Mean",
    " Bwd IAT Std", " Bwd IAT Max", " Bwd IAT Min", "Fwd PSH Flags", " Bwd PSH Flags", " Fwd URG Flags",
    " Bwd URG Flags", " Fwd Header Length", " Bwd Header Length", "Fwd Packets/s", " Bwd Packets/s",
    " Min Packet Length", " Max Packet Length", " Packet Length Mean", " Packet Length Std",
    " Packet Length Variance", "FIN Flag Count", " SYN Flag Count", " RST Flag Count", " PSH Flag Count",
    " ACK Flag Count", " URG Flag Count", " CWE Flag Count", " ECE Flag Count", " Down/Up Ratio",
    " Average Packet Size", " Avg Fwd Segment Size", " Avg Bwd Segment Size", "Fwd Avg Bytes/Bulk",
    " Fwd Avg Packets/Bulk", " Fwd Avg Bulk Rate", " Bwd Avg Bytes/Bulk", " Bwd Avg Packets/Bulk",
    "Bwd Avg Bulk Rate", "Subflow Fwd Packets", " Subflow Fwd Bytes", " Subflow Bwd Packets",
    " Subflow Bwd Bytes", "Init_Win_bytes_forward", " Init_Win_bytes_backward", " act_data_pkt_fwd",
    " min_seg_size_forward", "Active Mean", " Active Std", " Active Max", " Active Min", "Idle Mean",
    " Idle Std", " Idle Max", " Idle Min",
]

# Window features: (output, flow feature, aggregate).
WINDOW_AGGREGATES = [
    ("total_fwd_packets", " Total Fwd Packets", "sum"),
    ("total_bwd_packets", " Total Backward Packets", "sum"),
    ("total_fwd_bytes", "Total Length of Fwd Packets", "sum"),
    ("total_bwd_bytes", " Total Length of Bwd Packets", "sum"),
    ("syn_count", " SYN Flag Count", "sum"),
    ("ack_count", " ACK Flag Count", "sum"),
    ("fin_count", "FIN Flag Count", "sum"),
    ("rst_count", " RST Flag Count", "sum"),
    ("psh_count", " PSH Flag Count", "sum"),
    ("urg_count", " URG Flag Count", "sum"),
    ("mean_iat", " Flow IAT Mean", "mean"),
    ("iat_variance", " Flow IAT Mean", "var"),
    ("min_iat", " Flow IAT Min", "min"),
    ("max_iat", " Flow IAT Max", "max"),
    ("mean_flow_duration", " Flow Duration", "mean"),
    ("max_flow_duration", " Flow Duration", "max"),
    ("mean_packet_size", " Average Packet Size", "mean"),
    ("max_packet_size", " Max Packet Length", "max"),
]

# The window state vector, in order.
STATE_FEATURES = [
    "flow_count", "unique_src_ip_count", "unique_dst_ip_count", "unique_src_port_count", "unique_dst_port_count",
    "total_fwd_packets", "total_bwd_packets", "total_packets", "total_fwd_bytes", "total_bwd_bytes", "total_bytes",
    "packets_per_second", "bytes_per_second", "flows_per_second", "syn_count", "ack_count", "fin_count", "rst_count",
    "psh_count", "urg_count", "mean_iat", "iat_variance", "min_iat", "max_iat", "mean_flow_duration",
    "max_flow_duration", "mean_packet_size", "max_packet_size",
]

# Cross-flow signature thresholds.
FLOOD_BUCKET_SECONDS = 1
FLOOD_MIN_SOURCES = 20
FLOOD_MIN_PACKET_RATE = 100.0
FLOOD_MIN_VICTIM_SHARE = 0.5
FLOOD_MAX_TOP_SOURCE_SHARE = 0.25
SYN_MIN_COUNT = 20
SYN_MAX_ACK_RATIO = 0.2
SYN_MIN_PACKET_RATE = 100.0
SWEEP_MIN_PORTS = 20
SWEEP_MAX_MEAN_FWD_BYTES = 400.0

# Kill-chain stages.
STATE_TO_STAGE = {"BENIGN": "Benign", "PortScan": "Reconnaissance", "DoS": "Impact", "DDoS": "Impact"}
STAGE_LADDER = [
    ("Reconnaissance", "TA0043"), ("Initial Access", "TA0001"), ("Command and Control", "TA0011"),
    ("Lateral Movement", "TA0008"), ("Exfiltration", "TA0010"), ("Impact", "TA0040"),
]
