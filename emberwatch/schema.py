"""The event frame, its vocabularies and its bounds."""

from pyspark.sql import types as T

STR, INT, TS, BOOL = T.StringType(), T.IntegerType(), T.TimestampType(), T.BooleanType()
ATTRS = T.MapType(STR, STR)

# Columns a parser fills, in order.
PARSED = [
    ("timestamp", TS),
    ("source_type", STR),
    ("event_category", STR),
    ("event_action", STR),
    ("event_outcome", STR),
    ("host", STR),
    ("host_ip", STR),
    ("username", STR),
    ("user_domain", STR),
    ("target_username", STR),
    ("source_ip", STR),
    ("source_port", INT),
    ("destination_ip", STR),
    ("destination_port", INT),
    ("protocol", STR),
    ("service", STR),
    ("process_name", STR),
    ("parent_process_name", STR),
    ("command_line", STR),
    ("session_id", STR),
    ("message", STR),
    ("attributes", ATTRS),
]
# Columns enrichment adds.
ENRICHED = [
    ("source_ip_scope", STR),
    ("asset_id", STR),
    ("asset_criticality", STR),
    ("identity_id", STR),
    ("identity_privileged", BOOL),
]
KEYS = [("id", STR), ("raw_event_id", STR), ("source_id", STR), ("batch_id", STR), ("simulated", BOOL)]

EVENT_SCHEMA = T.StructType([T.StructField(n, t) for n, t in KEYS + PARSED + ENRICHED])
PARSED_NAMES = [n for n, _ in PARSED]
TEXT_FIELDS = [n for n, t in PARSED + ENRICHED if t == STR]

RAW_SCHEMA = T.StructType(
    [
        T.StructField("record_no", T.LongType()),
        T.StructField("raw_data", T.BinaryType()),
        T.StructField("source_id", STR),
        T.StructField("source_type", STR),
        T.StructField("batch_id", STR),
        T.StructField("received_at", TS),
        T.StructField("timezone", STR),
        T.StructField("default_host", STR),
    ]
)

# The controlled vocabularies and size bounds of the event model.
SOURCE_TYPES = ["linux_auth", "windows_security", "http_access", "app_json", "generic_json"]
OUTCOMES = ["success", "failure", "unknown"]
ACTIONS = {
    "authentication": ["logon", "logoff"],
    "iam": [
        "user_created",
        "user_deleted",
        "user_modified",
        "password_changed",
        "group_member_added",
        "group_member_removed",
    ],
    "privilege": ["sudo", "su", "special_privileges_assigned"],
    "process": ["process_started", "process_ended"],
    "network": ["connection"],
    "web": ["http_request"],
    "application": ["app_event", "config_changed"],
}
CATEGORIES = list(ACTIONS)
MAX_RAW_BYTES = 65536
INTERNAL_NETWORKS = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7"]
ACTIVE_ALERT = ["NEW", "TRIAGED", "IN_PROGRESS"]
ACTIVE_INCIDENT = ["OPEN", "TRIAGED", "INVESTIGATING", "CONTAINED"]
SEVERITIES = ["critical", "high", "medium", "low"]

IP_FIELDS = ["host_ip", "source_ip", "destination_ip"]
PORT_FIELDS = ["source_port", "destination_port"]
# Text stored without ASCII capitals, compared directly so that Parquet statistics can prune.
LOWERCASE_FIELDS = [
    "source_type",
    "event_category",
    "event_action",
    "event_outcome",
    "source_ip_scope",
    "asset_criticality",
    "host",
    "username",
    "target_username",
    "user_domain",
    "process_name",
    "parent_process_name",
    "protocol",
    "service",
]
CONDITION_FIELDS = [
    n for n, _ in PARSED if n not in ("timestamp", "attributes")
] + ["source_ip_scope", "asset_criticality", "identity_privileged"]
