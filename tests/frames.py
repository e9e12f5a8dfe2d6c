"""Small event frames for tests."""

from datetime import UTC, datetime, timedelta

from emberwatch.schema import EVENT_SCHEMA

T0 = datetime(2026, 9, 25, 10, 0, tzinfo=UTC)
LOGON = {
    "source_type": "linux_auth",
    "event_category": "authentication",
    "event_action": "logon",
    "event_outcome": "failure",
    "host": "web-01",
    "username": "root",
    "source_ip": "203.0.113.45",
    "source_ip_scope": "external",
    "service": "sshd",
    "attributes": {},
    "batch_id": "b1",
    "simulated": False,
}


def event(n, seconds=0.0, **fields):
    row = {f.name: None for f in EVENT_SCHEMA}
    row.update(LOGON, id=f"e{n:06d}", timestamp=T0 + timedelta(seconds=seconds))
    row.update(fields)
    return tuple(row[f.name] for f in EVENT_SCHEMA)


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENT_SCHEMA)
