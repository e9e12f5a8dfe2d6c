"""Literal lines of each format through the whole-table parsers."""

import json
from datetime import UTC, datetime

import pytest

from emberwatch.operators.ingest import batch_report, ingest
from emberwatch.operators.parsers import parse_records
from emberwatch.schema import RAW_SCHEMA

NOW = datetime(2026, 3, 9, 6, 30, tzinfo=UTC)


def raw(n, kind, data, received=NOW, zone="UTC", host="app-01"):
    data = json.dumps(data) if isinstance(data, dict) else data
    data = data.encode() if isinstance(data, str) else data
    return (n, bytearray(data), "s1", kind, "b1", received, zone, host)


def parse(spark, rows):
    found = parse_records(spark.createDataFrame(rows, RAW_SCHEMA)).collect()
    return {r.record_no: r for r in found}


def at(r):
    return r.timestamp.replace(tzinfo=None).isoformat(sep=" ")


@pytest.fixture(scope="module")
def parsed(spark):
    ssh = "relay7 sshd[88]: Failed publickey for invalid user backup from 2001:db8::5 port 1025 ssh2"
    win = lambda e, **d: {"EventID": e, "TimeCreated": "2026-03-08T21:07:45.7654321Z", "Computer": "LAB-PC", "EventRecordID": 31, "EventData": d}
    generic = {"timestamp": "2026-03-08T21:07:45Z", "event_category": "network", "event_action": "connection", "host": "lab-pc",
               "source_ip": "172.20.4.4", "destination_ip": "::ffff:172.20.9.1", "destination_port": 8443, "event_id": "flow/77",
               "attributes": {"packets": 12, "tls": False}}
    return parse(spark, [
        raw(1, "linux_auth", f"Mar  8 21:07:45 {ssh}"),
        raw(2, "linux_auth", f"2026-03-08T14:07:45.5-07:00 {ssh}\r"),
        raw(3, "linux_auth", f"Mar  8 18:07:45 {ssh}", zone="America/Sao_Paulo"),
        raw(4, "linux_auth", f"Nov 30 06:15:00 {ssh}", received=datetime(2026, 2, 1, tzinfo=UTC)),
        raw(5, "linux_auth", "Mar  8 21:09:00 relay7 sudo:  olga : TTY=tty2 ; PWD=/opt/jobs ; USER=postgres ; COMMAND=/usr/bin/psql -l"),
        raw(6, "linux_auth", "Mar  8 21:09:00 relay7 sudo: temp : user NOT in sudoers ; TTY=tty3 ; PWD=/ ; USER=root ; COMMAND=/bin/mount k=v"),
        raw(7, "linux_auth", "Mar  8 21:09:00 relay7 su[640]: FAILED SU (to postgres) olga on tty2"),
        raw(8, "linux_auth", "Mar  8 21:09:00 relay7 useradd[77]: new user: name=pavel, UID=2040, GID=100, home=/srv/pavel, shell=/bin/zsh, from=/dev/tty2"),
        raw(9, "linux_auth", "Mar  8 21:09:00 relay7 usermod[78]: add 'pavel' to group 'adm'"),
        raw(10, "linux_auth", "Mar  8 21:09:00 relay7 sshd[89]: Connection closed by 198.18.0.3 port 61000 [preauth]"),
        raw(11, "linux_auth", "Mar  8 21:09:00 relay7 CRON[90]: (olga) CMD (/opt/jobs/nightly)"),
        raw(12, "linux_auth", "-- MARK --"),
        raw(13, "linux_auth", "Mrz  8 21:09:00 relay7 sshd[91]: text"),
        raw(14, "linux_auth", b"Mar  8 \xc3\x28"),
        raw(15, "linux_auth", "Mar  8 21:09:00 relay,7 sshd[92]: Accepted password for olga from 198.18.0.3 port 61001 ssh2"),
        raw(16, "linux_auth", "Mar  8 21:09:00 relay7 sudo: temp : 2 incorrect password attempts ; TTY=tty3 ; PWD=/ ; USER=root ; COMMAND=/bin/mount"),
        raw(17, "linux_auth", "Mar  8 21:09:00 relay7 gpasswd[93]: user pavel added by olga to group docker"),
        raw(20, "windows_security", win(4625, TargetUserName="Olga", TargetDomainName="LAB", LogonType=10, IpAddress="198.18.0.3", IpPort="61002", Status="0xc0000234")),
        raw(21, "windows_security", win(4720, SubjectUserName="helpdesk", TargetUserName="pavel", TargetSid="S-1-5-21-7-1105")),
        raw(22, "windows_security", win(4732, SubjectUserName="helpdesk", TargetUserName="Backup Operators", MemberName="-", MemberSid="S-1-5-21-7-1105")),
        raw(23, "windows_security", {"EventID": 4624, "TimeCreated": "/Date(1772985600007)/", "Computer": "lab", "EventData": {}}),
        raw(24, "windows_security", win(4688, NewProcessName="D:\\tools\\CertUtil.exe", CommandLine="certutil -urlcache x", SubjectUserName="pavel")),
        raw(25, "windows_security", win(5)),
        raw(26, "windows_security", {"Computer": "lab"}),
        raw(27, "windows_security", "17"),
        raw(28, "windows_security", '{"EventID": 4624,'),
        raw(29, "windows_security", {"EventID": 4624, "TimeCreated": "2026-03-08 21:07", "Computer": "lab"}),
        raw(30, "http_access", '198.18.0.3 - olga [08/Mar/2026:21:07:45 +0000] "PUT /files/a.txt?v=2&w=3 HTTP/2.0" 403 91 "-" "uploader/3 (test)"'),
        raw(31, "http_access", '198.18.0.3 - - [08/Mar/2026:21:07:45 -0330] "OPTIONS * HTTP/1.0" 204 - "-" "-"'),
        raw(32, "http_access", '198.18.0.3 - - [08/Mar/2026:21:07:45 +0000] "\\x00\\x01" 400 0 "-" "-"'),
        raw(33, "http_access", "198.18.0.3 21:07"),
        raw(40, "app_json", {"ts": "2026-03-08T21:07:45Z", "event": "login_failure", "user": "Olga@lab.example", "ip": "198.18.0.3", "app": "wiki", "detail": "locked"}),
        raw(41, "app_json", {"ts": "2026-03-08T21:07:45Z", "event": "page_viewed"}),
        raw(42, "app_json", {"ts": "08.03.2026 21:07", "event": "logout"}),
        raw(43, "app_json", {"ts": "2026-03-08T21:07:45Z", "app": "wiki"}),
        raw(44, "app_json", {"ts": "2026-03-08T21:07:45Z", "event": "role_changed", "user": "LAB\\Olga", "target_user": "pavel@y"}),
        raw(50, "generic_json", generic),
        raw(51, "generic_json", {**generic, "colour": "red"}),
        raw(52, "generic_json", {**generic, "event_action": "user_created"}),
        raw(53, "generic_json", {**generic, "attributes": {"nested": {"k": 1}}}),
        raw(54, "generic_json", {**generic, "destination_port": -1}),
        raw(55, "generic_json", {**generic, "source_ip": "172.20.4"}),
        raw(56, "generic_json", {**generic, "host": ["lab-pc"]}),
        raw(57, "generic_json", {**generic, "timestamp": "yesterday"}),
        raw(58, "generic_json", {**generic, "username": "pa\tvel"}),
    ])


def test_every_record_has_one_outcome(parsed):
    codes = {n: (r.parse_status, r.parse_detail) for n, r in parsed.items() if r.parse_status != "PARSED"}
    assert codes == {
        10: ("SKIPPED", "sshd_informational"), 11: ("SKIPPED", "not_security_relevant"),
        12: ("FAILED", "unrecognized_format"), 13: ("FAILED", "invalid_timestamp"), 14: ("FAILED", "not_utf8"),
        15: ("FAILED", "invalid_field"), 25: ("SKIPPED", "unsupported_event_id"), 26: ("FAILED", "missing_event_id"),
        27: ("FAILED", "not_a_json_object"), 28: ("FAILED", "invalid_json"), 29: ("FAILED", "invalid_timestamp"),
        33: ("FAILED", "unrecognized_format"), 41: ("FAILED", "unknown_event_type"), 42: ("FAILED", "invalid_timestamp"),
        43: ("FAILED", "missing_event_type"), 51: ("FAILED", "invalid_event"), 52: ("FAILED", "invalid_event"),
        53: ("FAILED", "invalid_event"), 54: ("FAILED", "invalid_event"), 55: ("FAILED", "invalid_event"),
        56: ("FAILED", "invalid_event"), 57: ("FAILED", "invalid_event"), 58: ("FAILED", "invalid_event"),
    }


def test_linux_auth(parsed):
    r = parsed[1]
    assert (r.event_category, r.event_action, r.event_outcome) == ("authentication", "logon", "failure")
    assert (r.host, r.username, r.source_ip, r.source_port) == ("relay7", "backup", "2001:db8::5", 1025)
    assert (r.service, r.protocol, r.session_id) == ("sshd", "ssh", "88")
    assert r.attributes == {"auth_method": "publickey", "invalid_user": "true"}
    assert at(r) == at(parsed[3]) == "2026-03-08 21:07:45" and at(parsed[2]) == "2026-03-08 21:07:45.500000"
    assert at(parsed[4]) == "2025-11-30 06:15:00"  # a month later than the receipt is one of the year before
    r = parsed[5]
    assert (r.event_action, r.event_outcome, r.username, r.target_username) == ("sudo", "success", "olga", "postgres")
    assert r.command_line == "/usr/bin/psql -l" and r.attributes == {"tty": "tty2", "working_directory": "/opt/jobs"}
    assert parsed[6].command_line == "/bin/mount k=v" and parsed[6].attributes["failure_reason"] == "not_in_sudoers"
    r = parsed[7]
    assert (r.event_action, r.event_outcome, r.username, r.target_username) == ("su", "failure", "olga", "postgres")
    assert (parsed[8].event_action, parsed[8].target_username) == ("user_created", "pavel")
    assert parsed[8].attributes == {"uid": "2040", "shell": "/bin/zsh"}
    assert parsed[9].event_action == "group_member_added" and parsed[9].attributes == {"group_name": "adm"}
    assert parsed[16].event_outcome == "failure" and parsed[16].attributes["attempts"] == "2"
    assert (parsed[17].username, parsed[17].target_username) == ("olga", "pavel")


def test_windows_security(parsed):
    r = parsed[20]
    assert (r.username, r.user_domain, r.host, r.event_outcome, r.source_ip, r.source_port) == (
        "olga", "lab", "lab-pc", "failure", "198.18.0.3", 61002)
    assert r.attributes["event_id"] == "4625" and r.attributes["record_id"] == "31"
    assert at(r) == "2026-03-08 21:07:45.765432" and r.message == "Failed logon (type 10)"
    assert parsed[21].attributes["target_sid"] == parsed[22].attributes["target_sid"] == "S-1-5-21-7-1105"
    assert parsed[22].target_username is None and parsed[22].attributes["group_name"] == "Backup Operators"
    assert at(parsed[23]) == "2026-03-08 16:00:00.007000"
    assert (parsed[24].process_name, parsed[24].event_action) == ("certutil.exe", "process_started")


def test_http_access(parsed):
    r = parsed[30]
    assert (r.event_outcome, r.username, r.host, r.message) == ("failure", "olga", "app-01", "PUT /files/a.txt 403")
    assert r.attributes == {"http_method": "PUT", "url_path": "/files/a.txt", "url_query": "v=2&w=3", "http_version": "HTTP/2.0",
                            "http_status": "403", "response_bytes": "91", "user_agent": "uploader/3 (test)"}
    assert at(parsed[31]) == "2026-03-09 00:37:45" and "response_bytes" not in parsed[31].attributes
    assert parsed[32].attributes["request_line"] == "\\x00\\x01" and "http_method" not in parsed[32].attributes


def test_json_formats(parsed):
    r = parsed[40]
    assert (r.username, r.user_domain, r.service, r.host, r.message) == ("olga", "lab.example", "wiki", "app-01", "login_failure")
    assert (parsed[44].username, parsed[44].user_domain, parsed[44].target_username) == ("olga", "lab", "pavel")
    r = parsed[50]
    assert (r.source_type, r.destination_ip, r.destination_port, r.event_outcome) == ("generic_json", "172.20.9.1", 8443, "unknown")
    assert r.attributes == {"packets": "12", "tls": "false"}


def test_ingest_keeps_one_copy_and_counts_the_rest(spark):
    line = "Mar  8 21:07:45 {} sshd[88]: Failed password for olga from 198.18.0.3 port 61003 ssh2"
    rows = [raw(i, "", line.format("relay7")) for i in range(5)] + [raw(5, "", line.format("relay8")), raw(6, "", "x" * 70000), raw(7, "", "?")]
    records = spark.createDataFrame(rows, RAW_SCHEMA)
    sources = spark.createDataFrame([("s1", "linux_auth", "UTC", None, ["relay7"])], "id string, source_type string, timezone string, default_host string, allowed_hosts array<string>")
    assets = spark.createDataFrame([("m4", "relay7.lab.example", ["172.20.1.7"], "high")], "id string, hostname string, ip_addresses array<string>, criticality string")
    people = spark.createDataFrame([("p9", "olga", "privileged")], "id string, username string, privilege_level string")
    received, out, events = ingest(records, sources, assets, people)
    r = batch_report(received, out).first()
    assert (r.received, r.parsed, r.skipped, r.failed, r.duplicate, r.rejected) == (8, 1, 0, 2, 4, 1)
    assert [(i["index"], i["code"]) for i in r.issues] == [(5, "host_not_allowed"), (6, "record_too_large"), (7, "unrecognized_format")]
    e = events.first()
    assert (e.asset_id, e.asset_criticality, e.identity_privileged, e.source_ip_scope) == ("m4", "high", True, "external")
    again = ingest(records, sources, assets, people, stored=out.select("fingerprint"))
    assert again[1].count() == 0


def test_lines_of_any_length_neither_fail_the_job_nor_lose_text(spark):
    path, agent = "/find/" + "q" * 60_000, "tool " + r"a\"b\\c " * 8_000
    start = "198.51.100.7 - kim [02/Mar/2026:08:15:00 +0000]"
    rows = parse(spark, [
        raw(1, "http_access", f'{start} "GET {path} HTTP/1.1" 200 17 "-" "{agent}"'),
        raw(2, "http_access", f'{start} "' + "\\" * 60_000),
        raw(3, "http_access", f'{start} "' + r"\"" * 30_000 + '" 400 - "-" "-"'),
        raw(4, "linux_auth", "Mar  2 08:15:00 gate-02 sudo:  kim : TTY=pts/3 ; PWD=/srv ; USER=root ; COMMAND=/bin/echo " + "z" * 50_000),
        raw(5, "linux_auth", "(" * 60_000), raw(6, "app_json", "{" * 60_000), raw(7, "generic_json", "[" * 60_000),
        raw(8, "windows_security", '{"EventID": ' + "9" * 60_000),
    ])
    assert rows[1].parse_status == "PARSED" and rows[1].attributes["url_path"] == path
    assert rows[1].attributes["user_agent"] == agent.strip()
    assert rows[3].parse_status == "PARSED" and rows[3].attributes["request_line"] == r"\"" * 30_000
    assert rows[4].parse_status == "PARSED" and rows[4].command_line == "/bin/echo " + "z" * 50_000
    assert {rows[n].parse_status for n in (2, 5, 6, 7, 8)} <= {"FAILED", "SKIPPED"}
