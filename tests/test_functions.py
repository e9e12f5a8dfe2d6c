"""Column helpers against the Python standard library and plain restatements."""

import ipaddress
import random
from datetime import UTC, datetime, timedelta

import pytest
from frames import T0, event, frame
from pyspark.sql import functions as F

from emberwatch.functions import allowlist, net, text
from emberwatch.functions.conditions import apply_exclusions, compile_condition, holds

ADDRESSES = [
    "10.0.2.42", "192.168.1.10", "172.31.0.1", "172.32.0.1", "127.0.0.1", "169.254.10.1", "203.0.113.45", "8.8.8.8", "::1",
    "fd12::1", "fe80::1", "2001:db8::1", "2001:DB8:0:0:1:0:0:1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::", "::ffff:10.0.2.42",
    "1:0:0:2:0:0:0:3", "64:ff9b::192.0.2.33", "256.1.1.1", "01.2.3.4", "1.2.3", "1::2::3", "12345::", ":::", "a:b", "x", "", "1:2:3:4:5:6:7:8:9",
]
NETWORKS = ["10.0.0.0/8", "172.16.0.0/12", "203.0.113.45/32", "0.0.0.0/0", "fc00::/7", "2001:db8::/32", "::/0", "10.0.2.40/29"]
INTERNAL = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7"]


def address(value):
    try:
        return ipaddress.ip_address(value)
    except ValueError:
        return None


def test_addresses(spark):
    df = spark.createDataFrame([(a,) for a in ADDRESSES], "a string")
    a = F.col("a")
    rows = df.select(
        "a", net.canonical_ip(a).alias("canon"), net.to_network(a).alias("net"), net.valid_ip(a).alias("ok"), net.ip_scope(a, INTERNAL).alias("scope"),
        *[net.in_cidr(a, n).alias(n) for n in NETWORKS],
    ).collect()
    for r in rows:
        ip = address(r.a)
        assert r.ok == (ip is not None), r.a
        plain = ip and (getattr(ip, "ipv4_mapped", None) or ip)
        assert r.canon == (None if ip is None else str(plain)), r.a
        want = None if ip is None else str(ipaddress.ip_network(f"{ip}/{24 if ip.version == 4 else 64}", strict=False))
        assert r.net == want, r.a
        for n in NETWORKS:
            wide = ipaddress.ip_network(n)
            assert r[n] == (ip is not None and ip.version == wide.version and ip in wide), (r.a, n)
        if ip is not None:
            scope = "loopback" if ip.is_loopback else "link_local" if ip.is_link_local else "external"
            if scope == "external" and any(ip.version == ipaddress.ip_network(n).version and ip in ipaddress.ip_network(n) for n in INTERNAL):
                scope = "internal"
            assert r.scope == scope, r.a


NAMES = ["root", "ROOT", "Straße", "strasse", "ſvc", "svc", "İnci", "ınci", "a_b", "a%b", "ab", "back\\slash", "", None]


def fold(v):
    return "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in v)


@pytest.mark.parametrize("value", ["root", "SVC", "a_b", "a%b", "strasse", "k\\S", "inci"])
def test_text_conditions_fold_ascii_only(spark, value):
    rows = frame(spark, [event(i, message=n) for i, n in enumerate(NAMES)])
    tests = {
        "eq": lambda n: n is not None and fold(n) == fold(value), "ne": lambda n: n is None or fold(n) != fold(value),
        "contains": lambda n: n is not None and fold(value) in fold(n), "startswith": lambda n: n is not None and fold(n).startswith(fold(value)),
        "endswith": lambda n: n is not None and fold(n).endswith(fold(value)),
    }
    for op, want in tests.items():
        cond = {"field": "message", "op": op, "value": value}
        for negate in (False, True):
            got = {r.id for r in rows.filter(compile_condition({"not": cond} if negate else cond)).collect()}
            assert got == {f"e{i:06d}" for i, n in enumerate(NAMES) if want(n) != negate}, (op, negate)


def test_conditions_are_two_valued_and_bounded(spark):
    rows = frame(spark, [event(1, username=None), event(2, username=""), event(3, destination_port=22, identity_privileged=True)])
    ids = lambda c: sorted(int(r.id[1:]) for r in rows.filter(compile_condition(c)).collect())
    p = lambda f, o, v=None: {"field": f, "op": o, "value": v}
    assert ids(p("username", "exists", False)) == [1, 2] and ids({"not": p("username", "exists")}) == [1, 2]
    assert ids(p("destination_port", "gte", 22)) == [3] and ids({"not": p("destination_port", "lt", 30)}) == [1, 2]
    assert ids(p("identity_privileged", "eq", True)) == [3] and ids(p("identity_privileged", "ne", True)) == [1, 2]
    assert ids(p("username", "not_in", ["root"])) == [1, 2] and ids(p("attributes.x", "exists", False)) == [1, 2, 3]
    assert ids({"not": {"not": {"not": {"not": p("username", "exists")}}}}) == ids(p("username", "exists"))
    for bad in (p("nope", "eq", 1), p("username", "gt", 1), p("username", "cidr", "10.0.0.0/8"), p("username", "in", []), p("username", "like", "x"),
                {"all": []}):
        with pytest.raises(ValueError):
            compile_condition(bad)


def test_exclusions(spark):
    rows = frame(spark, [event(1, 0), event(2, 100), event(3, 200, source_ip=None), event(4, 0, username="Other")])
    kept = lambda *e: [int(r.id[1:]) for r in apply_exclusions(rows, list(e)).orderBy("id").collect()]
    assert kept({"field": "source_ip", "value": "203.0.113.0/24"}) == [3]
    assert kept({"field": "username", "value": "OTHER"}) == [1, 2, 3]
    window = {"active_from": T0, "active_until": T0 + timedelta(seconds=100)}
    assert kept({"field": "host", "value": "web-01", **window}) == [2, 3]
    assert kept({"field": "host", "value": "x", "active_from": T0, "active_until": T0 + timedelta(days=91)}) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        kept({"field": "host", "value": "x", "active_from": T0})
    assert rows.select(holds({"field": "source_ip", "op": "cidr", "value": "203.0.113.0/24"}).alias("h")).filter("h is null").count() == 0


def test_ten_thousand_entries_cover_what_each_of_them_covers(spark):
    pick = random.Random(8)
    v4 = lambda: f"198.{pick.randrange(4)}.{pick.randrange(9)}.{pick.randrange(256)}"
    v6 = lambda: f"2001:db8:{pick.randrange(9):x}::{pick.randrange(40):x}"
    at = lambda: T0 + timedelta(seconds=pick.randrange(900))
    entries = []
    for _ in range(10_000):
        start = at() if pick.random() < 0.5 else None
        window = {"active_from": start, "active_until": start + timedelta(seconds=pick.randint(1, 90))} if start else {}
        name, value = pick.choice([
            ("source_ip", f"{v4()}/{pick.choice([30, 31, 32])}"), ("source_ip", f"{v6()}/{pick.choice([125, 127, 128])}"),
            ("source_ip", v4()), ("username", f"U{pick.randrange(60_000)}"), ("host", f"h{pick.randrange(60_000)}"),
        ])
        entries.append({"field": name, "value": value, **window})
    ips = [None, "junk", "::ffff:198.1.1.1", *[v4() for _ in range(250)], *[v6() for _ in range(250)]]
    given = [(str(k), pick.choice(ips), f"u{pick.randrange(60_000)}", f"H{pick.randrange(60_000)}", pick.choice([None, at()])) for k in range(400)]
    rows = spark.createDataFrame(given, "id string, source_ip string, username string, host string, timestamp timestamp")
    rows = rows.withColumns({"target_username": F.lit(None).cast("string"), "value": F.lit("kept"), "bits": F.lit(1)})

    def parsed(text, kind):
        try:
            return kind(text) if text else None
        except ValueError:
            return None

    nets = [(e, ipaddress.ip_network(e["value"], strict=False)) for e in entries if e["field"] == "source_ip"]
    named = {}
    for e in entries:
        if e["field"] != "source_ip":
            named.setdefault((e["field"], e["value"].lower()), []).append(e)

    def covered(r):
        ip, when = parsed(r[1], ipaddress.ip_address), r[4]
        hits = [e for e, n in nets if ip is not None and ip in n] + named.get(("username", r[2]), []) + named.get(("host", r[3].lower()), [])
        return any("active_from" not in e or (when is not None and e["active_from"] <= when < e["active_until"]) for e in hits)

    left = apply_exclusions(rows, entries)
    want = {r[0] for r in given if not covered(r)}
    assert left.columns == rows.columns and {r.id for r in left.collect()} == want and 20 < len(want) < 380
    plan = lambda some: apply_exclusions(rows, some)._jdf.queryExecution().analyzed().toString().count("LeftAnti")
    assert plan(entries) == plan(entries[:2000]) == 8
    none = spark.createDataFrame([], allowlist.SCHEMA)
    assert allowlist.exclude_listed(rows, none).count() == 400
    for bad in [("source_ip", "198.0.0.0/33"), ("source_ip", "x"), ("colour", "x"), ("host", None)]:
        with pytest.raises(ValueError):
            allowlist.exclude_listed(rows, spark.createDataFrame([(*bad, None, None)], allowlist.SCHEMA))


def test_durations_and_masks(spark):
    spans = {0: "0 s", 38: "38 s", 60: "1 min", 300: "5 min", 330: "5 min 30 s", 7500: "2 h 5 min", 3601: "1 h", 86400: "1 day", 1209600: "14 days"}
    df = spark.createDataFrame([(s,) for s in spans], "s long")
    assert {r.s: r.t for r in df.select("s", text.duration_text(F.col("s") * 1_000_000).alias("t")).collect()} == spans
    lines = ["Authorization: Bearer abc.DEF-1", "postgres://u:secret@h/db", 'password="x" token=y', "eyJhbGci.eyJzdWI.sig done", "plain"]
    got = [r.t for r in spark.createDataFrame([(x,) for x in lines], "l string").select(text.redact(F.col("l")).alias("t")).collect()]
    assert got == ["Authorization: Bearer [REDACTED]", "postgres://u:[REDACTED]@h/db", 'password="[REDACTED]" token=[REDACTED]', "[REDACTED_JWT] done", "plain"]


def test_iso_timestamps(spark):
    good = {"2026-09-25T10:31:02.1234567Z": 123456, "2026-09-25T16:01:02+0530": 0, "2026-09-25T16:01:02+05:30": 0, "2026-09-25t10:31:02z": 0}
    bad = ["2026-09-25T10:31:02", "2026-13-25T10:31:02Z", "x", "-", None]
    df = spark.createDataFrame([(x,) for x in [*good, *bad]], "t string")
    got = {r.t: r.u for r in df.select("t", F.unix_micros(text.iso_timestamp(F.col("t"))).alias("u")).collect()}
    base = int(datetime(2026, 9, 25, 10, 31, 2, tzinfo=UTC).timestamp()) * 1_000_000
    assert got == {**{t: base + f for t, f in good.items()}, **{t: None for t in bad}}
