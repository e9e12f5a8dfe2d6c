"""Five log formats parsed into event columns, each as one projection over a whole table.

Input: RAW_SCHEMA rows. Output: the same rows with the event columns, `parse_status` (PARSED, SKIPPED
or FAILED) and `parse_detail` (why). A record never fails the job: everything that can go wrong
is a null that becomes a code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions import text as X
from emberwatch.functions.net import canonical_ip, optional_ip, valid_ip
from emberwatch.schema import (
    ACTIONS,
    ATTRS,
    IP_FIELDS,
    OUTCOMES,
    PARSED,
    PARSED_NAMES,
    PORT_FIELDS,
)

SEP = "\x1f"

# The line shapes, message shapes and names the formats consist of.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
SYSLOG_LINE = (
    r"^(?:([A-Z][a-z]{2}) {1,2}(\d{1,2}) (\d{2}:\d{2}:\d{2})"
    r"|(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})))"
    r" ([^\s\x1c-\x1f:]{1,253}) ([A-Za-z0-9_./-]{1,64})(?:\[(\d{1,10})\])?: (.*)$"
)
SSH_AUTH = (
    r"^(Failed|Accepted) (password|publickey|keyboard-interactive/pam|hostbased|gssapi-with-mic) for "
    r"(invalid user )?(\S*) from (\S+) port (\d{1,5})(?: ssh2)?(?:: .*)?$"
)
SSH_CLOSED = r"^pam_unix\(sshd:session\): session closed for user (\S+)$"
SSH_NOISE = [
    "Invalid user ",
    "Connection closed by ",
    "Connection reset by ",
    "Disconnected from ",
    "Received disconnect from ",
    "pam_unix(sshd:session): session opened",
    "pam_unix(sshd:auth): authentication failure",
    "PAM ",
    "error: maximum authentication attempts exceeded",
    "Server listening on ",
]
SUDO = r"^\s*([^\s:;]{1,256}) : (.*)$"
SUDO_ATTEMPTS = r"^(\d{1,3}) incorrect password attempts?$"
SU = r"^(FAILED SU )?\(to ([^)\s]{1,256})\) (\S+) on (\S+)$"
GROUP_ADD = r"^add '([^']+)' to group '([^']+)'$"
GPASSWD_ADD = r"^user (\S+) added by (\S+) to group (\S+)$"
USER_DELETE = r"^delete user '([^']+)'$"
PASSWORD_CHANGED = r"^pam_unix\(passwd:chauthtok\): password changed for (\S+)$"
ACCOUNT_PROGRAMS = ["useradd", "usermod", "userdel", "gpasswd", "groupadd", "passwd", "chpasswd"]
# Escapes are out of the way (see _unescaped), so text in quotes is one run of any length.
QUOTED = r'[^"]*+'
ACCESS_LINE = (
    r"^(\S{1,45}) (\S++) (\S++) \[([^\]]{1,40})\] "
    rf'"({QUOTED})" (\d{{3}}) (\d{{1,15}}|-)(?: "({QUOTED})" "({QUOTED})")?(?: .*)?$'
)
REQUEST = r"^([A-Z]{1,16}) (\S++) (HTTP/\d(?:\.\d)?)$"
ACCESS_TIME = r"^(\d{1,2})/([A-Z][a-z]{2})/(\d{4}):(\d{1,2}):(\d{1,2}):(\d{1,2}) ([+-]\d{2}):?(\d{2})$"
LOGON_TYPES = {
    2: "interactive",
    3: "network",
    4: "batch",
    5: "service",
    7: "unlock",
    8: "network_cleartext",
    9: "new_credentials",
    10: "remote_interactive",
    11: "cached_interactive",
}
APP_EVENTS = {
    "login_success": ("authentication", "logon", "success"),
    "login_failure": ("authentication", "logon", "failure"),
    "logout": ("authentication", "logoff", "success"),
    "password_change": ("iam", "password_changed", "success"),
    "user_created": ("iam", "user_created", "success"),
    "role_changed": ("iam", "user_modified", "success"),
    "config_changed": ("application", "config_changed", "success"),
    "admin_action": ("application", "app_event", "success"),
    "access_denied": ("application", "app_event", "failure"),
}
HOSTNAME = (
    r"^(?=.{1,253}$)[a-z0-9_](?:[a-z0-9_-]{0,61}[a-z0-9_])?"
    r"(?:\.[a-z0-9_](?:[a-z0-9_-]{0,61}[a-z0-9_])?)*$"
)
ATTRIBUTE_KEY = r"^[a-z][a-z0-9_]{0,63}$"


def groups(c: Column, pattern: str, n: int) -> Column:
    """All groups of an anchored pattern from one regex pass (missing ones are ""), null if it does
    not match. The last group may hold anything, the others never hold the separator."""
    pattern = "(?d)" + pattern
    joined = F.regexp_replace(c, pattern, SEP.join(f"${i}" for i in range(1, n + 1)))
    return F.when(c.rlike(pattern), F.split(joined, SEP, n))


def part(name: str, i: int) -> Column:
    """Group i of a captured array, null when empty."""
    return X.blank_to_null(F.get(name, F.lit(i - 1)))


def attributes(**values: Column) -> Column:
    pairs = [x for name, value in values.items() for x in (F.lit(name), value.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def with_first_of(df: DataFrame, *cases: tuple[Column, dict[str, Column]]) -> DataFrame:
    """Adds `_case`, the number of the first case that applies, and every event column from it."""
    number = F.lit(None).cast("int")
    for i, (test, _) in reversed(list(enumerate(cases))):
        number = F.when(test, F.lit(i)).otherwise(number)
    out = {}
    for name, kind in PARSED:
        value = F.lit(None).cast(kind)
        for i, (_, fields) in enumerate(cases):
            if name in fields:
                value = F.when(F.col("_case") == i, fields[name].cast(kind)).otherwise(value)
        out[name] = value
    return df.withColumn("_case", number).withColumns(out)


def _lit(**values: str) -> dict[str, Column]:
    return {k: F.lit(v) for k, v in values.items()}


def _decoded(df: DataFrame) -> DataFrame:
    raw = F.col("raw_data").cast("string")
    return df.withColumn("_text", F.when(F.is_valid_utf8(raw), raw))


def _line(df: DataFrame) -> DataFrame:
    return _decoded(df).withColumn("_text", F.regexp_replace("_text", "[\r\n]+$", ""))


def _finish(df: DataFrame, names: list[str], source_type: str, failed: Column, skipped: Column) -> DataFrame:
    """Status columns, in order: unreadable, failed, skipped, parsed."""
    failed = F.when(F.col("_text").isNull(), F.lit("not_utf8")).otherwise(failed)
    df = df.withColumn("_failed", failed).withColumn(
        "_skipped", F.when(F.col("_failed").isNull(), skipped)
    )
    detail = F.coalesce("_failed", "_skipped")
    status = (
        F.when(F.col("_failed").isNotNull(), F.lit("FAILED"))
        .when(F.col("_skipped").isNotNull(), F.lit("SKIPPED"))
        .otherwise(F.lit("PARSED"))
    )
    done = df.withColumns({"parse_status": status, "parse_detail": detail, "source_type": F.lit(source_type)})
    extra = [c for c in PARSED_NAMES if c not in names]
    return settled(done, names, [*extra, "parse_status", "parse_detail"])


def settled(df: DataFrame, kept: list[str], computed: list[str]) -> DataFrame:
    """The computed columns as the output of a one-row generator. A filter on them (a status, a
    category) then stays above instead of being rewritten into a copy of the whole parser."""
    return df.select(*kept, F.inline(F.array(F.struct(*computed))))


# ---------- linux_auth ----------


def syslog_timestamp(month: Column, day: Column, clock: Column, received: Column, zone: Column) -> tuple[Column, Column]:
    """(timestamp, code): a syslog time without year or zone, in the zone of its source. More than a
    day ahead of the receive time means last year."""
    wall = F.from_utc_timestamp(received, zone)
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), month).cast("int")
    h, m, s = (F.split_part(clock, F.lit(":"), F.lit(i)).cast("int") for i in (1, 2, 3))
    in_year = lambda y: F.when(
        (number > 0) & (s < 60), F.try_make_timestamp(y, number, day.cast("int"), h, m, s.cast("decimal(8,6)"))
    )
    this, last = in_year(F.year(wall)), in_year(F.year(wall) - 1)
    ahead = this > wall + F.expr("interval 1 day")
    local = F.when(ahead, last).otherwise(this)
    code = F.when(this.isNull(), F.lit("invalid_timestamp")).when(local.isNull(), F.lit("parser_error"))
    return F.to_utc_timestamp(local, zone), code


def _linux_auth(df: DataFrame) -> DataFrame:
    names = df.columns
    rows = _line(df).withColumn("_h", groups(F.col("_text"), SYSLOG_LINE, 8))
    rows = rows.withColumns(
        {
            "_program": F.lower(F.get("_h", F.lit(5))),
            "_message": F.get("_h", F.lit(7)),
            "_iso": X.iso_timestamp(part("_h", 4)),
        }
    )
    syslog, code = syslog_timestamp(part("_h", 1), part("_h", 2), part("_h", 3), F.col("received_at"), F.col("timezone"))
    has_iso = part("_h", 4).isNotNull()
    rows = rows.withColumns(
        {
            "_time": F.when(has_iso, F.col("_iso")).otherwise(syslog),
            "_time_code": F.when(
                has_iso, F.when(F.col("_iso").isNull(), F.lit("invalid_timestamp"))
            ).otherwise(code),
        }
    )
    p, msg = F.col("_program"), F.col("_message")
    when = lambda test, pattern, n: F.when(test, groups(msg, pattern, n))
    account = p.isin(ACCOUNT_PROGRAMS)
    rows = rows.withColumns(
        {
            "_auth": when(p == "sshd", SSH_AUTH, 6),
            "_closed": when(p == "sshd", SSH_CLOSED, 1),
            "_sudo": when((p == "sudo") & ~msg.startswith("pam_unix(sudo:"), SUDO, 2),
            "_su": when((p == "su") & ~msg.startswith("pam_unix(su"), SU, 4),
            "_add": when(account, GROUP_ADD, 2),
            "_gp": when(account, GPASSWD_ADD, 3),
            "_del": when(account, USER_DELETE, 1),
            "_pw": when(account, PASSWORD_CHANGED, 1),
        }
    )
    listed = lambda c, sep: F.split(c, sep)
    pairs = lambda items: F.map_from_entries(
        F.transform(
            _last_per_key(F.filter(items, lambda x: x.contains("="))),
            lambda x: F.struct(F.substring_index(x, "=", 1), F.regexp_replace(x, r"(?s)^[^=]*=", "")),
        )
    )
    sudo_parts = F.transform(listed(F.get("_sudo", F.lit(1)), " ; "), X.strip)
    new_user = account & msg.startswith("new user: ")
    rows = rows.withColumns(
        {
            "_sf": pairs(sudo_parts),
            "_sr": F.filter(sudo_parts, lambda x: ~x.contains("=")),
            "_nf": F.when(new_user, pairs(listed(F.substring(msg, 11, 1_000_000), ", "))),
        }
    )
    of = lambda m, k: F.try_element_at(F.col(m), F.lit(k))
    attempts = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter("_sr", lambda x: x.rlike(SUDO_ATTEMPTS))), -1)
    # The last reason names the failure, as they are read in order.
    named = F.transform(
        F.col("_sr"),
        lambda x: F.when(x.rlike(SUDO_ATTEMPTS), F.lit("incorrect_password"))
        .when(x == "user NOT in sudoers", F.lit("not_in_sudoers"))
        .when(x.startswith("command not allowed"), F.lit("command_not_allowed")),
    )
    reason = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.array_compact(named)), -1)
    uid = of("_nf", "UID")
    sudo_ok = F.col("_sudo").isNotNull() & of("_sf", "COMMAND").isNotNull()
    new_ok = new_user & X.clean(of("_nf", "name")).isNotNull()
    auth, closed, su = (F.col(c).isNotNull() for c in ("_auth", "_closed", "_su"))
    add, gp, gone, pw = (F.col(c).isNotNull() & ~new_user for c in ("_add", "_gp", "_del", "_pw"))
    common = {
        "timestamp": F.col("_time"), "host": part("_h", 5), "service": p, "process_name": p,
        "session_id": part("_h", 7), "message": msg,
    }
    iam = lambda action, **more: {
        **common, **_lit(event_category="iam", event_action=action, event_outcome="success"), **more,
    }
    rows = with_first_of(
        rows,
        (
            auth,
            {
                **common,
                **_lit(event_category="authentication", event_action="logon", protocol="ssh"),
                "event_outcome": F.when(part("_auth", 1) == "Accepted", F.lit("success")).otherwise(F.lit("failure")),
                "username": part("_auth", 4),
                "source_ip": optional_ip(part("_auth", 5)),
                "source_port": X.optional_port(part("_auth", 6)),
                "attributes": attributes(
                    auth_method=part("_auth", 2), invalid_user=part("_auth", 3).isNotNull()
                ),
            },
        ),
        (
            closed,
            {
                **common,
                **_lit(event_category="authentication", event_action="logoff", event_outcome="success", protocol="ssh"),
                "username": part("_closed", 1),
            },
        ),
        (
            sudo_ok,
            {
                **common,
                **_lit(event_category="privilege", event_action="sudo"),
                "event_outcome": F.when(reason.isNull(), F.lit("success")).otherwise(F.lit("failure")),
                "username": part("_sudo", 1),
                "target_username": X.clean(of("_sf", "USER")),
                "command_line": X.clean(of("_sf", "COMMAND")),
                "attributes": attributes(
                    tty=X.clean(of("_sf", "TTY")),
                    working_directory=X.clean(of("_sf", "PWD")),
                    failure_reason=reason,
                    attempts=F.regexp_extract(attempts, SUDO_ATTEMPTS, 1).try_cast("int"),
                ),
            },
        ),
        (
            su,
            {
                **common,
                **_lit(event_category="privilege", event_action="su"),
                "event_outcome": F.when(part("_su", 1).isNotNull(), F.lit("failure")).otherwise(F.lit("success")),
                "username": part("_su", 3),
                "target_username": part("_su", 2),
                "attributes": attributes(tty=part("_su", 4)),
            },
        ),
        (
            new_ok,
            iam(
                "user_created",
                target_username=of("_nf", "name"),
                attributes=attributes(
                    uid=F.when(uid.rlike(r"^\d+$"), uid.try_cast("bigint")), shell=X.clean(of("_nf", "shell"))
                ),
            ),
        ),
        (add, iam("group_member_added", target_username=part("_add", 1), attributes=attributes(group_name=part("_add", 2)))),
        (
            gp,
            iam("group_member_added", username=part("_gp", 2), target_username=part("_gp", 1),
                attributes=attributes(group_name=part("_gp", 3))),
        ),
        (gone, iam("user_deleted", target_username=part("_del", 1))),
        (pw, iam("password_changed", target_username=part("_pw", 1))),
    )
    noise = reduce(lambda a, b: a | b, [msg.startswith(n) for n in SSH_NOISE])
    skipped = F.when(
        F.col("_case").isNull(),
        F.when(p == "sshd", F.when(noise, F.lit("sshd_informational")).otherwise(F.lit("unmodelled_message")))
        .when(p == "sudo", F.when(msg.startswith("pam_unix(sudo:"), F.lit("sudo_session")).otherwise(F.lit("unmodelled_message")))
        .when(p == "su", F.when(msg.startswith("pam_unix(su"), F.lit("su_session")).otherwise(F.lit("unmodelled_message")))
        .when(account, F.when(new_user, F.lit("unmodelled_message")).otherwise(F.lit("account_informational")))
        .otherwise(F.lit("not_security_relevant")),
    )
    failed = F.when(F.col("_h").isNull(), F.lit("unrecognized_format")).otherwise(F.col("_time_code"))
    return _finish(rows, names, "linux_auth", failed, skipped)


def _last_per_key(items: Column) -> Column:
    """`k=v` texts with only the last one of each key."""
    key = lambda x: F.substring_index(x, "=", 1)
    return F.filter(
        items,
        lambda x, i: ~F.exists(F.slice(items, i + 2, F.greatest(F.size(items), F.lit(1))), lambda y: key(y) == key(x)),
    )


# ---------- JSON formats ----------


def _json(df: DataFrame) -> DataFrame:
    options = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}
    return _decoded(df).withColumn("_j", F.from_json("_text", "map<string,string>", options))


def _json_failure() -> Column:
    other = F.try_parse_json("_text").isNotNull()
    return F.when(
        F.col("_j").isNull(), F.when(other, F.lit("not_a_json_object")).otherwise(F.lit("invalid_json"))
    )


def _get(name: str, column: str = "_j") -> Column:
    return F.try_element_at(F.col(column), F.lit(name))


def _windows_security(df: DataFrame) -> DataFrame:
    names = df.columns
    has = lambda k: F.map_contains_key("_j", k)
    either = lambda a, b: F.when(has(a), _get(a)).otherwise(_get(b))
    data_text = F.trim(_get("EventData"))
    empty = data_text.isNull() | data_text.isin("", "{}", "[]", "0", "false", "null")
    created = X.clean(_get("TimeCreated"))
    epoch = F.regexp_extract(created, r"^/Date\((-?\d{1,15})\)/$", 1)
    rows = _json(df).withColumns(
        {
            "_e": X.optional_int(either("EventID", "Id")),
            "_rid": X.optional_int(either("EventRecordID", "RecordId")),
            "_bad_data": ~empty & ~data_text.startswith("{"),
            "_d": F.when(empty, F.create_map().cast("map<string,string>")).otherwise(F.from_json(data_text, "map<string,string>")),
            "_time": F.when(epoch != "", F.timestamp_millis(epoch.try_cast("bigint"))).otherwise(X.iso_timestamp(created)),
            "_host": F.coalesce(
                X.clean(F.coalesce(X.blank_to_null(_get("Computer")), _get("MachineName"))), F.col("default_host")
            ),
        }
    )
    d = lambda k, n=None: X.clean(_get(k, "_d"), n)
    e, logon_type = F.col("_e"), X.optional_int(_get("LogonType", "_d"))
    kind = lambda user: F.when(user.isNotNull(), F.when(user.endswith("$"), F.lit("machine")).otherwise(F.lit("user")))
    member = X.split_user(_get("MemberName", "_d"))[0]
    path = d("NewProcessName")

    def event(category: str, action: str, who: str, attrs: dict[str, Column], **more: Column) -> dict[str, Column]:
        return {
            "timestamp": F.col("_time"), "host": F.col("_host"),
            **_lit(service="microsoft-windows-security-auditing", event_category=category, event_action=action, event_outcome="success"),
            "username": d(f"{who}UserName"), "user_domain": d(f"{who}DomainName"),
            "attributes": attributes(event_id=e, **attrs, record_id=F.col("_rid")),
            **more,
        }

    failed_logon = e == 4625
    names_of_types = F.create_map(*[x for k, v in LOGON_TYPES.items() for x in (F.lit(k).cast("bigint"), F.lit(v))])
    shown_type = F.coalesce(logon_type.cast("string"), F.lit("None"))
    rows = with_first_of(
        rows,
        (
            e.isin(4624, 4625),
            event(
                "authentication", "logon", "Target",
                {
                    "logon_type": logon_type,
                    "logon_type_name": F.try_element_at(names_of_types, logon_type),
                    "auth_package": d("AuthenticationPackageName"),
                    "workstation": d("WorkstationName"),
                    "status": F.when(failed_logon, d("Status")),
                    "sub_status": F.when(failed_logon, d("SubStatus")),
                    "account_kind": kind(d("TargetUserName")),
                },
                event_outcome=F.when(failed_logon, F.lit("failure")).otherwise(F.lit("success")),
                source_ip=optional_ip(_get("IpAddress", "_d")),
                source_port=X.optional_port(_get("IpPort", "_d")),
                session_id=d("TargetLogonId"),
                protocol=F.when(logon_type == 10, F.lit("rdp")).when(logon_type == 3, F.lit("network")),
                message=F.concat(
                    F.when(failed_logon, F.lit("Failed")).otherwise(F.lit("Successful")), F.lit(" logon (type "), shown_type, F.lit(")")
                ),
            ),
        ),
        (
            e == 4634,
            event("authentication", "logoff", "Target", {"logon_type": logon_type, "account_kind": kind(d("TargetUserName"))},
                  session_id=d("TargetLogonId")),
        ),
        (
            e == 4672,
            event("privilege", "special_privileges_assigned", "Subject",
                  {"privileges": d("PrivilegeList"), "account_kind": kind(d("SubjectUserName"))},
                  session_id=d("SubjectLogonId")),
        ),
        (
            e == 4688,
            event(
                "process", "process_started", "Subject",
                {"process_path": path, "process_id": d("NewProcessId"), "token_elevation_type": d("TokenElevationType")},
                session_id=d("SubjectLogonId"), process_name=X.basename(path),
                parent_process_name=X.basename(_get("ParentProcessName", "_d")), command_line=d("CommandLine"),
            ),
        ),
        (
            e == 4720,
            event("iam", "user_created", "Subject", {"target_sid": d("TargetSid")}, target_username=d("TargetUserName")),
        ),
        (
            e == 4732,
            event("iam", "group_member_added", "Subject", {"group_name": d("TargetUserName"), "target_sid": d("MemberSid")},
                  target_username=F.when(~member.contains("="), member)),
        ),
    )
    failed = F.coalesce(
        _json_failure(),
        F.when(e.isNull(), F.lit("missing_event_id"))
        .when(F.col("_bad_data"), F.lit("invalid_event_data"))
        .when(F.col("_time").isNull(), F.lit("invalid_timestamp")),
    )
    skipped = F.when(~e.isin(4624, 4625, 4634, 4672, 4688, 4720, 4732), F.lit("unsupported_event_id"))
    return _finish(rows, names, "windows_security", failed, skipped)


def _app_json(df: DataFrame) -> DataFrame:
    names = df.columns
    rows = _json(df).withColumns({"_name": X.clean(_get("event")), "_time": X.iso_timestamp(_get("ts"))})
    name = F.col("_name")
    mapping = F.create_map(
        *[x for k, v in APP_EVENTS.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))]
    )
    kind = F.try_element_at(mapping, name)
    user, domain = X.split_user(_get("user"))
    rows = with_first_of(
        rows,
        (
            kind.isNotNull(),
            {
                "timestamp": F.col("_time"),
                "event_category": F.get(kind, F.lit(0)),
                "event_action": F.get(kind, F.lit(1)),
                "event_outcome": F.get(kind, F.lit(2)),
                "host": F.coalesce(X.clean(_get("host")), F.col("default_host")),
                "username": user,
                "user_domain": domain,
                "target_username": X.split_user(_get("target_user"))[0],
                "source_ip": optional_ip(_get("ip")),
                "service": F.coalesce(X.clean(_get("app")), F.lit("app")),
                "session_id": X.clean(_get("session")),
                "message": name,
                "attributes": attributes(
                    app_event=name, role=X.clean(_get("role")), detail=X.clean(_get("detail"))
                ),
            },
        )
    )
    failed = F.coalesce(
        _json_failure(),
        F.when(name.isNull(), F.lit("missing_event_type"))
        .when(~name.isin(list(APP_EVENTS)), F.lit("unknown_event_type"))
        .when(F.col("_time").isNull(), F.lit("invalid_timestamp")),
    )
    return _finish(rows, names, "app_json", failed, F.lit(None).cast("string"))


def _generic_json(df: DataFrame) -> DataFrame:
    """Records already in event field names; types are checked on the JSON value itself."""
    names = df.columns
    rows = _json(df).withColumn("_v", F.when(F.col("_j").isNotNull(), F.try_parse_json("_text")))
    allowed = [*PARSED_NAMES, "source_type", "event_id"]
    extra = F.exists(F.map_keys("_j"), lambda k: ~k.isin(allowed))
    type_of = lambda path: F.schema_of_variant(F.expr(f"try_variant_get(_v, '$.{path}', 'variant')"))
    texts = [n for n in PARSED_NAMES if n not in ("timestamp", "source_type", "attributes", *PORT_FIELDS)]
    wrong = [F.coalesce(~type_of(n).isin("STRING", "VOID"), F.lit(False)) for n in texts]
    required = [F.coalesce(type_of(n) == "VOID", F.lit(True)) for n in ("event_category", "event_action", "timestamp")]
    port = lambda n: X.strip(_get(n))
    bad_port = [F.coalesce(_get(n).isNotNull() & ~port(n).rlike(r"^[+-]?\d{1,9}(?:\.0+)?$"), F.lit(False)) for n in PORT_FIELDS]
    attrs_type = type_of("attributes")
    values = F.expr("map_values(try_variant_get(_v, '$.attributes', 'map<string,variant>'))")
    nested = F.exists(values, lambda v: F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"))
    bad_attrs = (attrs_type.isNotNull() & ~attrs_type.startswith("OBJECT")) | F.coalesce(nested, F.lit(False))
    no_outcome = ~F.map_contains_key("_j", "event_outcome")
    host = F.when(F.coalesce(_get("host"), F.lit("")) == "", F.col("default_host")).otherwise(_get("host"))
    fields = {n: _get(n) for n in texts}
    fields |= {
        "timestamp": X.iso_timestamp(_get("timestamp")),
        "host": host,
        "event_outcome": F.when(no_outcome, F.lit("unknown")).otherwise(_get("event_outcome")),
        "attributes": F.coalesce(F.from_json(_get("attributes"), "map<string,string>"), F.create_map().cast(ATTRS)),
        **{n: F.regexp_replace(port(n), r"\.0+$", "").try_cast("int") for n in PORT_FIELDS},
    }
    invalid = reduce(lambda a, b: a | b, [extra, bad_attrs, *wrong, *required, *bad_port])
    rows = rows.withColumn("_invalid", F.coalesce(invalid, F.lit(False)))
    rows = rows.withColumns({n: fields.get(n, F.lit(None)).cast(t) for n, t in PARSED if n != "source_type"})
    failed = F.coalesce(
        _json_failure(),
        F.when(F.col("_invalid") | F.col("timestamp").isNull(), F.lit("invalid_event")),
    )
    return _finish(rows, names, "generic_json", failed, F.lit(None).cast("string"))


# ---------- http_access ----------


# Escape pairs, and the code points without a character of their own that stand for them meanwhile.
ESCAPES = {"\\\\": "\ufdd0", '\\"': "\ufdd1"}


def _unescaped(c: Column) -> Column:
    for pair, mark in ESCAPES.items():
        c = F.replace(c, F.lit(pair), F.lit(mark))
    return c


def _escaped(c: Column) -> Column:
    for pair, mark in ESCAPES.items():
        c = F.replace(c, F.lit(mark), F.lit(pair))
    return c


def _http_access(df: DataFrame) -> DataFrame:
    names = df.columns
    parts = F.transform(groups(_unescaped(F.col("_text")), ACCESS_LINE, 9), _escaped)
    rows = _line(df).withColumn("_l", parts)
    t = groups(F.get("_l", F.lit(3)), ACCESS_TIME, 8)
    rows = rows.withColumns({"_t": t, "_r": groups(F.get("_l", F.lit(4)), REQUEST, 3)})
    n = lambda i: F.get("_t", F.lit(i)).cast("int")
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.get("_t", F.lit(1))).cast("int")
    zone = F.concat(F.get("_t", F.lit(6)), F.lit(":"), F.get("_t", F.lit(7)))
    ok = (month > 0) & (n(5) < 60)
    stamp = F.when(
        ok, F.try_make_timestamp(n(2), month, n(0), n(3), n(4), n(5).cast("decimal(8,6)"), zone)
    )
    status = F.get("_l", F.lit(5)).cast("int")
    target = F.get("_r", F.lit(1))
    path = F.substring_index(target, "?", 1)
    query = F.regexp_extract(target, r"(?s)^[^?]*\?(.*)$", 1)
    good = F.col("_r").isNotNull()
    request = F.get("_l", F.lit(4))
    rows = with_first_of(
        rows,
        (
            F.col("_l").isNotNull(),
            {
                "timestamp": stamp,
                **_lit(event_category="web", event_action="http_request", protocol="http", service="http"),
                "event_outcome": F.when(status < 400, F.lit("success")).otherwise(F.lit("failure")),
                "host": F.col("default_host"),
                "source_ip": optional_ip(part("_l", 1)),
                "username": X.clean(part("_l", 3)),
                "message": F.when(
                    good,
                    F.concat_ws(" ", F.get("_r", F.lit(0)), path, status.cast("string")),
                ).otherwise(F.concat(F.lit("malformed request "), status.cast("string"))),
                "attributes": attributes(
                    http_status=status,
                    response_bytes=F.get("_l", F.lit(6)).try_cast("bigint"),
                    referrer=X.clean(part("_l", 8)),
                    user_agent=X.clean(part("_l", 9)),
                    http_method=F.when(good, F.get("_r", F.lit(0))),
                    url_path=F.when(good, path),
                    url_query=F.when(good, X.blank_to_null(query)),
                    http_version=F.when(good, F.get("_r", F.lit(2))),
                    request_line=F.when(~good, X.blank_to_null(request)),
                ),
            },
        )
    )
    failed = F.when(F.col("_l").isNull(), F.lit("unrecognized_format"))
    failed = F.coalesce(failed, F.when(F.col("timestamp").isNull(), F.lit("invalid_timestamp")))
    return _finish(rows, names, "http_access", failed, F.lit(None).cast("string"))


# ---------- validation ----------


def validate_events(df: DataFrame) -> DataFrame:
    """Canonical form of parsed rows; those that cannot have it FAIL."""
    code = F.when(F.col("source_type") == "generic_json", F.lit("invalid_event")).otherwise(F.lit("invalid_field"))
    no_nul = lambda c: F.translate(c, "\x00", "�")
    c = {n: no_nul(F.col(n)) for n, t in PARSED if t.typeName() == "string"}
    lowered = lambda v: X.blank_to_null(F.lower(X.strip(v)))
    host = F.regexp_replace(F.lower(X.strip(c["host"])), r"\.+$", "")
    clean = {
        "host": F.when(c["host"] != "", host),
        **{n: F.when(c[n] != "", canonical_ip(X.strip(c[n]))) for n in IP_FIELDS},
        **{n: lowered(c[n]) for n in ("username", "user_domain", "target_username", "process_name", "parent_process_name", "protocol", "service")},
        "attributes": F.transform_values("attributes", lambda _, v: no_nul(v)),
        **{n: c[n] for n in ("command_line", "session_id", "message")},
    }
    vocabulary = reduce(
        lambda a, b: a | b,
        [(F.col("event_category") == cat) & F.col("event_action").isin(acts) for cat, acts in ACTIONS.items()],
    )
    no = F.lit(False)
    bad = [
        ~F.coalesce(vocabulary, no),
        ~F.coalesce(F.col("event_outcome").isin(OUTCOMES), no),
        F.col("timestamp").isNull(),
        F.coalesce((c["host"] != "") & ~host.rlike(HOSTNAME), no),
        *[F.coalesce((c[n] != "") & ~valid_ip(X.strip(c[n])), no) for n in IP_FIELDS],
        *[F.coalesce(clean[n].rlike("[\r\n\t�]"), no) for n in ("username", "user_domain", "target_username")],
        *[F.coalesce(~F.col(n).between(0, 65535), no) for n in PORT_FIELDS],
        F.coalesce(F.exists(F.map_keys("attributes"), lambda k: ~k.rlike(ATTRIBUTE_KEY)), no),
    ]
    invalid = (F.col("parse_status") == "PARSED") & reduce(lambda a, b: a | b, bad)
    rows = df.withColumn("_invalid", invalid)
    rows = rows.withColumns(
        {
            "parse_status": F.when(F.col("_invalid"), F.lit("FAILED")).otherwise(F.col("parse_status")),
            "parse_detail": F.when(F.col("_invalid"), code).otherwise(F.col("parse_detail")),
        }
    )
    parsed = F.col("parse_status") == "PARSED"
    final = {n: F.when(parsed, clean.get(n, F.col(n))) for n in PARSED_NAMES if n != "source_type"}
    computed = [n for n in [*PARSED_NAMES, "parse_status", "parse_detail"] if n != "source_type"]
    kept = [n for n in df.columns if n not in computed]
    return settled(rows.withColumns(final), kept, computed)


FORMATS = {
    "linux_auth": _linux_auth,
    "windows_security": _windows_security,
    "http_access": _http_access,
    "app_json": _app_json,
    "generic_json": _generic_json,
}


def parse_linux_auth(df: DataFrame) -> DataFrame:
    """sshd, sudo, su and account lines in syslog form."""
    return validate_events(_linux_auth(df))


def parse_windows_security(df: DataFrame) -> DataFrame:
    """Security log events as JSON objects."""
    return validate_events(_windows_security(df))


def parse_http_access(df: DataFrame) -> DataFrame:
    """Access-log lines in common or combined form."""
    return validate_events(_http_access(df))


def parse_app_json(df: DataFrame) -> DataFrame:
    """Application events as JSON objects."""
    return validate_events(_app_json(df))


def parse_generic_json(df: DataFrame) -> DataFrame:
    """Events already in this model's field names."""
    return validate_events(_generic_json(df))


def parse_records(df: DataFrame, formats: list[str] | None = None) -> DataFrame:
    """Every record with exactly one outcome. One branch per format: where the raw store is
    partitioned by source_type, each branch reads only its own files. `formats`: those that occur, if
    that is known; records of others give no rows."""
    wanted = [name for name in FORMATS if formats is None or name in formats] or list(FORMATS)
    parts = [FORMATS[name](df.filter(F.col("source_type") == name)) for name in wanted]
    return validate_events(reduce(DataFrame.unionByName, parts))
