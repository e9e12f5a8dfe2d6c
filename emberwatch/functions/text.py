"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# What sources write for "no value".
PLACEHOLDERS = ["", "-", "--", "n/a", "null", "none"]

# White space as Unicode sees it (trim() alone only removes the space character).
_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
_SPACE += "\u2028\u2029\u202f\u205f\u3000"


def fold(c: Column | str) -> Column:
    """Lower-cases ASCII letters only, so look-alike letters never become equal to ASCII ones."""
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(c.cast("string"), UPPER, UPPER.lower())


def fold_text(value: object) -> str:
    """The same folding for a literal on the driver."""
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value).translate(str.maketrans(UPPER, UPPER.lower()))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACE))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def clean(c: Column, limit: int | None = None) -> Column:
    """Stripped text, null for placeholders, cut to `limit` characters."""
    text = strip(c.cast("string"))
    kept = F.when(~F.lower(text).isin(PLACEHOLDERS), text)
    return F.substring(kept, 1, limit) if limit else kept


def split_user(c: Column) -> tuple[Column, Column]:
    r"""`DOM\user` or `user@dom` as (user, domain)."""
    text = clean(c)
    slash, at = F.instr(text, "\\") > 0, F.instr(text, "@") > 0
    user = (
        F.when(slash, clean(F.element_at(F.split(text, r"\\"), -1)))
        .when(at, clean(F.split_part(text, F.lit("@"), F.lit(1))))
        .otherwise(text)
    )
    domain = F.when(slash, clean(F.regexp_extract(text, r"(?s)^(.*)\\", 1))).when(
        at, clean(F.regexp_extract(text, r"(?s)^[^@]*@(.*)$", 1))
    )
    return user, domain


def basename(c: Column) -> Column:
    path = F.regexp_replace(F.translate(clean(c), "\\", "/"), "/+$", "")
    return blank_to_null(F.element_at(F.split(path, "/"), -1))


def optional_port(c: Column) -> Column:
    text = clean(c)
    number = F.when(text.rlike(r"^\d{1,9}$"), text.cast("int"))
    return F.when(number.between(0, 65535), number)


def optional_int(c: Column) -> Column:
    text = clean(c)
    return F.when(text.rlike(r"^-*\d{1,18}$"), text.try_cast("bigint"))


def iso_timestamp(c: Column) -> Column:
    """ISO 8601 with a zone; digits beyond microseconds are cut; anything else is null."""
    text = clean(c)
    moment = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d*)?)?"
    usual = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d*)?(?:Z|[+-]\d{2}:\d{2})$")
    # Seldom: no seconds, a zone without a colon or minutes, or small letters.
    upper = F.upper(text)
    full = F.regexp_replace(upper, r"^(.{10}[T ]\d{2}:\d{2})(Z|[+-])", "$1:00$2")
    colon = F.regexp_replace(F.regexp_replace(full, r"([+-]\d{2})$", "$1:00"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    seldom = upper.rlike(moment + r"(?:Z|[+-]\d{2}(?::?\d{2})?)$")
    return F.when(usual, text.try_cast("timestamp")).when(seldom, colon.try_cast("timestamp"))


def stamp_text(us: Column) -> Column:
    """`2026-09-25 10:00:00 UTC` from microseconds."""
    return F.concat(F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def duration_text(us: Column) -> Column:
    """`38 s`, `5 min`, `2 h 5 min`, `14 days` from microseconds."""
    s = F.floor(us / 1_000_000).cast("bigint")
    days, hours = F.expr("1") * F.floor(s / 86400), F.floor(s / 3600)
    minutes, rest = F.floor((s % 3600) / 60), s % 60
    long = F.concat_ws(
        " ",
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit(" h"))),
        F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit(" min"))),
        F.when((rest > 0) & (hours == 0), F.concat(rest.cast("string"), F.lit(" s"))),
    )
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit(" s")))
        .when(
            s % 86400 == 0,
            F.concat(days.cast("string"), F.when(days == 1, F.lit(" day")).otherwise(F.lit(" days"))),
        )
        .otherwise(long)
    )


# Secret shapes to mask and what replaces them, applied in this order.
SECRET_SHAPES = [
    (r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*", "[REDACTED_JWT]"),
    (r"(?i)\bbearer\s+[A-Za-z0-9\-._~+/]+=*", "Bearer [REDACTED]"),
    (r"(\b[a-z][a-z0-9+.-]*://[^:/@\s]+:)[^@\s]+@", "$1[REDACTED]@"),
    (
        r"(?i)(\b(?:password|passwd|secret|secret_key|token|api[_-]?key|ingest[_-]?key)\b"
        r"[\"']?\s*[=:]\s*[\"']?)([^\s,\"'}]+)",
        "$1[REDACTED]",
    ),
]
SECRET_KEY = r"(?i)(password|passwd|secret|token|credential|api[_-]?key|cookie)"


def redact(c: Column) -> Column:
    for shape, mask in SECRET_SHAPES:
        c = F.regexp_replace(c, shape, mask)
    return c
