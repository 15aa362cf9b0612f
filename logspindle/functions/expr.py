"""Column builders shared by the parsers. All run inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CUT = "\u0001\u0002"


def regex_groups(text: Column, pattern: str, groups: int) -> Column:
    """The groups of ``pattern``, which has to match the whole of ``text``, as an array from one regex pass; null without a match.

    Groups that took no part are empty strings. ``.`` and ``$`` should be written with ``(?d)`` and ``\\z``. Whoever uses the array
    more than once should ``bind`` it.
    """
    cut = F.split(F.regexp_replace(text, pattern, _CUT.join(f"${i}" for i in range(1, groups + 1))), _CUT, groups)
    # text without a match stays whole, so the number of parts tells; only text that has the mark itself is matched again
    return F.get(F.filter(F.array(cut), lambda g: (F.size(g) == groups) & (~text.contains(_CUT) | text.rlike(pattern))), F.lit(0))


def bind(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` uses it: Catalyst copies a column wherever it stands."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def blank_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def hyphen_null(c: Column) -> Column:
    return F.nullif(c, F.lit("-"))


def last_wins(entries: Column) -> Column:
    """A map from (key, value) structs; of equal keys the last counts."""

    def sorted_(e: Column) -> Column:  # places by key, the last of equal keys first
        places = F.array_sort(F.transform(e, lambda x, i: F.struct(x["key"].alias("key"), (-i).alias("at"))))
        first = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["key"] != x["key"]))
        return bind(places, lambda s: F.map_from_entries(F.transform(first(s), lambda x: F.get(e, -x["at"]))))

    def made(e: Column) -> Column:
        return F.when(F.size(F.array_distinct(F.transform(e, lambda x: x["key"]))) == F.size(e), F.map_from_entries(e)).otherwise(sorted_(e))

    return bind(entries, made)


def rfc3339(text: Column) -> Column:
    """A timestamp from RFC 3339 text, which needs an offset; null if it is none."""
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})\z")
    return F.when(shaped, F.try_to_timestamp(F.upper(text)))


def rfc3339_text(ts: Column) -> Column:
    """Text with milliseconds, if there are any, and offset +00:00 (for sessions in UTC)."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    ms = F.date_format(ts, "SSS")
    return F.concat(whole, F.when(ms == "000", F.lit("")).otherwise(F.concat(F.lit("."), ms)), F.lit("+00:00"))


def be_uint(data: Column, at, size: int) -> Column:
    """The big-endian unsigned number of ``size`` bytes (7 at most) at the 0-based offset ``at``."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(data, at + 1, F.lit(size))), 16, 10).cast("long")


def be_uint64(data: Column, at) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(data, at + 1, F.lit(8))), 16, 10).cast("decimal(20,0)")


def ipv4(data: Column, at) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.concat_ws(".", *[be_uint(data, at + i, 1).cast("string") for i in range(4)])


def ipv4_number(text: Column) -> Column:
    """The address as a number; null if the text is no dotted quad."""
    ok = text.rlike(r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(?!\z)|\z)){4}")
    p = F.split(text, r"\.")
    return F.when(ok, p[0].cast("long") * 16777216 + p[1].cast("long") * 65536 + p[2].cast("long") * 256 + p[3].cast("long"))


def ipv6_hex(text: Column) -> Column:
    """The address as 32 hexadecimal digits, which sort like addresses; null if the text is none. A zone is left out."""

    def full(s: Column) -> Column:
        halves = lambda h: F.filter(F.split(h, ":"), lambda x: x != "")
        wide = lambda a: F.array_join(F.transform(a, lambda x: F.lpad(x, 4, "0")), "")
        left, right = halves(F.substring_index(s, "::", 1)), F.when(s.contains("::"), halves(F.substring_index(s, "::", -1))).otherwise(F.array().cast("array<string>"))
        missing = 8 - F.size(left) - F.size(right)
        good = s.rlike(r"^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?(::([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?)?\z") & F.when(s.contains("::"), missing > 0).otherwise(missing == 0)
        return F.when(good, F.concat(wide(left), F.repeat(F.lit("0000"), missing), wide(right)))

    bare = F.regexp_replace(F.lower(text), r"%[^%]+\z", "")
    tail = F.regexp_extract(bare, r":(\d+\.\d+\.\d+\.\d+)\z", 1)  # the last 32 bits written as IPv4
    n = ipv4_number(tail)
    groups = F.concat(F.regexp_replace(bare, r"\d+\.\d+\.\d+\.\d+\z", ""), F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(65535))))
    return bind(F.when(tail == "", bare).otherwise(groups), full)


def sanitize_segment(key: Column) -> Column:
    """A path segment: lower case, [a-z0-9_] only, 64 characters at most, never empty."""
    clean = F.left(F.regexp_replace(F.lower(key), "[^a-z0-9_]", "_"), F.lit(64))
    return F.coalesce(blank_null(clean), F.lit("unknown"))


def xml_escape(c: Column) -> Column:
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(ref))
    return c


def xml_unescape(c: Column) -> Column:
    for raw, ref in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(ref), F.lit(raw))
    return c


# Names of syslog severities and facilities.
SEVERITIES = ["EMERGENCY", "ALERT", "CRITICAL", "ERROR", "WARNING", "NOTICE", "INFO", "DEBUG"]
FACILITIES = [
    "kernel", "user", "mail", "system", "security", "syslog", "lp", "news", "uucp", "clock", "authpriv", "ftp",
    "ntp", "audit", "alert", "clock2", "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7",
]


def _named(code: Column, names: list[str]) -> Column:
    known = F.try_element_at(F.array(*map(F.lit, names)), (code + 1).cast("int"))
    return F.when(code.between(0, len(names) - 1), known).otherwise(F.concat(F.lit("UNKNOWN("), code.cast("string"), F.lit(")")))


def severity_name(code: Column) -> Column:
    return _named(code, SEVERITIES)


def facility_name(code: Column) -> Column:
    return _named(code, FACILITIES)


def level_name(level: Column) -> Column:
    """Windows event levels."""
    return F.when(level == 1, "Critical").when(level == 2, "Error").when(level == 3, "Warning").when(level == 4, "Information").otherwise("Verbose")
