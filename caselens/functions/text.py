"""String, regex, id and formatting expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caselens.schema import blank_to_null

# The extraction patterns.
IPV4 = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
URL = r"https?://[^\s\"'>]+"
WINDOWS_PATH = r"[a-zA-Z]:\\[^:*?\"<>|\r\n]+"
POSIX_PATH = r"/[a-zA-Z0-9_\-./]+"
HASH = r"\b[a-fA-F0-9]{32,64}\b"
USER = r"(?i)\b(?:user|username|account)\s*[:=]\s*([a-zA-Z0-9_\-.\\]+)\b"
HASH_LINE = r"^\s*([a-fA-F0-9]{32,64})\s+[*\s]?(.+)?$"
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def first_match(col: Column, pattern: str) -> Column:
    """First match or NULL (``regexp_extract`` would give an empty string)."""
    return F.regexp_substr(col, F.lit(pattern))


def first_ip(col: Column) -> Column:
    return first_match(col, IPV4)


def first_url(col: Column) -> Column:
    return first_match(col, URL)


def first_hash(col: Column) -> Column:
    return first_match(col, HASH)


def first_user(col: Column) -> Column:
    return blank_to_null(F.regexp_extract(col, USER, 1))


def first_path(col: Column, compat: bool = False) -> Column:
    """Windows path first, then a POSIX path outside URLs.

    ``compat`` takes whichever matches first, so a URL's tail can win.
    """
    if compat:
        return first_match(col, f"(?:{WINDOWS_PATH}|{POSIX_PATH})")
    return F.coalesce(
        first_match(col, WINDOWS_PATH),
        first_match(F.regexp_replace(col, URL, " "), POSIX_PATH),
    )


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def hash_kind(col: Column) -> Column:
    return (
        F.when(F.length(col) == 32, "md5").when(F.length(col) == 40, "sha1").otherwise("sha256")
    )


def enum_guard(col: Column, allowed: list[str], default: str) -> Column:
    value = F.lower(F.trim(col))
    return F.when(value.isin(allowed), value).otherwise(F.lit(default))


def int_guard(col: Column) -> Column:
    """Digits-only strings become BIGINT, everything else NULL."""
    return F.when(col.rlike("^[0-9]+$"), col.try_cast("bigint"))


def humanize(col: Column) -> Column:
    """Underscores to spaces, first letter of every word upper-cased, rest kept."""
    words = F.split(F.replace(col, F.lit("_"), F.lit(" ")), r"(?<=\W)")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))),
        "",
    )


def person_name(col: Column) -> Column:
    """First word after an introduction, unless it is a filler word."""
    raw = F.regexp_extract(col, r"(?i)(?:my name is|i am|i'm|this is)\s+([A-Za-z\s]+)", 1)
    word = F.initcap(F.element_at(F.split(F.concat(F.trim(raw), F.lit(" ")), r"\s+"), 1))
    filler = ["a", "an", "the", "investigator", "analyst"]
    return F.when((word != "") & ~F.lower(word).isin(filler), word)


def json_path(col: Column, path: str) -> Column:
    """Dotted access into a JSON text column, for example ``metadata.case_id``."""
    return F.get_json_object(col, "$." + path)


def finding_id(prefix: str, *parts: Column) -> Column:
    key = F.concat(*[F.coalesce(p, F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.md5(key), 1, 10))


def point_id(col: Column) -> Column:
    """Stable integer id: first 8 hex digits of the md5."""
    return F.conv(F.substring(F.md5(col), 1, 8), 16, 10).cast("bigint")


def canonical_json(**fields: Column) -> Column:
    """JSON text with keys in sorted order and empty strings for NULL."""
    parts: list[Column] = []
    for i, name in enumerate(sorted(fields)):
        value = F.coalesce(fields[name].cast("string"), F.lit(""))
        escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        parts += [F.lit(("," if i else "{") + f'"{name}":"'), escaped, F.lit('"')]
    return F.concat(*parts, F.lit("}"))


def sha_json(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def iso_micros(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def size_text(size: Column) -> Column:
    """Bytes below 1 KB, KB with one digit below 1 MB, else MB with two digits."""
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" Bytes")))
        .when(size < 1024 * 1024, F.format_string("%.1f KB", F.bround(size / 1024, 1)))
        .otherwise(F.format_string("%.2f MB", F.bround(size / (1024 * 1024), 2)))
    )


def duration_text(seconds: Column) -> Column:
    """``47s``, ``1m 5s`` or ``1h 1m 5s``; negative or missing is ``0s``."""
    s = F.floor(seconds)
    mins, hours = F.floor(s / 60), F.floor(s / 3600)
    return (
        F.when(seconds.isNull() | (seconds < 0), "0s")
        .when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(mins < 60, F.concat_ws("", mins.cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat_ws(
            "", hours.cast("string"), F.lit("h "), (mins % 60).cast("string"), F.lit("m "),
            (s % 60).cast("string"), F.lit("s"),
        ))
    )
