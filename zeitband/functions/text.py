"""Column functions on texts and times."""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(x: Column) -> Column:
    """Without white space on either side and without leading punctuation."""
    return F.regexp_replace(F.regexp_replace(x, r"^[\s.,;:!?]+", ""), r"\s+$", "")


def hms(ms: Column) -> Column:
    """HH:MM:SS; hours are unbounded."""
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def ascii_like(x: Column, query: str) -> Column:
    """``x`` contains the pattern, A-Z and a-z alike; % and _ in it are wildcards."""
    fold = lambda c: F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    return fold(x).like("%" + query.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)) + "%")


def contains_text(x: Column, query: str) -> Column:
    """``x`` contains the query literally, in either case."""
    return F.contains(F.lower(x), F.lower(F.lit(query)))


def normal_words(x: Column) -> Column:
    """Lower-case words of German letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(x), r"[^a-zäöüß0-9\s]", " "), r"\s+"), lambda w: w != "")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; 0 for empty, unlike or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


#: All white space of Unicode: what ``(?U)\s`` matches.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

#: Of these, what DuckDB's ``trim`` takes off: blanks of any width, no tabs and no ends of lines.
BLANKS = "".join(c for c in WHITE if unicodedata.category(c) == "Zs")


def trimmed(x: Column) -> Column:
    """Without white space of any kind on either side; Spark's own trim takes off blanks alone, and a pattern would search
    whole texts."""
    return F.btrim(x, F.lit(WHITE))


def is_blank(x: Column) -> Column:
    return F.coalesce(trimmed(x) == "", F.lit(True))


def join_texts(a: Column, b: Column) -> Column:
    """Both texts trimmed, one blank between them unless either is blank."""
    return F.concat_ws(" ", F.nullif(trimmed(a), F.lit("")), F.nullif(trimmed(b), F.lit("")))


def speaker_number(speaker_id: Column) -> Column:
    """The number in ``speaker_<n>`` (or of a bare number), null for anything else."""
    return F.regexp_replace(speaker_id, "^speaker_", "").try_cast("int")


def speaker_name(number: Column, prefix: str = "Sprecher ") -> Column:
    """The shown name of a speaker; numbers begin at 0, names at 1."""
    return F.concat(F.lit(prefix), (number + 1).cast("string"))


def minutes(ms: Column) -> Column:
    """M:SS."""
    s = F.floor(ms / 1000)
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def duration(ms: Column) -> Column:
    """M:SS Min."""
    return F.concat(minutes(ms), F.lit(" Min"))


def rounded_hms(seconds: Column) -> Column:
    """HH:MM:SS of seconds, rounded half to even."""
    return hms(F.bround(seconds, 0).cast("bigint") * 1000)


def date_text(ms: Column, pattern: str = "dd.MM.yyyy · HH:mm", zone: str = "UTC") -> Column:
    """An epoch time in a time zone."""
    none = F.lit(0)
    utc = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(none, none, none, (ms / 1000).cast("decimal(18,6)"))
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc), pattern)


def count_text(n: Column, what: str = "Sprecher") -> Column:
    """``N what`` for counts above 0, else empty."""
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {what}"))).otherwise("")


def json_text(x: Column) -> Column:
    """A JSON string with its quotes (``null`` for null): short escapes where there are some, else \\u00xx in lower case."""
    out = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    for raw, short in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(raw), F.lit(short))
    for code in (*range(0x08), 0x0B, *range(0x0E, 0x20)):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.when(x.isNull(), "null").otherwise(F.concat(F.lit('"'), out, F.lit('"')))
