"""Text functions, as Catalyst expressions wherever Spark has the means."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: Unicode white space, as the inside of a character class.
WS = r"\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Control characters other than tab, line feed and carriage return.
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
#: How a log entry's line may begin, and the levels it may name.
TIMESTAMPS = [
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}",
    r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}",
    r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}",
    r"^\[\d{4}-\d{2}-\d{2}",
    r"^\d{10,13}\s",
    r"^\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}",
]
LEVELS = r"(?i)\b(DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL|TRACE|NOTICE)\b"
#: Tags that end a line in mail bodies, then entities in the order in which they are decoded.
BREAKS = [("<br>", "\n"), ("<br/>", "\n"), ("<br />", "\n"), ("</p>", "\n\n"), ("</div>", "\n"), ("</li>", "\n"), ("</tr>", "\n")]
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")]


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no expression for it."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def trim_ws(c: Column) -> Column:
    """Trim all Unicode white space, not blanks alone."""
    return F.regexp_replace(F.regexp_replace(c, f"^[{WS}]+", ""), f"[{WS}]+$", "")


def lines(c: Column) -> Column:
    """Array of a text's lines: a carriage return before the line feed goes, and so does an empty last line."""
    whole = F.transform(F.split(c, "\n", -1), lambda x: F.regexp_replace(x, "\r$", ""))
    return F.when(F.element_at(whole, -1) == "", F.slice(whole, F.lit(1), F.size(whole) - 1)).otherwise(whole)


def squash(c: Column) -> Column:
    """White space runs to one blank, ends trimmed."""
    return F.btrim(F.regexp_replace(c, f"[{WS}]+", " "))


def clean_text(c: Column) -> Column:
    """Composed, without control characters, white space squashed by line, empty lines dropped."""
    bare = F.regexp_replace(nfc(c), CONTROLS, "")
    return F.array_join(F.filter(F.transform(F.split(bare, "\n", -1), squash), lambda x: x != ""), "\n")


def starts_entry(line: Column) -> Column:
    out = F.lit(False)
    for p in TIMESTAMPS:
        out = out | line.rlike(p)
    return out


def is_log(c: Column) -> Column:
    """More than 0.3 of the first ten lines start with a timestamp."""
    first = F.slice(lines(c), 1, 10)
    hits = F.size(F.filter(first, lambda x: starts_entry(trim_ws(x))))
    return F.when(F.size(first) > 0, hits.cast("float") / F.size(first) > F.lit(0.3).cast("float")).otherwise(False)


def log_level(line: Column) -> Column:
    """First level that a line names, in capitals; empty if none."""
    return F.upper(F.regexp_extract(line, LEVELS, 1))


def strip_html(c: Column) -> Column:
    """Mail-style HTML to text: scripts and styles out, tags to breaks, entities decoded, blank lines dropped."""
    x = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", "")
    x = F.regexp_replace(x, r"(?is)<style[^>]*>.*?</style>", "")
    for a, b in BREAKS:
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(x, r"<[^>]+>", "")
    for a, b in ENTITIES:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.array_join(F.filter(F.transform(lines(x), trim_ws), lambda v: v != ""), "\n")


def likely_text(content: Column) -> Column:
    """More than 90 in 100 of the first 1024 bytes are printable ASCII or ASCII white space; false if empty."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    plain = F.length(F.regexp_replace(head, r"[^\x21-\x7e \t\n\x0c\r]", ""))
    return F.when(F.length(head) > 0, plain / F.length(head) > 0.9).otherwise(False)


def hover_text(title: Column, text: Column) -> Column:
    """Title, an empty line and text, or whichever is there."""
    has_t, has_x = F.coalesce(title, F.lit("")) != "", F.coalesce(text, F.lit("")) != ""
    return F.when(has_t & has_x, F.concat(title, F.lit("\n\n"), text)).when(has_t, title).when(has_x, text).otherwise("")
