"""Quality rules with host-level verdicts, by DataFrame functions only.

Each document is held against two rules. Failures are counted by host, each
host's failure rate is shrunk towards the mean of all hosts with a beta prior
that is fitted to the hosts by moments, and hosts whose shrunk rate is over a
threshold are rejected; their verdict is joined back to their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlake.llm.common import SPACE_CHARS, fresh, need, words
from weftlake.session import stash

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
HOST_MAX_FAIL = 0.5
#: Rows of the host table up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST_HOSTS = 100_000


def with_repeats(df: DataFrame, text: Column, n_words: str, n_repeat: str) -> DataFrame:
    """Add the number of words and of words in 3-word windows that the text holds more than once.

    Windows are hashed and sorted within the row; neighbours with one hash are
    repeats, and the union of their words is summed over the sorted positions.
    Work and memory of a row grow as n log n in its own words.
    """
    w, k, at = fresh(df, "w", "k", "at")
    q = "`{}`".format
    return (
        df.withColumn(w, words(text))
        .withColumn(
            k,
            F.expr(
                f"CASE WHEN size({q(w)}) < 3 THEN CAST(array() AS array<struct<h:bigint,p:int>>) ELSE "
                f"sort_array(transform(sequence(0, size({q(w)}) - 3), p -> struct(xxhash64({q(w)}[p], {q(w)}[p + 1], {q(w)}[p + 2]) AS h, p AS p))) END"
            ),
        )
        .withColumn(at, F.expr(f"sort_array(transform(filter({q(k)}, (x, i) -> x.h <=> get({q(k)}, i - 1).h OR x.h <=> get({q(k)}, i + 1).h), x -> x.p))"))
        .withColumn(n_words, F.size(w).cast("long"))
        .withColumn(
            n_repeat,
            F.expr(f"aggregate({q(at)}, struct(0L AS n, -3 AS last), (a, p) -> struct(a.n + least(3, p - a.last) AS n, p AS last), a -> a.n)"),
        )
        .drop(w, k, at)
    )


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < MIN_WORDS) | (n_repeat * 100 > n_words * MAX_REPEAT_PERCENT)


def rejected_hosts(flags: DataFrame, host: str, failed: str, host_max_fail: float = HOST_MAX_FAIL) -> DataFrame:
    """Hosts whose shrunk failure rate is over the threshold: (host, n_docs, n_failed, shrunk_rate).

    The prior's mean is the mean of the hosts' rates and its weight
    ``mean * (1 - mean) / variance - 1``, held within 1 and 10^6; with fewer than
    two hosts or no variance the weight is 10^6. Null hosts are no host.
    """
    hosts = flags.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v")).select(
        "m", F.when(F.col("v") > 0, F.least(F.lit(1e6), F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1))).otherwise(F.lit(1e6)).alias("s")
    )
    m, s = prior.first()  # one row
    if m is None:
        return hosts.withColumn("shrunk_rate", F.lit(None).cast("double")).limit(0)
    shrunk = (F.col("n_failed") + F.lit(m * s)) / (F.col("n_docs") + F.lit(s))
    return hosts.withColumn("shrunk_rate", shrunk).filter(F.col("shrunk_rate") > host_max_fail)


def apply_hosts(flags: DataFrame, host: str, failed: str, kept: str, host_max_fail: float = HOST_MAX_FAIL) -> DataFrame:
    """Add ``kept``: false if the document failed or its host is rejected.

    A small table of hosts is broadcast after its rows are counted; beside a large
    one rows without a host, and those that failed anyway, don't take the shuffle.
    """
    (h,) = fresh(flags, "host")
    bad = stash(rejected_hosts(flags, host, failed, host_max_fail).select(F.col("host").alias(h)), "hosts")
    if bad.count() > BROADCAST_HOSTS:
        open_ = F.col(host).isNotNull() & ~F.col(failed)
        asked = flags.filter(open_).join(bad, F.col(host) == F.col(h), "left").withColumn(kept, F.col(h).isNull()).drop(h)
        return asked.unionByName(flags.filter(~open_).withColumn(kept, ~F.col(failed)))
    bad = F.broadcast(bad)
    return flags.join(bad, F.col(host) == F.col(h), "left").withColumn(kept, ~F.col(failed) & F.col(h).isNull()).drop(h)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_max_fail: float = HOST_MAX_FAIL) -> DataFrame:
    """One row for each document: counts, base_failed and kept.

    A null text has no words and fails; a null host has no host verdict. Equal
    rows each give a row. An empty table gives none. Other columns are not read.
    """
    need(docs, id_col, text_col, host_col)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("host"))
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    d = with_repeats(d, F.col("text"), "n_words", "n_repeat_words").select(
        "doc_id",
        "host",
        "n_words",
        F.char_length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        "n_repeat_words",
    )
    d = d.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    d = stash(d.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))), "quality")
    out = apply_hosts(d, "host", "base_failed", "kept", host_max_fail)
    return out.select(F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def filter_quality(docs: DataFrame, text_col: str = "text", host_col: str = "source", host_max_fail: float = HOST_MAX_FAIL) -> DataFrame:
    """The documents that pass, with the columns they came with; same rules as :func:`quality_report`: a null text fails, a null host is never rejected, equal rows share their fate."""
    need(docs, text_col, host_col)
    n, r, failed, kept = fresh(docs, "n", "r", "failed", "kept")
    flags = with_repeats(docs, F.col(text_col), n, r).withColumn(failed, base_failed(F.col(n), F.col(r))).drop(n, r)
    flags = stash(flags, "quality")
    return apply_hosts(flags, host_col, failed, kept, host_max_fail).filter(kept).select(*docs.columns)


#: DuckDB SQL for quality_report over ``documents``.
REPORT_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
u AS (SELECT doc_id, unnest(w) AS a, unnest(range(1, len(w) + 1)) AS p FROM w),
k AS (SELECT doc_id, p, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
g AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS c FROM k WHERE c IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT p + d) AS n FROM g, (VALUES (0), (1), (2)) AS o(d) WHERE c > 1 GROUP BY doc_id),
f AS (
  SELECT w.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS bad FROM b WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT avg(bad / n) AS m, var_samp(bad / n) AS v FROM h),
s AS (SELECT m, CASE WHEN v > 0 THEN least(1e6, greatest(1.0, m * (1 - m) / v - 1)) ELSE 1e6 END AS s FROM p),
x AS (SELECT source FROM h, s WHERE (bad + m * s) / (n + s) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM x)) AS kept
FROM b"""
