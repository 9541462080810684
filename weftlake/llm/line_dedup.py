"""Line deduplication by content-defined chunks, by DataFrame functions only.

A rolling hash over the hashes of ``WINDOW`` lines cuts each text where the hash
is divisible by ``SPREAD``, so that an inserted line moves no later boundary.
Chunks of ``MIN_LINES`` lines or more that occur again anywhere are removed but
for their first place in the order of (id, position), after their bytes have
been compared.

A chunk is found only if both its boundaries lie in what repeats. With ``runs``
a second step grows the found chunks to the ends of each repeated run and finds
the runs that hold no whole chunk: every ``MIN_LINES`` adjacent lines that no
removed chunk covers are a place of their own, handled likewise. Lines of removed
chunks take no part in it, as each has its copy in a chunk that stays.

Each removed line has an equal line before it that stays. Only ids and hashes are
counted; text is shuffled once for each step, to meet the decisions about it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlake.llm.common import fresh, need
from weftlake.session import drop_stash, stash

WINDOW = 2
SPREAD = 4
MIN_LINES = 2
#: Repeated hash pairs, of 60 bytes each, up to which their table is broadcast after they are counted.
BROADCAST_PLACES = 200_000
#: Texts with repeated places up to which these are broadcast; each holds as many as it has lines.
BROADCAST_TEXTS = 5_000
#: SQL for the two hashes of a place's text ``s``, and for whether it holds more than white space.
HASHES = ("xxhash64(s)", "xxhash64(7, s)")
FULL = r"s rlike '[^\\x20\\x09-\\x0D]'"


def let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is then computed once for a row."""
    return f"transform(array({value}), {name} -> {body})[0]"


def chunks(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: array of (first line, lines, two independent hashes) of the chunks of a text; empty for null."""
    rolling = ", ".join(f"get(h, i - {WINDOW - 1 - k})" for k in range(WINDOW))
    stops = f"filter(transform(h, (x, i) -> IF(i = size(h) - 1 OR pmod(xxhash64({rolling}), {SPREAD}) = 0, i + 1, -1)), x -> x > 0)"
    one = let(
        "array_join(slice(ls, c.first + 1, c.stop - c.first), '\\n')",
        "s",
        f"struct(c.first AS first, c.stop - c.first AS n, {HASHES[0]} AS h1, {HASHES[1]} AS h2, {FULL} AS full)",
    )
    each = f"transform(transform(cut, (e, j) -> struct(coalesce(get(cut, j - 1), 0) AS first, e AS stop)), c -> {one})"
    lines = f"IF(`{text}` IS NULL, CAST(array() AS array<string>), split(`{text}`, '\\n', -1))"
    return df.withColumn(out, F.expr(let(lines, "ls", let("transform(ls, x -> xxhash64(x))", "h", let(stops, "cut", each)))))


def windows(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: array as in :func:`chunks` of every ``MIN_LINES`` adjacent lines of a text; empty for null and shorter texts."""
    one = let(
        f"array_join(slice(ls, i + 1, {MIN_LINES}), '\\n')",
        "s",
        f"struct(i AS first, {MIN_LINES} AS n, {HASHES[0]} AS h1, {HASHES[1]} AS h2, {FULL} AS full)",
    )
    at = f"filter(sequence(0, greatest(size(ls) - {MIN_LINES}, 0)), i -> i + {MIN_LINES} <= size(ls))"
    lines = f"IF(`{text}` IS NULL, CAST(array() AS array<string>), split(`{text}`, '\\n', -1))"
    return df.withColumn(out, F.expr(let(lines, "ls", f"transform({at}, i -> {one})")))


KEY = ["id", "th", "tl"]
PAIR = ["h1", "h2"]


def decided(places: DataFrame, by: list[str]) -> DataFrame:
    """Places whose text (columns ``by``) occurs again, with whether they stay.

    Sums by text are written before the join, so that neither side of it is an
    aggregate: AQE can then split the places of one text.
    """
    first = F.min(F.struct(*KEY, "first")).alias("keep")
    repeated = stash(places.groupBy(*by).agg(F.count("*").alias("m"), first).filter("m > 1").drop("m"), "texts")
    if repeated.count() <= BROADCAST_PLACES:
        repeated = F.broadcast(repeated)
    own = F.struct(*KEY).eqNullSafe(F.struct(*(f"keep.{c}" for c in KEY)))
    return places.join(repeated, by).select(*KEY, "first", "n", *PAIR, (own & (F.col("first") < F.col("keep.first") + F.col("n"))).alias("stays"))


def same_text(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on the columns of KEY, null ids being equal; those of the right side go. A small right side is broadcast after it is counted."""
    right = right.withColumnsRenamed({c: f"r_{c}" for c in KEY})
    if right.count() <= BROADCAST_TEXTS:
        right = F.broadcast(right)
    on = left["id"].eqNullSafe(right["r_id"]) & (left["th"] == right["r_th"]) & (left["tl"] == right["r_tl"])
    return left.join(right, on, how).drop(*(f"r_{c}" for c in KEY))


def repeated_places(docs: DataFrame, runs: bool, skip: DataFrame | None) -> DataFrame:
    """(KEY, first, n, PAIR, stays) of the repeated chunks of ``docs`` (id, th, tl, text) and, with ``runs``, of what they leave.

    Texts of the hash pairs in ``skip`` are told apart by their bytes.
    """
    full = lambda a: F.filter(a, lambda c: (c["n"] >= MIN_LINES) & c["full"])
    base = chunks(docs, "text", "chunks")
    base = windows(base, "text", "windows") if runs else base.withColumn("windows", F.col("chunks"))
    ls = [] if skip is None else [F.split("text", "\n", -1).alias("ls")]
    found = base.select(*KEY, full("chunks").alias("chunks"), *([full("windows").alias("windows")] if runs else []), *ls)
    found = stash(found.filter(F.size("windows" if runs else "chunks") > 0), "places")

    def decide(rows: DataFrame, places) -> DataFrame:
        at = rows.select(*KEY, *(["ls"] if ls else []), F.explode(places).alias("c")).select(*KEY, *(["ls"] if ls else []), "c.first", "c.n", "c.h1", "c.h2")
        if skip is None:
            return stash(decided(at, PAIR), "repeated")
        apart = at.join(F.broadcast(skip), PAIR, "left_semi").withColumn("s", F.expr("array_join(slice(ls, first + 1, n), '\\n')"))
        return stash(decided(at.drop("ls").join(F.broadcast(skip), PAIR, "left_anti"), PAIR).unionByName(decided(apart, [*PAIR, "s"])), "repeated")

    out = decide(found, "chunks")
    if runs:
        # Chunks of a document don't overlap: one flag for each line at which a run of MIN_LINES within a removed chunk starts.
        skipped = "array_repeat(false, x[j].first - IF(j = 0, 0, x[j - 1].first + x[j - 1].n))"
        inside = f"array_repeat(true, x[j].n - {MIN_LINES - 1}), array_repeat(false, {MIN_LINES - 1})"
        flags = F.expr(let("sort_array(gone)", "x", f"flatten(transform(sequence(0, size(x) - 1), j -> concat({skipped}, {inside})))"))
        gone = out.filter("NOT stays").groupBy(*KEY).agg(F.collect_set(F.struct("first", "n")).alias("gone"))
        gone = stash(gone.select(*KEY, flags.alias("gone")), "gone")
        covered = lambda c: F.get("gone", c["first"])
        out = out.unionByName(decide(same_text(found, gone, "left"), F.filter("windows", lambda c: ~F.coalesce(covered(c), F.lit(False)))))
        out = stash(out, "decisions")
    drop_stash(found)
    return out


def line_chunk_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", text_out: str = "text", counts: tuple[str, str, str] | None = None, runs: bool = False) -> DataFrame:
    """Every document, with the columns it came with and its repeated chunks removed.

    With ``runs`` it is all lines of runs of ``MIN_LINES`` or more that stand
    before without overlap, and a removed chunk is a stretch of removed lines.

    ``text_out`` may name another column for the shortened text; ``counts``
    names columns for the lines, the removed lines and the removed chunks. Null
    stays null and is never a chunk; chunks of white space alone (blanks, tabs,
    line and form feeds, returns) and single lines are left. A text of which
    nothing stays is empty. Rows that agree in id and text are one document and
    keep alike; null ids order first. An empty table gives no rows.
    """
    need(docs, id_col, text_col)
    text = F.col(text_col)
    id_, th, tl, cand, ls = fresh(docs, "id", "th", "tl", "cand", "ls")
    keyed = docs.withColumns({id_: F.col(id_col), th: F.xxhash64(text), tl: F.octet_length(text)})
    own = [F.col(id_).alias("id"), F.col(th).alias("th"), F.col(tl).alias("tl")]
    skip = None
    while True:
        decisions = repeated_places(keyed.select(*own, text.alias("text")), runs, skip)
        by_doc = stash(decisions.groupBy(*KEY).agg(F.sort_array(F.collect_set(F.struct("first", "n", *PAIR, "stays"))).alias("cand")), "by_doc")
        plain = keyed.toDF(*[f"c{k}" for k in range(len(keyed.columns))])
        where = {f"c{keyed.columns.index(c)}": k for c, k in zip((id_, th, tl), KEY)}
        held = stash(same_text(plain.withColumnsRenamed(where), by_doc, "left").drop(*KEY).toDF(*docs.columns, cand), "met")
        # The bytes of all places with one pair of hashes against each other.
        texts = let(f"split(`{text_col}`, '\\n', -1)", "ls", f"transform(`{cand}`, c -> struct(c.h1 AS h1, c.h2 AS h2, array_join(slice(ls, c.first + 1, c.n), '\\n') AS s))")
        places = held.filter(F.col(cand).isNotNull()).select(F.explode(F.expr(texts)).alias("c")).select("c.*")
        if skip is not None:
            places = places.join(F.broadcast(skip), PAIR, "left_anti")
        clash = stash(places.groupBy(*PAIR).agg(F.min("s").alias("a"), F.max("s").alias("b")).filter("a != b").select(*PAIR), "clash")
        if clash.isEmpty():
            break
        drop_stash(held)
        skip = clash if skip is None else stash(skip.unionByName(clash), "clash")

    # What stays lies between the removed chunks: one slice for each gap.
    gap = "slice(ls, IF(j = 0, 0, x[j - 1].first + x[j - 1].n) + 1, greatest(0, IF(j = size(x), size(ls), x[j].first) - IF(j = 0, 0, x[j - 1].first + x[j - 1].n)))"
    gaps = let(f"split(`{text_col}`, '\\n', -1)", "ls", let(f"`{cand}`", "x", f"array_join(flatten(transform(sequence(0, size(x)), j -> {gap})), '\\n')"))
    short = held.withColumn(cand, F.filter(cand, lambda c: ~c["stays"])).withColumn(ls, F.size(F.split(text, "\n", -1)))
    some = F.coalesce(F.size(cand), F.lit(0)) > 0
    new = {text_out: F.when(some, F.expr(gaps)).otherwise(text)}
    if counts:
        zero = F.lit(0).cast("long")
        removed = f"""aggregate(`{cand}`, struct(0L AS lines, 0L AS stretches, -1 AS stop), (a, c) -> struct(
            a.lines + c.first + c.n - greatest(c.first, a.stop) AS lines, a.stretches + IF(c.first > a.stop, 1L, 0L) AS stretches, c.first + c.n AS stop))"""
        new |= {
            counts[0]: F.coalesce(ls, F.lit(0)).cast("long"),
            counts[1]: F.coalesce(F.expr(removed)["lines"], zero),
            counts[2]: F.coalesce(F.expr(removed)["stretches"], zero) if runs else F.when(some, F.size(cand)).otherwise(0).cast("long"),
        }
    columns = [c for c in docs.columns if c not in new] + list(new)
    return short.withColumns(new).select(*(docs.columns if columns == docs.columns or not counts and text_out in docs.columns else columns))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: bool = False) -> DataFrame:
    """One row for each document: n_lines, n_removed_lines, n_removed_chunks and the SHA-256 of the kept text (null for null); nulls, ties and empty tables as in :func:`line_chunk_dedup`."""
    out = line_chunk_dedup(docs.select(id_col, text_col), id_col, text_col, "kept_text", ("n_lines", "n_removed_lines", "n_removed_chunks"), runs)
    return out.select(id_col, "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2("kept_text", 256).alias("kept_sha256"))
