"""Text index: posting lists in sorted blocks with maxima, ranked by BM25.

A posting is a document of a term with how often it holds the term and how many
terms it has. Postings are range-partitioned by (term, id), so that a frequent
term spans many partitions, and packed into blocks of ``BLOCK`` with the greatest
impact in each. A search bounds every query's k-th score from below by its best
blocks alone, and then reads only the blocks that can still reach that bound; what
it leaves out can't be among the best, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftlake.functions.batches import slices
from weftlake.session import drop_stash, stash

#: Postings of a block, and blocks of each term that give the first bound.
BLOCK = 128
FIRST_BLOCKS = 2
#: Documents and bytes of their terms that are counted at once: what a task holds in Python doesn't grow with the table.
LIST_ROWS, LIST_BYTES = 4096, 8 << 20
#: Of a search, about what a task scores at once: documents and postings of a part, queries and their terms of a group, products in one step; rows of a result's batch.
PART_DOCS, PART_POSTINGS, QUERIES, ENTRIES, PAIRS, OUT_ROWS = 4096, 1 << 20, 512, 1 << 16, 1 << 20, 1 << 16
#: Saturation and length parameters of BM25, and what a term is.
K1, B = 1.2, 0.75
TERM = r"([\p{L}\p{N}]+)"
BETWEEN = r"[^\p{L}\p{N}]++"
#: Scores are compared with so many digits: sums may differ beyond, by their order.
DIGITS = 9


def terms_of(text: Column) -> Column:
    """The lower-cased runs of letters and digits of a text; none for null."""
    return F.transform(F.coalesce(F.regexp_extract_all(text, F.lit(TERM)), F.array().cast("array<string>")), F.lower)


def words_of(text: Column) -> Column:
    """The same terms as one text, with a space between them: spaces end a term for the lower case too (a sigma at its end)."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BETWEEN, " ")))


def _impact(tf: Column, n: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / F.lit(mean)))


def build_text_index(docs: DataFrame, path: str, key: str = "id", text: str = "text") -> None:
    """Write the index of ``docs`` to ``path``: corpus, terms and posting blocks.

    Rows with a null key are left out, null and empty texts count as documents
    without terms, an empty table gives an empty index. Keys are meant to be unique:
    a row that repeats a key counts as a document of its own.
    """
    spark = docs.sparkSession
    base = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), words_of(F.col(text)).alias("words"))
    kind = base.schema["id"].dataType.simpleString()
    schema = f"term string, ids array<{kind}>, tfs array<long>, ns array<long>"
    # Written, so that texts are taken apart once: the sum of all counts and the range partitioning's sample read narrow columns of it.
    found = stash(base.mapInArrow(_packed, f"term string, ids array<{kind}>, counts array<long>, total long"), "postings")
    count = docs.filter(F.col(key).isNotNull()).count()
    mean = float((found.agg(F.sum("total")).first()[0] or 0) / max(count, 1) or 1.0)
    spark.createDataFrame([(count, mean)], "docs long, mean double").write.parquet(f"{path}/corpus")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lists that follow each other in the order of their terms, as full blocks."""
        for b in batches:
            code = b.column("term").dictionary_encode()
            size = pc.list_value_length(b.column("ids")).to_numpy()
            counts = b.column("counts").flatten().to_numpy()
            tfs, ns = counts >> 32, counts & 0xFFFFFFFF
            start, columns = _cut(np.repeat(code.indices.to_numpy(), size), code.dictionary, b.column("ids").flatten(), tfs, ns)
            impact = tfs * (K1 + 1) / (tfs + K1 * (1 - B + B * ns / mean))
            top = np.maximum.reduceat(impact, start) if len(start) else impact
            yield pa.RecordBatch.from_arrays([*columns, pa.array(top, pa.float64())], ["term", "ids", "tfs", "ns", "top"])

    order = F.col("term"), F.col("ids")[0]
    found.select("term", "ids", "counts").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, f"{schema}, top double").write.parquet(f"{path}/blocks")
    spark.read.parquet(f"{path}/blocks").groupBy("term").agg(F.sum(F.size("ids")).alias("df"), F.max("top").alias("top")).write.parquet(f"{path}/terms")
    drop_stash(found)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists of some documents: counted within the rows, nothing is shuffled yet."""
    for ids, words in slices(((b.column("id"), b.column("words")) for b in batches), LIST_ROWS, LIST_BYTES):
        has = pc.greater(pc.binary_length(words), 0)
        ids, words = ids.filter(has), pc.split_pattern(words.filter(has), " ")
        n = pc.list_value_length(words).to_numpy()
        flat = words.flatten().dictionary_encode()
        at, tf = np.unique(flat.indices.to_numpy().astype(np.int64) * len(n) + np.repeat(np.arange(len(n)), n), return_counts=True)
        term, doc = np.divmod(at, max(len(n), 1))
        start, columns = _cut(term, flat.dictionary, ids.take(pa.array(doc)), tf, n[doc].astype(np.int64))
        total = np.add.reduceat(tf, start) if len(start) else tf
        yield pa.RecordBatch.from_arrays([*columns, ids.take(pa.array(doc[start])), pa.array(total, pa.int64())], ["term", "ids", "tfs", "ns", "first", "total"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists with tf and n as the halves of one number (a text has less than 2 GB): most lists are short, and each array of a shuffled row costs as much again."""
    for b in _lists(batches):
        tfs, ns = (b.column(c).flatten().to_numpy() for c in ("tfs", "ns"))
        counts = pa.ListArray.from_arrays(b.column("ids").offsets, pa.array(tfs << 32 | ns))
        yield pa.RecordBatch.from_arrays([b.column("term"), b.column("ids"), counts, b.column("total")], ["term", "ids", "counts", "total"])


def _cut(term: np.ndarray, names: pa.Array, ids: pa.Array, tfs: np.ndarray, ns: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Postings whose terms (codes into ``names``) stand together, as blocks of at most BLOCK: where each starts, and term, ids, tfs, ns."""
    at = np.arange(len(term))
    new = np.flatnonzero(np.diff(term, prepend=-1))
    run = at - np.repeat(new, np.diff(np.append(new, len(term))))
    start = np.flatnonzero(run % BLOCK == 0)
    cut = pa.array(np.append(start, len(term)), pa.int32())
    return start, [names.take(pa.array(term[start])), pa.ListArray.from_arrays(cut, ids), *(pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int64))) for x in (tfs, ns))]


def postings(spark: SparkSession, path: str) -> DataFrame:
    """(term, id, tf, n) of the whole index."""
    return _unpacked(spark.read.parquet(f"{path}/blocks"), "term")


def _unpacked(blocks: DataFrame, *keep: str) -> DataFrame:
    return blocks.select(*keep, F.explode(F.arrays_zip("ids", "tfs", "ns")).alias("p")).select(*keep, F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.ns").alias("n"))


def _weighed(spark: SparkSession, path: str, queries: DataFrame) -> tuple[DataFrame, int, float]:
    """(query_id, term, idf, df, rest): each known term's weight, its documents and the greatest score of the query's other terms; documents and their mean length."""
    docs, mean = spark.read.parquet(f"{path}/corpus").first()
    terms = spark.read.parquet(f"{path}/terms").withColumn("idf", F.log(1 + (F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    asked = queries.filter("query_id IS NOT NULL").select("query_id", F.explode(terms_of(F.col("text"))).alias("term")).distinct()
    own = F.col("idf") * F.col("top")
    rest = F.sum(own).over(Window.partitionBy("query_id")) - own
    return asked.join(terms, "term").select("query_id", "term", "idf", "df", rest.alias("rest")), docs, mean


def _summed(chosen: DataFrame, mean: float) -> DataFrame:
    """(query_id, id, score) of blocks with their query and weight."""
    p = _unpacked(chosen, "query_id", "idf")
    return p.groupBy("query_id", "id").agg(F.sum(F.col("idf") * _impact(F.col("tf"), F.col("n"), mean)).alias("score"))


def _scored(blocks: DataFrame, asked: DataFrame, docs: int, mean: float, k: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score) of ``asked`` (query_id, term, idf, df, need): every document of ``ids`` that holds a term, or with ``k`` the best of each part of the documents.

    A posting is shuffled once for a group of queries, to the part of the documents
    that its id's hash names, and not once for each query that has its term. Where
    ``need`` is above a block's greatest impact, its query does without the block.
    """
    terms = stash(asked.select("term", "df").distinct().withColumn("code", F.monotonically_increasing_id()), "asked")
    entries, queries = asked.agg(F.count("*"), F.countDistinct("query_id")).first()
    groups = max(1, -(-queries // QUERIES), -(-entries // ENTRIES))
    parts = max(1, -(-docs // PART_DOCS), -(-(terms.agg(F.sum("df")).first()[0] or 0) // PART_POSTINGS))
    kind, query = blocks.schema["ids"].dataType.elementType.simpleString(), asked.schema["query_id"].dataType.simpleString()
    given = ids is not None

    def part_of(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(parts))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks as one row for each part and group that they have postings of."""
        for b in batches:
            size = pc.list_value_length(b.column("ids")).to_numpy()
            code, group = (np.repeat(b.column(c).to_numpy(), size) for c in ("code", "group"))
            tf, n, part = (b.column(c).flatten().to_numpy() for c in ("tfs", "ns", "parts"))
            at = group * parts + part
            order = np.argsort(at, kind="stable")
            at = at[order]
            start = np.flatnonzero(np.diff(at, prepend=-1))
            cut = pa.array(np.append(start, len(at)), pa.int32())
            impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean))
            lists = b.column("ids").flatten().take(pa.array(order)), pa.array(code[order]), pa.array(impact[order])
            yield pa.RecordBatch.from_arrays([pa.array(at[start]), *(pa.ListArray.from_arrays(cut, x) for x in lists)], ["at", "ids", "codes", "impacts"])

    def summed(postings: pa.Table, weights: pa.Table) -> pa.Table:
        names = {"query_id": weights.column("query_id").type, "id": postings.column("ids").type.value_type, "score": pa.float64()}
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(list(x), list(names)) for x in _matrix(postings, weights, given, k)], pa.schema(names))

    group = F.pmod(F.xxhash64("query_id"), F.lit(groups))
    weights = asked.select(group.alias("group"), "query_id", "term", "idf", "need").join(terms, "term")
    # Written, as its size is then known: the blocks are joined where they are.
    wanted = stash(weights.groupBy("term", "code", "group").agg(F.min("need").alias("need")), "asked")
    chosen = blocks.join(wanted, "term").filter(F.col("top") >= F.col("need"))
    pieces = chosen.select("code", "group", "ids", "tfs", "ns", F.transform("ids", part_of).alias("parts")).mapInArrow(dealt, f"at long, ids array<{kind}>, codes array<long>, impacts array<double>")
    told = weights.select("group", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "query_id", "code", "idf", F.lit(None).cast(kind).alias("id"))
    if given:
        c = ids.select(F.col("id").cast(kind)).filter("id IS NOT NULL")
        c = c.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), part_of(F.col("id")).alias("part"), F.lit(None).cast(query).alias("query_id"), F.lit(None).cast("long").alias("code"), F.lit(None).cast("double").alias("idf"), "id")
        told = told.unionByName(c)
    told = told.select((F.col("group") * parts + F.col("part")).alias("at"), "query_id", "code", "idf", "id")
    return pieces.groupBy("at").cogroup(told.groupBy("at")).applyInArrow(summed, f"query_id {query}, id {kind}, score double")


def _matrix(postings: pa.Table, weights: pa.Table, given: bool, k: int | None) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """(query_id, id, score) of one part of the documents and one group of queries, in pieces; ``given``: of the ids in ``weights`` alone, ``k``: the best alone."""
    is_query = pc.is_valid(weights.column("code"))
    asked, ids = weights.filter(is_query), pc.list_flatten(postings.column("ids")).combine_chunks()
    if not len(asked) or not len(ids):
        return
    names = pc.unique(ids)
    if given:
        names = names.filter(pc.is_in(names, weights.filter(pc.invert(is_query)).column("id").combine_chunks()))
    names = names.take(pc.sort_indices(names))
    doc = pc.index_in(ids, names)
    has = pc.is_valid(doc).to_numpy(zero_copy_only=False)
    doc = pc.drop_null(doc).to_numpy().astype(np.int64)
    code, impact = (pc.list_flatten(postings.column(c)).to_numpy()[has] for c in ("codes", "impacts"))
    queries = asked.column("query_id").combine_chunks().dictionary_encode()
    order = np.argsort(asked.column("code").to_numpy(), kind="stable")
    query, idf = queries.indices.to_numpy()[order].astype(np.int64), asked.column("idf").to_numpy()[order]
    own, first, held = np.unique(asked.column("code").to_numpy()[order], return_index=True, return_counts=True)
    term = np.searchsorted(own, code)
    score = np.zeros((len(names), len(queries.dictionary)))
    end = np.cumsum(held[term])
    a = 0
    while a < len(term):
        # As many postings as make PAIRS pairs with the queries that have their term, one at least.
        b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + PAIRS, "right")))
        t, size = term[a:b], held[term[a:b]]
        at = np.arange(size.sum()) + np.repeat(first[t] - np.cumsum(size) + size, size)
        score += np.bincount(np.repeat(doc[a:b], size) * score.shape[1] + query[at], np.repeat(impact[a:b], size) * idf[at], score.size).reshape(score.shape)
        a = b
    d, q = np.nonzero(score > 0) if k is None else _best(score, k)
    for a in range(0, len(d), OUT_ROWS):
        x, y = d[a : a + OUT_ROWS], q[a : a + OUT_ROWS]
        yield queries.dictionary.take(pa.array(y)), names.take(pa.array(x)), pa.array(score[x, y])


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what can be among the ``k`` best of a column by its rounded score, then by row: of equal scores the first ``k``."""
    least = np.partition(score, -k, axis=0)[-k] - 2 * 10.0**-DIGITS if len(score) > k else np.zeros(score.shape[1])
    d, q = np.nonzero((score > 0) & (score >= least))
    order = np.lexsort((d, score[d, q], q))
    d, q = d[order], q[order]
    s, at = score[d, q], np.arange(len(d))
    new = np.flatnonzero((np.diff(q, prepend=-1) != 0) | (np.diff(s, prepend=-1.0) != 0))
    keep = at - np.repeat(new, np.diff(np.append(new, len(d)))) < k
    return d[keep], q[keep]


def search_text(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` best documents for each of ``queries`` (query_id, text), equal scores by id.

    Repeated words of a query count once; queries without a known term have no
    rows, and documents without any of a query's terms aren't ranked.
    """
    asked, docs, mean = _weighed(spark, path, queries)
    asked = stash(asked, "asked")
    blocks = spark.read.parquet(f"{path}/blocks")
    w = Window.partitionBy("query_id", "term").orderBy(F.desc("top"), "first")
    tops = blocks.select("term", "top", F.col("ids")[0].alias("first"))
    best = asked.join(tops, "term").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= FIRST_BLOCKS).select("query_id", "term", "idf", "first").distinct()
    # Written, as its size is then known: the blocks are joined where they are, instead of shuffled whole.
    best = stash(best, "asked")
    some = _summed(blocks.withColumn("first", F.col("ids")[0]).join(best, ["term", "first"]), mean)
    bound = some.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("n") == k).select("query_id", F.col("score").alias("least"))
    need = F.coalesce((F.col("least") - 1e-6 - F.col("rest")) / F.col("idf"), F.lit(0.0))
    limits = stash(asked.join(bound, "query_id", "left").withColumn("need", need), "asked")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), "id")
    return _scored(blocks, limits, docs, mean, k=k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def score_candidates(spark: SparkSession, path: str, queries: DataFrame, ids: DataFrame) -> DataFrame:
    """(query_id, id, score) of the documents in ``ids`` (id) that hold a term of a query: BM25 as the scorer of a rerank."""
    asked, docs, mean = _weighed(spark, path, queries)
    asked = stash(asked.withColumn("need", F.lit(0.0)), "asked")
    return _scored(spark.read.parquet(f"{path}/blocks"), asked, docs, mean, ids=ids)
