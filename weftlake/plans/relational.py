"""Listings, joins, counters, upserts and interval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlake.operators import catalog, ledger
from weftlake.plans.registry import Tables, query


@query("list_page", "SELECT o_orderkey, o_custkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total_count FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def list_page(t: Tables) -> DataFrame:
    rows = t.orders.filter("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_totalprice")
    return catalog.page(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], 25, 50)


@query("owner_filter", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_custkey = 7")
def owner_filter(t: Tables) -> DataFrame:
    return t.orders.filter("o_custkey = 7").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("list_search", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%10%' OR p_brand ILIKE '%10%' OR list_contains(string_split(p_type, ' '), '10')")
def list_search(t: Tables) -> DataFrame:
    p = t.part.withColumn("tags", F.split("p_type", " "))
    return catalog.search(p, "10", "p_name", "p_brand", tags="tags").select("p_partkey", "p_name")


@query("tag_member", "SELECT p_partkey, list_contains(string_split(p_type, ' '), 'STEEL') AS tagged, p_size IN (1, 5, 9) AS listed FROM part WHERE list_contains(string_split(p_type, ' '), 'STEEL') OR p_size IN (1, 5, 9)")
def tag_member(t: Tables) -> DataFrame:
    tagged, listed = F.array_contains(F.split("p_type", " "), "STEEL"), F.col("p_size").isin(1, 5, 9)
    return t.part.filter(tagged | listed).select("p_partkey", tagged.alias("tagged"), listed.alias("listed"))


@query("sorted_page", "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice ASC, p_partkey LIMIT 40")
def sorted_page(t: Tables) -> DataFrame:
    order = catalog.sort_by("price", "asc", {"price": "p_retailprice", "size": "p_size"}, "p_partkey", "p_partkey")
    return t.part.orderBy(*order).limit(40).select("p_partkey", "p_name", "p_retailprice")


@query("sorted_page_fallback", "SELECT p_partkey, p_name FROM part ORDER BY p_size DESC, p_partkey LIMIT 40")
def sorted_page_fallback(t: Tables) -> DataFrame:
    return t.part.orderBy(*catalog.sort_by("1; drop", "asc", {"price": "p_retailprice"}, "p_size", "p_partkey")).limit(40).select("p_partkey", "p_name")


@query("inner_join_runs", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_acctbal < 0")
def inner_join_runs(t: Tables) -> DataFrame:
    c = t.customer.filter("c_acctbal < 0").select("c_custkey", "c_name")
    return t.orders.filter("o_orderstatus = 'F'").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query(
    "details_left_join",
    """SELECT c_custkey, c_name, coalesce(n_name, 'N/A') AS nation, coalesce(r_name, 'N/A') AS region, r_name IS NULL AS standalone
       FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 0 LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def details_left_join(t: Tables) -> DataFrame:
    n = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    r = t.region.select("r_regionkey", "r_name")
    out = t.customer.join(n, (F.col("c_nationkey") == F.col("n_nationkey")) & (F.col("c_acctbal") > 0), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("c_custkey", "c_name", F.coalesce("n_name", F.lit("N/A")).alias("nation"), F.coalesce("r_name", F.lit("N/A")).alias("region"), F.col("r_name").isNull().alias("standalone"))


@query("left_join_agg", "SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(round(sum(o_totalprice), 2), 0.0) AS spent FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def left_join_agg(t: Tables) -> DataFrame:
    o = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))  # one row a key meets the join
    return t.customer.select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("n_orders"), F.coalesce(F.round("s", 2), F.lit(0.0)).alias("spent"))


@query(
    "stats_filtered",
    """SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed, round(sum(value) FILTER (event_type = 'purchase'), 2) AS bought,
       round(avg(value) FILTER (event_type = 'view'), 4) AS mean_view, min(ts) FILTER (event_type = 'click') AS first_click, max(ts) FILTER (event_type = 'click') AS last_click FROM events GROUP BY user_id""",
)
def stats_filtered(t: Tables) -> DataFrame:
    kind = lambda k, c: F.when(F.col("event_type") == k, F.col(c))
    return t.events.groupBy("user_id").agg(
        F.count("*").alias("n"),
        F.count(kind("error", "event_id")).alias("failed"),
        F.round(F.sum(kind("purchase", "value")), 2).alias("bought"),
        F.round(F.avg(kind("view", "value")), 4).alias("mean_view"),
        F.min(kind("click", "ts")).alias("first_click"),
        F.max(kind("click", "ts")).alias("last_click"),
    )


@query("status_sums", "SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS done, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open, avg(o_totalprice)::DECIMAL(18, 3)::DOUBLE AS mean FROM orders GROUP BY 1")
def status_sums(t: Tables) -> DataFrame:
    one = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, 1).otherwise(0)).cast("long")
    return t.orders.groupBy("o_orderpriority").agg(one("F").alias("done"), one("O").alias("open"), F.avg("o_totalprice").cast("decimal(18,3)").cast("double").alias("mean"))


@query(
    "counter_refresh",
    """WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
       SELECT o_orderkey, coalesce(n, 0) AS chunks, coalesce(n, 0) * 3 AS to_process FROM orders LEFT JOIN c ON o_orderkey = l_orderkey""",
)
def counter_refresh(t: Tables) -> DataFrame:
    n = F.coalesce("n", F.lit(0).cast("long"))
    c = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return t.orders.select("o_orderkey").join(c, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", n.alias("chunks"), (n * 3).alias("to_process"))


@query("array_lengths", "SELECT p_partkey, CAST(len(string_split(p_type, ' ')) AS BIGINT) AS n FROM part")
def array_lengths(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.size(F.split("p_type", " ")).cast("long").alias("n"))


@query("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.expr("try_variant_get(parse_json(props), '$.k', 'bigint')").alias("k"))


@query("unnest_pairs", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word, unnest(range(1, len(string_split(p_type, ' ')) + 1)) AS pos FROM part")
def unnest_pairs(t: Tables) -> DataFrame:
    w = F.split("p_type", " ")
    z = F.arrays_zip(w.alias("word"), F.sequence(F.lit(1), F.size(w)).cast("array<bigint>").alias("pos"))
    return t.part.select("p_partkey", F.explode(z).alias("z")).select("p_partkey", F.col("z.word").alias("word"), F.col("z.pos").alias("pos"))


@query("upsert_latest", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(t: Tables) -> DataFrame:
    m = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id"))
    return t.events.groupBy("user_id", "event_type").agg(m.alias("m")).select("user_id", "event_type", "m.event_id", "m.value")


@query(
    "merge_rows",
    """SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0
       UNION ALL SELECT c_custkey, c_name || '-new', c_acctbal + 1 FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT -s_suppkey, s_name, s_acctbal FROM supplier""",
)
def merge_rows(t: Tables) -> DataFrame:
    old = t.customer.select("c_custkey", "c_name", "c_acctbal")
    new = old.filter("c_custkey % 3 = 0").select("c_custkey", F.concat("c_name", F.lit("-new")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    more = t.supplier.select((-F.col("s_suppkey")).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return catalog.upsert(old, new.unionByName(more), "c_custkey")


@query("owned_semi", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 13)")
def owned_semi(t: Tables) -> DataFrame:
    mine = t.orders.filter("o_custkey = 13").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity").join(mine, "l_orderkey", "left_semi")


@query("unprocessed_anti", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unprocessed_anti(t: Tables) -> DataFrame:
    return ledger.unprocessed(t.documents.select("doc_id", "n_chars"), t.labels, "doc_id")


@query("grab_copy", "SELECT c_name || '-grabbed' AS title, 'me' AS owner, c_acctbal FROM customer WHERE c_custkey = 11")
def grab_copy(t: Tables) -> DataFrame:
    row = t.customer.filter("c_custkey = 11").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), "c_acctbal")
    return catalog.grab(row, "me").select("title", "owner", "c_acctbal")


@query("partial_update", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'S' || c_custkey END, c_mktsegment) AS c_mktsegment, c_acctbal FROM customer")
def partial_update(t: Tables) -> DataFrame:
    new = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("S"), F.col("c_custkey").cast("string"))).alias("c_mktsegment"))
    return catalog.patch(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), new, "c_custkey", ["c_mktsegment"])


@query("guarded_transition", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'P') THEN o_orderstatus ELSE 'processing' END AS status FROM orders")
def guarded_transition(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    return t.orders.select("o_orderkey", F.when(s.isin("F", "P"), s).otherwise("processing").alias("status"))


@query("recent_public", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")
def recent_public(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderpriority = '1-URGENT'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(5).select("o_orderkey", "o_orderdate")


@query("keyset_files", "SELECT url, page_id FROM pages WHERE url > (SELECT min(url) FROM pages) ORDER BY url, page_id LIMIT 21")
def keyset_files(t: Tables) -> DataFrame:
    first = t.pages.agg(F.min("url")).first()[0]
    return t.pages.select("url", "page_id").filter(F.col("url") > F.lit(first)).orderBy("url", "page_id").limit(21)


@query("count_files", "SELECT count(*) AS n, count(*) FILTER (strlen(html) <= 2000) AS small FROM pages")
def count_files(t: Tables) -> DataFrame:
    return t.pages.agg(F.count("*").alias("n"), F.count(F.when(F.octet_length("html") <= 2000, 1)).alias("small"))


@query("vector_scroll", "SELECT vec_id, label, (SELECT count(*) FROM embeddings) AS total_count FROM embeddings WHERE vec_id >= 100 ORDER BY vec_id LIMIT 50")
def vector_scroll(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", "label")
    total = rows.agg(F.count("*").alias("total_count"))
    return rows.filter("vec_id >= 100").orderBy("vec_id").limit(50).crossJoin(F.broadcast(total))


@query("point_lookup", "SELECT vec_id, label, list_sum(embedding::DOUBLE[])::DECIMAL(18, 5)::DOUBLE AS s FROM embeddings WHERE vec_id = 42")
def point_lookup(t: Tables) -> DataFrame:
    s = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")).cast("decimal(18,5)").cast("double")
    return t.embeddings.filter("vec_id = 42").select("vec_id", "label", s.alias("s"))


@query(
    "integrity_violations",
    "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)",
)
def integrity_violations(t: Tables) -> DataFrame:
    c = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.select("o_orderkey", "o_custkey").join(c, "o_custkey", "left_anti")


@query("valid_titles", "SELECT p_partkey, length(trim(p_name)) > 0 AND length(p_name) <= 256 AS ok FROM part")
def valid_titles(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", catalog.valid_title(F.col("p_name")).alias("ok"))
