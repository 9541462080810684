"""Retrieval context, prompts, history and chunk references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftlake.functions.guard import chunk_block

#: What stands before the chunks, and in their stead if there are none.
PREAMBLE = 'Below are the relevant document chunks retrieved for this query. Reference them by their chunk number (e.g., "According to Chunk 1" or "As stated in Chunk 2") when answering.\n\n'
EMPTY_CONTEXT = "No relevant documents found."
MAX_CHUNKS, MIN_SCORE = 20, 0.2
TEMPERATURE, MAX_TOKENS = 0.7, 2000


def retrieve(scored: DataFrame, top: int = MAX_CHUNKS, floor: float = MIN_SCORE, text: str = "text", tie: str = "id") -> DataFrame:
    """The best chunks, then without those that have no text."""
    best = scored.filter(F.col("score") >= floor).orderBy(F.desc("score"), tie).limit(top)
    return best.filter(F.coalesce(F.col(text), F.lit("")) != "")


def build_context(retrieved: DataFrame, key: str = "conv_id", tie: str = "id") -> DataFrame:
    """(key, context) of the chunks (key, title, score, text), numbered by rank."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), tie)
    block = chunk_block(F.col("n"), F.coalesce("title", F.lit("unknown")), F.col("score"), F.col("text"))
    parts = retrieved.withColumn("n", F.row_number().over(w)).select(key, F.struct("n", F.concat(block, F.lit("\n\n")).alias("block")).alias("p"))
    return parts.groupBy(key).agg(F.concat(F.lit(PREAMBLE), F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["block"]), "")).alias("context"))


def replace_references(answer: Column, titles: Column) -> Column:
    """``Chunk n`` to the n-th title (null: Unknown Source); numbers without a title stay."""
    parts = F.split(answer, r"(?=Chunk \d)")

    def one(p: Column) -> Column:
        n = F.regexp_extract(p, r"^Chunk (\d+)", 1)
        k = n.try_cast("int")
        title = F.coalesce(F.get(titles, k - 1), F.lit("Unknown Source"))
        known = (n != "") & k.isNotNull() & (k >= 1) & (k <= F.size(titles))
        return F.when(known, F.concat(title, F.substring(p, F.length(n) + 7, F.length(p)))).when(
            (n != "") & k.isNotNull(), F.concat(F.lit("Chunk "), k.cast("string"), F.substring(p, F.length(n) + 7, F.length(p)))
        ).otherwise(p)

    return F.array_join(F.transform(parts, one), "")


def fill_prompt(template: Column, chunks: Column) -> Column:
    return F.replace(template, F.lit("{{chunks}}"), chunks)


def clamp_options(temperature: Column, max_tokens: Column) -> tuple[Column, Column]:
    t = F.least(F.lit(2.0), F.greatest(F.lit(0.0), F.coalesce(temperature, F.lit(TEMPERATURE))))
    return t, F.greatest(F.lit(1), F.coalesce(max_tokens, F.lit(MAX_TOKENS)))


def history(messages: DataFrame, key: str = "conv_id", complete: Column | None = None, last: int | None = None) -> DataFrame:
    """(key, history): the messages in turn order as ``role: text`` lines.

    With ``complete`` only messages for which it is true, and with ``last`` the last
    so many of these, so that a row stays bounded however long a conversation is.
    """
    if complete is not None:
        messages = messages.filter(complete)
    if last is not None:
        w = Window.partitionBy(key).orderBy(F.desc("turn"), "role", "text")
        messages = messages.withColumn("_back", F.row_number().over(w)).filter(F.col("_back") <= last).drop("_back")
    return messages.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n").alias("history"),
        F.count("*").alias("n_messages"),
    )


def regenerate(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """Each assistant turn with the last user text before it; turns without one are left out."""
    w = Window.partitionBy(key).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w)
    return messages.withColumn("question", asked).filter((F.col("role") == "assistant") & F.col("question").isNotNull()).select(key, "turn", "question")
