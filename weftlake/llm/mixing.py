"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed in Spark for each cell of source, language and topic. Raking
scales the cells until the sums over sources, over languages and over topics
meet their targets; the factor of each cell, over that of the cells of greatest
factor, is the probability with which its documents are drawn.

Up to ``MAX_CELLS`` cells, counted first, are raked as arrays on the driver. Beyond
that sources stay in Spark, one row each, and every round is one pass over these
rows; where languages and topics have no more than ``MAX_PAIRS`` pairs their sums
come to the driver, else all cells stay in Spark.

Topics come from a column of the documents, from a model of topics fitted to all
of them (:mod:`weftlake.llm.topics`), or from named patterns.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlake.llm.common import need, unit_hash, words
from weftlake.llm.topics import TopicModel, fit_topics, with_topics
from weftlake.session import drop_stash, stash

#: Topics by the first pattern that a text holds, else REST_TOPIC: a fallback without a fit.
PATTERNS = {
    "legal": r"(?i)licensed under|copyright|all rights reserved",
    "contact": r"[A-Za-z0-9._]@[A-Za-z0-9]|\+?[0-9][0-9() -]{7,}[0-9]",
    "markup": r"[*#$%&]{3}",
}
REST_TOPIC = "general"
NONE = "\x00none"
TEMPER = 0.9
#: Pairs of language and topic whose factors the driver holds; more are raked in Spark, cell by cell.
MAX_PAIRS = 1_000
TOLERANCE = 1e-6
#: Cells that are raked on the driver, some 40 bytes each.
MAX_CELLS = 65_536
#: Targets are out of reach where as many rounds again leave more than this share of the gap.
NEARER = 0.9
#: Rounds before that is asked for the first time, on the driver and in Spark, where a round is a job.
PATIENCE, SPARK_PATIENCE = 4_096, 64
#: Share of the tokens whose greatest weights have probability one.
PEAK_SHARE = 0.001
BROADCAST_CELLS = 100_000
SEED = 9

Topics = Mapping[str, str] | TopicModel


def topic_of(text: Column, topics: Mapping[str, str] = PATTERNS) -> Column:
    out = None
    for name, pattern in topics.items():
        hit = text.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(REST_TOPIC) if out is None else out.otherwise(REST_TOPIC)


def tempered(sums: dict[str, float], temper: float) -> dict[str, float]:
    total = sum(sums.values()) or 1.0
    powers = {k: (v / total) ** temper if v > 0 else 0.0 for k, v in sums.items()}
    whole = sum(powers.values()) or 1.0
    return {k: v / whole for k, v in powers.items()}


def normalised(weights: Mapping[str, float]) -> dict[str, float]:
    if any(w < 0 for w in weights.values()) or not sum(weights.values()):
        raise ValueError("target weights must be non-negative and not all zero")
    return {k: w / sum(weights.values()) for k, w in weights.items()}


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, temper: float = TEMPER) -> DataFrame:
    """(source, lang, topic, tokens, weight, probability, repeats, residual) from (source, lang, topic, tokens).

    ``targets`` gives weights by value for any of source, lang and topic; values
    that it leaves out get none. Without it a marginal's targets are the token
    shares to the power ``temper``, normalised. Rounds go on until all marginals
    meet their targets within TOLERANCE, or twice the rounds leave the gap as it
    was (NEARER), as where no weighting can meet them. Targets that only weights
    of zero can meet are neared as one over the rounds, and so are met too.
    ``residual`` is the largest gap that is left, as a share of all tokens, and
    more than TOLERANCE gives a warning.

    ``probability`` is the weight over the least weight of the cells that hold
    the top PEAK_SHARE of the tokens: rare cells of great weight don't set the
    share that all others keep. They have probability one and what is missing as
    ``repeats``, the times that their documents should be used. Cells without
    tokens have weight and probability 0.
    """
    targets = {k: normalised(v) for k, v in (targets or {}).items()}
    n, n_langs, n_topics = cells.agg(F.count("*"), F.count_distinct("lang"), F.count_distinct("topic")).first()
    flat, residual = (rake_few if n <= MAX_CELLS else rake_pairs if n_langs * n_topics <= MAX_PAIRS else rake_cells)(cells, targets, temper)
    if residual > TOLERANCE:
        warnings.warn(f"raking left a gap of {residual:.2e} of all tokens to the targets", stacklevel=2)
    # A histogram of the weights, by sixteenths of powers of two, finds the peak: some thousand rows at most.
    level = F.floor(F.log2("weight") * 16).cast("long")
    total = flat.agg(F.sum("tokens")).first()[0] or 1.0
    peak, seen = 1.0, 0.0
    for r in flat.filter("tokens > 0 AND weight > 0").groupBy(level.alias("level")).agg(F.sum("tokens").alias("m"), F.min("weight").alias("w")).orderBy(F.desc("level")).collect():
        peak, seen = r.w, seen + r.m
        if seen >= PEAK_SHARE * total:
            break
    times = F.col("weight") / peak
    return flat.select("source", "lang", "topic", "tokens", (F.col("weight") * total).alias("weight"), F.least(F.lit(1.0), times).alias("probability"), F.greatest(F.lit(1.0), times).alias("repeats"), F.lit(residual).alias("residual"))


def marginal(cells: DataFrame, name: str, targets: dict[str, dict[str, float]], temper: float) -> DataFrame:
    """(value, target) of a marginal, in Spark."""
    if name in targets:
        return cells.sparkSession.createDataFrame([(k, float(v)) for k, v in targets[name].items()], "value string, target double")
    by = cells.groupBy(F.col(name).alias("value")).agg(F.sum("tokens").cast("double").alias("m")).withColumn("p", F.when(F.col("m") > 0, F.pow("m", F.lit(temper))).otherwise(0.0))
    whole = by.agg(F.sum("p")).first()[0] or 1.0
    return by.select("value", (F.col("p") / whole).alias("target"))


class _Progress:
    """Whether rounds are done: the gap is within TOLERANCE, or as many rounds again have left it as it was."""

    def __init__(self, patience: int):
        self.rounds, self.ask, self.before = 0, patience, float("inf")

    def done(self, gap: float) -> bool:
        self.rounds += 1
        if gap < TOLERANCE:
            return True
        if self.rounds < self.ask:
            return False
        stuck, self.before, self.ask = gap > self.before * NEARER, gap, 2 * self.ask
        return stuck


def rake_few(cells: DataFrame, targets: dict[str, dict[str, float]], temper: float) -> tuple[DataFrame, float]:
    """As :func:`rake_pairs` for MAX_CELLS cells at most, which come to the driver."""
    names = ["source", "lang", "topic"]
    rows = sorted((r.source, r.lang, r.topic, int(r.tokens or 0)) for r in cells.select(*names, "tokens").collect())
    tokens = np.array([r[3] for r in rows], dtype=np.float64)
    sides = []
    for k, name in enumerate(names):
        values, at = np.unique(np.array([r[k] for r in rows], dtype=object), return_inverse=True)
        sums = np.bincount(at, tokens, minlength=len(values))
        by = targets.get(name) or tempered(dict(zip(values, sums.tolist())), temper)
        sides.append((at, np.array([by.get(v, 0.0) for v in values])))
    mass, gap, progress = tokens.copy(), 0.0, _Progress(PATIENCE)
    while rows:
        gap = 0.0
        for k, (at, goal) in enumerate(sides):
            now = np.bincount(at, mass, minlength=len(goal))
            if k:  # the first marginal's gap is that which the round before left by meeting the others
                gap = max(gap, float(np.abs(now - goal).max()))
            mass *= np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[at]
        if progress.done(gap):
            break
    weight = np.divide(mass, tokens, out=np.zeros_like(mass), where=tokens > 0)
    out = [(*r[:3], float(r[3]), w) for r, w in zip(rows, weight.tolist())]
    return cells.sparkSession.createDataFrame(out, "source string, lang string, topic string, tokens double, weight double"), gap


def rake_cells(cells: DataFrame, targets: dict[str, dict[str, float]], temper: float) -> tuple[DataFrame, float]:
    """As :func:`rake_pairs` for any number of languages and topics: one row a cell, all in Spark."""
    names = ["source", "lang", "topic"]
    wanted = {n: stash(marginal(cells, n, targets, temper), "target") for n in names}
    now = stash(cells.select(*names, F.col("tokens").cast("double").alias("tokens"), F.lit(1.0).alias("weight")), "rake")
    progress = _Progress(SPARK_PATIENCE)
    while True:
        off = 0.0
        for n in names:
            mass = now.groupBy(F.col(n).alias("value")).agg(F.sum(F.col("tokens") * F.col("weight")).alias("m"))
            factor = stash(mass.join(wanted[n], "value", "left").select("value", "m", F.coalesce("target", F.lit(0.0)).alias("target")), "factor")
            if n != names[0]:  # the last round's gap, as the first marginal has just been met
                off = max(off, factor.agg(F.max(F.abs(F.col("m") - F.col("target")))).first()[0] or 0.0)
            scaled = now.join(factor, F.col(n) == F.col("value")).withColumn("weight", F.when(F.col("m") > 0, F.col("weight") * F.col("target") / F.col("m")).otherwise(0.0))
            new = stash(scaled.select(*names, "tokens", "weight"), "rake")
            drop_stash(now)
            now = new
        if progress.done(off):
            return now, off


def rake_pairs(cells: DataFrame, targets: dict[str, dict[str, float]], temper: float) -> tuple[DataFrame, float]:
    """(cells with weights that give shares of one in all, gap): factors of languages and topics on the driver, of sources in Spark."""
    spark = cells.sparkSession
    sums = cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("m")).collect()  # at most MAX_PAIRS
    langs, topics = sorted({r.lang for r in sums}), sorted({r.topic for r in sums})

    def target(name: str, values: list[str]) -> list[float]:
        by = targets.get(name) or tempered({v: float(sum(r.m for r in sums if r[name] == v)) for v in values}, temper)
        return [by.get(v, 0.0) for v in values]

    want_l, want_t = target("lang", langs), target("topic", topics)
    pairs = spark.createDataFrame([(l, t, i * len(topics) + j) for i, l in enumerate(langs) for j, t in enumerate(topics)], "lang string, topic string, k int")
    rows = cells.join(F.broadcast(pairs), ["lang", "topic"]).groupBy("source").agg(F.collect_list(F.struct("k", F.col("tokens").cast("double").alias("m"))).alias("cells"))  # one element a pair
    goal = marginal(cells, "source", targets, temper).withColumnRenamed("value", "source")
    rows = stash(rows.join(goal, "source", "left").select("source", "cells", F.coalesce("target", F.lit(0.0)).alias("target")), "rake")
    b, c = [1.0] * len(langs), [1.0] * len(topics)

    def scaled() -> DataFrame:
        f = f"array({', '.join(f'{x * y!r}D' for x in b for y in c)})"
        mass = F.expr(f"aggregate(transform(cells, x -> x.m * {f}[x.k]), 0D, (s, x) -> s + x)")
        return rows.select("source", F.when(mass > 0, F.col("target") / mass).otherwise(0.0).alias("a"), F.expr(f"transform(cells, x -> struct(x.k AS k, x.m AS m, {f}[x.k] AS f))").alias("cells"))

    progress, off = _Progress(SPARK_PATIENCE), 0.0
    while sums:
        now = scaled().select("a", F.explode("cells").alias("x")).groupBy("x.k").agg(F.sum(F.col("a") * F.col("x.m") * F.col("x.f")).alias("m")).collect()
        m = [[0.0] * len(topics) for _ in langs]
        for r in now:
            m[r.k // len(topics)][r.k % len(topics)] = r.m
        off = 0.0
        for i, want in enumerate(want_l):
            s = sum(m[i])
            off = max(off, abs(s - want))
            b[i] *= want / s if s > 0 else 0.0
            m[i] = [x * (want / s if s > 0 else 0.0) for x in m[i]]
        for j, want in enumerate(want_t):
            s = sum(row[j] for row in m)
            off = max(off, abs(s - want))
            c[j] *= want / s if s > 0 else 0.0
        if progress.done(off):
            break
    flat = scaled().select("source", "a", F.explode("cells").alias("x")).select("source", F.col("x.k").alias("k"), F.col("x.m").alias("tokens"), (F.col("a") * F.col("x.f")).alias("weight"))
    return stash(flat.join(F.broadcast(pairs), "k").drop("k"), "weights"), off


def _keyed(docs: DataFrame, at: Mapping[str, str], names: list[str], topics: Topics, keep_text: bool) -> DataFrame:
    """``docs`` with source, language, topic, number of words and draw; ``at`` has the columns of id, text, source, lang and topic."""
    source, lang, topic, n, u = names
    text = F.coalesce(F.col(at["text"]), F.lit(""))
    out = docs.withColumns(
        {
            source: F.coalesce(F.col(at["source"]).cast("string"), F.lit(NONE)),
            lang: F.coalesce(F.col(at["lang"]).cast("string"), F.lit(NONE)),
            u: unit_hash(F.col(at["id"]), F.xxhash64(text), F.lit(SEED)),
        }
    )
    if "topic" not in at and isinstance(topics, TopicModel):
        return with_topics(out, topics, at["text"], n, topic, keep_text)
    value = F.coalesce(F.col(at["topic"]).cast("string"), F.lit(NONE)) if "topic" in at else topic_of(text, topics)
    out = out.withColumns({topic: value, n: F.size(words(F.col(at["text"]))).cast("long")})
    return out if keep_text else out.drop(at["text"])


def _drawn(keyed: DataFrame, names: list[str], targets, temper: float) -> DataFrame:
    """``keyed`` with the weight, probability, repeats and residual of each row's cell."""
    source, lang, topic, n, _ = names
    cells = stash(keyed.groupBy(F.col(source).alias("source"), F.col(lang).alias("lang"), F.col(topic).alias("topic")).agg(F.sum(n).alias("tokens")), "cells")
    w = rake(cells, targets, temper)
    w = stash(w.drop("tokens").toDF(*(f"\x00{c}" for c in ("s", "l", "t", "weight", "probability", "repeats", "residual"))), "drawn")
    right = F.broadcast(w) if w.count() <= BROADCAST_CELLS else w
    return keyed.join(right, (keyed[source] == w["\x00s"]) & (keyed[lang] == w["\x00l"]) & (keyed[topic] == w["\x00t"])).drop(w["\x00s"], w["\x00l"], w["\x00t"])


def mix_report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", targets=None, temper: float = TEMPER, topic_col: str | None = None, topics: Topics | None = None
) -> DataFrame:
    """One row for each document: source, lang, topic, n_tokens (words), weight, probability, repeats, residual and kept.

    Topics are those of ``topic_col``, else of the model or the patterns given
    as ``topics`` (PATTERNS has some), else of a model that is fitted to ``docs``.
    The draw depends on id and text alone, so that equal rows share it. Null
    sources, languages and topics are values of their own; a null text counts as
    empty; documents without words have the weight of their cell, 0 if the cell
    has no words at all. An empty table gives no rows.
    """
    need(docs, id_col, text_col, source_col, lang_col, *([topic_col] if topic_col else []))
    at = {"id": id_col, "text": text_col, "source": source_col, "lang": lang_col} | ({"topic": topic_col} if topic_col else {})
    d = docs.select(*(F.col(c).alias(k) for k, c in at.items()))
    names = ["s", "l", "t", "n", "u"]
    keyed = stash(_keyed(d, {k: k for k in at}, names, _topics(d, "text", topic_col, topics), False), "mix")
    out = _drawn(keyed, names, targets, temper)
    extra = [F.col(f"\x00{c}").alias(c) for c in ("weight", "probability", "repeats", "residual")]
    return out.select(F.col("id").alias(id_col), "source", "lang", F.col("t").alias("topic"), F.col("n").alias("n_tokens"), *extra, (F.col("u") < F.col("\x00probability")).alias("kept"))


def mix_sample(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", targets=None, temper: float = TEMPER, topic_col: str | None = None, topics: Topics | None = None
) -> DataFrame:
    """The documents that are drawn, with the columns they came with; same draw, nulls and ties as :func:`mix_report`."""
    need(docs, id_col, text_col, source_col, lang_col, *([topic_col] if topic_col else []))
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    given = {"id": id_col, "text": text_col, "source": source_col, "lang": lang_col} | ({"topic": topic_col} if topic_col else {})
    at = {k: f"c{docs.columns.index(c)}" for k, c in given.items()}
    names = ["s", "l", "t", "n", "u"]
    keyed = _keyed(plain, at, names, _topics(plain, at["text"], topic_col, topics), True)
    out = _drawn(keyed, names, targets, temper).filter(F.col("u") < F.col("\x00probability"))
    return out.select(*plain.columns).toDF(*docs.columns)


def _topics(docs: DataFrame, text_col: str, topic_col: str | None, topics: Topics | None) -> Topics:
    return {} if topic_col else topics if topics is not None else fit_topics(docs, text_col)
