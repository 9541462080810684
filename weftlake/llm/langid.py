"""Language identification by rank-order n-gram profiles.

A profile holds the ``PROFILE`` most frequent n-grams of one to three letters of
a language, in the order of their counts over all training texts. A document's
own most frequent n-grams are compared with each profile: the out-of-place
distance sums how far each stands from its place there, and PROFILE for those
that the profile lacks.

Texts are lower-cased, and each run of other characters than letters counts as
one blank, as do the ends. N-grams are packed in whole numbers and counted in
NumPy by sorting; nothing depends on the length of a text but the work.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftlake.llm.arrays import Lists
from weftlake.llm.common import fresh, need

PROFILE = 300
SIZES = (1, 2, 3)
BITS = 21  # of a code point
PIECE = 1 << 21  # letters that are counted at once
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """True for each code point that is a letter."""
    out = np.zeros(0x110000, bool)
    out[:0xD800] = np.fromiter((chr(c).isalpha() for c in range(0xD800)), bool, 0xD800)
    out[0xE000:] = np.fromiter((chr(c).isalpha() for c in range(0xE000, 0x110000)), bool, 0x110000 - 0xE000)
    return out


def ngrams(text: str) -> np.ndarray:
    """All n-grams of a text as numbers, blanks alone left out; empty if it has no letter."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[x]
    if not letter.any():
        return np.zeros(0, np.int64)
    blank = ~letter
    keep = letter.copy()
    keep[1:] |= blank[1:] & letter[:-1]  # the first blank after a letter
    y = np.where(letter, x, 32)[keep].astype(np.int64)
    y = np.concatenate([[32], y] if y[-1] == 32 else [[32], y, [32]])
    out = [y[y != 32]]
    for n in SIZES[1:]:
        k = y[: len(y) - n + 1].copy()
        for i in range(1, n):
            k = k << BITS | y[i : len(y) - n + 1 + i]
        out.append(k)
    return np.concatenate(out)


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts) over all of a list's texts."""
    held, grams, counts = 0, [], []
    part: list[np.ndarray] = []

    def fold() -> None:
        u, n = np.unique(np.concatenate(part), return_counts=True)
        grams.append(u)
        counts.append(n)
        part.clear()

    for t in texts:
        part.append(ngrams(t))
        held += len(part[-1])
        if held > PIECE:
            fold()
            held = 0
    if part:
        fold()
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    u, at = np.unique(np.concatenate(grams), return_inverse=True)
    return u, np.bincount(at, weights=np.concatenate(counts), minlength=len(u)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        by: dict[str, list[str]] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            by.setdefault(lang, []).append(text or "")
        for lang, texts in by.items():
            g, n = counted(texts)
            if len(g):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g), pa.array(n)], ["lang", "gram", "n"])


def train_profiles(labelled: DataFrame, profile: int = PROFILE) -> dict[str, np.ndarray]:
    """The profile of each language of ``labelled`` (lang, text): counts over all its rows; equal counts stand by n-gram.

    ``profile`` n-grams a language come to the driver, 16 bytes each in the model.
    """
    counts = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("place") <= profile)
    rows = top.select("lang", "gram", "place").toPandas().sort_values(["lang", "place"])  # ``profile`` rows a language
    return {lang: g["gram"].to_numpy(np.int64) for lang, g in rows.groupby("lang")}


class Profiles:
    """All profiles as one sorted array of n-grams, each with the languages that hold it and its places there."""

    def __init__(self, profiles: dict[str, np.ndarray], profile: int = PROFILE):
        self.langs, self.profile = sorted(profiles), profile
        grams = np.concatenate([np.zeros(0, np.int64), *(profiles[k] for k in self.langs)])
        size = [len(profiles[k]) for k in self.langs]
        lang, place = np.repeat(np.arange(len(size), dtype=np.int32), size), np.concatenate([np.zeros(0, np.int32), *(np.arange(n, dtype=np.int32) for n in size)])
        order = np.argsort(grams, kind="stable")
        self.lang, self.place = lang[order], place[order]
        self.grams, first = np.unique(grams[order], return_index=True)
        self.at = np.append(first, len(grams))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, the first by name of equally near ones, and 1 - distance / greatest distance."""
        g = ngrams(text or "")
        if not len(g) or not self.langs:
            return UNDETERMINED, 0.0
        if len(g) > PIECE:
            g, n = counted([text])
        else:
            g, n = np.unique(g, return_counts=True)
        top = g[np.argsort(-n, kind="stable")[: self.profile]]  # equal counts stand by n-gram
        k = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        mine = np.flatnonzero(self.grams[k] == top)
        held = Lists(np.arange(len(self.lang)), self.at).take(k[mine])
        at = np.repeat(mine, np.diff(held.at))
        near = self.profile - np.abs(self.place[held.values] - at)
        off = self.profile * len(top) - np.bincount(self.lang[held.values], near, len(self.langs)).astype(np.int64)
        best = int(np.argmin(off))
        return self.langs[best], 1 - float(off[best]) / (self.profile * len(top))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Every row with its columns, the predicted language and the score (0 to 1).

    Null texts and texts without a letter are ``und`` with score 0, as are all if
    there is no profile. Repeated rows are each predicted; columns of any other
    name stay. An empty table gives no rows.
    """
    need(docs, text_col)
    model = docs.sparkSession.sparkContext.broadcast(Profiles(profiles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = model.value
        for b in batches:
            found = [p.predict(t.as_py()) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], [*b.schema.names[:-1], "lang_pred", "score"]
            )

    plain = [f"c{k}" for k in range(len(docs.columns))]
    schema = docs.toDF(*plain).schema.add("lang_pred", "string").add("score", "double")
    (text,) = fresh(docs, "text_in")
    return docs.withColumn(text, F.col(text_col)).toDF(*plain, "t").mapInArrow(run, schema).toDF(*docs.columns, lang_out, score_out)


def language_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """One row for each document: held_out, lang_pred and score.

    Documents whose crc32(id as text) is divisible by ``folds`` are held out of
    the profiles; a null id counts as the empty text. Other columns than id, text
    and lang are not read, and lang only of the documents that are learned from.
    """
    need(docs, id_col, text_col, lang_col)
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0
    profiles = train_profiles(docs.filter(~held).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")))
    out = identify(docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).alias("text")), profiles)
    return out.select(F.col("id").alias(id_col), "held_out", "lang_pred", "score")
