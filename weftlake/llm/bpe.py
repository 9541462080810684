"""Byte-level BPE encoding and decoding with a transducer lexicon.

Spark counts the words of all texts; the ``lexicon_words`` most frequent, a
documented bound, are compiled with their ids into a minimal acyclic
transducer, which every executor gets as one file and memory-maps. Words that
it doesn't hold are merged exactly, by the ranks of the vocabulary. The size of
the lexicon changes speed alone, never an id.
"""

from __future__ import annotations

import contextlib
import json
import os
import tempfile
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlake.llm import lexicon
from weftlake.llm.arrays import Lists, parts, put, release, runs, slices
from weftlake.llm.common import fresh, need
from weftlake.session import shared_path, stash

#: The word pattern of the vocabulary's format, white space written out.
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Code points that the installed pattern library has as letters or numbers and the format (an older Unicode) has not.
LATER = """
558, 58B-58C, 88F, C5C, CDC, 208F, 209D-209F, A7CE-A7CF, A7D2, A7D4, A7DD, A7E2, A7F1, AB6C-AB6D, 107BB-107BF,
10940-10959, 10EC5-10EC7, 10ED9-10EEE, 11B0A, 11DB0-11DDB, 11DE0-11DE9, 11DF1, 1246F, 12475-1247F, 12550-12686,
16EA0-16EB8, 16EBB-16ED3, 16FF2-16FF6, 187F8-187FF, 18CD6-18CDA, 18D09-18D20, 18D80-18DF2, 18E00-19191, 191A0-191D2,
1B123-1B128, 1B168, 1D6A6, 1DF1F-1DF24, 1DF2B-1DF81, 1DF90-1DF96, 1DFCD-1DFFF, 1E6C0-1E6DE, 1E6E0-1E6E2, 1E6E4-1E6E5,
1E6E7-1E6ED, 1E6F0-1E6F4, 1E6FE-1E6FF, 2B73A-2B73F, 2B81E, 2CEA2-2CEAD, 323B0-33479, 3D000-3FC3F
"""
_X = "".join("-".join(rf"\U{int(c, 16):08X}" for c in x.split("-")) for x in LATER.replace("\n", " ").split(", "))
LATER_PATTERN = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{_X}]]+| ?[\p{{N}}--[{_X}]]+| ?[[^{_S}\p{{L}}\p{{N}}]||[{_X}]]+|[{_S}]+(?![^{_S}])|[{_S}]+"
LEXICON_WORDS = 1 << 16
#: The pattern's white space beyond ASCII.
WIDE_SPACE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: One word of the pattern, of Latin letters alone.
PLAIN = r"^ ?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+$"
#: Bytes from which on a word is merged by a heap.
LONG = 2048
#: Bytes of text that are encoded at once, and of distinct segments that are held while words are counted.
SLICE_BYTES = 4 << 20
COUNTED_BYTES = 12 << 20


@lru_cache
def byte_chars() -> dict[str, int]:
    """The format's character for each byte: printable Latin-1 as itself, all others from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """The ids, merges and special tokens of a byte-level BPE file of the tokenizers format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or model["ignore_merges"] or model["dropout"]:
            raise ValueError(f"{path}: only plain byte-level BPE is supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: special tokens that strip their surroundings aren't supported")
        chars = byte_chars()
        ids = {bytes(chars[c] for c in k): v for k, v in model["vocab"].items() if all(c in chars for c in k)}
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []  # by rank
        for rank, pair in enumerate(model["merges"]):
            a, b = (bytes(chars[c] for c in x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.ranks[ids[a], ids[b]] = rank
            self.merged.append(ids[a + b])
        pairs = np.array([a << 32 | b for a, b in self.ranks], np.int64)
        order = np.argsort(pairs)
        self._pairs, self._rank = pairs[order], np.fromiter(self.ranks.values(), np.int64, len(pairs))[order]
        self._merged, self._byte_ids = np.array(self.merged, np.int64), np.array(self.byte_ids, np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        table = {v: k for k, v in ids.items()} | {v: k.encode() for k, v in self.special.items()}
        pieces = [table.get(i, b"") for i in range(max(table) + 1)]
        self._bytes = Lists(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([0, *map(len, pieces)]))
        self._words, self._later, self._has_later = regex.compile(PATTERN).findall, regex.compile(LATER_PATTERN).findall, regex.compile(f"[{_X}]").search

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens; joined they give the text."""
        return self._words(text) if text.isascii() or not self._has_later(text) else self._later(text)

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The ids of one word: the pair of the lowest rank, the leftmost first, is merged until none is left."""
        ids, get, none = self.byte_ids, self.ranks.get, len(self.merged)
        x = [ids[b] for b in word]
        r = [get(p, none) for p in zip(x, x[1:])]
        while r:
            least = min(r)
            if least == none:
                break
            k = r.index(least)
            x[k : k + 2] = [self.merged[least]]
            del r[k]
            if k:
                r[k - 1] = get((x[k - 1], x[k]), none)
            if k < len(r):
                r[k] = get((x[k], x[k + 1]), none)
        return tuple(x)

    def words_of(self, segments: pa.Array) -> tuple[pa.DictionaryArray, Lists, np.ndarray]:
        """(words, their numbers list by list, the list of each segment) of a string array; special tokens are words.

        Segments that are one word of Latin letters, most of them, don't meet the pattern.
        """
        plain = pc.match_substring_regex(segments, PLAIN).to_numpy(zero_copy_only=False)
        cut = [[s] if s in self.special else self.words(s) for s in segments.filter(pa.array(~plain)).to_pylist()]
        words = pa.concat_arrays([segments.filter(pa.array(plain)), pa.array(list(chain.from_iterable(cut)), pa.string())]).dictionary_encode()
        n = int(plain.sum())
        place = np.zeros(len(segments), np.int64)
        place[plain], place[~plain] = np.arange(n), n + np.arange(len(cut))
        return words, Lists(words.indices.to_numpy(), np.concatenate([np.arange(n), n + np.cumsum([0, *map(len, cut)])])), place

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids; the number of merges for those that none joins."""
        want = a << 32 | b
        k = np.minimum(np.searchsorted(self._pairs, want), len(self._pairs) - 1)
        return np.where(self._pairs[k] == want, self._rank[k], len(self._merged))

    def merge_all(self, data: np.ndarray, at: np.ndarray) -> Lists:
        """As :meth:`merge` for many words, none of them empty, at once: each round merges one pair of every word that has one."""
        none = len(self._merged)
        x, word = self._byte_ids[data], np.repeat(np.arange(len(at) - 1), np.diff(at))
        inner = np.append(word[1:] == word[:-1], False) if len(x) else np.zeros(0, bool)
        r = np.where(inner, self.rank(x, np.append(x[1:], 0)), none) if len(x) else x
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(x):
            first = runs(word)
            size = np.diff(first, append=len(word))
            least = np.minimum.reduceat(r, first)
            over = np.repeat(least == none, size)
            if over.any():
                done.append((word[over], x[over]))
                left = least != none
                x, r, word, least, size = x[~over], r[~over], word[~over], least[left], size[left]
                if not len(x):
                    break
                first = np.cumsum(size) - size
            hit = np.flatnonzero(r == np.repeat(least, size))
            pos = hit[runs(word[hit])]  # the leftmost of each word
            x[pos] = self._merged[least]
            keep = np.ones(len(x), bool)
            keep[pos + 1] = False
            x, r, word = x[keep], r[keep], word[keep]
            pos -= np.arange(len(pos))  # one symbol less for each word before
            left = pos[np.concatenate([[False], word[1:] == word[:-1]])[pos]]
            r[left - 1] = self.rank(x[left - 1], x[left])
            right = np.append(word[1:] == word[:-1], False)[pos]
            r[pos] = none
            r[pos[right]] = self.rank(x[pos[right]], x[pos[right] + 1])
        words = np.concatenate([np.zeros(0, np.int64), *(w for w, _ in done)])
        order = np.argsort(words, kind="stable")
        return Lists(np.concatenate([np.zeros(0, np.int64), *(v for _, v in done)])[order], np.searchsorted(words[order], np.arange(len(at))))

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text between special tokens, and these."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            if m.start() > at:
                yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def entries(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray | None]:
        """(pieces between special tokens and these, whether a piece is one segment, number of the first piece of each text or None if they are the texts).

        Special tokens are one segment, as are texts that hold white space
        beyond ASCII, which the pattern then cuts as a whole.
        """
        found = np.zeros(len(texts), bool)
        for token in self.special:
            found |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        owner, special = None, np.zeros(len(texts), bool)
        if found.any():
            pieces = [list(self.pieces(t)) if hit else [(t, False)] for t, hit in zip(texts.to_pylist(), found)]
            owner = np.cumsum([0, *map(len, pieces)])
            texts = pa.array([p for x in pieces for p, _ in x], pa.string())
            special = np.array([q for x in pieces for _, q in x], bool)
        wide = pc.match_substring_regex(texts, WIDE_SPACE).to_numpy(zero_copy_only=False)
        return texts, special | wide, owner

    def decode_all(self, ids: Lists) -> pa.Array:
        """The text of each list of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        found = self._bytes.take(ids.values)
        ends = found.at[ids.at]
        if ends[-1] < 1 << 31:
            with contextlib.suppress(pa.ArrowInvalid):
                return Lists(found.values, ends).binary().cast(pa.string())
        return pa.array([found.values[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends, ends[1:])], pa.string())

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(Lists(np.array(ids, np.int64), np.array([0, len(ids)])))[0].as_py()


class Encoder:
    """Encodes many texts at once: cuts them into segments, and works on each distinct one.

    A segment is a run of other characters than white space with the one blank
    before it, or white space that the pattern can't join to what follows; no
    word of the pattern spans two. Distinct segments of a slice of texts are cut
    into words, these walk the lexicon together, the words that it lacks are
    merged, and the ids of all segments are gathered by their number. Merged
    words are remembered up to ``memo`` of them.
    """

    def __init__(self, vocabulary: Vocabulary, words: lexicon.Lexicon | None = None):
        self.vocabulary, self.lexicon = vocabulary, words

    def words(self, distinct: pa.Array) -> Lists:
        """The ids of each of the distinct words, a binary array."""
        at, data = parts(distinct)
        rank = self.lexicon.find(data, at) if self.lexicon else np.full(len(distinct), -1)
        size = np.diff(at)
        unseen, long = np.flatnonzero((rank < 0) & (size < LONG)), np.flatnonzero((rank < 0) & (size >= LONG))
        found = [self.vocabulary.merge_all(*reversed(parts(distinct.take(pa.array(unseen)))))]
        for k in long:
            ids = merge_long(self.vocabulary, data[at[k] : at[k + 1]].tobytes())
            found.append(Lists(np.array(ids, np.int64), np.array([0, len(ids)])))
        if self.lexicon:
            found.append(Lists(self.lexicon.ids, self.lexicon.at))
        rank[unseen], rank[long] = np.arange(len(unseen)), len(unseen) + np.arange(len(long))
        known = np.ones(len(rank), bool)
        known[unseen] = known[long] = False
        rank[known] += len(unseen) + len(long)
        ends = np.cumsum([0] + [len(x.values) for x in found])
        values = np.concatenate([x.values.astype(np.int32) for x in found])
        return Lists(values, np.concatenate([[0], *(x.at[1:] + e for x, e in zip(found, ends))])).take(rank)

    def encode_all(self, texts: pa.Array) -> Lists:
        """The ids of each text of a string array without nulls."""
        v = self.vocabulary
        texts, special, owner = v.entries(texts)
        segments, first = cut_segments(texts, special)
        coded = segments.dictionary_encode()
        words, of, place = v.words_of(coded.dictionary.cast(pa.string()))
        ids = self.words(words.dictionary.cast(pa.binary()))
        if special.any():
            for k, w in enumerate(words.dictionary.to_pylist()):
                if w in v.special:
                    ids = ids.replaced(k, v.special[w])
        out = ids.take(of.values).grouped(of.at).take(place[coded.indices.to_numpy()]).grouped(first)
        return out if owner is None else out.grouped(owner)

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text], pa.string())).values.tolist()


def cut_segments(texts: pa.Array, whole: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The segments of all texts as a binary array, and the number of the first one of each text; ``whole`` texts are one segment.

    White space before other characters gives up its last one: a blank goes to
    the segment that follows, any other is a segment of its own.
    """
    at, data = parts(texts)
    n = len(data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    for k in np.flatnonzero(whole):
        space[at[k] : at[k + 1]] = False
    begin = np.zeros(n + 1, bool)
    begin[at] = True  # texts, and the end of all
    start = begin.copy()
    if n:
        start[1:n] |= space[1:] & ~space[:-1]
        start[: n - 1] |= space[:-1] & ~space[1:] & ~begin[1:n]
        start[1:n] |= ~space[1:] & space[:-1] & (data[:-1] != 32)
    pos = np.flatnonzero(start)
    first = np.searchsorted(pos, at)
    return Lists(data, pos).binary(), first


def merge_long(v: Vocabulary, word: bytes) -> tuple[int, ...]:
    """As Vocabulary.merge, in n log n: a heap of pairs over a linked list, for words of thousands of bytes."""
    import heapq

    x = [v.byte_ids[b] for b in word]
    n = len(x)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = []

    def push(i: int) -> None:
        j = right[i]
        if j >= 0 and (rank := v.ranks.get((x[i], x[j]))) is not None:
            heapq.heappush(heap, (rank, i, x[i], x[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = right[i] if x[i] == a else -1
        if j < 0 or x[j] != b:
            continue
        x[i], x[j] = v.merged[rank], -1
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        if left[i] >= 0:
            push(left[i])
        push(i)
    return tuple(i for i in x if i >= 0)


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=1)
def _encoder(vocabulary: str, words: str) -> Encoder:
    return Encoder(_vocabulary(vocabulary), lexicon.Lexicon(words))


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(path)
        held: list[tuple[pa.Array, np.ndarray]] = []
        size = 0

        def summed(coded: pa.DictionaryArray, times: np.ndarray) -> tuple[pa.Array, np.ndarray]:
            return coded.dictionary, np.bincount(coded.indices.to_numpy(), times, len(coded.dictionary)).astype(np.int64)

        def flush() -> pa.RecordBatch:
            segments, n = summed(pa.concat_arrays([x for x, _ in held]).dictionary_encode(), np.concatenate([k for _, k in held]))
            held.clear()
            coded, of, place = v.words_of(segments.cast(pa.string()))
            times = np.zeros(len(of.at) - 1, np.int64)
            times[place] = n
            words, n = summed(coded, np.repeat(times, np.diff(of.at)))
            return pa.RecordBatch.from_arrays([words, pa.array(n)], ["word", "n"])

        for b in batches:
            for _, texts in slices(b, 0, SLICE_BYTES):
                texts, whole, _ = v.entries(texts)
                segments = cut_segments(texts, whole)[0]
                if len(segments):
                    held.append(summed(segments.dictionary_encode(), np.ones(len(segments))))
                    size += held[-1][0].nbytes
                if size > COUNTED_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def frequent_words(texts: DataFrame, vocabulary: str, most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of the one column of ``texts``; at most ``most`` come to the driver.

    A histogram of the counts' sixteenth powers of two gives the count from
    which on words are taken; no task sends more words than are taken in all.
    """
    counts = texts.mapInArrow(_count(vocabulary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stash(counts.filter("n > 1 AND length(word) <= 64").withColumn("level", F.floor(F.log2("n") * 16).cast("int")), "words")
    level, left = None, most
    for r in counts.groupBy("level").count().orderBy(F.desc("level")).collect():  # a thousand rows at most
        if r["count"] > left:
            break
        level, left = r.level, left - r["count"]
    rows = counts.filter(F.col("level") >= level).select("word").collect() if level is not None else []
    return [r.word for r in rows]


def compile_lexicon(texts: DataFrame, vocabulary: str, most: int = LEXICON_WORDS) -> str:
    """Build the transducer of the frequent words in the shared folder and hand it to all executors; the name of its file."""
    v, spark = _vocabulary(vocabulary), texts.sparkSession
    pairs = [(w.encode(), v.merge(w.encode())) for w in frequent_words(texts, vocabulary, most)]
    root = shared_path(spark, "lexicon")
    name = f"{root.rsplit('/', 1)[1]}.dawg"
    with tempfile.TemporaryDirectory() as d:
        lexicon.build(pairs, f"{d}/{name}")
        put(root, name, np.fromfile(f"{d}/{name}", np.uint8))
    spark.sparkContext.addFile(f"{root}/{name}")
    return name


def _encode(vocabulary: str, name: str, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(vocabulary, SparkFiles.get(name))
        for b in batches:
            for rows, texts in slices(b, b.num_columns - 1, SLICE_BYTES):
                ids = e.encode_all(texts)
                columns = [*rows.columns[:-1], pa.ListArray.from_arrays(pa.array(ids.at.astype(np.int32)), pa.array(ids.values, pa.int32()))]
                if decode:
                    columns.append(e.vocabulary.decode_all(ids))
                yield pa.RecordBatch.from_arrays(columns, [*rows.schema.names[:-1], "ids", *(["decoded"] if decode else [])])
                del ids, columns
                release()

    return run


def bpe_encode(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_out: str = "token_ids", decoded_out: str | None = None, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """Every row with its columns, the ids of its text and, if named, the text that they decode to.

    A null text is encoded as the empty one, which has no ids. Special tokens
    that stand in a text get their ids. ``vocabulary`` is a path that all
    executors can read. Rows stay as they are, repeated ones and ties included;
    an empty table gives no rows.
    """
    need(docs, text_col)
    name = compile_lexicon(docs.select(text_col), vocabulary, lexicon_words)
    (text,) = fresh(docs, "text")
    rows = docs.withColumn(text, F.col(text_col))
    plain = [f"c{k}" for k in range(len(docs.columns))]
    schema = docs.toDF(*plain).schema.add("ids", T.ArrayType(T.IntegerType()))
    if decoded_out:
        schema = schema.add("decoded", "string")
    out = rows.toDF(*plain, text).mapInArrow(_encode(vocabulary, name, decoded_out is not None), schema)
    return out.toDF(*docs.columns, ids_out, *([decoded_out] if decoded_out else []))


def _decode(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(vocabulary)
        for b in batches:
            x = b.column(b.num_columns - 1)
            flat = pc.fill_null(x, pa.scalar([], x.type))
            texts = v.decode_all(Lists(flat.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *pc.list_value_length(flat).to_pylist()])))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts.take(pa.array(np.arange(len(texts)), mask=x.is_null().to_numpy(zero_copy_only=False)))], [*b.schema.names[:-1], "decoded"])

    return run


def bpe_decode(rows: DataFrame, vocabulary: str, ids_col: str = "token_ids", text_out: str = "text") -> DataFrame:
    """Every row with its columns and the text of its ids; null ids give a null text."""
    need(rows, ids_col)
    plain = [f"c{k}" for k in range(len(rows.columns))]
    (ids,) = fresh(rows, "ids")
    schema = rows.toDF(*plain).schema.add("decoded", "string")
    return rows.withColumn(ids, F.col(ids_col)).toDF(*plain, ids).mapInArrow(_decode(vocabulary), schema).toDF(*rows.columns, text_out)


def bpe_report(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: n_tokens and the digests of its ids and of the text that they decode to.

    A null text is the empty one: no tokens, the digests of nothing. Repeated
    rows each give a row, null ids too; an empty table gives none. Other columns
    are not read.
    """
    need(docs, id_col, text_col)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    both = bpe_encode(d, vocabulary, "text", "ids", "decoded")
    return both.select(
        F.col("id").alias(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
