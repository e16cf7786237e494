"""Substring dedup (operator 13): Rabin-Karp hashes of word windows, counted in Spark.

A window is ``window`` consecutive words of one document. A word goes if a window that covers it also
starts in a document with a smaller doc_id. All hashes are Rabin-Karp polynomials modulo 2^64, taken
as differences of prefix sums: over a word's bytes, over a window's words, and over the ``PART`` words
of the shorter runs inside a window, the smallest of which is the window's *mark*. Equal windows have
equal marks, and neighbouring windows mostly share theirs, so there is about one mark for 14 windows.

1. A pass over the texts gives each document's marks and the digest of all its words. Spark counts
   the documents of each mark. A window whose mark is in one document alone repeats in no other, so
   only windows with a mark of several documents go on: all of them, nothing is sampled.
2. The texts that hold such marks are written once. Of their windows Spark counts, for each hash
   (96 bits: the window's and half of its mark's), the documents and finds the smallest doc_id.
   Counts are combined on the map side, so a window of a third of all documents is one row per task.
3. Windows that start earlier elsewhere return to their documents, where overlapping ones merge into
   maximal removal intervals.

Going back from a count to the documents is a join whose key may be hot (``_with_facts``): keys with
a thousandth of all rows or more are a thousand at most and are broadcast, the others are shuffled.

Cases: a null or empty text has no words; ASCII white space separates words, all else belongs to
them. A document shorter than a window keeps all its words. A window that repeats inside one
document only stays; rows of one doc_id are judged alike and none is earlier than the other. A null
doc_id is neither smaller nor larger than another: its words stay and remove none. Texts are read in
pieces of ``PIECE`` bytes, cut at white space, so a very long one costs memory by its words. An empty
table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import whole_text

WINDOW, PART = 50, 25
PIECE = 1 << 20  # bytes hashed together
HOT = 1000  # a key with this part of all rows is hot
_BYTE, _WORD = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03  # odd, so they have inverses modulo 2^64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; those that a piece needs are kept."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, PIECE + 1), base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        _POWERS[base] = known[:PIECE + 1].copy()
    return known[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rabin-Karp hashes of values[start:end]: a run's hash does not depend on where it starts."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(pow(base, -1, 1 << 64), len(values)), out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * _powers(base, len(values) + 1)[starts])


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of some text, and where they start in it."""
    hashes, places, at = [], [], 0
    view = np.frombuffer(data, np.uint8)
    while at < len(data):
        end = min(at + PIECE, len(data))
        if end < len(data):  # cut behind white space, also if that is further on
            blank = np.flatnonzero(_SPACE[view[at:end]])
            while not len(blank) and end < len(data):
                blank = np.flatnonzero(_SPACE[view[end:end + PIECE]]) + (end - at)
                end = min(end + PIECE, len(data))
            end = at + int(blank[-1]) + 1 if len(blank) else len(data)
        piece = view[at:end]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[piece], [True]))))
        starts, ends = edge[::2], edge[1::2]
        hashes.append(_runs(piece.astype(np.uint64) + np.uint64(1), _BYTE, starts, ends))
        places.append(starts + at)
        at = end
    return np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate(places or [np.zeros(0, np.int64)])


def windows(texts: list[bytes], window: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of some texts: the text's place, the window's first word in it, its hash and its mark."""
    words, places = word_hashes(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    text = np.searchsorted(ends, places, side="right")
    first = np.searchsorted(text, np.arange(len(texts)))  # a text's first word
    n = len(words) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    starts = np.arange(len(words) - part + 1)
    low, size = _runs(words, _WORD, starts, starts + part), 1
    while 2 * size <= window - part + 1:  # the smallest of 2, 4, 8 ... neighbours
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = window - part + 1 - size
    marks = np.minimum(low[:n], low[rest:rest + n])
    whole = np.flatnonzero(text[:n] == text[window - 1:])
    hashes = _runs(words, _WORD, whole, whole + window)
    return text[whole], whole - first[text[whole]], hashes, marks[whole]


def _slices(batches, size: int = PIECE):
    """Batches cut into rows with about ``size`` bytes of text (column 1), one at least."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False))
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, side="right")))
            yield b.slice(a, z - a)
            a = z


def _texts(b: pa.RecordBatch) -> list[bytes]:
    return b.column(1).cast(pa.binary()).to_pylist()


def _digest(words) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """One list for each of n owners (ascending) of the values."""
    return pa.ListArray.from_arrays(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32), pa.array(values.view(np.int64)))


def _marked(window: int, part: int):
    """Of each document: number of words, digest of all words, and its windows' marks."""

    def run(batches):
        for b in _slices(batches):
            texts = _texts(b)
            split = [t.split() for t in texts]
            text, _, _, marks = windows(texts, window, part)
            new = np.ones(len(marks), bool)
            new[1:] = (marks[1:] != marks[:-1]) | (text[1:] != text[:-1])
            text, marks = text[new], marks[new]
            order = np.lexsort((marks, text))
            text, marks = text[order], marks[order]
            new = np.ones(len(marks), bool)
            new[1:] = (marks[1:] != marks[:-1]) | (text[1:] != text[:-1])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(w) for w in split], pa.int64()), pa.array([_digest(w) for w in split]),
                 _lists(text[new], marks[new], len(texts))], ["doc_id", "n_words", "all_sha256", "marks"])

    return run


def _repeatable(window: int, part: int, later: bool):
    """Of each document: its windows with a shared mark, each once. With ``later`` only those whose
    mark starts in a smaller doc_id: no other one can be removed."""

    def run(batches):
        for b in _slices(batches):
            texts = _texts(b)
            text, _, hashes, marks = windows(texts, window, part)
            wanted = b.column("later" if later else "marks")
            # (text, mark) pairs as places in the sorted marks of all texts
            owner = np.repeat(np.arange(b.num_rows), pc.list_value_length(wanted).to_numpy(zero_copy_only=False))
            known = wanted.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            names = np.unique(known)
            place = np.searchsorted(names, marks)
            there = place < len(names)
            there[there] = names[place[there]] == marks[there]
            pairs = owner * len(names) + np.searchsorted(names, known)
            there[there] = np.isin(text[there] * len(names) + place[there], pairs)
            text, hashes, check = text[there], hashes[there], (marks[there] & np.uint64(0x7FFFFFFF)).astype(np.int32)
            order = np.lexsort((check, hashes, text))
            text, hashes, check = text[order], hashes[order], check[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1]) | (check[1:] != check[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(hashes[new].view(np.int64)), pa.array(check[new]), b.column(0).take(pa.array(text[new]))], ["hash", "check", "doc_id"])

    return run


def _cut(window: int, part: int):
    """Removal intervals of each document and the digest of the words it keeps."""

    def run(batches):
        for b in _slices(batches):
            texts = _texts(b)
            text, start, hashes, marks = windows(texts, window, part)
            gone_text = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("gone")).to_numpy(zero_copy_only=False))
            gone = b.column("gone").flatten()
            key = np.dtype([("text", np.int64), ("hash", np.uint64), ("check", np.int32)])
            wanted, have = np.zeros(len(gone_text), key), np.zeros(len(text), key)
            wanted["text"], have["text"] = gone_text, text
            wanted["hash"], have["hash"] = gone.field("hash").to_numpy(zero_copy_only=False).view(np.uint64), hashes
            wanted["check"], have["check"] = gone.field("check").to_numpy(zero_copy_only=False), (marks & np.uint64(0x7FFFFFFF)).astype(np.int32)
            # equal rows of both sides get one number
            _, number = np.unique(np.concatenate((wanted, have)), return_inverse=True)
            hit = np.isin(number[len(wanted):], number[:len(wanted)])
            text, start = text[hit], start[hit]
            # windows that touch or overlap merge: an interval starts where the one before has ended
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (start[1:] > start[:-1] + window)
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(text)) - 1
            spans = [[] for _ in texts]
            for t, a, z in zip(text[begin].tolist(), start[begin].tolist(), (start[end] + window).tolist()) if len(text) else ():
                spans[t].append({"start": a, "end": z})
            removed, digests, all_digests = [], [], []
            for t, own in zip(texts, spans):
                words = t.split()
                all_digests.append(_digest(words))
                keep = np.ones(len(words), bool)
                for s in own:
                    keep[s["start"]:s["end"]] = False
                removed.append(len(words) - int(keep.sum()))
                digests.append(_digest(compress(words, keep)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int64()), pa.array(digests), pa.array(spans, _SPANS),
                                              pa.array(all_digests)], ["doc_id", "n_removed", "kept_sha256", "spans", "all_sha256"])

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _stored(df: DataFrame, name: str) -> DataFrame:
    """Written with the denser codec: these tables hold texts and hashes."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _with_facts(rows: DataFrame, facts: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Rows joined with the facts of their keys (one row per key; ``n`` rows have it). Hot keys are
    at most HOT, so they are broadcast and their rows stay where they are."""
    hot = facts.filter(F.col("n") * HOT >= total).drop("n")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(facts.filter(F.col("n") * HOT < total).drop("n"), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def removals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (removal intervals, in words) of every row."""
    part = max(1, window // 2)
    texts = docs.select("doc_id", whole_text().alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    # 1. marks of several documents
    marked = _stored(texts.mapInArrow(_marked(window, part), f"doc_id {id_type}, n_words long, all_sha256 string, marks array<long>"), "passages-marks")
    known = marked.filter(F.col("doc_id").isNotNull())
    marks = known.select(F.explode("marks").alias("mark"), "doc_id")
    counted = marks.groupBy("mark").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    shared = _stored(counted.filter("first < last").select("mark", "first", "n"), "passages-shared")
    total = known.agg(F.sum(F.size("marks"))).first()[0] or 0
    of_docs = _with_facts(marks, shared, ["mark"], total).groupBy("doc_id").agg(
        F.collect_set("mark").alias("marks"), F.collect_set(F.when(F.col("first") < F.col("doc_id"), F.col("mark"))).alias("later"))
    # 2. windows with such marks
    chosen = _stored(texts.join(of_docs, "doc_id"), "passages-texts")
    window_cols = f"hash long, check int, doc_id {id_type}"
    every = chosen.mapInArrow(_repeatable(window, part, False), window_cols)
    firsts = every.groupBy("hash", "check").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    firsts = _stored(firsts.filter("first < last").select("hash", "check", "first", "n"), "passages-windows")
    n_windows = firsts.agg(F.sum("n")).first()[0] or 0
    later = chosen.filter(F.size("later") > 0)
    repeated = _with_facts(later.mapInArrow(_repeatable(window, part, True), window_cols), firsts, ["hash", "check"], n_windows)
    gone = repeated.filter(F.col("doc_id") > F.col("first")).groupBy("doc_id").agg(F.collect_set(F.struct("hash", "check")).alias("gone"))
    # 3. intervals; rows of one doc_id are told apart by their words
    cut = later.select("doc_id", "text").join(gone, "doc_id").mapInArrow(_cut(window, part), f"doc_id {id_type}, n_removed long, kept_sha256 string, spans array<struct<start: long, end: long>>, all_sha256 string")
    cut = cut.dropDuplicates(["doc_id", "all_sha256"])
    out = marked.select("doc_id", "n_words", "all_sha256").join(cut, ["doc_id", "all_sha256"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
                      F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256"), F.coalesce("spans", F.array().cast("array<struct<start: long, end: long>>")).alias("spans"))


def op13_substring_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return removals(read(spark, sf_dir, "documents")).drop("spans")


ORACLE_SQL = r"""
WITH texts AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM texts)),
firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
gone AS (
  SELECT DISTINCT doc_id, i + j AS place
  FROM windows JOIN firsts USING (w), range(50) AS t(j) WHERE first < doc_id),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS words
  FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM texts) ANTI JOIN gone USING (doc_id, place)
  GROUP BY doc_id)
SELECT doc_id, CAST(len(t.words) AS BIGINT) AS n_words, CAST(len(t.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.words, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (doc_id)
"""
