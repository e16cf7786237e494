"""Language-model scoring (operator 6): deleted interpolation of n-gram estimates.

The probability of a word after a context word mixes three estimates:

    P(w | v) = l2 * c(v w) / c(v) + l1 * c(w) / N + l0 / (V + 1)

The weights depend on how often the context was seen (buckets of powers of two) and are learned by
expectation-maximisation: one slice of the training documents is deleted from the counts, and its
tokens are predicted from the counts of the others. A text's tokens are its words (A-Z in lower
case) and one end; the end also stands before the first word, so a token is a context as often as
it is a token.

The corpus is dealt into blocks of documents. Each block sends its distinct words and word pairs
as sorted 64-bit hashes with their counts, packed by hash range; each hash range adds its counts up
and answers every block with the totals, in the block's own order. So a word of every document is
one entry per block, no table of counts is broadcast or held by the driver, and what is shuffled
follows the input. The driver sees N, V and a histogram with a fixed number of cells.

Cases: a null or empty text is one end token; a null doc_id counts as an empty one (it trains);
repeated rows count and are scored each; without training documents every estimate is the uniform
one; without a deleted slice the weights stay equal; an empty table gives an empty result; only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text, write_and_read
from .minhash import mix

FOLDS, HELD_OUT, DELETED = 7, 2, 3
BLOCK_CHARS = 8_000_000
BUCKETS = 24  # contexts by powers of two of their count
PER_DECADE = 10  # resolution of the histogram that the weights are learned from
DECADES = 12
_END = b" "  # no word holds a space


class Block:
    """The tokens of a block of texts, and its distinct keys in order: words (even), pairs (odd)."""

    def __init__(self, texts: list[bytes | None]):
        words = [(t or b"").lower().split() for t in texts]
        self.n = np.array([len(w) + 1 for w in words], np.int64)
        ids: dict[bytes, int] = {_END: 0}
        token = np.fromiter((ids.setdefault(w, len(ids)) for ws in words for w in (*ws, _END)), np.int32, int(self.n.sum()))
        del words
        h = np.fromiter((xxhash.xxh64_intdigest(w) for w in ids), np.uint64, len(ids)) & ~np.uint64(1)
        before = np.zeros_like(token)  # the end, before a text's first word
        before[1:] = token[:-1]
        pair = mix(h[before] * np.uint64(0x9E3779B97F4A7C15) + h[token]) | np.uint64(1)
        self.doc = np.repeat(np.arange(len(texts)), self.n)
        single, back = np.unique(h, return_inverse=True)
        pairs, self.pair = np.unique(pair, return_inverse=True)
        self.keys = np.concatenate((single, pairs))
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.word = place[back][token]
        self.before = place[back][before]
        self.pair = place[len(single) + self.pair]

    def counts(self, chosen: np.ndarray) -> np.ndarray:
        """How often each key is in the chosen texts."""
        use = chosen[self.doc]
        n = np.bincount(self.word[use], minlength=len(self.keys))
        return n + np.bincount(self.pair[use], minlength=len(self.keys))


def _range_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return keys >> np.uint64(64 - bits)


def pack(keys: np.ndarray) -> bytes:
    """Ascending keys: the first, then the gaps, in six bytes each where that is enough."""
    gaps = np.diff(keys)
    if len(gaps) and int(gaps.max()) >> 48:
        return b"\x08" + keys.astype("<u8").tobytes()
    return b"\x06" + keys[:1].astype("<u8").tobytes() + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"\x08":
        return np.frombuffer(data, "<u8", offset=1)
    gaps = np.zeros(((len(data) - 9) // 6, 8), np.uint8)
    gaps[:, :6] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, 6)
    return np.cumsum(np.concatenate((np.frombuffer(data, "<u8", 1, 1), gaps.view("<u8").ravel())), dtype=np.uint64)


def pack_counts(n: np.ndarray) -> bytes:
    """Unsigned integers in the fewest bytes that hold them all."""
    top = int(n.max()) if len(n) else 0
    size = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([size]) + n.astype(f"<u{size}").tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """The documents with their block; the deleted slice has blocks of its own (the odd ones)."""
    text = whole_text()
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    size = docs.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n")).first()["n"]
    n = max(1, math.ceil(size / BLOCK_CHARS))
    place = F.xxhash64("doc_id", text)
    block = F.when(fold == DELETED, F.pmod(place, F.lit(max(1, n // FOLDS))) * 2 + 1).otherwise(F.pmod(place, F.lit(n)) * 2)
    return docs.select("doc_id", text.cast("binary").alias("text"), (fold == HELD_OUT).alias("held_out"), block.alias("block")), n


def _totals(rows: DataFrame, n_blocks: int) -> DataFrame:
    """(block, part, totals, deleted): for the block's keys of one hash range, in order, how often
    they are in all training texts and in the deleted slice; block -1 carries N, V and the deleted N."""
    bits = max(3, (n_blocks - 1).bit_length())

    def send(table: pa.Table) -> pa.Table:
        b = Block(table["text"].to_pylist())
        n = b.counts(~np.array(table["held_out"].to_pylist(), bool))
        block = table["block"][0].as_py()
        part = _range_of(b.keys, bits)
        cuts = np.flatnonzero(np.diff(part, prepend=part[:1] - np.uint64(1)))
        ends = np.append(cuts[1:], len(part))
        return pa.table({"block": pa.array([block] * len(cuts), pa.int64()), "part": pa.array(part[cuts].astype(np.int64)),
                         "keys": pa.array([pack(b.keys[x:y]) for x, y in zip(cuts, ends)], pa.binary()),
                         "counts": pa.array([pack_counts(n[x:y]) for x, y in zip(cuts, ends)], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        blocks = table["block"].to_pylist()
        keys = [unpack(k) for k in table["keys"].to_pylist()]
        counts = np.concatenate([unpack_counts(c) for c in table["counts"].to_pylist()])
        lengths = np.array([len(k) for k in keys])
        distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
        gone = np.repeat(np.array(blocks) % 2 == 1, lengths)
        total = np.bincount(back, counts, len(distinct)).astype(np.int64)
        deleted = np.bincount(back[gone], counts[gone], len(distinct)).astype(np.int64)
        single = distinct % np.uint64(2) == 0
        ends = np.cumsum(lengths)
        t = [pack_counts(total[back[y - n:y]]) for n, y in zip(lengths, ends)]
        d = [pack_counts(deleted[back[y - n:y]]) if k % 2 else b"" for k, n, y in zip(blocks, lengths, ends)]
        own = np.array([total[single].sum(), (total[single] > 0).sum(), deleted[single].sum()], "<i8").tobytes()
        part = table["part"][0].as_py()
        return pa.table({"block": pa.array([*blocks, -1], pa.int64()), "part": pa.array([part] * (len(blocks) + 1), pa.int64()),
                         "totals": pa.array([*t, own], pa.binary()), "deleted": pa.array([*d, b""], pa.binary())})

    sent = rows.groupBy("block").applyInArrow(send, "block long, part long, keys binary, counts binary")
    return sent.groupBy("part").applyInArrow(add, "block long, part long, totals binary, deleted binary")


def _answer(table: pa.Table, column: str) -> np.ndarray:
    table = table.sort_by("part")
    parts = [unpack_counts(x) for x in table[column].to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def bucket(n: np.ndarray) -> np.ndarray:
    """0 for a context that was not seen, else its power of two."""
    return np.minimum(np.where(n > 0, np.frexp(n.astype(np.float64))[1], 0), BUCKETS - 1)


def estimates(pair, before, word, total: int):
    p2 = np.divide(pair, before, out=np.zeros(len(pair)), where=before > 0)
    return p2, word / max(total, 1)


def _bin(p: np.ndarray) -> np.ndarray:
    """0 for zero, else 1 + the tenths of a decade below one."""
    with np.errstate(divide="ignore"):
        k = np.floor(-np.log10(p) * PER_DECADE)
    return np.where(p > 0, 1 + np.clip(k, 0, PER_DECADE * DECADES - 1), 0).astype(np.int64)


def _value(k: np.ndarray) -> np.ndarray:
    return np.where(k > 0, 10.0 ** (-(k - 0.5) / PER_DECADE), 0.0)


def learn(cells: list[tuple[int, int, int, int]], uniform: float, rounds: int = 50) -> np.ndarray:
    """Weights l0, l1, l2 of each bucket by expectation-maximisation over (bucket, pair bin, word
    bin, n). A bucket without deleted tokens gets the weights of all together."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    c = np.array(cells, np.int64).reshape(-1, 4)
    p = np.stack([np.full(len(c), uniform), _value(c[:, 2]), _value(c[:, 1])], axis=1)
    n = c[:, 3].astype(np.float64)

    def fit(use: np.ndarray) -> np.ndarray:
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = w * p[use]
            share /= share.sum(axis=1, keepdims=True)
            w = n[use] @ share / n[use].sum()
        return w

    if len(c):
        weights[:] = fit(np.ones(len(c), bool))
        for b in np.unique(c[:, 0]):
            weights[b] = fit(c[:, 0] == b)
    # a context that was not seen has no pair estimate
    weights[0] = np.array([weights[0, 0], weights[0, 1], 0]) / max(weights[0, :2].sum(), 1e-300)
    return np.maximum(weights, [1e-9, 0, 0])


def score(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows, n_blocks = _blocks(docs)
    totals = write_and_read(_totals(rows, n_blocks), "lm-totals")
    own = totals.filter("block = -1").select("totals")
    # one row of three sums for each hash range, added up before the driver sees them
    sums = own.mapInArrow(_add_up, "n long, v long, d long").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("d").alias("d")).first()
    n_train, n_words, n_deleted = (int(x or 0) for x in sums)
    uniform = 1 / (n_words + 1)

    def cells(left: pa.Table, right: pa.Table) -> pa.Table:
        out = np.zeros((0, 2), np.int64)
        if left.num_rows:
            b = Block(left["text"].to_pylist())
            rest = _answer(right, "totals") - _answer(right, "deleted")
            p2, p1 = estimates(rest[b.pair], rest[b.before], rest[b.word], n_train - n_deleted)
            size = PER_DECADE * DECADES + 1
            cell = (bucket(rest[b.before]) * size + _bin(p2)) * size + _bin(p1)
            out = np.stack(np.unique(cell, return_counts=True), axis=1)
        return pa.table({"cell": pa.array(out[:, 0], pa.int64()), "n": pa.array(out[:, 1], pa.int64())})

    odd = (rows.filter("block % 2 = 1").groupBy("block").cogroup(totals.filter("block % 2 = 1").groupBy("block"))
           .applyInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")))
    size = PER_DECADE * DECADES + 1  # at most BUCKETS * size * size cells, however large the corpus
    weights = learn([(r["cell"] // size // size, r["cell"] // size % size, r["cell"] % size, r["n"]) for r in odd.collect()], uniform)

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"doc_id": pa.array([], left.schema.field("doc_id").type), "held_out": pa.array([], pa.bool_()),
                             **{c: pa.array([], pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")},
                             **{c: pa.array([], pa.float64()) for c in ("base_score", "score")}})
        b = Block(left["text"].to_pylist())
        t = _answer(right, "totals")
        c = t[b.word]
        base = np.log10((c + 1) / (n_train + n_words + 1))
        p2, p1 = estimates(t[b.pair], t[b.before], c, n_train)
        w = weights[bucket(t[b.before])]
        p = w[:, 0] * uniform + w[:, 1] * p1 + w[:, 2] * p2
        starts = np.cumsum(b.n) - b.n
        return pa.table({"doc_id": left["doc_id"], "held_out": left["held_out"], "n_tokens": pa.array(b.n),
                         "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)),
                         "train_tokens": pa.array(np.full(len(b.n), n_train, np.int64)),
                         "base_score": pa.array(np.add.reduceat(base, starts)), "score": pa.array(np.add.reduceat(np.log10(p), starts))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (rows.groupBy("block").cogroup(totals.filter("block >= 0").groupBy("block"))
            .applyInArrow(rate, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))


def _add_up(batches):
    for b in batches:
        x = np.array([np.frombuffer(v, "<i8") for v in b.column(0).to_pylist()]).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([pa.array([int(v)], pa.int64()) for v in x.sum(axis=0)], ["n", "v", "d"])


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return score(read(spark, sf_dir, "documents"))
