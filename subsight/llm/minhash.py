"""MinHash near-duplicates (operator 4): BagMinHash over multisets of word shingles.

A document is the multiset of its five-word shingles (a document of one to four words is one
shingle). Each shingle's weights 0, 1, 2, ... are discretised levels in a hierarchy of blocks
{0}, {1}, {2, 3}, {4..7}, ...; block b is a Poisson process whose rate is the number of its levels.
A point has a time, a register and a level; points at or above the shingle's count are thinned. A
register keeps the smallest time it sees, so two documents agree in a register with a probability
equal to their weighted Jaccard similarity. Points come in order of time and a process stops once
its time passes the largest register, so a document costs about its length plus m log m points.

Signatures are cut into bands; documents that share a band are candidates. ``BANDS`` x ``ROWS``
miss a pair at similarity 0.8 with probability (1 - 0.8^6)^42 < 3e-6. Candidates are verified by the
exact overlap of their shingle multisets; links join documents to classes:

1. each document against the best of the smallest documents of its bands (one pair a document);
2. the classes that meet in a band, by one pair for each band and class, until nothing joins;
3. all that still meet in a band in different classes, as blocks of texts that are compared at once.

So a group of near copies costs a few pairs for each member, and no link between different texts
is lost. Equal texts are one node from the start. Texts move once, and only those of candidates
are kept for the verification.

Cases: a null text is empty; texts without words link only with equal texts; a class is named by
its smallest doc_id (null if all are null); repeated rows and repeated ids are one node if their
texts are equal, else several; an empty table gives an empty result; only ``doc_id`` and ``text``
are read, and ``deduplicate`` keeps all other columns.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text, write_and_read
from .components import components

SHINGLE = 5
REGISTERS, BANDS, ROWS = 256, 42, 6
SIMILARITY = (4, 5)  # 0.8, as a fraction of whole numbers
_MEMORY = 500_000
_CHUNK = 200_000  # shingles that are hashed together
COMPARED = 256  # texts of a block


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_hashes(texts: list[bytes], memory: dict) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all texts: which text, and a hash."""
    words = [t.split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    h = np.fromiter((memory[w] for ws in words for w in ws), np.uint64, int(n.sum()))
    starts = np.concatenate(([0], np.cumsum(n)))[:-1]
    k = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(texts)), k)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k) + starts[doc]
    width = np.minimum(n, SHINGLE)[doc]
    s = width.astype(np.uint64)
    for i in range(SHINGLE):
        inside = i < width
        w = h[np.where(inside, at + i, 0)] if len(h) else np.zeros(len(at), np.uint64)
        s = np.where(inside, mix(s * np.uint64(0x9E3779B97F4A7C15) + w), s)
    return doc, s


def counted(doc: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) and how often."""
    order = np.argsort(s)
    order = order[np.argsort(doc[order].astype(np.uint16) if len(doc) and doc[-1] < 65536 else doc[order], kind="stable")]
    doc, s = doc[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], s[first], np.diff(np.append(first, len(s)))


def bag_minhash(doc: np.ndarray, s: np.ndarray, count: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """The registers of each text (n_docs x m); those of a text without shingles stay infinite."""
    registers = np.full(n_docs * m, np.inf)
    # one process for each shingle and block of levels that its count reaches
    lows = [np.zeros(len(s), np.int64)]
    picks = [np.arange(len(s))]
    low = 1
    while len(reach := np.flatnonzero(count > low)):
        picks.append(reach)
        lows.append(np.full(len(reach), low, np.int64))
        low *= 2
    pick, low = np.concatenate(picks), np.concatenate(lows)
    doc, count, size = doc[pick], count[pick], np.maximum(low, 1)
    seed = mix(s[pick] + low.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    time, done, step = np.zeros(len(seed)), 0, 1
    while len(seed):
        # so many points of each process that is still running; twice as many in the next round
        serial = np.arange(done + 1, done + step + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        r = mix(seed[:, None] + serial[None, :])
        gap = -np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / size[:, None]
        t = time[:, None] + np.cumsum(gap, axis=1)
        where = mix(r ^ np.uint64(0xA0761D6478BD642F))
        at = doc[:, None] * m + (where % np.uint64(m)).astype(np.int64)
        keep = low[:, None] + ((where >> np.uint64(32)) % size[:, None].astype(np.uint64)).astype(np.int64) < count[:, None]
        np.minimum.at(registers, at[keep], t[keep])
        time = t[:, -1]
        alive = time < registers.reshape(n_docs, m).max(axis=1)[doc]
        seed, time, doc, count, size, low = (x[alive] for x in (seed, time, doc, count, size, low))
        done, step = done + step, step * 2
    return registers.reshape(n_docs, m)


def band_keys(registers: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each text and band."""
    r = np.ascontiguousarray(registers[:, :bands * rows]).view(np.uint64).reshape(len(registers), bands, rows)
    key = mix(np.arange(1, bands + 1, dtype=np.uint64))[None, :].repeat(len(registers), 0)
    for i in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + r[:, :, i])
    return key.view(np.int64)


def _text_chunks(texts: list[bytes]):
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) // 6 + 100
        if size >= _CHUNK:
            yield texts[start:i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n (shingles) and the band keys of every document (none without words)."""
    text = whole_text()
    rows = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), text.cast("binary").alias("text"))

    def run(batches):
        memory = _Words()
        for b in batches:
            ns, offsets, keys = [], [0], []
            for texts in _text_chunks(b.column(2).to_pylist()):
                doc, s = shingle_hashes(texts, memory)
                n = np.bincount(doc, minlength=len(texts))
                k = band_keys(bag_minhash(*counted(doc, s), len(texts)))
                ns.append(n)
                keys.append(k[n > 0].ravel())
                offsets.extend(offsets[-1] + np.cumsum(np.where(n > 0, BANDS, 0)))
            lists = pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)),
                                             pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            n = pa.array(np.concatenate(ns) if ns else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, lists], ["doc_id", "digest", "n", "bands"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, digest binary, n long, bands array<long>")


def shingles(text: str | None) -> Counter:
    """The multiset of word shingles."""
    ws = (text or "").encode("utf-8", "surrogatepass").split()
    if len(ws) < SHINGLE:
        return Counter([tuple(ws)] if ws else [])
    return Counter(zip(*(ws[i:] for i in range(SHINGLE))))


def similar(a: Counter, b: Counter) -> bool:
    if not a or not b:
        return False
    if len(b) < len(a):
        a, b = b, a
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return SIMILARITY[1] * both >= SIMILARITY[0] * (a.total() + b.total() - both)


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar. Sorted by b, so a text that many pairs share is
    counted once in a row."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        last, counts = None, Counter()
        for batch in batches:
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            ok = []
            for i in range(len(a)):
                if b[i] != last:
                    last, counts = b[i], shingles(tb[i])
                ok.append(similar(shingles(ta[i]), counts))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _fits(n: str, o: str):
    """A pair can only be similar if its sizes are."""
    return F.least(n, o) * SIMILARITY[1] >= F.greatest(n, o) * SIMILARITY[0]


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, digest, node; nodes: node, digest, first_id, root, class_id). A node is
    a distinct text, first_id its smallest doc_id, class_id the smallest doc_id of its class."""
    signed = write_and_read(signatures(docs), "minhash-signed")
    nodes = signed.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = write_and_read(nodes.withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")
    rows = nodes.select(F.explode("bands").alias("key"), "node", "n")
    shared = rows.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("key").alias("k"))
    rows = write_and_read(rows.join(shared, F.col("key") == F.col("k"), "left_semi"), "minhash-rows")
    wanted = rows.select("node").distinct().join(nodes.select("node", "digest", "first_id"), "node")
    text = whole_text()
    texts = docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), F.col("doc_id").alias("d"), text.alias("text"))
    texts = texts.join(wanted, (texts["digest"] == wanted["digest"]) & F.col("d").eqNullSafe(F.col("first_id")))
    texts = write_and_read(texts.select("node", "text").dropDuplicates(["node"]), "minhash-texts")

    # 1: the leader that a document meets in most bands
    lead = rows.groupBy("key").agg(F.min(F.struct("node", "n")).alias("lead"))
    led = rows.join(lead, "key").filter("node <> lead.node").select("node", "n", "lead.node", "lead.n")
    met = led.toDF("a", "n_a", "b", "n_b").filter(_fits("n_a", "n_b")).groupBy("a", "b").agg(F.count("*").alias("met"))
    best = met.groupBy("a").agg(F.max_by("b", F.struct("met", -F.col("b"))).alias("b"))
    tested = write_and_read(best.select("a", "b"), "minhash-pairs")
    links = write_and_read(_verify(tested, texts), "minhash-links")
    roots = components(links)

    # 2: classes that meet in a band, by one pair for each band and class
    while True:
        placed = _placed(rows, roots)
        lead = placed.groupBy("key").agg(F.min(F.struct("root", "node", "n")).alias("lead"), F.max("root").alias("last"))
        lead = lead.filter("lead.root <> last").select("key", F.col("lead.root").alias("lead_root"), F.col("lead.node").alias("b"), F.col("lead.n").alias("n_b"))
        one = (placed.join(lead, "key").filter("root <> lead_root").filter(_fits("n", "n_b")).groupBy("key", "root")
               .agg(F.min(F.struct("node", "b")).alias("p")).select(F.col("p.node").alias("a"), F.col("p.b").alias("b")))
        pairs = write_and_read(_untested(one, tested), "minhash-pairs")
        found = write_and_read(_verify(pairs, texts), "minhash-links")
        tested = tested.unionByName(pairs)
        if found.isEmpty():
            break
        links = links.unionByName(found)
        roots = components(links)

    # 3: what else meets in a band, block by block
    found = write_and_read(_across(placed, texts), "minhash-links")
    if not found.isEmpty():
        roots = components(links.unionByName(found))

    named = nodes.select("node", "digest", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy(F.col("root").alias("r")).agg(F.min("first_id").alias("class_id"))
    named = named.join(names, F.col("root") == F.col("r")).drop("r")
    return signed.select("doc_id", "digest"), named


def _across(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between the classes that still meet in a band.

    In each band the largest class is the host and the nodes of the others are its guests, so any
    two nodes of different classes are host and guest, or two guests of one host. Hosts' nodes and
    guests are dealt to blocks, and pairs of blocks are compared in one step each: a node is sent
    once for each block it meets, never once for each node."""
    per = placed.groupBy("key", "root").agg(F.count("*").alias("c"))
    host = per.groupBy("key").agg(F.max(F.struct(F.col("c"), (-F.col("root")).alias("r"))).alias("h"), F.count("*").alias("n_classes"))
    host = host.filter("n_classes > 1").select("key", (-F.col("h.r")).alias("host"))
    tagged = placed.join(host, "key").select("host", "node", "root", (F.col("host") != F.col("root")).alias("guest")).distinct()
    sizes = tagged.groupBy(F.col("host").alias("of")).agg(F.ceil(F.sum(F.col("guest").cast("int")) / COMPARED).alias("ng"),
                                                          F.ceil(F.sum((~F.col("guest")).cast("int")) / COMPARED).alias("nh"))
    whole = tagged.join(sizes, F.col("host") == F.col("of")).join(texts, "node")
    block = F.pmod(F.xxhash64("node"), F.when(F.col("guest"), F.col("ng")).otherwise(F.col("nh")))
    to = lambda kind, i, j, left: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(left).alias("left"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    own = F.col("block")
    as_guest = F.concat(F.transform(upto(F.col("nh")), lambda j: to("host", own, j, True)),
                        F.transform(F.sequence(own, F.col("ng") - 1), lambda j: to("guests", own, j, True)),
                        F.transform(F.filter(upto(F.col("ng")), lambda i: i < own), lambda i: to("guests", i, own, False)))
    as_member = F.transform(upto(F.col("ng")), lambda i: to("host", i, own, False))
    sent = (whole.withColumn("block", block.cast("long"))
            .select("host", "node", "root", "text", F.explode(F.when(F.col("guest"), as_guest).otherwise(as_member)).alias("at"))
            .select("host", "at.kind", "at.i", "at.j", "at.left", "node", "root", "text"))
    pair = ["host", "kind", "i", "j"]
    dealt = sent.repartition(*pair).sortWithinPartitions(*pair, F.desc("left"), "node")

    def run(batches):
        memory, key, group = _Words(), None, []
        for b in batches:
            a, z = [], []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:4] != key:
                    for x, y in compare_blocks(group, memory):
                        a.append(x)
                        z.append(y)
                    key, group = row[:4], []
                group.append(row[4:])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])
        last = list(compare_blocks(group, memory))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in last], pa.int64()), pa.array([y for _, y in last], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def compare_blocks(group: list[tuple[bool, int, int, str]], memory: dict):
    """Similar pairs of a left and a right row (left, node, root, text), or of two left ones if there
    are no right ones: for each left row, one pair for each other class."""
    left = [r for r in group if r[0]]
    right = [r for r in group if not r[0]] or left
    if len(left) == len(right) == 1:
        (_, a, x, t), (_, b, y, u) = left[0], right[0]
        if x != y and similar(shingles(t), shingles(u)):
            yield a, b
        return
    rows = left if right is left else left + right
    doc, s, c = counted(*shingle_hashes([(t or "").encode("utf-8", "surrogatepass") for _, _, _, t in rows], memory))
    if not len(doc):
        return
    distinct, word = np.unique(s, return_inverse=True)
    total = np.bincount(doc, c, len(rows))
    first = len(rows) - len(right)  # where the right rows start
    at = np.searchsorted(doc, np.arange(len(rows) + 1))
    there, there_doc, there_c = word[at[first]:], doc[at[first]:] - first, c[at[first]:]
    roots = np.array([r[2] for r in right])
    own = np.zeros(len(distinct))
    for i, (_, a, root, text) in enumerate(left):
        z = slice(at[i], at[i + 1])
        own[word[z]] = c[z]
        both = np.bincount(there_doc, np.minimum(there_c, own[there]), len(right))
        own[word[z]] = 0
        near = (both > 0) & (SIMILARITY[1] * both >= SIMILARITY[0] * (total[i] + total[first:] - both)) & (roots != root)
        if right is left:
            near[:i + 1] = False
        hits = np.flatnonzero(near)
        for root_b in np.unique(roots[hits]):
            # the exact check of the shingles themselves
            mine = shingles(text)
            j = next((j for j in hits[roots[hits] == root_b] if similar(mine, shingles(right[j][3]))), None)
            if j is not None:
                yield a, right[j][1]


def _placed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The band rows with the class of their node."""
    return rows.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))


def _untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    return pairs.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id and kept (its class is named by it)."""
    members, nodes = classes(docs)
    named = nodes.select(F.col("digest").alias("g"), "class_id")
    return (members.join(named, F.col("digest") == F.col("g"))
            .select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull()).alias("kept")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each class, whole: the one with the smallest doc_id."""
    _, nodes = classes(docs)
    keep = nodes.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "node", "digest")).alias("k"))
    keep = keep.select(F.col("k.first_id").alias("keep_id"), F.col("k.digest").alias("keep_digest"))
    digest = F.unhex(F.sha2(whole_text(), 256))
    whole = docs.select(F.struct(*docs.columns).alias("all"), F.col("doc_id").alias("id"), digest.alias("digest"))
    kept = whole.join(keep, (F.col("digest") == F.col("keep_digest")) & F.col("id").eqNullSafe(F.col("keep_id")))
    return kept.dropDuplicates(["digest", "id"]).select("all.*")


def op4_minhash(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return near_duplicates(read(spark, sf_dir, "documents"))
