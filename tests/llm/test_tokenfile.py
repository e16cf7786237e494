"""Token files: exact round trips, the tokenizers library's own ids, damaged blocks, odd rows."""

import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from subsight.llm import tokenfile as T
from subsight.session import scratch_path

from ..conftest import SF001

PATH = T.default_tokenizer()


def expected(rows):
    """(doc_id, start, n_tokens, crc) by whole texts, in ascending doc_id order."""
    library = Tokenizer.from_file(PATH)
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("n", [0, 1, 2, T.STEPS - 1, T.STEPS, T.STEPS + 1, 3 * T.STEPS + 77, T.BLOCK - 1, T.BLOCK + 1, 2 * T.BLOCK + 77])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 65536, n), np.zeros(n, int), rng.geometric(0.01, n) % 65536, np.arange(n) % 9, np.full(n, 65535)):
        blocks = T.encode_blocks(ids.astype(np.uint32))
        assert (T.decode_blocks(blocks, n) == ids).all()
        # blocks do not depend on each other
        if len(blocks) > 1:
            assert T.encode_blocks(ids[T.BLOCK:2 * T.BLOCK].astype(np.uint32))[0] == blocks[1]


def test_model_learns_and_ids_are_bounded():
    rng = np.random.default_rng(5)
    text = np.tile(rng.integers(0, 50000, 200), 40).astype(np.uint32)
    assert sum(map(len, T.encode_blocks(text))) < len(text) / 4
    with pytest.raises(ValueError):
        T.encode_blocks(np.array([65536], np.uint32))


def test_words_give_the_ids_of_whole_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aeT 's't\n\t\x0b\x1c  Éé́<|endoftext|>1²你.,!") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a <|startoftext|> b", "<|endoftext|>x", "don't  we'll", "́ ́a", "ΑΣ ΣΑΣ", "İ I"]
    library = Tokenizer.from_file(PATH)
    words, want = T._Words(PATH), [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert words.splits
    for _ in range(2):  # with words learned word by word, then from memory; then as whole texts
        for split in (True, False):
            words.splits = split
            ids, lengths = words.encode(pa.array([t.encode() for t in texts], pa.binary()))
            for t, w, g in zip(texts, want, np.split(ids, np.cumsum(lengths)[:-1])):
                assert g.tolist() == w, repr(t)


def test_a_word_is_looked_up_once():
    """Once per slice and distinct word, new or known; words of letters and marks look their two parts up when they are new."""
    words, seen = T._Words(PATH), []

    class Counting(type(words.number)):
        def __getitem__(self, w):
            seen.append(w)
            return super().__getitem__(w)

        def __contains__(self, w):
            seen.append(w)
            return super().__contains__(w)

    words.number, library = Counting(), Tokenizer.from_file(PATH)
    texts = ["one two one three.", "two three. 4 one", "one", "İx \u0301a three!? two."]
    for lookups in (10 + 2 * 3, 10):  # 10 words, 3 with marks
        ids, _ = words.encode(pa.array([" ".join(texts).encode(), b"new2 new2 new2", b"new2 \xe4\xbd\xa0"], pa.binary()))
        assert len(seen) == lookups
        seen.clear()
    assert ids.tolist() == library.encode(" ".join(texts) + " new2 new2 new2 new2 你", add_special_tokens=False).ids


def test_plain_words_take_the_short_way():
    """Latin-1 letters go without normal form and stretches, all others by the whole tokenizer; the ids are those of whole texts."""
    words, library = T._Words(PATH), Tokenizer.from_file(PATH)
    plain = ["Wort", "ßEÄ", "ÀÉÎÕÜÿ", "µm", "ª", "ÞÆØ", "straße", "DON", "ll", "x" * 400]
    others = ["ǰ", "J\u030c", "Éa\u0301", "ſs", "İI", "ΑΣ", "你好", "Ǆ", "ﬁ", "Ÿ"]
    sent = []

    class Counting:
        def encode_batch_fast(self, texts, **kw):
            sent.extend(w for t in texts for w in t.split())
            return library.encode_batch_fast(texts, **kw)

    words.tokenizer = Counting()
    for some in (plain, others, plain + others):
        ids, _ = words.encode(pa.array([" ".join(some).encode()], pa.binary()))
        assert ids.tolist() == library.encode(" ".join(some), add_special_tokens=False).ids
    assert set(others) <= set(sent) and not set(plain) & set(sent)


def test_only_known_steps_are_left_out(tmp_path):
    from tokenizers import AddedToken, normalizers

    for change in (lambda t: setattr(t, "normalizer", normalizers.Lowercase()), lambda t: t.add_tokens([AddedToken("wort", normalized=False)]),
                   lambda t: setattr(t, "pre_tokenizer", pre_tokenizers.ByteLevel())):
        library = Tokenizer.from_file(PATH)
        change(library)
        library.save(path := str(tmp_path / "changed.json"))
        assert T._Words(path).short is None
    assert T._Words(PATH).short is not None


def test_words_of_several_slices_are_kept_when_others_are_forgotten(monkeypatch):
    monkeypatch.setattr(T, "_MEMORY", 12)
    words, library = T._Words(PATH), Tokenizer.from_file(PATH)
    common, sent, learn = ["often", "again", "Oft?"], [], words._learn

    def counted():
        sent.append(len(words.number) - words.number.known)
        learn()

    monkeypatch.setattr(words, "_learn", counted)
    for k in range(9):
        text = " ".join(common + [f"rare{'abcdefghi'[k]}{x}" for x in "uvwxyz"])
        ids, _ = words.encode(pa.array([text.encode()], pa.binary()))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(words.number) <= 12 + 9 + 2
    # (before: all words were learned again after they were forgotten)
    assert sent == [9] + [6] * 8
    # too many to keep: none is
    monkeypatch.setattr(T, "_MEMORY", 4)
    words.encode(pa.array([b"one two"], pa.binary()))
    assert len(words.number) == 2


def test_a_carry_reaches_words_that_left_before():
    coder = T._Writer(1, 4)
    coder.words[:3], coder.at[:], coder.low[:] = (7, 0xFFFFFFFF, 0xFFFFFFFF), 3, 2**64 - 1
    coder.narrow(np.array([4], np.uint64), np.array([2**40], np.uint64))
    assert coder.words[:3].tolist() == [8, 0, 0]


def test_all_words_of_a_block_are_read_in_order(monkeypatch):
    """A lane's words have no place of their own in a block (before: 2 bytes a lane for their number, two passes at least to settle)."""
    read = []

    class Reader(T._Reader):
        def __init__(self, *args):
            super().__init__(*args)
            read.append(self)

    monkeypatch.setattr(T, "_Reader", Reader)
    rng = np.random.default_rng(1)
    ids = np.concatenate((rng.integers(0, 65536, 5 * T.STEPS), rng.geometric(0.01, 9 * T.STEPS + 77) % 65536)).astype(np.uint32)
    (block,) = T.encode_blocks(ids)
    assert (T.decode_blocks([block], len(ids)) == ids).all()
    assert [r.next for r in read] == [len(block) // 4]
    with pytest.raises(ValueError):
        T.decode_blocks([block[:-40]], len(ids))


def test_a_tokenizer_that_keeps_white_space_gets_whole_texts(tmp_path):
    # (a tokenizer of bytes with a space as a token of its own; nothing is trained)
    alphabet = {c: i for i, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))}
    library = Tokenizer(models.BPE(vocab=alphabet, merges=[]))
    library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    path = str(tmp_path / "bytes.json")
    library.save(path)
    words = T._Words(path)
    assert not words.splits
    texts = ["a b", " two  spaces\n", "", "é"]
    ids, lengths = words.encode(pa.array([t.encode() for t in texts] + [None], pa.binary()))
    assert [g.tolist() for g in np.split(ids, np.cumsum(lengths)[:-1])] == [library.encode(t).ids for t in texts] + [[]]


def test_slices_hold_every_row():
    texts = pa.array([b"x" * n for n in (0, 5, 3 * T._SLICE, 0, 7, T._SLICE, 1)] + [None], pa.binary())
    parts = list(T._slices(texts))
    assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) == len(texts)
    assert list(T._slices(pa.array([], pa.binary()))) == []


def test_ids_take_fewer_bits_than_their_order_0_entropy():
    rows = duckdb.sql(f"SELECT text FROM '{SF001}/documents.parquet' ORDER BY doc_id").fetchall()
    ids, _ = T._Words(PATH).encode(pa.array([(t or "").encode() for t, in rows], pa.binary()))
    share = np.bincount(ids) / len(ids)
    share = share[share > 0]
    bits = 8 * sum(map(len, T.encode_blocks(ids))) / len(ids)
    assert bits < -(share * np.log2(share)).sum()


def test_odd_rows(spark, monkeypatch):
    rows = [(3, None), (1, ""), (2, "one two"), (7, "x " * 30000), (5, "\n"), (5, "same"), (None, "null id"), (9, "y"), (9, "y")]
    docs = spark.createDataFrame([(*r, 0, "s") for r in rows], "doc_id long, text string, start int, part string")
    folder = scratch_path(spark, "test-tokens")
    T.write(docs, folder, PATH)
    got = T.digests(spark, folder).collect()
    assert [r[2:] for r in sorted(got, key=lambda r: r["start"])] != []
    by_start = sorted(map(tuple, got), key=lambda r: r[1])
    want = expected(rows)
    assert [r[0] for r in by_start] == [r[0] for r in want]
    # rows of one doc_id may come in either order; all others are fixed
    assert sorted(r[2:] for r in by_start) == sorted(r[2:] for r in want)
    assert [b[1] for b in by_start] == [0, *np.cumsum([b[2] for b in by_start])[:-1]]
    # the ids themselves are those of the digests
    for r in T.read_back(spark, folder).collect():
        assert (r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) in by_start
    empty = scratch_path(spark, "test-tokens")
    T.write(docs.limit(0), empty, PATH)
    assert T.digests(spark, empty).collect() == []


def test_damage_is_found(spark):
    docs = spark.createDataFrame([(1, "some words to code " * 50)], "doc_id long, text string")
    folder, bad = scratch_path(spark, "test-tokens"), scratch_path(spark, "test-tokens")
    T.write(docs, folder, PATH)
    files = spark.read.parquet(folder)
    files.withColumn("checks", F.transform("checks", lambda c: c + 1)).write.parquet(bad)
    with pytest.raises(Exception, match="wrong checksum"):
        T.read_back(spark, bad).collect()


def test_segments(spark, monkeypatch):
    monkeypatch.setattr(T, "SEGMENT", 5000)
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF001}/documents.parquet'").fetchall()
    assert sorted(map(tuple, T.op1_token_output(spark, SF001).collect())) == expected(rows)


def test_query(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF001}/documents.parquet'").fetchall()
    assert sorted(map(tuple, T.op1_token_output(spark, SF001).collect())) == expected(rows)
