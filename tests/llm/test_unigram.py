"""Pieces against the tokenizers library's unigram model, exact round trips, odd rows."""

import random
import zlib

import duckdb
import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer, decoders, models

from subsight.llm import unigram as U

from ..conftest import SF001

PATH = U.default_model()


@pytest.fixture(scope="module")
def library():
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    vocab = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]
    t = Tokenizer(models.Unigram(vocab, sp.unk_id(), byte_fallback=True))
    t.decoder = decoders.ByteFallback()
    return t


def expected(library, text):
    return library.encode(U.SPACE + text.replace(" ", U.SPACE), add_special_tokens=False).ids if text else []


ODD = ["", " ", "  ", "a", "\n", "\n\n a", "a  b   c    d", "x" * 5000, "你好 世界 \U0001F600\U0001F601", "tab\tand space", "a▁b",
       " lead", "trail ", "\x00\x01", "é", "<s> </s> <unk> <0x41>", "ab" * 3000 + "\n" + "ba" * 3000]


def test_matches_library(library):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("aeiou tnrs \nÄé你.,") for _ in range(rng.randint(1, 200))) for _ in range(200)]
    texts += [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF001}/documents.parquet'").fetchall()]
    p = U.Pieces(PATH)
    for text in texts:
        want = [i for i in expected(library, text) if True]
        got = np.frombuffer(p.encode(text), "<u4").tolist()
        assert got == want, text[:80]
        assert p.count(text) == len(want)
        assert p.decode(got) == text.replace(U.SPACE, " ")


def test_cut_equals_whole_text():
    p = U.Pieces(PATH)
    for text in ODD + ["The quick  brown fox.\nJumps over"]:
        if text:
            whole = U.SPACE + text.replace(" ", U.SPACE)
            assert p.encode(text) == p.encode_stretch(whole)


def test_ties_take_the_longest_last_piece():
    p = U.Pieces(PATH)
    p.automaton.clear()
    for i, (piece, score) in enumerate([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0)]):
        p.automaton.add_word(piece, (len(piece), score, i))
    p.automaton.make_automaton()
    p.singles = {"a", "b"}
    # every cut of "aba" scores -3; the last piece is the longest of equals: a, then ba
    assert np.frombuffer(p.encode_stretch("aba"), "<u4").tolist() == [0, 3]


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Ab c", None), (3, "Ab c", None), (None, "Ab c", "y"), (4, "long " * 30000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    p = U.load(PATH)
    got = sorted(map(tuple, U.token_counts(docs, PATH).collect()), key=str)
    assert got == sorted([(r[0], p.count(r[1])) for r in rows], key=str)
    coded = U.coded_digest(docs, PATH).collect()
    assert all(r["round_trip"] for r in coded)
    assert sorted(r["ids_crc32"] for r in coded) == sorted(zlib.crc32(p.encode(r[1])) for r in rows)
    back = U.decode(U.encode(docs, PATH), PATH)
    assert sorted(r["decoded"] for r in back.collect()) == sorted(r[1] or "" for r in rows)
    with pytest.raises(ValueError):
        U.encode(docs.withColumnRenamed("n_tokens", "piece_ids"), PATH)
    assert U.token_counts(docs.limit(0), PATH).collect() == []
    assert U.coded_digest(docs.limit(0), PATH).collect() == []


def test_queries_cover_the_table(spark):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SF001}/documents.parquet'").fetchall()
    p = U.load(PATH)
    assert sorted(map(tuple, U.op2_token_counts(spark, SF001).collect())) == sorted((i, p.count(t)) for i, t in texts)
    assert sorted((r[0], r[2], r[4]) for r in U.op9_sentencepiece(spark, SF001).collect()) == sorted(
        (i, zlib.crc32(p.encode(t)), True) for i, t in texts)
