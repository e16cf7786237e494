"""Deleted interpolation against a plain version, and whether it predicts held-out texts."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from subsight.llm import lm as L

from ..conftest import SF001


def tokens(text):
    return [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [" "]


def plain(rows):
    """(doc_id, held_out, n_tokens, n_known, N, base, score) with exact weights from unbinned estimates' bins."""
    fold = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 for d, _ in rows]
    docs = [tokens(t) for _, t in rows]
    one, two, gone1, gone2 = Counter(), Counter(), Counter(), Counter()
    for f, ts in zip(fold, docs):
        pairs = list(zip([" ", *ts], ts))
        if f != 2:
            one.update(ts)
            two.update(pairs)
        if f == 3:
            gone1.update(ts)
            gone2.update(pairs)
    n, v, d = one.total(), len(one), gone1.total()
    cells = Counter()
    for f, ts in zip(fold, docs):
        if f == 3:
            for b, w in zip([" ", *ts], ts):
                c1 = one[b] - gone1[b]
                p2 = (two[b, w] - gone2[b, w]) / c1 if c1 else 0.0
                p1 = (one[w] - gone1[w]) / max(n - d, 1)
                cells[int(L.bucket(np.array([c1]))[0]), int(L._bin(np.array([p2]))[0]), int(L._bin(np.array([p1]))[0])] += 1
    weights = L.learn([(*k, c) for k, c in cells.items()], 1 / (v + 1))
    out = []
    for (doc, _), f, ts in zip(rows, fold, docs):
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in ts)
        s = 0.0
        for b, w in zip([" ", *ts], ts):
            l0, l1, l2 = weights[int(L.bucket(np.array([one[b]]))[0])]
            s += math.log10(l0 / (v + 1) + l1 * one[w] / max(n, 1) + (l2 * two[b, w] / one[b] if one[b] else 0))
        out.append((doc, f == 2, len(ts), sum(one[w] > 0 for w in ts), n, base, s))
    return out


def same(got, want):
    got, want = (sorted(map(tuple, x), key=lambda r: (str(r[0]), r[2], r[6])) for x in (got, want))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_query_equals_plain_version(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF001}/documents.parquet'").fetchall()
    got = L.op6_lm_scoring(spark, SF001).collect()
    same(got, plain(rows))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_blocks_do_not_change_scores(spark, monkeypatch):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF001}/documents.parquet'").fetchall()
    monkeypatch.setattr(L, "BLOCK_CHARS", 20_000)
    same(L.op6_lm_scoring(spark, SF001).collect(), plain(rows))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "A b Ä \n x"), (None, "a a a"), (4, "a a a"), (4, "a a a"), (5, "word " * 50000), *((i, f"a b {i % 3}") for i in range(10, 40))]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, score int, block string")
    same(L.score(docs).collect(), plain(rows))
    assert L.score(docs.limit(0)).collect() == []
    only = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2]
    same(L.score(spark.createDataFrame(only, "doc_id long, text string")).collect(), plain(only))


def test_packing():
    for keys in ([0], [5, 2**63, 2**64 - 1], list(range(7, 9000, 3))):
        k = np.array(keys, np.uint64)
        assert (L.unpack(L.pack(k)) == k).all()
        assert (L.unpack_counts(L.pack_counts(k // np.uint64(2))) == k // np.uint64(2)).all()
    assert len(L.pack(np.arange(0, 2**40, 2**30, dtype=np.uint64))) == 9 + 6 * 1023
