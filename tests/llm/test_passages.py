"""Removed words against plain windows, hashes, intervals, odd rows."""

import hashlib

import duckdb
import numpy as np

from subsight.llm import passages as P

from ..conftest import SF001


def brute(rows, window):
    """rows: (doc_id, text) -> sorted (doc_id, n_words, n_removed, digest)."""
    split = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, ws in split:
        for i in range(len(ws) - window + 1):
            key = tuple(ws[i:i + window])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, ws in split:
        keep = [True] * len(ws)
        for i in range(len(ws) - window + 1):
            if d is not None and first[tuple(ws[i:i + window])] < d:
                keep[i:i + window] = [False] * window
        kept = [w for w, k in zip(ws, keep) if k]
        out.append((d, len(ws), len(ws) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, window):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_words int, marks string")
    out = P.removals(df, window).collect()
    for r in out:
        spans = [(s["start"], s["end"]) for s in r["spans"]]
        assert sum(b - a for a, b in spans) == r["n_removed"] and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))  # maximal
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out), key=str)


def test_plain_windows(spark):
    rng = np.random.default_rng(1)
    passage = [" ".join(rng.choice(list("abcdef"), 30)) for _ in range(4)]
    rows = []
    for i in range(80):
        own = lambda: " ".join(rng.choice([f"w{j}" for j in range(200)], int(rng.integers(0, 25))))
        rows.append((int(i), f"{own()} {passage[rng.integers(4)]}\n{own()}\t{passage[rng.integers(4)]} {own()}"))
    rows += [(100 + i, t) for i, (_, t) in enumerate(rows[:10])]
    for window in (1, 2, 5, 8):
        assert run(spark, rows, window) == brute(rows, window)


def test_whole_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF001}/documents.parquet'").fetchall()
    found = run(spark, rows, 50)
    assert found == brute(rows, 50) and sum(r[2] for r in found) > 0


def test_odd_rows(spark):
    text = "one two three four five six"
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (None, text), (None, text), (4, "zero " + text), (5, text), (5, text), (5, text + " seven"),
            (6, "five six seven one two"), (7, "one two three four five"), (8, "a a a a a a a a"), (9, "a a a a a"), (-3, "b c d e"), (2**62, "x b c d e")]
    for window in (1, 3, 4):
        assert run(spark, rows, window) == brute(rows, window)
    assert run(spark, [], 50) == [] and run(spark, [(1, None)], 50) == brute([(1, None)], 50)


def test_long_text(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE", 64)  # pieces end inside the text, and inside long words
    rng = np.random.default_rng(2)
    text = " ".join("x" * int(rng.integers(1, 150)) if rng.random() < 0.1 else f"w{rng.integers(99)}" for _ in range(500))
    rows = [(1, text), (2, "y " * 30 + text[200:900]), (3, "z"), (4, text.replace(" ", "\n"))]
    assert run(spark, rows, 7) == brute(rows, 7)


def test_hashes_do_not_depend_on_the_place():
    a, places = P.word_hashes("  ab abc é ab\n\nabc ".encode())
    assert places.tolist() == [2, 5, 9, 12, 16] and a[0] == a[3] and a[1] == a[4] and len(set(a.tolist())) == 3
    text, start, hashes, marks = P.windows([b"a b c d e", b"", b"x", b"z a b c d"], 3, 2)
    assert text.tolist() == [0, 0, 0, 3, 3, 3] and start.tolist() == [0, 1, 2, 0, 1, 2]
    assert hashes[0] == hashes[4] and marks[0] == marks[4] and hashes[1] == hashes[5] and len(set(hashes.tolist())) == 4


def test_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(P, "HOT", 3)  # both ways of the join
    rows = [(i, "h1 h2 h3 h4 " + " ".join(f"v{i // 2}_{j}" for j in range(6))) for i in range(40)]
    assert run(spark, rows, 4) == brute(rows, 4)
