"""Line-first cleaning: measures against a plain version, the SQL, odd rows, labelled documents."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from subsight.llm import quality as Q
from subsight.plans.registry import Query

from ..conftest import SF001, SF01
from ..oracle_check import compare, duck


def plain(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [l for l in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", l)]
    wins = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    n = Counter(wins)
    rep = len({i + k for i, w in enumerate(wins) if n[w] > 1 for k in range(3)})
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), rep, len(ws) < 50 or 100 * rep > 50 * len(ws)


ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, "a b a b a b"), (4, "a b a b a b"), (None, "x y z x y z"), (5, "same " * 40000), (6, "no end of it " * 20),
        (7, ("A line of plain prose that says what it has to say. " * 8 + "\n") * 3), (8, "Line one is here.\nLine one is here.\r\n" * 30),
        (9, "\U0001F600 𝒳 # & | < >"), (10, "Home | About | News | Contact\n" * 20), (11, "word&&& " * 80), (12, "a b  c " * 30)]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "doc_id long, text string, n_words int, clean string")
    got = Q.judge(docs).collect()
    key = lambda r: (str(r[0]), r[1:])
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got), key=key) == sorted(
        ((d, *plain(t)) for d, t in ROWS), key=key)
    assert Q.judge(docs.limit(0)).collect() == [] and Q.clean(docs.limit(0)).collect() == []
    assert Q.clean(docs).columns == docs.columns


@pytest.mark.parametrize("line,ok", [
    ("A sentence with an end.", True), ("He said \"stop.\"", True), ("Home | About | News", False), ("this line just stops", False),
    ("One. Two and more without an end", True), ("Please enable JavaScript to view this page.", False), ("We use cookies to improve it.", False),
    ("Odd### words&&& with*** marks.", False), ("ends with a question?", True), ("  padded line.  \r", True), ("R&D is fine here.", True)])
def test_lines(spark, line, ok):
    df = spark.createDataFrame([(line,)], "l string")
    assert df.select(Q.line_passes(F.col("l")).alias("ok")).first()["ok"] is ok


def test_clean_removes_lines_and_documents(spark):
    text = "\n".join(" ".join(f"word{i}x{k}" for k in range(12)) + " ends here. " for i in range(10))
    rows = [(1, text, len(text)), (2, "menu | of | entries\n\n" + text, 0), (3, ("menu | of | entries\n" * 60) + text, 0), (4, None, None)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, n_chars long, lang string")
    got = {r["doc_id"]: r for r in Q.clean(docs).collect()}
    assert set(got) == {1, 2}
    assert got[1]["text"] == text and got[1]["n_chars"] == len(text)
    assert got[2]["text"] == "\n" + text and got[2]["n_chars"] == len(text) + 1


def test_sql(spark):
    q = Query("op8_quality_rules", Q.op8_quality_rules, Q.ORACLE_SQL)
    for sf in (SF001, SF01):
        problems, n = compare(spark, q.name, q, sf, duck(sf))
        assert not problems and n


def test_labelled_documents(spark):
    """Every labelled good document that passes the base rules stays, every bad one goes."""
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF01}/labels.parquet'").fetchall())
    rows = {r["doc_id"]: r for r in Q.op8_quality_rules(spark, SF01).collect()}
    assert all(rows[d]["kept"] or rows[d]["base_failed"] for d, good in labels.items() if good)
    assert not any(rows[d]["kept"] for d, good in labels.items() if not good)
