"""The pipeline against plain versions of its stages on a small table."""

import duckdb
import numpy as np

import corpus_pipeline as C
from subsight.llm import mixing, pii, quality, unigram
from subsight.llm.common import read, write_and_read

from ..conftest import SF001
from .brute import near_classes


def test_stages(spark):
    docs = read(spark, SF001, "documents")
    columns = docs.columns
    kept = []
    for name, stage in C.STAGES:
        docs = write_and_read(stage(spark, docs, SF001), "test-stage")
        if name != C.STAGES[-1][0]:
            assert docs.columns == columns, name
        kept.append([r.asDict() for r in docs.collect()])
    rules, dedup, private, mixed, pieces = kept
    judged = {r["doc_id"]: r for r in quality.judge(read(spark, SF001, "documents")).collect()}
    assert {r["doc_id"]: r["text"] for r in rules} == {d: r["clean"] for d, r in judged.items() if r["kept"]}
    classes = near_classes((r["doc_id"], r["text"]) for r in rules)
    assert sorted(r["doc_id"] for r in dedup) == sorted({c for _, c in classes})
    texts = {r["doc_id"]: r["text"] for r in dedup}
    for r in private:
        if "term" not in r["text"].lower():
            assert r["text"] == pii.masked(texts[r["doc_id"]], ()) or "[TERM]" in r["text"] or len(r["text"]) < len(texts[r["doc_id"]])
        assert pii.base_spans(r["text"]) == []
    sizes = {}
    for r in private:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    for s, target in mixing.targets(list(sizes.items())).items():
        words = [len(r["text"].split()) for r in mixed if r["source"] == s]
        assert abs(sum(words) - target) <= max(words, default=0) + 1
    p = unigram.load(unigram.default_model())
    assert len(pieces) == len(mixed)
    for r in pieces:
        assert r["piece_ids"] == np.frombuffer(p.encode(r["text"]), "<u4").tolist() and r["round_trip"] and r["n_pieces"] == len(r["piece_ids"])


def test_run(spark):
    n = duckdb.sql(f"SELECT count(*) FROM '{SF001}/documents.parquet'").fetchall()[0][0]
    assert 0 < C.run(spark, SF001).count() < 3 * n


def test_empty_table(spark):
    docs = read(spark, SF001, "documents").limit(0)
    for _, stage in C.STAGES:
        docs = write_and_read(stage(spark, docs, SF001), "test-stage")
    assert docs.count() == 0
