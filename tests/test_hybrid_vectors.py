"""Hybrid search over given vectors: what it leaves on disk, questions of the same terms, repeated rows, scoring in pieces."""

import os

import numpy as np
import pytest

from folioflow.operators import dense, lexical
from folioflow.plans import catalog
from folioflow.plans.lineage import checkpoint_dir
from folioflow.sources import index_store


def _bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)


def test_what_is_kept_is_less_than_the_input(spark, data):
    """Vectors and tokens are not written out as they are in memory (before: 2.2 times the two tables at sf0.001)."""
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = _bytes(folder)
    assert catalog.hybrid_vectors_topk(spark, data).count() > 0
    assert _bytes(folder) - before < sum(os.path.getsize(f"{data}/{t}.parquet") for t in ("chunks", "chunk_vectors"))


def test_questions_of_the_same_terms_and_scoring_in_pieces(spark, monkeypatch):
    """Chunks that go on in the next batch, blocks of questions, weights in parts: the same hits, and those of its twin for every question."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(12)]
    chunks = spark.createDataFrame([(f"c{i:02}", " ".join(rng.choice(words, 9))) for i in range(60)], "chunk_id string, text string")
    asked = [(i, " ".join(rng.choice(words, 3))) for i in range(7)]
    questions = spark.createDataFrame(asked + [(i + 10, " ".join(reversed(q.upper().split()))) for i, q in asked] + [(99, "none of these")], "query_id long, question string")
    search = lambda: sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in lexical.bm25(lexical.postings(chunks), lexical.corpus(chunks), questions, 5).collect())
    whole = search()
    assert len(whole) == 70 and [(q + 10, *x) for q, *x in whole if q < 10] == [x for x in whole if x[0] >= 10]
    monkeypatch.setattr(lexical, "QUERIES", 2)
    monkeypatch.setattr(lexical, "HELD", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        assert search() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("size", (1.0, 1e-7))
def test_repeated_vectors_count_once(spark, size):
    """In a batch, in a later one and in another task; also vectors so small that single precision is not asked."""
    rng = np.random.default_rng(6)
    rows = [(f"v{i:02}", (size * rng.standard_normal(4)).tolist()) for i in range(40)] + [("zero", [0.0] * 4)]
    asked = spark.createDataFrame([(i, rows[i][1]) for i in range(5)] + [(9, [0.0] * 4)], "query_id long, query array<double>")
    search = lambda some: sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in dense.dense_topk(spark.createDataFrame(some, "chunk_id string, embedding array<double>").repartition(3), asked, 6).collect())
    want = []
    for q, v in [(i, rows[i][1]) for i in range(5)] + [(9, [0.0] * 4)]:
        scores = {c: round(float(np.dot(e, v) / max(np.linalg.norm(e) * np.linalg.norm(v), 1e-10)), 6) + 0.0 for c, e in rows}
        want += [(q, i, c, s) for i, (c, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:6], 1)]
    assert search(rows + rows[:9] + rows[:3]) == want


def test_one_vector_for_each_chunk(spark):
    """Of different vectors of a chunk_id always the same one is taken; equal rows stay."""
    rows = [("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [1.0, 1.0]), ("b", [1.0, 1.0])]
    schema = "chunk_id string, embedding array<float>"
    first, second = (index_store.one_each(spark.createDataFrame(x, schema)).distinct().collect() for x in (rows, rows[::-1]))
    assert sorted(first) == sorted(second) and [r.chunk_id for r in sorted(first)] == ["a", "b"]
