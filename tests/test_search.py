"""Search, fusion and evidence: brute force over small fixtures, ties, nulls, empty tables."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import dense, evidence, fusion, lexical

CHUNKS = "chunk_id string, text string"
QUESTIONS = "query_id long, question string"


def test_bm25_equals_brute_force(spark):
    texts = {"a": "refund of levy under rule 42", "b": "levy levy on boats", "c": "rule 17(5) on refund", "d": "nothing here", "e": "levy levy on boats"}
    chunks = spark.createDataFrame([*texts.items(), ("a", texts["a"]), ("z", None)], CHUNKS).withColumn("term", F.lit("clash")).withColumn("score", F.lit(1))
    questions = spark.createDataFrame([(1, "refund rule 42"), (1, "refund rule 42"), (2, "levy levy boats"), (3, "  "), (4, None), (5, "unknown")], QUESTIONS)
    hits = lexical.bm25(lexical.postings(chunks), lexical.corpus(chunks), questions, 3).orderBy("query_id", "rank").collect()
    docs = {k: t.replace("17(5)", "17(5) 17 5").split() for k, t in texts.items()} | {"z": []}
    mean = sum(map(len, docs.values())) / len(docs)
    want = []
    for q, question in ((1, "refund rule 42"), (2, "levy levy boats")):
        scores = {}
        for key, words in docs.items():
            tf, total = Counter(words), 0.0
            for term, n in Counter(question.split()).items():
                df = sum(term in w for w in docs.values())
                if tf[term]:
                    total += n * math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf[term] * 2.5 / (tf[term] + 1.5 * (0.25 + 0.75 * len(words) / mean))
            if total > 0:
                scores[key] = round(total, 6)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:3]
        want += [(q, key, score, i) for i, (key, score) in enumerate(best, 1)]
    assert [(r.query_id, r.chunk_id, pytest.approx(r.score), r["rank"]) for r in hits] == want
    assert lexical.bm25(lexical.postings(chunks), lexical.corpus(chunks), questions, 0).count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], CHUNKS)
    questions = spark.createDataFrame([(1, "refund")], QUESTIONS)
    assert lexical.bm25(lexical.postings(none), lexical.corpus(none), questions).count() == 0
    assert dense.hashed_topk(dense.hashed_vectors(none, "chunk_id", "text"), questions, 5).count() == 0
    vectors = spark.createDataFrame([], "chunk_id string, embedding array<float>")
    assert dense.dense_topk(vectors, spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query array<double>")).count() == 0
    assert dense.dense_topk(vectors, spark.createDataFrame([], "query_id long, query array<double>")).count() == 0


def test_dense_ties_zero_null_and_length(spark):
    rows = [("b", [2.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 0.0]), ("d", [-1.0, 0.0]), ("e", None), ("f", []), ("g", [1.0, 1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").withColumn("query", F.lit("clash"))
    queries = spark.createDataFrame([(1, [3.0, 0.0]), (2, None), (3, [])], "query_id long, query array<double>")
    hits = dense.dense_topk(vectors, queries, 4).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in hits] == [("a", 1.0), ("b", 1.0), ("c", 0.0), ("d", -1.0)]
    hits = dense.dense_topk(vectors, queries, 2, normalized=True).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in hits] == [("b", 6.0), ("a", 3.0)]


def test_dense_equals_brute_force_in_parts_with_ties(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(f"c{i:03}", rng.integers(-2, 3, 3).astype(float).tolist()) for i in rng.permutation(400)]
    queries = [(q, rng.integers(-2, 3, 3).astype(float).tolist()) for q in range(30)]
    vectors = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, query array<double>")
    want = set()
    for q, v in queries:
        scores = {c: round(float(np.dot(e, v) / max(np.linalg.norm(e) * np.linalg.norm(v), 1e-10)), 6) for c, e in rows}
        want |= {(q, c, i) for i, (c, _) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:7], 1)}
    for held, block in ((dense.HELD, dense.QUERIES), (100, 4)):
        monkeypatch.setattr(dense, "HELD", held)
        monkeypatch.setattr(dense, "QUERIES", block)
        assert {(r.query_id, r.chunk_id, r["rank"]) for r in dense.dense_topk(vectors, asked, 7).collect()} == want


def test_embedder_hook(spark):
    texts = spark.createDataFrame([("a", " xx "), ("b", "yyyy"), ("c", "  "), ("d", None), ("e", "")], "key string, text string")
    made = {r.key: r.embedding for r in dense.embed(texts, "key", "text", lambda some: np.array([[len(t), 0.0] for t in some])).collect()}
    assert made == {"a": [1.0, 0.0], "b": [1.0, 0.0]}
    plain = dense.embed(texts, "key", "text", lambda some: np.array([[len(t), 0.0] for t in some]), normalize=False).collect()
    assert {r.key: r.embedding for r in plain} == {"a": [2.0, 0.0], "b": [4.0, 0.0]}


SIDE = "query_id long, chunk_id string, score double"


@pytest.mark.parametrize(
    ("left", "right", "want"),
    [
        ([("c1", 10.0)], [], [("c1", 0.5, ["bm25"], 10.0, None)]),
        ([], [("c2", 0.85)], [("c2", 0.5, ["dense"], None, 0.85)]),
        ([("c1", 20.0), ("c2", 10.0)], [("c2", 0.8), ("c1", 0.4)], [("c1", 0.5, ["bm25", "dense"], 20.0, 0.4), ("c2", 0.5, ["bm25", "dense"], 10.0, 0.8)]),
        ([("c1", 0.0), ("c2", 0.0)], [], [("c1", 0.0, ["bm25"], 0.0, None), ("c2", 0.0, ["bm25"], 0.0, None)]),
    ],
)
def test_fusion(spark, left, right, want):
    make = lambda rows: spark.createDataFrame([(1, *r) for r in rows], SIDE)
    got = fusion.fuse(make(left), make(right)).orderBy("rank").collect()
    assert [(r.chunk_id, r.score, r.retrieval_sources, r.bm25_score, r.dense_score) for r in got] == want
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1))


def test_refusals_labels_and_questions(spark):
    rows = [("Yes, 5 per cent.", "grounded"), ("There is INSUFFICIENT evidence.", "insufficient_evidence"), ("  ", "insufficient_evidence"), (None, "insufficient_evidence")]
    for text, label in rows:
        df = spark.createDataFrame([(text,)], "t string")
        assert df.select(evidence.confidence_label(F.col("t")).alias("x")).first().x == label
    phrases = [  # written out here, so that a missing phrase in the library shows
        "cannot be determined from the provided", "cannot be determined based on the provided", "not provided in the documents",
        "not mentioned in the provided", "provided documents do not contain", "provided evidence does not contain",
        "no information is provided", "insufficient evidence", "insufficient information", "not covered in the provided",
        "not found in the provided",
    ]
    said = spark.createDataFrame([(k, f"It is {p.title()} pages.") for k, p in enumerate(phrases)] + [(99, "It is provided in full.")], "k int, t string")
    assert {r.k for r in said.where(evidence.is_refusal(F.col("t"))).collect()} == set(range(len(phrases)))
    for text, valid in (("q", True), ("x" * 1000, True), ("x" * 1001, False), ("   ", False), ("", False), (None, False)):
        assert spark.createDataFrame([(text,)], "t string").select(evidence.valid_question(F.col("t")).alias("x")).first().x is valid


def test_evidence_and_citations(spark):
    found = spark.createDataFrame(
        [(1, 1, "c", "f.pdf", "4", "T", 2, 2, "one"), (1, 2, "d", "g.pdf", "5", "U", 2, 3, "two"), (1, 3, "c", "f.pdf", "4", "T", 2, 2, "one")],
        "query_id long, rank int, chunk_id string, source_filename string, section_path string, section_title string, page_start int, page_end int, text string",
    )
    text = evidence.evidence(found).first().evidence
    assert text.count("Document Evidence") == 3 and "Pages: pages 2-3\nContent:\ntwo" in text
    assert [(r.position, r.chunk_id) for r in evidence.citations(found).orderBy("position").collect()] == [(1, "c"), (2, "d")]
