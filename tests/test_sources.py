import pytest
from pyspark.sql import functions as F

from folioflow.config import Config
from folioflow.operators import chunking
from folioflow.plans.engine import NO_EVIDENCE, NO_QUESTION, Engine
from folioflow.sources import files, index_store
from folioflow.sources.tables import table
from folioflow.streaming import ingest


def test_config_from_environment(monkeypatch):
    monkeypatch.setenv("FOLIOFLOW_BM25_K1", "2.0")
    assert Config.from_environment().bm25_k1 == 2.0 and Config().bm25_k1 == 1.5


def test_files_rejections_and_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x" * 60 + "\f" + "y" * 70)
    (tmp_path / "b.txt").write_bytes(b"\n")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "d.txt").write_text("thin\fthin")
    (tmp_path / "z.txt").write_bytes(b"")
    (tmp_path / "e.other").write_text("not scanned")
    good, bad = files.accepted_and_rejected(files.scan_files(spark, str(tmp_path), "*.txt"))
    assert {(r.path[-5:], r.error_kind) for r in bad.collect()} == {("b.txt", "empty"), ("c.txt", "open_failed"), ("d.txt", "scanned"), ("z.txt", "empty")}
    assert [(r.doc_id, r.page_number) for r in files.as_pages(good).orderBy("page_number").collect()] == [("a", 1), ("a", 2)]
    assert files.scan_files(spark, str(tmp_path), "*.none").count() == 0
    assert files.scan_files(spark, str(tmp_path / "missing"), "*.txt").count() == 0


def test_metadata_is_validated(spark):
    rows = [("d1", "f", "c"), ("d2", None, None), (None, "f", "c"), ("d1", "f", "c")]
    good, bad = chunking.accepted_and_rejected_metadata(spark.createDataFrame(rows, "doc_id string, source_filename string, circular_number string"))
    assert good.count() == 2 and {(r.doc_id, tuple(r.missing)) for r in bad.collect()} == {("d2", ("circular_number", "source_filename")), (None, ("doc_id",))}
    with pytest.raises(ValueError, match="circular_number.*source_filename"):
        chunking.accepted_and_rejected_metadata(spark.createDataFrame([("d",)], "doc_id string"))
    with pytest.raises(TypeError, match="doc_id"):
        chunking.accepted_and_rejected_metadata(spark.createDataFrame([(1, "f", "c")], "doc_id long, source_filename string, circular_number string"))


def test_html_pages():
    pages = files.html_pages(b"<p>One &amp; two</p><hr/><table><tr><td>x</td></tr></table>")
    assert pages[0][0].strip() == "One & two" and [n for _, n in pages] == [0, 1]


def test_index_round_trip_and_answers(spark, data, tmp_path):
    chunks = table(spark, data, "chunks")
    with pytest.raises(FileNotFoundError, match="postings"):
        index_store.load(spark, str(tmp_path / "none"))
    index_store.save(index_store.build(chunks), str(tmp_path / "index"))
    engine = Engine.open(spark, str(tmp_path / "index"))
    questions = spark.createDataFrame([(1, " refund of levy on storage of grain "), (2, "  "), (3, "zzzz")], "query_id long, question string")
    built, opened = Engine(index_store.build(chunks)).search(questions), engine.search(questions)
    assert built.exceptAll(opened).count() == 0 and opened.where("query_id = 1").count() == 20 and engine.search(questions, 0).count() == 0
    answers = {r.query_id: r for r in engine.ask(questions.where("query_id < 3")).collect()}
    assert answers[1].confidence_label == "grounded" and len(answers[1].sources) == 20 and answers[1].question == "refund of levy on storage of grain"
    assert (answers[2].answer, answers[2].confidence_label, answers[2].sources) == (NO_QUESTION, "insufficient_evidence", None)
    nothing = Engine(index_store.build(chunks.limit(0))).ask(questions.where("query_id = 3")).first()
    assert (nothing.answer, nothing.confidence_label) == (NO_EVIDENCE, "insufficient_evidence")
    assert index_store.duplicates(chunks).count() == 0


def test_failing_client_fails(spark, data):
    def broken(prompt):
        raise RuntimeError("no answer")

    engine = Engine(index_store.build(table(spark, data, "chunks")), broken)
    with pytest.raises(Exception, match="no answer"):
        engine.ask(spark.createDataFrame([(1, "refund of levy")], "query_id long, question string")).count()


def test_streamed_ingest_equals_batch(spark, data, tmp_path):
    pages, meta = table(spark, data, "pages"), table(spark, data, "doc_meta")
    for part in range(2):
        some = pages.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == part)
        some.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{n} {t}" for n, t in pages.dtypes)
    stream = ingest.ingest(ingest.page_stream(spark, str(tmp_path / "in"), schema).select("*"), meta, str(tmp_path / "out"), str(tmp_path / "state"))
    stream.awaitTermination(120)
    assert stream.exception() is None
    got = spark.read.parquet(str(tmp_path / "out/chunks")).drop("batch")
    want = chunking.chunk_documents(pages, meta)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
    assert spark.read.parquet(str(tmp_path / "out/postings")).count() > 0


def test_index_of_given_vectors(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "levy on boats"), ("b", "levy on carts"), ("c", "grain")], "chunk_id string, text string")
    given = [("a", [3.0, 0.0]), ("b", [0.0, 0.5]), ("c", [1.0, 1.0])]
    vectors = spark.createDataFrame(given + given[:1], "chunk_id string, embedding array<float>")
    for wrong in (vectors.where("chunk_id <> 'a'"), vectors.unionByName(spark.createDataFrame([("z", [1.0, 0.0])], "chunk_id string, embedding array<float>"))):
        with pytest.raises(ValueError, match="have no"):
            index_store.build(chunks, wrong)
    index_store.save(index_store.build(chunks, vectors, model="two"), str(tmp_path / "i"))
    index = index_store.load(spark, str(tmp_path / "i"))
    assert (index.model, index.dimension, index.normalized, index.corpus_size()) == ("two", 2, False, 3)
    assert index_store.load(spark, str(tmp_path / "i"), model="other").model == "other"
    questions = spark.createDataFrame([(1, "boats"), (2, " ")], "query_id long, question string")
    with pytest.raises(ValueError, match="embedder of two"):
        Engine(index).search(questions)
    hits = Engine(index, embedder=lambda texts: [[0.0, 2.0] for _ in texts]).search(questions, 3).collect()
    assert [(r.query_id, r.chunk_id, r.dense_score) for r in sorted(hits, key=lambda r: r["rank"])] == [(1, "a", 0.0), (1, "b", 1.0), (1, "c", 0.707107)]
    known = Engine(index).search(questions, 1, spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query array<double>")).first()
    assert (known.chunk_id, known.score, known.retrieval_sources) == ("a", 1.0, ["bm25", "dense"])
    made = index_store.build(chunks, embedder=lambda texts: [[float(len(t)), 1.0] for t in texts], model="lengths")
    assert (made.dimension, made.normalized, made.vectors.count()) == (2, True, 3)
