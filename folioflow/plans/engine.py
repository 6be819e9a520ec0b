"""Questions to answers over an index: retrieval, evidence, an injected answer client, labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.config import DEFAULT, Config
from folioflow.functions.text import strip
from folioflow.operators import dense, evidence, fusion, lexical
from folioflow.plans.lineage import cut
from folioflow.sources import index_store

#: Takes the prompt, returns the answer.
AnswerClient = Callable[[str], str]

NO_QUESTION = "Please provide a question."
NO_EVIDENCE = "There is insufficient evidence to answer this question."


def first_sentence(prompt: str) -> str:
    """A stand-in for a language model: the first sentence of the first block of evidence."""
    content = prompt.split("Content:\n", 1)[-1].split("\n", 1)[-1]
    return content.split(". ", 1)[0].strip() or NO_EVIDENCE


class Engine:
    """Answers batches of questions; one question is a batch of one."""

    def __init__(
        self, index: index_store.Index, client: AnswerClient = first_sentence, config: Config = DEFAULT, embedder: dense.Embedder | None = None
    ) -> None:
        self.index, self.client, self.config, self.embedder = index, client, config, embedder

    @classmethod
    def open(
        cls, spark: SparkSession, folder: str, client: AnswerClient = first_sentence, config: Config = DEFAULT, embedder: dense.Embedder | None = None
    ) -> Engine:
        return cls(index_store.load(spark, folder), client, config, embedder)

    def _asked(self, questions: DataFrame) -> DataFrame:
        """query_id, query: the vectors of questions with text, by the embedder or, in an index of hashed tokens, like it."""
        if self.embedder is not None:
            vectors = dense.embed(questions.dropDuplicates(["query_id"]), "query_id", "question", self.embedder, self.index.normalized)
        elif self.index.model == index_store.HASHED:
            vectors = dense.hashed_vectors(questions, "query_id", "question")
        else:
            raise ValueError(f"questions need vectors or an embedder of {self.index.model}")
        return vectors.withColumnRenamed("embedding", "query")

    def search(self, questions: DataFrame, top_k: int | None = None, queries: DataFrame | None = None) -> DataFrame:
        """Fused hits of questions (query_id, question); blank ones and top_k <= 0 have none.

        ``queries`` (query_id, query) are the questions' vectors where they are known; else the embedder makes them.
        """
        top_k = self.config.hybrid_top_k if top_k is None else top_k
        depth = max(top_k, self.config.lexical_top_k, self.config.dense_top_k)
        a = lexical.bm25(self.index.postings, self.index.corpus, questions, depth, self.config)
        asked = self._asked(questions) if queries is None else queries
        b = dense.dense_topk(self.index.vectors, asked, depth if top_k > 0 else 0, self.index.normalized, self.config)
        return fusion.fuse(a, b, top_k, self.config)

    def ask(self, questions: DataFrame) -> DataFrame:
        """query_id, question, answer, confidence_label, sources: every question of the batch, each client call once.

        A blank question and one without hits get a fixed answer without a call. A failing client fails the job.
        """
        hits = evidence.hit_chunks(cut(self.search(questions).select("query_id", "chunk_id", "rank")), self.index.chunks)
        cited = evidence.citations(hits)
        fields = ("position", "chunk_id", "source_filename", "section_path", "page_start", "page_end")
        sources = cited.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("sources"))
        asked = questions.withColumn("question", strip(F.col("question"))).join(evidence.evidence(hits), "query_id", "left").join(sources, "query_id", "left")
        prompt = F.concat(F.lit("Evidence:\n"), F.col("evidence"), F.lit("\n\nQuestion: "), F.col("question"), F.lit("\n\nAnswer:"))
        client = self.client

        def answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(answer=[None if p is None else client(p) for p in batch["prompt"]])[["query_id", "answer"]]

        some = asked.where(F.col("evidence").isNotNull() & (F.col("question") != ""))
        said = cut(some.select("query_id", prompt.alias("prompt")).mapInPandas(answers, "query_id long, answer string"))
        blank = F.coalesce(F.col("question"), F.lit("")) == ""
        full = asked.join(said, "query_id", "left")
        fixed = F.when(blank, NO_QUESTION).when(F.col("evidence").isNull(), NO_EVIDENCE).otherwise(F.col("answer"))
        label = F.when(blank, "insufficient_evidence").otherwise(evidence.confidence_label(fixed))
        return full.select("query_id", "question", fixed.alias("answer"), label.alias("confidence_label"), "sources")
