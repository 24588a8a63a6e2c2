"""Continuous scoring: job descriptions arrive as a stream and are ranked against fixed résumé vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rankloom.functions.text import clean_text
from rankloom.operators.search import top_k as search_top_k
from rankloom.operators.tfidf import TfidfSettings, token_table, vectorizer
from rankloom.staging import drop_staged, stage


def score_stream(requests: DataFrame, resume_vectors: DataFrame, vocabulary: DataFrame,
                 settings: TfidfSettings, top_k: int, output: str, checkpoint: str, **trigger):
    """Start the query that appends ``query_id, rank, doc_id, score`` per request to ``output``.

    Each request meets all résumés within its micro-batch, so the result does not depend on how the stream
    is cut. Every micro-batch writes its own folder and a repeated one overwrites it. The vocabulary is broadcast once;
    what a micro-batch writes on the way is deleted when it is done.
    """
    to_vectors = vectorizer(resume_vectors.sparkSession, vocabulary, settings)

    def rank_batch(batch: DataFrame, batch_id: int) -> None:
        tokens = token_table(batch, "query_id", clean_text(F.col("text")), settings.stop_words, ascii_only=True)
        with drop_staged(batch.sparkSession):
            queries = stage(to_vectors(tokens), "vectors")
            (search_top_k(queries, resume_vectors, top_k)
             .write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}"))

    return (requests.writeStream.foreachBatch(rank_batch)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
