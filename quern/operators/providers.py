"""Models behind functions: embeddings in batches, query vectors with a cache, answers as streams of tokens.

A provider is any function that workers can import or unpickle; nothing here knows a model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import paths

#: Texts to vectors, as many as were given. A prompt to the pieces of its answer.
Embedder = Callable[[list[str]], list[list[float]]]
Chat = Callable[[str], Iterable[str]]
BATCH, CACHED = 16, 100


def checked_model(name: str, spark) -> str:
    """The model's name; one that runs elsewhere is refused."""
    if spark.range(1).select(paths.is_cloud_model(F.lit(name))).first()[0]:
        raise ValueError(f"{name} would leave this machine")
    return name


def embed(rows: DataFrame, embedder: Embedder, id_col: str = "id", text_col: str = "text", batch: int = BATCH) -> DataFrame:
    """(id_col, vec) of rows: unit vectors, null for null texts. A provider that returns another number of vectors fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            asked = [i for i, t in enumerate(texts) if t is not None]
            vectors: list[list[float] | None] = [None] * len(texts)
            for a in range(0, len(asked), batch):
                part = asked[a : a + batch]
                made = embedder([texts[i] for i in part])
                if len(made) != len(part):
                    raise ValueError(f"{len(part)} texts gave {len(made)} vectors")
                for i, v in zip(part, made, strict=True):
                    v = np.asarray(v, float)
                    vectors[i] = (v / (np.linalg.norm(v) or 1.0)).tolist()
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(vectors, pa.list_(pa.float32()))], ["id", "vec"])

    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, vec array<float>").withColumnRenamed("id", id_col)


def query_vectors(queries: DataFrame, cache: DataFrame, embedder: Embedder, most: int = CACHED) -> tuple[DataFrame, DataFrame]:
    """Vectors (query_id, vec) of queries (query_id, query, at), and the next cache (key, vec, at).

    Equal queries, case and outer white space aside, are embedded once, those in the cache not at all. The cache keeps
    the `most` keys that came last; being used again doesn't keep a key longer.
    """
    keyed = queries.withColumn("key", F.lower(F.trim("query")))
    fresh = keyed.groupBy("key").agg(F.min("at").alias("at")).join(cache.select("key"), "key", "left_anti")
    made = fresh.join(embed(fresh, embedder, "key", "key"), "key").select("key", "vec", "at")
    known = cache.select("key", "vec", "at").unionByName(made)
    kept = known.withColumn("place", F.row_number().over(Window.orderBy(F.desc("at"), "key"))).where(F.col("place") <= most)  # some hundred keys
    return keyed.join(known, "key").select("query_id", "vec"), kept.select("key", "vec", "at")


def answers(prompts: DataFrame, chat: Chat) -> DataFrame:
    """(query_id, seq, token) of prompts (query_id, prompt): the pieces of each answer in order. A chat that fails gives a last piece with seq -1 and its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, prompt in enumerate(b.column("prompt").to_pylist()):
                out: list[tuple[int, str]] = []
                try:
                    out += enumerate(chat(prompt or ""))
                except Exception as e:  # one answer's failure is its own
                    out.append((-1, str(e)))
                ids = b.column("query_id").take(pa.array([i] * len(out), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([s for s, _ in out], pa.int64()), pa.array([t for _, t in out], pa.string())], ["query_id", "seq", "token"])

    rows = prompts.select("query_id", "prompt")
    return rows.mapInArrow(run, f"query_id {rows.schema['query_id'].dataType.simpleString()}, seq long, token string")
