"""Queries of sources and chunks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import vectors
from quern.operators import chunking, evaluate, history, store
from quern.plans import model
from quern.plans.text_queries import CONTENTS
from quern.sources import files
from quern.streaming import session


def chunks_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.chunk(model.contents(spark, sf_dir).select("content_id", "kind", "text"))
    return made.select("content_id", F.col("ord").cast("long").alias("ord"), "start", "stop", F.sha2("text", 256).alias("sha"))


def stitch_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents again: each one's chunks of its one long paragraph, joined where they overlap, white space aside."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    contents = model.contents(spark, sf_dir).select("content_id", "kind", flat.alias("text")).where("text <> ''")
    return chunking.stitch(chunking.chunk(contents)).select("content_id", F.sha2(F.regexp_replace("text", r"\s+", " "), 256).alias("sha"), "truncated")


def chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks there are, of how many characters, and the longest."""
    made = model.chunks(spark, sf_dir)
    return made.agg(F.count("*").alias("chunks"), F.sum(F.char_length("text")).alias("characters"), F.max(F.char_length("text")).alias("longest"), F.count_if(F.col("ord") == 0).alias("contents"))


def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of each vector that aren't zero."""
    made = model.table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(vectors.hashed_words(F.col("text"))).alias("slot", "value"))
    return made.where("value > 0").select("item_id", "slot", F.round(F.col("value").cast("double"), 5).alias("value"))


def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of which every third is put in anew, turned round; and through their binary form."""
    rows = model.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    fresh = rows.where("chunk_id % 3 = 0").select("chunk_id", F.transform("vec", lambda x: -x).alias("vec"))
    stored = store.upsert_vectors(rows, fresh).select("chunk_id", vectors.from_bytes(vectors.to_bytes(F.col("vec"))).alias("vec"))
    return stored.select("chunk_id", F.size("vec").alias("dims"), F.round(F.col("vec")[0].cast("double"), 5).alias("first"))


def chunks_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of every fourth content replaced by its first one, and those of contents that are gone dropped."""
    pieces = model.chunks(spark, sf_dir).select("id", "content_id", "ord")
    replaced = store.replace_chunks(pieces, pieces.where("content_id % 4 = 0 and ord = 0"))
    (left,) = store.cascade(model.contents(spark, sf_dir).where("content_id % 7 <> 0"), replaced)
    return left


def documents_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every content as it is shown: text stitched from its chunks, state, and whether it has changed; every fifth has."""
    contents = model.contents(spark, sf_dir)
    changed = contents.select("content_id", (F.col("content_id") % 5 == 0).alias("changed"))
    label = store.status_label(F.col("extract_status"), F.col("embed_status"), F.col("chunk_count"))
    views = chunking.document_views(contents, model.chunks(spark, sf_dir), label, changed)
    return views.select("content_id", F.sha2(F.regexp_replace(F.trim("text"), r"\s+", " "), 256).alias("sha"), "truncated", "status", "changed")


def word_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns against themselves without every second word."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    turns = model.table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.col("text").alias("said"), F.array_join(F.filter(words, lambda w, i: i % 2 == 0), " ").alias("heard"))
    return turns.select("conv_id", "turn", evaluate.word_errors(F.col("said"), F.col("heard")).alias("edits"))


def frame_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loudness of vectors taken as audio frames, and the runs of loud ones."""
    frames = model.table(spark, sf_dir, "embeddings").select(F.lit("s").alias("stream"), F.col("vec_id").alias("seq"), F.col("embedding").alias("samples"))
    loud = session.valid_frames(frames, 64).withColumn("level", F.when(F.col("seq") % 10 < 6, files.level(F.col("samples"))).otherwise(0.0))
    return session.utterance_runs(loud, 0.02, 3).select("first", "last")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events as a conversation: what the state machine does after each."""
    kind = F.when(F.col("event_type") == "click", "wake").when(F.col("event_type") == "view", "utterance").when(F.col("event_type") == "purchase", "files_shown").otherwise("tick")
    events = model.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), (history.micros(F.col("ts")) / 1_000_000).cast("long").alias("at"), kind.alias("type"), F.lit("file").alias("kind"), F.lit("").alias("pick"), F.lit(False).alias("reveal"))
    return session.sessions_batch(events).groupBy("phase", "actions").agg(F.count("*").alias("n"))


FLAT = "trim(regexp_replace(coalesce(text, ''), '[\\s]+', ' ', 'g'))"
_CHUNKS = f"{CONTENTS}, {model.CHUNKS_SQL}"
SQL = {
    "stitch_document": f"WITH {model.FILES_SQL} SELECT content_id, sha256({FLAT}[1:{chunking.VIEW_CHARS}]) AS sha, length({FLAT}) > {chunking.VIEW_CHARS} AS truncated FROM contents WHERE {FLAT} <> ''",
    "chunks_structural": f"WITH RECURSIVE {_CHUNKS} SELECT content_id, ord, start, stop, sha256(text) AS sha FROM chunks",
    "chunk_totals": f"WITH RECURSIVE {_CHUNKS} SELECT count(*) AS chunks, sum(length(text))::BIGINT AS characters, max(length(text)) AS longest, count(*) FILTER (ord = 0) AS contents FROM chunks",
    "hashed_embeddings": """WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '\\S+')) AS w FROM benchmark),
        h AS (SELECT item_id, list_reduce([('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(encode(w)), '..')], lambda h, b: (xor(h, b) * 16777619) & 4294967295, 2166136261::BIGINT) % 768 AS slot FROM w),
        c AS (SELECT item_id, slot, count(*) AS n FROM h GROUP BY item_id, slot)
        SELECT item_id, slot::INTEGER AS slot, round((n / sqrt(sum(n * n) OVER (PARTITION BY item_id)))::FLOAT::DOUBLE, 5) AS value FROM c""",
    "vector_upsert": "SELECT vec_id AS chunk_id, len(embedding)::INTEGER AS dims, round((CASE WHEN vec_id % 3 = 0 THEN -embedding[1] ELSE embedding[1] END)::DOUBLE, 5) AS first FROM embeddings",
    "chunks_replaced": f"WITH RECURSIVE {_CHUNKS} SELECT id, content_id, ord FROM chunks WHERE content_id % 7 <> 0 AND (content_id % 4 <> 0 OR ord = 0)",
    "documents_view": f"""WITH {model.FILES_SQL} SELECT content_id, sha256(trim({FLAT}[1:{chunking.VIEW_CHARS}])) AS sha, length({FLAT}) > {chunking.VIEW_CHARS} AS truncated,
        CASE WHEN extract_status = 'pending' THEN 'waiting' WHEN extract_status <> 'ok' THEN replace(extract_status, '_', ' ') WHEN chunk_count = 0 THEN 'empty' WHEN embed_status = 'done' THEN 'searchable by meaning' WHEN embed_status = 'failed' THEN 'searchable by words only' ELSE 'searchable by words' END AS status, content_id % 5 = 0 AS changed FROM contents""",
    "word_error_rates": "SELECT conv_id, turn, len(regexp_extract_all(text, '\\S+')) // 2 AS edits FROM conversations WHERE text IS NOT NULL",
    "frame_levels": """WITH l AS (SELECT vec_id AS seq FROM embeddings WHERE vec_id % 10 < 6 AND len(embedding) = 64 AND sqrt(list_sum([(x * x)::DOUBLE FOR x IN embedding::DOUBLE[]]) / 64) >= 0.02),
        n AS (SELECT seq, CASE WHEN seq - lag(seq) OVER (ORDER BY seq) <= 3 THEN 0 ELSE 1 END AS new FROM l), r AS (SELECT seq, sum(new) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM n)
        SELECT min(seq) AS first, max(seq) AS last FROM r GROUP BY run HAVING max(seq) - min(seq) + 1 >= 3""",
}
QUERIES = {name: globals()[name] for name in SQL} | {"sessions": sessions}
