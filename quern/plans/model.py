"""The retrieval model over the driver's tables, as DataFrames and as the SQL of the same relations.

files: one for each document; contents: one for each distinct text (content-addressed); chunks: those of operators.chunking.
Statuses made up from sizes serve the queries of the store alone; searched are all files within the real size cap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import paths
from quern.operators import chunking

TOO_LARGE, TINY, SHORT = 20_000, 60, 120


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(
        F.col("doc_id").alias("file_id"), F.concat(F.lit("/"), F.col("source")).alias("folder"), F.concat_ws("_", "source", "lang", F.col("doc_id").cast("string")).alias("name"),
        F.concat(F.col("lang"), F.lit("/"), F.concat_ws("_", "source", "lang", F.col("doc_id").cast("string")), F.lit(".txt")).alias("rel_path"),
        F.char_length(text).cast("long").alias("size"), (F.col("doc_id") * 1000).alias("mtime_ms"), F.col("lang").alias("kind"), F.sha2(text, 256).alias("sha"),
    )
    ids = sized.groupBy("sha", "kind").agg(F.min("file_id").alias("content_id"))
    status = F.when(F.col("size") > TOO_LARGE, "skipped").when(F.col("size") < TINY, "error").when(F.col("size") < SHORT, "pending").otherwise("linked")
    return sized.join(ids, ["sha", "kind"]).withColumn("status", status).withColumn("path", F.concat_ws("/", "folder", "rel_path"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(content_id, text, kind, extract_status, embed_status, chunk_count, embedded)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("kind"))
    named = docs.groupBy("kind", F.sha2("text", 256).alias("sha")).agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("content_id"))
    size = F.char_length("text")
    extract = F.when(F.trim("text") == "", "no_text").when(size > TOO_LARGE, "timeout").when(size < TINY, "pending").otherwise("ok")
    out = named.select("content_id", "text", "kind", extract.alias("extract_status"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("content_id"), F.lit(True).alias("embedded"))
    chunks = F.when(F.col("extract_status") == "ok", F.ceil(F.char_length("text") / 1200)).otherwise(0).cast("long")
    both = out.join(vectors, "content_id", "left").withColumn("chunk_count", chunks)
    embed = F.when(F.col("chunk_count") == 0, "not_applicable").when(F.col("embedded"), "done").otherwise("pending")
    return both.withColumn("embed_status", embed).drop("embedded")


#: Chunks of a content are numbered below 2 to this power.
CHUNK_BITS = 20


def chunk_id(content_id, ord_):
    return F.shiftleft(content_id, CHUNK_BITS) + ord_


def content_of(chunk):
    return F.shiftright(chunk, CHUNK_BITS)


def chunk_span(chunk):
    """Sixteen contents side by side, 64 chunks of each."""
    return F.shiftleft(F.shiftright(chunk, CHUNK_BITS + 4), 14) + F.shiftright(chunk.bitwiseAND(F.lit((1 << CHUNK_BITS) - 1)), 6)


def searched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files() with the status that their kind's size cap gives: what may be searched is linked."""
    cap = paths.size_cap(F.lit("text"))
    return files(spark, sf_dir).withColumn("status", F.when(F.col("size") > cap, "skipped").otherwise("linked"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, content_id, ord, text, start, stop) of all contents."""
    made = chunking.chunk(contents(spark, sf_dir).select("content_id", "kind", "text"))
    return made.select(chunk_id(F.col("content_id"), F.col("ord")).alias("id"), "content_id", "ord", "text", "start", "stop")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), F.col("text").alias("query"))


FILES_SQL = f"""sized AS (
    SELECT doc_id AS file_id, '/' || source AS folder, concat_ws('_', source, lang, doc_id::VARCHAR) AS name, lang || '/' || concat_ws('_', source, lang, doc_id::VARCHAR) || '.txt' AS rel_path,
           length(coalesce(text, '')) AS size, doc_id * 1000 AS mtime_ms, lang AS kind, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, ''), lang) AS content_id
    FROM documents),
files AS (SELECT *, folder || '/' || rel_path AS path, CASE WHEN size > {TOO_LARGE} THEN 'skipped' WHEN size < {TINY} THEN 'error' WHEN size < {SHORT} THEN 'pending' ELSE 'linked' END AS status FROM sized),
contents0 AS (
    SELECT content_id, text, kind, CASE WHEN trim(text) = '' THEN 'no_text' WHEN size > {TOO_LARGE} THEN 'timeout' WHEN size < {TINY} THEN 'pending' ELSE 'ok' END AS extract_status
    FROM files WHERE file_id = content_id),
contents1 AS (SELECT *, CASE WHEN extract_status = 'ok' THEN ceil(length(text) / 1200.0)::BIGINT ELSE 0 END AS chunk_count FROM contents0),
contents AS (
    SELECT c.*, CASE WHEN chunk_count = 0 THEN 'not_applicable' WHEN e.vec_id IS NOT NULL THEN 'done' ELSE 'pending' END AS embed_status
    FROM contents1 c LEFT JOIN embeddings e ON e.vec_id = c.content_id),
live AS (SELECT DISTINCT content_id FROM files WHERE status = 'linked')"""

_S = chunking.PROSE
_HALF, _END = _S.target // 2, """[.!?]["'')\\]]?\\s+"""
_CUT = f"""CASE WHEN s + {_S.target} >= e THEN e ELSE coalesce(
        nullif(s + {_HALF} + length(regexp_extract(text[s + {_HALF + 1}:s + {_S.target}], '(?s)^.*{_END}')), s + {_HALF}),
        nullif(s + {_HALF + 1} + length(regexp_extract(text[s + {_HALF + 2}:s + {_S.target + 1}], '(?s)^.* ')), s + {_HALF + 1}), least(s + {_S.most}, e)) END"""
#: Chunks of contents without blank lines, as the driver's are: WITH RECURSIVE, after a relation contents (content_id, text).
CHUNKS_SQL = f"""body AS (SELECT content_id, text, length(regexp_extract(text, '^\\s*')) AS s, length(regexp_replace(text, '\\s+$', '')) AS e FROM contents),
piece AS (
    SELECT content_id, 0 AS n, s AS a, CASE WHEN e - s > {_S.most} THEN {_CUT} ELSE e END AS b, e FROM body WHERE e > s
    UNION ALL
    SELECT content_id, n, s AS a, {_CUT} AS b, e
    FROM (SELECT p.content_id, n + 1 AS n, p.e, text, greatest(a + 1, coalesce(nullif(b - {_S.overlap} + length(regexp_extract(text[b - {_S.overlap - 1}:b], '(?s)^.*?{_END}')), b - {_S.overlap}), b)) AS s
          FROM piece p JOIN contents USING (content_id) WHERE b < p.e)),
trimmed AS (
    SELECT content_id, n, a + length(regexp_extract(t, '^\\s*')) AS a, a + length(regexp_replace(t, '\\s+$', '')) AS b FROM (SELECT piece.*, text[a + 1:b] AS t FROM piece JOIN contents USING (content_id))),
cuts AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb, lead(a) OVER w AS na, lead(b) OVER w AS nb FROM trimmed WHERE b > a WINDOW w AS (PARTITION BY content_id ORDER BY n)),
spans AS (
    SELECT content_id, row_number() OVER (PARTITION BY content_id ORDER BY a) - 1 AS ord, a AS start, CASE WHEN nb - na < {_S.least} AND nb - a <= {_S.most} AND na <= b + 4 THEN greatest(b, nb) ELSE b END AS stop
    FROM cuts WHERE NOT coalesce(b - a < {_S.least} AND b - pa <= {_S.most} AND a <= pb + 4, false)),
chunks AS (SELECT content_id * {1 << CHUNK_BITS} + ord AS id, content_id, ord, start, stop, text[start + 1:stop] AS text FROM spans JOIN contents USING (content_id))"""
