"""Voice streams, streamed answers and the store's smaller rules over the driver's tables, as batches, with their SQL.

Events are minutes apart, so windows here are minutes long. Users stand for devices, and kinds of events for what a device does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import ask, history, store
from quern.plans import model, store_queries
from quern.streaming import session

WINDOW_MS, SETTLE_MS, IDLE_MS, DELAY, PIECE = 40 * 60_000, 5 * 60_000, 30 * 60_000, 8, 5


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, event_type, value, props, at_ms)"""
    return model.table(spark, sf_dir, "events").withColumn("at_ms", F.floor(history.micros(F.col("ts")) / 1000)).drop("ts")


def _utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as utterances, as long as they are worth."""
    clicks = _events(spark, sf_dir).where("event_type = 'click'")
    return clicks.select(F.col("user_id").alias("device"), F.col("at_ms").alias("start_ms"), (F.col("at_ms") + F.floor(F.coalesce("value", F.lit(0.0)) * 100)).alias("stop_ms"), F.col("event_id").cast("string").alias("text"))


def wake_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    wakes = _events(spark, sf_dir).where("event_type = 'view'").select(F.col("user_id").alias("device"), "at_ms")
    return session.requests(wakes, _utterances(spark, sf_dir), WINDOW_MS, SETTLE_MS)


def second_chances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.second_chances(_utterances(spark, sf_dir))


def transcripts_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces that take as long as their events are worth."""
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("device"), F.col("event_id").alias("seq"), (F.col("at_ms") + F.floor(F.coalesce("value", F.lit(0.0)) * 1_000_000)).alias("done_ms"), F.col("event_type").alias("text"))
    return session.in_order(rows)


def loaded_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.loaded_spans(_events(spark, sf_dir).select(F.col("event_type").alias("model"), "at_ms"), IDLE_MS)


def spotter_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as frames, errors as speech."""
    frames = _events(spark, sf_dir).select(F.col("user_id").alias("stream"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("seq"), (F.col("event_type") == "error").alias("speech"))
    return session.reset_frames(frames, DELAY)


def shown_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as answers in pieces, one of three behind the marker and one behind its beginning."""
    turns = model.table(spark, sf_dir, "conversations").where("text is not null")
    lead = F.when(F.col("turn") % 3 == 0, f"{ask.NO_EVIDENCE} ").when(F.col("turn") % 3 == 1, f"  {ask.NO_EVIDENCE[:10]} tea ").otherwise("")
    said = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ask_id"), F.concat(lead, "text").alias("said"))
    pieces = F.regexp_extract_all("said", F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    return ask.shown_tokens(said.select("ask_id", F.posexplode(pieces).alias("seq", "token")))


def response_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that have a vector of their number are asked by meaning too."""
    vectors = model.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return model.queries(spark, sf_dir).join(vectors, "query_id", "left").select("query_id", text.response_mode(F.col("embedding")).alias("mode"))


def valid_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions by the kind of event, with the number of its properties; null where they aren't valid."""
    k = F.get_json_object("props", "$.k")
    raw = (
        F.when(F.col("event_type") == "click", F.concat(F.lit('{"type":"select","index":'), k, F.lit("}"))).when(F.col("event_type") == "view", F.concat(F.lit('{"type":"resize","height":'), k, F.lit("0.5}")))
        .when(F.col("event_type") == "error", '{"type":"dismiss"').when(F.col("event_type") == "signup", F.concat(F.lit('{"type":"open_source","file_id":'), k, F.lit("}"))).otherwise('{"type":"reveal"}')
    )
    made = _events(spark, sf_dir).select("event_id", text.valid_action(raw).alias("a"))
    return made.select("event_id", "a.type", "a.index", "a.file_id", "a.height")


def embedded_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of even number have vectors for all their chunks, of odd number for none."""
    chunks = model.chunks(spark, sf_dir).select(F.col("id").alias("chunk_id"), "content_id")
    return store.embedded_contents(model.contents(spark, sf_dir), chunks, chunks.where("content_id % 2 = 0")).select("content_id")


def failure_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store_queries.failure_reasons(spark, sf_dir).join(model.files(spark, sf_dir).select("file_id", "name"), "file_id")
    return store.failures(rows.select("file_id", "name", "reason"))


def settings_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last kind of event of each user; of those with a purchase the number of purchases in its place."""
    rows = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), "event_id", "event_type")
    settings = rows.groupBy("key").agg(F.max_by("event_type", "event_id").alias("value"))
    fresh = rows.where("event_type = 'purchase'").groupBy("key").agg(F.count("*").cast("string").alias("value"))
    return store.upsert_settings(settings, fresh)


def folder_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of sources and languages are known; added are sources, what is inside of some, and others."""
    docs = model.table(spark, sf_dir, "documents").where("source is not null and lang is not null").select("source", "lang", F.col("doc_id") % 4)
    docs = docs.distinct().toDF("source", "lang", "n")
    roots = docs.select(F.concat_ws("/", F.lit(""), "source", "lang").alias("path")).distinct()
    added = F.when(F.col("n") == 0, F.concat(F.lit("/"), F.upper("source"))).when(F.col("n") == 1, F.concat_ws("/", F.lit(""), "source", "lang")).when(F.col("n") == 2, F.concat_ws("/", F.lit(""), "source", "lang", F.lit("deep"))).otherwise(F.concat(F.lit("/"), "source", F.lit("x")))
    return store.overlapping_roots(roots, docs.select(added.alias("path")).distinct())


def folder_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left without the first folder: contents, and how many files each has."""
    files = model.files(spark, sf_dir)
    first = files.agg(F.min("folder")).first()[0] or ""
    contents = model.contents(spark, sf_dir).select("content_id").withColumn("orphaned_at", F.lit(None).cast("long"))
    left, kept = store.remove_folder(files, contents, first)
    return kept.select("content_id").join(left.groupBy("content_id").agg(F.count("*").alias("files")), "content_id")


def changed_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, listing = store_queries._snapshot(spark, sf_dir)
    return store.changed_since(old, listing)


FLAGS, CHOICES = {"enabled": False, "muted": False, "readAloud": True}, {"sensitivity": ("balanced", "strict", "loose")}
REST_MS, MOST_PIECE = 10 * 60_000, 3


def history_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as stored histories: of seven turns one has no time, one a source without a snippet, one a citation that is a word; of eleven histories one isn't closed."""
    turns = model.table(spark, sf_dir, "conversations")
    n = F.col("turn") % 7
    source = F.struct(F.col("turn").alias("n"), F.col("conv_id").alias("fileId"), F.lit("a.txt").alias("name"), F.when(n == 3, "p. 1").alias("location"), F.when(n != 1, "s").alias("snippet"))
    entry = F.to_json(F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("question"), F.col("role").alias("answer"), F.array(source).alias("sources"), (n == 4).alias("insufficient"),
        F.array(F.when(n == 2, '"word"').otherwise("7").alias("x")).alias("invalidCitations"), F.lit("m").alias("model"), F.when(n != 0, F.col("turn") + 0.5).alias("at"),
    ))
    entry = F.replace(F.replace(entry, F.lit('["7"]'), F.lit("[7]")), F.lit('["\\"word\\""]'), F.lit('["word"]'))
    listed = turns.select("conv_id", "turn", entry.alias("entry")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "entry"))), lambda t: t["entry"]), ",").alias("entries"))
    json = F.concat(F.lit("["), "entries", F.when(F.col("conv_id") % 11 == 0, "").otherwise("]"))
    found = history.parsed_ask_history(listed, json, "conv_id")
    return found.select("conv_id", "place", F.try_variant_get("entry", "$.id", "string").alias("id"), F.sha2(F.try_variant_get("entry", "$.question", "string"), 256).alias("question"))


def voice_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings with the number of an event's properties in them: flags that are words, choices that there aren't, texts that end early."""
    k = F.get_json_object("props", "$.k").cast("long")
    enabled = F.when(k % 3 == 0, "true").when(k % 3 == 1, '"true"').otherwise("1")
    choice = F.when(k % 4 == 0, '"strict"').when(k % 4 == 1, '"loud"').otherwise("[]")
    raw = F.concat(F.lit('{"enabled":'), enabled, F.lit(',"readAloud":false,"other":true,"sensitivity":'), choice, F.when(k % 5 == 0, "").otherwise("}"))
    return _events(spark, sf_dir).select("event_id", history.settings(raw, FLAGS, CHOICES).alias("s")).select("event_id", "s.*")


def rested_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as searches with as many results as they are worth; a click opens one a minute later."""
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("user"), "at_ms", F.col("event_id").cast("string").alias("query"), F.floor(F.coalesce("value", F.lit(0.0)) / 20).alias("n_results"), F.when(F.col("event_type") == "click", F.col("at_ms") + 60_000).alias("opened_ms"))
    return history.rested(rows, REST_MS).select("user", "at_ms", "query")


def utterance_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as frames, loud where they are worth something; pieces of three frames at most."""
    frames = _events(spark, sf_dir).select(F.col("user_id").alias("stream"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("seq"), F.coalesce("value", F.lit(0.0)).alias("level"))
    return session.utterance_runs(frames, 30.0, 1, 1, MOST_PIECE)


_E = "e AS (SELECT user_id, event_id, event_type, value, json_extract_string(props, '$.k') AS k, epoch_us(ts) // 1000 AS t_ms FROM events)"
_U = f"{_E}, u AS (SELECT user_id AS device, t_ms AS start_ms, t_ms + floor(coalesce(value, 0) * 100)::BIGINT AS stop_ms, event_id::VARCHAR AS text FROM e WHERE event_type = 'click')"
SQL = {
    "wake_requests": f"""WITH {_U}, w AS (SELECT user_id AS device, t_ms FROM e WHERE event_type = 'view')
        SELECT device, start_ms, stop_ms, text, max(t_ms) AS wake_ms FROM u JOIN w USING (device) WHERE start_ms BETWEEN t_ms - {SETTLE_MS} AND t_ms + {WINDOW_MS} GROUP BY ALL""",
    "second_chances": f"WITH {_U} SELECT * FROM u WHERE stop_ms - start_ms BETWEEN {session.LONE_WORD_MS[0]} AND {session.LONE_WORD_MS[1]}",
    "transcripts_in_order": f"""WITH {_E}, p AS (SELECT user_id AS device, event_id AS seq, t_ms + floor(coalesce(value, 0) * 1000000)::BIGINT AS done_ms, event_type AS text FROM e)
        SELECT *, max(done_ms) OVER (PARTITION BY device ORDER BY seq ROWS UNBOUNDED PRECEDING) AS ready_ms FROM p""",
    "loaded_models": f"""WITH {_E}, g AS (SELECT event_type AS model, t_ms, coalesce(t_ms - lag(t_ms) OVER w > {IDLE_MS}, true) AS new FROM e WINDOW w AS (PARTITION BY event_type ORDER BY t_ms)),
        s AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY model ORDER BY t_ms RANGE UNBOUNDED PRECEDING) AS span FROM g)
        SELECT model, min(t_ms) AS start_ms, max(t_ms) + {IDLE_MS} AS stop_ms, count(*) AS uses FROM s GROUP BY model, span""",
    "spotter_resets": f"""WITH {_E}, f AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_type = 'error' AS speech FROM e),
        l AS (SELECT *, max(seq) FILTER (speech) OVER (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING) AS last FROM f) SELECT stream, seq::INTEGER AS seq FROM l WHERE NOT speech AND seq - last = {DELAY}""",
    "shown_tokens": f"""WITH s AS (SELECT conv_id * 1000 + turn AS ask_id, CASE turn % 3 WHEN 0 THEN '{ask.NO_EVIDENCE} ' WHEN 1 THEN '  {ask.NO_EVIDENCE[:10]} tea ' ELSE '' END || text AS said FROM conversations WHERE text IS NOT NULL),
        p AS (SELECT *, unnest(range(0, (length(said) + {PIECE - 1}) // {PIECE})) AS seq FROM s)
        SELECT ask_id, seq::INTEGER AS seq, said[seq * {PIECE} + 1:(seq + 1) * {PIECE}] AS token, starts_with('{ask.NO_EVIDENCE}', ltrim(said[1:(seq + 1) * {PIECE}])[1:{len(ask.NO_EVIDENCE)}]) AS held FROM p""",
    "response_modes": "SELECT item_id::BIGINT AS query_id, CASE WHEN embedding IS NULL THEN 'keyword' ELSE 'hybrid' END AS mode FROM benchmark LEFT JOIN embeddings ON vec_id = item_id::BIGINT",
    "valid_actions": f"""WITH {_E} SELECT event_id, CASE WHEN event_type = 'click' AND k::INTEGER <= 10 THEN 'select' WHEN event_type = 'view' AND k <> '0' THEN 'resize' WHEN event_type = 'signup' AND k IS NOT NULL THEN 'open_source' WHEN event_type = 'purchase' THEN 'reveal' END AS type,
        CASE WHEN event_type = 'click' AND k::INTEGER <= 10 THEN k::INTEGER END AS index, CASE WHEN event_type = 'signup' THEN k::BIGINT END AS file_id, CASE WHEN event_type = 'view' AND k <> '0' THEN least(ceil((k || '0.5')::DOUBLE), 480)::INTEGER END AS height FROM e""",
    "embedded_contents": f"WITH RECURSIVE {model.FILES_SQL}, {model.CHUNKS_SQL} SELECT content_id FROM contents WHERE extract_status = 'ok' AND embed_status = 'pending' AND (content_id % 2 = 0 OR content_id NOT IN (SELECT content_id FROM chunks))",
    "failure_list": f"""WITH {model.FILES_SQL}, r AS (
        SELECT file_id, name, CASE WHEN status = 'skipped' THEN 'skipped: too large' WHEN status = 'error' THEN 'unreadable: too short' WHEN extract_status NOT IN ('ok', 'pending') THEN 'not extracted: ' || extract_status WHEN embed_status = 'failed' THEN 'not embedded' END AS reason
        FROM files LEFT JOIN contents USING (content_id)) SELECT * FROM r WHERE reason IS NOT NULL ORDER BY name, file_id LIMIT 500""",
    "settings_upsert": "SELECT user_id::VARCHAR AS key, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN (count(*) FILTER (event_type = 'purchase'))::VARCHAR ELSE arg_max(event_type, event_id) END AS value FROM events GROUP BY user_id",
    "folder_overlaps": """WITH d AS (SELECT DISTINCT source, lang, doc_id % 4 AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL), r AS (SELECT DISTINCT lower('/' || source || '/' || lang) AS known FROM d),
        a AS (SELECT DISTINCT CASE n WHEN 0 THEN '/' || upper(source) WHEN 1 THEN '/' || source || '/' || lang WHEN 2 THEN '/' || source || '/' || lang || '/deep' ELSE '/' || source || 'x' END AS path FROM d)
        SELECT path, known, CASE WHEN known = lower(path) THEN 'same' WHEN starts_with(lower(path), known || '/') THEN 'inside' ELSE 'absorbs' END AS verdict FROM a, r WHERE known = lower(path) OR starts_with(lower(path), known || '/') OR starts_with(known, lower(path) || '/')""",
    "folder_removed": f"WITH {model.FILES_SQL} SELECT content_id, count(*) AS files FROM files WHERE folder <> (SELECT min(folder) FROM files) GROUP BY content_id",
    "history_parsed": """SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INTEGER AS place, conv_id || '-' || turn AS id, sha256(text) AS question FROM conversations
        WHERE text IS NOT NULL AND role IS NOT NULL AND turn % 7 NOT IN (0, 1, 2) AND conv_id % 11 <> 0 QUALIFY place <= 50""",
    "voice_settings": f"""WITH {_E} SELECT event_id, coalesce(k::BIGINT % 3 = 0 AND k::BIGINT % 5 <> 0, false) AS enabled, false AS muted, coalesce(k::BIGINT % 5 = 0, true) AS "readAloud",
        CASE WHEN k::BIGINT % 4 = 0 AND k::BIGINT % 5 <> 0 THEN 'strict' ELSE 'balanced' END AS sensitivity FROM e""",
    "rested_searches": f"""WITH {_E}, n AS (SELECT user_id AS user, t_ms AS at_ms, event_id::VARCHAR AS query, floor(coalesce(value, 0) / 20) AS found, event_type, lead(t_ms) OVER (PARTITION BY user_id ORDER BY t_ms, event_id::VARCHAR) AS next FROM e)
        SELECT user, at_ms, query FROM n WHERE found > 0 AND (next IS NULL OR next - at_ms >= {REST_MS} OR (event_type = 'click' AND at_ms + 60000 <= next))""",
    "utterance_pieces": f"""WITH {_E}, f AS (SELECT user_id AS stream, (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INTEGER AS seq, coalesce(value, 0) AS level FROM e),
        i AS (SELECT *, seq - row_number() OVER (PARTITION BY stream ORDER BY seq) AS island FROM f WHERE level >= 30), r AS (SELECT stream, min(seq) AS low, max(seq) AS high FROM i GROUP BY stream, island)
        SELECT stream, first::INTEGER AS first, least(high, first + {MOST_PIECE - 1})::INTEGER AS last FROM (SELECT *, unnest(range(low, high + 1, {MOST_PIECE})) AS first FROM r)""",
    "changed_since": f"{store_queries.MERGED} SELECT path_key, coalesce(o.old_size <> l.size OR o.old_mtime <> l.mtime_ms, true) AS changed FROM old o LEFT JOIN listing l USING (path_key)",
}
QUERIES = {name: globals()[name] for name in SQL}
