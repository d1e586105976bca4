"""Recent searches, ask history, restart policy and debounced events, over keyed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECENT, HISTORY = 5, 50
#: How long a search has to stand before it counts as one.
REST_MS = 1500


def micros(ts: Column) -> Column:
    """Microseconds since 1970 on the timestamp's own clock, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def recent_searches(searches: DataFrame, k: int = RECENT) -> DataFrame:
    """(user, query, place): newest first; an entry goes if a later one begins with it. searches: (user, ts, query)."""
    rows = searches.withColumn("query", F.trim("query")).where("query <> ''").withColumn("low", F.lower("query"))
    latest = rows.groupBy("user", "low").agg(F.max_by("query", "ts").alias("query"), F.max("ts").alias("ts"))
    # every entry names its beginnings, of the lengths that the user's entries have, and equal ones meet
    sized = latest.withColumn("n", F.char_length("low"))
    lengths = sized.select("user", F.col("n").alias("upto")).distinct()
    longer = sized.join(lengths, "user").where(F.col("upto") < F.col("n")).groupBy("user", F.left("low", F.col("upto")).alias("low")).agg(F.max("ts").alias("later"))
    kept = latest.join(longer, ["user", "low"], "left").where("later is null or later <= ts")
    order = Window.partitionBy("user").orderBy(F.desc("ts"), "low")
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("user", "query", "place")


def rested(searches: DataFrame, rest_ms: int = REST_MS) -> DataFrame:
    """Those of searches (user, at_ms, query, n_results, opened_ms) that have results and stood for rest_ms before the user typed on, or of which a result was opened by then.

    Half-typed steps of a search are gone then; recent_searches() takes what is left. The latest search of a user has stood, since nothing followed.
    """
    following = F.lead("at_ms").over(Window.partitionBy("user").orderBy("at_ms", "query"))
    rows = searches.withColumn("next_ms", following)
    stood = F.col("next_ms").isNull() | (F.col("next_ms") - F.col("at_ms") >= rest_ms)
    opened = F.col("opened_ms").isNotNull() & (F.col("next_ms").isNull() | (F.col("opened_ms") <= F.col("next_ms")))
    return rows.where((F.col("n_results") > 0) & (stood | opened)).drop("next_ms")


def _is(value: Column, path: str, kind: str) -> Column:
    """Whether what a JSON value has at a path is of a kind, as a pattern of type names; not so where it has nothing there."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(value, path, "variant")).rlike(f"^({kind})"), F.lit(False))


NUMBER, TEXT, FLAG, LIST = "BIGINT|DOUBLE|FLOAT|DECIMAL", "STRING$", "BOOLEAN$", "ARRAY"


def _all(value: Column, path: str, holds) -> Column:
    return _is(value, path, LIST) & F.coalesce(F.forall(F.try_variant_get(value, path, "array<variant>"), holds), F.lit(False))


def is_ask_entry(entry: Column) -> Column:
    """Whether a JSON value is a whole entry of the ask history, each of its fields, sources and numbers of the right type."""

    def is_source(s: Column) -> Column:
        place = F.try_variant_get(s, "$.location", "variant").isNull() | _is(s, "$.location", TEXT)
        return _is(s, "$.n", NUMBER) & _is(s, "$.fileId", NUMBER) & _is(s, "$.name", TEXT) & place & _is(s, "$.snippet", TEXT)

    fields = _is(entry, "$.insufficient", FLAG) & _is(entry, "$.at", NUMBER)
    for name in ("id", "question", "answer", "model"):
        fields &= _is(entry, f"$.{name}", TEXT)
    return fields & _all(entry, "$.sources", is_source) & _all(entry, "$.invalidCitations", lambda n: _is(n, "$", NUMBER))


def parsed_ask_history(rows: DataFrame, json: Column, *keys: str, k: int = HISTORY) -> DataFrame:
    """(keys, place, entry) of the first k whole entries in stored histories, JSON texts; the other entries are left out one by one. What isn't JSON, or no list, has none."""
    whole = F.try_variant_get(F.try_parse_json(json), "$", "array<variant>")
    kept = F.slice(F.filter(whole, is_ask_entry), 1, k)
    return rows.select(*keys, F.posexplode(kept).alias("place", "entry")).withColumn("place", F.col("place") + 1)


def settings(json: Column, flags: dict[str, bool], choices: dict[str, tuple[str, ...]]) -> Column:
    """struct of flags and choices (the first of each is its default) from a JSON text: known names with values of the right type, else defaults."""
    raw = F.try_parse_json(json)
    fields = [F.when(_is(raw, f"$.{n}", FLAG), F.try_variant_get(raw, f"$.{n}", "boolean")).otherwise(default).alias(n) for n, default in flags.items()]
    for name, allowed in choices.items():
        said = F.when(_is(raw, f"$.{name}", TEXT), F.try_variant_get(raw, f"$.{name}", "string"))
        fields.append(F.when(said.isin(*allowed), said).otherwise(allowed[0]).alias(name))
    return F.struct(*fields)


def ask_history(entries: DataFrame, k: int = HISTORY) -> DataFrame:
    """The newest version of each id of a user, newest first, k at most. entries: (user, id, ts, question)."""
    newest = entries.groupBy("user", "id").agg(F.max_by("question", "ts").alias("question"), F.max("ts").alias("ts"))
    order = Window.partitionBy("user").orderBy(F.desc("ts"), F.desc("id"))
    return newest.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def restart_policy(crashes: DataFrame, seconds: int = 300, most: int = 3) -> DataFrame:
    """(key, ts, recent, gives_up, wait): crashes of the last five minutes; more than `most` give up, else the wait grows with them."""
    at = micros(F.col("ts"))
    window = Window.partitionBy("key").orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    recent = F.count("*").over(window)
    return crashes.withColumn("recent", recent).select("key", "ts", "recent", (F.col("recent") > most).alias("gives_up"), F.when(F.col("recent") <= most, F.col("recent")).alias("wait"))


def debounced(events: DataFrame, gap: str = "1500 milliseconds") -> DataFrame:
    """(key, start, stop, n, last): runs of events with less than the gap between them. For batches and streams alike."""
    return events.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max_by("value", F.struct("ts", "value")).alias("last")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "last")


def coalesced(events: DataFrame, width: str = "400 milliseconds") -> DataFrame:
    """The last event of each tumbling window of a key."""
    return events.groupBy("key", F.window("ts", width).alias("w")).agg(F.max_by("value", F.struct("ts", "value")).alias("last"), F.count("*").alias("n")).select("key", F.col("w.start").alias("start"), "last", "n")


def superseded(requests: DataFrame) -> DataFrame:
    """The latest request of each session; earlier ones are dropped."""
    return requests.groupBy("session").agg(F.max_by(F.struct("request_id", "query"), F.struct("ts", "request_id")).alias("r")).select("session", "r.request_id", "r.query")
