"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source's target over its size is the expected number of copies of its words. The whole part is taken for certain, of every
document; what is left of the target is drawn. The inclusion probability of a document goes with the
TILT-th power of its size, up to one, such that the expected words are those left: whole texts are repeated rather than
scraps. Documents are ranked by the odds of a uniform number, drawn from id and text, over their inclusion odds. The sample,
of a fixed size in words, is filled down that ranking: a document that doesn't fit into what is left is passed over.

The ranking is never sorted in one place. A rank is RANK_BITS bits, behind which a number of the row parts equal ranks; places are read digit by digit:
word counts by the next digit are summed up before the shuffle, and only the digit in which a budget ends is looked into further, until it
holds NEAR words at most. These are filled document by document, whatever the size of the corpus and however many rows are alike.
The result is a short list of runs for each source: in a run all documents of at most so many words are taken.
Runs decide about documents in one narrow pass, in which no text moves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import BROADCAST_ROWS, WORD, column, cut, free_name, parts, small, table, tidy, whole_row

#: Values of a digit, and the words that are filled document by document.
BUCKETS, NEAR = 1 << 14, 1 << 16
RANK_BITS = 52
#: What stands behind each digit: four of the rank, then five of the row's number.
SHIFTS = (38, 24, 10, 0, 49, 35, 21, 7, 0)
OF_RANK = 4
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
#: Power of its size that a document's inclusion probability goes with.
TILT = 0.5
#: A place in the ranking. Runs end before a place; their limit is in words.
PLACE = "struct<rank:long,row:long>"
RUNS = f"array<struct<most:long,stop:{PLACE}>>"
#: Behind all places.
LAST = 1 << 62


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of rows (source, source_size): one row a source, so the only single-task step is as long as the list of sources.

    Weights repeat over the sources by code point, null last. A target is weight * level but at most
    `most` times the source; the level shares out `share` of all words. Sources are filled up in the order in
    which a rising level caps them, so the level after k caps is (budget - capped) / (weights left).
    """
    cap = F.col("source_size") * F.lit(most)
    named = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        named.withColumn("total", F.sum("source_size").over(whole)).withColumn("all_w", F.sum("w").over(whole))
        .withColumn("capped", F.coalesce(F.sum(cap).over(order), F.lit(0.0))).withColumn("capped_w", F.coalesce(F.sum("w").over(order), F.lit(0.0)))
        .withColumn("level", (F.col("total") * share - F.col("capped")) / (F.col("all_w") - F.col("capped_w")))
        .withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= cap, F.col("level"))).over(whole))
    )
    return levels.select("source", "source_size", F.least(cap, F.coalesce(F.col("level") * F.col("w"), cap)).alias("target"))


def uniform(key: Column, seed: str) -> Column:
    """A number inside (0, 1) from 52 bits of an MD5, the same on every engine and rerun."""
    return (F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(seed))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """docs with id, source, size, u and row, which are named in `__mix`, a struct."""
    size = F.coalesce(F.regexp_count(column(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    drawn = F.concat_ws(":", F.coalesce(column(id_col).cast("string"), F.lit("null")), F.md5(F.coalesce(column(text_col), F.lit("")).cast("binary")))
    return docs.withColumn(free_name(docs, "__mix"), F.struct(column(id_col).alias("id"), column(source_col).alias("source"), size.alias("size"), uniform(drawn, seed).alias("u"), F.monotonically_increasing_id().alias("row")))


def _levels(base: DataFrame, sources: DataFrame) -> DataFrame:
    """(s, level): a document's inclusion probability is level * size ** TILT, up to 1, of sizes that fit the budget.

    Sizes are filled up from the largest, as it is the first to reach 1: with those above at 1, the level shares out
    the rest. One row for each size of a source is all that is compared. No level where all documents fit.
    """
    sizes = _of_source(base, sources).where("size > 0 and size <= budget").groupBy("source", "size").agg(F.count("*").alias("n"), F.first("budget").alias("budget"))
    upto = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    tilted = F.sum(F.pow(F.col("size").cast("double"), F.lit(TILT)) * F.col("size") * F.col("n")).over(upto)
    level = (F.col("budget") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(above), F.lit(0))) / tilted
    fits = sizes.withColumn("level", level).where(F.col("level") * F.pow(F.col("size").cast("double"), F.lit(TILT)) <= 1)
    return fits.groupBy(F.col("source").alias("s")).agg(F.max_by("level", "size").alias("level"))


def _ranked(base: DataFrame, sources: DataFrame) -> DataFrame:
    """base with the columns of its source and its place in the ranking, null for what can't be drawn."""
    p = F.least(F.lit(1.0), F.coalesce(F.col("level") * F.pow(F.col("size").cast("double"), F.lit(TILT)), F.lit(1.0)))
    odds = F.when(p >= 1, 0.0).otherwise(F.col("u") / (1 - F.col("u")) / (p / (1 - p)))
    rank = F.floor(odds / (1 + odds) * float(1 << RANK_BITS))
    both = _of_source(base, sources)
    return both.withColumn("place", F.when((F.col("size") > 0) & (F.col("size") <= F.col("budget")), F.struct(rank.cast("long").alias("rank"), "row")))


def _place(rank: Column, row: Column) -> Column:
    return F.struct(rank.cast("long").alias("rank"), row.cast("long").alias("row"))


def _digit(place: Column) -> Column:
    """Which value of its next digit, from the source's place `at` on, a place has; BUCKETS is what lies beyond the last."""
    at, digit = F.col("at"), F.col("digit")
    of = lambda x, first, last: F.coalesce(*(F.when(digit == i, F.shiftright(x, SHIFTS[i])) for i in range(first, last)))
    rank, row = of(place["rank"] - at["rank"], 0, OF_RANK), of(place["row"] - at["row"], OF_RANK, len(SHIFTS))
    return F.least(F.lit(BUCKETS).cast("long"), F.when(digit < OF_RANK, rank).when(place["rank"] == at["rank"], row).otherwise(BUCKETS))


def _start(bucket: Column) -> Column:
    """The first place of a value of the next digit."""
    at, digit = F.col("at"), F.col("digit")
    width = F.coalesce(*(F.when(digit == i, F.lit(1 << shift).cast("long")) for i, shift in enumerate(SHIFTS)))
    return F.when(bucket == 0, at).when(digit < OF_RANK, _place(at["rank"] + bucket * width, F.lit(0))).otherwise(_place(at["rank"], at["row"] + bucket * width))


def _runs(ranked: DataFrame, sources: DataFrame) -> DataFrame:
    """(s, runs) of each source. A round counts words by the next digit of each source's place, and moves the place to where its budget ends.

    There the digit is looked into (narrow), or is filled if it holds few words or no further digit is left; sources whose rest fits are done.
    """
    hint = F.broadcast if sources.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lambda df: df
    first = _place(F.lit(0), F.lit(0))
    state, done = cut(sources.select("s", F.col("budget").alias("gap"), first.alias("at"), F.lit(0).alias("digit"), F.array().cast(RUNS).alias("runs"))), []
    drawn = ranked.where("place is not null").select("source", "size", "place")

    def run(most: Column, stop: Column) -> Column:
        return F.concat("runs", F.array(F.struct(most.cast("long").alias("most"), stop.alias("stop"))))

    while True:
        open_ = drawn.join(hint(state.select("s", "gap", "at", "digit")), F.col("source").eqNullSafe(F.col("s"))).where("size <= gap and place >= at")
        words = cut(open_.groupBy("s", _digit(F.col("place")).alias("bucket")).agg(F.sum("size").alias("words")))
        upto = words.join(hint(state), words["s"].eqNullSafe(state["s"])).select(words["s"], "bucket", "words", "gap", "digit", F.sum("words").over(Window.partitionBy(words["s"]).orderBy("bucket")).alias("upto"))
        ends = upto.where("upto > gap").groupBy("s").agg(F.min_by(F.struct("bucket", "words", "upto"), "bucket").alias("end")).withColumnRenamed("s", "t")
        near = upto.join(hint(ends), F.col("s").eqNullSafe(F.col("t"))).where((F.col("bucket") >= F.col("end.bucket")) & ((F.col("bucket") == F.col("end.bucket")) | (F.col("upto") - F.col("end.upto") <= NEAR)) & (F.col("bucket") < BUCKETS))
        last = near.groupBy("t", "end").agg(F.max("bucket").alias("last"))
        both = state.join(hint(ends.join(last.select(F.col("t").alias("l"), "last"), F.col("t").eqNullSafe(F.col("l")), "left").drop("l")), F.col("s").eqNullSafe(F.col("t")), "left")
        few = (F.col("end.words") <= NEAR) | (F.col("digit") == len(SHIFTS) - 1)
        step = F.when(F.col("end").isNull(), "done").when(F.col("end.bucket") == BUCKETS, "beyond").when(few, "fill").otherwise("narrow")
        chosen = cut(both.select("s", "gap", "at", "digit", "runs", F.col("end.bucket").alias("first"), (F.col("end.upto") - F.col("end.words")).alias("before"), "last", step.alias("step")))
        steps = {r[0] for r in chosen.select("step").distinct().collect()}
        done.append(chosen.where("step = 'done'").select("s", run(F.col("gap"), _place(F.lit(LAST), F.lit(0))).alias("runs")))
        if steps <= {"done"}:
            break
        stop = _start(F.col("first"))
        went = chosen.where("step in ('narrow', 'beyond')").select("s", (F.col("gap") - F.col("before")).alias("gap"), stop.alias("at"), F.when(F.col("step") == "narrow", F.col("digit") + 1).otherwise(0).alias("digit"), run(F.col("gap"), stop).alias("runs"))
        state = cut(went.unionByName(_filled(drawn, chosen.where("step = 'fill'"), hint)) if "fill" in steps else went)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return cut(out)


def _filled(drawn: DataFrame, chosen: DataFrame, hint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The state behind the digits first to last, whose documents are filled in one by one."""
    held = chosen.withColumns({"begin": _start(F.col("first")), "stop": _start(F.col("last") + 1)})
    inside = drawn.join(hint(held.select(F.col("s").alias("t"), F.col("gap").alias("least"), "begin", "stop")), F.col("source").eqNullSafe(F.col("t"))).where("size <= least and place >= begin and place < stop")
    close = inside.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("place", "size"))).alias("close"))  # some NEAR words
    begin = F.struct(F.col("gap").cast("long").alias("most"), (F.col("gap") - F.col("before")).cast("long").alias("left"), F.col("runs"))

    def filled(a: Column, x: Column) -> Column:
        passed = F.struct(a["left"].alias("most"), a["left"].alias("left"), F.concat(a["runs"], F.array(F.struct(a["most"].alias("most"), x["place"].alias("stop")))).alias("runs"))
        fits = F.struct(a["most"].alias("most"), (a["left"] - x["size"]).alias("left"), a["runs"].alias("runs"))
        return F.when(x["size"] <= a["left"], fits).when(x["size"] <= a["most"], passed).otherwise(a)

    folded = held.join(hint(close), F.col("s").eqNullSafe(F.col("t"))).select("s", "stop", F.aggregate("close", begin, filled).alias("f"))
    runs = F.concat("f.runs", F.array(F.struct(F.col("f.most").alias("most"), F.col("stop").alias("stop"))))
    return folded.select("s", F.col("f.left").alias("gap"), F.col("stop").alias("at"), F.lit(0).alias("digit"), runs.alias("runs"))


def _decided(base: DataFrame) -> DataFrame:
    """base (id, source, size, u, row) with source_size, target and copies. base is what cut() has written."""
    sources = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = cut(sources.withColumn("certain", F.floor(rate)).withColumn("budget", F.floor(F.col("target") - F.col("certain") * F.col("source_size") + 1e-6)).withColumnRenamed("source", "s"))
    levels = cut(_levels(base, sources)).withColumnRenamed("s", "t")
    sources = cut(sources.join(small(levels), sources["s"].eqNullSafe(levels["t"]), "left").drop("t"))
    ranked = _ranked(base, sources)
    runs = _runs(ranked, sources)
    own = F.get(F.filter("runs", lambda r: F.col("place") < r["stop"]), F.lit(0))
    drawn = F.coalesce(F.col("size") <= own["most"], F.lit(False))
    return _of_source(ranked, runs).withColumn("copies", F.col("certain") + drawn.cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = ":mix") -> DataFrame:
    """(id_col, source, size, source_size, target, copies, taken) of every row; size is in words.

    Null and empty texts have size 0 and get the certain copies only. A null source is a source of its own.
    Repeated rows and null ids draw by their text; of rows alike in id and text it is left open which of them are taken,
    so the rows returned are the same in each run. Empty tables give no rows; where all sizes are 0 all targets are 0.
    A text longer than what is left of its source's budget gets its certain copies only.
    """
    sized = _sized(docs, id_col, text_col, source_col, seed)
    found = _decided(cut(sized.select(f"{sized.columns[-1]}.*")))
    return found.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _of_source(rows: DataFrame, sources: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the columns of sources, which has one row for each source (s)."""
    return rows.join(small(sources), rows["source"].eqNullSafe(sources["s"]), how).drop("s")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = ":mix") -> DataFrame:
    """docs, each row as often as mix() takes it: nulls, empty texts, repeated rows and empty tables as there.

    Texts are written once, with their sizes, and read once more; they are never shuffled. Columns may have any names.
    """
    held = cut(_sized(docs, id_col, text_col, source_col, seed))
    base = held.select(f"{held.columns[-1]}.*", whole_row(docs.columns).alias("whole"))
    # only the narrow passes that need whole rows read them
    return _decided(base).select(F.explode(F.array_repeat("whole", F.col("copies").cast("int"))).alias("whole")).select(*parts(docs.columns))


@tidy
def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    """mix() of all documents; the cases are those of mix()."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')) || ':mix'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
    FROM documents),
s AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w FROM s),
l AS (
    SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS level
    FROM w WINDOW p AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
    SELECT source, source_size, least(source_size * 2.0::DOUBLE, coalesce((SELECT max(level) FROM l AS m WHERE m.level * m.w <= m.source_size * 2.0::DOUBLE) * w, source_size * 2.0::DOUBLE)) AS target FROM l),
r AS (
    SELECT *, floor(rate) AS certain, floor(target - floor(rate) * source_size + 1e-6::DOUBLE)::BIGINT AS budget
    FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)),
j AS (SELECT d.*, r.source_size, target, certain, budget, size > 0 AND size <= budget AS drawn FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
h AS (SELECT source, size, count(*) AS n, any_value(budget) AS budget FROM j WHERE drawn GROUP BY source, size),
v AS (
    SELECT source, size, (budget - coalesce(sum(size * n) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                         / sum(sqrt(size::DOUBLE) * size * n) OVER (PARTITION BY source ORDER BY size ROWS UNBOUNDED PRECEDING) AS level FROM h),
c AS (SELECT source, arg_max(level, size) AS level FROM v WHERE level * sqrt(size::DOUBLE) <= 1 GROUP BY source),
k AS (
    SELECT *, floor(odds / (1 + odds) * 4503599627370496.0) AS rank
    FROM (SELECT *, CASE WHEN NOT drawn THEN NULL WHEN p >= 1 THEN 0.0::DOUBLE ELSE u / (1 - u) / (p / (1 - p)) END AS odds FROM (SELECT j.*, least(1, coalesce(level * sqrt(size::DOUBLE), 1)) AS p FROM j LEFT JOIN c ON j.source IS NOT DISTINCT FROM c.source))),
f AS (
    SELECT list_reduce(list({'size': size, 'rid': rid, 'picked': NULL::BIGINT[]} ORDER BY rank, rid),
                       lambda a, x: CASE WHEN x.size <= a.size THEN {'size': a.size - x.size, 'rid': a.rid, 'picked': list_append(a.picked, x.rid)} ELSE a END,
                       {'size': any_value(budget), 'rid': 0::BIGINT, 'picked': []::BIGINT[]}).picked AS picked
    FROM k WHERE drawn GROUP BY source),
x AS (SELECT DISTINCT unnest(picked) AS rid FROM f)
SELECT doc_id, size, source_size, target, (certain::BIGINT + CASE WHEN rid IN (FROM x) THEN 1 ELSE 0 END) * size AS taken FROM k
"""
