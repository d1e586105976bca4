"""Distinctive words, phrases, and example searches made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import STOPWORDS, directories, query_terms

DF_CAP, WORDS, POOL, PROPER = 200, 30, 15, 1.5
FORM = r"(?<![\p{L}\p{N}_])(?:\p{Lu}\p{Ll}{3,17}|\p{Ll}{4,18})(?![\p{L}\p{N}_])"
#: A capitalised word inside a sentence.
NAME = r"(?<=[\p{Ll},] )\p{Lu}\p{Ll}{3,17}(?![\p{L}\p{N}_])"
# Nouns that say what a file is, by the words that stand for them; names and folders of files that nobody wrote.
NOUNS = {
    "proposal": "proposal", "invoice": "invoice", "contract": "contract", "agreement": "agreement", "receipt": "receipt", "manual": "manual", "statement": "statement", "itinerary": "itinerary", "recipe": "recipe",
    "resume": "resume", "cv": "resume", "report": "report", "budget": "budget", "quote": "quote", "letter": "letter", "guide": "guide", "policy": "policy", "checklist": "checklist", "spec": "spec", "brief": "brief",
    "plan": "plan", "planning": "plan", "presentation": "presentation", "notes": "notes", "note": "notes", "retro": "notes", "minutes": "notes", "journal": "notes",
}
BOILERPLATE_NAME = r"(?i)(^|[._-])(license|licence|copying|notice|changelog|changes|history|authors|contributing|code_of_conduct|security|third[_-]?party)([._-]|$)"
BOILERPLATE_DIR = r"(?i)(^|[\\/:])(node_modules|vendor|third[_-]?party|dist|build|out|\.git|\.next|coverage)([\\/]|$)"
# Words too common to tell files apart.
COMMON = (
    "also after again against almost along already although always among another anyone anything around back because been "
    "before being below between both cannot could down during each either else enough even ever every first following "
    "further gets getting give given goes going good great having here hers herself himself however into itself just keep "
    "last least less like likely made make makes making many maybe might more most much must need needs never next none "
    "nothing often once only onto other others otherwise over part perhaps please quite rather really said same says seem "
    "seems several shall should since some something soon still such sure take than thank thanks thing things think though "
    "through thus till toward under until upon used uses using very want well went whatever whether while whom whose within "
    "without would page pages http https const function return import export true false null undefined async await class "
    "interface type string number boolean void public private static elif self require module default extends implements "
    "today tomorrow yesterday week weeks weekly month months year years hour hours minute minutes morning evening night "
    "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september "
    "october november december"
).split()


def recent_per_kind(files: DataFrame, k: int = POOL) -> DataFrame:
    """The newest k contents of each kind, by their newest linked file."""
    newest = files.where("status = 'linked'").groupBy("kind", "content_id").agg(F.max_by(F.struct("name", "folder"), F.struct("mtime_ms", "file_id")).alias("file"), F.max("mtime_ms").alias("mtime_ms"))
    order = Window.partitionBy("kind").orderBy(F.desc("mtime_ms"), "content_id")
    ranked = newest.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return ranked.select("kind", "content_id", "place", "mtime_ms", F.col("file.name").alias("name"), F.col("file.folder").alias("folder"))


def together(contents: DataFrame) -> DataFrame:
    """contents (content_id, text), shuffled to their ids: forms, tallies and phrases of a content are then counted where its text is, and words are never shuffled."""
    return contents.select("content_id", "text").repartition("content_id")


def forms(contents: DataFrame, common: tuple[str, ...] | list[str] = COMMON) -> DataFrame:
    """(content_id, pos, form, key, proper): plain words of 4 to 18 letters, capitalised or not; proper: a name somewhere in the content."""
    names = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(NAME), F.lit(0)), lambda n: F.lower(n)))
    listed = F.transform(F.regexp_extract_all("text", F.lit(FORM), F.lit(0)), lambda w: F.struct(w.alias("form"), F.lower(w).alias("key"), F.array_contains(F.col("names"), F.lower(w)).alias("proper")))
    found = contents.withColumn("names", names).select("content_id", F.posexplode(listed).alias("pos", "w")).select("content_id", "pos", "w.*")
    return found.where(~F.col("key").isin(*STOPWORDS, *common))


def tallies(words: DataFrame) -> DataFrame:
    """(content_id, key, tf, form, first, proper): the commonest form, of equal ones the first met. Forms are counted before keys."""
    per_form = words.groupBy("content_id", "key", "form").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.bool_or("proper").alias("proper"))
    return per_form.groupBy("content_id", "key").agg(
        F.sum("n").alias("tf"), F.max_by("form", F.struct("n", (-F.col("first")).alias("early"))).alias("form"), F.min("first").alias("first"), F.bool_or("proper").alias("proper")
    )


def distinctive(words: DataFrame, frequencies: DataFrame, rows: int, k: int = WORDS) -> DataFrame:
    """(content_id, key, form, tf, idf, score) of each content's k commonest words, names weighing more; frequencies: (term, df) of the index, rows: its size."""
    order = Window.partitionBy("content_id").orderBy(F.desc("tf"), "first")
    top = tallies(words).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    df = F.least(F.coalesce("df", F.lit(0)), F.lit(DF_CAP))
    both = top.join(frequencies.withColumnRenamed("term", "key"), "key", "left").withColumn("idf", F.log((F.lit(float(rows)) + 1) / (df + 1)))
    return both.select("content_id", "key", "form", "tf", "place", "idf", (F.col("tf") * F.col("idf") * F.when(F.col("proper"), PROPER).otherwise(1.0)).alias("score"))


def phrases(contents: DataFrame, words: DataFrame, terms: DataFrame) -> DataFrame:
    """(content_id, phrase, tf, score) of two different top words that stand side by side at least twice."""
    pair = F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}_])(?=(\p{L}{4,18} \p{L}{4,18})(?![\p{L}\p{N}_]))"), F.lit(1))
    found = contents.select("content_id", F.explode(pair).alias("pair")).groupBy("content_id", F.lower("pair").alias("phrase")).agg(F.count("*").alias("tf")).where("tf >= 2")
    split = found.withColumn("a", F.split("phrase", " ")[0]).withColumn("b", F.split("phrase", " ")[1]).where("a <> b")
    idf = lambda c: terms.select("content_id", F.col("key").alias(c), F.col("idf").alias(f"idf_{c}"))
    return split.join(idf("a"), ["content_id", "a"]).join(idf("b"), ["content_id", "b"]).select("content_id", "phrase", "tf", (F.col("tf") * (F.col("idf_a") + F.col("idf_b"))).alias("score"))


def file_noun(name: Column, path: Column) -> Column:
    """What the file's name, or else its folders from the nearest on, say it is; null if nothing."""
    said = query_terms(F.concat_ws(" ", F.regexp_replace(name, r"\.[^.]+$", ""), F.array_join(F.reverse(directories(path)), " ")))
    known = F.create_map(*(F.lit(x) for pair in NOUNS.items() for x in pair))
    return F.get(F.filter(F.transform(said, lambda w: F.coalesce(F.try_element_at(known, w), F.try_element_at(known, F.regexp_replace(w, "s$", "")))), lambda n: n.isNotNull()), F.lit(0))


def alike(a: Column, b: Column) -> Column:
    """Whether two words agree in their first five letters, or in all of the shorter one."""
    x, y = F.substring(a, 1, 5), F.substring(b, 1, 5)
    return F.startswith(x, y) | F.startswith(y, x)


def suggestions(files: DataFrame, chunks: DataFrame, frequencies: DataFrame, rows: int, limit: int = 3) -> DataFrame:
    """(content_id, query): searches after the newest files, first one for each kind and folder, then one for each folder, then any.

    The pool is bounded (POOL a kind); its texts are tallied whole, all of their chunks, and only their queries reach the driver, which picks
    greedily. Boilerplate, by name or folder, is left out, and contents without chunks take no place.
    """
    linked = files.where("status = 'linked'").join(chunks.where("ord = 0").select("content_id"), "content_id", "left_semi")
    pool = recent_per_kind(linked).join(linked.groupBy("content_id").agg(F.max_by("rel_path", F.struct("mtime_ms", "file_id")).alias("rel_path")), "content_id")
    pool = pool.where(~F.col("name").rlike(BOILERPLATE_NAME) & ~F.concat("folder", F.lit(":"), "rel_path").rlike(BOILERPLATE_DIR)).withColumn("noun", file_noun(F.col("name"), F.col("rel_path")))
    texts = chunks.join(F.broadcast(pool.select("content_id")), "content_id", "left_semi")
    texts = texts.groupBy("content_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda c: c["text"]), "\n").alias("text"))
    words = forms(texts)
    terms = distinctive(words, frequencies, rows)
    both = terms.select("content_id", "form", "key", "score").unionByName(phrases(texts, words, terms).select("content_id", F.col("phrase").alias("form"), F.col("phrase").alias("key"), "score"))
    known = F.create_map(*(F.lit(x) for pair in NOUNS.items() for x in pair))
    own = F.exists(F.split("key", " "), lambda w: F.coalesce(F.try_element_at(known, w) == F.col("noun"), F.lit(False)))
    listed = both.join(F.broadcast(pool.select("content_id", "noun")), "content_id").where((F.col("score") > 0) & ~own)
    listed = listed.groupBy("content_id").agg(F.sort_array(F.collect_list(F.struct("score", "form", "key")), False).alias("terms"))  # WORDS and their phrases
    head = F.split(F.col("terms")[0]["key"], " ")
    second = F.filter("terms", lambda t: ~F.exists(F.split(t["key"], " "), lambda w: F.exists(head, lambda h: alike(w, h))))
    paired = listed.select("content_id", F.col("terms")[0]["form"].alias("a"), F.get(second, F.lit(0))["form"].alias("b")).where("a is not null and b is not null")
    lead = F.when(F.col("kind") == "code", "code for ").when(F.col("noun").isNotNull(), F.concat("noun", F.lit(" about "))).when(F.col("kind") == "pdf", "the PDF about ").when(F.col("kind") == "docx", "the document about ").otherwise("notes about ")
    made = pool.join(paired, "content_id").select("content_id", "kind", "mtime_ms", F.concat("folder", F.lit(":"), F.array_join(directories(F.col("rel_path")), "/")).alias("dir"), F.concat(lead, "a", F.lit(" and "), "b").alias("query"))
    chosen = pick_varied([r.asDict() for r in made.orderBy(F.col("kind") == "code", F.desc("mtime_ms"), "content_id").collect()], limit)
    return files.sparkSession.createDataFrame([(c["content_id"], c["query"]) for c in chosen], "content_id long, query string")


def pick_varied(rows: list[dict], limit: int) -> list[dict]:
    """Greedy, in three rounds: a new kind and a new folder; a new folder and no second code file; any."""
    out: list[dict] = []
    for new_kind, new_dir in ((True, True), (False, True), (False, False)):
        for r in rows:
            kinds, dirs = {c["kind"] for c in out}, {c["dir"] for c in out}
            second_code = r["kind"] == "code" and "code" in kinds
            if len(out) < limit and r not in out and not (new_dir and (r["dir"] in dirs or second_code)) and not (new_kind and r["kind"] in kinds):
                out.append(r)
    return out
