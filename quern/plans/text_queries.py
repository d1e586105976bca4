"""Queries of the text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import intent, paths, text
from quern.operators import folders, index
from quern.plans import model


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.queries(spark, sf_dir).select("query_id", F.array_join(text.query_terms(F.col("query")), " ").alias("terms"))


def name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.files(spark, sf_dir).select("file_id", text.tokenize_name(F.concat("name", F.lit(".txt"))).alias("name_tokens"), text.tokenize_path(F.col("rel_path")).alias("path_tokens"))


def path_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = model.table(spark, sf_dir, "pages").select(paths.host_of(F.col("url")).alias("host"), paths.path_of(F.col("url")).alias("path"))
    return pages.select(F.explode(text.path_prefixes(F.col("host"), F.col("path"))).alias("folder")).groupBy("folder").agg(F.count("*").alias("pages"))


def postings_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.build(model.contents(spark, sf_dir), "content_id", {"text": 1.0}).postings.select("term", "id", F.col("tf").cast("long").alias("tf"))


def document_frequency_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index.build(model.contents(spark, sf_dir), "content_id", {"text": 1.0}).frequencies
    return found.select("term", F.least("df", F.lit(200)).alias("df"))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.build(model.contents(spark, sf_dir), "content_id", {"text": 1.0}).stats.select("rows", F.round("average", 6).alias("average"))


def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = model.table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(".\r\n\r\n\r\r\n")).alias("text"))
    return docs.select("doc_id", F.sha2(text.normalise(F.col("text")), 256).alias("sha"))


def paragraph_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = model.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n \n")))))
    return docs.select("doc_id", F.col("pos").cast("long").alias("ord"), F.sha2("col", 256).alias("sha"))


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, paragraphs, items and rows of pages as office documents have them, with inline marks dropped."""
    blocks = F.regexp_extract_all("html", F.lit(r"(?s)<(?:h[1-6]|p|li|tr)\b[^>]*>(.*?)</(?:h[1-6]|p|li|tr)>"), F.lit(1))
    rows = model.table(spark, sf_dir, "pages").select("page_id", F.posexplode(blocks))
    plain = F.trim(text.decode_entities(F.regexp_replace(F.regexp_replace("col", r"<br\s*/?>", "\n"), r"<[^>]+>", "")))
    return rows.select("page_id", F.col("pos").cast("long").alias("ord"), F.sha2(plain, 256).alias("sha")).where(plain != "")


def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", r"(?s)<h1\b[^>]*>(.*?)</h1>", 1)
    return model.table(spark, sf_dir, "pages").select("page_id", text.decode_entities(F.regexp_replace(title, "<[^>]+>", "")).alias("title"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = paths.path_of(F.col("url"))
    return model.table(spark, sf_dir, "pages").select("page_id", paths.host_of(F.col("url")).alias("host"), text.base_name(path).alias("name"), text.short_folder(path).alias("folder"), paths.is_loopback(paths.host_of(F.col("url"))).alias("loopback"))


def location_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.table(spark, sf_dir, "lineitem")
    section = F.when(F.col("l_linenumber") > 2, F.concat_ws(text.JOINT, "l_returnflag", "l_linestatus"))
    start, end = F.when(F.col("l_linenumber") < 5, F.col("l_linenumber") - 1), F.when(F.col("l_linenumber") < 4, F.col("l_linenumber"))
    return rows.groupBy(text.location_label(start, end, section).alias("label")).agg(F.count("*").alias("n"))


def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = model.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(text.embedding_text("search_document: ", F.coalesce("text", F.lit("")), F.col("source"), F.when(F.col("lang") != "en", F.col("lang"))), 256).alias("sha"))


def display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = model.files(spark, sf_dir)
    return files.select("file_id", text.format_bytes(F.col("size")).alias("size_label"), text.plural(F.col("size"), "byte").alias("count_label"), text.iso_date(F.col("mtime_ms") * 100_000).alias("day"), text.quoted(F.col("rel_path"), 12).alias("short_name"))


def intent_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn, and each one again behind openers, so that all routes are taken."""
    turns = model.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    openers = F.array(*map(F.lit, ("", "Hey computer, please find my ", "what is ", "Yes, show me the folder with ", "cancel", "no thanks", "which file ", "computer")))
    said = turns.select("conv_id", "turn", F.posexplode(openers).alias("opener", "lead"), "text")
    whole = F.when(F.col("lead").isin("cancel", "no thanks", "computer"), F.col("lead")).otherwise(F.concat("lead", "text"))
    return said.select("conv_id", "turn", "opener", intent.classify(whole).alias("i")).select("conv_id", "turn", "opener", "i.kind", "i.query", "i.folder")


def ordinal_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks by number, made from the turns."""
    nth = F.get(F.array(*map(F.lit, ("first", "second", "3rd", "4", "five", "last", "sixth"))), (F.col("turn") % 7).cast("int"))
    said = F.concat(F.lit("Yes, the "), nth, F.when(F.col("role") == "user", " one please").otherwise(" match"))
    return model.table(spark, sf_dir, "conversations").select("conv_id", "turn", intent.ordinal(said).alias("pick"), intent.is_reveal(F.when(F.col("role") == "user", "Show it in the folder!").otherwise(F.col("text"))).alias("reveal"))


def wake_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("hey computer "), intent.normalise(F.col("text")))
    return model.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(intent.strip_wake(said), 256).alias("sha"))


def folder_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of pages for each benchmark text as a request."""
    return folders.match(model.queries(spark, sf_dir), path_prefixes(spark, sf_dir).select("folder"))


def citation_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that cite by length, order and position."""
    answer = F.concat(F.lit("See ["), (F.char_length("text") % 9).cast("string"), F.lit("] and ["), (F.col("turn") % 8).cast("string"), F.lit("], also [99] and [99]."))
    turns = model.table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", answer.alias("answer"))
    return turns.select("conv_id", "turn", F.array_join(text.citations(F.col("answer")), ",").alias("cited"), F.array_join(text.invalid_citations(F.col("answer"), F.lit(6)), ",").alias("invalid"))


def spoken_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = model.table(spark, sf_dir, "conversations").where("text is not null")
    return turns.select("conv_id", "turn", F.sha2(text.spoken_answer(F.concat(F.lit("Inferred:  it is so [1, 2].  "), F.regexp_replace("text", r"[^A-Za-z0-9 .]", ""))), 256).alias("sha"))


def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the path rules say of every page's path, taken as one of a drive, and of some that must be refused."""
    path = paths.path_of(F.col("url"))
    made = F.array(F.concat(F.lit("C:/Users/"), path), F.concat(F.lit("C:\\Windows\\"), path), F.concat(F.lit("//host/"), path), F.concat(F.lit("C:/"), path, F.lit("/../x")), F.lit("D:\\"), F.lit("C:/me/AppData/Local/x"))
    rows = model.table(spark, sf_dir, "pages").select("page_id", F.posexplode(made).alias("form", "path"))
    return rows.select(
        "page_id", "form", paths.path_key(F.col("path")).alias("key"), paths.is_inside(F.col("path"), F.lit("c:/users")).alias("inside"), paths.is_safe_local(F.col("path")).alias("safe"), paths.blocked_reason(F.col("path")).alias("blocked")
    )


def file_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds, caps, badges, exclusion and openness of files, whose extensions go round."""
    ext = F.get(F.array(*map(F.lit, ("txt", "md", "pdf", "docx", "py", "exe", "svelte"))), (F.col("file_id") % 7).cast("int"))
    lead = F.get(F.array(*map(F.lit, ("", "~$", ".", "node_modules/", "x/.git/y/"))), (F.col("file_id") % 5).cast("int"))
    kind = paths.kind_of(paths.extension(F.col("file")))
    rows = model.files(spark, sf_dir).select("file_id", F.concat(lead, "name", F.lit("."), ext).alias("file"))
    return rows.select("file_id", kind.alias("kind"), paths.size_cap(kind).alias("cap"), text.badge(paths.extension(F.col("file"))).alias("badge"), paths.is_excluded_path(F.col("file")).alias("excluded"), paths.is_openable(paths.extension(F.col("file"))).alias("openable"))


def query_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns cut as queries, questions and folder requests are."""
    cut = lambda n: F.char_length(F.left("text", F.lit(n))).alias(f"chars_{n}")
    return model.table(spark, sf_dir, "conversations").select("conv_id", "turn", *map(cut, (text.MOST_QUERY, text.MOST_QUESTION, text.MOST_FOLDER)))


def when_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of day of the last event's day, dates of the others."""
    events = model.table(spark, sf_dir, "events").select("event_id", F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")).alias("ms"))
    last = events.agg(F.max("ms").alias("last"))
    return events.crossJoin(F.broadcast(last)).select("event_id", text.when_label(F.col("ms"), F.timestamp_millis("last")).alias("label"))  # one row


def utf8_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written in four encodings and decoded as files are."""
    from quern.sources import files

    forms = F.array(F.encode("text", "UTF-8"), F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")), F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")), F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")))
    docs = model.table(spark, sf_dir, "documents").where("text is not null and trim(text) <> ''").select("doc_id", F.lit("text").alias("kind"), F.posexplode(forms).alias("form", "content"))
    return files.extract(docs).select("doc_id", "form", "status", F.sha2("text", 256).alias("sha"), F.size("blocks").alias("n_blocks"))


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown: each line a section of its own, cut into chunks that name their section."""
    from quern.operators import chunking
    from quern.sources import files

    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), lambda x, i: F.concat(F.lit("# Part "), i.cast("string"), F.lit("\n\n"), F.trim(x)))
    docs = model.table(spark, sf_dir, "documents").where("text is not null and trim(text) <> '' and not contains(text, '#') and not contains(text, '`') and not contains(text, '~')")
    read = files.extract(docs.select(F.col("doc_id").alias("content_id"), F.lit("markdown").alias("kind"), F.encode(F.array_join(lines, "\n\n"), "UTF-8").alias("content")))
    return chunking.chunk(read).groupBy("content_id").agg(F.countDistinct("section").alias("sections"), F.min("section").alias("first_section"))


_W = r"[\p{L}\p{N}]+"
_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
CONTENTS = "contents AS (SELECT min(doc_id) AS content_id, coalesce(text, '') AS text FROM documents GROUP BY coalesce(text, ''), lang)"
POSTINGS = f"{CONTENTS}, tokens AS (SELECT content_id AS id, unnest(regexp_extract_all(lower(text), '{_W}')) AS term FROM contents), postings AS (SELECT term, id, count(*) AS tf FROM tokens GROUP BY term, id)"
_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({}, '')), '[’`]', '''', 'g'), '[^a-z0-9'' ]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_q = lambda p: "'" + p.replace("'", "''") + "'"
_FILE_Q1 = f"regexp_replace(regexp_replace(trim(regexp_replace(r, {_q(intent.FILE_VERB)}, '')), '^(me|for|to)\\s+', ''), {_q(intent.ARTICLES)}, '')"
_FILE_Q2 = f"regexp_replace(regexp_replace(trim(regexp_replace(q1, {_q(intent.FOLDER_NOUN)}, ' ', 'g')), {_q(intent.JOINERS)}, ''), {_q(intent.ARTICLES)}, '')"
_NAME = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\\.[^.]+$', ''), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([a-zA-Z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-zA-Z])', '\\1 \\2', 'g'), '[_\\-.()\\[\\]{{}}]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1))"
_PATH = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/?([^?#]*)', 1)"
_PREFIXES = f"""parts AS (SELECT {_HOST} AS host, string_split_regex({_PATH}, '[\\\\/]') AS p FROM pages),
prefixes AS (SELECT array_to_string(list_concat([host], p[1:n]), '/') AS folder FROM (SELECT host, p, unnest(range(0, len(p))) AS n FROM parts))"""
_ENT = "replace(replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_STEM = "[regexp_replace(regexp_replace(w, '(ies)$', 'y'), '(es|s)$', '') FOR w IN string_split_regex(lower({}), '[^a-z0-9]+') IF length(w) > 1 AND w NOT IN (" + ", ".join(f"'{w}'" for w in folders.STOP) + ")]"
SQL = {
    "query_terms": f"SELECT item_id::BIGINT AS query_id, array_to_string(list_distinct_in_order, ' ') AS terms FROM (SELECT item_id, [w FOR w, i IN ws IF list_position(ws, w) = i] AS list_distinct_in_order FROM (SELECT item_id, [w FOR w IN regexp_extract_all(lower(text), '{_W}') IF w NOT IN ({_STOP}) AND (length(w) > 1 OR regexp_matches(w, '^\\d$'))] AS ws FROM benchmark))",
    "name_tokens": f"WITH {model.FILES_SQL} SELECT file_id, {_NAME.format('name || ' + _q('.txt'))} AS name_tokens, {_NAME.format(f'regexp_extract(rel_path, {_q("^(.*)/[^/]*$")}, 1)')} AS path_tokens FROM files",
    "path_prefixes": f"WITH {_PREFIXES} SELECT folder, count(*) AS pages FROM prefixes GROUP BY folder",
    "postings_tf": f"WITH {POSTINGS} SELECT * FROM postings",
    "document_frequency_capped": f"WITH {POSTINGS} SELECT term, least(count(*), 200) AS df FROM postings GROUP BY term",
    "corpus_stats": f"WITH {POSTINGS} SELECT (SELECT count(*) FROM contents) AS rows, round((SELECT count(*) FROM tokens) / (SELECT count(*) FROM contents), 6) AS average",
    "normalise_text": "SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(replace(text, '. ', '.' || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(13) || chr(10)), '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '\\n{4,}', repeat(chr(10), 3), 'g')) AS sha FROM documents",
    "paragraph_blocks": """SELECT doc_id, i - 1 AS ord, sha256(parts[i]) AS sha FROM (
        SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, [b FOR b IN [regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '') FOR x IN string_split(text, chr(10))] IF b <> ''] AS parts FROM documents))""",
    "html_blocks": f"""WITH b AS (SELECT page_id, regexp_extract_all(html, '(?s)<(?:h[1-6]|p|li|tr)\\b[^>]*>(.*?)</(?:h[1-6]|p|li|tr)>', 1) AS parts FROM pages),
        u AS (SELECT page_id, i - 1 AS ord, trim({_ENT.format("regexp_replace(regexp_replace(parts[i], '<br\\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g')")}) AS t FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM b))
        SELECT page_id, ord, sha256(t) AS sha FROM u WHERE t <> ''""",
    "html_title": f"""SELECT page_id, {_ENT.format("regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')")} AS title FROM pages""",
    "url_parts": f"""WITH p AS (SELECT page_id, {_HOST} AS host, string_split_regex({_PATH}, '[\\\\/]') AS p FROM pages)
        SELECT page_id, host, CASE WHEN p[-1] = '' AND len(p) > 1 THEN p[-2] ELSE p[-1] END AS name,
               CASE WHEN len(p) - 1 <= 3 THEN array_to_string(p[1:len(p) - 1], '/') ELSE '…/' || array_to_string(p[len(p) - 2:len(p) - 1], '/') END AS folder, regexp_matches(host, '^(localhost|::1|127\\.\\d+\\.\\d+\\.\\d+)$') AS loopback FROM p""",
    "location_labels": """SELECT label, count(*) AS n FROM (
        SELECT CASE WHEN s IS NOT NULL AND s <> 0 THEN CASE WHEN e IS NOT NULL AND e <> 0 AND e <> s THEN 'pp. ' || s || '–' || e ELSE 'p. ' || s END WHEN sec IS NOT NULL AND sec <> '' THEN '§ ' || string_split(sec, ' › ')[-1] END AS label
        FROM (SELECT CASE WHEN l_linenumber < 5 THEN l_linenumber - 1 END AS s, CASE WHEN l_linenumber < 4 THEN l_linenumber END AS e, CASE WHEN l_linenumber > 2 THEN concat_ws(' › ', l_returnflag, l_linestatus) END AS sec FROM lineitem)) GROUP BY label""",
    "embedding_text": "SELECT doc_id, sha256('search_document: ' || concat_ws(' › ', nullif(source, ''), CASE WHEN lang <> 'en' THEN lang END) || chr(10) || chr(10) || coalesce(text, '')) AS sha FROM documents",
    "display_labels": f"""WITH {model.FILES_SQL} SELECT file_id, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN round_even(size / 1024.0, 0)::BIGINT || ' KB' ELSE 'large' END AS size_label,
        format('{{:,}}', size) || ' byte' || CASE WHEN size = 1 THEN '' ELSE 's' END AS count_label, strftime(make_timestamp(mtime_ms * 100000 * 1000), '%Y-%m-%d') AS day,
        '“' || CASE WHEN length(rel_path) > 12 THEN rtrim(rel_path[1:11]) || '…' ELSE rel_path END || '”' AS short_name FROM files""",
    "intent_classify": f"""WITH t AS (
        SELECT conv_id, turn, i - 1 AS opener, CASE WHEN l IN ('cancel', 'no thanks', 'computer') THEN l ELSE l || coalesce(text, '') END AS raw
        FROM (SELECT *, ls[i] AS l FROM (SELECT conv_id, turn, text, unnest(range(1, 9)) AS i, ['', 'Hey computer, please find my ', 'what is ', 'Yes, show me the folder with ', 'cancel', 'no thanks', 'which file ', 'computer'] AS ls FROM conversations))),
        s AS (SELECT *, regexp_replace({_NORM.format("raw")}, '^((hey|hi|ok|okay)\\s+)?computer\\b\\s*', '') AS said FROM t),
        r AS (SELECT *, trim(regexp_replace(regexp_replace(said, {_q(intent.AGREEMENT_PREFIX)}, ''), {_q(f"^({intent.POLITE}|computer\\s+)+")}, '')) AS r FROM s),
        k AS (SELECT *, regexp_matches(r, {_q(intent.FOLDER_NOUN)}) AS is_folder, {_FILE_Q1} AS q1, CASE WHEN said = '' THEN 'empty' WHEN regexp_matches(said, {_q(intent.REFUSAL)}) THEN 'refuse' WHEN regexp_matches(said, {_q(intent.AGREEMENT)}) THEN 'agree' WHEN r = '' THEN 'agree'
             WHEN regexp_matches(r, {_q(intent.FILE_VERB)}) OR regexp_matches(r, {_q(intent.WHICH_FILE)}) THEN 'file' WHEN regexp_matches(r, {_q(intent.QUESTION_START)}) THEN 'question' ELSE 'file' END AS kind FROM r),
        f AS (SELECT *, trim(regexp_replace(regexp_replace(CASE WHEN is_folder THEN {_FILE_Q2} ELSE q1 END, '\\b(please|for me)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS fq FROM k)
        SELECT conv_id, turn, opener::INTEGER AS opener, kind, CASE kind WHEN 'file' THEN CASE WHEN fq = '' THEN r ELSE fq END WHEN 'question' THEN r END AS query, CASE WHEN kind = 'file' THEN is_folder END AS folder FROM f""",
    "ordinal_parse": f"""SELECT conv_id, turn, CASE turn % 7 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3' WHEN 3 THEN '4' WHEN 4 THEN '5' WHEN 5 THEN 'last' END AS pick,
        CASE WHEN role = 'user' THEN true ELSE regexp_matches({_NORM.format("text")}, {_q(intent.REVEAL)}) END AS reveal FROM conversations""",
    "wake_strip": f"SELECT conv_id, turn, sha256({_NORM.format('text')}) AS sha FROM conversations",
    "folder_match": f"""WITH {_PREFIXES}, d AS (SELECT DISTINCT folder, regexp_extract(rtrim(folder, '/'), '([^/]*)$', 1) AS name FROM prefixes),
        n AS (SELECT folder, len(string_split(folder, '/')) AS depth, {_STEM.format("name")} AS ns FROM d), q AS (SELECT item_id::BIGINT AS query_id, {_STEM.format("text")} AS qs FROM benchmark),
        m AS (SELECT query_id, folder, depth, list_sum([CASE WHEN list_contains(ns, w) THEN 2 WHEN length(w) >= 3 AND len([x FOR x IN ns IF starts_with(x, w) OR starts_with(w, x)]) > 0 THEN 1 ELSE 0 END FOR w IN qs])::INTEGER AS score FROM q, n WHERE len(ns) > 0),
        k AS (SELECT query_id, folder, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, depth, folder) AS place FROM m WHERE score > 0)
        SELECT * FROM k WHERE place <= 5""",
    "citation_validate": """WITH c AS (SELECT conv_id, turn, [length(text) % 9, turn % 8, 99, 99] AS c FROM conversations WHERE text IS NOT NULL)
        SELECT conv_id, turn, array_to_string(c, ',') AS cited, array_to_string([x FOR x, i IN v IF list_position(v, x) = i], ',') AS invalid FROM (SELECT *, [x FOR x IN c IF x < 1 OR x > 6] AS v FROM c)""",
}
SQL |= {
    "spoken_answers": r"""WITH s AS (SELECT conv_id, turn, string_split(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace('Inferred:  it is so [1, 2].  ' || regexp_replace(text, '[^A-Za-z0-9 .]', '', 'g'), '\s*\[\d+(?:\s*,\s*\d+)*\]', '', 'g'), '\bInferred:\s*', '', 'g'), '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) AS parts FROM conversations WHERE text IS NOT NULL)
        SELECT conv_id, turn, sha256(array_to_string([CASE WHEN regexp_matches(p, '^[a-z]') THEN upper(p[1]) || p[2:] ELSE p END FOR p IN parts], ' ')) AS sha FROM s""",
    "path_rules": f"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), f AS (SELECT page_id, i - 1 AS form, ps[i] AS path FROM (SELECT page_id, ['C:/Users/' || path, 'C:\\Windows\\' || path, '//host/' || path, 'C:/' || path || '/../x', 'D:\\', 'C:/me/AppData/Local/x'] AS ps, unnest(range(1, 7)) AS i FROM p)),
        k AS (SELECT *, lower(regexp_replace(regexp_replace(regexp_replace(path, '[\\\\/]+', '/', 'g'), '(/\\.)+(/|$)', '\\2', 'g'), '/+$', '')) AS key FROM f)
        SELECT page_id, form::INTEGER AS form, key, starts_with(key, 'c:/users/') AND form <> 3 AS inside, form <> 2 AS safe, CASE WHEN regexp_matches(key, '^[a-z]:$') THEN 'drive' WHEN key = 'c:/windows' OR starts_with(key, 'c:/windows/') THEN 'system' WHEN contains(key, '/appdata/local/') THEN 'application data' END AS blocked FROM k""",
    "file_rules": f"""WITH {model.FILES_SQL}, e AS (SELECT file_id, ['txt', 'md', 'pdf', 'docx', 'py', 'exe', 'svelte'][file_id % 7 + 1] AS ext, file_id % 5 AS lead FROM files)
        SELECT file_id, CASE ext WHEN 'txt' THEN 'text' WHEN 'md' THEN 'markdown' WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'py' THEN 'code' WHEN 'svelte' THEN 'code' END AS kind, CASE WHEN ext = 'pdf' THEN 209715200 ELSE 52428800 END AS cap,
            CASE ext WHEN 'docx' THEN 'DOC' WHEN 'svelte' THEN 'CODE' ELSE upper(ext) END AS badge, lead > 0 AS excluded, ext IN ('txt', 'md', 'pdf', 'docx') AS openable FROM e""",
    "query_caps": "SELECT conv_id, turn, least(length(text), 500) AS chars_500, least(length(text), 1000) AS chars_1000, least(length(text), 200) AS chars_200 FROM conversations",
    "when_labels": "SELECT event_id, CASE WHEN ts::DATE = (SELECT max(ts)::DATE FROM events) THEN strftime(ts, '%H:%M') ELSE strftime(ts, '%Y-%m-%d') END AS label FROM events",
    "utf8_text": "SELECT doc_id, form::INTEGER AS form, 'ok' AS status, sha256(text) AS sha, 1 AS n_blocks FROM documents, range(4) t(form) WHERE trim(text) <> ''",
    "markdown_sections": "SELECT doc_id AS content_id, len([x FOR x IN string_split(text, chr(10)) IF trim(x) <> '']) AS sections, 'Part 0' AS first_section FROM documents WHERE trim(text) <> '' AND NOT regexp_matches(text, '[#`~]')",
}
QUERIES = {name: globals()[name] for name in SQL}
