"""Text functions as columns. Offsets are code points everywhere, ends exclusive."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Words that a search leaves out.
STOPWORDS = (
    "a an and are as at be by did do does for from had has have how i in is it its me my of on or our that the their them "
    "then there these this those to was we were what when where which who why will with you your find show file files "
    "document documents doc docs about"
).split()
WORD = r"[\p{L}\p{N}]+"
ELLIPSIS, JOINT = "…", " › "


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


POINTS = 0x110000
_KNOWN: dict[str, bytes] = {}


def word_points(spark: SparkSession) -> bytes:
    """A bit for each code point: whether words() has it, as the JVM says, whose Unicode may be another than Python's. One small job a session."""
    app = spark.sparkContext.applicationId
    if app not in _KNOWN:
        points = spark.range(POINTS).where("id not between 55296 and 57343")  # surrogates are no characters
        char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        inside = np.zeros(POINTS, bool)
        inside[points.where(char.rlike(WORD)).toArrow()["id"].to_numpy()] = True
        _KNOWN[app] = np.packbits(inside).tobytes()
    return _KNOWN[app]


def split_words(lowered: pa.Array, points: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """words() of lower-cased texts: how many each has, and all of them one after another. points: which code points words have. Works on the UTF-8 bytes of whole batches."""
    lowered = lowered.cast(pa.string())
    off = np.frombuffer(lowered.buffers()[1], np.int32)[lowered.offset : lowered.offset + len(lowered) + 1].astype(np.int64)
    data = np.frombuffer(lowered.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    inside = points[:256][data]
    high = np.flatnonzero(data >= 128)
    if len(high):
        lead = data[high] >= 192
        at, padded = high[lead], np.append(data, np.zeros(3, np.uint8))
        a, b, c, d = (padded[at + i].astype(np.int64) & (255 if i == 0 else 63) for i in range(4))
        point = np.where(a < 224, (a & 31) << 6 | b, np.where(a < 240, (a & 15) << 12 | b << 6 | c, (a & 7) << 18 | b << 12 | c << 6 | d))
        fits = np.append(points[np.minimum(point, POINTS - 1)], False)
        inside[high] = fits[np.cumsum(lead) - 1]  # all bytes of a character
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = off[:-1][off[:-1] < len(data)]
    begins[first] = inside[first]  # a text ends a word
    begin = np.flatnonzero(begins)
    ends = np.append((np.cumsum(inside) - 1)[begin], inside.sum()).astype(np.int32)
    flat = pa.StringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(data[inside]))
    return np.diff(np.searchsorted(begin, off)), flat


def query_terms(query: Column) -> Column:
    """Distinct content words in first-seen order: no stop words, single characters only if they are digits."""
    kept = F.filter(words(query), lambda w: ~w.isin(*STOPWORDS) & ((F.char_length(w) > 1) | w.rlike(r"^\d$")))
    return F.array_distinct(kept)


def has_term(text: Column, term: Column) -> Column:
    """Whether a word of the text begins with the term."""
    return F.exists(words(text), lambda w: F.startswith(w, F.lower(term)))


def matched_terms(text: Column, terms: Column) -> Column:
    tokens = words(text)
    return F.filter(terms, lambda t: F.exists(tokens, lambda w: F.startswith(w, t)))


def tokenize_name(name: Column) -> Column:
    """Search words of a file name: no extension, split at case and digit changes and at separators."""
    out = F.regexp_replace(name, r"\.[^.]+$", "")
    for pattern, into in ((r"([a-z])([A-Z])", "$1 $2"), (r"([a-zA-Z])([0-9])", "$1 $2"), (r"([0-9])([a-zA-Z])", "$1 $2"), (r"[_\-.()\[\]{}]+", " "), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, into)
    return F.trim(out)


def directories(path: Column) -> Column:
    """The directory names of a relative path, either separator."""
    parts = F.split(path, r"[\\/]")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def tokenize_path(path: Column) -> Column:
    return F.array_join(F.transform(directories(path), lambda d: tokenize_name(d)), " ")


def path_prefixes(root: Column, path: Column, separator: str = "/") -> Column:
    """The root and every directory from it down to the file's own."""
    parts = directories(path)
    base = F.regexp_replace(root, r"[\\/]+$", "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.concat(F.array(base), F.slice(parts, 1, n)), separator))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"[\\/]+$", ""), r"[\\/]"), -1)


def parent_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"[\\/]+$", ""), r"[\\/][^\\/]*$", "")


def normalise(text: Column) -> Column:
    """One kind of line end, no byte order mark and control characters, at most two blank lines. (Composed form: normalise_nfc.)"""
    out = F.regexp_replace(text, r"^\x{FEFF}", "")
    for pattern, into in ((r"\r\n?", "\n"), (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), (r"\n{4,}", "\n\n\n")):
        out = F.regexp_replace(out, pattern, into)
    return out


def reflow(text: Column) -> Column:
    """Joins hyphenated and soft line breaks of a page, and runs of blanks."""
    out = text
    for pattern, into in ((r"[ \t]+\n", "\n"), (r"([A-Za-z0-9_])-\n([A-Za-z0-9_])", "$1$2"), (r"([^\n.!?:;])\n(?=[a-z0-9(])", "$1 "), (r"[ \t]{2,}", " ")):
        out = F.regexp_replace(out, pattern, into)
    return out


def decode_entities(text: Column) -> Column:
    """The named references of office documents; the ampersand last, so that none is decoded twice."""
    out = text
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(name), F.lit(char))
    parts = F.split(out, r"(?=&#[0-9]{1,7};)")
    number = lambda p: F.regexp_extract(p, r"^&#([0-9]{1,7});", 1)
    # JVM strings take any code point from its UTF-32 bytes
    decoded = F.transform(parts, lambda p: F.when(number(p) != "", F.concat(F.decode(F.unhex(F.lpad(F.hex(number(p).cast("long")), 8, "0")), "UTF-32"), F.regexp_replace(p, r"^&#[0-9]{1,7};", ""))).otherwise(p))
    out = F.when(out.rlike(r"&#[0-9]{1,7};"), F.array_join(decoded, "")).otherwise(out)
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, without the white space around them."""
    parts = F.split(text, r"\n[^\S\n]*\n\s*")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"^\s+", ""), r"\s+$", "")), lambda p: p != "")


def location_label(page_start: Column, page_end: Column, section: Column) -> Column:
    """"p. 3", "pp. 3–5" or "§ last part of the section"; a page wins, page 0 doesn't count."""
    page = F.when(page_end.isNotNull() & (page_end != 0) & (page_end != page_start), F.concat(F.lit("pp. "), page_start.cast("string"), F.lit("–"), page_end.cast("string"))).otherwise(F.concat(F.lit("p. "), page_start.cast("string")))
    return F.when(page_start.isNotNull() & (page_start != 0), page).when(section.isNotNull() & (section != ""), F.concat(F.lit("§ "), F.element_at(F.split(section, JOINT), -1)))


def embedding_text(prefix: str, text: Column, title: Column, section: Column) -> Column:
    header = F.array_join(F.filter(F.array(title, section), lambda x: x.isNotNull() & (x != "")), JOINT)
    return F.concat(F.lit(prefix), F.when(header != "", F.concat(header, F.lit("\n\n"))).otherwise(F.lit("")), text)


def citations(answer: Column) -> Column:
    """Numbers in square brackets, in order."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda n: n.cast("int"))


def invalid_citations(answer: Column, sources: Column) -> Column:
    return F.array_distinct(F.filter(citations(answer), lambda n: (n < 1) | (n > sources)))


def spoken_answer(text: Column) -> Column:
    """An answer as speech: without citations and inference labels, sentences capitalised."""
    out = text
    for pattern, into in ((r"\s*\[\d+(?:\s*,\s*\d+)*\]", ""), (r"\bInferred:\s*", ""), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, into)
    sentences = F.split(F.trim(out), r"(?<=[.!?]) ")
    return F.array_join(F.transform(sentences, lambda s: F.concat(F.upper(F.regexp_extract(s, r"^[a-z]?", 0)), F.regexp_replace(s, r"^[a-z]", ""))), " ")


def inferred_sentences(text: Column) -> Column:
    """Sentences of an answer with a flag for those marked as inference."""
    parts = F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s) != "")
    return F.transform(parts, lambda s: F.struct(F.regexp_replace(s, r"^\s*Inferred:\s*", "").alias("sentence"), F.startswith(F.ltrim(s), F.lit("Inferred:")).alias("inferred")))


def quoted(text: Column, most: int = 40) -> Column:
    t = F.trim(text)
    return F.concat(F.lit("“"), F.when(F.char_length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit(ELLIPSIS))).otherwise(t), F.lit("”"))


def ordinal_word(index: Column) -> Column:
    """first to fifth for 0 to 4, else "number n"."""
    return F.coalesce(F.get(F.array(*map(F.lit, ("first", "second", "third", "fourth", "fifth"))), index), F.concat(F.lit("number "), (index + 1).cast("string")))


def spoken_copied(name: Column, is_folder: Column, picked: Column) -> Column:
    bare = F.when(is_folder, F.concat(F.lit("the "), name, F.lit(" folder"))).otherwise(F.regexp_replace(name, r"(?i)\.[a-z0-9]{1,5}$", ""))
    return F.when(picked > 0, F.concat(F.lit("Copied the "), ordinal_word(picked), F.lit(" match, "), bare, F.lit("."))).otherwise(F.concat(F.lit("Copied the path to "), bare, F.lit(".")))


def short_path(parts: Column, separator: str, keep: int = 2) -> Column:
    whole = F.array_join(parts, separator)
    return F.when(F.size(parts) <= keep + 1, whole).otherwise(F.concat(F.lit(ELLIPSIS + separator), F.array_join(F.slice(parts, -keep, keep), separator)))


def short_folder(path: Column, separator: str = "/", keep: int = 2) -> Column:
    """The folder of a file, only its last parts if it is deep."""
    return short_path(directories(path), separator, keep)


def short_dir(path: Column, separator: str = "/", keep: int = 2) -> Column:
    return short_path(F.split(F.regexp_replace(path, r"[\\/]+$", ""), r"[\\/]"), separator, keep)


def middle_ellipsis(path: Column, separator: str = "/", keep: int = 2, most: int = 44) -> Column:
    """Both ends of a long path, or its end alone if that is still long."""
    parts = F.split(F.regexp_replace(path, r"[\\/]+$", ""), r"[\\/]")
    end = F.slice(parts, -keep, keep)
    both = F.array_join(F.concat(F.slice(parts, 1, 2), F.array(F.lit(ELLIPSIS)), end), separator)
    tail = F.array_join(F.concat(F.array(F.lit(ELLIPSIS)), end), separator)
    return F.when(F.size(parts) <= keep + 2, F.array_join(parts, separator)).when(F.char_length(both) <= most, both).otherwise(tail)


def format_bytes(n: Column) -> Column:
    at = lambda unit, places, name: F.concat(F.format_number(n / float(unit), places), F.lit(f" {name}"))
    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, at(1 << 10, 0, "KB")).when(n < 1 << 30, at(1 << 20, 1, "MB")).otherwise(at(1 << 30, 2, "GB"))


def plural(n: Column, word: str) -> Column:
    return F.concat(F.format_number(n, 0), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def iso_date(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def highlighted(text: Column, ranges: Column, before: str = "[", after: str = "]") -> Column:
    """The text with marks around ranges (array of start, stop), which don't overlap and are in order."""
    part = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))
    folded = F.aggregate(ranges, start, lambda s, r: F.struct(F.concat(s["done"], part(s["at"], r["start"]), F.lit(before), part(r["start"], r["stop"]), F.lit(after)).alias("done"), r["stop"].cast("long").alias("at")))
    return F.concat(folded["done"], part(folded["at"], F.char_length(text)))


# Labels of kinds of files, and characters that a query, question or folder request may have.
BADGES = {"pdf": "PDF", "docx": "DOC", "md": "MD", "markdown": "MD", "txt": "TXT", "log": "TXT"}
MOST_QUERY, MOST_QUESTION, MOST_FOLDER = 500, 1000, 200


def badge(ext: Column) -> Column:
    """A file's label: that of its kind, else a short extension itself, else CODE."""
    known = F.create_map(*(F.lit(x) for pair in BADGES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, ext), F.when(F.char_length(ext) <= 4, F.upper(ext)).otherwise("CODE"))


def when_label(ms: Column, now: Column) -> Column:
    """The time of day of what happened on the day of now (a timestamp), else the date."""
    at = F.timestamp_millis(ms)
    return F.when(F.to_date(at) == F.to_date(now), F.date_format(at, "HH:mm")).otherwise(F.date_format(at, "yyyy-MM-dd"))


def response_mode(vector: Column) -> Column:
    """hybrid with a query vector, keyword without."""
    return F.when(vector.isNotNull(), "hybrid").otherwise("keyword")


def valid_action(raw: Column, plain: tuple[str, ...] = ("dismiss", "reveal", "open_app", "open_settings", "stop_speech"), most_index: int = 10, most_height: int = 480) -> Column:
    """struct(type, index, file_id, on, height) of a JSON action, or null: malformed ones are dropped, heights are rounded up and capped."""
    a = F.from_json(raw, "type string, index double, file_id double, on boolean, height double")
    whole = lambda v: (v >= 0) & (v == F.floor(v))
    good = (
        F.when(a["type"].isin(*plain), True).when(a["type"] == "select", whole(a["index"]) & (a["index"] <= most_index)).when(a["type"] == "open_source", whole(a["file_id"]))
        .when(a["type"].isin("hover", "speaking"), a["on"].isNotNull()).when(a["type"] == "resize", (a["height"] > 0) & (a["height"] < float("inf")))
    )
    only = lambda kind, v: F.when(a["type"].isin(*kind), v)
    return F.when(good, F.struct(a["type"].alias("type"), only(("select",), a["index"].cast("int")).alias("index"), only(("open_source",), a["file_id"].cast("long")).alias("file_id"), only(("hover", "speaking"), a["on"]).alias("on"), only(("resize",), F.least(F.ceil(a["height"]), F.lit(most_height)).cast("int")).alias("height")))
