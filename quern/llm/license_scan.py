"""License scan by canonical digests, with DataFrame functions only.

A text is brought to a canonical form (case, punctuation, copyright lines and equivalent spellings aside), and
SHA-256 digests of the form are hash-joined to those of known licenses: once for the whole text, and once for
each of its lines as an entire text. The table of known digests is a constant of a few hundred rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import column, cut, small, table, tidy

# Names of licenses by SPDX identifier, and short license texts.
NAMES = {
    "MIT": ("MIT License", "MIT"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "ISC": ("ISC License",),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "MPL 2.0"),
    "CC0-1.0": ("CC0 1.0", "Creative Commons Zero 1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0"),
}
PHRASES = ("{}", "Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under the {}", "This work is licensed under {}", "This work is licensed under the {}", "This file is licensed under the {}", "SPDX-License-Identifier: {}")
TEXTS = {
    "MIT": (
        "MIT License\n\nCopyright (c) <year> <copyright holders>\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, '
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "ISC License\n\nCopyright (c) <year> <copyright holders>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD "
        "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "0BSD": (
        "Zero-Clause BSD\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND "
        "THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
}
#: Digests and lengths of the canonical forms of longer whole texts, in the wordings and with the headings they are commonly spread in.
WHOLE = {
    "Apache-2.0": (
        ("b28c592290fc881626accde93b8b1476bcd717477ba28db6071816697401aba7", 9653),
        ("ba4deb46c3f939c93400adce81216ba49532767f12252292c3937c75dc83fbe6", 9838),
        ("cb89c406f6433b7725f2cf43fa7d4ea56295d78083f171bab61c89553dd7411e", 8605),
        ("d66f2d05dfd3a982bdb11600e9e24574c7c2122cef3f565e4b2a399fe8fa4909", 8790),
    ),
    "BSD-2-Clause": (
        ("117fa84a7ffb2cb3a2ba7d18dd284e7283b034d6fb6c6419721ee4e28b5306fe", 1217),
        ("218f5b650f149e23f159537f8b1ab16d0ff44722e0038a34bb90a58b3442864a", 1242),
        ("447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2", 1218),
        ("63151a500234e07ef3e50814b0d1d07db92c9481191003b577fbf42336ed40a0", 1233),
        ("6a5d49c15e02e9e94957d78177d86e8631be9a19549a7cfd2e8c3be2699f00b9", 1213),
        ("759fbc88d1a61bf63640c42d23a213634de667f3d7ae64bc844d566a6cb7dd57", 1237),
        ("7be8178e4e9d0dea6ff4b04bd52bd086d7ea8386a5a6e09760df916bae5d42d2", 1192),
        ("9c47a682ef64c4e02c50c208384916c7f80087d4e4395b2b06e65a4c4b08b152", 1212),
        ("a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30", 1197),
        ("eda2ad636e738f6a26a2fea902bb734ee48c789a5b40035b8db3659bd951e5bc", 1217),
        ("f4befedc01589c90d5effeae5f64453726c8fded8e4b6fe6c36f99d303581f1f", 1238),
        ("f9c0de945db946a0b06e8587a80b1b35b3f3e48a0f63cb64860eb4e433d32c7b", 1222),
    ),
    "BSD-3-Clause": (
        ("007fde9b266f35183b511c8c01994581175bfdaa48438967e905c31fb50ba523", 1400),
        ("07002ede2e559c6e97a5ba89a53d7ded83eda46c54cea64eb39745675c2aabfc", 1431),
        ("1238550805feaeec7ac6f60c2a1b7b3828c3fb1e9d9d52c718c3b75c7b5ff98e", 1421),
        ("326c317935b3409d9750fd4ad5326ce15c9b75d313b4baf2cb9ff54accf8d903", 1405),
        ("53075742228962c7ea381b8242c64602fa32e7b8f52facb6d13ee4f9c596ddfa", 1380),
        ("73a15ef51d0f74bce7fc4d1287b8d8a639c37581de7f63863957aea115dca7da", 1411),
        ("9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2", 1386),
        ("cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15", 1407),
        ("cf77ee3d20f4076cecdb58fc53aa7204c9f5c0651621abbc85e028f5b2ffa6b4", 1427),
        ("da336ff5d6bbb6a30ad59a0dd798c7e6e1e57d719bbb6300725786c3648c658d", 1425),
        ("eabe215ff5a2cf5b1c090915b7cabdf511f70fc79fb8fde85247ebe3038a9658", 1406),
        ("f94931e221f919e6cec5ca99e0ea7da1912b2c7d805cdaee8baf508c248bc1af", 1401),
    ),
    "CC-BY-SA-4.0": (
        ("341e22d02bc30a04ebaef687f5a3a6e3a8e7d68b4e5defe71c5f5dd6fd4d3223", 17417),
    ),
    "CC0-1.0": (
        ("efa01e1f98bc5d90ca373f597e31e8f26b9c2e392a701828ae8cab513d864640", 6685),
    ),
    "GPL-2.0": (
        ("49ce9461d216539de6673d1b9c9fa012a9620093681882c9888171455a4a74ee", 14330),
        ("598186845e07cce9328167b92579f6070e45d0b9ced41fff57339604c6f9bb3c", 16857),
        ("79a6937f563fd3955eeb4deac71c3afb866299c317d1f84a67a1e04663500f96", 16802),
        ("872957fec116ea68654667f7029038dc199f4cb3b41f008fa363300053f2b47b", 16907),
        ("a1d31e63351f8586e11a3702ec9870ed70c4b8dbb8d8db2baa76a65dee870370", 14350),
        ("ec49d7742c0aa22a8b5b245ad1f93fb1cb35e84adad5f9f5eb4fe6222628746e", 14308),
    ),
    "GPL-3.0": (
        ("134c296ed8d7e3aa00ee9cca5f03765514057e1acf4249df8d24d25f43714a50", 32943),
        ("6ed101a9284909a88f3fa9e939c188da9f5ed0ad8b80e4f35e427ac0ef7efc5c", 30591),
        ("7c2fb775e0f43a52415c79b457a4a4721a259fc06e8c3c2c04f7348996e59b94", 32898),
        ("b124809721bf94810a18ff2b7890473e52456440149d22e4af1157de26a07274", 30571),
    ),
    "LGPL-3.0": (
        ("b50985b3383939ad499fe106bda3850ac36c3ba459d927f7629f22a4c09be631", 6803),
    ),
    "MPL-2.0": (
        ("d048a13c4c801ec27a08e23d904b0b33f300ac6a219641f2dc32ebb16b5665fa", 14112),
    ),
}
#: Spellings that count as one, applied in this order to the form without case and punctuation.
SAME = (
    ("licence", "license"), ("licencing", "licensing"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("share alike", "sharealike"),
    ("gnu general public license", "gnu gpl"), ("gnu lesser general public license", "gnu lgpl"), ("gnu affero general public license", "gnu agpl"), ("mozilla public license", "mpl"),
    ("creative commons zero", "cc0"), ("creative commons attribution noncommercial", "cc by nc"), ("creative commons attribution sharealike", "cc by sa"),
    ("creative commons attribution noderivatives", "cc by nd"), ("creative commons attribution", "cc by"), (" version ", " v"),
)
COPYRIGHT = r"(?m)^[ \t#*/-]*(copyright[ \t]+(\(c\)|©|[0-9]{4})|\(c\)[ \t]|©)[^\n]*"


def canonical(text: Column) -> Column:
    """The canonical form, with its lines kept apart."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, ""), r"[^\p{L}\p{N}\n]+", " ")
    for a, b in SAME:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def whole(form: Column) -> Column:
    return F.trim(F.regexp_replace(form, r"[ \n]+", " "))


def entries() -> list[tuple[str, str]]:
    """(license, text) of all that is known: whole texts, and phrases that name a license."""
    named = [(lic, p.format(n)) for lic, names in NAMES.items() for n in (*names, lic) for p in PHRASES]
    return [*TEXTS.items(), *named]


def known(spark: SparkSession) -> DataFrame:
    """(license, digest, length) of distinct canonical forms; of licenses that share one the first by name."""
    forms = spark.createDataFrame(entries(), "license string, text string").select("license", whole(canonical(F.col("text"))).alias("form"))
    texts = spark.createDataFrame([(lic, *d) for lic, of in WHOLE.items() for d in of], "license string, digest string, length int")
    both = forms.select("license", F.sha2("form", 256).alias("digest"), F.char_length("form").alias("length")).unionByName(texts)
    return both.groupBy("digest").agg(F.min("license").alias("license"), F.max("length").alias("length"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", licenses: DataFrame | None = None) -> DataFrame:
    """(id_col, text_digest, license, line_licenses, n_license_lines) of every row.

    license: what the whole text is, else null; line_licenses: sorted distinct licenses that single lines are;
    n_license_lines counts those lines, repeats too. Null and empty texts have the digest of "" and no license.
    Repeated rows get equal results each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    licenses = cut(known(spark) if licenses is None else licenses)
    longest = licenses.agg(F.max("length")).first()[0] or 0  # no longer line can match
    form = docs.select(column(id_col).alias("id"), canonical(column(text_col)).alias("form"))
    lines = F.filter(F.transform(F.split("form", "\n"), lambda x: F.trim(x)), lambda x: (F.char_length(x) > 0) & (F.char_length(x) <= longest))
    listed = cut(form.select(F.monotonically_increasing_id().alias("row"), "id", F.sha2(whole(F.col("form")), 256).alias("text_digest"), F.transform(lines, lambda x: F.sha2(x, 256)).alias("lines")))
    table_ = small(licenses.select("digest", "license"))
    hits = listed.select("row", F.explode("lines").alias("digest")).join(table_, "digest").groupBy("row").agg(F.array_sort(F.collect_set("license")).alias("line_licenses"), F.count("*").alias("n_license_lines"))
    return (
        listed.join(table_.withColumnRenamed("digest", "text_digest"), "text_digest", "left").join(hits, "row", "left")
        .select(F.col("id").alias(id_col), "text_digest", "license", F.coalesce(F.array_join("line_licenses", ","), F.lit("")).alias("line_licenses"), F.coalesce("n_license_lines", F.lit(0)).alias("n_license_lines"))
    )


@tidy
def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """scan() of all documents for the known licenses; the cases are those of scan()."""
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def form(column: str) -> str:
        out = f"regexp_replace(regexp_replace(lower(coalesce({column}, '')), {quoted(COPYRIGHT)}, '', 'g'), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
        for a, b in SAME:
            out = f"replace({out}, {quoted(a)}, {quoted(b)})"
        return out

    values = ", ".join(f"({quoted(lic)}, {quoted(text)})" for lic, text in entries())
    return f"""
WITH k AS (SELECT sha256(trim(regexp_replace({form("text")}, '[ \\n]+', ' ', 'g'))) AS digest, min(license) AS license FROM (VALUES {values}) AS v(license, text) GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, {form("text")} AS form FROM documents),
h AS (
    SELECT rid, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses, count(*) AS n_license_lines
    FROM (SELECT rid, sha256(trim(unnest(string_split(form, chr(10))))) AS digest FROM d) JOIN k USING (digest) GROUP BY rid),
w AS (SELECT rid, doc_id, sha256(trim(regexp_replace(form, '[ \\n]+', ' ', 'g'))) AS text_digest FROM d)
SELECT doc_id, text_digest, license, coalesce(line_licenses, '') AS line_licenses, coalesce(n_license_lines, 0)::BIGINT AS n_license_lines
FROM w LEFT JOIN k ON w.text_digest = k.digest LEFT JOIN h USING (rid)
"""


SQL = _sql()
