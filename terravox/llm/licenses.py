"""Operator 5: license scans by canonical digests, in DataFrame operations only.

A whole text is brought to a canonical form: ASCII letters in lower case, lines that hold only a copyright statement
left out, British spellings turned into American ones by their endings, everything but letters and digits turned into
single spaces. The SHA-256 of that form is joined with the digests of known licences. That table is bounded by the
number of known licences and their titles, so it is broadcast and texts are never shuffled.

Dropping lines makes the form hang on where lines break. A text that mentions a copyright is therefore looked up in two
more forms: one with nothing left out, and one without copyright statements only (the word or sign, a sign or a year, a
name up to the end of its line or the first words of a licence). Known texts are in the table in all three.

Null, empty and blank texts have the canonical form "" and match nothing. Rows keep their number and order of columns
does not matter; of extra columns none is read. Repeated rows give repeated results. Two licences of one canonical form
would be one row of the known table, with the alphabetically first id.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .license_texts import LICENSES

#: Replacements in this order, in syntax that Java's and RE2's patterns share. The text ends with a space by then.
COPYRIGHT_LINE = r"(^|\n)[ \t\r#*/;-]*(portions )?(copyright|\(c\)|\x{A9}|all rights reserved)[^\n]*"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x{A0}\x{A9}\x{AB}\x{BB}\x{2010}-\x{2015}\x{2018}-\x{201F}\x{2022}]+"
#: Endings of equivalent spellings: -ise/-ize, -our/-or, -ence/-ense, -ogue/-og, after three letters, so that short words
#: ("four" and "for", "hence", "rise") stay apart.
SPELLINGS = ((r"([a-z]{3})is(e|ed|es|er|ers|ing|ation|ations) ", "$1iz$2 "), (r"([a-z]{3})our(s|ed|ing|able)? ", "$1or$2 "), (r"([a-z]{3})ence(s|d)? ", "$1ense$2 "), (r"([a-z]{3})ogue(s|d)? ", "$1og$2 "), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"), ("https ", "http "))
#: In lower-case text: a mention of copyright, and a statement of it, which ends with the line or where a licence begins.
MENTION = r"copyright|\(c\)|\x{A9}|all rights reserved"
STATEMENT = (
    r"(portions\s+)?(copyright\s*(\(c\)|\x{A9}|(?=[\s:]*(19|20)\d\d))|(\(c\)|\x{A9})(?=\s*(19|20)\d\d))[^\n]*?"
    r"(?=\n|$|permission\s+(is|to)\s|redistribution\s+and\s+use|this\s+(software|program|library|work|is\s+free)|licensed\s+under|released\s+under|everyone\s+is\s+permitted|all\s+rights\s+reserved)|all\s+rights\s+reserved\.?"
)
#: Entire texts of longer licences, one file an SPDX id.
FILES = Path(__file__).parent / "license_files"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column, left_out: str | None = COPYRIGHT_LINE) -> Column:
    """Canonical form of a text column without what a pattern matches; null is empty."""
    x = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    x = F.concat(F.trim(F.regexp_replace(F.regexp_replace(x, left_out, "\n") if left_out else x, NOT_WORD, " ")), F.lit(" "))
    for pattern, to in SPELLINGS:
        x = F.regexp_replace(x, pattern, to) if "(" in pattern else F.replace(x, F.lit(pattern), F.lit(to))
    return F.trim(x)


def known(spark: SparkSession, licenses: dict[str, tuple[tuple[str, ...], str]] | None = None) -> DataFrame:
    """Rows (digest, license_id): each licence with and without each of its titles, in each form."""
    rows = [(k, f"{title}\n\n{text}") for k, (titles, text) in (LICENSES if licenses is None else licenses).items() for title in ("", *titles)]
    if licenses is None:
        rows += [(f.stem, f.read_text(encoding="utf-8")) for f in sorted(FILES.glob("*.txt"))]
    table = spark.createDataFrame(rows, "license_id string, text string")
    forms = F.array(*(canonical(F.col("text"), x) for x in (COPYRIGHT_LINE, None, STATEMENT)))
    table = table.select("license_id", F.explode(forms).alias("form")).where("form <> ''")
    return table.select(F.sha2("form", 256).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, licenses: DataFrame) -> DataFrame:
    """Rows (doc_id, n_canonical, digest, license_id), one per row of docs; license_id is null where nothing matches."""
    mentions = F.lower(F.col("text").cast("string")).rlike(MENTION)
    more = {k: F.when(mentions, F.sha2(canonical(F.col("text"), x), 256)).alias(k) for k, x in (("_plain", None), ("_bare", STATEMENT))}
    form = docs.select("doc_id", canonical(F.col("text")).alias("form"), *more.values())
    digests = form.select("doc_id", F.length("form").cast("long").alias("n_canonical"), F.sha2("form", 256).alias("digest"), *more)
    for k in ("digest", *more):
        digests = digests.join(F.broadcast(licenses.select(F.col("digest").alias(k), F.col("license_id").alias(f"_id{k}"))), k, "left")
    return digests.select("doc_id", "n_canonical", "digest", F.coalesce("_iddigest", "_id_plain", "_id_bare").alias("license_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir), known(spark))


def oracle() -> str:
    """The same in DuckDB SQL."""

    def sql(text: str) -> str:
        quote = lambda s: "'" + s.replace("'", "''") + "'"
        x = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
        x = f"regexp_replace(regexp_replace({x}, {quote(COPYRIGHT_LINE)}, chr(10), 'g'), {quote(NOT_WORD)}, ' ', 'g')"
        x = f"(trim({x}) || ' ')"
        for pattern, to in SPELLINGS:
            x = f"regexp_replace({x}, {quote(pattern)}, {quote(to.replace('$', chr(92)))}, 'g')" if "(" in pattern else f"replace({x}, {quote(pattern)}, {quote(to)})"
        return f"trim({x})"

    rows = ", ".join("('{}', '{}')".format(k, f"{t}\n\n{text}".replace("'", "''")) for k, (titles, text) in LICENSES.items() for t in ("", *titles))
    return f"""WITH known AS (SELECT sha256({sql("text")}) AS digest, min(license_id) AS license_id FROM (VALUES {rows}) t(license_id, text) GROUP BY 1),
forms AS (SELECT doc_id, {sql("text")} AS form FROM documents)
SELECT doc_id, CAST(length(form) AS BIGINT) AS n_canonical, sha256(form) AS digest, license_id FROM forms LEFT JOIN known ON sha256(form) = digest"""
