"""Fill-in-the-middle training texts by escaped marks: units are counted and cut out with string functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import let
from tidewater.session import load

#: The control strings of the output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The mark that ends a unit, and the character that escapes it and itself within texts.
MARK, ESCAPE = "\x1e", "\x1f"
ESCAPED_MARK, ESCAPED_ESCAPE = ESCAPE + "m", ESCAPE + "e"
#: Patterns of a unit over an escaped text; each covers every text without a gap.
UNITS = {
    "code_point": f"(?s){ESCAPE}[me]|.",
    "word": r"[^ \t\n]*[ \t\n]+|[^ \t\n]+",
    "line": r"[^\n]*\n|[^\n]+",
}


def escape(text: Column) -> Column:
    """`text` without MARK, reversibly."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPED_ESCAPE)), F.lit(MARK), F.lit(ESCAPED_MARK))


def unescape(part: Column) -> Column:
    """A part of a marked text without its marks, as it was before `escape`."""
    plain = F.replace(F.replace(part, F.lit(MARK), F.lit("")), F.lit(ESCAPED_MARK), F.lit(MARK))
    return F.replace(plain, F.lit(ESCAPED_ESCAPE), F.lit(ESCAPE))


def mark_units(text: Column, unit: str = "code_point") -> Column:
    """`text`, escaped, with MARK after each unit."""
    return F.regexp_replace(escape(text), F.lit(UNITS[unit]), F.lit("$0" + MARK))


def count_units(marked: Column) -> Column:
    """The units of a marked text."""
    return (F.char_length(marked) - F.char_length(F.replace(marked, F.lit(MARK), F.lit("")))).cast("long")


def cut(marked: Column, n: Column, low: Column, high: Column) -> Column:
    """Prefix, middle and suffix of a marked text of n units, cut after `low` and `high` units (low <= high)."""
    return F.struct(
        unescape(F.call_function("substring_index", marked, F.lit(MARK), low)).alias("prefix"),
        # The first `high` units end without a mark, so the last of them follow as many marks as there are units.
        unescape(F.call_function("substring_index", F.call_function("substring_index", marked, F.lit(MARK), high), F.lit(MARK), low - high)).alias("middle"),
        # All of the text ends with a mark: one more.
        unescape(F.call_function("substring_index", marked, F.lit(MARK), high - n - 1)).alias("suffix"),
    )


def draws(doc_id: Column, seed: int = 1) -> Column:
    """Four numbers below 2^32 of a document: the first 8-digit groups of a seeded SHA-256 of its id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return let(digest, lambda d: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substr(d, i * 8 + 1, F.lit(8)), 16, 10).cast("long")))


def assemble(form: Column, parts: Column, text: Column) -> Column:
    """The training text of a form: prefix-suffix-middle, suffix-prefix-middle, or the plain text."""
    first, second = F.concat(F.lit(PREFIX), parts["prefix"]), F.concat(F.lit(SUFFIX), parts["suffix"])
    last = F.concat(F.lit(MIDDLE), parts["middle"])
    return F.when(form == "psm", F.concat(first, second, last)).when(form == "spm", F.concat(second, first, last)).otherwise(text)


def restore(output: Column, form: Column) -> Column:
    """The text that `assemble` made an output of. The control strings occur once each in what isn't plain: the
    parts hold none, and none begins with the end of another, so that no two overlap."""

    def after(mark: str) -> Column:
        return F.substring_index(output, mark, -1)

    psm = F.concat(F.substring_index(after(PREFIX), SUFFIX, 1), after(MIDDLE), F.substring_index(after(SUFFIX), MIDDLE, 1))
    spm = F.concat(F.substring_index(after(PREFIX), MIDDLE, 1), after(MIDDLE), F.substring_index(after(SUFFIX), PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, unit: str = "code_point", plain_percent: int = 10, spm_percent: int = 20, seed: int = 1) -> DataFrame:
    """One row per row of `docs`: doc_id, n (units), form, the cuts `low` and `high`, `parts` and `output`.

    Cuts and form follow from the seed and doc_id alone, so repeated rows give equal rows and an id's texts the same
    draws; a null doc_id draws like the empty string. Null texts count as empty. Empty texts and texts that hold a
    control string stay plain, with null parts and cuts. Other columns are ignored. Nothing is shuffled. A text is
    marked whole: marks and escapes make it at most four times as long, so texts of up to 500 million bytes fit a row.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), draws(F.col("doc_id"), seed).alias("h"))
    holds = F.contains(F.col("text"), F.lit(PREFIX)) | F.contains(F.col("text"), F.lit(SUFFIX)) | F.contains(F.col("text"), F.lit(MIDDLE))
    plain = (F.col("text") == "") | holds | (F.get("h", F.lit(2)) % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.get("h", F.lit(3)) % 100 < spm_percent, "spm").otherwise("psm")

    def ranks(marked: Column) -> Column:
        def make(n: Column) -> Column:
            a, b = F.get("h", F.lit(0)) % (n + 1), F.get("h", F.lit(1)) % (n + 1)
            return F.struct(marked.alias("marked"), n.alias("n"), F.least(a, b).cast("int").alias("low"), F.greatest(a, b).cast("int").alias("high"))

        return let(count_units(marked), make)

    def with_parts(m: Column) -> Column:
        parts = F.when(F.col("form") != "plain", cut(m["marked"], m["n"].cast("int"), m["low"], m["high"]))
        return F.struct(m["n"].alias("n"), m["low"].alias("low"), m["high"].alias("high"), parts.alias("parts"))

    made = rows.withColumn("form", form).withColumn("made", let(mark_units(F.col("text"), unit), lambda m: let(ranks(m), with_parts)))
    shown = F.col("form") != "plain"
    return made.select(
        "doc_id",
        F.col("made.n").alias("n"),
        "form",
        F.when(shown, F.col("made.low")).alias("low"),
        F.when(shown, F.col("made.high")).alias("high"),
        F.col("made.parts").alias("parts"),
        assemble(F.col("form"), F.col("made.parts"), F.col("text")).alias("output"),
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by code points; the digests are of the output and of what it restores to."""
    made = fill_in_middle(load(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        F.char_length("parts.prefix").cast("long").alias("prefix_chars"),
        F.char_length("parts.middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
    ('0x' || substr(h, 17, 8))::BIGINT % 100 AS p, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS q FROM d),
f AS (
  SELECT *, least(a, b) AS lo, greatest(a, b) AS hi, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
    OR p >= 90 THEN 'plain' WHEN q < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
o AS (
  SELECT *, substr(text, 1, lo) AS x, substr(text, lo + 1, hi - lo) AS y, substr(text, hi + 1) AS z FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN lo END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y WHEN 'spm' THEN '<S>' || z || '<P>' || x || '<M>' || y ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM o
"""
