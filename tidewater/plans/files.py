"""Sources and sinks: documents are written in each form, read back by the scans, and held against the documents themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.plans.registry import Registry
from tidewater.session import load, scratch
from tidewater.sources import files as S
from tidewater.streaming.alerts import joined_parts

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

FLAT_SQL = "translate(text, chr(9) || chr(10) || chr(13), '   ')"


def flat():
    """A text on one line without tabs."""
    return F.translate("text", "\t\n\r", "   ")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


@R.add("q_csv_scan", "SELECT doc_id::VARCHAR AS doc_id, md5(text) AS text, lang FROM documents WHERE text <> ''")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV with a header, quotes and line ends inside fields."""
    path = scratch(spark, "csv")
    S.write_csv(documents(spark, sf_dir).filter("text <> ''"), path)
    return S.scan(spark, S.FileSpec("docs", path)).select("doc_id", F.md5("text").alias("text"), "lang")


@R.add("q_tsv_scan", f"SELECT lang AS label, md5({FLAT_SQL}) AS text FROM documents WHERE trim(text) <> '' AND lang IS NOT NULL")
def tsv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated lines without a header, columns by place."""
    path = scratch(spark, "tsv")
    documents(spark, sf_dir).filter("trim(text) <> '' AND lang IS NOT NULL").select(F.concat_ws("\t", "lang", flat()).alias("value")).write.text(path)
    rows = S.scan(spark, S.FileSpec("docs", path, separator="\t", header=False))
    return rows.select(F.col("_c0").alias("label"), F.md5("_c1").alias("text"))


@R.add(
    "q_tolerant_tsv",
    f"SELECT CASE WHEN doc_id % 3 > 0 THEN lang END AS label, md5(CASE WHEN doc_id % 3 = 1 THEN {FLAT_SQL} || chr(9) || 'more' ELSE {FLAT_SQL} END) AS text FROM documents WHERE lang IS NOT NULL",
)
def tolerant_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with one tab, with two, and with none."""
    path = scratch(spark, "lines")
    line = F.when(F.col("doc_id") % 3 == 0, flat()).when(F.col("doc_id") % 3 == 1, F.concat_ws("\t", "lang", flat(), F.lit("more"))).otherwise(F.concat_ws("\t", "lang", flat()))
    documents(spark, sf_dir).filter("lang IS NOT NULL").select(line.alias("value")).write.text(path)
    return S.scan_tolerant(spark, path).select("label", F.md5("text").alias("text"))


@R.add("q_malformed_lines", "SELECT doc_id::VARCHAR AS doc_id, lang FROM documents WHERE doc_id % 4 <> 0 AND lang IS NOT NULL")
def malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth line has a field too many and is skipped."""
    path = scratch(spark, "broken")
    docs = documents(spark, sf_dir).filter("lang IS NOT NULL")
    line = F.concat_ws(",", F.col("doc_id").cast("string"), "lang", F.when(F.col("doc_id") % 4 == 0, "extra"))
    # One column of whole lines, by the header's name, so that each file begins with the header.
    docs.select(line.alias("doc_id,lang")).write.csv(path, header=True, sep="\x01", quote="", escape="")
    return S.scan(spark, S.FileSpec("docs", path)).select("doc_id", "lang")


#: Bytes of texts in one JSON array.
ARRAY_BYTES = 32 << 20


@R.add("q_json_scan", "SELECT doc_id::VARCHAR AS doc_id, md5(text) AS text FROM documents WHERE text IS NOT NULL")
def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are one JSON array each, of about ARRAY_BYTES at most: an array is one value."""
    path = scratch(spark, "json")
    docs = documents(spark, sf_dir).filter("text IS NOT NULL")
    n_parts = max(16, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ARRAY_BYTES)
    rows = docs.select(F.to_json(F.struct("doc_id", "text")).alias("j"), F.pmod(F.xxhash64("doc_id"), F.lit(n_parts)).alias("part"))
    rows.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ",\n"), F.lit("]")).alias("value")).write.partitionBy("part").text(path)
    return S.scan(spark, S.FileSpec("docs", path, format="json")).select("doc_id", F.md5("text").alias("text"))


@R.add(
    "q_registry_scan",
    """SELECT md5(text) AS text, coalesce(source, 'unknown') AS label, coalesce(lang, 'xx') AS language, 'first' AS source_dataset FROM documents WHERE trim(text) <> '' AND doc_id % 2 = 0
      UNION ALL SELECT md5(text), 'unknown', 'en', 'second' FROM documents WHERE trim(text) <> '' AND doc_id % 2 = 1""",
)
def registry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of different columns, one that is missing and one without a text column, in one schema."""
    docs = documents(spark, sf_dir)
    paths = {name: scratch(spark, name) for name in ("first", "second", "fourth")}
    S.write_csv(docs.filter("doc_id % 2 = 0").select(F.col("text").alias("Message"), F.col("source").alias("Category"), F.col("lang").alias("language")), paths["first"])
    S.write_csv(docs.filter("doc_id % 2 = 1").select("doc_id", F.col("text").alias("CONTENT")), paths["second"])
    S.write_csv(docs.select("doc_id"), paths["fourth"])
    specs = [
        S.FileSpec("first", paths["first"], language=("language",), default_language="xx"),
        S.FileSpec("second", paths["second"], default_language="en"),
        S.FileSpec("third", scratch(spark, "missing")),
        S.FileSpec("fourth", paths["fourth"]),
    ]
    return S.scan_registry(spark, specs).withColumn("text", F.md5("text"))


@R.add(
    "q_sniffed_scan",
    f"SELECT 'comma' AS kind, doc_id::VARCHAR AS doc_id, md5({FLAT_SQL}) AS text FROM documents WHERE trim(text) <> '' UNION ALL SELECT 'tab', doc_id::VARCHAR, md5(replace({FLAT_SQL}, '\"', '')) FROM documents WHERE trim(text) <> ''",
)
def sniffed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with commas and one with tabs, each read by the separator that its first line shows."""
    docs = documents(spark, sf_dir).filter("trim(text) <> ''")
    out = []
    for kind, separator, text in (("comma", ",", flat()), ("tab", "\t", F.replace(flat(), F.lit('"'), F.lit("")))):
        path = scratch(spark, kind)
        rows = docs.select("doc_id", text.alias("text"))
        if kind == "comma":
            S.write_csv(rows, path)
        else:
            rows.write.csv(path, header=True, sep=separator, quote="", escape="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        found = S.scan(spark, S.FileSpec(kind, path, separator=S.sniff_separator(spark, path)))
        out.append(found.select(F.lit(kind).alias("kind"), "doc_id", F.md5("text").alias("text")))
    return out[0].unionByName(out[1])


LATIN_SQL = "regexp_replace(translate(text, chr(9) || chr(10) || chr(13), '   '), '[^ -~À-ÿ]', '', 'g')"


@R.add("q_encoding_fallback", f"SELECT kind, md5({LATIN_SQL}) AS text FROM documents, (VALUES ('ISO-8859-1'), ('UTF-8')) k(kind) WHERE lang = 'fr'")
def encoding_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines in two encodings; that which isn't UTF-8 is read as Latin-1."""
    lines = documents(spark, sf_dir).filter("lang = 'fr'").select(F.regexp_replace(flat(), "[^ -~À-ÿ]", "").alias("value"))
    out = None
    for kind in ("ISO-8859-1", "UTF-8"):
        path = scratch(spark, "encoded")
        lines.write.option("encoding", kind).csv(path, quote="", escape="", sep="\x01", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        found = S.fitting_encoding(spark, path)
        rows = spark.read.csv(path, encoding=found, quote="", escape="", sep="\x01", schema="value string").select(F.lit(found).alias("kind"), F.md5("value").alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out


@R.add("q_language_files", "SELECT doc_id::VARCHAR AS doc_id, md5(text) AS text, lang AS language FROM documents WHERE lang IN ('en', 'fr') AND text <> ''")
def language_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each language; rows of other languages are not written."""
    path = scratch(spark, "languages")
    rows = documents(spark, sf_dir).filter("text <> ''").select("doc_id", F.translate("text", "\n\r", "  ").alias("text"), F.md5("text").alias("digest"), F.col("lang").alias("language"))
    S.write_by_language(rows, path, ("en", "fr"))
    back = spark.read.csv(path, header=True, escape='"', schema="doc_id string, text string, digest string, language string")
    return back.select("doc_id", F.col("digest").alias("text"), "language")


@R.add("q_inventory", "SELECT lang AS name, count(*) + 1 AS n_lines, 'doc_id,source' AS header FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and header of each file found below a folder."""
    path = scratch(spark, "inventory")
    rows = documents(spark, sf_dir).filter("lang IS NOT NULL").select("doc_id", "source", "lang")
    rows.write.partitionBy("lang").csv(path, header=True)
    found = S.inventory(spark, path).withColumn("name", F.regexp_extract("path", "lang=([^/]+)/", 1))
    # Each file has its header; a folder's lines are counted with one.
    return found.groupBy("name", "header").agg((F.sum("n_lines") - F.count("*") + 1).alias("n_lines"))


@R.add(
    "q_multipart_messages",
    """WITH m AS (SELECT conv_id AS message_id, trim(string_agg(text, '' ORDER BY turn, text)) AS text, min(CASE WHEN role = 'user' THEN role END) AS sender FROM conversations GROUP BY conv_id)
      SELECT message_id, md5(text) AS text, coalesce(nullif(trim(sender), ''), 'Unknown') AS sender FROM m WHERE text <> ''""",
)
def multipart_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    sender = F.when(F.col("role") == "user", F.col("role"))
    parts = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("message_id"), F.col("turn").alias("part"), F.col("text").alias("body"), sender.alias("sender"))
    return joined_parts(parts).select("message_id", F.md5("text").alias("text"), "sender")
