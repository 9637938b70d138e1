"""File scans mapped onto one schema, and the sinks of corpus builds. Only headers and listings reach the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "text string, label string, language string, source_dataset string"


@dataclass(frozen=True)
class FileSpec:
    """One file or folder of a registry; columns are given by candidate names, or by place where there is no header."""

    name: str
    path: str
    text: Sequence[str] = ("text", "message", "content")
    label: Sequence[str] = ("label", "category", "class")
    language: Sequence[str] = ()
    default_language: str | None = None
    separator: str = ","
    header: bool = True
    encoding: str = "UTF-8"
    format: str = "csv"


def resolve(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The first candidate that is a column, whatever its case."""
    known = {c.strip().lower(): c for c in reversed(columns)}
    return next((known[c.lower()] for c in candidates if c.lower() in known), None)


def scan(spark: SparkSession, spec: FileSpec) -> DataFrame:
    """The file's columns as strings; CSV lines that don't fit are dropped, JSON may be one array."""
    if spec.format == "json":
        return spark.read.json(spec.path, multiLine=True, encoding=spec.encoding, primitivesAsString=True)
    quote = "" if spec.separator == "\t" else '"'
    options = {"sep": spec.separator, "header": spec.header, "encoding": spec.encoding, "quote": quote, "escape": quote, "mode": "DROPMALFORMED"}
    return spark.read.csv(spec.path, multiLine=spec.separator != "\t", **options)


def sniff_separator(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """A tab where the file's first line has one and no comma, else a comma. One line reaches the driver."""
    first = spark.read.option("encoding", encoding).text(path).limit(1).first()
    line = first["value"] if first is not None and first["value"] is not None else ""
    return "\t" if "\t" in line and "," not in line else ","


def fitting_encoding(spark: SparkSession, path: str, fallback: str = "ISO-8859-1") -> str:
    """UTF-8 where every line of every file at the path is valid UTF-8, else the fallback. Lines come as the bytes that they
    are, so files of any size are split, and the first bad line ends the search of its task."""
    broken = spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1).count()
    return fallback if broken else "UTF-8"


def write_csv(rows: DataFrame, path: str, separator: str = ",") -> None:
    """UTF-8 CSV with a header, every field quoted, blanks and line ends kept; `scan` reads it back."""
    rows.write.mode("overwrite").csv(path, header=True, sep=separator, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def scan_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """Lines as label and text, cut at the first tab; a line without one is text with a null label."""
    parts = F.split("value", "\t", 2)
    cut = F.size(parts) == 2
    return spark.read.text(path).select(F.when(cut, parts[0]).alias("label"), F.when(cut, parts[1]).otherwise(parts[0]).alias("text"))


def scan_registry(spark: SparkSession, specs: Sequence[FileSpec], need_label: bool = False) -> DataFrame:
    """Rows of all files in one schema.

    A file that is missing, or lacks the text column (or the label column where one is needed), adds no rows. Otherwise a
    missing label is 'unknown' and a missing language the file's default. Blank texts and the text 'nan' are dropped.
    """
    frames = [spark.createDataFrame([], SCHEMA)]
    for spec in specs:
        try:
            rows = scan(spark, spec)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        text, label, language = (resolve(rows.columns, names) for names in (spec.text, spec.label, spec.language))
        if text is None or (need_label and label is None):
            continue
        value = lambda name, default: F.coalesce(F.col(f"`{name}`").cast("string") if name else F.lit(None).cast("string"), F.lit(default))
        kept = rows.select(
            F.col(f"`{text}`").cast("string").alias("text"),
            value(label, "unknown").alias("label"),
            value(language, spec.default_language).alias("language"),
            F.lit(spec.name).alias("source_dataset"),
        )
        frames.append(kept.filter((F.trim("text") != "") & (F.lower(F.trim("text")) != "nan")))
    return reduce(DataFrame.unionByName, frames)


def discover(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """path and bytes of the files below the folder; the listing is Spark's own, contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("bytes"))


def inventory(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """path, lines and header (the first line) of each file below the folder, in one pass with partial aggregates."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = lines.select(F.col("_metadata.file_path").alias("path"), place.alias("place"), "value")
    return lines.groupBy("path").agg(F.count("*").alias("n_lines"), F.min_by("value", "place").alias("header"))


def write_by_language(corpus: DataFrame, path: str, languages: Sequence[str] = ("uz", "ru", "en")) -> None:
    """CSV folders language=…; rows of other languages are not written. Rows stay where they are: no shuffle."""
    corpus.filter(F.col("language").isin(*languages)).write.partitionBy("language").mode("overwrite").csv(path, header=True, escape='"')


def checksum(rows: DataFrame, *columns: str) -> DataFrame:
    """Count and digest of the rows, the same in whatever order or however many files they lie; nulls differ from empty texts."""

    def field(name: str) -> Column:
        text = F.col(f"`{name}`").cast("string")
        return F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    digest = F.md5(F.concat_ws(",", *(field(c) for c in columns or rows.columns)))
    half = lambda start: F.sum(F.conv(F.substring(digest, start, 8), 16, 10).cast("decimal(38,0)"))
    sums = [F.coalesce(half(1 + 8 * k), F.lit(0)).cast("string") for k in range(4)]
    return rows.agg(F.count("*").alias("n_rows"), F.md5(F.concat_ws(",", *sums)).alias("digest"))
