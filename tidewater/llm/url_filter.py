"""URL filters: prefix rules, and boosted trees on lexical features for what no rule fits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import LOWER, UPPER, let, written
from tidewater.session import load


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


@dataclass(frozen=True)
class UrlParams:
    """sample bounds the distinct labelled URLs that the trees are fitted on, half of them for each label."""

    sample: int = 10_000
    trees: int = 10
    depth: int = 3
    smoothing: float = 5.0
    seed: int = 5


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...], what: str) -> Column:
    """`what` (name or verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.lit(getattr(rule, what))).otherwise(found)
    return found


def entropy(text: Column) -> Column:
    """Bits per character of a text's own characters; 0 for the empty text."""
    n = F.char_length(text)
    each = F.transform(
        F.array_distinct(F.split(text, "")),
        lambda c: let((n - F.char_length(F.replace(text, c, F.lit("")))) / n, lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(0.0)),
    )
    return F.when(n > 0, F.aggregate(each, F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def section_of(host: Column, path: Column) -> Column:
    """The suffix of a host with the first part of the path."""
    return F.concat_ws("/", suffix_of(host), F.coalesce(F.get(F.split(path, "/", 3), F.lit(1)), F.lit("")))


#: Columns of values whose share of blocked URLs is a feature.
SHARES = {"suffix": "f_suffix", "section": "f_section"}


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of the characters of a URL."""
    n = F.char_length(url)
    count = lambda s, c: (F.char_length(s) - F.char_length(F.replace(s, F.lit(c), F.lit("")))).cast("double")
    return {
        "f_length": n.cast("double"),
        "f_host_length": F.char_length(host).cast("double"),
        "f_depth": count(path, "/"),
        "f_labels": count(host, "."),
        "f_hyphens": count(host, "-"),
        "f_digits": F.when(n > 0, (n - F.char_length(F.translate(url, "0123456789", ""))) / n).otherwise(0.0),
        "f_parameters": count(url, "&") + count(url, "="),
        "f_entropy": entropy(host),
    }


def with_features(urls: DataFrame) -> DataFrame:
    """`urls` with host, path, and a column per feature; null urls are empty."""
    url = F.coalesce("url", F.lit(""))
    parts = urls.withColumns({"host": host_of(url), "path": path_of(url)})
    return parts.withColumns(lexical(url, F.col("host"), F.col("path")) | {"suffix": suffix_of(F.col("host")), "section": section_of(F.col("host"), F.col("path"))})


class UrlModel:
    """Boosted trees with the label shares of the host suffixes and sections they were fitted on."""

    def __init__(self, labelled: DataFrame, params: UrlParams) -> None:
        """labelled: url and `block` (0 or 1). The sample is of distinct URLs, those with the least hashes:
        up to params.sample / 2 of each label, so neither copies of a URL nor a frequent label fill it."""
        spark = labelled.sparkSession
        most, space = max(1, params.sample // 2), 1 << 50
        order = F.xxhash64("url", F.lit(params.seed))
        sample = labelled.limit(0)
        for r in labelled.groupBy("block").agg(F.approx_count_distinct("url").alias("n")).orderBy("block").collect():  # two rows at most
            # About half as much again as wanted pass the filter, so that few URLs are left to be told apart and ordered.
            near = F.pmod(order, F.lit(space)) < int(space * min(1.0, 1.5 * most / max(r["n"], 1)))
            own = labelled.filter((F.col("block") == r["block"]) & near).dropDuplicates(["url"])
            sample = sample.union(own.orderBy(order, "url").limit(most))
        sample = written(with_features(sample).coalesce(1), "urls")
        total = sample.agg(F.count("*").alias("n"), F.sum("block").alias("block")).first()
        self.share = (total["block"] or 0) / total["n"] if total["n"] else 0.0
        # At most one row per row of the sample.
        self.rates = {}
        for column, feature in SHARES.items():
            share = (F.sum("block") + params.smoothing * self.share) / (F.count("*") + params.smoothing)
            self.rates[column] = written(sample.groupBy(column).agg(share.alias(feature)).coalesce(1), "rates")
        features = [c for c in sample.columns if c.startswith("f_")] + list(SHARES.values())
        self.assembler = VectorAssembler(inputCols=features, outputCol="features")
        self.model = None
        if 0 < self.share < 1:
            trees = GBTClassifier(
                labelCol="block", maxIter=params.trees, maxDepth=params.depth, seed=params.seed, cacheNodeIds=False, checkpointInterval=-1
            )
            table = self.assembler.transform(self._rated(sample)).select("features", F.col("block").cast("double").alias("block"))
            self.model = trees.fit(table)
        self.spark = spark

    def _rated(self, urls: DataFrame) -> DataFrame:
        for column, feature in SHARES.items():
            urls = urls.join(F.broadcast(self.rates[column]), column, "left").fillna({feature: self.share})
        return urls

    def verdict(self, urls: DataFrame) -> DataFrame:
        """`urls` (with features) and the probability `p_block`; with one class of labels alone, its share."""
        if self.model is None:
            return urls.withColumn("p_block", F.lit(float(self.share)))
        from pyspark.ml.functions import vector_to_array

        scored = self.model.transform(self.assembler.transform(self._rated(urls)))
        return scored.withColumn("p_block", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, params: UrlParams = UrlParams()) -> DataFrame:
    """page_id, host, path, rule, verdict and p_block of every row of `pages`.

    Where a rule fits it decides, and gives a labelled URL to learn from; for the rest the trees do, which
    block from p_block 0.5 on. Null urls and urls without :// have an empty host and path and are judged by
    the trees. Repeated rows agree; an empty table gives an empty result. Other columns are ignored.
    """
    own = pages.select("page_id", "url")
    ruled = lambda df: df.withColumns(
        {"rule": rule_for(F.col("host"), F.col("path"), rules, "name"), "ruled": rule_for(F.col("host"), F.col("path"), rules, "verdict")}
    )
    parts = own.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    labelled = ruled(parts).filter("ruled IS NOT NULL").select("url", (F.col("ruled") == "block").cast("int").alias("block"))
    scored = ruled(UrlModel(labelled, params).verdict(with_features(own)))
    by_trees = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_trees).alias("verdict"), "p_block")


def op3_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL."""
    return judge(load(spark, sf_dir, "pages"))
