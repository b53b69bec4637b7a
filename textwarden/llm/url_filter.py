"""URL filters: host and path rules first, gradient-boosted trees for the rest.

A rule fits a host and all its subdomains if the path starts with the rule's; the
longest fitting rule decides.  URLs that rules decide are the labelled ones: trees are
boosted on lexical features of them (lengths, depth, digit ratio, entropy, parameter
counts, statistics of the host's suffix) and judge the URLs that no rule fits.

Suffix statistics count every labelled URL; trees are fitted on at most ``MOST_URLS``
of them, taken by a hash.  Everything but the boosting itself is native expressions.

Defined results: a null url, or one without ``://``, has an empty host and path, fits
no rule and is judged on its features like any other; without any labelled URL the
verdict is allow, with labels of one kind it is that kind; repeated rows are judged
each; other columns, whatever their names, don't take part.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm.common import ascii_lower, corpus

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MOST_URLS, MOST_SUFFIXES = 20_000, 100_000
TREES, DEPTH, FOLDS = 20, 4, 5
FEATURES = (
    "url_length", "host_length", "path_length", "host_labels", "path_depth", "digit_ratio", "entropy",
    "parameters", "hyphens", "secure", "suffix_rate", "suffix_support",
)


def parted(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path)."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract("url", whole, k), F.lit(""))
    return pages.select("page_id", "url", ascii_lower(part(1)).alias("host"), part(2).alias("path"))


def with_rules(urls: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``rule`` and ``ruled``, the text and verdict of the longest fitting rule, or nulls."""
    fits = []
    for verdict, rule in rules:
        host, slash, rest = rule.partition("/")
        fit = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(slash + rest))
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    best = F.array_max(F.array_compact(F.array(*fits)))
    return urls.withColumn("r", best).select(*urls.columns, F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"))


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the features of a URL's own text, and its suffix: the last two labels of its host."""
    url = F.coalesce("url", F.lit(""))
    n = F.length(url)
    signs = F.filter(F.split(url, ""), lambda c: c != "")
    share = lambda c: F.size(F.filter("signs", lambda x: x == c)) / F.size("signs")
    entropy = F.aggregate(F.array_distinct("signs"), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    count = lambda pattern, of=url: F.regexp_count(of, F.lit(pattern)).cast("double")
    return (
        urls.withColumn("signs", signs)
        .withColumn("url_length", n.cast("double"))
        .withColumn("host_length", F.length("host").cast("double"))
        .withColumn("path_length", F.length("path").cast("double"))
        .withColumn("host_labels", count(r"[^.]+", F.col("host")))
        .withColumn("path_depth", count("/", F.col("path")))
        .withColumn("digit_ratio", count("[0-9]") / F.greatest(n, F.lit(1)))
        .withColumn("entropy", entropy)
        .withColumn("parameters", count(r"[?&][^?&#]"))
        .withColumn("hyphens", count("-"))
        .withColumn("secure", F.startswith(url, F.lit("https")).cast("double"))
        .withColumn("suffix", F.substring_index("host", ".", -2))
        .drop("signs")
    )


def with_suffixes(urls: DataFrame) -> DataFrame:
    """Adds how often labelled URLs of the same suffix are blocked, smoothed, and how many there are.

    For a labelled URL only those of other folds count, so its own label is never in
    its features.  Folds go by a hash of the URL, and equal URLs share one.
    """
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")
    blocked = F.sum((F.col("ruled") == "block").cast("long"))
    per_fold = urls.where("ruled is not null").groupBy("suffix", fold.alias("fold")).agg(F.count("*").alias("n"), blocked.alias("b"))
    known = per_fold.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", "b")))).alias("folds"))
    small = known.limit(MOST_SUFFIXES + 1).count() <= MOST_SUFFIXES
    out = urls.join(F.broadcast(known) if small else known, "suffix", "left")
    own = F.when(F.col("ruled").isNotNull(), F.col("folds")[fold])
    n, b = (F.coalesce(F.col(c), F.lit(0)) - F.coalesce(own[c], F.lit(0)) for c in ("n", "b"))
    return out.withColumn("suffix_rate", (b + 1) / (n + 2)).withColumn("suffix_support", F.log1p(n.cast("double"))).drop("n", "b", "folds")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every page."""
    urls = with_rules(parted(pages), rules)
    kinds = {r["ruled"]: r["n"] for r in urls.where("ruled is not null").groupBy("ruled").agg(F.count("*").alias("n")).collect()}
    out = ("page_id", "host", "path", "rule")
    if len(kinds) < 2:
        only = next(iter(kinds), "allow")
        return urls.select(*out, F.coalesce("ruled", F.lit(only)).alias("verdict"), F.lit(float(only == "block")).alias("score"))
    rows = with_suffixes(lexical(urls))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    sample = (
        rows.where("ruled is not null")
        .select("features", (F.col("ruled") == "block").cast("double").alias("label"), F.xxhash64("url", "page_id").alias("h"))
        .orderBy("h")
        .limit(MOST_URLS)
    )
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, cacheNodeIds=False).fit(sample.select("features", "label"))
    score = vector_to_array("probability")[1]
    verdict = F.coalesce("ruled", F.when(score >= 0.5, "block").otherwise("allow"))
    return trees.transform(rows).select(*out, verdict.alias("verdict"), score.alias("score"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every url of ``pages``."""
    return judge(corpus(spark, sf_dir, "pages").select("page_id", "url"))
