"""URL filtering by fixed rules and by mined association rules.

A URL's host and path are cut out of the text after the first ``://``. Fixed rules (a host and
the beginning of a path) hold for the host and its subdomains; the longest that fits decides. For
the rest, rules mined from labelled pages decide: the tokens of a URL and its label form a
transaction, frequent combinations are mined by pattern growth, and rules from token sets to a label are
kept if they are frequent, confident, surer than the label's share of all labelled pages, and more
confident than every rule on fewer of their tokens. Frequent is a number of rows, or a share of a table
so small that it is fewer, so that a rare host can block however large the table is. Rules are found
through an inverted index: each is filed under its rarest token, a URL meets the rules filed under its
tokens and keeps those whose tokens it has all. The rule that raises its label's share most
(its lift) decides, then the more frequent, then ``block``; without any the verdict is ``allow``.

Spark's FPGrowth has no limit on the length of a combination: one URL of 30 words that is crawled three
times has 2^30 frequent ones. So the miner is PrefixSpan, Spark's pattern growth with such a limit, over
transactions in sorted order, where sequences and sets are the same: all sets of up to
``most_tokens`` tokens and a label are found, and their number grows as a power of a URL's length.

Each different URL is judged once. A null URL, or one without ``://``, has an empty host and path,
no tokens, and is allowed. Every row gets its verdict, repeated ids included; an empty table gives
no rows, and no labels give no mined rules.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil
from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.fpm import PrefixSpan
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlab.llm.common import stored

ALLOW, BLOCK = "allow", "block"
_LABELS = ("label " + ALLOW, "label " + BLOCK)


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains, and paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Mining:
    support: float = 0.02  # share of the labelled pages that is always frequent
    least_rows: int = 3  # as many rows are frequent too, in however many
    confidence: float = 0.6
    most_tokens: int = 3


def parted(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path."""
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substr(url, mark + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    lower = F.translate(host, ascii_uppercase, ascii_lowercase)
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def fitting(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or null."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def tokens(host: Column, path: Column) -> Column:
    """Different words of host and path; a number counts as ``#``."""
    names = F.transform(F.split(host, r"\."), lambda w: F.concat(F.lit("h:"), w))
    words = F.split(F.regexp_replace(F.lower(path), r"[0-9]+", "#"), r"[^a-z#]+")
    paths = F.transform(words, lambda w: F.concat(F.lit("p:"), w))
    return F.array_distinct(F.filter(F.concat(names, paths), lambda w: F.length(w) > 2))


def subsets(column: str) -> Column:
    """All subsets of a short array, in its order."""
    none = F.array(F.array().cast("array<string>"))
    return F.aggregate(
        column, none, lambda found, w: F.concat(found, F.transform(found, lambda s: F.array_append(s, w)))
    )


def mined(transactions: DataFrame, how: Mining) -> DataFrame:
    """Rules from ``transactions`` (items, label): tokens, verdict, confidence, support, lift, key."""
    items = F.array_sort(F.array_append("items", F.concat(F.lit("label "), "label")))
    sequence = F.transform(items, lambda x: F.array(x)).alias("sequence")
    rows = stored(transactions.select("label", sequence), "transactions")
    shares = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = max(1, sum(shares.values()))
    n = F.lit(total)
    least = max(1, min(ceil(how.support * total), how.least_rows))
    # Spark rounds the product of share and rows up.
    miner = PrefixSpan(
        minSupport=(least - 0.5) / total, maxPatternLength=how.most_tokens + 1, sequenceCol="sequence"
    )
    found = stored(
        miner.findFrequentSequentialPatterns(rows).select(F.flatten("sequence").alias("items"), "freq"), "itemsets"
    )
    labels = F.array(*map(F.lit, _LABELS))
    parts = found.select(
        F.array_except("items", labels).alias("tokens"),
        F.array_intersect("items", labels).alias("labels"),
        "freq",
    )
    share_of = F.when(F.col("verdict") == BLOCK, shares.get(BLOCK, 0)).otherwise(shares.get(ALLOW, 0))
    alone = parts.where("size(labels) = 0").select("tokens", F.col("freq").alias("all"))
    rules = (
        parts.where("size(labels) = 1 AND size(tokens) > 0")
        .join(alone, "tokens")
        .select(
            "tokens",
            F.substring(F.col("labels")[0], 7, 16).alias("verdict"),
            (F.col("freq") / F.col("all")).alias("confidence"),
            (F.col("freq") / n).alias("support"),
        )
        .withColumn("lift", F.col("confidence") / (share_of / n))
        .where((F.col("confidence") >= how.confidence) & (F.col("lift") > 1))
    )
    rules = stored(rules, "rules")
    # A rule says nothing new if fewer of its tokens give its verdict as confidently.
    fewer = F.filter(subsets("tokens"), lambda s: F.size(s).between(1, F.size("tokens") - 1))
    wider = rules.select(F.col("tokens").alias("_fewer"), "verdict", F.col("confidence").alias("_c"))
    needless = (
        rules.select("tokens", "verdict", "confidence", F.explode(fewer).alias("_fewer"))
        .join(wider, ["_fewer", "verdict"])
        .where("_c >= confidence")
        .select("tokens", "verdict")
        .distinct()
    )
    single = found.where("size(items) = 1").select(F.col("items")[0].alias("_one"), F.col("freq").alias("_f"))
    kept = rules.join(needless, ["tokens", "verdict"], "left_anti")
    keys = (
        kept.withColumn("_one", F.explode("tokens"))
        .join(single, "_one")
        .groupBy("tokens", "verdict", "confidence", "support", "lift")
        .agg(F.min(F.struct("_f", "_one"))["_one"].alias("key"))
    )
    return keys


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, verdict, confidence) of URLs (url, items) that some mined rule fits: of the largest lift."""
    meets = urls.withColumn("key", F.explode("items")).join(
        rules.withColumnRenamed("tokens", "needs"), "key"
    )
    fits = meets.where(F.size(F.array_except("needs", "items")) == 0)
    best = F.max(F.struct("lift", "support", (F.col("verdict") == BLOCK).alias("stop"), "confidence"))
    return (
        fits.groupBy("url")
        .agg(best.alias("b"))
        .select(
            "url",
            F.when(F.col("b.stop"), BLOCK).otherwise(ALLOW).alias("_mined"),
            F.col("b.confidence").alias("confidence"),
        )
    )


def filter_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule], how: Mining | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict and the mined rule's confidence.

    ``labels`` has ``page_id`` and ``label`` (allow or block).
    """
    how = how or Mining()
    own = pages.select("page_id", "url")
    host, path = parted(F.col("url"))
    asked = own.select("page_id", tokens(host, path).alias("items")).join(labels, "page_id")
    model = stored(mined(asked.select("items", "label"), how), "mined")
    text, verdict = fitting(rules, F.col("host"), F.col("path"))
    urls = own.where("url IS NOT NULL").select("url").distinct()
    open_urls = urls.withColumns({"host": host, "path": path}).where(text.isNull())
    answers = matched(open_urls.select("url", tokens(F.col("host"), F.col("path")).alias("items")), model)
    judged = own.withColumns({"host": host, "path": path}).join(answers, "url", "left")
    return judged.select(
        "page_id",
        "host",
        "path",
        text.alias("rule"),
        F.coalesce(verdict, "_mined", F.lit(ALLOW)).alias("verdict"),
        "confidence",
    )
