"""URL filters: host-suffix and path-prefix expressions joined to rules on short hash prefixes.

Each URL expands into expressions: a suffix of its host at a label boundary with a prefix of its
path. First the suffixes of the distinct hosts, up to as many labels as any rule has, meet the rules'
hosts; then a URL's path is cut only to the lengths that the rules of a fitting host have. That is
exact and bounds the work for any URL and any number of rules. Both steps are equi-joins on the first
bytes of a SHA-256; the full digest then confirms, and the longest rule wins.

The joins run on distinct hosts and URLs, and the verdicts, written first, go back to the rows: so
both sides of that join are plain, and a hot URL can be split. Tables of at most ``BROADCAST_RULES``
rows are broadcast; larger ones are joined by shuffle.

Defined results: null URLs and those without ``://`` have an empty host and path and fit no rule;
no fitting rule gives a null rule and the default verdict; repeated rows keep their rows; an empty
table gives an empty result; without rules all get the default; rules with a null or an empty host or
a null path fit nothing; of equally long rules ``block`` wins, then the one that sorts last; result
columns replace columns of the same name, and all others are kept, of any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincart.llm.common import boxed, durable

#: Rules that are broadcast at most (a few hundred bytes each).
BROADCAST_RULES = 50_000
#: Hex digits of the hash prefix that the join uses.
PREFIX_DIGITS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII capitals lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both sides with one ``full`` digest: joined on its first digits, confirmed by all."""
    right = durable(right.withColumn("prefix", F.substring("full", 1, PREFIX_DIGITS)).withColumnRenamed("full", "confirmed"))
    if right.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        right = F.broadcast(right)
    return left.withColumn("prefix", F.substring("full", 1, PREFIX_DIGITS)).join(right, "prefix").where("full = confirmed").drop("prefix", "full", "confirmed")


def verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the distinct URLs (host, path) that a rule fits."""
    known = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & (F.col("host") != ""))
    known = known.groupBy(F.translate("host", _UPPER, _LOWER).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    most = known.agg(F.max(_labels(F.col("host")))).first()[0] or 0
    if not most:
        return urls.select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).limit(0)
    urls = durable(urls.where("host != ''").distinct())
    labels = "length(host) - length(replace(host, '.', '')) + 1"
    suffixes = F.expr(f"transform(sequence(1, least({labels}, {most})), n -> substring_index(host, '.', -n))")
    hosts = urls.select("host").distinct().select("host", F.explode(suffixes).alias("suffix")).withColumn("full", _digest(F.col("suffix")))
    sizes = known.groupBy("host").agg(F.collect_set(F.length("path")).alias("sizes")).select(_digest(F.col("host")).alias("full"), "sizes")
    fitting = durable(_met(hosts, sizes))
    if fitting.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        fitting = F.broadcast(fitting)
    cut = urls.join(fitting, "host").select("host", "path", "suffix", F.explode("sizes").alias("size")).where("size <= length(path)")
    expressions = cut.select("host", "path", _digest(F.col("suffix"), F.expr("substring(path, 1, size)")).alias("full"))
    fits = _met(expressions, known.select(_digest(F.col("host"), F.col("path")).alias("full"), F.concat("host", "path").alias("rule"), "verdict"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("length"), "verdict", "rule")).alias("best"))
    return durable(best.select("host", "path", "best.rule", "best.verdict"))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict. ``rules``: host, path, verdict (allow or block)."""
    rows = pages.select(boxed(pages, "host", "path", "rule", "verdict"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    best = verdicts(rows.select("host", "path"), rules)
    return rows.join(best, ["host", "path"], "left").select("row.*", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
