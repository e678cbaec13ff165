"""URL verdicts by allow and block rules, in DataFrame operations alone.

Each URL's host expands into its suffixes at label bounds and its path into prefixes of the lengths that rules
have. The expressions meet the rules in an equi-join on the first 32 bits of their SHA-256; full digests confirm,
and the longest rule decides. Verdicts are a function of the URL, so each distinct URL is expanded once and the
verdicts are joined back to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.llm._common import join_by_count, spare_prefix

#: Rules up to this many are broadcast; more go through a shuffled join on the hash prefix.
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), upper, upper.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def compile_rules(spark: SparkSession, rules: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """Rules as (action, rule text) rows: a host, then a path that starts with `/`. Of two rules with one text,
    block stands."""
    df = rules if isinstance(rules, DataFrame) else spark.createDataFrame(rules, "action string, rule string")
    host, path = F.lower(F.substring_index("rule", "/", 1)), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)")
    return df.where("rule is not null").groupBy("rule").agg(F.max("action").alias("action")).select("rule", "action", host.alias("rule_host"), path.alias("rule_path")).withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path")))


def verdicts(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, *, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to each row of pages; they replace columns of their name.

    A rule fits its host and all subdomains when the path starts with the rule's; of those that fit, the one with
    the longest text wins, on a tie the one with the longer host. Without one, rule is null and the verdict is
    `default`. A null URL, or one without `://`, has an empty host and path, which no rule fits. Rows are kept
    one for one, repeated rows too.
    """
    spark = pages.sparkSession
    compiled = compile_rules(spark, rules)
    shape = compiled.agg(F.count("*"), F.sort_array(F.collect_set(F.length("rule_path"))), F.max(F.size(F.split("rule_host", "\\.")))).first()
    count, lengths, labels = shape[0], shape[1], shape[2] or 0
    others = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    base = pages.select(*(F.col(f"`{c}`") for c in others), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    if not count:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    # A path longer than the longest rule's never matters beyond it: what is expanded is bounded by the rules.
    heads = base.where("host <> ''").select("host", F.substring("path", 1, max(lengths)).alias("head"))
    seen = heads.groupBy("host", "head").agg(F.count("*").alias("n"))
    parts = F.split("host", "\\.")
    depth = F.least(F.size(parts), F.lit(labels))
    suffixes = F.transform(F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    prefixes = F.filter(F.array(*(F.when(F.length("head") >= n, F.substring("head", 1, n)) for n in lengths)), lambda p: p.isNotNull())
    expressions = (
        seen.withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(prefixes))
        .withColumn("own", _digest(F.col("suffix"), F.col("prefix")))
        .select("host", "head", "n", "own", F.substring("own", 1, 8).alias("short"))
    )
    known = compiled.select("rule", "action", "digest", "rule_host", F.substring("digest", 1, 8).alias("short"))
    known = F.broadcast(known) if count <= BROADCAST_RULES else known
    fits = expressions.join(known, "short").where("own = digest")
    best = fits.groupBy("host", "head", "n").agg(F.max(F.struct(F.length("rule").alias("size"), F.length("rule_host").alias("host_size"), "action", "rule")).alias("best"))
    own = spare_prefix(pages.columns)
    keys = [f"{own}host", f"{own}head"]
    best = best.select(F.col("host").alias(keys[0]), F.col("head").alias(keys[1]), F.col("n").alias(f"{own}n"), F.col("best.rule").alias("rule"), F.col("best.action").alias(f"{own}action"))
    keyed = base.withColumns({keys[0]: F.col("host"), keys[1]: F.substring("path", 1, max(lengths))})
    # URLs without a host fit no rule and go around the join; popular heads are joined where their rows are.
    total = best.agg(F.sum(f"{own}n")).first()[0] or 0
    joined = join_by_count(keyed.where("host <> ''"), best, keys, f"{own}n", total, "left")
    hostless = base.where("host = ''").withColumns({"rule": F.lit(None).cast("string"), f"{own}action": F.lit(None).cast("string")})
    shown = [*(F.col(f"`{c}`") for c in others), F.col("host"), F.col("path"), F.col("rule"), F.coalesce(f"{own}action", F.lit(default)).alias("verdict")]
    return joined.select(*shown).unionByName(hostless.select(*shown))
