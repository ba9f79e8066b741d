"""URL filters: block and allow rules on host suffixes and path prefixes.

Every URL is expanded into (host suffix, path prefix) expressions, as deep as any rule goes; the expressions
meet the rules in an equi-join on a short prefix of their SHA-256, and the full digest, the rule's whole path
and the precedence (longest rule wins) then decide.

Defined results: a null URL, an empty one or one without `://` has an empty host and path, fits no
rule and gets the default verdict. Hosts and paths may have any length. Repeated URLs each get their row, and
an empty table or one without rules gives rows without rules. A rule with a null host or verdict is
ignored; a null path counts as empty. Of two rules of equal length the one with the longer host wins,
then `block` before `allow`. Other columns of the input are kept unless their name clashes with one of
the four result columns, in which case the result column replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Above this many rules they are joined by a shuffle instead of being broadcast.
BROADCAST_RULES = 200_000
#: Hex digits of the digest that form the join key.
SHORT_DIGITS = 8


def url_host(url: Column) -> Column:
    """What stands between the first `://` and the next `/`, `?`, `#` or the end, with A-Z lower-cased."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(raw, upper, lower), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, most: int) -> Column:
    """The host itself and each suffix that begins after a dot, of at most so many labels."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, most)))),
        lambda i: F.array_join(F.slice(labels, -i, i), "."),
    )


def slash_prefixes(path: Column, most: int) -> Column:
    """The empty prefix and each prefix of the path that ends in a slash, of at most so many slashes."""
    parts = F.split(path, "/", most + 2)
    return F.concat(
        F.array(F.lit("")),
        F.transform(
            F.filter(F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(most))), lambda i: i > 0),
            lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")),
        ),
    )


def _count(col: str, mark: str) -> Column:
    return F.length(col) - F.length(F.replace(F.col(col), F.lit(mark), F.lit("")))


def _digest(host: Column, prefix: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), prefix), 256)


def indexed_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) keyed by the host and by their path up to its last slash."""
    path = F.coalesce(F.col("path"), F.lit(""))
    return (
        rules.where(F.col("host").isNotNull() & F.col("verdict").isNotNull())
        .select(F.lower("host").alias("r_host"), path.alias("r_path"), F.col("verdict").alias("r_verdict"))
        .distinct()
        .withColumn("r_digest", _digest(F.col("r_host"), F.regexp_extract("r_path", r"(?s)^(.*/)?", 0)))
        .withColumn("r_short", F.substring("r_digest", 1, SHORT_DIGITS))
    )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    url_col: str = "url",
    default: str = "allow",
    broadcast_rules: int = BROADCAST_RULES,
) -> DataFrame:
    """Add host, path, rule and verdict to every row of `pages`."""
    made = ["host", "path", "rule", "verdict"]
    kept = [c for c in pages.columns if c not in made]
    url = F.col(f"`{url_col}`")
    judged = pages.select(*[F.col(f"`{c}`") for c in kept], url_host(url).alias("host"), url_path(url).alias("path"))
    table = indexed_rules(rules)
    depth = table.agg(F.max(_count("r_host", ".") + 1), F.max(_count("r_path", "/"))).first()
    places = judged.select(F.col("host").alias("__host"), F.col("path").alias("__path")).distinct()
    expressions = (
        places.withColumn("u_suffix", F.explode(host_suffixes(F.col("__host"), depth[0] or 0)))
        .withColumn("u_prefix", F.explode(slash_prefixes(F.col("__path"), depth[1] or 0)))
        .withColumn("u_digest", _digest(F.col("u_suffix"), F.col("u_prefix")))
        .withColumn("u_short", F.substring("u_digest", 1, SHORT_DIGITS))
        .select("__host", "__path", "u_digest", "u_short")
    )
    if table.limit(broadcast_rules + 1).count() <= broadcast_rules:
        table = F.broadcast(table)
    best = (
        expressions.join(table, F.col("u_short") == F.col("r_short"))
        .where((F.col("u_digest") == F.col("r_digest")) & F.col("__path").startswith(F.col("r_path")))
        .groupBy("__host", "__path")
        .agg(
            F.max(
                F.struct(
                    (F.length("r_host") + F.length("r_path")).alias("n"),
                    F.length("r_host").alias("h"),
                    (F.col("r_verdict") == "block").alias("b"),
                    F.concat("r_host", "r_path").alias("rule"),
                    F.col("r_verdict").alias("verdict"),
                )
            ).alias("__best")
        )
    )
    return judged.join(
        best, (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")), "left"
    ).select(
        *[F.col(f"`{c}`") for c in kept],
        "host",
        "path",
        F.col("__best.rule").alias("rule"),
        F.coalesce("__best.verdict", F.lit(default)).alias("verdict"),
    )
