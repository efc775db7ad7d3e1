"""URL filters: pattern rules, indexed by their rarest literal token.

A pattern is literal text in which ``*`` stands for any characters, ``||`` at the start for "this
host or a subdomain of it", ``|`` at the start or end for the start or end of the address, and
``^`` for a character that ends a name (or the end). It is matched against ``//host/path``: the
scheme, the query and the fragment take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.common import lower_ascii

PARTS = r"://([^/?#]*)([^?#]*)"
TOKEN = r"[a-z0-9]+"

RULES_SCHEMA = "rule string, pattern string, verdict string, stated boolean"
RULES_STRUCT = "rule:string,pattern:string,verdict:string,stated:boolean"

#: Stated rules: host and path, each for the host and all its subdomains; the longest wins.
STATED = [
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
]

#: Patterns of addresses that hold no prose, used where no stated rule fits.
PATTERNS = [
    ("*/cart/*", "block"),
    ("*/checkout/*", "block"),
    ("*/cgi-bin/*", "block"),
    ("*/wp-login.php|", "block"),
    ("*/login|", "block"),
    ("*/signin|", "block"),
    ("||ads.*", "block"),
    ("||adserver.*", "block"),
    ("||casino.*", "block"),
    ("||porn.*", "block"),
]


def rules(spark: SparkSession) -> DataFrame:
    """The stated rules and the default patterns as a rules table, of constants in the plan."""
    listed = [(rule, "||" + rule, verdict, True) for rule, verdict in STATED]
    listed += [(None, pattern, verdict, False) for pattern, verdict in PATTERNS]
    names = [field.split()[0] for field in RULES_SCHEMA.split(", ")]
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in listed]
    return spark.range(1).select(F.inline(F.array(*rows).cast(f"array<struct<{RULES_STRUCT}>>")))


def address(url: Column, part: int) -> Column:
    """Host (1, lower case) or path (2) of a URL; empty if it is NULL or has no ``://``."""
    found = F.coalesce(F.regexp_extract(url, PARTS, part), F.lit(""))
    return lower_ascii(found) if part == 1 else found


def pattern_regex(pattern: Column) -> Column:
    """The regular expression of a pattern, built by column functions."""
    hosted = pattern.startswith("||")
    body = F.when(hosted, F.substring(pattern, 3, 1 << 30)).otherwise(pattern)
    body = F.regexp_replace(body, r"([\\.\[\]{}()+?$])", r"\\$1")
    body = F.regexp_replace(body, r"(?<!^)\|(?!$)", r"\\|")
    body = F.regexp_replace(body, r"\^", r"(?:[^a-zA-Z0-9.%_-]|\\z)")
    body = F.regexp_replace(body, r"\*", r"[\\s\\S]*")
    body = F.regexp_replace(F.regexp_replace(body, r"^\|", "^"), r"(?<!\\)\|$", r"\\z")
    return F.concat(F.when(hosted, F.lit(r"^//(?:[^/]*\.)?")).otherwise(F.lit("")), body)


def pattern_tokens(pattern: Column) -> Column:
    """Lower-case tokens that every matching address holds as whole tokens.

    A token counts only where the pattern itself ends it on both sides: next to ``*``, or at an end
    without an anchor, the address could go on with more letters.
    """
    low = F.lower(pattern)
    closed = F.concat(
        F.when(low.startswith("|"), F.lit("|")).otherwise(F.lit("*")),
        low,
        F.when(low.endswith("|"), F.lit("|")).otherwise(F.lit("*")),
    )
    return F.regexp_extract_all(
        closed, F.lit(r"(?<![a-z0-9*])([a-z0-9]+)(?![a-z0-9*])"), F.lit(1)
    )


def _tokens(target: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(target), F.lit(TOKEN), F.lit(0)))


def rule_index(rule_table: DataFrame, addresses: DataFrame) -> DataFrame:
    """The rules by their rarest token: the one that the fewest addresses hold.

    Only counts of the rules' own tokens are shuffled. A rule without any whole token gets the
    empty token, which every address holds, so it is tried everywhere.
    """
    parsed = rule_table.where(F.col("pattern").isNotNull()).distinct().select(
        "rule", "pattern", "verdict", "stated",
        F.explode_outer(pattern_tokens(F.col("pattern"))).alias("token"),
    )
    ours = parsed.select(F.col("token").alias("t")).where("token is not null").distinct()
    held = addresses.select(F.explode("tokens").alias("token"))
    counts = held.join(ours, F.col("token") == F.col("t"), "left_semi").groupBy("token").agg(
        F.count(F.lit(1)).alias("held")
    )
    rarest = F.min(F.struct(F.coalesce("held", F.lit(0)), F.coalesce("token", F.lit(""))))
    return (
        parsed.join(counts, "token", "left")
        .groupBy("rule", "pattern", "verdict", "stated")
        .agg(rarest.alias("_rarest"))
        .select(
            "rule", "pattern", "verdict", "stated",
            F.col("_rarest.col2").alias("token"),
            pattern_regex(F.col("pattern")).alias("regex"),
        )
    )


def filter_urls(pages: DataFrame, rule_table: DataFrame, default: str = "allow") -> DataFrame:
    """Judge every page's URL: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``pattern``.

    Distinct addresses are cut into tokens, the tokens fetch the rules indexed under them by an
    equi-join, and only the rules fetched are tried as regular expressions. Of the rules that
    match, a stated one goes before a pattern, then the longest pattern wins, then ``allow``
    before ``block``, then the smaller text. ``rule`` is the stated rule's name, else NULL;
    ``pattern`` is what decided, NULL where ``default`` did. A NULL URL and one without ``://``
    have empty host and path and can match nothing but patterns of pure ``*``. Each row of the
    input, repeated or not, gives one row; other columns are dropped.

    The rules table may be of any size: Catalyst broadcasts it if it is small and otherwise
    shuffles. An address that a third of the pages share is judged once.
    """
    parts = pages.select(
        "page_id",
        address(F.col("url"), 1).alias("host"),
        address(F.col("url"), 2).alias("path"),
    )
    addresses = parts.select("host", "path").distinct().withColumn(
        "target", F.concat(F.lit("//"), "host", "path")
    ).withColumn("tokens", F.concat(F.array(F.lit("")), _tokens(F.col("target"))))
    index = rule_index(rule_table, addresses)
    size = F.length("pattern")
    allow_first = F.when(F.col("verdict") == "allow", 0).otherwise(1)
    best = F.min_by(
        F.struct("rule", "verdict", "pattern"),
        F.struct((~F.col("stated")).alias("p"), (-size).alias("s"), allow_first.alias("a"), "pattern"),
    )
    decided = (
        addresses.select("host", "path", "target", F.explode("tokens").alias("token"))
        .join(index, "token")
        .where(F.expr("target rlike regex"))
        .groupBy("host", "path")
        .agg(best.alias("best"))
    )
    return parts.join(decided, ["host", "path"], "left").select(
        "page_id", "host", "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.col("best.pattern").alias("pattern"),
    )
