"""URL filter: pattern rules, indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import ascii_lower, cut, literal_table, spread_join

SPLIT = "[^0-9A-Za-z]+"


@dataclass(frozen=True)
class Rule:
    """A regular expression over host and path joined. literals: tokens (h:... of the host,
    p:... of the path) that every URL it matches holds; without any, each URL is tried.
    tier: a match of a lower tier wins; weight: then the larger."""

    name: str
    action: str
    pattern: str
    literals: tuple[str, ...] = ()
    tier: int = 0
    weight: int = 0


def host_rule(host: str, path: str, action: str) -> Rule:
    """Fits the host and its subdomains where the path starts with `path`; the longest wins."""
    whole = re.split(SPLIT, path)[:-1]  # what follows the last separator may go on in the URL
    literals = {f"h:{x}" for x in re.split(SPLIT, host) if x} | {f"p:{x}" for x in whole if x}
    return Rule(host + path, action, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}" + ("" if path else r"(?:/|$)"), tuple(sorted(literals)), 0, len(host + path))


def word_rule(word: str, action: str = "block") -> Rule:
    """Fits hosts with the token `word`."""
    return Rule(f"host:{word}", action, rf"^(?:[^/]*[^0-9A-Za-z/])?{word}(?![0-9A-Za-z])", (f"h:{word}",), 1, len(word))


#: The host rules of the registered query.
HOST_RULES = (
    host_rule("net", "/", "block"),
    host_rule("example.net", "/en/", "allow"),
    host_rule("example.com", "/de/", "block"),
    host_rule("org", "/fr/", "allow"),
)
#: Host words of spam, used where no host rule fits.
SPAM_WORDS = ("bet", "bets", "casino", "gambling", "jackpot", "loans", "payday", "pills", "poker", "porn", "slots", "viagra", "warez", "xxx")
WORD_RULES = tuple(word_rule(w) for w in SPAM_WORDS)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _tokens(host: Column, path: Column) -> Column:
    of = lambda c, kind: F.transform(F.filter(F.split(c, SPLIT), lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(F.concat(of(host, "h:"), of(path, "p:"), F.array(F.lit("*"))))


RULES = "name string, action string, pattern string, literals array<string>, tier int, weight int"


def rules_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Some rules as a table of the schema RULES, made of constants."""
    rows = [{k: getattr(r, k) for k in ("name", "action", "pattern", "tier", "weight")} | {"literals": list(r.literals)} for r in rules]
    return literal_table(spark, rows, RULES)


def filter_urls(pages: DataFrame, rules: Sequence[Rule] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every row's URL: id_col, host, path, rule, verdict, tier. rules: a few as they are, or any number as
    a table of the schema RULES; equal rules count once.

    Rows are judged one by one, so repeated rows and ids (null ids too) each give a row. A null
    URL, an empty one and one without `://` have empty host and path and get the verdict of a
    rule that fits the empty text, else `default`. Of several matches the lower tier wins, then
    the greater weight, then the smaller name. URLs of any length are read whole. Other columns of `pages` are
    dropped; an empty table gives an empty result.

    Plan: the tokens that rules hold are counted over all URLs and each rule is filed under its
    rarest. A URL's tokens fetch the rules filed under them and only those run their regular
    expression. What fits, and a row for each URL, meet in the only shuffle, which is by row number and can't be
    skewed. The index is broadcast up to a number of rows and bytes, and dealt over salts beyond.
    """
    spark = pages.sparkSession
    table = rules if isinstance(rules, DataFrame) else rules_table(spark, rules)
    rules_df = table.select("name", "action", "pattern", "literals", "tier", "weight").distinct().withColumn("no", F.xxhash64("name", "action", "pattern", "literals", "tier", "weight"))
    if isinstance(rules, DataFrame):
        rules_df = cut(rules_df, "url-rules")
        n_held, n_bytes = rules_df.agg(F.coalesce(F.sum(F.greatest(F.lit(1), F.size("literals"))), F.lit(0)), F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "name", "pattern", F.concat_ws(" ", "literals")))), F.lit(0))).first()
    else:
        n_held = sum(max(1, len(r.literals)) for r in rules)
        n_bytes = sum(len(r.name) + len(r.pattern) + sum(map(len, r.literals)) for r in rules) * 4
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), host.alias("host"), path.alias("path"))
    held = rules_df.select("no", F.explode(F.when(F.size("literals") > 0, F.array_distinct("literals")).otherwise(F.array(F.lit("*")))).alias("token"))
    vocabulary = held.select("token").distinct()
    counts = spread_join(urls.select("_row", F.explode(_tokens(F.col("host"), F.col("path"))).alias("token")), vocabulary, "token", F.col("_row"), n_held, "inner", size=n_bytes).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = Window.partitionBy("no").orderBy(F.coalesce("n", F.lit(0)), "token")
    index = held.join(counts, "token", "left").withColumn("_k", F.row_number().over(rarest)).where("_k = 1").select("no", "token").join(rules_df.drop("literals"), "no").drop("no")
    # Several rules may be filed under a token: one row of the index for each token.
    index = index.groupBy("token").agg(F.collect_list(F.struct("tier", (-F.col("weight")).alias("w"), "name", "action", "pattern")).alias("filed"))

    found = spread_join(urls.withColumn("token", F.explode(_tokens(F.col("host"), F.col("path")))), index, "token", F.col("_row"), n_held, size=n_bytes)
    fits = F.filter(F.coalesce("filed", F.array().cast("array<struct<tier:int,w:int,name:string,action:string,pattern:string>>")), lambda r: F.rlike(F.concat("host", "path"), r["pattern"]))
    found = found.withColumn("fit", F.array_min(F.transform(fits, lambda r: F.struct(r["tier"].alias("tier"), r["w"].alias("w"), r["name"].alias("name"), r["action"].alias("action")))))
    found = found.where((F.col("token") == "*") | F.col("fit").isNotNull())
    out = found.groupBy("_row").agg(F.first("_id").alias(id_col), F.first("host").alias("host"), F.first("path").alias("path"), F.min("fit").alias("_best"))
    return out.select(id_col, "host", "path", F.col("_best.name").alias("rule"), F.coalesce("_best.action", F.lit(default)).alias("verdict"), F.col("_best.tier").alias("tier"))
