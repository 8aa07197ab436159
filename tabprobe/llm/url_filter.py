"""URL rules indexed by their rarest literal token, with DataFrame operations only.

Every rule is a regular expression over the url's target (host, path and query) and the literal
tokens that any url it matches must hold as whole runs of [A-Za-z0-9]. Token counts over all
distinct urls pick each rule's rarest token; url tokens fetch candidate rules by a join on that
token, and only the candidates' expressions run.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprobe.llm.text import lower_ascii

# Rules come from the caller's list on the driver; up to this many are broadcast, more are joined by shuffle.
BROADCAST_RULES = 100_000
TOKEN = "[A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``length`` ranks rules (longest wins); ``listed`` marks host and path rules."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    length: int
    listed: bool


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host and its subdomains whose url path starts with ``path``.

    The path's last token counts only if the path ends it (``/en/`` but not ``/en``).
    """
    cut = re.sub(f"{TOKEN}$", "", path)
    return Rule(host + path, verdict, rf"^(?:[^/?#]*\.)?{_quote(host)}(?=[/?#]|$){_quote(path)}",
                tuple(re.findall(TOKEN, host) + re.findall(TOKEN, cut)), len(host + path), True)


def word_rule(verdict: str, words: str) -> Rule:
    """A rule for urls that hold the literal ``words`` between other characters than [A-Za-z0-9]."""
    return Rule(words, verdict, f"(?<![A-Za-z0-9]){_quote(words)}(?![A-Za-z0-9])", tuple(re.findall(TOKEN, words)), len(words), False)


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


HOST_RULES = [
    host_rule("allow", "org", "/"),
    host_rule("block", "example.org", "/es/"),
    host_rule("block", "example.org", "/en/1"),
    host_rule("allow", "com", "/fr/"),
    host_rule("block", "com", "/de/"),
]
# Words of advertising, adult, gambling and spam hosts; they decide only where no host rule fits.
WORD_RULES = [word_rule("block", w) for w in (
    "ads", "adserver", "doubleclick", "popunder", "adult", "porn", "xxx", "casino", "bets", "betting", "pills", "spam", "malware", "warez")]


def _rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    table = spark.createDataFrame(
        [(i, r.name, r.verdict, r.pattern, list(dict.fromkeys(r.tokens)), r.length, r.listed) for i, r in enumerate(rules)],
        "rid int, name string, verdict string, pattern string, tokens array<string>, length int, listed boolean")
    return F.broadcast(table) if len(rules) <= BROADCAST_RULES else table


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[Rule] | None = None,
               default: str = "allow") -> DataFrame:
    """The verdict of the longest fitting rule for each url.

    Returns id_col, ``host``, ``path``, ``rule`` (the host rule, else null), ``verdict`` and
    ``word_rule`` (what decided in its stead, else null): one row per input row. Host: from the
    first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there to ``?``, ``#`` or
    the end. Null urls and urls without ``://`` have an empty host and path and the default verdict.
    Equal lengths: block before allow, then the rule's name. Work is done once per distinct url.
    """
    spark = pages.sparkSession
    rules = HOST_RULES + WORD_RULES if rules is None else rules
    if any(not r.tokens for r in rules):
        raise ValueError("every rule needs a literal token")
    table = _rules_table(spark, rules)
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    parts = base.select(
        "id", "url", lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)).alias("host"),
        F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1).alias("tail"))
    target = F.concat("host", "tail")
    urls = parts.where("host <> '' or tail <> ''").select(target.alias("target")).distinct()
    # Words of the query count too; regexp_extract_all gives whole runs only.
    tokens = urls.select("target", F.explode(F.array_distinct(F.regexp_extract_all("target", F.lit(TOKEN), 0))).alias("token"))
    needed = table.select("rid", F.explode("tokens").alias("token"))
    counts = tokens.join(F.broadcast(needed.select("token").distinct()) if len(rules) <= BROADCAST_RULES else needed.select("token").distinct(),
                         "token").groupBy("token").agg(F.count("*").alias("n"))
    index = (needed.join(counts, "token", "left")
             .groupBy("rid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best"))
             .select("rid", F.col("best.token").alias("token"))
             .join(table, "rid").select("token", "name", "verdict", "pattern", "length", "listed"))
    hits = (tokens.join(F.broadcast(index) if len(rules) <= BROADCAST_RULES else index, "token")
            .where(F.regexp_like("target", F.col("pattern"))))
    # Host rules beat words; then length, block before allow, name.
    rank = F.struct("listed", "length", (F.col("verdict") == "block").alias("blocks"), "name", "verdict")
    best = hits.groupBy("target").agg(F.max(rank).alias("best"))
    listed = F.col("best.listed")
    return (parts.withColumn("target", target).join(best, "target", "left")
            .select(F.col("id").alias(id_col), F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
                    F.when(listed, F.col("best.name")).alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
                    F.when(~listed, F.col("best.name")).alias("word_rule")))
