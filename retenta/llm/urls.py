"""URL filters: pattern rules found through their rarest literal token, in DataFrame functions only.

Every rule has literal tokens (runs of letters and digits in its host, path or word). How
often each such token occurs in the URLs at hand is counted, and a rule is filed under the
rarest of its own. The tokens of a URL then fetch the few rules filed under them, and only
those run their regular expression. Site rules (a host and a path prefix) decide first, the
longest that fits; then word rules, where any block wins; what no rule fits is allowed.

Nulls and ties: a null URL, or one without ``://``, has empty host and path, fits no rule and
is allowed; site rules of equal length go by their text; repeated rows are judged each for
itself; a null page id is kept. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The site rules (verdict, host, path).
SITE_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
# End of fixed values.
#: Words that, as a whole token of a host, mark a site as one to block.
WORD_RULES = ["casino", "bets", "pills", "spam", "adult", "ads"]
#: Rules are broadcast up to this many, and joined as a table beyond.
BROADCAST_RULES = 100_000
TOKEN = r"[a-z0-9]+"


def rule_table(spark: SparkSession, sites=SITE_RULES, words=WORD_RULES) -> DataFrame:
    """Rules as rows: id, kind, verdict, rule text, its length, pattern over ``host/path``, literal tokens."""
    rows = []
    for verdict, host, path in sites:
        pattern = rf"^([^/?#]*\.)?{re.escape(host)}{re.escape(path)}"
        # What a prefix ends in goes on in a URL unless a separator ends it, so it is no whole token.
        tokens = re.findall(TOKEN + r"(?=[^a-z0-9])", (host + path).lower())
        if not tokens:
            raise ValueError(f"site rule {host + path!r} has no whole token to be found by")
        rows.append(("site", verdict, host + path, pattern, tokens))
    for word in words:
        rows.append(("word", "block", word, rf"^([^/?#]*[.-])?{re.escape(word)}([.-][^/?#]*)?(/|$)", re.findall(TOKEN, word)))
    rows = [(i, *row) for i, row in enumerate(rows)]
    return spark.createDataFrame(
        rows, "rule_id int, kind string, rule_verdict string, rule string, pattern string, tokens array<string>"
    )


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(address: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(address), r"[^a-z0-9]+"), ""))


def _hinted(rules: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rules) if n <= BROADCAST_RULES else rules


def filed(rules: DataFrame, addresses: DataFrame, n_rules: int) -> DataFrame:
    """Each rule with ``token``, the rarest of its tokens among the addresses (never seen counts as 0)."""
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    seen = (
        addresses.select(F.explode(_tokens(F.col("address"))).alias("token"))
        .join(_hinted(wanted, n_rules), "token", "left_semi")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    spread = rules.select("*", F.explode("tokens").alias("token")).join(seen, "token", "left")
    rarest = spread.groupBy("rule_id").agg(
        F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token")
    )
    return rules.join(rarest, "rule_id").drop("tokens")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id``, host, path, the site rule that fits (or null), the verdict, and the word rules that fit."""
    url = F.col(url_col).cast("string")
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    addresses = parts.select("*", F.concat("host", "path").alias("address"))
    n_rules = rules.count()
    index = filed(rules, addresses, n_rules)
    # URLs repeat and hosts are hot; each distinct address is matched once.
    distinct = addresses.select("host", "path", "address").distinct()
    fits = (
        distinct.select("host", "path", "address", F.explode(_tokens(F.col("address"))).alias("token"))
        .join(_hinted(index, n_rules), "token")
        .filter(F.expr("address RLIKE pattern"))
        .groupBy("host", "path")
        .agg(
            F.max(
                F.when(F.col("kind") == "site", F.struct(F.char_length("rule").alias("n"), "rule", "rule_verdict"))
            ).alias("site"),
            F.sort_array(F.collect_set(F.when(F.col("kind") == "word", F.col("rule")))).alias("words"),
            F.max(F.when((F.col("kind") == "word") & (F.col("rule_verdict") == "block"), F.lit(1))).alias("blocked"),
        )
    )
    verdict = F.coalesce(
        F.col("site.rule_verdict"), F.when(F.col("blocked") == 1, F.lit("block")), F.lit("allow")
    )
    return parts.join(fits, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("site.rule").alias("rule"), verdict.alias("verdict"),
        F.coalesce("words", F.array().cast("array<string>")).alias("word_rules"),
    )
