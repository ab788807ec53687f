"""URL filters: rules found by their rarest literal token, DataFrame functions only.

A rule is a regular expression over host and path with the literal tokens (runs of letters and digits)
that any matching URL must hold whole.  Each rule is filed under the one of its tokens that the fewest
URLs hold.  A URL's distinct tokens fetch their rules, and only those rules' expressions run.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflow.llm.common import col

#: Rules beyond this many bytes are joined by shuffle instead of being sent to every executor.
BROADCAST_BYTES = 8 << 20


@dataclass(frozen=True)
class Rule:
    """verdict: allow or block.  host, path: a rule for the host and its subdomains with that path prefix.  Or a pattern with its tokens."""

    verdict: str
    host: str = ""
    path: str = "/"
    pattern: str = ""
    tokens: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return self.pattern or self.host + self.path

    @property
    def expression(self) -> str:
        quote = lambda s: re.sub(r"([^A-Za-z0-9])", r"\\\1", s)
        return self.pattern or rf"^([^/]*\.)?{quote(self.host)}{quote(self.path)}"

    @property
    def literals(self) -> list[str]:
        """Whole tokens only: a path that ends inside a token doesn't yield that one."""
        if self.pattern:
            return list(self.tokens)
        whole = self.host + (self.path if self.path.endswith("/") else self.path[: len(self.path) - len(re.search(r"[A-Za-z0-9]*$", self.path)[0])])
        return re.findall(r"[A-Za-z0-9]+", whole)


def _pattern(expression: str, *tokens: str, verdict: str = "block") -> Rule:
    return Rule(verdict, pattern=expression, tokens=tokens)


#: Patterns over host and path of what a corpus of prose has no use for; they decide where no host rule fits.
JUNK = (
    # link farms, shops and games
    _pattern(r"^([^/]*\.)?spam-farm\.", "spam", "farm"),
    _pattern(r"^([^/]*\.)?cheap-pills\.", "cheap", "pills"),
    _pattern(r"^([^/]*\.)?casino(-[a-z]+)*\.", "casino"),
    _pattern(r"^([^/]*\.)?online-poker(-[a-z]+)*\.", "online", "poker"),
    _pattern(r"^([^/]*\.)?payday-loans?\.", "payday"),
    _pattern(r"^([^/]*\.)?free-followers\.", "free", "followers"),
    # advertising and tracking hosts
    _pattern(r"^([^/]*\.)?doubleclick\.net/", "doubleclick", "net"),
    _pattern(r"^([^/]*\.)?googlesyndication\.com/", "googlesyndication", "com"),
    _pattern(r"^([^/]*\.)?adservice\.[^/]*/", "adservice"),
    _pattern(r"^(ads|adserver|banners)\.[^/]+/ads?/", "ads"),
    _pattern(r"^(pixel|tracking)\.[^/]+/pixel\.gif$", "pixel", "gif"),
    # pages for machines and for signed-in users
    _pattern(r"^[^/]+/([^?#]*/)?wp-login\.php$", "wp", "login", "php"),
    _pattern(r"^[^/]+/([^?#]*/)?wp-admin/", "wp", "admin"),
    _pattern(r"^[^/]+/([^?#]*/)?xmlrpc\.php$", "xmlrpc", "php"),
    _pattern(r"^[^/]+/cgi-bin/", "cgi", "bin"),
    _pattern(r"^[^/]+/(shopping-)?cart/(add|checkout)(/|$)", "cart"),
    _pattern(r"^[^/]+/account/(login|signin|register)(/|$)", "account"),
    _pattern(r"^[^/]+/phpmyadmin(/|$)", "phpmyadmin"),
    _pattern(r"^[^/]+/([^?#]*/)?calendar/[0-9]{4}/[0-9]{2}/[0-9]{2}/?$", "calendar"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z in lower case; path: then up to ?, # or the end; else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1)
    return host, F.coalesce(path, F.lit(""))


def rules_table(spark: SparkSession, rules: list[Rule] | DataFrame) -> DataFrame:
    """verdict, is_pattern, name, expression, literals of rules given as a list, or as a table with the columns of Rule.

    Of a table's columns, path, pattern and tokens may be absent or null; path is then /, and rows with neither a
    pattern nor a host, or with another verdict than allow or block, are no rules.
    """
    if isinstance(rules, list):
        listed = [(r.verdict, bool(r.pattern), r.name, r.expression, r.literals) for r in rules]
        return spark.createDataFrame(listed, "verdict string, is_pattern boolean, name string, expression string, literals array<string>").distinct()
    given = lambda name, kind, other: F.coalesce(col(name).cast(kind), other) if name in rules.columns else other
    host, path, pattern = given("host", "string", F.lit("")), given("path", "string", F.lit("/")), given("pattern", "string", F.lit(""))
    quoted = F.regexp_replace(F.concat(host, path), "([^A-Za-z0-9])", "\\\\$1")
    whole = F.concat(host, F.when(F.endswith(path, F.lit("/")), path).otherwise(F.regexp_replace(path, "[A-Za-z0-9]*$", "")))
    words = F.filter(F.split(whole, "[^A-Za-z0-9]+"), lambda t: t != "")
    out = rules.select(
        col("verdict").alias("verdict"), (pattern != "").alias("is_pattern"), F.when(pattern != "", pattern).otherwise(F.concat(host, path)).alias("name"),
        F.when(pattern != "", pattern).otherwise(F.concat(F.lit(r"^([^/]*\.)?"), quoted)).alias("expression"),
        F.when(pattern != "", given("tokens", "array<string>", F.array().cast("array<string>"))).otherwise(words).alias("literals"), host.alias("host"),
    )
    return out.where("verdict in ('allow', 'block') and (is_pattern or host != '')").drop("host").distinct()


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, *, patterns: tuple[Rule, ...] = JUNK, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, pattern of every row.

    Host rules decide first: the longest that fits (ties: the name that sorts first; of equal names,
    block).  Then patterns: a URL that one matches gets that one's verdict (block before allow).  Else
    allow.  Null URLs and URLs without :// have empty host and path and are allowed.  Repeated rows are
    judged alike and all stay; URLs count whole, however long; an empty table has no rows.  Rules can be a
    list or a table of any size (see rules_table()); those without a whole literal token run against every
    distinct URL, so there may be 1,000 of them at most.
    """
    spark = pages.sparkSession
    host, path = host_and_path(col(url_col).cast("string"))
    rows = pages.select(col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = rows.select("host", "path").distinct()
    if isinstance(rules, list):
        every = [*rules, *patterns]
        table, loose = rules_table(spark, every), [r for r in every if not r.literals]
        small = sum(len(r.name) + len(r.expression) + 50 for r in every) <= BROADCAST_BYTES
    else:
        table = rules_table(spark, rules).union(rules_table(spark, list(patterns)))
        loose = table.where("size(literals) = 0").limit(1001).collect()
        small = (table.agg(F.sum(F.length("name") + F.length("expression") + 50)).first()[0] or 0) <= BROADCAST_BYTES
    if len(loose) > 1000:
        raise ValueError("over 1,000 rules have no literal token")
    sent = F.broadcast if small else (lambda df: df)
    rule = ["verdict", "is_pattern", "name", "expression"]
    tokens = urls.select("host", "path", F.explode(F.array_distinct(F.filter(F.split(F.concat("host", "path"), "[^A-Za-z0-9]+"), lambda t: t != ""))).alias("token"))
    wanted = table.select(*rule, F.explode("literals").alias("token")).distinct()
    known = tokens.join(sent(wanted.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(known, "token", "left").groupBy(*rule).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("least"))
    index = rarest.select(*rule, F.col("least.token").alias("token"))
    fetched = tokens.join(sent(index), "token")
    if loose:
        each = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip((r.verdict, bool(r.pattern) if isinstance(r, Rule) else r.is_pattern, r.name, r.expression), rule, strict=True))) for r in loose))
        fetched = fetched.unionByName(urls.select("host", "path", F.explode(each).alias("r")).select("host", "path", F.lit(None).cast("string").alias("token"), "r.*"))
    hits = fetched.where(F.regexp_like(F.concat("host", "path"), F.col("expression")))
    blocks = (F.col("verdict") == "block").cast("int")
    best = hits.groupBy("host", "path").agg(
        F.min(F.when(~F.col("is_pattern"), F.struct((-F.length("name")).alias("n"), "name", (-blocks).alias("b"), "verdict"))).alias("fits"),
        F.min(F.when(F.col("is_pattern"), F.struct((-blocks).alias("b"), "name", "verdict"))).alias("like"),
    )
    out = rows.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("fits.name").alias("rule"), F.coalesce("fits.verdict", "like.verdict", F.lit("allow")).alias("verdict"), F.col("like.name").alias("pattern"))
