"""URL filter: pattern rules found through their rarest literal token.

A rule is either a site rule, a host with all its subdomains and a path prefix, or a pattern in the notation of filter
lists (``||`` start of a host label, ``*`` any text, ``^`` a separator or the end). Each rule becomes one regular
expression and the literal tokens (runs of letters and digits) that any matching URL must hold whole. Token frequencies
over all URLs pick the rarest token of each rule; the tokens of a URL fetch their rules by an equi-join, and only those
rules run their regular expression. Rules without such a token form one alternation that every URL is matched with.

Everything is DataFrame functions. URLs are judged once per distinct URL and joined back, so repeated rows cost little.
The rule list is a parameter; its index is broadcast up to ``BROADCAST_RULES`` rules and shuffled beyond.

Defined cases: a null URL or one without ``://`` has empty host and path, fits no site rule and is judged by the patterns
on its whole text (null: allowed). Repeated pages give repeated rows. Only ``page_id`` and ``url`` are read; a null
``page_id`` stays null. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_RULES = 5000
_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    site: bool


def site_rule(text: str, verdict: str) -> Rule:
    """``host/path``: fits the host and its subdomains if the path starts with the rule's."""
    host, _, path = text.partition("/")
    host, path = host.lower(), "/" + path
    whole = _TOKEN.findall(host)
    parts = re.findall(r"[a-z0-9]+|[^a-z0-9]+", path.lower())
    whole += [p for p in parts[:-1] if _TOKEN.fullmatch(p)]  # the last run may go on in the URL
    return Rule(text, verdict, rf"^//(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(dict.fromkeys(whole)), True)


def pattern_rule(text: str, verdict: str = "block") -> Rule:
    """A pattern matched anywhere in the lower-cased URL behind its scheme."""
    body, start = text.lower(), ""
    if body.startswith("||"):
        body, start = body[2:], r"^//(?:[^/?#]*\.)?"
    regex = start + "".join(".*" if x == "*" else r"(?:[^a-z0-9_.%-]|$)" if x == "^" else re.escape(x) for x in body)
    tokens = []
    for m in _TOKEN.finditer(body):
        closed_left = m.start() > 0 and body[m.start() - 1] != "*" or m.start() == 0 and start
        closed_right = m.end() < len(body) and body[m.end()] != "*"
        if closed_left and closed_right:
            tokens.append(m[0])
    return Rule(text, verdict, regex, tuple(dict.fromkeys(tokens)), False)


#: The site rules of the query's contract.
SITES = [site_rule("com/", "allow"), site_rule("example.com/en/", "block"), site_rule("www.example.com/en/", "allow"),
         site_rule("net/es/", "block"), site_rule("net/fr/", "block")]

#: Patterns that stand for an unwanted-site list.
PATTERNS = [pattern_rule(x) for x in (
    "||spam-farm.", "||cheap-pills.", "||casino.", "||adult.", "||xxx.", "||warez.", "-casino.", "/adclick/", "/affiliate/", "/banner/*.swf",
    "/wp-login.php", "/free-download/*.exe^", "&gclid=", "?sessionid=", "/porn/", "||doubleclick.net^", "||tracker.*/pixel^")]


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.expr("substr(url, instr(url, '://') + 3)"), "/", 1)).otherwise("")
    rest = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _with_parts(urls: DataFrame) -> DataFrame:
    """Add host, path, ``site`` (//host/path) and ``whole`` (the lower-cased URL behind its scheme) to a frame with url."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")
    cut = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    d = urls.withColumn("host", F.coalesce(host_of(F.col("url")), F.lit("")))
    d = d.withColumn("path", F.coalesce(F.substring(cut, F.length("host") + 1, F.length(cut)), F.lit("")))
    return d.withColumns({"site": F.concat(F.lit("//"), "host", "path"),
                          "whole": F.lower(F.when(at > 0, F.concat(F.lit("//"), rest)).otherwise(F.col("url")))})


def rule_index(tokens: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rules keyed by the token of theirs that the fewest distinct URLs hold. ``tokens`` has one row per URL and token."""
    spark = tokens.sparkSession
    rows = [(i, r.text, r.verdict, r.regex, r.site, t) for i, r in enumerate(rules) for t in r.tokens]
    own = spark.createDataFrame(rows, "rule_no int, rule_text string, rule_verdict string, regex string, is_site boolean, token string")
    small = F.broadcast if len(rules) <= BROADCAST_RULES else (lambda x: x)
    df = tokens.join(small(own.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = own.join(df, "token", "left").groupBy("rule_no").agg(
        F.min_by(F.struct("token", "rule_text", "rule_verdict", "regex", "is_site"), F.struct(F.coalesce("df", F.lit(0)), "token")).alias("r"))
    return small(ranked.select("rule_no", "r.*"))


def judge(pages: DataFrame, sites: list[Rule] = SITES, patterns: list[Rule] = PATTERNS) -> DataFrame:
    """page_id, host, path, rule (longest fitting site rule), verdict, pattern (first matching pattern) per page.

    The site rule decides; without one a matching pattern's verdict, else allow.
    """
    rules = [*sites, *patterns]
    urls = _with_parts(pages.select("url").where(F.col("url").isNotNull()).distinct())
    tokens = urls.select("url", "site", "whole", F.explode(F.array_distinct(F.split(F.lower("url"), "[^a-z0-9]+"))).alias("token"))
    found = tokens.join(rule_index(tokens.select("token"), [r for r in rules if r.tokens]), "token")
    fits = found.where(F.expr("CASE WHEN is_site THEN site ELSE whole END RLIKE regex"))
    plain = {True: [r for r in sites if not r.tokens], False: [r for r in patterns if not r.tokens]}
    for kind, col in ((True, "site"), (False, "whole")):
        for r in plain[kind]:
            more = urls.where(F.col(col).rlike(r.regex)).select("url", F.lit(rules.index(r)).alias("rule_no"), F.lit(r.text).alias("rule_text"),
                                                                 F.lit(r.verdict).alias("rule_verdict"), F.lit(kind).alias("is_site"))
            fits = fits.select(*more.columns).unionByName(more)
    best = fits.groupBy("url").agg(
        F.max_by(F.struct("rule_text", "rule_verdict"), F.when(F.col("is_site"), F.struct(F.length("rule_text"), -F.col("rule_no")))).alias("s"),
        F.min_by(F.struct("rule_text", "rule_verdict"), F.when(~F.col("is_site"), F.col("rule_no"))).alias("p"))
    out = _with_parts(pages.select("page_id", "url")).join(best, "url", "left")
    return out.select("page_id", "host", "path", F.col("s.rule_text").alias("rule"),
                      F.coalesce("s.rule_verdict", "p.rule_verdict", F.lit("allow")).alias("verdict"), F.col("p.rule_text").alias("pattern"))
