"""Crawled pages and robots rules as tables.

S13: pages are ``(website, path, page_id, status, html)`` rows; responses
with status >= 400 are dropped.
S14: robots.txt bodies ``(website, status, body)`` become a rules table
``(website, ord, allow, prefix)`` for the crawler's agent, with the usual
robots semantics:

* a group is a run of ``User-agent`` lines followed by rules;
* the first group naming our agent (token contained in our agent name,
  case-insensitive) is used, else the first ``*`` group, else no rules;
* inside the group the first rule whose prefix starts the path decides
  (``ord`` = rule order); an empty ``Disallow`` allows everything;
* a robots response with status >= 400 (or no body) means "allow all".
Everything is Spark: split into lines, a running group number per site
(window over the lines of one small file), then aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

DEFAULT_AGENT = "postbot/1.0"


def readable_pages(pages: DataFrame) -> DataFrame:
    """Keep responses with status < 400."""
    return pages.filter(F.col("status") < 400)


def url_host(url) -> F.Column:
    """Scheme and host of a URL, lower-cased: what a robots file covers."""
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def url_path(url) -> F.Column:
    """Path and query of a URL, '/' for a bare host."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"#.*$", "")
    return F.when(rest == "", F.lit("/")).when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)


def percent_encoded(path) -> F.Column:
    """A path with its escapes in one form, so that ``/a%20b`` and ``/a b`` are alike."""
    plain = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    code = F.url_encode(F.coalesce(plain, path))
    for escape, sign in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        code = F.replace(code, F.lit(escape), F.lit(sign))
    return code


def robots_rules(robots: DataFrame, agent: str = DEFAULT_AGENT) -> DataFrame:
    """Robots bodies ``(website, status, body)`` -> (website, ord, allow, prefix) for ``agent``.

    ``website`` is the host that the file was fetched from.  A group is one or
    more ``User-agent`` lines and what follows up to the next such line after
    a rule; a blank line after a group's rules ends it.  Other lines
    (``Crawl-delay``, ``Sitemap``) belong to their group but give no rule.
    """
    ok = robots.filter((F.coalesce(F.col("status"), F.lit(200)) < 400) & F.col("body").isNotNull())
    raw = ok.select("website", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("line_no", "raw"))
    line = strip(F.regexp_replace("raw", "#.*$", ""))
    # a line that is a comment only is skipped, an empty one may end a group
    raw = raw.filter(~((strip(F.col("raw")) != "") & (line == "")))
    colon = F.instr(line, ":")
    lines = raw.select("website", "line_no", (line == "").alias("blank"),
                       F.when(colon > 0, F.lower(strip(F.substring_index(line, ":", 1)))).otherwise("").alias("key"),
                       strip(F.substring(line, colon + 1, 1 << 30)).alias("value"))
    w = Window.partitionBy("website").orderBy("line_no")
    is_ua = F.col("key") == "user-agent"
    lines = lines.withColumn("starts", is_ua & ~F.coalesce(F.lag(is_ua).over(w), F.lit(False)))
    lines = lines.withColumn("grp", F.sum(F.col("starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    in_group = Window.partitionBy("website", "grp").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("ended", F.max(F.col("blank").cast("int")).over(in_group) == 1)
    me = agent.split("/")[0].lower()
    agents = (lines.filter(is_ua)
              .groupBy("website", "grp")
              .agg(F.max(F.when((F.col("value") != "*") & F.lit(me).contains(F.lower("value"))
                                & (F.col("value") != ""), 1).otherwise(0)).alias("mine"),
                   F.max(F.when(F.col("value") == "*", 1).otherwise(0)).alias("star")))
    chosen = (agents.filter((F.col("mine") == 1) | (F.col("star") == 1))
              .groupBy("website")
              .agg(F.min_by("grp", F.struct(-F.col("mine"), F.col("grp"))).alias("grp")))
    rules = lines.filter(F.col("key").isin("allow", "disallow") & (F.col("grp") > 0) & ~F.col("ended")).join(chosen, ["website", "grp"])
    w2 = Window.partitionBy("website").orderBy("line_no")
    return rules.select(
        "website",
        (F.row_number().over(w2) - 1).cast("bigint").alias("ord"),
        ((F.col("key") == "allow") | (F.col("value") == "")).alias("allow"),
        F.col("value").alias("prefix"))


def robots_bodies(rules: DataFrame) -> DataFrame:
    """Render a rules table back to robots.txt bodies (used to land fixture payloads)."""
    line = F.concat(F.when(F.col("allow"), F.lit("Allow: ")).otherwise(F.lit("Disallow: ")), F.col("prefix"))
    g = rules.groupBy("website").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))).alias("xs"))
    body = F.concat(F.lit("# robots\nUser-agent: other-bot\nDisallow: /\n\nUser-agent: *\n"),
                    F.array_join(F.transform("xs", lambda x: x["l"]), "\n"), F.lit("\n"))
    return g.select("website", F.lit(200).alias("status"), body.alias("body"))
