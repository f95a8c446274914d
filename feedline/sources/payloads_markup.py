"""B5 (markup / tabular / card feeds): landed payloads built from the derived postings.

Same rules as ``payloads``: bounded groups of CHUNK rows per document,
edge cases placed by rule on ``seq`` so the DuckDB twins can restate them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .payloads import CHUNK

SEQ_STRIDE = 1 << 20


def esc(c: Column) -> Column:
    """Escape text for XML/HTML element content and double-quoted attributes."""
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    c = F.replace(c, F.lit(">"), F.lit("&gt;"))
    return F.replace(c, F.lit('"'), F.lit("&quot;"))


def grouped(items: DataFrame, key: str, order: str, wrap) -> DataFrame:
    """(key, order, frag) -> one document per key, fragments concatenated in ``order``."""
    g = items.groupBy(F.col(key).alias("payload_id")).agg(
        F.array_sort(F.collect_list(F.struct(order, "frag"))).alias("xs"))
    body = F.array_join(F.transform("xs", lambda x: x["frag"]), "")
    return g.select("payload_id", wrap(F.col("payload_id"), body).alias("payload"))


def _chunk():
    return (F.col("seq") / CHUNK).cast("bigint")


def _rfc(ts: Column, zone: str) -> Column:
    return F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" " + zone))


def rss_payloads(postings: DataFrame) -> DataFrame:
    """One RSS document per chunk; every seventh document is truncated (not well-formed)."""
    q = F.col("seq")
    t, c = esc(F.col("title")), esc(F.col("company"))
    raw = (F.when(q % 13 == 6, F.lit(""))
           .when(q % 4 == 0, F.concat(F.lit("Dev: "), t, F.lit(" at "), c))
           .when(q % 4 == 1, F.concat(F.lit("Ops: "), t, F.lit(" at "), c))
           .when(q % 4 == 2, F.concat(t, F.lit(" at "), c))
           .otherwise(F.concat(F.lit("Design: "), t)))
    link = F.when(q % 13 == 5, F.lit("")).when(q % 13 == 7, F.lit("")).otherwise(esc(F.col("url")))
    guid = F.when(q % 13 == 7, F.lit("")).otherwise(
        F.concat(F.lit("<guid>https://weworkremotely.com/g/"), q.cast("string"), F.lit("</guid>")))
    ts = F.col("posted_at")
    pub = (F.when(ts.isNull(), F.lit(""))
           .when(q % 3 == 0, F.concat(F.lit("<pubDate>"), _rfc(ts, "+0000"), F.lit("</pubDate>")))
           .when(q % 3 == 1, F.concat(F.lit("<pubDate>"), _rfc(ts, "GMT"), F.lit("</pubDate>")))
           .otherwise(F.lit("<pubDate>someday</pubDate>")))
    frag = F.concat(F.lit("<item><title>"), raw, F.lit("</title><link>"), link, F.lit("</link>"), guid,
                    F.lit("<description>"), esc(F.col("description")), F.lit("</description>"), pub,
                    F.lit("</item>"))
    items = postings.select(_chunk().alias("chunk"), "seq", frag.alias("frag"))

    def wrap(pid, body):
        doc = F.concat(F.lit('<rss version="2.0"><channel><title>Remote jobs</title>'), body,
                       F.lit("</channel></rss>"))
        return F.when(pid % 7 == 6, doc.substr(F.lit(1), F.length(doc) - 20)).otherwise(doc)
    return grouped(items, "chunk", "seq", wrap)


def card_page_payloads(postings: DataFrame) -> DataFrame:
    """One category page per chunk; every seventh posting also appears on the next page."""
    badge = F.when(F.col("is_remote"), F.lit('<i class="perk-remote_full"></i>')).otherwise(
        F.lit('<i class="perk-hybrid"></i>'))
    frag = F.concat(
        F.lit('<a class="gb-results-list__item results-item" href="'), esc(F.col("url")),
        F.lit('" title="'), esc(F.col("description")), F.lit('"><div class="results-list-info">'
                                                             '<h4 class="results-list-title"><strong>'),
        esc(F.col("title")), F.lit('</strong></h4><div class="size0"><strong>'), esc(F.col("company")),
        F.lit("</strong></div></div>"), badge, F.lit("</a>"))
    base = postings.select(_chunk().alias("chunk"), F.col("seq").alias("ord"), frag.alias("frag"))
    dup = postings.filter(F.col("seq") % 7 == 0).select(
        (_chunk() + 1).alias("chunk"), (F.col("seq") + 1000000000).alias("ord"), frag.alias("frag"))
    return grouped(base.unionByName(dup), "chunk", "ord", lambda pid, body: F.concat(
        F.lit('<html><body><div class="results">'), body, F.lit("</div></body></html>")))


def list_page_payloads(postings: DataFrame) -> DataFrame:
    """One list page per chunk; every fifth item links elsewhere."""
    q = F.col("seq")
    path = F.when(q % 5 == 0, F.concat(F.lit("/blog/"), q.cast("string"))).otherwise(
        F.concat(F.lit("/hiring/jobs/"), q.cast("string"), F.lit("-x")))
    frag = F.concat(F.lit('<li class="list-group-item d-flex"><a class="stretched-link" href="#" hx-get="'),
                    path, F.lit('">'), esc(F.col("title")), F.lit("</a><span>"), esc(F.col("company")),
                    F.lit("</span></li>"))
    items = postings.select(_chunk().alias("chunk"), "seq", frag.alias("frag"))
    return grouped(items, "chunk", "seq", lambda pid, body: F.concat(
        F.lit('<html><body><ul class="list-group">'), body, F.lit("</ul></body></html>")))


def tabular_rows(postings: DataFrame) -> DataFrame:
    """Board-library rows (site names in mixed case, one unknown site)."""
    q = F.col("seq")
    site = (F.when(q % 4 == 0, "linkedin").when(q % 4 == 1, "Indeed").when(q % 4 == 2, "glassdoor")
            .otherwise("zip_recruiter"))
    return postings.select(
        "seq", "run_no", site.alias("site"),
        F.when(q % 13 == 6, F.lit(None)).otherwise(F.col("title")).alias("title"),
        "company", F.when(q % 13 == 5, F.lit(None)).otherwise(F.col("location")).alias("location"),
        F.col("url").alias("job_url"),
        F.when(q % 13 == 7, F.lit(None)).otherwise(F.col("description")).alias("description"),
        F.date_format("posted_at", "yyyy-MM-dd").alias("date_posted"))


def _k():
    q = F.col("seq")
    return F.when(q % 10 == 9, q - 9).otherwise(q)


def card_rows(postings: DataFrame, feed: str, base: str) -> DataFrame:
    """One row per rendered card; page ``step`` = chunk (even steps: remote pass)."""
    q = F.col("seq")
    step = _chunk()
    href = (F.when(q % 23 == 22, F.lit(""))
            .when(q % 6 == 0, F.concat(F.lit(base + "/empleos/oferta-"), _k().cast("string")))
            .otherwise(F.concat(F.lit("/empleos/oferta-"), _k().cast("string"))))
    marker = F.when(q % 3 != 0, F.lit("Home office")).otherwise(F.lit("Presencial"))
    raw = F.concat_ws("\n", F.lit("Nuevo"), F.col("title"), F.col("company"), marker)
    return postings.select(
        F.lit(feed).alias("feed"), step.alias("step"), (q % CHUNK).alias("pos"), href.alias("href"),
        raw.alias("raw"),
        F.when(q % 13 == 6, F.lit("")).otherwise(F.col("title")).alias("title"), "company",
        F.concat_ws(" ", F.col("title"), F.col("company"), marker).alias("text"),
        (step % 2 == 0).alias("is_remote"), (step % 16 == 13).alias("blocked"))


def thread_hits(orders: DataFrame) -> DataFrame:
    """W4 input: search hits (object_id, title, created_at)."""
    return orders.select(F.col("o_orderkey").alias("object_id"),
                         F.concat(F.lit("Ask HN: Who is hiring? ("), F.col("o_orderpriority"), F.lit(")"))
                         .alias("title"), F.col("o_orderdate").alias("created_at"))
