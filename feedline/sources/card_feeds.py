"""S8 (tabular board rows) and S9-S11 (browser-rendered result cards).

The browser feeds are re-aimed as readers over a landed card table, one row
per card: ``(feed, step, pos, href, raw | title/company/text, blocked)``
where ``step`` orders the pages a run visited (term x pass, remote pass
first) and ``blocked`` marks a page whose title said 403/Forbidden.

Per-feed order of operations is kept exactly, because it changes results:

* S9 / S11: skip empty hrefs -> first card per **raw** href (A2) -> P3 title
  -> (S9, remote pass) marker test F9.  The href is claimed before the title
  and marker tests, so a rejected card is lost to later pages (trap 3).
* S10: skip cards without title/href -> first card per **absolute** URL
  -> marker test on the whole card text (remote pass).
* All: a blocked page stops the feed's remaining pages (F13/W5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import date_to_ts
from ..functions.text import (absolutise_if_rooted, absolutise_unless_http, contains_any,
                              strip, title_case, title_company_lines)
from ..operators.dedup import dedup_first
from ..operators.joins import map_source
from ..operators.predicates import EMPTY, NOT_PARSABLE, WRONG_SHAPE, finish
from ..operators.windows import cut_after_first_block
from ..schema import POSTING, place

# Board bases and remote marker words.
CARD_TEXT_BASE = "https://www.bumeran.com.mx"
CARD_FIELDS_BASE = "https://mx.computrabajo.com"
CARD_LINKS_BASE = "https://www.occ.com.mx"
CARD_TEXT_MARKERS = ("remoto", "home office", "teletrabajo", "trabajo remoto")
CARD_FIELDS_MARKERS = ("remoto", "home office", "teletrabajo")


#: A landed response of a board whose pages are rendered: the cards of a page, or rows of the board library, as one JSON list.
CARD = "step: bigint, pos: bigint, href: string, raw: string, title: string, company: string, text: string, is_remote: boolean, blocked: boolean"
BOARD_ROW = "seq: bigint, site: string, title: string, company: string, location: string, job_url: string, description: string, date_posted: string, is_remote: boolean"


def json_rows(payloads: DataFrame, fields: str) -> DataFrame:
    """The rows of JSON lists, one list a payload; a payload that is none gives nothing (``bad_lists`` says why)."""
    return payloads.select(F.inline(F.from_json("payload", f"array<struct<{fields}>>")))


def bad_lists(payloads: DataFrame) -> DataFrame:
    """a reject for each payload that is not a JSON list."""
    v = F.try_parse_json("payload")
    blank = F.trim(F.coalesce(F.col("payload"), F.lit(""))) == ""
    reason = F.when(blank, F.lit(EMPTY)).when(v.isNull(), F.lit(NOT_PARSABLE)).when(~F.schema_of_variant(v).startswith("ARRAY"), F.lit(WRONG_SHAPE))
    bad = payloads.select(place(F.col("payload_id"), F.lit(0)).alias("seq"), reason.alias("bad")).filter("bad is not null")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in POSTING.fields if f.name != "seq"]
    return finish(bad.select("seq", "bad", *empty), True)


def landed_cards(read, feed: str, city: str):
    """A reader of card payloads: ``read`` over the cards, of the remote passes only where there is no local search."""
    def run(payloads: DataFrame, with_rejects: bool = True) -> DataFrame:
        cards = json_rows(payloads, CARD).withColumn("feed", F.lit(feed))
        rows = read(cards if city else cards.filter("is_remote"), city=city, with_rejects=with_rejects)
        return rows.unionByName(bad_lists(payloads)) if with_rejects else rows
    return run


def landed_board(spark: SparkSession, city: str):
    """A reader of payloads with rows of the board library; each row says of which pass it is."""
    def run(payloads: DataFrame, with_rejects: bool = True) -> DataFrame:
        rows = json_rows(payloads, BOARD_ROW)
        out = read_tabular_passes(spark, rows.filter("is_remote"), rows.filter("not is_remote") if city else None, with_rejects)
        return out.unionByName(bad_lists(payloads)) if with_rejects else out
    return run


def _location(city: str) -> F.Column:
    return title_case(F.lit(city)) if city else F.lit("Remote")


def _seq():
    return place(F.col("step"), F.col("pos")).alias("seq")


def read_card_text(cards: DataFrame, source: str = "bumeran", base: str = CARD_TEXT_BASE,
                   markers=CARD_TEXT_MARKERS, city: str = "", with_rejects: bool = False) -> DataFrame:
    """S9 (markers given) / S11 (markers None): href + inner text cards."""
    c = cut_after_first_block(cards).filter(F.coalesce(F.col("href"), F.lit("")) != "")
    c = c.select(_seq(), "href", "raw", "is_remote")
    c = dedup_first(c, "href")
    tc = title_company_lines(F.col("raw"))
    c = c.withColumn("__tc", tc).filter(F.col("__tc.title") != "")
    if markers:
        c = c.filter(~F.col("is_remote") | contains_any(F.lower(F.col("raw")), markers))
    loc = F.when(F.col("is_remote"), F.lit("Remote")).otherwise(_location(city))
    return finish(c.select(
        "seq", F.col("__tc.title").alias("title"), F.col("__tc.company").alias("company"),
        loc.alias("location"), absolutise_unless_http("href", base).alias("url"),
        F.lit(source).alias("source"), "is_remote", F.lit("").alias("description"),
        F.lit(None).cast("timestamp_ntz").alias("posted_at"),
        F.lit(None).cast("double").alias("min_salary_usd_monthly")), with_rejects)


def read_card_links(cards: DataFrame, city: str = "", with_rejects: bool = False) -> DataFrame:
    """Like S9 without the marker test (the pass is encoded in the URL)."""
    return read_card_text(cards, "occ", CARD_LINKS_BASE, None, city, with_rejects)


def read_card_fields(cards: DataFrame, base: str = CARD_FIELDS_BASE, markers=CARD_FIELDS_MARKERS,
                     city: str = "", with_rejects: bool = False) -> DataFrame:
    """Cards with title / company / href / full text fields; a blank title is no title."""
    c = cut_after_first_block(cards).withColumn("title", strip(F.coalesce(F.col("title"), F.lit(""))))
    c = c.filter((F.col("title") != "") & (F.coalesce(F.col("href"), F.lit("")) != ""))
    c = c.select(_seq(), "title", strip(F.coalesce(F.col("company"), F.lit(""))).alias("company"),
                 absolutise_if_rooted("href", base).alias("url"), "text", "is_remote")
    c = dedup_first(c, "url")
    c = c.filter(~F.col("is_remote") | contains_any(F.lower(F.col("text")), markers))
    loc = F.when(F.col("is_remote"), F.lit("Remote")).otherwise(_location(city))
    return finish(c.select(
        "seq", "title", "company", loc.alias("location"), "url", F.lit("computrabajo").alias("source"),
        "is_remote", F.lit("").alias("description"), F.lit(None).cast("timestamp_ntz").alias("posted_at"),
        F.lit(None).cast("double").alias("min_salary_usd_monthly")), with_rejects)


def read_tabular(spark: SparkSession, rows: DataFrame, is_remote: bool, with_rejects: bool = False) -> DataFrame:
    """One pass of board-library rows (site, title, company, location, job_url,
    description, date_posted); the site maps to a source (J8, unknown -> dropped),
    the date becomes midnight UTC (P8), the remote flag is the pass's literal."""
    m = map_source(rows, spark, "site")
    # the remote pass comes first, whatever numbers the rows of either pass bear
    return finish(m.select(
        place(F.lit(0 if is_remote else 1), F.col("seq")).alias("seq"), "title", "company",
        F.coalesce(F.col("location"), F.lit("Remote")).alias("location"),
        F.col("job_url").alias("url"), "source", F.lit(is_remote).alias("is_remote"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        date_to_ts(F.col("date_posted")).alias("posted_at"),
        F.lit(None).cast("double").alias("min_salary_usd_monthly")), with_rejects)


def read_tabular_passes(spark: SparkSession, remote_rows: DataFrame, local_rows: DataFrame | None,
                        with_rejects: bool = False) -> DataFrame:
    """The remote pass, then (when local search is on) the local pass."""
    out = read_tabular(spark, remote_rows, True, with_rejects)
    if local_rows is not None:
        out = out.unionByName(read_tabular(spark, local_rows, False, with_rejects))
    return out
