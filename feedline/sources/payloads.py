"""Landed feed payloads built from the derived posting / lead views.

The driver tables hold no feed payloads, so each feed's response shape is
rebuilt from the derived views with ``to_json`` and then read back through
the reader under test.  Items are grouped ``CHUNK`` per payload (a bounded
group: ``collect_list`` never sees more than CHUNK rows), ordered by seq.

Edge cases are placed by rule on ``seq`` so the DuckDB twin can restate them:
missing keys, explicit nulls, zero salary, empty links, RFC-2822 dates with
``+0000`` and ``GMT``, unparseable dates, non-USD currencies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 50
NULL_MARK = "@@explicit-null@@"

# Shapes of metadata items placed ahead of a JSON-array feed's postings.
ARRAY_PREAMBLE = ('{"legal":"terms of use apply"}', "42")


def _json(struct: Column) -> Column:
    """to_json with absent (null) fields omitted and NULL_MARK turned into JSON null."""
    return F.regexp_replace(F.to_json(struct), '"' + NULL_MARK + '"', "null")


def _chunked(items: DataFrame, wrap) -> DataFrame:
    """Group (seq, js) items into payloads of CHUNK, ordered by seq; ``wrap`` builds the text."""
    g = (items.groupBy((F.col("seq") / CHUNK).cast("bigint").alias("payload_id"))
         .agg(F.array_sort(F.collect_list(F.struct("seq", "js"))).alias("xs")))
    body = F.array_join(F.transform("xs", lambda x: x["js"]), ",")
    return g.select("payload_id", wrap(F.col("payload_id"), body).alias("payload"))


#: Landed files per folder.
FILES_PER_FOLDER = 50


def land_pages(pages: DataFrame, path: str, page: str = "payload_id", *then: str) -> None:
    """Each ``payload`` as a file of its own under ``path``; the files' names come in the natural order of ``page`` (a number) and ``then``.

    The pages of a folder are written by one task in their order, and Spark counts
    the files of a task: no folder per page, whose making and listing would cost
    more than its text.  They are packed, as Spark and Hadoop read them by their names.
    """
    rows = pages.select("payload", page, *then, (F.col(page) / FILES_PER_FOLDER).cast("bigint").alias("block"))
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as small texts would share one task
    rows = rows.repartition(tasks, "block").sortWithinPartitions("block", page, *then)
    rows.select("payload", "block").write.option("maxRecordsPerFile", 1).option("compression", "gzip").partitionBy("block").text(path)


def _epoch(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def json_array_payloads(postings: DataFrame) -> DataFrame:
    """S1 payloads: [meta, 42, {position, company, slug, description, epoch, salary_min}, ...]."""
    s = F.col("seq") % 13
    item = F.struct(
        F.when(s == 6, F.lit(NULL_MARK)).otherwise(F.col("title")).alias("position"),
        F.when(s != 5, F.col("company")).alias("company"),
        F.concat(F.lit("job-"), F.col("seq").cast("string")).alias("slug"),
        F.when(s != 9, F.col("description")).alias("description"),
        F.array(F.lit("dev"), F.col("source")).alias("tags"),
        F.when(s != 8, _epoch(F.col("posted_at"))).alias("epoch"),
        F.when(s == 7, F.lit(0.0)).otherwise(F.col("min_salary_usd_monthly") * 12).alias("salary_min"),
    )
    items = postings.select("seq", _json(item).alias("js"))
    pre = ",".join(ARRAY_PREAMBLE)
    return _chunked(items, lambda pid, body: F.concat(F.lit("[" + pre + ","), body, F.lit("]")))


def json_envelope_payloads(postings: DataFrame) -> DataFrame:
    """S2 payloads: {"jobs": [...]}; every fifth payload lacks the ``jobs`` key."""
    s = F.col("seq") % 13
    item = F.struct(
        F.col("seq").alias("id"),
        F.when(s == 6, F.lit(NULL_MARK)).otherwise(F.col("title")).alias("title"),
        F.col("company").alias("company_name"),
        F.when(s != 5, F.col("location")).alias("candidate_required_location"),
        F.when(s != 7, F.col("url")).alias("url"),
        F.col("description").alias("description"),
    )
    items = postings.select("seq", _json(item).alias("js"))
    key = lambda pid: F.when(pid % 5 == 4, F.lit("jobz")).otherwise(F.lit("jobs"))
    return _chunked(items, lambda pid, body: F.concat(F.lit('{"'), key(pid), F.lit('":['), body, F.lit("]}")))


def _rfc2822(ts: Column, zone: str) -> Column:
    return F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" " + zone))


def json_salaried_payloads(postings: DataFrame) -> DataFrame:
    """S3 payloads: {"jobs": [...]} with links, restrictions, mixed dates and salaries."""
    q = F.col("seq")
    ts = F.col("posted_at")
    pub = (F.when(ts.isNull(), F.lit(None))
           .when(q % 4 == 0, _epoch(ts).cast("string"))
           .when(q % 4 == 1, _rfc2822(ts, "+0000"))
           .when(q % 4 == 2, _rfc2822(ts, "GMT"))
           .otherwise(F.lit("not a date")))
    sal = F.col("min_salary_usd_monthly")
    period = (F.when(q % 4 == 0, "annual").when(q % 4 == 1, "monthly").when(q % 4 == 2, "hourly"))
    amount = F.when(q % 13 == 7, F.lit(0.0)).when(q % 4 == 0, sal * 12).otherwise(sal)
    item = F.struct(
        F.when(q % 13 == 6, F.lit(NULL_MARK)).otherwise(F.col("title")).alias("title"),
        F.col("company").alias("companyName"),
        F.when(q % 13 == 5, F.lit("")).otherwise(F.col("url")).alias("applicationLink"),
        F.concat(F.lit("https://himalayas.app/jobs/g"), q.cast("string")).alias("guid"),
        F.col("description").alias("description"),
        F.when(q % 3 == 0, F.array().cast("array<string>"))
        .when(q % 3 == 1, F.array(F.col("location"), F.lit("Other"))).alias("locationRestrictions"),
        F.when(q % 5 == 0, F.lit("EUR")).otherwise(F.lit("USD")).alias("currency"),
        F.when(sal.isNotNull(), amount).alias("minSalary"),
        period.alias("salaryPeriod"),
    )
    # pubDate: an int for epoch rows, a string otherwise -> spliced in as raw JSON.
    pub_js = (F.when(pub.isNull(), F.lit(""))
              .when(q % 4 == 0, F.concat(F.lit(',"pubDate":'), pub))
              .otherwise(F.concat(F.lit(',"pubDate":'),
                                  F.regexp_extract(F.to_json(F.array(pub)), r"^\[(.*)\]$", 1))))
    js = F.concat(F.expr("substring(js0, 1, length(js0) - 1)"), F.col("pub_js"), F.lit("}"))
    items = (postings.select("seq", _json(item).alias("js0"), pub_js.alias("pub_js"))
             .select("seq", js.alias("js")))
    return _chunked(items, lambda pid, body: F.concat(F.lit('{"jobs":['), body, F.lit("]}")))


def _escape_html(c: Column) -> Column:
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    return F.replace(c, F.lit(">"), F.lit("&gt;"))


def thread_payloads(postings: DataFrame) -> DataFrame:
    """S4 payloads: pages of two threads, an old one (run 0) and the newest (run 1).

    {"id", "created_at_i", "title", "children": [comment, ...]}.  Comment text: "company | title | REMOTE-or-Onsite<p>description</p>"; every
    13th comment is deleted (null text), the next one is empty.
    """
    q = F.col("seq")
    header = F.concat_ws(" | ", _escape_html(F.col("company")), _escape_html(F.col("title")),
                         F.when(F.col("is_remote"), F.lit("REMOTE")).otherwise(F.lit("Onsite")))
    text = F.concat(header, F.lit("<p>"), _escape_html(F.col("description")), F.lit("</p>"))
    item = F.struct(
        q.alias("id"), F.lit("someone").alias("author"),
        F.when(q % 13 == 6, F.lit(NULL_MARK)).when(q % 13 == 7, F.lit("")).otherwise(text).alias("text"),
        _epoch(F.col("posted_at")).alias("created_at_i"))
    def pages(run: int) -> DataFrame:
        items = postings.filter(F.col("run_no") == run).select("seq", _json(item).alias("js"))
        head = f'{{"id":{run},"created_at_i":{1_700_000_000 + run},"title":"Ask HN: Who is hiring?","children":['
        return _chunked(items, lambda pid, body: F.concat(F.lit(head), body, F.lit("]}")))

    return pages(0).unionByName(pages(1))


def geo_payloads(elements: DataFrame) -> DataFrame:
    """S12 payloads: {"elements": [...]} with nodes (lat/lon) and ways (center)."""
    item = F.struct(
        F.col("type"), F.col("element_id").alias("id"),
        F.col("lat"), F.col("lon"),
        F.when(F.col("center_lat").isNotNull(),
               F.struct(F.col("center_lat").alias("lat"), F.col("center_lon").alias("lon"))).alias("center"),
        F.struct(F.col("name"), F.col("website")).alias("tags"))
    items = elements.select(F.col("element_id").alias("seq"), _json(item).alias("js"))
    return _chunked(items, lambda pid, body: F.concat(F.lit('{"elements":['), body, F.lit("]}")))
