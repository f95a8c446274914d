"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Sizes are words.  Sources, by code point with null last, take the weights in
turn; targets share ``share`` of all sizes by weight, stop at ``most`` times
their source's size, and the excess goes to the others by weight.  With the
sources in order of cap per weight, the level that the others share is the
largest of (what is left of the budget) / (what is left of the weights), so no
repetition is needed.

Each source's documents, shuffled by a hash of their id, queue up to ``most``
times.  The virtual finish time of a copy is the source's words up to and with
it, divided by the source's target.  All copies in order of finish time fill
the budget; the first that does not fit ends the mix.

Running sums are never taken over a whole source or over all copies: a source
is cut into ranges of its shuffled order and the finish times into ranges too,
both of about ``range_rows`` rows, sums of ranges are added up first, and rows
run only within their range.  One row per source and one per range are the
only tables with an unpartitioned order.

Nulls: a null text has size 0; null ids are one id, null sources one source.  Empty
texts take no words.  Repeated rows are documents of their own.  An empty
table gives an empty table.  Other columns are not read by ``mix`` and kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import row_hashes, unused
from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS = 60


def words(text: Column) -> Column:
    """Number of words of a text."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, seed: int) -> Column:
    """A 60-bit pseudo-random order key of an id."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """``source, n, source_size, rank, target`` from ``source, n, source_size``: one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(by_name))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") - 1) % len(weights) + 1))
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("source_size").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most
    budget = F.sum("source_size").over(everything) * F.lit(share)
    rest = F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = ranked.withColumn("level", (budget - before) / rest).withColumn("level", F.max("level").over(everything))
    cap = (F.col("source_size") * most).cast("double")
    return level.select("source", "n", "source_size", "rank", F.least(cap, F.col("weight") * F.col("level")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, seed: int = 17,
        range_rows: int = 4_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        row_key: tuple[Column, ...] = ()) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` (and ``k0, k1, ...`` for ``row_key``), one row per document.

    ``copies``: how often the mix takes the document; ``taken``: its words times that.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    keys = [k.alias(f"k{i}") for i, k in enumerate(row_key)]
    names = [f"k{i}" for i in range(len(keys))]
    sized = scratch.write(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        words(F.col(text_col)).alias("size"), shuffle_key(F.col(id_col), seed).alias("key"), *keys), "sized")
    sources = scratch.write(targets(
        sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size")), weights, share, most), "sources")
    total = sources.agg(F.count(F.lit(1)), F.sum("n"), F.sum("source_size")).first()  # three numbers
    n, budget = total[1] or 0, int((total[2] or 0) * share)

    # ranges of each source's shuffled order
    cuts = sources.select(F.col("source").alias("s"), "source_size", "rank", "target", F.ceil(F.col("n") / range_rows).alias("cuts"))
    rows = sized.join(cuts, sized.source.eqNullSafe(cuts.s)).drop("s", "source").withColumn(
        "at", F.floor(F.col("key") / F.lit(float(1 << KEY_BITS)) * F.col("cuts")))
    sums = rows.groupBy("rank", "at").agg(F.sum("size").alias("words")).select(
        F.col("rank").alias("r"), F.col("at").alias("a"), (F.sum("words").over(Window.partitionBy("rank").orderBy("at")) - F.col("words")).alias("before"))
    order = ["key", "doc_id", "size", *names]
    within = Window.partitionBy("rank", "at").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.join(sums, (rows.rank == sums.r) & (rows["at"] == sums.a)).withColumn(
        "upto", F.col("before") + F.sum("size").over(within))
    queued = scratch.write(queued.drop("r", "a", "at", "before", "cuts"), "queued")
    scratch.drop("sized")

    def start(e: int | Column) -> Column:
        return F.lit(e) * F.col("source_size") + F.col("upto")

    def finish(e: int | Column) -> Column:
        return start(e) / F.nullif(F.col("target"), F.lit(0.0))

    def waits(e: int | Column) -> Column:  # a copy that starts after its source's target is never in the mix
        return (F.col("target") > 0) & (start(e) - F.col("size") < F.col("target"))

    # ranges of finish times; only the one in which the budget ends is put in order
    cells = max(1, -(-n // range_rows))
    copies = queued.withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).filter(waits(F.col("e"))).withColumn(
        "finish", finish(F.col("e"))).withColumn("cell", F.floor(F.col("finish") * cells))
    filled = copies.groupBy("cell").agg(F.sum("size").alias("words")).withColumn(
        "upto", F.sum("words").over(Window.orderBy("cell")))
    edge = filled.filter(F.col("upto") > budget).orderBy("cell").limit(1).select("cell", F.col("upto") - F.col("words")).first()
    place = ["finish", "rank", *order, "e"]
    if edge is None:
        inside = lambda e: waits(e)
    else:
        cell, before = edge
        last = copies.filter(F.col("cell") == cell).withColumn(
            "upto", F.lit(before) + F.sum("size").over(Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)))
        last = last.filter(F.col("upto") <= budget).agg(F.max(F.struct(*place)).alias("last"))
        queued = queued.crossJoin(F.broadcast(last))  # one row

        def inside(e: int) -> Column:
            own = F.struct(finish(e).alias("finish"), "rank", *order, F.lit(e).alias("e"))
            at = F.floor(finish(e) * cells)
            return waits(e) & ((at < cell) | ((at == cell) & F.coalesce(own <= F.col("last"), F.lit(False))))

    taken = sum((F.when(inside(e), 1).otherwise(0) for e in range(most)), F.lit(0))
    return queued.withColumn("copies", taken).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *names)


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    k0, k1, copies, copy = (unused(n, docs.columns) for n in ("__k0", "__k1", "__copies", "__copy"))
    keys = row_hashes(docs)
    taken = mix(docs, id_col=id_col, row_key=keys, **options).groupBy(F.col("k0").alias(k0), F.col("k1").alias(k1)).agg(F.sum("copies").alias(copies))
    # equal rows stand for each other: one of them carries the copies of all
    rows = docs.withColumns(dict(zip((k0, k1), keys))).dropDuplicates([k0, k1])
    rows = rows.join(taken.filter(F.col(copies) > 0), [k0, k1])
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))
