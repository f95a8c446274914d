"""Document fingerprints by winnowing, in DataFrame functions only.

A text is cut into words ``[^\\x20\\x09-\\x0D]+``; every run of ``k`` words is a
gram (fewer words: one gram of all; none: no gram).  Each gram is hashed, and
of every ``window`` grams in a row the smallest hash is chosen, the rightmost
if several are equal.  The fingerprint is the list of chosen hashes with their
positions.  So any ``k + window - 1`` words in a row that two texts share leave
a common hash, at known places; equal texts have equal fingerprints.

A chosen gram is one long: 40 bits of hash above 24 bits of inverted position,
so the smallest long is the smallest hash furthest right.  Positions count
modulo 2^24 words, the list itself is in the order of the text.

``next_documents`` orders documents by descending id (null last, equal ids by the
hash of their text) and gives each its successor, the last one the first:
ids are range-partitioned, and only the edges of partitions are compared
across them.  Texts are whole; a null text is an empty text and an empty text has an
empty fingerprint, which is fully like another empty one.  Rows that repeat
id and text are one document in that order and stay separate rows of the
result.  An empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

K, WINDOW = 5, 8
POSITION_BITS = 24
_LOW = (1 << POSITION_BITS) - 1
#: ASCII white space beside the space.
BLANKS = "\t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    flat = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), BLANKS, F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(flat, " "), "")


def with_fingerprint(df: DataFrame, text_col: str, out: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """``df`` with the chosen grams of ``text_col`` as the array of longs ``out``."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != out]

    # each step names its array before the next one refers to it more than once, so none is evaluated twice
    def step(d: DataFrame, col: Column) -> DataFrame:
        return d.select(*rest, col.alias("__a"))

    def gram(x: Column, i: Column) -> Column:
        h = F.xxhash64(x, *(F.get("__a", i + j) for j in range(1, k)))
        place = F.lit(_LOW) - i.cast("long").bitwiseAND(F.lit(_LOW))
        return h.bitwiseAND(F.lit(~_LOW)).bitwiseOR(place)

    d = step(df, words(F.col(f"`{text_col}`")))
    d = step(d, F.slice(F.transform("__a", gram), F.lit(1), F.greatest(F.lit(1), F.size("__a") - (k - 1))))
    d = step(d, F.slice(F.transform("__a", lambda x, i: F.least(x, *(F.get("__a", i + j) for j in range(1, window)))),
                        F.lit(1), F.greatest(F.lit(1), F.size("__a") - (window - 1))))
    return d.select(*rest, F.array_distinct("__a").alias(out))


def entries(chosen: Column) -> Column:
    """The chosen grams as ``array<struct<hash: long, position: long>>``; positions from 0, modulo 2^24."""
    return F.transform(chosen, lambda x: F.struct(
        F.shiftright(x, POSITION_BITS).alias("hash"), (F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW))).alias("position")))


def hashes(chosen: Column) -> Column:
    return F.transform(chosen, lambda x: F.shiftright(x, POSITION_BITS))


def digest(chosen: Column) -> Column:
    """A 128-bit name of a fingerprint: equal for equal hashes at equal positions."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(chosen)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), chosen)), 16, "0")))


def likeness(a: str, b: str) -> Column:
    """Shared hashes over all hashes of two hash arrays; two empty ones are alike."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(both, F.lit(0)))


def next_documents(ids: DataFrame, scratch: Scratch, range_rows: int = 50_000) -> DataFrame:
    """``did, tie, next_did, next_tie`` from distinct ``did, tie`` in descending order; the last is followed by the first."""
    n = ids.count()
    order = [F.col("did").desc(), F.col("tie").desc()]
    placed = scratch.write(ids.repartitionByRange(max(1, -(-n // range_rows)), *order).withColumn("pid", F.spark_partition_id()), "placed")
    within = Window.partitionBy("pid").orderBy(*order)
    follow = placed.withColumns({"next_did": F.lead("did").over(within), "next_tie": F.lead("tie").over(within)})
    # one row per range
    heads = placed.groupBy("pid").agg(F.max(F.struct("did", "tie")).alias("head"))
    everything = Window.partitionBy()
    across = heads.select(F.col("pid").alias("p"), F.coalesce(
        F.lead("head").over(Window.orderBy("pid")), F.max("head").over(everything)).alias("after"))
    last = F.col("next_tie").isNull()
    return follow.join(across, F.col("pid") == F.col("p")).select(
        "did", "tie", F.when(last, F.col("after.did")).otherwise(F.col("next_did")).alias("next_did"),
        F.when(last, F.col("after.tie")).otherwise(F.col("next_tie")).alias("next_tie"), "n_chars")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW, share: int = 3) -> DataFrame:
    """Each document beside its edited text and its successor.

    ``id_col, n_chars, edited, chosen, edited_chosen, near_edited, near_next``: the
    edited text has its last floor(n_chars / share) code points replaced by the
    first as many of the next document's (or all that it has).
    """
    scratch = Scratch(docs.sparkSession, "winnowing")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1 << 63)).alias("did"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    ids = scratch.write(rows.select("did", "tie", F.length("text").cast("long").alias("n_chars")), "ids")
    one_each = ids.groupBy("did", "tie").agg(F.max("n_chars").alias("n_chars"))
    follow = scratch.write(next_documents(one_each, scratch), "follow")
    # the successor's row gives its first code points and its hashes; texts are shuffled by id once and serve both joins
    wanted = follow.select("next_did", "next_tie", F.col("did").alias("of_did"), F.col("tie").alias("of_tie"), F.floor(F.col("n_chars") / share).cast("int").alias("need"))
    ahead = rows.join(wanted, (rows.did == wanted.next_did) & (rows.tie == wanted.next_tie)).select(
        "of_did", "of_tie", "need", F.substring("text", F.lit(1), F.col("need")).alias("head"), "text")
    ahead = with_fingerprint(ahead, "text", "next_chosen", k, window).select(
        "of_did", "of_tie", "need", "head", hashes(F.col("next_chosen")).alias("next_hashes"))
    if ids.count() > follow.count():  # repeated rows: one of them speaks for all
        ahead = ahead.dropDuplicates(["of_did", "of_tie"])
    pairs = rows.join(ahead, (rows.did == ahead.of_did) & (rows.tie == ahead.of_tie)).select(
        F.when(F.col("did") > -1 << 63, F.col("did")).alias("id"), "text", F.length("text").cast("long").alias("n_chars"), "need", "head", "next_hashes")
    pairs = pairs.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("need")).cast("int")), "head")).drop("head", "need")
    pairs = with_fingerprint(pairs, "text", "chosen", k, window).drop("text")
    pairs = with_fingerprint(pairs, "edited", "edited_chosen", k, window)
    pairs = pairs.withColumns({"h": hashes(F.col("chosen")), "e": hashes(F.col("edited_chosen"))})
    return pairs.select(F.col("id").alias(id_col), "n_chars", "edited", "chosen", "edited_chosen",
                        likeness("h", "e").alias("near_edited"), likeness("h", "next_hashes").alias("near_next"))
