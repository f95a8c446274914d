"""Near-duplicate embeddings by counting collisions of one-dimensional projections.

Vectors with equal label and dimension link at a cosine of ``threshold`` or
more, in double precision.  Two unit vectors that link are no further apart
than d = sqrt(2 - 2 * threshold), so their projections on a random direction
differ by about d / sqrt(dimension).

* Tables.  A table cuts each of ``cells`` projections into cells six such
  differences wide; vectors that share all cells of a table meet.  The number of
  cells follows from the largest label's size, so that strangers rarely meet, and
  the number of tables from ``recall``: a pair at the threshold misses every
  table with a probability under 1 - recall, closer pairs far less.
* Counting.  Where vectors meet, further projections are sorted, and each vector
  collides with those within a window around it (two differences wide to
  either side).  Pairs with enough collisions are verified by their cosine; the
  count that is enough loses one linking pair in ten thousand at the threshold.
* A pair that meets in several tables counts in the first only.

Equal vectors are one class before anything is compared, and count by their
number.  A meeting of more than ``block`` classes is cut into blocks that are
compared two by two in tasks of their own, so a hot group is spread and no task
holds more than two blocks.  Tasks return, per class, how many vectors it links
with and one link to the smallest class it is connected with there: rows grow
with the classes, never with their pairs.

Vectors that are null, empty, zero, or hold a null or non-finite component, and
rows without a label or id, link with nothing.  Repeated rows are vectors of their
own.  An empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .batches import M1, frugal, mix64, whole_groups
from .components import LocalComponents, connected_components
from .scratch import Scratch

CELL, WINDOW = 6.0, 2.0  #: widths in typical differences of a pair at the threshold
PROJECTIONS = 24


def _normal_below(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def settings(threshold: float, recall: float, largest: int) -> tuple[int, int, int]:
    """Cells per table, tables, and the collisions that a candidate needs."""
    # a difference of sd 1 keeps within a cell of width w with probability 1 - E|x| / w
    stay = 1 - math.sqrt(2 / math.pi) / CELL
    d = math.sqrt(2 - 2 * threshold)
    met = min(0.9, CELL * d / (math.sqrt(2) * math.sqrt(2 * math.pi)))  # strangers in one cell
    cells = max(4, math.ceil(math.log(max(largest, 2)) / -math.log(met)))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - stay ** cells))
    p = 2 * _normal_below(WINDOW) - 1
    enough, lost = 0, 0.0
    while True:
        lost += math.comb(PROJECTIONS, enough) * p ** enough * (1 - p) ** (PROJECTIONS - enough)
        if lost > 1e-4:
            return cells, tables, enough
        enough += 1


def directions(dim: int, n: int, seed: int) -> np.ndarray:
    a = np.random.default_rng([seed, dim]).standard_normal((dim, n))
    return a / np.linalg.norm(a, axis=0)


def _unit(col: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """By dimension: the dimension, the rows that have it, and their unit vectors in double precision."""
    sizes = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.cumsum(sizes) - sizes
    out = []
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        x = flat[start[rows][:, None] + np.arange(dim)]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        out.append((int(dim), rows, x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]))
    return out


def _cells(unit: np.ndarray, label: np.ndarray, threshold: float, cells: int, tables: int, seed: int) -> np.ndarray:
    """The place of each vector in each table, as 64-bit names (rows x tables)."""
    dim = unit.shape[1]
    width = CELL * math.sqrt(2 - 2 * threshold) / math.sqrt(dim)
    shift = np.random.default_rng([seed, dim, 1]).random(cells * tables)
    at = np.floor((unit @ directions(dim, cells * tables, seed)) / width + shift).astype(np.int64).view(np.uint64)
    name = np.empty((len(unit), tables), np.uint64)
    for t in range(tables):
        h = mix64(label.astype(np.int64).view(np.uint64) * M1 + np.uint64(dim * tables + t))
        for c in range(cells):
            h = mix64(h + at[:, t * cells + c])
        name[:, t] = h
    return name.view(np.int64)


def links_within(unit: np.ndarray, size: np.ndarray, name: np.ndarray, block: np.ndarray, table: int,
                 threshold: float, enough: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of classes that meet in a table: vectors that each links with there, and its component.

    ``block``: with two blocks present only pairs across them are taken.
    """
    m, dim = unit.shape
    window = WINDOW * math.sqrt(2 - 2 * threshold) / math.sqrt(dim)
    sides = directions(dim, PROJECTIONS, seed + 1)
    proj = unit @ sides
    order = np.argsort(proj[:, 0], kind="stable")
    proj, b = proj[order], block[order]
    across = b.min() != b.max()
    links, found = np.zeros(m, np.int64), LocalComponents(m)
    for lo in range(0, m, 256):
        hi = min(lo + 256, m)
        hits = np.zeros((hi - lo, m - lo), np.int8)
        for q in range(PROJECTIONS):
            hits += np.abs(proj[lo:hi, q, None] - proj[None, lo:, q]) <= window
        i, j = np.nonzero(hits >= enough)
        i, j = i + lo, j + lo
        take = (i < j) & ((b[i] != b[j]) if across else True)
        i, j = order[i[take]], order[j[take]]
        cos = np.einsum("ij,ij->i", unit[i], unit[j])
        near = cos >= threshold
        i, j = i[near], j[near]
        if not len(i):
            continue
        found.join(i, j)
        first = (name[i] == name[j]).argmax(axis=1) == table
        i, j = i[first], j[first]
        np.add.at(links, i, size[j])
        np.add.at(links, j, size[i])
    return links, found.label


def near_duplicates(emb: DataFrame, threshold: float = 0.98, recall: float = 0.9995, block: int = 2048, seed: int = 11,
                    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id_col, n_links, component_id``: per row the vectors it links with directly and the smallest id it reaches."""
    scratch = Scratch(emb.sparkSession, "embeddings")
    vec = F.col(vec_col).cast("array<double>")
    rows = emb.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vec.alias("vec"))
    inf = float("inf")
    sound = (F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()
             & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists("vec", lambda x: x != 0))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    named = scratch.write(rows.select("id", "sound", F.xxhash64("label", "vec").alias("h0"), F.xxhash64(F.lit(1), "label", "vec").alias("h1"), "label",
                                      F.when(F.col("sound"), F.col("vec")).alias("vec")), "named")
    classes = scratch.write(named.filter("sound").groupBy("h0", "h1").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("label").alias("label"), F.first("vec").alias("vec")), "classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    cells, tables, enough = settings(threshold, recall, largest)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column("label").to_numpy()
            names = np.zeros((b.num_rows, tables), np.int64)
            for _, r, unit in _unit(b.column("vec")):
                names[r] = _cells(unit, label[r], threshold, cells, tables, seed)
            if b.num_rows:
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * tables, pa.int32()), pa.array(names.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, "names"])

    placed = scratch.write(classes.mapInArrow(frugal(meet), StructType([*classes.schema, StructField("names", ArrayType(LongType()))])), "placed")
    spread = placed.select("h0", "h1", "rep", "size", "vec", "names", F.posexplode("names").alias("t", "g"))
    sizes = placed.select(F.explode("names").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    blocks = sizes.select("g", F.ceil(F.col("m") / block).cast("int").alias("nb"))
    # classes that meet nobody go no further; in a large meeting a class goes to each pair of blocks with its own
    met = spread.join(blocks, "g").withColumn("own", F.pmod(F.col("h0"), F.col("nb")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "h0", "h1", "rep", "size", "vec", "names", "t", "own",
        F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other")).alias("g"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab in whole_groups(batches, "g"):
            tab = tab.combine_chunks()
            g, t, own, size, h0, h1, rep = (tab.column(c).to_numpy() for c in ("g", "t", "own", "size", "h0", "h1", "rep"))
            name = tab.column("names").combine_chunks().flatten().to_numpy().reshape(-1, tables)
            out = []
            for _, r, unit in _unit(tab.column("vec").combine_chunks()):
                key = g[r]
                cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(r)]])
                for s, e in zip(cut[:-1], cut[1:]):
                    if e - s < 2:
                        continue
                    x = r[s:e]
                    links, root = links_within(unit[s:e], size[x], name[x], own[x], int(t[x[0]]), threshold, enough, seed)
                    some = np.flatnonzero((links > 0) | (root != np.arange(len(x))))
                    out.append((x[some], links[some], rep[x[root[some]]]))
            if out:
                x, links, root = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h0[x], h1[x], rep[x], links, root)], ["h0", "h1", "rep", "links", "root"])

    found = met.repartition("g").sortWithinPartitions("g").mapInArrow(frugal(compare), "h0 long, h1 long, rep long, links long, root long")
    found = scratch.write(found, "found")
    comp = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")), scratch)
    links = found.groupBy("h0", "h1").agg(F.sum("links").alias("links"))
    info = classes.select("h0", "h1", "rep", "size").join(links, ["h0", "h1"], "left").join(comp, F.col("rep") == F.col("node"), "left")
    info = scratch.write(info.select("h0", "h1", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component")), "info")
    scratch.drop("placed")
    return named.join(info, ["h0", "h1"], "left").select(
        F.col("id").alias(id_col), F.when(F.col("sound"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("sound"), F.col("component")).otherwise(F.col("id")).alias("component_id"))
