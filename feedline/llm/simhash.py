"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints.  A text is lower-cased (A-Z), cut into words
``[^\\x20\\x09-\\x0D]+`` and into shingles of ``shingle`` words joined by one
space, repeats included; fewer words make one shingle, none the fingerprint 0.
Each shingle is hashed with XXH64 (UTF-8, seed 42); a bit is 1 if it is set in
over half of the hashes.

Links.  Two fingerprints link at ``max_bits`` or fewer differing bits.  Cut
into ``max_bits + 1`` blocks, two such fingerprints agree in one block at
least.  So each distinct fingerprint goes once per block into a trie with that
block on top, tries are cut there into independent sub-tries (one per value of
the block), and inside a sub-trie pairs of nodes descend together, adding one
for each differing bit and pruned once the budget is exceeded.  A sub-trie
with more than ``split_above`` fingerprints is cut again in the same way along
the bits below, which loses no link.

Equal fingerprints are one row of the join.  Tasks return a spanning forest of
the links they find, never pairs, so a group of m near copies gives less than m
rows a block; components are then joined across tasks.

Nulls: a null text is an empty text; a null id is kept, and is no smallest id
unless its whole component has none.  Repeated rows are kept and share a component.
An empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import re
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sizing import broadcast_rows_if_bounded
from .batches import ID_ROW_BYTES, frugal, row_hashes, runs, unused, whole_groups
from .components import LocalComponents, connected_components
from .scratch import Scratch

SEED = 42
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Shingle hashes turned into bit counts at a time.
CHUNK = 1 << 14


def simhash(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one text."""
    w = WORD.findall((text or "").encode().lower())
    if not w:
        return 0
    if len(w) < shingle:
        grams = [b" ".join(w)]
    else:
        grams = list(map(b" ".join, zip(*(w[i:] for i in range(shingle)))))
    n, h = len(grams), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        x = np.array([h(g, SEED) for g in grams[at:at + CHUNK]], ">u8")
        ones += np.unpackbits(x.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id_col, fp, *keep)``: one row per document, ``fp`` the fingerprint's bits as a signed long; ``keep`` are longs."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *keep)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(t.as_py(), shingle) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp.view(np.int64)), *map(b.column, keep)], ["id", "fp", *keep])

    return rows.mapInArrow(frugal(scan), ", ".join(["id long, fp long", *(f"{c} long" for c in keep)])).withColumnRenamed("id", id_col)


def trie_forest(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, top: int, budget: int) -> np.ndarray:
    """Component labels of sorted distinct 64-bit ``keys`` under links of at most ``budget`` differing bits.

    ``lo, hi``: the sub-tries to join with themselves, each a range of keys
    that share their ``top`` leading bits.  A node is a range of keys with a
    common prefix; pairs of nodes descend bit by bit, and a pair whose keys
    are all in one component already is not followed.
    """
    found = LocalComponents(len(keys))
    many = hi - lo > 1
    stack = [(63 - top, lo[many], hi[many], lo[many], hi[many], np.zeros(many.sum(), np.int8))]
    one = np.uint64(1)
    while stack:
        bit, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > 100_000:
            half = len(a0) // 2
            stack += [(bit, *(x[half:] for x in (a0, a1, b0, b1, err))), (bit, *(x[:half] for x in (a0, a1, b0, b1, err)))]
            continue
        small = ((a1 - a0) * (b1 - b0) <= 64) | (bit < 0)
        if small.any():
            s0, s1, t0, t1 = a0[small], a1[small], b0[small], b1[small]
            n = (s1 - s0) * (t1 - t0)
            own = np.repeat(np.arange(len(n)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = (t1 - t0)[own]
            i, j = s0[own] + at // wide, t0[own] + at % wide
            near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            near &= i < j
            found.join(i[near], j[near])
            a0, a1, b0, b1, err = (x[~small] for x in (a0, a1, b0, b1, err))
        if not len(a0):
            continue
        label = found.label
        change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        done = (change[a0] == change[a1 - 1]) & (change[b0] == change[b1 - 1]) & (label[a0] == label[b0])
        if done.any():
            a0, a1, b0, b1, err = (x[~done] for x in (a0, a1, b0, b1, err))
        mask = (one << np.uint64(bit)) - one

        def middle(x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
            edge = (keys[x0] & ~(mask | (one << np.uint64(bit)))) | (one << np.uint64(bit))
            return np.clip(np.searchsorted(keys, edge), x0, x1)

        am, bm = middle(a0, a1), middle(b0, b1)
        same = a0 == b0
        nexts = [(a0, am, b0, bm, err, None), (am, a1, bm, b1, err, None),
                 (a0, am, bm, b1, err + 1, None), (am, a1, b0, bm, err + 1, ~same)]
        parts = []
        for x0, x1, y0, y1, e, keep in nexts:
            ok = (x1 > x0) & (y1 > y0) & (e <= budget)
            if keep is not None:
                ok &= keep
            parts.append([v[ok] for v in (x0, x1, y0, y1, e)])
        stack.append((bit - 1, *(np.concatenate(p) for p in zip(*parts))))
    return found.label


def _rotate(col: F.Column, by: int, width: int = 64) -> F.Column:
    """The low ``width`` bits of a long, rotated left by ``by``; bits above stay."""
    if not by:
        return col
    if width == 64:
        return F.shiftleft(col, by).bitwiseOR(F.shiftrightunsigned(col, 64 - by))
    ones = (1 << width) - 1
    low = col.bitwiseAND(F.lit(ones))
    turned = F.shiftleft(low, by).bitwiseOR(F.shiftrightunsigned(low, width - by)).bitwiseAND(F.lit(ones))
    return col.bitwiseAND(F.lit(~ones)).bitwiseOR(turned)


def trie_links(classes: DataFrame, max_bits: int = 3, split_above: int = 20_000) -> DataFrame:
    """``(u, v)``: links that span the components within each sub-trie of distinct fingerprints ``fp``."""
    blocks = max_bits + 1
    width = 64 // blocks
    spun = classes.select("fp", F.explode(F.array(*(
        F.struct(F.lit(r).alias("r"), _rotate(F.col("fp"), r * width).alias("key")) for r in range(blocks)))).alias("x")).select(
            "fp", "x.key", F.shiftleft("x.r", width).cast("long").bitwiseOR(F.shiftrightunsigned("x.key", 64 - width)).alias("g"))
    # at most blocks * 2^width sub-tries, whatever the number of documents: 262,144 for 3 bits
    hot = spun.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > split_above).select("g", F.lit(True).alias("hot"))
    spun = spun.join(F.broadcast(hot) if blocks << width <= 1 << 20 else hot, "g", "left")
    rest = 64 - width
    deep = rest // blocks
    plain = spun.filter("hot is null").select("fp", "key", "g", F.lit(width).alias("top"))
    # the same cut once more below the block on top
    split = spun.filter("hot").select("fp", "g", F.explode(F.array(*(
        F.struct(F.lit(s).alias("s"), _rotate(F.col("key"), s * deep, rest).alias("key")) for s in range(blocks)))).alias("x")).select(
            "fp", "x.key", F.xxhash64("g", "x.s", F.shiftrightunsigned("x.key", rest - deep)).alias("g"), F.lit(width + deep).alias("top"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "g"):
            g, key, fp, top = (t.column(c).to_numpy() for c in ("g", "key", "fp", "top"))
            s, e = runs(g)
            for bits in np.unique(top):
                of = np.flatnonzero((top[s] == bits) & (e - s > 1))
                if not len(of):
                    continue
                # ranks put the groups one after the other in one sorted array; keys keep their bits
                for part in np.array_split(of, max(1, int((e[of] - s[of]).sum()) // 200_000)):
                    for u, v in _group_links(key, fp, s[part], e[part], int(bits), max_bits):
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return plain.union(split).repartition("g").sortWithinPartitions("g").mapInArrow(frugal(join), "u long, v long")


def _group_links(key, fp, s, e, top, budget) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of the groups ``s[i]:e[i]``, which are disjoint ranges of rows."""
    n = e - s
    rows = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(n.sum())
    k = key[rows].view(np.uint64)
    # groups of different blocks may share their leading bits; one trie holds groups of distinct prefixes only
    own = np.repeat(np.arange(len(n)), n)
    lead = k[np.cumsum(n) - n] >> np.uint64(64 - top)
    turn = np.zeros(len(n), np.int64)
    order = np.argsort(lead, kind="stable")
    lo, hi = runs(lead[order])
    turn[order] = np.arange(len(n)) - np.repeat(lo, hi - lo)
    for t in range(int(turn.max()) + 1):
        here = np.flatnonzero(turn[own] == t)
        here = here[np.argsort(k[here], kind="stable")]
        keys = k[here]
        a, b = runs(keys >> np.uint64(64 - top))
        label = trie_forest(keys, a, b, top, budget)
        tied = np.flatnonzero(label != np.arange(len(label)))
        f = fp[rows[here]]
        yield f[tied], f[label[tied]]


def _rooted(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id_col, fp, *keep, root, component_id)`` per document; ``root`` names its component also where no row has an id."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.write(fingerprints(docs, id_col, text_col, shingle, keep), "fps")
    classes = scratch.write(fps.groupBy("fp").agg(F.min(id_col).alias("rep")), "classes")
    comp = connected_components(trie_links(classes.select("fp"), max_bits), scratch)
    rooted = classes.join(comp, classes.fp == comp.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = scratch.write(rooted.join(least, "root").select(F.col("fp").alias("cfp"), "root", "component_id"), "named")
    return fps.join(named, fps.fp == named.cfp).drop("cfp")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``(id_col, fp, component_id)`` per document: fingerprint and the smallest id reachable by links."""
    return _rooted(docs, id_col, text_col, shingle, max_bits).select(id_col, "fp", "component_id")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row of ``docs`` per group: that with the smallest id, nulls last, and then with the smallest hashes.

    Rows are told apart by their id and two hashes of all columns.
    """
    h1, h2, key, g1, g2 = (unused(n, docs.columns) for n in ("__h1", "__h2", "__id", "__g1", "__g2"))
    keyed = docs.withColumns(dict(zip((h1, h2), row_hashes(docs))))
    groups = _rooted(keyed, id_col, text_col, shingle, max_bits, (h1, h2))
    best = groups.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(h1).alias("h1"), F.col(h2).alias("h2"))).alias("x"))
    stay = Scratch(docs.sparkSession, "simhash").write(best.select(F.col("x.id").alias(key), F.col("x.h1").alias(g1), F.col("x.h2").alias(g2)), "stay")
    keys = broadcast_rows_if_bounded(stay, stay.count(), ID_ROW_BYTES + 32)  # else the texts are shuffled by id and hashes

    def staying(rows: DataFrame) -> DataFrame:
        same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(key)) & (F.col(h1) == F.col(g1)) & (F.col(h2) == F.col(g2))
        return rows.join(keys, same, "left_semi")

    kept = staying(keyed)
    by = [id_col, h1, h2]
    if not staying(groups).groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():  # rows equal in all columns
        kept = kept.dropDuplicates(by)
    return kept.drop(h1, h2)
