"""Connected components of a links table by alternating large-star and small-star rounds.

Every round is two shuffled aggregations and two joins; its links are written
to the shared scratch folder, so lineage stays short and nothing but two
numbers (link count, checksum) reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _nearest(links: DataFrame) -> DataFrame:
    """Per node ``u`` its smallest neighbour.

    The key gets a fresh expression: the join then shuffles both its sides by
    itself, and adaptive execution may split the rows of a hub.
    """
    return links.groupBy("u").agg(F.min("v").alias("m")).select(F.expr("u ^ 0").alias("mu"), "m")


def _star(links: DataFrame) -> DataFrame:
    m = _nearest(links)
    return links.join(m, links.u == m.mu).select("u", "v", F.least("u", "m").alias("m"))


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    s = _star(down)
    return s.select("u", F.col("m").alias("v")).union(
        s.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, root)`` for every node of ``links(u, v)``; ``root`` is its component's smallest node.

    ``links`` holds long columns; loops and repeated links do no harm; nodes
    without a link are not listed.  An empty table gives an empty table.
    """
    links = links.filter("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long")).distinct()
    links, before, k = scratch.write(links, "links-0"), None, 0
    while True:
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before or not now[0]:
            break
        before, k = tuple(now), k + 1
        links = scratch.write(_small(_large(links).distinct()).distinct(), f"links-{k}")
        scratch.drop(f"links-{k - 1}")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


class LocalComponents:
    """Union-find over 0..n-1 for links that come as numpy arrays."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up
