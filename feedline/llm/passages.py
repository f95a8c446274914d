"""Substring dedup of fuzzy passages by collinear chaining.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; ``k`` words in a row are a
k-mer.  The operator finds the passages of at least ``min_words`` words of a
document that an earlier one (a smaller id) holds with a similarity of at least
``similarity``:

1. Seeds.  Of every ``window`` k-mers in a row the one with the smallest hash is
   a seed (all of them if equal); by default each k-mer is one.  Of every
   ``apart`` strings of ``min_words`` words in a row one is named too.
2. Links.  A seed or string links each document that holds it with the first one
   that does and with the last one before it: a passage in a thousand documents
   gives two thousand links, not their square.  Exact repeats are so found whoever
   holds their phrases first; seeds where two phrases meet, or that few documents
   hold, lead to the sources of fuzzy ones.  Names travel in packed arrays.
   What this leaves out, step 5 meets.
3. Chains.  Per pair of documents the links are chained in the order of both:
   the best score at a link is the weight of a seed plus the best earlier score
   less the cost of the gap; with the gap costs moved into the scores it is a
   prefix maximum over the other document's positions, kept in a Fenwick tree.
   A chain needs as many k-mers as ``min_words`` words of that similarity share at
   least, seven, or rare ones in two places.
4. Alignment.  A chain is aligned word by word from its first link to both sides
   through the whole texts, resuming after differences near by or at the chain's
   next link, and its best-scoring stretch is the passage; equal words between
   differences count where they stand in order (their longest common subsequence),
   and a gap before a further link is bridged whenever the stretch as a whole keeps
   the similarity.  A stretch that ends at differing words may be shorter than
   ``min_words``, by a tenth at most, if it has the similarity together with words
   around it.  Where the
   best stretch is none, the longest one of the alignment that is one counts.
5. Frequent seeds.  A place of a seed of more than ``few`` holders is open if
   one of its words is among ``k`` or more in a row that no passage found holds, and
   it stands among as many linked seeds as a passage needs.  Open places meet all other earlier
   places of their seed, equal surroundings once, block by block; pairs that have
   enough words, and enough pairs of words in a row, in common there are chained by all their common seeds and aligned
   as above.  That is quadratic in the different surroundings of a seed, in time;
   a task holds two blocks.

Steps 4 and 5 go over the corpus in as many rounds as keep what they have on disk
within a multiple of the texts: of pairs, whose shorter text is moved to the longer
one, of seeds and of pairs of blocks.

Nulls: a null text is an empty text; a null id counts as the largest id and is
kept as null.  Rows that share an id are not compared with each other.  Texts
of fewer than ``min_words`` words hold no passage.  An empty table gives an
empty table; columns other than id and text are not read here and kept by
``without_passages``.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sizing import broadcast_rows_if_bounded
from .batches import (ID_ROW_BYTES, M1, ODD, from_planes, frugal, mix64, planes, prefix_sums, running_sums, runs, slices, span_hashes,
                      text_bytes, whole_groups, words)
from .scratch import Scratch, release

LAST = (1 << 63) - 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


@dataclass(frozen=True)
class Settings:
    min_words: int = 50
    similarity: float = 0.8
    k: int = 4  #: 50 words with 10 differing ones have four equal words in a row
    window: int = 1
    weight: float = 5.0  #: of a seed in a chain
    gap: float = 0.05  #: cost of a word skipped in either document
    min_score: float = 6.0  #: two seeds, at most 80 skipped words apart
    apart: int = 1  #: of so many strings of ``min_words`` words in a row one is named
    few: int = 4  #: holders up to which a seed is rare
    reach: int = 12  #: words skipped to resume after a difference
    resume: int = 3  #: equal words that resume an alignment
    miss: float = 2.0  #: cost of a differing word, in matching words
    core: float = 0.9  #: of ``min_words``: the least from the first to the last equal word of a passage
    drop: float = 20.0  #: an alignment ends this far below its best score
    stride: int = 8  #: of links that follow each other word by word, one in so many is chained


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of lower-cased words, their byte starts and ends, and the n + 1 offsets of texts into them."""
    s, e, w = words(buf, offs)
    return span_hashes(prefix_sums(LOWER[buf]), s, e), s, e, w


def seeds(h: np.ndarray, w: np.ndarray, conf: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, word position and 64-bit name of each seed of texts given as word hashes."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = len(h) - conf.k + 1
    size = np.diff(w)
    if m < conf.window or not (size >= conf.min_words).any():
        return none
    own = np.repeat(np.arange(len(size)), size)
    g = np.zeros(m, np.uint64)
    mult = ODD
    for i in range(conf.k):
        g = mix64(g + h[i:m + i] * mult)
    # smallest k-mer of each window that lies in one text, then the largest such minimum around each k-mer
    n = m - conf.window + 1
    least = g[:n].copy()
    for i in range(1, conf.window):
        np.minimum(least, g[i:n + i], out=least)
    least[own[:n] != own[conf.window + conf.k - 2:][:n]] = 0
    padded = np.concatenate([np.zeros(conf.window - 1, np.uint64), least, np.zeros(conf.window - 1, np.uint64)])
    top = padded[:m].copy()
    for i in range(1, conf.window):
        np.maximum(top, padded[i:m + i], out=top)
    at = np.flatnonzero((top == g) & (g != 0) & (size[own[:m]] >= conf.min_words))
    if not len(at):
        return none
    text, name = own[at], g[at]
    return text, at - w[text], mix64(name)


def chains(d: list[int], a: list[int], conf: Settings) -> list[tuple[float, list[int]]]:
    """Scores and link numbers of the chains of links ``(d[i], a[i])``, which come in the order of ``d``."""
    n = len(d)
    rank = sorted(set(a))
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(rank) + 1)
    score, back = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        while j < n and d[j] == d[i]:  # links at one position do not follow each other
            place = bisect_left(rank, a[j])
            best, p = (-1e18, -1)
            while place > 0:
                if tree[place] > (best, p):
                    best, p = tree[place]
                place &= place - 1
            best -= conf.gap * (d[j] + a[j])
            score[j], back[j] = (conf.weight + best, p) if best > 0 else (conf.weight, -1)
            j += 1
        for x in range(i, j):
            entry = (score[x] + conf.gap * (d[x] + a[x]), x)
            place = bisect_left(rank, a[x]) + 1
            while place <= len(rank):
                if tree[place] < entry:
                    tree[place] = entry
                place += place & -place
        i = j
    used, out = [False] * n, []
    for x in sorted(range(n), key=lambda x: -score[x]):
        if score[x] < conf.min_score:
            break
        chain, at = [], x
        while at >= 0 and not used[at]:
            used[at] = True
            chain.append(at)
            at = back[at]
        total = score[x] - (score[at] if at >= 0 else 0.0)
        if chain and total >= conf.min_score:
            out.append((total, chain[::-1]))
    return out


def _walk(x: np.ndarray, y: np.ndarray, i: int, j: int, links: list[tuple[int, int]], conf: Settings) -> tuple[tuple[int, int, int], tuple[int, int, int], list[tuple[int, int, int]]]:
    """Aligns ``x[i:]`` with ``y[j:]`` from the left: ends and equal words of the best-scoring stretch,
    of the longest one that reaches a link behind it and still has the similarity, and of all.

    ``links``: further places known to match, in order.  Differences before the
    last of them are bridged as long as the similarity can still be met.
    """
    steps = _steps(conf.reach)
    score = best = 0.0
    equal = missed = 0
    i0, j0 = i, j
    found = wide = (i, j, 0)
    stops = [found]
    at = 0
    while True:
        run = 64
        while True:  # equal words ahead, in growing strides
            n = min(run, len(x) - i, len(y) - j)
            diff = np.flatnonzero(x[i:i + n] != y[j:j + n])
            n = int(diff[0]) if len(diff) else n
            i, j, equal, score = i + n, j + n, equal + n, score + n
            if len(diff) or n < run:
                break
            run *= 4
        stops.append((i, j, equal))
        if score > best:
            best, found = score, (i, j, equal)
        if at and equal >= conf.similarity * max(i - i0, j - j0):
            wide = (i, j, equal)
        while at < len(links) and (links[at][0] < i or links[at][1] < j or links[at] == (i, j)):
            at += 1
        step = _resume(x, y, i, j, steps, conf)
        if step is None:
            if at == len(links):
                return found, max(found, wide), stops
            p, q = links[at][0] - i, links[at][1] - j
        else:
            p, q = step
        inside = common(x[i:i + p], y[j:j + q])
        equal += inside
        score += inside - conf.miss * (max(p, q) - inside)
        missed += max(p, q) - inside
        if score < best - conf.drop:
            ahead = equal + min(len(x) - i - p, len(y) - j - q)
            if at == len(links) or ahead < conf.similarity * (ahead + missed):
                return found, max(found, wide), stops
        i, j = i + p, j + q


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Equal words in order between two differences: along the diagonal if both are as long, or else the longest
    common subsequence (of longer stretches: along the diagonals from both ends)."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0
    if n == m or n * m > 1024:
        k = min(n, m)
        return max(int((a[:k] == b[:k]).sum()), int((a[n - k:] == b[m - k:]).sum()))
    row = np.zeros(m + 1, np.int64)
    for w in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == w)))
    return int(row[-1])


_STEPS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _steps(reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Words skipped in either text to resume an alignment, the nearest first."""
    if reach not in _STEPS:
        all_ = sorted(((p, q) for p in range(reach + 1) for q in range(reach + 1) if p + q), key=lambda s: (max(s), abs(s[0] - s[1])))
        _STEPS[reach] = tuple(np.array(x) for x in zip(*all_))
    return _STEPS[reach]


def _resume(x: np.ndarray, y: np.ndarray, i: int, j: int, steps: tuple[np.ndarray, np.ndarray], conf: Settings) -> tuple[int, int] | None:
    """The nearest step behind which ``resume`` words in a row are equal."""
    r = conf.resume
    a, b = x[i:i + conf.reach + r], y[j:j + conf.reach + r]
    n, m = len(a) - r + 1, len(b) - r + 1
    if n < 1 or m < 1:
        return None
    equal = a[:, None] == b
    run = equal[:n, :m].copy()
    for t in range(1, r):
        run &= equal[t:n + t, t:m + t]
    if not run.any():
        return None
    p, q = steps
    if n <= conf.reach or m <= conf.reach:
        fits = (p < n) & (q < m)
        p, q = p[fits], q[fits]
    hit = run[p, q]
    k = int(hit.argmax()) if len(hit) else 0
    return (int(p[k]), int(q[k])) if len(hit) and hit[k] else None


def may_hold(x: np.ndarray, y: np.ndarray, links: list[tuple[int, int]], conf: Settings) -> bool:
    """Whether the words around a chain can make a passage: those that both texts have there, each as often as
    in the text that has it less, are as many as ``min_words`` words of the similarity share.

    Beyond ``min_words`` words from the links there is no run of ``k`` equal words, so what a passage has
    there is less alike than it must be as a whole.
    """
    (i, j), (e, f) = links[0], links[-1]
    a, n = np.unique(x[max(0, i - conf.min_words):e + conf.k + conf.min_words], return_counts=True)
    b, m = np.unique(y[max(0, j - conf.min_words):f + conf.k + conf.min_words], return_counts=True)
    _, at, to = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return np.minimum(n[at], m[to]).sum() >= conf.similarity * conf.min_words


def _padded(x: np.ndarray, y: np.ndarray, s: int, e: int, t: int, f: int, equal: int, conf: Settings) -> tuple[int, int, int, int, float] | None:
    """A stretch of fewer than ``min_words`` words as the core of one that has them, by single equal words on the diagonals of its ends."""
    room = conf.min_words - max(e - s, f - t)
    a, b = min(room, s, t), min(room, len(x) - e, len(y) - f)
    before = np.concatenate([[0], np.cumsum(x[s - a:s][::-1] == y[t - a:t][::-1])])
    after = np.concatenate([[0], np.cumsum(x[e:e + b] == y[f:f + b])])
    left = np.arange(a + 1)
    right = np.minimum(room - left, b)
    most = before + after[right]
    k = int(most.argmax())
    if equal + most[k] < conf.similarity * conf.min_words:
        return None
    i, j = int(np.searchsorted(before, before[k])), int(np.searchsorted(after, after[right[k]]))  # up to the last equal words
    if min(e + j - s + i, f + j - t + i) < conf.core * conf.min_words:
        return None
    return s - i, e + j, t - i, f + j, float((equal + most[k]) / conf.min_words)


def align(x: np.ndarray, y: np.ndarray, links: list[tuple[int, int]], conf: Settings) -> tuple[int, int, int, int, float] | None:
    """The passage around a chain of links: its range in ``x`` and in ``y`` and its similarity, or None if it is none."""
    return _align(x, y, links, _walk(x, y, *links[0], links[1:], conf), conf)


def _align(x: np.ndarray, y: np.ndarray, links: list[tuple[int, int]], walked: tuple, conf: Settings) -> tuple[int, int, int, int, float] | None:
    i, j = links[0]
    best, wide, right_stops = walked
    (s, t, left), _, left_stops = _walk(x[:i][::-1], y[:j][::-1], 0, 0, [], conf)
    s, t = i - s, j - t
    for e, f, right in (wide, best):
        if max(e - s, f - t) < conf.min_words:
            got = _padded(x, y, s, e, t, f, left + right, conf)
            if got:
                return got
        elif (left + right) / max(e - s, f - t) >= conf.similarity:
            return s, e, t, f, (left + right) / max(e - s, f - t)
    # the longest stretch between two stops that is a passage
    ends = np.array(right_stops)
    found = None
    for p, q, left in left_stops:
        equal = left + ends[:, 2]
        x_size, y_size = ends[:, 0] - i + p, ends[:, 1] - j + q
        longer = np.maximum(np.maximum(x_size, y_size), conf.min_words)
        ok = (equal >= conf.similarity * longer) & (np.minimum(x_size, y_size) >= conf.core * conf.min_words)
        if ok.any():
            r = int(np.flatnonzero(ok)[longer[ok].argmax()])
            if found is None or longer[r] > max(found[1] - found[0], found[3] - found[2]):
                found = i - p, right_stops[r][0], j - q, right_stops[r][1], float(equal[r] / longer[r])
    return found


NAME_BYTES = 4  #: with a part's number, names that differ are alike once in some 2,000; aligned words decide
STRING = np.uint64(1 << 31)  #: set in the names of strings, which are links of their own kind
NAME = np.uint64((1 << 31) - 1)
LONG = 1 << 30  #: set in the positions of links by a string
RARE = 1 << 29  #: set in the positions of links by a name that few rows hold


def strings(h: np.ndarray, w: np.ndarray, conf: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, word position and 64-bit name of strings of ``min_words`` words of texts given as word hashes.

    Of every ``apart`` strings in a row the one with the smallest name is taken, of fewer all.
    """
    size = np.diff(w)
    n = np.maximum(size - conf.min_words + 1, 0)
    text = np.repeat(np.arange(len(size)), n)
    pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = w[text] + pos
    name = span_hashes(running_sums(h), at, at + conf.min_words)
    take = (n < conf.apart)[text]
    windows = len(name) - conf.apart + 1
    if windows > 0:
        least = name[:windows].copy()
        for i in range(1, conf.apart):
            np.minimum(least, name[i:windows + i], out=least)
        whole = text[:windows] == text[conf.apart - 1:]
        for i in range(conf.apart):
            take[i:windows + i] |= whole & (name[i:windows + i] == least)
    return text[take], pos[take], name[take]


def stable_order(key: np.ndarray) -> np.ndarray:
    """Stable order of unsigned keys; those that leave room for their places are sorted with them, as values."""
    bits = max(1, int(len(key) - 1).bit_length())
    if not len(key) or int(key.max()) >> (64 - bits):
        return np.argsort(key, kind="stable")
    both = key << np.uint64(bits) | np.arange(len(key), dtype=np.uint64)
    both.sort()
    return (both & np.uint64((1 << bits) - 1)).astype(np.int64)


def names_by_part(h: np.ndarray, w: np.ndarray, did: np.ndarray, key: np.ndarray, parts: int, conf: Settings) -> Iterator[tuple[int, bytes, bytes, int, bytes]]:
    """Seeds and strings of texts by parts of their names: part, names, positions, and how many rows they are of and which, with their numbers."""
    (t0, p0, n0), (t1, p1, n1) = seeds(h, w, conf), strings(h, w, conf)
    text, pos, name = np.concatenate([t0, t1]), np.concatenate([p0, p1]).astype(np.int32), np.concatenate([n0, n1])
    if not len(text):
        return
    part = ((name >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)
    name &= NAME
    name[len(n0):] |= STRING
    order = stable_order(part.astype(np.uint64) * np.uint64(len(w)) + text.astype(np.uint64))
    text, pos, name, part = text[order], pos[order], name[order], part[order]
    for s, e in zip(*runs(part)):
        a, b = runs(text[s:e])
        of = text[s:e][a]
        rows = planes(np.diff(did[of], prepend=np.int64(0)), 8) + planes(key[of], 4) + planes((b - a).astype(np.int32), 4)
        steps = pa.compress(planes(np.diff(pos[s:e], prepend=np.int32(0)), 4), "zstd", asbytes=True)
        yield int(part[s]), planes(name[s:e], NAME_BYTES), steps, len(of), pa.compress(rows, "zstd", asbytes=True)


def positions(data: pa.Buffer, n: int) -> np.ndarray:
    """The ``n`` positions of a part of ``names_by_part``."""
    return np.cumsum(from_planes(pa.decompress(data, 4 * n, "zstd"), 4, np.int32), dtype=np.int32)


def holders(data: pa.Buffer, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, keys and numbers of names of the ``n`` rows of a part of ``names_by_part``."""
    raw = memoryview(pa.decompress(data, 16 * n, "zstd"))
    return np.cumsum(from_planes(raw[:8 * n], 8, np.int64)), from_planes(raw[8 * n:12 * n], 4, np.int32), from_planes(raw[12 * n:], 4, np.int32)


def holder_links(did: np.ndarray, key: np.ndarray, count: np.ndarray, name: np.ndarray, pos: np.ndarray, few: int = 4) -> tuple[np.ndarray, ...]:
    """Links of all holders of some names with the first holder of each and the one before them.

    Holders of a name that at most ``few`` rows hold are linked with every one before them.

    Row ``(did[i], key[i])`` holds the next ``count[i]`` names.  The n-th place
    of a name is linked with the n-th one of the earlier row, or its last if it
    has fewer.  Returns ``did, key, src, src_key, pos, src_pos``.
    """
    start = np.cumsum(count) - count
    order = np.lexsort((key, did))
    d, k = did[order], key[order]
    order = order[np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])])]  # equal rows are one
    did, key, n = did[order], key[order], count[order]
    at = np.repeat(start[order] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    at = at[stable_order(name[at])]
    name, pos = name[at], pos[at]
    rank = np.empty(len(start), np.int64)
    rank[order] = np.arange(len(order))
    rank = np.repeat(rank, count)[at]
    s, e = runs(name)
    many = np.repeat(rank[s] != rank[e - 1], e - s)
    name, pos, rank = name[many], pos[many], rank[many]
    if not len(name):
        return tuple(np.zeros(0, x) for x in (np.int64, np.int32, np.int64, np.int32, np.int32, np.int32))
    # a block: the places of one name in one row
    block = np.concatenate([[True], (name[1:] != name[:-1]) | (rank[1:] != rank[:-1])])
    b0 = np.flatnonzero(block)
    size = np.diff(np.append(b0, len(name)))
    of = np.cumsum(block) - 1
    bname, bdid = name[b0], did[rank[b0]]
    new = np.concatenate([[True], bname[1:] != bname[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(len(b0)), 0))
    new[1:] |= bdid[1:] != bdid[:-1]
    before = np.maximum.accumulate(np.where(new, np.arange(len(b0)), 0)) - 1
    linked = np.flatnonzero((before >= first)[of])
    nth = linked - b0[of[linked]]
    held = np.diff(np.append(np.flatnonzero(np.append(True, bname[1:] != bname[:-1])), len(bname)))
    rare = np.repeat(held, held) <= few
    out = []
    steps = [(first, None), (before, before != first)]
    for _ in range(few - 2):  # further holders before those, of rare names only
        last = steps[-1][0]
        same = (last > first) & rare
        back = np.where(same, np.maximum(before[np.maximum(last, 0)], first), first)
        steps.append((back, same & (back != first)))
    for source, more in steps:
        i, m = (linked, nth) if more is None else (linked[more[of[linked]]], nth[more[of[linked]]])
        to = source[of[i]]
        r, q = rank[i], rank[b0[to]]
        flag = (np.where(name[i] & STRING, LONG, 0) | np.where(rare[of[i]], RARE, 0)).astype(np.int32)
        out.append((did[r], key[r], did[q], key[q], pos[i] | flag, pos[b0[to] + np.minimum(m, size[to] - 1)]))
    return tuple(np.concatenate(x) for x in zip(*out))


def row_chains(did: np.ndarray, key: np.ndarray, src: np.ndarray, skey: np.ndarray, pos: np.ndarray, spos: np.ndarray, conf: Settings) -> Iterator[tuple]:
    """Chains of links: ``(did, key, src, src_key, positions, source positions)``.

    Links that follow each other word by word are thinned out.  A chain without a
    seed wholly outside the strings that an earlier source holds is left out: what
    it adds to their passages is less than ``k + apart`` words at an edge.
    """
    if not len(did):
        return
    long, rare = (pos & LONG) != 0, (pos & RARE) != 0
    pos = pos & (RARE - 1)
    order = np.lexsort((pos, pos - spos, long, skey, src, key, did))
    did, key, src, skey, long, rare, pos, spos = (x[order] for x in (did, key, src, skey, long, rare, pos, spos))
    differ = lambda x: np.concatenate([[True], x[1:] != x[:-1]])
    row = differ(did) | differ(key)
    pair = row | differ(src) | differ(skey)
    # strings that overlap on a diagonal are one stretch
    run = pair | differ(long) | differ(pos - spos) | np.concatenate([[True], pos[1:] > pos[:-1] + np.where(long[1:], conf.min_words - conf.k, 1)])
    r0 = np.flatnonzero(run)
    r1 = np.append(r0[1:], len(run)) - 1
    of = (np.cumsum(pair) - 1)[r0]
    last = pos[r1] + np.where(long[r0], conf.min_words - conf.k, 0)
    n = -(-(last - pos[r0]) // conf.stride) + 1
    own = np.repeat(np.arange(len(r0)), n)
    at = np.minimum(pos[r0][own] + conf.stride * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)), last[own])
    to = at - (pos - spos)[r0][own]
    # links that each kept one stands for, up to the next of its run
    stands = np.append(np.where(own[1:] == own[:-1], at[1:] - at[:-1], 1), 1)
    # those among which is one by a rare seed
    rares = np.concatenate([[0], np.cumsum(rare & ~long)])
    i0 = np.minimum(r0[own] + at - pos[r0][own], r1[own])
    lone = rares[np.minimum(i0 + stands, r1[own] + 1)] > rares[i0]
    order = np.lexsort((-stands, to, at, of[own]))
    p, at, to, stands, lone = of[own][order], at[order], to[order], stands[order], lone[order]
    again = np.concatenate([[False], (p[1:] == p[:-1]) & (at[1:] == at[:-1]) & (to[1:] == to[:-1])])
    p, at, to, stands, lone = p[~again], at[~again], to[~again], stands[~again], lone[~again]
    s, e = runs(p)
    p0 = np.flatnonzero(pair)
    prow = (np.cumsum(row) - 1)[p0]
    held: dict[int, list[tuple[int, int]]] = {}  # ranges of the strings of each pair that has some
    for r in np.flatnonzero(long[r0]).tolist():
        held.setdefault(int(of[r]), []).append((int(pos[r0[r]]), int(pos[r1[r]]) + conf.min_words))
    least = shared_seeds(conf)
    now, starts, ends = -1, [], []

    def inside(x: int) -> bool:  # or over an edge, which strings tell to within ``apart`` words
        i = bisect_right(starts, x + conf.k + conf.apart - 2) - 1
        return i >= 0 and x < ends[i] + conf.apart - 1

    def apart(i: np.ndarray) -> bool:  # rare seeds in two places
        i = i[lone[i]]
        return len(i) > 1 and at[i].max() - at[i].min() >= 2 * conf.k

    spread = np.maximum.reduceat(np.where(lone, at, -1), s) - np.minimum.reduceat(np.where(lone, at, 1 << 40), s)
    for q in np.flatnonzero((np.add.reduceat(stands, s) >= least) | (spread >= 2 * conf.k)).tolist():
        if prow[q] != now:
            now, starts, ends = prow[q], [], []
        d, a = at[s[q]:e[q]].tolist(), to[s[q]:e[q]].tolist()
        if not starts or not all(map(inside, d)):
            i = p0[q]
            for _, c in chains(d, a, conf):
                links = s[q] + np.array(c)
                if (int(stands[links].sum()) >= least or apart(links)) and not (starts and all(inside(d[x]) for x in c)):
                    yield did[i], key[i], src[i], skey[i], [d[x] for x in c], [a[x] for x in c]
        if q in held:
            both = sorted([*zip(starts, ends), *held[q]])
            starts, ends = [], []
            for x, y in both:
                if ends and x <= ends[-1]:
                    ends[-1] = max(ends[-1], y)
                else:
                    starts.append(x)
                    ends.append(y)


NAMES_A_PART = 1 << 19
#: Bytes of texts whose names are dealt out together.
SLICE = 1 << 21
#: Places of a frequent seed that are held together.
BLOCK = 1 << 12
BAG_BITS = 1024
#: Of a place on disk, written and dealt out by its seed and surroundings (84 are measured), or with its bags.
PLACE_BYTES = 90
PACKED_BYTES = 160
#: Times the bytes of all texts that a round of steps 4 and 5 has on disk, beside the texts themselves.
ROUND = 1.5
#: Bytes of a corpus that is small enough to be moved about whole; a smaller one counts as that.
SMALL = 1 << 26

LINK = {"did": np.int64, "key": np.int32, "src": np.int64, "skey": np.int32, "pos": np.int32, "src_pos": np.int32}


def open_places(did: np.ndarray, key: np.ndarray, pos: np.ndarray, conf: Settings) -> Iterator[tuple[int, int, list[int], list[bool]]]:
    """Places of frequent seeds by row, and which stand among as many linked seeds as ``min_words`` words of a passage share."""
    short = (pos & LONG) == 0
    did, key, rare, pos = did[short], key[short], (pos[short] & RARE) != 0, pos[short] & (RARE - 1)
    order = np.lexsort((pos, key, did))
    did, key, rare, pos = did[order], key[order], rare[order], pos[order]
    new = np.concatenate([np.ones(min(1, len(did)), bool), (did[1:] != did[:-1]) | (key[1:] != key[:-1])])
    once = new | np.concatenate([np.zeros(min(1, len(did)), bool), pos[1:] != pos[:-1]])
    did, key, rare, pos, row = did[once], key[once], rare[once], pos[once], (np.cumsum(new) - 1)[once]
    least = shared_seeds(conf)
    dense = np.zeros(len(pos), bool)
    n = len(pos) - least + 1
    if n > 0:
        near = (row[:n] == row[least - 1:]) & (pos[least - 1:] - pos[:n] <= conf.min_words - conf.k)
        for i in range(least):
            dense[i:n + i] |= near
    did, key, pos, dense, row = did[~rare], key[~rare], pos[~rare], dense[~rare], row[~rare]
    for s, e in zip(*runs(row)):
        yield int(did[s]), int(key[s]), pos[s:e].tolist(), dense[s:e].tolist()


def shared_kmers(k: int, conf: Settings) -> int:
    """``k`` words in a row that ``min_words`` words of the similarity share at least, each differing word taking ``k``."""
    return conf.min_words + 1 - k - k * int((1 - conf.similarity) * conf.min_words + 1e-9)


def shared_seeds(conf: Settings) -> int:
    return max(1, shared_kmers(conf.k, conf)) if conf.window == 1 else 1  # sampled seeds guarantee less


def kmers(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` words from each word on."""
    n = max(0, len(h) - k + 1)
    return span_hashes(running_sums(h), np.arange(n), np.arange(n) + k)


def uncovered(bare: np.ndarray, k: int) -> np.ndarray:
    """The words of ``bare`` that are ``k`` or more in a row; fewer are the edge of a passage."""
    s, e = runs(bare)
    return np.repeat(bare[s] & (e - s >= k), e - s)


def contexts(h: np.ndarray, at: np.ndarray, conf: Settings) -> np.ndarray:
    """Hashes of the words around places of seeds in one text."""
    lo, hi = np.maximum(at - conf.min_words, 0), np.minimum(at + conf.k + conf.min_words, len(h))
    # the beginning counts: equal words around have the seed at the same place
    return mix64(span_hashes(running_sums(h), lo, hi) + (at - lo).astype(np.uint64) * ODD)


def around(h: np.ndarray, at: np.ndarray, conf: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The bags of the words around places of seeds in one text, as bits, and how many words share a bit with others."""
    lo, hi = np.maximum(at - conf.min_words, 0), np.minimum(at + conf.k + conf.min_words, len(h))
    bags, more = np.zeros((len(at), BAG_BITS // 8), np.uint8), np.zeros(len(at), np.int32)
    wide = np.arange(2 * conf.min_words + conf.k)
    for i in range(0, len(at), 1 << 10):
        end = hi[i:i + (1 << 10), None]
        w = lo[i:i + (1 << 10), None] + wide
        w = np.sort(np.where(w < end, h[np.minimum(w, len(h) - 1)], np.uint64(0)), axis=1)
        start = np.concatenate([np.ones((len(w), 1), bool), w[:, 1:] != w[:, :-1]], axis=1)
        nth = wide - np.maximum.accumulate(np.where(start, wide, 0), axis=1)  # a word held twice is two
        bit = (mix64(w + nth.astype(np.uint64) * ODD) % np.uint64(BAG_BITS)).astype(np.int64)
        held = np.zeros((len(w), BAG_BITS), bool)
        row, col = np.nonzero(w)
        held[row, bit[row, col]] = True
        bags[i:i + len(w)] = np.packbits(held, axis=1)
        more[i:i + len(w)] = (w != 0).sum(axis=1) - held.sum(axis=1)
    return bags, more


def enough(a: np.ndarray, more: np.ndarray, b: np.ndarray, room: np.ndarray, k: int, conf: Settings) -> np.ndarray:
    """Which bags of ``k`` words in a row have as many in common as a passage needs."""
    same = np.bitwise_count(a & b).sum(axis=1, dtype=np.int32)
    return same + np.minimum(room, more) >= shared_kmers(k, conf) - 1


def meetings(did: np.ndarray, prev: np.ndarray, follows: np.ndarray, bags: np.ndarray, more: np.ndarray, left: np.ndarray, right: np.ndarray, conf: Settings,
             k: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of a seed, one of ``left`` and an earlier one of ``right``, that do not follow a common
    seed, which led to the same, and have as many ``k`` words in a row around in common as a passage needs."""
    right = right[np.argsort(did[right], kind="stable")]
    ids, before, bits, room = did[right], prev[right], bags[right], more[right]
    got: list[tuple[np.ndarray, np.ndarray]] = []
    n_got = 0
    for i in left.tolist():
        n = int(np.searchsorted(ids, did[i]))
        j = np.flatnonzero(before[:n] != prev[i]) if follows[i] else np.arange(n)
        if len(j):
            j = j[enough(bits[j], room[j], bags[i], more[i], k, conf)]
            got.append((np.full(len(j), i), right[j]))
            n_got += len(j)
            if n_got >= 1 << 16:
                yield tuple(np.concatenate(c) for c in zip(*got))
                got, n_got = [], 0
    if n_got:
        yield tuple(np.concatenate(c) for c in zip(*got))


def common_links(x: np.ndarray, y: np.ndarray, conf: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k-mers that two texts share; the n-th of one goes with the n-th of the other, or its last."""
    a, b = kmers(x, conf.k), kmers(y, conf.k)
    oa, ob = np.arange(len(a)), np.argsort(b, kind="stable")
    if len(b):  # only those that both have are put in order
        oa = oa[b[ob[np.minimum(np.searchsorted(b, a, sorter=ob), len(b) - 1)]] == a]
    oa = oa[np.argsort(a[oa], kind="stable")]
    sa, sb = a[oa], b[ob]
    start, end = np.searchsorted(sb, sa, "left"), np.searchsorted(sb, sa, "right")
    nth = np.arange(len(sa)) - np.searchsorted(sa, sa, "left")
    has = start < end
    pos, to = oa[has], ob[np.minimum(start + nth, end - 1)[has]]
    order = np.argsort(pos, kind="stable")
    return pos[order].astype(np.int32), to[order].astype(np.int32)


def unpacked_links(data: pa.Buffer, n: int) -> list[np.ndarray]:
    """The columns of ``LINK`` that were packed together."""
    raw, out, at = memoryview(pa.decompress(data, n * 32, "zstd")), [], 0
    for kind in LINK.values():
        size = n * np.dtype(kind).itemsize
        out.append(from_planes(raw[at:at + size], size // n, kind))
        at += size
    return out


PAIR = "did long, key int, src long, skey int"
FOUND = "did long, key int, src long, start_word long, end_word long, src_start_word long, src_end_word long, start_char long, end_char long, src_start_char long, src_end_char long, similarity double"


def cell_of(name: F.Column, a: F.Column, b: F.Column) -> F.Column:
    """The number of a pair of blocks of a seed."""
    return F.xxhash64(name, F.least(a, b), F.greatest(a, b))


class _Words:
    """Words of whole texts; those of the last ones are kept, as pairs hold a text many times."""

    def __init__(self, budget: int = 1 << 24):
        self.got: dict[str, tuple[np.ndarray, ...]] = {}
        self.budget, self.size = budget, 0

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = self.got.get(text)
        if got is None:
            buf, offs = text_bytes(pa.array([text]))
            h, s, e, _ = word_hashes(buf, offs)
            if not text.isascii():
                chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                s, e = chars[s], chars[e]
            got = h, s, e
            size = len(buf) + 24 * len(h)
            if self.size + size > self.budget:
                self.got, self.size = {}, 0
            self.got[text] = got
            self.size += size
        return got


def rounds(moved: int, size: int) -> int:
    """Rounds in which ``moved`` bytes go over a corpus of ``size`` bytes, so that the disk they take grows with the corpus alone."""
    return max(1, math.ceil(moved / (ROUND * max(size, SMALL))))


def _row(docs: DataFrame, id_col: str, text_col: str) -> tuple[list[F.Column], bool]:
    """A row: its id, nulls last, and, where rows share an id, a hash of its text (0 in a table of different ids).  And whether some share one."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    did = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST))
    shared = not docs.groupBy(did).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    return [did.alias("did"), (F.hash(text) if shared else F.lit(0)).alias("key"), text.alias("text")], shared


def _aligned(x: np.ndarray, y: np.ndarray, own: list[int], other: list[int], conf: Settings) -> Iterator[tuple[int, int, int, int, float]]:
    """The passages along a chain."""
    pairs = [(i, j) for i, j in zip(own, other) if i < len(x) and j < len(y)]
    # after a stretch the rest of the chain may hold another passage
    while pairs and may_hold(x, y, pairs, conf):
        walked = _walk(x, y, *pairs[0], pairs[1:], conf)
        got = _align(x, y, pairs, walked, conf)
        end = pairs[0][0] + 1
        if got:
            yield got
            end = got[1]
        else:
            end = max(end, walked[0][0])
        pairs = [p for p in pairs if p[0] >= end]


def _found(docs: DataFrame, conf: Settings, row: list[F.Column], shared: bool) -> DataFrame:
    """The columns of ``FOUND``: one row per passage; ``row``, ``shared``: what ``_row`` tells."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "passages")
    rows = docs.select(*row)
    texts = rows.dropDuplicates(["did", "key"]) if shared else rows
    sizes = texts.select("did", "key", F.octet_length("text").alias("size"))
    # two names a word, and a word of six bytes and a space
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-2 * size // (7 * NAMES_A_PART)))

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = text_bytes(b.column("text"))
            did, key = b.column("did").to_numpy(), b.column("key").to_numpy()
            for lo, hi in slices(offs, SLICE):
                h, _, _, w = word_hashes(buf[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                got = list(names_by_part(h, w, did[lo:hi], key[lo:hi], parts, conf))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()))], ["part", "names", "pos", "n", "rows"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "part"):
            for lo, hi in zip(*runs(table.column("part").to_numpy())):
                t = table.slice(lo, hi - lo)  # one part, as each holds a row once
                name = np.concatenate([from_planes(x.as_buffer(), NAME_BYTES, np.uint64) for x in t.column("names")])
                pos = np.concatenate([positions(x.as_buffer(), len(y.as_buffer()) // NAME_BYTES) for x, y in zip(t.column("pos"), t.column("names"))])
                did, key, count = zip(*(holders(x.as_buffer(), n) for x, n in zip(t.column("rows"), t.column("n").to_pylist())))
                links = holder_links(*map(np.concatenate, (did, key, count)), name, pos, conf.few)
                if not len(links[0]):
                    continue
                part = (mix64(links[0].view(np.uint64) + ODD) % np.uint64(parts)).astype(np.int32)
                order = np.lexsort((links[4], links[2], links[0], part))
                part, links = part[order], [x[order] for x in links]
                got = [(int(part[s]), int(e - s), pa.compress(b"".join(planes(x[s:e], x.itemsize) for x in links), "zstd", asbytes=True)) for s, e in zip(*runs(part))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.int32(), pa.int32(), pa.binary()))], ["part", "n", "links"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "part"):
            for lo, hi in zip(*runs(table.column("part").to_numpy())):
                t = table.slice(lo, hi - lo)
                rows = [unpacked_links(x.as_buffer(), n) for x, n in zip(t.column("links"), t.column("n").to_pylist())]
                links = [np.concatenate(c) for c in zip(*rows)]
                out: list[tuple] = []
                for *pair, at, src_at in row_chains(*links, conf):  # the chains of a pair follow each other
                    if not out or out[-1][:4] != tuple(pair):
                        out.append((*pair, [], []))
                    out[-1][4].append(at)
                    out[-1][5].append(src_at)
                # a row without a source: its places of frequent seeds, and those that may be open
                out += [(d, k, None, None, [at], [np.flatnonzero(dense).tolist()]) for d, k, at, dense in open_places(links[0], links[1], links[4], conf)]
                if not out:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.list_(pa.list_(pa.int32()))] * 2))],
                    ["did", "key", "src", "skey", "at", "src_at"])

    def by_part(df: DataFrame) -> DataFrame:
        return df.repartition("part").sortWithinPartitions("part")

    named = rows.mapInArrow(frugal(seed), "part int, names binary, pos binary, n int, rows binary")
    links = by_part(named).mapInArrow(frugal(link), "part int, n int, links binary")
    chained = by_part(links).mapInArrow(frugal(chain), "did long, key int, src long, skey int, at array<array<int>>, src_at array<array<int>>")
    chained = scratch.write(chained, "chains")
    del named, links
    release(spark)
    placed, chained = chained.filter("src IS NULL"), chained.filter("src IS NOT NULL")

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved, stays = _Words(), _Words()
        for b in batches:
            out = []
            for did, key, src, skey, at, src_at, shorter, text, other in ([c.as_py() for c in row] for row in zip(*b.columns)):
                own, source = moved.of(text), stays.of(other)
                (x, xs, xe), (y, ys, ye) = (own, source) if shorter else (source, own)
                if at is None:  # a pair that met: by all seeds that it shares
                    pos, to = common_links(x, y, conf)
                    same = [np.full(len(pos), v, k) for v, k in ((did, np.int64), (key, np.int32), (src, np.int64), (skey, np.int32))]
                    met = [c[4:] for c in row_chains(*same, pos, to, conf)] if len(pos) >= shared_seeds(conf) else []
                else:
                    met = zip(at, src_at)
                for own, other in met:
                    for s, e, t, f, alike in _aligned(x, y, own, other, conf):
                        out.append((did, key, src, s, e, t, f, int(xs[s]), int(xe[e - 1]), int(ys[t]), int(ye[f - 1]), alike))
            if out:
                cols = FOUND.split(", ")
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if c.endswith(" int") else None) for x, c in zip(zip(*out), cols)], [c.split()[0] for c in cols])

    def aligned(pairs: DataFrame, name: str) -> DataFrame:
        """The passages of pairs.  The shorter text of a pair goes to the longer one, in rounds."""
        of_source = sizes.select(F.col("did").alias("src"), F.col("key").alias("skey"), F.col("size").alias("src_size"))
        sized = pairs.join(sizes, ["did", "key"]).join(of_source, ["src", "skey"])
        shorter = F.col("size") <= F.col("src_size")
        one = lambda a, b: F.when(shorter, F.col(a)).otherwise(F.col(b))
        sized = scratch.write(sized.select(*pairs.columns, shorter.alias("shorter"), F.least("size", "src_size").alias("moved"), one("did", "src").alias("a"), one("key", "skey").alias("a_key"),
                                           one("src", "did").alias("b"), one("skey", "key").alias("b_key")), f"{name}_sized")
        n = rounds(sized.agg(F.sum("moved")).first()[0] or 0, size)
        release(spark)
        for r in range(n):
            part = sized.filter(F.pmod(F.xxhash64("a", "a_key", "b", "b_key"), F.lit(n)) == r)
            ids = scratch.write(part.select(F.col("a").alias("did"), F.col("a_key").alias("key")).union(part.select("b", "b_key")).distinct(), f"{name}_ids{r}")
            held = texts.join(broadcast_rows_if_bounded(ids, ids.count(), ID_ROW_BYTES), ["did", "key"], "left_semi")
            both = part.join(held.select(F.col("did").alias("a"), F.col("key").alias("a_key"), "text"), ["a", "a_key"]).join(
                held.select(F.col("did").alias("b"), F.col("key").alias("b_key"), F.col("text").alias("other")), ["b", "b_key"])
            both = both.select("did", "key", "src", "skey", "at", "src_at", "shorter", "text", "other")
            scratch.write(both.mapInArrow(frugal(passages), FOUND), f"{name}/round={r}")
            del part, ids, held, both
            release(spark)
        del sized
        scratch.drop(f"{name}_sized")
        return scratch.read(name, FOUND)

    found = aligned(chained, "found")

    cols = ["did", "key", "pos", "prev", "follows"]

    def place(n: int, r: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, n_out = [], 0
            for did, key, at, may, spans, text in zip(*(b.column(c) for c in ("did", "key", "places", "may", "spans", "text"))):
                buf, offs = text_bytes(pa.array([text.as_py()]))
                h = word_hashes(buf, offs)[0]
                every = at.values.to_numpy().astype(np.int64)
                name = kmers(h, conf.k)
                covered = np.zeros(len(h) + 1, np.int64)
                for x in spans.as_py() or ():
                    covered[x["start_word"]] += 1
                    covered[x["end_word"]] -= 1
                bare = np.concatenate([[0], np.cumsum(uncovered(np.cumsum(covered[:-1]) == 0, conf.k))])
                is_open = np.zeros(len(every), bool)
                is_open[may.values.to_numpy()] = True
                is_open &= bare[every + conf.k] > bare[every]
                # the word before, if the seed there is a place too: 0 if not; and whether that one is open
                after = np.zeros(len(every), bool)
                after[1:] = every[1:] == every[:-1] + 1
                prev = np.where(after, h[every - 1] | np.uint64(1), np.uint64(0))
                follows = after & np.roll(is_open, 1)
                now = np.flatnonzero(mix64(name[every]) % np.uint64(n) == r)
                every = every[now]
                out.append((name[every].view(np.int64), contexts(h, every, conf).view(np.int64), is_open[now], np.full(len(every), did.as_py(), np.int64),
                            np.full(len(every), key.as_py(), np.int32), every.astype(np.int32), prev[now].view(np.int64), follows[now]))
                n_out += len(every)
                if n_out >= BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["name", "context", "open", *cols])
                    out, n_out = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["name", "context", "open", *cols])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(out: list[tuple], names: list[str]) -> pa.RecordBatch:
            *own, did, key, more, twos, bags = zip(*out)
            did, key, more, twos, bags = map(np.concatenate, (did, key, more, twos, bags))
            bags = pa.Array.from_buffers(pa.binary(bags.shape[1]), len(bags), [None, pa.py_buffer(bags.tobytes())]).cast(pa.binary())
            return pa.RecordBatch.from_arrays([*map(pa.concat_arrays, own), *map(pa.array, (did, key, more, twos)), bags], [*names, "did", "key", "more", "more_twos", "bags"])

        for b in batches:
            out, n_out = [], 0
            for did, key, at, text in zip(*(b.column(c) for c in ("did", "key", "places", "text"))):
                h = word_hashes(*text_bytes(pa.array([text.as_py()])))[0]
                two = kmers(h, 2)
                for lo in range(0, len(at.values), BLOCK):
                    t = at.values.slice(lo, BLOCK)
                    names, n = t.type.names, len(t)
                    t = dict(zip(names, t.flatten()))
                    places = t["pos"].to_numpy().astype(np.int64)
                    (bags, more), (of_twos, twos) = around(h, places, conf), around(two, places, conf)
                    out.append((*t.values(), np.full(n, did.as_py(), np.int64), np.full(n, key.as_py(), np.int32), more, twos, np.concatenate([bags, of_twos], axis=1)))
                    n_out += n
                    if n_out >= BLOCK:
                        yield packed(out, names)
                        out, n_out = [], 0
            if out:
                yield packed(out, names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell"):
            for s, e in zip(*runs(table.column("cell").to_numpy())):
                cell = table.slice(s, e - s)
                names = cell.column("name").to_numpy()
                order = np.argsort(names, kind="stable")
                for lo, hi in zip(*runs(names[order])):
                    t = cell.take(pa.array(order[lo:hi]))
                    did, key, prev, follows, more, twos, is_open, own, first = (
                        t.column(c).to_numpy() for c in ("did", "key", "prev", "follows", "more", "more_twos", "open", "own", "first"))
                    bags, of_twos = np.hsplit(np.frombuffer(b"".join(t.column("bags").to_pylist()), np.uint64).reshape(len(t), -1), 2)
                    if first[0]:  # a block with itself
                        sides = [(np.flatnonzero(is_open), np.arange(len(t)))]
                    else:
                        sides = [(np.flatnonzero(is_open & own), np.flatnonzero(~own)), (np.flatnonzero(is_open & ~own), np.flatnonzero(own))]
                    for left, right in sides:
                        for i, j in meetings(did, prev, follows, of_twos, twos, left, right, conf, 2):
                            both = enough(bags[i], more[i], bags[j], more[j], 1, conf)
                            i, j = i[both], j[both]
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (did[i], key[i], did[j], key[j])], ["did", "key", "src", "skey"])

    places_of = placed.select("did", "key", F.col("at")[0].alias("places"), F.col("src_at")[0].alias("may"))
    n_rounds = rounds((places_of.agg(F.sum(F.size("places"))).first()[0] or 0) * PLACE_BYTES, size)
    # the seeds of a round meet and are let go before those of the next
    for r in range(n_rounds):
        spans = found.groupBy("did", "key").agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
        whole = places_of.join(spans, ["did", "key"], "left").join(texts, ["did", "key"])
        places = scratch.write(whole.mapInArrow(frugal(partial(place, n_rounds, r)), "name long, context long, open boolean, did long, key int, pos int, prev long, follows boolean"), "places")
        del whole, spans
        release(spark)
        asked = places.filter("open").select("name").distinct()
        # of equal words around a seed the first are the source
        first = places.filter("NOT open").join(asked, "name", "left_semi").groupBy("name", "context").agg(F.min(F.struct(*cols)).alias("x")).select("name", F.lit(False).alias("open"), "x.*")
        meeting = scratch.write(places.filter("open").select("name", "open", *cols).union(first), "meeting")
        del asked, first, places
        scratch.drop("places")
        release(spark)
        # places of one seed meet by pairs of blocks; those behind one word whose open ones all follow its seed do not meet each other
        behind = meeting.groupBy("name", "prev").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and(F.when(F.col("open"), F.col("follows"))), F.lit(True)).alias("alike"))
        counts = behind.groupBy("name").agg(F.sum("n").alias("n"), F.max(F.when(F.col("alike"), F.struct("n", "prev"))).alias("most"))
        counts = counts.filter("most IS NULL OR n > most.n").withColumn("most", F.when(F.col("n") > BLOCK, F.col("most")))
        n_alike = F.coalesce(F.col("most.n"), F.lit(0))
        in_blocks = lambda n: F.ceil(n / BLOCK).cast("int")
        counts = counts.select("name", F.col("most.prev").alias("behind"), in_blocks(F.col("n") - n_alike).alias("others"), in_blocks(n_alike).alias("alike"))
        alike, others, at = F.col("prev").eqNullSafe(F.col("behind")), F.col("others"), F.xxhash64("did", "key", "pos")
        dealt = meeting.join(counts, "name").withColumns({
            "block": F.when(alike, others + F.pmod(at, F.greatest("alike", F.lit(1)))).otherwise(F.pmod(at, others)).cast("int"),
            "blocks": F.when(alike, others).otherwise(others + F.col("alike"))})
        dealt = dealt.groupBy("did", "key").agg(F.collect_list(F.struct("name", "open", "pos", "prev", "follows", "block", "blocks")).alias("places"))
        dealt = scratch.write(dealt, "dealt")
        del behind, counts, meeting
        scratch.drop("meeting")
        release(spark)
        sent = dealt.agg(F.sum(F.aggregate("places", F.lit(0).cast("long"), lambda n, p: n + p["blocks"]))).first()[0] or 0
        n_cells = rounds(sent * PACKED_BYTES, size)
        for c in range(n_cells):
            mine = lambda cell: F.pmod(cell, F.lit(n_cells)) == c  # noqa: B023, E731
            some = dealt
            if n_cells > 1:
                in_round = lambda p: F.exists(F.sequence(F.lit(0), p["blocks"] - 1), lambda o: mine(cell_of(p["name"], p["block"], o)))  # noqa: B023, E731
                some = dealt.withColumn("places", F.filter("places", in_round)).filter(F.size("places") > 0)
            some = some.join(texts, ["did", "key"]).mapInArrow(
                frugal(pack), "name long, open boolean, pos int, prev long, follows boolean, block int, blocks int, did long, key int, more int, more_twos int, bags binary")
            some = some.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            low, high = F.least("block", "other"), F.greatest("block", "other")
            some = some.select("name", "open", "did", "key", "prev", "follows", "more", "more_twos", "bags", (F.col("block") == low).alias("own"), (low == high).alias("first"),
                               cell_of(F.col("name"), F.col("block"), F.col("other")).alias("cell")).filter(mine(F.col("cell")))
            pairs = some.repartition("cell").sortWithinPartitions("cell").mapInArrow(frugal(meet), PAIR).distinct()
            scratch.write(pairs, f"pairs/round={r}-{c}")
            del some, pairs
            release(spark)
        del dealt
        scratch.drop("dealt")
        release(spark)
    pairs = scratch.read("pairs", PAIR).distinct()
    none = F.lit(None).cast("array<array<int>>")
    return found.union(aligned(pairs.withColumns({"at": none, "src_at": none}), "met"))


def find_passages(docs: DataFrame, conf: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage: ``id_col``, ``source_id`` (the earlier document), ranges in both, ``similarity``.

    Ranges are given in words and in code points; ends are exclusive.
    """
    found = _found(docs, conf, *_row(docs, id_col, text_col))
    return found.select(F.when(F.col("did") < LAST, F.col("did")).alias(id_col), F.col("src").alias("source_id"),
                        *(F.col(c.split()[0]) for c in FOUND.split(", ")[3:])).distinct()


def without_passages(docs: DataFrame, conf: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the passages cut out of ``text_col``; every row and column stays."""
    # the spans of one row, told by its id and its text's hash: bounded by its own text
    row, shared = _row(docs, id_col, text_col)
    spans = _found(docs, conf, row, shared).groupBy("did", "key").agg(F.collect_set(F.struct("start_char", "end_char")).alias("spans"))
    spans = Scratch(docs.sparkSession, "spans").write(spans, "spans")
    rows, many = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *row[:2])  # so that no name clashes
    joined = whole.join(broadcast_rows_if_bounded(spans, rows + many, ID_ROW_BYTES), ["did", "key"], "left").select("row", "spans")
    names = docs.columns
    at = names.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = b.column("row").flatten()
            text = cols[at].to_pylist()
            for r, spans in enumerate(b.column("spans").to_pylist()):
                if spans and text[r]:
                    parts, end = [], 0
                    for s, e in sorted((x["start_char"], x["end_char"]) for x in spans):
                        parts.append(text[r][end:max(s, end)])
                        end = max(end, e)
                    text[r] = "".join(parts) + text[r][end:]
            cols[at] = pa.array(text, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return joined.mapInArrow(frugal(cut), docs.schema)
