import numpy as np
import pyarrow as pa
import pytest

from feedline.llm.batches import prefix_sums, slices, span_hashes, text_bytes, whole_groups, words
from feedline.llm.components import LocalComponents, connected_components
from feedline.llm.scratch import Scratch

from .common import WORD, components


def test_words_and_span_hashes_match_the_pattern():
    texts = [None, "", "  a b  c", "é x\n", "a\x1fb\x0cc d", "z" * 5000 + " q " + "z" * 5000, "a b c a"]
    buf, offs = text_bytes(pa.array(texts))
    names = {}
    for lo, hi in slices(offs, 16):
        part = buf[offs[lo]:offs[hi]]
        s, e, w = words(part, offs[lo:hi + 1] - offs[lo])
        h = span_hashes(prefix_sums(part), s, e)
        for i in range(lo, hi):
            mine = range(w[i - lo], w[i - lo + 1])
            found = [part[s[k]:e[k]].tobytes().decode() for k in mine]
            assert found == WORD.findall(texts[i] or "")
            for word, k in zip(found, mine):
                assert names.setdefault(word, h[k]) == h[k]
    assert len(set(names.values())) == len(names)


def test_text_bytes_of_a_slice():
    col = pa.array(["ab", None, "cde", ""]).slice(1, 3)
    buf, offs = text_bytes(col)
    assert buf.tobytes() == b"cde" and offs.tolist() == [0, 0, 3, 3]


@pytest.mark.parametrize("cut", [1, 2, 3, 100])
def test_whole_groups_keep_runs_together(cut):
    keys = [1, 1, 2, 3, 3, 3, 3, 4, 5, 5]
    batches = [pa.RecordBatch.from_pydict({"k": keys[i:i + cut]}) for i in range(0, len(keys), cut)]
    seen = [t.column("k").to_pylist() for t in whole_groups(iter(batches), "k")]
    assert sum(seen, []) == keys
    assert all(not set(a) & set(b) for i, a in enumerate(seen) for b in seen[i + 1:])


def test_local_components():
    rng = np.random.default_rng(1)
    i, j = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    c = LocalComponents(300)
    c.join(i[:100], j[:100])
    c.join(i[100:], j[100:])
    assert c.label.tolist() == components(300, list(zip(i.tolist(), j.tolist())))


def test_connected_components_of_a_path_a_star_and_random_links(spark):
    rng = np.random.default_rng(2)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(5, 5), (1, 0), (0, 1)]
    links += [(int(a), int(b)) for a, b in rng.integers(200, 300, (60, 2))]
    df = spark.createDataFrame(links, "u long, v long")
    got = {r.node: r.root for r in connected_components(df, Scratch(spark, "t")).collect()}
    want = components(300, links)
    assert got == {x: want[x] for l in links if l[0] != l[1] for x in l}
    assert connected_components(df.limit(0), Scratch(spark, "t")).count() == 0
