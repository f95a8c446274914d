import random

import numpy as np
import pytest

from feedline.llm import passages
from feedline.llm.passages import BAG_BITS, Settings, align, around, chains, common_links, find_passages, kmers, meetings, open_places, without_passages

from .common import docs, odd_rows, words


def fuzz(ws, share, rng):
    out = []
    for w in ws:
        r = rng.random()
        if r >= share:
            out.append(w)
        elif r < share / 2:
            out.append(words(1, rng)[0])
        elif r < share * 0.75:
            out += [w, words(1, rng)[0]]
    return out


def best_chain(d, a, conf):
    score = []
    for j in range(len(d)):
        before = [score[i] - conf.gap * (d[j] - d[i] + a[j] - a[i]) for i in range(j) if d[i] < d[j] and a[i] < a[j]]
        score.append(conf.weight + max([0.0, *before]))
    return max(score)


def test_chains_are_as_good_as_the_quadratic_recurrence():
    rng = random.Random(7)
    for _ in range(300):
        n = rng.randrange(1, 25)
        links = sorted((rng.randrange(60), rng.randrange(60)) for _ in range(n))
        d, a = map(list, zip(*links))
        conf = Settings(min_score=0)
        got = chains(d, a, conf)
        assert got[0][0] == pytest.approx(best_chain(d, a, conf))
        seen = [x for _, c in got for x in c]
        assert len(seen) == len(set(seen))
        for _, c in got:
            assert all(d[x] < d[y] and a[x] < a[y] for x, y in zip(c, c[1:]))


def test_alignment_ends():
    rng = np.random.default_rng(1)
    p, q, r = (rng.integers(0, 1 << 40, n) for n in (70, 30, 30))
    x, y = np.concatenate([q, p]), np.concatenate([r[:10], p, r[10:]])
    assert align(x, y, [(50, 30)], Settings()) == (30, 100, 10, 80, 1.0)
    assert align(x, y[:50], [(50, 30)], Settings()) is None  # 40 words only
    z = np.delete(p, 33)
    z[50] = 1
    s, e, t, f, alike = align(p, z, [(2, 2)], Settings())
    assert (s, e, t, f) == (0, 70, 0, 69) and 0.95 < alike < 1


def test_planted_passages_are_found_and_clean_documents_left(spark):
    rng = random.Random(5)
    exact, fuzzy, short = words(60, rng), words(120, rng), words(20, rng)
    rows, dirty = [], set()
    for i in range(150):
        w = words(rng.randint(20, 300), rng)
        if i % 3 == 0:
            w = w[:10] + short + w[10:]
        if i % 5 == 0:
            w = w[:15] + exact + w[15:]
            dirty.add(i)
        if i % 21 == 1:
            w = w + fuzz(fuzzy, 0.03, rng)
            dirty.add(i)
        rows.append((i, " ".join(w)))
    dirty -= {0, 1}  # the first holders
    got = find_passages(docs(spark, rows)).collect()
    assert {r.doc_id for r in got} == dirty
    text = dict(rows)
    for r in got:
        assert r.source_id < r.doc_id and r.similarity >= 0.8 and r.end_word - r.start_word >= 50
        cut = text[r.doc_id][r.start_char:r.end_char]
        assert cut.split() == text[r.doc_id].split()[r.start_word:r.end_word]
        assert text[r.source_id][r.src_start_char:r.src_end_char].split() == text[r.source_id].split()[r.src_start_word:r.src_end_word]
    plain = [r for r in got if r.doc_id % 5 == 0 and r.source_id == 0]
    assert len(plain) == 29 and all(" ".join(exact) in text[r.doc_id][r.start_char:r.end_char] for r in plain)


def test_odd_rows(spark):
    rows = odd_rows()
    df = docs(spark, rows)
    got = {(r.doc_id, r.source_id) for r in find_passages(df).collect()}
    assert got == {(5, 4), (None, 4), (7, 6)}
    cut = without_passages(df)
    assert cut.columns == df.columns
    text = {}
    for r in cut.collect():
        text.setdefault(r.doc_id, []).append(r.text)
    assert sum(map(len, text.values())) == len(rows)
    assert text[5] == ["", ""] and text[7] == [" end"] and text[1] == [None] and text[4] == [rows[5][1]] and len(text[None]) == 2
    assert find_passages(df.limit(0)).count() == 0 and without_passages(df.limit(0)).count() == 0


def test_one_passage_in_many_documents_gives_one_row_each(spark):
    rng = random.Random(8)
    p = words(70, rng)
    rows = [(i, " ".join([*words(30, rng), *p, *words(30, rng)])) for i in range(300)]
    got = find_passages(docs(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 300)) and {r.source_id for r in got} == {0}


def test_a_gap_before_a_further_link_is_bridged():
    rng = np.random.default_rng(2)
    for n, at, gap in ((80, 40, 11), (100, 70, 20), (200, 100, 40)):
        p, other = rng.integers(0, 1 << 40, n), rng.integers(0, 1 << 40, gap)
        x = np.concatenate([p[:at], other, p[at:]])
        links = [(0, 0), (20, 20), (at + gap, at), (at + gap + 10, at + 10)]
        assert align(x, p, links, Settings()) == (0, n + gap, 0, n, n / (n + gap))
        assert align(p, x, [(j, i) for i, j in links], Settings()) == (0, n, 0, n + gap, n / (n + gap))
    q = np.concatenate([p[:60], rng.integers(0, 1 << 40, 60), p[60:120]])
    assert align(q, p[:120], [(0, 0), (120, 60)], Settings()) == (0, 60, 0, 60, 1.0)  # 120 of 180 words


def test_a_source_that_is_no_first_holder_is_found(spark):
    rng = random.Random(11)
    a, b = words(40, rng), words(40, rng)
    phrases = [words(10, rng) for _ in range(9)]
    text = {0: [*words(30, rng), *a, *words(30, rng)], 1: [*words(30, rng), *b], 2: [*a, *b], 3: [*words(20, rng), *a, *words(20, rng)],
            4: [*words(20, rng), *b, *words(20, rng)], 5: [*words(25, rng), *a, *b, *words(25, rng)]}
    # all stretches of 40 words of a passage of 90 stand elsewhere earlier, twice
    for i in range(12):
        text[10 + i] = [*words(20, rng), *sum(phrases[i // 2:i // 2 + 4], []), *words(20, rng)]
    text[30] = [*words(20, rng), *sum(phrases, []), *words(20, rng)]
    for i in range(12):
        text[40 + i] = [*words(20, rng), *sum(phrases[i // 2:i // 2 + 4], []), *words(20, rng)]
    text[60] = [*words(35, rng), *sum(phrases, [])]
    rows = [(i, " ".join(w)) for i, w in text.items()]
    got = {(r.doc_id, r.source_id, r.start_word, r.end_word) for r in find_passages(docs(spark, rows)).collect()}
    assert got == {(5, 2, 25, 105), (60, 30, 35, 125)}
    left = {r.doc_id: r.text.split() for r in without_passages(docs(spark, rows)).collect()}
    assert left == {**text, 5: text[5][:25] + text[5][105:], 60: text[60][:35]}


def test_exact_repeats_in_a_corpus_of_shared_phrases_as_brute_force_finds_them(spark):
    rng = random.Random(12)
    phrases = [words(rng.randint(8, 30), rng) for _ in range(60)]
    text = [[w for _ in range(12) for w in rng.choice(phrases)] for _ in range(120)]
    for i in range(40, 120, 3):  # passages of several earlier documents
        for j in rng.sample(range(i), 2):
            at = rng.randrange(len(text[j]) - 60)
            text[i] = [*text[i], *text[j][at:at + rng.randint(50, 60)]]
    seen, want = {}, {}
    for i, w in enumerate(text):
        own = [tuple(w[p:p + 50]) for p in range(len(w) - 49)]
        want[i] = {q for p, s in enumerate(own) if s in seen for q in range(p, p + 50)}
        seen.update(dict.fromkeys(own, i))
    assert sum(map(len, want.values())) > 2000
    held = {i: set() for i in want}
    for r in find_passages(docs(spark, [(i, " ".join(w)) for i, w in enumerate(text)])).collect():
        held[r.doc_id].update(range(r.start_word, r.end_word))
    lost = {i: sorted(want[i] - held[i]) for i in want if want[i] - held[i]}
    # words at the edge of another source's passage, fewer than a seed has
    assert all(len(v) <= 4 for v in lost.values()) and sum(map(len, lost.values())) <= 0.01 * sum(map(len, want.values()))


def test_a_passage_held_twice_and_one_whose_phrases_also_stand_elsewhere(spark):
    rng = random.Random(13)
    p, q, line = words(60, rng), words(90, rng), words(12, rng)
    rest = lambda: words(25, rng)
    text = {0: [*rest(), *p, *rest()], 1: [*rest(), *p, *rest(), *p, *rest()],
            # the phrases of q, and the line, stand before it in one of the two only
            2: [*q[50:70], *line, *rest(), *q[10:30], *line, *rest(), *q], 3: [*rest(), *q, *line]}
    got = {(r.doc_id, r.source_id, r.start_word, r.end_word) for r in find_passages(docs(spark, [(i, " ".join(w)) for i, w in text.items()])).collect()}
    assert got == {(1, 0, 25, 85), (1, 0, 110, 170), (3, 2, 25, 115)}


def test_fuzzy_passages_at_edit_shares_up_to_the_threshold(spark):
    rng = random.Random(14)
    rows, want = [], {}
    for n in (50, 80, 150):
        for share in (0.05, 0.1, 0.15, 0.2):
            for spread in (True, False):
                for _ in range(10):
                    p, i = words(n, rng), len(rows)
                    m = round(n * share)
                    at = [int((j + 0.5) * n / m) for j in range(m)] if spread else rng.sample(range(n), m)
                    q = [words(1, rng)[0] if j in at else w for j, w in enumerate(p)]
                    rows += [(i, " ".join([*words(40, rng), *p, *words(40, rng)])), (i + 1, " ".join([*words(40, rng), *q, *words(40, rng)]))]
                    want.setdefault((n, share, spread), []).append(i + 1)
    held = {r.doc_id for r in find_passages(docs(spark, rows)).collect() if r.source_id == r.doc_id - 1}
    found = {c: sum(d in held for d in ids) for c, ids in want.items()}
    # spread evenly, all but 50 words whose last, differing ones leave no seed behind them
    assert all(found[n, share, True] == 10 for n in (50, 80, 150) for share in (0.05, 0.1, 0.15, 0.2) if (n, share) != (50, 0.2))
    # at random places the aligned stretch of a short or heavily edited passage may be no passage
    assert all(found[n, share, False] == 10 for n in (80, 150) for share in (0.05, 0.1)) and found[150, 0.15, False] >= 8


def test_rows_without_ids_are_cut_and_rows_that_share_an_id_by_their_own_spans(spark):
    rng = random.Random(15)
    p, own, other = words(70, rng), words(40, rng), words(200, rng)
    rows = [(1, " ".join(p)), (2, " ".join([*own, *p])), (2, " ".join(other)), (None, " ".join([*p, *own]))]
    left = sorted(((r.doc_id, r.text.split()) for r in without_passages(docs(spark, rows)).collect()), key=str)
    assert left == sorted([(1, p), (2, own), (2, other), (None, own)], key=str)


def test_edited_passages_are_found_at_all_rates_of_edits(spark):
    """Recall of planted passages against the truth: random substitutions of 5 to 20 % in 50, 80 and 150 words."""
    rng = random.Random(31)
    own = lambda n: [f"v{rng.randrange(10 ** 7)}" for _ in range(n)]
    rows, planted = [], {}
    for n in (50, 80, 150):
        for share in (0.05, 0.1, 0.15, 0.2):
            for _ in range(10):
                p = own(n)
                copy = list(p)
                for i in rng.sample(range(n), int(n * share)):
                    copy[i] = own(1)[0]
                d = len(rows)
                rows += [(d, " ".join([*own(60), *p, *own(60)])), (d + 1, " ".join([*own(70), *copy, *own(50)]))]
                planted[d + 1] = (n, share, d)
    got = {}
    for r in find_passages(docs(spark, rows)).collect():
        assert r.similarity >= 0.8
        n, _, source = planted[r.doc_id]
        if r.source_id == source and min(r.end_word, 70 + n) - max(r.start_word, 70) >= 0.6 * n:
            got[r.doc_id] = True
    for key in {v[:2] for v in planted.values()}:
        mine = [d for d, v in planted.items() if v[:2] == key]
        assert sum(d in got for d in mine) >= 0.9 * len(mine), key


def test_edited_passages_of_shared_phrases_are_found(spark):
    """Phrases that stand in other documents before the source and between it and the copy do not hide the source."""
    rng = random.Random(33)
    own = lambda n: [f"v{rng.randrange(10 ** 7)}" for _ in range(n)]
    found = {}
    for size in (15, 25, 40):
        rows, truth = [], {}
        for _ in range(10):
            phrases = [own(size) for _ in range(120 // size)]
            p = [w for x in phrases for w in x]
            copy = list(p)
            for i in rng.sample(range(len(p)), 10):
                copy[i] = own(1)[0]
            alone = lambda: [(len(rows) + i, " ".join([*own(30), *x, *own(30)])) for i, x in enumerate(phrases)]
            rows += alone()
            source = len(rows)
            rows.append((source, " ".join([*own(40), *p, *own(40)])))
            rows += alone()
            truth[len(rows)] = source
            rows.append((len(rows), " ".join([*own(40), *copy, *own(40)])))
        covered = {d: set() for d in truth}
        for r in find_passages(docs(spark, rows)).collect():
            if truth.get(r.doc_id) == r.source_id:
                covered[r.doc_id].update(range(r.start_word, r.end_word))
        found[size] = sum(len(v) >= 72 for v in covered.values())
    assert min(found.values()) >= 9, found


@pytest.mark.parametrize("block", [passages.BLOCK, 3])
def test_edited_passages_whose_seeds_are_all_frequent_are_found(spark, monkeypatch, block):
    """Phrases that many documents hold before the source and between it and the copy do not hide the source."""
    monkeypatch.setattr(passages, "BLOCK", block)
    rng = random.Random(35)
    own = lambda n: [f"v{rng.randrange(10 ** 7)}" for _ in range(n)]
    rows, truth = [], {}
    for size in (10, 15, 20):
        for _ in range(4):
            phrases = [own(size) for _ in range(120 // size)]
            p = [w for x in phrases for w in x]
            # seeds where two phrases meet are frequent too
            pairs = [x + y for x, y in zip(phrases, phrases[1:])]

            def alone():
                for x in pairs:
                    rows.append((len(rows), " ".join([*own(30), *x, *own(30)])))

            for _ in range(3):
                alone()
            source = len(rows)
            rows.append((source, " ".join([*own(40), *p, *own(40)])))
            for _ in range(3):
                alone()
            copy = list(p)
            for i in rng.sample(range(len(p)), 10):
                copy[i] = own(1)[0]
            truth[len(rows)] = source
            rows.append((len(rows), " ".join([*own(40), *copy, *own(40)])))
    df = docs(spark, rows)
    covered = {d: set() for d in truth}
    for r in find_passages(df).collect():
        if truth.get(r.doc_id) == r.source_id:
            covered[r.doc_id].update(range(r.start_word, r.end_word))
    assert all(len(v & set(range(40, 160))) >= 100 for v in covered.values()), {d: len(v) for d, v in covered.items()}
    left = {r.doc_id: r.text for r in without_passages(df).collect()}
    assert all(len(left[d].split()) <= 100 for d in truth)


def test_places_that_meet_are_those_of_enough_common_words_as_brute_force_finds_them():
    rng = np.random.default_rng(36)
    conf = Settings()
    line = rng.integers(1, 1 << 60, 6).astype(np.uint64)
    base = rng.integers(1, 1 << 60, 100).astype(np.uint64)
    texts = []
    for i in range(40):
        w = np.where(rng.random(100) < i / 60, rng.integers(1, 1 << 60, 100).astype(np.uint64), base)
        texts.append(np.concatenate([w[:50], line, w[50:]]))
    at = np.array([50])
    bags, more = zip(*(around(x, at, conf) for x in texts))
    bags, more = np.concatenate(bags).view(np.uint64), np.concatenate(more)
    assert bags.shape == (40, BAG_BITS // 64)
    did, every = np.arange(40), np.arange(40)
    prev = np.array([x[49] for x in texts])
    got = {(int(a), int(b)) for i, j in meetings(did, prev, np.zeros(40, bool), bags, more, every, every, conf) for a, b in zip(i, j)}
    same = {(i, j): len(set(texts[i][:104].tolist()) & set(texts[j][:104].tolist())) for i in range(40) for j in range(i)}
    assert {p for p, n in same.items() if n >= 40} <= got  # none is lost
    assert all(same[p] >= 15 for p in got) and len(got) < len(same)
    after = {(int(a), int(b)) for i, j in meetings(did, prev, np.ones(40, bool), bags, more, every, every, conf) for a, b in zip(i, j)}
    assert after == {(i, j) for i, j in got if prev[i] != prev[j]}


def test_common_links_and_open_places():
    conf = Settings()
    x, y = np.array([1, 2, 3, 4, 5, 1, 2, 3, 4, 9], np.uint64), np.array([7, 1, 2, 3, 4, 5], np.uint64)
    assert [c.tolist() for c in common_links(x, y, conf)] == [[0, 1, 5], [1, 2, 1]]
    assert len(kmers(x[:3], 4)) == 0 and [len(c) for c in common_links(x[:3], y, conf)] == [0, 0]
    pos = np.array([0, 6, 12, 18, 24, 30, 36, 100, 36, 300 | passages.RARE, 5 | passages.LONG], np.int32)
    got = list(open_places(np.full(11, 3), np.zeros(11, np.int32), pos, conf))
    assert got == [(3, 0, [0, 6, 12, 18, 24, 30, 36, 100], [True] * 7 + [False])]
    assert list(open_places(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), conf)) == []


def test_rounds_keep_what_is_moved_within_the_texts_and_find_the_same(spark, monkeypatch):
    """Pairs and places go over the corpus in rounds."""
    gb = 10 ** 9
    assert [passages.rounds(n, gb) for n in (0, 1, 3 * gb // 2, 3 * gb // 2 + 1, 15 * gb)] == [1, 1, 1, 2, 10] and passages.rounds(10 ** 6, 0) == 1
    rng = random.Random(37)
    own = lambda n: [f"v{rng.randrange(10 ** 7)}" for _ in range(n)]
    p, q = own(60), own(80)
    phrases = [own(15) for _ in range(6)]
    line = [w for x in phrases for w in x]
    edited = [w if i % 12 else own(1)[0] for i, w in enumerate(line)]
    # sources that are longer and shorter than their copies, and a fuzzy passage whose seeds are all frequent
    rows = [(i, " ".join([*own(20), *phrases[i % 6], *phrases[(i + 1) % 6], *own(20)])) for i in range(30)]
    rows += [(40, " ".join([*own(900), *p, *own(9)])), (41, " ".join(p)), (42, " ".join([*q, *own(9)])), (43, " ".join([*own(900), *q]))]
    rows += [(50, " ".join([*own(30), *line, *own(30)]))]
    rows += [(60 + i, " ".join([*own(20), *phrases[i % 6], *phrases[(i + 1) % 6], *own(20)])) for i in range(30)]
    rows += [(99, " ".join([*own(30), *edited, *own(30)]))]
    df = docs(spark, rows)
    once = sorted(map(tuple, find_passages(df).collect()))
    assert {(41, 40), (43, 42), (99, 50)} <= {r[:2] for r in once}
    moved = []
    monkeypatch.setattr(passages, "BLOCK", 7)
    monkeypatch.setattr(passages, "rounds", lambda n, size: moved.append(n) or 2)
    assert sorted(map(tuple, find_passages(df).collect())) == once
    assert len(moved) == 5 and min(moved) > 0, moved  # pairs, seeds, blocks twice, pairs that met


def test_the_shorter_text_of_a_pair_is_moved(spark, monkeypatch):
    rng = random.Random(38)
    own = lambda n: [f"v{rng.randrange(10 ** 7)}" for _ in range(n)]
    p, q = own(60), own(80)
    some, moved = [(40, " ".join([*own(900), *p, *own(9)])), (41, " ".join(p)), (42, " ".join([*q, *own(9)])), (43, " ".join([*own(900), *q]))], []
    monkeypatch.setattr(passages, "rounds", lambda n, size: moved.append(n) or 1)
    assert {r[:2] for r in map(tuple, find_passages(docs(spark, some)).collect())} == {(41, 40), (43, 42)}
    assert moved[0] == len(some[1][1]) + len(some[2][1])


def test_texts_of_common_words_around_a_frequent_line_do_not_meet(spark, monkeypatch):
    """Words in common are not enough: pairs of words in a row must be, or else all holders of a line meet each other."""
    rng = random.Random(40)
    common = [f"c{i}" for i in range(60)]
    line = [f"v{rng.randrange(10 ** 7)}" for _ in range(12)]
    rows = [(i, " ".join([*line, *rng.choices(common, k=90)])) for i in range(40)]
    moved = []
    monkeypatch.setattr(passages, "rounds", lambda n, size: moved.append(n) or 1)
    assert find_passages(docs(spark, rows)).count() == 0
    assert moved[-1] == 0, moved  # the texts of pairs that met


@pytest.mark.parametrize("block", [passages.BLOCK, 5])
def test_places_behind_the_same_word_are_not_dealt_to_each_other(spark, monkeypatch, block):
    """A line is met by its first seed; a holder that begins it otherwise meets all others by the next one."""
    monkeypatch.setattr(passages, "BLOCK", block)
    rng = random.Random(41)
    own = lambda n: [f"v{rng.randrange(10 ** 7)}" for _ in range(n)]
    line, tail = own(30), own(30)
    rows = [(i, " ".join([*own(40), *line, *own(40)])) for i in range(30)]
    rows += [(40, " ".join([*own(40), *line, *tail]))]
    rows += [(50 + i, " ".join([*own(40), *line, *own(40)])) for i in range(30)]
    fuzzy = [w if i % 7 else own(1)[0] for i, w in enumerate(tail)]
    rows += [(99, " ".join([*own(40), *line[3:], *fuzzy]))]
    assert {r[:2] for r in map(tuple, find_passages(docs(spark, rows)).collect())} == {(99, 40)}
