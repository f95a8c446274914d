import itertools
import os

from pyspark.sql import functions as F

from feedline.operators.dedup import dedup_first, dedup_last_value_first_position
from feedline.operators.digest import POSTING_HEADER, digest_text, posting_line
from feedline.operators.joins import new_rows, seen_keys
from feedline.plans.state import Store

SCHEMA = "seq long, fingerprint string, title string, company string, location string, url string, " \
         "source string, is_remote boolean, description string, posted_at timestamp_ntz, " \
         "min_salary_usd_monthly double"


def _rows(spark, items):
    out = []
    for seq, fp, src in items:
        out.append((seq, fp, f"T{fp}", "Acme", "Remote", f"https://x/{fp}", src, True, "", None, None))
    return spark.createDataFrame(out, SCHEMA)


def test_dedup_keeps_last_values_at_first_position(spark):
    df = _rows(spark, [(1, "a", "remoteok"), (2, "b", "remoteok"), (3, "a", "himalayas")])
    got = {r["fingerprint"]: (r["seq"], r["source"]) for r in dedup_last_value_first_position(df).collect()}
    assert got == {"a": (1, "himalayas"), "b": (2, "remoteok")}


def test_dedup_first_keeps_first(spark):
    df = _rows(spark, [(5, "a", "x"), (2, "a", "y"), (9, "b", "z")])
    got = {r["fingerprint"]: (r["seq"], r["source"]) for r in dedup_first(df, "fingerprint").collect()}
    assert got == {"a": (2, "y"), "b": (9, "z")}


def test_seen_and_new_partition_the_batch(spark):
    hist = _rows(spark, [(0, "a", "x"), (1, "c", "x")])
    batch = _rows(spark, [(5, "a", "y"), (6, "b", "y"), (7, "b", "y")])
    seen = {r[0] for r in seen_keys(hist, batch).collect()}
    new = sorted(r["seq"] for r in new_rows(batch, hist).collect())
    assert seen == {"a"} and new == [6, 7]


def test_digest_text_format_and_overflow(spark):
    df = _rows(spark, [(i, f"f{i}", "remoteok") for i in range(12)])
    r = digest_text(df, 10, posting_line(), POSTING_HEADER).first()
    assert (r["n_items"], r["n_total"], r["overflow"]) == (10, 12, 2)
    lines = r["text"].split("\n")
    assert lines[0] == POSTING_HEADER.rstrip("\n") and lines[1] == ""
    assert lines[2] == "• *Tf0* @ Acme" and lines[3] == "  [remoteok] https://x/f0"
    assert r["text"].endswith("\n_...y 2 más guardadas en DB_")
    assert digest_text(df.limit(0), 10, posting_line(), POSTING_HEADER).count() == 0


def _keys(df):
    return sorted(r["fingerprint"] for r in df.collect())


def test_store_two_runs_retry_overflow_and_idempotence(spark, tmp_dir):
    store = Store(spark, os.path.join(tmp_dir, "state"))
    sent = []

    def ok(rows, total, run_id, kind):
        sent.append((rows.count(), total, run_id, kind))
        return True

    def fail(*_):
        return False

    run0 = _rows(spark, [(i, f"a{i}", "remoteok") for i in range(12)])
    rep = store.run(run0, 0, 10, ok)
    assert (rep.retried, rep.inserted, rep.sent) == (0, 12, True) and sent == [(10, 12, 0, "new")]
    assert store.pending().count() == 2  # overflow beyond the digest stays pending

    # run 1: delivery fails -> new rows stay pending; the retry of run 0's overflow also fails
    run1 = _rows(spark, [(100, "a0", "remoteok"), (101, "b1", "remoteok")])
    rep = store.run(run1, 1, 10, fail)
    assert (rep.retried, rep.retry_sent, rep.inserted, rep.sent) == (2, False, 1, False)
    assert store.pending().count() == 3

    # re-running run 1 (same batch id) rewrites the same folders: idempotent
    rep = store.run(run1, 1, 10, fail)
    assert rep.inserted == 1 and store.rows().count() == 13

    # run 2: retry succeeds and marks the first N pending
    rep = store.run(_rows(spark, [(200, "a0", "x")]), 2, 10, ok)
    assert (rep.retried, rep.retry_sent, rep.inserted) == (3, True, 0)
    assert store.pending().count() == 0 and sent[-1] == (3, 3, 2, "retry")


def test_retry_takes_the_oldest_rows_although_places_start_anew(spark, tmp_dir):
    """Eight new rows a run and a digest of two: rows of the first run come before those of later ones."""
    store, shown = Store(spark, os.path.join(tmp_dir, "s")), {}

    def send(rows, total, run_id, kind):
        shown[run_id, kind] = _keys(rows)
        return True

    for run in range(4):
        store.run(_rows(spark, [((100 if run == 0 else 0) + i, f"r{run}_{i}", "remoteok") for i in range(8)]), run, 2, send)
    assert [shown[r, "retry"] for r in (1, 2, 3)] == [["r0_2", "r0_3"], ["r0_4", "r0_5"], ["r0_6", "r0_7"]]
    assert all(shown[r, "new"] == [f"r{r}_0", f"r{r}_1"] for r in range(4))
    # what was shown is what is marked
    assert sorted(sum(shown.values(), [])) == _keys(store.notifications())


def test_ties_are_shown_and_marked_alike(spark, tmp_dir):
    store, shown = Store(spark, os.path.join(tmp_dir, "s")), []
    store.run(_rows(spark, [(7, f"k{i}", "remoteok") for i in range(9)]), 0, 4, lambda rows, *_: shown.extend(_keys(rows)) or True)
    assert shown == ["k0", "k1", "k2", "k3"] == _keys(store.notifications())


def test_first_run_keeps_one_row_per_key(spark, tmp_dir):
    store = Store(spark, os.path.join(tmp_dir, "s"))
    assert store.insert(_rows(spark, [(1, "a", "remoteok"), (2, "a", "himalayas"), (3, "b", "remoteok")]), 0) == 2
    assert {r["fingerprint"]: r["source"] for r in store.rows().collect()} == {"a": "remoteok", "b": "remoteok"}


def test_a_replay_with_nothing_leaves_nothing_of_the_run(spark, tmp_dir):
    from feedline.streaming.flows import digest_sink
    store, log = Store(spark, os.path.join(tmp_dir, "s")), os.path.join(tmp_dir, "digests")
    send = digest_sink(log, 2)
    store.run(_rows(spark, [(i, f"a{i}", "remoteok") for i in range(3)]), 0, 2, send)
    batch = _rows(spark, [(i, f"b{i}", "remoteok") for i in range(3)])
    for _ in range(2):
        store.run(batch, 1, 2, send)
    assert spark.read.parquet(log).count() == 3  # run 0 new, run 1 retry and new, each once
    rep = store.run(batch.limit(0), 1, 2, lambda *_: False)
    assert rep.inserted == 0 and _keys(store.rows()) == ["a0", "a1", "a2"] and _keys(store.pending()) == ["a2"]


def test_a_damaged_history_is_an_error_and_not_an_empty_one(spark, tmp_dir):
    import glob

    import pytest
    store = Store(spark, os.path.join(tmp_dir, "s"))
    store.run(_rows(spark, [(i, f"a{i}", "remoteok") for i in range(3)]), 0, 2, lambda *_: True)
    for path in glob.glob(os.path.join(tmp_dir, "s", "postings_keys", "run_id=0", "**", "*.parquet"), recursive=True):
        with open(path, "wb") as f:
            f.write(b"no parquet")
    with pytest.raises(Exception):
        store.run(_rows(spark, [(0, "a0", "remoteok")]), 1, 2, lambda *_: True)


def _break(monkeypatch, store, point):
    """Makes the store's next call of ``point`` fail, before or after its work."""
    import pytest

    when, name = point
    owner, attr = {"keys": (store.index, "add"), "saved": (store.log, "save"), "mark": (store, "mark"), "commit": (store.log, "commit"),
                   "intent": (store.log, "begin"), "admit": (store.schemas, "admit")}[name]
    real = getattr(owner, attr)

    def broken(*args):
        monkeypatch.setattr(owner, attr, real)
        if when == "after":
            real(*args)
        raise RuntimeError(f"{when} {name}")

    monkeypatch.setattr(owner, attr, broken)
    return pytest.raises(RuntimeError)


POINTS = [(when, name) for name in ("intent", "admit", "keys", "saved", "mark", "commit") for when in ("before", "after")]


def test_a_run_that_breaks_off_anywhere_forgets_nothing(spark, tmp_dir, monkeypatch):
    """After every step of a run: pending stays what the full history says, and later runs announce each row once saved."""
    for number, point in enumerate(POINTS):
        store, shown = Store(spark, os.path.join(tmp_dir, f"s{number}")), []

        def send(rows, total, run_id, kind):
            shown.extend(_keys(rows))
            return True

        store.run(_rows(spark, [(i, f"a{i}", "remoteok") for i in range(3)]), 0, 2, send)
        batch = _rows(spark, [(i, f"b{i}", "remoteok") for i in range(5)] + [(9, "a0", "x")])
        with _break(monkeypatch, store, point):
            store.run(batch, 1, 2, send)
        assert _keys(store.pending()) == _keys(store.pending_by_full_scan()), point
        assert sum(store.open_runs().values()) == store.pending().count(), point
        # the feeds still bring the rows; run number 2 is a new one and run 1 is never replayed
        store.run(batch, 2, 10, send)
        store.run(batch.limit(0), 4, 10, send)
        assert _keys(store.rows()) == ["a0", "a1", "a2", "b0", "b1", "b2", "b3", "b4"], point
        assert store.pending().count() == 0 and set(shown) == set(_keys(store.rows())), point
        assert store.recover() == [] and _keys(store.notifications()) == _keys(store.rows()), point


def test_a_send_that_raises_leaves_its_rows_to_the_next_run(spark, tmp_dir):
    import pytest
    store = Store(spark, os.path.join(tmp_dir, "s"))

    def crash(*_):
        raise RuntimeError("no network")

    batch = _rows(spark, [(i, f"a{i}", "remoteok") for i in range(5)])
    with pytest.raises(RuntimeError):
        store.run(batch, 0, 3, crash)
    assert store.pending().count() == store.pending_by_full_scan().count() == 5
    rep = store.run(batch, 1, 3, lambda *_: True)
    assert (rep.retried, rep.retry_sent, rep.inserted) == (5, True, 0) and _keys(store.pending()) == ["a3", "a4"]


def test_a_replay_of_a_broken_run_gives_the_tables_of_a_whole_one(spark, tmp_dir, monkeypatch):
    whole, broken = (Store(spark, os.path.join(tmp_dir, n)) for n in ("whole", "broken"))
    first, batch = (_rows(spark, [(i, f"{n}{i}", "remoteok") for i in range(4)]) for n in "ab")
    for store in (whole, broken):
        store.run(first, 0, 3, lambda *_: True)
    with _break(monkeypatch, broken, ("after", "keys")):
        broken.run(batch, 1, 3, lambda *_: True)
    for store in (whole, broken):
        store.run(batch, 1, 3, lambda *_: True)
    assert _keys(whole.rows()) == _keys(broken.rows()) and _keys(whole.notifications()) == _keys(broken.notifications())
    assert whole.open_runs() == broken.open_runs()


def test_key_segments_are_merged_in_levels(spark, tmp_dir, monkeypatch):
    """Thirty runs: few segments are read, and a batch finds what a scan of all rows finds."""
    from feedline.plans import key_index, run_log
    monkeypatch.setattr(key_index, "FANOUT", 3)
    for module in (key_index, run_log):
        monkeypatch.setattr(module, "KEEP", 2)
    monkeypatch.setattr(run_log, "FOLD", 5)
    store = Store(spark, os.path.join(tmp_dir, "s"))
    results = itertools.cycle([True, False, True, True, False])
    for run in range(30):
        store.run(_rows(spark, [(i, f"r{run}-{i}" if i else "shared", "remoteok") for i in range(4)]), run, 2, lambda *_: next(results))
    runs = store.log.runs()
    segments = store.index.segments(runs, 30)
    assert len(segments) <= 3 + 3 * 3 and max(s.level for s in segments) >= 2
    assert sum(s.rows for s in segments) == store.rows().count() == 30 * 3 + 1
    assert _keys(store.index.keys(runs, 30)) == _keys(store.rows())
    assert len(store.index.keys(runs, 30).inputFiles()) <= len(segments)
    batch = _rows(spark, [(i, k, "x") for i, k in enumerate(["shared", "r3-1", "r17-2", "r29-3", "new"])])
    for rows in (5, key_index.FEW + 1):  # by value, and by join
        assert _keys(store.index.new_rows(batch, rows, runs, 30)) == ["new"]
    # ledgers were folded, and say what the full history says
    assert runs.folded >= 10 and _keys(store.pending()) == _keys(store.pending_by_full_scan())
    import pytest
    with pytest.raises(ValueError):
        store.run(batch, 3, 2, lambda *_: True)
    again = Store(spark, os.path.join(tmp_dir, "s"))
    assert again.run(batch, 30, 50, lambda *_: True).inserted == 1 and again.open_runs() == {}


def test_few_keys_are_pushed_to_the_files(spark, tmp_dir):
    store = Store(spark, os.path.join(tmp_dir, "s"))
    store.run(_rows(spark, [(i, f"{i:02x}rest", "remoteok") for i in range(64)]), 0, 2, lambda *_: True)
    plan = store.index.new_rows(_rows(spark, [(0, "0arest", "x"), (1, "zz", "x")]), 2, store.log.runs(), 1)._jdf.queryExecution().executedPlan().toString()
    assert "In(fingerprint" in plan
    assert set(store.rows().columns) == {*SCHEMA.replace(",", "").split()[::2], "created_at", "run_id"}


def test_later_columns_are_kept_and_old_rows_read_null(spark, tmp_dir):
    import pytest
    store = Store(spark, os.path.join(tmp_dir, "s"))
    first = _rows(spark, [(1, "a", "remoteok")]).withColumn("score", F.lit(3))
    store.run(first, 0, 5, lambda *_: True)
    store.run(_rows(spark, [(1, "b", "remoteok")]).withColumn("board", F.lit("x")), 1, 5, lambda *_: True)
    store.run(_rows(spark, [(1, "c", "remoteok")]).withColumns({"score": F.lit(1 << 40), "board": F.lit("y")}), 2, 5, lambda *_: True)
    got = {r["fingerprint"]: (r["score"], r["board"]) for r in store.rows().collect()}
    assert got == {"a": (3, None), "b": (None, "x"), "c": (1 << 40, "y")}
    assert store.rows().schema["score"].dataType.simpleString() == "bigint" and store.schemas.latest() == 2
    with pytest.raises(ValueError):
        store.run(_rows(spark, [(1, "d", "remoteok")]).withColumn("board", F.lit(True)), 3, 5, lambda *_: True)


def test_store_pending_skips_unreadable_rows(spark, tmp_dir):
    store = Store(spark, os.path.join(tmp_dir, "s"))
    bad = _rows(spark, [(0, "a", "retired_board"), (1, "b", "remoteok")])
    store.run(bad, 0, 5, lambda *_: False)
    assert _keys(store.pending()) == ["b"]
    assert store.rows().filter(F.col("run_id") == 0).count() == 2


def test_postings_run_over_landed_feeds(spark, tmp_dir):
    import datetime as dt
    import json

    from feedline.params import PostingParams
    from feedline.plans.postings_flow import run_postings
    os.makedirs(os.path.join(tmp_dir, "land", "remotive"))
    jobs = [{"title": "Python Dev", "company_name": "A", "url": "https://r/1"},
            {"title": "Chef", "company_name": "B", "url": "https://r/2"},
            {"title": "python dev", "company_name": "a", "url": "https://R/1"}]  # same fingerprint
    with open(os.path.join(tmp_dir, "land", "remotive", "page-1.json"), "w") as f:
        json.dump({"jobs": jobs}, f)
    params = PostingParams(keywords=("python",), max_years=None, max_age_days=30, blacklist=None,
                           allowed_languages=None, as_of=dt.datetime(2024, 1, 31), enabled_feeds=("remotive",))
    store = Store(spark, os.path.join(tmp_dir, "state"))
    rep, failed, funnel = run_postings(spark, os.path.join(tmp_dir, "land"), store, 0, params, lambda *_: True)
    assert failed == {} and rep.inserted == 1 and rep.sent
    assert funnel["n_total"] == 3 and funnel["n_relevant"] == 2 and funnel["n_recent"] == 2
    assert store.rows().first()["title"] == "python dev"  # last values win within the batch
    rep, _, _ = run_postings(spark, os.path.join(tmp_dir, "land"), store, 1, params, lambda *_: True)
    assert rep.inserted == 0  # a second run over the same feeds inserts nothing


def test_pending_by_ledger_equals_full_history_scan(spark, tmp_dir):
    store = Store(spark, os.path.join(tmp_dir, "snap"))
    results = iter([True, False, True, False, True, True, True, True])

    def batch(run):
        return _rows(spark, [(i, f"r{run}-{i}" if i % 4 else f"shared-{i}", "remoteok") for i in range(13)])

    for run in range(4):
        store.run(batch(run), run, 5, lambda *_: next(results))
        assert _keys(store.pending()) == _keys(store.pending_by_full_scan())
        assert sum(store.open_runs().values()) == store.pending().count()
    # a replay of the last run reproduces the same state
    store.run(batch(3), 3, 5, lambda *_: True)
    assert _keys(store.pending()) == _keys(store.pending_by_full_scan())


def test_new_by_aggregation_equals_dedup_then_anti_join(spark):
    from feedline.operators.dedup import new_last_value_first_position
    rows = [(1, "a", 0, "x"), (2, "b", 1, "y"), (3, "b", 1, "z"), (4, "a", 1, "w"), (5, "c", 1, "v"),
            (6, "c", 2, "u")]
    df = spark.createDataFrame(rows, "seq long, fingerprint string, run_no long, source string")
    got = {r["fingerprint"]: (r["seq"], r["source"]) for r in new_last_value_first_position(df, 1).collect()}
    batch = dedup_last_value_first_position(df.filter(F.col("run_no") == 1).drop("run_no"))
    want = {r["fingerprint"]: (r["seq"], r["source"])
            for r in new_rows(batch, df.filter(F.col("run_no") < 1)).collect()}
    assert got == want == {"b": (2, "z"), "c": (5, "v")}


def test_language_list_without_a_profile_is_an_error(spark):
    import pytest

    from feedline.operators.predicates import posting_filter
    from feedline.params import PostingParams
    with pytest.raises(ValueError):
        posting_filter(_rows(spark, [(0, "a", "remoteok")]), PostingParams())
