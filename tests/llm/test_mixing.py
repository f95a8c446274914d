import duckdb
import pytest
from pyspark.sql import functions as F

from feedline.llm.mixing import mix, mixed, targets
from feedline.llm.queries import QUERIES
from feedline.llm.sql import ORACLE

from .common import WORD, docs, odd_rows


def level(sizes, weights, most=3.0):
    """Targets by sharing the excess again until none is above its cap."""
    free, target, left = set(range(len(sizes))), [0.0] * len(sizes), float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / total
            return target
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
            free.remove(i)
    return target


@pytest.mark.parametrize("sizes", [[5], [0, 10], [100, 1, 1, 1, 1], [1, 1000, 3, 50, 0, 7, 7], [10] * 9, [1, 2, 4, 8, 16, 3000], [0, 0]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i:02d}" if i < len(sizes) - 1 else None, 1, s) for i, s in enumerate(sizes)], "source string, n long, source_size long")
    got = [r.target for r in targets(df, (5, 2, 1), 1.0, 3).orderBy("rank").collect()]
    assert got == pytest.approx(level(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))]))


def test_query_equals_sql_and_comes_near_the_targets(spark):
    base = "/root/testdata/sf0.01"
    got = QUERIES["op7_weighted_mixing"](spark, base).collect()
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{base}/documents.parquet')")
    assert sorted(map(tuple, got)) == sorted(con.sql(ORACLE["op7_weighted_mixing"]).fetchall())
    taken, largest = {}, {}
    for r in got:
        key = r.source_size, r.target
        taken[key] = taken.get(key, 0) + r.taken
        largest[key] = max(largest.get(key, 0), r.size)
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    assert all(abs(t - k[1]) <= largest[k] for k, t in taken.items())


def test_odd_rows(spark):
    rows = [(d, t, ["b", None, "a"][i % 3]) for i, (d, t) in enumerate(odd_rows())]
    df = docs(spark, rows)
    got = mix(df).collect()
    assert sorted(r.size for r in got) == sorted(len(WORD.findall(t or "")) for _, t, _ in rows)
    assert sum(r.taken for r in got) <= sum(r.size for r in got)
    again = mixed(df)
    assert again.columns == df.columns
    assert again.count() == sum(r.copies for r in got)
    assert sum(len(WORD.findall(r.text or "")) for r in again.collect()) == sum(r.taken for r in got)
    assert mix(df.limit(0)).count() == 0 and mixed(df.limit(0)).count() == 0


def test_ranges_do_not_change_the_mix(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    key = lambda d: sorted(map(tuple, d.select("doc_id", "copies").collect()))
    assert key(mix(df)) == key(mix(df, range_rows=7)) == key(mix(df.repartition(5).sort(F.desc("doc_id"))))


def test_only_dataframe_functions(spark):
    plan = mixed(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian"))
