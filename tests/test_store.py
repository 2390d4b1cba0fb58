"""The stored table: only touched partitions are rewritten, batches can be replayed, reads are pruned."""

from pathlib import Path

from pyspark.sql import functions as F

from tidemark.sources import read_bars, write_bars
from tidemark.sources.store import bars_between, refresh, upsert

SCHEMA = "symbol long, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def bars(spark, *rows):
    df = spark.createDataFrame([(s, t, c, c, c, c, v) for s, t, c, v in rows], SCHEMA.replace("timestamp_ntz", "string"))
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def files(folder: Path) -> dict[str, set[str]]:
    return {p.name: {f.name for f in p.glob("part-*")} for p in folder.glob("year=*")}


def held(spark, path):
    return {(r["symbol"], str(r["ts"])[:10]): (r["close"], r["volume"], r["batch"]) for r in spark.read.parquet(path).collect()}


def test_upsert_rewrites_only_what_changes_and_replays(spark, tmp_path):
    path = str(tmp_path / "store")
    first = bars(spark, *[(s, f"{y}-03-0{d}", 10.0 * s + d, 1.0) for s in (1, 2) for y in (2020, 2021, 2022) for d in range(1, 5)])
    assert upsert(spark, path, first, 1) == [2020, 2021, 2022]
    before = files(tmp_path / "store")
    second = bars(spark, (1, "2021-03-01", 99.0, 1.0), (1, "2021-03-01", 98.0, 7.0), (3, "2021-03-02", 5.0, None), (2, "2022-03-01", 21.0, 1.0), (None, "2020-01-01", 1.0, 1.0), (9, None, 1.0, 1.0))
    assert upsert(spark, path, second, 2) == [2021], "2022's row says what is there"
    after = files(tmp_path / "store")
    assert after["year=2020"] == before["year=2020"] and after["year=2022"] == before["year=2022"] and not after["year=2021"] & before["year=2021"]
    now = held(spark, path)
    assert now[1, "2021-03-01"] == (99.0, 1.0, 2) and now[3, "2021-03-02"] == (5.0, None, 2) and now[2, "2021-03-01"] == (21.0, 1.0, 1) and len(now) == 25
    for batch, rows in ((2, second), (1, first), (2, second)):
        assert upsert(spark, path, rows, batch) == [] and files(tmp_path / "store") == after, "a replay rewrites nothing"
    assert upsert(spark, path, second.where("symbol = 1"), 3, "volume") == [2021]
    assert held(spark, path)[1, "2021-03-01"] == (98.0, 7.0, 3), "the newest of a batch wins"
    assert upsert(spark, path, first.limit(0), 4) == []


def test_refresh_takes_what_is_after_the_last_bar(spark, tmp_path):
    path = str(tmp_path / "store")
    upsert(spark, path, bars(spark, (1, "2024-01-01", 1.0, 1.0), (1, "2024-01-02", 2.0, 1.0), (2, "2024-02-09", 3.0, 1.0)), 1)
    source = bars(spark, (1, "2024-01-02", 50.0, 1.0), (1, "2024-01-03", 4.0, 1.0), (2, "2024-02-10", 5.0, 1.0), (3, "2023-05-05", 6.0, 1.0))
    assert refresh(spark, path, source, 2, "2024-02-10") == [2023, 2024]
    assert held(spark, path) == {(1, "2024-01-01"): (1.0, 1.0, 1), (1, "2024-01-02"): (2.0, 1.0, 1), (1, "2024-01-03"): (4.0, 1.0, 2), (2, "2024-02-09"): (3.0, 1.0, 1), (3, "2023-05-05"): (6.0, 1.0, 2)}
    assert refresh(spark, str(tmp_path / "new"), source, 1, "2024-02-10") == [2023, 2024]


def test_reads_are_pruned_by_year(spark, tmp_path):
    rows = bars(spark, *[(1, f"{y}-06-01", float(y), 1.0) for y in range(2010, 2020)])
    write_bars(rows, str(tmp_path / "plain"))
    upsert(spark, str(tmp_path / "store"), rows, 1)
    for df in (read_bars(spark, str(tmp_path / "plain"), "2012-01-01", "2014-06-01"), bars_between(spark, str(tmp_path / "store"), "2012-01-01", "2014-06-01")):
        assert sorted(r["close"] for r in df.collect()) == [2012.0, 2013.0, 2014.0]
        assert len(df.inputFiles()) >= 3
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(year" in plan
