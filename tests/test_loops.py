"""Paged scans, the polling loop and swept state."""

import glob
import time

import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from waymark.sources.paged import PagedReader, Pages, ShortPage, read_pages
from waymark.streaming import poll, rate, sweep

FOLDER = "/root/testdata/sf0.001"


def part_pages(cut_at=None):
    """(page, total) over the part table, as an interface would give it; one page short if asked for."""

    def rows():
        return pq.read_table(f"{FOLDER}/part.parquet", columns=["p_partkey", "p_name", "p_size"]).sort_by("p_partkey")

    def page(offset, limit):
        found = rows().slice(offset, limit - (1 if offset == cut_at else 0))
        return [tuple(r.values()) for r in found.to_pylist()]

    return page, lambda: rows().num_rows


@pytest.mark.parametrize("size", [7, 100, 200, 1000])
def test_pages_equal_the_table(spark, size):
    page, total = part_pages()
    found = read_pages(spark, page, total, "p_partkey long, p_name string, p_size int", size, 3)
    whole = spark.read.parquet(f"{FOLDER}/part.parquet").select("p_partkey", "p_name", "p_size")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))


def test_pages_are_planned_over_tasks_and_an_empty_table_has_none(spark):
    page, total = part_pages()
    plan = PagedReader(page, total, 30, 2).partitions()
    assert [p.offsets for p in plan] == [[0, 30], [60, 90], [120, 150], [180]]
    assert read_pages(spark, lambda offset, limit: [], lambda: 0, "a int").collect() == []


def test_a_short_page_fails_the_scan(spark):
    page, total = part_pages(cut_at=50)
    with pytest.raises(ShortPage):
        list(PagedReader(page, total, 50, 1).read(Pages([50])))
    with pytest.raises(Exception, match="49 rows at 50, 50 planned"):
        read_pages(spark, page, total, "p_partkey long, p_name string, p_size int", 50).collect()


@pytest.fixture
def folders(tmp_path):
    (tmp_path / "in").mkdir()
    return {k: str(tmp_path / k) for k in ("in", "work", "state", "copy")}


def put(folders, k, ids):
    pd.DataFrame({"id": ids, "v": [i * 10 + k for i in ids]}).to_parquet(f"{folders['in']}/{k}.parquet")


def test_a_failing_stage_stops_no_other_and_a_replay_doubles_nothing(spark, folders):
    broken = {"on": True}

    def flaky(batch):
        if broken["on"]:
            raise RuntimeError("no answer")
        return batch.withColumn("seen", F.lit(True))

    stages = {"flaky": flaky, "sums": lambda b: b.withColumn("w", F.col("v") + 1)}
    source = lambda: spark.readStream.schema("id long, v long").option("maxFilesPerTrigger", 1).parquet(folders["in"])
    put(folders, 1, [1, 2, 3])
    put(folders, 2, [3, 4])
    poll.polling_loop(source(), stages, folders["work"], folders["state"], None).awaitTermination()
    notes = {(r["batch"], r["stage"]): r["ok"] for r in poll.ledger(spark, folders["work"]).collect()}
    assert notes == {(0, "flaky"): False, (0, "sums"): True, (1, "flaky"): False, (1, "sums"): True}
    sums = sorted(map(tuple, poll.latest(spark, folders["work"], "sums", ["id"]).collect()))
    assert [r[0] for r in sums] == [1, 2, 3, 4]
    # the same batch again, as after a crash before its commit
    again = spark.read.parquet(f"{folders['in']}/1.parquet")
    assert [n[2] for n in poll.run_cycle(again, 0, stages, folders["work"])] == [False, True]
    assert sorted(map(tuple, poll.latest(spark, folders["work"], "sums", ["id"]).collect())) == sums
    assert spark.read.parquet(f"{folders['work']}/out/sums").count() == 5
    broken["on"] = False
    assert all(ok for _, _, ok, _ in poll.retry_failed(spark, stages, folders["work"]))
    assert poll.latest(spark, folders["work"], "flaky", ["id"]).count() == 4
    assert poll.ledger(spark, folders["work"]).filter("not ok").count() == 0


def test_swept_state_gives_the_verdicts_of_the_batch_and_forgets_idle_keys(spark, folders):
    limits = [(2, 1_000_000, "second"), (3, 4_000_000, "span")]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sweep.STATE_STORE)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        start = pd.Timestamp("2024-01-01")
        rows = [(f"k{n % 3}", n, start + pd.Timedelta(milliseconds=150 * n)) for n in range(40)]
        all_ = pd.DataFrame(rows, columns=["key", "id", "ts"])
        source = spark.readStream.schema("key string, id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folders["in"])
        write = lambda frame, name: frame.astype({"ts": "datetime64[us]"}).to_parquet(f"{folders['in']}/{name}.parquet")
        write(all_.iloc[:20], "a")
        write(all_.iloc[20:], "b")
        query = sweep.swept_admission(source, limits, idle_ms=30_000).writeStream.foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(f"{folders['work']}/{k}")).option("checkpointLocation", folders["state"]).trigger(processingTime="500 milliseconds").start()
        keys = lambda: {r[0] for r in spark.read.format("statestore").option("path", folders["state"]).option("stateVarName", "log").load().select("key.key").collect()}

        def until(holds):  # timers keep the query busy, so that processAllAvailable() would not return
            end = time.time() + 90
            while not holds() and time.time() < end:
                time.sleep(0.5)
            assert holds()

        def verdicts(n):
            done = glob.glob(f"{folders['work']}/*/_SUCCESS")
            return bool(done) and spark.read.parquet(*(f.rsplit("/", 1)[0] for f in done)).count() == n

        until(lambda: verdicts(40))
        assert keys() == {"k0", "k1", "k2"}
        until(lambda: not keys())
        query.stop()
        seen = spark.read.parquet(f"{folders['work']}/*").select("id", "admitted", "scope", "retry_after_ms")
        batch = rate.admission(spark.createDataFrame(all_), limits).select("id", "admitted", "scope", "retry_after_ms")
        assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, batch.collect()))
        assert {r["admitted"] for r in batch.collect()} == {True, False}
    finally:
        for running in spark.streams.active:
            running.stop()
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
