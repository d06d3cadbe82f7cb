"""State with timers: restarts, late rows, and keys that are forgotten."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from larder.streaming import streams as X

DAY = datetime(2030, 1, 1)
LOG = "key long, ts timestamp, seq long, outcome string"


def run(spark, source, checkpoint, shape, mode, out):
    """What a query emits over the files that are there now, going on from its checkpoint."""
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)
    query = shape(stream).writeStream.foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def put(spark, folder, n, rows):
    at = lambda hours: DAY + timedelta(hours=hours)
    spark.createDataFrame([(k, at(h), s, o) for k, h, s, o in rows], LOG).coalesce(1).write.mode("append").parquet(f"{folder}/part={n}")


BATCHES = [
    [(1, 0, 1, "failure"), (1, 0, 2, "failure"), (2, 0, 1, "success"), (3, 1, 1, "failure")],
    [(1, 5, 3, "failure"), (2, 6, 2, "failure"), (4, 30, 1, "success")],
    [(1, 2, 4, "success"), (3, 29.5, 2, "requeue"), (5, 31, 1, "failure")],  # the first is later than an hour
    [(4, 200, 2, "failure"), (2, 210, 3, "failure")],
]


@pytest.mark.parametrize("restarts", [False, True])
def test_fold_after_restarts_and_with_late_rows(spark, tmp_path, restarts):
    source, out = str(tmp_path / "in"), []
    for n, rows in enumerate(BATCHES):
        put(spark, source, n, rows)
        if restarts:
            run(spark, source, str(tmp_path / "c"), lambda s: X.fold_attempts_stream(s, "1 hour", "100 hours"), "update", out)
    if not restarts:
        run(spark, source, str(tmp_path / "c"), lambda s: X.fold_attempts_stream(s, "1 hour", "100 hours"), "update", out)
    last = {}
    for key, state, attempts, seen in out:
        last.setdefault(key, []).append((state, attempts, seen))
    if restarts:  # files in order: the late row is dropped, and what was silent for 100 hours begins anew
        assert last[1] == [("pending", 2, 2), ("failed", 3, 3)]
        assert last[3] == [("pending", 1, 1), ("pending", 0, 2)]
        assert last[4] == [("done", 0, 1), ("pending", 1, 1)] or last[4] == [("done", 0, 1), ("pending", 1, 2)]
    assert last[5][-1] == ("pending", 1, 1)


def test_absent_after_restarts(spark, tmp_path):
    source, out = str(tmp_path / "in"), []
    shape = lambda s: X.absent_stream(s.select("key", "ts"), "20 hours", "1 hour")
    for n, rows in enumerate(BATCHES):
        put(spark, source, n, rows)
        run(spark, source, str(tmp_path / "c"), shape, "append", out)
    got = {}
    for key, seen in out:
        got.setdefault(key, []).append(int((seen - DAY).total_seconds() // 3600))
    assert got[1] == [5] and got[2] == [6] and got[3][-1] == 29 and got[5] == [31] and 4 not in got  # 4 came back before the watermark passed
    assert all(len(x) == 1 for k, x in got.items() if k != 3)


def test_one_run_gives_the_rows_of_many(spark, tmp_path):
    """The keys that are absent in the end do not hang on how the input was cut."""
    a, b, many = str(tmp_path / "a"), str(tmp_path / "b"), []
    shape = lambda s: X.absent_stream(s.select("key", "ts"), "20 hours", "200 hours")
    for n, rows in enumerate(BATCHES):
        put(spark, a, n, rows)
        put(spark, b, 0, rows)
        run(spark, a, str(tmp_path / "ca"), shape, "append", many)
    one = run(spark, b, str(tmp_path / "cb"), shape, "append", [])
    assert sorted(many) == sorted(one)
    assert spark.range(1).select(F.lit(1)).count() == 1
