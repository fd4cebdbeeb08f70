"""The change feed, sessions and locks as running streams over a folder of Parquet files."""

from __future__ import annotations

import datetime as dt

from corvid.streaming import changes


def run(stream, tmp_path, mode):
    rows = []
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda df, k: rows.append(df.collect())).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return rows


def files(spark, folder, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/b{k}")
    return changes.event_stream(spark, f"{folder}/b*", spark.createDataFrame([], schema).schema)


def test_latest_versions(spark, tmp_path):
    batches = [[("a", 1, "created", 1), ("b", 2, "created", 1)], [("a", 3, "modified", 2)], [("b", 4, "deleted", 0), ("c", 5, "created", 9)]]
    got = run(changes.latest_versions(files(spark, tmp_path / "in", batches, "path string, seq long, op string, size long")), tmp_path, "complete")
    last = {r["path"]: (r["seq"], r["op"], r["size"]) for r in got[-1]}
    assert last == {"a": (3, "modified", 2), "b": (4, "deleted", 0), "c": (5, "created", 9)}


def test_lock_stream_grants_as_the_batch_does(spark, tmp_path):
    asked = [[("p", "x", 1000.0), ("p", "y", 1005.0)], [("p", "y", 1020.0), ("p", "x", 1021.0), ("q", "z", 1021.0)], [("p", "x", 1031.0)], [("r", "w", 90_000.0)], [("p", "y", 90_001.0)]]
    schema = "path string, agent string, at double"
    stream = changes.lock_grants(files(spark, tmp_path / "in", asked, schema), 10.0)
    got = sorted(tuple(r) for part in run(stream, tmp_path, "append") for r in part)
    batch = changes.lock_grants(spark.createDataFrame([r for b in asked for r in b], schema), 10.0)
    assert got == sorted(tuple(r) for r in batch.collect())
    assert [g for p, _, _, g in sorted(got, key=lambda r: r[2]) if p == "p"] == [True, False, True, False, True, True]


def test_sessions_close(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    batches = [[("x", t(0)), ("x", t(10)), ("y", t(5))], [("x", t(100))], [("y", t(600))], [("y", t(601))]]
    stream = changes.sessions(files(spark, tmp_path / "in", batches, "agent string, ts timestamp"))
    got = sorted((r["agent"], r["first"], r["last"], r["beats"]) for part in run(stream, tmp_path, "append") for r in part)
    assert got == [("x", t(0), t(10), 2), ("x", t(100), t(100), 1), ("y", t(5), t(5), 1)]
