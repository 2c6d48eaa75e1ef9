"""Job states as a stream, with late and repeated events and timeouts, against what the events say in all."""

from datetime import datetime, timedelta

from faultline.streaming import jobs

T0 = datetime(2024, 1, 1, 12)
at = lambda m: T0 + timedelta(minutes=m)


def run(spark, tmp_path, batches):
    source = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, jobs.EVENTS).coalesce(1).write.mode("append").parquet(str(source))
        query = (
            jobs.states(spark.readStream.schema(jobs.EVENTS).parquet(str(source))).writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out")))
            .outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
        assert query.exception() is None
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_jobs(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        batches = [
            [("a", at(0), "PENDING"), ("a", at(2), "PARSING"), ("b", at(1), "PENDING"), ("c", at(1), "PENDING"), ("x", at(1), "NONSENSE")],
            # late and repeated: neither brings a back; b is done, and what comes later doesn't undo that
            [("a", at(1), "CLONING"), ("a", at(2), "PARSING"), ("b", at(5), "COMPLETED"), ("b", at(6), "FAILED"), ("d", at(9), "SCORING")],
            [("a", at(20), "SCORING"), ("d", at(21), "FAILED"), ("d", at(22), "COMPLETED")],
            # c has been silent for over half an hour by the watermark
            [("a", at(45), "COMPLETED"), ("e", at(50), "PENDING")],
            [("c", at(1), "COMPLETED"), ("e", at(60), "CLONING"), ("f", at(95), "PENDING")],
            [("f", at(140), "PENDING")],
            [("f", at(141), "CLONING")],
        ]
        rows = run(spark, tmp_path, batches)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    seen = {}
    for r in rows:
        seen.setdefault(r.job_id, []).append((r.status, r.progress, r.reason))
    assert sorted(seen["a"], key=lambda s: s[1]) == [("PARSING", 40, "event"), ("SCORING", 85, "event"), ("COMPLETED", 100, "event")]
    assert set(seen["b"]) == {("PENDING", 5, "event"), ("COMPLETED", 100, "event")}
    assert set(seen["d"]) == {("SCORING", 85, "event"), ("FAILED", 85, "event")}
    assert ("FAILED", 5, "timeout") in seen["c"] and ("FAILED", 15, "timeout") in seen["e"] and "x" not in seen
    # the same from all events at once; those of c behind the watermark are no part of it
    events = spark.createDataFrame([r for b in batches for r in b if not (r[0] == "c" and r[2] == "COMPLETED") and r[0] != "f"], jobs.EVENTS)
    final = {x.job_id: (x.status, x.progress, x.reason) for x in jobs.final_states(events).collect()}
    assert final == {j: max(s, key=lambda x: (x[0] in jobs.FINAL, x[1])) for j, s in seen.items() if j != "f"}


def test_final_states_by_hand(spark):
    rows = [("a", at(0), "PENDING"), ("a", at(31), "COMPLETED"), ("b", at(0), "PENDING"), ("b", at(30), "COMPLETED"), ("c", at(0), "FAILED"), ("d", at(0), "SCORING"), ("d", at(5), "CLONING"), ("e", at(3), "NOPE")]
    got = {x.job_id: (x.status, x.progress, x.reason) for x in jobs.final_states(spark.createDataFrame(rows, jobs.EVENTS)).collect()}
    assert got == {"a": ("FAILED", 5, "timeout"), "b": ("COMPLETED", 100, "event"), "c": ("FAILED", 0, "event"), "d": ("FAILED", 85, "timeout")}
