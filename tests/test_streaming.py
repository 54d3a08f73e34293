from siltstone.sources.store import Store
from siltstone.streaming import snapshots

SCHEMA = "project string, snapshot_id string, path string, hash string, size long, lines long"


def test_snapshots_of_a_stream_are_compared(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    states = [{"a": "1", "b": "1"}, {"a": "2", "c": "1"}]
    for i, state in enumerate(states):
        rows = [("p", f"s{i}", k, h, 1, 10) for k, h in state.items()]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        snapshots.watch(stream, store, out, cp).awaitTermination()
    got = {(r.snapshot_id, r.path, r.change_type) for r in spark.read.parquet(out).collect()}
    assert got == {("s1", "a", "modified"), ("s1", "b", "deleted"), ("s1", "c", "created")}
    assert store.latest("p") == "s1"


def test_a_batch_that_runs_again_gives_the_same(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    first = spark.createDataFrame([("p", "s0", "a", "1", 1, 10), ("q", "s0", "x", "1", 1, 1)], SCHEMA)
    assert snapshots.compared(first, store).collect() == []
    store.save_snapshots(first, first.selectExpr("project", "snapshot_id", "timestamp'2025-01-01' as taken_at", "string(null) as doc_id").distinct())
    rows = [("p", "s1", "a", "2", 1, 10), ("p", "s2", "a", "2", 1, 10), ("p", "s2", "b", "1", 1, 10), ("q", "s1", "y", "1", 1, 1)]
    batch = spark.createDataFrame(rows, SCHEMA)
    want = {("p", "s1", "a", "modified"), ("p", "s2", "b", "created"), ("q", "s1", "x", "deleted"), ("q", "s1", "y", "created")}
    for _ in range(2):
        assert {tuple(r) for r in snapshots.compared(batch, store).select("project", "snapshot_id", "path", "change_type").collect()} == want
        # The run fails after it has saved its snapshots.
        store.save_snapshots(batch, batch.selectExpr("project", "snapshot_id", "timestamp'2025-01-02' as taken_at", "string(null) as doc_id").distinct())


def test_triggers():
    assert snapshots.trigger("time_interval", 7) == {"processingTime": "7 minutes"}
    assert snapshots.trigger("manual") == {"availableNow": True}
