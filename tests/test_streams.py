"""Streams over several micro-batches, restarts, and agreement with the batch operators."""

import pytest
from pyspark.sql import functions as F

from rillwatch.core import col
from rillwatch.errors import DataError
from rillwatch.operators import limits
from rillwatch.streaming import carried, flushing, jobs, readers, stateful

SCHEMA = "event_id long, ts timestamp, source string"


def write_batches(spark, path, batches):
    """One file per batch, in event-time order and written one after the other."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "event_id long, t long, source string").select("event_id", F.timestamp_seconds("t").alias("ts"), "source")
        df.coalesce(1).write.mode("append").parquet(path)


ROWS = [(i, 1_700_000_000 + i * 3, "hot" if i % 3 else f"s{i % 5}") for i in range(400)]
BATCHES = [ROWS[:150], ROWS[150:280], ROWS[280:]]


@pytest.fixture
def folder(spark, tmp_path):
    write_batches(spark, str(tmp_path / "in"), BATCHES)
    return tmp_path


def run(spark, stream, folder, name):
    jobs.start(stream, jobs.append_table(str(folder / name)), str(folder / f"{name}-progress")).awaitTermination()
    return jobs.read_runs(spark, str(folder / name))


def test_cool_down_over_batches(spark, folder):
    stream = readers.stream_parquet(spark, str(folder / "in"), SCHEMA, 1)
    got = run(spark, stateful.cool_down_stream(stream, "source", "ts", "event_id", 10), folder, "cooled")
    batch = limits.cool_down(spark.read.parquet(str(folder / "in")), "source", "ts", "event_id", 10)
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in batch.collect())


def test_minute_limit_over_batches(spark, folder):
    stream = readers.stream_parquet(spark, str(folder / "in"), SCHEMA, 1)
    got = run(spark, stateful.per_minute_limit_stream(stream, "ts", "event_id", 7), folder, "limited")
    batch = limits.per_minute_limit(spark.read.parquet(str(folder / "in")), "ts", "event_id", 7)
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in batch.collect())


def test_restart_reads_only_new_files(spark, folder):
    stream = lambda: readers.stream_parquet(spark, str(folder / "in"), SCHEMA, 1)
    assert run(spark, stream(), folder, "rows").count() == 400
    write_batches(spark, str(folder / "in"), [[(1000, 1_700_005_000, "new")]])
    assert run(spark, stream(), folder, "rows").count() == 401
    assert run(spark, stream(), folder, "rows").count() == 401


def test_formats_and_unknown_pattern(spark):
    with pytest.raises(DataError):
        readers.watch_folder(spark, "/tmp", "a long", "*.xml")


def test_unknown_handler_is_recorded(spark, folder):
    stream = readers.stream_parquet(spark, str(folder / "in"), SCHEMA)
    out = str(folder / "outcomes")
    jobs.start(stream, jobs.dispatcher({}, out, "absent"), str(folder / "p1")).awaitTermination()
    row = spark.read.parquet(out).first()
    assert not row.success and "not found" in row.error
    assert spark.read.parquet(out).select(col("handler")).first()[0] == "absent"


def run_carried(spark, folder, step, state, name):
    stream = readers.stream_parquet(spark, str(folder / "in"), SCHEMA, 1)
    out = str(folder / name)
    handler = carried.carried(step, state, str(folder / f"{name}-state"), out)
    jobs.start(stream, handler, str(folder / f"{name}-progress")).awaitTermination()
    return handler, jobs.read_runs(spark, out)


def test_limits_carried_over_batches(spark, folder):
    """Each equals the batch operator over all rows; a batch that is run again changes nothing; a restart goes on from the state."""
    every = lambda: spark.read.schema(SCHEMA).parquet(str(folder / "in"))
    steps = {
        "cooled": (carried.cool_down_step("source", "ts", "event_id", 40), carried.COOL_DOWN_STATE,
                   lambda df: limits.cool_down(df, "source", "ts", "event_id", 40)),
        "minutes": (carried.anchored_minute_step("ts", "event_id", 7, 60), carried.MINUTE_STATE,
                    lambda df: limits.anchored_minute_limit(df, "ts", "event_id", 7, 60)),
        "all": (carried.sliding_limit_step("ts", "event_id", 5, 60), "t long, n long", lambda df: limits.action_limit(df, "ts", "event_id", 5, 60)),
        "each": (carried.sliding_limit_step("ts", "event_id", 3, 60, ["source"]), "source string, t long, n long",
                 lambda df: limits.action_limit(df, "ts", "event_id", 3, 60, ["source"]))}
    ids = lambda df: sorted(r.event_id for r in (df.filter("executed") if "executed" in df.columns else df).collect())
    for name, (step, state, whole) in steps.items():
        handler, got = run_carried(spark, folder, step, state, name)
        assert ids(got) == ids(whole(every())), name
        again = spark.createDataFrame(BATCHES[2], "event_id long, t long, source string").select("event_id", F.timestamp_seconds("t").alias("ts"), "source")
        handler(again, 2)
        assert ids(jobs.read_runs(spark, str(folder / name))) == ids(whole(every())), name
        assert spark.read.parquet(str(folder / f"{name}-state/after=2")).count() <= 40
    write_batches(spark, str(folder / "in"), [[(1000 + k, 1_700_001_200 + k, "hot") for k in range(50)]])
    for name, (step, state, whole) in steps.items():
        assert ids(run_carried(spark, folder, step, state, name)[1]) == ids(whole(every())), name


def test_late_rows(spark, folder):
    write_batches(spark, str(folder / "in"), [[(900, 1_700_001_100, "hot"), (901, 1_700_001_202, None), (902, 1_700_001_210, None)]])
    _, cooled = run_carried(spark, folder, carried.cool_down_step("source", "ts", "event_id", 40), carried.COOL_DOWN_STATE, "cooled")
    assert [r.event_id for r in cooled.filter("event_id >= 900").collect()] == [901]  # 900 comes before what is decided
    _, judged = run_carried(spark, folder, carried.sliding_limit_step("ts", "event_id", 1000, 60), "t long, n long", "sliding")
    assert {r.event_id: r.executed for r in judged.filter("event_id >= 900").collect()} == {900: False, 901: True, 902: True}


def test_flush_by_size_and_by_age(spark, folder):
    """Full buffers leave at once, the rest when its time is over, each row once and in one batch; null keys share a buffer."""
    rows = spark.range(230).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "CASE WHEN id % 5 > 0 THEN concat('k', id % 2) END AS source")
    rows.coalesce(1).write.parquet(str(folder / "buffered"))
    stream = flushing.flushed(readers.stream_parquet(spark, str(folder / "buffered"), SCHEMA, 1), 50, 1.5, "source")
    query = jobs.start(stream, jobs.append_table(str(folder / "out")), str(folder / "progress"), "500 milliseconds")
    got = lambda: jobs.read_runs(spark, str(folder / "out"))
    assert jobs.run_until(query, lambda: query.lastProgress is not None and query.lastProgress["batchId"] > 0 and got().count() == 230, 120)
    found = {(r.source, r.flush, r.reason, r.flush_rows): r["count"] for r in got().groupBy("source", "flush", "reason", "flush_rows").count().collect()}
    assert found == {(None, 1, "age", 46): 46, ("k0", 1, "size", 50): 50, ("k0", 2, "age", 42): 42, ("k1", 1, "size", 50): 50, ("k1", 2, "age", 42): 42}
    assert got().select("event_id").distinct().count() == 230
    with pytest.raises(DataError):
        flushing.flushed(stream, 5, 1.0)  # its columns are there already
    with pytest.raises(DataError):
        flushing.flushed(readers.stream_parquet(spark, str(folder / "in"), SCHEMA, 1), 0, 1.0)


def test_model_store(spark, tmp_path):
    """Versions are complete when they are seen, keep the model that isn't given, and are loaded once."""
    import numpy as np

    from rillwatch.errors import ModelError
    from rillwatch.operators import bagging, forest, spread_forest
    from rillwatch.streaming.model_store import ModelStore

    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, float(a), float(b), "BENIGN" if a > 0 else "DoS Hulk") for i, (a, b) in enumerate(rng.normal(0, 1, (300, 2)))],
                               "id long, x double, y double, Label string")
    store = ModelStore(spark, str(tmp_path / "models"))
    with pytest.raises(ModelError):
        store.models(0)
    first = forest.fit(df, ["x", "y"], ["id"], trees=5)
    assert store.publish(first) == 1 and store.models(0)[1:] == (None, "v1")
    trained = bagging.train(df, ["x", "y"], "Label", ["id"], trees=5)
    assert store.publish(None, trained) == 2
    kept, classifier, version = store.models(1)
    assert version == "v2" and kept.nodes.equals(first.nodes) and classifier.stats == trained.stats
    assert store.models(2)[0] is kept  # not loaded again
    large = spread_forest.fit_spread(df, ["x", "y"], ["id"], 4, 300, 300, 2, False, 1)
    store.publish(large)
    again, classifier, version = ModelStore(spark, str(tmp_path / "models")).models(3)
    assert version == "v3" and again.score(df).exceptAll(large.score(df)).count() == 0 and classifier.classes == trained.classes
    (tmp_path / "models" / "v4").mkdir()  # half written: not published
    assert store.versions() == [1, 2, 3] and store.models(4)[2] == "v3"
