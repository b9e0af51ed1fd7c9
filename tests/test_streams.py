"""Streams give what the same operators give on tables."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.operators import gates
from tesserae.session import table
from tesserae.streaming import streams


def stream(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_latest_states(spark, data, tmp_path):
    rows = table(spark, data, "events")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    q = streams.latest_states(stream(spark, str(tmp_path / "in")), ["user_id"], "event_type", "ts", "event_id").writeStream.outputMode("complete").format("memory").queryName("latest").start()
    q.processAllAvailable()
    q.stop()
    want = streams.latest_states(rows, ["user_id"], "event_type", "ts", "event_id")
    assert sorted(map(tuple, spark.table("latest").collect())) == sorted(map(tuple, want.collect()))


def test_save_bursts(spark, tmp_path):
    log = [("k", 0, "a"), ("k", 10, "b"), ("k", 21, "c"), ("k", 1000, "d")]
    df = spark.createDataFrame(log, "key string, s long, state string").select("key", F.timestamp_seconds("s").alias("ts"), "state")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = streams.save_bursts(stream(spark, str(tmp_path / "in")), "key", "ts", "state").writeStream.outputMode("append").format("memory").queryName("bursts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["state"], r["n_saves"]) for r in spark.table("bursts").collect()) == [("b", 2), ("c", 1)]


def test_gated(spark, data, tmp_path):
    table(spark, data, "orders").write.parquet(str(tmp_path / "in"))
    seen = []
    source = stream(spark, str(tmp_path / "in"))
    q = streams.gated(source, lambda b: gates.duplicate_keys(b, ["o_orderkey"]), "keys", lambda b, i: seen.append(b.count())).start()
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == table(spark, data, "orders").count()
    q = streams.gated(source, lambda b: gates.duplicate_keys(b, ["o_orderstatus"]), "keys", lambda b, i: None).start()
    with pytest.raises(Exception, match="keys"):
        q.processAllAvailable()


@pytest.fixture
def state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, streams.STATE_STORE)
    yield
    spark.conf.set(name, before)


def test_debounced_over_restarts(spark, tmp_path, state_store):
    rng = random.Random(3)
    log, n = [], 0
    for key in ("a", "b", None):
        at = 1_000_000
        for _ in range(60):
            at += rng.choice([0, 3_000, 10_000, 10_001, 11_000, 40_000])
            n += 1
            log.append((key, at, n, rng.choice(["x", "y", None]), rng.choice(["save", "save", "save", "checkpoint"])))
    schema = "key string, ms long, n long, state string, kind string"
    rows = spark.createDataFrame(log, schema).select("key", F.timestamp_millis("ms").alias("ts"), "n", "state", "kind")
    want = streams.debounced(rows, "key", "ts", "state", "kind", "n")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    log.sort(key=lambda r: r[1] + rng.randrange(-20_000, 20_000))  # out of order within the watermark
    parts = [log[k : k + 37] for k in range(0, len(log), 37)] + [[("end", 10**10, n + 1, "z", "save")]]
    for part in parts:  # each part is a run of the query of its own, from the checkpoint
        spark.createDataFrame(part, schema).select("key", F.timestamp_millis("ms").alias("ts"), "n", "state", "kind").coalesce(1).write.mode("append").parquet(source)
        q = streams.debounced(stream(spark, source), "key", "ts", "state", "kind", "n").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out)
        q.awaitTermination()
    got = spark.read.parquet(out).filter("key IS NULL OR key != 'end'")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert 0 < want.count() < len(log)


class _Kept:
    """State of one key, kept in the test."""

    def __init__(self):
        self.rows, self.timers = [], []

    def getListState(self, name, schema):  # noqa: N802
        return self

    def getValueState(self, name, schema):  # noqa: N802
        return _Value()

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def appendList(self, rows):  # noqa: N802
        self.rows += rows

    def put(self, rows):
        self.rows = list(rows)

    def get(self):
        return iter(self.rows)

    def clear(self):
        self.rows = []

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.watermark


class _Value:
    now = None

    def exists(self):
        return self.now is not None

    def get(self):
        return self.now

    def update(self, row):
        self.now = row

    def clear(self):
        self.now = None


def test_a_key_has_one_timer_for_its_waiting_rows():
    kept, text = _Kept(), T.StringType()
    judge = streams._Debounce(text, T.LongType(), text, text, 1_000_000, "save")
    judge.init(kept)
    frame = pd.DataFrame({"k": "a", "ts": 0, "us": [1_000 * k + 1 for k in range(500)], "n": range(500), "s": [str(k) for k in range(500)], "d": "checkpoint"})
    list(judge.handleInputRows(("a",), iter([frame.sample(frac=1, random_state=1)]), kept))
    assert kept.timers == [1]
    out = []
    for kept.watermark in (1, 200, 500):
        out += [n for f in judge.handleExpiredTimer(("a",), kept, None) for n in f["_tie"]]
    assert out == list(range(500)) and kept.timers == [1, 2, 201] and not kept.rows
