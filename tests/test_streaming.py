"""The online score is the batch score."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import series
from tidemark.streaming import online


def test_state_carries_over_batches():
    x = np.random.default_rng(0).normal(size=200)
    rows = pd.DataFrame({"ts": pd.date_range("2020-01-01", periods=200), "value": x})
    whole, _ = online.advance(rows, ([], 0, 0, 0.0, 0.0, False), 20, 60, 1.0)
    parts, state = [], ([], 0, 0, 0.0, 0.0, False)
    for i in range(0, 200, 37):
        out, state = online.advance(rows[i : i + 37], state, 20, 60, 1.0)
        parts += out
    assert parts == whole and sum(r[4] for r in whole) > 0


def test_online_equals_batch(spark):
    x = np.random.default_rng(1).normal(size=150)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "series_id string, pos long, value double").withColumn("channel", F.lit("c"))
    batch = series.causal_zscore(df).orderBy("pos").toPandas()["z"]
    rows = pd.DataFrame({"ts": pd.date_range("2020-01-01", periods=150), "value": x})
    live = [r[2] for r in online.advance(rows, ([], 0, 0, 0.0, 0.0, False), 20, 60, 9.0)[0]]
    assert np.allclose(np.array(live, float)[60:], batch[60:].astype(float)) and all(v is None for v in live[:60])


def test_stream_of_bars(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rng = np.random.default_rng(2)
    rows = [("a" if i % 2 else "b", start + dt.timedelta(minutes=30 * i), float(rng.normal())) for i in range(300)]
    spark.createDataFrame(rows, "event_type string, ts timestamp, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_type string, ts timestamp, value double").parquet(str(tmp_path / "in"))
    bars = online.hourly_bars(stream)
    q = bars.writeStream.format("memory").queryName("bars").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    assert spark.table("bars").count() > 200
    plain = spark.readStream.schema("event_type string, ts timestamp, value double").parquet(str(tmp_path / "in")).withColumnRenamed("event_type", "series_id")
    q = online.online_scores(plain, 1.0, 5, 20).writeStream.format("memory").queryName("scores").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    s = spark.table("scores")
    assert s.count() == 300 and s.where("z is not null").count() > 200 and s.where("alarm").count() > 0
