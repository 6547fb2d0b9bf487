"""A fold over a stream in event time, whose rows come out of order, against the batch."""

import datetime as dt
import random

import pytest

from driftline.operators import kalman
from driftline.streaming import filters


def test_a_shuffled_stream_gives_the_result_of_the_batch(spark, tmp_path):
    r = random.Random(3)
    zero = dt.datetime(2024, 1, 1)
    rows = [(k, zero + dt.timedelta(seconds=10 * t + k), r.gauss(0, 1)) for k in range(3) for t in range(40)]
    came = sorted(rows, key=lambda x: x[1].timestamp() + r.uniform(-60, 60))  # up to two minutes out of order
    schema = "series_id long, ts timestamp, y double"
    last = [(9, zero + dt.timedelta(days=1), 0.0)]
    for n, part in enumerate([came[:25], came[25:60], came[60:90], came[90:], last, last]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", filters.ROCKSDB)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        model = kalman.Scalar(a=0.9, q=0.5, r=1.0)
        got = filters.in_event_time(stream, "series_id", "ts", "3 minutes", *filters.local_level(model), ["y"])
        query = got.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert query.awaitTermination(300) and query.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    found = {(x["series_id"], x["ts"]): x for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    numbered = [(k, n, y, ts) for k in range(3) for n, (_, ts, y) in enumerate(sorted(x for x in rows if x[0] == k))]
    batch = kalman.scalar_filter(spark.createDataFrame([x[:3] for x in numbered], "series_id long, t int, y double"), model)
    want = {(x["series_id"], x["t"]): x for x in batch.collect()}
    assert {k for k, _ in found} <= {0, 1, 2, 9} and sum(k != 9 for k, _ in found) == len(rows)
    for k, n, _, ts in numbered:
        assert found[k, ts]["m"] == pytest.approx(want[k, n]["m"], abs=1e-9)
        assert found[k, ts]["ll"] == pytest.approx(want[k, n]["ll"], abs=1e-9)
