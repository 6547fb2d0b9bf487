"""Interpolation in stretches of time, without a key too."""

import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import preprocessing as prep


@pytest.mark.parametrize("kind", ["linear", "nearest"])
def test_stretches_without_a_key_as_one_window(spark, monkeypatch, kind):
    """Several levels of groups of stretches, empty stretches between samples, and rows beyond both ends."""
    monkeypatch.setattr(prep, "CELLS", 3)
    r = random.Random(1)
    times = sorted(r.sample(range(0, 3000, 2), 60))
    samples = spark.createDataFrame([(float(t), r.gauss(0, 1)) for t in times], "s double, y double")
    at = spark.createDataFrame([(float(t), k) for k, t in enumerate(range(-300, 3400, 37))], "s double, n int")
    got = prep.interpolate(samples, at, None, "s", "y", kind=kind, bucket=40.0)
    want = {x["n"]: x["y"] for x in prep.interpolate(samples, at, None, "s", "y", kind=kind).collect()}
    assert {x["n"]: x["y"] for x in got.collect()} == pytest.approx(want, abs=1e-12) and len(want) == at.count()
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    keyed = prep.interpolate(samples.withColumn("k", F.lit(1)), at.withColumn("k", F.lit(1)), "k", "s", "y", kind=kind, bucket=40.0)
    assert {x["n"]: x["y"] for x in keyed.collect()} == pytest.approx(want, abs=1e-12)
