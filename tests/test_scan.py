import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.operators import metrics
from lumenframe.plans import scan


@pytest.fixture(scope="module")
def series(spark):
    draw = random.Random(1)
    rows = [(draw.choice(["hot"] * 8 + ["a", "b", None]), i * 3 % 997, draw.choice([None, 1, 2, 5]), float(draw.randrange(40))) for i in range(900)]
    return spark.createDataFrame(rows + [("one", 5, 7, 1.0)], "k string, t long, v long, x double").coalesce(3)


@pytest.mark.parametrize("parts", [1, 7])
def test_scans_equal_windows(spark, series, parts):
    stored = scan.ranged(series, ["k"], ["t"], parts)
    assert stored.select(scan.PART).distinct().count() > parts / 2
    w = W.partitionBy("k").orderBy("t")
    rows = lambda df: sorted(map(str, df.collect()))
    want = series.select("*", F.coalesce(F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)).alias("s"))
    assert rows(scan.running_sum(stored, ["k"], ["t"], "v", "s").drop(scan.PART)) == rows(want)
    want = series.select("*", F.lag("v").over(w).alias("pv"), F.lag("t").over(w).alias("pt"))
    assert rows(scan.previous(stored, ["k"], ["t"], {"v": "pv", "t": "pt"}).drop(scan.PART)) == rows(want)
    want = series.select("*", F.min("t").over(W.partitionBy("k")).alias("t0"))
    assert rows(scan.first_of_series(stored, ["k"], ["t"], {"t": "t0"}).drop(scan.PART)) == rows(want)
    assert scan.running_sum(scan.ranged(series.limit(0), ["k"], ["t"]), ["k"], ["t"], "v", "s").collect() == []


def test_percentiles_are_exact(spark, series):
    got = {r.k: r for r in metrics.latency_summary(series, ["k"], "x").collect()}
    values = {}
    for r in series.collect():
        values.setdefault(r.k, []).append(r.x)
    assert got.keys() == values.keys()
    for k, v in values.items():
        v.sort()
        at = lambda p: v[min(int(len(v) * p), len(v) - 1)]  # noqa: B023, E731
        assert (got[k].n, got[k].p50, got[k].p90, got[k].p95, got[k].p99) == (len(v), at(0.5), at(0.9), at(0.95), at(0.99))
    assert got["one"].stdev == 0.0


def test_no_window_spans_a_series(spark, series):
    """Windows are over (series, range), or over what ranges hand on."""
    plan = metrics.increases(series, "k", "t", "x")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_part" in line for line in windows)
