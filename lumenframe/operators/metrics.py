"""Time-series queries over counters and samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.functions.scalars import hours_between
from lumenframe.plans import scan

# Upper bounds of the request-duration histogram, in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def increases(samples: DataFrame, series: str = "series", ts: str = "ts", value: str = "value") -> DataFrame:
    """``samples`` with ``delta``: growth of a counter since its last sample; a fall is a reset, and counts from zero."""
    stored = scan.ranged(samples, [series], [ts])
    rows = scan.previous(stored, [series], [ts], {value: "_before"})
    step = F.col(value) - F.col("_before")
    return rows.select(*samples.columns, F.when(F.col("_before").isNull(), F.lit(0.0)).when(step < 0, F.col(value)).otherwise(step).alias("delta"))


def rate(samples: DataFrame, seconds: int = 300, series: str = "series", ts: str = "ts", value: str = "value", time: str | None = None) -> DataFrame:
    """Per-second increase by series and tumbling window of ``seconds``: ``series, window_start, rate``.

    Samples are ordered by ``ts``; if that is a struct that breaks ties, ``time`` names the column of their time.
    """
    rows = increases(samples, series, ts, value)
    start = F.window(time or ts, f"{seconds} seconds").start
    return rows.groupBy(series, start.alias("window_start")).agg((F.sum("delta") / seconds).alias("rate"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(F.coalesce(numerator / F.nullif(denominator, F.lit(0)), F.lit(0.0)))


def histogram(samples: DataFrame, keys: list[str], value: str = "value", bounds=BUCKETS) -> DataFrame:
    """Cumulative bucket counts ``(keys, le, n)``; the last bound is infinite. One aggregate, then an unpivot of its few rows."""
    counts = [F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)]
    wide = samples.groupBy(*keys).agg(*counts, F.count(value).alias("_all"))
    cells = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)), F.struct(F.lit(float("inf")).alias("le"), F.col("_all").alias("n")))
    return wide.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.le", "c.n")


def histogram_quantile(buckets: DataFrame, q: float, keys: list[str]) -> DataFrame:
    """Linear interpolation inside the bucket that reaches q; a quantile in the infinite bucket is the last finite bound."""
    w = W.partitionBy(*keys).orderBy("le")
    rows = buckets.withColumn("below", F.coalesce(F.lag("n").over(w), F.lit(0))).withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0)))
    rows = rows.withColumn("total", F.max("n").over(W.partitionBy(*keys))).withColumn("want", F.col("total") * q)
    rows = rows.where((F.col("n") >= F.col("want")) & (F.col("total") > 0)).withColumn("_i", F.row_number().over(w)).where("_i = 1")
    inside = F.col("low") + (F.col("le") - F.col("low")) * (F.col("want") - F.col("below")) / F.nullif(F.col("n") - F.col("below"), F.lit(0))
    value = F.when(F.col("le") == float("inf"), F.col("low")).otherwise(F.coalesce(inside, F.col("low")))
    return rows.select(*keys, value.alias("quantile"))


def index_percentile(p: float, column: str) -> Column:
    """The element at floor(n p) of the sorted values (the last for p = 1); no interpolation. Exact, so it holds a group's values: for groups of bounded size; :func:`latency_summary` is for any."""
    values = F.array_sort(F.collect_list(column))
    at = F.least(F.floor(F.size(values) * p) + 1, F.size(values)).cast("int")
    return F.when(F.size(values) > 0, F.element_at(values, F.greatest(at, F.lit(1))))


def latency_summary(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """mean, min, max, sample deviation (0 for one value) and index percentiles.

    Percentiles are exact and picked from running counts of (key, value) over ranges, so no key is sorted or gathered in one task.
    """
    rows = samples.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    plain = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.coalesce(F.stddev_samp("_v"), F.lit(0.0)).alias("stdev"))
    at = lambda p: F.least(F.floor(F.col("_total") * p), F.col("_total") - 1)
    found = scan.picked(rows.groupBy(*keys, "_v").agg(F.count("*").alias("_n")), keys, "_v", "_n", {"p50": at(0.5), "p90": at(0.9), "p95": at(0.95), "p99": at(0.99)})
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return plain.alias("a").join(found.alias("b"), same).select("a.*", "b.p50", "b.p90", "b.p95", "b.p99")


def firing(samples: DataFrame, condition: Column, hold_seconds: float, series: str = "series", ts: str = "ts", time: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Spells in which ``condition`` held at every sample, of at least ``hold_seconds``: ``series, since, until, samples``.

    Samples are ordered by ``ts``, which may be a struct that breaks ties; ``time`` takes the time out of it.
    """
    rows = samples.select(series, ts, F.coalesce(condition, F.lit(False)).alias("_on"))
    rows = rows.withColumn("_off", F.when(F.col("_on"), 0).otherwise(1))
    rows = scan.running_sum(scan.ranged(rows, [series], [ts]), [series], [ts], "_off", "_spell").where("_on")
    spells = rows.groupBy(series, "_spell").agg(F.min(ts).alias("since"), F.max(ts).alias("until"), F.count("*").alias("samples"))
    micros = lambda c: F.unix_micros(time(F.col(c)).cast("timestamp"))
    long = micros("until") - micros("since") >= hold_seconds * 1e6
    return spells.where(long).drop("_spell")


def interval_rates(ticks: DataFrame, ts: str = "ts", processed: str = "processed", series: str = "series") -> DataFrame:
    """Items per second since the last tick."""
    rows = scan.previous(scan.ranged(ticks, [series], [ts]), [series], [ts], {ts: "_ts", processed: "_done"})
    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_ts").cast("timestamp"))) / 1e6
    return rows.select(*ticks.columns, ratio(F.col(processed) - F.col("_done"), seconds).alias("interval_rate"))


def cooled_down(runs: DataFrame, min_hours: float, key: str = "index_name", ts: str = "ts") -> DataFrame:
    """Runs that come at least ``min_hours`` after the one before (the first always does)."""
    rows = scan.previous(scan.ranged(runs, [key], [ts]), [key], [ts], {ts: "_ts"})
    return rows.select(*runs.columns, hours_between(F.col(ts), F.col("_ts")).alias("hours_since")).where(F.col("hours_since").isNull() | (F.col("hours_since") >= min_hours))


def cache_replay(requests: DataFrame, ttl_seconds: float, key: str = "key", ts: str = "ts") -> DataFrame:
    """``hit`` of each request if entries live ``ttl_seconds`` from their last write: a miss writes, a hit does not.

    Requests within the TTL of a key's last miss are hits. The chain of misses of one key is sequential, so it is folded
    over the key's request times, a bounded state of two numbers a step.
    """
    times = F.array_sort(F.collect_list(F.unix_micros(F.col(ts).cast("timestamp"))))
    start = F.struct(F.lit(None).cast("long").alias("written"), F.lit(0).cast("long").alias("hits"))

    def step(acc, t):
        fresh = F.coalesce(t - acc["written"] <= int(ttl_seconds * 1_000_000), F.lit(False))
        return F.struct(F.when(fresh, acc["written"]).otherwise(t).alias("written"), (acc["hits"] + F.when(fresh, 1).otherwise(0)).alias("hits"))

    folded = requests.groupBy(key).agg(F.count("*").alias("requests"), F.aggregate(times, start, step, lambda acc: acc["hits"]).alias("hits"))
    return folded.withColumn("hit_rate", ratio(F.col("hits"), F.col("requests")))


def retry_delay(attempt: Column, base: float = 0.1, most: float = 5.0) -> Column:
    """Seconds before a retry: base x 2^attempt, at most ``most`` (jitter is the caller's)."""
    return F.least(base * F.pow(F.lit(2.0), attempt), F.lit(most))


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, total_documents`` of each table, in one union."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("total_documents")).select(F.lit(name).alias("table"), "total_documents")
        out = part if out is None else out.unionByName(part)
    return out


def ratio_of_rates(samples: DataFrame, over: str, under: str, seconds: int = 300, series: str = "series", name: str = "name", time: str | None = None) -> DataFrame:
    """Per series and window the rate of counter ``over`` by that of ``under``: ``series, window_start, ratio``; 0 where nothing grew."""
    rows = samples.where(F.col(name).isin(over, under)).withColumn("_s", F.struct(series, name))
    rates = rate(rows, seconds, "_s", time=time).select(F.col(f"_s.{series}").alias(series), F.col(f"_s.{name}").alias("_name"), "window_start", "rate")
    wide = rates.groupBy(series, "window_start").agg(F.sum(F.when(F.col("_name") == over, F.col("rate"))).alias("_o"), F.sum(F.when(F.col("_name") == under, F.col("rate"))).alias("_u"))
    return wide.select(series, "window_start", ratio(F.coalesce("_o", F.lit(0.0)), F.coalesce("_u", F.lit(0.0))).alias("ratio"))


def idle_share(samples: DataFrame, busy: Column, keys: list[str]) -> DataFrame:
    """1 - mean share of idle per key: ``keys, busy_share``."""
    return samples.groupBy(*keys).agg((1 - F.avg(F.when(busy, 0.0).otherwise(1.0))).alias("busy_share"))


def count_of_groups(samples: DataFrame, outer: list[str], inner: list[str]) -> DataFrame:
    """How many different ``inner`` groups each ``outer`` one has: ``count(count by (inner))``."""
    return samples.groupBy(*outer, *inner).agg(F.count("*").alias("_n")).groupBy(*outer).agg(F.count("*").alias("n_groups"))


def label_match(column: str, op: str, value: str) -> Column:
    """Label matchers ``=``, ``!=``, ``=~`` and ``!~``; patterns match whole labels, and a missing label is empty."""
    label = F.coalesce(F.col(column).cast("string"), F.lit(""))
    whole = label.rlike(f"^(?:{value})$") if op in ("=~", "!~") else label == value
    if op not in ("=", "!=", "=~", "!~"):
        raise ValueError(f"no label matcher {op}")
    return whole if op in ("=", "=~") else ~whole


def line_filter(line: Column, op: str, value: str) -> Column:
    """Log line filters ``|=``, ``!=``, ``|~`` and ``!~``: contains, or has a match of a pattern."""
    if op not in ("|=", "!=", "|~", "!~"):
        raise ValueError(f"no line filter {op}")
    found = line.contains(value) if op in ("|=", "!=") else line.rlike(value)
    return found if op in ("|=", "|~") else ~found


def progress(ticks: DataFrame, total: int, ts: str = "ts", processed: str = "processed", series: str = "series") -> DataFrame:
    """``percent``, overall ``rate`` since a series' first tick, and ``eta_seconds`` (null before there is a rate)."""
    rows = scan.first_of_series(scan.ranged(ticks, [series], [ts]), [series], [ts], {ts: "_first"})
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    seconds = (micros(ts) - micros("_first")) / 1e6
    speed = ratio(F.col(processed).cast("double"), seconds)
    left = F.greatest(F.lit(total) - F.col(processed), F.lit(0))
    out = (100.0 * F.col(processed) / max(1, total)).alias("percent"), speed.alias("rate"), F.when(speed > 0, left / speed).alias("eta_seconds")
    return rows.select(*ticks.columns, *out)


def pool_stats(requests: DataFrame, channel: str, latency: str, ok: Column) -> DataFrame:
    """Per channel: requests, mean latency, success rate."""
    return requests.groupBy(channel).agg(F.count("*").alias("requests"), F.avg(latency).alias("avg_latency"), F.avg(ok.cast("double")).alias("success_rate"))


def peak_concurrency(requests: DataFrame, start: str, end: str, keys: list[str]) -> DataFrame:
    """Most requests that ran at once, by key: +1 at a start, -1 at an end, ends first at equal times."""
    keyed = [F.col(k) for k in keys]
    steps = requests.select(*keyed, F.col(start).alias("t"), F.lit(1).alias("step")).unionByName(requests.select(*keyed, F.col(end).alias("t"), F.lit(-1).alias("step")))
    steps = steps.groupBy(*keys, "t", "step").agg(F.sum("step").alias("by"))
    running = scan.running_sum(scan.ranged(steps, keys, ["t", "step"]), keys, ["t", "step"], "by", "running")
    return running.groupBy(*keys).agg(F.max("running").alias("peak"))
