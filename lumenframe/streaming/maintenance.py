"""Maintenance of vector indexes as a stateful stream: how much each has grown since it was trained, and when it is due.

Time is the event time of the vectors that arrive. An index is looked at on ticks, multiples of ``interval``: first
trained once it has ``least`` vectors, then rebalanced when it has grown by more than ``growth`` of the size it was trained
on and ``pause`` hours have passed. State of an index is its size, the size and time of the last training, and counts of
what came after the last tick, by tick; a tick is judged by a timer when the watermark has passed it, so neither the cuts
between batches nor a restart change an event. An index that stands still has no timer.

:func:`retrain_due` runs what an event asks for: train, assign all rows anew, commit the model and the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenframe.operators import cluster, manifest
from lumenframe.operators.cluster import PATTERNS
from lumenframe.plans.storage import materialize

EVENTS = "index_name string, at timestamp, size long, trained_on long, hours_since double, action string"
HOUR = 3_600_000


class Maintenance(StatefulProcessor):
    """The state of one index; see the module."""

    def __init__(self, growth: float, pause_hours: float, interval_hours: float, least: int):
        self.growth, self.pause, self.interval, self.least = growth, int(pause_hours * HOUR), int(interval_hours * HOUR), least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.index = handle.getValueState("index", "size long, trained_on long, last long, seen long")
        self.arrived = handle.getMapState("arrived", "tick long", "n long")

    def _state(self) -> list:
        return list(self.index.get()) if self.index.exists() else [0, None, None, None]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for some in rows:
            at = some["ts_ms"].to_numpy()
            ticks = -(-at // self.interval) * self.interval
            for tick, n in pd.Series(some["n"].to_numpy()).groupby(ticks).sum().items():
                before = self.arrived.getValue((int(tick),))[0] if self.arrived.containsKey((int(tick),)) else 0
                self.arrived.updateValue((int(tick),), (before + int(n),))
                self.handle.registerTimer(int(tick))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        size, trained, last, seen = self._state()
        if seen is not None and seen >= now:
            return
        waiting = sorted(k[0] for k in self.arrived.keys())
        for tick in [t for t in waiting if t <= now]:
            size += self.arrived.getValue((tick,))[0]
            self.arrived.removeKey((tick,))
        rested = last is None or now - last >= self.pause
        grown = size >= self.least if trained is None else (size - trained) / max(1, trained) > self.growth
        if grown and rested:
            event = {"index_name": key[0], "at": pd.Timestamp(now, unit="ms"), "size": size, "trained_on": trained or 0, "hours_since": None if last is None else (now - last) / HOUR, "action": "trained" if trained is None else "rebalanced"}
            trained, last = size, now
            yield pd.DataFrame([event])
        elif grown:
            self.handle.registerTimer(now + self.interval)  # look again until the pause is over
        self.index.update((size, trained, last, now))

    def close(self) -> None:
        pass


def due_events(arrivals: DataFrame, pattern: str = "medium", interval_hours: float = 6.0, least: int = 100, late: str = "1 hour", index: str = "index_name", ts: str = "ts", n: str | None = None) -> DataFrame:
    """Events of a stream of arrived vectors: ``index_name, at, size, trained_on, hours_since, action``.

    Needs the RocksDB state store (:func:`with_state_store`). Arrivals that come later than ``late`` behind the newest count
    on the next tick, if Spark doesn't drop them; those without an index or a time are left out.
    """
    growth, pause = PATTERNS[pattern]
    rows = arrivals.where(F.col(index).isNotNull() & F.col(ts).isNotNull()).select(F.col(index).cast("string").alias("index_name"), F.col(ts).cast("timestamp").alias("ts"), (F.col(n) if n else F.lit(1)).cast("long").alias("n"))
    marked = rows.withColumn("ts_ms", F.unix_millis("ts")).withWatermark("ts", late)
    return marked.groupBy("index_name").transformWithStateInPandas(Maintenance(growth, pause, interval_hours, least), EVENTS, "Append", "EventTime")


def with_state_store(spark: SparkSession):
    """Sets the state store that timers need for the streams of a session, and gives back the setting that was there."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return before


def restore_state_store(spark: SparkSession, before: str | None) -> None:
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def retrain_due(
    spark: SparkSession, root: str, names: list[str] | None = None, pattern: str = "medium", force: bool = False, hours_since: dict[str, float] | None = None, n_clusters: int | None = None, tries: int = 5,
) -> DataFrame:
    """Check every vector table of a root and retrain those that need it: ``index_name, reason, needs_rebalance, action``.

    A table without a model is trained; one whose balance asks for it is rebalanced if its pause is over (``hours_since``;
    unknown counts as over), or if ``force``. The model and the table's rows with their new clusters change in one commit.
    Rows that others commit meanwhile are assigned to the new model and join it.
    """
    out = []
    for name in names or sorted(set(manifest.read(spark, root).folders) & set(cluster.CLUSTERED)):
        now = manifest.read(spark, root)
        rows = manifest.table(spark, root, name, now)
        key, vec = cluster.CLUSTERED[name]
        if rows.where(F.col(vec).isNotNull()).isEmpty():
            out.append((name, "empty", False, "none"))
            continue
        reason, needed, ready = "not_trained", True, True
        if f"model_{name}" in now.folders:
            model = manifest.table(spark, root, f"model_{name}", now)
            found = cluster.maintenance(rows, model, model.agg(F.max("trained_on")).first()[0] or 0, pattern, (hours_since or {}).get(name)).first()
            reason, needed, ready = found.reason, found.needs_rebalance, found.due
        if not (force or needed and ready):
            out.append((name, reason, needed, "waiting" if needed else "none"))
            continue
        centroids = cluster.train(rows, n_clusters, default=cluster.DEFAULTS[name], vec=vec)
        assigned = lambda df: cluster.write_back(df, cluster.assign(df, centroids, key, vec), key).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in df.schema.fields))  # noqa: B023, E731
        table = materialize(assigned(rows), f"retrained-{name}")
        model = centroids.select("cluster_id", "centroid", F.lit(table.count()).cast("long").alias("trained_on"))
        for turn in range(tries):
            base = manifest.read(spark, root)
            late = manifest.table(spark, root, name, base, since=now.number)
            try:
                manifest.publish(spark, root, replace={name: table.unionByName(assigned(late)), f"model_{name}": model}, base=base)
                break
            except manifest.Conflict:
                if turn == tries - 1:
                    raise
        out.append((name, reason, needed, "trained" if reason == "not_trained" else "rebalanced"))
    return spark.createDataFrame(out, "index_name string, reason string, needs_rebalance boolean, action string")
