"""Structured Streaming over logs: ingest without replays, latches, liveness rules, windowed incidence, progress."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LATE = "1 hour"


@dataclass(frozen=True)
class StopLimits:
    """Limits of the stop rules of a run; the windows and their bounds are fixed values."""

    streak: int = 3
    informative_window: int = 32
    informative_floor: float = 0.60
    truncated_window: int = 8
    truncated_ceiling: float = 0.05
    hours: float = 40.0
    per_step: int = 16
    trajectories: int = 1200


def ingest(stream: DataFrame, key: str, ts: str, late: str = LATE) -> DataFrame:
    """Each attempt once, however often it was replayed within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def incidence(stream: DataFrame, ts: str, bad: F.Column, width: str = "1 hour", slide: str | None = None, late: str = LATE) -> DataFrame:
    """start, n, bad: rows and bad rows of each tumbling (or sliding) window; works on a batch table too."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    s = stream.withWatermark(ts, late) if stream.isStreaming else stream
    return s.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).select(F.col("w.start").alias("start"), "n", "bad")


@contextmanager
def disk_state(spark: SparkSession, drain: bool = False) -> Iterator[None]:
    """Queries started within keep their state in RocksDB on the executors' disks, as latch and liveness need it. drain: they run no
    batches without rows; a query with timers that is to end when all is read would never end otherwise."""
    values = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    if drain:
        values["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Paths of an episode that stand together in one value of the state; more have one each.
TOGETHER = 256


class _Latch(StatefulProcessor):
    """The first call of each damaged path of one episode; a path that is not damaged again leaves the state after a while. Paths stand
    together, as each request to the state takes longer than the work on an episode; those beyond TOGETHER have a row each."""

    def __init__(self, ttl: int, together: int = TOGETHER) -> None:
        self.ttl, self.together = ttl, together

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.few = handle.getValueState("few", "paths array<string>, calls array<bigint>, seen array<bigint>, more boolean", self.ttl)
        self.first = handle.getMapState("first", "path string", "call long", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        least: dict[str, int] = {}
        for row in rows:
            if row.path not in least or row.call < least[row.path]:
                least[row.path] = row.call
        now = timerValues.getCurrentProcessingTimeInMs()
        *held, more = self.few.get() or ([], [], [], False)
        few = {path: (call, seen) for path, call, seen in zip(*held, strict=True) if seen + self.ttl > now}
        for path, call in least.items():
            known = few[path][0] if path in few else None
            apart = known is None and more and self.first.containsKey((path,))
            if apart:
                (known,) = self.first.getValue((path,))
            if known is None or call < known:
                yield Row(episode=key[0], path=path, first_call=call)
            call = call if known is None else min(call, known)
            if apart or (path not in few and len(few) >= self.together):
                self.first.updateValue((path,), (call,))
                more = True
            else:
                few[path] = (call, now)
        self.few.update((list(few), [call for call, _ in few.values()], [seen for _, seen in few.values()], more))

    def close(self) -> None:
        pass


def latch(stream: DataFrame, episode: str, call: str, path: str, ttl: int = 7 * 86_400_000) -> DataFrame:
    """episode, path, first_call of every damaged path, for update mode: a row when a path is damaged for the first time, and again if
    a late call has a smaller index. The state is two numbers for each path of an episode; they leave ttl milliseconds after the last
    damage. Rows without a path or call are none. Start it within disk_state."""
    rows = stream.select(F.col(episode).alias("episode"), F.col(call).cast("long").alias("call"), F.col(path).alias("path")).where("path is not null and call is not null")
    kind = stream.schema[episode].dataType.simpleString()
    return rows.groupBy("episode").transformWithState(_Latch(ttl), f"episode {kind}, path string, first_call long", "Update", "ProcessingTime")


def latched(updates: DataFrame) -> DataFrame:
    """episode, first_call, damaged: first violation and distinct paths of each episode, from what latch wrote so far."""
    per = updates.groupBy("episode", "path").agg(F.min("first_call").alias("first_call"))
    return per.groupBy("episode").agg(F.min("first_call").alias("first_call"), F.count("*").alias("damaged"))


class _Stops(StatefulProcessor):
    """The stop rules of one run. Steps are taken in their order: one that comes early waits in the state, and a timer says when a run
    from which nothing more came is over; then what still waits is taken, over its gaps, and the state is left."""

    NUMBERS = "next long, n long, streak long, inf_sum double, inf_before double, clip_sum double, clip_before double, hours double, fired boolean, timer long"

    def __init__(self, limits: StopLimits, patience: int) -> None:
        self.k, self.patience = limits, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.numbers = handle.getValueState("numbers", self.NUMBERS)
        self.waiting = handle.getMapState("waiting", "step long", "broken boolean, zero double, clipped double, hours double")

    def _take(self, s: dict, broken: bool, zero: float, clipped: float, hours: float) -> str | None:
        """The rule that holds after one more step; s is changed."""
        k = self.k
        s["n"] += 1
        s["hours"] += hours
        s["streak"] = s["streak"] + 1 if zero >= 1 else 0
        s["inf_sum"] += 1 - zero
        s["clip_sum"] += clipped
        rule = "streak" if s["streak"] >= k.streak else "not_finite" if broken else None
        for name, part, size, bad in (("informative", "inf", k.informative_window, lambda m: m < k.informative_floor), ("truncated", "clip", k.truncated_window, lambda m: m > k.truncated_ceiling)):
            if s["n"] % size == 0:
                mean, before = s[f"{part}_sum"] / size, s[f"{part}_before"]
                rule = name if s["n"] > size and bad(mean) and bad(before) else rule
                s[f"{part}_before"], s[f"{part}_sum"] = mean, 0.0
        rule = "hours" if s["hours"] > k.hours else rule
        return "trajectories" if s["n"] * k.per_step >= k.trajectories else rule

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        names = [x.split()[0] for x in self.NUMBERS.split(", ")]
        known = self.numbers.get()
        s = dict(zip(names, known, strict=True)) if known else dict(zip(names, (1, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, False, 0), strict=True))
        if not s["fired"]:
            early = {r.step: (r.broken, r.zero, r.clipped, r.hours) for r in rows if r.step >= s["next"]}
            waits = bool(known) and self.waiting.exists()  # else no step needs to be sought in the state
            while not s["fired"]:
                row = early.pop(s["next"], None)
                if waits and self.waiting.containsKey((s["next"],)):
                    row = row or self.waiting.getValue((s["next"],))
                    self.waiting.removeKey((s["next"],))
                if not row:
                    break
                if rule := self._take(s, *row):
                    yield Row(run=key[0], rule=rule, step=s["next"])
                    s["fired"] = True
                s["next"] += 1
            if s["fired"]:
                if waits:
                    self.waiting.clear()
            else:
                for step, row in early.items():
                    self.waiting.updateValue((step,), row)
        if s["timer"]:
            self.handle.deleteTimer(s["timer"])
        s["timer"] = timerValues.getCurrentProcessingTimeInMs() + self.patience
        self.handle.registerTimer(s["timer"])
        self.numbers.update(tuple(s.values()))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        s = dict(zip([x.split()[0] for x in self.NUMBERS.split(", ")], self.numbers.get(), strict=True))
        if not s["fired"]:
            for (step,), row in sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator()):
                if rule := self._take(s, *row):
                    yield Row(run=key[0], rule=rule, step=step)
                    break
        self.waiting.clear()
        self.numbers.clear()

    def close(self) -> None:
        pass


def liveness(stream: DataFrame, run: str, step: str, limits: StopLimits | None = None, patience: int = 86_400_000) -> DataFrame:
    """run, rule, step: the first step of each run at which a stop rule holds. Of several at one step the last in this order counts:
    not_finite (loss or grad_norm is infinite or no number), streak (steps in a row without signal, zero >= 1), informative (two whole windows
    in a row with a mean of 1 - zero under the floor), truncated (two with a mean of clipped above the ceiling), hours (their
    sum above the cap), trajectories (so many for each step; at the cap). Windows are looked at when they are full.

    stream: run, step (from 1 on), loss, grad_norm, zero, clipped, hours; a null in these is a missing log entry: finite, with signal,
    not clipped, no time. Steps may come in any order and again: an early one waits until those before it are there, a step that was
    taken is not taken again. patience milliseconds after its last row a run is over: what waits is taken without the missing steps,
    and the state is left, so that later rows are a new run. The state is ten numbers for each run, and the waiting steps; after a
    rule held, no step waits. For append mode; start it within disk_state.
    """
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(True))
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    whole = stream.select(F.col(run).alias("run"), F.col(step).cast("long").alias("step"), (~(finite("loss") & finite("grad_norm"))).alias("broken"), *map(number, ("zero", "clipped", "hours")))
    kind = stream.schema[run].dataType.simpleString()
    return whole.where("step is not null").groupBy("run").transformWithState(_Stops(limits or StopLimits(), patience), f"run {kind}, rule string, step long", "Append", "ProcessingTime")


def stops(df: DataFrame, run: str, step: str, limits: StopLimits | None = None) -> DataFrame:
    """What liveness gives, of a finished log as a batch: windows over each run. Steps count from 1."""
    k = limits or StopLimits()
    w = Window.partitionBy(run).orderBy(step)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c, n, back: F.avg(c).over(w.rowsBetween(1 - n * (back + 1), -n * back))
    whole = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("zero", "clipped", "hours")}).withColumn("inf", 1 - F.col("zero"))
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(True))
    n = F.row_number().over(w)
    pair = lambda c, size, bad: (n >= 2 * size) & (n % size == 0) & bad(last(c, size, 0)) & bad(last(c, size, 1))
    rules = {
        "trajectories": n * k.per_step >= k.trajectories, "hours": F.sum("hours").over(so_far) > k.hours, "truncated": pair("clipped", k.truncated_window, lambda m: m > k.truncated_ceiling),
        "informative": pair("inf", k.informative_window, lambda m: m < k.informative_floor), "streak": (n >= k.streak) & (F.min("zero").over(w.rowsBetween(1 - k.streak, 0)) >= 1), "not_finite": ~(finite("loss") & finite("grad_norm")),
    }
    fired = whole.withColumn("rule", F.coalesce(*(F.when(v, F.lit(name)) for name, v in rules.items()))).where("rule is not null")
    return fired.groupBy(F.col(run).alias("run")).agg(F.min_by("rule", step).alias("rule"), F.min(step).cast("long").alias("step"))


def progress(stream: DataFrame, error: F.Column) -> DataFrame:
    """done, errors so far, for update mode."""
    return stream.groupBy().agg(F.count("*").alias("done"), F.count_if(error).alias("errors"))
