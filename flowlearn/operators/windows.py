"""Behaviour of a host in its recent past."""

from __future__ import annotations

import functools
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECONDS, HISTORY = 60.0, 50
#: Lines of a range; a host's lines beyond it are dealt to several tasks.
RANGE_ROWS = 4_000_000
_OUT = "win_flow_count double, win_unique_resp_p double, win_unique_resp_h double, win_same_port_ratio double"


def host_windows(flows: DataFrame, seconds: float = SECONDS, history: int = HISTORY, mode: str = "exact", keys: tuple[str, ...] = ("scenario", "orig_h"), range_rows: int = RANGE_ROWS) -> DataFrame:
    """``flows`` with four statistics of each host's earlier flows, in the order of ``row_seq``:
    how many there were, of how many ports and hosts, and the share on this flow's port.

    mode "frame" looks at those of the latest ``history`` flows that began within ``seconds``
    before. mode "exact" forgets only from the oldest on and for good: an old flow behind a
    younger one stays until that goes. Both agree where time never runs backwards within a
    host; "auto" is "exact" that takes the frame for such hosts.

    Where lines go beyond ``range_rows`` by ``row_seq``, hosts are cut into ranges of so many
    lines, each preceded by the ``history`` flows before it, so a host that owns most lines is
    many tasks; "exact" then keeps one stream only for hosts whose time runs backwards.
    """
    if mode not in ("frame", "exact", "auto"):
        raise ValueError(f"unknown mode: {mode}")
    ranged = (flows.agg(F.max("row_seq")).first()[0] or 0) > range_rows
    frame = _ranged_frame if ranged else _frame
    if mode == "frame":
        return frame(flows, seconds, history, keys, range_rows)
    if mode == "exact" and not ranged:
        return _exact(flows, seconds, history, keys)
    back = _backward_hosts(flows, keys, range_rows)
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`back {k}`")) for k in keys]
    told = flows.join(back, functools.reduce(Column.__and__, same), "left").drop(*[f"back {k}" for k in keys])
    own = [F.col(f"`{c}`") for c in flows.columns]
    steady, others = told.where("backwards is null").select(*own), told.where("backwards").select(*own)
    return frame(steady, seconds, history, keys, range_rows).unionByName(_exact(others, seconds, history, keys))


def _backward_hosts(flows: DataFrame, keys: tuple[str, ...], range_rows: int) -> DataFrame:
    """The hosts (as ``back <key>``) whose time runs backwards, found by ranges of their lines."""
    cut = F.floor(F.col("row_seq") / range_rows)
    w = Window.partitionBy(*keys, "range").orderBy("row_seq")
    steps = flows.select(*keys, "row_seq", "ts", cut.alias("range")).withColumn("step", F.col("ts") < F.lag("ts").over(w))
    # A range is known by its first and last time: a row for each range of a host.
    ends = steps.groupBy(*keys, "range").agg(F.max("step").alias("step"), F.min_by("ts", "row_seq").alias("first"), F.max_by("ts", "row_seq").alias("last"))
    before = F.lag("last").over(Window.partitionBy(*keys).orderBy("range"))
    found = ends.withColumn("back", F.coalesce("step", F.lit(False)) | F.coalesce(F.col("first") < before, F.lit(False))).where("back")
    return found.select(*[F.col(f"`{k}`").alias(f"back {k}") for k in keys], F.lit(True).alias("backwards")).distinct()


def _frame(flows: DataFrame, seconds: float, history: int, keys: tuple[str, ...], _: int = 0) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("row_seq").rowsBetween(-history, -1)
    past = F.filter(F.collect_list(F.struct("ts", "resp_h", "resp_p")).over(w), lambda r: r["ts"] >= F.col("ts") - seconds)
    n = F.size("past")
    same = F.size(F.filter("past", lambda r: r["resp_p"] == F.col("resp_p")))
    return flows.withColumn("past", past).select(
        *[F.col(f"`{c}`") for c in flows.columns],
        n.cast("double").alias("win_flow_count"),
        F.size(F.array_distinct(F.transform("past", lambda r: r["resp_p"]))).cast("double").alias("win_unique_resp_p"),
        F.size(F.array_distinct(F.transform("past", lambda r: r["resp_h"]))).cast("double").alias("win_unique_resp_h"),
        F.when(n > 0, same / n).otherwise(F.lit(0.0)).alias("win_same_port_ratio"),
    )


def _ranged_frame(flows: DataFrame, seconds: float, history: int, keys: tuple[str, ...], range_rows: int) -> DataFrame:
    """The frame by ranges of ``row_seq``. The last ``history`` flows of each range of a host are
    gathered, and those before a range are put in front of it as rows that only lend their past."""
    cut = F.floor(F.col("row_seq") / range_rows)
    columns = [F.col(f"`{c}`") for c in flows.columns]
    own = flows.withColumn("range", cut)
    latest = Window.partitionBy(*keys, "range").orderBy(F.desc("row_seq"))
    ends = own.select(*keys, "range", "row_seq", "ts", "resp_h", "resp_p").withColumn("rank", F.row_number().over(latest)).where(F.col("rank") <= history)
    tails = ends.groupBy(*keys, "range").agg(F.array_sort(F.collect_list(F.struct("row_seq", "ts", "resp_h", "resp_p"))).alias("tail"))
    # Each range in between has a flow at least, so ``history`` of them hold enough.
    earlier = Window.partitionBy(*keys).orderBy("range").rowsBetween(-history, -1)
    lent = tails.withColumn("past", F.flatten(F.collect_list("tail").over(earlier))).where(F.size("past") > 0)
    lent = lent.select(*keys, "range", F.explode(F.slice("past", F.greatest(F.size("past") - history + 1, F.lit(1)), history)).alias("f")).select(*keys, "range", "f.*", F.lit(True).alias("lent"))
    every = own.select(*columns, "range", F.lit(False).alias("lent")).unionByName(lent, allowMissingColumns=True)
    done = _frame(every, seconds, history, (*keys, "range"))
    return done.where("not lent").drop("range", "lent")


class Host:
    """The flows of one host that are remembered; counts are kept up, not recounted."""

    def __init__(self, seconds: float, history: int):
        self.seconds, self.history = seconds, history
        self.flows: deque[tuple[float, str, str]] = deque()
        self.ports: Counter[str] = Counter()
        self.hosts: Counter[str] = Counter()

    def _forget(self) -> None:
        _, h, p = self.flows.popleft()
        for counts, x in ((self.hosts, h), (self.ports, p)):
            counts[x] -= 1
            if not counts[x]:
                del counts[x]

    def see(self, ts: float, resp_h: str, resp_p: str) -> tuple[float, float, float, float]:
        """Statistics of the past of a flow, which then is remembered."""
        while self.flows and self.flows[0][0] < ts - self.seconds:
            self._forget()
        while len(self.flows) > self.history:
            self._forget()
        n = len(self.flows)
        out = (float(n), float(len(self.ports)), float(len(self.hosts)), self.ports[resp_p] / n if n else 0.0)
        if not self.ports[resp_p]:
            del self.ports[resp_p]
        self.flows.append((ts, resp_h, resp_p))
        self.ports[resp_p] += 1
        self.hosts[resp_h] += 1
        return out


def _exact(flows: DataFrame, seconds: float, history: int, keys: tuple[str, ...]) -> DataFrame:
    """One pass over sorted partitions; a task holds one host's memory, however long its log is."""
    names, nk = flows.columns, len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, host = None, None
        for b in batches:
            rows = []
            for *key, ts, h, p in zip(*(b.column(i).to_pylist() for i in range(nk + 3))):
                if host is None or key != last:
                    last, host = key, Host(seconds, history)
                rows.append(host.see(ts, h, p))
            stats = [pa.array([r[i] for r in rows], pa.float64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*b.columns[nk + 3 :], *stats], names=[*names, *(x.split()[0] for x in _OUT.split(", "))])

    dealt = flows.repartition(*keys).sortWithinPartitions(*keys, "row_seq")
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in flows.schema), _OUT])
    work = [F.col(f"`{c}`").alias(f"work {i}") for i, c in enumerate([*keys, "ts", "resp_h", "resp_p"])]
    return dealt.select(*work, *[F.col(f"`{n}`").alias(f"kept {i}") for i, n in enumerate(names)]).mapInArrow(run, ddl)
