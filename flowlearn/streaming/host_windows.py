"""Host windows over an unbounded stream of flows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.windows import HISTORY, SECONDS, Host

STATE = "ts array<double>, resp_h array<string>, resp_p array<string>"
OUT = "scenario string, orig_h string, row_seq long, win_flow_count double, win_unique_resp_p double, win_unique_resp_h double, win_same_port_ratio double"


def read_lines(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Lines of the text files that arrive in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("lineSep", "\n").text(folder)


def host_windows(flows: DataFrame, seconds: float = SECONDS, history: int = HISTORY) -> DataFrame:
    """For each flow (scenario, orig_h, row_seq, ts, resp_h, resp_p) the four statistics of its
    host's past, in the order of arrival, and of ``row_seq`` within a micro-batch.

    A host's state holds at most ``history`` + 1 flows and never times out, as late flows are
    neither dropped nor put in order."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        host = Host(seconds, history)
        if state.exists:
            for flow in zip(*state.get):
                host.flows.append(flow)
                host.hosts[flow[1]] += 1
                host.ports[flow[2]] += 1
        rows = pd.concat(list(batches)).sort_values("row_seq", kind="stable")
        out = [(*key, n, *host.see(ts, h, p)) for n, ts, h, p in zip(rows.row_seq, rows.ts, rows.resp_h, rows.resp_p)]
        state.update(tuple(list(x) for x in zip(*host.flows)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    chosen = flows.select("scenario", "orig_h", "row_seq", "ts", "resp_h", "resp_p")
    return chosen.groupBy("scenario", "orig_h").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
