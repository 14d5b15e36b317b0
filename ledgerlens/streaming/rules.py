"""Event-time forms of the rules, for Structured Streaming. ``ts`` is a timestamp column ``at`` here."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def timed(tx: DataFrame, late: str = "1 hour") -> DataFrame:
    """``tx`` with its event time ``at`` and a watermark."""
    return tx.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)


def deduplicated(rows: DataFrame) -> DataFrame:
    """Each (wallet, tx_hash, stream) once within the watermark."""
    return rows.dropDuplicatesWithinWatermark(["wallet", "tx_hash", "stream"])


def activity(rows: DataFrame, width: str = "30 days") -> DataFrame:
    """Transactions by tumbling bucket. Buckets begin at the epoch, not at a wallet's first transaction."""
    return rows.groupBy(F.window("at", width), "wallet").agg(F.count("*").alias("n"))


def _bursts(key: tuple, batches: Iterator[pd.DataFrame], state, seconds: int, least: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    new = np.sort(np.concatenate([b["ts"].to_numpy(np.int64) for b in batches] or [np.empty(0, np.int64)]))
    held = np.sort(np.concatenate([np.array(state.get[0] if state.exists else [], np.int64), new]))
    within = lambda xs, s: np.searchsorted(xs, s + seconds, "right") - np.searchsorted(xs, s, "left")
    begin = np.unique(held)
    n = within(held, begin)
    found = (n >= least) & (within(new, begin) > 0)
    # what comes later lies after the watermark, so it can only join windows that end there or later
    kept = held[(held + seconds) * 1000 >= state.getCurrentWatermarkMs()]
    if len(kept):
        state.update((kept.tolist(),))
        state.setTimeoutTimestamp(int(kept[-1] + seconds + 1) * 1000)
    elif state.exists:
        state.remove()
    yield pd.DataFrame({"wallet": key[0], "from_ts": begin[found], "n": n[found]})


def bursts(rows: DataFrame, seconds: int = 300, least: int = 5) -> DataFrame:
    """``wallet, from_ts, n``: outgoing transfers within the closed forward window of each one, as RULE-002 counts them.

    A window comes again, with its new count, whenever a transfer joins it (output mode update). Counts are exact over
    all rows that aren't late; the state of a wallet is the times of its transfers that the watermark hasn't left behind
    by a window's length.
    """
    sent = rows.where("src = wallet AND dst <> wallet AND stream = 0").select("wallet", "ts", "at")
    return sent.groupBy("wallet").applyInPandasWithState(
        partial(_bursts, seconds=seconds, least=least), "wallet string, from_ts long, n long", "times array<long>", "update", "EventTimeTimeout"
    )


def sessions(rows: DataFrame, gap: str = "30 days") -> DataFrame:
    """Periods of activity; the time between two of a wallet's sessions is a dormancy."""
    return rows.groupBy(F.session_window("at", gap), "wallet").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _gaps(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    times = sorted(t for b in batches for t in b["ts"])
    out = []
    for t in times:
        if last is not None and t > last:
            out.append((key[0], int(last), int(t), (t - last) / 86400.0))
        last = t if last is None else max(last, t)
    if last is not None:
        state.update((int(last),))
    yield pd.DataFrame(out, columns=["wallet", "from_ts", "to_ts", "gap_days"])


def dormancies(rows: DataFrame, least_days: float = 30.0) -> DataFrame:
    """Exact gaps between consecutive transactions as they arrive; the state of a wallet is one number.

    Rows that arrive after a later one of their wallet begin no gap.
    """
    found = rows.groupBy("wallet").applyInPandasWithState(_gaps, "wallet string, from_ts long, to_ts long, gap_days double", "last long", "append", "NoTimeout")
    return found.where(F.col("gap_days") > least_days)


class _Counter(StatefulProcessor):
    """How many wallets each funder has had; the state of a funder is that number."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.n = handle.getValueState("n", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.n.get()[0] if self.n.exists() else 0
        for b in rows:
            yield pd.DataFrame({"wallet": b["wallet"].to_numpy(), "funder": key[0], "n_earlier": np.arange(before, before + len(b))})
            before += len(b)
        self.n.update((before,))

    def close(self) -> None:
        pass


def shared_funders(links: DataFrame, forget: bool = False) -> DataFrame:
    """``wallet, funder, n_earlier``: wallets whose funder has funded others before, in order of arrival.

    Two states: each (funder, wallet) pair is a key of its own, dealt over all tasks, and is let through once; each funder
    has a number. So a funder of very many wallets costs each of them one look-up, and its own state doesn't grow. With
    ``forget`` a pair is known for the watermark of ``links`` only, which bounds the state. State is held in RocksDB
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    pair = ["funder", "wallet"]
    once = links.dropDuplicatesWithinWatermark(pair) if forget else links.select(*pair).dropDuplicates(pair)
    counted = once.select(*pair).groupBy("funder").transformWithStateInPandas(_Counter(), "wallet string, funder string, n_earlier long", "Append", "None")
    return counted.where("n_earlier > 0")
