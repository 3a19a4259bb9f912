"""Request quotas: at most ``limit`` requests per key in windows that open with a request.

A window opens at its key's first request after the last window ended (strictly after its reset
time), so that windows depend on each other in time. The batch form cuts time into blocks: a block
is worked on as a function from the reset time that reaches it to the reset time that leaves it,
these short functions pass by in order per key, one number being kept, and then every block places its
windows. Numpy works on all blocks of a batch at once. No task holds the requests of a key beyond a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIMIT = 10
WINDOW_SECONDS = 3600
_MICROS = 1_000_000
_NEVER = -(2**62)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of rows sorted by ``client_key, block`` as tables that never cut a group; empty ones are left out."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        last = int(_group_starts(batch)[-1])
        if held and (last or not _same_group(held[-1], batch)):
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _same_group(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
    return all(a.column(c)[len(a) - 1] == b.column(c)[0] for c in ("client_key", "block"))


def _group_starts(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    keys = rows.column("client_key")
    keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    codes = keys.dictionary_encode("encode").indices.to_numpy()
    blocks = rows.column("block").to_numpy()
    return np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1]))))


class _Groups:
    """Times of many (client, block) groups at once, on one axis on which groups lie far apart."""

    def __init__(self, rows: pa.Table, block_micros: int, window: int):
        self.starts = _group_starts(rows)
        self.sizes = np.diff([*self.starts, rows.num_rows])
        self.group = np.repeat(np.arange(len(self.starts)), self.sizes)
        self.times, blocks = rows.column("micros").to_numpy(), rows.column("block").to_numpy()[self.starts]
        self.begin = blocks * block_micros
        self.far, self.window = block_micros + 4 * window, window
        self.axis = self._on_axis(self.times, self.group)

    def _on_axis(self, times: np.ndarray, group: np.ndarray) -> np.ndarray:
        # Times before the block are all alike to it, and so are those behind its reach.
        inside = np.clip(times - self.begin[group], -1, self.far - self.window)
        return group * self.far + inside + 1

    def after(self, times: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Place of the group's first time behind each of ``times``; the group's end where there is none."""
        return np.clip(
            np.searchsorted(self.axis, self._on_axis(times, group), side="right"),
            self.starts[group],
            self.starts[group] + self.sizes[group],
        )


def _block_pieces(rows: pa.Table, block_micros: int, window: int) -> dict[str, np.ndarray]:
    """Each block as a function: from ``low`` on, the reset time that reaches it becomes ``leaves`` (never: stays)."""
    g = _Groups(rows, block_micros, window)
    # A window opened before the block resets before ``begin + window``: only these can open the block.
    early = g.times < g.begin[g.group] + window
    n_groups = len(g.starts)
    group = np.concatenate((np.arange(n_groups), g.group[early]))
    low = np.concatenate((np.full(n_groups, _NEVER), g.times[early]))
    order = np.lexsort((low, group))
    group, low = group[order], low[order]
    end = g.starts[group] + g.sizes[group]
    at = g.after(np.maximum(low, g.begin[group] - 1), group)
    leaves = np.full(len(low), _NEVER)
    open_ = np.flatnonzero(at < end)
    while len(open_):
        reset = g.times[at[open_]] + window
        leaves[open_] = reset
        at[open_] = g.after(reset, group[open_])
        open_ = open_[at[open_] < end[open_]]
    changed = np.concatenate(([True], (leaves[1:] != leaves[:-1]) | (group[1:] != group[:-1])))
    return {"row": g.starts[group[changed]], "low": low[changed], "leaves": leaves[changed]}


def _window_starts(rows: pa.Table, block_micros: int, window: int) -> dict[str, np.ndarray]:
    """Starts of the windows that a block's requests fall into, one row for each."""
    g = _Groups(rows, block_micros, window)
    group = np.arange(len(g.starts))
    reached = rows.column("reached").to_numpy()[g.starts]
    carried = reached != _NEVER
    found, places = [reached[carried] - window], [group[carried]]
    at = g.after(np.maximum(reached, g.begin - 1), group)
    while True:
        group = group[at[group] < g.starts[group] + g.sizes[group]]
        if len(group) == 0:
            break
        opened = g.times[at[group]]
        found.append(opened)
        places.append(group)
        at[group] = g.after(opened + window, group)
    return {"row": g.starts[np.concatenate(places)], "start": np.concatenate(found)}


def _per_block(df: DataFrame, work: Callable[[pa.Table, int, int], dict[str, np.ndarray]], columns: list[str], *args: int) -> DataFrame:
    """``work`` on many blocks at a time; its ``row`` says whose keys a result has."""
    kind = dict(df.dtypes)["client_key"]
    by_block = ["client_key", "block"]
    schema = f"client_key {kind}, block bigint, " + ", ".join(f"{c} bigint" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            out = work(rows, *args)
            keys = rows.select(by_block).take(pa.array(out["row"]))
            table = pa.table([*keys.columns, *[pa.array(out[c], pa.int64()) for c in columns]], names=[*by_block, *columns])
            yield from table.combine_chunks().to_batches()

    return df.repartition(*by_block).sortWithinPartitions(*by_block, "micros").mapInArrow(run, schema)


def _chained(pieces: DataFrame) -> DataFrame:
    """``client_key, block, reached``: the reset time that reaches each block; a client's functions pass by in order, none is kept."""
    kind = dict(pieces.dtypes)["client_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = block = nothing = object()
        reset = leaves = reached = _NEVER
        for batch in batches:
            rows, out = [], []
            codes = batch.column("client_key").to_pylist()
            columns = [batch.column(c).to_pylist() for c in ("block", "low", "leaves")]
            for row, (key, at, low, to) in enumerate(zip(codes, *columns)):
                if key != client or at != block or client is nothing:
                    # The block before is over; what leaves it reaches this one.
                    reset = _NEVER if key != client or client is nothing else reset if leaves == _NEVER else leaves
                    client, block, reached, leaves = key, at, reset, _NEVER
                    rows.append(row)
                    out.append(reached)
                if low <= reached:
                    leaves = to
            if rows:
                keys = [batch.column(c).take(pa.array(rows)) for c in ("client_key", "block")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(out, pa.int64())], names=["client_key", "block", "reached"])

    ordered = pieces.repartition("client_key").sortWithinPartitions("client_key", "block", "low")
    return ordered.mapInArrow(run, f"client_key {kind}, block bigint, reached bigint")


def quota_labels(
    requests: DataFrame, limit: int = LIMIT, window_seconds: int = WINDOW_SECONDS, block_windows: int = 24
) -> DataFrame:
    """Requests with ``allowed``, ``remaining`` and ``reset_at``.

    Reads ``req_id, client_key, ts``; requests at the same time count in order of ``req_id``. A block has at most
    ``block_windows + 1`` windows, so the list of its starts is short.
    """
    window = window_seconds * _MICROS
    block_micros = window * block_windows
    timed = requests.withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn(
        "block", F.floor(F.col("micros") / F.lit(block_micros)).cast("bigint")
    )
    moments = timed.select("client_key", "block", "micros").distinct()
    reached = _chained(_per_block(moments, _block_pieces, ["low", "leaves"], block_micros, window))
    same_block = moments["client_key"].eqNullSafe(reached["client_key"]) & (moments["block"] == reached["block"])
    reached_moments = moments.join(reached, same_block).select(moments["*"], "reached")
    starts = _per_block(reached_moments, _window_starts, ["start"], block_micros, window)
    starts = starts.groupBy("client_key", "block").agg(F.array_sort(F.collect_list("start")).alias("starts"))
    start = F.element_at(F.filter("starts", lambda s: s <= F.col("micros")), -1)
    same_block = timed["client_key"].eqNullSafe(starts["client_key"]) & (timed["block"] == starts["block"])
    placed = timed.join(starts, same_block).select(timed["*"], start.alias("start"))
    # Only the first ``limit`` requests of a window matter; each task keeps as many before the shuffle.
    nth = F.row_number().over(W.partitionBy("client_key", "start").orderBy("micros", "req_id"))
    first = placed.withColumn("nth", nth).where(F.col("nth") <= limit).select("req_id", F.col("client_key").alias("_key"), "nth")
    own = (placed["req_id"] == first["req_id"]) & placed["client_key"].eqNullSafe(F.col("_key"))
    counted = placed.join(first, own, "left").select(placed["*"], F.coalesce("nth", F.lit(limit + 1)).alias("nth"))
    return counted.select(
        *requests.columns,
        (F.col("nth") <= limit).alias("allowed"),
        F.greatest(F.lit(limit) - F.col("nth"), F.lit(0)).alias("remaining"),
        (F.col("ts") + F.make_dt_interval(secs=(F.col("start") + F.lit(window) - F.col("micros")) / F.lit(_MICROS))).alias(
            "reset_at"
        ),
    )


def quota_snapshot(labels: DataFrame, as_of: datetime, limit: int = LIMIT) -> DataFrame:
    """Per key what it has used and has left at ``as_of``; an ended window counts as unused."""
    seen = labels.where(F.col("ts") <= F.lit(as_of))
    windows = seen.groupBy("client_key", "reset_at").agg(F.count_if("allowed").alias("used"))
    last = windows.groupBy("client_key").agg(
        F.max("reset_at").alias("reset_at"), F.max_by("used", "reset_at").alias("used")
    )
    count = F.when(F.lit(as_of) > F.col("reset_at"), F.lit(0)).otherwise(F.col("used"))
    return last.select("client_key", count.alias("used"), (F.lit(limit) - count).alias("remaining"))


def live_quotas(snapshot_windows: DataFrame, as_of: datetime) -> DataFrame:
    """Windows that are not past their reset time."""
    return snapshot_windows.where(F.lit(as_of) <= F.col("reset_at"))


def quota_stream(
    requests: DataFrame, limit: int = LIMIT, window_seconds: int = WINDOW_SECONDS, lateness: str = "1 hour"
) -> DataFrame:
    """Streaming form: ``(req_id, client_key, ts, allowed, remaining)`` per request.

    The state of a key is its reset time and count; it goes once the watermark of ``ts``, ``lateness``
    behind the latest request, has passed the reset time, so that a replayed log forgets nothing
    early. Requests of a key are taken in order of time within a micro-batch; requests behind the
    watermark are dropped.
    """
    window = window_seconds * _MICROS

    def label(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(chunks)).sort_values(["micros", "req_id"])
        times = rows["micros"].to_numpy()
        reset, used = state.get if state.exists else (_NEVER, 0)
        at = int(np.searchsorted(times, reset, side="right"))
        parts = [used + 1 + np.arange(at)]
        used += at
        while at < len(times):
            reset = int(times[at]) + window
            end = int(np.searchsorted(times, reset, side="right"))
            parts.append(1 + np.arange(end - at))
            used, at = end - at, end
        nth = np.concatenate(parts)
        state.update((reset, min(used, limit)))
        state.setTimeoutTimestamp(max(reset // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(
            {
                "req_id": rows["req_id"],
                "client_key": key[0],
                "ts": rows["ts"],
                "allowed": nth <= limit,
                "remaining": np.maximum(limit - nth, 0),
            }
        )

    kinds = dict(requests.dtypes)
    timed = requests.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", lateness)
    return timed.withColumn("micros", F.unix_micros("event_time")).groupBy("client_key").applyInPandasWithState(
        label,
        f"req_id {kinds['req_id']}, client_key {kinds['client_key']}, ts {kinds['ts']}, allowed boolean, remaining int",
        "reset bigint, used int",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
