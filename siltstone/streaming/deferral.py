"""Small changes held back until enough of them have gathered.

Sessions of a key are added up in order. When their number or the sum of their magnitudes
reaches its limit, all that are held are given out together and the sums start anew. The
batch form goes through sorted rows, the streaming form keeps the same sums as state; both
give the same rows for the same order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.session import ship

MAX_DEFERRED, THRESHOLD = 5, 0.40


def summary(files: Column, added: Column, removed: Column) -> Column:
    return F.format_string("%s files, %s+ / %s- lines", files, added, removed)


def fold(sessions: DataFrame, by: Sequence[str], order: Sequence[str], magnitude: str, max_deferred: int = MAX_DEFERRED, threshold: float = THRESHOLD) -> DataFrame:
    """sessions with batch (from 0 for each key), accumulated (up to and with the session) and flushed.

    Keys are hashed over tasks and sorted there; a task goes through its rows once and holds the
    sums of one key, so a key with very many sessions costs time but no memory. A null magnitude
    adds nothing.
    """
    ship(sessions.sparkSession)
    n_by, cols = len(by), sessions.columns
    keyed = sessions.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.coalesce(F.col(magnitude), F.lit(0.0)).cast("double").alias("_m"), *cols)
    keys = [f"_k{i}" for i in range(n_by)]
    rows = keyed.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, total, batch = None, 0, 0.0, 0
        for b in batches:
            out: list[tuple[int, float, bool]] = []
            for *key, m in zip(*[b.column(i).to_pylist() for i in range(n_by + 1)]):
                if key != now:
                    now, n, total, batch = key, 0, 0.0, 0
                n, total = n + 1, total + m
                full = n >= max_deferred or total >= threshold
                out.append((batch, total, full))
                if full:
                    n, total, batch = 0, 0.0, batch + 1
            new = [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.float64(), pa.bool_()))] if out else [pa.array([], t) for t in (pa.int64(), pa.float64(), pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns[n_by + 1 :], *new], names=[*cols, "batch", "accumulated", "flushed"])

    have = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sessions.schema)
    return rows.mapInArrow(run, f"{have}, batch bigint, accumulated double, flushed boolean")


def pending(folded: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, sessions_deferred, accumulated_magnitude): what is held at the end, rounded to four places."""
    last = folded.groupBy(*by, "batch").agg(F.count("*").alias("n"), F.max("accumulated").alias("m"), F.bool_or("flushed").alias("out"))
    held = last.where("not out").groupBy(*by).agg(F.sum("n").alias("n"), F.round(F.sum("m"), 4).alias("m"))
    keys = folded.select(*by).distinct()
    return keys.join(held, list(by), "left").select(*by, F.coalesce("n", F.lit(0)).cast("long").alias("sessions_deferred"), F.coalesce("m", F.lit(0.0)).alias("accumulated_magnitude"))


OUT = "key string, batch bigint, session_id string, magnitude double, accumulated double"
STATE = "n bigint, sum double, batch bigint, ids array<string>, magnitudes array<double>"


def stream(sessions: DataFrame, max_deferred: int = MAX_DEFERRED, threshold: float = THRESHOLD) -> DataFrame:
    """The sessions (key, session_id, ts, magnitude) of a stream that are given out, with the batch they leave in.

    Within a trigger the sessions of a key are ordered by ts; state holds at most max_deferred of them.
    """

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, batch, ids, magnitudes = state.get if state.exists else (0, 0.0, 0, [], [])
        ids, magnitudes = list(ids), list(magnitudes)
        rows = []
        new = pd.concat(list(frames)).sort_values(["ts", "session_id"], kind="stable")
        for sid, m in zip(new["session_id"], new["magnitude"].fillna(0.0)):
            ids.append(sid)
            magnitudes.append(float(m))
            n, total = n + 1, total + float(m)
            if n >= max_deferred or total >= threshold:
                run_sum = 0.0
                for s, x in zip(ids, magnitudes):
                    run_sum += x
                    rows.append((key[0], batch, s, x, run_sum))
                n, total, batch, ids, magnitudes = 0, 0.0, batch + 1, [], []
        state.update((n, total, batch, ids, magnitudes))
        yield pd.DataFrame(rows, columns=["key", "batch", "session_id", "magnitude", "accumulated"])

    return sessions.groupBy("key").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
