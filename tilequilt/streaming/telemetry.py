"""Telemetry as a stream: rates and bounded history by session, held in the state store."""

from __future__ import annotations

from collections.abc import Iterator
from io import StringIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "session_id long, state string, cpu_percent double, ram_used_mb int, ram_total_mb int, fps double, tiles_done int, tiles_total int, queue_size int, ts timestamp"
#: Rows of history a session.
HISTORY = 60


def parsed(lines: DataFrame) -> DataFrame:
    """Metrics rows of JSON lines (value); malformed ones go. A record without a time has that of its arrival."""
    rows = lines.select(F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}).alias("m")).select("m.*")
    return rows.where("session_id IS NOT NULL AND state IS NOT NULL").withColumn("ts", F.coalesce("ts", F.current_timestamp()))


def read_folder(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A landing folder of JSON lines as a stream of metrics rows."""
    return parsed(spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(path))


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of a session in order of time: rate against the row before (kept in the state), 0 at first or on a fall."""
    done, last, seen = state.get if state.exists else (None, None, 0)
    rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
    out = []
    for r in rows.itertuples():
        at = r.ts.value / 1e9
        rate = (r.tiles_done - done) / (at - last) if done is not None and r.tiles_done > done and at > last else 0.0
        seen += 1
        out.append((key[0], r.ts, r.tiles_done, rate, seen))
        done, last = int(r.tiles_done), at
    state.update((done, last, seen))
    yield pd.DataFrame(out, columns=["session_id", "ts", "tiles_done", "fps", "n"])


def rates(rows: DataFrame) -> DataFrame:
    """(session_id, ts, tiles_done, fps, n): a stream of rates, stateful by session. Rows without tiles_done or time go."""
    return _counted(rows).groupBy("session_id").applyInPandasWithState(_step, "session_id long, ts timestamp, tiles_done int, fps double, n long", "done int, last double, seen long", "append", GroupStateTimeout.NoTimeout)


def _counted(rows: DataFrame) -> DataFrame:
    return rows.where("session_id IS NOT NULL AND tiles_done IS NOT NULL AND ts IS NOT NULL")


def _kept(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The last HISTORY rows of a session by time, from those kept in the state and the new ones."""
    old = pd.read_json(StringIO(state.get[0]), orient="split", convert_dates=["ts"]) if state.exists else None
    rows = pd.concat([*([old] if old is not None else []), *(b[["ts", "state", "tiles_done"]] for b in batches)]).sort_values("ts", kind="stable").tail(HISTORY)
    state.update((rows.to_json(orient="split", index=False, date_unit="us"),))
    yield rows.assign(session_id=key[0], n=range(1, len(rows) + 1))[["session_id", "n", "ts", "state", "tiles_done"]]


def history(rows: DataFrame) -> DataFrame:
    """(session_id, n, ts, state, tiles_done): after each batch the newest HISTORY rows of every session it touched,
    oldest first; the state holds no more than those."""
    return _counted(rows).groupBy("session_id").applyInPandasWithState(_kept, "session_id long, n int, ts timestamp, state string, tiles_done int", "rows string", "update", GroupStateTimeout.NoTimeout)


def latest(rows: DataFrame) -> DataFrame:
    """The newest row of each session (for complete or update mode)."""
    return rows.groupBy("session_id").agg(F.max_by(F.struct("ts", "state", "tiles_done"), "ts").alias("newest"))
