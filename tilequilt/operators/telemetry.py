"""Telemetry over tables of metrics rows (session_id, ts, tiles_done, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(rows: DataFrame, key: str, order: list[str], done: str = "tiles_done", ts: str = "ts") -> DataFrame:
    """rows with fps: tiles a second since the row before; 0 for the first, for none, and when the counter falls."""
    w = Window.partitionBy(key).orderBy(*order)
    more = F.col(done) - F.lag(done).over(w)
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) / 1e6
    return rows.withColumn("fps", F.when((more > 0) & (gap > 0), more / gap).otherwise(F.lit(0.0)))


def last_rows(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The last n rows of each key, order being newest first."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def latest(rows: DataFrame, key: str, order: list[str], *values: str) -> DataFrame:
    """The newest row's values of each key."""
    row = F.max_by(F.struct(*values), F.struct(*order)).alias("__row")
    return rows.groupBy(key).agg(row).select(key, *(F.col(f"__row.{v}").alias(v) for v in values))


def one_decimal(x: Column) -> Column:
    """x as text with one decimal; halves go away from zero."""
    tenths = F.floor(F.abs(x.cast("double")) * 10 + 0.5)
    sign = F.when((x < 0) & (tenths > 0), "-").otherwise("")
    return F.concat(sign, F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def metrics_document() -> Column:
    """Metrics JSON in a fixed order of keys, with one decimal for cpu_percent and fps."""
    one = {c: one_decimal(F.col(c)) for c in ("cpu_percent", "fps")}
    parts = []
    for c in ("session_id", "state", "cpu_percent", "ram_used_mb", "ram_total_mb", "fps", "tiles_done", "tiles_total", "queue_size"):
        value = F.concat(F.lit('"'), F.col("state"), F.lit('"')) if c == "state" else one.get(c, F.col(c).cast("string"))
        parts.append(F.concat(F.lit(f'"{c}":'), value))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def cpu_percent(busy_before: Column, total_before: Column, busy: Column, total: Column) -> Column:
    """CPU use between two readings; 0 where no time went by."""
    span = total - total_before
    return F.when(span > 0, 100.0 * (busy - busy_before) / span).otherwise(F.lit(0.0))


def ram_used_mb(total_kb: Column, available_kb: Column) -> Column:
    return ((total_kb - available_kb) / 1024).cast("int")


def transitions(rows: DataFrame, key: str, order: list[str], state: str, legal: DataFrame) -> DataFrame:
    """rows with from_state and legal: whether the step from the row before is a legal transition (null for the first)."""
    steps = rows.withColumn("from_state", F.lag(state).over(Window.partitionBy(key).orderBy(*order)))
    known = legal.select("from_state", F.col("to_state").alias(state), F.lit(True).alias("__legal"))
    out = steps.join(known, ["from_state", state], "left")
    return out.withColumn("legal", F.when(F.col("from_state").isNotNull(), F.coalesce("__legal", F.lit(False)))).drop("__legal")


def run_summary(rows: DataFrame, run: str, status: str) -> DataFrame:
    """One row: runs, distinct detection counts, whether all ended well, and PASS or WARN."""
    per_run = rows.groupBy(run).agg(F.count("*").alias("n"), F.bool_and(F.col(status) == "DONE").alias("done"))
    return per_run.agg(F.count("*").alias("runs"), F.countDistinct("n").alias("distinct_counts"), F.bool_and("done").alias("all_done")).withColumn("verdict", F.when((F.col("distinct_counts") == 1) & F.col("all_done"), "PASS").otherwise("WARN"))


def report_line(*fields: tuple[Column, int]) -> Column:
    """A line of a fixed-width report: each value padded to its width, longer ones whole."""

    def cell(value: Column, width: int) -> Column:
        text = value.cast("string")
        return F.when(F.length(text) >= width, text).otherwise(F.rpad(text, width, " "))

    return F.concat_ws(" ", *(cell(v, w) for v, w in fields))


def report(rows: DataFrame, run: str, fields: list[tuple[str, str, int]], detections: str = "n", status: str = "status") -> DataFrame:
    """A whole report as (part, run, line): 0 the heading, 1 a rule, 2 a line a row, 3 whether counts agree, 4 whether all ended well.

    fields are (heading, column, width). Rows are not numbered, so that no task holds them all: sort by part and run. An
    empty table has a heading and a rule.
    """
    some = rows.agg(F.count("*").alias("n"), F.min(detections).alias("least"), F.max(detections).alias("most"), F.bool_and(F.coalesce(F.col(status) == "DONE", F.lit(False))).alias("done")).where("n > 0")
    same = F.format_string("PASS: All %d runs produced %d detections (consistent)", "n", "least")
    agree = F.when(F.col("least") == F.col("most"), same).otherwise(F.format_string("WARN: Inconsistent detection counts: %d to %d", "least", "most"))
    ended = F.concat(F.when(F.col("done"), "PASS").otherwise("FAIL"), F.lit(": All sessions reached DONE state"))

    def part(df: DataFrame, number: int, line: Column, at: Column) -> DataFrame:
        return df.select(F.lit(number).alias("part"), at.cast("long").alias("run"), line.alias("line"))

    one, none = rows.sparkSession.range(1), F.lit(None)
    parts = [part(one, 0, report_line(*((F.lit(h), w) for h, _, w in fields)), none), part(one, 1, F.lit("-" * 60), none)]
    parts += [part(rows, 2, report_line(*((F.col(c), w) for _, c, w in fields)), F.col(run)), part(some, 3, agree, none), part(some, 4, ended, none)]
    return reduce(DataFrame.unionByName, parts)
