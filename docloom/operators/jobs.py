"""The job table as a fold over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TERMINAL = ("completed", "failed", "cancelled")


def fold_actions(actions: Column) -> Column:
    """Status after ordered actions (submit, start, cancel, finish, fail): terminal states stay.

    A cancelled queued job ends at once; a cancelled running one is marked and ends at its next event.
    """
    def step(state: Column, action: Column) -> Column:
        running = state.startswith("running")
        return (
            F.when(state.isin(*TERMINAL), state)
            .when((state == "new") & (action == "submit"), "queued")
            .when(state == "new", state)
            .when((state == "queued") & (action == "cancel"), "cancelled")
            .when((state == "queued") & (action == "start"), "running")
            .when((state == "running!") & action.isin("finish", "fail", "start"), "cancelled")
            .when(running & (action == "cancel"), "running!")
            .when(running & (action == "finish"), "completed")
            .when(running & (action == "fail"), "failed")
            .otherwise(state)
        )

    return F.regexp_replace(F.aggregate(actions, F.lit("new"), step), "!", "")


def job_states(events: DataFrame) -> DataFrame:
    """events (job_id, ts, event_id, action) -> job_id, status, created_at, updated_at, n_events; unsubmitted jobs drop out."""
    rows = events.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "action"))).alias("rows"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.count("*").alias("n_events"))
    return rows.select("job_id", fold_actions(F.col("rows.action")).alias("status"), "created_at", "updated_at", "n_events").where("status <> 'new'")


def prune(jobs: DataFrame, now: str, retention_s: int, most: int) -> DataFrame:
    """Without terminal jobs older than the retention (0: none), nor the oldest terminal ones beyond ``most`` jobs.

    Ranks come from counts by day, so no window spans all jobs: only the day on the boundary is sorted.
    """
    ended = F.col("status").isin(*TERMINAL)
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("updated_at").cast("timestamp"))
    kept = jobs.where(~(ended & F.lit(retention_s > 0) & (age > retention_s))).withColumn("day", F.to_date("updated_at"))
    days = kept.groupBy("day").agg(F.count("*").alias("n"), F.count_if(ended).alias("n_ended"))
    earlier = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    total = Window.partitionBy(F.lit(1))
    placed = days.select("day", F.coalesce(F.sum("n_ended").over(earlier), F.lit(0)).alias("before"), F.greatest(F.lit(0), F.sum("n").over(total) - max(1, most)).alias("surplus"))
    nth = F.row_number().over(Window.partitionBy("day", ended).orderBy("updated_at", "created_at", "job_id"))
    ranked = kept.join(F.broadcast(placed), "day").withColumn("nth", nth + F.col("before"))
    return ranked.where(~(ended & (F.col("nth") <= F.col("surplus")))).select(*jobs.columns)
