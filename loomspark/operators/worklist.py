"""A durable worklist as folds over its event tables. Time is a column or a parameter, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def state_counts(tasks: DataFrame, states: list[str]) -> DataFrame:
    return tasks.agg(*[F.count_if(F.col("state") == s).alias(s) for s in states])


def priority(kind: Column) -> Column:
    """Outbox work first, then revalidation, then derivation, then the rest."""
    return F.when(kind.isin("outbox", "support_refresh"), 0).when(kind.isin("node_revalidate", "edge_revalidate"), 1).when(kind.isin("n2e", "k2k"), 2).otherwise(3)


def claimable(tasks: DataFrame, now: Column, epoch: int) -> DataFrame:
    """Tasks that may be claimed: waiting, due again, or leased by an earlier epoch or for too long."""
    state = F.col("state")
    return tasks.where(
        state.isin("pending", "awaiting_model") | (state == "retry") & (F.col("retry_after") <= now) | (state == "leased") & ((F.col("lease_expires") <= now) | (F.col("epoch") < epoch))
    )


def claim_order(tasks: DataFrame, limit: int) -> DataFrame:
    """The first tasks by kind's priority, age and id."""
    return tasks.withColumn("priority", priority(F.col("kind"))).orderBy("priority", "created_at", "task_id").limit(limit)


def undispatched(outbox: DataFrame, dispatched: DataFrame, key: str) -> DataFrame:
    return outbox.join(dispatched, key, "left_anti")


def streaks(events: DataFrame, who: str, order: str, failed: Column) -> DataFrame:
    """who, streak: failures in a row at the end of each log (0 if the last event isn't one)."""
    last_ok = events.groupBy(who).agg(F.max(F.when(~failed, F.col(order))).alias("ok"))
    after = events.join(last_ok, who).where(failed & (F.col("ok").isNull() | (F.col(order) > F.col("ok")))).groupBy(who).agg(F.count(F.lit(1)).alias("n"))
    return last_ok.join(after, who, "left").select(who, F.coalesce("n", F.lit(0)).cast("long").alias("streak"))


def oscillations(events: DataFrame, who: str, order: str, value: str) -> DataFrame:
    """Events at which a value returns to what it was two events before, after another in between."""
    w = Window.partitionBy(who).orderBy(order)
    marked = events.withColumn("before", F.lag(value, 1).over(w)).withColumn("first", F.lag(value, 2).over(w))
    return marked.where((F.col("first") == F.col(value)) & (F.col("before") != F.col(value))).select(who, order, F.col("first").alias("value"), "before")


def greedy_batches(rows: DataFrame, group: list[str], order: str, size: str, limit: int) -> DataFrame:
    """batch_no for each row: a batch is closed when the next row would bring it above limit; no batch is empty.

    A fold over a group's rows in order; what it needs of a row is its order and size.
    """
    import pandas as pd

    schema = rows.select(*group, order, size)
    names = schema.columns

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        no, held, out = 0, 0, []
        for n in pdf[size]:
            if held and held + n > limit:
                no, held = no + 1, 0
            held += n
            out.append(no)
        return pdf[names].assign(batch_no=out)

    return schema.groupBy(*group).applyInPandas(fold, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema.schema)}, batch_no long")
