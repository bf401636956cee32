"""How far each application had safely processed its partitions: completed checkpoints and the offsets saved in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HANDLE = "topic string, partition int, offset bigint"
APP = ("application_name", "application_id")


def latest_states(states: DataFrame) -> DataFrame:
    """Of the states that one task of one operator saved for one checkpoint the one with the largest id.

    The rows are placed by application and checkpoint, so that all later grouping of one checkpoint happens where they are.
    """
    keys = (*APP, "job_id", "task_number", "operator_id", "checkpoint_id")
    placed = states.select(*keys, "id", "num_tasks", "completed_checkpoint_id", "handle").repartition(*APP, "checkpoint_id")
    newest = placed.groupBy(*keys).agg(F.max(F.struct("id", "num_tasks", "completed_checkpoint_id", "handle")).alias("s"))
    return newest.select(*keys, "s.num_tasks", "s.completed_checkpoint_id", "s.handle")


def restart_points(latest: DataFrame) -> DataFrame:
    """(application, checkpoint_id) to restart from; no row for an application without a complete checkpoint.

    A checkpoint is complete if every pair of job and operator that the application has anywhere has rows of ``num_tasks`` tasks in
    it. The newest complete one counts, or, where any of its rows names completed checkpoints (> 0), the oldest of those.
    """
    pairs = latest.groupBy(*APP, "job_id", "operator_id").agg(F.lit(1).alias("one")).groupBy(*APP).agg(F.count("one").alias("pairs"))
    each = latest.groupBy(*APP, "checkpoint_id", "job_id", "operator_id").agg(
        F.count("task_number").alias("tasks"), F.max("num_tasks").alias("num_tasks"), F.min(F.when(F.col("completed_checkpoint_id") > 0, F.col("completed_checkpoint_id"))).alias("back")
    )
    whole = each.groupBy(*APP, "checkpoint_id").agg(F.count(F.when(F.col("tasks") == F.col("num_tasks"), 1)).alias("complete"), F.min("back").alias("back"))
    done = whole.join(pairs, list(APP)).where((F.col("complete") == F.col("pairs")) & F.col("checkpoint_id").isNotNull())
    best = done.groupBy(*APP).agg(F.max(F.struct("checkpoint_id", "back")).alias("b"))
    return best.select(*APP, F.coalesce("b.back", "b.checkpoint_id").alias("checkpoint_id"))


def saved_offsets(states: DataFrame) -> DataFrame:
    """(topic, partition, saved): the last offset safely processed. Null, broken or empty handles and null offsets save nothing.

    Should several applications have saved one partition, the smallest offset counts, so that nothing is skipped.
    """
    latest = latest_states(states)
    at = latest.join(restart_points(latest), [*APP, "checkpoint_id"], "left_semi").where((F.col("job_id") == 0) & (F.col("operator_id") == 0))
    handle = at.select(F.from_json("handle", HANDLE).alias("h")).select("h.*").where(F.col("offset").isNotNull() & F.col("topic").isNotNull() & F.col("partition").isNotNull())
    return handle.groupBy("topic", "partition").agg(F.min("offset").alias("saved"))
