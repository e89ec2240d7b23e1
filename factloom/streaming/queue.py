"""The work queue's state transitions, as plans over its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import BatchTable


def claimable(items: DataFrame, most_attempts: int = 3, limit: int | None = None) -> DataFrame:
    """Stored items and failed ones with tries left, the oldest first."""
    out = items.where((F.col("status") == "stored") | ((F.col("status") == "failed") & (F.col("attempts") < most_attempts))).orderBy(F.asc_nulls_last("received_at"), "id")
    return out.limit(limit) if limit else out


def claimed(items: DataFrame, ids: DataFrame) -> DataFrame:
    """The queue after the ids are taken: analyzing, one more try."""
    taken = ids.select("id").distinct().withColumn("taken", F.lit(True))
    out = items.join(taken, "id", "left")
    return out.withColumn("attempts", F.when(F.col("taken"), F.col("attempts") + 1).otherwise(F.col("attempts"))).withColumn("status", F.when(F.col("taken"), "analyzing").otherwise(F.col("status"))).select(items.columns)


def recovered(items: DataFrame, now: Column, orphan_minutes: int = 10, most_attempts: int = 3) -> DataFrame:
    """Failed items with tries left, and those analysed for too long, go back; without tries left they have failed."""
    late = (F.col("status") == "analyzing") & (F.col("received_at") < now - F.expr(f"interval {orphan_minutes} minutes"))
    tries = F.col("attempts") < most_attempts
    status = F.when(((F.col("status") == "failed") | late) & tries, "stored").when(late, "failed").otherwise(F.col("status"))
    return items.withColumn("status", status)


def requeued(items: DataFrame, version: int) -> DataFrame:
    """Done items of an older extraction version (or none) are stored again."""
    old = (F.col("status") == "done") & (F.coalesce("extraction_version", F.lit(-1)) < version)
    return items.withColumn("status", F.when(old, "stored").otherwise(F.col("status")))


def implicit_accepts(items: DataFrame, feedback: DataFrame, now: Column, hours: int = 24, limit: int | None = 200) -> DataFrame:
    """Done items of an agent that nobody has judged for so long: they count as accepted. The oldest first."""
    out = items.where((F.col("status") == "done") & (F.col("received_at") <= now - F.expr(f"interval {hours} hours"))).join(feedback.select(F.col("item_id").alias("id")), "id", "left_anti").orderBy("received_at", "id")
    return out.limit(limit) if limit else out


EVENTS = "id string, event string, worker string, at timestamp_ntz"


class ClaimLog:
    """Who took which items and what became of them, as numbered events beside the items.

    A claim reads the events up to a number, chooses, and writes its own as the
    next; the number's entry is created once, so of two workers that chose from
    the same state one wins and the other chooses again from what is then left.
    A claim writes as many rows as it takes, whatever the queue's length.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.log = BatchTable(spark, path, EVENTS)

    def state(self, items: DataFrame, now: Column, lease_minutes: int = 10, most_attempts: int = 3, last: int | None = None) -> DataFrame:
        """The items with status and attempts as the events have them; a claim past its lease is stored again, or failed without tries left."""
        e = self.log.read(None if last is None else last + 1)
        of = e.groupBy("id").agg(F.max_by("event", F.struct("at", (F.col("event") != "claimed").alias("over"))).alias("event"), F.max(F.when(F.col("event") == "claimed", F.col("at"))).alias("claimed_at"), F.count_if(F.col("event") == "claimed").cast("int").alias("taken"))
        tries = F.col("attempts") + F.coalesce("taken", F.lit(0))
        late = (F.col("event") == "claimed") & (F.col("claimed_at") < now - F.expr(f"interval {lease_minutes} minutes"))
        again = (late | (F.col("event") == "failed")) & (tries < most_attempts)
        status = F.when(F.col("event").isNull(), F.col("status")).when(again, "stored").when(late, "failed").when(F.col("event") == "claimed", "analyzing").otherwise(F.col("event"))
        return items.join(of, "id", "left").withColumn("status", status).withColumn("attempts", tries).select(items.columns)

    def claim(self, items: DataFrame, worker: str, now: Column, limit: int = 5, lease_minutes: int = 10, most_attempts: int = 3, tries: int = 50) -> list[str]:
        """The ids taken, oldest first; no other worker has them while the lease lasts."""
        for _ in range(tries):
            last = self.log.last()
            chosen = [r["id"] for r in claimable(self.state(items, now, lease_minutes, most_attempts, last), most_attempts, limit).select("id").collect()]  # limit ids
            if not chosen or self._write(chosen, "claimed", worker, now, last + 1):
                return chosen
        raise RuntimeError(f"others were first {tries} times")

    def finish(self, ids: list[str], worker: str, now: Column, event: str = "done") -> None:
        """The outcome of claimed items: done or failed."""
        while ids and not self._write(ids, event, worker, now, self.log.last() + 1):
            pass

    def _write(self, ids: list[str], event: str, worker: str, now: Column, number: int) -> bool:
        rows = self.log.spark.createDataFrame([(i,) for i in ids], "id string").select("id", F.lit(event).alias("event"), F.lit(worker).alias("worker"), now.cast("timestamp_ntz").alias("at"))
        return self.log.write(rows.coalesce(1), number)
