"""Structured Streaming: capture without repeats, claims folded with state, windows over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.resolve import fold_claim
from ..sources.capture import ENVELOPE


def envelope_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", files_per_trigger).json(path)


def captured_once(env: DataFrame, late: str = "7 days") -> DataFrame:
    """One of each (org, channel, external_id); state is kept as long as repeats may come. Null ids all pass."""
    key = ["org", "channel", "external_id"]
    env = env.withWatermark("received_at", late)
    # a null id gets a name of its own from what it says, so that only a redelivery of the same message is a repeat
    named = env.withColumn("external_id", F.coalesce("external_id", F.concat(F.lit("?"), F.sha2(F.concat_ws("\x1f", "sender", "subject", "text", F.col("received_at").cast("string")), 256))))
    return named.dropDuplicatesWithinWatermark(key)


#: A claim's current fact.
STATE = T.StructType([T.StructField("fact_id", T.StringType()), T.StructField("value", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("sources", T.ArrayType(T.StringType()))])


class ClaimFold(StatefulProcessor):
    """A claim's current fact as state: each observation's outcome is decided against it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["observed_at", "source_item_id", "fact_id"])
        state = self.current.get() if self.current.exists() else None
        state = None if state is None else (state[0], state[1], state[2], set(state[3] or []))
        made, state = fold_claim(((r.fact_id, r.observed_at, r.source_item_id, r.value, r.confidence) for r in batch.itertuples()), state)
        self.current.update((state[0], state[1], float(state[2]), sorted(state[3])))
        yield pd.DataFrame({"claim_key": [key[0]] * len(made), "fact_id": [m[0] for m in made], "outcome": [m[1] for m in made], "kept_id": [m[2] for m in made]})

    def close(self) -> None:
        pass


def folded_claims(claims: DataFrame) -> DataFrame:
    """Outcomes of a stream of claims (claim_key, fact_id, observed_at, source_item_id, value, confidence)."""
    return claims.groupBy("claim_key").transformWithStateInPandas(ClaimFold(), "claim_key string, fact_id string, outcome string, kept_id string", "Append", "None")


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type. Extension: the catalogue has no windows of its own."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of users. Extension, as tumbling()."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def drained(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs the stream over all there is, into a table at path, and returns when it is done."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
