"""The life of a projection's rebuild as a fold: each field by the last event that sets it, the phase by the last event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STREAM_TYPE = "ledger.rebuild"
EVENTS = ["rebuildcreated", "buildstarted", "buildresumed", "caughtup", "promoted", "rolledback", "abandoned", "previousretired"]
PHASES = ["created", "building", "caughtup", "promoted", "rolledback", "abandoned", "retired"]
PHASE_OF = dict(zip(EVENTS, (0, 1, 1, 2, 3, 4, 5, 6), strict=True))


def label(phase: int) -> str:
    return PHASES[phase] if 0 <= phase < len(PHASES) else f"unknown({phase})"


def phase_of(event_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for e, p in PHASE_OF.items():
        out = F.when(event_type == e, F.lit(PHASES[p])).otherwise(out)
    return out


def history(events: DataFrame) -> DataFrame:
    """The phase after each event; legality of transitions isn't judged."""
    return events.withColumn("phase", phase_of(F.col("event_type")))


def state(events: DataFrame) -> DataFrame:
    """A row a rebuild. All fields are partial aggregates."""
    v, kind = F.col("stream_version"), F.col("event_type")

    def last(value: Column, *of: str) -> Column:
        return F.max_by(value, F.when(kind.isin(*of), v))

    return events.groupBy("stream_id").agg(
        F.max(v).alias("version"), F.max_by(phase_of(kind), v).alias("phase"), last(F.col("name"), "rebuildcreated").alias("name"),
        last(F.col("next_version"), "rebuildcreated").alias("next_version"), last(F.col("previous_version"), "rebuildcreated").alias("previous_version"),
        last(F.col("reason"), "rebuildcreated").alias("reason"), last(F.col("at"), "rebuildcreated").alias("created_at"), last(F.col("at"), "caughtup").alias("caught_up_at"),
        last(F.col("position"), "caughtup").alias("caught_up_position"), last(F.col("at"), "promoted").alias("promoted_at"), last(F.col("reason"), "abandoned").alias("abandon_cause"),
    )
