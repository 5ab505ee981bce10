"""Lane scores per harness, fleet scores, trends, and the digest that makes them comparable."""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom import constants as C
from tallyloom.operators.rules import verdicts


def signals(metrics: DataFrame, by: list[str], marathon_ms: int = C.MARATHON_SITTING_MS) -> DataFrame:
    """(*by, signal, reading, sample): readings are null under their minimum."""
    rates = (
        verdicts(metrics, marathon_ms, tuple(by))
        .groupBy(*by, "rule")
        .agg(F.avg(F.col("fired").cast("int")).alias("rate"), F.count("fired").alias("sample"))
        .select(*by, F.concat(F.lit("fire-rate:"), "rule").alias("signal"), F.when(F.col("sample") >= C.MIN_SCORED_SESSIONS, F.col("rate")).alias("reading"), "sample")
    )
    pooled = metrics.groupBy(*by).agg(F.sum("errors").alias("errors"), F.sum("attempts").alias("sample"))
    pooled = pooled.select(*by, F.lit("pooled-tool-error-rate").alias("signal"), F.when(F.col("sample") >= C.MIN_SCORED_TOOL_ATTEMPTS, F.col("errors") / F.col("sample")).alias("reading"), "sample")
    return rates.unionByName(pooled)


def lane_table(spark) -> DataFrame:
    """(lane, signal, floor): a few rows of constants."""
    rows = [(lane, s, C.TOOL_ERROR_RATE_FLOOR if s == "pooled-tool-error-rate" else C.FIRE_RATE_FLOOR) for lane, _, signals_ in C.LANES for s in signals_]
    return spark.createDataFrame(rows, "lane string, signal string, floor double")


def lane_scores(metrics: DataFrame, by: list[str] | None = None, marathon_ms: int = C.MARATHON_SITTING_MS) -> DataFrame:
    """(*by, lane, score, components): null score where no component reads; by is source_agent unless given."""
    by = by or ["source_agent"]
    lanes = F.broadcast(lane_table(metrics.sparkSession))  # as many rows as there are signals in C.LANES
    penalty = F.greatest(F.least(F.col("reading") / F.col("floor"), F.lit(1.0)), F.lit(0.0))
    return (
        signals(metrics, by, marathon_ms)
        .join(lanes, "signal")
        .groupBy(*by, "lane")
        .agg(F.avg(penalty).alias("penalty"), F.count("reading").alias("components"))
        .select(*by, "lane", F.round(F.lit(C.CLEAN_SCORE) * (1 - F.col("penalty"))).cast("long").alias("score"), "components")
    )


def fleet_scores(scores: DataFrame) -> DataFrame:
    """(lane, score, harnesses): the unweighted mean over harnesses that scored, and which they are."""
    return scores.filter("score is not null").groupBy("lane").agg(F.round(F.avg("score")).cast("long").alias("score"), F.array_join(F.sort_array(F.collect_set("source_agent")), ",").alias("harnesses"))


def direction(now: Column, before: Column) -> Column:
    return F.when(now > before, "up").when(now < before, "down").when(now == before, "flat")


def fleet_trend(now: DataFrame, before: DataFrame) -> DataFrame:
    """(lane, score, before, direction, change): comparable only if the same harnesses scored on both sides."""
    n, b = fleet_scores(now), fleet_scores(before).withColumnsRenamed({"score": "before", "harnesses": "then"})
    same = F.col("harnesses").eqNullSafe(F.col("then"))
    return n.join(b, "lane", "full_outer").select(
        "lane", "score", F.when(same, F.col("before")).alias("before"), F.when(same, direction(F.col("score"), F.col("before"))).alias("direction"), F.when(same, F.abs(F.col("score") - F.col("before"))).alias("change")
    )


def _bits(x: float) -> str:
    return struct.pack(">d", x).hex()


def pack_entries() -> list[tuple[str, str]]:
    """(name, value) of everything that a score depends on, in order."""
    return [
        ("formula", C.FORMULA),
        *((f"rule.{key}", title) for key, title in C.RULES),
        ("threshold.session-tool-error-rate", _bits(C.SESSION_TOOL_ERROR_RATE)),
        ("threshold.min-session-tool-attempts", str(C.MIN_SESSION_TOOL_ATTEMPTS)),
        ("threshold.tool-error-rate", _bits(C.TOOL_ERROR_RATE)),
        ("threshold.min-tool-attempts", str(C.MIN_TOOL_ATTEMPTS)),
        ("threshold.retry-loop-repeats", str(C.RETRY_LOOP_REPEATS)),
        ("threshold.idle-gap", f"{C.IDLE_GAP_MS}ms"),
        ("threshold.marathon-sitting-active", f"{C.MARATHON_SITTING_MS}ms"),
        ("threshold.resumed-span-to-active", _bits(C.RESUMED_SPAN_TO_ACTIVE)),
        ("threshold.resumed-min-sittings", str(C.RESUMED_MIN_SITTINGS)),
        ("threshold.babysitting-tools-per-request", _bits(C.BABYSITTING_TOOLS_PER_REQUEST)),
        ("threshold.babysitting-min-user-requests", str(C.BABYSITTING_MIN_USER_REQUESTS)),
        ("threshold.fire-and-forget-tools-per-request", _bits(C.FIRE_AND_FORGET_TOOLS_PER_REQUEST)),
        ("threshold.fire-and-forget-user-requests", str(C.FIRE_AND_FORGET_USER_REQUESTS)),
        ("threshold.compaction-churn-completions", str(C.COMPACTION_CHURN_COMPLETIONS)),
        ("scoring.clean-score", _bits(C.CLEAN_SCORE)),
        ("scoring.fire-rate-floor", _bits(C.FIRE_RATE_FLOOR)),
        ("scoring.tool-error-rate-floor", _bits(C.TOOL_ERROR_RATE_FLOOR)),
        ("scoring.min-scored-sessions", str(C.MIN_SCORED_SESSIONS)),
        ("scoring.min-scored-tool-attempts", str(C.MIN_SCORED_TOOL_ATTEMPTS)),
        *((f"lane.{key}", ",".join(signals_)) for key, _, signals_ in C.LANES),
    ]


def pack_digest() -> str:
    """sha256 over the entries, one a line: two reports are comparable if and only if it is equal."""
    return hashlib.sha256("".join(f"{k}={v}\n" for k, v in pack_entries()).encode()).hexdigest()
