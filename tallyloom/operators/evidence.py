"""Anchors: bounded locators (ordinals of tool events) behind a finding, and which of them may be served."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom import constants as C
from tallyloom.operators.metrics import command_churn, with_outcomes


def failures(events: DataFrame) -> DataFrame:
    """(session_id, tool, locator, record, ts) of every event that states a failure; a null tool is unattributed."""
    return with_outcomes(events).filter("not ok").select("session_id", "tool", F.col("tool_ordinal").alias("locator"), "record", "ts")


def picked(failed: DataFrame, most: int = C.MAX_ANCHORS) -> DataFrame:
    """Up to `most` anchors per session, spread over its failing tools: (session_id, tool, locator).

    Whole rounds are taken (the first failure of each tool, then the second of each, and so on) until there are `most`;
    these are put in order of locators and cut. Unattributed failures have no tool to take turns with and stay out.
    """
    tool = Window.partitionBy("session_id", "tool").orderBy("locator")
    session = Window.partitionBy("session_id")
    rounds = failed.filter("tool is not null").withColumn("round", F.row_number().over(tool))
    before = F.coalesce(F.count(F.lit(1)).over(session.orderBy("round").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = rounds.withColumn("before", before).filter(F.col("before") < most)
    return kept.withColumn("nth", F.row_number().over(session.orderBy("locator"))).filter(F.col("nth") <= most).select("session_id", "tool", "locator")


def any_failures(failed: DataFrame, most: int = C.MAX_ANCHORS) -> DataFrame:
    """The first `most` failures of each session, whatever their tool."""
    w = Window.partitionBy("session_id").orderBy("locator")
    return failed.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most).select("session_id", "tool", "locator")


def busiest_runs(events: DataFrame, most: int = C.MAX_ANCHORS) -> DataFrame:
    """The first `most` runs of each session's busiest command: (session_id, command, locator)."""
    busiest = command_churn(events).select("session_id", F.col("busiest_command").alias("command"))
    w = Window.partitionBy("session_id").orderBy("locator")
    runs = with_outcomes(events).filter("command is not null").select("session_id", "command", F.col("tool_ordinal").alias("locator"))
    return runs.join(busiest, ["session_id", "command"]).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most).drop("nth")


def servable(asked: DataFrame, published: DataFrame) -> DataFrame:
    """The rows of asked (session_id, locator, ...) that the published anchors name."""
    return asked.join(published.select("session_id", "locator").distinct(), ["session_id", "locator"], "left_semi")


def index(*anchors: DataFrame) -> DataFrame:
    """(session_id, locator): the anchors of several findings or windows, each once."""
    out = anchors[0].select("session_id", "locator")
    for a in anchors[1:]:
        out = out.unionByName(a.select("session_id", "locator"))
    return out.distinct()


def offered(anchors: DataFrame, held: DataFrame) -> DataFrame:
    """The anchors (source_hash, locator) of the sessions that are held, with what is known of these."""
    return anchors.join(held, "source_hash")
