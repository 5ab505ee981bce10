"""Views of session_metrics by day, hour, repository and device."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom import constants as C
from tallyloom.functions.predicates import offset_minutes
from tallyloom.operators.scoring import lane_scores
from tallyloom.shared import cut


def _sum(name: str):
    return F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name)


def totals(metrics: DataFrame) -> DataFrame:
    """One row over all sessions."""
    m = metrics.agg(F.count(F.lit(1)).alias("sessions"), *(_sum(n) for n in ("user_requests", "assistant_messages", "tool_activities", "attempts", "errors", "command_events", "repeats", "commits", "review_passes")), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    return m.withColumn("error_rate", F.when(F.col("attempts") > 0, F.col("errors") / F.col("attempts")))


def agents(metrics: DataFrame) -> DataFrame:
    """(source_agent, sessions)."""
    return metrics.groupBy("source_agent").agg(F.count(F.lit(1)).alias("sessions"))


def busiest_tools(tally: DataFrame, most: int = C.TOOLS_LISTED) -> DataFrame:
    """Tools by attempts, then name; the first `most`."""
    return tally.filter("tool is not null").groupBy("tool").agg(F.sum("attempts").alias("attempts"), F.sum("errors").alias("errors")).orderBy(F.desc("attempts"), "tool").limit(most)


def cadence(metrics: DataFrame) -> DataFrame:
    """One row: dated and undated sessions, active days, the busiest day (the latest of equals), lower medians, longest."""
    metrics = cut(metrics.select("first_at", "active_ms", "span_ms"), "cadence")
    day = F.to_date("first_at")
    days = metrics.filter("first_at is not null").groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    top = days.agg(F.count(F.lit(1)).alias("days"), F.max(F.struct("n", "day")).alias("top")).select("days", F.col("top.day").cast("string").alias("busiest_day"), F.col("top.n").alias("busiest_sessions"))
    rest = metrics.agg(F.count("first_at").alias("dated"), F.sum(F.col("first_at").isNull().cast("long")).alias("undated"), F.max("active_ms").alias("longest_active_ms"), F.sum("active_ms").alias("total_active_ms"))
    out = rest.crossJoin(top)  # one row each
    for name in ("active_ms", "span_ms"):
        out = out.crossJoin(lower_median(metrics, name).withColumnRenamed("median", f"median_{name}"))
    return out.select("dated", "undated", "median_active_ms", "median_span_ms", "longest_active_ms", "total_active_ms", "days", "busiest_day", "busiest_sessions")


def lower_median(df: DataFrame, name: str, step: int = 60_000) -> DataFrame:
    """(median,): the value at place (n - 1) / 2 of the sorted ones, null without any.

    Values are counted by steps (minutes), a small table that finds the step of the median; only that step's values are
    counted one by one, so no task holds all of them.
    """
    values = df.filter(F.col(name).isNotNull()).select(F.col(name).cast("long").alias("value"), F.floor(F.col(name) / step).alias("step"))
    running = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = values.groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    place = F.floor((F.sum("n").over(Window.partitionBy(F.lit(1))) - 1) / 2)
    at = steps.withColumn("place", place).withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0))).filter("before <= place and place < before + n").select("step", (F.col("place") - F.col("before")).alias("left"))
    inside = values.join(F.broadcast(at), "step").groupBy("left", "value").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return inside.withColumn("before", before).filter("before <= left and left < before + n").agg(F.max("value").alias("median"))


def timeline(metrics: DataFrame) -> DataFrame:
    """(day, source_agent, sessions, active_seconds): seconds are floored for each session; the day is null if undated."""
    return metrics.groupBy(F.to_date("archived_at").cast("string").alias("day"), "source_agent").agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum(F.floor(F.col("active_ms") / 1000)), F.lit(0)).cast("long").alias("active_seconds"))


def heatmap(metrics: DataFrame) -> DataFrame:
    """(weekday, hour, source_agent, state, sessions): the first activity in its own offset; Monday is 0.

    state is placed, no_offset or undated, in that order of precedence for what can't be placed.
    """
    minutes = offset_minutes(F.col("utc_offset"))
    local = F.timestamp_micros(F.unix_micros("first_at") + minutes.cast("long") * 60_000_000)
    state = F.when(minutes.isNull(), "no_offset").when(F.col("first_at").isNull(), "undated").otherwise("placed")
    placed = state == "placed"
    slot = metrics.select(F.when(placed, F.weekday(local)).cast("long").alias("weekday"), F.when(placed, F.hour(local)).cast("long").alias("hour"), "source_agent", state.alias("state"))
    return slot.groupBy("weekday", "hour", "source_agent", "state").agg(F.count(F.lit(1)).alias("sessions"))


def scopes(metrics: DataFrame, label: str, marathon_ms: int = C.MARATHON_SITTING_MS) -> DataFrame:
    """(label, side, sessions, lane, score): lane scores of a repository or device on both sides of the comparison.

    metrics has a side column (reported, comparison). Scores are the unweighted mean over harnesses.
    """
    n = metrics.groupBy(label, "side").agg(F.count(F.lit(1)).alias("sessions"))
    scores = lane_scores(metrics, [label, "side", "source_agent"], marathon_ms).filter("score is not null")
    mean = scores.groupBy(label, "side", "lane").agg(F.round(F.avg("score")).cast("long").alias("score"))
    a, b = n.alias("n"), mean.alias("m")
    return a.join(b, F.col(f"n.{label}").eqNullSafe(F.col(f"m.{label}")) & (F.col("n.side") == F.col("m.side")), "left").select(F.col(f"n.{label}").alias("label"), "n.side", "n.sessions", "m.lane", "m.score")


def compare_sides(metrics: DataFrame, label: str) -> DataFrame:
    """(label, reported, comparison): sessions of each side, aligned; a side without the label is null."""
    side = lambda s: metrics.filter(F.col("side") == s).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias(s))
    a, b = side("reported").alias("a"), side("comparison").alias("b")
    return a.join(b, F.col("a.label").eqNullSafe(F.col("b.label")), "full_outer").select(F.coalesce("a.label", "b.label").alias("label"), "reported", "comparison")


def devices(metrics: DataFrame, now) -> DataFrame:
    """(hostname, sessions, harnesses, last_at, silent_days): silent_days is null below SILENT_DAYS whole days."""
    days = F.floor((F.unix_seconds(now) - F.unix_seconds(F.max("archived_at"))) / 86400)
    return (
        metrics.filter("hostname is not null")
        .groupBy("hostname")
        .agg(F.count(F.lit(1)).alias("sessions"), F.array_join(F.sort_array(F.collect_set("source_agent")), ",").alias("harnesses"), F.max("archived_at").alias("last_at"), days.alias("days"))
        .withColumn("silent_days", F.when(F.col("days") >= C.SILENT_DAYS, F.col("days")))
        .drop("days")
    )


def landing(metrics: DataFrame, listed: DataFrame) -> DataFrame:
    """(day, hostname, sessions): archived sessions of the devices in `listed` (hostname); others are dropped."""
    return metrics.join(listed.select("hostname").distinct(), "hostname", "left_semi").groupBy(F.to_date("archived_at").cast("string").alias("day"), "hostname").agg(F.count(F.lit(1)).alias("sessions"))


def gaps(skips: DataFrame) -> DataFrame:
    """(place, reason, sessions) of what was left out, most frequent first."""
    found = skips.groupBy("reason").agg(F.count(F.lit(1)).alias("sessions"))
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("sessions"), "reason")).cast("long"))  # one row per reason


def labels(*sections: DataFrame) -> DataFrame:
    """The distinct labels (column label) of several sections; none for what has no name."""
    out = sections[0].select("label")
    for s in sections[1:]:
        out = out.unionByName(s.select("label"))
    return out.filter("label is not null").distinct()


def in_windows(metrics: DataFrame, windows: tuple[str, ...], now) -> DataFrame:
    """metrics once for each trailing window and its side; what lies outside both halves of a window is dropped there."""
    from tallyloom.functions.grammar import parse_window

    cuts = [(w, parse_window(w).opens_at(now), parse_window(w).comparison_opens_at(now)) for w in windows]
    side = lambda opens, before: F.when(F.col("archived_at") >= F.lit(opens), "reported").when(F.col("archived_at") >= F.lit(before), "comparison")
    rows = F.array(*(F.struct(F.lit(w).alias("window"), side(opens, before).alias("side")) for w, opens, before in cuts))
    return metrics.withColumn("cut", F.explode(F.filter(rows, lambda r: r["side"].isNotNull()))).select("*", "cut.window", "cut.side").drop("cut")


def latest(listing: DataFrame) -> DataFrame:
    """One row per session: its newest snapshot (a session archived again moves wholesale)."""
    w = Window.partitionBy("session_id").orderBy(F.desc_nulls_last("completed_at"), F.desc("snapshot_id"))
    return listing.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")
