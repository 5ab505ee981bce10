"""The fold of typed events to one row per session.

events: one row per event of a record, with
session_id, source_agent, record, pos, ts, kind (user, assistant, tool or null), tool_event, tool_name, call_id, command,
skill, success, is_error (strings or null), compaction_phase, compaction_succeeded, pre_tokens.
Order within a session is (record, pos), never time: records may be out of order and negative gaps count as none.
All windows share one hash partitioning by session_id, and so do both aggregations of session_metrics: the fold is one
shuffle of the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom import constants as C
from tallyloom.functions.predicates import compaction_observable, is_commit, is_review, outcome, review_observable


def _n(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def with_outcomes(events: DataFrame) -> DataFrame:
    """events with ok (tri-state outcome), tool (name as of the latest invocation of the call id) and ordinals.

    An event's own name wins; an outcome without a name takes the latest name given for its call id so far.
    """
    order = [F.col("record"), F.col("pos")]
    call = Window.partitionBy("session_id", "call_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    session = Window.partitionBy("session_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = F.when(F.col("call_id").isNotNull(), F.last("tool_name", ignorenulls=True).over(call))
    is_tool = F.coalesce(F.col("kind") == "tool", F.lit(False))
    return (
        events.withColumn("ok", F.when(is_tool, outcome(F.col("success"), F.col("tool_event"), F.col("is_error"))))
        .withColumn("tool", F.when(is_tool, F.coalesce("tool_name", earlier)))
        .withColumn("tool_ordinal", F.when(is_tool, F.sum(is_tool.cast("long")).over(session)))
        .withColumn("event_ordinal", F.when(F.col("kind").isNotNull(), F.sum(F.col("kind").isNotNull().cast("long")).over(session)))
    )


def tool_tally(events: DataFrame) -> DataFrame:
    """(session_id, tool, attempts, errors): events with an explicit outcome only; a null tool is unattributed."""
    return with_outcomes(events).filter("ok is not null").groupBy("session_id", "tool").agg(F.count(F.lit(1)).alias("attempts"), _n(~F.col("ok")).alias("errors"))


def command_runs(events: DataFrame) -> DataFrame:
    """(session_id, command, runs, first_locator)."""
    return with_outcomes(events).filter("command is not null").groupBy("session_id", "command").agg(F.count(F.lit(1)).alias("runs"), F.min("tool_ordinal").alias("first_locator"))


def command_churn(events: DataFrame) -> DataFrame:
    """Per session: command_events, distinct_commands, repeats, repeated_commands, busiest_runs, busiest_command.

    Of commands run equally often the one that came first is the busiest.
    """
    busiest = F.max(F.struct("runs", (-F.col("first_locator")).alias("sooner"), "command"))
    return (
        command_runs(events)
        .groupBy("session_id")
        .agg(
            F.sum("runs").alias("command_events"),
            F.count(F.lit(1)).alias("distinct_commands"),
            F.sum(F.col("runs") - 1).alias("repeats"),
            _n(F.col("runs") > 1).alias("repeated_commands"),
            F.max("runs").alias("busiest_runs"),
            busiest["command"].alias("busiest_command"),
        )
    )


def sittings(events: DataFrame, idle_gap_ms: int = C.IDLE_GAP_MS) -> DataFrame:
    """(session_id, sitting, starts_at, ends_at, active_ms, records): dated records without a gap above idle_gap_ms."""
    w = Window.partitionBy("session_id").orderBy("record")
    dated = events.filter("ts is not null").groupBy("session_id", "record").agg(F.min("ts").alias("ts"))
    gap = F.greatest(F.unix_millis("ts") - F.lag(F.unix_millis("ts")).over(w), F.lit(0))
    return (
        dated.withColumn("gap", gap)
        .withColumn("sitting", F.sum(F.when(F.col("gap") > idle_gap_ms, 1).otherwise(0)).over(w).cast("long") + 1)
        .groupBy("session_id", "sitting")
        .agg(
            F.min_by("ts", "record").alias("starts_at"),
            F.max_by("ts", "record").alias("ends_at"),
            F.sum(F.when(F.col("gap") <= idle_gap_ms, F.col("gap")).otherwise(0)).cast("long").alias("active_ms"),
            F.count(F.lit(1)).alias("records"),
        )
    )


def activity(events: DataFrame, idle_gap_ms: int = C.IDLE_GAP_MS) -> DataFrame:
    """Per session with two dated records or more: active_ms, sittings, longest_sitting_ms."""
    return (
        sittings(events, idle_gap_ms)
        .groupBy("session_id")
        .agg(F.sum("active_ms").alias("active_ms"), F.count(F.lit(1)).alias("sittings"), F.max("active_ms").alias("longest_sitting_ms"), F.sum("records").alias("dated"))
        .filter("dated >= 2")
        .drop("dated")
    )


def sitting_boundaries(events: DataFrame, idle_gap_ms: int = C.IDLE_GAP_MS, most: int = C.MAX_SITTING_BOUNDARIES) -> DataFrame:
    """Per session the first `most` breaks between sittings and how many more there were."""
    w = Window.partitionBy("session_id").orderBy("sitting")
    s = sittings(events, idle_gap_ms).withColumn("next_at", F.lead("starts_at").over(w)).filter("next_at is not null")
    kept = F.sort_array(F.collect_list(F.when(F.col("sitting") <= most, F.struct("sitting", F.col("ends_at").alias("left_at"), F.col("next_at").alias("back_at")))))
    return s.groupBy("session_id").agg(kept.alias("breaks"), _n(F.col("sitting") > most).alias("elided"))


def compactions(events: DataFrame) -> DataFrame:
    """Per session: started, completed (not known to have failed), failed, stated, most and mean tokens before."""
    done = F.col("compaction_phase") == "complete"
    failed = done & F.col("compaction_succeeded").eqNullSafe(False)
    good = done & ~F.col("compaction_succeeded").eqNullSafe(False)
    stated = F.when(good, F.col("pre_tokens"))
    return (
        events.filter("compaction_phase is not null")
        .groupBy("session_id")
        .agg(
            _n(F.col("compaction_phase") == "start").alias("compactions_started"),
            _n(good).alias("compactions_completed"),
            _n(failed).alias("compactions_failed"),
            F.count(stated).alias("pre_tokens_stated"),
            F.max(stated).alias("pre_tokens_max"),
            F.expr("sum(case when compaction_phase = 'complete' and not (compaction_succeeded <=> false) then pre_tokens end) div nullif(count(case when compaction_phase = 'complete' and not (compaction_succeeded <=> false) then pre_tokens end), 0)").alias("pre_tokens_mean"),
        )
    )


def session_metrics(events: DataFrame, sessions: DataFrame, idle_gap_ms: int = C.IDLE_GAP_MS) -> DataFrame:
    """One row per session of `sessions` (session_id, source_agent, archived_at, repository, hostname, utc_offset).

    Counts that a harness can't express are null, never zero: commands where it records none, compactions and reviews
    where it isn't observable, activity with fewer than two dated records. One windowed pass marks each event with its
    outcome, tool, ordinals, gap and sitting; each then counts for its sitting, tool and command at once, and a session is the sum of its sittings.
    """
    order = [F.col("record"), F.col("pos")]
    session = Window.partitionBy("session_id").orderBy(*order)
    before = session.rowsBetween(Window.unboundedPreceding, -1)
    told = F.last(F.when(F.col("ts").isNotNull(), F.col("record")), ignorenulls=True).over(before)  # all events of a record have its time
    dated = F.when(F.col("ts").isNotNull() & ~told.eqNullSafe(F.col("record")), F.col("ts"))
    gap = F.greatest(F.unix_millis("at") - F.unix_millis("was"), F.lit(0))
    e = (
        with_outcomes(events)
        .withColumn("at", dated)
        .withColumn("was", F.last("at", ignorenulls=True).over(before))
        .withColumn("gap", F.when(F.col("at").isNotNull(), gap))
        .withColumn("sitting", F.sum(F.when(F.col("gap") > idle_gap_ms, 1).otherwise(0)).over(session.rowsBetween(Window.unboundedPreceding, 0)))
    )
    is_kind = lambda k: F.coalesce(F.col("kind") == k, F.lit(False))
    phase, good = F.col("compaction_phase"), ~F.col("compaction_succeeded").eqNullSafe(False)
    stated = F.when((phase == "complete") & good, F.col("pre_tokens"))
    one = lambda of, label, when: F.when(when, F.struct(F.lit(of).alias("of"), label.cast("string").alias("label")))
    of = F.array(
        one("sitting", F.col("sitting"), F.lit(True)),
        one("tool", F.col("tool"), F.col("ok").isNotNull()),
        one("command", F.col("command"), F.col("command").isNotNull()),
    )
    # a session's events are together: neither of the two aggregations moves them again
    parts = (
        e.withColumn("part", F.explode(F.filter(of, lambda x: x.isNotNull())))
        .groupBy("session_id", "part.of", "part.label")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("at").alias("dated"),
            _n(is_kind("user")).alias("user"),
            _n(is_kind("assistant")).alias("assistant"),
            _n(is_kind("tool")).alias("tools"),
            F.min("ts").alias("first_at"),
            F.max("ts").alias("last_at"),
            _n(F.coalesce(is_commit(F.col("command")), F.lit(False))).alias("commits"),
            F.count("skill").alias("skills"),
            _n(F.coalesce(is_review(F.col("skill")), F.lit(False))).alias("review_passes"),
            _n(F.coalesce(~F.col("ok"), F.lit(False))).alias("errors"),
            F.min("tool_ordinal").alias("first_locator"),
            F.sum(F.when(F.col("gap") <= idle_gap_ms, F.col("gap")).otherwise(0)).cast("long").alias("active_ms"),
            _n(phase == "start").alias("started"),
            _n((phase == "complete") & good).alias("completed"),
            _n((phase == "complete") & ~good).alias("failed"),
            F.max(stated).alias("pre_tokens_max"),
            F.sum(stated).alias("pre_tokens_sum"),
            F.count(stated).alias("pre_tokens_stated"),
        )
    )
    c = F.col
    at = lambda of, x: F.when(c("of") == of, x)
    sums = {n: F.sum(at("sitting", c(old))).alias(n) for n, old in {"user_requests": "user", "assistant_messages": "assistant", "tool_activities": "tools", "commits": "commits", "skills": "skills", "review_passes": "review_passes", "compactions_started": "started", "compactions_completed": "completed", "compactions_failed": "failed"}.items()}
    worst = (c("n") >= C.MIN_TOOL_ATTEMPTS) & (c("errors") / c("n") > C.TOOL_ERROR_RATE) & c("label").isNotNull()
    busiest = F.max(at("command", F.struct(c("n").alias("runs"), (-c("first_locator")).alias("sooner"), c("label").alias("command"))))
    folded = parts.groupBy("session_id").agg(
        *sums.values(),
        F.min(at("sitting", c("first_at"))).alias("first_at"),
        F.max(at("sitting", c("last_at"))).alias("last_at"),
        F.max(at("sitting", c("pre_tokens_max"))).alias("pre_tokens_max"),
        F.sum(at("sitting", c("pre_tokens_sum"))).alias("pre_tokens_sum"),
        F.sum(at("sitting", c("pre_tokens_stated"))).alias("pre_tokens_stated"),
        F.sum(at("tool", c("n"))).alias("attempts"),
        F.sum(at("tool", c("errors"))).alias("errors"),
        F.max(at("tool", worst.cast("int"))).alias("bad_tool"),
        F.sum(at("command", c("n"))).alias("command_events"),
        F.nullif(F.count(at("command", F.lit(1))), F.lit(0)).alias("distinct_commands"),
        F.sum(at("command", c("n") - 1)).alias("repeats"),
        F.sum(at("command", (c("n") > 1).cast("long"))).alias("repeated_commands"),
        busiest["runs"].alias("busiest_runs"),
        busiest["command"].alias("busiest_command"),
        F.sum(at("sitting", c("dated"))).alias("dated"),
        F.sum(at("sitting", c("active_ms"))).alias("active_ms"),
        F.count(at("sitting", F.when(c("dated") > 0, 1))).alias("sittings"),
        F.max(at("sitting", c("active_ms"))).alias("longest_sitting_ms"),
    )
    measurable = F.coalesce(c("dated") >= 2, F.lit(False))
    folded = folded.withColumns({n: F.when(measurable, c(n)) for n in ("active_ms", "sittings", "longest_sitting_ms")}).withColumn("pre_tokens_mean", F.expr("pre_tokens_sum div nullif(pre_tokens_stated, 0)")).drop("dated", "pre_tokens_sum")
    out = sessions.join(folded, "session_id", "left")
    zero = lambda *names: {n: F.coalesce(F.col(n), F.lit(0).cast("long")) for n in names}
    out = out.withColumns(zero("user_requests", "assistant_messages", "tool_activities", "attempts", "errors", "commits", "skills", "review_passes"))
    out = out.withColumn("span_ms", F.unix_millis("last_at") - F.unix_millis("first_at"))
    observable = compaction_observable(F.col("source_agent"))
    for n in ("compactions_started", "compactions_completed", "compactions_failed"):
        out = out.withColumn(n, F.when(observable, F.coalesce(F.col(n), F.lit(0).cast("long"))))
    return (
        out.withColumn("bad_tool", F.coalesce(F.col("bad_tool"), F.lit(0)) == 1)
        .withColumn("review_observable", review_observable(F.col("source_agent")))
        .withColumn("error_rate", F.when(F.col("attempts") > 0, F.col("errors") / F.col("attempts")))
        .withColumn("tools_per_request", F.when(F.col("user_requests") > 0, F.col("tool_activities") / F.col("user_requests")))
        .withColumn("repeat_share", F.when(F.col("command_events") > 0, F.col("repeats") / F.col("command_events")))
        .withColumn("dilution", F.when(F.col("active_ms") > 0, F.col("span_ms") / F.col("active_ms")).when((F.col("active_ms") == 0) & (F.col("span_ms") > 0), F.lit(float("inf"))))
    )


def bounds(events: DataFrame, commands: int = C.MAX_TRACKED_COMMANDS, boundaries: int = C.MAX_SITTING_BOUNDARIES, idle_gap_ms: int = C.IDLE_GAP_MS) -> DataFrame:
    """(session_id, untracked, elided): what a reader that keeps only so much of a session would leave out, as counts.

    untracked are runs of commands after the first `commands` distinct ones, elided are breaks after the first
    `boundaries`. Nothing is left out here: commands and sittings are rows.
    """
    first = Window.partitionBy("session_id").orderBy("first_locator")
    runs = command_runs(events).withColumn("nth", F.row_number().over(first)).groupBy("session_id").agg(F.sum(F.when(F.col("nth") > commands, F.col("runs")).otherwise(0)).cast("long").alias("untracked"))
    breaks = sittings(events, idle_gap_ms).groupBy("session_id").agg(F.greatest(F.count(F.lit(1)) - 1 - boundaries, F.lit(0)).cast("long").alias("elided"))
    return breaks.join(runs, "session_id", "full_outer").select("session_id", *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("untracked", "elided")))
