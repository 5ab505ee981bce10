"""Eight rules with three-valued verdicts: null is not looked at, false is looked at and clean, true fires."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom import constants as C
from tallyloom.functions import display


def verdict_columns(marathon_ms: int = C.MARATHON_SITTING_MS) -> dict[str, Column]:
    """One nullable boolean for each rule key over the columns of session_metrics."""
    c = F.col
    least = min(C.MIN_TOOL_ATTEMPTS, C.MIN_SESSION_TOOL_ATTEMPTS)
    over = (c("attempts") >= C.MIN_SESSION_TOOL_ATTEMPTS) & (c("error_rate") > C.SESSION_TOOL_ERROR_RATE)
    ratio = c("tools_per_request")
    return {
        "high-tool-error-rate": F.when(c("attempts") >= least, F.coalesce(over, F.lit(False)) | c("bad_tool")),
        "retry-loop": F.when(c("command_events") > 0, c("busiest_runs") >= C.RETRY_LOOP_REPEATS),
        "marathon-session": F.when(c("longest_sitting_ms").isNotNull(), c("longest_sitting_ms") > marathon_ms),
        "resumed-session": F.when(
            c("span_ms").isNotNull() & c("active_ms").isNotNull() & c("dilution").isNotNull(),
            (c("dilution") >= C.RESUMED_SPAN_TO_ACTIVE) & (c("sittings") >= C.RESUMED_MIN_SITTINGS),
        ),
        "babysitting": F.when(c("user_requests") >= C.BABYSITTING_MIN_USER_REQUESTS, ratio < C.BABYSITTING_TOOLS_PER_REQUEST),
        "fire-and-forget": F.when(c("user_requests") == C.FIRE_AND_FORGET_USER_REQUESTS, (ratio >= C.FIRE_AND_FORGET_TOOLS_PER_REQUEST) & (c("errors") > 0)),
        "compaction-churn": F.when(c("compactions_completed").isNotNull(), c("compactions_completed") >= C.COMPACTION_CHURN_COMPLETIONS),
        "unreviewed-ship": F.when(c("review_observable") & (c("commits") > 0), c("review_passes") == 0),
    }


def verdicts(metrics: DataFrame, marathon_ms: int = C.MARATHON_SITTING_MS, keep: tuple[str, ...] = ("session_id", "source_agent", "repository", "hostname", "archived_at")) -> DataFrame:
    """(*keep, rule, fired), long form."""
    rows = F.array(*(F.struct(F.lit(k).alias("rule"), v.alias("fired")) for k, v in verdict_columns(marathon_ms).items()))
    return metrics.select(*keep, F.explode(rows).alias("v")).select("*", "v.rule", "v.fired").drop("v")


def findings(metrics: DataFrame, marathon_ms: int = C.MARATHON_SITTING_MS) -> DataFrame:
    """(rule, eligible, fired): how many sessions were looked at and how many of them fired."""
    return verdicts(metrics, marathon_ms).groupBy("rule").agg(F.count("fired").alias("eligible"), F.sum(F.coalesce(F.col("fired").cast("long"), F.lit(0))).alias("fired"))


#: How a column of session_metrics is shown in a line of evidence; others are whole numbers.
_SHOWN = {
    **dict.fromkeys(("longest_sitting_ms", "active_ms", "span_ms"), lambda x: display.span(int(x))),
    **dict.fromkeys(("error_rate", "repeat_share"), display.percent),
    **dict.fromkeys(("pre_tokens_max", "pre_tokens_mean"), lambda x: display.tokens(int(x))),
    "tools_per_request": display.ratio,
    "dilution": lambda x: C.EVIDENCE_PARTS["never"] if x == float("inf") else f"{display.ratio(x)}x",
}
_READ = (
    "attempts", "errors", "error_rate", "busiest_runs", "repeats", "command_events", "repeated_commands", "repeat_share", "longest_sitting_ms", "active_ms", "span_ms", "sittings", "user_requests", "tool_activities", "dilution",
    "tools_per_request", "compactions_completed", "compactions_failed", "pre_tokens_max", "pre_tokens_mean", "pre_tokens_stated", "commits", "skills",
)


def _line(session: dict) -> str:
    """What made a session match: counts and names of tools, never what was said."""
    known = {n: session[n] for n in _READ if not pd.isna(session[n])}
    shown = {n: _SHOWN.get(n, lambda x: str(int(x)))(x) for n, x in known.items()}
    number = lambda n: int(known.get(n, 0))
    shown |= {f"plural_{to}": "" if number(n) == 1 else "s" for to, n in (("commits", "commits"), ("skills", "skills"), ("failed", "compactions_failed"))}
    part = lambda name: C.EVIDENCE_PARTS[name].format_map(shown)
    if session["rule"] == "high-tool-error-rate":
        over = [{"tool": part("session"), "errors": number("errors"), "attempts": number("attempts")}] if session["wholly"] else []
        rows = ({"name": t["tool"], "errors": t["errors"], "attempts": t["attempts"], "error_rate": display.percent(t["errors"] / t["attempts"])} for t in [*over, *session["tools"]])
        return "; ".join(C.EVIDENCE["high-tool-error-rate"].format_map(r) for r in rows)
    stated = number("pre_tokens_stated")
    shown["attempts_failed"] = part("failed") if number("compactions_failed") else ""
    shown["window"] = part("window-none" if not stated else "window-mean" if stated == number("compactions_completed") else "window-some")
    shown["skills_run"] = part("skills" if number("skills") else "no-skill")
    return C.EVIDENCE[session["rule"]].format_map(shown)


def evidence(metrics: DataFrame, tally: DataFrame, marathon_ms: int = C.MARATHON_SITTING_MS) -> DataFrame:
    """(session_id, rule, detail): one line for each session on which a rule fires.

    tally is tool_tally of the same events: the tools over their threshold are named in order. Only sessions that match
    reach Python, as Arrow batches.
    """
    over = (F.col("attempts") >= C.MIN_TOOL_ATTEMPTS) & (F.col("errors") / F.col("attempts") > C.TOOL_ERROR_RATE) & F.col("tool").isNotNull()
    named = tally.filter(over).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("tool", "errors", "attempts"))).alias("tools"))
    fired = verdicts(metrics, marathon_ms, ("session_id", *_READ)).filter("fired").join(named, "session_id", "left")
    wholly = F.coalesce((F.col("attempts") >= C.MIN_SESSION_TOOL_ATTEMPTS) & (F.col("error_rate") > C.SESSION_TOOL_ERROR_RATE), F.lit(False))
    read = fired.select("session_id", "rule", *_READ, wholly.alias("wholly"), F.coalesce("tools", F.array().cast("array<struct<tool:string,errors:bigint,attempts:bigint>>")).alias("tools"))

    @F.pandas_udf("string")
    def detail(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([_line(r) for r in rows.to_dict("records")], dtype=object)

    return read.select("session_id", "rule", detail(F.struct("rule", *_READ, "wholly", "tools")).alias("detail"))


def stated(metrics: DataFrame, marathon_ms: int = C.MARATHON_SITTING_MS) -> DataFrame:
    """(place, rule, title, problem, action) of the rules that fire, in the order of reports."""
    n = F.col("sessions").cast("string")
    sentences = F.create_map(*(x for k, (problem, action) in C.ADVICE.items() for x in (F.lit(k), F.struct(F.lit(problem).alias("problem"), F.lit(action).alias("action")))))
    titles = F.create_map(*(F.lit(x) for pair in C.RULES for x in pair))
    order = F.array(*(F.lit(k) for k, _ in C.RULES))
    found = verdicts(metrics, marathon_ms).groupBy("rule").agg(F.count_if(F.col("fired")).alias("fired"), F.count(F.lit(1)).alias("sessions")).filter("fired > 0")
    problem = F.replace(F.replace(sentences[F.col("rule")]["problem"], F.lit("{fired}"), F.col("fired").cast("string")), F.lit("{sessions}"), n)
    return found.select(F.array_position(order, F.col("rule")).cast("long").alias("place"), "rule", titles[F.col("rule")].alias("title"), problem.alias("problem"), sentences[F.col("rule")]["action"].alias("action"))


def findings_by_scope(fired: DataFrame, tags: DataFrame) -> DataFrame:
    """(rule, scope, source_agent, sessions): verdicts that fired (session_id, rule) by the scope and harness of their session."""
    return fired.select("session_id", "rule").join(tags, "session_id", "left").groupBy("rule", "scope", "source_agent").agg(F.count(F.lit(1)).alias("sessions"))
