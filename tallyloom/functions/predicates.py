"""Predicates and projections over typed events, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom import constants as C

#: A shell command word sequence that commits. The group is atomic and the repetition possessive, so an argument of -C
#: or -c is never given back and taken for the word commit.
COMMIT = r"^\s*(?:sudo \s*)?git(?:\s+(?>-[Cc](?=\s|$)(?:\s+\S+)?|-\S*))*+\s+commit(?:\s|$)"
_PARTS = r"\n|\r|&&|;|\|"


def harness(agent: Column) -> Column:
    """copilot, claude, codex or null."""
    out = F.lit(None).cast("string")
    for kind in ("copilot", "claude", "codex"):
        out = F.when(agent.isin([k for k, v in C.HARNESSES.items() if v == kind]), kind).otherwise(out)
    return out


def is_commit(command: Column) -> Column:
    """Whether any part of a command line is a git commit."""
    return F.exists(F.split(command, _PARTS), lambda p: p.rlike(COMMIT))


def is_review(skill: Column) -> Column:
    """Whether a skill's name has the part review."""
    return F.exists(F.split(F.lower(skill), r"[-_/. ]"), lambda p: p == "review")


def outcome(success: Column, tool_event: Column, is_error: Column) -> Column:
    """True, false, or null where the event states no outcome."""
    return F.when(success.isNotNull(), success == "true").when(tool_event == "tool_result", ~is_error.eqNullSafe("true"))


def compaction_observable(agent: Column) -> Column:
    return F.coalesce(harness(agent).isin(*C.COMPACTION_OBSERVABLE), F.lit(False))


def review_observable(agent: Column) -> Column:
    return F.coalesce(harness(agent).isin(*C.REVIEW_OBSERVABLE), F.lit(False))


def billing_signal(agent: Column) -> Column:
    """api, tokens-only or null."""
    return F.when(harness(agent) == "claude", "api").when(harness(agent) == "copilot", "tokens-only")


def authored(text: Column) -> Column:
    """Whether a message opens with none of the harnesses' own openings."""
    return ~F.rlike(text, F.lit(r"(?U)^\s*+(?:" + "|".join(map(re.escape, C.HARNESS_PREFIXES)) + ")"))  # one pass over a text, not one per opening


def placement(archived_at: Column, opens_at: Column, comparison_opens_at: Column | None) -> Column:
    """reported, comparison or unplaceable; no upper bound."""
    out = F.when(archived_at >= opens_at, "reported")
    if comparison_opens_at is not None:
        out = out.when(archived_at >= comparison_opens_at, "comparison")
    return out.otherwise("unplaceable")


def identifier(name: Column) -> Column:
    """The name if it is 1 to 64 characters without controls, bars and backticks."""
    return F.when(name.rlike(r"\A[^\p{Cc}|\x60]{1,64}\z"), name).otherwise("invalid-identifier")


def is_locator(text: Column) -> Column:
    return text.rlike(r"\A[1-9][0-9]{0,8}\z")


def is_digest(text: Column) -> Column:
    return text.rlike(r"\A[0-9a-f]{64}\z")


def is_snapshot_id(text: Column) -> Column:
    return text.rlike(r"\A[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z")


def offset_minutes(offset: Column) -> Column:
    """Signed minutes of +HH:MM, -HH:MM or Z; null for anything else."""
    ok = offset.rlike(r"\A[+-]([01][0-9]|2[0-3]):[0-5][0-9]\z")
    minutes = F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 5, 2).cast("int")
    return F.when(offset == "Z", 0).when(ok, F.when(F.startswith(offset, F.lit("-")), -minutes).otherwise(minutes))
