"""Search over session summaries, the verbatim dig behind it, and the narrative of recent work.

summaries: (source_hash, archived_at, title, repository, tags, goal, decisions, open_items, files_changed,
work_completed, commands_and_validation, branch, placeholder); lists are arrays of strings, the rest strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom import constants as C
from tallyloom.functions.redact import scrubbed
from tallyloom.functions.text import excerpt, query_terms, snippet
from tallyloom.shared import cut

LISTS = ("tags", "decisions", "open_items", "files_changed", "work_completed", "commands_and_validation")


def _entries(field: str) -> Column:
    """A field as a list of entries."""
    return F.coalesce(F.col(field), F.array().cast("array<string>")) if field in LISTS else F.filter(F.array(field), lambda x: x.isNotNull())


def ask(summaries: DataFrame, question: str, limit: int = C.DEFAULT_ASK_LIMIT, redact: bool = True) -> DataFrame:
    """(place, source_hash, score, snippet, total_matches), best first: score, newest, hash.

    A term scores a field's weight once if any entry contains it, on the raw text. The snippet comes from the first
    quotable field that matched, else from the first field that did; it is scrubbed whole before it is cut, since a
    secret that is cut in two isn't found. Summaries are read once: what matched is written and ranked from there.
    """
    terms = query_terms(question)
    if not terms:
        return summaries.sparkSession.createDataFrame([], "place int, source_hash string, score long, snippet string, total_matches long")
    score = F.lit(0)
    quotes: dict[bool, list[Column]] = {True: [], False: []}
    for name, weight, quotable in C.ASK_FIELDS:
        entries = _entries(name)
        for t in terms:
            score = score + F.when(F.exists(entries, _has([t])), weight).otherwise(0)
        match = F.filter(entries, _has(terms))
        quotes[quotable].append(F.get(match, F.lit(0)))
    quote = F.coalesce(*quotes[True], *quotes[False])
    hits = cut(summaries.filter(~F.coalesce("placeholder", F.lit(False))).select("source_hash", "archived_at", score.cast("long").alias("score"), quote.alias("quote")).filter("score > 0"), "hits")
    total = hits.agg(F.count(F.lit(1)).alias("total_matches"))
    top = hits.orderBy(F.desc("score"), F.desc_nulls_last("archived_at"), "source_hash").limit(limit)
    place = F.row_number().over(Window.orderBy(F.desc("score"), F.desc_nulls_last("archived_at"), "source_hash"))  # over `limit` rows
    shown = snippet(scrubbed(F.col("quote"))["text"] if redact else F.col("quote"))
    return top.crossJoin(total).select(place.alias("place"), "source_hash", "score", shown.alias("snippet"), "total_matches")


def _has(terms: list[str]):
    """A test of one entry: whether it contains any of the terms."""
    return lambda e: _any([F.contains(F.lower(e), F.lit(t)) for t in terms])


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def verbatim(lines: DataFrame, question: str, most: int = C.VERBATIM_LINES, redact: bool = True) -> DataFrame:
    """(session_id, locator, line_no, excerpt, total): per session the first lines that contain any term.

    lines: (session_id, locator, line_no, line). An empty question gives no rows. A line is scrubbed before it is cut.
    """
    terms = query_terms(question)
    if not terms:
        return lines.sparkSession.createDataFrame([], "session_id string, locator long, line_no long, excerpt string, total long")
    hit = lines.filter(_any([F.contains(F.lower("line"), F.lit(t)) for t in terms]))
    w = Window.partitionBy("session_id")
    return (
        hit.withColumn("nth", F.row_number().over(w.orderBy("locator", "line_no")))
        .withColumn("total", F.count(F.lit(1)).over(w))
        .filter(F.col("nth") <= most)
        .withColumn("line", scrubbed(F.col("line"))["text"] if redact else F.col("line"))
        .select("session_id", "locator", "line_no", excerpt(F.col("line"), terms).alias("excerpt"), "total")
    )


def standup_sessions(summaries: DataFrame) -> DataFrame:
    """Sessions of a repository in reading order: (repository, place, source_hash, title, goal), newest first."""
    w = Window.partitionBy("repository").orderBy(F.desc_nulls_last("archived_at"), "source_hash")
    return summaries.filter(~F.coalesce("placeholder", F.lit(False))).withColumn("place", F.row_number().over(w).cast("long"))


def standup_repositories(summaries: DataFrame, placed: bool = False) -> DataFrame:
    """(repository, sessions): the unattributed last, then by sessions and name; with place where it is asked for."""
    found = summaries.filter(~F.coalesce("placeholder", F.lit(False))).groupBy("repository").agg(F.count(F.lit(1)).alias("sessions"))
    order = [F.col("repository").isNull(), F.desc("sessions"), F.col("repository")]
    return found.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")) if placed else found.orderBy(*order)


def roll_up(summaries: DataFrame, field: str) -> DataFrame:
    """(repository, text, place, at): the distinct entries of a list field, at their first appearance in reading order."""
    e = standup_sessions(summaries).select("repository", "place", F.posexplode(_entries(field)).alias("at", "text"))
    w = Window.partitionBy("repository", "text").orderBy("place", "at")
    return e.withColumn("nth", F.row_number().over(w)).filter("nth = 1").select("repository", "text", "place", F.col("at").cast("long").alias("at"))


def standup_gaps(summaries: DataFrame) -> DataFrame:
    """(reason, sessions): summaries that give no narrative."""
    return summaries.filter(F.coalesce("placeholder", F.lit(False))).groupBy(F.lit("placeholder").alias("reason")).agg(F.count(F.lit(1)).alias("sessions"))


def escalate(hits: DataFrame, lines: DataFrame, question: str, most: int = C.VERBATIM_LINES, redact: bool = True) -> DataFrame:
    """(place, session_id, locator, line_no, excerpt, total): the verbatim lines of the sessions behind ask's hits.

    lines: (source_hash, session_id, locator, line_no, line). Only the sessions of hits (a bounded number) are searched;
    a hit whose session has no matching line, or no lines, stays with nulls.
    """
    wanted = hits.select("place", "source_hash")
    own = lines.join(wanted.select("source_hash"), "source_hash", "left_semi")
    found = verbatim(own.drop("source_hash"), question, most, redact)
    named = wanted.join(own.select("source_hash", "session_id").distinct(), "source_hash", "left")
    return named.join(found, "session_id", "left").select("place", "session_id", "locator", "line_no", "excerpt", "total")
