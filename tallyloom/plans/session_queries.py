"""Queries over sessions on which every rule fires, over costs at the top tier, friction, boundaries and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom import constants as C
from tallyloom.operators import calendar, cost, evidence, metrics, repetition, rules, scoring, summaries
from tallyloom.plans.queries import _NOW, _SIDED, _SUMMARY_SQL, _metrics, _sided
from tallyloom.plans.registry import query
from tallyloom.sources import bindings as B

_COACHED = f"WITH {B.COACHED_METRICS_SQL}"


def _coached(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = B.coached_events(spark, sf_dir)
    return e, metrics.session_metrics(e, B.sessions(e), B.IDLE_GAP_MS)


@query(f"{_COACHED} SELECT session_id, source_agent, rule, fired FROM v")
def rul1_verdicts(spark, sf_dir):
    """RUL1 to RUL8 on sessions of which some fire and some are clean for every rule."""
    return rules.verdicts(_coached(spark, sf_dir)[1], B.MARATHON_MS).select("session_id", "source_agent", "rule", "fired")


@query(f"{_COACHED} SELECT rule, count(fired) AS eligible, sum(coalesce(fired::INTEGER, 0))::BIGINT AS fired FROM v GROUP BY rule")
def rul1_findings(spark, sf_dir):
    return rules.findings(_coached(spark, sf_dir)[1], B.MARATHON_MS)


_SPAN = lambda ms: f"CASE WHEN {ms} // 1000 < 60 THEN ({ms} // 1000) || 's' WHEN {ms} // 1000 < 3600 THEN ({ms} // 60000) || 'm' ELSE ({ms} // 3600000) || 'h ' || lpad(CAST({ms} // 60000 % 60 AS VARCHAR), 2, '0') || 'm' END"
_TOKENS = lambda n: f"CASE WHEN {n} >= 1000 THEN printf('%.1f', {n} / 1000) || 'k' ELSE CAST({n} AS VARCHAR) END"
_PERCENT = lambda x: f"printf('%.0f', 100 * ({x})) || '%'"
_S = lambda n: f"CASE WHEN {n} = 1 THEN '' ELSE 's' END"


@query(f"""{_COACHED},
    tn AS (SELECT session_id, string_agg(tool || ' ' || errors || ' of ' || attempts || ' calls failed (' || {_PERCENT('errors / attempts')} || ')', '; ' ORDER BY tool) AS named FROM tt WHERE tool IS NOT NULL AND attempts >= 5 AND errors / attempts > 0.30 GROUP BY session_id),
    pt AS (SELECT session_id, count(pre_tokens) AS stated, max(pre_tokens) AS most, sum(pre_tokens)::BIGINT // nullif(count(pre_tokens), 0) AS mean FROM e WHERE compacted AND NOT failed_compaction GROUP BY session_id),
    x AS (SELECT m.*, rule, named, coalesce(stated, 0) AS stated, most, mean FROM v JOIN m USING (session_id) LEFT JOIN tn USING (session_id) LEFT JOIN pt USING (session_id) WHERE fired)
    SELECT session_id, rule, CASE rule
        WHEN 'high-tool-error-rate' THEN concat_ws('; ', CASE WHEN attempts >= 10 AND error_rate > 0.20 THEN 'session-wide ' || errors || ' of ' || attempts || ' calls failed (' || {_PERCENT('error_rate')} || ')' END, named)
        WHEN 'retry-loop' THEN 'one command run ' || busiest_runs || ' times; ' || repeats || ' of ' || command_events || ' command-bearing calls were repeats (' || {_PERCENT('repeats / command_events')} || '), across ' || repeated_commands || ' repeated commands'
        WHEN 'marathon-session' THEN 'longest sitting ' || {_SPAN('longest_sitting_ms')} || ' within a ' || {_SPAN('span_ms')} || ' span across ' || sittings || ' sittings, ' || user_requests || ' user requests, ' || tool_activities || ' tool activities'
        WHEN 'resumed-session' THEN 'active ' || {_SPAN('active_ms')} || ' across ' || sittings || ' sittings, span ' || {_SPAN('span_ms')} || ' (' || CASE WHEN dilution = 'inf'::DOUBLE THEN 'no gap short enough to count as work' ELSE printf('%.1f', dilution) || 'x' END || ')'
        WHEN 'babysitting' THEN user_requests || ' user requests, ' || tool_activities || ' tool activities (' || printf('%.1f', tools_per_request) || ' per request)'
        WHEN 'fire-and-forget' THEN '1 user request, ' || tool_activities || ' tool activities (' || printf('%.1f', tools_per_request) || ' per request), ' || errors || ' of ' || attempts || ' calls failed'
        WHEN 'compaction-churn' THEN 'compacted ' || compactions_completed || ' times' || CASE WHEN compactions_failed > 0 THEN ', ' || compactions_failed || ' further attempt' || {_S('compactions_failed')} || ' failed' ELSE '' END
            || CASE WHEN stated = 0 THEN '; no compaction stated the size of the window it compacted' ELSE '; largest window compacted ' || {_TOKENS('most')} || ' tokens, ' || CASE WHEN stated = compactions_completed THEN 'mean ' || {_TOKENS('mean')} ELSE 'stated on ' || stated || ' of them' END END
        ELSE 'committed ' || commits || ' time' || {_S('commits')} || CASE WHEN skills = 0 THEN '; no skill was invoked at all' ELSE '; no review pass among ' || skills || ' skill invocation' || {_S('skills')} END END AS detail
    FROM x""")
def rul2_evidence(spark, sf_dir):
    """One line of evidence for each session on which a rule fires."""
    e, m = _coached(spark, sf_dir)
    return rules.evidence(m, metrics.tool_tally(e), B.MARATHON_MS)


_PLACES = ", ".join(f"({k}, '{key}', '{title}')" for k, (key, title) in enumerate(C.RULES, 1))


@query(f"""{_COACHED}, r(place, rule, title) AS (VALUES {_PLACES}), f AS (SELECT rule, sum(coalesce(fired::INTEGER, 0)) AS fired, count(*) AS sessions FROM v GROUP BY rule)
    SELECT CAST(place AS BIGINT) AS place, rule, title, fired || ' of ' || sessions AS counts FROM f JOIN r USING (rule) WHERE fired > 0""")
def snk1_stated_findings(spark, sf_dir):
    """The findings of a report in order, with the counts that their sentences state."""
    found = rules.stated(_coached(spark, sf_dir)[1], B.MARATHON_MS)
    return found.select("place", "rule", "title", F.regexp_extract("problem", r"(\d+ of \d+)", 1).alias("counts"))


@query(f"""WITH {B.COACHED_SQL} SELECT session_id, sum(started::INTEGER)::BIGINT AS compactions_started, sum((compacted AND NOT failed_compaction)::INTEGER)::BIGINT AS compactions_completed,
        sum((compacted AND failed_compaction)::INTEGER)::BIGINT AS compactions_failed, count(CASE WHEN compacted AND NOT failed_compaction THEN pre_tokens END) AS pre_tokens_stated,
        max(CASE WHEN compacted AND NOT failed_compaction THEN pre_tokens END)::BIGINT AS pre_tokens_max,
        sum(CASE WHEN compacted AND NOT failed_compaction THEN pre_tokens END)::BIGINT // nullif(count(CASE WHEN compacted AND NOT failed_compaction THEN pre_tokens END), 0) AS pre_tokens_mean
    FROM e WHERE compacted OR started GROUP BY session_id""")
def agg05_started_compactions(spark, sf_dir):
    """Compactions that began, ended and failed, with some of the tokens stated."""
    return metrics.compactions(B.coached_events(spark, sf_dir))


@query(f"""WITH {B.METRICS_SQL}, n AS (SELECT *, lead(starts_at) OVER (PARTITION BY session_id ORDER BY sitting) AS next_at FROM si)
    SELECT session_id, sitting, CAST(ends_at AS VARCHAR)[:19] AS left_at, CAST(next_at AS VARCHAR)[:19] AS back_at FROM n WHERE next_at IS NOT NULL AND sitting <= 3""")
def win2_boundaries(spark, sf_dir):
    """The times of the first breaks between sittings (three here)."""
    b = metrics.sitting_boundaries(B.events(spark, sf_dir), B.IDLE_GAP_MS, 3).select("session_id", F.explode("breaks").alias("b"))
    shown = lambda n: F.date_format(f"b.{n}", "yyyy-MM-dd HH:mm:ss").alias(n)
    return b.select("session_id", "b.sitting", shown("left_at"), shown("back_at"))


@query(f"""WITH {B.METRICS_SQL}, fc AS (SELECT session_id, command, row_number() OVER (PARTITION BY session_id ORDER BY first_locator) AS nth, runs FROM cr),
        f AS (SELECT session_id, sum(CASE WHEN nth > 2 THEN runs ELSE 0 END)::BIGINT AS untracked FROM fc GROUP BY session_id),
        b AS (SELECT session_id, greatest(count(*) - 1 - 2, 0) AS elided FROM si GROUP BY session_id)
    SELECT session_id, coalesce(untracked, 0) AS untracked, elided FROM b LEFT JOIN f USING (session_id)""")
def str7_bounds(spark, sf_dir):
    """What lies beyond a session's bounds is counted: command events after the first distinct ones, breaks after the first (two here)."""
    return metrics.bounds(B.events(spark, sf_dir), commands=2, boundaries=2, idle_gap_ms=B.IDLE_GAP_MS)


# Messages after a failure, and friction.

_TALK = rf"""{_COACHED},
    tx AS (SELECT e.*, CASE WHEN kind = 'user' THEN CASE WHEN k % 10 = 0 THEN '<system-reminder>' ELSE '' END || 'please look into number ' || k || CASE WHEN k % 4 = 0 THEN '' ELSE ' and tell me what is wrong there' END END AS text FROM e),
    au AS (SELECT *, kind = 'user' AND k % 10 <> 0 AS authored, row_number() OVER (PARTITION BY session_id ORDER BY record) AS locator FROM tx),
    st AS (SELECT *, CASE WHEN ok THEN 'ok' WHEN NOT ok THEN 'failed' WHEN authored THEN 'ok' END AS state FROM au),
    be AS (SELECT *, last_value(state IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY record ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM st),
    ms AS (SELECT session_id, locator, authored, authored AND len(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) >= 8 AS clusterable, authored AND coalesce(before = 'failed', false) AS after_error FROM be WHERE kind = 'user')"""


@query(_TALK + " SELECT * FROM ms")
def win6_after_error(spark, sf_dir):
    """Requests that follow a failure, also across messages of the harness."""
    return repetition.read_messages(B.coached_events(spark, sf_dir)).select("session_id", "locator", "authored", "clusterable", "after_error")


@query(_TALK + """, fr AS (SELECT repository, count(*) AS messages, sum(after_error::INTEGER)::BIGINT AS after_error FROM ms JOIN s USING (session_id) WHERE authored GROUP BY repository)
    SELECT CAST(row_number() OVER (ORDER BY repository IS NULL, after_error DESC, messages DESC, repository) AS BIGINT) AS place, * FROM fr""")
def srt7_friction(spark, sf_dir):
    """Friction by repository, in the doctor's order."""
    e = B.coached_events(spark, sf_dir)
    m = repetition.read_messages(e).join(B.sessions(e).select("session_id", "repository"), "session_id")
    return repetition.friction(m)


@query(_TALK + """, re AS (SELECT repository, count(DISTINCT session_id) AS sessions FROM ms JOIN s USING (session_id) WHERE clusterable GROUP BY repository)
    SELECT CAST(row_number() OVER (ORDER BY sessions DESC, repository) AS BIGINT) AS place, repository, sessions FROM re WHERE repository IS NULL OR sessions < 12""")
def srt7_unexamined(spark, sf_dir):
    """Repositories that the doctor doesn't examine (fewer than twelve sessions here, or no name)."""
    e = B.coached_events(spark, sf_dir)
    m = repetition.read_messages(e).filter("clusterable").join(B.sessions(e).select("session_id", F.col("repository").alias("pool")), "session_id")
    return repetition.unexamined(m, 12)


@query(_TALK + """ SELECT session_id, count(*) AS messages, sum(CASE WHEN authored THEN 0 ELSE 1 END)::BIGINT AS harness_generated, sum(after_error::INTEGER)::BIGINT AS after_error, sum(clusterable::INTEGER)::BIGINT AS clusterable FROM ms GROUP BY session_id""")
def agg10_message_counts(spark, sf_dir):
    return repetition.message_counts(repetition.read_messages(B.coached_events(spark, sf_dir)))


# Costs at the top tier.

_TOP_SQL = """
    u AS (SELECT CAST(o_orderkey // 6 AS VARCHAR) AS session_id, o_orderkey, (o_orderkey // 6) % 12 AS j,
                 CAST(o_custkey % 700 AS BIGINT) AS output, CAST(o_orderkey % 1000 AS BIGINT) AS input FROM orders),
    x AS (SELECT *, CASE WHEN j % 3 = 0 THEN 'claude-fable-5' WHEN j % 3 = 1 AND o_orderkey % 2 = 0 THEN 'claude-opus-4-8' WHEN j % 3 = 1 THEN 'claude-fable-5' WHEN j = 2 THEN 'model-x' ELSE 'claude-haiku-4-5-20251001' END AS model,
                 CASE WHEN j IN (6, 7) THEN TIMESTAMP '2026-06-05 00:00:00' ELSE TIMESTAMP '2026-06-20 00:00:00' END AS stamp FROM u),
    p AS (SELECT session_id, model, CASE WHEN model = 'model-x' OR (model = 'claude-fable-5' AND j IN (6, 7)) THEN NULL ELSE
                 (input * CASE model WHEN 'claude-fable-5' THEN 10.0 WHEN 'claude-opus-4-8' THEN 5.0 ELSE 1.0 END + output * CASE model WHEN 'claude-fable-5' THEN 50.0 WHEN 'claude-opus-4-8' THEN 25.0 ELSE 5.0 END) / 1e6 END AS dollars,
                 CASE WHEN stamp >= TIMESTAMP '2026-06-09' THEN 'claude-fable-5' ELSE 'claude-opus-4-8' END AS top, input, output FROM x)"""


def _top_lines(spark, sf_dir: str) -> DataFrame:
    """orders as usage: a session is six order keys, some of its models the day's dearest, some at days before they had a price."""
    j = "(cast(o_orderkey / 6 as bigint) % 12)"
    u = B.table(spark, sf_dir, "orders").selectExpr(
        "cast(cast(o_orderkey / 6 as bigint) as string) as session_id", "cast(o_orderkey as bigint) as record", "cast(o_orderkey as string) as message_id",
        f"case when {j} % 3 = 0 then 'claude-fable-5' when {j} % 3 = 1 and o_orderkey % 2 = 0 then 'claude-opus-4-8' when {j} % 3 = 1 then 'claude-fable-5' when {j} = 2 then 'model-x' else 'claude-haiku-4-5-20251001' end as model",
        "'standard' as speed", "'standard' as service_tier", "'not_available' as inference_geo", "cast(o_orderkey % 1000 as bigint) as input", "cast(o_custkey % 700 as bigint) as output",
        *(f"cast(0 as bigint) as {n}" for n in ("cache_creation", "cache_5m", "cache_1h", "cache_read")), f"{j} as j",
    )
    s = u.groupBy("session_id").agg(F.max("j").alias("j")).selectExpr("session_id", "'claude-code' as source_agent", "if(j in (6, 7), timestamp'2026-06-05 00:00:00', timestamp'2026-06-20 00:00:00') as archived_at", "cast(null as string) as repository")
    return cost.priced(cost.tallies(u.drop("j")), s, cost.price_table(spark))


@query(f"""WITH {_TOP_SQL}, f AS (SELECT session_id, round(sum(dollars), 9) AS dollars, sum(output)::BIGINT AS output, count(*) AS messages, string_agg(DISTINCT model, ',') AS models FROM p
        GROUP BY session_id HAVING bool_and(dollars IS NOT NULL) AND bool_and(model = top) AND sum(output) <= 3000 AND count(*) <= 8)
    SELECT CAST(row_number() OVER (ORDER BY dollars DESC, session_id) AS BIGINT) AS place, *, count(*) OVER () AS found FROM f QUALIFY place <= 20""")
def agg22_premium_listed(spark, sf_dir):
    """AGG22, JOI3 and SRT12: small sessions wholly at the day's top tier, the twenty dearest and how many there are."""
    found = cost.premium_sessions(_top_lines(spark, sf_dir), cost.price_table(spark))
    return cost.listed(found, C.PREMIUM_LISTED).withColumn("dollars", F.round("dollars", 9))


@query(f"""WITH {_TOP_SQL}, t AS (SELECT model, round(sum(dollars), 9) AS dollars, count(*) AS messages FROM p WHERE dollars IS NOT NULL GROUP BY model)
    SELECT CAST(row_number() OVER (ORDER BY dollars DESC, model) AS BIGINT) AS place, model AS label, dollars, messages FROM t""")
def srt10_by_model(spark, sf_dir):
    """Totals by model in the order of reports: dollars, then name."""
    return cost.in_order(cost.cost_totals(_top_lines(spark, sf_dir)), "model").select("place", "label", F.round("dollars", 9).alias("dollars"), "messages")


@query(f"""WITH {_TOP_SQL}, w(name, least) AS (VALUES ('all', 0), ('some', 400), ('none', 10000)), d AS (SELECT name, sum(CASE WHEN CAST(session_id AS BIGINT) % 1000 >= least AND CAST(session_id AS BIGINT) % 2 = 0 THEN dollars END) AS now,
        sum(CASE WHEN CAST(session_id AS BIGINT) % 1000 >= least AND CAST(session_id AS BIGINT) % 2 = 1 THEN dollars END) AS before FROM p, w GROUP BY name)
    SELECT name, CASE WHEN now IS NULL AND before IS NULL THEN 'nothing-priced' ELSE 'compared' END AS state FROM d""")
def agg24_cost_states(spark, sf_dir):
    """Whether the costs of two sides can be compared."""
    lines = _top_lines(spark, sf_dir)
    number = F.col("session_id").cast("long")
    out = None
    for name, least in (("all", 0), ("some", 400), ("none", 10_000)):
        side = F.when(number % 1000 >= least, F.when(number % 2 == 0, "reported").otherwise("comparison"))
        one = cost.comparison(lines.withColumn("side", side)).select(F.lit(name).alias("name"), "state")
        out = one if out is None else out.unionByName(one)
    return out


# Orders, unions and joins of reports.

@query(f"""WITH {_SUMMARY_SQL}, r AS (SELECT source AS repository, count(*) AS sessions FROM sm WHERE NOT placeholder GROUP BY 1)
    SELECT CAST(row_number() OVER (ORDER BY repository IS NULL, sessions DESC, repository) AS BIGINT) AS place, repository, sessions FROM r""")
def srt3_standup_order(spark, sf_dir):
    return summaries.standup_repositories(B.summaries(spark, sf_dir), placed=True)


@query(f"""WITH {B.METRICS_SQL}, l AS (SELECT DISTINCT repository AS label FROM m WHERE archived_at >= TIMESTAMP '2024-01-11 00:00:00' UNION SELECT DISTINCT source FROM documents WHERE doc_id % 29 <> 0)
    SELECT label FROM l WHERE label IS NOT NULL""")
def set1_scope_labels(spark, sf_dir):
    """The labels of all sections of a payload: sessions on both sides, and the standup."""
    placed = _sided(spark, sf_dir).filter("side <> 'unplaceable'").select(F.col("repository").alias("label"))
    told = summaries.standup_sessions(B.summaries(spark, sf_dir)).select(F.col("repository").alias("label"))
    return calendar.labels(placed, told)


@query(_SIDED + " SELECT string_agg(DISTINCT source_agent, ',' ORDER BY source_agent) AS harnesses FROM ms WHERE side IN ('reported', 'comparison')")
def set6_harness_columns(spark, sf_dir):
    """The columns of a table of harnesses: those of either side."""
    m = _sided(spark, sf_dir)
    now, before = (m.filter(F.col("side") == s) for s in ("reported", "comparison"))
    return calendar.labels(now.select(F.col("source_agent").alias("label")), before.select(F.col("source_agent").alias("label"))).agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("harnesses"))


_PUBLISHED = f"""WITH {B.METRICS_SQL},
    fl AS (SELECT tl.session_id, tl.tool_ordinal AS locator FROM tl JOIN named USING (session_id, record) WHERE NOT named.ok),
    ea AS (SELECT session_id, locator FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY locator) AS nth FROM fl) WHERE nth <= 10),
    ca AS (SELECT session_id, locator FROM (SELECT tl.session_id, tool_ordinal AS locator, row_number() OVER (PARTITION BY tl.session_id ORDER BY tool_ordinal) AS nth FROM tl JOIN cc ON cc.session_id = tl.session_id AND cc.busiest_command = tl.command) WHERE nth <= 10),
    pa AS (SELECT * FROM ea UNION SELECT * FROM ca)"""


def _anchors(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = B.events(spark, sf_dir)
    return evidence.any_failures(evidence.failures(e)).select("session_id", "locator"), evidence.busiest_runs(e).select("session_id", "locator")


@query(_PUBLISHED + " SELECT session_id, CAST(locator AS BIGINT) AS locator FROM pa")
def set7_anchor_index(spark, sf_dir):
    """The anchors of several findings as one index."""
    return evidence.index(*_anchors(spark, sf_dir))


@query(_PUBLISHED + " SELECT sha256(pa.session_id) AS source_hash, CAST(locator AS BIGINT) AS locator, source_agent, repository FROM pa JOIN s USING (session_id) WHERE hostname IS NOT NULL")
def joi6_offered(spark, sf_dir):
    """Anchors of the sessions that are held, by the hash of their transcripts."""
    index = evidence.index(*_anchors(spark, sf_dir)).select(F.sha2("session_id", 256).alias("source_hash"), "locator")
    held = B.sessions(B.events(spark, sf_dir)).filter("hostname is not null").select(F.sha2("session_id", 256).alias("source_hash"), "source_agent", "repository")
    return evidence.offered(index, held)


@query(_COACHED + ", f AS (SELECT rule, repository, source_agent, count(*) AS sessions FROM v WHERE fired GROUP BY ALL) SELECT rule, repository AS scope, source_agent, sessions FROM f")
def joi7_scope_findings(spark, sf_dir):
    """Findings by repository and harness."""
    e, m = _coached(spark, sf_dir)
    fired = rules.verdicts(m, B.MARATHON_MS, ("session_id",)).filter("fired")
    return rules.findings_by_scope(fired, m.select("session_id", F.col("repository").alias("scope"), "source_agent"))


@query(f"""WITH {B.METRICS_SQL}, gp AS (SELECT CASE WHEN repository IS NULL THEN 'no-repository' WHEN hostname IS NULL THEN 'no-device' END AS reason FROM m)
    SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, reason) AS BIGINT) AS place, reason, count(*) AS sessions FROM gp WHERE reason IS NOT NULL GROUP BY reason""")
def agg30_gaps(spark, sf_dir):
    """What was left out and why, the most frequent reason first."""
    reason = F.when(F.col("repository").isNull(), "no-repository").when(F.col("hostname").isNull(), "no-device")
    return calendar.gaps(_metrics(spark, sf_dir).select(reason.alias("reason")).filter("reason is not null"))


@query(f"""WITH {B.METRICS_SQL}, w(name, days) AS (VALUES ('7d', 7), ('30d', 30), ('90d', 90)), x AS (SELECT w.name, m.*, CASE WHEN archived_at >= TIMESTAMP '{_NOW}' - to_days(days) THEN 'reported' WHEN archived_at >= TIMESTAMP '{_NOW}' - to_days(2 * days) THEN 'comparison' END AS side FROM m, w)
    SELECT name AS "window", side, count(*) AS sessions, sum(attempts)::BIGINT AS attempts FROM x WHERE side IS NOT NULL GROUP BY 1, 2""")
def fil6_windows(spark, sf_dir):
    """FIL6 and STR5: one fold cut for several trailing windows; what lies outside both halves is dropped, not counted."""
    m = calendar.in_windows(_metrics(spark, sf_dir), ("7d", "30d", "90d"), dt.datetime.fromisoformat(_NOW))
    return m.groupBy("window", "side").agg(F.count(F.lit(1)).alias("sessions"), F.sum("attempts").alias("attempts"))


@query(f"SELECT '{scoring.pack_digest()}' AS computed, '4137a6c61b13e31aa51c9ef181670d23902de391d63220ee5667f76cb50b1f5f' AS published WHERE '{scoring.pack_digest()}' = '4137a6c61b13e31aa51c9ef181670d23902de391d63220ee5667f76cb50b1f5f'")
def fun20_pack_digest(spark, sf_dir):
    """The digest of rules, thresholds and weights, beside the published one."""
    return spark.range(1).select(F.lit(scoring.pack_digest()).alias("computed"), F.lit("4137a6c61b13e31aa51c9ef181670d23902de391d63220ee5667f76cb50b1f5f").alias("published"))


# Streams, drained into tables.

@query("""WITH g AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, lag(CAST(ts AS TIMESTAMP)) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM events),
        n AS (SELECT *, sum(CASE WHEN ts - was <= INTERVAL 3 HOURS THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM g)
    SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(min(ts) AS VARCHAR)[:19] AS starts_at, CAST(max(ts) AS VARCHAR)[:19] AS ends_at, count(*) AS records FROM n GROUP BY user_id, nth""")
def str3_sittings(spark, sf_dir):
    """Gap windows of a stream over the events."""
    from tallyloom.streaming.sessions import drained, sitting_windows

    rows = _event_stream(spark, sf_dir).selectExpr("cast(user_id as string) as session_id", "cast(ts as timestamp) as ts")
    out = drained(sitting_windows(rows, "3 hours"), "str3", "complete")
    shown = lambda n: F.date_format(n, "yyyy-MM-dd HH:mm:ss").alias(n)
    return out.select("session_id", shown("starts_at"), shown("ends_at"), "records")


def _event_stream(spark, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*").parquet(f"{sf_dir}/")


@query("""SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(max(event_id) AS VARCHAR) AS snapshot_id, CAST(max(ts) AS VARCHAR)[:19] AS completed_at FROM events GROUP BY user_id""")
def str6_latest(spark, sf_dir):
    """Snapshots as they stream in: a session's newest one replaces the others."""
    from tallyloom.shared import table_path
    from tallyloom.streaming.sessions import keep_latest, published

    rows = _event_stream(spark, sf_dir).selectExpr("cast(user_id as string) as session_id", "lpad(cast(event_id as string), 12, '0') as snapshot_id", "cast(ts as timestamp) as completed_at")
    path = table_path(spark, "latest")
    keep_latest(rows, path, f"{path}-marks").awaitTermination()
    out = spark.read.parquet(f"{path}/v={published(rows, path)}")
    return out.select("session_id", F.col("snapshot_id").cast("long").cast("string").alias("snapshot_id"), F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss").alias("completed_at"))


@query("""SELECT * FROM (VALUES (0, (SELECT count(*) FROM events), false, 'page of generation 0'), (1, (SELECT count(*) FROM events), true, 'page of generation 0'), (2, (SELECT count(*) FROM events), false, 'page of generation 2')) t(generation, events, stale, body)""")
def str1_refreshes(spark, sf_dir):
    """STR1 and STR2: generations of a payload; the second build fails, so the first body is published again as stale."""
    from tallyloom.shared import table_path
    from tallyloom.streaming.sessions import generations, refresh_once

    path = table_path(spark, "payload")
    n = B.table(spark, sf_dir, "events").count()

    def build(number: int) -> str:
        if number == 1:
            raise RuntimeError("the archive doesn't answer")
        return f"page of generation {number}"

    for number in range(3):
        refresh_once(spark, path, number, lambda number=number: build(number))
    return generations(spark, path).select("generation", F.lit(n).alias("events"), F.col("stale_since").isNotNull().alias("stale"), "body")
