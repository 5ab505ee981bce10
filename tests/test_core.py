"""Goldens and oracle checks of the session operators."""

import datetime as dt

import pytest
from oracle import same
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyloom.functions import grammar, text
from tallyloom.functions.predicates import is_commit, is_review, offset_minutes
from tallyloom.operators import cost, metrics, rules, scoring
from tallyloom.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
EVENT = (
    "session_id string, record long, pos int, ts timestamp, kind string, tool_event string, tool_name string, call_id string, command string, "
    "skill string, success string, is_error string, compaction_phase string, compaction_succeeded boolean, pre_tokens long, text string"
)
T0 = dt.datetime(2026, 8, 1, 9, 0)


def event(record, minutes=0.0, session="s", **more):
    names = [c.split()[0] for c in EVENT.split(", ")]
    row = dict.fromkeys(names) | {"session_id": session, "record": record, "pos": 0, "ts": T0 + dt.timedelta(minutes=minutes)} | more
    return tuple(row[n] for n in names)


def folded(spark, events, agent="claude-code"):
    e = spark.createDataFrame(events, EVENT)
    s = spark.createDataFrame([("s", agent, T0, "r", "h", "Z")], "session_id string, source_agent string, archived_at timestamp, repository string, hostname string, utc_offset string")
    m = metrics.session_metrics(e, s)
    return m.collect()[0], {r.rule: r.fired for r in rules.verdicts(m).collect()}


@pytest.mark.parametrize("name", [n for n in ORACLE_SQL if n not in ("clu1_clusters", "clu3_conversations", "agg32_doctor", "agg33_flows")])
def test_query_equals_its_sql(spark, name):
    same(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)


def test_flows_equal_their_sql(spark):
    same(QUERIES["agg33_flows"](spark, SF), ORACLE_SQL["agg33_flows"], SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_pack_digest_is_the_published_one():
    assert scoring.pack_digest() == "4137a6c61b13e31aa51c9ef181670d23902de391d63220ee5667f76cb50b1f5f"


def test_gap_of_exactly_the_limit_stays_in_the_sitting(spark):
    m, v = folded(spark, [event(k, 15 * k, kind="user", text="x") for k in range(9)])
    assert (m.sittings, m.active_ms, m.longest_sitting_ms) == (1, 7_200_000, 7_200_000)
    assert v["marathon-session"] is False


def test_resumed_session(spark):
    m, v = folded(spark, [event(4 * d + k, 1440 * d + 5 * k, kind="user", text="x") for d in range(6) for k in range(4)])
    assert (m.sittings, m.active_ms, m.span_ms) == (6, 90 * 60_000, (120 * 60 + 15) * 60_000)
    assert v["resumed-session"] is True and round(m.dilution, 1) == 80.2


def test_negative_gaps_count_as_none(spark):
    m, _ = folded(spark, [event(1, 10, kind="user"), event(2, 0, kind="user"), event(3, 5, kind="user")])
    assert (m.sittings, m.active_ms) == (1, 300_000)


def test_one_dated_record_gives_no_reading(spark):
    m, v = folded(spark, [event(1, 0, kind="user")])
    assert m.sittings is None and v["marathon-session"] is None and v["resumed-session"] is None


def test_outcomes_take_the_latest_name_of_their_call(spark):
    e = [event(1, kind="tool", tool_event="tool_use", tool_name="Bash", call_id="a"), event(2, kind="tool", tool_event="tool_result", call_id="a", is_error="true"), event(3, kind="tool", tool_event="tool_result", call_id="b")]
    got = {(r.tool, r.attempts, r.errors) for r in metrics.tool_tally(spark.createDataFrame(e, EVENT)).collect()}
    assert got == {("Bash", 1, 1), (None, 1, 0)}


def test_compactions_are_unreadable_where_the_harness_has_none(spark):
    e = [event(k, compaction_phase="complete", pre_tokens=10 * k) for k in range(1, 5)]
    assert folded(spark, e)[1]["compaction-churn"] is True
    assert folded(spark, e, "codex-cli")[1]["compaction-churn"] is None


def test_unreviewed_ship(spark):
    ship = [event(1, kind="tool", command="git -C x commit -m y")]
    assert folded(spark, ship)[1]["unreviewed-ship"] is True
    assert folded(spark, [*ship, event(2, kind="tool", skill="team/code-review")])[1]["unreviewed-ship"] is False
    assert folded(spark, ship, "copilot-cli")[1]["unreviewed-ship"] is None


@pytest.mark.parametrize(
    ("command", "expected"),
    [("git commit", True), ("sudo git commit -m x", True), ("ls && git commit", True), ("git -c a=b commit", True), ("git -C commit", False), ("git -C commit status", False), ("git log commit", False), ("echo git commit", False), ("git commit-tree", False), ("git --no-pager commit", True), ("a | git commit", True)],
)
def test_commit_commands(spark, command, expected):
    assert spark.range(1).select(is_commit(F.lit(command))).first()[0] is expected


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(is_review(F.lit("a-Review.b"))) and not one(is_review(F.lit("reviewer")))
    assert [one(offset_minutes(F.lit(x))) for x in ("+02:00", "-05:30", "Z", "+2:00", "+25:00")] == [120, -330, 0, None, None]
    assert one(text.shingles(F.array(*map(F.lit, "abc")))) == []
    assert one(text.shingles(F.array(*map(F.lit, "abcde")))) == ["a b c d", "b c d e"]
    assert text.query_terms("What did the Index-cache do, the INDEX?") == ["index", "cache"]
    assert grammar.parse_window("2w").length == dt.timedelta(days=14)
    for bad in ("0d", "3m", "d", "-1d"):
        with pytest.raises(ValueError):
            grammar.parse_window(bad)
    with pytest.raises(ValueError):
        grammar.parse_refresh("59s")


USAGE = "session_id string, record long, message_id string, model string, speed string, service_tier string, inference_geo string, input long, output long, cache_creation long, cache_5m long, cache_1h long, cache_read long"


def test_cost_to_the_cent(spark):
    u = [
        ("s", 1, "m1", "claude-opus-5", "standard", "standard", None, 1_000_000, 100_000, 0, 0, 0, 1_000_000),
        ("s", 2, "m1", "claude-opus-5", "standard", "standard", None, 1_000_000, 100_000, 0, 0, 0, 1_000_000),
        ("s", 3, "m2", "claude-opus-5", "fast", "standard", "us", 100_000, 0, 0, 0, 0, 0),
        ("s", 4, "m3", "<synthetic>", None, None, None, 5, 5, 0, 0, 0, 0),
        ("s", 5, "m4", "nobody", None, None, None, 5, 7, 0, 0, 0, 0),
    ]
    s = spark.createDataFrame([("s", "claude-code", dt.datetime(2026, 8, 1), None)], "session_id string, source_agent string, archived_at timestamp, repository string")
    lines = cost.priced(cost.tallies(spark.createDataFrame(u, USAGE)), s, cost.price_table(spark)).cache()
    got = {(r.model, r.speed): (r.state, r.dollars) for r in lines.collect()}
    assert got["claude-opus-5", "standard"] == ("priced", pytest.approx(5 + 2.5 + 0.5))
    assert got["claude-opus-5", "fast"] == ("priced", pytest.approx(1.1))
    assert got["<synthetic>", None][0] == "unbilled" and got["nobody", None][0] == "unknown-model"
    total = {r.by: r for r in cost.cost_totals(lines).collect() if r.by == "all"}["all"]
    assert total.dollars == pytest.approx(9.1) and total.cache_saving == pytest.approx(4.5)
