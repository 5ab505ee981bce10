"""Conversations against brute force, and queries on clusters that read the documents once."""

import random
from itertools import combinations

import pytest

SF = "/root/testdata/sf0.001"


def _brute(size, sets):
    parent = {s: s for s in size}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for a, b in combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared >= 3 and shared * 100 >= 50 * min(size[a], size[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {s: root(s) for s in size}


def _tables(spark, size, sets):
    messages = spark.createDataFrame([("all", s) for s, n in size.items() for _ in range(n)], "pool string, session_id string")
    return messages, spark.createDataFrame([("all", s, c) for s, x in sets.items() for c in x], "pool string, session_id string, cluster long")


def test_conversations_equal_brute_force(spark):
    from tallyloom.operators import repetition

    rnd = random.Random(3)
    sets = {f"s{i:03d}": set(rnd.sample(range(9 if i % 2 else 60), rnd.randint(1, 7))) for i in range(150)}
    size = {s: len(x) + rnd.choice((0, 0, 1, 4, 12)) for s, x in sets.items()} | {"alone": 2}
    found = {r.session_id: r.conversation for r in repetition.conversations(*_tables(spark, size, sets)).collect()}
    assert found == _brute(size, sets) and 1 < len(set(found.values())) < len(found)


@pytest.mark.parametrize("least, joined", [(6, True), (7, False)])
def test_sessions_with_equal_clusters_are_linked_without_pairs(spark, monkeypatch, least, joined):
    from tallyloom.operators import repetition

    links, plain = [], repetition.components
    monkeypatch.setattr(repetition, "components", lambda edges: links.append(edges.count()) or plain(edges))
    sets = {f"s{i:03d}": {1, 2, 3} for i in range(200)}
    found = repetition.conversations(*_tables(spark, {s: 9 for s in sets} | {"s150": least}, sets)).collect()
    assert links == [0] and {r.conversation for r in found} == ({"s000"} if joined else set(sets))


def test_harness_openings_after_white_space(spark):
    from pyspark.sql import functions as F

    from tallyloom import constants as C
    from tallyloom.functions.predicates import authored

    texts = [*C.HARNESS_PREFIXES, *(f" \n\t {p}x" for p in C.HARNESS_PREFIXES), *(f"a {p}" for p in C.HARNESS_PREFIXES), "", " ", None]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", authored(F.col("text")).alias("a")).orderBy("i").collect()
    assert [r.a for r in found] == [None if t is None else not t.strip().startswith(C.HARNESS_PREFIXES) for t in texts]


#: Queries whose result reads tables in the shared folder only; recomputed clusters would read the documents again.
ONCE = ["clu3_conversations", "srt4_citations", "srt8_flow_order", "srt9_flow_instances", "agg33_flows"]


@pytest.mark.parametrize("name", ONCE)
def test_documents_are_read_once(spark, name):
    from __spark_entry__ import queries

    assert not [f for f in queries()[name](spark, SF).inputFiles() if "documents.parquet" in f]


def test_words_of_plain_and_other_texts_are_alike(spark):
    from pyspark.sql import functions as F

    from tallyloom.functions.text import words

    texts = ["", " ", "One two-THREE_4", "a\x00b\x7fc\td", "Ünï 4½ x²", "İstanbul Kelvin", "ß ẞ ﬁ", "...", "日本 語a", "I'ḿ ok", None]
    plain = F.filter(F.split(F.lower("text"), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")
    found = spark.createDataFrame([(t,) for t in texts], "text string").select("text", words(F.col("text")).alias("new"), plain.alias("old")).collect()
    assert len(found) == len(texts) and [r.new for r in found] == [r.old for r in found] and [r.new for r in found if r.text == "One two-THREE_4"] == [["one", "two", "three", "4"]]


def test_messages_are_split_once(spark):
    from pyspark.sql import functions as F

    from tallyloom.operators import repetition

    m = repetition.clusterable(spark.createDataFrame([("a b c d e f g h",), ("a b",), (None,)], "text string"))
    assert "split(" not in m._jdf.queryExecution().optimizedPlan().toString().split("Filter (size(words")[0] and "Filter (size(words" in m._jdf.queryExecution().optimizedPlan().toString()
    assert [r.words for r in m.select(F.size("words").alias("words")).collect()] == [8]


@pytest.mark.parametrize("name", ["srt9_flow_instances", "agg33_flows"])
def test_texts_that_no_result_needs_are_not_stored(spark, monkeypatch, name):
    from __spark_entry__ import queries
    from tallyloom.operators import repetition

    stored, plain = [], repetition.stored
    monkeypatch.setattr(repetition, "stored", lambda m: stored.append(m.columns) or plain(m))
    queries()[name](spark, SF)
    assert len(stored) == 1 and "text" not in stored[0]


def test_light_phrases_are_found_in_two_messages_or_more_and_not_in_too_many(spark):
    from collections import Counter

    from tallyloom.operators import repetition

    rnd = random.Random(5)
    sets = {k: sorted(rnd.sample(range(40), 6) + rnd.sample(range(100, 900), 3)) for k in range(80)} | {200: [-1, 5], 201: [-1, 5], 202: [-(1 << 63), (1 << 63) - 1], 203: [-(1 << 63)], 204: []}
    rows = [("all", k, s, len(s), hash(tuple(s)) & 0xFFFFFFFF, 7) for k, s in sets.items()]
    m = spark.createDataFrame(rows, "pool string, id long, hashes array<long>, n_phrases int, one long, two long")
    often = Counter(p for s in sets.values() for p in s)
    reps = {tuple(s): k for k, s in reversed(sets.items())}
    want = {k: (sum(tuple(x) == s for x in sets.values()), len(s), light) for s, k in reps.items() if (light := [p for _, p in sorted((often[p], p) for p in s if 2 <= often[p] <= 12)])}
    member, light = repetition.wordings(m, 12)
    assert {r.wording: (r.copies, r.n_phrases, r.light) for r in light.collect()} == want and max(often.values()) > 12
    assert {r.id: r.wording for r in member.collect()} == {k: reps[tuple(s)] for k, s in sets.items()}


def test_long_chains_end_in_few_rounds(spark):
    from tallyloom.operators.components import components

    names = list(range(600))
    random.Random(4).shuffle(names)
    chains = [names[:500], names[500:598], names[598:]]
    edges = spark.createDataFrame([(a, b) for c in chains for a, b in zip(c, c[1:])], "a long, b long")
    assert {r.vertex: r.component for r in components(edges, 8).collect()} == {v: min(c) for c in chains for v in c}


def test_all_phrases_count_where_no_bound_is_given(spark):
    """Families of edited copies, long ones that hold a family's phrases, and single ones, against brute force."""
    from tallyloom.operators import repetition

    rnd = random.Random(6)
    sets = {k: {1000 * (k % 3) + p for p in range(12) if rnd.random() < 0.7} | {10_000 + rnd.randrange(40) for _ in range(rnd.choice((0, 1, 3, 9)))} for k in range(160)}
    sets |= {200 + k: set(range(1000 * (k % 3), 1000 * (k % 3) + 12)) | set(range(20_000 + 30 * k, 20_030 + 30 * k)) for k in range(6)} | {300: {1, 2, 3, 4}, 301: {1, 2, 3, 4}, 302: {-5}, 303: {-5}, 304: {-6}}
    sets = {k: sorted(s or {-7}) for k, s in sets.items()}
    label = {k: k for k in sets}
    for a, b in combinations(sorted(sets), 2):
        if len(set(sets[a]) & set(sets[b])) * 100 >= 60 * min(len(sets[a]), len(sets[b])) and label[a] != label[b]:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {k: new if v == old else v for k, v in label.items()}
    size = {v: list(label.values()).count(v) for v in label.values()}
    m = spark.createDataFrame([("all", k, s, len(s), hash(tuple(s)) & 0xFFFFFFFF, 7) for k, s in sets.items()], "pool string, id long, hashes array<long>, n_phrases int, one long, two long")
    member, light = repetition.wordings(m, None)
    for many in (2, 20, 1000):
        found = {r.vertex: r.component for r in repetition.linked_wordings(light, many=many).collect()}
        assert {r.id: found[r.wording] for r in member.collect() if r.wording in found} == {k: v for k, v in label.items() if size[v] > 1}


def test_flows_of_requests_in_more_messages_than_the_bound(spark, tmp_path):
    """Two requests in 205 documents each: none of their phrases is in 200 messages or fewer."""
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    lines = ["please run all the tests again and show me what fails", "then write one small commit for every finding you have settled"]
    text = ["\n".join([*lines, f"only here {n} " + " ".join(f"w{n}x{k}" for k in range(8))]) for n in range(205)]
    spark.createDataFrame([(n, "web", t) for n, t in enumerate(text)], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = [tuple(r) for r in queries()["agg33_flows"](spark, str(tmp_path)).select("steps", "width", "occurrences", "conversations").collect()]
    assert found == con.execute(f"select steps, width, occurrences, conversations from ({oracle_sql()['agg33_flows']})").fetchall() == [("0>1", 2, 205, 205)]
