"""The registered queries against their SQL, and the pipeline against its stages done by hand."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from oracle import same
from test_operators import WORDS, brute_exact, brute_near

import corpus_pipeline
from tallyloom.llm import op3_fertility
from tallyloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    same(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)


def test_pipeline(spark):
    from tallyloom.llm.bpe import read_vocabulary

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    f = op3_fertility.Fertility(read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), read_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    docs = [d for d in docs if f.judge(d[1], d[2])[6]]
    stay = {x[0] for x in brute_exact(docs) if x[3]}
    docs = [d for d in docs if d[0] in stay]
    docs = [d for d, (i, _, c) in zip(docs, brute_near(docs, 5), strict=True) if i == c]
    size = {d[0]: len(WORDS.findall(d[1])) for d in docs}
    total = Counter()
    for d in docs:
        total[d[3]] += size[d[0]]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(total))}
    capped: set = set()
    while True:
        level = (1.5 * sum(total.values()) - sum(2 * total[s] for s in capped)) / sum(w for s, w in weight.items() if s not in capped)
        target = {s: 2 * total[s] if s in capped else level * w for s, w in weight.items()}
        more = {s for s in target if s not in capped and target[s] > 2 * total[s]}
        if not more:
            break
        capped |= more
    want = Counter()
    for s in total:
        goal = int(target[s] + 0.5)
        rest = goal % total[s]
        for d in sorted((d for d in docs if d[3] == s), key=lambda d: hashlib.md5(f"mix:{d[0]}".encode()).hexdigest()):
            part = min(size[d[0]], rest)
            rest -= part
            want[d[0]] += goal // total[s] * size[d[0]] + part
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {d[0]: d[1] for d in docs}
    tokens = Counter()
    for i, n in want.items():
        whole = n // size[i]
        tokens[i] += whole * (len(t.encode(text[i], add_special_tokens=False).ids) + 1)
        if n % size[i]:
            tokens[i] += len(t.encode(" ".join(WORDS.findall(text[i])[: n % size[i]]), add_special_tokens=False).ids) + 1
    got = Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] += r.length
    assert +got == +tokens


def test_stages_take_any_rows(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, names that clash with those made on the way, no rows."""
    from test_operators import corpus

    prose = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").limit(40).collect()
    rows = [(k, t, lang, source, 7, "x", "y", "z") for k, t, lang, source, *_ in corpus(n=20)]
    rows += [(1000 + k, r.text, r.lang, "s1", 7, None, "y", "z") for k, r in enumerate(prose)]
    rows += [(2000, prose[0].text, "en", None, None, "x", None, None), (1001, prose[1].text, "en", "s1", 7, "x", "y", "z"), (None, prose[2].text * 50, None, None, None, None, None, None), (3000, None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, bucket string, TAKEN string, stays string"
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema).repartition(3)
        counts = []
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, SF)
            after = spark.createDataFrame(found.collect(), found.schema)
            assert name == "packing" or after.columns == docs.columns
            docs = after
            counts.append(docs.count())
        assert (counts[0] < len(rows) and counts[1] < counts[0] and counts[4] >= counts[3] > 0) if data else not any(counts)
