"""Mixing of sources against a plain version and the oracle."""

import hashlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from dealtide.llm import mixing
from dealtide.llm.queries import ORACLES, QUERIES
from tests.compare import connect, duckdb_rows, spark_rows
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, source string, size string, `_range` string, target string, key string"


def plain(rows, weights=(1, 2, 3), epochs=3):
    """rows: doc_id, text, source. The targets are found by raising a level step by step."""
    sized = [(i, s, len(brute.WORD.findall(t or ""))) for i, t, s in rows]
    whole = Counter()
    for _, s, n in sized:
        whole[s] += n
    order = sorted(whole, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, full = {}, set()
    while True:
        rest = sum(whole.values()) - sum(epochs * whole[s] for s in full)
        shares = sum(weight[s] for s in order if s not in full)
        target = {
            s: Fraction(epochs * whole[s]) if s in full else Fraction(rest * weight[s], shares)
            for s in order
        }
        above = {s for s in order if target[s] > epochs * whole[s]}
        if not above:
            break
        full |= above
    out = []
    held = defaultdict(list)
    for i, s, n in sized:
        key = hashlib.md5(("0" if i is None else f"0:{i}").encode()).hexdigest()[:15]
        held[s].append((int(key, 16), i is not None, i or 0, n))
    for s, docs in held.items():
        budget, before = int(target[s]), 0
        times = budget // max(whole[s], 1)
        for _, known, i, n in sorted(docs):
            more = min(max(budget - times * whole[s] - before, 0), n)
            out.append((i if known else None, n, whole[s], float(target[s]), times * n + more))
            before += n
    return Counter(out)


def taken(df):
    return Counter(
        (r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in df.collect()
    )


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)


def test_the_mix_equals_a_plain_one(spark, rows):
    # One source holds a third, one has no words, one is small and far above its limit; a row is repeated.
    sources = ["hot", "hot", "a", "b", None, "é", "z"]
    listed = [(i, t, sources[(i or 0) % 7]) for i, t in rows]
    listed += [(8000 + k, " ", "empty") for k in range(3)] + [(8100, "three words here", "little")]
    assert taken(mixing.mixture(frame(spark, listed))) == plain(listed)


def test_a_doc_id_of_a_third_of_all_rows(spark):
    listed = [(7, "one two three", "a")] * 60 + [(i, "word " * i, "ab"[i % 2]) for i in range(100)]
    assert taken(mixing.mixture(frame(spark, listed))) == plain(listed)


def test_an_empty_table_and_one_without_words(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.mixture(none).collect() == []
    got = mixing.mixture(frame(spark, [(1, None, None), (2, "", "a")]))
    assert taken(got) == Counter({(1, 0, 0, 0.0, 0): 1, (2, 0, 0, 0.0, 0): 1})


def test_weights_by_name_and_the_texts_of_the_mix(spark):
    long = "\tw" * 60_000
    listed = [(1, "a b c", "x"), (2, "d\n e  f g", "x"), (3, long, "y"), (4, "left out", "z")]
    docs = frame(spark, listed)
    weights = spark.createDataFrame([("x", 1), ("y", 9999), ("w", 5)], "source string, weight int")
    plan = mixing.mixture(docs, weights)
    by_id = {r.doc_id: r for r in plan.collect()}
    assert by_id[4].taken == 0 and by_id[4].target == 0
    assert by_id[1].taken + by_id[2].taken == int(by_id[1].target)
    assert by_id[3].taken == int(by_id[3].target) <= 3 * 60_000
    out = mixing.mixed(docs, plan).collect()
    words = Counter()
    for r in out:
        words[r.doc_id] += len(r.text.split())
        whole = dict((i, t) for i, t, _ in listed)[r.doc_id]
        assert whole.startswith(r.text)
    assert words == Counter({i: r.taken for i, r in by_id.items() if r.taken})
    assert sorted((r.doc_id, r.epoch) for r in out) == sorted(set((r.doc_id, r.epoch) for r in out))


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = mixing.mixture(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("name", ["op12_source_mixing", "op13_ranked_search"])
def test_queries_equal_their_oracles(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    ours = spark_rows(QUERIES[name](spark, sf_dir))
    theirs = duckdb_rows(connect(sf_dir), ORACLES[name])
    assert ours == theirs and ours[1]
