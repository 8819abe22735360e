"""Ranked search against a plain version of the score."""

import math
import re
from collections import Counter

import pytest

from dealtide.llm import ranked
from tests.llm import brute

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain(docs, items, top=10):
    held = [(i, TERM.findall(brute.lower(t or ""))) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n_docs, total = len(held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(TERM.findall(brute.lower(t or "")))
    out = []
    for item, terms in queries.items():
        scores = []
        for i, words in held:
            m = 10 + (90 * len(words) * n_docs) // total
            tf = Counter(words)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m))
                for t in terms
                if tf[t]
            )
            if score > 0:
                scores.append((-score, i is not None, i or 0))
        for rank, (score, known, i) in enumerate(sorted(scores)[:top], 1):
            out.append((item, rank, i if known else None, -score))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.fixture
def items(spark, rows):
    texts = [t for _, t in rows if t]
    listed = [(k, texts[3 * k % len(texts)][50 * k : 50 * k + 160]) for k in range(25)]
    # One id with two texts, one without, terms that no document has, and a very long text.
    listed += [(7, "another text of item seven"), (30, None), (31, ""), (32, "zzzqqq xxxyyy"), (None, "no id 日本語")]
    listed += [(33, " ".join(texts))]
    return listed


@pytest.mark.parametrize("bucket,head", [(4096, 4096), (16, 3)])
def test_ranks_equal_a_plain_search(spark, docs, rows, items, monkeypatch, bucket, head):
    monkeypatch.setattr(ranked, "BUCKET", bucket)
    monkeypatch.setattr(ranked, "HEAD", head)
    # Copies of one document tie at the last places.
    copies = [(20_000 + k, rows[5][1]) for k in range(40)]
    more = spark.createDataFrame(copies, "doc_id bigint, text string")
    queries = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, score string")
    got = ranked.search(docs.unionByName(more, allowMissingColumns=True), queries)
    assert found(got) == plain(rows + copies, items)


def test_items_in_several_blocks(spark, docs, rows, items, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_BYTES", 2000)
    queries = spark.createDataFrame(items[:12], "item_id bigint, text string")
    assert found(ranked.search(docs, queries, top=3)) == plain(rows, items[:12], top=3)


def test_empty_tables(spark, docs, no_docs, items):
    queries = spark.createDataFrame(items, "item_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert ranked.search(no_docs, queries).collect() == []
    assert ranked.search(docs, none).collect() == []
    assert ranked.search(docs, spark.createDataFrame([(1, None)], none.schema)).collect() == []
    assert ranked.search(docs, none).columns == ["item_id", "rank", "doc_id", "score"]


def test_many_ties_and_few_rare_terms(spark):
    """Hundreds of documents share the last places; the smallest ids have them."""
    rows = [(k, f"common words here {'rare' if k == 5 else 'usual'}{k % 50} end") for k in range(600)]
    items = [(0, "rare5 end"), (1, "usual7 words")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    queries = spark.createDataFrame(items, "item_id bigint, text string")
    assert found(ranked.search(docs, queries)) == plain(rows, items)
