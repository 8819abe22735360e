"""Spelling variants against a plain search of all pairs of near words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from dealtide.llm import spelling
from tests.llm import brute

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_words(rows, garbled=31, least=7):
    n = Counter()
    for i, text in rows:
        for run in RUN.findall(brute.lower(text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % garbled == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def plain(n, ratio=10):
    """By the words less a letter: at one place for replaced letters, as words for inserted ones."""
    replaced, near = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            rest = w[:k] + w[k + 1 :]
            replaced[k, rest].add(w)
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    for held in replaced.values():
        for w in held:
            near[w] |= held - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= ratio * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w)))
    return out


def found(df):
    return {r.word: (r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_of_documents(docs, no_docs, rows):
    assert found(spelling.variants(docs)) == plain(plain_words(rows))
    assert spelling.variants(no_docs).collect() == []


@pytest.mark.parametrize("listed", [64, 2])
def test_variants_of_families_of_words(spark, monkeypatch, listed):
    """Chains of forms, ties, letters of two bytes, letters that double, very long words."""
    monkeypatch.setattr(spelling, "LISTED", listed)
    random.seed(3)
    base = ["wordings", "abababababab", "aaaaaaaa", "éàûïöüñ", "staßenbahn", "x" * 31, "y" * 32, "q" * 33, "nm" * 400]
    base += ["".join(random.choices("abcdeé", k=random.randint(7, 40))) for _ in range(40)]
    words = Counter()
    for w in base:
        words[w] += 2000
        for _ in range(12):
            v = w
            for count in (200, 19, 2):
                k = random.randrange(len(v) + 1)
                v = random.choice([v[:k] + "a" + v[k:], v[:k] + "é" + v[k + 1 :], v[:k] + v[k + 1 :]])
                words[v] += count
    rows = [(k, " ".join([w] * c)) for k, (w, c) in enumerate(words.items())]
    rows.append((None, "×÷×÷×÷×÷ " * 3))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = plain(plain_words(rows))
    assert any(v[1] and v[1] != v[2] for v in want.values())
    assert found(spelling.variants(docs)) == want


def test_checksums_are_those_of_the_bytes():
    runs = ["a", "É".lower(), "straße", "ÿ" * 70, "word" * 40, "é" * 63 + "x"]
    data = np.frombuffer("".join(runs).encode("latin-1"), np.uint8)
    size = np.array([len(r) for r in runs])
    begun = np.array([zlib.crc32(f"{k}:".encode()) for k in range(len(runs))], np.uint32)
    got = spelling.checksums(data, np.cumsum(size) - size, size, begun)
    assert got.tolist() == [zlib.crc32(f"{k}:{r}".encode()) for k, r in enumerate(runs)]


def test_the_dictionary_holds_the_frequent_grams_only(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LISTED", 3)
    words = [f"prefix{a}{b}" for a in "abcdef" for b in "ghijkl"]
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n bigint")
    grams = spelling.dictionary(frame, sum(map(len, words)))
    counts = Counter(w[p : p + q] for w in words for q in range(2, 9) for p in range(len(w) - q + 1))
    for q in range(2, 9):
        want = sorted((g, c) for g, c in counts.items() if len(g) == q and c > 3)
        packed = [int.from_bytes(g.encode("latin-1"), "big") for g, _ in want]
        assert grams.grams.get(q, np.empty(0)).tolist() == sorted(packed)
    matrix = np.frombuffer("".join(words).encode(), np.uint8).reshape(len(words), 8)
    chosen, _, alone = grams.cut(matrix, 4)
    # "prefix" is everywhere, so its grams have the most letters, but those at a word's end are rare.
    assert (chosen[:, 0] == 4).all() and alone[:, 0].all() and (chosen[:, 6] == 2).all()


def test_words_and_their_index_are_not_broadcast(spark, monkeypatch):
    """Spark takes every table of this size for small; the index has many rows for each of the words."""
    plans = []
    stored = spelling.stored

    def noted(df):
        plans.append(df)
        return stored(df)

    monkeypatch.setattr(spelling, "stored", noted)
    counts = {"elephant": 3000, "elephent": 200, "elepent": 9, "giraffes": 40, "giraffs": 3, "zebrahide": 2}
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(counts.items())]
    out = spelling.variants(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert found(out) == plain(plain_words(rows))
    whole = "".join(df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1] for df in [*plans, out])
    assert whole.count("SortMergeJoin") > 2 and "BroadcastExchange" not in whole
