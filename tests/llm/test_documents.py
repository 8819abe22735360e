"""Every operator on documents against a plain version of its definition, on inputs with all odd cases."""

import math
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dealtide.llm import (
    bpe,
    classifier,
    cluster,
    components,
    decontaminate,
    jaccard,
    licenses,
    lines,
    lm,
    quality_rules,
    substrings,
)
from tests.llm import brute
from tests.llm.frames import PASSAGE, known

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_similar_documents(docs, no_docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs).collect()}
    assert got == brute.similar(known(rows))
    assert jaccard.similar_documents(no_docs).collect() == []


def test_tiles_of_a_large_key_are_cut_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 4)
    base = [f"w{k}" for k in range(60)]
    # Chains: neighbours are similar, distant ones aren't.
    rows = [(i, " ".join(base[: 20 + i] + [f"x{i}_{k}" for k in range(3)])) for i in range(30)]
    got = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute.similar(rows)


def test_components_stop_at_stars(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "stored", lambda df: written.append(df) or cluster.stored(df))
    monkeypatch.setattr(components, "LINKS", 10)

    def least(links):
        written.clear()
        frame = spark.createDataFrame(links, "a bigint, b bigint")
        return sorted(tuple(r) for r in components.components(frame).collect())

    # Links that are stars already need no step, whichever end is first; a chain takes a few.
    assert least([(5, 1), (1, 6), (7, 1), (9, 8), (3, 3), (None, 4)]) == [
        (1, 1), (5, 1), (6, 1), (7, 1), (8, 8), (9, 8)
    ]
    assert len(written) == 1
    assert least([(k, k + 1) for k in range(200)]) == [(k, 0) for k in range(201)]
    assert least([(9, 4), (4, 9), (9, 4), (9, 2)]) == [(2, 2), (4, 2), (9, 2)]
    assert least([]) == []


def test_pairs_are_bounded_with_the_sizes_of_their_own_sets(spark):
    """A repeated id has a bitmap per set; a pair is held against that of its own set."""
    bitmaps = spark.createDataFrame(
        [(1, 4, bytes([15] * 8)), (1, 9, bytes(8)), (2, 4, bytes([15] * 8))], "id bigint, n bigint, bits binary"
    )
    pairs = spark.createDataFrame([(2, 4, 1, 4), (2, 4, 1, 9)], "a bigint, n_a bigint, b bigint, n_b bigint")
    assert [tuple(r) for r in jaccard._bounded(pairs, bitmaps, 75).collect()] == [(2, 1)]


def test_without_similar_keeps_one_of_each_group(docs, rows):
    left = jaccard.without_similar(docs)
    assert left.columns == docs.columns
    want = sorted(i for i, (_, c) in brute.similar(known(rows)).items() if c == i)
    assert sorted({r.doc_id for r in left.collect() if r.doc_id is not None}) == want


def test_repeated_strings(docs, no_docs, rows):
    got = substrings.without_repeats(docs).collect()
    assert len(got) == len(rows)
    want = brute.without_repeats(known(rows))
    for r in got:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
    assert substrings.without_repeats(no_docs).collect() == []


def _removed(rows, edits=2, least=30):
    found, first = [], {}
    for i, text in sorted(rows):
        for no, line in enumerate((text or "").split("\n")):
            if brute.WORD.search(line):
                found.append((i, no, line))
                first.setdefault(line, (i, no))
    long = [(x, x.encode()) for x in first if len(x.encode()) >= least]
    pairs = [
        (x, y, a, b)
        for k, (x, a) in enumerate(long)
        for y, b in long[:k]
        if abs(len(a) - len(b)) <= edits
    ]
    near = lines.within([p[2] for p in pairs], [p[3] for p in pairs], edits) <= edits
    late = {max(x, y, key=first.get) for (x, y, _, _), ok in zip(pairs, near, strict=True) if ok}
    return {(i, no) for i, no, x in found if first[x] != (i, no) or x in late}


def test_repeated_lines(docs, no_docs, rows):
    removed = lines.repeated_lines(docs)
    got = {(r.doc_id, r.no) for r in removed.collect()}
    want = _removed(known(rows))
    assert got == want
    assert {(9008, 1)} <= got  # an edit away from 9007's line
    changed = {r.doc_id: r for r in lines.changed_documents(docs, removed).collect()}
    assert set(changed) == {i for i, _ in want}
    assert changed[9008].text == "elsewhere\nand more" and changed[9008].n_removed == 1
    assert lines.repeated_lines(no_docs).collect() == []
    left = lines.without_repeated_lines(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert 9006 not in ids and None in ids and 9003 in ids


def test_banded_edit_distance():
    random = np.random.default_rng(3)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    texts = [bytes(random.integers(97, 99, random.integers(0, 9)).tolist()) for _ in range(400)]
    a, b = texts[:200], texts[200:]
    for edits in (1, 2, 3):
        want = [min(distance(x, y), edits + 1) for x, y in zip(a, b, strict=True)]
        assert lines.within(a, b, edits).tolist() == want


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_contaminations(spark, docs, no_docs, rows, sent):
    words = PASSAGE.split()
    benchmark = [
        (1, PASSAGE),
        (2, " ".join([*words[30:50], *words[:20]])),  # reordered
        (3, "nothing of the kind is in any of these documents at all"),
        (4, None),
        (5, "short"),
        (5, "short"),
        (None, PASSAGE),
    ]
    items = spark.createDataFrame(benchmark, "item_id int, text string")
    got = decontaminate.contaminations(docs, items, sent_seeds=sent).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {
        (i, item) for i in (9007, 9008, 9009) for item in ("1", "2")
    }
    reordered = next(r for r in got if (r.doc_id, r.item_id) == (9007, "2"))
    assert (reordered.n_tiles, reordered.coverage) == (2, 1.0)
    assert decontaminate.contaminations(no_docs, items, sent_seeds=sent).collect() == []
    assert decontaminate.contaminations(docs, items.limit(0), sent_seeds=sent).collect() == []
    if sent:
        left = decontaminate.decontaminated(docs, items)
        assert left.columns == docs.columns
        assert left.count() == len(rows) - 3


def test_tiles_match_a_plain_greedy_tiling():
    def plain(a, b, least):
        a, b, total = list(a), list(b), 0
        while True:
            best = (0, 0, 0)
            for i in range(len(a)):
                for j in range(len(b)):
                    k = 0
                    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and a[i + k] >= 0:
                        k += 1
                    if k > best[0]:
                        best = (k, i, j)
            if best[0] < least:
                return total
            k, i, j = best
            a[i : i + k], b[j : j + k] = [-1] * k, [-2] * k
            total += k

    random = np.random.default_rng(5)
    for _ in range(30):
        a, b = random.integers(0, 4, 25), random.integers(0, 4, 20)
        got = decontaminate.tiles(a.astype(np.uint64), b.astype(np.uint64), 3)
        assert max((n for _, _, n in got), default=0) <= 20
        taken = [x for i, _, n in got for x in range(i, i + n)]
        assert len(taken) == len(set(taken))
        assert all((a[i : i + n] == b[j : j + n]).all() for i, j, n in got)
        # Ties may be placed differently; the longest tile may not.
        if got:
            assert (plain(a, b, 3) > 0) and max(n for _, _, n in got) >= 3
        else:
            assert plain(a, b, 3) == 0


def test_encoding_and_decoding(docs, no_docs, rows):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = bpe.encode_decode(docs, TOKENIZER).collect()
    assert len(got) == len(rows)
    texts = dict(known(rows)) | {None: rows[-1][1]}
    for r in got:
        ids = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids), r.doc_id
        assert r.n_tokens == len(ids)
        assert r.decoded == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(no_docs, TOKENIZER).collect() == []


def test_language_model(docs, no_docs, rows):
    got = lm.score_documents(docs).collect()
    tokens = [(i, [*brute.WORD.findall(brute.lower(t or "")), None]) for i, t in rows if i is not None]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in tokens}
    seen = Counter(w for i, ws in tokens if not held[i] for w in ws)
    n, v = sum(seen.values()), len(seen)
    by_id = dict(tokens)
    assert len(got) == len(tokens)
    for r in got:
        words = by_id[r.doc_id]
        base = sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(words), n)
        assert r.n_known == sum(seen[w] > 0 for w in words)
        assert r.base_score == pytest.approx(base)
        assert r.score < 0 and math.isfinite(r.score)
    assert lm.score_documents(no_docs).collect() == []


def test_model_is_normalised_and_learns():
    counts = np.array([50.0, 100, 100, 100, 5])
    model = lm.Model.start(counts)
    trainer = lm.Trainer(model, counts / counts.sum(), 1)
    last = np.array([1, 2, 3] * 200)
    target = np.array([2, 3, 1] * 200)
    for _ in range(60):
        trainer.step(last, last, target)
    scorer = lm.Scorer(trainer.model)
    for a in range(5):
        every = np.arange(5)
        total = (10 ** scorer(np.full(5, a), np.full(5, a), every)).sum()
        assert total == pytest.approx(1, abs=1e-5)
    assert 10 ** scorer(np.array([1]), np.array([1]), np.array([2]))[0] > 0.7


def test_quality_classifier(spark, docs, no_docs, rows):
    got = {r.doc_id: r for r in classifier.classified(docs).collect()}
    assert set(got) == {i for i, _ in rows if i is not None}
    assert not got[9001].kept and not got[9002].kept and not got[9011].kept
    assert classifier.classified(no_docs).collect() == []
    assert classifier.accepted(docs).columns == docs.columns


def test_quality_classifier_agrees_with_labels(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    joined = classifier.classified(read("documents")).join(read("labels"), "doc_id").toPandas()
    assert ((joined.quality == 1) == joined.kept).mean() > 0.97
    assert joined[joined.quality == 1].kept.all()


def test_quality_rules(spark, docs, no_docs, rows):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    odd = spark.createDataFrame([(None, 1), (9007, None), (0, 1)], "doc_id bigint, quality int")
    labels = labels.select("doc_id", "quality").unionByName(odd)
    texts = dict(known(rows))
    got = quality_rules.judged(docs, labels).collect()
    assert len(got) == sum(i is not None for i, _ in rows)
    for r in got:
        counts = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert counts == brute.base_counts(texts[r.doc_id]), r.doc_id
        assert not (r.kept and r.base_failed)
    assert quality_rules.judged(no_docs, labels).collect() == []
    untrained = quality_rules.judged(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in untrained)  # all lines are content


def test_viterbi_is_the_best_path():
    random = np.random.default_rng(1)
    for n in (1, 2, 5):
        field = quality_rules.Field(random.normal(size=(3, 2)), random.normal(size=(2, 2)), random.normal(size=2))
        x = random.normal(size=(n, 3))
        lines_ = quality_rules.Lines(x, np.ones(n), np.array([0, n]))
        paths = [[k >> i & 1 for i in range(n)] for k in range(2**n)]

        def value(p, x=x, f=field):
            steps = sum(f.steps[a, b] for a, b in zip(p, p[1:], strict=False))
            return f.first[p[0]] + steps + sum((x[i] @ f.features)[s] for i, s in enumerate(p))

        assert quality_rules.viterbi(field, lines_).tolist() == max(paths, key=value)


def test_licenses(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    files = [
        ("a/LICENSE", f"some words\n{apache}"),
        ("a/b/c/code.py", "print"),
        ("a/b/COPYING.txt", "Released under the MIT License."),
        ("a/b/c/own.py", f"# {apache}\nprint"),
        ("top.py", "x"),
        ("z/LICENSE.md", "unknown terms"),
        ("z/code.py", None),
        (None, "Released under the MIT License."),
        ("a/b/c/code.py", ""),
    ]
    frame = spark.createDataFrame([(*f, "x") for f in files], "path string, text string, license string")
    got = [(r.path, r.license, r.origin, r.directory) for r in licenses.license_scan(frame).collect()]
    assert sorted(got, key=str) == sorted(
        [
            ("a/LICENSE", "Apache-2.0", "own", None),
            ("a/b/c/code.py", "MIT", "inherited", "a/b"),
            ("a/b/COPYING.txt", "MIT", "own", None),
            ("a/b/c/own.py", "Apache-2.0", "own", None),
            ("top.py", None, "none", None),
            ("z/LICENSE.md", None, "none", None),
            ("z/code.py", None, "none", None),
            (None, "MIT", "own", None),
            ("a/b/c/code.py", "MIT", "inherited", "a/b"),
        ],
        key=str,
    )
    assert licenses.license_scan(frame.limit(0)).collect() == []
