"""The pipeline on odd inputs, stage by stage against plain versions."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from dealtide.llm import classifier, decontaminate
from tests.llm import brute

CLASHING = ["key", "n", "bucket", "chunk", "size", "label", "_id", "word", "units", "share"]


def written(spark, folder, rows, items):
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(
        f"{c} string" for c in CLASHING
    )
    listed = [(i, t, None, "s", None, *["x"] * len(CLASHING)) for i, t in rows]
    spark.createDataFrame(listed, columns).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture
def folder(spark, rows, tmp_path):
    item = "the quick brown fox reads a very long and quite unusual passage about nothing at all in the end"
    more = [
        (9101, f"A first line of words that is long enough.\n{item}.\nAnd a last line."),
        (9102, "BUY NOW!!! $$$ ### $$$ BUY NOW!!! | | | | $$$ WIN WIN WIN WIN $$$ !!! ###"),
    ]
    return written(spark, tmp_path, [*rows, *more], [(1, item), (2, None), (3, "")])


def texts(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect())


def test_every_stage_on_odd_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination",
        "BPE encoding and decoding",
    ]

    def staged(name, docs):
        out = stages[name](spark, docs, folder)
        path = f"{folder}/after {name}"
        out.write.parquet(path)
        return spark.read.parquet(path)

    kept = staged("quality classifier", docs)
    assert kept.columns == columns
    judged = {r.doc_id: r for r in classifier.classified(docs).collect()}
    ids = {r.doc_id for r in kept.collect()}
    assert 9102 not in ids and 9101 in ids
    assert ids - {None} == {i for i, r in judged.items() if r.kept}

    lines = staged("line dedup", kept)
    assert lines.columns == columns
    before = {r.doc_id: r.text for r in kept.collect()}
    earlier = set()
    for r in sorted(lines.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)):
        own = (before[r.doc_id] or "").split("\n")
        left = (r.text or "").split("\n")
        assert set(left) <= set(own)
        # Long lines of earlier documents don't come again.
        if r.doc_id is not None:
            assert not {x for x in left if len(x) >= 30} & earlier
            earlier |= {x for x in own if len(x) >= 30}

    single = staged("n-gram Jaccard join", lines)
    assert single.columns == columns
    known = [(r.doc_id, r.text) for r in lines.collect() if r.doc_id is not None]
    want = {i for i, (_, c) in brute.similar(known).items() if c == i}
    assert {r.doc_id for r in single.collect() if r.doc_id is not None} == want

    clean = staged("benchmark decontamination", single)
    assert clean.columns == columns
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = {r.doc_id for r in decontaminate.contaminations(single, benchmark).collect()}
    assert 9101 in found
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - found

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    encoded = staged("BPE encoding and decoding", clean)
    want = []
    for r in clean.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        want.append((str(r.doc_id), len(ids), tokenizer.decode(ids, skip_special_tokens=False)))
    got = [(str(r.doc_id), r.n_tokens, r.decoded) for r in encoded.collect()]
    assert sorted(got) == sorted(want) and got

    # The whole run gives the same.
    whole = [(str(r.doc_id), r.n_tokens, r.decoded) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(whole) == sorted(got)


def test_empty_tables(spark, tmp_path):
    folder = written(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_documents_of_nothing(spark, tmp_path):
    folder = written(spark, tmp_path, [(1, None), (2, ""), (None, " \n"), (2, "")], [(1, "a b c d e f g")])
    out = corpus_pipeline.run(spark, folder).collect()
    assert all(r.n_tokens == 0 for r in out)
