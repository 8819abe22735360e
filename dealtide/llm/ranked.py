"""Ranked lexical search: the best documents for each of a set of queries, by norm buckets.

A query and a document are vectors over the queries' terms: a term's weight w is split evenly, so a query
has coordinates sqrt(w) and a document sqrt(w) * x, where x is the impact of the term's occurrences, and
their inner product is the score. Documents are range-sorted by the length of their vectors, the longest
first, and read in buckets of them. For a bucket and a query:

1. by Cauchy-Schwarz no score passes |query| * |longest of the bucket|: queries whose bound stays under
   their threshold, the score of their tenth document so far, skip the bucket, then single documents;
2. in what is left, the heaviest coordinates are added exactly, and only the rest is bounded by
   Cauchy-Schwarz;
3. survivors are scored in 64-bit integers over all terms.

Thresholds start from the longest documents of all and rise within each task. Nothing is cut off: a document is
passed over only if its bound is below the tenth score already found.

Defined results: a null text has no terms; a document without terms counts nowhere; rows of documents are
documents of their own, also where ids repeat; items (queries) of one id are one item with the terms of all
its rows; an item without a matching document has no rows, nor have empty tables; other columns are ignored,
whatever their names. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as K

from dealtide.llm import text as T
from dealtide.llm.cluster import batches, phased, stored

TOP = 10
#: Documents of a bucket.
BUCKET = 4096
#: Heaviest terms of a query that are added exactly before the rest is bounded.
FOCUS = 6
#: Documents, the longest vectors of all, that give the first thresholds.
HEAD = 4096
#: Bytes of item texts in a block; each block is a pass over the documents.
BLOCK_BYTES = 16_000_000

#: Fixed values of the score: units of an impact, and the constants of its saturation.
_UNITS, _TF, _SATURATION = 1_000_000_000, 1000, 8
#: Room for rounding in the bounds, which are doubles; scores are integers.
_SLACK = 1 + 1e-9

_VECTORS = "doc_id {id}, n bigint, terms binary, counts binary"
_FOUND = "item int, doc_id {id}, score bigint"


def _terms(column: pa.Array) -> tuple[np.ndarray, T.Words]:
    w = T.words(column, T.NOT_ALNUM)
    return w.hashes(lower=True), w


@dataclass
class Queries:
    """A block of items: `terms` in order, and of each item its terms' numbers."""

    ids: list
    terms: np.ndarray
    of_item: list[np.ndarray]
    weight: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are terms, and the numbers of those."""
        if not len(self.terms):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        # Most words are no terms: a table of their low bits drops them before the search.
        bits = max(16, len(self.terms).bit_length() + 4)
        low = np.uint64((1 << bits) - 1)
        there = np.zeros(1 << bits, bool)
        there[self.terms & low] = True
        at = np.flatnonzero(there[hashes & low])
        number = np.minimum(np.searchsorted(self.terms, hashes[at]), len(self.terms) - 1)
        same = self.terms[number] == hashes[at]
        return at[same], number[same]


def _queries(rows: list) -> Queries:
    """Of collected (id, texts) rows."""
    hashes = []
    for row in rows:
        hashes.append(np.unique(_terms(pa.array(row.texts, pa.string()))[0]))
    terms = np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]))
    return Queries([r.id for r in rows], terms, [np.searchsorted(terms, h) for h in hashes])


def _vectors(docs: DataFrame, queries: Queries) -> DataFrame:
    """doc_id, n (terms of the document), terms and counts (int32) of those that queries have; n > 0."""
    schema = _VECTORS.format(id=docs.schema["doc_id"].dataType.simpleString())
    size = max(len(queries.terms), 1)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, w = _terms(batch.column("text"))
        at, number = queries.place(hashes)
        keys, counts = np.unique(w.row[at] * size + number, return_counts=True)
        begin = np.searchsorted(keys, np.arange(len(batch) + 1) * size)
        some = np.flatnonzero(w.count > 0)
        number, counts = (keys % size).astype(np.int32), counts.astype(np.int32)

        def blobs(values: np.ndarray) -> pa.Array:
            raw = values.tobytes()
            offsets = np.concatenate([begin[some], [begin[-1]]]) * 4
            return pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(some), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)]
            ).cast(pa.binary())

        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(some)),
                pa.array(w.count[some]),
                blobs(number),
                blobs(counts),
            ],
            ["doc_id", "n", "terms", "counts"],
        )

    return docs.select("doc_id", "text").mapInArrow(batches(run), schema)


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """int32 values of a column of blobs, and how many each row has."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    return np.frombuffer(data.tobytes(), np.int32), np.diff(offsets) // 4


def _frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """The number of documents that hold each term: `size` numbers."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in rows:
            total += np.bincount(_numbers(batch.column("terms"))[0], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])

    df = np.zeros(size, np.int64)
    counted = vectors.select("terms").mapInArrow(run, "term bigint, df bigint")
    for row in counted.groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[row.term] = row.df
    return df


def _weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array(
        [math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64
    )


def _impacts(counts: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Impacts of terms by their counts and their documents' lengths."""
    # In Python's integers where 90 * n * documents may pass 64 bits.
    if len(n) and 90 * int(n.max()) * documents >= 1 << 62:
        share = np.array([90 * x * documents // total for x in n.tolist()], np.int64)
    else:
        share = (90 * n * documents) // total
    return (_UNITS * counts.astype(np.int64)) // (_TF * counts + _SATURATION * (10 + share))


def _with_lengths(vectors: DataFrame, weight: np.ndarray, documents: int, total: int) -> DataFrame:
    """Vectors with `length`; those without a term that weighs anything go."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            terms, size = _numbers(batch.column("terms"))
            row = np.repeat(np.arange(len(batch)), size)
            n = batch.column("n").to_numpy()
            x = _impacts(_numbers(batch.column("counts"))[0], n[row], documents, total).astype(float)
            length = np.sqrt(np.bincount(row, weight[terms] * x * x, minlength=len(batch)))
            yield batch.append_column("length", pa.array(length)).filter(pa.array(length > 0))

    schema = K.StructType([*vectors.schema.fields, K.StructField("length", K.DoubleType())])
    return vectors.mapInArrow(run, schema)


class _Best:
    """The best documents of each item so far."""

    def __init__(self, top: int, floor: np.ndarray):
        self.top, self.floor = top, floor
        self.found: dict[int, tuple[np.ndarray, list]] = {}

    def add(self, item: int, scores: np.ndarray, ids: list) -> None:
        old, old_ids = self.found.get(item, (np.empty(0, np.int64), []))
        scores, ids = np.concatenate([old, scores]), old_ids + ids
        # As Spark sorts: no id comes first.
        order = sorted(
            range(len(ids)),
            key=lambda k: (-scores[k], ids[k] is not None, 0 if ids[k] is None else ids[k]),
        )
        best = order[: self.top]
        self.found[item] = scores[best], [ids[k] for k in best]
        if len(best) == self.top:
            self.floor[item] = max(self.floor[item], scores[best[-1]])


def _searching(
    queries: Queries, documents: int, total: int, floor: np.ndarray, top: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over vectors, the longest first: the `top` documents of a task for each item.

    floor: a score per item that `top` documents reach; 1 where unknown.
    """
    weight = queries.weight
    root = np.sqrt(weight.astype(float))
    # The heaviest terms of each item first.
    ordered = [t[np.argsort(-weight[t], kind="stable")] for t in queries.of_item]
    own = np.array([math.sqrt(float(weight[t].sum())) for t in ordered])
    rest = np.array([math.sqrt(float(weight[t[FOCUS:]].sum())) for t in ordered])

    def bucket(batch: pa.RecordBatch, best: _Best) -> None:
        length = batch.column("length").to_numpy()
        # Cauchy-Schwarz for the whole bucket.
        active = np.flatnonzero(own * length.max() * _SLACK >= best.floor)
        if not len(active):
            return
        terms, size = _numbers(batch.column("terms"))
        counts = _numbers(batch.column("counts"))[0]
        row = np.repeat(np.arange(len(batch)), size)
        order = np.argsort(terms, kind="stable")
        terms, row = terms[order], row[order]
        n = batch.column("n").to_numpy()
        x = _impacts(counts[order], n[row], documents, total)
        begin = np.searchsorted(terms, np.arange(len(weight) + 1))
        ids = batch.column("doc_id")
        for item in active.tolist():
            of = ordered[item]
            floor = best.floor[item]
            # For each document.
            left = own[item] * length * _SLACK >= floor
            part, square = np.zeros(len(batch)), length * length
            for t in of[:FOCUS].tolist():
                lists = slice(begin[t], begin[t + 1])
                y = root[t] * x[lists]
                part[row[lists]] += root[t] * y
                square[row[lists]] -= y * y
            bound = part + rest[item] * np.sqrt(np.maximum(square, 0) + length * length * 1e-12)
            left &= bound * _SLACK >= floor
            if not left.any():
                continue
            score = np.zeros(len(batch), np.int64)
            for t in of.tolist():
                lists = slice(begin[t], begin[t + 1])
                score[row[lists]] += weight[t] * x[lists]
            at = np.flatnonzero(left & (score >= floor))
            if len(at) > top:
                # All that reach the last place, ties included.
                least = np.partition(score[at], len(at) - top)[len(at) - top]
                at = at[score[at] >= least]
            if len(at):
                best.add(item, score[at], ids.take(pa.array(at)).to_pylist())

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = _Best(top, floor.copy()), None
        for batch in rows:
            kind = batch.schema.field("doc_id").type
            for k in range(0, len(batch), BUCKET):
                bucket(batch.slice(k, BUCKET), best)
        for item, (scores, ids) in best.found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([item] * len(ids), pa.int32()), pa.array(ids, kind), pa.array(scores)],
                ["item", "doc_id", "score"],
            )

    return run


def _block(docs: DataFrame, items: list, id_type: K.DataType, top: int) -> DataFrame | None:
    """The best documents of the collected items of one block."""
    spark = docs.sparkSession
    queries = _queries(items)
    if not len(queries.terms):
        return None
    vectors = stored(_vectors(docs, queries))
    counted = vectors.agg(F.count("*").alias("documents"), F.sum("n").alias("total")).first()
    documents, total = counted.documents, counted.total
    if not documents:
        return None
    queries.weight = _weights(_frequencies(vectors, len(queries.terms)), documents)
    lengths = _with_lengths(vectors, queries.weight, documents, total)
    ordered = stored(
        # Copies have the same length; their ids spread them.
        lengths.repartitionByRange(F.desc("length"), "doc_id").sortWithinPartitions(F.desc("length"))
    )
    schema = _FOUND.format(id=docs.schema["doc_id"].dataType.simpleString())
    floor = np.ones(len(items), np.int64)

    def search(rows: DataFrame, floor: np.ndarray) -> DataFrame:
        return rows.mapInArrow(_searching(queries, documents, total, floor, top), schema)

    place = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    head = search(ordered.orderBy(F.desc("length")).limit(HEAD), floor)
    last = head.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") == top)
    for row in last.collect():  # a number per item of the block
        floor[row.item] = row.score
    found = search(ordered, floor).withColumn("rank", F.row_number().over(place))
    numbered = K.StructType([K.StructField("item", K.IntegerType()), K.StructField("item_id", id_type)])
    names = spark.createDataFrame(list(enumerate(queries.ids)), numbered)
    return found.filter(F.col("rank") <= top).join(names, "item").select("item_id", "rank", "doc_id", "score")


@phased
def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the `top` documents with a score above 0 of each item.

    docs: doc_id, text; items: item_id, text. Equal scores are ranked by doc_id. Items are taken in blocks
    of about `BLOCK_BYTES` of text, which are collected; each block is a pass over the documents.
    """
    id_type = items.schema["item_id"].dataType
    told = items.select("item_id", "text")
    size = told.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    found = []
    for k in range(blocks):
        of_block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k
        listed = (
            told.filter(of_block)
            .groupBy(F.col("item_id").alias("id"))
            .agg(F.collect_list("text").alias("texts"))
            .collect()
        )
        if (part := _block(docs, listed, id_type, top)) is not None:
            found.append(part)
    if not found:
        doc = docs.schema["doc_id"].dataType.simpleString()
        schema = f"item_id {id_type.simpleString()}, rank int, doc_id {doc}, score bigint"
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, found)

