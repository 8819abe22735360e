"""Removal of repeated strings by grouping of minimizers, in place of a radix sort of suffixes: no
suffix is ordered.

Windows of WINDOW bytes are told apart by equal hashes, in passes from a coarse digit to the whole
window; after each pass a group within one document leaves, and only the others are looked at more
closely.

1. The first digit of a suffix is the least GRAM-byte string in its window by hash. Neighbouring
   suffixes share it, so a tenth as many digits as suffixes are dealt out, and one digit stands for
   a stretch of suffixes.
2. The second digit is the whole stretch, as far as its windows reach. Documents with an earlier
   equal stretch are settled.
3. What is left, where one first digit has several stretches, is told apart by a longer digit: the gram with the SIDE
   bytes before it, or after it. A window holds one of the two.
4. Windows of stretches that still share a digit are compared as a whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dealtide.llm import text as T
from dealtide.llm.cluster import batches, phased, stored

WINDOW, GRAM = 50, 24
#: A window without SIDE bytes before the gram has as many after it.
SIDE = (WINDOW - GRAM) // 2
_BLOCK = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)
#: Rows of a slice: the only document of its group there; settled within the slice; a sign that a
#: settled group is there.
OPEN, SETTLED, WITNESS = 0, 1, 2


def _stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each stretch of windows with one least gram: its hash, the hash of all its bytes, row, first
    window, number of windows, place of the gram.
    """
    row_of = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    found = []
    for a in range(0, len(data) - WINDOW + 1, _BLOCK):
        part = data[a : a + _BLOCK + WINDOW - 1]
        total = T.sums(part)
        grams = T.rolling(total, GRAM)
        # The least by hash, then by place, so equal windows have it in the same place.
        least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        size, grams_in = 1, WINDOW - GRAM + 1
        while 2 * size <= grams_in:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < grams_in:
            least = np.minimum(least[: size - grams_in], least[grams_in - size :])
        row = row_of[a : a + len(least)]
        at = np.flatnonzero(row == row_of[a + WINDOW - 1 : a + WINDOW - 1 + len(least)])
        if not len(at):
            continue
        owner, row = (least[at] & _PLACE).astype(np.int64), row[at]
        new = np.ones(len(at), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        first, last = at[begin], at[np.append(begin[1:], len(at)) - 1]
        owner, count = owner[begin], last - first + 1
        sign = T.mix(
            T.between(total, first, last + WINDOW)
            + T.mix((owner - first).astype(np.uint64) * np.uint64(64) + count.astype(np.uint64))
        )
        found.append((grams[owner], sign, row[begin], first + a, count, owner + a))
    if not found:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where groups begin in it."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, new


def _digits(texts: DataFrame) -> DataFrame:
    """(key, doc_id, kind): first digits by document; those in several documents of a slice are settled
    at once.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        key, _, row, *_ = _stretches(*T.strings(batch.column("text")))
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        doc = ids[row]
        order, new = _grouped(key, doc)
        key, doc = key[order[new]], doc[order[new]]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        group = np.cumsum(first) - 1
        several = np.bincount(group)[group] > 1 if len(group) else first
        witness = first & several
        return pa.record_batch(
            [
                T.signed(np.concatenate([key, key[witness]])),
                pa.array(np.concatenate([doc, doc[witness]])),
                pa.array(
                    np.concatenate([several * SETTLED, np.full(witness.sum(), WITNESS)]).astype(np.int32)
                ),
            ],
            ["key", "doc_id", "kind"],
        )

    return texts.mapInArrow(batches(run), "key bigint, doc_id bigint, kind int")


def _dealt(key: str) -> Column:
    """What rows are dealt out by: their key, or, where they are settled, anything that spreads them."""
    return F.when(F.col("kind") == SETTLED, F.xxhash64("doc_id")).otherwise(F.col(key))


def _shared(digits: DataFrame) -> DataFrame:
    """(doc_id, keys): each document's digits that another document has."""
    group = Window.partitionBy("dealt", "key")
    return (
        digits.withColumn("dealt", _dealt("key"))
        .select(
            "doc_id",
            "key",
            "kind",
            F.min("doc_id").over(group).alias("low"),
            F.max("doc_id").over(group).alias("high"),
            F.max("kind").over(group).alias("most"),
        )
        .where((F.col("kind") != WITNESS) & ((F.col("most") > OPEN) | (F.col("low") < F.col("high"))))
        .select("doc_id", "key")
    )


def _marked(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A hash of each (row, value) of a column of lists of bigint."""
    lists = batch.column(column)
    n = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return _tagged(np.repeat(np.arange(len(batch)), n), flat)


def _tagged(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    return T.mix(value ^ T.mix(row.astype(np.uint64) + np.uint64(1)))


def _settle(keys: tuple[np.ndarray, ...], doc: np.ndarray) -> np.ndarray:
    """Whether a smaller document of the slice has equal keys."""
    order, new = _grouped(*keys, doc)
    _, first = _grouped(*(k[order] for k in keys))
    group = np.cumsum(first) - 1
    least = doc[order][first]
    out = np.empty(len(doc), bool)
    out[order] = doc[order] > least[group]
    return out


_STRETCH = ["key", "sign", "doc_id", "start", "count", "gram", "before", "after"]


def _second(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, sign, doc_id, start, count, removed): stretches of shared digits; removed: a smaller
    document has an equal one.
    """
    keys = shared.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = T.strings(batch.column("text"))
        key, sign, row, start, count, gram = _stretches(data, offsets)
        held = np.isin(_tagged(row, key), _marked(batch, "keys"))
        key, sign, row, start, count, gram = (
            x[held] for x in (key, sign, row, start, count, gram)
        )
        doc = batch.column("doc_id").to_numpy()[row]
        settled = _settle((key, sign), doc)
        total = T.sums(data)

        def side(begin: np.ndarray, any_window: np.ndarray) -> pa.Array:
            ok = any_window & ~settled
            out = np.zeros(len(gram), np.int32)
            h = T.between(total, begin[ok], begin[ok] + GRAM + SIDE)
            # Half a hash will do beside the key: it only chooses what is looked at more closely.
            out[ok] = (h >> np.uint64(33)).astype(np.int32)
            return pa.array(out, mask=~ok)

        return pa.record_batch(
            [
                # Settled rows meet no others.
                pa.array(key.view(np.int64), mask=settled),
                pa.array(sign.view(np.int64), mask=settled),
                pa.array(doc),
                pa.array(start - offsets[row]),
                pa.array(count.astype(np.int32)),
                pa.array((gram - start).astype(np.int32)),
                side(gram - SIDE, start <= gram - SIDE),
                side(gram, start + count - 1 > gram - SIDE),
                pa.array((settled * SETTLED).astype(np.int32)),
            ],
            [*_STRETCH, "kind"],
        )

    rows = texts.join(keys, "doc_id").mapInArrow(
        batches(run),
        "key bigint, sign bigint, doc_id bigint, start bigint, count int, gram int, "
        "before int, after int, kind int",
    )
    group = Window.partitionBy("dealt", "key", "sign")
    return (
        rows.withColumn("dealt", _dealt("sign"))
        .withColumn("least", F.min("doc_id").over(group))
        .select(
            *_STRETCH,
            ((F.col("kind") == SETTLED) | (F.col("doc_id") > F.col("least"))).alias("removed"),
        )
    )


def _third(texts: DataFrame, second: DataFrame) -> DataFrame:
    """(doc_id, start, count 1): single windows of unsettled stretches that a smaller document has."""
    left = second.where("not removed")

    def live(digit: str, first: str, last: str) -> DataFrame:
        """Windows from `first` to `last` of stretches whose digit another stretch has."""
        rows = left.where(F.col(digit).isNotNull())
        group = ["key", digit]
        mixed = rows.groupBy(*group).agg(F.min("sign").alias("low"), F.max("sign").alias("high"))
        return rows.join(mixed.where("low < high").select(*group), group, "left_semi").selectExpr(
            "doc_id", f"{first} * 64 + {last} - {first} + 1 as span"
        )

    end = "(start + count - 1)"
    spans = live("before", "start", f"least({end}, start + gram - {SIDE})").union(
        live("after", f"greatest(start, start + gram - {SIDE - 1})", end)
    )
    spans = stored(spans.groupBy("doc_id").agg(F.collect_list("span").alias("spans")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = T.strings(batch.column("text"))
        lists = batch.column("spans")
        row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        start, count = flat // 64, flat % 64
        row, first = np.repeat(row, count), np.repeat(start, count)
        step = np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
        at = offsets[row] + first + step
        # A repeated id brings the spans of another text.
        inside = at + WINDOW <= offsets[row + 1]
        row, at = row[inside], at[inside]
        one = T.between(T.sums(data), at, at + WINDOW)
        two = T.between(T.sums(T.SCRAMBLED[data]), at, at + WINDOW)
        doc = batch.column("doc_id").to_numpy()[row]
        settled = _settle((one, two), doc)
        return pa.record_batch(
            [
                T.signed(one),
                T.signed(two),
                pa.array(doc),
                pa.array(at - offsets[row]),
                pa.array((settled * SETTLED).astype(np.int32)),
            ],
            ["one", "two", "doc_id", "start", "kind"],
        )

    rows = texts.join(spans, "doc_id").mapInArrow(
        batches(run), "one bigint, two bigint, doc_id bigint, start bigint, kind int"
    )
    group = Window.partitionBy("dealt", "one", "two")
    return (
        rows.withColumn("dealt", _dealt("one"))
        .withColumn("least", F.min("doc_id").over(group))
        .where((F.col("kind") == SETTLED) | (F.col("doc_id") > F.col("least")))
        .select("doc_id", "start", F.lit(1).alias("count"))
    )


@phased
def repeated_windows(documents: DataFrame) -> DataFrame:
    """(doc_id, start, count): `count` windows of WINDOW bytes from byte `start` on, each of which a
    document with a smaller doc_id holds.

    Null texts are empty; rows without id are left out. Rows sharing an id are one document: windows
    found in either text are removed from both. Digits are 64-bit hashes; a window is removed only
    on 128 bits of agreement.
    """
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(
        "doc_id is not null and text is not null"
    )
    shared = stored(_shared(_digits(texts)))
    second = stored(_second(texts, shared))
    third = stored(_third(texts, second))
    return second.where("removed").select("doc_id", "start", "count").union(third)


@phased
def without_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256) of every document, without each byte of
    a WINDOW-byte string that also starts in a document with a smaller doc_id.

    kept (binary): the remaining bytes; n_spans: the maximal removed runs. Rows without id lose
    nothing. Other columns are ignored.
    """
    spans = (
        repeated_windows(documents)
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.collect_list(F.col("start") * 64 + F.col("count")).alias("spans"))
    )
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = T.strings(batch.column("text"))
        lists = batch.column("spans").fill_null([])
        row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        start = offsets[row] + flat // 64
        end = np.minimum(start + flat % 64 + WINDOW - 1, offsets[row + 1])
        change = np.zeros(len(data) + 1, np.int32)
        np.add.at(change, start, 1)
        np.add.at(change, end, -1)
        gone = np.cumsum(change)[:-1] > 0
        before = np.concatenate([[0], np.cumsum(gone)])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = offsets[:-1][np.diff(offsets) > 0]
        begins[inner] = gone[inner]
        spans_before = np.concatenate([[0], np.cumsum(begins)])
        kept = [
            data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)
        ]
        return pa.record_batch(
            [
                batch.column("doc_id"),
                pa.array(np.diff(offsets)),
                pa.array(np.diff(before[offsets])),
                pa.array(np.diff(spans_before[offsets])),
                pa.array(kept, pa.binary()),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
        )

    joined = texts.join(spans, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(
        batches(run),
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string",
    )
