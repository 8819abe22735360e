"""Texts as codes into word tables of their chunk, so that a fact about a word is looked up once a
chunk, not once an occurrence, and only facts and codes move.

A chunk is a run of rows with a bounded size of text. Its distinct words are dealt to buckets by
hash; a task that has a bucket has all that the corpus says of its words, and replies to each chunk.
Chunks and replies then meet by chunk.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealtide.llm import text as T
from dealtide.llm.cluster import give_back, giving_back, stored

CHUNK = 16_000_000
CODED = (
    "chunk bigint, bucket int, doc_ids array<bigint>, lengths binary, codes binary, words binary, "
    "counts binary"
)


def _compressed(raw: bytes) -> bytes:
    return struct.pack("<q", len(raw)) + _codec().compress(raw, asbytes=True)


def _plain(blob: bytes) -> bytes:
    n = struct.unpack_from("<q", blob)[0]
    return _codec().decompress(blob[8:], n, asbytes=True) if n else b""


@cache
def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=9)


#: Integers that are packed at once, so that packing takes little memory beside them.
_PACKED = 1 << 18


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers, 7 bits a byte, small ones in few bytes, compressed."""
    pieces = (_packed(values[i : i + _PACKED]) for i in range(0, len(values), _PACKED))
    return _compressed(b"".join(pieces))


def _packed(values: np.ndarray) -> bytes:
    v = np.asarray(values, np.uint64)
    width = max(1, -(-int(v.max()).bit_length() // 7))
    raw = np.empty((len(v), width), np.uint8)
    used = np.ones((len(v), width), bool)
    for k in range(width):
        raw[:, k] = (v & np.uint64(127)).astype(np.uint8)
        used[:, k] = (v > 0) | (k == 0)
        v = v >> np.uint64(7)
        raw[:, k] |= (v > 0).astype(np.uint8) << 7
    return raw[used].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(_plain(blob), np.uint8)
    end = np.flatnonzero(raw < 128)
    start = np.concatenate([[0], end[:-1] + 1])[: len(end)]
    size = (end - start).astype(np.int8)
    del end
    most = int(size.max(initial=0))
    out = (raw[start] & 127).astype(np.int64 if most > 3 else np.int32)
    for k in range(1, most + 1):
        more = np.flatnonzero(size >= k)
        out[more] |= (raw[start[more] + k] & 127).astype(out.dtype) << (7 * k)
    return out


def pack_rising(values: np.ndarray) -> bytes:
    """Rising integers, by their differences."""
    return pack(np.diff(values, prepend=0))


def unpack_rising(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.int64)


def pack_words(words: list[bytes]) -> bytes:
    """Words without a newline."""
    return _compressed(b"\n".join(words))


def _gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The spans of the data one after the other, each followed by `gap` newlines, and where they begin."""
    size = end - start
    first = np.concatenate([[0], np.cumsum(size + gap)])
    out = np.full(first[-1], 10, np.uint8)
    of_size = np.repeat(np.arange(len(size)), size)
    within = np.arange(len(of_size)) - np.repeat(np.cumsum(size) - size, size)
    out[first[of_size] + within] = data[start[of_size] + within]
    return out, first


def unpack_words(blob: bytes) -> list[bytes]:
    return _plain(blob).split(b"\n")


def coded(
    texts: DataFrame,
    buckets: int,
    split: Callable[[pa.Array], T.Words] = T.words,
    lower: bool = False,
    counted: Callable[[pa.Array], np.ndarray] | None = None,
) -> DataFrame:
    """Stored rows: per chunk its documents, their numbers of words and the codes of all these words in
    order; and per chunk and bucket its words, their codes (rising, the frequent words first) and
    counts.

    texts: doc_id, text. Counts are over the documents that `counted` picks by their ids, if given.
    Words are told apart by 64-bit hashes within a chunk.
    """

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        parts = []
        size = 0
        for batch in batches:
            for part in T.slices(batch, "text"):
                parts.append(_part(part, split, lower, counted))
                size += part.column("text").nbytes
                if size >= CHUNK:
                    yield from _chunk(chunk, parts, buckets, counted is not None)
                    chunk, parts, size = chunk + 1, [], 0
                    give_back()
        if parts:
            yield from _chunk(chunk, parts, buckets, counted is not None)

    return stored(texts.select("doc_id", "text").mapInArrow(run, CODED))


def _part(part: pa.RecordBatch, split, lower: bool, counted) -> tuple:
    """Of a slice: ids, words of each document, codes, and by code the hash, the words' bytes and where
    they begin, the count and the counted ones.
    """
    w = split(part.column("text"))
    keys, at, inverse, n = np.unique(
        w.hashes(lower), return_index=True, return_inverse=True, return_counts=True
    )
    words, first = _gathered(w.data, w.start[at], w.end[at], 0)
    if lower:
        words = T.LOWER[words]
    some = n
    if counted is not None:
        chosen = counted(part.column("doc_id"))[w.row]
        some = np.bincount(inverse[chosen], minlength=len(keys))
    return part.column("doc_id"), w.count, inverse.astype(np.uint32), keys, (words, first), n, some


def _chunk(chunk: int, parts: list[tuple], buckets: int, counted: bool) -> Iterator[pa.RecordBatch]:
    ids, lengths, codes, keys, words, n, some = zip(*parts, strict=True)
    all_keys = np.concatenate(keys)
    distinct, at, inverse = np.unique(all_keys, return_index=True, return_inverse=True)
    total = np.bincount(inverse, np.concatenate(n), len(distinct))
    seen = np.bincount(inverse, np.concatenate(some), len(distinct)).astype(np.int64)
    order = np.argsort(-total, kind="stable")
    code = np.empty(len(distinct), np.uint32)
    code[order] = np.arange(len(order))
    cut = np.cumsum([0, *map(len, keys)])
    renamed = np.concatenate([code[inverse[i:j]][c] for i, j, c in zip(cut, cut[1:], codes, strict=False)])
    yield _rows(
        1,
        chunk=[chunk],
        doc_ids=[pa.concat_arrays(ids).to_pylist()],
        lengths=[pack(np.concatenate(lengths))],
        codes=[pack(renamed)],
    )
    del renamed, codes
    data = np.concatenate([x for x, _ in words])
    shift = np.cumsum([0, *(len(x) for x, _ in words)])
    start = np.concatenate([first[:-1] + s for (_, first), s in zip(words, shift, strict=False)])
    end = np.concatenate([first[1:] + s for (_, first), s in zip(words, shift, strict=False)])

    def listed(group: np.ndarray) -> bytes:
        """The words of these places in order of frequency."""
        some = at[order[group]]
        return _compressed(_gathered(data, start[some], end[some], 1)[0][:-1].tobytes())

    bucket = ((distinct >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)[order]
    dealt = np.argsort(bucket, kind="stable")  # codes rise within a bucket
    cut = np.searchsorted(bucket[dealt], np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(cut))
    groups = [dealt[cut[b] : cut[b + 1]] for b in used]
    if len(used):
        yield _rows(
            len(used),
            chunk=np.full(len(used), chunk),
            bucket=used,
            codes=[pack_rising(g) for g in groups],
            words=[listed(g) for g in groups],
            **({"counts": [pack(seen[order[g]]) for g in groups]} if counted else {}),
        )


def _rows(n: int, **columns) -> pa.RecordBatch:
    kinds = [
        ("chunk", pa.int64()),
        ("bucket", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.binary()),
        ("codes", pa.binary()),
        ("words", pa.binary()),
        ("counts", pa.binary()),
    ]
    arrays = [
        pa.array(columns[name], kind) if name in columns else pa.nulls(n, kind)
        for name, kind in kinds
    ]
    return pa.record_batch(arrays, [name for name, _ in kinds])


def by_bucket(table: DataFrame, buckets: int) -> DataFrame:
    """The word rows, each bucket's together."""
    return (
        table.where("bucket is not null")
        .select("bucket", "chunk", "codes", "words", "counts")
        .repartition(buckets, "bucket")
        .sortWithinPartitions("bucket", "chunk")
    )


REPLY = "chunk bigint, kind int, codes binary, values binary, words binary"


def meet(table: DataFrame, replies: DataFrame, partitions: int) -> DataFrame:
    """Documents after the replies to their chunk; replies: as REPLY, kind below 9."""
    none = F.lit(None).cast("binary")
    docs = table.where("bucket is null").select(
        "chunk", F.lit(9).alias("kind"), "codes", none.alias("values"), none.alias("words"), "doc_ids", "lengths"
    )
    return (
        replies.select("chunk", "kind", "codes", "values", "words")
        .unionByName(docs, allowMissingColumns=True)
        .repartition(partitions, "chunk")
        .sortWithinPartitions("chunk", "kind")
    )


def documents(row: dict) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, codes) of a row that holds a chunk's documents."""
    codes = unpack(row["codes"])
    at = 0
    for doc_id, n in zip(row["doc_ids"], unpack(row["lengths"]).tolist(), strict=True):
        yield doc_id, codes[at : at + n]
        at += n
