"""BPE encoding and decoding over a table of distinct words."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cache
from itertools import batched, pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealtide.llm import dictionary as D
from dealtide.llm import text as T
from dealtide.llm.cluster import giving_back, phased, stored

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Punctuation that is no part of a contraction or a special token.
_CLOSING = np.zeros(256, bool)
_CLOSING[[ord(c) for c in ".,;:!?*&%$#()"]] = True


def _split(column: pa.Array) -> T.Words:
    """Words between ASCII white space, and cut where such punctuation follows an ASCII letter.

    The tokenizer's pattern never crosses these places, its normaliser works on either side alone,
    and no special token holds one, so words are encoded one by one with the result of the whole
    text.
    """
    w = T.words(column)
    cut = np.zeros(len(w.data) + 1, bool)
    cut[1:-1] = _LETTER[w.data[:-1]] & _CLOSING[w.data[1:]]
    cut[w.offsets] = False
    cut = np.flatnonzero(cut)
    start = np.sort(np.concatenate([w.start, cut]))
    end = np.sort(np.concatenate([w.end, cut]))
    first = np.searchsorted(start, w.offsets)
    return T.Words(w.data, w.offsets, start, end, np.repeat(np.arange(len(column)), np.diff(first)), first)


@cache
def _tokenizer(definition: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _encoded(words: DataFrame, definition: str) -> DataFrame:
    """(chunk, kind 1, codes, values: the ids, words: the number of ids of each word); each distinct
    word of a bucket is encoded once.
    """

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(definition)
        bucket, known = None, {}
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("bucket", "chunk", "codes", "words"))
            for b, chunk, codes, blob in zip(*columns, strict=True):
                if b != bucket:
                    bucket, known = b, {}
                words = D.unpack_words(blob)
                new = [w for w in words if w not in known]
                texts = [w.decode() for w in new]
                for w, e in zip(new, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
                    known[w] = e.ids
                ids = [known[w] for w in words]
                values = np.fromiter((i for x in ids for i in x), np.uint32)
                lengths = np.fromiter(map(len, ids), np.uint32, len(ids))
                yield pa.record_batch(
                    [
                        pa.array([chunk]),
                        pa.array([1], pa.int32()),
                        pa.array([codes]),
                        pa.array([D.pack(values)]),
                        pa.array([D.pack(lengths)]),
                    ],
                    ["chunk", "kind", "codes", "values", "words"],
                )

    return words.mapInArrow(run, D.REPLY)


def _pieces(encoded: DataFrame, vocabulary: dict[int, str]) -> list[bytes]:
    """Pieces by id: the ids in use, joined with the table of pieces; a row per id of the vocabulary at most."""
    table = encoded.sparkSession.createDataFrame(
        list(vocabulary.items()), "id bigint, piece string"
    )
    size = max(vocabulary, default=-1) + 1

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, bool)
        for batch in batches:
            for values in batch.column("values").to_pylist():
                seen[D.unpack(values)] = True
        yield pa.record_batch([pa.array(np.flatnonzero(seen))], ["id"])

    ids = encoded.select("values").mapInArrow(used, "id bigint").distinct()
    pieces = [b""] * size
    for row in ids.join(F.broadcast(table), "id").collect():
        pieces[row.id] = row.piece.encode()
    return pieces


def _placed(
    docs: tuple[tuple[int | None, np.ndarray], ...], ids: list[bytes], decoded: list[bytes]
) -> pa.RecordBatch:
    numbers, joined, texts = [], [], []
    for doc_id, codes in docs:
        listed = codes.tolist()
        numbers.append(doc_id)
        joined.append(b"".join([ids[c] for c in listed]))
        # A word of white space beyond ASCII has no ids.
        texts.append(b" ".join([d for c in listed if (d := decoded[c])]).decode())
    return pa.record_batch(
        [
            pa.array(numbers, pa.int64()),
            pa.array([len(x) // 4 for x in joined], pa.int64()),
            pa.array(joined, pa.binary()),
            pa.array(texts, pa.string()),
        ],
        ["doc_id", "n_tokens", "ids", "decoded"],
    )


@phased
def encode_decode(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): every text as the tokenizer encodes it, and its ids decoded
    again.

    ids: little-endian unsigned 32-bit integers; decoded: the pieces of the ids joined by a space,
    as the library does for a tokenizer without decoder. The tokenizer is a file of the tokenizers
    library whose pattern cuts at white space, with no special tokens added; those found in a text
    count. Null texts are empty and have no ids; rows without doc_id and rows sharing one are rows
    like others; other columns are ignored.

    Texts are split to words, and each distinct word is encoded once. Ids go back to the chunks of
    documents that hold the word and are put in the places of its occurrences. The ids of a chunk
    are joined with the table of pieces.
    """
    definition = Path(tokenizer_path).read_text()
    tokenizer = _tokenizer(definition)
    if tokenizer.decoder is not None or tokenizer.post_processor is not None:
        raise ValueError("a tokenizer without decoder and post-processor is needed")
    vocabulary = {i: p for p, i in tokenizer.get_vocab(with_added_tokens=True).items()}
    spark = documents.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    table = D.coded(texts, buckets, _split)
    encoded = stored(_encoded(D.by_bucket(table, buckets), definition))
    pieces = _pieces(encoded, vocabulary)

    @giving_back
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ids, decoded = None, [], []
        for batch in batches:
            # One row at a time, as a chunk's documents are large.
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(len(batch))):
                if row["chunk"] != chunk:
                    chunk, ids, decoded = row["chunk"], [], []
                if row["kind"] == 1:
                    values = D.unpack(row["values"])
                    cut = [0, *np.cumsum(D.unpack(row["words"])).tolist()]
                    raw, listed = values.astype("<u4").tobytes(), values.tolist()
                    codes = D.unpack_rising(row["codes"]).tolist()
                    more = [b""] * (codes[-1] + 1 - len(ids))
                    ids += more
                    decoded += more
                    for c, (i, j) in zip(codes, pairwise(cut), strict=True):
                        ids[c] = raw[4 * i : 4 * j]
                        decoded[c] = b" ".join([pieces[k] for k in listed[i:j]])
                else:
                    for some in batched(D.documents(row), 1000):
                        yield _placed(some, ids, decoded)

    return D.meet(table, encoded, buckets).mapInArrow(
        place, "doc_id bigint, n_tokens bigint, ids binary, decoded string"
    )
