"""Spelling variants: words one edit from a much more frequent word, found over a variable-length gram index.

A word of `size` code points is cut into grams: from each place the shortest one that few words have, between 2
letters and `longest(size)`, less those inside an earlier one. Which grams are frequent is a dictionary
counted over all words, level by level, and pruned by frequency. An edit leaves every gram as it is that
ends `longest` places before it, or that starts behind it and ends `longest` places on (the bounds hold
for the choice of the grams' lengths and for those inside another, too). So there are two grams of each
word of which any one edit leaves one as it is: the affected-gram bound of the pair is one. A word merges
the lists of the cheapest two of that kind, all grams of all words being listed, and meets every near word:

* words of equal size share a gram at the same place;
* a word one longer has it at the same place or, if it lies behind the letter put in, one further.

Of the two lists a near word is taken from one only: from the left gram's if both words are equal up to
where that gram's bound ends, else from the right one's. Then it is verified by bounded edit
distance. Words of over `LONG` code points are cut into halves in place of grams.

Defined results: a null or empty text has no words; a null doc_id is written as an empty text; repeated rows
count each; an empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealtide.llm import text as T
from dealtide.llm.cluster import merged, phased, stored

#: A run is garbled where this divides its checksum.
GARBLED = 31
#: Words have so many code points and occurrences at least.
LEAST_SIZE, LEAST_COUNT = 7, 2
#: How much more frequent a form is than its variant.
RATIO = 10
#: Grams have at most so many letters (one number holds a gram), words with grams so many.
GRAM, LONG = 8, 32
#: Grams of more words than this are frequent; of a large vocabulary, more than so small a part of its
#: letters, so the dictionary sent to the tasks has at most that many grams a level (16 bytes each).
LISTED, LETTERS = 64, 1 << 17

_SLICE = 4_000_000
_ROWS = 1 << 16
_NEVER = 1 << 40

#: Letters as one byte each: A-Z lower-cased, U+00C0 to U+00FF as they are; 0 for anything else.
_ASCII = np.zeros(256, np.uint8)
_ASCII[97:123] = _ASCII[65:91] = np.arange(97, 123)


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of a text column, 0 for each byte of anything else, and the offsets of its rows."""
    raw, offsets = T.strings(column)
    lead = raw == 0xC3
    after = np.zeros(len(raw), bool)
    after[1:] = lead[:-1]
    kept = ~lead
    at = np.concatenate([[0], np.cumsum(kept)])
    return np.where(after, raw + np.uint8(0x40), _ASCII[raw])[kept], at[offsets]


def _spans(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters within a row, of at least so many."""
    inside = data != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    kept = end - start >= least
    return start[kept], end[kept]


def _texts(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Spans of letters as strings."""
    first = np.concatenate([[0], np.cumsum(size)])
    part = data[np.repeat(start - first[:-1], size) + np.arange(first[-1])]
    high = part >= 0xC0
    ends = np.concatenate([[0], np.cumsum(1 + high)])
    out = np.empty(ends[-1], np.uint8)
    out[ends[:-1]] = np.where(high, np.uint8(0xC3), part)
    out[ends[:-1][high] + 1] = part[high] - np.uint8(0x40)
    offsets = ends[first].astype(np.int64)
    strings = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(out))
    return strings.cast(pa.string())


def _steps() -> np.ndarray:
    """crc32 of a byte, by its rule."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def checksums(
    data: np.ndarray, start: np.ndarray, size: np.ndarray, begun: np.ndarray, long: int = 64
) -> np.ndarray:
    """crc32 of spans of letters in UTF-8, going on from those of what comes before them."""
    table = _steps()
    out = np.empty(len(start), np.int64)
    order = np.argsort(-size, kind="stable")
    head = int((size > long).sum())
    for k in order[:head].tolist():
        word = data[start[k] : start[k] + size[k]].tobytes().decode("latin-1").encode()
        out[k] = zlib.crc32(word, int(begun[k]))
    order = order[head:]
    at, below, register = start[order], -size[order], ~begun[order].astype(np.uint32)
    for place in range(int(-below[0]) if len(below) else 0):
        n = int(np.searchsorted(below, -place))
        byte, r = data[at[:n] + place].astype(np.uint32), register[:n]
        high = byte >= 0xC0
        r = np.where(high, table[(r ^ np.uint32(0xC3)) & 0xFF] ^ (r >> 8), r)
        byte = np.where(high, byte - np.uint32(0x40), byte)
        register[:n] = table[(r ^ byte) & 0xFF] ^ (r >> 8)
    out[order] = ~register
    return out


def _counted(batch: pa.RecordBatch, garbled: int, least: int) -> pa.RecordBatch:
    """The distinct words of some documents with their numbers of occurrences."""
    data, offsets = _letters(batch.column("text"))
    start, end = _spans(data, offsets, least)
    ids = batch.column("doc_id").cast(pa.string()).fill_null("").to_pylist()
    begun = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    row = np.searchsorted(offsets, start, "right") - 1
    h = checksums(data, start, end - start, begun[row])
    lost = np.zeros(len(data), bool)
    due = h % garbled == 0
    lost[start[due] + h[due] % (end - start)[due]] = True
    earlier = np.concatenate([[0], np.cumsum(lost)])
    data, start, end = data[~lost], start - earlier[start], end - earlier[end]
    kept = end - start >= least
    start, end = start[kept], end[kept]
    _, at, n = np.unique(T.span_hashes(data, start, end), return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays(
        [_texts(data, start[at], (end - start)[at]), pa.array(n)], ["word", "n"]
    )


def words(
    docs: DataFrame,
    *,
    garbled: int = GARBLED,
    least_size: int = LEAST_SIZE,
    least_count: int = LEAST_COUNT,
) -> DataFrame:
    """word, n: runs of A-Z (lower-cased), a-z and U+00C0 to U+00FF, with their occurrences.

    A run whose crc32 (of `<doc_id>:<run>`) `garbled` divides loses the letter at checksum modulo size, as a
    typing error made on purpose, before it is counted.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in T.slices(batch, "text", _SLICE):
                yield _counted(part, garbled, least_size)

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    total = found.groupBy("word").agg(F.sum("n").alias("n"))
    return total.filter(F.col("n") >= least_count)


def longest(size: int) -> int:
    """Letters of the longest grams of words of a size: two must fit, with an edit between them."""
    return min(size // 2, GRAM)


def _pack(letters: np.ndarray, place: int, size: int) -> np.ndarray:
    """The grams of one size at one place, as numbers."""
    out = np.zeros(len(letters), np.uint64)
    for k in range(place, place + size):
        out = (out << np.uint64(8)) | letters[:, k]
    return out


def _by_size(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Words of a column by size: (size, their rows, their letters as a matrix)."""
    data, offsets = _letters(column)
    sizes = np.diff(offsets)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield size, rows, data[offsets[rows][:, None] + np.arange(size)]


def _gathered(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Larger batches, of bounded rows and bytes."""
    held, n, size = [], 0, 0
    for batch in rows:
        held.append(batch)
        n, size = n + len(batch), size + batch.nbytes
        if n >= _ROWS or size >= _SLICE:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n, size = [], 0, 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


@dataclass
class Dictionary:
    """The frequent grams of each size, in order, with the number of words' places that have them."""

    grams: dict[int, np.ndarray] = field(default_factory=dict)
    counts: dict[int, np.ndarray] = field(default_factory=dict)

    def frequency(self, size: int, gram: np.ndarray) -> np.ndarray:
        """How often, 0 for grams that aren't frequent."""
        listed = self.grams.get(size)
        if listed is None or not len(listed):
            return np.zeros(len(gram), np.int64)
        at = np.minimum(np.searchsorted(listed, gram), len(listed) - 1)
        return np.where(listed[at] == gram, self.counts[size][at], 0)

    def cut(self, letters: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words of one size, by place: the gram's size, its frequency, whether it is inside no earlier one."""
        n, size = letters.shape
        chosen, cost = np.zeros((n, size - 1), np.int64), np.zeros((n, size - 1), np.int64)
        for place in range(size - 1):
            open_ = np.ones(n, bool)
            for q in range(2, min(most, size - place) + 1):
                count = self.frequency(q, _pack(letters, place, q))
                chosen[open_, place] = q
                cost[open_, place] = count[open_]
                open_ &= count > 0
        end = np.arange(size - 1) + chosen
        alone = np.ones_like(end, bool)
        alone[:, 1:] = end[:, 1:] > np.maximum.accumulate(end, axis=1)[:, :-1]
        return chosen, cost, alone


def dictionary(words: DataFrame, letters: int) -> Dictionary:
    """The grams that more than max(LISTED, letters / LETTERS) places of words have, level by level.

    A gram is counted only if the one without its last letter is frequent. letters: of all words.
    """
    out = Dictionary()
    most = max(LISTED, letters // LETTERS)
    for q in range(2, GRAM + 1):
        before = out

        def count(rows: Iterator[pa.RecordBatch], q=q, before=before) -> Iterator[pa.RecordBatch]:
            for batch in _gathered(rows):
                found = [np.empty(0, np.uint64)]
                for size, _, matrix in _by_size(batch.column("word")):
                    if size > LONG + 1:
                        continue
                    for place in range(size - q + 1):
                        gram = _pack(matrix, place, q)
                        if q > 2:
                            gram = gram[before.frequency(q - 1, gram >> np.uint64(8)) > 0]
                        found.append(gram)
                gram, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([T.signed(gram), pa.array(n)], ["gram", "n"])

        counted = words.select("word").mapInArrow(count, "gram bigint, n bigint")
        total = counted.groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") > most)
        listed = total.toArrow()  # at most LETTERS rows
        gram = np.ascontiguousarray(listed.column("gram").to_numpy()).view(np.uint64)
        order = np.argsort(gram)
        out = Dictionary(
            out.grams | {q: gram[order]}, out.counts | {q: listed.column("n").to_numpy()[order]}
        )
        if not len(gram):
            break
    return out


def _key(gram: np.ndarray, size: int, longer: bool, place: int, q: int) -> np.ndarray:
    """One number of a gram, its size and place, and the words it may join: of `size`, or `size` and one more."""
    tag = np.array([((size * 2 + longer) * 64 + place) * 16 + q], np.uint64)
    return T.mix(gram + T.mix(tag))


def _halves(letters: np.ndarray, size: int, longer: bool, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the first and the last letters of long words."""
    n, width = letters.shape
    data = letters.ravel()
    start = np.arange(n) * width
    spans = np.stack([start, start + width - last], 1).ravel(), np.stack([start + first, start + width], 1).ravel()
    h = T.span_hashes(data, *spans).reshape(n, 2)
    return tuple(_key(h[:, k], size, longer, k, 0) for k in range(2))


def _listed(letters: np.ndarray, size: int, longer: bool, grams: Dictionary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The keys under which words are listed, for words of `size`: (rows, keys) by place."""
    if size > LONG:
        half = size // 2
        for key in _halves(letters, size, longer, half, size - half):
            yield np.arange(len(letters)), key
        return
    chosen, _, alone = grams.cut(letters, longest(size))
    for place in range(letters.shape[1] - 1):
        for q in np.unique(chosen[:, place]).tolist():
            rows = np.flatnonzero(alone[:, place] & (chosen[:, place] == q))
            if len(rows):
                yield rows, _key(_pack(letters[rows], place, q), size, longer, place, q)


def _asked(
    letters: np.ndarray, longer: bool, grams: Dictionary
) -> Iterator[tuple[np.ndarray, np.ndarray, bool, np.ndarray]]:
    """The two keys that words ask: (rows, keys, whether of the left gram, letters up to its bound).

    longer: for words with one letter more, else for those of the same size.
    """
    n, size = letters.shape
    if size > LONG:
        half = size // 2
        keys = _halves(letters, size, longer, half, size - half)
        for k, key in enumerate(keys):
            yield np.arange(n), key, k == 0, np.full(n, half)
        return
    most = longest(size)
    chosen, cost, alone = grams.cut(letters, most)
    places = np.arange(size - 1)
    end = places + chosen
    # The cheapest left gram up to each place, with that place in the low digits.
    cost = np.where(alone, np.maximum(cost, LISTED // 4), _NEVER)
    cheapest = np.minimum.accumulate(cost * 64 + places, axis=1)
    least, left, right = np.full(n, 2 * _NEVER * 64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    every = np.arange(n)
    for place in range(size - 1):
        # An edit up to `safe` (from 1; a letter is put in behind it) leaves this gram, one from the left
        # gram's place + most + (0 if one is put in, else 1) leaves that.
        safe = np.minimum(place, end[:, place] - most)
        latest = np.minimum(safe - most + longer, size - 2)
        other = cheapest[every, np.maximum(latest, 0)]
        total = np.where(latest >= 0, other // 64 + cost[:, place], 2 * _NEVER)
        better = total < least
        least[better], right[better] = total[better], place
        left[better] = other[better] % 64
    for which, shift, is_left in ((left, 0, True), (right, int(longer), False)):
        size_of = chosen[every, which]
        for place, q in np.unique(np.stack([which, size_of], 1), axis=0).tolist():
            rows = np.flatnonzero((which == place) & (size_of == q))
            key = _key(_pack(letters[rows], place, q), size, longer, place + shift, q)
            yield rows, key, is_left, left[rows] + most


def _index(words: DataFrame, grams: Dictionary, least: int) -> DataFrame:
    """key, near, near_n: every word under all its grams, for words of its size and of one letter less."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(rows):
            for size, at, letters in _by_size(batch.column("word")):
                for longer in (False, True) if size > least else (False,):
                    for of, key in _listed(letters, size - longer, longer, grams):
                        part = batch.take(pa.array(at[of]))
                        yield pa.RecordBatch.from_arrays(
                            [T.signed(key), part.column("word"), part.column("n")],
                            ["key", "near", "near_n"],
                        )

    return words.mapInArrow(run, "key bigint, near string, near_n bigint")


def _probes(words: DataFrame, grams: Dictionary) -> DataFrame:
    """key, word, n, longer, is_left, upto: the two grams of each word, for either kind of near words."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(rows):
            for _, at, letters in _by_size(batch.column("word")):
                for longer in (False, True):
                    for of, key, is_left, upto in _asked(letters, longer, grams):
                        part = batch.take(pa.array(at[of]))
                        yield pa.RecordBatch.from_arrays(
                            [
                                T.signed(key),
                                part.column("word"),
                                part.column("n"),
                                pa.array(np.full(len(of), longer)),
                                pa.array(np.full(len(of), is_left)),
                                pa.array(upto.astype(np.int32)),
                            ],
                            ["key", "word", "n", "longer", "is_left", "upto"],
                        )

    schema = "key bigint, word string, n bigint, longer boolean, is_left boolean, upto int"
    return words.mapInArrow(run, schema)


def near_words(words: DataFrame, *, least_size: int = LEAST_SIZE) -> DataFrame:
    """word, n, near, near_n: every pair of words one inserted, deleted or replaced letter apart, once.

    words: stored (word, n), distinct, of the letters of `words`, and of `least_size` at least.
    """
    letters = words.agg(F.sum(F.least(F.char_length("word"), F.lit(LONG + 1)))).first()[0] or 0
    grams = dictionary(words, letters)
    met = (
        (F.col("longer") | (F.col("word") < F.col("near")))
        & ((F.expr("left(word, upto) = left(near, upto)")) == F.col("is_left"))
        & (F.levenshtein("word", "near", 1) == 1)
    )
    probes, index = _probes(words, grams), _index(words, grams, least_size)
    return probes.join(merged(index), "key").filter(met).select("word", "n", "near", "near_n")


@phased
def variants(
    docs: DataFrame,
    *,
    garbled: int = GARBLED,
    least_size: int = LEAST_SIZE,
    least_count: int = LEAST_COUNT,
    ratio: int = RATIO,
) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents.

    form: the near word with the most occurrences (ties: the first in code-point order), if it has `ratio`
    times the word's; root: the end of the chain of forms, the word itself if it has none.
    """
    if least_size < 4 or ratio < 2:
        raise ValueError("words of two grams have 4 letters at least, and a form is more frequent")
    counted = stored(
        words(docs, garbled=garbled, least_size=least_size, least_count=least_count)
    )
    pairs = near_words(counted, least_size=least_size)
    ways = F.array(
        F.struct("word", F.col("near").alias("other"), F.col("near_n").alias("other_n")),
        F.struct(F.col("near").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")),
    )
    facts = (
        pairs.select(F.inline(ways))
        .groupBy("word")
        .agg(
            F.count("*").alias("n_near"),
            F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"),
        )
    )
    formed = -F.col("best.less") >= ratio * F.col("n")
    linked = stored(
        counted.join(merged(facts), "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(formed, F.col("best.other")).alias("form"),
            F.when(formed, -F.col("best.less")).alias("form_n"),
        )
    )
    # Each step of a chain has `ratio` times the occurrences of the one before.
    most = linked.agg(F.max("n")).first()[0] or 1
    steps = linked.filter(F.col("form").isNotNull()).select(
        F.col("word").alias("from"), F.col("form").alias("to")
    )
    ends = steps.select(F.col("to").alias("first")).distinct().withColumn("root", F.col("first"))
    for _ in range(int(math.log(max(most / least_count, 1), ratio))):
        ends = ends.join(merged(steps), F.col("root") == F.col("from"), "left").select(
            "first", F.coalesce("to", "root").alias("root")
        )
    return linked.join(merged(ends), F.col("form") == F.col("first"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
