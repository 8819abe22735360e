"""Line deduplication: equal lines, and lines within a few edits by a segment-partition join."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealtide.llm import text as T
from dealtide.llm.cluster import batches, fresh, phased, sent, stored

_NEWLINE = 10
WORD = re.compile("[^\x20\x09-\x0d]")


def spans(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Of lines parted by \\n: the bytes, the spans, the row, the number in its row, and whether it has
    a word.
    """
    data, offsets = T.strings(column)
    cut = np.flatnonzero(data == _NEWLINE)
    start = np.concatenate([offsets[:-1], cut + 1])
    row = np.concatenate(
        [np.arange(len(offsets) - 1), np.searchsorted(offsets, cut, "right") - 1]
    )
    # Each row begins a line, and each break another one.
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    begins = np.searchsorted(row, np.arange(len(offsets)))
    number = np.arange(len(row)) - begins[row]
    end = np.empty(len(row), np.int64)
    end[:-1] = start[1:] - 1
    end[begins[1:] - 1] = offsets[1:]
    seen = np.concatenate([[0], np.cumsum(~T.SPACES[data])])
    return data, start, end, row, number, seen[end] > seen[start]


def identity(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes."""
    return T.span_hashes(data, start, end), T.span_hashes(T.SCRAMBLED[data], start, end)


def _occurrences(texts: DataFrame) -> DataFrame:
    """(h, g, size, doc_id, no, again): every line with a word; again: an equal one is above it in the
    text.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, start, end, row, no, full = spans(batch.column("text"))
        h, g = identity(data, start, end)
        order = np.lexsort((no, g, h, row))
        again = np.zeros(len(row), bool)
        a, b = order[1:], order[:-1]
        again[a] = (row[a] == row[b]) & (h[a] == h[b]) & (g[a] == g[b])
        ids = batch.column("doc_id").take(pa.array(row[full]))
        return pa.record_batch(
            [
                T.signed(h[full]),
                T.signed(g[full]),
                pa.array((end - start)[full]),
                ids,
                pa.array(no[full]),
                pa.array(again[full]),
            ],
            ["h", "g", "size", "doc_id", "no", "again"],
        )

    return texts.mapInArrow(
        batches(run), "h bigint, g bigint, size bigint, doc_id bigint, no bigint, again boolean"
    )


def _histograms(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of all lines: counts of 16 classes of bytes, modulo 16, in 4 bits each."""
    kind = (T.SCRAMBLED[data] & 15).astype(np.int64)
    kind[data == _NEWLINE] = 16
    line = np.repeat(np.arange(len(start)), np.diff(start, append=len(data)))
    counts = np.bincount(line * 17 + kind, minlength=len(start) * 17).reshape(-1, 17)[:, :16] & 15
    return (counts.astype(np.uint64) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(
        axis=1, dtype=np.uint64
    )


def _segment(size: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i of lines of a size: even parts, the longer ones last."""
    least, over = size // parts, size % parts
    longer = np.maximum(i - (parts - over), 0)
    return i * least + longer, least + (i >= parts - over)


def _segments(texts: DataFrame, edits: int, least: int) -> DataFrame:
    """(h, sign, own, probes): of each distinct line of `least` bytes or more, the keys of its segments
    and of the substrings that may equal segments of lines as long or up to `edits` bytes shorter.

    A line that differs by at most `edits` holds one of the edits + 1 segments of the shorter one
    unchanged, moved by no more than the edits on either side of it.
    """
    parts = edits + 1

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, start, end, _, _, _ = spans(batch.column("text"))
        h, sign = T.span_hashes(data, start, end), _histograms(data, start)
        _, once = np.unique(h, return_index=True)
        once = once[(end - start)[once] >= least]
        h, sign, start, size = h[once], sign[once], start[once], (end - start)[once]
        total = T.sums(data)

        def keys(shorter: int, i: int, move: int) -> tuple[np.ndarray, np.ndarray]:
            of = size - shorter
            at, long = _segment(of, i, parts)
            at = at + move
            ok = np.flatnonzero((of >= least) & (at >= 0) & (at + long <= size))
            a = (start + at)[ok]
            key = T.between(total, a, a + long[ok]) + np.uint64(i + 1)
            return ok, T.mix(key ^ T.mix(of[ok].astype(np.uint64)))

        def lists(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
            line = np.concatenate([x for x, _ in found])
            order = np.argsort(line, kind="stable")
            cut = np.searchsorted(line[order], np.arange(len(h) + 1))
            key = np.concatenate([x for _, x in found])[order]
            return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), T.signed(key))

        own = lists([keys(0, i, 0) for i in range(parts)])
        probes = lists(
            [
                keys(shorter, i, move)
                for shorter in range(edits + 1)
                for i in range(parts)
                for move in range(
                    max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1
                )
            ]
        )
        return pa.record_batch(
            [T.signed(h), T.signed(sign), own, probes], ["h", "sign", "own", "probes"]
        )

    schema = "h bigint, sign bigint, own array<bigint>, probes array<bigint>"
    return texts.mapInArrow(batches(run), schema).repartition("h").dropDuplicates(["h"])


def _alike(edits: int) -> str:
    """SQL: two histograms differ by at most twice the edits, as a substitution changes two counts."""
    nibble = "(({0}.sign >> {1}) & 15)"
    parts = []
    for c in range(0, 64, 4):
        gap = f"pmod({nibble.format('r', c)} - {nibble.format('s', c)}, 16)"
        parts.append(f"least({gap}, 16 - {gap})")
    return f"{' + '.join(parts)} <= {2 * edits}"


def within(
    a: list[bytes], b: list[bytes], edits: int
) -> np.ndarray:
    """Edit distances of pairs over bytes, or edits + 1 where they are more.

    All pairs advance together, a byte of b at a time. For e = 0..edits a word of 2 * edits + 1 bits
    holds the diagonals of the band that are reached with at most e edits; a match keeps a bit, a
    substitution takes it from e - 1, an insertion and a deletion from the neighbouring diagonals of
    e - 1.
    """
    n_a = np.array([len(x) for x in a], np.int64)
    n_b = np.array([len(x) for x in b], np.int64)
    order = np.argsort(n_b, kind="stable")
    pad = edits + 1
    at_a = np.cumsum(n_a + 2 * pad) - n_a - pad
    bytes_a = np.full(int((n_a + 2 * pad).sum()), 256, np.uint16)
    for x, at in zip(a, at_a.tolist(), strict=True):
        bytes_a[at : at + len(x)] = np.frombuffer(x, np.uint8)
    bytes_b = np.frombuffer(b"".join(b), np.uint8)
    at_b = np.cumsum(n_b) - n_b
    out = np.full(len(a), edits + 1, np.int64)
    diagonal = n_a - n_b + edits
    near = (diagonal >= 0) & (diagonal <= 2 * edits)
    order = order[near[order]]
    one = np.uint64(1)
    band = np.uint64((1 << (2 * edits + 1)) - 1)
    # Before any byte of b, row d of a costs d deletions.
    reach = [
        np.full(len(order), sum(1 << (edits + d) for d in range(e + 1)), np.uint64)
        for e in range(edits + 1)
    ]
    at_a, at_b, n_b, diagonal = at_a[order], at_b[order], n_b[order], diagonal[order]
    begin, step = 0, 0
    while begin < len(order):
        done = begin + int(np.searchsorted(n_b[begin:], step, "right"))
        for k in range(begin, done):
            for e in range(edits, -1, -1):
                if int(reach[e][k - begin]) >> int(diagonal[k]) & 1:
                    out[order[k]] = e
        reach = [r[done - begin :] for r in reach]
        begin = done
        if begin >= len(order):
            break
        letter = bytes_b[at_b[begin:] + step]
        match = np.zeros(len(letter), np.uint64)
        for d in range(-edits, edits + 1):
            place = np.clip(at_a[begin:] + step + d, 0, len(bytes_a) - 1)
            same = (bytes_a[place] == letter) & (step + d >= 0)
            match |= same.astype(np.uint64) << np.uint64(d + edits)
        new = [reach[0] & match]
        for e in range(1, edits + 1):
            new.append(
                ((reach[e] & match) | reach[e - 1] | (reach[e - 1] >> one) | (new[e - 1] << one))
                & band
            )
        reach = new
        step += 1
    return out


def _near(texts: DataFrame, firsts: DataFrame, edits: int, least: int) -> DataFrame:
    """(h, g, size): lines with an earlier one at most `edits` edits away."""
    segments = stored(_segments(texts, edits, least))
    index = segments.select("h", "sign", F.explode("own").alias("key")).alias("r")
    probes = segments.select("h", "sign", F.explode("probes").alias("key")).alias("s")
    pairs = stored(
        index.join(probes, F.expr(f"r.key = s.key and r.h <> s.h and {_alike(edits)}"))
        .select(F.col("r.h").alias("a"), F.col("s.h").alias("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    of = lambda side: firsts.select(
        F.col("h").alias(side), F.struct("h", "g", "size", "doc_id", "no").alias(f"line_{side}")
    )
    both = pairs.join(of("a"), "a").join(of("b"), "b").where(f"abs(line_a.size - line_b.size) <= {edits}")
    earlier = F.struct("line_a.doc_id", "line_a.no") < F.struct("line_b.doc_id", "line_b.no")
    both = stored(
        both.select(
            F.when(earlier, F.col("line_a")).otherwise(F.col("line_b")).alias("kept"),
            F.when(earlier, F.col("line_b")).otherwise(F.col("line_a")).alias("late"),
        )
    )
    wanted = both.select("kept.doc_id", "kept.no").union(both.select("late.doc_id", "late.no"))
    wanted = stored(wanted.groupBy("doc_id").agg(F.collect_set("no").alias("wanted")))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for i, text, numbers in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "wanted")), strict=True):
            lines = text.encode().split(b"\n")
            out += [(i, no, lines[no]) for no in numbers if no < len(lines)]
        return pa.record_batch(
            [pa.array(c) for c in zip(*out, strict=True)], ["doc_id", "no", "line"]
        )

    lines = stored(
        texts.where("text is not null")
        .join(sent(wanted), "doc_id")
        .mapInArrow(batches(cut), "doc_id bigint, no bigint, line binary")
    )
    line = lambda side: lines.select(
        F.struct("doc_id", "no").alias(f"at_{side}"), F.col("line").alias(side)
    )

    def verify(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ok = within(batch.column("x").to_pylist(), batch.column("y").to_pylist(), edits) <= edits
            if ok.any():
                yield batch.select(["h", "g", "size"]).filter(pa.array(ok))

    return (
        both.select(
            F.struct("kept.doc_id", "kept.no").alias("at_x"),
            F.struct("late.doc_id", "late.no").alias("at_y"),
            "late.h",
            "late.g",
            "late.size",
        )
        .join(line("x"), "at_x")
        .join(line("y"), "at_y")
        .select("h", "g", "size", "x", "y")
        .mapInArrow(verify, "h bigint, g bigint, size bigint")
        .distinct()
    )


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(
        "doc_id is not null"
    )


@phased
def repeated_lines(documents: DataFrame, edits: int = 2, least: int = 30) -> DataFrame:
    """(doc_id, no): the lines to remove; `no` counts the lines of the text, parted by \\n, from 0.

    In the order of (doc_id, no), a line is removed if an equal one comes before it, or if it has
    `least` bytes or more and a line of as many bytes at most `edits` edits of bytes away first
    occurs before its own first occurrence. Lines are judged on the input, whatever becomes of the
    earlier one. Lines without a word stay.

    Each distinct line is cut into edits + 1 segments; any line near it holds one of them, so
    segments are joined with the substrings that may equal them by position and length. Histograms
    of bytes in the join's condition keep families of similar lines from forming all pairs. What
    passes is verified by banded bit-parallel edit distance. Rows without doc_id are left out; null
    texts have no lines; rows sharing a doc_id are one document whose line numbers are those of
    either text. Other columns are ignored.
    """
    texts = _texts(documents)
    occurrences = stored(_occurrences(texts))
    firsts = stored(
        occurrences.where("not again")
        .groupBy("h", "g", "size")
        .agg(F.min("doc_id").alias("doc_id"), F.min_by("no", "doc_id").alias("no"))
    )
    near = stored(_near(texts, firsts, edits, least))
    line = ["h", "g", "size"]
    later = occurrences.join(firsts.withColumnRenamed("doc_id", "first").drop("no"), line).where(
        "again or doc_id > first"
    )
    return (
        later.select("doc_id", "no")
        .union(occurrences.join(near, line, "left_semi").select("doc_id", "no"))
        .distinct()
    )


def _numbered(removed: DataFrame) -> DataFrame:
    return removed.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("no").alias("_gone"))


def _cut(text: str, gone: list[int]) -> tuple[str, int, int]:
    """The text without those lines, its number of lines, and how many went."""
    lines, drop = text.split("\n"), set(gone)
    kept = [x for i, x in enumerate(lines) if i not in drop]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


@phased
def changed_documents(documents: DataFrame, removed: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) of the documents that lose a line; removed: as of
    `repeated_lines`.
    """
    joined = _texts(documents).join(_numbered(removed), F.col("doc_id") == F.col("_id"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(batch.column("text").to_pylist(), batch.column("_gone").to_pylist(), strict=True)
        text, n, gone = zip(*(_cut(t or "", g) for t, g in rows), strict=True)
        return pa.record_batch(
            [batch.column("doc_id"), pa.array(text), pa.array(n), pa.array(gone)],
            ["doc_id", "text", "n_lines", "n_removed"],
        )

    return joined.select("doc_id", "text", "_gone").mapInArrow(
        batches(run), "doc_id bigint, text string, n_lines bigint, n_removed bigint"
    )


@phased
def without_repeated_lines(documents: DataFrame, **parameters) -> DataFrame:
    """The documents, whole rows, without the lines that `repeated_lines` finds; n_chars, if there,
    follows the text.

    A document that is left without a word goes, if it had one. Rows without id stay as they are.
    """
    names = documents.columns
    key, listed = fresh(documents, "gone_id"), fresh(documents, "gone_lines")
    gone = _numbered(repeated_lines(documents, **parameters)).toDF(key, listed)
    joined = documents.join(gone, documents["doc_id"].cast("bigint") == gone[key], "left").drop(key)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(listed).to_pylist()
        columns = {c: batch.column(c) for c in names}
        if any(lists):
            texts = columns["text"].to_pylist()
            left = [_cut(t, g)[0] if g and t else t for t, g in zip(texts, lists, strict=True)]
            columns["text"] = pa.array(left, columns["text"].type)
            if "n_chars" in columns:
                n = columns["n_chars"]
                size = [len(t) if g else k for t, g, k in zip(left, lists, n.to_pylist(), strict=True)]
                columns["n_chars"] = pa.array(size, n.type)
            stays = [not g or bool(WORD.search(t or "")) for t, g in zip(left, lists, strict=True)]
            batch = pa.record_batch(list(columns.values()), names)
            return batch.filter(pa.array(stays))
        return pa.record_batch(list(columns.values()), names)

    return joined.mapInArrow(batches(run), documents.schema)
