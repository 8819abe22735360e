"""Quality rules: counts over words and lines, and a linear-chain conditional random field that tells
content from boilerplate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealtide.llm import text as T
from dealtide.llm.classifier import word_shapes
from dealtide.llm.cluster import batches, phased
from dealtide.llm.lines import identity, spans

#: Labelled documents that the field is trained on, chosen by a hash of their id, and the most lines
#: of such a document.
SAMPLE, SAMPLE_LINES = 1500, 500
WINDOW = 5
BOILERPLATE, CONTENT = 0, 1
_SYMBOLS = list(b"#*$%&|<>")


@dataclass
class Field:
    """Scores of a line's features by state, of the step from state to state, and of the first state."""

    features: np.ndarray
    steps: np.ndarray
    first: np.ndarray


@dataclass
class Lines:
    """Lines of a slice that hold a word: their features, words, and where each document's lines begin."""

    features: np.ndarray
    words: np.ndarray
    first: np.ndarray


def _line_features(
    w: T.Words,
    h: np.ndarray,
    start: np.ndarray,
    end: np.ndarray,
    row: np.ndarray,
    again: np.ndarray,
    repeated: np.ndarray,
) -> Lines:
    line = np.searchsorted(start, w.start, "right") - 1
    n = np.bincount(line, minlength=len(start))
    shapes = np.concatenate([word_shapes(w, h), repeated[:, None]], axis=1)
    share = np.stack(
        [np.bincount(line, shapes[:, k], len(start)) for k in range(shapes.shape[1])], axis=1
    ) / np.maximum(n, 1)[:, None]
    last = w.data[np.maximum(end - 1, 0)] if len(w.data) else np.zeros(len(end), np.uint8)
    features = np.concatenate(
        [
            share,
            share > 0.2,
            np.stack([n < 4, n > 15, np.isin(last, list(b".!?")), again, np.ones(len(start))], axis=1),
        ],
        axis=1,
    )
    full = n > 0
    first = np.searchsorted(row[full], np.arange(len(w.offsets)))
    return Lines(features[full], n[full], first)


def _analysed(column: pa.Array) -> tuple[dict[str, np.ndarray], Lines]:
    """The counts of each text, and its lines."""
    w = T.words(column)
    h = w.hashes()
    rows = len(w.offsets) - 1
    per_row = lambda place: np.bincount(w.row, place, rows).astype(np.int64)

    def within(mark: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mark)])
        return total[w.end] - total[w.start]

    key, at = T.windows(h, w.row, WINDOW)
    order = np.lexsort((key, w.row[at]))
    same = np.zeros(len(key) + 1, bool)
    a, b = order[1:], order[:-1]
    same[1:-1] = (key[a] == key[b]) & (w.row[at[a]] == w.row[at[b]])
    found = at[order[same[1:] | same[:-1]]]
    repeated = np.zeros(len(h) + WINDOW, bool)
    for k in range(WINDOW):
        repeated[found + k] = True
    repeated = repeated[: len(h)]

    data, start, end, row, no, full = spans(column)
    one, two = identity(data, start, end)
    order = np.lexsort((no, two, one, row))
    again = np.zeros(len(row), bool)
    a, b = order[1:], order[:-1]
    again[a] = (row[a] == row[b]) & (one[a] == one[b]) & (two[a] == two[b])
    counts = {
        "n_words": w.count,
        "word_chars": per_row(within((w.data & 0xC0) != 0x80)),
        "n_symbols": per_row(within(np.isin(w.data, _SYMBOLS))),
        "n_dup_lines": np.bincount(row, again & full, rows).astype(np.int64),
        "n_repeat_words": per_row(repeated),
    }
    return counts, _line_features(w, h, start, end, row, again, repeated)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(documents: list[tuple[np.ndarray, np.ndarray]], rounds: int = 12) -> Field:
    """Conditional likelihood of the states of (features, states), by Adagrad over documents with
    forward-backward sums.
    """
    width = documents[0][0].shape[1] if documents else 0
    field = Field(np.zeros((width, 2)), np.zeros((2, 2)), np.zeros(2))
    squares = [np.full_like(x, 1e-4) for x in (field.features, field.steps, field.first)]
    random = np.random.default_rng(0)
    for _ in range(rounds):
        for d in random.permutation(len(documents)):
            x, y = documents[d]
            emit = x @ field.features
            n = len(y)
            ahead, back = np.empty((n, 2)), np.zeros((n, 2))
            ahead[0] = field.first + emit[0]
            for i in range(1, n):
                ahead[i] = _log_sum(ahead[i - 1][:, None] + field.steps, 0) + emit[i]
            for i in range(n - 2, -1, -1):
                back[i] = _log_sum(field.steps + (emit[i + 1] + back[i + 1])[None], 1)
            total = _log_sum(ahead[-1], 0)
            chance = np.exp(ahead + back - total)
            truth = np.eye(2)[y]
            pair = ahead[:-1, :, None] + field.steps[None] + (emit + back)[1:, None, :] - total
            true_pair = truth[:-1, :, None] * truth[1:, None, :]
            for value, square, g in zip(
                (field.features, field.steps, field.first),
                squares,
                (
                    x.T @ (truth - chance),
                    (true_pair - np.exp(pair)).sum(0),
                    truth[0] - chance[0],
                ),
                strict=True,
            ):
                g = g / n
                square += g * g
                value += 0.2 * g / np.sqrt(square)
    return field


def viterbi(field: Field, lines: Lines) -> np.ndarray:
    """The best states of all lines; the documents of a slice advance together, a line at a time. Ties
    are content.
    """
    emit = lines.features @ field.features if len(field.features) else np.zeros((len(lines.words), 2))
    count = np.diff(lines.first)
    order = np.argsort(-count, kind="stable")
    begin, count = lines.first[:-1][order], count[order]
    longest = int(count[0]) if len(count) else 0
    live = np.searchsorted(-count, -np.arange(1, longest + 1), "right")
    came = np.zeros((len(emit), 2), np.int8)
    score = np.zeros((len(emit), 2))
    for k in range(longest):
        at = begin[: live[k]] + k
        if k == 0:
            score[at] = field.first + emit[at]
            continue
        ways = score[at - 1][:, :, None] + field.steps
        came[at] = ways[:, 1] >= ways[:, 0]
        score[at] = ways.max(1) + emit[at]
    states = np.zeros(len(emit), np.int8)
    for k in range(longest - 1, -1, -1):
        at = begin[: live[k]] + k
        ends = count[: live[k]] == k + 1
        last = at[ends]
        states[last] = score[last, 1] >= score[last, 0]
        others = at[~ends]
        states[others] = came[others + 1, states[others + 1]]
    return states


@phased
def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """A field trained on lines of labelled documents: those of a good one are content, those of a bad
    one boilerplate.

    About `sample` documents are taken, by a hash of the id, of up to SAMPLE_LINES lines. Without
    labels, all is content.
    """
    marks = labels.where("doc_id is not null and quality is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")
    )
    share = sample / max(marks.count(), 1)
    marks = marks.where(f"pmod(xxhash64(doc_id), 1000000) < {share * 1000000}")
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(
        f"doc_id is not null and pmod(xxhash64(doc_id), 1000000) < {share * 1000000}"
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, lines = _analysed(batch.column("text"))
        out = []
        for i, (a, b) in enumerate(zip(lines.first, lines.first[1:], strict=False)):
            if 0 < b - a <= SAMPLE_LINES:
                out.append((i, lines.features[a:b].astype(np.float32).tobytes(), int(b - a)))
        at, values, n = zip(*out, strict=True) if out else ((), (), ())
        return pa.record_batch(
            [
                batch.column("doc_id").take(pa.array(at, pa.int64())),
                pa.array(values, pa.binary()),
                pa.array(n, pa.int64()),
            ],
            ["doc_id", "features", "n"],
        )

    rows = (
        texts.mapInArrow(batches(run), "doc_id bigint, features binary, n bigint")
        .join(marks, "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "n")
        .limit(2 * sample)
        .collect()
    )
    return train(
        [
            (
                np.frombuffer(r.features, np.float32).reshape(r.n, -1).astype(np.float64),
                np.full(r.n, int(r.quality > 0)),
            )
            for r in rows
        ]
    )


@phased
def judged(
    documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, content: float = 0.5
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    content_share, kept) of every text.

    Words: runs of other bytes than ASCII white space. word_chars: their code points; n_symbols:
    characters of #*$%&|<>; n_dup_lines: lines (parted by \\n) with a word that equal an earlier
    one; n_repeat_words: words in windows of 5 words found twice or more. base_failed: under 10
    words, or more than 20 % repeated. content_share: the share of words on lines that Viterbi
    decoding marks as content; kept: not base_failed, and at least `content` of them. Null texts
    have no words. Rows without doc_id are left out, rows sharing one are rows like others; other
    columns are ignored.
    """
    field = fit(documents, labels, sample)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, lines = _analysed(batch.column("text"))
        states = viterbi(field, lines)
        row = np.repeat(np.arange(len(batch)), np.diff(lines.first))
        good = np.bincount(row, lines.words * states, len(batch))
        share = good / np.maximum(counts["n_words"], 1)
        failed = (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
        return pa.record_batch(
            [
                batch.column("doc_id"),
                *map(pa.array, counts.values()),
                pa.array(failed),
                pa.array(share),
                pa.array(~failed & (share >= content)),
            ],
            ["doc_id", *counts, "base_failed", "content_share", "kept"],
        )

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(
        "doc_id is not null"
    )
    return texts.mapInArrow(
        batches(run),
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, base_failed boolean, content_share double, kept boolean",
    )
