"""Quality classifier without labels: overlapping heuristic labellers, their accuracies by
expectation-maximisation, and a hashed linear scorer trained on the posterior labels.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealtide.llm import text as T
from dealtide.llm.cluster import batches, phased, stored

BUCKETS = 1 << 14
#: Documents, chosen by a hash of their id, that the linear scorer is trained on.
SAMPLE = 4000
#: Least P(good) of a document that is kept.
KEPT = 0.5
ABSTAIN, BAD, GOOD = 0, 1, 2
_SYMBOLS = b"#*$%&|<>"
SHAPES = ("capitals", "exclaimed", "symbols", "only symbols", "as before", "seen", "digits")


def _classes(data: np.ndarray, members: np.ndarray | list[int]) -> np.ndarray:
    mark = np.zeros(256, np.int32)
    mark[members] = 1
    return np.concatenate([[0], np.cumsum(mark[data])])


def word_shapes(w: T.Words, h: np.ndarray) -> np.ndarray:
    """A row per word, a column per shape."""
    upper = _classes(w.data, range(65, 91))
    letters = upper + _classes(w.data, range(97, 123))
    symbols, digits = _classes(w.data, list(_SYMBOLS)), _classes(w.data, range(48, 58))
    of = lambda total: total[w.end] - total[w.start]
    size = w.end - w.start
    bang = _classes(w.data, [33])
    before = np.zeros(len(h), bool)
    before[1:] = (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])
    order = np.lexsort((np.arange(len(h)), h, w.row))
    seen = np.zeros(len(h), bool)
    a, b = order[1:], order[:-1]
    seen[a] = (h[a] == h[b]) & (w.row[a] == w.row[b])
    tail = np.maximum(w.end - 2, w.start)
    return np.stack(
        [
            (of(letters) >= 2) & (of(upper) == of(letters)),
            (size >= 2) & (bang[w.end] - bang[tail] == 2),
            of(symbols) > 0,
            (of(symbols) == size) & (size > 0),
            before,
            seen,
            of(digits) > 0,
        ],
        axis=1,
    )


def _shares(w: T.Words, shapes: np.ndarray) -> np.ndarray:
    """A row per document: the share of its words that have each shape."""
    n = len(w.count)
    sums = np.stack([np.bincount(w.row, shapes[:, k], n) for k in range(shapes.shape[1])], axis=1)
    return sums / np.maximum(w.count, 1)[:, None]


def votes(shares: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """A row per document, a column per labeller: ABSTAIN, BAD or GOOD."""
    capitals, exclaimed, symbols, bars, before, seen, _ = shares.T
    calm = (capitals < 0.2) & (exclaimed < 0.05) & (symbols < 0.05)
    out = np.zeros((len(shares), 8), np.int64)
    for k, bad in enumerate(
        [
            (capitals > 0.5) & (n_words >= 5),
            exclaimed > 0.2,
            symbols > 0.1,
            bars > 0.1,
            before > 0.2,
            (seen > 0.65) & (n_words >= 20),
        ]
    ):
        out[bad, k] = BAD
    out[calm & (n_words > 0), 6] = GOOD
    out[(before < 0.05) & (n_words > 0), 7] = GOOD
    out[n_words == 0, 6:] = BAD
    return out


def posterior(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each pattern of votes, and P(vote | class) as (class, labeller, vote); class 0 is
    bad.

    Expectation-maximisation of a mixture of two classes in which labellers err independently,
    started from: bad, if anyone says so.
    """
    good = np.where((patterns == BAD).any(1), 0.1, 0.9)
    chance = np.zeros((2, patterns.shape[1], 3))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        for v in range(3):
            chance[:, :, v] = weight @ (patterns == v) + 0.1
        chance /= chance.sum(2, keepdims=True)
        prior = (weight.sum(1) + 1) / (weight.sum() + 2)
        log = np.log(prior)[:, None] + np.log(
            chance[:, np.arange(patterns.shape[1]), patterns]
        ).sum(2)
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return good, chance


@dataclass
class Classifier:
    """label: P(good) by pattern code; chance: P(vote | class); weights of hashed words, of shapes, and
    the bias.
    """

    label: dict[int, float]
    chance: np.ndarray
    words: np.ndarray
    shapes: np.ndarray
    bias: float


def _code(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(BUCKETS)).astype(np.int64)


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(
        "doc_id is not null"
    )


def _trained(sample: list, label: dict[int, float]) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on soft labels by Adagrad."""
    words, shapes, bias = np.zeros(BUCKETS), np.zeros(len(SHAPES)), 0.0
    square_w, square_s, square_b = np.full(BUCKETS, 1e-8), np.full(len(SHAPES), 1e-8), 1e-8
    rows = [
        (
            np.frombuffer(r.buckets, np.int32),
            np.frombuffer(r.shares, np.float32),
            np.array(r.shapes),
            label[r.code],
        )
        for r in sample
    ]
    random = np.random.default_rng(0)
    for _ in range(10):
        for k in random.permutation(len(rows)):
            at, share, shape, y = rows[k]
            z = bias + words[at] @ share + shapes @ shape
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            square_w[at] += (g * share) ** 2
            words[at] -= 0.05 * g * share / np.sqrt(square_w[at])
            square_s += (g * shape) ** 2
            shapes -= 0.5 * g * shape / np.sqrt(square_s)
            square_b += g * g
            bias -= 0.1 * g / np.sqrt(square_b)
        words *= 0.8  # single words say little; shrink them against noise
    return words, shapes, float(bias)


@phased
def fit(documents: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Labellers vote on all documents; their accuracies come from the counts of all patterns of votes
    (3 ** 8 at most).

    The linear scorer is trained on about `sample` documents, chosen by a hash of their id.
    """
    texts = _texts(documents)

    def vote(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = T.words(batch.column("text"))
        code = _code(votes(_shares(w, word_shapes(w, w.hashes(True))), w.count))
        keys, n = np.unique(code, return_counts=True)
        return pa.record_batch([pa.array(keys), pa.array(n)], ["code", "n"])

    counted = texts.mapInArrow(batches(vote), "code bigint, n bigint").groupBy("code")
    counted = counted.agg(F.sum("n").alias("n")).orderBy("code").collect()
    codes = np.array([r.code for r in counted], np.int64)
    counts = np.array([r.n for r in counted], np.float64)
    patterns = codes[:, None] // 3 ** np.arange(8) % 3
    good, chance = posterior(patterns, counts)
    label = dict(zip(codes.tolist(), good.tolist(), strict=True))

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = T.words(batch.column("text"))
        h = w.hashes(True)
        shares = _shares(w, word_shapes(w, h))
        row, key = w.row, _buckets(h)
        pair, n = np.unique(row * BUCKETS + key, return_counts=True)
        cut = np.searchsorted(pair, np.arange(len(batch) + 1) * BUCKETS)
        at = (pair % BUCKETS).astype(np.int32)
        share = (n / np.maximum(w.count, 1)[pair // BUCKETS]).astype(np.float32)
        spans = list(zip(cut, cut[1:], strict=False))
        return pa.record_batch(
            [
                batch.column("doc_id"),
                pa.array(_code(votes(shares, w.count))),
                pa.array([at[i:j].tobytes() for i, j in spans], pa.binary()),
                pa.array([share[i:j].tobytes() for i, j in spans], pa.binary()),
                pa.array(list(shares), pa.list_(pa.float64())),
            ],
            ["doc_id", "code", "buckets", "shares", "shapes"],
        )

    share = sample / max(counts.sum(), 1)
    chosen = texts.where(f"pmod(xxhash64(doc_id), 1000000) < {share * 1000000}")
    rows = (
        chosen.mapInArrow(
            batches(features),
            "doc_id bigint, code bigint, buckets binary, shares binary, shapes array<double>",
        )
        .orderBy(F.xxhash64("doc_id"), "doc_id", "code")
        .limit(2 * sample)
        .collect()
    )
    return Classifier(label, chance, *_trained(rows, label))


def _scorer(
    model: Classifier,
) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of texts: the number of words, P(good) by the labellers, P(good) by the linear scorer."""

    def score(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = T.words(texts)
        h = w.hashes(True)
        shares = _shares(w, word_shapes(w, h))
        code = _code(votes(shares, w.count)).tolist()
        z = np.bincount(w.row, model.words[_buckets(h)], len(texts)) / np.maximum(w.count, 1)
        z += shares @ model.shapes + model.bias
        p = np.where(w.count > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
        return w.count, np.array([model.label.get(c, 0.5) for c in code], np.float64), p

    return score


@phased
def classified(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_words, weak_label, score, kept) of every document with an id.

    weak_label: P(good) by the labellers; score: P(good) by the linear scorer over hashed words and
    word shapes; kept: score >= 0.5. Null texts and texts without words aren't kept. Rows sharing an
    id are rows like others; other columns are ignored. Without any document the result is empty.
    """
    score = _scorer(fit(documents, sample))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, label, p = score(batch.column("text"))
        return pa.record_batch(
            [batch.column("doc_id"), *map(pa.array, (n, label, p, p >= KEPT))],
            ["doc_id", "n_words", "weak_label", "score", "kept"],
        )

    return _texts(documents).mapInArrow(
        batches(run),
        "doc_id bigint, n_words bigint, weak_label double, score double, kept boolean",
    )


@phased
def accepted(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents, whole rows, that `classified` keeps, filtered where they are read. Rows without
    id are judged like others.
    """
    score = _scorer(fit(documents, sample))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(score(batch.column("text"))[2] >= KEPT))

    return documents.mapInArrow(batches(run), documents.schema)
