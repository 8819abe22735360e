"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation, and a unigram
base.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealtide.llm import dictionary as D
from dealtide.llm.cluster import phased, stored

#: Words with a unit of their own, the most frequent ones; the size of vectors; noise classes of a
#: step, noise units of a token, and tokens of a step.
CLASSES, SIZE, NOISE, WORD_NOISE, STEP = 2000, 16, 64, 4, 8192
#: Units of the other words, times the square root of the number of distinct words.
SLOTS = 64
#: Training tokens of a group, whatever the layout of the input; rounds after which the models of several groups are joined.
GROUP, ROUNDS = 8_000_000, 3
RATE = 0.15
_SMOOTH = 0.1
#: Tokens scored together; units whose averages move together.
_SCORED, _BLOCK = 1 << 16, 512


def held_out(ids: np.ndarray | list) -> np.ndarray:
    """Whether crc32 of the id as text is divisible by 10."""
    return np.array([zlib.crc32(str(i).encode()) % 10 == 0 for i in ids], bool)


@dataclass
class Model:
    """Units: 0 the end of a text, then words or groups of words from frequent to rare; n, as context
    only, the start. Runs of units of about equal share of the square roots of the counts, about
    sqrt(n) / 2 of them, are classes; `first` has the first unit of each, and n.

    After the words a, b the context is h = mixing[0] * vectors[b] + mixing[1] * vectors[a]. A class
    scores h . heads[class] + head_bias[class], normalised over all classes; a unit h .
    targets[unit] + bias[unit], normalised over the units of its class.
    """

    vectors: np.ndarray
    targets: np.ndarray
    bias: np.ndarray
    heads: np.ndarray
    head_bias: np.ndarray
    mixing: np.ndarray
    first: np.ndarray

    @staticmethod
    def start(counts: np.ndarray) -> Model:
        n = len(counts)
        random = np.random.default_rng(0)
        share = np.cumsum(np.sqrt(np.maximum(counts, _SMOOTH)))
        cls = np.floor(share / share[-1] * np.ceil(0.5 * np.sqrt(n)) * (1 - 1e-9))
        first = np.append(np.flatnonzero(np.diff(cls, prepend=-1)), n)
        p = (counts + _SMOOTH) / (counts.sum() + _SMOOTH * n)
        of_class = np.add.reduceat(p, first[:-1])
        return Model(
            random.normal(0, 0.1, (n + 1, SIZE)).astype(np.float32),
            random.normal(0, 0.1, (n, SIZE)).astype(np.float32),
            np.log(p / np.repeat(of_class, np.diff(first))).astype(np.float32),
            random.normal(0, 0.1, (len(of_class), SIZE)).astype(np.float32),
            np.log(of_class).astype(np.float32),
            np.ones((2, SIZE), np.float32),
            first,
        )

    def copy(self) -> Model:
        return Model(*(x.copy() for x in vars(self).values()))

    def class_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.heads)), np.diff(self.first))

    def context(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        h = self.vectors.take(last, 0)
        h *= self.mixing[0]
        more = self.vectors.take(before, 0)
        more *= self.mixing[1]
        h += more
        return h


def _runs(rows: np.ndarray) -> np.ndarray:
    """Where the runs of equal numbers begin."""
    return np.flatnonzero(np.diff(rows, prepend=-1))


def _order(numbers: np.ndarray) -> np.ndarray:
    """The stable order of numbers below 2**32, by their halves: numpy sorts 16 bits by radix."""
    order = np.argsort(numbers.astype(np.uint16), kind="stable")
    high = (numbers >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def _pull(real: np.ndarray) -> np.ndarray:
    """1 - sigmoid, in place."""
    np.clip(real, -30, 30, out=real)
    np.exp(real, out=real)
    real += 1
    return np.reciprocal(real, out=real)


def _push(real: np.ndarray) -> np.ndarray:
    """-sigmoid, in place."""
    out = _pull(np.negative(real, out=real))
    return np.negative(out, out=out)


class Trainer:
    """Noise-contrastive estimation of classes, and of units within the class, with Adagrad. A step's
    tokens share their noise classes, and a token's noise units are targets of other tokens of the
    step in its class, which are drawn from the same counts. Gradients are sums over the tokens of
    a step, so that rare units learn as well.
    """

    def __init__(self, model: Model, noise: np.ndarray, seed: int):
        self.model = model.copy()
        first = model.first
        self.class_of = model.class_of()
        class_noise = np.add.reduceat(noise, first[:-1])
        self.log_class_noise = np.log(NOISE * class_noise).astype(np.float32)
        self.log_noise = np.log(WORD_NOISE * noise / class_noise[self.class_of]).astype(np.float32)
        self.reach = np.cumsum(class_noise)
        self.alone = np.diff(first) == 1
        self.random = np.random.default_rng(seed)
        self.squares = {k: np.ones_like(x) for k, x in vars(model).items() if k != "first"}
        n = len(model.bias)
        # Of each unit, as context and as target.
        self.events = np.zeros((2, n + 1), np.int64)
        self.tokens = 0

    def _move(self, name: str, rows: np.ndarray | slice, g: np.ndarray) -> None:
        squares = self.squares[name][rows] + g * g
        self.squares[name][rows] = squares
        g = RATE * g
        g /= np.sqrt(squares, out=squares)
        getattr(self.model, name)[rows] += g

    def step(self, last: np.ndarray, before: np.ndarray, target: np.ndarray) -> None:
        m, n = self.model, len(target)
        # By target, and so by class, whose units are a run.
        order = _order(target)
        last, before, target = last[order], before[order], target[order]
        of_last, of_before = m.vectors.take(last, 0), m.vectors.take(before, 0)
        # The last column of contexts stands for the bias, which is that of their counterparts.
        h = np.ones((n, SIZE + 1), np.float32)
        np.multiply(of_last, m.mixing[0], out=h[:, :SIZE])
        h[:, :SIZE] += of_before * m.mixing[1]
        cls = self.class_of[target]
        begin = _runs(cls)
        size = np.diff(begin, append=n)
        run = np.repeat(np.arange(len(begin)), size)
        # The class.
        drawn = np.searchsorted(self.reach, self.random.random(NOISE) * self.reach[-1], "right")
        drawn = np.minimum(drawn, len(m.heads) - 1)
        heads = np.c_[m.heads, m.head_bias - self.log_class_noise]
        q, noise = heads[cls[begin]].take(run, 0), heads[drawn]
        up = _pull(np.einsum("ij,ij->i", h, q))[:, None]
        down = _push(h @ noise.T)
        g_h = up * q
        g_h += down @ noise
        g_heads = np.zeros((len(m.heads), SIZE + 1), np.float32)
        g_heads[cls[begin]] = np.add.reduceat(up * h, begin)
        np.add.at(g_heads, drawn, down.T @ h)
        # The unit, where its class has others.
        place = np.arange(n) - begin[run]
        some = (~self.alone[cls] & (size[run] > 1)).astype(np.float32)
        first = _runs(target)
        many = np.diff(first, append=n)
        units = target[first]
        q = np.c_[m.targets[units], m.bias[units] - self.log_noise[units]].repeat(many, 0)
        up = (_pull(np.einsum("ij,ij->i", h, q)) * some)[:, None]
        g_h += up * q
        g_units = up * h
        for _ in range(WORD_NOISE):
            away = (1 + (self.random.random(len(begin)) * (size - 1)).astype(np.int64))[run]
            other = place + away
            other -= size[run] * (other >= size[run])
            other += begin[run]
            of_other = q.take(other, 0)
            pull = (_push(np.einsum("ij,ij->i", h, of_other)) * some)[:, None]
            of_other *= pull
            g_h += of_other
            # No two tokens have the same other one, so each is that of one.
            mine = np.empty(n, np.int64)
            mine[other] = np.arange(n)
            g_units += (pull * h).take(mine, 0)
        g_units = np.add.reduceat(g_units, first)
        self.events[1, units] += many
        contexts = np.concatenate([last, before])
        order = _order(contexts)
        contexts = contexts[order]
        begin = _runs(contexts)
        g_h = np.ascontiguousarray(g_h[:, :SIZE])
        g_vectors = np.concatenate([g_h * m.mixing[0], g_h * m.mixing[1]]).take(order, 0)
        g_vectors = np.add.reduceat(g_vectors, begin)
        self.events[0, contexts[begin]] += np.diff(begin, append=2 * n)
        g_mixing = np.stack([np.einsum("ij,ij->j", g_h, of_last), np.einsum("ij,ij->j", g_h, of_before)])
        heads = np.flatnonzero(g_heads.any(1))
        self._move("heads", heads, g_heads[heads, :SIZE])
        self._move("head_bias", heads, g_heads[heads, SIZE])
        self._move("targets", units, g_units[:, :SIZE])
        self._move("bias", units, g_units[:, SIZE])
        self._move("vectors", contexts[begin], g_vectors)
        self._move("mixing", slice(None), g_mixing)
        self.tokens += n


class Scorer:
    """Normalised log10 probabilities: of the class, summed over all classes once a context, times that
    of the unit, summed over all units of its class.
    """

    def __init__(self, model: Model):
        self.model = model
        self.class_of = model.class_of()
        self.heads = np.c_[model.heads, model.head_bias]
        self.targets = np.c_[model.targets, model.bias]

    def __call__(self, last: np.ndarray, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        m = self.model
        # By target, and so by class, whose tokens and units are runs.
        order = _order(target)
        last, before, target = last[order], before[order], target[order]
        # The last column stands for the bias.
        h = np.ones((len(last), SIZE + 1), np.float32)
        h[:, :SIZE] = m.context(last, before)
        cls = self.class_of[target]
        same = _order(before)
        same = same[_order(last[same])]
        new = (np.diff(last[same], prepend=-1) != 0) | (np.diff(before[same], prepend=-1) != 0)
        back = np.empty(len(last), np.int64)
        back[same] = np.cumsum(new) - 1
        out = np.einsum("ij,ij->i", h, self.heads.take(cls, 0))
        out -= _log_total(h.take(same[new], 0), self.heads)[back]
        score = np.einsum("ij,ij->i", h, self.targets.take(target, 0))
        ends = np.searchsorted(cls, np.arange(len(m.heads) + 1))
        for c in np.flatnonzero(np.diff(ends)):
            i, j = m.first[c], m.first[c + 1]
            if j - i > 1:
                own = slice(ends[c], ends[c + 1])
                out[own] += score[own] - _log_total(h[own], self.targets[i:j])
        placed = np.empty(len(out))
        placed[order] = out
        return placed / np.log(10)


def _log_total(h: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Of each context, the logarithm of the sum of exp(score) over the targets."""
    total = np.empty(len(h), np.float32)
    size = max(1, (1 << 18) // len(targets))
    one = np.ones(len(targets), np.float32)
    with np.errstate(over="ignore", divide="ignore"):
        for i in range(0, len(h), size):
            scores = h[i : i + size] @ targets.T
            np.exp(scores, out=scores)
            total[i : i + size] = scores @ one
        out = np.log(total)
    # Sums beyond what the numbers hold are taken relative to the greatest score.
    for i in np.flatnonzero(~np.isfinite(out)):
        scores = targets @ h[i]
        out[i] = scores.max() + np.log(np.exp(scores - scores.max()).sum())
    return out


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words))


def _level(counts: np.ndarray) -> np.ndarray:
    """The power of two at or below each count; 0 for unseen words."""
    return np.frexp(np.maximum(counts, 1).astype(np.float64))[1] - 1


@dataclass
class Units:
    """The unit of each word by its hash and training count: `best` (sorted hash and count in one number) have units
    `place`; the others of a level share its `size[level]` units by hash, from `offset[level]` on.
    """

    best: np.ndarray
    place: np.ndarray
    offset: np.ndarray
    size: np.ndarray

    @staticmethod
    def start(best: list[tuple[bytes, int]], n: np.ndarray, total: np.ndarray) -> Units:
        """n, total: the number of words of each level, and the sum of their counts."""
        keys = _hashes([w for w, _ in best]) + (np.array([c for _, c in best], np.int64) << 32)
        keys, place = np.unique(keys, return_index=True)
        counts = np.array([c for _, c in best], np.int64)
        n = n - np.bincount(_level(counts), minlength=64)
        total = total - np.bincount(_level(counts), counts, 64)
        weight = np.sqrt(np.maximum(n * total, 0.0))
        share = SLOTS * np.sqrt(n.sum()) * weight / max(weight.sum(), 1)
        size = np.minimum(n, np.ceil(share)).astype(np.int64)
        size[0] = max(size[0], 1)  # unseen words are of level 0
        # The frequent levels come first.
        offset = 1 + len(best) + size[::-1].cumsum()[::-1] - size
        return Units(keys, place + 1, offset, size)

    def __len__(self) -> int:
        return int(self.offset[0] + self.size[0])

    def __call__(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        level = _level(counts)
        unit = self.offset[level] + hashes % np.maximum(self.size[level], 1)
        if len(self.best):
            key = hashes + (counts.astype(np.int64) << 32)
            at = np.minimum(np.searchsorted(self.best, key), len(self.best) - 1)
            unit = np.where(self.best[at] == key, self.place[at], unit)
        return unit


def _totals(words: DataFrame, top: int) -> DataFrame:
    """Replies (kind 1) with each word's count over all chunks, and its hash as `words`; and, kind 2, a
    bucket's most frequent words, its sum, its number of words, and the hashes and counts of all of
    them.
    """

    def flush(rows: list[dict]) -> Iterator[tuple]:
        total: dict[bytes, int] = {}
        for row in rows:
            for w, n in zip(D.unpack_words(row["words"]), D.unpack(row["counts"]).tolist(), strict=True):
                total[w] = total.get(w, 0) + n
        seen = {w: n for w, n in total.items() if n}
        best = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:top]
        hashes = _hashes(list(seen))
        order = np.argsort(hashes)
        yield (
            None,
            2,
            None,
            D.pack(np.array([n for _, n in best], np.uint64)),
            D.pack_words([w for w, _ in best]),
            sum(seen.values()),
            len(seen),
            D.pack_rising(hashes[order]),
            D.pack(np.fromiter(seen.values(), np.int64, len(seen))[order]),
        )
        for row in rows:
            words = D.unpack_words(row["words"])
            values = np.array([total[w] for w in words], np.uint64)
            own = _hashes(words).astype(np.uint32).tobytes()
            yield row["chunk"], 1, row["codes"], D.pack(values), own, None, None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 3, pa.int64(), pa.int64(), *[pa.binary()] * 2]
        names = ["chunk", "kind", "codes", "values", "words", "total", "distinct", "hashes", "counts"]

        def out(rows: list[dict]) -> pa.RecordBatch:
            columns = zip(*flush(rows), strict=True)
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["bucket"] != row["bucket"]:
                    yield out(held)
                    held = []
                held.append(row)
        if held:
            yield out(held)

    return words.mapInArrow(
        run,
        f"{D.REPLY}, total bigint, distinct bigint, hashes binary, counts binary",
    )


class _Table:
    """Values by the codes of a chunk, from its replies."""

    def __init__(self, default: int):
        self.default = default
        self.values = np.full(1024, default, np.int64)

    def put(self, codes: np.ndarray, values: np.ndarray) -> None:
        if len(codes):
            self.reach(int(codes.max()) + 1)
            self.values[codes] = values

    def reach(self, n: int) -> None:
        if n > len(self.values):
            more = np.full(max(n, 2 * len(self.values)) - len(self.values), self.default, np.int64)
            self.values = np.concatenate([self.values, more])

    def __getitem__(self, codes: np.ndarray) -> np.ndarray:
        if len(codes):
            self.reach(int(codes.max()) + 1)
        return self.values[codes]


def _documents(batches: Iterator[pa.RecordBatch], units: Units) -> Iterator[tuple]:
    """(doc_id, units, counts) of the documents that `meet` brings after the replies to their chunk."""
    chunk, place, counts = None, _Table(0), _Table(0)
    for batch in batches:
        for k in range(len(batch)):
            row = batch.slice(k, 1).to_pylist()[0]
            if row["chunk"] != chunk:
                chunk, place, counts = row["chunk"], _Table(0), _Table(0)
            if row["kind"] == 1:
                codes, values = D.unpack_rising(row["codes"]), D.unpack(row["values"])
                counts.put(codes, values)
                place.put(codes, units(np.frombuffer(row["words"], np.uint32).astype(np.int64), values))
            else:
                for doc_id, codes in D.documents(row):
                    yield doc_id, place[codes], counts[codes]


def _narrow(values: np.ndarray) -> bytes:
    """Units in the fewest whole bytes that hold them all, the first byte telling how many."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    raw = values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    return bytes([width]) + raw.tobytes()


def _wide(blob: bytes) -> np.ndarray:
    width, raw = blob[0], np.frombuffer(blob, np.uint8, offset=1)
    out = np.zeros((len(raw) // width, 4), np.uint8)
    out[:, :width] = raw.reshape(-1, width)
    return out.view("<u4").ravel().astype(np.int64)


def _contexts(classes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(last, before, target) of each word and of the end."""
    padded = np.concatenate([[start, start], classes])
    return padded[1:], padded[:-1], np.concatenate([classes, [0]])


@phased
def score_documents(
    documents: DataFrame, classes: int = CLASSES, *, group: int = GROUP, rounds: int = ROUNDS
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text.

    Tokens: words between ASCII white space, A-Z lower-cased, then one end. Trained on the texts
    whose id's crc32 (of the id as text) isn't divisible by 10; the others are held out. base_score:
    sum of log10((c + 0.1) / (N + 0.1 (V + 1))) with the training counts. score: log10 probability
    of the text by the model.

    Counts are exact, over all training texts, summed by buckets of words. Every word has a vector as
    context and as target: the most frequent `classes` words their own, the others, by their count's
    power of two and a hash, one of SLOTS * sqrt(distinct words) that share it, so the model grows
    with the vocabulary. A word's probability is that of its class, times that of its unit within
    the class, times its smoothed share of the unit. Every partition trains on all its training
    tokens from the same start, and each unit is averaged by its occurrences, block by block of units;
    the averages reach the driver. Null texts are empty: one token, the
    end. Rows without doc_id are left out, rows sharing one are rows like others. Other columns are
    ignored.
    """
    spark = documents.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(
        "doc_id is not null"
    )
    table = D.coded(texts, buckets, lower=True, counted=lambda ids: ~held_out(ids.to_pylist()))
    totals = stored(_totals(D.by_bucket(table, buckets), classes))
    summary = totals.where("kind = 2")
    trained = "crc32(cast(cast(doc_id as string) as binary)) % 10 <> 0"
    ends = texts.where(trained).count()
    words, distinct = summary.agg(F.sum("total"), F.sum("distinct")).first()
    words, distinct = words or 0, distinct or 0

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = np.uint64(1) << np.arange(63, dtype=np.uint64)
        for batch in batches:
            for n in batch.column("values").to_pylist():
                # A bucket's counts fall.
                above = np.searchsorted(-D.unpack(n), -powers.astype(np.int64), "right")
                at = np.flatnonzero(above)
                yield pa.record_batch([pa.array(at), pa.array(above[at])], ["level", "n"])

    # Only words above the power of two that leaves enough of them are listed.
    level = (
        summary.select("values")
        .mapInArrow(levels, "level bigint, n bigint")
        .groupBy("level")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= classes)
        .agg(F.max("level"))
        .first()[0]
    )
    least = 1 << (level or 0)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, n in zip(batch.column("words").to_pylist(), batch.column("values").to_pylist(), strict=True):
                counts = D.unpack(n).astype(np.int64)
                enough = int((counts >= least).sum())
                if enough:
                    yield pa.record_batch(
                        [pa.array(D.unpack_words(w)[:enough], pa.binary()), pa.array(counts[:enough])],
                        ["word", "n"],
                    )

    best = (
        summary.select("words", "values")
        .mapInArrow(listed, "word binary, n bigint")
        .orderBy(F.desc("n"), "word")
        .limit(classes)
        .collect()
    )
    tokens, kinds = words + ends, distinct + (ends > 0)

    def by_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("counts").to_pylist():
                counts = D.unpack(blob).astype(np.int64)
                level = _level(counts)
                yield pa.record_batch(
                    [
                        pa.array(np.arange(64)),
                        pa.array(np.bincount(level, minlength=64)),
                        pa.array(np.bincount(level, counts, 64).astype(np.int64)),
                    ],
                    ["level", "n", "total"],
                )

    sizes = summary.select("counts").mapInArrow(by_level, "level bigint, n bigint, total bigint")
    n, total = np.zeros((2, 64), np.int64)
    for r in sizes.groupBy("level").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        n[r.level], total[r.level] = r.n, r.total
    units = Units.start([(bytes(r.word), r.n) for r in best], n, total)
    size = len(units)

    def by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c in zip(batch.column("hashes").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                counts = D.unpack(c).astype(np.int64)
                found, at = np.unique(units(D.unpack_rising(h), counts), return_inverse=True)
                yield pa.record_batch(
                    [
                        pa.array(found),
                        pa.array(np.bincount(at, counts, len(found)).astype(np.int64)),
                        pa.array(np.bincount(at, minlength=len(found))),
                    ],
                    ["unit", "total", "n"],
                )

    shares = summary.select("hashes", "counts").mapInArrow(by_unit, "unit bigint, total bigint, n bigint")
    shares = shares.groupBy("unit").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toPandas()
    counts, members = np.zeros((2, size))
    counts[0], members[0] = ends, 1
    counts[shares["unit"].to_numpy(np.int64)] = shares["total"].to_numpy()
    members[shares["unit"].to_numpy(np.int64)] = shares["n"].to_numpy()
    # A unit of level 0 also has one unseen word.
    members[units.offset[0] :] += 1
    noise = np.maximum(counts, _SMOOTH) / np.maximum(counts, _SMOOTH).sum()
    model = Model.start(counts)
    replies = totals.where("kind = 1").select("chunk", "kind", "codes", "values", "words")
    divisor, unit_divisor = tokens + _SMOOTH * (kinds + 1), counts + _SMOOTH * members
    shared = spark.sparkContext.broadcast((units, unit_divisor))

    def as_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, unit_divisor = shared.value
        held: list[tuple] = []
        many = 0

        def rows() -> pa.RecordBatch:
            ids, own, facts = zip(*held, strict=True)
            n, known, base, share = zip(*facts, strict=True)
            return pa.record_batch(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(held_out(ids)),
                    pa.array(n, pa.int64()),
                    pa.array(known, pa.int64()),
                    pa.array(base, pa.float64()),
                    pa.array(share, pa.float64()),
                    pa.array(own, pa.binary()),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "share", "units"],
            )

        for doc_id, own, seen in _documents(batches, units):
            seen = np.append(seen, ends)
            facts = (
                len(seen),
                int((seen > 0).sum()),
                float(np.log10((seen + _SMOOTH) / divisor).sum()),
                float(np.log10((seen + _SMOOTH) / unit_divisor[np.append(own, 0)]).sum()),
            )
            held.append((doc_id, _narrow(own), facts))
            many += len(own)
            if many >= _SCORED:
                yield rows()
                held, many = [], 0
        if held:
            yield rows()

    coded = stored(
        D.meet(table, replies, buckets).mapInArrow(
            as_units,
            "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, share double, "
            "units binary",
        )
    )
    groups = -(-int(words + ends) // group) or 1
    learned = coded.where("not held_out").select(
        F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("group"),
        F.xxhash64(F.lit(1), "doc_id").alias("place"),
        "units",
    )
    rounds = min(rounds, groups)  # a single group has nothing to join
    for k in range(rounds):
        some = learned.where(F.pmod("place", F.lit(rounds)) == k)
        dealt = some.repartitionById(groups, "group").sortWithinPartitions("group", "place", "units")
        model = _averaged(dealt, model, noise, buckets)
    sent = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            sizes = np.cumsum(batch.column("n_tokens").to_numpy())
            i = 0
            while i < len(batch):
                done = sizes[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(sizes, done + _SCORED)))
                yield rows(scorer, batch.slice(i, j - i))
                i = j

    def rows(scorer: Scorer, part: pa.RecordBatch) -> pa.RecordBatch:
        last, before, target = (
            np.concatenate(x)
            for x in zip(*(_contexts(_wide(own.as_py()), size) for own in part.column("units")), strict=True)
        )
        first = np.cumsum([0, *part.column("n_tokens").to_pylist()])[:-1]
        # A text may be longer than what is scored at once.
        pieces = (slice(i, i + _SCORED) for i in range(0, len(target), _SCORED))
        log = np.concatenate([scorer(last[p], before[p], target[p]) for p in pieces])
        log = np.add.reduceat(log, first)
        return pa.record_batch(
            [
                *[part.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")],
                pa.array(np.full(len(part), tokens)),
                part.column("base_score"),
                pa.array(log + part.column("share").to_numpy()),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return coded.mapInArrow(
        score,
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double",
    )


def _averaged(texts: DataFrame, model: Model, noise: np.ndarray, buckets: int) -> Model:
    """The model after every partition of `texts` (units) trained from it: each vector and bias averaged by its
    unit's occurrences, the rest by tokens.
    """
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast((model, noise))
    size = len(model.bias)
    shared = ("heads", "head_bias", "mixing")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, noise = sent.value
        trainer = None
        held: list[tuple] = []
        many = 0
        for own in (_wide(x) for batch in batches for x in batch.column("units").to_pylist()):
            held.append(_contexts(own, size))
            many += len(own) + 1
            if many >= STEP:
                trainer = trainer or Trainer(model, noise, 1)
                joined = [np.concatenate(x) for x in zip(*held, strict=True)]
                for i in range(0, many, STEP):
                    trainer.step(*(x[i : i + STEP] for x in joined))
                held, many = [], 0
        if many:
            trainer = trainer or Trainer(model, noise, 1)
            trainer.step(*(np.concatenate(x) for x in zip(*held, strict=True)))
        if trainer is None:
            return
        new = trainer.model
        out = [(-1, trainer.tokens, None, None, np.concatenate([getattr(new, k).ravel() for k in shared]))]
        for kind, delta in enumerate(
            (new.vectors - model.vectors, np.c_[new.targets - model.targets, new.bias - model.bias])
        ):
            weight = trainer.events[kind]
            for i in range(0, len(delta), _BLOCK):
                at = np.flatnonzero(weight[i : min(i + _BLOCK, len(delta))])
                if len(at):
                    moved = delta[i + at].astype(np.float16)
                    out.append((2 * i + kind, None, D.pack_rising(at), D.pack(weight[i + at]), moved))
        block, tokens, places, weights, moved = zip(*out, strict=True)
        yield pa.record_batch(
            [
                pa.array(block, pa.int64()),
                pa.array(tokens, pa.int64()),
                pa.array(places, pa.binary()),
                pa.array(weights, pa.binary()),
                pa.array([x.tobytes() for x in moved], pa.binary()),
            ],
            ["block", "tokens", "places", "weights", "moved"],
        )

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, sums = None, None, None

        def done() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            values = (sums[at] / total[at][:, None]).astype(np.float32)
            return pa.record_batch(
                [pa.array([now]), pa.array([at.tolist()], pa.list_(pa.int64())), pa.array([values.tobytes()])],
                ["block", "places", "values"],
            )

        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != now:
                    if now is not None:
                        yield done()
                    now, total, sums = row["block"], np.zeros(_BLOCK), None
                if now < 0:
                    at, weight = np.zeros(1, np.int64), np.array([row["tokens"]])
                    moved = np.frombuffer(row["moved"], np.float32)
                else:
                    at, weight = D.unpack_rising(row["places"]), D.unpack(row["weights"])
                    moved = np.frombuffer(row["moved"], np.float16)
                moved = moved.reshape(len(at), -1).astype(np.float64)
                if sums is None:
                    sums = np.zeros((_BLOCK, moved.shape[1]))
                total[at] += weight
                sums[at] += moved * weight[:, None]
        if now is not None:
            yield done()

    moves = texts.mapInArrow(train, "block bigint, tokens bigint, places binary, weights binary, moved binary")
    averages = moves.repartition(buckets, "block").sortWithinPartitions("block")
    averages = averages.mapInArrow(average, "block bigint, places array<bigint>, values binary")
    out = model.copy()
    for r in averages.collect():  # toLocalIterator would train once more
        values = np.frombuffer(r["values"], np.float32).reshape(len(r.places), -1)
        if r.block < 0:
            flat = values[0]
            for k in shared:
                x = getattr(out, k)
                x[...] = flat[: x.size].reshape(x.shape)
                flat = flat[x.size :]
            continue
        at = r.block // 2 + np.array(r.places)
        if r.block % 2:
            out.targets[at] += values[:, :SIZE]
            out.bias[at] += values[:, SIZE]
        else:
            out.vectors[at] += values
    return out
