"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealtide.llm import text as T
from dealtide.llm.cluster import batches, fresh, phased, stored

#: Up to so many distinct seeds (8 bytes each) are sent to the tasks; beyond, seeds are joined by a
#: shuffle.
SENT_SEEDS = 1 << 20


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(T.mix(values) * T.powers(len(values)), out=out[1:])
    return out


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows of `size` words without a marked one."""
    n = len(marked) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    taken = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(taken[size:] == taken[:n])


def tiles(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in doc, place in item, length) of matches that don't overlap,
    longest first.

    The greatest length with a common unmarked run is found by bisection, each step comparing the
    rolling Karp-Rabin hashes of all unmarked windows of one length. All such runs are marked in
    order of their places, and the search goes on below that length until no run of `min_match`
    words is left.
    """
    of_doc, of_item = _sums(doc), _sums(item)
    in_doc, in_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    found: list[tuple[int, int, int]] = []

    def common(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, b = _free(in_doc, size), _free(in_item, size)
        x, y = T.between(of_doc, a, a + size), T.between(of_item, b, b + size)
        return a, x, b, y

    longest = min(len(doc), len(item))
    while True:
        low, high = min_match - 1, longest
        while low < high:
            middle = (low + high + 1) // 2
            _, x, _, y = common(middle)
            low, high = (middle, high) if np.isin(y, x).any() else (low, middle - 1)
        if low < min_match:
            return found
        a, x, b, y = common(low)
        order = np.argsort(x, kind="stable")
        a, x = a[order], x[order]
        begin, end = np.searchsorted(x, y, "left"), np.searchsorted(x, y, "right")
        for j, lo, hi in zip(b.tolist(), begin.tolist(), end.tolist(), strict=True):
            if in_item[j : j + low].any():
                continue
            for i in a[lo:hi].tolist():
                if not in_doc[i : i + low].any() and (doc[i : i + low] == item[j : j + low]).all():
                    in_doc[i : i + low] = in_item[j : j + low] = True
                    found.append((i, j, low))
                    break
        longest = low - 1


def _word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs of letters, digits and non-ASCII bytes, A-Z lower-cased: hashes, rows, first of each
    row.
    """
    w = T.words(column, T.NOT_ALNUM)
    return w.hashes(lower=True), w.row, w.first


def _items(benchmark: DataFrame, min_match: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, row, first = _word_hashes(batch.column("text"))
        key, at = T.windows(h, row, min_match)
        cut = np.searchsorted(row[at], np.arange(len(batch) + 1))
        seeds = [np.unique(key[i:j]).view(np.int64) for i, j in zip(cut, cut[1:], strict=False)]
        words = [h[i:j].tobytes() for i, j in zip(first, first[1:], strict=False)]
        return pa.record_batch(
            [
                batch.column("item_id").cast(pa.string()),
                pa.array(words, pa.binary()),
                pa.array(seeds, pa.list_(pa.int64())),
            ],
            ["item", "item_words", "seeds"],
        )

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return rows.where("item_id is not null").mapInArrow(
        batches(run), "item string, item_words binary, seeds array<bigint>"
    )


def _runs(texts: DataFrame, min_match: int, seeds: np.ndarray | None) -> DataFrame:
    """Per document with a seed: its seeds, and the words that they cover, runs parted by a 0.

    The seeds to look for are those given, or those in the row's own column `seeds`.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        h, row, _ = _word_hashes(batch.column("text"))
        key, at = T.windows(h, row, min_match)
        if seeds is not None:
            place = np.searchsorted(seeds, key)
            hit = np.zeros(len(key), bool) if not len(seeds) else seeds[np.minimum(place, len(seeds) - 1)] == key
        else:
            own = batch.column("seeds")
            flat = own.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            n = np.diff(own.offsets.to_numpy())
            tag = T.mix(np.repeat(np.arange(len(batch)), n).astype(np.uint64) + np.uint64(1))
            hit = np.isin(key ^ T.mix(row[at].astype(np.uint64) + np.uint64(1)), flat ^ tag)
        key, at = key[hit], at[hit]
        if not len(at):
            return None
        covered = np.zeros(len(h) + min_match, bool)
        for k in range(min_match):
            covered[at + k] = True
        covered = covered[: len(h)]
        found = np.unique(row[at])
        cut = np.searchsorted(row[at], [*found, len(batch)])
        words = []
        for r in found:
            i, j = np.searchsorted(row, [r, r + 1])
            own_words = np.where(covered[i:j], h[i:j], np.uint64(0))
            keep = covered[i:j].copy()
            keep[1:] |= covered[i : j - 1]  # the 0 after a run
            words.append(own_words[keep].tobytes())
        return pa.record_batch(
            [
                batch.column("doc_id").take(pa.array(found)),
                pa.array(words, pa.binary()),
                pa.array(
                    [np.unique(key[i:j]).view(np.int64) for i, j in zip(cut, cut[1:], strict=False)],
                    pa.list_(pa.int64()),
                ),
            ],
            ["doc_id", "doc_words", "seeds"],
        )

    return texts.mapInArrow(batches(run), "doc_id bigint, doc_words binary, seeds array<bigint>")


def _all_seeds(texts: DataFrame, min_match: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, row, _ = _word_hashes(batch.column("text"))
        key, at = T.windows(h, row, min_match)
        row, key = T.distinct(row[at], key)
        return pa.record_batch(
            [batch.column("doc_id").take(pa.array(row)), T.signed(key)], ["doc_id", "seed"]
        )

    return texts.mapInArrow(batches(run), "doc_id bigint, seed bigint")


@phased
def contaminations(
    documents: DataFrame,
    benchmark: DataFrame,
    min_match: int = 5,
    threshold: float = 0.5,
    sent_seeds: int = SENT_SEEDS,
) -> DataFrame:
    """Documents that hold a benchmark item, in whole or in parts and in any order.

    Returns doc_id, item_id (string), n_tiles, covered, item_words (bigint), coverage (double): one
    row per pair whose tiles of at least `min_match` words cover `threshold` of the item's words or
    more. Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased, so case and
    punctuation don't hide a passage.

    Pairs that share a seed (a window of `min_match` words) are tiled, each pair a row of its own,
    so an item found in a third of all documents needs no group. Null texts are empty, rows without
    id are left out; items of fewer than `min_match` words match nothing; rows sharing an id count
    as one document with several texts, each tiled alone. Other columns are ignored.
    """
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(
        "doc_id is not null"
    )
    items = stored(_items(benchmark, min_match))
    of_seed = items.select("item", F.explode("seeds").alias("seed"))
    sizes = of_seed.select("seed").distinct()
    if sizes.count() <= sent_seeds:
        known = np.sort(np.array([r.seed for r in sizes.collect()], np.int64).view(np.uint64))
        runs = _runs(texts, min_match, known)
    else:
        held = _all_seeds(texts, min_match).join(sizes, "seed", "left_semi")
        held = held.groupBy("doc_id").agg(F.collect_set("seed").alias("seeds"))
        runs = _runs(texts.join(held, "doc_id"), min_match, None)
    runs = stored(runs.withColumn("at", F.monotonically_increasing_id()))
    pairs = (
        runs.select("at", F.explode("seeds").alias("seed"))
        .join(of_seed, "seed")
        .select("at", "item")
        .distinct()
    )
    joined = (
        pairs.join(runs.select("at", "doc_id", "doc_words"), "at")
        .join(items.select("item", "item_words"), "item")
        .select("doc_id", "item", "doc_words", "item_words")
    )

    def tile(rows):
        for batch in rows:
            out = []
            for doc_id, item, d, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = np.frombuffer(w, np.uint64)
                found = tiles(np.frombuffer(d, np.uint64), words, min_match)
                covered = sum(size for _, _, size in found)
                if covered >= threshold * len(words):
                    out.append((doc_id, item, len(found), covered, len(words)))
            if out:
                names = ["doc_id", "item_id", "n_tiles", "covered", "item_words"]
                yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], names)

    schema = "doc_id bigint, item_id string, n_tiles bigint, covered bigint, item_words bigint"
    return joined.mapInArrow(tile, schema).withColumn(
        "coverage", F.col("covered") / F.col("item_words")
    )


def decontaminated(documents: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The documents, whole rows, without those that `contaminations` finds. Rows without id stay."""
    found = contaminations(documents, benchmark, **parameters)
    name = fresh(documents, "found")
    found = found.select(F.col("doc_id").alias(name)).distinct()
    return documents.join(found, documents["doc_id"].cast("bigint") == found[name], "left_anti")
