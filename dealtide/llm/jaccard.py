"""Similarity join of documents on sets of word windows: size-banded tiles, bitmap bounds, exact
intersection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dealtide.llm import text as T
from dealtide.llm.cluster import batches, fresh, phased, sent, stored, tasks
from dealtide.llm.components import components

#: A shingle counts as frequent where a slice of texts holds it in so many different sets, and all
#: slices together in so many. At most so many frequent shingles (16 bytes each) go to the tasks.
#: They only order the prefixes: the links are the same for any choice.
LOCAL_FREQUENT, FREQUENT, MOST_FREQUENT = 2, 8, 500_000
#: Members of a tile above which it is cut into blocks.
TILE = 2048
#: Pairs whose documents are sent to the tasks without being counted first; pairs of a task.
FEW_PAIRS, PAIRS = 1 << 17, 1 << 12


def _band(n: np.ndarray, percent: int) -> np.ndarray:
    """Sizes in one band or two neighbouring ones are all that can be similar enough."""
    return np.floor(np.log(n) / np.log(100 / percent) + 1e-9).astype(np.int64)


def _width(band: np.ndarray, percent: int) -> np.ndarray:
    """64-bit words of a bitmap: four bits or more for each shingle of the band, a power of two, 1024
    at most.
    """
    n = 4 * (100 / percent) ** (band + 1)
    return np.clip(2 ** np.ceil(np.log2(np.maximum(n / 64, 1))), 1, 1024).astype(np.int64)


def _bitmap(keys: np.ndarray, width: int) -> bytes:
    bits = np.zeros(width * 64, np.uint8)
    bits[(keys & np.uint64(width * 64 - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _profiles(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """A row per document: n, a hash of its set, its size band and bitmap; and rows with key and n:
    frequent shingles of a slice.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, key = T.shingles(T.words(batch.column("text")), size)
        n = np.bincount(row, minlength=len(batch))
        cut = np.concatenate([[0], np.cumsum(n)])
        sets = [key[i:j] for i, j in zip(cut, cut[1:], strict=False)]
        whole = [T.hash_of(s) for s in sets]
        band = _band(np.maximum(n, 1), percent)
        bits = [_bitmap(s, w) for s, w in zip(sets, _width(band, percent).tolist(), strict=True)]
        once = np.zeros(len(batch), bool)
        once[np.unique(np.array(whole, np.uint64), return_index=True)[1]] = True
        keys, counts = np.unique(key[once[row]], return_counts=True)
        keys, counts = keys[counts >= LOCAL_FREQUENT], counts[counts >= LOCAL_FREQUENT]
        none = pa.nulls(len(keys), pa.int64())
        return pa.record_batch(
            [
                pa.concat_arrays([batch.column("doc_id"), none]),
                pa.array(np.concatenate([n, counts])),
                T.signed(np.concatenate([np.array(whole, np.uint64), keys])),
                pa.concat_arrays([pa.array(band), none]),
                pa.concat_arrays([pa.array(bits, pa.binary()), pa.nulls(len(keys), pa.binary())]),
            ],
            ["doc_id", "n", "key", "band", "bits"],
        )

    schema = "doc_id bigint, n bigint, key bigint, band bigint, bits binary"
    return texts.mapInArrow(batches(run), schema)


def _prefixes(
    texts: DataFrame, size: int, percent: int, frequent: np.ndarray, counts: np.ndarray
) -> DataFrame:
    """(key, set_hash): the shingles of each set's prefix, the rare ones first, each set once per
    slice.

    Two sets with enough in common share a shingle of both prefixes, if all are ordered alike.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, key = T.shingles(T.words(batch.column("text")), size)
        n = np.bincount(row, minlength=len(batch))
        cut = np.concatenate([[0], np.cumsum(n)])
        whole = np.array(
            [T.hash_of(key[i:j]) for i, j in zip(cut, cut[1:], strict=False)], np.uint64
        )
        _, once = np.unique(whole, return_index=True)
        place = np.minimum(np.searchsorted(frequent, key), max(len(frequent) - 1, 0))
        rank = np.zeros(len(key), np.int64)
        if len(frequent):
            rank = np.where(frequent[place] == key, counts[place], 0)
        order = np.lexsort((key, rank, row))
        within = np.arange(len(key)) - cut[:-1][row]
        keep = np.zeros(len(batch), bool)
        keep[once] = True
        taken = (within < (n - (percent * n + 99) // 100 + 1)[row]) & keep[row]
        return pa.record_batch(
            [T.signed(key[order][taken]), T.signed(whole[row[taken]])], ["key", "set_hash"]
        )

    return texts.mapInArrow(batches(run), "key bigint, set_hash bigint")


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """(id, keys): the sorted hashes of the set."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, key = T.shingles(T.words(batch.column("text")), size)
        cut = np.searchsorted(row, np.arange(len(batch) + 1))
        keys = [key[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)]
        return pa.record_batch([batch.column("doc_id"), pa.array(keys, pa.binary())], ["id", "keys"])

    return texts.mapInArrow(batches(run), "id bigint, keys binary")


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows x words) of a larger width as they would be at this one."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def _may_link(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether bitmaps and sizes allow a similarity of `percent`.

    Differing bits are at most the elements that only one set has, so the intersection is at most
    (n + m - differing) / 2.
    """
    both = (n + m - np.bitwise_count(x ^ y).sum(axis=1).astype(np.int64)) // 2
    return 100 * both >= percent * (n + m - both)


def _matrix(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    """Binary values of equal length of some rows, as 64-bit words."""
    data = b"".join(column.take(pa.array(rows)).to_pylist())
    return np.frombuffer(data, np.uint64).reshape(len(rows), -1)


def _bounded(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, n_a, b, n_b) that their bitmaps and sizes allow, as (a, b)."""
    of = lambda side: bitmaps.select(
        F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")
    )
    joined = (
        pairs.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        .join(of("a"), ["a", "n_a"])
        .join(of("b"), ["b", "n_b"])
    )

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            a, b = batch.column("bits_a"), batch.column("bits_b")
            n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            wide = pc.binary_length(a).to_numpy(), pc.binary_length(b).to_numpy()
            ok = np.zeros(len(batch), bool)
            for p, q in {*zip(*(w.tolist() for w in wide), strict=True)}:
                at = np.flatnonzero((wide[0] == p) & (wide[1] == q))
                width = min(p, q) // 8
                x, y = _folded(_matrix(a, at), width), _folded(_matrix(b, at), width)
                ok[at] = _may_link(x, y, n[at], m[at], percent)
            if ok.any():
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return joined.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(
        run, "a bigint, b bigint"
    )


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sorted sets intersect enough. Sets are built for the documents of pairs
    only.
    """
    pairs = stored(pairs)
    many = pairs.count()
    if not many:
        return pairs
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    wanted = F.broadcast(wanted) if many <= FEW_PAIRS else sent(stored(wanted))
    sets = stored(_sets(texts.join(wanted, "doc_id", "left_semi"), size))
    of = lambda side: sets.select(F.col("id").alias(side), F.col("keys").alias(f"keys_{side}"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ok = []
            for x, y in zip(batch.column("keys_a"), batch.column("keys_b"), strict=True):
                p = np.frombuffer(x.as_buffer(), np.uint64)
                q = np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            if any(ok):
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    dealt = tasks(many, PAIRS)
    both = pairs.join(of("a"), "a").coalesce(dealt).join(of("b"), "b").coalesce(dealt)
    return both.mapInArrow(run, "a bigint, b bigint")


def _tiles(members: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different components in a tile that bitmaps allow.

    members: key, id, component, n, band. A tile is a key with a band and the next larger one, and
    in large ones a block of either side. Its rows arrive sorted by size; each is compared with
    those after it until they are too large. Bitmaps travel to tiles that hold a pair only.
    """
    both = members.selectExpr(
        "*",
        "inline(array(struct(band as tile, true as low), struct(band - 1 as tile, false as low)))",
    ).drop("band")
    useful = (
        both.groupBy("key", "tile")
        .agg(
            F.count_if("low").alias("lows"),
            F.count("*").alias("rows"),
            F.min("component").alias("least"),
            F.max("component").alias("most"),
        )
        .where("lows > 0 and least < most")
        .select("key", "tile", F.ceil(F.col("rows") / TILE).alias("blocks"))
    )
    cells = (
        both.join(useful, ["key", "tile"])
        .selectExpr("*", "pmod(xxhash64(id), blocks) as own")
        .selectExpr("*", "explode(sequence(0, cast(blocks as int) - 1)) as other")
        # The cell (i, j), i <= j, holds the rows of blocks i and j of both bands.
        .selectExpr(
            "key", "tile", "least(own, other) as i", "greatest(own, other) as j",
            "id", "component", "n", "low", "own",
        )
        .join(bitmaps.select("id", "n", "bits"), ["id", "n"])
    )
    dealt = cells.repartition("key", "tile", "i", "j").sortWithinPartitions(
        "key", "tile", "i", "j", "n", "id"
    )

    def compare(batch: pa.Table) -> Iterator[pa.RecordBatch]:
        column = {
            c: batch.column(c).to_numpy()
            for c in ("key", "tile", "i", "j", "id", "component", "n", "low", "own")
        }
        where = np.zeros(len(batch), np.int64)
        for c in ("key", "tile", "i", "j"):
            where[1:] += column[c][1:] != column[c][:-1]
        cell = np.cumsum(where > 0)
        width = _width(np.maximum(column["tile"], 0), percent)
        bits = batch.column("bits").combine_chunks()
        size = pc.binary_length(bits).to_numpy() // 8
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            maps = np.empty((len(rows), w), np.uint64)
            for s in np.unique(size[rows]):
                at = np.flatnonzero(size[rows] == s)
                maps[at] = _folded(_matrix(bits, rows[at]), w)
            own = {k: v[rows] for k, v in column.items()}
            own_cell = cell[rows]
            live = np.arange(len(rows))
            step = 0
            while True:
                step += 1
                live = live[live + step < len(rows)]
                x, y = live, live + step
                on = (own_cell[x] == own_cell[y]) & (
                    100 * own["n"][x] >= percent * own["n"][y]
                )
                live, x, y = live[on], x[on], y[on]
                if not len(live):
                    break
                # A pair of two lower rows belongs to the cell of their blocks; of two upper rows to
                # the next tile.
                ok = (own["component"][x] != own["component"][y]) & (own["low"][x] | own["low"][y])
                ok &= (own["i"][x] == own["j"][x]) | (own["own"][x] != own["own"][y])
                x, y = x[ok], y[ok]
                ok = _may_link(maps[x], maps[y], own["n"][x], own["n"][y], percent)
                if ok.any():
                    a, b = own["id"][x[ok]], own["id"][y[ok]]
                    yield pa.record_batch(
                        [pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"]
                    )

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in rows:
            if not len(batch):
                continue
            kept.append(batch)
            if sum(map(len, kept)) < 1 << 16:
                continue
            table = pa.Table.from_batches(kept).combine_chunks()
            last = [table.column(c)[len(table) - 1].as_py() for c in ("key", "tile", "i", "j")]
            same = np.ones(len(table), bool)
            for c, v in zip(("key", "tile", "i", "j"), last, strict=True):
                same &= table.column(c).to_numpy() == v
            begin = int(np.argmax(same))
            if begin:
                yield from compare(table.slice(0, begin).combine_chunks())
            kept = table.slice(begin).combine_chunks().to_batches()
        if kept:
            yield from compare(pa.Table.from_batches(kept).combine_chunks())

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


@phased
def similar_documents(documents: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents joined where 100 * |intersection| >= percent *
    |union|.

    A document's set: its distinct windows of `size` words (A-Z lower-cased, parted by ASCII white
    space); with fewer words, the whole sequence; without words or with a null text, the empty set,
    which links with nothing. component_id is the least doc_id reachable by links. Sets are held as
    64-bit hashes.

    1. Equal sets form a class, represented by its least doc_id; only classes are compared.
    2. A class is dealt to tiles by the shingles of its prefix, rare ones first, and by its size
       band. Shingles with the same least holder are one tile.
    3. Each class is compared with the first of its tiles. Then all pairs of a tile that aren't
       connected yet are compared. Bitmaps bound the intersection from above; what passes is
       intersected exactly.

    So groups of near copies cost a comparison per member, not per pair, and no link between
    components is lost. Rows without doc_id are left out; rows sharing one get a row each, and link
    with what either links with. Other columns are ignored.
    """
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(
        "doc_id is not null"
    )
    profiles = stored(_profiles(texts, size, percent))
    docs = profiles.where("doc_id is not null")
    frequent = (
        profiles.where("doc_id is null")
        .groupBy("key")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= FREQUENT)
        .orderBy(F.desc("n"), "key")
        .limit(MOST_FREQUENT)
        .toPandas()
    )
    keys = frequent["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    prefixes = _prefixes(
        texts, size, percent, keys[order], frequent["n"].to_numpy(np.int64)[order]
    )
    classes = stored(
        docs.where("n > 0").groupBy("n", "key", "band").agg(F.min("doc_id").alias("id"))
    )
    by_key = Window.partitionBy("key")
    shared = (
        prefixes.repartition("key")
        .dropDuplicates(["key", "set_hash"])
        .select(
            "key",
            "set_hash",
            F.min("set_hash").over(by_key).alias("low"),
            F.max("set_hash").over(by_key).alias("high"),
        )
        .where("low < high")
    )
    # Keys with the same least member are one tile.
    members = stored(
        shared.select("key", "set_hash")
        .join(classes.select(F.col("key").alias("set_hash"), "id", "n", "band"), "set_hash")
        .select(F.min(F.struct("id", "n")).over(by_key).alias("least"), "id", "n", "band")
        .select(F.col("least.id").alias("first"), F.col("least.n").alias("first_n"), "id", "n", "band")
        .distinct()
    )
    bitmaps = stored(
        docs.select("doc_id", "n", "bits")
        .join(members.select(F.col("id").alias("doc_id"), "n").distinct(), ["doc_id", "n"], "left_semi")
        .withColumnRenamed("doc_id", "id")
    )

    pairs = members.where("id <> first").select(
        F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("first").alias("b"), F.col("first_n").alias("n_b")
    )
    first = stored(_verified(_bounded(pairs, bitmaps, percent), texts, size, percent))
    component = stored(components(first))

    open_ = members.join(component, F.col("id") == F.col("node"), "left").select(
        F.col("first").alias("key"), "id", "n", "band", F.coalesce("component", "id").alias("component")
    )
    second = stored(_verified(_tiles(open_, bitmaps, percent), texts, size, percent))
    if not second.isEmpty():
        component = components(component.toDF("a", "b").union(second))
    return (
        docs.withColumnRenamed("n", "n_shingles")
        .join(classes.select("key", F.col("n").alias("n_shingles"), "id"), ["key", "n_shingles"], "left")
        .join(component, F.col("id") == F.col("node"), "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component", "id", "doc_id").alias("component_id"),
        )
    )


@phased
def without_similar(documents: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """The documents, whole rows, of which no smaller doc_id is reachable by links. Rows without id
    stay.
    """
    found = similar_documents(documents, size, percent).where("component_id <> doc_id")
    name = fresh(documents, "gone")
    gone = found.select(F.col("doc_id").alias(name)).distinct()
    return documents.join(gone, documents["doc_id"].cast("bigint") == gone[name], "left_anti")
