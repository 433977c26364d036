"""Exact Jaccard join of documents on their word n-grams, and its components.

The join is a product of the sparse document by n-gram matrix with its
transpose, worked in blocks and cut down by bounds that follow from set sizes:

1. Documents with one set are one row of the matrix (a class). Each task packs
   the entries of its classes by blocks of columns (ranges of n-gram hashes).
2. A block drops the columns that only one class has. What remains of a class
   meets again; a class keeps its row only if the remaining entries reach
   ``threshold`` of its size, since no partner can overlap it in more.
3. A row's columns are ordered by rarity (documents, up to a limit, then hash).
   Two sets that reach the threshold share a column among the first
   ``size - ceil(threshold * size) + 1``, so only these propose pairs.
4. The overlap of proposed pairs is accumulated over all remaining columns and
   pairs below ``threshold / (1 + threshold) * (sum of sizes)`` are discarded.

Components need no pair twice: every row is first compared with one pivot, the
row of its columns whose own columns are the most common, which costs a row for
each member. Rows in one component after that are not compared again. Small
columns then propose their pairs across components. Rows that meet in large
columns form groups, in which the rows outside the largest component are
multiplied with all others of a size that fits, a block of rows by a block of
rows at a time; rows that share too little with others are multiplied only with
those that share enough. At most an edge for each row leaves a product. No link
between different components is lost. link_counts() multiplies all rows of a
group and gives the exact number of links.

Rows of a key that is common meet in no task: its partner is broadcast, and
there are fewer than HOT such keys. Intermediate tables are dropped at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import blobs, graphs
from factloom.llm import textkit as tk

U64 = np.uint64
#: Classes from which on a column counts as common: its exact count no longer orders it.
COMMON = 65
#: Members up to which a column proposes its pairs across components itself.
SMALL = 32
#: Rows of a block of a large group's product, their entries, and columns multiplied at once.
BLOCK_ROWS, BLOCK_ENTRIES, BLOCK_COLUMNS = 256, 1 << 17, 4096
#: Blocks that meet all their partners in one task.
STRIPE = 8
#: Entries (an n-gram of a set) of a bucket, about.
BUCKET_ENTRIES = 1 << 19
#: Keys that hold more than this part of all rows are joined by broadcast; there are fewer than HOT.
HOT = 1000


def _sets(w: tk.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(size of each document's set, the sets' hashes one after the other, each ascending)."""
    at, h = w.runs(size)
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    whole = w.run_hash(w.first[short], w.counts[short])
    edges = np.searchsorted(at, w.first)
    sets = [np.unique(h[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)]
    for d, x in zip(short, whole, strict=True):
        sets[d] = np.array([x], U64)
    n = np.array([len(x) for x in sets], np.int64)
    return n, np.concatenate(sets) if sets else np.zeros(0, U64)


def _keys(n: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A 63-bit key of each non-empty set, equal for equal sets."""
    some = n > 0
    out = np.zeros(len(n), np.int64)
    if some.any():
        first = (np.cumsum(n) - n)[some]
        sums = np.add.reduceat(tk.mix(hashes ^ U64(0x5851F42D4C957F2D)), first)
        out[some] = (tk.mix(sums + n[some].astype(U64)) >> U64(1)).astype(np.int64)
    return out


def shingle_sets(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, set_key (null for an empty set; equal for equal sets)."""

    @tk.tidy
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in tk.pieces(batches, "text"):
            n, hashes = _sets(tk.Words(buf, offsets, tk.SPACE, lower=True), size)
            yield tk.batch(rows, ("doc_id",), n_shingles=pa.array(n), set_key=pa.array(_keys(n, hashes), mask=n == 0))

    return tk.narrow(docs, id_col, text_col).mapInArrow(sets, "doc_id long, n_shingles long, set_key long")


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    """The overlap that a set of n must have with a partner."""
    return -(-n * percent // 100)


def shared_rows(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", entries_of_docs: int = 0) -> DataFrame:
    """The rows of the matrix that can have a partner: key, n, prefix, typical
    (how common the row's columns are on average) and columns (hashes that
    other classes have too, rarest first).

    entries_of_docs is the sum of the sizes of all sets; the number of buckets
    and partitions follows it, so a task decodes about BUCKET_ENTRIES at once.
    """
    buckets = max(2 * tk.partitions(docs.sparkSession), -(-entries_of_docs // BUCKET_ENTRIES))
    parts = max(tk.partitions(docs.sparkSession), -(-buckets // 8))

    @tk.tidy
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(hashes: list[np.ndarray], keys: list[int], sizes: list[int]) -> Iterator[tuple[int, int, bytes]]:
            n = np.array(sizes, np.int64)
            key = np.array(keys, np.int64)
            of = np.repeat(np.arange(len(n), dtype=np.uint32), n)
            h = np.concatenate(hashes)
            by = np.argsort(h)
            h, of = h[by], of[by]
            new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            times = np.diff(np.append(new, len(h)))
            weight = np.repeat(times, times)
            first = np.zeros(len(h), bool)
            first[new] = True
            common = weight >= COMMON
            for kind, some in ((0, ~common | first), (1, common & ~first)):
                to, x, o, t = blobs.bucket_of(h[some], buckets), h[some], of[some], np.where(common[some], COMMON, 1).astype(np.uint8)
                for i, j in tk.spans(to):
                    used, own = np.unique(o[i:j], return_inverse=True)
                    yield int(to[i]), kind, tk.pack(tk.gaps(x[i:j]), own.astype(np.uint32), t[i:j], key[used].view(U64), n[used].astype(np.uint32))

        def sent() -> Iterator[tuple[int, int, bytes]]:
            held, keys, sizes, seen, total = [], [], [], set(), 0
            for _, buf, offsets in tk.pieces(batches, "text"):
                n, hashes = _sets(tk.Words(buf, offsets, tk.SPACE, lower=True), size)
                key = _keys(n, hashes)
                ends = np.cumsum(n)
                for d, (k, m) in enumerate(zip(key.tolist(), n.tolist(), strict=True)):
                    if m and k not in seen:
                        seen.add(k)
                        keys.append(k)
                        sizes.append(m)
                        held.append(hashes[ends[d] - m : ends[d]])
                        total += m
                if total > blobs.FLUSH:
                    yield from flush(held, keys, sizes)
                    held, keys, sizes, seen, total = [], [], [], set(), 0
            if total:
                yield from flush(held, keys, sizes)

        return blobs.batches_of(sent())

    @tk.tidy
    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> Iterator[tuple[int, int, bytes]]:
            for held in blobs.by_bucket(batches):
                found = [(kind, *tk.unpack(blob)) for _, kind, blob in held]
                h = np.concatenate([tk.ungaps(x[1]) for x in found])
                key = np.concatenate([x[4][x[2]] for x in found])
                n = np.concatenate([x[5][x[2]] for x in found])
                weight = np.concatenate([x[3] for x in found]).astype(np.int64)
                by = np.lexsort((key, h))
                h, key, n, weight = h[by], key[by], n[by], weight[by]
                one = np.concatenate(([True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])))
                weight = np.maximum.reduceat(weight, np.flatnonzero(one))
                h, key, n = h[one], key[one], n[one]
                new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                times = np.minimum(np.add.reduceat(weight, new), COMMON)
                times = np.repeat(times, np.diff(np.append(new, len(h))))
                some = times > 1
                h, key, n, times = h[some], key[some], n[some], times[some].astype(np.uint8)
                to = blobs.group_of(key.view(np.int64), buckets)
                by = np.lexsort((key, to))
                if len(by):
                    yield from blobs.sent(to[by], 0, key[by], n[by], h[by], times[by])

        return blobs.batches_of(sent())

    @tk.tidy
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in blobs.by_bucket(batches):
            found = [tk.unpack(blob) for _, _, blob in held]
            key = np.concatenate([tk.ungaps(x[0]) for x in found])
            n, h, times = (np.concatenate([x[i] for x in found]) for i in (1, 2, 3))
            by = np.lexsort((h, times, key))
            key, n, h, times = key[by], n[by].astype(np.int64), h[by], times[by]
            one = np.concatenate(([True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])))
            key, n, h, times = key[one], n[one], h[one], times[one]
            new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            have = np.diff(np.append(new, len(key)))
            prefix = have - _need(n[new], percent) + 1
            stays = prefix > 0
            typical = np.add.reduceat(times.astype(np.float64), new) / n[new] if len(new) else np.zeros(0)
            if stays.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[new][stays].view(np.int64)), pa.array(n[new][stays]), pa.array(prefix[stays]), pa.array(typical[stays]), tk.lists(have[stays], pa.array(tk.signed(h[np.repeat(stays, have)])))],
                    names=["key", "n", "prefix", "typical", "columns"],
                )

    rows = tk.narrow(docs, id_col, text_col).select("text").mapInArrow(entries, blobs.SCHEMA)
    rows = blobs.dealt(rows, parts).mapInArrow(shared, blobs.SCHEMA)
    return blobs.dealt(rows, parts).mapInArrow(joined, "key long, n long, prefix long, typical double, columns array<long>")


def _linked(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) that reach the threshold: a, b, overlap."""
    left = rows.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("columns").alias("x"))
    right = rows.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("columns").alias("y"))

    @tk.tidy
    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ys = b.column("x"), b.column("y")
            sizes = b.column("na").to_numpy() + b.column("nb").to_numpy()
            overlap = np.array([len(np.intersect1d(xs[i].values.to_numpy(), ys[i].values.to_numpy(), assume_unique=True)) for i in range(b.num_rows)], np.int64)
            some = pa.array((100 + percent) * overlap >= percent * sizes)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(overlap)], names=["a", "b", "overlap"]).filter(some)

    tk.small_batches(rows.sparkSession)
    near = _close(percent, "size(x)", "size(y)")
    return pairs.join(left, "a").join(right, "b").where(near).mapInArrow(product, "a long, b long, overlap long")


def _close(percent: int, x: str, y: str) -> str:
    """Whether sets of sizes na and nb, of which other classes share x and y entries, can reach the threshold."""
    return f"least(na, nb) * 100 >= greatest(na, nb) * {percent} AND least({x}, {y}) * {100 + percent} >= (na + nb) * {percent}"


def _beside(rows: DataFrame, table: DataFrame, *by: str) -> DataFrame:
    """rows joined to table, whose column m says how many rows a key has. Keys
    with more than a HOT-th of all rows are fewer than HOT; these go to every
    task, so that no key's rows meet in one."""
    often = F.col("m") > rows.count() / HOT
    hot = table.where(often)
    on = list(by)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(*by)), on, "left_anti").join(table.where(~often), on))


def _blocks_linked(groups: DataFrame, percent: int, kept: graphs.Tables, counts: bool = False) -> DataFrame:
    """Products of blocks of rows within groups(g, key, n, root, copies, columns).

    Gives edges (a, b, overlap) that connect what links across components
    connect, overlap being null; or, for counts, (key, n_links): copies of the
    rows that each row is linked with, in parts to be summed.

    Two rows can only link if their sizes fall into the same or neighbouring
    bins, and if one of them is strong: it shares enough entries for a partner
    of its own size. Two weak rows would each have to be the larger one.
    """
    width = math.log(100 / percent) + 1e-6
    rows = groups.withColumn("bin", F.floor(F.log("n") / width)).withColumn("strong", F.size("columns") * (100 + percent) >= F.col("n") * 2 * percent)
    rows = kept.written(rows)
    rest = rows
    if not counts:
        roots = rows.groupBy("g", "root").agg(F.count("*").alias("own"))
        most = kept.written(roots.groupBy("g").agg(F.max(F.struct("own", "root")).alias("most"), F.sum("own").alias("m")).select("g", "m", F.col("most.root").alias("largest")))
        rest = kept.written(_beside(rows, most, "g").where("root <> largest").drop("m", "largest"))

    def blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        size = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(F.size("columns")) / BLOCK_ENTRIES))
        cells = kept.written(rows.groupBy("g", "bin", "strong").agg(F.count("*").alias("m"), size.alias("blocks")))
        block = F.pmod(F.xxhash64("key"), F.col("blocks")).alias("block")
        cut = _beside(rows, cells, "g", "bin", "strong").groupBy("g", "bin", "strong", block)
        return cells, kept.written(cut.agg(F.collect_list(F.struct("key", "n", "root", "copies", "columns")).alias("rows")))

    x_cells, x = blocks(rest)
    y_cells, y = (x_cells, x) if counts else blocks(rows)
    met = x_cells.select("g", F.col("bin").alias("x_bin"), F.col("strong").alias("x_strong"), F.ceil(F.col("blocks") / STRIPE).alias("stripes"), F.explode(F.array(*[F.col("bin") + d for d in (-1, 0, 1)])).alias("bin"))
    met = met.join(y_cells.select("g", "bin", "strong", F.col("blocks").alias("m")), ["g", "bin"]).where("x_strong OR strong")
    ys = _beside(y, kept.written(met), "g", "bin", "strong").select("g", "x_bin", "x_strong", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)).alias("stripe"), F.col("rows").alias("y"))
    stripes = _beside(x, x_cells.select("g", "bin", "strong", F.col("blocks").alias("m")), "g", "bin", "strong").withColumn("stripe", F.pmod("block", F.ceil(F.col("m") / STRIPE)))
    xs = stripes.select("g", F.col("bin").alias("x_bin"), F.col("strong").alias("x_strong"), "stripe", F.col("rows").alias("x"))
    pairs = xs.join(ys, ["g", "x_bin", "x_strong", "stripe"]).select("x", "y")

    @tk.tidy
    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield (_counted if counts else _connected)(b.column("x")[i].values, b.column("y")[i].values, percent)

    return pairs.mapInArrow(product, "key long, n_links long" if counts else "a long, b long, overlap long")


def _links(x: pa.Array, y: pa.Array, percent: int) -> np.ndarray:
    """Which rows of x and y reach the threshold: the product of both blocks, some columns at a time."""
    sides = []
    for side in (x, y):
        lists = side.field("columns")
        row = np.repeat(np.arange(len(side)), np.diff(lists.offsets.to_numpy()))
        sides.append((row, lists.flatten().to_numpy()))
    columns = np.intersect1d(sides[0][1], sides[1][1])
    overlap = np.zeros((len(x), len(y)), np.float32)
    placed = []
    for row, column in sides:
        at = np.minimum(np.searchsorted(columns, column), max(0, len(columns) - 1))
        both = columns[at] == column if len(columns) else np.zeros(len(column), bool)
        by = np.argsort(at[both], kind="stable")
        placed.append((row[both][by], at[both][by]))
    for c in range(0, len(columns), BLOCK_COLUMNS):
        dense = []
        for (row, at), side in zip(placed, (x, y), strict=True):
            i, j = np.searchsorted(at, [c, c + BLOCK_COLUMNS])
            part = np.zeros((len(side), BLOCK_COLUMNS), np.float32)
            part[row[i:j], at[i:j] - c] = 1
            dense.append(part)
        overlap += dense[0] @ dense[1].T
    xn, yn = x.field("n").to_numpy(), y.field("n").to_numpy()
    return (100 + percent) * overlap.astype(np.int64) >= percent * (xn[:, None] + yn[None, :])


def _connected(x: pa.Array, y: pa.Array, percent: int) -> pa.RecordBatch:
    """At most an edge for each row: from it to the first row of x that links of both blocks connect it with."""
    link = _links(x, y, percent)
    (xk, xr), (yk, yr) = ([side.field(f).to_numpy() for f in ("key", "root")] for side in (x, y))
    link &= xr[:, None] != yr[None, :]
    low, none = np.arange(len(xk)), len(xk)
    while True:
        of_y = np.where(link, low[:, None], none).min(0, initial=none)
        of_x = np.minimum(low, np.where(link, of_y[None, :], none).min(1, initial=none))
        if (of_x == low).all():
            break
        low = of_x
    some_x, some_y = np.flatnonzero(low != np.arange(len(xk))), np.flatnonzero(of_y < none)
    a, b = np.concatenate((xk[some_x], yk[some_y])), xk[np.concatenate((low[some_x], of_y[some_y]))]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "overlap"])


def _counted(x: pa.Array, y: pa.Array, percent: int) -> pa.RecordBatch:
    """The copies of the rows of y that each row of x is linked with."""
    xk, yk = x.field("key").to_numpy(), y.field("key").to_numpy()
    link = _links(x, y, percent) & (xk[:, None] != yk[None, :])
    return pa.RecordBatch.from_arrays([pa.array(xk), pa.array(link @ y.field("copies").to_numpy())], names=["key", "n_links"])


def _members(rows: DataFrame) -> DataFrame:
    """The columns that propose a row's pairs: col, key, n, have (entries that others share), typical."""
    return rows.select(F.explode(F.slice("columns", F.lit(1), F.col("prefix").cast("int"))).alias("col"), "key", "n", F.size("columns").alias("have"), "typical")


def _small_pairs(small: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members(col, key, n, have, root) across roots that small columns propose."""
    left, right = (small.select("col", F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("have").alias(f"h{k}"), F.col("root").alias(f"r{k}")) for k in "ab")
    return left.join(right, "col").where(f"a < b AND ra <> rb AND {_close(percent, 'ha', 'hb')}").select("a", "b").distinct()


def _groups(large: DataFrame, kept: graphs.Tables) -> DataFrame:
    """key, g: rows that large columns connect, directly or through others, have one g."""
    met = graphs.components(large.select(F.col("key").alias("a"), (F.lit(-1) - F.shiftrightunsigned("col", 1)).alias("b")), kept)
    return met.where("node >= 0").select(F.col("node").alias("key"), F.col("root").alias("g"))


def class_components(rows: DataFrame, percent: int = 75, kept: graphs.Tables | None = None) -> DataFrame:
    """Components (node, root) of shared_rows(): every link between different sets is followed."""
    kept = kept or graphs.Tables(rows.sparkSession)
    rows = kept.written(rows)
    members = kept.written(_members(rows))
    best = kept.written(members.groupBy("col").agg(F.max(F.struct("typical", "key")).alias("pivot"), F.count("*").alias("m")).where("m > 1"))
    pairs = _beside(members.select("col", "key"), best, "col").groupBy("key").agg(F.max("pivot").alias("p")).select(F.col("key").alias("a"), F.col("p.key").alias("b")).where("a <> b")
    links = kept.written(_linked(kept.written(pairs), rows, percent))
    roots = kept.written(graphs.components(links, kept))
    named = kept.written(members.select("col", "key", "n", "have").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")))
    open_ = kept.written(named.groupBy("col").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("col", "m"))
    if open_.isEmpty():
        return roots
    named = kept.written(_beside(named, open_, "col"))
    found = [links, kept.written(_linked(kept.written(_small_pairs(named.where(F.col("m") <= SMALL), percent)), rows, percent))]
    large = kept.written(named.where(F.col("m") > SMALL).select("col", "key", "root"))
    if not large.isEmpty():
        groups = large.select("key", "root").distinct().join(_groups(large, kept), "key").join(rows.select("key", "n", "columns", F.lit(1).alias("copies")), "key")
        found.append(kept.written(_blocks_linked(groups, percent, kept)))
    return kept.written(graphs.components(reduce(DataFrame.union, found), kept))


def _classes(sets: DataFrame) -> DataFrame:
    return sets.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def link_counts(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_links, the exact number of other rows that it
    is linked with, copies of its set among them.

    Counting needs every pair of a group of near copies, so the work (not the
    rows that leave a block) grows with the square of such a group;
    near_duplicates() doesn't need that. Nulls and empty texts have no links.
    """
    kept = graphs.Tables(docs.sparkSession)
    sets = kept.written(shingle_sets(docs, size, id_col, text_col))
    rows = kept.written(shared_rows(docs, size, percent, id_col, text_col, _entries(sets)))
    classes = kept.written(_classes(sets))
    rows = kept.written(rows.join(classes.select(F.col("set_key").alias("key"), "copies"), "key"))
    members = kept.written(_members(rows).withColumn("root", F.col("key")))
    times = kept.written(members.groupBy("col").agg(F.count("*").alias("m")).where("m > 1"))
    named = kept.written(_beside(members, times, "col"))
    large = kept.written(named.where(F.col("m") > SMALL).select("col", "key"))
    grouped = kept.written(_groups(large, kept))
    pairs = _small_pairs(named.where(F.col("m") <= SMALL), percent)
    for k in "ab":
        pairs = pairs.join(grouped.select(F.col("key").alias(k), F.col("g").alias(f"g{k}")), k, "left")
    links = kept.written(_linked(kept.written(pairs.where("ga IS NULL OR gb IS NULL OR ga <> gb").select("a", "b")), rows, percent))
    groups = grouped.join(rows.select("key", "n", "copies", "columns", F.col("key").alias("root")), "key")
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.join(classes.select(F.col("set_key").alias("b"), "copies"), "b").select(F.col("a").alias("key"), F.col("copies").alias("n_links"))
    counts = counts.union(_blocks_linked(groups, percent, kept, counts=True)).groupBy("key").agg(F.sum("n_links").alias("others"))
    each = classes.join(counts.withColumnRenamed("key", "set_key"), "set_key", "left").select("set_key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    each = kept.written(each.withColumn("m", F.col("n_links")))
    return kept.only(sets.join(each.drop("m"), "set_key", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links")))


def _entries(sets: DataFrame) -> int:
    return sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, the smallest doc_id
    reachable by links of at least ``percent`` per cent Jaccard likeness.

    A text of fewer words than a shingle is one shingle; a null text or one
    without words has none and is linked with nothing, so its component is its
    own doc_id. Equal sets always link. Rows with one doc_id are judged each by
    its own text. A text of any length is read whole: a task holds a few MB of
    text or one document, and the set of a document is one row. Other columns,
    whatever their names, play no part. An empty table gives an empty one.
    """
    kept = graphs.Tables(docs.sparkSession)
    sets = kept.written(shingle_sets(docs, size, id_col, text_col))
    roots = class_components(shared_rows(docs, size, percent, id_col, text_col, _entries(sets)), percent, kept)
    classes = kept.written(_classes(sets))
    rooted = classes.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").select("set_key", "doc_id", "copies", F.coalesce("root", "set_key").alias("root"))
    rooted = kept.written(rooted)
    lowest = kept.written(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("m")))
    named = kept.written(_beside(rooted, lowest, "root").select("set_key", "component_id", F.col("copies").alias("m")))
    out = _beside(sets.where("n_shingles > 0"), named, "set_key").select("doc_id", "n_shingles", "component_id")
    return kept.only(out.union(sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))))
