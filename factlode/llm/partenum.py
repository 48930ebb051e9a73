"""Similarity join of word shingle sets by PartEnum signatures.

Two sets of sizes s and t whose Jaccard similarity is p percent or more differ in at most
(s + t) * (100 - p) / (100 + p) elements. Sizes are dealt into bands, each half as large again as
the one before, so that such sets lie in one band or in neighbouring ones; a set shows the signatures
of its own band and, where a partner may be larger, of the next. In a band whose largest size allows
k differences, the domain of hashes is cut into n1 parts, each with at most k2 differences in some
part (n1 * (k2 + 1) > k), and each part into n2 smaller ones. A signature is the projection on
n2 - k2 of a part's n2 smaller parts; all such subsets are enumerated. Two similar sets agree on one
at least: no link is lost.

A projection without elements says nothing, yet many sets would share it. Parts in excess (``slack``)
give each similar pair slack + 1 parts in which they agree; so a set with empty projections in
``slack`` parts or fewer leaves these projections out, and still shows one that the partner shows.

1. One pass turns each text into its set (64-bit hashes of four lower-cased words) and the set's digest
   of 16 bytes, the node: equal sets are one node.
2. Signatures shown by two different nodes are kept. One row of each node is read for them (a Bloom filter
   tells which), and a signature moves as five bytes: the partition it is dealt to says the rest, as the
   number of partitions grows with the shingles. A task holds the different signatures of its partition,
   however often each comes. Of two in one partition, one in 2^40 pairs is taken for the other, which costs
   a comparison and never a link. A Bloom filter of bounded size and a join leave their rows.
3. Nodes of a bucket meet its centres, never all others; each node is paired with the centre that
   shares most of its signatures and verified on the full sets, unless their outlines (four bits for each
   of as many parts of the domain as a set has shingles) differ in more parts than similar sets have
   different elements; components are found by alternating large-star and small-star. A second round does so with centres of other components.
4. Nodes of buckets that still hold several components are compared by their rarest shingles, of which
   a similar pair shares one; pairs of different components are verified. A set with many shingles
   of its own drops out here without being paired.

Defined results: a null or empty text, or one of white space, has an empty set and is linked with
nothing; a text of fewer words than a shingle is one shingle; rows with equal doc_id are members by
their texts, like any others; a null doc_id has no rank: such a row gets the smallest id of its
component, or null. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sieve
from . import textkit as tk
from .common import forget, ids_and_text, save, table
from .neardup import across, components, different_sets, digest, ends_of, joined, once, prefixes, sets_of, shingle_sets, thinned, unsettled, verified

SHINGLE, PERCENT = 4, 85
U64 = np.uint64
#: Choices of a bucket's centre in the first round, and centres of other components a node meets in the second.
PIVOTS, SECOND = 2, 2
#: Bytes of a signature's name in its partition, and shingles whose signatures one partition takes.
NAME, SHARE = 5, 1 << 21


@lru_cache(maxsize=64)
def bands(percent: int) -> np.ndarray:
    """The least size of each band: half as large again as the last one, and never too narrow for a similar pair."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, -(-3 * out[-1] // 2), 100 * out[-1] // percent + 1))
    return np.array(out)


@lru_cache(maxsize=1024)
def scheme(band: int, percent: int) -> tuple | None:
    """Of a band: smaller parts of each part, slack, subsets, bounds of all smaller parts, and a salt of each
    signature; none if only equal sets can be similar there."""
    largest = int(bands(percent)[band + 1]) - 1
    k = 2 * largest * (100 - percent) // (100 + percent)
    if k == 0:
        return None
    k2 = 1 if k == 1 or k > 16 else 2
    n2 = 3 if k == 1 else 2 if k2 == 1 else 5
    n1 = -(-(k + 1) // (k2 + 1))
    slack = 2 + n1 // 8 if k > 16 else 0
    subsets = np.array(list(combinations(range(n2), n2 - k2)))
    parts, shape = (n1 + slack) * n2, (n1 + slack, len(subsets))
    bounds = np.arange(1, parts, dtype=U64) * U64((1 << 64) // parts)
    salt = tk.mix(np.arange(shape[0] * shape[1], dtype=U64) + (U64(band) << U64(40)) + U64(1)).reshape(shape)
    return n2, slack, subsets, bounds, salt


def tags(size: int, percent: int) -> list[int]:
    """The bands in which a set of this size shows signatures."""
    least = bands(percent)
    own = int(np.searchsorted(least, size, side="right")) - 1
    return [own, own + 1] if 100 * size // percent >= least[own + 1] else [own]


def signatures(items: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The signatures of a set of sorted hashes."""
    if not len(items):
        return np.zeros(0, U64)
    sums = np.zeros(len(items) + 1, U64)
    np.cumsum(items, out=sums[1:])
    out = []
    for band in tags(len(items), percent):
        if (how := scheme(band, percent)) is None:
            continue
        n2, slack, subsets, bounds, salt = how
        at = np.zeros(len(bounds) + 2, np.int64)
        at[1:-1] = np.searchsorted(items, bounds)
        at[-1] = len(items)
        total, many = np.diff(sums[at]).reshape(-1, n2), np.diff(at).reshape(-1, n2)
        if subsets.shape[1] > 1:
            total, many = total[:, subsets].sum(axis=2), many[:, subsets].sum(axis=2)
        keys, full = tk.mix(total + salt), many > 0
        out.append(keys[full] if len(full) - full.all(axis=1).sum() <= slack else keys.ravel())
    return np.concatenate(out) if out else np.zeros(0, U64)


def sketch(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, at (a hash of id and text), n_shingles and node of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes = [], []
            for items in shingle_sets(batch.column("text"), shingle):
                sizes.append(len(items))
                nodes.append(digest(items))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("at"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary())], names=["doc_id", "at", "n_shingles", "node"])

    return docs.select("doc_id", "at", "text").mapInArrow(run, "doc_id long, at long, n_shingles long, node binary")


def shown(batches: Iterator[pa.RecordBatch], shingle: int, percent: int, rows: int = 1 << 17) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
    """Signatures, and the nodes, sizes and counts of signatures of the sets that show them, many sets at a time."""
    keys, nodes, sizes, many = [], [], [], 0

    def held() -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        return np.concatenate(keys).view(np.int64), nodes, np.array(sizes, np.int64), np.array([len(k) for k in keys], np.int64)

    for batch in batches:
        for node, items in different_sets(batch.column("text"), shingle):
            keys.append(signatures(items, percent))
            nodes.append(node)
            sizes.append(len(items))
            many += len(keys[-1])
            if many >= rows:
                yield held()
                keys, nodes, sizes, many = [], [], [], 0
    if keys:
        yield held()


def coarse(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The partition of each signature, and its name there: 40 bits."""
    keys = keys.view(U64)
    return (keys & U64((1 << 24) - 1)) % U64(parts), keys >> U64(24)


def named(part: np.ndarray, name: np.ndarray) -> np.ndarray:
    """The key that stands for a partition and a name in it, its bits mixed."""
    return tk.mix(part << U64(40) | name).view(np.int64)


def packed(keys: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows (part, names): the names of the signatures of each partition, five bytes each."""
    part, name = coarse(keys, parts)
    order = np.argsort(part, kind="stable")
    part, name = part[order].astype(np.int32), name[order]
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    data = np.ascontiguousarray(name.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NAME])
    offsets = np.append(starts, len(part)).astype(np.int32) * NAME
    names = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(part[starts]), names], names=["part", "names"])


def unpacked(batch: pa.RecordBatch) -> np.ndarray:
    """Partition and name of every signature of ``packed`` rows, as one number each."""
    blobs = batch.column("names").to_pylist()
    name = np.zeros((sum(map(len, blobs)) // NAME, 8), np.uint8)
    name[:, :NAME] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, NAME)
    part = np.repeat(batch.column("part").to_numpy().astype(U64), [len(x) // NAME for x in blobs])
    return part << U64(40) | name.view("<u8").ravel()


def met_twice(batches: Iterator[pa.RecordBatch], fold: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The keys that come twice or more in a partition; what is held grows with its different keys only."""
    once, twice, held, many = np.zeros(0, U64), np.zeros(0, U64), [], 0

    def folded() -> tuple[np.ndarray, np.ndarray]:
        new = np.sort(np.concatenate(held))
        first = np.diff(new, prepend=~new[:1]) != 0
        again = np.unique(new[~first])
        new = new[first]
        return np.union1d(once, new), np.union1d(twice, np.concatenate([again, np.intersect1d(once, new, assume_unique=True)]))

    for batch in batches:
        held.append(unpacked(batch))
        many += len(held[-1])
        if many > max(fold, len(once)):
            once, twice = folded()
            held, many = [], 0
    if many:
        once, twice = folded()
    for k in range(0, len(twice), 1 << 16):
        keys = twice[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(named(keys >> U64(40), keys & U64((1 << 40) - 1)))], names=["key"])


def parts_for(spark: SparkSession, shingles: int) -> int:
    """Partitions for the signatures of so many shingles; a set shows about as many signatures as it has shingles."""
    return min(1 << 24, max(int(spark.conf.get("spark.sql.shuffle.partitions")), shingles // SHARE + 1))


def shared_keys(docs: DataFrame, chosen: Broadcast, parts: int, shingle: int, percent: int) -> DataFrame:
    """The signatures (key) that two or more of the ``chosen`` rows show."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, *_ in shown(those(batches, chosen), shingle, percent):
            if len(keys):
                yield packed(keys, parts)

    return docs.select("at", "text").mapInArrow(run, "part int, names binary").repartitionById(parts, "part").mapInArrow(met_twice, "key long")


def those(batches: Iterator[pa.RecordBatch], chosen: Broadcast) -> Iterator[pa.RecordBatch]:
    """The rows whose ``at`` the filter passes."""
    for batch in batches:
        yield batch.filter(pa.array(sieve.holds(chosen.value, batch.column("at").to_numpy())))


def bucket_members(docs: DataFrame, chosen: Broadcast, shared: DataFrame, parts: int, shingle: int, percent: int) -> DataFrame:
    """(key, node, n, other, m): the nodes of each shared signature, with their sizes, and the centre of its bucket."""
    sent = docs.sparkSession.sparkContext.broadcast(sieve.build(shared, "key", sieve.sized(shared.count())))
    # Chosen where the join has dealt a bucket's rows to, so that they are not moved again for it.
    centre = F.min_by(F.struct(F.col("node").alias("other"), F.col("n").alias("m")), F.xxhash64("node", F.pmod("key", F.lit(PIVOTS)))).over(Window.partitionBy("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, nodes, sizes, many in shown(those(batches, chosen), shingle, percent):
            keys = named(*coarse(keys, parts))
            keep = np.flatnonzero(sieve.holds(sent.value, keys))
            of = np.repeat(np.arange(len(nodes)), many)[keep]
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(nodes, pa.binary()).take(pa.array(of)), pa.array(sizes[of])], names=["key", "node", "n"])

    return docs.select("at", "text").mapInArrow(run, "key long, node binary, n long").join(shared, "key", "left_semi").distinct().withColumn("c", centre).select("key", "node", "n", "c.*")


def likeliest(met: DataFrame, percent: int) -> DataFrame:
    """Of rows (node, n, other, m), one for each shared signature, the pair of each node with the partner that
    shares most signatures, of those whose sizes allow the similarity."""
    fit = met.filter((F.col("node") != F.col("other")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m")))
    counted = fit.groupBy("node", "other").agg(F.count("*").alias("many"))
    best = counted.groupBy("node").agg(F.max_by("other", F.struct("many", "other")).alias("other"))
    return best.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()


def outline(items: np.ndarray) -> bytes:
    """Four bits for each of 2**k equal parts of the domain, as many as there are sorted hashes or more: the exclusive or of the last bits of those in it."""
    k = max(3, (len(items) - 1).bit_length())
    part = (items >> U64(64 - k)).astype(np.int64)
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    out = np.zeros(1 << k, np.uint8)
    out[part[starts]] = np.bitwise_xor.reduceat((items & U64(15)).astype(np.uint8), starts)
    return (out[::2] << 4 | out[1::2]).tobytes()


def apart_in(x: bytes, y: bytes) -> int:
    """In how many parts two outlines differ; the sets differ in as many elements at least."""
    a, b = (np.frombuffer(z, np.uint8) for z in sorted((x, y), key=len))
    while len(b) > len(a):
        # Two neighbouring parts become one.
        b = (b >> 4) ^ (b & 15)
        b = b[::2] << 4 | b[1::2]
    d = a ^ b
    return int(np.count_nonzero(d >> 4) + np.count_nonzero(d & 15))


def outlined(sets: DataFrame) -> DataFrame:
    """(node, n, outline) of ``sets`` (node, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sized = [(len(items), outline(items)) for _, items in _read(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([n for n, _ in sized], pa.int64()), pa.array([x for _, x in sized], pa.binary())], names=["node", "n", "outline"])

    return sets.select("node", "items").mapInArrow(run, "node binary, n long, outline binary")


def close(pairs: DataFrame, outlines: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose outlines do not rule out that they are similar enough: an outline is a twelfth of a set, and no link is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = batch.column("n").to_numpy() + batch.column("m").to_numpy()
            most = both + 2 * (-both * percent // (100 + percent))
            keep = [apart_in(x, y) <= k for x, y, k in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), most, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    outlines = thinned(outlines, ends_of(pairs))
    first = pairs.join(outlines.select(F.col("node").alias("a"), "n", F.col("outline").alias("x")), "a")
    met = first.join(outlines.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("outline").alias("y")), "b")
    return met.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a binary, b binary")


def linked(docs: DataFrame, marked: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, component) of the nodes that are linked with another one. ``marked`` is the sketch of ``docs``."""
    spark = docs.sparkSession
    one_each = save(marked.groupBy("node").agg(F.min("at").alias("at"), F.min("n_shingles").alias("n")), "one_each")
    total, many = one_each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    chosen_rows = spark.sparkContext.broadcast(sieve.build(one_each, "at", sieve.sized(many)))
    parts_of_keys = parts_for(spark, total)
    shared = save(shared_keys(docs, chosen_rows, parts_of_keys, shingle, percent), "shared")
    members = save(bucket_members(docs, chosen_rows, shared, parts_of_keys, shingle, percent), "members")
    pairs = save(likeliest(members, percent), "pairs")
    nodes = members.select("node").distinct()
    rows_of = save(one_each.join(nodes, "node", "left_semi").select("node", "at"), "rows_of")
    sets = once(save(sets_of(docs, rows_of, shingle), "sets"), rows_of.count())
    outlines = save(outlined(sets), "outlines")
    tried = [save(close(pairs, outlines, percent), "tried")]
    first = components(verified(tried[0], sets, percent))
    chosen = [F.min_by(F.struct(F.col("node").alias("other"), F.col("n").alias("m"), F.col("component").alias("c")), F.xxhash64(F.lit(k), "node", F.pmod("key", F.lit(32)))) for k in range(SECOND)]
    apart = unsettled(members.select("key", "node", "n"), first, **{f"centre{k}": c for k, c in enumerate(chosen)})
    others = apart.select("node", "n", "component", F.inline(F.array_distinct(F.array(*(f"centre{k}" for k in range(SECOND))))))
    second = save(likeliest(others.filter("component <> c"), percent).join(pairs, ["a", "b"], "left_anti"), "second")
    tried.append(save(close(second, outlines, percent), "tried"))
    parts = joined(first, verified(tried[1], sets, percent))
    # Components only grow, so a bucket that held one holds one.
    left = save(unsettled(apart.select("key", "node"), parts).select("node").distinct(), "left")
    rest = save(thinned(sets, left), "rest")
    total = rest.agg(F.sum(F.size("items"))).first()[0] or 0
    prefix, spread = prefixes(rest, _read, total, percent)
    more, placed = across(prefix, parts, percent, spread)
    third = save(more.join(pairs.unionByName(second), ["a", "b"], "left_anti"), "third")
    tried.append(save(close(third, outlines, percent), "tried"))
    out = joined(parts, verified(tried[2], sets, percent))
    forget(one_each, shared, members, pairs, rows_of, sets, outlines, first, apart, second, parts, left, rest, spread, placed, third, *tried)
    return out


def _read(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray]]:
    for node, items in zip(batch.column("node"), batch.column("items"), strict=True):
        yield node.as_py(), items.values.to_numpy().view(U64)


def similar_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) of every document."""
    source = ids_and_text(docs).withColumn("at", F.xxhash64("doc_id", "text"))
    marked = save(sketch(source, shingle), "sketch")
    known = marked.filter("node IS NOT NULL")
    found = linked(source, known, shingle, percent)
    least = known.groupBy("node").agg(F.min("doc_id").alias("least")).join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    least = save(least, "least")
    of_node = least.join(least.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id")
    empty = marked.filter("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.join(of_node, "node").select("doc_id", "n_shingles", "component_id").unionByName(empty)


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))
