"""Near-duplicate documents: MinHash bands, full-set verification, connected components.

1. One pass turns each text into its set of shingles (64-bit hashes of five lower-cased
   words), the set's digest, and ``BANDS * ROWS`` minima under universal hash functions: one
   key for each band, and one byte of each minimum as signature. The digest is the node: equal
   sets are one node from here on, so a text with thousands of copies is looked at once.
2. Nodes that share a band's key are candidates. Keys met by one node only are dropped first
   (counted exactly, then told by a Bloom filter and a join). Each node of a bucket is paired
   with the bucket's centre only, never with all others. Pairs whose sizes allow the similarity
   and whose signatures agree in ``AGREE`` places at least are verified on the full sets: linked
   if 100 * intersection >= 75 * union. (Of a pair that similar, 96 of the 128 places agree on
   average; fewer than 72 are five standard deviations off.) Centres are chosen in ``PIVOTS``
   ways; a second round pairs what is still apart with centres of other components.
3. What bands and stars can miss is found by an exact search over all nodes: a pair that similar
   shares one of the rarest shingles of each set. Rarity is counted in ``BINS`` bins of hashed
   shingles at most, which go to every task; any one order of all shingles finds every pair.
   Rare shingles that only one node shows are dropped first, by a grouping and a Bloom filter.
   Only pairs of different components are verified, and added to the links. Signatures rule out
   a pair here only below ``SURELY`` places, which a similar pair meets with a chance under 1e-17.
4. Components are found by alternating large-star and small-star steps until the edges are
   stars; every step is a grouping with partial minima and a join. Links found later are
   added to the components found so far, which are stars already.

Defined results: a null or empty text, or one of white space, has an empty set and is linked
with nothing; a text of under five words has one shingle, the whole sequence; rows with equal
doc_id are members by their texts, like any others. A null doc_id has no rank: such a row gets the
smallest id of its component, or null, and is kept only where that is null. An
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sieve
from . import textkit as tk
from .common import forget, ids_and_text, let_go, save, table, unused

SHINGLE, BANDS, ROWS, PERCENT = 5, 32, 4, 75
#: Different choices of a bucket's centre.
PIVOTS = 4
#: Centres of other components that a node meets in each bucket of the second round.
SECOND = 2
#: Places of the signature in which a pair must agree to be verified, in the rounds before the exact search and in it.
AGREE, SURELY = 72, 50
BINS, BLOCK = 1 << 23, 1 << 12
_RNG = np.random.default_rng(7)
_A = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
#: Shingles whose hashes are made at once, and the room for them.
_AT_ONCE = 256
_ROOM = np.empty((BANDS * ROWS, _AT_ONCE), np.uint64)


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted different values of an array that is not empty; for sets of a text's size a plain sort is faster than np.unique."""
    hashes = np.sort(hashes)
    first = np.ones(len(hashes), bool)
    np.not_equal(hashes[1:], hashes[:-1], out=first[1:])
    return hashes[first]


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for _, _, data, offsets in tk.blocks(column):
        starts, ends, row = tk.words(data, offsets)
        hashes = tk.Spans(data, tk.LOWER)(starts, ends)
        window, _ = tk.windows(hashes, row, shingle)
        at = np.searchsorted(row, np.arange(len(offsets)))
        for a, b in zip(at, at[1:], strict=False):
            if b - a >= shingle:
                yield distinct(window[a : b - shingle + 1])
            elif b > a:
                # Mixed with its length, so that it differs from any full shingle.
                yield tk.mix(tk.windows(hashes[a:b], row[a:b], int(b - a))[0] + np.uint64(b - a))
            else:
                yield np.zeros(0, tk.U64)


def minima(items: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(items), _AT_ONCE):
        part = items[k : k + _AT_ONCE]
        room = _ROOM[:, : len(part)]
        np.multiply(_A[:, None], part, out=room)
        np.add(room, _B[:, None], out=room)
        np.minimum(out, room.min(axis=1), out=out)
    return out


def sketched(items: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A key for each band, and one byte of each minimum."""
    least = minima(items)
    rows = (least >> np.uint64(32)).reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        h = tk.mix(h + rows[:, j] * np.uint64(0x9E3779B97F4A7C15))
    return h.view(np.int64), least.astype(np.uint8).tobytes()


def digest(items: np.ndarray) -> bytes | None:
    """The node of a set; none of the empty set."""
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None


def brief(node: bytes) -> int:
    """A long that tells whether two nodes that share a key differ."""
    return int.from_bytes(node[:8], "little", signed=True)


def different_sets(column: pa.Array, shingle: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """Node and set of each different set of a batch; none of empty ones."""
    met: set[bytes | None] = {None}
    for items in shingle_sets(column, shingle):
        node = digest(items)
        if node not in met:
            met.add(node)
            yield node, items


def gathered(run: Callable, rows: int = 1 << 16) -> Callable:
    """Small batches of a task put together."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in run(batches):
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= rows:
                yield pa.concat_batches(held)
                held, n = [], 0
        if held:
            yield pa.concat_batches(held)

    return some


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    for batch in batches:
        met: set[bytes | None] = {None}
        n, nodes, keys, signs = [], [], [], []
        for items in shingle_sets(batch.column("text")):
            node = digest(items)
            key, sign = (None, None) if node in met else sketched(items)
            met.add(node)
            n.append(len(items))
            nodes.append(node)
            keys.append(key)
            signs.append(sign)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("at"), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(signs, pa.binary())],
            names=["doc_id", "at", "n_shingles", "node", "keys", "sign"],
        )


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, items) of the rows whose ``at`` is among ``wanted`` (at), and of a few others that a filter passes.

    Texts are read again, so that no text is moved."""
    sent = docs.sparkSession.sparkContext.broadcast(sieve.build(wanted, "at", sieve.sized(wanted.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(sieve.holds(sent.value, batch.column("at").to_numpy())))
            sets = dict(different_sets(batch.column("text"), shingle))
            yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.binary()), pa.array([x.view(np.int64) for x in sets.values()], pa.list_(pa.int64()))], names=["node", "items"])

    return docs.select("at", "text").mapInArrow(run, "node binary, items array<long>")


def once(sets: DataFrame, wanted: int) -> DataFrame:
    """``sets`` (saved) with each node once, where many rows are repeated; a few repeated ones only repeat a verdict."""
    if sets.count() <= 2 * wanted:
        return sets
    out = save(sets.dropDuplicates(["node"]), "sets")
    forget(sets)
    return out


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def thinned(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``sets`` whose node is among ``nodes``, and a few others that a filter passes; none is exchanged."""
    keys = nodes.select(F.xxhash64("node").alias("key"))
    sent = sets.sparkSession.sparkContext.broadcast(sieve.build(keys, "key", sieve.sized(keys.count())))

    @F.pandas_udf("boolean")
    def maybe(key: pd.Series) -> pd.Series:
        return pd.Series(sieve.holds(sent.value, key.to_numpy()))

    return sets.filter(maybe(F.xxhash64("node")))


def promising(rows: DataFrame, agree: int = AGREE) -> DataFrame:
    """The pairs (a, b) of ``rows`` (a, b, sizes n and m, signatures x and y) that may be similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in ("x", "y"))
            keep = ((x == y).sum(axis=1) >= agree) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return rows.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a binary, b binary")


def with_signs(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs (a, b) with sizes and signatures of both."""
    first = pairs.join(signed.select(F.col("node").alias("a"), "n", F.col("sign").alias("x")), "a")
    return first.join(signed.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sign").alias("y")), "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, keep = batch.column("x"), batch.column("y"), []
            for k in range(batch.num_rows):
                x, y = left[k].values.to_numpy(), right[k].values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = thinned(sets, ends_of(pairs))
    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _stars(edges: DataFrame) -> bool:
    """Whether no node of ``edges`` (a, b; a > b, distinct) has two smaller neighbours, or a smaller and a larger one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    met = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return met.filter("down > 1 OR (down > 0 AND up > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over ``edges`` (a, b), for every node on one."""
    edges = save(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: every larger neighbour of a node goes to the least of the node's neighbourhood.
        # Minima are saved, so that the join after them reads plain rows and a hot node's can be split.
        least = save(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = save(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "large")
        forget(edges, least)
        # Small star: a node and its smaller neighbours go to the least of them.
        least = save(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = save(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        forget(large, least)
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return save(out.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "components")


def joined(parts: DataFrame, more: DataFrame) -> DataFrame:
    """The components that ``more`` (a, b) makes of ``parts`` (node, component)."""
    return components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def unsettled(members: DataFrame, parts: DataFrame, **more: Column) -> DataFrame:
    """The rows of the buckets of ``members`` (key, node) that hold more than one component, with that of each node.

    ``more`` are aggregates of a whole bucket. Rows are dealt by bucket once for all of it, as when they were found."""
    # Dealt before the windows' own columns are made, which else would be moved too.
    placed = members.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")).repartition("key")
    bucket = Window.partitionBy("key")
    mark = F.xxhash64("component")
    mixed = placed.withColumns({"lo": F.min(mark).over(bucket), "hi": F.max(mark).over(bucket)} | {name: of.over(bucket) for name, of in more.items()})
    return save(mixed.filter("lo <> hi").select(*members.columns, "component", *more), "unsettled")


def _pairs(left: str, right: str) -> list:
    return [F.greatest(left, right).alias("a"), F.least(left, right).alias("b")]


#: Reads (node, items) out of a batch.
Reader = Callable[[pa.RecordBatch], Iterator[tuple[bytes, np.ndarray]]]


def _folded(met: np.ndarray) -> bytes:
    """A block of counts, up to 65,535 each: first the low bytes, then the high ones, which are mostly zero."""
    met = np.minimum(met, 65535)
    return zlib.compress((met & 255).astype(np.uint8).tobytes() + (met >> 8).astype(np.uint8).tobytes(), 1)


def _counts(folded: bytes) -> np.ndarray:
    low, high = np.frombuffer(zlib.decompress(folded), np.uint8).reshape(2, -1).astype(np.uint16)
    return high << np.uint16(8) | low


def rarity(source: DataFrame, read: Reader, total: int) -> np.ndarray:
    """How often the shingles of each bin stand in the sets of ``source``, up to 65,535; at most ``BINS`` numbers come to the driver."""
    bins = min(BINS, 1 << max(16, int(total).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(bins, np.uint32)
        for batch in batches:
            for _, items in read(batch):
                np.add.at(met, (items & np.uint64(bins - 1)).astype(np.int64), 1)
        for k in np.flatnonzero(met.reshape(-1, BLOCK).any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_folded(met[k * BLOCK : (k + 1) * BLOCK])], pa.binary())], names=["block", "met"])

    def add(rows: pa.Table) -> pa.Table:
        met = sum(_counts(x).astype(np.uint64) for x in rows["met"].to_pylist())
        return pa.table({"block": rows["block"][:1], "met": pa.array([_folded(met)], pa.binary())})

    got = source.mapInArrow(run, "block int, met binary").groupBy("block").applyInArrow(add, "block int, met binary").toArrow()
    out = np.zeros(bins, np.uint16)
    for k, met in zip(got["block"].to_pylist(), got["met"].to_pylist(), strict=True):
        out[k * BLOCK : (k + 1) * BLOCK] = _counts(met)
    return out


def rarest(items: np.ndarray, met: np.ndarray, percent: int) -> np.ndarray:
    """The n - ceil(p n) + 1 rarest of n sorted shingles, rarest first: of a similar pair, both sets show one."""
    keep = len(items) - -(-len(items) * percent // 100) + 1
    # Of equally rare ones the least come first, as the items are in order.
    return items[np.argsort(met[(items & np.uint64(len(met) - 1)).astype(np.int64)], kind="stable")[:keep]]


def prefixes(source: DataFrame, read: Reader, total: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(node, n, short, items, at): one row for each node, with those of its rarest shingles that two nodes may show, and their ranks; and (item), what two nodes show, saved.

    The larger set of a pair shows one of its n - ceil(p n) + 1 rarest shingles; the smaller one need
    only show its n - ceil(2 p n / (1 + p)) + 1 rarest (``short``), since the overlap is at least that of it."""
    context = source.sparkSession.sparkContext
    order = context.broadcast(rarity(source, read, total))

    def items_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, items in read(batch):
                rare = rarest(items, order.value, percent)
                yield pa.RecordBatch.from_arrays([pa.array(rare.view(np.int64)), pa.array(np.full(len(rare), brief(node)))], names=["item", "node"])

    met = source.mapInArrow(gathered(items_of), "item long, node long").groupBy("item").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    spread = save(met.filter("lo <> hi").select("item"), "spread")
    sent = context.broadcast(sieve.build(spread, "item", sieve.sized(spread.count())))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, items in read(batch):
                n = len(items)
                rare = rarest(items, order.value, percent).view(np.int64)
                at = np.flatnonzero(sieve.holds(sent.value, rare))
                if len(at):
                    short = n - -(-n * 2 * percent // (100 + percent)) + 1
                    yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([n]), pa.array([short]), pa.array([rare[at]], pa.list_(pa.int64())), pa.array([at + 1], pa.list_(pa.int64()))], names=["node", "n", "short", "items", "at"])

    rows = source.mapInArrow(gathered(rows_of, 1 << 10), "node binary, n long, short long, items array<long>, at array<long>")
    return rows.dropDuplicates(["node"]), spread


def meetings(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components, that may be similar enough, by the items they share, of which only some
    later ones are left out. Of ``rows`` (item, node, n, at, short, component, before, earlier), the last
    two are the node's items of the two ranks before."""
    n = F.col("n")
    other = rows.select("item", F.col("node").alias("b"), F.col("n").alias("m"), F.col("component").alias("c"), F.col("at").alias("to"), F.col("before").alias("last"), F.col("earlier").alias("last_but_one"))
    larger = (F.col("m") > n) | ((F.col("m") == n) & (F.col("b") > F.col("node")))
    # At the first item two sets share, what follows it in each must still hold the overlap they need.
    room = (100 + percent) * (1 + F.least(n - F.col("at"), F.col("m") - F.col("to"))) >= percent * (n + F.col("m"))
    # Two sets that also share an item just before this one meet there, as that is in both prefixes too.
    met_before = [F.coalesce(F.col(x) == F.col(y), F.lit(False)) for x in ("before", "earlier") for y in ("last", "last_but_one")]
    new = ~(met_before[0] | met_before[1] | met_before[2] | met_before[3])
    met = rows.filter("short").join(other, "item").filter((F.col("component") != F.col("c")) & larger & (100 * n >= percent * F.col("m")) & room & new)
    return met.select(*_pairs("node", "b"))


def across(prefix: DataFrame, parts: DataFrame, percent: int, spread: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of nodes of different components that share a rare shingle and may be similar enough; and the rows they come from, saved."""
    # A node learns its component while it is one row, not once for each of its shingles.
    before, earlier = (F.concat(F.array_repeat(F.lit(None).cast("long"), k), "items") for k in (1, 2))
    each = prefix.join(parts, "node", "left").select("node", "n", "short", F.coalesce("component", "node").alias("component"), F.inline(F.arrays_zip("items", "at", before, earlier)).alias("item", "at", "before", "earlier"))
    each = each.filter("item IS NOT NULL")
    placed = save((each if spread is None else each.join(spread, "item", "left_semi")).select("item", "node", "n", "at", (F.col("at") <= F.col("short")).alias("short"), "component", "before", "earlier"), "prefix")
    spread = placed.groupBy("item").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("item")
    rows = placed.join(spread, "item", "left_semi")
    return meetings(rows, percent).distinct(), placed


def linked(sketch: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``sketch`` that are linked with another one."""
    context = docs.sparkSession.sparkContext
    rows = sketch.filter("keys IS NOT NULL")
    met = rows.select(F.xxhash64("node").alias("node"), F.explode("keys").alias("key")).groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    shared = save(met.filter("lo <> hi").select("key"), "shared")
    sent = context.broadcast(sieve.build(shared, "key", sieve.sized(shared.count())))

    def may_share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys").flatten().to_numpy()
            keep = sieve.holds(sent.value, keys)
            nodes = batch.column("node").take(pa.array(np.flatnonzero(keep) // BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), nodes], names=["key", "node"])

    members = save(rows.select("node", "keys").mapInArrow(may_share, "key long, node binary").join(shared, "key", "left_semi").distinct(), "members")
    # The star's centre differs from key to key, so that a node meets several of its kin.
    turn = F.xxhash64("node", F.pmod("key", F.lit(PIVOTS)))
    centre = members.groupBy("key").agg(F.min_by("node", turn).alias("b"))
    nodes = save(members.select("node").distinct(), "met")
    signed = save(sketch.filter("keys IS NOT NULL").select("node", F.col("n_shingles").alias("n"), "sign").join(nodes, "node", "left_semi").distinct(), "signed")
    heads = centre.join(signed.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sign").alias("y")), "b")
    met = members.join(signed.withColumnRenamed("sign", "x"), "node").join(heads, "key").filter("node <> b")
    pairs = save(promising(met.select(*_pairs("node", "b"), "n", "m", "x", "y")).distinct(), "pairs")
    # One row of each node is read again: ``at`` tells apart rows of one doc_id with different texts.
    rows_of = save(sketch.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("at").alias("at")), "rows_of")
    sets = once(save(sets_of(docs, rows_of), "sets"), rows_of.count())
    first = components(verified(pairs, sets))
    # Once more, only for what is still apart: nodes against centres of other components.
    chosen = [F.min_by(F.struct(F.col("node").alias("b"), F.col("component").alias("c")), F.xxhash64(F.lit(k), "node", F.pmod("key", F.lit(BANDS)))) for k in range(SECOND)]
    apart = unsettled(members, first, **{f"centre{k}": c for k, c in enumerate(chosen)})
    met = apart.select("node", "component", F.inline(F.array_distinct(F.array(*(f"centre{k}" for k in range(SECOND))))))
    others = met.filter("component <> c").select(*_pairs("node", "b")).distinct()
    second = save(promising(with_signs(others.join(pairs, ["a", "b"], "left_anti"), signed)), "second")
    parts = joined(first, verified(second, sets))
    pairs = pairs.unionByName(second)
    # Then every pair that is still apart, whether or not a bucket holds both.
    read = lambda batch: different_sets(batch.column("text"), SHINGLE)
    total = sketch.agg(F.sum("n_shingles")).first()[0] or 0
    prefix, spread = prefixes(docs.select("text"), read, total, PERCENT)
    more, placed = across(prefix, parts, PERCENT, spread)
    more = save(more.join(pairs, ["a", "b"], "left_anti"), "more")
    forget(shared, members, nodes, signed, rows_of, apart, first, sets, spread, placed)
    if more.isEmpty():
        return parts
    ends = ends_of(more)
    of_ends = sketch.filter("keys IS NOT NULL").select("node", F.col("n_shingles").alias("n"), "sign").join(ends, "node", "left_semi").dropDuplicates(["node"])
    third = save(promising(with_signs(more, of_ends), SURELY), "third")
    ends = ends_of(third)
    rows_of = save(sketch.filter("node IS NOT NULL").join(ends, "node", "left_semi").groupBy("node").agg(F.min("at").alias("at")), "rows_of")
    sets = once(save(sets_of(docs, rows_of), "sets"), rows_of.count())
    out = joined(parts, verified(third, sets))
    forget(more, third, rows_of, sets, parts)
    return out


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``at``, a hash of the two."""
    return ids_and_text(docs).withColumn("at", F.xxhash64("doc_id", "text"))


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, at, n_shingles, component (null for an empty set) and component_id, its least doc_id, of every document."""
    source = _rows(docs)
    sketch = save(source.select("doc_id", "at", "text").mapInArrow(_sketch, "doc_id long, at long, n_shingles long, node binary, keys array<long>, sign binary"), "sketch")
    nodes = sketch.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    found = linked(sketch, source)
    placed = save(nodes.select("node", "least").join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component")), "placed")
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = save(placed.join(least, "component").select("node", "component", "component_id"), "of_node")
    empty = sketch.filter("node IS NULL").select("doc_id", "at", "n_shingles", F.lit(None).cast("binary").alias("component"), F.col("doc_id").alias("component_id"))
    rest = sketch.filter("node IS NOT NULL").select("doc_id", "at", "n_shingles", "node").join(of_node, "node")
    return rest.select("doc_id", "at", "n_shingles", "component", "component_id").unionByName(empty)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return grouped(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group stays, one with the least doc_id, or with none if no row has an id."""
    found = save(grouped(docs).filter("component IS NOT NULL").groupBy("doc_id", "at", "component").agg(F.count("*").alias("many")), "grouped")
    best = found.groupBy("component").agg(F.count("*").alias("texts"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")).alias("best"))
    shared = found.join(best.filter("texts > 1"), "component", "left")
    stays = F.col("best").isNull() | (F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.at") == F.col("at")))
    # Rows to drop, and rows of which one stays, as both id and text are repeated.
    marked = save(shared.select("doc_id", "at", "many", stays.alias("stays")).filter("NOT stays OR many > 1"), "marked")
    names = docs.columns
    own_id, own_at, nth = unused(docs, "id", "at", "nth")
    source = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_at: F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))})
    # Most rows are not marked; a filter tells them, and they stay where they are.
    sent = spark.sparkContext.broadcast(sieve.build(marked, "at", sieve.sized(marked.count())))

    @F.pandas_udf("boolean")
    def maybe(at: pd.Series) -> pd.Series:
        return pd.Series(sieve.holds(sent.value, at.to_numpy()))

    hit = source.filter(maybe(own_at))
    same = lambda m: hit[own_id].eqNullSafe(m["doc_id"]) & (hit[own_at] == m["at"])
    repeated = marked.filter("stays")
    one = hit.join(repeated, same(repeated), "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy(own_id, own_at).orderBy(own_at))).filter(F.col(nth) == 1)
    rest = hit.join(marked, same(marked), "left_anti")
    return source.filter(~maybe(own_at)).select(*names).unionByName(rest.select(*names)).unionByName(one.select(*names))
