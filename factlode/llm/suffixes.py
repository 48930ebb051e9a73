"""Repeated byte strings, found by blockwise suffix sorting with a difference cover.

A window is ``LENGTH`` bytes of one text. Its anchor is the least hash of the ``GRAM``-byte
strings in it, so equal windows have equal anchors wherever they stand.

1. *Grams.* Each text emits its strings of ``GRAM`` bytes with a small hash, about one byte in
   ``SPARSE``, and the anchors of windows that hold none. Strings met once recur nowhere, and
   neither does a window that holds one. Those met twice go to every task as Bloom filter.
2. *Segments.* The runs of windows with one anchor that are left are emitted with their bytes,
   dealt by anchor, so all occurrences of a window meet in one shard. Equal segments of a batch
   are emitted once, with all their places.
3. *Suffix sort.* A shard's distinct segments stand end to end. Positions whose residue
   modulo 7 is in {1, 2, 4}, a difference cover, are ranked once by doubling (7 bytes, 14, 28,
   ... 448). The windows are then sorted one bucket of leading bytes at a time: by 7 bytes,
   and where these tie by the cover ranks at the first offset, below 7, where both windows
   meet the cover. Only one bucket's order is in memory. Neighbours that agree in ``LENGTH``
   bytes, and windows of a segment met twice, are repeated.

An anchor of more than ``HOT`` segments may have too many different ones for one shard. These are
made distinct by a grouping with partial counts and cut into pieces of ``WIDTHS`` windows by
their windows' distance from the anchor. All windows of a piece share its core, the bytes between
the last window's start and the first one's end, so pieces are dealt by core: a passage that many
texts share parts from what stands round it in each. Pieces of a core are suffix-sorted as above;
a core with more than ``HOT`` different ones is cut again, in the end to single windows, which are
equal if their bytes are.

Defined results: a null or empty text has no bytes; texts under ``LENGTH`` bytes lose nothing;
repeated rows are repeats of each other, also with a null doc_id; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sieve
from . import textkit as tk
from .common import forget, ids_and_text, save, table

LENGTH, GRAM = 400, 32
#: One string in so many stands for its neighbourhood.
SPARSE = 64
SMALL = np.uint64((1 << 64) // SPARSE)
HOT, WIDTHS = 2000, (64, 8, 1)
#: Bytes of segments a shard should hold.
SHARD = 1 << 20
PERIOD, COVER = 7, (1, 2, 4)
BUCKET = 1 << 19
SEGMENT = "anchor long, h1 long, h2 long, bytes binary, places array<struct<row_key:binary,first:long>>"
PIECE = "anchor long, h1 long, h2 long, c1 long, c2 long, p1 long, p2 long, starts array<long>, met long, bytes binary"
SPANS = "row_key binary, first long, last long"
INNER = "h1 long, h2 long, first long, last long"
#: First offset at which positions of residues a and b both meet the cover.
MEET = np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])
IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


class Grams:
    """The GRAM-byte strings of a block, and the anchors of its windows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        full = np.diff(offsets) >= LENGTH
        room = np.zeros(len(data) + 1, np.int32)  # windows that lie in one row
        np.add.at(room, offsets[:-1][full], 1)
        np.add.at(room, offsets[1:][full] - LENGTH + 1, -1)
        self.room = np.cumsum(room[: max(0, len(data) - LENGTH + 1)]) > 0
        if not self.room.any():
            self.grams, self.small, self.least, self.bare = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
            return
        self.grams = tk.grams32(data)
        self.least = _sliding_least(self.grams, LENGTH - GRAM + 1)
        small = self.grams < SMALL
        for d in range(1, GRAM):  # those that cross a row's end
            at = offsets[1:-1] - d
            small[at[(at >= 0) & (at < len(small))]] = False
        self.small = np.flatnonzero(small)
        self.bare = self.room & (self.least >= SMALL)

    def keys(self) -> np.ndarray:
        """Small strings, and the anchors of windows without any, at each place once."""
        if not len(self.least):
            return self.grams
        bare = self.least[self.bare]
        if not len(bare):
            return self.grams[self.small]
        # Every place of such an anchor's string counts, else two in one window would count once.
        spots = np.zeros(len(self.grams), bool)
        for a, b in _runs(self.bare):
            spots[a : b + LENGTH - GRAM] = True
        near = self.grams[spots]
        return np.concatenate([self.grams[self.small], near[np.isin(near, np.unique(bare))]])

    def runs(self, recur: np.ndarray, offsets: np.ndarray):
        """First window, window count and anchor of each run of windows that may recur."""
        none = np.zeros(0, np.int64)
        if not len(self.least):
            return none, none, np.zeros(0, np.uint64)
        lone = np.zeros(len(self.grams) + 1, np.int32)
        lone[self.small[~sieve.holds(recur, tk.mix(self.grams[self.small]))] + 1] = 1
        lone = np.cumsum(lone)
        wide = LENGTH - GRAM + 1
        live = self.room & (lone[wide : wide + len(self.room)] == lone[: len(self.room)])
        bare = np.flatnonzero(live & self.bare)
        live[bare[~sieve.holds(recur, tk.mix(self.least[bare]))]] = False
        at = np.flatnonzero(live)
        if not len(at):
            return none, none, np.zeros(0, np.uint64)
        least = self.least[at]
        new = np.ones(len(at), bool)
        new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
        edge = np.searchsorted(at, offsets[:-1])
        new[edge[edge < len(at)]] = True
        begin = np.flatnonzero(new)
        return at[begin], np.diff(np.append(begin, len(at))), least[begin]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of set flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def recurring_grams(source: DataFrame) -> DataFrame:
    """(gram): strings met twice or more that may belong to a repeated window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for _, _, data, offsets in tk.blocks(batch.column("text")):
                keys.append(Grams(data, offsets).keys())
            gram, met = np.unique(np.concatenate(keys or [np.zeros(0, np.uint64)]), return_counts=True)
            gram = tk.mix(gram)  # small hashes share their first bits, by which the filter deals
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(met)], names=["gram", "met"])

    return source.mapInArrow(run, "gram long, met long").groupBy("gram").agg(F.sum("met").alias("met")).filter("met > 1").select("gram")


def _name(content: bytes) -> tuple[int, int]:
    """A 128-bit name of some bytes, as two longs."""
    return struct.unpack("<qq", hashlib.blake2b(content, digest_size=16).digest())


def segments(source: DataFrame, recur: np.ndarray) -> DataFrame:
    """The bytes of each run of windows that may recur, once for each batch, with its places."""
    sent = source.sparkSession.sparkContext.broadcast(recur)
    names = [x.split()[0] for x in SEGMENT.split(", ")[:4]] + ["places"]
    place = pa.struct([("row_key", pa.binary()), ("first", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("row_key").to_pylist()
            found: dict[tuple[int, bytes], list[tuple[bytes, int]]] = {}
            for a, _, data, offsets in tk.blocks(batch.column("text")):
                first, many, anchor = Grams(data, offsets).runs(sent.value, offsets)
                row = np.searchsorted(offsets, first, side="right") - 1
                raw = data.tobytes()
                for x, y, g, r, at in zip(first.tolist(), (first + many + LENGTH - 1).tolist(), anchor.view(np.int64).tolist(), (a + row).tolist(), (first - offsets[row]).tolist(), strict=True):
                    found.setdefault((g, raw[x:y]), []).append((keys[r], at))
            part = list(found.items())
            for k in range(0, len(part), 2000):
                some = part[k : k + 2000]
                named = [_name(c) for (_, c), _ in some]
                columns = [pa.array([g for (g, _), _ in some], pa.int64()), pa.array([n[0] for n in named], pa.int64()), pa.array([n[1] for n in named], pa.int64()), pa.array([c for (_, c), _ in some], pa.binary())]
                places = pa.array([[{"row_key": r, "first": x} for r, x in p] for _, p in some], pa.list_(place))
                yield pa.RecordBatch.from_arrays([*columns, places], names=names)

    return source.mapInArrow(run, SEGMENT)


class Suffixes:
    """Cover ranks of a text, and its windows in order."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        padded = np.zeros(n + 2 * LENGTH + 128, np.int64)
        padded[:n] = text
        self.seven = np.zeros(n + LENGTH + 64, np.int64)
        for j in range(PERIOD):
            self.seven = (self.seven << 8) | padded[j : j + len(self.seven)]
        sample = np.flatnonzero(IN_COVER[np.arange(n + 8) % PERIOD])
        rank = np.zeros(n + 2 * LENGTH + 128, np.int64)
        rank[sample] = np.unique(self.seven[sample], return_inverse=True)[1] + 1
        depth = PERIOD
        while depth < LENGTH:
            if depth == 32 * PERIOD:
                self.half = rank.copy()
            pair = rank[sample] * (len(sample) + 2) + rank[sample + depth]
            rank[sample] = np.unique(pair, return_inverse=True)[1] + 1
            depth *= 2
        self.rank = rank

    def repeated(self, starts: np.ndarray) -> np.ndarray:
        """Which of the windows at ``starts`` equal another of them."""
        out = np.zeros(len(starts), bool)
        order = np.argsort(self.seven[starts], kind="stable")
        lead = self.seven[starts[order]]
        a = 0
        while a < len(order):  # one bucket of leading bytes at a time
            b = len(order) if a + BUCKET >= len(order) else int(np.searchsorted(lead, lead[a + BUCKET], side="left"))
            if b <= a:
                b = int(np.searchsorted(lead, lead[a], side="right"))
            self._bucket(starts, order[a:b], lead[a:b], out)
            a = b
        return out

    def _bucket(self, starts: np.ndarray, items: np.ndarray, lead: np.ndarray, out: np.ndarray) -> None:
        group = np.cumsum(np.append(True, lead[1:] != lead[:-1])) - 1
        size = np.bincount(group)
        tied = size[group] > 1
        items, group = items[tied], group[tied]
        if not len(items):
            return
        at = starts[items]
        residue = at % PERIOD
        wide = np.int64(len(self.rank) + 2)
        place = np.zeros(len(items), np.int64)
        members = [np.flatnonzero(residue == r) for r in range(PERIOD)]
        for b in range(PERIOD):
            if not len(members[b]):
                continue
            for d in np.unique(MEET[:, b]):
                theirs = np.sort(group[members[b]] * wide + self.rank[at[members[b]] + d])
                mine = np.concatenate([members[a] for a in range(PERIOD) if MEET[a, b] == d])
                key = group[mine] * wide
                # How many of residue b in the same group come before.
                place[mine] += np.searchsorted(theirs, key + self.rank[at[mine] + d]) - np.searchsorted(theirs, key)
        order = np.lexsort((place, group))
        x, y, same = at[order[:-1]], at[order[1:]], group[order[1:]] == group[order[:-1]]
        d = MEET[x % PERIOD, y % PERIOD]
        more = PERIOD * ((LENGTH - 32 * PERIOD - d) // PERIOD)
        tail = LENGTH - PERIOD
        same &= (self.half[x + d] == self.half[y + d]) & (self.half[x + d + more] == self.half[y + d + more]) & (self.seven[x + tail] == self.seven[y + tail])
        out[items[order[:-1]][same]] = True
        out[items[order[1:]][same]] = True


def _spans_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans that the flagged windows of a segment cover, joined where they meet."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > LENGTH)
    return list(zip(at[np.append(0, cut + 1)].tolist(), (at[np.append(cut, len(at) - 1)] + LENGTH).tolist(), strict=True))


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.table({n: pa.array(c, pa.int64() if k == "long" else pa.binary()) for (n, k), c in zip(fields, columns, strict=True)})


def repeated_in(met: dict[bytes, int]) -> dict[bytes, list[tuple[int, int]]]:
    """Spans of the repeated windows of some segments, each met so many times."""
    distinct = list(met)
    out = {c: [(0, len(c))] if n > 1 else [] for c, n in met.items()}
    if all(n > 1 for n in met.values()) or len(distinct) == 1 and len(distinct[0]) == LENGTH:
        return out
    sizes = np.array([len(c) for c in distinct])
    begins = np.cumsum(sizes) - sizes
    many = sizes - LENGTH + 1
    starts = np.repeat(begins - np.cumsum(many) + many, many) + np.arange(many.sum())
    flags = Suffixes(np.frombuffer(b"".join(distinct), np.uint8)).repeated(starts)
    for c, a, m in zip(distinct, np.cumsum(many) - many, many, strict=True):
        if met[c] == 1:
            out[c] = _spans_of(flags[a : a + m])
    return out


def _shard(table: pa.Table) -> pa.Table:
    """Spans of the repeated windows of a shard's segments."""
    met: dict[bytes, int] = {}
    of: dict[int, set[bytes]] = {}
    rows = list(zip(table["anchor"].to_pylist(), table["bytes"].to_pylist(), table["places"].to_pylist(), strict=True))
    for g, c, p in rows:
        met[c] = met.get(c, 0) + len(p)
        of.setdefault(g, set()).add(c)
    # A segment that shares its anchor with no other can only repeat itself, as a whole or round a second anchor string.
    alone = {c for g, some in of.items() if len(some) == 1 for c in some if met[c] > 1 or (tk.grams32(np.frombuffer(c, np.uint8)).view(np.int64) == g).sum() < 2}
    spans = repeated_in({c: n for c, n in met.items() if c not in alone}) | {c: [(0, len(c))] * (met[c] > 1) for c in alone}
    return _rows([(x["row_key"], x["first"] + a, x["first"] + b) for _, c, p in rows for a, b in spans[c] for x in p], SPANS)


def _shard_of_pieces(table: pa.Table) -> pa.Table:
    """Spans of the repeated windows of a shard's pieces, each of which stands in one row."""
    contents = table["bytes"].to_pylist()
    spans = repeated_in(dict(zip(contents, table["met"].to_pylist(), strict=True)))
    return _rows([(h, g, x, y) for h, g, c in zip(table["p1"].to_pylist(), table["p2"].to_pylist(), contents, strict=True) for x, y in spans[c]], INNER)


def pieces(content: bytes, anchor: int, width: int) -> dict[tuple[bytes, bytes], list[int]]:
    """Starts of a segment's pieces by core and content: up to ``width`` windows at like distance from their anchor."""
    spots = np.flatnonzero(tk.grams32(np.frombuffer(content, np.uint8)).view(np.int64) == anchor)
    windows = len(content) - LENGTH + 1
    out: dict[tuple[bytes, bytes], list[int]] = {}
    before = -1
    for p in spots.tolist():
        # Windows whose first anchor string is this one, from the last to the first.
        low, high = max(before + 1, p - (LENGTH - GRAM), 0), min(p, windows - 1)
        before = p
        while high >= low:
            j = (p - high) // width
            x = max(low, p - width * (j + 1) + 1)
            core = content[p - width * j : p - width * (j + 1) + 1 + LENGTH]
            out.setdefault((core, content[x : high + LENGTH]), []).append(x)
            high = x - 1
    return out


def _cut(level: DataFrame, width: int) -> DataFrame:
    names = [x.split()[0] for x in PIECE.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int64()), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for anchor, h1, h2, met, content in zip(*(batch.column(c).to_pylist() for c in ("anchor", "h1", "h2", "met", "bytes")), strict=True):
                rows += [(anchor, h1, h2, *_name(core), *_name(piece), starts, met, piece) for (core, piece), starts in pieces(content, anchor, width).items()]
                if len(rows) > 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return level.select("anchor", "h1", "h2", "met", "bytes").mapInArrow(run, PIECE)


def inner_spans(level: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Spans (h1, h2, first, last) of repeated windows of distinct segments (anchor, h1, h2, met, bytes)."""
    core = ["c1", "c2"]
    cut = save(_cut(level, widths[0]), "pieces")
    contents = save(cut.groupBy("anchor", *core, "p1", "p2", "bytes").agg(F.sum(F.col("met") * F.size("starts")).alias("met")), "contents")
    piece = [F.col("p1").alias("h1"), F.col("p2").alias("h2")]
    found = contents.filter("met > 1").select(*piece, F.lit(0).cast("long").alias("first"), F.length("bytes").cast("long").alias("last"))
    if widths[1:]:
        cores = save(contents.groupBy(*core).agg(F.count("*").alias("many"), F.sum(F.length("bytes")).alias("size")).filter("many > 1"), "cores")
        parts = int(level.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        size = cores.agg(F.sum("size")).first()[0] or 0
        few = contents.join(cores.filter(F.col("many") <= HOT).select(*core), core, "left_semi")
        shard = F.pmod(F.col("c1"), F.lit(max(4 * parts, size // SHARD))).alias("shard")
        found = found.unionByName(few.select(shard, "p1", "p2", "met", "bytes").groupBy("shard").applyInArrow(_shard_of_pieces, INNER))
        crowded = save(contents.join(cores.filter(F.col("many") > HOT).select(*core), core, "left_semi").select("anchor", *piece, "met", "bytes"), "crowded")
        if not crowded.isEmpty():
            found = found.unionByName(inner_spans(crowded, widths[1:]))
    spans = save(found.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), "first", "last").distinct(), "inner")
    at = cut.select("h1", "h2", "p1", "p2", F.explode("starts").alias("start")).join(spans, ["p1", "p2"])
    return at.select("h1", "h2", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))


def _hot_spans(hot: DataFrame) -> DataFrame:
    """Spans of the repeated windows of anchors with many segments."""
    distinct = save(hot.groupBy("anchor", "h1", "h2", "bytes").agg(F.sum(F.size("places")).alias("met")), "distinct")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h1, h2, x, y) for h1, h2, spans in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "spans")), strict=True) for x, y in merged(spans)]
            yield from _rows(rows, INNER).to_batches()

    spans = inner_spans(distinct).groupBy("h1", "h2").agg(F.collect_set(F.struct("first", "last")).alias("spans")).mapInArrow(join, INNER)
    place = hot.select("h1", "h2", F.explode("places").alias("place"))
    at = place.join(spans, ["h1", "h2"])
    return at.select(F.col("place.row_key").alias("row_key"), (F.col("place.first") + F.col("first")).alias("first"), (F.col("place.first") + F.col("last")).alias("last"))


def merged(spans: list[dict] | None) -> list[list[int]]:
    """Spans in order, those that meet or overlap joined."""
    out: list[list[int]] = []
    for x, y in sorted((s["first"], s["last"]) for s in spans or ()):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return out


def repeated_spans(source: DataFrame) -> DataFrame:
    """row_key, first, last: byte spans covered by repeated windows. ``source`` has row_key and text."""
    grams = save(recurring_grams(source), "grams")
    found = save(segments(source, sieve.build(grams, "gram", sieve.sized(grams.count()))), "segments")
    forget(grams)
    counts = save(found.groupBy("anchor").agg(F.count("*").alias("many"), F.sum(F.length("bytes")).alias("size")), "anchors")
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = counts.agg(F.sum("size")).first()[0] or 0
    busy = counts.filter(F.col("many") > HOT)
    hot = save(found.join(busy.select("anchor"), "anchor", "left_semi"), "hot")
    cold = found.join(busy.select("anchor"), "anchor", "left_anti")
    shard = F.pmod(F.col("anchor"), F.lit(max(4 * parts, size // SHARD)))
    plain = save(cold.select(shard.alias("shard"), "anchor", "bytes", "places").groupBy("shard").applyInArrow(_shard, SPANS), "plain")
    out = plain if hot.isEmpty() else save(plain.unionByName(_hot_spans(hot)), "spans")
    forget(found, counts, hot)
    return out
def _kept(docs: DataFrame, with_bytes: bool) -> DataFrame:
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))))
    source = ids_and_text(docs).withColumn("row_key", key)
    spans = repeated_spans(source.select("row_key", "text")).groupBy("row_key").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw, cut = (text.as_py() or "").encode(), merged(spans.as_py())
                edges = [0, *(e for m in cut for e in m), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(raw), len(raw) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept)[: 4 + with_bytes])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 4 + with_bytes]
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in schema.split(", ")])

    return source.join(spans, "row_key", "left").select("doc_id", "text", "spans").mapInArrow(run, schema)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """Counts and remaining bytes of every document."""
    return _kept(docs, True)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(table(spark, sf_dir, "documents"), False)
