"""A content-addressed store of token ids.

Each document's id stream is cut where a rolling hash of its last ``WINDOW`` ids says so, so
equal passages are cut alike wherever they stand. A chunk is named by the digest of its
content and stored once; a document is a recipe, the list of its chunks' names, and the
Merkle root over that list. Reading verifies every chunk against its name and every
recipe against its root.

Files, below one folder:

* ``pool/kind=chunk``: key, n (ids), body (ids as little-endian unsigned 16-bit integers, or
  32-bit where an id needs it);
* ``recipes``: doc_id, start, n_tokens, recipe (chunk names end to end), sizes, root, in
  ascending doc_id order from file to file;
* ``manifest``: one row for each partition of recipes: its start, counts, and the Merkle root
  over its recipes' roots, which ``verify_manifest`` computes anew.

One exchange moves the chunks: a task names each of its chunks and emits the content only
the first time it meets a name, so a text that makes up a third of the corpus moves once
for each task, and the exchange by name leaves one copy in all. Recipes travel in the same
exchange, dealt evenly.

Defined results: a null or empty text is the end id alone; repeated rows, and rows that
share a doc_id, each have a place of their own, ordered by (doc_id, root), a null doc_id
first; an empty table gives an empty store; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import ids_and_text, shared_dir, table

END_ID = 0
WINDOW, CUT_BITS, LEAST, MOST = 16, 10, 256, 8192
KEY = 16
CACHE = 300_000
#: Bytes of text encoded at a time.
PART = 4 << 20
POOL = "kind string, key binary, doc_id long, n long, body binary, sizes binary"
RECIPES = "doc_id long, n_tokens long, recipe binary, sizes binary, root binary, part int, start_in_part long, upto binary"
MANIFEST = "part int, part_start long, n_tokens long, n_docs long, root binary"
#: White space next to white space, or white space other than a space or a newline.
ODD = re.compile(r"\s\s|[^\S \n]|[\x1c-\x1f\x85᠎​﻿]")
#: Bytes that part pieces, and bytes that ODD's other characters hold.
SEPARATOR = np.isin(np.arange(256), [0x20, 0x0A])
MARK = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))
LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
DOUBT = np.isin(np.arange(256), [0x09, *range(0x0B, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0xE1, 0xE2, 0xE3, 0xEF])
_GEAR = np.random.default_rng(20240917).integers(0, 1 << 32, 1 << 16, dtype=np.uint32)


class Encoder:
    """The tokenizers library, asked once for each piece of text that recurs.

    The file's byte-level rule never joins across a space or newline that stands alone
    between other characters; there a text is cut, each piece with the separator before it. A
    block's pieces are told apart by Arrow, so Python sees each different one once. Texts with
    other white space are encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u4" if size > 1 << 16 else "<u2")
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        # Tokens that begin with a space, and the newline: the first of each piece.
        self.opens = {b" ": np.zeros(size, bool), b"\n": np.zeros(size, bool)}
        for token, k in self.tokenizer.get_vocab().items():
            self.opens[b" "][k] = token.startswith("\u0120")
        self.opens[b"\n"][np.frombuffer(self._ids([b"\n"])[0], self.kind)] = True

    def _encoded(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        return [x.tobytes() for x in self._encoded(texts)]

    def _learn(self, pieces: list[bytes]) -> None:
        """Pieces with the same separator are encoded end to end and parted where tokens begin with it."""
        new = []
        for p in pieces:
            if (ids := self.older.get(p)) is not None:
                self.known[p] = ids
            else:
                new.append(p)
        for mark, opens in self.opens.items():
            some = [p for p in new if p[:1] == mark]
            for a in range(0, len(some), 2048):
                part = some[a : a + 2048]
                ids = self._encoded([b"".join(part)])[0]
                at = np.flatnonzero(opens[ids])
                if len(at) == len(part):
                    raw, edges = ids.tobytes(), [*(at * self.kind.itemsize).tolist(), len(ids) * self.kind.itemsize]
                    self.known.update(zip(part, [raw[x:y] for x, y in zip(edges, edges[1:], strict=False)], strict=True))
                else:
                    self.known.update(zip(part, self._ids(part), strict=True))
        rest = [p for p in new if p[:1] not in self.opens]
        self.known.update(zip(rest, self._ids(rest), strict=True))

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the pieces (of odd rows, the row), first piece of each row, and which rows are odd."""
        rows = len(offsets) - 1
        mark = SEPARATOR[data]
        doubled = np.flatnonzero(mark[1:] & mark[:-1])
        row = np.searchsorted(offsets, doubled, side="right") - 1
        odd = np.zeros(rows, bool)
        odd[row[doubled + 1 < offsets[row + 1]]] = True
        doubt = np.zeros(rows, bool)
        doubt[np.searchsorted(offsets, np.flatnonzero(DOUBT[data]), side="right") - 1] = True
        for k in np.flatnonzero(doubt & ~odd):
            odd[k] = bool(ODD.search(data[offsets[k] : offsets[k + 1]].tobytes().decode()))
        at = np.flatnonzero(mark)
        at = at[~odd[np.searchsorted(offsets, at, side="right") - 1]]
        # A mark between a letter and a separator is a piece too.
        dots = np.flatnonzero(MARK[data[1:-1]] & LETTER[data[:-2]] & mark[2:]) + 1
        row = np.searchsorted(offsets, dots, side="right") - 1
        dots = dots[~odd[row] & (dots > offsets[row]) & (dots + 1 < offsets[row + 1])]
        # A row's first piece begins with the row, even if empty.
        key = np.sort(np.concatenate([2 * offsets[:-1], 2 * at + 1, 2 * dots + 1]))
        return key >> 1, np.flatnonzero(key & 1 == 0), odd

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text (null: empty) and the end id."""
        out: list[np.ndarray] = []
        for _, _, data, offsets in tk.blocks(column, PART):
            if len(self.known) > CACHE:
                # What is asked for again comes back from the older half; the rest goes with it.
                self.older, self.known = self.known, {}
            starts, first, odd = self._pieces(data, offsets)
            edges = np.append(starts, len(data)).astype(np.int64)
            pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
            words = pieces.dictionary.to_pylist()
            whole = set(np.unique(pieces.indices.to_numpy()[first[odd]]).tolist())
            self._learn([w for k, w in enumerate(words) if w not in self.known and k not in whole])
            ids = [self.known.get(w, b"") for w in words]
            for k, x in zip(whole, self._ids([words[k] for k in whole]), strict=True):
                ids[k] = x
            ids.append(np.array([END_ID], self.kind).tobytes())
            # Pieces in order, with the end id after each row's last.
            order = np.insert(pieces.indices.to_numpy().astype(np.int64), np.append(first[1:], len(starts)), len(words))
            size = np.array([len(x) for x in ids]) // self.kind.itemsize
            pool, begin, many = np.frombuffer(b"".join(ids), self.kind), np.cumsum(size) - size, size[order]
            ends = np.cumsum(many)
            stream = pool[np.repeat(begin[order] - ends + many, many) + np.arange(int(ends[-1]))]
            out += np.split(stream, ends[order == len(words)][:-1])
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(streams: list[np.ndarray]) -> list[list[int]]:
    """Ends of the chunks of each id stream.

    The streams are hashed end to end: the first ``WINDOW`` ids of a stream, which see ids of
    the one before, lie below ``LEAST`` and never end a chunk."""
    if not streams:
        return []
    gear = _GEAR[np.concatenate(streams) & 0xFFFF]
    h = np.zeros(len(gear), np.uint32)
    for j in range(WINDOW):
        h[j:] += gear[: len(gear) - j] << np.uint32(j)
    marks = np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1
    starts = np.cumsum([0, *map(len, streams)])
    at = np.searchsorted(marks, starts, side="right")
    return [_ends(len(s), (marks[a:b] - start).tolist()) for s, start, a, b in zip(streams, starts, at, at[1:], strict=False)]


def _ends(n: int, marks: list[int]) -> list[int]:
    ends, last = [], 0
    for e in marks:
        while e - last > MOST:
            last += MOST
            ends.append(last)
        if e - last >= LEAST:
            ends.append(last := e)
    while n - last > MOST:
        ends.append(last := last + MOST)
    if last < n:
        ends.append(n)
    return ends


def name(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=KEY).digest()


def merkle(keys: list[bytes]) -> bytes:
    """Root over a list of names: pairs are hashed level by level, an odd last one moves up."""
    level = keys or [b""]
    while len(level) > 1:
        level = [name(b"".join(level[k : k + 2])) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return name(level[0])


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "key", "doc_id", "n", "body", "sizes"])


def pool(docs: DataFrame, path: str) -> DataFrame:
    """Recipe rows and chunk rows of all documents; a chunk once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, met = encoder(path), set()
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, *_ in tk.blocks(batch.column("text"), PART):
                rows = []
                streams = use(batch.column("text").slice(a, b - a))
                for k, (stream, ends) in enumerate(zip(streams, cuts(streams), strict=True)):
                    keys, sizes, last = [], [], 0
                    for end in ends:
                        body = stream[last:end].tobytes()
                        keys.append(key := name(body))
                        sizes.append(end - last)
                        last = end
                        if key not in met:
                            met.add(key)
                            rows.append(("chunk", key, None, sizes[-1], body, None))
                    rows.append(("recipe", merkle(keys), ids[a + k].as_py(), len(stream), b"".join(keys), np.array(sizes, "<u4").tobytes()))
                yield _records(rows)

    return ids_and_text(docs).mapInArrow(run, POOL)


def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition that holds all rows of its chunks' names, the first of each."""
    met: set[bytes] = set()
    for batch in batches:
        keep = []
        for kind, key in zip(batch.column("kind").to_pylist(), batch.column("key").to_pylist(), strict=True):
            keep.append(kind == "recipe" or key not in met)
            if kind == "chunk":
                met.add(key)
        yield batch.filter(pa.array(keep, pa.bool_()))


def write_store(docs: DataFrame, path: str, to: str) -> None:
    """Encode ``docs`` and write chunks, recipes in doc_id order, and the manifest below ``to``."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pool(docs, path).withColumn("deal", F.when(F.col("kind") == "chunk", F.xxhash64("key")).otherwise(F.xxhash64("doc_id", "key")))
    dealt.repartition(parts, "deal").drop("deal").mapInArrow(once, POOL).write.partitionBy("kind").option("compression", "zstd").parquet(f"{to}/pool")
    recipes = _pool_part(spark, to, "recipe").select("doc_id", F.col("n").alias("n_tokens"), F.col("body").alias("recipe"), "sizes", F.col("key").alias("root"))
    ordered = recipes.repartitionByRange(parts, "doc_id", "root").sortWithinPartitions("doc_id", "root").withColumn("part", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, tree = 0, Growing()
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            ends = before + np.cumsum(n)
            before = int(ends[-1]) if len(ends) else before
            for root in batch.column("root").to_pylist():
                tree.add(root)
            upto = [None] * (len(n) - 1) + [tree.root()] * bool(len(n))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - n), pa.array(upto, pa.binary())], names=[*batch.schema.names, "start_in_part", "upto"])

    ordered.mapInArrow(number, RECIPES).write.option("compression", "zstd").parquet(f"{to}/recipes")
    # One row for each partition comes to the driver.
    totals = _parts(spark, to).orderBy("part").collect()
    before, rows = 0, []
    for part, n, many, root in totals:
        rows.append((part, before, n, many, root))
        before += n
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{to}/manifest")


class Growing:
    """A Merkle tree that grows by one leaf at a time and holds one root for each full subtree."""

    def __init__(self):
        self.full: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        height = 0
        while self.full and self.full[-1][0] == height:
            leaf, height = name(self.full.pop()[1] + leaf), height + 1
        self.full.append((height, leaf))

    def root(self) -> bytes:
        out = b""
        for _, x in reversed(self.full):
            out = name(x + out)
        return out


def _parts(spark: SparkSession, at: str) -> DataFrame:
    """part, ids, recipes and root of each recipe partition, as written."""
    ordered = spark.read.schema(RECIPES).parquet(f"{at}/recipes")
    return ordered.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"), F.max_by("upto", F.when(F.col("upto").isNotNull(), F.col("start_in_part"))).alias("root"))


def verify_manifest(spark: SparkSession, at: str) -> DataFrame:
    """The partitions whose recipes do not add up to the manifest's root and counts: none, if all is well."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, Growing] = {}
        ids: dict[int, int] = {}
        for batch in batches:
            for part, n, root in zip(*(batch.column(c).to_pylist() for c in ("part", "n_tokens", "root")), strict=True):
                trees.setdefault(part, Growing()).add(root)
                ids[part] = ids.get(part, 0) + n
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(trees), pa.int32()), "n": pa.array(list(ids.values()), pa.int64()), "again": pa.array([t.root() for t in trees.values()], pa.binary())})

    rows = spark.read.schema(RECIPES).parquet(f"{at}/recipes").select("part", "n_tokens", "root", "start_in_part")
    found = rows.repartition("part").sortWithinPartitions("part", "start_in_part", "root").select("part", "n_tokens", "root").mapInArrow(again, "part int, n long, again binary")
    listed = spark.read.schema(MANIFEST).parquet(f"{at}/manifest")
    return listed.join(found, "part", "full").filter(~(F.col("n").eqNullSafe(F.col("n_tokens")) & F.col("again").eqNullSafe(F.col("root")))).select("part")


def _pool_part(spark: SparkSession, at: str, kind: str) -> DataFrame:
    """Rows of one kind: only its folder is read, which an empty store does not have."""
    return spark.read.schema(POOL).parquet(f"{at}/pool").filter(F.col("kind") == kind).drop("kind")


def read_recipes(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, recipe, sizes, root of every document, from the files."""
    parts = spark.read.schema(MANIFEST).parquet(f"{at}/manifest").select("part", "part_start")
    rows = spark.read.schema(RECIPES).parquet(f"{at}/recipes").join(F.broadcast(parts), "part")
    return rows.select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "recipe", "sizes", "root")


def read_chunks(spark: SparkSession, at: str) -> DataFrame:
    """key, n and body of every chunk; fails where a chunk's content is not what its name says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, body in zip(batch.column("key").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if name(body) != key:
                    raise ValueError(f"chunk {key.hex()} does not hold its content")
            yield batch

    return _pool_part(spark, at, "chunk").select("key", "n", "body").mapInArrow(run, "key binary, n long, body binary")


# crc32 of a concatenation: each part's crc is multiplied by x to the bits that follow, and
# all are added, in the field of polynomials over GF(2) modulo the crc's polynomial.
_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b, out = a.copy(), b.copy(), np.zeros(np.broadcast(a, b).shape, np.uint32)
    for bit in range(32):
        out ^= np.where((a >> np.uint32(31 - bit)) & np.uint32(1), b, np.uint32(0)).astype(np.uint32)
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ _POLY, b >> np.uint32(1)).astype(np.uint32)
    return out


def crc_shift(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What a part with this crc32 adds to the crc32 of a text in which ``after`` bytes follow it."""
    out, step = crc.astype(np.uint32), np.array([1 << 23], np.uint32)  # x to the power 8
    after = after.astype(np.int64).copy()
    while after.any():
        out = np.where(after & 1, _times(out, step), out).astype(np.uint32)
        step = _times(step, step)
        after >>= 1
    return out


def checksums(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of the ids of every document, from the files.

    A chunk's crc32 is taken once and shifted to each place it stands in; ids do not move.
    Equal recipes are followed once."""

    def crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, out = batch.column("n").to_pylist(), []
            for count, body in zip(n, batch.column("body").to_pylist(), strict=True):
                ids = np.frombuffer(body, "<u2" if len(body) == 2 * count else "<u4")
                out.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.int64())], names=["key", "crc"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots, keys, after = [], [], []
            for root, recipe, sizes in zip(*(batch.column(c).to_pylist() for c in ("root", "recipe", "sizes")), strict=True):
                names = [recipe[k : k + KEY] for k in range(0, len(recipe), KEY)]
                if merkle(names) != root:
                    raise ValueError(f"recipe {root.hex()} does not match its root")
                n = np.frombuffer(sizes, "<u4").astype(np.int64)
                roots += [root] * len(names)
                keys += names
                after += (4 * (n.sum() - np.cumsum(n))).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(roots, pa.binary()), pa.array(keys, pa.binary()), pa.array(after, pa.int64())], names=["root", "key", "after"])

    @F.pandas_udf("long")
    def shifted(crc: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series(crc_shift(crc.to_numpy(), after.to_numpy()).astype(np.int64))

    from .common import save

    recipes = read_recipes(spark, at)
    # A hot text's recipe is one row here, and its chunks' places are too; a chunk that many texts
    # share is a key with many rows, which the join splits since both its sides are exchanges.
    distinct = recipes.groupBy("root").agg(F.first("recipe").alias("recipe"), F.first("sizes").alias("sizes"))
    chunk = read_chunks(spark, at).mapInArrow(crcs, "key binary, crc long")
    placed = distinct.mapInArrow(places, "root binary, key binary, after long").join(chunk, "key")
    crc = save(placed.select("root", shifted("crc", "after").alias("part")).groupBy("root").agg(F.bit_xor("part").alias("ids_crc32")), "crc")
    return recipes.select("doc_id", "start", "n_tokens", "root").join(crc, "root").select("doc_id", "start", "n_tokens", "ids_crc32", F.lower(F.hex("root")).alias("root"))


def restore(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start and ids of every document: the store read back whole."""
    recipes = read_recipes(spark, at)
    cut = recipes.select("doc_id", "start", F.posexplode(F.transform(F.sequence(F.lit(0), (F.length("recipe") / KEY).cast("int") - 1), lambda k: F.substring(F.hex("recipe"), k * 2 * KEY + 1, F.lit(2 * KEY)))).alias("pos", "name"))
    body = read_chunks(spark, at).select(F.hex("key").alias("name"), "n", "body")
    whole = cut.join(body, "name").groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "body"))).alias("parts"))

    @F.pandas_udf("array<long>")
    def join(parts: pd.Series) -> pd.Series:
        return parts.map(lambda rows: np.concatenate([np.frombuffer(r["body"], "<u2" if len(r["body"]) == 2 * r["n"] else "<u4") for r in rows]).astype(np.int64))

    return whole.select("doc_id", "start", join("parts").alias("ids"))


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_store(table(spark, sf_dir, "documents"), byte_vocabulary(), to)
    if wrong := verify_manifest(spark, to).collect():
        raise ValueError(f"recipes of parts {[r.part for r in wrong]} do not match the manifest")
    return checksums(spark, to)
