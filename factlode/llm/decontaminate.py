"""Benchmark decontamination: pigeonhole pieces, exact hits, Myers verification.

A test item of n characters may differ from a passage by ``budget(n)`` edits. Split into
``budget + 1`` pieces, at least one piece stands unchanged in any such passage. An automaton
finds every piece in every text; around each hit the item is aligned with Myers' bit-parallel
algorithm, whose bit vectors are Python integers as long as the item.

Texts and items are compared lower-cased, with each run of white space as one space.

The items are a stated query set. They go to the tasks in blocks of at most ``BLOCK_BYTES``;
a longer benchmark means more blocks, and one pass over the documents for each.

Items under ``LEAST`` characters have a budget of 0 or 1, and their pieces are met by chance inside
words; so every passage around a hit is compared, and only those count that neither begin nor end
within a word. Scripts without spaces have no word ends, and any place will do there.

Defined results: null or empty texts and items match nothing; items with a null item_id are numbered
in the order of their texts, downwards from -1 or from below the least id if that is negative;
repeated items and repeated rows are each matched (rows alike); an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ERROR_RATE, LEAST = 0.08, 24
BLOCK_BYTES = 8 << 20
#: Thai, Lao, Tibetan, Myanmar, Khmer; kana, Bopomofo and Han with their extensions.
UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U0001b000-\U0001b16f\U00020000-\U0003ffff]")
SCHEMA = "doc_id long, item_id long, distance long, start long, stop long"


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(n: int, rate: float = ERROR_RATE) -> int:
    return int(n * rate)


def pieces(item: str, parts: int) -> list[tuple[int, str]]:
    """(offset, piece) of an item cut in ``parts`` of nearly equal length."""
    ends = [len(item) * k // parts for k in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def myers(item: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the passage of ``text`` nearest to ``item``, the first of equals; None beyond ``most``."""
    m = len(item)
    masks: dict[str, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    full, high = (1 << m) - 1, 1 << m - 1
    plus, minus, score, best = full, 0, m, (m, 0)
    for end, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        x = eq | minus
        d = (((x & plus) + plus) ^ plus) | x
        hp, hm = (minus | ~(d | plus)) & full, plus & d
        if hp & high:
            score += 1
        elif hm & high:
            score -= 1
        # A passage may begin anywhere, so row 0 stays 0.
        hp, hm = hp << 1 & full, hm << 1 & full
        plus, minus = (hm | ~(d | hp)) & full, hp & d
        if score < best[0]:
            best = (score, end)
    return best if best[0] <= most else None


def within_word(text: str, at: int) -> bool:
    """Whether a word goes on across place ``at``."""
    if not 0 < at < len(text):
        return False
    return all(c.isalnum() and not UNSPACED.match(c) for c in text[at - 1 : at + 1])


def differ(a: str, b: str) -> int:
    """The edits between two texts if at most one, else 2."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1:
        return 2
    least = min(len(a), len(b))
    k = next((k for k in range(least) if a[k] != b[k]), least)
    return 1 if a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :] else 2


class Matcher:
    """The items of one block."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, budget(len(t), rate)) for i, t in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, most) in enumerate(self.items):
            for at, piece in pieces(text, most + 1):
                where.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best passage for each item within its budget."""
        if not self.items or not text:
            return []
        spots: dict[int, list[tuple[int, int]]] = {}
        short: dict[int, tuple[int, int, int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for k, at in places:
                _, item, most = self.items[k]
                begin = end + 1 - size - at
                if len(item) < LEAST and most < 2:
                    if (best := self.nearest(text, item, begin, most)) and best < short.get(k, (most + 1,)):
                        short[k] = best
                    continue
                a, b = max(0, begin - most), begin + len(item) + most
                seen = spots.setdefault(k, [])
                if seen and a <= seen[-1][1]:  # hits come in order, so spans that meet are joined
                    seen[-1] = (min(seen[-1][0], a), max(seen[-1][1], b))
                else:
                    seen.append((a, b))
        out = []
        for k, spans in sorted(spots.items()):
            i, item, most = self.items[k]
            found = [(d, a, a + end) for a, b in spans if (got := myers(item, text[a:b], most)) for d, end in [got]]
            if found:
                d, a, end = min(found, key=lambda f: (f[0], f[2]))
                back = myers(item[::-1], text[a:end][::-1], d)
                out.append((i, d, end - back[1], end))
        out += [(self.items[k][0], d, -a, end) for k, (d, end, a) in sorted(short.items())]
        return out

    @staticmethod
    def nearest(text: str, item: str, begin: int, most: int) -> tuple[int, int, int] | None:
        """(distance, end, -start) of the best passage of whole words about ``begin``."""
        found = []
        for a in range(max(0, begin - most), begin + most + 1):
            if within_word(text, a):
                continue
            for end in range(a + len(item) - most, min(len(text), a + len(item) + most) + 1):
                if (d := differ(item, text[a:end])) <= most and not within_word(text, end):
                    found.append((d, end, -a))
        return min(found, default=None)


def blocks_of(items: DataFrame, size: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Items as (id, plain text) in blocks; one block at a time is on the driver."""
    rows = items.select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").toLocalIterator()
    least = items.agg(F.min(F.col("item_id").cast("long"))).first()[0]
    unnamed = min(0, 0 if least is None else least)
    block, held = [], 0
    for i, text in rows:
        if not (p := plain(text)):
            continue
        if i is None:
            i = unnamed = unnamed - 1
        if block and held + len(p.encode()) > size:
            yield block
            block, held = [], 0
        block.append((i, p))
        held += len(p.encode())
    yield block


def contaminated(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """One row for each document and item that it holds: the nearest passage, its distance and place in the plain text."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in blocks_of(items):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        part = source.mapInArrow(_searcher(sent, rate), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def _searcher(sent, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(sent.value, rate)
        for batch in batches:
            rows = [(i.as_py(), *hit) for i, t in zip(batch.column("doc_id"), batch.column("text"), strict=True) for hit in match(plain(t.as_py()))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def clean(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    at = docs.columns.index("text")
    for block in blocks_of(items):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            match = Matcher(sent.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([not match(plain(t.as_py())) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go."""
    return clean(docs, table(spark, sf_dir, "benchmark"))
