"""Language-model scores: prediction by partial matching over bytes, and a word unigram base.

Training documents are those whose ``crc32(doc_id as text) % 10`` is not 0. One pass over
them gathers two kinds of counts, added up in each task before the exchange: words (hashed,
A-Z lower-cased), and byte strings of up to ``ORDER + 1`` bytes, which are the context trie.

The trie keeps every string of the training bytes and grows with them, so it stays distributed.
The score of a byte depends only on the ``ORDER + 1`` bytes that end with it: the pass also
gathers these strings of the held-out documents, with count 0, and each such string is scored
once. For that the strings of three bytes and more are sharded by the two bytes before their
last, so a shard holds all contexts of its strings but those of one byte and none, whose strings
(65,792 at most) go to every task. The commonest ``FAST`` strings go to every task with their scores;
each document's other strings are exchanged and joined with theirs.

A symbol's probability follows method C: in the longest context known, ``c / (n + d)`` for a symbol
seen c times among n, or ``d / (n + d)`` for an escape, d being the distinct symbols. After
an escape the next shorter context leaves out the symbols of the longer one; below the
empty context the remaining byte values are equally likely. Texts begin after ``ORDER`` bytes
0xFF and end with one, which no UTF-8 text holds, so the score is the probability of exactly
this text.

Word counts are an open vocabulary and stay distributed too. The ``FREQUENT`` commonest words go
to every task; only the other words of each document are exchanged and joined with their
counts, and no key among those is hot.

Defined results: a null or empty text is its end alone; a null doc_id has the text '' (held
out); repeated rows are scored alike; with no training documents every count is 0 and bytes
are equally likely; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import ids_and_text, save, table

ORDER, FAST, FREQUENT = 4, 2**20, 200_000
EDGE = 0xFF
HOLD = 4_000_000
SHARD = 500_000
COUNTS = "level int, key long, count long"
SCHEMA = "doc_id long, text_key long, level int, key long, tf long, n_tokens long, n_known long, base double, score double, rows long"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def strings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER + 1 bytes that end at each byte of each row and at its end, as one number, and their rows."""
    rows, pad = len(offsets) - 1, ORDER + 1
    out = np.full(len(data) + rows * pad, EDGE, np.uint8)
    of = np.repeat(np.arange(rows), np.diff(offsets))
    out[np.arange(len(data)) + ORDER + pad * of] = data
    key = np.zeros(len(out), np.int64)
    wide = out.astype(np.int64)
    for j in range(ORDER + 1):
        key[j:] |= wide[: len(wide) - j] << (8 * j)
    inside = np.ones(len(out), bool)
    begins = offsets[:-1] + pad * np.arange(rows)
    for j in range(ORDER):
        inside[begins + j] = False
    return key[inside], np.repeat(np.arange(rows), np.diff(offsets) + 1)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, row = tk.words(data, offsets)
    return tk.Spans(data, tk.LOWER)(starts, ends).view(np.int64), row


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, of = np.unique(keys, return_inverse=True)
    return at, np.bincount(of, counts, len(at)).astype(np.int64)


class Tally:
    """Counts by key, merged whenever enough have come together."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        at, n = np.unique(keys, return_counts=True)
        self.keys.append(at)
        self.counts.append(n)
        self.size += len(at)
        if self.size > HOLD:
            merged = self.total()
            self.keys, self.counts, self.size = [merged[0]], [merged[1]], 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        return added(np.concatenate(self.keys), np.concatenate(self.counts)) if self.keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def gather(docs: DataFrame) -> DataFrame:
    """Counts of the training documents: level 0 words, level n byte strings of length n, level -1 documents.

    The longest strings of the held-out documents are among them, with count 0 unless training documents have them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, longest, asked, documents = Tally(), Tally(), Tally(), 0
        for batch in batches:
            keep = [not held_out(i) for i in batch.column("doc_id").to_pylist()]
            documents += sum(keep)
            text = batch.column("text").filter(pa.array(keep, pa.bool_()))
            for _, _, data, offsets in tk.blocks(text):
                words.add(words_of(data, offsets)[0])
                longest.add(strings(data, offsets)[0])
            for _, _, data, offsets in tk.blocks(batch.column("text").filter(pa.array([not k for k in keep], pa.bool_()))):
                asked.add(strings(data, offsets)[0])
        parts = [(-1, np.zeros(1, np.int64), np.array([documents])), (0, *words.total())]
        keys, counts = longest.total()
        only = asked.total()[0]
        only = only[~_find(keys, only)[1]]
        parts.append((ORDER + 1, only, np.zeros(len(only), np.int64)))
        for n in range(ORDER + 1, 0, -1):
            keys, counts = added(keys & ((1 << 8 * n) - 1), counts)
            parts.append((n, keys, counts))
        for level, keys, counts in parts:
            for a in range(0, len(keys), 50_000):
                k, c = keys[a : a + 50_000], counts[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), level, np.int32)), pa.array(k), pa.array(c)], names=["level", "key", "count"])

    return ids_and_text(docs).mapInArrow(run, COUNTS).groupBy("level", "key").agg(F.sum("count").alias("count"))


@dataclass
class Level:
    """Byte strings of one length, by their contexts (all bytes but the last)."""

    keys: np.ndarray
    fresh: np.ndarray  # log10 of the symbol's probability if no longer context is known
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    below: np.ndarray  # count, in the next shorter context, of the symbols seen in this one


@dataclass
class Model:
    levels: dict[int, Level] = field(default_factory=dict)

    @classmethod
    def of(cls, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> Model:
        out = cls()
        for n in range(1, ORDER + 2):
            keys, c = counts.get(n, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            order = np.argsort(keys)
            keys, c = keys[order], c[order].astype(float)
            contexts, of = np.unique(keys >> 8, return_inverse=True)
            total, distinct = np.bincount(of, c, len(contexts)), np.bincount(of, minlength=len(contexts)).astype(float)
            below = np.zeros(len(contexts))
            if n > 1 and len(keys):
                short = out.levels[n - 1]
                below = np.bincount(of, short.counts[np.searchsorted(short.keys, keys & ((1 << 8 * (n - 1)) - 1))], len(contexts))
            out.levels[n] = Level(keys, np.log10(c / (total + distinct)[of]), c, contexts, total, distinct, below)
        return out

    def log10(self, strings: np.ndarray) -> np.ndarray:
        """log10 of the probability of each string's last byte after the bytes before it."""
        top = self.levels[ORDER + 1]
        at, hit = _find(top.keys, strings)
        out = np.where(hit, top.fresh[at] if len(top.keys) else 0.0, 0.0)
        rest = np.flatnonzero(~hit)
        skip_n, skip_d = np.zeros(len(rest)), np.zeros(len(rest))
        for n in range(ORDER + 1, 0, -1):
            if not len(rest):
                return out
            level = self.levels[n]
            key = strings[rest] & ((1 << 8 * n) - 1)
            c, known = _find(level.contexts, key >> 8)
            if not len(level.contexts):
                continue
            total, distinct = np.where(known, level.total[c] - skip_n, 0), np.where(known, level.distinct[c] - skip_d, 0)
            g, hit = _find(level.keys, key)
            room = np.maximum(total + distinct, 1e-300)
            out[rest[hit]] += np.log10(level.counts[g[hit]] / room[hit])
            away = known & ~hit & (distinct > 0)
            out[rest[away]] += np.log10(distinct[away] / room[away])
            skip_n, skip_d = np.where(known, level.below[c], 0)[~hit], np.where(known, level.distinct[c], 0)[~hit]
            rest = rest[~hit]
        out[rest] -= np.log10(256 - np.where(skip_d > 0, skip_d, 0)) if len(rest) else 0
        return out


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _arrays(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = rows.select("key", "count").toArrow()
    keys, counts = got["key"].to_numpy(), got["count"].to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def trained(counts: DataFrame) -> Model:
    """The model of all given strings, on the driver."""
    kept = counts.filter("level > 0 AND count > 0").toArrow()
    level, key, count = (kept[c].to_numpy() for c in ("level", "key", "count"))
    return Model.of({n: (key[level == n], count[level == n]) for n in range(1, ORDER + 2)})


def valued(counts: DataFrame) -> DataFrame:
    """key, count and log10 of the probability (``value``) of each longest string of any document."""
    spark = counts.sparkSession
    short = trained(counts.filter("level IN (1, 2)"))
    sent = spark.sparkContext.broadcast({n: (short.levels[n].keys, short.levels[n].counts) for n in (1, 2)})
    long = counts.filter("level > 2")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), long.count() // SHARD + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(c).to_numpy() for c in ("level", "key", "count")] for b in batches]
        if not got:
            return
        level, key, count = (np.concatenate(x) for x in zip(*got, strict=True))
        seen = count > 0
        model = Model.of({**sent.value, **{n: (key[seen & (level == n)], count[seen & (level == n)]) for n in range(3, ORDER + 2)}})
        key, count = key[level == ORDER + 1], count[level == ORDER + 1]
        for a in range(0, len(key), 50_000):
            k = key[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(count[a : a + 50_000]), pa.array(model.log10(k))], names=["key", "count", "value"])

    before = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF))
    return long.repartition(shards, before).mapInArrow(run, "key long, count long, value double")


def commonest(values: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of the commonest strings, FAST at most: whole classes of counts, the highest first."""
    band = F.floor(F.log2(F.col("count") + 1) * 8)
    bar, size = None, 0
    for r in sorted(values.groupBy(band.alias("band")).count().collect(), reverse=True):
        size += r["count"]
        if size > FAST:
            break
        bar = r.band
    got = values.filter(F.lit(False) if bar is None else band >= bar).select("key", "value").toArrow()
    keys, value = got["key"].to_numpy(), got["value"].to_numpy()
    order = np.argsort(keys)
    return keys[order], value[order]


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    counts = save(gather(docs), "counts")
    ends, seen, many = counts.agg(F.sum(F.when(F.col("level") == -1, F.col("count"))), F.sum(F.when(F.col("level") == 0, F.col("count"))), F.count(F.when(F.col("level") == 0, 1))).first()
    ends, tokens = ends or 0, (ends or 0) + (seen or 0)
    distinct = many + (ends > 0)
    unit = float(np.log10(tokens + 0.1 * (distinct + 1)))
    vocabulary = counts.filter("level = 0").select("key", "count")
    values = save(valued(counts), "values")
    sent = spark.sparkContext.broadcast((*commonest(values), *_arrays(vocabulary.orderBy(F.desc("count"), "key").limit(FREQUENT))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast, value, common, often = sent.value
        worth = np.log10(often + 0.1)
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, data, offsets in tk.blocks(batch.column("text")):
                n = b - a
                spans = tk.Spans(data)(offsets[:-1], offsets[1:]).view(np.int64)
                grams, gram_row = strings(data, offsets)
                at, known = _find(fast, grams)
                score = np.bincount(gram_row[known], value[at[known]] if len(value) else [], n).astype(float)
                missed = grams[~known], gram_row[~known]
                word, row = words_of(data, offsets)
                at, known = _find(common, word)
                base = np.bincount(row[known], worth[at[known]] if len(worth) else [], n) + np.log10(ends + 0.1)
                summary = [ids[a:b], spans, np.zeros(n, np.int32), tk.mix(spans.view(np.uint64)).view(np.int64), np.zeros(n, np.int64), np.bincount(row, minlength=n) + 1, np.bincount(row[known], minlength=n) + (ends > 0), base, score, np.ones(n, np.int64)]
                rest = []
                for level, (rare, of) in ((0, (word[~known], row[~known])), (ORDER + 1, missed)):
                    order = np.lexsort((rare, of))
                    rare, of = rare[order], of[order]
                    first = np.ones(len(rare), bool)
                    first[1:] = (rare[1:] != rare[:-1]) | (of[1:] != of[:-1])
                    begin = np.flatnonzero(first)
                    m = len(begin)
                    rest.append([ids[a:b].take(pa.array(of[begin])), spans[of[begin]], np.full(m, level, np.int32), rare[begin], np.diff(np.append(begin, len(rare))), *[np.zeros(m, np.int64)] * 2, *[np.zeros(m)] * 2, np.zeros(m, np.int64)])
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                for part in (summary, *rest):
                    yield pa.RecordBatch.from_arrays([part[0], *(pa.array(x) for x in part[1:])], names=names)

    rows = ids_and_text(docs).mapInArrow(run, SCHEMA)
    word, tf, c = F.col("level") == 0, F.col("tf"), F.coalesce(F.col("count"), F.lit(0))
    found = vocabulary.select(F.lit(0).alias("level"), "key", "count", F.lit(0.0).alias("value")).unionByName(values.select(F.lit(ORDER + 1).alias("level"), "key", "count", "value"))
    joined = rows.join(found, ["level", "key"], "left").select(
        "doc_id", "text_key", "n_tokens", (F.col("n_known") + F.when(word & (c > 0), tf).otherwise(0)).alias("n_known"),
        (F.col("base") + F.when(word, tf * F.log10(c + F.lit(0.1))).otherwise(0.0)).alias("base"), (F.col("score") + F.when(word, 0.0).otherwise(tf * F.col("value"))).alias("score"), "rows",
    )
    summed = joined.groupBy("doc_id", "text_key").agg(*(F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "score", "rows")))
    out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0
    one = lambda x: F.col(x) / F.col("rows")  # noqa: E731  equal rows were added up
    return summed.select(
        "doc_id", out.alias("held_out"), one("n_tokens").cast("long").alias("n_tokens"), one("n_known").cast("long").alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (one("base") - one("n_tokens") * F.lit(unit)).alias("base_score"), one("score").alias("score"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy"),
    ).drop("copy")


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
