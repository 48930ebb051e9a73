"""Repeated passages of words, found with sharded Aho-Corasick automata.

A window is ``WINDOW`` consecutive words. Its anchor is the least hash of the ``GRAM``-word
strings in it, so equal windows have equal anchors wherever they stand.

1. *Anchors.* Each document emits its anchors; those of two or more documents recur. Only
   these can belong to recurring windows. They go to every task as Bloom filter of bounded size.
2. *Segments.* Each run of windows with one recurring anchor is emitted with its words, dealt
   by anchor, so that all occurrences of a window meet.
3. *Confirmation.* In each shard, windows that stand in two or more documents are confirmed,
   each with the least doc_id that holds it.
4. *Automata.* Each shard compiles its confirmed windows and streams its segments through the
   automaton, which locates every occurrence. Those of a larger doc_id are removed.

An anchor of more than ``HOT`` occurrences is dealt over ``SALTS`` shards: its windows are
confirmed by a grouping with partial minima, and the few confirmed ones go to all its shards.
A second Bloom filter tells such anchors; a false positive only takes the longer way.

Defined results: a null or empty text has no words; texts under ``WINDOW`` words lose nothing;
a row without doc_id neither loses words nor counts as an earlier document; rows with an equal
doc_id do not count against each other; repeated rows get equal results; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sieve
from . import textkit as tk
from .common import ids_and_text, save, table

WINDOW, GRAM = 13, 5
#: An anchor with so many occurrences still fits a shard: some 2 MB of segments.
HOT, SALTS, SHARD = 20_000, 64, 4000
SEGMENT = "shard long, salt int, hot boolean, anchor long, doc_id long, text_key long, first long, words string"
REMOVED = "doc_id long, text_key long, first long, last long"


def anchor_runs(data: np.ndarray, offsets: np.ndarray):
    """Words, and the runs of windows with one anchor: (starts, ends, row of each word), first window, window count, anchor."""
    starts, ends, row = tk.words(data, offsets)
    grams, _ = tk.windows(tk.RoughSpans(data)(starts, ends), row, GRAM)
    n = len(starts) - WINDOW + 1
    if n <= 0:
        return (starts, ends, row), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = grams[:n].copy()
    for j in range(1, WINDOW - GRAM + 1):
        np.minimum(least, grams[j : j + n], out=least)
    at = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
    least = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    return (starts, ends, row), at[begin], np.diff(np.append(begin, len(at))), least[begin]


def recurring_anchors(docs: DataFrame) -> DataFrame:
    """(anchor, many): anchors that stand in two or more documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for a, _, data, offsets in tk.blocks(batch.column("text")):
                (_, _, row), first, _, anchor = anchor_runs(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(ids[a + row[first]])], names=["anchor", "doc_id"])

    met = docs.mapInArrow(run, "anchor long, doc_id long").groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("many"))
    return met.filter("lo < hi").select("anchor", "many")


def segments(docs: DataFrame, recur: np.ndarray, hot: np.ndarray, shards: int) -> DataFrame:
    """The runs of windows whose anchor may recur, with their words."""
    sent = docs.sparkSession.sparkContext.broadcast((recur, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recur, hot = sent.value
        names = [x.split()[0] for x in SEGMENT.split(", ")]
        for batch in batches:
            ids, keys = batch.column("doc_id").to_numpy(), batch.column("text_key").to_numpy()
            for a, _, data, offsets in tk.blocks(batch.column("text")):
                (starts, ends, row), first, many, anchor = anchor_runs(data, offsets)
                keep = sieve.holds(recur, anchor)
                first, many, anchor = first[keep], many[keep], anchor[keep]
                if not len(first):
                    continue
                of = a + row[first]
                is_hot = sieve.holds(hot, anchor)
                raw = data.tobytes()
                words = [b" ".join(raw[x:y].split()).decode() for x, y in zip(starts[first].tolist(), ends[first + many + WINDOW - 2].tolist(), strict=True)]
                begin = np.searchsorted(row, np.arange(len(offsets) - 1))
                salt = np.where(is_hot, ids[of] % SALTS, 0).astype(np.int32)
                arrays = [(anchor % np.uint64(shards)).astype(np.int64), salt, is_hot, anchor.view(np.int64), ids[of], keys[of], first - begin[row[first]]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.array(words, pa.string())], names=names)

    return docs.mapInArrow(run, SEGMENT)


def windows(text: str) -> list[str]:
    words = text.split(" ")
    return [" ".join(words[k : k + WINDOW]) for k in range(len(words) - WINDOW + 1)]


class Phrases:
    """An automaton of confirmed windows, each with the least doc_id that holds it."""

    def __init__(self, owners: dict[str, int]):
        self.automaton = ahocorasick.Automaton()
        for window, owner in owners.items():
            # Spaces on both sides, so that only whole words match.
            self.automaton.add_word(f" {window} ", (len(window) + 2, owner))
        self.any = bool(owners)
        if owners:
            self.automaton.make_automaton()

    def locate(self, text: str) -> list[tuple[int, int]]:
        """(word position, owner) of every occurrence in a text of words joined by spaces."""
        if not self.any:
            return []
        text = f" {text} "
        hits = [(end + 1 - size, owner) for end, (size, owner) in self.automaton.iter(text)]
        out, at, word = [], 0, 0
        for start, owner in sorted(hits):
            word += text.count(" ", at, start)
            at = start
            out.append((word, owner))
        return out


def _removed(phrases: Phrases, table: pa.Table) -> pa.Table:
    """Word spans of the segments' documents that an earlier document holds."""
    rows, known = [], {}
    for doc_id, key, first, text in zip(*(table[c].to_pylist() for c in ("doc_id", "text_key", "first", "words")), strict=True):
        if text not in known:
            known[text] = phrases.locate(text)
        last = None
        for k, owner in known[text]:
            if owner < doc_id:
                if last is not None and first + k <= last:
                    rows[-1][3] = first + k + WINDOW
                else:
                    rows.append([doc_id, key, first + k, first + k + WINDOW])
                last = first + k + WINDOW
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.table({n.split()[0]: pa.array(c, pa.int64()) for n, c in zip(REMOVED.split(", "), columns, strict=True)})


def _confirm(table: pa.Table) -> tuple[dict[str, int], pa.Table]:
    """Windows of two or more documents, with the least doc_id, and the rows that may hold one."""
    spans: dict[str, list] = {}
    for text, doc_id, anchor in zip(table["words"].to_pylist(), table["doc_id"].to_pylist(), table["anchor"].to_pylist(), strict=True):
        at = spans.setdefault(text, [doc_id, doc_id, anchor])
        at[0], at[1] = min(at[0], doc_id), max(at[1], doc_id)
    texts: dict[int, list[str]] = {}
    for text, (_, _, anchor) in spans.items():
        texts.setdefault(anchor, []).append(text)
    owners: dict[str, int] = {}
    live = set()
    for anchor, of in texts.items():
        before = len(owners)
        if len(of) == 1:  # equal windows have equal anchors, so no other text counts
            lo, hi, _ = spans[of[0]]
            if lo < hi:
                owners.update(dict.fromkeys(windows(of[0]), lo))
        else:
            met: dict[str, tuple[int, int]] = {}
            for text in of:
                lo, hi, _ = spans[text]
                for w in windows(text):
                    a, b = met.get(w, (lo, hi))
                    met[w] = min(a, lo), max(b, hi)
            owners.update((w, lo) for w, (lo, hi) in met.items() if lo < hi)
        if len(owners) > before:
            live.add(anchor)
    return owners, table.filter(pc.is_in(table["anchor"], pa.array(sorted(live), pa.int64())))


def removed_spans(source: DataFrame) -> DataFrame:
    """doc_id, text_key, first, last: spans of words to remove. ``source`` has doc_id, text_key and text."""
    spark = source.sparkSession
    known = source.filter("doc_id IS NOT NULL")
    anchors = save(recurring_anchors(known), "anchors")
    total = anchors.agg(F.sum("many")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(4 * parts, total // SHARD)
    busy = anchors.filter(F.col("many") > HOT)
    recur, hot = (sieve.build(x, "anchor", sieve.sized(x.count())) for x in (anchors, busy))
    found = segments(known, recur, hot, shards)

    def cold(rows: pa.Table) -> pa.Table:
        owners, rows = _confirm(rows)
        return _removed(Phrases(owners), rows)

    plain = found.filter("NOT hot").select("shard", "anchor", "doc_id", "text_key", "first", "words").groupBy("shard").applyInArrow(cold, REMOVED)
    busy = save(found.filter("hot").drop("hot"), "busy")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, w, lo, hi) for s, t, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("shard", "words", "lo", "hi")), strict=True) for w in windows(t)]
            if rows:
                s, w, lo, hi = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(w), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["shard", "window", "lo", "hi"])

    texts = busy.groupBy("shard", "words").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    confirmed = texts.mapInArrow(expand, "shard long, window string, lo long, hi long").groupBy("shard", "window").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi")
    sent_to = save(confirmed.select("shard", "window", "lo", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), "confirmed")

    def hot_ones(patterns: pa.Table, rows: pa.Table) -> pa.Table:
        owners = dict(zip(patterns["window"].to_pylist(), patterns["lo"].to_pylist(), strict=True))
        return _removed(Phrases(owners), rows)

    many = sent_to.groupBy("shard", "salt").cogroup(busy.select("shard", "salt", "doc_id", "text_key", "first", "words").groupBy("shard", "salt")).applyInArrow(hot_ones, REMOVED)
    return plain.unionByName(many)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by one space) and its digest, of every document."""
    return _kept(docs, True)


def _kept(docs: DataFrame, with_text: bool) -> DataFrame:
    source = ids_and_text(docs).withColumn("text_key", F.xxhash64("text"))
    spans = save(removed_spans(source), "spans").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                words = (text.as_py() or "").encode().split()  # bytes part at \x20 and \x09-\x0D only
                left = words
                if spans := spans.as_py():
                    keep = bytearray(b"\1" * len(words))
                    for s in spans:
                        keep[s["first"] : s["last"]] = bytes(s["last"] - s["first"])
                    left = list(compress(words, keep))
                kept = b" ".join(left)
                rows.append((len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None)[: 3 + with_text])
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()][: 3 + with_text]
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in schema.split(", ")])

    # Rows without doc_id keep all their words and stay out of the join.
    joined = source.filter("doc_id IS NOT NULL").join(spans, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans")
    rest = source.filter("doc_id IS NULL").select("doc_id", "text", F.lit(None).cast("array<struct<first:long,last:long>>").alias("spans"))
    return joined.unionByName(rest).mapInArrow(run, schema)


def op8_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(table(spark, sf_dir, "documents"), False)
