"""Quality rules: word and line rules, then a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed byte n-grams, one of trusted documents
(labelled good) and one of the raw corpus, and is divided by the document's n-grams, so
long and short documents share one fixed threshold.

Two passes over the documents and one exchange of at most ``BUCKETS`` sums per task:

1. each task adds the n-grams of its rows up in two vectors of ``BUCKETS`` counts and
   emits the buckets it met; the sums over tasks are the two multinomials;
2. the ratios, one number for each bucket, go to every task, which judges its rows.

What is sent to the tasks is bounded: ``BUCKETS`` ratios, and the ids of the trusted rows
used as labelled sample, at most ``TRUSTED_ROWS`` (those with the smallest hashed ids).
The raw multinomial always covers every document.

Defined results: a null or empty text has no words, fails the base rules and is not kept;
a text under ``NGRAM`` bytes has score 0; repeated rows are judged alike; with no
documents or no labels the ratio is 0 everywhere and only the base rules speak; further
columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import ids_and_text, let_go, table

NGRAM, BUCKETS, ALPHA = 3, 1 << 16, 0.5
#: Mean log ratio for each n-gram, in nats, from which a document is kept.
THRESHOLD = -0.03
#: Bound on the labelled rows that the trusted multinomial is fitted on.
TRUSTED_ROWS = 200_000
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, score double, kept boolean"
)


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram from each position, and whether it lies in one row."""
    n = len(data) - NGRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    v = np.zeros(n, np.uint32)
    for j in range(NGRAM):
        v |= data[j : j + n].astype(np.uint32) << np.uint32(8 * j)
    inside = np.ones(n, bool)
    for j in range(1, NGRAM):
        edge = offsets[1:] - j
        inside[edge[(edge >= 0) & (edge < n)]] = False
    return ((v * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64), inside


def ngram_sums(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """(bucket, raw, trusted): n-gram counts of all documents and of the trusted ones."""
    flagged = ids_and_text(docs).join(F.broadcast(trusted_ids.withColumn("trusted", F.lit(True))), "doc_id", "left").select("text", F.col("trusted").isNotNull().alias("trusted"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            marks = batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
            for a, b, data, offsets in tk.blocks(batch.column("text")):
                bucket, inside = _grams(data, offsets)
                raw += np.bincount(bucket[inside], minlength=BUCKETS)
                of_row = np.repeat(marks[a:b], np.diff(offsets))[: len(bucket)]
                good += np.bincount(bucket[inside & of_row], minlength=BUCKETS)
        met = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(raw[met]), pa.array(good[met])], names=["bucket", "raw", "trusted"])

    return flagged.mapInArrow(count, "bucket int, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def log_ratios(sums: DataFrame) -> np.ndarray:
    """log P(trusted) - log P(raw) of each bucket; at most ``BUCKETS`` rows come to the driver."""
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    rows = sums.toArrow()
    at = rows["bucket"].to_numpy()
    raw[at], good[at] = rows["raw"].to_numpy(), rows["trusted"].to_numpy()
    if not good.sum():
        return np.zeros(BUCKETS)
    return np.log((good + ALPHA) / (good.sum() + ALPHA * BUCKETS)) - np.log((raw + ALPHA) / (raw.sum() + ALPHA * BUCKETS))


def trusted_sample(labels: DataFrame, limit: int = TRUSTED_ROWS) -> DataFrame:
    """Ids labelled good, at most ``limit``: those with the smallest hashes."""
    good = labels.filter(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def _repeats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    rows = len(offsets) - 1
    spans = tk.Spans(data)
    starts, ends, row = tk.words(data, offsets)
    solid = tk.SOLID[data]
    out = {
        "n_words": tk.word_counts(row, rows),
        "word_chars": tk.per_row(solid & tk.LEADS[data], offsets),
        "n_symbols": tk.per_row(SYMBOLS[data], offsets),
    }
    # Lines: after each newline and at each row's start.
    begins = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    begins = begins[begins < len(data)]
    line_row = np.searchsorted(offsets, begins, side="right") - 1
    stops = np.minimum(np.append(begins[1:], len(data)), offsets[line_row + 1])
    stops = stops - (data[stops - 1] == 10)
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(solid, out=sums[1:])
    full = sums[stops] > sums[begins]
    begins, stops, line_row = begins[full], stops[full], line_row[full]
    key = tk.mix(spans(begins, stops) + tk.BYTE[0] * line_row.astype(np.uint64))
    _, first = np.unique(key, return_index=True)
    out["n_dup_lines"] = tk.word_counts(line_row, rows) - tk.word_counts(line_row[first], rows)
    window, inside = tk.windows(spans(starts, ends), row, REPEAT_WINDOW)
    at = np.flatnonzero(inside)
    key = tk.mix(window[at] + tk.BYTE[0] * row[at].astype(np.uint64))
    _, group, many = np.unique(key, return_inverse=True, return_counts=True)
    again = tk.covered(at[many[group] > 1], REPEAT_WINDOW, len(starts))
    out["n_repeat_words"] = tk.word_counts(row[again], rows)
    return out


def _verdicts(text: pa.Array, weights: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    """Counts, score and verdict of each row of a batch."""
    parts: dict[str, list[np.ndarray]] = {}
    for _, _, data, offsets in tk.blocks(text):
        got = _repeats(data, offsets)
        bucket, inside = _grams(data, offsets)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(bucket)][inside]
        n = np.bincount(row, minlength=len(offsets) - 1)
        total = np.bincount(row, weights[bucket[inside]], minlength=len(offsets) - 1)
        # Rounded, so that the order of additions never decides.
        got["score"] = np.round(np.where(n > 0, total / np.maximum(n, 1), 0.0), 9)
        got["base_failed"] = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > MAX_REPEAT_PERCENT * got["n_words"])
        got["kept"] = ~got["base_failed"] & (got["score"] >= threshold)
        for k, v in got.items():
            parts.setdefault(k, []).append(v)
    return {k: np.concatenate(v) for k, v in parts.items()}


def judge(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, score and verdict of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            if batch.num_rows:
                got = _verdicts(batch.column("text"), sent.value, threshold)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(got[k]) for k in names[1:])], names=names)

    return ids_and_text(docs).mapInArrow(run, SCHEMA)


def keep_rows(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that are kept, with all their columns, in one pass without an exchange."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_verdicts(batch.column(at), sent.value, threshold)["kept"]))

    return docs.mapInArrow(run, docs.schema)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return judge(docs, log_ratios(ngram_sums(docs, trusted_sample(labels))), threshold)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, with all their columns."""
    return keep_rows(docs, log_ratios(ngram_sums(docs, trusted_sample(table(spark, sf_dir, "labels")))))
