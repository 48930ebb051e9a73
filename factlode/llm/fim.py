"""Fill-in-the-middle: texts cut at two units and put in another order, and put back.

A unit is a run of A-Z and a-z, or any other single code point. Texts are looked at as UTF-8,
eight bytes in a word: a byte ends a unit unless it and the next are letters, or the next
continues its code point. Both tests are sums and masks over whole words, with no carry from
byte to byte. The ends are counted word by word (``bitwise_count``) and summed up over a block of
texts; the word of a wanted unit is found by searching these sums, and the byte in the word by
comparing the sums of its bytes with the rank left.

Form and places come from the sha256 of the seed and doc_id, so they are the same on every run
and machine. A text is left plain if it is empty or holds one of the marks, and in
``PLAIN`` of 100 cases; of the others ``SPM`` of 100 begin with the suffix.

Defined results: a null text is empty; a row without doc_id is dealt as if its id were an empty
string; repeated rows get equal results; long texts are blocks of their own and never cut; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textkit as tk
from .common import ids_and_text, table

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED, PLAIN, SPM = "1", 10, 20
U64 = np.uint64
ONES, TOPS = U64(0x0101010101010101), U64(0x8080808080808080)
LOW = ~TOPS


def letters(words: np.ndarray) -> np.ndarray:
    """The top bit of each byte that is A-Z or a-z."""
    low = (words & LOW) | U64(0x20) * ONES
    from_a = low + U64(0x80 - ord("a")) * ONES
    past_z = low + U64(0x80 - ord("z") - 1) * ONES
    return from_a & ~past_z & ~words & TOPS


def following(words: np.ndarray) -> np.ndarray:
    """The top bit of each byte that continues a code point (10xxxxxx)."""
    return words & ~(words << U64(1)) & TOPS


def _next(marks: np.ndarray) -> np.ndarray:
    """Each byte's mark moved to the byte before it."""
    out = marks >> U64(8)
    out[:-1] |= marks[1:] << U64(56)
    return out


def unit_ends(words: np.ndarray) -> np.ndarray:
    """The top bit of each byte that ends a unit; what follows the words is no letter."""
    of = letters(words)
    return TOPS & ~((of & _next(of)) | _next(following(words)))


def aligned(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes in words, each row from a word of its own with a zero byte after it, and the rows' first words."""
    sizes = np.diff(offsets)
    first = np.zeros(len(offsets), np.int64)
    np.cumsum(sizes // 8 + 1, out=first[1:])
    out = np.zeros(8 * first[-1], np.uint8)
    for at, a, b in zip((8 * first).tolist(), offsets.tolist(), offsets[1:].tolist(), strict=False):
        out[at : at + b - a] = data[a:b]
    return out.view("<u8").astype(U64, copy=False), first


class Units:
    """The unit ends of a block of texts: how many each row has, and where the k-th stands."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words, self.first = aligned(data, offsets)
        self.ends = unit_ends(words)
        # Of a row's last word, the bytes behind the text are none of its units.
        last = self.first[1:] - 1
        kept = np.diff(offsets) % 8
        self.ends[last] &= (U64(1) << (U64(8) * kept.astype(U64))) - U64(1)
        self.sums = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.ends), out=self.sums[1:])
        self.before = self.sums[self.first[:-1]]
        self.count = self.sums[self.first[1:]] - self.before

    def offset(self, k: np.ndarray) -> np.ndarray:
        """Bytes of the first k units of each row."""
        rank = self.before + k
        word = np.searchsorted(self.sums, rank, side="left") - 1
        word = np.where(k > 0, word, self.first[:-1])
        left = np.where(k > 0, rank - self.sums[word], 0).astype(U64)
        # Byte sums of the marks; those below the rank left are before the byte looked for.
        sums = ((self.ends[word] >> U64(7)) & ONES) * ONES
        reached = ((sums | TOPS) - left * ONES) & TOPS
        byte = 8 - np.bitwise_count(reached).astype(np.int64)
        return np.where(k > 0, 8 * (word - self.first[:-1]) + byte + 1, 0)


def draws(doc_id: int | None, seed: str = SEED) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits of a document."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[k : k + 4], "big") for k in (0, 4, 8, 12))


def arranged(text: bytes, p: int, q: int, form: str) -> bytes:
    """The text, cut at bytes p and q, in a form."""
    a, b, c = text[:p], text[p:q], text[q:]
    if form == "psm":
        return b"".join((PREFIX, a, SUFFIX, c, MIDDLE, b))
    if form == "spm":
        return b"".join((SUFFIX, c, PREFIX, a, MIDDLE, b))
    return text


def restored(output: bytes, form: str) -> bytes:
    """The text of an output. No text in a form holds a mark, and no mark can begin in a part and end in the next."""
    if form == "plain":
        return output
    inner = SUFFIX if form == "psm" else PREFIX
    at = output.index(inner, 3)
    to = output.index(MIDDLE, at + 3)
    first, second, middle = output[3:at], output[at + 3 : to], output[to + 3 :]
    return first + middle + second if form == "psm" else second + middle + first


def _forms(batches: Iterator[pa.RecordBatch], seed: str) -> Iterator[tuple[pa.Array, list[tuple]]]:
    """Ids, and (units, form, prefix and middle in code points, output), some texts at a time."""
    for batch in batches:
        ids = batch.column("doc_id")
        for a, b, data, offsets in tk.blocks(batch.column("text")):
            units = Units(data, offsets)
            drawn = np.array([draws(i, seed) for i in ids[a:b].to_pylist()], np.int64).reshape(-1, 4)
            cuts = drawn[:, :2] % (units.count[:, None] + 1)
            p, q = units.offset(cuts.min(axis=1)), units.offset(cuts.max(axis=1))
            points = np.zeros(len(data) + 1, np.int64)
            np.cumsum(tk.LEADS[data], out=points[1:])
            at = offsets[:-1]
            chars = np.stack([points[at + p] - points[at], points[at + q] - points[at + p]], axis=1).tolist()
            plain, spm = drawn[:, 2] % 100 >= 100 - PLAIN, drawn[:, 3] % 100 < SPM
            rows = []
            for k in range(b - a):
                text = data[offsets[k] : offsets[k + 1]].tobytes()
                if not text or plain[k] or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
                    rows.append((int(units.count[k]), "plain", None, None, text))
                else:
                    form = "spm" if spm[k] else "psm"
                    rows.append((int(units.count[k]), form, *chars[k], arranged(text, int(p[k]), int(q[k]), form)))
            yield ids[a:b], rows


def transform(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _forms(batches, seed):
            n, form, prefix, middle, out = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return ids_and_text(docs).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame) -> DataFrame:
    """doc_id and text of outputs (doc_id, form, output)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [restored(o.as_py().encode(), f.as_py()) for o, f in zip(batch.column("output"), batch.column("form"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "form", "output").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """What ``transform`` and ``restore`` make of every document, as digests: neither text leaves its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _forms(batches, seed):
            n, form, prefix, middle, out = zip(*rows, strict=True)
            sha = lambda texts: pa.array([hashlib.sha256(t).hexdigest() for t in texts])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), sha(out), sha(map(restored, out, form))],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
            )

    return ids_and_text(docs).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
