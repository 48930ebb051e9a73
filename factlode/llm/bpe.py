"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of a word's tree are the ranks of its adjacent symbol pairs, each leaf holding
``rank * width + position``; the root is therefore the leftmost pair of lowest rank. A
merge replaces two symbols by one, which changes three leaves, each with an update of
logarithmic cost, until no pair of the word is mergeable. Words of like length are encoded
together: every step is one array operation over all words that are still merging.

Around that, the tokenizer's own file fixes the rules: added tokens are cut out of the raw
text, the rest is NFC-normalised and lower-cased, split by the file's pattern, and mapped
to byte symbols with a word-end mark. White space is dropped and decoding joins the tokens
with one space, as the file names no decoder.

A worker keeps two bounded caches (pieces between white space, and words). When one is full its
older half goes, but for what is asked for again, so memory does not grow with the corpus.

Defined results: a null or empty text has no tokens and empty strings; repeated rows give
equal results; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import CACHES, ids_and_text, table

#: Entries of a cache's newer half.
CACHE = 100_000
NONE = np.int64(1) << 60
#: Characters that str.split() takes as white space and Unicode does not.
SEPARATORS = regex.compile("[\x1c-\x1f]")
SPACES = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def lower(text: str) -> str:
    """Each character alone, so that no context rule (as for a final sigma) applies."""
    return text.lower() if "\u03a3" not in text else "".join([c.lower() for c in text])


class Merger:
    """Merges symbol sequences by rank, many at a time."""

    def __init__(self, pairs: list[tuple[int, int]], made: list[int]):
        keys = np.array([a << 32 | b for a, b in pairs], np.int64).reshape(-1)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = np.append(keys[order], NONE), np.append(order, 0)
        self.made = np.array(made or [0], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where it cannot merge or a side is missing (-1)."""
        key = left << 32 | right
        at = np.searchsorted(self.keys[:-1], key)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.rank[at], NONE)

    def __call__(self, symbols: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
        """The merged symbols of each word, of all words' symbols end to end and their counts."""
        out: list[list[int]] = [[]] * len(sizes)
        ends = np.cumsum(sizes)
        # The bit length of the count of pairs, one at least.
        size = np.frexp(np.maximum(sizes - 1, 1))[1]
        for bits in np.unique(size):
            at = np.flatnonzero(size == bits)
            step = max(1, (1 << 18) >> int(bits))
            for a in range(0, len(at), step):
                part = at[a : a + step]
                many = sizes[part]
                ids, met = self._merge(symbols[np.repeat(ends[part] - np.cumsum(many), many) + np.arange(many.sum())], many, 1 << int(bits))
                ids, stop = ids.tolist(), 0
                for k, n in zip(part.tolist(), met.tolist(), strict=True):
                    out[k] = ids[stop : stop + n]
                    stop += n
        return out

    def _merge(self, symbols: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """What is left of words with ``width`` pairs at most, end to end, and how much of each."""
        n, wide = len(sizes), width + 1
        grid = np.full((n, wide), -1, np.int64)
        grid[np.arange(wide) < sizes[:, None]] = symbols
        leaves = np.full((n, 2 * width), NONE, np.int64)
        rank = self.ranks(grid[:, :-1].ravel(), grid[:, 1:].ravel()).reshape(n, width)
        leaves[:, width:] = np.where(rank < NONE, rank * width + np.arange(width), NONE)
        half = width
        while half > 1:
            half //= 2
            leaves[:, half : 2 * half] = np.minimum(leaves[:, 2 * half : 4 * half : 2], leaves[:, 2 * half + 1 : 4 * half : 2])
        # From here on all words' arrays are flat: a word's row begins at ``live`` times the row's length.
        sym, tree = grid.ravel(), leaves.ravel()
        nxt = np.tile(np.arange(1, wide + 1), n)
        prv = np.tile(np.arange(-1, width), n)
        live = np.flatnonzero(leaves[:, 1] < NONE)
        while len(live):
            row, top = live * wide, live * (2 * width)
            root = tree[top + 1]
            i = root % width
            here = row + i
            j = nxt[here]
            after = nxt[row + j]
            made = self.made[root // width]
            sym[here] = made
            sym[row + j] = -1
            nxt[here] = after
            inside = after <= width
            prv[(row + after)[inside]] = i[inside]
            right = np.where(inside, sym[row + np.minimum(after, width)], -1)
            self._set(tree, top, i, self.ranks(made, right), width)
            gone = j < width
            self._set(tree, top[gone], j[gone], np.full(int(gone.sum()), NONE), width)
            before = prv[here]
            has = before >= 0
            b = before[has]
            self._set(tree, top[has], b, self.ranks(sym[row[has] + b], made[has]), width)
            live = live[tree[top + 1] < NONE]
        left = grid >= 0
        return grid[left], left.sum(axis=1)

    @staticmethod
    def _set(tree: np.ndarray, top: np.ndarray, leaf: np.ndarray, rank: np.ndarray, width: int) -> None:
        at = leaf + width
        tree[top + at] = np.where(rank < NONE, rank * width + leaf, NONE)
        for _ in range(width.bit_length() - 1):
            at = at >> 1
            below = top + 2 * at
            tree[top + at] = np.minimum(tree[below], tree[below + 1])


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merge = Merger([(vocab[a], vocab[b]) for a, b in merges], [vocab[a + b] for a, b in merges])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = {v: k for k, v in vocab.items()} | {v: k for k, v in self.added.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + self.end] for s in symbols], np.int64)
        self.digits = {k: str(k) for k in self.text}
        self.words: dict[int | str, tuple[str, str]] = {}
        self.pieces: dict[str, tuple[str, str]] = {}
        self.old_words, self.old_pieces = self.words, self.pieces

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The byte symbols of words end to end, and how many each has."""
        coded = [w.encode() for w in words]
        sizes = np.array([len(b) for b in coded], np.int64)
        data = np.frombuffer(b"".join(coded), np.uint8)
        out, ends = self.inner[data], np.cumsum(sizes) - 1
        out[ends] = self.last[data[ends]]
        return out, sizes

    def _parts(self, piece: str) -> list[int | str]:
        """Added tokens (ids) and words of a text, in order."""
        if piece.isascii() and piece[:-1].isalpha() and piece[-1] not in "'<":
            # The commonest pieces, a word and perhaps one mark, need no pattern.
            low = piece.lower()
            return [low] if piece[-1].isalpha() else [low[:-1], low[-1]]
        out: list[int | str] = []
        for k, part in enumerate(self.cut.split(piece) if self.cut and "<" in piece else [piece]):
            if k % 2:
                out.append(self.added[part])
            elif part:
                out += self.split.findall(lower(unicodedata.normalize("NFC", part)))
        return out

    def learn(self, pieces: set[str]) -> None:
        """Encode what the caches lack, all at once."""
        if len(self.pieces) > CACHE:
            self.old_pieces, self.pieces = self.pieces, {}
        if len(self.words) > CACHE:
            self.old_words, self.words = self.words, {}
        known = self.words
        new = {}
        for p in pieces.difference(self.pieces):
            if (got := self.old_pieces.get(p)) is not None:
                self.pieces[p] = got
            else:
                new[p] = self._parts(p)
        lacking = []
        for w in {w for parts in new.values() for w in parts}.difference(known):
            if (got := self.old_words.get(w)) is not None:
                known[w] = got
            else:
                lacking.append(w)
        words = [w for w in lacking if isinstance(w, str)]
        for w in lacking:
            if isinstance(w, int):
                known[w] = self.digits[w], self.decode([w])
        digits, text = self.digits.__getitem__, self.text.__getitem__
        for w, ids in zip(words, self.merge(*self._symbols(words)), strict=True):
            known[w] = " ".join(map(digits, ids)), " ".join(map(text, ids))
        for p, parts in new.items():
            if len(parts) == 1:
                self.pieces[p] = known[parts[0]]
            else:
                ids, texts = zip(*map(known.__getitem__, parts), strict=True) if parts else ((), ())
                self.pieces[p] = " ".join(ids), " ".join(texts)

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.text[i] for i in ids)

    def encode(self, texts: list[str]) -> list[str]:
        """Decimal ids of each text, joined by a space."""
        return [x for x, _ in self.both(texts)]

    def both(self, texts: list[str]) -> list[tuple[str, str]]:
        """Ids (decimal, joined by a space) and decoded text of each text."""
        cut = [[p for p in SPACES.split(t) if p] if SEPARATORS.search(t) else t.split() for t in texts]
        self.learn(set().union(*cut))
        out = []
        for pieces in cut:
            ids, decoded = zip(*map(self.pieces.__getitem__, pieces), strict=True) if pieces else ((), ())
            if "" in ids:
                # Pieces without tokens leave no space behind.
                ids, decoded = zip(*filter(lambda x: x[0], zip(ids, decoded, strict=True)), strict=True) if any(ids) else ((), ())
            out.append((" ".join(ids), " ".join(decoded)))
        return out


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


CACHES.append(codec.cache_clear)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (decimal, joined by a space) and decoded text of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, got in _coded(batches, path):
            yield pa.RecordBatch.from_arrays([ids, pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.string())], names=["doc_id", "ids", "decoded"])

    return ids_and_text(docs).mapInArrow(run, "doc_id long, ids string, decoded string")


def _coded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, list[tuple[str, str]]]]:
    """A few texts at a time, about 1 MB, so that strings stay small."""
    use = codec(path)
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        a = 0
        while a < len(texts):
            b, size = a, 0
            part: list[str] = []
            while b < len(texts) and size < 1 << 20:
                part.append(texts[b].as_py() or "")
                size += len(part[-1])
                b += 1
            yield ids[a:b], use.both(part)
            a = b


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Token count and digests of ids and decoded text, without moving either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, got in _coded(batches, path):
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([x.count(" ") + 1 if x else 0 for x, _ in got], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x, _ in got]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for _, x in got]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return ids_and_text(docs).mapInArrow(run, SCHEMA)


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), word_vocabulary())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: token counts and digests of what the others kept."""
    return digests(docs, word_vocabulary())
