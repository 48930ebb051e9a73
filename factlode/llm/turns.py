"""Repair of conversations: turns aligned with an alternating grammar at least cost.

A repaired conversation's roles read ``(s?(ua)+)?``. Edits keep a turn (K, 0), give it the role of a
user or assistant (R, 2), delete it (D, 3) or insert an empty one (I, 2); blank and repeated turns
must go, and a truncated turn that stays adds 1.

Each conversation's turns are aligned by Wagner and Fischer's table with each feasible length of the
grammar's string. From the end, what is left of any such string depends on its length only, so one
table serves all lengths: its column is the number of symbols left. It is filled within Ukkonen's
band: a first narrow band gives an incumbent cost, and a cell so far off the diagonal that its
deletions or insertions alone cost more than that cannot be on a cheapest path. Of all lengths that
are cheapest, the audits are traced back, least letter first, and compared.

Long conversations are cut into pieces of ``PIECE`` turns. Pieces are aligned from the last to the
first; each gives, for every state of the grammar it may begin in, its cheapest audit and the
state it ends in. Only a few bytes a turn are held, whatever the texts' length; texts stream past in a
second pass that follows the audit.

Defined results: null roles and texts, and a null conv_id or turn in the damage's key, count as one
space; rows without conv_id are one conversation; turns are in order of turn (null first), then role,
then the digest of the text, equal rows next to each other; a conversation all of whose rows are
gone has zeros, an empty audit and the digest of the empty string; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, table

DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
PIECE = 1024
#: Characters that separate words, and those that end a turn.
BLANKS, STOPS = " \t\n\x0b\x0c\r", ".!?"
#: What a piece may begin in: nothing yet, after the system turn, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: A turn's code: its role's initial (0: s, 1: u, 2: a, 3: another), 4 if it must go, 8 if truncated.
FORCED, TRUNCATED = 4, 8
FAR = 1 << 40


class Table:
    """Least cost from each turn on, with each number of symbols left, for strings that end in one state."""

    def __init__(self, codes: np.ndarray, end: int, at_end: int, inserts: bool, wide: tuple[int, int]):
        """``at_end``: what follows costs; ``inserts``: whether the piece may end in inserted turns."""
        self.end, self.low = end, wide[0]
        n, width = len(codes), wide[0] + wide[1] + 1
        free = (codes & FORCED) == 0
        #: Turns from each one on that need not go: the diagonal.
        self.left = np.append(np.cumsum(free[::-1])[::-1], 0).astype(np.int64)
        steps = np.arange(width)
        out = np.full((n + 1, width + 1), FAR, np.int64)
        symbols = steps - self.low
        out[n, :width] = np.where(symbols == 0, at_end, np.where((symbols > 0) & inserts, at_end + INSERT * symbols, FAR))
        for i in range(n - 1, -1, -1):
            after, symbols = out[i + 1], steps + self.left[i] - self.low
            if free[i]:
                own = codes[i] & 3
                same = np.full(width, False) if own not in (1, 2) else self.wants_user(symbols) == (own == 1)
                best = np.minimum(after[1:] + DELETE, np.where(symbols > 0, after[:-1] + np.where(same, 0, REROLE) + (CUT if codes[i] & TRUNCATED else 0), FAR))
            else:
                best = after[:-1] + DELETE
            best = np.where(symbols >= 0, best, FAR)
            out[i, :width] = np.minimum.accumulate(best - INSERT * steps) + INSERT * steps
        self.cost = np.minimum(out, FAR)

    def wants_user(self, symbols):
        """Whether the first of so many symbols left is a user's."""
        return (symbols % 2 == 0) if self.end == ASSISTANT else (symbols % 2 == 1)

    def at(self, i: int, symbols: int) -> int:
        d = symbols - self.left[i] + self.low
        return int(self.cost[i, d]) if 0 <= d < self.cost.shape[1] - 1 and symbols >= 0 else FAR

    def audit(self, codes: np.ndarray, i: int, symbols: int) -> str:
        """The least letters of a cheapest path."""
        out = []
        while i < len(codes) or symbols:
            here = self.at(i, symbols)
            if i < len(codes) and self.at(i + 1, symbols) + DELETE == here:
                out.append("D")
                i += 1
                continue
            if symbols and self.at(i, symbols - 1) + INSERT == here:
                out.append("I")
                symbols -= 1
                continue
            own = codes[i] & 3
            out.append("K" if own == (1 if self.wants_user(symbols) else 2) and self.at(i + 1, symbols - 1) + (CUT if codes[i] & TRUNCATED else 0) == here else "R")
            i += 1
            symbols -= 1
        return "".join(out)


def aligned(codes: np.ndarray, ends: tuple[int, ...], last: bool) -> list[tuple[int, str, int]]:
    """(cost, audit, state behind) of the turns, for each state before them. ``ends``: what follows costs in each state."""
    forced = DELETE * int(((codes & FORCED) > 0).sum())
    reach = [x for x in ends if x < FAR]
    wide = (3, 4)
    while True:
        tables = [Table(codes, end, ends[end], last, wide) for end in (USER, ASSISTANT) if ends[end] < FAR]
        found = []
        for state in range(4):
            options = _options(codes, tables, state, ends)
            least = min((c for c, *_ in options), default=FAR)
            found.append((least, [x for x in options if x[0] == least]))
        worst = max(c for c, _ in found if c < FAR) - forced - min(reach)
        # Off the band, deletions or insertions alone cost so much.
        if worst < min(DELETE * (wide[0] + 1), INSERT * (wide[1] + 1)):
            break
        wide = (worst // DELETE + 1, worst // INSERT + 1)
    return [(least, *min(((head + (t.audit(codes, i, symbols) if t else "")), end) for _, head, t, i, symbols, end in options)) if least < FAR else (FAR, "", START) for least, options in found]


def _options(codes: np.ndarray, tables: list[Table], state: int, ends: tuple[int, ...]) -> list[tuple]:
    """(cost, letters so far, table, turn, symbols, state behind) of every length of the string from a state on."""
    n, out = len(codes), []

    def strings(i: int, state: int, spent: int, head: str) -> None:
        """Those that begin at turn i in a state, after ``head`` at a cost."""
        if state in (START, SYSTEM) and ends[state] < FAR:
            out.append((spent + DELETE * (n - i) + ends[state], head + "D" * (n - i), None, n, 0, state))
        for t in tables:
            symbols = np.arange(t.cost.shape[1] - 1) + t.left[i] - t.low
            # An empty string leaves the state as it is.
            ok = (symbols > 0) & (t.wants_user(symbols) == (state != USER)) | (symbols == 0) & (t.end == state)
            costs = np.where(ok, t.cost[i, :-1], FAR)
            least = int(costs.min(initial=FAR))
            if least < FAR:
                out.extend((spent + least, head, t, i, int(s), t.end) for s in symbols[costs == least])

    strings(0, state, 0, "")
    if state == START:
        for i in np.flatnonzero((codes & (3 | FORCED)) == 0).tolist():
            strings(i + 1, SYSTEM, DELETE * i + (CUT if codes[i] & TRUNCATED else 0), "D" * i + "K")
    return out


def chained(codes: bytes) -> tuple[int, str]:
    """Least cost and audit of the turns of a conversation, piece by piece."""
    pieces = [np.frombuffer(codes[k : k + PIECE], np.uint8) for k in range(0, max(1, len(codes)), PIECE)]
    ends, done = (0, FAR, FAR, 0), []
    for k in range(len(pieces) - 1, -1, -1):
        done.append(aligned(pieces[k], ends, k == len(pieces) - 1))
        ends = tuple(c for c, _, _ in done[-1])
    state, out = START, []
    for found in reversed(done):
        _, audit, state = found[state]
        out.append(audit)
    return ends[START], "".join(out)


#: Short conversations mostly repeat the same few sequences of codes.
_known = lru_cache(maxsize=100_000)(chained)


def repair(codes: bytes) -> tuple[int, str]:
    return _known(codes) if len(codes) <= 64 else chained(codes)


def _or_space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone: the rows after damage, and (gone) those that it dropped."""
    chance = F.pmod(F.crc32(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn"))), F.lit(20))
    marked = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _or_space("role").alias("role"), _or_space("text").alias("text"), chance.alias("chance"))
    text = F.when(F.col("chance") == 1, "").when(F.col("chance") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    out = marked.select("conv_id", "turn", F.when(F.col("chance") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("chance") == 0).alias("gone"), F.expr("explode(sequence(1, if(chance = 3, 2, 1)))").alias("copy"))
    return out.drop("copy")


def _with_digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.md5("text")))


def coded(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, gone, nth and code of each row, without its text."""
    ends = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    own = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    plain = _with_digest(rows).select("conv_id", "turn", "role", "digest", "gone", (ends == "").alias("blank"), (~F.right(ends, F.lit(1)).isin(*STOPS)).alias("truncated"), own.alias("own"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "digest", "gone").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(F.col("blank"), 1).when(F.col("nth") > 1, 2).when(F.col("truncated"), 3).otherwise(0)
    return plain.withColumn("nth", nth).select("conv_id", "turn", "role", "digest", "gone", "nth", "own", fault.alias("fault"))


AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[pa.RecordBatch]]]:
    """Slices of sorted batches with the conversation they belong to, and whether it begins."""
    known, last = False, None
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        a = 0
        for b in range(1, len(ids) + 1):
            if b == len(ids) or ids[b] != ids[a]:
                yield not known or ids[a] != last, ids[a], batch.slice(a, b - a)
                known, last = True, ids[a]
                a = b


def audits(rows: DataFrame) -> DataFrame:
    """Faults, gaps, cost and audit of every conversation of damaged rows (conv_id, turn, role, text, gone)."""
    sorted_rows = coded(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now = None
        for begins, conv, part in _by_conversation(batches):
            if begins:
                if now:
                    done.append(now.result())
                now = _Conversation(conv)
            now.add(part.filter(pa.array(~part.column("gone").to_numpy(zero_copy_only=False))))
            if len(done) >= 4096:
                yield _rows(done, AUDITS)
                done = []
        if now:
            done.append(now.result())
        if done:
            yield _rows(done, AUDITS)

    return sorted_rows.mapInArrow(run, AUDITS)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [(c.split()[0], {"long": pa.int64(), "string": pa.string()}[c.split()[1]]) for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


class _Conversation:
    """What is held of a conversation while its turns pass: a code each, and counts."""

    def __init__(self, conv: int | None):
        self.conv, self.codes, self.faults, self.illegal = conv, [], np.zeros(4, np.int64), 0
        self.turns, self.least, self.most, self.own = 0, None, None, None

    def add(self, part: pa.RecordBatch) -> None:
        if not part.num_rows:
            return
        own, fault = (part.column(c).to_numpy().astype(np.uint8) for c in ("own", "fault"))
        self.codes.append((own | np.where((fault == 1) | (fault == 2), FORCED, 0) | np.where(fault == 3, TRUNCATED, 0)).astype(np.uint8).tobytes())
        self.faults += np.bincount(fault, minlength=4)
        pairs = np.concatenate([[] if self.own is None else [self.own], own]).astype(np.int64)
        self.illegal += int((~np.isin(pairs[:-1] * 4 + pairs[1:], [1, 6, 9])).sum())  # su, ua, au
        self.own = own[-1]
        turns = part.column("turn").drop_null().to_numpy()
        if len(turns):
            self.turns += len(np.unique(turns)) - (self.most == turns[0])
            self.least = turns[0] if self.least is None else self.least
            self.most = turns[-1]

    def result(self) -> tuple:
        cost, audit = repair(b"".join(self.codes))
        gaps = 0 if self.least is None else int(self.most) - int(self.least) + 1 - self.turns
        return self.conv, gaps, *(int(self.faults[k]) for k in (1, 2, 3)), self.illegal, cost, audit


class _Follower:
    """Walks an audit over the turns as they pass."""

    def __init__(self, audit: str):
        self.audit, self.at, self.user = audit, 0, True

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield "I", self._next(), ""

    def _next(self) -> str:
        self.user = not self.user
        return "assistant" if self.user else "user"

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns that stand up to this one."""
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield edit, self._next(), text
        elif edit == "K":
            if role[0] != "s":
                self._next()
            yield edit, role, text

    def rest(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()


def _followed(rows: DataFrame, found: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over (conv_id, audit | role, text), a conversation's audit before its turns in order."""
    turns = _with_digest(rows.filter("NOT gone")).select("conv_id", F.lit(1).alias("part"), "turn", "role", "digest", "text")
    heads = found.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("digest"), F.col("audit").alias("text"))
    both = turns.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "part", F.col("turn").asc_nulls_first(), "role", "digest")
    return both.select("conv_id", "part", "role", "text").mapInArrow(run, schema)


REPAIRED = "conv_id long, at long, edit string, role string, text string"


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, at (from 0), edit, role and text of every repaired turn, from damaged rows and their ``audits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, at, conv = None, 0, None
        for batch in batches:
            out = []
            for c, part, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "part", "role", "text")), strict=True):
                if part == 0:
                    steps = walk.rest() if walk else ()
                else:
                    steps = walk.turn(role, text)
                for step in steps:
                    out.append((conv, at, *step))
                    at += 1
                if part == 0:
                    walk, at, conv = _Follower(text), 0, c
            if out:
                yield _rows(out, REPAIRED)
        if walk and (out := [(conv, at + k, *step) for k, step in enumerate(walk.rest())]):
            yield _rows(out, REPAIRED)

    return _followed(rows, found, run, REPAIRED)


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id and the sha256 of the repaired ``role:text`` lines of every conversation; no text is held."""
    schema = "conv_id long, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, conv, hashed, any_yet = None, None, None, False

        def put(steps) -> None:
            nonlocal any_yet
            for _, role, text in steps:
                hashed.update(f"{chr(10) * any_yet}{role}:{text}".encode())
                any_yet = True

        for batch in batches:
            out = []
            for c, part, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "part", "role", "text")), strict=True):
                if part:
                    put(walk.turn(role, text))
                    continue
                if walk:
                    put(walk.rest())
                    out.append((conv, hashed.hexdigest()))
                walk, conv, hashed, any_yet = _Follower(text), c, hashlib.sha256(), False
            if out:
                yield _rows(out, schema)
        if walk:
            put(walk.rest())
            yield _rows([(conv, hashed.hexdigest())], schema)

    return _followed(rows, found, run, schema)


def repairs(conversations: DataFrame) -> DataFrame:
    """Faults, audit and digest of every conversation, damaged and repaired."""
    rows = damaged(conversations)
    found = save(audits(rows), "audits")
    sha = digests(rows, found).withColumnRenamed("conv_id", "c")
    return found.join(sha, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs(table(spark, sf_dir, "conversations"))
