"""Personal data: base patterns, and boosted trees over high-recall candidates.

Generators propose overlapping spans of five kinds, with far looser patterns than the base:
spelled-out ``[at]`` and ``(dot)``, numbers without a plus sign, other separators, and long runs
of letters and digits that may be secrets (keys, tokens). Boosted trees score each candidate by
its format and its context; a candidate is chosen if its score reaches its kind's threshold and
it overlaps no base span and no better candidate. Base spans always stay.

The trees are fitted here on a bounded sample of documents that hold candidates (at most
``TRAIN_DOCS`` different ones, those with the smallest hashes, with at most ``EXAMPLES`` candidates
of each). Candidates that are base spans are positive, also rewritten in the looser formats;
candidates that the base rules refuse, like numbers that fail their check digit, are negative.
Secrets have no base rule: runs that something like ``token =`` stands before are positive, others
negative, and as the trees see only the run's own form they find those without such a word too.
A kind's threshold is the lowest score from which, on documents left out of the fit,
``PRECISION`` of the candidates are positive; a kind without such a score adds nothing. Every
document is then searched whole, in time that grows with its length.

Defined results: a null or empty text has no spans; repeated rows are judged alike; an empty
table gives no rows; with no candidates to learn from only base spans are found; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ids_and_text, table

KINDS = ("email", "ip", "card", "phone")
ALL = (*KINDS, "secret")
USER = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
SITE = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
BASE = {
    # A run of digits is tried from its start only, and never given back: no other try could fit.
    "ip": re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
DOT = r"(?:\.|\x20?\[dot\]\x20?|\x20?\(dot\)\x20?|\x20dot\x20)"
AT = re.compile(r"@|\x20?\[at\]\x20?|\x20?\(at\)\x20?|\x20at\x20")
LOOSE_SITE = re.compile(r"[A-Za-z0-9-]++(?:" + DOT + r"[A-Za-z0-9-]++)+")
GENERATORS = (
    (("ip",), re.compile(r"[0-9]{1,4}(?:\x20?[.,]\x20?[0-9]{1,4}){3}")),
    (("card", "phone"), re.compile(r"\+?\(?[0-9](?:[\x20()./-]{0,3}[0-9]){6,24}")),
    (("secret",), re.compile(r"[A-Za-z0-9_+/-]{20,}+")),
)
NAMED = re.compile(r"(?i)(?:token|secret|passw|key|auth)[a-z0-9_]{0,12}[\"']?\s?[=:]\s?[\"']?$")
HINT = re.compile(r"[0-9@]|\[at\]|\(at\)|\x20at\x20")
TRAIN_DOCS, EXAMPLES, PRECISION, CONTEXT = 4000, 50, 0.98, 24
ROUNDS, DEPTH, RATE, BINS = 60, 3, 0.2, 24
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _octets(parts: tuple[str, ...]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts)


def addresses(text: str, marks: re.Pattern, site: re.Pattern) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping runs of ``USER`` characters, a mark and a site: found from the marks, so that a long run is read once."""
    done = since = 0
    for m in marks.finditer(text):
        if m.start() >= done:
            user = text[max(done, since) : m.start()]
            start = m.start() - (len(user) - len(user.rstrip(USER)))
            if start < m.start() and (s := site.match(text, m.end())):
                yield start, s.end()
                done = s.end()
        since = m.end()


ONLY_AT = re.compile("@")


def base_spans(text: str) -> list[Span]:
    """Spans of the base rules, by start and kind."""
    out: list[Span] = []
    if "@" in text:
        out += [(a, b, "email") for a, b in addresses(text, ONLY_AT, SITE)]
    out += [(m.start(), m.end(), "ip") for m in BASE["ip"].finditer(text) if _octets(m.groups())]
    for m in BASE["card"].finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in BASE["phone"].finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], ALL.index(s[2])))


def candidates(text: str) -> list[Span]:
    out = [(a, b, "email") for a, b in addresses(text, AT, LOOSE_SITE)]
    return out + [(m.start(), m.end(), k) for kinds, p in GENERATORS for m in p.finditer(text) for k in kinds]


def _class(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3


def features(text: str, span: Span) -> list[float]:
    """Format of a candidate and what stands around it."""
    a, b, kind = span
    s, before, after = text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    digits = re.sub("[^0-9]", "", s)
    runs = re.findall("[0-9]+", s)
    return [
        ALL.index(kind), len(s), len(digits), len(runs), max(map(len, runs), default=0), len(runs[0]) if runs else 0, len(runs[-1]) if runs else 0,
        s.count(" "), s.count("-"), s.count("."), s.count("("), s.count("/"), s.startswith("+"), "@" in s, "at" in s and "@" not in s,
        12 <= len(digits) <= 19 and luhn(digits), len(runs) == 4 and _octets(tuple(runs)), len(re.split(DOT, s)[-1]),
        _class(before[-1:]), _class(after[:1]), sum(c.isdigit() for c in before), sum(c.isdigit() for c in after),
        len(set(s)), sum(c.isupper() for c in s), len(re.findall("[0-9][A-Za-z]|[A-Za-z][0-9]", s)), re.fullmatch("[0-9a-f]+", s) is not None,
        kind != "secret" and sum(c in "#*$%&|=\"'" for c in before), bool(re.search("(?i)tel|phone|call|fax|mail|card|visa|addr", before)),
    ]


def rewritten(text: str, span: Span) -> list[tuple[str, Span]]:
    """A base span in the looser formats, each within its context."""
    a, b, kind = span
    s, before, after = text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    if kind == "email":
        user, site = s.split("@", 1)
        forms = [f"{user} [at] {site}", f"{user}(at){site}", f"{user} at {site.replace('.', ' dot ')}", f"{user} [at] {site.replace('.', ' [dot] ')}"]
    elif kind == "phone":
        forms = [s[1:], s[1:].replace(" ", "."), s.replace("-", "/")]
    elif kind == "card":
        d = re.sub("[^0-9]", "", s)
        forms = [sep.join(d[k : k + 4] for k in range(0, len(d), 4)) for sep in (".", "/")]
    else:
        forms = [s.replace(".", " . ")]
    return [(before + f + after, (len(before), len(before) + len(f), kind)) for f in forms]


def _mask(text: str, spans: list[Span]) -> bytearray:
    """1 for each character in a span."""
    out = bytearray(len(text))
    for a, b, _ in spans:
        out[a:b] = b"\1" * (b - a)
    return out


def examples(text: str) -> list[tuple[list[float], bool]]:
    """Labelled candidates of a text, those that half overlap a base span left out."""
    base = base_spans(text)
    known, spans, taken = set(base), {s[:2] for s in base}, _mask(text, base)
    out = []
    for c in candidates(text):
        if c in known:
            out.append((features(text, c), True))
        elif c[2] == "secret":
            out.append((features(text, c), bool(NAMED.search(text[max(0, c[0] - CONTEXT) : c[0]]))))
        elif c[:2] in spans or 1 not in taken[c[0] : c[1]]:
            out.append((features(text, c), False))
    for span in base:
        for form, where in rewritten(text, span):
            if where in candidates(form):
                out.append((features(form, where), True))
    return out


@dataclass
class Trees:
    """Boosted trees of fixed depth for a yes-or-no question, stored as arrays."""

    bias: float
    feature: np.ndarray  # rounds x (2**depth - 1)
    cut: np.ndarray
    leaf: np.ndarray  # rounds x 2**depth
    thresholds: dict[str, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Trees | None:
    """Trees on the rows that are not held out, thresholds on the others."""
    train = ~held
    if not (y[train].any() and (~y[train]).any()):
        return None
    xt, yt = x[train], y[train].astype(float)
    grid = [np.unique(np.quantile(xt[:, j], np.linspace(0, 1, BINS + 1)[:-1])) for j in range(x.shape[1])]
    rate = yt.mean()
    bias = float(np.log(rate / (1 - rate)))
    total = np.full(len(yt), bias)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    feature, cut, leaf = np.zeros((ROUNDS, inner), np.int64), np.full((ROUNDS, inner), np.inf), np.zeros((ROUNDS, leaves))
    for r in range(ROUNDS):
        p = 1 / (1 + np.exp(-total))
        g, h = yt - p, p * (1 - p)
        node = np.zeros(len(yt), np.int64)
        for level in range(DEPTH):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                at = np.flatnonzero(node == k)
                best = (1e-6, 0, np.inf)
                if len(at) > 1:
                    whole = g[at].sum() ** 2 / (h[at].sum() + 1)
                    for j, cuts in enumerate(grid):
                        if len(cuts) < 2:
                            continue
                        bins = np.searchsorted(cuts, xt[at, j])
                        gs, hs = np.cumsum(np.bincount(bins, g[at], len(cuts) + 1))[:-1], np.cumsum(np.bincount(bins, h[at], len(cuts) + 1))[:-1]
                        gain = gs**2 / (hs + 1) + (g[at].sum() - gs) ** 2 / (h[at].sum() - hs + 1) - whole
                        i = int(np.argmax(gain))
                        if gain[i] > best[0]:
                            best = (float(gain[i]), j, float(cuts[i]))
                feature[r, k], cut[r, k] = best[1], best[2]
            node = 2 * node + 1 + (xt[np.arange(len(yt)), feature[r, node]] > cut[r, node])
        node -= inner
        leaf[r] = RATE * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + 1)
        total += leaf[r][node]
    out = Trees(bias, feature, cut, leaf, {})
    score, truth, kind = out.score(x[held]), y[held], x[held, 0].astype(int)
    for k, name in enumerate(ALL):
        order = np.argsort(-score[kind == k], kind="stable")
        s, right = score[kind == k][order], np.cumsum(truth[kind == k][order])
        good = np.flatnonzero((right >= PRECISION * np.arange(1, len(s) + 1)) & (np.append(s[1:], -1) < s))
        out.thresholds[name] = float(max(0.5, s[good[-1]])) if len(good) else 2.0
    return out


def train(docs: DataFrame, limit: int = TRAIN_DOCS) -> Trees | None:
    """Fit on at most ``limit`` different documents; only their labelled candidates come to the driver."""
    hashed = ids_and_text(docs).withColumn("at", F.xxhash64("doc_id", "text"))
    hint = F.col("text").rlike("[0-9]{2}|@")
    last = hashed.filter(hint).select("at").distinct().orderBy("at").limit(limit).agg(F.max("at")).first()[0]
    if last is None:
        return None
    some = hashed.filter(hint & (F.col("at") <= last)).dropDuplicates(["at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, f, y) for i, t in zip(batch.column("at").to_pylist(), batch.column("text").to_pylist(), strict=True) for f, y in examples(t)[:EXAMPLES]]
            if rows:
                at, f, y = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([[float(v) for v in r] for r in f], pa.list_(pa.float64())), pa.array(y)], names=["at", "x", "y"])

    got = some.select("at", "text").mapInArrow(run, "at long, x array<double>, y boolean").toPandas()
    if not len(got):
        return None
    got = got.assign(key=got.x.map(tuple)).sort_values(["at", "key", "y"])
    return fit(np.stack(got.x.to_numpy()), got.y.to_numpy(bool), (got["at"] % 5 == 0).to_numpy())


def find(text: str, trees: Trees | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    if not HINT.search(text):
        return [], []
    base = base_spans(text)
    taken = _mask(text, base)
    more: list[Span] = []
    found = [c for c in candidates(text) if 1 not in taken[c[0] : c[1]]] if trees else []
    if found:
        score = trees.score(np.array([features(text, c) for c in found], float))
        for k in np.lexsort((np.arange(len(found)), -score)):
            a, b, kind = found[k]
            if score[k] >= trees.thresholds[kind] and 1 not in taken[a:b]:
                more.append(found[k])
                taken[a:b] = b"\1" * (b - a)
    return base, sorted([*base, *more], key=lambda s: (s[0], ALL.index(s[2])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def personal_data(docs: DataFrame, trees: Trees | None) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column("text"):
                base, every = find(t.as_py() or "", sent.value)
                rows.append((*(sum(s[2] == k for s in base) for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return ids_and_text(docs).mapInArrow(run, SCHEMA)


def redact(text: str | None, trees: Trees | None) -> str | None:
    """The text with each span replaced by its kind; overlapping spans go together."""
    if not text or not (spans := find(text, trees)[1]):
        return text
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """All rows and columns, with the spans in ``text`` replaced."""
    sent, at = docs.sparkSession.sparkContext.broadcast(trees), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([redact(t.as_py(), sent.value) for t in batch.column(at)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), new)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return personal_data(docs, train(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data is replaced in the texts."""
    return redacted(docs, train(docs))
