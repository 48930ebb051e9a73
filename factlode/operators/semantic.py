"""Pages cut where the subject changes: sentences, the likeness of neighbours, and chunks with an overlap.

A page is ``PARAGRAPHS`` paragraphs of a document. Sentences are vectors of term counts. A page is
read and cut in one pass of a task, so no text is exchanged and what is held is one page.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlode.operators.corpus import SENTENCE, SHORT
from factlode.llm.common import bound_batches
from factlode.plans.registry import query
from factlode.sources.fixtures import fixture

PARAGRAPHS = 15
LEAST, MOST, OVERLAP, SIGMA = 400, 1500, 0.2, 1.0
TERM = r"[a-z]+|[0-9]+|[一-龥]"


def page_texts(docs: DataFrame) -> DataFrame:
    """doc_id, page (from 1) and text: every ``PARAGRAPHS`` lines that are not blank. Null and blank texts have no page."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    cut = docs.select("doc_id", lines.alias("lines")).filter(F.size("lines") > 0)
    starts = F.sequence(F.lit(1), F.size("lines"), F.lit(PARAGRAPHS))
    return cut.select("doc_id", F.posexplode(F.transform(starts, lambda k: F.array_join(F.slice("lines", k, F.lit(PARAGRAPHS)), "\n"))).alias("page", "text")).withColumn("page", F.col("page") + 1)


def sentences(text: str) -> list[str]:
    out: list[list[str]] = []
    for m in re.finditer(SENTENCE, text):
        piece = m.group().strip(" \n")
        if piece and out and len(piece) < SHORT:
            out[-1].append(piece)
        elif piece:
            out.append([piece])
    return ["".join(x) for x in out]


def likeness(parts: list[str]) -> list[float]:
    """Cosine of the term counts of each sentence and the next."""
    counts = [Counter(re.findall(TERM, re.sub("[A-Z]", lambda m: m.group().lower(), p))) for p in parts]
    norms = [math.sqrt(sum(n * n for n in c.values())) for c in counts]
    return [sum(n * b[t] for t, n in a.items()) / (x * y + 1e-8) for a, b, x, y in zip(counts, counts[1:], norms, norms[1:], strict=False)]


def threshold(sims: list[float], sigma: float) -> float:
    if not sims:
        return 0.5 - sigma * 0.1
    mean = sum(sims) / len(sims)
    return mean - sigma * math.sqrt(sum((s - mean) ** 2 for s in sims) / len(sims))


def chunks(text: str, least: int = LEAST, most: int = MOST, overlap: float = OVERLAP, sigma: float = SIGMA) -> list[str]:
    """The chunks of a page: cut at a fall of likeness once ``least`` characters are there, and before ``most`` are passed.

    A chunk begins with the last ``overlap`` share of ``most`` of the one before. A short page is one chunk."""
    parts = sentences(text)
    if len(text) < most or len(parts) <= 2:
        return [text.strip()] if text.strip() else []
    sims, tail = likeness(parts), int(most * overlap)
    low = threshold(sims, sigma)
    out, now, size = [], [parts[0]], len(parts[0])
    for sim, part in zip(sims, parts[1:], strict=True):
        if (sim < low and size >= least) or size + len(part) > most:
            whole = "".join(now)
            out.append(whole.strip())
            now = [whole[-tail:], part] if 0 < tail < size else [part]
            size = sum(map(len, now))
        else:
            now.append(part)
            size += len(part)
    out.append("".join(now).strip())
    return [c for c in out if c]


PAGES = 64


def _each_page(pages: DataFrame, read, schema: str, kinds: list) -> DataFrame:
    """Rows of ``read`` of every page; a task holds what ``PAGES`` pages give, and gets a few MB of texts at a time."""
    names = [c.split()[0] for c in schema.split(", ")]
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, PAGES) for b in batches for at in range(0, b.num_rows, PAGES)):
            rows = [(i, p, *row) for i, p, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "page", "text")), strict=True) for row in read(t)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=names)

    return pages.mapInArrow(run, schema)


def boundaries(pages: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """doc_id, page, at (a sentence's number, from 1), likeness to the next and whether it falls below the page's threshold."""

    def read(text: str) -> Iterator[tuple]:
        sims = likeness(sentences(text))
        low = threshold(sims, sigma)
        return ((k, s, s < low) for k, s in enumerate(sims, 1))

    return _each_page(pages, read, "doc_id long, page int, at long, likeness double, boundary boolean", [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.bool_()])


def semantic(pages: DataFrame) -> DataFrame:
    """doc_id, page, pos and content of every chunk of every page."""
    return _each_page(pages, lambda t: enumerate(chunks(t)), "doc_id long, page int, pos long, content string", [pa.int64(), pa.int32(), pa.int64(), pa.string()])


PAGES_SQL = f"SELECT doc_id, CAST((rn - 1) // {PARAGRAPHS} + 1 AS INT) AS page, string_agg(line, chr(10) ORDER BY rn) AS text FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM corpus) l WHERE trim(line) <> '') p GROUP BY 1, 2"
PIECES_SQL = f"SELECT doc_id, page, k, string_agg(piece, '' ORDER BY i) AS s FROM (SELECT doc_id, page, i, piece, SUM(CASE WHEN length(piece) >= {SHORT} OR i = lowest THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, MIN(i) OVER (PARTITION BY doc_id, page) AS lowest FROM (SELECT doc_id, page, trim(unnest(p), ' ' || chr(10)) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, page, regexp_extract_all(text, '{SENTENCE}') AS p FROM ({PAGES_SQL}) g) a) b WHERE piece <> '') c) d GROUP BY 1, 2, 3"


@query("semantic_boundaries", f"""WITH s AS ({PIECES_SQL}), t AS (SELECT doc_id, page, k, term, COUNT(*) AS n FROM (SELECT doc_id, page, k, unnest(regexp_extract_all(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM s) e GROUP BY 1, 2, 3, 4),
norm AS (SELECT doc_id, page, k, sqrt(SUM(n * n)) AS x FROM t GROUP BY 1, 2, 3), dot AS (SELECT a.doc_id, a.page, a.k, SUM(a.n * b.n) AS v FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.page = b.page AND b.k = a.k + 1 AND a.term = b.term GROUP BY 1, 2, 3),
sims AS (SELECT s.doc_id, s.page, s.k, coalesce(v, 0) / (coalesce(p.x, 0) * coalesce(q.x, 0) + 1e-8) AS sim FROM s JOIN s z ON z.doc_id = s.doc_id AND z.page = s.page AND z.k = s.k + 1
 LEFT JOIN dot ON dot.doc_id = s.doc_id AND dot.page = s.page AND dot.k = s.k LEFT JOIN norm p ON p.doc_id = s.doc_id AND p.page = s.page AND p.k = s.k LEFT JOIN norm q ON q.doc_id = s.doc_id AND q.page = s.page AND q.k = s.k + 1)
SELECT doc_id, page, CAST(k AS BIGINT) AS at, floor(sim * 1000000 + 0.5) / 1000000 AS likeness FROM sims""")
def semantic_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Likeness to six decimals; which of them are boundaries is in ``boundaries`` (a mean's last bits differ between engines)."""
    found = boundaries(page_texts(fixture(spark, d, "corpus")))
    return found.select("doc_id", "page", "at", (F.floor(F.col("likeness") * 1000000 + 0.5) / 1000000).alias("likeness"))


@query("semantic_chunks")
def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    return semantic(page_texts(fixture(spark, d, "corpus")))
