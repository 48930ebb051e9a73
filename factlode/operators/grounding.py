"""Numbers of reports held against what they should say.

A report's numbers and its own values meet in one row, where pairs of values are made a bounded number at a
time. Numbers of a source meet within a tolerance by joining on buckets: a value shows the bucket it lies in and both
neighbours, a number its own, and the pair is then decided by the exact rule. A bucket is as wide as the
tolerance at least, so no pair is lost and nothing is compared with everything.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlode.llm.common import bound_batches
from factlode.plans.registry import query
from factlode.sources.fixtures import fixture

RELATIVE, ABSOLUTE, PERCENT, GROUNDED = 0.01, 0.1, 1.0, 0.015
WINDOW = 500
#: Pairs of values, or of a number and a value, that a task makes at a time.
CELLS = 1 << 20
VERDICTS = pa.array(["suspicious", "close", "derived"])
PLAIN = r"[0-9]+\.?[0-9]*"
#: Confidence marks and lines that only part a table's head from its rows hold no numbers of the report.
MARKS = r"\[置信度[：:]\s*[0-9]+%\]|(?m)^\s*\|[\s\-:|]+\|\s*$"


def even_bucket(x: Column, width: float) -> Column:
    return F.floor(x / width).cast("long")


def _shown(values: DataFrame, rule: str, bucket: Column) -> DataFrame:
    """Rows of (report_id, value) with the buckets in which a number close to them may lie."""
    return values.select("report_id", "value", F.lit(rule).alias("rule"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))


def numbers_of(reports: DataFrame) -> DataFrame:
    """report_id, number (as written) and x of a report's different numbers that are to be checked.

    Years, 100 and whole numbers under 100 are not."""
    clean = F.regexp_replace("text", MARKS, "")
    found = reports.select("report_id", F.explode(F.array_distinct(F.regexp_extract_all(clean, F.lit(PLAIN), F.lit(0)))).alias("number"))
    skip = F.col("number").rlike("^20[0-9]{2}$") | (F.col("number") == "100") | (~F.contains("number", F.lit(".")) & (F.col("x") < 100))
    return found.withColumn("x", F.col("number").cast("double")).filter(~skip)


def written(values: DataFrame) -> DataFrame:
    """report_id and known: a report's different values, each as it is and as written in hundred millions or ten thousands."""
    v = F.col("value")
    two = lambda x: F.floor(x * 100 + 0.5) / 100
    forms = F.array(v, F.when(F.abs(v) >= 1e8, two(v / 1e8)).when(F.abs(v) >= 1e4, two(v / 1e4)))
    shown = values.select("report_id", F.explode(F.filter(forms, lambda x: x.isNotNull() & (x != 0))).alias("value"))
    return shown.groupBy("report_id").agg(F.collect_set("value").alias("known"))


def within(x: np.ndarray, targets: np.ndarray, off: float) -> np.ndarray:
    """Whether some target is nearer than ``off`` to each number."""
    targets = np.sort(targets)
    if not len(targets):
        return np.zeros(len(x), bool)
    at = np.searchsorted(targets, x)
    return (np.abs(x - targets[np.minimum(at, len(targets) - 1)]) < off) | (np.abs(x - targets[np.maximum(at - 1, 0)]) < off)


def judged(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """1 for each number close to a known value, 2 if one is derived from two of them, else 0; ``CELLS`` pairs are held at a time."""
    close, derived = np.zeros(len(x), bool), np.zeros(len(x), bool)
    step = max(1, CELLS // max(len(known), len(x), 1))
    for k in range(0, len(known), step):
        a = known[k : k + step]
        off = np.abs(x[:, None] - a)
        close |= ((off / np.abs(a) < RELATIVE) | (off < ABSOLUTE)).any(axis=1)
        sums = [(a[:, None] + known).ravel(), np.abs(a[:, None] - known).ravel(), np.abs(100 - a[a > 1])]
        derived |= within(x, np.concatenate(sums), ABSOLUTE)
        derived |= within(x, (a[:, None] / known * 100)[a[:, None] != known], PERCENT)
    return np.where(close, 1, np.where(derived, 2, 0))


def verdicts(reports: DataFrame, values: DataFrame) -> DataFrame:
    """report_id, number and verdict of every number to be checked.

    'close' to a value (1 % or 0.1), else 'derived' as a sum, difference, complement to 100 or ratio in
    percent of two values, else 'suspicious'. A report's numbers and values meet as two lists; the pairs of
    its values are made where these are and leave no task."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, known = batch.column("numbers"), batch.column("known")
            flat, edges = numbers.flatten(), np.append(0, np.cumsum(pc.list_value_length(numbers).to_numpy()))
            x, how = flat.cast(pa.float64()).to_numpy(), np.zeros(len(flat), np.int64)
            for k in range(batch.num_rows):
                if known[k].is_valid:
                    how[edges[k] : edges[k + 1]] = judged(x[edges[k] : edges[k + 1]], known[k].values.to_numpy())
            report = batch.column("report_id").take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(edges))))
            yield pa.RecordBatch.from_arrays([report, flat, VERDICTS.take(pa.array(how))], names=["report_id", "number", "verdict"])

    bound_batches(reports.sparkSession)
    numbers = numbers_of(reports).groupBy("report_id").agg(F.collect_set("number").alias("numbers"))
    both = numbers.join(written(values), "report_id", "left").select("report_id", "numbers", "known")
    return both.mapInArrow(judge, "report_id string, number string, verdict string")


_FORMS = "SELECT report_id, value FROM report_values WHERE value <> 0 UNION SELECT report_id, w FROM (SELECT report_id, CASE WHEN abs(value) >= 1e8 THEN floor(value / 1e8 * 100 + 0.5) / 100 WHEN abs(value) >= 1e4 THEN floor(value / 1e4 * 100 + 0.5) / 100 END AS w FROM report_values) f WHERE w <> 0"
_NUMBERS = r"SELECT report_id, number, CAST(number AS DOUBLE) AS x FROM (SELECT DISTINCT report_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(text, '\[置信度[：:]\s*[0-9]+%\]', '', 'g'), '(?m)^\s*\|[\s\-:|]+\|\s*$', '', 'g'), '[0-9]+\.?[0-9]*')) AS number FROM reports) n WHERE NOT regexp_full_match(number, '20[0-9]{2}') AND number <> '100' AND NOT (NOT contains(number, '.') AND CAST(number AS DOUBLE) < 100)"


@query("number_verification", f"""WITH known AS ({_FORMS}), num AS ({_NUMBERS}),
pairs AS (SELECT a.report_id, a.value AS a, b.value AS b FROM known a JOIN known b ON a.report_id = b.report_id),
one AS (SELECT n.report_id, number, 1 AS how FROM num n JOIN known k ON n.report_id = k.report_id WHERE abs(x - value) / abs(value) < 0.01 OR abs(x - value) < 0.1),
two AS (SELECT n.report_id, number, 2 AS how FROM num n JOIN pairs p ON n.report_id = p.report_id WHERE abs(x - (a + b)) < 0.1 OR abs(x - abs(a - b)) < 0.1 OR (a > 1 AND abs(x - abs(100 - a)) < 0.1) OR (a <> b AND abs(x - a / b * 100) < 1.0))
SELECT n.report_id, n.number, CASE MIN(how) WHEN 1 THEN 'close' WHEN 2 THEN 'derived' ELSE 'suspicious' END AS verdict
FROM num n LEFT JOIN (SELECT * FROM one UNION ALL SELECT * FROM two) h ON h.report_id = n.report_id AND h.number = n.number GROUP BY 1, 2""")
def number_verification(spark: SparkSession, d: str) -> DataFrame:
    return verdicts(fixture(spark, d, "reports"), fixture(spark, d, "report_values"))


def grounded(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """report_id, number and grounded: whether a number of more than two characters stands in a source of
    its report, as written or within 0.015 of one there."""
    numbers = answers.select("report_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(PLAIN), F.lit(0)))).alias("number")).filter(F.length("number") > 2)
    asked = numbers.groupBy("report_id").agg(F.collect_list("number").alias("numbers"))
    # A report's numbers go to its sources, not the texts to each number.
    there = sources.join(asked, "report_id").select("report_id", F.explode(F.filter("numbers", lambda n: F.contains("text", n))).alias("number"))
    x = F.col("x")
    theirs = sources.select("report_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(PLAIN), F.lit(0)))).alias("y")).select("report_id", F.col("y").cast("double").alias("value")).distinct()
    shown = _shown(theirs, "near", even_bucket(F.col("value"), GROUNDED)).drop("rule")
    own = numbers.withColumn("x", F.col("number").cast("double")).withColumn("bucket", even_bucket(x, GROUNDED))
    near = own.join(shown, ["report_id", "bucket"]).filter(F.abs(x - F.col("value")) < GROUNDED).select("report_id", "number")
    met = there.unionByName(near).distinct().withColumn("grounded", F.lit(True))
    return numbers.join(met, ["report_id", "number"], "left").select("report_id", "number", F.coalesce("grounded", F.lit(False)).alias("grounded"))


@query("number_grounding", """WITH num AS (SELECT report_id, number, CAST(number AS DOUBLE) AS x FROM (SELECT DISTINCT report_id, unnest(regexp_extract_all(text, '[0-9]+\\.?[0-9]*')) AS number FROM reports) n WHERE length(number) > 2),
src AS (SELECT doc_id AS report_id, text FROM statement_pages), theirs AS (SELECT DISTINCT report_id, CAST(unnest(regexp_extract_all(text, '[0-9]+\\.?[0-9]*')) AS DOUBLE) AS y FROM src)
SELECT report_id, number, EXISTS (SELECT 1 FROM src s WHERE s.report_id = n.report_id AND contains(s.text, n.number)) OR EXISTS (SELECT 1 FROM theirs t WHERE t.report_id = n.report_id AND abs(n.x - t.y) < 0.015) AS grounded FROM num n""")
def number_grounding(spark: SparkSession, d: str) -> DataFrame:
    return grounded(fixture(spark, d, "reports"), fixture(spark, d, "statement_pages").select(F.col("doc_id").alias("report_id"), "text"))


def _matches(x: Column, expected: Column, tolerance: Column) -> Column:
    """Whether a number is an expected value, as it is or in ten thousands or hundred millions, rounded."""
    at = lambda by, digits: F.signum(expected) * F.floor(F.abs(expected) / by * 10**digits + 0.5) / 10**digits
    forms = [expected, *(at(by, k) for by in (1e4, 1e8) for k in (2, 1, 0))]
    near = lambda c: F.when(F.abs(c) < 0.01, F.abs(x) < 0.01).otherwise(F.abs(x - c) / F.abs(c) < tolerance)
    ok = F.lit(False)
    for c in forms:
        ok = ok | near(c) | ((expected < 0) & near(F.abs(c)))
    return ok


def places(reports: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report_id, name, at) of every place of a wanted name, its parts and its small letters; (report_id, at, x) of every number."""
    names = wanted.groupBy("report_id").agg(F.collect_set("name").alias("names"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for report, text, names in zip(*(batch.column(c).to_pylist() for c in ("report_id", "text", "names")), strict=True):
                text = text or ""
                rows += [(report, None, m.start(), float(m.group())) for m in re.finditer(r"-?[0-9]+\.?[0-9]*", text)]
                for name in names:
                    parts = {name, *(name.split("_"))} - {""}
                    hits = {m.start() for p in parts | {p.lower() for p in parts} for m in re.finditer(f"(?={re.escape(p)})", text)}
                    rows += [(report, name, at, None) for at in hits]
            kinds = [("report_id", pa.string()), ("name", pa.string()), ("at", pa.int64()), ("x", pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for _, k in kinds], names=[n for n, _ in kinds])

    found = reports.join(names, "report_id").select("report_id", "text", "names").mapInArrow(find, "report_id string, name string, at long, x double")
    return found.filter("name IS NOT NULL").drop("x"), found.filter("name IS NULL").drop("name")


def associations(reports: DataFrame, wanted: DataFrame) -> DataFrame:
    """report_id, name and found of each wanted (report_id, name, expected, tolerance): 'near' if a number that fits stands
    within 500 characters of the name, 'anywhere' if only elsewhere, 'no value', or 'no name'.

    Names and numbers meet by blocks of 500 characters: a number shows its block and both neighbours."""
    at_names, numbers = places(reports, wanted)
    fits = _matches(F.col("x"), F.col("expected"), F.col("tolerance"))
    # Numbers that fit a wanted value, wherever they stand; their places are what is joined with names.
    fitting = wanted.join(numbers, "report_id").filter(fits).select("report_id", "name", F.col("at").alias("number_at"))
    block = F.floor(F.col("number_at") / WINDOW)
    shown = fitting.withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
    named = at_names.withColumn("block", F.floor(F.col("at") / WINDOW))
    near = named.join(shown, ["report_id", "name", "block"]).filter(F.abs(F.col("at") - F.col("number_at")) <= WINDOW).select("report_id", "name").distinct().withColumn("near", F.lit(True))
    some = fitting.select("report_id", "name").distinct().withColumn("fits", F.lit(True))
    there = at_names.select("report_id", "name").distinct().withColumn("there", F.lit(True))
    rows = wanted.join(there, ["report_id", "name"], "left").join(near, ["report_id", "name"], "left").join(some, ["report_id", "name"], "left")
    found = F.when(F.col("there").isNull(), "no name").when(F.col("near"), "near").when(F.col("fits"), "anywhere").otherwise("no value")
    return rows.select("report_id", "name", found.alias("found"))


_FORMS_OF = ["e"] + [f"(sign(e) * floor(abs(e) / {by} * {10**k} + 0.5) / {10**k})" for by in ("1e4", "1e8") for k in (2, 1, 0)]
_FIT = " OR ".join(f"(CASE WHEN abs({c}) < 0.01 THEN abs(x) < 0.01 ELSE abs(x - {c}) / abs({c}) < 0.02 END) OR (e < 0 AND (CASE WHEN abs({c}) < 0.01 THEN abs(x) < 0.01 ELSE abs(x - abs({c})) / abs({c}) < 0.02 END))" for c in _FORMS_OF)


@query("indicator_association", f"""WITH num AS (SELECT report_id, CAST(part AS DOUBLE) AS x, until - length(part) AS place FROM (SELECT report_id, part, SUM(length(part)) OVER (PARTITION BY report_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS until FROM (SELECT report_id, unnest(p) AS part, generate_subscripts(p, 1) AS k FROM (SELECT report_id, regexp_extract_all(text, '-?[0-9]+\\.?[0-9]*|-|[^0-9-]+') AS p FROM reports) a) b) c WHERE regexp_full_match(part, '-?[0-9]+\\.?[0-9]*')),
named AS (SELECT v.report_id, name, value AS e, unnest(list_filter(range(1, length(text) - length(name) + 2), lambda i: substr(text, i, length(name)) = name)) - 1 AS place FROM report_values v JOIN reports r ON v.report_id = r.report_id),
fit AS (SELECT report_id, name, place FROM (SELECT v.report_id, name, value AS e, x, place FROM report_values v JOIN num n ON v.report_id = n.report_id) j WHERE {_FIT})
SELECT v.report_id, v.name, CASE WHEN NOT EXISTS (SELECT 1 FROM named n WHERE n.report_id = v.report_id AND n.name = v.name) THEN 'no name'
 WHEN EXISTS (SELECT 1 FROM named n JOIN fit f ON n.report_id = f.report_id AND n.name = f.name WHERE n.report_id = v.report_id AND n.name = v.name AND abs(n.place - f.place) <= {WINDOW}) THEN 'near'
 WHEN EXISTS (SELECT 1 FROM fit f WHERE f.report_id = v.report_id AND f.name = v.name) THEN 'anywhere' ELSE 'no value' END AS found
FROM report_values v JOIN reports r ON v.report_id = r.report_id""")
def indicator_association(spark: SparkSession, d: str) -> DataFrame:
    reports = fixture(spark, d, "reports")
    wanted = fixture(spark, d, "report_values").join(reports.select("report_id"), "report_id", "left_semi")
    return associations(reports, wanted.select("report_id", "name", F.col("value").alias("expected"), F.lit(0.02).alias("tolerance")))
