"""Scores of reports, and metrics read from texts by pattern.

A report's expected numbers, claims and tables meet it by its key, so every score is a join on report_id and
one grouping. A report without anything to be checked scores 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlode.operators.grounding import _FIT, associations
from factlode.plans.registry import query
from factlode.sources.fixtures import fixture

# Weights of the measures by type of question, what a system in use should reach, and the default tolerance.
WEIGHTS = {
    "template": {"anchor_accuracy": 0.30, "number_accuracy": 0.20, "traceability_rate": 0.15, "chart_render_rate": 0.10, "hallucination_score": 0.10, "structural_coverage": 0.10, "industry_benchmark": 0.05},
    "freeform": {"structural_coverage": 0.35, "hallucination_score": 0.20, "traceability_rate": 0.15, "number_accuracy": 0.10, "chart_render_rate": 0.10, "industry_benchmark": 0.05, "anchor_accuracy": 0.05},
}
TARGETS = {"anchor_accuracy": 0.95, "number_accuracy": 0.85, "traceability_rate": 0.80, "chart_render_rate": 0.90, "structural_coverage": 0.80, "hallucination_score": 0.90, "industry_benchmark": 0.50, "overall_score": 0.85}
TOLERANCE = 0.03
# What claims are made of, and words by which a report cites its industry.
CLAIMED = "毛利率|净利率|ROE|ROA|资产负债率|负债率|营收|收入|净利润|现金流|费用|成本"
DOWN, UP = "下降|下滑|减少|降低|回落|下跌", "上升|增长|提高|增加|提升|扩大|上涨"
CLAIMS = ((f"({CLAIMED})[^\\n]{{0,15}}({DOWN}|缩水)", "down"), (f"({CLAIMED})[^\\n]{{0,15}}({UP})", "up"), (f"({DOWN})[^\\n]{{0,15}}({CLAIMED})", "down"), (f"({UP})[^\\n]{{0,15}}({CLAIMED})", "up"))
CITES = "行业平均|行业均值|行业中位|同业|行业对比|行业水平"


def r4(x: Column) -> Column:
    return F.floor(x * 10000 + 0.5) / 10000


def accuracy(reports: DataFrame, wanted: DataFrame) -> DataFrame:
    """How many of its wanted (report_id, name, expected, tolerance, verified) each report states, near the name or elsewhere:
    report_id, total, matched and accuracy of all, and anchors, anchors_matched and anchor_accuracy of those that were verified
    by themselves. A null tolerance is 3 %. Both come from one reading of the texts."""
    found = associations(reports, wanted.withColumn("tolerance", F.coalesce("tolerance", F.lit(TOLERANCE))).drop("verified"))
    ok, sure = F.col("found").isin("near", "anywhere"), F.col("verified")
    counts = found.join(wanted.select("report_id", "name", "verified"), ["report_id", "name"]).groupBy("report_id").agg(
        F.count("*").alias("total"), F.count_if(ok).alias("matched"), F.count_if(sure).alias("anchors"), F.count_if(sure & ok).alias("anchors_matched"))
    rows = reports.select("report_id").join(counts, "report_id", "left").na.fill(0)
    share = lambda part, of: F.when(F.col(of) == 0, 1.0).otherwise(r4(F.col(part) / F.col(of)))
    return rows.withColumn("accuracy", share("matched", "total")).withColumn("anchor_accuracy", share("anchors_matched", "anchors"))


# Each number with its tolerance: 3 % unless the table says otherwise; those of the statements are verified by themselves.
_WANTED = "SELECT report_id, name, value AS expected, CASE WHEN name = '毛利率' THEN 5e-2 END AS tolerance, name <> '净利润' AS verified FROM report_values"


def _accuracy_sql(only: str) -> str:
    return f"""WITH wanted AS (SELECT report_id, name, expected AS e, coalesce(tolerance, {TOLERANCE}e0) AS tol FROM ({_WANTED}) w WHERE {only}),
num AS (SELECT report_id, CAST(unnest(regexp_extract_all(text, '-?[0-9]+\\.?[0-9]*')) AS DOUBLE) AS x FROM reports),
fit AS (SELECT DISTINCT w.report_id, w.name FROM wanted w JOIN reports r ON w.report_id = r.report_id JOIN num n ON w.report_id = n.report_id WHERE contains(r.text, w.name) AND ({_FIT.replace("< 0.02", "< tol")})),
c AS (SELECT w.report_id, COUNT(*) AS total, COUNT(f.name) AS matched FROM wanted w LEFT JOIN fit f ON w.report_id = f.report_id AND w.name = f.name GROUP BY 1)
SELECT r.report_id, coalesce(total, 0) AS total, coalesce(matched, 0) AS matched, CASE WHEN coalesce(total, 0) = 0 THEN 1e0 ELSE floor(matched * 1e0 / total * 10000 + 0.5) / 10000 END AS accuracy FROM reports r LEFT JOIN c ON r.report_id = c.report_id"""


def wanted_numbers(spark: SparkSession, d: str) -> DataFrame:
    tolerance = F.when(F.col("name") == "毛利率", 0.05)
    rows = fixture(spark, d, "report_values").join(fixture(spark, d, "reports").select("report_id"), "report_id", "left_semi")
    return rows.select("report_id", "name", F.col("value").alias("expected"), tolerance.alias("tolerance"), (F.col("name") != "净利润").alias("verified"))


@query("number_accuracy", _accuracy_sql("true"))
def number_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return accuracy(fixture(spark, d, "reports"), wanted_numbers(spark, d)).select("report_id", "total", "matched", "accuracy")


@query("anchor_accuracy", _accuracy_sql("verified"))
def anchor_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Only the numbers that were verified by themselves count."""
    rows = accuracy(fixture(spark, d, "reports"), wanted_numbers(spark, d))
    return rows.select("report_id", F.col("anchors").alias("total"), F.col("anchors_matched").alias("matched"), F.col("anchor_accuracy").alias("accuracy"))


def directions(values: DataFrame) -> DataFrame:
    """report_id, indicator, direction of (report_id, indicator, year, value): the last of its years against the one before, where they differ
    by more than 1 % of the latter's size."""
    w = Window.partitionBy("report_id", "indicator").orderBy(F.desc("year"))
    rows = values.withColumn("before", F.lead("value").over(w)).withColumn("rn", F.row_number().over(w)).filter("rn = 1 AND before <> 0")
    change = (F.col("value") - F.col("before")) / F.abs(F.col("before")) * 100
    return rows.withColumn("direction", F.when(change > 1, "up").when(change < -1, "down")).filter("direction IS NOT NULL").select("report_id", "indicator", "direction")


def claims(reports: DataFrame) -> DataFrame:
    """report_id, claim and claimed of every different wording that says a metric rose or fell; of two readings of one wording the earlier pattern's holds."""
    def read_by(k: int) -> Column:
        pattern, claimed = CLAIMS[k]
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda t: F.struct(t.alias("claim"), F.lit(k).alias("k"), F.lit(claimed).alias("claimed")))

    read = [read_by(k) for k in range(len(CLAIMS))]
    rows = reports.select("report_id", F.explode(F.concat(*read)).alias("c")).select("report_id", "c.*")
    return rows.groupBy("report_id", "claim").agg(F.min_by("claimed", "k").alias("claimed"))


def judged_claims(reports: DataFrame, values: DataFrame) -> DataFrame:
    """report_id, checked, wrong and score: how many claims name a metric that moved, how many say the other direction, and 1 less
    the share of the wrong. A claim that names several is judged by the longest name, then the least."""
    named = claims(reports).join(directions(values), "report_id").filter(F.contains("claim", F.col("indicator")))
    best = named.groupBy("report_id", "claim", "claimed").agg(F.min_by("direction", F.struct(-F.length("indicator"), F.col("indicator"))).alias("direction"))
    counts = best.groupBy("report_id").agg(F.count("*").alias("checked"), F.count_if(F.col("claimed") != F.col("direction")).alias("wrong"))
    checked, wrong = F.coalesce("checked", F.lit(0)), F.coalesce("wrong", F.lit(0))
    return reports.select("report_id").join(counts, "report_id", "left").select("report_id", checked.alias("checked"), wrong.alias("wrong"), r4(1.0 - wrong / F.greatest(checked, F.lit(1))).alias("score"))


_CLAIMS_SQL = " UNION ALL ".join(f"SELECT report_id, unnest(regexp_extract_all(text, '{p}', 0)) AS claim, {k} AS k, '{to}' AS claimed FROM comments" for k, (p, to) in enumerate(CLAIMS))


@query("direction_claims", f"""WITH c AS (SELECT report_id, claim, arg_min(claimed, k) AS claimed FROM ({_CLAIMS_SQL}) u GROUP BY 1, 2),
v AS (SELECT report_id, indicator, value, year, lead(value) OVER (PARTITION BY report_id, indicator ORDER BY year DESC) AS before, row_number() OVER (PARTITION BY report_id, indicator ORDER BY year DESC) AS rn FROM comment_values),
m AS (SELECT report_id, indicator, CASE WHEN (value - before) / abs(before) * 100 > 1 THEN 'up' WHEN (value - before) / abs(before) * 100 < -1 THEN 'down' END AS direction FROM v WHERE rn = 1 AND before <> 0),
j AS (SELECT c.report_id, claimed, direction, row_number() OVER (PARTITION BY c.report_id, claim ORDER BY length(indicator) DESC, indicator) AS rn FROM c JOIN m ON c.report_id = m.report_id WHERE direction IS NOT NULL AND contains(claim, indicator)),
n AS (SELECT report_id, COUNT(*) AS checked, COUNT(*) FILTER (claimed <> direction) AS wrong FROM j WHERE rn = 1 GROUP BY 1)
SELECT r.report_id, coalesce(checked, 0) AS checked, coalesce(wrong, 0) AS wrong, floor((1e0 - coalesce(wrong, 0) * 1e0 / greatest(coalesce(checked, 0), 1)) * 10000 + 0.5) / 10000 AS score FROM comments r LEFT JOIN n ON r.report_id = n.report_id""")
def direction_claims(spark: SparkSession, d: str) -> DataFrame:
    return judged_claims(fixture(spark, d, "comments"), fixture(spark, d, "comment_values"))


@query("benchmark_citation", f"""SELECT report_id, cites, n_values, CASE WHEN n_wanted = 0 THEN 1e0 WHEN cites THEN 1e0 WHEN n_values > 0 THEN 0.5e0 ELSE 0e0 END AS rate FROM (
SELECT c.report_id, any_value(regexp_matches(text, '{CITES}')) AS cites, COUNT(b.metric) FILTER (contains(text, substr(CAST(b.value AS VARCHAR), 1, 4))) AS n_values, COUNT(b.metric) AS n_wanted
FROM comments c LEFT JOIN sector_benchmarks b ON c.sector = b.sector GROUP BY 1) s""")
def benchmark_citation(spark: SparkSession, d: str) -> DataFrame:
    return cited(fixture(spark, d, "comments"), fixture(spark, d, "sector_benchmarks"))


def cited(reports: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """report_id, cites (the report speaks of its industry), n_values (of its sector's values (sector, metric, value) it shows the first
    four characters) and rate: 1, or 0.5 for values without such words, or 0; 1 where the sector has no values.

    A sector's values go to its reports as one row."""
    packed = benchmarks.groupBy("sector").agg(F.collect_list(F.substring(F.col("value").cast("string"), 1, 4)).alias("heads"))
    heads = F.coalesce("heads", F.array().cast("array<string>"))
    rows = reports.join(packed, "sector", "left").select("report_id", F.col("text").rlike(CITES).alias("cites"), F.size(F.filter(heads, lambda h: F.contains("text", h))).cast("long").alias("n_values"), F.size(heads).alias("n_wanted"))
    rate = F.when((F.col("n_wanted") == 0) | F.col("cites"), 1.0).when(F.col("n_values") > 0, 0.5).otherwise(0.0)
    return rows.select("report_id", "cites", "n_values", rate.alias("rate"))


def overall(scores: DataFrame, tasks: DataFrame) -> DataFrame:
    """report_id and overall of (report_id, measure, score): the mean by the weights of the report's kind over the measures that it has,
    and, where ``tasks`` (report_id, kind, n_tasks, min_tasks) shows fewer tasks than asked, times their share. Without any weighted measure 0."""
    pairs = [(F.lit(f"{kind}/{m}"), F.lit(w)) for kind, of in WEIGHTS.items() for m, w in of.items()]
    weight = F.try_element_at(F.create_map(*(x for p in pairs for x in p)), F.concat_ws("/", "kind", "measure"))
    rows = tasks.join(scores.filter("score IS NOT NULL"), "report_id", "left").withColumn("w", weight)
    total = F.sum(F.when(F.col("w").isNotNull(), F.col("w") * F.col("score")))
    mean = rows.groupBy("report_id", "n_tasks", "min_tasks").agg((total / F.sum("w")).alias("mean"))
    short = F.when((F.col("min_tasks") > 0) & (F.col("n_tasks") < F.col("min_tasks")), F.col("n_tasks") / F.col("min_tasks")).otherwise(1.0)
    return mean.select("report_id", (r4(F.coalesce("mean", F.lit(0.0))) * short).alias("overall"))


_KINDS = "SELECT report_id, CASE WHEN year % 2 = 0 THEN 'template' ELSE 'freeform' END AS kind, 1 + year % 4 AS n_tasks, CASE WHEN year % 3 = 0 THEN 3 ELSE 0 END AS min_tasks FROM reports"
_SCORES_SQL = f"SELECT report_id, 'number_accuracy' AS measure, accuracy AS score FROM ({_accuracy_sql('true')}) a UNION ALL SELECT report_id, 'anchor_accuracy', accuracy FROM ({_accuracy_sql('verified')}) b UNION ALL SELECT report_id, 'structural_coverage', CASE WHEN contains(text, '未披露') THEN 0.5e0 ELSE 1e0 END FROM reports"
_WEIGHTS_SQL = "(VALUES " + ", ".join(f"('{k}', '{m}', {w}e0)" for k, of in WEIGHTS.items() for m, w in of.items()) + ") w(kind, measure, weight)"
_OVERALL_SQL = f"""SELECT report_id, floor(coalesce(SUM(weight * score) / SUM(weight), 0e0) * 10000 + 0.5) / 10000 * (CASE WHEN MAX(min_tasks) > 0 AND MAX(n_tasks) < MAX(min_tasks) THEN MAX(n_tasks) * 1e0 / MAX(min_tasks) ELSE 1e0 END) AS overall
FROM (SELECT k.report_id, k.n_tasks, k.min_tasks, s.score, w.weight FROM ({_KINDS}) k LEFT JOIN ({_SCORES_SQL}) s ON s.report_id = k.report_id LEFT JOIN {_WEIGHTS_SQL} ON w.kind = k.kind AND w.measure = s.measure) j GROUP BY 1"""


def report_scores(spark: SparkSession, d: str) -> DataFrame:
    """report_id, measure, score of the given reports: numbers, anchors, and whether all parts are there."""
    reports = fixture(spark, d, "reports")
    parts = reports.select("report_id", F.when(F.contains("text", F.lit("未披露")), 0.5).otherwise(1.0).alias("structural_coverage"))
    rows = accuracy(reports, wanted_numbers(spark, d)).withColumnRenamed("accuracy", "number_accuracy").join(parts, "report_id")
    return rows.unpivot(["report_id"], ["number_accuracy", "anchor_accuracy", "structural_coverage"], "measure", "score")


def report_tasks(spark: SparkSession, d: str) -> DataFrame:
    year = F.col("year")
    return fixture(spark, d, "reports").select("report_id", F.when(year % 2 == 0, "template").otherwise("freeform").alias("kind"), (1 + year % 4).alias("n_tasks"), F.when(year % 3 == 0, 3).otherwise(0).alias("min_tasks"))


@query("overall_score", _OVERALL_SQL)
def overall_score(spark: SparkSession, d: str) -> DataFrame:
    return overall(report_scores(spark, d), report_tasks(spark, d))


def against_targets(scores: DataFrame) -> DataFrame:
    """measure, actual (the mean over all reports), target, pass and gap, of the measures that have a target."""
    target = F.try_element_at(F.create_map(*(F.lit(x) for pair in TARGETS.items() for x in pair)), F.col("measure"))
    means = scores.filter("score IS NOT NULL").groupBy("measure").agg(r4(F.sum(F.col("score").cast("decimal(20,4)")).cast("double") / F.count("*")).alias("actual"))
    rows = means.withColumn("target", target).filter("target IS NOT NULL")
    return rows.select("measure", "actual", "target", (F.col("actual") >= F.col("target")).alias("pass"), F.greatest(r4(F.col("target") - F.col("actual")), F.lit(0.0)).alias("gap"))


@query("targets_gap", f"""SELECT measure, actual, target, actual >= target AS pass, greatest(floor((target - actual) * 10000 + 0.5) / 10000, 0e0) AS gap FROM (
SELECT measure, floor(CAST(SUM(CAST(score AS DECIMAL(20,4))) AS DOUBLE) / COUNT(*) * 10000 + 0.5) / 10000 AS actual FROM ({_SCORES_SQL} UNION ALL SELECT report_id, 'overall_score', overall FROM ({_OVERALL_SQL}) o) s GROUP BY 1) a
JOIN (VALUES {', '.join(f"('{m}', {t}e0)" for m, t in TARGETS.items())}) t(name, target) ON t.name = a.measure""")
def targets_gap(spark: SparkSession, d: str) -> DataFrame:
    scores = report_scores(spark, d)
    totals = overall(scores, report_tasks(spark, d)).select("report_id", F.lit("overall_score").alias("measure"), F.col("overall").alias("score"))
    return against_targets(scores.unionByName(totals))


# Words, how far a number may stand from them, its unit, and the metric it is of.
_MONEY, _SHARE = r"\s*(亿元|万元|元)", r"\s*%"
PATTERNS = (
    ("营业收入|营业总收入|营收", 10, _MONEY, "营业收入"), ("营业成本|成本", 10, _MONEY, "营业成本"), ("净利润|归[属母]净利润", 10, _MONEY, "净利润"),
    ("毛利率|销售毛利率", 5, _SHARE, "毛利率"), ("净利率|销售净利率", 5, _SHARE, "净利率"), ("ROE|净资产收益率", 5, _SHARE, "ROE"),
    ("资产负债率|负债率", 5, _SHARE, "资产负债率"), ("总资产", 10, _MONEY, "总资产"), ("净资产|股东权益", 10, _MONEY, "净资产"),
    (r"经营活动[^\n]*?现金流", 10, _MONEY, "经营现金流"), ("总负债", 10, _MONEY, "总负债"), ("流动资产", 10, _MONEY, "流动资产"),
    ("流动负债", 10, _MONEY, "流动负债"), ("研发费用|研发投入", 10, _MONEY, "研发费用"), ("基本每股收益|EPS", 10, r"\s*元", "基本每股收益"),
)
_DATED = r"(20[0-9]{2})年[^\n]*?[0-9]+\.?[0-9]*"


def _pattern(words: str, far: int, unit: str) -> str:
    return rf"(?:{words})[^0-9]{{0,{far}}}?([0-9]+\.?[0-9]*){unit}"


def metrics_by_pattern(docs: DataFrame) -> DataFrame:
    """doc_id, metric, value and key of every metric that a whole text states first in words, number and unit.

    The key ends in the text's main year, the one named most before a number, of several the one named first; without one it is the metric."""
    text = F.coalesce("text", F.lit(""))
    read = F.array(*(F.struct(F.lit(m).alias("metric"), F.nullif(F.regexp_extract(text, _pattern(w, far, u), 1), F.lit("")).try_cast("double").alias("value")) for w, far, u, m in PATTERNS))
    years = F.regexp_extract_all(text, F.lit(_DATED), F.lit(1))
    order = F.transform(F.array_distinct("years"), lambda y: F.struct((-F.size(F.filter("years", lambda z: z == y))).alias("n"), F.array_position(F.col("years"), y).alias("at"), y.alias("year")))
    rows = docs.select("doc_id", F.filter(read, lambda x: x["value"].isNotNull()).alias("found"), years.alias("years")).withColumn("year", F.array_min(order)["year"])
    out = rows.select("doc_id", "year", F.explode("found").alias("f")).select("doc_id", "f.metric", "f.value", "year")
    return out.select("doc_id", "metric", "value", F.concat_ws("_", "metric", "year").alias("key"))


_READ_SQL = " UNION ALL ".join(f"SELECT doc_id, '{m}' AS metric, TRY_CAST(nullif(regexp_extract(text, '{_pattern(w, far, u)}', 1), '') AS DOUBLE) AS value FROM t" for w, far, u, m in PATTERNS)


@query("regex_extract_metrics", f"""WITH t AS (SELECT report_id AS doc_id, text FROM comments), y AS (SELECT doc_id, regexp_extract_all(text, '{_DATED}', 1) AS years FROM t),
m AS (SELECT doc_id, year FROM (SELECT doc_id, year, row_number() OVER (PARTITION BY doc_id ORDER BY COUNT(*) DESC, MIN(k)) AS rn FROM (SELECT doc_id, unnest(years) AS year, generate_subscripts(years, 1) AS k FROM y) e GROUP BY 1, 2) r WHERE rn = 1)
SELECT r.doc_id, metric, value, concat_ws('_', metric, year) AS key FROM ({_READ_SQL}) r LEFT JOIN m ON m.doc_id = r.doc_id WHERE value IS NOT NULL""")
def regex_extract_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics_by_pattern(fixture(spark, d, "comments").select(F.col("report_id").alias("doc_id"), "text"))


# Other words for a part of a report.
SYNONYMS = {"杜邦分解": ("杜邦分析", "杜邦"), "对比": ("vs", "VS", "比较", "对比分析"), "打分": ("评分", "评级", "评估")}
_PARTING = r"[_()（）\s]+"


def coverage(reports: DataFrame, dims: DataFrame) -> DataFrame:
    """report_id, total, found and coverage: of a report's wanted (report_id, dim) parts, how many it speaks of by the whole name, a word
    of it or another word for it, in any case. A name without words is never found; a report without wanted parts covers all.

    A report's names go to its text, so a text is moved once."""
    packed = dims.filter("dim IS NOT NULL").groupBy("report_id").agg(F.collect_list("dim").alias("dims"))
    rows = reports.join(packed, "report_id", "left").select("report_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"), F.coalesce("dims", F.array().cast("array<string>")).alias("dims"))
    words = lambda d: F.concat(F.split(d, _PARTING), *(F.when(F.contains(d, F.lit(k)), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in SYNONYMS.items()))
    met = F.filter("dims", lambda d: F.exists(words(d), lambda w: (w != "") & F.contains(F.col("text"), F.lower(w))))
    total, found = F.size("dims").cast("long"), F.size(met).cast("long")
    return rows.select("report_id", total.alias("total"), found.alias("found")).withColumn("coverage", F.when(F.col("total") == 0, 1.0).otherwise(r4(F.col("found") / F.col("total"))))


DIMS = ("营收_2021", "杜邦分解", "行业对比", "负债率(年末)", "增长 评级")
_OTHER_SQL = " OR ".join(f"(contains(dim, '{k}') AND ({' OR '.join(f'''contains(lower(text), lower('{w}'))''' for w in v)}))" for k, v in SYNONYMS.items())


@query("structural_coverage", f"""SELECT report_id, COUNT(*) AS total, COUNT(*) FILTER (hit) AS found, floor(COUNT(*) FILTER (hit) * 1e0 / COUNT(*) * 10000 + 0.5) / 10000 AS coverage FROM (
SELECT report_id, len(list_filter(regexp_split_to_array(dim, '{_PARTING}'), lambda w: w <> '' AND contains(lower(text), lower(w)))) > 0 OR {_OTHER_SQL} AS hit
FROM (SELECT report_id, text, unnest([{', '.join(f"'{x}'" for x in DIMS)}]) AS dim FROM comments) d) h GROUP BY 1""")
def structural_coverage(spark: SparkSession, d: str) -> DataFrame:
    reports = fixture(spark, d, "comments").select("report_id", "text")
    return coverage(reports, reports.select("report_id", F.explode(F.array(*map(F.lit, DIMS))).alias("dim")))


def render_rate(points: DataFrame, reports: DataFrame) -> DataFrame:
    """report_id, total, valid and rate of (report_id, chart, value) for reports (report_id, expected): a chart is drawn if one of its points has
    a value. The rate is the drawn charts' share, 1 where none was expected and 0 where one was and none was made."""
    charts = points.groupBy("report_id", "chart").agg(F.max(F.col("value").isNotNull()).alias("drawn"))
    counts = charts.groupBy("report_id").agg(F.count("*").alias("total"), F.count_if("drawn").alias("valid"))
    rows = reports.join(counts, "report_id", "left").na.fill(0, ["total", "valid"])
    rate = F.when(~F.col("expected"), 1.0).when(F.col("total") == 0, 0.0).otherwise(r4(F.col("valid") / F.col("total")))
    return rows.select("report_id", "total", "valid", rate.alias("rate"))


@query("chart_render_rate", """SELECT c.symbol AS report_id, coalesce(total, 0) AS total, coalesce(valid, 0) AS valid, CASE WHEN CAST(c.symbol AS INT) % 4 = 0 THEN 1e0 WHEN coalesce(total, 0) = 0 THEN 0e0 ELSE floor(valid * 1e0 / total * 10000 + 0.5) / 10000 END AS rate
FROM companies c LEFT JOIN (SELECT symbol, COUNT(*) AS total, COUNT(*) FILTER (drawn) AS valid FROM (SELECT split_part(chart, '-', 2) AS symbol, chart, bool_or(label IS NOT NULL AND value IS NOT NULL) AS drawn FROM chart_points GROUP BY 1, 2) g GROUP BY 1) n ON n.symbol = c.symbol""")
def chart_render_rate(spark: SparkSession, d: str) -> DataFrame:
    points = fixture(spark, d, "chart_points").select(F.split_part(F.col("chart"), F.lit("-"), F.lit(2)).alias("report_id"), "chart", F.when(F.col("label").isNotNull(), F.col("value")).alias("value"))
    reports = fixture(spark, d, "companies").select(F.col("symbol").alias("report_id"), (F.col("symbol").cast("int") % 4 != 0).alias("expected"))
    return render_rate(points, reports)


#: How far a number of a report may be from an expected one; names of cash flows, which are also written with other roundings; what is too small for an amount.
NEAR, CASH, AMOUNT = 0.02, ("operating_cf", "investing_cf", "financing_cf", "free_cash", "经营现金流", "投资现金流", "筹资现金流", "自由现金流", "capex"), 10
#: Buckets of the logarithm are wider than ``NEAR``, so that a match lies in the same one or in one beside it.
_STEP = 0.03


def _rounded(x: Column, places: int) -> Column:
    return F.signum(x) * F.floor(F.abs(x) * 10**places + 0.5) / 10**places


def _bucket(x: Column) -> Column:
    """Sign and logarithm of a number other than 0, in steps; 0 has a bucket of its own."""
    log = F.floor(F.log(F.abs(x)) / _STEP).cast("long")
    return F.when(F.abs(x) < 1e-6, F.lit(0).cast("long")).otherwise((log + 100_000) * F.signum(x).cast("long"))


def amounts(values: DataFrame) -> DataFrame:
    """(report_id, name, c): what a report may write for each of ``values`` (report_id, name, value).

    As it is, in 万 and in 亿 with two places; cash flows also in 亿 with none, one and four; negative ones also without the sign."""
    v = F.col("value")
    cash = F.lower("name").rlike("|".join(CASH))
    forms = F.array(v, _rounded(v / 1e4, 2), _rounded(v / 1e8, 2))
    forms = F.when(cash, F.concat(forms, F.array(_rounded(_rounded(v / 1e8, 2), 0), _rounded(v / 1e8, 1), _rounded(v / 1e8, 4)))).otherwise(forms)
    forms = F.when(v < 0, F.concat(forms, F.transform(forms, F.abs))).otherwise(forms)
    return values.filter(F.abs(v) >= AMOUNT).select("report_id", "name", F.explode(F.array_distinct(forms)).alias("c"))


def accuracy_in_units(reports: DataFrame, values: DataFrame) -> DataFrame:
    """report_id, total, matched and accuracy: how many of a report's ``values`` stand in its text in some unit.

    Numbers meet amounts in buckets of the logarithm. Nothing to find is an accuracy of 1; a null text has no numbers."""
    numbers = reports.select("report_id", F.explode(F.regexp_extract_all(F.col("text"), F.lit(r"(-?[0-9]+\.?[0-9]*)"), 1)).alias("x")).select("report_id", F.col("x").cast("double").alias("x")).distinct()
    ours, c = numbers.withColumn("bucket", _bucket(F.col("x"))), F.col("c")
    theirs = amounts(values).withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: _bucket(c) + k)))
    near = F.when(F.abs(c) < 1e-6, F.abs(F.col("x")) < 1e-6).otherwise(F.abs(F.col("x") - c) / F.abs(c) < NEAR)
    hits = theirs.join(ours, ["report_id", "bucket"]).filter(near).select("report_id", "name").distinct().withColumn("hit", F.lit(1))
    names = values.filter(F.abs("value") >= AMOUNT).select("report_id", "name").distinct().join(hits, ["report_id", "name"], "left")
    met = names.groupBy("report_id").agg(F.count("*").alias("total"), F.count("hit").alias("matched"))
    out = reports.select("report_id").join(met, "report_id", "left").fillna(0, ["total", "matched"])
    return out.withColumn("accuracy", F.when(F.col("total") == 0, 1.0).otherwise(r4(F.col("matched") / F.col("total"))))


_R = lambda x, k: f"(sign({x}) * floor(abs({x}) * {10**k} + 0.5) / {10**k})"
_AMOUNTS = f"list_concat([value, {_R('(value / 1e4)', 2)}, {_R('(value / 1e8)', 2)}], CASE WHEN regexp_matches(lower(name), '{'|'.join(CASH)}') THEN [{_R(_R('(value / 1e8)', 2), 0)}, {_R('(value / 1e8)', 1)}, {_R('(value / 1e8)', 4)}] ELSE [] END)"


@query("number_accuracy_units", f"""WITH num AS (SELECT report_id, list_transform(regexp_extract_all(text, '-?[0-9]+[.]?[0-9]*'), lambda t: CAST(t AS DOUBLE)) AS xs FROM reports),
form AS (SELECT report_id, name, unnest(list_distinct(CASE WHEN value < 0 THEN list_concat({_AMOUNTS}, list_transform({_AMOUNTS}, lambda a: abs(a))) ELSE {_AMOUNTS} END)) AS c FROM data_values WHERE abs(value) >= 10),
hit AS (SELECT report_id, name, bool_or(len(list_filter(xs, lambda x: CASE WHEN abs(c) < 1e-6 THEN abs(x) < 1e-6 ELSE abs(x - c) / abs(c) < 0.02e0 END)) > 0) AS ok FROM form JOIN num USING (report_id) GROUP BY 1, 2)
SELECT r.report_id, COUNT(ok) AS total, COUNT(*) FILTER (ok) AS matched, CASE WHEN COUNT(ok) = 0 THEN 1e0 ELSE floor(COUNT(*) FILTER (ok) * 1e0 / COUNT(ok) * 10000 + 0.5) / 10000 END AS accuracy FROM reports r LEFT JOIN hit ON r.report_id = hit.report_id GROUP BY r.report_id""")
def number_accuracy_units(spark: SparkSession, d: str) -> DataFrame:
    return accuracy_in_units(fixture(spark, d, "reports"), fixture(spark, d, "data_values"))


def indicators_named(reports: DataFrame, expected: DataFrame) -> DataFrame:
    """report_id, total, found and coverage: how many of the ``expected`` names (report_id, name) a report has, in either case.

    A report of which nothing is expected is covered whole; a null text names nothing."""
    wanted = expected.select("report_id", "name").distinct()
    met = reports.join(wanted, "report_id", "left").withColumn("hit", F.coalesce(F.contains(F.lower("text"), F.lower("name")), F.lit(False)))
    out = met.groupBy("report_id").agg(F.count("name").alias("total"), F.count_if("hit").alias("found"))
    return out.withColumn("coverage", F.when(F.col("total") == 0, 1.0).otherwise(r4(F.col("found") / F.col("total"))))


@query("indicator_coverage", """SELECT r.report_id, COUNT(name) AS total, COUNT(*) FILTER (contains(lower(text), lower(name))) AS found, CASE WHEN COUNT(name) = 0 THEN 1e0 ELSE floor(COUNT(*) FILTER (contains(lower(text), lower(name))) * 1e0 / COUNT(name) * 10000 + 0.5) / 10000 END AS coverage
FROM reports r LEFT JOIN (SELECT DISTINCT report_id, name FROM data_values) v ON r.report_id = v.report_id GROUP BY r.report_id""")
def indicator_coverage(spark: SparkSession, d: str) -> DataFrame:
    return indicators_named(fixture(spark, d, "reports"), fixture(spark, d, "data_values"))
