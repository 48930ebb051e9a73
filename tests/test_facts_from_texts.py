"""Tables, numbers, names and chunks of texts against plain loops."""

import random
import re

import pytest

from factlode.operators import grounding, names, semantic, tables


def plain_facts(text, default_year=None):
    found, year = {}, default_year
    blocks = re.findall(r"(?:^\|[^\n]*\n?)+", text or "", re.M)
    for block in blocks:
        lines = block.rstrip("\n").split("\n")
        if len(lines) < 3:
            continue
        m = re.search(r"20\d{2}", lines[0])
        year = int(m.group()) if m else year
        if not year:
            continue
        for line in lines[1:]:
            cells = [c.strip(" \t\r") for c in line.split("|")[1:-1]]
            if len(cells) < 2 or not cells[0]:
                continue
            words = [w for w in tables.LABELS if w in cells[0]]
            if not words:
                continue
            key = tables.LABELS[max(words, key=len)]
            for c in cells[1:]:
                c = c.replace(",", "").replace(" ", "")
                if re.fullmatch(tables.NUMBER.strip("^$"), c) and float(c) != 0 and abs(float(c)) <= 1e15:
                    found.setdefault((year, key), (float(c), cells[0]))
                    break
    return found


def test_table_facts_of_random_texts(spark):
    r = random.Random(3)
    cell = lambda: r.choice(["1,234.5", "-7", "0", "--", "", "1e3", "9" * 16, "12.", ".5", "不适用", "1 000", "nan", " 3\t"])
    label = lambda: r.choice([*tables.LABELS, "减：营业成本", "非流动负债合计", "其他", "", "流动负债合计（元）"])
    texts = [None, "", "|", "||", "|\n|\n|", "no table", "| 2024 |\n|---|\n| 营业收入 | 5 |", "| a | 2023年 |\r\n|---|\r\n| 存货 | 8 |\r\n"]
    for _ in range(150):
        lines = []
        for _ in range(r.randrange(0, 30)):
            lines.append(r.choice(["", "text | with bar", " | indented |", f"| 项目 | {r.choice(['2021年', '2022', '本期'])} |", "|---|---|", *[f"| {label()} | {cell()} | {cell()} |"] * 6]))
        texts.append("\n".join(lines))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, year string")
    for default in (None, 2019):
        want = {(i, y, k): v for i, t in enumerate(texts) for (y, k), v in plain_facts(t, default).items()}
        got = {(x.doc_id, x.year, x.metric_key): (x.metric_value, x.row_label) for x in tables.table_facts(docs, default).collect()}
        assert got == want
    assert len(want) > 200 and tables.table_facts(docs.filter("1 = 0")).count() == 0


def test_long_tables_are_read_whole(spark):
    text = "| 项目 | 2024 |\n|---|---|\n" + "| 其他 | 1 |\n" * 50_000 + "| 存货 | 7 |"
    docs = spark.createDataFrame([("a", text)], "doc_id string, text string")
    assert [(r.metric_key, r.metric_value) for r in tables.table_facts(docs).collect()] == [("inventory", 7.0)]


def test_longest_words_name_a_row(spark):
    rows = spark.createDataFrame([("非流动负债合计",), ("流动负债合计",), ("负债合计",), ("归属于母公司所有者权益",), ("无",)], "label string")
    from pyspark.sql import functions as F

    got = [r[0] for r in rows.select(tables.metric_of(F.col("label"))).collect()]
    assert got == ["non_current_liabilities", "current_liabilities", "total_liabilities", "equity_attr_parent", None]


def test_numbers_close_derived_or_suspicious(spark):
    reports = [("a", "值200.5, 201.5, 203, 300.45 和 2024 年 100 以及 7，[置信度：95%]\n|---:|\n 9999, 1.5亿")]
    values = [("a", "x", 200.5), ("a", "y", 100.0), ("a", "z", 1.5e8), ("b", "x", 9999.0), ("a", "zero", 0.0)]
    got = grounding.verdicts(spark.createDataFrame(reports, "report_id string, text string"), spark.createDataFrame(values, "report_id string, name string, value double"))
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert {r.number: r.verdict for r in got.collect()} == {"200.5": "close", "201.5": "close", "203": "suspicious", "300.45": "derived", "9999": "suspicious", "1.5": "close"}


@pytest.mark.parametrize("seed", range(3))
def test_verdicts_of_random_numbers(spark, seed):
    r = random.Random(seed)
    values = [("r", f"v{k}", round(r.choice([1, 10, 1e3, 1e6, 1e9]) * r.random() * r.choice([1, 1, -1]), 2)) for k in range(8)]
    known = set()
    for _, _, v in values:
        two = lambda x: __import__("math").floor(x * 100 + 0.5) / 100
        known |= {v} | ({two(v / 1e8)} if abs(v) >= 1e8 else {two(v / 1e4)} if abs(v) >= 1e4 else set())
    known -= {0.0}
    near = [abs(v) * f for v in known for f in (1, 1.0099, 1.0101, 0.9901, 0.9899)] + [abs(a + b) for a in known for b in known] + [r.random() * 10 ** r.randrange(1, 9) for _ in range(200)]
    written = {f"{x:.4f}" for x in near}
    want = {}
    for n in written:
        x = float(n)
        if re.fullmatch(r"20\d\d", n) or n == "100" or ("." not in n and x < 100):
            continue
        close = any(abs(x - v) / abs(v) < 0.01 or abs(x - v) < 0.1 for v in known)
        derived = any(abs(x - (a + b)) < 0.1 or abs(x - abs(a - b)) < 0.1 or (a > 1 and abs(x - abs(100 - a)) < 0.1) or (a != b and abs(x - a / b * 100) < 1) for a in known for b in known)
        want[n] = "close" if close else "derived" if derived else "suspicious"
    reports = spark.createDataFrame([("r", " ; ".join(sorted(written)))], "report_id string, text string")
    got = grounding.verdicts(reports, spark.createDataFrame(values, "report_id string, name string, value double"))
    assert {x.number: x.verdict for x in got.collect()} == want


def test_pairs_of_values_are_not_exchanged(spark):
    import numpy as np

    values = [("r", f"v{k}", 1000.0 + 7 * k * k) for k in range(60)] + [("only values", "v", 5.0)]
    reports = spark.createDataFrame([("r", "2002, 3.1415, 77777"), ("r", "2002 77777"), ("no values", "55555"), (None, "66666.5")], "report_id string, text string")
    got = grounding.verdicts(reports, spark.createDataFrame(values, "report_id string, name string, value double"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Exchange") == 2, plan
    assert sorted((r.report_id or "", r.number, r.verdict) for r in got.collect()) == [("", "66666.5", "suspicious"), ("no values", "55555", "suspicious"), ("r", "3.1415", "derived"), ("r", "77777", "suspicious")]
    x, known = np.array([2002.0, 14.0, 1e9, 50.0]), np.array([1000.0, 2002.0, 7.0, 2000.0])
    whole = grounding.judged(x, known).tolist()
    before, grounding.CELLS = grounding.CELLS, 1
    try:
        assert grounding.judged(x, known).tolist() == whole == [1, 2, 0, 2]
    finally:
        grounding.CELLS = before


def test_names_near_their_numbers(spark):
    gap = lambda n: "，" * n
    rows = []
    for k, n in enumerate((0, 490, 498, 499, 500, 501, 999, 1000, 1500)):
        rows.append((f"r{k}", f"{gap(7 * k)}毛利率{gap(n - 3 if n > 3 else 0)}45.5{gap(40)}"))
    rows += [("before", f"45.5{gap(496)}毛利率"), ("far", f"45.5{gap(497)}毛利率"), ("none", "毛利率未知 46.9"), ("gone", "45.5"), ("loss", "净利润为 3.2 亿"), ("empty", None)]
    reports = spark.createDataFrame(rows, "report_id string, text string")
    wanted = [(r, "毛利率", 45.5, 0.02) for r, _ in rows if r != "loss"] + [("loss", "净利润", -3.2e8, 0.02)]
    got = {r.report_id: r.found for r in grounding.associations(reports, spark.createDataFrame(wanted, "report_id string, name string, expected double, tolerance double")).collect()}
    for r, t in rows:
        name, value = ("净利润", "3.2") if r == "loss" else ("毛利率", "45.5")
        places = [m.start() for m in re.finditer(name, t or "")]
        numbers = [m.start() for m in re.finditer(re.escape(value), t or "")]
        want = "no name" if not places else "no value" if not numbers else "near" if any(abs(a - b) <= 500 for a in places for b in numbers) else "anywhere"
        assert got[r] == want, r
    assert {"near", "anywhere", "no value", "no name"} == set(got.values())


def test_names_inside_names(spark):
    r = random.Random(1)
    texts = lambda n: [(f"{n}{k}", "".join(r.choices("ab中", k=r.randrange(0, 7)))) for k in range(120)] + [(f"{n}null", None)]
    short, long = texts("s"), texts("l")
    frame = lambda rows: spark.createDataFrame(rows, "id string, text string")
    got = {tuple(x) for x in names.inside(frame(short), frame(long)).collect()}
    assert got == {(i, j) for i, a in short for j, b in long if a and b and a in b}


def test_chunks_of_pages():
    r = random.Random(2)
    word = lambda: "".join(r.choices("abcde中文", k=r.randrange(1, 6)))
    for _ in range(300):
        text = "".join(" ".join(word() for _ in range(r.randrange(1, 40))) + r.choice(["。", "！", "\n", ". ", "；"]) for _ in range(r.randrange(0, 40)))
        most, least, tail = r.choice([(1500, 400, 300), (200, 50, 40), (100, 0, 0)])
        got = semantic.chunks(text, least, most, tail / most)
        parts = semantic.sentences(text)
        assert "".join(parts) == "".join(p.strip(" \n") for p in re.findall(semantic.SENTENCE, text))
        if len(text) < most or len(parts) <= 2:
            assert got == ([text.strip()] if text.strip() else [])
            continue
        # A plain fold over the same likeness.
        sims = semantic.likeness(parts)
        low = sum(sims) / len(sims) - (sum((s - sum(sims) / len(sims)) ** 2 for s in sims) / len(sims)) ** 0.5
        want, now = [], parts[0]
        for s, p in zip(sims, parts[1:]):
            if (s < low and len(now) >= least) or len(now) + len(p) > most:
                want.append(now.strip())
                now = (now[-tail:] if tail and len(now) > tail else "") + p
            else:
                now += p
        assert got == [w for w in [*want, now.strip()] if w]


def test_semantic_chunks_cover_every_page(spark, sf):
    pages = semantic.page_texts(spark.read.parquet(f"{sf}/documents.parquet"))
    keys = {(r.doc_id, r.page) for r in pages.select("doc_id", "page").collect()}
    assert {(r.doc_id, r.page) for r in semantic.semantic(pages).collect()} == keys
    null = spark.createDataFrame([(1, None), (2, " \n ")], "doc_id long, text string")
    assert semantic.page_texts(null).count() == 0


def test_least_names_without_pairs(spark):
    r = random.Random(3)
    texts = lambda n: [(f"{n}{k:03}", "".join(r.choices("ab中", k=r.randrange(0, 7)))) for k in range(120)] + [(f"{n}null", None)]
    short, long = texts("s"), texts("l")
    frame = lambda rows: spark.createDataFrame(rows, "id string, text string")
    met = [(i, j) for i, a in short for j, b in long if a and b and a in b]
    assert {tuple(x) for x in names.least_holder(frame(short), frame(long)).collect()} == {(i, min(j for k, j in met if k == i)) for i, _ in met}
    assert {tuple(x) for x in names.least_held(frame(short), frame(long)).collect()} == {(j, min(i for i, k in met if k == j)) for _, j in met}
    assert names.least_held(frame([]), frame(long)).count() == names.least_holder(frame(short), frame([])).count() == 0
