"""Files, sinks, JSON in free text, terms, and ranking after boosts."""

import json
import os
import random

from pyspark.sql import functions as F

from factlode.operators import files, retrieval, search


def test_files_in_two_encodings(spark, tmp_path):
    os.makedirs(tmp_path / "in" / "deep")
    put = {"a.txt": "  你好\n".encode(), "b.txt": "世界，报告".encode("gbk"), "c.md": b"# t\r\n", "d.txt": b"", "e.txt": b" \n\t", "deep/f.txt": b"ok\xff\xfe\xffx", "g.pdf": b"no"}
    for name, raw in put.items():
        (tmp_path / "in" / name).write_bytes(raw)
    got = {r.source: (r.page, r.text) for r in files.scan_files(spark, f"file://{tmp_path}/in").collect()}
    bad = files._gbk(b"ok\xff\xfe\xffx")
    assert got == {"a.txt": (1, "你好"), "b.txt": (1, "世界，报告"), "c.md": (1, "# t"), "f.txt": (1, bad)}
    assert bad.startswith("ok") and "�" in bad


def test_chunks_written_twice_stay_once(spark, tmp_path):
    path = f"file://{tmp_path}/chunks"
    rows = lambda source, n: spark.createDataFrame([(source, 1, k, f"{source}{k}") for k in range(n)], "source string, doc_id long, pos long, content string")
    for chunks in (rows("a", 5).unionByName(rows("b", 3)), rows("a", 5), rows("b", 2)):
        files.put_chunks(files.with_ids(chunks), path)
    got = sorted((r.source, r.id) for r in spark.read.parquet(path).collect())
    assert got == [("a", f"a_p1_{k}") for k in range(5)] + [("b", f"b_p1_{k}") for k in range(2)]


def test_first_objects_of_noisy_texts(spark):
    r = random.Random(4)
    value = lambda d: r.choice([1, None, 'q"uo\\te}', "{,]", "", "中", *([{f"k{r.randrange(3)}": value(d - 1)}, [value(d - 1)] * 2] if d else [])])
    for _ in range(2000):
        want = {f"k{k}": value(3) for k in range(r.randrange(0, 4))}
        text = json.dumps(want, ensure_ascii=False, indent=r.choice([None, 2]))
        noisy = text + r.choice(["", "以上", "{\"b\": 2}", " } ,"])
        if r.random() < 0.5:
            noisy = f"```json\n{noisy}\n```"
        assert json.loads(files.first_object(noisy)) == want
    assert json.loads(files.first_object('{"a": [1, 2, ], }')) == {"a": [1, 2]}
    assert [files.first_object(t) for t in (None, "", "no object", "```\n{\"open\": 1")] == [None, "", "no object", '{"open": 1']


def test_terms_expand_like_a_plain_loop(spark, sf):
    def plain(text):
        out, taken = text, set()
        for term in sorted(files.TERMS, key=len, reverse=True):
            at = text.find(term)
            if files.TERMS[term] in text or at < 0 or taken & set(range(at, at + len(term))):
                continue
            taken |= set(range(at, at + len(term)))
            out = out.replace(term, f"{term}({files.TERMS[term]})", 1)
        return out

    texts = ["", "ROE和ROE", "资产负债率", "负债率", "归母净利润是多少", "营收增长率和营收", *(r.query for r in files.spoken(spark, sf).collect())]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = {r.t: r.e for r in rows.select("t", files.expanded(F.col("t")).alias("e")).collect()}
    assert got == {t: plain(t) for t in texts} | {None: None}


def test_an_eleventh_document_wins_by_its_boost(spark):
    same = "gross margin of the year"
    docs = spark.createDataFrame([(k, f"{same} {'filler ' * (40 + k)}") for k in range(1, 15)] + [(k, "other words here") for k in range(20, 60)], "doc_id long, text string")
    corpus = docs.select("doc_id", F.when(F.col("doc_id") == 12, "NATION_3").otherwise("NATION_1").alias("entity"), F.lit("plain.txt").alias("source"))
    asked = spark.createDataFrame([(1, "PERU 2020 gross margin")], "qid long, query string")
    nations = spark.createDataFrame([("PERU", 3), ("CHINA", 4)], "n_name string, n_nationkey int")
    plain = [r.doc_id for r in search.bm25(docs, asked.select(F.col("qid").alias("item_id"), F.col("query").alias("text"))).orderBy("rank").collect()]
    assert 12 not in plain and len(plain) == 10
    got = retrieval.boosted(docs, corpus, asked, nations).orderBy(F.desc("score")).collect()
    assert got[0].doc_id == 12 and len(got) == 10
    # A source without a year gets no boost for one.
    scores = {r.doc_id: r.score for r in search.bm25(docs, asked.select(F.col("qid").alias("item_id"), F.col("query").alias("text")), top=None).collect()}
    assert got[0].score == scores[12] * 1.5 and all(r.score == scores[r.doc_id] for r in got[1:])


def test_measures_look_at_whole_items(spark):
    rows = spark.createDataFrame([(1, 1, ["a"], 2), (1, 2, [], 2), (1, 3, ["a", "b"], 2), (2, 1, [], 3), (2, 9, ["c"], 3)], "item_id int, rank int, found array<string>, wanted int")
    got = {r.item_id: r for r in rows.groupBy("item_id").agg(search.recall(1).alias("r1"), search.recall(3).alias("r3"), search.precision(3).alias("p3"), search.reciprocal_rank().alias("rr"), search.ndcg().alias("n")).collect()}
    assert (got[1].r1, got[1].r3, got[1].rr, got[2].r3, got[2].rr, got[2].n) == (0.5, 1.0, 1.0, 0.0, 1 / 9, 0.0)
    assert abs(got[1].p3 - 2 / 3) < 1e-12 and abs(got[1].n - (1 + 2 / 2) / (1 + 0.6309297535714575)) < 1e-6
    words = spark.createDataFrame([("bb a ccc bb dddd ee fff",)], "t string").select(search.keywords(F.col("t"))).first()[0]
    assert words == ["dddd", "ccc", "fff", "bb", "ee"]
