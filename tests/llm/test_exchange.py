"""What the exact search by rare shingles exchanges."""

from pyspark.sql import functions as F

from factlode.llm import neardup


def test_prefixes_are_one_row_a_node(spark):
    same = " ".join(f"w{k}" for k in range(60))
    texts = [same, same, same.upper(), same + " end", " ".join(f"v{k}" for k in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    prefix, spread = neardup.prefixes(docs.select("text"), lambda batch: neardup.different_sets(batch.column("text"), 5), 500, 75)
    rows = prefix.collect()
    assert len(rows) == len({bytes(r.node) for r in rows}) == 2
    assert all(len(r["items"]) == len(r["at"]) and list(r["at"]) == sorted(r["at"]) for r in rows)
    nothing = spark.createDataFrame([], "node binary, component binary")
    pairs, _ = neardup.across(prefix, nothing, 75, spread)
    assert pairs.count() == 1
    whole = prefix.select("node").withColumn("component", prefix["node"]).limit(0).unionByName(spark.createDataFrame([(r.node, rows[0].node) for r in rows], "node binary, component binary"))
    assert neardup.across(prefix, whole, 75, spread)[0].isEmpty()


def edited(seed, families, copies, words, edits):
    """Texts of a few families, each copy with so many words of its own."""
    import random

    r, out = random.Random(seed), []
    for f in range(families):
        base = [f"w{f}x{k}" for k in range(words)]
        for _ in range(copies):
            text = list(base)
            for k in r.sample(range(words), edits):
                text[k] = f"own{r.randrange(10**12)}"
            out.append(" ".join(text))
    return out


def test_outlines_rule_out_pairs_and_no_similar_one(spark, monkeypatch):
    import itertools

    import numpy as np

    from factlode.llm import partenum as pe

    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 8, 9, 60, 400, 512, 513, 3000):
        whole = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64))
        for lost, more in ((0, 0), (n // 20, n // 9), (n // 7, 0), (0, n // 4)):
            part = np.unique(np.concatenate([whole[lost:], rng.integers(0, 1 << 63, more, dtype=np.uint64)]))
            assert pe.apart_in(pe.outline(whole), pe.outline(part)) <= len(np.setxor1d(whole, part))
    # Copies with 4 of 200 words of their own are at 0.72; before, the full sets of each such pair were moved.
    texts = edited(1, 3, 12, 200, 4) + edited(2, 1, 4, 200, 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    moved, verify = [], pe.verified
    monkeypatch.setattr(pe, "verified", lambda pairs, *rest: moved.extend(pairs.collect()) or verify(pairs, *rest))
    got = {r.doc_id: r.component_id for r in pe.similar_groups(docs).collect()}
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in (t.split() for t in texts)]
    want = {k: k for k in range(len(texts))}
    for a, b in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            lo, hi = sorted((want[a], want[b]))
            want = {k: lo if v == hi else v for k, v in want.items()}
    assert got == want and len(set(want.values())) < len(want)
    assert len(moved) < 20


def test_pairs_that_share_many_rare_shingles_meet_seldom(spark):
    texts = edited(3, 2, 10, 400, 6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prefix, spread = neardup.prefixes(docs.select("text"), lambda batch: neardup.different_sets(batch.column("text"), 4), 10_000, 85)
    nothing = spark.createDataFrame([], "node binary, component binary")
    pairs, placed = neardup.across(prefix, nothing, 85, spread)
    met, plain = neardup.meetings(placed, 85).count(), neardup.meetings(placed.withColumns({c: F.lit(None).cast("long") for c in ("before", "earlier")}), 85)
    assert plain.distinct().exceptAll(pairs).isEmpty() and pairs.count() == plain.distinct().count() > 60
    assert 2 * met < plain.count()


def test_codec_leaves_the_worker_before_the_next_query(spark):
    import pyarrow as pa

    from factlode.llm import bpe

    text = pa.RecordBatch.from_pydict({"doc_id": [1], "at": [1], "text": ["some words that are looked at once more"]})
    bpe.codec(bpe.word_vocabulary()).encode(text["text"].to_pylist())
    assert bpe.codec.cache_info().currsize == 1
    assert [r.num_rows for r in neardup._sketch(iter([text]))] == [1]
    assert bpe.codec.cache_info().currsize == 0
