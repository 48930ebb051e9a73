"""Operators against brute force on small tables with nulls, empty, long, tied and repeated rows."""

import collections
import hashlib
import random
import re
import zlib

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice(["an", "de", "is", "th", "É", "o"]) for _ in range(r.randrange(1, 4)))
    make = lambda n: " ".join(word() for _ in range(n))
    shared, long = make(80), make(3000)
    near = shared.split()
    near[40] = "changed"
    rows = [None, "", "  \n ", "one two", "one two", shared, shared, " ".join(near), f"{make(60)}\n{shared}\n{make(70)}", long, long[:9000] + " tail", "k" * 400, "k" * 401, "ab" * 700]
    rows += [make(120) for _ in range(12)] + [f"mail jo.do@ex.org +1 (377) 555-0271 ip 10.0.0.1 card 4111111111111111 {make(30)}"]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 10, t, "x", 1) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[5], (None, "a b c d e f", "x", 1)], "doc_id long, text string, words string, key int").repartition(3)


def with_id(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def empty(docs):
    return docs.filter("1 = 0")


def same(rows, want):
    assert collections.Counter(map(tuple, rows)) == collections.Counter(want)


def test_token_store(spark, docs, tmp_path):
    import numpy as np
    from tokenizers import Tokenizer

    from factlode.llm import tokenstore as ts

    tk, at = Tokenizer.from_file(ts.byte_vocabulary()), f"file://{tmp_path}/store"
    ts.write_store(docs, ts.byte_vocabulary(), at)
    got = sorted(ts.checksums(spark, at).collect(), key=lambda r: r.start)
    ids = {(i, t): [*tk.encode(t, add_special_tokens=False).ids, 0] for i, t in with_id(docs)}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], [(i, len(ids[i, t]), crc(ids[i, t])) for i, t in with_id(docs)])
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(r.doc_id for r in got if r.doc_id is not None)
    same([(r.doc_id, tuple(r.ids)) for r in ts.restore(spark, at).collect()], [(i, tuple(ids[i, t])) for i, t in with_id(docs)])
    assert ts.verify_manifest(spark, at).count() == 0


def test_urls(spark):
    from factlode.llm.urls import filter_urls

    urls = [None, "no scheme", "http://A.Example.COM/en/7x?q", "http://x.com/en/1", "http://b.example.net/de/80", "http://net/de/1", "http://spam.io/p#f", "http://spam.io/p#f"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([("spam.io/p",), (None,)], "url_key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, listed).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[3] == ("x.com", "/en/1", "com/en/", "block")
    assert got[4][2:] == ("example.net/de/8", "block") and got[5][2:] == ("net/de/", "allow")
    assert got[6] == got[7] == ("spam.io", "/p", None, "block")


def test_quality(spark, docs):
    from factlode.llm.quality import quality_rules

    labels = spark.createDataFrame([(i * 10, 1, 0) for i in range(14, 26)], "doc_id long, quality int, toxic int")
    got = quality_rules(docs, labels).collect()
    want = []
    for i, t in with_id(docs):
        w, seen, dup = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        many = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {j for k in range(len(w) - 4) if many[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)))
    same([r[:7] for r in got], want)
    assert not any(r.kept and r.base_failed for r in got) and quality_rules(empty(docs), labels).count() == 0


def test_ppm(spark, docs):
    import numpy as np

    from factlode.llm import ppm

    got = ppm.scores(docs).collect()
    assert len(got) == docs.count() and all(np.isfinite(r.score) and r.score <= 0 for r in got)
    model = ppm.trained(ppm.gather(docs))
    # After any context, the 256 symbols' probabilities add up to 1.
    for context in (b"\xff\xff\xff\xff", b"deis", b"zzzz", b"an d"):
        keys = (int.from_bytes(context, "big") << 8) + np.arange(256)
        assert abs((10.0 ** model.log10(keys)).sum() - 1) < 1e-9
    assert ppm.scores(empty(docs)).count() == 0


@pytest.mark.parametrize("fast", [0, 300, None])
def test_ppm_keeps_rare_strings(spark, docs, fast, monkeypatch):
    import math

    from factlode.llm import ppm

    if fast is not None:
        monkeypatch.setattr(ppm, "FAST", fast)
    # So much common text that a string met once or twice has less than 2^-20 of all training bytes.
    common = [(i, "x y z " * 15_000) for i in range(1000, 1070)]
    more = spark.createDataFrame([*common, (2000, "x y an deisq\xe9 \u4e2d\u6587")], "doc_id long, text string")
    rows = with_id(docs) + with_id(more)
    bytes_of = lambda t: b"\xff" * 4 + t.encode() + b"\xff"
    seen = collections.defaultdict(collections.Counter)
    for t, times in collections.Counter(t for i, t in rows if not ppm.held_out(i)).items():
        b = bytes_of(t)
        for k in range(4, len(b)):
            for n in range(5):
                seen[b[k - n : k]][b[k]] += times

    def value(b):
        got, out = 0.0, set()
        for n in range(4, -1, -1):
            after = {s: c for s, c in seen.get(b[4 - n : 4], {}).items() if s not in out}
            if after:
                room = sum(after.values()) + len(after)
                if b[4] in after:
                    return got + math.log10(after[b[4]] / room)
                got += math.log10(len(after) / room)
                out |= set(after)
        return got - math.log10(256 - len(out))

    known = {}
    for t in {t for _, t in rows}:
        b = bytes_of(t)
        known[t] = sum(value(s) * c for s, c in collections.Counter(b[k - 4 : k + 1] for k in range(4, len(b))).items())
    want = sorted(((-1 if i is None else i, known[t]) for i, t in rows))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in ppm.scores(docs.select("doc_id", "text").unionByName(more)).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-9)


@pytest.mark.parametrize("hot", [2, 400])
def test_suffixes(docs, hot, monkeypatch):
    from factlode.llm import suffixes

    monkeypatch.setattr(suffixes, "HOT", hot)
    rows = [(i, t.encode()) for i, t in with_id(docs)]
    many = collections.Counter(b[k : k + 400] for _, b in rows for k in range(len(b) - 399))
    want = []
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if many[b[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept))
    same([(*r[:5], bytes(r.kept)) for r in suffixes.drop_repeats(docs).collect()], want)
    assert suffixes.drop_repeats(empty(docs)).count() == 0


@pytest.mark.parametrize("hot", [2, 400])
def test_phrases(docs, hot, monkeypatch):
    from factlode.llm import phrases

    monkeypatch.setattr(phrases, "HOT", hot)
    rows = [(i, WORD.findall(t)) for i, t in with_id(docs)]
    owner = {}
    for i, w in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for k in range(len(w) - 12):
            owner.setdefault(tuple(w[k : k + 13]), i)
    want = []
    for i, w in rows:
        gone = {j for k in range(len(w) - 12) if i is not None and owner[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    same(phrases.drop_repeats(docs).collect(), want)
    assert phrases.drop_repeats(empty(docs)).count() == 0


def test_bpe(docs):
    from tokenizers import Tokenizer

    from factlode.llm import bpe

    tk = Tokenizer.from_file(bpe.word_vocabulary())
    want = []
    for i, t in with_id(docs):
        ids = tk.encode(t, add_special_tokens=False).ids
        want.append((i, " ".join(map(str, ids)), tk.decode(ids, skip_special_tokens=False)))
    same(bpe.encode_decode(docs, bpe.word_vocabulary()).collect(), want)


def test_pii(docs):
    from factlode.llm import pii

    trees = pii.train(docs)
    got = {r.doc_id: r for r in pii.personal_data(docs, trees).collect()}
    found = next(r for r in got.values() if r.n_email)
    assert (found.n_email, found.n_ip, found.n_card, found.n_phone) == (1, 1, 1, 1)
    assert all(r.spans == "" for i, r in got.items() if r is not found)
    assert "<EMAIL>" in next(r.text for r in pii.redacted(docs, trees).collect() if r.doc_id == found.doc_id)
    assert pii.train(empty(docs)) is None


def test_decontaminate(spark, docs):
    from factlode.llm import decontaminate as dc

    r = random.Random(1)
    for _ in range(60):
        p, t = ("".join(r.choice("abc") for _ in range(r.randrange(1, n))) for n in (70, 90))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, e in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
            row = new
        assert dc.myers(p, t, len(p)) == (min(row), row.index(min(row)))
    item = " ".join(texts()[5].split()[:40])
    items = spark.createDataFrame([(1, item), (2, item.replace("an", "am", 1)), (3, None), (4, "short")], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in dc.contaminated(docs, items).collect()}
    assert got[50, 1] == 0 and got[50, 2] == 1 and {i for _, i in got} == {1, 2}
    left = {x.doc_id for x in dc.clean(docs, items).collect()}
    assert 50 not in left and 90 in left and dc.contaminated(docs, empty(items)).count() == 0


def test_decontaminate_short_and_unnamed(spark):
    from factlode.llm import decontaminate as dc

    long = "which of these rivers flows through the old capital"
    items = spark.createDataFrame([(1, "the end?"), (2, "法国的首都是哪里"), (3, "capital of france"), (4, "art"), (None, long), (None, "  "), (5, "")], "item_id long, text string")
    texts = ["so is THE  end? yes", "the ends", "请问法国的首都是哪里呢", "a capitol of france, too", "acapital of francex", "start", "an art.", f"x {long} y", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance, plain_of[r.start : r.stop]) for r in dc.contaminated(docs, items).collect() for plain_of in [dc.plain(texts[r.doc_id])]}
    assert got == {(0, 1, 0, "the end?"), (2, 2, 0, "法国的首都是哪里"), (3, 3, 1, "capitol of france"), (6, 4, 0, "art"), (7, -1, 0, long)}
    assert {r.doc_id for r in dc.clean(docs, items).collect()} == {1, 4, 5, 8, 9}
    r = random.Random(2)
    for _ in range(300):
        a, b = ("".join(r.choice("ab") for _ in range(r.randrange(1, 7))) for _ in range(2))
        near = a == b or any(a[:k] + c + a[k + d :] == b for k in range(len(a) + 1) for c, d in (("", 1), ("a", 0), ("b", 0), ("a", 1), ("b", 1)))
        assert (dc.differ(a, b) < 2) == near and (dc.differ(a, b) == 0) == (a == b)


def test_near_duplicates(docs):
    from factlode.llm.neardup import near_duplicates

    sets = {}
    for i, t in with_id(docs):
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t))
        sets.setdefault(i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    ids = sorted(i for i in sets if i is not None)
    part = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    part[a] = part[b] = min(part[a], part[b])
    got = near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), part[r.doc_id], part[r.doc_id] == r.doc_id)
    assert near_duplicates(empty(docs)).count() == 0


def test_near_duplicates_by_row(spark):
    from factlode.llm import neardup

    word = lambda k, n: [f"w{k}x{j}" for j in range(n)]
    text = lambda k, end="": " ".join(word(k, 60) + ([end] if end else []))
    rows = [
        (1, text(0)), (2, text(1)), (7, text(0, "z")), (7, text(1, "z")), (7, text(2)),  # one id, three texts: two are near copies
        (None, text(3)), (None, text(3)), (None, text(3, "z")), (None, text(4)), (None, text(0, "y")),  # rows without id
        (9, text(5)), (9, text(5)), (None, ""), (None, None),
    ]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int").repartition(3)
    got = collections.Counter((r.doc_id, r.component_id) for r in neardup.near_duplicates(docs).collect())
    assert got == collections.Counter([(1, 1), (2, 2), (7, 1), (7, 2), (7, 7), (None, 1), *[(None, None)] * 6, (9, 9), (9, 9)])
    left = {r.k for r in neardup.stage(spark, docs, "").collect()}
    assert {0, 1, 4, 8, 12, 13} <= left and not {2, 3, 9} & left
    assert len({5, 6, 7} & left) == 1 and len({10, 11} & left) == 1 and len(left) == 8


def test_pipeline(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(cp.STAGES):
        before, docs = docs, stage(spark, docs, sf)
        if k < len(cp.STAGES) - 1:
            assert docs.columns == before.columns
    assert {r.doc_id for r in cp.run(spark, sf).collect()} == {r.doc_id for r in docs.collect()}


def test_span_hashes_part_thue_morse_strings():
    import numpy as np

    from factlode.llm import textkit as tk

    a, b = b"a", b"b"
    for _ in range(12):
        a, b = a + b, b + a
    n, data = len(a), np.frombuffer(a + b, np.uint8)
    h = tk.Spans(data)(np.array([0, n]), np.array([n, 2 * n]))
    assert h[0] != h[1]
    twice = tk.Spans(np.frombuffer(a + a, np.uint8))(np.array([0, n]), np.array([n, 2 * n]))
    assert twice[0] == twice[1] == h[0]


def test_near_duplicates_part_thue_morse_words(spark):
    from factlode.llm import neardup

    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    rows = spark.createDataFrame([(1, f"{a} x"), (2, f"{b} x"), (3, f"{a} x")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(rows).collect()) == [(1, 1), (2, 2), (3, 1)]


def test_base_spans_equal_plain_patterns():
    from factlode.llm import pii

    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    r = random.Random(4)
    for _ in range(20_000):
        t = "".join(r.choices("a1@.-_ @.b2 5.", k=r.randrange(1, 26)))
        want = [(*m.span(), "email") for m in email.finditer(t)]
        want += [(*m.span(), "ip") for m in ip.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
        assert sorted(s for s in pii.base_spans(t) if s[2] in ("email", "ip")) == sorted(want), t


@pytest.mark.parametrize("width", [64, 8, 1])
def test_pieces_cover_each_window_once(width):
    import numpy as np

    from factlode.llm import suffixes as sx

    r = random.Random(2)
    passage = bytes(r.choices(b"ab", k=500))
    content = bytes(r.choices(b"abc", k=300)) + passage + bytes(r.choices(b"abc", k=300)) + b"x" * 700 + passage
    data = np.frombuffer(content, np.uint8)
    offsets = np.array([0, len(data)])
    first, many, anchor = sx.Grams(data, offsets).runs(np.full(1024, 2**64 - 1, np.uint64), offsets)
    assert many.sum() == len(content) - sx.LENGTH + 1
    for f, m, a in zip(first, many, anchor.view(np.int64), strict=True):
        segment = content[f : f + m + sx.LENGTH - 1]
        met = [s + k for (core, p), starts in sx.pieces(segment, int(a), width).items() for s in starts for k in range(len(p) - sx.LENGTH + 1) if core in p and segment[s : s + len(p)] == p]
        assert sorted(met) == list(range(m))


def test_components_of_paths_and_stars(spark):
    from factlode.llm import neardup

    path = [(k, k + 1) for k in range(40)]
    star = [(100, k) for k in range(101, 130)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    parts = neardup.components(frame([*path, *star, *path[:5], (7, 7)]))
    assert {(r.node, r.component) for r in parts.collect()} == {(k, 0) for k in range(41)} | {(k, 100) for k in range(100, 130)}
    more = neardup.joined(parts, frame([(129, 33), (200, 201)]))
    assert {(r.node, r.component) for r in more.collect()} == {(k, 0) for k in [*range(41), *range(100, 130)]} | {(200, 200), (201, 200)}
    assert neardup.components(frame([])).count() == 0


@pytest.mark.parametrize("name", ["op2_token_store", "op7_bpe", "op9_pii"])
def test_queries_of_empty_tables(spark, docs, tmp_path, name):
    from factlode.llm import registry

    empty(docs).write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.queries()[name](spark, str(tmp_path)).collect() == []
