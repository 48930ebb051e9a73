"""Fill-in-the-middle, similarity join and turn repair against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(8)
    make = lambda n: " ".join("".join(r.choice(["an", "de", "Is", "th", "É", "中", "-", "😀"]) for _ in range(r.randrange(1, 4))) for _ in range(n))
    texts = [None, "", " \n\t", "a", "ab", "abcdefg", "abcdefgh", "abcdefghi", "é" * 8, "\x00\x00", "a\x00b", "has <P> in it", "a<", "<S", "x" * 100_000, make(3000), "one two", "One  two"]
    texts += [make(r.randrange(1, 60)) for _ in range(150)]
    base = make(300).split()
    for k in range(1, 30):
        near = list(base)
        for _ in range(k):
            near[r.randrange(len(near))] = f"w{k}"
        texts.append(" ".join(near))
    rows = [(i * 3, t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[15], (None, "a b c d e f", "x", 1), (None, base and " ".join(base), "x", 1)], "doc_id long, text string, words string, key int").repartition(3)


def test_fill_in_middle(docs):
    from factlode.llm import fim

    want = []
    for r in docs.collect():
        t = r.text or ""
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
        h = hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        n = len(units)
        lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b, c = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
        if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            want.append((r.doc_id, n, "plain", None, None, sha(t), sha(t)))
        elif h4 % 100 < 20:
            want.append((r.doc_id, n, "spm", len(a), len(b), sha(f"<S>{c}<P>{a}<M>{b}"), sha(t)))
        else:
            want.append((r.doc_id, n, "psm", len(a), len(b), sha(f"<P>{a}<S>{c}<M>{b}"), sha(t)))
    assert collections.Counter(map(tuple, fim.digests(docs).collect())) == collections.Counter(want)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    back = fim.restore(fim.transform(docs))
    assert collections.Counter(map(tuple, back.collect())) == collections.Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert fim.digests(docs.filter("1 = 0")).count() == 0


def test_unit_ends_of_every_offset():
    import numpy as np

    from factlode.llm import fim

    r = random.Random(1)
    texts = ["".join(r.choices("aZ[`{@ é中😀\x00-", k=r.randrange(0, 40))) for _ in range(500)]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    units = fim.Units(np.frombuffer(b"".join(raw), np.uint8), offsets)
    want = [re.findall(r"[A-Za-z]+|[^A-Za-z]", t) for t in texts]
    assert units.count.tolist() == list(map(len, want))
    for k in range(40):
        at = np.minimum(k, units.count)
        assert units.offset(at).tolist() == [len("".join(w[: int(j)]).encode()) for w, j in zip(want, at, strict=True)]


def shingles(t, k):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def groups(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    part = list(range(len(rows)))

    def top(a):
        while part[a] != a:
            a = part[a]
        return a

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            part[top(a)] = top(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[top(a)] = min(i, least.get(top(a), i))
    return collections.Counter((i, len(sets[a]), least.get(top(a))) for a, (i, _) in enumerate(rows))


def test_jaccard_join(docs):
    from factlode.llm.partenum import similar_groups

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = groups(rows, 4, 85)
    assert collections.Counter(map(tuple, similar_groups(docs).collect())) == want
    assert len({c for _, _, c in want}) < len(want) - 5
    assert similar_groups(docs.filter("1 = 0")).count() == 0


def test_jaccard_join_of_short_and_just_similar_texts(spark):
    from factlode.llm.partenum import similar_groups

    r = random.Random(3)
    rows = []
    for n in (7, 8, 9, 13, 14, 20, 27, 40, 60, 100, 139):
        for _ in range(6):
            words = [f"v{r.randrange(10**9)}" for _ in range(n)]
            rows.append((len(rows), " ".join(words)))
            for cut in (1, max(1, n * 15 // 200), n * 15 // 100, n * 16 // 100 + 1):
                rows.append((len(rows), " ".join(words[cut:])))
                rows.append((len(rows), " ".join([*words, *(f"z{r.randrange(10**9)}" for _ in range(cut))])))
    got = similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert collections.Counter(map(tuple, got.collect())) == groups(rows, 4, 85)


@pytest.mark.parametrize("percent", [85, 75, 50])
def test_similar_sets_share_a_signature(percent):
    import numpy as np

    from factlode.llm import partenum as pe

    r = np.random.default_rng(percent)
    for _ in range(2):
        for _ in range(1500):
            both = int(r.integers(1, 400))
            apart = int(both * (100 - percent) / percent)
            x = int(r.integers(0, apart + 1))
            items = r.integers(0, 1 << 64, both + apart, dtype=np.uint64)
            # Few different values in the top bits make empty projections usual.
            if r.random() < 0.5:
                items = (items % np.uint64(1 << 58)) + (r.integers(0, 3, len(items), dtype=np.uint64) << np.uint64(62))
            a, b = np.sort(items[: both + x]), np.sort(np.concatenate([items[:both], items[both + x :]]))
            assert len(np.intersect1d(pe.signatures(a, percent), pe.signatures(b, percent))) or np.array_equal(a, b) or pe.scheme(max(pe.tags(len(b), percent)), percent) is None


def plain_repair(codes):
    """Least (cost, audit) by trying all edits over the grammar's states."""
    best = {}

    def go(i, state, seen):
        if not seen and (i, state) in best:
            return best[i, state]
        found = []
        if i == len(codes):
            if state in (0, 3):
                found.append((0, ""))
        else:
            own, forced, cut = codes[i] & 3, codes[i] & 4, codes[i] & 8
            add = lambda cost, letter, rest: found.append((cost + rest[0], letter + rest[1]))
            add(3, "D", go(i + 1, state, 0))
            if not forced:
                nxt = 3 if state == 2 else 2
                if own == 0 and state == 0:
                    add(bool(cut), "K", go(i + 1, 1, 0))
                if own == (2 if state == 2 else 1):
                    add(bool(cut), "K", go(i + 1, nxt, 0))
                add(2 + bool(cut), "R", go(i + 1, nxt, 0))
        if seen < 3:
            rest = go(i, 3 if state == 2 else 2, seen + 1)
            found.append((2 + rest[0], "I" + rest[1]))
        out = min(found, default=(1 << 30, ""))
        if not seen:
            best[i, state] = out
        return out

    return go(0, 0, 0)


@pytest.mark.parametrize("piece", [1024, 3, 1])
def test_least_audits(piece, monkeypatch):
    from factlode.llm import turns

    monkeypatch.setattr(turns, "PIECE", piece)
    r = random.Random(piece)
    for _ in range(1500):
        codes = bytes(r.choice([0, 1, 1, 2, 2, 3]) | r.choice([0, 0, 0, 4, 8]) for _ in range(r.randrange(0, 13)))
        want = plain_repair(codes)
        assert turns.chained(codes) == want, list(codes)


def conversation_rows():
    r = random.Random(6)
    rows = []
    for c in range(80):
        for t in range(r.randrange(1, 9)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", r.choice(["Yes. ", "No?", "cut off", "", " \t", "Fine!", f"text {r.randrange(9)}."])))
    rows += [(90, None, "system", "Be brief."), (90, 0, None, "Hello."), (90, 0, "assistant", None), (90, 5, "tool", "x."), (None, 1, "user", "a."), (None, 2, "assistant", "b."), (91, 3, "user", "same."), (91, 3, "user", "same.")]
    rows += [(92, t, r.choice(["user", "assistant", "system", ""]), f"turn {t}.") for t in range(300)]
    return rows


def wanted(rows):
    """Each conversation's result, with the cost and audit of plain_repair."""
    out = {}
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for conv, turns_ in convs.items():
        left = []
        for turn, role, text in turns_:
            k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            left += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        left.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).digest()))
        numbers = [t for t, _, _ in left if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        seen, codes, counts = set(), [], collections.Counter()
        for _, role, text in left:
            solid = WORD.findall(text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1][-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            codes.append(("sua".find(role[:1]) if role and role[0] in "sua" else 3) | (4 if fault in ("blank", "duplicate") else 8 if fault else 0))
        initials = [r[:1] for _, r, _ in left]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = plain_repair(codes)
        lines, at, user = [], 0, True
        for letter in audit:
            role, text = ("", "") if letter == "I" else left[at][1:]
            at += letter != "I"
            if letter == "D":
                continue
            if letter != "K":
                role = "user" if user else "assistant"
            if role[0] != "s" or letter != "K":
                user = not user
            lines.append(f"{role}:{text}")
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha("\n".join(lines)))
    return out


def test_turn_repair(spark):
    from factlode.llm import turns

    rows = conversation_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, digest int").repartition(3)
    want = wanted(rows)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in turns.repairs(df).collect()}
    assert got == want
    assert turns.repairs(df.filter("1 = 0")).count() == 0
    # The repaired turns themselves follow the grammar and give the same digests.
    damaged = turns.damaged(df)
    kept = collections.defaultdict(list)
    for r in sorted(turns.repaired(damaged, turns.audits(damaged)).collect(), key=lambda r: r.at):
        kept[r.conv_id].append(r)
    for conv, (*_, digest) in want.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in kept[conv]))
        assert sha("\n".join(f"{r.role}:{r.text}" for r in kept[conv])) == digest


@pytest.mark.parametrize("percent", [75, 85])
def test_exact_search_needs_no_buckets(spark, percent):
    """Every pair that similar is found by its rare shingles alone, at the bound as well."""
    from factlode.llm import neardup

    r = random.Random(percent)
    rows = []
    for n in (4, 8, 20, 40, 150, 151):
        for _ in range(5):
            whole = [f"v{r.randrange(10**9)}" for _ in range(n * 100 // percent + 4)]
            rows += [(len(rows) + k, " ".join(t)) for k, t in enumerate((whole, whole[: n + 4], whole[: n + 3], whole[4:], [*whole[: n + 4], *["of the same passage as all"] * 1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [shingles(t, 5) for _, t in rows]
    want = {frozenset((a, b)) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    column = docs.toArrow().column("text").combine_chunks()
    node = {neardup.digest(s): k for k, s in enumerate(neardup.shingle_sets(column))}
    prefix, _ = neardup.prefixes(docs.select("text"), lambda batch: neardup.different_sets(batch.column("text"), 5), 10_000, percent)
    nothing = spark.createDataFrame([], "node binary, component binary")
    got = {frozenset((node[bytes(r.a)], node[bytes(r.b)])) for r in neardup.across(prefix, nothing, percent)[0].collect()}
    assert want <= got and len(want) > 60


def test_stage_keeps_columns_named_like_its_own(spark):
    from factlode.llm import neardup

    rows = [(1, "a b c d e f g", 7, "x", 3), (2, "a b c d e f g", 8, "y", 4), (3, "h i j k l m n", 9, "z", 5), (3, "h i j k l m n", 9, "z", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, nth int, at string, ID int")
    assert sorted(map(tuple, neardup.stage(spark, docs, "").collect())) == [rows[0], rows[2]]


def test_signatures_met_twice_survive_packing():
    import numpy as np

    from factlode.llm import partenum as pe

    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    shown = [np.concatenate([keys[:3000], np.repeat(keys[:1], 700)]), keys[2500:]]
    for parts in (1, 7, 4096):
        batches = [pe.packed(k, parts) for k in shown]
        assert sum(len(pe.unpacked(b)) for b in batches) == sum(map(len, shown))
        found = np.concatenate([b.column("key").to_numpy() for b in pe.met_twice(iter(batches), fold=1000)])
        expected = pe.named(*pe.coarse(np.concatenate([keys[:1], keys[2500:3000]]), parts))
        assert sorted(found.tolist()) == sorted(expected.tolist())
    assert not list(pe.met_twice(iter([])))


def test_bpe_makes_few_calls_for_a_new_word():
    import sys

    from tokenizers import Tokenizer

    from factlode.llm import bpe

    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABÀÉßİΣσςé中文😀0123456789'-.,<"
    texts = ["", " ", "ΑΣ ΑΣΑ Σ", "<|endoftext|>a<|endoftext|>", "­ ​ x", *(" ".join("".join(r.choice(letters) for _ in range(r.randrange(1, 40))) for _ in range(60)) for _ in range(40))]
    codec, calls = bpe.Codec(bpe.word_vocabulary()), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        got = codec.both(texts)
    finally:
        sys.setprofile(None)
    # Work for each symbol is done for all words at once: before, each character and token of a new word was a call.
    assert calls < 4 * len({p for t in texts for p in t.split()})
    tk = Tokenizer.from_file(bpe.word_vocabulary())
    tk.no_truncation()
    tk.no_padding()
    for text, (ids, decoded) in zip(texts, got, strict=True):
        want = tk.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and decoded == tk.decode(want, skip_special_tokens=False)


def test_counts_of_shingles_fold_to_few_bytes():
    import numpy as np

    from factlode.llm import neardup

    rng = np.random.default_rng(2)
    met = rng.poisson(0.15, neardup.BLOCK).astype(np.uint32)
    # Before, a block of rare shingles took two bytes for each bin.
    assert len(neardup._folded(met)) < neardup.BLOCK // 2
    met[:3] = 70_000, 65_535, 256
    assert neardup._counts(neardup._folded(met)).tolist() == np.minimum(met, 65535).tolist()
    assert neardup.distinct(np.array([5, 1, 5, 2**63], np.uint64)).tolist() == [1, 5, 2**63]


def test_a_bucket_is_dealt_once_to_tell_whether_it_is_settled(spark):
    from pyspark.sql import functions as F

    from factlode.llm import neardup

    rows = [(k, bytes([n])) for k in range(6) for n in range(k, 9)] + [(7, b"x"), (7, b"y")]
    members = spark.createDataFrame(rows, "key long, node binary")
    parts = spark.createDataFrame([(bytes([n]), bytes([n // 3])) for n in range(9)] + [(b"x", b"x"), (b"y", b"x")], "node binary, component binary")
    least, asked = F.min("node"), []
    keep, neardup.save = neardup.save, lambda df, name: asked.append(df) or keep(df, name)
    try:
        got = neardup.unsettled(members, parts, least=least)
    finally:
        neardup.save = keep
    want = {(k, bytes([n]), bytes([n // 3]), bytes([k])) for k in range(6) for n in range(k, 9)}
    assert {(r.key, bytes(r.node), bytes(r.component), bytes(r.least)) for r in got.collect()} == want
    # Before, three results were saved one after the other, and the rows were moved for two of them.
    assert len(asked) == 1 and asked[0]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(key") == 1
