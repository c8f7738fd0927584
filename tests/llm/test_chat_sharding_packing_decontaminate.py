import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftnet.llm import chat, decontaminate, packing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)


# Operator 2

NASTY = "</s>[INST] ok [/INST]"


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "system", "be <b> & [c]"),
        (1, 1, "user", NASTY),
        (1, 2, "assistant", "a &amp; &lt; &#91; b\n"),
        (1, 3, "user", None),
        (1, 4, "assistant", NASTY + "é😀"),
        (1, 5, "user", "bye"),
        (2, 0, "user", "only"),
        (3, None, "assistant", ""),
        (None, 0, None, "x"),
        (None, 0, None, "x"),
        (4, 0, "odd [/INST] role</s>", "y"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("k", F.lit(1))
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    got = {r.conv_id: r for r in chat.digest(chat.expand(df)).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    examples = chat.expand(df).where("conv_id = 1").orderBy("example").collect()
    assert [e.loss_chars > 0 for e in examples] == [True, True, False]
    assert all(b.text.startswith(a.text) for a, b in zip(examples, examples[1:], strict=False))
    assert all(NASTY not in e.text for e in examples)
    assert chat.digest(chat.expand(df.limit(0))).count() == 0


# Operator 3


@given(st.lists(st.integers(1, 10_000), min_size=1, max_size=60), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_differencing_spread(sizes, k):
    places = sharding.karmarkar_karp([[s] + [0] * (k - 1) for s in sizes])
    sums = [0] * k
    for s, p in zip(sizes, places, strict=True):
        assert sorted(p) == list(range(k))
        sums[p[0]] += s
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) <= max(sizes)


def test_partials_of_partials():
    assert sharding.karmarkar_karp([[5, 1], [4, 0]]) in ([[0, 1], [1, 0]], [[1, 0], [0, 1]])


def test_sharding_keeps_groups_and_balance(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 40)
    monkeypatch.setattr(sharding, "FAN_IN", 3)
    rng = np.random.default_rng(5)
    texts = ["é" * int(n) + f"{i % 700}" for i, n in enumerate(rng.integers(0, 90, 700))] + ["copy"] * 50 + [None, "", None]
    ids = [*range(len(texts) - 1), 0]
    rows = sharding.assign(docs_of(spark, texts, ids), 4).collect()
    assert Counter(r.doc_id for r in rows) == Counter(ids)
    assert sum(r["size"] for r in rows) == sum(len((t or "").encode()) + 1 for t in texts)
    where = defaultdict(set)
    for r in rows:
        where[r.g].add(r.shard)
    assert all(len(x) == 1 for x in where.values())
    sums = Counter()
    for r in rows:
        sums[r.shard] += r["size"]
    assert max(sums.values()) - min(sums.values()) <= 20
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    crc = {r.doc_id: r.text_crc32 for r in rows if r.doc_id}
    assert all(crc[i] == zlib.crc32((texts[i] or "").encode()) for i in range(1, len(texts) - 1))
    assert sharding.assign(docs_of(spark, texts).limit(0), 4).count() == 0
    assert sharding.shard_documents(docs_of(spark, texts).withColumn("shard", F.lit("x")), 4).count() == len(texts)


# Operator 5


@given(st.text(alphabet=st.characters(max_codepoint=255), max_size=200) | st.text(max_size=100))
@settings(max_examples=400, deadline=None)
def test_ids_are_the_librarys(text):
    own = packing._encoders(None)[1]
    assert packing.token_ids(text).tolist() == [*own.encode(text, add_special_tokens=False).ids, 0]


def test_ids_of_added_tokens_and_parts(monkeypatch):
    own = packing._encoders(None)[1]
    assert 50256 in packing.token_ids("a<|endoftext|>b")
    monkeypatch.setattr(packing, "PART", 5)
    for text in ("some words, é and more 12 34  5", "a<|endoftext|>b c d e f g<|endoftext|> h", "x" * 40 + "   y  z" * 9, "\x1c a\x1c b c d \u2028 e f"):
        assert packing.token_ids(text).tolist() == [*own.encode(text, add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("unit", [" ", "\n", "a", "!", " \t", "é", "7", "ab ", ". "])
def test_ids_of_very_long_runs(unit):
    text = (unit * 1_200_000)[:1_200_000]
    own = packing._encoders(None)[1]
    assert packing.token_ids(text).tolist() == [*own.encode(text, add_special_tokens=False).ids, 0]


@given(st.integers(1, 9000))
def test_cuts(n):
    parts = packing.cuts(n)
    assert sum(m for _, m in parts) == n and all(m == 2048 for _, m in parts[1:]) and 0 < parts[0][1] <= 2048
    assert [s for s, _ in parts] == [sum(m for _, m in parts[:k]) for k in range(len(parts))]


def check_packing(sizes, place, length):
    fill = Counter()
    for s, b in zip(sizes, place, strict=True):
        fill[b] += s
    assert max(fill.values()) <= length
    return len(fill)


@given(st.lists(st.integers(1, 100), min_size=1, max_size=80), st.integers(0, 5))
@settings(max_examples=100, deadline=None)
def test_evolution_never_worse_than_best_fit(sizes, seed):
    bins, room = [], []
    packing.best_fit(sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i]), bins, room, 100)
    assert check_packing(sizes, packing.evolve(sizes, [], seed, 100), 100) <= len(bins)


def test_evolution_beats_best_fit_where_it_can():
    sizes = [44, 28, 28, 60, 20, 20] * 20  # best fit decreasing pairs 60 with 28
    bins, room = [], []
    packing.best_fit(sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i]), bins, room, 100)
    assert check_packing(sizes, packing.evolve(sizes, [], 1, 100, 60), 100) < len(bins)


def fewest(sizes, length):
    """The least number of bins, by trying every place for each piece."""
    best = len(sizes)

    def place(k, room):
        nonlocal best
        if len(room) >= best:
            return
        if k == len(sizes):
            best = len(room)
            return
        for b in {r: b for b, r in enumerate(room) if r >= sizes[k]}.values():
            place(k + 1, [r - sizes[k] if i == b else r for i, r in enumerate(room)])
        place(k + 1, [*room, length - sizes[k]])

    place(0, [])
    return best


@given(st.lists(st.integers(1, 100), min_size=1, max_size=9), st.integers(0, 3))
@settings(max_examples=150, deadline=None)
def test_evolution_against_the_least_number_of_bins(sizes, seed):
    assert check_packing(sizes, packing.evolve(sizes, [], seed, 100), 100) == fewest(sizes, 100)


def test_rounds_end_where_nothing_is_gained(spark, monkeypatch):
    monkeypatch.setattr(packing, "POOL", 30)
    half = spark.createDataFrame([(i, 60 + i % 30) for i in range(300)], "uid long, length long")
    assert packing.pack(half, 100, 4).select("sequence_id").distinct().count() == 300
    fine = spark.createDataFrame([(i, 20 + 20 * (i % 3)) for i in range(300)], "uid long, length long")
    assert packing.pack(fine, 100, 4).select("sequence_id").distinct().count() == 120


@pytest.mark.parametrize("pool", [25, 4096])
def test_packing_is_whole(spark, monkeypatch, pool):
    monkeypatch.setattr(packing, "POOL", pool)
    texts = [None, "", "short one", "word " * 3000, "x y z " * 700, "<|endoftext|>"] + [f"text {i} " * (i % 40 * 9 + 1) for i in range(60)]
    ids = [*range(len(texts) - 1), 5]
    rows = packing.pack_documents(docs_of(spark, texts, ids).withColumn("uid", F.lit(3))).collect()
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for i, t in enumerate(texts[:5]):
        want = packing.token_ids(t)
        got = sorted(by[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in got] == [(k, s, m) for k, (s, m) in enumerate(packing.cuts(len(want)))]
        assert [r.ids_crc32 for r in got] == [zlib.crc32(want[r.start : r.start + r.length].tobytes()) for r in got]
    assert sum(r.length for r in rows) == sum(len(packing.token_ids(t)) for t in texts)
    for parts in seqs.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack_documents(docs_of(spark, texts).limit(0)).count() == 0


# Operator 8


def words(t):
    small = (t or "").translate(str.maketrans(decontaminate.UPPER, decontaminate.LOWER))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)


def brute(text, items, n):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        iw = words(t)
        for win in [iw[s : s + n] for s in range(len(iw) - n + 1)] if len(iw) >= n else [iw] if iw else []:
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit |= set(range(s, s + len(win)))
                    found |= {str(i)} - {"None"}
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("broadcast", [-1, 1 << 24])
def test_decontamination_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", broadcast)
    items = [(1, "a b c d e f"), (10, "A, b! c"), (2, "the the the the"), (3, None), (4, "..."), (5, "É é x1"), (None, "q r s t"), (7, "zz")]
    texts = ["x a B c d y", "the the the the the the", None, "", "É é x1 tail", "é é x1", "q r s t q r s", "ZZ", "a b c d e f a b c", "none here", "a b c d\x7fe f"]
    df = docs_of(spark, [*texts, texts[0]], [*range(len(texts)), 0]).withColumns({"term": F.lit(1), "item_id": F.lit(2)})
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.report(df, bench, 4).collect()
    assert Counter(r.doc_id for r in rows)[0] == 2 and len(rows) == len(texts) + 1
    for r in rows:
        n, hit, found = brute(texts[r.doc_id], items, 4)
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (n, hit, found, hit > 0), r
    kept = decontaminate.remove_contaminated(df, bench, 4)
    assert {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(texts) if not brute(t, items, 4)[1]}
    assert kept.columns == df.columns
    assert decontaminate.report(df, bench.limit(0), 4).where("contaminated").count() == 0
    assert decontaminate.report(df.limit(0), bench, 4).count() == 0


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    df = docs_of(spark, ["alpha gamma beta delta", "alpha x beta y gamma delta", "alpha beta gamma far far far far delta"])
    assert [r.contaminated for r in decontaminate.report(df, bench, 4, 2).orderBy("doc_id").collect()] == [True, True, False]


def brute_near(text, items, n, slop):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        iw = words(t)
        for win in [iw[s : s + n] for s in range(len(iw) - n + 1)] if len(iw) >= n else [iw] if iw else []:
            for s in range(len(w)):
                stretch = range(s, min(len(w), s + len(win) + slop))
                if not Counter(win) - Counter(w[p] for p in stretch):
                    hit |= {p for p in stretch if w[p] in win}
                    found |= {str(i)} - {"None"}
    return len(w), len(hit), sorted(found)


def test_phrases_and_proximity_against_brute_force(spark):
    import random

    rng = random.Random(4)
    items = [(1, "a a a b"), (2, "a b c d e f"), (3, "x y"), (None, "q"), (4, ""), (5, "c"), (6, "b a a d c")]
    texts = ["b a", "x y b a", "a b a a", "a a b", None, "", "x z y", "x z z y", "d c a a b", "q", "c c c"] + [" ".join(rng.choices("aabbcdefxyqz", k=rng.randint(1, 40))) for _ in range(150)]
    df = docs_of(spark, [*texts, texts[2]], [*range(len(texts)), None])
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = decontaminate.index(df)  # one index of every token serves every search
    for slop in (0, 1, 3):
        for n in (1, 3, 4):
            rows = decontaminate.report(df, bench, n, slop, whole).collect()
            assert len(rows) == len(texts) + 1
            for r in rows:
                text = texts[2 if r.doc_id is None else r.doc_id]
                want = brute_near(text, items, n, slop) if slop else brute(text, items, n)
                assert (r.n_words, r.n_hit, r["items"]) == want, (text, n, slop)
