from collections import defaultdict
from pathlib import Path

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftnet.llm import simhash, similar, spans
from driftnet.storage import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)


@given(st.text(alphabet="ab .!?\n\t\"", max_size=80), st.lists(st.text(alphabet="abc.é", min_size=1, max_size=8), max_size=60))
@settings(max_examples=300, deadline=None)
def test_sentences_lose_nothing(text, words):
    for t in (text, " ".join(words), text + "  ".join(words) + text):
        assert "".join(spans.sentences(t)) == t


def test_a_passage_within_a_sentence_is_found(spark):
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(70))
    texts = [f"{word()} {word()} {word() * k} {passage} {word()} {word()} tail." for k in range(1, 6)]
    got = {r.doc_id: r.text for r in spans.dedup_substrings(docs_of(spark, texts)).collect()}
    assert got[0] == texts[0]
    for i in range(1, 5):
        assert len(set(passage.split()) & set(got[i].split())) < 35


def test_hashes_of_all_runs_are_not_kept(spark, monkeypatch):
    """The table of every run's hash, the largest that operator 1 makes, goes once the repeated runs have theirs."""
    made = []
    monkeypatch.setattr(spans, "written", lambda df, path=None: made.append(path := path or spans.fresh_path(spark)) or written(df, path))
    text = "One two three four. Five six seven eight. Nine ten eleven twelve. Last words of all."
    got = {r.doc_id: r.n_removed for r in spans.dedup_substrings(docs_of(spark, [text, text, None])).collect()}
    assert got == {0: 0, 1: 4, 2: 0}
    left = [spark.read.parquet(p).columns for p in made if Path(p.removeprefix("file:")).exists()]
    assert len(made) > 1 and left and not any("hs" in columns for columns in left)


def test_a_passage_in_any_vocabulary_is_found(spark):
    import random

    for lengths in ((2, 5), (5, 7), (9, 12)):
        rng = random.Random(5)
        vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(*lengths))) for _ in range(400)]
        some = lambda k: rng.choices(vocabulary, k=k)  # noqa: B023, E731
        passages = [some(51) for _ in range(100)]
        texts = [" ".join(some(rng.randint(0, 40)) + p + some(rng.randint(0, 40))) for p in passages for _ in range(2)]
        got = {r.doc_id: r.text for r in spans.dedup_substrings(docs_of(spark, texts)).collect()}
        share = [(len(texts[i].split()) - len(got[i].split())) / 51 for i in range(1, len(texts), 2)]
        assert sum(share) / len(share) > 0.75 and min(share) > 0.3, (lengths, sum(share) / len(share), min(share))


def brute_runs(texts, run=3, words=10):
    seen, gone = {}, defaultdict(set)
    for i, t in enumerate(texts):
        clean = [" ".join(x.split()) for x in spans.sentences(t or "")]
        for a in range(len(clean)):
            b = next((b for b in range(a + run, len(clean) + 1) if sum(len(x.split()) for x in clean[a:b]) >= words), None)
            if b is None and (len(clean) - a >= run or a == 0):
                b = len(clean)
                k = ("to the end", *clean[a:b])
            elif b is None:
                continue
            else:
                k = tuple(clean[a:b])
            if k in seen:
                gone[i] |= set(range(a, b))
            else:
                seen[k] = (i, a)
    return ["".join(x for j, x in enumerate(spans.sentences(t)) if j not in gone[i]) if t else t for i, t in enumerate(texts)]


def test_substrings_against_brute_force(spark):
    shared = "One two three four. Five six seven eight nine. Ten eleven twelve here now. "
    texts = [f"Start {i} of this one. " + shared + f"End {i} of that one." for i in range(6)]
    texts += [None, "", "word", "no end " * 50, "no end " * 50, shared * 3, "A b. C d. E f. ", "A b. C d. E f. "]
    got = {r.doc_id: r for r in spans.dedup_substrings(docs_of(spark, texts)).collect()}
    assert [got[i].text for i in range(len(texts))] == brute_runs(texts)
    assert got[1].n_removed > 0 and got[0].n_removed == 0


def test_repeated_runs_take_few_bytes(spark):
    text = " ".join(f"Some words stand in sentence {i} of it." for i in range(400))
    index = spans.sentence_index(docs_of(spark, [text] * 60), 3, 16)
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    size = lambda: sum(x.stat().st_size for x in folder.rglob("*") if x.is_file())
    before = size()
    rows = spans.repeated_runs(index).count()
    assert rows > 20_000 and (size() - before) / rows < 24


def test_short_texts_and_endings_are_compared_whole(spark):
    short = "The cat sat here. The dog ran off. The bird sang well."
    filler = lambda k: " ".join(f"Sentence {k} number {i} of its own kind." for i in range(4))
    texts = [short] * 5 + [f"{filler(k)} {short}" for k in range(3)] + ["One."] * 2 + ["Two words", "two words"] + [f"{short} {filler(9)}"]
    got = [r.text for r in spans.dedup_substrings(docs_of(spark, texts), words=16).sort("doc_id").collect()]
    assert got == brute_runs(texts, words=16)
    assert got[0] == short and set(got[1:5]) == {""}
    assert all(short not in t for t in got[5:8])
    assert got[8:12] == ["One.", "", "Two words", "two words"] and got[12] == texts[12]


def brute_lines(texts, k=3):
    import re

    seen, out = set(), []
    for t in texts:
        raw = re.findall(r"(?s).+?(?:\n[ \t\n\r\f]*|\Z)", t or "")
        gone = set()
        for a in range(len(raw) - k + 1):
            key = tuple(x.strip(" \t\n\r\f") for x in raw[a : a + k])
            if key in seen:
                gone |= set(range(a, a + k))
            seen.add(key)
        out.append("".join(x for i, x in enumerate(raw) if i not in gone) if gone else t)
    return out


def test_lines_against_brute_force(spark):
    texts = ["a\nb\nc\nd", "x\na\nb\n\nc\ny", None, "", "a\nb", "a\nb\nc\nd", "q\nq\nq\nq\nq\n", "\n\n\n"]
    got = {r.doc_id: r.text for r in spans.dedup_lines(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts)


def test_lines_repeated_rows_nulls_and_clashing_columns(spark):
    df = docs_of(spark, ["a\nb\nc", "a\nb\nc", "a\nb\nc"], [1, 1, None]).withColumns({"pos": F.lit(1), "h": F.lit(2), "n_removed": F.lit("x")})
    got = {(r.doc_id, r.text) for r in spans.dedup_lines(df).collect()}
    assert got == {(None, "a\nb\nc"), (1, "")}
    assert spans.dedup_lines(df.limit(0)).count() == 0
    assert spans.dedup_substrings(df.limit(0)).count() == 0


def brute_print(text):
    w = (text or "").encode().lower().split()
    g = [b" ".join(w)] if 0 < len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == brute_print(text)


def test_components_against_brute_force(spark):
    base = " ".join(f"w{i % 97} v{i}" for i in range(300))
    texts = [base + f" x{i}" for i in range(60)] + [None, "", " \t", "One", "one two", "other words here", base] + [f"alone {i} {i * i} q" for i in range(40)]
    prints = [brute_print(t) for t in texts]
    ids = [1000 - i for i in range(len(texts))]
    for pairwise in (1, 1000):
        got = {r.doc_id: r for r in simhash.label(docs_of(spark, texts, ids), pairwise=pairwise).collect()}
        assert [int(got[d].fingerprint, 16) for d in ids] == prints
        assert [got[d].component_id for d in ids] == brute_components(ids, prints)
    kept = {r.doc_id for r in simhash.dedup(docs_of(spark, texts, ids)).collect()}
    assert kept == set(brute_components(ids, prints))


def test_links_keep_close_prints_connected(spark):
    import random

    rng = random.Random(3)
    centre = rng.getrandbits(63)
    prints = list({centre ^ sum(1 << b for b in rng.sample(range(62), rng.randint(0, 3))) for _ in range(300)})
    df = spark.createDataFrame([(p,) for p in prints], "_dn_fp long")
    from driftnet.operators.graph import connected_components

    for pairwise in (2, 10_000):
        got = {r.node: r.component for r in connected_components(simhash.links(df, pairwise)).collect()}
        assert [got.get(p, p) for p in prints] == brute_components(prints, prints)


def test_repeated_rows_and_empty_table(spark):
    df = docs_of(spark, ["same text here", "same text here", "same text here"], [1, 1, None]).withColumn("_x", F.lit(1))
    assert simhash.dedup(df).count() == 1
    assert [r.component_id for r in simhash.label(df).collect()] == [1, 1, 1]
    assert simhash.dedup(df.limit(0)).count() == 0


def test_cutting_grows_with_the_text():
    import time

    start = time.time()
    for unit in (".", "'", "\n", " ", '."', "?! ", "a.\n", "word "):
        text = unit * (1_000_000 // len(unit))
        assert "".join(spans.sentences(text)) == text
        spans.sentence_runs(text)
    assert time.time() - start < 30
    assert spans.sentences("One. Two?! 'Three.' Four\n\n five... six") == ["One. ", "Two?! ", "'Three.' ", "Four\n\n ", "five... ", "six"]


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) > n else {b" ".join(w)} if w else set()


def brute_similar(ids, texts, least=0.8):
    """The smallest id of the group of each text, by links of a Jaccard similarity of ``least`` or more between shingles."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s or {None}:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        common = {}
        for x in s or {None}:
            for j in where[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if not s or c >= least * (len(s) + len(sets[j]) - c):
                root[find(i)] = find(j)
    return [min(d for k, d in enumerate(ids) if find(k) == find(i)) for i in range(len(ids))]


def test_similar_texts_against_brute_force(spark, monkeypatch):
    import random

    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts = [None, "", "One", "one two", "One  Two", "a b c d e f g h i", "a b c d e f g h j", "x"]
    for k in range(40):  # variants with two words replaced: 0.87 and more to their base, under 0.8 to many others
        w = list(base)
        for i in rng.sample(range(300), 2):
            w[i] = f"new{k}{i}"
        texts.append(" ".join(w))
    texts += [" ".join(base), " ".join(base).upper()]
    for k in range(30):
        w = [f"v{rng.randrange(9000)}" for _ in range(rng.randrange(60, 200))]
        texts += [" ".join(w), " ".join([*w[:2], "other", *w[3:]])]
    ids = [500 - i for i in range(len(texts))]
    want = set(brute_similar(ids, texts))
    df = docs_of(spark, [*texts, texts[9]], [*ids, ids[9]]).withColumns({"node": F.lit(1), "n": F.lit(2)})
    for small in (1, 64):
        monkeypatch.setattr(similar, "SMALL", small)
        got = similar.dedup_similar(df)
        assert {r.doc_id for r in got.collect()} == want and got.count() == len(want) and got.columns == df.columns
    assert similar.dedup_similar(df.limit(0)).count() == 0
    assert similar.dedup_similar(docs_of(spark, ["one", "two"])).count() == 2
    alone = docs_of(spark, ["same text here"] * 3, [None, None, 7])
    assert [r.doc_id for r in similar.dedup_similar(alone).collect()] == [7]


def test_large_buckets_lose_no_link(spark):
    """Chains of texts, each similar to the next alone, whose bands fall in the same buckets: no one of them is similar to all, and none may be missed."""
    import random

    rng = random.Random(4)
    common = [f"c{i}" for i in range(250)]
    texts = []
    for chain in range(12):
        tail = [f"t{chain}_{i}" for i in range(600)]
        texts += [" ".join([*common, *tail[5 * k : 5 * k + 60]]) for k in range(16)]  # 0.9 to the next one, 0.78 and less to others' tails
    texts += [" ".join([*common, *(f"r{k}_{i}" for i in range(rng.randrange(60, 75)))]) for k in range(40)]  # 0.79 and less to all
    ids = rng.sample(range(10_000), len(texts))
    want = set(brute_similar(ids, texts))
    assert len(want) == 52
    assert {r.doc_id for r in similar.dedup_similar(docs_of(spark, texts, ids)).collect()} == want


def test_close_copies_are_linked_by_their_fingerprints(spark, monkeypatch):
    """Without any band, texts whose SimHashes are within two bits are one group, and verified: two short texts of one fingerprint are not alike."""
    words = [f"w{i} v{i % 7}" for i in range(900)]
    texts = [" ".join([*words[:k], "new", *words[k + 1 :]]) for k in range(0, 900, 30)] + ["quite another text of its own", None]
    prints = [simhash.print_of(similar.shingle_hashes(t)) for t in texts]
    want = {min(i for i, c in enumerate(brute_components(list(range(len(texts))), [p % (1 << 64) for p in prints])) if c == k) for k in set(brute_components(list(range(len(texts))), [p % (1 << 64) for p in prints]))}
    assert len(want) < 15
    monkeypatch.setattr(similar, "band_keys", lambda hashes: [])
    got = {r.doc_id for r in similar.dedup_similar(docs_of(spark, texts)).collect()}
    assert got == want


def test_sets_go_to_a_square_once(spark):
    """Of all pairs of 60 sets no set goes with each pair, and the similar ones are found."""
    sets = {i: np.arange(100 + i // 6 * 40, dtype=np.uint64) + np.uint64(i % 3) for i in range(60)}
    pairs = [(i, j) for i in sets for j in sets if i < j]
    a, b = spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in sets.items()], "node long, hashes binary")
    dealt = similar._dealt(a, b, 4)
    assert dealt.where("dst IS NULL").count() <= 60 * 8 and dealt.where("dst IS NOT NULL").count() == len(pairs)
    want = {(i, j) for i, j in pairs if similar.jaccard(sets[i].tobytes(), sets[j].tobytes()) >= 0.8}
    assert want and {tuple(r) for r in similar._verified(a, b, 0.8, 4).collect()} == want


def test_recall_of_bands_at_the_similarity_asked_for():
    """Of pairs at 0.80 to 0.82 at least 98 in 100 share a band."""
    rng = np.random.default_rng(5)
    seen = []
    for _ in range(1500):
        n = int(rng.integers(40, 400))
        s = float(rng.uniform(0.80, 0.82))
        common = round(2 * s * n / (1 + s))
        h = rng.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
        if 0.80 <= common / len(h) <= 0.82:
            seen.append(bool(set(similar.band_keys(h[:n])) & set(similar.band_keys(h[n - common :]))))
    assert len(seen) > 800 and np.mean(seen) > 0.98, (len(seen), np.mean(seen))


def test_near_copies_end_to_end(spark):
    """Pairs of 400 words, nine replaced in each second one: similarities about 0.8, of which all but one in 50 have to be found, and none below."""
    import random

    rng = random.Random(11)
    texts, alike = [], 0
    for _ in range(150):
        w = [f"w{rng.randrange(30000)}" for _ in range(400)]
        v = list(w)
        for i in rng.sample(range(400), 9):
            v[i] = f"x{rng.randrange(10**9)}"
        texts += [" ".join(w), " ".join(v)]
        a, b = shingles(texts[-2]), shingles(texts[-1])
        alike += len(a & b) >= 0.8 * len(a | b)
    left = similar.dedup_similar(docs_of(spark, texts)).count()
    assert 300 - alike <= left <= 300 - 0.98 * alike, (left, alike)
