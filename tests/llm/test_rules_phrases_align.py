import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftnet.llm import align, oracles, phrases, queries, rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t", "One", "a b c d e", "a b c d e\na b c d e\n \na b c d e", "x " * 400, "né à l'été ½ 中文 \x00 \x0b y", "- one\n* two\n• three", "cut...\nshort…\nend", "{a} [b] \\", "12345 6 7 8 9", "# | & <b>", "<|endoftext|> <s> </s> <unk> ▁ <0x0A>", "  two  spaces ", "\n", "tail\r\n"]


def docs_of(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, "en" if langs is None else langs[i], "s", 0) for i, t in enumerate(texts)], SCHEMA)


# Operator 11


def brute_base(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {p for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def brute_kept(text):
    t, (n, chars, symbols, dup, repeated) = text or "", brute_base(text)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    bullets = sum(bool(re.match(r"[ \t]*[-*•]", x)) for x in lines)
    cut = sum(bool(re.search(r"(\.\.\.|…)[ \t\x0b\f\r]*\Z", x)) for x in lines)
    digits, braces = len(re.findall("[0-9]", t)), len(re.findall(r"[{}\[\]\\]", t))
    return (
        n >= 10 and 100 * repeated <= 20 * n and 10 * symbols <= n and 2 * n <= chars <= 15 * n and 2 * dup <= len(lines)
        and 10 * bullets <= 9 * len(lines) and 10 * cut <= 3 * len(lines) and 2 * digits <= chars and 20 * braces <= chars
    )


def test_rules_against_brute_force_in_any_order(spark):
    rng = random.Random(3)
    texts = [*ODD, *[" ".join(rng.choice("ab cd efg hijk - # 12 { line\n end.".split(" ")) for _ in range(rng.randint(1, 80))) for _ in range(80)], "w " * 30000]
    texts += [" ".join(f"word{rng.randint(0, 999)}" for _ in range(60)), "the same line here\n" * 12 + " ".join(f"w{i}" for i in range(100))]
    df = docs_of(spark, texts).withColumns({"n_words": F.lit("clash"), "kept": F.lit(3)})
    for by in (None, list(rules.RULES), list(reversed(rules.RULES))):
        got = {r.doc_id: r for r in rules.judge(df, by=by).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            assert tuple(got[i][c] for c in rules.BASE) == brute_base(t), t
            assert got[i].kept == brute_kept(t), t
            assert (got[i].rejected_by is None) == got[i].kept
    assert rules.judge(df.limit(0)).count() == 0


def test_a_cascade_stops_at_the_first_rule_that_fails(spark):
    """A rule that would raise an error is not reached by texts that the rule before rejects."""
    strict = {"long": lambda x: x["n_words"] > 3, "never": lambda x: F.raise_error(F.lit("reached")).cast("boolean")}
    assert [r.rejected_by for r in rules.judge(docs_of(spark, ["a b", "c"]), strict, by=["long", "never"]).collect()] == ["long", "long"]


@given(st.lists(st.tuples(st.frozensets(st.sampled_from("abcd")), st.integers(1, 50)), max_size=6), st.lists(st.floats(0.1, 9), min_size=4, max_size=4))
@settings(max_examples=200, deadline=None)
def test_arranged_is_near_the_best_order(failures, costs):
    cost = dict(zip("abcd", costs, strict=True))

    def spent(by):
        return sum(n * sum(cost[r] for r in by[: next((k + 1 for k, r in enumerate(by) if r in failed), len(by))]) for failed, n in failures)

    found = rules.arranged(cost, failures)
    assert sorted(found) == list("abcd")
    assert spent(found) <= 4 * min(map(spent, permutations("abcd"))) + 1e-9  # what a greedy order is known to keep


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rate = {r.quality: r.kept for r in rules.judge(docs, by=list(rules.RULES)).where("NOT base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rate[1] > 0.995 and rate[0] < 0.05, rate


def test_rule_cascade_is_native(spark):
    plan = rules.judge(docs_of(spark, ODD), by=list(rules.RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# Operator 12


def brute_phrases(rows, least, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cands.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                continue
            score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("least", "width", "shard", "top"), [(3, 1 << 16, 1 << 20, 2000), (3, 64, 200, 5), (1, 1 << 12, 1 << 20, 2000), (300, 1 << 10, 1 << 20, 2000)])
def test_phrases_against_brute_force(spark, least, width, shard, top):
    rng = random.Random(least)
    vocabulary = ["a", "B", "été", "x y", "the", "of.", "и", "\x00z", "long,word", "q\tq", " "]
    texts = [*ODD, *[" ".join(rng.choices(vocabulary, k=rng.randint(1, 40))) for _ in range(60)], "a a a a a a a. a a", "THE THE the the " * 120]
    langs = [rng.choice(["en", "fr", None, "und"]) for _ in texts]
    got = phrases.ranked(phrases.mine(docs_of(spark, texts, langs).repartition(5), least, width, shard), top)
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()) == brute_phrases(zip(langs, texts, strict=True), least, top)


def test_phrases_of_nothing(spark):
    assert phrases.mine(docs_of(spark, ["x"]).limit(0), 1, 1 << 10).count() == 0
    assert phrases.mine(docs_of(spark, [None, "", ". , ;"]), 1, 1 << 10).count() == 0


def test_a_pass_reads_its_languages_and_sends_blocks_of_counts(spark):
    words = [f"w{i}" for i in range(300)]
    texts = docs_of(spark, [" ".join(words)] * 40, ["en", "fr"] * 20).selectExpr("lang", "CAST(text AS BINARY) AS text").repartition(4)
    patterns = {lang: [w.encode() for w in words] for lang in ("en", "fr")}
    sent = spark.sparkContext.broadcast(("own", patterns))
    made = phrases.matches(texts, sent)
    assert made.count() <= 8  # a row for each task and language, not for each pattern too
    assert {tuple(r) for r in phrases.summed(made, 4, sent).collect()} == {(lang, w.encode(), 20) for lang in patterns for w in words}
    passes = phrases.shards_of({"en": 900, "fr": 390, "de": 10, "it": 5}, 400)
    assert sorted(x for p in passes for x in p) == [("de", 0, 1), ("en", 0, 3), ("en", 1, 3), ("en", 2, 3), ("fr", 0, 1), ("it", 0, 1)]
    assert len(passes) == 5 and max(len({lang for lang, _, _ in p}) for p in passes) == 2


def test_sketches_widen_with_the_texts(spark):
    texts = spark.range(80, numPartitions=2).selectExpr("repeat('abcde ', 4000000) AS text")
    assert phrases.width_of(texts.limit(1), 100) == phrases.WIDTH
    assert phrases.width_of(texts, 100) >= 2 * 80 * 4_000_000 // 100 > phrases.WIDTH


def test_scores_beyond_64_bits(spark):
    a, n = 3_000_000_019, 90_000_000_000_017
    counts = spark.createDataFrame([("en", "x y", a), ("en", "x", a + 7), ("en", "y", 5 * a)], "lang string, phrase string, f long").withColumn("phrase", F.col("phrase").cast("binary"))
    [row] = phrases.scored(counts, spark.createDataFrame([("en", n)], "lang string, n long"), 100).collect()
    assert row.score == 1000 * a * n // ((a + 7) * 5 * a)


@given(st.lists(st.text(alphabet="aB .\n,é\t", max_size=30), max_size=6))
@settings(max_examples=200, deadline=None)
def test_phrase_hashes_tell_words_apart(texts):
    body = b" " + b" \n ".join(phrases.plain(t.encode()) for t in texts) + b" "
    starts, ends, hashes, within = phrases.phrase_hashes("en", body)
    want = [w for t in texts for p in re.split(r"[.,\n]", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for w in p.split()]
    words = [body[s:e].decode() for s, e in zip(starts, ends, strict=True)]
    assert words == want
    assert len(set(hashes[0].tolist())) == len(set(words))
    for level in range(2, 6):
        seen = {}
        for i in range(len(within[level - 1])):
            assert seen.setdefault(int(hashes[level - 1][i]), words[i : i + level]) == words[i : i + level]


# Operator 13


def brute_alignment(texts, pair):
    told, held = [], Counter()
    for t in texts:
        a, b = pair.ids(t)
        spans = []
        for ids, table in zip((a, b), pair.tables, strict=True):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(table[i])))
                at += len(table[i])
            spans.append(out)
        links = [(x, y) for x, (s, e) in zip(a, spans[0], strict=True) for y, (u, v) in zip(b, spans[1], strict=True) if s < v and u < e]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for c in cuts:
            sides = [[str(i) for i, (s, e) in zip(ids, own, strict=True) if low <= s and e <= c] for ids, own in zip((a, b), spans, strict=True)]
            groups.append(",".join(sides[0]) + "|" + ",".join(sides[1]))
            low = c
        told.append((a, b, groups, links))
        held.update(set(links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return [
        (len(a), len(b), len(g), len(k), sum(held[p] == most[p[0]] for p in k), sum(held[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
        for a, b, g, k in told
    ]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("rows", [1 << 21, 40])
def test_alignment_against_brute_force(spark, rows):
    rng = random.Random(7)
    some = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars < 600").limit(40).collect()]
    texts = [*ODD, *some, some[0], "½ ﬁ ① ｆｕｌｌ", "á é", "".join(rng.choice("ab é中\n\t<>0") for _ in range(300)), "\U0001f600\U0001f600 ok", " leading", "trailing ", "tab\ttab\r\n\r\n"]
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align.align(docs_of(spark, texts).withColumn("pairs", F.lit(1)), rows=rows).collect()}
    want = brute_alignment(texts, align.Pair())
    assert [got[i] for i in range(len(texts))] == want
    assert sum(x[0] > 0 for x in want) > 40 and any(x[3] > x[1] for x in want)


def test_alignment_of_nothing(spark):
    assert align.align(docs_of(spark, ["x"]).limit(0)).count() == 0
    assert {tuple(r[c] for c in COLUMNS) for r in align.align(docs_of(spark, [None, ""])).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_byte_level_ids_are_the_files_own(spark):
    pair = align.Pair()
    own = align._byte_level(pair.paths[0])[1]
    rng = random.Random(1)
    texts = [t for t in ODD if t] + ["".join(rng.choice("aé '12.\n\t <|endoftext|>") for _ in range(500)) for _ in range(50)] + ["word " * 60000 + "<|endoftext|> x" * 50, " " * 5000 + "x"]
    for t in texts:
        assert pair.a_ids(t) == own.encode(" " + t, add_special_tokens=False).ids
        assert b"".join(pair.tables[0][i] for i in pair.a_ids(t)) == (" " + t).encode()


@given(st.lists(st.integers(1, 5), min_size=1, max_size=30), st.randoms())
@settings(max_examples=200, deadline=None)
def test_overlaps(widths, rng):
    ends_a = np.cumsum(widths)
    inner = sorted(rng.sample(range(1, int(ends_a[-1])), rng.randint(0, int(ends_a[-1]) - 1))) if ends_a[-1] > 1 else []
    ends_b = np.array([*inner, int(ends_a[-1])])
    first, last = align.overlaps(ends_a, ends_b)
    starts = [np.concatenate([[0], e[:-1]]) for e in (ends_a, ends_b)]
    for i in range(len(ends_a)):
        hit = [j for j in range(len(ends_b)) if starts[0][i] < ends_b[j] and starts[1][j] < ends_a[i]]
        assert hit == list(range(first[i], last[i] + 1))


# Queries and their SQL


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in ("documents", "conversations", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = db.execute(oracles.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert sorted(map(repr, got[cols].astype(object).to_numpy().tolist())) == sorted(map(repr, want[cols].astype(object).to_numpy().tolist()))
