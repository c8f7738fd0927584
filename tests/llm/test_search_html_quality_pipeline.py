import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from driftnet.llm import ann, html, quality
from tests.llm.test_chat_sharding_packing_decontaminate import brute as brute_hits
from tests.llm.test_spans_simhash import brute_lines, brute_similar

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

# Operator 6


def brute_search(rows, k):
    sound = [(i, v) for i, v in rows if i is not None and v and len(v) == 5 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for q, x in sound:
        if q % 20 == 0:
            near = sorted((-float(np.dot(np.float64(np.float32(x)), np.float64(np.float32(y)))), i) for i, y in sound if i != q)
            out |= {(q, r + 1, i) for r, (_, i) in enumerate(near[:k])}
    return out


def test_search_ties_bad_vectors_and_copies(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=5)]) for i in range(120)]
    rows += [(200 + i, [3.0, 0.0, 0.0, 0.0, 0.0]) for i in range(60)]
    rows += [(300, None), (320, [0.0] * 5), (340, [1.0, None, 0.0, 0.0, 0.0]), (360, [float("nan")] + [1.0] * 4), (380, [float("inf")] + [1.0] * 4), (400, [1.0]), (None, [1.0] * 5), (420, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit("x"))
    v = ann.usable(df)
    got = ann.search(v, v.where("vec_id % 20 = 0"), 4, refine=200).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == brute_search(rows, 4)
    none = ann.usable(df.limit(0))
    assert ann.search(none, none, 4).count() == 0
    few = ann.usable(df.where("vec_id IN (0, 1, 2)"))
    assert ann.search(few, few.where("vec_id = 0"), 20).count() == 2


def test_search_in_blocks_has_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "QUERY_BYTES", 64 * 8 * 20)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, float) for r in rows.collect()}
    v = ann.usable(rows)
    found = {}
    for r in ann.search(v, v.where("vec_id % 20 = 0"), 20, refine=40).collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = 0
    for q, near in found.items():
        true = sorted((-float(x[i] @ x[q]), i) for i in x if i != q)[:20]
        hits += len({i for _, i in true} & set(near))
        assert all(abs(s - float(x[i] @ x[q])) < 1e-12 for i, s in near.items())
    assert len(found) == sum(i % 20 == 0 for i in x) and hits >= 0.9 * 20 * len(found)


def test_anisotropic_codes_lower_the_parallel_error():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def errors(weight, books):
        codes = ann.encode(x, books, weight)
        back = books[np.arange(books.shape[0]), codes].reshape(len(x), -1)
        return np.mean(((x - back) * x).sum(1) ** 2)

    books = ann.fit(x)
    assert errors(8.0, books) < errors(1.0, books)
    codes = ann.encode(x, books, 2.0)
    back = books[np.arange(books.shape[0]), codes].reshape(len(x), -1)
    assert np.allclose(ann.scan(x[:5], ann.pack(codes), books), x[:5] @ back.T, atol=1e-5)


# Operator 9

PAGES = [
    ("<table><caption>Cap</caption><tr><th>Name<th>Age<tr><td>Bob<td>5</table>after", "Cap\nName  Age\nBob   5\n\nafter"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>e</ul><ol start=3><li>x<li>z</ol>", "- a\n- b\n  - c\n- e\n\n3. x\n4. z"),
    ("<title>t</title><p>one<p>two<br>three<div hidden>no</div><i style='display : none'>no</i>x <b>y</b>\n z", "one\n\ntwo\nthree\n\nx y z"),
    ("<pre>\n a  b\n  c</pre>t", " a  b\n  c\n\nt"),
    ("<script>var t='</p>';</script><style>p{}</style>a &amp; b &lt;c> &copy;", "a & b <c> ©"),
    ("<dl><dt>k<dd>v</dl>", "k\n  v"),
    ("a < b <!-- x --> c<p title='x", "a < b c"),
    ("<td>x</td><tr>y", "x\ny"),
    (None, ""),
    ("", ""),
]


def test_pages(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(PAGES)], "page_id long, html string").withColumn("text", F.lit("old"))
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert [got[i].text for i in range(len(PAGES))] == [t for _, t in PAGES]
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html.extract(df.limit(0)).count() == 0


@given(st.lists(st.sampled_from(["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<ul>", "<li>", "</ul>", "<b>", "</div>", "<div>", "<pre>", "</pre>", "<dd>", "<br>", "<tbody>", "<!--c-->", "\n", " "]) | st.from_regex("[a-z]{3}", fullmatch=True), max_size=30))
@settings(max_examples=400, deadline=None)
def test_no_word_is_lost(parts):
    want = [x for x in parts if x.isalpha()]
    text = html.page_text(" ".join(parts))
    assert sorted(x for x in text.split() if x.isalpha()) == sorted(want)


def test_stray_quotes_lose_nothing():
    for tag in ('<a href="x"">', "<b data-n=it's>", '<a href="x" ">', "<a '>", '<a x=y"z>', '<a title=">" b=\'>\'>', '<a href = "x>y" c>', "<a =\">", '<a href="x"title="y"">', "<a/'/>", "<a b==\">", "<a b=>"):
        for quote in ("", "<i class='k'>it's \"so\"</i>"):
            words = html.page_text(f"<p>one</p>{tag}two</a><p>three</p>{quote}<p title=\"t\">four</p>").split()
            assert [x for x in words if x in ("one", "two", "three", "four")] == ["one", "two", "three", "four"], tag
    assert html.page_text("<p>a</p><ol start='3'><li>x</ol><p b='never ends>c</p>") == "a\n\n3. x"


LAYOUT = [
    ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A  B\n   C"),
    ("<table><tr><td rowspan=0>A<td>B<tr><td>C<tbody><tr><td>D<td>E</table>", "A  B\n   C\nD  E"),
    ("<table><tfoot><tr><td>f<tbody><tr><td>b<thead><tr><td>h</table>", "h\nb\nf"),
    ("<table><tr><td colspan=2>long cell<td>x<tr><td>a<td>b<td>c</table>", "long cell  x\na  b       c"),
    ("<table><tr><td><p>a<p>b<td>c</table>", "a  c\n\nb"),
    ("<table><tr><td>1<td><table><tr><td>x<td>y<tr><td>z</table></table>", "1  x  y\n   z"),
    ("<svg><title>t</title><g>no<text>axis</text><text>one</text></g></svg>", "axis\none"),
    ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "x=1"),
    ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>", "yes"),
    ("<style>.h{display:none} @media print{p{display:none}} #i{visibility:hidden}</style><p class='a h'>no<p>yes<p id=i>no", "yes"),
    ("<style>p.h{display:none}.k{display:block!important}</style><p class='h k' style='display:none'>yes<p class=h style='display:block'>too", "yes\n\ntoo"),
    ("<style>/* .x{ */ div p{display:none} .x,.y{display:none}</style><p>yes<i class=y>no</i>", "yes"),
    ("<details><summary>s</summary>no<table><tr><td>no</table></details>", "s"),
    ("<b/>still <i hidden/>no", "still"),
    ("<ul><li><ul><li>x</ul><li>y</ul>", "- - x\n- y"),
    ("<p a=1 hidden a=2>no</p><p title=it's>hello</p><a href=x\" >world</a>", "hello\n\nworld"),
]


def test_layout_and_visibility():
    for page, text in LAYOUT:
        assert html.page_text(page) == text, page


def slow_text(node):
    """A plain recursive renderer of a tree of p, div, ul, ol, li, b, br and tables, with a cell for each place of a table."""

    def parts(x):  # text, line and margin marks, indents, and tables
        if isinstance(x, str):
            return [x]
        if x.tag == "br":
            return ["<br"]
        if x.tag == "table":
            return ["<margin", ("table", grid(x)), "<margin"]
        inner = [p for y in x.children for p in parts(y)]
        edge = ["<margin"] if x.tag in ("p", "ul") else ["<line"] if x.tag in ("div", "li") else []
        return edge + ([("in", "- ")] if x.tag == "li" else []) + inner + edge + ([("out",)] if x.tag == "li" else [])

    def grid(table):
        taken, cells, r = {}, [], 0
        for row in table.children[0].children:
            c = 0
            for cell in row.children:
                while (r, c) in taken:
                    c += 1
                wide, down = int(cell.attributes.get("colspan", 1)), int(cell.attributes.get("rowspan", 1))
                for i in range(down):
                    for j in range(wide):
                        taken[r + i, c + j] = 1
                cells.append((r, c, wide, lines([p for y in cell.children for p in parts(y)])))
                c += wide
            r += 1
        ends = sorted({e for _, c, w, _ in cells for e in (c, c + w)})
        width = dict.fromkeys(ends, 0)
        for single in (True, False):
            for _, c, w, text in sorted(cells, key=lambda x: (ends.index(x[1] + x[2]) - ends.index(x[1]), ends.index(x[1]), max(map(len, x[3]), default=0))):
                over = [e for e in ends if c <= e < c + w]
                need = max(map(len, text), default=0)
                if (len(over) == 1) == single:
                    have = sum(width[e] + 2 for e in over if width[e]) - 2
                    width[over[-1]] += max(0, need - have) if have >= 0 else need
        out = []
        for i in range(r):
            mine = [x for x in cells if x[0] == i]
            for k in range(max((len(x[3]) for x in mine), default=0)):
                s = ""
                for _, c, _, text in mine:
                    if k < len(text) and text[k]:
                        s = s.ljust(max(len(s) + 2 if s else 0, sum(width[e] + 2 for e in ends if e < c and width[e]))) + text[k]
                out.append(s)
        return out

    def lines(items):
        out, now, gap, marks = [], "", False, []

        def put(s):
            nonlocal gap
            if gap and out:
                out.append("")
            gap = False
            out.append(("".join(m[0] for m in marks) + s).rstrip())
            for m in marks:
                m[0] = " " * len(m[0])

        for x in [*items, "<line"]:
            if isinstance(x, str) and not x.startswith("<"):
                now += x
                continue
            if s := " ".join(now.split()):
                put(s)
            elif x == "<br" and out and out[-1]:
                out.append("")
            now = ""
            if x == "<margin":
                gap = True
            elif x[0] == "in":
                marks.append([x[1]])
            elif x[0] == "out":
                marks.pop()
            elif x[0] == "table":
                for s in x[1]:
                    put(s)
        while out and not out[-1]:
            out.pop()
        return out

    return "\n".join(lines([p for y in node.children for p in parts(y)]))


WORDS = st.from_regex("[a-z]{1,6}", fullmatch=True)


def _inside(inner):
    many = st.lists(inner, max_size=4).map(" ".join)
    cell = st.tuples(st.integers(1, 3), st.integers(1, 3), many).map(lambda x: f"<td colspan={x[0]} rowspan={x[1]}>{x[2]}</td>")
    table = st.lists(st.lists(cell, max_size=3).map(lambda x: f"<tr>{''.join(x)}</tr>"), min_size=1, max_size=4).map(lambda x: f"<table><tbody>{''.join(x)}</tbody></table>")
    return table | many.map(lambda x: f"<div>{x}</div>") | many.map(lambda x: f"<b>{x}</b>") | st.lists(many, max_size=3).map(lambda x: "<div>" + "".join(f"<li>{y}</li>" for y in x) + "</div>")


@given(st.lists(st.recursive(WORDS | st.just("<br>") | WORDS.map(lambda x: f"<p>{x}</p>"), _inside, max_leaves=25), max_size=5).map(" ".join))
@settings(max_examples=300, deadline=None)
def test_against_a_slow_renderer(page):
    assert html.page_text(page) == slow_text(html.build(page))


def test_time_grows_with_the_page():
    start = time.time()
    for page in ("<p><div>" * 20_000, "<b>" * 40_000 + "</i>" * 40_000, "<table><tr><td>" * 5_000 + "x", "<table><tr><td>a<tr><td>" * 1_000, "<ul><li>a" * 5_000, "<pre>" + "  <br>" * 20_000, "<" * 300_000, '<a "' * 100_000, "<svg>" * 10_000):
        html.page_text(page)
    spans = html.page_text("<table>" + "<tr><td colspan=1000 rowspan=65534>x" * 300 + "<tr><td>y" * 500)
    assert len(spans) < 600_000 and spans.count("y") == 500
    assert time.time() - start < 20


def test_deep_and_wide_pages():
    start = time.time()
    assert html.page_text("<div>" * 30_000 + "deep") == "deep"
    assert "x" in html.page_text("<table><tr><td>" * 60 + "x")
    wide = "<table>" + f"<tr><td>{'w' * 100_000}<td>b" + "<tr><td>a<td>b" * 500 + "</table>"
    assert len(html.page_text(wide)) < 200_000
    assert time.time() - start < 20


# Operator 10


def test_thresholds_are_ordered_and_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, rated = spark.read.parquet(f"{sf}/documents.parquet"), quality.ratings(spark.read.parquet(f"{sf}/labels.parquet"))
    held = rated.where("doc_id % 4 = 0")
    model = quality.train(docs, rated.where("doc_id % 4 <> 0"))
    assert (np.diff(model[1]) > 0).all()
    found = quality.score(docs.join(held, "doc_id"), model).groupBy("grade").agg(F.avg(F.col("accepted").cast("int")).alias("a")).collect()
    a = {r.grade: r.a for r in found}
    assert a[2] > 0.98 and a[0] < 0.05 and a[1] < 0.6


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x y"), (3, "good words here"), (3, "good words here"), (4, "bad!! bad!!" * 900)], "doc_id long, text string").withColumn("accepted", F.lit("old"))
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, None), (None, 1, 1), (1, None, 1), (2, 1, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in rows)
    assert all(r.accepted for r in quality.classify(docs, labels.limit(0)).collect())
    assert quality.classify(docs.limit(0), labels).count() == 0


# The pipeline


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality classifier"](spark, docs, SF)
    want = {r.doc_id for r in quality.score(docs, quality.train(docs, quality.ratings(labels))).where("accepted").collect()}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == columns
    rows = sorted(kept.collect(), key=lambda r: r.doc_id)
    lined = stages["line dedup"](spark, kept, SF)
    got = {r.doc_id: r for r in lined.collect()}
    texts = brute_lines([r.text for r in rows])
    assert lined.columns == columns and [got[r.doc_id].text for r in rows] == texts and all(r.n_chars == len(r.text) for r in got.values())
    near = stages["SimHash near-dedup"](spark, lined, SF)
    ids = [r.doc_id for r in rows]
    alone = set(brute_similar(ids, texts))  # five words, a similarity of 0.8
    assert near.columns == columns and {r.doc_id for r in near.collect()} == alone
    clean = stages["benchmark decontamination"](spark, near, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r.doc_id for r in near.collect() if not brute_hits(r.text, items, 10)[1]}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == left
    packed = stages["best-fit packing"](spark, clean, SF)
    assert {r.doc_id for r in packed.collect()} == left
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == left


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages_on_nulls_copies_and_nothing(spark):
    rows = [(1, None, None, None, None), (None, "a b c d", "en", "s", 7), (2, "", "en", "s", 0), (3, "x\ny\nz\nw " * 40, "en", "s", 1), (3, "x\ny\nz\nw " * 40, "en", "s", 1), (4, "long " * 30_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            some = stage(spark, some, SF)
            if name != "best-fit packing":
                assert some.columns == docs.columns, name
        some.collect()
