"""Operators over pages and embeddings, and the pipeline."""

import json
from collections import Counter

import duckdb
import numpy as np

import corpus_pipeline
from framelake.llm import ann, html_extraction, url_filter
from framelake.llm.common import table
from framelake.llm.queries import ORACLES

from test_near_copies import brute as near_copies_kept

URLS = [
    "http://a.example.net/en/1?x", "https://NET/", "http://net", "x://b.net/en/", "http://m.example.com/de/2#t", "http://example.com/de", "http://q.org/fr/",
    "http://q.org/de/", None, "no scheme", "", "http://q.org?u=/fr/", "http://w.org/fr/a://b", "http://good.org/fr/1", "http://good.org/fr/1", "http://z.test/1", "http://y.test/1", "http://u.test/",
]
HTML = {
    "http://z.test/1": '<a href="http://good.org/x">a</a><a href=//GOOD.org>b</a>', "http://y.test/1": "<a HREF='https://b.net/en/'>x</a>",
    "http://good.org/fr/1": '<a href="http://u.test/">t</a>', "http://u.test/": None,
}


def url_pages(spark, urls=URLS):
    rows = [(i, u, HTML.get(u, "<p>x</p>"), "c") for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string")


def test_url_filter_against_sql(spark):
    for urls in (URLS, URLS[:1], []):
        pages = url_pages(spark, urls)
        got = Counter(tuple(r) for r in url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict").collect())
        con = duckdb.connect()
        con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
        for r in pages.select("page_id", "url", "html").collect():
            con.execute("INSERT INTO pages VALUES (?, ?, ?)", list(r))
        assert got == Counter(con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({ORACLES['op5_url_filter']})").fetchall())


def test_url_rules_and_graph(spark):
    rows = {r.page_id: r for r in url_filter.filter_urls(url_pages(spark)).collect()}
    assert (rows[0].rule, rows[0].verdict) == ("example.net/en/", "allow")
    assert (rows[1].rule, rows[1].verdict) == ("net/", "block")
    assert rows[2].rule is None and rows[3].rule == "net/" and rows[4].rule == "example.com/de/"
    assert rows[5].rule is None and rows[6].rule == "org/fr/" and rows[7].rule is None
    assert (rows[8].host, rows[8].path) == ("", "") and rows[9].host == ""
    assert rows[11].path == "" and rows[12].path == "/fr/a://b"
    by = {r.host: r for r in rows.values()}
    assert by["y.test"].distrust > 0 and by["y.test"].verdict == "block"  # it links to a blocked host
    assert by["u.test"].trust > 0 and by["u.test"].verdict == "allow"  # an allowed host links to it


PAGES = [
    ("<html><head><title>T</title></head><body><nav><ul><li><a href=x>Menu</a></ul></nav><article><h1>Head</h1><p>One <b>bo</b>ld &amp; &lt;b&gt;<p>Two<br>lines</article><footer>f</footer>", "Head One bold & <b> Two lines"),
    ("<article><header><h1>In</h1></header><p>a\n b\u00a0c</p><div class='comments'><p>no</p></div><form>no</form><script>var t='</p>'</script></article>", "In a b c"),
    ("<body><header>Site</header><div id=sidebar>s</div><div class=post><p>Body text that is long enough.</p><p>More.</p></div><div class=cookie-notice>We use</div></body>", "Body text that is long enough. More."),
    (None, ""), ("", ""), ("plain &copy text", "plain © text"), ("<article>cut off &am", "cut off &am"), ("<article>tag <p", "tag"),
    ("<nav>only menu</nav>", ""), ("<article>" + "word " * 50000 + "</article>", ("word " * 50000).strip()),
    ("<article>" + "<div>" * 30000 + "deep" + "</p>" * 30000 + "</div>" * 30000 + "<p>end</article>", "deep end"),
]


def test_main_text(spark):
    rows = [(i, f"http://h{i % 3}.test/{i}", h, "clash") for i, (h, _) in enumerate(PAGES)]
    rows += [(100 + i, f"http://t.test/{i}", f"<div class=top><p>Always here</p></div><div class=main><p>Story number {i} goes on for a while, longer than the rest.</p></div>", "c") for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in html_extraction.extract_main_text(pages).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert got[i].text == want and got[i].n_chars == len(want) and got[i].url == rows[i][1]
    for i in range(5):
        assert got[100 + i].text.startswith(f"Story number {i}") and "Always" not in got[100 + i].text
    assert html_extraction.extract_main_text(pages.limit(0)).count() == 0


def test_wrappers_are_union_free(spark):
    one = "<body><div class=a><p>x</p></div><dl><dt>k<dd>v<dt>k<dd>v</dl></body>"
    two = "<body><div class=a><p>x</p><p>y</p></div><div class=b>o</div><dl><dt>k<dd>v</dl></body>"
    pages = spark.createDataFrame([(1, "http://h.test/1", one), (2, "http://h.test/2", two)], "page_id long, url string, html string")
    row = html_extraction.infer_wrappers(pages).first()
    assert row.pattern.startswith("body[div.a[p[#]+] ") and "div.b[#]?" in row.pattern and "|" not in row.pattern


def test_trees_merge_alike_in_any_number_of_rounds(spark):
    bodies = ["".join(f"<div class=c{chr(97 + b)}><p>x</p></div>" for b in range(6) if i >> b & 1) for i in range(1, 60)]
    pages = spark.createDataFrame([(i, f"http://h.test/{i}", f"<body>{b}</body>") for i, b in enumerate(bodies)] + [(99, "http://other.test/", "<p>y")], "page_id long, url string, html string")
    trees = spark.createDataFrame([("h", json.dumps(html_extraction.page_wrapper(html_extraction.read_page(f"<body>{b}</body>")[0]))) for b in bodies], "host string, tree string")
    few, many = (html_extraction.merge_trees(trees, n).collect() for n in (4, 64))
    want = {f"/body/div.c{c}/p" for c in "abcdef"}
    for rows in (few, many):
        assert len(rows) == 1 and set(html_extraction.slot_paths(json.loads(rows[0].tree))) == want
    all_rows = {r.page_id: r.text for r in html_extraction.extract_main_text(pages).collect()}
    assert all_rows == {r.page_id: r.text for r in html_extraction.extract_main_text(pages, broadcast_bytes=0).collect()} and len(all_rows) == 60


def test_pages_of_the_test_data(spark):
    import html as h
    import re

    for r in html_extraction.extract_main_text(table(spark, "/root/testdata/sf0.001", "pages")).join(table(spark, "/root/testdata/sf0.001", "pages").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        inner = re.sub(r"<[^>]*(>|$)", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", inner))
        assert r.text == " ".join(h.unescape(inner).split())


def brute(vectors, ids, k=20):
    out = {}
    for i, q in enumerate(ids):
        if q % 20 == 0:
            score = vectors @ vectors[i]
            order = np.lexsort((ids, -score))
            out[int(q)] = [int(ids[j]) for j in order if ids[j] != q][:k]
    return out


def test_ann_recall(spark):
    rows = table(spark, "/root/testdata/sf0.1", "embeddings").orderBy("vec_id").toPandas()
    vectors = np.stack(rows.embedding.to_numpy()).astype(float)
    want = brute(vectors, rows.vec_id.to_numpy())
    got = ann.nearest(table(spark, "/root/testdata/sf0.1", "embeddings")).toPandas()
    found = {q: set(g.vec_id) for q, g in got.groupby("query_id")}
    assert np.mean([len(found[q] & set(w)) / len(w) for q, w in want.items()]) >= 0.9
    by_id = dict(zip(rows.vec_id, vectors, strict=True))
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21))
        assert list(zip(-g.score, g.vec_id, strict=True)) == sorted(zip(-g.score, g.vec_id, strict=True))
        assert np.allclose(g.score, [by_id[q] @ by_id[v] for v in g.vec_id], atol=1e-12)


def test_ann_awkward(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(30)] + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(30, 60)]
    bad = [(None, [1.0] * 4), (61, None), (80, [0.0] * 4), (100, [float("nan"), 1.0, 1.0, 1.0]), (62, [float("inf"), 0.0, 0.0, 1.0]), (63, [None, 1.0, 1.0, 1.0]), (120, [1.0]), (140, [])]
    table_ = spark.createDataFrame([(*r, 1, 2.0) for r in good + bad], "vec_id long, embedding array<float>, leaf int, score double")
    got = ann.nearest(table_, piece=8, leaf=10, recall=1.0).toPandas()
    vectors = np.array([v for _, v in good], dtype=np.float32).astype(float)
    want = brute(vectors, np.array([i for i, _ in good]))
    assert {q: list(g.sort_values("rank").vec_id) for q, g in got.groupby("query_id")} == want
    few = ann.nearest(spark.createDataFrame(good[:5], "vec_id long, embedding array<float>"))
    assert few.count() == 4 and ann.nearest(table_.limit(0)).count() == 0
    assert ann.nearest(table_.filter("vec_id = 61")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    names = docs.columns
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.toPandas()
        seen.append(name)
        if name == "quality":
            good = {d for d in before.doc_id if labels.get(d) == 1}
            assert len(good & set(after.doc_id)) >= 0.97 * len(good) and set(after.doc_id) <= set(before.doc_id)
        elif name == "exact_dedup":
            key = lambda t: "".join(c for c in t if c not in " \t\n\x0b\x0c\r")
            best = {}
            for r in before.sort_values("doc_id").itertuples():
                if key(r.text) not in best or len(r.text) > best[key(r.text)][1]:
                    best[key(r.text)] = (r.doc_id, len(r.text))
            assert sorted(after.doc_id) == sorted(d for d, _ in best.values())
        elif name == "near_dedup":
            assert Counter(after.doc_id) == near_copies_kept(list(zip(before.doc_id, before.text, strict=True)))
        elif name == "mixing":
            size = lambda f: f.text.map(lambda t: len(t.encode().split())).groupby(f.source).sum()
            had, has = size(before), size(after)
            assert (has <= 2 * had).all() and abs(has.sum() - 1.5 * had.sum()) < 0.1 * had.sum()
        if name != "packing":
            assert docs.columns == names
        else:
            assert after.n_words.sum() == before.text.map(lambda t: len(t.encode().split())).sum()
    assert len(seen) == 5
    assert corpus_pipeline.run(spark, sf).count() == len(after)
