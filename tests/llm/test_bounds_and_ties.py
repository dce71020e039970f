"""Samples that one id can't swell, products beyond the range of doubles, and masses that are equal by symmetry."""

import numpy as np
import pytest

from framelake.llm import ann, quality, url_filter
from framelake.llm.sampling import bounded_texts
from pyspark.sql import functions as F


def test_one_id_cannot_swell_a_sample(spark):
    many = spark.range(30_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    known = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, label int")
    sample = bounded_texts(known, many, 6_000, 10**9)
    assert 5_500 < len(sample) < 6_500
    few = bounded_texts(known, many, 10**9, 5_000)
    assert 0 < few.text.str.len().sum() < 6_500
    same = bounded_texts(known, many.withColumn("text", F.lit("same")), 6_000, 10**9)
    assert same.values.tolist() == [[7, "same", 1]]


def test_a_model_learns_where_ids_repeat_and_labels_contradict(spark):
    good, bad = "a calm and well made sentence about rivers and hills number", "BUY NOW !!! $$$ CLICK >>> win win win"
    docs = spark.createDataFrame([(1, f"{good} {i}") for i in range(400)] + [(2, f"{bad} {i}") for i in range(400)] + [(3, None), (None, good)], "doc_id long, text string").withColumn("label", F.lit("x")).withColumn("quality", F.lit(0))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, 1, 0), (None, 1, 0), (1, 1, 1), (5, 7, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")).withColumn("label", F.lit(9))
    model = quality.fit(docs, labels)
    scored = quality.classify(spark.createDataFrame([(10, f"{good} 999"), (11, f"{bad} 999"), (12, ""), (13, None)], "doc_id long, text string"), model)
    got = {r.doc_id: r for r in scored.collect()}
    assert got[10].score > 0.7 and got[11].score < 0.3 and all(0 <= r.score <= 1 for r in got.values())


def ranked(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_products_beyond_doubles_keep_all_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.choice([-1.0, 1.0], 3) * 1e200).tolist()) for i in range(60)] + [(100 + i, rng.normal(size=3).tolist()) for i in range(30)]
    got = ranked(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), recall=1.0))
    of = {i: np.array(v) for i, v in rows}
    want = []
    for q in sorted(i for i in of if i % 20 == 0):
        with np.errstate(all="ignore"):
            scores = [(float(np.multiply(of[i], of[q]).sum()), i) for i in of if i != q]
        scores.sort(key=lambda x: (np.isnan(x[0]), 0.0 if np.isnan(x[0]) else -x[0], x[1]))
        want += [(q, r + 1, i, s) for r, (s, i) in enumerate(scores[:20])]
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.array_equal([x[3] for x in got], [x[3] for x in want], equal_nan=True)
    assert sum(q < 60 for q, *_ in got) == 60 and np.isinf([s for q, r, _, s in got if q < 60 and r == 1]).all()


def mirrored(spark, n, parts):
    """A trusted host that reaches m through n others, and m that reaches a blocked host through n others, alike."""
    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    weights = {i: 1 + (i * 7) % 5 for i in range(n)}
    pages = [("http://t.org/fr/a", link(*(f"a{i}.com" for i in range(n) for _ in range(weights[i]))))]
    pages += [(f"http://a{i}.com/", link("m.com", f"side{i}.com")) for i in range(n)]
    pages += [("http://m.com/", link(*(f"b{i}.com" for i in range(n))))]
    pages += [(f"http://b{i}.com/", link(*["c.net"] * weights[i])) for i in range(n)]
    pages += [(f"http://side{i}.com/", "") for i in range(n)] + [(f"http://other{i}.com/", link(f"b{i}.com")) for i in range(n)]
    pages += [("http://c.net/", "")]
    rows = [(i, u, h) for i, (u, h) in enumerate(pages)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)


@pytest.mark.parametrize("n", [3, 11])
def test_equal_masses_allow_whatever_the_order_of_sums(spark, n):
    seen = set()
    for parts in (1, 5):
        got = url_filter.filter_urls(mirrored(spark, n, parts))
        row = got.filter("host = 'm.com'").first()
        assert row.trust == pytest.approx(row.distrust, rel=1e-12) and row.trust > 0
        seen.add(row.verdict)
    assert seen == {"allow"}
