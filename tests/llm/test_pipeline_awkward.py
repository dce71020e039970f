"""Every stage of the pipeline on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from framelake.llm import mixing
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string, row long, n long, _gone string, times double, key string, _f long, copies long, label long"


def awkward():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(70)]
    long = " ".join(word() for _ in range(30_000))
    near = long.split()
    near[500] = "changed"
    rows = [(i, t, "hot" if i % 3 else f"s{i % 4}") for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i] + ("" if i % 2 else " \n"), "copy") for i in range(12)]
    rows += [(200, long, "a"), (201, " ".join(near), "b"), (202, long + " ", None), (203, "w" * 200_000, "c")]
    rows += [(300, None, "c"), (301, "", "c"), (302, " \t\n", None), (None, texts[3], "a"), (None, None, None), (None, "alone and without an id", "a")]
    rows += [(400, "a row that stands here three times over", "d")] * 3 + [(401, "a row that stands here three times over", "d")]
    return [(*r, 1, 2, "x", 0.5, None, 3, 4, 5) for r in rows]


def in_folder(spark, folder, rows):
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 70)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_in_turn(spark, tmp_path):
    sf = in_folder(spark, tmp_path, awkward())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, bag(docs)
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, sf)
        assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = bag(docs)
        assert set(after) <= set(before), name
        if name != "mixing":
            assert not after - before, name
        before = after
    packed = stage("packing")(spark, docs, sf)
    assert packed.count() > 0


def test_exact_copies(spark, tmp_path):
    sf = in_folder(spark, tmp_path, awkward())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = stage("exact_dedup")(spark, docs, sf).collect()
    groups = {}
    for r in awkward():
        groups.setdefault(bare(r[1]), []).append(r)
    want = {}
    for text, rows in groups.items():
        want[text] = min(rows, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
    assert {bare(r.text): r.doc_id for r in kept} == want and len(kept) == len(want)


def test_near_copies(spark, tmp_path):
    sf = in_folder(spark, tmp_path, awkward())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = Counter(r.doc_id for r in stage("near_dedup")(spark, docs, sf).collect())
    given = Counter(r[0] for r in awkward())
    assert kept[200] == 1 and not kept[201] and not kept[202] and kept[None] == given[None]
    assert all(kept[i] == given[i] for i in range(12, 70) if len((awkward()[i][1]).split()) > 10)


def test_mixing_takes_what_the_mix_says(spark, tmp_path):
    sf = in_folder(spark, tmp_path, awkward())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    taken = Counter()
    for r in stage("mixing")(spark, docs, sf).collect():
        taken[r.source] += words(r.text)
    want = {r.source: r.target for r in mixing.mix_sources(docs).select("source", "target").distinct().collect()}
    longest = Counter()
    for r in awkward():
        longest[r[2]] = max(longest[r[2]], words(r[1]))
    for source, target in want.items():
        assert abs(taken[source] - target) <= longest[source] + 1, source


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables(spark, tmp_path, name):
    sf = in_folder(spark, tmp_path, [])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert stage(name)(spark, docs, sf).count() == 0


def test_whole_run_on_awkward_rows(spark, tmp_path):
    sf = in_folder(spark, tmp_path, awkward())
    assert corpus_pipeline.run(spark, sf).select(F.count("*")).first()[0] > 0
