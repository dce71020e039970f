"""Operators over documents: against DuckDB or brute force, on awkward rows."""

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

from framelake.llm import exact_dedup, language_id, mixing, packing, quality, simhash, substring_dedup
from framelake.llm.common import held_out, table
from framelake.llm.components import connected_components
from framelake.llm.queries import ORACLES, QUERIES
from framelake.llm.sampling import labelled_texts
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
#: A further column for each name that operators use inside.
CLASH = {c: 7 for c in ("key", "digest", "node", "fp", "size", "target", "kind", "bucket", "uid", "row", "n", "words", "best", "_gone", "_f", "start", "copies")}


def awkward():
    """Nulls, empty and very long texts, ties, repeated rows, hot source, copies and near copies, shared passages."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(30))
    rows = []
    for i in range(120):
        words = [word() for _ in range(rng.randint(0, 90))]
        if i % 4 == 0:
            words[10:10] = passage.split()
        rows.append((i, " ".join(words), "hot" if i % 3 else f"s{i % 5}"))
    rows += [(200, rows[5][1], "a"), (201, rows[5][1] + " \n", None), (202, rows[5][1].replace(" ", "\t"), "a"), (203, rows[7][1] + " z", "b")]
    rows += [(None, rows[5][1], "a"), (None, None, None), (300, None, "c"), (301, "", "c"), (302, " \t\n\x0b\x0c\r ", "c"), (303, "x y", "c")]
    rows += [(400, "same row here", "d")] * 3 + [(400, "another text of that id", "d")]
    rows += [(500, "la " * 40 + passage, "e"), (501, "la " * 50, "e"), (502, "w" * 9000 + " " + " ".join(word() for _ in range(5000)), "e")]
    rows += [(600, "\u00a0nbsp stays\u2003a word " + passage, "f"), (601, "É e\u0301 " + passage.upper(), "f")]
    return pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})


def frames(spark, pdf):
    docs = spark.createDataFrame([tuple(None if pd.isna(v) else int(v) if k == 0 else v for k, v in enumerate(r)) for r in pdf.itertuples(index=False)], "doc_id long, text string, source string")
    for c, v in CLASH.items():
        docs = docs.withColumn(c, F.lit(v))
    return docs.repartition(3)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def by_duckdb(pdf, sql, columns):
    con = duckdb.connect()
    con.register("given", pdf)
    con.sql("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text, CAST(source AS VARCHAR) AS source FROM given")
    return Counter(con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())


CASES = {
    "op1_substring_dedup": lambda d: substring_dedup.drop_repeats(d).withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256)),
    "op2_packing": packing.pack,
    "op3_mixing": mixing.mix_sources,
    "op7_exact_dedup": exact_dedup.exact_dedup,
}
COLUMNS = {
    "op1_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op2_packing": ["doc_id", "piece", "n_words", "bucket", "bucket_len", "batch", "slot", "padding"],
    "op3_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op7_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("part", ["all", "one", "none"])
def test_against_sql(spark, name, part):
    pdf = awkward()
    pdf = {"all": pdf, "one": pdf[pdf.doc_id == 303], "none": pdf[:0]}[part]
    columns = COLUMNS[name]
    got = rows_of(CASES[name](frames(spark, pdf)).select(columns))
    assert got == by_duckdb(pdf, ORACLES[name], columns)


def test_mixing_nears_targets(spark):
    out = mixing.mix_sources(table(spark, SF, "documents")).toPandas()
    by = out.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by.taken - by.target) < 1).all()
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-6 and (by.target <= 2 * by["size"]).all()
    assert (out.taken <= 2 * out["size"]).all()


def test_mixed_documents_repeat_whole_rows(spark):
    pdf = awkward()
    docs = frames(spark, pdf)
    counts = defaultdict(int)
    for r in mixing.mix_sources(docs).collect():
        counts[r.doc_id, r.source, r.size] += r.copies
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    size = lambda t: len((t or "").encode().split())
    got = Counter((r.doc_id, r.source, size(r.text)) for r in out.collect())
    assert got == Counter({k: v for k, v in counts.items() if v})


def test_bucket_lengths_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(5)
    for _ in range(20):
        lengths = sorted(rng.choice(40, 8, replace=False).tolist())
        counts = rng.integers(1, 50, 8).tolist()
        waste = lambda tops: sum(c * (min(t for t in tops if t >= x) - x) for x, c in zip(lengths, counts, strict=True))  # noqa: B023, E731
        got = packing.bucket_lengths(lengths, counts, 3)
        assert len(got) == 3 and waste(got) == min(waste([*c, lengths[-1]]) for c in combinations(lengths[:-1], 2))
    assert packing.bucket_lengths([5], [3], 4) == [5]


def test_pack_keeps_every_word_and_budget(spark):
    out = packing.pack(frames(spark, awkward()), max_len=64, buckets=4, budget=256).toPandas()
    size = Counter()
    for r in out.itertuples():
        size[r.doc_id if r.doc_id == r.doc_id else None] += r.n_words
    words = Counter()
    for r in awkward().itertuples():
        words[None if pd.isna(r.doc_id) else r.doc_id] += len((r.text or "").encode().split())
    assert +size == +words
    batches = out.groupby(["bucket", "batch"]).agg(rows=("slot", "size"), slots=("slot", "nunique"), top=("bucket_len", "first"))
    assert (batches.rows == batches.slots).all() and (batches.rows * batches.top <= 256).all()


@pytest.mark.parametrize("width", [13, 50])
def test_substrings_with_colliding_names(spark, width):
    """With keys of one byte and three bits of the first hash nearly all windows meet; the second hash tells them apart."""
    pdf = awkward()
    first = {}
    for r in pdf[pdf.doc_id.notna()].itertuples():
        own = (r.text if isinstance(r.text, str) else "").encode().split()
        for i in range(len(own) - width + 1):
            window = tuple(own[i : i + width])
            first[window] = min(first.get(window, r.doc_id), r.doc_id)
    want = Counter()
    for r in pdf.itertuples():
        own = (r.text if isinstance(r.text, str) else "").encode().split()
        gone = set()
        for i in range(len(own) - width + 1):
            if not pd.isna(r.doc_id) and first[tuple(own[i : i + width])] < r.doc_id:
                gone.update(range(i, i + width))
        kept = b" ".join(w for i, w in enumerate(own) if i not in gone).decode()
        want[(None if pd.isna(r.doc_id) else int(r.doc_id), len(own), len(gone), kept)] += 1
    assert sum(n for _, _, n, _ in want) > 100
    assert rows_of(substring_dedup.drop_repeats(frames(spark, pdf), width=width, key_bytes=1, first_bits=3)) == want
    assert rows_of(substring_dedup.drop_repeats(frames(spark, pdf), width=width)) == want


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(ids))]


@pytest.mark.parametrize("part", ["all", "none"])
def test_simhash(spark, part):
    pdf = awkward() if part == "all" else awkward()[:0]
    ids = [None if pd.isna(x) else int(x) for x in pdf.doc_id]
    prints = [brute_fingerprint(None if pd.isna(t) else t) for t in pdf.text]
    want = Counter(zip(ids, (f"{p:016x}" for p in prints), brute_components(ids, prints), strict=True))
    assert rows_of(simhash.near_duplicates(frames(spark, pdf))) == want


def test_simhash_links_among_planted_fingerprints():
    rng = np.random.default_rng(1)
    values = set(rng.integers(0, 2**63, 200).tolist())
    for centre in list(values)[:50]:
        for n in range(1, 6):
            flipped = centre
            for bit in rng.choice(64, n, replace=False):
                flipped ^= 1 << int(bit)
            values.add(flipped)
    ball = 12345
    values |= {ball ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False)) for _ in range(5500)}
    v = np.array(sorted(values), dtype=np.uint64)
    import pyarrow as pa

    rows = [(t, int(x & np.uint64(simhash._SEGMENTS[a] | simhash._SEGMENTS[b])), int(x)) for t, (a, b) in enumerate(simhash.KEYS) for x in v]
    rows.sort()
    t, k, f = (np.array(c, dtype=d) for c, d in zip(zip(*rows, strict=True), (np.int32, np.uint64, np.uint64), strict=True))
    batches = [pa.RecordBatch.from_arrays([pa.array(t[i : i + 999]), pa.array(k[i : i + 999].view(np.int64)), pa.array(f[i : i + 999].view(np.int64))], names=["t", "k", "f"]) for i in range(0, len(t), 999)]
    links = [(int(a), int(b)) for out in simhash._links(3)(iter(batches)) for a, b in zip(*(out.column(i).to_numpy().view(np.uint64) for i in range(2)), strict=True)]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    at = {int(x): i for i, x in enumerate(v)}

    def roots(pairs):
        parent = list(range(len(v)))

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        return [root(i) for i in range(len(v))]

    near = [(i, i + 1 + int(j)) for i in range(len(v)) for j in np.nonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= 3)[0]]
    assert roots([(at[a], at[b]) for a, b in links]) == roots(near)
    assert len(links) <= 4 * len(simhash.KEYS) * len(v)


def test_simhash_splits_crowded_keys(spark):
    rng = np.random.default_rng(4)
    ball = {777 ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)) for _ in range(700)}
    values = sorted({v - (1 << 64) if v >> 63 else v for v in ball})
    df = spark.createDataFrame([(v,) for v in values], "fp long").repartition(3)
    want, got = ({(r.node, r.root) for r in connected_components(simhash.fingerprint_links(df, crowded=n)).collect()} for n in (10**6, 20))
    assert got == want and len(want) > 300


def test_rows_without_an_id_mix_and_dedup(spark):
    rows = [(None, f"w{i % 40} and more words here", "s", i % 3) for i in range(400)] + [(7, "same text", "s", 1)] * 300 + [(8, "x y z", "t", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang long").repartition(5)
    mixed = mixing.mix_sources(docs)
    assert mixed.count() == 701 and mixed.groupBy("source").agg(F.abs(F.sum("taken") - F.first("target")) < 1).filter("NOT `(abs((sum(taken) - first(target))) < 1)`").count() == 0
    out = [rows_of(mixing.mixed_documents(docs.repartition(n))) for n in (2, 7)]
    assert out[0] == out[1] and sum(out[0].values()) == mixed.agg(F.sum("copies")).first()[0]
    kept = [rows_of(exact_dedup.drop_exact_copies(docs.repartition(n))) for n in (2, 7)]
    assert kept[0] == kept[1] and sum(kept[0].values()) == 42


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5), (7, 6)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_drop_exact_copies(spark):
    pdf = awkward()
    docs = frames(spark, pdf)
    out = exact_dedup.drop_exact_copies(docs)
    assert out.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in out.collect())
    want = exact_dedup.exact_dedup(docs).filter("kept").select("doc_id", "text_sha256").collect()
    assert Counter(k[0] for k in kept) == Counter(r.doc_id for r in want) and sum(kept.values()) == len(want)
    assert exact_dedup.drop_exact_copies(docs.limit(0)).count() == 0


def test_drop_near_copies(spark):
    docs = frames(spark, awkward())
    out = simhash.drop_near_copies(docs)
    assert out.columns == docs.columns
    stay = Counter(r.doc_id for r in simhash.near_duplicates(docs).collect() if r.doc_id is None or r.doc_id == r.component_id)
    assert Counter(r.doc_id for r in out.collect()) == stay


def test_language_id(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    apart = out[out.held_out]
    assert len(apart) > 100 and (apart.lang_pred == apart.lang).mean() > 0.98
    assert out.score.between(0, 1).all()


def test_language_id_awkward(spark):
    train = [("the cat and the dog", "en")] * 3 + [("der hund und die katze", "de")] * 3
    model = language_id.LanguageModel([t for t, _ in train], [x for _, x in train])
    texts = [None, "", "12 !!", "²³", "the dog", "Und die", "cats", "é" * 5000, "the dog"]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, score double")
    got = language_id.identify(docs, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got[:7]] == ["und"] * 4 + ["en", "de", "en"]
    assert [r.score for r in got[:4]] == [0.0] * 4 and got[4].score == got[8].score
    assert language_id.identify(docs.limit(0), model).count() == 0
    empty = language_id.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language_id.identify(docs, empty).collect()} == {"und"}


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    out = QUERIES["op9_quality"](spark, sf).join(labels, "doc_id").toPandas()
    apart = out[out.held_out]
    assert len(apart) > 40 and (apart.predicted == apart.quality).mean() > 0.9
    assert (out.predicted == (out.score >= 0.3)).all() and out.score.between(0, 1).all()


def test_quality_awkward(spark):
    model = quality.QualityModel(["good words stand here", "BAD ### !!! |||"] * 40, [1, 0] * 40, epochs=20)
    texts = [None, "", "x", "good words", "BAD !!!", "y" * 20000, "word " * 30000]
    docs = spark.createDataFrame([(i, t, 0.5, 3) for i, t in enumerate(texts)], "doc_id long, text string, score double, predicted int")
    got = quality.classify(docs, model).orderBy("doc_id").collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got) and abs(got[0].score - got[1].score) < 1e-12
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.classify(docs.limit(0), model).count() == 0
    assert quality.QualityModel([], []).score(["a", None]).tolist() == [0.5, 0.5]


def test_held_out_matches_crc32(spark):
    import zlib

    got = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_samples_have_every_label_and_stay_bounded(spark):
    rows = [(i, f"text {i} " + "x " * (i % 7), "common") for i in range(3000)] + [(5000 + i, f"rare {i}", "rare") for i in range(3)]
    rows += [(6000, "long " * 20_000, "long"), (7000, "again", "again"), (7000, "again", "again"), (None, "no id", "common")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(4)
    got = labelled_texts(docs, 200, 20_000)
    assert set(got.label) == {"common", "rare", "long", "again"} and 80 < len(got) < 300
    assert Counter(got.label)["rare"] == 3 and Counter(got.label)["again"] == 1
    assert got.equals(labelled_texts(docs.repartition(2), 200, 20_000))
    assert labelled_texts(docs.limit(0), 200, 20_000).empty


def test_rare_language_is_learned(spark):
    rng = random.Random(4)
    of = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(12))
    rows = [(i, of("abcde"), "aa") for i in range(4000)] + [(9000 + i, of("vwxyz"), "zz") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(docs, language_id.fit(docs, rows=100)).toPandas().set_index("doc_id").lang_pred
    assert (got[got.index >= 9000] == "zz").all() and (got[got.index < 9000] == "aa").all()
