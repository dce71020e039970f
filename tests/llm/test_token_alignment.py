"""Alignment of two tokenizers: against loops over bytes, with the vocabulary file's own library."""

import hashlib
import json
import random
from collections import Counter

import sentencepiece
from tokenizers import Tokenizer

from framelake.llm import token_alignment
from framelake.llm.common import table
from framelake.llm.queries import QUERIES
from framelake.llm.vocabularies import BYTE_LEVEL, PIECES, byte_level
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def library():
    own = Tokenizer.from_file(BYTE_LEVEL)
    own.encode_special_tokens = True
    return own


def spans(lengths):
    at, out = 0, []
    for n in lengths:
        out.append((at, at + n))
        at += n
    return out


def by_hand(texts):
    """COLUMNS of each text, by comparing every byte range of A with every one of B near it."""
    own, sp = library(), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    byte = {c: b for c, b in zip(*_letters(), strict=True)}
    name = {i: t for t, i in json.load(open(BYTE_LEVEL, encoding="utf-8"))["model"]["vocab"].items()}
    found = []
    for text in texts:
        a = own.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        a_bytes = [bytes(byte[c] for c in name[i]) for i in a]
        b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if text and not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            a = b = a_bytes = b_bytes = []
        sa, sb = spans(map(len, a_bytes)), spans(map(len, b_bytes))
        links, j = [], 0
        for i, (s, e) in enumerate(sa):
            while j and sb[j - 1][1] > s:
                j -= 1
            for k in range(j, len(sb)):
                if sb[k][0] >= e:
                    break
                if sb[k][1] > s:
                    links.append((a[i], b[k]))
            j = min(k, len(sb) - 1)
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, low = [], 0
        for end in ends:
            groups.append(",".join(str(a[i]) for i, x in enumerate(sa) if low < x[1] <= end) + "|" + ",".join(str(b[i]) for i, x in enumerate(sb) if low < x[1] <= end))
            low = end
        found.append((len(a), len(b), groups, links))
    counts = Counter(x for *_, links in found for x in links)
    highest = Counter()
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    return [
        (n_a, n_b, len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), ";".join(groups))
        for n_a, n_b, groups, links in found
    ]


def _letters():
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return [chr(b) for b in printable] + [chr(256 + i) for i in range(len(rest))], printable + rest


def awkward():
    rng = random.Random(5)
    pick = lambda: rng.choice(["the ", "é", "ß", " <|endoftext|>", "\n\n", "  ", "\t", "日本", "😀", "naïve", "don't", "123456", "</s>", " ", "x" * 50, "é"])
    texts = ["".join(pick() for _ in range(rng.randint(1, 40))) for _ in range(80)]
    return [*texts, *texts[:3], None, "", " ", "a", "▁", "a▁b", "\x00", "word " * 3000, "�"]


def test_ids_are_the_file_s_own():
    own, fast = library(), byte_level()
    rng = random.Random(1)
    texts = [f"a{chr(c)}b 1{chr(c)}! {chr(c)} {chr(c)}{chr(c)}" for c in range(1, 0x3200)]
    texts += ["".join(rng.choice("etaoin shrdlu'.1é\n") for _ in range(60)) for _ in range(2000)]
    assert [e.ids for e in own.encode_batch(texts, add_special_tokens=False)] == [fast.encode(t) for t in texts]


def rows_of(spark, texts, chunk_links):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for c in ("chunk", "links", "pairs", "counts", "place", "total", "best", "n"):
        docs = docs.withColumn(c, F.lit("x"))
    out = token_alignment.score_links(token_alignment.align(docs.repartition(3), chunk_links=chunk_links)).collect()
    return {r.doc_id: tuple(r[c] for c in COLUMNS) for r in out}


def test_alignment_by_hand(spark):
    texts = awkward()
    want = dict(enumerate(by_hand(texts)))
    assert rows_of(spark, texts, 4_000_000) == want
    assert rows_of(spark, texts, 50) == want  # many chunks, many of one text
    at = texts.index("a▁b")
    assert want[at] == (0, 0, 0, 0, 0, 0, "") and want[texts.index("a")][0] == 1


def test_ids_of_groups_are_the_tokens(spark):
    out = token_alignment.align(spark.createDataFrame([(1, "Straße naïve")], "doc_id long, text string")).filter("doc_id is not null").first()
    sides = [g.split("|") for g in out.groups.split(";")]
    for side, ids in enumerate((out.a_ids, out.b_ids)):
        assert [int(i) for g in sides for i in g[side].split(",")] == ids


def test_no_documents(spark):
    assert rows_of(spark, [], 100) == {}
    assert rows_of(spark, [None, ""], 100) == {0: (0, 0, 0, 0, 0, 0, ""), 1: (0, 0, 0, 0, 0, 0, "")}


def test_query(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
    want = {d.doc_id: (*row[:-1], digest(row[-1])) for d, row in zip(docs, by_hand([d.text for d in docs]), strict=True)}
    got = QUERIES["op13_token_alignment"](spark, SF)
    assert got.columns == ["doc_id", *COLUMNS[:-1], "groups_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
