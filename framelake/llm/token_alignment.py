"""Alignment of two tokenizers' tokens over the bytes of the same texts.

Both tokenizers' tokens cut a text's bytes into intervals. B's intervals make a
static index; for each token of A two bisections find the tokens of B that it
overlaps, and the gaps between tokens of B that no token of A spans are where groups
end. Texts are aligned in chunks of about 2 million bytes, whose link pairs are
numbered inside the chunk, so a chunk asks for each pair's count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import checkpoint_folder
from framelake.llm.vocabularies import BYTE_LEVEL, PIECES, byte_level, pieces

#: Bytes of text that are aligned at once; a longer text is aligned alone.
ALIGNED_BYTES = 2_000_000
#: Links after which a chunk, whose pairs are counted together, ends.
CHUNK_LINKS = 4_000_000


def _joined_bytes(spellings: list[bytes], ids: list[int]) -> bytes:
    return b"".join(map(spellings.__getitem__, ids))


class Aligner:
    """The tokens, groups and links of texts under two vocabularies."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = byte_level(a_path), pieces(b_path)
        self.a_len = np.array([len(x) for x in self.a.bytes], dtype=np.int64)
        self.b_len = np.array([len(x) for x in self.b.bytes], dtype=np.int64)
        most = max(len(self.a_len), len(self.b_len))
        #: The id of each token, spelled with what follows it: nothing, a comma, a bar, a semicolon.
        self.spelled = np.array([f"{i}{mark}" for mark in ("", ",", "|", ";") for i in range(most)], dtype=object)
        self.most = most

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of a text after a space; none where it is null or empty, or where tokens don't spell it again."""
        if not text:
            return [], []
        want = (" " + text).encode()
        a, b = self.a.encode(" " + text), self.b.encode(text)
        if _joined_bytes(self.a.bytes, a) != want or _joined_bytes(self.b.bytes, b) != want:
            return [], []
        return a, b

    def align(self, texts: list[tuple[list[int], list[int]]]) -> dict[str, np.ndarray | list]:
        """Counts and groups for each text, and all links as (A id, B id) with each text's number of them."""
        n = len(texts)
        n_a, n_b = (np.array([len(t[k]) for t in texts], dtype=np.int64) for k in (0, 1))
        a, b = (np.fromiter((i for t in texts for i in t[k]), dtype=np.int64, count=c.sum()) for k, c in ((0, n_a), (1, n_b)))
        out = {"n_a": n_a, "n_b": n_b, "n_groups": np.zeros(n, np.int64), "n_links": np.zeros(n, np.int64), "groups": [""] * n, "a": a, "b": b}
        if not len(a):
            return out | {"link_a": a, "link_b": b}
        # Texts lie end to end on one axis of bytes, so tokens of different ones never overlap.
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        a_start = a_end - self.a_len[a]
        first = np.searchsorted(b_end, a_start, side="right")
        last = np.searchsorted(b_end, a_end, side="left")
        spans = last - first + 1
        # A token of A spans the gaps after the tokens of B from its first to the one before its last.
        steps = np.zeros(len(b) + 1, dtype=np.int64)
        np.add.at(steps, first, 1)
        np.add.at(steps, last, -1)
        closed = np.cumsum(steps[:-1]) == 0
        b_group = np.concatenate([[0], np.cumsum(closed)[:-1]])
        a_group = b_group[first]
        a_text, b_text = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
        out["n_groups"] = np.bincount(b_text[closed], minlength=n)
        out["n_links"] = np.bincount(a_text, weights=spans, minlength=n).astype(np.int64)
        nth = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
        out["link_a"], out["link_b"] = np.repeat(a, spans), b[np.repeat(first, spans) + nth]
        out["groups"] = self._spell(a, b, a_group, b_group, closed, n_a, n_b)
        return out

    def _spell(self, a, b, a_group, b_group, closed, n_a, n_b) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for each text."""
        groups = int(b_group[-1]) + 1
        a_of, b_of = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
        a_at = np.arange(len(a)) + (np.cumsum(b_of) - b_of)[a_group]
        b_at = np.arange(len(b)) + np.cumsum(a_of)[b_group]
        flat = np.empty(len(a) + len(b), dtype=np.int64)
        a_last = np.append(a_group[1:] != a_group[:-1], True)
        b_mark = np.where(closed, 3, 1)
        b_mark[(np.cumsum(n_b) - 1)[n_b > 0]] = 0
        flat[a_at] = a + self.most * np.where(a_last, 2, 1)
        flat[b_at] = b + self.most * b_mark
        parts = self.spelled[flat].tolist()
        edge = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        return ["".join(parts[s:e]) for s, e in zip(edge, edge[1:], strict=False)]


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class _Chunk:
    """The aligned texts of a chunk, and its pairs with the links that hold each."""

    def __init__(self, key: int) -> None:
        self.key, self.links, self.size = key, [], 0
        self.rows: dict[str, list] = {c: [] for c in ("doc_id", "groups", "a_ids", "b_ids", *_COUNTS)}

    def add(self, doc_ids: list, found: dict, b_size: int) -> None:
        self.rows["doc_id"] += doc_ids
        self.rows["groups"] += found["groups"]
        for c in _COUNTS:
            self.rows[c] += found[c].tolist()
        for side, ids, n in (("a_ids", found["a"], found["n_a"]), ("b_ids", found["b"], found["n_b"])):
            self.rows[side] += np.split(ids.astype(np.int32), np.cumsum(n)[:-1]) if len(n) else []
        self.links.append(found["link_a"] * b_size + found["link_b"])
        self.size += len(found["link_a"])

    def batches(self, schema: pa.Schema, most: int = 1000) -> Iterator[pa.RecordBatch]:
        """Rows of texts, then one of the chunk's pairs."""
        codes, local, counts = np.unique(np.concatenate(self.links), return_inverse=True, return_counts=True)
        edge = np.concatenate([[0], np.cumsum(self.rows["n_links"])]).astype(np.int64)
        # Places of a chunk's pairs need two bytes where it has few of them.
        local = local.astype(np.uint16 if len(codes) <= 1 << 16 else np.uint32)
        none = lambda n: [None] * n
        for s in range(0, len(self.rows["doc_id"]), most):
            part = {c: v[s : s + most] for c, v in self.rows.items()}
            n = len(part["doc_id"])
            part |= {"chunk": [self.key] * n, "pairs": none(n), "counts": none(n), "links": [local[edge[i] : edge[i + 1]].tobytes() for i in range(s, s + n)]}
            yield pa.RecordBatch.from_arrays([pa.array(part[f.name], f.type) for f in schema], schema=schema)
        own = {"chunk": [self.key], "pairs": [codes.astype(np.int64).tobytes()], "counts": [counts.astype(np.int64).tobytes()]}
        yield pa.RecordBatch.from_arrays([pa.array(own.get(f.name, [None]), f.type) for f in schema], schema=schema)


def align(docs: DataFrame, a_path: str = BYTE_LEVEL, b_path: str = PIECES, id_col: str = "doc_id", text_col: str = "text", chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """One row per document: chunk, doc_id, n_a, n_b, n_groups, n_links, groups, a_ids, b_ids, links; and a row per chunk with its pairs.

    ``groups`` spells ids as ``a1,a2|b1;a3|b2,b3``: a group ends where tokens of
    both sides end. A link is a token of A and one of B whose bytes overlap.
    ``links`` are a document's links in order, as places in its chunk's ``pairs`` (code A id times
    B's size plus B id); the chunk's own row has null in ``links``, its pairs and
    their counts. Texts that are null or empty, or that tokens of either side
    don't spell again (after one space), have no tokens: counts of 0, empty
    ``groups``. Whole texts are read; repeated rows are rows; an empty table gives
    no rows. Further columns of ``docs`` are not read. Both files are read by every executor.
    """
    doc = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path)
        b_size = len(aligner.b_len)
        key = TaskContext.get().partitionId() << 32
        chunk = schema = None
        for batch in batches:
            if schema is None:
                schema = _aligned_schema(batch.schema.field(0).type)
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for s, e in _runs(texts):
                chunk = chunk or _Chunk(key)
                chunk.add(ids[s:e], aligner.align([aligner.tokens(texts[i].as_py()) for i in range(s, e)]), b_size)
                if chunk.size >= chunk_links:
                    yield from chunk.batches(schema)
                    chunk, key = None, key + 1
        if chunk:
            yield from chunk.batches(schema)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _aligned_ddl(doc))


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of a batch's rows with about ALIGNED_BYTES of text each."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n or 0
        if size >= ALIGNED_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _aligned_ddl(doc: str) -> str:
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return f"chunk long, doc_id {doc}, {counts}, groups string, a_ids array<int>, b_ids array<int>, links binary, pairs binary, counts binary"


def _aligned_schema(doc: pa.DataType) -> pa.Schema:
    counts = [(c, pa.int64()) for c in _COUNTS]
    ids = [(c, pa.list_(pa.int32())) for c in ("a_ids", "b_ids")]
    return pa.schema([("chunk", pa.int64()), ("doc_id", doc), *counts, ("groups", pa.string()), *ids, ("links", pa.binary()), ("pairs", pa.binary()), ("counts", pa.binary())])


def score_links(aligned: DataFrame, b_path: str = PIECES) -> DataFrame:
    """``aligned``'s documents with n_best and count_sum in place of links, pairs and counts.

    A pair's count is the number of links of all documents that hold it; n_best
    is the number of a document's links whose count is the highest that their B
    id has, count_sum the sum of its links' counts. ``aligned`` is ``align``'s
    result, less any columns but chunk, links, pairs and counts. It is written
    once, as both its pairs and its documents are read. Pairs meet over all
    chunks once for each chunk that has them, and their counts come back to the chunk,
    so no task needs all pairs.
    """
    spark = aligned.sparkSession
    path = f"{checkpoint_folder(spark)}/aligned"
    aligned.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(aligned.schema).parquet(path)

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b_size = len(pieces(b_path).bytes)
        for batch in batches:
            for chunk, pairs, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = np.frombuffer(pairs, dtype=np.int64)
                columns = [np.full(len(codes), chunk), np.arange(len(codes), dtype=np.int32), codes, (codes % b_size).astype(np.int32), np.frombuffer(counts, dtype=np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["chunk", "place", "pair", "b", "n"])

    pairs = written.filter(F.col("links").isNull()).select("chunk", "pairs", "counts").mapInArrow(pairs_of, "chunk long, place int, pair long, b int, n long")
    totals = pairs.groupBy("pair", "b").agg(F.sum("n").alias("total"))
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))
    known = totals.join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    answers = pairs.join(known, "pair").select("chunk", "place", "total", "best")

    kept = [f for f in aligned.schema.fields if f.name not in ("chunk", "links", "pairs", "counts")]
    names = [f.name for f in kept]
    ddl = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "n_best long", "count_sum long"])

    def summed(docs: pa.Table, facts: pa.Table) -> pa.Table:
        place = facts.column("place").to_numpy()
        total, best = np.empty(len(place), dtype=np.int64), np.empty(len(place), dtype=np.int64)
        total[place], best[place] = facts.column("total").to_numpy(), facts.column("best").to_numpy(zero_copy_only=False)
        width = np.uint16 if len(place) <= 1 << 16 else np.uint32
        n_best, count_sum = [], []
        for links in docs.column("links").to_pylist():
            at = np.frombuffer(links, dtype=width)
            n_best.append(int(best[at].sum()))
            count_sum.append(int(total[at].sum()))
        return docs.select(names).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    texts = written.filter(F.col("links").isNotNull()).select("chunk", "links", *names)
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(summed, ddl)
