"""Removal of word windows that an earlier document holds, by recompression.

Every window of ``width`` words has the key of its interior symbols (see
recompression.py), and equal windows share it; neighbouring windows mostly share
a key too, so a document has far fewer keys than windows. Five steps, each a map
over one Spark exchange:

1. keys: a task names the words of its documents in rounds and lists each
   document's keys. A key that several of the task's documents hold is known to
   be shared; one row for it goes on.
2. shared keys: keys meet by hash, and those of two documents or more go back to
   their documents.
3. windows: documents list the windows whose keys are shared, again one row for
   each window and task.
4. verified repeats: windows meet by the first of two independent 64-bit hashes
   and are equal only where the second agrees; those of a smaller document go back.
5. cut: documents drop the words that those windows cover.

Documents travel to steps 3 and 5 by hash of doc_id in compressed blocks, in the
rows of the exchange that also carries what steps 2 and 4 found, sorted ahead of
the texts. A task holds the findings for its share of documents and one block of
texts; a key or window held by any number of documents is one row per task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import shuffle_partitions
from framelake.llm.recompression import Words, mix, read_words, sequence_hash, sequence_hashes, window_keys

WIDTH = 13
#: Rows of the exchanges: found keys or windows for a document, rows to be met by hash, texts.
_FOUND, _MEET, _TEXT = 0, 1, 2
_ROW = "target int, kind int, n long, docs binary, items binary"
#: Bytes of text in a chunk, and keys or windows kept before they are sent on.
_CHUNK_BYTES, _KEEP = 3 << 20, 1_500_000
#: Bytes of a window's two hashes. Keys only choose candidates and travel in as many bytes as the input's size asks for.
_WINDOW_BYTES = 16
#: Bytes of text for a task of the exchanges, and for a target in a chunk that is sent.
_TASK_BYTES, _BLOCK_BYTES, _MOST_CHUNK = 256 << 20, 96 << 10, 48 << 20


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each row of numbers, lowest bytes first, then the next ones: a form that compresses."""
    return np.ascontiguousarray(np.ascontiguousarray(x, dtype="<u8").view(np.uint8).reshape(len(x), -1).T[:width]).tobytes()


def _unplanes(data: bytes, n: int, width: int) -> np.ndarray:
    """Rows of as many numbers as ``width`` bytes need."""
    out = np.zeros((n, 8 * -(-width // 8)), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(width, n).T
    return out.view("<u8")


def _new_rows(x: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before."""
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[1:] != x[:-1]).any(axis=1)
    return new


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    target, kind, n, docs, items = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(target, pa.int32()), pa.array(kind, pa.int32()), pa.array(n, pa.int64()), pa.array(docs, pa.binary()), pa.array(items, pa.binary())],
        names=["target", "kind", "n", "docs", "items"],
    )


def _dealt(kind: int, target: np.ndarray, docs: np.ndarray, items: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """A row for each target, its documents ascending."""
    order = np.lexsort((docs, target))
    target, docs, items = target[order], docs[order], items[order]
    cuts = np.concatenate([[0], np.nonzero(np.diff(target))[0] + 1, [len(target)]])
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            steps = np.diff(docs[a:b], prepend=np.int64(0))
            rows.append((int(target[a]), kind, int(b - a), _planes(steps.view(np.uint64), 8), _planes(items[a:b], width)))
    if rows:
        yield _rows(rows)


def _pairs(n: int, docs: bytes, items: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_unplanes(docs, n, 8)[:, 0].view(np.int64)), _unplanes(items, n, width)


def _shard(docs: np.ndarray, parts: int) -> np.ndarray:
    return (mix(docs.astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _meeting(items: np.ndarray, parts: int) -> np.ndarray:
    return (mix(items[:, 0] ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(parts)).astype(np.int64)


class _Collected:
    """(document, item) pairs of a task, sent on when there are enough.

    ``earlier`` False: an item of several documents is found for all of them.
    True: it is found for all but the smallest. Either way its smallest document
    goes on to meet other tasks' pairs.
    """

    def __init__(self, parts: int, width: int, earlier: bool) -> None:
        self.parts, self.width, self.earlier = parts, width, earlier
        self.docs: list[np.ndarray] = []
        self.items: list[np.ndarray] = []
        self.n = 0

    def add(self, docs: np.ndarray, items: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.docs.append(docs)
        self.items.append(items)
        self.n += len(docs)
        if self.n >= _KEEP:
            yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            docs, items, first, found = _grouped(np.concatenate(self.docs), np.concatenate(self.items), self.earlier)
            self.docs, self.items, self.n = [], [], 0
            yield from _dealt(_FOUND, _shard(docs[found], self.parts), docs[found], items[found], self.width)
            yield from _dealt(_MEET, _meeting(items[first], self.parts), docs[first], items[first], self.width)


def _grouped(docs: np.ndarray, items: np.ndarray, earlier: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs by item, then document; which have the item's smallest document; which are found."""
    order = np.lexsort((docs, *items.T[::-1]))
    docs, items = docs[order], items[order]
    new_item = _new_rows(items)
    new = new_item.copy()
    new[1:] |= docs[1:] != docs[:-1]
    docs, items, first = docs[new], items[new], new_item[new]
    if earlier:
        return docs, items, first, ~first
    several = ~first
    several[:-1] |= ~first[1:]
    return docs, items, first, several


#: Odd multipliers that join a document to the first and second hash of an item.
_JOINERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


class _Found:
    """Found (document, item) pairs of a task's share of documents."""

    def __init__(self, width: int) -> None:
        self.width, self.parts = width, []
        self.docs: np.ndarray | None = None

    def add(self, n: int, docs: bytes, items: bytes) -> None:
        d, x = _pairs(n, docs, items, self.width)
        self.parts.append((np.unique(d), self._joined(d, x)))

    @staticmethod
    def _joined(docs: np.ndarray, items: np.ndarray) -> np.ndarray:
        """A hash of document and item for each hash of the item."""
        doc = docs.view(np.uint64)
        return np.stack([mix(doc * m + mix(items[:, i])) for i, m in zip(range(items.shape[1]), _JOINERS, strict=False)], axis=1)

    def _close(self) -> None:
        self.docs = np.unique(np.concatenate([p[0] for p in self.parts]))
        pairs = np.concatenate([p[1] for p in self.parts])
        self.parts = []
        pairs = pairs[np.lexsort(pairs.T[::-1])]
        pairs = pairs[_new_rows(pairs)]
        self.first, self.second = np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, -1])

    def has(self, docs: np.ndarray, items: np.ndarray) -> np.ndarray:
        out = np.zeros(len(docs), dtype=bool)
        if self.docs is None:
            if not self.parts:
                return out
            self._close()
        at = np.minimum(np.searchsorted(self.docs, docs), len(self.docs) - 1)
        maybe = np.nonzero(self.docs[at] == docs)[0]
        want = self._joined(docs[maybe], items[maybe])
        at = np.searchsorted(self.first, want[:, 0])
        # Pairs that share the first hash lie side by side; the second tells them apart.
        while len(maybe):
            inside = at < len(self.first)
            maybe, want, at = maybe[inside], want[inside], at[inside]
            same = self.first[at] == want[:, 0]
            hit = same & (self.second[at] == want[:, -1])
            out[maybe[hit]] = True
            more = same & ~hit
            maybe, want, at = maybe[more], want[more], at[more] + 1
        return out


def _chunks(batches: Iterator[pa.RecordBatch], most: int = _CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(doc_id, has an id, texts) for about ``most`` bytes each; a null text is empty."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or b""
            ids.append(doc)
            texts.append(text)
            size += len(text)
            if size >= most:
                yield _ids(ids), np.array([i is not None for i in ids]), texts
                ids, texts, size = [], [], 0
    if ids:
        yield _ids(ids), np.array([i is not None for i in ids]), texts


def _ids(ids: list) -> np.ndarray:
    return np.array([0 if i is None else i for i in ids], dtype=np.int64)


def _words(texts: list[bytes]):
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    words = read_words(b"".join(texts), bounds)
    return words, sequence_hashes(words)


def _keys_of(ids: np.ndarray, named: np.ndarray, words: Words, prefix: np.ndarray, width: int, key_bytes: int):
    """(document, first word, key) of all windows of documents with ids, and which start a run of equal ones."""
    at, key = window_keys(words, prefix, width)
    doc = words.doc[at]
    keep = named[doc]
    docs, keys = ids[doc[keep]], mix(key[keep]) & np.uint64((1 << 8 * key_bytes) - 1)
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    return docs, at[keep], keys, new


def _windows(words: Words, prefix: np.ndarray, at: np.ndarray, width: int, first_bits: int) -> np.ndarray:
    """The two hashes of the windows that start at ``at``."""
    first = sequence_hash(prefix, at, at + width) & np.uint64((1 << first_bits) - 1)
    return np.stack([first, sequence_hash(sequence_hashes(words, 1), at, at + width, 1)], axis=1)


def _list_keys(width: int, parts: int, key_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Collected(parts, key_bytes, earlier=False)
        for ids, named, texts in _chunks(batches):
            docs, _, keys, new = _keys_of(ids, named, *_words(texts), width, key_bytes)
            yield from kept.add(docs[new], keys[new, None])
        yield from kept.send()

    return run


def _meet(item_bytes: int, parts: int, earlier: bool):
    """Steps 2 and 4: what was found passes, the rest meets by item and goes back to its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, items = [], []
        for batch in batches:
            own = np.array(batch.column(1)) == _MEET
            if not own.all():
                yield batch.filter(pa.array(~own))
            for row in batch.filter(pa.array(own)).to_pylist():
                d, x = _pairs(row["n"], row["docs"], row["items"], item_bytes)
                docs.append(d)
                items.append(x)
        if docs:
            d, x, _, found = _grouped(np.concatenate(docs), np.concatenate(items), earlier)
            yield from _dealt(_FOUND, _shard(d[found], parts), d[found], x[found], item_bytes)

    return run


def _send_texts(parts: int):
    """Rows of compressed texts by shard of their document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for ids, named, texts in _chunks(batches, max(_CHUNK_BYTES, min(_MOST_CHUNK, parts * _BLOCK_BYTES))):
            shard = _shard(ids, parts)
            shard[~named] = np.nonzero(~named)[0] % parts
            order = np.argsort(shard, kind="stable")
            cuts = np.concatenate([[0], np.nonzero(np.diff(shard[order]))[0] + 1, [len(order)]])
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = order[a:b]
                head = np.stack([ids[own], named[own].astype(np.int64), np.array([len(texts[i]) for i in own], dtype=np.int64)])
                rows.append((int(shard[own[0]]), _TEXT, len(own), head.tobytes(), pack.compress(b"".join(texts[i] for i in own))))
            yield _rows(rows)

    return run


def _shares(batches: Iterator[pa.RecordBatch], item_bytes: int) -> Iterator[tuple[_Found, np.ndarray, np.ndarray, list[bytes]]]:
    """For each block of texts: all that was found for the task's documents, ids, which have one, texts."""
    found, unpack = _Found(item_bytes), zstandard.ZstdDecompressor()
    for batch in batches:
        for kind, n, docs, items in zip(*(batch.column(i) for i in (1, 2, 3, 4)), strict=True):
            kind, n, docs, items = kind.as_py(), n.as_py(), docs.as_py(), items.as_py()
            if kind == _FOUND:
                found.add(n, docs, items)
                continue
            ids, named, sizes = np.frombuffer(docs, dtype=np.int64).reshape(3, n)
            data = unpack.decompress(items) if sizes.sum() else b""
            ends = np.cumsum(sizes).tolist()
            yield found, ids, named.astype(bool), [data[e - s : e] for e, s in zip(ends, sizes.tolist(), strict=True)]


def _list_windows(width: int, parts: int, key_bytes: int, first_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Collected(parts, _WINDOW_BYTES, earlier=True)
        for found, ids, named, texts in _shares(batches, key_bytes):
            words, prefix = _words(texts)
            docs, at, keys, new = _keys_of(ids, named, words, prefix, width, key_bytes)
            shared = found.has(docs[new], keys[new, None])[np.cumsum(new) - 1]
            yield from kept.add(docs[shared], _windows(words, prefix, at[shared], width, first_bits))
        yield from kept.send()

    return run


def _cut(width: int, first_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, ids, named, texts in _shares(batches, _WINDOW_BYTES):
            words, prefix = _words(texts)
            n = len(words.name)
            doc = words.doc
            at = np.nonzero((np.arange(n) + width <= words.edge[1:][doc]) & named[doc])[0] if n else np.zeros(0, dtype=np.int64)
            gone = at[found.has(ids[doc[at]], _windows(words, prefix, at, width, first_bits))]
            step = np.zeros(n + 1, dtype=np.int64)
            np.add.at(step, gone, 1)
            np.add.at(step, gone + width, -1)
            covered = np.cumsum(step)[:n] > 0
            before = np.concatenate([[0], np.cumsum(covered)])
            removed = before[words.edge[1:]] - before[words.edge[:-1]]
            kept = []
            for i, text in enumerate(texts):
                own = text.split()  # bytes: ASCII white space only
                if removed[i]:
                    own = [w for w, c in zip(own, covered[words.edge[i] : words.edge[i + 1]].tolist(), strict=True) if not c]
                kept.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=~named), pa.array(np.diff(words.edge)), pa.array(removed), pa.array(kept, pa.binary())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return run


def drop_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, key_bytes: int | None = None, first_bits: int = 64
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept.

    kept is the text's words, joined by one space, without those that are covered
    by a window of ``width`` words which also starts in a document with a smaller
    doc_id. Windows are judged on the texts as they come. Rows that share an id
    don't cut each other; rows without an id are neither cut nor cut others. A
    null text has no words; a text of fewer than ``width`` words stays whole. An
    empty table gives no rows. Further columns of ``docs`` are not read.

    Windows are equal when two 64-bit hashes of their words' 64-bit names agree:
    among 10^13 windows two unlike ones do so with a probability of about 10^-12.
    ``key_bytes`` (8 at most) and ``first_bits`` of the first hash change which
    rows meet, never the result. Keys have as many bytes as leave about one in
    256 shared by chance, and the exchanges a task for each 256 MB of text, or as
    many as the session sets if more; one sum over the texts' lengths tells.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    key_bytes = key_bytes or min(8, math.ceil(math.log2(size) / 8) + 1)
    parts = max(shuffle_partitions(docs.sparkSession), math.ceil(size / _TASK_BYTES))
    texts = source.mapInArrow(_send_texts(parts), _ROW)

    def met(rows: DataFrame, step: Callable) -> DataFrame:
        return rows.repartition(parts, "target").mapInArrow(step, _ROW)

    def shares(found: DataFrame) -> DataFrame:
        return found.unionByName(texts).repartition(parts, "target").sortWithinPartitions("kind")

    shared = met(source.mapInArrow(_list_keys(width, parts, key_bytes), _ROW), _meet(key_bytes, parts, earlier=False))
    windows = shares(shared).mapInArrow(_list_windows(width, parts, key_bytes, first_bits), _ROW)
    repeats = met(windows, _meet(_WINDOW_BYTES, parts, earlier=True))
    out = shares(repeats).mapInArrow(_cut(width, first_bits), "doc_id long, n_words long, n_removed long, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))
