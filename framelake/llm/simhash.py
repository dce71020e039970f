"""Near-duplicate documents by SimHash, with pigeonring filtering.

A fingerprint's 64 bits form a ring of five segments. If two fingerprints differ
in d <= 3 bits, some segment starts a chain in which the first l segments hold
at most l * 3 / 5 of the differing bits, for every l from 1 to 5. So the first
segment of that chain is equal, and so is the second or the third, as the first
three hold at most one differing bit. Distinct fingerprints therefore meet under
ten keys, each a starting segment and one of its next two; where they meet, the
chain is checked length by length, which prunes pairs before the full Hamming
distance (the chain of all five). A key gives a spanning forest of its links,
not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import join_group_facts, materialise
from framelake.llm.components import connected_components

SHINGLE_WORDS, HASH_SEED, MAX_DISTANCE = 3, 42, 3
_WIDTHS = (13, 13, 13, 13, 12)
_SEGMENTS = [((1 << w) - 1) << sum(_WIDTHS[:i]) for i, w in enumerate(_WIDTHS)]
_RING = len(_WIDTHS)
#: (start, other segment that is equal too) of each key.
KEYS = [(i, (i + step) % _RING) for step in (1, 2) for i in range(_RING)]
#: Shingles whose bits are counted together, and members of a key that are compared at once.
_BLOCK_SHINGLES, _BLOCK_ROWS, _SPLIT_ROWS = 1 << 18, 512, 4096
#: Members of a key up to which its few pairs are all compared at once.
_SMALL = 8
_LANES = np.uint64(0x0101010101010101)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def shingle_hashes(text: bytes, size: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of each word shingle of a text, A-Z lower-cased, repeats included."""
    words = text.lower().split()  # bytes: ASCII white space and letters only
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), HASH_SEED)] if words else []
    joined = b" ".join(words)
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)]).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], HASH_SEED) for a, b in zip(starts, islice(starts, size, None), strict=False)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of ``counts`` hashes: the bits set in over half of them; 0 for an empty run."""
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.nonzero(counts)[0]
    if not len(full):
        return out
    n = counts[full]
    ends = np.cumsum(n)
    # Runs in chunks of 255 at most, so that eight counters fit in a word.
    per = -(-n // 255)
    first = np.concatenate([[0], np.cumsum(per)[:-1]])
    chunk = np.repeat(ends - n, per) + (np.arange(per.sum()) - np.repeat(first, per)) * 255
    bits = np.zeros(len(full), dtype=np.uint64)
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _LANES, chunk)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            bits |= (sums[:, byte] * 2 > n).astype(np.uint64) << np.uint64(8 * byte + shift)
    out[full] = bits
    return out


def _fingerprints(size: int):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            parts, hashes, counts = [], [], []
            for text in batch:
                found = shingle_hashes(text, size) if text is not None else []
                hashes += found
                counts.append(len(found))
                if len(hashes) >= _BLOCK_SHINGLES:
                    parts.append(majority_bits(np.array(hashes, dtype=np.uint64), np.array(counts)))
                    hashes, counts = [], []
            parts.append(majority_bits(np.array(hashes, dtype=np.uint64), np.array(counts, dtype=np.int64)))
            yield pd.Series(np.concatenate(parts).view(np.int64))

    return F.pandas_udf(run, "long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (64 bits as a long) of each row; null and word-less texts have 0."""
    return docs.select(F.col(id_col).alias("doc_id"), _fingerprints(size)(F.col(text_col).cast("binary")).alias("fp"))


def _chain(diff: np.ndarray, start: int, distance: int) -> np.ndarray:
    """Whether every prefix of the chain from ``start`` keeps to its share of ``distance``."""
    ok, mask = np.ones(len(diff), dtype=bool), 0
    for length in range(1, _RING + 1):
        mask |= _SEGMENTS[(start + length - 1) % _RING]
        live = np.nonzero(ok)[0]
        ok[live] = np.bitwise_count(diff[live] & np.uint64(mask)) <= length * distance // _RING
    return ok


def _forest(values: np.ndarray, start: int, distance: int, free: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links among distinct fingerprints that agree in the key's segments, enough to connect all that are linked."""
    if len(values) > _SPLIT_ROWS and free:
        # With up to 3 differing bits in four parts of the free bits, one part is equal.
        out = []
        for part in free:
            key = values & np.uint64(part)
            order = np.argsort(key, kind="stable")
            cuts = np.nonzero(np.diff(key[order]))[0] + 1
            for group in np.split(values[order], cuts):
                if len(group) > 1:
                    out += _forest(group, start, distance, [])
        return out
    out, rest = [], values
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            block, front = front[:_BLOCK_ROWS], front[_BLOCK_ROWS:]
            found = np.zeros(len(rest), dtype=bool)
            parent = np.zeros(len(rest), dtype=np.uint64)
            for value in block:
                new = _chain(rest ^ value, start, distance) & ~found
                parent[new] = value
                found |= new
            out.append((parent[found], rest[found]))
            front, rest = np.concatenate([front, rest[found]]), rest[~found]
    return out


def _links(distance: int):
    def complete(keys: np.ndarray, starts: np.ndarray, values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Links of whole keys; rows are sorted by key."""
        out = []
        cuts = np.concatenate([[0], np.nonzero((np.diff(keys) != 0) | (np.diff(starts) != 0))[0] + 1, [len(keys)]])
        sizes = np.diff(cuts)
        for first, n in zip(cuts[:-1][sizes > _SMALL], sizes[sizes > _SMALL], strict=True):
            start, _ = KEYS[starts[first] % len(KEYS)]
            bits = _free_bits(starts[first] % len(KEYS))
            # Keys from len(KEYS) on have a fourth of the free bits in common already.
            out += _forest(values[first : first + n], start, distance, [sum(bits[i::4]) for i in range(4)] if starts[first] < len(KEYS) else [])
        group = np.repeat(np.arange(len(sizes)), sizes)
        small = sizes[group] <= _SMALL
        group, value, table = group[small], values[small], starts[small]
        for step in range(1, int(sizes[sizes <= _SMALL].max(initial=1))):
            near = np.nonzero(group[step:] == group[:-step])[0]
            if not len(near):
                break
            a, b, t = value[near], value[near + step], table[near]
            for k, (start, _) in enumerate(KEYS):
                at = np.nonzero(t % len(KEYS) == k)[0]
                ok = at[_chain(a[at] ^ b[at], start, distance)]
                out.append((a[ok], b[ok]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] = ()
        for batch in batches:
            rows = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True)) if held else rows
            table, key, fp = rows
            last = np.nonzero((table != table[-1]) | (key != key[-1]))[0] if len(table) else []
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield from emit(complete(key[:cut], table[:cut], fp[:cut].view(np.uint64)))
            held = tuple(x[cut:] for x in rows)
        if held and len(held[0]):
            yield from emit(complete(held[1], held[0], held[2].view(np.uint64)))

    def emit(links: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if links:
            a, b = (np.concatenate([x[i] for x in links]).view(np.int64) for i in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _free_bits(t: int) -> list[int]:
    """The bits that key ``t`` leaves open."""
    taken = _SEGMENTS[KEYS[t][0]] | _SEGMENTS[KEYS[t][1]]
    return [1 << i for i in range(64) if not taken >> i & 1]


def fingerprint_links(distinct: DataFrame, distance: int = MAX_DISTANCE, crowded: int = _SPLIT_ROWS) -> DataFrame:
    """a, b: links among the distinct values of column fp that connect all within ``distance`` (3 at most) bits; keys of more than ``crowded`` members are split before they meet."""
    if not 0 <= distance <= MAX_DISTANCE:
        raise ValueError(f"the ring's keys find up to {MAX_DISTANCE} differing bits")
    keys = F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(_SEGMENTS[a] | _SEGMENTS[b]))).alias("key")) for t, (a, b) in enumerate(KEYS)
    ])
    placed = distinct.select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp")
    hot = materialise(placed.groupBy("t", "key").agg(F.count("*").alias("members")).filter(F.col("members") > crowded))
    if hot.limit(1).count():
        # Two that differ in 3 bits at most agree in one of four parts of the free bits: crowded keys are split by each.
        parts = F.array(*[F.array(*[F.lit(_signed(sum(b[i::4]))) for i in range(4)]) for b in map(_free_bits, range(len(KEYS)))])
        joined = join_group_facts(placed.withColumn("at", F.struct("t", "key")), hot.select(F.struct("t", "key").alias("at"), "members"), "at", "members", distinct.count() * len(KEYS))
        split = joined.filter("members IS NOT NULL").select("t", "key", "fp", F.posexplode(parts[F.col("t")]).alias("i", "part"))
        split = split.select((F.col("t") + len(KEYS) * (F.col("i") + 1)).alias("t"), F.col("fp").bitwiseAND(F.col("part")).bitwiseOR(F.col("key")).alias("key"), "fp")
        placed = joined.filter("members IS NULL").select("t", "key", "fp").unionByName(split)
    met = placed.repartition("t", "key").sortWithinPartitions("t", "key")
    return met.mapInArrow(_links(distance), "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id.

    Fingerprints within ``distance`` differing bits link; component_id is the
    smallest non-null doc_id reachable over links, itself included (null if there
    is none). A text of fewer than ``size`` words is one shingle; null, empty and
    word-less texts have fingerprint 0 and link like any other. Equal fingerprints
    always share a component. An empty table gives no rows. Further columns of
    ``docs`` are not read.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, size))
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")))
    roots = materialise(connected_components(fingerprint_links(distinct.select("fp"), distance)))
    linked = roots.join(distinct, roots.node == distinct.fp).select("node", "root", "least")
    groups = linked.groupBy("root").agg(F.min("least").alias("component"))
    found = linked.join(groups, "root").select(F.col("node").alias("fp"), "component")
    facts = distinct.join(found, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"), "size")
    return join_group_facts(rows, materialise(facts), "fp", "size", rows.count()).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is their component's smallest, with all their columns.

    Rows that share an id stay or go together, and rows without an id all stay:
    nothing names them.
    """
    gone = near_duplicates(docs, id_col, text_col, **options).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.alias("_d").join(gone.alias("_g"), F.col(f"_d.`{id_col}`") == F.col("_g._gone"), "left_anti")
