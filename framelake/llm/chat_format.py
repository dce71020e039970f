"""Chat formatting as token ids with a loss mask, and the way back.

A turn is START role newline text END newline. START and END are two ids after
the vocabulary's own, so no text can hold them; as text they are spelled
``<|im_start|>`` and ``<|im_end|>``, and a text that spells them, or anything
else between ``<|`` and ``|>``, gets a backslash in between.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.turns import PIECE_ROWS, conversation_pieces
from framelake.llm.vocabularies import BYTE_LEVEL, byte_level

START_TEXT, END_TEXT = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"

_OPENING = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_ROLE_OUT, _ROLE_IN = {"\\": "\\\\", "\n": "\\n"}, {"\\\\": "\\", "\\n": "\n"}


def escape(text: str) -> str:
    """``text`` without any ``<|``: one more backslash between ``<`` and ``|``, however many are there."""
    return _OPENING.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """Like ``escape``, and no line ends, as the first one ends the role."""
    return escape(re.sub(r"[\\\n]", lambda m: _ROLE_OUT[m.group()], role))


def unescape_role(role: str) -> str:
    return re.sub(r"\\[\\n]", lambda m: _ROLE_IN[m.group()], unescape(role))


class Template:
    """The ids of one vocabulary's turns."""

    def __init__(self, path: str) -> None:
        self.vocabulary = byte_level(path)
        n = len(self.vocabulary.bytes)
        # Ids after the vocabulary's own are free, but for the one that its special token has.
        self.start, self.end = n + 1, n + 2
        self.newline = self.vocabulary.encode("\n")
        self.bytes = [*self.vocabulary.bytes, b"", START_TEXT.encode(), END_TEXT.encode()]

    def assemble(self, turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of turns: segments encoded apart, the mask summed up from where learned segments begin and end."""
        segments, learned = [], []
        for role, text in turns:
            segments += [[self.start], self.vocabulary.encode(escape_role(role)), self.newline, self.vocabulary.encode(escape(text)), [self.end], self.newline]
            learned += [False, False, False, role == LEARNED, False, False]
        edge = np.concatenate([[0], np.cumsum([len(s) for s in segments])]).astype(np.int64)
        steps = np.zeros(edge[-1] + 1, dtype=np.int8)
        at = np.nonzero(learned)[0]
        np.add.at(steps, edge[at], 1)
        np.add.at(steps, edge[at + 1], -1)
        ids = np.array(list(chain.from_iterable(segments)), dtype=np.int32)
        return ids, np.cumsum(steps, dtype=np.int8)[:-1]

    def spell(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8")

    def read(self, ids: np.ndarray) -> list[tuple[str, str]]:
        """The (role, text) turns of ids."""
        out = []
        for a, b in zip(np.nonzero(ids == self.start)[0], np.nonzero(ids == self.end)[0], strict=True):
            role, _, text = self.spell(ids[a + 1 : b]).partition("\n")
            out.append((unescape_role(role), unescape(text)))
        return out

    def learned(self, ids: np.ndarray, mask: np.ndarray) -> list[str]:
        """The texts under the mask, one for each run of it."""
        steps = np.diff(np.concatenate([[0], mask, [0]]))
        return [unescape(self.spell(ids[a:b])) for a, b in zip(np.nonzero(steps == 1)[0], np.nonzero(steps == -1)[0], strict=True)]


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    """Each row's list, as a part of one array."""
    return np.split(column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))[:-1])


def _rows(batch: pa.RecordBatch, columns: dict[str, tuple[pa.DataType, list]]) -> pa.RecordBatch:
    kept = ("conv_id", "part", "piece", "whole")
    schema = pa.schema([*(batch.schema.field(c) for c in kept), *((n, t) for n, (t, _) in columns.items())])
    arrays = [*(batch.column(batch.schema.get_field_index(c)) for c in kept), *(pa.array(v, t) for t, v in columns.values())]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def format_conversations(rows: DataFrame, vocabulary: str = BYTE_LEVEL, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Token ids and loss mask: conv_id, part, piece, whole, n_turns, token_ids, loss_mask.

    ``rows`` has conv_id, turn, role and text; further columns are not read. Null role
    and text are empty. Turns are taken by turn (null first), those of one turn by
    role and text. The mask is 1 on the ids of assistants' texts and nothing else.
    Long conversations are in several pieces, ordered by (part, piece): their
    arrays one after another are the conversation's. ``vocabulary`` is a byte-level
    BPE file that every executor can read. An empty table gives no rows.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    pieces = conversation_pieces(rows.select("conv_id", "turn", empty("role"), empty("text")), piece_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(vocabulary)
        for batch in batches:
            turns = [[(r["role"], r["text"]) for r in rows] for rows in batch.column("rows").to_pylist()]
            made = [template.assemble(t) for t in turns]
            yield _rows(
                batch,
                {
                    "n_turns": (pa.int64(), [len(t) for t in turns]),
                    "token_ids": (pa.list_(pa.int32()), [ids for ids, _ in made]),
                    "loss_mask": (pa.list_(pa.int8()), [mask for _, mask in made]),
                },
            )

    conv = pieces.schema["conv_id"].dataType.simpleString()
    return pieces.mapInArrow(run, f"conv_id {conv}, part int, piece long, whole boolean, n_turns long, token_ids array<int>, loss_mask array<byte>")


def read_back(formatted: DataFrame, vocabulary: str = BYTE_LEVEL) -> DataFrame:
    """What ``format_conversations``' ids and mask say: one row per conversation, from nothing but these two.

    conv_id, n_turns, turns_text (role, newline, text, newline for each turn),
    loss_text (all text under the mask, unescaped) and formatted_chars (code
    points of the ids, spelled). A conversation in several pieces meets in one row here, as its texts are one string each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(vocabulary)
        for batch in batches:
            ids, masks = (_arrays(batch.column(batch.schema.get_field_index(c))) for c in ("token_ids", "loss_mask"))
            turns = [template.read(x) for x in ids]
            yield _rows(
                batch,
                {
                    "n_turns": (pa.int64(), [len(t) for t in turns]),
                    "turns_text": (pa.string(), ["".join(f"{r}\n{x}\n" for r, x in t) for t in turns]),
                    "loss_text": (pa.string(), ["".join(template.learned(x, m)) for x, m in zip(ids, masks, strict=True)]),
                    "formatted_chars": (pa.int64(), [len(template.spell(x)) for x in ids]),
                },
            )

    conv = formatted.schema["conv_id"].dataType.simpleString()
    out = "n_turns long, turns_text string, loss_text string, formatted_chars long"
    told = formatted.mapInArrow(run, f"conv_id {conv}, part int, piece long, whole boolean, {out}")
    columns = ("conv_id", "n_turns", "turns_text", "loss_text", "formatted_chars")
    inner = F.sort_array(F.collect_list(F.struct("part", "piece", "turns_text", "loss_text")))
    whole = F.when(F.col("whole"), F.struct("part", "piece"))
    # One more key, null but for whole conversations: those are groups of their own and never meet others of the same id.
    met = told.groupBy("conv_id", whole.alias("_own")).agg(F.sum("n_turns").alias("n_turns"), inner.alias("_p"), F.sum("formatted_chars").alias("formatted_chars"))
    text = lambda name: F.array_join(F.transform("_p", lambda p: p[name]), "").alias(name)
    return met.select("conv_id", "n_turns", text("turns_text"), text("loss_text"), "formatted_chars").select(*columns)
