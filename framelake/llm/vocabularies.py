"""Published vocabularies, read from files whose paths are parameters: ids of a text, and the bytes that each id stands for."""

from __future__ import annotations

import functools
import json
from pathlib import Path

import sentencepiece
import tiktoken

#: Where this machine and every executor keep the published vocabularies.
FOLDER = "/opt/tokenizers"
BYTE_LEVEL = f"{FOLDER}/byte_bpe_50k.json"
PIECES = f"{FOLDER}/piece_bpe_32k.model"

#: Fixed value: how byte-level vocabularies cut a text into words before they merge bytes.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies spell printable bytes as themselves and the others, in order, from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE vocabulary file in JSON. Strings of special tokens inside texts are plain text.

    Merges must stand in the order of the ids they make, after 256 bytes, as they
    do in every vocabulary trained by merging; then ids are ranks.
    """

    def __init__(self, path: str) -> None:
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        byte, vocab = _byte_of_letter(), model["vocab"]
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if any(vocab[m] != 256 + i for i, m in enumerate(merges)):
            raise ValueError(f"{path}: merges are not in the order of their ids")
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items()}
        self.encoding = tiktoken.Encoding(path, pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)


class Pieces:
    """A sentencepiece model; it puts a space before the text itself."""

    def __init__(self, path: str) -> None:
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [self._bytes(i) for i in range(self.processor.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.processor.id_to_piece(i)
        if self.processor.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, text: str) -> list[int]:
        return self.processor.encode(text)


@functools.lru_cache(maxsize=4)
def byte_level(path: str = BYTE_LEVEL) -> ByteLevel:
    """The vocabulary, loaded once in each Python worker."""
    return ByteLevel(path)


@functools.lru_cache(maxsize=4)
def pieces(path: str = PIECES) -> Pieces:
    """The model, loaded once in each Python worker."""
    return Pieces(path)
