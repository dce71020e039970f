"""Language identification, words first.

A known word scores each language by the log frequency that it has there. An
unseen word backs off to its characters: at each place the longest known n-gram
scores, from NGRAM letters down to one. Counts come from a bounded sample of
labelled documents, and the model keeps a bounded number of words and n-grams,
so it can go to every task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import held_out
from framelake.llm.recompression import mix, read_words
from framelake.llm.sampling import labelled_texts

#: Training sample and model at most: documents, characters, words, n-grams of each length; letters in an n-gram.
FIT_ROWS, FIT_CHARS, WORDS, NGRAMS, NGRAM = 4_000, 12_000_000, 200_000, 100_000, 5
#: Words whose evidence counts in full when a probability is given, and bytes of text in a chunk.
_EVIDENCE, _CHUNK_BYTES = 20, 4 << 20
UNKNOWN = "und"
_EDGE = 0x20
#: Words are runs of a-z and of all characters beyond ASCII, in lower case.
_SEPARATORS = np.zeros(256, dtype=bool)
_SEPARATORS[:128] = True
_SEPARATORS[ord("a") : ord("z") + 1] = False
_M = np.uint64(0x9E3779B97F4A7C15)


def _lowered(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def _read(texts: list[bytes]):
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = b"".join(texts)
    return data, read_words(data, bounds, _SEPARATORS)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each after an edge mark, and the word of each place."""
    joined = "".join(f" {w}" for w in words)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    return points, np.cumsum(points == _EDGE) - 1


def _ngram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n letters from each place on; edge marks count as letters. None where there are fewer than n."""
    out = np.full(max(0, len(points) - n + 1), n, dtype=np.uint64)
    for i in range(n):
        out = mix(out * _M + points[i : i + len(out)])
    return out


class _Table:
    """Log frequencies of hashed items by language."""

    def __init__(self, items: np.ndarray, languages: np.ndarray, weights: np.ndarray, n_languages: int, most: int) -> None:
        keys, at = np.unique(items, return_inverse=True)
        counts = np.zeros((len(keys), n_languages))
        np.add.at(counts, (at, languages), weights)
        keep = np.sort(np.argsort(-counts.sum(axis=1), kind="stable")[:most])
        self.keys, counts = keys[keep], counts[keep]
        total = counts.sum(axis=0)
        self.logs = np.log((counts + 0.5) / (total + 0.5 * len(self.keys) + 1)).astype(np.float32)

    def find(self, items: np.ndarray) -> np.ndarray:
        """Row of each item, -1 where it is unknown."""
        if not len(self.keys):
            return np.full(len(items), -1)
        at = np.minimum(np.searchsorted(self.keys, items), len(self.keys) - 1)
        return np.where(self.keys[at] == items, at, -1)


class LanguageModel:
    """Fitted on texts and their languages; scores any text."""

    def __init__(self, texts: list[str], languages: list[str], words: int = WORDS, ngrams: int = NGRAMS, ngram: int = NGRAM) -> None:
        self.languages = sorted(set(languages))
        place = {x: i for i, x in enumerate(self.languages)}
        names, of, counts, spelled, spelled_of = [], [], [], [], []
        for language in self.languages:
            seen = Counter()
            for text, own in zip(texts, languages, strict=True):
                if own == language:
                    data, found = _read([_lowered(text)])
                    seen.update(data[a : a + n] for a, n in zip(found.start.tolist(), found.length.tolist(), strict=True))
            if not seen:
                continue
            spelling = [w.decode("utf-8", "replace") for w in seen]
            data, found = _read([b" ".join(seen)])
            names.append(found.name)
            of.append(np.full(len(seen), place[language]))
            counts.append(np.array(list(seen.values()), dtype=np.float64))
            spelled += spelling
            spelled_of += [place[language]] * len(seen)
        n = len(self.languages)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
        weights, languages_of = join(counts, np.float64), join(of, np.int64)
        # A word of one occurrence teaches its letters, and is left to them.
        often = weights > 1
        self.words = _Table(join(names, np.uint64)[often], languages_of[often], weights[often], n, words)
        self.ngrams = []
        points, word = _letters(spelled)
        for size in range(ngram, 0, -1):
            hashes = _ngram_hashes(points, size)
            at = np.nonzero(word[: len(hashes)] == word[size - 1 : size - 1 + len(hashes)])[0]
            self.ngrams.append((size, _Table(hashes[at], np.array(spelled_of, dtype=np.int64)[word[at]], np.log1p(weights)[word[at]], n, ngrams)))

    def _spelled_scores(self, words: list[str]) -> np.ndarray:
        """Mean log frequency over each word's places, by the longest n-gram known at each."""
        points, word = _letters(words)
        place_scores = np.zeros((len(points), len(self.languages)), dtype=np.float32)
        open_ = np.ones(len(points), dtype=bool)
        for size, table in self.ngrams:
            hashes = _ngram_hashes(points, size)
            at = np.nonzero(open_[: len(hashes)])[0]
            if size > 1:
                at = at[word[at] == word[at + size - 1]]
            row = table.find(hashes[at])
            place_scores[at[row >= 0]] = table.logs[row[row >= 0]]
            open_[at[row >= 0]] = False
        out = np.zeros((len(words), len(self.languages)))
        np.add.at(out, word, place_scores)
        return out / np.bincount(word, minlength=len(words))[:, None]

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(language, probability) of each text; ``und`` with 0 where there is no letter."""
        data, found = _read([_lowered(t) for t in texts])
        n = len(self.languages)
        named = np.full(len(texts), UNKNOWN, dtype=object)
        chance = np.zeros(len(texts))
        if not n:
            return named, chance
        row = self.words.find(found.name)
        unseen = np.nonzero(row < 0)[0]
        logs = self.words.logs
        if len(unseen):
            _, first, which = np.unique(found.name[unseen], return_index=True, return_inverse=True)
            first = unseen[first]
            spelled = [data[a : a + k].decode("utf-8", "replace") for a, k in zip(found.start[first].tolist(), found.length[first].tolist(), strict=True)]
            logs = np.concatenate([logs, self._spelled_scores(spelled).astype(np.float32)])
            row[unseen] = len(self.words.keys) + which
        count = np.diff(found.edge)
        full = np.nonzero(count)[0]
        if len(full):
            sums = np.add.reduceat(logs[row].astype(np.float64), found.edge[full], axis=0)
            mean = sums / count[full][:, None]
            weighted = mean * np.minimum(count[full], _EVIDENCE)[:, None]
            p = np.exp(weighted - weighted.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            named[full] = np.array(self.languages, dtype=object)[best]
            chance[full] = p[np.arange(len(full)), best]
            # Words of characters beyond ASCII alone may hold no letter.
            plain = np.zeros(len(texts), dtype=bool)
            plain[found.doc[np.isin(np.frombuffer(data, dtype=np.uint8)[found.start], _A_TO_Z)]] = True
            for i in full[~plain[full]]:
                if not any(c.isalpha() for c in texts[i]):
                    named[i], chance[i] = UNKNOWN, 0.0
        return named, chance


_A_TO_Z = np.arange(ord("a"), ord("z") + 1, dtype=np.uint8)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> LanguageModel:
    """A model of documents with a language that are not held out: about ``rows`` documents and ``chars`` of text at most.

    Every language is in the sample, half of which is shared evenly among them.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("label")).filter(
        F.col("label").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    )
    sample = labelled_texts(known, rows, chars)
    return LanguageModel(sample["text"].tolist(), sample["label"].tolist())


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    lang_pred is a language of the model, or ``und`` with score 0 where the text
    is null or has no letter (or the model has no language). score is the
    language's probability. Whole texts are read. An empty table gives no rows.
    Further columns of ``docs`` are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            parts, own, size = [], [], 0
            for text in batch:
                own.append(text)
                size += len(text or "")
                if size >= _CHUNK_BYTES:
                    parts.append(shared.value.score(own))
                    own, size = [], 0
            parts.append(shared.value.score(own))
            yield pd.DataFrame({"lang_pred": np.concatenate([p[0] for p in parts]), "score": np.concatenate([p[1] for p in parts])})

    scored = docs.select(F.col(id_col).alias("doc_id"), F.pandas_udf(run, "lang_pred string, score double")(F.col(text_col)).alias("s"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "s.lang_pred", "s.score")
