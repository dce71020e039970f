"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Every word form has a sparse random index vector, drawn from a hash. A frequent
word's vector is its index vector plus its context: the sum of its neighbours'
index vectors over the training sample, scaled to length one. A rare or unseen
word has its form's vector alone; its form is the kinds of characters in it and
its length. A document pools its words' vectors to their mean and root mean square, and
how much its words agree with their neighbours and repeat. A network of two
layers, trained in numpy, turns that into a score, and a temperature fitted on
documents left out of training makes it a probability.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import held_out
from framelake.llm.recompression import Words, mix, read_words
from framelake.llm.sampling import bounded_rows

#: Training sample and model at most: documents, characters, words with a context.
FIT_ROWS, FIT_CHARS, WORDS = 6_000, 24_000_000, 30_000
#: Length of a vector, non-zero entries of an index vector, neighbours on each side, hidden units.
DIM, NONZERO, NEIGHBOURS, HIDDEN = 32, 4, 2, 32
#: A score of this much predicts label 1.
THRESHOLD = 0.3
_CHUNK_BYTES = 512 << 10
_SPREAD = 0x9E3779B97F4A7C15

#: Kinds of bytes in a word's form, one bit each.
_KINDS = np.zeros(256, dtype=np.uint16)
for _bit, _bytes in enumerate((
    range(ord("a"), ord("z") + 1), range(ord("A"), ord("Z") + 1), range(ord("0"), ord("9") + 1), range(0x80, 0x100),
    b".,;:'\"-()", b"!?", b"|", b"#$%&*@^~+=<>", b"/\\_[]{}`",
)):
    _KINDS[list(_bytes)] |= 1 << _bit


def index_vectors(names: np.ndarray) -> np.ndarray:
    """Sparse random vectors of length one, a function of the names alone."""
    out = np.zeros((len(names), DIM), dtype=np.float32)
    for k in range(NONZERO):
        h = mix(names + np.uint64((k + 1) * _SPREAD & 0xFFFFFFFFFFFFFFFF))
        np.add.at(out, (np.arange(len(names)), (h % np.uint64(DIM)).astype(np.int64)), np.where(h >> np.uint64(63), 1, -1).astype(np.float32))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


#: A form is 9 kinds, whether the first letter is upper case, and which of these lengths the word exceeds.
_LENGTHS = np.array([1, 2, 4, 8, 16, 32])
_FORM_VECTORS = index_vectors(mix(np.arange(1 << 13, dtype=np.uint64)))


def _read(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    """Words of the texts and each word's form."""
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = b"".join(texts)
    words = read_words(data, bounds)
    if not len(words.name):
        return words, np.zeros(0, dtype=np.uint16)
    kinds = _KINDS[np.frombuffer(data, dtype=np.uint8)]
    # Between two words lie separators only, and those have no kind.
    form = np.bitwise_or.reduceat(kinds, words.start)
    first_upper = kinds[words.start] >> 1 & 1
    length = np.searchsorted(_LENGTHS, np.minimum(words.length, 64)).astype(np.uint16)
    return words, (form << 4) | (first_upper << 3) | length


def _sums(values: np.ndarray, edge: np.ndarray) -> np.ndarray:
    out = np.zeros((len(edge) - 1, *values.shape[1:]))
    full = np.nonzero(np.diff(edge))[0]
    if len(full):
        out[full] = np.add.reduceat(values, edge[full], axis=0)
    return out


class QualityModel:
    """Fitted on texts and their labels 0 and 1; scores any text."""

    def __init__(self, texts: list[str], labels: list[int], words: int = WORDS, epochs: int = 200, seed: int = 7) -> None:
        self.names, self.contexts = np.zeros(0, dtype=np.uint64), np.zeros((1, DIM), dtype=np.float32)
        self.net: tuple[np.ndarray, ...] | None = None
        self.prior = float(np.mean(labels)) if len(labels) else 0.5
        self.temperature = 1.0
        if len(set(labels)) < 2:
            return
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self._learn_contexts(data, words)
        self._train(self.features(data), np.array(labels, dtype=np.float64), epochs, np.random.default_rng(seed))

    def _learn_contexts(self, data: list[bytes], most: int) -> None:
        chunks = list(_chunked(data))
        counts: dict[int, int] = {}
        for chunk in chunks:
            name, n = np.unique(_read(chunk)[0].name, return_counts=True)
            for w, c in zip(name.tolist(), n.tolist(), strict=True):
                counts[w] = counts.get(w, 0) + c
        chosen = sorted(counts, key=lambda w: (-counts[w], w))[:most]
        self.names = np.sort(np.array([w for w in chosen if counts[w] > 1], dtype=np.uint64))
        contexts = np.zeros((len(self.names) + 1, DIM), dtype=np.float64)
        for chunk in chunks:
            words, form = _read(chunk)
            row, doc = self._rows(words.name), words.doc
            # A word's index vector is its form's and, for a kept word, its own.
            own = (index_vectors(np.append(self.names, np.uint64(0))) * np.append(np.ones(len(self.names)), 0)[:, None]).astype(np.float32)
            index = _FORM_VECTORS[form] + own[row]
            for step in range(1, NEIGHBOURS + 1):
                near = np.nonzero(doc[step:] == doc[:-step])[0]
                for a, b in ((near, near + step), (near + step, near)):
                    for d in range(DIM):
                        contexts[:, d] += np.bincount(row[a], weights=index[b, d], minlength=len(contexts))
        contexts[-1] = 0
        self.contexts = (contexts / np.maximum(np.linalg.norm(contexts, axis=1, keepdims=True), 1e-6)).astype(np.float32)
        self.contexts[:-1] += index_vectors(self.names)

    def _rows(self, names: np.ndarray) -> np.ndarray:
        """Row of each word's vector; unseen words have the last, which is zero."""
        if not len(self.names):
            return np.zeros(len(names), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[at] == names, at, len(self.names))

    def features(self, data: list[bytes]) -> np.ndarray:
        return np.concatenate([self._features(chunk) for chunk in _chunked(data)]) if data else np.zeros((0, 2 * DIM + 4))

    def _features(self, data: list[bytes]) -> np.ndarray:
        words, form = _read(data)
        n = np.diff(words.edge)
        vector = _FORM_VECTORS[form] + self.contexts[self._rows(words.name)]
        several = np.maximum(n, 1)[:, None]
        total, squares = _sums(vector, words.edge), _sums(vector * vector, words.edge)
        mean = total / several
        spread = np.sqrt(squares / several)
        # Mean product of two different words of the document, drawn to 0 for few words.
        alike = ((total * total).sum(axis=1) - squares.sum(axis=1)) / (n * (n - 1) + 10)
        doc = words.doc
        same = np.zeros((len(words.name), 1))
        if len(words.name) > 1:
            same[1:, 0] = (words.name[1:] == words.name[:-1]) & (doc[1:] == doc[:-1])
        # Forty bits tell a document's words apart.
        pairs = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (words.name >> np.uint64(24)))
        new = np.ones(len(pairs), dtype=bool)
        new[1:] = pairs[1:] != pairs[:-1]
        distinct = np.bincount(doc[new], minlength=len(n))
        pooled = np.stack([np.log1p(n), (n - distinct) / (n + 8), _sums(same, words.edge)[:, 0] / (n + 4), alike], axis=1)
        return np.concatenate([mean, spread, pooled], axis=1)

    def _train(self, x: np.ndarray, y: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.centre) / self.scale
        order = rng.permutation(len(x))
        apart, fit = order[: len(x) // 5], order[len(x) // 5 :]
        net = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        first, second = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net]
        step = 0
        for _ in range(epochs):
            rng.shuffle(fit)
            for at in range(0, len(fit), 256):
                step += 1
                b = fit[at : at + 256]
                hidden = np.tanh(x[b] @ net[0] + net[1])
                error = (_sigmoid(hidden @ net[2] + net[3]) - y[b]) / len(b)
                back = np.outer(error, net[2]) * (1 - hidden**2)
                slopes = [x[b].T @ back + 1e-4 * net[0], back.sum(axis=0), hidden.T @ error + 1e-4 * net[2], error.sum(keepdims=True)]
                for p, m, v, g in zip(net, first, second, slopes, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.net = tuple(net)
        logits = self._logits(x[apart])
        losses = [(float(np.mean(np.logaddexp(0, np.where(y[apart] > 0, -1, 1) * logits / t))), t) for t in np.geomspace(0.5, 8, 61)]
        self.temperature = min(losses)[1] if len(apart) else 1.0

    def _logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.net
        return np.tanh(x @ w1 + b1) @ w2 + b2

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 of each text; null counts as empty. Without both labels in training, their share."""
        if self.net is None:
            return np.full(len(texts), self.prior)
        scores = [np.zeros(0)]
        for chunk in _chunked((t or "").encode("utf-8", "surrogatepass") for t in texts):
            x = (self._features(chunk) - self.centre) / self.scale
            scores.append(_sigmoid(self._logits(x) / self.temperature))
        return np.concatenate(scores)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _chunked(data: Iterable[bytes]) -> Iterator[list[bytes]]:
    own, size = [], 0
    for text in data:
        own.append(text)
        size += len(text)
        if size >= _CHUNK_BYTES:
            yield own
            own, size = [], 0
    if own:
        yield own


def _fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The model of a bounded sample (doc_id, text, label), fitted in a task, so that the driver holds neither texts nor features."""
    if parts := [batch for batch in batches if len(batch)]:
        sample = pd.concat(parts).sort_values(["doc_id", "text", "label"])
        yield pd.DataFrame({"model": [pickle.dumps(QualityModel(sample["text"].tolist(), sample["label"].tolist()))]})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> QualityModel:
    """A model of labelled documents that are not held out: about ``rows`` documents and ``chars`` of text at most.

    Labels other than 0 and 1 teach nothing; of several labels of an id the least holds.
    """
    known = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("label").alias("label"))
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    fitted = bounded_rows(known, texts, rows, chars).repartition(1).mapInPandas(_fitted, "model binary").first()
    return pickle.loads(fitted["model"]) if fitted else QualityModel([], [])


def score_column(docs: DataFrame, model: QualityModel, text_col: str = "text"):
    """The score of each row's text, as a column for ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(shared.value.score(batch.tolist()), dtype="float64")

    return F.pandas_udf(run, "double")(F.col(f"`{text_col}`"))


def classify(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    score is the probability of label 1 of the whole text, 0 to 1, for null and
    empty texts too; predicted is 1 from ``threshold`` on. An empty table gives
    no rows. Further columns of ``docs`` are not read.
    """
    scored = docs.select(F.col(id_col).alias("doc_id"), score_column(docs, model, text_col).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, with all their columns."""
    return docs.filter(score_column(docs, model, text_col) >= threshold)
