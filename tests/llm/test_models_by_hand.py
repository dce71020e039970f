"""Scores of the language and quality models against plain dictionaries and loops."""

import math
import re
from collections import Counter, defaultdict

import numpy as np

from framelake.llm import language_id, quality
from framelake.llm.recompression import read_words

WORD = re.compile(r"[a-z\x80-\U0010ffff]+")


def training():
    german = ["der Hund und die Katze und der Wald", "die Straße und das Haus, der Hund", "und die Wälder über dem Fluss"]
    english = ["the dog and the cat and the wood", "the street and the house, the dog", "a naïve view of the river"]
    return [*german, *english], ["de"] * 3 + ["en"] * 3


def by_dictionary(texts, labels, most=5):
    """(word logs, n-gram logs by size) as dictionaries."""
    languages = sorted(set(labels))
    words = {x: Counter() for x in languages}
    for text, label in zip(texts, labels):
        words[label].update(WORD.findall(text.lower()))

    def logs(counts):
        keys = {k for c in counts.values() for k in c}
        totals = {x: sum(c.values()) for x, c in counts.items()}
        return {k: [math.log((counts[x].get(k, 0) + 0.5) / (totals[x] + 0.5 * len(keys) + 1)) for x in languages] for k in keys}

    grams = {}
    for n in range(most, 0, -1):
        counts = {x: defaultdict(float) for x in languages}
        for x in languages:
            for w, c in words[x].items():
                spelled = " " + w
                for i in range(len(spelled) - n + 1):
                    counts[x][spelled[i : i + n]] += math.log1p(c)
        grams[n] = logs(counts)
    return languages, logs({x: {w: c for w, c in words[x].items() if c > 1} for x in languages}), grams


def score_by_dictionary(model, text):
    languages, words, grams = model
    found = WORD.findall(text.lower())
    if not found or not any(c.isalpha() for c in text):
        return "und", 0.0
    total = np.zeros(len(languages))
    for w in found:
        if w in words:
            total += words[w]
            continue
        spelled, places = " " + w, []
        for i in range(len(spelled)):
            near = next((grams[n][spelled[i : i + n]] for n in range(5, 0, -1) if i + n <= len(spelled) and spelled[i : i + n] in grams[n]), [0.0] * len(languages))
            places.append(near)
        total += np.mean(places, axis=0)
    p = total / len(found) * min(len(found), 20)
    p = np.exp(p - p.max())
    return languages[int(p.argmax())], float(p.max() / p.sum())


def test_words_first_and_backoff_by_hand():
    texts, labels = training()
    model, plain = language_id.LanguageModel(texts, labels), by_dictionary(texts, labels)
    asked = ["der Hund", "The WOODS were naïve", "Katzen und Wald", "é", "ß", "qqq", "x", "a", "", "123 !?", "«»", "straßenhund", "und und und the", "über " * 300, None, "dog katze"]
    names, chances = model.score(asked)
    for text, name, chance in zip(asked, names, chances):
        want = score_by_dictionary(plain, text or "")
        assert name == want[0] and math.isclose(chance, want[1], rel_tol=1e-4, abs_tol=1e-6), text
    # A text's score doesn't depend on the texts that it is scored with.
    for text, name, chance in zip(asked, names, chances):
        alone = model.score([text])
        assert alone[0][0] == name and math.isclose(alone[1][0], chance, rel_tol=1e-5, abs_tol=1e-7)


def features_by_hand(model, text):
    """The features of one document, word after word."""
    data = text.encode()
    words = read_words(data, np.array([0, len(data)]))
    spelled = [data[s : s + n] for s, n in zip(words.start.tolist(), words.length.tolist())]
    _, form = quality._read([data])
    row = {int(n): i for i, n in enumerate(model.names)}
    vectors = [quality._FORM_VECTORS[f] + model.contexts[row.get(int(n), len(model.names))] for f, n in zip(form, words.name)]
    n, dim = len(spelled), quality.DIM
    mean = sum(vectors, np.zeros(dim)) / max(n, 1)
    spread = np.sqrt(sum((v * v for v in vectors), np.zeros(dim)) / max(n, 1))
    products = sum(float(vectors[i] @ vectors[j]) for i in range(n) for j in range(n) if i != j)
    same = sum(a == b for a, b in zip(spelled, spelled[1:]))
    return np.concatenate([mean, spread, [math.log1p(n), (n - len(set(spelled))) / (n + 8), same / (n + 4), products / (n * (n - 1) + 10)]])


def test_quality_features_and_network_by_hand():
    rng = np.random.default_rng(3)
    calm = "the river runs past old trees and a quiet house while people walk home".split()
    loud = "BUY NOW!!! $$$ click WIN free >>> 100% deal".split()
    texts = [" ".join(rng.choice(calm, 20)) for _ in range(80)] + [" ".join(rng.choice(loud, 20)) for _ in range(80)]
    model = quality.QualityModel(texts, [1] * 80 + [0] * 80)
    asked = ["the river runs and runs", "BUY BUY BUY!!! now", "", "unseen wörter: ½ 7", "the", " ".join(calm * 3 + loud), "\t \n"]
    got = model.features([t.encode() for t in asked])
    want = np.array([features_by_hand(model, t) for t in asked])
    assert np.allclose(got, want, rtol=1e-3, atol=1e-4)
    w1, b1, w2, b2 = model.net
    for text, x, score in zip(asked, want, model.score(asked)):
        hidden = [math.tanh(sum((x[i] - model.centre[i]) / model.scale[i] * w1[i, j] for i in range(len(x))) + b1[j]) for j in range(len(b1))]
        logit = (sum(h * w for h, w in zip(hidden, w2)) + b2[0]) / model.temperature
        assert math.isclose(score, 1 / (1 + math.exp(-logit)), rel_tol=1e-2, abs_tol=1e-3), text
    assert model.score(["the river runs past old trees"])[0] > 0.8 and model.score(["BUY NOW!!! click WIN"])[0] < 0.2
    assert model.score([None])[0] == model.score([""])[0]
    # The temperature is the one of its grid with the least loss on what training left out.
    assert 0.5 <= model.temperature <= 8


def test_quality_is_fitted_in_a_task(spark, monkeypatch):
    """The driver gets the model, not the sample; the model is the one that the sample gives."""
    import numpy as np
    from pyspark.sql import functions as F

    from framelake.llm import quality, sampling
    from framelake.llm.common import held_out

    docs = spark.createDataFrame([(i, f"good plain words number {i % 7} here") if i % 2 else (i, f"BUY!!! now {i % 5} $$$") for i in range(120)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality")
    known = labels.filter(~held_out(F.col("doc_id"))).withColumnRenamed("quality", "label")
    sample = sampling.bounded_texts(known, docs, 1000, 10**6)
    by_hand = quality.QualityModel(sample["text"].tolist(), sample["label"].tolist())
    monkeypatch.delattr(quality.QualityModel, "__init__")
    model = quality.fit(docs, labels)
    texts = ["good words", "BUY $$$", "", None]
    assert np.allclose(model.score(texts), by_hand.score(texts), atol=1e-9)
