"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded by
statistics of its bytes and words and by the log-odds of its words' stems and
shapes; a gated attention, learned from document labels alone, weighs the
passages, and the weighted passage representation is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from twinframe.llm.learn import Adam, hashed_words, labelled_sample, places, sigmoid
from twinframe.llm.tables import held_out, table
from twinframe.llm.text import buffers, mix, rolling, texts_of, word_bounds

#: Labelled rows of each class that the model is fitted to.
FIT_ROWS = 2000
#: Words of a passage.
PASSAGE = 64
HIDDEN, ATTENTION = 16, 8
STEPS = 300
STEM = 6
THRESHOLD = 0.7
#: Byte classes of a word's shape: small letters, capitals, digits; other signs stand for themselves.
CLASSES = np.array(
    [1 if 97 <= b <= 122 or b >= 0x80 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else b for b in range(256)], np.uint8
)
#: Documents of a word needed before its log-odds count.
LEAST = 3
STATISTICS = 15


def _segments(texts):
    """Per buffer: first text, words (start, end), passage of each word, document of each passage."""
    for first, data, starts in buffers(texts):
        begin, end = word_bounds(data)
        doc = np.searchsorted(starts, begin, "right") - 1
        size = np.bincount(doc, minlength=len(starts) - 1)
        index = np.arange(len(begin)) - (np.cumsum(size) - size)[doc]
        # a text without words is one empty passage
        per = np.maximum(1, -(-size // PASSAGE))
        passage = (np.cumsum(per) - per)[doc] + index // PASSAGE
        yield first, data, begin, end, passage, np.repeat(np.arange(len(size)), per)


def _shapes(data, begin, end):
    """Hash of every word's shape: its runs of byte classes."""
    kind = CLASSES[data]
    turn = np.ones(len(data), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[begin] = True
    place = np.cumsum(turn) - turn
    roll = rolling(31)
    prefix = roll.of_bytes(kind[turn])
    low = place[begin]
    high = place[end - 1] + turn[end - 1]
    return mix(roll.slices(prefix, low, high))


def _share(top, bottom):
    return top / np.maximum(bottom, 1)


def _statistics(data, begin, end, passage, n):
    """What needs no labels, per passage: shares of byte classes, word lengths, repetition."""
    kind = CLASSES[data]
    inside = np.concatenate([[0], np.cumsum(kind == 1)]), np.concatenate([[0], np.cumsum(kind == 2)]), np.concatenate([[0], np.cumsum(kind == 3)])
    size = (end - begin).astype(float)
    words = np.bincount(passage, minlength=n).astype(float)
    length = np.bincount(passage, size, n)
    counts = [np.bincount(passage, c[end] - c[begin], n) for c in inside]
    roll = rolling(32)
    word = mix(roll.slices(roll.of_bytes(data), begin, end))
    order = np.lexsort((word, passage))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (word[order[1:]] != word[order[:-1]]) | (passage[order[1:]] != passage[order[:-1]])
    distinct = np.bincount(passage[order[fresh]], minlength=n)
    again = np.zeros(len(word))
    again[1:] = (word[1:] == word[:-1]) & (passage[1:] == passage[:-1])
    first = kind[begin] if len(begin) else np.zeros(0)
    last = kind[end - 1] if len(begin) else np.zeros(0)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    gap = np.zeros(len(begin))
    gap[1:] = lines[begin[1:]] - lines[end[:-1]]
    mean = _share(length, words)
    return np.stack([
        np.log1p(words), mean, np.sqrt(np.maximum(0, _share(np.bincount(passage, size * size, n), words) - mean**2)),
        *(_share(c, length) for c in counts), _share(length - sum(counts), length), _share(distinct, words),
        _share(np.bincount(passage, again, n), words), _share(np.bincount(passage, first == 2, n), words),
        _share(np.bincount(passage, last > 3, n), words), _share(np.bincount(passage, (first > 3) | (first == 3), n), words),
        _share(np.bincount(passage, size <= 2, n), words), _share(np.bincount(passage, size >= 15, n), words),
        _share(np.bincount(passage, gap, n), words),
    ], axis=1)


class Model:
    """Log-odds by sorted key; scaling of the features; weights of encoder, attention and score."""

    def __init__(self, keys, odds, centre, spread, weights):
        self.keys, self.odds, self.centre, self.spread, self.weights = keys, odds, centre, spread, weights

    def encode(self, texts):
        """Features of every passage, and its document."""
        features, owner = [], []
        odds = np.append(self.odds, 0.0)
        for first, data, begin, end, passage, doc in _segments(texts):
            n = len(doc)
            columns = [_statistics(data, begin, end, passage, n)]
            _, stem, low, _ = hashed_words(data, STEM)
            inner = passage[np.clip(np.searchsorted(begin, low, "right") - 1, 0, None)] if len(begin) else low
            for key, at in ((stem, inner), (_shapes(data, begin, end), passage)):
                weight = odds[places(self.keys, key)]
                count = np.bincount(at, minlength=n)
                least = np.zeros(n)
                np.minimum.at(least, at, weight)
                columns.append(np.stack([_share(np.bincount(at, weight, n), count), least], axis=1))
            features.append(np.concatenate(columns, axis=1))
            owner.append(first + doc)
        if not features:
            return np.zeros((0, STATISTICS + 4)), np.zeros(0, np.int64)
        return (np.concatenate(features) - self.centre) / self.spread, np.concatenate(owner)

    def forward(self, x, owner, n):
        """Score of every document, and what the slopes need."""
        w0, b0, v, u, a, c, b = self.weights
        h = np.tanh(x @ w0 + b0)
        gate, value = sigmoid(h @ u), np.tanh(h @ v)
        energy = (gate * value) @ a
        top = np.full(n, -np.inf)
        np.maximum.at(top, owner, energy)
        raised = np.exp(energy - top[owner])
        attention = raised / np.bincount(owner, raised, n)[owner]
        bag = np.stack([np.bincount(owner, attention * h[:, i], n) for i in range(h.shape[1])], axis=1)
        return sigmoid(bag @ c + b[0]), (h, gate, value, attention, bag)

    def score(self, texts):
        x, owner = self.encode(texts)
        scores, (_, _, _, attention, _) = self.forward(x, owner, len(texts))
        return scores, attention, owner


def _slopes(model, x, owner, y, weight):
    """Gradient of the weighted log-loss for every weight array."""
    w0, b0, v, u, a, c, b = model.weights
    score, (h, gate, value, attention, bag) = model.forward(x, owner, len(y))
    miss = (score - y) * weight / len(y)
    d_bag = miss[:, None] * c
    d_h = attention[:, None] * d_bag[owner]
    gain = (h * d_bag[owner]).sum(axis=1)
    mean = np.bincount(owner, attention * gain, len(y))
    d_energy = attention * (gain - mean[owner])
    d_mix = d_energy[:, None] * a
    d_gate, d_value = d_mix * value * gate * (1 - gate), d_mix * gate * (1 - value**2)
    d_h += d_gate @ u.T + d_value @ v.T
    d_in = d_h * (1 - h**2)
    return [
        x.T @ d_in + 1e-4 * w0, d_in.sum(axis=0), h.T @ d_value + 1e-4 * v, h.T @ d_gate + 1e-4 * u,
        (gate * value).T @ d_energy, bag.T @ miss + 1e-4 * c, np.array([miss.sum()]),
    ]


def _log_odds(texts, label):
    """Keys (stems and shapes) in enough documents, and their shrunken log-odds of label 1."""
    pairs = []
    for first, data, begin, end, passage, doc in _segments(texts):
        if len(begin):
            _, stem, low, _ = hashed_words(data, STEM)
            at = np.clip(np.searchsorted(begin, low, "right") - 1, 0, None)
            for key, where in ((stem, passage[at]), (_shapes(data, begin, end), passage)):
                pairs.append(np.unique(np.stack([key, (first + doc[where]).astype(np.uint64)], axis=1), axis=0))
    if not pairs:
        return np.zeros(0, np.uint64), np.zeros(0)
    both = np.concatenate(pairs)
    keys, back = np.unique(both[:, 0], return_inverse=True)
    good = np.bincount(back, label[both[:, 1].astype(np.int64)])
    total = np.bincount(back)
    enough = total >= LEAST
    ones, all_ = max(1, label.sum()), len(label)
    odds = np.log((good + 1) / (ones + 2)) - np.log((total - good + 1) / (max(1, all_ - ones) + 2))
    return keys[enough], odds[enough]


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the driver to a bounded sample of labelled rows (``rows`` per class); whole texts are used.

    The log-odds come from one half of the sample, the network is fitted to the
    other. Without labels of both classes every text scores the share of 1.
    """
    texts, label, weight = labelled_sample(docs, labels, "quality", rows, id_col, text_col)
    random = np.random.default_rng(1)
    width = STATISTICS + 4
    draw = lambda *shape: random.normal(0, 1 / np.sqrt(shape[0]), shape)
    weights = [draw(width, HIDDEN), np.zeros(HIDDEN), draw(HIDDEN, ATTENTION), draw(HIDDEN, ATTENTION), draw(ATTENTION), draw(HIDDEN), np.zeros(1)]
    model = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(width), np.ones(width), weights)
    if len(set(label.tolist())) < 2:
        share = float(label.mean()) if len(label) else 0.5
        weights[5][:] = 0
        weights[6][0] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return model
    half = random.permutation(len(texts)) % 2 == 0
    model.keys, model.odds = _log_odds([t for t, own in zip(texts, half) if own], label[half])
    chosen = np.flatnonzero(~half) if len(set(label[~half].tolist())) == 2 else np.arange(len(texts))
    x, owner = model.encode([texts[i] for i in chosen])
    model.centre, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - model.centre) / model.spread
    y, weight = label[chosen].astype(float), weight[chosen] / weight[chosen].mean()
    adam = Adam(weights, 0.02)
    for _ in range(STEPS):
        adam.move(_slopes(model, x, owner, y, weight))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, passage) per row of ``docs``; ``passage`` is the number of the one with the most attention.

    Null and empty texts are one empty passage. Repeated rows keep a row each, a
    null id is carried along, other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(
        [model.keys, model.odds, model.centre, model.spread, model.weights]
    )

    def run(batches):
        own = Model(*held.value)
        for batch in batches:
            texts = texts_of(batch.column(1))
            scores, tops = [], []
            for low in range(0, len(texts), 256):
                part = texts[low : low + 256]
                found, attention, owner = own.score(part)
                scores.append(found)
                order = np.lexsort((np.arange(len(owner)), -attention, owner))
                first = np.searchsorted(owner, np.arange(len(part)))
                tops.append(order[first] - first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(scores or [np.zeros(0)])), pa.array(np.concatenate(tops or [np.zeros(0, np.int64)]))],
                names=["id", "score", "passage"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double, passage long")


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = score(docs, fit(docs, table(spark, folder, "labels")))
    return found.select(
        F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
