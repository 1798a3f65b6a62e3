"""Toxic spans by a linear-chain conditional random field.

Labels are given per document, so tokens are labelled first: a word or stem that is far
more frequent in toxic documents than chance allows is a toxic token where it
stands in a toxic document. A two-state chain is then fitted to these tokens by
its likelihood, with weights for a word and its neighbours and for the passage
from state to state. Forward-backward marginals give every token's probability;
their aggregates score the document, and runs of likely tokens are its
offending spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from twinframe.llm.learn import Adam, hashed_words, labelled_sample, places, sigmoid
from twinframe.llm.tables import held_out, table
from twinframe.llm.text import buffers, texts_of

#: Labelled rows of each class that the model is fitted to.
FIT_ROWS = 2000
#: Tokens of one chain.
CHAIN = 64
#: First bytes of a word that count as its stem.
STEM = 6
STEPS = 60
#: Log-likelihood ratio from which a word's excess in toxic documents is no chance.
EXCESS = 15.0
#: Weights below this, all three together, count as none.
NO_WEIGHT = 0.3
THRESHOLD = 0.3
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
FOUND = "id {id}, score double, spans array<struct<start:int,end:int>>"


def _tokens(texts):
    """Hashes of all words and their stems with their document, and start and end within it."""
    parts = []
    for first, data, starts in buffers(texts):
        hashes, stem, begin, end = hashed_words(data, STEM)
        doc = np.searchsorted(starts, begin, "right") - 1
        parts.append((hashes, stem, first + doc, begin - starts[doc], end - starts[doc]))
    return [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 3


def _chains(doc):
    """Place of every token in a grid (step, chain); a chain stays within a document."""
    size = np.bincount(doc) if len(doc) else np.zeros(0, np.int64)
    first = np.cumsum(size) - size
    index = np.arange(len(doc)) - first[doc] if len(doc) else doc
    per = -(-size // CHAIN)
    return index % CHAIN, (np.cumsum(per) - per)[doc] + index // CHAIN if len(doc) else doc, int(per.sum())


def _neighbours(bucket, doc, none):
    """Places of the words before and after, ``none`` at the ends of a document."""
    before, after = np.full(len(bucket), none), np.full(len(bucket), none)
    same = doc[1:] == doc[:-1]
    before[1:][same] = bucket[:-1][same]
    after[:-1][same] = bucket[1:][same]
    return before, after


class Field:
    """Weights of the chain for a word and its neighbours by place among ``keys``, a bias, and passage[from, to].

    Words that are not among the keys have the last weight, zero.
    """

    def __init__(self, keys, own, before, after, bias, passage, scale):
        self.keys, self.own, self.before, self.after = keys, own, before, after
        self.bias, self.passage, self.scale = bias, passage, scale

    def emission(self, word, stem, before, after):
        return self.bias[0] + self.own[word] + self.own[stem] + self.before[before] + self.after[after]

    def places(self, hashes, stems, doc):
        word, stem = places(self.keys, hashes), places(self.keys, stems)
        return word, stem, *_neighbours(word, doc, len(self.keys))

    def marginals(self, emission, step, chain, n_chains, pairs=False):
        """Probability of state 1 per token and, if asked, the expected passages; in the grid, step by step."""
        grid = np.zeros((CHAIN, n_chains))
        inside = np.zeros((CHAIN, n_chains), bool)
        grid[step, chain], inside[step, chain] = emission, True
        one = np.exp(np.clip(grid, -30, 30))
        move = np.exp(self.passage)
        # the first column is state 0; every step is scaled to sum 1
        ahead = np.empty((CHAIN, 2, n_chains))
        a0, a1 = np.ones(n_chains), one[0].copy()
        for t in range(CHAIN):
            if t:
                a0, a1 = a0 * move[0, 0] + a1 * move[1, 0], (a0 * move[0, 1] + a1 * move[1, 1]) * one[t]
            total = a0 + a1
            a0, a1 = a0 / total, a1 / total
            ahead[t, 0], ahead[t, 1] = a0, a1
        b0, b1 = np.ones(n_chains), np.ones(n_chains)
        high = np.empty((CHAIN, n_chains))
        expected = np.zeros((2, 2))
        for t in range(CHAIN - 1, -1, -1):
            p1 = ahead[t, 1] * b1
            high[t] = p1 / (ahead[t, 0] * b0 + p1)
            if not t:
                break
            live = inside[t]
            e1 = one[t] * b1
            if pairs:
                before = ahead[t - 1]
                joint = np.array([
                    [before[0] * move[0, 0] * b0, before[0] * move[0, 1] * e1],
                    [before[1] * move[1, 0] * b0, before[1] * move[1, 1] * e1],
                ])
                expected += (joint / joint.sum(axis=(0, 1)) * live).sum(axis=2)
            n0, n1 = move[0, 0] * b0 + move[0, 1] * e1, move[1, 0] * b0 + move[1, 1] * e1
            total = n0 + n1
            # a step past the end of a chain tells nothing
            b0, b1 = np.where(live, n0 / total, 1.0), np.where(live, n1 / total, 1.0)
        return high[step, chain], expected

    def aggregate(self, high, doc, n):
        """Per document: log of one plus the expected toxic tokens, their greatest probability, their share."""
        total = np.bincount(doc, high, n)
        most = np.zeros(n)
        np.maximum.at(most, doc, high)
        return np.stack([np.log1p(total), most, total / np.maximum(1, np.bincount(doc, minlength=n))], axis=1)

    def tag(self, texts):
        """(score per text, tokens as (document, start, end, probability))."""
        hashes, stems, doc, start, end = _tokens(texts)
        step, chain, n_chains = _chains(doc)
        high, _ = self.marginals(self.emission(*self.places(hashes, stems, doc)), step, chain, n_chains)
        return sigmoid(self.aggregate(high, doc, len(texts)) @ self.scale[:-1] + self.scale[-1]), (doc, start, end, high)


def toxic_words(bucket, doc, label, n):
    """Which of n words stand in toxic documents more often than chance allows."""
    pairs = np.unique(doc * n + bucket)
    of, word = pairs // n, pairs % n
    bad = np.bincount(word, label[of], n)
    total = np.bincount(word, minlength=n).astype(float)
    share = label.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        rate = bad / total
        ratio = 2 * (
            np.where(bad > 0, bad * np.log(rate / share), 0)
            + np.where(bad < total, (total - bad) * np.log((1 - rate) / (1 - share)), 0)
        )
    return (rate > (1 + share) / 2) & (ratio > EXCESS)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fit the field on the driver to a bounded sample of labelled rows (``rows`` per class); whole texts are used.

    Without labels of both classes the field scores every text with the share of 1.
    """
    texts, label, weight = labelled_sample(docs, labels, "toxic", rows, id_col, text_col)
    hashes, stems, doc, _, _ = _tokens(texts)
    keys = np.unique(np.concatenate([hashes, stems]))
    width = len(keys) + 1
    bias, passage = np.array([-3.0]), np.zeros((2, 2))
    own, before_w, after_w = np.zeros(width), np.zeros(width), np.zeros(width)
    share = float((label * weight).mean()) if len(label) else 0.0
    scale = np.array([0.0, 0.0, 0.0, np.log((share + 1e-6) / (1 - share + 1e-6))])
    field = Field(keys, own, before_w, after_w, bias, passage, scale)
    if not len(doc) or len(set(label.tolist())) < 2:
        return field
    word, stem, before, after = at = field.places(hashes, stems, doc)
    toxic = toxic_words(np.concatenate([word, stem]), np.concatenate([doc, doc]), label, len(keys))
    y = ((toxic[word] | toxic[stem]) & (label[doc] == 1)).astype(float)
    step, chain, n_chains = _chains(doc)
    grid = np.zeros((CHAIN, n_chains), np.int64)
    grid[step, chain] = y
    used = np.zeros((CHAIN, n_chains), bool)
    used[step, chain] = True
    seen = np.zeros((2, 2))
    np.add.at(seen, (grid[:-1][used[1:]], grid[1:][used[1:]]), 1)
    values = [own, before_w, after_w, bias, passage]
    adam = Adam(values, 0.3)
    for _ in range(STEPS):
        high, expected = field.marginals(field.emission(*at), step, chain, n_chains, pairs=True)
        miss = high - y
        adam.move([
            np.bincount(word, miss, width) + np.bincount(stem, miss, width) + 0.05 * own,
            np.bincount(before, miss, width) + 0.05 * before_w, np.bincount(after, miss, width) + 0.05 * after_w,
            np.array([miss.sum()]), expected - seen + 0.05 * passage,
        ])
    # words that hardly move the field are left out
    kept = np.flatnonzero(np.abs(own[:-1]) + np.abs(before_w[:-1]) + np.abs(after_w[:-1]) > NO_WEIGHT)
    field.keys = keys[kept]
    field.own, field.before, field.after = (np.append(w[kept], 0.0) for w in (own, before_w, after_w))
    high, _ = field.marginals(field.emission(*field.places(hashes, stems, doc)), step, chain, n_chains)
    facts = np.concatenate([field.aggregate(high, doc, len(texts)), np.ones((len(texts), 1))], axis=1)
    scaler = Adam([scale], 0.1)
    for _ in range(400):
        scaler.move([facts.T @ ((sigmoid(facts @ scale) - label) * weight) / len(label) + 1e-4 * scale])
    return field


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """(id, score, spans) per row of ``docs``.

    ``spans`` are the byte ranges of runs of words whose probability is
    ``at_least`` that. Null and empty texts have no spans and the score of no
    evidence. Repeated rows keep a row each, a null id is carried along, other
    columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(
        [field.keys, field.own, field.before, field.after, field.bias, field.passage, field.scale]
    )

    def run(batches):
        own = Field(*held.value)
        for batch in batches:
            texts = texts_of(batch.column(1))
            scores, spans = [], []
            for low in range(0, len(texts), 512):
                part = texts[low : low + 512]
                found, (doc, start, end, high) = own.tag(part)
                scores.append(found)
                runs = [[] for _ in part]
                hot = np.flatnonzero(high >= at_least)
                last = -2
                for i, d, a, b in zip(hot.tolist(), doc[hot].tolist(), start[hot].tolist(), end[hot].tolist()):
                    if i == last + 1 and runs[d]:
                        runs[d][-1]["end"] = b
                    else:
                        runs[d].append({"start": a, "end": b})
                    last = i
                spans.extend(runs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(scores or [np.zeros(0)])), pa.array(spans, SPANS)],
                names=["id", "score", "spans"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, FOUND.format(id=rows.schema["id"].dataType.simpleString()))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = score(docs, fit(docs, table(spark, folder, "labels")))
    return found.select(
        F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
