"""Language by multilingual mixture inference.

Each language is a distribution over hashed byte 4-grams of lower-cased letters,
counted over labelled texts. A document is a mixture of languages: expectation-
maximisation finds the shares under which its n-grams are likeliest, and the
set of languages grows, largest share first, as long as the likelihood gains
more than the penalty of a further language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from twinframe.llm.tables import held_out, table

GRAM = 4
BITS = 16
#: Labelled rows per language that the n-gram counts are taken from; the rows of smallest id hash.
FIT_ROWS = 4000
ROUNDS = 12
SMOOTH = 0.1
UNKNOWN = "und"
#: Bytes that are no letter: ASCII but a-z; other bytes belong to letters or symbols of other scripts.
FOLD = bytes(b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256))
FOUND = "id {id}, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
LANGUAGES = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))


def grams(text: str) -> np.ndarray:
    """Bucket of every 4-gram of a text, white space and signs as one space; none without a letter."""
    if not any(map(str.isalpha, text)):
        return np.zeros(0, np.int64)
    data = np.frombuffer(b" " + text.lower().encode(errors="replace").translate(FOLD) + b"   ", np.uint8)
    blank = data == 32
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    data = data[keep].astype(np.uint32)
    if len(data) < GRAM:
        data = np.concatenate([data, np.full(GRAM - len(data), 32, np.uint32)])
    packed = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    return ((packed * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


class Model:
    """Languages in code point order and the probability of every bucket in each."""

    def __init__(self, languages: list[str], chance: np.ndarray):
        self.languages, self.chance = languages, chance

    def shares(self, chance: np.ndarray) -> tuple[np.ndarray, float]:
        """Shares of the languages (rows) under which the n-grams (columns) are likeliest, and their log-likelihood."""
        share = np.full(len(chance), 1 / len(chance))
        for _ in range(ROUNDS):
            last, total = share, share @ chance
            share = share * (chance @ (1 / total)) / chance.shape[1]
            share /= share.sum()
            if np.abs(share - last).max() < 1e-3:
                break
        return share, float(np.log(share @ chance).sum())

    def judge(self, text: str) -> tuple[str, float, list[dict]]:
        found = grams(text)
        if not len(found) or not self.languages:
            return UNKNOWN, 0.0, []
        chance = self.chance[:, found]
        share, _ = self.shares(chance)
        order = np.lexsort((np.arange(len(share)), -share))
        # every letter is part of GRAM n-grams, so their likelihoods count once in GRAM
        penalty = 0.5 * np.log(max(2, len(found)))
        best, chosen = None, None
        for size in range(1, len(order) + 1):
            rows = np.sort(order[:size])
            part, fit = self.shares(chance[rows]) if size > 1 else (np.ones(1), float(np.log(chance[rows[0]]).sum()))
            gain = fit / GRAM - penalty * size
            if best is not None and gain <= best:
                break
            best, chosen = gain, (rows, part)
        rows, part = chosen
        first = rows[np.argmax(part)]
        listed = sorted(zip((-part).tolist(), rows.tolist()))
        return (
            self.languages[first], float(min(1.0, max(0.0, share[first]))),
            [{"lang": self.languages[r], "share": -p} for p, r in listed],
        )


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS) -> Model:
    """Count n-grams per language over at most about ``rows`` labelled rows each.

    Rows of null text or language teach nothing. Languages are few: what comes
    to the driver is one count per language and bucket.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = known.groupBy(F.col(lang_col).alias("lang")).count().collect()
    if not sizes:
        return Model([], np.zeros((0, 1 << BITS)))
    # hashes are uniform over 2**64; a language keeps the rows below its share
    keep = F.lit(False)
    order = F.xxhash64(F.lit(7), F.col(id_col))
    for row in sizes:
        cut = (1 << 63) - 1 if row["count"] <= rows else int((1 << 64) * rows / row["count"]) - (1 << 63)
        keep = keep | ((F.col(lang_col) == row["lang"]) & (order <= cut))
    sample = known.where(keep).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).repartition(8)

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = totals.setdefault(lang, np.zeros(1 << BITS, np.int64))
                own += np.bincount(grams(text), minlength=1 << BITS)
        for lang, own in totals.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(own[used])], names=["lang", "bucket", "n"]
            )

    counted = (
        sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    languages = sorted({row["lang"] for row in sizes})
    matrix = np.zeros((len(languages), 1 << BITS))
    place = {lang: i for i, lang in enumerate(languages)}
    matrix[counted["lang"].map(place).to_numpy(np.int64), counted["bucket"].to_numpy(np.int64)] = counted["n"].to_numpy(float)
    matrix += SMOOTH
    return Model(languages, matrix / matrix.sum(axis=1, keepdims=True))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, languages) per row of ``docs``.

    ``score`` is the share of the predicted language, ``languages`` the chosen
    set with its shares, largest first. Null text, text without a letter, or a
    model without languages gives "und", 0 and no languages. Of equal shares the
    language first in code point order wins. Repeated rows keep a row each, a
    null id is carried along, other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.languages, model.chance))

    def run(batches):
        own = Model(*held.value)
        for batch in batches:
            found = [own.judge(t or "") for t in batch.column(1).to_pylist()]
            names, scores, sets = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, LANGUAGES)],
                names=["id", "lang_pred", "score", "languages"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, FOUND.format(id=rows.schema["id"].dataType.simpleString()))


def rejected_dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows of ``docs`` that have a language, learned from the rows that are not held out.

    Texts that are null or have no letter go; all columns are kept.
    """
    model = fit(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    held = docs.sparkSession.sparkContext.broadcast((model.languages, model.chance))

    def run(batches):
        own = Model(*held.value)
        for batch in batches:
            kept = [own.judge(t or "")[0] != UNKNOWN for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = predict(docs, fit(docs.where(~held_out())))
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")
