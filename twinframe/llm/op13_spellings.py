"""Spelling variants by a bit-sliced position index.

For every position and letter of a block of words there is one bitset over the
block: the words with that letter there. A word is looked up letter by letter,
64 words of the block at a time. Four sets run along: the words that agree so
far, and those with one error so far, which is a replaced letter (same
position), an extra letter of theirs (read one position ahead), or one they
lack (one position behind). All words of a block are looked up together, as
rows of a matrix of bitsets.

Words meet only where they can be near: of two words one edit apart, the
shorter with ``l`` letters, the first ``l // 2`` letters of both are equal or
the last ``l - l // 2`` are. Each word goes to these two buckets for its own
length and for one less, and blocks are cut at bucket borders. A bucket larger
than ``PART`` is dealt as pairs of parts. What leaves a task is per word: how
many near words it found and the best of them.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from twinframe.llm.tables import table
from twinframe.session import materialize

#: Fixed by the contract: the divisor that marks a run, letters and uses a word needs, and a form's lead.
DIVISOR = 31
LETTERS = 7
USES = 2
LEAD = 10
#: Distinct words a task gathers before it hands on their counts.
GATHERED = 200_000
#: Rows of one bucket that one group holds; larger buckets are dealt as pairs of parts.
PART = 1 << 14
#: Letters that one shard of buckets holds, and letters of one block of words, on average.
SHARD_LETTERS = 1 << 20
BLOCK_LETTERS = 1 << 14
#: Rows of the bit matrix whose near words are listed at once.
LISTED = 256
#: Latin-1 bytes: A-Z lowered, a-z and 0xC0-0xFF as they are, all others a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def marked(word: bytes, check: int, divisor: int = DIVISOR) -> bytes:
    """A Latin-1 word without its code point ``check % length`` where ``divisor`` divides ``check``."""
    if check % divisor:
        return word
    at = check % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    divisor: int = DIVISOR, letters: int = LETTERS, uses: int = USES,
) -> DataFrame:
    """(word, n): the marked runs of at least ``letters`` code points with ``uses`` occurrences or more.

    The check of a run is the crc32 of its row's id as text (null: empty), a
    colon and the run. Null and empty texts have no runs; repeated rows each
    count. Task totals are added up after one shuffle of distinct words.
    """

    def run(batches):
        found: Counter = Counter()

        def emitted():
            words = pa.array([w.decode("latin-1") for w in found], pa.string())
            counts = pa.array(np.fromiter(found.values(), np.int64, len(found)))
            found.clear()
            return pa.RecordBatch.from_arrays([words, counts], names=["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # characters beyond Latin-1 become "?", which is no letter
                own = Counter(w for w in text.encode("latin-1", "replace").translate(FOLD).split() if len(w) >= letters)
                head = zlib.crc32(f"{key}:".encode())
                for word, n in own.items():
                    kept = marked(word, zlib.crc32(word.decode("latin-1").encode(), head), divisor)
                    if len(kept) >= letters:
                        found[kept] += n
                if len(found) > GATHERED:
                    yield emitted()
        yield emitted()

    rows = docs.where(F.length(text_col) > 0).select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text")
    )
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= uses)


class PositionIndex:
    """Bitsets over a block of words, one per (position, letter) that occurs."""

    def __init__(self, letters: np.ndarray, sizes: np.ndarray):
        """``letters``: one row per word, zero beyond its ``sizes``."""
        self.words, self.width = len(sizes), letters.shape[1]
        self.columns = (self.words + 63) // 64
        word, at = np.nonzero(letters)
        key = at * 256 + letters[word, at].astype(np.int64)
        kinds, row = np.unique(key, return_inverse=True)
        self.row_of = np.full((self.width + 1) * 256, len(kinds), np.int64)
        self.row_of[kinds] = np.arange(len(kinds))
        self.sets = np.zeros((len(kinds) + 1, self.columns), np.uint64)
        np.bitwise_or.at(self.sets, (row, word >> 6), np.uint64(1) << (word & 63).astype(np.uint64))
        self.of_size = {}
        for size in np.unique(sizes).tolist():
            self.of_size[size] = self._set(np.flatnonzero(sizes == size))

    def _set(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(self.columns, np.uint64)
        np.bitwise_or.at(out, words >> 6, np.uint64(1) << (words & 63).astype(np.uint64))
        return out

    def having(self, at: int, letters: np.ndarray) -> np.ndarray:
        """One row per letter: the words that have it at position ``at``."""
        return self.sets[self.row_of[at * 256 + letters.astype(np.int64)]]

    def near(self, letters: np.ndarray, size: int) -> np.ndarray:
        """One bitset per looked-up word, all of ``size`` letters: the words exactly one edit away."""
        agree = np.full((len(letters), self.columns), ~np.uint64(0))
        replaced, extra, lacking = (np.zeros_like(agree) for _ in range(3))
        for at in range(size):
            here = self.having(at, letters[:, at])
            ahead = self.having(at + 1, letters[:, at]) if at + 1 < self.width else np.uint64(0)
            # one error so far: agreed up to here and differs now, or erred before and agrees in its own position
            lacking = agree | (lacking & self.having(at - 1, letters[:, at])) if at else agree
            extra = (extra | agree) & ahead
            replaced = (replaced & here) | (agree & ~here)
            agree = agree & here
        none = np.zeros(self.columns, np.uint64)
        return (
            (replaced & self.of_size.get(size, none))
            | ((extra | agree) & self.of_size.get(size + 1, none))
            | (lacking & self.of_size.get(size - 1, none))
        )


def _matrix(words: list[bytes], sizes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), int(sizes.max())), np.uint8)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    return out


def _near_pairs(words: list[bytes], sizes: np.ndarray, asked: np.ndarray, held: np.ndarray):
    """Yields (i, j) index arrays: words of ``asked`` and their near words among ``held``."""
    letters = _matrix([words[i] for i in held.tolist()], sizes[held])
    index = PositionIndex(letters, sizes[held])
    for size in np.unique(sizes[asked]).tolist():
        own = asked[sizes[asked] == size]
        for first in range(0, len(own), LISTED):
            part = own[first : first + LISTED]
            found = index.near(_matrix([words[i] for i in part.tolist()], sizes[part]), size)
            row, column = np.nonzero(found)
            bits = np.unpackbits(found[row, column].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            which, bit = np.nonzero(bits)
            yield part[row[which]], held[column[which] * 64 + bit]


def _blocks(bucket: np.ndarray, sizes: np.ndarray):
    """Yields (asked, held) index arrays of sorted rows, so that rows of one bucket all meet.

    A block holds whole buckets; one larger than a block is cut and its cuts meet in pairs.
    """
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.append(starts[1:], len(bucket))
    several = ends - starts > 1
    starts, ends = starts[several], ends[several]
    total = np.concatenate([[0], np.cumsum(sizes)])
    held: list[np.ndarray] = []
    letters = 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        size = int(total[b] - total[a])
        if held and letters + size > BLOCK_LETTERS:
            rows = np.concatenate(held)
            yield rows, rows
            held, letters = [], 0
        if size <= BLOCK_LETTERS:
            held.append(np.arange(a, b))
            letters += size
            continue
        cut = max(2, -(-size // BLOCK_LETTERS))
        parts = [p for p in np.array_split(np.arange(a, b), cut) if len(p)]
        for mine in parts:
            for other in parts:
                yield mine, other
    if held:
        rows = np.concatenate(held)
        yield rows, rows


def _bucket_keys(word: Column) -> Column:
    """(low, side, part of the word) for pairs whose shorter word has ``low`` letters."""
    size = F.length(word)

    def of(low):
        half = F.floor(low / 2).cast("int")
        return [
            F.struct(low.alias("low"), F.lit(0).alias("side"), F.substring(word, F.lit(1), half).alias("shared")),
            F.struct(low.alias("low"), F.lit(1).alias("side"), F.right(word, low - half).alias("shared")),
        ]

    return F.filter(F.array(*of(size), *of(size - 1)), lambda k: k["low"] >= 1)


FOUND = "word string, n long, n_near long, form string, form_n long"


def near_words(words: DataFrame, part: int = PART) -> DataFrame:
    """(word, n, n_near, best, best_n) of the words of ``words`` (word, n) that have near words.

    Words must be distinct, and their code points at most U+00FF. Near: exactly
    one inserted, deleted or replaced code point. ``best`` is the near word of
    largest n, of equal ones the smallest in code-point order.
    """
    words = words.where(F.length("word") > 0)
    keyed = words.select("word", "n", F.explode(_bucket_keys(F.col("word"))).alias("key")).select(
        "word", "n", F.col("key.low").alias("low"), F.xxhash64("key.low", "key.side", "key.shared").alias("bucket"),
        (F.col("key.side") == 1).alias("tail"),
    )
    large = keyed.groupBy("low", "bucket").count().where(F.col("count") > part).select(
        "low", "bucket", F.ceil(F.col("count") / part).cast("int").alias("parts")
    )
    letters = words.agg(F.sum(4 * F.length("word"))).first()[0] or 0
    shards = letters // SHARD_LETTERS + 1
    own = F.pmod(F.xxhash64("word", F.lit(3)), F.col("parts")).cast("int")
    pair = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    dealt = (
        keyed.join(large, ["low", "bucket"], "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("group", F.when(F.col("parts") == 1, F.col("bucket")).otherwise(pair))
        # a pair of two parts compares across, a part paired with itself inside
        .select("word", "n", "low", "tail", "group", F.when(F.col("own") != F.col("other"), F.col("own")).alias("across"))
        .withColumn("shard", F.pmod(F.xxhash64("group", "low"), F.lit(shards)))
    )

    def search(rows):
        low, group = rows.column("low").to_numpy(), rows.column("group").to_numpy()
        order = np.lexsort((group, low))
        rows = rows.take(pa.array(order))
        low, group = low[order].astype(np.int64), group[order]
        text = rows.column("word").to_pylist()
        words = [w.encode("latin-1") for w in text]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        tail = rows.column("tail").to_numpy(zero_copy_only=False)
        across = rows.column("across").fill_null(-1).to_numpy()
        n = rows.column("n").to_numpy()
        place = np.empty(len(words), np.int64)
        place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        total = np.zeros(len(words), np.int64)
        best = np.full(len(words), -1)
        # rows of one length class only share a block, and a bucket is one class
        bucket = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]) | (low[1:] != low[:-1])])) if len(words) else group
        for lo in np.unique(low).tolist():
            rows_of = np.flatnonzero(low == lo)
            for asked, held in _blocks(bucket[rows_of], sizes[rows_of]):
                for i, j in _near_pairs(words, sizes, rows_of[asked], rows_of[held]):
                    kept = (group[i] == group[j]) & (np.minimum(sizes[i], sizes[j]) == lo)
                    kept &= (across[i] < 0) | (across[i] != across[j])
                    i, j = i[kept], j[kept]
                    if not len(i):
                        continue
                    # a pair that shares its first half met there already
                    half = lo // 2
                    again = np.array([words[a][:half] == words[b][:half] for a, b in zip(i.tolist(), j.tolist())]) & tail[i]
                    i, j = i[~again], j[~again]
                    total += np.bincount(i, minlength=len(words))
                    ranked = np.lexsort((place[j], -n[j], i))
                    i, j = i[ranked], j[ranked]
                    lead = np.concatenate([[True], i[1:] != i[:-1]]) if len(i) else np.zeros(0, bool)
                    i, j = i[lead], j[lead]
                    old = best[i]
                    better = (old < 0) | (n[j] > n[old]) | ((n[j] == n[old]) & (place[j] < place[old]))
                    best[i[better]] = j[better]
        some = np.flatnonzero(total)
        return pa.table({
            "word": pa.array([text[i] for i in some.tolist()], pa.string()), "n": n[some], "n_near": total[some],
            "form": pa.array([text[i] for i in best[some].tolist()], pa.string()), "form_n": n[best[some]],
        })

    found = dealt.groupBy("shard").applyInArrow(search, FOUND)
    # the smallest of (-n, word) is the largest n, of equal ones the first word
    lead = F.min(F.struct((-F.col("form_n")).alias("minus"), F.col("form").alias("word"))).alias("lead")
    return found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), lead).select(
        "word", "n", "n_near", F.col("lead.word").alias("best"), (-F.col("lead.minus")).alias("best_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where following forms ends; every round doubles the steps.

    Forms rise in their count, so there is no circle, and chains are as long as
    a count can grow tenfold: a handful of rounds.
    """
    found = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = found.join(onward, "root", "left")
        moved = joined.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        moved = materialize(moved)
        found = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return found


def spelling_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    divisor: int = DIVISOR, letters: int = LETTERS, uses: int = USES, lead: int = LEAD,
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) per word of ``word_counts``.

    A word's form is its near word of largest n (of equal ones the smallest in
    code-point order) if that is at least ``lead`` times its own n, else null;
    its root is where following forms ends, itself without a form. A word
    without near words has n_near 0. Null and empty texts, null ids, repeated
    rows: see ``word_counts``. Other columns are not read; an empty table gives
    an empty table.
    """
    if lead <= 1:
        raise ValueError("a form must have more uses than its word, or forms could run in a circle")
    words = materialize(word_counts(docs, id_col, text_col, divisor, letters, uses))
    near = materialize(near_words(words).withColumn("formed", F.col("best_n") >= lead * F.col("n")))
    followed = roots(near.where("formed").select("word", F.col("best").alias("form")))
    return (
        words.join(near.drop("n"), "word", "left").join(followed, "word", "left")
        .select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("formed"), F.col("best")).alias("form"),
            F.when(F.col("formed"), F.col("best_n")).alias("form_n"), F.coalesce("root", "word").alias("root"),
        )
    )


def op13_spellings(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_groups(table(spark, folder, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
