"""Token counts, ranked search and spelling groups against the library, SQL and plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, sorted_rows, words
from twinframe.llm import op11_tokens, op12_search, op13_spellings


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counter(path):
    return op11_tokens.Counter(path)


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


# -- token counts -----------------------------------------------------------


def test_counts_of_odd_texts(counter, library):
    r = random.Random(3)
    letters = [*" \n\t  aabc'stre'll1٣²é日本ñ.,!  　\x1c\x85ⅷABZ", "\U0001f600", "<|endoftext|>", " <|endoftext|> ", "   "]
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(5000)]
    assert counter.counts(texts).tolist() == library(texts)


def test_counts_of_every_plane(counter, library):
    texts = [f"a{c}1{c} {c}  {c}b {c}{c}" for c in map(chr, range(1, 0x30000, 7)) if not "\ud800" <= c <= "\udfff"]
    assert counter.counts(texts).tolist() == library(texts)


def test_long_sequences_merge_as_short_ones(counter, library):
    """Places listed by rank give what looking at all symbols gives."""
    r = random.Random(4)
    texts = ["".join(r.choice("abcdefghij") for _ in range(6000)), "a" * 9001, "ab" * 4000, " " * 7000, "日本" * 2000, "é" * 3001]
    want = library(texts)
    assert counter.counts(texts).tolist() == want
    symbols = [counter.merges.of_byte[np.frombuffer(t.encode(), np.uint8)] for t in texts]
    whole = counter.merges._ragged(np.concatenate(symbols), np.array([len(s) for s in symbols]))
    assert whole.tolist() == want == [counter.merges._listed(s) for s in symbols]


def test_token_counts_of_rows(spark, docs, rows, no_docs, path, library):
    want = sorted(
        ((r[0], len((r[1] or "").encode()), n) for r, n in zip(rows, library([r[1] or "" for r in rows]))), key=repr
    )
    found = op11_tokens.token_counts(docs, path)
    assert sorted_rows(found, "id", "n_bytes", "n_tokens") == want
    assert op11_tokens.token_counts(no_docs, path).count() == 0


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        op11_tokens.Counter(public_tokenizers.path("word_bpe_49k.json"))


def test_op11(spark, data, library):
    documents = spark.read.parquet(f"{data}/documents.parquet").collect()
    tokens = library([r.text or "" for r in documents])
    want = sorted(((r.doc_id, len((r.text or "").encode()), n, n > 1024) for r, n in zip(documents, tokens)), key=repr)
    assert sorted_rows(op11_tokens.op11_tokens(spark, data), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


# -- ranked search ----------------------------------------------------------


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def ranked(documents, items, best):
    """Rows (item, rank, id, score) of whole lists of (id, text) and (item, text)."""
    counted = [(key, Counter(terms(text))) for key, text in documents]
    counted = [(key, own) for key, own in counted if own]
    total, length = len(counted), sum(sum(own.values()) for _, own in counted)
    df = Counter(t for _, own in counted for t in own)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for key, own in counted:
            m = 50 + (50 * sum(own.values()) * total) // length
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * own[t]) // (1000 * own[t] + 20 * m))
                for t in wanted if t in own
            )
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        out += [(item, rank + 1, key, -score) for rank, (score, _, _, key) in enumerate(sorted(scores, key=lambda s: s[:3])[:best])]
    return sorted(out, key=repr)


ITEMS = [
    ("a", "w1 w2 w3 W4 w5"), ("b", "tail, é ñ!"), ("c", None), ("d", "..."), ("e", "unheard-of words"), (None, "w7 w8"),
    ("a", "w9"), ("a", "w9"), ("f", " ".join(f"w{i}" for i in range(0, 400, 3))),
]


@pytest.fixture
def items(spark):
    schema = "item_id string, text string, id string, term string, score string, rank string"
    return spark.createDataFrame([(*row, "x", "y", "z", "r") for row in ITEMS], schema)


@pytest.mark.parametrize("best,slice_terms,part,hits", [(3, 10**6, 1 << 14, 1 << 20), (200, 100, 200, 1)])
def test_search(docs, rows, items, monkeypatch, best, slice_terms, part, hits):
    """Nulls, ties, copies and repeated rows; many slices, parts and runs of items change nothing."""
    monkeypatch.setattr(op12_search, "PART_POSTINGS", part)
    monkeypatch.setattr(op12_search, "SHARD_POSTINGS", 10 * part)
    monkeypatch.setattr(op12_search, "HITS", hits)
    found = op12_search.search(docs, items, best, slice_terms=slice_terms)
    assert sorted_rows(found, "item_id", "rank", "id", "score") == ranked([r[:2] for r in rows], ITEMS, best)


def test_search_of_a_hot_stratum(spark, monkeypatch):
    """Equal texts share a stratum and a score: the smallest ids win, nulls come last."""
    monkeypatch.setattr(op12_search, "PART_POSTINGS", 16)
    documents = [(i if i % 3 else None, "same words here") for i in range(300)] + [(i, f"other {i}") for i in range(300, 400)]
    docs = spark.createDataFrame(documents, "doc_id long, text string").repartition(5)
    asked = [(7, "same"), (8, "other 350")]
    items = spark.createDataFrame(asked, "item_id long, text string")
    for best in (50, 250):
        found = op12_search.search(docs, items, best)
        assert sorted_rows(found, "item_id", "rank", "id", "score") == ranked(documents, asked, best)


def test_search_of_empty_tables(spark, docs, no_docs, items):
    none = spark.createDataFrame([], "item_id int, text string")
    assert op12_search.search(no_docs, items).count() == 0
    assert op12_search.search(docs, none).count() == 0
    blank = docs.withColumn("text", F.lit(" . "))
    assert op12_search.search(blank, items).count() == 0
    assert op12_search.search(docs, spark.createDataFrame([(1, "nowhere")], "item_id int, text string")).count() == 0


def test_bounds_hold(spark, docs, items):
    """No score of a stratum exceeds its bound."""
    index = [
        {"m": 60, "ids": [1, 2, 3], "terms": np.array([0, 0, 2], "<u4").tobytes(), "tfs": bytes([1, 4, 2]),
         "ends": np.array([1, 2, 4], "<u4").tobytes(), "places": bytes([0, 1, 1, 2])}
    ]

    class Items:
        ids, terms, term, owner, starts = [7, 8], 3, np.array([0, 2, 1]), np.array([0, 0, 1]), np.array([0, 2])

    stratum = op12_search.Stratum(index[0], np.array([1000, 5, 300]))
    impact = lambda tf: 10**9 * tf // (1000 * tf + 1200)
    assert stratum.bounds(Items).tolist() == [1000 * impact(4) + 300 * impact(2), 0]
    (item, place, score), = stratum.scores(Items, np.array([0, 1]), np.zeros(2, np.int64))
    assert list(zip(item.tolist(), place.tolist(), score.tolist())) == [
        (0, 0, 1000 * impact(1)), (0, 1, 1000 * impact(4) + 300 * impact(2)), (0, 2, 300 * impact(2)),
    ]


# -- spelling variants ------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def groups(documents, divisor=31, letters=7, uses=2, lead=10):
    total = Counter()
    for key, text in documents:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            check = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if check % divisor == 0:
                run = run[: check % len(run)] + run[check % len(run) + 1 :]
            if len(run) >= letters:
                total[run] += 1
    total = {w: n for w, n in total.items() if n >= uses}
    near = {w: [x for x in total if one_edit(w, x)] for w in total}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-total[x], x), default=None)
        if best is not None and total[best] >= lead * total[w]:
            form[w] = best
    out = []
    for w, n in total.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), total[form[w]] if w in form else None))
    return sorted(out, key=repr)


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def spelled(seed, n, alphabet="abÉÿ", size=(6, 9)):
    """Words over few letters, of steep frequency, so that many are near and forms chain."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice(alphabet) for _ in range(r.randint(*size))) for _ in range(300)]
    pick = lambda: vocabulary[int(300 * r.random() ** 4)]
    rows = [(i, " ".join(pick().title() if r.random() < 0.1 else pick() for _ in range(r.randrange(60)))) for i in range(n)]
    return [*rows, (None, rows[0][1]), (3, rows[3][1]), (n, None), (n + 1, ""), (n + 2, "÷×日本aaaaaaa"), (n + 3, "b" * 3000 + " " + "b" * 3000)]


@pytest.mark.parametrize("part,block", [(1 << 14, 1 << 14), (20, 60)])
def test_spelling_groups(spark, monkeypatch, part, block):
    monkeypatch.setattr(op13_spellings, "PART", part)
    monkeypatch.setattr(op13_spellings, "BLOCK_LETTERS", block)
    monkeypatch.setattr(op13_spellings, "SHARD_LETTERS", 100 * block)
    monkeypatch.setattr(op13_spellings.near_words, "__defaults__", (part,))
    rows = [(*row, "w", "n", "f") for row in spelled(1, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n string, form string").repartition(3)
    want = groups([r[:2] for r in rows], letters=6, lead=3)
    found = op13_spellings.spelling_groups(docs, letters=6, lead=3)
    assert sorted_rows(found, *COLUMNS) == want
    chained = [w for w in want if w[1] is not None and w[1] != w[2]]
    assert chained and max(w[4] for w in want) >= 5


def test_short_words_have_near_words_too(spark):
    """Words of one and two letters: no length is too short for the buckets."""
    texts = ["a b ab ba abc", "a a b ab ab", "abc ba c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = op13_spellings.spelling_groups(docs, letters=1, uses=1, lead=2, divisor=10**9)
    assert sorted_rows(found, *COLUMNS[:1], *COLUMNS[3:5]) == sorted(
        (w[0], w[3], w[4]) for w in groups(list(enumerate(texts)), 10**9, 1, 1, 2)
    )


def test_spellings_of_given_rows(docs, rows, no_docs):
    assert sorted_rows(op13_spellings.spelling_groups(docs, letters=3), *COLUMNS) == groups([r[:2] for r in rows], letters=3)
    assert op13_spellings.spelling_groups(no_docs).count() == 0


def test_op13(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    found = op13_spellings.op13_spellings(spark, data)
    assert found.columns == COLUMNS
    total = {w[0]: w for w in map(tuple, found.collect())}
    by_hole = defaultdict(set)
    for word in total:
        for at in range(len(word) + 1):
            by_hole[word[:at] + "*" + word[at + 1 :]].add(word)
            by_hole[word[:at] + "*" + word[at:]].add(word)
    # words with a common pattern are at most one edit apart, or share a place where each lacks a letter
    for word, row in total.items():
        others = {x for at in range(len(word) + 1) for p in (word[:at] + "*" + word[at + 1 :], word[:at] + "*" + word[at:]) for x in by_hole[p]}
        assert row[4] == sum(one_edit(word, x) for x in others)
    counted = Counter()
    for key, text in documents:
        for run in re.findall("[A-Za-zÀ-ÿ]{7,}", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            check = zlib.crc32(f"{key}:{run}".encode())
            kept = run if check % 31 else run[: check % len(run)] + run[check % len(run) + 1 :]
            counted[kept] += len(kept) >= 7
    assert {w: row[3] for w, row in total.items()} == {w: n for w, n in counted.items() if n >= 2}


def test_a_very_long_text(spark, counter, library, path):
    r = random.Random(11)
    text = " ".join(words(r, 200_000, 90_000)) + " " + "x" * 200_000
    docs = spark.createDataFrame([(1, text, None, None, 0, "c", "i", "k", "s"), (2, "w1 xyzxyzx xyzxyzx", None, None, 0, "c", "i", "k", "s")], SCHEMA)
    found = {x.id: x.n_tokens for x in op11_tokens.token_counts(docs, path).collect()}
    assert [found[1], found[2]] == library([text, "w1 xyzxyzx xyzxyzx"])
    items = [(1, "w1 w17"), (2, text)]
    hits = op12_search.search(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted_rows(hits, "item_id", "rank", "id", "score") == ranked([(1, text), (2, "w1 xyzxyzx xyzxyzx")], items, 50)
    assert sorted_rows(op13_spellings.spelling_groups(docs, uses=1), "word") == sorted(
        (w[0],) for w in groups([(1, text), (2, "w1 xyzxyzx xyzxyzx")], uses=1)
    )
