"""Byte, word, SimHash and vector dedup against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F
from tests.llm.conftest import sorted_rows
from twinframe.llm import op2_suffix, op4_vectors, op8_substring, op10_simhash
from twinframe.llm.components import connected_components
from twinframe.llm.suffixes import sort_suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("chunk_bytes", [3000, 1 << 22])
def test_repeated_bytes(docs, rows, chunk_bytes):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(t[k : k + 200] for _, t in texts for k in range(len(t) - 199))
    want = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want.append((i, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytearray(kept)))
    got = op2_suffix.repeats_removed(docs, chunk_bytes=chunk_bytes)
    assert sorted_rows(got, "id", "n_bytes", "n_removed", F.size("spans"), "kept") == sorted(want, key=repr)


def test_suffixes_sort_by_group_and_bytes():
    random = np.random.default_rng(1)
    data = random.integers(0, 2, 3000).astype(np.uint8)
    starts, group = random.integers(0, 2900, 500), random.integers(0, 5, 500)
    order, same = sort_suffixes(data, starts, group, 12)
    keys = [(g, data[s : s + 12].tobytes()) for g, s in zip(group, starts)]
    assert [keys[i] for i in order] == sorted(keys)
    assert same.tolist() == [False] + [keys[a] == keys[b] for a, b in zip(order, order[1:])]


@pytest.mark.parametrize("chunk_bytes", [3000, 1 << 22])
def test_words_of_earlier_windows(docs, rows, chunk_bytes):
    order = lambda i: float("inf") if i is None else i
    first = {}
    tokens = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    for i, w in sorted(tokens, key=lambda x: order(x[0])):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), order(i))
    want = []
    for i, w in tokens:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < order(i):
                gone[k : k + 13] = [True] * 13
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    got = op8_substring.windows_removed(docs, chunk_bytes=chunk_bytes)
    assert sorted_rows(got, "id", "n_words", "n_removed", "kept") == sorted(want, key=repr)


def _components(n, linked):
    root = list(range(n))
    for a in range(n):
        for b in range(n):
            if linked(a, b):
                low, high = min(root[a], root[b]), max(root[a], root[b])
                root = [low if x == high else x for x in root]
    return root


def test_simhash_groups(docs, rows):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    prints = []
    for r in rows:
        w = [x.encode().translate(lower) for x in WORD.findall(r[1] or "")]
        shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        ones = [0] * 64
        for s in shingles:
            h = xxhash.xxh64_intdigest(s, 42)
            ones = [o + (h >> b & 1) for b, o in enumerate(ones)]
        prints.append(sum(1 << b for b, o in enumerate(ones) if 2 * o > len(shingles)))
    root = _components(len(rows), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 3)
    low = {}
    for r, row in zip(root, rows):
        if row[0] is not None:
            low[r] = min(low.get(r, row[0]), row[0])
    want = [(row[0], p - (1 << 64) if p >> 63 else p, low.get(r)) for row, p, r in zip(rows, prints, root)]
    assert sorted_rows(op10_simhash.simhash_components(docs), "id", "fp", "component") == sorted(want, key=repr)


@pytest.mark.parametrize("group_rows", [4, 4096])
def test_near_fingerprints_lose_no_link(spark, group_rows):
    random = np.random.default_rng(3)
    base = random.integers(0, 1 << 63, 30, dtype=np.int64)
    prints = {int(b) for b in base}
    for b in base[:12]:
        for _ in range(10):
            x = int(b)
            for bit in random.choice(64, random.integers(1, 5), replace=False):
                x ^= 1 << int(bit) if bit < 63 else -(1 << 63)
            prints.add(x)
    prints = sorted(prints)
    links = op10_simhash.fingerprint_links(spark.createDataFrame([(p,) for p in prints], "fp long"), group_rows=group_rows)
    found = {r.node: r.component for r in connected_components(links).collect()}
    root = _components(len(prints), lambda a, b: bin((prints[a] ^ prints[b]) & (1 << 64) - 1).count("1") <= 3)
    assert [found.get(p, p) for p in prints] == [prints[r] for r in root]


@pytest.mark.parametrize("cell,block", [(8, 4), (1024, 1024)])
def test_vectors(spark, monkeypatch, cell, block):
    monkeypatch.setattr(op4_vectors, "CELL_ROWS", cell)
    monkeypatch.setattr(op4_vectors, "BLOCK_ROWS", block)
    random = np.random.default_rng(2)
    base = random.normal(size=(25, 8))
    rows = []
    for i in range(120):
        vector = base[i % 25] + random.normal(size=8) * random.choice([0.0, 0.05, 0.1, 0.3])
        rows.append((i, [float(x) for x in vector], i % 2))
    rows += [(200, rows[3][1], 1), (201, rows[3][1], 1), (202, [0.0] * 8, 1), (203, None, 1), (204, [1.0, None], 1), (205, [], 1)]
    rows += [(206, [float("nan")] * 8, 1), (207, rows[3][1], None), (208, [x * 1e-200 for x in rows[3][1]], 1), (209, [1.0, 2.0], 1)]
    unit = {i: np.array(v) / np.linalg.norm(np.array(v) * 1e100) * 1e100 for i, v, l in rows if l is not None and i not in range(202, 208)}
    label = {i: l for i, _, l in rows}
    near = lambda a, b: a != b and label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] / np.sqrt((unit[a] @ unit[a]) * (unit[b] @ unit[b])) >= 0.98
    ids = list(unit)
    root = _components(len(ids), lambda a, b: near(ids[a], ids[b]))
    want = [(i, sum(near(i, j) for j in ids), ids[r]) for i, r in zip(ids, root)] + [(i, 0, i) for i in range(202, 208)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1))
    assert sorted_rows(op4_vectors.vector_components(table), "id", "n_links", "component") == sorted(want, key=repr)


def test_vectors_of_repeated_and_null_ids(spark):
    """Brute force over rows: links and components belong to vectors, not to their ids."""
    random = np.random.default_rng(5)
    base = random.normal(size=(12, 6))
    rows = []
    for i in range(90):
        vector = base[i % 12] + random.normal(size=6) * random.choice([0.0, 0.05, 0.1, 0.4])
        vec_id = None if i % 3 == 0 else int(random.integers(0, 25))
        rows.append((vec_id, [float(x) for x in vector], i % 2))
    rows += [(5, [1.0] * 6, 1), (2, [1.0] * 6, 1), (5, [1.0] * 6, 2), (9, [1.0] * 6, 2), (None, [7.0, -7.0, 0.0, 0.0, 0.0, 0.0], 9), (None, [7.0, -7.0, 0.0, 0.0, 0.0, 0.0], 9)]
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    near = lambda a, b: a != b and rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= 0.98
    root = _components(len(rows), near)
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    want = [(rows[i][0], sum(near(i, j) for j in range(len(rows))), least[root[i]]) for i in range(len(rows))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    found = sorted_rows(op4_vectors.vector_components(table), "id", "n_links", "component")
    assert found == sorted(want, key=repr)
    assert (9, 1, 5) in found and (2, 1, 2) in found


def test_empty_tables(spark, no_docs):
    assert op2_suffix.repeats_removed(no_docs).count() == 0
    assert op8_substring.windows_removed(no_docs).count() == 0
    assert op10_simhash.simhash_components(no_docs).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert op4_vectors.vector_components(vectors).count() == 0
