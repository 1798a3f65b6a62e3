"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of many texts lie in one numpy array of symbols with the length
of each sequence beside it. In every round each sequence looks up the lowest
merge rank among its neighbouring pairs and all sequences apply their own
lowest pair at once, at all its places, left ones first where places overlap.
A sequence without a mergeable pair leaves the arrays; the symbols it still has
are its tokens. A merge ranks after the merges its parts come from (checked
when the file is read), so a round never makes a pair that ranks lower than the
one it applied, and the order of the library's own queue is kept.

Sequences of many symbols list the places of each rank instead of looking at
all symbols again in every round; the order of merges is the same.
"""

from __future__ import annotations

import heapq
import json
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from twinframe.llm.tables import table
from twinframe.llm.text import worker_cache

LIMIT = 1024
#: Characters of text whose pre-tokens are held at once; one longer text is held alone.
BATCH_CHARS = 1 << 21
#: Symbols of one sequence beyond which its places are listed by rank.
LONG = 1 << 11
#: Pieces, and pre-tokens, whose counts a worker remembers before it starts anew.
REMEMBERED = 400_000
NEVER = np.int64(1 << 62)
COUNTS = "id {id}, n_bytes long, n_tokens long"
# fixed: the published word pattern of byte-level vocabularies
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable bytes for themselves, others from 256 on."""
    shown = [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else "" for b in range(256)]
    spare = iter(range(256, 512))
    return [c or chr(next(spare)) for c in shown]


class Merges:
    """Merge ranks of a byte-level BPE file, as sorted pair keys."""

    def __init__(self, spec: dict):
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (
            model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True)
            and not before.get("add_prefix_space") and not spec.get("normalizer") and not model.get("dropout")
            and not any(model.get(k) for k in ("ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))
        )
        if not plain:
            raise ValueError("only byte-level BPE without normalizer, prefixes, suffixes or stripping tokens is counted")
        self.special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        vocab = model["vocab"]
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (
            np.array(ids, np.int64) for ids in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs))
        )
        born = np.full(max(vocab.values()) + 1, -1, np.int64)
        born[made] = np.arange(len(made))
        if len(np.unique(made)) < len(made) or (np.maximum(born[left], born[right]) >= np.arange(len(made))).any():
            raise ValueError("a merge must rank after the merges of its parts")
        self.made, keys = made, left << 32 | right
        self.ranked = np.argsort(keys)
        self.keys = np.append(keys[self.ranked], NEVER)
        self.ranked = np.append(self.ranked, 0)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, ``NEVER`` where there is none."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranked[at], NEVER)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each word; an empty word has none."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros(len(words), np.int64)
        short = np.flatnonzero((sizes > 0) & (sizes <= LONG))
        if len(short):
            joined = b"".join([words[i] for i in short.tolist()])
            out[short] = self._ragged(self.of_byte[np.frombuffer(joined, np.uint8)], sizes[short])
        for i in np.flatnonzero(sizes > LONG).tolist():
            out[i] = self._listed(self.of_byte[np.frombuffer(words[i], np.uint8)])
        return out

    def _ragged(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """All sequences at once; ``rank`` belongs to a symbol and its right neighbour."""
        left_over = sizes.copy()
        owner = np.arange(len(sizes))
        last = np.cumsum(sizes) - 1
        rank = np.full(len(symbols), NEVER)
        rank[:-1] = self.ranks(symbols[:-1], symbols[1:])
        rank[last] = NEVER
        while True:
            first = np.cumsum(sizes) - sizes
            lowest = np.minimum.reduceat(rank, first)
            live = lowest < NEVER
            left_over[owner] = sizes
            if not live.any():
                return left_over
            inside = np.repeat(live, sizes)
            symbols, rank = symbols[inside], rank[inside]
            owner, sizes, lowest = owner[live], sizes[live], lowest[live]
            sequence = np.repeat(np.arange(len(sizes)), sizes)
            at = _without_overlap(np.flatnonzero(rank == lowest[sequence]))
            symbols[at] = self.made[lowest[sequence[at]]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = (np.cumsum(keep) - 1)[at]
            sizes = sizes - np.bincount(sequence[at], minlength=len(sizes))
            symbols, rank = symbols[keep], rank[keep]
            last = np.cumsum(sizes) - 1
            changed = np.concatenate([moved, moved[moved > 0] - 1])
            ends = np.zeros(len(symbols), bool)
            ends[last] = True
            rank[changed[ends[changed]]] = NEVER
            changed = changed[~ends[changed]]
            rank[changed] = self.ranks(symbols[changed], symbols[changed + 1])

    def _listed(self, symbols: np.ndarray) -> int:
        """One long sequence: its places are kept by rank, and neighbours by links."""
        n = len(symbols)
        right, left = np.arange(1, n + 1), np.arange(-1, n)
        rank = np.full(n, NEVER)
        rank[:-1] = self.ranks(symbols[:-1], symbols[1:])
        places: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def file(at: np.ndarray) -> None:
            at = at[rank[at] < NEVER]
            at = at[np.argsort(rank[at], kind="stable")]
            found, begin = np.unique(rank[at], return_index=True)
            for key, part in zip(found.tolist(), np.split(at, begin[1:])):
                if key not in places:
                    heapq.heappush(queue, key)
                    places[key] = []
                places[key].append(part)

        file(np.arange(n))
        while queue:
            lowest = heapq.heappop(queue)
            at = np.unique(np.concatenate(places.pop(lowest)))
            at = at[rank[at] == lowest]
            if not len(at):
                continue
            at = _without_overlap(at, right[at])
            gone = right[at]
            symbols[at] = self.made[lowest]
            rank[gone] = NEVER
            right[at] = right[gone]
            left[right[gone]] = at
            n -= len(at)
            changed = np.unique(np.concatenate([at, left[at][left[at] >= 0]]))
            rank[changed] = NEVER
            paired = changed[right[changed] < len(symbols)]
            rank[paired] = self.ranks(symbols[paired], symbols[right[paired]])
            file(paired)
        return n


def _without_overlap(at: np.ndarray, following: np.ndarray | None = None) -> np.ndarray:
    """Every other place of each run of places that touch, from its first."""
    following = at + 1 if following is None else following
    run = np.ones(len(at), bool)
    run[1:] = at[1:] != following[:-1]
    number = np.arange(len(at))
    begin = np.maximum.accumulate(np.where(run, number, 0))
    return at[(number - begin) % 2 == 0]


class Counter:
    """Token counts of whole texts, remembering pieces between spaces and pre-tokens."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path) as file:
            self.merges = Merges(json.load(file))
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.words_of = regex.compile(PATTERN).findall
        special = "|".join(map(regex.escape, self.merges.special))
        self.special = regex.compile(special) if special else None
        self.pieces: dict[str, int] = {}
        self.known: dict[str, int] = {}

    def _words(self, piece: str) -> list[str]:
        """Pre-tokens of a piece; beyond Latin letters the library's own character classes count."""
        if max(piece) < "ɐ":
            return self.words_of(piece)
        return [piece[a:b] for _, (a, b) in self.split(piece)]

    def _cut(self, text: str) -> list[str]:
        """Pieces of a text that share no pre-token.

        The word pattern joins nothing across a space that is followed by
        something else than white space; the space goes with what follows.
        """
        parts = text.split(" ")
        begin = [0, *(k for k, p in enumerate(parts) if k and p and not p[0].isspace())]
        if len(begin) < len(parts):
            parts = [" ".join(parts[a:b]) for a, b in zip(begin, [*begin[1:], len(parts)])]
        pieces = [" " + p for p in parts]
        pieces[0] = parts[0]
        return pieces if parts[0] else pieces[1:]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        cut = []
        for number, text in enumerate(texts):
            if self.special and any(s in text for s in self.merges.special):
                out[number] = len(self.special.findall(text))
                cut.append([p for segment in self.special.split(text) for p in self._cut(segment)])
            else:
                cut.append(self._cut(text))
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        pieces = self.pieces
        fresh = [p for p in set(chain.from_iterable(cut)) if p not in pieces]
        if fresh:
            words = [self._words(p) for p in fresh]
            if len(self.known) > REMEMBERED:
                self.known.clear()
            known = self.known
            new = [w for w in set(chain.from_iterable(words)) if w not in known]
            known.update(zip(new, self.merges.counts([w.encode() for w in new]).tolist()))
            pieces.update((p, sum([known[w] for w in own])) for p, own in zip(fresh, words))
        look = pieces.__getitem__
        for number, own in enumerate(cut):
            out[number] += sum(map(look, own))
        return out


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) per row of ``docs``, over its whole text.

    Tokens are those the tokenizers library gives for the byte-level BPE file at
    ``path`` without begin, end or added tokens; strings of special tokens
    inside a text are those tokens, as is its default. ``path`` must name the
    file on every worker. Null text counts as empty: no bytes, no tokens. Null
    ids and repeated rows keep a row each, other columns are not read, an empty
    table gives an empty table. Nothing is shuffled.
    """

    def run(batches):
        counter = worker_cache(f"token counter {path}", lambda: Counter(path))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = np.zeros(len(texts), np.int64)
            first = 0
            while first < len(texts):
                end, size = first, 0
                while end < len(texts) and (end == first or size + len(texts[end]) <= BATCH_CHARS):
                    size += len(texts[end])
                    end += 1
                tokens[first:end] = counter.counts(texts[first:end])
                first = end
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(tokens)], names=["id", "n_bytes", "n_tokens"]
            )

    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), n_bytes)
    return rows.mapInArrow(run, COUNTS.format(id=rows.schema["id"].dataType.simpleString()))


def op11_tokens(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    found = token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit")
    )
