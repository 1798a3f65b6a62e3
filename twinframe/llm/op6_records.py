"""Token ids as length-delimited binary records with an offset index.

A data file is a run of records, each framed as

    length     unsigned 64-bit, little-endian: bytes of the payload
    check      unsigned 32-bit: masked CRC-32 of the length's 8 bytes
    payload    a byte 1 (0: the id is null), a byte for the width of an id in bytes, the document id (signed
               64-bit), then the ids as unsigned numbers of that width: 2 bytes if the vocabulary allows, else 4
    check      unsigned 32-bit: masked CRC-32 of the payload

and the file beside it, ``.index``, holds for every record its offset and its
number of ids (two unsigned 64-bit), so that shuffled reads need no scan. The
mask turns a check right by 15 bits and adds a constant, so that a check over
data that holds checks is not weak.

Files are written in ascending id order: rows are range-partitioned by id, one
file per partition. A task writes under a name of its own and moves it into
place, so a repeated task leaves one file. All access goes through
``pyarrow.fs``, which opens local, HDFS and object stores by the folder's URI.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from twinframe.llm.tables import table
from twinframe.llm.text import worker_cache
from twinframe.session import materialize, shared_folder

END = 2
#: Fixed constant of the published record format.
MASK_DELTA = 0xA282EAD8
HEAD = "<QI"
IDENTITY = "<BBq"
#: Text that one file holds on average.
FILE_BYTES = 32 << 20
#: Pieces, and words, whose ids a worker remembers.
REMEMBERED = 400_000
FILES = "part int, data string, n_records long, n_ids long"
RECORDS = "part int, place long, id long, n_tokens long, crc long"


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


class Remembered(dict):
    """A dictionary that computes what it lacks, and keeps it while there is room."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) < REMEMBERED:
            self[key] = value
        return value


class Encoder:
    """Whole texts to ids by the tokenizers library, remembering pieces between spaces and their words.

    A byte-level vocabulary with the usual word pattern never joins what stands
    before a space and what follows it, if the space is followed by no other
    white space; so the pieces of such texts may be encoded apart. In pieces of
    Latin letters the word pattern is applied here and only new words go to the
    library's model. Other pieces, texts and tokenizers go to the library whole.
    """

    def __init__(self, path: str):
        import json
        import os

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        with open(path) as file:
            spec = json.load(file)
        before = spec.get("pre_tokenizer") or {}
        self.apart = (
            spec["model"]["type"] == "BPE" and not spec["model"].get("ignore_merges")
            and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
            and not spec.get("normalizer")
            and not any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in spec.get("added_tokens", []))
        )
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.blank = regex.compile(r" (?:\s|\Z)")
        # fixed: the published word pattern of byte-level vocabularies
        self.pattern = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
            r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
        )
        # printable bytes stand for themselves, the others for characters from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        others = [b for b in range(256) if b not in plain]
        self.shown = {b: chr(256 + i) for i, b in enumerate(others)}
        self.words = Remembered(self._word)
        self.pieces = Remembered(self._piece)

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _word(self, word: str) -> bytes:
        shown = word.encode().decode("latin-1").translate(self.shown)
        return self._packed([token.id for token in self.model.tokenize(shown)])

    def _piece(self, piece: str) -> bytes:
        if max(piece, default="") < "\u0250":
            return b"".join([self.words[w] for w in self.pattern.findall(piece)])
        return self._packed(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian numbers of ``kind``, without the end id."""
        if not self.apart or self.blank.search(text) or any(s in text for s in self.special):
            return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        first, *rest = text.split(" ")
        pieces = self.pieces
        return pieces[first] + b"".join([pieces[" " + p] for p in rest])


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_records(
    docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Encode and write; returns one row per file: (part, data, n_records, n_ids).

    Rows are in ascending order of (id, hash of the text), a null id first. Null
    text is empty; every record ends with ``end_id``. ``folder`` is a URI that
    driver and executors share. Other columns are not read. An empty table
    leaves no file.
    """
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.xxhash64(text_col).alias("tie"),
    )
    ordered = rows.repartitionByRange(int(total // file_bytes) + 1, "id", "tie").sortWithinPartitions("id", "tie")
    def write(batches):
        part = TaskContext.get().partitionId()
        system, base = _open(folder)
        encoder = worker_cache("encoder:" + tokenizer, lambda: Encoder(tokenizer))
        end = np.array([end_id], encoder.kind).tobytes()
        width = len(end)
        name = f"{base}/part-{part:08d}"
        temporary = f"{name}.{uuid.uuid4().hex}.tmp"
        offset = n_records = n_ids = 0
        data = index = None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for low in range(0, len(ids), 256):
                encoded = [encoder.encode(t) for t in texts.slice(low, 256).to_pylist()]
                out, entries = [], []
                for id_, tokens in zip(ids[low : low + 256], encoded):
                    payload = struct.pack(IDENTITY, id_ is not None, width, id_ or 0) + tokens + end
                    length = struct.pack("<Q", len(payload))
                    record = struct.pack(HEAD, len(payload), masked(zlib.crc32(length))) + payload
                    record += struct.pack("<I", masked(zlib.crc32(payload)))
                    out.append(record)
                    entries.append(struct.pack("<QQ", offset, len(tokens) // width + 1))
                    offset += len(record)
                    n_ids += len(tokens) // width + 1
                if data is None:
                    system.create_dir(base, recursive=True)
                    data, index = (system.open_output_stream(temporary + x) for x in ("", ".index"))
                data.write(b"".join(out)), index.write(b"".join(entries))
                n_records += len(entries)
        if data is not None:
            data.close(), index.close()
            system.move(temporary + ".index", name + ".index")
            system.move(temporary, name + ".records")
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([name + ".records"]), pa.array([n_records]), pa.array([n_ids])],
                names=["part", "data", "n_records", "n_ids"],
            )

    return materialize(ordered.select("id", "text").mapInArrow(write, FILES))


def read_records(files: DataFrame, folder: str) -> DataFrame:
    """(part, place, id, n_tokens, crc) of every record of ``files``, found through the index, both checks verified."""

    def read(batches):
        system, _ = _open(folder)
        for batch in batches:
            for part, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_file(name.removesuffix(".records") + ".index") as file:
                    index = np.frombuffer(file.read(), "<u8").reshape(-1, 2)
                with system.open_input_stream(name, buffer_size=1 << 20) as file:
                    rows = []
                    for place in range(len(index)):
                        rows.append((place, *_record(file, name, int(index[place, 1]))))
                        if len(rows) == 4096 or place + 1 == len(index):
                            place_, id_, n, crc = zip(*rows)
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array([part] * len(rows), pa.int32()), pa.array(place_, pa.int64()),
                                    pa.array(id_, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()),
                                ],
                                names=["part", "place", "id", "n_tokens", "crc"],
                            )
                            rows = []

    spread = files.select("part", "data").repartition(max(1, files.count()), "part")
    return spread.mapInArrow(read, RECORDS)


def _record(file, name: str, n_ids: int):
    head = file.read(struct.calcsize(HEAD))
    length, check = struct.unpack(HEAD, head)
    if masked(zlib.crc32(head[:8])) != check:
        raise ValueError(f"{name}: a record's length is damaged")
    payload = file.read(length)
    if masked(zlib.crc32(payload)) != struct.unpack("<I", file.read(4))[0]:
        raise ValueError(f"{name}: a record is damaged")
    id_, ids = _payload(payload)
    if len(ids) != n_ids:
        raise ValueError(f"{name}: the index and a record differ")
    return id_, n_ids, zlib.crc32(ids.astype("<u4").tobytes())


def _payload(payload: bytes) -> tuple[int | None, np.ndarray]:
    known, width, id_ = struct.unpack_from(IDENTITY, payload)
    return id_ if known else None, np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(IDENTITY))


def fetch(folder: str, data: str, places: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """(id, ids) of chosen records of one file, by their offsets; a shuffled read."""
    system, _ = _open(folder)
    with system.open_input_file(data.removesuffix(".records") + ".index") as file:
        index = np.frombuffer(file.read(), "<u8").reshape(-1, 2)
    found = []
    with system.open_input_file(data) as file:
        for place in places:
            file.seek(int(index[place, 0]))
            length, _ = struct.unpack(HEAD, file.read(struct.calcsize(HEAD)))
            payload = file.read(length)
            if masked(zlib.crc32(payload)) != struct.unpack("<I", file.read(4))[0]:
                raise ValueError(f"{data}: record {place} is damaged")
            found.append(_payload(payload))
    return found


def with_starts(records: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``start``: ids of all records before, over all files; one row per file is summed in one task."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = files.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return (
        records.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(ahead, "part")
        .withColumn("start", F.col("ahead") + F.col("inside"))
        .drop("ahead", "inside")
    )


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder, as a URI, under the one that driver and executors share."""
    base = shared_folder(spark)
    if "://" not in base:
        base = "file://" + base.removeprefix("file:")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as records into the shared folder and read them back: (doc_id, start, n_tokens, ids_crc32)."""
    folder = new_folder(docs.sparkSession, "records")
    files = write_records(docs, folder, tokenizer, id_col, text_col)
    return with_starts(read_records(files, folder), files).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", F.col("crc").alias("ids_crc32")
    )


def op6_records(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
