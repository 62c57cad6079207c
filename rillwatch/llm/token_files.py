"""Token ids in files: fixed-width bit packing, blocks, random access.

A file holds, in this order: the mark ``TOKBITS1``; blocks of ``BLOCK`` ids (the last may be shorter), each id in the fewest
bits that the vocabulary needs, lowest bit first, each block starting at a byte; the byte offset of every block; doc_id,
null flag and first id of every document, and the number of ids; a JSON header and its length (8 bytes); the mark again.
Eight ids fill as many bytes as an id has bits, so packing and unpacking are a few shifts over whole columns of bytes, and
any document is read from the blocks that hold it.

The table is range-partitioned by doc_id; each task writes one file under a name of its own attempt, and the list of the
files whose tasks ended well is the dataset. A retried task leaves at most an unlisted file.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..core import pin, work_path
from .common import slices, two_columns
from .tokens import encoder

MARK = b"TOKBITS1"
BLOCK = 1 << 16
END_ID = 2
#: Documents of a file that are read at a time.
READ_AT_A_TIME = 10_000


def bits_for(vocabulary: int) -> int:
    """The fewest bits that tell ``vocabulary`` ids apart."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids (unsigned 32-bit) to ceil(n * bits / 8) bytes."""
    n = len(ids)
    eight = np.zeros(-(-n // 8) * 8, dtype=np.uint64)
    eight[:n] = ids
    eight = eight.reshape(-1, 8)
    out = np.zeros((len(eight), bits), dtype=np.uint8)
    for j in range(8):
        first, shift = divmod(j * bits, 8)
        value = eight[:, j] << np.uint64(shift)
        for k in range(-(-(shift + bits) // 8)):
            out[:, first + k] |= (value >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()[:-(-n * bits // 8)]


def unpack_bits(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of ``data``."""
    rows = -(-n // 8)
    raw = np.zeros(rows * bits, dtype=np.uint8)
    raw[:len(data)] = np.frombuffer(data, dtype=np.uint8)[:len(raw)]
    raw = raw.reshape(rows, bits)
    out = np.empty((rows, 8), dtype="<u4")
    for j in range(8):
        first, shift = divmod(j * bits, 8)
        value = np.zeros(rows, dtype=np.uint64)
        for k in range(-(-(shift + bits) // 8)):
            value |= raw[:, first + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, j] = ((value >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype("<u4")
    return out.reshape(-1)[:n]


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class TokenFileWriter:
    """Writes documents one after another; holds one block in memory."""

    def __init__(self, path: str, bits: int, block: int = BLOCK):
        store, self.place = _store(path)
        store.create_dir(self.place.rsplit("/", 1)[0], recursive=True)
        self.out, self.bits, self.block = store.open_output_stream(self.place), bits, block
        self.out.write(MARK)
        self.docs, self.starts, self.blocks, self.held, self.waiting, self.n, self.at = [], [], [], [], 0, 0, len(MARK)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.n)
        self.n += len(ids)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            self._flush(self.waiting - self.waiting % self.block)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, dtype="<u4")
        for i in range(0, n, self.block):
            data = pack_bits(ids[i:min(i + self.block, n)], self.bits)
            self.blocks.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.held, self.waiting = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.waiting)
        head = json.dumps({"bits": self.bits, "block": self.block, "docs": len(self.docs), "ids": self.n,
                           "blocks": len(self.blocks), "index": self.at}).encode()
        self.out.write(np.array(self.blocks, dtype="<i8").tobytes())
        self.out.write(np.array([d or 0 for d in self.docs], dtype="<i8").tobytes())
        self.out.write(np.array([d is None for d in self.docs], dtype=np.uint8).tobytes())
        self.out.write(np.array([*self.starts, self.n], dtype="<i8").tobytes())
        self.out.write(head + len(head).to_bytes(8, "little") + MARK)
        self.out.close()


class TokenFile:
    """Random access to one file: ``ids(i)`` reads the blocks of the i-th document alone."""

    def __init__(self, path: str):
        store, place = _store(path)
        self.source = store.open_input_file(place)
        size = self.source.size()
        tail = self._read(size - 16, 16)
        if tail[8:] != MARK:
            raise ValueError(f"{path} is no token file, or it is cut off")
        length = int.from_bytes(tail[:8], "little")
        head = json.loads(self._read(size - 16 - length, length))
        self.bits, self.block, self.n, n_docs = head["bits"], head["block"], head["ids"], head["docs"]
        index = self._read(head["index"], 8 * head["blocks"] + 9 * n_docs + 8 * (n_docs + 1))
        self.blocks = np.frombuffer(index, dtype="<i8", count=head["blocks"])
        docs = np.frombuffer(index, dtype="<i8", count=n_docs, offset=8 * head["blocks"])
        nulls = np.frombuffer(index, dtype=np.uint8, count=n_docs, offset=8 * (head["blocks"] + n_docs))
        self.doc_ids = [None if z else int(d) for d, z in zip(docs, nulls)]
        self.starts = np.frombuffer(index, dtype="<i8", offset=8 * head["blocks"] + 9 * n_docs)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def span(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of the file, from the blocks that hold them."""
        if stop <= start:
            return np.empty(0, dtype="<u4")
        first, last = start // self.block, (stop - 1) // self.block
        found = []
        for b in range(first, last + 1):
            n = min(self.block, self.n - b * self.block)
            found.append(unpack_bits(self._read(int(self.blocks[b]), -(-n * self.bits // 8)), n, self.bits))
        return np.concatenate(found)[start - first * self.block:stop - first * self.block]

    def ids(self, i: int) -> np.ndarray:
        return self.span(int(self.starts[i]), int(self.starts[i + 1]))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of every document, each block unpacked once; about a block and a document in memory."""
        held, at, b = np.empty(0, dtype="<u4"), 0, 0
        for i, doc_id in enumerate(self.doc_ids):
            start, stop = int(self.starts[i]), int(self.starts[i + 1])
            parts = [held[start - at:]]
            have = at + len(held)
            while have < stop:
                n = min(self.block, self.n - b * self.block)
                held, at, b = unpack_bits(self._read(int(self.blocks[b]), -(-n * self.bits // 8)), n, self.bits), have, b + 1
                parts.append(held)
                have += n
            yield doc_id, start, np.concatenate(parts)[:stop - start]
            held, at = held[max(0, stop - at):], max(at, stop)

    def close(self) -> None:
        self.source.close()


def write_token_files(df: DataFrame, tokenizer_path: str, folder: str, vocabulary: int, end_id: int = END_ID,
                      id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Write ``folder/*.tok`` and return the list of files: part, path, n_docs, n_ids, base (ids in all files before it).

    Documents are in ascending doc_id order, null ids first, ties in no fixed order. Null text counts as empty: it has the
    end id alone. An empty table gives an empty list.
    """
    bits = bits_for(vocabulary)
    end = np.array([end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, path = TaskContext.get().partitionId(), None, f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.tok"
        ids_of = encoder(tokenizer_path).encode
        for batch in (part for whole in batches for part in slices(whole)):
            writer = writer or TokenFileWriter(path, bits, block)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                writer.add(doc_id, np.concatenate([np.frombuffer(ids_of(text), dtype="<u4"), end]))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([len(writer.docs)], pa.int64()),
                                              pa.array([writer.n], pa.int64())], ["part", "path", "n_docs", "n_ids"])

    rows = two_columns(df, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    files = pin(rows.mapInArrow(run, "part int, path string, n_docs long, n_ids long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one short row per file
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document of the listed files, each read by a task of its own: doc_id, start (over all files), n_tokens, ids_crc32, and its ids' file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                source = TokenFile(path)
                found = ((d, base + s, len(ids), zlib.crc32(ids.tobytes())) for d, s, ids in source.documents())
                while rows := list(islice(found, READ_AT_A_TIME)):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                source.close()

    spread = files.select("path", "base").repartition(max(1, files.count()))  # a task for each file; the list is one row a file
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files_folder(spark: SparkSession) -> str:
    """A fresh folder that all executors share."""
    path = work_path(spark, "token-files")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
