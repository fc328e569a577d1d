"""Token ids as length-delimited binary records with a separate offset index.

A file is a run of records: the payload's length (8 bytes), the masked checksum of those 8 bytes (4), the payload, the masked
checksum of the payload (4), all little-endian. The checksum is CRC-32, rotated by 15 bits and shifted by a constant, so that
records which hold checksums themselves stay apart from their own. A payload is a flag byte (1: no id, 2: ids of 4 bytes instead
of 2), the document id (8), the number of ids (4) and the ids. The index, a Parquet table beside the files, has a row for each
record: file, place, length, ids, ids before it in the file. Whoever wants documents in any order reads the index, shuffles its
rows and fetches those records alone.

Documents are dealt out by ranges of doc_id, a file for each range. A task writes under a name of its own and renames the
complete file, so a repeated or lost task leaves nothing half-written; its rows reach the index by Spark's own commit.
NULL or empty text: only the end id. NULL doc_id: sorted first, flagged, read back as NULL. Repeated rows: a record each, in order
of text. An empty table: an empty index. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .shared import scratch
from .tokens import encoder

# Fixed value: the constant added to rotated checksums of record files.
MASK = 0xA282EAD8
HEAD = "<BqI"
BLOCK = 8 << 20
INDEX = "file string, doc_id long, place long, length long, n_tokens long, before long"
READ = "doc_id long, start long, n_tokens long, ids binary"
SUMS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(record: bytes) -> bytes:
    """The payload of one record; ValueError where a length or checksum does not fit."""
    length, payload = record[:8], record[12:-4]
    if len(record) < 16 or struct.unpack("<Q", length)[0] != len(payload):
        raise ValueError("record of another length")
    if struct.unpack("<I", record[8:12])[0] != masked(length) or struct.unpack("<I", record[-4:])[0] != masked(payload):
        raise ValueError("checksum does not fit")
    return payload


def serialize(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return struct.pack(HEAD, (doc_id is None) + 2 * wide, doc_id or 0, len(ids)) + ids.astype("<u4" if wide else "<u2").tobytes()


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id, n = struct.unpack_from(HEAD, payload)
    ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=struct.calcsize(HEAD))
    if len(ids) != n:
        raise ValueError("record holds another number of ids")
    return None if flags & 1 else doc_id, ids.astype("<u4")


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Writes the files of a table (doc_id, text) and their index below a folder; returns the index."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task = TaskContext.get()
        name = f"ids-{task.partitionId():06d}.bin"
        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        draft = f"{path}/_draft-{task.partitionId()}-{task.taskAttemptId()}"
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        place = before = 0
        with files.open_output_stream(draft) as out:
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = np.frombuffer(enc.encode(text.as_py()) + end, "<u4")
                    record = frame(serialize(doc_id, ids))
                    out.write(record)
                    rows.append((name, doc_id, place, len(record), len(ids), before))
                    place += len(record)
                    before += len(ids)
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), *[pa.int64()] * 5])], names=["file", "doc_id", "place", "length", "n_tokens", "before"])
        files.move(draft, f"{path}/{name}")

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(records, INDEX).write.parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def read(index: DataFrame, folder: str, sums: bool = False) -> DataFrame:
    """The documents of an index (all of it or some rows, in any order) with their ids and the number of ids before them.

    With ``sums`` the checksum of the ids stands for them, taken where they are read. Rows meet by file and are read in the order of the file, so that neighbouring records come in one request.
    """
    sizes = index.sparkSession.read.schema(INDEX).parquet(f"{folder}/index").groupBy("file").agg({"n_tokens": "sum"}).toDF("file", "n").collect()  # one row per file
    first, total = {}, 0
    for row in sorted(sizes):
        first[row["file"]] = total
        total += row["n"]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(folder)
        name, source = None, None

        def runs(rows):
            run: list = []
            for row in rows:
                if run and (row["file"] != run[0]["file"] or row["place"] != run[-1]["place"] + run[-1]["length"] or row["place"] + row["length"] - run[0]["place"] > BLOCK):
                    yield run
                    run = []
                run.append(row)
            if run:
                yield run

        for batch in batches:
            for run in runs(batch.to_pylist()):
                if run[0]["file"] != name:
                    if source is not None:
                        source.close()
                    name = run[0]["file"]
                    source = files.open_input_file(f"{path}/{name}")
                data = source.read_at(run[-1]["place"] + run[-1]["length"] - run[0]["place"], run[0]["place"])
                out = []
                for row in run:
                    at = row["place"] - run[0]["place"]
                    doc_id, ids = parse(unframe(data[at : at + row["length"]]))
                    if len(ids) != row["n_tokens"] or doc_id != row["doc_id"]:
                        raise ValueError(f"index and {name} do not belong together")
                    out.append((doc_id, first[name] + row["before"], len(ids), zlib.crc32(ids) if sums else ids.tobytes()))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.int64(), pa.int64() if sums else pa.binary()])], names=["doc_id", "start", "n_tokens", "ids_crc32" if sums else "ids"])
        if source is not None:
            source.close()

    return index.repartition("file").sortWithinPartitions("file", "place").mapInArrow(fetch, SUMS if sums else READ)


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written, and read back through the index."""
    import public_tokenizers

    folder = scratch(spark)
    index = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("word_bpe_49k.json"), 2)
    return read(index, folder, sums=True)


QUERIES = {"op4_token_records": op4_token_records}
