"""Token ids as length-delimited binary records, with an offset index.

A record is framed as in TFRecord files: its length (64 bits), the masked CRC-32C
of the length, the serialized sequence, the masked CRC-32C of the sequence, all
little-endian. A sequence is a head of 32-bit numbers below 2^24 (flags; the
document's identifier, the ids before it in its file, the record's place in the
file and its number of ids, in parts of 24 bits) and then the ids, of 16 bits where
they fit and else of 32, filled up to whole words.

Files are written by Spark's text writer, so that only committed attempts of tasks
leave files, on any store that Spark writes to. A row is a block of records of
about ``BLOCK_BYTES``; the line end between rows is a whole record of length
zero, which readers of such files skip, and by which the text reader cuts a file
into blocks again, so no reader holds a file. No block holds that line end: a
record whose 16-bit ids would spell it has 32-bit ids, in which every fourth byte
is zero, while the line end's last eight bytes are not.

Documents are dealt out to files in ranges of their identifiers (ties by a hash of the
text) and sorted, so file after file holds ascending identifiers. The index, a
table written apart, names each record's file, offset and length: a loader reads
any record with one seek, and ``epoch_order`` puts them in a keyed random order.

Defined results: a null text counts as empty and has the end id alone; null
identifiers come last; documents that repeat an identifier follow each other in
the order of their texts' hashes; very long texts are one record each (read and
encoded in blocks); an empty table gives no record; other columns are not read.
A damaged record raises ``ValueError`` with its place.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verity.llm.crc import Crc32c
from verity.llm.ids import ids_of
from verity.llm.pretokens import blocks
from verity.llm.shared import few_rows, noted, partitions, shared_folder, small_batches, written

END_ID = 2
BLOCK_BYTES = 1 << 17
HEAD = 11  # numbers before the ids
HAS_ID, WIDE = 1, 2
# Fixed values of the format: a record of length zero, and its two masked checksums.
EMPTY_RECORD = bytes(8) + (0x07980329).to_bytes(4, "little") + (0xA282EAD8).to_bytes(4, "little")
_TEXT = {"lineSep": EMPTY_RECORD.decode("latin-1"), "encoding": "ISO-8859-1"}
_RECORD = "shard int, doc_id long, shard_start long, n_tokens long, offset long, length long"


def _parts(number: int, n: int) -> list[int]:
    return [(number >> 24 * i) & 0xFFFFFF for i in range(n)]


def _whole(parts: np.ndarray) -> int:
    return sum(int(p) << 24 * i for i, p in enumerate(parts))


class Framer:
    """Records of one file, block after block."""

    def __init__(self) -> None:
        self.crc, self.offset, self.before = Crc32c(), 0, 0
        self.waiting: list[tuple[int | None, np.ndarray]] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.waiting.append((doc_id, ids))
        self.held += 4 * len(ids)

    def block(self) -> bytes:
        framed = self._framed(narrow=True)
        if EMPTY_RECORD in framed:
            framed = self._framed(narrow=False)
        self.offset += len(framed) + len(EMPTY_RECORD)
        self.before += sum(len(ids) for _, ids in self.waiting)
        self.waiting, self.held = [], 0
        return framed

    def _framed(self, narrow: bool) -> bytes:
        offset, before, payloads = self.offset, self.before, []
        for doc_id, ids in self.waiting:
            wide = not narrow or int(ids.max()) > 0xFFFF
            flags = (doc_id is not None) * HAS_ID + wide * WIDE
            head = [flags, *_parts((doc_id or 0) % 2**64, 3), *_parts(before, 3), *_parts(offset, 2), *_parts(len(ids), 2)]
            body = ids.astype("<u4") if wide else np.append(ids, np.zeros(len(ids) % 2, ids.dtype)).astype("<u2").view("<u4")
            payloads.append(np.concatenate([np.array(head, "<u4"), body]))
            offset, before = offset + 16 + 4 * len(payloads[-1]), before + len(ids)
        lengths = np.array([4 * len(p) for p in payloads], "<u8")
        of_lengths, of_payloads = self.crc.masked(list(lengths.view("<u4").reshape(-1, 2))), self.crc.masked(payloads)
        return b"".join(b"".join((n.tobytes(), a.tobytes(), p.tobytes(), b.tobytes()))
                        for n, a, p, b in zip(lengths, of_lengths.astype("<u4"), payloads, of_payloads.astype("<u4")))


def parsed(block: bytes, crc: Crc32c, where: str = "") -> Iterator[tuple[int | None, int, int, int, int, bytes]]:
    """(identifier, ids before it in its file, number of ids, offset, length, ids as 32-bit
    numbers) of each record in the block, its checksums tested."""
    at, found, lengths, sums = 0, [], [], []
    while at < len(block):
        size = int.from_bytes(block[at: at + 8], "little")
        if at + 16 + size > len(block) or size % 4 or size < 4 * HEAD:
            raise ValueError(f"damaged record {where} at byte {at} of a block: length {size}")
        lengths.append(np.frombuffer(block, "<u4", 2, at))
        found.append(np.frombuffer(block, "<u4", size // 4, at + 12))
        sums.append((int.from_bytes(block[at + 8: at + 12], "little"), int.from_bytes(block[at + 12 + size: at + 16 + size], "little")))
        at += 16 + size
    told = zip(crc.masked(lengths).tolist(), crc.masked(found).tolist())
    for payload, held, right in zip(found, sums, told):
        if held != right:
            raise ValueError(f"damaged record {where}: checksum")
        flags, n = int(payload[0]), _whole(payload[9:11])
        doc_id = _whole(payload[1:4])
        ids = payload[HEAD:] if flags & WIDE else payload[HEAD:].view("<u2")[:n].astype("<u4")
        yield ((doc_id - (doc_id >> 63 << 64)) if flags & HAS_ID else None, _whole(payload[4:7]), n, _whole(payload[7:9]), 16 + 4 * len(payload), ids.tobytes())


def _encoded(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, framer, end = ids_of(tokenizer), Framer(), np.array([end_id], np.uint32)
        if len(make.encoder.ends) > 1 << 24:
            raise ValueError("a vocabulary of more than 2^24 ids")

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([framer.block()], pa.binary())], names=["value"])

        for batch in few_rows(batches):
            numbers = batch.column("doc_id").to_pylist()
            open_at, pieces = 0, []
            for owners, parts in blocks(batch.column("text").to_pylist()):
                ids, sizes, _, _ = make(parts)
                for owner, piece in zip(owners, np.split(ids, np.cumsum(sizes)[:-1])):
                    if owner != open_at:
                        framer.add(numbers[open_at], np.concatenate([*pieces, end]))
                        open_at, pieces = owner, []
                        if framer.held > BLOCK_BYTES:
                            yield block()
                    pieces.append(piece)
            if numbers:
                framer.add(numbers[open_at], np.concatenate([*pieces, end]))
        if framer.waiting:
            yield block()
    return run


def write_records(docs: DataFrame, tokenizer: str, folder: str, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID,
                  files: int | None = None) -> None:
    """Writes the ids of ``docs`` as files of records into ``folder``, in
    ascending order of identifiers; ``files`` of them at most."""
    if end_id <= 0:
        raise ValueError("the end id must not be zero")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.crc32(F.coalesce("text", F.lit("")))]
    dealt = rows.repartitionByRange(files or partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    made = dealt.mapInArrow(_encoded(tokenizer, end_id), "value binary").select(F.col("value").cast("string").alias("value"))
    with small_batches(docs.sparkSession):
        made.write.options(**_TEXT).text(folder)


def _read(last: str):
    """Of each block the records, with their ids or the name of their file as last column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc = Crc32c()
        for batch in batches:
            for shard, file, block in zip(batch.column("shard").to_pylist(), batch.column("file").to_pylist(), batch.column("block")):
                found = list(zip(*parsed(block.as_py(), crc, f"in {file}"))) or [()] * 6
                n = len(found[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * n, pa.int32()), *[pa.array(c, pa.int64()) for c in found[:5]],
                     pa.array(found[5], pa.binary()) if last == "ids" else pa.array([file] * n, pa.string())],
                    names=["shard", "doc_id", "shard_start", "n_tokens", "offset", "length", last])
    return run


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    return spark.read.options(**_TEXT).text(folder).select(
        number.alias("shard"), F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("block")).where(F.length("block") > 0)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the files, its checksums tested: ``shard`` (the
    file's number), ``doc_id``, ``shard_start`` (ids before it in its file),
    ``n_tokens``, ``offset``, ``length`` (bytes, frame included) and ``ids``
    (little-endian 32-bit numbers)."""
    return _blocks(spark, folder).mapInArrow(_read("ids"), f"{_RECORD}, ids binary")


def write_index(spark: SparkSession, folder: str, index: str) -> None:
    """Writes the offset index of the records in ``folder``: all columns of
    ``read_records``, with ``file`` (its address) in place of the ids."""
    _blocks(spark, folder).mapInArrow(_read("file"), f"{_RECORD}, file string").write.option("compression", "zstd").parquet(index)


def with_starts(records: DataFrame) -> DataFrame:
    """``records`` with ``start``: the ids of all documents before it. The
    window runs over one row a file."""
    files = records.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return records.join(files.select("shard", F.coalesce(before, F.lit(0)).alias("before")), "shard").withColumn(
        "start", F.col("before") + F.col("shard_start")).drop("before")


def epoch_order(index: DataFrame, seed: int) -> DataFrame:
    """The index in a random order that the seed fixes: sorted by a keyed hash of
    each record's place (a range sort, no task holds the whole)."""
    return index.orderBy(F.xxhash64(F.lit(seed), "shard", "offset"), "shard", "offset")


def records_at(places: DataFrame) -> DataFrame:
    """The records that rows of the index (``file``, ``offset``, ``length``)
    point at, in the order of those rows, each read by one seek."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, opened = Crc32c(), {}
        for batch in few_rows(batches):
            found = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file not in opened:
                    if len(opened) >= 64:
                        opened.pop(next(iter(opened))).close()
                    store, path = pyarrow.fs.FileSystem.from_uri(file)
                    opened[file] = store.open_input_file(path)
                found += [r for r in parsed(opened[file].read_at(length, offset), crc, f"in {file}")]
            ids, _, n, _, _, body = zip(*found) if found else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(body, pa.binary())], names=["doc_id", "n_tokens", "ids"])
    return places.select("file", "offset", "length").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def record_digests(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """Writes ``docs`` as records into the shared folder, reads the files back and
    gives one row per document: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``."""
    folder = noted(f"{shared_folder(docs.sparkSession)}/verity-records-{uuid.uuid4().hex}")
    write_records(docs, tokenizer, folder, text, doc_id, end_id)
    read = read_records(docs.sparkSession, folder).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return with_starts(written(read, "digests")).select("doc_id", "start", "n_tokens", "ids_crc32")
