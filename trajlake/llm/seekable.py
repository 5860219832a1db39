"""Token ids in files of independent zstandard frames that end in a seek table.

File layout, all integers little-endian:

* one frame for each document, in ascending doc_id order: its ids, 2 or 4 bytes each;
* a skippable frame (magic 0x184D2A5D) with a zstandard frame inside: byte width of
  an id, then for each document 8 bytes of doc_id and 1 byte that is 1 for a null id;
* a skippable frame (magic 0x184D2A5E), the seek table of the public seekable format:
  for each frame before it the compressed size, the decompressed size and the low 32
  bits of the XXH64 of the decompressed bytes; then the number of frames, a flag byte
  (0x80: checksums) and the magic 0x8F92EAB1.

Any zstandard tool decompresses the whole file; :class:`SeekableReader` reads the two
tables from the end and then only the frames asked for.

Nulls: a null text is an empty one, a null doc_id sorts first. Every document has an
end id, so an empty document has a frame too. Repeated rows and ids are kept as they
are; rows with the same id stand in the order of their text. An empty table gives no
files. A long text is one frame. Other columns are ignored.
"""

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajlake.llm.common import ids_and_texts
from trajlake.llm.tokenise import encoder
from trajlake.session import fresh_path

DIRECTORY_MAGIC = 0x184D2A5D
SEEK_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
# The text writer ends each row with its line separator: the footer's last four bytes.
FOOTER_END = struct.pack("<I", FOOTER_MAGIC).decode("latin-1")

FILE_IDS = 4_000_000  # ids after which a file is closed
FILE_BYTES = 64 << 20  # text bytes of documents that one task writes, about


def _checksum(payload: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(payload) & 0xFFFFFFFF


class SeekableWriter:
    """Builds one file in memory; :meth:`close` gives all of it but the last four bytes' magic."""

    def __init__(self, level: int = 3, width: int = 2) -> None:
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.width = width
        self.frames: list[bytes] = []
        self.entries: list[bytes] = []
        self.ids: list[int | None] = []
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        payload = ids.astype(f"<u{self.width}").tobytes()
        frame = self.compress(payload)
        self.frames.append(frame)
        self.entries.append(struct.pack("<III", len(frame), len(payload), _checksum(payload)))
        self.ids.append(doc_id)
        self.n_ids += len(ids)

    def close(self) -> bytes:
        names = b"".join(struct.pack("<qB", x or 0, x is None) for x in self.ids)
        inside = self.compress(struct.pack("<B", self.width) + names)
        directory = struct.pack("<II", DIRECTORY_MAGIC, len(inside)) + inside
        entries = b"".join(self.entries) + struct.pack("<III", len(directory), 0, _checksum(b""))
        seek = struct.pack("<II", SEEK_MAGIC, len(entries) + 9) + entries + struct.pack("<IB", len(self.entries) + 1, 0x80)
        return b"".join(self.frames) + directory + seek


class SeekableReader:
    """Reads documents of one file; ``source`` is a seekable binary file object."""

    def __init__(self, source) -> None:
        import zstandard

        self.source = source
        self.decompress = zstandard.ZstdDecompressor().decompress
        source.seek(0, os.SEEK_END)
        size = source.tell()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        table = np.frombuffer(self._at(size - 9 - 12 * frames, 12 * frames), "<u4").reshape(frames, 3)
        self.table = table[:-1]
        self.start = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        head = self._at(int(self.start[-2]), int(table[-1, 0]))
        names = self.decompress(head[8:])
        self.width = names[0]
        rows = np.frombuffer(names[1:], np.dtype([("id", "<i8"), ("null", "u1")]))
        self.doc_ids: list[int | None] = [None if x["null"] else int(x["id"]) for x in rows]
        self.lengths = self.table[:, 1] // self.width

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def ids(self, place: int) -> np.ndarray:
        """The ids of document number ``place``; a wrong checksum raises."""
        stored, size, checksum = (int(x) for x in self.table[place])
        payload = self.decompress(self._at(int(self.start[place]), stored), max_output_size=size)
        if len(payload) != size or _checksum(payload) != checksum:
            raise ValueError(f"frame {place} is damaged")
        return np.frombuffer(payload, f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int | None) -> list[np.ndarray]:
        return [self.ids(i) for i, x in enumerate(self.doc_ids) if x == doc_id]


def write(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, level: int = 3) -> str:
    """Encode ``docs`` and write files below ``path`` (a new one in the shared folder); returns the path.

    Documents are dealt to tasks by ranges of doc_id. A task closes a file after
    ``FILE_IDS`` ids, so memory holds one file at most, or one document if that is
    longer. ``shard=`` folders in ascending order hold ascending documents.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    width = 4 if encoder(tokenizer).library.get_vocab_size() > 65_536 or end_id > 65_535 else 2

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        end = np.array([end_id], "<u4")
        coder, part, closed, writer = encoder(tokenizer), TaskContext.get().partitionId(), 0, SeekableWriter(level, width)

        def closing() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"value": pa.array([writer.close()], pa.binary()), "shard": pa.array([f"{part:07d}-{closed:05d}"])}
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                writer.add(doc_id, np.concatenate([np.frombuffer(coder.encode(text.as_py()), "<u4"), end]))
                if writer.n_ids >= FILE_IDS:
                    yield closing()
                    closed, writer = closed + 1, SeekableWriter(level, width)
        if writer.ids:
            yield closing()

    parts = spread(docs)
    rows = ids_and_texts(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    files = rows.mapInArrow(shards, "value binary, shard string")
    # A cast to string keeps the bytes as they are; the writer adds the footer's magic after each row.
    files.select(F.col("value").cast("string"), "shard").write.partitionBy("shard").option(
        "encoding", "ISO-8859-1"
    ).option("lineSep", FOOTER_END).text(path)
    return path


def spread(docs: DataFrame) -> int:
    """Tasks for a whole pass over the texts: by their bytes where known, as many as the session asks for at least."""
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, -(-size // FILE_BYTES))


def read(spark: SparkSession, path: str, column: Column | None = None) -> DataFrame:
    """One row for each document of the files below ``path``.

    Columns: ``shard`` string, ``place`` int in the file, ``doc_id`` long,
    ``before`` long (ids before it in its file), ``n_tokens`` long, ``ids`` array<long>
    and ``ids_crc32`` long. Every frame's checksum is verified.
    """

    def open_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                reader = SeekableReader(io.BytesIO(content.as_buffer()))
                total = np.concatenate([[0], np.cumsum(reader.lengths, dtype=np.int64)])
                for first in range(0, len(reader.doc_ids), 512):
                    places = range(first, min(first + 512, len(reader.doc_ids)))
                    ids = [reader.ids(i).tobytes() for i in places]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([shard] * len(places)),
                            pa.array(list(places), pa.int32()),
                            pa.array([reader.doc_ids[i] for i in places], pa.int64()),
                            pa.array(total[first : first + len(places)], pa.int64()),
                            pa.array([len(x) // 4 for x in ids], pa.int64()),
                            pa.array(ids, pa.binary()),
                            pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        ],
                        ["shard", "place", "doc_id", "before", "n_tokens", "ids", "ids_crc32"],
                    )

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.regexp_extract("path", r"shard=([0-9-]+)", 1).alias("shard"), "content")
    return named.mapInArrow(
        open_files,
        "shard string, place int, doc_id long, before long, n_tokens long, ids binary, ids_crc32 long",
    )


def with_starts(read_back: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all documents before it, over all files.

    Files are put in order by one row each; no document takes part in that.
    """
    shards = read_back.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    # One row per file of some millions of ids: few even for a very large corpus.
    before = F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = shards.select("shard", F.coalesce(before, F.lit(0)).alias("_base"))
    return read_back.join(shards, "shard").withColumn("start", F.col("_base") + F.col("before")).drop("_base")
