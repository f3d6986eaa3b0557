"""Token files: ids of documents in independent zstandard frames with a trailing seek table.

A shard holds the ids of its documents one after another, cut into frames of a fixed number of
bytes; then, as a skippable frame, the compressed list of its documents; then the seek table of the
public seekable zstandard format, with the low 32 bits of each frame's XXH64. A reader loads the
table and the list, and decompresses and checks only the frames that the wanted documents lie in.
A plain zstandard decoder reads the same ids.

Writing sorts by document id over ranges, one shard per task. A task writes under a name of its own
attempt and renames it when whole, so lost executors and repeated tasks leave the same shards.

Defined cases: a null text is empty and has the end id alone; a null id comes first; rows that share
an id are ordered by text and all stay; a document longer than a frame spans several; an empty table
has no shards; other columns are not carried. Damaged frames raise ``ValueError``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from scanloom.llm.common import shared_folder, ship
from scanloom.llm.tokens import ID_TYPE, batches_of, text_encoder

FRAME_BYTES = 1 << 18
LEVEL = 3

# Fixed values of the zstandard formats: skippable frames, and the seek table's footer and flag.
INDEX_MAGIC = 0x184D2A50
TABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

_HEAD, _ENTRY, _FOOT = struct.Struct("<II"), struct.Struct("<III"), struct.Struct("<IBI")


class ShardWriter:
    """Writes one shard to an open binary file; memory holds one frame and the document list."""

    def __init__(self, file, id_type: pa.DataType, frame_bytes: int = FRAME_BYTES):
        self.file, self.id_type, self.frame_bytes = file, id_type, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.held, self.table = bytearray(), []
        self.names: list[pa.Array] = []
        self.counts: list[pa.Array] = []

    def add(self, names: pa.Array, ids: list[bytes]) -> None:
        self.names.append(names)
        self.counts.append(pa.array([len(x) // ID_TYPE.itemsize for x in ids], pa.int64()))
        for x in ids:
            self.held += x
            while len(self.held) >= self.frame_bytes:
                self._frame(bytes(self.held[: self.frame_bytes]))
                del self.held[: self.frame_bytes]

    def _frame(self, raw: bytes) -> None:
        packed = self.packer.compress(raw)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.file.write(packed)

    def close(self) -> tuple[int, int]:
        """Finishes the file; its documents and tokens."""
        if self.held:
            self._frame(bytes(self.held))
        index = pa.table(
            {
                "doc": pa.chunked_array(self.names, self.id_type),
                "tokens": pa.chunked_array(self.counts, pa.int64()),
            }
        )
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, index.schema) as out:
            out.write_table(index)
        packed = self.packer.compress(sink.getvalue().to_pybytes())
        self.file.write(_HEAD.pack(INDEX_MAGIC, len(packed)) + packed)
        self.table.append((_HEAD.size + len(packed), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        entries = b"".join(_ENTRY.pack(*e) for e in self.table)
        foot = _FOOT.pack(len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.file.write(_HEAD.pack(TABLE_MAGIC, len(entries) + len(foot)) + entries + foot)
        return index.num_rows, sum(e[1] for e in self.table) // ID_TYPE.itemsize


class ShardReader:
    """Documents of one shard, from a file that can seek."""

    def __init__(self, file):
        self.file = file
        self.unpacker = zstandard.ZstdDecompressor()
        file.seek(0, 2)
        end = file.tell()
        count, flags, magic = _FOOT.unpack(self._read(end - _FOOT.size, _FOOT.size))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("no seek table at the end of the file")
        size = count * _ENTRY.size
        entries = list(_ENTRY.iter_unpack(self._read(end - _FOOT.size - size, size)))
        self.frames, at = [], 0
        for packed, raw, check in entries[:-1]:
            self.frames.append((at, packed, raw, check))
            at += packed
        index = self._read(at + _HEAD.size, entries[-1][0] - _HEAD.size)
        with pa.ipc.open_stream(self.unpacker.decompress(index)) as stream:
            table = stream.read_all()
        self.docs, self.counts = table.column(0), table.column(1).to_pylist()
        # All data frames but the last have the same size, so a place gives its frame by division.
        self.frame_bytes = self.frames[0][2] if self.frames else 1
        self.kept: tuple[int, bytes] = (-1, b"")
        self.decompressed = 0

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _frame(self, k: int) -> bytes:
        if self.kept[0] != k:
            at, packed, size, check = self.frames[k]
            raw = self.unpacker.decompress(self._read(at, packed), max_output_size=size)
            if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} is damaged")
            self.kept = (k, raw)
            self.decompressed += 1
        return self.kept[1]

    def pieces(self, start: int, tokens: int) -> Iterator[bytes]:
        """The bytes of a run of tokens, frame by frame."""
        at, end = start * ID_TYPE.itemsize, (start + tokens) * ID_TYPE.itemsize
        while at < end:
            k = at // self.frame_bytes
            raw = self._frame(k)
            low = at - k * self.frame_bytes
            piece = raw[low : low + end - at]
            yield piece
            at += len(piece)

    def read(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, int, int, Iterator[bytes]]]:
        """(place in the shard, tokens before it, tokens, its bytes) of the wanted places, or all."""
        wanted = None if wanted is None else set(wanted)
        start = 0
        for place, n in enumerate(self.counts):
            if wanted is None or place in wanted:
                yield place, start, n, self.pieces(start, n)
            start += n


def open_filesystem(uri: str):
    return pafs.FileSystem.from_uri(uri)


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> list[dict]:
    """Writes the shards below ``folder``, a URI that all executors reach, in order of document id.

    Returns one record per shard, in order: path, documents, tokens, and the tokens before it.
    """
    spark = docs.sparkSession
    ship(spark)
    end = int(end_id).to_bytes(ID_TYPE.itemsize, "little")

    def run(batches):
        encoder, context, writer = text_encoder(tokenizer), TaskContext.get(), None
        files, root = open_filesystem(folder)
        name = f"{root}/shard-{context.partitionId():06d}.ids.zst"
        own = f"{root}/.attempt-{context.taskAttemptId()}"
        for batch in batches:
            for first, texts in batches_of(batch.column(1).to_pylist()):
                if writer is None:
                    files.create_dir(root, recursive=True)
                    writer = ShardWriter(files.open_output_stream(own), batch.column(0).type)
                ids = [x + end for x in encoder.encode_many(texts)]
                writer.add(batch.column(0).slice(first, len(ids)), ids)
        if writer is not None:
            n_docs, n_tokens = writer.close()
            writer.file.close()
            if files.get_file_info(name).type != pafs.FileType.NotFound:
                files.delete_file(name)  # of a lost attempt at the same task
            files.move(own, name)
            row = [[context.partitionId()], [name], [n_docs], [n_tokens]]
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(row, kinds)], names=["part", "path", "docs", "tokens"]
            )

    ordered = (
        docs.select(id_col, text_col)
        .repartitionByRange(id_col)
        .sortWithinPartitions(id_col, text_col)
    )
    # One small record per shard: what a job's driver keeps per task anyway.
    shards = ordered.mapInArrow(run, "part int, path string, docs long, tokens long").collect()
    out, before = [], 0
    for shard in sorted(shards):
        out.append({"path": shard["path"], "docs": shard["docs"], "tokens": shard["tokens"], "before": before})
        before += shard["tokens"]
    return out


def read_token_files(
    spark: SparkSession, shards: list[dict], folder: str, id_type: str = "bigint", id_col: str = "doc_id"
) -> DataFrame:
    """Every document of the shards: id, ``start`` (tokens of all before it), ``n_tokens`` and the
    CRC-32 of its ids, computed frame by frame."""
    ship(spark)

    def run(batches):
        files, _ = open_filesystem(folder)
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with files.open_input_file(path) as file:
                    reader = ShardReader(file)
                    starts, counts, sums = [], [], []
                    for _, start, n, pieces in reader.read():
                        crc = 0
                        for piece in pieces:
                            crc = zlib.crc32(piece, crc)
                        starts.append(before + start)
                        counts.append(n)
                        sums.append(crc)
                columns = [pa.array(v, pa.int64()) for v in (starts, counts, sums)]
                yield pa.RecordBatch.from_arrays(
                    [reader.docs.combine_chunks(), *columns],
                    names=[id_col, "start", "n_tokens", "ids_crc32"],
                )

    listed = spark.createDataFrame(
        [(s["path"], s["before"]) for s in shards], "path string, before long"
    ).repartition(max(1, len(shards)))
    return listed.mapInArrow(
        run, f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long"
    )


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``docs`` below the shared folder and reads the files back."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "token-files")
    shards = write_token_files(docs, tokenizer, folder, end_id, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    return read_token_files(spark, shards, folder, kind, id_col)
