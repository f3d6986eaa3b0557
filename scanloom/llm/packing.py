"""Packing: documents concatenated and cut into sequences of a fixed number of tokens.

Two passes over partitions. The first tokenises each partition, numbers its tokens from 0 and
stages the ids; the partitions' token totals, one number per task, give every partition its place
in the whole by prefix sums. The second cuts at multiples of the sequence length; a document that
crosses a cut gives one boundary record on each side. Nothing is shuffled, so no document, source
or key can gather in one task. The order is that of the input's partitions, fixed once staged.

Every sequence but the last is full. It is padded to the sequence length, unless its tokens are a
power of two (``padded_length``).

Defined cases: a null text is empty; a document has its end id even where its text is empty; without
an end id, documents without tokens have no piece; ids of documents may be null or repeat and are
carried as they are; very long texts span many sequences; an empty table has no pieces; other
columns are not carried.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from scanloom.llm.common import ship, stage
from scanloom.llm.tokens import ID_TYPE, batches_of, text_encoder

SEQUENCE_TOKENS = 4096


def tokenize(
    docs: DataFrame, path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Ids per document as binary, with the partition and the tokens before it there; no shuffle."""
    ship(docs.sparkSession)
    end = b"" if end_id is None else int(end_id).to_bytes(ID_TYPE.itemsize, "little")

    def run(batches):
        encoder, part, before = text_encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, texts in batches_of(batch.column(1).to_pylist()):
                ids = [x + end for x in encoder.encode_many(texts)]
                counts = [len(x) // ID_TYPE.itemsize for x in ids]
                starts = []
                for n in counts:
                    starts.append(before)
                    before += n
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(ids)),
                        pa.array(ids, pa.binary()),
                        pa.array(counts, pa.int64()),
                        pa.array([part] * len(ids), pa.int32()),
                        pa.array(starts, pa.int64()),
                    ],
                    names=[id_col, "ids", "doc_tokens", "part", "part_start"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, ids binary, doc_tokens long, part int, part_start long"
    )


def pack(tokens: DataFrame, length: int = SEQUENCE_TOKENS, id_col: str = "doc_id") -> DataFrame:
    """Pieces of staged ``tokenize`` rows: one per document and sequence that share tokens."""
    ship(tokens.sparkSession)
    # One row per task of the first pass; the driver of a job holds as many task records anyway.
    totals = sorted(map(tuple, tokens.groupBy("part").agg(F.sum("doc_tokens")).collect()))
    bases, whole = {}, 0
    for part, n in totals:
        bases[part] = whole
        whole += n
    last_sequence, last_fill = divmod(whole, length)

    def run(batches):
        for batch in batches:
            rows = {k: [] for k in ("at", "start", "length", "crc", "sequence", "offset")}
            columns = [batch.column(i).to_pylist() for i in (2, 3, 4)]
            for i, (n, part, part_start) in enumerate(zip(*columns)):
                ids = memoryview(batch.column(1)[i].as_buffer())
                place, start = bases[part] + part_start, 0
                while start < n:
                    sequence, offset = divmod(place + start, length)
                    size = min(n - start, length - offset)
                    piece = ids[start * ID_TYPE.itemsize : (start + size) * ID_TYPE.itemsize]
                    for k, v in zip(rows, (i, start, size, zlib.crc32(piece), sequence, offset)):
                        rows[k].append(v)
                    start += size
            at = pa.array(rows["at"], pa.int64())
            fills = [last_fill if s == last_sequence else length for s in rows["sequence"]]
            padded = [f if f & (f - 1) == 0 else length for f in fills]
            longs = [pa.array(rows[k], pa.int64()) for k in ("start", "length", "crc")]
            place = [pa.array(rows[k], pa.int64()) for k in ("sequence", "offset")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    *longs,
                    batch.column(2).take(at),
                    *place,
                    pa.array(padded, pa.int64()),
                ],
                names=piece_columns(id_col),
            )

    kind = tokens.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in piece_columns(id_col)[1:])
    return tokens.select(id_col, "ids", "doc_tokens", "part", "part_start").mapInArrow(run, schema)


def piece_columns(id_col: str) -> list[str]:
    return [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"]


def pack_documents(
    docs: DataFrame,
    path: str,
    end_id: int | None = 2,
    length: int = SEQUENCE_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    return pack(stage(tokenize(docs, path, end_id, id_col, text_col), "tokens"), length, id_col)
