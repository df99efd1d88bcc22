"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

Documents are dealt into ranges of ascending ``doc_id``; each task encodes its range
and streams three flat little-endian files:

* ``.bin``  the ids, two bytes each where the vocabulary fits, else four
* ``.off``  int64, the first id of each document in this file, and the end of the last
* ``.doc``  int64, the documents' ids (null as ``NULL_ID``)

The part table (one row a file) gives each file's base, a prefix sum of id counts; a
document's place is base + offset.  Readers map the files into memory.

Defined cases: null or empty text has the end id alone; equal doc_ids are ordered by
text; an empty table has no files; other columns are ignored.  A task that runs
again writes files of another name, and only those named in the part table count.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minekit.llm.common import Scratch, map_arrow, need, ranges_of, table
from minekit.llm.tokens import encoder

NULL_ID = -(1 << 63)
PART_SCHEMA = "part int, file string, width int, n_docs long, n_tokens long"
DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _store(root: str):
    """The file system and path of a folder that every executor reaches: a shared mount, or a store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("s3://" + root[6:] if root.startswith("s3a://") else root)


def crc32_of_ids(ids: bytes, width: int) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids if width == 4 else np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())


def write_token_files(docs: DataFrame, root: str, *, end_id: int, vocabulary: str | None = None) -> list[dict]:
    """Encode ``docs`` (doc_id, text) into files under ``root``; the part table with bases, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, context = encoder(vocabulary), TaskContext.get()
        end = np.array([end_id], enc.dtype).tobytes()
        files, name, n_docs, n_tokens = None, "", 0, 0
        for batch in batches:
            if files is None:
                store, top = _store(root)
                store.create_dir(top, recursive=True)
                name = f"part-{context.partitionId():06d}-{uuid.uuid4().hex[:8]}"
                files = {x: store.open_output_stream(f"{top}/{name}.{x}") for x in ("bin", "off", "doc")}
            ids = [x + end for x in enc.encode(batch.column("text"))]
            ends = n_tokens + np.cumsum([len(x) // enc.width for x in ids])
            files["bin"].write(b"".join(ids))
            files["off"].write(np.concatenate([[n_tokens], ends[:-1]]).astype("<i8").tobytes())
            files["doc"].write(
                np.array([NULL_ID if x is None else x for x in batch.column("doc_id").to_pylist()], "<i8").tobytes()
            )
            n_docs, n_tokens = n_docs + len(ids), int(ends[-1])
        if files:
            files["off"].write(np.array([n_tokens], "<i8").tobytes())
            for x in files.values():
                x.close()
            row = {"part": context.partitionId(), "file": name, "width": enc.width, "n_docs": n_docs, "n_tokens": n_tokens}
            yield pa.RecordBatch.from_pylist([row], pa.schema(
                [("part", pa.int32()), ("file", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]
            ))

    # The first letters of the text part the rows of one doc_id, should it have very many.
    chosen = need(docs, "doc_id", "text")
    ordered = chosen.repartitionByRange(ranges_of(chosen), F.col("doc_id"), F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    # One row for each file, of ``RANGE_BYTES`` of text or as many as shuffle partitions.
    parts = sorted((x.asDict() for x in map_arrow(ordered, run, PART_SCHEMA).collect()), key=lambda x: x["part"])
    base = 0
    for x in parts:
        x["base"] = base
        base += x["n_tokens"]
    return parts


class Ranged:
    """An array in a file of a store without memory maps: slices are read by range, so it is never held whole."""

    def __init__(self, file, dtype: str):
        self.file, self.dtype = file, np.dtype(dtype)

    def __len__(self) -> int:
        return self.file.size() // self.dtype.itemsize

    def __getitem__(self, at: slice) -> np.ndarray:
        low, high, _ = at.indices(len(self))
        return np.frombuffer(self.file.read_at(max(0, high - low) * self.dtype.itemsize, low * self.dtype.itemsize), self.dtype)


def open_part(root: str, part: dict) -> tuple[np.ndarray | Ranged, ...]:
    """ids, offsets and doc ids of one part: mapped into memory where the store is a file system, else read by range."""
    from pyarrow import fs

    store, top = _store(root)
    out = []
    for kind, dtype in (("bin", f"<u{part['width']}"), ("off", "<i8"), ("doc", "<i8")):
        at = f"{top}/{part['file']}.{kind}"
        if isinstance(store, fs.LocalFileSystem):
            out.append(np.memmap(at, dtype, "r") if store.get_file_info(at).size else np.zeros(0, dtype))
        else:
            out.append(Ranged(store.open_input_file(at), dtype))
    return tuple(out)


def read_token_files(spark: SparkSession, root: str, parts: list[dict]) -> DataFrame:
    """A row for each document of the files: doc_id, start, n_tokens, ids_crc32."""
    if not parts:
        return spark.createDataFrame([], DOC_SCHEMA)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                ids, offsets, docs = open_part(root, parts[k])
                for lo in range(0, len(docs), 5000):
                    hi = min(lo + 5000, len(docs))
                    at = offsets[lo : hi + 1]
                    crc = [crc32_of_ids(ids[a:b].tobytes(), parts[k]["width"]) for a, b in zip(at[:-1], at[1:], strict=True)]
                    doc = np.asarray(docs[lo:hi])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(doc, mask=doc == NULL_ID), pa.array(parts[k]["base"] + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())
                    ], schema=schema)

    return map_arrow(spark.range(0, len(parts), 1, len(parts)), run, DOC_SCHEMA)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, write the files, and digest what the files hold."""
    root = Scratch(spark, "tokens").path("files")
    parts = write_token_files(table(spark, sf_dir, "documents"), root, end_id=2)
    return read_token_files(spark, root, parts)
