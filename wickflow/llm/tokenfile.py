"""Token ids as Arrow stream files of fixed-size lists, in document order.

A file holds record batches of two columns, ``ids`` and ``mask``, both lists of
``SEQUENCE`` values: rows are equal-length sequences of the running id stream,
and the mask, one bit for each id, is false where the last row is padded.
Batches are uncompressed, so a memory-mapped file gives any sequence without a
copy. A second, small stream file beside it lists each document's start and
count in that file.

Documents are dealt to tasks by ranges of their id that hold equally many bytes
of text; a task writes one file after another of up to ``FILE_IDS`` ids, so file
after file is in ascending order. Starts across files come from the files' totals.

Defined results: null text counts as empty and holds the end id alone; null
ids come first; repeated ids are in order of a hash of their text; an empty input gives
an empty output. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wickflow.llm.common import materialise, scratch_uri, ship, text_of
from wickflow.llm.ranges import byte_ranges
from wickflow.llm.tokens import crc32_u4, default_tokenizer, encoder

SEQUENCE = 2048
#: Sequences in a record batch.
BATCH_ROWS = 256
END_ID = 2
#: Ids in a file, apart from the last document's.
FILE_IDS = 64 << 20
#: Documents in a batch of a file's index.
INDEX_ROWS = 50_000


def _write(uri: str, tokenizer: str, end_id: int, length: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        fs, root = pafs.FileSystem.from_uri(uri)
        kind = pa.from_numpy_dtype(enc.dtype)
        schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        state: dict = {}

        def rows(ids: np.ndarray, real: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids, kind), length),
                                               pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(ids)) < real), length)], schema=schema)

        def begin(part: int, number: int) -> None:
            fs.create_dir(root, recursive=True)
            tmp, tmp_index = f"{root}/_{uuid.uuid4().hex}", f"{root}/_{uuid.uuid4().hex}"
            out, out_index = (fs.open_output_stream(x, compression=None) for x in (tmp, tmp_index))
            state.update(part=part, number=number, tmp=tmp, tmp_index=tmp_index, out=out, out_index=out_index, writer=pa.ipc.new_stream(out, schema),
                         index=pa.ipc.new_stream(out_index, index_schema), held=[], n_held=0, total=0, docs=[], n_docs=0)

        def push(final: bool) -> None:
            step = length * BATCH_ROWS
            if final or len(state["docs"]) >= INDEX_ROWS:
                state["index"].write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*state["docs"])] or [pa.array([], pa.int64())] * 3, schema=index_schema))
                state["docs"] = []
            if not final and state["n_held"] < step:
                return
            ids = np.concatenate(state["held"]) if state["held"] else np.empty(0, enc.dtype)
            full = len(ids) // step * step
            for s in range(0, full, step):
                state["writer"].write_batch(rows(ids[s:s + step], step))
            rest = ids[full:]
            if final and len(rest):
                padded = np.zeros(-(-len(rest) // length) * length, enc.dtype)
                padded[:len(rest)] = rest
                state["writer"].write_batch(rows(padded, len(rest)))
                rest = rest[:0]
            state.update(held=[rest], n_held=len(rest))

        def finish() -> pa.RecordBatch:
            push(final=True)
            for x in ("writer", "out", "index", "out_index"):
                state[x].close()
            name = f"part-{state['part']:06d}-{state['number']:04d}.arrow"
            fs.move(state["tmp_index"], f"{root}/{name}.index")
            fs.move(state["tmp"], f"{root}/{name}")
            done = pa.RecordBatch.from_pydict({"part": pa.array([state["part"]], pa.int32()), "number": pa.array([state["number"]], pa.int32()), "file": [name],
                                               "total": pa.array([state["total"]], pa.int64()), "docs": pa.array([state["n_docs"]], pa.int64())})
            state.clear()
            return done

        # Rows come sorted by part, then id: one file after another.
        for b in batches:
            for part, doc, text in zip(b.column("part").to_pylist(), b.column("doc_id").to_pylist(), b.column("text")):
                number = 0
                if state and (state["part"] != part or state["total"] >= file_ids):
                    number = state["number"] + 1 if state["part"] == part else 0
                    yield finish()
                if not state:
                    begin(part, number)
                ids = np.append(enc.encode(text.as_py()), enc.dtype.type(end_id))
                state["docs"].append((doc, state["total"], len(ids)))
                state["held"].append(ids)
                state["n_held"] += len(ids)
                state["total"] += len(ids)
                state["n_docs"] += 1
                push(final=False)
        if state:
            yield finish()

    return run


_MANIFEST = "part int, number int, file string, total long, docs long"


def write_token_files(docs: DataFrame, uri: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, length: int = SEQUENCE,
                      parts: int | None = None, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files; returns the manifest (uri, part, number, file, total, docs), one row per file.

    ``parts`` is the least number of tasks; by default there are as many as
    shuffle partitions, and more where the bytes ask for them.
    """
    spark = docs.sparkSession
    ship(spark)
    uri = uri or scratch_uri(spark, "token-files")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    ranges = byte_ranges(rows, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    if ranges is None:
        return spark.createDataFrame([], _MANIFEST).withColumn("uri", F.lit(uri))
    hashed = rows.withColumn("h", F.xxhash64("text"))
    dealt = hashed.withColumn("part", ranges.part_of(F.col("doc_id"), F.col("h"))).repartitionById(ranges.parts, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "h", "text")
    done = dealt.select("part", "doc_id", "text").mapInArrow(_write(uri, tokenizer or default_tokenizer(), end_id, length, file_ids), _MANIFEST)
    return materialise(done.withColumn("uri", F.lit(uri)), "token-manifest")


class TokenFile:
    """Random access to the sequences of one file, without copies where the store can be mapped."""

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        reader = pa.ipc.open_stream(source)
        self.batches = list(reader)
        self.length = reader.schema.field("ids").type.list_size
        self.ends = np.cumsum([b.num_rows for b in self.batches])

    def _rows(self, k: int, column: str) -> pa.Array:
        b = int(np.searchsorted(self.ends, k, "right"))
        row = k - (int(self.ends[b - 1]) if b else 0)
        return self.batches[b].column(column).values.slice(row * self.length, self.length)

    def ids(self, k: int) -> np.ndarray:
        """The ids of sequence ``k``, as they lie in the file."""
        return self._rows(k, "ids").to_numpy(zero_copy_only=True)

    def mask(self, k: int) -> pa.BooleanArray:
        """The mask of sequence ``k``, as its bits lie in the file."""
        return self._rows(k, "mask")

    def span(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from position ``start`` of the file's stream."""
        rows = [self.ids(k) for k in range(start // self.length, -(-(start + n) // self.length))]
        ids = rows[0] if len(rows) == 1 else np.concatenate(rows)
        at = start % self.length
        return ids[at:at + n]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for uri, name, base in zip(*(b.column(c).to_pylist() for c in ("uri", "file", "base"))):
            fs, root = pafs.FileSystem.from_uri(uri)
            tokens = TokenFile(fs, f"{root}/{name}")
            with fs.open_input_file(f"{root}/{name}.index") as f:
                for index in pa.ipc.open_stream(f):
                    start, count = index.column("start").to_numpy(), index.column("n_tokens").to_numpy()
                    sums = [crc32_u4(tokens.span(s, n)) for s, n in zip(start.tolist(), count.tolist())]
                    yield pa.RecordBatch.from_pydict({"doc_id": index.column("doc_id"), "start": start + base, "n_tokens": count, "ids_crc32": pa.array(sums, pa.int64())})


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, all from the files.

    ``base``, the ids in all files before, is a running sum over one row per file.
    """
    ship(spark)
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0))).select("uri", "file", "base")
    spread = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")
    return spread.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame) -> DataFrame:
    return read_token_files(docs.sparkSession, write_token_files(docs))
