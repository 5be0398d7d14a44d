"""Best-fit packing of token sequences by hierarchical residual packing.

Every document is encoded once (ids, then one end id), cut into pieces of the sequence length only where it is longer,
and reduced to a narrow row per piece. Pieces that fill a sequence are done. The others are dealt in turn to many tasks
that each run best-fit decreasing; nearly full bins are emitted, and the underfull bins travel on as items, to fewer
and fewer tasks in a tree, until a last round of bounded size emits whatever is left.

Null or empty text: one piece that holds the end id alone. Null doc_id: kept, null in the result. Repeated rows: each
is packed on its own. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise, slices
from ledgerloom.llm.encoding import encoder, tokenizer_path

CAPACITY = 4096
END_ID = 1
#: Items that one task packs, and the share of the capacity from which a bin is emitted before the last round.
ITEMS_PER_TASK = 50_000
NEARLY_FULL = 0.998
#: Each round of the tree has this many times fewer tasks.
FAN_IN = 8

PIECE = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])
BIN_SCHEMA = "sequence_id bigint, length int, members binary, full boolean"
LAYOUT_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def encode_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (little-endian unsigned 32-bit; null unless with_ids) of every document."""
    path, end = path or tokenizer_path(), np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint, ids binary")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing. A bit set of the open residuals finds the tightest bin; equal lengths keep their order."""
    open_bins: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    residuals = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        if fits := residuals >> need:
            room = need + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                residuals &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if left := room - need:
            open_bins.setdefault(left, []).append(b)
            residuals |= 1 << left
    return bins


def _round(level: int, capacity: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        task = TaskContext.get().partitionId()
        members = [m for b in got for m in b.column(1).to_pylist()]
        order = sorted(range(len(members)), key=members.__getitem__)  # the same bins if the task runs again
        members = [members[i] for i in order]
        lengths = np.concatenate([b.column(0).to_numpy() for b in got])[order] if got else np.zeros(0, "i4")
        bins = best_fit(lengths, capacity)
        totals = [int(lengths[b].sum()) for b in bins]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([(level << 56) | (task << 28) | i for i in range(len(bins))], pa.int64()),
                pa.array(totals, pa.int32()),
                pa.array([b"".join(members[i] for i in b) for b in bins], pa.binary()),
                pa.array([t >= least for t in totals], pa.bool_()),
            ],
            ["sequence_id", "length", "members", "full"],
        )

    return run


def _as_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.zeros(batch.num_rows, PIECE)
        rows["known"] = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        for name, col in (("doc_id", "doc_id"), ("piece", "piece"), ("start", "start"), ("length", "length"), ("crc", "ids_crc32")):
            rows[name] = batch.column(col).fill_null(0).to_numpy(zero_copy_only=False)
        raw, w = rows.tobytes(), PIECE.itemsize
        yield pa.RecordBatch.from_arrays([pa.array(rows["length"], pa.int32()), pa.array([raw[i : i + w] for i in range(0, len(raw), w)], pa.binary())], ["length", "members"])


def _layout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        blobs = batch.column("members").to_pylist()
        rows = np.frombuffer(b"".join(blobs), PIECE)
        counts = np.array([len(b) // PIECE.itemsize for b in blobs])
        ends = np.cumsum(rows["length"].astype("i8"))
        starts = ends - rows["length"]
        first = np.repeat(starts[np.cumsum(counts) - counts], counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rows["doc_id"].astype("i8"), pa.int64(), mask=rows["known"] == 0),
                pa.array(rows["piece"].astype("i4")),
                pa.array(rows["start"].astype("i8")),
                pa.array(rows["length"].astype("i8")),
                pa.array(rows["crc"].astype("i8")),
                pa.array(np.repeat(batch.column("sequence_id").to_numpy(), counts)),
                pa.array(starts - first),
            ],
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, items_per_task: int = ITEMS_PER_TASK, nearly_full: float = NEARLY_FULL, fan_in: int = FAN_IN) -> DataFrame:
    """Place pieces (doc_id, piece, start, length, ids_crc32) into sequences; adds sequence_id and offset."""
    slim = materialise(pieces.select("doc_id", "piece", "start", "length", "ids_crc32"), "pieces")
    items = slim.mapInArrow(_as_items, "length int, members binary")
    whole = items.where(F.col("length") == capacity).withColumn("sequence_id", F.lit(1 << 62) + F.monotonically_increasing_id())
    done = [materialise(whole.select("sequence_id", "members"), "whole")]
    rest, n, level = items.where(F.col("length") < capacity), slim.where(F.col("length") < capacity).count(), 0
    tasks = max(1, -(-n // items_per_task))
    dealt = rest.repartition(tasks)  # in turn: repeated rows don't meet in one task
    while True:
        last = tasks == 1
        bins = materialise(dealt.mapInArrow(_round(level, capacity, 0 if last else int(nearly_full * capacity)), BIN_SCHEMA), "bins")
        done.append(bins.where("full").select("sequence_id", "members"))
        if last:
            break
        under = bins.where("NOT full").select("length", "members")
        left = under.count()
        if not left:
            break
        level += 1
        fewer = max(-(-tasks // fan_in), -(-left // items_per_task))
        if fewer >= tasks and left > 0.999 * n:  # nothing fits together any more: the bins are final
            done.append(bins.where("NOT full").select("sequence_id", "members"))
            break
        tasks, n = min(fewer, tasks), left
        dealt = under.repartition(tasks)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.mapInArrow(_layout, LAYOUT_SCHEMA)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    encode_pieces() gives the ids of the same pieces, for writing the sequences themselves.
    """
    return pack_pieces(encode_pieces(docs, path, capacity, end_id, with_ids=False), capacity, **options)
