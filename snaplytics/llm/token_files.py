"""Token ids in binary files: frequency-ranked, variable-length, with separate control bytes.

Every id is replaced by its rank in descending frequency over all documents, so frequent ids
are small numbers. Numbers take one to four bytes; the lengths stand apart in control bytes of
four two-bit codes each. A reader looks all lengths up in a table by control byte, adds them up and gathers
the numbers with one numpy index.

Layout of a folder: ``ranks/`` has one file with the ids by rank (32 bits each), ``blocks/shard=N/``
files of blocks one after the other, each followed by a line break. Shards ascend with doc_id, and so do
places in a shard. A block: header (see HEADER), ids of its documents (64 bits, and a byte each
that is 1 for a null id), their token counts (32 bits), control bytes, data bytes. All numbers are little-endian.

Texts are dealt by ranges of doc_id once, rows of one id by a hash of their text and equal rows by their
number, so no id is too frequent for a shard; they are encoded behind that shuffle and stored. Blocks are of
bounded size whatever a shard holds. Files are written and read by Spark's own sources, so
any storage that Spark reaches will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snaplytics.llm.cached_tokens import encoder
from snaplytics.llm.common import remove, shared_folder, stored, text_or_empty

MAGIC = b"VTOK"
HEADER = struct.Struct("<4sIqIQQI")  # magic, shard, first place, documents, tokens, data bytes, crc32 of what follows
END = b"\n"
BLOCK_TOKENS = 2_000_000  # a block ends with the document that reaches this
BLOCKS_PER_FILE = 8
TEXTS_AT_ONCE = 512
LENGTHS = np.array([[(c >> shift & 3) + 1 for shift in (0, 2, 4, 6)] for c in range(256)], np.uint8)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_numbers(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of 32-bit numbers."""
    values = np.ascontiguousarray(values, "<u4")
    codes = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = codes
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= codes[:, None]]
    return control.tobytes(), data.tobytes()


def decode_numbers(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    padded = data + b"\0\0\0"
    at_every_byte = np.ndarray((max(0, len(padded) - 3),), "<u4", padded, strides=(1,))
    return at_every_byte[starts] & MASKS[lengths]


def _tokenised(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, place = encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                ids = [x + end for x in encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), shard, np.int32)),
                        pa.array(np.arange(place, place + len(ids))),
                        part.column(0),
                        pa.array(ids, pa.binary()),
                    ],
                    ["shard", "place", "doc_id", "ids"],
                )
                place += len(ids)

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << 16, np.int64)
    for batch in batches:
        counts += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2"), minlength=1 << 16)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["id", "n"])


def _block(shard: int, place: int, doc_ids: list, ids: list[bytes], rank_of: np.ndarray) -> bytes:
    lengths = np.fromiter((len(x) // 2 for x in ids), "<u4", len(ids))
    control, data = encode_numbers(rank_of[np.frombuffer(b"".join(ids), "<u2")])
    missing = np.fromiter((d is None for d in doc_ids), np.uint8, len(doc_ids))
    known = np.fromiter((d or 0 for d in doc_ids), "<i8", len(doc_ids))
    body = known.tobytes() + missing.tobytes() + lengths.tobytes() + control + data
    return HEADER.pack(MAGIC, shard, place, len(ids), int(lengths.sum()), len(data), zlib.crc32(body)) + body


def _blocks(rank_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, places = (batch.column(i).to_numpy() for i in (0, 1))
            doc_ids, ids = (batch.column(i).to_pylist() for i in (2, 3))
            start = tokens = 0
            for i in range(batch.num_rows):
                tokens += len(ids[i]) // 2
                # A batch may hold rows of several files: a block never spans a gap.
                last = i + 1 == batch.num_rows or shards[i + 1] != shards[i] or places[i + 1] != places[i] + 1
                if last or tokens >= BLOCK_TOKENS:
                    shard, cut = int(shards[start]), slice(start, i + 1)
                    block = _block(shard, int(places[start]), doc_ids[cut], ids[cut], rank_of)
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.binary())], ["shard", "value"])
                    start, tokens = i + 1, 0

    return run


def write_tokens(docs: DataFrame, path: str, end_id: int, folder: str) -> None:
    """Encode every row's whole text with the tokenizer file at ``path`` and write the files to ``folder``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    order = ["doc_id", "text_hash", "row"]
    keyed = texts.withColumns({"text_hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    in_order = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    schema = "shard int, place long, doc_id long, ids binary"
    spark = docs.sparkSession
    own = shared_folder(spark, "ids")
    tokens = stored(in_order.mapInArrow(_tokenised(path, end_id), schema), "ids", path=own)
    counts = tokens.select("ids").mapInArrow(_counted, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    by_rank = [r["id"] for r in sorted(counts.collect(), key=lambda r: (-r["n"], r["id"]))]  # at most the vocabulary
    rank_of = np.zeros(1 << 16, "<u4")
    rank_of[by_rank] = np.arange(len(by_rank))
    ranks = spark.createDataFrame([(bytearray(np.array(by_rank, "<u4").tobytes()),)], "value binary")
    ranks.select(F.col("value").cast("string")).write.text(f"{folder}/ranks", lineSep=END.decode())
    blocks = tokens.mapInArrow(_blocks(rank_of), "shard int, value binary")
    blocks = blocks.select("shard", F.col("value").cast("string"))
    blocks.write.option("maxRecordsPerFile", BLOCKS_PER_FILE).partitionBy("shard").text(f"{folder}/blocks", lineSep=END.decode())
    remove(spark, own)


def read_blocks(content: bytes) -> Iterator[tuple]:
    """Blocks of a file: shard, first place, document ids, token counts, ranks."""
    at = 0
    while at < len(content):
        magic, shard, place, n_docs, n_tokens, n_data, checksum = HEADER.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += HEADER.size
        n_control = -(-n_tokens // 4)
        sizes = np.cumsum([8 * n_docs, n_docs, 4 * n_docs, n_control, n_data])
        body = content[at : at + int(sizes[-1])]
        if zlib.crc32(body) != checksum:
            raise ValueError(f"block before byte {at} is damaged")
        known, missing, lengths = (np.frombuffer(body[a:b], t) for a, b, t in zip([0, *sizes], sizes[:3], ("<i8", "u1", "<u4")))
        ranks = decode_numbers(body[sizes[2] : sizes[3]], body[sizes[3] :], n_tokens)
        yield shard, place, np.ma.array(known, mask=missing), lengths, ranks
        at += len(body) + len(END)


def _decoded(id_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for shard, place, doc_ids, lengths, ranks in read_blocks(content.as_py()):
                    ids = id_of[ranks]
                    ends = np.cumsum(lengths, dtype=np.int64)
                    starts = ends - lengths
                    sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                    n = len(lengths)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, shard, np.int32)),
                            pa.array(np.full(n, place, np.int64)),
                            pa.array(doc_ids.data, pa.int64(), mask=np.ma.getmaskarray(doc_ids)),
                            pa.array(starts),
                            pa.array(lengths.astype(np.int64)),
                            pa.array(sums, pa.int64()),
                        ],
                        ["shard", "block", "doc_id", "in_block", "n_tokens", "ids_crc32"],
                    )

    return run


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.format("binaryFile")
    ranks = files.load(f"{folder}/ranks").filter("length > 0").select("content").first()
    id_of = np.frombuffer(ranks[0][: -len(END)] if ranks else b"", "<u4")
    schema = "shard int, block long, doc_id long, in_block long, n_tokens long, ids_crc32 long"
    content = files.option("pathGlobFilter", "part-*").load(f"{folder}/blocks").select("content")
    rows = stored(content.mapInArrow(_decoded(id_of), schema), "decoded")
    per_block = rows.groupBy("shard", "block").agg(F.sum("n_tokens").alias("n"))
    per_shard = per_block.groupBy("shard").agg(F.sum("n").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    shard_start = per_shard.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    block_start = per_block.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("block_start"))
    starts = block_start.join(shard_start, "shard").select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("first"))
    return rows.join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("first") + F.col("in_block")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_round_trip(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Write the ids of all rows of ``docs`` to files and return what the files hold.

    A null or empty text is the end id alone; a null doc_id comes first and is kept apart by a
    flag; repeated rows are documents of their own; rows of one id, or without one, are in the order of a hash of
    their text. An empty table gives no rows. Further
    columns are ignored. The files lie in the shared folder until they have been read.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "tokens")
    write_tokens(docs, path, end_id, folder)
    found = read_tokens(spark, folder)
    remove(spark, folder)
    return found
