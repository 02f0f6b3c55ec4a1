"""Exact duplicate removal by a minimal perfect hash over known digests.

The distinct digests seen before ("history": earlier documents, or one half of the table's own
rows, drawn by row number) go into sharded minimal perfect hashes. Every slot holds
the full digest and the locator of the row that won it. A lookup computes one slot and
compares all bytes of the digest there: equal means the document repeats a known text,
anything else means it is new. New documents are grouped among themselves. Where the history is a part
of the table, repeats found in the other part may win over the row in the slot, so the slots are
then filled again with the final locators, and all rows of known texts read theirs from there.

A hash is a cascade of bit arrays: keys that meet no other key in an array rest there, the
others go on to the next array; the rank of a key's bit is its slot. All steps are numpy
operations over one shard. Shards are bounded by a target number of rows; the lookups of a
shard that a frequent text makes large are salted over several groups, each with a copy of
the shard's small index.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplytics.llm.common import SPACE_PATTERN, numbered, stored, text_or_empty

DIGEST_BYTES = 32
TARGET_ROWS = 50_000  # rows of a shard, and lookups of one group
MAX_LEVELS = 48


def normalised(column: str = "text") -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(text_or_empty(column), f"{SPACE_PATTERN}+", "")


def _positions(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each key (rows of two 64-bit numbers) in the array of a level."""
    with np.errstate(over="ignore"):
        x = keys[:, 0] ^ (keys[:, 1] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level) * np.uint64(0xD6E8FEB86659FD93))
        for _ in range(2):
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


def _keys(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests[:, 8:24]).view(np.uint64).reshape(-1, 2)


class PerfectHash:
    """Maps the distinct digests it was built from to 0..n-1, one each; other digests to anything or -1."""

    def __init__(self, digests: np.ndarray):
        self.levels: list[tuple[int, int, np.ndarray]] = []  # size, slots before it, packed bits
        left, before = np.arange(len(digests)), 0
        keys = _keys(digests)
        for level in range(MAX_LEVELS):
            if not len(left):
                break
            size = max(64, len(left) * 3 // 2)
            at = _positions(keys[left], level, size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((size, before, np.packbits(alone)))
            before += int(alone.sum())
            left = left[~alone[at]]
        # Keys that no array separates (equal in the 16 bytes that are hashed) are listed.
        self.rest = {digests[i].tobytes(): before + k for k, i in enumerate(left)}

    def slots(self, digests: np.ndarray) -> np.ndarray:
        out = np.full(len(digests), -1, np.int64)
        keys, left = _keys(digests), np.arange(len(digests))
        for level, (size, before, packed) in enumerate(self.levels):
            if not len(left):
                break
            bits = np.unpackbits(packed, count=size)
            rank = np.cumsum(bits, dtype=np.int64) - 1 + before
            at = _positions(keys[left], level, size)
            hit = bits[at] == 1
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        for i in left if self.rest else ():
            out[i] = self.rest.get(digests[i].tobytes(), -1)
        return out


def _bytes_array(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, DIGEST_BYTES)


def _build(group: pa.Table) -> pa.Table:
    digests = _bytes_array(group["digest"])
    hashed = PerfectHash(digests)
    slots = hashed.slots(digests)
    order = np.argsort(slots)
    locators = [group[c].to_numpy()[order].astype(np.int64).tobytes() for c in ("keep_row", "keep_id", "group_size")]
    return pa.table(
        {
            "shard": group["shard"].slice(0, 1),
            "hash": pa.array([pickle.dumps((hashed.levels, hashed.rest))], pa.binary()),
            "digests": pa.array([digests[order].tobytes()], pa.binary()),
            **{f"slot_{i}": pa.array([x], pa.binary()) for i, x in enumerate(locators)},
        }
    )


def _lookup(left: pa.Table, right: pa.Table) -> pa.Table:
    n = left.num_rows
    member = np.zeros(n, bool)
    values = np.zeros((3, n), np.int64)
    if n and right.num_rows:
        index = right.slice(0, 1).to_pylist()[0]
        hashed = PerfectHash.__new__(PerfectHash)
        hashed.levels, hashed.rest = pickle.loads(index["hash"])
        held = np.frombuffer(index["digests"], np.uint8).reshape(-1, DIGEST_BYTES)
        asked = _bytes_array(left["digest"])
        slots = hashed.slots(asked)
        at = np.maximum(slots, 0)
        member = (slots >= 0) & (held[at] == asked).all(axis=1)
        for i in range(3):
            values[i] = np.frombuffer(index[f"slot_{i}"], np.int64)[at]
    fields = {c: left[c] for c in ("row", "doc_id", "digest", "n_points")}
    found = {c: pa.array(values[i], pa.int64(), mask=~member) for i, c in enumerate(("keep_row", "keep_id", "group_size"))}
    return pa.table(fields | found)


FIELDS = "row long, doc_id long, digest binary, n_points long"


def digest_rows(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """A row number, the id, the SHA-256 of the normalised text and the code points of the text,
    stored, as later steps read it several times. No text is shuffled."""
    row = F.monotonically_increasing_id() if row is None else row
    digest = F.unhex(F.sha2(normalised().cast("binary"), 256))
    narrow = docs.select(
        row.alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        digest.alias("digest"),
        F.length(text_or_empty()).cast("long").alias("n_points"),
    )
    return stored(narrow, "digests", "none")


def winners(rows: DataFrame) -> DataFrame:
    """Per digest the row that stays: most code points, then smallest doc_id, then first row."""
    order = F.struct(F.col("n_points"), F.col("doc_id").isNotNull(), -F.col("doc_id"), -F.col("row"))
    best = F.max_by(F.struct("row", "doc_id"), order)
    return (
        rows.groupBy("digest")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", F.col("best.row").alias("keep_row"), F.col("best.doc_id").alias("keep_id"), "group_size")
    )


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


def build_index(known: DataFrame, shards: int) -> DataFrame:
    """One stored row per shard: hash, digests and locators by slot. ``known`` as ``winners`` gives it.

    A locator without id (a null doc_id won) is held as its row alone.
    """
    keyed = known.withColumn("shard", _shard(shards)).withColumn("keep_id", F.coalesce("keep_id", F.lit(-(2**63))))
    schema = "shard int, hash binary, digests binary, slot_0 binary, slot_1 binary, slot_2 binary"
    return stored(keyed.groupBy("shard").applyInArrow(_build, schema), "index", "none")


def look_up(rows: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """``rows`` with ``keep_row``, ``keep_id`` and ``group_size`` of the known text they repeat, else null."""
    keyed = rows.withColumn("shard", _shard(shards))
    hot = keyed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / TARGET_ROWS).cast("int").alias("salts")).filter("salts > 2")
    salts = F.coalesce("salts", F.lit(1))
    asked = keyed.join(hot, "shard", "left").withColumn("salt", F.pmod(F.xxhash64("row"), salts).cast("int")).drop("salts")
    held = index.join(hot, "shard", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    schema = f"{FIELDS}, keep_row long, keep_id long, group_size long"
    grouped = asked.groupBy("shard", "salt").cogroup(held.groupBy("shard", "salt"))
    return grouped.applyInArrow(_lookup, schema)


def shards_for(rows: DataFrame) -> int:
    return max(1, math.ceil(rows.count() / TARGET_ROWS))


NARROW = [field.split()[0] for field in FIELDS.split(", ")]


def _grouped(new: DataFrame) -> DataFrame:
    """Rows that repeat no known text, with the winners among themselves."""
    return new.join(winners(new), "digest").select(*NARROW, "keep_row", "keep_id", "group_size")


def _against(rows: DataFrame, shards: int, known: DataFrame) -> DataFrame:
    """``rows`` decided by a history apart from them."""
    found = stored(look_up(rows, build_index(known, shards), shards), "lookups", "none")
    new = found.filter(F.col("keep_row").isNull()).select(*NARROW)
    return found.filter(F.col("keep_row").isNotNull()).unionByName(_grouped(new))


def _by_halves(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` decided by one half as the history of the other."""
    early = F.pmod(F.xxhash64("row"), F.lit(2)) == 0
    history = rows.filter(early)
    asked = stored(look_up(rows.filter(~early), build_index(winners(history), shards), shards), "lookups", "none")
    known = history.unionByName(asked.filter(F.col("keep_row").isNotNull()).select(*NARROW))
    settled = look_up(known, build_index(winners(known), shards), shards)
    return settled.unionByName(_grouped(asked.filter(F.col("keep_row").isNull()).select(*NARROW)))


def exact_duplicates(docs: DataFrame, history: DataFrame | None = None, row: Column | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (and ``row``).

    Texts are equal when identical without ASCII white space; a null text is empty, and all
    empty texts are equal. Of equal texts the row with the most code points stays, then the
    smallest doc_id (null last), then the first of repeated rows, so exactly one row of each
    group is ``kept``. With ``history`` (earlier documents), rows that repeat one of its texts
    are not kept, ``keep_id`` is the winner there and ``group_size`` its group's. An empty
    table gives no rows; further columns are ignored.
    """
    rows = digest_rows(docs, row)
    shards = shards_for(rows)
    if history is None:
        out = _by_halves(rows, shards)
    else:
        # Rows of the history are numbered apart, below zero, so none of them is a row of ``docs``.
        out = _against(rows, shards, winners(digest_rows(history).withColumn("row", -1 - F.col("row"))))
    none = F.lit(-(2**63))
    return out.select(
        "row",
        "doc_id",
        F.when(F.col("keep_id") != none, F.col("keep_id")).alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows, name = numbered(docs)
    dropped = exact_duplicates(rows, row=F.col(name)).filter(~F.col("kept")).select(F.col("row").alias(name))
    return rows.join(dropped, name, "left_anti").drop(name)
