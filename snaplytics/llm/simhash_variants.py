"""Near duplicates by SimHash, found through deletion-variant signatures.

Two 64-bit fingerprints that differ in at most four bits are cut into three segments; one of
the segments then differs in at most one bit. Leaving out each bit of a segment in turn gives
variants of which one is equal for both. So every distinct fingerprint is indexed under 64
keys (a left-out bit and the other bits of its segment), rows meet by equality of the key,
and every pair that meets is verified by counting its differing bits.

Equal fingerprints are one row from the start. Rows with equal keys lie side by side after
one shuffle and sort and are compared in numpy blocks; of the links of a block only a
spanning forest goes on, so a large group of near copies makes as many rows as it has
members, not pairs. Long runs of one key are cut again by the variants of the other segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplytics.llm.common import numbered, stored, text_or_empty
from snaplytics.llm.components import components, spanning_edges

MAX_DISTANCE = 4
SEGMENTS = ((0, 22), (22, 43), (43, 64))  # a third of four differing bits is at most one
SHINGLE_WORDS = 4
SEED = 42
BLOCK = 65_536
LONG_RUN = 32_768


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """SimHash of the word shingles: a bit is 1 if set in over half of the shingles' hashes."""
    words = text.lower().split()  # bytes: lowers A-Z only, cuts at ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    n = max(1, len(words) - width + 1)
    starts = (ends - lengths + 1)[:n].tolist()
    stops = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        pieces = zip(starts[i : i + BLOCK], stops[i : i + BLOCK])
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in pieces), np.uint64, min(BLOCK, n - i))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(t) for t in batch.column(2).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))], ["row", "doc_id", "fp"])


def variant_keys(fp: Column) -> Column:
    """The 64 keys of a fingerprint: the left-out bit's number, and the rest of its segment."""
    keys = []
    for start, end in SEGMENTS:
        part = F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << (end - start)) - 1))
        for bit in range(end - start):
            keys.append(part.bitwiseAND(F.lit(((1 << (end - start)) - 1) ^ (1 << bit))).bitwiseOR(F.lit((start + bit) << 32)))
    return F.array(*keys)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= MAX_DISTANCE


def linked(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of ``fps`` (distinct, of one key) under links of at most four bits."""
    return _forest(fps) if len(fps) <= LONG_RUN else _linked_by_parts(fps)


def _forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint reached is compared once with those not reached yet, so links are found and dropped
    from the search as they come: a dense group is soon used up, and no list of pairs is held."""
    found_a, found_b, waiting, left = [fps[:0]], [fps[:0]], [], fps
    while len(left):
        if waiting:
            now = waiting.pop()
        else:
            now, left = left[0], left[1:]
        near = _near(now, left)
        reached = left[near]
        if len(reached):
            found_a.append(np.full(len(reached), now))
            found_b.append(reached)
            waiting.extend(reached)
            left = left[~near]
    return np.concatenate(found_a), np.concatenate(found_b)


def _linked_by_parts(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a long run: the same cut on all 64 bits in six parts. Four differing bits leave two of
    six parts equal, so the pairs of parts are keys of 20 to 22 bits; what one of them holds is searched by
    itself, and what all of them link is reduced to a forest after each pair."""
    cuts = [0, 11, 22, 33, 43, 54, 64]
    masks = [np.uint64((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:])]
    a, b = fps[:0], fps[:0]
    for i in range(6):
        for j in range(i + 1, 6):
            key = fps & (masks[i] | masks[j])
            order = np.argsort(key, kind="stable")
            own = fps[order]
            found = [_forest(same) for same in np.split(own, np.flatnonzero(np.diff(key[order])) + 1) if len(same) > 1]
            a, b = spanning_edges(np.concatenate([a, *[x for x, _ in found]]), np.concatenate([b, *[y for _, y in found]]))
    return a, b


def _edges_of(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges among rows of equal key; rows are sorted by key."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    lengths = np.diff(np.append(first, len(keys)))
    run = np.repeat(lengths, lengths)
    found_a, found_b = [fps[:0]], [fps[:0]]
    short = np.flatnonzero((run > 1) & (run <= 64))
    k, f = keys[short], fps[short]
    for step in range(1, 64):
        same = np.flatnonzero(k[step:] == k[:-step]) if len(k) > step else short[:0]
        if not len(same):
            break
        near = same[_near(f[same], f[same + step])]
        found_a.append(f[near])
        found_b.append(f[near + step])
    for start, n in zip(first[lengths > 64], lengths[lengths > 64]):
        a, b = linked(fps[start : start + n])
        found_a.append(a)
        found_b.append(b)
    return spanning_edges(np.concatenate(found_a), np.concatenate(found_b))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) come sorted by key; whole runs are compared, the last one waits for its rest."""
    held, rows = [], 0

    def emit(keys, fps):
        a, b = _edges_of(keys, fps.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        rows += batch.num_rows
        if rows >= 500_000:
            keys, fps = (np.concatenate(x) for x in zip(*held))
            whole = int(np.searchsorted(keys, keys[-1]))
            held, rows = [(keys[whole:], fps[whole:])], 0
            if whole:
                yield emit(keys[:whole], fps[:whole])
    if held and sum(len(k) for k, _ in held):
        yield emit(*(np.concatenate(x) for x in zip(*held)))


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints ``fp`` wherever links of four bits do."""
    keyed = distinct.select(F.explode(variant_keys(F.col("fp"))).alias("key"), "fp")
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_links, "u long, v long")


def _members(docs: DataFrame, row: Column) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, fp) of ``docs``, and per distinct ``fp`` its component's ``root`` (a
    fingerprint of it) and the ``least`` doc_id of the fingerprint."""
    texts = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    prints = stored(texts.mapInArrow(_fingerprints, "row long, doc_id long, fp long"), "fingerprints", "none")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    return prints, distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint, component_id (smallest doc_id linked to it, over any
    number of links), and the row number given by ``row``.

    A null text counts as empty; texts without a word have the fingerprint zero and are linked
    with each other like any others. A null doc_id is no component's smallest unless all its
    documents have none. Repeated rows are rows of one component. An empty table gives no rows;
    further columns are ignored.
    """
    prints, by_fp = _members(docs, F.lit(None).cast("long") if row is None else row)
    least = by_fp.groupBy("root").agg(F.min("least").alias("component_id"))
    component = by_fp.join(least, "root").select("fp", "component_id")
    return prints.join(component, "fp").select(
        "row", "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of every component, all columns unchanged: the one with the smallest doc_id (null
    last), of equal ids the first. Components are told apart by their root, as ids may repeat."""
    rows, name = numbered(docs)
    prints, by_fp = _members(rows, F.col(name))
    found = stored(prints.join(by_fp.select("fp", "root"), "fp").select("row", "doc_id", "root"), "components", "none")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    stays = found.groupBy("root").agg(best.alias("best")).select(F.col("best.row").alias("row"))
    others = found.join(stays, "row", "left_anti").select(F.col("row").alias(name))
    return rows.join(others, name, "left_anti").drop(name)
