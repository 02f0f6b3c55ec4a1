"""Repeated passages by suffix sorting: bytes covered by a long string that starts elsewhere too.

A passage is a string of LENGTH bytes. Sorting every suffix of a corpus would move it many
times over, so suffixes are anchored first: of the KGRAM-byte strings in a passage, those with
the smallest hash are its anchors. Equal passages have equal anchors at equal places, so only
suffixes that begin at an anchor need meet, about one in sixty bytes.

1. Each task finds the anchors of its texts and a hash of every anchor's surroundings, which are
   all bytes that a passage over the anchor can hold. Surroundings that occur twice are
   covered whole; of those in some thousand texts, only one goes on.
2. Anchors meet by hash. Equal surroundings are covered; of the distinct ones that share an
   anchor, the bytes are fetched, as they may agree in part.
3. Groups of one anchor are sorted: the suffixes by multikey quicksort to a shallow depth and
   beyond it by blind tries (deep-shallow sorting), and likewise the reversed texts
   before the anchor. Joining neighbours in the order of their common prefixes finds, for
   each place, the longest agreement to both sides of at least LENGTH bytes.
4. Groups too large for one task are not sorted but cut into their passages, which meet by hash.

Copies and boilerplate thus cost one representative per some thousand texts, not pairs, and no text is
compared with all others.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplytics.llm.common import stored, text_or_empty

LENGTH = 200
KGRAM = 32
REACH = LENGTH - KGRAM  # bytes before an anchor that a passage over it can hold
SHALLOW = 16  # bytes that quicksort looks at before tries take over
LARGE_GROUP = 20_000  # distinct surroundings of one anchor sorted in one task
CHUNK = 300_000  # rows compared at once
TEXTS_AT_ONCE = 2_048  # texts whose anchors meet before the shuffle


# Anchors -----------------------------------------------------------------------------------------


def kgram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the KGRAM bytes from each place, by doubling."""
    hashes, factor, width = data.astype(np.uint64) + np.uint64(1), np.uint64(0x100000001B3), 1
    with np.errstate(over="ignore"):
        while width < KGRAM:
            hashes = hashes[:-width] * factor + hashes[width:]
            factor, width = factor * factor, 2 * width
        hashes ^= hashes >> np.uint64(29)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        return hashes ^ (hashes >> np.uint64(32))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    out, done = values, 1
    while 2 * done <= width:
        out, done = pick(out[:-done], out[done:]), 2 * done
    return pick(out[: len(out) - (width - done)], out[width - done :]) if done < width else out


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose hash is the smallest in some passage around them (all of equal ones), and the hashes."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = kgram_hashes(data)
    least = _sliding(hashes, REACH + 1, np.minimum)
    edge = np.zeros(REACH, np.uint64)
    places = np.flatnonzero(hashes == _sliding(np.concatenate([edge, least, edge]), REACH + 1, np.maximum))
    return places, hashes[places]


# Deep-shallow sorting ----------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differing = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differing.bit_length() + 7) // 8


class BlindTrie:
    """Orders texts that agree far: a trie of branching places only. A text goes down by the bytes
    at these places, unchecked, is compared with one leaf, and is put in where the two part."""

    def __init__(self, texts: Sequence[bytes], first: int):
        self.texts = texts
        self.root: list = [len(texts[first]), {-1: [first]}]  # depth, then nodes by next byte; -1: texts that end here

    def _byte(self, text: bytes, depth: int) -> int:
        return text[depth] if depth < len(text) else -1

    def add(self, own: int) -> None:
        text, node = self.texts[own], self.root
        while True:
            children = node[1]
            below = children.get(self._byte(text, node[0]))
            if below is None:
                below = next(iter(children.values()))
            if isinstance(below[0], int) and len(below) > 1 and isinstance(below[1], dict):
                node = below
            else:
                leaf = below[0]
                break
        agreed = common_prefix(text, self.texts[leaf])
        parent, node = None, self.root
        while node[0] < agreed:
            step = self._byte(text, node[0])
            below = node[1].get(step)
            if below is None or not (len(below) > 1 and isinstance(below[1], dict)):
                break
            parent, node = (node, step), below
        if node[0] > agreed:  # the text leaves above this node
            split = [agreed, {self.texts[leaf][agreed]: node, self._byte(text, agreed): [own]}]
            if parent is None:
                self.root = split
            else:
                parent[0][1][parent[1]] = split
            return
        step = self._byte(text, node[0])
        below = node[1].get(step)
        if below is None:
            node[1][step] = [own]
        elif agreed == len(text) == len(self.texts[below[0]]):
            below.append(own)
        else:
            node[1][step] = [agreed, {self._byte(self.texts[below[0]], agreed): below, self._byte(text, agreed): [own]}]

    def ordered(self) -> tuple[list[int], list[int]]:
        """All texts in order, and the common prefix of each with the one before."""
        order, agreed = [], []
        stack: list[tuple[list, int]] = [(self.root, 0)]
        while stack:
            node, before = stack.pop()
            if len(node) > 1 and isinstance(node[1], dict):
                steps = sorted(node[1])
                stack += [(node[1][s], node[0]) for s in reversed(steps[1:])] + [(node[1][steps[0]], before)]
            else:
                order += node
                agreed += [before, *[len(self.texts[node[0]])] * (len(node) - 1)]
        return order, agreed


def deep_shallow_sort(texts: Sequence[bytes], depth: int = 0) -> tuple[list[int], list[int]]:
    """The order of ``texts``, which agree in the first ``depth`` bytes, and the common prefix of each with the one before."""
    order: list[int] = []
    agreed: list[int] = []

    def put(group: list[int], lengths: list[int]) -> None:
        if order:
            lengths = [common_prefix(texts[order[-1]], texts[group[0]]), *lengths[1:]]
        order.extend(group)
        agreed.extend(lengths)

    stack = [(list(range(len(texts))), depth)]
    while stack:
        group, at = stack.pop()
        if len(group) == 1:
            put(group, [0])
        elif at >= depth + SHALLOW:
            trie = BlindTrie(texts, group[0])
            for i in group[1:]:
                trie.add(i)
            put(*trie.ordered())
        else:
            keys = [texts[i][at : at + 8] for i in group]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            smaller = [i for i, k in zip(group, keys) if k < pivot]
            equal = [i for i, k in zip(group, keys) if k == pivot]
            larger = [i for i, k in zip(group, keys) if k > pivot]
            if larger:
                stack.append((larger, at))
            if len(pivot) < 8 or len(equal) == 1:  # texts that end here are equal
                stack.append((equal, depth + SHALLOW) if len(equal) > 1 else (equal, at))
            else:
                stack.append((equal, at + 8))
            if smaller:
                stack.append((smaller, at))
    return order, agreed


def agreements(before: Sequence[bytes], after: Sequence[bytes], length: int = LENGTH, shared: int = KGRAM) -> list[tuple[int, int]]:
    """For places that share the ``shared`` bytes after them: how far the union of the passages
    that another place has too reaches to the left and right; (0, 0) if there is none.

    Places are joined in descending order of their common suffix text. At every join the
    smaller side is put into the larger one's order of reversed texts; the two neighbours found there
    agree most to the left, at this agreement to the right.
    """
    left, right = [0] * len(after), [0] * len(after)
    reversed_before = [b[::-1] for b in before]

    def meet(a: int, b: int, r: int) -> None:
        agreed = common_prefix(reversed_before[a], reversed_before[b])
        if agreed + r >= length:
            for i in (a, b):
                left[i], right[i] = max(left[i], agreed), max(right[i], r)

    if len(after) == 2:
        meet(0, 1, common_prefix(after[0], after[1]))
        return list(zip(left, right))
    order, agreed = deep_shallow_sort(after, shared)
    rank = [0] * len(after)
    for place, i in enumerate(deep_shallow_sort(reversed_before)[0]):
        rank[i] = place
    by_rank = sorted(range(len(after)), key=rank.__getitem__)
    group = list(range(len(after)))  # of a place in ``order``, by union-find

    def find(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    members = {x: [rank[i]] for x, i in enumerate(order)}
    for x in sorted(range(1, len(order)), key=agreed.__getitem__, reverse=True):
        r = agreed[x]
        if r + REACH < length:
            break
        a, b = find(x - 1), find(x)
        large, small = (a, b) if len(members[a]) >= len(members[b]) else (b, a)
        into = members[large]
        for own in members.pop(small):
            at = bisect_left(into, own)
            if at > 0:
                meet(by_rank[into[at - 1]], by_rank[own], r)
            if at < len(into):
                meet(by_rank[into[at]], by_rank[own], r)
            into.insert(at, own)
        group[small] = large
    return list(zip(left, right))


# Steps -------------------------------------------------------------------------------------------

DOCUMENT, COVERED, ANCHOR = 0, 1, 2
FOUND = "kind int, ref long, a long, b long, h long, c long, many boolean, doc_id long, text_key binary"


def _rows(kind: int, ref, a=None, b=None, h=None, c=None, many=None, doc_id=None, text_key=None) -> pa.RecordBatch:
    n = len(ref)
    types = (pa.int32(), *[pa.int64()] * 5, pa.bool_(), pa.int64(), pa.binary())
    values = (np.full(n, kind, np.int32), ref, a, b, h, c, many, doc_id, text_key)
    arrays = [pa.nulls(n, t) if v is None else pa.array(v, t) for v, t in zip(values, types)]
    return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in FOUND.split(", ")])


def _merged(ref: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each ref joined where they touch."""
    order = np.lexsort((start, ref))
    ref, start, stop = ref[order], start[order], stop[order]
    if not len(ref):
        return ref, start, stop
    first = np.concatenate([[True], ref[1:] != ref[:-1]])
    base = np.cumsum(first) * (1 << 40)  # keeps refs apart in the running maximum
    reach = np.maximum.accumulate(stop + base) - base
    new = first | np.concatenate([[True], start[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return ref[at], start[at], np.maximum.reduceat(stop, at)


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1. A document's ref is its task and place; ``a`` and ``b`` are the bounds of what is covered.
    For an anchor, ``a`` holds its place, and how many bytes before and after it count, in the two low bytes."""
    ref = TaskContext.get().partitionId() << 33
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            part = batch.slice(at, TEXTS_AT_ONCE)
            yield from _anchored_texts(ref, part.column(0), part.column(1).to_pylist())
            ref += part.num_rows


def _anchored_texts(ref: int, ids: pa.Array, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    refs = np.arange(ref, ref + len(texts))
    yield _rows(DOCUMENT, refs, doc_id=ids, text_key=[hashlib.md5(t).digest() for t in texts])
    found = []
    for own_ref, text in zip(refs, texts):
        places, hashes = anchors(np.frombuffer(text, np.uint8))
        if len(places):
            start = np.maximum(places - REACH, 0)
            stop = np.minimum(places + LENGTH, len(text))
            around = zip((places - start).tolist(), start.tolist(), stop.tolist())
            own = np.fromiter((xxhash.xxh3_64_intdigest(text[s:e], at) for at, s, e in around), np.uint64, len(places))
            found.append((np.full(len(places), own_ref), places, start, stop, hashes, own))
    if not found:
        return
    refs, places, start, stop, h, c = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(h)))
    repeated = order[np.repeat(counts > 1, counts)]
    yield _rows(COVERED, *_merged(refs[repeated], start[repeated], stop[repeated]))
    one = order[at]
    packed = places[one] << 16 | (places[one] - start[one]) << 8 | stop[one] - places[one]
    yield _rows(ANCHOR, refs[one], packed, None, h[at].view(np.int64), c[at].view(np.int64), counts > 1)


def _unpacked(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return packed >> 16, packed >> 8 & 0xFF, packed & 0xFF  # place, bytes before, bytes after


def _runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Rows sorted by their first column, in tables that never cut a value's rows apart."""
    held, n, wanted = [], 0, rows
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= wanted:
            whole = pa.Table.from_batches(held).combine_chunks()
            keys = whole.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield whole.slice(0, cut)
            held, n = whole.slice(cut).to_batches(), whole.num_rows - cut
            wanted = max(rows, 2 * n)  # a long run is not copied again for every batch
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


MET = "kind int, ref long, a long, b long, h long, c long, large boolean"
NEEDED = 3


def _bounded_runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.Table, int | None]]:
    """As ``_runs``, but an anchor of more rows is cut between two surroundings; with each table the
    anchor, if any, of which it holds a part only."""
    held, n, part_of = [], 0, None
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        while n >= rows:
            whole = pa.Table.from_batches(held).combine_chunks()
            h, c = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            known = part_of
            if not cut:  # one anchor fills it
                known = part_of = int(h[0])
                cut = int(np.searchsorted(c, c[-1])) or len(c)
                if cut == len(c):
                    break  # equal surroundings stay together: there is one row for some thousand texts at most
            yield whole.slice(0, cut), known
            held, n = whole.slice(cut).to_batches(), whole.num_rows - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks(), part_of


def _met(batches: Iterator[pa.RecordBatch], large_group: int, rows: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Step 2 over rows sorted by (h, c): what is covered, and the surroundings whose bytes are needed.

    An anchor of more than ``rows`` rows is large; it is taken in parts, so memory is bounded."""
    for table, part_of in _bounded_runs(batches, rows):
        h, c, ref, packed = (table.column(i).to_numpy() for i in range(4))
        many = table.column(4).to_numpy()
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        new = new_h | np.concatenate([[True], c[1:] != c[:-1]])
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(h)))
        repeated = np.repeat((counts > 1) | np.logical_or.reduceat(many, at), counts)
        place, before, after = _unpacked(packed)
        ref_c, start, stop = _merged(ref[repeated], (place - before)[repeated], (place + after)[repeated])
        names = [f.split()[0] for f in MET.split(", ")]
        none = lambda n, t=pa.int64(): pa.nulls(n, t)
        n = len(ref_c)
        kind = pa.array(np.full(n, COVERED, np.int32))
        yield pa.RecordBatch.from_arrays([kind, pa.array(ref_c), pa.array(start), pa.array(stop), none(n), none(n), none(n, pa.bool_())], names)
        heads = np.flatnonzero(new_h[at])
        distinct = np.diff(np.append(heads, len(at)))
        size = np.repeat(distinct, distinct)
        if part_of is not None:
            size[h[at] == part_of] = large_group + 2  # more of it lies in other parts
        need = at[size > 1]
        n = len(need)
        kind = pa.array(np.full(n, NEEDED, np.int32))
        large = pa.array(size[size > 1] > large_group)
        yield pa.RecordBatch.from_arrays([kind, pa.array(ref[need]), pa.array(packed[need]), none(n), pa.array(h[need]), pa.array(c[need]), large], names)


BYTES = "h long, c long, ref long, place long, before binary, after binary"


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around the needed places of each text. Repeated rows come with the needs of all of them, so the
    first one of a task serves the others, too."""
    seen = set()
    for batch in batches:
        for doc_id, key, text, needs in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3)):
            if (doc_id, key) in seen:
                continue
            seen.add((doc_id, key))
            own = needs.values
            place, before, after = _unpacked(own.field("a").to_numpy())
            bounds = list(zip(place.tolist(), before.tolist(), after.tolist()))
            arrays = [
                own.field("h"), own.field("c"), own.field("ref"), pa.array(place),
                pa.array([text[p - b : p] for p, b, _ in bounds], pa.binary()),
                pa.array([text[p : p + a] for p, _, a in bounds], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in BYTES.split(", ")])


SPAN = "ref long, a long, b long"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3 over rows sorted by (h, c)."""
    for table in _runs(batches, CHUNK // 10):
        h, c, ref, place = (table.column(i).to_numpy() for i in range(4))
        before, after = table.column(4).to_pylist(), table.column(5).to_pylist()
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        out = []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(h)]):
            # Rows of repeated documents bring the same surroundings again.
            own = [i for i in range(s, e) if i == s or c[i] != c[i - 1]]
            if len(own) > 1:
                found = agreements([before[i] for i in own], [after[i] for i in own])
                out += [(ref[i], place[i] - left, place[i] + right) for i, (left, right) in zip(own, found) if right]
        columns = np.array(out, np.int64).reshape(-1, 3).T
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["ref", "a", "b"])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4: all passages over an anchor, by a hash of 128 bits."""
    for batch in batches:
        ref, place = (batch.column(i).to_numpy() for i in (2, 3))
        for i, (before, after) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
            text = before + after
            starts = range(max(0, len(before) + KGRAM - LENGTH), min(len(before), len(text) - LENGTH) + 1)
            keys = b"".join(xxhash.xxh3_128_digest(text[s : s + LENGTH]) for s in starts)
            k1, k2 = np.frombuffer(keys, np.int64).reshape(-1, 2).T
            at = np.arange(starts.start, starts.stop) + place[i] - len(before)
            arrays = [pa.array(np.ascontiguousarray(x)) for x in (k1, k2, np.full(len(at), ref[i]), at)]
            yield pa.RecordBatch.from_arrays(arrays, ["k1", "k2", "ref", "a"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lengths, removed runs and the hash of what stays."""
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    for batch in batches:
        rows = []
        for text, a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            spans = spans_of(a, b)
            removed = sum(e - s for s, e in spans)
            rows.append((len(text), removed, len(spans), hashlib.sha256(without(text, spans)).hexdigest()))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)


def spans_of(a: list[int] | None, b: list[int] | None) -> list[tuple[int, int]]:
    """Maximal runs of the intervals (a, b)."""
    if not a:
        return []
    starts, stops = np.array(a), np.array(b)
    _, starts, stops = _merged(np.zeros(len(starts), np.int64), starts, stops)
    return list(zip(starts.tolist(), stops.tolist()))


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for span in spans for x in span], len(text)]
    return b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2]))


def _same_text(left: DataFrame, right: DataFrame) -> Column:
    return left["text_key"].eqNullSafe(right["text_key"]) & left["doc_id"].eqNullSafe(right["doc_id"])


def covered_spans(texts: DataFrame, large_group: int = LARGE_GROUP) -> DataFrame:
    """(doc_id, text_key, a, b): the covered intervals of every text of ``texts`` (doc_id, text as binary) that has some."""
    found = stored(texts.mapInArrow(_anchored, FOUND), "anchors")
    documents = found.filter(f"kind = {DOCUMENT}").select("ref", "doc_id", "text_key")
    places = found.filter(f"kind = {ANCHOR}").select("h", "c", "ref", "a", "many")
    met = stored(places.repartition("h").sortWithinPartitions("h", "c").mapInArrow(partial(_met, large_group=large_group), MET), "met")
    # The texts cross one shuffle, by id and hash; every join with them in this plan and the caller's reuses it.
    keyed = texts.withColumn("text_key", F.unhex(F.md5("text")))

    def surroundings(large: bool) -> DataFrame:
        needs = met.filter((F.col("kind") == NEEDED) & (F.col("large") == large)).join(documents, "ref")
        needs = needs.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("h", "c", "ref", "a")).alias("needs"))
        joined = keyed.join(needs, _same_text(keyed, needs))
        return joined.select(keyed["doc_id"], keyed["text_key"], "text", "needs").mapInArrow(_fetched, BYTES)

    passages = surroundings(True).mapInArrow(_passages, "k1 long, k2 long, ref long, a long")
    # Two ends that differ are two places; repeated documents bring the same place twice.
    ends = passages.groupBy("k1", "k2").agg(F.min(F.struct("ref", "a")).alias("first"), F.max(F.struct("ref", "a")).alias("last"))
    repeated = ends.filter("first <> last").select("k1", "k2")
    spans = [
        found.filter(f"kind = {COVERED}").select("ref", "a", "b"),
        met.filter(f"kind = {COVERED}").select("ref", "a", "b"),
        passages.join(repeated, ["k1", "k2"]).select("ref", "a", (F.col("a") + LENGTH).alias("b")),
        surroundings(False).repartition("h").sortWithinPartitions("h", "c").mapInArrow(_compared, SPAN),
    ]
    every = spans[0].unionByName(spans[1])
    for more in spans[2:]:
        every = every.unionByName(more)
    per_text = every.join(documents, "ref").groupBy("doc_id", "text_key")
    # Repeated rows bring the same spans.
    return per_text.agg(F.collect_set(F.struct("a", "b")).alias("spans")).select("doc_id", "text_key", F.col("spans.a").alias("a"), F.col("spans.b").alias("b"))


def remove_passages(docs: DataFrame, large_group: int = LARGE_GROUP) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte covered by a string of LENGTH bytes that also starts anywhere else, in any text, the same one
    included, is removed; what is left is hashed. Passages never span texts. A null text is
    empty, and texts below LENGTH bytes lose nothing. Repeated rows are texts of their own, so they
    repeat each other. A null doc_id stays null. An empty table gives no rows; further columns are
    ignored. ``large_group`` is the number of distinct surroundings of an anchor from which passages meet by hash.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    spans = covered_spans(texts, large_group)
    keyed = texts.withColumn("text_key", F.unhex(F.md5("text")))
    joined = keyed.join(spans, _same_text(keyed, spans), "left").select(keyed["doc_id"], "text", "a", "b")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
