"""Alignment of two tokenizers' ids, with corpus-wide counts of the id pairs that overlap.

Both tokenizers cut the same bytes. Places where tokens of both end cut a text into groups; two
tokens are linked where their byte ranges overlap. A pair of ids counts the documents that
hold it linked, and a document gets back the counts of its own links and how many are the highest of their first id.

Counting is external. The pair-document records of a chunk of documents (of bounded size) are combined per pair,
parted by a radix of the first id and written as sorted zstd runs. Runs of one radix are merged
by a heap over their frames, a bounded number at a time, level by level; the merged run lists pairs side by
side per first id, which yields the maxima. The way back is the same: every run is looked up in the
merged run of its radix, and a chunk's documents add up what comes back. So a pair that
every document holds crosses the shuffle once per chunk, and a task holds at most one chunk, the
runs of one merge, or the pairs of one radix, which the two vocabularies bound.

Spark's shuffle and the stored tables hold the runs; nothing lies in an executor's own folder.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplytics.llm.cached_tokens import BYTE_LETTERS, ODD_SPACE, CachedTokenizer
from snaplytics.llm.common import stored

RADIX = 64
CHUNK_RECORDS = 1_000_000  # pair-document records of a chunk
FAN_IN = 64  # chunks whose runs are merged at a time
FRAME = 16_384  # pairs of a compressed frame
MAX_UNITS = 200_000  # units of text that a worker holds; further ones are aligned each time
MAX_UNIT = 64
LUMP = 512  # new units that are encoded at once
TEXTS_AT_ONCE = 256
BLANK = "▁"
BARE = {"", "\n"}  # units that come from a blank or line break beside another one, or at a text's end
LONG_BLANK = re.compile(r"(?<!\s)\s{1000}")  # merging by ranks fails on a million
ODD = re.compile(f"[\t\r\x0b\x0c]|{ODD_SPACE.pattern}")
WHOLE = "\t"  # before a text that is not cut; those that are cut hold none
FRAME_HEAD = struct.Struct("<II")  # pairs, compressed bytes
DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

Frame = tuple[np.ndarray, np.ndarray]  # ascending pair keys, their counts


# Alignment


@dataclass(frozen=True)
class Aligned:
    """A text cut into the same bytes by both: numbers of ids, groups and links, links as 32-bit pair keys, hash of the groups."""

    n_a: int
    n_b: int
    n_groups: int
    links: np.ndarray
    groups_sha256: str


class Aligner:
    """Ids of both tokenizers and their links. ``None`` stands for texts that are not cut into the same bytes.

    A single blank between other characters starts a token in both vocabularies, and so does a line
    break, so texts are cut there into units. Both have an end where a unit ends, so a text's groups and links are those
    of its units in a row, and each distinct unit is encoded and aligned once per worker. Where
    other white space might matter, or a vocabulary has tokens across blanks, a text is a unit of its own.
    """

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        cached = CachedTokenizer(path_a)
        self.a, self.merge, self.unsure = cached.tokenizer, cached.merge, cached.unsure
        byte_of = {letter: b for b, letter in BYTE_LETTERS.items()}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        self.b = SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces)
        self.blank = self.b.piece_to_id(BLANK)
        self.sizes = tuple(np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        # An id as text, with what stands behind it inside its group's side, and at that side's end.
        self.names = [f"{i}{end}" for n, last in ((len(self.a_bytes), "|"), (len(self.b_bytes), ";")) for i in range(n) for end in (",", last)]
        self.name_sizes = np.fromiter(map(len, self.names), np.int64, len(self.names))
        # Units that are held, and by place: numbers of ids of both, groups and links, the links side by side, the groups.
        # Behind them stand those of the last texts only.
        self.places: dict[str, int] = {}
        self.counts, self.links, self.groups = np.empty((4, 0), np.int64), np.empty(0, "<u4"), []

    def _odd(self, units: set[str]) -> set[str]:
        """Those of the units that show that their text can't be cut at blanks."""
        if not self.cuts:
            return units
        if units.isdisjoint(BARE) and not ODD.search(" ".join(units)):
            return set()
        return {u for u in units if u in BARE or ODD.search(u)}

    def _placed(self, texts: Sequence[str | None]) -> list[list[int]]:
        """Per text the places of its units: what stands behind a blank, a line break and what stands behind it, or WHOLE
        and the text. A held unit has no odd white space, so only new ones are searched for it."""
        cut = [t.replace("\n", " \n").split(" ") if t else [] for t in texts]
        placed = [list(map(self.places.get, units)) for units in cut]
        lacking = [n for n, own in enumerate(placed) if None in own]
        new = {u for n in lacking for u, x in zip(cut[n], placed[n]) if x is None}
        odd = self._odd(new)
        whole = [n for n in lacking if not odd.isdisjoint(cut[n])] if odd else []
        for n in whole:
            cut[n], placed[n] = [WHOLE + texts[n]], [None]
        if whole:
            new = {u for n in lacking for u, x in zip(cut[n], placed[n]) if x is None}
        self._add(new)
        for n in lacking:
            placed[n] = [self.added[u] if x is None else x for u, x in zip(cut[n], placed[n])]
        return placed

    def _add(self, new: set[str]) -> None:
        held = len(self.places)
        plain = [u for u in new if u[0] != WHOLE]
        if self.unsure.search(" ".join(plain)):  # those that merge by ranks in lumps of their own
            plain.sort(key=lambda u: self.unsure.search(u) is not None)
        stay = [u for u in plain if len(u) <= MAX_UNIT][: max(0, MAX_UNITS - held)]
        others = set(stay)
        plain = stay + [u for u in plain if u not in others]
        whole = [u for u in new if u[0] == WHOLE]
        self.added = {u: held + i for i, u in enumerate(plain + whole)}
        self.places.update((u, self.added[u]) for u in stay)
        counts, links, groups = self._aligned([plain[at : at + LUMP] for at in range(0, len(plain), LUMP)] + [[u] for u in whole])
        kept = self.counts[:, :held]
        self.counts, self.links = np.concatenate([kept, counts], 1), np.concatenate([self.links[: kept[3].sum()], links])
        self.groups[held:] = groups

    def _encoded(self, units: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids of both, and the units' numbers of bytes: of all at once, or of parts, where one gives back other bytes."""
        is_whole = units[0][0] == WHOLE
        text = " " + units[0][1:] if is_whole else (" " + " ".join(units)).replace(" \n", "\n")
        raw = np.frombuffer(text.encode(), np.uint8)
        starts = np.zeros(1, np.int64) if is_whole else np.flatnonzero((raw == ord(" ")) | (raw == ord("\n")))
        if self.merge is None or self.unsure.search(text) or is_whole and LONG_BLANK.search(text):
            a = self.a.encode(text, add_special_tokens=False).ids
        else:
            a = np.frombuffer(self.merge(text), "<u2").tolist()
        b = self.b.encode(text.removeprefix(" "))
        if text[0] == "\n" and b[0] == self.blank:  # no blank stands before a line break
            b = b[1:]
        given, sizes = raw.tobytes(), np.diff(starts, append=len(raw))
        if b"".join(map(self.a_bytes.__getitem__, a)) == given and b"".join(map(self.b_bytes.__getitem__, b)) == given:
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            ends = np.cumsum(sizes)
            if len(units) == 1 or all(np.isin(ends, np.cumsum(own[ids])).all() for own, ids in zip(self.sizes, (a, b))):
                return [(a, b, sizes)]
        if len(units) == 1:
            return [(np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1, np.int64))]
        step = -(-len(units) // 16)
        return [x for at in range(0, len(units), step) for x in self._encoded(units[at : at + step])]

    def _aligned(self, lumps: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Units one after the other in one sequence of bytes. Both tokenizers' ends cut it into
        stretches; each stretch lies in one token of either, and so is one link. Units with other bytes have no ids."""
        if not lumps:
            return np.empty((4, 0), np.int64), np.empty(0, "<u4"), []
        a, b, sizes = map(np.concatenate, zip(*[x for lump in lumps for x in self._encoded(lump)]))
        unit_ends, ends_a, ends_b = np.cumsum(sizes), np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        twice = ends[1:] == ends[:-1]
        stretches, groups = ends[np.concatenate([ends[:1] > 0, ~twice])], ends[1:][twice]
        links = (a[np.searchsorted(ends_a, stretches)] << 16 | b[np.searchsorted(ends_b, stretches)]).astype("<u4")
        own = [np.diff(np.searchsorted(x, unit_ends, "right"), prepend=0) for x in (ends_a, ends_b, groups, stretches)]
        return np.array(own), links, self._written_groups(a, b, ends_a, ends_b, groups, own[0] + own[1])

    def _written_groups(self, a, b, ends_a, ends_b, groups, tokens) -> list[str]:
        group_a, group_b = np.searchsorted(groups, ends_a), np.searchsorted(groups, ends_b)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        names = np.concatenate([2 * a + (groups[group_a] == ends_a), 2 * (len(self.a_bytes) + b) + (groups[group_b] == ends_b)])[order]
        written = "".join(map(self.names.__getitem__, names.tolist()))
        ends = np.cumsum(np.append(0, self.name_sizes[names]))[np.cumsum(tokens)].tolist()
        return [written[start:end] for start, end in zip([0, *ends], ends)]

    def align(self, texts: Sequence[str | None]) -> list[Aligned | None]:
        placed = self._placed(texts)
        sizes = np.array([len(own) for own in placed if own], np.int64)
        if not len(sizes):
            return [None] * len(texts)
        places = np.fromiter(chain.from_iterable(placed), np.int64, sizes.sum())
        counts, first = self.counts[:, places], (np.cumsum(self.counts[3]) - self.counts[3])[places]
        starts = np.cumsum(sizes) - sizes
        totals, same = np.add.reduceat(counts, starts, axis=1), np.minimum.reduceat(counts[0], starts) > 0
        own = counts[3]
        links = self.links[np.repeat(first - np.cumsum(own) + own, own) + np.arange(own.sum())]
        of_text = zip(same.tolist(), *totals[:3].tolist(), np.split(links, np.cumsum(totals[3])[:-1]))
        out = []
        for own_places in placed:
            is_same, n_a, n_b, n_groups, own_links = next(of_text) if own_places else (False,) * 5
            groups = "".join(map(self.groups.__getitem__, own_places))[:-1] if is_same else ""
            out.append(Aligned(n_a, n_b, n_groups, own_links, hashlib.sha256(groups.encode()).hexdigest()) if is_same else None)
        return out


_workers: dict[tuple[str, str], Aligner] = {}


def worker_aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of this Python worker; what it holds outlives the task."""
    if (path_a, path_b) not in _workers:
        _workers[path_a, path_b] = Aligner(path_a, path_b)
    return _workers[path_a, path_b]


# Runs


def combined(parts: Sequence[Frame]) -> Frame:
    """One frame with the counts of equal keys added up."""
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def written(frames: Iterator[Frame]) -> bytes:
    """A run: frames with key differences and counts, each compressed by zstd."""
    codec, out = pa.Codec("zstd"), []
    for keys, counts in frames:
        for at in range(0, len(keys), FRAME):
            own = keys[at : at + FRAME]
            raw = np.diff(own, prepend=np.uint32(0)).astype("<u4").tobytes() + counts[at : at + FRAME].astype("<i8").tobytes()
            packed = codec.compress(raw, asbytes=True)
            out += [FRAME_HEAD.pack(len(own), len(packed)), packed]
    return b"".join(out)


def frames(run: bytes) -> Iterator[Frame]:
    codec, at = pa.Codec("zstd"), 0
    while at < len(run):
        n, size = FRAME_HEAD.unpack_from(run, at)
        at += FRAME_HEAD.size
        raw = codec.decompress(run[at : at + size], 12 * n, asbytes=True)
        yield np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.uint32), np.frombuffer(raw, "<i8", n, 4 * n)
        at += size


def merged(runs: Sequence[bytes]) -> Iterator[Frame]:
    """K-way merge. The heap holds the last key of every run's current frame; up to the smallest of
    them all frames are complete, so that part is added up and given out."""
    sources = [frames(run) for run in runs]
    heads: dict[int, Frame] = {}
    heap: list[tuple[int, int]] = []

    def advance(i: int) -> None:
        frame = next(sources[i], None)
        if frame is None:
            heads.pop(i, None)
        else:
            heads[i] = frame
            heapq.heappush(heap, (int(frame[0][-1]), i))

    for i in range(len(sources)):
        advance(i)
    while heap:
        limit, parts = heap[0][0], []
        for i, (keys, counts) in heads.items():
            cut = int(np.searchsorted(keys, limit, "right"))
            if cut:
                parts.append((keys[:cut], counts[:cut]))
                heads[i] = keys[cut:], counts[cut:]
        while heap and heap[0][0] == limit:
            advance(heapq.heappop(heap)[1])
        yield combined(parts)


def whole_run(run: bytes) -> Frame:
    parts = list(frames(run))
    if not parts:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    return np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])


def highest(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a pair's count is the highest of its first id; keys ascend, so a first id's pairs lie together."""
    if not len(keys):
        return np.empty(0, bool)
    first = keys >> 16
    starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
    return counts == np.repeat(np.maximum.reduceat(counts, starts), np.diff(np.append(starts, len(keys))))


# Jobs


def _distinct(aligned: Aligned | None) -> tuple[bytes, bytes]:
    if aligned is None:
        return b"", b""
    keys, times = np.unique(aligned.links, return_counts=True)
    return keys.tobytes(), times.astype("<u4").tobytes()


DOCUMENT_FIELDS = [f.split()[0] for f in DOCUMENT.split(", ")]
CHUNK_SCHEMA = f"chunk long, radix int, {DOCUMENT}, keys binary, times binary, run binary"


def _document_rows(chunk: int, doc_ids: list, aligned: list, pairs: list) -> pa.RecordBatch:
    n = len(doc_ids)
    numbers = zip(*[(x.n_a, x.n_b, x.n_groups, len(x.links)) if x else (0, 0, 0, 0) for x in aligned])
    digests = [x.groups_sha256 if x else "" for x in aligned]
    columns = [pa.array([chunk] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(doc_ids, pa.int64())]
    columns += [pa.array(x, pa.int64()) for x in numbers] + [pa.array(digests)]
    columns += [pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)] + [pa.nulls(n, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["chunk", "radix", *DOCUMENT_FIELDS, "keys", "times", "run"])


def _run_rows(chunk: int, held: list[bytes]) -> pa.RecordBatch:
    """The chunk's records combined per pair: one run per radix that it has."""
    keys, documents = np.unique(np.frombuffer(b"".join(held), "<u4"), return_counts=True)
    radix = (keys >> 16) % RADIX
    own = [int(r) for r in np.unique(radix)]
    runs = [written(iter([(keys[radix == r], documents[radix == r])])) for r in own]
    n = len(own)
    columns = [pa.array([chunk] * n, pa.int64()), pa.array(own, pa.int32()), pa.nulls(n, pa.int64())]
    columns += [pa.nulls(n, pa.int64())] * 4 + [pa.nulls(n, pa.string())] + [pa.nulls(n, pa.binary())] * 2 + [pa.array(runs, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["chunk", "radix", *DOCUMENT_FIELDS, "keys", "times", "run"])


def _chunks(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_aligner(path_a, path_b)
        chunk, held, records = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                aligned = aligner.align(part.column(1).to_pylist())
                pairs = list(map(_distinct, aligned))
                yield _document_rows(chunk, part.column(0).to_pylist(), aligned, pairs)
                held += [keys for keys, _ in pairs]
                records += sum(len(keys) // 4 for keys, _ in pairs)
                if records >= CHUNK_RECORDS:
                    yield _run_rows(chunk, held)
                    chunk, held, records = chunk + 1, [], 0
        yield _run_rows(chunk, held)

    return run


def _merge_group(key: tuple, rows: pa.Table) -> pa.Table:
    run = written(merged([r for r in rows.column("run").to_pylist()]))
    return pa.table({"radix": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "run": pa.array([run], pa.binary())})


def merged_runs(runs: DataFrame, chunks: int) -> DataFrame:
    """One run per radix: radix, run. At most about FAN_IN runs meet in a task; levels follow from the number of chunks."""
    parts = chunks
    level = runs.select("radix", F.xxhash64("chunk").alias("part"), "run")
    while True:
        parts = -(-parts // FAN_IN)
        level = level.withColumn("part", F.pmod("part", F.lit(max(parts, 1))))
        level = level.groupBy("radix", "part").applyInArrow(_merge_group, "radix int, part long, run binary")
        if parts <= 1:
            return level.select("radix", "run")


def _look_up(key: tuple, runs: pa.Table, totals: pa.Table) -> pa.Table:
    """Per run of a chunk its keys, their counts over all documents, and whether these are the highest."""
    keys, counts = whole_run(totals.column("run")[0].as_py()) if len(totals) else whole_run(b"")
    best, answers = highest(keys, counts), []
    for run in runs.column("run").to_pylist():
        own, _ = whole_run(run)
        at = np.searchsorted(keys, own)
        answers.append(written(iter([(own, counts[at] << 1 | best[at])])))
    return pa.table({"chunk": runs.column("chunk"), "answer": pa.array(answers, pa.binary())})


def _add_up(key: tuple, documents: pa.Table, answers: pa.Table) -> pa.Table:
    table = [whole_run(a) for a in answers.column("answer").to_pylist()]
    keys, marked = combined(table) if table else whole_run(b"")
    best, sums = [], []
    for own, times in zip(documents.column("keys").to_pylist(), documents.column("times").to_pylist()):
        found, times = marked[np.searchsorted(keys, np.frombuffer(own, "<u4"))], np.frombuffer(times, "<u4").astype(np.int64)
        best.append(int(times[(found & 1) == 1].sum()))
        sums.append(int((times * (found >> 1)).sum()))
    columns = {name: documents.column(name) for name in DOCUMENT_FIELDS}
    columns |= {"n_best": pa.array(best, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
    return pa.table({f.split()[0]: columns[f.split()[0]] for f in RESULT.split(", ")})


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``path_a`` is a byte-level file of the tokenizers library, which encodes a blank and the text; ``path_b`` is a
    sentencepiece file, which encodes the text and adds that blank. Both have fewer than 65,536 ids. A null or empty
    text, and one whose tokens do not give back the same bytes, has zeros and an empty
    ``groups_sha256``, and counts in no pair. A null doc_id stays null; repeated rows are documents
    of their own; counts that tie are all the highest. An empty table gives no rows. Further columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = stored(texts.mapInArrow(_chunks(path_a, path_b), CHUNK_SCHEMA), "aligned")
    runs = chunks.filter("radix is not null").select("chunk", "radix", "run")
    documents = chunks.filter("radix is null").select("chunk", *DOCUMENT_FIELDS, "keys", "times")
    n = runs.select("chunk").distinct().count()
    totals = stored(merged_runs(runs, n), "pair_runs", "none")
    shares = -(-n // FAN_IN) or 1
    dealt = runs.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(shares)))
    copies = totals.select("radix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("part"), "run")
    answers = dealt.groupBy("radix", "part").cogroup(copies.groupBy("radix", "part")).applyInArrow(_look_up, "chunk long, answer binary")
    return documents.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_add_up, RESULT)
