"""Token files (op5), packing (op8), mixing (op9), archives (op10) and the pipeline."""

import base64
import functools
import hashlib
import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from checks.compare import connect, difference
from snaplytics.llm import online_packing as op, registry, token_files as tf, warc_segments as ws, weighted_mix as wm
from snaplytics.llm.cached_tokens import LATIN, CachedTokenizer, word_merger, worker_tokenizer
from snaplytics.llm.common import remove, shared_folder, stored_so_far
from tests.helpers import settings as settings_of
from tests.llm.edge_cases import edge_documents, no_documents, prose, with_clashes
from tests.llm.test_dedup import brute_components, brute_exact, brute_fingerprint
from tests.llm.test_text_rules import brute_judgements

WORD_BPE, BYTE_BPE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
FOLDER = "/root/testdata/sf0.001"


@functools.cache
def plain(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


ODD = [
    "", " ", "a  b", "a \n b\n\nc", " x", "x ", "\n", "a\tb c", "it's 12,5 we'll go \x1c q", "É Σας İ", "<|endoftext|> a<|endoftext|>b",
    "a.\nB c\n" * 3, "\U0001f642 x\U0001f642y", " a​b  c", "x\x85y \x1fz", "﻿a", "a\r\nb", "á ́b",
]


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_cached_ids_are_those_of_the_whole_text(path):
    cached, whole = CachedTokenizer(path), plain(path)
    for _ in range(2):  # the second time from the cache
        for text in [*ODD, prose(300, "é")]:
            assert np.frombuffer(cached.encode([text])[0], np.uint16).tolist() == whole(text), text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'st12.,!- \n\t\r\x1c\x85 ​é́Σ\U0001f642"), max_size=25), max_size=4))
def test_cached_ids_of_random_texts(texts):
    for path in (WORD_BPE, BYTE_BPE):
        cached, whole = worker_tokenizer(path), plain(path)
        cached.ids.clear()
        assert [np.frombuffer(x, np.uint16).tolist() for x in cached.encode(texts)] == [whole(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=70))
def test_numbers_round_trip(values):
    control, data = tf.encode_numbers(np.array(values, np.uint32))
    assert len(control) == math.ceil(len(values) / 4)
    assert len(data) == sum(max(1, (v.bit_length() + 7) // 8) for v in values)
    assert tf.decode_numbers(control, data, len(values)).tolist() == values


def brute_tokens(rows):
    encode, at, out = plain(WORD_BPE), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(encode(text) + [1], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return sorted(map(str, out))


def test_token_files_equal_brute_force(spark, monkeypatch):
    docs = edge_documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = tf.token_round_trip(with_clashes(docs), WORD_BPE)
    assert sorted(str(tuple(r)) for r in found.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == brute_tokens(rows)
    assert tf.token_round_trip(no_documents(spark), WORD_BPE).count() == 0


def test_token_files_of_the_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    found = registry.queries()["op5_token_files"](spark, FOLDER)
    assert sorted(str(tuple(r)) for r in found.collect()) == brute_tokens(rows)


def test_damaged_and_small_blocks(monkeypatch):
    rank_of = np.arange(1 << 16, dtype="<u4")
    block = tf._block(3, 5, [7, None], [np.array([1, 300], "<u2").tobytes(), b""], rank_of)
    (shard, place, ids, lengths, ranks), second = tf.read_blocks(2 * (block + tf.END))
    assert (shard, place, ids.tolist(), lengths.tolist(), ranks.tolist()) == (3, 5, [7, None], [2, 0], [1, 300])
    with pytest.raises(ValueError):
        list(tf.read_blocks(block[:-1] + b"x" + tf.END))


# Packing


def check_packing(rows, pieces, most_padding):
    encode = plain(BYTE_BPE)
    texts = {}
    for doc_id, text in rows:
        ids = np.array(encode(text) + [0], "<u4")
        texts.setdefault(doc_id, []).append(ids)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert by_doc.keys() == texts.keys()
    for doc_id, own in by_doc.items():
        if len(texts[doc_id]) > 1:  # repeated ids: only their totals can be told
            assert sum(p["length"] for p in own) == sum(map(len, texts[doc_id]))
            continue
        ids, at = texts[doc_id][0], 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] > 0
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : at].tobytes())
        assert at == len(ids)
    padding = total = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
        total += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding <= most_padding * (padding + total)


def test_packing_loses_no_id(spark):
    docs = edge_documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check_packing(rows, op.pack(with_clashes(docs), BYTE_BPE).collect(), 0.02)
    assert op.pack(no_documents(spark), BYTE_BPE).count() == 0


def test_packing_of_the_documents_pads_little(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    check_packing(rows, registry.queries()["op8_online_packing"](spark, FOLDER).collect(), 0.01)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_open_windows_are_bounded(lengths):
    packer = op.Packer(0, window=32, open_windows=3)
    for i, n in enumerate(lengths):
        packer.add(i, np.arange(n))
        assert len(packer.open) == len(packer.rooms) <= 3 and packer.rooms == sorted(packer.rooms)
    left = sum(r[2] for r in packer.leftovers())
    assert sum(r[2] for r in packer.closed) + left == sum(lengths)


# Mixing


def brute_targets(sizes):
    """Share out again and again until no source is above three times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    words, full = sum(sizes.values()), set()
    while True:
        rest = words - sum(3 * sizes[s] for s in full)
        open_weight = sum(w for s, w in weight.items() if s not in full)
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / open_weight for s in order}
        above = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not above:
            return target
        full |= above


def test_mix_meets_its_targets(spark):
    docs = edge_documents(spark)
    out = wm.mix(with_clashes(docs)).collect()
    sizes = {}
    for source, text in docs.select("source", "text").collect():
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    target = brute_targets(sizes)
    got = sorted((r["source_size"], r["target"]) for r in out)
    want = sorted((sizes[s], float(target[s])) for (s,) in docs.select("source").collect())
    assert np.allclose(got, want)
    taken = {}
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["target"]] = taken.get(r["target"], 0) + r["taken"]
    assert taken == {float(t): math.floor(t) for t in target.values()}
    assert wm.mix(no_documents(spark)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.text("abc", max_size=3), st.integers(0, 1000), min_size=1, max_size=9))
def test_targets_equal_sharing_out_in_rounds(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in wm.targets(df).collect()}
    assert got == pytest.approx({s: float(t) for s, t in brute_targets(sizes).items()})


def test_heavier_documents_are_drawn_more_often_and_reruns_agree(spark):
    rows = [(i, "a b", "s") if i % 2 else (i, "## ## ## a b", "s") for i in range(4000)] + [(10_000 + i, "x y z " * 20, "t") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (wm.mix(docs.repartition(n)).orderBy("doc_id").drop("row").toPandas() for n in (2, 7))
    assert a.equals(b)
    plain_share = (a[(a.doc_id < 10_000) & (a.doc_id % 2 == 1)].eval("taken / size")).mean()
    marked_share = (a[(a.doc_id < 10_000) & (a.doc_id % 2 == 0)].eval("taken / size")).mean()
    assert plain_share > marked_share


def test_rows_of_one_id_are_dealt_to_several_ranges(spark):
    """A third of the rows with one id, source and text: no range holds them all, and sums equal a plain pass over sorted rows."""
    rows = [(None if i % 3 == 0 else i, "a b c" if i % 6 == 0 else "w " * (i % 7), "s" if i % 5 else None) for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    with settings_of(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        sizes = wm.sized(docs)
        ranged = wm.dealt(sizes)
        assert ranged.filter("doc_id is null and source = 's'").select("range").distinct().count() > 1
        out = wm.taken(sizes, wm.targets(sizes)).collect()
    assert len(out) == len(rows)
    by_source, want = {}, []
    for r in sizes.collect():
        by_source.setdefault(r["source"], []).append(r)
    target = brute_targets({s: sum(r["size"] for r in own) for s, own in by_source.items()})
    for source, own in by_source.items():
        epochs, rest = divmod(math.floor(target[source]), sum(r["size"] for r in own))
        for r in sorted(own, key=lambda r: (r["key"], r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["row"])):
            part = max(0, min(r["size"], rest))
            rest -= part
            want.append((r["row"], epochs * r["size"] + part))
    assert sorted((r["row"], r["taken"]) for r in out) == sorted(want)


def test_mixed_documents_keep_columns(spark):
    docs = with_clashes(edge_documents(spark))
    out = wm.mix_documents(docs)
    assert out.columns == docs.columns and out.filter("text is null").count() == 0


# Archives


PAGES = "page_id long, url string, html string"


def brute_archive(rows):
    out = []
    for page_id, html in rows:
        payload = (html or "").encode()
        best = max((i for i, h in rows if (h or "") == (html or "")), key=lambda i: (i is not None, i or 0))
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page_id, len(payload), digest, best))
    return out


def test_archive_round_trip(spark):
    rows = [
        (1, "http://a/", "<p>é" + "x" * 50_000), (2, None, None), (3, "http://b/\r\nX: y", ""), (4, "http://c/", "WARC/1.1\r\n\r\n\r\n0\r\n\r\n"),
        (5, "http://d/", "same"), (6, "http://e/", "same"), (6, "http://e/", "same"), (None, "http://f/", "same"), (7, "u", "y" * ws.SEGMENT_BYTES * 3),
        (8, "u", "\U0001f642" * 9_000), (8, "u", "\U0001f643" * 9_000),
    ]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    found = ws.archive_round_trip(pages.withColumns({c: F.lit("x") for c in ("row", "digest", "payload", "n", "best")})).collect()
    want = brute_archive([(r[0], r[2]) for r in rows])
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in found]
    assert sorted(map(str, got)) == sorted(str(w[:3]) for w in want)
    for digest in {w[2] for w in want}:
        own, best = [r for r in found if r["payload_digest"] == digest], next(w[3] for w in want if w[2] == digest)
        assert [r["page_id"] for r in own if r["record_type"] == "response"] == [best]
        assert all(r["refers_to"] == best for r in own if r["record_type"] == "revisit")
    assert ws.archive_round_trip(pages, min_bytes=10**6).filter("record_type = 'revisit'").count() == 0
    assert ws.archive_round_trip(pages.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 40))
def test_chunked_framing(payload, size):
    assert ws.unchunked(ws.chunked(payload, size)) == payload
    with_extension = ws.chunked(payload, size).replace(b"\r\n", b";name=value\r\n", 1)
    assert ws.unchunked(with_extension) == payload


def test_segments_that_do_not_fit_are_errors():
    records = [r for text in ws.page_records(1, 9, "u", b"z" * 50_000, None, None) for r in ws.parse_records(text + ws.RECORD_END.encode())]
    rows = [ws._parsed_record(*r) for r in records]
    table = lambda rows: ws.pa.Table.from_batches([ws._batch(rows)])
    assert len(rows) == 4 and ws.join_segments(table(rows[::-1])).to_pylist()[0]["payload_bytes"] == 50_000
    for bad in (rows[:2] + rows[3:], rows[:3], [rows[0], *rows]):
        with pytest.raises(ValueError):
            ws.join_segments(table(bad))
    short = [*rows[:3], (*rows[3][:8], rows[3][8][:-1])]
    with pytest.raises(ValueError):
        ws.join_segments(table(short))


# Queries


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert difference(registry.queries()[name](spark, FOLDER), connect(FOLDER), registry.oracle_sql()[name]) is None


def test_a_query_for_each_operator():
    names = [n for n in registry.queries() if n.startswith("op")]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))


def brute_copies(docs):
    """How often the mix gives each of ``docs`` (doc_id, source, text): in order of the keys until the budget is used up."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, _, t in docs}
    sizes = Counter()
    for i, source, _ in docs:
        sizes[source] += size[i]
    target = brute_targets(sizes)

    def key(i, text):
        u = (int(hashlib.md5(f"1:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 16**12
        return -math.log(u) / (1.05 - len(re.findall(r"[#*$%&|<>]", text)) / max(1, len(text)))

    copies = {}
    for source in sizes:
        epochs, left = divmod(math.floor(target[source]), sizes[source])
        for _, i in sorted((key(i, t), i) for i, s, t in docs if s == source):
            part = min(size[i], left)
            left -= part
            copies[i] = math.floor(epochs + part / size[i] + 0.5)
    return {i: n for i, n in copies.items() if n}


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_pipeline_stages(spark, folder):
    """Each stage's decisions against brute force on its own input, texts included."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    counts = [docs.count()]
    assert len(texts) == counts[0]

    def after(stage, docs):
        path = shared_folder(spark, "stage")
        corpus_pipeline.STAGES[stage][1](spark, docs, folder).write.parquet(path)
        out = spark.read.parquet(path)
        if stage < 4:
            assert out.columns == columns
            assert all(texts[r["doc_id"]] == r["text"] for r in out.collect())
        counts.append(out.count())
        return out

    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    judged = after(0, docs)
    assert ids(judged) == sorted(i for i, (_, _, stays) in brute_judgements(docs.collect()).items() if stays)
    unique = after(1, judged)
    assert ids(unique) == sorted({r[1] for r in brute_exact([(i, texts[i]) for i in ids(judged)])})
    apart = after(2, unique)
    assert ids(apart) == sorted(set(brute_components(ids(unique), [brute_fingerprint(texts[i]) for i in ids(unique)])))
    mixed = after(3, apart)
    want = brute_copies([(r["doc_id"], r["source"], r["text"]) for r in apart.collect()])
    assert Counter(ids(mixed)) == want
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0

    tokens, held, filled = plain(BYTE_BPE), {}, {}
    for r in after(4, mixed).collect():
        held.setdefault(r["doc_id"], []).append(r)
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert held.keys() == want.keys()
    for doc_id, pieces in held.items():
        own = np.array([*tokens(texts[doc_id]), 0], "<u4")
        times = Counter()
        for r in pieces:
            assert r["doc_tokens"] == len(own)
            assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
            times.update(range(r["start"], r["start"] + r["length"]))
        assert times == dict.fromkeys(range(len(own)), want[doc_id])
    for pieces in filled.values():
        ends = [0, *np.cumsum([n for _, n in sorted(pieces)])]
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 1024


def test_run_leaves_no_tables_but_its_result(spark):
    before = set(stored_so_far())
    out = corpus_pipeline.run(spark, FOLDER)
    assert len(set(stored_so_far()) - before) == 1 and out.count() > 0


def test_pipeline_takes_empty_and_odd_documents(spark):
    for docs in (no_documents(spark), with_clashes(edge_documents(spark))):
        for _, stage in corpus_pipeline.STAGES:
            path = shared_folder(spark, "stage")
            stage(spark, docs, FOLDER).write.parquet(path)
            docs = spark.read.parquet(path)


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_whole_texts_by_ranks_equal_the_tokenizer(path):
    """Every character the ranks are trusted with, beside letters, digits, signs and blanks; and long runs."""
    cached, whole = CachedTokenizer(path), plain(path)
    assert cached.merge is not None
    assert [c for c in LATIN if cached.unsure.search(c)] == (["\0", "\u0130"] if path == WORD_BPE else [])
    assert len(LATIN) > 500
    texts = [f"a{c}b {c}1{c} {c}{c}. \n{c}\n" for c in LATIN] + [f"{c}'{d}" for c in LATIN for d in ("s", "LL", c)]
    texts += ["ab" * 20_000, " " * 3_000 + "x", "ł'S'll " * 50, "日本 a", "'", "it''s 'tis we'rE O'Neil's", prose(3_000, "'s")]
    assert [np.frombuffer(x, np.uint16).tolist() for x in cached.encode(texts)] == [whole(t) for t in texts]


def test_every_entry_of_the_word_file_is_found_by_ranks():
    cached, whole = CachedTokenizer(WORD_BPE), plain(WORD_BPE)
    entries = [e for e in Tokenizer.from_file(WORD_BPE).get_vocab() if e.removesuffix("</w>").isascii()]
    texts = [" ".join(entries[i : i + 50]) for i in range(0, len(entries), 50)]
    texts += [t.replace("</w>", "") for t in texts]
    assert [np.frombuffer(x, np.uint16).tolist() for x in cached.encode(texts)] == [whole(t) for t in texts]


def test_files_with_other_steps_are_not_merged_by_ranks():
    known = json.loads(open(WORD_BPE, encoding="utf-8").read())
    assert word_merger(known) is not None
    known["normalizer"]["normalizers"].pop()
    assert word_merger(known) is None


def test_rows_of_one_id_are_dealt_to_several_shards(spark):
    """A third of the rows without an id, half of them equal: no shard holds them all, and what is read back is whole."""
    rows = [(None if i % 3 == 0 else i, "same text" if i % 6 == 0 else f"text {i} of many") for i in range(1_800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = shared_folder(spark, "tokens")
    with settings_of(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        tf.write_tokens(docs, WORD_BPE, 1, folder)
        blocks = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/blocks").select("content").collect()
        found = [tuple(r) for r in tf.read_tokens(spark, folder).collect()]
    remove(spark, folder)
    read = [b for row in blocks for b in tf.read_blocks(bytes(row["content"]))]
    without = {shard for shard, _, ids, _, _ in read if np.ma.getmaskarray(ids).any()}
    assert len(without) > 1
    assert sum(len(ids) for _, _, ids, _, _ in read) == len(rows) == len(found)
    in_order = sorted(found, key=lambda r: r[1])
    assert [r[0] for r in in_order] == [None] * 600 + [i for i in range(1_800) if i % 3]
    encode = plain(WORD_BPE)
    sums = Counter((d, zlib.crc32(np.array(encode(t) + [1], "<u4").tobytes())) for d, t in rows)
    assert Counter((d, c) for d, _, _, c in found) == sums
    assert [r[1] for r in in_order] == [0, *np.cumsum([r[2] for r in in_order])[:-1]]
