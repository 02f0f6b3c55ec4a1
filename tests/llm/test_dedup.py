"""Exact duplicates (op6), near duplicates (op3) and repeated passages (op4) against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from snaplytics.llm import components, exact_mph, simhash_variants as sv, suffix_dedup as sd
from tests.llm.edge_cases import edge_documents, no_documents, prose, with_clashes

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def collected(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


# Exact duplicates


def brute_exact(docs):
    groups = {}
    for doc_id, text in docs:
        groups.setdefault(re.sub(SPACE, "", text or ""), []).append((doc_id, text or ""))
    out = []
    for key, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0]))
        out += [(m[0], best[0], len(members), hashlib.sha256(key.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


def test_exact_duplicates_equal_brute_force(spark):
    docs = edge_documents(spark)
    found = exact_mph.exact_duplicates(with_clashes(docs))
    got = sorted((tuple(r) for r in found.select("doc_id", "keep_id", "group_size", "text_sha256").collect()), key=str)
    assert got == brute_exact(collected(docs))
    # One row of each group is kept, of repeated rows too.
    assert found.groupBy("text_sha256").agg(F.sum(F.col("kept").cast("int")).alias("n")).filter("n <> 1").count() == 0
    assert exact_mph.exact_duplicates(no_documents(spark)).count() == 0


def test_dropping_exact_duplicates_keeps_columns(spark):
    docs = with_clashes(edge_documents(spark))
    out = exact_mph.drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    texts = [re.sub(SPACE, "", t or "") for _, t in collected(docs)]
    assert sorted(re.sub(SPACE, "", t or "") for _, t in collected(out)) == sorted(set(texts))


def test_rows_that_repeat_a_history(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "new"), (3, "new "), (4, "other")], "doc_id long, text string")
    history = spark.createDataFrame([(70, "ab"), (71, "a  b"), (72, "x")], "doc_id long, text string")
    out = exact_mph.exact_duplicates(docs, history).orderBy("doc_id").select("doc_id", "keep_id", "group_size", "kept")
    assert [tuple(r) for r in out.collect()] == [(1, 71, 2, False), (2, 3, 2, False), (3, 3, 2, True), (4, 4, 1, True)]


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 3000), st.integers(0, 2**32 - 1))
def test_perfect_hash_is_minimal_and_rejects_others_by_bytes(n, seed):
    random_digests = np.random.default_rng(seed).integers(0, 256, (n + 50, exact_mph.DIGEST_BYTES), np.uint8)
    held, others = random_digests[:n], random_digests[n:]
    hashed = exact_mph.PerfectHash(held)
    assert sorted(hashed.slots(held)) == list(range(n))
    assert all(-1 <= s < n for s in hashed.slots(others))


def test_perfect_hash_lists_keys_that_agree_where_it_looks():
    digests = np.zeros((3, exact_mph.DIGEST_BYTES), np.uint8)
    digests[:, 0] = [1, 2, 3]
    assert sorted(exact_mph.PerfectHash(digests).slots(digests)) == [0, 1, 2]


def test_a_frequent_text_is_looked_up_in_several_groups(spark, monkeypatch):
    monkeypatch.setattr(exact_mph, "TARGET_ROWS", 20)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot text").otherwise(F.col("id").cast("string")).alias("text"))
    found = exact_mph.exact_duplicates(docs)
    assert found.filter("group_size = 200 and keep_id = 1").count() == 200 and found.filter("kept").count() == 101


# Near duplicates


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(WORD, lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    least = [float("inf") if i is None else i for i in ids]
    prints = np.array(prints, np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    while True:
        new = [min(least[j] for j in np.flatnonzero(near[i])) for i in range(len(least))]
        if new == least:
            return least
        least = new


def near_copies(n, seed):
    rng = random.Random(seed)
    base = prose(300).split()
    docs = []
    for i in range(n):
        words = list(base) if i % 3 else [f"w{rng.randint(0, 500)}" for _ in range(200)]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"changed{i}"
        docs.append((i + 10, " ".join(words)))
    return docs


def test_near_duplicates_equal_brute_force(spark):
    docs = edge_documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame(near_copies(150, 3), "doc_id long, text string"))
    rows = collected(docs)
    prints = [brute_fingerprint(t) for _, t in rows]
    least = [None if c == float("inf") else c for c in brute_components([i for i, _ in rows], prints)]
    want = sorted(map(str, zip((i for i, _ in rows), (f"{p:016x}" for p in prints), least)))
    found = sv.near_duplicates(with_clashes(docs)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(str(tuple(r)) for r in found) == want
    assert sv.near_duplicates(no_documents(spark)).count() == 0


def test_one_row_of_each_component_stays(spark):
    docs = with_clashes(edge_documents(spark))
    out = sv.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    components_of = sv.near_duplicates(docs).groupBy("component_id").count().filter("component_id is not null").count()
    assert out.filter("doc_id is not null").count() == components_of
    assert out.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").count() == 0


def test_survivors_do_not_depend_on_how_ids_repeat(spark):
    a, b, c, d = (prose(60, salt) for salt in "pqrs")
    rows = [(1, a), (1, b), (5, a + " "), (6, " " + b), (None, c), (None, c + "\n"), (None, d), (9, d + "\t"), (8, d)]
    assert len({brute_fingerprint(t) for t in (a, b, c, d)}) == 4 == len(set(brute_components(range(4), [brute_fingerprint(t) for t in (a, b, c, d)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    kept = collected(sv.drop_near_duplicates(docs))
    assert sorted((str(i), " ".join(t.split())) for i, t in kept) == sorted([("1", a), ("1", b), ("None", c), ("8", d)])


@pytest.mark.parametrize("n", [100, 3000])
def test_every_link_within_a_run_of_one_key_is_kept(n):
    rng = np.random.default_rng(n)
    centre = rng.integers(0, 2**63, dtype=np.uint64)
    bits = rng.integers(0, 64, (n, 6))
    fps = np.unique(centre ^ np.bitwise_xor.reduce(np.uint64(1) << bits.astype(np.uint64), axis=1))
    a, b = sv.linked(fps)
    assert len(a) < len(fps)

    def classes(a, b):
        label = {int(f): int(f) for f in fps}

        def find(x):
            while label[x] != x:
                x = label[x]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            x, y = sorted((find(x), find(y)))
            label[y] = x
        return {f: find(f) for f in label}

    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    assert classes(a, b) == classes(fps[i], fps[j])


def test_variants_of_fingerprints_four_bits_apart_meet(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x ^ sum(1 << b for b in rng.sample(range(64), 4))
        pairs.append(tuple(v - 2**64 if v >= 2**63 else v for v in (x, y)))
    df = spark.createDataFrame(pairs, "x long, y long")
    met = F.arrays_overlap(sv.variant_keys(F.col("x")), sv.variant_keys(F.col("y")))
    assert df.filter(met).count() == 200


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 300)]
    star = [(5, i) for i in range(1000, 1200)] + [(7, 7)]
    found = components.components(spark.createDataFrame(path + star, "u long, v long"))
    assert {r[0]: r[1] for r in found.collect()} == {i: 100 for i in range(100, 301)} | {5: 5} | {i: 5 for i in range(1000, 1200)}


# Repeated passages


def brute_passages(texts):
    counts = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        edges = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - 199):
            if counts[t[i : i + 200]] > 1:
                edges[i] += 1
                edges[i + 200] -= 1
        covered = np.cumsum(edges)[:-1] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~covered])
        runs = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        out.append((len(t), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def passage_texts(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [text(rng.randint(190, 420)) for _ in range(6)]
    out = []
    for _ in range(120):
        t = ""
        for _ in range(rng.randint(0, 4)):
            t += text(rng.randint(0, 150))
            if rng.random() < 0.6:
                p = rng.choice(passages)
                p = p[rng.randint(0, 60) : len(p) - rng.randint(0, 60)]
                if rng.random() < 0.3:
                    at = rng.randrange(len(p))
                    p = p[:at] + "X" + p[at + 1 :]
                t += p
        out.append(t)
    return out + [out[5], out[6] + out[7], "", "a" * 900, "ab" * 300, "q" * 199, "z" * 200, "y" * 201]


@pytest.mark.parametrize("large_group", [sd.LARGE_GROUP, 3])
def test_removed_passages_equal_brute_force(spark, large_group):
    texts = passage_texts(4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = sd.remove_passages(with_clashes(df), large_group).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in found] == brute_passages([t.encode() for t in texts])


def test_an_anchor_in_very_many_texts_is_taken_in_parts():
    rng = np.random.default_rng(2)
    h = np.sort(np.concatenate([np.full(900, 5), rng.integers(0, 50, 300)]))
    c = np.concatenate([np.sort(rng.integers(0, 200, (h == v).sum())) for v in np.unique(h)])
    names = ("h", "c", "ref", "a", "many")
    arrays = [h, c, np.arange(len(h)), np.full(len(h), 1000 << 16 | 168 << 8 | 200), np.zeros(len(h), bool)]
    whole = pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names)
    batches = [whole.slice(i, 70) for i in range(0, len(h), 70)]

    def result(rows):
        table = pa.Table.from_batches(sd._met(iter(batches), 10_000, rows))
        covered = {r["ref"] for r in table.to_pylist() if r["kind"] == sd.COVERED}
        needs = {(r["h"], r["c"]): r["large"] for r in table.to_pylist() if r["kind"] == sd.NEEDED}
        return covered, needs

    covered, needs = result(10**6)
    some, parts = result(100)
    assert some == covered and parts.keys() == needs.keys()
    assert not any(needs.values()) and all(large == (key[0] == 5) for key, large in parts.items())


def test_passages_of_edge_documents(spark):
    docs = edge_documents(spark)
    rows = [(i, t) for i, t in collected(docs) if i != 10]
    found = sd.remove_passages(docs.filter("doc_id is null or doc_id <> 10")).collect()
    want = zip((i for i, _ in rows), brute_passages([(t or "").encode() for _, t in rows]))
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(str((i, *w)) for i, w in want)
    assert sd.remove_passages(no_documents(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=70).map(lambda b: bytes(x % 2 + 97 for x in b)), min_size=1, max_size=40))
def test_deep_shallow_sort(texts):
    order, agreed = sd.deep_shallow_sort(texts)
    assert sorted(order) == list(range(len(texts))) and [texts[i] for i in order] == sorted(texts)
    assert all(agreed[k] == sd.common_prefix(texts[order[k - 1]], texts[order[k]]) for k in range(1, len(order)))


def test_history_decides_by_lookup(spark, monkeypatch):
    """One half of the rows is looked up in the other's hash: without lookups, repeats across the halves stay."""
    docs = spark.createDataFrame([(i, f"text {i // 6}") for i in range(60)], "doc_id long, text string")
    kept = lambda: exact_mph.exact_duplicates(docs).filter("kept").count()
    assert kept() == 10
    true_lookup = exact_mph.look_up
    none = F.lit(None).cast("long")
    forget = lambda rows, index, shards: true_lookup(rows, index, shards).withColumns(dict.fromkeys(("keep_row", "keep_id", "group_size"), none))
    calls = []
    monkeypatch.setattr(exact_mph, "look_up", lambda *args: calls.append(1) or (forget if len(calls) == 1 else true_lookup)(*args))
    assert kept() == 20


def test_a_dense_run_of_near_fingerprints_stays_small():
    """40,000 fingerprints around a few centres under one key: a forest, found without lists of pairs."""
    import tracemalloc

    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**63, 5, np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40_000, 3)).astype(np.uint64)
    fps = np.unique(centres[rng.integers(0, 5, 40_000)] ^ np.bitwise_xor.reduce(flips, axis=1))
    tracemalloc.start()
    a, b = sv.linked(fps)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    u, v = sv._forest(fps)
    assert len(a) == len(u)  # as many edges, so as many components
    assert sv._near(u, v).all()


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(7)
    for n in (2, 30, 300):
        fps = np.unique(rng.integers(0, 2**9, n, np.uint64) * np.uint64(0x0101010101010101) ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)))
        i, j = np.triu_indices(len(fps), 1)
        near = sv._near(fps[i], fps[j])
        all_a, all_b = components.spanning_edges(fps[i][near], fps[j][near])
        for a, b in (sv._forest(fps), sv._linked_by_parts(fps)):
            nodes, roots = components.spanning_edges(np.concatenate([a, all_a]), np.concatenate([b, all_b]))
            assert len(a) == len(all_a) == len(nodes)  # both forests together link no more than each


def test_repeated_rows_cost_no_more_than_others(spark):
    """Rows that repeat id and text: every row is judged, and each place is fetched once."""
    passage = " ".join(f"w{i}" for i in range(120))
    docs = spark.createDataFrame([(1, passage)] * 2_000 + [(2, "alone " * 3)], "doc_id long, text string").repartition(4)
    out = sd.remove_passages(docs).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    assert sorted(tuple(r) for r in out) == [(1, len(passage), len(passage), 1, 2_000), (2, 18, 0, 0, 1)]
