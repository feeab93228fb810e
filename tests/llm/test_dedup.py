"""Exact, near and substring duplicates against brute force."""

import hashlib
import os
import sys
from collections import Counter

import numpy as np
import pytest
import xxhash

sys.path.insert(0, os.path.dirname(__file__))

from corpora import corpus, empty, odd_texts, pairs_of  # noqa: E402
from rasterledger.llm import exact_dedup, simhash, suffix_dedup  # noqa: E402
from rasterledger.llm.components import connected  # noqa: E402


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("in_one_task", [0, 1_000_000])
def test_connected(spark, monkeypatch, in_one_task):
    monkeypatch.setattr("rasterledger.llm.components.TASK_LINKS", in_one_task)
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(500 + i, 501 + i) for i in range(70)] + [(1000, 1001 + i) for i in range(50)]
    nodes = {n for a, b in edges for n in (a, b) if a != b}
    found = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == components(nodes, [e for e in edges if e[0] != e[1]])
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def lower(text):
    return (text or "").encode().lower()


def test_exact_duplicates(spark):
    texts = odd_texts()
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(lower(t), []).append(i)
    sizes = {k: len(v) + (25 in v) for k, v in groups.items()}
    found = exact_dedup.exact_duplicates(corpus(spark)).distinct()
    expected = [(i, max(groups[lower(t)]), sizes[lower(t)], i == max(groups[lower(t)]), hashlib.sha256(lower(t)).hexdigest()) for i, t in enumerate(texts)]
    assert pairs_of(found, *found.columns) == sorted(expected, key=repr)
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0


def test_rows_without_an_id_leave_large_ids_exact(spark):
    big = 1 << 60
    rows = [(big + 1, "x"), (big + 3, "X"), (None, "x"), (None, "y"), (None, "Y"), (7, "z"), (None, "z")]
    found = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    expected = [(big + 1, big + 3, 3, False), (big + 3, big + 3, 3, True), (None, big + 3, 3, False), (None, None, 2, True), (None, None, 2, True), (7, 7, 2, True), (None, 7, 2, False)]
    assert pairs_of(found, "doc_id", "keep_id", "group_size", "kept") == sorted(expected, key=repr)


def test_pipeline_keeps_one_of_a_repeated_row(spark):
    import corpus_pipeline

    text = " ".join(f"word{i * i}" for i in range(60))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, "first text of an id", "en", "s", 1), (2, "second text of this id", "en", "s", 1), (3, "Second text of this id", "en", "s", 1), (None, "n", "en", "s", 1), (None, "N", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    exact = corpus_pipeline.exact(spark, docs, "")
    left = corpus_pipeline.repeats(spark, corpus_pipeline.near(spark, exact, ""), "")
    assert left.columns == docs.columns
    assert pairs_of(left.where("doc_id < 3"), "doc_id", "text") == [(1, text), (2, "first text of an id")]
    assert left.count() == 4


def test_pipeline_links_by_fingerprints(spark):
    import corpus_pipeline

    docs = corpus(spark).selectExpr("doc_id", "text", "lang", "'s' as source", "cast(length(text) as long) as n_chars")
    linked = simhash.near_duplicates(docs).where("doc_id = component_id")
    found = corpus_pipeline.near(spark, docs, "")
    assert pairs_of(found, "doc_id") == pairs_of(linked, "doc_id") and found.count() < docs.count()
    # Texts of one shingle set are alike at any similarity, but their fingerprints are far apart.
    rows = [(1, "a b c " * 40 + "d e f g h i j", "en", "s", 1), (2, "a b c d e f g h i j " * 3, "en", "s", 1)]
    apart = spark.createDataFrame(rows, docs.schema)
    assert corpus_pipeline.near(spark, apart, "").count() == simhash.near_duplicates(apart).select("component_id").distinct().count()


def test_cuckoo_filter_forgets_what_is_deleted_and_grows():
    bucket = exact_dedup.DigestBucket()
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    assert all(bucket.insert(d, i) for i, d in enumerate(digests))
    assert bucket.resizes > 0
    assert not any(bucket.insert(d, 10_000) for d in digests[:50])
    assert bucket.content[digests[0]] == (10_000, 2)
    assert all(bucket.delete(d) for d in digests[:1500])
    assert not any(bucket.delete(d) for d in digests[:1500])
    assert all(bucket.filter.may_hold(d) for d in digests[1500:])
    assert sum(bucket.filter.may_hold(d) for d in digests[:1500]) < 30
    assert bucket.insert(digests[0], 1)


def test_index_with_deletions(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string")
    marked = exact_dedup.digests(docs)
    gone = exact_dedup.digests(docs.where("doc_id = 3")).select("digest")
    assert pairs_of(exact_dedup.index_of(marked, "doc_id", gone), "keep_id", "group_size") == [(2, 2)]


def fingerprint(text, words=3):
    parts = lower(text).split()
    if not parts:
        return 0
    n = min(words, len(parts))
    hashes = [xxhash.xxh64_intdigest(b" ".join(parts[i : i + n]), 42) for i in range(len(parts) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("limit", [simhash.CELL_LIMIT, 2])
def test_near_duplicates(spark, limit):
    """Both ways of linking a cell, over and under the limit, at one input."""
    rng = np.random.default_rng(3)
    texts = odd_texts()
    prints = [fingerprint(t) for t in texts]
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    expected = components(range(len(texts)), edges)
    found = simhash.near_duplicates(corpus(spark), cell_limit=limit).distinct().collect()
    assert {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in found} == {i: (prints[i], expected[i]) for i in range(len(texts))}
    # Fingerprints of their own: chains of steps of one to three bits.
    values = [int(rng.integers(0, 1 << 63))]
    for _ in range(300):
        value = values[int(rng.integers(0, len(values)))]
        for bit in rng.choice(64, int(rng.integers(1, 4)), replace=False):
            value ^= 1 << int(bit)
        values.append(value)
    values = sorted(set(values))
    rows = [(v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(values)]
    links = simhash.links(spark.createDataFrame(rows, "fp long, node long"), cell_limit=limit)
    edges = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2]
    nodes = {n for e in edges for n in e}
    assert {r.node: r.root for r in connected(links).collect()} == components(nodes, edges)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_pivots_discard_only_far_pairs():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 1 << 63, (200, 1), dtype=np.int64).view(np.uint64)
    near = values ^ (np.uint64(1) << rng.integers(0, 64, (200, 1)).astype(np.uint64))
    both = np.concatenate([values, near])
    to = simhash.cell_links(both, simhash.references(), 2)
    assert all(to[i] == to[i + 200] for i in range(200))
    assert len(set(to.tolist())) == 200


def test_similar_documents(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(4000)]
    rows, expected = [], []
    for k in range(30):
        base = list(rng.choice(words, 300))
        rows.append((3 * k, " ".join(base)))
        near = list(base)
        near[int(rng.integers(300))] = "other"
        rows.append((3 * k + 1, " ".join(near)))  # nine of ten shingles and more
        far = list(base)
        for place in range(0, 300, 12):
            far[place] = "other"
        rows.append((3 * k + 2, " ".join(far)))  # under 0.8
        expected += [(3 * k, 3 * k), (3 * k + 1, 3 * k)]
    rows += [(900, None), (901, ""), (902, "w1 w2"), (903, "W1  w2"), (None, "w1 w2")]
    found = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert pairs_of(found, "doc_id", "component_id") == sorted([*expected, (902, 902), (903, 902)], key=repr)
    assert simhash.similar_documents(empty(spark)).count() == 0


def cut_by_brute_force(rows, length):
    counts = Counter()
    for _, text in rows:
        data = (text or "").encode()
        counts.update(data[i : i + length] for i in range(len(data) - length + 1))
    out = set()
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            if counts[data[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.add((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,period", [(200, 91), (40, 13)])
@pytest.mark.parametrize("large", [0, 200])
def test_repeats(spark, monkeypatch, length, period, large):
    """Classes over and under the size from which they are split, at one input."""
    monkeypatch.setattr(suffix_dedup, "LARGE_CLASS", large)
    monkeypatch.setattr(suffix_dedup, "MERGED_BYTES", 1 if large == 0 else 8 << 20)
    docs = corpus(spark)
    found = suffix_dedup.repeat_report(docs, length=length, period=period).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {tuple(r) for r in found} == cut_by_brute_force(rows, length)
    assert len(found) == len(rows)


def test_repeats_of_nothing(spark):
    assert suffix_dedup.repeat_report(empty(spark)).count() == 0
    one = spark.createDataFrame([(None, "ab" * 300), (2, None)], "doc_id long, text string")
    assert pairs_of(suffix_dedup.repeat_report(one), "n_bytes", "n_removed", "n_spans") == [(0, 0, 0), (600, 600, 1)]


def test_covers_meet_every_difference():
    for period, residues in suffix_dedup.COVERS.items():
        assert {(a - b) % period for a in residues for b in residues} == set(range(period))
    with pytest.raises(ValueError):
        suffix_dedup.Cover(50, 57)


def shingles(text, words=5):
    parts = lower(text).split()
    n = min(words, len(parts))
    return {b" ".join(parts[i : i + n]) for i in range(len(parts) - n + 1)} if parts else set()


def linked_by_brute_force(rows, similarity=0.8):
    sets = [(i, shingles(t)) for i, t in rows]
    edges = []
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            common = len(a & b)
            if common and common >= similarity * (len(a) + len(b) - common):
                edges.append((i, j))
    nodes = {n for e in edges for n in e}
    return sorted(components(nodes, edges).items(), key=repr)


def template_family(rng, count, length=200):
    """Texts off one template, changed so that pairs lie at a similarity of about 0.6 to 0.95, and chains of edits."""
    base = [f"t{i}" for i in range(length)]
    rows = []
    for k in range(count):
        text = list(base if k % 3 or not rows else rows[int(rng.integers(len(rows)))])
        for place in rng.choice(length, int(rng.integers(1, 6)), replace=False):
            text[place] = f"x{rng.integers(1 << 30)}"
        rows.append(text)
    return [(i, " ".join(t)) for i, t in enumerate(rows)]


@pytest.mark.parametrize("growth", [simhash.ROUND_GROWTH, 2])
def test_a_template_family_is_linked_as_by_brute_force(spark, monkeypatch, growth):
    monkeypatch.setattr(simhash, "ROUND_GROWTH", growth)
    rows = template_family(np.random.default_rng(8), 300)
    rows += [(1000 + i, t.replace("t", "u")) for i, t in template_family(np.random.default_rng(9), 80, 60)]
    expected = linked_by_brute_force(rows)
    assert len({c for _, c in expected}) > 3
    found = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert pairs_of(found, "doc_id", "component_id") == expected


def test_cells_over_the_limit_lose_no_pair(spark, monkeypatch):
    rows = template_family(np.random.default_rng(10), 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(simhash, "CELL_LIMIT", 2)
    assert pairs_of(simhash.similar_documents(docs), "doc_id", "component_id") == linked_by_brute_force(rows)


def test_a_class_at_one_residue_in_a_merge_keeps_all_its_members(spark):
    """D1 and D2 share 150 bytes at one place; D2 and E, of another partition, share 200 at two."""
    rng = np.random.default_rng(13)

    def letters(n):
        return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))

    header = letters(200)
    # 27 and 56 are the only residues of the cover that lie 29 apart.
    rows = [(1, header[:150] + letters(400)), (2, header + letters(300)), (3, letters(29) + header + letters(300))]
    rows.append((4, letters(500)))
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    assert [[r.doc_id for r in part] for part in docs.rdd.glom().collect()] == [[1, 2], [3, 4]]
    found = suffix_dedup.repeat_report(docs).collect()
    assert {tuple(r) for r in found} == cut_by_brute_force(rows, 200)
    assert {r.doc_id: r.n_removed for r in found} == {1: 0, 2: 200, 3: 200, 4: 0}


def test_every_pair_at_the_similarity_is_found(spark):
    """Pairs at 0.80 to 0.85 of 160 to 400 shingles, where sampled cells lost some."""
    rng = np.random.default_rng(12)
    rows = []
    while len(rows) < 1000:
        base = [f"w{rng.integers(1 << 30)}" for _ in range(int(rng.integers(164, 405)))]
        near = list(base)
        for place in rng.choice(len(base), int(len(base) * rng.uniform(0.018, 0.03)), replace=False):
            near[place] = f"z{rng.integers(1 << 30)}"
        pair = " ".join(base), " ".join(near)
        a, b = map(shingles, pair)
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            rows += [(len(rows), pair[0]), (len(rows) + 1, pair[1])]
    found = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert pairs_of(found, "doc_id", "component_id") == sorted(((i, i // 2 * 2) for i, _ in rows), key=repr)
