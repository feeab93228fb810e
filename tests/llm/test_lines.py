"""Shared lines against brute force."""

import hashlib
import os
import random
import sys
from collections import defaultdict

import numpy as np

sys.path.insert(0, os.path.dirname(__file__))

from corpora import empty, odd_texts, pairs_of  # noqa: E402
from rasterledger.llm import line_dedup  # noqa: E402

BLANKS = " \t\n\v\f\r"


def line_texts():
    rng = random.Random(3)
    pool = ["".join(rng.choice("abÉ 日") for _ in range(rng.randint(15, 40))) for _ in range(40)]
    texts = []
    for i in range(60):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 9))]
        lines = [x.upper() if rng.random() < 0.2 else f" \t{x}\v\r" if rng.random() < 0.3 else x for x in lines]
        texts.append("\n".join(lines))
    hot = "This line stands in every other document of all"
    texts = [hot + "\n" + t if i % 2 else t for i, t in enumerate(texts)]
    return texts + odd_texts() + ["\n\n", hot, "x" * 19 + "\n" + "y" * 20, "Y" * 20, " " + "y" * 20 + "\n" + "y" * 20, "word " * 300_000 + "\n" + hot]


def expected(rows):
    """(id, text) rows; an id of None stands before all others."""
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))
    order = lambda i: (i is not None, i or 0)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 3 or max(holders[key(x)], key=order) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text")


def test_line_duplicates_equal_brute_force(spark):
    rows = list(enumerate(line_texts()))
    rows += [rows[7], rows[8], (3, rows[5][1]), (None, rows[9][1]), (None, rows[11][1]), (-4, rows[12][1])]
    table = [(i, t, "low", 1, "high") for i, t in rows]
    docs = spark.createDataFrame(table, "doc_id long, text string, low string, id int, lines string").repartition(5)
    for frequent_least in (1000, 4):  # lines looked up in the shards only, and where documents are read
        found = line_dedup.line_duplicates(docs, shard_bytes=20_000, frequent_least=frequent_least, with_text=True)
        assert pairs_of(found, *COLUMNS) == expected(rows)
    assert sum(r[2] for r in expected(rows)) > 50


def test_few_copies_of_one_row_are_one_document(spark):
    line = "a line of more than twenty characters"
    rows = [(1, line)] * 5 + [(2, line)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    assert {(r.doc_id, r.n_dropped) for r in line_dedup.line_duplicates(docs).collect()} == {(1, 0), (2, 0)}
    docs = spark.createDataFrame(rows + [(3, "x\n" + line + "\n" + line.upper())], "doc_id int, text string")
    found = {(r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.line_duplicates(docs).collect()}
    assert found == {(1, 1, 1), (2, 1, 1), (3, 3, 0)}


def test_empty_table(spark):
    found = line_dedup.line_duplicates(empty(spark))
    assert found.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"] and found.count() == 0


def test_perfect_hash_is_minimal_and_survives_packing():
    rng = np.random.default_rng(4)
    high, low = rng.integers(0, 1 << 63, (2, 5000), dtype=np.uint64)
    high[:50] = high[0]  # keys that differ in one half only
    hashing = line_dedup.PerfectHash(high, low)
    assert sorted(hashing.places(high, low).tolist()) == list(range(5000))
    bits = sum(64 * len(words) for words in hashing.levels)
    assert bits < 5000 * 4
    ids = np.arange(5000) % 7
    index = line_dedup.LineIndex(np.repeat(high, 3), np.repeat(low, 3), np.repeat(ids, 3) + np.tile([0, 1, 2], 5000), np.ones(15000, np.int64), 3)
    packed = line_dedup._pack(index, 10)
    again = line_dedup._unpack(*packed[:-1])
    assert again.dropped(high, low, ids).all() and not again.dropped(high, low, ids + 2).any()
    assert not again.dropped(high + np.uint64(1), low ^ np.uint64(5), ids).any()
