"""Token alignment against brute force over the tokenizer libraries."""

import hashlib
import os
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(__file__))
public_tokenizers = pytest.importorskip("public_tokenizers")

from corpora import corpus, empty, odd_texts, pairs_of  # noqa: E402
from rasterledger.llm import token_alignment  # noqa: E402

FIRST = public_tokenizers.path("byte_bpe_50k.json")
SECOND = public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")


def spans(pieces):
    at, out = 0, []
    for i, piece in pieces:
        out.append((at, at + len(piece), i))
        at += len(piece)
    return out


def tokens(first, second, letters, text):
    if not text:
        return [], []
    ids = first.encode(" " + text, add_special_tokens=False).ids
    a = [(i, bytes(letters[c] for c in first.id_to_token(i))) for i in ids]
    b = []
    for i in second.encode(text):
        piece = second.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return [], []
    return spans(a), spans(b)


def expected(rows):
    import sentencepiece
    from rasterledger.llm.vocabulary import byte_letters
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(FIRST)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=SECOND)
    letters = {c: i for i, c in enumerate(byte_letters())}
    parts, counts = [], Counter()
    for i, text in rows:
        a, b = tokens(first, second, letters, text)
        # Tokens that overlap lie near each other on both sides.
        links, j = [], 0
        for x in a:
            while j < len(b) and b[j][1] <= x[0]:
                j += 1
            k = j
            while k < len(b) and b[k][0] < x[1]:
                links.append((x[2], b[k][2]))
                k += 1
        counts.update(set(links))
        ends = sorted({x[1] for x in a} & {x[1] for x in b})
        groups = []
        for low, high in zip([0, *ends], ends, strict=False):
            groups.append("|".join(",".join(str(x[2]) for x in side if low <= x[0] and x[1] <= high) for side in (a, b)) if len(a) < 300 else None)
        parts.append((i, a, b, len(ends), links, groups))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for i, a, b, cuts, links, groups in parts:
        text = ";".join(groups) if None not in groups else None
        digest = hashlib.sha256(text.encode()).hexdigest() if text else "" if not a else None
        out.append((i, len(a), len(b), cuts, len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), digest, text))
    return out


def thue_morse(size):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(size))


def check(found, want):
    want = sorted(want, key=lambda r: repr(r[:7]))
    have = sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=lambda r: repr(r[:7]))
    assert len(have) == len(want)
    for mine, other in zip(have, want, strict=True):
        assert mine[:7] == other[:7]
        assert other[7] is None or mine[7:] == other[7:]
        assert mine[7] == (hashlib.sha256(mine[8].encode()).hexdigest() if mine[1] else "")


def test_alignment_equals_brute_force(spark):
    texts = odd_texts() + ["Tokenization of unbelievable words, naïve café 🎉🎉", " two  spaces", "line\nline\n\nend", "tab\there", "a" * 5000, "<s>plain</s> <unk>", "<0x41>", "▁under▁", "ﬁne ½", "x\x00y"]
    texts += ["The quick brown fox jumps over the lazy dog. " * n for n in (1, 2, 700)]
    word = thue_morse(1024)
    texts.append(word + "\n" + word.translate({97: 98, 98: 97}))
    rows = list(enumerate(texts))
    rows += [rows[20], (None, texts[21]), (3, texts[22])]
    docs = spark.createDataFrame([(i, t, "p", "t", 1) for i, t in rows], "doc_id long, text string, pairs string, times string, _row int").repartition(4)
    want = expected(rows)
    for frequent in (1_000_000, 30, 1):  # all pairs looked up where they are read, some, none
        check(token_alignment.aligned_documents(docs, FIRST, SECOND, frequent_pairs=frequent, with_groups=True), want)


def test_repeats_and_empty_table(spark):
    assert token_alignment.aligned_documents(corpus(spark), FIRST, SECOND).count() == len(odd_texts()) + 1
    found = token_alignment.aligned_documents(empty(spark), FIRST, SECOND)
    assert found.columns == list(COLUMNS[:-1]) and found.count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert pairs_of(token_alignment.aligned_documents(nothing, FIRST, SECOND), *COLUMNS[:-1]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
