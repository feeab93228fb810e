"""Small corpora with the odd cases that every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, digest string, node string, n_words string, tokens string"


def odd_texts() -> list:
    """Null, empty, white space, one word, long, many languages, ties and repeats."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    passage = " ".join(rng.choice(words) for _ in range(70))
    texts = [None, "", " ", "\n\t\r", "a", "The END", "the end", "ab" * 400, "x" * 3000, "日本語のテキスト 🎉 שלום", "I'll can't we've 'd '", "a<|endoftext|>b<|endoftext|>"]
    for i in range(40):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 90)))
        if i % 4 == 0:
            cut = rng.randint(0, 60)
            text = text[:40] + passage[cut : cut + rng.randint(150, 300)] + text[40:]
        texts.append(text)
    long = " ".join(rng.choice(words) for _ in range(9000))
    texts += [long, long.replace(words[3], "zzzz", 2), texts[20], texts[20].upper(), texts[21]]
    # Two words of equal polynomial hashes modulo 2 ** 64, whatever the odd base.
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    texts.append(word + "\n" + word.translate({97: 98, 98: 97}))
    return texts


def corpus(spark):
    """The odd texts, with a repeated row and columns whose names clash with those of results."""
    rows = [(i, t, "en", "d", "n", "w", "t") for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows + rows[25:26], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
