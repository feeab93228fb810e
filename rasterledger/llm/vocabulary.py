"""Byte-level BPE vocabulary files, and the ids of whole texts by their distinct pre-tokens."""

from __future__ import annotations

import base64
import json

import numpy as np

from rasterledger.llm.pretokens import Splitter, words_of
from rasterledger.llm.texts import Texts

#: Distinct pre-tokens whose ids a task keeps before it begins anew; bounds its memory only.
KEPT_WORDS = 400_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary.

    Printable bytes of Latin-1 stand for themselves; the others, in order, are
    the letters from 256 on.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, extra = [], 256
    for byte in range(256):
        if byte in printable:
            letters.append(chr(byte))
        else:
            letters.append(chr(extra))
            extra += 1
    return letters


class Vocabulary:
    """Ids of byte strings, merges by rank, and special strings."""

    def __init__(self, ids: dict[bytes, int], merges: dict[tuple[bytes, bytes], int], special: dict[bytes, int]):
        self.ids = ids
        self.merges = merges
        self.special = special


def from_json(path: str) -> Vocabulary:
    """Vocabulary of a tokenizer file with a byte-level BPE model."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    back = {letter: byte for byte, letter in enumerate(byte_letters())}

    def raw(token: str) -> bytes:
        return bytes(back[letter] for letter in token)

    special = {t["content"].encode(): t["id"] for t in content["added_tokens"]}
    ids = {raw(t): i for t, i in content["model"]["vocab"].items() if t.encode() not in special}
    merges = {}
    for rank, pair in enumerate(content["model"]["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges[raw(left), raw(right)] = rank
    return Vocabulary(ids, merges, special)


def from_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Parts:
    """Texts cut where a special string stands; ``after`` has the special id behind a part, or -1."""

    def __init__(self, texts: Texts, special: dict[bytes, int]):
        whole = texts.data.tobytes()
        self.texts = texts
        self.counts = np.ones(len(texts), np.int64)
        self.after = np.full(len(texts), -1, np.int64)
        if not any(name in whole for name in special):
            return
        pieces, after, counts = [], [], []
        for i in range(len(texts)):
            rest, before = texts.one(i), len(pieces)
            while True:
                # The first special string from the left; of two at one place, the longer.
                found = min(((rest.find(name), -len(name), name) for name in special if name in rest), default=None)
                pieces.append(rest if found is None else rest[: found[0]])
                after.append(-1 if found is None else special[found[2]])
                if found is None:
                    break
                rest = rest[found[0] + len(found[2]) :]
            counts.append(len(pieces) - before)
        self.texts = Texts.of(pieces)
        self.counts = np.array(counts, np.int64)
        self.after = np.array(after, np.int64)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over the parts of each text."""
        ends = np.cumsum(self.counts)
        sums = np.r_[0, np.cumsum(values)]
        return sums[ends] - sums[ends - self.counts]


class Encoder:
    """Ids of whole texts; each distinct pre-token of some texts is encoded once."""

    def __init__(self, vocabulary: Vocabulary):
        import tiktoken

        self.special = vocabulary.special
        self.splitter = Splitter()
        # It is handed one pre-token at a time, which is one match.
        self.model = tiktoken.Encoding("words", pat_str="(?s:.+)", mergeable_ranks=vocabulary.ids, special_tokens={})
        self.known: dict[bytes, bytes] = {}

    def _word(self, word: bytes) -> bytes:
        ids = np.array(self.model.encode_ordinary(word.decode("utf-8")), "<u4").tobytes()
        self.known[word] = ids
        return ids

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each text has."""
        parts = Parts(texts, self.special)
        words = words_of(parts.texts, self.splitter)
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        known = self.known
        coded = [known.get(w) or self._word(w) for w in words.distinct]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        pool = np.frombuffer(b"".join(coded), "<u4")
        begins = np.cumsum(sizes) - sizes
        count = sizes[words.which]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = pool[np.arange(total) + np.repeat(begins[words.which] - (ends - count), count)]
        sums = np.r_[0, ends][np.r_[0, np.cumsum(words.counts)]]
        lengths = np.diff(sums)
        marked = np.flatnonzero(parts.after >= 0)
        if len(marked):
            ids = np.insert(ids, np.cumsum(lengths)[marked], parts.after[marked])
            lengths[marked] += 1
        return ids, parts.per_text(lengths)
