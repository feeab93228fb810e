"""Byte-level BPE by a sentencepiece model that is written straight from the vocabulary.

Each token becomes one piece: its bytes mapped to printable letters, scored by
its negative rank, so that the best merge is that of the lowest rank. The
normaliser is the identity: nothing is added, removed or escaped. Ids of the model
are ranks plus one, as piece 0 is the unknown piece, which is never used.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rasterledger.llm.pretokens import Splitter, words_of
from rasterledger.llm.texts import chunks
from rasterledger.llm.vocabulary import KEPT_WORDS, byte_letters, from_ranks

# Fields and kinds of the model message. Fixed values.
PIECE, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
MODEL_TYPE_FIELD, BPE = 3, 2
NAME_FIELD, DUMMY_PREFIX_FIELD, EXTRA_SPACES_FIELD, ESCAPE_FIELD = 1, 3, 4, 5
UNKNOWN_PIECE = "⁇"


def _number(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer message."""
    if isinstance(value, bytes):
        return _number(number << 3 | 2) + _number(len(value)) + value
    if isinstance(value, float):
        return _number(number << 3 | 5) + struct.pack("<f", value)
    return _number(number << 3) + _number(value)


def model_of(ranks: dict[bytes, int]) -> bytes:
    """Serialised sentencepiece BPE model of a vocabulary whose ranks run from 0 without gaps."""
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[token] for token in order] != list(range(len(order))):
        raise ValueError("ranks must run from 0 without gaps")
    letters = byte_letters()
    message = [_field(PIECE, _field(1, UNKNOWN_PIECE.encode()) + _field(2, 0.0) + _field(3, UNKNOWN))]
    for rank, token in enumerate(order):
        piece = "".join(letters[byte] for byte in token).encode()
        message.append(_field(PIECE, _field(1, piece) + _field(2, -float(rank)) + _field(3, NORMAL)))
    message.append(_field(TRAINER, _field(MODEL_TYPE_FIELD, BPE) + _field(4, len(order) + 1)))
    flags = (DUMMY_PREFIX_FIELD, EXTRA_SPACES_FIELD, ESCAPE_FIELD)
    message.append(_field(NORMALIZER, _field(NAME_FIELD, b"identity") + b"".join(_field(f, 0) for f in flags)))
    return b"".join(message)


class ByteCodec:
    """Encodes pre-tokens and decodes ids with the model of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_of(ranks))
        self.letters = byte_letters()
        back = {ord(letter): byte for byte, letter in enumerate(self.letters)}
        self.bytes_of = [bytes(map(back.__getitem__, map(ord, self.model.id_to_piece(i + 1)))) for i in range(len(ranks))]

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ranks of each pre-token."""
        # Bytes are mapped as Latin-1 letters; translate() then sends each to its own letter.
        table = dict(enumerate(self.letters))
        mapped = [word.decode("latin-1").translate(table) for word in words]
        return [[i - 1 for i in ids] for ids in self.model.encode(mapped, num_threads=1)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Ids of every whole text and what they decode to, as digests.

    Returns (id, n_tokens, ids_sha256, decoded_sha256) and with ``with_ids`` also
    (ids, decoded). A null or empty text has no ids and decodes to nothing; repeated
    rows are encoded each; other columns of ``docs`` are left out; an empty table gives
    an empty one. Special strings are ordinary text. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ByteCodec(from_ranks(path))
        splitter = Splitter()
        known: dict[bytes, tuple[int, ...]] = {}
        decimal = [str(i) for i in range(len(codec.bytes_of))]
        for batch, texts in chunks(batches, "_text"):
            words = words_of(texts, splitter)
            if len(known) > KEPT_WORDS:
                known.clear()
            fresh = [w for w in words.distinct if w not in known]
            known.update(zip(fresh, map(tuple, codec.encode(fresh)), strict=True))
            coded = [known[w] for w in words.distinct]
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            pool = np.fromiter((i for ids in coded for i in ids), np.int64, int(sizes.sum()))
            begins = np.cumsum(sizes) - sizes
            count = sizes[words.which]
            ends = np.cumsum(count)
            total = int(ends[-1]) if len(ends) else 0
            flat = pool[np.arange(total) + np.repeat(begins[words.which] - (ends - count), count)]
            bounds = np.r_[0, ends][np.r_[0, np.cumsum(words.counts)]].tolist()
            ids_sha, text_sha, all_ids, decoded = [], [], [], []
            for a, b in zip(bounds, bounds[1:], strict=False):
                ids = flat[a:b].tolist()
                text = codec.decode(ids)
                ids_sha.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(text).hexdigest())
                if with_ids:
                    all_ids.append(ids)
                    decoded.append(text)
            arrays = [batch.column("_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays += [pa.array(all_ids, pa.list_(pa.int64())), pa.array(decoded, pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = docs.schema[id_column].dataType.simpleString()
    columns = f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    rows = docs.select(docs[id_column].alias("_id"), docs[text_column].alias("_text"))
    return rows.mapInArrow(run, columns + (", ids array<long>, decoded binary" if with_ids else ""))
