"""Hash columns. The stable hash is the only source of randomness in the package."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

TWO_POW_32 = 4294967296.0


def sha256_text(column: Column) -> Column:
    return F.sha2(column.cast("string"), 256)


def stable_hash32(value: Column, seed: int | Column = 0) -> Column:
    """Unsigned 32-bit integer taken from sha256("{seed}:{value}")."""
    seed_text = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    digest = F.sha2(F.concat_ws(":", seed_text, value.cast("string")), 256)
    # The reduction modulo 2^32 of the first 16 hex digits keeps digits 9 to 16.
    return F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint")


def uniform01(value: Column, seed: int | Column = 0) -> Column:
    """Deterministic draw in [0, 1)."""
    return stable_hash32(value, seed).cast("double") / F.lit(TWO_POW_32)


def _sorted_value(value: Column, kind: DataType) -> Column:
    """The value with the fields of its structs and the keys of its maps in ascending order, at every depth."""
    if isinstance(kind, StructType):
        fields = [_sorted_value(value.getField(f.name), f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda item: _sorted_value(item, kind.elementType))
    if isinstance(kind, MapType):
        if not isinstance(kind.keyType, StringType):
            raise TypeError("keys of JSON objects are strings")
        keys = F.array_sort(F.map_keys(value))
        return F.map_from_arrays(keys, F.transform(keys, lambda key: _sorted_value(value[key], kind.valueType)))
    return value


def canonical_json(value: Column, kind: DataType | None = None) -> Column:
    """JSON text with the keys of all objects in ascending order and no spaces.

    ``kind`` is the type of the value: structs, maps with string keys and arrays at any
    depth; the default is a flat map of strings. Types stay apart, so 512 is not "512", and
    fields without a value are written as null. A missing value gives null.
    """
    kind = kind or MapType(StringType(), StringType())
    return F.to_json(_sorted_value(value, kind), {"ignoreNullFields": "false"})


def hex_to_long(hex16: Column) -> Column:
    """Signed 64-bit view of a 16-digit hexadecimal hash."""
    return F.conv(hex16, 16, -10).cast("bigint")


def hamming_distance(left: Column, right: Column) -> Column:
    """Number of differing bits of two signed 64-bit hashes."""
    return F.bit_count(left.bitwiseXOR(right)).cast("int")


def hamming_hex(left: Column, right: Column) -> Column:
    """Hamming distance of two hexadecimal hashes; unequal lengths raise."""
    same = F.length(left) == F.length(right)
    distance = hamming_distance(hex_to_long(left), hex_to_long(right))
    return F.when(same, distance).otherwise(
        F.raise_error(F.lit("hashes have different lengths")).cast("int")
    )


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of one row, columns taken in name order, nulls kept distinct."""
    fields = F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(columns)])
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)
