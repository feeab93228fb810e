"""Views over the driver tables, one SQL text for both engines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterledger.session import fill_cores

SPLIT = (
    "case when {key} % 20 < 14 then 'train' when {key} % 20 < 17 then 'validation' else 'test' end"
)

VIEWS: dict[str, str] = {
    # Pixel predictions: one image per supplier.
    "px": """
        select l_suppkey as image_id,
               least(cast(1 as double), round(l_discount * 8 + cast(0.2 as double)
                     * (case when l_returnflag = 'R' then 1 else 0 end), 2)) as prob,
               case when l_returnflag = 'R' then 1 else 0 end as target
        from lineitem""",
    # Sparse 32x32 masks: absent cell = background.
    "grid": """
        select l_suppkey as image_id, cast(l_partkey % 32 as int) as y,
               cast(l_orderkey % 32 as int) as x,
               max(case when l_returnflag = 'R' then 1 else 0 end) as target,
               max(case when l_discount >= cast(0.05 as double) and l_returnflag <> 'N'
                        then 1 else 0 end) as pred
        from lineitem group by 1, 2, 3""",
    "manifest": f"""
        select doc_id as image_id, lang, source,
               cast(n_chars % 1000 as double) / 1000 as coverage,
               cast(n_chars % 97 + 5 as int) as width, cast(n_chars % 89 + 7 as int) as height,
               {SPLIT.format(key="doc_id")} as split, md5(text) as digest
        from documents""",
    "runs": f"""
        select o_orderkey as run_id, o_custkey as image_id, o_orderpriority as experiment,
               o_orderstatus as prompt_mode, {SPLIT.format(key="o_custkey")} as split,
               round((o_totalprice % 1000) / 1000, 6) as iou
        from orders""",
    "reqlog": """
        select event_id as request_id, ts, concat('v', cast(user_id % 3 as varchar(10))) as model_version,
               case when event_type = 'error' then 'error' else 'ok' end as status,
               value as total_ms
        from events""",
}

TABLE_OF = {"px": "lineitem", "grid": "lineitem", "manifest": "documents", "runs": "orders", "reqlog": "events"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = TABLE_OF[name]
    text = VIEWS[name].replace(f"from {source}", f"from {{{source}}}")
    return spark.sql(text, **{source: table(spark, sf_dir, source)})


def with_views(names: str, rest: str) -> str:
    """SQL text that defines the named views first. ``rest`` may go on with ", x as (...)"."""
    heads = ", ".join(f"{n} as ({VIEWS[n]})" for n in names.split())
    return f"with {heads} {rest}"


WORD_BITS = 64
#: Words whose bucket a task keeps, and bytes of texts that are cut into words together; one longer text is cut alone.
WORDS_KEPT, CHUNK_BYTES = 1 << 18, 16 << 20

# 64-bit document hashes: word counts in 64 buckets, bit = count >= mean, highest bit first.
DOCHASH_SQL = f"""
    doc_words as (select doc_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'),
                         lambda w: w <> '')) as word from documents),
    doc_cells as (select doc_id, ('0x' || substr(sha256('0:' || word), 9, 8))::bigint % 64 as bucket,
                         count(*) as n from doc_words group by 1, 2),
    doc_means as (select doc_id, sum(n) / 64.0::double as mean from doc_cells group by 1),
    dochash as (select c.doc_id as image_id,
                  sum(case when n >= mean then (1::hugeint << (63 - bucket)::int) else 0 end)::ubigint as bits,
                  {SPLIT.format(key="c.doc_id")} as split
                from doc_cells c join doc_means m on c.doc_id = m.doc_id group by c.doc_id)"""


def word_counts(documents: DataFrame) -> DataFrame:
    """(image_id, counts, words): word counts of whole texts in 64 buckets. Rows of one image are to be added up."""
    rows = fill_cores(documents.select("doc_id", "text"), "doc_id").select(F.col("doc_id").alias("image_id"), F.lower("text").alias("text"))
    return rows.mapInArrow(_count_words, f"image_id {rows.schema['image_id'].dataType.simpleString()}, counts array<bigint>, words bigint")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    buckets = WordBuckets()
    for batch in batches:
        texts = batch.column("text").fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        start = 0
        while start < len(batch):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, side="right")))
            images = batch.column("image_id").slice(start, stop - start).dictionary_encode(null_encoding="encode")
            counts = _counts(texts.slice(start, stop - start), images.indices.to_numpy(), len(images.dictionary), buckets)
            words = counts.sum(axis=1)
            kept = np.flatnonzero(words)
            lists = pa.ListArray.from_arrays(np.arange(len(kept) + 1, dtype=np.int32) * WORD_BITS, counts[kept].ravel())
            yield pa.RecordBatch.from_arrays([images.dictionary.take(pa.array(kept)), lists, pa.array(words[kept])], ["image_id", "counts", "words"])
            start = stop


def _counts(texts: pa.Array, images: np.ndarray, size: int, buckets: WordBuckets) -> np.ndarray:
    """Words of each image in each bucket. Words end at the six ASCII blanks, as at ``\\s`` in Spark."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten().dictionary_encode()
    cells = np.fromiter(map(buckets.__getitem__, words.dictionary.cast(pa.binary()).to_pylist()), np.int64, len(words.dictionary))
    rows = np.repeat(images * (WORD_BITS + 1), pc.list_value_length(lists).to_numpy())
    counted = np.bincount(rows + cells[words.indices.to_numpy()], minlength=size * (WORD_BITS + 1))
    return counted.reshape(size, WORD_BITS + 1)[:, :WORD_BITS]


class WordBuckets(dict):
    """Bucket of a word, ``stable_hash32(word, 0) % 64``, hashed once while the word is kept; 64 for the empty word."""

    def __missing__(self, word: bytes) -> int:
        # Digits 9 to 16 are bytes 4 to 7 of the digest, and 64 divides 256.
        bucket = hashlib.sha256(b"0:" + word).digest()[7] % WORD_BITS if word else WORD_BITS
        if len(word) <= 64:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = bucket
        return bucket
