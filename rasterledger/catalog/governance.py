"""Source, key, validation, join, leakage and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterledger.catalog.evaluation import r6
from rasterledger.catalog.registry import query
from rasterledger.catalog.views import (
    DOCHASH_SQL,
    SPLIT,
    table,
    view,
    with_views,
    word_counts,
)
from rasterledger.functions.hashing import (
    canonical_json,
    hamming_hex,
    sha256_text,
    stable_hash32,
)
from rasterledger.operators import binning, checks, fingerprints, leakage, pairing, splitting, validation
from rasterledger.operators.checks import duplicates
from rasterledger.session import pin
from rasterledger.sources import files, sinks

SEED = 42


def h5(value: str, seed: str = "42") -> str:
    """SQL of the stable hash."""
    return f"('0x' || substr(sha256('{seed}:' || {value}), 9, 8))::bigint"


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def manifest(spark, sf_dir):
    return view(spark, sf_dir, "manifest")


def dochash(spark, sf_dir):
    """(image_id, bits, image_ahash, split) of whole document texts."""
    hashed = fingerprints.hash_of_counts(word_counts(documents(spark, sf_dir)), "image_id")
    return hashed.withColumn("split", F.expr(SPLIT.format(key="image_id")))


# --- sources ------------------------------------------------------------------

_LISTING = """select concat('/data/', source, case when doc_id % 3 = 0 then '/Masks/' else '/Images/' end,
    'Doc', cast(doc_id % 700 as varchar(20)),
    case doc_id % 5 when 0 then '.png' when 1 then '.JPG' when 2 then '.tif' when 3 then '.txt' else '.jpeg' end)
    as path from documents"""
_SUPPORTED = r""", supported as (select path, regexp_extract(path, '([^/]*)$', 1) as filename,
    lower(regexp_extract(path, '([^/]*)\.[^.]+$', 1)) as stem from listing
    where lower(regexp_extract(path, '(\.[^.]+)$', 1)) in ('.png', '.jpg', '.jpeg', '.tif', '.tiff'))"""
_FILES = f"with listing as ({_LISTING}){_SUPPORTED}"


def listing(spark, sf_dir):
    return spark.sql(_LISTING.replace("from documents", "from {documents}"), documents=documents(spark, sf_dir))


@query("s1_supported_files", f"{_FILES} select path, stem, filename from supported")
def _s1(spark, sf_dir):
    return files.supported_files(listing(spark, sf_dir))


@query("s2_files_with_given_extensions", f"{_FILES} select path, stem, filename from supported where lower(filename) like '%.tif'")
def _s2(spark, sf_dir):
    return files.supported_files(listing(spark, sf_dir), [".TIF"])


@query(
    "s3_candidate_roots",
    f"""{_FILES}, c as (select regexp_extract(path, '^(.*)/(Images|Masks)/', 1) as root,
          count(*) filter (path like '%/Images/%') as image_count,
          count(*) filter (path like '%/Masks/%') as mask_count from supported group by 1)
        select root, image_count, mask_count, least(image_count, mask_count) as paired_capacity from c
        where image_count > 0 and mask_count > 0
        order by 4 desc, image_count + mask_count desc, root limit 1""",
)
def _s3(spark, sf_dir):
    return files.best_root(files.candidate_roots(listing(spark, sf_dir)))


@query(
    "s5_json_lines",
    """select event_id, (props::json->>'k')::bigint as k from events where trim(props) <> ''""",
)
def _s5(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select("event_id", "props")
    return files.parse_json_lines(lines, "k bigint", "props").select("event_id", "k")


@query(
    "s8_metric_log_rows",
    """select o_orderkey as step, '{"iou":' || (o_orderkey % 8 / 8.0::double)::varchar || ',"loss":'
       || (o_custkey % 4 / 4.0::double)::varchar || '}' as value from orders""",
)
def _s8(spark, sf_dir):
    steps = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_orderkey % 8 / 8.0D as iou", "o_custkey % 4 / 4.0D as loss"
    )
    return sinks.metric_log_rows(steps, "o_orderkey", ["loss", "iou"])


@query(
    "s9_failure_ledger",
    """select event_type as stage, epoch_us(ts)::bigint as timestamp_us,
         '{"event":"' || event_id || '","user":"' || user_id || '"}' as configuration_json,
         case when value > 100 then 'Timeout' else '' end as error_type, '' as error_message,
         '' as root_cause, '' as resolution, 'pending' as rerun_status
       from events where event_type = 'error'""",
)
def _s9(spark, sf_dir):
    failed = (
        table(spark, sf_dir, "events")
        .where("event_type = 'error'")
        .select(
            F.col("event_type").alias("stage"),
            F.col("ts").cast("timestamp").alias("timestamp_utc"),
            F.create_map(
                F.lit("user"), F.col("user_id").cast("string"), F.lit("event"), F.col("event_id").cast("string")
            ).alias("configuration"),
            F.when(F.col("value") > 100, "Timeout").alias("error_type"),
        )
    )
    ledger = sinks.failure_rows(failed)
    return ledger.select(
        *[c for c in ledger.columns if c != "timestamp_utc"], F.unix_micros("timestamp_utc").alias("timestamp_us")
    )


_LANES = ", ".join(f"coalesce(sum(('0x' || substr(r, {4 * i + 1}, 4))::bigint), 0)::bigint" for i in range(16))
DIGEST_SQL = f""", row_digests as (select sha256('{{"digest":"' || digest || '","image_id":"' || image_id || '","lang":"'
      || lang || '","split":"' || split || '"}}') as r from manifest),
  digest as (select sha256(concat_ws(':', count(*), {_LANES})) as digest, count(*) as rows from row_digests)"""


@query(
    "s10_registry_payload",
    with_views(
        "manifest",
        f"""{DIGEST_SQL} select count(*) as total_pairs, count(*) filter (split = 'train') as train_pairs,
            count(*) filter (split = 'validation') as validation_pairs,
            count(*) filter (split = 'test') as test_pairs,
            (select digest from digest) as split_registry_sha256 from manifest""",
    ),
)
def _s10(spark, sf_dir):
    return sinks.registry_payload(manifest(spark, sf_dir).select("image_id", "split", "lang", "digest"))


@query(
    "s11_merge_splits",
    with_views("manifest", "select split, count(*) as images, sum(image_id)::bigint as id_sum from manifest group by split"),
)
def _s11(spark, sf_dir):
    m = manifest(spark, sf_dir)
    parts = {s: m.where(F.col("split") == s).drop("split") for s in ("train", "validation", "test")}
    return files.merge_splits(parts).groupBy("split").agg(
        F.count(F.lit(1)).alias("images"), F.sum("image_id").alias("id_sum")
    )


@query(
    "s12_tagged_union",
    with_views(
        "runs",
        """select experiment as run_table, count(*) as rows, count(iou) as scored,
           count(prompt_mode) as with_mode from
           (select experiment, iou, case when experiment = '1-URGENT' then prompt_mode end as prompt_mode from runs)
           group by 1""",
    ),
)
def _s12(spark, sf_dir):
    runs = view(spark, sf_dir, "runs")
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    frames = {
        n: runs.where(F.col("experiment") == n).select("iou", *(["prompt_mode"] if n == "1-URGENT" else []))
        for n in names
    }
    return files.tag_and_union(frames, "run_table").groupBy("run_table").agg(
        F.count(F.lit(1)).alias("rows"), F.count("iou").alias("scored"), F.count("prompt_mode").alias("with_mode")
    )


# --- keys and digests ---------------------------------------------------------


@query("h1_content_sha256", "select doc_id as path, sha256(text) as sha256 from documents")
def _h1(spark, sf_dir):
    raw = documents(spark, sf_dir).select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return files.with_sha256(raw)


@query("h2_text_sha256", "select page_id, sha256(html) as digest from pages")
def _h2(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", sha256_text(F.col("html")).alias("digest"))


_H3_TEXT = """'{"lang":"' || lang || '","n_chars":"' || n_chars || '","source":"' || source || '"}'"""


@query("h3_canonical_json", f"select doc_id, {_H3_TEXT} as payload, sha256({_H3_TEXT}) as digest from documents")
def _h3(spark, sf_dir):
    fields = F.create_map(
        F.lit("source"), F.col("source"), F.lit("n_chars"), F.col("n_chars").cast("string"), F.lit("lang"), F.col("lang")
    )
    rows = documents(spark, sf_dir).select("doc_id", canonical_json(fields).alias("payload"))
    return rows.withColumn("digest", sha256_text(F.col("payload")))


_H3_NESTED = """'{"counts":{"' || lang || '":' || n_chars || '},"meta":{"lang":"' || lang || '","source":"' || source
  || '"},"missing":null,"n_chars":' || n_chars || ',"parts":[1,' || (n_chars % 7) || ']}'"""


@query("h3_nested_json", f"select doc_id, {_H3_NESTED} as payload, sha256({_H3_NESTED}) as digest from documents")
def _h3_nested(spark, sf_dir):
    rows = documents(spark, sf_dir).select(
        "doc_id",
        F.struct(
            "n_chars",
            F.struct("source", "lang").alias("meta"),
            F.array(F.lit(1).cast("bigint"), F.col("n_chars") % 7).alias("parts"),
            F.create_map("lang", "n_chars").alias("counts"),
            F.lit(None).cast("string").alias("missing"),
        ).alias("settings"),
    )
    payload = canonical_json(F.col("settings"), rows.schema["settings"].dataType)
    return rows.select("doc_id", payload.alias("payload")).withColumn("digest", sha256_text(F.col("payload")))


@query("h4_table_digest", with_views("manifest", f"{DIGEST_SQL} select digest, rows from digest"))
def _h4(spark, sf_dir):
    return fingerprints.table_digest(manifest(spark, sf_dir), ["image_id", "split", "lang", "digest"])


@query("h5_stable_hash", f"select l_orderkey, l_linenumber, {h5('l_orderkey')} as hash from lineitem")
def _h5(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", stable_hash32(F.col("l_orderkey"), SEED).alias("hash")
    )


@query(
    "h6_average_hash_of_texts",
    f"with {DOCHASH_SQL} select image_id, split, lower(lpad(hex(bits), 16, '0')) as image_ahash from dochash",
)
def _h6(spark, sf_dir):
    return dochash(spark, sf_dir).select("image_id", "split", "image_ahash")


@query(
    "h6_average_hash_of_pixels",
    with_views(
        "grid",
        """, cells as (select image_id, (y // 4) * 8 + x // 4 as bucket, sum(pred * 255.0::double) / 16 as v
              from grid group by 1, 2), m as (select image_id, sum(v) / 64 as mean from cells group by 1)
           select c.image_id, lower(lpad(hex(case when any_value(mean) <= 0 then 18446744073709551615::ubigint
             else sum(case when v >= mean then 1::hugeint << (63 - bucket) else 0 end)::ubigint end), 16, '0'))
             as image_ahash from cells c join m using (image_id) group by 1""",
    ),
)
def _h6_pixels(spark, sf_dir):
    pixels = view(spark, sf_dir, "grid").select(
        "image_id", "y", "x", (F.col("pred") * 255.0).alias("value"), F.lit(32).alias("height"), F.lit(32).alias("width")
    )
    return fingerprints.average_hash(pixels).select("image_id", "image_ahash")


@query(
    "h7_hamming_distance",
    f"""with {DOCHASH_SQL} select a.image_id, bit_count(xor(a.bits::hugeint, b.bits::hugeint))::int as distance
        from dochash a join dochash b on b.image_id = a.image_id + 1""",
)
def _h7(spark, sf_dir):
    hashed = dochash(spark, sf_dir).select("image_id", "image_ahash")
    following = hashed.select((F.col("image_id") - 1).alias("image_id"), F.col("image_ahash").alias("next"))
    return hashed.join(following, "image_id").select(
        "image_id", hamming_hex(F.col("image_ahash"), F.col("next")).alias("distance")
    )


@query(
    "h8_study_fingerprint",
    with_views(
        "manifest",
        f"""{DIGEST_SQL}, p as (select '{{"image_size":"512","manifest_sha256":"' || (select digest from digest)
              || '","resize_policy":"letterbox","study":"base"}}' as payload)
            select payload, sha256(payload) as fingerprint from p""",
    ),
)
def _h8(spark, sf_dir):
    settings = spark.createDataFrame(
        [("study", "base"), ("resize_policy", "letterbox"), ("image_size", "512")], "name string, value string"
    )
    rows = manifest(spark, sf_dir).select("image_id", "split", "lang", "digest")
    return fingerprints.study_fingerprint(settings, {"manifest_sha256": rows})


@query(
    "h8_typed_fingerprint",
    with_views(
        "manifest",
        f"""{DIGEST_SQL}, p as (select '{{"image_size":512,"manifest_sha256":"' || (select digest from digest)
              || '","optimizer":{{"rate":0.25,"schedule":[1,2,3]}},"study":"base"}}' as payload)
            select payload, sha256(payload) as fingerprint from p""",
    ),
)
def _h8_typed(spark, sf_dir):
    settings = spark.createDataFrame(
        [("base", ([1, 2, 3], 0.25), 512)], "study string, optimizer struct<schedule: array<int>, rate: double>, image_size int"
    )
    rows = manifest(spark, sf_dir).select("image_id", "split", "lang", "digest")
    return fingerprints.typed_study_fingerprint(settings, {"manifest_sha256": rows}).select("payload", "fingerprint")


@query(
    "h8_fingerprint_mismatches",
    """select doc_id as study, sha256(text || '!') as stored_fingerprint, sha256(text) as current_fingerprint
       from documents join labels using (doc_id) where toxic = 1""",
)
def _h8_mismatches(spark, sf_dir):
    """Each document is a study; those labelled toxic were stored with another text."""
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    current = docs.select(F.col("doc_id").alias("study"), sha256_text(F.col("text")).alias("fingerprint"))
    stored = docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("study"),
        sha256_text(F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("fingerprint"),
    )
    return fingerprints.fingerprint_mismatches(current, stored)


@query(
    "h9_digest_audit",
    """select doc_id as artefact, found is not null as present, coalesce(length(found) = 64, false) as well_formed,
         coalesce(expected = found, false) as hashes_equal
       from (select d.doc_id, sha256(d.text) as expected,
               case when l.doc_id is null then null when l.toxic = 1 then md5(d.text)
                    when l.quality = 0 then sha256(d.text || '!') else sha256(d.text) end as found
             from documents d left join labels l using (doc_id))""",
)
def _h9(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    expected = docs.select(F.col("doc_id").alias("artefact"), sha256_text(F.col("text")).alias("digest"))
    found = docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("artefact"),
        F.when(F.col("toxic") == 1, F.md5("text"))
        .when(F.col("quality") == 0, sha256_text(F.concat("text", F.lit("!"))))
        .otherwise(sha256_text(F.col("text")))
        .alias("digest"),
    )
    return fingerprints.digest_audit(expected, found)


# --- filters and validation ---------------------------------------------------


@query("f2_split_filter", with_views("manifest", "select image_id, split from manifest where split = 'validation'"))
def _f2(spark, sf_dir):
    return validation.split_rows(manifest(spark, sf_dir).select("image_id", "split"), "val")


@query(
    "f3_test_firewall",
    with_views(
        "manifest",
        """select image_id from manifest where split = 'test'
           union select m.image_id from manifest m join labels l on m.image_id = l.doc_id where l.toxic = 1""",
    ),
)
def _f3(spark, sf_dir):
    held_out = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("image_id"))
    return validation.firewall_breaches(manifest(spark, sf_dir), held_out)


def _checked(spark, sf_dir):
    m = manifest(spark, sf_dir)
    masks = m.select(
        "image_id",
        F.when(F.col("image_id") % 11 != 0, F.col("width")).alias("mask_width"),
        F.when(F.col("image_id") % 7 == 0, F.col("height") + 1).otherwise(F.col("height")).alias("mask_height"),
    )
    return validation.with_status(m.join(masks, "image_id"), validation.pair_rules())


@query(
    "f4_row_validation",
    with_views(
        "manifest",
        """select image_id, case when image_id % 11 = 0 then 'UnreadableMask' else 'ValueError' end as error_type,
             case when image_id % 11 = 0 then 'mask cannot be decoded' else
               'Image and mask dimensions differ: (' || width || ', ' || height || ') vs (' || width || ', '
               || (height + 1) || ')' end as error_message
           from manifest where image_id % 11 = 0 or image_id % 7 = 0""",
    ),
)
def _f4(spark, sf_dir):
    _, errors = validation.valid_and_errors(_checked(spark, sf_dir))
    return errors.select("image_id", "error_type", "error_message")


@query(
    "f4_valid_rows",
    with_views("manifest", "select image_id, width, height from manifest where image_id % 11 <> 0 and image_id % 7 <> 0"),
)
def _f4_valid(spark, sf_dir):
    valid, _ = validation.valid_and_errors(_checked(spark, sf_dir))
    return valid.select("image_id", "width", "height")


@query(
    "f5_mask_statistics",
    with_views(
        "grid",
        """select image_id, sum(pred)::bigint as foreground_pixels, 1024::bigint as total_pixels,
             round(sum(pred) / 1024.0::double, 6) as foreground_fraction,
             array_to_string(list_sort(list_distinct(list(pred * 255) || case when count(*) < 1024 then [0] else [] end)), ',')
               as mask_unique_values
           from grid group by image_id""",
    ),
)
def _f5(spark, sf_dir):
    sides = F.lit(32).alias("height"), F.lit(32).alias("width")
    pixels = view(spark, sf_dir, "grid").select("image_id", (F.col("pred") * 255).alias("value"), *sides)
    return r6(validation.mask_statistics(pixels))


@query(
    "f6_binary_mask",
    with_views(
        "grid",
        "select image_id, bool_and(pred * 255 - image_id % 2 in (0, 255)) as mask_binary from grid group by image_id",
    ),
)
def _f6(spark, sf_dir):
    pixels = view(spark, sf_dir, "grid").select(
        "image_id", (F.col("pred") * 255 - F.col("image_id") % 2).alias("value")
    )
    return validation.binary_mask_check(pixels)


@query(
    "f7_log_evidence",
    with_views(
        "reqlog",
        """select model_version, count(*) as rows, bool_or(status = 'ok') as log_has_success,
           bool_and(status = 'ok') as log_all_ok from reqlog group by 1""",
    ),
)
def _f7(spark, sf_dir):
    return validation.log_evidence(view(spark, sf_dir, "reqlog"), ["model_version"])


@query(
    "f8_upload_contract",
    """with u as (select doc_id as request_id, case when lang = 'en' then 'image/png' when lang = 'de' then 'image/jpeg'
              when lang = 'fr' then 'text/html' else 'image/tiff' end as content_type,
            case when doc_id % 13 = 0 then 0 else n_chars end as size_bytes, doc_id % 17 <> 0 as readable,
            (n_chars % 97 + 5) * (n_chars % 89 + 7) as pixels, doc_id % 19 <> 0 as ready from documents),
       r as (select request_id, case when content_type not in ('image/png', 'image/jpeg', 'image/tiff') then 'unsupported content type'
              when size_bytes = 0 then 'empty file' when size_bytes > 20000 then 'too many bytes'
              when not readable then 'unreadable image' when pixels > 6000 then 'too many pixels'
              when not ready then 'model not ready' else 'accepted' end as reason from u)
       select request_id, reason, (case reason when 'unsupported content type' then 415 when 'empty file' then 400
          when 'too many bytes' then 413 when 'unreadable image' then 400 when 'too many pixels' then 413
          when 'model not ready' then 503 else 200 end)::int as status_code from r""",
)
def _f8(spark, sf_dir):
    uploads = documents(spark, sf_dir).selectExpr(
        "doc_id as request_id",
        "case when lang = 'en' then 'image/png' when lang = 'de' then 'image/jpeg' when lang = 'fr' then 'text/html' "
        "else 'image/tiff' end as content_type",
        "case when doc_id % 13 = 0 then 0 else n_chars end as size_bytes",
        "doc_id % 17 <> 0 as readable",
        "cast(n_chars % 97 + 5 as int) as width",
        "cast(n_chars % 89 + 7 as int) as height",
        "doc_id % 19 <> 0 as ready",
    )
    checked = validation.upload_contract(uploads, max_bytes=20_000, max_pixels=6_000)
    return checked.select("request_id", "reason", "status_code")


@query(
    "f9_relative_path",
    f"""with listing as ({_LISTING}) select path, case when path like '/data/src0/%' then substr(path, 12)
        else regexp_extract(path, '([^/]*)$', 1) end as relative_path from listing""",
)
def _f9(spark, sf_dir):
    return listing(spark, sf_dir).withColumn("relative_path", validation.relative_path(F.col("path"), "/data/src0"))


@query(
    "f10_missing_files",
    """select distinct d.doc_id as image_id from documents d
       where d.doc_id not in (select doc_id from labels) or d.doc_id % 10 = 0""",
)
def _f10(spark, sf_dir):
    registry = documents(spark, sf_dir).select(
        F.col("doc_id").alias("image_id"),
        F.format_string("Images/%d.png", "doc_id").alias("image_relative_path"),
        F.format_string("Masks/%d.png", "doc_id").alias("mask_relative_path"),
    )
    paths = validation.runtime_paths(
        registry, "/data", {"image_relative_path": "image_path", "mask_relative_path": "mask_path"}
    )
    labels = table(spark, sf_dir, "labels")
    found = labels.select(F.format_string("/data/Images/%d.png", "doc_id").alias("path")).unionByName(
        labels.where("doc_id % 10 <> 0").select(F.format_string("/data/Masks/%d.png", "doc_id").alias("path"))
    )
    return validation.missing_files(paths, found, ["image_path", "mask_path"])


@query(
    "f11_fixed_projection",
    with_views(
        "manifest",
        """select image_id, split, null::varchar as image_filename, width, height,
           null::varchar as image_ahash from manifest""",
    ),
)
def _f11(spark, sf_dir):
    wanted = ["image_id", "split", "image_filename", "width", "height", "image_ahash"]
    return validation.fixed_projection(manifest(spark, sf_dir), wanted)


@query(
    "f12_binarise",
    with_views("px", "select image_id, sum((prob >= 0.45::double)::int)::bigint as positives from px group by image_id"),
)
def _f12(spark, sf_dir):
    from rasterledger.functions.scalars import binarise

    return view(spark, sf_dir, "px").groupBy("image_id").agg(F.sum(binarise(F.col("prob"), 0.45)).alias("positives"))


@query(
    "f14_percentile_stretch",
    with_views(
        "px",
        """, q as (select image_id, target, quantile_cont(prob, 0.02) as lo, quantile_cont(prob, 0.98) as hi
              from px group by 1, 2)
           select image_id, target as band, floor(round(least(greatest((prob - lo) / greatest(hi - lo, 1e-6), 0), 1) * 255, 6))::int as stretched,
             count(*) as pixels from px join q using (image_id, target) group by all""",
    ),
)
def _f14(spark, sf_dir):
    pixels = view(spark, sf_dir, "px").withColumnRenamed("target", "band")
    done = validation.percentile_stretch(pixels, ["image_id", "band"], "prob")
    return done.groupBy("image_id", "band", "stretched").agg(F.count(F.lit(1)).alias("pixels"))


# --- joins and set operations -------------------------------------------------


def _label_masks(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("image_id"), "quality", "toxic")


@query("j1_strict_pairs", "select doc_id as image_id, lang, n_chars from documents")
def _j1(spark, sf_dir):
    # Two listings of the same records; the check runs over all of both.
    images = documents(spark, sf_dir).select(F.col("doc_id").alias("image_id"), "lang")
    masks = documents(spark, sf_dir).select(F.col("doc_id").alias("image_id"), "n_chars")
    return pairing.strict_pairs(images, masks)


@query(
    "j1_pairing_verdicts",
    """with i as (select doc_id as image_id, count(*) as n from documents group by 1),
         k as (select case when quality = 0 then -doc_id else doc_id end as image_id, toxic from labels),
         m as (select image_id, sum(1 + toxic)::bigint as n from k group by 1),
         c as (select image_id, coalesce(i.n, 0) as images, coalesce(m.n, 0) as masks from i full join m using (image_id))
       select *, case when images > 1 or masks > 1 then 'ambiguous' when masks = 0 then 'image alone'
         when images = 0 then 'mask alone' else 'paired' end as verdict from c""",
)
def _j1_verdicts(spark, sf_dir):
    # Masks of rejected records carry another key, toxic ones are listed twice.
    labels = table(spark, sf_dir, "labels")
    key = F.when(F.col("quality") == 0, -F.col("doc_id")).otherwise(F.col("doc_id")).alias("image_id")
    masks = labels.select(key, F.explode(F.sequence(F.lit(0), F.col("toxic").cast("int"))).alias("copy"))
    return pairing.pairing_verdicts(documents(spark, sf_dir).select(F.col("doc_id").alias("image_id")), masks)


@query(
    "f1_schema_contract",
    """select 'doc_id' as "column", 'bigint' as expected, 'bigint' as found, true as holds, count(*) as rows, count(*) filter (doc_id is null) as missing_values from documents
       union all select 'text', 'string', 'string', true, count(*), count(*) filter (text is null) from documents
       union all select 'n_chars', 'int', 'bigint', false, count(*), count(*) filter (n_chars is null) from documents
       union all select 'license', 'string', null, false, count(*), count(*) from documents""",
)
def _f1(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return checks.schema_contract(docs, {"doc_id": "bigint", "text": "string", "n_chars": "int", "license": "string"})


@query(
    "j1_pairing_report",
    """select count(*) filter (l.doc_id is not null and d.doc_id is not null) as paired,
         count(*) filter (l.doc_id is null) as images_without_masks,
         count(*) filter (d.doc_id is null) as masks_without_images
       from documents d full join labels l on d.doc_id = l.doc_id""",
)
def _j1_report(spark, sf_dir):
    return pairing.pairing_report(manifest(spark, sf_dir), _label_masks(spark, sf_dir))


@query("j2_lenient_pairs", "select doc_id as image_id, lang, quality, toxic from documents join labels using (doc_id)")
def _j2(spark, sf_dir):
    return pairing.lenient_pairs(manifest(spark, sf_dir).select("image_id", "lang"), _label_masks(spark, sf_dir))


@query(
    "j3_recover_split",
    with_views("manifest", "select image_id::varchar as image_id, split, coverage from manifest"),
)
def _j3(spark, sf_dir):
    m = manifest(spark, sf_dir)
    history = m.select(
        F.format_string(" %d ", "image_id").alias("image_id"),
        F.when(F.col("split") == "validation", "VAL").otherwise(F.upper("split")).alias("split"),
    )
    # History lists two runs of every image; the labels agree.
    return pairing.recover_split(m.select("image_id", "coverage"), history.unionByName(history))


@query(
    "j3_split_conflicts",
    with_views(
        "runs",
        """select image_id::varchar as image_id, count(distinct case when prompt_mode = 'P' then 'test' else split end) as labels
           from runs group by 1 having count(distinct case when prompt_mode = 'P' then 'test' else split end) > 1""",
    ),
)
def _j3_conflicts(spark, sf_dir):
    runs = view(spark, sf_dir, "runs")
    label = F.when(F.col("prompt_mode") == "P", "test").otherwise(F.col("split"))
    return pairing.split_conflicts(runs.select("image_id", label.alias("split")))


def averaged_runs(spark, sf_dir, mode):
    """One row per (image, experiment) of one mode."""
    return (
        view(spark, sf_dir, "runs")
        .where(F.col("prompt_mode") == mode)
        .groupBy("image_id", "experiment")
        .agg(F.avg("iou").alias("iou"))
    )


PAIRED_SQL = """, f as (select image_id, experiment, avg(iou) as iou from runs where prompt_mode = 'F' group by 1, 2),
  o as (select image_id, experiment, avg(iou) as iou from runs where prompt_mode = 'O' group by 1, 2),
  paired as (select image_id, experiment, f.iou as iou_current, o.iou as iou_reference from f join o using (image_id, experiment))"""


def paired_runs(spark, sf_dir):
    return pairing.paired_comparison(
        averaged_runs(spark, sf_dir, "F"), averaged_runs(spark, sf_dir, "O"), ["image_id", "experiment"], "iou"
    )


@query(
    "j4_paired_comparison",
    with_views(
        "runs",
        f"{PAIRED_SQL} select image_id, experiment, round(iou_current, 6) as iou_current, round(iou_reference, 6) as iou_reference from paired",
    ),
)
def _j4(spark, sf_dir):
    return r6(paired_runs(spark, sf_dir))


@query(
    "j5_enrichment",
    with_views(
        "runs",
        """select run_id, image_id, experiment, prompt_mode, split, iou, c_mktsegment as segment,
             case when c_acctbal > 0 then 'train' else 'test' end as split_registry
           from runs left join customer on image_id = c_custkey""",
    ),
)
def _j5(spark, sf_dir):
    registry = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as image_id",
        "c_mktsegment as segment",
        "case when c_acctbal > 0 then 'train' else 'test' end as split",
    )
    return pairing.enrich(view(spark, sf_dir, "runs"), registry, ["image_id"])


@query("u1_union_all", "select count(*) as rows from (select doc_id from documents union all select doc_id from labels)")
def _u1(spark, sf_dir):
    both = documents(spark, sf_dir).select("doc_id").unionByName(table(spark, sf_dir, "labels").select("doc_id"))
    return both.agg(F.count(F.lit(1)).alias("rows"))


@query("u2_distinct_id_split", with_views("runs", "select distinct image_id, split from runs"))
def _u2(spark, sf_dir):
    return view(spark, sf_dir, "runs").select("image_id", "split").distinct()


@query("u3_except", "select doc_id as image_id from documents except select doc_id from labels")
def _u3(spark, sf_dir):
    return pairing.missing_keys(manifest(spark, sf_dir), _label_masks(spark, sf_dir), "image_id")


@query("u4_intersect", "select doc_id as image_id from documents intersect select doc_id from labels")
def _u4(spark, sf_dir):
    return pairing.common_keys(manifest(spark, sf_dir), _label_masks(spark, sf_dir), "image_id")


@query(
    "u5_prediction_parity",
    with_views(
        "grid",
        """select image_id, count(*) as cells, count(*) filter (pred <> target) as different from grid group by image_id""",
    ),
)
def _u5(spark, sf_dir):
    grid = view(spark, sf_dir, "grid")
    exported = grid.select("image_id", "y", "x", F.col("pred").alias("value"))
    reloaded = grid.select("image_id", "y", "x", F.col("target").alias("value"))
    return pairing.mask_differences(exported, reloaded, "value")


# --- duplicates and leakage ---------------------------------------------------


@query(
    "d1_duplicate_ids",
    "select l_orderkey, l_linenumber, count(*) as rows from lineitem group by 1, 2 having count(*) > 1",
)
def _d1(spark, sf_dir):
    return duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "d2_duplicate_stems",
    f"""{_FILES} select stem, path, count(*) as rows from supported
        where stem in (select stem from supported group by stem having count(*) > 1) group by 1, 2""",
)
def _d2(spark, sf_dir):
    return files.duplicate_stems(files.supported_files(listing(spark, sf_dir)))


@query(
    "d3_crossing_digests",
    with_views(
        "manifest",
        """select digest, count(distinct split) as splits, count(*) as rows, false as check_skipped from manifest
           group by digest having count(distinct split) > 1""",
    ),
)
def _d3(spark, sf_dir):
    return leakage.crossing_digests(manifest(spark, sf_dir), "digest")


@query(
    "d4_exact_duplicates",
    with_views(
        "manifest",
        """select coalesce(sum(n), 0)::bigint as duplicate_rows, count(*) as duplicate_digests from
           (select count(*) as n from manifest group by digest having count(*) > 1)""",
    ),
)
def _d4(spark, sf_dir):
    return leakage.exact_duplicate_rows(manifest(spark, sf_dir), "digest")


_HAMMING = "bit_count(xor(l.bits::hugeint, r.bits::hugeint))"
_GROUPS = f"""with {DOCHASH_SQL}, g as (select bits, split, count(*) as n from dochash group by 1, 2),
  pairs as (select l.bits as lb, r.bits as rb, l.split as left_split, r.split as right_split,
     {_HAMMING}::int as hamming_distance, l.n as left_images, r.n as right_images
     from g l join g r on l.split < r.split and {_HAMMING} <= 4)"""


def _hexed(df, *names):
    return df.withColumns({n: F.lower(F.lpad(F.hex(n), 16, "0")) for n in names})


@query(
    "d5_near_duplicate_groups",
    f"""{_GROUPS} select lower(lpad(hex(lb), 16, '0')) as left_bits, lower(lpad(hex(rb), 16, '0')) as right_bits, left_split,
        right_split, hamming_distance, left_images, right_images, left_images * right_images as image_pairs from pairs""",
)
def _d5(spark, sf_dir):
    groups = leakage.near_duplicate_groups(dochash(spark, sf_dir), hamming_threshold=4)
    return _hexed(groups, "left_bits", "right_bits")


@query(
    "d5_near_duplicate_images",
    f"""{_GROUPS}, s as (select lb as bits, left_split as split, right_images as partners, hamming_distance from pairs
          union all select rb, right_split, left_images, hamming_distance from pairs),
        t as (select bits, split, sum(partners)::bigint as partners, min(hamming_distance) as nearest_distance from s group by 1, 2)
        select image_id, split, partners, nearest_distance from dochash join t using (bits, split)""",
)
def _d5_images(spark, sf_dir):
    hashed = pin(dochash(spark, sf_dir))
    groups = leakage.near_duplicate_groups(hashed, hamming_threshold=4)
    return leakage.near_duplicate_images(hashed, groups)


@query(
    "d6_audit_metadata",
    f"""{_GROUPS}, c as (select split, count(*) as n from dochash group by split),
        e as (select sum(a.n * b.n)::bigint as pairs from c a join c b on a.split < b.split),
        byhash as (select bits, split, count(*) as n from dochash group by bits, split),
        compared as (select sum(a.n * b.n)::bigint as pairs from byhash a join byhash b on a.split < b.split and bit_count(xor(a.bits, b.bits)) >= 0)
        select compared.pairs as comparisons_evaluated, e.pairs as expected_cross_split_pairs,
          (select coalesce(sum(left_images * right_images), 0)::bigint from pairs) as suspected_pairs,
          compared.pairs = e.pairs as audit_complete, 4::int as hamming_threshold from e, compared""",
)
def _d6(spark, sf_dir):
    hashed = pin(dochash(spark, sf_dir))
    rounds = []
    groups = leakage.near_duplicate_groups(hashed, hamming_threshold=4, settled=rounds)
    return leakage.audit_metadata(hashed, groups, 4, leakage.decided_hashes(rounds))


@query(
    "d7_leaking_values",
    with_views(
        "manifest",
        """, v as (select 'digest' as "column", digest as value, split from manifest
                  union all select 'image_id', image_id::varchar, split from manifest)
           select "column", value, array_to_string(list_sort(list_distinct(list(split))), ',') as splits from v
           group by 1, 2 having count(distinct split) > 1""",
    ),
)
def _d7(spark, sf_dir):
    m = manifest(spark, sf_dir)
    parts = [m.where(F.col("split") == s) for s in ("train", "validation", "test")]
    return leakage.leaking_values(*parts, ["image_id", "digest"])


# --- bins ---------------------------------------------------------------------


def edges_sql(source: str, value: str, bins: int, name: str) -> str:
    probs = ", ".join(repr(i / bins) for i in range(bins + 1))
    return f"{name} as (select list_distinct(quantile_cont({value}, [{probs}])) as e from {source})"


def bin_sql(value: str, edges: str) -> str:
    return f"greatest(len(list_filter((select e from {edges}), lambda t: t < {value})) - 1, 0)"


@query(
    "b1_quantile_bins",
    with_views(
        "manifest",
        f""", {edges_sql('manifest', 'coverage', 10, 'edges')}
            select image_id, {bin_sql('coverage', 'edges')}::int as bin from manifest""",
    ),
)
def _b1(spark, sf_dir):
    return binning.quantile_bins(manifest(spark, sf_dir), "coverage", 10).select("image_id", "bin")


RANKED_SQL = """, ranked as (select *, row_number() over (order by coverage, image_id) as r, count(*) over () as n from manifest),
  strata as (select * exclude (r, n), case when n = 1 then 0 else
     greatest(((r - 1) * least(10, greatest(2, n // 20)) + n - 2) // (n - 1) - 1, 0) end::int as stratum from ranked)"""


@query("b2_rank_first_bins", with_views("manifest", f"{RANKED_SQL} select image_id, stratum from strata"))
def _b2(spark, sf_dir):
    return binning.rank_first_bins(manifest(spark, sf_dir), "coverage").select("image_id", "stratum")


COVERAGE_CASE = """case when coverage >= -1e-9 and coverage <= 0 then 'empty' when coverage <= 0.1::double then '0-10%'
  when coverage <= 0.25::double then '10-25%' when coverage <= 0.5::double then '25-50%'
  when coverage <= 0.75::double then '50-75%' when coverage <= 1 then '75-100%' end"""


@query("b3_coverage_slices", with_views("manifest", f"select image_id, {COVERAGE_CASE} as coverage_slice from manifest"))
def _b3(spark, sf_dir):
    return manifest(spark, sf_dir).select("image_id", binning.coverage_label(F.col("coverage")).alias("coverage_slice"))


@query(
    "b4_size_tertiles",
    with_views(
        "manifest",
        f""", a as (select *, (width * height)::double as area from manifest), {edges_sql('a', 'area', 3, 'edges')}
            select image_id, ['small', 'medium', 'large'][{bin_sql('area', 'edges')} + 1] as image_size_slice from a""",
    ),
)
def _b4(spark, sf_dir):
    sized = manifest(spark, sf_dir).withColumn("area", (F.col("width") * F.col("height")).cast("double"))
    return binning.tertile_labels(sized, "area", binning.SIZE_LABELS, "image_size_slice").select(
        "image_id", "image_size_slice"
    )


# --- splits and samples -------------------------------------------------------


def _take_sql(source: str, count: str, tag: str) -> str:
    """Largest-remainder allocation over decile strata; rows of ``{tag}_taken`` are the chosen ones."""
    return f"""{edges_sql(source, 'coverage', 10, f'{tag}_edges')},
      {tag}_binned as (select *, {bin_sql('coverage', f'{tag}_edges')} as bin from {source}),
      {tag}_sizes as (select bin, count(*) as c, {count} * count(*)::double / (select count(*) from {source}) as exact
                      from {tag}_binned group by bin),
      {tag}_alloc as (select bin, floor(exact)::bigint + (case when
          row_number() over (order by floor(exact) - exact, bin) <= {count} - (select sum(floor(exact)) from {tag}_sizes)
          then 1 else 0 end) as quota from {tag}_sizes),
      {tag}_ranked as (select b.*, quota, row_number() over (partition by b.bin order by {h5('image_id')}, image_id) as r
                       from {tag}_binned b join {tag}_alloc using (bin)),
      {tag}_taken as (select image_id from {tag}_ranked where r <= quota)"""


@query(
    "d8_exact_split",
    with_views(
        "manifest",
        f""", total as (select count(*) as n from manifest), {_take_sql('manifest', '(select n * 15 // 100 from total)', 't')},
            rest as (select * from manifest where image_id not in (select image_id from t_taken)),
            {_take_sql('rest', '(select n * 15 // 100 from total)', 'v')}
            select image_id, case when image_id in (select image_id from t_taken) then 'test'
              when image_id in (select image_id from v_taken) then 'validation' else 'train' end as split from manifest""",
    ),
)
def _d8(spark, sf_dir):
    m = manifest(spark, sf_dir).select("image_id", "coverage")
    n = m.count()
    part = n * 15 // 100
    return splitting.assign_exact_split(
        m, train_count=n - 2 * part, validation_count=part, test_count=part, seed=SEED, fraction="coverage"
    ).select("image_id", "split")


@query(
    "d9_group_split",
    with_views(
        "manifest",
        f"""{RANKED_SQL}, groups as (select digest, arg_min(stratum, image_id) as stratum from strata group by digest),
            g as (select *, row_number() over (partition by stratum order by {h5('digest')}, digest) as r,
                  count(*) over (partition by stratum) as n from groups),
            s as (select *, case when n >= 3 then least(greatest(round_even(n * 0.7::double, 0), 1), n - 2)
                  else round_even(n * 0.7::double, 0) end as nt from g),
            w as (select *, case when n >= 3 then least(greatest(round_even(n * 0.15::double, 0), 1), n - nt - 1)
                  else round_even(n * 0.15::double, 0) end as nv from s)
            select image_id, case when r <= nt then 'train' when r <= nt + nv then 'val' else 'test' end as split
            from manifest join w using (digest)""",
    ),
)
def _d9(spark, sf_dir):
    m = manifest(spark, sf_dir).select("image_id", "coverage", "digest")
    return splitting.group_split(
        m,
        train_fraction=0.7,
        validation_fraction=0.15,
        test_fraction=0.15,
        seed=SEED,
        group="digest",
        fraction="coverage",
    ).select("image_id", "split")


_SUBSET = 150


@query(
    "d10_fixed_stratified_subset",
    with_views(
        "manifest",
        f""", {edges_sql('manifest', 'coverage', 7, 'edges')},
            b as (select *, {bin_sql('coverage', 'edges')} as bin from manifest),
            q as (select bin, least(count(*), greatest(1, round_even({_SUBSET} * count(*)::double
                  / (select count(*) from manifest), 0))) as quota from b group by bin),
            r as (select image_id, bin, row_number() over (partition by bin order by {h5('image_id')}, image_id) as r from b),
            e as (select image_id, (r > quota)::int as extra from r join q using (bin))
            select image_id from e order by extra, {h5('image_id')}, image_id limit {_SUBSET}""",
    ),
)
def _d10(spark, sf_dir):
    m = manifest(spark, sf_dir).select("image_id", "coverage")
    return splitting.fixed_stratified_subset(m, size=_SUBSET, seed=SEED, fraction="coverage").select("image_id")


@query(
    "d11_random_rows",
    with_views("manifest", f"select image_id from manifest order by {h5('image_id')}, image_id limit 64"),
)
def _d11(spark, sf_dir):
    return splitting.sample_rows(manifest(spark, sf_dir).select("image_id"), 64, SEED)


@query(
    "d12_pixel_sample",
    with_views(
        "grid",
        f"""select image_id, y, x, pred, target from grid
            qualify row_number() over (partition by image_id order by {h5("image_id || ':' || y || ':' || x")}, y, x) <= 200""",
    ),
)
def _d12(spark, sf_dir):
    return splitting.sample_pixels(view(spark, sf_dir, "grid"), 200, SEED).select(
        "image_id", "y", "x", "pred", "target"
    )


_MODES = ["none", "point1", "points", "box", "box_points"]
_WEIGHTS = splitting.reweighted(0.3, [0.15, 0.2, 0.2, 0.15])


def _mode_case() -> str:
    parts, upto = [], 0.0
    for mode, weight in list(zip(_MODES, _WEIGHTS))[:-1]:
        upto += weight / sum(_WEIGHTS)
        parts.append(f"when u < {upto!r}::double then '{mode}'")
    return f"case {' '.join(parts)} else '{_MODES[-1]}' end"


@query(
    "d13_prompt_mode_draw",
    with_views(
        "manifest",
        f"select image_id, {_mode_case()} as prompt_mode from (select image_id, {h5('image_id')} / 4294967296.0::double as u from manifest)",
    ),
)
def _d13(spark, sf_dir):
    return splitting.draw_prompt_modes(manifest(spark, sf_dir), _MODES, _WEIGHTS, SEED).select("image_id", "prompt_mode")


def draw_sql(name: str) -> str:
    return f"('0x' || substr(sha256(draw_seed || ':{name}'), 9, 8))::bigint / 4294967296.0::double"


@query(
    "d14_augmentation_plan",
    with_views(
        "manifest",
        f""", p as (select image_id, row_number() over (order by image_id) as r, count(*) over () as n from manifest),
            e as (select image_id, epoch::int as epoch, {SEED} + epoch * n + r - 1 as draw_seed from p, range(3) t(epoch))
            select image_id, epoch, draw_seed::bigint as draw_seed, {draw_sql('flip_x')} < 0.5 as flip_x,
              {draw_sql('flip_y')} < 0.5 as flip_y, (floor({draw_sql('rotation')} * 4) * 90)::int as rotation,
              round(0.9::double + 0.2::double * {draw_sql('brightness')}, 6) as brightness,
              round(0.9::double + 0.2::double * {draw_sql('contrast')}, 6) as contrast from e""",
    ),
)
def _d14(spark, sf_dir):
    return r6(splitting.augmentation_plan(manifest(spark, sf_dir), epochs=3, seed=SEED, profile="moderate"))
