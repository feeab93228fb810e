"""Dataset preparation: pair, validate, split, audit, register."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from rasterledger.operators import leakage, pairing, splitting, validation
from rasterledger.session import pin
from rasterledger.sources.sinks import registry_payload


@dataclass
class PreparedDataset:
    """Tables of one preparation run."""

    manifest: DataFrame
    errors: DataFrame
    suspects: DataFrame
    audit: DataFrame
    payload: DataFrame


def prepare_dataset(
    images: DataFrame,
    masks: DataFrame,
    *,
    validation_share: float,
    test_share: float,
    seed: int,
    fraction: str = "water_fraction",
    digest: str = "image_sha256",
    hamming_threshold: int = 4,
    history: DataFrame | None = None,
    split_method: str = "stratified",
) -> PreparedDataset:
    """Run the preparation on decoded image and mask rows.

    ``images`` has image_id, width, height, the digest and image_ahash; ``masks``
    has image_id, mask_width, mask_height and the foreground fraction. Splits are
    recovered from ``history`` or drawn with exact counts by ``split_method``.
    """
    pairs = pairing.strict_pairs(images, masks)
    checked = pin(validation.with_status(pairs, validation.pair_rules()))
    valid, errors = validation.valid_and_errors(checked)
    if history is not None:
        split = pairing.recover_split(valid, history)
    else:
        rows = valid.count()
        tested, validated = int(rows * test_share), int(rows * validation_share)
        split = splitting.assign_exact_split(
            valid,
            train_count=rows - tested - validated,
            validation_count=validated,
            test_count=tested,
            seed=seed,
            fraction=fraction,
            method=split_method,
        )
    manifest = pin(split)
    rounds = []
    suspects = pin(leakage.near_duplicate_groups(manifest, hamming_threshold=hamming_threshold, settled=rounds))
    registry = manifest.select("image_id", "split", "width", "height", fraction, digest)
    return PreparedDataset(
        manifest=manifest,
        errors=errors.select("image_id", "error_type", "error_message"),
        suspects=suspects,
        audit=leakage.audit_metadata(manifest, suspects, hamming_threshold, leakage.decided_hashes(rounds)),
        payload=registry_payload(registry, {"pairing_key": "case-insensitive filename stem"}),
    )


def exact_leaks(dataset: PreparedDataset, digest: str = "image_sha256") -> DataFrame:
    """Digests of the prepared manifest that cross a split boundary."""
    return leakage.crossing_digests(dataset.manifest, digest).orderBy(F.desc("rows"), digest)
