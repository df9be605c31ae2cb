"""Step manifests and canonical hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the JSON of the named columns in name order; leave measurements of the run out of them."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def fingerprint(*parts: str) -> str:
    """16 hex digits over the parts a step depends on."""
    import hashlib

    return hashlib.sha256("\0".join(parts).encode()).hexdigest()[:16]


MANIFEST = "step string, fingerprint string, cursor string, files array<string>, at bigint"


def is_fresh(manifest: DataFrame, step: str, mark: str) -> bool:
    """Whether the step's latest entry carries this fingerprint, so that its outputs still hold."""
    latest = manifest.filter(F.col("step") == step).orderBy(F.desc("at")).select("fingerprint").limit(1).collect()
    return bool(latest) and latest[0][0] == mark


def commit_step(path: str, manifest_row: DataFrame) -> None:
    """Append one entry; readers take the latest per step, so a lost write only repeats the step."""
    manifest_row.write.mode("append").json(path)
