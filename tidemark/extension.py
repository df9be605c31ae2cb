"""Extension surface: repositories as data, detectors as functions from tables to tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.paths import PathRules, shell_glob
from .operators.ci import Reach, ScoreRules


@dataclass(frozen=True)
class PathClass:
    """A class of paths; rank 1 reaches widest."""

    name: str
    rank: int
    kind: str


@dataclass(frozen=True)
class Repository:
    """What is known of one repository, as data. Checked when it is made; nothing is subclassed."""

    name: str
    classes: tuple[PathClass, ...]
    rules: tuple[tuple[str, str], ...]
    fallback: str
    markers: tuple[tuple[str, ...], ...] = ()
    buckets: PathRules = field(default_factory=PathRules)
    reach: Reach | None = None
    scores: ScoreRules = field(default_factory=ScoreRules)
    components: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        ranks = sorted(item.rank for item in self.classes)
        if ranks != list(range(1, len(ranks) + 1)):
            raise ValueError(f"{self.name}: ranks must run from 1 to {len(ranks)}, not {ranks}")
        known = {item.name: item for item in self.classes}
        unknown = sorted({target for _pattern, target in self.rules} - set(known))
        if unknown:
            raise ValueError(f"{self.name}: rules name undeclared classes {unknown}")
        if self.fallback not in known or known[self.fallback].kind != "other":
            raise ValueError(f"{self.name}: the fallback must be a declared class of kind 'other'")

    def class_rules(self) -> list[tuple[str, str]]:
        return [(shell_glob(pattern), target) for pattern, target in self.rules]

    def class_table(self, spark: SparkSession) -> DataFrame:
        """One row per class: a handful, so it may always be broadcast."""
        rows = [(item.name, item.rank, item.kind) for item in self.classes]
        return spark.createDataFrame(rows, "path_class string, rank int, kind string")

    def marker_table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.name, number, marker) for number, group in enumerate(self.markers) for marker in group]
        return spark.createDataFrame(rows, "adapter string, grp int, marker string")


Detector = Callable[..., DataFrame]
DETECTORS: dict[str, Detector] = {}


def register_detector(name: str, detector: Detector) -> None:
    """Detectors return (id, ..) rows; the name is taken once."""
    if name in DETECTORS:
        raise ValueError(f"detector {name!r} is registered already")
    DETECTORS[name] = detector


def run_detectors(inputs: Mapping[str, DataFrame], names: tuple[str, ...] | None = None) -> DataFrame:
    """All findings of the chosen detectors, the first of each id in registration order."""
    rows = None
    for order, name in enumerate(names or tuple(DETECTORS)):
        found = DETECTORS[name](**inputs).withColumn("_order", F.lit(order))
        rows = found if rows is None else rows.unionByName(found, allowMissingColumns=True)
    columns = [name for name in rows.columns if name != "_order"]
    first = rows.groupBy("id").agg(F.min_by(F.struct(*columns), "_order").alias("_r"))
    return first.select("_r.*")


def reference_table(spark: SparkSession, groups: Mapping[str, list[str]]) -> DataFrame:
    """(grp, repo, prefix) of a map of group to ``repo/prefix`` entries, as related groups are configured."""
    rows = [
        (group, *entry.strip("/").split("/", 1)) for group, entries in sorted(groups.items()) for entry in entries
        if "/" in entry.strip("/")
    ]
    return spark.createDataFrame(sorted(set(rows)), "grp string, repo string, prefix string")
