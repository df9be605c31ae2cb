"""Readers and writers of the commit dataset: records, feature table, incidents, card."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE = """struct<status:string,old_path:string,new_path:string,old_mode:string,new_mode:string,old_blob:string,new_blob:string,
 similarity:int,additions:int,deletions:int,binary:boolean,file_class:string,hunks:array<array<int>>,patch:string,
 patch_truncated:boolean,scopes:array<string>,line_kinds:map<string,array<int>>>"""
RECORD = f"""commit struct<sha:string,tree:string,parents:array<string>,is_merge:boolean,is_root:boolean,authored_at:string,
 committed_at:string,committed_epoch:bigint,author_id:string,author_is_bot:boolean,base:string,base_strategy:string>,
 message struct<subject:string,body:string,body_truncated:boolean,body_length:int,pr_number:bigint,subject_tags:array<string>,
 sections:map<string,string>,trailer_counts:map<string,int>,revert:struct<is_revert:boolean,depth:int,is_nested:boolean,
 reverts_sha:string,reverts_pr:bigint>,pulled_commit_lines:int>, files array<{FILE}>,
 submodules array<struct<path:string,name:string,url:string,old_sha:string,new_sha:string>>,
 areas struct<components:array<struct<id:string,path_count:int>>,features:array<struct<id:string,path_count:int>>,
 entities:array<struct<id:string,kind:string,name:string,path_count:int>>,unmapped_paths:array<string>>,
 features map<string,double>, warnings array<string>, idx bigint"""
INCIDENT = """incident_id string, revert_sha string, revert_subject string, revert_authored_date string, revert_committed_date string,
 revert_paths array<string>, pr_number bigint, is_nested_revert boolean, link_status string, reverted_sha string,
 reverted_subject string, reverted_authored_date string, reverted_committed_date string, reverted_paths array<string>,
 additional_reverted_shas array<string>, lead_time_days bigint, detector_category string, notes string"""
CHANGE_SET = """change_id string, commits array<struct<sha:string,files:array<struct<path:string,old_path:string,change_type:string,
 is_binary:boolean,hunks:array<struct<old_start:int,old_count:int,new_start:int,new_count:int,
 lines:array<struct<kind:string,content:string,old_lineno:int,new_lineno:int>>>>>>>>"""
PARTS_GLOB = "part-*.json*"


def _schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(" ".join(text.split()))


def read_json_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of ``part-*`` files, packed or plain; unfinished files are not read.

    Rows carry their position in a column; file names and read order mean nothing.
    """
    return spark.read.schema(_schema(schema)).option("pathGlobFilter", PARTS_GLOB).json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return read_json_parts(spark, path, RECORD)


def write_json_parts(df: DataFrame, path: str, order: str = "idx", rows: int = 1000, compress: bool = True) -> None:
    """Ordered parts of at most ``rows`` lines with sorted keys; old parts go with the overwrite."""
    names = sorted(df.columns)
    (
        df.select(*names).repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite")
        .option("maxRecordsPerFile", rows).option("compression", "gzip" if compress else "none").json(path)
    )


def write_features(df: DataFrame, path: str) -> None:
    """The feature table as zstd Parquet; the commit protocol publishes it whole or not at all."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"no feature table at {path}; build the dataset first") from error


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    """Incidents; unknown keys are ignored and missing lists are empty."""
    rows = spark.read.schema(_schema(INCIDENT)).json(path)
    lists = ("revert_paths", "reverted_paths", "additional_reverted_shas")
    return rows.withColumns({name: F.coalesce(name, F.array().cast("array<string>")) for name in lists})


def write_incidents(df: DataFrame, path: str) -> None:
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def read_change_sets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_schema(CHANGE_SET)).json(path)


def write_change_sets(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def flatten_change_sets(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, hunks, lines) with the positions that put them back together."""
    files = df.select("change_id", F.posexplode("commits").alias("commit_no", "c")).select(
        "change_id", "commit_no", "c.sha", F.posexplode("c.files").alias("file_no", "f")
    ).select("change_id", "commit_no", "sha", "file_no", "f.*")
    hunks = files.select("change_id", "commit_no", "file_no", F.posexplode("hunks").alias("hunk_no", "h")).select(
        "change_id", "commit_no", "file_no", "hunk_no", "h.*"
    )
    lines = hunks.select("change_id", "commit_no", "file_no", "hunk_no", F.posexplode("lines").alias("line_no", "l")).select(
        "change_id", "commit_no", "file_no", "hunk_no", "line_no", "l.*"
    )
    return files.drop("hunks"), hunks.drop("lines"), lines


def read_exclusions(lines: DataFrame, column: str = "value") -> DataFrame:
    """Exclusion entries without comments, in lower case, blank ones dropped."""
    entry = F.lower(F.trim(F.split(column, "#")[0]))
    return lines.select(entry.alias("prefix")).filter("prefix <> ''")


def _as_map(rows: DataFrame, key: str, value: str):
    """A few (key, value) rows as one map."""
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))).scalar()


def dataset_card(
    facts: DataFrame, files: DataFrame, splits: DataFrame | None = None, rates: DataFrame | None = None, kinds: DataFrame | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """One summary row: commits, splits, label rates, change types, paths and columns.

    ``splits(sha, split)``, ``rates(split, label, rate)``, ``kinds(sha, change_type)``. Each part is counted where
    its rows are; only the few counts meet in the row.
    """
    paths = files.agg(F.count(F.lit(1))).scalar()
    card = facts.agg(
        F.count(F.lit(1)).alias("commits"), F.count_if("is_merge").alias("merges"), F.count_if("is_revert").alias("reverts"),
        F.count_distinct("author_id").alias("authors"), F.min("landed").alias("first_landed"), F.max("landed").alias("last_landed"),
    ).withColumn("file_paths", paths)
    if splits is not None:
        card = card.withColumn("splits", _as_map(splits.groupBy("split").agg(F.count(F.lit(1)).alias("n")), "split", "n"))
    if rates is not None:
        named = rates.select(F.concat_ws(":", "split", "label").alias("name"), "rate")
        card = card.withColumn("label_rates", _as_map(named, "name", "rate"))
    if kinds is not None:
        card = card.withColumn("categories", _as_map(kinds.groupBy("change_type").agg(F.count(F.lit(1)).alias("n")), "change_type", "n"))
    return card.withColumn("columns", F.array(*[F.lit(name) for name in columns or []]).cast("array<string>"))


def card_json(card: DataFrame) -> DataFrame:
    """The card as one JSON text with sorted keys."""
    return card.select(F.to_json(F.struct(*sorted(card.columns))).alias("card"))


CORPUS_TABLES = ("manifest", "incidents", "controls", "candidates")


def write_corpus(tables: dict[str, DataFrame], path: str, version: str) -> None:
    """The four tables of a backtest corpus under one versioned path; the manifest comes last."""
    for name in sorted(set(CORPUS_TABLES) - {"manifest"}):
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}")
    tables["manifest"].withColumn("corpus_version", F.lit(version)).write.mode("overwrite").parquet(f"{path}/manifest")


def read_corpus(spark: SparkSession, path: str, version: str) -> dict[str, DataFrame]:
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in CORPUS_TABLES}
    found = [row[0] for row in tables["manifest"].select("corpus_version").distinct().limit(2).collect()]
    if found != [version]:
        raise ValueError(f"corpus at {path} has version {found}, not {version}")
    return tables
