"""Partitioned tables, manifests, experiment records and published snapshots."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import issuer_root
from tidemark.operators.quality import quarantine


def write_partitioned(df: DataFrame, root: str, by: Sequence[str] = ("year",), cluster: Sequence[str] = ("ticker",)) -> None:
    """Replace only the partitions present in `df`.

    Rows are spread over (partition, cluster) before writing, so one large year is written by many
    tasks and each file holds a run of entities.
    """
    keys = [c for c in (*by, *cluster) if c in df.columns]
    (
        df.repartition(*keys)
        .sortWithinPartitions(*keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*by)
        .parquet(root)
    )


def read_partitions(spark: SparkSession, *roots: str) -> DataFrame:
    """The first existing root (such as adjusted, else raw); columns may differ between partitions."""
    missing = []
    for root in roots:
        try:
            return spark.read.option("mergeSchema", True).parquet(root)
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            missing.append(root)
    raise FileNotFoundError(f"no partitions under {missing}")


def union_drifting(*frames: DataFrame) -> DataFrame:
    """Union by name; columns a frame lacks become null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


DIGEST_BLOCK = 4 * 1024 * 1024


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """URI, digest and size of each landed file, of any size.

    A task reads its files block by block through their file system into a running digest, so no
    row ever holds a file; files are dealt to tasks by size. Spark's scan passes over empty files,
    so they are added from its listing, with the digest of nothing. Works for the file systems that
    pyarrow knows (local and mounted folders, hdfs, s3, gs, abfs).
    """
    files = spark.read.format("binaryFile").load(path)
    # The two listings differ in the slashes of a local file's URI.
    uri = F.regexp_replace("_metadata.file_path", "^file:/(?!/)", "file:///")
    filled = files.select(uri.alias("source"), F.col("length").alias("bytes"))
    listing = spark.createDataFrame([(uri,) for uri in files.inputFiles()], "source string")
    empty = listing.join(filled, "source", "left_anti").withColumn("bytes", F.lit(0).cast("bigint"))

    def digests(batches):
        import hashlib

        from pyarrow import fs

        for batch in batches:
            found = []
            for uri in batch["source"]:
                digest = hashlib.sha256()
                system, name = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
                with system.open_input_stream(name, compression=None) as stream:
                    while block := stream.read(DIGEST_BLOCK):
                        digest.update(block)
                found.append(digest.hexdigest())
            yield batch.assign(sha256=found)[["source", "sha256", "bytes"]]

    return filled.unionByName(empty).mapInPandas(digests, "source string, sha256 string, bytes bigint")


def quarantine_prices(prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid prices, and a side table of the invalid ones."""
    from tidemark.functions.scalars import finite

    bad = ~finite(F.col("close")) | (F.col("close") <= 0)
    return quarantine(prices, bad, "invalid_price", ["ticker", "trade_date"])


def quarantine_issuers(prices: DataFrame, excluded_roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prices of issuers with known actions, and a side table of those without.

    `excluded_roots` has one column issuer_root.
    """
    tagged = prices.withColumn("issuer_root", issuer_root(F.col("ticker")))
    good = tagged.join(excluded_roots, "issuer_root", "left_anti").drop("issuer_root")
    side = tagged.join(excluded_roots, "issuer_root", "left_semi").drop("issuer_root")
    return good, side.withColumn("quarantine_reason", F.lit("missing_action_coverage"))


EXPERIMENT = "experiment_id string, recorded_at timestamp, features array<string>, parameters string, training_window string, validation_folds string, metrics string, notes string"


def append_experiment(
    spark: SparkSession,
    root: str,
    features: Sequence[str],
    parameters: Mapping,
    training_window: Mapping,
    validation_folds: Sequence,
    metrics: Mapping,
    notes: str | None = None,
    run_id: str | None = None,
) -> str:
    """Add one record; records of other runs are never touched.

    The run is a partition of the log. A run repeated under its own `run_id` replaces its own
    record, so a retry leaves one record; without `run_id` each call is a run.
    """
    identifier = run_id or uuid.uuid4().hex
    row = (
        identifier, datetime.now(timezone.utc), list(features), json.dumps(dict(parameters), default=str), json.dumps(dict(training_window), default=str),
        json.dumps(list(validation_folds), default=str), json.dumps(dict(metrics), default=str), notes,
    )
    record = spark.createDataFrame([row], EXPERIMENT).coalesce(1)
    record.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment_id").parquet(root)
    return identifier


def read_experiments(spark: SparkSession, root: str) -> DataFrame:
    """All records; run ids stay text, also those that look like numbers."""
    return spark.read.schema(EXPERIMENT).parquet(root)


def publish_snapshot(df: DataFrame, root: str) -> None:
    """Replace the rows of the snapshot dates in `df` and keep all other dates."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of").parquet(root)


def publish_run(df: DataFrame, root: str, log: str, run_id: str, **record) -> str:
    """Publish the snapshot dates of a run, then record the run.

    The record comes last, so a run in the log has been published whole. A run that failed in
    between is simply repeated: both steps replace what the first attempt left.
    """
    publish_snapshot(df, root)
    return append_experiment(df.sparkSession, log, run_id=run_id, **record)
