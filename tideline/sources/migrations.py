"""Versioned tables: each version's rows lie in a folder of their own, `schema_version=<n>`, and are read as the newest.

Columns that a version lacks are null, or have the default that the migration states; a version that isn't known is
refused, since its columns could mean anything. Rows keep the version they were written with."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType


@dataclass(frozen=True)
class Versions:
    """name of the table; columns (DDL) that each version adds, from version 1 on; defaults by column."""

    name: str
    added: tuple[str, ...]
    defaults: tuple[tuple[str, object], ...] = ()

    @property
    def newest(self) -> int:
        return len(self.added)

    def schema(self, version: int) -> StructType:
        return StructType.fromDDL(", ".join(self.added[:version]))


#: The columns of the stored tables, by the version that brought them, and defaults of those that have one.
RECORDINGS = Versions(
    "recordings",
    ("id string, status string, start_time timestamp, end_time timestamp, duration_ms bigint, file_path string, fps int, width int, height int, file_size_bytes bigint, error_message string, created_at timestamp", "max_duration_seconds bigint, output_dir string, display_name string, encoder_mode string"),
    (("encoder_mode", "in_memory_pipe"),),
)
ENTRIES = Versions(
    "timeline_entries",
    ("id string, recording_id string, start_time timestamp, end_time timestamp, category string, app string, activity string, summary string", "region_id bigint, bbox_x int, bbox_y int, bbox_w int, bbox_h int, parent_region_id bigint, display_id int, reading_order int"),
)


class UnknownVersion(ValueError):
    pass


def write(rows: DataFrame, versions: Versions, folder: str, version: int | None = None) -> None:
    """Adds rows in a version's layout, by default the newest. Columns of later versions are refused, not dropped."""
    version = versions.newest if version is None else version
    if not 1 <= version <= versions.newest:
        raise UnknownVersion(f"{versions.name} has no version {version}")
    schema = versions.schema(version)
    extra = sorted(set(rows.columns) - set(schema.names))
    if extra:
        raise ValueError(f"version {version} of {versions.name} has no column {', '.join(extra)}")
    rows.to(schema).write.mode("append").parquet(f"{folder}/{versions.name}/schema_version={version}")


def _found(spark: SparkSession, versions: Versions, folder: str) -> list[int]:
    """The versions that a table's folder holds: a few."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{folder}/{versions.name}")
    return sorted(r[0] for r in names.select(F.regexp_extract("path", r"/schema_version=([^/]+)/[^/]*$", 1)).distinct().collect())


def read(spark: SparkSession, versions: Versions, folder: str) -> DataFrame:
    """All rows in the newest layout, with schema_version. Each version is read with its own schema, so that filters and
    columns reach its scan."""
    parts = []
    for found in _found(spark, versions, folder):
        if not found.isdigit() or not 1 <= int(found) <= versions.newest:
            raise UnknownVersion(f"{versions.name} holds version {found or 'none'}; known are 1 to {versions.newest}")
        v = int(found)
        rows = spark.read.schema(versions.schema(v)).parquet(f"{folder}/{versions.name}/schema_version={v}")
        old = set(versions.schema(v).names)
        given = {c: F.lit(value).cast(versions.schema(versions.newest)[c].dataType) for c, value in versions.defaults if c not in old}
        parts.append(rows.withColumns({**given, "schema_version": F.lit(v)}))
    out = spark.createDataFrame([], versions.schema(versions.newest).add("schema_version", IntegerType()))
    for p in parts:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
