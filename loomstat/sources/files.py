"""Readers: shards, JSON lines, CSV, documents, ids, prompts and settings."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import MutableMapping, Sequence
from functools import lru_cache
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

CORRUPT = "_corrupt_record"


def read_shards(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """All ``split-*.parquet`` of a folder; an error if there are none."""
    try:
        return spark.read.option("pathGlobFilter", f"{split}-*.parquet").parquet(folder)
    except AnalysisException as error:
        raise FileNotFoundError(f"no shards of {split!r} in {folder}") from error


def read_jsonl(spark: SparkSession, path: str, schema: StructType, strict: bool = True) -> DataFrame:
    """JSON lines with a given schema. Strict fails on a bad line; otherwise bad or torn lines are left out."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wide = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    rows = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def last_by_line(rows: DataFrame, key: Sequence[str], line: str = "line_no") -> DataFrame:
    """The row with the highest line number of each key."""
    order = Window.partitionBy(*key).orderBy(F.desc(line))
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).options(header=True, multiLine=True, escape='"', nullValue="").csv(path)


def read_document(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def wanted(df: DataFrame, ids: DataFrame, key: str = "run_id") -> tuple[DataFrame, DataFrame]:
    """The rows with a wanted id, one per id, and the ids that are missing."""
    ids = ids.select(key).distinct()
    return df.join(ids, key, "left_semi").dropDuplicates([key]), ids.join(df, key, "left_anti")


def in_order(df: DataFrame, ids: Sequence[int], key: str = "run_id") -> DataFrame:
    """The rows in the order of a given id list."""
    spark = df.sparkSession
    places = spark.createDataFrame([(int(x), k) for k, x in enumerate(ids)], f"{key} long, _place int")
    return df.join(places, key).orderBy("_place").drop("_place")


def parse_ids(text: str, allowed: Sequence[int] | None = None, limit: int | None = None, calibrate: int | None = None) -> list[int]:
    """Ids from a comma list or a file of lines; ids outside ``allowed`` are refused, its order is kept.

    ``limit`` keeps the first ids, ``calibrate`` the first of those for a trial run.
    """
    path = Path(text)
    parts = path.read_text().split() if path.is_file() else text.split(",")
    ids = [int(p) for p in parts if p.strip()]
    if allowed is not None:
        outside = sorted(set(ids) - set(allowed))
        if outside:
            raise ValueError(f"not in the subset: {outside}")
        ids = [x for x in allowed if x in set(ids)]
    return ids[:limit][:calibrate]


def read_cache(spark: SparkSession, folder: str, key: str = "key") -> DataFrame:
    """``key, score, reasoning`` of a cache of Parquet or JSON rows; corrupt entries are left out, so that they are misses.

    An entry is corrupt if its row can't be read, or its score isn't a number from 0 to 100. Of a repeated key one entry counts.
    """
    wide = StructType([StructField(key, StringType()), StructField("score", DoubleType()), StructField("reasoning", StringType()), StructField(CORRUPT, StringType())])
    try:
        rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").schema(wide).option("columnNameOfCorruptRecord", CORRUPT).json(folder)
        rows = rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
        parquet = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").schema(StructType(wide.fields[:3])).parquet(folder)
    except AnalysisException as error:
        raise FileNotFoundError(f"no cache in {folder}") from error
    good = F.col(key).isNotNull() & F.col("score").between(0, 100)
    return rows.unionByName(parquet).where(good).dropDuplicates([key])


def read_manifest(path: str) -> dict:
    return json.loads(Path(path).read_text())


def manifest_ids(spark: SparkSession, path: str) -> DataFrame:
    """``pos, run_id`` of a manifest's ids."""
    rows = spark.read.schema("run_ids array<long>").option("multiLine", True).json(path)
    return rows.select(F.posexplode("run_ids").alias("pos", "run_id"))


@lru_cache
def load_prompt(folder: str, version: str, name: str) -> tuple[str, str]:
    """A prompt's text and digest; read once, so that it can't change during a run."""
    text = (Path(folder) / version / f"{name}.md").read_text()
    return text, hashlib.sha256(text.encode()).hexdigest()


def available_prompts(folder: str, version: str | None = None) -> list[str]:
    """The versions, or the prompts of one version."""
    root = Path(folder) if version is None else Path(folder) / version
    return sorted(p.name if version is None else p.stem for p in root.iterdir() if (p.is_dir() if version is None else p.suffix == ".md"))


_ENV_LINE = re.compile(r"""^[ \t]*(?:export[ \t]+)?(?P<name>[^\s#=][^=\n]*?)[ \t]*=[ \t]*(?P<quote>["']?)(?P<value>[^\n]*?)(?P=quote)[ \t\r]*$""", re.MULTILINE)


def load_env(path: str, override: bool = False, env: MutableMapping[str, str] | None = None) -> dict[str, str]:
    """``NAME=value`` lines into the environment; values that are there already win unless ``override``. Gives what was set.

    A file that isn't there sets nothing; of a repeated name the last value holds with ``override``, else the first.
    """
    target = os.environ if env is None else env
    text = Path(path).read_text() if Path(path).is_file() else ""
    pairs = [(m["name"], m["value"]) for m in _ENV_LINE.finditer(text)]
    told = dict(pairs if override else reversed(pairs))
    fresh = {name: value for name, value in told.items() if override or name not in target}
    target.update(fresh)
    return fresh
