"""Writers. Large results go through Spark's committers, single documents are written whole and renamed."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Mapping
from datetime import UTC, datetime
from pathlib import Path
from typing import Any
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_document(path: str, value: Any) -> None:
    """One JSON document; readers see the old or the new one, never a part.

    What can't be written as JSON is refused before anything is touched.
    """
    _put(Path(path), json.dumps(value, indent=2, default=str))


def write_text(path: str, parts: Iterable[str]) -> None:
    """One text file out of parts, as ``write_document`` writes."""
    _put(Path(path), "".join(parts))


def _put(target: Path, text: str) -> None:
    os.makedirs(target.parent, exist_ok=True)
    beside = target.with_name(f".{uuid4().hex}.{target.name}")
    beside.write_text(text)
    beside.replace(target)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays of plain values become ``;``-joined text, other nested values JSON."""

    def flat(name: str, kind: str) -> Any:
        column = F.col(f"`{name}`")
        if kind.startswith("array<") and not re.match(r"array<(array|struct|map|binary)", kind):
            return F.array_join(column.cast("array<string>"), ";").alias(name)
        return F.to_json(column).alias(name) if kind.startswith(("array", "struct", "map")) else column

    told = df.select(*(flat(c, t) for c, t in df.dtypes))
    told.write.mode("overwrite").options(header=True, escape='"', multiLine=True).csv(path)


def append_cache(rows: DataFrame, path: str, key: str = "key") -> None:
    """New cache rows, in folders by the first two characters of the key."""
    rows.withColumn("shard", F.left(F.col(key), F.lit(2))).write.mode("append").partitionBy("shard").parquet(path)


def rewrite(df: DataFrame, path: str) -> None:
    """Replaces a folder by a frame that may read it: written beside it, then swapped."""
    fresh, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(fresh)
    spark = df.sparkSession
    files = spark._jvm.org.apache.hadoop.fs
    to = lambda p: files.Path(p)
    fs = to(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(to(old), True)
    if fs.exists(to(path)):
        fs.rename(to(path), to(old))
    if not fs.rename(to(fresh), to(path)):
        raise OSError(f"could not move {fresh} to {path}")
    fs.delete(to(old), True)


class RunFolder:
    """``root/experiment/stage`` with the outputs of a stage and its manifest."""

    def __init__(self, root: str, experiment: str, stage: str) -> None:
        self.path = Path(root) / experiment / stage
        self.started = datetime.now(UTC).isoformat()

    def file(self, name: str) -> str:
        return str(self.path / name)

    def write_manifest(self, **fields: Any) -> dict[str, Any]:
        told = {"started": self.started, "finished": datetime.now(UTC).isoformat(), **fields}
        write_document(self.file("run.json"), told)
        return told

    def write_tables(self, tables: Mapping[str, DataFrame], may_be_empty: Iterable[str] = ()) -> list[str]:
        """A CSV folder per table; those in ``may_be_empty`` are left out where they have no rows. Gives the names written."""
        done = []
        for name, df in tables.items():
            if name in may_be_empty and df.isEmpty():
                continue
            write_csv(df, self.file(name))
            done.append(name)
        return done
