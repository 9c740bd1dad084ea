"""Linearising nested samples (growing conversations or independent calls) into one transcript.

The long form of a sample is one row per message: ``run_id, si`` (sample), ``tier`` (0 input, 1
completion), ``i`` (place in its list), ``node_id, role, content, call, arguments``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def explode_samples(runs: DataFrame) -> DataFrame:
    """The long form of ``run_id, samples: array<struct<input: array<msg>, output: array<array<msg>>>>``.

    Of the outputs the first choice counts. ``msg`` has role, content, function_call and metadata.node_id.
    """
    sample = runs.select("run_id", F.posexplode("samples").alias("si", "s"))
    both = sample.select(
        "run_id", "si",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("tier"), F.col("s.input").alias("list")),
                F.struct(F.lit(1).alias("tier"), F.get("s.output", F.lit(0)).alias("list")),
            )
        ).alias("part"),
    )
    told = both.select("run_id", "si", "part.tier", F.posexplode("part.list").alias("i", "m"))
    return told.select(
        "run_id", "si", "tier", "i", F.col("m.metadata.node_id").alias("node_id"), F.col("m.role").alias("role"),
        F.col("m.content").alias("content"), F.col("m.function_call.name").alias("call"), F.col("m.function_call.arguments").alias("arguments"),
    )


def flatten_dag(rows: DataFrame) -> DataFrame:
    """Input nodes in order, each once, with every completion behind the last input of its sample.

    A completion that comes back as a later input is shown once: each completion can
    swallow one equal input. Built from running windows only.
    """
    run = Window.partitionBy("run_id").orderBy("tier", "si", "i")
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    is_input, node = F.col("tier") == 0, F.col("node_id")
    told = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("role", "content", "call", "arguments")})
    seen = Window.partitionBy("run_id", "tier", "node_id").orderBy("si", "i")
    told = told.withColumn("dup", is_input & node.isNotNull() & (F.row_number().over(seen) > 1))
    # inputs without a node go behind what came before them
    loose = is_input & node.isNull()
    told = told.withColumn("fb", F.sum(loose.cast("int")).over(upto))
    told = told.withColumn("f", F.sum(F.when(loose, F.col("fb")).otherwise(0)).over(upto))
    reach = F.max(F.when(is_input, node) - F.col("f")).over(upto)
    told = told.withColumn("key", F.when(is_input, F.coalesce(node, F.col("f") + F.greatest(F.lit(0), F.coalesce(reach, F.lit(0))))))
    told = told.withColumn("fb_all", F.max("fb").over(Window.partitionBy("run_id")))
    own = Window.partitionBy("run_id", "si").orderBy("tier", "i").rowsBetween(Window.unboundedPreceding, 0)
    told = told.withColumn("anchor", F.coalesce(F.last("key", ignorenulls=True).over(own), F.col("fb_all")))
    told = told.withColumn("key", F.coalesce("key", "anchor"))
    # a counter per message that never falls below zero: +1 a completion, -1 an input
    told = told.withColumn("alike", F.md5(F.concat_ws("\x00", "role", "content", "call", "arguments")))
    alike = Window.partitionBy("run_id", "alike").orderBy("si", "tier", "i")
    step = F.when(F.col("tier") == 1, 1).when(F.col("dup"), 0).otherwise(-1)
    told = told.withColumn("s", F.sum(step).over(alike.rowsBetween(Window.unboundedPreceding, 0)))
    told = told.withColumn("m", F.least(F.lit(0), F.min("s").over(alike.rowsBetween(Window.unboundedPreceding, 0))))
    held = F.coalesce(F.lag(F.col("s") - F.col("m")).over(alike), F.lit(0))
    kept = told.withColumn("held", held).where((F.col("tier") == 1) | (~F.col("dup") & (F.col("held") <= 0)))
    offset = F.when(F.col("tier") == 1, F.col("i")).otherwise(0)
    order = Window.partitionBy("run_id").orderBy("key", "tier", offset, "si", "i")
    return kept.select(
        "run_id", (F.row_number().over(order) - 1).alias("pos"), "tier", "node_id", "role", "content", "call", "arguments"
    )


def _widths(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run_id", "si").agg(F.count(F.when(F.col("tier") == 0, 1)).alias("width"))


def flatten_longest(rows: DataFrame) -> DataFrame:
    """The widest input (the first of equals) and its completion."""
    best = _widths(rows).groupBy("run_id").agg(F.max(F.struct("width", -F.col("si"))).alias("w"))
    chosen = best.select("run_id", (-F.col("w.col2")).alias("si"))
    order = Window.partitionBy("run_id").orderBy("tier", "i")
    return rows.join(chosen, ["run_id", "si"], "left_semi").withColumn("pos", F.row_number().over(order) - 1)


def flatten_concat(rows: DataFrame) -> DataFrame:
    """The narrowest sample's input, then every completion, samples ordered by width."""
    widths = _widths(rows)
    first = widths.groupBy("run_id").agg(F.min(F.struct("width", "si")).alias("w")).select("run_id", F.col("w.si").alias("first"))
    told = rows.join(widths, ["run_id", "si"]).join(first, "run_id").where((F.col("tier") == 1) | (F.col("si") == F.col("first")))
    order = Window.partitionBy("run_id").orderBy("tier", "width", "si", "i")
    return told.withColumn("pos", F.row_number().over(order) - 1).drop("width", "first")
