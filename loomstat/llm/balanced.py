"""A sample per wave whose categories have given shares: the cube method.

1. Every run gets the categories it belongs to; runs with the same categories form a cell. Only
   cells (few per wave) are gathered to find the drawing probabilities: wanted counts are
   fitted to what is there (water filling between a floor and the number available, then whole
   numbers), and iterative proportional fitting spreads them over the cells.
2. Flight phases move the probabilities to 0 or 1 while every category's expected count stays
   the same. They run per block of at most ``BLOCK`` runs of a wave; of each block no more runs
   stay unresolved than there are constraints. Those merge upward into blocks again, until
   a wave is one block. How a wave is cut into blocks follows from its own runs and categories alone.
3. Landing resolves the remainder: constraints are given up one by one, largest categories first and
   the sample size last.

The report sets what was wanted against what is there, what was expected and what was drawn, and says why a
category was not met.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.functions.text import strip
from loomstat.session import checkpoint_dir

#: Runs of one wave that are balanced together.
BLOCK = 2_000
TINY = 1e-9
KEY = ("is_positive", "label", "run_source")


def canonical(text: Column) -> Column:
    """One spelling for texts that differ in case, outer blanks or what joins the words; NULL if blank."""
    plain = F.regexp_replace(F.lower(strip(text)), r"[^\p{L}\p{N}]+", "_")
    return F.nullif(plain, F.lit(""))


def latest_runs(runs: DataFrame) -> DataFrame:
    """One row per run, the latest by ``ingested_at``: ``run_id, wave, label_set, source, positive``.

    Equally late rows that differ: the greatest by wave, source and labels holds. NULL or
    blank labels count as absent and repeats once; ``positive`` is NULL without labels.
    """
    row = F.struct("ingested_at", "wave", "run_source", "labels")
    last = runs.where(F.col("run_id").isNotNull()).groupBy("run_id").agg(F.max(row).alias("r"))
    labels = F.array_sort(F.array_distinct(F.array_compact(F.transform("r.labels", canonical))))
    out = last.select("run_id", "r.wave", labels.alias("label_set"), canonical(F.col("r.run_source")).alias("source"))
    return out.withColumn(
        "positive", F.when(F.size("label_set") > 0, F.exists("label_set", lambda x: x != "normal"))
    )


def prepared_targets(targets: DataFrame) -> DataFrame:
    """The target rows with their whole-number needs and a category key that joins with runs."""
    whole = F.ceil(F.coalesce("target_pct", F.lit(0)) * F.coalesce("sample_size", F.lit(0)) / 100 - 1e-9).cast("long")
    return targets.select(
        "wave",
        "is_positive",
        "label",
        "run_source",
        "target_pct",
        "min_rows",
        "sample_size",
        whole.alias("want"),
        F.greatest(whole, F.coalesce("min_rows", F.lit(0)).cast("long")).alias("need"),
        F.concat_ws("|", F.col("is_positive").cast("string"), canonical(F.col("label")), canonical(F.col("run_source"))).alias("category"),
    )


def run_categories(runs: DataFrame, targets: DataFrame) -> DataFrame:
    """``wave, run_id, category``: every target category that a run is in."""
    label = latest_runs(runs).where("source IS NOT NULL").select(
        "wave", "run_id", "positive", "source", F.explode("label_set").alias("label")
    )
    keyed = label.select(
        "wave", "run_id", F.concat_ws("|", F.col("positive").cast("string"), "label", "source").alias("category")
    )
    return keyed.join(targets.select("wave", "category").distinct(), ["wave", "category"], "left_semi")


def whole_targets(want: np.ndarray, floor: np.ndarray, there: np.ndarray, size: int) -> np.ndarray:
    """Whole counts between ``floor`` and ``there`` that add up to ``size`` if they can, in the ratio of ``want``."""
    floor = np.minimum(floor, there).astype(float)
    there = there.astype(float)
    weight = want.astype(float)
    goal = float(min(max(size, floor.sum()), there.sum()))
    if np.maximum(floor, np.where(weight > 0, there, 0)).sum() < goal:
        weight = np.where(weight > 0, there, 0) + TINY * there  # even all of the wanted don't suffice
    low, high = 0.0, 1.0
    level = lambda x: np.clip(weight * x, floor, there)
    while level(high).sum() < goal - 1e-7 and high < 1e18:
        high *= 4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if level(mid).sum() < goal else (low, mid)
    exact = level(high)
    counts = np.floor(exact + 1e-6)
    spare = there - counts
    for k in np.lexsort((np.arange(len(counts)), -(exact - counts))):
        if counts.sum() >= round(goal):
            break
        if spare[k] >= 1:
            counts[k] += 1
    return counts


def cell_probabilities(member: np.ndarray, n: np.ndarray, counts: np.ndarray, size: float, rounds: int = 300) -> np.ndarray:
    """Drawing probability per cell, fitted so that categories have ``counts`` and all have ``size``.

    ``member`` is categories x cells, ``n`` the runs of each cell.
    """
    p = np.full(len(n), min(1.0, size / max(n.sum(), 1)))
    for _ in range(rounds):
        before = p.copy()
        for row, count in zip(member, counts, strict=True):
            total = (p * n)[row].sum()
            if total > 0:
                p[row] = np.minimum(1.0, p[row] * (count / total))
        if np.abs(p - before).max(initial=0) < 1e-10:
            break
    for _ in range(60):  # the size holds exactly
        total = (p * n).sum()
        open_ = (p < 1) & (p > 0)
        if abs(total - size) < 1e-9 or not open_.any():
            break
        share = (size - (p * n)[~open_].sum()) / max((p * n)[open_].sum(), TINY)
        p[open_] = np.clip(p[open_] * share, 0, 1)
    return p


def flight(p: np.ndarray, rules: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves ``p`` to 0 or 1 while ``rules @ p`` stays, until at most as many are open as there are rules."""
    p = p.copy()
    queue = [k for k in rng.permutation(len(p)) if TINY < p[k] < 1 - TINY]
    window: list[int] = []
    while True:
        while queue and len(window) < len(rules) + 1:
            window.append(queue.pop())
        if not window:
            return p
        part = rules[:, window]
        _, s, vt = np.linalg.svd(part, full_matrices=True)
        rank = int((s > 1e-8 * max(s.max(initial=0), 1)).sum())
        if rank >= len(window):
            return p
        u = vt[-1]
        u[np.abs(u) < 1e-10] = 0
        x = p[window]
        up, down = u > 0, u < 0
        ahead = min(((1 - x[up]) / u[up]).min(initial=np.inf), (x[down] / -u[down]).min(initial=np.inf))
        back = min((x[up] / u[up]).min(initial=np.inf), ((1 - x[down]) / -u[down]).min(initial=np.inf))
        x = x + u * ahead if rng.random() * (ahead + back) < back else x - u * back
        x[x < TINY], x[x > 1 - TINY] = 0, 1
        p[window] = x
        window = [k for k in window if 0 < p[k] < 1]


def _rules(cells: Iterable[str], extra: bool = True) -> tuple[np.ndarray, list[str]]:
    """Indicator rows of the categories, largest first, and the sample size as the last row."""
    sets = [set(c.split("\n")) for c in cells]
    names = sorted({x for s in sets for x in s})
    rows = np.array([[x in s for s in sets] for x in names], dtype=float).reshape(len(names), len(sets))
    order = np.lexsort((np.arange(len(names)), -rows.sum(axis=1)))
    rows = rows[order]
    return np.vstack([rows, np.ones((1, len(sets)))]) if extra else rows, [names[k] for k in order]


def resolve(pdf: pd.DataFrame, seed: int, last: bool) -> pd.DataFrame:
    """One flight over a block; the last one lands as well."""
    pdf = pdf.sort_values(["run_id"], kind="stable").reset_index(drop=True)
    key = f"{seed}:{pdf['wave'].iloc[0]}:{len(pdf)}:{pdf['run_id'].iloc[0]}"
    rng = np.random.default_rng(zlib.crc32(key.encode()))
    rules, _ = _rules(pdf["cell"])
    p = flight(pdf["p"].to_numpy(float), rules, rng)
    while last and len(rules) > 1 and ((p > TINY) & (p < 1 - TINY)).any():
        rules = rules[1:]
        p = flight(p, rules, rng)
    if last:
        p = np.where((p > TINY) & (p < 1 - TINY), (rng.random(len(p)) < p).astype(float), np.round(p))
    return pdf.assign(p=p)


def drawing_units(runs: DataFrame, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """``wave, run_id, cell, p, blocks, fan``: every run in a target category with its drawing probability.

    ``blocks`` is in how many blocks the wave starts, ``fan`` how many of them merge into one. ``p`` is 0
    where the run can't be drawn. Waves without targets have no rows.
    """
    wanted = prepared_targets(targets)
    member = run_categories(runs, wanted)
    unit = member.groupBy("wave", "run_id").agg(F.array_join(F.array_sort(F.collect_set("category")), "\n").alias("cell"))
    cells = unit.groupBy("wave", "cell").agg(F.count(F.lit(1)).alias("n"))

    def fit(_: tuple, cell: pd.DataFrame, target: pd.DataFrame) -> pd.DataFrame:
        if cell.empty or target.empty:
            kinds = {"wave": "int32", "cell": "object", "p": "float64", "blocks": "int64", "fan": "int64"}
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in kinds.items()})
        cell = cell.sort_values("cell").reset_index(drop=True)
        one = target.groupby("category", as_index=False).agg(
            want=("want", "max"), floor=("min_rows", "max"), size=("sample_size", "max")
        )
        rules, names = _rules(cell["cell"], extra=False)
        one = one.set_index("category").loc[names]
        n = cell["n"].to_numpy(float)
        floor = pd.to_numeric(one["floor"]).fillna(0).to_numpy(float)
        size = int(pd.to_numeric(target["sample_size"]).fillna(0).max())
        counts = whole_targets(one["want"].to_numpy(float), floor, rules @ n, size)
        p = cell_probabilities(rules > 0, n, counts, min(size, n.sum()))
        # of a block as many runs may stay open as there are rules
        open_ = len(names) + 1
        held = max(block, 4 * open_)
        return pd.DataFrame(
            {"wave": cell["wave"], "cell": cell["cell"], "p": np.where(p > TINY, p, 0.0), "blocks": math.ceil(n.sum() / held), "fan": max(2, held // open_)}
        )

    small = wanted.select("wave", "category", "want", "min_rows", "sample_size")
    chance = cells.groupBy("wave").cogroup(small.groupBy("wave")).applyInPandas(
        fit, "wave int, cell string, p double, blocks long, fan long"
    )
    return unit.join(chance, ["wave", "cell"])


def drawn(units: DataFrame, seed: int = 0) -> DataFrame:
    """``wave, run_id`` of the drawn among ``drawing_units``: flights, merges upward and the landing.

    A wave lands in the round in which it is one block; its sample doesn't depend on other waves.
    """
    top = units.agg(F.max("blocks"), F.min("fan")).first()  # two numbers: how often the largest wave merges
    rounds, left = 1, top[0] or 1
    while left > 1:
        rounds, left = rounds + 1, math.ceil(left / top[1])
    start = F.pmod(F.xxhash64("run_id"), F.col("blocks"))
    todo, resolved = units.where("p > 0").withColumn("block", start), []
    for k in range(rounds):
        flown = _round(todo, seed)
        if k + 1 < rounds:
            flown = flown.checkpoint()  # read twice: for what is resolved and what is open
        resolved.append(flown.where(f"p > {1 - TINY}").select("wave", "run_id"))
        merged = F.ceil(F.col("blocks") / F.col("fan"))
        todo = flown.where(f"p > {TINY} AND p < {1 - TINY}").withColumn("blocks", merged).withColumn("block", F.pmod("block", merged))
    out = resolved[0]
    for more in resolved[1:]:
        out = out.unionByName(more)
    return out


def balanced_sample(runs: DataFrame, targets: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """The drawn runs: ``wave, run_id``; the same for the same data and ``seed``.

    A run counts by its latest row; a run without source or labels is never drawn, nor is one in no
    target category. Where the targets, the minimum rows and the size can't all hold, minimum
    rows come first, then the size, then the shares. Empty tables give an empty sample.
    """
    checkpoint_dir(runs.sparkSession)
    return drawn(drawing_units(runs, targets, block).checkpoint(), seed)


def _round(units: DataFrame, seed: int) -> DataFrame:
    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        return resolve(pdf, seed, bool(pdf["blocks"].iloc[0] == 1))

    # the work is arithmetic on few bytes: as many tasks as there are cores to do it, not as bytes would have it
    tasks = 3 * units.sparkSession.sparkContext.defaultParallelism
    kept = units.select("wave", "run_id", "cell", "p", "block", "blocks", "fan").repartition(tasks, "wave", "block")
    return kept.groupBy("wave", "block").applyInPandas(fly, "wave int, run_id long, cell string, p double, block long, blocks long, fan long")


def sample_report(runs: DataFrame, targets: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """One row per target row: what was wanted, what is there and what was drawn.

    ``wave, is_positive, label, run_source, target_pct, min_rows, sample_size, need, available, expected,
    drawn, residual, met, reason``. ``need`` is the larger of ``min_rows`` and ``target_pct`` percent of
    ``sample_size``, ``residual`` is drawn minus need. ``reason`` says why a category was not met: ``too few
    runs`` are there; ``size``: the sample had no room for it besides what the other categories need; or
    ``rounding`` in the landing. It is NULL where the need is met.
    """
    checkpoint_dir(runs.sparkSession)
    units = drawing_units(runs, targets, block).checkpoint()  # for the draw and for the counts
    taken = drawn(units, seed).withColumn("drawn", F.lit(1))
    # counts per cell, then per category: few rows
    cells = units.join(taken, ["wave", "run_id"], "left").groupBy("wave", "cell").agg(
        F.count(F.lit(1)).alias("available"), F.sum("p").alias("expected"), F.count("drawn").alias("drawn")
    )
    counts = cells.withColumn("category", F.explode(F.split("cell", "\n"))).groupBy("wave", "category").agg(
        *(F.sum(c).alias(c) for c in ("available", "expected", "drawn"))
    )
    zero = F.lit(0).cast("long")
    out = prepared_targets(targets).join(counts, ["wave", "category"], "left").select(
        "wave", *KEY, "target_pct", "min_rows", "sample_size", "need",
        F.coalesce("available", zero).alias("available"),
        F.round(F.coalesce("expected", F.lit(0.0)), 6).alias("expected"),
        F.coalesce("drawn", zero).alias("drawn"),
    )
    need = F.col("need")
    reason = F.when(F.col("drawn") < need, F.when(F.col("available") < need, "too few runs").when(F.col("expected") < need - 1e-6, "size").otherwise("rounding"))
    return out.withColumns({"residual": F.col("drawn") - need, "met": F.col("drawn") >= need, "reason": reason})


def unmet_for_lack_of_runs(report: DataFrame) -> DataFrame:
    """The rows of a report that the drawn sample leaves under their need since the wave has too few runs."""
    return report.where(F.col("reason") == "too few runs")
