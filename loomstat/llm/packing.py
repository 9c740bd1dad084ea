"""Filling containers of fixed capacity with documents: variable-capacity best fit.

Sizes are tokens of a public tokenizer. A text longer than the capacity is divided into full
pieces and a rest; nothing else is divided. Only (key, piece, size) rows are shuffled, by a hash of
key and piece, sorted by it and cut into blocks of at most ``2 * BLOCK`` rows, so that blocks depend neither on
the file layout nor on the order in which rows arrive: a task that is run again gives the same containers.

A block is packed by itself in one pass over its items from large to small: each goes
into the open bin that it fills best, found by a bit mask over the space left; where none
fits, the permitted capacity of least cost is opened, by the fill that the sizes still to come allow. Finally every
bin is brought down to the smallest permitted capacity that holds its contents.

Where several capacities are permitted they are chosen jointly: the block is packed once with every choice of them that
holds its largest item, and the packing of least total cost stands. The cost of a bin is that of
training on it: its tokens, attention that grows with the square of its length, and a constant.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.llm.tokenize import DEFAULT_VOCABULARY, encoder, read_vocabulary, slices

CAPACITY = 2_048
#: Rows that are packed together; a task with more packs them in several blocks.
BLOCK = 50_000
#: What a bin costs besides its space, in tokens.
BIN_COST = 16
#: The length at which attention costs as much as all else that a token costs.
ATTENTION = 8_192


def bin_cost(capacity: np.ndarray | int) -> np.ndarray | float:
    """What a bin costs, in tokens of a very short one."""
    return capacity * (1 + capacity / ATTENTION) + BIN_COST


def joint_fit(sizes: Sequence[int], capacities: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """``best_fit`` with the choice of ``capacities`` whose bins cost least in total; of equals the first.

    Every choice that holds the largest item is tried, smaller ones first. There are ``2 ** n`` of them, so up to 6
    capacities are allowed.
    """
    caps = sorted(set(capacities))
    if len(caps) > 6:
        raise ValueError("more than 6 capacities")
    most = max(sizes, default=0)
    best, least = None, math.inf
    for n in range(1, len(caps) + 1):
        for some in combinations(caps, n):
            if some[-1] < most:
                continue
            fit = best_fit(sizes, some)
            # bins are brought down to any permitted capacity, chosen or not
            used = np.bincount(fit[0], weights=sizes, minlength=len(fit[1])) if len(sizes) else np.empty(0)
            down = np.asarray(caps)[np.searchsorted(caps, np.maximum(used, 1))]
            cost = float(np.sum(bin_cost(down)))
            if cost < least:
                best, least = (fit[0], down), cost
    if best is None:
        raise ValueError("an item is larger than the largest capacity")
    return best


def best_fit(sizes: Sequence[int], capacities: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item and the capacity of each bin. ``sizes`` must run from large to small.

    Items of size 0 go into the first bin. An item over the largest capacity is an error.
    """
    caps = sorted(set(capacities))
    if not caps or caps[0] <= 0:
        raise ValueError("capacities must be positive")
    if len(sizes) and max(sizes) > caps[-1]:
        raise ValueError("an item is larger than the largest capacity")
    bins = np.empty(len(sizes), np.int64)
    used: list[int] = []
    space: list[list[int]] = [[] for _ in range(caps[-1] + 1)]
    mask = 0
    # the sizes still to come: how many of each, and a bit for each
    to_come = np.bincount(np.asarray(sizes, np.int64), minlength=1).tolist() if len(sizes) else [0]
    sizes_left = sum(1 << v for v, n in enumerate(to_come) if v and n)
    for k, size in enumerate(sizes):
        if size == 0:
            bins[k] = 0
            if not used:
                used.append(0)
            continue
        to_come[size] -= 1
        if not to_come[size]:
            sizes_left &= ~(1 << size)
        fits = mask >> size
        if fits:
            room = size + ((fits & -fits).bit_length() - 1)
            b = space[room].pop()
            if not space[room]:
                mask &= ~(1 << room)
            room -= size
        else:
            room, b = _open(size, caps, to_come, sizes_left) - size, len(used)
            used.append(0)
        used[b] += size
        bins[k] = b
        if room:
            space[room].append(b)
            mask |= 1 << room
    at = np.searchsorted(caps, np.maximum(used, 1)) if used else np.empty(0, int)
    return bins, np.asarray(caps)[at]


def _open(size: int, caps: Sequence[int], to_come: Sequence[int], sizes_left: int) -> int:
    """The capacity to open for an item: least cost per token that it will hold.

    What it will hold besides is told by the sizes still to come, the largest that fits first. The
    cost is that of the smallest capacity for it, as the bin is brought down to that in the end.
    """
    able = [c for c in caps if c >= size]
    if len(able) == 1:
        return able[0]

    def cost(cap: int) -> float:
        spare = most = cap - size
        while fits := sizes_left & ((1 << (min(spare, most) + 1)) - 1):
            v = fits.bit_length() - 1
            spare -= v * min(to_come[v], spare // v)
            most = v - 1
        held = cap - spare
        return bin_cost(next(c for c in able if c >= held)) / held

    return min(able, key=lambda c: (cost(c), -c))


def sized_pieces(
    documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY, capacity: int = CAPACITY
) -> DataFrame:
    """``key, piece, start_token, n_tokens``: a text over the capacity is divided, any other is piece 0."""
    ranks = read_vocabulary(vocabulary)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks)
        for batch in batches:
            for part in slices(batch, text):
                n = own.count(part.column(text).to_pylist())
                pieces = np.maximum(1, -(-n // capacity))
                row = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(key).take(pa.array(row)),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(np.minimum(n[row] - start, capacity), pa.int32()),
                    ],
                    [key, "piece", "start_token", "n_tokens"],
                )

    rows = documents.select(key, text)
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(measure, f"`{key}` {kind}, piece int, start_token long, n_tokens int")


def pack(
    pieces: DataFrame, parts: int, key: str = "doc_id", capacities: Sequence[int] = (CAPACITY,), block: int = BLOCK
) -> DataFrame:
    """Adds ``container`` (unique), its ``capacity`` and the tokens ``used`` to every row of ``sized_pieces``.

    ``parts`` is the number of tasks, about one per ``block`` rows. Every row is placed once, also those of 0 tokens
    and repeated ones. The same rows give the same containers, whatever their order and layout.
    """
    kind = pieces.schema[key].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 40
        held: list[pa.RecordBatch] = []
        count = opened = 0

        def flush() -> pa.RecordBatch:
            nonlocal opened
            rows = pa.Table.from_batches(held).combine_chunks()
            rows = rows.sort_by([("n_tokens", "descending"), (key, "ascending"), ("piece", "ascending")])
            sizes = rows.column("n_tokens").to_numpy().tolist()
            bins, caps = joint_fit(sizes, capacities)
            used = np.bincount(bins, weights=sizes, minlength=len(caps)).astype(np.int64)
            out = rows.append_column("container", pa.array(first + opened + bins, pa.int64()))
            out = out.append_column("capacity", pa.array(caps[bins], pa.int32()))
            out = out.append_column("used", pa.array(used[bins], pa.int32()))
            opened += len(caps)
            return out.combine_chunks().to_batches()[0]

        for batch in batches:
            batch = batch.drop_columns(["_lot"])
            # blocks end at row numbers, not at batches
            while batch.num_rows:
                some = batch.slice(0, 2 * block - count)
                batch = batch.slice(some.num_rows)
                held.append(some)
                count += some.num_rows
                if count == 2 * block:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    lot = pieces.withColumn("_lot", F.xxhash64(key, "piece"))
    spread = lot.repartition(parts, "_lot").sortWithinPartitions("_lot", key, "piece", "n_tokens")
    return spread.mapInArrow(
        place,
        f"`{key}` {kind}, piece int, start_token long, n_tokens int, container long, capacity int, used int",
    )


def containers(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    vocabulary: str = DEFAULT_VOCABULARY,
    capacities: Sequence[int] = (CAPACITY,),
    block: int = BLOCK,
) -> DataFrame:
    """Every text placed: ``key, piece, start_token, n_tokens, container, capacity, used``.

    NULL and empty texts have 0 tokens and take no space in a container; an empty table gives no
    rows. Columns of other names are not looked at.
    """
    pieces = sized_pieces(documents, key, text, vocabulary, max(capacities))
    # a token has a byte at least: this many pieces at most, known without encoding
    most = F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / max(capacities)))
    rows = documents.agg(F.sum(most)).first()[0] or 0
    return pack(pieces, max(1, math.ceil(rows / block)), key, capacities, block)


def container_cost(packed: DataFrame) -> DataFrame:
    """``capacity, n_containers, used, cost`` of packed rows: what the bins of each length hold and cost."""
    bins = packed.groupBy("container").agg(F.max("capacity").alias("capacity"), F.max("used").alias("used"))
    c = F.col("capacity")
    return bins.groupBy("capacity").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("used")).withColumn(
        "cost", F.col("n_containers") * bin_cost(c)
    )


def placement_faults(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, whole, fits``: whether each text's pieces follow one another and its containers hold what they should.

    ``whole``: pieces are numbered from 0 without gaps and each begins where the one before ends. ``fits``: the tokens placed
    in each of its containers add up to ``used``, within ``capacity``. For tables with one row per key.
    """
    bins = packed.groupBy("container").agg(
        (F.sum("n_tokens") == F.max("used")).alias("summed"), (F.max("used") <= F.min("capacity")).alias("within")
    )
    told = packed.join(bins, "container").groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.max("piece").alias("last"), F.countDistinct("piece").alias("pieces"), F.sum("n_tokens").alias("total"),
        F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.min(F.col("summed") & F.col("within")).alias("fits"),
    )
    whole = (F.col("n") == F.col("pieces")) & (F.col("last") + 1 == F.col("n")) & (F.col("total") == F.col("end"))
    return told.select(key, whole.alias("whole"), "fits")
