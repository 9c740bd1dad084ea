import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.llm import packing, tokenize

tokenizers = pytest.importorskip("tokenizers")
ALPHABET = [chr(c) for c in [*range(0x250), *range(0x600, 0x680), *range(0x1680, 0x1690), *range(0x2000, 0x2070), *range(0x3000, 0x3040), 0xFEFF, 0x1F600, 0xFFFD, 0xB2, 0x2160, 0x4E00]]


@pytest.fixture(scope="module")
def public():
    path = tokenize.DEFAULT_VOCABULARY.replace(".tiktoken", ".json")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def own():
    return tokenize.Encoder(tokenize.read_vocabulary())


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", " don't", "\n\n", "  ", "naïve", "文字", "1234", "####", "<|endoftext|>", "x" * 300, "ab" * 400, "\t"]
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return out + ["".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", " ", "\r\n", "a" * 2_000, " " * 3_000, "".join(rng.choice("abcdef") for _ in range(3_000))]


def test_ids_equal_the_public_library(own, public):
    told = texts(1, 600)
    offsets, ids = own.encode(told)
    for k, text in enumerate(told):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == public(text), repr(text)
    assert own.count(told).tolist() == np.diff(offsets).tolist()


def test_a_small_pool_starts_afresh(own, public, monkeypatch):
    monkeypatch.setattr(tokenize, "POOL_WORDS", 50)
    for seed in range(6):
        told = texts(seed, 20)
        offsets, ids = own.encode(told)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [public(t) for t in told]


def test_a_million_characters(own, public):
    text = "z" * 1_000_000
    offsets, ids = own.encode([text, None])
    assert ids.tolist() == public(text) and offsets[-1] == offsets[-2]


def test_column(spark, public):
    rows = [(1, "Hello  world"), (2, None), (3, ""), (None, "x"), (1, "Hello  world"), (4, "né\n文" * 3_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = sorted(((r.doc_id, list(r.ids)) for r in tokenize.encode_column(df).collect()), key=str)
    assert got == sorted(((k, public(t) if t else []) for k, t in rows), key=str)
    assert tokenize.encode_column(df.limit(0)).count() == 0


def at_least(sizes, cap):
    """Items over half a bin can't share one; smaller ones fill what those leave, for any cut-off."""
    s = np.array(sizes)
    best = 0
    for a in range(cap // 2 + 1):
        big, mid, small = s[s > cap - a], s[(s > cap / 2) & (s <= cap - a)], s[(s >= a) & (s <= cap / 2)]
        best = max(best, len(big) + len(mid) + max(0, -(-(small.sum() - (len(mid) * cap - mid.sum())) // cap)))
    return best


def test_best_fit_never_overfills_and_leaves_little():
    rng = np.random.default_rng(0)
    for caps in ((2_048,), (256, 512, 2_048), (100,)):
        sizes = np.sort(np.minimum(rng.lognormal(5, 1, 4_000).astype(int), max(caps)))[::-1].tolist()
        bins, capacity = packing.best_fit(sizes, caps)
        used = np.bincount(bins, weights=sizes)
        assert len(used) == len(capacity) and (used <= capacity).all() and set(capacity) <= set(caps)
        if len(caps) == 1:  # against a lower bound on the number of bins
            assert len(used) <= 1.01 * at_least(sizes, caps[0]) + 1
        else:
            assert used.sum() / capacity.sum() > 0.99
        smaller = [max([c for c in caps if c < k], default=0) for k in capacity]
        assert (used > smaller).all()  # brought down to what it holds
    assert packing.best_fit([], (8,))[0].size == 0 and packing.best_fit([0, 0], (8,))[1].tolist() == [8]
    with pytest.raises(ValueError):
        packing.best_fit([9], (8,))


def test_every_text_is_placed_once(spark, own):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([0, 3, 50, 400, 5_000])))) for k in range(120)]
    rows += [(500, None), (501, ""), (7, rows[7][1]), (None, "no key")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"container": F.lit(1), "piece": F.lit(2)})
    got = packing.containers(df, capacities=(512,)).toPandas()
    sizes = own.count([t for _, t in rows])
    assert got.n_tokens.sum() == sizes.sum() and len(got) == np.maximum(1, -(-sizes // 512)).sum()
    per = got.groupby("container").agg(n=("n_tokens", "sum"), used=("used", "first"), capacity=("capacity", "first"))
    assert (per.n == per.used).all() and (per.used <= 512).all()
    for (key, _), n in zip(rows, sizes, strict=True):
        part = got[got.doc_id == key] if key is not None else got[got.doc_id.isna()]
        if n <= 512:
            assert set(part.piece) == {0}
    again = packing.containers(df.repartition(5), capacities=(512,)).toPandas()
    key = ["doc_id", "piece", "container"]
    assert sorted(map(str, got[key].to_numpy().tolist())) == sorted(map(str, again[key].to_numpy().tolist()))
    assert packing.containers(df.limit(0)).count() == 0


def test_a_task_with_many_rows_packs_in_blocks(spark):
    pieces = spark.range(5_000).select(F.lit(1).alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start_token"), (F.col("id") % 900).cast("int").alias("n_tokens"))
    got = packing.pack(pieces, 1, block=500).toPandas()
    assert len(got) == 5_000 and (got.groupby("container").n_tokens.sum() <= 2_048).all()


def test_a_smaller_capacity_wins_where_the_largest_would_stay_empty():
    bins, capacity = packing.best_fit([250] * 100, (256, 700))
    assert capacity.tolist() == [256] * 100 and sorted(bins) == list(range(100))
    # small sizes to come fill the largest one
    bins, capacity = packing.best_fit([250] * 20 + [40] * 100, (256, 700))
    assert set(capacity[bins[:20]].tolist()) == {700} and capacity.sum() <= 9_000 + 700  # where attention makes long bins dear, the rest takes short ones


def test_blocks_do_not_depend_on_the_order_of_rows(spark):
    pieces = spark.range(7_001).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start_token"), (1 + F.col("id") * 7 % 900).cast("int").alias("n_tokens"))
    rows = lambda df: sorted(map(tuple, packing.pack(df, 2, block=1_000).select("doc_id", "container", "capacity").collect()))
    assert rows(pieces) == rows(pieces.orderBy(F.rand(1))) == rows(pieces.repartition(5))


def test_several_lengths_cost_less_than_one():
    rng = np.random.default_rng(5)
    sizes = np.sort(np.minimum(rng.lognormal(5.5, 1, 6_000).astype(int) + 1, 2_048))[::-1].tolist()
    cost = lambda caps: packing.bin_cost(packing.joint_fit(sizes, caps)[1]).sum()
    several = packing.joint_fit(sizes, (256, 512, 1_024, 2_048))[1]
    assert len(set(several.tolist())) >= 3
    assert cost((256, 512, 1_024, 2_048)) < 0.97 * cost((2_048,)) and cost((256, 512, 1_024, 2_048)) <= cost((1_024, 2_048)) <= cost((2_048,))
    used = np.bincount(packing.joint_fit(sizes, (256, 2_048))[0], weights=sizes)
    assert used.sum() == sum(sizes)
    assert packing.joint_fit([], (8,))[0].size == 0
    with pytest.raises(ValueError):
        packing.joint_fit([9], (4, 8))
    with pytest.raises(ValueError):
        packing.joint_fit([1], range(1, 9))


def test_faults_of_a_placement_are_told(spark):
    good = [(1, 0, 0, 5, 9, 8, 8), (2, 0, 0, 3, 9, 8, 8)]
    schema = "doc_id long, piece int, start_token long, n_tokens int, container long, capacity int, used int"
    faults = lambda rows: {r.doc_id: (r.whole, r.fits) for r in packing.placement_faults(spark.createDataFrame(rows, schema)).collect()}
    assert faults(good) == {1: (True, True), 2: (True, True)}
    assert faults([*good, (2, 0, 0, 3, 10, 8, 3)])[2] == (False, True)
    assert faults([(1, 0, 0, 5, 9, 4, 5), (2, 1, 5, 3, 7, 8, 2)]) == {1: (True, False), 2: (False, False)}
