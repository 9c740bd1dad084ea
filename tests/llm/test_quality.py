import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.llm import quality as Q
from loomstat.llm.quality_examples import COMMON_WORDS, EXAMPLES

HAN = r"[㐀-鿿豈-﫿぀-ヿ]"


def by_hand(text):
    words = re.findall(rf"{HAN}|(?:(?!{HAN})[^\W_])+(?:['’](?:(?!{HAN})[^\W\d_])+)*", text)
    lines = [x.strip() for x in re.split(r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", text) if x.strip()]
    ended = sum(bool(re.search(r"[.!?…。！？][\"')\]}*_”’»」』）]{0,3}$", x)) for x in lines)
    best = max(sum(w.lower() in set(v) for w in words) for v in COMMON_WORDS.values())
    return len(words), ended / len(lines), best / max(len(words), 1)


@pytest.mark.parametrize(
    "text", ["The worker's file isn't here.\n\nNo, it is (not)!\r\n* a b\n", "日志。测试 abc 1x，了\n很长", "x", "-- ## --", "Der Bericht ist 3 Seiten lang. \"Ja.\"\n", "a_b c-d 2,516.1 v7.2"]
)
def test_statistics(text):
    got = Q.describe(["pad. pad\n", text, "\n \n"])
    n, ended, common = by_hand(text)
    assert got.n_words[1] == n and got.ended[1] / got.lines[1] == pytest.approx(ended)
    assert got.common[1].max() / max(n, 1) == pytest.approx(common)
    assert got.visible[2] == 0 and got.lines[2] == 0


def shuffled(text, rng):
    lines = text.split("\n")
    rng.shuffle(lines)
    return "\n".join(lines)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    rows = [shuffled(t, rng) for forms in EXAMPLES.values() for t in forms for _ in range(3)]
    return Q.fit_mixture(Q.describe(rows).features)


def test_examples_come_out_as_their_kind(model):
    wrong = []
    for kind, forms in EXAMPLES.items():
        for text in forms:
            if Q.KINDS[Q.document_kinds(Q.describe([text]), model, 1)[0].argmax()] != kind:
                wrong.append(text[:40])
    assert len(wrong) <= 3, wrong


def test_held_out_forms(model):
    """Texts that are no examples, in forms that are."""
    table = "\n".join(f"{a};{b};{c}" for a, b, c in zip(range(9), "abcdefghi", range(100, 109), strict=True))
    kinds = {
        "prose": ["We did not expect that the second build would fail so early. It had been tested twice, and nobody saw a problem with it.", "Ich habe den Bericht gelesen, aber er ist noch nicht fertig. Wir müssen ihn noch einmal prüfen."],
        "list": ["- apples\n- pears\n- green plums\n- figs\n- dates", "1. Open the box.\n2. Read the note.\n3. Close the box.\n4. Call the shop."],
        "table": [table, "name\tage\tcity\nann\t31\toslo\nbob\t44\trome\ncid\t28\tlyon"],
        "junk": ["=" * 60 + "\n" + "=" * 40 + "\n" + "=" * 55, "2024-01-02T03:04:05Z INFO app[12] took=33 path=/a/b.c\n" * 4, "blah blah blah blah blah blah blah blah blah blah blah blah"],
    }
    for kind, texts in kinds.items():
        for text in texts:
            got = Q.document_kinds(Q.describe([text]), model, 1)[0]
            assert Q.KINDS[got.argmax()] == kind, (kind, text, got)


def test_most_of_the_characters_decide(model):
    prose, table = EXAMPLES["prose"][0], EXAMPLES["table"][0]
    for text, kind in ((f"{prose}\n\n{prose}\n\n{table}", "prose"), (f"It went well, they say.\n\n{table}\n{table}\n{table}", "table")):
        assert Q.KINDS[Q.document_kinds(Q.describe([text]), model, 1)[0].argmax()] == kind


def test_slices_don_t_matter(model):
    texts = [t for forms in EXAMPLES.values() for t in forms]
    whole, parts = Q.describe(texts), [Q.describe([t]) for t in texts]
    assert np.allclose(whole.features, np.concatenate([p.features for p in parts]), atol=1e-5)
    assert np.allclose(Q.document_kinds(whole, model, len(texts)), np.concatenate([Q.document_kinds(p, model, 1) for p in parts]))


def test_column(spark):
    some = ("The end was near", "Nobody had seen the old pilot", "We did not expect that it would fail so early", "It was late, and the road to the coast was long", "She wrote to him")
    rng = random.Random(4)
    said = [rng.choice(some) for _ in range(30_000)]
    long = ". ".join(said) + "."
    rows = [(k, t) for k, t in enumerate(t for forms in EXAMPLES.values() for t in forms)]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, long), (904, "​"), (None, rows[0][1]), (1, rows[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kind": F.lit(1), "f": F.lit(2)})
    got = Q.quality(df).toPandas()
    assert len(got) == len(rows) - 4 and not set(got.doc_id.dropna()) & {900, 901, 902, 904}
    assert got[got.doc_id == 903].n_words.item() == sum(len(x.split()) for x in said) and got[got.doc_id == 903].kind.item() == "prose"
    assert got.groupby("doc_id").kind.nunique().max() == 1
    assert Q.quality(df.limit(0)).count() == 0


def test_every_line_of_every_document_is_fitted(spark):
    forms = [t for forms in EXAMPLES.values() for t in forms]
    rows = [(k, forms[k % len(forms)][: 40 + k % 90].rstrip("'’")) for k in range(2_400)]
    rows += [(9_000, "\n".join(f"{k};{k * k};a{k % 7}" for k in range(1_500))), (9_001, None), (9_002, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    lines = Q.describe([t for _, t in rows if t]).features
    assert len(lines) > 3_900
    want, got = Q.fit_mixture(lines), Q.fit_documents(df)
    for name in ("shift", "scale", "weights", "means", "variances", "kinds"):
        assert np.allclose(getattr(got, name), getattr(want, name), rtol=1e-3, atol=1e-4), name
    assert np.allclose(got.shift, np.concatenate([lines, *(Q.describe([t]).features for t in forms)]).mean(axis=0, dtype=float))


def test_sums_are_those_of_the_responsibilities(model):
    lines = Q.describe([t for forms in EXAMPLES.values() for t in forms]).features
    x = (lines - model.shift) / model.scale
    r = model.responsibilities(x)
    got = model.sums(lines)
    assert np.allclose(got[:-1], r.T @ np.concatenate([np.ones((len(x), 1)), x, x * x], axis=1), rtol=1e-3, atol=1e-2)
    log = model._log(x)
    assert got[-1, 0] == pytest.approx((np.log(np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1)) + log.max(axis=1)).sum(), rel=1e-4)


def test_fragments_over_and_over_at_any_distance(model):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    fragment = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long, block = fragment(30), f"{fragment(7)}\n{fragment(9)}\n{fragment(5)}\n"
    han = "".join(chr(0x4E00 + rng.randint(0, 3_000)) for _ in range(20))
    sentence = "The end of it was near. "
    share = lambda text: float(Q.describe([text]).features[:, Q.FEATURES.index("period")].max())
    for text in (f"{long} " * 6, block * 5, han * 6, sentence * 50, sentence * 2_000):
        assert share(text) > 0.7
        assert Q.KINDS[Q.document_kinds(Q.describe([text]), model, 1)[0].argmax()] == "junk", text[:50]
    assert share(" ".join(rng.choice(words) for _ in range(300))) < 0.5 and share(f"{long}\n\n{long}") < 0.5
    prose = EXAMPLES["prose"][0]
    assert Q.KINDS[Q.document_kinds(Q.describe([prose]), model, 1)[0].argmax()] == "prose"


def test_texts_are_read_and_described_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    forms = [t for forms in EXAMPLES.values() for t in forms]
    df = spark.createDataFrame(list(enumerate(forms)), "doc_id long, text string").repartition(3).mapInArrow(seen, "doc_id long, text string")
    assert Q.quality(df).count() == len(forms) and read.value == len(forms)


def test_kept_lines_are_those_described(spark):
    texts = ["It is late.\n\n- a\n- b\n", " \n", "", None, "日志 abc\n日志 abc", "a;b;c\n1;2;3"] + [t for forms in EXAMPLES.values() for t in forms]
    df = spark.createDataFrame([(f"k{k}", t) for k, t in enumerate(texts)], "name string, said string").coalesce(1)
    kept = Q.keep_lines(df, "name", "said").toArrow()
    n, keys = kept["n"][0].as_py(), kept["keys"][0].as_py()
    assert len(kept) == 1 and keys == [f"k{k}" for k, t in enumerate(texts) if t]
    got, want = Q.unpacked_lines(n, kept["f"][0], kept["counts"][0], len(keys)), Q.describe([t for t in texts if t])
    for name in vars(want):
        assert np.array_equal(getattr(got, name), getattr(want, name)), name


def test_no_sum_is_too_small_for_a_normalized_number(model):
    """Such numbers make a step several times slower on many processors."""
    lines = Q.describe([t for forms in EXAMPLES.values() for t in forms]).features
    for k in range(0, len(lines), 7):
        weights = model.sums(lines[k : k + 1])[:-1, 0]
        assert weights.min() >= np.finfo(np.float32).tiny and weights.sum() == pytest.approx(1, rel=1e-5)


def test_ends_of_a_slice_are_not_next_to_each_other():
    assert np.array_equal(Q.describe(["+ a", "b -"]).features[0], Q.describe(["+ a"]).features[0])
