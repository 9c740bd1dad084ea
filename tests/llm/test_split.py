import random

import pytest
from pyspark.sql import functions as F

from loomstat.llm import split

MSG = "array<struct<role:string,name:string,content:string,function_call:struct<name:string,arguments:string>>>"
SCHEMA = f"run_id long, chunk_index int, messages {MSG}, context {MSG}, text string, pieces int, marked string"


def m(content, role="user", call=None, name=None):
    return (role, name, content, call)


def run(spark, rows, limit, overlap):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    told = df.select("run_id", "chunk_index", split.render_chunk(F.col("messages"), F.col("context")).alias("t"), split.render_chunk(F.col("messages"), F.col("context"), marked=True).alias("k"))
    texts = {(r.run_id, r.chunk_index): (r.t, r.k) for r in told.collect()}
    return texts, {(r.run_id, r.chunk_index): r.pieces for r in split.split_chunks(df, limit, overlap).collect()}


def python_cut(marked, limit, overlap):
    """The same rule, walked by hand: the last of the strongest boundaries in the further half, else nearer."""
    import re

    ends = [0]
    while ends[-1] < len(marked):
        at = ends[-1]
        least, most = (max(1, overlap), limit) if at == 0 else (1, limit - overlap)
        if len(marked) - at <= most:
            ends.append(len(marked))
            break
        best = None
        half, few, later = max(least, most // 2), max(least, limit // split.LEAST_FILL), limit - overlap
        kinds = (split.MARK, r"\n[ \t]{0,8}\r?\n", r"[\n\r\u2028\u2029]", split.SENTENCE_END)
        is_end = lambda e, kind: any(re.fullmatch(kind, marked[max(0, e - k) : e]) for k in range(1, 13))
        keeps = lambda e: len(marked) - e <= later or any(is_end(x, kind) for kind in kinds for x in range(e + later // 2, e + later + 1))
        for low, high in ((half, most), (few, half - 1), (least, min(few, half) - 1)):
            for kind in kinds:
                found = [e for e in range(at + low, at + high + 1) if is_end(e, kind) and (low >= few or keeps(e))]
                if found and best is None:
                    best = found[-1]
        ends.append(best or at + most)
    return [(max(0, a - overlap) if a else 0, b) for a, b in zip(ends, ends[1:], strict=False)]


def test_against_the_rule_by_hand(spark):
    rng = random.Random(4)
    words = ["word", "a", "some.", "end!", "next\n", "para\n\n", "汉字。", "x" * 90, "q? ", "é\r\n", "\U0001f600"]
    rows = []
    for k in range(40):
        make = lambda: m(" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))), rng.choice(["user", "assistant"]), ("ls", "y" * rng.randint(0, 300)) if rng.random() < 0.3 else None)
        rows.append((k, 0, [make() for _ in range(rng.randint(0, 5))], [make()] if k % 2 else []))
    limit, overlap = 400, 50
    texts, got = run(spark, rows, limit, overlap)
    assert len(got) == 40
    for key, pieces in got.items():
        text, marked = texts[key]
        assert len(text) == len(marked)
        spans = [(p.start, p.end) for p in pieces]
        assert spans == (python_cut(marked, limit, overlap) if len(text) > limit else [(0, len(text))])
        assert all(p.text == text[p.start : p.end] and 0 < len(p.text) <= limit for p in pieces)
        assert all(b.start == a.end - overlap for a, b in zip(pieces, pieces[1:], strict=False))
        assert pieces[-1].end == len(text) and "".join(p.text[(overlap if i else 0) :] for i, p in enumerate(pieces)) == text


def test_nulls_empties_marks_and_long_texts(spark):
    rows = [
        (1, 0, [], []), (2, 0, None, None), (3, 0, [None, m(None)], [None]), (None, None, [m("a" * 900)], []),
        (4, 0, [m("￿ odd ￿" * 200)], [m("\udfff".encode("utf-8", "replace").decode())]), (5, 0, [m("z" * 400_000)], []), (5, 0, [m("z" * 400_000)], []),
    ]
    texts, got = run(spark, rows, 400, 50)
    assert texts[(2, 0)][0] == "<transcript_chunk>\n\n</transcript_chunk>" == texts[(1, 0)][0]
    assert texts[(3, 0)][0] == "<transcript_chunk>\n[user]\n</transcript_chunk>"
    for key, pieces in got.items():
        assert "".join(p.text[(50 if i else 0) :] for i, p in enumerate(pieces)) == texts[key][0]
        assert all(len(p.text) <= 400 for p in pieces)
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    assert {(r.run_id, r.chunk_index) for r in split.oversized(df, 400, 50).collect()} == {(None, None), (4, 0), (5, 0)}
    assert split.pieces(df, 400, 50).where("run_id = 5").count() == len(got[(5, 0)])
    assert split.pieces(df.limit(0)).count() == split.oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split.split_chunks(df, 100, 100)


def test_pieces_are_at_least_half_full_where_a_boundary_allows(spark):
    rows = [(1, 0, [m("short")] + [m("one two three. " * 60) for _ in range(9)], [m("opening")])]
    _, got = run(spark, rows, 2_000, 200)
    pieces = got[1, 0]
    assert len(pieces) > 4 and all(p.end - p.start - 200 >= 900 for p in pieces[:-1])


def test_checks_of_pieces(spark):
    rows = [(1, 0, [m("word. " * 300)], None), (None, None, [m("word. " * 300)], []), (1, 0, [m("word. " * 300)], None), (2, 0, [m("small")], None)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    got = split.piece_checks(df, 400, 50).collect()
    assert sorted(str(r.run_id) for r in got) == ["1", "None"] and all(r.covered and r.shared and r.within and r.own_text for r in got)
