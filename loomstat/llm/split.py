"""Cutting oversized chunks at natural boundaries with a shared overlap.

The rendered chunk gets a one-character mark where two messages meet. One regular
expression then consumes the text piece by piece: its alternatives are ordered by the
strength of the boundary (message, paragraph, line, sentence, any character), each
with a quantifier bounded by the limit, so that the strongest boundary in reach wins and
of equally strong ones the last. Boundaries that leave a piece less than half full are
tried after all others, and those that leave it nearly empty only if the next piece then ends at a boundary: else a
stretch without any is cut by characters either way, and a tiny piece would gain nothing. Lookback offsets into the unmarked text supply
the overlap. Everything is one projection of built-in functions: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.functions.messages import BLOCK_SEPARATOR, render_message

LIMIT = 6_000
OVERLAP = 200
#: A piece with less new text than this part of the limit is made only to keep the next one whole.
LEAST_FILL = 6
#: A noncharacter, which texts don't hold; where one does, it is masked in the marked copy.
MARK = "\uffff"
MASK = "\ufffd"

# What ends a sentence, with closing quotes or brackets after it.
SENTENCE_END = r"[.!?][\"'\u201d\u2019)\]]{0,3}\s|[\u3002\uff01\uff1f][\"\u201d\u2019\u300d\u300f\uff09]{0,3}"


def boundary_pattern(limit: int, overlap: int) -> str:
    """The first piece takes up to ``limit`` characters, each later one ``limit - overlap`` new ones.

    The first is also at least ``overlap`` long, else the second could not share that much.
    """

    def options(least: int, most: int) -> str:
        half, few = max(least, most // 2), max(least, limit // LEAST_FILL)
        ends = (MARK, r"\n[ \t]{0,8}\r?\n", r"[\n\r\u2028\u2029]", SENTENCE_END)
        at = lambda low, high, then="": [rf".{{{low},{high}}}(?<={end}){then}" for end in ends] if low <= high else []
        whole = rf"(?=.{{0,{limit - overlap}}}\z|.{{{(limit - overlap) // 2},{limit - overlap}}}(?:{'|'.join(f'(?<={end})' for end in ends)}))"
        return "|".join(
            [rf".{{{least},{most}}}\z", *at(half, most), *at(few, half - 1), *at(least, min(few, half) - 1, whole), rf".{{{least},{most}}}"]
        )

    return rf"(?s)\A(?:{options(max(1, overlap), limit)})|(?:{options(1, limit - overlap)})"


def _marked(text: Column) -> Column:
    return F.replace(text, F.lit(MARK), F.lit(MASK))


def render_chunk(messages: Column, context: Column, marked: bool = False) -> Column:
    """The chunk as its reader sees it; ``marked`` sets a mark after each gap between messages.

    Both forms have the same length in code points. NULL arrays count as empty, NULL
    messages in them are passed over.
    """

    def rendered(array: Column) -> Column:
        kept = F.filter(array, lambda m: m.isNotNull())
        return F.transform(kept, lambda m: _marked(render_message(m)) if marked else render_message(m))

    gap = BLOCK_SEPARATOR[:-1] + MARK if marked else BLOCK_SEPARATOR
    body = F.array_join(rendered(F.coalesce(messages, F.array().cast(_kind()))), gap)
    opening = rendered(F.coalesce(context, F.array().cast(_kind())))
    turn = "..." + (MARK if marked else "\n")
    head = F.concat(F.lit("<first_few_messages>\n"), F.array_join(opening, gap), F.lit(f"\n</first_few_messages>\n{turn}"))
    chunk = F.concat(F.lit("<transcript_chunk>\n"), body, F.lit("\n</transcript_chunk>"))
    return F.concat(F.when(F.size(opening) > 0, head).otherwise(""), chunk)


def _kind() -> str:
    return "array<struct<role:string,name:string,content:string,function_call:struct<name:string,arguments:string>>>"


def with_ends(df: DataFrame, marked: str, length: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Adds ``ends``: where each piece of the marked text ends (exclusive), in order."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and under the limit")
    cut = F.regexp_extract_all(F.col(marked), F.lit(boundary_pattern(limit, overlap)), F.lit(0))
    ends = F.aggregate(
        F.transform(cut, lambda piece: F.length(piece)),
        F.array().cast("array<int>"),
        lambda done, n: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + n)),
    )
    return df.withColumn("ends", F.when(F.col(length) <= limit, F.array(F.col(length))).otherwise(ends))


def split_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per input row: ``run_id, chunk_index, n_characters, n_pieces, pieces``.

    ``pieces`` holds ``piece_index, start, end`` and ``text`` of each piece, in order. A chunk
    within the limit is one piece. Pieces have at most ``limit`` code points; each but the
    first begins ``overlap`` characters before the end of the one before it. Repeated input
    rows give repeated output rows; NULL keys, NULL or empty arrays, null contents
    and null messages are allowed (a chunk without messages is its bare frame).
    Other columns of the input are not looked at.
    """
    text = chunks.select(
        "run_id",
        "chunk_index",
        render_chunk(F.col("messages"), F.col("context")).alias("text"),
        render_chunk(F.col("messages"), F.col("context"), marked=True).alias("marked"),
    ).withColumn("n_characters", F.length("text"))
    # a column of its own: the lambda below looks ends up once per piece, the text is cut once
    text = with_ends(text, "marked", "n_characters", limit, overlap)
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.get("ends", i - 1) - overlap))
    pieces = F.transform(
        F.col("ends"),
        lambda end, i: F.struct(
            i.alias("piece_index"),
            start(i).alias("start"),
            end.alias("end"),
            F.substring(F.col("text"), start(i) + 1, end - start(i)).alias("text"),
        ),
    )
    return text.select("run_id", "chunk_index", "n_characters", F.size("ends").alias("n_pieces"), pieces.alias("pieces"))


def oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Once each chunk that had to be cut: ``run_id, chunk_index``."""
    cut = split_chunks(chunks, limit, overlap).where(F.col("n_pieces") > 1)
    return cut.select("run_id", "chunk_index").distinct()


def pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every oversized chunk, a repeated chunk once.

    ``run_id, chunk_index, piece_index, start, end, n_characters, text``.
    """
    # conditions on the pieces themselves would be pushed down and cut the text once per piece again
    rows = split_chunks(chunks, limit, overlap).where(F.col("n_characters") > limit)
    one = rows.select("run_id", "chunk_index", F.explode_outer("pieces").alias("p"))
    return one.select(
        "run_id",
        "chunk_index",
        F.col("p.piece_index"),
        F.col("p.start"),
        F.col("p.end"),
        F.length("p.text").alias("n_characters"),
        F.col("p.text"),
    ).dropDuplicates(["run_id", "chunk_index", "piece_index", "start", "end", "text"])


def piece_checks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Once per oversized chunk ``run_id, chunk_index, n_characters`` and what must hold of its pieces.

    ``covered``: they begin at 0 and end with the chunk. ``shared``: each next one begins ``overlap`` before the end
    of the one before, and ends after it. ``within``: all are at most ``limit`` long. ``own_text``: each is what stands between its ends.
    """
    rows = split_chunks(chunks, limit, overlap).where(F.col("n_characters") > limit)
    p = F.col("pieces")
    last = F.get("pieces", F.size(p) - 1)
    follows = F.forall(
        F.sequence(F.lit(1), F.size(p) - 1),
        lambda i: (F.get("pieces", i)["start"] == F.get("pieces", i - 1)["end"] - overlap) & (F.get("pieces", i)["end"] > F.get("pieces", i - 1)["end"]),
    )
    # overlaps taken out, the pieces are the chunk again
    whole = F.array_join(F.transform(p, lambda x, i: F.when(i == 0, x["text"]).otherwise(F.substring(x["text"], F.lit(overlap + 1), F.length(x["text"])))), "")
    told = rows.select(
        "run_id", "chunk_index", "n_characters",
        ((F.get("pieces", F.lit(0))["start"] == 0) & (last["end"] == F.col("n_characters"))).alias("covered"),
        follows.alias("shared"),
        F.forall(p, lambda x: (F.length(x["text"]) <= limit) & (F.length(x["text"]) == x["end"] - x["start"])).alias("within"),
        F.md5(whole).alias("digest"),
    )
    text = chunks.select("run_id", "chunk_index", F.md5(render_chunk(F.col("messages"), F.col("context"))).alias("digest")).distinct()
    own = text.withColumn("own_text", F.lit(True))
    keys = ["run_id", "chunk_index", "digest"]
    out = told.distinct().join(own, [F.equal_null(told[k], own[k]) for k in keys], "left")
    return out.select(*(told[c] for c in ("run_id", "chunk_index", "n_characters", "covered", "shared", "within")), F.coalesce("own_text", F.lit(False)).alias("own_text")).distinct()
