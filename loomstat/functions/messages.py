"""Shaping and rendering of messages.

A message is a struct or a row with ``role, name, content`` and
``function_call<name, arguments>``. A call that is null or has an empty name is no
call; null content is empty; a null or empty role reads ``unknown``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstat.functions.text import strip

#: Between the messages of a whole transcript.
TRANSCRIPT_SEPARATOR = "\n\n---\n\n"
#: Between the messages of a prompt block.
BLOCK_SEPARATOR = "\n\n"


def has_call(call: Column) -> Column:
    return F.coalesce(call["name"] != "", F.lit(False))


def clean_role(role: Column) -> Column:
    return F.coalesce(F.when(role != "", role), F.lit("unknown"))


def render(role: Column, name: Column, content: Column, call: Column) -> Column:
    """``[role] (name)``, the content, and a call as ``tool_call: name(arguments)``."""
    header = F.concat(
        F.lit("["),
        clean_role(role),
        F.lit("]"),
        F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit(" ("), name, F.lit(")"))).otherwise(""),
    )
    body = F.coalesce(content, F.lit(""))
    told = F.concat(
        body, F.lit("\ntool_call: "), call["name"], F.lit("("), F.coalesce(call["arguments"], F.lit("")), F.lit(")")
    )
    return strip(F.concat(header, F.lit("\n"), F.when(has_call(call), strip(told)).otherwise(body)))


def render_message(message: Column) -> Column:
    return render(message["role"], message["name"], message["content"], message["function_call"])


def prompt_layout(head: Column, body: Column) -> Column:
    """The prompt of one excerpt; ``head`` (rendered opening messages) is left out where it is NULL."""
    chunk = F.concat(F.lit("<transcript_chunk>\n"), body, F.lit("\n</transcript_chunk>"))
    opening = F.concat(F.lit("<first_few_messages>\n"), head, F.lit("\n</first_few_messages>\n...\n"))
    return F.concat(F.coalesce(opening, F.lit("")), chunk)
