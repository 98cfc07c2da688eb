"""Structured replies of a model, as text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANALYSIS = "findings array<struct<id:string,type:string,claim:string,evidence:struct<page:int,quote:string,section:string>,explanation:string>>"
ANSWER = "answer string, not_found boolean, evidence array<struct<page:int,quote:string,section:string>>"


#: A string with its escapes (an open one runs to the end), a brace, or a run of anything else: the pieces of a text, without a gap.
_PIECE = r'(?s)"(?:[^"\\]|\\.)*"?|[{}]|[^"{}]+'


def balanced(text: Column) -> Column:
    """What stands from the text's first character, an opening brace, to the brace that closes it; braces in strings do not count. Null if it stays open.

    Folded over strings and braces, not over characters.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, piece: Column) -> Column:
        depth = F.when(piece == "{", s["depth"] + 1).when(piece == "}", s["depth"] - 1).otherwise(s["depth"])
        at = s["at"] + F.length(piece)
        closed = (s["end"] == 0) & (piece == "}") & (depth == 0)
        return F.struct(depth.alias("depth"), at.alias("at"), F.when(closed, at).otherwise(s["end"]).alias("end"))

    end = F.aggregate(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), start, step, lambda s: s["end"])
    return F.when(end > 0, F.substring(text, F.lit(1), end))


def json_text(reply: Column) -> Column:
    """The JSON object of a reply; null without one.

    Thoughts are dropped, closed ones first; then what a fence holds stands for the whole. The
    object begins at the first brace before a name or a closing brace and ends where it closes.
    """
    bare = F.regexp_replace(F.coalesce(reply, F.lit("")), r"(?is)<think>.*?</think>", "")
    bare = F.regexp_replace(bare, r"(?is)<think>.*$", "")
    fence = r"(?s)```(?:json)?\s*(.*?)```"
    inner = F.when(bare.rlike(fence), F.regexp_extract(bare, fence, 1)).otherwise(bare)
    return balanced(F.regexp_extract(inner, r"(?s)\{(?=\s*[\"}]).*$", 0))


def parsed(reply: Column, schema: str) -> Column:
    """The reply's object by schema; unknown fields go, a reply that does not parse is null."""
    found = F.from_json(json_text(reply), f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    return F.when(found["__bad"].isNull(), found.dropFields("__bad"))
