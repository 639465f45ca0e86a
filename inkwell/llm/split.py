"""Problem 5: cutting oversized texts at natural boundaries.

Each text is parsed once into a tree: sections under their headings, inside them paragraphs, lists and fenced
code, inside those list items, sentences, lines and words.  A subtree that fits is never opened.  The parts of one that
doesn't fit are merged with their whole siblings, bottom-up, as far as the limit allows; a piece reaches over a heading
only if it holds whole sections, and a heading goes with the first piece of its text where both fit.  Only a
stretch without any boundary that is longer than the room is cut between two characters.

Every piece but the first begins with the last ``overlap_chars`` characters of the piece before it, so
new text has ``max_chars - overlap_chars`` characters of room.  Without those repeated characters the
pieces give the text back, character by character.

Defined results: null texts, texts of a type without a limit, and texts within the limit give no rows;
an overlap of at least the limit is lowered to the limit less one; repeated keys count once; the columns of the
input other than the named ones are not read.
"""

from __future__ import annotations

import re
from pathlib import Path
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.sentences import unit_ends
from inkwell.llm.tokens import token_count, vocabulary_file

STRETCH_END = " \n　。！？.!?"
_STRETCH = re.compile(f"[^{re.escape(STRETCH_END)}]+")
_WORD_END = re.compile(f"[{re.escape(STRETCH_END)}]+")
_HEADING = re.compile(r"(#{1,6})[ \t]+\S")
_FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})")
_ITEM = re.compile(r"([ \t　]*)(?:[-*+•・‣◦][ 　]|[(（]?[0-9０-９]{1,3}[.．)）][ 　])")
_LINE = re.compile(r"[^\n]*\n|[^\n]+")


class Node(NamedTuple):
    """A subtree; ``kind`` is section, heading, list, item, fence or paragraph, ``parts`` its children so far as they are parsed."""

    kind: str
    start: int
    end: int
    parts: list[Node]


def blocks(text: str, start: int, end: int) -> list[tuple[str, int, int, int]]:
    """(kind, level, start, end) of headings, lists, fences and paragraphs; blank lines belong to what precedes them."""
    found: list[list] = []
    fence, blank = "", True
    for m in _LINE.finditer(text, start, end):
        line, at, stop = m.group(), m.start(), m.end()
        mark = _FENCE.match(line)
        if fence:
            found[-1][3] = stop
            if mark and mark.group(1).startswith(fence) and not line[mark.end() :].strip():
                fence, blank = "", True
            continue
        heading = _HEADING.match(line)
        if not line.strip():
            if found:
                found[-1][3] = stop
            else:
                found.append(["paragraph", 0, at, stop])
            blank = True
            continue
        if mark:
            fence = mark.group(1)
            found.append(["fence", 0, at, stop])
        elif heading:
            found.append(["heading", len(heading.group(1)), at, stop])
            blank = True
            continue
        elif _ITEM.match(line):
            if found and found[-1][0] == "list":
                found[-1][3] = stop
            else:
                found.append(["list", 0, at, stop])
        elif found and not blank and found[-1][0] in ("paragraph", "list"):
            found[-1][3] = stop
        elif found and found[-1][0] == "list" and line[0] in " \t　":
            found[-1][3] = stop
        else:
            found.append(["paragraph", 0, at, stop])
        blank = False
    return [tuple(b) for b in found]


def tree(text: str) -> Node:
    """The text as sections within sections, each with its heading and blocks."""
    root = Node("section", 0, len(text), [])
    open_: list[tuple[int, list]] = [(0, ["section", 0, len(text), root.parts])]
    for kind, level, start, end in blocks(text, 0, len(text)):
        if kind == "heading":
            while open_[-1][0] >= level:
                _shut(open_, start)
            open_.append((level, ["section", start, end, []]))
        open_[-1][1][3].append(Node(kind, start, end, []))
    while len(open_) > 1:
        _shut(open_, len(text))
    return root


def _shut(open_: list[tuple[int, list]], end: int) -> None:
    kind, start, _, parts = open_.pop()[1]
    open_[-1][1][3].append(Node(kind, start, end, parts))


def _items(text: str, node: Node) -> list[Node]:
    """The items of a list, or those inside an item: the outermost ones, with what is indented below them."""
    marks = [(m.start(), len(i.group(1))) for m in _LINE.finditer(text, node.start, node.end) if (i := _ITEM.match(m.group()))]
    marks = [(at, depth) for at, depth in marks if node.kind == "list" or at > node.start]
    if not marks:
        return []
    least = min(depth for _, depth in marks)
    edges = [node.start, *(at for at, depth in marks if depth == least and at > node.start), node.end]
    return [Node("item", a, b, []) for a, b in zip(edges, edges[1:])]


def _opened(text: str, node: Node) -> list[Node]:
    """The children of a node; [] if it is one word."""
    if node.parts:
        return node.parts
    start, end = node.start, node.end
    if node.kind in ("list", "item"):
        inner = _items(text, node)
        if len(inner) > 1:
            return inner
    cuts = {
        "fence": lambda: [m.end() for m in _LINE.finditer(text, start, end)],
        "sentence": lambda: [m.end() for m in _LINE.finditer(text, start, end)],
        "line": lambda: [m.end() for m in _WORD_END.finditer(text, start, end)],
        "word": lambda: [],
    }.get(node.kind, lambda: [start + e for e in unit_ends(text[start:end])])()
    below = {"fence": "line", "sentence": "line", "line": "word", "word": "word"}.get(node.kind, "sentence")
    edges = [start, *(c for c in cuts if start < c < end), end]
    if len(edges) == 2:
        return [] if node.kind in ("word", "line") else [Node(below, start, end, [])]
    return [Node(below, a, b, []) for a, b in zip(edges, edges[1:])]


class Piece(NamedTuple):
    start: int
    end: int
    inside: bool = False  # ends inside a stretch
    whole: bool = True  # holds whole parts of one section
    lead: bool = False  # headings alone


def _pack(text: str, node: Node, room: int, stretches: list[int]) -> list[Piece]:
    """Pieces of at most ``room`` characters that cover a node; the longest stretch of each opened block goes to ``stretches``."""
    if node.end - node.start <= room:
        return [Piece(node.start, node.end, lead=node.kind == "heading")]
    if node.kind in ("heading", "list", "fence", "paragraph"):  # blocks end at line breaks, so stretches lie inside them
        stretches.append(max((m.end() - m.start() for m in _STRETCH.finditer(text, node.start, node.end)), default=0))
    parts = _opened(text, node)
    if not parts:
        return [Piece(at, min(at + room, node.end), at + room < node.end, False) for at in range(node.start, node.end, room)]
    packed: list[Piece] = []
    for part in parts:
        section, fits = part.kind == "section", part.end - part.start <= room
        for number, piece in enumerate([Piece(part.start, part.end, lead=part.kind == "heading")] if fits else _pack(text, part, room, stretches)):
            last = packed[-1] if packed else None
            joins = last is not None and not last.inside and piece.end - last.start <= room and (last.whole or not section) and (fits or not section or last.lead and not number)
            if joins:
                packed[-1] = Piece(last.start, piece.end, piece.inside, last.whole and piece.whole and fits, last.lead and piece.lead)
            else:
                packed.append(piece._replace(whole=piece.whole and fits))
    return packed


def cut(text: str, max_chars: int, overlap_chars: int) -> tuple[list[int], list[bool], bool]:
    """Ends of the pieces, whether each is cut inside a stretch, and whether a stretch exceeds max_chars."""
    stretches: list[int] = []
    packed = _pack(text, tree(text), max(1, max_chars - overlap_chars), stretches)
    return [p.end for p in packed], [p.inside for p in packed], max(stretches, default=0) > max_chars


_PLAN = T.StructType().add("ends", T.ArrayType(T.IntegerType())).add("inside", T.ArrayType(T.BooleanType())).add("unbroken", T.BooleanType())


@F.pandas_udf(_PLAN)
def _cut_udf(texts: pd.Series, limits: pd.Series, overlaps: pd.Series) -> pd.DataFrame:
    rows = [cut(*row) for row in zip(texts, limits, overlaps)]
    return pd.DataFrame({"ends": [r[0] for r in rows], "inside": [r[1] for r in rows], "unbroken": [r[2] for r in rows]})


def _over(df: DataFrame, keys: list[str], text: str, file_type: str, limits: DataFrame) -> DataFrame:
    """The texts above their limit: keys, text, max_chars, overlap_chars; the length decides in the JVM what Python must see.

    ``limits`` holds one row per file type, so it is as small as the list of types and is broadcast.
    """
    bounds = limits.select(F.col("file_type").alias("_type"), "max_chars", F.least("overlap_chars", F.col("max_chars") - 1).alias("overlap_chars"))
    rows = df.select(*keys, F.col(text).alias("text"), F.col(file_type).alias("_type"))
    return rows.join(F.broadcast(bounds), "_type").where(F.length("text") > F.col("max_chars")).drop("_type")


def oversized(df: DataFrame, keys: list[str], text: str, file_type: str, limits: DataFrame) -> DataFrame:
    """(keys, pieces, cut) of each text that the tree divides: how many pieces, and 'forced' if a stretch without a boundary is itself above the limit, else 'natural'.

    Repeated keys are dropped after the cut, so that contents are never shuffled.
    """
    plan = _over(df, keys, text, file_type, limits).withColumn("plan", _cut_udf("text", "max_chars", "overlap_chars"))
    kind = F.when(F.col("plan.unbroken"), "forced").otherwise("natural")
    cut_ = plan.select(*keys, F.size("plan.ends").alias("pieces"), kind.alias("cut")).groupBy(*keys).agg(F.max("pieces").alias("pieces"), F.min("cut").alias("cut"))
    return cut_.where(F.col("pieces") > 1)


def pieces(df: DataFrame, keys: list[str], text: str, file_type: str, limits: DataFrame, tokenizer: str | Path) -> DataFrame:
    """One row per piece of each text above its limit: keys, piece, start_pos, end_pos, forced and a right chunk_info.

    The pieces are cut where their ends are found, so a text goes to Python once and comes back once.
    """
    name = vocabulary_file(df.sparkSession, tokenizer)

    @F.pandas_udf("array<struct<piece: string, start_pos: int, end_pos: int, forced: boolean, chunk_tokens: int>>")
    def cut_out(texts: pd.Series, limit: pd.Series, overlaps: pd.Series) -> pd.Series:
        def one(content: str, most: int, overlap: int) -> list[dict]:
            ends, inside, _ = cut(content, most, overlap)
            starts = [0, *(max(0, e - overlap) for e in ends)]
            return [
                {"piece": content[s:e], "start_pos": s, "end_pos": e, "forced": f, "chunk_tokens": token_count(content[s:e], name)}
                for s, e, f in zip(starts, ends, inside)
            ]

        return pd.Series([one(*row) for row in zip(texts, limit, overlaps)], dtype=object)

    once = _over(df, keys, text, file_type, limits).dropDuplicates(keys)
    cut_ = once.select(*keys, cut_out("text", "max_chars", "overlap_chars").alias("_cut"))
    one = cut_.select(*keys, F.size("_cut").alias("_total"), F.posexplode("_cut").alias("_index", "_piece"))
    info = F.struct(
        F.col("_index").cast("int").alias("chunk_index"), F.col("_total").alias("total_chunks"),
        F.length("_piece.piece").alias("chunk_size"), F.col("_piece.chunk_tokens").alias("chunk_tokens"),
    )
    return one.select(*keys, "_piece.piece", "_piece.start_pos", "_piece.end_pos", "_piece.forced", info.alias("chunk_info"))
