"""Small tables for the operators' tests."""

import random

EDGES = [
    (1, "plain words in a short text", "x"),
    (2, None, "x"),
    (3, "", "x"),
    (None, "a row without an id", None),
    (5, "plain words in a short text", "y"),
    (5, "plain words in a short text", "y"),  # a repeated row
    (6, "   \n\t ", "z"),
    (7, "naïve Größe 漢字 😀 ʼn   ß", "z"),
    (8, "long " * 20000, "z"),
]
#: Further columns whose names the operators use inside.
INSIDE = (
    "score id kind label fp words block found row spans text_key key unnamed name least part places whole at seed first item item_key hit firsts under n "
    "size error media payload blob rules fold y s base extra pattern instance start stop rank body _id _key _spans _t _n _b _w _s bucket ids decoded "
    "packs positions target texts context char docs sizes u v node component uid bands"
).split()
NAMES = "doc_id bigint, text string, " + ", ".join(f"{name} string" for name in INSIDE)


def edge_table(spark):
    rows = [(i, t, s, *(f"{name}'s" for name in INSIDE[1:])) for i, t, s in EDGES]
    return spark.createDataFrame(rows, NAMES)


def empty_table(spark):
    return spark.createDataFrame([], NAMES)


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    draw = random.Random(seed)
    return " ".join("w" + str(draw.randrange(vocabulary)) for _ in range(n))
