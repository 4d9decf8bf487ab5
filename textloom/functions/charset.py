"""Character profiles: what counts as a character of the text, where sentences end, which words to count."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Charset:
    """letter: a regular expression class; ends: sentence ends; clauses: clause ends; tokens: words to count."""

    letter: str
    ends: str
    clauses: str
    tokens: tuple[str, ...]
    quotes: tuple[str, str]


#: The class that holds every character.
EVERY = r"\s\S"
HAN = Charset(
    letter=r"\p{IsHan}",
    ends=r"[。！？…]+",
    clauses=r"[，。；：！？、…]+",
    # Common function words of vernacular Chinese prose.
    tokens=("的", "了", "着", "过", "也", "又", "还", "便", "就", "才", "只", "但", "却", "不", "无", "若", "把", "将", "被"),
    quotes=("“", "”"),
)
LETTERS = Charset(letter=r"\p{L}", ends=r"[.!?\n]+", clauses=r"[,.;:!?\n]+", tokens=("the", "and", "of", "de", "la", "und"), quotes=("(", ")"))


def only_letters(text: Column | str, charset: Charset = LETTERS) -> Column:
    """The characters of the profile alone; null as empty."""
    column = F.col(text) if isinstance(text, str) else text
    if charset.letter == EVERY:
        return F.coalesce(column, F.lit(""))
    return F.regexp_replace(F.coalesce(column, F.lit("")), f"[^{charset.letter}]+", "")
