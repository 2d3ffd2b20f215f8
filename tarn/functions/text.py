"""Choice labels, answers and prompts as Column expressions. Choices are arrays of strings, labels letters from A."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .fields import folded


def option_label(place: Column) -> Column:
    """The letter of a 0-based place."""
    return F.char(place + 65)


def format_choices(choices: Column) -> Column:
    """One line a choice: letter, full stop, text."""
    return F.array_join(F.transform(choices, lambda c, i: F.concat(option_label(i), F.lit(". "), c)), "\n")


def prompt(question: Column, choices: Column) -> Column:
    return F.concat(question, F.lit("\n"), format_choices(choices), F.lit("\nAnswer:"))


def normalized_answer(answer: Column, choices: Column) -> Column:
    """The letter of an answer given as a letter, alone or in brackets, or as a choice's text; null if none or several fit."""
    said = F.trim(answer)
    letter = F.upper(F.regexp_extract(said, r"^\(?\s*([A-Za-z])\s*\)?[.):]?$", 1))
    place = F.ascii(letter) - 65
    same = F.filter(F.sequence(F.lit(0), F.size(choices) - 1), lambda i: folded(F.get(choices, i)) == folded(said))
    by_text = F.when(F.size(same) == 1, option_label(F.get(same, 0)))
    return F.when((letter != "") & (place < F.size(choices)), letter).otherwise(by_text)


def answer_text(answer: Column, choices: Column) -> Column:
    """The text of the answer's choice."""
    return F.get(choices, F.ascii(normalized_answer(answer, choices)) - 65)


def safe_id(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_")


def sham(c: Column) -> Column:
    """The form of a text without its content: digits become 0, letters x."""
    return F.regexp_replace(F.regexp_replace(c, r"\p{Nd}", "0"), r"\p{L}", "x")


def permuted(choices: Column, order: Column) -> Column:
    """The choices in an order of 0-based places."""
    return F.transform(order, lambda i: F.get(choices, i))


def restored(choices: Column, order: Column) -> Column:
    """Undoes permuted."""
    return F.transform(F.sequence(F.lit(0), F.size(order) - 1), lambda i: F.get(choices, (F.array_position(order, i) - 1).cast("int")))


def percent_text(part: Column, whole: Column) -> Column:
    """A share in percent, one decimal; an empty text for a total of nothing."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, "").otherwise(F.format_string("%.1f%%", 100.0 * part / whole))


@F.pandas_udf(StringType())
def semantic_text(texts: pd.Series) -> pd.Series:
    """Compatibility normal form (NFKC), full case folding, white space collapsed; blank is null. Arrow batches: Spark has neither form."""
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()) or None)


def time_text(seconds: Column) -> Column:
    """Seconds with at most three decimals, without trailing zeros."""
    return F.when(seconds.isNotNull(), F.regexp_replace(F.format_string("%.3f", seconds.cast("double")), r"\.?0+$", ""))
