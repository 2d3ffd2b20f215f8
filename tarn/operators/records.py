"""Record building: messages of conversations, prompt variants, keyword exclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_exchange(messages: DataFrame, key: str, order: str, role: str, text: str, marks: tuple[str, ...] = ("<video>", "<image>")) -> DataFrame:
    """Per conversation the first user's and the first assistant's message, media marks cut out and ends trimmed: key, question, answer.

    A side without a message is null. One aggregation with partial sums, no window.
    """
    first = lambda who: F.min_by(F.when(F.col(role) == who, F.col(text)), F.when(F.col(role) == who, F.col(order)))
    out = messages.groupBy(key).agg(first("user").alias("question"), first("assistant").alias("answer"))
    for side in ("question", "answer"):
        c = F.col(side)
        for mark in marks:
            c = F.replace(c, F.lit(mark), F.lit(""))
        out = out.withColumn(side, F.trim(c))
    return out


def prompt_variants(rows: DataFrame, choices: str, templates: dict[str, str]) -> DataFrame:
    """Each row under every template and both orders of its choices: adds template, option_order, option_permutation and shown.

    Templates are a small, configured mapping of name to text, in which {choices} stands for the lettered lines.
    """
    from ..functions import text

    n = F.size(choices)
    forward = F.sequence(F.lit(0), n - 1)
    orders = F.array(*(F.struct(F.lit(name).alias("name"), order.alias("places")) for name, order in (("original", forward), ("reversed", F.reverse(forward)))))
    named = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(v).alias("text")) for k, v in templates.items()))
    out = rows.where(n > 0).withColumn("__t", F.explode(named)).withColumn("__o", F.explode(orders))
    shown = F.replace(F.col("__t.text"), F.lit("{choices}"), text.format_choices(text.permuted(F.col(choices), F.col("__o.places"))))
    return out.select(*rows.columns, F.col("__t.name").alias("template"), F.col("__o.name").alias("option_order"), F.col("__o.places").alias("option_permutation"), shown.alias("shown"))


def named_in(keywords: list[str], *columns: Column) -> Column:
    """Whether any of the columns holds any keyword, whatever the case; nulls hold none."""
    found = F.lit(False)
    for c in columns:
        for k in keywords:
            found = found | F.coalesce(F.contains(F.lower(c), F.lit(k.lower())), F.lit(False))
    return found
