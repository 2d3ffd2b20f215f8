"""Registered queries of record building: conversations, prompt variants, exclusions, text forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import records as C
from .queries import _query, _table


@_query("first_exchange", """WITH f AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS q, arg_min(text, turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY 1)
SELECT conv_id, trim(replace(replace(q, '<video>', ''), '<image>', '')) AS question, trim(replace(replace(a, '<video>', ''), '<image>', '')) AS answer FROM f""")
def first_exchange(spark, d):
    return C.first_exchange(_table(spark, d, "conversations"), "conv_id", "turn", "role", "text")


_TEMPLATES = {"plain": "{choices}", "which": "Which one?\n{choices}", "answer": "{choices}\nAnswer:"}


@_query("prompt_variants", """WITH c AS (SELECT p_partkey, [p_name, p_brand] AS c FROM part), t(template, head, tail) AS (VALUES ('plain', '', ''), ('which', 'Which one?' || chr(10), ''), ('answer', '', chr(10) || 'Answer:'))
SELECT p_partkey, template, option_order, head || 'A. ' || c[k] || chr(10) || 'B. ' || c[3 - k] || tail AS shown FROM c, t, (VALUES ('original', 1), ('reversed', 2)) o(option_order, k)""")
def prompt_variants(spark, d):
    rows = _table(spark, d, "part").select("p_partkey", F.array("p_name", "p_brand").alias("choices"))
    return C.prompt_variants(rows, "choices", _TEMPLATES).select("p_partkey", "template", "option_order", "shown")


@_query("keyword_exclusion", "SELECT p_partkey, p_type FROM part WHERE NOT (contains(lower(p_type), 'steel') OR contains(lower(p_brand), '#1'))")
def keyword_exclusion(spark, d):
    return _table(spark, d, "part").where(~C.named_in(["STEEL", "#1"], F.col("p_type"), F.col("p_brand"))).select("p_partkey", "p_type")


@_query("semantic_forms", "SELECT p_partkey, lower(trim(p_type)) AS form FROM part")
def semantic_forms(spark, d):
    return _table(spark, d, "part").select("p_partkey", text.semantic_text(F.concat(F.lit("  "), F.upper("p_type"), F.lit(" "))).alias("form"))


@_query("time_texts", "SELECT o_orderkey, rtrim(rtrim(printf('%.3f', o_totalprice), '0'), '.') AS at FROM orders")
def time_texts(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", text.time_text(F.col("o_totalprice")).alias("at"))
