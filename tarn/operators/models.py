"""The boundary to models: encoders and scorers are callables that a worker makes once and that see Arrow batches.

What goes in and out are plain rows, so any model fits; the engine keeps views distinct, partitions work by content,
resumes a run and derives every reported score from likelihoods alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import digests as D
from .frames import distinct_views
from .preparation import canonical_scores

#: make() -> encode(frame of views) -> list of token arrays, one a row.
Encode = Callable[[pd.DataFrame], list]
#: make() -> score(frame of trials) -> list of {label: negative log-likelihood}, one a row.
Score = Callable[[pd.DataFrame], list]
IGNORED = -100  # label of places that the loss does not count


def encoded(views: DataFrame, make: Callable[[], Encode], key: str = "visual_id", tasks: int | None = None) -> DataFrame:
    """key, tokens (array<array<float>>), digest: every different view is encoded once, however many trials show it."""
    rows = distinct_views(views, key)
    rows = rows.repartition(tasks, key) if tasks else rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for b in batches:
            yield pd.DataFrame({key: b[key], "tokens": encode(b)})

    out = rows.mapInPandas(run, f"`{key}` {dict(rows.dtypes)[key]}, tokens array<array<float>>")
    return out.withColumn("digest", F.sha2(F.to_json("tokens"), 256))


def joined_features(trials: DataFrame, features: DataFrame, key: str = "visual_id") -> tuple[DataFrame, DataFrame]:
    """(trials with the tokens of their view, views without features): trials without pixels keep null tokens."""
    known = features.select(F.col(key).alias("__k"), "tokens")
    lost = trials.where(F.col(key).isNotNull()).select(key).distinct().join(known, F.col(key) == F.col("__k"), "left_anti")
    return trials.join(known, F.col(key) == F.col("__k"), "left").drop("__k"), lost


def feature_size(features: DataFrame) -> int | None:
    """Dimensions of the tokens, from one row; null without rows."""
    row = features.select(F.size(F.get("tokens", 0)).alias("n")).first()
    return row.n if row else None


def scored(trials: DataFrame, make: Callable[[], Score], workers: int = 1, worker: int | None = None) -> DataFrame:
    """trials with choice_nll and everything that follows from it. With `worker`, only the trials that its number owns.

    Needs trial_id, trial_content_sha256, choices, answer and what the scorer reads.
    """
    rows = trials if worker is None else trials.where(D.worker(F.col("trial_content_sha256"), workers) == worker)
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make()
        for b in batches:
            yield pd.DataFrame({"trial_id": b["trial_id"], "choice_nll": score(b)})

    nll = rows.mapInPandas(run, "trial_id string, choice_nll map<string,double>")
    out = rows.join(nll, "trial_id").withColumn("__s", canonical_scores(F.col("choices"), F.col("choice_nll"), F.col("answer")))
    derived = {"choice_probability": "probability", "prediction": "prediction", "prediction_text": "prediction_text", "correct": "correct", "gold_nll": "gold_nll", "best_distractor_nll": "best_distractor_nll", "gold_margin": "gold_margin"}
    return out.withColumns({k: F.col(f"__s.{v}") for k, v in derived.items()}).select(*[n for n in names if n not in derived], "choice_nll", *derived)


def option_nll(losses: Column, counted: Column) -> Column:
    """The likelihood of an answer: mean loss times counted tokens."""
    return losses * counted


def padded(tokens: Column, size: int, fill: float = 0.0) -> Column:
    """struct(tokens, mask): an array of vectors cut or filled with `fill` vectors to `size`, and which of them are real."""
    width = F.coalesce(F.size(F.get(tokens, 0)), F.lit(0))
    n = F.least(F.size(tokens), F.lit(size))
    whole = F.concat(F.slice(tokens, 1, size), F.array_repeat(F.array_repeat(F.lit(float(fill)).cast("float"), width), F.lit(size) - n))
    return F.struct(whole.alias("tokens"), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i < n).cast("int")).alias("mask"))


def training_places(prefix: Column, visual: Column, suffix: Column, answer: Column, most: int) -> Column:
    """struct(ids, labels, attention): prefix, places for pixels (id -1), suffix and answer in one row; only the answer
    counts in the loss. Pixels give way first (one stays), then the beginning: the last `most` places are kept."""
    said = F.size(prefix) + F.size(suffix) + F.size(answer)
    shown = F.least(visual, F.greatest(F.lit(most) - said, F.lit(1)))
    ids = F.concat(prefix, F.array_repeat(F.lit(-1), shown), suffix, answer)
    labels = F.concat(F.array_repeat(F.lit(IGNORED), F.size(prefix) + shown + F.size(suffix)), answer)
    cut = lambda a: F.slice(a, F.greatest(F.size(a) - F.lit(most), F.lit(0)) + 1, F.lit(most))
    return F.struct(cut(ids).alias("ids"), cut(labels).alias("labels"), F.transform(cut(ids), lambda _: F.lit(1)).alias("attention"))


def projected(tokens: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """Each vector through one linear layer: a small, given matrix (rows are inputs)."""
    columns = [F.array(*(F.lit(float(w[j])) for w in weights)) for j in range(len(bias))]
    return F.transform(tokens, lambda t: F.array(*(F.aggregate(F.zip_with(t, columns[j], lambda x, w: x.cast("double") * w), F.lit(float(bias[j])), lambda s, x: s + x) for j in range(len(bias)))))


def gelu(tokens: Column) -> Column:
    """The tanh form, element by element."""
    return F.transform(tokens, lambda t: F.transform(t, lambda x: 0.5 * x * (1 + F.tanh(0.7978845608028654 * (x + 0.044715 * x * x * x)))))


def perturbation_rows(predictions: DataFrame, key: str = "id") -> DataFrame:
    """One row an item from its predictions under the modes original, reverse and shuffle (id, mode, prediction, correct): flags of what order does."""
    at = lambda m, c: F.max(F.when(F.col("mode") == m, F.col(c)))
    modes = ("original", "reverse", "shuffle")
    wide = predictions.groupBy(key).agg(*(at(m, "correct").alias(m) for m in modes), *(at(m, "prediction").alias(f"p_{m}") for m in modes))
    o, r, s = (F.coalesce(F.col(m), F.lit(False)) for m in modes)
    return wide.select(
        key, o.alias("original_correct"), r.alias("reverse_correct"), s.alias("shuffle_correct"), (o & r & s).alias("robust"), (o & (~r | ~s)).alias("temporal_sensitive"), (~o & (r | s)).alias("helped"),
        (~F.col("p_original").eqNullSafe(F.col("p_reverse"))).alias("reverse_changed"), (~F.col("p_original").eqNullSafe(F.col("p_shuffle"))).alias("shuffle_changed"),
    )
