"""Evaluators by name: each takes (pair_id, reference, candidate, context, ...) rows and gives (pair_id, skipped, quality_score, note) for all of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.functions.text import strip, text_of

from . import evaluation

DEFAULT = "composite"
_EVALUATORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_evaluator(name: str, evaluate: Callable[[DataFrame], DataFrame]) -> None:
    """Add an evaluator, or replace the one of that name."""
    _EVALUATORS[name] = evaluate


def evaluator_names() -> list[str]:
    return sorted(_EVALUATORS)


def evaluator(name: str | None = None) -> Callable[[DataFrame], DataFrame]:
    found = _EVALUATORS.get((name or DEFAULT).strip())
    if found is None:
        raise KeyError(f"no evaluator {name!r}; there are {', '.join(evaluator_names())}")
    return found


def evaluate(pairs: DataFrame, *names: str) -> DataFrame:
    """(evaluator, pair_id, skipped, quality_score, note): the pairs scored by each named evaluator, the default one without names."""
    out = None
    for name in names or (DEFAULT,):
        rows = evaluator(name)(pairs).select(F.lit(name).alias("evaluator"), "pair_id", "skipped", F.col("quality_score").cast("double").alias("quality_score"), "note")
        out = rows if out is None else out.unionByName(rows)
    return out


def compare_evaluators(scores: DataFrame) -> DataFrame:
    """Scores of evaluate() -> for each two evaluators the pairs that both scored, and the mean difference of the second from the first."""
    s = scores.filter(~F.col("skipped")).select("evaluator", "pair_id", "quality_score")
    a, b = s.withColumnsRenamed({"evaluator": "first", "quality_score": "x"}), s.withColumnsRenamed({"evaluator": "second", "quality_score": "y"})
    return a.join(b, "pair_id").filter("first < second").groupBy("first", "second").agg(F.count("*").alias("pairs"), F.avg(F.col("y") - F.col("x")).alias("mean_difference"))


def lexical(pairs: DataFrame) -> DataFrame:
    """Token F1 of candidate and reference; skipped without a reference."""
    skipped = strip(text_of("reference")) == ""
    s = evaluation.lexical_scores(pairs, "reference", "candidate")
    return s.select("pair_id", skipped.alias("skipped"), F.when(~skipped, F.col("token_f1")).alias("quality_score"), F.lit("token f1").alias("note"))


def labelled(pairs: DataFrame) -> DataFrame:
    """Human labels that the pairs carry (quality 0 or 1); skipped where there is none."""
    return pairs.select("pair_id", F.col("quality").isNull().alias("skipped"), (100.0 * F.col("quality")).alias("quality_score"), F.lit("label").alias("note"))


register_evaluator(DEFAULT, evaluation.composite)
register_evaluator("lexical", lexical)
register_evaluator("labelled", labelled)
