"""Scorers as functions: a column function, or a batch function over the question rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepline.functions import prob

ColumnScorer = Callable[[], Column]
BatchScorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def pointer_scorer() -> Column:
    """Scaled dot product of a question vector ``q`` and an option vector ``o``."""
    return prob.dot_score("q", "o")


def answers_from_logits(scored: DataFrame, question: str, option: str) -> DataFrame:
    """Options with a logit each → one answer per question; the group is one question's options."""
    per = scored.groupBy(question).agg(F.array_sort(F.collect_list(F.struct(F.col(option).alias("key"), F.col("logit").alias("z")))).alias("_o"))
    per = per.select(question, F.transform("_o", lambda x: x["key"]).alias("keys"), prob.softmax(F.transform("_o", lambda x: x["z"])).alias("p"))
    return per.select(
        question,
        F.element_at("keys", prob.argmax_first("p") + 1).alias("choice"),
        F.round(prob.choice_confidence("p"), 4).alias("confidence"),
        F.transform("p", lambda x: F.round(x, 4)).alias("probabilities"),
    )


def score_with(options: DataFrame, scorer: ColumnScorer, question: str, option: str) -> DataFrame:
    """Answers of a column scorer."""
    return answers_from_logits(options.withColumn("logit", scorer()), question, option)


def score_with_batches(options: DataFrame, scorer: BatchScorer, question: str, option: str) -> DataFrame:
    """Answers of a batch scorer: it gets the option rows in Arrow batches and adds ``logit``."""
    schema = f"{options._jdf.schema().toDDL()}, logit double"
    return answers_from_logits(options.mapInPandas(scorer, schema), question, option)


def recorded(questions: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Questions with precomputed answers; a question without one keeps a null answer."""
    return questions.join(answers, keys, "left")
