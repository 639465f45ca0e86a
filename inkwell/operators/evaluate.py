"""Checks of evaluation rows, metrics by a judge, and their means.

A judge is a column function (claim, source) -> how far the source carries the claim, from 0 to 1.  ``overlap`` judges by
terms; every metric takes another one, as a pandas UDF that asks a model.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import strip, terms

TAU = 0.5
#: From which judgement a grade is full or half.
FULL, HALF = 0.8, 0.4
DIGITS = 6


def overlap(claim: Column, source: Column) -> Column:
    """Share of the claim's distinct terms that the source has; null claims and claims without terms give 0."""
    own = F.array_distinct(terms(F.coalesce(claim, F.lit(""))))
    shared = F.size(F.array_intersect(own, F.array_distinct(terms(F.coalesce(source, F.lit(""))))))
    return F.when(F.size(own) > 0, shared / F.size(own)).otherwise(F.lit(0.0))


Judge = Callable[[Column, Column], Column]


def supports(claim: Column, source: Column, judge: Judge = overlap, tau: float = TAU) -> Column:
    return judge(claim, source) >= tau


def grade(claim: Column, source: Column, judge: Judge = overlap) -> Column:
    """0, a half or 1: how far the source carries the claim."""
    share = judge(claim, source)
    return F.when(share >= FULL, 1.0).when(share >= HALF, 0.5).otherwise(0.0)


def statements(text: Column) -> Column:
    """Parts of an answer between terminators, without blanks; none for null."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "([。！？!?])", "$1\n"), "\n")
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def once(rows: DataFrame) -> DataFrame:
    """Each evaluation row once; repeated rows agree in all but their time."""
    return rows.dropDuplicates(["row_id"])


def context_precision(rows: DataFrame, judge: Judge = overlap) -> DataFrame:
    """(row_id, context_precision): mean of precision@i over the contexts that support the reference."""
    verdicts = F.transform(F.coalesce("retrieved_contexts", F.array().cast("array<string>")), lambda c: supports(F.col("reference"), c, judge).cast("int"))
    summed = F.transform(F.col("v"), lambda v, i: v * F.aggregate(F.slice(F.col("v"), 1, i + 1), F.lit(0), lambda a, x: a + x) / (i + 1))
    n = F.aggregate("v", F.lit(0), lambda a, x: a + x)
    score = F.when(F.size("v") == 0, F.lit(None)).when(n > 0, F.aggregate(summed, F.lit(0.0), lambda a, x: a + x) / n).otherwise(0.0)
    return rows.withColumn("v", verdicts).select("row_id", F.round(score, DIGITS).alias("context_precision"))


def share_supported(rows: DataFrame, answer: str, sources: Column, name: str, judge: Judge = overlap) -> DataFrame:
    """(row_id, name): statements of an answer that the joined sources support; null without statements."""
    parts = statements(F.col(answer))
    held = F.filter("p", lambda p: supports(p, F.col("s"), judge))
    return rows.select("row_id", parts.alias("p"), F.coalesce(F.array_join(sources, "\n"), F.lit("")).alias("s")).select(
        "row_id", F.when(F.size("p") > 0, F.round(F.size(held) / F.size("p"), DIGITS)).alias(name)
    )


def context_recall(rows: DataFrame, judge: Judge = overlap) -> DataFrame:
    return share_supported(rows, "reference", F.col("retrieved_contexts"), "context_recall", judge)


def faithfulness(rows: DataFrame, judge: Judge = overlap) -> DataFrame:
    return share_supported(rows, "response", F.col("retrieved_contexts"), "faithfulness", judge)


def _given(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_contexts", F.coalesce(F.array_join("retrieved_contexts", "\n"), F.lit("")))


def context_relevance(rows: DataFrame, judge: Judge = overlap) -> DataFrame:
    """(row_id, context_relevance): grade of the question by its contexts; null without contexts.  Needs no reference."""
    score = F.when(F.size(F.coalesce("retrieved_contexts", F.array().cast("array<string>"))) > 0, grade(F.col("user_input"), F.col("_contexts"), judge))
    return _given(rows).select("row_id", score.alias("context_relevance"))


def answer_accuracy(rows: DataFrame, judge: Judge = overlap) -> DataFrame:
    """(row_id, answer_accuracy): mean of two grades, the answer by the reference and the reference by the answer."""
    both = (grade(F.col("response"), F.col("reference"), judge) + grade(F.col("reference"), F.col("response"), judge)) / 2
    return rows.select("row_id", both.alias("answer_accuracy"))


def groundedness(rows: DataFrame, judge: Judge = overlap) -> DataFrame:
    """(row_id, groundedness): grade of the answer by the contexts; null without an answer."""
    score = F.when(strip(F.coalesce("response", F.lit(""))) != "", grade(F.col("response"), F.col("_contexts"), judge))
    return _given(rows).select("row_id", score.alias("groundedness"))


#: The metrics of each evaluator, and which columns it needs (REQUIRED).
EVALUATORS: dict[str, tuple[Callable[..., DataFrame], ...]] = {
    "context_reference": (context_relevance, context_precision, context_recall),
    "context": (context_relevance,),
    "groundedness": (groundedness, faithfulness),
}


def evaluated(rows: DataFrame, evaluator: str, judge: Judge = overlap) -> DataFrame:
    """(row_id, the evaluator's metrics); an error names the first row that lacks a needed column."""
    require(rows, evaluator, "row_id")
    metrics = EVALUATORS.get(evaluator, (answer_accuracy, answer_correctness))
    return reduce(lambda left, right: left.join(right, "row_id"), (m(rows) if m is answer_correctness else m(rows, judge) for m in metrics))


def f_beta(tp: Column, fp: Column, fn: Column, beta: float = 1.0) -> Column:
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    low = beta * beta * precision + recall
    return F.when(low > 0, (1 + beta * beta) * precision * recall / low).otherwise(0.0)


def answer_correctness(rows: DataFrame, weight: float = 0.75) -> DataFrame:
    """(row_id, f1, similarity, correctness) on distinct terms; similarity is their cosine."""
    a, b = F.array_distinct(terms(F.coalesce("response", F.lit("")))), F.array_distinct(terms(F.coalesce("reference", F.lit(""))))
    sized = rows.select("row_id", a.alias("a"), b.alias("b")).select("row_id", F.size("a").alias("na"), F.size("b").alias("nb"), F.size(F.array_intersect("a", "b")).alias("n"))
    f1 = f_beta(F.col("n"), F.col("na") - F.col("n"), F.col("nb") - F.col("n"))
    similarity = F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("n") / F.sqrt(F.col("na") * F.col("nb"))).otherwise(0.0)
    return sized.select("row_id", F.round(f1, DIGITS).alias("f1"), F.round(similarity, DIGITS).alias("similarity"), F.round(weight * f1 + (1 - weight) * similarity, DIGITS).alias("correctness"))


def sound(metric: Column) -> Column:
    """The metric, null for NaN and infinities, so that means skip them."""
    return F.when(~F.isnan(metric) & (F.abs(metric) != float("inf")), metric)


def means(scores: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """Mean and count of each metric in each group; a null group is a group."""
    columns = [c for m in metrics for c in (F.round(F.avg(sound(F.col(m))), DIGITS).alias(f"{m}_mean"), F.count(sound(F.col(m))).alias(f"{m}_valid"))]
    return scores.groupBy(*by).agg(*columns, F.count("*").alias("rows"))


def gold_problem(query: Column, keywords: Column, reference: Column) -> Column:
    """What is wrong with a gold row, or null; missing keywords are the empty list."""
    blank = lambda c: strip(F.coalesce(c, F.lit(""))) == ""
    bad = F.exists(F.coalesce(keywords, F.array().cast("array<string>")), blank)
    return F.when(blank(query), "query is blank").when(bad, "a keyword is blank").when(blank(reference), "reference is blank")


REQUIRED = {
    "context_reference": ("user_input", "retrieved_contexts", "reference"), "context": ("user_input", "retrieved_contexts"),
    "answer": ("user_input", "response", "reference"), "groundedness": ("user_input", "response", "retrieved_contexts"),
}


def sample_problem(evaluator: str) -> Column:
    """The first column that an evaluator needs and a row lacks, or null."""
    missing = lambda c: F.size(F.coalesce(F.col(c), F.array())) == 0 if c == "retrieved_contexts" else strip(F.coalesce(F.col(c), F.lit(""))) == ""
    return reduce(lambda rest, c: F.when(missing(c), c).otherwise(rest), reversed(REQUIRED[evaluator]), F.lit(None).cast("string"))


def require(rows: DataFrame, evaluator: str, order: str) -> None:
    """Raises for the first row that lacks a needed column."""
    first = rows.select(order, sample_problem(evaluator).alias("_p")).where(F.col("_p").isNotNull()).orderBy(order).first()
    if first:
        raise ValueError(f"row {first[0]}: {first[1]} is missing")
