"""Queries of evaluation: checks, metrics by the lexical judge, means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.text import prompt_context
from inkwell.operators import evaluate
from inkwell.operators.store import latest
from inkwell.plans.registry import query, table
from inkwell.plans.search import sql_terms
from inkwell.plans.texts import sql_strip

_ONCE = "e as (select * from eval_rows qualify row_number() over (partition by row_id order by judged_at desc nulls last) = 1)"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.once(table(spark, sf_dir, "eval_rows"))


def _overlap(claim: str, source: str) -> str:
    a, b = f"list_distinct({sql_terms(f'coalesce({claim}, {chr(39)}{chr(39)})')})", f"list_distinct({sql_terms(f'coalesce({source}, {chr(39)}{chr(39)})')})"
    return f"case when len({a}) > 0 then len(list_intersect({a}, {b})) / len({a}) else 0 end"


_BLANK = lambda c: f"{sql_strip(f'coalesce({c}, chr(32))')} = ''"


@query(f"""
select line_no, case when {_BLANK('query')} then 'query is blank' when len(list_filter(coalesce(keywords, []), lambda k: {_BLANK('k')})) > 0 then 'a keyword is blank'
 when {_BLANK('reference')} then 'reference is blank' end as problem, len(coalesce(keywords, [])) as keywords from jp_reference""")
def gold_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "jp_reference")
    problem = evaluate.gold_problem(F.col("query"), F.col("keywords"), F.col("reference"))
    return rows.select("line_no", problem.alias("problem"), F.size(F.coalesce("keywords", F.array().cast("array<string>"))).alias("keywords"))


@query(f"""
with {_ONCE}
select row_id, case when {_BLANK('user_input')} then 'user_input' when len(coalesce(retrieved_contexts, [])) = 0 then 'retrieved_contexts' when {_BLANK('reference')} then 'reference' end as context_reference,
 case when {_BLANK('user_input')} then 'user_input' when {_BLANK('response')} then 'response' when {_BLANK('reference')} then 'reference' end as answer,
 case when {_BLANK('user_input')} then 'user_input' when {_BLANK('response')} then 'response' when len(coalesce(retrieved_contexts, [])) = 0 then 'retrieved_contexts' end as groundedness from e""")
def eval_sample_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("row_id", *(evaluate.sample_problem(name).alias(name) for name in ("context_reference", "answer", "groundedness")))


@query("""
select line_no, mode, case mode when 'keywords' then '' else query end as query, case mode when 'embedding' then 0 else len(coalesce(keywords, [])) end as lists
from jp_reference, (select unnest(['embedding', 'keywords', 'mix']) as mode)""")
def mode_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each gold row for each mode of retrieval, with what that mode searches by."""
    rows = table(spark, sf_dir, "jp_reference").select("line_no", "query", "keywords", F.explode(F.array(*map(F.lit, ("embedding", "keywords", "mix")))).alias("mode"))
    n = F.size(F.coalesce("keywords", F.array().cast("array<string>")))
    return rows.select("line_no", "mode", F.when(F.col("mode") == "keywords", "").otherwise(F.col("query")).alias("query"), F.when(F.col("mode") == "embedding", 0).otherwise(n).alias("lists"))


@query(f"""
with {_ONCE}, v as (select row_id, list_transform(coalesce(retrieved_contexts, []), lambda c: case when {_overlap('reference', 'c')} >= 0.5 then 1 else 0 end) as v from e)
select row_id, round(case when len(v) = 0 then null when list_sum(v) > 0 then list_sum(list_transform(v, lambda x, i: x * list_sum(v[1:i]) / i)) / list_sum(v) else 0 end, 6) as context_precision from v""")
def context_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.context_precision(_rows(spark, sf_dir))


def _sql_share(answer: str, name: str) -> str:
    parts = f"list_filter(list_transform(string_split(regexp_replace(coalesce({answer}, ''), '([。！？!?])', '\\1' || chr(10), 'g'), chr(10)), lambda p: {sql_strip('p')}), lambda p: p <> '')"
    return f"""
with {_ONCE}, p as (select row_id, {parts} as p, array_to_string(coalesce(retrieved_contexts, []), chr(10)) as s from e)
select row_id, case when len(p) > 0 then round(len(list_filter(p, lambda c: {_overlap('c', 's')} >= 0.5)) / len(p), 6) end as {name} from p"""


@query(_sql_share("reference", "context_recall"))
def context_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.context_recall(_rows(spark, sf_dir))


@query(_sql_share("response", "faithfulness"))
def faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.faithfulness(_rows(spark, sf_dir))


def _sql_grade(claim: str, source: str) -> str:
    return f"case when {_overlap(claim, source)} >= 0.8 then 1.0 when {_overlap(claim, source)} >= 0.4 then 0.5 else 0.0 end"


@query(f"""
with {_ONCE}, s as (select *, array_to_string(coalesce(retrieved_contexts, []), chr(10)) as c from e)
select row_id, case when len(coalesce(retrieved_contexts, [])) > 0 then {_sql_grade('user_input', 'c')} end as context_relevance from s""")
def context_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.context_relevance(_rows(spark, sf_dir))


@query(f"with {_ONCE} select row_id, ({_sql_grade('response', 'reference')} + {_sql_grade('reference', 'response')}) / 2 as answer_accuracy from e")
def answer_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.answer_accuracy(_rows(spark, sf_dir))


@query(f"""
with {_ONCE}, s as (select *, array_to_string(coalesce(retrieved_contexts, []), chr(10)) as c from e)
select row_id, case when not {_BLANK('response')} then {_sql_grade('response', 'c')} end as groundedness from s""")
def groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.groundedness(_rows(spark, sf_dir))


_SQL_CORRECT = f"""
t as (select row_id, eval_type, list_distinct({sql_terms("coalesce(response, '')")}) as a, list_distinct({sql_terms("coalesce(reference, '')")}) as b from e),
c as (select row_id, eval_type, len(a) as na, len(b) as nb, len(list_intersect(a, b)) as n from t),
f as (select row_id, eval_type, case when na > 0 then n / na else 0 end as p, case when nb > 0 then n / nb else 0 end as r, case when na > 0 and nb > 0 then n / sqrt(na * nb) else 0 end as s from c),
g as (select row_id, eval_type, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f1, s from f)"""


@query(f"with {_ONCE}, {_SQL_CORRECT} select row_id, round(f1, 6) as f1, round(s, 6) as similarity, round(0.75 * f1 + 0.25 * s, 6) as correctness from g")
def answer_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.answer_correctness(_rows(spark, sf_dir))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with what a judge may leave: NaN where there is no response, infinity where no reference is."""
    rows = latest(table(spark, sf_dir, "eval_rows"), ["row_id"], ["judged_at"])
    scored = evaluate.answer_correctness(rows).join(rows.select("row_id", "eval_type", "response", "reference"), "row_id")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return scored.withColumn("f1", F.when(F.col("response").isNull(), nan).otherwise(F.col("f1"))).withColumn("correctness", F.when(F.length("reference") < 10, inf).otherwise(F.col("correctness")))


_SQL_SCORES = f"""
{_ONCE}, {_SQL_CORRECT}, x as (select g.eval_type, case when response is null then null else round(f1, 6) end as f1, case when length(reference) < 10 then null else round(0.75 * f1 + 0.25 * s, 6) end as c from g join e using (row_id))"""


@query(f"with {_SQL_SCORES} select round(avg(f1), 6) as f1_mean, count(f1) as f1_valid, round(avg(c), 6) as correctness_mean, count(c) as correctness_valid, count(*) as rows from x")
def metric_mean_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.means(_scores(spark, sf_dir), ["f1", "correctness"], [])


@query(f"with {_SQL_SCORES} select eval_type, round(avg(f1), 6) as f1_mean, count(f1) as f1_valid, round(avg(c), 6) as correctness_mean, count(c) as correctness_valid, count(*) as rows from x group by eval_type")
def metric_mean_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.means(_scores(spark, sf_dir), ["f1", "correctness"], ["eval_type"])


@query(f"""
with {_SQL_SCORES},
m as (select eval_type, grouping(eval_type) as total, round(avg(f1), 6) as f1, round(avg(c), 6) as correctness from x group by grouping sets ((eval_type), ()))
select case when total = 1 then 'avg' else coalesce(eval_type, 'null') end || '.' || name as metric, value from (unpivot m on f1, correctness into name name value value) where value is not null""")
def trace_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'avg.<metric>' and '<mode>.<metric>' rows, without nulls."""
    both = _scores(spark, sf_dir).groupingSets([["eval_type"], []], "eval_type").agg(
        F.grouping("eval_type").alias("total"), *(F.round(F.avg(evaluate.sound(F.col(m))), 6).alias(m) for m in ("f1", "correctness"))
    )
    mode = F.when(F.col("total") == 1, "avg").otherwise(F.coalesce("eval_type", F.lit("null")))
    long = both.withColumn("mode", mode).unpivot(["mode"], ["f1", "correctness"], "name", "value")
    return long.where(F.col("value").isNotNull()).select(F.concat_ws(".", "mode", "name").alias("metric"), "value")


@query("""
with e as (select * from eval_rows qualify row_number() over (partition by row_id order by judged_at desc nulls last) = 1)
select row_id, array_to_string(list_transform(coalesce(retrieved_contexts, []), lambda c, i: '[Context ' || i || ']' || chr(10) || coalesce(c, '')), chr(10) || chr(10)) as prompt from e""")
def prompt_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("row_id", prompt_context(F.col("retrieved_contexts")).alias("prompt"))


@query("select count(*) as rows_expanded, count(distinct line_no) as rows_original, count(distinct row_id) as rows_once from eval_rows")
def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_rows").agg(F.count("*").alias("rows_expanded"), F.count_distinct("line_no").alias("rows_original"), F.count_distinct("row_id").alias("rows_once"))
