"""Keyword routing of a question table, dispatch to the lookups, and templated answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import contains_any, customer_id, percent, plain_number
from tidemark.operators.retail import lookup_country_kpis, lookup_customers, top_drivers
from tidemark.operators.retrieval import answer_columns
from tidemark.operators.terms import TERM_CHARS, first_term
from tidemark.session import broadcast_if_small

# Fixed values.
CUSTOMER_TOOL = "get_customer_churn_risk"
COUNTRY_TOOL = "get_country_kpis"
DRIVER_TOOL = "get_churn_risk_drivers"
POLICY_TOOL = "ask_hr_it_policy"
POLICY_TERMS = (
    "leave", "expense", "reimburs", "laptop", "it equipment", "remote work", "hybrid",
    "in the office", "wfh", "work from home", "onboard", "probation", "password",
    "mfa", "phishing", "business travel", "per diem", "flight", "performance review",
    "rating", "pip", "maternity", "paternity", "parental leave", "harassment",
    "grievance", "workplace conduct",
)
DRIVER_TERMS = ("driver", "why are customers churning", "feature importance", "model accuracy", "how accurate")
ANALYTICS_TERMS = ("customer", "revenue", "kpi", "churn", "risk", "market", "sales")
NOT_HANDLED = (
    "This question fits none of the known topics (company policy, customers, markets, churn drivers) and was left unanswered."
)
CUSTOMER_ANSWER = (
    "Customer %s (%s, %s segment): churn probability %s, risk band %s. "
    "Recency %s days, frequency %s, monetary SGD %s, tenure %s days."
)
COUNTRY_ANSWER = "%s: %s customers, average churn probability %s, %s high-risk, total revenue SGD %s."
MISSING = "n/a"
DRIVER_ITEM = "%s (%s)"
DRIVER_ANSWER = "Top churn drivers: %s. Model accuracy %s%%, ROC-AUC %s."

def term_routes(questions: DataFrame, terms: DataFrame, question: str = "question", term_chars: int = TERM_CHARS) -> DataFrame:
    """Route of the smallest-priority term that occurs in the question, else NULL; the dictionary may have any size."""
    best = first_term(questions, terms, ["priority", "route", "term"], question, "_best", term_chars=term_chars)
    return best.withColumn("route", F.col("_best.route")).drop("_best")


def all_routes(questions: DataFrame, countries: DataFrame, question: str = "question", term_chars: int = TERM_CHARS) -> DataFrame:
    """Every tool that a question calls for, in ``calls`` (tool, tool_input), in this order: customer id, country with an analytics
    word, driver words, policy words. A question of several parts has several calls; one that calls for nothing is not handled."""
    text = F.lower(question)
    names = countries.select("country", F.lower("country").alias("term"))
    country = F.when(contains_any(text, ANALYTICS_TERMS), F.col("_named.country"))
    customer = customer_id(F.col(question))
    call = lambda found, tool, value: F.when(found, F.struct(F.lit(tool).alias("tool"), value.cast("string").alias("tool_input")))
    calls = F.array_compact(F.array(
        call(customer.isNotNull(), CUSTOMER_TOOL, customer),
        call(country.isNotNull(), COUNTRY_TOOL, country),
        call(contains_any(text, DRIVER_TERMS), DRIVER_TOOL, F.lit(None)),
        call(contains_any(text, POLICY_TERMS), POLICY_TOOL, F.col(question)),
    ))
    named = first_term(questions, names, ["country", "term"], question, "_named", term_chars=term_chars)
    return named.withColumn("calls", calls).withColumn("handled", F.size("calls") > 0).drop("_named")


def route_questions(questions: DataFrame, countries: DataFrame, question: str = "question", term_chars: int = TERM_CHARS) -> DataFrame:
    """First match wins: customer id, country with an analytics word, driver words, policy words, else unhandled."""
    first = F.get("calls", F.lit(0))
    routed = all_routes(questions, countries, question, term_chars)
    return routed.withColumns({"tool": first["tool"], "tool_input": first["tool_input"]}).drop("calls").select(*questions.columns, "tool", "tool_input", "handled")


def customer_answer() -> Column:
    text = F.format_string(
        CUSTOMER_ANSWER, "found_id", "country", "segment", percent(F.col("churn_probability")), "churn_risk_band",
        "recency_days", "frequency", plain_number(F.col("monetary_sgd")), F.coalesce(F.col("tenure_days").cast("string"), F.lit(MISSING)),
    )
    return F.coalesce(F.col("error"), text)


def country_answer() -> Column:
    text = F.format_string(
        COUNTRY_ANSWER, "country", "customer_count", percent(F.col("avg_churn_probability")), "high_risk_count",
        F.format_number("total_monetary_sgd", 2),
    )
    return F.coalesce(F.col("error"), text)


def driver_answer(drivers: Column) -> Column:
    first = F.get(drivers, F.lit(0))
    listed = F.transform(drivers, lambda r: F.format_string(DRIVER_ITEM, r["feature"], percent(r["importance"])))
    accuracy = F.bround(first["model_accuracy"] * 100, 1).cast("decimal(10,1)").cast("string")
    auc = F.bround(first["model_roc_auc"], 2).cast("decimal(10,2)").cast("string")
    return F.format_string(DRIVER_ANSWER, F.array_join(listed, ", "), accuracy, auc)


LOOKUP_FIELDS = (
    "found_id", "country", "segment", "churn_probability", "churn_risk_band", "recency_days", "frequency", "monetary_sgd", "tenure_days", "error",
)
KPI_FIELDS = ("country", "customer_count", "avg_churn_probability", "high_risk_count", "total_monetary_sgd", "error")


def dispatch(
    routed: DataFrame,
    scored: DataFrame,
    importance: DataFrame,
    metrics: DataFrame,
    policy_answers: DataFrame | None = None,
    question_id: str = "question_id",
    id_col: str = "customer_id",
) -> DataFrame:
    """Answer routed questions: one join per tool over the rows of that tool only, then a union.

    Splitting by tool first keeps rows without a key out of the joins. ``policy_answers`` has the question id,
    ``answer``, ``grounded`` and ``citations``. Every answer carries a trace of tool, input and JSON output; a lookup
    that finds nothing is an error in that output, not a failed job.
    """
    keep = [*routed.columns]
    of = lambda tool: routed.where(F.col("tool") == tool)

    def traced(df: DataFrame, output: Column, answer: Column, inputs: Column) -> DataFrame:
        call = F.struct(F.col("tool").alias("tool"), inputs.alias("input"), output.alias("output"))
        return df.select(*keep, F.array(call).alias("tool_calls"), answer.alias("answer"))

    customers = lookup_customers(of(CUSTOMER_TOOL), scored, "tool_input", id_col)
    customers = traced(
        customers, F.to_json(F.struct(*LOOKUP_FIELDS)), customer_answer(), F.create_map(F.lit("customer_id"), F.col("tool_input"))
    )
    countries = lookup_country_kpis(of(COUNTRY_TOOL), scored, "tool_input")
    countries = traced(
        countries, F.to_json(F.struct(*KPI_FIELDS)), country_answer(), F.create_map(F.lit("country"), F.col("tool_input"))
    )
    # Five rows at most.
    best = top_drivers(importance, metrics)
    order = F.struct((-F.col("importance")).alias("o"), "feature", "importance", "model_accuracy", "model_roc_auc")
    listed = best.agg(F.sort_array(F.collect_list(order)).alias("d")).scalar()
    drivers = of(DRIVER_TOOL).withColumn("_drivers", listed)
    output = F.struct(
        F.transform("_drivers", lambda r: F.struct(r["feature"].alias("feature"), r["importance"].alias("importance"))).alias("top_drivers"),
        F.get("_drivers", F.lit(0))["model_accuracy"].alias("model_accuracy"),
        F.get("_drivers", F.lit(0))["model_roc_auc"].alias("model_roc_auc"),
    )
    no_input = F.create_map().cast("map<string,string>")
    drivers = traced(drivers, F.to_json(output), driver_answer(F.col("_drivers")), no_input)
    result = customers.unionByName(countries).unionByName(drivers)
    if policy_answers is not None:
        policy = of(POLICY_TOOL).join(policy_answers.select(question_id, "answer", "grounded", "citations"), question_id, "left")
        policy = policy.withColumn("answer", F.coalesce("answer", F.lit("")))
        policy = traced(
            policy, F.to_json(F.struct("answer", "grounded", "citations")), F.col("answer"), F.create_map(F.lit("question"), F.col("tool_input"))
        )
        result = result.unionByName(policy)
    calls = result.schema["tool_calls"].dataType
    rest = routed.where(~F.col("handled")).select(
        *keep, F.array().cast(calls).alias("tool_calls"), F.lit(NOT_HANDLED).alias("answer")
    )
    return result.unionByName(rest)


def dispatch_all(
    routed: DataFrame, scored: DataFrame, importance: DataFrame, metrics: DataFrame, policy_answers: DataFrame | None = None,
    question_id: str = "question_id", id_col: str = "customer_id", policy_texts: DataFrame | None = None,
) -> DataFrame:
    """Answer every call of the questions from :func:`all_routes`: fan out to one row per call, dispatch, fan in.

    ``tool_calls`` holds the trace in the order of the calls and ``answer`` their answers, one below the other. Question ids are unique.
    With ``policy_texts`` (answer_id, citations, answer) the ``policy_answers`` have ``answer_id`` and ``grounded`` alone: the texts,
    which many questions may share, then join after the calls are gathered and are neither shuffled nor collected per question.
    """
    late = policy_answers is not None and policy_texts is not None
    rest = [c for c in routed.columns if c not in (question_id, "calls")]
    fanned = routed.select(question_id, *rest, F.posexplode_outer("calls").alias("_step", "_call"))
    fanned = fanned.select(question_id, *rest, "_step", F.col("_call.tool").alias("tool"), F.col("_call.tool_input").alias("tool_input"))
    done = dispatch(fanned, scored, importance, metrics, None if late else policy_answers, question_id, id_col)
    if late:
        call = F.struct(F.col("tool").alias("tool"), F.create_map(F.lit("question"), F.col("tool_input")).alias("input"), F.lit(None).cast("string").alias("output"))
        policy = fanned.where(F.col("tool") == POLICY_TOOL).join(policy_answers.select(question_id, "answer_id", "grounded"), question_id, "left")
        policy = policy.select(*fanned.columns, F.array(call).alias("tool_calls"), F.lit(None).cast("string").alias("answer"), "answer_id", "grounded")
        done = done.withColumns({"answer_id": F.lit(None).cast("string"), "grounded": F.lit(None).cast("boolean")}).unionByName(policy)
    step = F.struct("_step", F.col("tool_calls").alias("trace"), F.col("answer").alias("said"), *["grounded"] * late)
    # four steps at most; the map input of a call can't be ordered, the step number alone is
    ordered = F.array_sort(F.collect_list(step), lambda a, b: F.coalesce(a["_step"] - b["_step"], F.lit(0)))
    kept = [F.first("answer_id", ignorenulls=True).alias("answer_id")] * late
    whole = done.groupBy(question_id).agg(*[F.first(c).alias(c) for c in rest], ordered.alias("_steps"), *kept)
    if late:
        whole = _with_policy(whole, policy_texts)
    return whole.select(
        question_id, *rest, F.flatten(F.transform("_steps", lambda s: s["trace"])).alias("tool_calls"),
        F.array_join(F.transform("_steps", lambda s: s["said"]), "\n\n").alias("answer"),
    )


def _with_policy(whole: DataFrame, texts: DataFrame) -> DataFrame:
    """The answer texts put into the policy steps of the gathered calls."""
    known = whole.join(broadcast_if_small(texts.select("answer_id", F.col("answer").alias("_text"), F.col("citations").alias("_cites"))), "answer_id", "left")

    def filled(s):
        of = answer_columns(s["grounded"], F.col("_cites"), F.col("_text"))
        said = F.coalesce(F.when(s["grounded"].isNotNull(), of["answer"]), F.lit(""))
        cites = F.when(s["grounded"].isNotNull(), of["citations"])
        output = F.to_json(F.struct(said.alias("answer"), s["grounded"].alias("grounded"), cites.alias("citations")))
        trace = F.transform(s["trace"], lambda c: F.struct(c["tool"].alias("tool"), c["input"].alias("input"), output.alias("output")))
        mine = F.coalesce(F.get(s["trace"], F.lit(0))["tool"] == POLICY_TOOL, F.lit(False))
        return F.when(mine, F.struct(s["_step"].alias("_step"), trace.alias("trace"), said.alias("said"), s["grounded"].alias("grounded"))).otherwise(s)

    return known.withColumn("_steps", F.transform("_steps", filled)).drop("answer_id", "_text", "_cites")
