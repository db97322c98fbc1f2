"""The operations desk: filters, summaries and gates over priced assets, budget execution, and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.maths import rate
from quarry.functions.text import money_string
from quarry.operators.pricing import GRADES
from quarry.operators.relational import contains_any

# Stages of the pipeline in which work goes on; grades from best to worst; least grade and risk-adjusted return of an intake.
ACTIVE_STAGES = ("qualified", "offer", "due_diligence", "cession")
GRADE_ORDER = tuple(row[1] for row in GRADES)
MIN_GRADE, MIN_RETURN = "A", 0.25


def data_issue(issue: str) -> Column:
    """Whether a row has one of the six issues, from face_value and its evidence flags and counts."""
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return {
        "missing_value": (count("face_value") <= 0) | ~flag("has_value"), "missing_datajud": ~flag("has_process"), "missing_djen": ~flag("has_publication"),
        "missing_field_evidence": count("resolved_fields") < 4, "conflicts": (count("n_conflicts") > 0) | (count("n_field_conflicts") > 0), "candidate_review": count("pending_candidates") > 0,
    }[issue]


def opportunities(df: DataFrame, grade: str | None = None, stage: str | None = None, source: str | None = None, issue: str | None = None, min_return: float | None = None, min_face: float | None = None, max_face: float | None = None, q: str | None = None) -> DataFrame:
    """Priced rows that meet every filter that is given; a return over 1 is a percentage; q is looked for in number, asset number and debtor."""
    tests = [F.col(c) == v for c, v in (("grade", grade), ("stage", stage), ("source", source)) if v]
    tests += [data_issue(issue)] if issue else []
    tests += [F.col("risk_adjusted_irr") >= rate(F.lit(min_return))] if min_return is not None else []
    tests += [F.col("face_value") >= min_face] if min_face is not None else []
    tests += [F.col("face_value") <= max_face] if max_face is not None else []
    tests += [contains_any(q, "_text")] if q else []
    out = df.withColumn("_text", F.concat_ws(" ", *(F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("cnj_number", "asset_number", "debtor_name")))) if q else df
    for test in tests:
        out = out.where(test)
    return out.drop("_text")


def summary(df: DataFrame, where: Column | None = None) -> DataFrame:
    """One row: count, face_value, and the averages of return and probability, 0 for no rows."""
    rows = df if where is None else df.where(where)
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return rows.agg(F.count("*").alias("n"), zero(F.sum("face_value"), "face_value"), zero(F.avg("risk_adjusted_irr"), "average_return"), zero(F.avg("payment_probability"), "average_probability"))


def desk(df: DataFrame) -> DataFrame:
    """Inbox (best grade), active pipeline and portfolio, one row each, in one pass over priced rows with stage and lifecycle_status."""
    sections = {"inbox": (F.col("stage") == "inbox") & (F.col("grade") == GRADE_ORDER[0]), "pipeline": F.col("stage").isin(*ACTIVE_STAGES), "portfolio": (F.col("stage") == "paid") | (F.col("lifecycle_status") == "paid")}
    rows = df.select("face_value", "risk_adjusted_irr", "payment_probability", F.explode(F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in sections.items())))).alias("section"))
    sums = rows.groupBy("section").agg(F.count("*").alias("n"), F.sum("face_value").alias("face_value"), F.avg("risk_adjusted_irr").alias("average_return"), F.avg("payment_probability").alias("average_probability"))
    every = df.sparkSession.createDataFrame([(name,) for name in sections], "section string")
    return every.join(F.broadcast(sums), "section", "left").fillna(0)  # three rows


def quality_summary(df: DataFrame) -> DataFrame:
    """One row: rows, those with each issue, and those blocked and complete."""
    issues = ("missing_value", "missing_datajud", "missing_djen", "missing_field_evidence", "conflicts", "candidate_review")
    return df.agg(F.count("*").alias("total"), *(F.count_if(data_issue(issue)).alias(issue) for issue in issues), *(F.count_if(F.col("status") == state).alias(state) for state in ("blocked", "complete")))


def recent_signals(df: DataFrame, now: str, hours: int = 24, most: int = 12) -> DataFrame:
    """The first signals, of positive and then negative ones of each row in turn, that are undated or of the last hours."""
    rows = df.select("asset_id", "grade", F.posexplode(F.concat("positive", "negative")).alias("at", "s")).select("asset_id", "grade", "at", "s.*")
    recent = F.col("event_at").isNull() | (F.col("event_at") >= F.lit(now).cast("timestamp") - F.expr(f"interval {hours} hours"))
    return rows.where(recent).orderBy("asset_id", "at").limit(most).drop("at")


def intake(df: DataFrame, min_grade: str = MIN_GRADE, min_return: float = MIN_RETURN) -> DataFrame:
    """df with outcome: created or updated for rows to make an opportunity of, else skipped.

    Those have a face value, are not to be avoided, and reach the grade or the return. known: whether there is one already.
    """
    rank = F.array_position(F.array(*map(F.lit, GRADE_ORDER)), F.col("grade"))
    reaches = (rank <= GRADE_ORDER.index(min_grade) + 1) | (F.col("risk_adjusted_irr") >= rate(F.lit(min_return)))
    good = (F.col("face_value") > 0) & (F.col("decision") != "avoid") & reaches
    return df.withColumn("outcome", F.when(~F.coalesce(good, F.lit(False)), F.lit("skipped")).when(F.col("known"), F.lit("updated")).otherwise(F.lit("created")))


def budget_rows(df: DataFrame, q: str | None = None, **equal) -> DataFrame:
    """Budget executions with the given values and a term in one of their four names."""
    for column, value in equal.items():
        if value is not None and value != "":
            df = df.where(F.col(column) == value)
    return df.where(contains_any(q, "budget_unit_name", "program_name", "action_name", "funding_source_name")) if q else df


def budget_summary(df: DataFrame) -> DataFrame:
    """One row: the number of rows and four sums as decimal texts, 0.00 for none."""
    names = ("net_allocation", "committed_amount", "liquidated_amount", "paid_amount")
    return df.agg(F.count("*").alias("rows"), *(F.sum(c).alias(c) for c in names)).select("rows", *(money_string(c).alias(f"{c}_total") for c in names))


def candidates(df: DataFrame, q: str | None = None, min_score: float | None = None, max_score: float | None = None, **equal) -> DataFrame:
    """Match candidates with the given values, in a band of scores, and a term in number, process or court."""
    for column, value in equal.items():
        if value:
            df = df.where(F.col(column) == value)
    df = df if min_score is None else df.where(F.col("score") >= min_score)
    df = df if max_score is None else df.where(F.col("score") <= max_score)
    return df.where(contains_any(q, "candidate_cnj", "process_id", "court")) if q else df


# Signals of each item of the checklist, with the state that they give it, the first that holds.
CHECKLIST = (
    ("cession_chain", (("prior_cession_detected", "blocked"),)), ("encumbrances", (("lien_detected", "review"),)), ("procedural_risk", (("suspension_detected", "blocked"), ("objection_pending", "review"))),
    ("ownership_capacity", (("beneficiary_inventory_pending", "blocked"),)), ("attorney_fees", (("fee_dispute_detected", "review"),)),
)
EXITS = ("payment_available", "direct_agreement_opened", "superpreference_granted")


def checklist() -> Column:
    """Array of (item, state) of a row with codes and lifecycle_status; a suspended asset is to be reviewed; without a way out so is the payment."""
    has = lambda code: F.coalesce(F.array_contains("codes", code), F.lit(False))
    items = []
    for item, rules in CHECKLIST:
        state = F.when(F.col("lifecycle_status") == "suspended", F.lit("review")).otherwise(F.lit("passed")) if item == "procedural_risk" else F.lit("passed")
        for code, value in reversed(rules):
            state = F.when(has(code), F.lit(value)).otherwise(state)
        items.append(F.struct(F.lit(item).alias("item"), state.alias("state")))
    way_out = F.coalesce(F.arrays_overlap("codes", F.array(*map(F.lit, EXITS))), F.lit(False))
    return F.array(*items, F.struct(F.lit("payment_window").alias("item"), F.when(way_out, F.lit("passed")).otherwise(F.lit("review")).alias("state")))
