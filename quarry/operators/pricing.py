"""Pricing, scoring and ranking of assets, as columns over one joined row per asset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.maths import clamp, inverse_scaled, product, rate, rounded, scaled

# Payment multiplier and score weight of each signal, positive and negative.
POSITIVE = {
    "direct_agreement_opened": (1.6, 18), "direct_agreement_window": (1.45, 16), "superpreference_granted": (1.4, 16), "preferential_queue": (1.25, 14), "payment_available": (1.9, 22),
    "payment_process_detected": (1.35, 18), "queue_position_favorable": (1.18, 10), "final_judgment": (1.12, 10), "calculation_homologated": (1.1, 9), "requisition_issued": (1.08, 8),
}
NEGATIVE = {
    "prior_cession_detected": (0.0, 100), "lien_detected": (0.6, 28), "suspension_detected": (0.3, 42), "objection_pending": (0.55, 28), "beneficiary_inventory_pending": (0.45, 36),
    "fee_dispute_detected": (0.7, 18), "special_regime_declared": (0.7, 22), "queue_position_unknown": (0.95, 6),
}
# Correction, tax and cost rates; offer rate and term in months by debtor type; grades by least score.
CORRECTION, TAX, COST = 0.12, 0.15, 0.015
OFFER = {"union": 0.78, "autarchy": 0.78, "foundation": 0.78, "state": 0.6, "municipality": 0.35}
TERM = {"union": 24, "autarchy": 24, "foundation": 24, "state": 42, "municipality": 60}
GRADES = ((0.85, "A+", "aggressive_buy", 100), (0.7, "A", "buy", 80), (0.55, "B+", "buy", 60), (0.4, "B", "watch", 40), (0.25, "C", "watch", 20), (None, "D", "avoid", 0))


def _by(column: str, values: dict, default) -> Column:
    out = F.lit(default)
    for key, value in values.items():
        out = F.when(F.col(column) == key, F.lit(value)).otherwise(out)
    return out


def signal_table(events: DataFrame, codes: str = "code") -> DataFrame:
    """events that are signals, with polarity, multiplier and weight."""
    spark = events.sparkSession
    rows = [(code, sign, float(m), w) for sign, table in (("positive", POSITIVE), ("negative", NEGATIVE)) for code, (m, w) in table.items()]
    return events.join(F.broadcast(spark.createDataFrame(rows, f"{codes} string, polarity string, multiplier double, weight int")), codes)


def lifecycle_signals(assets: DataFrame) -> DataFrame:
    """The signal that an asset's state adds to its events: (asset_id, code)."""
    code = F.when(F.col("lifecycle_status") == "in_payment", F.lit("payment_available")).when(F.col("lifecycle_status") == "suspended", F.lit("suspension_detected"))
    return assets.select("asset_id", code.alias("code")).where("code is not null")


def signals_by_asset(events: DataFrame) -> DataFrame:
    """Per asset: the product of multipliers, summed weights, and its codes. events: (asset_id, code), one row per signal.

    Counts per code come first, so an asset with very many events still is a few rows when they are multiplied.
    """
    per_code = signal_table(events.groupBy("asset_id", "code").agg(F.count("*").alias("n")))
    sums = [F.sum(F.when(F.col("polarity") == sign, F.col("weight") * F.col("n")).otherwise(0)).alias(name) for sign, name in (("positive", "positive_weight"), ("negative", "negative_weight"))]
    return per_code.groupBy("asset_id").agg(
        product(F.pow("multiplier", "n")).alias("multiplier"), *sums, F.sum(F.when(F.col("polarity") == "positive", F.col("n")).otherwise(0)).alias("positive_signals"),
        F.sum(F.when(F.col("polarity") == "negative", F.col("n")).otherwise(0)).alias("negative_signals"), F.sort_array(F.collect_set("code")).alias("codes"),
    )


def has_code(*codes: str) -> Column:
    found = F.lit(False)
    for code in codes:
        found = found | F.coalesce(F.array_contains("codes", code), F.lit(False))
    return found


def offer_rate(override: Column | None = None, discount: Column | None = None) -> Column:
    """Of face value: an override within 1 and 99 %, an override of the discount, else by nature and debtor type."""
    rule = F.when(F.col("nature") == "alimentar", F.lit(0.72)).otherwise(_by("debtor_type", OFFER, 0.65))
    given = [clamp(rate(override), 0.01, 0.99)] if override is not None else []
    given += [clamp(1 - rate(discount), 0.01, 0.99)] if discount is not None else []
    return F.coalesce(*given, rule)


def term_months() -> Column:
    """Expected months to payment: the debtor's average, else the first rule that holds."""
    queue = F.col("queue_position")
    rules = [
        (F.col("average_months") > 0, F.col("average_months")),
        (has_code("payment_available", "payment_process_detected"), F.lit(12)), (has_code("superpreference_granted"), F.lit(10)), (has_code("preferential_queue"), F.lit(12)),
        (has_code("direct_agreement_window"), F.lit(18)), (queue <= 25, F.lit(12)), (queue <= 100, F.lit(18)), (F.col("lifecycle_status").isin("in_payment", "paid"), F.lit(12)),
        (F.col("payment_regime") == "special", F.lit(72)),
    ]
    out = _by("debtor_type", TERM, 36)
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return F.greatest(F.lit(1), F.floor(out + 0.5)).cast("int")


def default_reliability() -> Column:
    special = F.col("payment_regime") == "special"
    return F.when(F.col("debtor_type").isin("union", "autarchy", "foundation"), 88).when((F.col("debtor_type") == "state") & special, 52).when(F.col("debtor_type") == "state", 68).when(F.col("debtor_type") == "municipality", 42).otherwise(55)


def price(assets: DataFrame, correction: float | Column = CORRECTION, tax: float = TAX, cost: float = COST) -> DataFrame:
    """assets with the pricing projection.

    Needs face_value (double), nature, debtor_type, payment_regime, lifecycle_status, queue_position,
    reliability, on_time_rate, average_months, regime_special, recent_default, multiplier and codes; nulls
    mean unknown. An asset without face value costs nothing and has IRR 0.
    """
    growth = correction if isinstance(correction, Column) else F.lit(correction)
    out = assets.withColumn("face_value", F.coalesce(F.col("face_value").cast("double"), F.lit(0.0)))
    out = out.withColumns({"term_months": term_months(), "offer_rate": offer_rate()})
    out = out.withColumn("acquisition_cost", F.col("face_value") * F.col("offer_rate"))
    out = out.withColumn("expected_payment", F.col("face_value") * F.pow(1 + growth, F.col("term_months") / 12))
    out = out.withColumn("operational_cost", F.col("face_value") * cost)
    out = out.withColumn("estimated_tax", F.greatest(F.col("expected_payment") - F.col("acquisition_cost"), F.lit(0.0)) * tax)
    out = out.withColumn("net_proceeds", F.col("expected_payment") - F.col("operational_cost") - F.col("estimated_tax"))
    out = out.withColumn("net_profit", F.col("net_proceeds") - F.col("acquisition_cost"))
    months = F.lit(12) / F.col("term_months")
    # below six months the return is annualised linearly
    irr = F.when(F.col("acquisition_cost") > 0, F.when(F.col("term_months") >= 6, F.pow(F.col("net_proceeds") / F.col("acquisition_cost"), months) - 1).otherwise(F.col("net_profit") / F.col("acquisition_cost") * months)).otherwise(0.0)
    known = F.coalesce(F.col("on_time_rate").cast("double"), F.col("reliability") / 100, default_reliability() / 100)
    special = F.coalesce(F.col("regime_special"), F.lit(False)) | F.coalesce(F.col("payment_regime") == "special", F.lit(False))
    chance = known * F.when(special, 0.7).otherwise(1.0) * F.when(F.coalesce(F.col("recent_default"), F.lit(False)), 0.55).otherwise(1.0) * F.coalesce(F.col("multiplier"), F.lit(1.0))
    out = out.withColumns({"expected_irr": clamp(irr, -1.0, 2.0), "payment_probability": clamp(chance, 0.0, 1.0)})
    out = out.withColumn("risk_adjusted_irr", clamp(F.col("expected_irr") * F.col("payment_probability"), -1.0, 2.0))
    parts = {"irr": 0.4 * scaled("risk_adjusted_irr", 0.05, 0.6), "probability": 0.25 * F.col("payment_probability"), "term": 0.2 * inverse_scaled("term_months", 1, 60), "face": 0.15 * scaled("face_value", 50_000, 5_000_000)}
    out = out.withColumn("breakdown", F.struct(*(v.alias(k) for k, v in parts.items())))
    out = out.withColumn("final_score", F.col("breakdown.irr") + F.col("breakdown.probability") + F.col("breakdown.term") + F.col("breakdown.face"))
    return graded(out, "final_score")


def graded(df: DataFrame, score: str) -> DataFrame:
    """df with grade, decision and priority by its score."""
    values = [F.lit(x) for x in GRADES[-1][1:]]
    for least, *row in reversed(GRADES[:-1]):
        values = [F.when(F.col(score) >= least, F.lit(new)).otherwise(old) for new, old in zip(row, values, strict=True)]
    return df.withColumns(dict(zip(("grade", "decision", "priority"), values, strict=True)))


# Texts of an explanation, by decision, and by what tells a debtor's reliability and the term; weights of the score's parts with the bounds between which they are scaled.
HEADLINES = {"aggressive_buy": "prioritize commercial action", "buy": "commercially attractive", "watch": "monitor and complete diligence", "avoid": "avoid until risk clears"}
RELIABILITY = ("Uses historical on-time payment rate for the debtor.", "Uses debtor reliability score when historical payment rate is unavailable.", "Uses conservative default reliability by debtor type.")
TERMS = {
    "payment_available": "Payment available signal sets a short expected exit window.", "payment_process_detected": "Payment-process document indicates near-term liquidity.", "superpreference_granted": "Superpreference signal shortens expected queue time.",
    None: "Falls back to debtor type, payment regime and lifecycle status.",
}
DETAILS = {
    "risk_adjusted_irr": "Primary ranking metric after payment probability is applied.", "offer_rate": "Lower acquisition cost increases expected spread but must remain commercially executable.",
    "signals": "DJEN, DataJud, tribunal queue and payment documents change payment probability.",
}
PARTS = {"risk_adjusted_irr": (0.4, 0.05, 0.6), "payment_probability": (0.25, 0, 1), "term_months": (0.2, 1, 60), "face_value": (0.15, 50_000, 5_000_000)}


def _percent(value: Column) -> Column:
    """A share in percent with at most two decimals."""
    return F.concat(F.regexp_replace(F.format_string("%.2f", rounded(value * 100, 2)), r"\.?0+$", ""), F.lit("%"))


def explanation() -> Column:
    """Why a priced row has its grade: headline, summary, breakdown (value, normalized, weight and contribution of each part) and factors (key, impact, value, detail)."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    text = lambda c: c.cast("string")
    headline, term = F.lit(None).cast("string"), F.when(F.col("queue_position") <= 100, F.concat(F.lit("Queue position "), text(F.col("queue_position")), F.lit(" shortens the estimated term."))).otherwise(F.lit(TERMS[None]))
    for decision, words in HEADLINES.items():
        headline = F.when(F.col("decision") == decision, F.concat(F.lit("Grade "), "grade", F.lit(f": {words}"))).otherwise(headline)
    for code in ("superpreference_granted", "payment_process_detected", "payment_available"):
        term = F.when(has_code(code), F.lit(TERMS[code])).otherwise(term)
    signals = F.concat(text(n("positive_signals")), F.lit(" {} "), text(n("negative_signals")), F.lit(" negative"))
    summary = F.concat_ws(
        ", ", F.concat(F.lit("Score "), "grade", F.lit(" from "), _percent(F.col("risk_adjusted_irr")), F.lit(" risk-adjusted IRR")), F.concat(_percent(F.col("payment_probability")), F.lit(" payment probability")),
        F.concat(text(F.col("term_months")), F.lit(" month estimated term")), F.concat(F.replace(signals, F.lit("{}"), F.lit("positive and")), F.lit(" signals")),
    )
    breakdown = []
    for name, (weight, low, high) in PARTS.items():
        part = inverse_scaled(name, low, high) if name == "term_months" else scaled(name, low, high)
        breakdown.append(F.struct(rounded(name, 6).alias("value"), rounded(part, 6).alias("normalized"), F.lit(weight).alias("weight"), rounded(part * weight, 6).alias("contribution")).alias(name))
    reliable = F.when(F.coalesce(F.col("on_time_rate").cast("double"), F.lit(0.0)) != 0, F.lit(RELIABILITY[0])).when(n("reliability") != 0, F.lit(RELIABILITY[1])).otherwise(F.lit(RELIABILITY[2]))
    good = lambda test: F.when(test, F.lit("positive")).otherwise(F.lit("neutral"))
    factor = lambda key, impact, value, detail: F.struct(F.lit(key).alias("key"), impact.alias("impact"), value.alias("value"), detail.alias("detail"))
    factors = F.array(
        factor("risk_adjusted_irr", good(F.col("risk_adjusted_irr") >= 0.25), text(rounded("risk_adjusted_irr", 6)), F.lit(DETAILS["risk_adjusted_irr"])), factor("payment_probability", good(F.col("payment_probability") >= 0.75), text(rounded("payment_probability", 6)), reliable),
        factor("estimated_term", F.when(F.col("term_months") <= 18, F.lit("positive")).when(F.col("term_months") >= 60, F.lit("negative")).otherwise(F.lit("neutral")), text(F.col("term_months")), term), factor("offer_rate", good(F.col("offer_rate") <= 0.6), text(rounded("offer_rate", 6)), F.lit(DETAILS["offer_rate"])),
        factor("signals", F.when(n("negative_signals") > 0, F.lit("negative")).when(n("positive_signals") > 0, F.lit("positive")).otherwise(F.lit("neutral")), F.replace(signals, F.lit("{}"), F.lit("positive /")), F.lit(DETAILS["signals"])),
    )
    return F.struct(headline.alias("headline"), summary.alias("summary"), F.struct(*breakdown).alias("breakdown"), factors.alias("factors"))


def signal_scores(assets: DataFrame) -> DataFrame:
    """Six sub-scores and the final score, a whole number, from the weights and codes of the asset's events and what is known of it.

    Needs positive_weight, negative_weight, codes, cnj_number, debtor_id and face_value; an asset with a prior cession has legal score 0.
    Sub-scores that lose half of the negative weight may end in .5.
    """
    plus, minus = (F.coalesce(c, F.lit(0)) for c in ("positive_weight", "negative_weight"))
    value = F.coalesce(F.col("face_value").cast("double"), F.lit(0.0))
    within = lambda c: clamp(c, 0, 100)
    out = assets.withColumns({
        "quality_score": 30 * (F.col("cnj_number").isNotNull().cast("int") + F.col("debtor_id").isNotNull().cast("int") + (value > 0).cast("int")),
        "maturity_score": within(F.lit(40) + 20 * has_code("requisition_issued").cast("int") + 15 * has_code("final_judgment").cast("int") + 15 * has_code("calculation_homologated").cast("int")),
        "liquidity_score": within(F.lit(45) + 35 * has_code("payment_available").cast("int") + 25 * has_code("payment_process_detected").cast("int") + 25 * has_code("direct_agreement_opened").cast("int")
                                 + 22 * has_code("direct_agreement_window").cast("int") + 20 * has_code("preferential_queue").cast("int") + 20 * has_code("superpreference_granted").cast("int") - minus / 2),
        "legal_score": F.when(has_code("prior_cession_detected"), 0).otherwise(within(F.lit(50) + plus - minus)),
        "economic_score": F.when(value >= 50_000, 70).otherwise(45),
    })
    out = out.withColumn("risk_score", within(F.lit(100) - F.col("legal_score") + minus / 2))
    final = 0.2 * F.col("quality_score") + 0.2 * F.col("maturity_score") + 0.2 * F.col("liquidity_score") + 0.3 * F.col("legal_score") + 0.1 * F.col("economic_score") - 0.1 * F.col("risk_score")
    # Ten times the weights are whole, so that the rounding sees no error of binary fractions.
    return out.withColumn("signal_score", clamp(F.floor(F.round(final, 6) + 0.5), 0, 100).cast("int"))


def changed_only(scores: DataFrame, known: DataFrame, keys: Sequence[str] = ("asset_id",), fingerprint: str = "fingerprint") -> DataFrame:
    """Scores whose fingerprint is not yet among the known ones."""
    return scores.join(known.select(*keys, fingerprint), [*keys, fingerprint], "left_anti")


def import_scores(cnj: str = "cnj_number", debtor: str = "debtor_name", value: str = "face_value", year: str = "exercise_year") -> dict[str, Column]:
    """data_quality_score: 30 for each of process number, debtor and value that is there and neither blank nor 0; final_score: 10 more.

    maturity_score: years since 2000, at most 100, negative before it; null without a year.
    """
    filled = [F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in (cnj, debtor)] + [F.col(value).cast("double") != 0]
    quality = 30 * sum((F.coalesce(test, F.lit(False)).cast("int") for test in filled), F.lit(0))
    maturity = F.when(F.col(year) != 0, F.least(F.col(year) - 2000, F.lit(100)))
    return {"data_quality_score": quality, "maturity_score": maturity, "final_score": F.least(quality + 10, F.lit(100))}


def data_quality() -> Column:
    """Issues, and status blocked, review or complete, of a row with face_value, the flags has_value, has_process and has_publication, and the counts resolved_fields, n_conflicts (of sources), n_field_conflicts and pending_candidates.

    Conflicts and candidates that wait for a review block; other issues ask for a review. Null counts are 0.
    """
    n = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    conflicts, waiting = (n("n_conflicts") > 0) | (n("n_field_conflicts") > 0), n("pending_candidates") > 0
    issues = F.array_compact(F.array(
        F.when((F.coalesce(F.col("face_value").cast("double"), F.lit(0.0)) <= 0) | no("has_value"), F.lit("missing_value")), F.when(no("has_process"), F.lit("missing_datajud")), F.when(no("has_publication"), F.lit("missing_djen")),
        F.when(n("resolved_fields") < 4, F.lit("missing_field_evidence")), F.when(conflicts, F.lit("conflicts")), F.when(waiting, F.lit("candidate_review")),
    ))
    status = F.when(conflicts | waiting, F.lit("blocked")).when(F.size(issues) == 0, F.lit("complete")).otherwise(F.lit("review"))
    return F.struct(issues.alias("issues"), status.alias("status"))
