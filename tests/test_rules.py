"""Rules on rows of known outcome, typed from the rules themselves."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import maths
from quarry.operators import coverage, evidence, legal, pricing, relational
from quarry.sources import tribunals


def test_fatal_acts(spark):
    texts = {
        "Recolhimento de custas.": ("court_costs", "medium", ["fatal_act_without_deadline"], "low"),
        "Penhora de bens.": ("attachment", "high", ["fatal_act_without_deadline"], "low"),
        "Pauta de julgamento: sessão em 10/08/2026.": ("judgment_docket", "medium", [], "low"),
        "Retorno dos autos.": ("case_return", "medium", [], "high"),
        "Ato ordinatório.": ("other", "low", [], "low"),
        "Diga a parte.": ("other", "high", ["manifestation_without_explicit_deadline"], "low"),
        "Prazo de 90 dias.": ("other", "medium", ["unusually_long_deadline"], "low"),
        "Sentença de improcedência, sem prazo.": ("sentence", "medium", ["text_denies_deadline_but_deadline_was_detected"], "low"),
    }
    rows = legal.interpret(spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect()
    assert {r.text: (r.act_type, r.priority, r.review_reasons, r.confidence) for r in rows} == texts


def test_conflicts_block(spark):
    shape = "face_value double, has_value boolean, has_process boolean, has_publication boolean, resolved_fields int, n_conflicts int, n_field_conflicts int, pending_candidates int"
    cases = [
        ((1.0, True, True, True, 4, 0, 0, 0), ("complete", [])), ((0.0, True, True, True, 4, None, None, None), ("review", ["missing_value"])), ((1.0, None, False, None, 3, 0, 0, 0), ("review", ["missing_value", "missing_datajud", "missing_djen", "missing_field_evidence"])),
        ((1.0, True, True, True, 4, 0, 1, 0), ("blocked", ["conflicts"])), ((1.0, True, True, True, 4, 1, 0, 2), ("blocked", ["conflicts", "candidate_review"])),
    ]
    for row, wanted in cases:
        got = spark.createDataFrame([row], shape).select(pricing.data_quality().alias("q")).first().q
        assert (got.status, got.issues) == wanted, row


def test_coherence_of_courts(spark):
    flags = "court string, has_primary_source boolean, has_process boolean, has_publication boolean, has_value boolean, has_score boolean, evidence int, resolved_fields int, n_conflicts int, n_field_conflicts int, pending_candidates int"
    rows = [("whole",) + (True,) * 5 + (4, 4, 0, 0, 0), ("usable",) + (True,) * 5 + (4, 4, 0, 0, 0), ("usable", True, True, True, False, True, 1, 3, 0, 0, 1), ("bad",) + (True,) * 5 + (4, 4, 0, 1, 0), ("thin", True, False, True, True, True, 0, 4, None, None, None)]
    report = coverage.coherence(spark.createDataFrame(rows, flags), every=spark.createDataFrame([("none",)], "court string"))
    got = {r.court: (r.status, [(g.code, g.severity, g.missing) for g in r.gaps]) for r in report.collect()}
    assert got == {
        "whole": ("complete", []), "usable": ("usable", [("missing_valuation", "medium", 1), ("missing_field_evidence", "medium", 1), ("pending_candidate_review", "medium", 1)]), "bad": ("critical", [("field_evidence_conflicts", "high", 1)]),
        "thin": ("partial", [("missing_datajud_process", "medium", 1)]), "none": ("partial", [("no_assets", "medium", 0)]),
    }
    total = coverage.coherence_summary(report).first()
    assert (total.assets, total.complete_assets, total.courts, total.courts_with_assets, total.ready_courts, total.critical_courts) == (5, 2, 5, 4, 1, 1)


def test_signal_score_is_whole(spark):
    shape = "positive_weight int, negative_weight int, codes array<string>, cnj_number string, debtor_id int, face_value double"
    score = lambda *row: pricing.signal_scores(spark.createDataFrame([row], shape)).first()
    plain = score(None, None, None, "x", 1, 60_000.0)
    assert (plain.quality_score, plain.maturity_score, plain.liquidity_score, plain.legal_score, plain.economic_score, plain.risk_score, plain.signal_score) == (90, 40, 45, 50, 70, 50, 52)
    paid = score(18, 0, ["payment_process_detected"], "x", 1, 60_000.0)
    assert paid.liquidity_score == 70 and score(16, 0, ["superpreference_granted"], "x", 1, 1.0).liquidity_score == 65
    ceded = score(0, 100, ["prior_cession_detected"], None, None, None)
    assert (ceded.legal_score, ceded.risk_score, ceded.signal_score) == (0, 100, 3)


@pytest.mark.parametrize("codes, blocked, review, wanted", [(["payment_available"], 0, 0, ("ready", "private_cession")), (["direct_agreement_opened"], 0, 0, ("ready", "direct_agreement")), ([], 0, 1, ("review", "private_cession")), (["lien_detected"], 1, 0, ("blocked", "hold_and_wait"))])
def test_liquidity(spark, codes, blocked, review, wanted):
    shape = "positive_signals int, negative_signals int, review_items int, blocked_items int, payment_probability double, term_months int, final_score double, codes array<string>"
    row = evidence.advise(spark.createDataFrame([(1, 0, review, blocked, 0.8, 12, 0.5, codes)], shape)).first()
    assert (row.advice_state, row.recommended_channel) == wanted and all(isinstance(c.fit, int) for c in row.channels)


def test_scores_of_runs_and_imports(spark):
    one = spark.createDataFrame([(1,)], "x int")
    score = lambda *v: one.select(coverage.coverage_score(*map(F.lit, v)).alias("s")).first().s
    assert [score("failed", 0, 9, 9, 9), score("completed", 1, 9, 0, 0), score("completed", 0, 0, 1, 0), score("completed", 0, 0, 0, 3), score("completed", 0, 0, 0, 0)] == [0.0, 0.5, 1.0, 0.75, 0.25]
    rows = spark.createDataFrame([("a", True), ("a", False), ("b", False), ("c", True), ("d", None)], "i string, valid boolean")
    assert {r.i: r.status for r in tribunals.import_status(rows, "i").collect()} == {"a": "partial", "b": "failed", "c": "completed", "d": "completed"}
    checks = {"source_evidence": F.lit("complete"), "canonical_identity": F.lit("complete"), "judicial_process": F.lit("complete"), "publication_history": F.lit("complete"), "financial_facts": F.lit("complete"), "legal_signals": F.lit("complete"), "scoring": F.lit("complete"), "operation": F.lit("partial")}
    value, grade = evidence.completeness(checks)
    assert tuple(one.select(value.alias("v"), grade.alias("g")).first()) == (98, "A")  # 97.5


def test_explained_halves(spark):
    """A share of which a hundred times a hundred is a whole and a half goes up, whatever the text of its percentage; a part just below its half stays down."""
    row = spark.createDataFrame([(0.10674999999999998, 0.00653)], "share double, part double").select(pricing._percent(F.col("share")).alias("p"), maths.rounded(F.lit(0.15) * F.col("part"), 6).alias("c")).first()
    assert (row.p, row.c) == ("10.68%", 0.000979)


def test_many_alike_candidates(spark):
    """Processes that no rule tells apart give the lowest ids only; assets without a number share them, also where cause or year is null."""
    a = spark.createDataFrame([(i, None if i % 2 else "", 3, 2000, None if i % 3 else 2000, "Aposentadoria especial" if i % 5 else None) for i in range(60)] + [(5000, "0000007-00.2001.4.03.0000", 3, 2001, 2001, "x")], "asset_id long, cnj_number string, court int, filed_year int, proposal_year int, cause string")
    p = spark.createDataFrame([(i, f"{i % 9:07d}-00.2000.4.03.0000", 3, 2000, 1265 + i % 2, "Precatório", ("Aposentadoria", "Outro")[i % 3 % 2]) for i in range(180)], "process_id long, cnj string, p_court int, p_year int, class_code int, class_name string, subject string")
    found = evidence.match_candidates(a, p).drop("status").collect()
    score, signals = evidence.candidate_score()
    plain = a.where("coalesce(cnj_number, '') = ''").crossJoin(p).where("court = p_court and filed_year = p_year").unionByName(a.where("asset_id = 5000").crossJoin(p).where("substr(cnj, 1, 7) = '0000007'"))
    wanted = relational.top_by(plain.withColumns({"score": score, "signals": signals}).where("score >= 35"), ["asset_id"], [F.desc("score"), F.asc("process_id")], 5).select("asset_id", "process_id", "score", "signals")
    assert sorted(map(str, found)) == sorted(map(str, wanted.collect())) and len(found) > 200


def test_candidates_of_a_crowded_court(spark):
    """20,000 assets and as many processes of one court and year: pair by pair they would be 400 million."""
    a = spark.range(20_000).selectExpr("id AS asset_id", "CAST(NULL AS string) AS cnj_number", "3 AS court", "2000 AS filed_year", "2000 AS proposal_year", "'Aposentadoria' AS cause")
    p = spark.range(20_000).selectExpr("id AS process_id", "concat(lpad(string(id), 7, '0'), '-00.2000.4.03.0000') AS cnj", "3 AS p_court", "2000 AS p_year", "1265 AS class_code", "'Precatório' AS class_name", "'Aposentadoria' AS subject")
    assert evidence.match_candidates(a, p).agg(F.count("*"), F.max("process_id"), F.min("score")).first()[:2] == (100_000, 4)
