"""Queries of the desk, timeline, dossier, coverage and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import coverage, desk, evidence, legal, pricing, relational, timeline
from quarry.plans import bindings as b
from quarry.plans.queries import _COHERENCE_SQL, _FLAGS_SQL, _PRICE_SQL, _QUALITY_SQL, _coherence, _flags, _priced, query

_STAGES = ("inbox", "qualified", "offer", "due_diligence", "cession", "paid", "lost", "won")
_STAGED = _PRICE_SQL + ", staged AS (SELECT g.*, a.debtor_name, a.cnj_number, [" + ", ".join(f"'{s}'" for s in _STAGES) + "][(asset_id % 8 + 1)::INT] AS stage FROM graded g JOIN (SELECT asset_id, debtor_name, cnj_number FROM assets) a USING (asset_id))"


def _staged(spark: SparkSession, d: str) -> DataFrame:
    stage = F.get(F.array(*map(F.lit, _STAGES)), F.pmod("asset_id", F.lit(8)).cast("int"))
    return _priced(spark, d).join(b.assets(spark, d).select("asset_id", "cnj_number"), "asset_id").withColumns({"stage": stage, "asset_number": F.col("asset_id").cast("string"), "source": F.when(F.col("asset_id") % 2 == 0, F.lit("siop")).otherwise(F.lit("tribunal"))})


@query(_STAGED + """, s AS (SELECT 'inbox' AS section, * FROM staged WHERE stage = 'inbox' AND grade = 'A+' UNION ALL SELECT 'pipeline', * FROM staged WHERE stage IN ('qualified', 'offer', 'due_diligence', 'cession') UNION ALL SELECT 'portfolio', * FROM staged WHERE stage = 'paid' OR lifecycle_status = 'paid')
SELECT section, count(asset_id) AS n, round(coalesce(sum(face_value), 0), 2) AS face_value, round(coalesce(avg(risk_irr), 0), 6) AS average_return, round(coalesce(avg(probability), 0), 6) AS average_probability FROM (VALUES ('inbox'), ('pipeline'), ('portfolio')) v(section) LEFT JOIN s USING (section) GROUP BY section""")
def operations_desk(spark: SparkSession, d: str) -> DataFrame:
    out = desk.desk(_staged(spark, d))
    return out.select("section", "n", F.round("face_value", 2).alias("face_value"), F.round("average_return", 6).alias("average_return"), F.round("average_probability", 6).alias("average_probability"))


@query(_STAGED + " SELECT 'all' AS name, count(*) AS n, round(sum(face_value), 2) AS face_value, round(avg(risk_irr), 6) AS average_return FROM staged UNION ALL SELECT 'none', 0, 0, 0")
def opportunity_summary(spark: SparkSession, d: str) -> DataFrame:
    """Sums and averages are 0 where there are no rows."""
    rows = _staged(spark, d)
    of = lambda name, where: desk.summary(rows, where).select(F.lit(name).alias("name"), "n", F.round("face_value", 2).alias("face_value"), F.round("average_return", 6).alias("average_return"))
    return of("all", None).unionAll(of("none", F.col("stage") == "nowhere"))


@query(_STAGED + """ SELECT asset_id FROM staged WHERE grade = 'B+' AND stage = 'offer' AND asset_id % 2 = 0 AND risk_irr >= 0.05 AND face_value BETWEEN 20000 AND 400000 AND contains(lower(concat_ws(' ', cnj_number, asset_id, debtor_name)), 'customer#0')""")
def opportunity_filters(spark: SparkSession, d: str) -> DataFrame:
    return desk.opportunities(_staged(spark, d), grade="B+", stage="offer", source="siop", min_return=5, min_face=20_000, max_face=400_000, q="CUSTOMER#0").select("asset_id")


@query(_STAGED + """ SELECT asset_id, CASE WHEN face_value <= 0 OR grade = 'D' OR NOT (grade IN ('A+', 'A') OR risk_irr >= 0.25) THEN 'skipped' WHEN asset_id % 3 = 0 THEN 'updated' ELSE 'created' END AS outcome FROM staged""")
def intake_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return desk.intake(_staged(spark, d).withColumn("known", F.col("asset_id") % 3 == 0)).select("asset_id", "outcome")


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).withColumn("status", pricing.data_quality()["status"])


@query(_QUALITY_SQL + """ SELECT count(*) AS total, count(*) FILTER (i1) AS missing_value, count(*) FILTER (i2) AS missing_datajud, count(*) FILTER (i3) AS missing_djen, count(*) FILTER (i4) AS missing_field_evidence, count(*) FILTER (i5) AS conflicts,
  count(*) FILTER (i6) AS candidate_review, count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (status = 'complete') AS complete FROM quality""")
def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    return desk.quality_summary(_evidence(spark, d))


@query(_QUALITY_SQL + " SELECT 'missing_value' AS issue, count(*) AS n FROM q WHERE i1 UNION ALL SELECT 'conflicts', count(*) FROM q WHERE i5 UNION ALL SELECT 'candidate_review', count(*) FROM q WHERE i6")
def issue_filters(spark: SparkSession, d: str) -> DataFrame:
    rows = _evidence(spark, d)
    out = [desk.opportunities(rows, issue=issue).agg(F.count("*").alias("n")).select(F.lit(issue).alias("issue"), "n") for issue in ("missing_value", "conflicts", "candidate_review")]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query("""
, s AS (SELECT asset_id, event_id, event_type, CASE WHEN event_type IN ('error') THEN 1 ELSE 0 END AS neg, CASE WHEN event_id % 50 > 0 THEN event_at END AS event_at FROM asset_events),
n AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY neg, event_id) AS place FROM s)
SELECT asset_id, event_id, event_type FROM n WHERE event_at IS NULL OR event_at >= TIMESTAMP '2024-01-30' - INTERVAL 24 HOUR ORDER BY asset_id, place LIMIT 12""")
def critical_signals(spark: SparkSession, d: str) -> DataFrame:
    s = b.events(spark, d).select("asset_id", F.struct("event_id", "event_type", F.when(F.col("event_id") % 50 > 0, F.col("event_at").cast("timestamp")).alias("event_at")).alias("s"), (F.col("event_type") == "error").alias("neg"))
    side = lambda neg: F.array_sort(F.collect_list(F.when(F.col("neg") == neg, F.col("s"))))
    rows = s.groupBy("asset_id").agg(side(False).alias("positive"), side(True).alias("negative")).withColumn("grade", F.lit("A"))
    return desk.recent_signals(rows, "2024-01-30").select("asset_id", "event_id", "event_type")


@query("""
, e AS (SELECT l_suppkey % 4 AS court, year(l_shipdate) AS reference_year, CASE WHEN l_linenumber % 2 = 0 THEN 'Fundo ' || l_partkey END AS program_name, (l_extendedprice)::DECIMAL(18,2) AS net, (l_extendedprice::DECIMAL(18,2) - 1)::DECIMAL(18,2) AS paid FROM lineitem)
SELECT count(*) AS rows, coalesce(sum(net), 0)::DECIMAL(18,2)::VARCHAR AS net_allocation_total, coalesce(sum(net), 0)::DECIMAL(18,2)::VARCHAR AS committed_amount_total, '0.00' AS liquidated_amount_total, coalesce(sum(paid), 0)::DECIMAL(18,2)::VARCHAR AS paid_amount_total
FROM e WHERE court = 2 AND reference_year = 1995 AND contains(lower(program_name), 'fundo 1')""")
def budget_execution_summary(spark: SparkSession, d: str) -> DataFrame:
    none, price = F.lit(None).cast("string"), F.col("l_extendedprice")
    rows = b.read(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 4).alias("court"), F.year("l_shipdate").alias("reference_year"), none.alias("budget_unit_name"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Fundo "), F.col("l_partkey").cast("string"))).alias("program_name"), none.alias("action_name"), none.alias("funding_source_name"),
        price.cast("decimal(18,2)").alias("net_allocation"), price.cast("decimal(18,2)").alias("committed_amount"), F.lit(None).cast("decimal(18,2)").alias("liquidated_amount"), (price.cast("decimal(18,2)") - 1).cast("decimal(18,2)").alias("paid_amount"),
    )
    return desk.budget_summary(desk.budget_rows(rows, q="FUNDO 1", court=2, reference_year=1995, source_kind=None))


@query(_PRICE_SQL + """, c AS (SELECT asset_id, codes, lifecycle_status FROM graded), r AS (
  SELECT asset_id, CASE WHEN list_contains(codes, 'prior_cession_detected') THEN 'blocked' ELSE 'passed' END AS a, CASE WHEN list_contains(codes, 'lien_detected') THEN 'review' ELSE 'passed' END AS b,
    CASE WHEN list_contains(codes, 'suspension_detected') THEN 'blocked' WHEN list_contains(codes, 'objection_pending') OR lifecycle_status = 'suspended' THEN 'review' ELSE 'passed' END AS c,
    CASE WHEN list_has_any(codes, ['payment_available', 'direct_agreement_opened', 'superpreference_granted']) THEN 'passed' ELSE 'review' END AS f FROM c)
SELECT asset_id, concat_ws(',', a, b, c, 'passed', 'passed', f) AS states FROM r""")
def liquidity_checklist(spark: SparkSession, d: str) -> DataFrame:
    return _priced(spark, d).select("asset_id", F.array_join(F.transform(desk.checklist(), lambda x: x["state"]), ",").alias("states"))


@query(_STAGED + r""" SELECT asset_id, 'Grade ' || grade || ': ' || CASE grade WHEN 'A+' THEN 'prioritize commercial action' WHEN 'A' THEN 'commercially attractive' WHEN 'B+' THEN 'commercially attractive' WHEN 'D' THEN 'avoid until risk clears' ELSE 'monitor and complete diligence' END AS headline,
  'Score ' || grade || ' from ' || regexp_replace(printf('%.2f', round(risk_irr * 100, 2)), '\.?0+$', '') || '% risk-adjusted IRR, ' || regexp_replace(printf('%.2f', round(probability * 100, 2)), '\.?0+$', '') || '% payment probability, ' || term_months || ' month estimated term, ' || positive_signals || ' positive and ' || negative_signals || ' negative signals' AS summary,
  concat_ws(',', CASE WHEN risk_irr >= 0.25 THEN 'positive' ELSE 'neutral' END, CASE WHEN probability >= 0.75 THEN 'positive' ELSE 'neutral' END, CASE WHEN term_months <= 18 THEN 'positive' WHEN term_months >= 60 THEN 'negative' ELSE 'neutral' END, CASE WHEN offer_rate <= 0.6 THEN 'positive' ELSE 'neutral' END, CASE WHEN negative_signals > 0 THEN 'negative' WHEN positive_signals > 0 THEN 'positive' ELSE 'neutral' END) AS impacts,
  positive_signals || ' positive / ' || negative_signals || ' negative' AS signals, CASE WHEN reliability > 0 THEN 'Uses debtor reliability score when historical payment rate is unavailable.' ELSE 'Uses conservative default reliability by debtor type.' END AS reliability,
  CASE WHEN list_contains(codes, 'payment_available') THEN 'Payment available signal sets a short expected exit window.' WHEN list_contains(codes, 'payment_process_detected') THEN 'Payment-process document indicates near-term liquidity.' WHEN list_contains(codes, 'superpreference_granted') THEN 'Superpreference signal shortens expected queue time.'
    WHEN queue_position <= 100 THEN 'Queue position ' || queue_position || ' shortens the estimated term.' ELSE 'Falls back to debtor type, payment regime and lifecycle status.' END AS term,
  round(0.4::DOUBLE * least(greatest((risk_irr - 0.05::DOUBLE) / 0.55::DOUBLE, 0), 1), 6) AS irr_part, round(0.25::DOUBLE * probability, 6) AS probability_part, round(0.2::DOUBLE * (1 - least(greatest((term_months - 1) / 59.0::DOUBLE, 0), 1)), 6) AS term_part, round(0.15::DOUBLE * least(greatest((face_value - 50000) / 4950000.0::DOUBLE, 0), 1), 6) AS face_part FROM staged""")
def price_explanations(spark: SparkSession, d: str) -> DataFrame:
    """Headline, summary, impacts, details that depend on the row, and what each part adds to the score."""
    rows = _priced(spark, d).withColumn("e", pricing.explanation())
    parts = zip(("irr_part", "probability_part", "term_part", "face_part"), pricing.PARTS, strict=True)
    return rows.select("asset_id", "e.headline", "e.summary", F.array_join(F.transform("e.factors", lambda f: f["impact"]), ",").alias("impacts"), F.col("e.factors")[4]["value"].alias("signals"), F.col("e.factors")[1]["detail"].alias("reliability"), F.col("e.factors")[2]["detail"].alias("term"), *(F.col(f"e.breakdown.{part}.contribution").alias(name) for name, part in parts))


_TIMELINE = """, t AS (
  SELECT a.asset_id, CASE WHEN a.asset_id % 10 > 0 THEN cnj_number END AS cnj_number, CASE WHEN a.asset_id % 11 > 0 THEN debtor_id END AS debtor_id, court_id, coalesce(v.n, 0) AS valuations, (a.asset_id % 2) AS budget_facts, coalesce(e.processes, 0) AS processes, (a.asset_id % 4 = 0)::INT AS candidates,
    (a.asset_id % 8 = 0)::INT AS pending, coalesce(e.publications, 0) AS publications, (a.asset_id % 5 > 0)::INT AS scores, CASE WHEN a.asset_id % 5 > 0 THEN a.asset_id % 101 END AS score, a.asset_id % 3 = 0 AS has_opportunity, coalesce(l.n, 0) AS source_links
  FROM assets a LEFT JOIN (SELECT asset_id, count(*) AS n FROM valuations GROUP BY ALL) v USING (asset_id) LEFT JOIN (SELECT asset_id, count(*) FILTER (event_type = 'view') AS processes, count(*) FILTER (event_type = 'click') AS publications FROM asset_events GROUP BY ALL) e USING (asset_id)
  LEFT JOIN (SELECT asset_id, count(*) AS n FROM links WHERE role = 'primary' GROUP BY ALL) l USING (asset_id))"""


def _timeline(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("asset_id")
    of = lambda df, kind: df.select("asset_id", F.lit(kind).alias("kind"))
    events = b.events(spark, d)
    told = of(b.valuations(spark, d), "valuations").unionAll(of(events.where("event_type = 'view'"), "processes")).unionAll(of(events.where("event_type = 'click'"), "publications")).unionAll(of(b.links(spark, d).where("role = 'primary'"), "source_links"))
    rows = b.assets(spark, d).select("asset_id", F.when(k % 10 > 0, F.col("cnj_number")).alias("cnj_number"), F.when(k % 11 > 0, F.col("debtor_id")).alias("debtor_id"), "court_id")
    rows = rows.join(relational.counts_by_kind(told, ["asset_id"], "kind", ["valuations", "processes", "publications", "source_links"]), "asset_id", "left")
    return rows.fillna(0, ["valuations", "processes", "publications", "source_links"]).withColumns({
        "budget_facts": k % 2, "candidates": (k % 4 == 0).cast("int"), "pending_candidates": (k % 8 == 0).cast("int"), "scores": (k % 5 > 0).cast("int"), "score": F.when(k % 5 > 0, k % 101), "has_opportunity": k % 3 == 0, "has_source": F.lit(None).cast("boolean"),
    })


@query(_TIMELINE + """
SELECT asset_id, concat_ws(',', CASE WHEN cnj_number IS NULL THEN 'missing_cnj_number' END, CASE WHEN debtor_id IS NULL THEN 'missing_debtor' END, CASE WHEN valuations = 0 THEN 'missing_valuation_snapshot' END, CASE WHEN budget_facts = 0 THEN 'missing_budget_fact' END,
    CASE WHEN processes = 0 AND candidates = 0 THEN 'missing_datajud_process_link' END, CASE WHEN pending > 0 THEN 'pending_process_candidate_review' END, CASE WHEN publications = 0 THEN 'missing_publication_history' END, CASE WHEN scores = 0 THEN 'missing_score_history' END) AS gaps,
  floor(100.0::DOUBLE * ((source_links > 0)::INT + (cnj_number IS NOT NULL)::INT + (debtor_id IS NOT NULL)::INT + 1 + (valuations > 0)::INT + (budget_facts > 0)::INT + (processes > 0 OR candidates > 0)::INT + (publications > 0)::INT + (scores > 0)::INT) / 9 + 0.5)::INT AS completeness,
  concat_ws(',', CASE WHEN cnj_number IS NULL THEN 'enrich_asset_from_datajud' END, CASE WHEN pending > 0 THEN 'review_datajud_candidates' END, CASE WHEN processes = 0 AND candidates > 0 THEN 'promote_best_process_candidate' END, CASE WHEN publications = 0 THEN 'sync_djen_publications' END,
    CASE WHEN scores = 0 THEN 'recompute_asset_score' END, CASE WHEN NOT has_opportunity AND coalesce(score, 0) >= 85 THEN 'create_cession_opportunity' END) AS actions FROM t""")
def asset_timelines(spark: SparkSession, d: str) -> DataFrame:
    rows = _timeline(spark, d).withColumn("gaps", timeline.gaps()).withColumn("actions", timeline.next_actions())
    return rows.select("asset_id", F.array_join("gaps", ",").alias("gaps"), timeline.completeness().alias("completeness"), F.array_join("actions", ",").alias("actions"))


_CHECKED = _TIMELINE + """, c AS (SELECT *, (cnj_number IS NOT NULL)::INT + (debtor_id IS NOT NULL)::INT + 1 AS identities FROM t),
s AS (SELECT *, CASE WHEN source_links > 0 THEN 2 ELSE 0 END AS s1, CASE WHEN identities = 3 THEN 2 WHEN identities = 2 THEN 1 ELSE 0 END AS s2, CASE WHEN processes > 0 THEN 2 WHEN candidates > 0 THEN 1 ELSE 0 END AS s3, CASE WHEN publications > 0 AND processes > 0 THEN 2 WHEN publications > 0 THEN 1 ELSE 0 END AS s4,
  CASE WHEN valuations > 0 AND budget_facts > 0 THEN 2 WHEN valuations > 0 OR budget_facts > 0 THEN 1 ELSE 0 END AS s5, CASE WHEN processes > 0 OR publications >= 2 THEN 2 WHEN publications > 0 THEN 1 ELSE 0 END AS s6, CASE WHEN scores > 0 THEN 2 ELSE 0 END AS s7, CASE WHEN has_opportunity AND asset_id % 2 = 0 THEN 2 WHEN has_opportunity THEN 1 ELSE 0 END AS s8 FROM c)"""


@query(_CHECKED + """, g AS (SELECT *, floor((15 * s1 + 20 * s2 + 15 * s3 + 10 * s4 + 15 * s5 + 10 * s6 + 10 * s7 + 5 * s8) / 2.0 + 0.5) AS score100 FROM s)
SELECT asset_id, score100::INT AS completeness, CASE WHEN score100 >= 90 THEN 'A' WHEN score100 >= 75 THEN 'B' WHEN score100 >= 55 THEN 'C' ELSE 'D' END AS grade,
  concat_ws(',', CASE WHEN asset_id % 13 = 0 THEN 'resolve_high_severity_conflicts' END, CASE WHEN s3 < 2 AND candidates > 0 THEN 'review_datajud_candidates' WHEN s3 < 2 THEN 'enrich_from_datajud' END, CASE WHEN s4 < 2 THEN 'sync_djen_publications' END, CASE WHEN s5 < 2 THEN 'backfill_financial_facts' END,
    CASE WHEN s1 < 2 THEN 'link_primary_source_evidence' END, CASE WHEN s7 < 2 THEN 'recompute_asset_score' END, CASE WHEN NOT has_opportunity AND score >= 80 THEN 'create_cession_opportunity' END) AS actions FROM g""")
def asset_dossiers(spark: SparkSession, d: str) -> DataFrame:
    checked = _dossiers(spark, d)
    score, grade = evidence.completeness({name: F.col(f"checks.{name}") for name in evidence.CHECKS})
    return checked.select("asset_id", score.alias("completeness"), grade.alias("grade"), F.array_join(F.transform(timeline.dossier_actions(), lambda x: x["key"]), ",").alias("actions"))


def _dossiers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("asset_id")
    rows = _timeline(spark, d).withColumns({
        "identities": F.col("cnj_number").isNotNull().cast("int") + F.col("debtor_id").isNotNull().cast("int") + 1, "publication_events": F.col("processes"), "process_signals": F.col("processes"), "events": F.col("publications"), "has_source": F.lit(False), "has_score": F.lit(False),
        "has_pricing": k % 2 == 0, "high_conflicts": (k % 13 == 0).cast("int"),
    })
    # publication events only count beside publications
    rows = rows.withColumn("publication_events", F.when(F.col("publications") > 0, F.col("processes")).otherwise(0))
    return rows.withColumn("checks", F.struct(*(c.alias(name) for name, c in evidence.dossier_checks().items())))


@query(_CHECKED + """, a AS (SELECT asset_id, s3, s4, candidates FROM s), own AS (SELECT asset_id, 'sync_djen_publications' AS key, 'medium' AS priority FROM a WHERE s4 < 2),
any_action AS (SELECT asset_id FROM s WHERE asset_id % 13 = 0 OR s3 < 2 OR s4 < 2 OR s5 < 2 OR s1 < 2 OR s7 < 2 OR (NOT has_opportunity AND score >= 80))
SELECT asset_id, v.key, coalesce(own.priority, 'low') AS priority FROM (SELECT * FROM any_action CROSS JOIN (VALUES ('sync_djen_publications'), ('other')) v(key)) v LEFT JOIN own USING (asset_id, key)""")
def requested_actions(spark: SparkSession, d: str) -> DataFrame:
    rows = _dossiers(spark, d).select("asset_id", F.explode(timeline.dossier_actions()).alias("x")).select("asset_id", "x.*")
    return timeline.planned(rows, ["sync_djen_publications", "other", "other"])


@query("""SELECT DISTINCT 'asset-intelligence-' || tenant_id || '-sync-' || CASE WHEN court_id % 5 = 0 THEN 'national' ELSE court END || '-' || exercise_year || '-01-01-open' AS job_id FROM assets""")
def court_jobs(spark: SparkSession, d: str) -> DataFrame:
    court = F.when(F.col("court_id") % 5 > 0, F.col("court"))
    return b.assets(spark, d).select(timeline.court_job_id("tenant_id", F.lit("sync"), court, F.make_date("exercise_year", F.lit(1), F.lit(1)), F.lit(None)).alias("job_id")).distinct()


@query(""", rule(code, polarity) AS (VALUES """ + ", ".join(f"('{code}', '{polarity}')" for code, polarity, *_ in legal.SIGNALS) + """)
SELECT kind, code, count(*) AS n FROM (SELECT CASE polarity WHEN 'negative' THEN 'risk' ELSE 'chance' END AS kind, code FROM asset_events JOIN rule USING (code)
  UNION ALL SELECT CASE WHEN x IN ('suspension_detected') THEN 'risk' ELSE 'chance' END, x FROM (SELECT ['suspension_detected', 'payment_available', 'other'][event_id % 3 + 1] AS x FROM asset_events) WHERE x <> 'other') GROUP BY ALL""")
def risk_flags(spark: SparkSession, d: str) -> DataFrame:
    events = b.events(spark, d)
    rules = spark.createDataFrame([(code, polarity) for code, polarity, *_ in legal.SIGNALS], "code string, polarity string")
    signals = events.join(F.broadcast(rules), "code").select("asset_id", "code", "polarity", F.col("event_at").alias("at"))
    kinds = events.select("asset_id", F.get(F.array(*map(F.lit, ("suspension_detected", "payment_available", "other"))), F.pmod("event_id", F.lit(3)).cast("int")).alias("event_type"), F.col("event_at").alias("at"))
    return timeline.flags(signals, kinds).groupBy("kind", "code").agg(F.count("*").alias("n"))


@query("""
, c AS (SELECT asset_id, role, CASE role WHEN 'primary' THEN 0.9 WHEN 'enrichment' THEN 0.72 END::DOUBLE AS w FROM links)
SELECT asset_id, count(*) AS links, min(w) AS minimum, round(avg(w), 4) AS average, max(w) AS maximum, count(*) FILTER (role = 'conflict') AS conflicts FROM c GROUP BY asset_id""")
def evidence_graphs(spark: SparkSession, d: str) -> DataFrame:
    rows = b.links(spark, d).withColumn("confidence", F.when(F.col("role") == "primary", 0.9).when(F.col("role") == "enrichment", 0.72))
    return timeline.evidence_graph(rows).select("asset_id", "links", "minimum", "average", "maximum", F.coalesce(F.col("by_role")["conflict"], F.lit(0)).alias("conflicts"))


@query("""SELECT asset_id, role AS kind, array_to_string(list_sort(list(DISTINCT source_id)), ',') AS ids FROM links WHERE role IN ('primary', 'conflict') GROUP BY ALL""")
def identifier_values(spark: SparkSession, d: str) -> DataFrame:
    rows = b.links(spark, d).select("asset_id", F.col("role").alias("kind"), F.col("source_id").alias("value"))
    return timeline.distinct_values(rows, ["primary", "conflict"]).select("asset_id", "kind", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("ids"))


@query("""
, at AS (SELECT asset_id, computed_at AS t FROM valuations UNION ALL SELECT asset_id, event_at FROM asset_events), m AS (SELECT asset_id, max(t) AS latest_at FROM at GROUP BY asset_id)
SELECT asset_id, latest_at, floor(date_diff('second', latest_at, TIMESTAMP '2024-02-10') / 86400)::INT AS age, coalesce(floor(date_diff('second', latest_at, TIMESTAMP '2024-02-10') / 86400) > 30, true) AS stale FROM assets LEFT JOIN m USING (asset_id)""".replace("at AS (SELECT asset_id, computed_at", "seen AS (SELECT asset_id, computed_at").replace("FROM at GROUP", "FROM seen GROUP"))
def evidence_freshness(spark: SparkSession, d: str) -> DataFrame:
    seen = b.valuations(spark, d).select("asset_id", F.col("computed_at").cast("timestamp_ntz").alias("at")).unionAll(b.events(spark, d).select("asset_id", F.col("event_at").cast("timestamp_ntz")))
    return timeline.freshness(seen, b.assets(spark, d).select("asset_id"), "2024-02-10")


_STATES = """, st AS (SELECT c_custkey AS id, ['missing', 'mapped', 'configured', 'validated', 'blocked'][c_custkey % 5 + 1] AS "primary", ['missing', 'configured', 'validated'][c_custkey % 3 + 1] AS datajud, ['validated', 'missing'][c_custkey % 2 + 1] AS djen FROM customer),
si AS (SELECT *, "primary" IN ('validated', 'configured') AS hp, datajud IN ('validated', 'configured') AS hj, djen = 'validated' AS hd FROM st)"""


def _states(spark: SparkSession, d: str) -> DataFrame:
    turn = lambda values: F.get(F.array(*map(F.lit, values)), F.pmod("c_custkey", F.lit(len(values))).cast("int"))
    return b.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), turn(("missing", "mapped", "configured", "validated", "blocked")).alias("primary"), turn(("missing", "configured", "validated")).alias("datajud"), turn(("validated", "missing")).alias("djen"))


@query(_STATES + """ SELECT id, hp AND hj AND hd AS ready, "primary" = 'validated' OR datajud = 'validated' OR djen = 'validated' AS has_evidence,
  concat_ws(',', CASE "primary" WHEN 'missing' THEN 'primary_source_missing' WHEN 'mapped' THEN 'primary_source_mapped_without_adapter' WHEN 'configured' THEN 'primary_source_not_validated' END, CASE WHEN datajud = 'missing' THEN 'datajud_missing' END, CASE WHEN djen = 'missing' THEN 'djen_missing' END,
    CASE WHEN NOT (hp AND hj AND hd) THEN 'operational_scoring_incomplete' END) AS gaps FROM si""")
def state_coverage(spark: SparkSession, d: str) -> DataFrame:
    return coverage.state_intelligence(_states(spark, d)).select("id", "ready", "has_evidence", F.array_join(F.transform("gaps", lambda x: x["code"]), ",").alias("gaps"))


@query(_STATES + """ SELECT count(*) AS states, count(*) FILTER ("primary" = 'missing') AS missing, count(*) FILTER ("primary" = 'blocked') AS blocked, count(*) FILTER ("primary" = 'mapped') AS mapped, count(*) FILTER ("primary" = 'configured') AS configured, count(*) FILTER ("primary" = 'validated') AS validated,
  count(*) FILTER (datajud <> 'missing') AS datajud, count(*) FILTER (djen <> 'missing') AS djen FROM st""")
def matrix_totals(spark: SparkSession, d: str) -> DataFrame:
    return coverage.matrix_summary(_states(spark, d))


@query(_COHERENCE_SQL + """, r AS (SELECT *, CASE WHEN assets > 0 AND NOT (c1 < assets OR conflicts > 0 OR field_conflicts > 0) AND complete >= 0.95 * assets THEN 1 ELSE 0 END AS ready, CASE WHEN assets > 0 AND (c1 < assets OR conflicts > 0 OR field_conflicts > 0) THEN 1 ELSE 0 END AS critical FROM per_court)
SELECT sum(assets)::BIGINT AS assets, sum(complete)::BIGINT AS complete_assets, round(sum(complete) / sum(assets)::DOUBLE, 4) AS complete, round(sum(c1) / sum(assets)::DOUBLE, 4) AS has_primary_source, round(sum(c2) / sum(assets)::DOUBLE, 4) AS has_process, round(sum(c3) / sum(assets)::DOUBLE, 4) AS has_publication,
  round(sum(c4) / sum(assets)::DOUBLE, 4) AS has_value, round(sum(c5) / sum(assets)::DOUBLE, 4) AS has_score, round(sum(c6) / sum(assets)::DOUBLE, 4) AS has_evidence, round(sum(c7) / sum(assets)::DOUBLE, 4) AS has_resolved, sum(conflicts)::BIGINT AS conflicts, sum(field_conflicts)::BIGINT AS field_conflicts, sum(pending)::BIGINT AS pending,
  count(*) AS courts, count(*) FILTER (assets > 0) AS courts_with_assets, sum(ready)::BIGINT AS ready_courts, sum(critical)::BIGINT AS critical_courts FROM r""")
def coherence_totals(spark: SparkSession, d: str) -> DataFrame:
    return coverage.coherence_summary(_coherence(spark, d))


@query("""
, a AS (SELECT asset_id, CASE WHEN asset_id % 9 > 0 THEN cnj_number END AS n, asset_id % 2 = 0 AS p, ['siop', 'tribunal'][asset_id % 2 + 1] AS source, 'trf' || substr(cnj_number, 20, 1) AS court FROM assets),
g AS (SELECT source AS "group", n, p FROM a UNION ALL SELECT CASE WHEN n IS NULL THEN 'unknown' ELSE court END, n, p FROM a UNION ALL SELECT 'total', n, p FROM a)
SELECT "group", count(*) AS assets, count(n) AS numbered, count(*) FILTER (n IS NOT NULL AND p) AS with_process, 0::BIGINT AS no_court, CASE WHEN count(n) > 0 THEN round(100.0::DOUBLE * count(*) FILTER (n IS NOT NULL AND p) / count(n), 2) ELSE 0 END AS percent FROM g GROUP BY ALL""")
def process_coverage(spark: SparkSession, d: str) -> DataFrame:
    from quarry.functions.text import court_of_process

    rows = b.assets(spark, d).select("asset_id", F.when(F.col("asset_id") % 9 > 0, F.col("cnj_number")).alias("cnj_number"), (F.col("asset_id") % 2 == 0).alias("has_process"), F.when(F.col("asset_id") % 2 == 0, F.lit("siop")).otherwise(F.lit("tribunal")).alias("source"))
    rows = rows.withColumn("courts", F.array_compact(F.array(court_of_process("cnj_number"))))
    own = F.when(F.size("courts") > 0, F.col("courts")).otherwise(F.array(F.lit("unknown")))
    return coverage.process_coverage(rows, F.concat(F.array(F.lit("total"), F.col("source")), own))


@query("""
, s AS (SELECT s_nationkey AS g, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 7 END AS records, s_suppkey % 5 AS discovered, s_suppkey % 4 AS imported, s_suppkey % 6 = 0 AS ok, ['active', 'blocked', 'error', NULL][s_suppkey % 4 + 1] AS status, s_suppkey % 11 = 0 AS manual FROM supplier)
SELECT g AS nation, count(*) AS sources, coalesce(sum(records), 0)::BIGINT AS records, sum(discovered)::BIGINT AS discovered, sum(imported)::BIGINT AS imported, count(*) FILTER (coalesce(records, 0) > 0 OR ok) AS covered, count(*) FILTER (coalesce(status, '') = 'blocked' OR manual) AS manual_or_blocked, count(*) FILTER (coalesce(status, '') = 'error') AS errors FROM s GROUP BY g""")
def coverage_map(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = b.read(spark, d, "supplier").select(
        F.col("s_nationkey").alias("nation"), F.when(k % 3 > 0, k % 7).alias("records"), (k % 5).alias("discovered"), (k % 4).alias("imported"), F.when(k % 6 == 0, F.lit("2024-01-01")).alias("last_success_at"), F.get(F.array(*map(F.lit, ("active", "blocked", "error", None))), F.pmod(k, F.lit(4)).cast("int")).alias("status"),
        F.lit(None).cast("int").alias("blocked_links"), F.when(k % 11 == 0, F.lit("x")).alias("manual_url"), F.lit(None).cast("string").alias("last_error_at"),
    )
    return coverage.source_groups(rows, "nation")
