"""Queries over publications: signals, interpretation, deadlines, agenda, monitoring and the classification flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import dates
from quarry.operators import legal, publications
from quarry.plans import bindings as b
from quarry.plans.queries import query

_TEXT = ", p AS (SELECT *, lower(strip_accents(text)) AS t FROM publications)"
_CODES = ", ".join(f"('{code}', {confidence}, '{pattern}')" for code, _, confidence, _, pattern in legal.SIGNALS)


@query(f"""{_TEXT}, rule(code, confidence, pattern) AS (VALUES {_CODES})
SELECT code, count(*) AS publications, count(DISTINCT asset_id) AS assets, max(confidence)::INT AS confidence FROM p JOIN rule ON regexp_matches(t, pattern) GROUP BY code""")
def publication_signals(spark: SparkSession, d: str) -> DataFrame:
    found = legal.classify(b.publications(spark, d), "text", ["publication_id", "asset_id"])
    return found.groupBy("code").agg(F.count("*").alias("publications"), F.countDistinct("asset_id").alias("assets"), F.max("confidence").alias("confidence"))


# Typed from the rules, not from the library.
_FIFTEEN = "'citation', 'sentence', 'embargos_decision', 'appellate_decision', 'article_523_notice', 'interlocutory_decision', 'compliance_challenge', 'monocratic_decision', 'counterarguments', 'extrajudicial_execution'"
_FATAL = "'citation', 'sentence', 'embargos_decision', 'appellate_decision', 'article_523_notice', 'interlocutory_decision', 'compliance_challenge', 'monocratic_decision', 'judgment_docket', 'counterarguments', 'extrajudicial_execution', 'attachment', 'case_return', 'court_costs'"
_ACT = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '{pattern}') THEN '{name}' END" for name, pattern in legal.ACTS) + "], lambda x: x IS NOT NULL)[1]"
_DEADLINE = legal._DEADLINE
_INTERPRETED = f"""{_TEXT}, court AS (SELECT *, upper(coalesce(court, '')) AS c, contains(lower(strip_accents(coalesce(judicial_class, ''))), 'juizado especial') AS special FROM p),
act AS (
  SELECT *, coalesce({_ACT}, CASE WHEN lower(strip_accents(communication)) LIKE '%intimacao%' OR regexp_matches(t, '{legal.NOTICE}') THEN 'order' ELSE 'other' END) AS act_type,
    CASE WHEN regexp_matches(t, '{legal.SMALL_CLAIMS}') THEN 'small_claims' WHEN regexp_matches(t, '{legal.FEDERAL_SMALL_CLAIMS}') THEN 'federal_small_claims' WHEN c = 'TST' OR c LIKE 'TRT%' THEN 'labor'
      WHEN c LIKE 'TRF%' AND special THEN 'federal_small_claims' WHEN c LIKE 'TRF%' THEN 'federal' WHEN c LIKE 'TJ%' AND special THEN 'small_claims' WHEN c LIKE 'TJ%' THEN 'civil' END AS branch,
    regexp_extract(t, '{_DEADLINE}', 1) AS token, regexp_extract(t, '{_DEADLINE}', 2) AS token_kind, regexp_matches(t, '{legal.HEARD}') AS heard FROM court),
explicit AS (SELECT *, nullif(CASE token WHEN 'cinco' THEN 5 WHEN 'oito' THEN 8 WHEN 'dez' THEN 10 WHEN 'quinze' THEN 15 ELSE try_cast(nullif(token, '') AS INT) END, 0) AS days FROM act),
canonical AS (
  SELECT *, days IS NULL AND heard AS assumed, act_type IN ({_FATAL}) AS fatal,
    coalesce(days, CASE WHEN branch = 'labor' AND act_type IN ('sentence', 'embargos_decision', 'appellate_decision') THEN 8 WHEN branch IN ('small_claims', 'federal_small_claims') AND act_type IN ('citation', 'sentence', 'embargos_decision') THEN 10
      WHEN act_type IN ({_FIFTEEN}) THEN 15 WHEN act_type = 'case_return' THEN 10 END, CASE WHEN days IS NULL AND heard THEN 5 END) AS deadline_days FROM explicit),
said AS (
  SELECT publication_id, asset_id, published_on, court, branch, act_type, deadline_days, CASE WHEN days IS NOT NULL AND token_kind = 'corridos' THEN 'calendar_days' WHEN deadline_days IS NOT NULL THEN 'business_days' END AS deadline_kind,
    try_strptime(nullif(regexp_extract(t, '(?s)(?:{legal.HEARING}).{{0,80}}([0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}})', 1), ''), '%d/%m/%Y')::DATE AS hearing_on,
    try_strptime(nullif(regexp_extract(t, '(?s)(?:{legal.JUDGMENT}).{{0,80}}([0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}})', 1), ''), '%d/%m/%Y')::DATE AS judgment_on,
    CASE WHEN assumed THEN 'manifestation_without_explicit_deadline' END AS r1, CASE WHEN fatal AND act_type <> 'judgment_docket' AND deadline_days IS NULL THEN 'fatal_act_without_deadline' END AS r0, CASE WHEN days > 60 THEN 'unusually_long_deadline' END AS r2,
    CASE WHEN deadline_days IS NOT NULL AND regexp_matches(t, '{legal.NO_DEADLINE}') THEN 'text_denies_deadline_but_deadline_was_detected' END AS r3,
    CASE WHEN regexp_matches(t, '{legal.URGENT}') OR deadline_days <= 5 THEN 'high' WHEN fatal OR deadline_days IS NOT NULL THEN 'medium' ELSE 'low' END AS priority, fatal FROM canonical)
"""


def _interpreted(spark: SparkSession, d: str) -> DataFrame:
    return legal.interpret(b.publications(spark, d), "text", F.col("court"), F.col("communication"), F.col("judicial_class"))


@query(_INTERPRETED + """SELECT publication_id, branch, act_type, deadline_days, deadline_kind, hearing_on, judgment_on, priority, concat_ws(',', r1, r0, r2, r3) AS reasons,
  CASE WHEN concat_ws(',', r1, r0, r2, r3) <> '' OR deadline_days IS NULL THEN 'low' ELSE 'high' END AS confidence FROM said""")
def publication_interpretation(spark: SparkSession, d: str) -> DataFrame:
    return _interpreted(spark, d).select("publication_id", "branch", "act_type", "deadline_days", "deadline_kind", "hearing_on", "judgment_on", "priority", F.array_join("review_reasons", ",").alias("reasons"), "confidence")


_CALENDAR = """, days AS (SELECT range::DATE AS day FROM range(DATE '2023-12-01', DATE '2025-06-01', INTERVAL 1 DAY)),
easter(y, day) AS (VALUES (2023, DATE '2023-04-09'), (2024, DATE '2024-03-31'), (2025, DATE '2025-04-20')),
cal AS (
  SELECT days.day, isodow(days.day) < 6 AND strftime(days.day, '%m-%d') NOT IN ('01-01', '04-21', '05-01', '09-07', '10-12', '11-02', '11-15', '11-20', '12-25') AND (days.day - easter.day) NOT IN (-48, -47, -2, 60) AS working,
    strftime(days.day, '%m-%d') >= '12-20' OR strftime(days.day, '%m-%d') <= '01-20' AS recess
  FROM days JOIN easter ON easter.y = year(days.day)),
o AS (SELECT *, sum(working::INT) OVER w AS n, sum((working AND NOT recess)::INT) OVER w AS n_open, sum((NOT recess)::INT) OVER w AS d_open, min(CASE WHEN working THEN day END) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next FROM cal WINDOW w AS (ORDER BY day)),
due AS (
  SELECT p.publication_id, p.start, CASE
    WHEN p.kind = 'business_days' AND o.recess THEN (SELECT min(t.day) FROM o t WHERE t.working AND t.n = o.n + k)
    WHEN p.kind = 'business_days' THEN (SELECT min(t.day) FROM o t WHERE t.working AND NOT t.recess AND t.n_open = o.n_open + k)
    WHEN o.recess THEN (SELECT t.next FROM o t WHERE t.day = p.start + k)
    ELSE (SELECT min(t.next) FROM o t WHERE NOT t.recess AND t.d_open = o.d_open + k) END AS due_on
  FROM p2 p JOIN o ON o.day = p.start)
"""


@query(_INTERPRETED + ", p2 AS (SELECT publication_id, (published_on + (publication_id % 400)::INT)::DATE AS start, deadline_days AS k, deadline_kind AS kind FROM said WHERE deadline_days IS NOT NULL)" + _CALENDAR + "SELECT publication_id, due_on FROM due")
def publication_deadlines(spark: SparkSession, d: str) -> DataFrame:
    """Publications moved over a year and more, so that they meet both ends of a recess."""
    days = dates.calendar(spark, "2023-12-01", "2025-05-31")
    read = _interpreted(spark, d).where("deadline_days is not null").withColumn("published_on", F.date_add("published_on", F.pmod("publication_id", F.lit(400)).cast("int")))
    return dates.deadlines(read, "published_on", "deadline_days", "deadline_kind", days).select("publication_id", "due_on")


@query(_INTERPRETED + """, p2 AS (SELECT publication_id, (SELECT min(day) FROM (SELECT range::DATE AS day FROM range(DATE '2024-01-01', DATE '2024-03-01', INTERVAL 1 DAY)) w WHERE w.day > said.published_on AND isodow(w.day) < 6 AND w.day NOT IN (DATE '2024-02-12', DATE '2024-02-13')) AS start, deadline_days AS k, deadline_kind AS kind FROM said)""" + _CALENDAR + """
, r AS (SELECT s.publication_id, CASE WHEN s.publication_id % 9 = 0 THEN DATE '2024-02-10' END AS manual, due_on, s.court IS NOT NULL AND s.publication_id % 2 = 1 AS part, hearing_on, judgment_on, p2.start FROM said s JOIN p2 USING (publication_id) LEFT JOIN due USING (publication_id))
SELECT publication_id, start AS published_on, coalesce(manual, due_on) AS due_on, coalesce(coalesce(manual, due_on) < DATE '2024-02-12', false) AS overdue,
  CASE WHEN manual IS NOT NULL AND part THEN 'manual_due_date_with_partial_calendar' WHEN manual IS NOT NULL THEN 'manual_due_date' WHEN due_on IS NULL THEN 'missing_deadline_data' WHEN part THEN 'partial_court_calendar' END AS reason,
  coalesce(manual, due_on) IS NOT NULL AND part AS needs_review,
  concat_ws(',', CASE WHEN manual IS NOT NULL THEN 'manual_due_date' WHEN due_on IS NOT NULL THEN 'deadline' END, CASE WHEN hearing_on IS NOT NULL THEN 'hearing' END, CASE WHEN judgment_on IS NOT NULL THEN 'judgment' END) AS items FROM r""")
def deadline_results(spark: SparkSession, d: str) -> DataFrame:
    """Publications known by their availability; some with a manual day, courts with an unverified calendar."""
    days = dates.calendar(spark, "2023-12-01", "2025-05-31")
    rows = _interpreted(spark, d).withColumnRenamed("published_on", "available_on").withColumns({
        "published_on": F.lit(None).cast("date"), "manual_due_on": F.when(F.col("publication_id") % 9 == 0, F.lit("2024-02-10").cast("date")), "calendar_verified": F.col("publication_id") % 2 == 0,
    })
    out = dates.deadline_results(rows, days, "2024-02-12")
    return out.select("publication_id", "published_on", "due_on", "overdue", "reason", "needs_review", F.array_join(F.transform("items", lambda x: x["kind"]), ",").alias("items"))


@query(_INTERPRETED + """, items AS (
  SELECT publication_id, asset_id, 'hearing' AS kind, hearing_on AS day, false AS fatal FROM said WHERE hearing_on IS NOT NULL AND publication_id % 11 > 0
  UNION ALL SELECT publication_id, asset_id, 'judgment', judgment_on, false FROM said WHERE judgment_on IS NOT NULL AND publication_id % 11 > 0
  UNION ALL SELECT publication_id, asset_id, 'deadline', published_on + deadline_days, true FROM said WHERE deadline_days IS NOT NULL AND publication_id % 11 > 0),
newest AS (SELECT publication_id FROM said WHERE publication_id % 11 > 0 AND (hearing_on IS NOT NULL OR judgment_on IS NOT NULL OR deadline_days IS NOT NULL)
  ORDER BY coalesce(published_on + deadline_days, hearing_on, judgment_on), publication_id LIMIT 200)
SELECT publication_id, kind, day::DATE AS day, fatal, fatal AND day < DATE '2024-01-25' AS overdue FROM items JOIN newest USING (publication_id) ORDER BY day, publication_id, kind LIMIT 25""")
def publication_agenda(spark: SparkSession, d: str) -> DataFrame:
    rows = _interpreted(spark, d).withColumns({"dismissed": F.col("publication_id") % 11 == 0, "due_on": F.date_add("published_on", F.col("deadline_days"))})
    return publications.agenda(rows, "2024-01-25").select("publication_id", "kind", "day", "fatal", "overdue")


@query("""
, cases AS (SELECT asset_id, asset_id % 4 > 0 AS active FROM assets), per AS (SELECT asset_id, count(*) AS n, max(published_on) AS latest FROM publications GROUP BY ALL)
SELECT asset_id, active, coalesce(n, 0) AS publications, latest AS latest_on FROM cases LEFT JOIN per USING (asset_id)""")
def monitored_cases(spark: SparkSession, d: str) -> DataFrame:
    cases = b.assets(spark, d).select("asset_id", (F.col("asset_id") % 4 > 0).alias("active"))
    return publications.monitored(cases, b.publications(spark, d), "asset_id", "published_on").select("asset_id", "active", "publications", "latest_on")


@query("""
, cases AS (SELECT asset_id AS id, asset_id % 4 > 0 AS active FROM assets), lawyers AS (SELECT s_suppkey AS id, s_suppkey % 2 = 0 AS active FROM supplier), per AS (SELECT asset_id AS id, count(*) AS n FROM publications GROUP BY ALL)
SELECT (SELECT count(*) FROM cases WHERE active) AS active_cases, (SELECT count(*) FROM lawyers WHERE active) AS active_registrations,
  ((SELECT coalesce(sum(n), 0) FROM cases JOIN per USING (id)) + (SELECT coalesce(sum(n), 0) FROM lawyers JOIN per USING (id)))::BIGINT AS publications""")
def monitoring_totals(spark: SparkSession, d: str) -> DataFrame:
    found = b.publications(spark, d).withColumnRenamed("asset_id", "id")
    cases = b.assets(spark, d).select(F.col("asset_id").alias("id"), (F.col("asset_id") % 4 > 0).alias("active"))
    lawyers = b.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 2 == 0).alias("active"))
    return publications.monitoring_totals(publications.monitored(cases, found, "id", "published_on"), publications.monitored(lawyers, found, "id", "published_on"))


_FLOW = f"""{_TEXT}, rule(code, pattern) AS (VALUES {", ".join(f"('{code}', '{pattern}')" for code, _, _, _, pattern in legal.SIGNALS)}),
linked AS (SELECT p.*, CASE WHEN publication_id % 3 = 0 THEN NULL ELSE p.asset_id END AS own, a.asset_id AS by_process FROM p LEFT JOIN (SELECT asset_id FROM assets WHERE asset_id % 2 = 0) a ON a.asset_id = p.asset_id),
scan AS (SELECT *, coalesce(own, by_process) AS of FROM linked ORDER BY published_on DESC, publication_id DESC LIMIT 5000)
"""


@query(_FLOW + """SELECT publication_id, "of" AS asset_id, rule.code AS event_type FROM scan JOIN rule ON regexp_matches(t, pattern) WHERE "of" IS NOT NULL""")
def publication_events(spark: SparkSession, d: str) -> DataFrame:
    return publications.project(*_scan(spark, d)).select("publication_id", "asset_id", "event_type")


@query(_FLOW + """SELECT "of" AS asset_id, count(*) AS events FROM scan JOIN rule ON regexp_matches(t, pattern) WHERE "of" IS NOT NULL GROUP BY ALL""")
def scores_to_refresh(spark: SparkSession, d: str) -> DataFrame:
    return publications.affected(publications.project(*_scan(spark, d)))


def _scan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Publications of which some name only a process, and the processes of half of the assets; the newest 5,000."""
    found = b.publications(spark, d).withColumn("process_id", F.col("asset_id") * 10).withColumn("asset_id", F.when(F.col("publication_id") % 3 != 0, F.col("asset_id")))
    processes = b.assets(spark, d).where("asset_id % 2 = 0").select((F.col("asset_id") * 10).alias("process_id"), "asset_id")
    return publications.newest(found, [F.desc("published_on"), F.desc("publication_id")], 5000), processes


@query(f"""{_TEXT}, items AS (SELECT user_id AS asset_id, event_id, ts::DATE AS day, text FROM events JOIN p ON publication_id = event_id UNION ALL SELECT user_id, event_id, ts::DATE, text FROM events JOIN p ON publication_id = event_id WHERE event_id % 10 = 0),
known AS (SELECT asset_id, asset_id % 5 = 0 AS filled FROM assets WHERE asset_id % 4 = 0), proc AS (SELECT DISTINCT asset_id FROM items)
SELECT coalesce(p.asset_id, k.asset_id) AS asset_id, CASE WHEN k.filled THEN 'known class' WHEN p.asset_id IS NOT NULL THEN 'new class' END AS class_name,
  (SELECT count(*) FROM (SELECT DISTINCT day, text FROM items i WHERE i.asset_id = coalesce(p.asset_id, k.asset_id))) AS publications FROM proc p FULL JOIN known k ON k.asset_id = p.asset_id""")
def intake_of_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of an API, some twice: existing values of a process win; a publication is its text and day."""
    found = b.publications(spark, d).select("asset_id", "publication_id", F.col("published_on").alias("day"), "text")
    found = found.unionAll(found.where("publication_id % 10 = 0")).withColumn("class_name", F.lit("new class"))
    known = b.assets(spark, d).where("asset_id % 4 = 0").select("asset_id", F.when(F.col("asset_id") % 5 == 0, F.lit("known class")).alias("class_name"))
    processes, rows = publications.intake(known, found, "asset_id", ["class_name"])
    per = rows.groupBy("asset_id").agg(F.count("*").alias("publications"))
    return processes.join(per, "asset_id", "left").select("asset_id", "class_name", F.coalesce("publications", F.lit(0)).alias("publications"))


# Every publication as an item of an API: numbers of assets, some of them no numbers; a fourth is known; some come twice.
_ITEMS = """, item AS (
  SELECT said.*, said.publication_id AS djen_id, a.tenant_id, a.cnj_number, a.asset_id AS owner, CASE WHEN said.asset_id % 3 = 0 THEN NULL ELSE a.cnj_number END AS number FROM said LEFT JOIN (SELECT asset_id, tenant_id, cnj_number FROM assets) a USING (asset_id)),
p2 AS (SELECT publication_id, (SELECT min(day) FROM (SELECT range::DATE AS day FROM range(DATE '2024-01-01', DATE '2024-03-01', INTERVAL 1 DAY)) w WHERE w.day > said.published_on AND isodow(w.day) < 6 AND w.day NOT IN (DATE '2024-02-12', DATE '2024-02-13')) AS start, deadline_days AS k, deadline_kind AS kind FROM said)"""


def _flow(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    k = F.col("asset_id")
    found = b.publications(spark, d).withColumnRenamed("published_on", "available_on")
    assets = b.assets(spark, d).select("asset_id", "tenant_id", "cnj_number")
    items = found.join(assets, "asset_id", "left").select("tenant_id", F.col("publication_id").alias("djen_id"), F.when(k % 3 > 0, F.col("cnj_number")).otherwise(F.lit("123")).alias("process_number"), "court", "communication", "judicial_class", "text", "available_on", F.lit(None).cast("date").alias("published_on"), F.lit(True).alias("calendar_verified"))
    items = items.unionAll(items.where("djen_id % 10 = 0"))
    known = items.where("djen_id % 4 = 0").select("tenant_id", "djen_id")
    processes = assets.where("asset_id % 2 = 0").select("tenant_id", "cnj_number", F.when(k % 4 > 0, k).alias("asset_id"), F.when(k % 8 > 0, F.lit("known")).alias("court"))
    return publications.flow(items, known, processes, assets, dates.calendar(spark, "2023-12-01", "2025-05-31"), "2024-02-12")


@query(_INTERPRETED + _ITEMS + _CALENDAR + """SELECT djen_id, i.tenant_id, CASE WHEN number IS NULL OR (owner % 2 = 0 AND owner % 4 = 0) THEN NULL ELSE owner END AS asset_id, djen_id % 4 > 0 OR i.tenant_id IS NULL AS is_new, branch, act_type, priority, due_on, coalesce(due_on < DATE '2024-02-12', false) AS overdue
FROM item i LEFT JOIN due USING (publication_id)""")
def publication_flow(spark: SparkSession, d: str) -> DataFrame:
    """Items linked to processes and assets, interpreted, with their deadlines."""
    return _flow(spark, d)["publications"].select("djen_id", "tenant_id", "asset_id", "is_new", "branch", "act_type", "priority", "due_on", "overdue")


@query(_INTERPRETED + _ITEMS + f""", rule(code, confidence, pattern) AS (VALUES {_CODES}) """ + """
SELECT 'process' AS kind, CASE WHEN asset_id % 2 = 0 THEN 'known' ELSE 'new' END AS name, count(*) AS n FROM (SELECT DISTINCT owner AS asset_id FROM item WHERE number IS NOT NULL UNION SELECT asset_id FROM assets WHERE asset_id % 2 = 0) GROUP BY ALL
UNION ALL SELECT 'event', 'ingested', count(*) FROM item WHERE djen_id % 4 > 0 OR tenant_id IS NULL
UNION ALL SELECT 'event', code, count(*) FROM item i JOIN p ON p.publication_id = i.publication_id JOIN rule ON regexp_matches(p.t, pattern) WHERE number IS NOT NULL AND NOT (owner % 2 = 0 AND owner % 4 = 0) GROUP BY code""")
def publication_flow_events(spark: SparkSession, d: str) -> DataFrame:
    """Processes after the flow, and the events that it makes."""
    out = _flow(spark, d)
    count = lambda df, kind, name: df.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return count(out["processes"], "process", F.when(F.col("is_new"), F.lit("new")).otherwise(F.lit("known"))).unionAll(count(out["events"], "event", F.col("event_type")))


@query(f""", m AS (
  SELECT event_id AS movement_id, user_id AS process_id, CASE WHEN user_id % 4 > 0 THEN user_id END AS asset_id, CASE WHEN event_id % 6 = 0 THEN 12457 ELSE event_id % 50 END AS code, ['Certidão de trânsito em julgado', 'Expedição de alvará', 'Alvará expedido', NULL][event_id % 4 + 1] AS name,
    CASE WHEN event_id % 5 = 0 THEN 'suspensão' ELSE '' END || ' ' || CASE WHEN event_id % 7 = 0 THEN 'penhora no rosto' ELSE '' END AS more FROM events),
rule(code, confidence, pattern) AS (VALUES {_CODES}),
f AS (SELECT DISTINCT movement_id, process_id, asset_id, r.code FROM m JOIN rule r ON regexp_matches(lower(strip_accents(coalesce(name, '') || ' ' || more)), r.pattern) OR (r.code = 'requisition_issued' AND m.code = 12457))
SELECT code, count(*) AS signals, count(DISTINCT process_id) AS processes, count(asset_id) AS events FROM f GROUP BY code""")
def movement_signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals of movements: in the name, in the raw data, in a complement's description, or by the code."""
    e = b.read(spark, d, "events")
    k, name = F.col("event_id"), F.get(F.array(*map(F.lit, ("Certidão de trânsito em julgado", "Expedição de alvará", "Alvará expedido", None))), F.pmod("event_id", F.lit(4)).cast("int"))
    raw = F.when(k % 5 == 0, F.to_json(F.struct(F.lit("suspensão").alias("nota"))))
    moves = e.select(F.col("user_id").alias("process_id"), k.alias("movement_id"), F.when(F.col("user_id") % 4 > 0, F.col("user_id")).alias("asset_id"), F.when(k % 6 == 0, 12457).otherwise(k % 50).cast("int").alias("code"), name.alias("name"), raw.alias("raw"), F.col("ts").alias("at"))
    extra = e.where(k % 7 == 0).select(k.alias("movement_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("position")).select("movement_id", "position", F.lit(3).alias("code"), F.lit("v").alias("value"), F.lit("complemento").alias("name"), F.when(F.col("position") == 2, F.lit("Penhora no rosto")).alias("description"))
    found = legal.classify_movements(moves.unionAll(moves.where(k % 9 == 0)), extra)
    events = legal.movement_events(found).groupBy(F.col("event_type").alias("code")).agg(F.count("*").alias("events"))
    return found.groupBy("code").agg(F.count("*").alias("signals"), F.countDistinct("process_id").alias("processes")).join(events, "code", "left").select("code", "signals", "processes", F.coalesce("events", F.lit(0)).alias("events"))
