"""Queries of upserts, links, filters, state tables, streams' batch forms and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import dates, text
from quarry.operators import coverage, desk, evidence, pricing, relational
from quarry.plans import bindings as b
from quarry.plans.queries import query
from quarry.sources import sinks, tribunals

_BATCHES = """, src AS (SELECT l_orderkey AS k1, CASE WHEN l_suppkey % 7 > 0 THEN l_suppkey END AS k2, l_linenumber AS n, l_extendedprice::DECIMAL(18,2) AS price, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag, l_partkey AS part FROM lineitem),
old_rows AS (SELECT k1, k2, price, flag FROM src WHERE n <= 2 QUALIFY row_number() OVER (PARTITION BY k1, k2 ORDER BY n, price, part) = 1),
new_rows AS (SELECT k1, k2, price, flag FROM src WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY k1, k2 ORDER BY n DESC, price DESC, part DESC) = 1),
merged AS (SELECT coalesce(o.k1, n.k1) AS k1, coalesce(o.k2, n.k2) AS k2, o.price AS op, n.price AS np, o.flag AS ofl, n.flag AS nfl, n.k1 IS NOT NULL AS fresh, o.k1 IS NOT NULL AS known FROM old_rows o FULL JOIN new_rows n ON o.k1 = n.k1 AND o.k2 IS NOT DISTINCT FROM n.k2)
"""


def _batches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list, list]:
    """State and new rows by order and supplier, of which a seventh are null."""
    rows = b.read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k1"), F.when(F.col("l_suppkey") % 7 > 0, F.col("l_suppkey")).alias("k2"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"), F.col("l_partkey").alias("part"),
    )
    keys, last = ["k1", "k2"], [F.desc("n"), F.desc("price"), F.desc("part")]
    state = relational.top_by(rows.where("n <= 2"), keys, [F.asc("n"), F.asc("price"), F.asc("part")]).select(*keys, "price", "flag")
    return state, rows.where("n > 1"), keys, last


@query(_BATCHES + " SELECT k1, k2, CASE WHEN fresh THEN np ELSE op END AS price, CASE WHEN fresh THEN nfl ELSE ofl END AS flag FROM merged")
def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    state, new, keys, order = _batches(spark, d)
    return relational.upsert(state, new, keys, order)


@query(_BATCHES + " SELECT k1, k2, coalesce(np, op) AS price, coalesce(nfl, ofl) AS flag FROM merged")
def upsert_keeps_known_values(spark: SparkSession, d: str) -> DataFrame:
    state, new, keys, order = _batches(spark, d)
    return relational.upsert(state, new, keys, order, keep_old_when_null=True)


@query(_BATCHES + " SELECT k1, k2, coalesce(op, np) AS price, CASE WHEN fresh THEN nfl ELSE ofl END AS flag FROM merged")
def upsert_keeps_creator(spark: SparkSession, d: str) -> DataFrame:
    state, new, keys, order = _batches(spark, d)
    return relational.upsert(state, new, keys, order, keep_first=["price"])


@query(_BATCHES + " SELECT k1, k2, coalesce(op, np) AS price, CASE WHEN known THEN ofl ELSE nfl END AS flag FROM merged WHERE k2 IS NOT NULL")
def insert_missing_rows(spark: SparkSession, d: str) -> DataFrame:
    state, new, keys, order = _batches(spark, d)
    return relational.insert_missing(state.where("k2 is not null"), new.where("k2 is not null"), keys, order)


@query("""
, a AS (SELECT asset_id, asset_id % 5 = 0 AS was, asset_id % 3 = 0 AS goes, asset_id % 15 = 0 AS back FROM assets)
SELECT count(*) FILTER (NOT was) AS live, count(*) AS with_deleted, count(*) FILTER (NOT was AND NOT goes) AS after_delete, count(*) FILTER (NOT was OR back) AS after_restore, count(*) FILTER (NOT goes) AS after_force FROM a""")
def deletions(spark: SparkSession, d: str) -> DataFrame:
    rows = b.assets(spark, d).select("asset_id", "tenant_id", F.when(F.col("asset_id") % 5 == 0, F.lit("2024-01-01").cast("timestamp")).alias("deleted_at"))
    third = F.col("asset_id") % 3 == 0
    frames = {
        "live": relational.live(rows), "with_deleted": relational.live(rows, deleted=True), "after_delete": relational.live(relational.soft_delete(rows, third, "2024-02-02")),
        "after_restore": relational.live(relational.restore(rows, F.col("asset_id") % 15 == 0)), "after_force": relational.force_delete(rows, third),
    }
    out = None
    for name, df in frames.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


@query("SELECT asset_id, CASE WHEN lifecycle_status = 'pending' AND created_at < TIMESTAMP '1995-06-01' - INTERVAL 90 MINUTE THEN 'failed' ELSE lifecycle_status END AS status FROM assets")
def stale_to_failed(spark: SparkSession, d: str) -> DataFrame:
    old = (F.col("lifecycle_status") == "pending") & (F.col("created_at") < F.lit("1995-06-01").cast("timestamp") - F.expr("interval 90 minutes"))
    return relational.set_where(b.assets(spark, d), old, lifecycle_status=F.lit("failed")).select("asset_id", F.col("lifecycle_status").alias("status"))


@query("""
, c AS (SELECT l_orderkey AS g, l_linenumber AS id, ['candidate', 'ambiguous', 'rejected'][l_linenumber % 3 + 1] AS status, l_quantity AS score FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1),
best AS (SELECT g, id FROM c WHERE score >= 45)
SELECT c.g, c.id, CASE WHEN best.id IS NOT NULL THEN 'accepted' WHEN c.g IN (SELECT g FROM best) AND status IN ('candidate', 'ambiguous') THEN 'rejected' ELSE status END AS status FROM c LEFT JOIN best ON best.g = c.g AND best.id = c.id""")
def sibling_updates(spark: SparkSession, d: str) -> DataFrame:
    rows = b.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("id"), F.get(F.array(*map(F.lit, ("candidate", "ambiguous", "rejected"))), F.col("l_linenumber") % 3).alias("status"), F.col("l_quantity").alias("score"), "l_partkey", "l_suppkey")
    rows = relational.top_by(rows, ["g", "id"], [F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("score")])
    accepted = rows.withColumn("status", evidence.review(rows, 45)).where("status = 'accepted'")
    return relational.reject_siblings(rows, "g", "id", accepted).select("g", "id", "status")


@query("SELECT 'staging' AS kind, count(*) AS n FROM asset_events WHERE event_at >= TIMESTAMP '2024-02-15' - INTERVAL 30 DAY UNION ALL SELECT 'applied', count(*) FROM links WHERE seen_at >= TIMESTAMP '1998-01-01' - INTERVAL 365 DAY UNION ALL SELECT 'dry run', count(*) FROM links")
def purged_rows(spark: SparkSession, d: str) -> DataFrame:
    of = lambda kind, df: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    links = b.links(spark, d)
    return of("staging", relational.purge(b.events(spark, d), "event_at", "2024-02-15", 30)).unionAll(of("applied", relational.apply_retention(links, "seen_at", "1998-01-01", 365, dry_run=False))).unionAll(of("dry run", relational.apply_retention(links, "seen_at", "1998-01-01", 365)))


@query("""
, cases AS (SELECT DISTINCT CASE WHEN asset_id % 5 > 0 THEN asset_id END AS k, asset_id % 2 = 0 AS active FROM assets WHERE asset_id % 3 = 0), per AS (SELECT k, bool_or(active) AS active FROM cases GROUP BY k), n AS (SELECT DISTINCT CASE WHEN asset_id % 5 > 0 THEN asset_id END AS k FROM assets)
SELECT n.k, CASE WHEN per.active THEN 'duplicate' WHEN NOT per.active THEN 'reactivate' ELSE 'create' END AS outcome FROM n LEFT JOIN per ON n.k IS NOT DISTINCT FROM per.k""")
def case_registrations(spark: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("asset_id") % 5 > 0, F.col("asset_id")).alias("k")
    rows = b.assets(spark, d)
    return relational.register_case(rows.where("asset_id % 3 = 0").select(key, (F.col("asset_id") % 2 == 0).alias("active")), rows.select(key).distinct(), ["k"])


@query("""
, l AS (SELECT o_orderkey AS id, o_custkey AS a, (floor(o_totalprice)::INT % 1000)::INT AS z FROM orders), r AS (SELECT c_custkey AS rid, CASE WHEN c_custkey % 4 = 0 THEN c_custkey END AS a, (floor(c_acctbal)::INT % 1000)::INT AS z FROM customer),
m AS (SELECT id, rid, 0 AS p FROM l JOIN r USING (a) UNION ALL SELECT id, rid, 1 FROM l JOIN r USING (z))
SELECT id, rid, CASE p WHEN 0 THEN 'a' ELSE 'z' END AS matched_by FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY p, rid) = 1""")
def matches_by_either_key(spark: SparkSession, d: str) -> DataFrame:
    left = b.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("a"), (F.floor("o_totalprice").cast("int") % 1000).alias("z"))
    right = b.read(spark, d, "customer").select(F.col("c_custkey").alias("rid"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey")).alias("a"), (F.floor("c_acctbal").cast("int") % 1000).alias("z"))
    return relational.match_either(left, right, "a", "z", "id", "rid")


@query("""SELECT r.r_name AS region, n.n_name AS nation FROM region r CROSS JOIN nation n""")
def catalogue_pairs(spark: SparkSession, d: str) -> DataFrame:
    return relational.product_rows(b.read(spark, d, "region").select(F.col("r_name").alias("region")), b.read(spark, d, "nation").select(F.col("n_name").alias("nation")))


@query("SELECT asset_id, CASE WHEN court_id % 3 > 0 THEN court ELSE court_id::VARCHAR END AS court_name FROM assets")
def names_of_codes(spark: SparkSession, d: str) -> DataFrame:
    names = b.courts(spark, d).where("court_id % 3 > 0").select("court_id", F.col("court").alias("court_name"))
    return relational.named(b.assets(spark, d).select("asset_id", "court_id"), names, "court_id", "court_name").select("asset_id", "court_name")


@query("""
, facts AS (SELECT asset_id, tenant_id, asset_id % 4 AS fact FROM assets WHERE asset_id % 4 <> 3)
SELECT a.asset_id, f.fact, coalesce(n.n, 0) AS n_links FROM assets a LEFT JOIN facts f ON f.asset_id = a.asset_id AND f.tenant_id = a.tenant_id LEFT JOIN (SELECT asset_id, count(*) AS n FROM links GROUP BY ALL) n ON n.asset_id = a.asset_id WHERE f.fact IS NOT NULL OR a.debtor_name LIKE '%7'""")
def candidate_assets(spark: SparkSession, d: str) -> DataFrame:
    """A left join on two keys, counts of another table, and an OR over both sides."""
    rows = b.assets(spark, d)
    facts = rows.where("asset_id % 4 <> 3").select("asset_id", "tenant_id", (F.col("asset_id") % 4).alias("fact"))
    joined = rows.join(facts, ["asset_id", "tenant_id"], "left").where(F.col("fact").isNotNull() | F.col("debtor_name").endswith("7"))
    return relational.with_counts(joined.select("asset_id", "fact"), b.links(spark, d), ["asset_id"], n_links=F.count("*"))


@query("""
, c AS (SELECT event_id, asset_id, ['datajud', 'djen'][event_id % 2 + 1] AS source, ['candidate', 'ambiguous', 'accepted'][event_id % 3 + 1] AS status, k AS score, CASE WHEN event_id % 4 > 0 THEN 'TRF' || (event_id % 6) END AS court, 'P' || event_id AS process_id, NULL::VARCHAR AS candidate_cnj FROM asset_events)
SELECT event_id, score FROM c WHERE source = 'datajud' AND status = 'ambiguous' AND score BETWEEN 20 AND 80 AND (contains(lower(coalesce(court, '')), 'trf4') OR contains(lower(process_id), 'trf4'))""")
def candidate_list(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    turn = lambda *values: F.get(F.array(*map(F.lit, values)), F.pmod(k, F.lit(len(values))).cast("int"))
    rows = b.events(spark, d).select(
        "event_id", turn("datajud", "djen").alias("source"), turn("candidate", "ambiguous", "accepted").alias("status"), F.col("k").alias("score"), F.when(k % 4 > 0, F.concat(F.lit("TRF"), (k % 6).cast("string"))).alias("court"), F.concat(F.lit("P"), k.cast("string")).alias("process_id"), F.lit(None).cast("string").alias("candidate_cnj"),
    )
    return desk.candidates(rows, q="trf4", min_score=20, max_score=80, source="datajud", status="ambiguous", asset_id=None).select("event_id", "score")


@query("""
, a AS (SELECT asset_id, cnj_number, court_id, (asset_id % 3 = 0) AS none, year(created_at) AS filed, exercise_year AS proposal, ['Desapropriação indireta', 'Aposentadoria especial', 'Outros'][asset_id % 3 + 1] AS cause FROM assets),
p AS (SELECT asset_id AS pid, cnj_number AS pn, court_id AS pc, exercise_year + asset_id % 2 AS py, [1265, 1266, 7][asset_id % 3 + 1] AS code, ['Precatório', 'RPV', 'Cumprimento de sentença'][asset_id % 3 + 1] AS klass, ['Desapropriação', 'Aposentadoria', 'Salário'][asset_id % 3 + 1] AS subject FROM assets),
pairs AS (SELECT DISTINCT asset_id, pid FROM a JOIN p ON NOT none AND substr(cnj_number, 1, 7) = substr(pn, 1, 7) UNION SELECT asset_id, pid FROM a JOIN p ON none AND court_id = pc AND filed = py AND code IN (1265, 1266)),
scored AS (
  SELECT asset_id, pid, least(100, 35 * (NOT none AND substr(cnj_number, 1, 7) = substr(pn, 1, 7))::INT + 20 * (NOT none AND substr(cnj_number, 12, 4) = substr(pn, 12, 4))::INT + 15 * (NOT none AND substr(cnj_number, 17, 4) = substr(pn, 17, 4))::INT + 10 * (proposal::VARCHAR = substr(pn, 12, 4))::INT
    + 20 * (none AND filed = py)::INT + 10 * (none AND abs(proposal - py) <= 2)::INT + 25 * (code < 1265)::INT * 0 + 25 * (klass IN ('Precatório', 'RPV'))::INT + 15 * (klass = 'Cumprimento de sentença')::INT
    + 15 * ((cause LIKE 'Desap%' AND subject = 'Desapropriação') OR (cause LIKE 'Apos%' AND subject = 'Aposentadoria'))::INT + 5 * (subject IN ('Aposentadoria', 'Salário'))::INT)::INT AS score
  FROM pairs JOIN a USING (asset_id) JOIN p USING (pid))
SELECT asset_id, pid AS process_id, score, CASE WHEN score BETWEEN 60 AND 84 THEN 'ambiguous' ELSE 'candidate' END AS status FROM scored WHERE score >= 35 QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY score DESC, pid) <= 5""")
def process_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Numbered assets meet processes by the number's prefix, others by court and year among requisitions."""
    turn = lambda *values: F.get(F.array(*map(F.lit, values)), F.pmod("asset_id", F.lit(len(values))).cast("int"))
    rows = b.assets(spark, d)
    a = rows.select("asset_id", F.when(F.col("asset_id") % 3 > 0, F.col("cnj_number")).alias("cnj_number"), F.col("court_id").alias("court"), F.year("created_at").alias("filed_year"), F.col("exercise_year").alias("proposal_year"), turn("Desapropriação indireta", "Aposentadoria especial", "Outros").alias("cause"))
    p = rows.select(
        F.col("asset_id").alias("process_id"), F.col("cnj_number").alias("cnj"), F.col("court_id").alias("p_court"), (F.col("exercise_year") + F.col("asset_id") % 2).cast("int").alias("p_year"), turn(1265, 1266, 7).alias("class_code"), turn("Precatório", "RPV", "Cumprimento de sentença").alias("class_name"),
        turn("Desapropriação", "Aposentadoria", "Salário").alias("subject"),
    )
    return evidence.match_candidates(a, p).select("asset_id", "process_id", "score", "status")


@query("""
, day AS (SELECT event_id, event_at::DATE AS d, asset_id % 25 AS court FROM asset_events), h AS (SELECT (DATE '2024-01-01' + (3 * i)::INT)::DATE AS day, CASE WHEN i % 2 = 0 THEN i % 25 END AS court FROM range(10) r(i))
SELECT court_id, count(*) AS holidays FROM courts JOIN h ON h.day BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' AND (h.court IS NULL OR h.court = court_id) GROUP BY court_id""")
def court_holidays(spark: SparkSession, d: str) -> DataFrame:
    """Holidays of a span, national ones and each court's own."""
    i = F.col("id")
    holidays = spark.range(10).select(F.date_add(F.lit("2024-01-01").cast("date"), (3 * i).cast("int")).alias("day"), F.when(i % 2 == 0, i % 25).alias("court"))
    found = dates.holidays_of(holidays, b.courts(spark, d).select("court_id"), "court_id", "2024-01-05", "2024-01-25")
    return found.groupBy("court_id").agg(F.count("*").alias("holidays"))


@query("SELECT k, count(*) AS n, min(event_id) AS first_id FROM asset_events WHERE k BETWEEN 10 AND 12 GROUP BY k")
def events_by_json_value(spark: SparkSession, d: str) -> DataFrame:
    rows = b.read(spark, d, "events").where(F.get_json_object("props", "$.k").isin("10", "11", "12"))
    return rows.groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""SELECT asset_id, CASE WHEN asset_id % 4 = 0 THEN 'own' WHEN asset_id % 4 = 1 THEN 'tjsp' WHEN asset_id % 4 = 2 THEN ['tjac', 'tjdft', 'tjrj', 'tjto'][(asset_id // 4 % 4 + 1)::INT] END AS court FROM assets""")
def court_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The first that is known: an alias, a name, the state's court."""
    k = F.col("asset_id") % 4
    state = F.when(k == 2, F.get(F.array(*map(F.lit, ("AC", "df", "RJ", "to"))), (F.floor(F.col("asset_id") / 4) % 4).cast("int")))
    return b.assets(spark, d).select("asset_id", text.first_alias(F.when(k == 0, F.lit(" OWN ")), F.when(k == 1, F.lit("TJSP")).otherwise(F.lit("")), text.court_of_state(state)).alias("court"))


@query("SELECT asset_id, tenant_id, debtor_name, debtor_type, total::VARCHAR AS total_text, CASE WHEN lifecycle_status = 'paid' THEN 'closed' ELSE 'open' END AS state FROM assets")
def serialised_assets(spark: SparkSession, d: str) -> DataFrame:
    """Nested rows, and back."""
    rows = b.assets(spark, d).select("asset_id", F.struct(F.col("tenant_id").alias("id")).alias("tenant"), F.struct(F.col("debtor_name").alias("name"), F.col("debtor_type").alias("type")).alias("debtor"), text.money_string("total").alias("total"), F.when(F.col("lifecycle_status") == "paid", F.lit("closed")).otherwise(F.lit("open")).alias("state"))
    back = F.from_json(F.to_json(F.struct(*rows.columns)), "asset_id long, tenant struct<id:int>, debtor struct<name:string,type:string>, total string, state string")
    return rows.select(back.alias("r")).select("r.asset_id", F.col("r.tenant.id").alias("tenant_id"), F.col("r.debtor.name").alias("debtor_name"), F.col("r.debtor.type").alias("debtor_type"), F.col("r.total").alias("total_text"), "r.state")


# Jobs run in one of five states; now is late on the last day of the events.
_RUNS = """
, moment AS (SELECT max(ts) - INTERVAL 5 MINUTE AS now FROM events),
runs AS (SELECT event_type || '-' || user_id % 40 AS job, event_id, ts AS event_at, ['completed', 'failed', 'running', 'skipped', 'cancelled'][event_id % 5 + 1] AS status, event_id * 10 AS metric FROM events)
"""


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    events = b.read(spark, d, "events")
    now = events.agg(F.date_format(F.max("ts") - F.expr("interval 5 minutes"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
    state = F.get(F.array(*map(F.lit, ("completed", "failed", "running", "skipped", "cancelled"))), F.pmod("event_id", F.lit(5)).cast("int"))
    return events.select(F.concat_ws("-", "event_type", (F.col("user_id") % 40).cast("string")).alias("job"), "event_id", F.col("ts").cast("timestamp").alias("at"), state.alias("status"), (F.col("event_id") * 10).alias("metric")), now


@query(_RUNS + """, last AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY job ORDER BY event_at DESC, event_id DESC) = 1),
s AS (SELECT job, max(event_at) FILTER (status = 'completed') AS ok, max(event_at) FILTER (status = 'running') AS busy, max(event_at) FILTER (status IN ('failed', 'skipped', 'cancelled')) AS bad FROM runs GROUP BY job)
SELECT last.job, last.event_id, last.status, last.metric, CASE WHEN busy >= now - INTERVAL 6 HOUR THEN 'in_progress' WHEN ok >= now - INTERVAL 20 HOUR THEN 'recent_success' WHEN bad >= now - INTERVAL 2 HOUR THEN 'recent_failure' END AS skip_reason FROM last LEFT JOIN s USING (job), moment""")
def job_runs(spark: SparkSession, d: str) -> DataFrame:
    """The latest run of each job with its metric, and why the job need not run again: a running one first, then a success, then a failure."""
    runs, now = _runs(spark, d)
    last = relational.latest_by(runs, ["job"], [F.col("at"), F.col("event_id")])
    return last.join(coverage.job_state(runs, "job", now).select("job", "skip_reason"), "job", "left").select("job", "event_id", "status", "metric", "skip_reason")


@query(_RUNS + """, tenant AS (SELECT job, event_id % 3 AS tenant, status, event_at FROM runs), n AS (SELECT tenant, count(*) FILTER (status = 'failed' AND event_at >= now - INTERVAL 6 HOUR) AS failed, count(*) FILTER (status = 'running' AND event_at < now - INTERVAL 700 HOUR) AS hangs FROM tenant, moment GROUP BY tenant)
SELECT tenant, CASE WHEN tenant = 0 THEN hangs ELSE 0 END AS stalled, CASE WHEN (tenant = 1 AND failed > 0) OR (tenant = 0 AND hangs > 0) THEN 'degraded' WHEN tenant = 2 THEN 'attention' ELSE 'ok' END AS status FROM n""")
def overall_health(spark: SparkSession, d: str) -> DataFrame:
    """Per group of runs: a failed queue degrades, so does a hanging run; a job that is due asks for attention."""
    runs, now = _runs(spark, d)
    moment, out = F.lit(now).cast("timestamp"), None
    for tenant in range(3):
        own = runs.where(F.col("event_id") % 3 == tenant)
        queues = own.where((F.col("status") == "failed") & (F.col("at") >= moment - F.expr("interval 6 hours"))).select(F.lit("degraded" if tenant == 1 else "ok").alias("status"))
        jobs = own.select(F.lit("due" if tenant == 2 else "fresh").alias("status"))
        stalled = own.where((F.col("status") == "running") & (F.col("at") < moment - F.expr("interval 700 hours"))) if tenant == 0 else own.limit(0)
        one = coverage.health(queues, own.limit(0), stalled, jobs).select(F.lit(tenant).cast("long").alias("tenant"), "stalled", "status")
        out = one if out is None else out.unionAll(one)
    return out


@query(_RUNS + """, q AS (SELECT DISTINCT job AS queue FROM runs UNION SELECT 'idle'), beat AS (SELECT job AS queue, max(event_at) AS last_beat FROM runs GROUP BY ALL)
SELECT queue, last_beat, coalesce(last_beat >= now - INTERVAL 1800 SECOND, false) AS fresh FROM q LEFT JOIN beat USING (queue), moment""")
def queue_freshness(spark: SparkSession, d: str) -> DataFrame:
    runs, now = _runs(spark, d)
    queues = runs.select(F.col("job").alias("queue")).distinct().unionAll(spark.createDataFrame([("idle",)], "queue string"))
    return coverage.freshness(runs.select(F.col("job").alias("queue"), "at"), queues, now, 1800)


@query("""
, t AS (
  SELECT s_suppkey AS id, s_suppkey AS k, ['configured', 'validated', 'blocked', 'validated'][s_suppkey % 4 + 1] AS status, CASE WHEN s_suppkey % 13 > 0 THEN 'a' END AS adapter, CASE WHEN s_suppkey % 5 > 0 THEN DATE '2024-01-20' - (s_suppkey % 41)::INT END AS ok_on,
    (s_suppkey // 4) % 3 AS records, [NULL, 'A', 'B', 'C', 'D'][(s_suppkey // 3) % 5 + 1] AS grade, (s_suppkey % 21) / 20.0::DOUBLE AS q, (s_suppkey % 7) / 10.0::DOUBLE AS y, (s_suppkey % 9) / 20.0::DOUBLE AS e, CASE WHEN s_suppkey % 6 > 0 THEN 0.55::DOUBLE + (s_suppkey % 5) / 20.0::DOUBLE END AS f FROM supplier),
s AS (
  SELECT *, DATE '2024-01-20' - ok_on AS age, grade IS NOT NULL AS known, coalesce(grade = 'D' OR (grade IS NOT NULL AND q < 0.5), false) AS failed FROM t WHERE adapter IS NOT NULL AND status IN ('configured', 'validated')),
r AS (
  SELECT *, concat_ws(',', CASE WHEN status = 'configured' THEN 'configured_without_validated_run' END, CASE WHEN ok_on IS NULL THEN 'never_succeeded' WHEN age >= 7 THEN 'stale_success' END, CASE WHEN records = 0 THEN 'no_tenant_source_records' END, CASE WHEN NOT known THEN 'quality_unknown' WHEN failed THEN 'quality_failed' WHEN grade = 'C' OR q < 0.7 THEN 'quality_weak' END,
    CASE WHEN known AND y < 0.5 THEN 'low_import_yield' END, CASE WHEN known AND e >= 0.25 THEN 'high_error_rate' END, CASE WHEN known AND coalesce(f, 1) < 0.65 THEN 'low_field_coverage' END) AS reasons FROM s),
p AS (
  SELECT id, coalesce(nullif(reasons, ''), 'healthy_refresh') AS reasons, 50 * (ok_on IS NULL)::INT + 35 * (status = 'configured')::INT + 30 * (records = 0)::INT + 10 * (NOT known)::INT + CASE WHEN contains(reasons, 'quality_failed') THEN 35 WHEN contains(reasons, 'quality_weak') THEN 20 ELSE 0 END
    + 20 * contains(reasons, 'low_import_yield')::INT + 20 * contains(reasons, 'high_error_rate')::INT + 15 * contains(reasons, 'low_field_coverage')::INT + coalesce(least(age, 30), 0) + CASE WHEN known THEN floor(round((1 - q) * 20, 9) + 0.5)::INT ELSE 0 END + 5 * (status = 'validated' AND reasons = '')::INT AS points FROM r)
SELECT id, reasons, points::INT AS recovery_score, CASE WHEN points >= 80 THEN 'critical' WHEN points >= 50 THEN 'high' WHEN points >= 25 THEN 'medium' ELSE 'low' END AS recovery_priority FROM p""")
def recovery_plans(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    turn = lambda of, *values: F.get(F.array(*map(F.lit, values)), F.pmod(of, F.lit(len(values))).cast("int"))
    rows = b.read(spark, d, "supplier").select(
        k.alias("id"), turn(k, "configured", "validated", "blocked", "validated").alias("status"), F.when(k % 13 > 0, F.lit("a")).alias("adapter"), F.when(k % 5 > 0, F.date_sub(F.lit("2024-01-20").cast("date"), (k % 41).cast("int")).cast("timestamp")).alias("last_success_at"), F.pmod(F.floor(k / 4), F.lit(3)).alias("records"),
        turn(F.floor(k / 3), None, "A", "B", "C", "D").alias("grade"), ((k % 21) / 20).alias("quality_score"), ((k % 7) / 10).alias("yield"), ((k % 9) / 20).alias("error_rate"), F.when(k % 6 > 0, F.lit(0.55) + (k % 5) / 20).alias("field_coverage"),
    )
    return coverage.recovery_plan(rows, "2024-01-20").select("id", F.array_join("reasons", ",").alias("reasons"), "recovery_score", "recovery_priority")


@query("""
, t AS (SELECT s_suppkey AS id, s_nationkey AS court, s_suppkey % 7 = 0 AS captcha, s_suppkey % 2 = 0 AS runnable, s_suppkey % 3 = 0 AS evidence, CASE WHEN s_suppkey % 5 > 0 THEN 'u' END AS url FROM supplier),
s AS (SELECT *, CASE WHEN captcha THEN 1 WHEN runnable AND evidence THEN 4 WHEN runnable THEN 3 WHEN url IS NOT NULL THEN 2 ELSE 0 END AS r FROM t)
SELECT court, id, ['missing', 'blocked', 'mapped', 'configured', 'validated'][r + 1] AS status FROM s QUALIFY row_number() OVER (PARTITION BY court ORDER BY r DESC, id) = 1""")
def primary_targets(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = b.read(spark, d, "supplier").select(k.alias("id"), F.col("s_nationkey").alias("court"), (k % 7 == 0).alias("needs_captcha"), (k % 2 == 0).alias("runnable"), (k % 3 == 0).alias("has_evidence"), F.when(k % 5 > 0, F.lit("u")).alias("url"))
    return coverage.primary_targets(rows.withColumn("status", coverage.layer_status()), "court", "status", ["id"]).select("court", "id", "status")


@query("""
, t AS (
  SELECT s_nationkey AS court, s_suppkey AS name, ['implemented', 'generic_supported', 'blocked_captcha', 'planned'][s_suppkey % 4 + 1] AS status, CASE WHEN s_suppkey % 3 > 0 THEN 'a' END AS adapter, CASE WHEN s_suppkey % 5 > 0 THEN 'u' END AS url, s_suppkey % 6 = 0 AS ok, CASE WHEN s_suppkey % 7 > 2 THEN s_suppkey % 140 ELSE 0 END AS discovered,
    CASE WHEN s_suppkey % 8 > 5 THEN s_suppkey % 90 END AS records, s_suppkey % 10 AS dataset FROM supplier),
c AS (SELECT s_suppkey % 10 AS dataset, count(*) AS n FROM supplier WHERE s_suppkey % 10 < 5 GROUP BY ALL),
r AS (SELECT *, status IN ('implemented', 'generic_supported') AND adapter IS NOT NULL AS runs, ok OR discovered > 0 OR coalesce(records, 0) > 0 AS evidence FROM t),
k AS (SELECT *, CASE WHEN status = 'blocked_captcha' THEN 1 WHEN runs AND evidence THEN 4 WHEN runs THEN 3 WHEN url IS NOT NULL THEN 2 ELSE 0 END * 1000 + 100 * (adapter IS NOT NULL)::INT + 10 * (url IS NOT NULL)::INT + coalesce(records, 0) + discovered AS rank FROM r),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY court ORDER BY rank DESC, name % 3, name) = 1)
SELECT court, name, rank::BIGINT AS rank, CASE WHEN status = 'blocked_captcha' THEN 'blocked' WHEN runs AND (evidence OR n > 0) THEN 'validated' WHEN runs THEN 'configured' WHEN url IS NOT NULL THEN 'mapped' ELSE 'missing' END AS layer_status,
  round(2 * ok::INT + least(discovered, 100) / 100.0::DOUBLE + least(coalesce(records, 0) + coalesce(n, 0), 100) / 50.0::DOUBLE, 6) AS evidence_score FROM b LEFT JOIN c USING (dataset)""")
def target_layers(spark: SparkSession, d: str) -> DataFrame:
    """The strongest target of each court by status, adapter, address and counts, and the evidence behind its layer."""
    k = F.col("s_suppkey")
    status = F.get(F.array(*map(F.lit, ("implemented", "generic_supported", "blocked_captcha", "planned"))), F.pmod(k, F.lit(4)).cast("int"))
    rows = b.read(spark, d, "supplier").select(
        F.col("s_nationkey").alias("court"), k.alias("name"), status.alias("status"), F.when(k % 3 > 0, F.lit("a")).alias("adapter"), F.when(k % 5 > 0, F.lit("u")).alias("url"), F.when(k % 6 == 0, F.lit("2024-01-01")).alias("last_success_at"), F.when(k % 7 > 2, k % 140).otherwise(0).alias("discovered"),
        F.when(k % 8 > 5, k % 90).alias("records"), (k % 3).alias("priority_order"), (k % 10).alias("dataset"),
    )
    counts = rows.where("dataset < 5").groupBy("dataset").agg(F.count("*").alias("records"))
    return coverage.layers(rows, "court", counts).select("court", "name", F.col("rank").cast("long").alias("rank"), "layer_status", F.round("evidence_score", 6).alias("evidence_score"))


@query("""
, c AS (SELECT s_nationkey AS section, s_suppkey AS id, CASE WHEN s_suppkey % 10 >= 8 THEN 2 WHEN s_suppkey % 10 >= 3 THEN 1 ELSE 0 END AS r FROM supplier)
SELECT section, ['fail', 'warn', 'pass'][min(r) + 1] AS status, count(*) AS checks, count(*) FILTER (r = 0) AS failed FROM c GROUP BY section""")
def readiness_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = b.read(spark, d, "supplier").select(F.col("s_nationkey").alias("section"), coverage.readiness(F.col("s_suppkey") % 10, 3, 8).alias("status"))
    return coverage.roll_up(rows, "section")


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN 0.0 WHEN s_suppkey % 2 > 0 THEN 0.5 WHEN s_suppkey % 3 > 0 OR s_suppkey % 8 = 0 THEN 1.0 WHEN s_suppkey % 5 > 0 THEN 0.75 ELSE 0.25 END::DOUBLE AS score,
  greatest(s_suppkey % 4 - 2, 0)::BIGINT AS found, CASE WHEN s_suppkey % 6 > 0 THEN s_suppkey ELSE 7 END::BIGINT AS imported FROM supplier""")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    """A run's score, and counters that keep what was known where nothing is said, and are never below 0."""
    k = F.col("s_suppkey")
    rows = b.read(spark, d, "supplier").select(k.alias("id"), coverage.coverage_score(F.when(k % 7 == 0, F.lit("failed")).otherwise(F.lit("completed")), k % 2, k % 3, (k % 8 == 0).cast("int"), k % 5).alias("score"), F.lit(0).alias("found"), F.lit(7).alias("imported"))
    new = b.read(spark, d, "supplier").select(k.alias("id"), (k % 4 - 2 + 0.5).alias("found"), F.when(k % 6 > 0, k).alias("imported")).withColumn("found", F.when(F.col("found") < 0, F.floor("found")).otherwise(F.col("found")))
    return coverage.counters(rows, new, "id", ["found", "imported"])


@query("""SELECT tenant_id, round(count(cnj_number)::DOUBLE / count(*), 4) AS cnj_number_ratio, round(count(*) FILTER (asset_id % 4 > 0)::DOUBLE / count(*), 4) AS value_ratio, round(count(*) FILTER (asset_id % 4 > 0 AND cnj_number IS NOT NULL)::DOUBLE / count(*), 4) AS complete_ratio FROM assets WHERE tenant_id = 2 GROUP BY tenant_id""")
def extraction_ratios(spark: SparkSession, d: str) -> DataFrame:
    rows = relational.live(b.assets(spark, d), 2).select("cnj_number", F.when(F.col("asset_id") % 4 > 0, F.col("total")).alias("value"))
    return coverage.extraction_completeness(rows, ["cnj_number", "value"]).select(F.lit(2).alias("tenant_id"), "cnj_number_ratio", "value_ratio", "complete_ratio")


@query("""
, before AS (SELECT event_type AS k, count(*) AS n FROM asset_events WHERE event_id % 2 = 0 AND event_type <> 'view' GROUP BY ALL), after AS (SELECT event_type AS k, count(*) AS n FROM asset_events WHERE event_type <> 'error' GROUP BY ALL)
SELECT coalesce(b.k, a.k) AS event_type, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM before b FULL JOIN after a ON a.k = b.k""")
def count_deltas(spark: SparkSession, d: str) -> DataFrame:
    count = lambda df: df.groupBy("event_type").agg(F.count("*").alias("n"))
    events = b.events(spark, d)
    return relational.deltas(count(events.where("event_id % 2 = 0 and event_type <> 'view'")), count(events.where("event_type <> 'error'")), "event_type", "n")


@query("""
, r AS (SELECT asset_id, asset_id % 2 > 0 AS has_number, asset_id % 3 > 0 AS has_debtor, asset_id % 5 > 1 AS has_value, CASE WHEN asset_id % 11 > 0 THEN exercise_year - CASE WHEN asset_id % 4 = 0 THEN 0 ELSE 1 END * 2 END AS year FROM assets WHERE asset_id % 7 > 0)
SELECT asset_id, 30 * (has_number::INT + has_debtor::INT + has_value::INT) AS data_quality_score, CASE WHEN year IS NOT NULL THEN least(year - 2000, 100) END::INT AS maturity_score, least(30 * (has_number::INT + has_debtor::INT + has_value::INT) + 10, 100) AS final_score FROM r""")
def import_scores(spark: SparkSession, d: str) -> DataFrame:
    """Of imported rows whose fingerprint is not known yet: empty names, values of 0 and years before 2000 among them."""
    k = F.col("asset_id")
    rows = b.assets(spark, d).select(
        "asset_id", F.when(k % 2 > 0, F.col("cnj_number")).alias("cnj_number"), F.when(k % 3 > 0, F.col("debtor_name")).when(k % 6 == 0, F.lit("")).alias("debtor_name"), F.when(k % 5 > 1, F.col("total")).when(k % 5 == 1, F.lit(0)).alias("face_value"),
        F.when(k % 11 > 0, F.col("exercise_year") - F.when(k % 4 == 0, 0).otherwise(2)).alias("exercise_year"), text.fingerprint(id=k).alias("fingerprint"),
    )
    new = pricing.changed_only(rows, rows.where("asset_id % 7 = 0").select("asset_id", "fingerprint"))
    return new.select("asset_id", *(c.cast("int").alias(name) for name, c in pricing.import_scores().items()))


@query("""
, top AS (SELECT asset_id, cnj_number, total FROM assets ORDER BY total DESC, asset_id LIMIT 100)
SELECT '"' || asset_id || '","' || cnj_number || '","' || total || '"' AS line FROM top""")
def exported_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.export_rows(b.assets(spark, d), [F.desc("total"), F.asc("asset_id")], "100", ["asset_id", "cnj_number", "total"])


@query("SELECT asset_id, '# ' || cnj_number || chr(10) || chr(10) || '- **Debtor**: ' || debtor_name || CASE WHEN asset_id % 2 = 0 THEN chr(10) || '- **Total**: ' || total ELSE '' END AS page FROM assets")
def markdown_pages(spark: SparkSession, d: str) -> DataFrame:
    total = F.when(F.col("asset_id") % 2 == 0, F.col("total"))
    return b.assets(spark, d).select("asset_id", evidence.markdown("cnj_number", {"Debtor": "debtor_name", "Total": total, "Nothing": F.lit(None).cast("string")}).alias("page"))


@query("""
, role_of AS (SELECT s_suppkey AS role, unnest([s_suppkey % 3, s_suppkey % 5 + 3]) AS permission FROM supplier)
SELECT role, array_to_string(list_sort(list('p' || permission)), ',') AS permissions FROM role_of GROUP BY role""")
def role_permissions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = b.read(spark, d, "supplier").select(k.alias("role"), F.explode(F.array(k % 3, k % 5 + 3)).alias("permission_id"))
    names = spark.range(8).select(F.col("id").alias("permission_id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("permission"))
    return rows.join(F.broadcast(names), "permission_id").groupBy("role").agg(F.array_join(F.sort_array(F.collect_list("permission")), ",").alias("permissions"))


@query("""
, run AS (SELECT l_suppkey AS source, l_linenumber AS n, l_quantity::BIGINT AS found, (l_quantity / 2)::BIGINT AS saved, (l_returnflag = 'R')::BIGINT AS errors FROM lineitem)
SELECT source, count(*) AS runs, sum(found)::BIGINT AS found, sum(errors)::BIGINT AS errors, count(DISTINCT n) AS kinds FROM run GROUP BY source""")
def run_roll_up(spark: SparkSession, d: str) -> DataFrame:
    rows = b.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("long").alias("found"), (F.col("l_returnflag") == "R").cast("long").alias("errors"))
    return coverage.run_totals(rows, "source", ["found", "errors"], "n")


@query("SELECT n_nationkey AS code, lower(n_name) AS alias, 'https://api/' || lower(n_name) || '/search' AS endpoint FROM nation WHERE n_nationkey % 4 > 0")
def catalogue_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Datasets that a target names, with their address."""
    courts = b.courts(spark, d).select(F.col("court_id").alias("code"), F.col("court").alias("alias"))
    lacking = coverage.without_targets(courts, courts.where("code % 4 > 0"), "code")
    return courts.join(lacking.select("code"), "code", "left_anti").select("code", "alias", tribunals.endpoint("https://api", "alias").alias("endpoint"))
