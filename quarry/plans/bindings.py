"""The engine's canonical tables over a TPC-H-like data set.

Each function gives a DataFrame of one canonical table. SQL has the same tables as common table expressions
for the DuckDB side of the query checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import check_digits

NOW = "1998-12-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("tenant_id"), F.col("r_name").alias("name"))


def courts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One court per nation: 25 rows."""
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("court_id"), F.lower("n_name").alias("court"), F.col("n_regionkey").alias("tenant_id"))


def debtors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*(F.lit(x) for pair in DEBTOR_TYPES.items() for x in pair))
    return read(spark, sf_dir, "customer").join(F.broadcast(courts(spark, sf_dir)), F.col("c_nationkey") == F.col("court_id")).select(
        F.col("c_custkey").alias("debtor_id"), "tenant_id", "court_id", "court", F.col("c_name").alias("name"), kind[F.col("c_mktsegment")].alias("debtor_type"),
        F.when(F.pmod(F.col("c_nationkey"), F.lit(3)) == 0, F.lit("special")).otherwise(F.lit("general")).alias("payment_regime"),
        F.least(F.greatest(F.floor((F.col("c_acctbal") + 1000) / 110), F.lit(0)), F.lit(100)).cast("int").alias("reliability"),
    )


# How the five segments, three states and five priorities are read.
DEBTOR_TYPES = {"AUTOMOBILE": "union", "BUILDING": "state", "FURNITURE": "municipality", "MACHINERY": "autarchy", "HOUSEHOLD": "foundation"}
LIFECYCLES = {"F": "paid", "O": "in_payment", "P": "pending"}


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One asset per order, with the debtor's tenant and court, and a valid process number."""
    owner = debtors(spark, sf_dir).select("debtor_id", "tenant_id", "court_id", "court", "name", "debtor_type", "payment_regime", "reliability")
    orders = read(spark, sf_dir, "orders")
    life = F.create_map(*(F.lit(x) for pair in LIFECYCLES.items() for x in pair))
    part = [F.lpad(F.pmod(F.col("o_orderkey"), F.lit(10_000_000)).cast("string"), 7, "0"), F.year("o_orderdate").cast("string"), F.lit("4"), F.lpad((F.pmod(F.col("court_id"), F.lit(6)) + 1).cast("string"), 2, "0"), F.lit("3400")]
    number = F.concat(part[0], F.lit("-"), check_digits(*part), F.lit("."), part[1], F.lit("."), part[2], F.lit("."), part[3], F.lit("."), part[4])
    return orders.join(owner, F.col("o_custkey") == F.col("debtor_id")).select(
        F.col("o_orderkey").alias("asset_id"), "tenant_id", "debtor_id", "court_id", "court", F.col("name").alias("debtor_name"), "debtor_type", "payment_regime", "reliability", number.alias("cnj_number"),
        F.coalesce(life[F.col("o_orderstatus")], F.lit("unknown")).alias("lifecycle_status"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit("alimentar")).when(F.col("o_orderpriority") == "5-LOW", F.lit("unknown")).otherwise(F.lit("comum")).alias("nature"),
        F.year("o_orderdate").alias("exercise_year"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").cast("decimal(18,2)").alias("total"),
    )


def updated_value(price: Column, discount: Column, tax: Column) -> Column:
    return (price * (1 - discount.cast("decimal(4,2)")) * (1 + tax.cast("decimal(4,2)"))).cast("decimal(18,2)")


def valuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One valuation per line item; valuation_rank orders what shares a date."""
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("asset_id"), F.col("l_shipdate").alias("computed_at"), "l_linenumber", "l_partkey", "l_suppkey", price.alias("face_value"),
        updated_value(price, F.col("l_discount"), F.col("l_tax")).alias("updated_value"), F.col("l_linenumber").cast("int").alias("queue_position"),
    )


#: Total order of an asset's valuations, newest first.
LATEST = (F.desc, "computed_at"), (F.desc, "l_linenumber"), (F.desc, "face_value"), (F.asc, "l_partkey"), (F.asc, "l_suppkey")


def newest(**names: str) -> list:
    """The same order as values of which the highest is the newest; names are columns' other names."""
    return [F.col(names.get(column, column)) if direction is F.desc else -F.col(names.get(column, column)) for direction, column in LATEST]


def latest_order() -> list:
    return [direction(column) for direction, column in LATEST]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One asset event per event of a user, read as the asset of that number."""
    kind = F.create_map(*(F.lit(x) for pair in EVENT_SIGNALS.items() for x in pair))
    return read(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("asset_id"), F.col("ts").alias("event_at"), kind[F.col("event_type")].alias("code"), "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"), "props",
    )


# The signal that each kind of event stands for.
EVENT_SIGNALS = {"signup": "requisition_issued", "error": "suspension_detected", "click": "direct_agreement_window", "view": "queue_position_favorable", "purchase": "payment_process_detected"}


# Texts of publications, in turn by event.
PUBLICATIONS = (
    "Expedição de precatório. Cite-se a ré para contestar no prazo de 15 dias úteis.",
    "Suspensão do processo por decisão liminar; manifeste-se a parte.",
    "Homologação do cálculo. Acordo direto: prazo de 10 dias corridos.",
    "Audiência de conciliação redesignada de 01/02/2024 para 12/05/2024 às 14:30. Intime-se.",
    "Pagamento liberado; alvará expedido. Penhora e honorários contratuais em sentença.",
    "Certidão de trânsito em julgado. Baixa dos autos.",
    "Deferida a superpreferência por doença grave. Expedição de RPV.",
    "Cessão de crédito comunicada pelo cessionário. Prazo de 5 dias corridos para impugnar.",
    "Impugnação ao cumprimento apresentada; valor controvertido. Prazo de quinze dias uteis.",
    "Embargos de declaração rejeitados. Recolhimento de custas.",
    "Óbito: espólio e herdeiros habilitados em inventário. Diga a parte contrária.",
    "Município em regime especial e moratória. Julgo procedente o pedido.",
    "Acórdão publicado. Turma recursal. Embargos à execução.",
    "Decisão do relator. Tutela de urgência indeferida.",
    "Cumprimento de sentença, art. 523 do CPC.",
    "Execução de título extrajudicial. Bloqueio via SISBAJUD.",
    "Pauta de julgamento: sessão de julgamento em 10/08/2026.",
    "Contrarrazões no prazo de 90 dias.",
    "Defiro o pedido. Prazo de oito dias. Certidão sem prazo.",
    "Retorno dos autos. Ciência às partes.",
    "Preparo insuficiente. Pronuncie-se o autor com urgência.",
    "Juizado especial cível: sentença de improcedência.",
    "JEF. Citação do INSS.",
    "Ato ordinatório.",
    "Suspenso o feito até nova ordem.",
)


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One publication per event: texts, courts, classes and kinds of communication in turn."""
    turn = lambda values: F.get(F.array(*map(F.lit, values)), F.pmod("event_id", F.lit(len(values))).cast("int"))
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("publication_id"), F.col("user_id").alias("asset_id"), F.to_date("ts").alias("published_on"), turn(("trf1", "TRT2", "TST", "TJSP", None, "tjrj", "TRF3")).alias("court"),
        turn(("Juizado Especial", "Procedimento comum", None)).alias("judicial_class"), turn(("Intimação", None, "Edital", None)).alias("communication"), turn(PUBLICATIONS).alias("text"), "event_type",
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence links of assets to source records; a supplier is a source."""
    role = F.when(F.col("l_returnflag") == "R", F.lit("conflict")).when(F.col("l_returnflag") == "A", F.lit("primary")).otherwise(F.lit("enrichment"))
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("asset_id"), F.col("l_suppkey").alias("source_id"), role.alias("role"), F.col("l_shipdate").alias("seen_at"), F.col("l_linestatus").alias("status"))


def _case(column: str, values: dict[str, str], default: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {default} END"


SQL = f"""
courts AS (SELECT n_nationkey AS court_id, lower(n_name) AS court, n_regionkey AS tenant_id FROM nation),
debtors AS (
  SELECT c_custkey AS debtor_id, tenant_id, court_id, court, c_name AS name, {_case('c_mktsegment', DEBTOR_TYPES)} AS debtor_type,
    CASE WHEN c_nationkey % 3 = 0 THEN 'special' ELSE 'general' END AS payment_regime,
    least(greatest(floor((c_acctbal + 1000) / 110), 0), 100)::INT AS reliability
  FROM customer JOIN courts ON c_nationkey = court_id),
numbered AS (
  SELECT *, lpad((o_orderkey % 10000000)::VARCHAR, 7, '0') AS p1, year(o_orderdate)::VARCHAR AS p2, lpad((court_id % 6 + 1)::VARCHAR, 2, '0') AS p3
  FROM orders JOIN debtors ON o_custkey = debtor_id),
assets AS (
  SELECT o_orderkey AS asset_id, tenant_id, debtor_id, court_id, court, name AS debtor_name, debtor_type, payment_regime, reliability,
    p1 || '-' || lpad((98 - ((p1 || p2 || '4' || p3 || '340000')::HUGEINT % 97))::VARCHAR, 2, '0') || '.' || p2 || '.4.' || p3 || '.3400' AS cnj_number,
    {_case('o_orderstatus', LIFECYCLES, "'unknown'")} AS lifecycle_status,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'alimentar' WHEN o_orderpriority = '5-LOW' THEN 'unknown' ELSE 'comum' END AS nature,
    year(o_orderdate)::INT AS exercise_year, o_orderdate AS created_at, o_totalprice::DECIMAL(18,2) AS total
  FROM numbered),
valuations AS (
  SELECT l_orderkey AS asset_id, l_shipdate AS computed_at, l_linenumber, l_partkey, l_suppkey, l_extendedprice::DECIMAL(12,2) AS face_value,
    (l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)) * (1 + l_tax::DECIMAL(4,2)))::DECIMAL(18,2) AS updated_value, l_linenumber::INT AS queue_position
  FROM lineitem),
latest AS (
  SELECT * FROM valuations
  QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY computed_at DESC, l_linenumber DESC, face_value DESC, l_partkey, l_suppkey) = 1),
asset_events AS (
  SELECT event_id, user_id AS asset_id, ts AS event_at, {_case('event_type', EVENT_SIGNALS)} AS code, event_type, value, (props->>'$.k')::INT AS k, props FROM events),
publications AS (
  SELECT event_id AS publication_id, user_id AS asset_id, ts::DATE AS published_on, ['trf1', 'TRT2', 'TST', 'TJSP', NULL, 'tjrj', 'TRF3'][event_id % 7 + 1] AS court,
    ['Juizado Especial', 'Procedimento comum', NULL][event_id % 3 + 1] AS judicial_class, ['Intimação', NULL, 'Edital', NULL][event_id % 4 + 1] AS communication,
    [{", ".join("'" + x + "'" for x in PUBLICATIONS)}][event_id % {len(PUBLICATIONS)} + 1] AS text, event_type FROM events),
links AS (
  SELECT l_orderkey AS asset_id, l_suppkey AS source_id, CASE l_returnflag WHEN 'R' THEN 'conflict' WHEN 'A' THEN 'primary' ELSE 'enrichment' END AS role,
    l_shipdate AS seen_at, l_linestatus AS status FROM lineitem)
"""
