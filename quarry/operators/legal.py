"""Legal texts: signals, interpretation of publications, deadlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import fold, search_text

# Per signal its polarity, confidence, movement code, and patterns over folded lower-case text.
SIGNALS = (
    ("requisition_issued", "positive", 96, 12457, r"expedicao\s+de\s+precatorio|expedicao\s+de\s+rpv"),
    ("payment_available", "positive", 94, None, r"pagamento\s+(disponibilizado|liberado|efetuado|realizado)|deposito\s+(disponibilizado|liberado|judicial)|alvara\s+(expedido|liberado)"),
    ("final_judgment", "positive", 92, None, r"transito\s+em\s+julgado|certidao\s+de\s+transito"),
    ("calculation_homologated", "positive", 90, None, r"calculo.*homologad|homologacao.*calculo"),
    ("superpreference_granted", "positive", 88, None, r"superpreferencia|preferencia.*idos|doenca\s+grave"),
    ("direct_agreement_opened", "positive", 86, None, r"acordo\s+direto|edital.*acordo|conciliario.*precatorio"),
    ("prior_cession_detected", "negative", 94, None, r"cessao\s+de\s+credito|cessionario|cedente"),
    ("lien_detected", "negative", 90, None, r"penhora|bloqueio|constricao|indisponibilidade"),
    ("suspension_detected", "negative", 88, None, r"suspensao|suspenso|sobrestamento|liminar.*suspend"),
    ("objection_pending", "negative", 84, None, r"impugnacao|embargos|valor\s+controvertido"),
    ("beneficiary_inventory_pending", "negative", 82, None, r"inventario|espolio|herdeir|falecid"),
    ("fee_dispute_detected", "negative", 78, None, r"honorarios|sucumbencia|contratuais"),
    ("special_regime_declared", "negative", 82, None, r"regime\s+especial|moratoria"),
)


def signals(text: Column | str, code: Column | None = None) -> Column:
    """Array of (code, polarity, confidence, matched_by) of the signals in a text or movement code."""
    t, rows = F.coalesce(F.lower(fold(text)), F.lit("")), []
    for name, polarity, confidence, number, pattern in SIGNALS:
        by_text = t.rlike(pattern)
        by_code = F.coalesce(code == number, F.lit(False)) if code is not None and number is not None else F.lit(False)
        how = F.when(by_text & by_code, F.lit("code_or_text")).when(by_code, F.lit("code")).otherwise(F.lit("text"))
        rows.append(F.when(by_text | by_code, F.struct(F.lit(name).alias("code"), F.lit(polarity).alias("polarity"), F.lit(confidence).alias("confidence"), how.alias("matched_by"))))
    return F.array_compact(F.array(*rows))


def classify(df: DataFrame, text: Column | str, keys: list[str], code: Column | None = None) -> DataFrame:
    """One row per key and signal found, with an idempotency key."""
    found = df.select(*keys, F.explode(signals(text, code)).alias("s")).select(*keys, "s.*")
    return found.withColumn("idempotency_key", F.sha2(F.to_json(F.struct(*keys, "code")), 256))


# Kinds of act by their pattern in folded lower-case text, first match wins.
ACTS = (
    ("citation", r"\bcitacao\b|\bcite-se\b|\bcitado\b|\bcitada\b"),
    ("article_523_notice", r"\bart\.?\s*523\b|artigo\s*523|cumprimento\s+de\s+sentenca"),
    ("compliance_challenge", r"\bimpugnacao\s+ao\s+cumprimento|\bimpugnar\s+o\s+cumprimento"),
    ("extrajudicial_execution", r"\bexecucao\s+de\s+titulo\s+extrajudicial|\bembargos\s+a\s+execucao"),
    ("attachment", r"\bpenhora\b|\bbloqueio\b|\bbacenjud\b|\bsisbajud\b"),
    ("appellate_decision", r"\bacordao\b|\bacordam\b|\bturma\s+recursal\b"),
    ("monocratic_decision", r"\bdecisao\s+monocratica\b|\bdecisao\s+do\s+relator\b"),
    ("embargos_decision", r"\bembargos\s+de\s+declaracao\b|\bed\b"),
    ("sentence", r"\bsentenca\b|\bjulgo\s+(procedente|improcedente)|dispositivo\b"),
    ("judgment_docket", r"\bpauta\s+de\s+julgamento\b|\bsessao\s+de\s+julgamento\b"),
    ("counterarguments", r"\bcontrarrazoes\b|\bcontra-razoes\b"),
    ("suspension", r"\bsuspensao\b|\bsuspenso\b|\bsuspender\b"),
    ("case_return", r"\bretorno\s+dos\s+autos\b|\bbaixa\s+dos\s+autos\b|\bdescida\s+dos\s+autos\b"),
    ("court_costs", r"\bcustas\b|\bpreparo\b|\brecolhimento\b"),
    ("interlocutory_decision", r"\bdecisao\b|\bdefiro\b|\bindefiro\b|\bhomologo\b|\brejeito\b|\bacolho\b"),
)
# Acts with a deadline of 15 days, and those whose missed deadline is fatal; words for days.
FIFTEEN_DAYS = ("citation", "sentence", "embargos_decision", "appellate_decision", "article_523_notice", "interlocutory_decision", "compliance_challenge", "monocratic_decision", "counterarguments", "extrajudicial_execution")
FATAL = (
    "citation", "sentence", "embargos_decision", "appellate_decision", "article_523_notice", "interlocutory_decision", "compliance_challenge",
    "monocratic_decision", "judgment_docket", "counterarguments", "extrajudicial_execution", "attachment", "case_return", "court_costs",
)
DEADLINE_WORDS = {"cinco": 5, "oito": 8, "dez": 10, "quinze": 15}
_DEADLINE = r"\bprazo\s+(?:de\s+)?(\d{1,3}|cinco|dez|quinze|oito)\s+dias?\s*(uteis|corridos)?"


# Words in folded lower-case text that name a branch, a notice, a wish to be heard, a denied deadline, a matter, urgency; words of dated events.
SMALL_CLAIMS, FEDERAL_SMALL_CLAIMS = r"\b(jec|juizado especial civel)\b", r"\b(jef|juizado especial federal)\b"
NOTICE, HEARD = r"\bintime-se\b|\bmanifeste-se\b", r"\b(manifeste-se|manifestar|manifestacao|pronuncie-se|diga)\b"
NO_DEADLINE = r"\bsem\s+prazo\b|\bprazo\s+nao\s+informado\b"
MATTERS = (("precatorio", r"\bprecatorio\b|\brpv\b"), ("injunction", r"\btutela\b|\bliminar\b"), ("asset_restriction", r"\bpenhora\b|\bbloqueio\b"))
URGENT = r"\burgente\b|\bliminar\b|\btutela\b|\bpenhora\b|\bbloqueio\b"
HEARING, JUDGMENT = "audiencia|conciliacao|instrucao", "julgamento|sessao"
# Rule of law behind a deadline, by act.
BASIS = {"article_523_notice": "CPC art. 523", "citation": "CPC art. 335", "sentence": "CPC art. 1.003, paragraph 5", "appellate_decision": "CPC art. 1.003, paragraph 5", "interlocutory_decision": "CPC art. 1.015", "embargos_decision": "CPC art. 1.023"}
ASSUMED_BASIS, SMALL_CLAIMS_BASIS = "CPC art. 218, paragraph 3", "Law 9.099/95"


def branch(text: Column, court: Column, judicial_class: Column) -> Column:
    c, special = F.upper(F.coalesce(court, F.lit(""))), F.coalesce(search_text(judicial_class).contains("juizado especial"), F.lit(False))
    return (
        F.when(text.rlike(SMALL_CLAIMS), F.lit("small_claims")).when(text.rlike(FEDERAL_SMALL_CLAIMS), F.lit("federal_small_claims"))
        .when((c == "TST") | c.startswith("TRT"), F.lit("labor")).when(c.startswith("TRF"), F.when(special, F.lit("federal_small_claims")).otherwise(F.lit("federal")))
        .when(c.startswith("TJ"), F.when(special, F.lit("small_claims")).otherwise(F.lit("civil")))
    )


def act_type(text: Column, communication: Column) -> Column:
    notice = F.contains(F.coalesce(search_text(communication), F.lit("")), F.lit("intimacao")) | text.rlike(NOTICE)
    out = F.when(notice, F.lit("order")).otherwise(F.lit("other"))
    for name, pattern in reversed(ACTS):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def dated_event(text: Column, words: str) -> tuple[Column, Column]:
    """(date, time) that ends the reach of 80 characters behind the first of the words: the last date there, and a time at most 30 behind it."""
    pattern = rf"(?s)(?:{words}).{{0,80}}(\d{{2}}/\d{{2}}/\d{{4}})(?:.{{0,30}}?(\d{{1,2}}:\d{{2}}))?"
    get = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    return F.try_to_date(get(1), "dd/MM/yyyy"), F.lpad(get(2), 5, "0")


def interpret(df: DataFrame, text: str, court: Column | None = None, communication: Column | None = None, judicial_class: Column | None = None) -> DataFrame:
    """df with what a publication says: branch, act, deadline, hearing and judgment dates, labels, priority, confidence and reasons for review."""
    none = F.lit(None).cast("string")
    court, communication, judicial_class = (none if c is None else c for c in (court, communication, judicial_class))
    out = df.withColumn("_t", F.coalesce(search_text(text), F.lit("")))
    t = F.col("_t")
    out = out.withColumns({"branch": branch(t, court, judicial_class), "act_type": act_type(t, communication)})
    token = F.regexp_extract(t, _DEADLINE, 1)
    words = F.create_map(*(F.lit(x) for pair in DEADLINE_WORDS.items() for x in pair))
    out = out.withColumn("explicit_days", F.nullif(F.coalesce(token.try_cast("int"), words[token]), F.lit(0)))
    out = out.withColumn("_kind", F.when(F.regexp_extract(t, _DEADLINE, 2) == "corridos", F.lit("calendar_days")).otherwise(F.lit("business_days")))
    act = F.col("act_type")
    canonical = (
        F.when((F.col("branch") == "labor") & act.isin("sentence", "embargos_decision", "appellate_decision"), 8)
        .when(F.col("branch").isin("small_claims", "federal_small_claims") & act.isin("citation", "sentence", "embargos_decision"), 10).when(act.isin(*FIFTEEN_DAYS), 15).when(act == "case_return", 10)
    )
    out = out.withColumn("assumed_deadline", F.col("explicit_days").isNull() & t.rlike(HEARD))
    out = out.withColumn("deadline_days", F.coalesce("explicit_days", canonical, F.when(F.col("assumed_deadline"), 5)))
    out = out.withColumn("deadline_kind", F.when(F.col("explicit_days").isNotNull(), F.col("_kind")).when(F.col("deadline_days").isNotNull(), F.lit("business_days")))
    hearing, judgment = dated_event(t, HEARING), dated_event(t, JUDGMENT)
    out = out.withColumns({"hearing_on": hearing[0], "hearing_time": hearing[1], "judgment_on": judgment[0]})
    due = F.col("deadline_days").isNotNull()
    reasons = F.array_compact(F.array(
        F.when(F.col("assumed_deadline"), F.lit("manifestation_without_explicit_deadline")), F.when(act.isin(*FATAL) & (act != "judgment_docket") & ~due, F.lit("fatal_act_without_deadline")),
        F.when(F.col("explicit_days") > 60, F.lit("unusually_long_deadline")), F.when(due & t.rlike(NO_DEADLINE), F.lit("text_denies_deadline_but_deadline_was_detected")),
    ))
    out = out.withColumn("review_reasons", reasons)
    labels = F.array_distinct(F.array_compact(F.array(
        F.col("branch"), act, F.when(F.col("hearing_on").isNotNull(), F.lit("hearing")), *(F.when(t.rlike(pattern), F.lit(name)) for name, pattern in MATTERS),
    )))
    priority = F.when(t.rlike(URGENT) | (F.col("deadline_days") <= 5), F.lit("high")).when(act.isin(*FATAL) | due, F.lit("medium")).otherwise(F.lit("low"))
    confidence = F.when(F.size("review_reasons") > 0, F.lit("low")).when(due, F.lit("high")).otherwise(F.lit("low"))
    action = F.when(due, F.lit("calendar_deadline")).when(act == "judgment_docket", F.lit("review_date")).otherwise(F.lit("review"))
    by_act = F.create_map(*(F.lit(x) for pair in BASIS.items() for x in pair))[act]
    basis = F.when(F.col("assumed_deadline"), F.lit(ASSUMED_BASIS)).when((act == "citation") & (F.col("branch") == "small_claims"), F.lit(SMALL_CLAIMS_BASIS)).otherwise(by_act)
    return out.withColumns({"labels": labels, "priority": priority, "confidence": confidence, "recommended_action": action, "legal_basis": basis}).drop("_t", "_kind")


def classify_movements(movements: DataFrame, complements: DataFrame) -> DataFrame:
    """(process_id, movement_id, asset_id, code, polarity, confidence, matched_by, idempotency_key, evidence) of the signals in movements.

    movements: process_id, movement_id, asset_id, code, name, raw (JSON), at. complements: movement_id, position, code,
    value, name, description. The text of a movement is its name, its raw data and what its complements say; code
    12457 is a signal whatever the text. A signal of a movement is one row, however often it is classified.
    """
    said = F.concat_ws(" ", "name", "description", F.col("code").cast("string"), F.col("value").cast("string"))
    per = complements.groupBy("movement_id").agg(F.array_sort(F.collect_list(F.struct("position", said.alias("text"), "code", "value", "name", "description"))).alias("complements"))
    rows = movements.join(per, "movement_id", "left")
    texts = F.transform(F.coalesce("complements", F.array().cast(per.schema["complements"].dataType)), lambda c: c["text"])
    rows = rows.withColumn("_text", F.concat_ws(" ", "name", F.coalesce("raw", F.lit("")), F.array_join(texts, " ")))
    found = rows.select("process_id", "movement_id", "asset_id", "code", "name", "at", "complements", F.explode(signals("_text", F.col("code"))).alias("s"))
    key = F.sha2(F.to_json(F.struct(F.lit("datajud").alias("source"), F.col("process_id").alias("processId"), F.col("movement_id").alias("movementId"), F.col("s.code").alias("signalCode"))), 256)
    evidence = F.struct(F.col("code").alias("movement_code"), F.col("name").alias("movement_name"), "at", "complements")
    return found.select("process_id", "movement_id", "asset_id", "s.code", "s.polarity", "s.confidence", "s.matched_by", key.alias("idempotency_key"), evidence.alias("evidence")).dropDuplicates(["idempotency_key"])


def movement_events(found: DataFrame) -> DataFrame:
    """Events of assets from signals of classify_movements: (asset_id, event_type, at, idempotency_key); processes without an asset give none."""
    return found.where("asset_id is not null").select("asset_id", F.col("code").alias("event_type"), F.col("evidence.at").alias("at"), F.concat(F.lit("datajud-signal:"), "idempotency_key").alias("idempotency_key"))
