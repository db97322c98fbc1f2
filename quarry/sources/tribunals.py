"""Records of court lists from their several layouts, all to the columns of RECORD."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import json
from quarry.functions.dates import day_or_null, local_moment, short_month
from quarry.functions.maths import reliability
from quarry.functions.text import (
    brazilian_money,
    code_key,
    collapse,
    debtor_type,
    digits,
    find_money,
    find_process_number,
    find_year,
    fold,
    header_key,
    money_cell,
    nature,
    padded_process_number,
    percent_cell,
    preference,
    process_number,
    process_number_without_origin,
    short_process_number,
    whole_number,
)
from quarry.sources.files import blocks, carried, cells, computed, delimited, html_rows, kept_index, lines, previous

RECORD = ("cnj_number", "debtor_name", "value", "year", "queue_position", "nature", "preference")
# Column names under which each field comes.
ALIASES = {
    "number": ("cnj", "processo", "numero_do_processo", "process_number", "numero_processo", "precatorio", "processo_originario"),
    "debtor": ("devedor", "entidade", "ente_devedor", "entidade_devedora", "debtor", "reu", "requerido"),
    "value": ("valor", "valor_atualizado", "valor_do_precatorio", "valor_original", "value", "face_value"),
    "year": ("ano", "exercicio", "proposta", "orcamento", "budget", "year", "ano_orcamento"),
    "order": ("ordem", "posicao", "ordem_cronologica", "order", "numero_de_ordem"),
    "nature": ("natureza", "natureza_do_credito", "nature", "tipo"),
    "preference": ("preferencia", "prioridade", "preference", "superpreferencia"),
}


# Names of the columns of requisition lists, in the order in which they are tried.
REQUISITION = {
    "process": ("processo", "numero_do_processo", "numero_processo", "numero_do_precatorio", "precatorio", "prc", "num_req", "numero_da_requisicao", "requisicao"), "requisition": ("num_req", "numero_requisicao", "numero_da_requisicao", "requisicao"),
    "value": ("valor_atualizado", "valor_requisitado", "valor_do_precatorio", "valor", "valor_principal", "parcela_devida"), "order": ("n_ordem", "ordem", "ordem_cronologica", "numero_ordem", "n_de_ordem_cronologica"),
    "year": ("proposta", "exercicio", "ano_proposta", "ano_orcamento", "ano"), "origin": ("processo_originario", "processo_de_origem", "proc_orig_execucao", "origem"), "debtor": ("entidade_devedora", "ente_devedor", "devedor", "orgao_devedor", "unidade_orcamentaria"),
    "nature": ("natureza_do_credito", "natureza_credito", "natureza", "tipo"), "filed": ("data_de_apresentacao", "data_apresentacao", "data_de_autuacao", "autuado_em", "autuacao"),
}


def pick(row: Column | str, field: str) -> Column:
    """The first filled cell among a field's names."""
    source = F.col(row) if isinstance(row, str) else row
    return F.coalesce(*(F.nullif(F.trim(source[name]), F.lit("")) for name in ALIASES[field]))


def flat(row: Column | str) -> Column:
    return F.concat_ws(" ", F.map_values(F.col(row) if isinstance(row, str) else row))


def records(df: DataFrame, keys: list[str], row: str = "row", need_number: bool = False, number=process_number) -> DataFrame:
    """RECORD columns of mapped rows, found by column names, else in the row's text.

    Rows with neither process number nor value nor year go, with need_number all without process number.
    """
    text = flat(row)
    out = df.select(
        *keys, F.coalesce(number(pick(row, "number")), find_process_number(text)).alias("cnj_number"), collapse(pick(row, "debtor")).alias("debtor_name"),
        F.coalesce(money_cell(pick(row, "value")), find_money(text)).alias("value"), F.coalesce(find_year(F.lit(None).cast("string"), [pick(row, "year")]), find_year(text)).alias("year"),
        whole_number(pick(row, "order")).alias("queue_position"), nature(F.coalesce(pick(row, "nature"), text)).alias("nature"), preference(F.coalesce(pick(row, "preference"), text)).alias("preference"),
    )
    out = computed(out, *(["cnj_number"] if need_number else ["cnj_number", "value", "year"]))
    return out.where("cnj_number is not null" if need_number else "cnj_number is not null or value is not null or year is not null")


def delimited_records(df: DataFrame, key: str, text: str | None, header: Column | None = None) -> DataFrame:
    return records(delimited(lines(df, key, text), key, header), [key, "n"])


def excel_html(df: DataFrame, key: str, html: str) -> DataFrame:
    """Spreadsheets saved as HTML: rows of at least seven cells with a year and a process number, some with six-digit sequences."""
    rows = html_rows(df, key, html).where(F.size("cells") >= 7)
    text = F.array_join("cells", " | ")
    numbers = F.filter(F.transform("cells", short_process_number), lambda c: c.isNotNull())
    out = rows.select(key, "n", F.get(numbers, F.lit(0)).alias("cnj_number"), find_money(text).alias("value"), find_year(text).alias("year"), nature(text).alias("nature"), preference(text).alias("preference"))
    return out.where("cnj_number is not null and year is not null")


def chronological_csv(df: DataFrame, key: str, text: str | None) -> DataFrame:
    """Lists whose header stands somewhere below a preamble; one record per process number.

    Sums of values, the first position, the first other cells, and the masked documents of a number.
    """
    is_header = F.lower(F.col("line")).rlike("ordem|processo|precat") & (F.size(F.split("line", ";")) >= 5)
    rows = delimited(lines(df, key, text), key, is_header)
    found = records(rows, [key, "n", "row"], need_number=True)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("n")))
    mask = F.regexp_extract(flat("row"), r"(\d{3}\*{4,})", 1)
    return found.groupBy(key, "cnj_number").agg(
        F.sum("value").alias("value"), F.min("queue_position").alias("queue_position"), first("debtor_name").alias("debtor_name"), first("year").alias("year"), first("nature").alias("nature"),
        F.sort_array(F.collect_set(F.nullif(mask, F.lit("")))).alias("masks"), F.count("*").alias("rows"), F.min(short_month(pick("row", "year"))).alias("published_on"),
    )


def budget_list(df: DataFrame, key: str, text: str | None) -> DataFrame:
    """Lists below a preamble whose header names the number of the precatório; rows without one go.

    A row without a position has its number among the rows that stay.
    """
    is_header = F.array_contains(F.transform(F.split("line", ";"), header_key), "numero_do_precatorio")
    r = F.col("row")
    number = F.nullif(F.trim(r["numero_do_precatorio"]), F.lit(""))
    basis = F.nullif(F.trim(r["base_legal_para_enquadramento_na_ordem_cronologica"]), F.lit(""))
    # What clauses of the legal basis say.
    said = F.upper(fold(F.coalesce(basis, F.lit(""))))
    wish = F.when(said.contains("INCISO II"), F.lit("superpreferential")).when(said.contains("INCISO III"), F.lit("alimentar_preferential")).when(said.contains("INCISO IV"), F.lit("alimentar_balance")).when(said.contains("INCISO V"), F.lit("common"))
    kind = F.when(said.contains("NAO ALIMENTARES") | said.contains("INCISO V"), F.lit("comum")).otherwise(F.lit("alimentar"))
    rows = kept_index(delimited(lines(df, key, text), key, is_header).where(number.isNotNull()), key, "_at")
    return rows.select(
        key, "n", F.coalesce(whole_number(r["n_de_ordem_cronologica"]).cast("int"), F.col("_at")).alias("queue_position"), whole_number(r["proposta"]).cast("int").alias("year"), number.alias("process_number"), process_number(number).alias("cnj_number"),
        brazilian_money(r["parcela_devida"]).alias("value"), brazilian_money(r["valor_pago"]).alias("paid_value"), wish.alias("preference"), kind.alias("nature"),
    )


def requisitions(df: DataFrame, keys: list[str], row: str = "row", fallback_year: Column | None = None) -> DataFrame:
    """Rows of requisition lists by the names of REQUISITION. Only rows without any of process number, value, process and requisition go.

    process: the process, else its number, else the requisition, else `row:` and the hash of the row.
    """
    cell = lambda name: F.coalesce(*(F.nullif(F.trim(F.col(row)[c]), F.lit("")) for c in REQUISITION[name]))
    cnj = F.coalesce(process_number(cell("process")), find_process_number(flat(row)))
    out = df.select(
        *keys, cnj.alias("cnj_number"), cell("process").alias("_process"), cell("requisition").alias("requisition"), money_cell(cell("value")).alias("value"), whole_number(cell("order")).cast("int").alias("queue_position"),
        F.coalesce(whole_number(cell("year")).cast("int"), find_year(flat(row)), fallback_year if fallback_year is not None else F.lit(None).cast("int")).alias("year"), cell("origin").alias("origin"), collapse(cell("debtor")).alias("debtor_name"), nature(cell("nature")).alias("nature"),
        day_or_null(cell("filed")).alias("filed_on"), F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(row)))), 256).alias("_row"),
    )
    out = out.where(F.col("cnj_number").isNotNull() | (F.coalesce("value", F.lit(0)) != 0) | F.col("_process").isNotNull() | F.col("requisition").isNotNull())
    return out.withColumn("process", F.coalesce("_process", "cnj_number", "requisition", F.concat(F.lit("row:"), "_row"))).drop("_process", "_row")


def positional_budget(df: DataFrame, key: str, text: str | None, amounts: int = 11, percents: int = 3) -> DataFrame:
    """Budget tables by position: a five-digit code, a name that is not a total, amounts, then percentages."""
    rows = lines(df, key, text).withColumn("c", cells("line", ";")).where(F.get("c", F.lit(0)).rlike(r"^\d{5}$") & (F.lower(F.get("c", F.lit(1))) != "total"))
    money = [money_cell(F.get("c", F.lit(2 + k))).alias(f"amount_{k + 1}") for k in range(amounts)]
    share = [percent_cell(F.get("c", F.lit(2 + amounts + k))).alias(f"percent_{k + 1}") for k in range(percents)]
    return rows.select(key, "n", F.get("c", F.lit(0)).alias("code"), F.get("c", F.lit(1)).alias("name"), *money, *share)


def report_blocks(df: DataFrame, key: str, text: str | None) -> DataFrame:
    """Reports in which a line with position and process number opens a record of several lines."""
    starts = F.col("line").rlike(r"^\s*\d+\s+\d{7}-?\d{2}\.?\d{4}\.?\d\.?\d{2}")
    debtor = F.nullif(F.trim(F.regexp_extract("line", r"(?i)^\s*(?:entidade|ente)\s+devedor[a]?\s*:\s*(.+)$", 1)), F.lit(""))
    rows = carried(lines(df, key, text), key, debtor, "debtor_name").withColumn("line", F.concat_ws("\x01", "line", F.when(starts, F.coalesce("debtor_name", F.lit("")))))
    out = blocks(rows, key, F.col("line").rlike(r"^\s*\d+\s+\d{7}-?\d{2}\.?\d{4}\.?\d\.?\d{2}"))
    body = F.regexp_replace("text", "\x01[^\n]*", "")
    number = F.regexp_extract("text", r"\d{7}-?\d{2}\.?\d{4}\.?\d\.?\d{2}(?:\.?\d{4})?", 0)
    return out.select(
        key, "block", whole_number(F.regexp_extract("text", r"^\s*(\d+)\s", 1)).alias("queue_position"), process_number_without_origin(number).alias("cnj_number"),
        F.nullif(F.trim(F.regexp_extract("text", "\x01([^\n]*)", 1)), F.lit("")).alias("debtor_name"), find_money(body).alias("value"), nature(body).alias("nature"), preference(body).alias("preference"),
    )


def sectioned_text(df: DataFrame, key: str, text: str | None) -> DataFrame:
    """Lists under section titles (alimentar, comum) that hold for the lines below: position, number, amount, preference."""
    upper = F.upper(F.col("line"))
    title = F.when(~F.col("line").rlike(r"\d{10}"), F.when(upper.contains("ALIMENTAR"), F.lit("alimentar")).when(upper.contains("COMUM") | upper.contains("COMUNS"), F.lit("comum")))
    rows = carried(lines(df, key, text), key, title, "nature")
    pattern = r"^\s*(\d+)\s+([\d.-]{17,25})\s+(?:R\$\s*)?([\d.]+,\d{2})\s*(.*)$"
    get = lambda k: F.regexp_extract("line", pattern, k)
    return rows.where(F.col("line").rlike(pattern)).select(key, "n", whole_number(get(1)).alias("queue_position"), padded_process_number(get(2)).alias("cnj_number"), brazilian_money(get(3)).alias("value"), "nature", preference(get(4)).alias("preference"))


def annual_map(df: DataFrame, key: str, text: str | None) -> DataFrame:
    """Annual debt maps: lines with court, year, sphere, state and four amounts; a name may stand on up to three lines before."""
    pattern = r"^\s*TJ[A-Z]{2,3}\s+(20\d{2})\s+(\S+)\s+([A-Z]{2})\s+(?:(\d{7})\s+)?(ESPECIAL|GERAL|COMUM)\s+(\S+)\s+(?:(\d{14}|\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2})\s+)?(.*?)\s*R\$\s*([\d.,-]+)\s+R\$\s*([\d.,-]+)\s+R\$\s*([\d.,-]+)\s+R\$\s*([\d.,-]+)\s*$"
    rows = lines(df, key, text).withColumn("line", collapse("line"))
    is_row = F.col("line").rlike("(?i)" + pattern)
    # Of the three lines before, those behind the last row.
    rows = previous(rows, key, F.when(~is_row, F.col("line")), 3, "_before")
    behind = F.aggregate("_before", F.array().cast("array<string>"), lambda out, x: F.when(x.isNull(), F.array().cast("array<string>")).otherwise(F.concat(out, F.array(x))))
    rows = rows.withColumn("_before", collapse(F.array_join(behind, " "))).where(is_row)
    get = lambda k: F.nullif(F.trim(F.regexp_extract("line", "(?i)" + pattern, k)), F.lit(""))
    name = F.coalesce(get(8), F.nullif("_before", F.lit("")), F.concat(F.lit("Municipality IBGE "), get(4), F.lit(" - "), get(3)))
    money = {label: brazilian_money(get(9 + k)) for k, label in enumerate(("debt_before", "paid", "current_year", "debt_after"))}
    out = rows.select(key, "n", get(1).cast("int").alias("year"), get(2).alias("sphere"), get(3).alias("state"), get(4).alias("ibge"), (F.upper(get(5)) == "ESPECIAL").alias("special"), digits(get(7)).alias("cnpj"), name.alias("debtor_name"), *(v.alias(k) for k, v in money.items()))
    return out.withColumn("open_stock", F.coalesce("debt_after", F.lit(0)) + F.coalesce("current_year", F.lit(0))).withColumn("debtor_type", debtor_type("debtor_name"))


def payment_stats(rows: DataFrame, keys: list[str], source: str = "tjrj_annual_map") -> DataFrame:
    """Rows of annual_map as payment statistics of debtors: (keys, debtor_name, source, period_start, period_end, sample_size, paid_volume, open_debt_stock, regime_special, reliability_score).

    One row for each debtor and year, the last by n: what an upsert by debtor and source keeps. Due is what was owed
    before and what the year added.
    """
    due = F.coalesce("debt_before", F.lit(0)) + F.coalesce("current_year", F.lit(0))
    each = rows.withColumn("source", F.concat(F.lit(f"{source}:"), F.col("year").cast("string"))).withColumns({"_due": due, "special": F.coalesce("special", F.lit(False))})
    last = each.groupBy(*keys, "debtor_name", "source").agg(F.max_by(F.struct("year", "paid", "open_stock", "special", "_due"), "n").alias("_x")).select(*keys, "debtor_name", "source", "_x.*")
    score = reliability(F.coalesce("paid", F.lit(0)), F.col("_due"), F.col("special")).cast("int")
    return last.select(*keys, "debtor_name", "source", F.make_date("year", F.lit(1), F.lit(1)).alias("period_start"), F.make_date("year", F.lit(12), F.lit(31)).alias("period_end"), F.lit(1).alias("sample_size"), F.col("paid").alias("paid_volume"), F.col("open_stock").alias("open_debt_stock"), F.col("special").alias("regime_special"), score.alias("reliability_score"))


def pdf_rows(df: DataFrame, key: str, text: str | None) -> DataFrame:
    """Lists in which a line is position, number, local date and time, nature, amount and debtor."""
    pattern = r"^\s*(\d+)\s+([\d.-]{20,25})\s+(\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2})\s+(\S+)\s+(?:R\$\s*)?([\d.]+,\d{2})\s+(.*)$"
    get = lambda k: F.regexp_extract("line", pattern, k)
    return lines(df, key, text).where(F.col("line").rlike(pattern)).select(key, "n", whole_number(get(1)).alias("queue_position"), process_number(get(2)).alias("cnj_number"), local_moment(get(3)).alias("presented_at"), nature(get(4)).alias("nature"), brazilian_money(get(5)).alias("value"), F.trim(get(6)).alias("debtor_name"))


def json_pages(df: DataFrame, keys: list[str], payload: str, items: str = "content") -> DataFrame:
    """RECORD columns of API pages: a JSON object with an array of flat objects."""
    rows = df.select(*keys, F.posexplode(F.from_json(F.get_json_object(payload, f"$.{items}"), "array<map<string,string>>")).alias("n", "row"))
    return records(computed(rows.withColumn("row", F.transform_keys("row", lambda k, v: F.lower(code_key(k)))), "row"), [*keys, "n"])


def process_hits(df: DataFrame, payload: str) -> dict[str, DataFrame]:
    """Processes, subjects, movements and complements of API hits, each keyed by the process number.

    payload: JSON with numeroProcesso, tribunal, dataAjuizamento, classe, assuntos (objects, or arrays of them
    up to two deep, of which only objects count) and movimentos with complementosTabelados. A hit without a
    valid number goes.
    """
    shape = "numeroProcesso string, tribunal string, dataAjuizamento string, classe struct<codigo:int,nome:string>, assuntos array<string>, movimentos array<struct<codigo:int,nome:string,dataHora:string,complementosTabelados:array<struct<codigo:int,valor:string,nome:string>>>>"
    hits = computed(df.select(F.from_json(payload, shape).alias("h")), "h")
    hits = computed(hits.select(process_number("h.numeroProcesso").alias("cnj_number"), "h.*"), "cnj_number").where("cnj_number is not null")
    subjects = computed(hits.select("cnj_number", F.transform(json.objects("assuntos"), lambda x: F.from_json(x, "codigo int, nome string")).alias("assuntos")), "assuntos")
    from quarry.functions.dates import moment_or_null

    movements = hits.select("cnj_number", F.posexplode("movimentos").alias("n", "m"))
    key = F.sha2(F.concat_ws("|", "cnj_number", "n", "m.codigo", "m.dataHora"), 256)
    return {
        "processes": hits.select("cnj_number", F.lower("tribunal").alias("court"), moment_or_null("dataAjuizamento").alias("filed_at"), F.col("classe.codigo").alias("class_code"), F.col("classe.nome").alias("class_name")),
        "subjects": subjects.select("cnj_number", F.posexplode("assuntos").alias("n", "s")).select("cnj_number", (F.col("n") + 1).alias("position"), F.col("s.codigo").alias("code"), F.col("s.nome").alias("name")),
        "movements": movements.select("cnj_number", (F.col("n") + 1).alias("position"), F.col("m.codigo").alias("code"), F.col("m.nome").alias("name"), moment_or_null("m.dataHora").alias("at"), key.alias("idempotency_key")),
        "complements": movements.select("cnj_number", key.alias("idempotency_key"), F.posexplode("m.complementosTabelados").alias("n", "c")).select("cnj_number", "idempotency_key", (F.col("n") + 1).alias("position"), F.col("c.codigo").alias("code"), F.col("c.valor").alias("value"), F.col("c.nome").alias("name")),
    }


def budget_row(df: DataFrame, row: str = "row") -> DataFrame:
    """A row of the federal open-data file, with money, rates, dates and flags, and what is missing in it."""
    from quarry.functions.text import brazilian_decimal, yes_no

    r = F.col(row)
    out = df.select(
        "*", F.nullif(F.trim(r["chave"]), F.lit("")).alias("external_id"), process_number(r["cnj"]).alias("cnj_number"), whole_number(r["exercicio"]).cast("int").alias("exercise_year"), F.trim(r["nome_da_uo_executada"]).alias("debtor_name"),
        brazilian_money(F.coalesce(r["valor_original_do_precatorio"], r["valor"])).alias("face_value"), brazilian_money(r["valor_atualizado"]).alias("updated_value"), brazilian_decimal(r["indiceatualizacao"]).alias("index_value"),
        yes_no(r["tributario"]).alias("is_tax"), yes_no(r["fundef"]).alias("is_fundef"), day_or_null(r["data_de_ajuizamento_da_acao_originaria"]).alias("filed_on"), day_or_null(r["data_da_autuacao"]).alias("registered_on"),
    )
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    errors = F.array_compact(F.array(F.when(blank("debtor_name"), F.lit("debtor_missing")), F.when(F.coalesce(F.col("face_value").cast("double"), F.lit(0.0)) == 0, F.lit("face_value_invalid"))))
    return out.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def import_status(rows: DataFrame, key: str) -> DataFrame:
    """Per import: failed with errors and nothing taken, partial with errors, else completed, also if it is empty. rows: one per import and row; `valid` is null for an import without rows."""
    out = rows.groupBy(key).agg(F.count("valid").alias("total"), F.count_if("valid").alias("imported"), F.count_if(~F.col("valid")).alias("errors"))
    return out.withColumn("status", F.when((F.col("errors") > 0) & (F.col("imported") == 0), F.lit("failed")).when(F.col("errors") > 0, F.lit("partial")).otherwise(F.lit("completed")))


def operational_signals(queue: str = "queue_position", kind: str = "source_kind") -> Column:
    """Signals that a list itself gives: a position within the first 100, none in a list that is in order of time, and what kind of list it is."""
    q, k = F.col(queue), F.col(kind)
    return F.array_compact(F.array(
        F.when(q <= 100, F.lit("queue_position_favorable")), F.when(q.isNull() & (k == "chronological_list"), F.lit("queue_position_unknown")), F.when(k == "direct_agreement", F.lit("direct_agreement_window")),
        F.when(k == "preferential_lot", F.lit("preferential_queue")), F.when(k == "paid_or_payment_process", F.lit("payment_process_detected")),
    ))


def endpoint(base: str, alias: Column | str) -> Column:
    """Address of a court's search."""
    return F.concat(F.lit(base.rstrip("/") + "/"), F.col(alias) if isinstance(alias, str) else alias, F.lit("/search"))
