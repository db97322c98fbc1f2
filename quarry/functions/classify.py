"""Debtor types, payment regimes, natures and preferences by the rules of each source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import code_key, col, has_any, search_text

# Per source, words of a debtor's name (as a code key), with type and regime; the first that holds, else the last row. None: the source's own regime.
DEBTORS = {
    "open_data": ((("FUNDACAO",), "foundation", None), (("INSTITUTO", "AUTARQUIA"), "autarchy", None), ((), "union", None)),
    "generic": (
        (("UNIAO",), "union", "federal_unique"), (("INSS",), "autarchy", "federal_unique"), (("IPREV",), "autarchy", "special"), (("MUNICIP", "PREFEITURA", "CAMARA"), "municipality", "special"),
        (("FUNDACAO",), "foundation", "special"), (("ESTADO",), "state", "special"), ((), "autarchy", "special"),
    ),
    "trf1": ((("MUNICIPIO", "PREFEITURA"), "municipality", "other"), (("ESTADO", "FAZENDA"), "state", "other"), (("UNIAO",), "union", "federal_unique"), ((), "autarchy", "federal_unique")),
    "trf5": ((("UNIAO",), "union", "federal_unique"), (("MUNICIPIO",), "municipality", "other"), (("ESTADO",), "state", "other"), ((), "autarchy", "federal_unique")),
    "tjba": (
        (("INSS",), "autarchy", "federal_unique"), (("MUNICIP", "PREFEITURA", "CAMARA"), "municipality", "special"), (("FUNDACAO",), "foundation", "special"),
        (("INSTITUTO", "DEPARTAMENTO", "AUTARQUIA", "EMBASA"), "autarchy", "special"), ((), "state", "special"),
    ),
    "tjes": (
        (("INSS",), "autarchy", "federal_unique"), (("MUNICIP", "PREFEITURA", "CAMARA"), "municipality", None), (("FUNDACAO",), "foundation", None),
        (("INSTITUTO", "DEPARTAMENTO", "AUTARQUIA", "COMPANHIA"), "autarchy", None), ((), "state", None),
    ),
    "tjsp": ((("INSS",), "autarchy", "federal_unique"), (("MUNICIP", "PREFEITURA"), "municipality", "special"), (("FUNDACAO",), "foundation", "special"), (("INSTITUTO", "AUTARQUIA"), "autarchy", "special"), ((), "state", "special")),
}
# Per source, words of a folded text and the nature they name; the first that holds, else the last row.
NATURES = {
    "open_data": ((("ALIMENT",), "alimentar"), (("TRIBUT",), "tributario"), (("COMUM",), "comum"), ((), "unknown")),
    "generic": ((("ALIMENTAR",), "alimentar"), (("TRIBUT",), "tributario"), (("COMUM",), "comum"), ((), "unknown")),
    "trf1": ((("ALIMENT",), "alimentar"), (("COMUM",), "comum"), ((), "unknown")),
    "trf4": ((("ALIMENT",), "alimentar"), ((), "comum")),
    "trf5": ((("NAO ALIMENTAR",), "comum"), (("ALIMENTAR",), "alimentar"), ((), "comum")),
    "trf6": ((("NAO ALIMENTARES", "INCISO V"), "comum"), ((), "alimentar")),
    "tjsp": ((("ALIMENT",), "alimentar"), (("TRIBUT",), "tributario"), (("COMUM",), "comum"), ((), "unknown")),
}
# Words of super-preference (as a code key), and preferences by legal item, the first that holds.
SUPERPREFERENCE = ("IDADE", "IDOS", "DOENCA_GRAVE", "PREFERENCIAL", "SUPERPREFER")
ITEMS = (("INCISO II", "superpreferential"), ("INCISO III", "alimentar_preferential"), ("INCISO IV", "alimentar_balance"), ("INCISO V", "common"))


def _first(text: Column, rules, value: int) -> Column:
    out = F.lit(rules[-1][value])
    for rule in reversed(rules[:-1]):
        out = F.when(has_any(text, *rule[0]), F.lit(rule[value])).otherwise(out)
    return out


def debtor_profile(source: str, name: Column | str, regime: Column | None = None) -> Column:
    """Struct of debtor_type and payment_regime; regime is the source's own, for the sources that tell it."""
    key, rules = F.coalesce(code_key(name), F.lit("")), DEBTORS[source]
    own = _first(key, rules, 2)
    return F.struct(_first(key, rules, 1).alias("debtor_type"), (F.coalesce(own, regime) if regime is not None else own).cast("string").alias("payment_regime"))


def map_profile(sphere: Column | str, entity: Column | str, special: Column, name: Column | str) -> Column:
    """Debtor type and regime of a row of an annual map, by its sphere (F, E, M) and entity (D direct, I indirect)."""
    direct = col(entity) == "D"
    indirect = F.when(F.contains(F.upper(col(name)), F.lit("FUNDA")), F.lit("foundation")).otherwise(F.lit("autarchy"))
    kind = F.when((col(sphere) == "F") & direct, F.lit("union")).when(col(sphere) == "F", F.lit("autarchy")).when((col(sphere) == "E") & direct, F.lit("state")).when((col(sphere) == "M") & direct, F.lit("municipality")).otherwise(indirect)
    return F.struct(kind.alias("debtor_type"), F.when(col(sphere) == "F", F.lit("federal_unique")).when(special, F.lit("special")).otherwise(F.lit("other")).alias("payment_regime"))


def nature_by(source: str, text: Column | str) -> Column:
    return _first(F.upper(search_text(F.coalesce(col(text), F.lit("")))), NATURES[source], 1)


def is_superpreference(text: Column | str) -> Column:
    return has_any(F.coalesce(code_key(text), F.lit("")), *SUPERPREFERENCE)


def item_preference(text: Column | str) -> Column:
    t, out = F.upper(search_text(text)), F.lit(None).cast("string")
    for words, value in reversed(ITEMS):
        out = F.when(F.contains(t, F.lit(words)), F.lit(value)).otherwise(out)
    return out
