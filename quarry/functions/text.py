"""Text functions, Column to Column: names, process numbers, money, identifiers, fingerprints."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTED = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFD", c)) > 1}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(x: Column | str) -> Column:
    """Without diacritics; case stays."""
    return F.translate(F.regexp_replace(col(x), "[̀-ͯ]", ""), "".join(_ACCENTED), "".join(_ACCENTED.values()))


def blank_to_null(x: Column | str) -> Column:
    return F.nullif(F.trim(col(x)), F.lit(""))


def collapse(x: Column | str) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(col(x), r"\s+", " "))


def digits(x: Column | str) -> Column:
    return F.regexp_replace(col(x), r"[^0-9]", "")


def digits_or_null(x: Column | str) -> Column:
    return F.nullif(digits(x), F.lit(""))


def debtor_name(x: Column | str) -> Column:
    """Folded upper-case words of letters and digits; null if none is left."""
    return blank_to_null(F.upper(F.regexp_replace(fold(x), r"[^\p{L}\p{N}]+", " ")))


def header_key(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(fold(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def code_key(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(fold(x)), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def search_text(x: Column | str) -> Column:
    return F.lower(fold(x))


def check_digits(sequence: Column, year: Column, segment: Column, court: Column, origin: Column) -> Column:
    """98 minus the number with 00 appended, modulo 97, as two digits."""
    number = F.concat(sequence, year, segment, court, origin, F.lit("00")).try_cast("decimal(20,0)")
    return F.lpad((F.lit(98) - F.pmod(number, F.lit(97))).cast("int").cast("string"), 2, "0")


def once(x: Column, f) -> Column:
    """f(x) with x evaluated one time, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def process_number(x: Column | str) -> Column:
    """NNNNNNN-DD.AAAA.J.TR.OOOO if x has 20 digits with valid check digits, else null."""
    return once(digits(x), _formatted)


def _formatted(d: Column) -> Column:
    part = lambda at, n: F.substring(d, at, n)
    good = (F.length(d) == 20) & (part(8, 2) == check_digits(part(1, 7), part(10, 4), part(14, 1), part(15, 2), part(17, 4)))
    return F.when(good, F.concat(part(1, 7), F.lit("-"), part(8, 2), F.lit("."), part(10, 4), F.lit("."), part(14, 1), F.lit("."), part(15, 2), F.lit("."), part(17, 4)))


def padded_process_number(x: Column | str) -> Column:
    """As process_number, with zeros put before what has fewer than 20 digits."""
    d = digits(x)
    return F.when(F.length(d).between(1, 20), process_number(F.lpad(d, 20, "0")))


def joined_process_number(x: Column | str) -> Column:
    """As process_number; also with segment and court joined and a digit behind: NNNNNNN-DD.AAAA.JTR.OOOO-d."""
    return F.coalesce(process_number(x), process_number(F.when(col(x).rlike(r"^\d{7}-\d{2}\.\d{4}\.\d{3}\.\d{4}-\d$"), F.regexp_replace(col(x), r"-\d$", ""))))


def short_process_number(x: Column | str) -> Column:
    """Sequences of six digits before the check digits get a zero in front."""
    return F.coalesce(process_number(x), process_number(F.regexp_replace(F.trim(col(x)), r"^(\d{6})-", "0$1-")))


def process_number_without_origin(x: Column | str) -> Column:
    return F.coalesce(process_number(x), process_number(F.concat(col(x), F.lit(".0000"))))


# State of each two-digit court number of the state courts (segment 8) and electoral courts (segment 6).
STATES = ("ac", "al", "ap", "am", "ba", "ce", "df", "es", "go", "ma", "mt", "ms", "mg", "pa", "pb", "pr", "pe", "pi", "rj", "rn", "rs", "ro", "rr", "sc", "se", "sp", "to")


def court_of_process(x: Column | str) -> Column:
    """Alias of the court that a process number names, or null."""
    return once(digits(process_number(x)), _court)


def _court(d: Column) -> Column:
    segment, court = F.substring(d, 14, 1), F.substring(d, 15, 2).cast("int")
    state = F.get(F.array(*map(F.lit, STATES)), court - 1)
    state = F.when(court.between(1, len(STATES)), state)
    # the Federal District's state court has an alias of its own
    state_court = F.when(state == "df", F.lit("tjdft")).otherwise(F.concat(F.lit("tj"), state))
    military = F.when(state.isin("mg", "rs", "sp"), F.concat(F.lit("tjm"), state))
    return (
        F.when(segment == "3", F.lit("stj"))
        .when((segment == "4") & court.between(1, 6), F.concat(F.lit("trf"), court.cast("string")))
        .when((segment == "5") & court.between(1, 24), F.concat(F.lit("trt"), court.cast("string")))
        .when(segment == "6", F.concat(F.lit("tre-"), state))
        .when(segment == "7", F.lit("stm"))
        .when(segment == "8", state_court)
        .when(segment == "9", military)
    )


def court_of_state(x: Column | str) -> Column:
    """Alias of a state's court, from its two letters; the Federal District's has an alias of its own."""
    state = F.lower(F.trim(col(x)))
    return F.when(state == "df", F.lit("tjdft")).when(state.isin(*STATES), F.concat(F.lit("tj"), state))


def first_alias(*columns: Column | str) -> Column:
    """The first alias that is not blank, in lower case."""
    return F.coalesce(*(F.lower(blank_to_null(c)) for c in columns))


def court_from_name(x: Column | str) -> Column:
    """trfN from names like 'TRF 3' or 'Federal Regional Court of the 3rd region' in Portuguese."""
    t = search_text(x)
    return F.nullif(F.concat(F.lit("trf"), F.coalesce(F.nullif(F.regexp_extract(t, r"\btrf\s*-?\s*([1-6])\b", 1), F.lit("")), F.regexp_extract(t, r"federal.{0,40}?\b([1-6])\s*(?:a|ª|o|º)?\s*regiao", 1))), F.lit("trf"))


_NUMBER = r"^(-?)\s*(?:R\$)?\s*(-?)\s*(\d{1,3}(?:\.\d{3})+|\d+)(?:,(\d+))?$"


def brazilian_decimal(x: Column | str, kind: str = "decimal(38,16)") -> Column:
    """1.234,56 with an optional R$ and sign; thousands by dots, decimals by a comma; anything else is null."""
    return once(F.trim(col(x)), lambda t: _decimal(t, kind))


def _decimal(t: Column, kind: str) -> Column:
    get = lambda k: F.regexp_extract(t, _NUMBER, k)
    plain = F.concat(get(1), get(2), F.replace(get(3), F.lit(".")), F.lit("."), F.concat(get(4), F.lit("0")))
    return F.when(t.rlike(_NUMBER), plain.try_cast(kind))


def brazilian_money(x: Column | str) -> Column:
    """As brazilian_decimal, cut (not rounded) to two decimals."""
    return once(F.trim(col(x)), _money)


def _money(t: Column) -> Column:
    get = lambda k: F.regexp_extract(t, _NUMBER, k)
    cents = F.rpad(F.substring(get(4), 1, 2), 2, "0")
    return F.when(t.rlike(_NUMBER), F.concat(get(1), get(2), F.replace(get(3), F.lit(".")), F.lit("."), cents).try_cast("decimal(18,2)"))


def money_cell(x: Column | str) -> Column:
    """A table cell: '-' and blanks are null."""
    return brazilian_money(F.nullif(F.trim(col(x)), F.lit("-")))


def percent_cell(x: Column | str) -> Column:
    """A percentage as a share with four decimals."""
    return (brazilian_decimal(F.trim(F.replace(F.nullif(F.trim(col(x)), F.lit("-")), F.lit("%")))) / 100).cast("decimal(10,4)")


def find_process_number(x: Column | str) -> Column:
    """The first valid process number in a text."""
    hits = F.regexp_extract_all(col(x), F.lit(r"\d{7}-?\d{2}\.?\d{4}\.?\d\.?\d{2}\.?\d{4}"), F.lit(0))
    return F.get(F.filter(F.transform(hits, process_number), lambda h: h.isNotNull()), F.lit(0))


def find_money(x: Column | str) -> Column:
    """The first amount with two decimals in a text."""
    hits = F.regexp_extract_all(col(x), F.lit(r"-?(?:\d{1,3}(?:\.\d{3})+|\d+),\d{2}(?!\d)"), F.lit(0))
    return F.get(F.filter(F.transform(hits, brazilian_money), lambda h: h.isNotNull()), F.lit(0))


def find_year(text: Column | str, named: Sequence[Column] = ()) -> Column:
    """A year from columns named for it, else after a label in the text, else the first 20xx."""
    year = lambda c, pattern, k: F.nullif(F.regexp_extract(c, pattern, k), F.lit("")).cast("int")
    t = search_text(text)
    return F.coalesce(*(year(c, r"\b(20\d{2})\b", 1) for c in named), year(t, r"(?:ano|exercicio|proposta|orcamento|budget|year)\D{0,20}(20\d{2})", 1), year(t, r"\b(20\d{2})\b", 1))


# Named character references that are decoded.
_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'"}


def decode_entities(x: Column | str) -> Column:
    out = col(x)
    for entity, char in _ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def strip_tags(x: Column | str, by: str = " ") -> Column:
    """Text of a piece of HTML: tags replaced, references decoded, white space collapsed."""
    return collapse(decode_entities(F.regexp_replace(F.regexp_replace(col(x), r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", by)))


def slug(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(fold(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def safe_extension(filename: Column | str) -> Column:
    return F.nullif(F.lower(F.regexp_extract(col(filename), r"(\.[A-Za-z0-9]{1,10})$", 1)), F.lit(""))


def fingerprint(**fields: Column) -> Column:
    """SHA-256 of a JSON object with its keys in order; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))), 256)


def keyed_hash(x: Column | str, pepper: str) -> Column:
    """HMAC-SHA256 of the UTF-8 text, from its definition: the key is padded to 64 bytes."""
    import hashlib

    key = pepper.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(col(x), "UTF-8")), 256))), 256)


def csv_cell(x: Column | str) -> Column:
    """Quoted, with doubled quotes; null is empty."""
    text = col(x).cast("string")
    return F.when(text.isNull(), F.lit("")).otherwise(F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')))


def format_brl(x: Column | str) -> Column:
    return F.concat(F.lit("R$ "), F.translate(F.format_number(col(x).cast("decimal(18,2)"), 2), ",.", ".,"))


def format_percent(x: Column | str) -> Column:
    return F.concat(F.translate(F.format_number((col(x) * 100).cast("decimal(18,2)"), 2), ",.", ".,"), F.lit("%"))


def money_string(x: Column | str) -> Column:
    """Decimal as text with two cut decimals; null is 0.00."""
    value = F.coalesce(col(x).cast("decimal(38,6)"), F.lit(0).cast("decimal(38,6)"))
    return F.regexp_replace(value.cast("string"), r"^(-?\d+\.\d{2})\d*$", "$1")


# Identifier types that are compared by their digits.
NUMERIC_IDENTIFIERS = ("cnj_number", "process_number", "originating_process", "requisition_number", "asset_number")


def identifier(kind: Column | str, value: Column | str) -> Column:
    words = collapse(F.upper(fold(value)))
    return F.nullif(F.when(col(kind).isin(*NUMERIC_IDENTIFIERS), digits(value)).otherwise(words), F.lit(""))


def first_filled(*columns: Column | str) -> Column:
    """The first column that is not blank."""
    return F.coalesce(*(blank_to_null(c) for c in columns))


def whole_number(x: Column | str) -> Column:
    return F.regexp_extract(F.trim(col(x)), r"^(-?\d+)$", 1).try_cast("long")


def yes_no(x: Column | str) -> Column:
    t = search_text(F.trim(col(x)))
    return F.when(t.isin("sim", "s", "true", "1", "yes"), F.lit(True)).when(t.isin("nao", "n", "false", "0", "no"), F.lit(False)).when(F.contains(t, F.lit("fundef")), F.lit(True))


def has_any(text: Column, *words: str) -> Column:
    """A folded upper-case text contains one of the words."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return F.coalesce(found, F.lit(False))


def first_match(text: Column | str, rules: Sequence[tuple[str, Sequence[str]]], default: str | None = None) -> Column:
    """Value of the first rule of which the folded upper-case text contains a word."""
    t, out = F.upper(fold(text)), F.lit(None).cast("string")
    for value, words in reversed([*rules, (default, ())]):
        out = F.lit(value) if not words else F.when(has_any(t, *words), F.lit(value)).otherwise(out)
    return out


# Words that classify debtors and natures, first match wins.
DEBTOR_TYPES = (
    ("union", ("UNIAO", "FAZENDA NACIONAL", "MINISTERIO")),
    ("autarchy", ("INSS", "INSTITUTO NACIONAL", "AUTARQUIA", "INCRA", "DNIT", "IBAMA")),
    ("foundation", ("FUNDACAO", "UNIVERSIDADE", "FUNASA")),
    ("municipality", ("MUNICIPIO", "PREFEITURA", "CAMARA MUNICIPAL")),
    ("state", ("ESTADO", "GOVERNO", "SECRETARIA DE ESTADO", "DISTRITO FEDERAL")),
)
NATURES = (("alimentar", ("ALIMENTAR", "ALIMENTICI", "SALARIO", "PREVIDENCI", "BENEFICIO")), ("tributario", ("TRIBUTARI",)), ("comum", ("COMUM", "DESAPROPRIA", "INDENIZA")))
PREFERENCES = (("superpreference", ("SUPERPREFEREN", "SUPER PREFEREN")), ("elderly", ("IDOSO", "60 ANOS", "INCISO I")), ("illness", ("DOENCA GRAVE", "MOLESTIA")), ("disability", ("DEFICIEN",)))


def debtor_type(x: Column | str) -> Column:
    return first_match(x, DEBTOR_TYPES, "private_entity")


def nature(x: Column | str) -> Column:
    return first_match(x, NATURES, "unknown")


def preference(x: Column | str) -> Column:
    return first_match(x, PREFERENCES)


def shares_long_word(cause: Column | str, subject: Column | str, least: int = 5) -> Column:
    """Some word of the cause with at least that many letters occurs in the subject."""
    words = F.filter(F.split(search_text(cause), "[^a-z0-9]+"), lambda w: F.length(w) >= least)
    return F.coalesce(F.exists(words, lambda w: F.contains(search_text(subject), w)), F.lit(False))
