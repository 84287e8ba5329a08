"""Text keys and categories as JVM-side expressions."""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom import fixed_values as V

# Python's str.isspace also counts the four separators 0x1c-0x1f.
_NOT_ASCII = r"[^\x00-\x7F]"
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once and named, so big expressions stay small."""
    return F.transform(F.array(value), body)[0]


def literal_map(table: dict[str, str]) -> Column:
    """A constant text map; parsed once by constant folding."""
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def clean(c: Column | str) -> Column:
    """One blank between words, none around, empty becomes null."""
    return F.nullif(F.trim(F.regexp_replace(col(c).cast("string"), WHITESPACE, " ")), F.lit(""))


def _fold_char(ch: str) -> str:
    return "".join(
        x for x in unicodedata.normalize("NFD", ch.casefold()) if unicodedata.category(x) != "Mn"
    )


def _ascii_char(ch: str) -> str:
    kept = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
    return kept.lower()


@lru_cache(maxsize=None)
def _char_tables(kind: str) -> tuple[str, str, dict[str, str]]:
    """(from, to, many) tables derived from the Unicode database.

    ``from``/``to`` feed ``translate`` (one character or a deletion), ``many`` holds the few
    characters that expand to several. Hangul syllables stay composed: as keys they compare alike.
    """
    rule = _fold_char if kind == "fold" else _ascii_char
    plain, deleted, many = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3:
            continue
        ch = chr(code)
        if unicodedata.category(ch) == "Cn":
            continue
        out = rule(ch)
        if out == ch:
            continue
        if len(out) == 1:
            plain.append((ch, out))
        elif not out:
            if kind == "fold":
                deleted.append(ch)
        else:
            many[ch] = out
    source = "".join(a for a, _ in plain) + "".join(deleted)
    return source, "".join(b for _, b in plain), many


def _fold(c: Column, kind: str) -> Column:
    """Per-character mapping; plain ASCII rows and rows without rare characters stay cheap."""
    source, target, many = _char_tables(kind)
    table = literal_map(many)

    def expand(s: Column) -> Column:
        rare = F.array_distinct(F.regexp_extract_all(s, F.lit(_NOT_ASCII), F.lit(0)))
        return F.aggregate(
            rare, s,
            lambda acc, ch: F.replace(acc, ch, F.coalesce(F.try_element_at(table, ch), ch)),
        )

    def common(s: Column) -> Column:
        return F.when(s.rlike(_NOT_ASCII), expand(s)).otherwise(s)

    def start(b: Column) -> Column:
        return F.when(b.rlike(_NOT_ASCII), let(F.translate(b, source, target), common)).otherwise(b)

    return let(F.lower(c), start)


def fold_key(c: Column | str) -> Column:
    """Comparison key: clean, case-folded, without accents."""
    return _fold(clean(c), "fold")


def ascii_fold(c: Column | str) -> Column:
    """Compatibility-decomposed ASCII lower case; everything else is dropped."""
    return F.lower(F.regexp_replace(_fold(col(c), "ascii"), _NOT_ASCII, ""))


def alnum_key(c: Column | str) -> Column:
    """Key of a product mention: letters and digits only."""
    return F.regexp_replace(ascii_fold(c), "[^a-z0-9]", "")


def model_key(c: Column | str) -> Column:
    """Comparison key with brand spellings repaired and a trailing year dropped."""
    key = F.regexp_replace(fold_key(c), r"^a\.k\.t\b", "akt")
    for wrong, right in V.BRAND_TYPOS.items():
        key = F.regexp_replace(key, rf"^{wrong}\b", right)
    return F.trim(F.regexp_replace(key, r"\s+20\d{2}$", ""))


def normalize_text_columns(df: DataFrame, skip: tuple[str, ...] = ("source_row",)) -> DataFrame:
    """Add ``<c>_normalizado`` for every text column; ids upper, e-mail lower."""
    added = {}
    for field in df.schema.fields:
        if field.name in skip or not isinstance(field.dataType, T.StringType):
            continue
        value = clean(field.name)
        if field.name.endswith("_id") or field.name == "sku":
            value = F.upper(value)
        elif field.name == "email":
            value = F.lower(value)
        added[field.name + "_normalizado"] = value
    return df.withColumns(added)


def phone(c: Column | str) -> Column:
    """Colombian mobile as ``struct(valor, estado)``; only E.164 or a reason."""
    def judge(p: Column) -> Column:
        state = (
            F.when(p["t"].isNull(), "faltante")
            .when(~p["t"].rlike(r"^\+?[0-9\s().-]+\z"), "caracteres_no_permitidos")
            .when(F.length(p["n"]) != 10, "longitud_invalida")
            .when(~p["n"].startswith("3"), "revisar_prefijo_movil")
            .otherwise("valido")
        )
        return F.struct(
            F.when(state == "valido", F.concat(F.lit("+57"), p["n"])).alias("valor"),
            state.alias("estado"),
        )

    text = clean(c)
    digits = F.regexp_replace(text, r"\D", "")
    local = F.when(
        (F.length(digits) == 12) & digits.startswith("57"), F.substring(digits, 3, 10)
    ).otherwise(digits)
    return let(F.struct(text.alias("t"), local.alias("n")), judge)


def _key(text: str) -> str:
    return "".join(_fold_char(ch) for ch in " ".join(text.split()))


CATEGORIES: dict[str, dict[str, str]] = {
    "canal": {_key(v): v for v in V.CHANNELS},
    "estado_gestion": {_key(v): v for v in V.MANAGEMENT_STATES},
    "activo": V.YES_NO,
    "manifesto_cuota_inicial": V.YES_NO_UNSTATED,
    "pidio_cita": V.YES_NO,
    "forma_pago_declarada": {v: v for v in V.PAYMENT_FORMS},
    "desenlace": {_key(v): v for v in V.OUTCOMES},
    "ciudad": {**{_key(v): v for v in V.CITIES}, **V.CITY_SYNONYMS},
}


def category(c: Column | str, domain: str) -> Column:
    """Dictionary lookup as ``struct(valor, estado)``."""
    key = fold_key(c)
    table = F.create_map(*[F.lit(x) for pair in CATEGORIES[domain].items() for x in pair])
    value = F.try_element_at(table, key)
    state = (
        F.when(key.isNull(), "faltante").when(value.isNull(), "no_reconocido").otherwise("valido")
    )
    return F.struct(value.alias("valor"), state.alias("estado"))


def email(c: Column | str) -> Column:
    """Structurally plausible address in lower case, else null."""
    text = clean(c)
    return F.when(
        text.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+\z"), F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    )


def html_unescape(c: Column) -> Column:
    """Decode HTML entities found in ``c`` (named, numeric, legacy without semicolon)."""
    from html.entities import html5

    named = {"&" + k: v for k, v in html5.items()}
    legacy = sorted((k for k in html5 if not k.endswith(";")), key=len, reverse=True)
    pattern = "&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[A-Za-z0-9]+;|&(?:" + "|".join(legacy) + ")"
    table = literal_map(named)

    def decode(entity: Column) -> Column:
        hexa = F.regexp_extract(entity, "^&#[xX]([0-9a-fA-F]+)", 1)
        deci = F.regexp_extract(entity, "^&#([0-9]+)", 1)
        code = F.when(hexa != "", F.conv(hexa, 16, 16)).when(deci != "", F.conv(deci, 10, 16))
        numeric = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
        return F.coalesce(numeric, F.try_element_at(table, entity), entity)

    found = F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))
    return F.when(
        c.contains("&"), F.aggregate(found, c, lambda acc, e: F.replace(acc, e, decode(e)))
    ).otherwise(c)
