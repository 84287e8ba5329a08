"""Number and boolean parsing that keeps unknown, zero and no apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.text import col

_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*\z"
_INFINITE = r"(?i)^\s*[+-]?inf(inity)?\s*\z"


def blank_to_null(c: Column | str) -> Column:
    """Only the empty string is unknown; zero stays zero."""
    return F.nullif(col(c), F.lit(""))


def checked_number(c: Column | str, integer: bool, zero_allowed: bool) -> Column:
    """``struct(valor double, estado)`` with six reasons."""
    text = col(c).cast("string")
    value = F.when(text.rlike(_NUMBER), F.expr("1")).isNotNull()
    number = F.when(value, F.trim(text)).try_cast("double")
    state = (
        F.when(text.isNull() | (F.trim(text) == ""), "faltante")
        .when(text.rlike(_INFINITE), "no_finito")
        .when(number.isNull(), "no_numerico")
        .when(number < 0, "negativo")
    )
    if not zero_allowed:
        state = state.when(number == 0, "cero_no_permitido")
    if integer:
        state = state.when(number % 1 != 0, "debe_ser_entero")
    state = state.otherwise("valido")
    return F.struct(F.when(state == "valido", number).alias("valor"), state.alias("estado"))


def strict_decimal(c: Column | str) -> Column:
    """``struct(valor decimal, violacion)``: empty is null, anything unparsable a violation."""
    text = blank_to_null(c).cast("string")
    value = F.when(text.rlike(_NUMBER), F.trim(text)).try_cast("decimal(38,6)")
    bad = text.isNotNull() & value.isNull()
    return F.struct(value.alias("valor"), F.when(bad, "numero_invalido").alias("violacion"))


def strict_integer(c: Column | str) -> Column:
    """``struct(valor bigint, violacion)``; fractions are never truncated."""
    number = strict_decimal(c)
    fraction = number["valor"] != F.floor(number["valor"])
    return F.struct(
        F.when(~fraction, number["valor"].try_cast("bigint")).alias("valor"),
        F.coalesce(
            number["violacion"], F.when(fraction, "entero_con_fraccion")
        ).alias("violacion"),
    )


def strict_boolean(c: Column | str) -> Column:
    """``struct(valor boolean, violacion)`` from SI/NO/True/False."""
    text = F.lower(blank_to_null(c).cast("string"))
    value = F.when(text.isin("true", "si"), True).when(text.isin("false", "no"), False)
    return F.struct(
        value.alias("valor"),
        F.when(text.isNotNull() & value.isNull(), "booleano_invalido").alias("violacion"),
    )


def state_flag(c: Column | str) -> Column:
    """Tri-state flag: si -> true, no_explicito -> false, no_mencionado -> unknown."""
    return F.when(col(c) == "si", True).when(col(c) == "no_explicito", False)
