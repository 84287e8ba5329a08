"""Money expressions in everyday wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.functions.text import ascii_fold, col, let

_AMOUNT = (
    rf"(?<![\w.,])(\$\s*)?({V.MONEY_NUMBER})\s*({V.MONEY_UNIT})?(?!\w)"
)
RESULT_FIELDS = ("valor", "minimo", "maximo", "aproximado", "moneda", "error")


def localized_number(number: Column, unit: Column) -> Column:
    """Thousands dots, decimal comma, unit word -> double; null when separators are ambiguous."""
    plain = (
        F.when(
            number.rlike(r"^\d{1,3}(?:\.\d{3})+(?:,\d{1,2})?\z"),
            F.replace(F.replace(number, F.lit("."), F.lit("")), F.lit(","), F.lit(".")),
        )
        .when(number.rlike(r"^\d+(?:,\d{1,2})?\z"), F.replace(number, F.lit(","), F.lit(".")))
        .when(number.rlike(r"^\d+\.\d{1,2}\z"), number)
    )
    factor = F.when(unit == "mil", 1000).when(F.coalesce(unit, F.lit("")) != "", 1000000).otherwise(1)
    return (plain.try_cast("decimal(30,2)") * factor.cast("decimal(7,0)")).cast("double")


def _amount(value: Column | None, low: Column | None, high: Column | None,
            approx: Column | None, currency: Column | None, error: Column | None) -> Column:
    def typed(x: Column | None, kind: str) -> Column:
        return (F.lit(None) if x is None else x).cast(kind)

    return F.struct(
        typed(value, "double").alias("valor"),
        typed(low, "double").alias("minimo"),
        typed(high, "double").alias("maximo"),
        typed(approx, "boolean").alias("aproximado"),
        typed(currency, "string").alias("moneda"),
        typed(error, "string").alias("error"),
    )


def money(c: Column | str) -> Column:
    """``struct(valor, minimo, maximo, aproximado, moneda, error)`` of one expression.

    One amount gives ``valor``; two with a range marker give ``minimo`` and ``maximo``; anything
    that would need a guess gives only ``error``. Evaluated on the folded text once per row.
    """
    source = col(c)
    return let(let(F.trim(ascii_fold(source)), _split), lambda p: _decide(source, p))


def _split(text: Column) -> Column:
    return F.struct(
        text.alias("t"),
        F.regexp_extract_all(text, F.lit(_AMOUNT), F.lit(2)).alias("n"),
        F.regexp_extract_all(text, F.lit(_AMOUNT), F.lit(3)).alias("u"),
        F.filter(
            F.array(*[F.when(text.rlike(p), F.lit(code)) for p, code in V.MONEY_CURRENCIES]),
            lambda x: x.isNotNull(),
        ).alias("m"),
    )


def _decide(source: Column, p: Column) -> Column:
    text, numbers, units, currencies = p["t"], p["n"], p["u"], p["m"]
    count = F.size(numbers)
    is_range = count == 2
    marked = (text.rlike(r"\bentre\b") & text.rlike(r"\by\b")) | text.rlike(r"\bde\b.+\ba\b")
    unit_a, unit_b = F.get(units, F.lit(0)), F.get(units, F.lit(1))
    shared = F.when(is_range & (unit_a == ""), unit_b).otherwise(unit_a)
    first = localized_number(F.get(numbers, F.lit(0)), shared)
    second = localized_number(F.get(numbers, F.lit(1)), unit_b)
    approx = text.rlike(V.MONEY_APPROXIMATE)
    currency = F.get(currencies, F.lit(0))

    def error(code: str) -> Column:
        return _amount(None, None, None, None, None, F.lit(V.MONEY_ERRORS[code]))

    return (
        F.when(source.isNull(), _amount(None, None, None, None, None, None))
        .when(
            text.rlike(f"^(?:{V.MONEY_NO_INITIAL})\\z"),
            _amount(F.lit(0.0), None, None, F.lit(False), None, None),
        )
        .when(text.rlike(r"-\s*\d"), error("negative"))
        .when(~count.between(1, 2), error("count"))
        .when(is_range & ~marked, error("marker"))
        .when(first.isNull() | (is_range & second.isNull()), error("separator"))
        .when(F.size(currencies) > 1, error("currency"))
        .when(is_range & (first > second), error("inverted"))
        .when(is_range, _amount(None, first, second, approx, currency, None))
        .otherwise(_amount(first, None, None, approx, currency, None))
    )


def listed_price(c: Column | str) -> Column:
    """The price of a message, if it names exactly one with a currency sign."""
    found = F.regexp_extract_all(col(c), F.lit(r"\$\s*(\d{1,3}(?:\.\d{3})+|\d+)"), F.lit(1))
    return F.when(
        F.size(found) == 1,
        F.replace(F.get(found, F.lit(0)), F.lit("."), F.lit("")).try_cast("decimal(38,0)"),
    )
