"""Dates with explicit precision: a day never becomes a midnight, an order is never guessed."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.functions.text import clean, col, let

_TIME = r"(?:[ T]\d{2}:\d{2}(?::\d{2})?)?\z"
_YEAR_FIRST = r"^\d{4}([-/])\d{1,2}\1\d{1,2}" + _TIME
_YEAR_LAST = r"^\d{1,2}([-/])\d{1,2}\1\d{4}" + _TIME
_YEAR_LAST_HEAD = r"^(\d{1,2})[-/](\d{1,2})[-/]\d{4}(?:\D|\z)"


def _leading_pair(c: Column | str, body) -> Column:
    """``body(a, b)`` over the first two numbers of a year-last date, null for other texts."""

    def cast(x: Column) -> Column:
        # the pattern only yields digits, so the cast cannot fail on the empty no-match
        a, b = (
            F.nullif(F.regexp_extract(x, _YEAR_LAST_HEAD, g), F.lit("")).cast("int")
            for g in (1, 2)
        )
        return F.struct(a.alias("a"), b.alias("b"))

    return let(let(F.trim(col(c).cast("string")), cast), lambda p: body(p["a"], p["b"]))


def _pad(c: Column, width: int) -> Column:
    return F.lpad(c.cast("string"), width, "0")


def _read(c: Column | str) -> Column:
    """The written parts of a date: text, form (iso, last or null) and its numbers."""

    def parts(text: Column) -> Column:
        form = F.when(text.rlike(_YEAR_FIRST), "iso").when(text.rlike(_YEAR_LAST), "last")
        return F.struct(
            text.alias("text"), form.alias("form"), F.split(text, "[-/ T:]").alias("x"))

    def numbers(p: Column) -> Column:
        values = F.when(
            p["form"].isNotNull(), F.transform(p["x"], lambda x: x.cast("int")))
        return F.struct(
            p["text"].alias("text"), p["form"].alias("form"), values.alias("n"),
            (F.size(p["x"]) > 3).alias("timed"))

    return let(let(clean(c), parts), numbers)


def _fields(p: Column, mdy: Column) -> tuple[Column, Column, Column]:
    """Year, month and day of the written parts under a day/month order."""
    iso = p["form"] == "iso"
    a, b, c = (F.get(p["n"], F.lit(i)) for i in range(3))
    return (
        F.when(iso, a).otherwise(c),
        F.when(iso | ~mdy, b).otherwise(a),
        F.when(iso, c).when(mdy, b).otherwise(a),
    )


def _clock(p: Column) -> list[Column]:
    return [F.coalesce(F.get(p["n"], F.lit(i)), F.lit(0)) for i in (3, 4, 5)]


def _value(p: Column, mdy: Column) -> Column:
    """The instant, or null when the parts are no real date."""
    year, month, day = _fields(p, mdy)
    hour, minute, second = _clock(p)
    plausible = (
        (year >= 1) & month.between(1, 12) & day.between(1, 31)
        & (hour <= 23) & (minute <= 59) & (second <= 59)
    )
    made = F.call_function(
        "try_make_timestamp_ntz", year, month, day, hour, minute, second.cast("decimal(16,6)"))
    return F.when(p["form"].isNotNull() & plausible, made)


def _told(p: Column, mdy: Column, value: Column, motive: Column | None = None) -> Column:
    """The full parse result, with the reason in words."""
    year, month, day = _fields(p, mdy)
    hour, minute, second = _clock(p)
    order = (
        F.when(p["form"] == "iso", V.DATE_ORDER_TEXT["ISO"])
        .when(mdy, V.DATE_ORDER_TEXT["MDY"])
        .otherwise(V.DATE_ORDER_TEXT["DMY"])
    )
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    longest = (
        F.when(month.isin(4, 6, 9, 11), 30).when((month == 2) & leap, 29)
        .when(month == 2, 28).otherwise(31)
    )
    reason = (
        F.when(value.isNotNull(), F.concat(
            F.lit("Interpretada como "), order, F.lit(": "),
            F.date_format(value, "yyyy-MM-dd"), F.lit("."),
            F.when(p["timed"], "").otherwise(V.DATE_NO_HOUR)))
        .when(p["text"].isNull(), V.DATE_MISSING)
        .when(p["form"].isNull(), V.DATE_BAD_FORMAT)
        .when(year < 1, F.concat(
            F.lit("Año "), year.cast("string"),
            F.lit(" fuera del intervalo admitido (1–9999).")))
        .when(~month.between(1, 12), F.concat(
            F.lit("Interpretación "), order, F.lit(": el mes sería "), month.cast("string"),
            F.lit(", fuera de 1–12. El orden se evalúa junto con las otras fechas del mismo "
                  "lead.")))
        .when(~day.between(1, longest), F.concat(
            F.lit("Interpretación "), order, F.lit(": día "), day.cast("string"),
            F.lit(" imposible; el mes "), _pad(month, 2), F.lit(" de "),
            year.cast("string"), F.lit(" tiene "), longest.cast("string"), F.lit(" días.")))
        .otherwise(F.concat(
            F.lit("Hora inválida "), _pad(hour, 2), F.lit(":"), _pad(minute, 2), F.lit(":"),
            _pad(second, 2), F.lit("; se requiere 00–23:00–59:00–59.")))
    )
    if motive is not None:
        reason = F.concat(reason, F.lit(" "), motive)
    return F.struct(
        value.alias("valor"),
        F.when(value.isNotNull(), "valida").when(p["text"].isNull(), "faltante")
        .otherwise("invalida").alias("estado"),
        F.when(p["form"].isNotNull(), F.when(p["timed"], "fecha_hora").otherwise("fecha"))
        .alias("precision"),
        reason.alias("criterio"),
    )


def parse_date(c: Column | str, order: Column | str = "DMY") -> Column:
    """Parse an ISO or year-last date.

    Returns ``struct(valor, estado, precision, criterio)``. ``order`` (DMY or MDY, literal or
    column) only matters for year-last dates.
    """
    mdy = F.lit(order == "MDY") if isinstance(order, str) else (order == "MDY")
    read = let(_read(c), lambda p: F.struct(p.alias("p"), _value(p, mdy).alias("v")))
    return let(read, lambda x: _told(x["p"], mdy, x["v"]))


def order_evidence(c: Column | str) -> Column:
    """MDY or DMY when a component above 12 rules the other order out."""
    return _leading_pair(c, lambda a, b: F.when(
        a.between(1, 12) & b.between(13, 31), "MDY"
    ).when(a.between(13, 31) & b.between(1, 12), "DMY"))


def _ambiguous(c: Column | str) -> Column:
    return _leading_pair(c, lambda a, b: F.coalesce(
        a.between(1, 12) & b.between(1, 12), F.lit(False)))


def sequence_possible(earlier: Column, later: Column) -> Column:
    """Whether ``earlier`` can precede ``later`` at the coarser precision; null if unknown."""
    by_day = (earlier["precision"] == "fecha") | (later["precision"] == "fecha")
    return F.when(
        by_day, earlier["valor"].cast("date") <= later["valor"].cast("date")
    ).otherwise(earlier["valor"] <= later["valor"])


def resolve_pair(registered: str, contacted: str) -> Column:
    """Settle the day/month order of two date columns of one record.

    Returns ``struct(regla, motivo, registro, contacto)``; the two dates are parse results whose
    ``criterio`` already carries the motive. Evidence wins, then a joint flip that restores the
    sequence, then a single consistent combination of the ambiguous fields.
    """
    no, yes = F.lit(False), F.lit(True)
    written = F.struct(
        _read(registered).alias("r"), _read(contacted).alias("c"),
        order_evidence(registered).alias("er"), order_evidence(contacted).alias("ec"),
        _ambiguous(registered).alias("ar"), _ambiguous(contacted).alias("ac"),
    )

    def valued(w: Column) -> Column:
        return F.struct(
            w.alias("w"),
            _value(w["r"], no).alias("rd"), _value(w["r"], yes).alias("rm"),
            _value(w["c"], no).alias("cd"), _value(w["c"], yes).alias("cm"),
            (~w["r"]["timed"] | ~w["c"]["timed"]).alias("by_day"),
        )

    def possible(s: Column, r: Column, c: Column) -> Column:
        return F.when(s["by_day"], r.cast("date") <= c.cast("date")).otherwise(r <= c)

    def option(s: Column, rule: str | Column, fr: Column, fc: Column) -> Column:
        rv, cv = F.when(fr, s["rm"]).otherwise(s["rd"]), F.when(fc, s["cm"]).otherwise(s["cd"])
        return F.struct(
            (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"),
            fr.alias("fr"), fc.alias("fc"), rv.alias("rv"), cv.alias("cv"),
            possible(s, rv, cv).alias("ok"),
        )

    def evidence(s: Column) -> Column:
        er, ec = s["w"]["er"], s["w"]["ec"]
        any_mdy = F.coalesce((er == "MDY"), no) | F.coalesce((ec == "MDY"), no)
        any_dmy = F.coalesce((er == "DMY"), no) | F.coalesce((ec == "DMY"), no)
        mixed = any_mdy & any_dmy
        rule = (
            F.when(mixed, "origen_mixto_resuelto_por_valores")
            .when(any_mdy, "MDY_por_evidencia_del_lead")
            .when(any_dmy, "DMY_por_evidencia_del_lead")
            .otherwise("DMY_por_defecto")
        )
        return F.struct(s.alias("s"), option(
            s, rule,
            F.when(mixed, er == "MDY").otherwise(any_mdy),
            F.when(mixed, ec == "MDY").otherwise(any_mdy)).alias("b"))

    def flip(x: Column) -> Column:
        s, b = x["s"], x["b"]
        worth = (
            s["w"]["er"].isNull() & s["w"]["ec"].isNull()
            & ~F.coalesce(b["ok"], yes) & possible(s, s["rm"], s["cm"])
        )
        turned = option(s, "MDY_por_coherencia_del_lead", yes, yes)
        return F.struct(s.alias("s"), F.when(worth, turned).otherwise(b).alias("b"))

    def combine(x: Column) -> Column:
        s, b = x["s"], x["b"]

        def choices(ambiguous: Column, now: Column) -> list[Column]:
            return [F.when(ambiguous, wanted).otherwise(now) for wanted in (no, yes)]

        pairs = F.array(*[
            option(s, "origen_mixto_por_coherencia_unica", fr, fc)
            for fr in choices(s["w"]["ar"], b["fr"]) for fc in choices(s["w"]["ac"], b["fc"])
        ])

        def settle(found: Column) -> Column:
            different = F.array_distinct(F.transform(found, lambda p: F.struct(p["rv"], p["cv"])))
            return F.when(F.size(different) == 1, F.get(found, F.size(found) - 1)).otherwise(b)

        repaired = let(F.filter(pairs, lambda p: p["ok"]), settle)
        return F.struct(
            s.alias("s"), F.when(~F.coalesce(b["ok"], yes), repaired).otherwise(b).alias("b"))

    def explain(x: Column) -> Column:
        s, b = x["s"], x["b"]
        motive = F.coalesce(
            F.element_at(
                F.create_map(*[F.lit(t) for kv in V.DATE_RULE_TEXT.items() for t in kv]),
                F.when(b["rule"].startswith("DMY"), "DMY").otherwise(b["rule"])),
            F.lit(""))
        return F.struct(
            b["rule"].alias("regla"), motive.alias("motivo"),
            _told(s["w"]["r"], b["fr"], b["rv"], motive).alias("registro"),
            _told(s["w"]["c"], b["fc"], b["cv"], motive).alias("contacto"),
        )

    return let(let(let(let(let(written, valued), evidence), flip), combine), explain)


def sequence_state(registered: Column, contacted: Column) -> Column:
    """``struct(estado, comentario)`` of registration versus first contact."""
    possible = sequence_possible(registered, contacted)
    broken = F.concat(
        F.lit("El contacto ("), contacted["valor"].cast("string"),
        F.lit(") sigue siendo anterior al registro ("), registered["valor"].cast("string"),
        F.lit(") tras aplicar la regla por lead. Las fechas son válidas, pero su relación requiere "
              "revisión; no se inventa una fecha."),
    )
    return F.struct(
        F.when(possible.isNull(), "no_evaluable")
        .when(possible, "coherente")
        .otherwise("contacto_anterior_registro")
        .alias("estado"),
        F.when(possible.isNull(), V.SEQUENCE_MISSING)
        .when(possible, V.SEQUENCE_OK)
        .otherwise(broken)
        .alias("comentario"),
    )


def date_text(value: Column, precision: Column | str | None = None) -> Column:
    """ISO text that shows an hour only when the source gave one."""
    full = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    if precision is None:
        return full
    return F.when(col(precision) == "fecha", F.date_format(value, "yyyy-MM-dd")).otherwise(full)


def date_parts(c: Column | str, precision: Column | str | None = None) -> Column:
    """``struct(fecha date, hora HH:mm:ss text, precision, violacion)`` of an ISO text.

    A text with a zone, or one that is no ISO date, is a violation; a midnight is only kept when
    the precision does not say day.
    """
    text = F.nullif(col(c).cast("string"), F.lit(""))
    day_only = text.rlike(r"^\d{4}-\d{2}-\d{2}\z")
    full = text.rlike(r"^\d{4}-\d{2}-\d{2}.\d{2}:\d{2}(:\d{2}([.,]\d+)?)?\z")
    padded = F.when(
        full,
        F.concat(
            F.substring(text, 1, 10), F.lit(" "), F.substring(text, 12, 5),
            F.when(F.length(text) > 16, F.substring(text, 17, 3)).otherwise(":00"),
        ),
    ).when(day_only, F.concat(text, F.lit(" 00:00:00")))
    value = F.try_to_timestamp(padded, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    bad = text.isNotNull() & value.isNull()
    suppressed = F.lit(False) if precision is None else F.coalesce(
        col(precision) == "fecha", F.lit(False))
    with_hour = full & ~suppressed
    hour = F.when(with_hour, F.date_format(value, "HH:mm:ss"))
    return F.struct(
        value.cast("date").alias("fecha"),
        hour.alias("hora"),
        F.when(value.isNotNull(), F.when(hour.isNotNull(), "fecha_hora").otherwise("fecha"))
        .alias("precision"),
        F.when(bad, "fecha_incompatible").alias("violacion"),
    )
