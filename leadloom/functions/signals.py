"""Priority policy over explicit signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.functions.text import col


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def model_identified(sku: Column | str) -> Column:
    return ~F.trim(F.coalesce(col(sku), F.lit(""))).isin(V.UNIDENTIFIED_MODELS)


def payment_declared(payment: Column | str) -> Column:
    return _true(col(payment).isin(V.PAYMENT_SIGNALS))


def _flags(sku, initial, payment, appointment) -> dict[str, Column]:
    return {
        "modelo": model_identified(sku),
        "inicial": _true(col(initial)),
        "pago": payment_declared(payment),
        "cita": _true(col(appointment)),
    }


def points(sku, initial, payment, appointment) -> Column:
    """Points out of 90; absent signals add nothing."""
    flags = _flags(sku, initial, payment, appointment)
    parts = [F.when(flag, V.SIGNAL_POINTS[k]).otherwise(0) for k, flag in flags.items()]
    return parts[0] + parts[1] + parts[2] + parts[3]


def score(total_points: Column) -> Column:
    """Half-up percentage of the maximum with two decimals."""
    hundred = (total_points * 100).cast("decimal(18,6)")
    return F.round(hundred / F.lit(V.MAX_POINTS).cast("decimal(4,0)"), 2).cast("decimal(18,2)")


def temperature(initial, payment, appointment) -> Column:
    return (
        F.when(_true(col(appointment)), "caliente")
        .when(_true(col(initial)) | payment_declared(payment), "tibio")
        .otherwise("sin_informacion_suficiente")
    )


def queue(temp: Column | str, all_discarded: Column | str, context_state: Column | str) -> Column:
    return (
        F.when(_true(col(all_discarded)), "revision_descartado_crm")
        .when(col(context_state) == "revision_orden", "revision_datos")
        .when(col(temp) == "sin_informacion_suficiente", "primer_contacto_o_ampliar_informacion")
        .otherwise("seguimiento_comercial")
    )


def action(queue_name: Column | str, temp: Column | str) -> Column:
    q = col(queue_name)
    chain = F.when(
        (q == "seguimiento_comercial") & (col(temp) == "caliente"), V.APPOINTMENT_ACTION
    )
    for name, text in V.QUEUE_ACTION.items():
        chain = chain.when(q == name, text)
    return chain


def explanation(sku, initial, payment, appointment, style: str = "batch") -> Column:
    """Sentences of the contributing signals; ``batch`` adds the scale, ``intake`` joins by ';'."""
    flags = _flags(sku, initial, payment, appointment)
    sentences = [F.when(flag, V.SIGNAL_TEXT[k]) for k, flag in flags.items()]
    if style == "batch":
        return F.concat(F.concat_ws(" ", *sentences), F.lit(V.SCALE_TEXT))
    joined = F.concat_ws("; ", *sentences)
    return F.when(joined == "", V.NO_SIGNAL_TEXT).otherwise(joined)


def initial_signal(value: Column, low: Column, evidence_count: Column) -> Column:
    """SI, NO or NO_INFORMA: an explicit zero is a no, silence is neither."""
    return (
        F.when(F.coalesce(evidence_count, F.lit(0)) == 0, "NO_INFORMA")
        .when(value > 0, "SI")
        .when(value == 0, "NO")
        .when(value.isNull() & (low > 0), "SI")
        .otherwise("NO_INFORMA")
    )
