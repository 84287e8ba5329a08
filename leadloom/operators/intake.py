"""Intake and activity rules, defaults, references and transcripts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.functions.text import clean, email, phone


def first_informed(*columns: str) -> Column:
    """First non-empty of several fields."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def keep_suffixes(m: Column, suffixes: Sequence[str] = ("_estado", "_criterio", "_comentario")
                  ) -> Column:
    """Entries of a map whose key ends in one of the quality suffixes."""
    return F.map_filter(m, lambda k, v: k.rlike("(" + "|".join(suffixes) + r")\z"))


def default_categories(df: DataFrame, columns: Sequence[str], default: str = "DESCONOCIDO"
                       ) -> DataFrame:
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit(default)) for c in columns})


def embedded_ids(log: DataFrame, key: str, pattern: str, known: DataFrame, name: str) -> DataFrame:
    """Known ids that appear anywhere in the serialised record."""
    found = F.regexp_extract_all(F.to_json(F.struct("*")), F.lit(pattern), F.lit(0))
    return (
        log.select(key, F.explode(F.array_distinct(found)).alias(name))
        .join(known.select(name).distinct(), name, "left_semi")
        .select(key, name)
    )


def date_extremes(df: DataFrame, keys: Sequence[str], date: str, precision: str) -> DataFrame:
    """First and last date per key, and whether either is only known to the day.

    An extreme loses its hour when any event of that same day came without one.
    """
    per_day = df.where(F.col(date).isNotNull()).groupBy(*keys, F.to_date(date).alias("_d")).agg(
        F.min(date).alias("_lo"), F.max(date).alias("_hi"),
        F.bool_or(F.col(precision) == "fecha").alias("_dia"))
    return per_day.groupBy(*keys).agg(
        F.min("_lo").alias("primera"), F.max("_hi").alias("ultima"),
        F.min_by("_dia", "_d").alias("primera_es_dia"),
        F.max_by("_dia", "_d").alias("ultima_es_dia"),
    )


def transcript_pages(messages: DataFrame, chat: str, page: int = 2000) -> DataFrame:
    """Numbered transcript per chat, cut into pages of ``page`` messages."""
    line = F.concat(F.col("posicion").cast("string"), F.lit(". "), F.col("emisor"), F.lit(": "),
                    F.col("texto"))
    packed = messages.groupBy(
        chat, F.floor((F.col("posicion") - 1) / page).cast("bigint").alias("pagina")
    ).agg(F.sort_array(F.collect_list(F.struct("posicion", line.alias("linea")))).alias("_l"))
    return packed.select(
        chat, "pagina",
        F.array_join(F.transform("_l", lambda x: x["linea"]), "\n").alias("transcripcion"))


def _codes(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[
        F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in rules.items()
    ]))


def check_intake(requests: DataFrame) -> DataFrame:
    """Add ``violaciones`` (empty = accepted) and the normalised contact of each request."""
    name, mail, number = clean("nombre_cliente"), email("correo"), phone("telefono")
    amounts = F.col("cuota_inicial").isNotNull() | F.col("presupuesto").isNotNull()
    rules = {
        "empresa_obligatoria": clean("empresa_id").isNull(),
        "nombre_obligatorio": name.isNull(),
        "nombre_muy_largo": F.length(name) > 200,
        "correo_invalido": clean("correo").isNotNull() & mail.isNull(),
        "sin_contacto_utilizable": number["valor"].isNull() & mail.isNull(),
        "cuota_inicial_negativa": F.col("cuota_inicial") < 0,
        "moneda_no_declarada": amounts & ~F.coalesce(F.col("moneda") == "COP", F.lit(False)),
        "contado_y_credito": (F.col("forma_pago") == "contado") & F.col("cliente_pidio_credito"),
        "inicial_supera_presupuesto": F.col("cuota_inicial") > F.col("presupuesto"),
    }
    return requests.withColumns({
        "violaciones": _codes(rules),
        "nombre_limpio": name,
        "correo_valido": mail,
        "telefono_valido": number["valor"],
        "incidencias": F.array_compact(F.array(F.when(
            ~number["estado"].isin("faltante", "valido"),
            F.concat(F.lit("telefono:"), number["estado"])))),
    })


def check_activity(activities: DataFrame) -> DataFrame:
    """Add ``violaciones`` to each commercial activity."""
    result, due = F.col("resultado"), F.col("proxima_accion_en")
    scheduled = result == "seguimiento_programado"
    rules = {
        "clave_invalida": (F.trim("clave") == "") | (F.length("clave") > 255),
        "resultado_invalido": ~result.isin(V.ACTIVITY_RESULTS) | result.isNull(),
        "nota_muy_larga": F.length("nota") > 2000,
        "falta_motivo": result.isin("perdido", "descartado") & (F.trim("nota") == ""),
        "cierre_sin_confirmar": (result == "cerrado") & ~F.col("confirmar_cierre"),
        "seguimiento_sin_fecha": scheduled & due.isNull(),
        "fecha_sin_seguimiento": ~scheduled & due.isNotNull(),
        "fecha_no_futura": due <= F.col("registrada_en"),
    }
    return activities.withColumn("violaciones", _codes(rules))
