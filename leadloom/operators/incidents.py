"""Data-quality log: one row per noteworthy cell, row or group, in one common shape."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.operators.checks import left_join_sparse
from leadloom.operators.ranking import Key, numbered

COLUMNS = ["tipo", "tabla", "fila", "id_origen", "campo", "valor_original", "valor_resultante",
           "accion", "motivo"]


def _log(df: DataFrame, **values: Column | str | None) -> DataFrame:
    return df.select(*[
        (v if isinstance(v, Column) else F.lit(v)).cast(
            "bigint" if c == "fila" else "string").alias(c)
        for c in COLUMNS for v in [values.get(c)]])


def cell_log(df: DataFrame, table: str, row: str, key: str, fields: Sequence[str]) -> DataFrame:
    """Missing, unresolved, normalised and inferred cells of every listed field in one scan.

    Reads ``<field>``, and where present ``<field>_normalizado``, ``<field>_estado`` and
    ``<field>_criterio``.
    """
    have = set(df.columns)

    def opt(name: str) -> Column:
        return F.col(name).cast("string") if name in have else F.lit(None).cast("string")

    cells = F.array(*[
        F.struct(
            F.lit(f).alias("campo"), F.col(f).cast("string").alias("original"),
            F.coalesce(opt(f"{f}_normalizado"), F.lit(None) if f"{f}_normalizado" in have
                       else F.col(f).cast("string")).alias("normalizado"),
            F.lit(f"{f}_normalizado" in have).alias("tiene"),
            opt(f"{f}_estado").alias("estado"), opt(f"{f}_criterio").alias("criterio"))
        for f in fields
    ])
    long = df.select(F.col(row).alias("fila"), F.col(key).alias("id_origen"), F.inline(cells))
    blank = F.coalesce(F.trim("original"), F.lit("")) == ""
    resolved = F.col("estado").isin(V.RESOLVED_STATES)
    inferred = F.col("estado").isin("abreviatura_unica", "resuelta_por_contexto")
    unresolved = F.col("estado").isNotNull() & ~resolved
    changed = F.col("tiene") & ~F.col("original").eqNullSafe(F.col("normalizado"))

    def entry(kind: str | Column, action: str, reason: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("tipo"), F.lit(action).alias("accion"),
            F.coalesce("criterio", reason).alias("motivo"))

    state_text = F.concat(F.lit("Estado de validación: "), F.col("estado"),
                          F.lit(". El valor no se reemplaza por una suposición."))
    first = (
        F.when(blank, entry("faltante", "conservar_sin_imputar",
                            F.lit(V.INCIDENT_REASON["faltante"])))
        .when(unresolved, entry("valor_no_resuelto", "conservar_original_y_marcar", state_text))
        .when(changed, entry("normalizacion", "normalizar_en_copia",
                             F.lit(V.INCIDENT_REASON["normalizacion"]))))
    second = F.when(inferred, entry(
        "inferencia_documentada", "conservar_marca_de_inferencia",
        F.lit(V.INCIDENT_REASON["inferencia_documentada"])))
    return long.select(
        "fila", "id_origen", "campo", "original", "normalizado",
        F.inline(F.array_compact(F.array(first, second)))
    ).select(
        "tipo", F.lit(table).alias("tabla"), F.col("fila").cast("bigint").alias("fila"),
        F.col("id_origen").cast("string").alias("id_origen"), "campo",
        F.col("original").alias("valor_original"), F.col("normalizado").alias("valor_resultante"),
        "accion", "motivo")


def date_order_log(resolved: DataFrame, row: str, key: str, rule: Column, motive: Column,
                   original: Column, result: Column) -> DataFrame:
    """Corrections of the day/month order."""
    fixed = resolved.where(rule.startswith("MDY") | rule.startswith("origen_mixto"))
    return _log(fixed, tipo="orden_fechas_corregido", tabla="leads", fila=F.col(row),
                id_origen=F.col(key), campo="fechas_del_lead", valor_original=original,
                valor_resultante=result, accion=rule, motivo=motive)


def sequence_log(df: DataFrame, row: str, key: str, state: Column, comment: Column,
                 original: Column) -> DataFrame:
    return _log(df.where(state == "contacto_anterior_registro"), tipo="secuencia_fechas",
                tabla="leads", fila=F.col(row), id_origen=F.col(key),
                campo="fecha_primer_contacto", valor_original=original,
                accion="conservar_y_marcar", motivo=comment)


def duplicate_log(trace: DataFrame, row: str, key: str) -> DataFrame:
    return _log(trace.where("accion = 'repeticion_exacta'"), tipo="duplicado_exacto",
                tabla="leads", fila=F.col(row), id_origen=F.col(key),
                valor_resultante=F.col("fila_conservada"),
                accion="excluir_repeticion_de_salida",
                motivo=V.INCIDENT_REASON["duplicado_exacto"])


def identity_log(decisions: DataFrame) -> DataFrame:
    return _log(decisions, tipo="duplicado_identidad", tabla="leads",
                id_origen=F.concat_ws("|", "empresa_id", "telefono"),
                valor_resultante=F.col("decision"),
                accion=F.when(F.col("decision") == "agrupado", "agrupar_sin_perder_consultas")
                .otherwise("mantener_separados"),
                motivo=V.INCIDENT_REASON["duplicado_identidad"])


def shared_phone_log(shared: DataFrame) -> DataFrame:
    return _log(shared, tipo="telefono_en_varias_empresas", tabla="leads", campo="telefono",
                valor_original=F.col("telefono"), valor_resultante=F.col("telefono"),
                accion="mantener_separados_por_empresa",
                motivo=V.INCIDENT_REASON["telefono_en_varias_empresas"])


def unlinked_chat_log(chats: DataFrame) -> DataFrame:
    return _log(chats.where("estado_vinculo = 'lead_y_empresa_desconocidos'"),
                tipo="conversacion_sin_lead", tabla="conversaciones",
                id_origen=F.col("conversacion_id"), campo="lead_id",
                valor_original=F.col("lead_id_recibido"),
                accion="conservar_con_vinculo_desconocido", motivo=F.col("anotacion_vinculo"))


def phone_log(decisions: DataFrame) -> DataFrame:
    excluded = F.col("decision").startswith("excluir")
    return _log(decisions,
                tipo=F.when(excluded, "exclusion_registro").otherwise(
                    "telefono_invalido_con_valor"),
                tabla="leads", fila=F.col("fila"), id_origen=F.col("lead_id"), campo="telefono",
                valor_original=F.col("telefono_original"), accion=F.col("decision"),
                motivo=F.col("comentario"))


def unlisted_model_log(availability: DataFrame, row: str, key: str) -> DataFrame:
    return _log(availability.where("disponibilidad = 'no_listado_en_punto'"),
                tipo="modelo_no_listado_en_punto", tabla="leads", fila=F.col(row),
                id_origen=F.col(key), campo="modelo_interes_texto",
                valor_resultante=F.col("modelo_sku"), accion="conservar_interes_y_catalogo",
                motivo=V.INCIDENT_REASON["modelo_no_listado_en_punto"])


def unknown_site_log(orphans: DataFrame, row: str, key: str) -> DataFrame:
    return _log(orphans, tipo="empresa_punto_no_reconocido", tabla="leads", fila=F.col(row),
                id_origen=F.col(key), campo="punto_venta_id",
                valor_original=F.col("punto_venta_id"), accion="conservar_y_marcar",
                motivo=V.INCIDENT_REASON["empresa_punto_no_reconocido"])


def message_gap_log(messages: DataFrame) -> DataFrame:
    """Messages without speaker, hour or text; one row per missing field."""
    fields = F.array(*[
        F.struct(F.lit(c).alias("campo"), F.col(c).alias("_v"))
        for c in ("emisor", "hora", "texto")])
    long = messages.select("conversacion_id", "posicion", F.inline(fields)).where(
        F.coalesce("_v", F.lit("")) == "")
    return _log(long, tipo="mensaje_campo_faltante", tabla="conversaciones",
                id_origen=F.concat_ws("#", "conversacion_id", F.col("posicion").cast("string")),
                campo=F.col("campo"), valor_original=F.col("_v"), accion="conservar_mensaje",
                motivo=V.INCIDENT_REASON["mensaje_campo_faltante"])


def exceptions_table(df: DataFrame, table: str, row: str, key: str, fields: Sequence[str]
                     ) -> DataFrame:
    """Cells whose state is not resolved, with their comment."""
    have = set(df.columns)
    cells = F.array(*[
        F.struct(F.lit(f).alias("campo"), F.col(f).cast("string").alias("valor_original"),
                 F.col(f"{f}_estado").alias("estado"),
                 F.coalesce(F.col(f"{f}_criterio") if f"{f}_criterio" in have
                            else F.lit(None).cast("string"),
                            F.lit("Revisar el estado indicado y el valor original."))
                 .alias("comentario"))
        for f in fields])
    return df.select(
        F.lit(table).alias("tabla"), F.col(row).alias("fila"), F.col(key).alias("id"),
        F.inline(cells)).where(~F.col("estado").isin(V.RESOLVED_STATES))


def traceability(trace: DataFrame, identities: DataFrame, exclusions: DataFrame, row: str
                 ) -> DataFrame:
    """Every received row -> kept row -> identity and output state with its reason."""
    ids = identities.select(
        F.col(row).alias("fila_conservada"), "lead_consolidado_id", "regla_identidad")
    out = exclusions.where("decision = 'excluir_sin_valor_recuperable'").select(
        F.col("fila").alias("fila_conservada"), F.col("comentario").alias("motivo_exclusion"))
    joined = trace.join(ids, "fila_conservada", "left").join(out, "fila_conservada", "left")
    return joined.withColumn(
        "estado_salida",
        F.when(F.col("motivo_exclusion").isNotNull(), "excluido_sin_valor_recuperable")
        .otherwise("conservado"))


def numbered_log(frames: Sequence[DataFrame]) -> DataFrame:
    """All events in one log with sequential ids in a stable order."""
    log = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    order = [Key(c) for c in ("tabla", "tipo", "fila", "id_origen", "campo", "valor_original",
                              "valor_resultante")]
    text = F.col("_n").cast("string")
    return numbered(log, order, out="_n").withColumn("incidencia_id", F.concat(
        F.lit("INC-"), F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text))
    ).drop("_n")


def run_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("tipo").agg(F.count(F.lit(1)).alias("eventos"))


def with_owner(events: DataFrame, owners: DataFrame, external: DataFrame
               ) -> tuple[DataFrame, DataFrame]:
    """Incidents with an inferred company, and those of unlinked chats kept outside.

    The company is the event's own or the single owner of its reference; an event that mentions
    an external chat anywhere stays out.
    """
    mentioned = F.regexp_extract_all(F.to_json(F.struct("*")), F.lit(r"CONV-\d+"), F.lit(0))
    tagged = events.withColumn("_row", F.sha2(F.to_json(F.struct("*")), 256)).withColumn(
        "_ids", mentioned)
    outside = tagged.select("_row", F.explode("_ids").alias("conversacion_id")).join(
        external.select("conversacion_id"), "conversacion_id", "left_semi"
    ).select("_row").distinct()
    inside = tagged.join(outside, "_row", "left_anti")
    single = owners.groupBy("referencia").agg(
        F.when(F.countDistinct("empresa_id") == 1, F.max("empresa_id")).alias("_owner"))
    reference = F.coalesce(*[
        F.nullif(F.col(c), F.lit("")) for c in
        ("conversacion_id", "lead_consolidado_id", "lead_id", "id_origen") if c in events.columns])
    joined = left_join_sparse(inside.withColumn("referencia", reference), single, ["referencia"])
    own = F.col("empresa_id") if "empresa_id" in events.columns else F.lit(None).cast("string")
    kept = joined.withColumn("empresa_inferida", F.coalesce(own, "_owner")).drop(
        "_row", "_ids", "_owner")
    return kept, tagged.join(outside, "_row", "left_semi").drop("_row", "_ids")
