"""Profiles, indicators and service-level measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def owner_reference(df: DataFrame, key: str, owner: str) -> DataFrame:
    """Rows, distinct owners, missing owners and the single owner if there is exactly one."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("filas"),
        F.countDistinct(owner).alias("distintas"),
        F.count_if(F.col(owner).isNull()).alias("faltantes"),
        F.max(owner).alias("_o"),
    ).select(
        key, "filas", "distintas", "faltantes",
        F.when((F.col("distintas") == 1) & (F.col("faltantes") == 0), F.col("_o"))
        .alias("identificada"))


def key_quality(df: DataFrame, key: str, table: str) -> DataFrame:
    """Missing keys, distinct repeated keys and rows with a repeated key."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    repeated = F.col(key).isNotNull() & (F.col("_n") > 1)
    return per_key.agg(
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("_n"))), F.lit(0)).alias(
            "ids_faltantes"),
        F.count_if(repeated).alias("ids_repetidos_distintos"),
        F.coalesce(F.sum(F.when(repeated, F.col("_n"))), F.lit(0)).alias("filas_con_id_repetido"),
    ).select(F.lit(table).alias("tabla"), "ids_faltantes", "ids_repetidos_distintos",
             "filas_con_id_repetido")


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Columns as (campo, valor) rows; one scan, no per-column pass."""
    return df.select(*keep, F.inline(F.array(*[
        F.struct(F.lit(c).alias("campo"), F.col(c).cast("string").alias("valor")) for c in columns
    ])))


def state_frequencies(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    return long_form(df, columns).groupBy("campo", F.col("valor").alias("estado")).agg(
        F.count(F.lit(1)).alias("registros")).withColumn("tabla", F.lit(table))


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return long_form(df, columns).groupBy("campo").agg(
        F.count_if(F.col("valor").isNull()).alias("nulos"),
        F.round(F.avg(F.col("valor").isNull().cast("int")) * 100, 4).alias("porcentaje"))


def site_coverage(advisors: DataFrame) -> DataFrame:
    """Advisors, active ones, unknown state, and capacity only when every active one is known."""
    active = F.coalesce(F.col("activo"), F.lit(False))
    return advisors.groupBy("empresa_id", "punto_venta_id").agg(
        F.count(F.lit(1)).alias("asesores"),
        F.count_if(active).alias("activos"),
        F.count_if(F.col("activo").isNull()).alias("estado_desconocido"),
        F.when(
            F.count_if(active & F.col("capacidad").isNull()) == 0,
            F.coalesce(F.sum(F.when(active, F.col("capacidad"))), F.lit(0)),
        ).alias("capacidad_activos"))


def shared_across_owners(df: DataFrame, value: str, owner: str) -> DataFrame:
    """Values seen under more than one owner."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(
        F.countDistinct(owner).alias("empresas"), F.count(F.lit(1)).alias("filas")
    ).where("empresas > 1")


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def sla_class(start: Column, contact: Column, imprecise: Column, now: Column) -> Column:
    """met / overdue / open / not measurable for the first contact within 24 hours (inclusive)."""
    limit = start + F.expr("interval 24 hours")
    unmeasurable = (
        start.isNull() | (start > now) | F.coalesce(imprecise, F.lit(False))
        | (contact < start) | (contact > now)
    )
    return (
        F.when(F.coalesce(unmeasurable, F.lit(False)) | start.isNull(), "no_medibles")
        .when(contact.isNotNull(), F.when(contact <= limit, "cumplen").otherwise("vencidos"))
        .when(now < limit, "en_plazo")
        .otherwise("vencidos"))


def sla_summary(rows: DataFrame, keys: Sequence[str] = (), column: str = "clase") -> DataFrame:
    """Counts per class and the percentage met among the decided ones."""
    c = F.col(column)
    met, late = F.count_if(c == "cumplen"), F.count_if(c == "vencidos")
    total = met + late
    return rows.groupBy(*keys).agg(
        met.alias("cumplen"), late.alias("vencidos"),
        F.count_if(c == "en_plazo").alias("en_plazo"),
        F.count_if(c == "no_medibles").alias("no_medibles"),
        total.alias("denominador"),
        F.when(total > 0, F.round(met * 100 / F.when(total > 0, total), 2)).alias("porcentaje"))


def dashboard(states: DataFrame, activities: DataFrame, assignments: DataFrame, now: Column,
              keys: Sequence[str] = ("empresa_id",)) -> DataFrame:
    """Indicators of one business day; the inputs are already scoped to the same portfolio."""
    keys = list(keys)
    s = states.groupBy(*keys).agg(
        F.count_if(F.col("estado") == "abierto").alias("leads_activos"),
        F.count_if("requiere_revision").alias("requieren_revision"),
        F.count_if((F.col("estado") == "abierto") & (F.col("proxima_accion_en") < now))
        .alias("seguimientos_vencidos"))
    a = activities.groupBy(*keys).agg(
        F.countDistinct("lead_consolidado_id").alias("gestionados_hoy"),
        F.count_if(F.col("resultado") == "sin_respuesta").alias("intentos_hoy"),
        F.count_if(F.col("resultado") == "contactado").alias("contactos_hoy"))
    d = assignments.groupBy(*keys).agg(F.count(F.lit(1)).alias("asignados_hoy"))
    joined = s.join(a, keys, "left").join(d, keys, "left")
    return joined.na.fill(
        0, ["gestionados_hoy", "intentos_hoy", "contactos_hoy", "asignados_hoy"])


def usage_ledger(log: DataFrame, payload: str, keys: Sequence[str]) -> DataFrame:
    """Requests and token sums out of a serialised usage record."""
    def field(name: str) -> Column:
        return F.coalesce(F.get_json_object(payload, f"$.{name}").cast("bigint"), F.lit(0))

    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("peticiones"),
        F.sum(field("prompt")).alias("entrada"),
        F.sum(field("candidates")).alias("salida"),
        F.sum(field("total")).alias("total"))


def single_owner(refs: DataFrame, key: str, owner: str) -> DataFrame:
    """The one distinct owner among references, else null."""
    return refs.groupBy(key).agg(
        F.when(F.countDistinct(owner) == 1, F.max(owner)).alias("propietario"))
