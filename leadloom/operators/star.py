"""Relational tables of the batch, with stable ids and unique keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.functions import ids, numbers
from leadloom.functions.dates import date_parts
from leadloom.operators.checks import duplicate_keys
from leadloom.schemas import STAR_KEYS


def company_site_masters(sources: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Companies, sites and violations from every (empresa_id, punto_venta_id) reference.

    A site seen under two companies keeps no owner and is reported.
    """
    refs = reduce(
        DataFrame.unionByName, [s.select("empresa_id", "punto_venta_id") for s in sources]
    ).distinct()
    companies = refs.where(F.col("empresa_id").isNotNull()).select("empresa_id").distinct()
    sites = refs.where(F.col("punto_venta_id").isNotNull()).groupBy("punto_venta_id").agg(
        F.countDistinct("empresa_id").alias("empresas"), F.max("empresa_id").alias("_e"))
    sites = sites.select(
        "punto_venta_id", "empresas",
        F.when(F.col("empresas") == 1, F.col("_e")).alias("empresa_id"))
    bad = sites.where("empresas > 1").select(
        F.lit("sede_en_varias_empresas").alias("regla"), F.col("punto_venta_id").alias("clave"))
    bad = bad.unionByName(refs.where(F.col("empresa_id").isNull()).select(
        F.lit("registro_sin_empresa").alias("regla"), F.col("punto_venta_id").alias("clave")))
    return companies, sites, bad


def split_sites(catalogue: DataFrame, column: str = "puntos_venta_disponibles") -> DataFrame:
    """(sku, punto_venta_id) pairs of a '|'-separated list."""
    return catalogue.select(
        "sku", F.explode(F.split(column, r"\|")).alias("punto_venta_id")
    ).select("sku", F.upper(F.trim("punto_venta_id")).alias("punto_venta_id")).where(
        "punto_venta_id <> ''").distinct()


def message_rows(chats: DataFrame) -> DataFrame:
    """One row per message of nested chats, with 1-based position and stable id."""
    return chats.select("conversacion_id", F.posexplode("mensajes").alias("_p", "m")).select(
        ids.stable_id(ids.json_string("conversacion_id"), ids.json_number(F.col("_p") + 1))
        .alias("mensaje_id"),
        "conversacion_id", (F.col("_p") + 1).cast("bigint").alias("posicion"),
        F.col("m.emisor").alias("emisor"), F.col("m.hora").alias("hora_original"),
        F.col("m.texto").alias("texto"))


def with_date(df: DataFrame, name: str, source: str, precision: str | None = None) -> DataFrame:
    """Replace a date text by its date / hour / precision triple."""
    p = date_parts(source, precision)
    return df.withColumn("_d", p).withColumns({
        name: F.col("_d.fecha"), f"{name}_hora": F.col("_d.hora"),
        f"{name}_precision": F.col("_d.precision"), f"{name}_violacion": F.col("_d.violacion"),
    }).drop("_d")


def build_star(frames: dict[str, DataFrame], run: str) -> dict[str, DataFrame]:
    """The relational tables of one processed snapshot.

    ``frames``: leads, consultas_leads, asesores, catalogo_motos, historico_cierres,
    conversaciones (nested), extracciones, priorizacion_leads, trazabilidad_leads, archivos,
    incidencias. ``run`` identifies the load.
    """
    advisors, inquiries = frames["asesores"], frames["consultas_leads"]
    history, catalogue = frames["historico_cierres"], frames["catalogo_motos"]
    companies, sites, _ = company_site_masters([advisors, inquiries, history])
    brand = ids.row_id("marca")
    chats = frames["conversaciones"]
    extraction_id = ids.stable_id(ids.json_string(F.lit(run)), ids.json_string("conversacion_id"))
    out = {
        "empresas": companies.withColumn("nombre", F.lit(None).cast("string")),
        "puntos_venta": sites.select("punto_venta_id", "empresa_id"),
        "asesores": with_date(advisors, "fecha_ingreso", "fecha_ingreso").select(
            "asesor_id", "empresa_id", "punto_venta_id", "nombre",
            numbers.strict_integer("capacidad_diaria_leads")["valor"].alias(
                "capacidad_diaria_leads"),
            numbers.strict_boolean("activo")["valor"].alias("activo"),
            "fecha_ingreso", "fecha_ingreso_hora", "fecha_ingreso_precision"),
        "marcas": catalogue.select(brand.alias("marca_id"), F.col("marca").alias("nombre")
                                   ).distinct(),
        "modelos_moto": catalogue.select(
            "sku", brand.alias("marca_id"), "linea",
            numbers.strict_integer("cilindraje")["valor"].alias("cilindraje"),
            numbers.blank_to_null("segmento").alias("segmento"),
            numbers.strict_decimal("precio_lista")["valor"].cast("decimal(18,2)").alias(
                "precio_lista"),
            numbers.strict_integer("unidades_disponibles")["valor"].alias(
                "unidades_disponibles")),
        "disponibilidad_modelo": split_sites(catalogue),
        "leads": frames["leads"],
        "consultas": with_date(
            with_date(inquiries, "fecha_registro", "fecha_registro"),
            "fecha_primer_contacto", "fecha_primer_contacto",
        ).withColumnRenamed("lead_id", "lead_id_origen"),
        "conversaciones": with_date(
            chats.where(F.col("empresa_id").isNotNull()), "fecha_inicio", "fecha_inicio"
        ).drop("mensajes"),
        "mensajes": message_rows(chats.where(F.col("empresa_id").isNotNull())),
        "ejecuciones": advisors.sparkSession.createDataFrame(
            [(run, "carga", "completada")], "ejecucion_id string, etapa string, estado string"),
        "extracciones_ia": frames["extracciones"].select(
            extraction_id.alias("extraccion_id"), "*"),
        "intereses_modelo": interest_rows(frames["extracciones"].withColumn(
            "extraccion_id", extraction_id), catalogue),
        "modelos_ml": frames["modelos_ml"],
        "priorizaciones": frames["priorizacion_leads"].withColumn(
            "priorizacion_id", ids.stable_id(
                ids.json_string(F.lit(run)), ids.json_string("lead_consolidado_id"))),
        "historico_cierres": with_date(history, "fecha_registro", "fecha_registro"
                                       ).withColumnRenamed("lead_id", "historico_id"),
        "archivos_fuente": frames["archivos"].select(
            ids.row_id("ruta", "hash_contenido").alias("archivo_id"), "ruta", "hash_contenido"),
        "trazabilidad_registros": frames["trazabilidad_leads"].withColumn(
            "trazabilidad_id", ids.stable_id(
                ids.json_string(F.lit(run)), ids.json_number("fila_origen"))),
        "incidencias": frames["incidencias"],
    }
    out["ejecucion_archivos"] = out["archivos_fuente"].select(
        F.lit(run).alias("ejecucion_id"), "archivo_id", F.lit("entrada_validada").alias("funcion"))
    return {name: out[name] for name in STAR_KEYS}


def interest_rows(extractions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One row per model mention with its unique sku, numbered inside the extraction."""
    from leadloom.operators.catalog import resolve_mentions

    exploded = extractions.select(
        "extraccion_id", F.posexplode("modelos_interes").alias("_i", "m")
    ).select("extraccion_id", "_i", F.col("m.valor").alias("texto_mencionado"),
             F.col("m.evidencias").alias("evidencias"))
    named = resolve_mentions(exploded, "texto_mencionado", catalogue)
    return named.select(
        ids.stable_id(ids.json_string("extraccion_id"), ids.json_number("_i")).alias("interes_id"),
        "extraccion_id", "texto_mencionado", F.col("sku").alias("modelo_sku"),
        F.when(F.col("sku").isNotNull(), "identificado").otherwise("sin_resolver").alias(
            "estado_identificacion"),
        "evidencias")


def star_violations(star: dict[str, DataFrame]) -> DataFrame:
    """Repeated or missing keys in any table of the star."""
    parts = [
        duplicate_keys(star[name], keys).select(
            F.lit(name).alias("tabla"),
            F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("clave"), "filas")
        for name, keys in STAR_KEYS.items()
    ]
    return reduce(DataFrame.unionByName, parts)
