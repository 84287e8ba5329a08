"""Explicit schemas and the key registry of the relational tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _text(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


LEADS = _text(
    "lead_id", "empresa_id", "punto_venta_id", "nombre_cliente", "telefono", "email", "ciudad",
    "canal", "campania", "modelo_interes_texto", "fecha_registro", "fecha_primer_contacto",
    "estado_gestion")
CATALOGUE = _text(
    "sku", "marca", "linea", "cilindraje", "segmento", "precio_lista", "unidades_disponibles",
    "puntos_venta_disponibles")
ADVISORS = _text(
    "asesor_id", "empresa_id", "punto_venta_id", "nombre", "capacidad_diaria_leads", "activo",
    "fecha_ingreso")
HISTORY = _text(
    "lead_id", "empresa_id", "punto_venta_id", "fecha_registro", "canal", "modelo_cotizado",
    "precio_lista", "horas_al_primer_contacto", "numero_contactos", "manifesto_cuota_inicial",
    "forma_pago_declarada", "pidio_cita", "desenlace")
MESSAGE = _text("emisor", "hora", "texto")
CHATS = T.StructType([
    *_text("conversacion_id", "lead_id", "canal", "fecha_inicio").fields,
    T.StructField("mensajes", T.ArrayType(MESSAGE)),
])
SOURCES = {
    "leads.csv": LEADS,
    "catalogo_motos.csv": CATALOGUE,
    "asesores.csv": ADVISORS,
    "historico_cierres.csv": HISTORY,
    "conversaciones.json": CHATS,
}

STAR_KEYS = {
    "empresas": ["empresa_id"],
    "puntos_venta": ["punto_venta_id"],
    "asesores": ["asesor_id"],
    "marcas": ["marca_id"],
    "modelos_moto": ["sku"],
    "disponibilidad_modelo": ["sku", "punto_venta_id"],
    "leads": ["lead_consolidado_id"],
    "consultas": ["lead_id_origen"],
    "conversaciones": ["conversacion_id"],
    "mensajes": ["mensaje_id"],
    "ejecuciones": ["ejecucion_id"],
    "extracciones_ia": ["extraccion_id"],
    "intereses_modelo": ["interes_id"],
    "modelos_ml": ["modelo_ml_id"],
    "priorizaciones": ["priorizacion_id"],
    "historico_cierres": ["historico_id"],
    "archivos_fuente": ["archivo_id"],
    "ejecucion_archivos": ["ejecucion_id", "archivo_id"],
    "trazabilidad_registros": ["trazabilidad_id"],
    "incidencias": ["incidencia_id"],
}

# extraction payload ---------------------------------------------------------
EVIDENCE = T.StructType([
    T.StructField("mensaje", T.IntegerType()),
    T.StructField("emisor", T.StringType()),
    T.StructField("texto", T.StringType()),
])
_EVIDENCES = T.StructField("evidencias", T.ArrayType(EVIDENCE))


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SIGNAL = T.StructType([T.StructField("estado", T.StringType()), _EVIDENCES])
STATEMENT = T.StructType([T.StructField("valor", T.StringType()), _EVIDENCES])
AMOUNT = T.StructType([T.StructField("expresion_original", T.StringType()), _EVIDENCES])
FINDING = T.StructType([
    T.StructField("campo", T.StringType()), T.StructField("descripcion", T.StringType()),
    _EVIDENCES])
EVENT_FIELDS = ["asesor_ofrecio", "cliente_solicito", "cliente_acepto", "cliente_rechazo"]
EVENT = _struct(**{f: SIGNAL for f in EVENT_FIELDS})
CREDIT_FIELDS = [*EVENT_FIELDS, "cliente_declaro_contado"]
CREDIT = _struct(**{f: SIGNAL for f in CREDIT_FIELDS})
AMOUNT_FIELDS = ["presupuesto_total", "cuota_inicial", "cuota_mensual_maxima"]
MONEY = _struct(**{f: AMOUNT for f in AMOUNT_FIELDS})
PAYLOAD = T.StructType([
    T.StructField("conversacion_id", T.StringType()),
    T.StructField("modelos_interes", T.ArrayType(STATEMENT)),
    T.StructField("dinero", MONEY),
    T.StructField("credito", CREDIT),
    T.StructField("forma_pago", STATEMENT),
    T.StructField("intencion_declarada", STATEMENT),
    T.StructField("objecion_principal", STATEMENT),
    T.StructField("cita", EVENT),
    T.StructField("cotizacion", EVENT),
    T.StructField("cambios_de_declaracion", T.ArrayType(FINDING)),
    T.StructField("inconsistencias", T.ArrayType(FINDING)),
    T.StructField("limitaciones", T.ArrayType(T.StringType())),
])
