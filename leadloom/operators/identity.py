"""Duplicates, identity inside one company, consolidation and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import ids, names
from leadloom.functions.text import clean, fold_key
from leadloom.operators.checks import left_join_sparse
from leadloom.operators.ranking import Key, group_codes, null_safe_key, with_positions

OWNER_PHONE = ["empresa_id", "telefono"]


def exact_duplicates(df: DataFrame, columns: Sequence[str], row: str) -> DataFrame:
    """Map every row to the first row with identical columns (nulls equal)."""
    keyed = df.withColumn("_h", F.sha2(null_safe_key(columns), 256))
    kept = keyed.groupBy("_h").agg(
        F.min(row).alias("fila_conservada"), F.count(F.lit(1)).alias("copias"))
    return (
        keyed.join(kept, "_h")
        .drop("_h")
        .withColumn(
            "accion",
            F.when(F.col(row) == F.col("fila_conservada"), "conservar").otherwise(
                "repeticion_exacta"),
        )
    )


def candidate_groups(inquiries: DataFrame) -> DataFrame:
    """Companies and valid phones shared by several inquiries, numbered in order."""
    shared = (
        inquiries.where(F.col("empresa_id").isNotNull() & F.col("telefono").isNotNull())
        .groupBy(*OWNER_PHONE).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    )
    return shared.join(group_codes(shared, OWNER_PHONE, "DUP-", "grupo"), OWNER_PHONE)


def duplicate_summary(inquiries: DataFrame) -> DataFrame:
    """Counts and a first reading per shared phone. Expects ``nombre``, ``email``, ``canal``,
    ``lead_id`` and ``copia`` (digest of the original row)."""
    key = fold_key("nombre")
    base = inquiries.where(
        F.col("empresa_id").isNotNull() & F.col("telefono").isNotNull()
    ).withColumn("_k", key)
    # one row per distinct original first: repeats are only counted
    per_copy = base.groupBy(*OWNER_PHONE, "copia").agg(
        F.count(F.lit(1)).alias("_n"), F.first("lead_id").alias("lead_id"),
        F.first("_k").alias("_k"), F.first("email").alias("email"), F.first("canal").alias("canal"),
    )
    n = F.col("_n")
    grouped = per_copy.groupBy(*OWNER_PHONE).agg(
        F.sum(n).alias("filas"),
        F.countDistinct("lead_id").alias("ids_distintos"),
        F.count(F.lit(1)).alias("filas_originales_distintas"),
        F.sum(F.when(n > 1, n).otherwise(0)).alias("filas_en_repeticiones_exactas"),
        F.countDistinct("_k").alias("nombres_distintos"),
        F.sum(F.when(F.col("_k").isNull(), n).otherwise(0)).alias("nombres_faltantes"),
        F.countDistinct("email").alias("correos_distintos"),
        F.sum(F.when(F.col("email").isNull(), n).otherwise(0)).alias("correos_faltantes"),
        F.countDistinct("canal").alias("canales_distintos"),
    ).where("filas > 1")
    return grouped.withColumn(
        "lectura_inicial",
        F.when(F.col("filas_originales_distintas") == 1, "Todas las filas son idénticas")
        .when(
            (F.col("nombres_distintos") > 1) | (F.col("correos_distintos") > 1),
            "Revisar diferencias de nombre o correo",
        )
        .otherwise("Datos de identidad compatibles; revisar consultas y faltantes"),
    )


def identity_proposals(inquiries: DataFrame) -> DataFrame:
    """Proposal and reasons per shared phone of one company."""
    base = inquiries.where(
        F.col("empresa_id").isNotNull() & F.col("telefono").isNotNull()
    ).withColumns({"_k": fold_key("nombre"), "_full": names.is_full_name("nombre")})
    grouped = base.groupBy(*OWNER_PHONE).agg(
        F.count(F.lit(1)).alias("consultas"),
        F.countDistinct("_k").alias("_names"),
        F.countDistinct("email").alias("_mails"),
        F.bool_or(F.col("_k").isNull()).alias("_no_name"),
        F.bool_and("_full").alias("_full"),
        F.bool_or(F.col("email").isNull()).alias("_no_mail"),
    ).where("consultas > 1")
    same = (
        (F.col("_names") == 1) & ~F.col("_no_name") & F.col("_full") & (F.col("_mails") <= 1)
    )
    reasons = F.array_compact(F.array(
        F.when(same, "mismo nombre completo normalizado y sin correos contradictorios"),
        F.when(F.col("_names") > 1, "nombres diferentes; pueden incluir abreviaturas"),
        F.when(F.col("_no_name"), "nombre faltante"),
        F.when(~F.col("_full"), "nombre incompleto o con iniciales"),
        F.when(F.col("_mails") > 1, "correos diferentes"),
        F.when(F.col("_no_mail"), "correo faltante en alguna consulta"),
    ))
    return grouped.select(
        *OWNER_PHONE,
        "consultas",
        F.when(same, "agrupar_cliente_conservar_consultas")
        .otherwise("revision_manual_identidad")
        .alias("propuesta"),
        F.when(F.size(reasons) > 0, F.array_join(reasons, "; "))
        .otherwise("revisar evidencia de identidad")
        .alias("motivo"),
    )


def compatible_groups(inquiries: DataFrame, group: Sequence[str], name: str) -> DataFrame:
    """Groups of several rows and whether every pair of names is compatible.

    Between full names "the short one is an ordered part of the long one" is transitive, and a
    name with an initial can only be the shortest. So all pairs agree exactly when each name
    agrees with the next longer one, and a compatible group has at most two distinct names per
    word count. Names are folded and counted first; no pair of rows is ever built.
    """
    tokens = names.name_tokens(name)
    distinct = (
        inquiries.select(*group, tokens.alias("_t"))
        .groupBy(*group, "_t")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    entry = F.struct(
        names.name_order(F.col("_t")).alias("o"), F.col("_t").alias("t"), F.col("_n").alias("n"))
    per_length = distinct.groupBy(*group, F.size("_t").alias("_len")).agg(
        F.sum("_n").alias("_rows"),
        F.count(F.lit(1)).alias("_names"),
        F.min(entry).alias("_lo"),
        F.max(entry).alias("_hi"),
    )
    per_group = per_length.groupBy(*group).agg(
        F.sum("_rows").alias("filas"),
        F.max("_names").alias("_worst"),
        # one entry per word count, at most two names each
        F.sort_array(F.collect_list(F.struct("_len", "_lo", "_hi", "_names"))).alias("_levels"),
    ).where("filas > 1")
    chain = F.flatten(F.transform(
        "_levels",
        lambda v: F.when(v["_names"] == 1, F.array(v["_lo"])).otherwise(
            F.array(v["_lo"], v["_hi"])),
    ))
    pairs_ok = F.forall(
        F.when(
            F.size("_chain") > 1,
            F.transform(
                F.sequence(F.lit(1), F.size("_chain") - 1),
                lambda i: names.tokens_compatible(
                    F.get("_chain", i - 1)["t"], F.get("_chain", i)["t"]),
            ),
        ).otherwise(F.array().cast("array<boolean>")),
        lambda ok: ok,
    )
    repeats_ok = F.forall(
        "_chain", lambda e: (e["n"] == 1) | names.tokens_compatible(e["t"], e["t"]))
    return per_group.withColumn("_chain", chain).select(
        *group,
        "filas",
        F.when(F.col("_worst") > 2, False).otherwise(pairs_ok & repeats_ok).alias("compatibles"),
    )


def resolve_identities(inquiries: DataFrame) -> DataFrame:
    """Attach ``lead_consolidado_id`` and the rule that produced it.

    Inquiries of one company with the same valid phone form one person only if all their names
    are pairwise compatible; otherwise each stays on its own. Companies never mix.
    """
    eligible = F.col("telefono").isNotNull() & F.col("empresa_id").isNotNull()
    groups = compatible_groups(inquiries.where(eligible), OWNER_PHONE, "nombre").where(
        "compatibles").select(*OWNER_PHONE, F.lit(True).alias("_same"))
    joined = left_join_sparse(inquiries, groups, OWNER_PHONE, spread=["lead_id", "nombre"])
    same = F.coalesce(F.col("_same"), F.lit(False))
    return joined.withColumns({
        "lead_consolidado_id": F.when(
            same,
            ids.lead_identity("empresa_id", F.concat(F.lit("telefono:"), F.col("telefono"))),
        ).otherwise(
            ids.lead_identity("empresa_id", F.concat(F.lit("consulta:"), F.col("lead_id")))),
        "regla_identidad": F.when(same, "empresa_telefono_nombre_compatible").otherwise(
            "consulta_individual"),
    }).drop("_same")


def identity_decisions(inquiries: DataFrame) -> DataFrame:
    """One decision per shared phone."""
    groups = compatible_groups(
        inquiries.where(F.col("telefono").isNotNull() & F.col("empresa_id").isNotNull()),
        OWNER_PHONE, "nombre")
    return groups.select(
        *OWNER_PHONE,
        F.col("filas").alias("consultas"),
        F.when(F.col("compatibles"), "agrupado").otherwise("separado_por_identidad_incierta")
        .alias("decision"),
    )


def best_name(name: Column) -> Column:
    """Aggregate: the fullest, longest name; the first in order on a tie."""
    rank = names.presentation_rank(name)
    return F.min_by(name, F.when(name.isNotNull(), F.struct(-rank["n"], -rank["l"], name)))


def consolidate(resolved: DataFrame) -> DataFrame:
    """One row per identity: presentation name, counters, date range, flags.

    Expects ``nombre, telefono, telefono_estado, email, canal, punto_venta_id, modelo_estado,
    fecha_registro`` beside the identity columns. Lists are a frame of their own
    (``informed_values``), so a very large identity never becomes one huge row.
    """
    name = clean("nombre")
    known_model = F.col("modelo_estado").isin("coincidencia_exacta", "abreviatura_unica")
    return resolved.groupBy("empresa_id", "lead_consolidado_id").agg(
        best_name(name).alias("nombre_presentacion"),
        F.bool_and(F.col("telefono_estado") == "valido").alias("telefono_utilizable"),
        F.coalesce(F.min("email") != F.max("email"), F.lit(False)).alias("varios_correos"),
        F.countDistinct("canal").alias("canales"),
        F.countDistinct("telefono").alias("telefonos"),
        F.count_if(~F.coalesce(known_model, F.lit(False))).alias("consultas_con_modelo_pendiente"),
        F.min("fecha_registro").alias("primera_fecha_registro"),
        F.max("fecha_registro").alias("ultima_fecha_registro"),
        F.count_if(F.col("fecha_registro").isNull()).alias("consultas_con_fecha_pendiente"),
        F.count(F.lit(1)).alias("numero_consultas"),
    )


def informed_values(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Sorted distinct present values in long form: ``keys, campo, orden, valor``."""
    long = df.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(f).alias("campo"), F.col(f).cast("string").alias("valor")) for f in fields
    ]))).where(F.col("valor").isNotNull()).distinct()
    return with_positions(
        long, [*keys, "campo"], [Key("valor")], [Key(F.substring("valor", 1, 4))],
        [Key(F.substring("valor", 1, 10))], out="orden",
    )


def listed_values(df: DataFrame, keys: Sequence[str], fields: Sequence[str], page: int = 1000
                  ) -> DataFrame:
    """The same lists as arrays, cut into pages so that every array stays bounded."""
    long = informed_values(df, keys, fields).withColumn(
        "pagina", F.floor((F.col("orden") - 1) / page).cast("bigint"))
    packed = long.groupBy(*keys, "campo", "pagina").agg(
        F.sort_array(F.collect_list(F.struct("orden", "valor"))).alias("_v"))
    return packed.withColumn("valores", F.transform("_v", lambda v: v["valor"])).drop("_v")


def reconcile_identities(
    base_leads: DataFrame, base_inquiries: DataFrame, batch_leads: DataFrame,
    batch_inquiries: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Map batch identities onto stored ones.

    Returns ``(mapping, violations)``: ``mapping`` is (lead_consolidado_id, destino); violations
    name batches that would change an owner, guess between people, merge stored people or use one
    stored person twice.
    """
    stored_refs = base_inquiries.select(
        "lead_id_origen", F.col("lead_consolidado_id").alias("_dest"),
        F.col("empresa_id").alias("_owner"))
    stored_names = base_leads.select(
        F.col("lead_consolidado_id").alias("_dest"),
        F.col("empresa_id").alias("_dest_owner"),
        F.col("nombre_presentacion").alias("_dest_name"))
    own = batch_leads.select(
        "lead_consolidado_id", "empresa_id", "nombre_presentacion")
    rows = batch_inquiries.select("lead_id_origen", "lead_consolidado_id", "telefono").join(
        own, "lead_consolidado_id")
    linked = rows.join(stored_refs, "lead_id_origen", "left")

    by_id = own.join(
        stored_names.select(F.col("_dest").alias("lead_consolidado_id")), "lead_consolidado_id",
        "left_semi",
    ).select("lead_consolidado_id", F.col("lead_consolidado_id").alias("_dest"))
    by_ref = linked.where(F.col("_dest").isNotNull()).select("lead_consolidado_id", "_dest")

    phones = base_inquiries.where(F.col("telefono").isNotNull()).groupBy(
        "empresa_id", "telefono").agg(
        (F.min("lead_consolidado_id") == F.max("lead_consolidado_id")).alias("_single"),
        F.min("lead_consolidado_id").alias("_found"))
    by_phone = (
        linked.where(F.col("_dest").isNull() & F.col("telefono").isNotNull())
        .drop("_dest", "_owner")
        .join(phones, ["empresa_id", "telefono"])
        .join(stored_names.select(F.col("_dest").alias("_found"), "_dest_name"), "_found", "left")
        .withColumn("_ok", F.col("_single") & names.names_compatible(
            "nombre_presentacion", "_dest_name"))
    )
    found = by_phone.where("_ok").select("lead_consolidado_id", F.col("_found").alias("_dest"))
    candidates = by_id.unionByName(by_ref).unionByName(found).groupBy("lead_consolidado_id").agg(
        F.countDistinct("_dest").alias("_n"), F.min("_dest").alias("_dest"))
    mapping = own.join(candidates, "lead_consolidado_id", "left").select(
        "lead_consolidado_id", "empresa_id",
        F.coalesce("_dest", "lead_consolidado_id").alias("destino"))

    def broken(frame: DataFrame, rule: str, key: str) -> DataFrame:
        return frame.select(F.lit(rule).alias("regla"), F.col(key).cast("string").alias("clave"))

    violations = (
        broken(linked.where(F.col("_owner") != F.col("empresa_id")),
               "referencia_de_otra_empresa", "lead_id_origen")
        .unionByName(broken(by_phone.where("NOT _ok"), "identidad_ambigua", "lead_consolidado_id"))
        .unionByName(broken(candidates.where("_n > 1"), "fusiona_identidades",
                            "lead_consolidado_id"))
        .unionByName(broken(
            mapping.groupBy("destino").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"),
            "destino_repetido", "destino"))
        .unionByName(broken(
            mapping.join(stored_names.withColumnRenamed("_dest", "destino"), "destino").where(
                F.col("_dest_owner") != F.col("empresa_id")),
            "identidad_de_otra_empresa", "lead_consolidado_id"))
        .distinct()
    )
    return mapping.select("lead_consolidado_id", "destino"), violations


def remap(df: DataFrame, mapping: DataFrame, column: str = "lead_consolidado_id") -> DataFrame:
    """Rewrite a reference through the identity map."""
    m = mapping.select(F.col("lead_consolidado_id").alias(column), F.col("destino").alias("_d"))
    return df.join(m, column, "left").withColumn(column, F.coalesce("_d", column)).drop("_d")


def people_by_phone(people: DataFrame, phone: str = "telefono") -> DataFrame:
    """(empresa_id, phone, personas, primera): how many people share a phone, and the first.

    Decisions need no more than that, so requests meet one row per phone however many people
    there are. ``visible``, if present, is whether all of them are.
    """
    seen = [F.bool_and("visible").alias("visible")] if "visible" in people.columns else []
    return people.where(F.col(phone).isNotNull()).groupBy("empresa_id", phone).agg(
        F.countDistinct("lead_consolidado_id").alias("personas"),
        F.min("lead_consolidado_id").alias("primera"), *seen)


def intake_by_phone(requests: DataFrame, people: DataFrame, phone: str = "telefono") -> DataFrame:
    """New, existing or review per request, from the people who share its company and phone."""
    joined = requests.select("solicitud_id", "empresa_id", phone).join(
        people_by_phone(people, phone), ["empresa_id", phone], "left")
    n, seen = F.coalesce("personas", F.lit(0)), F.coalesce("visible", F.lit(True))
    return joined.select(
        "solicitud_id",
        F.when(n == 0, "nueva").when((n > 1) | ~seen, "revision_requerida")
        .otherwise("consulta_existente").alias("estado"),
        F.when((n == 1) & seen, F.col("primera")).alias("lead_consolidado_id"),
        F.when(n > 1, "identidad_ambigua").when((n == 1) & ~seen, "coincidencia_fuera_de_cartera")
        .alias("motivo"))


def intake_decision(candidates: DataFrame, requests: DataFrame) -> DataFrame:
    """New, existing or review per request.

    ``candidates``: (solicitud_id, empresa_id, lead_consolidado_id, visible). A candidate of
    another company is an error, several are ambiguous, one outside the portfolio goes to review
    without its id.
    """
    c = candidates.select(
        "solicitud_id", F.col("empresa_id").alias("_owner"), "lead_consolidado_id", "visible"
    ).distinct()
    r = requests.select("solicitud_id", "empresa_id")
    grouped = c.join(r, "solicitud_id").groupBy("solicitud_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_or(F.col("_owner") != F.col("empresa_id")).alias("_foreign"),
        F.min("lead_consolidado_id").alias("_lead"),
        F.bool_and("visible").alias("_seen"),
    )
    joined = r.join(grouped, "solicitud_id", "left")
    n = F.coalesce("_n", F.lit(0))
    review = (n > 1) | ~F.coalesce("_seen", F.lit(True))
    return joined.select(
        "solicitud_id",
        F.when(F.coalesce("_foreign", F.lit(False)), "error_otra_empresa")
        .when(n == 0, "nueva")
        .when(review, "revision_requerida")
        .otherwise("consulta_existente")
        .alias("estado"),
        F.when(~F.coalesce("_foreign", F.lit(False)) & (n == 1) & F.col("_seen"), F.col("_lead"))
        .alias("lead_consolidado_id"),
        F.when(F.coalesce("_foreign", F.lit(False)), None)
        .when(n > 1, "identidad_ambigua")
        .when((n == 1) & ~F.col("_seen"), "coincidencia_fuera_de_cartera")
        .alias("motivo"),
    )


def clean_split(resolved: DataFrame, decisions: DataFrame, row: str
                ) -> tuple[DataFrame, DataFrame]:
    """Kept and excluded inquiries, from the invalid-phone decisions."""
    out = decisions.where(F.col("decision") == "excluir_sin_valor_recuperable").select(row)
    return resolved.join(out, row, "left_anti"), resolved.join(out, row, "left_semi")


def link_chats(chats: DataFrame, kept: DataFrame) -> DataFrame:
    """Chats with their lead and company, or an explicit unknown link."""
    from leadloom import fixed_values as V

    ref = kept.select(
        "lead_id", F.col("empresa_id").alias("_e"), F.col("lead_consolidado_id").alias("_l"))
    joined = left_join_sparse(
        chats.withColumnRenamed("lead_id", "lead_id_recibido"),
        ref.withColumnRenamed("lead_id", "lead_id_recibido"), ["lead_id_recibido"])
    ok = F.col("_l").isNotNull()
    return joined.withColumns({
        "lead_id_vinculado": F.when(ok, F.col("lead_id_recibido")),
        "lead_consolidado_id": F.col("_l"),
        "empresa_id": F.col("_e"),
        "estado_vinculo": F.when(ok, "identificado").otherwise("lead_y_empresa_desconocidos"),
        "anotacion_vinculo": F.when(ok, V.LINK_NOTE[True]).otherwise(V.LINK_NOTE[False]),
    }).drop("_e", "_l")


def phone_exclusions(inquiries: DataFrame, chat_leads: DataFrame) -> DataFrame:
    """Keep or exclude each invalid-phone inquiry, listing what makes it worth keeping."""
    from leadloom import fixed_values as V

    flagged = inquiries.where(F.col("telefono_estado") != "valido").join(
        chat_leads.select("lead_id").distinct().withColumn("_chat", F.lit(True)), "lead_id", "left")
    key = fold_key("nombre")
    texts = ["email", "modelo_interes_texto", "ciudad", "canal", "campania"]
    labels = [c if c == "modelo_interes_texto" else f"{c}_normalizado" for c in texts]
    useful = F.array_compact(F.array(
        F.when(~key.isin(V.TEST_NAMES), "nombre distinto de un marcador de prueba"),
        *[F.when(clean(c).isNotNull(), F.lit(label)) for c, label in zip(texts, labels, strict=True)],
        F.when(F.col("fecha_registro").isNotNull(), "fecha de registro válida"),
        F.when(F.col("fecha_primer_contacto").isNotNull(), "primer contacto válido"),
        F.when(F.col("estado_gestion") != "Sin gestión", "gestión comercial registrada"),
        F.when(F.col("_chat"), "conversación asociada"),
    ))
    return flagged.withColumn("_u", useful).select(
        "fila", "lead_id", "empresa_id", "telefono_original", "telefono_estado",
        F.when(F.size("_u") > 0, "conservar_con_anotacion")
        .otherwise("excluir_sin_valor_recuperable")
        .alias("decision"),
        F.when(
            F.size("_u") > 0,
            F.concat(F.lit("Teléfono inválido; conservar porque contiene: "),
                     F.array_join("_u", ", "), F.lit(".")),
        ).otherwise(V.EXCLUSION_TEXT).alias("comentario"),
    )
