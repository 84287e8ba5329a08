"""Verification of facts extracted from chats against the literal messages.

One input row is one chat: a nested ``extraccion`` (``schemas.PAYLOAD``) beside its ``mensajes``.
Every rule is an expression over that row, so the whole verification is one narrow projection
without shuffles; only catalogue lookups join. All holders of evidence are first put into one
array of signals, the rules run as transforms over it, and the record is rebuilt at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom import schemas as S
from leadloom.functions.money import money
from leadloom.functions.numbers import state_flag
from leadloom.functions.text import ascii_fold, html_unescape, let

EV = "array<struct<mensaje:int,emisor:string,texto:string>>"
INCIDENT = ("struct<campo:string,tipo:string,detalle:string,antes:string,despues:string,"
            "estado:string>")
P = V.CHAT_PATTERNS


# --- contract -----------------------------------------------------------------------------------
def contract_violations(df: DataFrame, payload: str, key: str) -> DataFrame:
    """Breaches of the strict payload contract: (key, violaciones), only for broken payloads.

    Missing or unknown keys at any level, values outside their enumeration, evidence without
    position, speaker or text.
    """
    as_map, as_maps = "map<string,string>", "array<map<string,string>>"

    def field(obj: Column, name: str) -> Column:
        return F.try_element_at(obj, F.lit(name))

    def flag(broken: Column, code: str) -> Column:
        return F.when(F.coalesce(broken, F.lit(True)), F.lit(code))

    def same_keys(obj: Column, expected: list[str]) -> Column:
        return F.sort_array(F.map_keys(obj)) == F.array(*[F.lit(k) for k in sorted(expected)])

    def fine(e: Column) -> Column:
        return F.coalesce(
            same_keys(e, ["emisor", "mensaje", "texto"])
            & field(e, "mensaje").rlike(r"^[1-9]\d*\z")
            & field(e, "emisor").isin("cliente", "asesor")
            & (F.length(field(e, "texto")) > 0),
            F.lit(False))

    def holder(parent: Column, name: str, path: str, expected: list[str], allowed=None) -> Column:
        def judge(obj: Column) -> Column:
            items = F.from_json(field(obj, "evidencias"), as_maps)
            checks = [flag(~same_keys(obj, expected), f"claves:{path}"),
                      flag(~F.forall(items, fine), f"evidencias:{path}")]
            if allowed:
                checks.append(flag(~field(obj, expected[0]).isin(allowed), f"valor:{path}"))
            return F.array(*checks)

        return let(F.from_json(field(parent, name), as_map), judge)

    def group(root: Column, name: str, fields: list[str]) -> Column:
        amount = name == "dinero"

        def judge(obj: Column) -> Column:
            return F.concat(
                F.array(flag(~same_keys(obj, fields), f"claves:{name}")),
                *[holder(obj, f, f"{name}.{f}",
                         ["expresion_original" if amount else "estado", "evidencias"],
                         None if amount else ["si", "no_explicito", "no_mencionado"])
                  for f in fields])

        return let(F.from_json(field(root, name), as_map), judge)

    def listed(root: Column, name: str, expected: list[str]) -> Column:
        return let(F.from_json(field(root, name), as_maps), lambda items: F.array(
            flag(~F.forall(items, lambda e: same_keys(e, expected)), f"claves:{name}")))

    def judge(root: Column) -> Column:
        payment = ["contado", "credito", "mixto", "desconocida"]
        found = F.concat(
            F.array(flag(~same_keys(root, S.PAYLOAD.fieldNames()), "claves:raiz")),
            group(root, "dinero", S.AMOUNT_FIELDS),
            group(root, "credito", S.CREDIT_FIELDS),
            group(root, "cita", S.EVENT_FIELDS),
            group(root, "cotizacion", S.EVENT_FIELDS),
            *[holder(root, n, n, ["valor", "evidencias"], payment if n == "forma_pago" else None)
              for n in ("forma_pago", "intencion_declarada", "objecion_principal")],
            listed(root, "modelos_interes", ["evidencias", "valor"]),
            listed(root, "cambios_de_declaracion", ["campo", "descripcion", "evidencias"]),
            listed(root, "inconsistencias", ["campo", "descripcion", "evidencias"]),
        )
        return F.when(root.isNull(), F.array(F.lit("json_invalido"))).otherwise(
            F.array_compact(found))

    codes = let(F.from_json(payload, as_map), judge)
    # rows come out of a generator, so the parsing is not repeated by a pushed-down filter
    return df.select(F.col(key), F.inline(F.filter(
        F.array(F.struct(codes.alias("violaciones"))), lambda x: F.size(x["violaciones"]) > 0)))


def parse_payload(c: Column | str) -> Column:
    """Typed payload of a JSON text that already passed the contract."""
    return F.from_json(c, S.PAYLOAD)


# --- signals ------------------------------------------------------------------------------------
def _incident(path: Column, kind: str, before: Column, after: Column, pending: Column | bool,
              detail: Column | None = None) -> Column:
    waiting = F.lit(pending) if isinstance(pending, bool) else pending
    return F.struct(
        path.alias("campo"), F.lit(kind).alias("tipo"),
        (F.lit(V.CHAT_DETAIL.get(kind)) if detail is None else detail).alias("detalle"),
        before.cast("string").alias("antes"), after.cast("string").alias("despues"),
        F.when(waiting, "pendiente_revision").otherwise("corregido_por_regla").alias("estado"),
    ).cast(INCIDENT)


def _incidents(*items: Column) -> Column:
    return F.array_compact(F.array(*items)).cast(f"array<{INCIDENT}>")


def _signal(path: Column, kind: str, state: Column, value: Column, evidence: Column) -> Column:
    return F.struct(
        path.cast("string").alias("ruta"), F.lit(kind).alias("clase"),
        state.cast("string").alias("estado"), value.cast("string").alias("valor"),
        F.coalesce(evidence.cast(EV), F.array().cast(EV)).alias("ev"),
        F.array().cast(f"array<{INCIDENT}>").alias("inc"))


def _signals(e: Column) -> Column:
    """All evidence holders of the payload in document order."""
    none = F.lit(None)

    def listed(name: str, kind: str, state, value) -> Column:
        return F.transform(e[name], lambda x, i: _signal(
            F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]")), kind, state(x), value(x),
            x["evidencias"]))

    def states(group: str, fields: list[str]) -> list[Column]:
        return [_signal(F.lit(f"{group}.{f}"), "senal", e[group][f]["estado"], none,
                        e[group][f]["evidencias"]) for f in fields]

    amounts = [_signal(F.lit(f"dinero.{f}"), "monto", none, e["dinero"][f]["expresion_original"],
                       e["dinero"][f]["evidencias"]) for f in S.AMOUNT_FIELDS]
    values = [_signal(F.lit(f), "valor", none, e[f]["valor"], e[f]["evidencias"])
              for f in ("forma_pago", "intencion_declarada", "objecion_principal")]
    return F.concat(
        listed("modelos_interes", "valor", lambda x: none, lambda x: x["valor"]),
        F.array(*amounts, *states("credito", S.CREDIT_FIELDS), *values,
                *states("cita", S.EVENT_FIELDS), *states("cotizacion", S.EVENT_FIELDS)),
        listed("cambios_de_declaracion", "hallazgo", lambda x: x["campo"],
               lambda x: x["descripcion"]),
        listed("inconsistencias", "hallazgo", lambda x: x["campo"], lambda x: x["descripcion"]),
    )


def _messages(mensajes: Column) -> Column:
    """Messages with position, folded text and, where it can matter, their amount."""

    def folded(m: Column, i: Column) -> Column:
        return F.struct((i + 1).alias("i"), m["emisor"].alias("emisor"), m["texto"].alias("texto"),
                        ascii_fold(m["texto"]).alias("s"))

    def priced(m: Column) -> Column:
        client = m["emisor"] == "cliente"
        kind = F.when(client & m["s"].contains("tengo") & m["s"].contains("inicial"),
                      "cuota_inicial").when(
            client & m["s"].startswith(V.CASH_READY_PREFIX), "presupuesto_total")
        both = client & m["s"].contains("tengo") & m["s"].contains("inicial") & m["s"].startswith(
            V.CASH_READY_PREFIX)
        return F.struct(
            m["i"].alias("i"), m["emisor"].alias("emisor"), m["texto"].alias("texto"),
            m["s"].alias("s"), kind.alias("campo"), both.alias("ambos"),
            F.when(kind.isNotNull(), money(m["texto"])).alias("m"))

    return F.transform(F.transform(mensajes, folded), priced)


def _valid(ev: Column, msgs: Column) -> Column:
    m = F.get(msgs, ev["mensaje"] - 1)
    return F.coalesce(
        (ev["mensaje"] >= 1) & F.contains(m["texto"], ev["texto"]) & (m["emisor"] == ev["emisor"]),
        F.lit(False))


def _repair(ev: Column, msgs: Column) -> Column:
    """The literal fragment a badly encoded quote stands for, null when it cannot be told."""
    m = F.get(msgs, ev["mensaje"] - 1)
    known = F.coalesce((ev["mensaje"] >= 1) & (m["emisor"] == ev["emisor"]), F.lit(False))

    def literal(decoded: Column) -> Column:
        bare = F.regexp_replace(decoded, r"(?U)^[^\w]+", "")
        pieces = F.split(bare, "%{1,2}")
        quoted = F.transform(pieces, lambda p: F.concat(
            F.lit(r"\Q"), F.replace(p, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
        found = F.regexp_extract_all(
            m["texto"], F.array_join(quoted, V.REPAIR_WILDCARD), F.lit(0))
        enough = F.length(F.regexp_replace(bare, r"(?U)\W", "")) >= 8
        return (
            F.when((decoded != "") & F.contains(m["texto"], decoded), decoded)
            .when((bare != "") & F.contains(m["texto"], bare), bare)
            .when(decoded.contains("%") & enough, F.when(F.size(found) == 1, F.get(found, F.lit(0))))
        )

    return F.when(known & ~_valid(ev, msgs), let(html_unescape(ev["texto"]), literal))


def _quote(i: Column, speaker: str | Column, text: Column) -> Column:
    return F.struct(
        i.cast("int").alias("mensaje"),
        (F.lit(speaker) if isinstance(speaker, str) else speaker).alias("emisor"),
        text.alias("texto"))


def _with(s: Column, estado=None, valor=None, ev=None, inc: Column | None = None) -> Column:
    """A signal with some fields replaced and incidents appended."""
    more = s["inc"] if inc is None else F.concat(s["inc"], inc)
    return F.struct(
        s["ruta"].alias("ruta"), s["clase"].alias("clase"),
        (s["estado"] if estado is None else estado).cast("string").alias("estado"),
        (s["valor"] if valor is None else valor).cast("string").alias("valor"),
        (s["ev"] if ev is None else ev).cast(EV).alias("ev"), more.alias("inc"))


def _cleaned(s: Column, msgs: Column) -> Column:
    """Quote repair, literal check, right speaker, and the consequences for state and value."""
    finding = s["clase"] == "hallazgo"

    def mend(x: Column) -> Column:
        pairs = F.transform(x["ev"], lambda e: F.struct(e.alias("e"), _repair(e, msgs).alias("r")))
        return let(pairs, lambda ps: _with(
            x,
            ev=F.transform(ps, lambda p: _quote(
                p["e"]["mensaje"], p["e"]["emisor"], F.coalesce(p["r"], p["e"]["texto"]))),
            inc=F.transform(
                F.filter(ps, lambda p: p["r"].isNotNull()),
                lambda p: _incident(x["ruta"], "formato_cita_reparado", F.to_json(p["e"]), p["r"],
                                    False))))

    def literal(x: Column) -> Column:
        kept = F.filter(x["ev"], lambda e: _valid(e, msgs))
        return let(kept, lambda k: _with(x, ev=k, inc=_incidents(F.when(
            F.size(k) != F.size(x["ev"]),
            _incident(x["ruta"], "evidencia_invalida", F.to_json(x["ev"]), F.to_json(k), True)))))

    def speaker(x: Column) -> Column:
        actor = F.when(x["ruta"].contains("asesor_ofrecio"), "asesor").otherwise("cliente")
        own = F.filter(x["ev"], lambda e: e["emisor"] == actor)
        judged = let(own, lambda k: _with(x, ev=k, inc=_incidents(F.when(
            (F.size(x["ev"]) > 0) & (F.size(k) == 0),
            _incident(x["ruta"], "sin_declaracion_del_actor", F.to_json(x["ev"]), F.lit("[]"),
                      True)))))
        return F.when(finding, x).otherwise(judged)

    def state(x: Column) -> Column:
        denied = F.exists(x["ev"], lambda e: ascii_fold(e["texto"]).rlike(P["negation"]))
        unsupported = (x["estado"] == "no_explicito") & (F.size(x["ev"]) > 0) & ~denied
        bare = (F.size(x["ev"]) == 0) & (x["estado"] != "no_mencionado")
        gone = unsupported | bare
        return _with(
            x,
            estado=F.when(gone, "no_mencionado").otherwise(x["estado"]),
            ev=F.when(gone | (x["estado"] == "no_mencionado"), F.array().cast(EV)).otherwise(
                x["ev"]),
            inc=_incidents(
                F.when(unsupported, _incident(
                    x["ruta"], "negativa_no_sustentada", x["estado"], F.lit("no_mencionado"),
                    False)),
                F.when(bare, _incident(
                    x["ruta"], "estado_sin_evidencia", x["estado"], F.lit("no_mencionado"),
                    x["estado"] == "si"))))

    def value(x: Column) -> Column:
        payment = x["ruta"] == "forma_pago"
        bare = x["valor"].isNotNull() & (x["valor"] != "desconocida") & (F.size(x["ev"]) == 0)
        told = F.exists(x["ev"], lambda e: F.contains(e["texto"], x["valor"]))
        loose = ~payment & x["valor"].isNotNull() & (F.size(x["ev"]) > 0) & ~told
        last = F.get(x["ev"], F.size(x["ev"]) - 1)["texto"]
        return _with(
            x,
            valor=F.when(bare, F.when(payment, "desconocida")).when(loose, last).otherwise(
                x["valor"]),
            inc=_incidents(
                F.when(bare, _incident(
                    x["ruta"], "valor_sin_evidencia", x["valor"], F.lit(None), True)),
                F.when(loose, _incident(
                    x["ruta"], "resumen_sustituido_por_cita", x["valor"], last, False))))

    checked = let(let(let(s, mend), literal), speaker)
    return let(checked, lambda x: F.when(x["clase"] == "senal", state(x)).when(
        x["clase"] == "valor", value(x)).otherwise(x))


def _credit_decision(s: Column, msgs: Column) -> Column:
    """Acceptance and refusal of credit must be explicit in the quoted words."""
    texts = F.transform(s["ev"], lambda e: F.struct(
        e["mensaje"].alias("i"), ascii_fold(e["texto"]).alias("s")))

    def accepted(t: Column) -> Column:
        before = F.filter(msgs, lambda m: (m["i"] < t["i"]) & (m["emisor"] == "asesor"))
        context = F.coalesce(F.get(before, F.size(before) - 1)["s"], F.lit(""))
        offered = context.rlike(P["credit_offer"]) & ~context.rlike(P["credit_study"])
        return (t["s"].rlike(P["accepts"]) & ~t["s"].rlike(P["no"])
                & (t["s"].rlike(P["credit"]) | offered))

    def judge(ts: Column) -> Column:
        yes = s["estado"] == "si"
        backed = (
            F.when(s["ruta"].endswith("cliente_acepto"),
                   F.when(yes, F.exists(ts, accepted)).otherwise(
                       F.exists(ts, lambda t: t["s"].rlike(P["denies_credit"]))))
            .when(yes, F.exists(ts, lambda t: t["s"].rlike(P["rejects_credit"])))
            .otherwise(F.exists(ts, lambda t: t["s"].rlike(P["denies_rejection"])))
        )
        after = _with(s, estado=F.lit("no_mencionado"), ev=F.array().cast(EV), inc=_incidents(
            _incident(s["ruta"], "decision_credito_no_explicita", s["estado"],
                      F.lit("no_mencionado"), False)))
        return F.when(backed, s).otherwise(after)

    concerned = s["ruta"].isin("credito.cliente_acepto", "credito.cliente_rechazo") & (
        s["estado"] != "no_mencionado")
    return F.when(concerned, let(texts, judge)).otherwise(s)


def _payment(s: Column) -> Column:
    """A payment form needs its words in the evidence."""
    text = F.array_join(F.transform(s["ev"], lambda e: ascii_fold(e["texto"])), " ")

    def judge(t: Column) -> Column:
        credit, cash = t.rlike(P["credit_payment"]), t.contains(P["cash"])
        backed = F.when(s["valor"] == "credito", credit).when(
            s["valor"] == "contado", cash).otherwise(credit & cash)
        after = _with(s, valor=F.lit("desconocida"), ev=F.array().cast(EV), inc=_incidents(
            _incident(s["ruta"], "forma_pago_no_declarada", s["valor"], F.lit("desconocida"),
                      False)))
        return F.when(backed, s).otherwise(after)

    concerned = (s["ruta"] == "forma_pago") & (s["valor"] != "desconocida")
    return F.when(concerned, let(text, judge)).otherwise(s)


def _offer(s: Column, msgs: Column) -> Column:
    """A question about payment is no offer; a concrete one in the source is recovered."""
    texts = F.transform(s["ev"], lambda e: ascii_fold(e["texto"]))
    asks = F.forall(texts, lambda t: t.contains("?") & t.contains(P["cash"]) & t.rlike(
        "financiad|credito") & ~t.rlike(P["real_offer"]))
    offers = F.transform(
        F.filter(msgs, lambda m: (m["emisor"] == "asesor") & m["s"].rlike(P["concrete_offer"])),
        lambda m: _quote(m["i"], "asesor", m["texto"]))

    def withdraw(x: Column) -> Column:
        only_asks = (x["estado"] == "si") & (F.size(x["ev"]) > 0) & asks
        return F.when(only_asks, _with(
            x, estado=F.lit("no_mencionado"), ev=F.array().cast(EV), inc=_incidents(_incident(
                x["ruta"], "pregunta_no_es_oferta", F.lit("si"), F.lit("no_mencionado"),
                False)))).otherwise(x)

    def recover(x: Column) -> Column:
        return let(offers, lambda o: F.when(
            (F.size(o) > 0) & (x["estado"] == "no_mencionado"),
            _with(x, estado=F.lit("si"), ev=o, inc=_incidents(_incident(
                x["ruta"], "oferta_explicita_recuperada", x["estado"], F.to_json(o), False))),
        ).otherwise(x))

    return F.when(s["ruta"] == "credito.asesor_ofrecio", let(let(s, withdraw), recover)).otherwise(s)


def _said(msgs: Column, pattern: str) -> Column:
    """Client quotes that match a pattern and are no instruction to the extractor."""
    return F.transform(
        F.filter(msgs, lambda m: (m["emisor"] == "cliente") & m["s"].rlike(pattern)
                 & ~m["s"].rlike(P["injection"])),
        lambda m: _quote(m["i"], "cliente", m["texto"]))


def _recover_text(s: Column, path: str, kind: str, candidates: Column, single: bool) -> Column:
    def take(c: Column) -> Column:
        usable = (F.size(c) == 1) if single else (F.size(c) > 0)
        last = F.get(c, F.size(c) - 1)
        return F.when(usable, _with(
            s, valor=last["texto"], ev=F.array(last),
            inc=_incidents(_incident(s["ruta"], kind, F.lit(None), last["texto"], False)),
        )).otherwise(s)

    return F.when((s["ruta"] == path) & s["valor"].isNull(), let(candidates, take)).otherwise(s)


AMOUNT_OUT = ("struct<expresion_original:string,evidencias:" + EV + ",valor:double,minimo:double,"
              "maximo:double,aproximado:boolean,moneda:string>")
FINDING_OUT = f"struct<campo:string,descripcion:string,evidencias:{EV},origen:string>"


def _amount_result(s: Column, msgs: Column) -> Column:
    """struct(monto, inc, cambios, inconsistencias) of one amount signal."""
    field = F.substring_index(s["ruta"], ".", -1)
    found = F.filter(msgs, lambda m: F.coalesce(
        ((m["campo"] == field) | m["ambos"]) & m["m"]["error"].isNull(), F.lit(False)))
    no_findings = F.array().cast(f"array<{FINDING_OUT}>")
    empty = F.lit(None).cast("struct<valor:double,minimo:double,maximo:double,aproximado:boolean,"
                             "moneda:string,error:string>")

    def quote(m: Column) -> Column:
        return _quote(m["i"], "cliente", m["texto"])

    def finding(text: str, c: Column) -> Column:
        return F.array(F.struct(
            s["ruta"].alias("campo"), F.lit(text).alias("descripcion"),
            F.transform(c, quote).alias("evidencias"), F.lit("regla_local").alias("origen"),
        )).cast(f"array<{FINDING_OUT}>")

    def start(c: Column) -> Column:
        kinds = F.array_distinct(F.transform(c, lambda m: F.struct(
            m["m"]["valor"], m["m"]["minimo"], m["m"]["maximo"])))
        last = F.get(c, F.size(c) - 1)
        many = F.size(kinds) > 1
        corrected = many & last["s"].rlike(P["correction"])
        return F.struct(
            c.alias("c"), many.alias("many"), corrected.alias("corrected"), last.alias("last"),
            F.when(corrected | (F.size(c) == 1), last).alias("only"),
            F.when(corrected, last["texto"]).otherwise(s["valor"]).alias("expr"),
            F.when(corrected, F.array(quote(last))).otherwise(s["ev"]).cast(EV).alias("ev"),
            money(s["valor"]).alias("said"))

    def recover(x: Column) -> Column:
        now = F.when(x["corrected"], x["last"]["m"]).otherwise(x["said"])
        only = x["only"]
        differs = only.isNotNull() & (
            now["error"].isNotNull()
            | ~(now["valor"].eqNullSafe(only["m"]["valor"])
                & now["minimo"].eqNullSafe(only["m"]["minimo"])
                & now["maximo"].eqNullSafe(only["m"]["maximo"])))
        expr = F.when(differs, only["texto"]).otherwise(x["expr"])
        ev = F.when(differs, F.array(quote(only)).cast(EV)).otherwise(x["ev"])
        return F.struct(
            x.alias("x"), differs.alias("differs"), expr.alias("expr"), ev.alias("ev"),
            F.when(differs, only["m"]).otherwise(now).alias("m"))

    def finish(r: Column) -> Column:
        x = r["x"]
        conflict = x["many"] & ~x["corrected"]
        outside = r["expr"].isNotNull() & ~F.exists(
            r["ev"], lambda e: F.contains(e["texto"], r["expr"]))
        error = F.when(outside, V.MONEY_ERRORS["outside"]).otherwise(r["m"]["error"])
        approx = r["expr"].isNotNull() & F.exists(
            r["ev"], lambda e: ascii_fold(e["texto"]).rlike(V.MONEY_APPROXIMATE))
        m = F.when(~conflict & error.isNull(), r["m"]).otherwise(empty)
        return F.struct(
            F.struct(
                F.when(~conflict, r["expr"]).alias("expresion_original"),
                F.when(conflict, F.array().cast(EV)).otherwise(r["ev"]).alias("evidencias"),
                m["valor"].alias("valor"), m["minimo"].alias("minimo"), m["maximo"].alias("maximo"),
                F.when(m.isNotNull() & approx, True).otherwise(m["aproximado"])
                .alias("aproximado"),
                m["moneda"].alias("moneda"),
            ).cast(AMOUNT_OUT).alias("monto"),
            F.concat(s["inc"], _incidents(
                F.when(x["corrected"], _incident(
                    s["ruta"], "cambio_importe_explicito", s["valor"], x["last"]["texto"], False)),
                F.when(conflict, _incident(
                    s["ruta"], "importes_contradictorios", s["valor"], F.lit(None), True)),
                F.when(~conflict & r["differs"], _incident(
                    s["ruta"], "importe_explicito_recuperado", x["expr"], r["expr"], False)),
                F.when(~conflict & error.isNotNull(), _incident(
                    s["ruta"], "monto_no_convertible", r["expr"], F.lit(None), True, error)),
            )).alias("inc"),
            F.when(x["corrected"], finding(V.FINDING_CHANGE, x["c"])).otherwise(no_findings)
            .alias("cambios"),
            F.when(conflict, finding(V.FINDING_CONFLICT, x["c"])).otherwise(no_findings)
            .alias("inconsistencias"))

    return let(let(let(found, start), recover), finish)


def verify_extractions(df: DataFrame) -> DataFrame:
    """Verified record per chat: normalised ``extraccion``, ``incidencias``, ``estado_extraccion``.

    Expects ``extraccion`` (``schemas.PAYLOAD``) and ``mensajes``; other columns pass through.
    """
    rest = [c for c in df.columns if c not in ("extraccion", "mensajes")]
    # each stage reads the one before exactly once, so the plan stays linear in the rules
    first, *stages = _rule_columns()
    work = df.withColumn("_v", first)
    for stage in stages:
        work = work.withColumn("_v", stage)
    return work.select(
        *rest, "mensajes", F.col("_v.extraccion").alias("extraccion"),
        F.col("_v.incidencias").alias("incidencias"),
        F.col("_v.estado_extraccion").alias("estado_extraccion"))


def _rule_columns() -> tuple[Column, ...]:
    """The rule expressions; they name columns, not data."""
    start = F.struct(
        F.col("extraccion").alias("e"), _messages(F.col("mensajes")).alias("m"),
        _signals(F.col("extraccion")).alias("s"), F.lit(None).alias("a"))
    return (start, *[let(F.col("_v"), stage) for stage in _stages()])


def _stages() -> list[Callable[[Column], Column]]:
    """The rules in order, each from a state (payload, messages, signals, amounts) to the next."""

    def state(x: Column, **changed: Column) -> Column:
        return F.struct(*[changed.get(n, x[n]).alias(n) for n in ("e", "m", "s", "a")])

    def clean(x: Column) -> Column:
        return state(x, s=F.transform(x["s"], lambda s: _cleaned(s, x["m"])))

    def judge_credit(x: Column) -> Column:
        return state(x, s=F.transform(x["s"], lambda s: let(
            _credit_decision(s, x["m"]), _payment)))

    def amounts(x: Column) -> Column:
        held = F.filter(x["s"], lambda s: s["clase"] == "monto")
        return F.struct(
            x["e"].alias("e"), x["m"].alias("m"),
            F.transform(x["s"], lambda s: _offer(s, x["m"])).alias("s"),
            F.transform(held, lambda s: _amount_result(s, x["m"])).alias("a"))

    def phrases(x: Column) -> Column:
        visit = F.filter(
            x["s"], lambda s: (s["ruta"] == "cita.cliente_solicito") & (s["estado"] == "si"))
        asked = F.coalesce(F.get(visit, F.lit(0))["ev"], F.array().cast(EV))
        msgs = x["m"]
        wanted = let(asked, lambda a: F.when(F.size(a) > 0, a).otherwise(
            _said(msgs, P["intention"])))
        return let(wanted, lambda w: state(x, s=F.transform(x["s"], lambda s: let(
            _recover_text(s, "intencion_declarada", "frase_explicita_recuperada", w, single=False),
            lambda y: _recover_text(y, "objecion_principal", "objecion_literal_recuperada",
                                    _said(msgs, P["objection"]), single=True)))))

    def finish(x: Column) -> Column:
        log = F.concat(
            F.flatten(F.transform(F.filter(x["s"], lambda s: s["clase"] != "monto"),
                                  lambda s: s["inc"])),
            F.flatten(F.transform(x["a"], lambda a: a["inc"])))
        return let(log, lambda inc: F.struct(
            _rebuild(x["e"], x["s"], x["a"]).alias("extraccion"), inc.alias("incidencias"),
            F.when(F.exists(inc, lambda i: i["estado"] == "pendiente_revision"),
                   "requiere_revision").otherwise("validada_automaticamente")
            .alias("estado_extraccion")))

    return [clean, judge_credit, amounts, phrases, finish]


def _rebuild(e: Column, signals: Column, amounts: Column) -> Column:
    """The nested record out of the signals and amounts."""

    def one(path: str) -> Column:
        return F.get(F.filter(signals, lambda s: s["ruta"] == path), F.lit(0))

    def state(path: str) -> Column:
        return let(one(path), lambda s: F.struct(
            s["estado"].alias("estado"), s["ev"].alias("evidencias")))

    def value(path: str) -> Column:
        return let(one(path), lambda s: F.struct(
            s["valor"].alias("valor"), s["ev"].alias("evidencias")))

    def findings(name: str, local: str) -> Column:
        held = F.transform(
            F.filter(signals, lambda s: s["ruta"].startswith(name)),
            lambda s: F.struct(
                s["estado"].alias("campo"), s["valor"].alias("descripcion"),
                s["ev"].alias("evidencias"),
                F.when(s["valor"].isin(V.FINDING_CHANGE, V.FINDING_CONFLICT), "regla_local")
                .otherwise("modelo").alias("origen")))
        return F.concat(held.cast(f"array<{FINDING_OUT}>"),
                        F.flatten(F.transform(amounts, lambda a: a[local])))

    return F.struct(
        e["conversacion_id"].alias("conversacion_id"),
        F.transform(F.filter(signals, lambda s: s["ruta"].startswith("modelos_interes")),
                    lambda s: F.struct(s["valor"].alias("valor"), s["ev"].alias("evidencias")))
        .alias("modelos_interes"),
        F.struct(*[F.get(amounts, F.lit(i))["monto"].alias(f)
                   for i, f in enumerate(S.AMOUNT_FIELDS)]).alias("dinero"),
        F.struct(*[state(f"credito.{f}").alias(f) for f in S.CREDIT_FIELDS]).alias("credito"),
        value("forma_pago").alias("forma_pago"),
        value("intencion_declarada").alias("intencion_declarada"),
        value("objecion_principal").alias("objecion_principal"),
        F.struct(*[state(f"cita.{f}").alias(f) for f in S.EVENT_FIELDS]).alias("cita"),
        F.struct(*[state(f"cotizacion.{f}").alias(f) for f in S.EVENT_FIELDS]).alias("cotizacion"),
        findings("cambios_de_declaracion", "cambios").alias("cambios_de_declaracion"),
        findings("inconsistencias", "inconsistencias").alias("inconsistencias"),
        e["limitaciones"].alias("limitaciones"))


# --- what follows from a verified record --------------------------------------------------------
def evidence_rows(df: DataFrame, payload: str = "extraccion") -> DataFrame:
    """Every quoted evidence with its path."""
    key = "conversacion_id"
    flat = F.transform(_signals(F.col(payload)), lambda s: F.struct(
        s["ruta"].alias("ruta"), s["clase"].alias("clase"), s["estado"].alias("estado"),
        s["valor"].alias("valor"), s["ev"].alias("ev")))
    return df.select(F.col(f"{payload}.{key}").alias(key), F.inline(flat)).select(
        key, "ruta", "clase", "estado", "valor", F.inline("ev"))


def evidence_violations(evidence: DataFrame, messages: DataFrame) -> DataFrame:
    """Quotes that are no literal part of that message by that speaker."""
    m = messages.select(
        "conversacion_id", F.col("posicion").cast("int").alias("mensaje"),
        F.col("emisor").alias("_e"), F.col("texto").alias("_t"))
    joined = evidence.join(m, ["conversacion_id", "mensaje"], "left")
    fine = (F.col("_e") == F.col("emisor")) & (F.length("texto") > 0) & F.contains(
        F.col("_t"), F.col("texto"))
    return joined.where(~F.coalesce(fine, F.lit(False))).drop("_e", "_t")


def record_status(incidents: DataFrame, keys: list[str]) -> DataFrame:
    return incidents.groupBy(*keys).agg(
        F.when(F.bool_or(F.col("estado") == "pendiente_revision"), "requiere_revision")
        .otherwise("validada_automaticamente").alias("estado_extraccion"))


def technical_errors(incidents: DataFrame, keys: list[str]) -> DataFrame:
    """Pending incidents other than real contradictions."""
    return incidents.groupBy(*keys).agg(F.count_if(
        (F.col("estado") == "pendiente_revision")
        & (F.col("tipo") != "importes_contradictorios")).alias("errores"))


def flat_signals(verified: DataFrame) -> DataFrame:
    """One flat row per usable chat; unknown stays null."""
    e = F.col("extraccion")
    flags = {
        "cliente_pidio_cita": e["cita"]["cliente_solicito"],
        "cliente_pidio_cotizacion": e["cotizacion"]["cliente_solicito"],
        "cliente_pidio_credito": e["credito"]["cliente_solicito"],
        "asesor_ofrecio_credito": e["credito"]["asesor_ofrecio"],
    }
    values = {
        "presupuesto": e["dinero"]["presupuesto_total"], "cuota_inicial":
        e["dinero"]["cuota_inicial"], "forma_pago": e["forma_pago"],
        "intencion_declarada": e["intencion_declarada"],
        "objecion_principal": e["objecion_principal"],
    }

    def quotes(name: str, holder: Column) -> Column:
        return F.transform(holder["evidencias"], lambda ev: F.struct(
            F.lit(name).alias("campo"), ev["mensaje"].alias("posicion"),
            ev["texto"].alias("cita")))

    mentions = F.flatten(F.transform(e["modelos_interes"], lambda m: quotes("modelos_interes", m)))
    usable = (F.col("estado_extraccion") != "requiere_revision") & (
        F.size(e["inconsistencias"]) == 0)
    row = F.struct(
        e["conversacion_id"].alias("conversacion_id"),
        F.filter(F.transform(e["modelos_interes"], lambda m: m["valor"]),
                 lambda v: v.isNotNull()).alias("modelos_interes"),
        *[(F.nullif(v["valor"], F.lit("desconocida")) if n == "forma_pago" else v["valor"]).alias(n)
          for n, v in values.items()],
        *[state_flag(v["estado"]).alias(n) for n, v in flags.items()],
        F.concat(*[quotes(n, v) for n, v in {**values, **flags}.items()], mentions)
        .alias("evidencias"))
    # rows come out of a generator: a filter would be pushed below and verify every chat twice
    return verified.select(F.inline(F.when(usable, F.array(row))))


def flat_violations(results: DataFrame) -> DataFrame:
    """Breaches of the flat result contract beside its messages (arrays on one row)."""
    client = ["modelos_interes", "presupuesto", "cuota_inicial", "forma_pago",
              "intencion_declarada", "objecion_principal", "cliente_pidio_cita",
              "cliente_pidio_cotizacion", "cliente_pidio_credito"]
    ev, msgs = F.col("evidencias"), F.col("mensajes")

    def message(x: Column) -> Column:
        return F.get(msgs, x["posicion"] - 1)

    def backed(name: str) -> Column:
        return F.exists(ev, lambda x: x["campo"] == name)

    def present(name: str) -> Column:
        return F.size(name) > 0 if name == "modelos_interes" else (
            F.col(name).isNotNull() & (F.col(name).cast("string") != ""))

    unfounded = F.lit(False)
    for name in [*client, "asesor_ofrecio_credito"]:
        unfounded = unfounded | (F.coalesce(present(name), F.lit(False)) & ~backed(name))
    rules = {
        "modelo_vacio": F.exists("modelos_interes", lambda m: F.coalesce(F.trim(m), F.lit("")) == ""),
        "importe_invalido": F.exists(F.array("presupuesto", "cuota_inicial"), lambda v: (
            v < 0) | F.isnan(v) | (v == float("inf"))),
        "forma_pago_fuera_de_contrato": ~F.col("forma_pago").isin("credito", "contado"),
        "texto_vacio": F.exists(F.array("intencion_declarada", "objecion_principal"),
                                lambda v: F.trim(v) == ""),
        "campo_desconocido": F.exists(
            ev, lambda x: ~x["campo"].isin([*client, "asesor_ofrecio_credito"])),
        "mensaje_inexistente": F.exists(ev, lambda x: message(x)["texto"].isNull()),
        "cita_inexistente": F.exists(ev, lambda x: (F.trim(x["cita"]) == "") | ~F.contains(
            message(x)["texto"], x["cita"])),
        "emisor_incorrecto": F.exists(ev, lambda x: F.lower(F.trim(message(x)["emisor"])) != F.when(
            x["campo"] == "asesor_ofrecio_credito", "asesor").otherwise("cliente")),
        "hecho_sin_evidencia": unfounded,
        "modelo_fuera_de_cita": F.exists("modelos_interes", lambda m: ~F.exists(
            F.filter(ev, lambda x: x["campo"] == "modelos_interes"),
            lambda x: F.contains(F.lower(x["cita"]), F.lower(m)))),
        "contado_y_credito": (F.col("forma_pago") == "contado") & F.col("cliente_pidio_credito"),
        "inicial_supera_presupuesto": F.col("cuota_inicial") > F.col("presupuesto"),
    }
    codes = F.array_compact(F.array(*[
        F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in rules.items()]))
    return results.withColumn("violaciones", codes)


def review_rows(verified: DataFrame) -> DataFrame:
    """One review line per chat, with its numbered transcript."""
    e = F.col("extraccion")
    line = F.transform("mensajes", lambda m, i: F.concat(
        (i + 1).cast("string"), F.lit(". "), m["emisor"], F.lit(": "), m["texto"]))
    return verified.select(
        e["conversacion_id"].alias("conversacion_id"),
        F.array_join(F.transform(e["modelos_interes"], lambda m: F.coalesce(
            m["valor"], F.lit(""))), "; ").alias("modelos"),
        e["dinero"]["presupuesto_total"]["valor"].alias("presupuesto"),
        e["dinero"]["cuota_inicial"]["valor"].alias("inicial"),
        e["dinero"]["cuota_mensual_maxima"]["valor"].alias("cuota_maxima"),
        e["forma_pago"]["valor"].alias("forma_pago"),
        e["intencion_declarada"]["valor"].alias("intencion"),
        e["objecion_principal"]["valor"].alias("objecion"),
        e["cita"]["cliente_solicito"]["estado"].alias("pidio_cita"),
        e["cotizacion"]["cliente_solicito"]["estado"].alias("pidio_cotizacion"),
        e["cotizacion"]["cliente_acepto"]["estado"].alias("acepto_cotizacion"),
        "estado_extraccion", F.array_join(line, "\n").alias("mensajes_originales"))


def incident_log(verified: DataFrame, discarded: DataFrame) -> DataFrame:
    """Incidents of four origins, each stamped when its chat was discarded."""
    e = F.col("extraccion")

    def entry(kind: Column | str, state: Column | str, field: Column, detail: Column) -> Column:
        return F.struct(
            (F.lit(kind) if isinstance(kind, str) else kind).alias("tipo"),
            (F.lit(state) if isinstance(state, str) else state).alias("estado"),
            field.cast("string").alias("campo"), detail.alias("detalle"))

    none = F.lit(None)
    own = F.transform("incidencias", lambda i: entry(
        i["tipo"], i["estado"], i["campo"], i["detalle"]))
    found = F.transform(e["inconsistencias"], lambda i: entry(
        F.when(i["origen"] == "modelo", "inconsistencia_candidata_ia").otherwise(
            "inconsistencia_detectada_por_regla"),
        "pendiente_revision_semantica", i["campo"], i["descripcion"]))
    limits = F.transform(e["limitaciones"], lambda d: entry("limitacion_ia", "informativo", none, d))
    unknown = F.filter(
        F.array(entry("empresa_desconocida", "sin_vinculo", none, F.lit(
            "Conversación conservada; no se asigna a una empresa por inferencia."))),
        lambda _: F.col("empresa_id").isNull())
    out = verified.select(
        e["conversacion_id"].alias("conversacion_id"), "empresa_id", "lead_id",
        F.inline(F.concat(own, found, limits, unknown)))
    flagged = discarded.select("conversacion_id").distinct().withColumn(
        "decision_registro", F.lit("descartado_por_instruccion_del_usuario"))
    return out.join(flagged, "conversacion_id", "left")


def discard_reasons(verified: DataFrame, source_findings: DataFrame) -> DataFrame:
    """Why chats are unusable: declared inconsistencies, pending incidents, source findings."""
    def reason(origin: Column, kind: Column, text: Column) -> Column:
        return F.struct(origin.alias("origen"), kind.alias("tipo"), text.alias("descripcion"))

    found = F.transform("extraccion.inconsistencias", lambda h: reason(
        h["origen"], F.lit("inconsistencia_en_extraccion"), h["descripcion"]))
    pending = F.transform(
        F.filter("incidencias", lambda i: i["estado"] == "pendiente_revision"),
        lambda i: reason(F.lit("validador_extraccion"), i["tipo"], i["detalle"]))
    own = verified.select(
        F.col("extraccion.conversacion_id").alias("conversacion_id"),
        F.inline(F.concat(found, pending)))
    source = source_findings.select(
        "conversacion_id", F.lit("regla_local_sobre_fuente").alias("origen"), "tipo",
        "descripcion")
    return own.unionByName(source)


def pending_amounts(verified: DataFrame) -> DataFrame:
    """Amounts left unknown because the client contradicted themselves."""
    return verified.select(
        F.col("extraccion.conversacion_id").alias("conversacion_id"),
        F.inline("extraccion.inconsistencias")
    ).where((F.col("origen") == "regla_local") & F.col("campo").startswith("dinero.")).select(
        "conversacion_id", "campo", F.lit(None).cast("double").alias("valor_final"),
        F.col("descripcion").alias("motivo"), F.col("evidencias").alias("declaraciones"))


def amount_audit(verified: DataFrame) -> DataFrame:
    """Amounts read again from the messages by a simpler rule, against the extracted ones.

    Contradictory statements of one field expect an unknown amount.
    """
    m = verified.select(
        F.col("extraccion.conversacion_id").alias("conversacion_id"),
        F.col("extraccion.dinero").alias("_d"), F.posexplode("mensajes").alias("_p", "_m")
    ).where(F.col("_m.emisor") == "cliente").withColumn("s", ascii_fold("_m.texto"))
    s = F.col("s")
    kind = F.when(s.startswith(V.CASH_READY_PREFIX), "presupuesto_total").when(
        s.contains("inicial") & s.contains("tengo"), "cuota_inicial")
    raw = F.regexp_extract_all(
        s, F.lit(r"\d+(?:[.,]\d+)*\s*(?:millonzitos|millones|palos|mil)?"), F.lit(0))
    zero = s.isin("no tengo inicial", "no tengo con que dar la inicial ahora")
    text = F.trim(F.get("raw", F.lit(0)))
    number = F.replace(F.replace(F.regexp_extract(text, r"^[\d.,]+", 0), F.lit("."), F.lit("")),
                       F.lit(","), F.lit("."))
    factor = F.when(text.rlike("millonzitos|millones|palos"), 1000000).when(
        text.contains("mil"), 1000).otherwise(1)
    read = m.withColumns({"campo": kind, "raw": raw, "zero": zero}).where(
        F.col("campo").isNotNull() & (zero | (F.size("raw") == 1)))
    read = read.withColumn("esperado", F.when(F.col("zero"), 0.0).otherwise(
        (number.try_cast("decimal(30,2)") * factor.cast("decimal(7,0)")).cast("double")))
    got = F.when(F.col("campo") == "cuota_inicial", F.col("_d.cuota_inicial.valor")).otherwise(
        F.col("_d.presupuesto_total.valor"))
    grouped = read.withColumn("obtenido", got).groupBy("conversacion_id", "campo").agg(
        F.countDistinct("esperado").alias("_n"), F.max("esperado").alias("_e"),
        F.max("obtenido").alias("obtenido"))
    expected = F.when(F.col("_n") == 1, F.col("_e"))
    return grouped.select(
        "conversacion_id", "campo", expected.alias("esperado"), "obtenido",
        expected.eqNullSafe(F.col("obtenido")).alias("cumple"))


def evaluate_paths(payloads: DataFrame, payload: str, checks: DataFrame, key: str,
                   paths: list[str]) -> DataFrame:
    """Expected against obtained value per JSON path of the pilot checks."""
    read = F.when(F.lit(False), F.lit(None).cast("string"))
    for p in paths:
        read = read.when(F.col("campo") == p, F.get_json_object(payload, f"$.{p}"))
    joined = checks.join(payloads, key, "left").withColumn("obtenido", read)
    return joined.withColumn("cumple", F.col("obtenido").eqNullSafe(F.col("esperado"))).drop(payload)
