"""Operators against brute force and golden rows."""

import itertools
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadloom.operators import (
    assignment, checks, extraction, identity, intake, merge, profile, ranking, scope, star,
)
from leadloom.operators.ranking import Key
from test_functions import reference_compatible


def test_positions_equal_a_plain_window(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([None, 1.0, 2.0]), rng.choice([None, "x", "y"]), i)
            for i in range(500)]
    df = spark.createDataFrame(rows, "g string, s double, d string, id long")
    order = [Key("s", desc=True, nulls_last=True), Key("d"), Key("id")]
    got = ranking.with_positions(df, ["g"], order, order[:1], [order[1], Key(F.floor(F.col("id") / 9))])
    plain = F.row_number().over(W.partitionBy("g").orderBy(*[k.sort() for k in order]))
    assert got.withColumn("w", plain).where("w <> posicion").count() == 0
    assert got.count() == 500


def test_running_values_cross_chunks(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.choice([None, i])) for k in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = ranking.with_running(
        df, ["k"], ["i"], F.floor(F.col("i") / 7),
        {"p": ranking.Running("last", F.col("v")), "n": ranking.Running("next", F.col("v")),
         "s": ranking.Running("sum", F.col("v")), "m": ranking.Running("max", F.col("v"))})
    w = W.partitionBy("k").orderBy("i")
    before, after = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(1, W.unboundedFollowing)
    want = got.select(
        "*", F.last("v", True).over(before).alias("p2"), F.first("v", True).over(after).alias("n2"),
        F.coalesce(F.sum("v").over(before), F.lit(0)).alias("s2"), F.max("v").over(before).alias("m2"))
    bad = want.where("NOT (p <=> p2 AND n <=> n2 AND s = s2 AND m <=> m2)")
    assert bad.count() == 0


def test_provable_latest(spark):
    rows = [
        ("a", 1, "2026-08-01", False), ("a", 2, "2026-08-01 10:00:00", True),
        ("b", 3, "2026-08-01", False), ("b", 4, "2026-08-02 10:00:00", True),
        ("c", 5, None, False), ("c", 6, "2026-08-02 10:00:00", True),
        ("d", 7, "2026-08-02 10:00:00", True), ("d", 8, "2026-08-02 10:00:00", True),
    ]
    df = spark.createDataFrame(rows, "k string, id long, f string, h boolean").withColumn(
        "f", F.col("f").cast("timestamp_ntz"))
    got = {r["k"]: (r["id"], r["motivo"]) for r in
           ranking.provable_latest(df, ["k"], "f", "h", "id").collect()}
    assert got == {"a": (None, "orden_intradia_desconocido"), "b": (4, None),
                   "c": (None, "fecha_invalida"), "d": (None, "empate_fecha")}


def test_all_pairs_without_pairs(spark):
    rng = random.Random(11)
    words = ["jose", "j.", "ana", "maria", "perez", "ruiz", "r", "lopez"]
    rows, groups = [], {}
    for g in range(150):
        names = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(rng.randint(2, 4))]
        if g % 3 == 0:
            base = ["jose", "maria", "perez", "ruiz"]
            names = [" ".join(base), "jose perez ruiz", rng.choice(["j. ruiz", "jose perez"])]
        if g % 7 == 0:
            names.append(names[0])
        groups[g] = names
        rows += [(g, n) for n in names]
    df = spark.createDataFrame(rows, "g int, nombre string")
    got = {r["g"]: r["compatibles"] for r in
           identity.compatible_groups(df, ["g"], "nombre").collect()}
    for g, names in groups.items():
        want = all(reference_compatible(a, b) for a, b in itertools.combinations(names, 2))
        assert got[g] == want, names
    assert len(set(got.values())) == 2


def test_identity_stays_inside_the_company(spark):
    rows = [(1, "C1", "A", "+573001112233", "José Pérez"), (2, "C2", "A", "+573001112233", "J. Pérez"),
            (3, "C3", "B", "+573001112233", "José Pérez"), (4, "C4", "A", None, "José Pérez")]
    df = spark.createDataFrame(
        rows, "fila long, lead_id string, empresa_id string, telefono string, nombre string")
    got = {r["fila"]: r["lead_consolidado_id"] for r in identity.resolve_identities(df).collect()}
    assert got[1] == got[2] and len({got[1], got[3], got[4]}) == 3


def reconcile(spark, company="A", name="José Pérez", batch="FUENTE-1"):
    leads = "lead_consolidado_id string, empresa_id string, nombre_presentacion string"
    inquiries = ("lead_id_origen string, lead_consolidado_id string, empresa_id string, "
                 "telefono string")
    base_l = spark.createDataFrame([("WEB-1", "A", "José Pérez")], leads)
    base_q = spark.createDataFrame([("MANUAL-1", "WEB-1", "A", "+573001234567")], inquiries)
    new_l = spark.createDataFrame([(batch, company, name)], leads)
    new_q = spark.createDataFrame([("FUENTE-C1", batch, company, "+573001234567")], inquiries)
    mapping, violations = identity.reconcile_identities(base_l, base_q, new_l, new_q)
    return {r["lead_consolidado_id"]: r["destino"] for r in mapping.collect()}, [
        r["regla"] for r in violations.collect()]


def test_reconcile_identities(spark):
    assert reconcile(spark) == ({"FUENTE-1": "WEB-1"}, [])
    assert reconcile(spark, company="B") == ({"FUENTE-1": "FUENTE-1"}, [])
    assert reconcile(spark, name="Otra Persona")[1] == ["identidad_ambigua"]


def test_sla(spark):
    now = datetime(2026, 1, 3)
    rows = [(datetime(2026, 1, 1), datetime(2026, 1, 2), False),
            (datetime(2026, 1, 1), datetime(2026, 1, 2, 0, 0, 1), False),
            (datetime(2026, 1, 2, 12), None, False), (None, None, False),
            (datetime(2026, 1, 1), None, True)]
    df = spark.createDataFrame(rows, "i timestamp, c timestamp, x boolean").withColumn(
        "clase", profile.sla_class(F.col("i"), F.col("c"), F.col("x"), F.lit(now)))
    r = profile.sla_summary(df).first()
    assert (r["denominador"], r["porcentaje"], r["en_plazo"], r["no_medibles"]) == (2, 50.0, 1, 2)


def greedy(candidates, members, done, now):
    """Plain sequential restatement of the daily assignment."""
    load = {m["asesor_id"]: m["carga"] for m in members}
    last = {m["membresia_id"]: m["ultima_posicion"] for m in members}
    out, pending = {}, {}
    far = datetime(9999, 1, 1)

    def order(c):
        due = c["proxima_accion_en"]
        return (due if due and due <= now else far, -c["score"], c["fecha"] or far.date(),
                c["lead_consolidado_id"])

    for c in sorted(candidates, key=order):
        lead = c["lead_consolidado_id"]
        if lead in done:
            continue
        why = None
        if c["cola"].startswith("revision"):
            why = "revision"
        elif not c["punto_venta_id"]:
            why = "sin_sede_verificable"
        elif c["estado"] and (c["estado"] != "abierto" or c["requiere_revision"]):
            why = "estado_no_elegible"
        elif c["estado"] and c["proxima_accion_en"] and c["proxima_accion_en"] > now:
            why = "seguimiento_futuro"
        if why is None:
            options = [
                (-((m["capacidad"] or 0) - load[m["asesor_id"]]), m["membresia_id"], m["asesor_id"])
                for m in members
                if m["punto_venta_id"] == c["punto_venta_id"]
                and (m["capacidad"] or 0) > load[m["asesor_id"]]
                and c["responsable"] in (None, m["membresia_id"])]
            if options:
                _, member, advisor = min(options)
                load[advisor] += 1
                last[member] += 1
                out[lead] = (member, last[member])
                continue
            why = "sin_cupo_o_asesor"
        pending[why] = pending.get(why, 0) + 1
    return out, pending


def test_assignment_equals_greedy(spark):
    rng = random.Random(2)
    now = datetime(2026, 1, 10, 12)
    cand = [dict(
        empresa_id="E", lead_consolidado_id=f"LC-{rng.getrandbits(40):010x}",
        cola=rng.choice(["seguimiento_comercial", "revision_datos", "primer_contacto"]),
        score=rng.choice([0.0, 11.11, 44.44, 100.0]),
        fecha=rng.choice([None, (now - timedelta(days=rng.randint(1, 60))).date()]),
        punto_venta_id=rng.choice(["S1", "S1", "S2", None]),
        estado=rng.choice([None, "abierto", "abierto", "cerrado"]),
        requiere_revision=rng.random() < 0.1,
        proxima_accion_en=rng.choice([None, None, now - timedelta(hours=rng.randint(1, 99)),
                                      now + timedelta(hours=5)]),
        responsable=rng.choice([None, None, None, 1, 2, 5])) for _ in range(250)]
    members = [dict(membresia_id=i, empresa_id="E", asesor_id=f"A{min(i, 4)}",
                    punto_venta_id="S1" if i < 4 else "S2", capacidad=c, carga=l, ultima_posicion=p)
               for i, c, l, p in [(1, 9, 2, 5), (2, 7, 0, 0), (3, None, 0, 0), (4, 12, 3, 1),
                                  (5, 12, 3, 0)]]
    done = {c["lead_consolidado_id"] for c in cand[:10]}
    cdf = spark.createDataFrame(
        [tuple(c.values()) for c in cand],
        "empresa_id string, lead_consolidado_id string, cola string, score double, fecha date, "
        "punto_venta_id string, estado string, requiere_revision boolean, "
        "proxima_accion_en timestamp, responsable long")
    mdf = spark.createDataFrame(
        [tuple(m.values()) for m in members],
        "membresia_id long, empresa_id string, asesor_id string, punto_venta_id string, "
        "capacidad long, carga long, ultima_posicion long")
    already = spark.createDataFrame([("E", x) for x in done],
                                    "empresa_id string, lead_consolidado_id string")
    assigned, pending = assignment.daily_assignment(cdf, mdf, already, F.lit(now))
    want, why = greedy(cand, members, done, now)
    got = {r["lead_consolidado_id"]: (r["membresia_id"], r["posicion_inicial"])
           for r in assigned.collect()}
    assert got == want and len(want) > 15
    counted = {r["motivo"]: r["leads"] for r in assignment.pending_by_reason(pending).collect()}
    assert counted == why


def test_transfer(spark):
    states = spark.createDataFrame(
        [("E", "L1", 1, "S"), ("E", "L2", 1, "S"), ("E", "L3", 1, "S"), ("E", "L4", 1, "X")],
        "empresa_id string, lead_consolidado_id string, responsable long, punto_venta_id string")
    members = spark.createDataFrame(
        [(1, "E", "asesor", True, "A1", "S", 5), (2, "E", "asesor", True, "A2", "S", 3)],
        "membresia_id long, empresa_id string, rol string, activa boolean, asesor_id string, "
        "punto_venta_id string, capacidad long")
    plan = spark.createDataFrame(
        [("E", "L1", 1, "pendiente", 1), ("E", "L2", 1, "completada", 2),
         ("E", "L3", 1, "pendiente", 3), ("E", "K1", 2, "pendiente", 1),
         ("E", "K2", 2, "pendiente", 2)],
        "empresa_id string, lead_consolidado_id string, membresia_id long, estado string, "
        "posicion_inicial long")
    req = spark.createDataFrame(
        [(1, "E", "L1", 2), (2, "E", "L2", 2), (3, "E", "L3", 2), (4, "E", "L4", 2)],
        "solicitud_id long, empresa_id string, lead_consolidado_id string, destino long")
    decisions, after = assignment.transfer_owners(req, states, members, plan)
    got = {r["lead_consolidado_id"]: (r["decision"], r["posicion_inicial"])
           for r in decisions.collect()}
    assert got == {"L1": ("transferido", 3), "L2": ("transferido", None), "L3": ("sin_cupo", None),
                   "L4": ("sede_distinta", None)}
    rows = {r["lead_consolidado_id"]: (r["membresia_id"], r["posicion_inicial"])
            for r in after.collect()}
    assert rows["L1"] == (2, 3) and rows["L2"] == (1, 2) and rows["L3"] == (1, 3)


def _transfers_in_order(requests, states, members, plan):
    """The rules of one transfer, request after request."""
    owner = {(e, x): (r, site) for e, x, r, site in states}
    member = {m[0]: m for m in members}
    today = {(e, x): [m, st, pos] for e, x, m, st, pos in plan}
    out = {}
    for rid, e, x, to in sorted(requests):
        who = member.get(to)
        before, site = owner.get((e, x), (None, None))
        pos = None
        if who is None or who[1] != e or who[2] != "asesor" or not who[3]:
            why = "responsable_invalido"
        elif before == to:
            why = "sin_cambio"
        elif who[4] is None:
            why = "sin_asesor_operativo"
        elif not site:
            why = "sin_sede_verificable"
        elif who[5] != site:
            why = "sede_distinta"
        else:
            why, now = "transferido", today.get((e, x))
            if now is not None and now[1] != "completada" and now[0] != to:
                load = sum(member[m][4] == who[4] for m, _, _ in today.values())
                if load >= (who[6] or 0):
                    why = "sin_cupo"
                else:
                    pos = 1 + max((p for m, _, p in today.values() if m == to), default=0)
                    now[0], now[2] = to, pos
            if why == "transferido":
                owner[e, x] = (to, site)
        out[rid] = (before, why, pos)
    return out, {k: (m, p) for k, (m, _, p) in today.items()}


@pytest.mark.parametrize("n,leads,in_order", [(10_000, 900, 50_000), (400, 260, 150)])
def test_transfers_see_freed_places(spark, n, leads, in_order):
    rng = random.Random(12)
    members = [(m, f"E{m % 2}", "asesor" if m % 9 else "supervisor", m != 7, None if m == 8 else f"A{m - 2 * (m in (5, 12))}",
                "S" if m % 10 else "T", None if m == 6 else (6 + m % 5) * leads // 260) for m in range(1, 25)]
    members = [(*m[:6], next(x[6] for x in members if x[4] == m[4])) for m in members]
    states, plan, held = [], [], {}
    for x in range(leads):
        e = f"E{x % 2}"
        own = [m[0] for m in members if m[1] == e]
        states.append((e, f"L{x}", rng.choice([None, *own]), rng.choice(["S"] * 9 + ["", None, "T"])))
        if x % 3:
            m = rng.choice(own)
            held[m] = held.get(m, 0) + rng.randint(1, 2)
            plan.append((e, f"L{x}", m, rng.choice(["pendiente"] * 6 + ["completada"]), held[m]))
    requests = [(i, f"E{x % 2}", f"L{x}", rng.randint(1, 26)) for i in range(n) for x in [rng.randrange(leads + 2)]]
    requests = [r if r[3] % 2 == int(r[1][1]) or rng.random() < 0.1 else (*r[:3], r[3] - 1 or 2) for r in requests]
    rng.shuffle(requests)
    frame = spark.createDataFrame
    decisions, after = assignment.transfer_owners(
        frame(requests, "solicitud_id long, empresa_id string, lead_consolidado_id string, destino long"),
        frame(states, "empresa_id string, lead_consolidado_id string, responsable long, punto_venta_id string"),
        frame(members, "membresia_id long, empresa_id string, rol string, activa boolean, asesor_id string, punto_venta_id string, capacidad long"),
        frame(plan, "empresa_id string, lead_consolidado_id string, membresia_id long, estado string, posicion_inicial long"), in_order)
    expected, held = _transfers_in_order(requests, states, members, plan)
    got = {r["solicitud_id"]: (r["anterior"], r["decision"], r["posicion_inicial"]) for r in decisions.collect()}
    assert got == expected
    assert {(r["empresa_id"], r["lead_consolidado_id"]): (r["membresia_id"], r["posicion_inicial"]) for r in after.collect()} == held
    assert {"sin_cupo", "transferido", "sin_cambio"} <= {v[1] for v in expected.values()}


def test_conflict_cycle_keeps_the_review_flag(spark):
    pointers = spark.createDataFrame(
        [("E", "L", "P1", 2, "captura_manual", False, None, None)],
        "empresa_id string, lead_consolidado_id string, priorizacion_id string, "
        "revision_entrada long, origen string, conflicto_lote boolean, propuesta_lote_id string, "
        "revision_antes_conflicto boolean")
    states = spark.createDataFrame(
        [("E", "L", "abierto", 2, "P1", "captura_manual", False)],
        "empresa_id string, lead_consolidado_id string, estado string, revision_entrada long, "
        "priorizacion_vigente_id string, priorizacion_origen string, requiere_revision boolean")
    proposal = spark.createDataFrame(
        [("E", "L", "P2")],
        "empresa_id string, lead_consolidado_id string, priorizacion_id string")
    during = merge.publish_batch(pointers, proposal, states)
    s1 = merge.propagate(states, during)
    assert s1.first()["requiere_revision"] is True
    decision = spark.createDataFrame(
        [("E", "L", "P2", "adoptar", "ok")],
        "empresa_id string, lead_consolidado_id string, propuesta_id string, accion string, "
        "nota string")
    after, audit, rejected = merge.resolve_conflicts(during, decision, decision.limit(0))
    assert rejected.count() == 0 and after.first()["priorizacion_id"] == "P2"
    s2 = merge.propagate(s1, after)
    queues = spark.createDataFrame([("P2", "seguimiento_comercial")],
                                   "priorizacion_id string, cola string")
    s3 = merge.restore_review_flag(s2, during, after, queues)
    assert s3.first()["requiere_revision"] is False
    again, _, late = merge.resolve_conflicts(after, decision, audit)
    assert late.count() == 0 and again.first()["revision_entrada"] == 3


def test_upsert_is_repeatable(spark):
    stored = spark.createDataFrame([(1, "A", 1), (2, "A", 1)], "k int, empresa_id string, v int")
    new = spark.createDataFrame([(2, "B", 9), (3, "B", 9), (1, "A", 5)],
                                "k int, empresa_id string, v int")
    once = merge.upsert(stored, new, ["k"], "empresa_id")
    twice = merge.upsert(once, new, ["k"], "empresa_id")
    assert checks.fingerprint(once).first() == checks.fingerprint(twice).first()
    assert {tuple(r) for r in once.collect()} == {(1, "A", 5), (2, "A", 1), (3, "B", 9)}
    runs = merge.upsert(stored, new, ["k"], insert_only=True)
    assert {tuple(r) for r in runs.collect()} == {(1, "A", 1), (2, "A", 1), (3, "B", 9)}


def test_lookup_rejects_repeated_keys(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="repeated key"):
        checks.lookup(left, right, ["k"]).collect()


def test_contract_stops(spark):
    df = spark.createDataFrame([(1, -1)], "k int, v int")
    with pytest.raises(checks.ContractBroken):
        checks.fail_if_any(checks.expect(df, "negativo", F.col("v") < 0, "k"))


def test_scope_fails_closed(spark):
    df = spark.createDataFrame([("A",)], "empresa_id string")
    for missing in (None, " "):
        with pytest.raises(scope.ScopeError):
            scope.scoped(df, missing)


def test_review_intake(spark):
    rows = [("1", "E", "Ana Ruiz", "300 111 2233", None, 10.0, None, "COP", None, False),
            ("2", "E", " ", None, "x", -1.0, 5.0, None, "contado", True)]
    df = spark.createDataFrame(
        rows, "id string, empresa_id string, nombre_cliente string, telefono string, correo string, "
              "cuota_inicial double, presupuesto double, moneda string, forma_pago string, "
              "cliente_pidio_credito boolean")
    got = {r["id"]: r["violaciones"] for r in intake.check_intake(df).collect()}
    assert got["1"] == []
    assert set(got["2"]) == {"nombre_obligatorio", "correo_invalido", "sin_contacto_utilizable",
                             "cuota_inicial_negativa", "moneda_no_declarada", "contado_y_credito"}


def test_star_is_keyed_and_complete(spark):
    text = "string"
    advisors = spark.createDataFrame(
        [("A1", "E", "S1", "Ana", "5", "SI", "2026-01-02")],
        "asesor_id string, empresa_id string, punto_venta_id string, nombre string, "
        "capacidad_diaria_leads string, activo string, fecha_ingreso string")
    inquiries = spark.createDataFrame(
        [("C1", "L1", "E", "S1", "2026-01-02 10:00:00", "")],
        "lead_id string, lead_consolidado_id string, empresa_id string, punto_venta_id string, "
        "fecha_registro string, fecha_primer_contacto string")
    history = spark.createDataFrame(
        [("H1", "E", "S1", "2026-01-02")],
        "lead_id string, empresa_id string, punto_venta_id string, fecha_registro string")
    catalogue = spark.createDataFrame(
        [("K1", "AKT", "NKD 125", "125", "", "9000000", "3", "S1|S1 ")],
        "sku string, marca string, linea string, cilindraje string, segmento string, "
        "precio_lista string, unidades_disponibles string, puntos_venta_disponibles string")
    chats = spark.createDataFrame(
        [("CONV-1", "E", "2026-01-02", [("cliente", "10:00", "hola"), ("asesor", None, "buenas")])],
        "conversacion_id string, empresa_id string, fecha_inicio string, "
        "mensajes array<struct<emisor:string,hora:string,texto:string>>")
    extractions = spark.createDataFrame(
        [("CONV-1", [("akt nkd 125", [(1, "cliente", "akt nkd 125")])])],
        "conversacion_id string, modelos_interes array<struct<valor:string,"
        "evidencias:array<struct<mensaje:int,emisor:string,texto:string>>>>")
    frames = {
        "asesores": advisors, "consultas_leads": inquiries, "historico_cierres": history,
        "catalogo_motos": catalogue, "conversaciones": chats, "extracciones": extractions,
        "leads": spark.createDataFrame([("L1", "E")], f"lead_consolidado_id {text}, empresa_id {text}"),
        "priorizacion_leads": spark.createDataFrame([("L1",)], f"lead_consolidado_id {text}"),
        "trazabilidad_leads": spark.createDataFrame([(0,)], "fila_origen long"),
        "archivos": spark.createDataFrame([("a.csv", "00")], f"ruta {text}, hash_contenido {text}"),
        "incidencias": spark.createDataFrame([("INC-000001",)], f"incidencia_id {text}"),
        "modelos_ml": spark.createDataFrame([("M1",)], f"modelo_ml_id {text}"),
    }
    tables = star.build_star(frames, "RUN")
    assert len(tables) == 20 and star.star_violations(tables).count() == 0
    assert tables["mensajes"].count() == 2
    assert tables["disponibilidad_modelo"].count() == 1
    interest = tables["intereses_modelo"].first()
    assert (interest["modelo_sku"], interest["estado_identificacion"]) == ("K1", "identificado")
    q = tables["consultas"].first()
    assert (str(q["fecha_registro"]), q["fecha_registro_hora"], q["fecha_primer_contacto"]) == (
        "2026-01-02", "10:00:00", None)
    again = star.build_star(frames, "RUN")
    for name in ("mensajes", "intereses_modelo", "marcas"):
        assert checks.fingerprint(tables[name]).first() == checks.fingerprint(again[name]).first()


def test_pilot_paths(spark):
    p = spark.createDataFrame([("a", '{"x":{"y":"1"}}')], "id string, j string")
    c = spark.createDataFrame([("a", "x.y", "1"), ("a", "x.z", None)],
                              "id string, campo string, esperado string")
    got = extraction.evaluate_paths(p, "j", c, "id", ["x.y", "x.z"]).collect()
    assert all(r["cumple"] for r in got)


def test_quota_fold():
    from leadloom.streaming.timers import admit

    minute = 60 * 1_000_000
    flags, kept = admit([i * 1_000_000 for i in range(12)] + [minute, minute + 1], [])
    assert flags == [True] * 8 + [False] * 4 + [True, False]
    assert len(kept) == 9
    flags, _ = admit([i * minute for i in range(300)], [])
    assert sum(flags) == 240 and isinstance(pd.Series(flags), pd.Series)


def test_sparse_left_join(spark):
    left = spark.createDataFrame(
        [(i, None if i % 3 else i % 5, "x") for i in range(60)], "id int, k int, v string")
    right = spark.createDataFrame([(0, "a"), (3, "b")], "k int, w string")
    got = checks.left_join_sparse(left, right, ["k"])
    want = left.join(right, "k", "left")
    assert checks.fingerprint(got).first() == checks.fingerprint(want.select(got.columns)).first()


def test_null_and_hot_keys_are_spread(spark):
    """A third of the rows under one key, or without a key, must not meet in one bucket."""
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id").cast("string")))
        .alias("g"), (F.col("id") % 7).alias("s"), F.sha2(F.col("id").cast("string"), 256).alias("id"))
    order = [Key("s", desc=True), Key("id")]
    ranked = ranking.with_positions(df, ["g"], order, order[:1], [Key(F.substring("id", 1, 2))])
    assert ranked.where("g = 'hot'").agg(F.max("posicion")).first()[0] == 10000
    # what one window task may see is the rows of one bucket, not the group
    bucket = df.where("g = 'hot'").groupBy("s", F.substring("id", 1, 2)).count()
    assert bucket.agg(F.max("count")).first()[0] < 40


REQUEST = ("solicitud_id string, empresa_id string, actor string, nombre_limpio string, "
           "telefono_valido string, correo_valido string, sede_id string, modelo_sku string, "
           "cuota_inicial double, forma_pago string, cliente_pidio_cita boolean, "
           "registrada_en timestamp, lead_existente string")
STATE = "empresa_id string, lead_consolidado_id string, revision_entrada long"


def test_intake_plan_is_repeatable(spark):
    from leadloom.operators import capture

    at = datetime(2026, 1, 2, 9)
    rows = [("r1", "E", "u", "Ana Ruiz", "+573001112233", None, "S", "K1", 5.0, "contado", False, at, None),
            ("r2", "E", "u", "Ana Ruiz", "+573001112233", None, "S", None, None, None, True, at, "L7"),
            ("r3", "E", "u", "Ana Ruiz", "+573001112233", None, "S", None, None, None, False,
             at + timedelta(hours=1), "L7")]
    requests = spark.createDataFrame(rows, REQUEST)
    states = spark.createDataFrame([("E", "L7", 4)], STATE)
    plan = capture.plan_intake(requests, states)
    assert plan["leads"].count() == 1 and plan["consultas"].count() == 3
    pointers = {r["lead_consolidado_id"]: r for r in plan["prioridades_publicadas"].collect()}
    assert pointers["L7"]["revision_entrada"] == 6
    new = next(k for k in pointers if k.startswith("WEB-"))
    assert pointers[new]["revision_entrada"] == 1
    scores = {r["priorizacion_id"]: (float(r["score_prioridad"]), r["explicacion"])
              for r in plan["priorizaciones"].collect()}
    assert scores[pointers[new]["priorizacion_id"]][0] == 55.56
    assert scores[pointers["L7"]["priorizacion_id"]] == (0.0, "Sin señales declaradas suficientes.")
    again = capture.plan_intake(requests, states)
    for name in ("leads", "consultas", "priorizaciones", "prioridades_publicadas"):
        assert checks.fingerprint(plan[name]).first() == checks.fingerprint(again[name]).first()


def test_review_resolution(spark):
    from leadloom.operators import capture

    reviews = spark.createDataFrame(
        [(f"R{i}", "E", "pendiente", None) for i in range(1, 6)],
        "revision_id string, empresa_id string, estado string, resolucion string")
    schema = "revision_id string, accion string, nota string, lead_id string, actor string"
    decisions = spark.createDataFrame(
        [("R1", "vincular", "", "L7", "s"), ("R2", "rechazar", "duplicado", "", "s"),
         ("R3", "crear_distinto", "otra persona", None, "s"), ("R4", "vincular", "", "L8", "s"),
         ("R5", "rechazar", " ", "", "s"), ("R9", "rechazar", "x", "", "s")], schema)
    states = spark.createDataFrame([("E", "L7", 4), ("F", "L8", 1)], STATE)
    out = capture.resolve_reviews(reviews, decisions, states)
    assert {r["revision_id"]: r["lead_existente"] for r in out["aceptadas"].collect()} == {
        "R1": "L7", "R3": None}
    assert {r["revision_id"]: r["motivo"] for r in out["rechazadas"].collect()} == {
        "R4": "lead_ajeno", "R5": "falta_motivo", "R9": "revision_inexistente"}
    after = out["revisiones"]
    assert {r["revision_id"]: r["estado"] for r in after.collect()} == {
        "R1": "resuelta", "R2": "rechazada", "R3": "resuelta", "R4": "pendiente", "R5": "pendiente"}
    repeat = capture.resolve_reviews(after, decisions.where("revision_id = 'R1'"), states)
    assert repeat["aceptadas"].count() == 0 and repeat["rechazadas"].count() == 0
    other = spark.createDataFrame([("R1", "rechazar", "no", "", "s")], schema)
    refused = capture.resolve_reviews(after, other, states)["rechazadas"].first()
    assert refused["motivo"] == "decision_distinta"


def test_single_chat_publication(spark):
    from leadloom.operators import capture

    results = spark.createDataFrame(
        [("t1", "E", "L7", "C1", "CONV-1", 4, ["AKT NKD 125"], None, 2e6, 1, "credito", True),
         ("t2", "E", "L9", "C2", "CONV-2", 1, ["otra"], 0.0, None, 1, None, None)],
        "trabajo_id string, empresa_id string, lead_consolidado_id string, lead_id_origen string, "
        "conversacion_id string, revision_entrada long, modelos_interes array<string>, "
        "cuota_inicial double, inicial_minimo double, inicial_evidencias int, forma_pago string, "
        "cliente_pidio_cita boolean")
    catalogue = spark.createDataFrame([("K1", "AKT", "NKD 125")],
                                      "sku string, marca string, linea string")
    states = spark.createDataFrame([("E", "L7", 4), ("E", "L9", 2)], STATE)
    out = capture.publish_extractions(results, catalogue, states)
    row = out["priorizaciones"].first()
    assert out["priorizaciones"].count() == 1 and float(row["score_prioridad"]) == 100.0
    assert out["intereses_modelo"].first()["modelo_sku"] == "K1"
    assert [r["trabajo_id"] for r in out["obsoletas"].collect()] == ["t2"]


def test_a_load_happens_once_and_is_checked_every_time(spark):
    from leadloom.operators import merge

    expected = {"t": spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")}
    stored = {"t": spark.createDataFrame([(1, "a")], "k long, v string")}
    calls = []

    def load():
        calls.append(1)
        stored["t"] = expected["t"]

    runs = spark.createDataFrame([("r0", "completada"), ("r1", "fallida")], "ejecucion_id string, estado string")
    done = merge.load_once(runs, "r0", expected, {"t": ["k"]}, load, stored.get)
    assert [(r["tabla"], r["clave"], r["estado"]) for r in done.collect()] == [("t", "2", "ausente")] and not calls
    assert merge.load_once(runs, "r1", expected, {"t": ["k"]}, load, stored.get).count() == 0 and calls == [1]


def test_catalogue_keys_are_dealt_before_they_multiply(spark):
    """Keys of one catalogue row are told apart in the row; the rows of a small file are dealt first."""
    from leadloom.operators import catalog

    rows = [("s1", "Akt", "NKD 125"), ("s1", "Akt", "NKD 125"), ("s2", "Akt", "NKD"), ("s3", None, "solo"),
            ("s4", "uno", None), (None, "x", "y"), ("s5", "dos dos", "dos")]
    df = spark.createDataFrame(rows, "sku string, marca string, linea string")
    keys = catalog.reference_keys(df)
    got = {tuple(r) for r in keys.collect()}
    assert keys.count() == len(got) and not {r for r in got if r[0] is None}
    assert {(r[0], r[4]) for r in got if r[1] == "s1"} == {
        ("akt nkd 125", True), ("nkd 125", True), ("akt", False), ("akt nkd", False), ("nkd", False)}
    assert {(r[0], r[4]) for r in got if r[1] == "s5"} == {
        ("dos dos dos", True), ("dos", True), ("dos dos", False)}
    assert {(r[0], r[4]) for r in got if r[1] is None} == {("x y", True), ("y", True), ("x", False)}
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")  # read from the top: dealt before it is multiplied


def test_a_catalogue_is_not_sent_whole_to_every_executor(spark):
    from leadloom.plans.q_values import wanted_models
    from leadloom.plans.registry import Tables

    plan = wanted_models(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_names_are_found_at_every_place_and_in_every_text(spark):
    from leadloom.operators import catalog

    catalogue = spark.createDataFrame(
        [("a", "Moto", "Ñandú 1"), ("b", "Moto", "Ñandú 12"), ("c", "x", "y"), ("d", "moto", "nandu 1"), ("e", "", None),
         (None, "zeta", "larga larga larga larga larga larga"), ("a", "Moto", "Ñandú 1")],
        "sku string, marca string, linea string")
    texts = [(1, "MOTO ÑANDÚ 12 y otra moto nandu 1"), (1, "moto nandu 1"), (1, "moto nandu 1"), (2, "x yx y"), (3, ""),
             (4, None), (None, "x y"), (5, "zeta larga larga larga larga larga larga"), (6, "oto nandu 12"), (7, "x"),
             (8, "nada\u0000moto nandu 1" * 3)]
    df = spark.createDataFrame(texts, "id int, t string")
    names = [(s, "".join(f"{m} {n}".lower().replace("ñ", "n").replace("ú", "u"))) for s, m, n in
             [("a", "moto", "nandu 1"), ("b", "moto", "nandu 12"), ("c", "x", "y"), ("d", "moto", "nandu 1"),
              (None, "zeta", "larga larga larga larga larga larga")]]
    want = [(i, s) for i, t in texts if i is not None and t is not None
            for s, n in names if n in t.lower().replace("ñ", "n").replace("ú", "u")]
    key = lambda r: (r[0], str(r[1]))
    got = sorted(map(tuple, catalog.names_in_text(df, "id", "t", catalogue.where("sku <> 'e' OR sku IS NULL")).collect()), key=key)
    assert got == sorted(want, key=key)
    once = catalog.names_in_text(df, "id", "t", catalogue.where("sku <> 'e' OR sku IS NULL"), each_row=False)
    assert sorted(map(tuple, once.collect()), key=key) == sorted(set(want), key=key)
    # grams of the texts stay in the tasks that read them
    assert "_seen" not in once.columns and once.columns == ["id", "sku"]


def test_sparse_join_needs_no_columns_that_nobody_asks_for(spark):
    from leadloom.operators.checks import left_join_sparse

    left = spark.createDataFrame([(1, "k", "x"), (2, None, "y"), (3, None, None)], "i int, k string, w string")
    left = left.withColumn("dear", F.upper("w"))
    right = spark.createDataFrame([("k", 5)], "k string, v int")
    out = left_join_sparse(left, right, ["k"], spread=["i"])
    assert sorted((r["i"], r["v"], r["dear"]) for r in out.collect()) == sorted(
        (r["i"], r["v"], r["dear"]) for r in left_join_sparse(left, right, ["k"]).collect())
    assert "upper" not in out.select("i", "v")._jdf.queryExecution().optimizedPlan().toString()


def test_identity_does_not_work_out_other_columns(spark):
    from leadloom.operators import identity

    rows = spark.createDataFrame([("E", "+573", "Ana Ruiz", "1", "a@b.co"), ("E", None, "Ana", "2", None)],
                                 "empresa_id string, telefono string, nombre string, lead_id string, email string")
    out = identity.resolve_identities(rows.withColumn("dear", F.reverse("email")))
    assert "reverse" not in out.select("lead_consolidado_id")._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 2
