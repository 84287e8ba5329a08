"""Change logs: applied together, refused when outdated, without effect when repeated."""

import glob
import tempfile
import time
from datetime import datetime
from itertools import groupby

from pyspark.sql import functions as F

from leadloom.operators import capture, changes

KEYS = {"a": ["k"], "b": ["k", "p"]}
A, B = "k string, v long", "k string, p int, w double"


def _plan(plan, stored):
    return changes.plan_changes(plan, stored, KEYS, {n: F.col("k") for n in KEYS})


def _states(decisions):
    return {r["unidad"]: r["estado"] for r in decisions.collect()}


def _rows(df):
    return {tuple(r) for r in df.collect()}


def test_units_are_applied_together_or_not_at_all(spark):
    stored = {"a": spark.createDataFrame([("x", 1), ("y", 1), ("z", 1)], A)}
    plan = {"a": spark.createDataFrame([("x", 2), ("y", 2), ("n", 1)], A),
            "b": spark.createDataFrame([("x", 1, 0.5), ("x", 2, None), ("y", 1, 0.5), ("n", None, 1.5)], B)}
    batch = _plan(plan, stored)
    assert {r["clave"]: (r["antes"], r["despues"]) for r in batch.log.where("tabla = 'a'").collect()}['{"k":"x"}'] == (
        '{"k":"x","v":1}', '{"k":"x","v":2}')
    # y moves on before the batch is applied
    later = {"a": spark.createDataFrame([("x", 1), ("y", 7), ("z", 1)], A)}
    after, decisions = changes.apply_changes(batch, later)
    assert _states(decisions) == {"x": "aplicada", "y": "obsoleta", "n": "aplicada"}
    assert _rows(after["a"]) == {("x", 2), ("y", 7), ("z", 1), ("n", 1)}
    assert _rows(after["b"]) == {("x", 1, 0.5), ("x", 2, None), ("n", None, 1.5)}
    again, decisions = changes.apply_changes(batch, after)
    assert _states(decisions) == {"x": "repetida", "y": "obsoleta", "n": "repetida"}
    assert _rows(again["a"]) == _rows(after["a"]) and _rows(again["b"]) == _rows(after["b"])


def test_a_partly_applied_unit_is_completed(spark):
    stored = {"a": spark.createDataFrame([("x", 1)], A), "b": spark.createDataFrame([], B)}
    plan = {"a": spark.createDataFrame([("x", 2)], A), "b": spark.createDataFrame([("x", 1, 0.5)], B)}
    batch = _plan(plan, stored)
    half = {"a": plan["a"], "b": stored["b"]}
    after, decisions = changes.apply_changes(batch, half)
    assert _states(decisions) == {"x": "aplicada"} and _rows(after["b"]) == {("x", 1, 0.5)}


def test_rows_written_twice_null_keys_other_columns_and_empty_batches(spark):
    stored = {"a": spark.createDataFrame([(None, 1, "stays"), ("y", 1, "too")], A + ", extra string")}
    plan = {"a": spark.createDataFrame([(None, 2), ("y", 2), ("y", 3)], A)}
    batch = _plan(plan, stored)
    after, decisions = changes.apply_changes(batch, stored)
    assert _states(decisions) == {None: "sin_unidad", "y": "ambigua"}
    assert _rows(after["a"]) == _rows(stored["a"]) and after["a"].columns == ["k", "v", "extra"]
    keyed = changes.plan_changes({"a": plan["a"].limit(1)}, stored, KEYS, {"a": F.lit("u")})
    after, decisions = changes.apply_changes(keyed, stored)
    assert _rows(after["a"]) == {(None, 2, "stays"), ("y", 1, "too")}
    none = _plan({"a": plan["a"].limit(0)}, stored)
    same, decisions = changes.apply_changes(none, stored)
    assert decisions.count() == 0 and _rows(same["a"]) == _rows(stored["a"])


def test_log_is_written_compressed_and_tables_that_are_not_there_meet_nothing(spark):
    """Repeated keys are told on keys, rows are compared by digest, and the fewer units choose the rows."""
    stored = {"a": spark.createDataFrame([("x", 1), ("y", 1)], A)}
    plan = {"a": spark.createDataFrame([("x", 2), ("y", 2), ("y", 3), (None, 1)], A),
            "b": spark.createDataFrame([("x", 1, 0.5), ("n", 1, 0.5), ("m", 1, 0.5)], B)}
    batch = _plan(plan, stored)
    assert any(f.endswith(".zstd.parquet") for f in batch.log.inputFiles())
    assert {(r["clave"], r["veces"]) for r in batch.log.where("tabla = 'a'").collect()} == {
        ('{"k":"x"}', 1), ('{"k":"y"}', 2), ('{"k":null}', 1)}
    after, decisions = changes.apply_changes(batch, stored)
    assert _states(decisions) == {"x": "aplicada", "y": "ambigua", "n": "aplicada", "m": "aplicada", None: "sin_unidad"}
    assert _rows(after["a"]) == {("x", 2), ("y", 1)}
    assert _rows(after["b"]) == {("x", 1, 0.5), ("n", 1, 0.5), ("m", 1, 0.5)}
    plan_text = changes.judge(batch, stored)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in plan_text
    again, decisions = changes.apply_changes(batch, after)
    assert _states(decisions) == {"x": "repetida", "y": "ambigua", "n": "repetida", "m": "repetida", None: "sin_unidad"}
    assert _rows(again["a"]) == _rows(after["a"]) and _rows(again["b"]) == _rows(after["b"])


def test_rows_made_together_stand_together(spark):
    """One pass makes the rows of several tables, a null struct is no row, and tables that are there are met one by one."""
    frame = spark.createDataFrame([("x", 1, True), ("y", 2, False), ("z", 3, True), ("z", 4, True)], "k string, v long, more boolean")
    rows = {"b": F.when(F.col("more"), F.struct("k", F.col("v").cast("int").alias("p"), F.lit(0.5).alias("w"))), "a": F.struct("k", "v"),
            "c": F.struct("k", "v")}
    keys = {**KEYS, "c": ["v"]}
    stored = {"a": spark.createDataFrame([("x", 0), ("y", 0)], A)}
    batch = changes.plan_changes({}, stored, keys, {}, together=[changes.Together(frame.coalesce(1), rows, F.col("k"))])
    log = [(r["tabla"], r["unidad"], r["clave"], r["antes"], r["despues"], r["veces"]) for r in batch.log.collect()]
    assert [(t, u) for t, u, *_ in log if t != "a"] == [("b", "x"), ("c", "x"), ("c", "y"), ("b", "z"), ("c", "z"), ("b", "z"), ("c", "z")]
    assert ("b", "x", '{"k":"x","p":1}', None, '{"k":"x","p":1,"w":0.5}', 1) in log
    assert ("a", "x", '{"k":"x"}', '{"k":"x","v":0}', '{"k":"x","v":1}', 1) in log and ("a", "z", '{"k":"z"}', None, '{"k":"z","v":4}', 2) in log
    after, decisions = changes.apply_changes(batch, {"a": spark.createDataFrame([("x", 0), ("y", 5)], A)})
    assert _states(decisions) == {"x": "aplicada", "y": "obsoleta", "z": "ambigua"}
    assert {r["unidad"]: r["cambios"] for r in decisions.collect()} == {"x": 3, "y": 2, "z": 6}
    assert _states(changes.judge(batch, after)) == {"x": "repetida", "y": "obsoleta", "z": "ambigua"}
    assert _rows(after["a"]) == {("x", 1), ("y", 5)} and _rows(after["b"]) == {("x", 1, 0.5)} and _rows(after["c"]) == {("x", 1)}
    again, _ = changes.apply_changes(batch, after)
    assert all(again[n] is after[n] for n in after)


def test_shuffle_files_go_with_the_job_that_wrote_them(spark):
    place = spark.conf.get("spark.local.dir", tempfile.gettempdir())

    def files():
        return set(glob.glob(f"{place}/**/shuffle_*.data", recursive=True))

    before, setting = files(), spark.conf.get(changes.CLEANUP, None)
    assert changes.written(spark.range(1000).groupBy(F.col("id") % 100).count(), "test").count() == 100
    counted = {f for f in files() - before}
    for _ in range(50):
        counted = files() - before
        if len(counted) <= 4:  # those of the count above
            break
        time.sleep(0.2)
    assert len(counted) <= 4 and spark.conf.get(changes.CLEANUP, None) == setting


def _as_planned(batch, plan):
    """The log's rows of each table are those of the plan."""
    for n, shape in batch.shapes.items():
        got = batch.log.where(F.col("tabla") == n).select(F.from_json("despues", shape).alias("r")).select("r.*")
        assert sorted(map(str, got.collect())) == sorted(map(str, plan[n].select(got.columns).collect())), n


def _side_by_side(batch):
    units = [r["unidad"] for r in batch.log.where("tabla NOT IN ('prioridades_publicadas', 'intereses_modelo')").collect()]
    assert len(units) > len(set(units)) == len(list(groupby(units)))


def test_the_rows_of_captures_stand_side_by_side_by_lead(spark):
    at = datetime(2026, 1, 2, 9)
    schema = ("solicitud_id string, empresa_id string, actor string, nombre_limpio string, telefono_valido string, correo_valido string, "
              "sede_id string, modelo_sku string, cuota_inicial double, forma_pago string, cliente_pidio_cita boolean, registrada_en timestamp, "
              "lead_existente string")
    rows = [(f"r{i}", "E", "u", "Ana", "+57", None, "S", "K1", float(i % 2), "contado", i % 3 == 0, at, f"L{i % 5}" if i % 4 else None) for i in range(40)]
    requests = spark.createDataFrame(rows, schema).repartition(7, "solicitud_id")
    states = spark.createDataFrame([("E", "L1", 4)], "empresa_id string, lead_consolidado_id string, revision_entrada long")
    batch = capture.intake_changes(requests, states, {})
    _as_planned(batch, capture.plan_intake(requests, states))
    _side_by_side(batch)


def test_the_rows_of_results_stand_side_by_side_by_lead(spark):
    schema = ("trabajo_id string, empresa_id string, lead_consolidado_id string, lead_id_origen string, conversacion_id string, "
              "revision_entrada long, modelos_interes array<string>, cuota_inicial double, inicial_minimo double, inicial_evidencias int, "
              "forma_pago string, cliente_pidio_cita boolean")
    rows = [(f"t{i}", "E", f"L{i % 5}", f"C{i}", f"V{i}", 1 + (i % 7 == 0), ["AKT 125", "otra"][: i % 3], None, 2e6, 1, "credito", True) for i in range(40)]
    results = spark.createDataFrame(rows, schema).repartition(7, "trabajo_id")
    states = spark.createDataFrame([("E", f"L{i}", 1) for i in range(5)], "empresa_id string, lead_consolidado_id string, revision_entrada long")
    catalogue = spark.createDataFrame([("K1", "AKT", "125")], "sku string, marca string, linea string")
    batch, stale = capture.publication_changes(results, catalogue, states, {})
    plan = capture.publish_extractions(results, catalogue, states)
    last = plan["prioridades_publicadas"].groupBy("lead_consolidado_id").agg(F.max("priorizacion_id").alias("priorizacion_id"))
    plan["prioridades_publicadas"] = plan["prioridades_publicadas"].join(last, ["lead_consolidado_id", "priorizacion_id"], "left_semi")
    _as_planned(batch, plan)
    _side_by_side(batch)
    assert sorted(r["trabajo_id"] for r in stale.collect()) == sorted(f"t{i}" for i in range(0, 40, 7))
