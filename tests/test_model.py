"""Baseline models on history derived from the test tables."""

import pytest
from pyspark.sql import functions as F

from leadloom.operators import metrics, model
from leadloom.plans import bindings as B
from leadloom.plans.registry import Tables

COLUMNS = model.PROFILES["comercial"]


@pytest.fixture(scope="module")
def data(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    kept, _ = metrics.observed_outcomes(B.history(t))
    # give the label some signal so that selection has something to find
    rows = metrics.feature_frame(kept, ("lead_id", "fecha", "y")).dropDuplicates(["lead_id"])
    rows = rows.withColumn("y", F.when(
        (F.col("cita_observada") == "SI") & (F.col("canal") == "WhatsApp"), 1).otherwise(F.col("y")))
    return rows.where(F.col("fecha") < "1998-01-01").cache()


def test_unseen_category_is_the_empty_vector(spark, data):
    fitted = model.fit(data, model.Candidate("comercial", "logistica", 1.0))
    odd = data.limit(1).select("lead_id", *[F.lit("NUNCA").alias(c) for c in COLUMNS])
    vector = fitted.transform(odd).select("features").first()["features"]
    assert vector.numNonzeros() == 0 and vector.size == len(model.feature_names(fitted, COLUMNS))
    seen = model.unseen_categories(data, odd, COLUMNS, "lead_id")
    assert seen.count() == len(COLUMNS)


def test_logit_contributions_add_up(spark, data):
    fitted = model.fit(data, model.Candidate("comercial", "logistica", 1.0))
    table = model.coefficients(fitted, COLUMNS, spark)
    base = table.where("caracteristica = 'intercepto'").first()["coeficiente"]
    parts = model.logit_contributions(data, table, COLUMNS, "lead_id").groupBy("lead_id").agg(
        F.sum("aporte").alias("s"))
    scored = model.score(fitted, data.select("lead_id", *COLUMNS)).join(parts, "lead_id")
    gap = scored.select(F.max(F.abs(
        F.col("score") - 1 / (1 + F.exp(-(F.col("s") + base)))))).first()[0]
    assert gap < 1e-9
    hundred = model.experimental_score(fitted, data).agg(
        F.min("score_modelo_experimental"), F.max("score_modelo_experimental")).first()
    assert 0 <= hundred[0] <= hundred[1] <= 100


def test_tree_paths(spark, data):
    fitted = model.fit(data, model.Candidate("comercial", "arbol", 2))
    rules = model.tree_rules(fitted, COLUMNS, spark)
    paths = model.tree_paths(fitted, data, COLUMNS, "lead_id")
    counts = {r["hoja"]: r["count"] for r in paths.groupBy("hoja").count().collect()}
    assert counts == {r["hoja"]: r["ejemplos"] for r in rules.collect()}
    assert all(r["ejemplos"] >= 40 for r in rules.collect())


def test_selection_and_intervals(spark, data):
    cut = [("r1", "1992-01-01", "1996-01-01", "1997-01-01")]
    rounds = metrics.month_rounds(data, "fecha", cut)
    candidates = [model.Candidate("ingreso", "logistica", 1.0),
                  model.Candidate("comercial", "logistica", 1.0),
                  model.Candidate("comercial", "arbol", 2, "balanced")]
    per_round, best = model.select_candidates(rounds, candidates)
    picked = {r["regimen"]: r["candidato"] for r in best.collect()}
    assert picked == {"sin_pesos": "comercial_logistica_1.0_sin_pesos",
                      "balanced": "comercial_arbol_2_balanced"}
    assert per_round.count() == 3
    assert len(model.grid()) == 20
    fitted = model.fit(data, candidates[1])
    scored = model.score(fitted, data).withColumn("fijo", F.lit(0.0))
    interval = {r["medida"]: r for r in model.bootstrap_interval(
        scored, "y", "score", "fijo", repetitions=40).collect()}
    ap = interval["AP"]
    assert 0 < ap["limite_inferior_95"] <= ap["mediana"] <= ap["limite_superior_95"]


def test_cells_choose_as_rows_do(spark, data):
    """Fitted on counted cells, a candidate scores and ranks as one fitted on the rows."""
    cut = [("r1", "1992-01-01", "1996-01-01", "1997-01-01"), ("r2", "1992-01-01", "1996-06-01", "1997-06-01")]
    rounds = metrics.month_rounds(data, "fecha", cut)
    candidates = [model.Candidate("ingreso", "logistica", 0.1), model.Candidate("comercial", "logistica", 1.0, "balanced"),
                  model.Candidate("comercial", "arbol", 3)]
    per_round, _ = model.select_candidates(rounds, candidates)
    got = {(r["orden"], r["ronda"]): r for r in per_round.collect()}
    assert len(got) == 6
    for order, candidate in enumerate(candidates):
        for name in ("r1", "r2"):
            here = rounds.where(F.col("ronda") == name)
            fitted = model.fit(here.where("uso = 'entrenamiento'"), candidate)
            plain = model.evaluate(model.score(fitted, here.where("uso = 'validacion'"))).first()
            for column in ("ap", "auc", "k", "precision_top", "brier", "vp", "fp", "fn", "vn"):
                assert got[order, name][column] == pytest.approx(plain[column], abs=2e-4), (candidate.name, column)


def test_no_task_counts_the_cells_of_many_partitions(spark, data, monkeypatch):
    """The cells of a fit stand in one task, which reads them counted and counts none itself."""
    plans, fitted = [], model._fitted_classifier

    def watched(candidate, encoded, per_class):
        plans.append((encoded._jdf.queryExecution().optimizedPlan().toString(), encoded.select(F.spark_partition_id()).distinct().count()))
        return fitted(candidate, encoded, per_class)

    monkeypatch.setattr(model, "_fitted_classifier", watched)
    rounds = metrics.month_rounds(data, "fecha", [("r1", "1992-01-01", "1996-01-01", "1997-01-01")])
    model.score_grid(rounds, [model.Candidate("comercial", "arbol", 2)])
    assert [n for _, n in plans] == [1] and not any("Coalesce" in plan for plan, _ in plans)


def test_a_round_without_training_rows_is_an_error(spark, data):
    empty = metrics.month_rounds(data, "fecha", [("r1", "1980-01-01", "1981-01-01", "1997-01-01")])
    with pytest.raises(ValueError, match="r1"):
        model.score_grid(empty, [model.Candidate("ingreso", "logistica", 1.0)])


def test_the_grid_runs_every_round_on_all_rows_before_it(spark, monkeypatch):
    """One labelled row a month: no round is left out, nor a month before its validation."""
    from leadloom.plans import q_streams

    schema = ("lead_id string, empresa_id string, fecha date, desenlace string, canal string, modelo_sku string, "
              "manifesto_cuota_inicial string, forma_pago_declarada string, pidio_cita string")
    rows = [(f"H-{i}", "EMP-1", f"{1995 + i // 12}-{1 + i % 12:02d}-15", "Cerrado" if i % 2 else "Perdido", *["SI"] * 5) for i in range(60)]
    history = spark.createDataFrame([(*r[:2], None, *r[3:]) for r in rows[:1]], schema).unionByName(
        spark.createDataFrame(rows, schema.replace("fecha date", "fecha string")).withColumn("fecha", F.col("fecha").cast("date")))
    seen = []
    monkeypatch.setattr(q_streams.B, "history", lambda t: history)
    monkeypatch.setattr(q_streams.model, "select_candidates", lambda rounds, candidates: (seen.append((rounds, candidates)), None))
    q_streams.k8_grid(None)
    rounds, candidates = seen[0]
    counted = {(r["ronda"], r["uso"]): r["count"] for r in rounds.groupBy("ronda", "uso").count().collect()}
    assert counted == {("abril", "entrenamiento"): 39, ("abril", "validacion"): 1, ("mayo", "entrenamiento"): 40, ("mayo", "validacion"): 1,
                       ("junio", "entrenamiento"): 41, ("junio", "validacion"): 1}
    assert candidates == model.grid()


def test_draws_follow_the_law(spark):
    """Mean and variance of Poisson(n), and the share of zeros, over many cells."""
    for n in (1, 3, 64, 65, 4_000):
        draws = spark.range(4_000).select(model.poisson_draw(F.lit(n), F.concat(F.lit(f"{n}|"), F.col("id"))).alias("w"))
        got = draws.agg(F.avg("w").alias("m"), F.var_samp("w").alias("v"), F.min("w").alias("low"), F.avg((F.col("w") == 0).cast("int")).alias("none")).first()
        assert abs(got["m"] - n) < 5 * (n / 4_000) ** 0.5 and abs(got["v"] / n - 1) < 0.15 and got["low"] >= 0
        if n == 1:
            assert abs(got["none"] - 0.3679) < 0.04


def test_registry(spark):
    row = model.registry_row(spark, "m", "models/m", "00", model.Candidate("comercial", "arbol", 2))
    assert row.first()["apto_produccion"] is False and len(row.first()["modelo_ml_id"]) == 64


def test_a_stored_model_scores_as_before(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from leadloom.plans.q_streams import training_rows
    from leadloom.plans.registry import Tables

    rows = training_rows(Tables(spark, "/root/testdata/sf0.001"))
    candidate = model.Candidate("comercial", "logistica", 1.0)
    fitted = model.fit(rows, candidate)
    path = str(tmp_path / "m")
    entry = model.store_model(fitted, "m", path, candidate, spark).first()
    assert entry["ruta_artefacto"] == path and len(entry["hash_artefacto"]) == 64
    before = {r["lead_id"]: r["score"] for r in model.score(fitted, rows).collect()}
    after = {r["lead_id"]: r["score"] for r in model.score(PipelineModel.load(path), rows).collect()}
    assert before == after
