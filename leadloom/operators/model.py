"""Small baseline models on the approved features, their selection and explanation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from leadloom.operators import metrics
from leadloom.operators.ranking import attach_single
from leadloom.session import cut_lineage

PROFILES = {
    "ingreso": ["canal"],
    "comercial": ["canal", "modelo_sku", "manifesto_cuota_inicial", "forma_pago_declarada",
                  "cita_observada"],
}
LEAF_ROWS = 40
TASK_CELLS = 20_000
FITS_AT_ONCE = 4
FORBIDDEN = {"numero_contactos", "desenlace", "empresa_id", "horas_al_primer_contacto"}


@dataclass(frozen=True)
class Candidate:
    """One point of the grid."""

    profile: str
    kind: str
    value: float
    weights: str = "sin_pesos"

    @property
    def name(self) -> str:
        return f"{self.profile}_{self.kind}_{self.value}_{self.weights}"


def grid(weights: Sequence[str] = ("sin_pesos", "balanced")) -> list[Candidate]:
    """Candidates from the simplest to the richest; the order breaks ties."""
    return [
        Candidate(profile, kind, value, w)
        for profile in PROFILES
        for kind, values in (("logistica", (0.1, 1.0, 10.0)), ("arbol", (2, 3)))
        for value in values
        for w in weights
    ]


def encoder(columns: Sequence[str]) -> list:
    """One-hot stages; a category unseen in training becomes all zeros."""
    indexed = [f"{c}_ix" for c in columns]
    encoded = [f"{c}_v" for c in columns]
    return [
        StringIndexer(inputCols=list(columns), outputCols=indexed, handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
        VectorAssembler(inputCols=encoded, outputCol="features"),
    ]


def fit(train: DataFrame, candidate: Candidate) -> PipelineModel:
    """Train one candidate. The regularisation follows the summed-loss convention (C)."""
    columns = PROFILES[candidate.profile]
    if FORBIDDEN & set(columns):
        raise ValueError("leakage column among the features")
    rows = train.select(*columns, F.col("y").cast("double").alias("y"))
    weight = {}
    if candidate.weights == "balanced":
        w = metrics.balanced_weights(rows, "y").select("y", F.col("peso").alias("w"))
        rows, weight = rows.join(F.broadcast(w), "y"), {"weightCol": "w"}
    if candidate.kind == "logistica":
        # with weights the loss is averaged over their sum, which equals the row count
        n = rows.count()
        estimator = LogisticRegression(
            labelCol="y", regParam=1.0 / (candidate.value * n), elasticNetParam=0.0,
            standardization=False, maxIter=2000, tol=1e-9, **weight)
    else:
        estimator = DecisionTreeClassifier(
            labelCol="y", maxDepth=int(candidate.value), minInstancesPerNode=LEAF_ROWS, seed=42,
            leafCol="hoja", **weight)
    return Pipeline(stages=[*encoder(columns), estimator]).fit(rows)


def score(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    """Probability of closing; helper columns are dropped."""
    keep = df.columns
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias(out))


def experimental_score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The probability times 100 with four decimals, kept apart from the operating score."""
    return score(model, df, "_p").withColumn(
        "score_modelo_experimental", F.round(F.col("_p") * 100, 4)).drop("_p")


def evaluate(scored: DataFrame, probability: bool = True) -> DataFrame:
    """One row of metrics for ``y`` and ``score``."""
    steps = metrics.score_steps(scored, "y", "score")
    out = attach_single(metrics.average_precision(steps), metrics.roc_auc(steps))
    out = attach_single(out, metrics.top_fraction(steps))
    if probability:
        out = attach_single(out, metrics.brier(scored, "y", "score"))
        out = attach_single(out, metrics.confusion(scored, "y", "score"))
    return out


def _fitted_classifier(candidate: Candidate, encoded: DataFrame, per_class: dict[int, int]):
    """Train one candidate on encoded cells (features, y, n), each standing for ``n`` rows.

    Forty rows a leaf become their share of the whole weight, which balancing leaves as it is; half
    a row less, so that rounding never turns forty into too few.
    """
    total = sum(per_class.values())
    share = F.lit(1.0)
    if candidate.weights == "balanced":
        share = F.coalesce(*[
            F.when(F.col("y") == y, round(total / (len(per_class) * n), 6)) for y, n in per_class.items()])
    rows = encoded.withColumn("w", F.col("n") * share)
    if candidate.kind == "logistica":
        estimator = LogisticRegression(
            labelCol="y", weightCol="w", regParam=1.0 / (candidate.value * total), elasticNetParam=0.0,
            standardization=False, maxIter=2000, tol=1e-9)
    else:
        estimator = DecisionTreeClassifier(
            labelCol="y", weightCol="w", maxDepth=int(candidate.value), seed=42,
            minWeightFractionPerNode=min(0.499, (LEAF_ROWS - 0.5) / total))
    return estimator.fit(rows)


def score_grid(rounds: DataFrame, candidates: Sequence[Candidate]) -> DataFrame:
    """Validation cells scored by every candidate: candidato, regimen, orden, ronda, y, n, score.

    ``rounds``: features, y, ronda, uso. The history is read once and counted into cells of equal
    features, label and use; their number depends on the categories, not on the rows. Encoders are
    fitted once per round and profile, and their cells stay in memory for all candidates. The loops
    run over the grid and the rounds (a fixed handful). A round without training rows is an error,
    one without validation rows gives none.
    """
    spark = rounds.sparkSession
    profiles = list(dict.fromkeys(c.profile for c in candidates))
    columns = list(dict.fromkeys(c for p in profiles for c in PROFILES[p]))
    if FORBIDDEN & set(columns):
        raise ValueError("leakage column among the features")
    cells = cut_lineage(rounds.groupBy("ronda", "uso", *columns, F.col("y").cast("int").alias("y")).agg(
        F.count(F.lit(1)).alias("n")))
    classes: dict[str, dict[int, int]] = {
        r["ronda"]: {} for r in cells.select("ronda").distinct().collect()}
    training = cells.where("uso = 'entrenamiento'")
    parts = 1 + cells.count() // TASK_CELLS  # an iteration over few cells is one small task
    for r in training.groupBy("ronda", "y").agg(F.sum("n").alias("n")).collect():
        classes[r["ronda"]][r["y"]] = r["n"]
    scored = []
    for name, per_class in sorted(classes.items()):
        if not per_class:
            raise ValueError(f"round {name} has no training rows")
        for profile in profiles:
            here = cells.where(F.col("ronda") == name).groupBy("uso", *PROFILES[profile], "y").agg(
                F.sum("n").alias("n"))
            train, check = (here.where(F.col("uso") == u) for u in ("entrenamiento", "validacion"))
            encoding = Pipeline(stages=encoder(PROFILES[profile])).fit(train)
            # dealt and not coalesced: a task would hold the tables of all partitions it counts
            encoded = encoding.transform(train).select("features", "y", "n").repartition(parts).persist()
            unseen = encoding.transform(check).select("features", "y", "n")
            mine = [(order, c) for order, c in enumerate(candidates) if c.profile == profile]
            fits = [inheritable_thread_target(spark)(partial(_fitted_classifier, c, encoded, per_class)) for _, c in mine]
            with ThreadPool(FITS_AT_ONCE) as pool:
                fitted = pool.map(lambda task: task(), fits)
            encoded.unpersist()
            scored += [
                one.transform(unseen).select(
                    F.lit(c.name).alias("candidato"), F.lit(c.weights).alias("regimen"),
                    F.lit(order).alias("orden"), F.lit(name).alias("ronda"), "y", "n",
                    vector_to_array("probability")[1].alias("score"))
                for (order, c), one in zip(mine, fitted, strict=True)]
    return reduce(DataFrame.unionByName, scored)


RUN = ["candidato", "regimen", "orden", "ronda"]


def grid_metrics(scored: DataFrame) -> DataFrame:
    """One row of metrics per candidate and round, all in one job over the scored cells."""
    cells = cut_lineage(scored.groupBy(*RUN, "y", "score").agg(F.sum("n").alias("n")))
    steps = cut_lineage(metrics.weighted_steps(cells, "y", "score", "n", RUN))
    parts = [
        metrics.average_precision(steps, RUN), metrics.roc_auc(steps, RUN), metrics.top_fraction(steps, group=RUN),
        metrics.brier(cells, "y", "score", RUN, "n"), metrics.confusion(cells, "y", "score", group=RUN, weight="n")]
    return reduce(lambda a, b: a.join(b, RUN), parts)


def choose(per_round: DataFrame) -> DataFrame:
    """The candidate with the best mean average precision per weighting; ties go to the simplest."""
    means = per_round.groupBy("candidato", "regimen", "orden").agg(
        F.round(F.avg("ap"), 6).alias("ap_media"), F.min("ap").alias("ap_minima"),
        F.round(F.avg("precision_top"), 6).alias("precision_media"))
    return means.groupBy("regimen").agg(F.max_by(
        F.struct("candidato", "ap_media", "ap_minima", "precision_media"),
        F.struct("ap_media", -F.col("orden"))).alias("_b")).select("regimen", "_b.*")


def select_candidates(rounds: DataFrame, candidates: Sequence[Candidate]
                      ) -> tuple[DataFrame, DataFrame]:
    """(metrics per candidate and round, best candidate per weighting)."""
    per_round = cut_lineage(grid_metrics(score_grid(rounds, candidates)))
    return per_round, choose(per_round)


#: Cells of up to so many rows are drawn by the exact law, larger ones by its expansion.
EXACT_DRAWS, LONGEST_DRAW = 64, 160


def _uniform(cell: Column, part: int) -> Column:
    """A number in [0, 1) out of 13 hexadecimal digits of the cell's digest."""
    digits = F.conv(F.substring(F.md5(cell), 1 + 13 * part, 13), 16, 10).cast("bigint")
    return digits / F.lit(float(1 << 52))


def poisson_draw(n: Column, cell: Column) -> Column:
    """How often ``n`` rows are drawn together, each Poisson(1) times: one Poisson(n) number per cell.

    Up to ``EXACT_DRAWS`` rows by the inverse of the law; beyond, by its Cornish-Fisher expansion
    around a normal number, whose error in the law falls with the root of n.
    """
    u, v = _uniform(cell, 0), _uniform(cell, 1)
    x = n.cast("double")
    # the number is kept beside the sums, so that it is worked out once and not at every step
    start = F.struct(F.lit(0).alias("k"), F.exp(-x).alias("p"), F.exp(-x).alias("c"), u.alias("u"), x.alias("x"))

    def more(acc: Column, i: Column) -> Column:
        p = acc["p"] * acc["x"] / i
        k = acc["k"] + F.when(acc["u"] >= acc["c"], 1).otherwise(0)
        return F.struct(k.alias("k"), p.alias("p"), (acc["c"] + p).alias("c"), acc["u"].alias("u"), acc["x"].alias("x"))

    exact = F.aggregate(F.sequence(F.lit(1), F.lit(LONGEST_DRAW)), start, more, lambda acc: acc["k"]).cast("bigint")
    z = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)
    wide = F.greatest(F.lit(0), F.floor(x + z * F.sqrt(x) + (z * z - 1) / 6 + 0.5)).cast("bigint")
    return F.when(n <= EXACT_DRAWS, exact).otherwise(wide)


def bootstrap_interval(df: DataFrame, y: str, a: str, b: str, repetitions: int = 1000,
                       seed: int = 42) -> DataFrame:
    """95 % interval of AP(a) - AP(b) and of the top-20 % precision difference.

    Rows with equal label and scores are one cell. A cell is drawn once per repetition, a
    Poisson(n) number from a digest of its values, so cells and not rows are repeated, the draws are
    the same on every attempt of a task, and no resample is ever materialised.
    """
    cells = cut_lineage(df.groupBy(y, a, b).agg(F.count(F.lit(1)).alias("_n")))
    drawn = cells.select("*", F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("rep"))
    shown = lambda c: F.round(F.col(c) * 1e9).cast("bigint")
    cell = F.concat_ws("|", F.lit(seed), shown(a), shown(b), F.col(y).cast("bigint"), "rep")
    drawn = cut_lineage(drawn.withColumn("w", poisson_draw(F.col("_n"), cell)).where("w > 0"))

    def steps(name: str) -> DataFrame:
        return metrics.weighted_steps(drawn, y, name, "w", ["rep"])

    def both(name: str, tag: str) -> DataFrame:
        s = steps(name)
        ap = metrics.average_precision(s, ["rep"]).withColumnRenamed("ap", f"ap_{tag}")
        top = metrics.top_fraction(s, group=["rep"]).select(
            "rep", F.col("precision_top").alias(f"top_{tag}"))
        return ap.join(top, "rep")

    diff = both(a, "a").join(both(b, "b"), "rep").select(
        (F.col("ap_a") - F.col("ap_b")).alias("AP"),
        (F.col("top_a") - F.col("top_b")).alias("precision_top20"))
    long = diff.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("medida"), F.col(c).alias("d"))
        for c in ("AP", "precision_top20")]))).where(F.col("d").isNotNull())
    q = F.percentile("d", [0.025, 0.5, 0.975])
    return long.groupBy("medida").agg(q.alias("_q")).select(
        "medida", *[F.round(F.col("_q")[i], 6).alias(n) for i, n in
                    enumerate(("limite_inferior_95", "mediana", "limite_superior_95"))])


def feature_names(model: PipelineModel, columns: Sequence[str]) -> list[str]:
    """Names of the vector positions, ``campo=categoria``."""
    labels = model.stages[0].labelsArray
    return [f"{c}={v}" for c, vs in zip(columns, labels, strict=True) for v in vs]


def coefficients(model: PipelineModel, columns: Sequence[str], spark: SparkSession) -> DataFrame:
    """(caracteristica, coeficiente) of a logistic model, with the intercept."""
    fitted = model.stages[-1]
    rows = [(n, float(v)) for n, v in
            zip(feature_names(model, columns), fitted.coefficients.toArray(), strict=True)]
    rows.append(("intercepto", float(fitted.intercept)))
    return spark.createDataFrame(rows, "caracteristica string, coeficiente double")


def logit_contributions(df: DataFrame, table: DataFrame, columns: Sequence[str], row: str
                        ) -> DataFrame:
    """The active features of each row with their share of the logit; unseen ones add nothing."""
    active = df.select(row, F.explode(F.array(*[
        F.concat(F.lit(f"{c}="), F.col(c)) for c in columns])).alias("caracteristica"))
    return active.join(table, "caracteristica").select(
        row, "caracteristica", F.col("coeficiente").alias("aporte"))


def tree_rules(model: PipelineModel, columns: Sequence[str], spark: SparkSession) -> DataFrame:
    """(hoja, condiciones, probabilidad, ejemplos) of every leaf of a shallow tree."""
    names = feature_names(model, columns)
    rows: list[tuple[int, str, float, int]] = []

    def walk(node, path: list[str]) -> None:
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            total = sum(stats) or 1.0
            rows.append((len(rows), " y ".join(path), stats[1] / total,
                         int(node.impurityStats().rawCount())))
            return
        split = node.split()
        name = names[split.featureIndex()]
        if split.getClass().getSimpleName() == "ContinuousSplit":
            left, right = f"{name} <= {split.threshold()}", f"{name} > {split.threshold()}"
        else:
            inside = 1.0 in list(split.leftCategories())
            left, right = (name, f"no {name}") if inside else (f"no {name}", name)
        walk(node.leftChild(), [*path, left])
        walk(node.rightChild(), [*path, right])

    walk(model.stages[-1]._call_java("rootNode"), [])
    return spark.createDataFrame(
        rows, "hoja int, condiciones string, probabilidad double, ejemplos long")


def tree_paths(model: PipelineModel, df: DataFrame, columns: Sequence[str], row: str) -> DataFrame:
    """The leaf each row falls into, with its conditions."""
    rules = tree_rules(model, columns, df.sparkSession)
    leaf = model.transform(df).select(row, F.col("hoja").cast("int").alias("hoja"))
    return leaf.join(F.broadcast(rules), "hoja")


def registry_row(spark: SparkSession, name: str, path: str, digest: str, candidate: Candidate,
                 state: str = "experimental_generador_scores_actuales") -> DataFrame:
    """Registry entry of a stored model; never fit for production by itself."""
    from leadloom.functions import ids

    base = spark.createDataFrame(
        [(name, candidate.kind, candidate.name, path, digest, state, False)],
        "nombre string, algoritmo string, version string, ruta_artefacto string, "
        "hash_artefacto string, estado string, apto_produccion boolean")
    return base.select(ids.row_id("nombre", "hash_artefacto").alias("modelo_ml_id"), "*")


def store_model(model: PipelineModel, name: str, path: str, candidate: Candidate, spark: SparkSession
                ) -> DataFrame:
    """Write the fitted model and return its registry entry, with a digest of what was written."""
    from leadloom.sources.manifest import file_hashes

    model.write().overwrite().save(path)
    parts = file_hashes(spark, path).agg(
        F.sort_array(F.collect_list("sha256")).alias("h"))  # the few files of one model
    digest = parts.select(F.sha2(F.array_join("h", ""), 256)).first()[0]
    return registry_row(spark, name, path, digest, candidate)


def unseen_categories(train: DataFrame, current: DataFrame, columns: Sequence[str], row: str
                      ) -> DataFrame:
    """Rows whose category never occurred in training."""
    from leadloom.operators.profile import long_form

    seen = long_form(train, columns).distinct()
    now = long_form(current, columns, keep=[row])
    return now.join(seen, ["campo", "valor"], "left_anti").select(
        F.lit("categoria_no_vista").alias("tipo"), row, "campo", "valor")
