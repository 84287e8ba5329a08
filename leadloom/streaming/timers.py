"""Snapshots, duplicate suppression, quotas, deadlines, revisions, leases and daily counts.

State per key is small and bounded: a revision, a lease, the instants of at most one day's
admissions, and the events that the watermark has not passed yet. It goes when it has aged.
"""

from __future__ import annotations

import json
import sys
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leadloom import fixed_values as V
from leadloom.operators.checks import fingerprint

HOUR = 3600 * 1000


def _marks(spark: SparkSession, path: str) -> DataFrame:
    """The written marks below ``path``, none when nothing has been written yet."""
    try:
        return spark.read.schema("huella string").json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "huella string")


def _mark(spark: SparkSession, path: str, digest: str, mode: str) -> None:
    spark.createDataFrame([(digest,)], "huella string").coalesce(1).write.mode(mode).json(path)


def _digest(df: DataFrame) -> str | None:
    mark = fingerprint(df).first()
    return f"{mark['filas']}-{mark['huella_a']}-{mark['huella_b']}" if mark["filas"] else None


def _handle_once(
    spark: SparkSession, folder: str, schema: T.StructType, results: str, handler: Callable[[DataFrame, str], DataFrame],
    still: Callable[[], bool] = lambda: True,
) -> str:
    """Handle the content of a folder unless its result is kept already: vacia, conocida, cambiada or publicada.

    When the folder is not ``still`` the same after the run, the result is not entered.
    """
    snapshot = spark.read.schema(schema).json(folder)
    digest = _digest(snapshot)
    if digest is None:
        return "vacia"
    if len(_marks(spark, f"{results}/listas").where(F.col("huella") == digest).take(1)):
        return "conocida"
    handler(snapshot, digest).write.mode("overwrite").parquet(f"{results}/huella={digest}")
    if not still():
        return "cambiada"
    _mark(spark, f"{results}/listas", digest, "append")
    return "publicada"


def observe(spark: SparkSession, folder: str) -> str | None:
    """A fingerprint of names, sizes and times of the files of a folder; none without files. No file is read."""
    files = spark.read.format("binaryFile").load(folder)
    return _digest(files.select("path", "length", F.col("modificationTime").cast("string").alias("en")))


def observed_run(
    spark: SparkSession, folder: str, schema: T.StructType, results: str, handler: Callable[[DataFrame, str], DataFrame],
    number: int,
) -> str:
    """Observation ``number`` of a folder without manifest: its content is handled when two observations
    in a row agree, so a folder that is still being written waits (``pendiente``).

    The observation is written under its number, so a repeated one replaces itself.
    """
    now = observe(spark, folder)
    if now is None:
        return "vacia"
    _mark(spark, f"{results}/observaciones/numero={number}", now, "overwrite")
    before = _marks(spark, f"{results}/observaciones/numero={number - 1}").first()
    if before is None or before["huella"] != now:
        return "pendiente"
    return _handle_once(spark, folder, schema, results, handler, lambda: observe(spark, folder) == now)


def watch_folder(
    spark: SparkSession, folder: str, schema: T.StructType, results: str, checkpoint: str,
    handler: Callable[[DataFrame, str], DataFrame], interval: str = "60 seconds",
):
    """Observe a folder at every interval and handle each content that has settled, once."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(
        lambda _, number: observed_run(spark, folder, schema, results, handler, number) and None
    ).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def on_new_snapshot(
    spark: SparkSession, manifests: str, schema: T.StructType, results: str, checkpoint: str,
    handler: Callable[[DataFrame, str], DataFrame],
):
    """Run ``handler(snapshot, fingerprint)`` for each new snapshot and keep its result.

    A snapshot is a folder of JSON lines, complete once a manifest file ``{"carpeta": path}``
    names it; the stream watches the manifests, and the batch reads the whole folder, however
    many files it has. The result goes to ``results/huella=<fingerprint>``, which is also the
    ledger: known content is not handled again, and a run that broke off writes the same place
    anew, so each content leaves exactly one result.
    """
    incoming = spark.readStream.schema("carpeta string").json(manifests)

    def run(batch: DataFrame, _: int) -> None:
        for row in batch.select("carpeta").distinct().orderBy("carpeta").toLocalIterator():
            _handle_once(spark, row["carpeta"], schema, results, handler)

    return incoming.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def in_event_order(
    events: DataFrame, key: str, kind: Column, number: Column, out: str, delay: str, load: Callable, dump: Callable,
    step: Callable,
) -> DataFrame:
    """Fold the events of each key in event time, whatever batches they arrive in.

    Events wait in the state until the watermark has passed them; those of one key and ``delay``
    are held together. ``step(memo, micros, kind, number)`` returns the new memo, the rows to emit
    and the instant (microseconds, or None) at which to call it again with kind None if no event
    comes before; a memo of None ends the state of the key. Between batches a memo is the text that
    ``dump`` makes of it and ``load`` reads, "" for a new key. Results cover all events older than the
    watermark.
    """
    kinds = T.StructType.fromDDL(out)
    name, names = kinds.fieldNames()[0], kinds.fieldNames()[1:]

    def fold(value, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, memo, due = [], load(""), None
        if state.exists:
            text, kept, due = state.get
            memo = load(kept)
            waiting = [tuple(x) for x in json.loads(text)]
        if not state.hasTimedOut:
            for frame in frames:
                at = frame["ts"].astype("datetime64[us]").astype("int64")
                waiting += zip(at.tolist(), frame["_kind"].tolist(), map(int, frame["_number"]), strict=True)
        now = state.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda x: (x[0], x[2]))
        rows: list[tuple] = []

        def call(at: int, what: str | None, n: int) -> None:
            nonlocal memo, due
            memo, made, due = step(load("") if memo is None else memo, at, what, n)
            rows.extend(made)

        done = 0
        for at, what, n in waiting:
            if at >= now:
                break
            while due is not None and due < at:
                call(due, None, 0)
            call(at, what, n)
            done += 1
        while due is not None and due < now:
            call(due, None, 0)
        waiting = waiting[done:]
        if not waiting and memo is None:
            state.remove()
        else:
            state.update((json.dumps(waiting), "" if memo is None else dump(memo), due))
            later = [x for x in (waiting[0][0] if waiting else None, due) if x is not None]
            if later:
                state.setTimeoutTimestamp(max(min(later) // 1000, now // 1000, 1))
        yield pd.DataFrame({name: [value[0]] * len(rows), **{c: [r[i] for r in rows] for i, c in enumerate(names)}})

    narrow = events.withWatermark("ts", delay).select(
        key, "ts", kind.alias("_kind"), number.cast("bigint").alias("_number"))
    return narrow.groupBy(key).applyInPandasWithState(
        fold, kinds, "espera string, memo string, vence long", "append", GroupStateTimeout.EventTimeTimeout)


def suppress_repeats(requests: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """First request per tenant, actor, operation and key inside the watermark."""
    return requests.withWatermark(ts, delay).dropDuplicatesWithinWatermark(
        ["empresa_id", "actor", "operacion", "clave"])


def admit(instants: list[int], admitted: list[int], per_day: int = V.QUOTA_PER_DAY,
          per_minute: int = V.QUOTA_PER_MINUTE) -> tuple[list[bool], list[int]]:
    """Sequential admission over sorted instants (microseconds). Rejected ones do not count."""
    held = deque(sorted(admitted))
    flags = [_admits(held, t, per_day, per_minute) for t in instants]
    return flags, list(held)


def _admits(held: deque[int], t: int, per_day: int, per_minute: int) -> bool:
    """Whether an attempt at ``t`` is admitted; ``held`` are the admissions of the day before, in order."""
    day, minute = 24 * 3600 * 1_000_000, 60 * 1_000_000
    while held and held[0] <= t - day:
        held.popleft()
    # of instants in order, the one that far from the end tells how many are inside the minute
    ok = len(held) < per_day and per_minute > 0 and (len(held) < per_minute or held[-per_minute] <= t - minute)
    if ok:
        held.append(t)
    return ok


def rolling_quota(attempts: DataFrame, per_day: int = V.QUOTA_PER_DAY,
                  per_minute: int = V.QUOTA_PER_MINUTE, delay: str = "1 hour") -> DataFrame:
    """Admission of (modelo, intento_id, ts) attempts in event order; only admitted ones use quota.

    The state of a model is at most one day's admissions and goes when they have aged.
    """
    day = 24 * HOUR * 1000

    def step(held: deque[int], at: int, kind: str | None, number: int):
        held = held or deque()
        made = [] if kind is None else [(number, _admits(held, at, per_day, per_minute))]
        while held and held[0] <= at - day:
            held.popleft()
        return (held if held or made else None), made, (held[-1] + day if held else None)

    return in_event_order(attempts, "modelo", F.lit("intento"), F.col("intento_id"),
                          "modelo string, intento_id long, admitido boolean", delay,
                          lambda text: deque(json.loads(text or "[]")), lambda held: json.dumps(list(held)), step)


def first_contact_deadline(events: DataFrame, delay: str = "1 hour", hours: int = 24,
                           keep_days: int = 90) -> DataFrame:
    """Met and overdue first contacts, and those that cannot be measured.

    ``events``: lead_consolidado_id, tipo ('inicio' or 'contacto'), ts. The first start counts.
    A contact before it makes the lead ``no_medible``; one until start + 24 h is ``cumple``; else
    the lead is ``vencido`` when that instant has passed. One result per lead; its state is kept
    for ``keep_days`` so that later events change nothing, then removed.
    """
    limit, kept = hours * HOUR * 1000, keep_days * 24 * HOUR * 1000

    def step(memo: str, at: int, kind: str | None, number: int):
        tag, _, since = memo.partition(":")
        if tag == "listo":
            return (None if kind is None else memo), [], (None if kind is None else int(since) + kept)
        done = (f"listo:{at}", at + kept)
        if kind is None:  # the limit has passed, or a contact never got a start
            if tag == "antes":
                return None, [], None
            return done[0], [("vencido",)], done[1]
        if kind == "inicio":
            if tag == "antes":
                return done[0], [("no_medible",)], done[1]
            return (memo, [], int(since) + limit) if tag else (f"inicio:{at}", [], at + limit)
        if tag == "inicio":
            return done[0], [("cumple",)], done[1]
        return (memo or f"antes:{at}"), [], int(since or at) + kept

    return in_event_order(events, "lead_consolidado_id", F.col("tipo"), (F.col("tipo") != "inicio").cast("int"),
                          "lead_consolidado_id string, estado string", delay, str, str, step)


def latest_revision(results: DataFrame, delay: str = "1 hour", keep_days: int = 90) -> DataFrame:
    """Tag results as current or obsolete by the highest revision before them in event time.

    ``results``: lead_consolidado_id, resultado_id, revision, ts. The revision of a lead is kept
    for ``keep_days`` after its last result.
    """
    kept = keep_days * 24 * HOUR * 1000

    def step(memo: str, at: int, kind: str | None, number: int):
        if kind is None:
            return None, [], None
        top = int(memo or 0)
        state = "vigente" if int(kind) >= top else "obsoleto"
        return str(max(top, int(kind))), [(number, state)], at + kept

    return in_event_order(
        results, "lead_consolidado_id", F.col("revision").cast("string"), F.col("resultado_id"),
        "lead_consolidado_id string, resultado_id long, estado string", delay, str, str, step)


def lease_expiry(events: DataFrame, delay: str = "1 minute", max_attempts: int = 3,
                 keep_days: int = 90) -> DataFrame:
    """What became of every lease: finished, to be tried again, or failed.

    ``events``: trabajo_id, tipo ('reclamo' or 'completado'), ts, lease_segundos. At every event a
    lease that has run out is settled first: ``reintento``, or ``fallido`` from the
    ``max_attempts``-th claim on. A claim while a lease runs renews it without an outcome. A job's
    state goes ``keep_days`` after its last event.
    """
    kept = keep_days * 24 * HOUR * 1000

    def step(memo: str, at: int, kind: str | None, number: int):
        attempts, until, last = map(int, (memo or "0:0:0").split(":"))
        out = []
        if until and (until <= at if kind else until < at + 1):
            out.append(("fallido" if attempts >= max_attempts else "reintento",))
            until = 0
        elif kind is None:
            return None, [], None
        if kind == "completado" and until:
            out.append(("completado",))
            until = 0
        elif kind is not None and kind != "completado":
            attempts, until = attempts + 1, at + int(kind) * 1_000_000
        last = at if kind else last
        return f"{attempts}:{until}:{last}", out, until or last + kept

    lease = F.when(F.col("tipo") == "completado", "completado").otherwise(
        F.col("lease_segundos").cast("string"))
    order = F.col("orden") if "orden" in events.columns else F.lit(0)
    return in_event_order(events, "trabajo_id", lease, order,
                          "trabajo_id string, estado string", delay, str, str, step)


def business_day(ts: Column | str) -> Column:
    """Day window of Bogota (UTC-5)."""
    return F.window(ts, "1 day", startTime="5 hours")


def daily_activity(activities: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Attempts and contacts per company and business day."""
    return (
        activities.withWatermark("ts", delay)
        .groupBy("empresa_id", business_day("ts").alias("dia"))
        .agg(F.count_if(F.col("resultado") == "sin_respuesta").alias("intentos"),
             F.count_if(F.col("resultado") == "contactado").alias("contactos"))
        .select("empresa_id", F.col("dia.start").alias("inicio"), "intentos", "contactos")
    )


def daily_leads(activities: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Exact number of distinct leads handled per company and business day."""
    one = (
        activities.withWatermark("ts", delay)
        .withColumn("dia", business_day("ts"))
        .dropDuplicates(["empresa_id", "lead_consolidado_id", "dia"])
    )
    return one.groupBy("empresa_id", "dia").agg(F.count(F.lit(1)).alias("leads")).select(
        "empresa_id", F.col("dia.start").alias("inicio"), "leads")


def chat_sessions(messages: DataFrame, gap: str = "30 minutes", delay: str = "1 hour"
                  ) -> DataFrame:
    """Messages of a chat grouped into sessions separated by a pause."""
    return (
        messages.withWatermark("ts", delay)
        .groupBy("conversacion_id", F.session_window("ts", gap).alias("s"))
        .agg(F.count(F.lit(1)).alias("mensajes"))
        .select("conversacion_id", F.col("s.start").alias("inicio"), F.col("s.end").alias("fin"),
                "mensajes")
    )


# worker functions travel with their code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
