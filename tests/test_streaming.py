"""Streams driven to completion from files."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.streaming import timers
from leadloom.streaming.timers import admit

T0 = datetime(2026, 1, 1)


def drain(spark, tmp_path, name, batches, schema, transform, mode="append"):
    """Write each batch as a file, run the stream over them one by one, return all rows."""
    folder = tmp_path / name
    folder.mkdir()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    query = transform(source).writeStream.format("memory").queryName(name).outputMode(mode).option(
        "checkpointLocation", str(tmp_path / f"{name}_cp")).start()
    try:
        for i, rows in enumerate(batches):
            text = "\n".join(json.dumps(r, default=str) for r in rows)
            (folder / f".{i}.tmp").write_text(text)
            (folder / f".{i}.tmp").rename(folder / f"{i:03d}.json")
            query.processAllAvailable()
    finally:
        query.stop()
    return [r.asDict() for r in spark.table(name).collect()]


def at(**kw):
    return str(T0 + timedelta(**kw))


def test_repeats(spark, tmp_path):
    schema = "empresa_id string, actor string, operacion string, clave string, n int, ts timestamp"

    def row(key, n, **kw):
        return {"empresa_id": "E", "actor": "a", "operacion": "o", "clave": key, "n": n,
                "ts": at(**kw)}

    out = drain(spark, tmp_path, "repeats",
                [[row("k1", 1), row("k2", 2)], [row("k1", 3, minutes=5)], [row("k3", 4, minutes=9)]],
                schema, timers.suppress_repeats)
    assert sorted(r["n"] for r in out) == [1, 2, 4]


def one_and_many(spark, tmp_path, name, rows, schema, transform, end):
    """The same rows in one file, one by one and in disorder inside the watermark; ``end`` rows
    only move the watermark past them. All must give the same result."""
    shuffled = [r for pair in zip(rows[1::2], rows[::2]) for r in pair] + rows[len(rows) // 2 * 2:]
    found = []
    for tag, batches in (("one", [rows]), ("many", [[r] for r in rows]), ("swapped", [[r] for r in shuffled])):
        out = drain(spark, tmp_path, f"{name}_{tag}", [*batches, *[[e] for e in end]], schema, transform)
        found.append(sorted(tuple(r.values()) for r in out))
    assert found[0] == found[1] == found[2]
    return found[0]


def test_quota(spark, tmp_path):
    schema = "modelo string, intento_id long, ts timestamp"
    seconds = [i * 2 for i in range(12)] + [60, 61, 62] + list(range(70, 74))
    rows = [{"modelo": "a", "intento_id": i, "ts": at(seconds=s)} for i, s in enumerate(seconds)]
    end = [{"modelo": "z", "intento_id": 0, "ts": at(days=d)} for d in (3, 4)]
    out = one_and_many(spark, tmp_path, "quota", rows, schema, timers.rolling_quota, end)
    want, _ = admit([s * 1_000_000 for s in seconds], [])
    assert [(i, ok) for m, i, ok in out if m == "a"] == list(enumerate(want))


def test_deadline(spark, tmp_path):
    schema = "lead_consolidado_id string, tipo string, ts timestamp"

    def row(lead, kind, **kw):
        return {"lead_consolidado_id": lead, "tipo": kind, "ts": at(**kw)}

    rows = [
        row("met", "inicio"), row("late", "inicio", minutes=1), row("before", "contacto", minutes=2),
        row("before", "inicio", minutes=3), row("before", "contacto", minutes=4),
        row("exact", "inicio", minutes=5), row("met", "contacto", hours=24), row("exact", "contacto", hours=24, minutes=5),
        row("late", "contacto", hours=24, minutes=6), row("met", "contacto", hours=24, minutes=7),
    ]
    end = [row("clock", "inicio", days=3), row("clock", "contacto", days=3, hours=30)]
    out = one_and_many(spark, tmp_path, "deadline", rows, schema,
                       lambda s: timers.first_contact_deadline(s, delay="2 hours"), end)
    assert out == [("before", "no_medible"), ("clock", "vencido"), ("exact", "cumple"), ("late", "vencido"),
                   ("met", "cumple")]


def test_revisions(spark, tmp_path):
    schema = "lead_consolidado_id string, resultado_id long, revision long, ts timestamp"

    def row(i, rev, lead="L"):
        return {"lead_consolidado_id": lead, "resultado_id": i, "revision": rev, "ts": at(minutes=i)}

    out = one_and_many(spark, tmp_path, "revisions", [row(1, 1), row(2, 3), row(3, 2), row(4, 3)], schema,
                       timers.latest_revision, [row(500, 1, "z"), row(700, 1, "z")])
    assert {i: state for lead, i, state in out if lead == "L"} == {
        1: "vigente", 2: "vigente", 3: "obsoleto", 4: "vigente"}


def test_leases(spark, tmp_path):
    schema = "trabajo_id string, tipo string, ts timestamp, lease_segundos int"

    def row(job, kind, **kw):
        return {"trabajo_id": job, "tipo": kind, "ts": at(**kw), "lease_segundos": 60}

    rows = [row("done", "reclamo"), row("lost", "reclamo", seconds=1), row("done", "completado", seconds=30),
            row("lost", "reclamo", minutes=10), row("lost", "reclamo", minutes=20), row("late", "reclamo", minutes=21),
            row("late", "completado", minutes=23)]
    end = [row("z", "completado", hours=3), row("z", "completado", hours=5)]
    out = one_and_many(spark, tmp_path, "leases", rows, schema,
                       lambda s: timers.lease_expiry(s, delay="1 hour"), end)
    assert sorted(out) == [("done", "completado"), ("late", "reintento"), ("lost", "fallido"),
                           ("lost", "reintento"), ("lost", "reintento")]


def test_state_goes_when_it_has_aged():
    """Every step ends its state once nothing more can follow from it."""
    seen = []
    keep = timers.in_event_order
    try:
        timers.in_event_order = lambda *args: seen.append(args[-1])
        timers.rolling_quota(None), timers.first_contact_deadline(None)
        timers.latest_revision(None)
    finally:
        timers.in_event_order = keep
    for step in seen:
        memo, _, due = step("", 10, "1", 1)
        for _ in range(3):
            if memo is None:
                break
            memo, _, due = step(memo, due, None, 0)
        assert memo is None


def test_daily_counts(spark, tmp_path):
    schema = "empresa_id string, lead_consolidado_id string, resultado string, ts timestamp"

    def row(lead, result, **kw):
        return {"empresa_id": "E", "lead_consolidado_id": lead, "resultado": result, "ts": at(**kw)}

    batches = [[row("a", "sin_respuesta", hours=6), row("a", "contactado", hours=28),
                row("b", "contactado", hours=30)], [row("z", "perdido", hours=100)],
               [row("z", "perdido", hours=101)]]
    out = drain(spark, tmp_path, "daily", batches, schema, timers.daily_activity)
    first = next(r for r in out if r["inicio"] == T0 + timedelta(hours=5))
    assert (first["intentos"], first["contactos"]) == (1, 1)
    leads = drain(spark, tmp_path, "dailyleads", batches, schema, timers.daily_leads)
    assert {(r["inicio"].day, r["leads"]) for r in leads} >= {(1, 1), (2, 1)}


def test_sessions(spark, tmp_path):
    schema = "conversacion_id string, ts timestamp"
    batches = [[{"conversacion_id": "c", "ts": at(minutes=m)} for m in (0, 10, 50)],
               [{"conversacion_id": "x", "ts": at(hours=9)}],
               [{"conversacion_id": "x", "ts": at(hours=9, minutes=1)}]]
    out = drain(spark, tmp_path, "sessions", batches, schema, timers.chat_sessions)
    assert sorted(r["mensajes"] for r in out if r["conversacion_id"] == "c") == [1, 2]


def test_snapshot_is_handled_once(spark, tmp_path):
    results = tmp_path / "results"
    (tmp_path / "manifests").mkdir()
    schema = T.StructType([T.StructField("k", T.LongType())])
    seen = []

    def handler(df, mark):
        seen.append(df.count())
        return df.agg(F.sum("k").alias("s"))

    def run(checkpoint):
        timers.on_new_snapshot(spark, str(tmp_path / "manifests"), schema, str(results),
                               str(tmp_path / checkpoint), handler).awaitTermination(60)

    def deliver(name, files):
        folder = tmp_path / name
        folder.mkdir()
        for i, text in enumerate(files):
            (folder / f"{i}.json").write_text(text)
        (tmp_path / "manifests" / f"{name}.json").write_text(json.dumps({"carpeta": str(folder)}) + "\n")

    deliver("a", [f'{{"k": {i}}}\n' for i in range(120)])
    run("one")
    run("two")  # a fresh checkpoint replays the same content
    assert seen == [120]
    deliver("b", ['{"k": 5}\n'])
    deliver("c", ['{"k": 5}\n'])  # the same content elsewhere
    run("two")
    assert seen == [120, 1]
    assert sorted(r["s"] for r in spark.read.option("recursiveFileLookup", "true").parquet(
        *[str(p) for p in results.glob("huella=*")]).collect()) == [5, sum(range(120))]


def test_empty_quota():
    assert admit([], []) == ([], [])


def test_a_folder_is_handled_when_two_observations_agree(spark, tmp_path):
    folder, results = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    seen = []

    def handler(snapshot, digest):
        seen.append(digest)
        return snapshot

    def look(number):
        return timers.observed_run(spark, str(folder), T.StructType().add("v", "long"), results, handler, number)

    assert look(0) == "vacia"
    (folder / "a.json").write_text('{"v": 1}\n')
    assert look(1) == "pendiente"
    (folder / "b.json").write_text('{"v": 2}\n')  # still being written
    assert look(2) == "pendiente" and not seen
    assert look(3) == "publicada" and look(4) == "conocida" and len(seen) == 1
    assert look(4) == "conocida"  # a repeated observation
    (folder / "b.json").write_text('{"v": 2}\n{"v": 3}\n')
    assert look(5) == "pendiente" and look(6) == "publicada" and len(set(seen)) == 2
    assert spark.read.parquet(f"{results}/huella={seen[1]}").count() == 3


def test_a_folder_that_changes_during_the_run_waits(spark, tmp_path):
    folder, results = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.json").write_text('{"v": 1}\n')

    def handler(snapshot, digest):
        if not (folder / "b.json").exists():
            (folder / "b.json").write_text('{"v": 2}\n')
        return snapshot

    states = [timers.observed_run(
        spark, str(folder), T.StructType().add("v", "long"), results, handler, n) for n in range(4)]
    assert states == ["pendiente", "cambiada", "pendiente", "publicada"]


def test_admission_takes_the_same_time_whatever_is_held():
    """Instants leave at one end; the rule is that of counting the day and the minute again each time."""
    import random
    import time

    day, minute = 24 * 3600 * 1_000_000, 60 * 1_000_000
    draw = random.Random(7)
    instants = sorted(draw.randrange(3 * day) for _ in range(3000))
    for per_day, per_minute in ((300, 10), (20, 1), (5, 0), (0, 3), (2000, 2)):
        held, want = [], []
        for t in instants:
            held = [a for a in held if a > t - day]
            ok = len(held) < per_day and sum(a > t - minute for a in held) < per_minute
            held += [t] * ok
            want.append(ok)
        flags, kept = admit(instants, [], per_day, per_minute)
        assert flags == want and [a for a in kept if a > instants[-1] - day] == held
    begin = time.process_time()
    admit([i * minute // 5 for i in range(100_000)], [], 5000, 5)
    assert time.process_time() - begin < 5
