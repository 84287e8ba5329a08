"""Readers, writers, manifests."""

import json

import pytest
from pyspark.sql import functions as F

from leadloom import schemas as S
from leadloom.operators.checks import fingerprint
from leadloom.sources import manifest, readers, writers


def test_csv_keeps_text(spark, tmp_path):
    path = tmp_path / "leads.csv"
    head = ",".join(S.LEADS.fieldNames())
    path.write_text(head + '\nL1,E1,S1,"Ana, Ruiz",0300 111,,,,,,2026-01-02,,\n', encoding="utf-8")
    row = readers.read_csv(spark, str(path), S.LEADS).first()
    assert row["telefono"] == "0300 111" and row["nombre_cliente"] == "Ana, Ruiz"
    assert row["email"] is None


def test_processed_csv_drops_the_mark(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("﻿lead_id,telefono\nL1,+57300\nL2,\n", encoding="utf-8")
    df = readers.read_processed_csv(spark, str(path))
    assert df.columns == ["lead_id", "telefono"]
    assert {tuple(r) for r in df.collect()} == {("L1", "+57300"), ("L2", "")}


def test_strict_json(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    chat = {"conversacion_id": "C", "lead_id": "L", "canal": "x", "fecha_inicio": "2026-01-01",
            "mensajes": [{"emisor": "cliente", "hora": None, "texto": "hola"}]}
    good.write_text(json.dumps([chat]), encoding="utf-8")
    bad.write_text('[{"conversacion_id": NaN}]', encoding="utf-8")
    assert readers.read_chats(spark, str(good)).first()["mensajes"][0]["texto"] == "hola"
    with pytest.raises(Exception, match="bad.json|MALFORMED|Malformed|NaN"):
        readers.read_chats(spark, str(bad)).collect()
    lines = tmp_path / "lines.json"
    lines.write_text('{"emisor": "a"}\n[1, 2\n', encoding="utf-8")
    assert readers.shape_violations(spark, str(lines), S.MESSAGE).count() == 1


def test_export_and_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("05/01/2026", "2026-01-05 00:00:00", "fecha", [1, 2], float("nan")),
         ("2026-01-06 10:00", "2026-01-06 10:00:00", "fecha_hora", None, 1.5)],
        "fecha string, n string, fecha_precision string, ids array<int>, x double"
    ).withColumn("fecha_normalizado", F.col("n").cast("timestamp_ntz")).drop("n")
    out = writers.export_table(df, ["fecha"])
    rows = {r["fecha_original"]: r["fecha"] for r in out.collect()}
    assert rows == {"05/01/2026": "2026-01-05", "2026-01-06 10:00": "2026-01-06 10:00:00"}
    writers.write_csv(out, str(tmp_path / "csv"))
    back = readers.read_processed_csv(spark, str(tmp_path / "csv"))
    assert {r["ids"] for r in back.collect()} == {"[1,2]", ""}
    writers.write_json(df, str(tmp_path / "json"))
    text = "".join(p.read_text() for p in (tmp_path / "json").glob("part-*"))
    assert '"x":null' in text and '"ids":null' in text and "2026-01-06 10:00:00" in text
    stable = spark.range(50).withColumn("v", F.col("id") % 3)
    writers.write_table(stable, str(tmp_path / "t"), ["v"])
    again = spark.read.parquet(str(tmp_path / "t")).select("id", F.col("v").cast("bigint").alias("v"))
    assert fingerprint(again).first() == fingerprint(stable).first()
    assert manifest.verify_round_trip({"t": stable}, {"t": again}).count() == 0
    assert manifest.verify_round_trip({"t": stable}, {"t": again.limit(49)}).count() == 1


def test_manifest_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n")
    found = manifest.file_hashes(spark, str(tmp_path)).first()
    expected = spark.createDataFrame(
        [("a.csv", found["sha256"]), ("b.csv", "00")], "nombre string, sha256 string")
    bad = {r["nombre"]: r["estado"] for r in
           manifest.verify_files(spark, str(tmp_path), expected).collect()}
    assert bad == {"b.csv": "falta"}
    missing = manifest.missing_inputs(spark, str(tmp_path), ["a.csv", "c.csv"])
    assert [r["nombre"] for r in missing.collect()] == ["c.csv"]
    for place, text in (("one", "1\n"), ("two", "2\n")):
        (tmp_path / "deep" / place).mkdir(parents=True)
        (tmp_path / "deep" / place / "x.csv").write_text(text)
    both = manifest.file_hashes(spark, str(tmp_path / "deep"))
    assert {r["nombre"] for r in both.collect()} == {"one/x.csv", "two/x.csv"}
    assert manifest.verify_files(spark, str(tmp_path / "deep"), both).count() == 0


def test_source_rows_are_stable(spark):
    df = spark.createDataFrame([(f"L{i:03d}",) for i in range(40)], "lead_id string")
    out = readers.with_source_rows(df.repartition(7), ["lead_id"])
    assert {(r["lead_id"], r["source_row"]) for r in out.collect()} == {
        (f"L{i:03d}", i + 1) for i in range(40)}
