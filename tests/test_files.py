"""Scans, sinks and the incremental run on files that the tests write."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cohortspark.functions.fields import fingerprint
from cohortspark.plans import q_files
from cohortspark.sources import files as A
from cohortspark.streaming.incremental import resume


def test_manifest_keeps_text(spark, tmp_path):
    (tmp_path / "m.csv").write_text("id,path,label,split,sha256,phash,exclusion_reason\n007,a,x,train,00ff,0001,\n")
    row = A.read_manifest(spark, str(tmp_path / "m.csv")).first()
    assert (row.id, row.sha256, row.exclusion_reason) == ("007", "00ff", "")


def test_held_out_rows_close_the_door(spark):
    rows = spark.createDataFrame([(1, "train"), (2, " Test ")], "id long, split string")
    with pytest.raises(PermissionError):
        A.admitted(rows, ["id"])
    assert A.admitted(rows.where("id = 1"), ["id"]).columns == ["id"]


def test_split_lists(spark, tmp_path):
    (tmp_path / "train.txt").write_text("a\n b \n\n")
    (tmp_path / "val.txt").write_text("c\n")
    assert {(r.id, r.split) for r in A.read_splits(spark, str(tmp_path)).collect()} == {("a", "train"), ("b", "train"), ("c", "val")}


def annotation(persons, **more):
    return {"filename": "f", "originalname": "o", "width": 9, "height": 9, "persons": persons} | more


def person(actions, box=(1, 2, 60, 9)):
    return {"actions": actions, "bndbox": dict(zip(("xmin", "ymin", "xmax", "ymax"), box, strict=True))}


def test_annotations(spark, tmp_path):
    good = annotation([person({"walk": 1, "sit": 0})])
    bad = {
        "persons": annotation([], filename="p"), "actions": annotation([person({"walk": 1})], filename="a"), "values": annotation([person({"walk": 2, "sit": 0})], filename="v"),
        "active": annotation([person({"walk": 1, "sit": 1})], filename="m"), "box": annotation([person({"walk": 1, "sit": 0}, (5, 2, 5, 9))], filename="b"), "source": annotation([person({"walk": 1, "sit": 0})], filename="s", originalname=" "),
    }
    for k, d in enumerate([good, *bad.values()]):
        (tmp_path / f"{k}.json").write_text(json.dumps(d))
    docs = A.read_annotations(spark, str(tmp_path))
    errors = {}
    for r in A.strict_errors(docs, ["walk", "sit"]).collect():
        errors.setdefault(r.filename, set()).add(r.error)
    assert "f" not in errors and all(e in errors[d["filename"]] for e, d in bad.items())
    rows = {r.filename: r for r in A.target_rows(docs, ["walk"]).collect()}
    assert rows["f"].label == "walk" and rows["f"].box.xmax == 60 and rows["p"].status == "none"


def test_unlike_arrays_raise(spark):
    rows = spark.createDataFrame([("sit", [1, 2], [5, 5], [1])], "action string, ann_id array<long>, image_id array<long>, label array<int>")
    with pytest.raises(Exception, match="unlike"):
        A.column_actions(rows).collect()


def test_summaries_and_digests(spark, tmp_path):
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "summary.json").write_text(json.dumps({"val": {"f1": 0.5}, "seed": 3}))
    row = A.run_summaries(spark, str(tmp_path)).first()
    assert (row.val_f1, row.seed, row.run) == (0.5, 3, "run1")
    import hashlib

    assert A.file_digests(spark, str(tmp_path)).first().sha256 == hashlib.sha256((tmp_path / "run1" / "summary.json").read_bytes()).hexdigest()


def test_evidence_is_written_once(spark, tmp_path):
    rows = spark.range(3)
    A.write_once(rows, str(tmp_path / "x"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        A.write_once(rows, str(tmp_path / "x"))


def test_cohorts_and_their_receipt(spark, tmp_path):
    rows = spark.range(10).select("id", (F.col("id") % 2).cast("string").alias("split"))
    receipt = A.write_cohorts(rows, str(tmp_path / "c"), ["split"])
    assert sorted(r.rows for r in receipt.collect()) == [5, 5]
    assert sorted(map(tuple, receipt.collect())) == sorted(map(tuple, A.cohort_receipt(rows, ["split"]).select(*receipt.columns).collect()))


def test_aliases(spark):
    t = spark.createDataFrame([(1, "x")], "ID long, Class_Name string")
    aliases = {"id": ["image_id"], "label": ["class_name"]}
    assert A.resolve_columns(t, aliases).columns == ["id", "label"] and A.fitness(t, aliases) == 2


def test_incremental_run_does_each_row_once(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    once = lambda s=state: resume(spark, source, "id long, v long", target, s, "id", "v1", lambda d: d.withColumn("w", F.col("v") * 2))
    spark.range(5).select("id", F.col("id").alias("v")).write.parquet(source)
    once()
    spark.range(3, 9).select("id", F.col("id").alias("v")).write.mode("append").parquet(source)
    once()
    once()
    once(str(tmp_path / "lost state"))
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == list(range(9))


def test_digests_hold_no_group(spark):
    rows = [(k, None if k % 5 == 0 else "ab"[k % 2]) for k in range(25_000)]
    table = spark.createDataFrame(rows, "id long, split string").repartition(5)
    for by in ((), ("split",)):
        out = fingerprint(table, "id", by=by)
        plan = out._jdf.queryExecution().toString()
        assert "collect_list" not in plan and "MapInArrow" in plan
        want = {}
        for k, g in rows:
            want.setdefault(g if by else None, []).append(str(k))
        assert {r["split"] if by else None: r.digest for r in out.collect()} == {g: hashlib.sha256("\n".join(x).encode()).hexdigest() for g, x in want.items()}
    none = table.limit(0)
    assert [r.digest for r in fingerprint(none, "id").collect()] == [hashlib.sha256(b"").hexdigest()] and fingerprint(none, "id", by=("split",)).count() == 0


def test_action_columns_are_bounded(spark, tmp_path):
    spark.range(7000).selectExpr("id AS user_id", "'click' AS event_type").write.parquet(str(tmp_path / "events.parquet"))
    columns = q_files._columns(spark, str(tmp_path))
    assert columns.selectExpr("max(size(ann_id)) AS n").first().n <= 1000
    assert A.column_actions(columns).where("actions = array('sit')").count() == 7000
