"""Registered queries: scans, contracts and receipts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.plans.q_metrics import r
from cohortspark.sources import files as A
from cohortspark.sources import fixtures as X
from cohortspark.sources.tables import scratch_root, table

MAN = f"WITH {X.MANIFEST}"


def documents(s, d):
    """Annotation documents made from orders: one or two persons, actions from the key."""
    o = F.col("o_orderkey")
    on = lambda k: F.when(o % 7 == k, 1).otherwise(F.when((o % 11 == 0) & (k == 1), 1).otherwise(0))
    acts = F.create_map(*[x for k, a in enumerate(("walk", "run", "sit", "jump")) for x in (F.lit(a), on(k))])
    box = F.struct((o % 150).cast("int").alias("xmin"), (o % 130).cast("int").alias("ymin"), (o % 150 + 20).cast("int").alias("xmax"), (o % 130 + o % 3).cast("int").alias("ymax"))
    person = F.struct(acts.alias("actions"), box.alias("bndbox"))
    return table(s, d, "orders").select(
        F.concat(F.lit("img_"), "o_orderkey").alias("filename"), F.when(o % 50 == 0, "").otherwise(F.concat(F.lit("src_"), F.col("o_custkey").cast("string"))).alias("originalname"),
        F.lit(640).alias("width"), F.lit(480).alias("height"), F.when(o % 13 == 0, F.array(person, person)).otherwise(F.array(person)).alias("persons"),
    )


_ON = "CASE WHEN o_orderkey % 13 = 0 THEN 2 ELSE 1 END * (CASE WHEN k = 0 THEN 1 ELSE 0 END + CASE WHEN k = 1 OR o_orderkey % 11 = 0 THEN 1 ELSE 0 END)"
DOCS = "WITH d AS (SELECT *, o_orderkey % 7 AS k, 'img_' || o_orderkey AS filename FROM orders)"


BLOCK = 1000  # annotations to an array


def _columns(s, d):
    """(action, ann_id, image_id, label): per action and block of users three parallel arrays."""
    e = table(s, d, "events").select("user_id", X.action_of().alias("a")).distinct()
    every = e.select("user_id").distinct().select("user_id", F.explode(F.array(*[F.lit(x) for x in ("sit", "stand", "walk", "run")])).alias("a"))
    rows = every.join(e.withColumn("on", F.lit(1)).hint("merge"), ["user_id", "a"], "left").withColumn("on", F.coalesce("on", F.lit(0)))
    arrays = rows.groupBy(F.col("a").alias("action"), F.floor(F.col("user_id") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("user_id", "on"))).alias("z"))
    return arrays.select("action", F.col("z.user_id").alias("ann_id"), F.transform("z.user_id", lambda u: u % 20).alias("image_id"), F.col("z.on").alias("label"))


def _column_actions(s, d):
    return A.column_actions(_columns(s, d))


def _instances(s, d, part):
    ann = X.boxes(s, d).select(F.col("person_id").alias("annotation"), F.col("image_id").alias("image"), "xmin")
    images = X.boxes(s, d).select(F.col("image_id").alias("image"), "w", "h").distinct()
    wanted = table(s, d, "lineitem").select((F.col("l_orderkey") + F.col("l_suppkey")).alias("annotation")).distinct()
    return A.instances(ann, images, wanted)[part]


def _csv(s, d):
    """A manifest written as CSV to the shared folder and read back: empty fields and leading zeros survive."""
    import uuid

    path = f"{scratch_root(s)}/csv-{uuid.uuid4().hex}"
    m = X.manifest(s, d).select(F.format_string("%06d", "id").alias("id"), F.col("original_name").alias("path"), "label", "split", "sha256", F.lit(None).cast("string").alias("phash"), F.when(F.col("id") % 5 == 0, "dup").otherwise("").alias("exclusion_reason"))
    A.write_csv(m, path)
    return A.read_manifest(s, path).select("id", "label", "split", "sha256", "exclusion_reason")


def _resume(s, d):
    m = X.manifest(s, d).select("id", "sha256", "label")
    done = m.where("id % 3 = 0").select("id", "sha256", F.when(F.col("id") % 2 == 0, "v1").otherwise("v0").alias("contract"))
    return A.unfinished(m, done, "id", "v1").select("id", "label")


def _persons(s, d):
    b = X.boxes(s, d).select("person_id", "image_id", "label", "split")
    out = A.person_manifest({k: b.where(F.col("split") == k).drop("split") for k in ("train", "val", "test")}, "person_id", "image_id")
    return out.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("grp").alias("images"))


QUERIES = {
    "csv_manifest": (_csv, f"{MAN} SELECT printf('%06d', id) AS id, label, split, sha256, CASE WHEN id % 5 = 0 THEN 'dup' ELSE '' END AS exclusion_reason FROM manifest"),
    "admitted_columns": (lambda s, d: A.admitted(X.manifest(s, d).withColumn("split", F.when(F.col("split") == "test", "val").otherwise(F.col("split"))), ["id", "label"]), f"{MAN} SELECT id, label FROM manifest"),
    "target_rows": (lambda s, d: A.target_rows(documents(s, d), ["walk", "run"]).select("filename", "status", "label", F.col("box.xmin").alias("xmin")),
        f"{DOCS}, n AS (SELECT *, {_ON} AS n FROM d) SELECT filename, CASE WHEN n = 1 THEN 'target' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS status, CASE WHEN n = 1 THEN CASE WHEN k = 0 THEN 'walk' ELSE 'run' END END AS label, CASE WHEN n = 1 THEN o_orderkey % 150 END AS xmin FROM n"),
    "strict_errors": (lambda s, d: A.strict_errors(documents(s, d), ["jump", "run", "sit", "walk"]),
        f"""{DOCS}, a AS (SELECT *, CASE WHEN k < 4 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 11 = 0 AND k <> 1 THEN 1 ELSE 0 END AS act FROM d)
SELECT filename, 'persons' AS error FROM a WHERE o_orderkey % 13 = 0 UNION ALL SELECT filename, 'active' FROM a WHERE act <> 1 UNION ALL SELECT filename, 'box' FROM a WHERE o_orderkey % 3 = 0 UNION ALL SELECT filename, 'source' FROM a WHERE o_orderkey % 50 = 0"""),
    "column_actions": (_column_actions, f"WITH {X.ACTIONS} SELECT annotation, image, actions FROM actions"),
    "instance_rows": (lambda s, d: _instances(s, d, 0), f"WITH {X.BOXES} SELECT image_id AS image, person_id AS annotation, xmin, w, h FROM boxes WHERE person_id IN (SELECT l_orderkey + l_suppkey FROM lineitem)"),
    "instance_missing": (lambda s, d: _instances(s, d, 1), "SELECT DISTINCT l_orderkey + l_suppkey AS annotation FROM lineitem WHERE l_orderkey + l_suppkey NOT IN (SELECT o_orderkey FROM orders)"),
    "prediction_scan": (lambda s, d: r(X.preds(s, d).where("model = 'cand' AND split = 'val'").select("id", "y", F.element_at("p", F.col("y") + 1).alias("p_label"))), f"WITH {X.PREDS} SELECT id, y, round(p[y + 1], 6) AS p_label FROM preds WHERE model = 'cand' AND split = 'val'"),
    "feature_contract": (lambda s, d: A.feature_contract(X.vectors(s, d).select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 90 == 1, "other").otherwise("m").alias("model"), F.lit("full").alias("view"), "split", F.when(F.col("vec_id") % 100 == 5, F.slice("features", 1, 10)).otherwise(F.col("features")).alias("features")), "m", "full", 64),
        f"WITH {X.VECTORS} SELECT vec_id AS id, CASE WHEN vec_id % 90 = 1 THEN 'scope' WHEN split = 'test' THEN 'held out' ELSE 'size' END AS problem FROM vectors WHERE vec_id % 90 = 1 OR split = 'test' OR vec_id % 100 = 5"),
    "flattened_summaries": (lambda s, d: r(A.flattened(X.candidates(s, d).select("candidate", F.struct("macro_f1", F.struct("seed", "best_epoch").alias("run")).alias("val")))), f"WITH {X.CANDIDATES} SELECT candidate, round(macro_f1, 6) AS val_macro_f1, seed AS val_run_seed, best_epoch AS val_run_best_epoch FROM candidates"),
    "cohort_receipt": (lambda s, d: A.cohort_receipt(X.manifest(s, d), ["split", "label"]), f"{MAN} SELECT split, label, count(*) AS rows, sha256(string_agg(CAST(id AS VARCHAR), chr(10) ORDER BY id)) AS digest FROM manifest GROUP BY split, label"),
    "portable_manifest": (lambda s, d: A.portable(X.manifest(s, d), ["id", "label"], "images/full", "original_name"), f"{MAN} SELECT id, label, 'images/full/' || original_name AS path FROM manifest"),
    "unfinished_rows": (_resume, f"{MAN} SELECT id, label FROM manifest WHERE NOT (id % 3 = 0 AND id % 2 = 0)"),
    "digest_drift": (lambda s, d: A.digest_drift(X.manifest(s, d), X.manifest(s, d).select("id", F.when(F.col("id") % 40 == 0, F.lit("old")).otherwise(F.col("sha256")).alias("sha256")), "id"), f"{MAN} SELECT id, sha256 AS now, 'old' AS \"then\" FROM manifest WHERE id % 40 = 0"),
    "person_manifest": (_persons, f"WITH {X.BOXES} SELECT split, count(*) AS rows, count(DISTINCT image_id) AS images FROM boxes GROUP BY split"),
    "nested_props": (lambda s, d: r(table(s, d, "events").select("event_type", F.from_json("props", "k int").alias("p"), "value").groupBy("event_type", (F.col("p.k") % 10).alias("bucket")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))), "SELECT event_type, CAST(json_extract(props, '$.k') AS INT) % 10 AS bucket, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL"),
    "resolved_columns": (lambda s, d: A.resolve_columns(table(s, d, "customer").withColumnRenamed("c_mktsegment", "Label_Name"), {"label": ["label_name", "class"], "id": ["c_custkey"]}).groupBy("label").agg(F.count("id").alias("n")), "SELECT c_mktsegment AS label, count(*) AS n FROM customer GROUP BY 1"),
}
