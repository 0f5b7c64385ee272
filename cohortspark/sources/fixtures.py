"""Prediction, manifest, box and other views over the order, document and event tables, and the same views in SQL.

The classes, seeds and scores are integer arithmetic over the keys, so both engines hold exactly the same numbers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.sources.tables import table

CLASSES = 5
MODELS = [("ref", 7, 7, 4, 42), ("cand", 5, 8, 5, 52), ("third", 13, 6, 6, 62)]


def split_of(key: str):
    k = F.col(key) % 10
    return F.when(k < 7, "train").when(k < 8, "val").otherwise("test")


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task, model, seed, id, grp, split, price, yr, y, s, p, pred, conf): one row per model and id."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("grp"),
        F.col("o_totalprice").alias("price"),
        F.year("o_orderdate").alias("yr"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("y"),
    )
    models = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(r).alias("r"), F.lit(d).alias("seed")) for n, a, b, r, d in MODELS]))
    score = lambda k: 1 + (F.col("id") * F.col("m.a") + F.col("grp") * 3 + k * (F.col("id") % 7 + 1)) % 11 + F.when((k == F.col("y")) & (F.col("id") % F.col("m.r") != 0), F.col("m.b")).otherwise(0)
    rows = o.withColumn("m", models).withColumn("s", F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), score))
    total = F.aggregate("s", F.lit(0).cast("bigint"), lambda a, v: a + v)
    return (
        rows.withColumn("total", total)
        .withColumn("p", F.transform("s", lambda v: v / F.col("total")))
        .withColumn("pred", (F.array_position("s", F.array_max("s")) - 1).cast("int"))
        .withColumn("conf", F.array_max("s") / F.col("total"))
        .select(F.lit("orders").alias("task"), "m.model", "m.seed", "id", "grp", split_of("grp").alias("split"), "price", "yr", "y", "s", "p", "pred", "conf")
    )


PREDS = """
m(model, a, b, r, seed) AS (VALUES ('ref', 7, 7, 4, 42), ('cand', 5, 8, 5, 52), ('third', 13, 6, 6, 62)),
o AS (SELECT o_orderkey AS id, o_custkey AS grp, o_totalprice AS price, year(o_orderdate) AS yr, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS y FROM orders),
preds0 AS (SELECT model, seed, id, grp, price, yr, y, CASE WHEN grp % 10 < 7 THEN 'train' WHEN grp % 10 < 8 THEN 'val' ELSE 'test' END AS split,
  list_transform([0, 1, 2, 3, 4], lambda k: 1 + (id * a + grp * 3 + k * (id % 7 + 1)) % 11 + CASE WHEN k = y AND id % r <> 0 THEN b ELSE 0 END) AS s FROM o, m),
preds AS (SELECT *, list_transform(s, lambda v: v / list_sum(s)) AS p, list_position(s, list_max(s)) - 1 AS pred, list_max(s) / list_sum(s) AS conf FROM preds0)"""


#: A byte's bits, each in 16 bits of its own, as two numbers; words that are summed so at a time, too few to overflow.
LANES, SUMMED = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype("<u2").view("<u8"), 1 << 15


@F.arrow_udf(T.LongType())
def _voted(texts: pa.Array) -> pa.Array:
    """32-bit SimHash of the distinct words between blanks, 0 without words; each word of a batch is digested once, and no row leaves its task."""
    words = pc.split_pattern(texts, " ")
    flat = words.flatten().dictionary_encode()
    known = flat.dictionary.cast(pa.binary()) if len(flat.dictionary) else pa.array([b""])
    first = np.frombuffer(b"".join([hashlib.md5(w).digest() for w in known.to_pylist()]), ">u4")[::4].astype("<u4")
    lanes, blank = LANES[first.view(np.uint8).reshape(-1, 4)].reshape(-1, 8), pc.equal(known, b"").to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(words)), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    met = np.sort(row * len(known) + flat.indices.to_numpy(zero_copy_only=False))
    row, word = np.divmod(met[np.concatenate(([True], met[1:] != met[:-1]))[: len(met)]], len(known))
    row, word = row[~blank[word]], word[~blank[word]]
    votes = np.zeros((len(words), 32), np.int64)
    for low in range(0, len(row), SUMMED):
        at = row[low : low + SUMMED]
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        votes[at[starts]] += np.add.reduceat(lanes[word[low : low + SUMMED]], starts, axis=0).view(np.uint16).reshape(-1, 32)
    return pa.array((2 * votes > np.bincount(row, minlength=len(words))[:, None]) @ (1 << np.arange(32)), pa.int64())


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def letter_shares(texts: pa.Array) -> pa.Array:
    """The shares of a to z among a text's characters, in one pass over its bytes; null of a null text."""
    texts = texts.cast(pa.large_string())
    ends, raw = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1], np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    counts = np.zeros((len(texts), 26), np.int64)
    for k, (low, high) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        counts[k] = np.bincount(raw[low:high], minlength=256)[97:123]
    shares = counts / np.maximum(pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False), 1)[:, None]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, 26 * len(texts) + 1, 26, dtype=np.int32)), pa.array(shares.ravel()), mask=texts.is_null())


def simhash(text: Column | str) -> Column:
    """The 32-bit SimHash of a text's distinct lower-cased words between blanks; 0 of a null text or one without words."""
    return F.coalesce(_voted(F.lower(text)), F.lit(0))  # never null, so that a test for null doesn't work it out again


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, split, label, sha256, h32, original_name, text): the documents as a cohort table; h32 is a 32-bit SimHash of the words."""
    d = table(spark, sf_dir, "documents")
    sha = F.sha2("text", 256)
    name = F.concat(F.lit("["), "lang", F.lit("]_getty_p"), F.col("doc_id") % 90, F.lit("_"), F.substring(sha, 1, 8), F.lit("-00"), F.col("doc_id") % 2, F.lit(".jpg"))
    return d.select(F.col("doc_id").alias("id"), split_of("doc_id").alias("split"), F.col("lang").alias("label"), sha.alias("sha256"), simhash("text").alias("h32"), name.alias("original_name"), "text", "source")


MANIFEST = """
words AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents) WHERE w <> ''),
bits AS (SELECT doc_id, i, sum(((CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) >> i) & 1) * 2 - 1) AS b FROM words, range(32) r(i) GROUP BY doc_id, i),
hashed AS (SELECT doc_id, CAST(sum(CASE WHEN b > 0 THEN CAST(1 AS BIGINT) << i ELSE 0 END) AS BIGINT) AS h32 FROM bits GROUP BY doc_id),
manifest AS (SELECT d.doc_id AS id, CASE WHEN d.doc_id % 10 < 7 THEN 'train' WHEN d.doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split, lang AS label,
  sha256(text) AS sha256, coalesce(h32, 0) AS h32,
  '[' || lang || ']_getty_p' || (d.doc_id % 90) || '_' || substr(sha256(text), 1, 8) || '-00' || (d.doc_id % 2) || '.jpg' AS original_name, text, source
  FROM documents d LEFT JOIN hashed USING (doc_id))"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, person_id, w, h, xmin, ymin, xmax, ymax, label): several persons to an image; some boxes lie over the edge."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        c.alias("image_id"), k.alias("person_id"), (200 + c % 400).alias("w"), (200 + c % 300).alias("h"), (k % 150 - 10).alias("xmin"), (k % 130 - 8).alias("ymin"),
        F.substring("o_orderpriority", 3, 20).alias("label"), split_of("o_custkey").alias("split"),
    ).withColumn("xmax", F.col("xmin") + 20 + F.col("person_id") % 180).withColumn("ymax", F.col("ymin") + 20 + F.col("person_id") % 170)


BOXES = """
boxes0 AS (SELECT o_custkey AS image_id, o_orderkey AS person_id, 200 + o_custkey % 400 AS w, 200 + o_custkey % 300 AS h, o_orderkey % 150 - 10 AS xmin, o_orderkey % 130 - 8 AS ymin,
  substr(o_orderpriority, 3, 20) AS label, CASE WHEN o_custkey % 10 < 7 THEN 'train' WHEN o_custkey % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM orders),
boxes AS (SELECT *, xmin + 20 + person_id % 180 AS xmax, ymin + 20 + person_id % 170 AS ymax FROM boxes0)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 10 < 8, "train").otherwise("test").alias("split"), F.col("embedding").alias("features"), "label", (F.col("vec_id") % 50).alias("grp")
    )


VECTORS = """
vectors AS (SELECT vec_id, CASE WHEN vec_id % 10 < 8 THEN 'train' ELSE 'test' END AS split, embedding AS features, label, vec_id % 50 AS grp FROM embeddings)"""


_EVENT_ACTION = {"click": "sit", "view": "stand", "purchase": "walk", "scroll": "run", "error": "stand"}


def action_of(column: str = "event_type"):
    out = F.when(F.col(column) == "click", "sit")
    for k, v in list(_EVENT_ACTION.items())[1:]:
        out = out.when(F.col(column) == k, v)
    return out.otherwise("sit")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(annotation, image, actions): the set of actions each user's events stand for."""
    return (
        table(spark, sf_dir, "events")
        .select(F.col("user_id").alias("annotation"), (F.col("user_id") % 20).alias("image"), action_of().alias("action"))
        .groupBy("annotation", "image")
        .agg(F.array_sort(F.collect_set("action")).alias("actions"))
    )


ACTIONS = """
acted AS (SELECT user_id AS annotation, user_id % 20 AS image, CASE event_type WHEN 'click' THEN 'sit' WHEN 'view' THEN 'stand' WHEN 'purchase' THEN 'walk' WHEN 'scroll' THEN 'run'
  WHEN 'error' THEN 'stand' ELSE 'sit' END AS action FROM events),
actions AS (SELECT annotation, image, list_sort(list(DISTINCT action)) AS actions FROM acted GROUP BY annotation, image)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("candidate"), (F.col("s_nationkey") % 3).alias("family"), (s * 37 % 100 / 100).alias("macro_f1"), (s * 13 % 50 / 100).alias("log_loss"),
        (s * 7 % 20 / 100).alias("ece"), (s % 3 * 10 + 42).alias("seed"), (s % 12 + 1).alias("best_epoch"), (s % 5).alias("complexity"), F.floor(s / 3).alias("run"),
    )


CANDIDATES = """
candidates AS (SELECT s_name AS candidate, s_nationkey % 3 AS family, s_suppkey * 37 % 100 / 100 AS macro_f1, s_suppkey * 13 % 50 / 100 AS log_loss, s_suppkey * 7 % 20 / 100 AS ece,
  s_suppkey % 3 * 10 + 42 AS seed, s_suppkey % 12 + 1 AS best_epoch, s_suppkey % 5 AS complexity, s_suppkey // 3 AS run FROM supplier)"""


def pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), (F.col("p_size") % 5).alias("family"), (F.col("p_partkey") * 31 % 1000 / 1000).alias("p"))


PVALUES = "pvalues AS (SELECT p_partkey AS name, p_size % 5 AS family, p_partkey * 31 % 1000 / 1000 AS p FROM part)"
