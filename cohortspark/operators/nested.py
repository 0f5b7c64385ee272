"""Nested selection of heads that can be stopped and taken up again: every finished fit is an entry of an append-only ledger."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, as_completed
from functools import reduce

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions.fields import merkle
from cohortspark.operators import heads as Z
from cohortspark.operators import metrics as M
from cohortspark.operators import splits as J
from cohortspark.sources.tables import materialize, scratch_folder

KEYS = ["family", "outer_fold", "candidate"]
ENTRY = "family string, outer_fold int, candidate string, n bigint, accuracy double, macro_f1 double, log_loss double"
HELD_OUT = "family string, outer_fold int, id {id}, y int, p array<double>"


class Ledger:
    """Finished fits under one contract: a row in a folder of its own for each, in ``inner`` or ``outer``.

    Nothing is ever changed: a fit is there or not. A folder that a lost driver left without its row is written again. Entries of other
    contracts lie beside it and are not read.
    """

    def __init__(self, spark: SparkSession, path: str, contract: str):
        self.spark, self.root = spark, f"{path.rstrip('/')}/contract={contract}"

    def folder(self, kind: str, *key: object) -> str:
        return f"{self.root}/{kind}/{hashlib.sha256(json.dumps(key).encode()).hexdigest()[:32]}"

    def read(self, kind: str, schema: str = ENTRY) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.root}/{kind}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def add(self, kind: str, row: tuple) -> None:
        self.spark.createDataFrame([row], ENTRY).coalesce(1).write.mode("overwrite").parquet(self.folder(kind, *row[:3]))

    def missing(self, kind: str, declared: DataFrame) -> list:
        """The declared fits without an entry, as many as are declared at most."""
        return declared.join(self.read(kind).select(*KEYS).hint("merge"), KEYS, "left_anti").orderBy(*KEYS).collect()


def contract_of(rows: DataFrame, families: dict[str, dict[str, dict]], **settings: object) -> str:
    """Digest of the rows, in any order, and of all that was declared."""
    root = merkle(rows.select("id", "grp", "y", "features"), ["id", "grp", "y", "features"]).where("prefix = ''").first()
    told = json.dumps([families, settings, root["digest"] if root else ""], sort_keys=True)
    return hashlib.sha256(told.encode()).hexdigest()[:32]


def folded(rows: DataFrame, outer: int, inner: int) -> DataFrame:
    """Adds ``outer_fold`` and ``inner``, a map from each other outer fold to the row's fold among its training rows. Groups stay whole."""
    base = materialize(J.group_folds(rows, "grp", outer).withColumnRenamed("fold", "outer_fold"))
    own = [J.group_folds(base.where(F.col("outer_fold") != k).select("grp"), "grp", inner).distinct().withColumn("k", F.lit(k)) for k in range(outer)]
    dealt = reduce(DataFrame.unionByName, own).groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("k", "fold"))).alias("inner"))
    return materialize(base.join(dealt.hint("merge"), "grp"))


def scores(out: DataFrame, classes: int) -> tuple[int, float, float, float]:
    """(n, accuracy, macro F1, log loss) in one pass; the driver holds a cell for each label and prediction."""
    loss = -F.ln(F.greatest(M.of_label(), F.lit(M.EPS)))
    cells = M.with_prediction(out).groupBy("y", "pred").agg(F.count("*").alias("n"), F.sum(loss).alias("loss")).collect()
    m = np.zeros((classes, classes))
    for c in cells:
        m[c.y, c.pred] += c.n
    n = int(m.sum())
    f1 = 2 * np.diag(m) / np.maximum(m.sum(0) + m.sum(1), 1)
    return n, float(np.trace(m) / max(n, 1)), float(f1.mean()), sum(c.loss for c in cells) / max(n, 1)


def _side_by_side(work: Callable, todo: list, parallel: int) -> None:
    """Runs ``work`` on each; the first error stops what hasn't begun, and what has finished stays in the ledger."""
    with ThreadPoolExecutor(parallel) as pool:
        jobs = [pool.submit(work, *t) for t in todo]
        try:
            for j in as_completed(jobs):
                j.result()
        finally:
            pool.shutdown(wait=True, cancel_futures=True)


def nested_runs(
    rows: DataFrame, families: dict[str, dict[str, dict]], fit_of: Callable, classes: int, path: str, outer: int = 3, inner: int = 2, parallel: int = 2, version: str = "1"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(selection, scores, held out) of a nested selection in each family, with its ledger below ``path``.

    ``families`` declares settings by family and candidate, ``fit_of(family, settings)`` gives a fit: train rows to a predictor. For each outer
    fold the candidates are scored on inner group folds of the other folds; the best (macro F1, log loss, order of declaration) is
    fitted on all of these and scored on the outer fold. Rows are (id, grp, y, features); those without a group take no part.

    ``parallel`` fits are under way at a time: each keeps plans and results of its many small jobs on the driver.
    A rerun under the same contract (rows, declaration, folds, ``version`` of the code) makes only the fits that the ledger lacks.
    Selection: (family, outer_fold, candidate, n, accuracy, macro_f1, log_loss, selected). Held out: (family, outer_fold, id, y, p).
    """
    spark = rows.sparkSession
    rows = rows.withColumn("y", F.col("y").cast("int"))
    ledger = Ledger(spark, path, contract_of(rows, families, classes=classes, outer=outer, inner=inner, version=version))
    listed = [(f, k, c, at) for f, own in families.items() for k in range(outer) for at, c in enumerate(own)]
    declared = spark.createDataFrame(listed, "family string, outer_fold int, candidate string, place int")
    data = folded(rows, outer, inner)
    train = lambda k: data.where(F.col("outer_fold") != k)

    def score(family: str, k: int, candidate: str, _: int) -> None:
        fit = fit_of(family, families[family][candidate])
        out = Z.out_of_fold(train(k).withColumn("fold", F.col("inner")[k]), fit, inner, 1)
        ledger.add("inner", (family, k, candidate, *scores(out, classes)))

    _side_by_side(score, ledger.missing("inner", declared), parallel)
    order = F.struct(-F.round("macro_f1", 9), F.round("log_loss", 9), "place")
    tried = declared.join(ledger.read("inner").hint("merge"), KEYS)
    best = tried.groupBy("family", "outer_fold").agg(F.min_by("candidate", order).alias("candidate"))

    def hold_out(family: str, k: int, candidate: str) -> None:
        predict = fit_of(family, families[family][candidate])(train(k))
        at = ledger.folder("held_out", family, k)
        out = predict(data.where(F.col("outer_fold") == k)).select(F.lit(family).alias("family"), "outer_fold", "id", "y", "p")
        out.write.mode("overwrite").parquet(at)
        ledger.add("outer", (family, k, candidate, *scores(spark.read.schema(out.schema).parquet(at), classes)))

    _side_by_side(hold_out, ledger.missing("outer", best.select(*KEYS)), parallel)
    done = ledger.read("outer")
    chosen = done.select(*KEYS, F.lit(True).alias("_s"))
    selection = tried.drop("place").join(chosen.hint("merge"), KEYS, "left").withColumn("selected", F.coalesce("_s", F.lit(False))).drop("_s")
    held = ledger.read("held_out", HELD_OUT.format(id=rows.schema["id"].dataType.simpleString()))
    return selection, done, held.join(done.select("family", "outer_fold").hint("merge"), ["family", "outer_fold"], "left_semi")


def heads_of(classes: int) -> Callable:
    """Families of this library's heads: "flat" and "factorised", settings as ``fit_head`` takes them."""
    return lambda family, settings: Z.flat(classes, **settings) if family == "flat" else lambda train: Z.fit_factorised(train, **settings)


def nested(rows: DataFrame, classes: int, grid: list[float], outer: int = 3, inner: int = 2, path: str | None = None) -> DataFrame:
    """(outer_fold, c, accuracy, macro_f1): C chosen on inner group folds of the other outer folds, scored on the outer fold."""
    families = {"flat": {f"c={c}": {"c": c} for c in sorted(grid)}}
    done = nested_runs(rows, families, heads_of(classes), classes, path or scratch_folder(rows.sparkSession), outer, inner)[1]
    return done.select("outer_fold", F.substring("candidate", 3, 30).cast("double").alias("c"), "accuracy", "macro_f1")
