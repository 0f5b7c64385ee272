"""Typed scans, contract checks on what is read, and sinks that don't replace evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "id string, path string, label string, split string, sha256 string, phash string, exclusion_reason string"
#: An annotation document: persons with actions switched on or off and a box.
ANNOTATION = (
    "filename string, originalname string, width int, height int, "
    "persons array<struct<actions: map<string, int>, bndbox: struct<xmin: int, ymin: int, xmax: int, ymax: int>>>"
)


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST, empty: tuple[str, ...] = ("exclusion_reason",)) -> DataFrame:
    """A CSV file with a header; ids and digests stay text, and an empty field of ``empty`` columns is '', not null."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in empty if c in rows.columns})


def admitted(rows: DataFrame, allowed: list[str], held_out: tuple[str, ...] = ("test",)) -> DataFrame:
    """The allowed columns, after a look at the split column alone has shown that no row is held out."""
    found = rows.select("split").where(F.lower(F.trim("split")).isin(list(held_out)) | F.col("split").isNull()).limit(1).count()
    if found:
        raise PermissionError("the table holds rows that are held out")
    return rows.select(*allowed)


def read_splits(spark: SparkSession, folder: str) -> DataFrame:
    """(id, split) from text files with an id to a line; the split is the file's name. Blank lines are left out."""
    rows = spark.read.text(folder, recursiveFileLookup=True).select(F.trim("value").alias("id"), F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("split"))
    return rows.where("id <> ''")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANNOTATION).option("multiLine", True).option("recursiveFileLookup", True).json(path)


def target_rows(documents: DataFrame, targets: list[str]) -> DataFrame:
    """(document, label, box) of documents with exactly one enabled target action, and status for all: target, none, ambiguous."""
    on = F.filter(F.map_keys(F.map_filter("p.actions", lambda _, v: v == 1)), lambda a: a.isin(targets))
    persons = documents.select("filename", F.posexplode_outer("persons").alias("k", "p")).select("filename", "k", on.alias("on"), "p.bndbox")
    hits = persons.groupBy("filename").agg(F.sum(F.coalesce(F.size("on"), F.lit(0))).alias("n"), F.max(F.when(F.size("on") > 0, F.struct(F.col("on")[0].alias("label"), "bndbox"))).alias("x"))
    status = F.when(F.col("n") == 1, "target").when(F.col("n") > 1, "ambiguous").otherwise("none")
    return hits.select("filename", status.alias("status"), F.when(F.col("n") == 1, F.col("x.label")).alias("label"), F.when(F.col("n") == 1, F.col("x.bndbox")).alias("box"))


def strict_errors(documents: DataFrame, actions: list[str]) -> DataFrame:
    """(filename, error) of documents that break the strict form: one person, exactly these actions, values 0 or 1, one active, a whole box, a source name."""
    p = F.try_element_at("persons", F.lit(1))
    keys, values = F.array_sort(F.map_keys(p["actions"])), F.map_values(p["actions"])
    box = p["bndbox"]
    rules: list[tuple[str, Column]] = [
        ("persons", F.size("persons") == 1),
        ("actions", keys == F.array(*[F.lit(a) for a in sorted(actions)])),
        ("values", F.forall(values, lambda v: v.isin(0, 1))),
        ("active", F.aggregate(values, F.lit(0), lambda a, v: a + v) == 1),
        ("box", box["xmin"].isNotNull() & box["ymin"].isNotNull() & (box["xmax"] > box["xmin"]) & (box["ymax"] > box["ymin"])),
        ("source", F.trim("originalname") != ""),
    ]
    wrong = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    return documents.select("filename", F.explode(wrong).alias("error"))


def column_actions(table: DataFrame) -> DataFrame:
    """(annotation, image, actions) from rows (action, ann_id, image_id, label): three parallel arrays per action.

    Raises on arrays of unlike lengths, labels other than 0 and 1, and annotations of two images.
    """
    same = (F.size("ann_id") == F.size("image_id")) & (F.size("ann_id") == F.size("label")) & F.forall("label", lambda v: v.isin(0, 1))
    sure = table.withColumn("label", F.when(same, F.col("label")).otherwise(F.raise_error(F.lit("unlike arrays or labels")).cast(table.schema["label"].dataType)))
    rows = sure.select("action", F.explode(F.arrays_zip("ann_id", "image_id", "label")).alias("z")).select("action", "z.*")
    out = rows.groupBy(F.col("ann_id").alias("annotation")).agg(F.min("image_id").alias("image"), F.max("image_id").alias("_i"), F.array_sort(F.collect_set(F.when(F.col("label") == 1, F.col("action")))).alias("actions"))
    one = F.when(F.col("image") == F.col("_i"), F.col("image")).otherwise(F.raise_error(F.lit("an annotation of two images")).cast(out.schema["image"].dataType))
    return out.withColumn("image", one).drop("_i")


def instances(annotations: DataFrame, images: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, missing): annotations of the wanted ids with their image's columns, and wanted ids without one. Repeated ids raise."""
    from cohortspark.operators.pairs import left_checked

    rows = left_checked(annotations.join(wanted.hint("merge"), "annotation", "left_semi"), images, "image")
    return rows, wanted.join(annotations.hint("merge"), "annotation", "left_anti")


def feature_contract(rows: DataFrame, model: str, view: str, size: int) -> DataFrame:
    """(id, problem): rows of another model or view, held out, of another size, or with components that aren't finite."""
    finite = F.forall("features", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    problem = (
        F.when((F.col("model") != model) | (F.col("view") != view), "scope").when(F.col("split") == "test", "held out").when(F.size("features") != size, "size").when(~F.coalesce(finite, F.lit(False)), "not finite")
    )
    return rows.select("id", problem.alias("problem")).where("problem IS NOT NULL")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files under ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def checked_digests(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(path, bytes, sha256, error) of the ``wanted`` paths below ``path``: null, or why a file has no digest: absent or unreadable.

    A file without bytes, which Spark's scan doesn't list, counts as absent. Files are listed without being opened; those that can't be read are passed over by the scan that hashes, and flagged here. One bad
    file fails no other.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    listed = found.select("path", F.col("length").alias("bytes"))
    lenient = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(path)
    hashed = lenient.select("path", F.sha2("content", 256).alias("sha256"))
    both = wanted.select("path").distinct().join(listed.hint("merge"), "path", "left").join(hashed.hint("merge"), "path", "left")
    error = F.when(F.col("bytes").isNull(), "absent").when(F.col("sha256").isNull(), "unreadable")
    return both.select("path", "bytes", "sha256", error.alias("error"))


def run_summaries(spark: SparkSession, folder: str, name: str = "summary.json") -> DataFrame:
    """One flat row per run summary below ``folder``: nested fields as a_b, and the folder as ``run``."""
    rows = spark.read.option("recursiveFileLookup", True).option("multiLine", True).option("pathGlobFilter", name).json(folder).withColumn("run", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    return flattened(rows)


def flattened(rows: DataFrame) -> DataFrame:
    while any(isinstance(f.dataType, T.StructType) for f in rows.schema):
        rows = rows.select(*[c for f in rows.schema for c in ([F.col(f.name)[s.name].alias(f"{f.name}_{s.name}") for s in f.dataType] if isinstance(f.dataType, T.StructType) else [F.col(f.name)])])
    return rows


def write_once(rows: DataFrame, path: str) -> None:
    """Writes Parquet where nothing stands yet, else raises."""
    rows.write.mode("errorifexists").parquet(path)


def write_cohorts(rows: DataFrame, path: str, by: list[str], digest_key: str = "id") -> DataFrame:
    """Writes one table partitioned by ``by`` and returns its receipt: (by, rows, digest)."""
    from cohortspark.functions.fields import fingerprint

    rows.write.mode("errorifexists").partitionBy(*by).parquet(path)
    back = rows.sparkSession.read.schema(rows.schema).parquet(path)
    return back.groupBy(*by).agg(F.count("*").alias("rows")).join(fingerprint(back, digest_key, by=tuple(by)).hint("merge"), by)


def cohort_receipt(rows: DataFrame, by: list[str], key: str = "id") -> DataFrame:
    from cohortspark.functions.fields import fingerprint

    return rows.groupBy(*by).agg(F.count("*").alias("rows")).join(fingerprint(rows, key, by=tuple(by)).hint("merge"), by)


def portable(rows: DataFrame, columns: list[str], folder: str, name: str) -> DataFrame:
    """The columns in order, with ``path`` made relative: folder/name."""
    return rows.select(*columns, F.concat_ws("/", F.lit(folder), F.col(name).cast("string")).alias("path"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("header", True).option("lineSep", "\n").csv(path)


def person_manifest(parts: dict[str, DataFrame], person: str, image: str) -> DataFrame:
    """The rows of all split tables with a split column, keyed by person, the image as group. A person twice is an error."""
    from functools import reduce

    from pyspark.sql import Window

    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn("split", F.lit(s)) for s, t in parts.items()])
    rows = rows.withColumnRenamed(person, "id").withColumnRenamed(image, "grp")
    n = F.count("*").over(Window.partitionBy("id"))
    return rows.withColumn("id", F.when(n == 1, F.col("id")).otherwise(F.raise_error(F.lit("a person stands twice")).cast(rows.schema["id"].dataType)))


def resolve_columns(table: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Renames columns to their canonical names, whatever their case or alias; other columns stay."""
    by_name = {c.lower(): c for c in table.columns}
    for name, others in aliases.items():
        found = next((by_name[a.lower()] for a in [name, *others] if a.lower() in by_name), None)
        if found and found != name:
            table = table.withColumnRenamed(found, name)
    return table


def fitness(table: DataFrame, aliases: dict[str, list[str]]) -> int:
    """How many of the canonical columns a table can give."""
    have = {c.lower() for c in table.columns}
    return sum(any(a.lower() in have for a in [n, *o]) for n, o in aliases.items())


def unfinished(rows: DataFrame, done: DataFrame, key: str, contract: str) -> DataFrame:
    """Rows that no finished chunk of this contract holds."""
    return rows.join(done.where(F.col("contract") == contract).select(key).hint("merge"), key, "left_anti")


def digest_drift(rows: DataFrame, done: DataFrame, key: str, digest: str = "sha256") -> DataFrame:
    """Finished rows whose source has changed since."""
    return rows.select(key, F.col(digest).alias("now")).join(done.select(key, F.col(digest).alias("then")).hint("merge"), key).where("now <> then")
