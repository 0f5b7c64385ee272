"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Each source gets a target number of words. A document of a source is due ``target / source_size`` copies; the
whole part is certain, the fractional part is settled by pivotal rounding: two documents with open fractions meet
and words move at random from one to the other until one of them is taken or left whole, so that the expected
copies of every document and the words of the pair stay as they are. Blocks of a source settle on their own and
hand on one open document each; the open ones of many blocks meet on the next level of the tree. The last open
document of a source is taken in part (its first words), so that the source meets its target to the word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.sources.tables import materialize

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(source, source_size, ...) with ``target``: shares of all words by weight, none above ``cap`` times its size.

    Weights go round by code point order of the source, null last. What a source can't take is shared among the
    others by weight until none is above its limit: with sources in order of limit / weight, the first ones fill
    up and the rest lie at one common level. The table has one row per source; its windows see those rows alone.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(names) - 1) % len(weights) + 1).cast("int"))
    everything = Window.partitionBy(F.lit(1))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return (
        sources.withColumn("weight", weight)
        .withColumn("limit", F.col("source_size") * F.lit(float(cap)))
        .withColumn("words", F.sum("source_size").over(everything))
        .withColumn("at", F.row_number().over(order))
        .withColumn("rest", F.col("words") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("rest") / F.col("open"))
        .withColumn("full", F.col("limit") / F.col("weight") < F.col("level"))
        .withColumn("common", F.min(F.when(~F.col("full"), F.struct("at", "level"))).over(everything)["level"])
        .withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(F.coalesce(F.col("common"), F.lit(0.0)) * F.col("weight")))
        .drop("words", "at", "rest", "open", "level", "full", "common", "limit", "weight")
    )


def _settle(items: Column, kind: str, seed: int) -> Column:
    """Pivotal rounding along an array of open items: (open: the last open item, done: the settled ones)."""

    def at(x: Column, p: Column) -> Column:
        return x.withField("p", p).cast(kind)

    def step(acc: Column, j: Column) -> Column:
        i = acc["open"]
        mass_i, mass_j = i["p"] * i["size"], j["p"] * j["size"]
        room_i, room_j = (1 - i["p"]) * i["size"], (1 - j["p"]) * j["size"]
        to_i, to_j = F.least(room_i, mass_j), F.least(mass_i, room_j)
        luck = F.pmod(F.xxhash64(i["h"], j["h"], F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
        gains_i = luck * (to_i + to_j) < to_j
        one, none = F.lit(1.0), F.lit(0.0)
        moved = (
            F.when(gains_i & (room_i <= mass_j), F.struct(at(j, (mass_j - to_i) / j["size"]).alias("open"), at(i, one).alias("done")))
            .when(gains_i, F.struct(at(i, (mass_i + to_i) / i["size"]).alias("open"), at(j, none).alias("done")))
            .when(room_j <= mass_i, F.struct(at(i, (mass_i - to_j) / i["size"]).alias("open"), at(j, one).alias("done")))
            .otherwise(F.struct(at(j, (mass_j + to_j) / j["size"]).alias("open"), at(i, none).alias("done")))
        )
        return F.when(i.isNull(), F.struct(j.cast(kind).alias("open"), acc["done"].alias("done"))).otherwise(
            F.struct(moved["open"].alias("open"), F.concat(acc["done"], F.array(moved["done"])).alias("done"))
        )

    start = F.struct(F.lit(None).cast(kind).alias("open"), F.array().cast(f"array<{kind}>").alias("done"))
    return F.aggregate(items, start, step)


def decide(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 20, block: int = 64) -> DataFrame:
    """How often each document is taken: one row per distinct (doc_id, source, size) with

    ``n`` (equal rows), ``source_size``, ``target``, ``whole`` (copies of each), ``extra`` (rows that get one more),
    ``part`` (words that one further row gives, else 0). ``docs`` has doc_id, source and text; null text has no
    words; documents without words and sources without words take nothing. Random draws are hashes of the ids.
    An empty table gives an empty one; other columns of ``docs`` are ignored.
    """
    items = (
        docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
        .groupBy("doc_id", "source", "size")
        .agg(F.count("*").alias("n"))
    )
    items = materialize(items)
    sources = items.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("items")
    )
    sources = materialize(source_targets(sources, weights, cap))
    per_source = sources.alias("s")
    small = sources.count() <= 100_000
    per_source = F.broadcast(per_source) if small else per_source.hint("merge")
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = (
        items.alias("i")
        .join(per_source, F.col("i.source").eqNullSafe(F.col("s.source")))
        .select("i.*", "source_size", "target", "items", due.alias("due"))
        .withColumn("whole", F.floor(F.least(F.col("due"), F.lit(float(cap))) + 1e-12))
        .withColumn("due", F.col("n") * F.greatest(F.least(F.col("due"), F.lit(float(cap))) - F.col("whole"), F.lit(0.0)))
        .withColumn("extra", F.floor("due"))
        .withColumn("p", F.col("due") - F.col("extra"))
        .drop("due")
    )
    open_ = (F.col("size") > 0) & (F.col("p") > 1e-12)
    fixed = rated.where(~open_).withColumn("part", F.lit(0).cast("long")).drop("items", "p")
    carried = ["doc_id", "source", "size", "n", "source_size", "target", "whole", "extra"]
    state = rated.where(open_).select(*carried, "items", "p", F.xxhash64("doc_id", "size", "source", F.lit(seed)).alias("h"))
    most = sources.agg(F.max("items")).first()[0] or 0
    levels = max(1, math.ceil(math.log(max(most, 2), block)))
    keep = ["h", "doc_id", "size", "n", "whole", "extra", "p"]
    kind = f"struct<{','.join(f'{c}:{state.schema[c].dataType.simpleString()}' for c in keep)}>"
    settled = [fixed]
    for level in range(1, levels + 1):
        blocks = F.ceil(F.col("items") / F.lit(float(block) ** level)).cast("long")
        met = (
            state.withColumn("block", F.pmod(F.xxhash64("h", F.lit(level)), blocks))
            .groupBy("source", "block", "items", "source_size", "target")
            .agg(F.sort_array(F.collect_list(F.struct(*keep))).alias("list"))
            .select("source", "items", "source_size", "target", _settle(F.col("list"), kind, seed + level).alias("got"))
        )
        met = materialize(met)
        done = met.select("source", "source_size", "target", F.explode("got.done").alias("x"))
        settled.append(
            done.select("x.*", "source", "source_size", "target")
            .withColumn("extra", F.col("extra") + F.round("p").cast("long"))
            .withColumn("part", F.lit(0).cast("long"))
        )
        state = met.select("source", "items", "source_size", "target", "got.open.*")
    settled.append(
        state.withColumn("part", F.round(F.col("p") * F.col("size")).cast("long"))
        .withColumn("extra", F.col("extra") + F.when(F.col("part") >= F.col("size"), 1).otherwise(0))
        .withColumn("part", F.when(F.col("part") >= F.col("size"), 0).otherwise(F.col("part")))
    )
    out = settled[0].select(*carried, "part")
    for more in settled[1:]:
        out = out.unionByName(more.select(*carried, "part"))
    return out


def _rows(decisions: DataFrame) -> DataFrame:
    """One row per row of the input: ``k`` counts equal rows from 1."""
    k = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k")
    return (
        decisions.select("*", k)
        .withColumn("copies", F.col("whole") + (F.col("k") <= F.col("extra")).cast("long"))
        .withColumn("part", F.when(F.col("k") == F.col("extra") + 1, F.col("part")).otherwise(F.lit(0).cast("long")))
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, part and taken (= copies * size + part).

    Null doc_ids, sources and texts, repeated rows and empty tables as in ``decide``.
    """
    rows = _rows(decide(docs, **how))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", "copies", "part", (F.col("copies") * F.col("size") + F.col("part")).alias("taken")
    )


def apply_mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed table: whole documents, with all their columns, repeated as often as decided (the word-exact last part is left out).

    ``part`` is rounded to a whole copy where it is at least half of the document, so every text stays whole. Documents
    without words (null or empty text) are taken as often as their source's whole copies say. Equal rows are decided
    together and share their copies; rows of one doc_id, source and size are told apart by their texts' hashes. A null
    doc_id or source is a value like others. An empty table stays empty; columns may have any names.
    """
    half = F.col("part") * 2 >= F.col("size")
    rows = _rows(decide(docs, **how)).withColumn("copies", F.col("copies") + half.cast("long") * (F.col("part") > 0).cast("long"))
    rows = materialize(rows.select("doc_id", "source", "size", "k", "n", "copies"))
    few = rows.count() <= 1_000_000
    keyed = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("h"), F.struct("*").alias("row"))
    on = lambda a, b: (F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.size") == F.col(f"{b}.size")))
    hint = (lambda x: F.broadcast(x)) if few else (lambda x: x.hint("merge"))
    single = keyed.alias("d").join(hint(rows.where("n = 1").alias("m")), on("d", "m")).select("d.row", "m.copies")
    many = keyed.alias("d").join(hint(rows.where("n > 1 AND k = 1").alias("m")), on("d", "m"), "left_semi")
    many = many.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("h")))
    many = many.alias("d").join(hint(rows.where("n > 1").alias("m")), on("d", "m") & (F.col("d.k") == F.col("m.k"))).select("d.row", "m.copies")
    taken = single.unionByName(many).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
