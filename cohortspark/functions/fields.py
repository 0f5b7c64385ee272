"""Scalar column work: canonical texts, boxes, action sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.sources.tables import materialize

#: Spellings of splits.
SPLITS = {"train": "train", "training": "train", "valid": "val", "validation": "val", "val": "val", "test": "test", "testing": "test", "trainval": "train_val", "train_val": "train_val"}


def split_name(c: Column | str) -> Column:
    """Canonical split, null if the trimmed, lowered text is no known spelling."""
    known = F.create_map(*[F.lit(x) for kv in SPLITS.items() for x in kv])
    return F.try_element_at(known, F.lower(F.trim(c)))


def class_index(c: Column | str, classes: list[str]) -> Column:
    """Place in ``classes``, null if it isn't one of them."""
    at = F.array_position(F.array(*[F.lit(x) for x in classes]), F.col(c) if isinstance(c, str) else c)
    return F.when(at > 0, at - 1)


def source_name(c: Column | str) -> Column:
    """Name of the source picture: no leading [category]_, lower case (by ASCII rules), pages of one asset alike."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"^\[[^\]]*\]_", "")
    return F.regexp_replace(bare, r"getty_p\d+_", "getty_asset_")


def image_number(c: Column | str) -> Column:
    """The number of an id that may be written as tensor(123)."""
    inner = F.regexp_extract(c, r"^\s*tensor\(\s*(-?\d+)[^)]*\)\s*$", 1)
    return F.when(inner != "", inner).otherwise(F.trim(c))


def has_token(c: Column | str, token: str, mark: str = "|") -> Column:
    """Whether a list written with ``mark`` between its tokens holds ``token``."""
    return F.array_contains(F.transform(F.split(c, "\\" + mark), lambda x: F.trim(x)), token)


def rounded(c: Column | str, places: int) -> Column:
    """A double to ``places``, as SQL engines round: the nearest whole multiple of the double product, halves away from zero.

    Spark's own rounds the shortest decimal of the value, so it differs where that ends in a 5 which the product doesn't reach.
    """
    unit = 10.0**places
    return F.round((F.col(c) if isinstance(c, str) else c) * unit, 0) / unit


def clip(c: Column, low, high) -> Column:
    return F.greatest(F.least(c, high), low)


def clean_boxes(rows: DataFrame, min_side: int = 1) -> DataFrame:
    """Adds clipped corners (x0, y0, x1, y1), was_clipped, valid, area_fraction, eligible, exclusion_reason ('' if none)."""
    zero = F.lit(0)
    out = (
        rows.withColumn("x0", clip(F.col("xmin"), zero, F.col("w"))).withColumn("y0", clip(F.col("ymin"), zero, F.col("h")))
        .withColumn("x1", clip(F.col("xmax"), zero, F.col("w"))).withColumn("y1", clip(F.col("ymax"), zero, F.col("h")))
    )
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return (
        out.withColumn("was_clipped", (F.col("x0") != F.col("xmin")) | (F.col("y0") != F.col("ymin")) | (F.col("x1") != F.col("xmax")) | (F.col("y1") != F.col("ymax")))
        .withColumn("valid", (wide >= min_side) & (high >= min_side))
        .withColumn("area_fraction", F.when(F.col("valid"), wide * high / (F.col("w") * F.col("h"))).otherwise(0.0))
        .withColumn("exclusion_reason", F.when(~F.col("valid"), "invalid_person_box").otherwise(""))
        .withColumn("eligible", F.col("exclusion_reason") == "")
    )


def geometry(rows: DataFrame) -> DataFrame:
    """Adds aspect, centre and height from corners x0 … y1, and ``geometry``: log area, log aspect, centre, log height, distance of the centre to the edge."""
    wide, high = F.greatest(F.col("x1") - F.col("x0"), F.lit(1)), F.greatest(F.col("y1") - F.col("y0"), F.lit(1))
    out = rows.withColumns({"aspect": wide / high, "cx": (F.col("x0") + F.col("x1")) / 2 / F.col("w"), "cy": (F.col("y0") + F.col("y1")) / 2 / F.col("h"), "pixel_height": high})
    area = F.least(F.greatest(wide * high / (F.col("w") * F.col("h")), F.lit(1e-8)), F.lit(1.0))
    edge = F.least("cx", 1 - F.col("cx"), "cy", 1 - F.col("cy"))
    return out.withColumn("geometry", F.array(F.ln(area), F.ln("aspect"), "cx", "cy", F.ln(high), edge))


def inspected(rows: DataFrame) -> DataFrame:
    """``clean_boxes`` for files that were opened: (…, w, h as declared, file_w, file_h, decode_ok). Boxes are clipped to the file's own size;
    adds dimension_match, and a file that can't be decoded is excluded before its box is looked at."""
    own = rows.withColumns({"dimension_match": F.coalesce((F.col("w") == F.col("file_w")) & (F.col("h") == F.col("file_h")), F.lit(False)), "w": F.col("file_w"), "h": F.col("file_h")})
    failed = ~F.coalesce(F.col("decode_ok"), F.lit(False))
    out = clean_boxes(own)
    return out.withColumn("exclusion_reason", F.when(failed, "decode_failure").otherwise(F.col("exclusion_reason"))).withColumn("eligible", F.col("exclusion_reason") == "")


def pose(points: str, skeleton: list[tuple[int, int]]) -> Column:
    """Features of key points (array of structs x, y, v: 0 not labelled, 1 hidden, 2 visible) in the box with corners x0 … y1.

    Per point: place in the box (0 if not labelled), labelled, visible; per bone of ``skeleton``: steps in x and y, length, whether both
    ends are labelled; then the shares of labelled and visible points and the mean place of the labelled ones.
    """
    wide, high = (F.greatest((F.col(b) - F.col(a)).cast("double"), F.lit(1.0)) for a, b in (("x0", "x1"), ("y0", "y1")))
    flag = lambda c: c.cast("double")
    own = F.transform(
        points,
        lambda q: F.struct(
            F.when(q["v"] > 0, (q["x"] - F.col("x0")) / wide).otherwise(0.0).alias("x"), F.when(q["v"] > 0, (q["y"] - F.col("y0")) / high).otherwise(0.0).alias("y"),
            flag(q["v"] > 0).alias("l"), flag(q["v"] == 2).alias("s"),
        ),
    )

    def features(own: Column) -> Column:
        base = F.flatten(F.transform(own, lambda q: F.array(q["x"], q["y"], q["l"], q["s"])))

        def bone(a: int, b: int) -> list[Column]:
            both = own[a]["l"] * own[b]["l"]
            dx, dy = (F.when(both > 0, own[b][c] - own[a][c]).otherwise(0.0) for c in ("x", "y"))  # no zero with a sign
            return [dx, dy, F.sqrt(dx * dx + dy * dy), both]

        add = lambda name: F.aggregate(own, F.lit(0.0), lambda s, q: s + q[name])
        n = F.size(own)
        middle = [F.coalesce(F.try_divide(add(c), add("l")), F.lit(0.0)) for c in ("x", "y")]  # places of points that aren't labelled are 0
        return F.concat(base, F.array(*[c for a, b in skeleton for c in bone(a, b)], add("l") / n, add("s") / n, *middle))

    return F.transform(F.array(own), features)[0]  # the points' places are worked out once a row


def five_features(mode: str) -> Column:
    """Five of the ``geometry`` features: "edge" leaves out the height, "height" the distance to the edge."""
    g = F.col("geometry")
    return F.slice(g, 1, 5) if mode == "height" else F.array(*[g[k] for k in (0, 1, 2, 3, 5)])


def context_box(fraction: float) -> list[Column]:
    """Corners of the box grown by ``fraction`` of its sides, rounded outwards and clipped: cx0, cy0, cx1, cy1."""
    dx, dy = (F.col("x1") - F.col("x0")) * fraction, (F.col("y1") - F.col("y0")) * fraction
    zero = F.lit(0)
    return [
        F.greatest(F.floor(F.col("x0") - dx), zero).alias("cx0"), F.greatest(F.floor(F.col("y0") - dy), zero).alias("cy0"),
        F.least(F.ceil(F.col("x1") + dx), F.col("w")).alias("cx1"), F.least(F.ceil(F.col("y1") + dy), F.col("h")).alias("cy1"),
    ]


#: Name, shift of x and y as a share of the sides, scale.
PERTURBATIONS = [
    ("none", 0.0, 0.0, 1.0),
    ("shift_left_05", -0.05, 0.0, 1.0),
    ("shift_right_05", 0.05, 0.0, 1.0),
    ("shift_up_05", 0.0, -0.05, 1.0),
    ("shift_down_05", 0.0, 0.05, 1.0),
    ("scale_090", 0.0, 0.0, 0.90),
    ("scale_110", 0.0, 0.0, 1.10),
]


def perturbed(rows: DataFrame) -> DataFrame:
    """One row per box and declared perturbation: px0 … py1 (clipped), input_area (share of the picture), too_small (a side under a pixel)."""
    table = F.explode(F.array(*[F.struct(F.lit(n).alias("perturbation"), F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(s).alias("scale")) for n, a, b, s in PERTURBATIONS]))
    out = rows.select("*", table.alias("q")).select("*", "q.perturbation")
    for axis, size in (("x", "w"), ("y", "h")):
        side = F.col(f"{axis}1") - F.col(f"{axis}0")
        middle, half = (F.col(f"{axis}0") + F.col(f"{axis}1")) / 2 + F.col(f"q.d{axis}") * side, F.col("q.scale") * side / 2
        out = out.withColumns({f"p{axis}0": F.greatest(middle - half, F.lit(0.0)), f"p{axis}1": F.least(middle + half, F.col(size).cast("double"))})
    wide, high = F.col("px1") - F.col("px0"), F.col("py1") - F.col("py0")
    return out.withColumn("input_area", wide * high / (F.col("w") * F.col("h"))).withColumn("too_small", (wide < 1) | (high < 1)).drop("q")


def projected_box(fraction: float | None = None, resize: int = 256, crop: int = 224) -> list[Column]:
    """Box corners in the model's input: the picture (or the box grown by ``fraction``) with its shorter side at ``resize``, the middle ``crop`` square of it."""
    left, top, right, bottom = context_box(fraction) if fraction is not None else (F.lit(0), F.lit(0), F.col("w"), F.col("h"))
    wide, high = right - left, bottom - top
    scale = F.lit(float(resize)) / F.least(wide, high)
    shift = lambda side: F.floor((F.floor(side * scale) - crop) / 2)
    at = lambda c, off, side: (F.col(c) - off) * scale - shift(side)
    x0, y0 = (clip(F.floor(at(c, off, side)), F.lit(0), F.lit(crop - 1)) for c, off, side in (("x0", left, wide), ("y0", top, high)))
    x1, y1 = (F.least(F.greatest(F.ceil(at(c, off, side)), first + 1), F.lit(crop)) for c, off, side, first in (("x1", left, wide, x0), ("y1", top, high, y0)))
    return [x0.alias("vx0"), y0.alias("vy0"), x1.alias("vx1"), y1.alias("vy1")]


#: The target actions.
ACTIONS = ["sit", "stand", "walk", "run"]


def factorise_actions(c: str = "actions") -> dict[str, Column]:
    """posture, motion, gait, both labels and two flags of a set of actions; ambiguous sets are kept, an empty set or an unknown action gives null throughout."""
    sit, stand, walk, run = (F.array_contains(c, a) for a in ACTIONS)
    known = (F.size(c) > 0) & (F.size(F.array_except(c, F.array(*[F.lit(a) for a in ACTIONS]))) == 0)
    both, moves = sit & stand, walk | run
    gait = F.when(walk & run, "ambiguous").when(walk, "walking").when(run, "running").otherwise("not_applicable")
    rest = F.when(both, "").when(sit, "sitting").otherwise("standing")
    out = {
        "posture": F.when(both, "ambiguous").when(sit, "seated").otherwise("upright"),
        "motion": F.when(moves, "locomoting").when(both, "ambiguous").otherwise("stationary"),
        "gait": gait,
        "label_3": F.when(moves, "walking_running").otherwise(rest),
        "label_4": F.when(walk & run, "").when(moves, gait).otherwise(rest),
        "legacy_eligible": ~both,
        "factorized_clear": ~both,
    }
    return {k: F.when(known, v).alias(k) for k, v in out.items()}


def exclusive_label(c: str = "actions") -> dict[str, Column]:
    """coarse and fine label by precedence: motion wins over posture, two motions have no fine label, sitting with standing has none at all."""
    sit, stand, walk, run = (F.array_contains(c, a) for a in ACTIONS)
    still = F.when(sit & stand, None).when(sit, "sitting").when(stand, "standing")
    fine = F.when(walk & run, None).when(walk, "walking").when(run, "running").otherwise(still)
    return {"coarse": F.when(walk | run, "walking_running").otherwise(still).alias("coarse"), "fine": fine.alias("fine")}


def tag_group(c: str = "actions") -> Column:
    """Which tags a set of actions holds: sitting alone, standing alone, motion with or without a tag for standing."""
    alone = lambda a: (F.size(c) == 1) & F.array_contains(c, a)
    return F.when(alone("sit"), "sit").when(alone("stand"), "stand_only").when(F.array_contains(c, "stand") & F.arrays_overlap(c, F.array(F.lit("walk"), F.lit("run"))), "locomotion_with_stand_cotag").otherwise("locomotion_without_stand_cotag")


def quartile(rows: DataFrame, value: str, name: str = "quartile", by: tuple = ()) -> DataFrame:
    """Adds the right-closed quartile 1 … 4 of ``value`` by interpolated cut points (three numbers per group); equal cut points are an error."""
    from cohortspark.operators.quantiles import quantiles

    cuts = quantiles(rows, value, [0.25, 0.5, 0.75], by, "_c")
    sure = F.when((F.col("_c")[0] < F.col("_c")[1]) & (F.col("_c")[1] < F.col("_c")[2]), F.col("_c")).otherwise(F.raise_error(F.lit("quartile borders coincide")).cast("array<double>"))
    cuts = cuts.withColumn("_c", sure)
    out = rows.join(cuts.hint("merge"), list(by)) if by else rows.join(F.broadcast(cuts))
    v = F.col(value)
    return out.withColumn(name, F.when(v <= F.col("_c")[0], 1).when(v <= F.col("_c")[1], 2).when(v <= F.col("_c")[2], 3).otherwise(4)).drop("_c")


def strata(rows: DataFrame, edge: float = 1.0) -> DataFrame:
    """Adds people (boxes of the image), occupancy and boundary (whether the box comes within ``edge`` pixels) for boxes with corners x0 … y1."""
    n = rows.groupBy("image_id").agg(F.count("*").alias("people"))
    near = (F.col("x0") <= edge) | (F.col("y0") <= edge) | (F.col("x1") >= F.col("w") - edge) | (F.col("y1") >= F.col("h") - edge)
    return rows.join(n.hint("merge"), "image_id").withColumn("occupancy", F.when(F.col("people") == 1, "single_person").otherwise("multiple_people")).withColumn("boundary", F.when(near, "touches_boundary").otherwise("interior_box"))


def _digests(width: int):
    """Running digests over batches in order: ``width`` group columns, then the line. One row per group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, now, state = [], None, None
        ended, first = [], True
        names = None

        def out():
            columns = [pa.array([g[i] for g, _ in ended], kinds[i]) for i in range(width)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([x for _, x in ended], pa.string())], [*(names or []), "digest"])

        for batch in batches:
            kinds, names = [batch.schema.field(i).type for i in range(width)], batch.schema.names[:width]
            lines = batch.column(width).to_pylist()
            groups = list(zip(*[batch.column(i).to_pylist() for i in range(width)], strict=True)) if width else [()] * len(lines)
            k = 0
            while k < len(lines):
                end = k
                while end < len(lines) and groups[end] == groups[k]:
                    end += 1
                if state is None or groups[k] != now:
                    if state is not None:
                        ended.append((now, state.hexdigest()))
                    state, first = hashlib.sha256(), True
                now = groups[k]
                state.update(("" if first else "\n").encode() + "\n".join(lines[k:end]).encode())
                first, k = False, end
            if ended:
                yield out()
                ended.clear()
        if state is not None:
            ended.append((now, state.hexdigest()))
            yield out()

    return run


def fingerprint(rows: DataFrame, key: str, columns: list[str] | None = None, by: tuple = ()) -> DataFrame:
    """(by, digest): SHA-256 of the rows' texts in order of the key, one to a line.

    A group's rows are sorted (on disk, where they don't fit) and run through the digest in batches, so no row or task holds a group.
    """
    lines = rows.select(*by, F.col(key).alias("_k"), F.concat_ws("|", *(columns or [key])).alias("_v"))
    ordered = (lines.repartition(*by) if by else lines.repartition(1)).sortWithinPartitions(*by, "_k", "_v").select(*by, "_v")
    out = ordered.mapInArrow(_digests(len(by)), T.StructType([*(ordered.schema[c] for c in by), T.StructField("digest", T.StringType())]))
    return out if by else out.agg(F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("digest"))


def fingerprint_large(rows: DataFrame, key: str, columns: list[str] | None = None, parts: int = 256) -> DataFrame:
    """(digest): a digest of the digests of ``parts`` hash parts, which a large table needs; not equal to ``fingerprint``."""
    part = F.pmod(F.xxhash64(key), F.lit(parts)).alias("part")
    inner = fingerprint(rows.withColumn("part", part), key, columns, ("part",))
    return fingerprint(inner, "part", ["part", "digest"])


def merkle(rows: DataFrame, columns: list[str], by: tuple = (), digits: tuple[int, ...] = (4, 2)) -> DataFrame:
    """(by, prefix, digest): the hash tree of a group's rows, its root with an empty prefix; the same for the same rows in any order.

    A row's hash is of its columns, one to a field; equal rows are one entry with a count. Entries are dealt by the first hexadecimal digits of
    their hash, a node's digest is of its entries in order, and nodes by fewer digits are of the digests below, so a task holds no group,
    only one node's entries: a group's rows over 16 ** ``digits[0]``. Nulls count as a field of their own.
    """
    by = list(by)
    fields = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    h = F.sha2(F.concat_ws("|", *fields), 256)
    entries = rows.groupBy(*by, h.alias("prefix")).agg(F.count("*").cast("string").alias("digest"))
    levels = []
    for n in (*digits, 0):
        text = F.concat("prefix", F.lit(":"), "digest")
        entries = entries.groupBy(*by, F.substring("prefix", 1, n).alias("node")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(text)), "\n"), 256).alias("digest"))
        entries = materialize(entries.withColumnRenamed("node", "prefix"))
        levels.append(entries)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def merkle_changes(a: DataFrame, b: DataFrame, by: tuple = ()) -> DataFrame:
    """(by, prefix) of the nodes of two trees that differ or that one of them lacks. Only rows below the longest prefixes need comparing."""
    same = F.col("a.prefix") == F.col("b.prefix")
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    both = a.alias("a").join(b.alias("b").hint("merge"), same, "full").where(~F.col("a.digest").eqNullSafe(F.col("b.digest")))
    return both.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in by], F.coalesce("a.prefix", "b.prefix").alias("prefix"))
