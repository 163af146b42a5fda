"""Binary images as rows of bytes: reading tables, patching, verifying, comparing and auditing.

An image is (image_id, offset, byte). Many images are handled at once; every
join and window is keyed by image, and one image is 64 KiB. Suggestions and patches
carry ``KEYS``: the image that they are for, and the log and mode that they come
from; a patched image carries them too, so that one plan patches for all logs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revscope.cluster import staged
from revscope.functions import scalars as S

SIZE = 65536
KEYS = ["image_id", "log_id", "mode"]
RPM17 = [float(400 * k) for k in range(17)]
MAP13 = [float(30 + 5 * k) for k in range(13)]
MAP17 = [float(20 + 5 * k) for k in range(17)]
MPH17 = [float(4 * k) for k in range(17)]
TPS17 = [6.25 * k for k in range(17)]
#: Titles that suggestions name, with our own geometry. Geometry of the tables that patches touch: title, address, rows, cols, bits, column labels, row labels, equation.
TABLES = [
    ("Main VE", 0x1000, 17, 13, 16, [f"{v:g}" for v in MAP13], [f"{v:g}" for v in RPM17], "X"),
    ("Idle VE", 0x1200, 7, 13, 16, [f"{v:g}" for v in MAP13], [f"{v:g}" for v in RPM17[:7]], "X"),
    ("Spark Advance", 0x1300, 17, 17, 8, [f"{v:g}" for v in MAP17], [f"{v:g}" for v in RPM17], "X*(90/255)"),
    ("Power Enrichment", 0x1480, 17, 1, 8, ["AFR"], [f"{v:g}" for v in RPM17], "X/10"),
    ("AE vs D-TPS", 0x14A0, 17, 1, 8, ["factor"], [f"{v:g}" for v in TPS17], "X/256"),
    ("AE vs D-MAP", 0x14C0, 17, 1, 8, ["factor"], [f"{v:g}" for v in TPS17], "X/256"),
    ("PE Entry", 0x14E0, 17, 1, 8, ["TPS"], [f"{v:g}" for v in RPM17], "X*(100/255)"),
    ("Normal Upshifts", 0x1500, 17, 3, 8, ["1-2", "2-3", "3-4"], [f"{v:g}" for v in TPS17], "X/2"),
    ("Normal Downshifts", 0x1540, 17, 3, 8, ["2-1", "3-2", "4-3"], [f"{v:g}" for v in TPS17], "X/2"),
    ("Line Pressure Low", 0x1600, 17, 17, 8, [f"{v:g}" for v in MPH17], [f"{v:g}" for v in TPS17], "X"),
    ("Line Pressure High", 0x1730, 17, 17, 8, [f"{v + 64:g}" for v in MPH17], [f"{v:g}" for v in TPS17], "X"),
]
CATALOG = "title string, address int, n_rows int, n_cols int, bits int, x_labels array<string>, y_labels array<string>, equation string"


def catalog(spark: SparkSession, tables: list[tuple] = TABLES) -> DataFrame:
    return spark.createDataFrame(tables, CATALOG)


def formula_image(spark: SparkSession, image_id: str, change: Column | None = None) -> DataFrame:
    """A synthetic image made by a formula, for tests and registered queries; ``change`` is added to each byte."""
    at = F.col("offset")
    byte = (at * 7 + F.floor(at / 256) * 13 + (change if change is not None else F.lit(0))) % 256
    return spark.range(SIZE).select(F.lit(image_id).alias("image_id"), F.col("id").cast("int").alias("offset")).select("image_id", "offset", byte.cast("int").alias("byte"))


def elements(tables: DataFrame) -> DataFrame:
    """(title, row, col, address, size) of every element of every table."""
    rows = tables.select("title", "address", "n_rows", "n_cols", (F.col("bits") / 8).cast("int").alias("size"), "x_labels", "y_labels", "equation", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_rows"), F.lit(1)) - 1)).alias("row"))
    cells = rows.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_cols"), F.lit(1)) - 1)).alias("col"))
    label = lambda labels, k: F.try_element_at(labels, (F.col(k) + 1).cast("int"))
    at = F.col("address") + (F.col("row") * F.greatest(F.col("n_cols"), F.lit(1)) + F.col("col")) * F.col("size")
    return cells.select("title", "row", "col", at.alias("address"), "size", label(F.col("x_labels"), "col").alias("x_label"), label(F.col("y_labels"), "row").alias("y_label"), "equation")


def read_tables(images: DataFrame, tables: DataFrame) -> DataFrame:
    """Raw and decoded values of all tables in all images; big-endian, NULL for an element cut by the image's end.

    The elements of a catalog are bounded by the size of an image and are the
    side that is broadcast; images may be any number. Elements wholly beyond an
    image have no row. An image is known by all columns but offset and byte.
    """
    own = [c for c in images.columns if c not in ("offset", "byte")]
    cells = elements(tables)
    byte_rows = cells.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("k")).withColumn("offset", F.col("address") + F.col("k"))
    joined = images.join(F.broadcast(byte_rows), "offset")
    keys = [*own, "title", "row", "col", "address", "size", "x_label", "y_label", "equation"]
    weight = F.when(F.col("k") == F.col("size") - 1, 1).otherwise(256)
    raw = joined.groupBy(*keys).agg(F.when(F.count("byte") == F.first("size"), F.sum(F.col("byte") * weight)).alias("raw"))
    return raw.withColumn("value", S.half_up(S.decoded(F.col("raw"), F.col("equation")), 4))


def looked_up(points: DataFrame, cells: DataFrame, rows: list[float], cols: list[float], y: str = "rpm", x: str = "map") -> DataFrame:
    """Add ``value``: a table (row, col, value) at (y, x), bilinear between the four cells around it and held at its ends.

    A table is at most a few hundred cells: it travels as one map beside every row, and no row is shuffled.
    """
    grid = cells.agg(F.map_from_entries(F.collect_list(F.struct(F.col("row") * 1000 + F.col("col"), "value"))).alias("_grid"))
    at = [S.axis_coordinate(F.array(*(F.lit(v) for v in axis)), F.col(name)) for axis, name in ((rows, y), (cols, x))]
    r, c = (F.floor(v).cast("int") for v in at)
    u, v = at[0] - r, at[1] - c
    corner = lambda i, j: F.try_element_at("_grid", F.least(r + i, F.lit(len(rows) - 1)) * 1000 + F.least(c + j, F.lit(len(cols) - 1)))
    value = corner(0, 0) * (1 - u) * (1 - v) + corner(1, 0) * u * (1 - v) + corner(0, 1) * (1 - u) * v + corner(1, 1) * u * v
    return points.join(F.broadcast(grid), F.lit(True)).withColumn("value", value).drop("_grid")


def runs(offsets: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of consecutive offsets: start_offset, end_offset, length."""
    w = Window.partitionBy(*keys).orderBy("offset")
    marked = offsets.withColumn("_run", F.col("offset") - F.row_number().over(w))
    return marked.groupBy(*keys, "_run").agg(F.min("offset").alias("start_offset"), F.max("offset").alias("end_offset"), F.count("*").alias("length")).drop("_run")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Offsets where two images (offset, byte) differ."""
    pairs = a.select("offset", F.col("byte").alias("old")).join(b.select("offset", F.col("byte").alias("new")), "offset", "full_outer")
    return pairs.where(~F.col("old").eqNullSafe(F.col("new")))


def diff_regions(a: DataFrame, b: DataFrame) -> DataFrame:
    return runs(differing(a, b).withColumn("pair", F.lit(0)), ["pair"]).drop("pair")


def diff_tables(a: DataFrame, b: DataFrame, tables: DataFrame) -> DataFrame:
    """Per table the changed elements and their decoded range, from whole elements of both images."""
    side = lambda df, n: read_tables(df.select(F.lit("x").alias("image_id"), "offset", "byte"), tables).select("title", "row", "col", F.col("raw").alias(f"raw_{n}"), F.col("value").alias(n))
    both = side(a, "old").join(side(b, "new"), ["title", "row", "col"]).where(~F.col("raw_old").eqNullSafe(F.col("raw_new")))
    return both.groupBy("title").agg(F.count("*").alias("changed"), F.min("old").alias("old_min"), F.max("old").alias("old_max"), F.min("new").alias("new_min"), F.max("new").alias("new_max"))


def entropy(bytes_: DataFrame, keys: list[str]) -> DataFrame:
    """Shannon entropy of the bytes of each group, in bits."""
    counts = bytes_.groupBy(*keys, "byte").agg(F.count("*").alias("n"))
    totals = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
    return totals.groupBy(*keys).agg(S.half_up(-F.sum(F.col("p") * F.log2("p")), 4).alias("entropy"))


def entropy_windows(images: DataFrame, width: int = 256) -> DataFrame:
    return entropy(images.withColumn("window", F.floor(F.col("offset") / width).cast("int")), ["image_id", "window"])


#: Byte counts of regions that are common sizes of tables.
TABLE_SIZES = [16, 24, 32, 48, 64, 96, 128, 144, 192, 256, 288, 384, 512]


def nway_regions(images: DataFrame, least: int = 4) -> DataFrame:
    """Runs where any image differs from another, the mean entropy of the images' bytes there, and what they look like."""
    odd = images.groupBy("offset").agg(F.countDistinct("byte").alias("n")).where("n > 1").withColumn("all", F.lit(0))
    found = runs(odd.select("all", "offset"), ["all"]).where(F.col("length") >= least).drop("all")
    spread = found.select("start_offset", F.explode(F.sequence("start_offset", "end_offset")).alias("offset"))
    bits = entropy(images.join(spread, "offset"), ["image_id", "start_offset"]).groupBy("start_offset").agg(S.half_up(F.avg("entropy"), 4).alias("mean_entropy"))
    size = F.col("length")
    small = F.when(F.col("mean_entropy") > 4, "code-or-pointer").otherwise("scalar-or-flag")
    kind = F.when(size.isin(TABLE_SIZES), "table-size").when((size >= 16) & (size % 16 == 0), "aligned-block").when(size <= 8, small).when(size < 64, "small-block").otherwise("large-block")
    return found.join(bits, "start_offset").withColumn("kind", kind)


def _spans(tables: DataFrame) -> DataFrame:
    length = (F.greatest(F.col("n_rows"), F.lit(1)) * F.greatest(F.col("n_cols"), F.lit(1)) * F.col("bits") / 8).cast("int")
    return tables.select("title", F.explode(F.sequence(F.col("address"), F.col("address") + length - 1)).alias("offset")).where(F.col("offset").between(0, SIZE - 1))


def audit_gaps(images: DataFrame, tables: DataFrame, least: int = 16) -> DataFrame:
    """Runs of bytes that no definition covers, the entropy of each image there, and what that suggests."""
    free = tables.sparkSession.range(SIZE).select(F.col("id").cast("int").alias("offset")).join(_spans(tables).select("offset").distinct(), "offset", "left_anti").withColumn("all", F.lit(0))
    gaps = runs(free, ["all"]).where(F.col("length") >= least).drop("all")
    spread = gaps.select("start_offset", F.explode(F.sequence("start_offset", "end_offset")).alias("offset"))
    bits = entropy(images.join(spread, "offset"), ["image_id", "start_offset"])
    kind = F.when(F.col("entropy") < 1, "empty").when(F.col("entropy") < 5, "structured").otherwise("code")
    return gaps.join(bits, "start_offset").select("image_id", "start_offset", "end_offset", "length", "entropy", kind.alias("kind"))


def audit_overlaps(tables: DataFrame) -> DataFrame:
    """Runs of bytes that several definitions claim, with the titles of all of them."""
    claims = _spans(tables).groupBy("offset").agg(F.array_sort(F.collect_set("title")).alias("titles")).where(F.size("titles") > 1)
    found = runs(claims.select(F.lit(0).alias("all"), "offset"), ["all"]).drop("all")
    spread = found.select("start_offset", "end_offset", "length", F.explode(F.sequence("start_offset", "end_offset")).alias("offset"))
    named = spread.join(claims, "offset").groupBy("start_offset", "end_offset", "length").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("titles")))).alias("titles"))
    return named.withColumn("titles", F.array_join("titles", " / "))


def audit(tables: DataFrame, size: int = SIZE, least_gap: int = 16) -> DataFrame:
    """How definitions cover an image: covered and doubly covered bytes, out-of-range definitions, gaps."""
    spans = tables.select("title", "address", (F.greatest(F.col("n_rows"), F.lit(1)) * F.greatest(F.col("n_cols"), F.lit(1)) * F.col("bits") / 8).cast("int").alias("length"))
    out = spans.where((F.col("address") < 0) | (F.col("address") + F.col("length") > size)).agg(F.count("*").alias("out_of_range"))
    cover = spans.select(F.explode(F.sequence("address", F.col("address") + F.col("length") - 1)).alias("offset")).where(F.col("offset").between(0, size - 1)).groupBy("offset").agg(F.count("*").alias("n"))
    counts = cover.agg(F.count("*").alias("covered"), F.count_if(F.col("n") > 1).alias("overlapping"))
    free = tables.sparkSession.range(size).select(F.col("id").cast("int").alias("offset")).join(cover, "offset", "left_anti").withColumn("all", F.lit(0))
    gaps = runs(free, ["all"]).where(F.col("length") >= least_gap).agg(F.count("*").alias("gaps"), F.max("length").alias("largest_gap"))
    # three one-row tables side by side
    return counts.join(out, F.lit(True)).join(gaps, F.lit(True)).withColumn("coverage_pct", S.half_up(100 * F.col("covered") / size, 1))


def checksums(images: DataFrame) -> DataFrame:
    """Sum of bytes and of big-endian words, and whether the words sum to a usual target."""
    weight = F.when(F.col("offset") % 2 == 0, 256).otherwise(1)
    sums = images.groupBy("image_id").agg(F.sum("byte").alias("byte_sum"), (F.sum(F.col("byte") * weight) % 65536).alias("word_sum"))
    return sums.withColumn("sums_to_zero", F.col("word_sum") == 0).withColumn("sums_to_ffff", F.col("word_sum") == 65535)


def sha256(images: DataFrame) -> DataFrame:
    """Digest of each image; an image is 64 KiB, so its bytes fit one row."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "byte"))), lambda x: F.lpad(F.hex(x["byte"].cast("long")), 2, "0")), "")
    return images.groupBy("image_id").agg(F.sha2(F.unhex(text), 256).alias("sha256"))


def _matched(images: DataFrame, expected: DataFrame) -> Column:
    return S.half_up(100 * F.avg((F.col("byte") == F.col("expected")).cast("double")), 1)


def fingerprint(images: DataFrame, known: DataFrame, stride: int = 97) -> DataFrame:
    """Share of sampled bytes that each image has in common with each known image."""
    expected = known.where(F.col("offset") % stride == 0).select(F.col("image_id").alias("known_id"), "offset", F.col("byte").alias("expected"))
    return images.join(expected, "offset").groupBy("image_id", "known_id").agg(_matched(images, expected).alias("match_pct"))


def discriminant_rank(images: DataFrame, known: DataFrame) -> DataFrame:
    """Known images ranked by the bytes in which they differ from one another, and how sure the first one is."""
    telling = known.groupBy("offset").agg(F.countDistinct("byte").alias("n")).where("n > 1").select("offset")
    expected = known.join(telling, "offset").select(F.col("image_id").alias("known_id"), "offset", F.col("byte").alias("expected"))
    scores = images.join(expected, "offset").groupBy("image_id", "known_id").agg(_matched(images, expected).alias("match_pct"))
    order = Window.partitionBy("image_id").orderBy(F.desc("match_pct"), "known_id")
    gap = F.col("match_pct") - F.coalesce(F.lead("match_pct").over(order), F.lit(0.0))
    sure = F.when((F.col("match_pct") == 100) & (gap >= 0.5), "high").when((F.col("match_pct") >= 99) & (gap >= 0.25), "medium").otherwise("ambiguous")
    ranked = scores.withColumn("rank", F.row_number().over(order)).withColumn("confidence", sure)
    return ranked.withColumn("confidence", F.when(F.col("rank") == 1, F.col("confidence")))


def consensus(known: DataFrame) -> DataFrame:
    """(offset, expected): the bytes that all known images agree on."""
    return known.groupBy("offset").agg(F.countDistinct("byte").alias("n"), F.min("byte").alias("expected")).where("n = 1").select("offset", "expected")


def dense_match(images: DataFrame, known: DataFrame, step: int = 7) -> DataFrame:
    """Share of densely sampled stable bytes that an image has as all known images do."""
    expected = consensus(known).where(F.col("offset") % step == 0)
    return images.join(expected, "offset").groupBy("image_id").agg(_matched(images, expected).alias("dense_pct"))


def landmark_match(images: DataFrame, known: DataFrame, windows: DataFrame) -> DataFrame:
    """Share of firmware windows (address, length) that an image has whole; windows in which known images differ do not count."""
    spread = windows.select("address", "length", F.explode(F.sequence(F.col("address"), F.col("address") + F.col("length") - 1)).alias("offset"))
    agreed = consensus(known).join(spread, "offset")
    whole = agreed.groupBy("address", "length").count().where("count = length").select("address", "length")
    hits = images.join(agreed.join(whole, ["address", "length"]), "offset").groupBy("image_id", "address", "length").agg(F.count_if(F.col("byte") == F.col("expected")).alias("hits"))
    # a window beyond the end of an image has no row there, but counts
    total = max(1, whole.count())
    return hits.groupBy("image_id").agg(S.half_up(100 * F.count_if(F.col("hits") == F.col("length")) / total, 1).alias("landmark_pct"))


def anchor_match(images: DataFrame, known: DataFrame, tables: DataFrame) -> DataFrame:
    """Share of the first and last cells of all tables that hold the value which all known images hold there."""
    ends = lambda df: read_tables(df, tables.select("*")).join(tables.select("title", (F.col("n_rows") - 1).alias("last_row"), (F.col("n_cols") - 1).alias("last_col")), "title").where("(row = 0 and col = 0) or (row = last_row and col = last_col)")
    expected = ends(known).groupBy("title", "row", "col").agg(F.countDistinct("raw").alias("n"), F.min("raw").alias("expected")).where("n = 1")
    own = ends(images).select("image_id", "title", "row", "col", "raw").join(expected, ["title", "row", "col"])
    return own.groupBy("image_id").agg(S.half_up(100 * F.avg((F.col("raw") == F.col("expected")).cast("double")), 1).alias("anchor_pct"))


def image_gate(images: DataFrame, known: DataFrame, tables: DataFrame, windows: DataFrame) -> DataFrame:
    """May an image be patched: ok, warn or block? The family decides between block and the rest, stock conformity between warn and ok."""
    shape = images.groupBy("image_id").agg(F.count("*").alias("size"), F.min("byte").alias("low"), F.max("byte").alias("high"))
    family = fingerprint(images, known).groupBy("image_id").agg(F.max("match_pct").alias("match_pct"))
    first = discriminant_rank(images, known).where("rank = 1").select("image_id", F.col("known_id").alias("closest"), "confidence")
    blank = (F.col("low") == F.col("high")) & F.col("low").isin(0, 255)
    joined = shape
    for part in (family, first, dense_match(images, known), landmark_match(images, known, windows), anchor_match(images, known, tables)):
        joined = joined.join(part, "image_id", "left")
    odd = F.coalesce((F.col("dense_pct") < 100) | (F.col("landmark_pct") < 100) | (F.col("anchor_pct") < 100), F.lit(False))
    level = F.when((F.col("size") != SIZE) | blank | F.coalesce(F.col("match_pct") < 90, F.lit(True)), "block").when((F.col("match_pct") < 99) | odd, "warn").otherwise("ok")
    return joined.select("image_id", "size", "match_pct", "closest", "confidence", "dense_pct", "landmark_pct", "anchor_pct", level.alias("level"))


def smoothed(targets: DataFrame, n_rows: int, n_cols: int, rings: tuple[tuple[int, float], ...] = ((1, 0.5), (2, 0.25))) -> DataFrame:
    """Untouched cells take a part of the mean of the targeted cells near them; the inner ring wins. Rows: KEYS, row, col, delta."""
    out = targets.select(*KEYS, "row", "col", "delta", F.lit(False).alias("smoothed"))
    reach = max(r for r, _ in rings)
    near = targets.select(*KEYS, F.explode(F.sequence(F.col("row") - reach, F.col("row") + reach)).alias("r"), "row", "col", "delta").select(*KEYS, "r", F.explode(F.sequence(F.col("col") - reach, F.col("col") + reach)).alias("c"), "row", "col", "delta")
    near = near.where(F.col("r").between(0, n_rows - 1) & F.col("c").between(0, n_cols - 1)).withColumn("d", F.greatest(F.abs(F.col("r") - F.col("row")), F.abs(F.col("c") - F.col("col"))))
    means = near.groupBy(*KEYS, F.col("r").alias("row"), F.col("c").alias("col")).agg(F.min("d").alias("nearest"), *(F.avg(F.when(F.col("d") <= r, F.col("delta"))).alias(f"m{r}") for r, _ in rings))
    value = F.coalesce(*(F.col(f"m{r}") * f for r, f in rings))
    free = means.where("nearest > 0").select(*KEYS, "row", "col", value.alias("delta"), F.lit(True).alias("smoothed"))
    return out.unionByName(free)


class Layers(NamedTuple):
    """Images of sessions: ``first`` (image_id, offset, byte) as all begin, and ``written`` (KEYS, offset, byte, rank), of which the highest rank of a byte holds."""

    first: DataFrame
    written: DataFrame | None


def _session_cells(images: DataFrame | Layers, tables: DataFrame, changes: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Each cell for each change (KEYS and what it says) of its image, or of its place ``on`` too; of layers as the last writer left it."""
    cells = read_tables(images.first if isinstance(images, Layers) else images, tables)
    joined = cells.join(changes, [*(c for c in KEYS if c in cells.columns), *on])
    if not isinstance(images, Layers) or images.written is None:
        return joined
    # only bytes of these tables are met; where no stage before wrote any, nothing is
    last = within(images.written, tables).groupBy(*KEYS, "offset").agg(F.max_by("byte", "rank").alias("new"))
    place, raw, wide = [*KEYS, "title", "row", "col"], F.col("raw"), F.col("size") == 2
    high = wide & (F.col("k") == 0)
    spread = joined.select(*place, "address", "size", "raw", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("k")).distinct()
    met = spread.withColumn("offset", F.col("address") + F.col("k")).join(last, [*KEYS, "offset"])
    step = (F.col("new") - F.when(high, F.floor(raw / 256)).when(wide, raw % 256).otherwise(raw)) * F.when(high, 256).otherwise(1)
    moved = met.groupBy(*place).agg(F.sum(step).alias("_step"))
    now = joined.join(moved, place, "left").withColumn("raw", raw + F.coalesce("_step", F.lit(0))).drop("_step")
    return now.withColumn("value", S.half_up(S.decoded(F.col("raw"), F.col("equation")), 4))


PATCH = [*KEYS, "title", "row", "col", "address", "size", "old_value", "new_value", "delta", "smoothed"]


def _patches(joined: DataFrame, new: Column) -> DataFrame:
    """Patches of cells that stand beside their deltas."""
    top = F.when(F.col("size") == 2, 65535).otherwise(255)
    value = F.greatest(F.lit(0), F.least(top, S.half_up_int(new)))
    return joined.select(*KEYS, "title", "row", "col", "address", "size", F.col("raw").alias("old_value"), value.cast("long").alias("new_value"), S.half_up(F.col("delta")).alias("delta"), "smoothed").where("old_value <> new_value")


def fuel_targets(suggestions: DataFrame, rpm_axis: list[float], map_axis: list[float]) -> DataFrame:
    """Breakpoints touched by fuel suggestions; the strongest trim wins where bins meet."""
    rows = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(rpm_axis)))
    cols = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(map_axis)))
    act = suggestions.where("action <> 'none'").select(*KEYS, "delta_pct", "avg_trim", "first_row", F.explode(F.filter(rows, lambda x: x["v"].between(F.col("rpm_lo"), F.col("rpm_lo") + 500))).alias("r"), F.filter(cols, lambda x: x["v"].between(F.col("map_lo"), F.col("map_lo") + 10)).alias("cs"))
    hits = act.select(*KEYS, "delta_pct", "avg_trim", "first_row", F.col("r.i").alias("row"), F.explode("cs").alias("c")).withColumn("col", F.col("c.i"))
    return hits.groupBy(*KEYS, "row", "col").agg(F.max_by("delta_pct", F.struct(F.abs("avg_trim"), -F.col("first_row"))).alias("delta"))


def apply_fuel(images: DataFrame | Layers, tables: DataFrame, suggestions: DataFrame, title: str = "Main VE") -> DataFrame:
    deltas = smoothed(fuel_targets(suggestions.where(F.col("table_name") == title), RPM17, MAP13), 17, 13)
    return _patches(_session_cells(images, tables.where(F.col("title") == title), deltas, ["row", "col"]), F.col("raw") * (1 + F.col("delta") / 100))


def apply_spark(images: DataFrame | Layers, tables: DataFrame, suggestions: DataFrame) -> DataFrame:
    targets = suggestions.where("action <> 'none'").groupBy(*KEYS, "row", "col").agg(F.min("delta_deg").alias("delta"))
    step = S.half_up_int(F.col("delta") * S.raw_per_unit(F.col("equation")))
    return _patches(_session_cells(images, tables.where("title = 'Spark Advance'"), smoothed(targets, 17, 17, ((1, 0.5),)), ["row", "col"]), F.col("raw") + step)


def apply_scale(images: DataFrame | Layers, tables: DataFrame, titles: list[str], changes: DataFrame, floor: int = 0) -> DataFrame:
    """Scale whole tables by the percentages of ``changes`` (KEYS, percent), raw values not below a floor unless they were."""
    cells = _session_cells(images, tables.where(F.col("title").isin(titles)), changes)
    top = F.when(F.col("size") == 2, 65535).otherwise(255)
    value = F.least(top, F.greatest(F.least(F.col("raw"), F.lit(floor)), S.half_up_int(F.col("raw") * (1 + F.col("percent") / 100))))
    return cells.select(*KEYS, "title", "row", "col", "address", "size", F.col("raw").alias("old_value"), value.cast("long").alias("new_value"), S.half_up(F.col("percent")).alias("delta"), F.lit(False).alias("smoothed")).where("old_value <> new_value")


TRANS_CHANGES = ["firm_pct", "firm_mph", "kick_pct", "kick_mph", "hunt_pct", "hunt_tps", "hunt_pair"]


def apply_transmission(images: DataFrame | Layers, tables: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes``: KEYS and percentages with the speeds, the throttle and the pair of gears (as '3-4') around which they hold; a NULL makes no patch."""
    cells = _session_cells(images, tables.where("title like 'Line Pressure%' or title like 'Normal %'"), changes)
    old, parts = F.col("raw"), []

    def patch(rows: DataFrame, new: Column, percent: Column) -> None:
        parts.append(rows.select(*KEYS, "title", "row", "col", "address", "size", old.alias("old_value"), new.cast("long").alias("new_value"), percent.alias("delta"), F.lit(False).alias("smoothed")).where(percent.isNotNull()))

    scaled = lambda name: S.half_up_int(old * (1 + F.col(name) / 100))
    firm = cells.where(F.col("title").like("Line Pressure%") & (F.abs(S.number(F.col("x_label")) - F.col("firm_mph")) <= 10))
    patch(firm, F.least(F.lit(255), scaled("firm_pct")), F.col("firm_pct"))
    up = cells.where("title = 'Normal Upshifts'").select(*KEYS, "row", F.array_join(F.reverse(F.split("x_label", "-")), "-").alias("x_label"), F.col("raw").alias("up_raw"))
    down = cells.where("title = 'Normal Downshifts'").where(F.abs(old / 2 - F.col("kick_mph")) <= 15).join(up, [*KEYS, "row", "x_label"], "left")
    cap = F.least(F.lit(255), S.half_up_int(old * 1.5), F.coalesce(F.floor(F.col("up_raw") * 0.9), F.lit(255)))
    patch(down, F.greatest(old, F.least(cap, scaled("kick_pct"))), F.col("kick_pct"))
    near = cells.where(F.abs(S.number(F.col("y_label")) - F.col("hunt_tps")) <= 12.5)
    back = F.array_join(F.reverse(F.split("hunt_pair", "-")), "-")
    patch(near.where((F.col("title") == "Normal Upshifts") & (F.col("x_label") == F.col("hunt_pair"))), F.least(F.lit(255), scaled("hunt_pct")), F.col("hunt_pct"))
    patch(near.where((F.col("title") == "Normal Downshifts") & (F.col("x_label") == back)), F.greatest(F.lit(0), S.half_up_int(old / (1 + F.col("hunt_pct") / 100))), -F.col("hunt_pct"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("old_value <> new_value")


def patch_bytes(patches: DataFrame) -> DataFrame:
    """(KEYS, title, address, offset, byte): the bytes that patches write."""
    k = F.explode(F.sequence(F.lit(0), F.col("size") - 1))
    rows = patches.select(*KEYS, "title", "address", "size", "new_value", k.alias("k"))
    high = (F.col("size") == 2) & (F.col("k") == 0)
    return rows.select(*KEYS, "title", "address", (F.col("address") + F.col("k")).alias("offset"), F.when(high, F.floor(F.col("new_value") / 256)).otherwise(F.col("new_value") % 256).cast("int").alias("byte"))


def patched(images: DataFrame, patches: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """The image of each session (KEYS; those that have patches unless given) with the bytes of its patches (disjoint; of several writers of a byte the highest address wins)."""
    new = patch_bytes(patches).groupBy(*KEYS, "offset").agg(F.max_by("byte", "address").alias("new"))
    if "log_id" not in images.columns:
        images = images.join(sessions if sessions is not None else patches.select(*KEYS).distinct(), "image_id")
    return images.join(new, [*KEYS, "offset"], "left").select(*KEYS, "offset", F.coalesce("new", "byte").alias("byte"))


def within(images: DataFrame, tables: DataFrame) -> DataFrame:
    """Only the bytes that tables cover; a catalog covers at most an image, so its offsets are broadcast."""
    span = F.sequence(F.col("address"), F.col("address") + (F.greatest(F.col("n_rows"), F.lit(1)) * F.greatest(F.col("n_cols"), F.lit(1)) * F.col("bits") / 8).cast("int") - 1)
    covered = tables.select(F.explode(span).alias("offset")).where(F.col("offset").between(0, SIZE - 1)).distinct()
    return images.join(F.broadcast(covered), "offset", "left_semi")


def chained(images: DataFrame, tables: DataFrame, sessions: DataFrame, stages: list[tuple[str, Callable[[Layers], DataFrame]]]) -> DataFrame:
    """The patches of all stages (name, function of the images so far), each on top of the images that the stage before left.

    A session's image is the first one and the bytes that its patches wrote, so what is kept between stages is the patches alone.
    """
    sessions = staged(sessions.select(*KEYS).distinct(), "sessions")
    current, out = Layers(within(images, tables), None), None
    for nth, (name, stage) in enumerate(stages):
        patches = staged(stage(current).withColumn("stage", F.lit(name)).join(sessions, KEYS, "left_semi"), f"patches-{name}")
        bytes_ = patch_bytes(patches).select(*KEYS, "offset", "byte", F.struct(F.lit(nth).alias("nth"), "address").alias("rank"))
        current = Layers(current.first, bytes_ if current.written is None else current.written.unionByName(bytes_))
        out = patches if out is None else out.unionByName(patches)
    return out


def verify(before: DataFrame, after: DataFrame, patches: DataFrame, tables: DataFrame) -> DataFrame:
    """One row for each failed check of a patch: range, table, old-value, conflict, value-range, read-back; overlap (of two tables' definitions) only warns.

    ``before`` is known by image_id or by KEYS, ``after`` by KEYS.
    """
    spans = tables.select("title", F.col("address").alias("base"), (F.col("address") + F.greatest(F.col("n_rows"), F.lit(1)) * F.greatest(F.col("n_cols"), F.lit(1)) * F.col("bits") / 8).cast("int").alias("stop"))
    top = F.when(F.col("size") == 2, 65535).otherwise(255)
    outside = (F.col("address") < 0) | (F.col("address") + F.col("size") > SIZE)
    spread = patches.select(*KEYS, "address", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("k")).withColumn("offset", F.col("address") + F.col("k")).distinct()

    def words(image: DataFrame, name: str) -> DataFrame:
        own = [c for c in KEYS if c in image.columns]
        weight = F.when((F.col("size") == 2) & (F.col("k") == 0), 256).otherwise(1)
        return spread.join(image.select(*own, "offset", "byte"), [*own, "offset"]).groupBy(*KEYS, "address").agg(F.sum(F.col("byte") * weight).alias(name))

    written = patch_bytes(patches)
    shared = written.groupBy(*KEYS, "offset").agg(F.count("*").alias("n")).where("n > 1").select(*KEYS, "offset")
    clash = written.join(shared, [*KEYS, "offset"]).select(*KEYS, "address").distinct().withColumn("clash", F.lit(True))
    # bytes that two definitions claim: a catalog covers at most an image
    claims = spans.select(F.explode(F.sequence("base", F.col("stop") - 1)).alias("offset")).groupBy("offset").count().where("count > 1").select("offset")
    doubly = spread.join(F.broadcast(claims), "offset").select(*KEYS, "address").distinct().withColumn("doubly", F.lit(True))
    rows = patches.join(spans, "title", "left")
    for part in (words(before, "was"), words(after, "now"), clash, doubly):
        rows = rows.join(part, [*KEYS, "address"], "left")
    checks = {
        "range": outside,
        "table": ~outside & (F.col("base").isNull() | (F.col("address") < F.col("base")) | (F.col("address") + F.col("size") > F.col("stop"))),
        "old-value": ~outside & ~F.col("was").eqNullSafe(F.col("old_value")),
        "conflict": ~outside & F.coalesce("clash", F.lit(False)),
        "value-range": ~outside & ((F.col("new_value") < 0) | (F.col("new_value") > top)),
        "read-back": ~outside & ~F.col("now").eqNullSafe(F.col("new_value")),
        "overlap": ~outside & F.coalesce("doubly", F.lit(False)),
    }
    named = F.array_compact(F.array(*(F.when(c, n) for n, c in checks.items())))
    return rows.select(*KEYS, "title", "address", F.explode(named).alias("failed"))


def uncovered(before: DataFrame, after: DataFrame, patches: DataFrame) -> DataFrame:
    """Bytes of each session's image that changed although no patch writes them."""
    old = before.select("image_id", "offset", F.col("byte").alias("old_byte"))
    changed = after.withColumnRenamed("byte", "new_byte").join(old, ["image_id", "offset"]).where("old_byte <> new_byte")
    return changed.join(patch_bytes(patches).select(*KEYS, "offset").distinct(), [*KEYS, "offset"], "left_anti").select(*KEYS, "offset", "old_byte", "new_byte")


def before_after(before: DataFrame, after: DataFrame, tables: DataFrame) -> DataFrame:
    """Every cell of every table of each session's image, before and after."""
    cell = ["title", "row", "col"]
    old = read_tables(before, tables).select("image_id", *cell, F.col("value").alias("before"))
    both = read_tables(after, tables).select(*KEYS, *cell, F.col("value").alias("after")).join(old, ["image_id", *cell])
    return both.select(*KEYS, *cell, "before", "after", S.half_up(F.col("after") - F.col("before"), 4).alias("change"))


def biggest_moves(cells: DataFrame) -> DataFrame:
    """Per session and table how many cells moved, and the one that moved most (the first by row and column of equals)."""
    moved = cells.where("change <> 0")
    most = F.max_by(F.struct("row", "col", "change"), F.struct(F.abs("change"), -F.col("row"), -F.col("col")))
    return moved.groupBy(*KEYS, "title").agg(F.count("*").alias("changed"), most.alias("m")).select(*KEYS, "title", "changed", "m.row", "m.col", "m.change")


def same_image(images: DataFrame) -> DataFrame:
    """Pairs of images with the same digest."""
    digests = sha256(images)
    other = digests.select(F.col("image_id").alias("other_id"), "sha256")
    return digests.join(other, "sha256").where("image_id < other_id").select("image_id", "other_id")
