"""Queries for binary images, each with its comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revscope.cluster import staged
from revscope.operators import events as E
from revscope.operators import features as X
from revscope.operators import images as I
from revscope.operators import reports as R
from revscope.operators import rules as U
from revscope.plans.base_sql import half_up as hu
from revscope.plans.base_sql import half_up_int as hi
from revscope.plans.report_queries import with_
from revscope.plans import base_sql as B
from revscope.plans.event_queries import TIPIN, TIPSUM, TRANS, recursive
from revscope.plans.rule_queries import AESG, FUEL, MODES, NEAREST, PEEG, PESG, SPARK, TRSG, fuel, spark_rows
from revscope.sources.telemetry import telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = query
    ORACLES[name] = sql


CHANGES: dict[str, Callable[[], Column | None]] = {
    "a": lambda: None,
    "b": lambda: F.when(F.col("offset") % 1021 < 3, 5).otherwise(0),
    "c": lambda: F.when((F.col("offset") % 2048).between(100, 115), 9).otherwise(0),
}


def image(spark: SparkSession, name: str) -> DataFrame:
    return I.formula_image(spark, name, CHANGES[name]())


def three(spark: SparkSession) -> DataFrame:
    return image(spark, "a").unionByName(image(spark, "b")).unionByName(image(spark, "c"))


def _lit(v: object) -> str:
    return "[" + ", ".join(f"'{x}'" for x in v) + "]" if isinstance(v, list) else f"'{v}'" if isinstance(v, str) else str(v)


IMAGES = """o AS (SELECT CAST(range AS INTEGER) AS "offset" FROM range(65536)),
ia AS (SELECT 'a' AS image_id, "offset", CAST(("offset" * 7 + "offset" // 256 * 13) % 256 AS INTEGER) AS byte FROM o),
ib AS (SELECT 'b' AS image_id, "offset", CAST(("offset" * 7 + "offset" // 256 * 13 + CASE WHEN "offset" % 1021 < 3 THEN 5 ELSE 0 END) % 256 AS INTEGER) AS byte FROM o),
ic AS (SELECT 'c' AS image_id, "offset", CAST(("offset" * 7 + "offset" // 256 * 13 + CASE WHEN "offset" % 2048 BETWEEN 100 AND 115 THEN 9 ELSE 0 END) % 256 AS INTEGER) AS byte FROM o),
im AS (SELECT * FROM ia UNION ALL SELECT * FROM ib UNION ALL SELECT * FROM ic)"""
CAT = "cat AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_lit(v) for v in t) + ")" for t in I.TABLES) + ") AS c(title, address, n_rows, n_cols, bits, x_labels, y_labels, equation))"
FACTOR = "CASE equation WHEN 'X' THEN 1e0 WHEN 'X/10' THEN 10e0 WHEN 'X/256' THEN 256e0 WHEN 'X/2' THEN 2e0 WHEN 'X*(90/255)' THEN 255 / 90e0 WHEN 'X*(100/255)' THEN 255 / 100e0 END"


def read_sql(source: str, name: str) -> str:
    return f"""{name}0 AS (SELECT *, unnest(generate_series(0, n_rows - 1)) AS r FROM cat),
{name}1 AS (SELECT *, unnest(generate_series(0, n_cols - 1)) AS c FROM {name}0),
{name}2 AS (SELECT title, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, CAST(address + (r * n_cols + c) * (bits // 8) AS INTEGER) AS address, CAST(bits // 8 AS INTEGER) AS size, x_labels[c + 1] AS x_label, y_labels[r + 1] AS y_label, equation FROM {name}1),
{name}3 AS (SELECT image_id, t.*, CASE WHEN size = 1 THEN h.byte ELSE h.byte * 256 + (SELECT l.byte FROM {source} l WHERE l.image_id = h.image_id AND l."offset" = t.address + 1) END AS raw FROM {name}2 t JOIN {source} h ON h."offset" = t.address),
{name} AS (SELECT image_id, title, "row", col, address, size, x_label, y_label, equation, CAST(raw AS BIGINT) AS raw, {hu(f"raw / ({FACTOR})", 4)} AS value FROM {name}3)"""


register("table_read", lambda spark, sf_dir: I.read_tables(three(spark), I.catalog(spark)), with_(IMAGES, CAT, read_sql("im", "tr"), "SELECT * FROM tr"))
register(
    "spark_lookup",
    lambda spark, sf_dir: I.looked_up(telemetry(spark, sf_dir).where("rpm is not null").select("log_id", "row_idx", "rpm", "map"), I.read_tables(image(spark, "a"), I.catalog(spark).where("title = 'Spark Advance'")), I.RPM17, I.MAP17).select("log_id", "row_idx", I.S.half_up(F.col("value"), 4).alias("advance")),
    with_(
        B.T, IMAGES, CAT, read_sql("ia", "ta"),
        "sa AS (SELECT \"row\" AS r, col AS c, value FROM ta WHERE title = 'Spark Advance')",
        "q0 AS (SELECT *, greatest(0, least(15, floor(rpm / 400))) AS lr, greatest(0, least(15, floor((map - 20) / 5))) AS lc FROM t WHERE rpm IS NOT NULL)",
        "q AS (SELECT log_id, row_idx, greatest(0e0, least(16e0, lr + (rpm - lr * 400) / 400)) AS y, greatest(0e0, least(16e0, lc + (map - (20 + lc * 5)) / 5)) AS x FROM q0)",
        "w AS (SELECT *, floor(y) AS r0, floor(x) AS c0, y - floor(y) AS u, x - floor(x) AS v FROM q)",
        f"SELECT log_id, row_idx, {hu('a.value * (1 - u) * (1 - v) + b.value * u * (1 - v) + d.value * (1 - u) * v + e.value * u * v', 4)} AS advance FROM w JOIN sa a ON a.r = r0 AND a.c = c0 JOIN sa b ON b.r = least(r0 + 1, 16) AND b.c = c0 JOIN sa d ON d.r = r0 AND d.c = least(c0 + 1, 16) JOIN sa e ON e.r = least(r0 + 1, 16) AND e.c = least(c0 + 1, 16)",
    ),
)
register(
    "linear_decode",
    lambda spark, sf_dir: I.catalog(spark).select("title", "equation", F.explode(F.array(*map(F.lit, (0, 1, 100, 255)))).alias("raw")).select("title", "equation", "raw", I.S.half_up(I.S.decoded(F.col("raw"), F.col("equation")), 4).alias("value")),
    with_(CAT, f"SELECT title, equation, raw, {hu(f'raw / ({FACTOR})', 4)} AS value FROM cat, (VALUES (0), (1), (100), (255)) AS v(raw)"),
)
DIFF = 'df AS (SELECT "offset" FROM ia JOIN ib USING ("offset") WHERE ia.byte <> ib.byte)'
RUNS = 'SELECT min("offset") AS start_offset, max("offset") AS end_offset, count(*) AS length FROM (SELECT "offset", "offset" - row_number() OVER (ORDER BY "offset") AS run FROM {0}) GROUP BY run'
register("byte_diff_regions", lambda spark, sf_dir: I.diff_regions(image(spark, "a"), image(spark, "b")), with_(IMAGES, DIFF, RUNS.format("df")))
register(
    "diff_table_summary",
    lambda spark, sf_dir: I.diff_tables(image(spark, "a"), image(spark, "b"), I.catalog(spark)),
    with_(IMAGES, CAT, read_sql("ia", "ta"), read_sql("ib", "tb"), 'SELECT title, count(*) AS changed, min(ta.value) AS old_min, max(ta.value) AS old_max, min(tb.value) AS new_min, max(tb.value) AS new_max FROM ta JOIN tb USING (title, "row", col) WHERE ta.raw <> tb.raw GROUP BY title'),
)
register(
    "entropy_windows",
    lambda spark, sf_dir: I.entropy_windows(three(spark)),
    with_(IMAGES, 'n AS (SELECT image_id, "offset" // 256 AS w, byte, count(*) AS n FROM im GROUP BY ALL)', "p AS (SELECT image_id, w, n / sum(n) OVER (PARTITION BY image_id, w) AS p FROM n)", f'SELECT image_id, CAST(w AS INTEGER) AS "window", {hu("-sum(p * log2(p))", 4)} AS entropy FROM p GROUP BY image_id, w'),
)
ENTROPY = """{0}n AS (SELECT image_id, start_offset, byte, count(*) AS n FROM im JOIN {1} r ON "offset" BETWEEN start_offset AND end_offset GROUP BY ALL),
{0}p AS (SELECT image_id, start_offset, n / sum(n) OVER (PARTITION BY image_id, start_offset) AS p FROM {0}n),
{0} AS (SELECT image_id, start_offset, {2} AS entropy FROM {0}p GROUP BY ALL)"""
register(
    "nway_diff",
    lambda spark, sf_dir: I.nway_regions(three(spark), 2),
    with_(
        IMAGES,
        'od AS (SELECT "offset" FROM im GROUP BY "offset" HAVING count(DISTINCT byte) > 1)',
        f"r AS (SELECT * FROM ({RUNS.format('od')}) WHERE length >= 2)",
        ENTROPY.format("ne", "r", hu("-sum(p * log2(p))", 4)),
        f"me AS (SELECT start_offset, {hu('avg(entropy)', 4)} AS mean_entropy FROM ne GROUP BY start_offset)",
        f"SELECT *, CASE WHEN length IN ({', '.join(map(str, I.TABLE_SIZES))}) THEN 'table-size' WHEN length >= 16 AND length % 16 = 0 THEN 'aligned-block' WHEN length <= 8 THEN CASE WHEN mean_entropy > 4 THEN 'code-or-pointer' ELSE 'scalar-or-flag' END WHEN length < 64 THEN 'small-block' ELSE 'large-block' END AS kind FROM r JOIN me USING (start_offset)",
    ),
)
CLAIMED = "cat2 AS (SELECT title, address, n_rows, n_cols, bits FROM cat UNION ALL SELECT 'Fuel Probe', 4096, 2, 1, 16)"


def _claimed_twice(spark: SparkSession) -> DataFrame:
    """The catalog with a second definition over the first bytes of the fuel table."""
    extra = spark.createDataFrame([("Fuel Probe", 0x1000, 2, 1, 16, ["X"], ["0", "400"], "X")], I.CATALOG)
    return I.catalog(spark).unionByName(extra)


register(
    "definition_overlaps",
    lambda spark, sf_dir: I.audit_overlaps(_claimed_twice(spark)),
    with_(
        CAT,
        CLAIMED,
        'cl AS (SELECT title, unnest(generate_series(address, address + n_rows * n_cols * bits // 8 - 1)) AS "offset" FROM cat2)',
        'ov AS (SELECT "offset" FROM cl GROUP BY "offset" HAVING count(DISTINCT title) > 1)',
        f"r AS ({RUNS.format('ov')})",
        "SELECT CAST(start_offset AS INTEGER) AS start_offset, CAST(end_offset AS INTEGER) AS end_offset, length, string_agg(DISTINCT title, ' / ' ORDER BY title) AS titles FROM r JOIN cl ON \"offset\" BETWEEN start_offset AND end_offset GROUP BY ALL",
    ),
)
register(
    "definition_gaps",
    lambda spark, sf_dir: I.audit_gaps(three(spark), I.catalog(spark)),
    with_(
        IMAGES,
        CAT,
        'cv AS (SELECT DISTINCT unnest(generate_series(address, address + n_rows * n_cols * bits // 8 - 1)) AS "offset" FROM cat)',
        'fr AS (SELECT o."offset" FROM o ANTI JOIN cv USING ("offset"))',
        f"g AS (SELECT * FROM ({RUNS.format('fr')}) WHERE length >= 16)",
        ENTROPY.format("ge", "g", hu("-sum(p * log2(p))", 4)),
        "SELECT image_id, start_offset, end_offset, length, entropy, CASE WHEN entropy < 1 THEN 'empty' WHEN entropy < 5 THEN 'structured' ELSE 'code' END AS kind FROM g JOIN ge USING (start_offset)",
    ),
)
register(
    "definition_audit",
    lambda spark, sf_dir: I.audit(I.catalog(spark)),
    with_(
        IMAGES,
        CAT,
        'cv AS (SELECT "offset", count(*) AS n FROM (SELECT unnest(generate_series(address, address + n_rows * n_cols * bits // 8 - 1)) AS "offset" FROM cat) GROUP BY "offset")',
        'fr AS (SELECT o."offset" FROM o ANTI JOIN cv USING ("offset"))',
        f"g AS (SELECT * FROM ({RUNS.format('fr')}) WHERE length >= 16)",
        f"SELECT (SELECT count(*) FROM cv) AS covered, (SELECT count(*) FROM cv WHERE n > 1) AS overlapping, (SELECT count(*) FROM cat WHERE address + n_rows * n_cols * bits // 8 > 65536) AS out_of_range, count(*) AS gaps, max(length) AS largest_gap, {hu('100e0 * (SELECT count(*) FROM cv) / 65536', 1)} AS coverage_pct FROM g",
    ),
)
register("checksum_probes", lambda spark, sf_dir: I.checksums(three(spark)), with_(IMAGES, 's AS (SELECT image_id, CAST(sum(byte) AS BIGINT) AS byte_sum, CAST(sum(byte * CASE WHEN "offset" % 2 = 0 THEN 256 ELSE 1 END) % 65536 AS BIGINT) AS word_sum FROM im GROUP BY image_id)', "SELECT *, word_sum = 0 AS sums_to_zero, word_sum = 65535 AS sums_to_ffff FROM s"))
register("image_sha256", lambda spark, sf_dir: I.sha256(three(spark)), with_(IMAGES, "SELECT image_id, sha256(from_hex(string_agg(lpad(hex(byte), 2, '0'), '' ORDER BY \"offset\"))) AS sha256 FROM im GROUP BY image_id"))
FINGER = f"fp AS (SELECT m.image_id, k.image_id AS known_id, {hu('100 * avg(CASE WHEN m.byte = k.byte THEN 1e0 ELSE 0e0 END)', 1)} AS match_pct FROM im m JOIN im k ON m.\"offset\" = k.\"offset\" WHERE k.image_id <> 'c' AND k.\"offset\" % 97 = 0 GROUP BY ALL)"


def _known(spark: SparkSession) -> DataFrame:
    return three(spark).where("image_id <> 'c'")


register("fingerprint_match", lambda spark, sf_dir: I.fingerprint(three(spark), _known(spark)), with_(IMAGES, FINGER, "SELECT * FROM fp"))
WINDOWS = [(0x0040, 16), (0x0460, 24), (0x07F8, 16), (0x8000, 32), (0x9C00, 16), (0xF000, 64)]


def _windows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WINDOWS, "address int, length int")


_share = lambda hit: hu(f"100 * avg(CASE WHEN {hit} THEN 1e0 ELSE 0e0 END)", 1)
LAYERS = (
    "kn AS (SELECT * FROM im WHERE image_id <> 'c')",
    'ag AS (SELECT "offset", min(byte) AS expected FROM kn GROUP BY "offset" HAVING count(DISTINCT byte) = 1)',
    'ds AS (SELECT m.image_id, k.image_id AS known_id, ' + _share("m.byte = k.byte") + ' AS match_pct FROM im m JOIN kn k USING ("offset") WHERE "offset" NOT IN (SELECT "offset" FROM ag) GROUP BY ALL)',
    "dg AS (SELECT *, row_number() OVER w AS rank, match_pct - coalesce(lead(match_pct) OVER w, 0) AS gap FROM ds WINDOW w AS (PARTITION BY image_id ORDER BY match_pct DESC, known_id))",
    "dr AS (SELECT image_id, known_id, match_pct, CAST(rank AS INTEGER) AS rank, CASE WHEN rank > 1 THEN NULL WHEN match_pct = 100 AND gap >= 0.5 THEN 'high' WHEN match_pct >= 99 AND gap >= 0.25 THEN 'medium' ELSE 'ambiguous' END AS confidence FROM dg)",
    'dn AS (SELECT image_id, ' + _share("byte = expected") + ' AS dense_pct FROM im JOIN ag USING ("offset") WHERE "offset" % 7 = 0 GROUP BY image_id)',
    f"wi AS (SELECT w.* FROM (VALUES {', '.join(map(str, WINDOWS))}) AS w(address, length) JOIN ag ON \"offset\" BETWEEN address AND address + length - 1 GROUP BY ALL HAVING count(*) = length)",
    'lw AS (SELECT image_id, address, length, count(*) FILTER (WHERE byte = expected) AS hits FROM wi JOIN ag ON "offset" BETWEEN address AND address + length - 1 JOIN im USING ("offset") GROUP BY ALL)',
    "lm AS (SELECT image_id, " + hu("100e0 * count(*) FILTER (WHERE hits = length) / (SELECT count(*) FROM wi)", 1) + " AS landmark_pct FROM lw GROUP BY image_id)",
    read_sql("im", "tall"),
    'en AS (SELECT t.* FROM tall t JOIN cat USING (title) WHERE ("row" = 0 AND col = 0) OR ("row" = n_rows - 1 AND col = n_cols - 1))',
    """ex AS (SELECT title, "row", col, min(raw) AS expected FROM en WHERE image_id <> 'c' GROUP BY ALL HAVING count(DISTINCT raw) = 1)""",
    'an AS (SELECT image_id, ' + _share("raw = expected") + ' AS anchor_pct FROM en JOIN ex USING (title, "row", col) GROUP BY image_id)',
)
register("discriminant_rank", lambda spark, sf_dir: I.discriminant_rank(three(spark), _known(spark)), with_(IMAGES, *LAYERS[:5], "SELECT * FROM dr"))
register("dense_match", lambda spark, sf_dir: I.dense_match(three(spark), _known(spark)), with_(IMAGES, *LAYERS[:2], LAYERS[5], "SELECT * FROM dn"))
register("landmark_match", lambda spark, sf_dir: I.landmark_match(three(spark), _known(spark), _windows(spark)), with_(IMAGES, *LAYERS[:2], *LAYERS[6:9], "SELECT * FROM lm"))
register("anchor_match", lambda spark, sf_dir: I.anchor_match(three(spark), _known(spark), I.catalog(spark)), with_(IMAGES, CAT, *LAYERS[9:], "SELECT * FROM an"))
register(
    "image_gate",
    lambda spark, sf_dir: I.image_gate(three(spark), _known(spark), I.catalog(spark), _windows(spark)),
    with_(
        IMAGES,
        CAT,
        FINGER,
        *LAYERS,
        "s AS (SELECT image_id, count(*) AS size FROM im GROUP BY image_id)",
        "fm AS (SELECT image_id, max(match_pct) AS match_pct FROM fp GROUP BY image_id)",
        "SELECT image_id, size, fm.match_pct, known_id AS closest, confidence, dense_pct, landmark_pct, anchor_pct, CASE WHEN size <> 65536 OR fm.match_pct < 90 THEN 'block' WHEN fm.match_pct < 99 OR dense_pct < 100 OR landmark_pct < 100 OR anchor_pct < 100 THEN 'warn' ELSE 'ok' END AS level FROM s JOIN fm USING (image_id) JOIN (SELECT image_id, known_id, confidence FROM dr WHERE rank = 1) USING (image_id) LEFT JOIN dn USING (image_id) LEFT JOIN lm USING (image_id) LEFT JOIN an USING (image_id)",
    ),
)


def _for_image(rows: DataFrame) -> DataFrame:
    """Suggestions of all logs and modes, each log with image "a"."""
    return rows.withColumn("image_id", F.lit("a"))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.drop("image_id")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.with_features(telemetry(spark, sf_dir))


def fuel_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.apply_fuel(image(spark, "a"), I.catalog(spark), _for_image(fuel(_features(spark, sf_dir))))


def spark_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.apply_spark(image(spark, "a"), I.catalog(spark), _for_image(spark_rows(_features(spark, sf_dir))))


def smooth_sql(targets: str, n_rows: int, n_cols: int, name: str, outer: bool) -> str:
    second = "avg(delta) FILTER (WHERE d <= 2) * 0.25e0" if outer else "NULL"
    return f"""{name}n AS (SELECT t.log_id, t.mode, r, c, t.delta, greatest(abs(r - t."row"), abs(c - t.col)) AS d FROM range({n_rows}) AS a(r), range({n_cols}) AS b(c), {targets} t WHERE abs(r - t."row") <= 2 AND abs(c - t.col) <= 2),
{name}m AS (SELECT log_id, mode, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, coalesce(avg(delta) FILTER (WHERE d <= 1) * 0.5e0, {second}) AS delta FROM {name}n GROUP BY log_id, mode, r, c HAVING min(d) > 0),
{name} AS (SELECT log_id, mode, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, delta, false AS smoothed FROM {targets} UNION ALL SELECT log_id, mode, "row", col, delta, true FROM {name}m)"""


AXES = f"xr AS (SELECT unnest({I.RPM17}) AS v, unnest(generate_series(0, 16)) AS i), xm AS (SELECT unnest({I.MAP13}) AS v, unnest(generate_series(0, 12)) AS i)"
FUEL_TARGETS = """ft AS (SELECT log_id, mode, xr.i AS "row", xm.i AS col, first(delta_pct ORDER BY abs(avg_trim) DESC, first_row) AS delta FROM fsg JOIN xr ON xr.v BETWEEN rpm_lo AND rpm_lo + 500 JOIN xm ON xm.v BETWEEN map_lo AND map_lo + 10
  WHERE action <> 'none' AND table_name = 'Main VE' GROUP BY ALL)"""
PATCH = "SELECT log_id, mode, title, \"row\", col, address, size, raw AS old_value, greatest(0, least(CASE WHEN size = 2 THEN 65535 ELSE 255 END, {0})) AS new_value, {1} AS delta, smoothed FROM ta JOIN {2} s USING (\"row\", col) WHERE title = '{3}'"
READ_A = (IMAGES, CAT, read_sql("ia", "ta"))
FUEL_STEPS = (AXES, FUEL_TARGETS, smooth_sql("ft", 17, 13, "fsm", True), f"fpt AS ({PATCH.format(hi('raw * (1 + delta / 100)'), hu('delta'), 'fsm', 'Main VE')})", "fpp AS (SELECT * FROM fpt WHERE old_value <> new_value)")
FUEL_PATCH = (MODES, FUEL, *READ_A, *FUEL_STEPS)
register("apply_fuel", lambda spark, sf_dir: _shown(fuel_patches(spark, sf_dir)), with_(*FUEL_PATCH, "SELECT * FROM fpp"))
register(
    "grid_smooth",
    lambda spark, sf_dir: _shown(I.smoothed(I.fuel_targets(_for_image(fuel(_features(spark, sf_dir))).where("table_name = 'Main VE'"), I.RPM17, I.MAP13), 17, 13).withColumn("delta", I.S.half_up(F.col("delta"), 4))),
    with_(MODES, FUEL, AXES, FUEL_TARGETS, smooth_sql("ft", 17, 13, "fsm", True), f'SELECT log_id, mode, "row", col, {hu("delta", 4)} AS delta, smoothed FROM fsm'),
)
SPARK_STEPS = (
    """st AS (SELECT log_id, mode, "row", col, min(delta_deg) AS delta FROM ssg WHERE action <> 'none' GROUP BY ALL)""",
    smooth_sql("st", 17, 17, "ssm", False),
    f"spt AS ({PATCH.format('raw + ' + hi('delta * (255 / 90e0)'), hu('delta'), 'ssm', 'Spark Advance')})",
    "spp AS (SELECT * FROM spt WHERE delta IS NOT NULL AND old_value <> new_value)",
)
register("apply_spark", lambda spark, sf_dir: _shown(spark_patches(spark, sf_dir)), with_(MODES, NEAREST, SPARK, *READ_A, *SPARK_STEPS, "SELECT * FROM spp"))


def scale_sql(name: str, source: str, titles: list[str], percent: str, floor: int = 0) -> str:
    names = ", ".join(f"'{t}'" for t in titles)
    return (
        f'{name}0 AS (SELECT s.log_id, s.mode, title, "row", col, address, ta.size, raw AS old_value, least(255, greatest(least(raw, {floor}), {hi(f"raw * (1 + {percent} / 100)")})) AS new_value, {hu(percent)} AS delta, false AS smoothed '
        f"FROM ta, {source} s WHERE s.action <> 'none' AND title IN ({names})), {name} AS (SELECT * FROM {name}0 WHERE old_value <> new_value)"
    )


def _percent(rows: DataFrame, sign: int = 1) -> DataFrame:
    return _for_image(rows.where("action <> 'none'")).select(*I.KEYS, (sign * F.col("delta_pct")).alias("percent"))


def pe_changes(f: DataFrame) -> DataFrame:
    """Enrichment lowers the commanded air-fuel ratio."""
    return _percent(U.pe_suggestions(R.lambda_by_region(f)), -1)


def ae_changes(f: DataFrame) -> DataFrame:
    return _percent(U.ae_suggestions(E.tip_in_summary(f, E.tip_ins(f)), R.o2_cross_counts(f)))


def pe_entry_changes(f: DataFrame) -> DataFrame:
    return _percent(U.pe_entry_suggestions(R.pe_entry(f)))


def trans_changes(f: DataFrame) -> DataFrame:
    report = staged(E.transmission(f), "transmission")
    return _for_image(U.trans_changes(U.trans_suggestions(report), report))


PE_TITLES, AE_TITLES, ENTRY_TITLES, ENTRY_FLOOR = ["Power Enrichment"], ["AE vs D-TPS", "AE vs D-MAP"], ["PE Entry"], 128
SCALES = {"pep": ("pg", PE_TITLES, "-s.delta_pct", 0), "aep": ("ag", AE_TITLES, "s.delta_pct", 0), "enp": ("eg", ENTRY_TITLES, "s.delta_pct", ENTRY_FLOOR)}
_beyond = lambda sql: sql.removeprefix(B.FEATURES).lstrip(",\n ")
_scaled = lambda name: scale_sql(name, *SCALES[name])
register("apply_pe", lambda spark, sf_dir: _shown(I.apply_scale(image(spark, "a"), I.catalog(spark), PE_TITLES, pe_changes(_features(spark, sf_dir)))), with_(MODES, PESG, *READ_A, _scaled("pep"), "SELECT * FROM pep"))
register("apply_ae", lambda spark, sf_dir: _shown(I.apply_scale(image(spark, "a"), I.catalog(spark), AE_TITLES, ae_changes(_features(spark, sf_dir)))), recursive(with_(TIPIN, TIPSUM, MODES, AESG, *READ_A, _scaled("aep"), "SELECT * FROM aep")))
register("apply_pe_entry", lambda spark, sf_dir: _shown(I.apply_scale(image(spark, "a"), I.catalog(spark), ENTRY_TITLES, pe_entry_changes(_features(spark, sf_dir)), ENTRY_FLOOR)), with_(MODES, PEEG, *READ_A, _scaled("enp"), "SELECT * FROM enp"))
TRANS_STEPS = (
    """tw AS (SELECT log_id, mode, max(delta_pct) FILTER (WHERE kind = 'trans-firmness') AS firm, max(delta_pct) FILTER (WHERE kind = 'trans-kickdown') AS kick, max(delta_pct) FILTER (WHERE kind = 'trans-hunting') AS hunt FROM trg WHERE action <> 'none' GROUP BY log_id, mode),
tx AS (SELECT tw.*, worst_flare_mph, kickdown_mph, hunting_tps, hunting_pair FROM tw JOIN trn USING (log_id))""",
    f"""tp AS (
 SELECT log_id, mode, title, "row", col, address, size, raw AS old_value, least(255, {hi("raw * (1 + firm / 100)")}) AS new_value, firm AS delta FROM ta, tx WHERE title LIKE 'Line Pressure%' AND abs(CAST(x_label AS DOUBLE) - worst_flare_mph) <= 10 AND firm IS NOT NULL
 UNION ALL SELECT log_id, mode, d.title, d."row", d.col, d.address, d.size, d.raw, greatest(d.raw, least(255, {hi("d.raw * 1.5e0")}, coalesce(CAST(floor(u.raw * 0.9e0) AS BIGINT), 255), {hi("d.raw * (1 + kick / 100)")})), kick
   FROM tx, ta d LEFT JOIN ta u ON u.title = 'Normal Upshifts' AND u."row" = d."row" AND u.x_label = reverse(d.x_label) WHERE d.title = 'Normal Downshifts' AND abs(d.raw / 2 - kickdown_mph) <= 15 AND kick IS NOT NULL
 UNION ALL SELECT log_id, mode, title, "row", col, address, size, raw, least(255, {hi("raw * (1 + hunt / 100)")}), hunt FROM ta, tx WHERE title = 'Normal Upshifts' AND x_label = hunting_pair AND abs(CAST(y_label AS DOUBLE) - hunting_tps) <= 12.5 AND hunt IS NOT NULL
 UNION ALL SELECT log_id, mode, title, "row", col, address, size, raw, greatest(0, {hi("raw / (1 + hunt / 100)")}), -hunt FROM ta, tx WHERE title = 'Normal Downshifts' AND x_label = reverse(hunting_pair) AND abs(CAST(y_label AS DOUBLE) - hunting_tps) <= 12.5 AND hunt IS NOT NULL),
trp AS (SELECT log_id, mode, title, "row", col, address, size, old_value, new_value, delta, false AS smoothed FROM tp WHERE old_value <> new_value)""",
)
register("apply_trans", lambda spark, sf_dir: _shown(I.apply_transmission(image(spark, "a"), I.catalog(spark), trans_changes(_features(spark, sf_dir)))), recursive(with_(TRANS, MODES, TRSG, *READ_A, *TRANS_STEPS, "SELECT * FROM trp")))


def chained_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patches of all kinds of suggestions of all logs and modes, each stage on the images that the stage before left."""
    f, tables = _features(spark, sf_dir), I.catalog(spark)
    modes = F.explode(F.array(*map(F.lit, U.MODES)))
    sessions = _for_image(f.select("log_id").distinct().select("log_id", modes.alias("mode"))).select(*I.KEYS)
    stages = [
        ("fuel", lambda now: I.apply_fuel(now, tables, _for_image(fuel(f)))),
        ("spark", lambda now: I.apply_spark(now, tables, _for_image(spark_rows(f)))),
        ("pe", lambda now: I.apply_scale(now, tables, PE_TITLES, pe_changes(f))),
        ("ae", lambda now: I.apply_scale(now, tables, AE_TITLES, ae_changes(f))),
        ("pe-entry", lambda now: I.apply_scale(now, tables, ENTRY_TITLES, pe_entry_changes(f), ENTRY_FLOOR)),
        ("trans", lambda now: I.apply_transmission(now, tables, trans_changes(f))),
    ]
    return I.chained(image(spark, "a"), tables, sessions, stages)


CHAINED = (TRANS, _beyond(TIPIN), TIPSUM, MODES, FUEL, NEAREST, SPARK, PESG, AESG, PEEG, TRSG, *READ_A, *FUEL_STEPS, *SPARK_STEPS, *map(_scaled, SCALES), *TRANS_STEPS)
#: Stages write to tables of their own, so each one's old values are those of the first image.
register(
    "chained_patches",
    lambda spark, sf_dir: _shown(chained_patches(spark, sf_dir)),
    recursive(with_(*CHAINED, " UNION ALL ".join(f"SELECT *, '{stage}' AS stage FROM {name}" for stage, name in (("fuel", "fpp"), ("spark", "spp"), ("pe", "pep"), ("ae", "aep"), ("pe-entry", "enp"), ("trans", "trp"))))),
)
AFTER = """pw AS (SELECT log_id, mode, address AS "offset", CASE WHEN size = 2 THEN new_value // 256 ELSE new_value END AS nb FROM fpp UNION ALL SELECT log_id, mode, address + 1, new_value % 256 FROM fpp WHERE size = 2),
kk AS (SELECT DISTINCT log_id, mode FROM fpp),
pim AS (SELECT log_id || '/' || mode AS image_id, "offset", CAST(coalesce(nb, byte) AS INTEGER) AS byte FROM kk CROSS JOIN ia LEFT JOIN pw USING (log_id, mode, "offset"))"""


def _with_faults(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Image, patched images and patches, some of them broken on purpose."""
    good, before = staged(fuel_patches(spark, sf_dir), "patches"), image(spark, "a")
    col = F.col("col")
    bad = good.withColumns({
        "old_value": F.when(col == 3, F.col("old_value") + 1).otherwise(F.col("old_value")), "title": F.when(col == 4, "Idle VE").otherwise(F.col("title")),
        "new_value": F.when(col == 5, F.lit(70000)).otherwise(F.col("new_value")), "address": F.when(col == 7, F.col("address") + 65536).otherwise(F.col("address")),
    })
    twice = bad.where("col = 6").withColumn("delta", F.col("delta") + 1)
    return before, I.patched(I.within(before, I.catalog(spark)), good), bad.unionByName(twice)


register(
    "verify_patches",
    lambda spark, sf_dir: _shown(I.verify(*_with_faults(spark, sf_dir), _claimed_twice(spark))),
    with_(
        *FUEL_PATCH,
        "SELECT log_id, mode, title, address, 'old-value' AS failed FROM fpp WHERE col = 3 UNION ALL SELECT log_id, mode, 'Idle VE', address, 'table' FROM fpp WHERE col = 4 UNION ALL SELECT log_id, mode, title, address, 'value-range' FROM fpp WHERE col = 5 UNION ALL SELECT log_id, mode, title, address, 'read-back' FROM fpp WHERE col = 5"
        " UNION ALL SELECT log_id, mode, title, address, 'conflict' FROM fpp, range(2) WHERE col = 6 UNION ALL SELECT log_id, mode, title, address + 65536, 'range' FROM fpp WHERE col = 7 UNION ALL SELECT log_id, mode, title, address, 'overlap' FROM fpp WHERE address < 4100 AND col <> 7",
    ),
)


def _uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = staged(fuel_patches(spark, sf_dir), "patches")
    changed = image(spark, "b").withColumn("image_id", F.lit("a"))
    return _shown(I.uncovered(image(spark, "a"), I.patched(changed, good), good))


register(
    "uncovered_bytes",
    _uncovered,
    with_(*FUEL_PATCH, AFTER, 'SELECT log_id, mode, "offset", ia.byte AS old_byte, ib.byte AS new_byte FROM kk CROSS JOIN ia JOIN ib USING ("offset") ANTI JOIN pw USING (log_id, mode, "offset") WHERE ia.byte <> ib.byte'),
)


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, tables = I.within(image(spark, "a"), I.catalog(spark)), I.catalog(spark)
    return I.before_after(before, I.patched(before, staged(fuel_patches(spark, sf_dir), "patches")), tables)


MOVED = f'bf AS (SELECT CAST(split_part(tb.image_id, \'/\', 1) AS BIGINT) AS log_id, split_part(tb.image_id, \'/\', 2) AS mode, title, "row", col, ta.value AS before, tb.value AS after, {hu("tb.value - ta.value", 4)} AS change FROM ta JOIN tb USING (title, "row", col))'
register("table_before_after", lambda spark, sf_dir: _shown(_moved(spark, sf_dir)), with_(*FUEL_PATCH, AFTER, read_sql("pim", "tb"), MOVED, "SELECT * FROM bf"))
register(
    "biggest_moves",
    lambda spark, sf_dir: _shown(I.biggest_moves(_moved(spark, sf_dir))),
    with_(*FUEL_PATCH, AFTER, read_sql("pim", "tb"), MOVED, 'SELECT log_id, mode, title, count(*) AS changed, first("row" ORDER BY abs(change) DESC, "row", col) AS "row", first(col ORDER BY abs(change) DESC, "row", col) AS col, first(change ORDER BY abs(change) DESC, "row", col) AS change FROM bf WHERE change <> 0 GROUP BY log_id, mode, title'),
)
