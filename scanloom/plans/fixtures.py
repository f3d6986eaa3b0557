"""Catalogue, stream and raster views over the supplied tables, in Spark and in SQL.

Each view exists twice on purpose: the Spark form feeds the operators, the SQL text feeds the
independent check. All of them read whole tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scanloom import scale
from scanloom.schema import NAME_PREFIX
from scanloom.session import spread_shuffles, tune

NOW = "2026-01-01 00:00:00"
PIXEL_ROWS, PIXEL_COLS = 32, 24


def now() -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{NOW}'")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts)


# --- catalogue ---------------------------------------------------------------------------------


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit(NAME_PREFIX), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).alias("name"),
        F.col("o_orderdate").alias("created_at"),
        F.expr("o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 86400)").alias("updated_at"),
    )


def pages(spark: SparkSession, sf_dir: str, with_dims: bool = False) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    numbered = scale.number_rows(
        lines,
        ["l_orderkey"],
        F.struct("l_linenumber", scale.span_bucket(F.col("l_partkey"))),
        # The flags decide nothing that the others leave open but for rows that differ in them alone; with them
        # all readers of a query need the same columns of the lines and share one shuffle.
        ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"],
        "rn",
    )
    page_id = F.col("l_orderkey") * 100 + F.col("rn")
    kind = F.col("l_partkey") % 7
    preset = (
        F.when(kind == 0, "original")
        .when(kind == 1, "sharpen")
        .when(kind == 2, "bw")
        .when(kind == 3, "magic")
        .when(kind == 4, "whiteboard")
        .when(kind == 5, "vivid")
        .otherwise("legacy")
    )
    columns = [
        page_id.alias("id"),
        F.col("l_orderkey").alias("document_id"),
        F.col("rn").cast("int").alias("sort_order"),
        F.concat(F.lit("img_"), F.col("l_partkey").cast("string"), F.lit(".jpg")).alias("image_path"),
        preset.alias("filter_name"),
        ((F.col("l_suppkey") % 4) * 90).cast("int").alias("rotation_degrees"),
        F.when(F.col("l_returnflag") != "R", F.concat(F.lit("s_"), page_id.cast("string"), F.lit(".jpg"))).alias(
            "small_preview_path"
        ),
        F.when(F.col("l_linestatus") != "O", F.concat(F.lit("l_"), page_id.cast("string"), F.lit(".jpg"))).alias(
            "large_preview_path"
        ),
    ]
    if with_dims:
        columns += [
            (600 + (F.col("l_partkey") * 37) % 2600).cast("int").alias("img_w"),
            (600 + (F.col("l_suppkey") * 53 + F.col("l_partkey") * 11) % 2600).cast("int").alias("img_h"),
        ]
    return numbered.select(*columns)


SQL_DOCUMENTS = f"""scan_documents AS (
  SELECT o_orderkey AS id, concat('{NAME_PREFIX}', strftime(o_orderdate, '%Y-%m-%d %H:%M')) AS name,
    o_orderdate AS created_at, o_orderdate + to_seconds(o_orderkey % 86400) AS updated_at FROM orders)"""

SQL_PAGES = """scan_pages AS (
  SELECT l_orderkey*100 + rn AS id, l_orderkey AS document_id, cast(rn AS int) AS sort_order,
    concat('img_', cast(l_partkey AS varchar), '.jpg') AS image_path,
    CASE l_partkey % 7 WHEN 0 THEN 'original' WHEN 1 THEN 'sharpen' WHEN 2 THEN 'bw' WHEN 3 THEN 'magic'
      WHEN 4 THEN 'whiteboard' WHEN 5 THEN 'vivid' ELSE 'legacy' END AS filter_name,
    cast((l_suppkey % 4) * 90 AS int) AS rotation_degrees,
    CASE WHEN l_returnflag = 'R' THEN NULL ELSE concat('s_', cast(l_orderkey*100 + rn AS varchar), '.jpg') END
      AS small_preview_path,
    CASE WHEN l_linestatus = 'O' THEN NULL ELSE concat('l_', cast(l_orderkey*100 + rn AS varchar), '.jpg') END
      AS large_preview_path,
    cast(600 + (l_partkey*37) % 2600 AS int) AS img_w,
    cast(600 + (l_suppkey*53 + l_partkey*11) % 2600 AS int) AS img_h
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
    l_shipdate, l_quantity, l_extendedprice) - 1 AS rn FROM lineitem) t)"""

CATALOGUE = f"WITH {SQL_DOCUMENTS}, {SQL_PAGES} "


# --- artefacts ---------------------------------------------------------------------------------


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File listing (cache_id, kind, file_name, size, mtime): some previews missing, some working files."""
    p = pages(spark, sf_dir)
    size = 10000 + (F.col("id") * 7919) % 90000
    mtime = F.expr("TIMESTAMP_NTZ '2025-01-01 00:00:00' + make_dt_interval(0, 0, 0, (id * 31) % 8640000)")
    working = F.concat_ws("_", F.col("id").cast("string"), "filter_name", F.col("rotation_degrees").cast("string"))

    def files(kind: str, name: Column, keep: Column) -> DataFrame:
        return p.filter(keep).select(
            F.lit("device").alias("cache_id"),
            F.lit(kind).alias("kind"),
            name.alias("file_name"),
            size.alias("size"),
            mtime.alias("mtime"),
        )

    small = files("small", F.col("small_preview_path"), F.col("small_preview_path").isNotNull() & (F.col("id") % 5 != 0))
    large = files("large", F.col("large_preview_path"), F.col("large_preview_path").isNotNull() & (F.col("id") % 7 != 0))
    work = files("working", F.concat(working, F.lit(".jpg")), F.col("id") % 3 == 0)
    return small.unionByName(large).unionByName(work)


SQL_INVENTORY = """file_inventory AS (
  SELECT 'device' AS cache_id, kind, file_name, 10000 + (id*7919) % 90000 AS size,
    TIMESTAMP '2025-01-01 00:00:00' + to_seconds((id*31) % 8640000) AS mtime
  FROM (SELECT 'small' AS kind, small_preview_path AS file_name, id FROM scan_pages
          WHERE small_preview_path IS NOT NULL AND id % 5 <> 0
        UNION ALL SELECT 'large', large_preview_path, id FROM scan_pages
          WHERE large_preview_path IS NOT NULL AND id % 7 <> 0
        UNION ALL SELECT 'working', concat(id::varchar, '_', filter_name, '_', rotation_degrees::varchar, '.jpg'), id
          FROM scan_pages WHERE id % 3 = 0) f)"""

ARTEFACTS = f"WITH {SQL_DOCUMENTS}, {SQL_PAGES}, {SQL_INVENTORY} "


# --- streams -----------------------------------------------------------------------------------


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection frames (frame_id, session_id, ts_ms, corners?) in normalised coordinates."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("frame_id"),
        F.col("user_id").alias("session_id"),
        F.floor(epoch_micros(F.col("ts")) / F.lit(250_000_000)).cast("long").alias("ts_ms"),
        frame_corners(frame_jitter()).alias("corners"),
    )


def frame_jitter() -> Column:
    return F.when(
        ~F.col("event_type").isin("error", "signup", "view"),
        F.floor(F.col("value") * 100).cast("int") % 97,
    )


def frame_corners(j: Column) -> Column:
    def point(x: Column, y: Column) -> Column:
        return F.struct((x / F.lit(1000.0)).alias("x"), (y / F.lit(1400.0)).alias("y"))

    return F.when(
        j.isNotNull(),
        F.array(point(100 + j, 100 + j), point(900 - j, 100 + j), point(900 - j, 1300 - j), point(100 + j, 1300 - j)),
    )


SQL_FRAMES = """frames AS (
  SELECT event_id AS frame_id, user_id AS session_id, epoch_us(ts) // 250000000 AS ts_ms,
    CASE WHEN event_type IN ('error','signup','view') THEN NULL ELSE cast(floor(value*100) AS int) % 97 END AS j
  FROM events)"""

# Pages of a session are edited together: ten users make one document.
COMMANDS = {"click": "rotate", "view": "select_filter", "purchase": "apply_all", "error": "discard", "signup": "apply"}


def edit_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    command = F.lit(None).cast("string")
    for event, name in COMMANDS.items():
        command = F.when(F.col("event_type") == event, name).otherwise(command)
    number = F.floor(F.col("value") * 100).cast("int") % 6
    presets = F.array(*[F.lit(k) for k in ("original", "sharpen", "bw", "magic", "whiteboard", "vivid")])
    return events.select(
        F.col("event_id").alias("seq"),
        F.floor(F.col("user_id") / 10).cast("long").alias("document_id"),
        F.col("user_id").alias("page_id"),
        F.col("ts"),
        command.alias("command"),
        F.when(command.isin("select_filter", "apply_all"), F.get(presets, number)).alias("filter_name"),
    )


def edited_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved state of the pages the command log talks about."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(
        F.col("user_id").alias("id"),
        F.floor(F.col("user_id") / 10).cast("long").alias("document_id"),
        (F.col("user_id") % 10).cast("int").alias("sort_order"),
        F.when(F.col("user_id") % 2 == 0, "original").otherwise("bw").alias("filter_name"),
        ((F.col("user_id") % 4) * 90).cast("int").alias("rotation_degrees"),
    )


SQL_EDITS = """commands AS (
  SELECT event_id AS seq, user_id // 10 AS document_id, user_id AS page_id, ts,
    CASE event_type WHEN 'click' THEN 'rotate' WHEN 'view' THEN 'select_filter' WHEN 'purchase' THEN 'apply_all'
      WHEN 'error' THEN 'discard' WHEN 'signup' THEN 'apply' END AS command,
    CASE WHEN event_type IN ('view', 'purchase') THEN
      ['original','sharpen','bw','magic','whiteboard','vivid'][cast(floor(value*100) AS int) % 6 + 1] END AS filter_name
  FROM events),
saved AS (
  SELECT DISTINCT user_id AS id, user_id // 10 AS document_id, cast(user_id % 10 AS int) AS sort_order,
    CASE WHEN user_id % 2 = 0 THEN 'original' ELSE 'bw' END AS filter_name,
    cast((user_id % 4) * 90 AS int) AS rotation_degrees FROM events)"""


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations")
    return talk.select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("seq"),
        (F.col("role") != "user").alias("is_retake"),
        F.when(F.col("role") != "user", F.col("conv_id") * 100).alias("retake_page_id"),
    )


SQL_CAPTURES = """captures AS (
  SELECT conv_id AS session_id, turn AS seq, role <> 'user' AS is_retake,
    CASE WHEN role <> 'user' THEN conv_id * 100 END AS retake_page_id FROM conversations)"""


# --- quads -------------------------------------------------------------------------------------

SHIFTS = (3, 5, 7, 11, 13, 17, 19, 29)


def candidate_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate outlines per image: integer corners, where they came from, image size."""
    events = table(spark, sf_dir, "events").withColumn("j", frame_jitter()).filter(F.col("j").isNotNull())
    j, e = F.col("j"), F.col("event_id")
    base = [100 + j, 100 + j, 900 - j, 100 + j, 900 - j, 1300 - j, 100 + j, 1300 - j]
    moved = [b + (e * k) % 23 for b, k in zip(base, SHIFTS)]
    small = F.when(e % 13 == 0, 10).otherwise(1)
    xy = [F.floor(v / small).cast("int") for v in moved]
    points = [F.struct(xy[2 * i].alias("x"), xy[2 * i + 1].alias("y")) for i in range(4)]
    crossed = e % 11 == 0
    return events.select(
        F.col("user_id").alias("image_id"),
        F.col("event_id").alias("cand_id"),
        # Generated rather than projected, so filters on corners are not expanded into their formula.
        F.explode(
            F.array(F.when(crossed, F.array(points[0], points[2], points[1], points[3])).otherwise(F.array(*points)))
        ).alias("corners"),
        F.when(e % 2 == 0, "merged").otherwise("paper").alias("source"),
        F.when(e % 3 == 0, "minAreaRect").otherwise("quad").alias("kind"),
        F.lit(1000).alias("img_w"),
        F.lit(1400).alias("img_h"),
    )


def _sql_quads() -> str:
    base = ["100+j", "100+j", "900-j", "100+j", "900-j", "1300-j", "100+j", "1300-j"]
    names = ["x1", "y1", "x2", "y2", "x3", "y3", "x4", "y4"]
    swapped = {"x2": "x3", "y2": "y3", "x3": "x2", "y3": "y2"}
    raw = ", ".join(
        f"cast(floor(({b} + (event_id*{k}) % 23) / (CASE WHEN event_id % 13 = 0 THEN 10 ELSE 1 END)) AS int) AS {n}_"
        for b, k, n in zip(base, SHIFTS, names)
    )
    final = ", ".join(
        f"CASE WHEN cand_id % 11 = 0 THEN {swapped.get(n, n)}_ ELSE {n}_ END AS {n}" for n in names
    )
    return f"""quads AS (
  SELECT image_id, cand_id, {final}, source, kind, 1000 AS img_w, 1400 AS img_h FROM (
    SELECT user_id AS image_id, event_id AS cand_id, {raw},
      CASE WHEN event_id % 2 = 0 THEN 'merged' ELSE 'paper' END AS source,
      CASE WHEN event_id % 3 = 0 THEN 'minAreaRect' ELSE 'quad' END AS kind
    FROM (SELECT *, cast(floor(value*100) AS int) % 97 AS j FROM events
          WHERE event_type NOT IN ('error','signup','view')) e) q)"""


SQL_QUADS = _sql_quads()


# --- raster ------------------------------------------------------------------------------------


# Parts whose images one task makes: a few bytes per part become a whole image.
PARTS_PER_TASK = 4096
# Parts whose images meet in one partition of a shuffle before Spark joins small ones.
PARTS_PER_SHUFFLED = 2048


def page_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small page image per part, as scanlines (page_id, y, h, w, r, g, b)."""
    from scanloom.llm.common import ship
    from scanloom.raster.grid import to_bands

    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"))
    # The parts are spread before they grow, over more tasks the more there are; Spark counts them from the footers.
    n = parts.count()
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // PARTS_PER_TASK))
    spread_shuffles(spark, -(-n // PARTS_PER_SHUFFLED))
    ship(spark)
    lines = parts.repartition(tasks, "page_id").select(
        "page_id", F.explode(F.sequence(F.lit(0), F.lit(PIXEL_ROWS - 1))).alias("y")
    )
    drawn = F.arrow_udf(draw_lines, "struct<r:array<int>,g:array<int>,b:array<int>>")
    lines = lines.withColumn("_drawn", drawn(F.col("page_id").cast("bigint"), "y"))
    return to_bands(
        lines.select("page_id", "y", F.lit(PIXEL_ROWS).alias("h"), F.lit(PIXEL_COLS).alias("w"), *[F.col(f"_drawn.{c}").alias(c) for c in "rgb"])
    )


def draw_lines(page_id: pa.Array, y: pa.Array) -> pa.Array:
    """The image lines ``y`` of parts; without a key their pixels are missing."""
    known = pc.is_valid(page_id).to_numpy(zero_copy_only=False)
    k = pc.fill_null(page_id, 0).to_numpy(zero_copy_only=False)[:, None]
    y, x = y.to_numpy(zero_copy_only=False)[:, None].astype(np.int64), np.arange(PIXEL_COLS)[None, :]
    # Remainders keep their dividend's sign, as in SQL.
    ink = np.fmod(x * 7 + np.fmod(y * 13 + k * 17, 19), 19) == 0
    offsets = pa.array(np.arange(len(k) + 1, dtype=np.int32) * PIXEL_COLS)

    def channel(dark, base: int, step: int) -> pa.Array:
        values = np.where(ink, dark, base + np.fmod(x * 3 + np.fmod(y * 2 + k * step, 90), 90)).astype(np.int32).ravel()
        gone = None if known.all() else np.repeat(~known, PIXEL_COLS)
        return pa.ListArray.from_arrays(offsets, pa.array(values, mask=gone))

    dark, blue = 40 + np.fmod(k, 30), 120 + np.fmod(k, 50)
    return pa.StructArray.from_arrays([channel(dark, 150, 11), channel(dark, 145, 7), channel(blue, 135, 5)], names=list("rgb"))


SQL_PIXELS = f"""px AS (
  SELECT p_partkey AS page_id, y::int AS y, x::int AS x,
    cast(CASE WHEN (x*7+y*13+p_partkey*17) % 19 = 0 THEN 40 + p_partkey % 30 ELSE 150 + (x*3+y*2+p_partkey*11) % 90 END AS int) AS r,
    cast(CASE WHEN (x*7+y*13+p_partkey*17) % 19 = 0 THEN 40 + p_partkey % 30 ELSE 145 + (x*3+y*2+p_partkey*7) % 90 END AS int) AS g,
    cast(CASE WHEN (x*7+y*13+p_partkey*17) % 19 = 0 THEN 120 + p_partkey % 50 ELSE 135 + (x*3+y*2+p_partkey*5) % 90 END AS int) AS b
  FROM part, range({PIXEL_ROWS}) ry(y), range({PIXEL_COLS}) rx(x))"""


def page_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One outline per page image."""
    k = F.col("p_partkey")

    def point(x: Column, y: Column) -> Column:
        return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))

    return table(spark, sf_dir, "part").select(
        k.alias("page_id"),
        F.lit(0).alias("cand_id"),
        F.array(
            point(2 + k % 3, 3 + k % 4), point(20 - k % 2, 2 + k % 3), point(21 - k % 3, 28 - k % 4), point(1 + k % 2, 27 - k % 3)
        ).alias("corners"),
    )


SQL_PAGE_QUADS = """pq AS (SELECT p_partkey AS page_id, 2 + p_partkey % 3 AS x0, 3 + p_partkey % 4 AS y0, 20 - p_partkey % 2 AS x1,
  2 + p_partkey % 3 AS y1, 21 - p_partkey % 3 AS x2, 28 - p_partkey % 4 AS y2, 1 + p_partkey % 2 AS x3, 27 - p_partkey % 3 AS y3 FROM part)"""


def raster_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page rows for the page images: every preset and an unknown key."""
    keys = F.array(*[F.lit(v) for v in ("original", "sharpen", "bw", "magic", "whiteboard", "vivid", "legacy")])
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.get(keys, (F.col("p_partkey") % 7).cast("int")).alias("filter_name")
    )
