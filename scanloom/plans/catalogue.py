"""Catalogue queries and mutations over the supplied tables, each with its SQL check."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.operators import artefacts as art, catalog as cat, mutations as mut
from scanloom.plans import fixtures as fx
from scanloom.plans.fixtures import CATALOGUE, NOW
from scanloom.registry import query
from scanloom.schema import NAME_PREFIX, PAGES_V1

NOW_SQL = f"TIMESTAMP '{NOW}'"
PAGE_COLUMNS = (
    "id, document_id, sort_order, image_path, filter_name, rotation_degrees, small_preview_path, large_preview_path"
)


def orders_with(spark, sf, status: str):
    """Documents picked by an attribute of their source row."""
    orders = fx.table(spark, sf, "orders")
    return orders.filter(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias("id"))


@query("catalog_scan", CATALOGUE + """
SELECT d.id AS document_id, d.name, d.created_at, d.updated_at, p.id AS page_id, p.sort_order, p.image_path
FROM scan_documents d JOIN scan_pages p ON p.document_id = d.id""")
def catalog_scan(spark, sf):
    d, p = fx.documents(spark, sf), fx.pages(spark, sf)
    return d.withColumnRenamed("id", "document_id").join(
        p.select(F.col("id").alias("page_id"), "document_id", "sort_order", "image_path"), "document_id"
    )


@query("schema_upgrade", CATALOGUE + """
SELECT id, document_id, sort_order, image_path, filter_name, rotation_degrees,
  cast(NULL AS varchar) AS small_preview_path, cast(NULL AS varchar) AS large_preview_path FROM scan_pages""")
def schema_upgrade(spark, sf):
    return cat.upgrade_pages(fx.pages(spark, sf).select(*PAGES_V1.fieldNames()))


@query("page_insert_defaults", CATALOGUE + """
SELECT id, document_id, sort_order, image_path, coalesce(nullif(filter_name, 'legacy'), 'original') AS filter_name,
  cast(0 AS int) AS rotation_degrees, cast(NULL AS varchar) AS small_preview_path,
  cast(NULL AS varchar) AS large_preview_path FROM scan_pages""")
def page_insert_defaults(spark, sf):
    given = fx.pages(spark, sf).select(
        "id", "document_id", "sort_order", "image_path",
        F.when(F.col("filter_name") != "legacy", F.col("filter_name")).alias("filter_name"),
    )
    return cat.with_page_defaults(given)


@query("document_by_id", CATALOGUE + "SELECT * FROM scan_documents WHERE id = (SELECT max(id) FROM scan_documents)")
def document_by_id(spark, sf):
    d = fx.documents(spark, sf)
    return cat.document_by_id(d, d.select(F.max("id")).scalar())


@query("page_by_id", CATALOGUE + f"SELECT {PAGE_COLUMNS} FROM scan_pages WHERE id = (SELECT max(id) FROM scan_pages)")
def page_by_id(spark, sf):
    p = fx.pages(spark, sf)
    return cat.page_by_id(p, p.select(F.max("id")).scalar())


@query("pages_of_document", CATALOGUE + f"""
SELECT {PAGE_COLUMNS} FROM scan_pages WHERE document_id = (SELECT max(document_id) FROM scan_pages)
ORDER BY sort_order, id""")
def pages_of_document(spark, sf):
    p = fx.pages(spark, sf)
    return cat.pages_of(p, p.select(F.max("document_id")).scalar())


@query("image_path_of_page", CATALOGUE + "SELECT image_path FROM scan_pages WHERE id = (SELECT max(id) FROM scan_pages)")
def image_path_of_page(spark, sf):
    p = fx.pages(spark, sf)
    return cat.image_path_of(p, p.select(F.max("id")).scalar())


def _attr_query(name: str, attr: str, column: str):
    sql = CATALOGUE + f"""SELECT document_id, id AS page_id{'' if attr == 'id' else ', ' + attr} FROM scan_pages
      WHERE document_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"""

    @query(name, sql)
    def build(spark, sf):
        found = cat.page_attr_for_documents(fx.pages(spark, sf), orders_with(spark, sf, "F"), attr)
        return found.select("document_id", "page_id") if attr == "id" else found

    return build


_attr_query("image_paths_of_documents", "image_path", "image_path")
_attr_query("small_previews_of_documents", "small_preview_path", "small_preview_path")
_attr_query("large_previews_of_documents", "large_preview_path", "large_preview_path")
_attr_query("page_ids_of_documents", "id", "page_id")

PRESET_SQL = "CASE WHEN {c} IN ('original','sharpen','bw','magic','whiteboard','vivid') THEN {c} ELSE 'original' END"
PRESET_NAME_SQL = """CASE {k} WHEN 'original' THEN 'オリジナル' WHEN 'sharpen' THEN 'くっきり' WHEN 'bw' THEN '白黒'
  WHEN 'magic' THEN 'マジック' WHEN 'whiteboard' THEN 'ホワイトボード' WHEN 'vivid' THEN '鮮やか' END"""


@query("preset_lookup", CATALOGUE + f"""
SELECT id, filter_name, preset, {PRESET_NAME_SQL.format(k='preset')} AS preset_name
FROM (SELECT id, filter_name, {PRESET_SQL.format(c='filter_name')} AS preset FROM scan_pages) t""")
def preset_lookup(spark, sf):
    return cat.resolve_preset(fx.pages(spark, sf).select("id", "filter_name"))


@query("document_summary", CATALOGUE + """
SELECT d.id, d.name, d.updated_at, count(p.id) AS page_count,
  (SELECT p2.small_preview_path FROM scan_pages p2 WHERE p2.document_id = d.id ORDER BY p2.sort_order, p2.id LIMIT 1)
    AS first_small_preview
FROM scan_documents d LEFT JOIN scan_pages p ON p.document_id = d.id GROUP BY d.id, d.name, d.updated_at
ORDER BY d.updated_at DESC, d.id""")
def document_summary(spark, sf):
    return cat.recent_documents(cat.document_summary(fx.documents(spark, sf), fx.pages(spark, sf)))


@query("documents_with_pages", CATALOGUE + """
SELECT d.id, d.name, p.id AS page_id, p.sort_order FROM scan_documents d LEFT JOIN scan_pages p ON p.document_id = d.id""")
def documents_with_pages(spark, sf):
    p = fx.pages(spark, sf).select(F.col("document_id").alias("id"), F.col("id").alias("page_id"), "sort_order")
    return fx.documents(spark, sf).select("id", "name").join(p, "id", "left")


@query("recent_documents", CATALOGUE + "SELECT * FROM scan_documents ORDER BY updated_at DESC, id")
def recent_documents(spark, sf):
    return cat.recent_documents(fx.documents(spark, sf))


@query("page_count", CATALOGUE + "SELECT document_id, count(*) AS page_count FROM scan_pages GROUP BY document_id")
def page_count(spark, sf):
    return cat.page_count(fx.pages(spark, sf))


@query("last_page_preview", CATALOGUE + """
SELECT document_id, count(*) AS captured_count, arg_max_null(small_preview_path, sort_order) AS last_small_preview
FROM scan_pages GROUP BY document_id""")
def last_page_preview(spark, sf):
    return cat.last_page_preview(fx.pages(spark, sf))


@query("collect_pages", CATALOGUE + """
SELECT document_id, cast(0 AS bigint) AS part, count(*) AS n,
  string_agg(concat(sort_order::varchar, ':', image_path, ':', filter_name, ':', rotation_degrees::varchar), '|'
             ORDER BY sort_order) AS listing
FROM scan_pages GROUP BY document_id""")
def collect_pages(spark, sf):
    lists = cat.collect_pages(fx.pages(spark, sf), ["image_path", "filter_name", "rotation_degrees"])
    entry = lambda p: F.concat_ws(
        ":", p["pos"].cast("string"), p["image_path"], p["filter_name"], p["rotation_degrees"].cast("string")
    )
    return lists.select(
        "document_id", "part", F.size("pages").cast("long").alias("n"),
        F.array_join(F.transform("pages", entry), "|").alias("listing"),
    )


# Pages that stay after deleting every page whose line was returned.
DELETED = "SELECT id FROM scan_pages WHERE small_preview_path IS NULL"


@query("renumber_after_delete", CATALOGUE + f"""
SELECT id, document_id, image_path,
  cast(row_number() OVER (PARTITION BY document_id ORDER BY sort_order, id) - 1 AS int) AS sort_order
FROM scan_pages WHERE id NOT IN ({DELETED})""")
def renumber_after_delete(spark, sf):
    left = fx.pages(spark, sf).filter(F.col("small_preview_path").isNotNull())
    return cat.renumber(left.select("id", "document_id", "image_path", "sort_order"))


@query("page_numbers", CATALOGUE + """
SELECT id, document_id, row_number() OVER (PARTITION BY document_id ORDER BY sort_order, id) AS page_number FROM scan_pages""")
def page_numbers(spark, sf):
    return cat.page_numbers(fx.pages(spark, sf)).select("id", "document_id", "page_number")


def listed_order(spark, sf):
    """A new order that names the pages with a large preview, last first, and every third of them twice."""
    p = fx.pages(spark, sf).filter(F.col("large_preview_path").isNotNull())
    flipped = p.select("document_id", F.col("id").alias("page_id"), (-F.col("sort_order")).alias("back"), "id")
    from scanloom import scale

    once = scale.number_rows(
        flipped, ["document_id"], scale.span_bucket(F.col("back")), ["back", "id"], "position"
    ).select("document_id", "page_id", "position")
    again = once.filter(F.col("page_id") % 3 == 0).withColumn("position", F.col("position") + 100)
    return once.unionByName(again)


LISTED = """listed AS (SELECT document_id, id AS page_id,
  row_number() OVER (PARTITION BY document_id ORDER BY sort_order DESC, id) - 1
    + CASE WHEN id % 3 = 0 THEN 100 ELSE 0 END AS position
  FROM scan_pages WHERE large_preview_path IS NOT NULL)"""


@query("order_with_missing", CATALOGUE + f""", {LISTED}
SELECT p.id, p.document_id, row_number() OVER (PARTITION BY p.document_id
  ORDER BY (l.page_id IS NULL), coalesce(l.position, p.sort_order), p.id) - 1 AS resolved_order
FROM scan_pages p LEFT JOIN listed l ON l.page_id = p.id""")
def order_with_missing(spark, sf):
    found = cat.order_with_missing(fx.pages(spark, sf), listed_order(spark, sf))
    return found.select("id", "document_id", "resolved_order")


@query("cascade_delete", CATALOGUE + """
SELECT 'document' AS kept, id FROM scan_documents WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT 'page', id FROM scan_pages
WHERE document_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def cascade_delete(spark, sf):
    d, p = cat.cascade_delete(fx.documents(spark, sf), fx.pages(spark, sf), orders_with(spark, sf, "F"))
    return d.select(F.lit("document").alias("kept"), "id").unionByName(p.select(F.lit("page").alias("kept"), "id"))


# --- edits against saved pages: the edit turns pages of one filter and switches another ----------


def edits_of(pages):
    """Edits for pages that have a small preview: vivid becomes bw, whiteboard pages turn left."""
    return pages.filter(F.col("small_preview_path").isNotNull()).select(
        F.col("id").alias("page_id"),
        "document_id",
        "sort_order",
        F.when(F.col("filter_name") == "vivid", "bw").otherwise(F.col("filter_name")).alias("filter_name"),
        F.when(F.col("filter_name") == "whiteboard", (F.col("rotation_degrees") + 270) % 360)
        .otherwise(F.col("rotation_degrees"))
        .cast("int")
        .alias("rotation_degrees"),
    )


EDITS = """edits AS (SELECT id AS page_id, document_id, sort_order,
  CASE WHEN filter_name = 'vivid' THEN 'bw' ELSE filter_name END AS filter_name,
  cast(CASE WHEN filter_name = 'whiteboard' THEN (rotation_degrees + 270) % 360 ELSE rotation_degrees END AS int)
    AS rotation_degrees
  FROM scan_pages WHERE small_preview_path IS NOT NULL)"""


@query("unsaved_edits", CATALOGUE + f""", {EDITS}
SELECT e.page_id, e.filter_name, e.rotation_degrees,
  coalesce(e.filter_name <> s.filter_name OR e.rotation_degrees <> s.rotation_degrees, false) AS has_unsaved
FROM edits e LEFT JOIN (SELECT * FROM scan_pages WHERE large_preview_path IS NOT NULL) s ON s.id = e.page_id""")
def unsaved_edits(spark, sf):
    p = fx.pages(spark, sf)
    saved = p.filter(F.col("large_preview_path").isNotNull())
    return cat.unsaved_edits(edits_of(p).select("page_id", "filter_name", "rotation_degrees"), saved)


@query("refresh_edits", CATALOGUE + f""", {EDITS}
SELECT e.page_id, e.filter_name, e.rotation_degrees, coalesce(s.image_path, 'unsaved.jpg') AS image_path,
  CASE WHEN s.id IS NULL THEN 'old.jpg' ELSE s.large_preview_path END AS large_preview_path
FROM edits e LEFT JOIN (SELECT * FROM scan_pages WHERE filter_name <> 'magic') s ON s.id = e.page_id""")
def refresh_edits(spark, sf):
    p = fx.pages(spark, sf)
    edits = edits_of(p).select(
        "page_id", "filter_name", "rotation_degrees",
        F.lit("unsaved.jpg").alias("image_path"), F.lit("old.jpg").alias("large_preview_path"),
    )
    return cat.refresh_edits(edits, p.filter(F.col("filter_name") != "magic"))


@query("document_dirty", CATALOGUE + f""", {EDITS},
a AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY sort_order, page_id) AS k,
  filter_name, rotation_degrees FROM edits),
b AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY sort_order, id) AS k,
  filter_name, rotation_degrees FROM scan_pages)
SELECT coalesce(a.document_id, b.document_id) AS document_id,
  bool_or(a.k IS NULL OR b.k IS NULL OR a.filter_name <> b.filter_name OR a.rotation_degrees <> b.rotation_degrees) AS is_dirty
FROM a FULL JOIN b ON a.document_id = b.document_id AND a.k = b.k GROUP BY 1""")
def document_dirty(spark, sf):
    p = fx.pages(spark, sf)
    return cat.document_dirty(edits_of(p).withColumnRenamed("page_id", "id"), p)


# --- mutations -----------------------------------------------------------------------------------


@query("create_documents", CATALOGUE + f"""
SELECT * FROM scan_documents UNION ALL
SELECT 1000000000 + c_custkey, CASE WHEN c_acctbal < 0 THEN concat('{NAME_PREFIX}', strftime({NOW_SQL}, '%Y-%m-%d %H:%M'))
  ELSE c_name END, {NOW_SQL}, {NOW_SQL} FROM customer""")
def create_documents(spark, sf):
    new = fx.table(spark, sf, "customer").select(
        (1000000000 + F.col("c_custkey")).alias("id"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("name"),
    )
    return mut.create_documents(fx.documents(spark, sf), new, fx.now())


def rename_commands(spark, sf):
    """Open orders get a new name padded with white space of several kinds, finished ones a blank of
    full-width spaces, the rest a name for an unknown document."""
    return fx.table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey") + 2000000000)
        .otherwise(F.col("o_orderkey")).alias("document_id"),
        F.when(F.col("o_orderstatus") == "F", " \u3000\u00a0")
        .otherwise(F.concat(F.lit("\t\u3000 "), "o_orderpriority", F.lit("\n\u2003"))).alias("name"),
        F.col("o_custkey").alias("seq"),
    )


@query("rename_documents", CATALOGUE + f"""
SELECT d.id, CASE WHEN o.o_orderstatus = 'O' THEN trim(o.o_orderpriority) ELSE d.name END AS name, d.created_at,
  CASE WHEN o.o_orderstatus = 'O' THEN {NOW_SQL} ELSE d.updated_at END AS updated_at
FROM scan_documents d JOIN orders o ON o.o_orderkey = d.id""")
def rename_documents(spark, sf):
    return mut.rename(fx.documents(spark, sf), rename_commands(spark, sf), fx.now())


@query("delete_documents", fx.ARTEFACTS + """, gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'),
doomed AS (SELECT * FROM scan_pages WHERE document_id IN (SELECT o_orderkey FROM gone))
SELECT 'document' AS what, id, NULL AS file_name FROM scan_documents WHERE id NOT IN (SELECT o_orderkey FROM gone)
UNION ALL SELECT 'page', id, NULL FROM scan_pages WHERE document_id NOT IN (SELECT o_orderkey FROM gone)
UNION ALL SELECT 'source', id, image_path FROM doomed
UNION ALL SELECT 'small', id, small_preview_path FROM doomed WHERE small_preview_path IS NOT NULL
UNION ALL SELECT 'large', id, large_preview_path FROM doomed WHERE large_preview_path IS NOT NULL
UNION ALL SELECT 'working', d.id, f.file_name FROM doomed d JOIN file_inventory f
  ON f.kind = 'working' AND cast(split_part(f.file_name, '_', 1) AS bigint) = d.id""")
def delete_documents(spark, sf):
    d, p, files = mut.delete_documents(
        fx.documents(spark, sf), fx.pages(spark, sf), orders_with(spark, sf, "F"), fx.inventory(spark, sf)
    )
    nothing = F.lit(None).cast("string").alias("file_name")
    return (
        d.select(F.lit("document").alias("what"), "id", nothing)
        .unionByName(p.select(F.lit("page").alias("what"), "id", nothing))
        .unionByName(files.select(F.col("kind").alias("what"), F.col("page_id").alias("id"), "file_name"))
    )


def new_pages(spark, sf):
    """A capture per returned line of every document."""
    p = fx.pages(spark, sf).filter(F.col("small_preview_path").isNull())
    return p.select(
        (F.col("id") + 100000000000).alias("id"), "document_id",
        F.col("sort_order").alias("capture_index"),
        F.concat(F.lit("new_"), F.col("id").cast("string"), F.lit(".jpg")).alias("image_path"),
    )


NEW_PAGES = """fresh AS (SELECT id + 100000000000 AS id, document_id, sort_order AS capture_index,
  concat('new_', id::varchar, '.jpg') AS image_path FROM scan_pages WHERE small_preview_path IS NULL)"""
APPENDED = """SELECT f.id, f.document_id, cast(coalesce(c.n, 0) + row_number() OVER
  (PARTITION BY f.document_id ORDER BY f.capture_index, f.id) - 1 AS int) AS sort_order, f.image_path
  FROM fresh f LEFT JOIN (SELECT document_id, count(*) AS n FROM scan_pages GROUP BY 1) c ON c.document_id = f.document_id"""


@query("append_order", CATALOGUE + f", {NEW_PAGES} {APPENDED}")
def append_order(spark, sf):
    found = mut.append_order(fx.pages(spark, sf), new_pages(spark, sf))
    return found.select("id", "document_id", "sort_order", "image_path")


@query("add_pages", CATALOGUE + f""", {NEW_PAGES}
SELECT 'page' AS what, id, document_id, sort_order, image_path, filter_name, rotation_degrees, small_preview_path,
  NULL::timestamp AS updated_at FROM scan_pages
UNION ALL SELECT 'page', id, document_id, sort_order, image_path, 'original', 0, NULL, NULL FROM ({APPENDED}) a
UNION ALL SELECT 'document', id, NULL, NULL, NULL, NULL, NULL, NULL,
  CASE WHEN id IN (SELECT document_id FROM fresh) THEN greatest(updated_at, {NOW_SQL}) ELSE updated_at END
FROM scan_documents""")
def add_pages(spark, sf):
    d, p = mut.add_pages(fx.documents(spark, sf), fx.pages(spark, sf), new_pages(spark, sf), fx.now())
    return _pages_and_documents(d, p, ["document_id", "sort_order", "image_path", "filter_name",
                                       "rotation_degrees", "small_preview_path"])


def _pages_and_documents(d, p, columns):
    """Both result tables in one frame, for comparison."""
    rows = p.select(F.lit("page").alias("what"), "id", *columns)
    heads = d.select(F.lit("document").alias("what"), "id", "updated_at")
    return rows.unionByName(heads, allowMissingColumns=True)


TOUCHED = "CASE WHEN id IN ({docs}) THEN greatest(updated_at, " + NOW_SQL + ") ELSE updated_at END AS updated_at"


@query("replace_pages", CATALOGUE + f""", hit AS (SELECT * FROM scan_pages WHERE filter_name = 'magic')
SELECT 'page' AS what, id, document_id, filter_name, rotation_degrees,
  CASE WHEN filter_name = 'magic' THEN concat('retake_', id::varchar, '.jpg') ELSE image_path END AS image_path,
  CASE WHEN filter_name <> 'magic' THEN small_preview_path END AS small_preview_path,
  CASE WHEN filter_name <> 'magic' THEN large_preview_path END AS large_preview_path,
  NULL::timestamp AS updated_at FROM scan_pages
UNION ALL SELECT 'document', id, NULL, NULL, NULL, NULL, NULL, NULL,
  {TOUCHED.format(docs='SELECT document_id FROM hit')} FROM scan_documents""")
def replace_pages(spark, sf):
    p = fx.pages(spark, sf)
    magic = p.filter(F.col("filter_name") == "magic")
    # Two retakes per page and one for a page that does not exist; the later one wins.
    retakes = magic.select(
        F.col("id").alias("page_id"),
        F.explode(F.array(F.lit("early_"), F.lit("retake_"))).alias("tag"),
    ).select(
        "page_id",
        F.concat("tag", F.col("page_id").cast("string"), F.lit(".jpg")).alias("image_path"),
        F.when(F.col("tag") == "retake_", 2).otherwise(1).alias("seq"),
    )
    unknown = retakes.withColumn("page_id", F.col("page_id") + 500000000000)
    d, q = mut.replace_pages(fx.documents(spark, sf), p, retakes.unionByName(unknown), fx.now())
    return _pages_and_documents(d, q, ["document_id", "image_path", "filter_name", "rotation_degrees",
                                       "small_preview_path", "large_preview_path"])


@query("delete_pages", CATALOGUE + f"""
SELECT 'page' AS what, id, document_id, cast(row_number() OVER (PARTITION BY document_id ORDER BY sort_order, id) - 1 AS int)
  AS sort_order, NULL::timestamp AS updated_at FROM scan_pages WHERE filter_name <> 'legacy'
UNION ALL SELECT 'document', id, NULL, NULL,
  {TOUCHED.format(docs="SELECT document_id FROM scan_pages WHERE filter_name = 'legacy'")} FROM scan_documents""")
def delete_pages(spark, sf):
    p = fx.pages(spark, sf)
    targets = p.filter(F.col("filter_name") == "legacy").select(F.col("id").alias("page_id"), "document_id")
    d, q = mut.delete_pages(fx.documents(spark, sf), p, targets, fx.now())
    return _pages_and_documents(d, q, ["document_id", "sort_order"])


@query("reorder_pages", CATALOGUE + f""", {LISTED}
SELECT 'page' AS what, p.id, p.document_id, cast(coalesce(l.position, p.sort_order) AS int) AS sort_order,
  NULL::timestamp AS updated_at FROM scan_pages p LEFT JOIN listed l ON l.page_id = p.id
UNION ALL SELECT 'document', id, NULL, NULL, {TOUCHED.format(docs='SELECT document_id FROM listed')} FROM scan_documents""")
def reorder_pages(spark, sf):
    d, q = mut.reorder(fx.documents(spark, sf), fx.pages(spark, sf), listed_order(spark, sf), fx.now())
    return _pages_and_documents(d, q, ["document_id", "sort_order"])


def move_commands(spark, sf):
    """Move the second page to the customer's digit: some in range, some not, some no-ops."""
    return fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("document_id"),
        (F.col("o_orderkey") % 3).cast("int").alias("source"),
        (F.col("o_custkey") % 6).cast("int").alias("destination"),
    )


@query("move_pages", CATALOGUE + f""", cmd AS (SELECT o_orderkey AS document_id, cast(o_orderkey % 3 AS int) AS src,
  cast(o_custkey % 6 AS int) AS dst FROM orders),
cnt AS (SELECT document_id, count(*) AS n FROM scan_pages GROUP BY 1),
ok AS (SELECT c.* FROM cmd c JOIN cnt USING (document_id) WHERE src < n AND dst < n AND src <> dst),
pos AS (SELECT p.*, o.src, o.dst, row_number() OVER (PARTITION BY p.document_id ORDER BY sort_order, p.id) - 1 AS k
  FROM scan_pages p LEFT JOIN ok o ON o.document_id = p.document_id)
SELECT 'page' AS what, id, document_id, cast(CASE WHEN src IS NULL THEN sort_order ELSE row_number() OVER
  (PARTITION BY document_id ORDER BY CASE WHEN k = src THEN dst + CASE WHEN dst > src THEN 0.5 ELSE -0.5 END ELSE k END) - 1 END
  AS int) AS sort_order, NULL::timestamp AS updated_at FROM pos
UNION ALL SELECT 'document', id, NULL, NULL, {TOUCHED.format(docs='SELECT document_id FROM ok')} FROM scan_documents""")
def move_pages(spark, sf):
    d, q = mut.move(fx.documents(spark, sf), fx.pages(spark, sf), move_commands(spark, sf), fx.now())
    return _pages_and_documents(d, q, ["document_id", "sort_order"])


@query("set_page_filter", CATALOGUE + f"""
SELECT 'page' AS what, id, document_id, CASE WHEN filter_name = 'legacy' THEN 'bw' ELSE filter_name END AS filter_name,
  NULL::timestamp AS updated_at FROM scan_pages
UNION ALL SELECT 'document', id, NULL, NULL,
  {TOUCHED.format(docs="SELECT document_id FROM scan_pages WHERE filter_name = 'legacy'")} FROM scan_documents""")
def set_page_filter(spark, sf):
    p = fx.pages(spark, sf)
    commands = p.filter(F.col("filter_name") == "legacy").select(
        F.col("id").alias("page_id"), F.lit("bw").alias("filter_name"), F.lit(1).alias("seq")
    )
    d, q = mut.set_filter(fx.documents(spark, sf), p, commands, fx.now())
    return _pages_and_documents(d, q, ["document_id", "filter_name"])


@query("set_document_filter", CATALOGUE + f""", gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
SELECT 'page' AS what, id, document_id,
  CASE WHEN document_id IN (SELECT o_orderkey FROM gone) THEN 'vivid' ELSE filter_name END AS filter_name,
  NULL::timestamp AS updated_at FROM scan_pages
UNION ALL SELECT 'document', id, NULL, NULL, {TOUCHED.format(docs="SELECT o_orderkey FROM gone")} FROM scan_documents""")
def set_document_filter(spark, sf):
    commands = orders_with(spark, sf, "F").select(
        F.col("id").alias("document_id"), F.lit("vivid").alias("filter_name"), F.lit(1).alias("seq")
    )
    d, q = mut.set_document_filter(fx.documents(spark, sf), fx.pages(spark, sf), commands, fx.now())
    return _pages_and_documents(d, q, ["document_id", "filter_name"])


@query("set_page_rotation", CATALOGUE + f"""
SELECT 'page' AS what, id, document_id,
  cast(CASE WHEN filter_name = 'bw' THEN (rotation_degrees + 270) % 360 ELSE rotation_degrees END AS int) AS rotation_degrees,
  NULL::timestamp AS updated_at FROM scan_pages
UNION ALL SELECT 'document', id, NULL, NULL,
  {TOUCHED.format(docs="SELECT document_id FROM scan_pages WHERE filter_name = 'bw'")} FROM scan_documents""")
def set_page_rotation(spark, sf):
    from scanloom.functions.geometry import quarter_left

    p = fx.pages(spark, sf)
    commands = p.filter(F.col("filter_name") == "bw").select(
        F.col("id").alias("page_id"), quarter_left(F.col("rotation_degrees")).alias("rotation_degrees"), F.lit(1).alias("seq")
    )
    d, q = mut.set_rotation(fx.documents(spark, sf), p, commands, fx.now())
    return _pages_and_documents(d, q, ["document_id", "rotation_degrees"])


@query("touch_documents", CATALOGUE + """
SELECT d.id, d.name, d.created_at, greatest(d.updated_at, c.ts) AS updated_at FROM scan_documents d LEFT JOIN
  (SELECT l_orderkey, max(l_shipdate) AS ts FROM lineitem GROUP BY 1) c ON c.l_orderkey = d.id""")
def touch_documents(spark, sf):
    changed = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_shipdate").alias("ts"))
    return mut.touch(fx.documents(spark, sf), changed)


@query("apply_edits", fx.ARTEFACTS + f""", {EDITS},
j AS (SELECT p.id, p.document_id, p.image_path, e.filter_name, e.rotation_degrees,
    (e.filter_name <> p.filter_name OR e.rotation_degrees <> p.rotation_degrees) AS changed,
    EXISTS (SELECT 1 FROM file_inventory f WHERE f.kind = 'small' AND f.file_name = p.small_preview_path) AS s,
    EXISTS (SELECT 1 FROM file_inventory f WHERE f.kind = 'large' AND f.file_name = p.large_preview_path) AS l
  FROM scan_pages p JOIN edits e ON e.page_id = p.id)
SELECT 'job' AS what, id, NULL::bigint AS document_id, filter_name, rotation_degrees, NULL::timestamp AS updated_at
  FROM j WHERE changed OR NOT s OR NOT l
UNION ALL SELECT 'page', p.id, p.document_id, coalesce(e.filter_name, p.filter_name),
  coalesce(e.rotation_degrees, p.rotation_degrees), NULL FROM scan_pages p LEFT JOIN edits e ON e.page_id = p.id
UNION ALL SELECT 'document', id, NULL, NULL, NULL, {TOUCHED.format(docs='SELECT document_id FROM edits')} FROM scan_documents""")
def apply_edits(spark, sf):
    p = fx.pages(spark, sf)
    edits = edits_of(p).select("page_id", "filter_name", "rotation_degrees")
    d, q, jobs = mut.apply_edits(fx.documents(spark, sf), p, edits, fx.inventory(spark, sf), fx.now())
    tables = _pages_and_documents(d, q, ["document_id", "filter_name", "rotation_degrees"])
    work = jobs.select(F.lit("job").alias("what"), F.col("page_id").alias("id"), "filter_name", "rotation_degrees")
    return tables.unionByName(work, allowMissingColumns=True)


@query("asset_deletes", fx.ARTEFACTS + """
SELECT id AS page_id, 'source' AS kind, image_path AS file_name FROM scan_pages
UNION ALL SELECT id, 'small', small_preview_path FROM scan_pages WHERE small_preview_path IS NOT NULL
UNION ALL SELECT id, 'large', large_preview_path FROM scan_pages WHERE large_preview_path IS NOT NULL
UNION ALL SELECT p.id, 'working', f.file_name FROM scan_pages p JOIN file_inventory f
  ON f.kind = 'working' AND cast(split_part(f.file_name, '_', 1) AS bigint) = p.id""")
def asset_deletes(spark, sf):
    return art.asset_deletes(fx.pages(spark, sf), fx.inventory(spark, sf))
