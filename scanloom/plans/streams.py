"""Frame, edit and capture queries (batch form) with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.operators import captures as cap, edits as ed, frames as fr
from scanloom.plans import fixtures as fx
from scanloom.plans.catalogue import NOW_SQL, _pages_and_documents
from scanloom.plans.fixtures import SQL_CAPTURES, SQL_DOCUMENTS, SQL_EDITS, SQL_FRAMES, SQL_PAGES
from scanloom.registry import query

# The jitter j decides all four corners: left/top grow with j, right/bottom shrink.
COORDS = ["(100+{lo})/1000.0::double", "(100+{lo})/1400.0::double", "(900-{hi})/1000.0::double", "(100+{lo})/1400.0::double",
          "(900-{hi})/1000.0::double", "(1300-{hi})/1400.0::double", "(100+{lo})/1000.0::double", "(1300-{hi})/1400.0::double"]
NAMES = ["x1", "y1", "x2", "y2", "x3", "y3", "x4", "y4"]

# Upper median of a rising coordinate is the upper median of j; of a falling one the lower median.
BUFFERED = f"""WITH {SQL_FRAMES}, b AS (SELECT *, list_sort(list(j) FILTER (j IS NOT NULL) OVER w) AS l FROM frames
  WINDOW w AS (PARTITION BY session_id ORDER BY ts_ms, frame_id ROWS 6 PRECEDING)),
m AS (SELECT frame_id, session_id, ts_ms, coalesce(len(l), 0) AS n, l[len(l)//2 + 1] AS up, l[len(l) - len(l)//2] AS down FROM b),
v AS (SELECT *, max(CASE WHEN n >= 3 THEN ts_ms END) OVER o AS last_ms,
    max(CASE WHEN n >= 3 THEN k END) OVER o AS shown_k FROM
    (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, frame_id) AS k FROM m) z
  WINDOW o AS (PARTITION BY session_id ORDER BY ts_ms, frame_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CASE WHEN n >= 3 THEN 'valid' WHEN ts_ms - last_ms < 500 THEN 'held' ELSE 'none' END AS status FROM v)"""


def flat(corners: str):
    return [F.element_at(corners, i // 2 + 1)["xy"[i % 2]] for i in range(8)]


@query("stabilized_frames", BUFFERED + f"""
SELECT s.frame_id, s.session_id, s.status, {', '.join(
    f"floor(({c.format(lo='t.up', hi='t.down')})*1e8 + 0.5)/1e8 AS {n}" for c, n in zip(COORDS, NAMES))}
FROM s LEFT JOIN s t ON s.status <> 'none' AND t.session_id = s.session_id AND t.k = s.shown_k""")
def stabilized_frames(spark, sf):
    shown = fr.stabilize(fx.frames(spark, sf))
    return shown.select("frame_id", "session_id", "status", *[
        (F.floor(c * 1e8 + 0.5) / 1e8).alias(n) for c, n in zip(flat("shown"), NAMES)
    ])


@query("last_valid_frame", BUFFERED + "SELECT frame_id, session_id, last_ms AS last_valid_ms FROM s")
def last_valid_frame(spark, sf):
    return fr.last_valid(fx.frames(spark, sf)).select("frame_id", "session_id", "last_valid_ms")


@query("smoothed_frames", BUFFERED.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
r AS (SELECT session_id, frame_id, k, status, {', '.join(f"{c.format(lo='up', hi='down')} AS {n}" for c, n in zip(COORDS, NAMES))} FROM s),
e AS (SELECT session_id, frame_id, k, status, {', '.join(f"CASE WHEN status = 'valid' THEN {n} END AS {n}" for n in NAMES)} FROM r WHERE k = 1
  UNION ALL SELECT r.session_id, r.frame_id, r.k, r.status, {', '.join(
      f"CASE r.status WHEN 'valid' THEN coalesce(e.{n} + (r.{n} - e.{n}) * 0.35::double, r.{n}) WHEN 'held' THEN e.{n} END" for n in NAMES)}
  FROM e JOIN r ON r.session_id = e.session_id AND r.k = e.k + 1)
SELECT session_id, frame_id, status, {', '.join(f"floor({n}*1e6 + 0.501)/1e6 AS {n}" for n in NAMES)} FROM e""")
def smoothed_frames(spark, sf):
    smooth = fr.stabilize_smooth(fx.frames(spark, sf))
    return smooth.select("session_id", "frame_id", "status", *[
        # Short decimals tie at the sixth digit; the rounding point is moved off the ties on both sides.
        (F.floor(c * 1e6 + 0.501) / 1e6).alias(n) for c, n in zip(flat("smoothed"), NAMES)
    ])


@query("folded_edits", f"""WITH {SQL_EDITS},
c AS (SELECT *, min(CASE WHEN command IN ('apply','discard') THEN {{'t': ts, 's': seq, 'c': command}} END) OVER
  (PARTITION BY document_id ORDER BY ts, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM commands),
kept AS (SELECT * FROM c WHERE nxt IS NULL OR nxt.c <> 'discard'),
turns AS (SELECT page_id, count(*) AS n FROM kept WHERE command = 'rotate' GROUP BY 1),
choice AS (SELECT s.id, k.filter_name, row_number() OVER (PARTITION BY s.id ORDER BY k.ts DESC, k.seq DESC) AS o
  FROM saved s JOIN kept k ON (k.command = 'select_filter' AND k.page_id = s.id) OR (k.command = 'apply_all' AND k.document_id = s.document_id))
SELECT s.id, s.document_id, s.sort_order, coalesce(f.filter_name, s.filter_name) AS filter_name,
  cast((((s.rotation_degrees - 90 * coalesce(t.n, 0)) % 360) + 360) % 360 AS int) AS rotation_degrees
FROM saved s LEFT JOIN turns t ON t.page_id = s.id LEFT JOIN choice f ON f.id = s.id AND f.o = 1""")
def folded_edits(spark, sf):
    return ed.fold_edits(fx.edited_pages(spark, sf), fx.edit_commands(spark, sf))


@query("ingested_captures", f"""WITH {SQL_DOCUMENTS}, {SQL_PAGES}, {SQL_CAPTURES},
n AS (SELECT *, 1000000000000 + session_id AS doc, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS k
  FROM captures WHERE NOT is_retake),
rt AS (SELECT retake_page_id AS id, arg_max(concat('cap_', session_id::varchar, '_', seq::varchar, '.jpg'), seq) AS img
  FROM captures WHERE is_retake GROUP BY 1),
hit AS (SELECT p.document_id FROM scan_pages p JOIN rt USING (id))
SELECT 'page' AS what, p.id, p.document_id, p.sort_order, coalesce(rt.img, p.image_path) AS image_path, p.filter_name,
  p.rotation_degrees, CASE WHEN rt.id IS NULL THEN p.small_preview_path END AS small_preview_path, NULL::timestamp AS updated_at
FROM scan_pages p LEFT JOIN rt ON rt.id = p.id
UNION ALL SELECT 'page', doc * 1000000 + seq, doc, cast(k AS int), concat('cap_', session_id::varchar, '_', seq::varchar, '.jpg'),
  'original', 0, NULL, NULL FROM n
UNION ALL SELECT 'document', id, NULL, NULL, NULL, NULL, NULL, NULL,
  CASE WHEN id IN (SELECT document_id FROM hit) THEN greatest(updated_at, {NOW_SQL}) ELSE updated_at END FROM scan_documents
UNION ALL SELECT DISTINCT 'document', doc, NULL::bigint, NULL::int, NULL, NULL, NULL::int, NULL, {NOW_SQL} FROM n""")
def ingested_captures(spark, sf):
    d, p = cap.ingest_captures(fx.documents(spark, sf), fx.pages(spark, sf), fx.captures(spark, sf), fx.now())
    return _pages_and_documents(d, p, ["document_id", "sort_order", "image_path", "filter_name", "rotation_degrees", "small_preview_path"])
