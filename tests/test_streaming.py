"""Streaming forms give what the batch forms give, on input split over several files."""

import pytest
from pyspark.sql import Window, functions as F

from scanloom import streaming
from scanloom.operators import captures as cap, edits as ed, frames as fr
from scanloom.plans import fixtures as fx
from scanloom.streaming import edits as se, frames as sfr, live


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    streaming.use_rocksdb(spark)


def feed(spark, df, order, folder, files=3):
    """Write ``df`` as several files in order and stream them one file per trigger."""
    ranked = df.withColumn("_n", F.ntile(files).over(Window.orderBy(*order)))
    for n in range(1, files + 1):
        ranked.filter(F.col("_n") == n).drop("_n").coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(stream, name, mode="append", tmp=None):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp)).trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    assert query.exception() is None
    return stream.sparkSession.table(name)


def test_frames_stream_equals_batch(spark, small, tmp_path):
    frames = fx.frames(spark, small)
    flat = sfr.flat_frames(frames)
    out = run(sfr.stabilize_stream(feed(spark, flat, ["ts_ms", "frame_id"], tmp_path / "in")), "frames_out", tmp=tmp_path / "cp")
    got = {r.frame_id: r for r in out.collect()}
    shown = {r.frame_id: r for r in fr.stabilize(frames).collect()}
    smooth = {r.frame_id: r for r in fr.stabilize_smooth(frames).collect()}
    assert got.keys() == shown.keys() == smooth.keys()
    for key, row in shown.items():
        assert got[key].status == row.status
        if row.shown:
            assert [got[key][c] for c in sfr.COORDS] == [v for p in row.shown for v in (p.x, p.y)]
            flat_smooth = [v for p in smooth[key].smoothed for v in (p.x, p.y)]
            assert [got[key][f"s{c}"] for c in sfr.COORDS] == pytest.approx(flat_smooth, abs=1e-12)


def test_applied_edits_stream_equals_batch(spark, small, tmp_path):
    commands = fx.edit_commands(spark, small)
    saved = fx.edited_pages(spark, small)
    closes = commands.filter(F.col("command").isin("apply", "discard")).groupBy("document_id").agg(
        F.max(F.struct("ts", "seq")).alias("_end")
    )
    closed = commands.join(closes, "document_id").filter(F.struct("ts", "seq") <= F.col("_end")).drop("_end")
    want = {r.id: (r.filter_name, r.rotation_degrees) for r in ed.fold_edits(saved, closed).collect()}
    stamped = commands.withColumn("ts", F.col("ts").cast("timestamp"))
    out = run(se.applied_edits_stream(feed(spark, stamped, ["ts", "seq"], tmp_path / "in")), "edits_out", tmp=tmp_path / "cp")
    rows = sorted(out.collect(), key=lambda r: (r.applied_ts, r.applied_seq, r.page_id is not None))
    state = {r.id: [r.filter_name, r.rotation_degrees, r.document_id] for r in saved.collect()}
    for r in rows:
        for page, s in state.items():
            if (r.page_id is None and s[2] == r.document_id) or r.page_id == page:
                s[0] = r.filter_name or s[0]
                s[1] = (s[1] - 90 * r.turns) % 360
    assert {k: (v[0], v[1]) for k, v in state.items()} == want


def changes_of(spark, small):
    """Three versions of every page; the last one deletes magic pages."""
    pages = fx.pages(spark, small)
    return pages.select(
        "document_id", F.col("id").alias("page_id"), "sort_order", "filter_name",
        F.explode(F.array(*[F.lit(n).cast("long") for n in (1, 2, 3)])).alias("step"), "small_preview_path",
    ).select(
        "document_id", "page_id", (F.col("step") * 10_000_000 + F.col("page_id")).alias("version"),
        F.when(F.col("step") == 1, F.lit(99)).otherwise(F.col("sort_order")).cast("int").alias("sort_order"),
        F.when(F.col("step") == 3, F.col("small_preview_path")).alias("small_preview_path"),
        ((F.col("step") == 3) & (F.col("filter_name") == "magic")).alias("deleted"),
    )


def test_live_summary_equals_batch(spark, small, tmp_path):
    from scanloom.operators.catalog import document_summary

    stream = feed(spark, changes_of(spark, small), ["version"], tmp_path / "in")
    out = run(live.live_summary(stream), "summary_out", "update", tmp_path / "cp")
    latest = {}
    for r in out.collect():  # the memory sink keeps updates in order
        latest[r.document_id] = (r.page_count, r.first_small_preview)
    pages = fx.pages(spark, small).filter("filter_name <> 'magic'")
    want = {
        r.id: (r.page_count, r.first_small_preview)
        for r in document_summary(fx.documents(spark, small), pages).collect() if r.id in latest
    }
    assert latest == want


def test_live_pages_keeps_latest(spark, small, tmp_path):
    stream = feed(spark, changes_of(spark, small), ["version"], tmp_path / "in")
    out = run(live.live_pages(stream, ["sort_order", "deleted"]), "pages_out", "complete", tmp_path / "cp")
    want = {r.id: (r.sort_order, r.filter_name == "magic") for r in fx.pages(spark, small).collect()}
    assert {r.page_id: (r.sort_order, r.deleted) for r in out.collect()} == want


def test_capture_stream_equals_batch(spark, small, tmp_path):
    captures = fx.captures(spark, small)
    out = run(live.capture_stream(feed(spark, captures, ["seq", "session_id"], tmp_path / "in")), "captures_out", tmp=tmp_path / "cp")
    _, pages = cap.ingest_captures(fx.documents(spark, small), fx.pages(spark, small), captures, fx.now())
    fresh = pages.filter(F.col("document_id") >= cap.NEW_DOCUMENT_BASE)
    want = {(r.id, r.document_id, r.sort_order, r.image_path) for r in fresh.collect()}
    rows = out.collect()
    assert {(r.page_id, r.document_id, r.sort_order, r.image_path) for r in rows if r.what == "page"} == want
    assert sum(r.what == "document" for r in rows) == len({w[1] for w in want})
    assert sum(r.what == "retake" for r in rows) == captures.filter("is_retake").count()


def test_preview_requests_run_once(spark, small, tmp_path):
    pages = fx.pages(spark, small).select(
        "image_path", "filter_name", "rotation_degrees", F.lit("2025-01-01 00:00:00").cast("timestamp").alias("ts")
    )
    out = run(live.preview_request_stream(feed(spark, pages, ["image_path"], tmp_path / "in")), "requests_out", tmp=tmp_path / "cp")
    assert out.count() == pages.distinct().count()
