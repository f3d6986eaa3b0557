"""Folding a log of edit commands into the final edit state of each page."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scanloom import scale


def fold_edits(saved: DataFrame, commands: DataFrame) -> DataFrame:
    """Final filter and rotation per saved page after ``commands``.

    ``commands(document_id, page_id, seq, ts, command, filter_name)``: ``rotate`` and
    ``select_filter`` address a page, ``apply_all``, ``apply`` and ``discard`` its document.
    ``apply`` and ``discard`` close what was done since the previous close; discarded work is dropped.
    Document-wide filters are compared per document, never copied to every page's log.
    """
    closes = F.col("command").isin("apply", "discard")
    hour = scale.span_bucket(F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col("ts")), 3600)
    parts = scale.prefix_sum(
        commands, ["document_id"], hour, ["ts", "seq"], closes.cast("long"), "part", inclusive=False
    )
    discarded = parts.filter(F.col("command") == "discard").select("document_id", "part")
    kept = parts.filter(F.col("command").isin("rotate", "select_filter", "apply_all")).join(
        discarded, ["document_id", "part"], "left_anti"
    )
    per_page = (
        kept.filter(F.col("command") != "apply_all")
        .groupBy(F.col("page_id").alias("id"))
        .agg(
            F.count_if(F.col("command") == "rotate").alias("_turns"),
            F.max(F.when(F.col("command") == "select_filter", F.struct("ts", "seq", "filter_name"))).alias("_own"),
        )
    )
    per_document = (
        kept.filter(F.col("command") == "apply_all")
        .groupBy("document_id")
        .agg(F.max(F.struct("ts", "seq", "filter_name")).alias("_all"))
    )
    latest = F.greatest("_own", "_all")
    return (
        saved.join(per_page, "id", "left")
        .join(per_document, "document_id", "left")
        .withColumns(
            {
                "filter_name": F.coalesce(latest["filter_name"], "filter_name"),
                "rotation_degrees": F.pmod(
                    F.col("rotation_degrees") - 90 * F.coalesce("_turns", F.lit(0)), F.lit(360)
                ).cast("int"),
            }
        )
        .select(*saved.columns)
    )
