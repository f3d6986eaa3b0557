"""Tables of the catalogue and the constants tied to them."""

from __future__ import annotations

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)

PAGES_V1 = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("document_id", T.LongType()),
        T.StructField("sort_order", T.IntegerType()),
        T.StructField("image_path", T.StringType()),
        T.StructField("filter_name", T.StringType()),
        T.StructField("rotation_degrees", T.IntegerType()),
    ]
)

PAGES = T.StructType(
    PAGES_V1.fields
    + [
        T.StructField("small_preview_path", T.StringType()),
        T.StructField("large_preview_path", T.StringType()),
    ]
)

# Filter keys with their display names, in menu order.
PRESETS = [
    ("original", "オリジナル"),
    ("sharpen", "くっきり"),
    ("bw", "白黒"),
    ("magic", "マジック"),
    ("whiteboard", "ホワイトボード"),
    ("vivid", "鮮やか"),
]
DEFAULT_PRESET = "original"

# Document naming.
NAME_PREFIX = "スキャン "

MANIFEST = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("step0", T.StringType()),
        T.StructField("step1", T.StringType()),
        T.StructField("magic_step2", T.StringType()),
        T.StructField("magic_step3", T.StringType()),
        T.StructField("crop_mode", T.StringType()),
        T.StructField("filters", T.MapType(T.StringType(), T.StringType())),
    ]
)
