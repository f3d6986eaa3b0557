"""Names, labels and keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from scanloom.schema import NAME_PREFIX

# Characters not allowed in file names, characters kept in preview names.
UNSAFE_IN_FILE_NAME = r'[/\\:*?"<>|]'
NOT_KEPT_IN_PREVIEW_NAME = r"[^A-Za-z0-9_-]"
FALLBACK_FILE_NAME = "document"
# Unicode's white space, as a class that Java's and RE2's patterns both take.
WHITE_SPACE = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def trim(name: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(name, f"^{WHITE_SPACE}+|{WHITE_SPACE}+$", "")


def safe_file_name(name: Column, trim_first: bool = False) -> Column:
    """Replace path-unsafe characters; a blank result becomes the fallback name."""
    source = trim(name) if trim_first else name
    cleaned = F.regexp_replace(source, UNSAFE_IN_FILE_NAME, "_")
    return F.when(F.length(trim(cleaned)) == 0, F.lit(FALLBACK_FILE_NAME)).otherwise(cleaned)


def preview_base_name(file_name: Column) -> Column:
    """Sanitised stem of a source file; an empty stem becomes the fallback name."""
    stem = F.regexp_replace(file_name, r"(?<=.)\.[^./]*$", "")
    kept = F.btrim(F.regexp_replace(stem, NOT_KEPT_IN_PREVIEW_NAME, "_"), F.lit("_"))
    return F.when(F.length(kept) == 0, F.lit(FALLBACK_FILE_NAME)).otherwise(kept)


def working_prefix(file_name: Column) -> Column:
    """Prefix that names every working file of a source (stem sanitised but not trimmed)."""
    stem = F.regexp_replace(file_name, r"(?<=.)\.[^./]*$", "")
    return F.regexp_replace(stem, NOT_KEPT_IN_PREVIEW_NAME, "_")


def default_name(ts: Column) -> Column:
    return F.concat(F.lit(NAME_PREFIX), F.date_format(ts, "yyyy-MM-dd HH:mm"))


def list_label(page_count: Column, ts: Column) -> Column:
    return F.concat(page_count.cast("string"), F.lit("ページ · "), F.date_format(ts, "yyyy/MM/dd"))


def working_key(page_id: Column, filter_name: Column, rotation: Column) -> Column:
    return F.concat(
        F.concat_ws("_", page_id.cast("string"), filter_name, rotation.cast("string")), F.lit(".jpg")
    )


def request_key(source: Column, filter_name: Column, rotation: Column) -> Column:
    return F.concat_ws("|", source, filter_name, rotation.cast("string"), F.lit("persisted"))
