"""Links, ids and file names found in free text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values: site domains -------------------------------------------------------------
SITES = {
    "tiktok": ["tiktok.com", "vm.tiktok.com", "vt.tiktok.com"],
    "douyin": ["douyin.com", "iesdouyin.com"],
}
#: Id patterns, tried in this order.
ID_PATTERNS = [r"/video/(\d+)", r"modal_id=(\d+)", r"/photo/(\d+)"]


def is_site(url: Column, site: str) -> Column:
    hit = F.lit(False)
    for domain in SITES[site]:
        hit = hit | F.contains(url, F.lit(domain))
    return hit


def item_id(url: Column, patterns: list[str] = ID_PATTERNS) -> Column:
    """First pattern that matches, or null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in patterns])


# --- fixed values: characters that no file name has, those cut off its ends, and the name of what has none
NOT_IN_NAMES, NOT_AT_ENDS, NO_NAME = r'[\\/:*?"<>|\n\r\t]', ". ", "video"


def safe_file_name(name: Column, max_len: int = 50) -> Column:
    cleaned = F.btrim(F.regexp_replace(name, NOT_IN_NAMES, ""), F.lit(NOT_AT_ENDS))
    return F.when(cleaned != "", F.substring(cleaned, 1, max_len)).otherwise(F.lit(NO_NAME))


def sibling(url: Column, name: str) -> Column:
    """Replace the last path part; a link without ``/`` is an error."""
    return F.when(F.contains(url, F.lit("/")), F.concat(F.regexp_extract(url, "^(.*/)", 1), F.lit(name))).otherwise(
        F.raise_error(F.concat(F.lit("link has no path: "), url))
    )


def absolute(url: Column) -> Column:
    return F.when(url.isNotNull() & ~url.startswith("http"), F.concat(F.lit("https:"), url)).otherwise(url)


def without_watermark(url: Column) -> Column:
    return F.replace(url, F.lit("/playwm/"), F.lit("/play/"))
