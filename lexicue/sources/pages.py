"""Item records embedded as JSON in saved pages of three formats."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from lexicue.functions import urls as U
from lexicue.operators.staging import staged

# --- fixed values: where each page format keeps its JSON, tried in this order -----------------
FORMATS = {
    "router": r"(?s)_ROUTER_DATA\s*=\s*(\{.+?\})\s*</script>",
    "universal": r'(?s)<script\s+id="__UNIVERSAL_DATA_FOR_REHYDRATION__"[^>]*>\s*(\{.+?\})\s*</script>',
    "sigi": r'(?s)<script\s+id="SIGI_STATE"[^>]*>\s*(\{.+?\})\s*</script>',
}
#: Key searched for in each format.
ITEM_KEYS = {"router": "item_list", "universal": "itemStruct", "sigi": "ItemModule"}
#: Known places of that key; other depths take the slow search.
KNOWN_PATHS = {
    "router": ["$.item_list", "$.loaderData.page.videoInfoRes.item_list"],
    "universal": [
        "$.itemInfo.itemStruct",
        "$.__DEFAULT_SCOPE__['webapp.video-detail'].itemInfo.itemStruct",
    ],
    "sigi": ["$.ItemModule"],
}


def find_key(doc, key: str):
    """Depth-first, first non-null value of ``key`` at any depth."""
    todo = [doc]
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            if node.get(key) is not None:
                return node[key]
            todo.extend(v for v in reversed(node.values()) if isinstance(v, (dict, list)))
        elif isinstance(node, list):
            todo.extend(v for v in reversed(node) if isinstance(v, (dict, list)))
    return None


@F.pandas_udf(StringType())
def deep_find(docs: pd.Series, keys: pd.Series) -> pd.Series:
    """JSON text of the first value of a key at any depth; null when absent or not JSON."""

    def one(text, key):
        try:
            hit = find_key(json.loads(text), key) if text else None
        except ValueError:
            return None
        return None if hit is None else json.dumps(hit, ensure_ascii=False)

    return pd.Series([one(t, k) for t, k in zip(docs, keys)])


def embedded(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``format`` and ``payload`` (JSON text) of the first page format that matches."""
    tried = F.array(*[
        F.struct(F.lit(name).alias("format"), F.regexp_extract(html, pattern, 1).alias("payload"))
        for name, pattern in FORMATS.items()
    ])
    first = F.get(F.filter(tried, lambda t: t["payload"] != ""), F.lit(0))
    out = staged(pages, __hit=first)
    return out.select(*pages.columns, F.col("__hit.format").alias("format"), F.col("__hit.payload").alias("payload"))


def located(df: DataFrame) -> DataFrame:
    """Add ``found``: the JSON under the format's item key. Known paths first, the deep search for the rest."""
    known = F.lit(None).cast("string")
    for name, paths in KNOWN_PATHS.items():
        at = F.coalesce(*[F.get_json_object("payload", p) for p in paths])
        known = F.when(F.col("format") == name, at).otherwise(known)
    df = staged(df, __known=known)
    hit = df.filter("__known IS NOT NULL OR payload IS NULL").withColumn("found", F.col("__known"))
    key = F.lit(None).cast("string")
    for name, k in ITEM_KEYS.items():
        key = F.when(F.col("format") == name, F.lit(k)).otherwise(key)
    rest = df.filter("__known IS NULL AND payload IS NOT NULL").withColumn("found", deep_find("payload", key))
    return hit.unionByName(rest).drop("__known")


def items(df: DataFrame) -> DataFrame:
    """Add ``item``: first of a list, first value of a map, or the object itself; null when there is none."""
    first_of_map = F.get(F.map_values(F.from_json("found", "map<string,string>")), F.lit(0))
    text = (
        F.when(F.col("format") == "router", F.get_json_object("found", "$[0]"))
        .when(F.col("format") == "sigi", first_of_map)
        .otherwise(F.col("found"))
    )
    return staged(df, item=F.try_parse_json(text))


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("item", path, kind)


def _some(*paths: str) -> Column:
    """First present, non-empty text."""
    return F.coalesce(*[F.nullif(_get(p), F.lit("")) for p in paths])


def normalized(df: DataFrame, item_id: Column) -> DataFrame:
    """Eleven fields of one record whatever the page format."""
    share = F.col("format") == "router"
    stats = lambda a, b: F.coalesce(
        F.when(share, _get(f"$.statistics.{a}", "bigint")).otherwise(_get(f"$.stats.{b}", "bigint")), F.lit(0)
    )
    author_object = F.schema_of_variant(F.try_variant_get("item", "$.author", "variant")).startswith("OBJECT")
    name = (
        F.when(share, F.coalesce(_get("$.author.nickname"), F.lit("Unknown")))
        .when(author_object, F.coalesce(_some("$.author.nickname"), _get("$.author.uniqueId"), F.lit("Unknown")))
        .otherwise(F.coalesce(_some("$.author"), F.lit("Unknown")))
    )
    author_id = (
        F.when(share, F.coalesce(_some("$.author.unique_id"), _get("$.author.uid"), F.lit("")))
        .when(author_object, F.coalesce(_some("$.author.uniqueId"), _get("$.author.id"), F.lit("")))
        .otherwise(F.lit(""))
    )
    seconds = F.coalesce(_get("$.video.duration", "bigint"), F.lit(0))
    video = F.when(share, U.without_watermark(_some("$.video.play_addr.url_list[0]"))).otherwise(
        _some("$.video.downloadAddr", "$.video.playAddr", "$.video.play_addr.url_list[0]")
    )
    cover = F.when(share, _some("$.video.cover.url_list[0]")).otherwise(
        _some("$.video.cover", "$.video.originCover", "$.video.dynamicCover")
    )
    keep = [c for c in df.columns if c not in ("item", "found", "payload", "html")]
    return df.filter("item IS NOT NULL").select(
        *keep,
        F.coalesce(F.when(share, _some("$.aweme_id")).otherwise(_some("$.id")), item_id).alias("item_id"),
        F.coalesce(_get("$.desc"), F.lit("Untitled")).alias("title"),
        name.alias("author"),
        author_id.alias("author_id"),
        F.when(share & (seconds > 1000), F.floor(seconds / 1000)).otherwise(seconds).alias("duration"),
        cover.alias("thumbnail"),
        U.absolute(video).alias("video_url"),
        stats("digg_count", "diggCount").alias("likes"),
        stats("comment_count", "commentCount").alias("comments"),
        stats("share_count", "shareCount").alias("shares"),
        F.when(share, "douyin").otherwise("tiktok").alias("platform"),
    )
