"""Saved pages with embedded item JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexicue.plans.registry import job
from lexicue.sources import pages as Pg
from lexicue.sources.tables import table


def _saved(spark, folder):
    """The given pages with an item embedded by page number: three formats, or none for every fourth page.

    Fields vary by number too: authors as object or text, missing titles, times in ms, relative links,
    and items in an unusual place.
    """
    c = F.col
    p = table(spark, folder, "pages", "page_id", "url", "html")
    n = c("page_id")
    title = F.when(n % 5 != 0, F.regexp_extract("html", "<title>(.*?)</title>", 1))
    link = F.when(n % 3 == 0, F.concat(F.lit("//v.example/playwm/"), n.cast("string"))).otherwise(F.concat(F.lit("http://v.example/playwm/"), n.cast("string")))
    stat = lambda m: F.when(n % m != 0, n * m)
    share = F.to_json(F.struct(
        F.concat(F.lit("s"), n.cast("string")).alias("aweme_id"), title.alias("desc"),
        F.struct(F.when(n % 7 != 0, c("url")).alias("nickname"), F.when(n % 8 != 0, "u1").otherwise("").alias("unique_id"), n.cast("string").alias("uid")).alias("author"),
        F.struct(F.struct(F.array(link).alias("url_list")).alias("play_addr"), F.struct(F.array(F.lit("c.jpg")).alias("url_list")).alias("cover"), (n * 37).alias("duration")).alias("video"),
        F.struct(stat(2).alias("digg_count"), stat(3).alias("comment_count"), stat(5).alias("share_count")).alias("statistics")))
    author = F.when(n % 6 == 1, F.to_json(F.struct(F.when(n % 12 == 1, "nick").otherwise("").alias("nickname"), F.lit("uq").alias("uniqueId")))).otherwise(F.concat(F.lit('"by '), n.cast("string"), F.lit('"')))
    item = F.concat(
        F.lit('{"id":"'), F.when(n % 10 != 2, F.concat(F.lit("t"), n.cast("string"))).otherwise(""), F.lit('","desc":"d'), n.cast("string"), F.lit('","author":'), author,
        F.lit(',"video":'), F.to_json(F.struct(F.when(n % 4 == 1, link).otherwise("").alias("downloadAddr"), F.lit("//p.example/x").alias("playAddr"), F.lit("").alias("cover"), F.lit("o.jpg").alias("originCover"), (n * 37).alias("duration"))),
        F.lit(',"stats":'), F.to_json(F.struct(stat(2).alias("diggCount"), stat(3).alias("commentCount"), stat(5).alias("shareCount"))), F.lit("}"))
    deep = n % 3 == 1
    body = (
        F.when(n % 4 == 0, F.concat(F.lit("<script>window._ROUTER_DATA = "), F.when(deep, F.concat(F.lit('{"a":[{"b":{"item_list":['), share, F.lit("]}}]}")))
                                    .otherwise(F.concat(F.lit('{"loaderData":{"page":{"videoInfoRes":{"item_list":['), share, F.lit("]}}}}"))), F.lit("</script>")))
        .when(n % 4 == 1, F.concat(F.lit('<script id="__UNIVERSAL_DATA_FOR_REHYDRATION__" type="application/json">'), F.when(deep, F.concat(F.lit('{"x":{"itemStruct":'), item, F.lit("}}")))
                                   .otherwise(F.concat(F.lit('{"__DEFAULT_SCOPE__":{"webapp.video-detail":{"itemInfo":{"itemStruct":'), item, F.lit("}}}}"))), F.lit("</script>")))
        .when(n % 4 == 2, F.concat(F.lit('<script id="SIGI_STATE" >'), F.lit('{"ItemModule":{"k":'), item, F.lit("}}"), F.lit("</script>")))
        .otherwise(""))
    return p.select("page_id", "url", F.replace("html", F.lit("</head>"), F.concat(body, F.lit("</head>"))).alias("html"))


@job("page_formats", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'router' WHEN 1 THEN 'universal' WHEN 2 THEN 'sigi' ELSE 'none' END AS format FROM pages""")
def page_formats(spark, folder):
    return Pg.embedded(_saved(spark, folder)).select("page_id", F.coalesce("format", F.lit("none")).alias("format"))


@job("page_fields", """
WITH p AS (SELECT page_id AS n, page_id % 4 AS f, url, regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
  CASE WHEN page_id % 3 = 0 THEN 'https://v.example/playwm/' ELSE 'http://v.example/playwm/' END || CAST(page_id AS VARCHAR) AS link FROM pages WHERE page_id % 4 <> 3)
SELECT n AS page_id, CASE WHEN f = 0 THEN 's' || n WHEN n % 10 <> 2 THEN 't' || n ELSE 'page ' || n END AS item_id,
 CASE WHEN f > 0 THEN 'd' || n WHEN n % 5 <> 0 THEN title ELSE 'Untitled' END AS title,
 CASE WHEN f = 0 THEN CASE WHEN n % 7 <> 0 THEN url ELSE 'Unknown' END WHEN n % 6 = 1 THEN CASE WHEN n % 12 = 1 THEN 'nick' ELSE 'uq' END ELSE 'by ' || n END AS author,
 CASE WHEN f = 0 THEN CASE WHEN n % 8 <> 0 THEN 'u1' ELSE CAST(n AS VARCHAR) END WHEN n % 6 = 1 THEN 'uq' ELSE '' END AS author_id,
 CASE WHEN f = 0 AND n * 37 > 1000 THEN n * 37 // 1000 ELSE n * 37 END AS duration, CASE WHEN f = 0 THEN 'c.jpg' ELSE 'o.jpg' END AS thumbnail,
 CASE WHEN f = 0 THEN replace(link, '/playwm/', '/play/') WHEN f = 1 THEN link ELSE 'https://p.example/x' END AS video_url,
 CASE WHEN n % 2 <> 0 THEN n * 2 ELSE 0 END AS likes, CASE WHEN n % 3 <> 0 THEN n * 3 ELSE 0 END AS comments, CASE WHEN n % 5 <> 0 THEN n * 5 ELSE 0 END AS shares,
 CASE WHEN f = 0 THEN 'douyin' ELSE 'tiktok' END AS platform FROM p""")
def page_fields(spark, folder):
    found = Pg.items(Pg.located(Pg.embedded(_saved(spark, folder))))
    return Pg.normalized(found, F.concat(F.lit("page "), F.col("page_id").cast("string"))).drop("url", "format")
