"""Text, number and link expressions over the given texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexicue.functions import labels
from lexicue.functions import text as T
from lexicue.functions import urls as U
from lexicue.operators import captions as Cp
from lexicue.operators.scans import Look, chunk_of, scan
from lexicue.plans import standins as S
from lexicue.plans.registry import job
from lexicue.sources.tables import table

CJK = "[一-鿿㐀-䶿぀-ヿ가-힯]"


@job("visual_width", f"""
WITH t AS (SELECT conv_id, turn, text || CASE WHEN turn % 2 = 0 THEN ' 你好世界' ELSE '' END AS t FROM conversations)
SELECT conv_id, turn, CAST(len(regexp_extract_all(t, '{CJK}')) * 2 + len(regexp_extract_all(t, '[^\\s一-鿿㐀-䶿぀-ヿ가-힯]')) AS BIGINT) AS width,
 len(regexp_extract_all(t, '{CJK}')) * 2 + len(regexp_extract_all(t, '[^\\s一-鿿㐀-䶿぀-ヿ가-힯]')) > 36 AS too_wide,
 len(regexp_extract_all(t, '{CJK}')) > length(t) * 0.3 AS cjk_dominant FROM t""")
def visual_width(spark, folder):
    """Turns, every other one with an ideographic tail."""
    t = F.concat(F.col("text"), F.when(F.col("turn") % 2 == 0, " 你好世界").otherwise(""))
    c = table(spark, folder, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", t.alias("t"))
    return c.select("conv_id", "turn", T.visual_width(F.col("t")).cast("bigint").alias("width"), T.too_wide(F.col("t")).alias("too_wide"), T.cjk_dominant(F.col("t")).alias("cjk_dominant"))


def _turns(spark, folder):
    """Turns as spoken segments: words 300 ms apart, a pause after every seventh."""
    toks = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    start = F.col("turn") * 60000
    words = F.transform(
        toks, lambda w, i: F.struct(
            ((start + i * 300 + F.floor(i / 7) * 400) / 1000).alias("start"), ((start + i * 300 + F.floor(i / 7) * 400 + 250) / 1000).alias("end"), w.alias("word")))
    return table(spark, folder, "conversations", "conv_id", "turn", "text").select(
        F.col("conv_id").alias("video"), F.col("turn").alias("seg_idx"), start.alias("start_ms"),
        (start + F.size(toks) * 360).cast("bigint").alias("end_ms"), "text", words.alias("words"))


@job("punct_split", """
WITH t AS (SELECT conv_id AS video, turn AS seg_idx, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t, turn * 60000 AS s,
  turn * 60000 + len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) * 360 AS e FROM conversations),
p AS (SELECT *, list_filter(string_split(regexp_replace(t, '([。！？，、.!?,;])\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10)) <> '') AS parts FROM t),
q AS (SELECT *, unnest(parts) AS part, unnest(range(len(parts))) AS i,
  unnest(list_transform(range(len(parts)), lambda k: coalesce(list_sum(list_transform(list_slice(parts, 1, k), lambda x: length(x))), 0))) AS off FROM p)
SELECT video, seg_idx, CAST(i AS INTEGER) AS part_idx, trim(part, ' ' || chr(10)) AS text, s + CAST(trunc(off / greatest(length(t), 1) * (e - s)) AS BIGINT) AS start_ms,
 s + CAST(trunc((off + length(part)) / greatest(length(t), 1) * (e - s)) AS BIGINT) AS end_ms FROM q""")
def punct_split(spark, folder):
    return Cp.punctuation_parts(_turns(spark, folder).drop("words"))


WIDTH = "(len(regexp_extract_all({0}, '" + CJK + "')) * 2 + len(regexp_extract_all({0}, '[^\\s一-鿿㐀-䶿぀-ヿ가-힯]')))"
BARE = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
LED = "(length({0}) - length(regexp_replace({0}, '^\\s+', '')))"
#: Words of a list that lie in a span, both in the row.
DURING = "list_filter({0}, lambda w: w.b >= ({1}) / 1000 - 0.05 AND w.d <= ({2}) / 1000 + 0.05)"
AT = "(s + CAST(trunc(({0}) / n * (e - s)) AS BIGINT))"
#: The cuts one by one: a row is a piece (``lo`` is its offset), done or still to be divided in two.
CHUNKS = f"""
WITH RECURSIVE t0 AS (SELECT conv_id AS video, turn AS seg_idx, text, {BARE.format('text')} AS t, turn * 60000 AS s,
  string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS toks FROM conversations),
t AS (SELECT * EXCLUDE toks, s + len(toks) * 360 AS e, {WIDTH.format('t')} > 36 AS wide,
  list_transform(range(len(toks)), lambda i: {{'b': (s + i * 300 + i // 7 * 400) / 1000, 'd': (s + i * 300 + i // 7 * 400 + 250) / 1000, 'w': toks[i + 1]}}) AS words FROM t0),
p AS (SELECT *, regexp_extract_all(t, '[^\\s。！？，、.!?,;][^。！？，、.!?,;]*[。！？，、.!?,;]?|[。！？，、.!?,;]') AS parts FROM t WHERE wide),
p2 AS (SELECT *, unnest(parts) AS part, unnest(range(len(parts))) AS i,
  unnest(list_transform(range(len(parts)), lambda k: coalesce(list_sum(list_transform(list_slice(parts, 1, k), lambda x: length(x))), 0))) AS gone FROM p),
p3 AS (SELECT video, seg_idx, i, t AS whole, part AS t, length(t) AS n, s, e, gone, words, len(parts) AS k FROM p2),
p4 AS (SELECT video, seg_idx, i, whole, t, k, words, {AT.format('gone')} AS s, {AT.format('gone + length(t)')} AS e FROM p3),
walk AS (SELECT video, seg_idx, i, 0::BIGINT AS lo, t, s, e, CASE WHEN k > 1 THEN {DURING.format('words', 's', 'e')} ELSE words END AS words, {WIDTH.format('t')} <= 36 AS done,
   CASE WHEN i > 0 THEN 'punctuation' ELSE 'whole' END AS cut FROM p4
 UNION ALL SELECT video, seg_idx, i, u.lo, u.t, u.s, u.e, CASE WHEN u.cut = 'kept' OR NOT silent THEN words ELSE {DURING.format('words', 'u.s', 'u.e')} END,
   u.done OR {WIDTH.format('u.t')} <= 36, CASE WHEN u.first THEN cut ELSE u.cut END
 FROM (SELECT *, CASE WHEN silent THEN [{{'lo': lo, 't': a, 's': s, 'e': {AT.format('length(a)')}, 'done': false, 'cut': 'pause', 'first': true}},
     {{'lo': lo + x + {LED.format('substr(t, x + 1)')}, 't': b, 's': {AT.format('x')}, 'e': {AT.format('x + length(b)')}, 'done': false, 'cut': 'pause', 'first': false}}]
   ELSE [{{'lo': lo, 't': a, 's': s, 'e': {AT.format('length(a)')}, 'done': true, 'cut': 'width', 'first': true}},
     {{'lo': lo + x + {LED.format('substr(t, x + 1)')}, 't': b, 's': {AT.format('length(a)')}, 'e': {AT.format('length(a) + length(b)')}, 'done': false, 'cut': 'width', 'first': false}}] END AS us
  FROM (SELECT *, {BARE.format('substr(t, 1, x)')} AS a, {BARE.format('substr(t, x + 1)')} AS b FROM (SELECT *, length(t) AS n, CAST(CASE WHEN silent THEN past ELSE fit END AS BIGINT) AS x FROM
   (SELECT *, coalesce(past > 0 AND past < length(t) AND {BARE.format('substr(t, 1, past)')} <> '' AND {BARE.format('substr(t, past + 1)')} <> '', false) AS silent,
     CASE WHEN unit > 0 THEN unit ELSE len(list_filter(range(1, length(t) + 1), lambda c: {WIDTH.format('substr(t, 1, c)')} <= 36)) END AS fit FROM
    (SELECT *, CASE WHEN longest > 0.3 THEN list_reduce(list_transform(list_slice(words, 1, list_position(gaps, longest)), lambda w: {{'at': 0::BIGINT, 'w': w.w}}), lambda acc, y:
       {{'at': CAST(acc.at + CASE WHEN contains(substr(t, acc.at + 1), y.w) THEN position(y.w IN substr(t, acc.at + 1)) - 1 + length(y.w) ELSE 0 END AS BIGINT), 'w': ''}},
       {{'at': 0::BIGINT, 'w': ''}}).at END AS past,
      coalesce(list_sum(list_transform(list_filter(range(1, len(units) + 1), lambda c: {WIDTH.format("array_to_string(list_slice(units, 1, c), '')")} <= 36), lambda c: length(units[c]))), 0) AS unit FROM
     (SELECT *, list_max(gaps) AS longest FROM
      (SELECT *, list_transform(range(1, len(words)), lambda j: words[j + 1].b - words[j].d) AS gaps, regexp_extract_all(t, '{CJK}|[^ 一-鿿㐀-䶿぀-ヿ가-힯]+ ?| +') AS units FROM walk WHERE NOT done)))))))
  , unnest(us) v(u) WHERE u.t <> ''),
pieces AS (SELECT video, seg_idx, i, lo, t, s, e, cut FROM walk WHERE done),
cutted AS (SELECT video, seg_idx, CAST(i AS INTEGER) AS part_idx, CAST(row_number() OVER (PARTITION BY video, seg_idx, i ORDER BY lo) - 1 AS INTEGER) AS cut_idx, cut, s AS start_ms, e AS end_ms, t AS text FROM pieces
 UNION ALL SELECT video, seg_idx, 0, 0, 'whole', s, e, text FROM t WHERE NOT wide),
laid AS (SELECT *, least(CAST(612 // greatest(length(text), 1) AS INTEGER), 43) AS cw, length(text) AS n FROM cutted)
SELECT video, seg_idx, part_idx, cut_idx, cut, start_ms, end_ms, text, 1.0::DOUBLE AS confidence, CAST(floor((720 - cw * n) / 2) AS INTEGER) AS x, 1049 AS y, CAST(cw * n AS INTEGER) AS width, 64 AS height,
 CAST(len(regexp_extract_all(text, '{CJK}|[^\\s一-鿿㐀-䶿぀-ヿ가-힯][^\\s一-鿿㐀-䶿]*')) AS INTEGER) AS n_chars FROM laid"""


@job("chunk_captions", CHUNKS)
def chunk_captions(spark, folder):
    """Every turn as a spoken segment, cut into captions with their boxes."""
    out = Cp.chunk_captions(_turns(spark, folder))
    return out.select(
        "video", "seg_idx", "part_idx", "cut_idx", "cut", "start_ms", "end_ms", "text", "confidence", "bbox.x", "bbox.y", "bbox.width", "bbox.height",
        F.size("chars").alias("n_chars"),
    )


@job("longest_pause", S.with_views("ev", body="""
, n AS (SELECT user_id, event_id, lead(ts_ms) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) - (ts_ms + 60000) AS gap FROM ev)
SELECT user_id, max(gap) AS gap, arg_max(event_id, gap * 1000000::HUGEINT - event_id) AS event_id FROM n WHERE gap > 3600000 GROUP BY ALL""").replace(")\n\n,", "),\n"))
def longest_pause(spark, folder):
    """Events as one-minute words; the longest silence of each user over an hour."""
    w = S.ev(spark, folder).select("user_id", "event_id", "ts_ms", (F.col("ts_ms") + 60000).alias("end"))
    return Cp.longest_pause(w, ["user_id"], "ts_ms", "end", "event_id", S.HOUR, chunk_of(F.col("ts_ms"), S.DAY))


@job("turn_similarity", r"""
WITH t AS (SELECT conv_id, turn, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS prev FROM conversations),
s AS (SELECT *, list_distinct(string_split(trim(text, ' ' || chr(10)), '')) AS a, list_distinct(string_split(trim(prev, ' ' || chr(10)), '')) AS b FROM t)
SELECT conv_id, turn, CASE WHEN trim(text) = '' OR trim(prev) = '' THEN 0.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) END AS jaccard,
 prev = text OR contains(text, prev) OR contains(prev, text) OR len(list_filter(string_split(text, ''), lambda c: contains(prev, c))) / greatest(length(text), length(prev), 1) >= 0.8 AS fuzzy
FROM s""")
def turn_similarity(spark, folder):
    """Each turn against the one before it, by both similarity rules."""
    c = table(spark, folder, "conversations", "conv_id", "turn", "text")
    t = scan(c, ["conv_id"], ["turn"], [Look("prev", F.col("text"), inclusive=False)], chunk_of(F.col("turn"), 1000)).withColumn("prev", F.coalesce("prev", F.lit("")))
    return t.select("conv_id", "turn", F.round(T.char_jaccard(F.col("text"), F.col("prev")), 9).alias("jaccard"), T.fuzzy_equal(F.col("text"), F.col("prev")).alias("fuzzy"))


@job("noise_tokens", r"""
SELECT conv_id, count(*) FILTER (regexp_matches(w, '^[^\p{L}\p{M}\p{Nl}\p{Pc}]+$')) AS noise, count(*) AS n FROM
 (SELECT conv_id, unnest(regexp_split_to_array(trim(text || ' — 42 .. été', ' ' || chr(10)), '\s+')) AS w FROM conversations) WHERE w <> '' GROUP BY ALL""")
def noise_tokens(spark, folder):
    t = F.explode(F.split(T.strip(F.concat("text", F.lit(" — 42 .. été"))), r"\s+"))
    w = table(spark, folder, "conversations", "conv_id", "text").select("conv_id", t.alias("w")).filter("w <> ''")
    return w.groupBy("conv_id").agg(F.count_if(T.is_noise_token(F.col("w"))).alias("noise"), F.count("*").alias("n"))


@job("tap_units", f"""
SELECT conv_id, turn, len(regexp_extract_all(t, '{CJK}|[^\\s一-鿿㐀-䶿぀-ヿ가-힯]+')) AS units, len(regexp_extract_all(t, '{CJK}|[^\\s一-鿿㐀-䶿぀-ヿ가-힯][^\\s一-鿿]*')) AS wide_units,
 list_last(regexp_extract_all(t, '{CJK}|[^\\s一-鿿㐀-䶿぀-ヿ가-힯]+')) AS last_unit, CAST(length(t) - length(list_last(regexp_extract_all(t, '{CJK}|[^\\s一-鿿㐀-䶿぀-ヿ가-힯]+'))) AS INTEGER) AS last_start
FROM (SELECT conv_id, turn, text || ' ok日本ごabcの語x' AS t FROM conversations)""")
def tap_units(spark, folder):
    """Tappable units with both rules for where a run of letters ends."""
    c = table(spark, folder, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", F.concat("text", F.lit(" ok日本ごabcの語x")).alias("t"))
    u = c.select("conv_id", "turn", T.script_units(F.col("t")).alias("u"), T.script_units(F.col("t"), False).alias("w"))
    return u.select("conv_id", "turn", F.size("u").cast("bigint").alias("units"), F.size("w").cast("bigint").alias("wide_units"),
                    F.element_at("u", -1)["unit"].alias("last_unit"), F.element_at("u", -1)["start"].alias("last_start"))


@job("overlay_units", """
SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS units, CAST(4 AS BIGINT) AS cjk_units FROM conversations""")
def overlay_units(spark, folder):
    c = table(spark, folder, "conversations", "conv_id", "turn", "text")
    return c.select("conv_id", "turn", F.size(T.dominant_script_units(F.col("text"))).cast("bigint").alias("units"),
                    F.size(T.dominant_script_units(F.concat(F.lit("你 好a"), F.substring((F.col("turn") % 10).cast("string"), 1, 1)))).cast("bigint").alias("cjk_units"))


@job("number_formats", """
SELECT o_orderkey AS id, CASE WHEN n = 0 THEN '0' WHEN n >= 10000 AND n % 5000 = 2500 THEN ((n + 500) // 10000) || '.' || ((n + 500) // 1000 % 10) || 'w' WHEN n >= 10000 THEN printf('%.1f', n / 10000) || 'w' ELSE format('{:,}', n) END AS shown,
 CAST(ms // 60000 AS VARCHAR) || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') AS clock,
 CASE o_orderkey % 8 WHEN 0 THEN 'zh-CN' WHEN 1 THEN 'en-US' WHEN 2 THEN 'ja-JP' WHEN 3 THEN 'fr-FR' WHEN 4 THEN 'es-ES' WHEN 5 THEN 'ko-KR' WHEN 6 THEN 'de-DE' ELSE 'pt' END AS locale
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 0 WHEN o_orderkey % 10 = 1 THEN 10000 + o_orderkey * 500 ELSE CAST(trunc(o_totalprice) AS BIGINT) // 20 * 10 END AS n, CAST(trunc(o_totalprice) AS BIGINT) AS ms FROM orders)""")
def number_formats(spark, folder):
    o = table(spark, folder, "orders", "o_orderkey", "o_totalprice")
    whole = F.col("o_totalprice").cast("bigint")
    n = F.when(F.col("o_orderkey") % 10 == 0, F.lit(0)).when(F.col("o_orderkey") % 10 == 1, 10000 + F.col("o_orderkey") * 500).otherwise(F.floor(whole / 20) * 10)
    code = F.get(F.array(*[F.lit(x) for x in ("zh", "en", "ja", "fr", "es", "ko", "de", "pt")]), (F.col("o_orderkey") % 8).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), T.short_count(n).alias("shown"), T.minutes_seconds(whole).alias("clock"), labels.voice_locale(code).alias("locale"))


@job("content_language", """
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'zh' WHEN doc_id % 7 = 1 THEN 'zh' ELSE lang END AS language,
 CASE WHEN doc_id % 7 <= 1 THEN true ELSE lang IN ('en', 'fr', 'es') END AS supported FROM documents""")
def content_language(spark, folder):
    """Detected codes folded and defaulted: some documents are marked as a Chinese variant or undetected."""
    from lexicue.constants import SOURCE_LANGUAGES

    d = table(spark, folder, "documents", "doc_id", "lang")
    seen = F.when(F.col("doc_id") % 7 == 0, "zh-tw").when(F.col("doc_id") % 7 == 1, F.lit(None)).otherwise(F.col("lang"))
    lang = T.content_language(seen)
    return d.select("doc_id", lang.alias("language"), lang.isin(SOURCE_LANGUAGES).alias("supported"))


DERIVED = """u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(url, '/en/', '/video/') WHEN 1 THEN regexp_replace(url, '/(en|fr|es|de)/([0-9]+)', '/photo/\\2')
   WHEN 2 THEN regexp_replace(url, '/(en|fr|es|de)/([0-9]+)', '/x?modal_id=\\2') ELSE url END AS url, html FROM pages)"""


def _derived(spark, folder):
    p = table(spark, folder, "pages", "page_id", "url", "html")
    m = F.col("page_id") % 4
    url = (F.when(m == 0, F.replace("url", F.lit("/en/"), F.lit("/video/"))).when(m == 1, F.regexp_replace("url", "/(en|fr|es|de)/([0-9]+)", "/photo/$2"))
           .when(m == 2, F.regexp_replace("url", "/(en|fr|es|de)/([0-9]+)", "/x?modal_id=$2")).otherwise(F.col("url")))
    return p.select("page_id", url.alias("url"), "html")


@job("url_ids", f"""WITH {DERIVED}
SELECT page_id, coalesce(nullif(regexp_extract(url, '/video/([0-9]+)', 1), ''), nullif(regexp_extract(url, 'modal_id=([0-9]+)', 1), ''), nullif(regexp_extract(url, '/photo/([0-9]+)', 1), ''), '') AS item_id,
 contains(replace(url, '.example.', '.tiktok.'), 'tiktok.com') AS is_tiktok, url AS found, regexp_extract(url, '^(.*/)', 1) || 'bboxes.json' AS boxes_url FROM u""")
def url_ids(spark, folder):
    """Ids, site test, first link in a sentence and the sibling document of each link."""
    d = _derived(spark, folder)
    url = F.col("url")
    sentence = F.concat(F.lit("look at "), url, F.lit(" now http://b.example"))
    return d.select("page_id", F.coalesce(U.item_id(url), F.lit("")).alias("item_id"),
                    U.is_site(F.replace(url, F.lit(".example."), F.lit(".tiktok.")), "tiktok").alias("is_tiktok"),
                    T.first_url(sentence).alias("found"), U.sibling(url, "bboxes.json").alias("boxes_url"))


@job("safe_name", r"""
WITH t AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN ' ?. ' ELSE '. a/b:' || regexp_extract(html, '<title>(.*?)</title>', 1) END AS name FROM pages),
c AS (SELECT page_id, trim(regexp_replace(name, '[\\/:*?"<>|\n\r\t]', '', 'g'), '. ') AS c FROM t)
SELECT page_id, CASE WHEN c = '' THEN 'video' ELSE substr(c, 1, 50) END AS file_name FROM c""")
def safe_name(spark, folder):
    p = table(spark, folder, "pages", "page_id", "html")
    name = F.when(F.col("page_id") % 9 == 0, " ?. ").otherwise(F.concat(F.lit(". a/b:"), F.regexp_extract("html", "<title>(.*?)</title>", 1)))
    return p.select("page_id", U.safe_file_name(name).alias("file_name"))
