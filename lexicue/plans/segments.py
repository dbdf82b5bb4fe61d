"""Segment sets: detections, matching, transcript, coverage, diagnosis, fallbacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexicue import constants as K
from lexicue.functions import geometry as G
from lexicue.functions import text as T
from lexicue.operators import detections as D
from lexicue.operators import segments as Sg
from lexicue.operators.scans import chunk_of
from lexicue.plans import standins as S
from lexicue.plans.registry import job
from lexicue.plans.sequence import NEAR
from lexicue.sources.tables import table


def views(*names, body):
    return S.with_views(*names, body=body).replace(")\n\n,", "),\n")


PERSISTENT = """persistent AS (SELECT video, text, count(DISTINCT seg_idx) AS n_segments,
   count(DISTINCT seg_idx) / any_value(total) AS share FROM ocr_dets JOIN (SELECT video, count(DISTINCT seg_idx) AS total FROM ocr_dets GROUP BY ALL) USING (video)
 WHERE trim(text) <> '' GROUP BY video, text HAVING count(DISTINCT seg_idx) / any_value(total) >= 0.7)"""
CHARSET = "list_distinct(string_split(trim({}), ''))"
MATCH = f"""said AS (SELECT * FROM speech WHERE trim(text) <> ''),
shown AS (SELECT d.video, d.seg_idx, d.det_idx, d.start_ms, d.end_ms, trim(d.text) AS text FROM ocr_dets d
  WHERE d.y / 1280.0 >= 0.40 AND (d.video, d.text) NOT IN (SELECT video, text FROM persistent)),
pairs AS (SELECT s.video, s.stt_idx, d.seg_idx, d.det_idx, d.text,
   CASE WHEN d.text = '' THEN 0.0 ELSE len(list_intersect({CHARSET.format('d.text')}, {CHARSET.format('s.text')})) /
    len(list_distinct(list_concat({CHARSET.format('d.text')}, {CHARSET.format('s.text')}))) END AS sim
  FROM said s JOIN shown d ON d.video = s.video AND d.end_ms + 500 >= s.start_ms AND d.start_ms - 500 <= s.end_ms),
best AS (SELECT video, stt_idx, sim, text FROM (SELECT *, row_number() OVER (PARTITION BY video, stt_idx ORDER BY sim DESC, seg_idx, det_idx) AS rn FROM pairs WHERE sim > 0) WHERE rn = 1),
matched AS (SELECT s.video, s.stt_idx, s.start_ms, s.end_ms, coalesce(b.sim, 0.0) AS similarity,
  CASE WHEN coalesce(b.sim, 0) >= 0.5 THEN 'ocr+stt' ELSE 'stt_only' END AS source,
  CASE WHEN coalesce(b.sim, 0) >= 0.5 THEN b.text ELSE trim(s.text) END AS text FROM said s LEFT JOIN best b USING (video, stt_idx))"""


@job("persistent_text", views("ocr_dets", body=""", total AS (SELECT video, count(DISTINCT seg_idx) AS total FROM ocr_dets GROUP BY ALL)
SELECT video, trim(text) AS text, count(DISTINCT seg_idx) AS n_segments FROM ocr_dets JOIN total USING (video) WHERE seg_idx % 4 <> 3 AND trim(text) <> ''
GROUP BY video, trim(text) HAVING count(DISTINCT seg_idx) / any_value(total) >= 0.7"""))
def persistent_text(spark, folder):
    """Every fourth segment shows nothing, and still counts."""
    d = S.ocr_dets(spark, folder)
    return Sg.persistent_texts(d.filter("seg_idx % 4 <> 3"), segments=d.select("video", "seg_idx"))


@job("best_match", views("ocr_dets", "speech", body=f""", {PERSISTENT}, {MATCH}
SELECT video, stt_idx, start_ms, end_ms, round(similarity, 9) AS similarity, source, md5(text) AS text_md5 FROM matched"""))
def best_match(spark, folder):
    out = Sg.best_match(S.speech(spark, folder), S.ocr_dets(spark, folder), F.lit(1280.0))
    return out.select("video", "stt_idx", "start_ms", "end_ms", F.round("similarity", 9).alias("similarity"), "source", F.md5("text").alias("text_md5"))


@job("merge_provenance", views("ocr_dets", "speech", body=f""", {PERSISTENT}, {MATCH}
SELECT video, count(*) FILTER (source = 'ocr+stt') AS ocr_matched, count(*) FILTER (source = 'stt_only') AS stt_only FROM matched GROUP BY ALL"""))
def merge_provenance(spark, folder):
    out = Sg.best_match(S.speech(spark, folder), S.ocr_dets(spark, folder), F.lit(1280.0))
    return out.groupBy("video").agg(F.count_if(F.col("source") == "ocr+stt").alias("ocr_matched"), F.count_if(F.col("source") == "stt_only").alias("stt_only"))


@job("merged_transcript", views("ocr_dets", "speech", body=f""", {PERSISTENT}, {MATCH},
s AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY start_ms, stt_idx) AS rn, list_distinct(string_split(trim(text), '')) AS cs FROM matched),
{NEAR}, laid AS (SELECT k.*, m.source, least(CAST(612 // greatest(length(k.text), 1) AS INTEGER), 43) AS cw, length(k.text) AS n FROM kept k JOIN matched m USING (video, stt_idx))
SELECT video, stt_idx, start_ms, end_ms, source, text, CAST(floor((720 - cw * n) / 2) AS INTEGER) AS x, 1049 AS y, CAST(cw * n AS INTEGER) AS width, 64 AS height FROM laid""").replace("WITH ", "WITH RECURSIVE ", 1))
def merged_transcript(spark, folder):
    """The whole merge: best match, near-duplicate removal, caption layout."""
    out = Sg.merged_transcript(S.speech(spark, folder), S.ocr_dets(spark, folder), F.lit(720), F.lit(1280), chunk_of(F.col("start_ms"), S.HOUR))
    return out.select("video", "stt_idx", "start_ms", "end_ms", "source", "text", "bbox.x", "bbox.y", "bbox.width", "bbox.height")


SEGS_ONLY = """cs AS (SELECT DISTINCT video, seg_idx, start_ms, end_ms FROM ocr_dets)"""


def _corpus(spark, folder):
    """Segments with the model that produced them, by segment number, and the video's duration."""
    t = table(spark, folder, "conversations", "conv_id", "turn", "text")
    s = t.select(F.col("conv_id").alias("video"), F.col("turn").alias("seg_idx"), (F.col("turn") * 3000).alias("start_ms"),
                 (F.col("turn") * 3000 + 500 + F.length("text") % 4000).alias("end_ms"), _model(F.col("turn")).alias("model"))
    return s.join(s.groupBy("video").agg((F.max("end_ms") + 1000).alias("duration")), "video")


def _model(turn):
    return F.when(turn % 4 == 0, "videocr2").when(turn % 4 == 1, "pipeline").when(turn % 4 == 2, "rapid").otherwise("baseline")


CORPUS = """c0 AS (SELECT conv_id AS video, turn AS seg_idx, turn * 3000 AS start_ms, turn * 3000 + 500 + length(text) % 4000 AS end_ms,
 CASE turn % 4 WHEN 0 THEN 'videocr2' WHEN 1 THEN 'pipeline' WHEN 2 THEN 'rapid' ELSE 'baseline' END AS model FROM conversations),
corpus AS (SELECT *, max(end_ms) OVER (PARTITION BY video) + 1000 AS duration FROM c0)"""


@job("coverage", f"""WITH {CORPUS}
SELECT video, model, count(*) AS segments, CAST(sum(end_ms - start_ms) AS BIGINT) AS covered_ms, max(duration) AS duration_ms,
 round_even(sum(end_ms - start_ms) / max(duration) * 100, 1) AS coverage FROM corpus GROUP BY ALL""")
def coverage(spark, folder):
    return Sg.coverage(_corpus(spark, folder), ["video", "model"], "duration")


@job("models_available", f"""WITH {CORPUS}
SELECT video, string_agg(DISTINCT model, ',' ORDER BY model) AS models, count(DISTINCT model) AS n FROM corpus GROUP BY ALL""")
def models_available(spark, folder):
    m = F.array_sort(F.collect_set("model"))  # at most five models exist
    return _corpus(spark, folder).groupBy("video").agg(F.array_join(m, ",").alias("models"), F.size(m).cast("bigint").alias("n"))


@job("models_missing", f"""WITH {CORPUS}
SELECT v.video, m.model FROM (SELECT DISTINCT video FROM corpus) v, (SELECT DISTINCT model FROM corpus) m
EXCEPT SELECT video, model FROM corpus""")
def models_missing(spark, folder):
    """Videos lacking a model: planned pairs minus existing ones."""
    names = F.array(*[F.lit(m) for m in ("videocr2", "pipeline", "rapid", "baseline")])
    have = _corpus(spark, folder).select("video", "model").distinct()
    return have.select("video").distinct().select("video", F.explode(names).alias("model")).join(have, ["video", "model"], "left_anti")


@job("models_distinct", f"WITH {CORPUS} SELECT DISTINCT model FROM corpus")
def models_distinct(spark, folder):
    return _corpus(spark, folder).select("model").distinct()


@job("best_model", f"""WITH {CORPUS},
m AS (SELECT video, model, count(*) AS segments, round_even(sum(end_ms - start_ms) / max(duration) * 100, 1) AS coverage,
  CASE model WHEN 'dense' THEN 0 WHEN 'videocr2' THEN 1 WHEN 'pipeline' THEN 2 WHEN 'baseline' THEN 3 END AS p FROM corpus GROUP BY video, model),
b AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY p) AS rn FROM m WHERE p IS NOT NULL AND video % 5 <> 0)
SELECT v.video, coalesce(model, '-') AS model, coalesce(segments, 0) AS segments, coalesce(coverage, 0.0) AS coverage
FROM (SELECT DISTINCT video FROM corpus) v LEFT JOIN b ON b.video = v.video AND rn = 1""")
def best_model(spark, folder):
    """Best-ranked model per video; every fifth video has none."""
    c = _corpus(spark, folder)
    cov = Sg.coverage(c.filter("video % 5 <> 0"), ["video", "model"], "duration")
    best = Sg.first_available(cov, ["video"], {m: i for i, m in enumerate(K.MODEL_PRIORITY)}, "model")
    return c.select("video").distinct().join(best, "video", "left").select(
        "video", F.coalesce("model", F.lit("-")).alias("model"), F.coalesce("segments", F.lit(0)).alias("segments"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


@job("source_fallback", """
SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'transcript' WHEN d.doc_id % 3 = 0 THEN 'stt' WHEN d.n_chars > 1500 THEN 'bboxes' ELSE 'none' END AS kind,
 CASE WHEN l.quality = 1 THEN l.toxic WHEN d.doc_id % 3 = 0 THEN 2 WHEN d.n_chars > 1500 THEN 3 ELSE -1 END AS body
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def source_fallback(spark, folder):
    """First present of transcript (good labels), speech (every third document), boxes (long documents)."""
    d = table(spark, folder, "documents", "doc_id", "n_chars")
    l = table(spark, folder, "labels", "doc_id", "quality", "toxic").filter("quality = 1")
    options = (l.select("doc_id", F.lit("transcript").alias("kind"), F.col("toxic").alias("body"))
               .unionByName(d.filter("doc_id % 3 = 0").select("doc_id", F.lit("stt").alias("kind"), F.lit(2).alias("body")))
               .unionByName(d.filter("n_chars > 1500").select("doc_id", F.lit("bboxes").alias("kind"), F.lit(3).alias("body"))))
    best = Sg.first_available(options, ["doc_id"], {k: i for i, k in enumerate(K.SOURCE_PRIORITY)}, "kind")
    return d.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce("body", F.lit(-1)).alias("body"))


@job("provenance_flag", """
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'ocr' ELSE 'both' END AS subtitle_source FROM documents d LEFT JOIN labels l USING (doc_id)""")
def provenance_flag(spark, folder):
    d = table(spark, folder, "documents", "doc_id")
    said = table(spark, folder, "labels", "doc_id").distinct().withColumn("hit", F.lit(True))
    return d.join(said, "doc_id", "left").select("doc_id", F.when(F.col("hit"), "both").otherwise("ocr").alias("subtitle_source"))


@job("speech_documents", """
SELECT doc_id, source FROM documents WHERE source = 'src7' AND lang = 'en'""")
def speech_documents(spark, folder):
    return table(spark, folder, "documents", "doc_id", "source", "lang").filter("source = 'src7' AND lang = 'en'").select("doc_id", "source")


@job("mixed_models_union", """
SELECT 'rapid' AS model, doc_id, lang AS label, n_chars, -1 AS quality FROM documents UNION ALL SELECT 'stt', doc_id, '', -1, quality FROM labels""")
def mixed_models_union(spark, folder):
    """Documents of two models with different fields in one table; absent fields become defaults."""
    a = table(spark, folder, "documents", "doc_id", "lang", "n_chars").select(F.lit("rapid").alias("model"), "doc_id", F.col("lang").alias("label"), "n_chars")
    b = table(spark, folder, "labels", "doc_id", "quality").withColumn("model", F.lit("stt"))
    return a.unionByName(b, allowMissingColumns=True).na.fill({"label": "", "n_chars": -1, "quality": -1})


@job("transcript_text", """
SELECT conv_id AS video, string_agg(text, ' ' ORDER BY turn) AS transcript FROM conversations GROUP BY ALL""")
def transcript_text(spark, folder):
    """One text per video: the group is one document, whose parts are sorted inside the row."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, folder, "conversations", "conv_id", "turn", "text").groupBy(F.col("conv_id").alias("video")).agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("transcript"))


@job("frame_text", views("ocr_dets", body="""
SELECT video, seg_idx, md5(string_agg(text, '|' ORDER BY y DESC, det_idx)) AS full_md5,
 md5(coalesce(nullif(string_agg(text, '|' ORDER BY y DESC, det_idx) FILTER (y / frame_h > 0.45), ''), string_agg(text, '|' ORDER BY y DESC, det_idx))) AS caption_md5
FROM (SELECT *, greatest(max(y + 60) OVER (PARTITION BY video, seg_idx) * 1.1, 1280) AS frame_h FROM ocr_dets) GROUP BY ALL"""))
def frame_text(spark, folder):
    """Frame text from the lowest detection upwards, and the caption text used to compare frames."""
    det = F.struct("det_idx", "text", F.struct("y", F.lit(60).alias("height")).alias("bbox"))
    frames = S.ocr_dets(spark, folder).groupBy("video", "seg_idx").agg(F.array_sort(F.collect_list(det)).alias("dets"))
    return frames.select("video", "seg_idx", F.md5(G.joined_text(G.by_y_desc(F.col("dets")))).alias("full_md5"), F.md5(G.caption_text(F.col("dets"))).alias("caption_md5"))


@job("first_title", views("ocr_dets", body="""
SELECT video, coalesce(arg_min(trim(text), seg_idx * 1000 + det_idx) FILTER (length(trim(text)) >= 2), 'Untitled') AS title FROM ocr_dets GROUP BY ALL"""))
def first_title(spark, folder):
    return Sg.first_title(S.ocr_dets(spark, folder))


@job("readable_detections", views("ocr_dets", body="""
, m AS (SELECT *, CASE seg_idx % 3 WHEN 0 THEN 'dense' WHEN 1 THEN 'rapid' ELSE 'baseline' END AS model FROM ocr_dets)
SELECT video, seg_idx, det_idx, model FROM m WHERE confidence / 100.0 >= CASE model WHEN 'dense' THEN 0.5 WHEN 'rapid' THEN 0.65 ELSE 0.7 END
 AND length(text) >= CASE WHEN regexp_matches(text, '[一-鿿㐀-䶿぀-ヿ가-힯]') THEN 1 ELSE 2 END"""))
def readable_detections(spark, folder):
    model = F.when(F.col("seg_idx") % 3 == 0, "dense").when(F.col("seg_idx") % 3 == 1, "rapid").otherwise("baseline")
    d = S.ocr_dets(spark, folder).withColumn("model", model).withColumn("confidence", F.col("confidence") / 100.0)
    return D.readable(d, spark).select("video", "seg_idx", "det_idx", "model")


POLY = """poly AS (SELECT l_orderkey AS id, l_linenumber AS n, l_returnflag || ' ' || l_linestatus || '日本' AS text,
 l_quantity * 7.25 AS x0, l_extendedprice / 100 AS y0, l_quantity * 7.25 + l_partkey % 300 AS x1, l_extendedprice / 100 + l_suppkey % 40 AS y1, l_discount * 5 + 0.5 AS conf FROM lineitem)"""


def _polys(spark, folder):
    c = F.col
    l = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_partkey", "l_suppkey", "l_discount")
    x0, y0 = c("l_quantity") * 7.25, c("l_extendedprice") / 100
    x1, y1 = x0 + c("l_partkey") % 300, y0 + c("l_suppkey") % 40
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return l.select(c("l_orderkey").alias("id"), c("l_linenumber").alias("n"), F.concat(c("l_returnflag"), F.lit(" "), c("l_linestatus"), F.lit("日本")).alias("text"),
                    (c("l_discount") * 5 + 0.5).alias("confidence"), F.array(pt(x0, y1), pt(x1, y0), pt(x0, y0), pt(x1, y1)).alias("poly"))


@job("polygon_boxes", f"""WITH {POLY}
SELECT id, n, CAST(round_even(x0, 0) AS INTEGER) AS x, CAST(round_even(y0, 0) AS INTEGER) AS y, CAST(round_even(x1 - x0, 0) AS INTEGER) AS width, CAST(round_even(y1 - y0, 0) AS INTEGER) AS height,
 round_even(conf, 4) AS confidence FROM poly WHERE y1 - y0 > 0""")
def polygon_boxes(spark, folder):
    return D.boxed(_polys(spark, folder)).select("id", "n", "bbox.*", "confidence")


@job("script_char_boxes", f"""WITH {POLY}, p AS (SELECT *, (x1 - x0) / length(text) AS cw FROM poly WHERE y1 - y0 > 0)
SELECT id, n, CAST(u.i AS BIGINT) AS unit_idx, substr(text, CAST(u.i + 1 AS BIGINT), 1) AS unit, CAST(round_even(x0 + u.i * cw, 0) AS INTEGER) AS x, CAST(round_even(cw, 0) AS INTEGER) AS width
FROM p, (VALUES (0), (2), (3), (4)) u(i)""")
def script_char_boxes(spark, folder):
    """A letter, a blank, a letter and two ideographs: four units, the blank is skipped."""
    b = D.boxed(_polys(spark, folder)).select("id", "n", F.posexplode("chars").alias("i", "c"))
    at = F.when(F.col("i") == 0, 0).otherwise(F.col("i") + 1).cast("bigint")
    return b.select("id", "n", at.alias("unit_idx"), F.col("c.char").alias("unit"), F.col("c.x").alias("x"), F.col("c.width").alias("width"))


@job("equal_char_boxes", f"""WITH {POLY}, p AS (SELECT *, (x1 * 2.0 - x0 * 2.0) / length(text) AS cw FROM poly WHERE y1 * 2.0 - y0 * 2.0 > 0)
SELECT id, n, CAST(i AS BIGINT) AS i, substr(text, CAST(i + 1 AS BIGINT), 1) AS ch, CAST(round_even(x0 * 2.0 + i * cw, 0) AS INTEGER) AS x FROM p, range(5) r(i)""")
def equal_char_boxes(spark, folder):
    """Boxes from a picture read at half size, scaled back, one per character."""
    b = D.boxed(_polys(spark, folder), scale=2.0, per_script=False)
    return b.select("id", "n", F.posexplode("chars").alias("i", "c")).select("id", "n", F.col("i").cast("bigint").alias("i"), F.col("c.char").alias("ch"), F.col("c.x").alias("x"))


@job("caption_layout", """
WITH c AS (SELECT conv_id, turn, length(text) AS n, 720 + CAST(turn AS INTEGER) * 10 AS w FROM conversations),
l AS (SELECT *, least(CAST(floor(trunc(w * 0.85) / greatest(n, 1)) AS INTEGER), CAST(trunc(w * 0.06) AS INTEGER)) AS char_width FROM c)
SELECT conv_id, turn, CAST(floor((w - char_width * n) / 2) AS INTEGER) AS x, CAST(trunc(1280 * 0.82) AS INTEGER) AS y, CAST(char_width * n AS INTEGER) AS width, char_width FROM l""")
def caption_layout(spark, folder):
    c = table(spark, folder, "conversations", "conv_id", "turn", "text")
    box = G.caption_layout(F.col("text"), 720 + F.col("turn").cast("int") * 10, F.lit(1280))
    return c.select("conv_id", "turn", box.alias("b")).select("conv_id", "turn", "b.x", "b.y", "b.width", "b.char_width")


@job("screen_fit", """
WITH s AS (SELECT p_partkey AS id, p_size * 16.0 AS vw, p_retailprice AS vh FROM part),
f AS (SELECT *, CASE WHEN vw / vh > 390.0 / 844.0 THEN 390.0 / vw ELSE 844.0 / vh END AS scale FROM s)
SELECT id, scale, CASE WHEN vw / vh > 390.0 / 844.0 THEN 0 ELSE (390.0 - vw * scale) / 2 END AS offset_x,
 CASE WHEN vw / vh > 390.0 / 844.0 THEN (844.0 - vh * scale) / 2 ELSE 0 END AS offset_y FROM f""")
def screen_fit(spark, folder):
    p = table(spark, folder, "part", "p_partkey", "p_size", "p_retailprice")
    fit = G.contain_fit(F.col("p_size") * F.lit(16.0), F.col("p_retailprice"), F.lit(390.0), F.lit(844.0))
    return p.select(F.col("p_partkey").alias("id"), fit.alias("f")).select("id", "f.scale", "f.offset_x", "f.offset_y")


@job("frame_grid", f"""WITH {CORPUS}
SELECT video, CAST(t AS BIGINT) AS ts_ms, t // 250 AS frame_idx, least(CAST(floor((t + 130) / 250 + 0.5) AS BIGINT), (duration - 1) // 250) AS shown_idx, round(t / duration, 9) AS position
FROM (SELECT DISTINCT video, duration FROM corpus), LATERAL (SELECT unnest(range(0, duration, 250)) AS t)""")
def frame_grid(spark, folder, limit_ms=None):
    """Frame times, the frame shown 130 ms later and its place on the time line; the whole video unless limited."""
    v = _corpus(spark, folder).groupBy("video").agg(F.max("duration").alias("duration"))
    end = F.col("duration") if limit_ms is None else F.least(F.col("duration"), F.lit(limit_ms))
    g = v.filter(end > 0).withColumn("ts_ms", F.explode(F.sequence(F.lit(0), end - 1, F.lit(250))))
    last = F.floor((F.col("duration") - 1) / 250)
    return g.select("video", F.col("ts_ms").cast("bigint").alias("ts_ms"), F.floor(F.col("ts_ms") / 250).alias("frame_idx"),
                    F.least(T.half_up((F.col("ts_ms") + 130) / 250), last).alias("shown_idx"), F.round(F.col("ts_ms") / F.col("duration"), 9).alias("position"))


@job("source_vote", views("ev", "frames", body="""
, d AS (SELECT video, max(ts_ms) - 1704067200000 AS duration FROM frames GROUP BY ALL),
s AS (SELECT video, CAST(trunc(duration * p) AS BIGINT) + 1704067200000 AS at_ms FROM d, (VALUES (0.25), (0.5), (0.75)) v(p)),
h AS (SELECT s.video, s.at_ms, coalesce((SELECT arg_max(f.text <> '', f.ts_ms) FROM frames f WHERE f.video = s.video AND f.ts_ms <= s.at_ms), false) AS hit FROM s)
SELECT video, count(*) FILTER (hit) AS votes, CASE WHEN count(*) FILTER (hit) >= 2 THEN 'ocr' ELSE 'stt' END AS source FROM h GROUP BY ALL"""))
def source_vote(spark, folder):
    f = S.frames(spark, folder).select("video", (F.col("ts_ms") - 1704067200000).alias("ts_ms"), (F.col("text") != "").alias("has_text"))
    return Sg.source_vote(f, f.groupBy("video").agg(F.max("ts_ms").alias("duration_ms")))


@job("language_filter", """
SELECT conv_id, turn FROM conversations WHERE trim(text) <> '' AND len(regexp_extract_all(text, '[一-鿿㐀-䶿぀-ヿ가-힯]')) / greatest(length(text), 1) <= 0.3""")
def language_filter(spark, folder):
    c = table(spark, folder, "conversations", "conv_id", "turn", "text")
    return c.filter(T.matches_language(F.col("text"), F.lit("en"))).select("conv_id", "turn")


# --- diagnosis --------------------------------------------------------------------------------
DIAG = """dframes AS (SELECT user_id AS video, event_id AS frame_id, ts_ms, CASE WHEN event_type = 'error' THEN [] ELSE [event_type, 'k' || CAST(k % 3 AS VARCHAR)] END AS texts FROM ev),
dsegs AS (SELECT video, seg_idx, start_ms, end_ms, ['click', 'k' || CAST(k % 3 AS VARCHAR)] AS seg_texts FROM segs),
cov AS (SELECT f.*, (SELECT arg_min(s.seg_idx, CAST(s.start_ms AS HUGEINT) * 10000000 + s.seg_idx) FROM dsegs s WHERE s.video = f.video AND f.ts_ms >= s.start_ms AND f.ts_ms < s.end_ms) AS seg_idx
  FROM dframes f WHERE len(f.texts) > 0),
diag AS (SELECT c.*, CASE WHEN c.seg_idx IS NOT NULL THEN list_filter(c.texts, lambda t: NOT list_contains(s.seg_texts, t)) END AS new_texts FROM cov c LEFT JOIN dsegs s ON s.seg_idx = c.seg_idx AND s.video = c.video)"""


def _diag(spark, folder):
    e = S.ev(spark, folder)
    tag = lambda: F.concat(F.lit("k"), (F.col("k") % 3).cast("string"))
    frames = e.select(F.col("user_id").alias("video"), F.col("event_id").alias("frame_id"), "ts_ms",
                      F.when(F.col("event_type") == "error", F.array().cast("array<string>")).otherwise(F.array("event_type", tag())).alias("texts"))
    segs = S.segs(spark, folder).select("video", "seg_idx", "start_ms", "end_ms", F.array(F.lit("click"), tag()).alias("seg_texts"))
    return Sg.diagnose(frames, segs, S.DAY), segs


@job("diagnosis", views("ev", "segs", body=f""", {DIAG}
SELECT video, count(*) AS text_frames, count(seg_idx) AS covered, count(*) FILTER (seg_idx IS NULL) AS missed, count(*) FILTER (len(new_texts) > 0) AS mismatched,
 round_even(count(seg_idx) / greatest(count(*), 1) * 100, 1) AS coverage FROM diag GROUP BY ALL"""))
def diagnosis(spark, folder):
    return Sg.diagnosis_totals(_diag(spark, folder)[0])


@job("diagnosis_gaps", views("ev", "segs", body=f""", {DIAG},
g0 AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY video ORDER BY ts_ms, frame_id) > 7200000 THEN 1 ELSE 0 END AS flag FROM diag WHERE seg_idx IS NULL),
g1 AS (SELECT *, sum(flag) OVER (PARTITION BY video ORDER BY ts_ms, frame_id) AS gap FROM g0),
g AS (SELECT video, gap, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, arg_min(texts, ts_ms) AS first_texts FROM g1 GROUP BY ALL),
n AS (SELECT g.video, g.gap, s.seg_idx, least(abs(g.start_ms - s.start_ms), abs(g.start_ms - s.end_ms)) AS dist,
   row_number() OVER (PARTITION BY g.video, g.gap ORDER BY least(abs(g.start_ms - s.start_ms), abs(g.start_ms - s.end_ms)), s.seg_idx) AS rn FROM g JOIN dsegs s ON s.video = g.video)
SELECT g.video, g.start_ms, g.end_ms, g.end_ms - g.start_ms + 3600000 AS duration_ms, array_to_string(g.first_texts, ' | ') AS first_texts,
 coalesce(n.seg_idx, -1) AS nearest_idx, coalesce(n.dist, -1) AS distance_ms FROM g LEFT JOIN n ON n.video = g.video AND n.gap = g.gap AND rn = 1"""))
def diagnosis_gaps(spark, folder):
    d, segs = _diag(spark, folder)
    return Sg.missed_gaps(d, segs, S.HOUR, S.DAY)


@job("missed_time", views("ev", "segs", body=f""", {DIAG},
g0 AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY video ORDER BY ts_ms, frame_id) > 7200000 THEN 1 ELSE 0 END AS flag FROM diag WHERE seg_idx IS NULL),
g1 AS (SELECT *, sum(flag) OVER (PARTITION BY video ORDER BY ts_ms, frame_id) AS gap FROM g0),
g AS (SELECT video, gap, max(ts_ms) - min(ts_ms) + 3600000 AS span FROM g1 GROUP BY ALL)
SELECT video, count(*) AS gaps, CAST(sum(span) AS BIGINT) AS missed_ms FROM g GROUP BY ALL"""))
def missed_time(spark, folder):
    """Groups of missed frames and their total time per video."""
    d, segs = _diag(spark, folder)
    gaps = Sg.missed_gaps(d, segs, S.HOUR, S.DAY)
    return gaps.groupBy("video").agg(F.count("*").alias("gaps"), F.sum("duration_ms").cast("bigint").alias("missed_ms"))


@job("diagnosis_mismatches", views("ev", "segs", body=f""", {DIAG}
SELECT video, frame_id, array_to_string(new_texts, ',') AS new_texts FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY ts_ms, frame_id) AS rn FROM diag WHERE len(new_texts) > 0) WHERE rn <= 10"""))
def diagnosis_mismatches(spark, folder):
    """The first ten mismatching frames of each video."""
    return Sg.first_mismatches(_diag(spark, folder)[0]).select("video", "frame_id", F.array_join("new_texts", ",").alias("new_texts"))


@job("models_side_by_side", f"""WITH {CORPUS}, t AS (SELECT conv_id AS video, turn * 3000 + 900 AS at_ms FROM conversations),
m AS (SELECT t.video, t.at_ms, c.model, min(c.seg_idx) AS seg_idx FROM t JOIN corpus c ON c.video = t.video AND t.at_ms >= c.start_ms AND t.at_ms < c.end_ms GROUP BY ALL)
SELECT video, at_ms, coalesce(max(seg_idx) FILTER (model = 'videocr2'), -1) AS videocr2, coalesce(max(seg_idx) FILTER (model = 'pipeline'), -1) AS pipeline,
 coalesce(max(seg_idx) FILTER (model = 'rapid'), -1) AS rapid, coalesce(max(seg_idx) FILTER (model = 'baseline'), -1) AS baseline FROM m GROUP BY ALL""")
def models_side_by_side(spark, folder):
    """Active segment of every model at a moment, one column per model."""
    from lexicue.operators import intervals as I

    models = ["videocr2", "pipeline", "rapid", "baseline"]
    c = _corpus(spark, folder)
    at = table(spark, folder, "conversations", "conv_id", "turn").select(F.col("conv_id").alias("video"), (F.col("turn") * 3000 + 900).alias("at_ms"))
    asked = at.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    hit = I.covering(asked, c, ["video", "model"], "at_ms", chunk_width=S.HOUR).filter("segment IS NOT NULL")
    wide = hit.groupBy("video", "at_ms").pivot("model", models).agg(F.max("segment.seg_idx"))
    return wide.na.fill(-1)


@job("transcript_order", views("speech", body="""
SELECT video, stt_idx, row_number() OVER (PARTITION BY video ORDER BY start_ms, stt_idx) - 1 AS position FROM speech"""))
def transcript_order(spark, folder):
    from lexicue.operators.scans import row_numbers

    s = S.speech(spark, folder).select("video", "stt_idx", "start_ms")
    return row_numbers(s, ["video"], ["start_ms", "stt_idx"], "n", chunk_of(F.col("start_ms"), S.HOUR)).select("video", "stt_idx", (F.col("n") - 1).alias("position"))


@job("word_centre", f"""WITH {POLY}, p AS (SELECT *, (x1 - x0) / length(text) AS cw FROM poly WHERE y1 - y0 > 0)
SELECT id, n, (CAST(round_even(x0, 0) AS INTEGER) + CAST(round_even(x0 + 4 * cw, 0) AS INTEGER) + CAST(round_even(cw, 0) AS INTEGER)) / 2 AS centre FROM p""")
def word_centre(spark, folder):
    """Middle between the first and last character box of each detection."""
    b = D.boxed(_polys(spark, folder))
    first, last = F.element_at("chars", 1), F.element_at("chars", -1)
    return b.select("id", "n", G.span_centre(first["x"], last["x"], last["width"]).alias("centre"))
