"""Frame and event sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexicue.functions import geometry as G
from lexicue.operators import collapse as C
from lexicue.operators.scans import Look, chunk_of, scan, row_numbers
from lexicue.plans import standins as S
from lexicue.plans.registry import job
from lexicue.sources.tables import table


#: Near-duplicate removal over ``s`` (rows numbered ``rn`` with character sets ``cs``), row by row.
NEAR = """walk AS (SELECT video, rn, stt_idx, start_ms, end_ms, text, cs FROM s WHERE rn = 1
 UNION ALL SELECT s.video, s.rn, CASE WHEN j.same THEN w.stt_idx ELSE s.stt_idx END, CASE WHEN j.same THEN w.start_ms ELSE s.start_ms END,
  CASE WHEN j.same THEN greatest(w.end_ms, s.end_ms) ELSE s.end_ms END, CASE WHEN j.same THEN w.text ELSE s.text END, CASE WHEN j.same THEN w.cs ELSE s.cs END
 FROM walk w JOIN s ON s.video = w.video AND s.rn = w.rn + 1,
 LATERAL (SELECT trim(s.text) <> '' AND trim(w.text) <> '' AND len(list_intersect(s.cs, w.cs)) / len(list_distinct(list_concat(s.cs, w.cs))) >= 0.8 AS same) j),
kept AS (SELECT video, stt_idx, any_value(start_ms) AS start_ms, max(end_ms) AS end_ms, any_value(text) AS text FROM walk GROUP BY video, stt_idx)"""


def day_chunk(col: str = "ts_ms"):
    return chunk_of(F.col(col), S.DAY)


@job(
    "exact_collapse",
    S.with_views("ev", "frames", body="""
, a AS (SELECT *, CASE WHEN text = lag(text) OVER w THEN 0 ELSE 1 END AS flag FROM frames
        WINDOW w AS (PARTITION BY video ORDER BY ts_ms, frame_id)),
b AS (SELECT *, sum(flag) OVER (PARTITION BY video ORDER BY ts_ms, frame_id) AS island FROM a)
SELECT video, min(ts_ms) AS start_ms, max(ts_ms) + 3600000 AS end_ms, any_value(text) AS text,
       arg_min(frame_id, ts_ms) AS frame_id
FROM b WHERE text <> '' GROUP BY video, island HAVING max(ts_ms) + 3600000 - min(ts_ms) >= 3600000
""").replace(")\n\n,", "),\n"),
)
def exact_collapse(spark, folder):
    f = S.frames(spark, folder).withColumn("tie", F.col("frame_id"))
    return C.exact_collapse(
        f, ["video"], "ts_ms", "text", S.HOUR, S.HOUR, tie="tie", keep=["frame_id"], chunk=day_chunk()
    )


@job(
    "carry_forward",
    S.with_views("ev", "frames", body="""
SELECT video, frame_id, coalesce(last_value(CASE WHEN frame_id % 3 = 0 THEN text END IGNORE NULLS)
   OVER (PARTITION BY video ORDER BY ts_ms, frame_id), '') AS shown FROM frames"""),
)
def carry_forward(spark, folder):
    # two of three frames were skipped by the reader
    read = F.when(F.col("frame_id") % 3 == 0, F.col("text"))
    out = C.carry_forward(
        S.frames(spark, folder), ["video"], ["ts_ms", "frame_id"], read, "shown", day_chunk()
    )
    return out.select("video", "frame_id", F.coalesce("shown", F.lit("")).alias("shown"))


@job(
    "gap_groups",
    S.with_views("ev", body="""
, a AS (SELECT user_id, event_id, ts_ms, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) > 43200000
          THEN 1 ELSE 0 END AS flag FROM ev),
b AS (SELECT *, sum(flag) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS island FROM a)
SELECT user_id, CAST(island AS BIGINT) AS island, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*) AS n
FROM b GROUP BY ALL""").replace(")\n\n,", "),\n"),
)
def gap_groups(spark, folder):
    grouped = C.gap_groups(
        S.ev(spark, folder).select("user_id", "event_id", "ts_ms"), ["user_id"], "ts_ms", 12 * S.HOUR, "event_id", day_chunk()
    )
    return grouped.groupBy("user_id", "island").agg(
        F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count("*").alias("n")
    )


@job(
    "keyframes",
    """
WITH a AS (SELECT label, vec_id, embedding, lag(embedding) OVER w AS prev, row_number() OVER w - 1 AS position
           FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
b AS (SELECT *, list_transform(range(4), lambda b:
        list_avg(list_transform(range(b * 16 + 1, b * 16 + 17), lambda i:
           abs(CAST(embedding[i] - prev[i] AS DOUBLE))))) AS means FROM a)
SELECT label, vec_id, position,
       prev IS NULL OR position % 5 = 0 OR list_max(means) > 0.15 AS is_key FROM b""",
)
def keyframes(spark, folder):
    out = C.keyframes(
        table(spark, folder, "embeddings"), ["label"], "vec_id", "embedding", 4, 0.15, 5, chunk_of(F.col("vec_id"), 1000)
    )
    return out.select("label", "vec_id", "position", "is_key")


def turn_frames(spark, folder):
    """Turns as frames 100 ms apart, one per 60 characters, numbered through the conversation.

    Odd frames misread a letter, every 9th shows nothing, and so does every 5th turn.
    """
    t = table(spark, folder, "conversations", "conv_id", "turn", "text")
    n = F.greatest(F.lit(1), F.floor(F.length("text") / 60)).cast("int")
    frames = t.select(F.col("conv_id").alias("video"), "turn", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    numbered = row_numbers(frames, ["video"], ["turn", "i"], "frame_id", F.floor(F.col("turn") / 20))
    return numbered.select(
        "video", "frame_id", (F.col("frame_id") * 100).alias("ts_ms"),
        F.when((F.col("turn") % 5 == 4) | (F.col("i") % 9 == 8), "")
        .when(F.col("i") % 2 == 1, F.translate("text", "e", "3"))
        .otherwise(F.col("text"))
        .alias("text"),
    )


TURN_FRAMES = """tf AS (SELECT conv_id AS video, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS frame_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) * 100 AS ts_ms,
 CASE WHEN turn % 5 = 4 OR i % 9 = 8 THEN '' WHEN i % 2 = 1 THEN replace(text, 'e', '3') ELSE text END AS text
 FROM (SELECT conv_id, turn, text, unnest(range(greatest(1, length(text) // 60))) AS i FROM conversations))"""
SIMILAR = """({a} = {b} OR contains({b}, {a}) OR contains({a}, {b}) OR
 len(list_filter(string_split({a}, ''), lambda c: contains({b}, c))) / greatest(length({a}), length({b})) >= 0.8)"""
#: The fold, frame by frame, as a recursive query.
FUZZY = TURN_FRAMES + f""", f AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY ts_ms) AS rn FROM tf),
walk AS (SELECT video, 0::BIGINT AS rn, 0 AS seg, false AS live, NULL::BIGINT AS start_ms, NULL::BIGINT AS end_ms, ''::VARCHAR AS match_text, NULL::BIGINT AS last_frame, NULL::BIGINT AS gap FROM (SELECT DISTINCT video FROM f)
 UNION ALL SELECT f.video, f.rn,
  CASE WHEN f.text <> '' AND NOT (w.live AND {SIMILAR.format(a='f.text', b='w.match_text')}) THEN seg + 1 ELSE seg END,
  CASE WHEN f.text <> '' THEN true WHEN w.live AND gap IS NOT NULL AND f.ts_ms - gap + 100 > 500 THEN false ELSE w.live END,
  CASE WHEN f.text <> '' AND NOT (w.live AND {SIMILAR.format(a='f.text', b='w.match_text')}) THEN f.ts_ms ELSE w.start_ms END,
  CASE WHEN f.text <> '' THEN f.ts_ms + 100 ELSE w.end_ms END,
  CASE WHEN f.text <> '' AND NOT (w.live AND {SIMILAR.format(a='f.text', b='w.match_text')}) THEN f.text ELSE w.match_text END,
  CASE WHEN f.text <> '' THEN f.frame_id ELSE w.last_frame END,
  CASE WHEN f.text <> '' THEN NULL WHEN w.live AND gap IS NULL THEN f.ts_ms WHEN w.live AND f.ts_ms - gap + 100 > 500 THEN NULL ELSE gap END
 FROM walk w JOIN f ON f.video = w.video AND f.rn = w.rn + 1),
fuzzy AS (SELECT video, any_value(start_ms) AS start_ms, max(end_ms) AS end_ms, any_value(match_text) AS match_text, max(last_frame) AS last_frame FROM walk WHERE seg > 0 GROUP BY video, seg)"""


@job("fuzzy_collapse", f"WITH RECURSIVE {FUZZY} SELECT * FROM fuzzy")
def fuzzy_collapse(spark, folder):
    return C.fuzzy_collapse(
        turn_frames(spark, folder), ["video"], "ts_ms", "text", "frame_id", 100, 500, 100, chunk_of(F.col("ts_ms"), S.HOUR)
    )


@job("flicker_merge", f"""WITH RECURSIVE {FUZZY},
lowed AS (SELECT fuzzy.*, CASE WHEN length(tf.text) % 3 <> 0 THEN tf.text ELSE '' END AS low_text FROM fuzzy JOIN tf ON tf.video = fuzzy.video AND frame_id = last_frame),
c AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY start_ms) AS rn FROM lowed WHERE low_text <> ''),
m AS (SELECT video, rn, rn AS grp, end_ms, low_text, last_frame FROM c WHERE rn = 1
 UNION ALL SELECT c.video, c.rn, CASE WHEN c.start_ms - m.end_ms <= 1500 AND {SIMILAR.format(a='c.low_text', b='m.low_text')} THEN m.grp ELSE c.rn END, c.end_ms, c.low_text, c.last_frame
 FROM m JOIN c ON c.video = m.video AND c.rn = m.rn + 1),
g AS (SELECT video, grp, arg_max(end_ms, rn) AS end_ms, arg_max(low_text, rn) AS low_text, arg_max(last_frame, rn) AS last_frame FROM m GROUP BY ALL)
SELECT g.video, c.start_ms, g.end_ms, c.match_text, g.last_frame, g.low_text FROM g JOIN c ON c.video = g.video AND c.rn = g.grp
UNION ALL SELECT video, start_ms, end_ms, match_text, last_frame, low_text FROM lowed WHERE low_text = ''""")
def flicker_merge(spark, folder):
    """Segments whose last frame shows the same caption are joined; what stands above the caption line does not count.

    Each frame shows a heading and its text, which is a caption where its length is no multiple of three.
    """
    frames = turn_frames(spark, folder)
    segs = C.fuzzy_collapse(frames, ["video"], "ts_ms", "text", "frame_id", 100, 500, 100, chunk_of(F.col("ts_ms"), S.HOUR))
    shown = lambda text, y: F.struct(F.struct(y.alias("y")).alias("bbox"), text.alias("text"))
    detections = F.array(shown(F.lit("heading"), F.lit(40)), shown(F.col("text"), F.when(F.length("text") % 3 != 0, 900).otherwise(500)))
    low = frames.select("video", F.col("frame_id").alias("last_frame"), G.lower_text(detections).alias("low_text"))
    return C.flicker_merge(segs.join(low, ["video", "last_frame"]).select(*segs.columns, "low_text"), ["video"], chunk_of(F.col("start_ms"), S.HOUR))


@job("near_duplicates", "WITH RECURSIVE speech AS (" + S.SQL["speech"] + """), s AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY start_ms, stt_idx) AS rn,
   list_distinct(string_split(trim(text), '')) AS cs FROM speech),
""" + NEAR + " SELECT video, stt_idx, start_ms, end_ms, text FROM kept")
def near_duplicates(spark, folder):
    return C.drop_near_duplicates(
        S.speech(spark, folder), ["video"], ["start_ms", "stt_idx"], chunk=chunk_of(F.col("start_ms"), S.HOUR)
    )
