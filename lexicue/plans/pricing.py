"""Scenarios derived from customers, and usage derived from lines, priced against the rate cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexicue import constants as K
from lexicue.operators import pricing as Pr
from lexicue.plans.registry import job
from lexicue.sources.dimensions import fixed, known
from lexicue.sources.tables import table

STT, TTS = list(K.SPEECH_RATES), list(K.SYNTHESIS_RATES)
TRANSLATION, TRANSCODE, MODEL = list(K.TRANSLATION_RATES), list(K.TRANSCODE), list(K.DEFINITION_RATES)


def _pick(values, n):
    return F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))


def scenarios(spark, folder):
    c = F.col
    k = c("c_custkey")
    return table(spark, folder, "customer", "c_custkey", "c_nationkey").select(
        k.alias("id"), F.when(k % 50 == 0, 0).when(k % 50 == 1, 100000).when(k % 50 == 2, 100001).otherwise(k * k * 37 % 2000000).cast("bigint").alias("mau"),
        (5 + k % 45).cast("double").alias("dau_percent"), (k % 7).cast("double").alias("upload_percent"), (15 + k % 60).cast("double").alias("video_sec"),
        (k % 10).cast("double").alias("sub_price"), (k % 6).cast("double").alias("sub_percent"), (1 + k % 9).cast("double").alias("ad_rpm"),
        (k % 2 == 0).alias("lean"), (k % 3 != 0).alias("uploads"), (c("c_nationkey") * 10).alias("seeded"),
        _pick(STT, k).alias("stt"), _pick(TTS, k).alias("tts"), _pick(TRANSLATION, k).alias("translation"), _pick(TRANSCODE, k).alias("transcode"),
        _pick(MODEL, k).alias("model"), (k % 4 * 1000).alias("platform_videos"), (1 + k % 12).cast("int").alias("languages"), (k % 20).cast("int").alias("views_per_day"))


def _list(values):
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def _values(rows):
    lit = lambda v: "'" + v + "'" if isinstance(v, str) else ("true" if v is True else "false" if v is False else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v))
    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + ")"


SCENARIOS = f"""scenarios AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 50 = 0 THEN 0 WHEN c_custkey % 50 = 1 THEN 100000 WHEN c_custkey % 50 = 2 THEN 100001 ELSE c_custkey * c_custkey * 37 % 2000000 END AS mau,
 CAST(5 + c_custkey % 45 AS DOUBLE) AS dau_percent, CAST(c_custkey % 7 AS DOUBLE) AS upload_percent, CAST(15 + c_custkey % 60 AS DOUBLE) AS video_sec,
 CAST(c_custkey % 10 AS DOUBLE) AS sub_price, CAST(c_custkey % 6 AS DOUBLE) AS sub_percent, CAST(1 + c_custkey % 9 AS DOUBLE) AS ad_rpm,
 c_custkey % 2 = 0 AS lean, c_custkey % 3 <> 0 AS uploads, c_nationkey * 10 AS seeded,
 ({_list(STT)})[c_custkey % {len(STT)} + 1] AS stt, ({_list(TTS)})[c_custkey % {len(TTS)} + 1] AS tts, ({_list(TRANSLATION)})[c_custkey % {len(TRANSLATION)} + 1] AS translation,
 ({_list(TRANSCODE)})[c_custkey % {len(TRANSCODE)} + 1] AS transcode, ({_list(MODEL)})[c_custkey % {len(MODEL)} + 1] AS model,
 c_custkey % 4 * 1000 AS platform_videos, CAST(1 + c_custkey % 12 AS INTEGER) AS languages, CAST(c_custkey % 20 AS INTEGER) AS views_per_day FROM customer)"""


def priced_sql(source: str) -> str:
    """The published formulas, restated as nested selects over ``source``."""
    return f"""r AS (SELECT s.*, stt_rate, tr_rate, in_rate, out_rate, min_rate, rend, share, mb, objs, managed FROM {source} s
 JOIN {_values(list(K.SPEECH_RATES.items()))} a(stt, stt_rate) USING (stt) JOIN {_values(list(K.TRANSLATION_RATES.items()))} b(translation, tr_rate) USING (translation)
 JOIN {_values([(k, *v) for k, v in K.DEFINITION_RATES.items()])} c(model, in_rate, out_rate) USING (model)
 JOIN {_values([(k, *v) for k, v in K.TRANSCODE.items()])} d(transcode, min_rate, rend, share, mb, objs, managed) USING (transcode)),
a1 AS (SELECT *, mau * dau_percent / 100 AS dau, CASE WHEN uploads THEN mau * dau_percent / 100 * upload_percent / 100 * 30 ELSE seeded END AS nv, mau * dau_percent / 100 * views_per_day * 30 AS views FROM r),
a2 AS (SELECT *, nv * video_sec / 60 AS mins, video_sec / 30 * 400 AS chars, CASE WHEN platform_videos > 0 THEN platform_videos ELSE nv * 12 END * (video_sec / 30 * mb) / 1024 AS gb FROM a1),
a3 AS (SELECT *, mins * share * rend * min_rate + mins * stt_rate + CASE WHEN tts = 'On-Device Only' THEN 0 ELSE 1.9 * 0.015 END + CASE WHEN uploads THEN nv * chars / 1e6 * tr_rate ELSE 0 END
   + (1590 / 1e6 * in_rate + 1500 / 1e6 * out_rate) * nv * languages AS media_processing,
  gb * 0.015 + CASE WHEN managed THEN 0 ELSE nv * objs / 1e6 * 4.5 + views * 0.1 / 1e6 * 0.36 END + CASE WHEN transcode = 'Cloudflare Stream' THEN views * video_sec / 60 * 0.001 ELSE 0 END AS storage_delivery,
  greatest(0, mau - 100000) * 0.00325 AS auth_over, greatest(0, views * 40 / 1024 / 1024 - 250) * 0.09 AS egress_over, log10(mau + 1) / 5 AS sf FROM a2),
a4 AS (SELECT *, CASE WHEN lean THEN 25 + greatest(0, CASE WHEN mau <= 10000 THEN 10 WHEN mau <= 50000 THEN 15 WHEN mau <= 100000 THEN 60 WHEN mau <= 250000 THEN 110 WHEN mau <= 500000 THEN 210 WHEN mau <= 750000 THEN 410 ELSE 960 END - 10)
   + auth_over + egress_over + greatest(0, nv * 7200 * 0.5 / 1024 / 1024 - 8) * 0.125 WHEN mau <= 100000 THEN 2550 * pow(sf, 1.5) ELSE 2550 * pow(mau / 100000, 0.7) END AS database,
  CASE WHEN lean THEN CASE WHEN mau <= 10000 THEN 3 WHEN mau <= 50000 THEN 13 WHEN mau <= 100000 THEN 64 WHEN mau <= 250000 THEN 129 WHEN mau <= 500000 THEN 386 ELSE 773 END
   WHEN mau <= 100000 THEN 3250 * pow(sf, 1.8) ELSE 3250 * pow(mau / 100000, 0.75) END AS compute,
  CASE WHEN lean THEN CASE WHEN mau * 0.0005 > 5000 THEN 26 ELSE 0 END + CASE WHEN mau >= 250000 THEN 200 WHEN mau >= 50000 THEN 20 ELSE 0 END + CASE WHEN mau >= 500000 THEN 199 WHEN mau >= 100000 THEN 29 ELSE 0 END
   ELSE greatest(200, 2000 * sf) + greatest(50, mau * 0.005) + CASE WHEN mau < 50000 THEN 0 ELSE greatest(5000, 5000 * sf) END + nv * 0.02 END AS platform_ops FROM a3),
a5 AS (SELECT * REPLACE (CASE WHEN mau = 0 THEN 0 ELSE media_processing END AS media_processing, CASE WHEN mau = 0 THEN 0 ELSE storage_delivery END AS storage_delivery, CASE WHEN mau = 0 THEN 0 ELSE database END AS database,
   CASE WHEN mau = 0 THEN 0 ELSE compute END AS compute, CASE WHEN mau = 0 THEN 0 ELSE platform_ops END AS platform_ops),
  mau * sub_percent / 100 * sub_price AS gross, mau * (1 - sub_percent / 100) * dau_percent / 100 * views_per_day * 30 AS ad_views FROM a4),
priced AS (SELECT *, media_processing + storage_delivery + database + compute + platform_ops AS total, gross * 0.85 + CASE WHEN ad_views >= 2000000 THEN ad_views * 0.14 / 1000 * ad_rpm ELSE 0 END AS revenue FROM a5)"""


def near(c, digits: int):
    """Rounded with a nudge, so that exact halves and signed zeros come out alike in every engine."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-7, digits) + 0.0


def money(*cols):
    return [near(c, 3).alias(c) for c in cols]


COSTS = ["media_processing", "storage_delivery", "database", "compute", "platform_ops", "total", "revenue"]


@job("scenario_pnl", f"""WITH {SCENARIOS}, {priced_sql('scenarios')}
SELECT id, {', '.join(f'CAST((round(({c}) + 1e-7, 3) + 0.0) AS DOUBLE) AS {c}' for c in COSTS)}, (round((revenue - total) + 1e-7, 3) + 0.0) AS net, ad_views >= 2000000 AS ads_eligible,
 (round((CASE WHEN mau = 0 OR NOT uploads THEN seeded ELSE nv END) + 1e-7, 3) + 0.0) AS new_videos FROM priced""")
def scenario_pnl(spark, folder):
    p = Pr.price(scenarios(spark, folder))
    return p.select("id", *money(*COSTS, "net"), "ads_eligible", *money("new_videos"))


@job("unit_economics", f"""WITH {SCENARIOS}, {priced_sql('scenarios')}
SELECT id, (round((total / mau) + 1e-7, 4) + 0.0) AS cost_per_user, (round(((revenue - total) / greatest(revenue, 0.01) * 100) + 1e-7, 1) + 0.0) AS margin,
 coalesce(CASE WHEN sub_price * sub_percent > 0 AND total > 0 THEN CAST(ceil(total / (sub_price * (sub_percent / 100) * (1 - 0.15))) AS BIGINT) END, -1) AS break_even_users FROM priced WHERE mau > 0""")
def unit_economics(spark, folder):
    p = Pr.price(scenarios(spark, folder)).filter("mau > 0")
    return p.select("id", near("cost_per_user", 4).alias("cost_per_user"), near("margin", 1).alias("margin"), F.coalesce("break_even_users", F.lit(-1)).alias("break_even_users"))


@job("scenario_warnings", f"""WITH {SCENARIOS}, {priced_sql('scenarios')}
SELECT id, array_to_string(list_filter([CASE WHEN auth_over > 0 THEN 'auth_overage' END, CASE WHEN egress_over > 0 THEN 'egress_overage' END,
 CASE WHEN stt = 'Groq Whisper (Turbo)' AND nv > 60000 THEN 'speech_rate_limit' END, CASE WHEN translation = 'Google Translate API' AND nv * chars > 500000 THEN 'translation_allowance' END,
 CASE WHEN gb > 10 THEN 'storage_allowance' END, CASE WHEN views * (video_sec / 30 * 15) / 1024 / 1024 > 50 THEN 'delivery_volume' END], lambda x: x IS NOT NULL), ',') AS warnings
FROM priced WHERE lean AND mau > 0""")
def scenario_warnings(spark, folder):
    p = Pr.price(scenarios(spark, folder)).filter("lean AND mau > 0")
    return p.select("id", F.array_join("warnings", ",").alias("warnings"))


PRESET_SQL = f"""pre AS (SELECT s.* REPLACE (CASE preset WHEN 'budget' THEN true WHEN 'balanced' THEN true WHEN 'premium' THEN false ELSE lean END AS lean,
  CASE WHEN preset = 'current' THEN stt ELSE 'Groq Whisper (Turbo)' END AS stt, CASE preset WHEN 'current' THEN tts WHEN 'premium' THEN 'ElevenLabs (Scale)' ELSE 'Google Cloud Neural2' END AS tts,
  CASE preset WHEN 'budget' THEN 'Client Compress + Progressive MP4' WHEN 'balanced' THEN 'Delayed Transcoding (>100 views)' WHEN 'premium' THEN 'Mux (Managed)' ELSE transcode END AS transcode,
  CASE WHEN preset = 'budget' THEN false ELSE uploads END AS uploads), preset FROM scenarios s, (VALUES ('current'), ('budget'), ('balanced'), ('premium')) v(preset))"""


@job("preset_delta", f"""WITH {SCENARIOS}, {PRESET_SQL}, {priced_sql('pre')},
w AS (SELECT id, max(total) FILTER (preset = 'current') AS current, max(total) FILTER (preset = 'budget') AS b, max(total) FILTER (preset = 'balanced') AS l, max(total) FILTER (preset = 'premium') AS p FROM priced GROUP BY ALL)
SELECT id, (round((current) + 1e-7, 2) + 0.0) AS current, (round(((b - current) / greatest(current, 1) * 100) + 1e-7, 2) + 0.0) AS budget_delta, (round(((l - current) / greatest(current, 1) * 100) + 1e-7, 2) + 0.0) AS balanced_delta,
 (round(((p - current) / greatest(current, 1) * 100) + 1e-7, 2) + 0.0) AS premium_delta FROM w""")
def preset_delta(spark, folder):
    d = Pr.preset_delta(Pr.price(Pr.with_presets(scenarios(spark, folder))), "id")
    return d.select("id", *[near(c, 2).alias(c) for c in d.columns if c != "id"])


@job("preset_categories", f"""WITH {SCENARIOS}, {PRESET_SQL}, {priced_sql('pre')}
SELECT preset, {', '.join(f'(round((avg({c})) + 1e-7, 2) + 0.0) AS {c}' for c in COSTS[:6])} FROM priced GROUP BY ALL""")
def preset_categories(spark, folder):
    p = Pr.price(Pr.with_presets(scenarios(spark, folder)))
    return p.groupBy("preset").agg(*[near(F.avg(c), 2).alias(c) for c in COSTS[:6]])


GRID = "[" + ", ".join(str(n) for n in K.USER_STEPS) + "]"


@job("user_sweep", f"""WITH {SCENARIOS}, sw AS (SELECT * REPLACE (CAST(n AS BIGINT) AS mau) FROM scenarios, (SELECT unnest({GRID}) AS n) g WHERE NOT lean OR n <= 1000000),
{priced_sql('sw')} SELECT lean, mau, count(*) AS scenarios, (round((avg(total)) + 1e-7, 2) + 0.0) AS total, (round((avg(revenue)) + 1e-7, 2) + 0.0) AS revenue FROM priced GROUP BY ALL""")
def user_sweep(spark, folder):
    p = Pr.price(Pr.user_sweep(scenarios(spark, folder)))
    return p.groupBy("lean", "mau").agg(F.count("*").alias("scenarios"), near(F.avg("total"), 2).alias("total"), near(F.avg("revenue"), 2).alias("revenue"))


@job("tier_price", """
SELECT o_orderkey AS id, CASE WHEN m <= 10000 THEN 10 WHEN m <= 50000 THEN 15 WHEN m <= 100000 THEN 60 WHEN m <= 250000 THEN 110 WHEN m <= 500000 THEN 210 WHEN m <= 750000 THEN 410 ELSE 960 END AS database_price,
 CASE WHEN m <= 10000 THEN 3 WHEN m <= 50000 THEN 13 WHEN m <= 100000 THEN 64 WHEN m <= 250000 THEN 129 WHEN m <= 500000 THEN 386 ELSE 773 END AS compute_price
FROM (SELECT o_orderkey, o_totalprice * 2 AS m FROM orders)""")
def tier_price(spark, folder):
    """Band prices for the users each order stands for."""
    o = table(spark, folder, "orders", "o_orderkey", "o_totalprice")
    m = F.col("o_totalprice") * 2
    return o.select(F.col("o_orderkey").alias("id"), Pr.band(m, K.DATABASE_BANDS).alias("database_price"), Pr.band(m, K.COMPUTE_BANDS).alias("compute_price"))


@job("usage_priced", f"""WITH u AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, ({_list(STT)})[l_suppkey % 4 + 1] AS stt, count(*) AS videos, CAST(sum(l_quantity) AS BIGINT) AS seconds FROM lineitem GROUP BY ALL)
SELECT month, stt, videos, (round((seconds / 60) + 1e-7, 4) + 0.0) AS minutes, (round((seconds / 60 * rate) + 1e-7, 4) + 0.0) AS stt_cost, (round((videos * (1590 / 1e6 * 0.8 + 1500 / 1e6 * 4.0) * 11) + 1e-7, 4) + 0.0) AS definitions_cost
FROM u JOIN {_values(list(K.SPEECH_RATES.items()))} r(stt, rate) USING (stt)""")
def usage_priced(spark, folder):
    """Monthly usage from lines (quantity = seconds), priced per speech provider."""
    l = table(spark, folder, "lineitem", "l_shipdate", "l_suppkey", "l_quantity")
    u = l.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month"), _pick(STT, F.col("l_suppkey")).alias("stt")).agg(
        F.count("*").alias("videos"), F.sum("l_quantity").cast("bigint").alias("seconds"))
    rates = fixed(spark, ["stt", "rate"], list(K.SPEECH_RATES.items()))
    t_in, t_out = K.DEFINITION_RATES["Claude 3.5 Haiku"]
    per_video = (K.TOKENS_IN / 1e6 * t_in + K.TOKENS_OUT / 1e6 * t_out) * 11
    return known(u, rates, "stt").select("month", "stt", "videos", near(F.col("seconds") / 60, 4).alias("minutes"),
                                       near(F.col("seconds") / 60 * F.col("rate"), 4).alias("stt_cost"), near(F.col("videos") * per_video, 4).alias("definitions_cost"))


@job("frame_cost", f"""WITH w AS (SELECT p_type AS kind, count(*) AS videos, CAST(sum(p_size) AS DOUBLE) / count(*) AS seconds FROM part GROUP BY ALL)
SELECT kind, method, (round((videos * seconds * 4 * (1 - skip / 100)) + 1e-7, 3) + 0.0) AS frames, (round((videos * seconds * 4 * (1 - skip / 100) * t / 3600) + 1e-7, 6) + 0.0) AS hours, (round((videos * seconds * 4 * (1 - skip / 100) * t / 3600 * 0.05) + 1e-7, 6) + 0.0) AS cost,
 (round((seconds * 4 * (1 - skip / 100) * t) + 1e-7, 4) + 0.0) AS video_s FROM w, {_values([(n, float(t), float(s)) for n, t, s in K.FRAME_METHODS])} m(method, t, skip)""")
def frame_cost(spark, folder):
    """Parts by type as workloads: count of videos and their average length."""
    w = table(spark, folder, "part", "p_type", "p_size").groupBy(F.col("p_type").alias("kind")).agg(F.count("*").alias("videos"), (F.sum("p_size").cast("double") / F.count("*")).alias("seconds"))
    return Pr.frame_processing(w).select("kind", "method", near("frames", 3).alias("frames"), near("hours", 6).alias("hours"), near("cost", 6).alias("cost"), near("video_s", 4).alias("video_s"))
