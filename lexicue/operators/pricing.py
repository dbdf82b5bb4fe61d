"""Usage priced against rate cards, one row per scenario.

Rate cards are fixed lists of a few rows, so they are broadcast; bands are CASE ladders built from the
fixed band lists, evaluated inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexicue import constants as K
from lexicue.operators.staging import staged
from lexicue.sources.dimensions import fixed, known

SETTINGS = [
    "mau", "dau_percent", "upload_percent", "video_sec", "sub_price", "sub_percent", "ad_rpm", "lean",
    "uploads", "seeded", "stt", "tts", "translation", "transcode", "model", "platform_videos", "languages",
    "views_per_day",
]
GROUPS = ["media_processing", "storage_delivery", "database", "compute", "platform_ops"]


def band(value: Column, bands: list[tuple]) -> Column:
    """Price of the band with ``low < value <= high``; the first band also takes lower values."""
    out = None
    for low, high, price in bands:
        if high is None:
            return out.otherwise(F.lit(price))
        cond = value <= high
        out = F.when(cond, F.lit(price)) if out is None else out.when(cond, F.lit(price))
    return out


def steps(value: Column, levels: list[tuple]) -> Column:
    """Price of the highest level reached, else 0."""
    out = F.lit(0)
    for low, price in levels:
        out = F.when(value >= low, F.lit(price)).otherwise(out)
    return out


def with_rates(scenarios: DataFrame) -> DataFrame:
    """Look up all provider rates."""
    spark = scenarios.sparkSession
    out = known(scenarios, fixed(spark, ["stt", "stt_rate"], list(K.SPEECH_RATES.items())), "stt")
    out = known(out, fixed(spark, ["translation", "translation_rate"], list(K.TRANSLATION_RATES.items())), "translation")
    out = known(out, fixed(spark, ["model", "in_rate", "out_rate"], [(k, *v) for k, v in K.DEFINITION_RATES.items()]), "model")
    columns = ["transcode", "min_rate", "renditions", "share", "stored_mb", "objects", "managed"]
    return known(out, fixed(spark, columns, [(k, *v) for k, v in K.TRANSCODE.items()]), "transcode")


def activity(df: DataFrame) -> DataFrame:
    c = F.col
    dau = c("mau") * (c("dau_percent") / 100.0)
    new = F.when(c("uploads"), dau * (c("upload_percent") / 100.0) * 30).otherwise(c("seeded").cast("double"))
    out = staged(df, dau=dau, new_videos=new, views=dau * c("views_per_day") * 30)
    return out.withColumn("video_minutes", c("new_videos") * (c("video_sec") / 60.0)).withColumn(
        "video_chars", c("video_sec") / 30.0 * 400
    )


def media_costs(df: DataFrame) -> DataFrame:
    c = F.col
    definitions = (K.TOKENS_IN / 1e6 * c("in_rate") + K.TOKENS_OUT / 1e6 * c("out_rate")) * c("new_videos") * c("languages")
    return (
        df.withColumn("transcode_cost", c("video_minutes") * c("share") * c("renditions") * c("min_rate"))
        .withColumn("stt_cost", c("video_minutes") * c("stt_rate"))
        .withColumn("tts_cost", F.when(c("tts") == "On-Device Only", 0.0).otherwise(2 * 0.95 * K.STORAGE_PER_GB))
        .withColumn("translate_cost", F.when(c("uploads"), c("new_videos") * c("video_chars") / 1e6 * c("translation_rate")).otherwise(0.0))
        .withColumn("definitions_cost", definitions)
        .withColumn("media_processing", c("transcode_cost") + c("stt_cost") + c("tts_cost") + c("translate_cost") + c("definitions_cost"))
    )


def storage_costs(df: DataFrame) -> DataFrame:
    c = F.col
    held = F.when(c("platform_videos") > 0, c("platform_videos").cast("double")).otherwise(c("new_videos") * 12)
    streamed = c("transcode") == "Cloudflare Stream"
    return (
        df.withColumn("stored_gb", held * (c("video_sec") / 30.0 * c("stored_mb")) / 1024)
        .withColumn("write_cost", F.when(c("managed"), 0.0).otherwise(c("new_videos") * c("objects") / 1e6 * K.WRITE_PER_MILLION))
        .withColumn("read_cost", F.when(c("managed"), 0.0).otherwise(c("views") * (1 - K.CACHE_HIT) / 1e6 * K.READ_PER_MILLION))
        .withColumn("delivery_cost", F.when(streamed, c("views") * (c("video_sec") / 60.0) * K.STREAM_DELIVERY_PER_MIN).otherwise(0.0))
        .withColumn("storage_delivery", c("stored_gb") * K.STORAGE_PER_GB + c("write_cost") + c("read_cost") + c("delivery_cost"))
    )


def infrastructure_costs(df: DataFrame) -> DataFrame:
    """Lean set-up priced by bands and overages; the full stack by a power of its users."""
    c, mau = F.col, F.col("mau")
    over = lambda used, free, rate: F.greatest(used - free, F.lit(0.0)) * rate
    egress = c("views") * 20 * 2 / 1024 / 1024
    db_size = c("new_videos") * 12 * 50 * 12 * 0.5 / 1024 / 1024
    base = K.DATABASE_BASE + F.greatest(band(mau, K.DATABASE_BANDS) - K.DATABASE_CREDIT, F.lit(0))
    auth_over = over(mau, K.FREE_AUTH_USERS, K.AUTH_RATE)
    egress_over = over(egress, K.FREE_EGRESS_GB, K.EGRESS_RATE)
    lean_db = base + auth_over + egress_over + over(db_size, K.FREE_DB_GB, K.DB_GB_RATE)
    errors = F.when(mau * 0.005 * 20 * 0.005 > K.FREE_ERRORS, 26).otherwise(0)
    # fixed values: content network and support steps
    lean_ops = errors + steps(mau, [(50_000, 20), (250_000, 200)]) + steps(mau, [(100_000, 29), (500_000, 199)])
    scale = F.log10(mau + 1) / F.log10(F.lit(100000.0))
    growth = mau / 100_000
    small = mau <= 100_000
    # fixed values: exponents and bases of the full stack
    full_db = F.when(small, 2550 * F.pow(scale, F.lit(1.5))).otherwise(2550 * F.pow(growth, F.lit(0.7)))
    full_compute = F.when(small, 3250 * F.pow(scale, F.lit(1.8))).otherwise(3250 * F.pow(growth, F.lit(0.75)))
    full_ops = (
        F.greatest(F.lit(200.0), 2000 * scale) + F.greatest(F.lit(50.0), mau * 0.005)
        + F.when(mau < 50_000, 0.0).otherwise(F.greatest(F.lit(5000.0), 5000 * scale)) + c("new_videos") * 0.02
    )
    lean = c("lean")
    return (
        df.withColumn("auth_overage", F.when(lean, auth_over).otherwise(0.0))
        .withColumn("egress_gb", egress)
        .withColumn("egress_overage", F.when(lean, egress_over).otherwise(0.0))
        .withColumn("database", F.when(lean, lean_db).otherwise(full_db))
        .withColumn("compute", F.when(lean, band(mau, K.COMPUTE_BANDS)).otherwise(full_compute))
        .withColumn("platform_ops", F.when(lean, lean_ops.cast("double")).otherwise(full_ops))
    )


def warnings(df: DataFrame) -> DataFrame:
    """Codes of exceeded allowances, lean set-up only."""
    c = F.col
    checks = {
        "auth_overage": c("auth_overage") > 0,
        "egress_overage": c("egress_overage") > 0,
        "speech_rate_limit": (c("stt") == "Groq Whisper (Turbo)") & (c("new_videos") > K.FREE_SPEECH_VIDEOS),
        "translation_allowance": (c("translation") == "Google Translate API") & (c("new_videos") * c("video_chars") > K.FREE_TRANSLATE_CHARS),
        "storage_allowance": c("stored_gb") > K.FREE_STORAGE_GB,
        "delivery_volume": c("views") * (c("video_sec") / 30.0 * 15) / 1024 / 1024 > 50,
    }
    raised = F.array(*[F.when(c("lean") & (c("mau") > 0) & cond, F.lit(name)) for name, cond in checks.items()])
    return df.withColumn("warnings", F.filter(raised, lambda w: w.isNotNull()))


def revenue(df: DataFrame) -> DataFrame:
    c, mau = F.col, F.col("mau")
    views = mau * (1 - c("sub_percent") / 100.0) * (c("dau_percent") / 100.0) * c("views_per_day") * 30
    return (
        df.withColumn("subscription_gross", mau * (c("sub_percent") / 100.0) * c("sub_price"))
        .withColumn("store_fees", c("subscription_gross") * K.STORE_COMMISSION)
        .withColumn("ad_views", views)
        .withColumn("ads_eligible", views >= K.AD_VIEW_THRESHOLD)
        .withColumn("ad_revenue", F.when(c("ads_eligible"), views * K.AD_FILL * K.AD_SOLD / 1000 * c("ad_rpm")).otherwise(0.0))
        .withColumn("revenue", c("subscription_gross") - c("store_fees") + c("ad_revenue"))
    )


def profit(df: DataFrame) -> DataFrame:
    c = F.col
    per_user = c("sub_price") * (c("sub_percent") / 100.0) * (1 - K.STORE_COMMISSION)
    total = sum((c(g) for g in GROUPS[1:]), c(GROUPS[0]))
    out = df.withColumn("total", total).withColumn("net", c("revenue") - c("total"))
    return (
        out.withColumn("cost_per_user", F.when(c("mau") > 0, c("total") / c("mau")))
        .withColumn("margin", (c("revenue") - c("total")) / F.greatest(c("revenue"), F.lit(0.01)) * 100)
        .withColumn("break_even_users", F.when((per_user > 0) & (c("total") > 0), F.ceil(c("total") / per_user)))
    )


def price(scenarios: DataFrame) -> DataFrame:
    """All cost groups, revenue and profit. No users means no cost, while seeded videos are still reported."""
    out = infrastructure_costs(storage_costs(media_costs(activity(with_rates(scenarios)))))
    none = F.col("mau") == 0
    out = staged(out, **{f"__{g}": F.when(none, 0.0).otherwise(F.col(g)) for g in GROUPS})
    out = out.drop(*GROUPS).withColumnsRenamed({f"__{g}": g for g in GROUPS})
    shown = F.when((F.col("mau") == 0) | ~F.col("uploads"), F.col("seeded").cast("double")).otherwise(F.col("new_videos"))
    return warnings(profit(revenue(out))).withColumn("new_videos", shown)


def with_presets(scenarios: DataFrame) -> DataFrame:
    """Each scenario as it is and under every preset: a constant list exploded per row."""
    names = ["current", *K.PRESETS]
    out = scenarios.withColumn("preset", F.explode(F.array(*[F.lit(n) for n in names])))
    for field in ("lean", "stt", "tts", "transcode", "uploads"):
        value = F.col(field)
        for name, changes in K.PRESETS.items():
            if field in changes:
                value = F.when(F.col("preset") == name, F.lit(changes[field])).otherwise(value)
        out = out.withColumn(field, value)
    return out


def preset_delta(priced: DataFrame, key: str) -> DataFrame:
    """Cost change of each preset against the current configuration, in %."""
    total = lambda n: F.max(F.when(F.col("preset") == n, F.col("total")))
    wide = priced.groupBy(key).agg(*[total(n).alias(n) for n in ("current", *K.PRESETS)])
    return wide.select(
        key, "current",
        *[((F.col(n) - F.col("current")) / F.greatest("current", F.lit(1.0)) * 100).alias(f"{n}_delta") for n in K.PRESETS],
    )


def user_sweep(scenarios: DataFrame) -> DataFrame:
    """Each scenario at 22 user counts; lean set-ups only up to their cap."""
    grid = F.array(*[F.lit(n).cast("bigint") for n in K.USER_STEPS])
    allowed = F.when(F.col("lean"), F.filter(grid, lambda n: n <= K.LEAN_MAX_USERS)).otherwise(grid)
    return scenarios.withColumn("mau", F.explode(allowed))


def frame_processing(work: DataFrame, interval_ms: int = 250, hour_price: float = 0.05) -> DataFrame:
    """Cost of reading frames per method; ``work`` has ``videos`` and ``seconds`` (average length)."""
    methods = F.array(*[
        F.struct(F.lit(n).alias("method"), F.lit(float(t)).alias("frame_s"), F.lit(float(skip)).alias("skip_pct"))
        for n, t, skip in K.FRAME_METHODS
    ])
    per_video = F.col("seconds") * 1000 / interval_ms * (1 - F.col("skip_pct") / 100)
    return work.select("*", F.inline(methods)).withColumn("frames", F.col("videos") * per_video).withColumn(
        "hours", F.col("frames") * F.col("frame_s") / 3600
    ).withColumn("cost", F.col("hours") * hour_price).withColumn("video_s", per_video * F.col("frame_s"))
