"""Hand cases for expressions, CJK included."""

import pytest
from pyspark.sql import functions as F

from lexicue.functions import geometry as G
from lexicue.functions import labels, profile
from lexicue.functions import text as T
from lexicue.functions import urls as U
from lexicue.operators import vocab as V
from lexicue.operators.learning import motivation


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize("text,width,wide", [("你好World", 9, False), ("你好 世界", 8, False), ("", 0, False), ("好" * 18, 36, False), ("好" * 19, 38, True), ("a b" * 20, 40, True)])
def test_visual_width(spark, text, width, wide):
    assert one(spark, T.visual_width(F.col("t")), t=text) == width
    assert one(spark, T.too_wide(F.col("t")), t=text) is wide


def test_split_after_punctuation(spark):
    assert one(spark, T.split_after_punctuation(F.col("t")), t="你好，世界。 Hi! ok") == ["你好，", "世界。", "Hi!", "ok"]


def test_tokens_number_kept_words_only(spark):
    assert one(spark, T.tokens(F.col("t")), t=" hello — 42 été\tworld , 你好 ") == ["hello", "été", "world", "你好"]


@pytest.mark.parametrize("a,b,want", [("", "abc", 0.0), ("abc", "abc", 1.0), ("abcd", "abxy", 2 / 6), ("  ab ", "ab", 1.0)])
def test_char_jaccard(spark, a, b, want):
    assert one(spark, T.char_jaccard(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)
    assert one(spark, T.char_jaccard(F.col("b"), F.col("a")), a=a, b=b) == pytest.approx(want)


def test_fuzzy_equal_is_not_symmetric(spark):
    f = lambda a, b: one(spark, T.fuzzy_equal(F.col("a"), F.col("b")), a=a, b=b)
    assert f("aaaaaaaaab", "aXXXXXXXXX") and not f("aXXXXXXXXX", "aaaaaaaaab")
    assert f("hello", "hello!") and f("", "x") and not f("abc", "xyz")


def test_script_units_two_rules(spark):
    u = lambda rule: [(r.unit, r.start) for r in one(spark, T.script_units(F.col("t"), rule), t="ok 日本abごc")]
    assert u(True) == [("ok", 0), ("日", 3), ("本", 4), ("ab", 5), ("ご", 7), ("c", 8)]
    assert u(False) == [("ok", 0), ("日", 3), ("本", 4), ("abごc", 5)]


def test_layout_and_fit(spark):
    b = one(spark, G.caption_layout(F.col("t"), F.lit(720), F.lit(1280)), t="你好世界")
    assert (b.x, b.y, b.width, b.height, b.char_width) == (274, 1049, 172, 64, 43)
    f = one(spark, G.contain_fit(F.lit(720.0), F.lit(1280.0), F.lit(360.0), F.lit(800.0)))
    assert (f.scale, f.offset_x, f.offset_y) == (0.5, 0.0, 80.0)


def test_half_even_boxes(spark):
    pts = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.5, 1.5), (3.0, 4.0))])
    b = one(spark, G.box_struct(G.polygon_box(pts)))
    assert (b.x, b.y, b.width, b.height) == (0, 2, 2, 2)


@pytest.mark.parametrize("n,want", [(0, "0"), (9999, "9,999"), (12345, "1.2w"), (12500, "1.3w"), (14500, "1.4w"), (12345678, "1234.6w"), (99950, "10.0w"), (None, "0")])
def test_short_count(spark, n, want):
    assert one(spark, T.short_count(F.lit(n).cast("bigint"))) == want


def test_clock_and_labels(spark):
    assert one(spark, T.minutes_seconds(F.lit(65_400))) == "1:05"
    assert one(spark, labels.rating_label(F.lit(3))) == "Got it"
    assert one(spark, labels.state_label(F.lit(9))) == ""
    assert one(spark, labels.voice_locale(F.lit("pt"))) == "pt"
    assert one(spark, motivation(F.lit(0))) == "" and one(spark, motivation(F.lit(6))) == "Strengthen your memory"


REPLY = "Sure:\n  翻译: 你好: 吗  \nContextual Definition: greeting\nPart of Speech: noun\nPart of Speech:verb"


def test_reply_fields(spark):
    r = spark.range(1).select(*V.parse_reply(F.lit(REPLY), F.lit("zh"))).first()
    assert tuple(r) == ("你好: 吗", "greeting", "verb")
    r = spark.range(1).select(*V.parse_reply(F.lit("nothing here"), F.lit("en"))).first()
    assert tuple(r) == ("", "", "")


def test_definition_plan_counts(spark):
    words = spark.createDataFrame([("你好", "zh"), ("world", "en")], "word string, lang string")
    plan = V.definition_plan(words, "lang").collect()
    assert len(plan) == 22 and not [r for r in plan if r.lang == r.target_language]


def test_urls(spark):
    assert one(spark, U.item_id(F.lit("https://x/video/12?modal_id=3"))) == "12"
    assert one(spark, U.item_id(F.lit("https://x/?modal_id=3"))) == "3"
    assert one(spark, U.item_id(F.lit("https://x/"))) is None
    assert one(spark, U.safe_file_name(F.lit(' .a/b:c?. '))) == "abc"
    assert one(spark, U.sibling(F.lit("https://x/v/1/video.mp4"), "stt.json")) == "https://x/v/1/stt.json"
    with pytest.raises(Exception, match="no path"):
        one(spark, U.sibling(F.lit("nothing"), "stt.json"))


def test_profile_rules(spark):
    arr = lambda *x: F.array(*[F.lit(i) for i in x])
    assert one(spark, profile.toggle_learning(arr("en"), F.lit("en"))) == ["en"]
    assert one(spark, profile.toggle_learning(arr("en", "zh"), F.lit("en"))) == ["zh"]
    assert one(spark, profile.without_native(arr("en"), F.lit("en"))) == ["en"]
    assert one(spark, profile.onboarding_complete(F.lit("en"), arr("en"))) is False
    with pytest.raises(Exception, match="unknown profile field"):
        one(spark, profile.stored_field(F.lit("shoeSize")))


def test_language_match(spark):
    m = lambda t, lang: one(spark, T.matches_language(F.lit(t), F.lit(lang)))
    assert m("你好abc", "zh") and not m("你好abc", "en") and m("hello", "en") and not m("  ", "en")
