"""Words, definitions and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexicue import constants as K
from lexicue.functions import text as T
from lexicue.operators import learning as L
from lexicue.operators import matching as M
from lexicue.operators import vocab as V
from lexicue.operators.scans import chunk_of
from lexicue.plans import standins as S
from lexicue.plans.registry import job
from lexicue.operators.staging import materialized
from lexicue.sources.tables import table

NOISE = r"^[^\p{L}\p{M}\p{Nl}\p{Pc}]+$"
TOKENS = rf"list_filter(regexp_split_to_array(trim(text, ' ' || chr(10) || chr(9) || chr(13)), '\s+'), lambda t: t <> '' AND NOT regexp_matches(t, '{NOISE}'))"
S.SQL["occ"] = f"""
SELECT conv_id AS video, turn AS seg_idx, turn * 3000 AS start_ms, turn * 3000 + 500 + length(text) % 4000 AS end_ms,
 word, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS word_index
FROM (SELECT conv_id, turn, text, unnest(toks) AS word, unnest(range(len(toks))) AS pos FROM
 (SELECT *, {TOKENS} AS toks FROM conversations))"""


def segments(spark, folder):
    return table(spark, folder, "conversations", "conv_id", "turn", "text").select(
        F.col("conv_id").alias("video"), F.col("turn").alias("seg_idx"), (F.col("turn") * 3000).alias("start_ms"),
        (F.col("turn") * 3000 + 500 + F.length("text") % 4000).alias("end_ms"), "text")


def occ(spark, folder):
    return V.occurrences(segments(spark, folder), ["video"], ["seg_idx"], "text", chunk_of(F.col("seg_idx"), 1000))


@job("word_occurrences", S.with_views("occ", body="SELECT * FROM occ"))
def word_occurrences(spark, folder):
    return occ(spark, folder).drop("text")


@job("word_first_sentence", S.with_views("occ", body="""
SELECT o.video, o.word, o.word_index, md5(c.text) AS sentence_md5 FROM
 (SELECT video, word, min(word_index) AS word_index, arg_min(seg_idx, word_index) AS seg_idx FROM occ GROUP BY ALL) o
 JOIN conversations c ON c.conv_id = o.video AND c.turn = o.seg_idx"""))
def word_first_sentence(spark, folder):
    """Only the place is aggregated; the sentence is fetched afterwards by key."""
    words = occ(spark, folder).select("video", "seg_idx", "word", "word_index")
    first = words.groupBy("video", "word").agg(F.min("word_index").alias("word_index"), F.min_by("seg_idx", "word_index").alias("seg_idx"))
    return first.join(segments(spark, folder).select("video", "seg_idx", "text"), ["video", "seg_idx"]).select(
        "video", "word", "word_index", F.md5("text").alias("sentence_md5"))


DOC_TOKENS = f"SELECT lang, unnest({TOKENS}) AS word FROM documents"


@job("word_rank", f"""
WITH w AS (SELECT lang, word, count(*) AS n FROM ({DOC_TOKENS}) GROUP BY ALL)
SELECT lang, word, n, rank() OVER (PARTITION BY lang ORDER BY n DESC) AS frequency_rank FROM w""")
def word_rank(spark, folder):
    d = table(spark, folder, "documents", "lang", "text")
    counts = d.select("lang", F.explode(T.tokens(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    return L.frequency_rank(counts, "lang", "word", "n")


LANG_LIST = "[" + ", ".join(f"'{c}'" for c, _ in K.TARGET_LANGUAGES) + "]"


@job("definition_plan", f"""
WITH w AS (SELECT DISTINCT lang, word FROM ({DOC_TOKENS})),
p AS (SELECT lang, word, unnest({LANG_LIST}) AS target_language FROM w)
SELECT lang, target_language, count(*) AS words, CAST(sum(length(word)) AS BIGINT) AS chars FROM p WHERE target_language <> lang GROUP BY ALL""")
def definition_plan(spark, folder):
    """Planned requests per source and target language, over every word of every document."""
    words = table(spark, folder, "documents", "lang", "text").select("lang", F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    return V.definition_plan(words, "lang").groupBy("lang", "target_language").agg(F.count("*").alias("words"), F.sum(F.length("word")).alias("chars"))


@job("definition_missing", S.with_views("occ", body=f"""
SELECT DISTINCT word FROM occ WHERE word NOT IN (SELECT word FROM ({DOC_TOKENS}))"""))
def definition_missing(spark, folder):
    known = table(spark, folder, "documents", "text").select(F.explode(T.tokens(F.col("text"))).alias("word"))
    words = occ(spark, folder).select("word").distinct()
    return V.missing(words, known, ["word"])


@job("definition_reuse", S.with_views("definitions", body="""
SELECT p_partkey AS vocab_id, target_language, translation FROM part JOIN
 (SELECT vocab_id, target_language, arg_min(translation, definition_id) AS translation FROM definitions GROUP BY ALL) d ON d.vocab_id = p_partkey"""))
def definition_reuse(spark, folder):
    words = table(spark, folder, "part").select(F.col("p_partkey").alias("vocab_id"))
    return V.reuse(words, S.definitions(spark, folder), ["vocab_id"], ["translation"], ["definition_id"])


@job("definition_completeness", S.with_views("definitions", body="""
SELECT vocab_id, count(DISTINCT target_language) AS languages, count(DISTINCT target_language) / 3 AS share FROM definitions GROUP BY ALL"""))
def definition_completeness(spark, folder):
    return V.completeness(S.definitions(spark, folder), "vocab_id", 3)


def _map(d):
    return "MAP {" + ", ".join("'%s': '%s'" % (k, v.replace("'", "''")) for k, v in d.items()) + "}"


def _sql_label(i, kind):
    src = K.REQUEST_LABELS if kind == "q" else K.REPLY_LABELS
    return f"{_map({k: v[i] for k, v in src.items()})}[target_language]"


NAMES = _map(dict(K.TARGET_LANGUAGES))


@job("request_text", f"""
WITH w AS (SELECT DISTINCT p_name AS word, p_brand || ' ' || p_name AS sentence FROM part),
p AS (SELECT *, unnest({LANG_LIST}) AS target_language FROM w)
SELECT word, sentence, target_language, md5({_sql_label(0, 'q')} || ' English ' || {_sql_label(1, 'q')} || ' "' || word || '" ' || {_sql_label(2, 'q')}
 || ' ' || {NAMES}[target_language] || ' ' || {_sql_label(3, 'q')} || ': "' || sentence || '"' || chr(10) || chr(10) || {_sql_label(5, 'q')} || chr(10)
 || {_sql_label(0, 'a')} || ': <' || {NAMES}[target_language] || '>' || chr(10) || {_sql_label(1, 'a')} || ': <' || {NAMES}[target_language] || '>' || chr(10)
 || {_sql_label(2, 'a')} || ': <noun/verb/adjective/etc.>' || chr(10) || chr(10) || {_sql_label(4, 'q')}) AS request_md5
FROM p WHERE target_language <> 'en'""")
def request_text(spark, folder):
    p = table(spark, folder, "part", "p_name", "p_brand")
    words = p.select(F.col("p_name").alias("word"), F.concat_ws(" ", "p_brand", "p_name").alias("sentence")).distinct().withColumn("src", F.lit("en"))
    plan = V.definition_plan(words, "src")
    return plan.select("word", "sentence", "target_language",
                       F.md5(V.request_text(F.col("word"), F.col("sentence"), F.col("src"), F.col("target_language"))).alias("request_md5"))


REPLY = """replies AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'zh' ELSE 'xx' END AS target_language,
 'Sure, here it is' || chr(10) || '  ' || CASE o_orderkey % 3 WHEN 0 THEN 'Übersetzung' WHEN 1 THEN '翻译' ELSE 'Translation' END || ':  w: ' || o_orderpriority || ' ' || chr(10)
 || CASE WHEN o_orderkey % 2 = 0 THEN 'Contextual Definition: ' ELSE 'Definition: ' END || o_orderstatus || chr(10) || 'Part of Speech:noun' || chr(10) || 'Part of Speech: verb' AS reply FROM orders)"""


@job("reply_fields", f"""
WITH {REPLY} SELECT id, target_language, trim(regexp_extract(reply, '\\n +(?:Übersetzung|翻译|Translation):([^\\n]*)', 1)) AS translation,
 trim(regexp_extract(reply, '\\nContextual Definition:([^\\n]*)', 1)) AS contextual_definition, 'verb' AS part_of_speech FROM replies""")
def reply_fields(spark, folder):
    """Replies rendered from orders, some with localized labels; the later of two lines wins."""
    c = F.col
    o = table(spark, folder, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    m = c("o_orderkey") % 3
    reply = F.concat(
        F.lit("Sure, here it is\n  "), F.when(m == 0, "Übersetzung").when(m == 1, "翻译").otherwise("Translation"), F.lit(":  w: "), c("o_orderpriority"),
        F.lit(" \n"), F.when(c("o_orderkey") % 2 == 0, "Contextual Definition: ").otherwise("Definition: "), c("o_orderstatus"), F.lit("\nPart of Speech:noun\nPart of Speech: verb"))
    r = o.select(c("o_orderkey").alias("id"), F.when(m == 0, "de").when(m == 1, "zh").otherwise("xx").alias("target_language"), reply.alias("reply"))
    return r.select("id", "target_language", *V.parse_reply(c("reply"), c("target_language")))


# --- matching ---------------------------------------------------------------------------------
IGNORED = r"[\s　，。？！“”‘’《》【】.,!?''\"()\-:;]"
S.SQL["tap_words"] = """SELECT video, word_index, word AS display_text, start_ms, end_ms FROM occ WHERE length(word) % 3 <> 0"""
S.SQL["taps"] = """
SELECT conv_id * 1000 + turn AS tap_id, conv_id AS video, text AS full_text, CAST((conv_id * 31 + turn * 17) % length(text) AS INTEGER) AS char_index,
 turn * 3000 + 1000 AS time_ms, substr(text, (conv_id * 31 + turn * 17) % length(text) + 1, 1) AS tapped FROM conversations WHERE length(text) > 0"""


def taps(spark, folder):
    at = ((F.col("conv_id") * 31 + F.col("turn") * 17) % F.length("text")).cast("int")
    return table(spark, folder, "conversations", "conv_id", "turn", "text").filter(F.length("text") > 0).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("tap_id"), F.col("conv_id").alias("video"), F.col("text").alias("full_text"),
        at.alias("char_index"), (F.col("turn") * 3000 + 1000).alias("time_ms"), F.substring(F.col("text"), at + 1, F.lit(1)).alias("tapped"))


#: The best word of each tap and where it starts, over ``tap_words`` and ``taps``.
TAPPED = rf"""
, n AS (SELECT *, regexp_replace(full_text, '{IGNORED}', '', 'g') AS norm,
   length(regexp_replace(substr(full_text, 1, char_index), '{IGNORED}', '', 'g')) AS before FROM taps),
m AS (SELECT *, CASE WHEN before < length(norm) THEN before ELSE char_index END AS at_pos FROM n),
w AS (SELECT *, regexp_replace(display_text, '{IGNORED}', '', 'g') AS nw FROM tap_words),
c AS (SELECT m.tap_id, w.word_index, w.display_text, abs(2 * m.time_ms - (w.start_ms + w.end_ms)) AS dist,
   list_filter(range(greatest(0, at_pos - length(w.nw) + 1), at_pos + 1), lambda p: substr(m.norm, p + 1, length(w.nw)) = w.nw)[1] AS pos
  FROM m JOIN w ON w.video = m.video AND w.nw <> '' AND
   contains(substr(m.norm, CAST(greatest(0, at_pos - length(w.nw) + 1) AS BIGINT) + 1, CAST(at_pos - greatest(0, at_pos - length(w.nw) + 1) + length(w.nw) AS BIGINT)), w.nw)),
b AS (SELECT tap_id, arg_min(display_text, dist * 100000 + word_index) AS display_text, arg_min(word_index, dist * 100000 + word_index) AS word_index,
   arg_min(pos, dist * 100000 + word_index) AS pos FROM c GROUP BY ALL),
f AS (SELECT m.tap_id, arg_min(w.display_text, CASE WHEN m.time_ms >= w.start_ms - 3000 AND m.time_ms < w.end_ms + 3000 THEN 0 ELSE 10000000 END + w.word_index) AS display_text,
    arg_min(w.word_index, CASE WHEN m.time_ms >= w.start_ms - 3000 AND m.time_ms < w.end_ms + 3000 THEN 0 ELSE 10000000 END + w.word_index) AS word_index
  FROM m JOIN w ON w.video = m.video AND contains(w.display_text, m.tapped) WHERE m.tap_id NOT IN (SELECT tap_id FROM b) GROUP BY ALL)"""


@job("tap_match", S.with_views("occ", "tap_words", "taps", body=TAPPED + """
SELECT m.tap_id, m.video, coalesce(b.display_text, f.display_text, '') AS display_text, coalesce(b.word_index, f.word_index, -1) AS word_index
FROM m LEFT JOIN b USING (tap_id) LEFT JOIN f USING (tap_id)""").replace(")\n\n,", "),\n"))
def tap_match(spark, folder):
    """Every turn is tapped once; words of lengths divisible by three are missing from the vocabulary."""
    # stands for the stored table of word occurrences
    words = materialized(occ(spark, folder).filter(F.length("word") % 3 != 0).select(
        "video", "word_index", F.col("word").alias("display_text"), "start_ms", "end_ms"))
    out = M.match_taps(taps(spark, folder), words, S.HOUR)
    return out.select("tap_id", "video", F.coalesce("display_text", F.lit("")).alias("display_text"), F.coalesce("word_index", F.lit(-1)).alias("word_index"))


S.SQL["dictionary"] = """
SELECT word, CASE WHEN length(word) > 2 THEN array_to_string(string_split(upper(word), ''), ' ') ELSE upper(word) END AS reading FROM
 (SELECT DISTINCT unnest([string_split(p_name, ' ')[1], string_split(p_name, ' ')[2], lower(substr(p_type, 1, 2))]) AS word FROM part) WHERE length(word) <= 4"""


GREEDY = "WITH RECURSIVE dictionary AS (" + S.SQL["dictionary"] + """),
hits AS (SELECT id, pos, arg_max(reading, length(word)) AS reading, max(length(word)) AS len FROM
  (SELECT p_partkey AS id, p_name, unnest(range(1, length(p_name) + 1)) AS pos FROM part) t JOIN dictionary d ON substr(p_name, pos, length(word)) = word GROUP BY ALL),
walk AS (SELECT p_partkey AS id, length(p_name) AS n, 1::BIGINT AS pos, '' AS readings FROM part
 UNION ALL SELECT w.id, n, w.pos + coalesce(h.len, 1), CASE WHEN h.reading IS NULL THEN w.readings WHEN w.readings = '' THEN h.reading ELSE w.readings || ' ' || h.reading END
 FROM walk w LEFT JOIN hits h ON h.id = w.id AND h.pos = w.pos WHERE w.pos <= n)"""


@job("greedy_dict", GREEDY + " SELECT id, arg_max(readings, pos) AS readings FROM walk GROUP BY ALL")
def greedy_dict(spark, folder):
    """Part names covered by a dictionary of the short words and type openings that occur."""
    return _greedy(spark, folder).select("id", "readings")


def _greedy(spark, folder):
    p = table(spark, folder, "part", "p_partkey", "p_name", "p_type")
    words = p.select(F.explode(F.concat(F.split("p_name", " "), F.array(F.lower(F.substring("p_type", 1, 2))))).alias("word")).distinct().filter(F.length("word") <= 4)
    dictionary = words.withColumn("reading", F.when(F.length("word") > 2, F.array_join(T.chars(F.upper("word")), " ")).otherwise(F.upper("word")))
    return M.greedy_cover(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), "id", "text", dictionary, "word", "reading")


@job("greedy_syllables", GREEDY + """, used AS (SELECT w.id, w.pos, list_slice(string_split(h.reading, ' '), 1, h.len) AS ss FROM walk w JOIN hits h ON h.id = w.id AND h.pos = w.pos WHERE w.pos <= w.n)
SELECT id, CAST(pos - 1 + unnest(range(len(ss))) AS INTEGER) AS pos, unnest(ss) AS syllable FROM used""")
def greedy_syllables(spark, folder):
    return _greedy(spark, folder).select("id", F.inline("syllables"))


@job("shared_opening", """
WITH l AS (SELECT doc_id, unnest(list_slice(string_split(text, chr(10)), 1, 3)) AS line FROM documents),
r AS (SELECT substr(line, 1, 10) AS o, max(doc_id) AS remote_id FROM l WHERE doc_id % 2 = 0 GROUP BY ALL)
SELECT l.doc_id AS local_id, max(r.remote_id) AS remote_id FROM l JOIN r ON r.o = substr(l.line, 1, 10) WHERE l.doc_id % 2 = 1 GROUP BY ALL""")
def shared_opening(spark, folder):
    """Odd documents are local, even ones remote; the first three lines are compared."""
    lines = table(spark, folder, "documents", "doc_id", "text").select("doc_id", F.explode(F.slice(F.split("text", "\n"), 1, 3)).alias("line"))
    local = lines.filter("doc_id % 2 = 1").withColumnRenamed("doc_id", "local_id")
    remote = lines.filter("doc_id % 2 = 0").withColumnRenamed("doc_id", "remote_id")
    return M.shared_opening(local, remote, "local_id", "remote_id", "line")


@job("translation_window", S.with_views("occ", body="""
SELECT t.conv_id AS video, t.turn AS seg_idx, md5(string_agg(o.word, ' ' ORDER BY o.word_index)) AS translation_md5, count(*) AS n
FROM conversations t JOIN occ o ON o.video = t.conv_id AND t.turn * 3000 <= o.start_ms + 2000 AND o.end_ms - 2000 <= t.turn * 3000 + 500 + length(t.text) % 4000 GROUP BY ALL"""))
def translation_window(spark, folder):
    """Words within two seconds of a segment, in order, translations joined by blanks."""
    from lexicue.operators import intervals as I

    w = occ(spark, folder).select("video", "word_index", F.col("word").alias("translation"),
                                  (F.col("start_ms") + K.TRANSLATION_WINDOW_MS).alias("w0"), (F.col("end_ms") - K.TRANSLATION_WINDOW_MS).alias("w1"))
    # seg.start <= w0 and w1 <= seg.end: an asymmetric test, expressed as an overlap of spans
    s = segments(spark, folder).select("video", "seg_idx", "start_ms", "end_ms")
    w = w.withColumn("lo", F.least("w0", "w1")).withColumn("hi", F.greatest("w0", "w1"))
    pairs = I.overlapping(s, w, ["video"], ("start_ms", "end_ms"), ("lo", "hi"), 4000).filter(
        (F.col("start_ms") <= F.col("w0")) & (F.col("w1") <= F.col("end_ms")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_index", "translation"))), lambda x: x["translation"]), " ")
    return pairs.groupBy("video", "seg_idx").agg(F.md5(text).alias("translation_md5"), F.count("*").alias("n"))


S.SQL["all_words"] = S.SQL["tap_words"].split(" WHERE ")[0]


@job("tap_highlight", S.with_views("occ", "all_words", "taps", body=TAPPED.replace("tap_words", "all_words") + rf""",
s AS (SELECT m.tap_id, coalesce(b.display_text, f.display_text) AS shown, CAST(CASE WHEN b.tap_id IS NOT NULL THEN
    list_filter(range(0, length(full_text)), lambda i: NOT regexp_matches(substr(full_text, i + 1, 1), '{IGNORED}'))[b.pos + 1]
   WHEN contains(full_text, f.display_text) THEN position(f.display_text IN full_text) - 1 ELSE char_index END AS INTEGER) AS word_start
  FROM m LEFT JOIN b USING (tap_id) LEFT JOIN f USING (tap_id))
SELECT tap_id, word_start AS highlight_start, CAST(word_start + length(shown) AS INTEGER) AS highlight_end FROM s WHERE shown IS NOT NULL""").replace(")\n\n,", "),\n"))
def tap_highlight(spark, folder):
    """Range of characters to highlight for each matched tap."""
    words = materialized(occ(spark, folder).select("video", "word_index", F.col("word").alias("display_text"), "start_ms", "end_ms"))
    out = M.match_taps(taps(spark, folder), words, S.HOUR).filter("display_text IS NOT NULL")
    return out.select("tap_id", F.col("word_start").alias("highlight_start"), (F.col("word_start") + F.length("display_text")).alias("highlight_end"))


@job("definition_rows", """
SELECT p_partkey AS vocab_id, lang AS target_language, p_name || '-' || lang AS translation, CASE lang WHEN 'en' THEN p_type ELSE '' END AS part_of_speech
FROM part, (VALUES ('en'), ('fr'), ('es')) l(lang) WHERE lang <> CASE p_partkey % 2 WHEN 0 THEN 'es' ELSE '' END""")
def definition_rows(spark, folder):
    """Nested maps {language: {translation, part of speech}} to one row per language."""
    p = table(spark, folder, "part", "p_partkey", "p_name", "p_type")
    entry = lambda lang, pos: (F.lit(lang), F.struct(F.concat_ws("-", "p_name", F.lit(lang)).alias("translation"), pos.alias("part_of_speech")))
    full = F.create_map(*entry("en", F.col("p_type")), *entry("fr", F.lit(None).cast("string")), *entry("es", F.lit(None).cast("string")))
    defs = F.when(F.col("p_partkey") % 2 == 0, F.map_filter(full, lambda k, v: k != "es")).otherwise(full)
    return p.select(F.col("p_partkey").alias("vocab_id"), F.explode(defs).alias("target_language", "d")).select(
        "vocab_id", "target_language", "d.translation", F.coalesce("d.part_of_speech", F.lit("")).alias("part_of_speech"))
