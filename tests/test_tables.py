"""Table changes, documents, pricing edges."""

import json
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexicue.operators import captions as Cp
from lexicue.operators import feed as Q
from lexicue.operators import pricing as Pr
from lexicue.operators import segments as Sg
from lexicue.operators import tables as Tb
from lexicue.sinks import files, writers as Wr
from lexicue.sources import subtitles as Sub


def test_upsert_is_idempotent_and_keeps_unsent_columns(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, name string, n int")
    ch = spark.createDataFrame([(2, "B"), (3, "C")], "id int, name string")
    once = Tb.upsert(base, ch, ["id"], {"n": F.lit(0)})
    twice = Tb.upsert(once, ch, ["id"], {"n": F.lit(0)})
    want = [(1, "a", 5), (2, "B", 6), (3, "C", 0)]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, twice.collect()))


def test_update_refreshes_only_changed_rows(spark):
    base = spark.createDataFrame([(1, 5, 0), (2, 6, 0)], "id int, n int, at int")
    ch = spark.createDataFrame([(1, 5), (2, 7), (9, 9)], "id int, n int")
    assert sorted(map(tuple, Tb.update(base, ch, ["id"], "at", F.lit(99)).collect())) == [(1, 5, 0), (2, 7, 99)]


def test_pages_concatenate_to_the_full_sort(spark):
    rows = spark.createDataFrame([(i // 3, i) for i in range(23)], "ts int, id int")
    seen, cursor = [], None
    while True:
        page = Q.keyset_page(rows, ["ts", "id"], 5, cursor)
        got = [tuple(r) for r in page.collect()]
        seen += got
        nxt = Q.next_cursor(page, ["ts", "id"], 5).first()
        if nxt.ts is None:
            break
        cursor = (nxt.ts, nxt.id)
    assert seen == sorted(((i // 3, i) for i in range(23)), reverse=True)


def test_simple_cursor_drops_ties(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (0, 3)], "ts int, id int")
    assert [tuple(r) for r in Q.keyset_page(rows, ["ts", "id"], 5, (1, 2), compound=False).collect()] == [(0, 3)]
    assert [tuple(r) for r in Q.keyset_page(rows, ["ts", "id"], 5, (1, 2)).collect()] == [(1, 1), (0, 3)]


def _docs(spark, path):
    segs = spark.createDataFrame(
        [("video_1", "dense", 0, 0, 1000, [("你好世界", 0.9)]), ("video_1", "dense", 1, 1500, 3000, [("今天天气真好", 0.9)])],
        "video string, kind string, seg_idx int, start_ms int, end_ms int, detections array<struct<text:string,confidence:double>>",
    )
    meta = spark.createDataFrame([("video_1", 5000)], "video string, duration_ms int")
    Wr.write_documents(segs, meta, path)


def test_documents_round_trip(spark, tmp_path):
    import os

    _docs(spark, str(tmp_path / "d"))
    os.makedirs(tmp_path / "named")
    assert os.listdir(tmp_path / "d") == ["video_1_dense.json"]
    os.rename(tmp_path / "d" / "video_1_dense.json", tmp_path / "named" / "video_1_dense.json")
    (tmp_path / "named" / "video_2.json").write_text(
        '{"video": "x", "duration_ms": 10, "segments": [{"start_ms": 0, "end_ms": 5, "text": "看个视频", "source": "stt_only", "spoken": true}]}'
    )
    (tmp_path / "named" / "video_9_videocr2.json").write_text('{"video": "y", "duration_ms": 10, "segments": []}')
    docs = Sub.read_documents(spark, str(tmp_path / "named"))
    assert sorted((r.file_video, r.model) for r in docs.collect()) == [("video_1", "dense"), ("video_2", "baseline"), ("video_9", "videocr2")]
    segs = Sub.segments(docs)
    assert sorted(r.text for r in segs.collect()) == sorted(["你好世界", "今天天气真好", "看个视频"])
    cov = {(r.video, r.model): (r.segments, r.coverage) for r in Sg.coverage(segs, ["video", "model"], "duration_ms").collect()}
    assert cov[("video_1", "dense")] == (2, 50.0)
    titles = {r.video: r.title for r in Sg.first_title(Sub.detections(segs)).collect()}
    assert titles == {"video_1": "你好世界"}


def test_first_title_skips_short(spark):
    d = spark.createDataFrame([("v", 0, 0, "a"), ("v", 1, 0, " 有效标题 "), ("w", 0, 0, "。")], "video string, seg_idx int, det_idx int, text string")
    assert {r.video: r.title for r in Sg.first_title(d).collect()} == {"v": "有效标题", "w": "Untitled"}


def test_captions_fit_and_keep_all_text(spark):
    long = "好" * 50
    latin = "the quick brown fox jumps over the lazy dog and runs far away again"
    rows = [("v", 0, 0, 9000, long, []), ("v", 1, 9000, 20000, latin, [(9.0, 9.5, "fox"), (12.0, 12.5, "jumps")]), ("v", 2, 0, 10, "short.", [])]
    df = spark.createDataFrame(rows, "video string, seg_idx int, start_ms bigint, end_ms bigint, text string, words array<struct<start:double,end:double,word:string>>")
    out = Cp.chunk_captions(df).orderBy("seg_idx", "part_idx", "cut_idx").collect()
    texts = lambda i: [r.text for r in out if r.seg_idx == i]
    assert texts(0) == ["好" * 18, "好" * 18, "好" * 14]
    assert texts(1)[0] == "the quick brown fox" and " ".join(texts(1)) == latin  # the pause comes after "fox"
    assert texts(2) == ["short."]
    spans = [(r.start_ms, r.end_ms) for r in out if r.seg_idx == 0]
    assert spans == [(0, 3240), (3240, 6480), (6480, 9000)]


def test_pricing_edges(spark):
    base = dict(mau=0, dau_percent=20.0, upload_percent=5.0, video_sec=30.0, sub_price=8.0, sub_percent=2.0, ad_rpm=3.0, lean=True, uploads=False,
                seeded=100, stt="Groq Whisper (Turbo)", tts="On-Device Only", translation="DeepL API Pro", transcode="Mux (Managed)", model="GPT-4o",
                platform_videos=0, languages=12, views_per_day=15)
    rows = [base | {"mau": m, "lean": lean} for m, lean in ((0, True), (10_000, True), (10_001, True), (100_000, False), (100_001, False))]
    out = Pr.price(spark.createDataFrame(rows)).select("mau", "total", "new_videos", "database", "compute", "media_processing").collect()
    got = {r.mau: r for r in out}
    assert got[0].total == 0 and got[0].new_videos == 100
    assert (got[10_000].database, got[10_000].compute) == (25, 3) and (got[10_001].database, got[10_001].compute) == (30, 13)
    assert round(got[100_000].database, 1) == 2550.0 and round(got[100_001].database, 1) == 2550.0
    media = 100 * 0.5 * 0.0075 + 100 * 0.5 * 0.000667 + (1590 / 1e6 * 2.5 + 1500 / 1e6 * 10) * 100 * 12
    assert abs(got[10_000].media_processing - media) < 1e-9


def test_surrogate_ids_repeat(spark):
    df = spark.createDataFrame([("a", "en"), ("a", "en"), ("b", "en")], "w string, l string").select(Tb.surrogate_id("w", "l").alias("i"))
    a, b, c = [r.i for r in df.collect()]
    assert a == b != c and len(a) == 32


def test_surrogate_ids_keep_parts_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("a", None), (None, "a"), ("", "a"), (None, None), ("1:a", ""), ("", "1:a")]
    ids = [r.i for r in spark.createDataFrame(rows, "w string, l string").select(Tb.surrogate_id("w", "l").alias("i")).collect()]
    assert len(set(ids)) == len(rows)


def test_append_fills_defaults_and_keeps_old_rows(spark, tmp_path):
    path = str(tmp_path / "videos")
    rows = spark.createDataFrame([(1, "en")], "id int, language string")
    Wr.append(rows, path, ["language"], status=F.lit("processing"))
    Wr.append(rows.withColumn("id", F.lit(2)).withColumn("status", F.lit("ready")), path, ["language"], status=F.lit("processing"))
    got = spark.read.parquet(path).select("id", "status", "language").collect()
    assert sorted(map(tuple, got)) == [(1, "processing", "en"), (2, "ready", "en")]


def test_captions_and_documents_are_written_per_video(spark, tmp_path):
    segs = spark.createDataFrame(
        [("a", 1, 61_500, 62_000, "two"), ("a", 0, 0, 900, "one"), ("b", 0, 0, 5, 'q"ü')], "video string, seg_idx int, start_ms int, end_ms int, text string")
    Wr.write_captions(segs, str(tmp_path / "c"))
    assert (tmp_path / "c" / "a.vtt").read_text() == "WEBVTT\n\n00:00:00.000 --> 00:00:00.900\none\n\n00:01:01.500 --> 00:01:02.000\ntwo\n"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["c"] and sorted(p.name for p in (tmp_path / "c").iterdir()) == ["a.vtt", "b.vtt"]
    Wr.write_captions(segs.where("video = 'b'"), str(tmp_path / "c"))  # overwrites as a whole
    assert [p.name for p in (tmp_path / "c").iterdir()] == ["b.vtt"]
    Wr.write_documents(segs.select("video", F.lit("stt").alias("kind"), "seg_idx", "start_ms", "end_ms", F.array("text").alias("detections")),
                       spark.createDataFrame([("a", 99), ("b", 98)], "video string, duration_ms int"), str(tmp_path / "d"))
    a, b = (json.loads((tmp_path / "d" / f"{v}_stt.json").read_text()) for v in "ab")
    assert a["duration_ms"] == 99 and [s["detections"][0] for s in a["segments"]] == ["one", "two"]
    assert b == {"video": "b", "duration_ms": 98, "segments": [{"start_ms": 0, "end_ms": 5, "detections": ['q"ü']}]}


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0), (None, 1)], "n string, i int")
    with pytest.raises(Exception, match="needs a name"):
        files.write(rows, F.col("n"), [F.col("i")], F.lit("<"), F.col("i").cast("string"), ",", ">", str(tmp_path / "x"))
    assert list(tmp_path.iterdir()) == []


def test_a_file_larger_than_a_batch_keeps_its_order(spark, tmp_path):
    rows = spark.range(60_000).select((F.col("id") % 2).alias("n"), "id")
    files.write(rows, F.col("n"), [F.col("id")], F.lit("<"), F.col("id").cast("string"), ",", ">", str(tmp_path / "x"))
    for n in (0, 1):
        assert (tmp_path / "x" / str(n)).read_text() == "<" + ",".join(map(str, range(n, 60_000, 2))) + ">"


def test_a_writer_holds_few_rows_of_a_batch(tmp_path):
    names = pa.array(["a"] * 20_000 + ["b"] * 10, pa.string())
    batch = pa.RecordBatch.from_arrays([names, pa.array(["<"] * len(names)), pa.array(["x" * 1000] * len(names))], names=["name", "head", "text"])
    writer = files.NamedFilesWriter(str(tmp_path / "x"), ",", ">")
    tracemalloc.start()
    message = writer.write(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    writer.commit([message])
    assert message.files == 2 and peak < 4_000_000  # the batch has 20 MB of text
    assert (tmp_path / "x" / "b").read_text() == "<" + ",".join(["x" * 1000] * 10) + ">"


def test_attach_words(spark):
    segs = spark.createDataFrame([("v", 0, 1000, 2000), ("v", 1, 5000, 6000)], "video string, seg_idx int, start_ms int, end_ms int")
    words = spark.createDataFrame([("v", "b", 1.5, 2.04), ("v", "a", 0.96, 1.2), ("v", "late", 1.9, 2.2)], "video string, word string, start double, end double")
    got = {r.seg_idx: [w.word for w in r.words] for r in Cp.attach_words(segs, words, 1.0).collect()}
    assert got == {0: ["a", "b"], 1: []}


def test_surviving_copies_of_videos(spark, tmp_path):
    for n in ("video_1.mp4", "video_1_clean.mp4", "video_2_noaudio.mp4", "video_3.mp4", "notes.txt"):
        (tmp_path / n).write_bytes(b"x" * 1048576)
    got = Sub.catalog(spark, str(tmp_path)).orderBy("file_name").collect()
    assert [tuple(r) for r in got] == [("video_1.mp4", 1.0), ("video_3.mp4", 1.0)]


def test_unknown_names_stop_the_job(spark):
    from lexicue.operators import detections as D

    rows = spark.createDataFrame([("dense", "text", 0.9), ("pipeline", "text", 0.9)], "model string, text string, confidence double")
    assert D.readable(rows.filter("model = 'dense'"), spark).count() == 1
    with pytest.raises(Exception, match="unknown model: pipeline"):
        D.readable(rows, spark).collect()
