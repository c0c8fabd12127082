import pickle

import pytest
from pyspark.sql import Row, functions as F

from cuemill.functions import text as X
from cuemill.sources import listing, srt

SIMPLE = "1\n00:00:01,000 --> 00:00:03,000\nHello\n\n2\n00:00:04,000 --> 00:00:06,000\nWorld\n"


def read(spark, content, mode="auto"):
    raw = content if isinstance(content, bytes) else content.encode()
    return srt.read_srt(spark.createDataFrame([("a.srt", bytearray(raw))], "path string, content binary"), mode).first()


def test_simple_file(spark):
    got = read(spark, SIMPLE, "strict")
    assert got.how == "strict"
    assert [(c.idx, c.start_ms, c.end_ms, c.text) for c in got.cues] == [(1, 1000, 3000, "Hello"), (2, 4000, 6000, "World")]


def test_bom_crlf_and_lines_within_a_cue(spark):
    got = read(spark, b"\xef\xbb\xbf" + b"1\r\n00:00:01.5 --> 00:00:02,25\r\n Line 1 \r\nLine 2\r\n", "strict")
    assert [(c.start_ms, c.end_ms, c.text) for c in got.cues] == [(1500, 2250, "Line 1\nLine 2")]


def test_broken_file_is_read_leniently(spark):
    text = "1\n00:00:01,000 --> 00:00:02,000\ngood\n\n00:00:03,000 --> 00:00:04,000\nno index\n\n3\n00:00:05,000 --> 00:00:06,000\n\n4\n00:00:07,000 --> 00:00:08,000\nlast\n"
    got = read(spark, text)
    assert (got.how, got.skipped, [c.text for c in got.cues], [c.idx for c in got.cues]) == ("lenient", 1, ["good", "no index", "last"], [1, 2, 3])
    assert read(spark, text, "strict").how == "error"


def test_no_subtitle_is_an_error_row(spark):
    for text in ("not a subtitle at all", "\n\n", ""):
        got = read(spark, text)
        assert got.how == "error" and got.message and got.cues == []


def test_bad_bytes(spark):
    raw = SIMPLE.encode().replace(b"Hello", b"H\xff")
    assert read(spark, raw, "strict").how == "error"
    assert read(spark, raw).how == "lenient"


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "nested").mkdir()
    for name, text in (("a.srt", SIMPLE), ("nested/b.SRT", SIMPLE), ("c.txt", "x"), ("d.srt", "bad")):
        (tmp_path / name).write_text(text)
    found = srt.collect_srt(spark, [str(tmp_path)]).collect()
    assert [r.name for r in found] == ["a.srt", "b.SRT", "d.srt"]
    read = srt.read_srt(srt.read_files(spark, str(tmp_path)))
    assert srt.cues_of(read).count() == 4
    assert [r.path.split("/")[-1] for r in srt.errors_of(read).collect()] == ["d.srt"]
    assert srt.scan_media(spark, str(tmp_path), []).count() == 0


def cues(spark, rows):
    return spark.createDataFrame(rows, "media_id string, cue_no int, start_ms long, end_ms long, lang string, text string")


def test_round_trip_and_spacing(spark):
    made = cues(spark, [("e", 1, 0, 1000, "en", "hello"), ("e", 2, 1000, 2500, "en", "world"), ("j", 1, 0, 900, "ja", "こんにちは"), ("j", 2, 900, 1800, "ja", "世界")])
    files = srt.to_srt(made).select(F.col("media_id").alias("path"), "content")
    back = srt.cues_of(srt.read_srt(files, "strict")).orderBy("path", "cue_no").collect()
    assert [(c.path, c.start_ms, c.end_ms, c.text) for c in back] == [(r.media_id, r.start_ms, r.end_ms, r.text) for r in made.collect()]
    assert {r.media_id: r.content for r in srt.to_plaintext(made).collect()} == {"e": "hello world\n", "j": "こんにちは世界\n"}


def test_export_one_file_per_document(spark, tmp_path):
    made = cues(spark, [("e", 1, 0, 1000, "en", "hello"), ("f.x", 1, 0, 1000, "en", "there")])
    docs = srt.documents(made, made, ["srt", "md", "unknown"])
    srt.write_documents(docs, str(tmp_path / "out"), as_files=True)
    assert (tmp_path / "out/f.x.md").read_text() == "[00:00:00] there\n"
    assert (tmp_path / "out/e.srt").read_text() == "1\n00:00:00,000 --> 00:00:01,000\nhello\n"
    srt.write_documents(docs, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 4


def test_progress_store(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"media_id": "a", "status": "done", "language": "en"}\nbroken{\n{"media_id": "b"}\n')
    stored = srt.read_progress(spark, str(tmp_path / "p.json"))
    new = spark.createDataFrame([("a", "failed"), ("c", "done")], "media_id string, status string").withColumn("language", F.lit(None).cast("string")).withColumn("fp", F.lit(None).cast(stored.schema["fp"].dataType))
    got = {r.media_id: (r.status, r.language) for r in srt.upsert_progress(stored, new).collect()}
    assert got == {"a": ("failed", "en"), "b": (None, None), "c": ("done", None)}


def test_scalars(spark):
    one = spark.range(1)
    row = one.select(
        X.format_ts_srt(F.lit(20.22)).alias("cut"), X.format_ts_srt(F.lit(20.22), True).alias("rounded"), X.srt_ts_to_seconds(F.lit("00:01:01,5")).alias("s"),
        X.clean_response(F.lit("<think>a</think> “b” ")).alias("kept"), X.clean_response(F.lit("<think> 'b' ")).alias("bare"), X.join_text(F.lit("ja"), F.lit("世 "), F.lit(" 界")).alias("j"),
        X.reading_speed(F.lit("auto"), F.lit("世界")).alias("cjk"), X.reading_speed(F.lit("zh"), F.lit("x")).alias("zh"), X.is_english(F.lit("auto"), F.lit("a世")).alias("mixed"), X.provider_code("edge", F.lit(None).cast("string")).alias("none"),
        X.duration_label(F.lit(3725.9)).alias("d"), X.strip(F.lit("　x ")).alias("u"), X.player_suffix(F.lit("zh-hant")).alias("cht"),
    ).first()
    assert (row.cut, row.rounded, row.s) == ("00:00:20,219", "00:00:20,220", 61.5)
    assert (row.kept, row.bare, row.j, row.cjk, row.zh, row.mixed, row.none, row.d, row.u, row.cht) == ("“b”", "b", "世界", 10, 15, False, "auto-detect", "1h02m", "x", "cht")


def test_huge_index_and_blank_lines_of_any_script(spark):
    got = read(spark, "99999999999\n00:00:01,000 --> 00:00:02,000\nA\n　\n2\n00:00:03,000 --> 00:00:04,000\nB\n", "strict")
    assert [(c.idx, c.text) for c in got.cues] == [(99999999999, "A"), (2, "B")]
    got = read(spark, "9" * 30 + "\n00:00:01,000 --> 00:00:02,000\nA\n")
    assert (got.how, [c.text for c in got.cues]) == ("lenient", ["A"])
    assert read(spark, "9" * 30 + "\n00:00:01,000 --> 00:00:02,000\nA\n", "strict").how == "error"


def test_time_lines_in_texts(spark):
    text = " \n1\n00:00:01,000 --> 00:00:02,000\nA\n00:00:05,000 --> 00:00:06,000\nB\n\n\t\n2\n00:00:03,000 --> 00:00:04,000 align:start\nC"
    for mode in ("strict", "lenient"):
        got = read(spark, text, mode)
        assert [(c.start_ms, c.text) for c in got.cues] == [(1000, "A\n00:00:05,000 --> 00:00:06,000\nB"), (3000, "C")]


def test_a_bad_file_does_not_stop_others(spark):
    rows = [("bad", bytearray(b"99999999999999999999\n00:00:01,000 --> 00:00:02,000\nA\n")), ("none", None), ("good", bytearray(SIMPLE.encode()))]
    got = {r.path: r.how for r in srt.read_srt(spark.createDataFrame(rows, "path string, content binary"), "strict").collect()}
    assert got == {"bad": "error", "none": "error", "good": "strict"}


def test_a_long_file_is_one_pass(spark):
    import time

    body = "".join(f"{i}\n00:00:01,000 --> 00:00:02,000\ntext {i}\n\n" for i in range(1, 20_001))
    began = time.time()
    got = read(spark, body, "strict")
    assert len(got.cues) == 20_000 and got.cues[-1].text == "text 20000" and time.time() - began < 20


def test_export_keeps_folders_and_refuses_what_it_cannot_write(spark, tmp_path):
    import pytest

    rows = spark.createDataFrame([("x/m.srt", "1"), ("y/m.srt", "2")], "file_name string, content string").repartition(2)
    srt.write_documents(rows, str(tmp_path / "out"), as_files=True)
    assert ((tmp_path / "out/x/m.srt").read_text(), (tmp_path / "out/y/m.srt").read_text()) == ("1", "2")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["x", "y"]
    for bad in (rows.union(rows), spark.createDataFrame([("../a", "1")], "file_name string, content string")):
        with pytest.raises(Exception):
            srt.write_documents(bad, str(tmp_path / "bad"), as_files=True)
        assert not (tmp_path / "bad").exists() or not [p for p in (tmp_path / "bad").rglob("*") if p.is_file()]


def test_files_through_a_file_system_of_spark_only(spark, tmp_path):
    """viewfs, which no local path reaches."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.clips.link./data", f"file://{tmp_path}")
    schema, out = "file_name string, content string", "viewfs://clips/data/out"
    rows = [("a/b.srt", "1\nline\n"), ("a/c d%é=1.txt", "x\n\ny\r\n"), ("e.md", ""), ("n.md", None), *[(f"many/{i % 7}/{i}.srt", f"{i}\n") for i in range(60)]]
    srt.write_documents(spark.createDataFrame(rows, schema).repartition(5), out, as_files=True)
    files = {str(p.relative_to(tmp_path / "out")): p.read_bytes().decode() for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.endswith(".crc")}
    assert files == {n: c or "" for n, c in rows}
    srt.write_documents(spark.createDataFrame([("a/b.srt", "2\n")], schema), out, as_files=True)
    assert (tmp_path / "out/a/b.srt").read_text() == "2\n" and (tmp_path / "out/e.md").exists()
    for bad in ([("x", "1\n"), ("x", "2\n")], [("../x", "1\n")], [("/x", "1\n")], [(None, "1\n")], [("x", "no end")], [("", "1\n")], [("a//x", "1\n")]):
        with pytest.raises(ValueError):
            srt.write_documents(spark.createDataFrame(bad, schema), out, as_files=True)

    broken = spark.createDataFrame([("x", "1\n"), ("y", "2\n")], schema).withColumn("content", F.when(F.col("file_name") == "y", F.raise_error(F.lit("task lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="task lost"):
        srt.write_documents(broken, out, as_files=True)
    left = [p for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.endswith(".crc")]
    assert len(left) == len(rows) and not list((tmp_path / "out").glob(".parts*"))
    srt.write_documents(spark.createDataFrame([], schema), out, as_files=True)


def test_all_line_separators_end_lines(spark):
    for end in ("\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"):
        text = end.join(["1", "00:00:01,000 --> 00:00:03,000", "Hello", "you", "", "2", "00:00:04,000 --> 00:00:06,000", "World", ""])
        read = srt.read_srt(spark.createDataFrame([("a", bytearray(text.encode()))], "path string, content binary"), "strict").first()
        assert read.how == "strict" and [c.text for c in read.cues] == ["Hello\nyou", "World"], repr(end)


def test_tasks_list_as_the_driver_does(spark, tmp_path):
    """Against Spark's own listing: depth, hidden names, patterns, overlaps, odd names."""
    for name in ("a.srt", "x/b.SRT", "x/y/z/c d%é=1.srt", "x/_no/d.srt", "x/.no.srt", "x/_k=1/e.srt", "x1/f.srt", "y/g.txt", ".h/i.srt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    for paths in ([str(tmp_path)], [f"file://{tmp_path}/"], [f"{tmp_path}/*", str(tmp_path)], [f"{tmp_path}/x*"], [f"{tmp_path}/[xy]", f"{tmp_path}/x?"], [f"{tmp_path}/*/y"], [f"{tmp_path}/x/*.SRT"]):
        plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length", "modificationTime").distinct()
        wanted = sorted((r.path, r.length, r.modificationTime) for r in plain.collect() if r.path.lower().endswith(".srt"))
        assert listing.files(spark, [listing.local_path(spark, p) for p in paths]) is not None
        assert sorted((r.path, r.length, r.modified) for r in srt.collect_srt(spark, paths).collect()) == wanted and wanted
    for gone in (f"{tmp_path}/none", f"{tmp_path}/none*"):
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            srt.collect_srt(spark, [gone]).collect()


def test_the_driver_gets_a_line_for_each_task_not_for_each_file(spark, tmp_path):
    writer = srt._FileWriter(str(tmp_path / "out"))
    rows = [Row(file_name=f"{i % 3}/{i}.srt", content=str(i)) for i in range(500)]
    messages = [writer.write(iter(rows[:250])), writer.write(iter(rows[250:]))]
    assert all(len(pickle.dumps(m)) < 500 for m in messages)
    writer.commit(messages)
    assert sum(p.is_file() for p in (tmp_path / "out").rglob("*")) == 500 and (tmp_path / "out/1/4.srt").read_text() == "4"


def test_files_are_written_in_turns(spark, tmp_path):
    docs = spark.range(40).select(F.concat("id", F.lit(".srt")).alias("file_name"), F.concat("id", F.lit("\n")).alias("content"))
    srt.write_documents(docs, str(tmp_path / "out"), as_files=True, turns=3)
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {f"{i}.srt": f"{i}\n" for i in range(40)}
