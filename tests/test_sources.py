import io
import plistlib
import shutil
import struct
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.sources import files, sinks
from quarryline.streaming import sessions


@pytest.fixture()
def folder(tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("Payload/A.app/Info.plist", plistlib.dumps({"CFBundleName": "A", "n": 3, "list": [1]}))
        z.writestr("../evil", "x")
        link = zipfile.ZipInfo("Payload/A.app/link")
        link.external_attr = 0o120777 << 16
        z.writestr(link, "../B/target")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.zip").write_bytes(data.getvalue())
    (tmp_path / "in/b.zip").write_bytes(b"PK damaged")
    (tmp_path / "in/c.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480))
    (tmp_path / "in/d.gif").write_bytes(b"GIF89a" + struct.pack("<HH", 7, 300))
    (tmp_path / "in/e.strings").write_bytes('/* c */ "k" = "v \\"q\\""; // x\n"u" = "http://z"; "k2"="1"; "k2"="2";'.encode())
    (tmp_path / "in/f.plist").write_bytes(plistlib.dumps({"a": "b"}, fmt=plistlib.FMT_BINARY))
    return tmp_path


def test_archives_images_lists_and_strings(spark, folder):
    every = files.binary(spark, str(folder / "in"))
    rows = files.archive_members(every.where(F.col("path").endswith(".zip"))).collect()
    by = {r.member: r for r in rows}
    assert by["../evil"].error == "unsafe_path" and by["Payload/A.app/Info.plist"].path == "Payload/A.app/Info.plist" and by["Payload/A.app/link"].link == "../B/target" and by[None].error == "BadZipFile"
    link = spark.createDataFrame([("a/b/l", "../x/./y"), ("a/l", "../../z"), ("l", "/abs"), ("l", "t")], "p string, t string").select(files.resolve_link(F.col("p"), F.col("t")).alias("r")).collect()
    assert [r.r for r in link] == ["a/x/y", None, None, "t"]
    sizes = {r.path.rsplit("/", 1)[1]: r.s for r in every.select("path", files.image_size(F.col("content")).alias("s")).collect()}
    assert tuple(sizes["c.png"]) == (640, 480) and tuple(sizes["d.gif"]) == (7, 300) and sizes["a.zip"] is None
    assert every.where(F.col("path").endswith("f.plist")).select(files.plist_strings("content").alias("m")).first().m == {"a": "b"}
    words = {r.key: (r.value, r.error) for r in files.localized(every.where(F.col("path").endswith(".strings"))).collect()}
    assert words == {"k": ('v "q"', None), "u": ("http://z", None), "k2": (None, "duplicate_key")}
    kinds = spark.createDataFrame([("x/A.PNG",), ("b.strings",), ("noext",)], "p string").select(files.asset_category(F.col("p")).alias("c")).collect()
    assert [r.c for r in kinds] == ["image", "localization", "other"]


def test_identities_lines_states_and_sinks(spark, folder):
    before = files.identities(files.binary(spark, str(folder / "in"))).toPandas()
    (folder / "in/d.gif").write_bytes(b"other")
    after = files.identities(files.binary(spark, str(folder / "in")))
    assert [r.path.rsplit("/", 1)[1] for r in files.changed(spark.createDataFrame(before), after).collect()] == ["d.gif"]
    (folder / "x.jsonl").write_text('{"a": 1}\n[2]\nnope\n\n{"a": 3}\n')
    good, bad = files.json_lines(spark, str(folder / "x.jsonl"), T.StructType([T.StructField("a", T.LongType())]))
    assert sorted(r.a for r in good.collect() if r.a is not None) == [1, 3] and "nope" in {r.line for r in bad.collect()}
    (folder / "s.state").write_text("magic 1\nk%3D=v%0Aw+\nbroken\n")
    assert [tuple(r) for r in files.state_pairs(spark, str(folder / "s.state"), "magic 1").collect()] == [("k=", "v\nw+")]
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    sinks.write_once(rows, str(folder / "once"))
    sinks.write_once(rows, str(folder / "once"))
    with pytest.raises(ValueError):
        sinks.write_once(rows.limit(1), str(folder / "once"))
    assert sinks.report(rows, ["i"]).startswith('[\n  {\n    "i": 1,') and [r.i for r in sinks.stale(rows, rows.where("i = 1"), "i").collect()] == [2]


def test_streams_end_where_batches_do(spark, tmp_path):
    small = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(small).schema
    (tmp_path / "in").mkdir()
    shutil.copy(small, tmp_path / "in")
    stream = sessions.event_stream(spark, str(tmp_path / "in"), schema)
    q = sessions.navigation(stream).writeStream.format("memory").queryName("nav").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    from quarryline.plans.graphs import navigation_machine

    want = {(r.user_id, r.depth, r.top) for r in navigation_machine(spark, "/root/testdata/sf0.001").collect()}
    assert {(r.user_id, r.depth, r.top) for r in spark.table("nav").collect()} == want
    q = sessions.windowed_counts(stream).writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "d")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("win").agg(F.sum("n")).first()[0] == 1000
