import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.sources import bundles, files, reports, sinks


def test_report_records(spark, tmp_path):
    good = {"schema_version": 1, "artifact": "calls", "facts": {"edges": [{"a": 1}, {"a": 2}]}, "hypotheses": [], "errors": []}
    for name, value in (("good", good), ("other", good | {"artifact": "x"}), ("old", good | {"schema_version": 0}), ("bare", {"artifact": "calls"}), ("none", good | {"facts": {}})):
        (tmp_path / f"{name}.json").write_text(json.dumps(value, indent=2))
    (tmp_path / "bad.json").write_text("[1")
    records, errors = reports.report_records(spark, str(tmp_path), "calls", "edges", T.StructType([T.StructField("a", T.LongType())]))
    assert sorted((r.place, r.a) for r in records.collect()) == [(0, 1), (1, 2)]
    assert {r.path.rsplit("/", 1)[1].split(".")[0]: r.error for r in errors.collect()} == {"other": "artifact", "old": "version", "bare": "envelope", "none": "collection", "bad": "no_object"}


def test_verified_texts(spark):
    given = spark.createDataFrame([("a", 2, bytearray(b"hi")), ("b", 2, bytearray(b"no")), ("big", 99, bytearray(b"x" * 99))], "path string, length long, content binary")
    right = given.select(F.sha2(F.lit("hi"), 256)).first()[0]
    index = spark.createDataFrame([("f1", "a", "success", right), ("f2", "b", "success", "00"), ("f3", "big", "success", None), ("f4", "gone", "success", None), ("f5", "b", "failed", None), ("f6", "a", "success", None)], "owner string, path string, status string, sha256 string")
    found = lambda required: {r.owner: r.text or r.error for r in reports.verified_texts(index, given, 10, required).collect()}
    assert found(True) == {"f1": "hi", "f2": "changed", "f3": "too_large", "f4": "missing", "f6": "no_digest"} and found(False)["f6"] == "hi"


def test_swapped_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.swap(spark.range(3), path)
    sinks.swap(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and not (tmp_path / "t.old").exists() and not (tmp_path / "t.new").exists()
    with pytest.raises(Exception, match="broken"):
        sinks.swap(spark.range(2).select(F.raise_error(F.lit("broken")).alias("x")), path)
    assert spark.read.parquet(path).count() == 5


def test_texts_of_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a|b", 2), ("c\nd", 1), (None, 3)], "name string, n int")
    assert sinks.markdown("Names", rows, ["n"]) == "# Names\n\n| name | n |\n| --- | --- |\n| c d | 1 |\n| a\\|b | 2 |\n|  | 3 |\n"
    with pytest.raises(ValueError, match="at most 2"):
        sinks.markdown("Names", rows, ["n"], 2)
    pairs = spark.createDataFrame([("k=1", "v%\n"), ("a", "+ x")], "key string, value string")
    text = sinks.state_text(pairs, "STATE", 2, "app")
    assert text == "STATE\nversion=2\nnamespace=app\na=+ x\nk%3D1=v%25%0A\n"
    (tmp_path / "s.txt").write_text(text)
    (tmp_path / "bad.txt").write_text(text.replace("version=2", "version=3"))
    back, errors = files.state_guarded(spark, str(tmp_path), "STATE", 2, "app")
    assert {(r.key, r.value) for r in back.collect()} == {("k=1", "v%\n"), ("a", "+ x")} and [r.error for r in errors.collect()] == ["version"]
    for bad in ([("magic", "x")], [("", "x")], [("a", "x"), ("a", "y")]):
        with pytest.raises(ValueError, match="reserved"):
            sinks.state_text(spark.createDataFrame(bad, "key string, value string"), "STATE", 2, "app")
    assert sinks.instantiate("{{a}} and {{b}}{{a}}", {"a": "1", "b": "2"}) == "1 and 21"
    with pytest.raises(ValueError, match="unfilled"):
        sinks.instantiate("{{a}}", {})


def test_long_chains_of_links(spark):
    rows = [("z", f"p{i}", f"p{i + 1}") for i in range(70)] + [("z", "p70", None), ("z", "c1", "c2"), ("z", "c2", "c3"), ("z", "c3", "c1"), ("z", "out", "../x"), ("y", "p1", None), ("z", "lost", "nothing")]
    got = {(r.archive, r.path): (r.target, r.state) for r in bundles.link_targets(spark.createDataFrame(rows, "archive string, path string, link string")).collect()}
    assert all(got["z", f"p{i}"] == ("p70", "file") for i in range(70))
    assert {got["z", c][1] for c in ("c1", "c2", "c3")} == {"cycle"} and got["z", "out"] == (None, "outside") and got["z", "lost"] == ("nothing", "missing")
