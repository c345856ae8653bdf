from pyspark.sql import functions as F

from quarryline.sources import interfaces

XML = b"""<?xml version="1.0"?><document><scenes><viewController id="vc" customClass="Main"><view id="v"><button id="b" title="Go"><connections>
<action selector="tap:" destination="vc"/><segue destination="other" kind="show"/></connections></button></view></viewController></scenes></document>"""


def test_nodes_connections_and_errors(spark):
    rows = [("a", XML), ("b", b"<a><b></a>"), ("c", b"<!DOCTYPE x><a/>"), ("d", None), ("e", b"<a>" * 3000 + b"</a>" * 3000)]
    files = spark.createDataFrame(rows, "path string, content binary")
    found = interfaces.elements(files)
    by = {r.node_id: r for r in found.where("path = 'a' and node_id is not null").collect()}
    assert by["b"].controller == "vc" and by["vc"].custom_class == "Main" and by["b"].attributes["title"] == "Go" and by["v"].depth == 3
    assert {r.path: r.error for r in found.where("error is not null").collect()} == {"b": "syntax", "c": "declaration", "d": "syntax"}
    assert found.where("path = 'e'").agg(F.max("depth")).first()[0] == 2999
    assert {tuple(r)[1:] for r in interfaces.connections(found).collect()} == {("b", "action", "vc", "tap:"), ("b", "segue", "other", None)}
    kinds = spark.createDataFrame([(b"NIBArchive\x01",), (b"bplist00",), (b"  <x/>",), (b"zz",)], "c binary").select(interfaces.kind_of(F.col("c")).alias("k")).collect()
    assert [r.k for r in kinds] == ["nib_archive", "property_list", "xml", "unknown"]
