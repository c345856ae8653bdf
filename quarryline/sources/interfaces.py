"""Interface trees: XML files as node rows with their parent and their nearest controller."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most elements of a file, and what a document must not declare.
MOST_ELEMENTS = 100_000
_FORBIDDEN = re.compile(rb"<!(?:DOCTYPE|ENTITY)", re.I)
SCHEMA = "path string, node int, parent int, depth int, tag string, node_id string, custom_class string, controller string, attributes map<string,string>, text string, error string"
_ARROW = pa.schema([
    ("path", pa.string()), ("node", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("node_id", pa.string()), ("custom_class", pa.string()), ("controller", pa.string()),
    ("attributes", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("error", pa.string()),
])


def nodes(content: bytes) -> list[dict]:
    """The elements in document order; the controller is the id of the nearest element whose tag ends in Controller."""
    if _FORBIDDEN.search(content):
        raise ValueError("declaration")
    try:
        root = ElementTree.fromstring(content)
    except ElementTree.ParseError as e:
        raise ValueError("syntax") from e
    out, todo = [], [(root, None, 0, None)]
    while todo:
        element, parent, depth, controller = todo.pop()
        if len(out) >= MOST_ELEMENTS:
            raise ValueError("too_many_elements")
        tag, own = element.tag.rpartition("}")[2], element.get("id")
        if tag.lower().endswith("controller"):
            controller = own
        here = len(out)
        out.append({
            "node": here, "parent": parent, "depth": depth, "tag": tag, "node_id": own, "custom_class": element.get("customClass"), "controller": controller,
            "attributes": sorted((k.rpartition("}")[2], v) for k, v in element.attrib.items()), "text": (element.text or "").strip() or None,
        })
        todo += [(child, here, depth + 1, controller) for child in reversed(element)]
    return out


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.to_pylist():
            try:
                rows = [{"path": file["path"]} | n for n in nodes(file["content"] or b"")]
            except ValueError as e:
                rows = [{"path": file["path"], "error": str(e)}]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def elements(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA for files (path, content); a file that is not accepted gives one row with its error."""
    return files.select("path", "content").mapInArrow(_decode, SCHEMA)


def kind_of(content):
    """Which decoder a file's first bytes call for."""
    head = F.hex(F.substring(content, 1, 10))
    return F.when(head.startswith(F.hex(F.lit("NIBArchive"))), "nib_archive").when(head.startswith(F.hex(F.lit("bplist"))), "property_list").when(F.ltrim(F.decode(F.substring(content, 1, 16), "ISO-8859-1")).startswith("<"), "xml").otherwise("unknown")


def connections(found: DataFrame) -> DataFrame:
    """Outlets, actions and segues: (path, source, kind, destination, selector), the source being the parent of the connections element."""
    inner = found.where("tag in ('outlet', 'action', 'segue')").select("path", F.col("parent").alias("holder"), F.col("tag").alias("kind"), F.col("attributes")["destination"].alias("destination"), F.coalesce(F.col("attributes")["selector"], F.col("attributes")["property"]).alias("selector"))
    holders = found.where("tag = 'connections'").select("path", F.col("node").alias("holder"), F.col("parent").alias("node"))
    return inner.join(holders, ["path", "holder"]).join(found.select("path", "node", F.col("node_id").alias("source")), ["path", "node"]).select("path", "source", "kind", "destination", "selector")
