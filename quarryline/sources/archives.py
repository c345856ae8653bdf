"""Object graphs of interface archives: compiled and keyed ones as the same flat rows, and the view tree as joins over them.

A row is one value of one object: (path, object, class_name, key, ordinal, kind, number, text, target). Values of
arrays are rows of one key with rising ordinals. What is a node, whose child it is and which controller owns it
follow from the rows: references through containers are a join, ownership is a flood that stops at controllers.
"""

from __future__ import annotations

import math
import plistlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators.graph import closure

#: The compiled form's magic, header, limits and value kinds (bytes, form); 4 and 5 are booleans, 8 bytes, 9 nothing, 10 a reference.
MAGIC, HEADER, MOST_ENTRIES, MOST_TEXT = b"NIBArchive", 50, 200_000, 16 << 20
NUMBERS = {0: "b", 1: "h", 2: "i", 3: "q", 6: "f", 7: "d"}
#: Containers, keys that hold children, and class name parts that are no nodes.
CONTAINERS = ("NSArray", "NSMutableArray", "NSSet", "NSMutableSet", "NSOrderedSet")
TEXTS = ("NSString", "NSMutableString")
EMPTY_KEY = "UINibEncoderEmptyKey"
NO_NODES = "Connection|Constraint|Segue|Proxy|Nib|Storyboard|ClassSwapper"
NODE_STARTS = "^(?:UIView|UIControl|UILabel|UIButton|UIImageView|UIWindow)"
NODE_KEYS = ("UISubviews", "UIFrame", "UIBounds", "UIConstraints")
CHILD_KEYS = ("NS.objects", "UIChildViewControllers", "UIItems", "UINavigationItems", "UISubviews", "UIView", "UIViewControllers")

SCHEMA = "path string, object int, class_name string, key string, ordinal int, kind string, number double, text string, target int, error string"
_ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[c.split()[1]]) for c in SCHEMA.split(", ")])


class Bytes:
    """A cursor over one table; it may not leave it, and has to end where the table ends."""

    def __init__(self, data: bytes, at: int, end: int):
        self.data, self.at, self.end = data, at, end

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise ValueError("truncated")
        self.at += n
        return self.data[self.at - n : self.at]

    def varint(self) -> int:
        """Groups of seven bits, the lowest first; the last one carries the high bit."""
        value = 0
        for shift in range(0, 35, 7):
            byte = self.take(1)[0]
            if shift == 28 and byte & 0x70:
                raise ValueError("number_too_large")
            value |= (byte & 0x7F) << shift
            if byte & 0x80:
                return value
        raise ValueError("number_too_long")

    def done(self) -> None:
        if self.at != self.end:
            raise ValueError("table_size")


def readable(raw: bytes) -> str | None:
    """Bytes as text by the first encoding that gives nothing but printable characters; None if none does."""
    raw = raw.removesuffix(b"\0")
    for encoding in ("utf-8", "utf-16", "utf-16-le", "utf-16-be"):
        try:
            text = raw.decode(encoding)
        except UnicodeError:
            continue
        if text and all(c.isprintable() or c in "\r\n\t" for c in text):
            return text
    return None if raw else ""


def _value(cursor: Bytes, kind: int, objects: int) -> dict:
    if kind in NUMBERS:
        number = struct.unpack("<" + NUMBERS[kind], cursor.take(struct.calcsize("<" + NUMBERS[kind])))[0]
        if not math.isfinite(number):
            raise ValueError("number_not_finite")
        return {"kind": "number", "number": float(number)}
    if kind in (4, 5):
        return {"kind": "boolean", "number": float(kind == 5)}
    if kind == 8:
        raw = cursor.take(cursor.varint())
        return {"kind": "bytes", "text": readable(raw) if len(raw) <= MOST_TEXT else None}
    if kind == 9:
        return {"kind": "null"}
    if kind == 10:
        target = int.from_bytes(cursor.take(4), "little")
        if target >= objects:
            raise ValueError("reference_range")
        return {"kind": "reference", "target": target}
    raise ValueError("value_kind")


def compiled(data: bytes) -> list[dict]:
    """Rows of a compiled archive: four tables (objects, keys, values, classes), each exactly as long as said."""
    if len(data) < HEADER or not data.startswith(MAGIC):
        raise ValueError("header")
    version, _, *pairs = struct.unpack_from("<10I", data, len(MAGIC))
    counts, starts = pairs[0::2], pairs[1::2]
    if version != 1:
        raise ValueError("version")
    if max(counts) > MOST_ENTRIES:
        raise ValueError("too_many_entries")
    if starts[0] != HEADER or sorted(starts) != starts or starts[-1] > len(data):
        raise ValueError("table_offsets")
    at = {name: Bytes(data, a, b) for name, a, b in zip(("objects", "keys", "values", "classes"), starts, [*starts[1:], len(data)], strict=True)}
    n_objects, n_keys, n_values, n_classes = counts
    objects = [(at["objects"].varint(), at["objects"].varint(), at["objects"].varint()) for _ in range(n_objects)]
    keys = [at["keys"].take(at["keys"].varint()).decode() for _ in range(n_keys)]
    values = []
    for _ in range(n_values):
        key, kind = at["values"].varint(), at["values"].take(1)[0]
        if key >= n_keys:
            raise ValueError("key_range")
        values.append((keys[key], _value(at["values"], kind, n_objects)))
    for name in ("objects", "keys", "values"):
        at[name].done()
    classes = []
    for _ in range(n_classes):
        length, fallbacks = at["classes"].varint(), at["classes"].varint()
        at["classes"].take(4 * fallbacks)
        raw = at["classes"].take(length)
        if len(raw) < 2 or raw.find(b"\0") != len(raw) - 1:
            raise ValueError("class_name")
        classes.append(raw[:-1].decode())
    out = []
    for number, (kind, first, count) in enumerate(objects):
        if kind >= n_classes or first + count > n_values:
            raise ValueError("object_range")
        seen: dict[str, int] = {}
        for key, value in values[first : first + count]:
            if key == EMPTY_KEY and classes[kind] in CONTAINERS:
                key = "NS.objects"
            elif key in (EMPTY_KEY, "NS.bytes") and classes[kind] in TEXTS:
                key = "NS.string"
            out.append({"object": number, "class_name": classes[kind], "key": key, "ordinal": seen.setdefault(key, 0)} | value)
            seen[key] += 1
        if not count:
            out.append({"object": number, "class_name": classes[kind], "kind": "empty"})
    return out + ([{"key": EMPTY_KEY, "class_name": "$top", "ordinal": 0, "kind": "reference", "target": 0}] if objects else [])


def keyed(data: bytes) -> list[dict]:
    """Rows of a keyed archive, a property list of numbered objects."""
    try:
        document = plistlib.loads(data)
    except Exception as e:  # a damaged list can fail anywhere in the decoder
        raise ValueError("property_list") from e
    objects, top = (document.get("$objects"), document.get("$top")) if isinstance(document, dict) else (None, None)
    if not isinstance(objects, list) or not isinstance(top, dict):
        raise ValueError("no_keyed_archive")
    if len(objects) > MOST_ENTRIES:
        raise ValueError("too_many_entries")

    def class_of(item: dict) -> str | None:
        at = item.get("$class")
        record = objects[at.data] if isinstance(at, plistlib.UID) and at.data < len(objects) else None
        return record.get("$classname") if isinstance(record, dict) else None

    def scalar(v) -> dict:
        if isinstance(v, plistlib.UID):
            if v.data >= len(objects):
                raise ValueError("reference_range")
            there = objects[v.data]
            # a reference to a plain value is the value
            return {"kind": "reference", "target": v.data} if isinstance(there, dict) else {"kind": "null"} if there == "$null" else scalar(there)
        if isinstance(v, bool):
            return {"kind": "boolean", "number": float(v)}
        if isinstance(v, int | float):
            return {"kind": "number", "number": float(v)}
        return {"kind": "text" if isinstance(v, str) else "bytes", "text": v if isinstance(v, str) else readable(v) if isinstance(v, bytes) else None}

    out = []
    for number, item in enumerate(objects):
        if isinstance(item, dict) and "$class" in item:
            name, before = class_of(item), len(out)
            for key, value in item.items():
                for ordinal, v in enumerate(value if isinstance(value, list) else [value]) if key != "$class" else ():
                    out.append({"object": number, "class_name": name, "key": str(key), "ordinal": ordinal} | scalar(v))
            if len(out) == before:
                out.append({"object": number, "class_name": name, "kind": "empty"})
    return out + [{"class_name": "$top", "key": str(k), "ordinal": 0} | scalar(v) for k, v in sorted(top.items(), key=lambda p: str(p[0]))]


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.to_pylist():
            content = file["content"] or b""
            try:
                rows = [{"path": file["path"]} | r for r in (compiled if content.startswith(MAGIC) else keyed)(content)]
            except (ValueError, struct.error) as e:
                rows = [{"path": file["path"], "error": str(e) if isinstance(e, ValueError) and not isinstance(e, UnicodeError) else "text"}]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def values(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA for files (path, content); a file that is not accepted gives one row with its error."""
    return files.select("path", "content").mapInArrow(_decode, SCHEMA)


def identities(found: DataFrame) -> DataFrame:
    """(path, object, class_name, base, custom): swapped classes by what they stand for and by what they were."""
    field = lambda *keys: F.max(F.when(F.lower("key").isin(*(k.lower() for k in keys)), F.col("text")))
    rows = found.where("object is not null").groupBy("path", "object").agg(F.coalesce(F.max("class_name"), F.lit("UnknownArchiveClass")).alias("encoded"), field("UIClassName", "className").alias("custom"), field("UIOriginalClassName", "originalClassName").alias("original"))
    swapped = F.col("encoded").contains("ClassSwapper") & F.col("custom").isNotNull()
    plain = F.col("encoded").startswith("UI")
    return rows.select(
        "path", "object", F.when(swapped, F.col("custom")).otherwise(F.col("encoded")).alias("class_name"),
        F.when(swapped, F.col("original")).when(plain, F.col("encoded")).alias("base"), F.when(swapped, F.col("custom")).when(~plain, F.col("encoded")).alias("custom"),
    )


def references(found: DataFrame) -> DataFrame:
    """(path, object, key, target): references, those to containers replaced by what the containers hold, containers in containers included."""
    plain = found.where("kind = 'reference' and object is not null").select("path", "object", "key", "target")
    held = found.where(F.col("class_name").isin(*CONTAINERS)).select("path", F.col("object").alias("box")).distinct()
    node = lambda c: F.concat_ws("|", "path", F.col(c).cast("string"))
    inside = plain.where("key = 'NS.objects'").join(held, (plain["path"] == held["path"]) & (plain["object"] == held["box"]), "left_semi")
    reach = closure(inside.select(node("object").alias("a"), node("target").alias("b")), blocked=None)
    met = plain.join(held.select("path", F.col("box").alias("target")), ["path", "target"], "left_anti")
    through = plain.join(held.select("path", F.col("box").alias("target")), ["path", "target"], "left_semi").withColumn("a", node("target")).join(reach, "a")
    through = through.select("path", "object", "key", F.substring_index("b", "|", -1).cast("int").alias("target")).join(held.select("path", F.col("box").alias("target")), ["path", "target"], "left_anti")
    return met.select("path", "object", "key", "target").unionByName(through).distinct()


def view_tree(found: DataFrame, controllers: tuple[str, ...] = ()) -> DataFrame:
    """(path, object, class_name, base, custom, is_controller, parent, controller) of controllers and views.

    The parent is the smallest node that holds a node as a child; the controller is the first one, by number,
    that reaches it without passing another, a controller's own being itself.
    """
    keys = found.where("object is not null").groupBy("path", "object").agg(F.collect_set("key").alias("keys"))
    rows = identities(found).join(keys, ["path", "object"])
    named = lambda c: F.coalesce(F.col(c).isin(*controllers) | F.col(c).endswith("ViewController"), F.lit(False))
    is_controller = named("class_name") | named("base") | (F.array_contains("keys", "UIView") & F.exists("keys", lambda k: k.startswith("UI")))
    view = ~F.col("class_name").rlike(NO_NODES) & (F.col("class_name").rlike(NODE_STARTS) | F.arrays_overlap("keys", F.array(*map(F.lit, NODE_KEYS))))
    nodes = rows.withColumn("is_controller", is_controller).where(F.col("is_controller") | view).drop("keys")
    ends = nodes.select("path", F.col("object").alias("target"))
    starts = nodes.select("path", "object")
    edges = references(found).where(F.col("key").isin(*CHILD_KEYS) & (F.col("object") != F.col("target"))).join(starts, ["path", "object"], "left_semi").join(ends, ["path", "target"], "left_semi")
    parent = edges.groupBy("path", F.col("target").alias("object")).agg(F.min("object").alias("parent"))
    node = lambda c: F.concat_ws("|", "path", F.col(c).cast("string"))
    sources = nodes.where("is_controller").select(node("object").alias("a"))
    reach = closure(edges.select(node("object").alias("a"), node("target").alias("b")), sources=sources, blocked=sources)
    owner = reach.groupBy("b").agg(F.min(F.substring_index("a", "|", -1).cast("int")).alias("owner"))
    met = nodes.join(parent, ["path", "object"], "left").join(owner, node("object") == F.col("b"), "left")
    return met.select("path", "object", "class_name", "base", "custom", "is_controller", "parent", F.when(F.col("is_controller"), F.col("object")).otherwise(F.col("owner")).alias("controller"))


def connections(found: DataFrame) -> DataFrame:
    """(path, object, kind, source, destination, selector) of connection and segue objects."""
    rows = found.where(F.col("class_name").rlike("Connection|Segue") & F.col("object").isNotNull())
    first = lambda column, *keys: F.coalesce(*(F.min(F.when(F.lower("key") == k.lower(), F.col(column))) for k in keys))
    kind = F.when(F.col("class_name").contains("Outlet"), "outlet").when(F.col("class_name").rlike("Event|Action"), "action").otherwise("segue")
    return rows.groupBy("path", "object", kind.alias("kind")).agg(first("target", "UISource", "source").alias("source"), first("target", "UIDestination", "destination", "UIDestinationViewController").alias("destination"), first("text", "UIActionName", "selector").alias("selector"))
