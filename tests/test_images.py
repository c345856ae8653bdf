import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from quarryline.sources import archives, images, metadata, pictures


class Builder:
    """A 32-bit little-endian slice with one segment, whose file and memory places agree."""

    def __init__(self, base=0x1000):
        self.base, self.body, self.sections = base, bytearray(), []
        self.head = 2048

    def put(self, data):
        while len(self.body) % 4:
            self.body += b"\0"
        at = self.base + self.head + len(self.body)
        self.body += data
        return at

    def text(self, s):
        return self.put(s.encode() + b"\0")

    def words(self, *values):
        return self.put(struct.pack(f"<{len(values)}I", *(v & 0xFFFFFFFF for v in values)))

    def section(self, name, data, segment="__DATA"):
        self.sections.append([name, segment, self.put(data), len(data), 0, 0])
        return self.sections[-1]

    def build(self, symbols=(), relocations=()):
        strings, entries = bytearray(b"\0"), b""
        for name, kind, section, description, value in symbols:
            entries += struct.pack("<IBBHI", len(strings) if name else 0, kind, section, description, value)
            strings += name.encode() + b"\0"
        place = lambda address: address - self.base
        symbols_at, strings_at = self.put(entries), self.put(bytes(strings))
        dynamic_at = self.put(b"".join(struct.pack("<II", a, n | 0x08000000) for a, n in relocations))
        size = self.head + len(self.body)
        sections = b"".join(struct.pack("<16s16s9I", n.encode(), s.encode(), a, z, place(a), 0, r, c, 0, 0, 0) for n, s, a, z, r, c in self.sections)
        segment = struct.pack("<II16s8I", 1, 56 + len(sections), b"__DATA", self.base, size, 0, size, 7, 7, len(self.sections), 0) + sections
        table = struct.pack("<6I", 2, 24, place(symbols_at), len(symbols), place(strings_at), len(strings))
        dynamic = struct.pack("<20I", 0xB, 80, *([0] * 14), place(dynamic_at), len(relocations), 0, 0)
        commands = segment + table + dynamic
        head = struct.pack("<7I", 0xFEEDFACE, 12, 9, 2, 3, len(commands), 0) + commands
        assert len(head) <= self.head
        return head.ljust(self.head, b"\0") + bytes(self.body)


def files(spark, *contents):
    return spark.createDataFrame([(f"f{i}", bytearray(c)) for i, c in enumerate(contents)], "path string, content binary")


def sample():
    b = Builder()
    method = lambda *rows: b.words(12, len(rows), *(w for n, t, i in rows for w in (b.text(n), b.text(t), i)))
    base = b.words(0, b.text("Base"), 0, b.words(8, 1, b.text("ping"), b.text("v8@0:4")), 0, 0, 0, 0)
    more = b.words(0, b.text("More"), b.words(1, base, 0), 0, b.words(8, 1, b.text("make"), b.text("@8@0:4")), 0, 0, 0)
    ivars = b.words(20, 1, b.words(16), b.text("_count"), b.text("i"), 2, 4)
    properties = b.words(8, 1, b.text("count"), b.text("Ti,V_count"))
    ro = b.words(0, 4, 20, 0, b.text("Widget"), method(("tap:", "v12@0:4@8", 0x5001), ("count", "i8@0:4", 0x5100)), b.words(1, more, 0), ivars, 0, properties)
    meta = b.words(0, 0, 0, 0, b.words(1, 0, 0, 0, b.text("Widget"), method(("shared", "@8@0:4", 0x5200)), 0, 0, 0, 0))
    widget = b.words(meta, 0, 0, 0, ro)
    child = b.words(0, widget, 0, 0, b.words(0, 0, 8, 0, b.text("Child"), 0, 0, 0, 0, 0) | 1)
    category = b.words(b.text("Extra"), widget, method(("more", "v8@0:4", 0x5300)), 0, 0, 0)
    b.section("__objc_classlist", struct.pack("<3I", child, widget, widget))
    b.section("__objc_catlist", struct.pack("<I", category))
    b.section("__objc_methname", b"tap:\0extra:\0")
    symbols = [("_OBJC_CLASS_$_NSObject", 1, 0, 0x0140, 0), ("_printf", 1, 0, 0x0300, 0), ("_printf", 1, 0, 0x0500, 0), ("_main", 0x0F, 1, 0x80, 0x2000), ("_debug", 0x24, 1, 0, 0x2000), ("", 1, 0, 0, 0), ("_local", 0x0E, 1, 0, 0x2400)]
    return b.build(symbols, [(widget + 4, 1), (widget + 4, 0)]), widget


def test_symbols_and_relocations(spark):
    content, widget = sample()
    given = files(spark, content, b"nothing", content[:-40])
    rows = images.symbol_rows(given)
    assert {(r.path, r.error) for r in rows.where("error is not null").collect()} == {("f1", "magic"), ("f2", "string_bounds")}
    good = rows.where("path = 'f0'")
    assert {(r.name, r.weak, r.ordinal) for r in images.imports(good).collect()} == {("_OBJC_CLASS_$_NSObject", True, 1), ("_printf", False, 3)}
    assert {(r.name, r.address, r.weak) for r in images.exports(good).collect()} == {("_main", 0x2000, True)}
    assert {r.name for r in images.defined_symbols(good).collect()} == {"_main", "_local"}
    assert [(r.address, r.name) for r in images.relocated(given.where("path = 'f0'"), good).collect()] == [(widget + 4, "_OBJC_CLASS_$_NSObject")]


def test_reads_at_addresses():
    image = images.Image(sample()[0])
    assert image.place(0x1000) == 0 and image.place(0x10) is None and image.pointer(0x1000) == 0xFEEDFACE
    assert image.text(0) is None and image.at("Q", 0x1000 + len(image.data) - 4) is None


def test_metadata(spark):
    content, widget = sample()
    given = files(spark, content)
    found = metadata.records(given).persist()
    assert found.where("record = 'error'").count() == 0
    assert {(r.name, r.superclass, r.source) for r in metadata.classes(found, given).collect()} == {("Widget", "NSObject", "relocation"), ("Child", "Widget", "pointer")}
    assert {(r.exact_name, r.implementation) for r in metadata.methods(found).collect()} == {("-[Widget tap:]", 0x5001), ("-[Widget count]", 0x5100), ("+[Widget shared]", 0x5200), ("-[Widget(Extra) more]", 0x5300)}
    assert [(r.name, r.encoding, r.target, r.number) for r in found.where("record = 'ivar'").collect()] == [("_count", "i", 16, 4)]
    assert [r.encoding for r in found.where("record = 'property'").collect()] == ["Ti,V_count"]
    assert {(r.member, r.own) for r in metadata.protocol_methods(found).collect()} == {("ping", True), ("ping", False), ("make", True)}
    assert {r.name for r in found.where("record = 'selector'").collect()} == {"tap:", "extra:"}
    lost = metadata.records(files(spark, content.replace(struct.pack("<2I", widget, widget), struct.pack("<2I", widget, 0xFFFF0))))
    assert [r.address for r in lost.where("record = 'error'").collect()] == [0xFFFF0]


def varint(n):
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F]), n >> 7
    return out + bytes([n | 0x80])


def compiled():
    classes, keys = ["UIView", "NSArray", "MyViewController", "UIRuntimeEventConnection", "NSString"], ["UIView", "UINibEncoderEmptyKey", "UISubviews", "UISource", "UIDestination", "UIActionName", "UIAlpha", "NS.bytes", "UILabel"]
    ref = lambda n: bytes([10]) + struct.pack("<I", n)
    objects = [
        (2, [(0, ref(1)), (8, ref(5))]), (0, [(2, ref(2)), (6, bytes([6]) + struct.pack("<f", 0.5))]), (1, [(1, ref(3)), (1, ref(6))]), (0, []), (3, [(3, ref(3)), (4, ref(0)), (5, bytes([8]) + varint(4) + b"tap:")]),
        (4, [(7, bytes([8]) + varint(3) + b"hi\0")]), (0, [(6, bytes([5]))]),
    ]
    values = [v for _, vs in objects for v in vs]
    at, table = 0, b""
    for kind, vs in objects:
        table += varint(kind) + varint(at) + varint(len(vs))
        at += len(vs)
    parts = [table, b"".join(varint(len(k)) + k.encode() for k in keys), b"".join(varint(k) + v for k, v in values), b"".join(varint(len(c) + 1) + varint(0) + c.encode() + b"\0" for c in classes)]
    starts = [50 + sum(map(len, parts[:i])) for i in range(4)]
    counts = [len(objects), len(keys), len(values), len(classes)]
    head = struct.pack("<10I", 1, 9, *(x for pair in zip(counts, starts, strict=True) for x in pair))
    return b"NIBArchive" + head + b"".join(parts)


def test_compiled_archives(spark):
    good = compiled()
    found = archives.values(files(spark, good, good[:-9], b"NIBArchive" + b"\0" * 40)).persist()
    assert {r.path: r.error for r in found.where("error is not null").collect()} == {"f1": "truncated", "f2": "version"}
    good_rows = found.where("path = 'f0'")
    assert {(r.object, r.text) for r in good_rows.where("text is not null").collect()} == {(4, "tap:"), (5, "hi")}
    assert good_rows.where("key = 'UIAlpha'").orderBy("object").first().number == 0.5
    assert {(r.object, r.parent, r.controller, r.is_controller) for r in archives.view_tree(good_rows).collect()} == {(0, None, 0, True), (1, 0, 0, False), (3, 1, 0, False), (6, 1, 0, False)}
    assert [(r.kind, r.source, r.destination, r.selector) for r in archives.connections(good_rows).collect()] == [("action", 3, 0, "tap:")]


def test_keyed_archives(spark):
    import plistlib

    U = plistlib.UID
    objects = ["$null", {"$class": U(6), "UIView": U(2)}, {"$class": U(7), "UISubviews": U(3), "UIFrame": "{{0, 0}, {3, 4}}"}, {"$class": U(8), "NS.objects": [U(4)]}, {"$class": U(7), "UIHidden": True, "name": U(5)}, "label", {"$classname": "HomeViewController"}, {"$classname": "UIView"}, {"$classname": "NSArray"}]
    found = archives.values(files(spark, plistlib.dumps({"$objects": objects, "$top": {"root": U(1)}}, fmt=plistlib.FMT_BINARY), b"bplist00junk"))
    assert [r.error for r in found.where("error is not null").collect()] == ["property_list"]
    rows = found.where("error is null").persist()
    assert {(r.object, r.parent, r.controller) for r in archives.view_tree(rows).collect()} == {(1, None, 1), (2, 1, 1), (4, 2, 1)}
    assert rows.where("object = 4 and key = 'name'").first().text == "label"


def png(pixels, filters, optimised):
    height, width, _ = pixels.shape
    raw, above = b"", np.zeros((width + 1, 4), int)
    for row, kind in zip(pixels.astype(int), filters, strict=True):
        here = np.vstack([np.zeros((1, 4), int), row])
        left, up, corner = here[:-1], above[1:], above[:-1]
        if kind == 4:
            p = left + up - corner
            a, b, c = abs(p - left), abs(p - up), abs(p - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        else:
            guess = [0, left, up, (left + up) // 2][kind]
        raw += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = here
    squeeze = zlib.compressobj(wbits=-15 if optimised else 15)
    body = squeeze.compress(raw) + squeeze.flush()
    chunk = pictures.chunk
    return pictures.SIGNATURE + (chunk(b"CgBI", b"\x50\0\x20\x06") if optimised else b"") + chunk(b"IHDR", struct.pack(">II5B", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def test_pictures(spark):
    rng = np.random.default_rng(2)
    bgra = rng.integers(0, 256, (5, 7, 4))
    bgra[..., 3] = rng.choice([0, 10, 128, 255], (5, 7))
    bgra[..., :3] = np.where(bgra[..., 3:] > 0, np.minimum(bgra[..., :3], bgra[..., 3:]), bgra[..., :3])
    optimised, plain = png(bgra, [0, 1, 2, 3, 4], True), png(bgra, [4, 3, 2, 1, 0], False)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x02\x00\x03" + b"\0" * 8
    rows = {r.path: r for r in pictures.pictures(files(spark, optimised, plain, jpeg, plain[:-5], plain.replace(b"IDAT", b"IDAX"))).collect()}
    assert bytes(rows["f1"].content) == plain and not rows["f1"].optimised and (rows["f1"].width, rows["f1"].height) == (7, 5)
    assert rows["f0"].optimised and (rows["f2"].width, rows["f2"].height) == (3, 2) and rows["f3"].error == "no_end" and rows["f4"].error == "checksum"
    parts = dict(pictures.chunks(bytes(rows["f0"].content)))
    got = pictures.unfiltered(zlib.decompress(parts[b"IDAT"]), 7, 5)
    for y in range(5):
        for x in range(7):
            b, g, r, a = bgra[y, x].tolist()
            want = [min(255, (v * 255 + a // 2) // a) for v in (r, g, b)] if a else [r, g, b]
            assert got[y, x].tolist() == [*want, a]


def test_empty_files(spark):
    none = files(spark, b"")
    assert images.symbol_rows(none).first().error and archives.values(none).first().error and pictures.pictures(none).first().error
    assert metadata.records(none).select(F.max("error")).first()[0]
