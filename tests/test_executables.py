import struct

from quarryline.sources import executables


def thin(encrypted=0):
    segment = struct.pack("<II16s4I4I", 1, 56, b"__TEXT", 0x1000, 0x2000, 0, 0x800, 7, 5, 0, 0)
    name = b"/usr/lib/libSystem.B.dylib\0\0"
    library = struct.pack("<6I", 0xC, 24 + len(name), 24, 2, 0x10203, 1) + name
    secret = struct.pack("<5I", 0x21, 20, 0x100, 0x200, encrypted)
    body = segment + library + secret
    return struct.pack("<7I", 0xFEEDFACE, 12, 6, 2, 3, len(body), 0) + body


def test_commands_slices_and_addresses(spark):
    one = thin(1)
    fat = struct.pack(">II", 0xCAFEBABE, 1) + struct.pack(">5I", 12, 6, 28, len(one), 0) + one
    rows = [("thin", thin()), ("fat", fat), ("junk", b"junk"), ("cut", thin()[:60]), ("bad", struct.pack(">II", 0xCAFEBABE, 900))]
    found = executables.load_commands(spark.createDataFrame(rows, "path string, content binary"))
    by = {(r.path, r.kind): r for r in found.collect()}
    assert by["thin", "segment"].name == "__TEXT" and by["thin", "segment"].vm_start == 0x1000 and by["fat", "library"].name == "/usr/lib/libSystem.B.dylib"
    assert {r.path: r.error for r in found.where("error is not null").collect()} == {"junk": "magic", "cut": "command_bounds", "bad": "slice_count"}
    assert [r.path for r in executables.encrypted(found).collect()] == ["fat"]
    asked = spark.createDataFrame([("thin", 0, a) for a in (0xFFF, 0x1000, 0x1010, 0x1900, 0x4000)], "path string, slice int, address long")
    assert {r.address: r.offset for r in executables.file_offset(asked, found).collect()} == {0xFFF: None, 0x1000: 0, 0x1010: 0x10, 0x1900: None, 0x4000: None}
