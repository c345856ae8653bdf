"""Class metadata of executables as flat records, and the tables that follow from them.

Reading follows pointers inside one slice and stays in Python; a record names its owner by address. Which class
is whose superclass, what a category extends and which protocols are inherited are joins over the records.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators.hierarchy import inherited
from quarryline.sources.images import Image, _signed, per_image, relocated, symbol_rows

#: Most entries of a list, its flags, and prefixes of class symbols.
MOST, RELATIVE, ENTRY_SIZE = 200_000, 0x80000000, 0xFFFF
CLASS_SYMBOLS = ("_OBJC_CLASS_$_", "OBJC_CLASS_$_", ".objc_class_name_")
SCHEMA = "path string, slice int, record string, owner long, address long, name string, kind string, encoding string, target long, number long, required boolean, error string"


class Reader:
    """Records of one slice."""

    def __init__(self, image: Image):
        self.image, self.out = image, []
        self.one = "Q" if image.wide else "I"
        self.protocols: list[int] = []
        self.seen: set[int] = set()

    def add(self, record: str, owner: int | None, **values) -> None:
        long = lambda v: None if v is None else _signed(v)
        self.out.append({"record": record, "owner": long(owner)} | {k: long(v) if k in ("address", "target", "number") else v for k, v in values.items()})

    def wrong(self, what: str, address: int | None = None) -> None:
        self.add("error", None, address=address, error=what)

    def pointers(self, section: str) -> list[int]:
        """The distinct pointers of the sections of a name, in order."""
        out: set[int] = set()
        for s in self.image.sections:
            if s.name == section:
                n = s.size // self.image.word
                if s.size % self.image.word:
                    self.wrong("section_alignment", s.address)
                if n > MOST:
                    self.wrong("section_count", s.address)
                else:
                    out |= set(self.image.take(f"{n}{self.one}", s.offset))
        return sorted(out - {0})

    def entries(self, address: int, form: str, what: str, relative: str | None = None) -> Iterator[tuple[int, tuple, bool]]:
        """(place, values, relative) of a counted list with a header of entry size and count."""
        head = self.image.at("II", address) if address else None
        if not head:
            if address:
                self.wrong(f"{what}_list", address)
            return
        size, count = head
        if count > MOST:
            self.wrong(f"{what}_count", address)
            return
        near = bool(relative and size & RELATIVE)
        form = relative if near else form
        least = 12 if near else sum(self.image.word if c == self.one else 4 for c in form)
        for i in range(count):
            place = address + 8 + i * max(size & ENTRY_SIZE, least)
            values = self.image.at(form, place)
            if values is None:
                self.wrong(what, place)
                return
            yield place, values, near

    def methods(self, owner: int, address: int, kind: str) -> None:
        for place, (name, types, code), near in self.entries(address, self.one * 3, "method", "iii"):
            if near:  # offsets from each field; the name may be reached over a reference
                name, types, code = place + name, place + 4 + types, place + 8 + code
            text = self.image.text(name) or (self.image.text(self.image.pointer(name)) if near else None)
            if text:
                self.add("method", owner, address=place, name=text, kind=kind, encoding=self.image.text(types), target=code)
            else:
                self.wrong("method_name", place)

    def described(self, owner: int, address: int, kind: str, required: bool) -> None:
        for place, (name, types), _ in self.entries(address, self.one * 2, "description"):
            if text := self.image.text(name):
                self.add("description", owner, address=place, name=text, kind=kind, encoding=self.image.text(types), required=required)

    def fields(self, owner: int, address: int) -> None:
        for place, (offset, name, types, _, size), _ in self.entries(address, self.one * 3 + "II", "ivar"):
            if text := self.image.text(name):
                at = self.image.at("I", offset) if offset else None
                self.add("ivar", owner, address=place, name=text, encoding=self.image.text(types), target=at[0] if at else None, number=size)

    def properties(self, owner: int, address: int) -> None:
        for place, (name, attributes), _ in self.entries(address, self.one * 2, "property"):
            if text := self.image.text(name):
                self.add("property", owner, address=place, name=text, encoding=self.image.text(attributes))

    def conforms(self, owner: int, address: int) -> None:
        """The protocols of a list without an entry size; each is read once, later, in turn."""
        count = self.image.pointer(address) if address else None
        if count is None:
            return
        if count > MOST:
            self.wrong("protocol_count", address)
            return
        for i in range(count):
            if target := self.image.pointer(address + self.image.word * (i + 1)):
                self.add("conforms", owner, target=target)
                self.protocols.append(target)

    def half(self, address: int) -> tuple | None:
        """(superclass, isa, read-only part) of a class record or its metaclass."""
        found = self.image.at(self.one * 5, address)
        if found is None:
            self.wrong("class", address)
            return None
        part = found[4] & ~(7 if self.image.wide else 3)  # low bits are flags
        fixed = self.image.at(("4I" if self.image.wide else "3I") + "7" + self.one, part)
        return (found[1], found[0], fixed[:3], fixed[-7:]) if fixed and self.image.text(fixed[-6]) else self.wrong("class_part", address)

    def classes(self) -> None:
        for address in self.pointers("__objc_classlist"):
            if not (own := self.half(address)):
                continue
            above, isa, (flags, start, size), (_, name, methods, protocols, ivars, _, properties) = own
            self.add("class", None, address=address, name=self.image.text(name), target=above, number=size, kind=str(flags), encoding=str(start))
            self.methods(address, methods, "instance")
            self.conforms(address, protocols)
            self.fields(address, ivars)
            self.properties(address, properties)
            if isa and (meta := self.half(isa)):
                self.methods(address, meta[3][2], "class")

    def categories(self) -> None:
        for address in self.pointers("__objc_catlist"):
            found = self.image.at(self.one * 6, address)
            name = self.image.text(found[0]) if found else None
            if not name:
                self.wrong("category", address)
                continue
            self.add("category", None, address=address, name=name, target=found[1])
            self.methods(address, found[2], "instance")
            self.methods(address, found[3], "class")
            self.conforms(address, found[4])
            self.properties(address, found[5])

    def read(self) -> list[dict]:
        self.add("image", None, number=self.image.word)
        self.classes()
        self.categories()
        self.protocols += self.pointers("__objc_protolist")
        while self.protocols:  # inheritance may be cyclic: each address once
            address = self.protocols.pop()
            if address in self.seen:
                continue
            self.seen.add(address)
            found = self.image.at(self.one * 8, address)
            name = self.image.text(found[1]) if found else None
            if not name:
                self.wrong("protocol", address)
                continue
            self.add("protocol", None, address=address, name=name)
            self.conforms(address, found[2])
            for list_, kind, required in ((3, "instance", True), (4, "class", True), (5, "instance", False), (6, "class", False)):
                self.described(address, found[list_], kind, required)
            self.properties(address, found[7])
        for pointer in self.pointers("__objc_selrefs"):
            if text := self.image.text(pointer):
                self.add("selector", None, name=text)
        for s in self.image.sections:
            if s.name == "__objc_methname":
                for raw in set(self.image.data[s.offset : s.offset + s.size].split(b"\0")) - {b""}:
                    self.add("selector", None, name=raw.decode("utf-8", "replace"))
        if any(s.segment == "__OBJC" for s in self.image.sections):
            self.wrong("legacy_runtime")
        return self.out


def records(files: DataFrame) -> DataFrame:
    """Flat records of SCHEMA for files (path, content); errors are records of their own."""
    return per_image(files, SCHEMA, lambda image: Reader(image).read())


def class_symbol(name):
    """The class behind a class symbol, else NULL."""
    out = F.when(F.lit(False), "")
    for p in CLASS_SYMBOLS:
        out = out.when(name.startswith(p), F.substr(name, F.lit(len(p) + 1)))
    return out


def classes(found: DataFrame, files: DataFrame) -> DataFrame:
    """(path, slice, address, name, superclass, source): by pointer, else by the relocation of the field, else by symbol."""
    own = found.where("record = 'class'").select("path", "slice", "address", "name", "target")
    symbols = symbol_rows(files)
    by_pointer = own.select("path", "slice", F.col("address").alias("target"), F.col("name").alias("p"))
    moved = relocated(files, symbols).select("path", "slice", F.col("address").alias("field"), class_symbol(F.col("name")).alias("r")).where("r is not null")
    by_symbol = symbols.where("error is null and value <> 0").select("path", "slice", F.col("value").alias("target"), class_symbol(F.col("name")).alias("s")).where("s is not null").groupBy("path", "slice", "target").agg(F.min("s").alias("s"))
    word = found.where("record = 'image'").select("path", "slice", F.col("number").alias("word"))
    met = own.join(word, ["path", "slice"]).withColumn("field", F.col("address") + F.col("word"))
    met = met.join(by_pointer, ["path", "slice", "target"], "left").join(by_symbol, ["path", "slice", "target"], "left").join(moved, ["path", "slice", "field"], "left")
    return met.select("path", "slice", "address", "name", F.coalesce("p", "r", "s").alias("superclass"), F.when(F.col("p").isNotNull(), "pointer").when(F.col("r").isNotNull(), "relocation").when(F.col("s").isNotNull(), "symbol").when(F.col("target") != 0, "unresolved").alias("source"))


def methods(found: DataFrame) -> DataFrame:
    """(path, slice, class_name, category, kind, selector, encoding, implementation, exact_name) of classes and categories."""
    rows = found.where("record = 'method'").select("path", "slice", "owner", "kind", F.col("name").alias("selector"), "encoding", F.col("target").alias("implementation"))
    holder = found.where("record in ('class', 'category')").select("path", "slice", F.col("address").alias("owner"), "record", "name", "target")
    extended = found.where("record = 'class'").select("path", "slice", F.col("address").alias("target"), F.col("name").alias("extended"))
    met = rows.join(holder.join(extended, ["path", "slice", "target"], "left"), ["path", "slice", "owner"])
    category = F.when(F.col("record") == "category", F.col("name"))
    name = F.when(category.isNull(), F.col("name")).otherwise(F.coalesce("extended", F.lit("UnknownClass")))
    met = met.select("path", "slice", name.alias("class_name"), category.alias("category"), "kind", "selector", "encoding", "implementation")
    shown = F.concat("class_name", F.coalesce(F.concat(F.lit("("), "category", F.lit(")")), F.lit("")))
    return met.withColumn("exact_name", F.concat(F.when(F.col("kind") == "class", "+[").otherwise("-["), shown, F.lit(" "), "selector", F.lit("]")))


def protocol_methods(found: DataFrame) -> DataFrame:
    """(node, member, own): selectors of each protocol and of all it inherits; nodes are path, slice and address."""
    node = lambda c: F.concat_ws("|", "path", "slice", c)
    protocols = found.where("record = 'protocol'").select(node("address").alias("node"))
    members = found.where("record = 'description'").select(node("owner").alias("node"), F.col("name").alias("member"))
    parents = found.where("record = 'conforms'").select(node("owner").alias("node"), node("target").alias("parent")).join(protocols, "node", "left_semi")
    return inherited(members, parents)

