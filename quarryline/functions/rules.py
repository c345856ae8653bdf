"""Ordered rules as column expressions: what a name, a field, an edge or a set of candidates is taken for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of a dispatching runtime symbol, once a name is reduced to lower-case letters and digits.
SEND, LOOKUP = "objcmsgsend", "objcmsglookup"
#: Prefixes of imported symbols with their kinds, and the one of external thunks.
IMPORT_KINDS = {"_OBJC_CLASS_$_": "objective_c_class", "_OBJC_METACLASS_$_": "objective_c_metaclass", "_OBJC_PROTOCOL_$_": "objective_c_protocol"}
EXTERNAL = "<EXTERNAL>::"
#: Work items that effects of a kind call for; others are dependencies on the platform.
ITEM_KINDS = {
    "state_read": "state", "state_write": "state", "navigation": "navigation", "ui_update": "component", "persistence_read": "persistence", "persistence_write": "persistence", "persistence_access": "persistence",
    "network_request": "networking", "notification_post": "platform_dependency", "timer_schedule": "platform_dependency", "platform_api": "platform_dependency",
}
#: Bytes of C scalar types; those of pointer size are apart.
WIDTHS = {
    "bool": 1, "boolean": 1, "byte": 1, "char": 1, "signed char": 1, "unsigned char": 1, "undefined1": 1, "short": 2, "short int": 2, "unsigned short": 2, "ushort": 2, "undefined2": 2,
    "int": 4, "unsigned": 4, "unsigned int": 4, "uint": 4, "float": 4, "undefined4": 4, "bool32": 4, "undefined8": 8, "long long": 8, "unsigned long long": 8, "double": 8,
}
POINTER_SIZED = ("long", "unsigned long", "ulong", "size_t", "intptr_t", "uintptr_t")
#: What a field's last name ends in, by role, and whole names of the text role.
ROLE_ENDS = {"image": ("image",), "text": ("text", "title", "placeholder"), "color": ("color",)}
TEXT_NAMES = ("accessibilitylabel", "prompt")


def _plain(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def dispatching(*names: Column) -> Column:
    """The first of the names that calls the message runtime, else NULL."""
    return F.coalesce(*(F.when(_plain(n).contains(SEND) | _plain(n).contains(LOOKUP), n) for n in names))


def runtime_variant(*names: Column) -> Column:
    """(variant, is_super, structure_return, floating_return) of the first dispatching name, NULL without one."""
    name = _plain(dispatching(*names))
    stret = name.contains("stret")
    ends = lambda base: F.when(stret, base + "_stret").otherwise(base)
    variant = (
        F.when(name.contains(SEND + "super2"), ends("objc_msgSendSuper2")).when(name.contains(SEND + "super"), ends("objc_msgSendSuper")).when(name.contains(SEND + "stret"), "objc_msgSend_stret")
        .when(name.contains(SEND + "fpret"), "objc_msgSend_fpret").when(name.contains(SEND), "objc_msgSend").when(name.contains(LOOKUP + "super"), "objc_msgLookupSuper").otherwise("objc_msgLookup")
    )
    return F.when(name.isNotNull(), F.struct(variant.alias("variant"), name.contains("super").alias("is_super"), stret.alias("structure_return"), name.contains("fpret").alias("floating_return")))


def edge_state(dispatch: Column, indirect: Column, target_known: Column) -> Column:
    """(semantic, reason): whether a call's target is proven, and else why it is not."""
    semantic = target_known & ~dispatch & ~indirect
    reason = F.when(dispatch, "dynamic_dispatch").when(indirect & ~target_known, "indirect").when(~target_known, "unknown_function")
    return F.struct(semantic.alias("semantic"), reason.alias("reason"))


def function_class(has_methods: Column, external: Column, thunk: Column) -> Column:
    """C7."""
    return F.when(has_methods, "objective_c_method").when(external, "external_function").when(thunk, "thunk").otherwise("native_internal_function")


def field_role(path: Column) -> Column:
    """Image, text, font or color by the last name of a path like a.b[0], else NULL."""
    leaf = F.regexp_replace(F.lower(F.element_at(F.split(path, r"[.\[]"), -1)), "[^a-z]", "")
    ends = lambda role: reduce(lambda a, b: a | b, (leaf.endswith(e) for e in ROLE_ENDS[role]))
    return F.when(ends("image"), "image").when(ends("text") | leaf.isin(*TEXT_NAMES), "text").when(leaf.contains("font"), "font").when(ends("color"), "color")


def item_kind(effect: Column) -> Column:
    """C16."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in ITEM_KINDS.items() for x in pair)), effect)


def effect_kind(catalogued: Column, categories: Column, status: Column) -> Column:
    """C14: the catalogue's kind, else one by category, else by status, else NULL."""
    return F.coalesce(
        catalogued,
        F.when(F.array_contains(categories, "networking"), "network_request").when(F.array_contains(categories, "persistence"), "persistence_access").when(status.isin("external_exact", "external_candidate"), "platform_api"),
    )


def import_kind(symbol: Column) -> Column:
    """C17: (kind, class_name) of an imported symbol; protocols and plain symbols name no class."""
    kind = reduce(lambda out, p: out.when(symbol.startswith(p[0]), p[1]), IMPORT_KINDS.items(), F.when(F.lit(False), "")).otherwise("unknown")
    name = reduce(lambda out, p: out.when(symbol.startswith(p), F.substr(symbol, F.lit(len(p) + 1))), list(IMPORT_KINDS)[:2], F.when(F.lit(False), ""))
    return F.struct(kind.alias("kind"), name.alias("class_name"))


def external_symbol(thunk: Column) -> Column:
    """The name behind an external thunk, else NULL."""
    return F.when(thunk.startswith(EXTERNAL), F.substr(thunk, F.lit(len(EXTERNAL) + 1)))


def explicit_class(text: Column) -> Column:
    """The class that a receiver expression names outright, else NULL."""
    name = F.regexp_extract(F.trim(text), r"^&?\s*(?:objc::class_t::|_OBJC_CLASS___|_OBJC_CLASS_\$_)([A-Za-z_$][A-Za-z0-9_$]*)$", 1)
    return F.when(name != "", name)


def screen_class(n_screens: Column, only_exact: Column) -> Column:
    """None is unresolved, one that is exact itself is exact, all else is a set of candidates."""
    return F.when(n_screens == 0, "unresolved").when((n_screens == 1) & only_exact, "exact").otherwise("candidate_set")


def platform_status(n_external: Column, proven: Column, n_local: Column) -> Column:
    """(status, classification)."""
    status = F.when(n_external > 0, F.when((n_external == 1) & proven, "external_exact").otherwise("external_candidate")).when(n_local > 0, "application_local").otherwise("unresolved")
    return F.struct(status.alias("status"), F.when(status == "external_candidate", "candidate_set").when(status == "unresolved", "unresolved").otherwise("exact").alias("classification"))


def type_class(n_types: Column, hypothesis: Column) -> Column:
    """K8: exact for one type that is no hypothesis, whatever its confidence."""
    return F.when(n_types == 0, "unresolved").when((n_types > 1) | hypothesis, "candidate_set").otherwise("exact")


def native_class(n_atoms: Column, hypothesis: Column, confidence: Column) -> Column:
    """Exact for one atom that is no hypothesis and of high confidence (3)."""
    return F.when(n_atoms == 0, "unresolved").when((n_atoms == 1) & ~hypothesis & (confidence == 3), "exact").otherwise("candidate_set")


def native_type(text: Column, pointer: int) -> Column:
    """(kind, name, depth, width) of a C type; NULL for none, void and unknown ones."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"\b(?:const|volatile|register|restrict|struct|class)\b", ""), r"\s+", " "))
    depth = F.length(F.regexp_replace(bare, r"[^*]", ""))
    base = F.trim(F.regexp_replace(bare, r"\s*\*+\s*$", ""))
    width = F.coalesce(F.when(F.lower(base).isin(*POINTER_SIZED), pointer), F.try_element_at(F.create_map(*(F.lit(x) for pair in WIDTHS.items() for x in pair)), F.lower(base)))
    of = lambda kind, name, d, w: F.struct(F.lit(kind).alias("kind"), name.alias("name"), d.cast("int").alias("depth"), w.cast("int").alias("width"))
    size, one, none = F.lit(pointer), F.lit(1), F.lit(0)
    return (
        F.when((base == "") | base.isNull() | (base.isin("unknown", "undefined", "void") & (depth == 0)), None).when((base == "code"), of("function_pointer", F.lit("code *"), F.greatest(depth, one), size))
        .when(depth > 0, of("native_pointer", bare, depth, size)).when(width.isNotNull(), of("scalar", base, none, width)).when(base == "SEL", of("selector", base, none, size))
        .when(base == "Class", of("objective_c_class_object", base, one, size)).when(F.lower(base) == "id", of("objective_c_id", F.lit("id"), one, size)).otherwise(of("named_native_type", base, none, F.lit(None)))
    )


def access_kind(line: Column, token: Column) -> Column:
    """Write if the token stands left of the line's first plain assignment, read if elsewhere, NULL if nowhere."""
    left = F.regexp_extract(line, r"^(.*?)(?<![=!<>+\-*/%&|^])=(?!=)", 1)
    return F.when(F.contains(line, token), F.when(F.contains(left, token), "write").otherwise("read"))


def literal_text(argument: Column) -> Column:
    """The text of a quoted argument, the usual escapes undone; NULL for anything else."""
    inner = F.regexp_extract(argument, r'(?s)^\s*"((?:\\.|[^"\\])*+)"\s*$', 1)
    parts = F.regexp_extract_all(inner, F.lit(r"(?s)\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\.|[^\\]+"), F.lit(0))
    simple = F.create_map(*(F.lit(x) for pair in {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}.items() for x in pair))
    code = lambda p: F.conv(F.substr(p, F.lit(3)), 16, 10).cast("int")
    one = lambda p: F.when(~p.startswith("\\"), p).when(p.rlike(r"^\\[xu][0-9A-Fa-f]"), F.decode(F.unhex(F.lpad(F.hex(code(p)), 4, "0")), "UTF-16BE")).otherwise(F.coalesce(F.try_element_at(simple, F.substr(p, F.lit(2))), F.substr(p, F.lit(2))))
    return F.when(argument.rlike(r'(?s)^\s*"(?:\\.|[^"\\])*+"\s*$'), F.array_join(F.transform(parts, one), ""))


def argument_at(arguments: Column, place: Column) -> Column:
    """(text, number): the quoted text or the plain number that stands at a place of an argument list."""
    one = F.try_element_at(arguments, (place + 1).cast("int"))
    safe = F.when(place >= 0, one)
    return F.struct(literal_text(safe).alias("text"), F.when(F.trim(safe).rlike(r"^[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$"), F.trim(safe)).alias("number"))


def variable_of(expression: Column, known: Column) -> Column:
    """The expression if it is a known variable but for casts and signs of reference, else the one known name in it."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(expression), r"^(?:\([A-Za-z_$][A-Za-z0-9_$ :<>*]*\)\s*)+", ""), r"^[&*\s]+", "")
    names = F.array_distinct(F.filter(F.regexp_extract_all(expression, F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0)), lambda x: F.array_contains(known, x)))
    return F.when(F.array_contains(known, F.trim(bare)), F.trim(bare)).when(F.size(names) == 1, names[0])


def rectangle(text: Column) -> Column:
    """(x, y, width, height), the last four numbers of a text; NULL with fewer, or with one beyond 1e9."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"), F.lit(0)), lambda x: x.try_cast("double"))
    last = F.slice(numbers, -4, 4)
    return F.when((F.size(numbers) >= 4) & F.forall(last, lambda x: F.abs(x) <= 1e9), F.struct(*(F.get(last, F.lit(i)).alias(n) for i, n in enumerate(("x", "y", "width", "height")))))


def canonical_address(address: Column, architecture: Column) -> Column:
    """(address, flagged): the mode flag in the lowest bit of 32-bit ARM addresses is cleared and told apart."""
    lowered = F.lower(architecture)
    flagged = lowered.startswith("arm") & ~lowered.contains("64") & (address.bitwiseAND(F.lit(1)) == 1)
    return F.struct(F.when(flagged, address.bitwiseAND(F.lit(-2))).otherwise(address).alias("address"), flagged.alias("flagged"))


def address_order(text: Column) -> Column:
    """G1: a sort key: hexadecimal addresses by value first, then anything else by its text, NULL last as the empty text."""
    valid = F.coalesce(text.rlike(r"^0[xX][0-9a-fA-F]{1,16}$"), F.lit(False))
    digits = F.lpad(F.lower(F.substr(text, F.lit(3))), 16, "0")
    return F.struct(F.when(valid, 0).otherwise(1).alias("other"), F.when(valid, digits).otherwise(F.coalesce(text, F.lit(""))).alias("key"))


def encoding_of(symbol: Column, prefix: str) -> Column:
    """The encoded type behind a mangled special symbol (type info, vtable), NULL for other symbols."""
    marker = f"__Z{prefix}"
    return F.when(symbol.startswith(marker) & (F.length(symbol) > len(marker)), F.substr(symbol, F.lit(len(marker) + 1)))


def attribute_value(attributes: Column, names: tuple[str, ...]) -> Column:
    """The value of the first of the names that is a key, whatever its case, else of the first key in order that holds one of them."""
    lowered = F.map_from_entries(F.transform(F.map_entries(attributes), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    exact = F.coalesce(*(F.try_element_at(lowered, F.lit(n.lower())) for n in names))
    near = F.array_sort(F.filter(F.map_keys(lowered), lambda k: reduce(lambda a, b: a | b, (k.contains(n.lower()) for n in names))))
    return F.coalesce(exact, F.try_element_at(lowered, F.get(near, F.lit(0))))


def identity_of(*fields: Column) -> Column:
    """The first identity that a candidate has."""
    return F.coalesce(*(F.when(f != "", f) for f in fields))


def document_link(artifact: Column, pointer: Column, record: Column, classification: Column, digest: Column) -> Column:
    """Where a record of an artifact stands."""
    return F.struct(
        F.lit("artifact_record").alias("kind"), artifact.alias("artifact"), F.concat(F.lit("analysis/"), artifact, F.lit(".json")).alias("path"), pointer.alias("pointer"), record.alias("record"),
        F.when(classification.isin("exact", "candidate_set", "unresolved"), classification).otherwise("unresolved").alias("classification"), digest.alias("sha256"),
    )
