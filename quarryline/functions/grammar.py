"""Small grammars that regular expressions cannot carry: type encodings, signatures, declarations, prefixed names."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.functions.text import matching_close, split_arguments

#: One-letter type codes of the Objective-C runtime.
CODES = {
    "c": "char", "i": "int", "s": "short", "l": "long", "q": "long long", "C": "unsigned char", "I": "unsigned int", "S": "unsigned short", "L": "unsigned long", "Q": "unsigned long long",
    "f": "float", "d": "double", "B": "bool", "v": "void", "*": "char *", "#": "Class", ":": "SEL", "?": "unknown",
}
QUALIFIERS = "rnNoORV"


def _one(text: str, at: int) -> tuple[str, int]:
    """(type, place after it) of the encoding that starts at a place."""
    while at < len(text) and text[at] in QUALIFIERS:
        at += 1
    if at >= len(text):
        raise ValueError("encoding ends early")
    c = text[at]
    if c == "@":
        if text[at + 1 : at + 2] == "?":
            return "block", at + 2
        if text[at + 1 : at + 2] == '"':
            end = text.index('"', at + 2)
            return text[at + 2 : end], end + 1
        return "id", at + 1
    if c == "^":
        inner, after = _one(text, at + 1)
        return f"{inner} *", after
    if c in "{(":
        depth, i = 0, at
        while i < len(text):
            depth += (text[i] in "{(") - (text[i] in "})")
            i += 1
            if not depth:
                name = re.match(r"[^=})]*", text[at + 1 : i - 1])[0]
                return f"{'struct' if c == '{' else 'union'} {name}".strip(), i
        raise ValueError("aggregate does not close")
    if c == "[":
        count = re.match(r"[0-9]*", text[at + 1 :])[0]
        inner, after = _one(text, at + 1 + len(count))
        if text[after : after + 1] != "]":
            raise ValueError("array does not close")
        return f"{inner}[{count}]", after + 1
    if c == "b":
        bits = re.match(r"[0-9]+", text[at + 1 :])
        if not bits:
            raise ValueError("bit field without width")
        return f"bits:{bits[0]}", at + 1 + len(bits[0])
    if c in CODES:
        return CODES[c], at + 1
    raise ValueError(f"unknown code {c}")


def encoded_types(text: str | None) -> list[str] | None:
    """The types of a method encoding, return type first, offsets skipped; None if it does not parse."""
    if not text:
        return None
    out, at = [], 0
    try:
        while at < len(text):
            one, at = _one(text, at)
            out.append(one)
            at += len(re.match(r"-?[0-9]*", text[at:])[0])
    except ValueError:
        return None
    return out


_DECLARED = re.compile(r"^(?P<type>(?:(?:const|struct|unsigned|signed|static)\s+)*[A-Za-z_]\w*(?:\s+(?:int|long|char|short))*[\s*]*?[\s*])(?P<name>[A-Za-z_]\w*)(?P<size>(?:\s*\[[^\]]*\])*)$")


def declaration(text: str) -> tuple[str, str] | None:
    """(type, name) of a declaration without its initial value."""
    m = _DECLARED.match(text.strip())
    return (re.sub(r"\s*\*", " *", re.sub(r"\s+", " ", m["type"])).strip() + m["size"].replace(" ", ""), m["name"]) if m and m["type"].strip() not in ("return", "goto", "else") else None


def signature(text: str | None) -> dict | None:
    """Result, name and parameters (type, name) of a C function's head."""
    m = re.search(r"([A-Za-z_][\w:~]*)\s*\(", text or "")
    end = matching_close(text, m.end() - 1) if m else -1
    if end < 0:
        return None
    parts = [p for p in split_arguments(text[m.end() : end]) if p not in ("", "void")]
    found = [declaration(p) or (p, None) for p in parts]
    return {"result": re.sub(r"\s+", " ", text[: m.start()]).strip(), "name": m[1], "parameters": [{"type": t, "name": n} for t, n in found]}


def locals_of(body: str | None) -> list[dict]:
    """Declarations at the start of a body, up to the first other statement."""
    out = []
    for line in (body or "").split("\n"):
        plain = line.strip()
        if plain in ("", "{"):
            continue
        found = declaration(plain[:-1].split("=")[0]) if plain.endswith(";") else None
        if not found:
            break
        out.append({"type": found[0], "name": found[1]})
    return out


def prefixed_names(text: str | None) -> list[str] | None:
    """Names written as length and letters, in a row or between N and E; None where lengths do not fit."""
    rest = text or ""
    nested = rest.startswith("N")
    rest = rest[nested:]
    out = []
    while m := re.match(r"[0-9]+", rest):
        n = int(m[0])
        if not n or len(rest) < len(m[0]) + n:
            return None
        out.append(rest[len(m[0]) : len(m[0]) + n])
        rest = rest[len(m[0]) + n :]
    return out if out and rest == ("E" if nested else "") else None


_TYPED = T.StructType([T.StructField("type", T.StringType()), T.StructField("name", T.StringType())])
_HEAD = T.StructType([T.StructField("result", T.StringType()), T.StructField("name", T.StringType()), T.StructField("parameters", T.ArrayType(_TYPED))])


@F.pandas_udf(T.ArrayType(T.StringType()))
def encoding_types(text: pd.Series) -> pd.Series:
    return text.map(encoded_types)


@F.pandas_udf(T.ArrayType(_TYPED))
def local_declarations(text: pd.Series) -> pd.Series:
    return text.map(locals_of)


@F.pandas_udf(T.ArrayType(T.StringType()))
def names_of(text: pd.Series) -> pd.Series:
    return text.map(prefixed_names)


@F.pandas_udf(_HEAD)
def heads(text: pd.Series) -> pd.DataFrame:
    found = [signature(t) or {"result": None, "name": None, "parameters": None} for t in text]
    return pd.DataFrame(found, columns=["result", "name", "parameters"])


def assignments(text):
    """Array of (target, value) of plain assignments, one statement each."""
    form = r"(?m)^\s*(?:\*\s*)?([A-Za-z_]\w*)\s*=(?!=)\s*([^;]*);"
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(form), F.lit(1)).alias("target"), F.regexp_extract_all(text, F.lit(form), F.lit(2)).alias("value"))
