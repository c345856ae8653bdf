"""Personal data by candidate generation and boosted trees.

Base kinds follow fixed forms. Beyond them, high-recall generators propose overlapping digit and letter
groups, each with format and context features; gradient-boosted trees, compiled into one column
expression, give a calibrated probability and the threshold picks the redactions. The trees are fitted in
numpy on a bounded, seeded set of synthetic candidates (``TRAINED_ON``); no corpus row is labelled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.boosting import Boosted
from quarryline.llm.common import let, match_spans, no_spans, render, running

#: The base forms, in the order in which their kinds are listed. Loops are possessive and
#: starts inside a run are skipped (a run fails or matches as a whole), so long runs stay linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
CUES = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Generators of further candidates; they overlap each other and the base on purpose.
GENERATORS = {
    "national_id": r"(?<![0-9-])[0-9]{3}[-\x20][0-9]{2}[-\x20][0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+.])\(?[0-9]{3}\)?[-.\x20][0-9]{3}[-.\x20][0-9]{4}(?![0-9])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "number": r"(?<![0-9])[0-9][0-9\x20()./-]{5,22}[0-9](?![0-9])",
    "birth_date": r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2})(?![0-9/-])",
    "document": r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{6,9}(?![A-Za-z0-9])",
    "device": r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])",
    "street": r"(?<![0-9A-Za-z])[0-9]{1,5}(?:\x20[A-Z][a-z]{1,20}){1,3}\x20(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Way)(?![A-Za-z])",
}
#: What a text without which none of the generators, nor of the base kinds but email, proposes anything holds.
NUMERIC = "[0-9]|[A-Fa-f]{2}[:-][A-Fa-f]{2}[:-]"
#: Characters of context on either side.
CONTEXT = 32
#: Words whose nearness speaks for personal data, and for something else.
FOR, AGAINST = r"(?i)\b(?:phone|tel|call|mobile|fax|ssn|social|passport|iban|account|acct|id|born|birth|birthday|dob|licence|license|address|lives|resides|device|mac)\b", r"(?i)\b(?:version|order|invoice|page|chapter|isbn|total|year|figure|table|sku|item|published|updated|due|released|copyright|model|part)\b"
FEATURES = ("digits", "length", "separators", "groups", "first_group", "distinct", "letters", "luhn", "for_near", "against_near", "joined_before", "joined_after", "generator", "date_like", "paren")
#: Synthetic candidates for fitting, as many again for calibration; precision that the threshold must reach on the latter.
TRAINED_ON, PRECISION, SEED = 3000, 0.98, 17


def luhn_ok(digits: Column) -> Column:
    """Luhn's check over a string of digits."""
    total = F.aggregate(
        F.transform(
            F.split(F.reverse(digits), ""),
            lambda c, i: let(c.cast("int") * (1 + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v)),
        ),
        F.lit(0),
        lambda a, v: a + v,
    )
    return total % 10 == 0


def _small(part: Column) -> Column:
    """A part of an address is at most 255, whatever its leading zeros."""
    return let(F.regexp_replace(part, "^0+", ""), lambda z: (F.length(z) <= 3) & (F.coalesce(z.try_cast("int"), F.lit(0)) <= 255))


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def _passes(kind: str, body: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(body, r"\."), _small)
    if kind == "card":
        return let(_digits(body), lambda d: F.length(d).between(13, 19) & F.when(F.length(d).between(13, 19), luhn_ok(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(body)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str, rank: int) -> Column:
    """array of (rank, s, e, kind, score) of one base kind."""
    matches = match_spans(text, BASE[kind])
    if CUES[kind]:
        matches = F.when(F.contains(text, F.lit(CUES[kind])), matches).otherwise(no_spans())
    return F.transform(F.filter(matches, lambda z: _passes(kind, z["body"])), lambda z: _span(rank, z, kind, F.lit(1.0)))


def _span(rank: int, z: Column, kind: str, score: Column) -> Column:
    return F.struct(F.lit(rank).alias("rank"), z["s"].alias("s"), z["e"].alias("e"), F.lit(kind).alias("kind"), score.alias("score"))


def _features(before: Column, body: Column, after: Column, generator: Column) -> dict[str, Column]:
    """Format and context of one candidate, all as doubles; before and after are what stands next to it."""
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    d = _digits(body)
    groups = F.filter(F.split(body, "[^0-9A-Za-z]+"), lambda g: g != "")
    out = {
        "digits": F.length(d), "length": F.length(body), "separators": F.length(F.regexp_replace(body, "[0-9A-Za-z]", "")), "groups": F.size(groups), "first_group": F.length(groups[0]),
        "distinct": F.size(F.array_distinct(F.split(d, ""))), "letters": F.length(F.regexp_replace(body, "[^A-Za-z]", "")), "luhn": flag(luhn_ok(d)),
        "for_near": flag(before.rlike(FOR)), "against_near": flag(before.rlike(AGAINST)), "joined_before": flag(before.rlike(r"[A-Za-z0-9_#/=-]$")), "joined_after": flag(after.rlike(r"^[A-Za-z0-9_/=-]")),
        "generator": generator, "date_like": flag(body.rlike(r"^(?:19|20)[0-9]{2}[-/.]|[-/.](?:19|20)[0-9]{2}$")), "paren": flag(F.contains(body, F.lit("("))),
    }
    return {k: v.cast("double") for k, v in out.items()}


def features(text: Column, z: Column, generator: int) -> dict[str, Column]:
    """The features of the span z of a text."""
    before = F.substring(text, F.greatest(z["s"] - CONTEXT + 1, F.lit(1)).cast("int"), F.least(z["s"], F.lit(CONTEXT)).cast("int"))
    return _features(before, z["body"], F.substring(text, (z["e"] + 1).cast("int"), F.lit(CONTEXT)), F.lit(generator))


@dataclass(frozen=True)
class Candidate:
    before: str
    body: str
    after: str
    generator: int


def _numeric(c: Candidate) -> list[float]:
    """The same features in Python, for fitting; a test holds both forms against each other."""
    import re

    d = re.sub("[^0-9]", "", c.body)
    before, after = c.before[-CONTEXT:], c.after[:CONTEXT]
    groups = [g for g in re.split("[^0-9A-Za-z]+", c.body) if g]
    total = sum(v - 9 if v > 9 else v for v in (int(x) * (1 + i % 2) for i, x in enumerate(reversed(d))))
    return [
        len(d), len(c.body), len(re.sub("[0-9A-Za-z]", "", c.body)), len(groups), len(groups[0]), len(set(d)), len(re.sub("[^A-Za-z]", "", c.body)), float(total % 10 == 0),
        float(bool(re.search(FOR, before))), float(bool(re.search(AGAINST, before))), float(bool(re.search(r"[A-Za-z0-9_#/=-]$", before))), float(bool(re.search(r"^[A-Za-z0-9_/=-]", after))),
        c.generator, float(bool(re.search(r"^(?:19|20)[0-9]{2}[-/.]|[-/.](?:19|20)[0-9]{2}$", c.body))), float("(" in c.body),
    ]


#: Contexts of the synthetic candidates by generator: personal ones, others.
_NEAR = {
    "birth_date": (("born on ", "DOB: ", "date of birth ", "birthday "), ("published ", "updated on ", "due ", "released ", "copyright ")),
    "document": (("passport ", "licence ", "ID ", "license no. "), ("model ", "part ", "order ", "item ", "sku ")),
    "device": (("device ", "mac ", "the ", "id "), ("version ", "table ", "x=", "#")),
    "street": (("lives at ", "address: ", "resides at ", "the ", "of, "), ("page ", "chapter ", "table ", "figure ", "item ")),
}
_NUMBERS = (("my phone ", "tel: ", "call ", "SSN ", "IBAN ", "account ", "passport ", "mobile: "), ("order ", "version ", "invoice ", "page ", "table ", "item ", "total ", "x=", "#", "key"))


def synthetic(n: int, seed: int) -> tuple[list[Candidate], np.ndarray]:
    """Candidates with known labels: personal numbers in personal contexts, other numbers in other contexts, some of each in none."""
    rng = np.random.default_rng(seed)
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda *x: x[rng.integers(len(x))]
    kinds, out, labels = list(GENERATORS), [], []
    for _ in range(n):
        y = int(rng.random() < 0.5)
        g = int(rng.integers(len(kinds)))
        if kinds[g] == "national_id":
            body = f"{num(3)}-{num(2)}-{num(4)}" if y or rng.random() < 0.4 else f"{num(3)} {num(2)} {num(4)}"
        elif kinds[g] == "local_phone":
            body = pick(f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}") if y else pick(f"{num(3)} {num(3)} {num(4)}", f"{num(3)}.{num(3)}.{num(4)}")
        elif kinds[g] == "account":
            body = pick("DE", "FR", "ES", "GB") + num(2) + (" " if rng.random() < 0.5 else "").join(["", *(num(4) for _ in range(rng.integers(3, 6)))]) if y else pick("AB", "NO", "SK") + num(2) + "".join(pick("A", "7", "Q", "X") for _ in range(8))
        elif kinds[g] == "number":
            body = f"{num(3)}-{num(3)}-{num(3)}" if y else pick(num(8), num(12), f"20{num(2)}-0{rng.integers(1, 9)}-1{num(1)}", f"{num(1)}.{num(2)}.{num(4)}", f"{num(4)}/{num(4)}", f"{num(3)} {num(4)} {num(2)}")
        elif kinds[g] == "birth_date":
            body = pick(f"19{num(2)}-0{rng.integers(1, 10)}-1{num(1)}", f"1{num(1)}/0{rng.integers(1, 10)}/19{num(2)}") if y else pick(f"20{num(2)}-0{rng.integers(1, 10)}-1{num(1)}", f"1{num(1)}.0{rng.integers(1, 10)}.20{num(2)}", f"19{num(2)}-0{rng.integers(1, 10)}-1{num(1)}")
        elif kinds[g] == "document":
            body = pick("A", "C", "AB", "XK") + num(rng.integers(6, 10))
        elif kinds[g] == "device":
            body = pick(":", "-").join((pick("a", "b", "F", "0", "9") + pick("1", "c", "E", "7")) for _ in range(6)) if y else pick(":", "-").join(num(2) for _ in range(6))
        else:
            body = f"{rng.integers(1, 999)} " + pick("Oak", "Baker", "Mill Hill", "New Park") + " " + pick("Street", "St", "Road", "Lane", "Ave")
        personal, other = _NEAR.get(kinds[g], _NUMBERS)
        plain = pick("the ", "and ", "of, ", "")
        near = rng.random()
        before = (pick(*personal) if near < 0.8 else plain) if y else (pick(*other) if near < 0.6 else plain if near < 0.97 else pick(*personal))
        if kinds[g] in ("document", "birth_date", "street"):  # the form says little there: the context decides
            before = pick(*personal) if y else pick(*other) if near < 0.7 or kinds[g] == "street" else plain
        out.append(Candidate("it was " + before, body, pick(" and so", ".", " the", "") if y or rng.random() < 0.7 else pick("_x", "/2", "abc"), g))
        labels.append(y)
    return out, np.array(labels, dtype=float)


@cache
def model() -> Boosted:
    """The fitted and calibrated trees; the same on every machine."""
    fit, y = synthetic(TRAINED_ON, SEED)
    held, z = synthetic(TRAINED_ON, SEED + 1)
    trees = Boosted(FEATURES).fit(np.array([_numeric(c) for c in fit], float), y)
    return trees.calibrate(np.array([_numeric(c) for c in held], float), z, PRECISION)


def candidates(text: Column) -> Column:
    """array of (rank, s, e, kind, body, before, after) of all generators; the context ends at the generator's next candidate."""

    def of(kind: str, generator: int) -> Column:
        raw = F.struct(match_spans(text, GENERATORS[kind]).alias("found"), F.split(text, GENERATORS[kind], -1).alias("gaps"))
        placed = lambda r: F.transform(
            r["found"],
            lambda z, i: F.struct(
                F.lit(len(BASE) + generator).alias("rank"), z["s"].alias("s"), z["e"].alias("e"), F.lit(kind).alias("kind"), z["body"].alias("body"),
                F.right(F.get(r["gaps"], i), F.lit(CONTEXT)).alias("before"), F.left(F.get(r["gaps"], i + 1), F.lit(CONTEXT)).alias("after"),
            ),
        )
        return F.when(text.rlike(GENERATORS[kind]), let(raw, placed)).otherwise(F.array().cast(_CANDIDATES))

    return F.concat(*(of(kind, i) for i, kind in enumerate(GENERATORS)))


_CANDIDATES = "array<struct<rank:int,s:bigint,e:bigint,kind:string,body:string,before:string,after:string>>"
_CHOSEN = "array<struct<rank:int,s:bigint,e:bigint,kind:string,score:double>>"


def scored(text: Column) -> Column:
    """array of (rank, s, e, kind, score) of the candidates that the trees accept."""
    trees = model()

    def judged(z: Column) -> Column:
        columns = _features(z["before"], z["body"], z["after"], z["rank"] - len(BASE))
        return F.struct(z["rank"], z["s"], z["e"], z["kind"], let(F.struct(*(c.alias(k) for k, c in columns.items())), lambda f: trees.column({k: f[k] for k in FEATURES})).alias("score"))

    return F.filter(F.transform(candidates(text), judged), lambda z: z["score"] >= trees.threshold)


def uncovered(spans: Column) -> Column:
    """spans, in order of their starts, without those that overlap one of a lower rank; base spans stay all.

    For each rank, what starts earlier is met by the farthest end so far, what starts later by the nearest
    start to come: two running folds instead of all pairs.
    """
    far = 1 << 62
    ranks = F.sequence(F.lit(len(BASE) - 1), F.lit(len(BASE) + len(GENERATORS) - 2))  # the base is one, the last rank covers nothing
    by_rank = lambda z, value, other: F.transform(ranks, lambda r: F.when(F.greatest(z["rank"], F.lit(len(BASE) - 1)) == r, value).otherwise(F.lit(other).cast("long")))
    none = lambda other: F.transform(ranks, lambda r: F.lit(other).cast("long"))
    fold = lambda pick: lambda a, b: F.zip_with(a, b, lambda x, y: pick(x, y))
    ends = lambda v: running(F.transform(v, lambda z: by_rank(z, z["e"], -1)), none(-1), fold(F.greatest))
    starts = lambda v: F.reverse(running(F.reverse(F.transform(v, lambda z: by_rank(z, z["s"], far))), none(far), fold(F.least)))

    def lower(m: Column, z: Column, i: Column) -> Column:
        first = z["rank"] - (len(BASE) - 1)
        return F.exists(F.slice(F.get(m["end"], i), F.lit(1), first), lambda e: e > z["s"]) | F.exists(F.slice(F.get(m["start"], i), F.lit(1), first), lambda s: s < z["e"])

    both = lambda v: let(F.struct(ends(v).alias("end"), starts(v).alias("start")), lambda m: F.filter(v, lambda z, i: (z["rank"] < len(BASE)) | ~lower(m, z, i)))
    return let(spans, lambda v: F.when(F.size(v) > 1, both(v)).otherwise(v))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and added: arrays of (rank, s, e, kind, score) by kind, then start.

    One row per input row, repeated ids included; ids may be null. Null text counts as empty and has no spans,
    as have texts without a match; an empty table gives an empty result; other columns, whatever their names,
    are not looked at. Long texts are read whole, in time that grows with their length and number of spans.
    An added span that overlaps a base span is dropped, for the base span stays and covers it; of overlapping
    added spans that of the more specific generator, which is listed earlier, stays.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("numeric", F.col("text").rlike(NUMERIC))
    text, none = F.col("text"), F.array().cast(_CHOSEN)
    base = [base_spans(text, k, i) for i, k in enumerate(BASE)]
    rows = rows.select("doc_id", "text", "numeric", F.concat(base[0], F.when(F.col("numeric"), F.concat(*base[1:])).otherwise(none)).alias("base"))
    rows = rows.select("doc_id", "base", F.when(F.col("numeric"), scored(text)).otherwise(none).alias("accepted"))
    by_start = F.array_sort(F.transform(F.concat("base", "accepted"), lambda z: F.struct(z["s"], z["rank"], z["e"], z["kind"], z["score"])))
    plain = lambda z: F.struct(z["rank"], z["s"], z["e"], z["kind"], z["score"])
    added = F.transform(F.filter(uncovered(by_start), lambda z: z["rank"] >= len(BASE)), plain)
    return rows.select("doc_id", F.array_sort("base").alias("base"), F.when(F.size("accepted") > 0, F.array_sort(added)).otherwise(none).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda z: z["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(render(F.col("base")), 256).alias("base_sha256"), render(F.concat("base", "added")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[PII]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text with every chosen span replaced; joins on the id, so ids must be unique there."""
    spans = scan(docs, id_col, text_col).select("doc_id", F.array_sort(F.transform(F.concat("base", "added"), lambda z: F.struct(z["s"], z["e"]))).alias("spans"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(spans, "doc_id")
    done = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, z: F.when(z["s"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], z["e"]).alias("at"))).otherwise(
            F.struct(F.concat(a["out"], F.substring("text", (a["at"] + 1).cast("int"), (z["s"] - a["at"]).cast("int")), F.lit(mark)).alias("out"), z["e"].alias("at"))
        ),
        lambda a: F.concat(a["out"], F.substring("text", (a["at"] + 1).cast("int"), F.length("text"))),
    )
    return rows.select("doc_id", done.alias("text"))
