"""Secret scans by a trigram inverted index.

Each rule's regular expression yields a Boolean query over trigrams. A first scan posts, for each trigram that
some query names, the keys of the texts that hold it (a text's key is its digest, so copies share one); the
index is written. Each rule's postings are intersected as its query says, for all rules in one grouping by
key, and a second scan verifies with a rule's expression only the texts that its postings leave. A rule
without mandatory trigrams (hex digits) scans every text in that second scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import bounded, keep, match_spans, no_spans, render
from quarryline.llm.trigrams import grams, trigram_query


@dataclass(frozen=True)
class Rule:
    """pattern is a Java and Python expression; least bounds the length of the numbered group (0: the match).

    linear, where given, is a Java expression whose first group, at its end, makes the same matches in linear time.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    linear: str | None = None


#: The base rules, in the order in which their kinds are listed.
BASE = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Rules of widely documented credential formats, added to the base.
ADDED = (
    Rule("pem", r"-----BEGIN\x20[A-Z0-9\x20]{0,40}PRIVATE\x20KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    # a part without white space has one first eyJ, and if what follows it does not match, later ones in the part do not either
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", linear=r"(?:\G|(?<![A-Za-z0-9_-]))(?:(?!eyJ)[A-Za-z0-9_-])*+(eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)"),
    Rule("url", r"://[A-Za-z0-9._~-]+:[A-Za-z0-9._~!$*+-]{4,}@"),
)
RULES = BASE + ADDED
#: Candidate texts (a digest and a number each) that may be broadcast; more are joined in a shuffle.
MOST_CANDIDATES = 1_000_000


def vocabulary(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """The trigrams that the index must post: those of the rules' queries."""
    return sorted(set().union(*(grams(trigram_query(r.pattern)) for r in rules)))


def posting_list(folded: Column, terms: list[str]) -> Column:
    """Numbers of the terms that a lower-cased text holds."""
    return F.array_compact(F.array(*(F.when(F.contains(folded, F.lit(g)), F.lit(i)) for i, g in enumerate(terms)))) if terms else F.array().cast("array<int>")


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index: (gram, doc_id) for the trigrams that the rules' queries name; a null text posts nothing."""
    terms = vocabulary(rules)
    folded = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col)).alias("folded"))
    # the outer form, for the plain one would first make the list once more, in a filter on its size
    posted = folded.select("doc_id", posting_list(F.col("folded"), terms).alias("posted")).select("doc_id", F.explode_outer("posted").alias("term")).where("term is not null")
    return posted.select(F.element_at(F.array(*map(F.lit, terms)), F.col("term") + 1).alias("gram"), "doc_id")


def _holds(query) -> Column:
    """The Boolean query over the collected grams of an id."""
    if isinstance(query, str):
        return F.array_contains("held", query)
    return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), map(_holds, query[1]))


def intersections(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, rules): ids whose postings satisfy some rule's query, with the numbers of those rules as bits."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not True}
    held = index.where(F.col("gram").isin(sorted(set().union(*map(grams, queries.values()))))).groupBy("doc_id").agg(F.collect_set("gram").alias("held"))
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(_holds(q), 1 << i).otherwise(0).cast("long") for i, q in queries.items()), F.lit(0).cast("long"))
    return held.select("doc_id", bits.alias("rules")).where("rules <> 0")


def candidates(index: DataFrame, rule: Rule) -> DataFrame | None:
    """Ids whose postings satisfy the rule's query; None where the rule has to scan everything."""
    return None if trigram_query(rule.pattern) is True else intersections(index, (rule,)).select("doc_id")


def _verified(rule: Rule, rank: int, candidate: Column) -> Column:
    """The rule's spans in the texts that the index leaves."""
    found = match_spans(F.col("text"), rule.linear, 1) if rule.linear else match_spans(F.col("text"), rule.pattern, rule.group)
    start, body = (lambda z: z["e"] - F.length(z["part"]), lambda z: z["part"]) if rule.linear else (lambda z: z["s"], lambda z: z["body"])
    return F.transform(
        F.filter(F.when(candidate, found).otherwise(no_spans()), lambda z: F.length(z["part"]) >= rule.least),
        lambda z: F.struct(start(z).alias("s"), F.lit(rank).alias("rank"), z["e"].alias("e"), F.lit(rule.kind).alias("kind"), body(z).alias("body")),
    )


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans, an array of (s, rank, e, kind, body) by start, then by the rules' order.

    One row per input row, repeated ids included; ids may be null, for texts are told apart by their digest.
    Null text counts as empty and has no spans; an empty table gives an empty result; other columns, whatever
    their names, are not looked at. Texts of any length are read whole; all expressions take time in
    proportion to the text. Matches of one rule do not overlap; those of different rules may.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.unhex(F.md5("text")))
    index = keep(postings(rows, rules, "key").sortWithinPartitions("gram").withColumnRenamed("doc_id", "key"))
    left = keep(intersections(index.withColumnRenamed("key", "doc_id"), rules).withColumnRenamed("doc_id", "held_key"))
    met = rows.join(bounded(left, MOST_CANDIDATES), F.col("key") == F.col("held_key"), "left")
    wanted = lambda i, r: F.lit(True) if trigram_query(r.pattern) is True else F.coalesce(F.col("rules").bitwiseAND(F.lit(1 << i)) != 0, F.lit(False))
    return met.select("doc_id", F.array_sort(F.concat(*(_verified(r, i, wanted(i, r)) for i, r in enumerate(rules)))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans as text."""
    base = F.filter("spans", lambda z: z["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda z: z["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(render(base), 256).alias("base_sha256"), render(F.col("spans")).alias("spans"))
