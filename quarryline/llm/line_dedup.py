"""Near-duplicate lines across a corpus by a deletion-neighbourhood join over words.

Edits are whole words: a line of MIN_WORDS words or more goes when an earlier line (by document id, then line
number) equals it or is one inserted, deleted or replaced word away; shorter ones, where asked for, when one equals it. A variant is what a line leaves when one
word is deleted, keyed by the hashes of the words before and after the gap. A replaced word is a gap of both
lines at the same place; an inserted one is a gap of the longer line that meets a seam between words of the
shorter. So all lines of one key are one edit apart, the earliest of each key decides, and no pairs are
listed. Distinct lines first meet by the hash of their first or last half, one of which an edit leaves
alone: only lines that meet there send variants, for the other half and the kind of edit they met by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import bounded, keep, let, row_key, shuffle_partitions

#: Stands for a null id, so that rows without one come last in the order.
NO_ID = (1 << 63) - 1
#: A line is hot when its places exceed this fraction (1 / SPLITS) of an even shuffle partition.
SPLITS = 4
#: Shorter lines have no near copies, for only from here on one edit leaves 80 % of the words.
MIN_WORDS = 5


def words_of(line: Column) -> Column:
    """Lower-cased words of a line. Splitting at one character is the fast way; other blanks are made spaces where there are any."""
    others = "\t\r\f\x0b"
    blank = F.contains(line, F.lit(others[0])) | F.contains(line, F.lit(others[1])) | F.contains(line, F.lit(others[2])) | F.contains(line, F.lit(others[3]))
    return F.array_remove(F.split(F.when(blank, F.translate(F.lower(line), others, "    ")).otherwise(F.lower(line)), " "), "")


def lines(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc, row, line_no, words) of the lines of least words or more."""
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), row_key(F.col("text")).alias("row"), "text")
    rows = rows.select("doc", "row", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    # a generator of one row: its output is taken apart once, where a filter over an expression would evaluate it twice
    return rows.select("doc", "row", "line_no", F.explode(F.array(words_of(F.col("line")))).alias("words")).where(F.size("words") >= least)


def _half(words: Column, m: Column, side: str) -> Column:
    """Hash of the first half of m words, or of what the last m words have beyond such a half."""
    h = F.floor(m / 2).cast("int")
    part = F.slice(words, F.lit(1), h) if side == "p" else F.slice(words, h - m, m - h)
    return F.xxhash64(m, F.lit(side), part)


def fingerprints(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc, row, line_no, fp, n, p, s, lp, ls): identity of each line and the hashes of its halves, as itself and as the longer of two; no halves under MIN_WORDS."""
    n = F.size("words")
    fp = F.unhex(F.md5(F.array_join("words", " ")))
    return lines(docs, least).select(
        "doc", "row", "line_no", fp.alias("fp"), n.alias("n"),
        *(F.when(n >= MIN_WORDS, _half(F.col("words"), n - longer, side)).alias("l" * longer + side) for longer in (0, 1) for side in "ps"),
    )


def _meeting(distinct: DataFrame) -> DataFrame:
    """(fp, sub_p, sub_s, seam_p, seam_s, del_p, del_s): which variants the lines that meet by a half have to send."""
    role = lambda column, longer, side: F.struct(F.col(column).alias("key"), F.lit(longer).alias("longer"), F.lit(side).alias("side"))
    sent = distinct.select("fp", F.xxhash64("fp").alias("id"), F.inline(F.array(role("p", False, "p"), role("s", False, "s"), role("lp", True, "p"), role("ls", True, "s"))))
    same = F.when(~F.col("longer"), F.col("id"))
    met = sent.groupBy("key").agg(F.min(same).alias("low"), F.max(same).alias("high"), F.max(F.when(F.col("longer"), F.col("id"))).alias("long")).where("low <> high or (low is not null and long is not null)")
    back = sent.join(met, "key")
    flag = lambda cond, side: F.max(F.when(cond & (F.col("side") == side), 1).otherwise(0)) == 1
    replaced, seam, deleted = ~F.col("longer") & (F.col("low") != F.col("high")), ~F.col("longer") & F.col("long").isNotNull(), F.col("longer") & F.col("low").isNotNull()
    flags = [flag(c, side).alias(f"{name}_{side}") for name, c in (("sub", replaced), ("seam", seam), ("del", deleted)) for side in "ps"]
    return back.groupBy("fp").agg(*flags).where("sub_p or sub_s or seam_p or seam_s or del_p or del_s")


def _chain(words: Column) -> Column:
    """Hashes of the first 0, 1, ... words."""
    return F.aggregate(words, F.array(F.lit(7).cast("long")), lambda a, w: F.array_append(a, F.xxhash64(F.element_at(a, -1), w)))


def variants() -> Column:
    """Keys of a line's gaps and seams; columns words, n and the flags of ``_meeting``."""
    n = F.col("n")

    def keys(kind: str, wanted_p: str, wanted_s: str, m: Column, gap: int, c: Column) -> Column:
        # the first half of m words is whole in what met by "p": the edit comes after it; before it in what met by "s"
        h = F.floor(m / 2).cast("int")
        last = n - gap
        low = F.when(F.col(wanted_s), F.lit(0)).otherwise(h)
        high = F.when(F.col(wanted_p), last).otherwise(F.least(h, last))
        body = F.transform(F.sequence(low, high), lambda i: F.xxhash64(F.lit(kind), m, i, F.get(c["up"], i), F.get(c["down"], n - gap - i)))
        return F.when(F.col(wanted_p) | F.col(wanted_s), body).otherwise(F.array().cast("array<bigint>"))

    both = F.struct(_chain(F.col("words")).alias("up"), _chain(F.reverse("words")).alias("down"))
    return let(both, lambda c: F.concat(keys("sub", "sub_p", "sub_s", n, 1, c), keys("ins", "del_p", "del_s", n - 1, 1, c), keys("ins", "seam_p", "seam_s", n, 0, c)))


def one_edit(a: Column, b: Column) -> Column:
    """Whether two different word lists are one inserted, deleted or replaced word apart."""
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    agree = F.array_position(F.zip_with(long, short, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")  # 1-based place of the first difference
    replaced = F.slice(a, agree + 1, F.size(a)) == F.slice(b, agree + 1, F.size(b))
    inserted = F.slice(long, agree + 1, F.size(long)) == F.slice(short, agree, F.size(long))
    return F.when(F.size(a) == F.size(b), replaced).otherwise((F.size(long) == F.size(short) + 1) & inserted)


def _place(line: str) -> Column:
    """What a line comes earlier by; its row is no part of that."""
    return F.struct(F.col(f"{line}.doc"), F.col(f"{line}.line_no"))


def _gone(docs: DataFrame, short: bool) -> DataFrame:
    """(doc, row, line_no) of every line that goes; docs has doc_id and text."""
    occurrences = keep(fingerprints(docs, 1 if short else MIN_WORDS))
    distinct = keep(occurrences.groupBy("fp").agg(F.count(F.lit(1)).alias("seen"), F.min(F.struct("doc", "line_no", "row")).alias("first"), *(F.min(c).alias(c) for c in ("n", "p", "s", "lp", "ls"))))
    flags = keep(_meeting(distinct.where(F.col("n") >= MIN_WORDS)))
    senders = keep(flags.join(distinct.select("fp", "first", "n"), "fp"))
    home = docs.join(bounded(keep(senders.select(F.col("first.doc").alias("home")).distinct())), F.coalesce("doc_id", F.lit(NO_ID)) == F.col("home"), "left_semi")
    texts = lines(home).select(F.struct("doc", "line_no", "row").alias("first"), "words").dropDuplicates(["first"])
    sending = keep(senders.join(texts, "first"))
    # the outer form, for the plain one would first make the variants once more, in a filter on their number
    sent = sending.select("fp", "first", F.explode_outer(variants()).alias("key")).where("key is not null")
    lead = sent.groupBy("key").agg(F.min("first").alias("lead"), F.max("first").alias("tail")).where(_place("lead") < _place("tail")).select("key", "lead")
    found = sent.join(lead, "key").where(_place("lead") < _place("first")).select("fp", "lead").distinct()
    of = lambda x: sending.select(F.col("first").alias(f"{x}_first"), F.col("fp").alias(f"{x}_fp"), F.col("words").alias(f"{x}_words"))
    near = (
        found.join(of("a"), F.col("fp") == F.col("a_fp")).join(of("b"), F.col("lead") == F.col("b_first"))
        .where(one_edit(F.col("a_words"), F.col("b_words"))).select("fp").distinct().withColumn("near", F.lit(True))
    )
    decided = keep(distinct.select("fp", "first", "seen").join(keep(near), "fp", "left").where("near or seen > 1"))
    # a line so frequent that its places would crowd one task: at most SPLITS * parts are, so these can be broadcast
    parts = shuffle_partitions(docs.sparkSession)
    hot = F.broadcast(decided.where(F.col("seen") > max(1, occurrences.count() // (SPLITS * parts))))
    places = occurrences.select("doc", "row", "line_no", "fp")
    met = places.join(hot, "fp").unionByName(places.join(hot.select("fp"), "fp", "left_anti").join(decided, "fp"))
    return met.where(F.col("near") | (F.struct("doc", "line_no") > _place("first"))).select("doc", "row", "line_no").distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """(doc_id, line_no) of every line that goes. Lines are separated by line feeds and numbered from 0.

    Lines under MIN_WORDS words go only if short is set, and then only as exact repeats.

    Null and empty texts have no lines to compare. A line is earlier only by a smaller (id, line number); ids
    that are null come after all others. Rows with the same id, or none, keep and lose lines each on its own.
    """
    gone = _gone(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), short)
    return gone.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "line_no").distinct()


def _gone_by_row(docs: DataFrame, id_col: str, text_col: str, short: bool, went: str) -> DataFrame:
    """The rows of docs that lines go from, as (went_doc, went_row), with the numbers of those lines as went."""
    gone = _gone(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), short)
    return gone.groupBy(F.col("doc").alias(f"{went}_doc"), F.col("row").alias(f"{went}_row")).agg(F.array_sort(F.collect_list("line_no")).alias(went))


def _fresh(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """The rows of docs with repeated lines taken out of their text; documents of which nothing but blanks is left after that go."""
    went = _fresh("line_dedup_gone", docs.columns)
    gone = _gone_by_row(docs, id_col, text_col, short, went)
    met = docs.join(gone, (F.coalesce(docs[id_col], F.lit(NO_ID)) == gone[f"{went}_doc"]) & (row_key(docs[text_col]) == gone[f"{went}_row"]), "left")
    rest = let(F.split(text_col, "\n", -1), lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(went)), lambda i: F.get(x, i)))
    kept = met.withColumn(text_col, F.when(F.col(went).isNotNull(), F.array_join(rest, "\n")).otherwise(F.col(text_col)))
    return kept.where(F.col(went).isNull() | F.col(text_col).rlike(r"[^\x20\t\r\n\f\x0B]")).select(*docs.columns)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, removed: the numbers of the lines that go, comma-joined.

    Null and empty texts have no lines; rows with the same id, or none, and texts of any length are treated as in
    ``repeated_lines``. An empty table gives an empty result; other columns, whatever their names, are not looked at.
    """
    gone = _gone_by_row(docs, id_col, text_col, short, "gone")
    counted = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(text_col)).alias("row"), F.when(F.coalesce(F.col(text_col), F.lit("")) == "", 0).otherwise(F.size(F.split(text_col, "\n", -1))).cast("long").alias("n_lines"))
    met = counted.join(gone, (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("gone_doc")) & (F.col("row") == F.col("gone_row")), "left")
    return met.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed"))
