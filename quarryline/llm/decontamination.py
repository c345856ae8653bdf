"""Benchmark decontamination by spaced seeds.

Fixed masks name the word places of a short span that count; the others may differ. Hashes of every place of
the corpus under every mask meet those of the benchmark, which travels to the corpus, in blocks of a checked
size, instead of the other way round. Hits of one document and item on one diagonal (distance of places) are
one candidate, and around it the aligned words are compared. A document is contaminated when it holds

* WINDOW neighbouring words of an item with at most SUBSTITUTED others: the masks hit every such window,
* a whole item of LEAST to WINDOW - 1 words with one other word: its halves, one of which is intact, are masks too,
* a whole item of fewer than LEAST words as it stands: the item is a mask,
* at its first or last word, an item's end or beginning of LEAST words or more as they stand: the shorter mask hits it.

Masks for short items are used only where the benchmark has such items. Nothing is missed for want of a seed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import MOST_BROADCAST, bounded, keep, let, row_key

#: Fixed masks; together they hit every window of WINDOW words with up to SUBSTITUTED substitutions.
MASKS = ((0, 1, 2, 5, 7, 8), (0, 1, 2, 4, 5, 6))
WINDOW, SUBSTITUTED = 13, 2
#: Items with fewer words must stand in the text as they are; those between may have one other word.
LEAST = 1 + min(m[-1] for m in MASKS)


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def hashed_words(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def short_lengths(n: int) -> tuple[int, ...]:
    """Lengths of the runs of words that an item of n words is found by beside the masks, in its order."""
    return () if n >= WINDOW or not n else (n,) if n < LEAST else (n // 2, n - n // 2)


def seeds(words: Column, masks: tuple[tuple[int, ...], ...] = MASKS) -> Column:
    """Hash of each place under each mask, place by place: entry k belongs to place k div m and mask k mod m; null where the mask sticks out."""
    m, n, least = len(masks), F.size(words), 1 + min(x[-1] for x in masks)

    def at(k: Column) -> Column:
        place = F.floor(k / m).cast("int")
        one = lambda mask: F.when(place + mask[-1] < n, F.xxhash64(F.lit(",".join(map(str, mask))), *(F.get(words, place + j) for j in mask)))
        out = one(masks[-1])
        for i in range(m - 1):
            out = F.when(k % m == i, one(masks[i])).otherwise(out)
        return out

    return F.when(n >= least, F.transform(F.sequence(F.lit(0), (n - least + 1) * m - 1), at)).otherwise(F.array().cast("array<bigint>"))


def _seeded(hashed: DataFrame, names: list[str], place: str, masks: tuple[tuple[int, ...], ...] = MASKS) -> DataFrame:
    # the outer form, for the plain one would first make the seeds once more, in a filter on their number
    placed = hashed.select(*names, F.posexplode_outer(seeds(F.col("words"), masks)).alias("k", "seed"))
    return placed.select(*names, F.floor(F.col("k") / len(masks)).cast("int").alias(place), "seed").where("seed is not null")


def _item_seeds(items: DataFrame, lengths: list[int]) -> DataFrame:
    """(item_id, item_place, seed): all places under MASKS, and the runs that short items are found by; lengths: those of the short items."""
    found = _seeded(items, ["item_id"], "item_place")
    for n in lengths:
        place = 0
        for length in short_lengths(n):
            mask = tuple(range(length))
            seed = F.get(seeds(F.slice("words", place + 1, length), (mask,)), F.lit(0))
            found = found.union(items.where(F.size("words") == n).select("item_id", F.lit(place).alias("item_place"), seed.alias("seed")))
            place += length
    return found.distinct()


def _windows(same: Column, item_size: Column) -> Column:
    """Whether the aligned words agree enough; same: array of 0 and 1, item_size: words of the whole item."""
    n, width = F.size(same), F.least(item_size, F.lit(WINDOW))
    allowed = F.when(width >= WINDOW, F.lit(SUBSTITUTED)).otherwise(F.floor(width / LEAST).cast("int"))
    total = lambda i: F.aggregate(F.slice(same, i + 1, width), F.lit(0), lambda a, b: a + b)
    inside = F.exists(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), lambda i: total(i) >= width - allowed)
    return F.when(n >= width, inside).otherwise((n >= LEAST) & ~F.exists(same, lambda x: x == 0))


def _hits(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """mine with the items of equal seeds. The benchmark's seeds come in blocks that may be broadcast, so the corpus's never move."""
    blocks = max(1, -(-theirs.count() // MOST_BROADCAST))
    block = lambda df, b: df.where(F.pmod(F.xxhash64("seed", F.lit("block")), F.lit(blocks)) == b) if blocks > 1 else df
    parts = [block(mine, b).join(F.broadcast(block(theirs, b)), "seed").select("doc_id", "row", "item_id", (F.col("place") - F.col("item_place")).alias("diagonal")) for b in range(blocks)]
    return reduce(DataFrame.union, parts).distinct()


def _overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, row, item_id, doc_start, length, matched): as ``overlaps``, with the key of the document's row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    items = keep(benchmark.select(F.col(item_col).alias("item_id"), hashed_words(F.col("text")).alias("words")))
    # at most WINDOW - 1 numbers reach the driver
    lengths = sorted(r["n"] for r in items.select(F.size("words").alias("n")).where(F.col("n").between(1, WINDOW - 1)).distinct().collect())
    theirs = keep(_item_seeds(items, lengths))
    masks = MASKS + tuple(tuple(range(n)) for n in sorted({x for n in lengths for x in short_lengths(n)}))
    mine = _seeded(docs.select("doc_id", "row", hashed_words(F.col("text")).alias("words")), ["doc_id", "row"], "place", masks)
    hits = keep(_hits(mine, theirs))
    hits = hits.withColumnsRenamed({"doc_id": "hit", "row": "hit_row"})
    same_row = F.col("doc_id").eqNullSafe(F.col("hit")) & (F.col("row") == F.col("hit_row"))
    some = docs.join(bounded(keep(hits.select("hit", "hit_row").distinct())), same_row, "left_semi")
    sides = hits.join(some.select("doc_id", "row", hashed_words(F.col("text")).alias("words")), same_row)
    item_words = items.select(F.col("item_id").alias("item"), F.col("words").alias("item_words"))
    met = sides.join(bounded(item_words), F.col("item_id").eqNullSafe(F.col("item")))
    lead = F.greatest(F.lit(0), -F.col("diagonal"))
    length = F.least(F.size("item_words") - lead, F.size("words") - (F.col("diagonal") + lead))
    met = met.select("doc_id", "row", "item_id", (F.col("diagonal") + lead).alias("doc_start"), length.alias("length"), "words", "item_words", lead.alias("lead")).where("length > 0")
    same = F.zip_with(F.slice("words", F.col("doc_start") + 1, F.col("length")), F.slice("item_words", F.col("lead") + 1, F.col("length")), lambda a, b: F.when(a == b, 1).otherwise(0))
    judged = met.select("doc_id", "row", "item_id", "doc_start", "length", let(same, lambda s: F.struct(_windows(s, F.size("item_words")).alias("ok"), F.aggregate(s, F.lit(0), lambda a, b: a + b).alias("matched"))).alias("j"))
    return judged.where("j.ok").select("doc_id", "row", "item_id", "doc_start", "length", F.col("j.matched").alias("matched")).distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, item_id, doc_start, length, matched): verified alignments of documents with items, by words.

    length is the aligned length, matched how many of its words agree. Null texts and those without words
    overlap with nothing, nor do null and empty items; an empty table on either side gives no rows. Texts of
    any length are read whole, other columns, whatever their names, are not looked at. Rows with the same id,
    or none, are judged each on its own; repeated items are told by their id.
    """
    return _overlaps(docs, benchmark, id_col, text_col, item_col).drop("row").distinct()


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per input row: doc_id, contaminated, n_items, items (item ids, comma-joined, rising), matched (most words).

    Nulls, empty and long texts, repeats, empty tables and other columns are treated as in ``overlaps``; a row
    without overlap has false, 0, an empty text and 0. An item without an id is counted by none.
    """
    found = _overlaps(docs, benchmark, id_col, text_col, item_col).groupBy(F.col("doc_id").alias("hit"), F.col("row").alias("hit_row")).agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("matched").alias("most"))
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(text_col)).alias("row"))
    met = rows.join(found, F.col("doc_id").eqNullSafe(F.col("hit")) & (F.col("row") == F.col("hit_row")), "left")
    return met.select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join(F.transform("items", lambda i: i.cast("string")), ","), F.lit("")).alias("items"), F.coalesce("most", F.lit(0)).cast("long").alias("matched"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of docs that overlap with no benchmark item."""
    hit = "decontamination_hit"
    while hit in docs.columns or f"{hit}_row" in docs.columns:
        hit += "_"
    bad = keep(_overlaps(docs, benchmark, id_col, text_col, item_col).select(F.col("doc_id").alias(hit), F.col("row").alias(f"{hit}_row")).distinct())
    return docs.join(bounded(bad), docs[id_col].eqNullSafe(bad[hit]) & (row_key(docs[text_col]) == bad[f"{hit}_row"]), "left_anti")
