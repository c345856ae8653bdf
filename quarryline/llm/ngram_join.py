"""Exact Jaccard self-join on word shingles by a partition of the token universe.

Sizes fall into bands [2^k, 2^(k+1)); a set also takes part in the next lower band when a partner may lie
there. In a band, hashing deals the tokens into M segments. Two sets that link differ in at most H tokens,
hence agree on at least M - H segments, so each set may leave out all but its H + 1 + E segment subsets that
come first in one common order: the pair's first E + 1 agreeing subsets survive on both sides (E is the
band's). The order is by cost: subsets whose every token is frequent in a bounded sample come last, then
those of few tokens, empty ones never. Once the true bucket sizes are counted, each set gives up the E of
its shared keys with the largest buckets, again in one common order, so that a common key survives; pairs
that share a passage only are gone by then. A wrong estimate costs time, not links. Sets with H + 1 + e
filled segments, e less than E, give up e only; those with fewer than H + 1 index their deletion
neighbourhoods down to single tokens as well and give up nothing.

Each bucket of equal keys is compared to its first member, not pairwise. Where the other members then still
lie in several components, those outside the bucket's first component meet the rest in blocks of bounded
size. A comparison counts differing bits of two parity sketches, a lower bound of the symmetric difference;
only what that leaves becomes a row and is verified on the whole sets. Only identities, keys, sketches and the
sets of near pairs are shuffled, and frequent buckets are dealt out by a salt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryline.llm import hashing as H
from quarryline.llm.common import bounded, keep, row_key
from quarryline.llm.components import connect
from quarryline.llm.workers import released, runs

#: Link when NUM * union <= DEN * intersection.
NUM, DEN = 80, 100
#: Documents in the frequency sample, least sampled count of a frequent token, most tokens kept: all bound the broadcast.
SAMPLE, FREQUENT, MOST_FREQUENT = 4000, 3, 50_000
#: Members of a bucket that one task should see at most, for buckets known to be frequent.
BUCKET = 2000
#: Members of a block, about; members from which on a bucket counts as large.
BLOCK, LARGE = 512, 128
_FILTER_BITS = 20


def differ_at_most(size):
    """Most tokens in which a linking partner can differ, from either side in size."""
    return ((DEN - NUM) * (size + size * DEN // NUM)) // (DEN + NUM)


def segments(band):
    """Segments of a band; at least as many filled ones as are needed, with room to leave out frequent ones."""
    low = 1 << np.asarray(band, np.int64)
    return np.maximum(np.minimum(4 * low, 64), (7 * low + 9) // 10)


def extra(band):
    """E: keys that the sets of a band send beyond the needed ones, so as to give up those that prove frequent."""
    return 8 + (1 << np.asarray(band, np.int64)) // 32


class Costs:
    """Sampled frequency levels: 0 for what is not frequent, else about the binary logarithm of the sampled count."""

    def __init__(self, tokens: list[int], counts: list[int], scale: float):
        token = np.array(tokens, np.int64).view(np.uint64)
        order = np.argsort(token)
        self.tokens, self.levels = token[order], np.floor(np.log2(np.array(counts, float)[order])).astype(np.int64) + 1
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.tokens & H.U((1 << _FILTER_BITS) - 1)] = True
        self.salts = np.maximum(1, np.ceil(2.0 ** np.arange(64) * scale / BUCKET)).astype(np.uint64)

    def level(self, token: np.ndarray) -> np.ndarray:
        out = np.zeros(len(token), np.int64)
        maybe = np.nonzero(self.filter[token & H.U((1 << _FILTER_BITS) - 1)])[0]
        if len(maybe):
            at = np.minimum(np.searchsorted(self.tokens, token[maybe]), len(self.tokens) - 1)
            hit = self.tokens[at] == token[maybe]
            out[maybe[hit]] = self.levels[at[hit]]
        return out


def keys(owner: np.ndarray, token: np.ndarray, sizes: np.ndarray, ids: np.ndarray, costs: Costs):
    """(bucket, id, base, spare) for all sets: base is the key of a salted bucket, else 0; spare is twice the
    number of keys that the set may give up in this band, plus 1 for the lower band."""
    bands = np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    level = costs.level(token)
    out = []
    for lower in (False, True):
        band = bands - lower
        there = (sizes > 0) & ((NUM * sizes <= DEN * ((1 << bands) - 1)) if lower else True) & (band >= 0)
        mine = there[owner]
        if not mine.any():
            continue
        own, tok, lev = owner[mine], token[mine], level[mine]
        m = np.where(there, segments(np.maximum(band, 0)), 0)
        base = np.cumsum(m) - m
        seg = base[own] + (H.mix(tok, 5) % m[own].astype(np.uint64)).astype(np.int64)
        total = int(m.sum())
        sums = np.zeros(total, np.uint64)
        np.add.at(sums, seg, H.mix(tok, 6))
        held = np.bincount(seg, minlength=total)
        rank = np.full(total, 63, np.int64)
        if lev.any():
            np.minimum.at(rank, seg, lev)
        else:
            rank[:] = 0
        at = np.nonzero(held)[0]
        doc = np.repeat(np.arange(len(sizes)), m)[at]
        key = H.mix(sums[at] + (at - base[doc]).astype(np.uint64) * H.U(0x2545F4914F6CDD1D) + H.mix(band[doc].astype(np.uint64), 7), 8)
        rank = rank[at]
        small = 7 - np.minimum(held[at], 7)
        order = np.lexsort((((rank << 3) | small).astype(np.uint64) << H.U(55) | (key >> H.U(9)), doc))
        doc, key, rank = doc[order], key[order], rank[order]
        have = np.bincount(doc, minlength=len(sizes))
        place = np.arange(len(doc)) - (np.cumsum(have) - have)[doc]
        need = differ_at_most(sizes) + 1
        sent = np.minimum(have, need + extra(np.maximum(band, 0)))
        kept = place < sent[doc]
        few = there & (have < need)
        spare = 2 * np.maximum(0, sent - need) + int(lower)
        parts = [(doc[kept], key[kept], rank[kept])]
        if few.any():
            single = few[own]
            parts.append((own[single], H.mix(tok[single] + H.mix(band[own[single]].astype(np.uint64), 7), 9), lev[single]))
        for d, k, r in parts:
            salts = costs.salts[r]
            salted = salts > H.U(1)
            salt = ids[d].view(np.uint64) % salts
            out.append((np.where(salted, H.mix(k + H.mix(salt, 10), 11), k).view(np.int64), ids[d], np.where(salted, k, H.U(0)).view(np.int64), spare[d].astype(np.int32)))
    return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64 if i < 3 else np.int32) for i in range(4))


def sketches(owner: np.ndarray, token: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """A bit for each of 2^(k + 1) segments, 8 at least, k the band: whether its tokens are odd in number. Sketches of different bands fold.

    Parities of twice as many segments tell as many differences as a byte-wide sum of each segment, in a quarter of the space.
    """
    width = np.where(sizes > 0, np.maximum(8, 2 << np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64)), 0)
    base = np.cumsum(width) - width
    place = base[owner] + (H.mix(token, 12) & (width[owner] - 1).astype(np.uint64)).astype(np.int64)
    out = np.packbits(np.bincount(place, minlength=int(width.sum())) & 1 == 1, bitorder="little")
    return [out[i : i + w].tobytes() for i, w in zip((base // 8).tolist(), (width // 8).tolist(), strict=True)]


def may_link(size_a: int, size_b: int, sketch_a: bytes, sketch_b: bytes) -> bool:
    """False only if the sets cannot link: each differing bit's segment holds a token that one side lacks."""
    x, y = np.frombuffer(sketch_a, np.uint8), np.frombuffer(sketch_b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return NUM * max(size_a, size_b) <= DEN * min(size_a, size_b) and (DEN + NUM) * int(np.bitwise_count(x ^ y).sum()) <= (DEN - NUM) * (size_a + size_b)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")]
        yield batch.select(["a", "b"]).filter(pa.array([may_link(*x) for x in zip(*cols, strict=True)], pa.bool_()))


class _Blocks:
    """A list column of (set_id, label, n, sketch, bases) members, one block a row, read in place."""

    def __init__(self, column: pa.Array):
        self.at, members = column.offsets.to_numpy(), column.values
        self.set_id, self.label, self.n = (members.field(i).to_numpy() for i in range(3))
        sketch = members.field(3)
        self.bases = members.field(4)
        self.data, self.starts = np.frombuffer(sketch.buffers()[2], np.uint8), np.frombuffer(sketch.buffers()[1], np.int32)[sketch.offset : sketch.offset + len(sketch) + 1]

    def rows(self, i: int) -> slice:
        return slice(self.at[i], self.at[i + 1])

    def width(self, i: int) -> int:
        return int(np.diff(self.starts[self.at[i] : self.at[i + 1] + 1]).min())

    def sketches(self, i: int, width: int) -> np.ndarray:
        """The block's sketches, folded to one width."""
        out = np.zeros((self.at[i + 1] - self.at[i], width), np.uint8)
        for j in range(len(out)):
            lo, hi = self.starts[self.at[i] + j], self.starts[self.at[i] + j + 1]
            out[j] = np.bitwise_xor.reduce(self.data[lo:hi].reshape(-1, width), axis=0)
        return out


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of an odd member and any member with another label whose sketches allow a link, block by block.

    A pair that shares several large buckets is told by the smallest key of them only; members carry the keys
    of their large buckets for that.
    """
    for batch in batches:
        pairs: set[tuple[int, int]] = set()
        odd, every = _Blocks(batch.column("odd")), _Blocks(batch.column("every"))
        for i, base in enumerate(batch.column("base").to_pylist()):
            width = min(odd.width(i), every.width(i))
            table, rows = every.sketches(i, width), every.rows(i)
            size, label, ids = every.n[rows], every.label[rows], every.set_id[rows]
            mine = odd.rows(i)
            for j, sketch, one, n, its in zip(range(mine.start, mine.stop), odd.sketches(i, width), odd.set_id[mine].tolist(), odd.n[mine], odd.label[mine], strict=True):
                ok = (label != its) & (NUM * np.maximum(size, n) <= DEN * np.minimum(size, n))
                if not ok.any():
                    continue
                ok &= (DEN + NUM) * np.bitwise_count(table ^ sketch).sum(1, dtype=np.int64) <= (DEN - NUM) * (size + n)
                found = np.nonzero(ok)[0].tolist()
                large = set(odd.bases[j].as_py() or ()) if found else set()
                for k in found:
                    if base not in large or next(x for x in every.bases[rows.start + k].as_py() if x in large) == base:
                        other = int(ids[k])
                        pairs.add((max(one, other), min(one, other)))
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for done, run in runs(batch.column("text").cast(pa.binary())):
            owner, token = H.shingle_sets(run)
            sizes, ids = H.set_ids(owner, token, len(run))
            names = [c for c in ("doc_id", "row") if c in batch.schema.names]
            columns = [*(batch.column(c).slice(done, len(run)) for c in names), pa.array(sizes.astype(np.int64)), pa.array(ids), pa.array(sketches(owner, token, sizes), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_shingles", "set_id", "sketch"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, run in runs(batch.column("text").cast(pa.binary())):
            yield pa.RecordBatch.from_arrays([pa.array(H.shingle_sets(run)[1].view(np.int64))], ["token"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # a task makes a set once, however many copies it reads
    for batch in batches:
        for _, run in runs(batch.column("text").cast(pa.binary())):
            owner, token = H.shingle_sets(run)
            sizes, ids = H.set_ids(owner, token, len(run))
            new = np.zeros(len(run), bool)
            for i, x in enumerate(ids.tolist()):
                if x not in seen:
                    seen.add(x)
                    new[i] = True
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(new, sizes, 0))]).astype(np.int32)), pa.array(token[new[owner]].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), lists], ["set_id", "tokens"]).filter(pa.array(new))


def _keyed(costs):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task sends a set once, however many copies it reads
        for batch in batches:
            for _, run in runs(batch.column("text").cast(pa.binary())):
                owner, token = H.shingle_sets(run)
                sizes, ids = H.set_ids(owner, token, len(run))
                new = np.zeros(len(run), bool)
                for i, x in enumerate(ids.tolist()):
                    if sizes[i] and x not in seen:
                        seen.add(x)
                        new[i] = True
                fresh = new[owner]
                bucket, who, base, spare = keys(owner[fresh], token[fresh], np.where(new, sizes, 0), ids, costs.value)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(who), pa.array(base, mask=base == 0), pa.array(spare)], ["bucket", "set_id", "base", "spare"])

    return emit


def frequent_tokens(docs: DataFrame, rows: int) -> Costs:
    """Costs from a sample of about SAMPLE documents."""
    share = min(1.0, SAMPLE / max(rows, 1))
    some = docs.select("text").sample(withReplacement=False, fraction=share, seed=7) if share < 1 else docs.select("text")
    counted = some.mapInArrow(released(_tokens), "token long").groupBy("token").count().where(F.col("count") >= FREQUENT)
    top = counted.orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).collect()
    return Costs([r["token"] for r in top], [r["count"] for r in top], 1 / share)


def buckets(docs: DataFrame, costs) -> DataFrame:
    """(base, bucket, set_id, salted): the keys that several sets share, less what each set gives up.

    A set gives up its most frequent keys, those of salted buckets first. Their true sizes are not known
    here, so these follow each other by key.
    """
    rows = docs.select("text").mapInArrow(released(_keyed(costs)), "bucket long, set_id long, base long, spare int")
    together = Window.partitionBy("bucket")
    met = rows.select(
        F.col("base").isNotNull().alias("salted"), "bucket", F.coalesce("base", "bucket").alias("base"), "set_id", "spare",
        F.coalesce(F.lag("set_id").over(together.orderBy("set_id")) != F.col("set_id"), F.lit(True)).alias("new"),
        F.min("set_id").over(together).alias("low"), F.max("set_id").over(together).alias("high"), F.count(F.lit(1)).over(together).alias("rows"),
    ).where("new and (salted or low <> high)")
    own = Window.partitionBy("set_id", F.col("spare") % 2).orderBy(F.col("salted").desc(), F.when(F.col("salted"), 0).otherwise(F.col("rows")).desc(), "base")
    kept = met.withColumn("place", F.row_number().over(own)).where(F.col("place") > F.floor(F.col("spare") / 2)).select("base", "bucket", "set_id", "salted")
    return kept


def _pivoted(kept: DataFrame) -> DataFrame:
    """kept with the first member of each bucket as pivot, without buckets that only one set is left in."""
    ends = kept.groupBy("bucket").agg(F.min("set_id").alias("pivot"), F.max("set_id").alias("last"))
    return kept.join(ends, "bucket").where("salted or pivot <> last").select("base", "set_id", "salted", "pivot")


class Verifier:
    """Which of given pairs link. Sketches come with the class list; whole sets are read again from the texts.

    A pair's first set is made where its text lies, and travels once, to the second; only second sets, the pivots, are
    dealt out by themselves. A task sends a set once, however many rows have it.
    """

    def __init__(self, docs: DataFrame, classes: DataFrame):
        self.docs, self.classes, self.tested = docs, classes, None

    def _sets(self, ids: DataFrame) -> DataFrame:
        """(set_id, tokens) of the classes in ids (set_id)."""
        wanted = keep(ids.distinct().join(self.classes.select("set_id", "first_id"), "set_id").select(F.col("first_id").alias("doc_id")))
        return self.docs.join(bounded(wanted), "doc_id", "left_semi").mapInArrow(released(_sets), "set_id long, tokens array<long>")

    def links(self, pairs: DataFrame) -> DataFrame:
        side = lambda x: self.classes.select(F.col("set_id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = keep(pairs)
        self.tested = pairs if self.tested is None else keep(self.tested.union(pairs))
        near = keep(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(released(_near), "a long, b long"))
        if near.isEmpty():
            return near
        first = self._sets(near.select(F.col("a").alias("set_id"))).select(F.col("set_id").alias("a"), F.col("tokens").alias("ta")).join(bounded(near), "a")
        second = self._sets(near.select(F.col("b").alias("set_id"))).select(F.col("set_id").alias("b"), F.col("tokens").alias("tb")).dropDuplicates(["b"])
        shared = F.size(F.array_intersect("ta", "tb"))
        return keep(first.join(second, "b").where(DEN * shared >= NUM * (F.size("ta") + F.size("tb") - shared)).select("a", "b").distinct())


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x) != F.col(y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()


def _apart(pairs: DataFrame, x: str, y: str, labels: DataFrame) -> DataFrame:
    """The pairs whose members are not in one component yet."""
    label = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    met = pairs.join(label(x), x, "left").join(label(y), y, "left")
    return met.where(F.coalesce(f"label_{x}", x) != F.coalesce(f"label_{y}", y)).select(x, y)


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, the smallest id reachable by links, itself included.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set holds the distinct shingles of
    WORDS words, of a shorter text the whole. Texts without words, and null, are empty and link with
    nothing. Repeated rows are rows of their own. Rows with a null id follow the rows that have the same set;
    a set whose rows all have a null id links with nothing and its component_id is null. With row, the
    row's key is a further column.
    """
    keys = {"row": row_key(F.col(text_col))} if row else {}
    keyed = docs.select(F.col(id_col).alias("doc_id"), *(c.alias(k) for k, c in keys.items()), F.col(text_col).alias("text"))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = docs.count()
    members = keep(keyed.mapInArrow(released(_sizes), "doc_id long, " + "row long, " * row + "n_shingles long, set_id long, sketch binary"))
    costs = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs, rows))
    shared = keep(_pivoted(keep(buckets(docs, costs))))
    classes = members.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n"))
    # a representative's row carries the sketch; equal sets have equal sketches
    met = shared.select("set_id").distinct().join(classes, "set_id")
    drawn = members.select("set_id", F.col("doc_id").alias("first_id"), "sketch").dropDuplicates(["set_id", "first_id"])
    verifier = Verifier(docs, keep(met.join(drawn, ["set_id", "first_id"])))
    # first round: everyone against the pivot it shares most keys with, then, where that leaves them apart, against the
    # other pivots; a key's salted buckets have several, which meet the first of them
    heads = shared.where("salted").select("base", F.col("pivot").alias("head")).distinct()
    heads = heads.join(heads.groupBy("base").agg(F.min("head").alias("top")), "base")
    asked = keep(shared.where("set_id <> pivot").groupBy("set_id", "pivot").agg(F.count(F.lit(1)).alias("n")))
    nearest = asked.groupBy("set_id").agg(F.max(F.struct("n", "pivot")).alias("m")).select("set_id", F.col("m.pivot").alias("pivot"))
    links = verifier.links(_pairs(nearest, "set_id", "pivot").union(_pairs(heads, "head", "top")).distinct())
    labels = connect(links)
    links = links.union(verifier.links(_pairs(_apart(asked, "set_id", "pivot", labels), "set_id", "pivot")))
    labels = connect(links)
    # then the members that were no pivots, where they lie in several components
    live = shared.where("salted or set_id <> pivot").select("base", "set_id").distinct()
    placed = live.join(labels, live["set_id"] == labels["node"], "left").select("base", "set_id", F.coalesce("label", "set_id").alias("label"))
    spread = placed.groupBy("base").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("members"),
        F.bit_xor(F.xxhash64("set_id")).alias("m1"), F.bit_xor(F.xxhash64("set_id", F.lit(1))).alias("m2"), F.min("set_id").alias("m3"), F.max("set_id").alias("m4"),
    ).where("low <> high")
    # keys with the same members ask the same questions: one of them is enough
    spread = spread.groupBy("members", "m1", "m2", "m3", "m4", "low").agg(F.min("base").alias("base"))
    drawn = verifier.classes.select("set_id", "n", "sketch")
    placed = keep(placed.join(spread.select("base", "low", "members"), "base"))
    bases = placed.where(F.col("members") > LARGE).groupBy("set_id").agg(F.array_sort(F.collect_list("base")).alias("bases"))  # at most as many as a set sends keys
    placed = keep(placed.join(drawn.join(bases, "set_id", "left"), "set_id"))
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("set_id"), F.ceil(F.col("members") / BLOCK)))
    member = F.struct("set_id", "label", "n", "sketch", "bases")
    every = dealt.groupBy("base", "block").agg(F.collect_list(member).alias("every"))
    odd = dealt.where("label <> low").groupBy("base", "block").agg(F.collect_list(member).alias("odd"))
    more = verifier.links(every.drop("block").join(odd.drop("block"), "base").select("base", "odd", "every").mapInArrow(released(_across), "a long, b long").distinct())
    if not more.isEmpty():
        labels = connect(links.union(more))
    reached = classes.join(labels, classes["set_id"] == labels["node"], "left").select("set_id", "first_id", F.coalesce("label", "set_id").alias("label"))
    lowest = reached.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_set = reached.join(lowest, "label").select(F.col("set_id").alias("s"), "component_id")
    # the hot side keeps its rows: every row of a class reads the class's one line
    return members.join(by_set, members["set_id"] == by_set["s"], "left").select(
        "doc_id", *keys, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
