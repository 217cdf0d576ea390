"""Near duplicates by the first-kept rule: an item stays unless an earlier item that stays is alike.

That is the lexicographically first maximal independent set of the similarity graph,
not its connected components. Equal sets are one class, which its least id stands
for. Pairs of classes come from a shingle self-join with an exact prefix filter:
in one order of all shingles, two sets can only reach the threshold if they share one of
their first |S| - ceil(t |S|) + 1, and of these as many as the threshold leaves no choice
about. Any order gives right results. Here it is that of the hashes, but for shingles
that stand in many prefixes, which come last: so only prefixes are counted and dealt
out, a tenth of the sets at 0.9, and whole sets only of the pairs that are left.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from granary.functions import text as T
from granary.functions.similarity import dot, jaccard
from granary.sieve import maybe
from granary.storage import Scratch

#: Open edges that one task settles by itself, some megabytes; more go through another round first.
FEW_EDGES = 200_000
#: Blocks of vectors that meet each other: each vector is dealt out so many times, however many there are; and the vectors of a block at most.
GRID, MOST_VECTORS = 48, 1 << 16
#: Items in more prefixes than MET, and than the MOST_LATE-th part of all prefixes' items, come late in the order, MOST_LATE in each of ROUNDS looks at most.
MET, MOST_LATE, ROUNDS = 16, 1 << 18, 4
#: Numbers of one product of vectors, 32 MB.
PRODUCT = 1 << 22
#: Pairs of vectors that a task hands on at once.
MOST_PAIRS = 1 << 17


def signatures(docs: DataFrame, k: int = 5, key: str = "doc_id", text: str = "text", native: bool = False) -> DataFrame:
    """(key, shingles): the distinct word shingles of the fingerprint form, as hashes."""
    found = T.words(T.fingerprint_form(F.coalesce(F.col(text), F.lit("")), native))
    return docs.select(F.col(key).alias("id"), F.array_distinct(T.let(found, lambda w: _runs(w, k))).alias("items"))


def _runs(words: Column, k: int) -> Column:
    """A hash of each run of k words; fewer words than k: none."""
    if k <= 1:
        return F.transform(words, lambda w: F.xxhash64(w))
    made = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(F.array_join(F.slice(words, i, k), " ")))
    return F.when(F.size(words) < k, F.array().cast("array<bigint>")).otherwise(made)


def classes(signs: DataFrame) -> DataFrame:
    """(id, rep) of each non-empty set: rep is the least id with an equal set."""
    full = signs.where(F.size("items") > 0).select("id", F.explode(F.array(F.sort_array("items"))).alias("items"))
    full = full.select("id", F.size("items").alias("n"), F.xxhash64("items").alias("h1"), F.xxhash64(F.lit(1), "items").alias("h2"))
    least = full.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"))
    return full.join(least, ["n", "h1", "h2"]).select("id", "rep")


def _stars(of: DataFrame) -> DataFrame:
    """classes to (a, b): each member but the rep, after the rep."""
    return of.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))


def pairs(signs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard), a < b: pairs of classes that reach the threshold, by their reps, and each other member with its rep."""
    linked, of = class_pairs(Scratch(signs.sparkSession, "signs").save(signs, "signs"), threshold)
    return linked.unionByName(_stars(of).withColumn("jaccard", F.lit(1.0)))


def _allowed(n: Column, threshold: float) -> Column:
    return n - F.ceil(threshold * n - 1e-9) + 1


def prefixes(signs: DataFrame, threshold: float, late: Broadcast) -> DataFrame:
    """(id, item, n): the first n - ceil(threshold * n) + 1 items of each set of n, in the order of their hashes; those of `late`, sorted numbers, after all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = late.value
        for batch in batches:
            sizes = np.asarray(batch.column(1).value_lengths().fill_null(0), np.int64)
            part = np.maximum(np.cumsum(sizes) - 1, 0) // BITS_ITEMS
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)] if len(sizes) else []
            for a, b in zip(cuts, cuts[1:]):
                n, items = sizes[a:b], np.asarray(batch.column(1).slice(a, b - a).flatten(), np.int64)
                row = np.repeat(np.arange(b - a), n)
                at = np.minimum(np.searchsorted(last, items), max(len(last) - 1, 0))
                order = np.lexsort((items, last[at] == items, row) if len(last) else (items, row))
                place = np.arange(len(items)) - np.repeat(np.cumsum(n) - n, n)
                most = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
                kept = order[place < most[row]]  # rows stay in order
                own = row[kept]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(own)), pa.array(items[kept]), pa.array(n[own].astype(np.int32))], names=["id", "item", "n"])

    return signs.select("id", "items").mapInArrow(run, f"id {signs.schema['id'].dataType.simpleString()}, item long, n int")


def late_items(signs: DataFrame, threshold: float) -> np.ndarray:
    """Items that stand in many prefixes, sorted: found by prefixes that leave out those found before."""
    context, late = signs.sparkSession.sparkContext, np.zeros(0, np.int64)
    rows = signs.where(F.size("items") > 0).agg(F.sum(_allowed(F.size("items"), threshold))).first()[0] or 0
    for _ in range(ROUNDS):
        counts = prefixes(signs, threshold, context.broadcast(late)).groupBy("item").count()
        # MOST_LATE rows at most, by their least count
        found = np.asarray(counts.where(F.col("count") > max(MET, rows // MOST_LATE)).select("item").toArrow().column(0), np.int64)
        more = np.setdiff1d(found, late)
        if not len(more):
            break
        late = np.union1d(late, more)
    return late


def candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of prefixes left (id a) and right (id b) in one order that can reach the threshold, by sizes and by the items that they share."""
    met = left.toDF("a", "item", "na").join(right.toDF("b", "item", "nb"), "item").where(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)
    met = met.groupBy("a", "b").agg(F.count("*").alias("met"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    # what a set lacks of the other is bounded, and of the prefix that ends first all that is shared is in the other's
    least = F.ceil(threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-6)
    need = F.least(*[_allowed(F.col(n), threshold) - (F.col(n) - least) for n in ("na", "nb")])
    return met.where(F.col("met") >= need).select("a", "b")


def weighed(near: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, jaccard) of pairs; left and right: (id, items). Sets of no pair are sieved out before any is dealt out."""
    own = lambda sets, x: maybe(sets, F.xxhash64("id"), near, F.xxhash64(x)).select("id", "items").toDF(x, f"i{x}")
    both = near.join(own(left, "a"), "a").join(own(right, "b"), "b")
    return both.select("a", "b", jaccard(F.size(F.array_intersect("ia", "ib")), F.size("ia"), F.size("ib")).alias("jaccard"))


def class_pairs(signs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(a, b, jaccard), a < b, of the reps of classes that reach the threshold, and classes(signs). signs: a written table, as it is read several times."""
    scratch = Scratch(signs.sparkSession, "pairs")
    of = scratch.save(classes(signs), "classes")
    late = signs.sparkSession.sparkContext.broadcast(late_items(signs, threshold))
    reps = of.where("id = rep").select("id")
    prefix = scratch.save(prefixes(signs, threshold, late).join(reps, "id", "left_semi"), "prefix")
    near = scratch.save(candidates(prefix, prefix, threshold).where("a < b"), "near")
    return weighed(near, signs, signs).where(F.col("jaccard") >= threshold), of


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) to the ids that are dropped, in order of b; for one task."""
    before: dict = {}
    kind = None
    for part in batches:
        kind = part.schema.field(0).type
        for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            a, b = (tuple(x.values()) if isinstance(x, dict) else x for x in (a, b))
            before.setdefault(b, []).append(a)
    lost: set = set()
    for b in sorted(before):
        if any(a not in lost for a in before[b]):
            lost.add(b)
    if kind is not None:
        ids = [dict(zip([f.name for f in kind], x)) if isinstance(x, tuple) else x for x in sorted(lost)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind)], names=["id"])


def first_independent(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """Ids to drop: edges (a, b), a before b, of which the lexicographically first independent set is kept.

    An item all of whose earlier neighbours are dropped is kept; one with a kept
    earlier neighbour is dropped. Each round settles what it can over all components
    and leaves the edges between open items; once no more than `few` are left, a
    size that is checked, one task walks them in order. There is no limit to rounds.
    """
    scratch = Scratch(edges.sparkSession, "independent")
    open_ = scratch.save(edges.select("a", "b").distinct(), "edges-0")
    kept, lost, turn = None, None, 0
    count = open_.count()
    while count > few:
        turn += 1
        later = open_.select(F.col("b").alias("id")).distinct()
        first = open_.select(F.col("a").alias("id")).distinct().join(later, "id", "left_anti")
        first = scratch.save(first, f"first-{turn}")  # no open item before them: kept
        gone = scratch.save(open_.join(first, F.col("a") == F.col("id"), "left_semi").select(F.col("b").alias("id")).distinct(), f"gone-{turn}")
        lost = gone if lost is None else lost.unionByName(gone)
        left = open_.join(gone, F.col("b") == F.col("id"), "left_anti").join(gone, F.col("a") == F.col("id"), "left_anti")
        open_ = scratch.save(left, f"edges-{turn}")
        scratch.drop(f"edges-{turn - 1}")
        count = open_.count()
    rest = open_.coalesce(1).mapInArrow(_walk, f"id {open_.schema['a'].dataType.simpleString()}")
    return rest if lost is None else lost.unionByName(rest)


def deduplicate(docs: DataFrame, threshold: float = 0.90, k: int = 5, key: str = "doc_id", text: str = "text", short_exact: bool = False, native: bool = False) -> DataFrame:
    """(id, kept, reason) in order of id. Empty signatures are all alike: the first stays, and so no clique is built.

    short_exact: texts with fewer than k words are compared whole instead.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    signs = signatures(docs, k, key, text, native)
    if short_exact:
        whole = docs.select(F.col(key).alias("id"), F.array(F.xxhash64(F.array_join(T.words(T.fingerprint_form(F.coalesce(F.col(text), F.lit("")), native)), " "))).alias("whole"))
        signs = signs.join(whole, "id").select("id", F.when(F.size("items") == 0, F.col("whole")).otherwise(F.col("items")).alias("items"))
    signs = scratch.save(signs, "signs")
    linked, of = class_pairs(signs, threshold)
    # what keeps or drops a rep drops the other members of its class, so they have no part in the choice
    drop = first_independent(linked).unionByName(of.where("id <> rep").select("id")).distinct().withColumn("near", F.lit(True))
    first = signs.where(F.size("items") == 0).agg(F.min("id").alias("first"))  # one row
    out = signs.select("id", (F.size("items") == 0).alias("empty")).join(F.broadcast(first)).join(drop, "id", "left")
    lost = F.coalesce("near", F.lit(False)) | (F.col("empty") & (F.col("id") != F.col("first")))
    return out.select("id", (~lost).alias("kept"), F.when(F.coalesce("near", F.lit(False)), F.lit("near")).when(lost, F.lit("empty")).alias("reason"))


def exact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The first row of each distinct text."""
    first = docs.groupBy(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest")).agg(F.min(key).alias("first"), F.count("*").alias("copies"))
    return first.select(F.col("first").alias(key), "copies")


#: Items whose bits are held apart at once, 16 MB; a longer array is one piece.
BITS_ITEMS = 1 << 18


@F.arrow_udf(LongType())
def simhash(items: pa.Array) -> pa.Array:
    """64-bit SimHash of an array of hashes: the majority of each bit. All bits of an empty array, 0 for none."""
    sizes = np.asarray(items.value_lengths().fill_null(0), np.int64)
    bits = np.asarray(items.flatten(), np.int64).view(np.uint8).reshape(-1, 8)
    ends = np.cumsum(sizes)
    out = np.full(len(sizes), -1, np.int64)
    full = np.flatnonzero(sizes)
    part = (ends[full] - 1) // BITS_ITEMS
    for some in np.split(full, np.flatnonzero(np.diff(part)) + 1) if len(full) else []:
        first, starts = ends[some[0]] - sizes[some[0]], ends[some] - sizes[some]
        apart = np.unpackbits(bits[first : ends[some[-1]]], axis=1, bitorder="little")
        counts = np.add.reduceat(apart, starts - first, axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * counts >= sizes[some, None], axis=1, bitorder="little").view(np.int64)[:, 0]
    out[np.asarray(items.is_null())] = 0
    return pa.array(out)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _masks(radius: int) -> list[int]:
    """Bit masks, one of which two fingerprints within the radius agree in: 2 * radius blocks, of which the radius spoils that many at most."""
    if radius == 0:
        return [(1 << 64) - 1]
    edges = [round(i * 64 / (2 * radius)) for i in range(2 * radius + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in itertools.combinations(blocks, radius)]


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def simhash_pairs(signs: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b, distance), a < b, within the radius: pairs of the least ids of each fingerprint, and each other id of it with that one.

    Two fingerprints within the radius agree in half of 2 * radius blocks, so a key is some 32
    bits, and few others share it; a pair comes from its first common key. n copies are n - 1 pairs.
    """
    masks = _masks(radius)
    scratch = Scratch(signs.sparkSession, "simhash")
    # sets are made once: a filter on them would make them again
    rows = scratch.save(signs.select("id", simhash("items").alias("sim"), (F.size("items") > 0).alias("some")), "prints").where("some").select("id", "sim")
    reps = scratch.save(rows.groupBy("sim").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "reps")
    keyed = reps.select(F.col("rep").alias("id"), "sim", F.posexplode(F.array(*[F.col("sim").bitwiseAND(_long(m)) for m in masks])).alias("k", "value"))
    left, right = keyed.toDF("x", "sx", "k", "value"), keyed.toDF("y", "sy", "k", "value")
    apart = F.col("sx").bitwiseXOR(F.col("sy"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(_long(m)) == 0, i) for i, m in enumerate(masks)]) == F.col("k")
    # each fingerprint is a row for each mask, which the size that is estimated for a broadcast does not tell
    near = left.hint("merge").join(right, ["k", "value"]).where((F.col("x") < F.col("y")) & (hamming(F.col("sx"), F.col("sy")) <= radius) & first)
    stars = rows.join(reps.where("n > 1"), "sim").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance"))
    return near.select(F.col("x").alias("a"), F.col("y").alias("b"), hamming(F.col("sx"), F.col("sy")).alias("distance")).unionByName(stars)


def simhash_dedup(signs: DataFrame, radius: int = 3) -> DataFrame:
    """(id, kept) by the first-kept rule over SimHash pairs; a fingerprint's other ids go with what its first one decides."""
    scratch = Scratch(signs.sparkSession, "simhash")
    pairs = scratch.save(simhash_pairs(signs, radius), "pairs")
    copies = pairs.where("distance = 0").select(F.col("b").alias("id"))
    drop = first_independent(pairs.where("distance > 0")).unionByName(copies).distinct().withColumn("near", F.lit(True))
    return signs.select("id").join(drop, "id", "left").select("id", F.col("near").isNull().alias("kept"))


def _planes(dim: int, bits: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((dim, bits))


def semantic_pairs(vectors: DataFrame, same: float = 0.92, cross: float = 0.96, id_: str = "vec_id", vector: str = "embedding", group: str | None = None, exact: bool = True, block: int = 512, bands: int = 48, bits: int = 16, copies: bool = False) -> DataFrame:
    """(a, b, similarity), a < b, of unit vectors whose inner product reaches `same` within a group and `cross` across groups.

    Every vector meets every other, a block of vectors with a block, which costs the square
    of their number and misses nothing. copies: all pairs; else a vector that has an equal one
    before it in its group is linked to the first of these only, and n copies are n - 1 pairs.
    exact=False weighs only pairs with the signs of `bits` random projections in common in one
    of `bands` bands: a pair at 0.92 is missed with a probability of 0.3 %, at 0.96 of 1e-5.
    """
    if copies:
        return _between(_vectors(vectors, id_, vector, group), Scratch(vectors.sparkSession, "semantic"), same, cross, exact, block, bands, bits)
    linked, of = _vector_pairs(vectors, same, cross, id_, vector, group, exact, block, bands, bits)
    return linked.unionByName(_stars(of).join(of.select(F.col("id").alias("b"), "similarity"), "b").select("a", "b", "similarity"))


def _vectors(vectors: DataFrame, id_: str, vector: str, group: str | None) -> DataFrame:
    """(id, v, g)"""
    return vectors.select(F.col(id_).alias("id"), F.col(vector).alias("v"), (F.col(group) if group else F.lit(0)).cast("string").alias("g"))


def _vector_pairs(vectors: DataFrame, same: float, cross: float, id_: str, vector: str, group: str | None, exact: bool, block: int, bands: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of the reps, and (id, rep, similarity): equal vectors of one group are one class, where they reach `same` with themselves."""
    scratch = Scratch(vectors.sparkSession, "semantic")
    rows = _vectors(vectors, id_, vector, group)
    own = rows.select("id", "g", dot(F.col("v"), F.col("v")).alias("similarity"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    least = own.where(F.col("similarity") >= same).groupBy("g", "h1", "h2").agg(F.min("id").alias("rep")).toDF("g_", "k1", "k2", "rep")
    met = own.join(least, F.col("g").eqNullSafe(F.col("g_")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & (F.col("similarity") >= same), "left")
    of = scratch.save(met.select("id", F.coalesce("rep", "id").alias("rep"), "similarity"), "classes")
    return _between(rows.join(of.where("id = rep").select("id"), "id", "left_semi"), scratch, same, cross, exact, block, bands, bits), of


def _in_order(key: object) -> object:
    """What an id compares by: a struct by its fields, null first."""
    return tuple((v is not None, v) for v in key.values()) if isinstance(key, dict) else key


def _between(rows: DataFrame, scratch: Scratch, same: float, cross: float, exact: bool, block: int, bands: int, bits: int) -> DataFrame:
    """(a, b, similarity) of the rows (id, v, g); those without id or vector are in no pair."""
    rows = rows.select("id", "v", "g").where("id IS NOT NULL AND v IS NOT NULL")
    kind = rows.schema["id"].dataType.simpleString()
    if not exact:

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            planes = None
            for batch in batches:
                v = batch.column(1)
                if len(v):
                    x = np.asarray(v.flatten(), np.float64).reshape(len(v), -1)
                    planes = _planes(x.shape[1], bands * bits) if planes is None else planes
                    signs = ((x @ planes) >= 0).reshape(len(v), bands, bits)
                    key = signs @ (1 << np.arange(bits)) + (np.arange(bands) << bits)
                    made = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, bands), pa.int32()), pa.array(key.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([*batch.columns, made], names=["id", "v", "g", "keys"])

        kept = scratch.save(rows.mapInArrow(keys, f"id {kind}, v {rows.schema['v'].dataType.simpleString()}, g string, keys array<long>"), "keys")
        one = kept.select(F.explode("keys").alias("key"), "id")
        met = one.toDF("key", "a").join(one.toDF("key", "b"), "key").where("a < b").select("a", "b").distinct()
        side = lambda s: kept.select(F.col("id").alias(s), F.col("v").alias(f"v{s}"), F.col("g").alias(f"g{s}"))
        both = met.join(side("a"), "a").join(side("b"), "b")
        found = both.select("a", "b", dot(F.col("va"), F.col("vb")).alias("similarity"), F.when(F.col("ga").eqNullSafe(F.col("gb")), same).otherwise(cross).alias("least"))
        return found.where("similarity >= least").drop("least")
    count = rows.count()
    blocks = max(1, min(-(-count // block), max(GRID, -(-count // MOST_VECTORS))))
    # equal shares by hash, so a block has about `block` vectors whatever the ids are
    packed = rows.withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).groupBy("blk").agg(F.collect_list(F.struct("id", "g", "v")).alias("items"))
    packed = scratch.save(packed, "blocks")
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = packed.select(F.col("blk").alias("bx"), F.col("items").alias("x"), F.explode(every).alias("by")).where("bx <= by")
    right = packed.select(F.col("blk").alias("by"), F.col("items").alias("y"), F.explode(every).alias("bx")).where("bx <= by")
    # a block is a row for each other one, which the size that is estimated for a broadcast does not tell
    met = left.hint("merge").join(right, ["bx", "by"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bx, by, x, y in zip(batch["bx"], batch["by"], batch["x"], batch["y"]):
                a, b = (np.array([r["v"] for r in s], np.float64) for s in (x, y))
                ida, idb = (np.array([*(r["id"] for r in s), None], object)[:-1] for s in (x, y))
                ka, kb = (np.array([*map(_in_order, ids), None], object)[:-1] for ids in (ida, idb))
                codes: dict = {}
                ga, gb = (np.array([codes.setdefault(r["g"], len(codes)) for r in s]) for s in (x, y))
                for start in range(0, len(a), step := max(1, PRODUCT // len(b))):
                    sims = a[start : start + step] @ b.T
                    at = np.flatnonzero(sims >= np.where(ga[start : start + step, None] == gb, same, cross))
                    for k in range(0, len(at), MOST_PAIRS):
                        i, j = np.divmod(at[k : k + MOST_PAIRS], len(b))
                        p, q = ida[start + i], idb[j]
                        less, more = (ka[start + i] < kb[j]).astype(bool), (ka[start + i] > kb[j]).astype(bool) & (bx != by)
                        some = less | more
                        yield pd.DataFrame({"a": np.where(less, p, q)[some], "b": np.where(less, q, p)[some], "similarity": sims[i, j][some]})

    return met.select("bx", "by", "x", "y").mapInPandas(run, f"a {kind}, b {kind}, similarity double")


def semantic_dedup(vectors: DataFrame, same: float = 0.92, cross: float = 0.96, id_: str = "vec_id", vector: str = "embedding", group: str | None = None, exact: bool = True) -> DataFrame:
    """(id, kept): the same first-kept rule over vector pairs."""
    linked, of = _vector_pairs(vectors, same, cross, id_, vector, group, exact, 512, 48, 16)
    drop = first_independent(linked).unionByName(of.where("id <> rep").select("id")).distinct().withColumn("near", F.lit(True))
    return vectors.select(F.col(id_).alias("id")).join(drop, "id", "left").select("id", F.col("near").isNull().alias("kept"))
