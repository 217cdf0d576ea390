"""Near duplicates by fast similarity sketching, banding and exact verification.

Each text's set of word shingles is sketched in T coordinates. In round r every
shingle is hashed to a bin and offers the value (r, hash); a bin keeps its least
value, so rounds go on only while a bin is empty. Rounds T to 2T-1 send every
shingle to the bin of their own number: all coordinates fill, and the number of
equal coordinates of two sketches concentrates around T times the Jaccard
similarity as it does when sampling without replacement.

Bands of ROWS coordinates give candidates. A pair at the threshold shares no band
with a probability of 5e-8 (0.8, 32 bands of 4). Every candidate is confirmed on
the full sets. Within a band's bucket, members are first held against one of them
only, the centre; buckets whose members are by then one component are done, and the
pairs of the rest are held against each other wherever their components differ.
So no pair of a component is built twice and no pair that could join two
components is left out, however large a bucket is.

Edges: a null text, or one without words, has no shingles, links with nothing and
is its own component. Equal sets are collapsed before sketches are compared. Rows
with one doc_id are rows of their own: the id is only reported. A null doc_id is
never the least of a component unless all are null. Repeated rows get equal
results. Ties, equal sets, share everything but the id. A very long text is sketched
whole. An empty table gives an empty table; other columns, whatever their names, are
carried (keep_first) or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm import words
from granary.llm.graph import components
from granary.llm.sieve import maybe
from granary.llm.storage import Scratch, fresh

T = 128
ROWS = 4
#: Coordinates of the sketch of texts that meet others in a band but are no link of a centre.
FINE = 1024
_MASK = np.uint64((1 << 52) - 1)
_SALT = words.mix(np.arange(1, 2 * FINE + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def sketch(items: np.ndarray, t: int = T) -> np.ndarray:
    """t coordinates, a power of two up to FINE, of a set of at least one 64-bit hash."""
    best = np.full(t, ~np.uint64(0), np.uint64)
    shift = np.uint64(64 - t.bit_length() + 1)
    for r in range(2 * t):
        x = words.mix(items ^ _SALT[r])
        value = (x & _MASK) | np.uint64(r << 52)
        if r < t:
            np.minimum.at(best, (x >> shift).astype(np.int64), value)
            if (best != ~np.uint64(0)).all():
                break
        else:
            best[r - t] = min(best[r - t], value.min())
    return best


def bands(best: np.ndarray) -> np.ndarray:
    acc = np.arange(T // ROWS, dtype=np.uint64)
    for j in range(ROWS):
        acc = words.mix(acc + best[j::ROWS])
    return acc.view(np.int64)


def signature(best: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, 32 coordinates a number."""
    two = (best & np.uint64(3)).reshape(-1, 32)
    return np.bitwise_or.reduce(two << np.arange(0, 64, 2, dtype=np.uint64), axis=1).view(np.int64)


def _names(t: int) -> list[str]:
    return [f"s{t}_{i}" for i in range(t // 32)]


def sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offs = words.text_bytes(column)
    low = words.LOWER[data]
    starts, ends, doc = words.spans(low, offs)
    sh, at = words.shingles(words.hashes(low, starts, ends), doc, len(offs) - 1, k)
    cut = np.searchsorted(at, np.arange(len(offs)))
    return [np.unique(sh[a:b]) for a, b in zip(cut, cut[1:])]


def _key(items: np.ndarray) -> bytes | None:
    """128 bits that stand for a set."""
    if not len(items):
        return None
    return np.array([words.mix(items).sum(dtype=np.uint64), words.mix(items ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]).tobytes()


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """docs: columns doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, 1):
                got = sets(part.column(1), k)
                best = [sketch(x) if len(x) else None for x in got]
                signs = [None if b is None else signature(b) for b in best]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) for x in got], pa.int64()),
                        pa.array([_key(x) for x in got], pa.binary()),
                        *[pa.array([None if x is None else int(x[i]) for x in signs], pa.int64()) for i in range(T // 32)],
                        pa.array([None if b is None else bands(b) for b in best], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n", "ckey", *_names(T), "bands"],
                )

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, ckey binary, {' long, '.join(_names(T))} long, bands array<long>")


def _shown(a: Column, b: Column) -> Column:
    """Coordinates, of 32, that two numbers of a signature show to differ."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def _most(percent: int, t: int) -> int:
    """How many of t coordinates may show a difference in a possible link.

    Two of four bits' values agree by chance, so a coordinate that differs shows in
    3 of 4 cases. The bound lies 5.2 deviations, one case in ten million, above what
    a link at the threshold shows on average.
    """
    q = (1 - percent / 100) * 0.75
    return int(t * q + 5.2 * (t * q * (1 - q)) ** 0.5 + 1)


def _alike(percent: int) -> Column:
    """Whether rows x and y (suffixes of n and the signature) can be a link by size and by sketch."""
    shown = [_shown(F.col(f"{s}x"), F.col(f"{s}y")) for s in _names(T)]
    return (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")) & (sum(shown[1:], shown[0]) <= _most(percent, T))


def _side(rows: DataFrame, side: str) -> DataFrame:
    """rows with the side put after each column name but `key`, and ckey named as the side."""
    return rows.select(*[F.col(c).alias({"key": "key", "ckey": side}.get(c, f"{c}{side}")) for c in rows.columns])


def _by_key(part: pa.RecordBatch, column: int, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The sets of the distinct keys of a column, whose texts are two columns on, and each row's place among them."""
    at = np.asarray(part.column(column).dictionary_encode().indices)
    _, first = np.unique(at, return_index=True)
    return sets(part.column(column + 2).take(pa.array(first)), k), at


def _fine(texts: DataFrame, k: int) -> DataFrame:
    """(ckey, text) to (ckey, signature of FINE coordinates)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, 1):
                signs = [signature(sketch(x, FINE)) for x in sets(part.column(1), k)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(signs, pa.list_(pa.int64()))], names=["ckey", "fine"])

    return texts.mapInArrow(run, "ckey binary, fine array<long>")


def _confirm(pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (x, y, tx, ty) whose full sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, 2):
                for sub in words.slices(part, 3):
                    (own, at), (other, to) = (_by_key(sub, c, k) for c in (0, 1))
                    good = []
                    for i, j in zip(at, to):
                        both = len(np.intersect1d(own[i], other[j], assume_unique=True))
                        good.append(100 * both >= percent * (len(own[i]) + len(other[j]) - both))
                    yield sub.filter(pa.array(good, pa.bool_())).select(["x", "y"])

    return pairs.mapInArrow(run, "x binary, y binary")


def _texts(docs: DataFrame, rows: DataFrame, wanted: DataFrame, k: int, scratch: Scratch, label: str) -> DataFrame:
    """(ckey, text), one for each wanted ckey."""
    ids = rows.join(wanted, "ckey", "left_semi").groupBy("ckey").agg(F.min("doc_id").alias("id"))
    ids = scratch.save(ids, f"{label}-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, 1):
                own = [_key(x) for x in sets(part.column(1), k)]
                yield part.filter(pa.array([a == b for a, b in zip(own, part.column(0).to_pylist())], pa.bool_()))

    # the other documents' texts are not dealt out
    some = maybe(docs, F.xxhash64("doc_id"), ids, F.xxhash64("id"))
    found = some.join(ids, F.col("doc_id").eqNullSafe(F.col("id"))).select("ckey", "text").mapInArrow(run, "ckey binary, text string")
    return found.groupBy("ckey").agg(F.min("text").alias("text"))


def _verified(near: DataFrame, rows: DataFrame, docs: DataFrame, scratch: Scratch, label: str, k: int, percent: int) -> DataFrame:
    """The pairs (x, y) of ckeys that are links."""
    wanted = near.select("x").unionByName(near.select(F.col("y").alias("x"))).distinct().withColumnRenamed("x", "ckey")
    texts = scratch.save(_texts(docs, rows, wanted, k, scratch, label), f"{label}-texts")
    full = near.join(texts.toDF("x", "tx"), "x").join(texts.toDF("y", "ty"), "y").select("x", "y", "tx", "ty")
    out = scratch.save(_confirm(full, k, percent), f"{label}-links")
    scratch.drop(f"{label}-texts")
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs; kept marks the least id of a component."""
    scratch = Scratch(docs.sparkSession, "neardup")
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = scratch.save(sketches(docs, k), "sketches")
    rows = found.select("doc_id", "n", "ckey")
    slim = ["n", *_names(T)]
    reps = found.where("ckey is not null").groupBy("ckey").agg(*[F.first(c).alias(c) for c in (*slim, "bands")])
    reps = scratch.save(reps, "reps")
    member = reps.select(F.explode("bands").alias("key"), "ckey")
    several = member.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = scratch.save(member.join(several, "key"), "shared")

    # the centre of a bucket is its member that meets most others over all bands: of copies, the least edited
    typical = shared.groupBy("ckey").agg(F.sum("size").alias("score"))
    shared = scratch.save(shared.join(typical, "ckey").select("key", "ckey", "score"), "scored")
    centre = shared.groupBy("key").agg(F.max(F.struct("score", "ckey")).alias("c")).select("key", F.col("c.ckey").alias("low"))
    star = shared.join(centre, "key").where("ckey <> low").select(F.least("low", "ckey").alias("x"), F.greatest("low", "ckey").alias("y")).distinct()
    own = reps.select("ckey", *slim)
    near = star.join(_side(own, "x"), "x").join(_side(own, "y"), "y").where(_alike(percent)).select("x", "y")
    near = scratch.save(near, "star")
    links = _verified(near, rows, docs, scratch, "one", k, percent)
    edges = links.select(F.col("x").alias("a"), F.col("y").alias("b"))
    roots = scratch.save(components(edges, scratch, "one-cc"), "one-roots")

    placed = shared.select("key", "ckey").join(roots, F.col("ckey") == F.col("node"), "left").select("key", "ckey", F.coalesce("root", "ckey").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    open_ = scratch.save(placed.join(mixed, "key").join(own, "ckey").select("key", "ckey", "root", *slim), "open")
    own_keys = open_.groupBy("ckey").agg(F.collect_list("key").alias("keys"))  # T / ROWS at most
    fine = scratch.save(_fine(_texts(docs, rows, own_keys, k, scratch, "fine"), k), "fine")
    open_ = scratch.save(open_.join(own_keys, "ckey").join(fine, "ckey"), "keyed")
    # the join itself weighs each pair of a bucket; only pairs that can be links leave it, and each from one bucket
    apart = (F.col("x") < F.col("y")) & (F.col("rootx") != F.col("rooty")) & _alike(percent)
    apart = apart & (F.array_min(F.array_intersect("keysx", "keysy")) == F.col("key"))
    apart = apart & (F.aggregate(F.zip_with("finex", "finey", _shown), F.lit(0), lambda a, b: a + b) <= _most(percent, FINE))
    rest = _side(open_, "x").join(_side(open_, "y").withColumnRenamed("key", "key_"), (F.col("key") == F.col("key_")) & apart)
    rest = scratch.save(rest.select("x", "y").distinct().join(near, ["x", "y"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = _verified(rest, rows, docs, scratch, "two", k, percent)
        if not more.isEmpty():
            # the stars of the first round stand for its links
            edges = roots.toDF("a", "b").unionByName(more.select(F.col("x").alias("a"), F.col("y").alias("b")))
            roots = scratch.save(components(edges, scratch, "two-cc"), "two-roots")
    for name in ("reps", "shared", "scored", "star", "open", "fine", "keyed", "rest"):
        scratch.drop(name)

    least = rows.where("ckey is not null").groupBy("ckey").agg(F.min("doc_id").alias("least"))
    least = least.join(roots, F.col("ckey") == F.col("node"), "left").select("ckey", "least", F.coalesce("root", "ckey").alias("root"))
    least = scratch.save(least, "least")
    ids = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("ckey", "component_id")
    out = rows.join(ids, "ckey", "left")
    component = F.when(F.col("ckey").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, as they are, without near duplicates: of each component one row stays, that of least (doc_id, hash of its text).

    Rows that repeat both are copies as well, and one of them stays; rows without
    words all stay, and so do other rows of a null or repeated doc_id.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    key = F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"))
    found = near_duplicates(docs.select(key.alias("doc_id"), F.col(text).alias("text")), k, percent)
    found = found.where("n_shingles > 0").groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1")
    own, of, kept, row = (fresh(docs, f"near_{n}") for n in ("own", "of", "kept", "row"))
    found = scratch.save(found.select("doc_id", "kept"), "found").toDF(of, kept)
    # the other rows are not dealt out
    alone, some = (maybe(docs, F.xxhash64(key), found, F.xxhash64(of), wanted) for wanted in (False, True))
    met = some.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), key.alias(own)).join(found, F.col(own).eqNullSafe(F.col(of)), "left")
    single = met.where(F.col(kept).isNull()).select(row)
    # of equal rows one is picked as they combine, before they are dealt out
    again = met.where(kept).groupBy(own).agg(F.first(row).alias(row)).select(row)
    back = [F.col(row).getField(c).alias(c) for c in docs.columns]
    return alone.unionByName(single.select(*back)).unionByName(again.select(*back))
