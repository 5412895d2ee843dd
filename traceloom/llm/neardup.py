"""MinHash near-duplicate groups with tensored banding (operator 9).

Two small collections of ``GROUPS`` hash groups, each of ``WIDTH`` minhashes, are computed:
A_1..A_m and B_1..B_m. The table keys are all m * m pairs (A_i, B_j), so 2 * m * WIDTH
minhashes serve m * m tables of 2 * WIDTH minhashes each, about the square root of what
independent tables would take. A pair of similarity s meets in some table with
probability (1 - (1 - s^WIDTH)^m)^2: 0.990 at 0.8, 0.997 at 0.85, 0.9999 at 0.9; larger
groups also connect through other members.

Equal sets are one class, and classes alone are compared. A group value that one class
alone has cannot be part of a shared key and goes before keys are formed. In each bucket
leaders are compared with the other members: first the smallest class alone, then, only
in buckets that still hold several components, 256, 4096, ... more, until each pair of a
bucket is in one component or has been compared. Pairs are verified on the full sets.
Before that a bitmap of ``MAP_BITS`` hashed shingles a class bounds their intersection
from above: a bit that one map has alone stands for a shingle that is not shared. The
bound drops no pair that could be linked.
No window or list ever holds a bucket whose members are all linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, read, release, slices
from .components import components
from .hashing import chunks, hash_chunk, mix

GROUPS, WIDTH, SHINGLE = 10, 4, 4
MAP_BITS = 2048
#: Further members of a mixed bucket that are compared with all others first.
LEADERS = 256
#: Ids that may be broadcast to pick texts (8 bytes each); beyond, the join is shuffled.
BROADCAST_IDS = 2_000_000

_rng = np.random.Generator(np.random.PCG64(99))
_A = _rng.integers(1, 2**63, (2 * GROUPS * WIDTH,), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = (_rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1))


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one after another; and their counts."""
    hashes, counts = hash_chunk(texts)
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    rolled = np.zeros(n, np.uint64)
    for i in range(min(words, n)):  # all the texts together may have fewer words than a shingle
        rolled[: n - i] += hashes[i:] * _ODD[i]
    rolled = mix(rolled)
    ends = np.cumsum(counts)
    starts = ends - counts
    # a shingle starts at each word but the last words - 1 of its text
    doc = np.repeat(np.arange(len(texts)), counts)
    full = np.arange(n) + words <= ends[doc]
    value, owner = rolled[full], doc[full]
    short = np.flatnonzero((counts > 0) & (counts < words))
    if short.size:
        whole = np.array([mix(np.array([(int((hashes[a:b] * _ODD[8 : 8 + b - a]).sum()) + int(b - a)) % 2**64], np.uint64))[0] for a, b in zip(starts[short], ends[short])], np.uint64)
        value, owner = np.concatenate([value, whole]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[first], np.bincount(owner[first], minlength=len(texts))


def _sketch(sets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128-bit set hashes (two columns) and the group hashes of texts that have shingles."""
    has = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[has]
    h1, h2 = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    groups = np.zeros((len(counts), 2 * GROUPS), np.uint64)
    if len(has):
        h1[has] = mix(np.add.reduceat(mix(sets + np.uint64(11)), starts)).view(np.int64)
        h2[has] = mix(np.add.reduceat(mix(sets ^ np.uint64(0x5555AAAA)), starts)).view(np.int64)
        for g in range(2 * GROUPS):
            for w in range(WIDTH):
                j = g * WIDTH + w
                x = sets * _A[j]
                x ^= x >> np.uint64(32)
                x *= np.uint64(0x9E3779B97F4A7C15)
                groups[has, g] += np.minimum.reduceat(x, starts) * _ODD[32 + w]
        groups[has] = mix(groups[has])
    return h1, h2, groups.view(np.int64)


def _maps(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A bitmap of hashed shingles for each text, as signed 64-bit words."""
    out = np.zeros((len(counts), MAP_BITS // 64), np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    bit = (sets >> np.uint64(53 - 11)).astype(np.int64) % MAP_BITS
    for a in range(0, len(counts), 512):
        part = slice(*np.searchsorted(owner, [a, a + 512]))
        bits = np.zeros((min(512, len(counts) - a), MAP_BITS), bool)
        bits[owner[part] - a, bit[part]] = True
        out[a : a + 512] = np.packbits(bits, axis=1).view(np.int64)
    return out


def sketches(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, h1, h2, groups, map`` of each input row."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for a, b, held in chunks(batch.column(1).to_pylist(), lower=True):
                sets, counts = shingle_sets(held, shingle)
                h1, h2, groups = _sketch(sets, counts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * 2 * GROUPS, 2 * GROUPS, dtype=np.int32)), pa.array(groups.ravel()))
                words = MAP_BITS // 64
                maps = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * words, words, dtype=np.int32)), pa.array(_maps(sets, counts).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts.astype(np.int64)), pa.array(h1), pa.array(h2), lists, maps], names=["doc_id", "n_shingles", "h1", "h2", "groups", "map"])
        release()

    return rows.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, groups array<bigint>, map array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``c, n, shingles`` of the classes ``wanted (rep, h1, h2, c)``, from the texts of their representatives."""
    ids = wanted.select(F.col("rep").alias("_rep")).distinct()
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).join(ids, F.col("id") == F.col("_rep"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for a, b, held in chunks(batch.column(1).to_pylist(), lower=True):
                sets, counts = shingle_sets(held, shingle)
                h1, h2, _ = _sketch_hashes(sets, counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(h1), pa.array(h2), lists], names=["rep", "h1", "h2", "shingles"])
        release()

    found = rows.mapInArrow(run, "rep long, h1 long, h2 long, shingles array<bigint>")
    found = found.join(wanted.select("rep", "h1", "h2", "c"), ["rep", "h1", "h2"])
    # repeated rows of one id give the same set
    return found.groupBy("c").agg(F.first("shingles").alias("shingles"))


def _sketch_hashes(sets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, None]:
    has = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[has]
    h1, h2 = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    if len(has):
        h1[has] = mix(np.add.reduceat(mix(sets + np.uint64(11)), starts)).view(np.int64)
        h2[has] = mix(np.add.reduceat(mix(sets ^ np.uint64(0x5555AAAA)), starts)).view(np.int64)
    return h1, h2, None


def _relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels of classes after further ``links (a, b)`` between classes; the table before is removed."""
    if labels is None:
        return components(links)
    at = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l_{x}"))
    moved = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b"))
    higher = components(moved)
    # a large group's label is one hot key: few changes are broadcast, so that it is not dealt out
    changes = higher.select(F.col("node").alias("label"), F.col("label").alias("to"))
    old = labels.join(F.broadcast(changes) if higher.count() <= BROADCAST_IDS else changes, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    out = materialize(old.unionByName(higher.join(labels.select("node"), "node", "left_anti")), "labels")
    discard(higher, labels)
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each input row.

    Texts are taken whole; A-Z in lower case; documents are linked where
    100 * intersection >= ``percent`` * union of their shingle sets. Null and wordless
    texts have empty sets and are linked with nothing. A null id has no component and is
    kept. Repeated rows get the same result; of an id with several texts each row goes by
    its own text. Other columns are not read.
    """
    rows = materialize(sketches(docs, id_col=id_col, text_col=text_col, shingle=shingle), "sketches")
    real = rows.where("n_shingles > 0 and doc_id is not null")
    classes = real.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("groups").alias("groups"), F.first("map").alias("map"))
    classes = materialize(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    values = classes.select("c", "n", F.posexplode("groups").alias("g", "v"))
    shared = values.groupBy("g", "v").agg(F.count("*").alias("k")).where("k > 1").select("g", "v")
    # the group values of a class that others have too, then its table keys
    met = values.join(shared, ["g", "v"]).groupBy("c", "n").agg(F.collect_list(F.struct("g", "v")).alias("gv"))
    pick = lambda low: F.filter("gv", lambda x: (x["g"] < GROUPS) if low else (x["g"] >= GROUPS))
    keys = met.select("c", "n", F.explode(pick(True)).alias("x"), pick(False).alias("ys")).select("c", "n", "x", F.explode("ys").alias("y"))
    keys = materialize(keys.select(F.xxhash64("x.g", "x.v", "y.g", "y.v").alias("key"), "c", "n"), "keys")

    least = keys.groupBy("key").agg(F.min(F.struct("c", "n")).alias("lead"), F.count("*").alias("k")).where("k > 1").select("key", F.col("lead.c").alias("a"), F.col("lead.n").alias("na"))
    sized = lambda x, y: (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)
    pairs = keys.join(least, "key").where((F.col("c") > F.col("a")) & sized("n", "na")).groupBy("a", F.col("c").alias("b"), "na", F.col("n").alias("nb")).agg(F.count("*").alias("tables"))
    maps = classes.select("c", "map")
    named = lambda x: maps.select(F.col("c").alias(x), F.col("map").alias(f"m{x}"))

    def possible(na, nb, ma, mb):
        """Whether the maps leave room for a link."""
        alone = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, v: s + v)
        most = F.least(F.col(na) - alone(ma, mb), F.col(nb) - alone(mb, ma))
        return most * (100 + percent) >= (F.col(na) + F.col(nb)) * percent

    met = materialize(pairs, "pairs")
    pairs = materialize(met.join(named("a"), "a").join(named("b"), "b").where(possible("na", "nb", "ma", "mb")).drop("ma", "mb"), "pairs")
    discard(met)

    state: dict = {"labels": None, "sets": None}
    spent = [keys, pairs]  # tables that the result does not read

    def compare(found: DataFrame) -> None:
        """Verify pairs ``(a, b, na, nb)`` on their full sets, and take their links in."""
        found = materialize(found, "compare")
        spent.append(found)
        if found.isEmpty():
            return
        need = found.select(F.col("a").alias("c")).unionByName(found.select(F.col("b").alias("c"))).distinct()
        if state["sets"] is not None:
            need = need.join(state["sets"].select("c"), "c", "left_anti")
        wanted = materialize(classes.select("rep", "h1", "h2", "c").join(need, "c", "left_semi"), "wanted")
        if not wanted.isEmpty():
            more = materialize(_sets(docs, wanted, id_col, text_col, shingle), "sets")
            spent.append(more)
            state["sets"] = more if state["sets"] is None else state["sets"].unionByName(more)
        sets = state["sets"]
        both = found.join(sets.select(F.col("c").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("c").alias("b"), F.col("shingles").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        links = materialize(both.where(common * 100 >= (F.col("na") + F.col("nb") - common) * percent).select("a", "b"), "links")
        if not links.isEmpty():
            state["labels"] = _relabel(state["labels"], links)
        discard(wanted, links)

    def apart(found: DataFrame) -> DataFrame:
        """Those of the pairs that are in different components so far."""
        if state["labels"] is None:
            return found
        at = lambda x: state["labels"].select(F.col("node").alias(x), F.col("label").alias(f"l_{x}"))
        both = found.join(at("a"), "a", "left").join(at("b"), "b", "left")
        return both.where(F.coalesce("l_a", "a") != F.coalesce("l_b", "b")).drop("l_a", "l_b")

    # each class with the leader that it meets in most tables, then with its other leaders
    first = pairs.groupBy("b").agg(F.max(F.struct("tables", (-F.col("a")).alias("a"), "na", "nb")).alias("p"))
    compare(first.select((-F.col("p.a")).alias("a"), "b", F.col("p.na").alias("na"), F.col("p.nb").alias("nb")))
    compare(apart(pairs.select("a", "b", "na", "nb")))
    # further leaders where a bucket still holds several components
    done, step = 1, LEADERS
    while True:
        labels = state["labels"]
        now = keys if labels is None else keys.join(labels.select(F.col("node").alias("c"), "label"), "c", "left")
        now = now.withColumn("label", F.coalesce("label", "c")) if labels is not None else now.withColumn("label", F.col("c"))
        mixed = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("k")).where((F.col("lo") < F.col("hi")) & (F.col("k") > done + 1)).select("key", "k")
        ranked = now.join(mixed, "key").withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("c")))
        open_ = materialize(ranked.join(maps, "c"), "open")
        spent.append(open_)
        if open_.isEmpty():
            break
        lead = open_.where((F.col("r") > done) & (F.col("r") <= done + step)).select("key", F.col("c").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"), F.col("r").alias("ra"), F.col("map").alias("ma"))
        rest = open_.join(lead, "key").where((F.col("r") > F.col("ra")) & (F.col("label") != F.col("la")) & sized("n", "na") & possible("na", "n", "ma", "map"))
        compare(rest.select("a", F.col("c").alias("b"), "na", F.col("n").alias("nb")).distinct())
        if open_.where(F.col("k") > done + step).isEmpty():
            break  # all pairs of these buckets have been compared
        done, step = done + step, step * 16

    discard(*spent)
    reps = classes.select("c", "h1", "h2", "rep")
    if state["labels"] is not None:
        labels = state["labels"].select(F.col("node").alias("c"), "label")
        smallest = labels.join(reps, "c").groupBy("label").agg(F.min("rep").alias("root"))
        smallest = F.broadcast(smallest) if state["labels"].count() <= BROADCAST_IDS else smallest
        reps = reps.join(labels, "c", "left").join(smallest, "label", "left")
    else:
        reps = reps.withColumn("root", F.lit(None).cast("long"))
    reps = reps.select("h1", "h2", F.coalesce("root", "rep").alias("root"))
    out = rows.select("doc_id", "n_shingles", "h1", "h2").join(reps, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    return near_duplicates(read(spark, sf_dir, "documents"))
