"""Exact top-k search among binary codes by incremental multi-index hashing (operator 1).

A code of ``bits`` bits is cut into ``m`` segments of at most about log2(number of codes)
bits, and each segment's values are an index: a value leads to its codes, in lists of about
``LIST`` codes however many share the value. A query probes all segments at radius 0, 1, 2,
...: if its segments differ in more than s bits each, two codes are more than
m * (s + 1) - 1 apart. So after radius s everything up to that distance has been seen,
and a query is finished once its kth verified distance is at most that. Only unfinished
queries go on.

A pair of query and code is met at radius min(segment distances) alone, in the first
segment with that distance, so nothing has to be made distinct. Equal codes are one
entry with the ``k + 1`` smallest ids, which is all that a list of k neighbours can need;
a code that a third of all rows share is no larger than others.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, read

K = 10
#: Codes in one list of the index, about.
LIST = 256
#: Bit patterns that may be broadcast; beyond, the join is shuffled.
BROADCAST_PATTERNS = 200_000


def sign_code(vector: Column, bits: int = 64) -> Column:
    """Bit i is set where component i is above 0. Null for null, empty or non-finite vectors."""
    from_bits = F.aggregate(
        F.transform(F.slice(vector, 1, bits), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x),
    )
    sound = (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(sound, from_bits)


def segments(bits: int, n: int) -> list[tuple[int, int]]:
    """(first bit, length) of each segment: at most about log2(n) bits each, all bits covered."""
    m = max(1, min(bits, math.ceil(bits / max(1.0, math.log2(max(n, 2))))))
    cuts = [bits * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _segment(code: Column, at: int, length: int) -> Column:
    return F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << length) - 1 if length < 64 else -1))


def _patterns(spark, cuts: list[tuple[int, int]], radius: int) -> DataFrame:
    """``seg, mask`` of all patterns of ``radius`` bits in each segment: each further bit is above those before it."""
    out = spark.createDataFrame([(i, w, 0, 0) for i, (_, w) in enumerate(cuts)], "seg int, width int, mask long, low int")
    for _ in range(radius):
        out = out.where("low < width").select("seg", "width", "mask", F.explode(F.sequence(F.col("low"), F.col("width") - 1)).alias("bit"))
        out = out.select("seg", "width", F.col("mask").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("mask"), (F.col("bit") + 1).alias("low"))
    out = out.select("seg", "mask")
    return F.broadcast(out) if sum(math.comb(w, radius) for _, w in cuts) <= BROADCAST_PATTERNS else out


def search(rows: DataFrame, *, id_col: str = "vec_id", code_col: str = "code", is_query: Column | None = None, k: int = K, bits: int = 64) -> DataFrame:
    """The ``k`` nearest other rows of each query: ``query_id, rank, <id>, distance``.

    Ties go to the smaller id. Rows with a null id or code take no part. Repeated ids:
    the smallest code is the query, rows of its own id are never its neighbours, and otherwise
    each row counts. All
    candidates come if fewer than ``k`` exist. ``is_query`` tells the queries (default:
    ids divisible by 100). Other columns are not read; an empty table gives no rows.
    """
    spark = rows.sparkSession
    asked = F.col(f"`{id_col}`") % 100 == 0 if is_query is None else is_query
    base = materialize(rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{code_col}`").cast("long").alias("code"), asked.alias("q")).where("id is not null and code is not null"), "mih-codes")
    least = Window.partitionBy("code").orderBy("id")
    distinct = base.groupBy("code", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    some = distinct.withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1)
    index = materialize(some.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("ids")), "mih-index")
    n = index.count()
    total = base.count()
    cuts = segments(bits, n)
    m = len(cuts)
    entries = index.select("code", "ids", F.posexplode(F.array(*(_segment(F.col("code"), a, w) for a, w in cuts))).alias("seg", "value"))
    lists = entries.groupBy("seg", "value").agg(F.ceil(F.count("*") / LIST).alias("lists"))
    dealt = entries.join(lists, ["seg", "value"]).withColumn("list", F.pmod(F.xxhash64("code"), "lists"))
    buckets = materialize(dealt.groupBy("seg", "value", "list").agg(F.collect_list(F.struct("code", "ids")).alias("codes")).drop("list"), "mih-buckets")
    active = base.where("q").groupBy(F.col("id").alias("query_id")).agg(F.min("code").alias("qcode")).withColumn("within", F.lit(bits))
    schema = "query_id long, qcode long, code long, ids array<struct<id bigint, n int>>, d int"
    best = spark.createDataFrame([], schema)
    finished: list[DataFrame] = []
    nearest = Window.partitionBy("query_id").orderBy("d", F.col("ids")[0]["id"])
    for s in range(max(w for _, w in cuts) + 1):
        table = _patterns(spark, cuts, s)
        values = active.select("query_id", "qcode", "within", F.posexplode(F.array(*(_segment(F.col("qcode"), a, w) for a, w in cuts))).alias("seg", "v"))
        probes = values.join(table, "seg").select("query_id", "qcode", "within", "seg", F.col("v").bitwiseXOR(F.col("mask")).alias("value"))
        met = probes.join(buckets, ["seg", "value"])

        def near(x: Column) -> Column:
            apart = F.col("qcode").bitwiseXOR(x["code"])
            each = [F.bit_count(_segment(apart, a, w)) for a, w in cuts]
            # in this segment first: no other is nearer, and none before it as near
            first = reduce(lambda a, b: a & b, (F.when(F.lit(i) < F.col("seg"), e > s).otherwise(e >= s) for i, e in enumerate(each)))
            return (F.bit_count(apart) <= F.col("within")) & first

        # what is farther than k verified ones stays in its list
        new = met.select("query_id", "qcode", F.explode(F.filter("codes", near)).alias("x")).select("query_id", "qcode", "x.code", "x.ids")
        new = new.withColumn("d", F.bit_count(F.col("qcode").bitwiseXOR(F.col("code"))).cast("int"))
        top = best.unionByName(new).withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k + 1).drop("r")
        best = materialize(top, "mih-best")
        # rows that a query has found: its own id is not a neighbour
        others = F.aggregate(F.filter("ids", lambda x: x["id"] != F.col("query_id")), F.lit(0), lambda acc, x: acc + x["n"])
        at_most = m * (s + 1) - 1
        state = best.groupBy("query_id").agg(F.sum(F.when(F.col("d") <= at_most, others).otherwise(0)).alias("sure"), F.sum(others).alias("seen"), F.max("d").alias("last"))
        done = state.where((F.col("sure") >= k) | (F.col("seen") >= total - 1)).select("query_id")
        finished.append(best.join(done, "query_id", "left_semi"))
        bound = state.select("query_id", F.when(F.col("seen") >= k, F.col("last")).otherwise(bits).alias("now"))
        left = active.join(done, "query_id", "left_anti").join(bound, "query_id", "left")
        active = materialize(left.select("query_id", "qcode", F.coalesce("now", "within").alias("within")), "mih-active")
        best = best.join(active.select("query_id"), "query_id", "left_semi")
        if active.isEmpty():
            break
    finished.append(best)
    discard(index, buckets)
    found = reduce(DataFrame.unionByName, finished)
    each_row = found.select("query_id", "d", F.explode("ids").alias("x")).where("x.id <> query_id")
    each_row = each_row.select("query_id", "d", F.explode(F.array_repeat("x.id", F.col("x.n"))).alias("id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "id"))
    return each_row.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), F.col("d").alias("distance"))


def query(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest others of each vector whose id is divisible by 100, by the signs of its first 64 components.

    Null, empty and non-finite vectors take no part.
    """
    return search(read(spark, sf_dir, "embeddings").select("vec_id", sign_code(F.col("embedding")).alias("code")))


ORACLE = """
WITH c AS (SELECT vec_id, (SELECT sum(CASE WHEN embedding[i] > 0 THEN 1::HUGEINT << (i - 1)::INT ELSE 0 END) FROM range(1, 65) t(i)) AS code
           FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code, c.code))::INT AS distance FROM c q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id))::INT AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
