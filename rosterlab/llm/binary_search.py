"""Exact nearest binary codes by incremental multi-index hashing.

A vector's code has a bit for each of its dimensions, set where the value is positive. Codes are cut into
segments, as many as it takes for a segment to have some log2(entries) bits, and filed under each
segment's value. Two codes that differ in fewer than ``m * (r + 1)`` bits agree up to ``r`` bits in
some of the ``m`` segments, so the search looks up all values at segment distance 0, 1, 2, …; after
each radius every code up to a known distance has been seen. A query is done when its kth distance,
worked out on whole codes, is within it.

Equal codes are one entry with their smallest ids, so a vector that a third of the rows share is
one code. A pair is taken only at the step that finds it first, and only the best ``k + 1`` codes
of a query are carried on, which a ranking cuts before anything is shuffled.

A null vector has no code: it is neither found nor asked. A shorter vector's missing dimensions and null
entries count as not positive. Equal distances are ordered by id. Rows that share id and code are one
row, which does not find itself; a row with its id and another code is another row. If there are fewer
than ``k`` other rows, all are returned; an empty table gives no rows. Joins of the steps are sort-merge
joins by hint: the small steps would otherwise leave many broadcast tables in the driver.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlab.llm.common import stored

CODE = "array<bigint>"


@dataclass(frozen=True)
class Search:
    k: int = 10
    first_radius: int = 1  # the first step looks up all segment distances up to this
    least_width: int = 4
    most_width: int = 22  # bits of a segment; a step looks up no more values than it has


@dataclass(frozen=True)
class Cut:
    """Codes of ``bits`` bits in segments of ``width`` bits, the last of which may be shorter."""

    bits: int
    width: int

    @property
    def segments(self) -> int:
        return max(1, ceil(self.bits / self.width))

    @staticmethod
    def of(bits: int, entries: int, how: Search) -> Cut:
        wanted = min(how.most_width, max(how.least_width, round(log2(max(2, entries)))))
        return Cut(bits, ceil(bits / max(1, ceil(bits / wanted))) or 1)


def codes(vectors: DataFrame, cut: Cut) -> DataFrame:
    """vec_id and code: the values of the segments."""
    marks = F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0")), "")
    line = F.rpad(marks, cut.bits, "0")
    code = F.array(
        *[
            F.conv(F.substring(line, i * cut.width + 1, cut.width), 2, 10).cast("bigint")
            for i in range(cut.segments)
        ]
    )
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), code.alias("code")).distinct()


def segment_distances(a: str, b: str, cut: Cut) -> list[Column]:
    return [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(cut.segments)]


def masks(width: int, radii: range) -> Column:
    """All numbers of ``width`` bits with so many bits set, as an array."""
    found = (
        sum(1 << i for i in at) for r in radii for at in itertools.combinations(range(width), r)
    )
    return F.split(F.lit(",".join(map(str, found))), ",").cast("array<bigint>")


def steps(cut: Cut, how: Search) -> list[tuple[range, int]]:
    """(segment distances looked up, distance that is then covered)."""
    ends = [*range(min(how.first_radius, cut.width), cut.width + 1)]
    begins = [0, *(r + 1 for r in ends[:-1])]
    covered = [cut.segments * (r + 1) - 1 for r in ends[:-1]] + [cut.bits]
    return [(range(a, z + 1), c) for a, z, c in zip(begins, ends, covered, strict=True)]


def filed(code: str, cut: Cut) -> Column:
    """(number, value) of each segment of a code, to be exploded."""
    return F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("number"), F.col(code)[i].alias("value"))
                for i in range(cut.segments)
            ]
        )
    )


def _best(pairs: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("distance", "first_id")
    return pairs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def nearest_codes(queries: DataFrame, index: DataFrame, rows: int, cut: Cut, how: Search) -> DataFrame:
    """The ``k + 1`` nearest entries of each query code: query, code, first_id, n, distance."""
    spark, width, most = queries.sparkSession, cut.width, how.k + 1
    schema = f"query {CODE}, code {CODE}, first_id bigint, n bigint, distance int"
    state = spark.createDataFrame([], schema)
    active = queries.select("query", F.lit(cut.bits).alias("worst"))
    entries = stored(index.select("*", filed("code", cut).alias("s")).select("*", "s.*").drop("s"), "filed")
    # A pair is taken in the segment in which it is nearest, the first of several.
    apart = segment_distances("query", "code", cut)
    distance = sum(apart[1:], apart[0])
    ranked = [d * cut.segments + i for i, d in enumerate(apart)]
    nearest_segment = F.least(*ranked) % cut.segments if cut.segments > 1 else F.lit(0)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done: list[DataFrame] = []
    for radii, covered in steps(cut, how):
        # The open queries are a small table; the values they look up are not.
        probes = (
            active.repartition(tasks, "query")
            .select("query", "worst", filed("query", cut).alias("s"))
            .select("query", "worst", "s.*", F.explode(masks(width, radii)).alias("_mask"))
            .withColumn("value", F.col("value").bitwiseXOR(F.col("_mask")))
        )
        new = (
            probes.join(entries.hint("merge"), ["number", "value"])
            .where(F.col("number") == nearest_segment)
            .withColumn("distance", distance)
            .where("distance <= worst")
            .select("query", "code", "first_id", "n", "distance")
        )
        # Only the best of the step meet the best so far.
        merged = state.join(active.select("query").hint("merge"), "query", "left_semi").union(_best(new, most))
        state = stored(_best(merged, most), "nearest")
        figures = state.groupBy("query").agg(
            F.sum(F.when(F.col("distance") <= covered, F.col("n")).otherwise(0)).alias("sure"),
            F.sum("n").alias("seen"),
            F.max("distance").alias("far"),
            F.count(F.lit(1)).alias("entries"),
        )
        ready = (F.col("sure") >= most) | (F.col("seen") >= rows) | F.lit(covered >= cut.bits)
        figures = stored(
            active.select("query").join(figures.hint("merge"), "query", "left").select(
                "query",
                F.coalesce(ready, F.lit(covered >= cut.bits)).alias("ready"),
                F.when(F.col("entries") >= most, F.col("far")).otherwise(cut.bits).alias("worst"),
            ),
            "active",
        )
        done.append(state.join(figures.where("ready").hint("merge"), "query", "left_semi"))
        active = figures.where("NOT ready").select("query", "worst")
        if active.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def nearest(vectors: DataFrame, asked: Column, how: Search | None = None) -> DataFrame:
    """query_id, rank, vec_id, distance of the ``k`` nearest others of each row where ``asked``."""
    how = how or Search()
    size = F.max(F.size("embedding")).alias("d")
    shape = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").agg(size, F.count(F.lit(1)).alias("n")).first()
    cut = Cut.of(max(1, shape["d"] or 0), shape["n"], how)
    all_codes = stored(codes(vectors, cut), "codes")
    order = Window.partitionBy("code").orderBy("vec_id")
    few = all_codes.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= how.k + 1)
    index = stored(
        few.groupBy("code").agg(
            F.min("vec_id").alias("first_id"),
            F.count(F.lit(1)).alias("n"),
            F.sort_array(F.collect_list("vec_id")).alias("ids"),
        ),
        "index",
    )
    queries = all_codes.where(asked).select(F.col("vec_id").alias("query_id"), F.col("code").alias("query"))
    best = nearest_codes(
        queries.select("query").distinct(), index.drop("ids"), all_codes.count(), cut, how
    )
    near = best.join(index.select("code", "ids"), "code").select(
        "query", "code", "distance", F.explode("ids").alias("vec_id")
    )
    by_code = Window.partitionBy("query").orderBy("distance", "vec_id", "code")
    top = near.withColumn("_n", F.row_number().over(by_code)).where(F.col("_n") <= how.k + 1)
    # At most k + 1 rows, so a query drops itself and still has k.
    found = F.struct("distance", "vec_id", "code")
    lists = top.groupBy("query").agg(F.sort_array(F.collect_list(found)).alias("l"))
    itself = lambda x: (x["distance"] == 0) & (x["vec_id"] == F.col("query_id"))
    others = F.slice(F.filter("l", lambda x: ~itself(x)), 1, how.k)
    return (
        queries.join(lists, "query")
        .select("query_id", F.posexplode(others).alias("rank", "x"))
        .select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.distance")
    )
