"""Keyword search over unit names by an index of character runs.

The index files each unit under every run of one, two and three characters of its lower-cased name, and
under the empty run. A keyword's fixed parts (between ``%`` and ``_``) give runs that a hit must have:
all runs of three of a part, or the part itself if it is shorter; a keyword of wildcards alone, or an
empty one, has the empty run. The rarest few of them are looked up, their posting lists intersected, and
the names of what is left are compared with the exact pattern, so hits are those of
``expressions.contains_ci`` whatever the keyword.

Stored below ``root``: ``postings`` (run, unit_id), split into parts by a hash of the run and sorted
by run, ``runs`` (how many units each has), and ``names`` split by a hash of the unit. A search reads the
parts that its keywords' rarest runs fall in and the names' parts that hold candidates. At most
``parts`` small numbers reach the driver for that. Runs that very many units have are chosen only for
keywords that have no rarer one; what a join does with them Spark splits while running.

A short name has many runs and sorted postings take few bytes, so neither files nor shuffled bytes say how many
rows a task makes of them. Names and candidates are dealt to tasks by the number of rows that follows from the names'
lengths and from the counts in ``runs``; a file of postings holds a bounded number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlab.plans.durable import freeze

_ESCAPE = "\x01"
_LONGEST = 3
# Rows of (run, unit) or (keyword, unit) that meet in one task, some 130 bytes each while they are told apart.
ROWS_PER_TASK = 1 << 18


def runs_of(text: Column, size: int) -> Column:
    """All runs of ``size`` characters."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1)))
    found = F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))
    return F.coalesce(found, F.array().cast("array<string>"))


def name_runs(name: Column) -> Column:
    low = F.lower(name)
    each = [F.array(F.lit("")), *(runs_of(low, size) for size in range(1, _LONGEST + 1))]
    return F.array_distinct(F.concat(*each))


def keyword_runs(keyword: Column) -> Column:
    """Runs that the name of every hit has."""
    fixed = F.filter(F.split(F.lower(keyword), "[%_]"), lambda part: part != "")
    runs = F.flatten(
        F.transform(
            fixed, lambda part: F.when(F.length(part) < _LONGEST, F.array(part)).otherwise(runs_of(part, _LONGEST))
        )
    )
    return F.when(F.size(runs) > 0, F.array_distinct(runs)).otherwise(F.array(F.lit("")))


def matches(name: Column, keyword: Column) -> Column:
    """Case-insensitive LIKE '%keyword%' with a keyword from a column."""
    word = F.replace(F.lower(keyword), F.lit(_ESCAPE), F.lit(_ESCAPE * 2))
    return F.like(F.lower(name), F.concat(F.lit("%"), word, F.lit("%")), F.lit(_ESCAPE))


@dataclass(frozen=True)
class NameIndex:
    """An index below ``root``; ``parts`` stays the same for its life."""

    root: str
    parts: int = 64
    most_runs: int = 3  # looked up per keyword

    def _path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def _part(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.parts)).cast("int").alias("part")

    def named(self, units: DataFrame) -> DataFrame:
        """Units with id and name, dealt by unit before their runs are made: equal runs of one are in one task."""
        own = units.where("unit_id IS NOT NULL AND name IS NOT NULL").select(
            F.col("unit_id").cast("bigint").alias("unit_id"), "name"
        )
        most = F.sum(1 + _LONGEST * F.length("name").cast("bigint"))
        return own.repartition(self._tasks(own, most), "unit_id")

    def build(self, units: DataFrame) -> None:
        """Write the index of the units' names; units without id or name are left out."""
        own = self.named(units)
        postings = own.select(F.explode(name_runs(F.col("name"))).alias("run"), "unit_id").distinct()
        for table, rows, order in (
            ("postings", postings.select("*", self._part("run")), ["run", "unit_id"]),
            ("names", own.distinct().select("*", self._part("unit_id")), ["unit_id"]),
        ):
            # One file a part where they are small; a part that is large is split.
            laid = rows.hint("rebalance", "part").sortWithinPartitions("part", *order)
            laid.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_TASK).partitionBy("part").parquet(
                self._path(table)
            )
        stored = self._read(units, "postings", "run string, unit_id bigint, part int")
        stored.groupBy("run").agg(F.count(F.lit(1)).alias("units")).write.mode("overwrite").parquet(
            self._path("runs")
        )

    @staticmethod
    def _tasks(rows: DataFrame, made: Column) -> int:
        """Tasks for the rows that ``made`` adds up."""
        return max(1, -(-(rows.agg(made.alias("made")).first()["made"] or 0) // ROWS_PER_TASK))

    def _read(self, near: DataFrame, table: str, schema: str) -> DataFrame:
        return near.sparkSession.read.schema(schema).parquet(self._path(table))

    def _pruned(self, table: DataFrame, wanted: DataFrame) -> DataFrame:
        """The folders of ``table`` that ``wanted`` (with its ``part``) falls in."""
        found = [r["part"] for r in wanted.select("part").distinct().collect()]
        return table.where(F.col("part").isin(found))

    def chosen_runs(self, keywords: DataFrame) -> DataFrame:
        """(keyword, run, part, needs, units): the rarest runs of each keyword; none if one is in no name."""
        asked = keywords.where("keyword IS NOT NULL").select("keyword").distinct()
        runs = asked.select("keyword", F.explode(keyword_runs(F.col("keyword"))).alias("run"))
        counts = self._read(keywords, "runs", "run string, units bigint")
        known = runs.join(counts, "run", "left")
        of = Window.partitionBy("keyword")
        return (
            known.withColumn("_missing", F.bool_or(F.col("units").isNull()).over(of))
            .withColumn("_n", F.row_number().over(of.orderBy("units", "run")))
            .where(~F.col("_missing") & (F.col("_n") <= self.most_runs))
            .withColumn("needs", F.count(F.lit(1)).over(of))
            .select("keyword", "run", self._part("run"), "needs", "units")
        )

    def search(self, keywords: DataFrame) -> DataFrame:
        """(keyword, unit_id, name) for every different keyword and every unit that it finds."""
        chosen = freeze(self.chosen_runs(keywords))
        postings = self._read(keywords, "postings", "run string, unit_id bigint, part int")
        candidates = freeze(
            self._pruned(postings, chosen)
            .join(chosen, ["part", "run"])
            .select("keyword", "unit_id", "needs")
            .repartition(self._tasks(chosen, F.sum("units")), "keyword", "unit_id")
            .groupBy("keyword", "unit_id")
            .agg(F.count(F.lit(1)).alias("_n"), F.first("needs").alias("needs"))
            .where("_n = needs")
            .select("keyword", "unit_id", self._part("unit_id"))
        )
        names = self._read(keywords, "names", "unit_id bigint, name string, part int")
        found = candidates.join(self._pruned(names, candidates), ["part", "unit_id"])
        return found.where(matches(F.col("name"), F.col("keyword"))).select("keyword", "unit_id", "name")


def indexed_unit_search(index: NameIndex, keywords: DataFrame, search: DataFrame) -> DataFrame:
    """Rows of a ``unit_search`` without keyword for each keyword that finds them."""
    return index.search(keywords).select("keyword", "unit_id").join(search, "unit_id")
