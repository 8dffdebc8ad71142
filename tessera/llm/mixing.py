"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each row has the key ``-ln(u) / quality`` with ``u`` from a hash of the row: sorted by it, a
source is a weighted sample without replacement of any length. A source whose target is several
times its size gives that many complete epochs first; the rest of its token budget goes to the
rows at the head of the key order whose running sum stays within it (a row counts when its middle
does, so the sum ends within half a row of the budget).

No window runs over a source: rows fall into ranges of the key, so many that each holds about
``RANGE_ROWS`` rows, and sums of the ranges tell in which one the budget ends. Only that range is
sorted, to find the last row taken; every row then compares itself with its source's cut. Rows alike
in key and text share a place in the order: they are counted as one before any shuffle, and when the
budget ends among them, the first of them by number are taken, found from counts of the written
table's parts and the order of one part. Targets come from water-filling over the source table (one
row a source).

Null texts count as empty and have the least quality; a null source is a source, the last one;
null keys are told apart by their texts. Of rows alike in both, any may be the ones taken.
An empty table gives an empty result. Texts are read once: the measures are written, and so are the
rows themselves where the mix returns them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage, spread

WORD = r"[^\x20\x09-\x0D]+"
RANGE_ROWS = 10_000
LEAST_QUALITY = 0.05
DIVERSE = 64
MAX_EPOCHS = 3
# Sources up to which their table is broadcast.
BROADCAST_SOURCES = 50_000


def quality_weight(text: Column, words: Column) -> Column:
    """Share of letters times the share of distinct words (of ``DIVERSE``), at least 0.05."""
    visible = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    distinct = F.size(F.array_distinct(words)) / F.least(F.size(words), F.lit(DIVERSE))
    weight = letters / visible * F.least(distinct, F.lit(1.0))
    return F.when(F.size(words) > 0, F.greatest(weight, F.lit(LEAST_QUALITY))).otherwise(F.lit(LEAST_QUALITY))


def uniform(key: Column, text: Column, seed: str) -> Column:
    """A number in (0, 1) from the row's key and text."""
    digest = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"),
                            text).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(2 ** 52))


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
             carry: list[str] | None = None, seed: str = "mix") -> DataFrame:
    """Per row: key, ``carry`` columns, ``_source``, ``_size``, ``_quality``, sampling key ``_key`` and a number ``_at``.

    Numbers hold in a written table only.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    kept = [F.col(c) for c in (carry or [key])]
    rows = spread(docs).select(
        *kept, F.col(source).alias("_source"), body.alias("_body"), uniform(F.col(key), body, seed).alias("_u"),
        F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("_words"))
    rows = rows.withColumn("_quality", quality_weight(F.col("_body"), F.col("_words")))
    return rows.select(*(carry or [key]), "_source", F.size("_words").cast("long").alias("_size"), "_quality",
                       (-F.log("_u") / F.col("_quality")).alias("_key"), F.monotonically_increasing_id().alias("_at"))


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``_source, _source_size, _rows`` and ``_target``: shares by weight, none above ``max_epochs`` sizes.

    Sources in code point order, null last, weigh 1, 2, 3, repeating. In order of size per weight, a
    source is held at its limit when the even share of what is left would exceed it.
    """
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    weighed = sizes.withColumn("_weight", (F.row_number().over(order) - 1) % 3 + 1).withColumn(
        "_limit", max_epochs * F.col("_source_size"))
    fill = Window.orderBy(F.col("_limit") / F.col("_weight"), F.col("_source").asc_nulls_last())
    through, whole = fill.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    left = weighed.withColumn(
        "_words_left", F.sum("_source_size").over(whole) - F.coalesce(F.sum("_limit").over(through), F.lit(0))
    ).withColumn("_weight_left", F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(through), F.lit(0)))
    held = left.withColumn("_held", F.col("_limit") * F.col("_weight_left") <= F.col("_weight") * F.col("_words_left"))
    rest = held.withColumn(
        "_rest", F.sum("_source_size").over(whole) - F.sum(F.when(F.col("_held"), F.col("_limit")).otherwise(0)).over(whole)
    ).withColumn("_rest_weight", F.sum(F.when(F.col("_held"), 0).otherwise(F.col("_weight"))).over(whole))
    share = F.col("_weight") * F.col("_rest").cast("double") / F.col("_rest_weight")
    return rest.select("_source", "_source_size", "_rows",
                       F.when(F.col("_held"), F.col("_limit").cast("double")).otherwise(share).alias("_target"))


def cutoffs(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per source ``_name, _source_size, _target, _epochs``, ``_cut``, the last place taken once more, and ``_number``, to which
    its rows are taken.

    ``rows`` are ``measured`` rows; they are read several times, so they should be a written table.
    Only the range of each source in which the budget ends is sorted.
    """
    sizes = rows.groupBy("_source").agg(F.sum("_size").alias("_source_size"), F.count(F.lit(1)).alias("_rows"))
    whole = F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(F.lit(0))
    sources = cut_lineage(targets(sizes).withColumn("_epochs", whole).withColumn(
        "_budget", F.col("_target") - F.col("_epochs") * F.col("_source_size")).withColumnRenamed("_source", "_name"),
        "mixing-targets")
    places = rows.groupBy("_source", "_key", key, "_size").agg(F.count(F.lit(1)).alias("_alike"))
    at = F.floor(F.ceil(F.col("_rows") / RANGE_ROWS) * (1 - F.exp(-0.8 * F.col("_key")))).cast("long")
    same = F.col("_source").eqNullSafe(F.col("_name"))
    dealt = places.join(small(sources), same).withColumn("_range", at).withColumn("_words", F.col("_size") * F.col("_alike"))
    before = (Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_name", "_range", "_budget").agg(F.sum("_words").alias("_words_in")).withColumn(
        "_start", F.coalesce(F.sum("_words_in").over(
            Window.partitionBy("_name").orderBy("_range").rowsBetween(*before)), F.lit(0)))
    last = sums.filter((F.col("_start") < F.col("_budget")) & (F.col("_start") + F.col("_words_in") >= F.col("_budget")))
    last = last.select(F.col("_name").alias("_of"), F.col("_range").alias("_last"), "_start")
    ends = dealt.join(last, F.col("_name").eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_last")))
    inside = Window.partitionBy("_name", "_range").orderBy("_key", key, "_size").rowsBetween(*before)
    start = F.col("_start") + F.coalesce(F.sum("_words").over(inside), F.lit(0))
    # The n-th of the rows of a place is taken if 2 * (start + (n - 1) * size) + size <= 2 * budget.
    reach = F.floor((2 * (F.col("_budget") - start) + F.col("_size")) / (2 * F.greatest("_size", F.lit(1))))
    taken = ends.withColumn("_many", F.greatest(F.lit(0), F.least(reach, "_alike")))
    # Where no row of the last range is taken, the cut lies at the end of the range before it.
    cut = taken.groupBy("_of").agg(
        F.max(F.when(F.col("_many") > 0, F.struct(_place(key).alias("place"), "_many", "_alike"))).alias("_inside"),
        F.min(_place(key)).alias("_first"))
    cuts = sources.join(cut, F.col("_name").eqNullSafe(F.col("_of")), "left").select(
        "_name", "_source_size", "_target", "_epochs", F.coalesce("_inside.place", "_first").alias("_cut"),
        F.coalesce("_inside._many", F.lit(0)).alias("_many"), F.coalesce("_inside._alike", F.lit(0)).alias("_alike"))
    cuts = cut_lineage(cuts, "mixing-places")
    numbers = _last_numbers(rows, cuts.filter("_many > 0 and _many < _alike"), key)
    every = F.when(F.col("_many") > 0, F.lit(2 ** 63 - 1)).otherwise(F.lit(-1))
    return cuts.join(numbers, F.col("_name").eqNullSafe(F.col("_of")), "left").select(
        "_name", "_source_size", "_target", "_epochs", "_cut", F.coalesce("_number", every).alias("_number"))


def _last_numbers(rows: DataFrame, cuts: DataFrame, key: str) -> DataFrame:
    """``_of, _number``: the ``_many``-th smallest number of a source's rows at the cut.

    A number's high bits tell the task that wrote it. Counts of these tasks say in which one the row lies, and only
    its rows are ordered.
    """
    split = cuts.select("_name", F.col("_cut").alias("_end"), F.col("_many").alias("_wanted"))
    alike = rows.join(small(split), F.col("_source").eqNullSafe(F.col("_name")) & (_place(key) == F.col("_end"))).select(
        "_name", "_wanted", "_at", F.shiftright("_at", 33).alias("_part"))
    before = Window.partitionBy("_name").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = alike.groupBy("_name", "_wanted", "_part").agg(F.count(F.lit(1)).alias("_held")).withColumn(
        "_passed", F.coalesce(F.sum("_held").over(before), F.lit(0)))
    parts = parts.filter("_passed < _wanted and _passed + _held >= _wanted").select(
        F.col("_name").alias("_of"), F.col("_part").alias("_in"), "_passed")
    inside = alike.join(parts, F.col("_name").eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_in"))).withColumn(
        "_nth", F.col("_passed") + F.row_number().over(Window.partitionBy("_name").orderBy("_at")))
    return inside.filter("_nth = _wanted").select("_of", F.col("_at").alias("_number"))


def _place(key: str) -> Column:
    return F.struct(F.col("_key").alias("at"), F.col(key).alias("id"), F.col("_size").alias("size"))


def small(table: DataFrame) -> DataFrame:
    """A written table with a broadcast hint if it has at most ``BROADCAST_SOURCES`` rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table


def decide(rows: DataFrame, cuts: DataFrame, key: str = "doc_id") -> DataFrame:
    """``measured`` rows with ``_source_size``, ``_target`` and ``_copies``, how often the mix takes the row."""
    met = rows.join(small(cuts), F.col("_source").eqNullSafe(F.col("_name")), "left")
    place = _place(key)
    extra = (place < F.col("_cut")) | ((place == F.col("_cut")) & (F.col("_at") <= F.col("_number")))
    copies = F.col("_epochs") + F.coalesce(extra & (F.col("_size") > 0), F.lit(False)).cast("long")
    return met.withColumn("_copies", copies.cast("long")).drop("_name", "_cut", "_number", "_epochs", "_at")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
          seed: str = "mix") -> DataFrame:
    """Per row key, measures and ``_copies``. The measures are written once, so texts are read once."""
    rows = cut_lineage(measured(docs, key, text, source, None, seed), "mixing")
    return decide(rows, cut_lineage(cutoffs(rows, key), "mixing-cuts"), key)


def mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
            seed: str = "mix") -> DataFrame:
    """The rows of the mix themselves, each as often as it is taken, with the columns of ``docs``."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_id"), F.col(text).alias("_text"),
                         F.col(source).alias("_origin"))
    rows = cut_lineage(measured(packed, "_id", "_text", "_origin", ["_id", "_row"], seed), "mixing")
    cuts = cut_lineage(cutoffs(rows, "_id"), "mixing-cuts")
    return decide(rows, cuts, "_id").filter(F.col("_copies") > 0).select(
        "_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select("_row.*")
