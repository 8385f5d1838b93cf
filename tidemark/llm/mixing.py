"""Mixing sources to target weights.

A source's size is the number of words of its documents.  The sources, in
order of their names (by code point, null last), have the weights ``WEIGHTS``
in turn; by weight they share ``share`` times all words, but no source gets
more than ``most`` times its own: its target stops there and the excess is
shared again by weight until none is above.  The shares that result are

    target = least(most * size, level * weight)

for the one ``level`` at which the targets sum to the total, which is found
from running sums over the sources in order of size / weight.

A document is emitted floor(rate) times, rate = target / size of its source,
plus once more with probability equal to the fraction f: it is, if a number in
[0, 1) made from the md5 of the seed, the document's id and its text lies
below.  Rows that repeat id, text and source have one such number; n of them are
emitted once more n * f times in all, rounded down or, as their number says, up.
Reruns agree: which of the repeated rows it is makes no difference.

All of it is DataFrame expressions.  Texts are read once for their word
counts; sizes are aggregated per source before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_no, lookup, numbered, ordered, stored, word_count

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2.0, "mix-1"


def uniform(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an md5."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(16 ** 13))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size)."""
    total = share * (sizes.agg(F.sum("source_size")).first()[0] or 0)
    ranked = ordered(sizes, ["source"], {}, "mix-sources")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", weight.alias("w")).withColumn("ratio", F.lit(most) * F.col("source_size") / F.col("w"))
    # Sources whose cap lies below the level come first in order of their ratio.
    steps = ordered(ranked, ["ratio", "source"], {"size_before": "source_size", "w_before": "w"}, "mix-steps")
    w_all = F.lit(ranked.agg(F.sum("w")).first()[0] or 0)
    level = (F.lit(total) - F.lit(most) * F.col("size_before")) / (w_all - F.col("w_before"))
    # The first source in that order whose cap is not below the level that its predecessors leave.
    found = steps.withColumn("level", level).where("level <= ratio").agg(F.min_by("level", "pos")).first()[0]
    target = F.lit(most) * F.col("source_size")
    if found is not None:
        target = F.when(F.col("ratio") < found, target).otherwise(F.lit(found) * F.col("w"))
    return steps.select("source", "source_size", target.cast("double").alias("target"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
           share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """``docs`` with columns renamed by position (``numbered``) plus mix_size,
    mix_source_size, mix_target and mix_copies, the times each row is emitted.

    Null texts have size 0 and null sources are one source; a source without words
    has target 0 and none of its documents is emitted.  An empty table stays empty.
    """
    at = {c: column_no(docs, c) for c in (id_col, text_col, source_col)}
    text, source = F.col(at[text_col]), F.col(at[source_col])
    rows = numbered(docs).withColumns({"mix_size": word_count(text), **_drawn(seed, F.col(at[id_col]), text, source)})
    narrow = stored(rows.select(source.alias("mix_from"), "mix_size", "mix_key"), "mix-rows")
    return _planned(rows, source, narrow, weights, share, most)


def _drawn(seed: str, doc_id: Column, text: Column, source: Column) -> dict[str, Column]:
    """The number of a row, and what tells repeated rows."""
    md5 = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return {"mix_u": uniform(seed, doc_id, md5), "mix_key": F.xxhash64(F.isnull(doc_id), doc_id, md5, F.isnull(source), source)}


def _repeats(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """``rows`` with mix_n, how many repeat a row, and mix_k, which of them it is (from
    0).  Rows that repeat are few or one large group: they alone are sorted, by range."""
    groups = stored(narrow.groupBy("mix_key").agg(F.count("*").alias("mix_n")).where("mix_n > 1"), "mix-repeats")
    none = F.lit(0).cast("long").alias("mix_k")
    if not groups.limit(1).count():
        return rows.select("*", F.lit(1).cast("long").alias("mix_n"), none)
    rows = lookup(rows, groups, ["mix_key"])
    again = stored(rows.where("mix_n is not null").withColumn("mix_tie", F.monotonically_increasing_id()), "mix-repeated")
    again = ordered(again, ["mix_key", "mix_tie"], {}, "mix-repeated-order")
    starts = stored(again.groupBy("mix_key").agg(F.min("pos").alias("mix_first")), "mix-repeated-starts")
    again = lookup(again, starts, ["mix_key"]).withColumn("mix_k", F.col("pos") - F.col("mix_first")).drop("pos", "mix_first", "mix_tie")
    once = rows.where("mix_n is null").withColumn("mix_n", F.lit(1).cast("long")).select("*", none)
    return once.unionByName(again)


def _planned(rows: DataFrame, source: Column, narrow: DataFrame, weights, share: float, most: float) -> DataFrame:
    """``rows`` with their plan; ``narrow`` has their mix_from (source), mix_size and mix_key."""
    sizes = narrow.groupBy(F.col("mix_from").alias("source")).agg(F.sum("mix_size").alias("source_size"))
    plan = stored(source_targets(stored(sizes, "mix-sizes"), weights, share, most), "mix-targets")
    # An equi-join wants no nulls: the null source goes by its flag.
    plan = plan.select(F.isnull("source").alias("mix_none"), F.coalesce("source", F.lit("")).alias("mix_source"),
                       F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    rows = _repeats(rows, narrow).withColumns({"mix_none": F.isnull(source), "mix_source": F.coalesce(source, F.lit(""))})
    rows = lookup(rows, plan, ["mix_none", "mix_source"], "inner")
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    more = F.col("mix_n") * (rate - F.floor(rate))  # of the repeated rows together
    more = F.floor(more) + (F.col("mix_u") < more - F.floor(more)).cast("long")
    times = F.floor(rate) + (F.col("mix_k") < more).cast("long")
    return rows.withColumn("mix_copies", times).drop("mix_none", "mix_source", "mix_u", "mix_key", "mix_n", "mix_k")


def plan_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
               share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """(id, size, source_size, target, copies) for every row, from one reading of the texts."""
    at = {c: column_no(docs, c) for c in (id_col, text_col, source_col)}
    rows = numbered(docs)
    text = F.col(at[text_col])
    drawn = _drawn(seed, F.col(at[id_col]), text, F.col(at[source_col]))
    rows = rows.select(F.col(at[id_col]).alias("id"), F.col(at[source_col]).alias("mix_from"), word_count(text).alias("mix_size"),
                       *[c.alias(n) for n, c in drawn.items()])
    rows = stored(rows, "mix-rows")
    rows = _planned(rows, F.col("mix_from"), rows, weights, share, most)
    return rows.select("id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                       F.col("mix_target").alias("target"), F.col("mix_copies").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as its source's rate asks for."""
    rows = copies(docs, **options)
    kept = [f"c{i}" for i in range(len(docs.columns))]
    rows = rows.where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))))
    return rows.select(*kept).toDF(*docs.columns)
