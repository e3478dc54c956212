"""Mix sources to target weights: an exact budget of words for each source, epochs repeated where it needs more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteflux.llm.common import join_small, keep, n_words, shuffle_partitions, text_of, unwrapped, wrapped

#: Weights by the source's place in code-point order, repeating.
CYCLE = (1, 2, 3)
MAX_EPOCHS = 3
SEED = 20_011


def mixing_key(seed: int = SEED) -> Column:
    """The place of a document in the random order: it depends on its id and text alone, so that reruns agree."""
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def source_targets(sizes: DataFrame, budget: float | None = None, cycle=CYCLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of the sources, from one row (``source``, ``source_size``) per source.

    ``budget`` (default: all sizes) is shared by weight. A target above ``max_epochs`` times its source stops
    there and the excess is shared again among the others. The fixed point is found in one pass: in the order of
    size by weight the sources that stop come first, so each source is tested against the share that would be
    left if all before it had stopped. The windows run over one row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    named = sizes.withColumn("weight", F.element_at(weights, (F.pmod(place - 1, F.lit(len(cycle))) + 1).cast("int")))
    named = named.withColumn("_most", F.col("source_size") * float(max_epochs))
    order = Window.orderBy(F.col("_most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    total = F.lit(float(budget)) if budget is not None else F.sum("source_size").over(whole).cast("double")
    left = total - F.coalesce(F.sum("_most").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    named = named.withColumn("_level", left / weight_left)
    named = named.withColumn("_stops", F.col("weight") * F.col("_level") >= F.col("_most"))
    # the level of the first source that does not stop holds for all after it
    first = F.min(F.when(~F.col("_stops"), F.struct(F.col("_most") / F.col("weight"), "source", "_level"))).over(whole)
    level = first["_level"]
    target = F.when(level.isNull(), F.col("_most")).otherwise(F.least(F.col("_most"), F.col("weight") * level))
    return named.select("source", "source_size", "weight", target.alias("target"))


def mixing_cuts(docs: DataFrame, budget: float | None = None, cycle=CYCLE, max_epochs: int = MAX_EPOCHS, seed: int = SEED):
    """The slim rows (``source, _key, doc_id, size``) in range order, and one row per source that says where it is cut.

    A source's budget is its target in whole words. It is taken as ``epochs`` whole passes and a part of one more,
    that part in the order of the random key: documents before ``cut_key`` are in it, and the documents at the
    cut give ``cut_words`` of their ``cut_size`` words.
    """
    slim = docs.select("source", mixing_key(seed).alias("_key"), "doc_id", n_words(text_of()).alias("size"))
    # ranges of (source, key): a large source is spread over many tasks; each task then holds a sorted run
    slim = slim.repartitionByRange(shuffle_partitions(docs), F.col("source").asc_nulls_last(), "_key")
    slim = slim.sortWithinPartitions(F.col("source").asc_nulls_last(), "_key")
    slim = keep(slim.withColumn("_range", F.spark_partition_id()), "mixing_order")
    ranges = keep(slim.groupBy("source", "_range").agg(F.sum("size").alias("_words")), "mixing_ranges")
    sizes = ranges.groupBy("source").agg(F.sum("_words").alias("source_size"))
    targets = source_targets(sizes, budget, cycle, max_epochs)
    take = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(take / F.col("source_size"))).otherwise(0).cast("long")
    part = F.col("_take") - F.col("epochs") * F.col("source_size")
    targets = targets.withColumn("_take", take).withColumn("epochs", passes).withColumn("_part", part)
    targets = keep(targets, "mixing_targets")
    # prefix sums over the ranges of a source: as many rows as tasks
    run = Window.partitionBy("source").orderBy("_range")
    ranges = ranges.withColumn("_before", F.sum("_words").over(run) - F.col("_words"))
    ranges = join_small(ranges, targets.select("source", "_part"), "source")
    cut = F.col("_part").between(F.col("_before") + 1, F.col("_before") + F.col("_words"))
    cut_ranges = keep(ranges.where(cut).select("source", F.col("_range").alias("_cut"), "_before", "_part"), "mixing_cut")
    # prefix sums inside the one range of each source that holds its cut; equal keys are one step
    inside = join_small(slim, cut_ranges, "source", "inner").where("_range = _cut")
    steps = inside.groupBy("source", "_before", "_part", "_key").agg(F.sum("size").alias("cut_size"))
    upto = F.sum("cut_size").over(Window.partitionBy("source").orderBy("_key"))
    steps = steps.withColumn("_upto", F.col("_before") + upto)
    at = F.col("_part").between(F.col("_upto") - F.col("cut_size") + 1, F.col("_upto"))
    words = (F.col("_part") - F.col("_upto") + F.col("cut_size")).alias("cut_words")
    steps = keep(steps.where(at).select("source", F.col("_key").alias("cut_key"), words, "cut_size"), "mixing_steps")
    return slim, keep(join_small(targets, steps, "source"), "mixing_cuts")


def _extra(size: Column) -> Column:
    """Words of the pass that is cut. Rows with one key share the cut by their sizes."""
    at_cut = F.floor(size * F.col("cut_words") / F.col("cut_size"))
    extra = F.when(F.col("_key") < F.col("cut_key"), size).when(F.col("_key") == F.col("cut_key"), at_cut)
    return F.coalesce(extra, F.lit(0)).cast("long")


def mix_amounts(docs: DataFrame, **settings) -> DataFrame:
    """How much of every document the mix takes: ``doc_id, source, size, source_size, target, taken``.

    ``settings`` are those of :func:`mixing_cuts`. One row per input row. A null text has no words, a null source
    is a source of its own, a null id is an ordinary id; documents without words take nothing. Rows that repeat
    both id and text share a cut by their sizes, rounded down. Texts are read once and never shuffled; nothing but
    counts reaches the driver. Columns of ``docs`` other than ``doc_id, text, source`` are not touched.
    """
    slim, cuts = mixing_cuts(docs, **settings)
    size = F.col("size")
    taken = F.col("epochs") * size + _extra(size)
    return join_small(slim, cuts, "source").select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: documents of every source repeated by whole passes, the one at the cut shortened to its words.

    Returns the columns of ``docs``; a shortened text ends after its last taken word and ``n_chars``, if there,
    follows it. The cuts are one row per source, so the texts stay where they are read.
    """
    _, cuts = mixing_cuts(docs, **settings)
    cuts = cuts.select("source", "epochs", "cut_key", "cut_words", "cut_size")
    out = join_small(wrapped(docs).withColumn("_key", mixing_key(settings.get("seed", SEED))), cuts, "source")
    before, at = F.col("_key") < F.col("cut_key"), F.col("_key") == F.col("cut_key")
    extra = F.when(at, _extra(n_words(text_of())))
    whole = F.array_repeat(F.lit(-1).cast("long"), (F.col("epochs") + F.when(before, 1).otherwise(0)).cast("int"))
    part = F.when(extra > 0, F.array(extra)).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("_copy", F.explode(F.concat(whole, part)))
    # words are counted off in pieces, each with the white space before it
    pieces = F.regexp_extract_all(text_of(), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1)
    cut = F.when(F.col("_copy") >= 0, F.concat_ws("", F.slice(pieces, F.lit(1), F.col("_copy").cast("int"))))
    return unwrapped(out.withColumn("_cut", cut), docs, F.col("_cut"), F.col("_copy") >= 0)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_amounts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken")

