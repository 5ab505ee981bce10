"""Mixing sources to target weights by capped water-filling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.columns import WORD, as_id
from tallyloom.shared import cut

#: Hash buckets of a source: sums over them stand in for its documents, so no window holds a whole source.
BUCKETS = 1 << 16
#: Buckets that are summed as one at first, so that no task orders more than BUCKETS / STEP or STEP sums of a source.
STEP = 1 << 8
#: Sources up to which their plan (some 100 bytes each) is broadcast, and tasks that share one source beyond.
MOST_SOURCES, SALTS = 10_000, 64


def words_in(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_order(sources: DataFrame) -> DataFrame:
    """sources with place, from 0: in order of code points, null last. No task orders all of them: ranges are ordered, and counts of ranges added."""
    order = [F.col("source").isNull(), F.col("source")]
    ranged = cut(sources.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return ranged.join(before, "range").withColumn("place", inside + F.col("before")).drop("range", "before")


def water_fill(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """(source, source_size, target, goal): sources is (source, source_size), one row per source.

    Sources in order of code points, null last, get the weights in turn and share `share` times all words. A source
    stops at `epochs` times its own size and what it can't take goes to the others by weight, until none is above:
    each round clamps the sources above the level of the last one and finds the level that the rest of the words
    gives to the others, one row of sums a round. No round after the level stays.
    """
    turn = F.array(*map(F.lit, weights))
    weight = F.element_at(turn, (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    s = in_order(sources).withColumn("weight", weight).withColumn("cap", (F.col("source_size") * F.lit(epochs)).cast("double")).withColumn("fill", F.col("cap") / F.col("weight"))
    s = cut(s, "mix-sources")
    level, words = -1.0, (s.agg(F.sum("source_size").alias("n")).first().n or 0) * share
    while True:
        free = F.col("fill") > level
        sums = s.agg(F.sum(F.when(free, F.col("weight"))).alias("weight"), F.sum(F.when(~free, F.col("cap"))).alias("clamped")).first()
        found = (words - (sums.clamped or 0.0)) / sums.weight if sums.weight else None
        if found is None or found == level:
            break
        level = found
    target = F.col("cap") if found is None else F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return s.withColumn("target", target).select("source", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("goal"))


def ends_in(sums: DataFrame, rests: DataFrame) -> DataFrame:
    """(source, at, need): where, in the order of at, the words of a source first come to its rest, and what is needed there. sums: (source, at, words)."""
    running = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    found = before.join(rests.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).filter("before < rest and before + words >= rest")
    return found.select("source", "at", (F.col("rest") - F.col("before")).alias("need"))


def meet(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs joined to the plan of their source: the plan is broadcast if it is small, else each source is dealt over SALTS tasks."""
    same = F.col("source").eqNullSafe(F.col("s"))
    if plan.count() <= MOST_SOURCES:
        return docs.join(F.broadcast(plan), same)
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.join(salted, same & (F.col("bucket") % SALTS == F.col("salt"))).drop("salt")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    epochs: int = 2,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of docs: (doc_id, size, source_size, target, taken).

    A source whose target is w whole repetitions and a rest takes every document w times; the rest goes to documents in
    seeded order of the md5 of seed and id, the last of them in part, so a source's words come to its target, rounded.
    A document takes at most `epochs` times its size.

    Sums by (source, bucket of that order) are aggregated before they are shuffled, and tell in which bucket the rest
    ends; only that bucket's documents are put in order. The sources' plan meets documents by broadcast up to
    MOST_SOURCES sources, beyond that in a salted join. Reruns agree: nothing depends on partitions.

    Nulls: a null text has size 0; a null source is a source of its own, the last; a null id hashes as empty. Empty
    text: size 0, takes 0. Very long text: counted whole, may be the one that is taken in part. Ties in the order
    (repeated rows): they are equal rows, so either may come first. Empty table: no rows. Other columns are ignored.
    """
    d = docs.select(as_id(docs, id_col), words_in(docs[text_col]).alias("size"), docs[source_col].cast("string").alias("source"))
    sized = cut(d.withColumns(seeded(F.col("doc_id"), seed)), "mix-sized")
    return taken(sized, plan_of(sized, weights, share, epochs)).select("doc_id", "size", "source_size", "target", "taken")


def seeded(ident: Column, seed: str) -> dict[str, Column]:
    """digest and bucket of a document: its place in the seeded order."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))))
    return {"digest": digest, "bucket": F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")}


def plan_of(sized: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """(s, source_size, target, times, end, need): what each source s takes, from (source, bucket, size) of its documents."""
    buckets = cut(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    sources = water_fill(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, epochs)
    plan = sources.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0).cast("long")).withColumn(
        "rest", F.col("goal") - F.col("times") * F.col("source_size")
    )
    # the rest ends in one bucket: found among STEP-wide ranges of buckets, then among that range's
    coarse = ends_in(buckets.groupBy("source", F.floor(F.col("bucket") / STEP).cast("int").alias("at")).agg(F.sum("words").alias("words")), plan.select("source", "rest"))
    inner = coarse.select(F.col("source").alias("in_source"), F.col("at").alias("range"), F.col("need").alias("rest"))
    fine = buckets.join(inner, F.col("source").eqNullSafe(F.col("in_source")) & (F.floor(F.col("bucket") / STEP) == F.col("range"))).select("source", F.col("bucket").alias("at"), "words")
    last = ends_in(fine, inner.select(F.col("in_source").alias("source"), "rest")).select(F.col("source").alias("ends_in"), F.col("at").alias("end"), "need")
    plan = plan.join(last, F.col("source").eqNullSafe(F.col("ends_in")) & F.col("end").isNotNull(), "left")
    return cut(plan.select(F.col("source").alias("s"), "source_size", "target", "times", "end", "need"), "mix-plan")


def taken(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """sized (doc_id, size, source, digest, bucket and more) with its source's plan and taken, the words that the mix takes of it."""
    joined = meet(sized, plan)
    at_end = F.coalesce(F.col("bucket") == F.col("end"), F.lit(False))
    inside = Window.partitionBy("source").orderBy("digest", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("need") - F.coalesce(F.sum("size").over(inside), F.lit(0))))
    whole = F.col("times") * F.col("size")
    far = joined.filter(~at_end).withColumn("taken", (whole + F.when(F.col("bucket") < F.col("end"), F.col("size")).otherwise(0)).cast("long"))
    return far.unionByName(joined.filter(at_end).withColumn("taken", (whole + part).cast("long")))


def repeat_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    epochs: int = 2,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: every row of docs, all columns, as often as `mix` takes it.

    A document that takes part of its words beyond whole repetitions (one per source at most) gives one more row with
    that many first words, joined by one space; an n_chars column follows the text. Documents that take nothing go.
    Rows are neither shuffled nor joined by id: each meets its source's plan and takes its own words, but for the few
    of the one bucket in which its source's rest ends. Nulls, empty and very long texts, ties, repeated rows and empty
    tables as in `mix`; columns keep their names, whatever they are.
    """
    sized = docs.select(as_id(docs, id_col), words_in(docs[text_col]).alias("size"), docs[source_col].cast("string").alias("source"), F.struct(*docs.columns).alias("row"))
    sized = sized.withColumns(seeded(F.col("doc_id"), seed))
    plan = plan_of(cut(sized.select("source", "bucket", "size"), "mix-sized"), weights, share, epochs)
    d = taken(sized, plan).filter("taken > 0").select("row", "size", "taken")
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    rest = (F.col("taken") % F.col("size")).cast("int")
    copies = d.withColumn("copy", F.explode(F.sequence(F.lit(0), whole - F.when(rest > 0, 0).otherwise(1))))
    cut_here = F.col("copy") == F.when(rest > 0, whole).otherwise(-1)
    text = F.col("row").getField(text_col)
    part = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), 1, rest), " ")
    fields = {c: F.col("row").getField(c) for c in docs.columns} | {text_col: F.when(cut_here, part).otherwise(text)}
    if "n_chars" in docs.columns:
        fields["n_chars"] = F.when(cut_here, F.char_length(part).cast(docs.schema["n_chars"].dataType)).otherwise(fields["n_chars"])
    return copies.select(*(x.alias(c) for c, x in fields.items()))
