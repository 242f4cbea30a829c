"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order that only their ids decide. A copy's virtual finish
time is the words its source has sent when it ends, divided by the source's target; a queue may be sent up to
`repeats` times over. All copies are range-sorted by finish time and the mix is truncated at the total budget.

Documents go whole, so a source whose next copy is long stops short of its target. Fill-up: what such sources lack is set aside before the
truncation, and each takes, in its own order, later documents of at most a quarter of its gap, as long as they fit.

A document's fate follows from its place in its source's order, so the decision is one row for each source (whole
passes, the last place of the pass that was cut, and the last place and size of the fill-up), joined to the documents; no text is shuffled.
A source may hold any share of the rows: its order is cut in hash ranges, summed apart and offset. Sources may be many: they are numbered in
ranges of their names, and the level of their targets is found by aggregates alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import WORD, id_text, stage

#: Hash ranges of each source's order: rows of one (source, range) are sorted together.
RANGE_BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """sizes: source, source_size. Adds weight and target: shares of all words by weight, none above repeats * source_size.

    Sources above their cap are held at it and the rest is shared anew, until none is above: one aggregate a round.
    """
    name = F.col("source").asc_nulls_last()
    ranged = stage(sizes.repartitionByRange(name).withColumn("part", F.spark_partition_id()), "mix-sources")
    ahead = ranged.groupBy("part").agg(F.count("*").alias("n"))  # a row a range
    ahead = ahead.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    number = F.row_number().over(Window.partitionBy("part").orderBy(name)) - 1 + F.col("ahead")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(number, F.lit(len(weights))) + 1).cast("int")).cast("double")
    capped = stage(ranged.join(ahead, "part").select("source", "source_size", w.alias("weight"), (F.col("source_size") * F.lit(float(repeats))).alias("cap")), "mix-weights")
    total, level = capped.agg(F.sum("source_size")).first()[0] or 0, 0.0
    while True:
        over = F.col("cap") < F.col("weight") * level
        held, still, n = capped.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.count_if(over)).first()
        new = (total - held) / still if still else level
        if not still or new <= level:
            break
        level = new
    return capped.select("source", "source_size", "weight", F.least(F.col("cap"), F.col("weight") * level).alias("target"))


def place(doc_id: str | Column, seed: int) -> Column:
    """A document's place in the shuffled order of its source: 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_text(doc_id)), 1)


def plan(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, budget: float = 1.0, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Slim rows (doc, source, size, place), one for each row of docs, and the decision for each source.

    Decisions: source, source_size, target, passes (whole ones taken), last_place and last_doc (where the cut one ends; null: at once).
    Null text has size 0. A null source is a source of its own, last in order. Rows that share source and id stand or fall together,
    but for the fill-up, which looks at each row's size.
    """
    slim = stage(docs.select(F.col(doc_id).alias("doc"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), place(doc_id, seed).alias("place")), "mix")
    targets = stage(source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats).withColumn("target", F.col("target") * budget), "mix-targets")

    part = slim.withColumn("part", F.shiftright("place", 63 - RANGE_BITS))
    sums = part.groupBy("source", "part").agg(F.sum("size").alias("n"))
    offsets = sums.withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    # peers share a sum: rows of one id
    inside = part.groupBy("source", "part", "place", "doc").agg(F.sum("size").alias("size")).withColumn("sent", F.sum("size").over(Window.partitionBy("source", "part").orderBy("place", "doc")))
    same = lambda a, b, *keys: [a[k].eqNullSafe(b[k]) for k in keys]
    queue = inside.join(offsets, same(inside, offsets, "source", "part")).select(inside.source, "place", "doc", "size", (F.col("sent") + F.col("offset")).alias("sent"))
    queue = queue.join(targets, same(queue, targets, "source")).select(queue.source, "place", "doc", "size", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("pass"), "sent", "source_size", "target").where("size > 0 and target > 0")
    queue = queue.withColumn("finish", (F.col("sent") + (F.col("pass") - 1) * F.col("source_size")) / F.col("target"))

    order = ["finish", "source", "pass", "place", "doc"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(queue.select(*order, "size").repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "mix-queue")
    before = ranged.groupBy("part").agg(F.sum("size").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    running = F.sum("size").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sent = stage(ranged.withColumn("running", running).join(F.broadcast(before), "part").withColumn("total", F.col("before") + F.col("running")).drop("running", "before"), "mix-sent")  # `before`: a row a partition

    def truncated(budget: int) -> DataFrame:
        """source, taken, last: what of each source lies within the budget."""
        return sent.where(F.col("total") <= budget).groupBy("source").agg(F.sum("size").alias("taken"), F.max(F.struct("pass", "place", "doc")).alias("last"))

    def gaps(cut: DataFrame) -> DataFrame:
        gap = F.greatest(F.floor(F.col("target") + 1e-6) - F.coalesce("taken", F.lit(0)), F.lit(0)).cast("long")
        return targets.join(cut, same(targets, cut, "source"), "left").select(targets.source, "source_size", "target", "last", gap.alias("gap"))

    total = int(targets.agg(F.floor(F.sum("target") + 1e-6)).first()[0] or 0)
    short = int(gaps(truncated(total)).agg(F.sum("gap")).first()[0] or 0)  # what stops short here goes to the others, beyond their targets
    decided = stage(gaps(truncated(total - short)).withColumns({"passes": F.coalesce(F.col("last.pass") - 1, F.lit(0)), "last_place": F.col("last.place"), "last_doc": F.col("last.doc"), "fill_size": F.floor(F.col("gap") / 4)}).drop("last"), "mix-cut")

    # fill-up: later documents of the pass that was cut, small ones, summed over hash ranges of the order like the queue
    after = F.col("last_place").isNull() | (F.col("place") > F.col("last_place"))
    small = part.join(decided.where(F.col("passes") < repeats), same(part, decided, "source")).where(after & (F.col("size") > 0) & (F.col("size") <= F.col("fill_size")))
    small = small.groupBy(part.source, "part", "place", "doc").agg(F.sum("size").alias("size"), F.max("gap").alias("gap"))
    some = small.groupBy("source", "part").agg(F.sum("size").alias("n"), F.max("gap").alias("most"))
    some = some.withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("offset < most").drop("n", "most")
    filled = small.join(some, [*same(small, some, "source"), small.part == some.part]).select(small.source, "place", "doc", "gap", (F.sum("size").over(Window.partitionBy(small.source, small.part).orderBy("place", "doc")) + F.col("offset")).alias("sum"))
    filled = filled.where("sum <= gap").groupBy("source").agg(F.max(F.struct("place", "doc")).alias("fill"))
    decided = decided.join(filled, same(decided, filled, "source"), "left").select(decided.source, "source_size", "target", "passes", "last_place", "last_doc", "fill_size", F.col("fill.place").alias("fill_place"), F.col("fill.doc").alias("fill_doc"))
    return slim, stage(decided, "mix-decided")


def times(place: Column, doc: Column, size: Column, decided: DataFrame) -> Column:
    """How often a document is in the mix, from its place and its source's decision."""

    def upto(end: str) -> Column:
        last, last_doc = decided[f"{end}_place"], decided[f"{end}_doc"]
        return F.coalesce((place < last) | ((place == last) & F.coalesce(doc <= last_doc, doc.isNull())), F.lit(False))

    beyond = decided["last_place"].isNull() | (place > decided["last_place"])
    filled = beyond & (size <= decided["fill_size"]) & upto("fill")
    return (decided["passes"] + (upto("last") | F.coalesce(filled, F.lit(False))).cast("int")).cast("int")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row for each row of docs.

    Null text has size 0 and is taken as 0 words; a null source is one source, last in order; rows that share source and id are taken alike;
    no rows give no rows; other columns are left out, whatever their names.
    """
    slim, decided = plan(docs, **options)
    at = slim.join(decided, slim.source.eqNullSafe(decided.source))
    return at.select(F.col("doc").alias("doc_id"), "size", "source_size", "target", (F.col("size") * times(F.col("place"), F.col("doc"), F.col("size"), decided)).alias("taken"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 17, **options) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken, with all their columns, whatever their names.

    A row without words, null text included, comes along once. A null source is one source; no rows give no rows.
    """
    _, decided = plan(docs, text, source, doc_id, seed=seed, **options)
    size = word_count(docs[text])
    n = F.when(size == 0, 1).otherwise(times(place(docs[doc_id], seed), docs[doc_id], size, decided))
    kept = docs.join(decided, docs[source].cast("string").eqNullSafe(decided["source"])).select(*[docs[c] for c in docs.columns], n.alias("__times"))
    return kept.where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[F.col(f"`{c}`") for c in docs.columns])
