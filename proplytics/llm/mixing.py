"""Mixing sources to target weights by pivotal dependent rounding, in blocks, over a reduction tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proplytics.llm.common import WORD, uniform, written

#: Weights that repeat over the sources in code point order.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], total: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, size), one row a source.

    ``total`` times all sizes is shared by weight; a target stops at ``most`` times its source's size and what is left is
    shared by weight among the others, until none is above. Water filling in closed form: with sources in order of
    size per weight, those below the level are full, and the level is what is left over the weights that are left.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row a source; the order of sources and the level need all of them in one place
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(in_order) - 1
    by_source = by_source.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(number, F.lit(len(weights)))))
    filled = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = filled.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    bound = F.col("source_size") * F.lit(float(most))
    by_source = by_source.select(
        "source", "source_size", "weight", bound.alias("bound"),
        (F.sum("source_size").over(everything) * F.lit(float(total)) - F.coalesce(F.sum(bound).over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weights_left"),
    )
    # a source is full if the level of those from it on is above what it holds; the others share the first such level
    level = F.col("left") / F.col("weights_left")
    full = level * F.col("weight") > F.col("bound")
    shared = F.min(F.when(~full, F.struct(F.col("bound") / F.col("weight"), F.col("source").isNull(), "source", level.alias("level")))).over(everything)
    return by_source.select("source", "source_size", F.when(full, F.col("bound")).otherwise(shared["level"] * F.col("weight")).alias("target"))


def _round_block(units: Column) -> Column:
    """Sequential pivotal rounding of one block: (decisions, carried).

    ``units`` are structs (size, key, p, u) in descending order of size, every p strictly between 0 and 1. The carried
    unit meets the next: mass moves between the two at a constant number of words until one becomes integral, in either
    direction with the probabilities that keep each expected copy count. The other is carried on.
    """
    start = F.struct(
        F.expr("cast(array() as array<struct<key:string,copy:int>>)").alias("done"),
        F.expr("cast(null as struct<size:bigint,key:string,p:double,u:double>)").alias("held"),
    )

    def meet(state: Column, unit: Column) -> Column:
        held = state["held"]
        back = unit["size"] / held["size"]  # copies of the held unit that weigh as much as one of the unit
        up = F.least(1 - unit["p"], held["p"] * held["size"] / unit["size"])  # the unit can grow so far
        down = F.least(unit["p"], (1 - held["p"]) * held["size"] / unit["size"])
        grows = unit["u"] * (up + down) < down
        moved = F.when(grows, up).otherwise(-down)
        unit_end = F.when(grows, (1 - unit["p"]) <= up).otherwise(unit["p"] <= down)
        rest = F.when(unit_end, held["p"] - moved * back).otherwise(unit["p"] + moved)
        rest = F.least(F.greatest(rest, F.lit(0.0)), F.lit(1.0))
        copy = F.when(unit_end, F.when(grows, 1).otherwise(0)).otherwise(F.when(grows, 0).otherwise(1))
        over = F.when(unit_end, unit["key"]).otherwise(held["key"])
        kept = F.struct(
            F.when(unit_end, held["size"]).otherwise(unit["size"]).alias("size"),
            F.when(unit_end, held["key"]).otherwise(unit["key"]).alias("key"),
            rest.alias("p"),
            unit["u"].alias("u"),
        )
        # a rest of exactly 0 or 1 is carried on: meeting it moves nothing but its own last step
        return F.struct(F.concat(state["done"], F.array(F.struct(over.alias("key"), copy.cast("int").alias("copy")))).alias("done"), kept.alias("held"))

    def step(state: Column, unit: Column) -> Column:
        first = F.struct(state["done"].alias("done"), unit.alias("held"))
        return F.when(state["held"].isNull(), first).otherwise(meet(state, unit))

    return F.aggregate(units, start, step)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0, seed: int = 7,
        block: int = 192, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Copies of every row so that each source's words meet its target: row_key, doc_id, source, size, source_size, target, copies.

    Expected copies of a row are target / source_size (at most ``most``). Its whole part is taken at once; the fractions of a
    source are rounded against each other by pivotal rounding in hashed blocks of about ``block`` rows. What is left of a block
    is one open unit; these meet in blocks again, level by level, until each source holds one, which is drawn by its fraction. The
    units of a block run from large to small, so open units are small and a source misses its target by less than one small row.
    Draws depend on (doc_id, text, source, seed) alone: reruns agree.

    A null source is a source (the last); a null or empty text has size 0, is taken as often as its fraction says (0 words).
    Equal rows are counted before they are dealt and count as separate units; empty tables give no rows; other columns are not read.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[source].alias("source"), docs[text].alias("_text"))
    rows = rows.select("doc_id", "source", word_count(F.col("_text")).alias("size"), F.xxhash64("doc_id", "_text", "source").alias("row_key"))
    counted = written(rows.groupBy("row_key", "doc_id", "source", "size").agg(F.count("*").alias("n")))
    goal = written(targets(counted.select("source", (F.col("size") * F.col("n")).alias("size")), weights, total, most))
    share = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    units = (
        counted.withColumn("source", F.struct("source")).join(goal.withColumn("source", F.struct("source")), "source")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
        .withColumn("share", share)
        .withColumn("whole", F.floor("share").cast("int"))
        .withColumn("key", F.concat_ws(":", F.col("row_key").cast("string"), F.col("copy").cast("string")))
        .withColumn("p", F.col("share") - F.col("whole"))
    )
    open_units = units.where((F.col("p") > 0) & (F.col("size") > 0)).select("source", "key", "size", "p")
    decided = written(_reduce(open_units, block, seed))
    out = units.join(decided, "key", "left")
    # a row without words changes no target: its fraction is drawn alone
    alone = F.when(uniform(F.col("key"), F.lit(seed)) < F.col("p"), 1).otherwise(0)
    copies = F.col("whole") + F.when(F.col("size") == 0, alone).otherwise(F.coalesce(F.col("decided"), F.lit(0)))
    return out.select("row_key", "doc_id", F.col("source.source").alias("source"), "size", "source_size", "target", copies.cast("int").alias("copies"))


def _reduce(open_units: DataFrame, block: int, seed: int) -> DataFrame:
    """(key, decided) of units (source, key, size, p), by levels of blocks until each source is one block."""
    level, out = 0, None
    while True:
        # one row a source: how many blocks its units fill; the driver learns only the largest
        blocks = written(open_units.groupBy("source").agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("blocks")))
        most = blocks.agg(F.max("blocks")).first()[0]
        if most is None:
            return out if out is not None else open_units.select("key", F.lit(0).alias("decided")).limit(0)
        # blocks are dealt by one hash of source and number, so that no task gets a source
        number = F.pmod(F.xxhash64("key", F.lit(seed + level)), F.col("blocks"))
        dealt = open_units.join(blocks, "source").withColumn("block", F.xxhash64("source", number))
        unit = F.struct("size", "key", "p", uniform(F.col("key"), F.lit(seed), F.lit(level)).alias("u"))
        rounded = dealt.groupBy("block").agg(F.first("source").alias("source"), F.sort_array(F.collect_list(unit), asc=False).alias("units"))
        rounded = written(rounded.select("source", _round_block(F.col("units")).alias("state")))
        done = rounded.select(F.explode("state.done").alias("d")).select("d.key", F.col("d.copy").alias("decided"))
        out = done if out is None else out.unionByName(done)
        rest = rounded.select("source", F.col("state.held.key").alias("key"), F.col("state.held.size").alias("size"), F.col("state.held.p").alias("p"))
        if most == 1:
            draw = F.when(uniform(F.col("key"), F.lit(seed), F.lit("last")) < F.col("p"), 1).otherwise(0)
            return out.unionByName(rest.select("key", draw.alias("decided")))
        integral = (F.col("p") <= 0) | (F.col("p") >= 1)
        out = out.unionByName(rest.where(integral).select("key", F.when(F.col("p") >= 1, 1).otherwise(0).alias("decided")))
        open_units, level = written(rest.where(~integral)), level + 1


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: every row as often as it is taken.

    Equal rows (same doc_id, text and source) are one row here and appear as often as all of them together are taken.
    """
    names = docs.columns
    keyed = docs.select(F.struct(*names).alias("row"), F.xxhash64(docs[options.get("doc_id", "doc_id")], docs[options.get("text", "text")],
                                                                 docs[options.get("source", "source")]).alias("row_key"))
    taken = mix(docs, **options).groupBy("row_key").agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).where("copies > 0")
    rows = keyed.join(taken, "row_key")
    once = rows.where("n = 1").select("row", "copies")
    # rows that repeat are folded map-side to one each
    many = rows.where("n > 1").groupBy("row_key", "copies").agg(F.any_value("row").alias("row")).select("row", "copies")
    out = once.unionByName(many)
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
