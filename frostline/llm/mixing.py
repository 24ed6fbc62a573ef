"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

The mix is dealt in blocks of equal words, to the sources by highest quotients target / (2 * blocks so far + 1),
shard after shard: the method never takes a block back when the total grows, so a shard's quota is the
difference of two apportionments.  A source's documents form a tape in a seeded order that is cut into blocks, and
each shard draws its quota from its own blocks.  Blocks hold whole documents; a few documents more or fewer,
nearest in size, close the gap between what the blocks hold and the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frostline.llm.common import WORD_JAVA, materialize, named

#: A gap of fewer words is left open; rounds of closing gaps.
LEAST_BLOCK = 8
ROUNDS = 24


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_JAVA)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Per source: source_size, weight, target.

    Targets share the size of everything by weight; none exceeds ``most`` times its source, and what
    that leaves over is shared again by weight.  In the order of most * size / weight, sources are
    capped until the rest's common rate lies below that ratio, which is where sharing again ends.
    """
    every = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    weighted = every.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int")))
    limit = weighted.withColumn("limit", F.col("source_size") * most)
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    rate = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("limit").over(upto), F.lit(0))) / F.sum("weight").over(after)
    rated = limit.withColumn("rate", rate).withColumn("place", F.row_number().over(order)).withColumn("free", F.col("rate") <= F.col("limit") / F.col("weight"))
    # The first free source and all behind it have its rate.
    common = F.min_by("rate", F.when(F.col("free"), F.col("place"))).over(Window.partitionBy())
    return rated.select("source", "source_size", "weight", F.least(F.col("limit").cast("double"), F.coalesce(F.col("weight") * common, F.col("limit"))).alias("target"))


def apportion(targets: DataFrame, houses: list[tuple[int, int]]) -> DataFrame:
    """Sainte-Laguë seats: for each (shard, house) of ``houses`` and each source, its seats.

    Every source gets the seats whose quotients surely are among the highest; the few that are left are
    given by comparing the next quotients, ties to the source first by code point.
    """
    each = F.array(*[F.struct(F.lit(s).cast("long").alias("shard"), F.lit(h).cast("long").alias("house")) for s, h in houses])
    t = targets.where("target > 0").select("source", "target", F.explode(each).alias("_at")).select("source", "target", "_at.shard", "_at.house")
    n, whole = F.count("*").over(Window.partitionBy("shard")), F.sum("target").over(Window.partitionBy("shard"))
    # Rounding target / d with d at house -/+ n/2 seats bounds the seats from both sides.
    sure = F.greatest(F.floor(F.col("target") * (F.col("house") - n / 2) / whole + 0.5), F.lit(0))
    most = F.floor(F.col("target") * (F.col("house") + n / 2) / whole + 0.5) + 1
    bounds = t.withColumn("sure", sure).withColumn("most", most)
    bounds = bounds.withColumn("open", F.col("house") - F.sum("sure").over(Window.partitionBy("shard")))
    seats = bounds.where("open > 0").select("shard", "source", "open", F.explode(F.sequence(F.col("sure") + 1, F.col("most"))).alias("seat"), "target")
    ranked = Window.partitionBy("shard").orderBy((F.col("target") / (2 * F.col("seat") - 1)).desc(), F.col("source").asc_nulls_last(), "seat")
    won = seats.withColumn("r", F.row_number().over(ranked)).where("r <= open").groupBy("shard", "source").agg(F.count("*").alias("more"))
    b, w = bounds.alias("b"), won.alias("w")
    same = (F.col("b.shard") == F.col("w.shard")) & F.col("b.source").eqNullSafe(F.col("w.source"))
    return b.join(w, same, "left").select("b.shard", "b.source", (F.col("sure") + F.coalesce("more", F.lit(0))).cast("long").alias("seats"))


def shard_quotas(targets: DataFrame, house: int, shards: int = 16) -> DataFrame:
    """Blocks that each source puts into each shard, of ``house`` in all: shard, source, quota."""
    upto = apportion(targets, [(k, k * house // shards) for k in range(1, shards + 1)])
    before = F.lag("seats", 1, 0).over(Window.partitionBy("source").orderBy("shard"))
    return upto.select("shard", "source", (F.col("seats") - before).alias("quota"))


def block_length(targets: DataFrame, shards: int) -> int:
    """Words in a block: a sixteenth of what the source of the smallest target puts into a shard, 1 at least."""
    least = targets.where("target > 0").agg(F.min("target").alias("t")).first()["t"]
    return max(1, int((least or 0) / (16 * shards)))


def block_draws(sources: DataFrame, quotas: DataFrame, length: int, shards: int, most: int) -> DataFrame:
    """(_key, _blocks, _whole, _draws): a source's blocks, how often all are taken, and how many more of each shard's.

    Block b is dealt to shard b modulo ``shards``, and its copy in pass p over all blocks to the shard p further on.  What
    the passes leave of a shard's quota is drawn from its own blocks; where these are too few or too many, the next
    shards give or take.
    """
    blocks = F.ceil(F.col("source_size") / length).cast("long")
    seats = quotas.withColumn("_key", _key()).groupBy("_key").agg(F.sum("quota").alias("_seats"))
    all_ = sources.join(seats, "_key", "left").withColumn("_blocks", blocks).withColumn("_seats", F.least(F.coalesce("_seats", F.lit(0)), F.col("_blocks") * most))
    all_ = all_.withColumn("_whole", F.coalesce(F.expr("_seats div nullif(_blocks, 0)"), F.lit(0)).cast("long"))
    each = all_.select("_key", "_blocks", "_whole", "_seats", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("_k"))
    of = lambda k: F.greatest(F.expr("_blocks + {0} - 1".format(shards)) - k, F.lit(0)) / shards
    own = lambda k: F.floor(of(k)).cast("long")
    passed = sum((F.when(F.col("_whole") > p, own(F.pmod(F.col("_k") - p, F.lit(shards)))).otherwise(0) for p in range(most)), F.lit(0).cast("long"))
    mine = quotas.select(_key(), (F.col("shard") - 1).alias("_k"), "quota")
    each = each.join(mine, ["_key", "_k"], "left").withColumn("_n", own(F.col("_k")))
    x = F.greatest(F.least(F.coalesce("quota", F.lit(0)) - passed, F.col("_n")), F.lit(0))
    source, before = Window.partitionBy("_key"), Window.partitionBy("_key").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_seats") - F.col("_whole") * F.col("_blocks") - F.sum("_x").over(source)
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    within = lambda v, top: F.greatest(F.least(v, top), F.lit(0))
    room = F.col("_n") - F.col("_x")
    fit = each.withColumn("_x", x).withColumn("_left", left).withColumn("_more", within(F.col("_left") - upto(room), room)).withColumn("_less", within(-F.col("_left") - upto("_x"), F.col("_x")))
    drawn = fit.groupBy("_key").agg(F.first("_blocks").alias("_blocks"), F.first("_whole").alias("_whole"), F.sort_array(F.collect_list(F.struct("_k", (F.col("_x") + F.col("_more") - F.col("_less")).alias("n")))).alias("_d"))
    return drawn.select("_key", "_blocks", "_whole", F.transform("_d", lambda d: d["n"]).alias("_draws"))


def _key() -> Column:
    """A source as a join key that is never null."""
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source")).alias("_key")


def _closing(placed: DataFrame) -> DataFrame:
    """_key, _start and _more (1 or -1) of the documents whose times change so that quotas are met.

    Each round moves the document nearest in size to what a source's words are short of or beyond its
    quota, if that brings them nearer: one is added once or left out once.  Of documents of one size and
    equally often taken, that of least hash is asked.
    """
    gaps = placed.groupBy("_key").agg((F.first("_quota") - F.sum(F.col("size") * F.col("_times"))).alias("_gap")).where(F.abs("_gap") >= LEAST_BLOCK)
    # One row for each size and number of times of a source, before a source's rows meet.
    sizes = placed.where("size > 0").groupBy("_key", "size", "_times", "_most").agg(F.min(F.struct("_h", "_start")).alias("_first"))
    one = sizes.join(gaps, "_key").where(F.col("size") < 2 * F.abs("_gap"))
    move = lambda way: F.struct((F.col("size") * way).alias("words"), (F.col("_times") * way).alias("often"), F.col("_first._start").alias("start"), F.lit(way).alias("more"))
    moves = F.array_compact(F.array(F.when(F.col("_times") < F.col("_most"), move(1)), F.when(F.col("_times") > 0, move(-1))))
    lists = one.select("_key", "_gap", F.explode(moves).alias("_move")).groupBy("_key", "_gap").agg(F.collect_list("_move").alias("_moves"))

    def round_(state: Column, _: Column) -> Column:
        left = lambda m: F.abs(state["gap"] - m["words"])
        able = F.filter("_moves", lambda m: (left(m) < F.abs(state["gap"])) & ~F.exists(state["made"], lambda x: x["start"] == m["start"]))
        best = F.array_min(F.transform(able, lambda m: F.struct(left(m).alias("left"), m["often"].alias("often"), m["start"].alias("start"), m["words"].alias("words"), m["more"].alias("more"))))
        found = F.filter(F.array(best), lambda x: x.isNotNull() & (F.abs(state["gap"]) >= LEAST_BLOCK))
        gap = state["gap"] - F.coalesce(F.get(found, F.lit(0))["words"], F.lit(0))
        made = F.concat(state["made"], F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["more"].alias("more"))))
        return F.struct(gap.cast("long").alias("gap"), made.cast("array<struct<start:bigint,more:int>>").alias("made"))

    start = F.struct(F.col("_gap").cast("long").alias("gap"), F.expr("cast(array() as array<struct<start:bigint,more:int>>)").alias("made"))
    made = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_, lambda state: state["made"])
    return lists.select("_key", F.explode(made).alias("_m")).select("_key", F.col("_m.start").alias("_start"), F.col("_m.more").alias("_more"))


def _hash(seed: int) -> Column:
    """A tape's order: by a seeded hash of the document's id and text."""
    return F.xxhash64(F.lit(seed), "doc_id", "text").alias("_h")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, shards: int = 16, seed: int = 17, rows_a_group: int = 2_048, block_words: int | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, times, shards, and _key and _h, of every document.

    ``times`` is how often the document is taken, whole; ``taken`` its words so often; ``shards`` has the
    shard of each copy.  A source's documents lie on a tape in a seeded order, which is cut into blocks of
    ``block_words`` (see ``block_length``); a document belongs to the block that it starts in.  Sources get blocks shard
    by shard by highest quotients; each shard draws its blocks, seeded, one from each of as many even parts of its own.
    Blocks hold whole documents, so closing rounds make up for their unequal words.  Other seeds and numbers of shards
    take other documents, to the same totals.  Null and empty texts have size 0 and nothing taken; a null source is a
    source; repeated rows are all kept, each with its own place on the tape.  Tables without rows or words give no rows
    or targets of 0.  Other columns of the input play no part; texts are read once and never shuffled.
    """
    small = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _hash(seed), _key()), "sizes")
    totals = small.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("w"), F.count("*").alias("n")).first()
    groups = max(1, -(-totals["n"] // rows_a_group))

    targets = materialize(source_targets(small, weights, most).withColumn("_key", _key()), "targets")
    length = block_words or block_length(targets, shards)
    quotas = shard_quotas(targets, totals["w"] // length, shards)
    draws = block_draws(targets, quotas, length, shards, most)
    quota = F.least(F.round("target").cast("long"), F.col("source_size") * most).alias("_quota")
    sources = materialize(targets.join(draws, "_key").select("_key", "source_size", "target", quota, "_blocks", "_whole", "_draws"), "quotas")

    # Places on the tape: running sums within salted groups of a source, and before each group.
    group = F.pmod(F.col("_h"), F.lit(groups)).alias("_g")
    before = Window.partitionBy("_key").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_key", "_g").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    sums = small.groupBy("_key", group).agg(F.sum("size").alias("_s"))
    bases = sums.select("_key", "_g", upto("_s", before).alias("_base")).join(sources, "_key")
    at = small.select("*", group).join(bases, ["_key", "_g"]).withColumn("_start", F.col("_base") + upto("size", inside))
    at = at.withColumn("_b", F.expr(f"_start div {length}")).withColumn("_k", F.pmod("_b", F.lit(shards))).withColumn("_i", F.expr(f"_b div {shards}"))
    # The one of n blocks that each of r even parts gives: its part, where that starts and ends, and the draw.
    at = at.withColumn("_n", F.expr(f"(_blocks - _k + {shards - 1}) div {shards}")).withColumn("_r", F.coalesce(F.get("_draws", F.col("_k").cast("int")), F.lit(0)))
    part = F.expr("((_i + 1) * _r - 1) div nullif(_n, 0)")
    low, high = F.expr("(_t * _n) div nullif(_r, 0)"), F.expr("((_t + 1) * _n) div nullif(_r, 0)")
    at = at.withColumn("_t", part).withColumn("_low", low).withColumn("_high", high)
    more = F.col("_i") == F.col("_low") + F.pmod(F.xxhash64(F.lit(seed), "_key", "_k", "_t"), F.nullif(F.col("_high") - F.col("_low"), F.lit(0)))
    times = F.when(F.col("size") > 0, F.col("_whole") + F.when(F.col("_r") > 0, F.coalesce(more.cast("long"), F.lit(0))).otherwise(0)).otherwise(0)
    placed = at.select("doc_id", "source", "size", "source_size", "target", "_key", "_h", "_start", "_quota", "_b", times.cast("long").alias("_times"), F.lit(most).cast("long").alias("_most"))
    placed = materialize(placed, "placed")

    closing = materialize(_closing(placed), "closing")
    timed = placed.join(closing, ["_key", "_start"], "left").withColumn("times", F.when(F.col("size") > 0, F.col("_times") + F.coalesce("_more", F.lit(0))).otherwise(0).cast("long"))
    none = F.expr("cast(array() as array<int>)")
    copies = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("times"), F.lit(1))), lambda c: (F.pmod(F.col("_b") + c - 1, F.lit(shards)) + 1).cast("int"))
    return timed.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * F.col("times")).alias("taken"), "times", F.when(F.col("times") > 0, copies).otherwise(none).alias("shards"), "_key", "_h")


def mixed_documents(docs: DataFrame, seed: int = 17, **parameters) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: each whole, as often as it is taken.

    The mix is made without texts, which are joined to its result in one shuffle.  Of rows that agree in
    doc_id, source and text, one stands for all, as often as they are taken together.  ``n_chars``, where
    there is one, is counted anew.
    """
    keys = ["doc_id", "_key", "_h"]
    of = mix(docs, seed=seed, **parameters).groupBy(*keys).agg(F.sum("times").alias("_times"), F.count("*").alias("_rows"))
    of = materialize(of.where("_times > 0").withColumnsRenamed({k: f"{k}_" for k in keys}), "times")
    hashed = docs.select(F.struct(*named(*docs.columns)).alias("_doc"), "doc_id", _hash(seed), _key())
    same = (F.col("doc_id").eqNullSafe(F.col("doc_id_"))) & (F.col("_key") == F.col("_key_")) & (F.col("_h") == F.col("_h_"))
    found = hashed.join(of.hint("shuffle_hash"), same)
    if not of.where("_rows > 1").isEmpty():
        found = found.where("_rows = 1").union(found.where("_rows > 1").dropDuplicates(keys))
    copies = found.select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))).alias("_copy")).select("_doc.*")
    return copies.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else copies


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "shards")
