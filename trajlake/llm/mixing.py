"""Mixing sources to target weights in fixed-length blocks. DataFrame functions only.

Words stand for tokens. The documents of a source are laid end to end and cut into
blocks of ``block_words``. The mix is a row of output slots, each taking one block,
grouped into output shards of ``shard_slots``:

* how often a source is drawn in a shard is a multinomial draw of the shard's slots, by
  the sources' shares of all slots. Over all shards a source would then miss its target
  by chance, or pass its limit, so the draws beyond a source's slots, in the last shards
  that drew it, go to the sources that lack some;
* the j-th slot that the shards drew of a source takes block perm(j mod n) of its n blocks, where each pass
  over the source has a pseudorandom permutation of its own;
* slots and blocks are joined by (source, index).

The permutations of blocks and of the slots in a shard are four-round Feistel networks on a grid just larger than the range,
walked until they fall into the range: computed from the index alone, so nothing is
sorted or kept, and the same on each run.

Targets: sources in code-point order, null last, have the weights of ``weights`` in
turn and share all words; no target exceeds ``most`` times its source, the excess goes
to the others by weight.

Nulls: a null text has no words, a null source is a source of its own, a null doc_id
stands first in its source. Empty texts take 0 words. Rows are counted each for
itself, repeated or not; ties are rows alike in all that matters, so their order does
not matter. A long document spans many blocks. An empty table gives no rows. Other
columns are ignored.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.llm.common import ident, save, small, whole_text

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
STRIPE_ROWS = 50_000  # documents on average in a part in which they are summed and numbered
CELLS = 4096  # cells of the hash range in which draws meet the sources
RUN_SHARDS = 4096  # shards that are numbered in one window
MOST_TASKS = 20_000  # tasks that draw; with more shards a task has more of them
FEW = 1_000_000  # rows of few numbers that may be broadcast
WALK = 64  # steps of the walk; a range of up to 900 never needs more, a larger one with chance under 1e-70


def permuted(x: Column, n: Column, *key: Column | int | str) -> Column:
    """The place of ``x`` in a pseudorandom permutation of 0 .. n-1 that depends on ``key`` and n."""
    keys = [k if isinstance(k, Column) else F.lit(k) for k in key]
    wide = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    wide = F.greatest(wide, F.lit(1).cast("long"))

    def once(v: Column) -> Column:
        high, low = F.floor(v / wide).cast("long"), F.pmod(v, wide)
        for turn in range(2):
            high = F.pmod(high + F.pmod(F.xxhash64(low, F.lit(2 * turn), *keys), wide), wide)
            low = F.pmod(low + F.pmod(F.xxhash64(high, F.lit(2 * turn + 1), *keys), wide), wide)
        return high * wide + low

    first = once(x.cast("long"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return F.when(first < n, first).otherwise(walked)


def words_in(column: Column) -> Column:
    return F.regexp_count(column, F.lit("[^ \\t-\\r]+")).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size``; written once, as the texts are read only here."""
    return save(docs.select(ident(), F.col("source").cast("string").alias("source"), words_in(whole_text()).alias("size")), "sizes")


def with_targets(per_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Add ``target`` to a table of ``source, source_size``, one row per source.

    With sources in order of limit / weight, the first ones reach their limit; the
    rest share what is left by weight. Windows over all rows see one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    rows = per_source.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    rows = rows.withColumn("_most", F.col("source_size") * most).withColumn("_r", F.col("_most") / F.col("_w"))
    every = Window.partitionBy()
    up = Window.orderBy("_r", F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("_all", F.sum("source_size").over(every))
        .withColumn("_full", F.coalesce(F.sum("_most").over(before), F.lit(0.0)))
        .withColumn("_rest", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_all") - F.col("_full")) / F.col("_rest"))
    )
    # The level of the first source that stays below its limit holds for all after it.
    share = F.min(F.when(F.col("_level") <= F.col("_r"), F.struct("_r", "source", "_level"))).over(every)
    rows = rows.withColumn("_share", share["_level"])
    return rows.select("source", "source_size", F.least(F.col("_most"), F.coalesce("_share", "_r") * F.col("_w")).alias("target"))


def laid_out(sized: DataFrame) -> DataFrame:
    """Add ``first``: the words of the same source before the document.

    A source is summed and numbered in stripes by a hash of the id, so a source with a
    third of all documents is no single task's work.
    """
    stripes = max(64, -(-sized.count() // STRIPE_ROWS))
    striped = sized.withColumn("_stripe", F.pmod(F.xxhash64("doc_id"), F.lit(stripes)))
    stripes = striped.groupBy("source", "_stripe").agg(F.sum("size").alias("_n"))
    ahead = Window.partitionBy("source").orderBy("_stripe").rowsBetween(Window.unboundedPreceding, -1)
    stripes = stripes.select(
        F.col("source").alias("_s"), F.col("_stripe").alias("_t"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base")
    )
    within = Window.partitionBy("source", "_stripe").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = striped.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.join(stripes, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_stripe") == F.col("_t")))
    return joined.withColumn("first", F.col("_base") + F.col("_in")).drop("_s", "_t", "_stripe", "_in", "_base")


def quotas(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``source, blocks, slots, first``: slots a source has in the whole mix, and those of the sources before it."""
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    # In whole passes and parts of one, so that the last, shorter block counts as what it is.
    wanted = F.least(F.floor(F.col("target") * blocks / F.col("source_size") + 0.5).cast("long"), (blocks * MOST).cast("long"))
    rows = targets.where("source_size > 0").select("source", blocks.alias("blocks"), wanted.alias("slots")).where("slots > 0")
    before = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("first", F.coalesce(F.sum("slots").over(before), F.lit(0)))


def draws(quota: DataFrame, every: int, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """The multinomial draw of each output shard: ``shard, source, drawn``.

    Each slot of a shard takes a hash below ``every``; the source in whose range of
    slots it falls is drawn. A hash meets the ranges in one of ``CELLS`` equal cells.
    """
    spark = quota.sparkSession
    shards = -(-every // shard_slots)
    tasks = max(1, min(shards, MOST_TASKS, max(spark.sparkContext.defaultParallelism, shards // 16)))
    left = F.least(F.lit(shard_slots).cast("long"), F.lit(every) - F.col("shard") * shard_slots) - 1
    places = spark.range(0, shards, 1, tasks).withColumnRenamed("id", "shard").withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), left)))
    thrown = places.select("shard", F.pmod(F.xxhash64("shard", "_p", F.lit(seed), F.lit("draw")), F.lit(every)).alias("_u"))
    width = -(-every // CELLS)
    end = F.col("first") + F.col("slots")
    cells = quota.select(
        "source", "first", end.alias("_end"), F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((end - 1) / width))).alias("_cell")
    )
    met = thrown.withColumn("_cell", F.floor(F.col("_u") / width)).join(small(cells, FEW), "_cell")
    return met.where("_u >= first and _u < _end").groupBy("shard", "source").agg(F.count("*").alias("drawn"))


def settled(drawn: DataFrame, quota: DataFrame) -> DataFrame:
    """Draws that meet every source's slots: ``shard, source, start, count``.

    ``start`` is the number of the source's slots before. Over all shards a source is
    drawn a little too often or too seldom. Its draws beyond its slots, all in the last
    shards that drew it, go to the sources that lack some, in order.
    """
    # Sums over runs of shards first, so that no window holds all shards.
    runs = drawn.withColumn("_run", F.floor(F.col("shard") / RUN_SHARDS))
    ahead = Window.partitionBy("source").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sums = runs.groupBy("source", "_run").agg(F.sum("drawn").alias("_n"))
    sums = sums.select(F.col("source").alias("_s"), F.col("_run").alias("_r"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    within = Window.partitionBy("source", "_run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    rows = runs.withColumn("_in", F.coalesce(F.sum("drawn").over(within), F.lit(0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_run") == F.col("_r")))
    rows = rows.select("shard", "source", "drawn", (F.col("_base") + F.col("_in")).alias("start"))

    totals = drawn.groupBy(F.col("source").alias("_s")).agg(F.sum("drawn").alias("_drawn"))
    order = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    over = quota.join(totals, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("_drawn", F.coalesce("_drawn", F.lit(0)))
    over = over.withColumns({
        "_spare": F.greatest(F.col("_drawn") - F.col("slots"), F.lit(0)),
        "_lack": F.greatest(F.col("slots") - F.col("_drawn"), F.lit(0)),
    })
    over = over.withColumns({
        "_spare_at": F.coalesce(F.sum("_spare").over(order), F.lit(0)), "_lack_at": F.coalesce(F.sum("_lack").over(order), F.lit(0)),
    })
    over = save(over.select(F.col("source").alias("_s"), "slots", "_drawn", "_spare_at", "_lack", "_lack_at"), "overdrawn")

    rows = rows.join(over, F.col("source").eqNullSafe(F.col("_s")))
    kept = F.greatest(F.least(F.col("drawn"), F.col("slots") - F.col("start")), F.lit(0))
    rows = rows.withColumn("count", kept)
    # The spare draws have numbers; a lacking source takes a range of them.
    low = F.col("_spare_at") + F.greatest(F.col("start") - F.col("slots"), F.lit(0))
    spare = rows.where("drawn > count").select("shard", low.alias("_low"), (low + F.col("drawn") - F.col("count")).alias("_high"))
    lack = over.where("_lack > 0").select(
        F.col("_s").alias("source"), F.col("_drawn").alias("_from"), F.col("_lack_at").alias("_left"), (F.col("_lack_at") + F.col("_lack")).alias("_right")
    )

    def cells(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(a) / SHARD_SLOTS), F.floor((F.col(b) - 1) / SHARD_SLOTS))))

    met = cells(spare, "_low", "_high").join(cells(lack, "_left", "_right"), "_cell")
    # Of two ranges that share several cells, the cell with the start of the shared part counts.
    a, b = F.greatest("_low", "_left"), F.least("_high", "_right")
    met = met.where((a < b) & (F.floor(a / SHARD_SLOTS) == F.col("_cell")))
    given = met.select("shard", "source", (F.col("_from") + a - F.col("_left")).alias("start"), (b - a).alias("count"))
    return rows.where("count > 0").select("shard", "source", "start", "count").unionByName(given)


def slots(targets: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """The mix: ``shard, slot, source, index``, a row per output slot."""
    quota = save(quotas(targets, block_words), "quotas")
    every = int(quota.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0])
    if not every:
        return quota.select(F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("slot"), "source", F.col("first").alias("index")).limit(0)
    counts = settled(save(draws(quota, every, shard_slots, seed), "draws"), quota)
    # A number of tasks that Spark does not lower: few bytes come in, many slots go out.
    shards = -(-every // shard_slots)
    spark = targets.sparkSession
    counts = counts.repartition(max(1, min(MOST_TASKS, max(spark.sparkContext.defaultParallelism, shards // 16))), "shard")
    order = Window.partitionBy("shard").orderBy(F.col("source").asc_nulls_last(), "start").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("count").over(order), F.lit(0)))
    of = small(quota.select(F.col("source").alias("_s"), F.col("blocks").alias("_blocks")), FEW)
    counts = counts.join(of, F.col("source").eqNullSafe(F.col("_s")))
    dealt = counts.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1))).withColumn("_j", F.col("start") + F.col("_i"))
    size = F.least(F.lit(shard_slots).cast("long"), F.lit(every) - F.col("shard") * shard_slots)
    slot = permuted(F.col("_before") + F.col("_i"), size, seed, "slots", F.col("shard"))
    turn = F.floor(F.col("_j") / F.col("_blocks"))
    index = permuted(F.pmod("_j", "_blocks"), F.col("_blocks"), seed, F.coalesce("source", F.lit("")), F.col("source").isNull(), turn)
    return dealt.select("shard", slot.alias("slot"), "source", index.alias("index"))


def block_parts(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Which words of which document stand in a block: ``source, index, doc_id, first, size, words``."""
    spans = placed.where("size > 0")
    low = F.floor(F.col("first") / block_words)
    high = F.floor((F.col("first") + F.col("size") - 1) / block_words)
    rows = spans.withColumn("index", F.explode(F.sequence(low, high)))
    end = F.least(F.col("first") + F.col("size"), (F.col("index") + 1) * block_words)
    return rows.withColumn("words", end - F.greatest("first", F.col("index") * block_words))


def mixed(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, weights: tuple[float, ...] = WEIGHTS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Per document ``doc_id, source, size, source_size, target, taken``; and the slots with their shard."""
    sized = sizes(docs)
    placed = laid_out(sized)
    targets = save(with_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "targets")
    plan = slots(targets, block_words, shard_slots, seed)
    uses = plan.groupBy("source", "index").agg(F.count("*").alias("_uses"))
    uses = uses.select(F.col("source").alias("_s"), F.col("index").alias("_i"), "_uses")
    parts = block_parts(placed, block_words)
    # Both sides grow with the words; a broadcast that Spark thinks small would not stay so.
    met = parts.join(uses.hint("merge"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("index") == F.col("_i")), "left")
    taken = met.groupBy("doc_id", "source", "first", "size").agg(F.sum(F.col("words") * F.coalesce("_uses", F.lit(0))).alias("taken"))
    empty = placed.where("size = 0").select("doc_id", "source", "first", "size", F.lit(0).cast("long").alias("taken"))
    of = targets.withColumnRenamed("source", "_s")
    rows = taken.unionByName(empty).join(of, F.col("source").eqNullSafe(F.col("_s")))
    return rows.select("doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken")), plan


def repeated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as many times as its words are taken, in whole documents.

    ``taken / size`` is rounded up with the chance of its fraction, by a hash of the row, so
    that sources keep their shares. A row that is taken no time goes. Rows are told apart
    by doc_id, source and a hash of the text; repeated rows share what is taken of them.
    """
    rows = docs.select(F.struct("*").alias("_row"), ident(), F.col("source").cast("string").alias("source"), whole_text().alias("_t"))
    rows = rows.select("_row", "doc_id", "source", words_in(F.col("_t")).alias("size"), F.xxhash64("_t").alias("_k"))
    mix, _ = mixed(docs, **options)
    # Rows of one id and size are alike to the mix, so their copies follow from their mean.
    rate = mix.where("size > 0").groupBy("doc_id", "source", "size").agg((F.sum("taken") / F.sum("size")).alias("_rate"))
    rate = small(save(rate.where("_rate > 0"), "rates"), FEW)
    keyed = rate.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), "_rate")
    met = rows.join(keyed, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    chance = F.pmod(F.xxhash64("doc_id", "_k", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    times = F.least(F.floor(F.col("_rate") + chance), F.lit(int(MOST))).cast("int")
    return met.select(F.explode(F.array_repeat("_row", times)).alias("_row")).select("_row.*")
