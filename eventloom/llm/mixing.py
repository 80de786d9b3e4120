"""Mixing sources to target weights, with DataFrame functions only.

Targets. Sources in order weigh WEIGHTS, repeating, and share all words by weight; no source gives more than MOST times its
own words, and what goes beyond that is shared by the others, until no source is above.

The mix. The documents of a source, in pseudorandom order, are one stream of words, packed into blocks of BLOCK words. The
output has slots, each for one block, in shards of SHARD slots. For every shard the counts of its sources are drawn from
the multinomial distribution of the targets, and the draws are the mix: a source has the slots it drew, in all shards
together. Only where chance takes it further than SLACK from its target (small sources), or beyond MOST times its blocks,
its last slots fall away or more come up to that bound. The slots of a source, in order, run over its blocks again and
again, each time in the order of another pseudorandom permutation of the block numbers (swap-or-not, so any number of
blocks is permuted in place), and blocks join by number. A block comes at most MOST times.

Everything random is a function of ids, texts and positions, so reruns agree. A stream position needs the words before it:
words are summed per document within a chunk, per chunk within a group of chunks, and per group, so neither a source with
a third of all documents nor one id or text that many rows share lands in one task. Sums and numbers of slots are exact in
64 bits. Only the windows over all sources hold a row per source in one task.

Null and empty texts have size 0 and are never taken. A null source is a source, the last one. Repeated rows are
documents of their own; null and repeated ids only matter for the order. Very long documents span many blocks. Empty
tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import BLANK, WORD, n_words, stage

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 32
SHARD = 4096
CHUNK_ROWS = 1000
ROUNDS = 8
#: How far a source's slots may lie from its target, as a share of it; one slot at least.
SLACK = 0.01
#: A prime; x -> x**5 permutes the numbers below it.
PRIME = (1 << 31) - 1
#: Cells in which the shares of sources are looked up, at least.
CELLS = 1024


def scrambled(x: Column, salt: int) -> Column:
    """A pseudorandom number below PRIME for a whole number, in arithmetic that any engine has."""
    for key in (salt * 7919 + 104729, salt * 104723 + 15485863):
        y = F.pmod(x + F.lit(key), F.lit(PRIME))
        square = y * y % PRIME
        x = square * square % PRIME * y % PRIME
    return x


def long_scrambled(x: Column, salt: int) -> Column:
    """The same for numbers of any size: what lies above PRIME counts as well."""
    return scrambled(x + scrambled(F.floor(x / PRIME), salt + 500), salt)


def share_drawn(slot: Column) -> Column:
    """A pseudorandom number from 0 up to, but not including, 1 for a slot, in 53 bits."""
    drawn = (long_scrambled(slot, 2) + long_scrambled(slot, 1002) / F.lit(float(PRIME))) / F.lit(float(PRIME))
    return F.least(drawn, F.lit(1 - 2.0**-53))


def before(df: DataFrame, group: list[str], order: str, value: str, name: str, length: int) -> DataFrame:
    """`df` with the sum of `value` over the rows of the group with a smaller `order` (whole numbers, unique in a group).

    In two levels: within runs of about the root of `length` numbers, and over the runs, so no window is long.
    """
    run = F.floor(F.col(order) / (math.isqrt(max(length, 1)) + 1)).alias("__run")
    inside = Window.partitionBy(*group, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*group).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    marked = df.withColumn("__run", run)
    runs = marked.groupBy(*group, "__run").agg(F.sum(value).alias("__sum"))
    runs = runs.select(*group, "__run", F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__earlier"))
    placed_in = marked.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    total = (F.col("__earlier") + F.col("__inside")).alias(name)
    return placed_in.join(runs, [*group, "__run"]).select(*[c for c in df.columns if c != name], total)


def _key(text: str) -> Column:
    """Equal for rows with the same id, source and text."""
    return F.xxhash64("doc_id", F.col("doc_id").isNull(), "source", F.col("source").isNull(), text)


def _numbered_copies(rows: DataFrame) -> DataFrame:
    """Rows (`key`, `part`, ...) with `copy`: 0, 1, ... for rows of one key, counted part by part."""
    counts = rows.groupBy("key", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    counts = counts.select("key", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("key", "part").orderBy("size"))
    return rows.withColumn("nth", nth).join(counts, ["key", "part"]).withColumn("copy", F.col("nth") - 1 + F.col("offset"))


def placed(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, key, origin (the source, null told apart), size, start (words of the source before it) of every document."""
    sized = documents.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("origin"), n_words(text).alias("size"),
        _key(text).alias("key"), F.spark_partition_id().alias("part"),
    )
    sized = stage(sized, "sizes")
    chunks = 1 + sized.count() // CHUNK_ROWS
    numbered = _numbered_copies(sized)
    turn = scrambled(F.pmod(F.col("key") + F.col("copy") * 7919, F.lit(PRIME)), 1)
    turned = stage(numbered.select("doc_id", "key", "origin", "size", "copy", turn.alias("turn")), "turns")
    turned = turned.withColumn("chunk", F.floor(F.col("turn") * chunks / PRIME))
    totals = turned.groupBy("origin", "chunk").agg(F.sum("size").alias("words"))
    totals = before(totals, ["origin"], "chunk", "words", "earlier", chunks).select("origin", "chunk", "earlier")
    inside = Window.partitionBy("origin", "chunk").orderBy("turn", "doc_id", "size", "key", "copy").rowsBetween(Window.unboundedPreceding, -1)
    turned = turned.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    start = (F.col("earlier") + F.col("inside")).alias("start")
    return turned.join(totals, ["origin", "chunk"]).select("doc_id", "key", "origin", "size", start)


def targets(sizes: DataFrame) -> DataFrame:
    """origin, number (in order), source_size, target, blocks, quota (slots) of every source."""
    sources = sizes.groupBy("origin").agg(F.sum("size").alias("source_size"))
    # windows over all sources: a row per source
    number = F.row_number().over(Window.orderBy(F.col("origin") == "", "origin"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.col("number") % F.lit(len(WEIGHTS)) + 1)
    sources = sources.withColumn("number", number - 1).withColumn("weight", weight.cast("long"))
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.col("source_size") * MOST
    by_need = Window.orderBy(full / F.col("weight"), "number")
    earlier = by_need.rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.select(
        "*",
        (F.sum("source_size").over(every) - F.coalesce(F.sum(full).over(earlier), F.lit(0))).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))).alias("weights"),
    )
    fits = (F.col("left") * F.col("weight") <= full * F.col("weights")) & (F.col("left") > 0)
    first = F.min(F.when(fits, F.struct(by_rank := F.col("need"), "left", "weights"))).over(every)
    sources = sources.withColumn("need", F.row_number().over(by_need)).withColumn("level", first)
    share = F.col("level.left") * F.col("weight") / F.col("level.weights")
    capped = F.col("level").isNull() | (by_rank < F.col("level.need"))
    target = F.when(capped, full.cast("double")).otherwise(share)
    blocks = F.ceil(F.col("source_size") / BLOCK)
    quota = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0)
    return (
        sources.withColumn("target", target).withColumn("blocks", blocks).withColumn("quota", quota.cast("long"))
        .select("origin", "number", "source_size", "target", "blocks", "quota")
    )


def shard_counts(sources: DataFrame) -> DataFrame:
    """origin, number, blocks, shard, first, slots: which slots of its source a shard holds, as drawn."""
    earlier = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)  # a row per source
    shares = stage(sources.filter("quota > 0").withColumn("low", F.coalesce(F.sum("quota").over(earlier), F.lit(0))), "shares")
    slots, known = shares.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    shards, cells, whole = -(-slots // SHARD), max(CELLS, 4 * known), F.lit(float(max(slots, 1)))
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1))
    low, high = F.col("low") / whole, (F.col("low") + F.col("quota")) / whole
    spread = shares.select("origin", low.alias("low"), high.alias("high"), F.explode(F.sequence(cell(low), cell(high))).alias("cell"))
    draws = sources.sparkSession.range(slots).select(F.floor(F.col("id") / SHARD).alias("shard"), share_drawn(F.col("id")).alias("draw"))
    drawn = draws.withColumn("cell", cell(F.col("draw"))).join(spread, "cell").filter((F.col("draw") >= F.col("low")) & (F.col("draw") < F.col("high")))
    drawn = stage(drawn.groupBy("origin", "shard").agg(F.count("*").alias("drawn")), "drawn")
    drawn = stage(before(drawn, ["origin"], "shard", "drawn", "first", shards), "draws")
    had = drawn.groupBy("origin").agg(F.sum("drawn").alias("had"))
    slack = F.greatest(F.floor(F.col("quota") * SLACK), F.lit(1))
    wanted = F.greatest(F.least("had", F.col("quota") + slack, F.col("blocks") * MOST), F.col("quota") - slack)
    facts = shares.select("origin", "number", "blocks", "quota").join(had, "origin", "left").fillna(0, ["had"]).withColumn("wanted", wanted)
    facts = stage(facts, "drawn-sources")
    kept = drawn.join(facts, "origin").select(
        "origin", "number", "blocks", "shard", "first", F.least("drawn", F.col("wanted") - F.col("first")).alias("slots")
    )
    more = facts.select(
        "origin", "number", "blocks", F.lit(shards).cast("long").alias("shard"), F.col("had").alias("first"), (F.col("wanted") - F.col("had")).alias("slots")
    )
    return kept.union(more).filter("slots > 0")


def permuted(slots: DataFrame) -> DataFrame:
    """`slots` (`number`, `blocks`, `slot`) with `block`: the slot's block number, another order for each pass."""
    seed = F.col("number") * 1000003 + F.floor(F.col("slot") / F.col("blocks")) * 8191
    found = slots.withColumn("seed", seed).withColumn("block", F.col("slot") % F.col("blocks"))
    for k in range(ROUNDS):
        key = scrambled(F.col("seed"), 3 + k) * PRIME + scrambled(F.col("seed"), 103 + k)  # below 2**62
        found = found.withColumn("mirror", F.pmod(key - F.col("block"), F.col("blocks")))
        larger = F.greatest("block", "mirror")
        found = found.withColumn("coin", scrambled(larger + F.floor(larger / PRIME) * 104711 + F.col("seed"), 53 + k) % 2)
        found = found.withColumn("block", F.when(F.col("coin") == 1, F.col("mirror")).otherwise(F.col("block"))).drop("mirror", "coin")
    return found.drop("seed")


def mixed_blocks(sources: DataFrame) -> DataFrame:
    """shard, slot, origin, block: the whole mix, as block numbers."""
    counts = stage(shard_counts(sources), "shard-counts")
    slots = counts.withColumn("slot", F.explode(F.sequence("first", F.col("first") + F.col("slots") - 1)))
    return permuted(slots.select("shard", "origin", "number", "blocks", "slot")).select("shard", "slot", "origin", "block")


def pieces(docs: DataFrame) -> DataFrame:
    """key, origin, start, block, low, high: the words low..high (from 0) of a document lie in a block."""
    last = F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
    cut = docs.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), last)))
    low = F.greatest(F.lit(0).cast("long"), F.col("block") * BLOCK - F.col("start"))
    high = F.least(F.col("size"), (F.col("block") + 1) * BLOCK - F.col("start")) - 1
    return cut.select("key", "origin", "start", "block", low.alias("low"), high.alias("high"))


def uses(sources: DataFrame) -> DataFrame:
    """origin, block, uses: how often the mix takes each block."""
    # written before it is joined: the planner takes very long to reason about the permutation's rounds in a join
    return stage(mixed_blocks(sources).groupBy("origin", "block").agg(F.count("*").alias("uses")), "uses")


def mixed(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    docs = stage(placed(documents, text), "placed")
    sources = stage(targets(docs), "sources")
    words = pieces(docs).join(uses(sources), ["origin", "block"])
    taken = words.groupBy("origin", "start").agg(F.sum((F.col("high") - F.col("low") + 1) * F.col("uses")).alias("taken"))
    taken = taken.withColumn("holds", F.lit(True))
    found = docs.withColumn("holds", F.col("size") > 0).join(taken, ["origin", "start", "holds"], "left")
    return found.join(sources.select("origin", "source_size", "target"), "origin").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")
    )


def remixed(documents: DataFrame, text: str = "text") -> DataFrame:
    """The mix as documents: a row for each pass that takes words of one, with the words taken in that pass, in order.

    A document's words keep the white space before them. Other columns stay as they are. Rows with the same id, source and
    text have their words one after the other in one row a pass.
    """
    docs = stage(placed(documents, text), "placed")
    parts = pieces(docs).join(uses(stage(targets(docs), "sources")), ["origin", "block"])
    passes = parts.withColumn("__pass", F.explode(F.sequence(F.lit(1).cast("long"), "uses")))
    ordered = F.sort_array(F.collect_list(F.struct("start", "low", "high"))).alias("__parts")  # of one document
    parts = stage(passes.groupBy(F.col("key").alias("__key"), "__pass").agg(ordered), "passes")
    named = documents.withColumn("__key", _key(text)).dropDuplicates(["__key"])
    words = F.regexp_extract_all(F.col(text), F.lit(rf"[{BLANK}]*{WORD}"), F.lit(0)).alias("__words")
    joined = named.join(parts, "__key").select(*[F.col(f"`{c}`") for c in documents.columns], "__parts", words)
    piece = lambda p: F.array_join(F.slice("__words", (p["low"] + 1).cast("int"), (p["high"] - p["low"] + 1).cast("int")), "")
    apart = lambda t: F.when(t.rlike(f"^[{BLANK}]"), t).otherwise(F.concat(F.lit(" "), t))
    taken = F.transform("__parts", lambda p: apart(piece(p)))
    return joined.withColumn(text, F.ltrim(F.array_join(taken, ""))).select(*[F.col(f"`{c}`") for c in documents.columns])
