"""Mixing sources to target weights: Sainte-Lague apportionment of equal blocks of words.

Sources share the words of the mix by weight; none takes more than a limit times its own size, and what that leaves is
shared by the others. The mix is counted in blocks of equal size. Blocks go to sources, and a source's blocks to its
shards, by highest quotients (weight by 1, 3, 5, ...), which gives whole numbers that add up. A shard's documents stand in a
seeded order on a line of words that is cut into blocks; whole passes over the line come first, and the rest of the quota
is a run of blocks from a seeded start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType
from pyspark.sql.window import Window

from tidelake.llm._common import SPACED_WORD, in_parts, slices, staged, widened, words

#: Words of a block.
BLOCK_WORDS = 32
#: Documents of a shard, about: a source has as many shards as its documents need.
SHARD_DOCUMENTS = 2000
#: Values at which quotients are counted in one round, and rounds, to find the last winning quotient.
GRID, ROUNDS = 64, 2
#: Weights of the sources in order of their names, repeating; share of all words that the mix has; limit of a source.
WEIGHTS, SHARE, LIMIT = (5, 2, 1), 1.5, 2


def sized(documents: DataFrame, text: str = "text") -> DataFrame:
    """The frame with the number of words of its column `text` (null: 0) as a further column, `size`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.zeros(0, np.int64)]
            for _, _, data, offsets in slices(batch.column(batch.schema.get_field_index(text))):
                n.append(np.diff(words(data, offsets, SPACED_WORD)[2]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(n), pa.int64())], names=[*batch.schema.names, "size"])

    return documents.mapInArrow(count, widened(documents, size=LongType()))


def apportion(frame: DataFrame, of: list[str], key: str, weight: str, seats: str, into: str) -> DataFrame:
    """The frame with the number of seats of each row by Sainte-Lague's method, of those that its group `of` has.

    Rows win a seat for each of their quotients weight / 1, 3, 5, ... that is among the group's highest. Where the last
    winning quotient lies is narrowed by counting, for a grid of values, the quotients at or above each: one small
    aggregate a round, folded before the shuffle. Quotients above the range that is left are certain, those inside compete
    one by one, so the result is exact; the rounds only make them few. Rows without weight get none. Ties go to the
    smaller key. The frame is read several times: give it a written one.
    """
    group = of or ["_whole"]
    rows = (frame if of else frame.withColumn("_whole", F.lit(0))).withColumn("_weight", F.col(weight).cast("double"))
    live = rows.where((F.col("_weight") > 0) & (F.col(seats) > 0))
    # A row of weight w has between w / 2v - 1/2 and w / 2v + 1/2 quotients at or above v: so v lies between these two.
    total, most = F.sum("_weight"), F.max("_weight")
    bounds = live.groupBy(*group).agg(F.max(seats).alias("_all"), total.alias("_total"), most.alias("_most"), F.count("*").alias("_n"))
    spare = 2 * F.col("_all") - F.col("_n")
    high = F.when(spare > 0, F.least(2 * F.col("_most"), F.col("_total") / spare * (1 + 1e-9))).otherwise(2 * F.col("_most"))
    low = F.col("_total") / (2 * F.col("_all") + F.col("_n")) * (1 - 1e-9)
    bounds = bounds.select(*group, "_all", low.alias("_lowest"), high.alias("_highest"))
    above = lambda value: F.floor((F.col("_weight") / value + 1) / 2)
    ratio = F.col("_highest") / F.col("_lowest")
    grid = F.transform(F.sequence(F.lit(1), F.lit(GRID - 1)), lambda k: F.col("_lowest") * F.pow(ratio, k / F.lit(float(GRID))))
    enough = F.col("_found") >= F.col("_all")
    for _ in range(ROUNDS):
        points = live.join(bounds.withColumn("_grid", grid), group).select(*group, "_all", "_lowest", "_highest", "_weight", F.explode("_grid").alias("_value"))
        found = points.groupBy(*group, "_all", "_lowest", "_highest", "_value").agg(F.sum(above(F.col("_value"))).alias("_found"))
        found = found.groupBy(*group, "_all", "_lowest", "_highest").agg(
            F.max(F.when(enough, F.col("_value"))).alias("_under"), F.min(F.when(~enough, F.col("_value"))).alias("_over")
        )
        bounds = found.select(*group, "_all", F.coalesce("_under", "_lowest").alias("_lowest"), F.coalesce("_over", "_highest").alias("_highest"))
        bounds = staged(bounds, "mix-bounds")
    ranged = live.join(bounds, group).select(*group, key, "_all", "_weight", above(F.col("_highest")).alias("_certain"), above(F.col("_lowest")).alias("_upto"))
    left = F.col("_all") - F.coalesce(F.col("_sure"), F.lit(0))
    sure = ranged.groupBy(*group).agg(F.sum("_certain").alias("_sure"))
    tries = ranged.where(F.col("_upto") > F.col("_certain")).join(sure, group)
    tries = tries.withColumn("_try", F.explode(F.sequence(F.col("_certain"), F.col("_upto") - 1)))
    quotient = F.col("_weight") / (2 * F.col("_try") + 1)
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("_quotient").desc(), F.col(key), F.col("_try")))
    won = tries.withColumn("_quotient", quotient).withColumn("_place", place).where(F.col("_place") <= left)
    won = won.groupBy(*group, key).agg(F.count("*").alias("_won"))
    result = ranged.join(won, [*group, key], "left").select(*group, key, (F.col("_certain") + F.coalesce("_won", F.lit(0))).alias(into))
    return rows.join(result, [*group, key], "left").select(*frame.columns, F.coalesce(into, F.lit(0)).cast("long").alias(into))


def source_key(source: Column) -> Column:
    """A name that is never null and sorts nulls last, after all others by code point."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast(StringType())))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(source_key, n_documents, source_size, target) of every source, from rows of `source_key` and `size`.

    A source's target is the smaller of its limit and a level times its weight, with the level that makes the targets add
    up. Going from the sources that reach their limit soonest, the level that the rest would have rises until no source is
    above its limit, so the level is the highest of these. The windows go over sources, not documents.
    """
    sources = sizes.groupBy("source_key").agg(F.count("*").alias("n_documents"), F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("source_key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    sources = sources.withColumn("_weight", weight).withColumn("_most", F.col("source_size") * float(limit))
    every = Window.partitionBy(F.lit(0))
    soonest = every.orderBy(F.col("_most") / F.col("_weight"), "source_key")
    sooner = soonest.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(sooner), F.lit(0.0))
    level = (F.sum("source_size").over(every) * share - before("_most")) / (F.sum("_weight").over(every) - before("_weight"))
    return (
        sources.withColumn("_level", level)
        .withColumn("_level", F.max("_level").over(every))
        .select("source_key", "n_documents", "source_size", F.least(F.col("_most"), F.col("_level") * F.col("_weight")).alias("target"))
    )


def _sharded(rows: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Rows with their source's figures and their shard. The table of sources is small; Spark sees its size and decides."""
    n_shards = F.ceil(F.col("n_documents") / SHARD_DOCUMENTS)
    return rows.join(targets, "source_key").withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), n_shards))


def _shard_quotas(rows: DataFrame, seed: int) -> DataFrame:
    """For each shard its words, blocks, whole passes, and the run of words that is taken once more."""
    shards = staged(rows.groupBy("source_key", "_shard", "target").agg(F.sum("size").alias("_words")), "mix-words")
    # Blocks of the whole mix by source, then of each source by shard.
    sources = shards.groupBy("source_key").agg(F.first("target").alias("target"))
    sources = sources.withColumn("_seats", F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / BLOCK_WORDS).cast("long"))
    sources = staged(sources.withColumn("_mix", F.lit(0)), "mix-targets")
    sources = apportion(sources, ["_mix"], "source_key", "target", "_seats", "_source_blocks")
    shards = staged(shards.drop("target").join(sources.select("source_key", "_source_blocks"), "source_key"), "mix-blocks")
    shards = apportion(shards, ["source_key"], "_shard", "_words", "_source_blocks", "_quota")
    blocks = F.when(F.col("_words") > 0, F.greatest(F.round(F.col("_words") / BLOCK_WORDS).cast("long"), F.lit(1))).otherwise(0)
    shards = shards.withColumn("_blocks", blocks).where(F.col("_blocks") > 0)
    shards = shards.withColumn("_quota", F.least("_quota", F.col("_blocks") * LIMIT))
    passes, rest = F.floor(F.col("_quota") / F.col("_blocks")), F.col("_quota") % F.col("_blocks")
    start = F.pmod(F.xxhash64(F.lit(seed + 1), "source_key", "_shard"), F.col("_blocks") - F.col("_rest") + 1)
    word = lambda block: F.floor(block * F.col("_words") / F.col("_blocks"))
    return (
        shards.withColumn("_passes", passes)
        .withColumn("_rest", rest)
        .withColumn("_start", start)
        .select("source_key", "_shard", "_passes", word(F.col("_start")).alias("_from"), word(F.col("_start") + F.col("_rest")).alias("_to"))
    )


def _placed(rows: DataFrame, seed: int) -> DataFrame:
    """Rows of a frame with doc_id, source_key and size, and what the mix takes: whole passes and words [_low, _high)."""
    targets = staged(source_targets(rows.select("source_key", "size")), "mix-sources")
    placed = _sharded(rows, targets, seed)
    quotas = staged(_shard_quotas(_sharded(rows.select("doc_id", "source_key", "size"), targets, seed), seed), "mix-shards")
    order = Window.partitionBy("source_key", "_shard").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id"), "doc_id", "size")
    end = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("_begin", end - F.col("size")).join(quotas, ["source_key", "_shard"], "left")
    inside = lambda word: F.least(F.greatest(F.coalesce(F.col(word), F.lit(0)) - F.col("_begin"), F.lit(0)), F.col("size"))
    return (
        placed.withColumn("_low", inside("_from").cast("long"))
        .withColumn("_high", inside("_to").cast("long"))
        .withColumn("_passes", F.coalesce(F.col("_passes"), F.lit(0)))
        .withColumn("taken", F.col("_passes") * F.col("size") + F.col("_high") - F.col("_low"))
    )


def plan(documents: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row: the words that the mix takes of it, repeats counted.

    A null text has no words, a null source is a source of its own. Rows that repeat a doc_id are documents of their own in
    the same shard; which of two that are alike in id and size stands first changes nothing. Other columns are ignored. The
    same rows and seed give the same plan, however the rows are spread. An empty table gives an empty plan.
    """
    rows = sized(documents.select("doc_id", "source", "text")).select("doc_id", source_key(F.col("source")).alias("source_key"), "size")
    return _placed(rows, seed).select("doc_id", "size", "source_size", "target", "taken")


def _taken_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as the mix takes them: the whole text for each pass, then the words of the run; passes are parted by a line end."""
    for batch in in_parts(batches):
        index = batch.schema.get_field_index
        texts = batch.column(index("_in_text")).to_pylist()
        figures = zip(*(batch.column(index(c)).to_pylist() for c in ("_passes", "_low", "_high")), strict=True)
        spans = [None] * len(texts)
        for low, _, data, offsets in slices(batch.column(index("_in_text"))):
            starts, ends, first = words(data, offsets, SPACED_WORD)
            for i in range(len(offsets) - 1):
                spans[low + i] = (starts[first[i] : first[i + 1]] - offsets[i], ends[first[i] : first[i + 1]] - offsets[i])
        out = []
        for text, (passes, a, b), (starts, ends) in zip(texts, figures, spans, strict=True):
            parts = [text] * passes
            if b > a:
                parts.append(text if b - a == len(starts) else text.encode()[starts[a] : ends[b - 1]].decode())
            out.append("\n".join(parts))
        columns = list(batch.columns)
        columns[index("_in_text")] = pa.array(out, pa.string())
        columns[index("_in_n_chars")] = pa.array([len(t) for t in out], pa.int64())
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def mix(documents: DataFrame, seed: int = 1) -> DataFrame:
    """The documents that the mix takes words of, with the taken words as text and their length in characters.

    A document taken more than once has its text as often, parted by line ends. The columns are those of `documents`; null
    and wordless texts are not taken.
    """
    # Names of the input's own columns can't clash with what is added.
    own = [f"_in_{c}" for c in documents.columns]
    rows = documents.withColumn("n_chars", F.col("n_chars").cast("long")).toDF(*own)
    rows = rows.withColumns({"doc_id": F.col("_in_doc_id"), "source_key": source_key(F.col("_in_source"))})
    taken = _placed(sized(rows, "_in_text"), seed).where(F.col("taken") > 0).select(*own, "_passes", "_low", "_high")
    return taken.mapInArrow(_taken_text, taken.schema).select(*own).toDF(*documents.columns)
