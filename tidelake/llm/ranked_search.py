"""Ranked lexical search by pipelined term partitioning.

Documents are dealt into blocks. The terms of the items have owners, the rarest terms the first. An item has one bundle for
each block: its terms with their weights, and a sparse accumulator of the block's documents. Bundles pass from owner to owner;
at each they meet, by cogroup, the owner's postings of the block, and its terms add their whole-number contributions. A
document that cannot reach the block's k-th score any more, whatever the later owners add, gets no accumulator: at least k
others stand above it. After the last owner each bundle gives its best documents, and an item's best of all blocks are its result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.llm._common import PLAIN_WORD, signed, slices, span_hashes, staged, unstaged, words

#: Documents of a block, about, and bundles that are taken up at once with one.
BLOCK_DOCUMENTS, BLOCK_ITEMS = 8_192, 256
#: Owners of terms, one after the other.
OWNERS = 4
#: Cells of the map that tells which hashed terms any item may have; a document's other terms need not be written.
CELLS = 1 << 21
#: The unit of a term's contribution, which a document comes near as it repeats the term.
UNIT = 1_000_000

_POSTINGS = "doc_id long, salt long, n long, terms array<long>, counts array<int>"
_ITEM_TERMS = "item_id long, term long, times long"
_BUNDLES = "block long, part long, item_id long, terms array<long>, weights array<long>, docs array<int>, scores array<long>, ends array<int>"


def term_counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """By run of texts: the first, the numbers of terms, and of each text its distinct hashed terms with their counts."""
    for low, _, data, offsets in slices(column):
        starts, ends, first = words(data, offsets, PLAIN_WORD)
        hashes = span_hashes(data, starts, ends, lowered=True)
        terms, counts = [], []
        for i in range(len(offsets) - 1):
            own, n = np.unique(signed(hashes[first[i] : first[i + 1]]), return_counts=True)
            terms.append(own)
            counts.append(n)
        yield low, np.diff(first), terms, counts


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    values = np.concatenate([np.zeros(0, np.int64), *rows])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values).cast(kind))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, _, terms, counts in term_counts(batch.column("text")):
            ids = np.repeat(np.arange(low, low + len(terms)), [len(t) for t in terms])
            arrays = [batch.column("item_id").take(pa.array(ids, pa.int64())), *(pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in (terms, counts))]
            yield pa.RecordBatch.from_arrays(arrays, names=["item_id", "term", "times"])


def _postings(wanted: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() << 40
        for batch in batches:
            for low, sizes, terms, counts in term_counts(batch.column("text")):
                asked = [wanted[t & (CELLS - 1)] for t in terms]
                names = ["doc_id", "salt", "n", "terms", "counts"]
                found = [_lists([t[a] for t, a in zip(terms, asked, strict=True)], pa.int64()), _lists([c[a] for c, a in zip(counts, asked, strict=True)], pa.int32())]
                salts = pa.array(np.arange(salt, salt + len(terms)))
                salt += len(terms)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, len(terms)), salts, pa.array(sizes, pa.int64()), *found], names=names)

    return rows


class _Owner:
    """What an owner does with the bundles of a block: (postings of the block, bundles of a part) -> bundles.

    A bundle's next terms are those up to the first of `ends`; the postings hold the terms of this owner only.
    """

    def __init__(self, documents: int, terms: int, k: int) -> None:
        self.documents, self.total, self.k = documents, terms, k

    def __call__(self, left: pa.Table, right: pa.Table) -> pa.Table:
        bundles = left.combine_chunks()
        n = len(right)
        lists = right["terms"].combine_chunks() if n else pa.array([], pa.list_(pa.int64()))
        lengths = np.asarray(lists.value_lengths()) if n else np.zeros(0, np.int64)
        terms = np.asarray(lists.flatten())
        counts = np.asarray(right["counts"].combine_chunks().flatten()).astype(np.int64) if n else np.zeros(0, np.int64)
        place = np.repeat(np.asarray(right["place"]), lengths) if n else np.zeros(0, np.int64)
        size = np.repeat(np.asarray(right["n"]).astype(np.int64), lengths) if n else np.zeros(0, np.int64)
        order = np.argsort(terms, kind="stable")
        terms, place = terms[order], place[order]
        long = 75 + 25 * size[order] * self.documents // self.total
        parts = (1000 * UNIT * counts[order]) // (1000 * counts[order] + 12 * long)
        sums = np.zeros(int(place.max(initial=-1)) + 1, np.int64)
        out: dict[str, list] = {"docs": [], "scores": [], "terms": [], "weights": [], "ends": []}
        for own_terms, weights, ends, docs, scores in zip(*(bundles[c] for c in ("terms", "weights", "ends", "docs", "scores")), strict=True):
            own_terms, weights, ends, docs, scores = (np.asarray(x.values) for x in (own_terms, weights, ends, docs, scores))
            here = int(ends[0])
            if len(docs) and docs.max() >= len(sums):
                sums = np.concatenate([sums, np.zeros(int(docs.max()) + 1 - len(sums), np.int64)])
            sums[docs] = scores
            touched = [docs]
            lows, highs = (np.searchsorted(terms, own_terms[:here], side) for side in ("left", "right"))
            for low, high, weight in zip(lows, highs, weights[:here], strict=True):
                sums[place[low:high]] += weight * parts[low:high]  # a document has a term once
                touched.append(place[low:high])
            met = np.unique(np.concatenate(touched))
            found = sums[met]
            sums[met] = 0
            rest = int(weights[here:].sum()) * UNIT
            # Without those that got nothing, and those below the k-th of the block even with all that may come.
            keep = found > 0
            if keep.sum() > self.k:
                keep &= found + rest >= np.partition(found, -self.k)[-self.k]
                if not rest:  # equal scores: places go by id
                    keep &= np.isin(np.arange(len(met)), np.lexsort((met, -found))[: self.k])
            for name, values in (("docs", met[keep]), ("scores", found[keep]), ("terms", own_terms[here:]), ("weights", weights[here:]), ("ends", ends[1:] - here)):
                out[name].append(values)
        columns = {name: bundles[name] for name in ("block", "part", "item_id")}
        for name in ("terms", "weights", "docs", "scores", "ends"):
            columns[name] = _lists(out[name], pa.int32() if name in ("docs", "ends") else pa.int64())
        return pa.table(columns)


def _passed(bundles: DataFrame, postings: DataFrame, owner: _Owner) -> DataFrame:
    """The bundles after an owner's terms have been added."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return owner(left, right) if len(left) else _NO_BUNDLES.empty_table()

    return bundles.groupBy("block", "part").cogroup(postings.groupBy("block", "part")).applyInArrow(meet, _BUNDLES)


_NO_BUNDLES = pa.schema(
    [(n, pa.int64()) for n in ("block", "part", "item_id")]
    + [("terms", pa.list_(pa.int64())), ("weights", pa.list_(pa.int64())), ("docs", pa.list_(pa.int32())), ("scores", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32()))]
)


def search(documents: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score) of the `k` best documents of each item, all if fewer have a score above 0.

    Terms are runs of letters, digits and characters beyond ASCII, with A-Z as a-z. A term weighs
    floor(1000 ln((2N + 2) / (2 df + 1))) of N documents with any term; it adds its weight times
    1000000000 tf div (1000 tf + 12 m) to a document's score, m = 75 + 25 n N div L for n terms of L in all documents, as often
    as the item has it. Equal scores are ranked by ascending doc_id.

    Null and empty texts have no terms. Rows that repeat a doc_id are documents of their own; rows without one count in
    the statistics and are not ranked. Rows that repeat an item_id are one item; those without one, and items of
    which no term occurs, have no result. Other columns are ignored; empty tables give no rows. Terms are 64-bit hashes.
    """
    asked = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_item_terms, _ITEM_TERMS)
    asked = staged(asked.groupBy("item_id", "term").agg(F.sum("times").alias("times")), "search-items")
    cells = asked.select(F.col("term").bitwiseAND(CELLS - 1).alias("cell")).distinct().toArrow()["cell"]  # CELLS at most
    wanted = np.zeros(CELLS, bool)
    wanted[np.asarray(cells)] = True

    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_postings(wanted), _POSTINGS)
    found = staged(found, "search-postings")
    n_docs, n_terms, most = found.agg(F.count_if(F.col("n") > 0), F.sum("n"), F.count_if(F.size("terms") > 0)).first()
    df = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.ln((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = asked.join(df, "term").withColumn("weight", weight).where(F.col("weight") > 0)
    weighed = staged(weighed.select("item_id", "term", "weight", (F.col("weight") * F.col("times")).alias("adds")), "search-weights")

    # Owners by weight, the heaviest terms first: equal weights have one owner.
    cuts = weighed.agg(F.percentile_approx("weight", [1 - i / OWNERS for i in range(1, OWNERS)], 1000)).first()[0] or []
    owner_of = sum((F.when(F.col("weight") < cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    owned = weighed.withColumn("owner", owner_of)
    blocks = max(1, -(-(most or 0) // BLOCK_DOCUMENTS))
    parts = max(1, -(-weighed.select("item_id").distinct().count() // BLOCK_ITEMS))

    # A bundle for every item and block: the blocks are numbered, not looked up.
    terms = F.sort_array(F.collect_list(F.struct("owner", "term", "adds")))
    ends = F.array(*[F.count_if(F.col("owner") <= i).cast("int") for i in range(OWNERS)])
    bundles = owned.groupBy("item_id").agg(terms.alias("own"), ends.alias("ends"))
    bundles = bundles.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        F.pmod(F.xxhash64("item_id"), F.lit(parts)).alias("part"),
        "item_id",
        F.col("own.term").alias("terms"),
        F.col("own.adds").alias("weights"),
        F.array().cast("array<int>").alias("docs"),
        F.array().cast("array<long>").alias("scores"),
        "ends",
    )

    # Documents have a number in their block, in the order of ids, given once and written.
    placed = found.where((F.size("terms") > 0) & F.col("doc_id").isNotNull()).withColumn("block", F.pmod(F.xxhash64("salt"), F.lit(blocks)))
    placed = placed.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy("doc_id", "salt")) - 1)
    placed = staged(placed.select("block", "place", "doc_id", "n", "terms", "counts"), "search-blocks")
    unstaged(found)
    every_part = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part")
    pairs = placed.select("block", "place", "n", F.explode(F.arrays_zip("terms", "counts")).alias("pair"))
    pairs = pairs.select("block", "place", "n", F.col("pair.terms").alias("term"), F.col("pair.counts").alias("count"))
    owners = owned.select("term", "owner").distinct()
    of_owner = pairs.join(owners, "term").groupBy("block", "place", "n", "owner")
    of_owner = staged(of_owner.agg(F.collect_list("term").alias("terms"), F.collect_list("count").alias("counts")), "search-owned")
    owner = _Owner(n_docs or 0, max(1, n_terms or 0), k)
    for i in range(OWNERS):
        own = of_owner.where(F.col("owner") == i).select("block", "place", "n", "terms", "counts", every_part)
        bundles = _passed(bundles, own, owner)

    hits = bundles.select("item_id", "block", F.explode(F.arrays_zip("docs", "scores")).alias("hit"))
    hits = hits.select("item_id", "block", F.col("hit.docs").alias("place"), F.col("hit.scores").alias("score"))
    named = hits.join(placed.select("block", "place", "doc_id"), ["block", "place"])
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id", "block", "place")
    ranked = named.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
