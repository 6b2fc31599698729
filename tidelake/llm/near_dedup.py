"""Near-duplicates by bottom-k sketches of one hash function, with exact verification.

A document is the set of hashes of its word shingles; its sketch holds the smallest of them. Documents with equal sets are one
class. Classes meet in inverted lists of retained values. If two sets are alike enough, their sketches share more than a
known number of values, so each class need only be listed under its rarest values: all but one less than that
number. Values of one class alone make no lists, and common ones are left to classes that have hardly any others.

In each band of a list, of classes alike enough in size, classes are first compared with one of them, the hub: groups of near copies become stars and not all pairs.
Pairs pass if the estimate of the union's sketch allows it and the full sets confirm it. What is left are classes of a list
that no star has joined. They are compared with the others of the hub's component in blocks, by sketches and then by
full sets, and only links that join components come out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.llm._common import SPACED_WORD, grams, mixed, signed, slices, span_hashes, staged, unstaged, words
from tidelake.llm.components import components

#: Values of a sketch.
SKETCH = 64
#: Estimates below this are not verified: at a likeness of 0.8, one in a hundred million is lower.
ESTIMATE = 0.5
#: Members of a family that are compared at once: of those outside its component, and of all.
OUTSIDE_BLOCK, ALL_BLOCK = 512, 2048


# ---------------------------------------------------------------- sets and sketches


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """By run of texts: the first, and for each the ascending hashes of its distinct shingles of k words.

    A text of fewer words has one of them all, a text without words none.
    """
    for low, _, data, offsets in slices(column):
        starts, ends, first = words(data, offsets, SPACED_WORD)
        hashes = span_hashes(data, starts, ends, lowered=True)
        h, at = grams(hashes, first, k)
        edge = np.searchsorted(at, first)
        found = []
        for i in range(len(offsets) - 1):
            n = first[i + 1] - first[i]
            if 0 < n < k:
                few = np.full(1, n, np.uint64)
                for word in hashes[first[i] : first[i + 1]]:
                    few = mixed(few * np.uint64(0x9E3779B97F4A7C15) + word)
                found.append(signed(few))
            else:
                found.append(np.unique(signed(h[edge[i] : edge[i + 1]])))
        yield low, found


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def _set_rows(k: int, size: int | None) -> Callable:
    """(doc_id, n, print, hashes): number of shingles, digest of the set, and its smallest `size` hashes or all."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for low, found in shingle_sets(batch.column("text"), k):
                n = pa.array([len(own) for own in found], pa.int64())
                prints = pa.array([xxhash.xxh3_128_digest(own.tobytes()) for own in found], pa.binary())
                hashes = _lists([own[:size] for own in found])
                yield pa.RecordBatch.from_arrays([ids.slice(low, len(found)), n, prints, hashes], names=["doc_id", "n", "print", "hashes"])

    return rows


_SET = "doc_id long, n long, print binary, hashes array<long>"


# ---------------------------------------------------------------- candidates


def _prefix_lists(classes: DataFrame, percent: int) -> DataFrame:
    """(value, rep, n): each class under its rarest retained values that others have as well."""
    values = classes.select("rep", "n", F.explode("hashes").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("df")).where(F.col("df") > 1)
    met = values.join(shared, "value")
    # Sets that are whole in the sketch, like all that can be near to them, share this share of their values exactly.
    least = F.when(F.col("n") * 100 <= SKETCH * percent, F.ceil(F.col("n") * percent / 100)).otherwise(SKETCH * (percent - 30) // 100)
    of_class = Window.partitionBy("rep")
    ranked = met.withColumn("rank", F.row_number().over(of_class.orderBy("df", "value"))).withColumn("met", F.count("*").over(of_class))
    # Values that no other class has are rarer still and fill the prefix first.
    return ranked.where(F.col("rank") <= F.col("met") - least + 1).select("value", "rep", "n")


def _alike_in_size(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) with the estimate: the share of the union's smallest values that both sketches hold."""
    sketches = classes.select("rep", "hashes")
    for side in ("a", "b"):
        pairs = pairs.join(sketches.select(F.col("rep").alias(side), F.col("hashes").alias(f"of_{side}")), side)
    union = F.slice(F.array_sort(F.array_union("of_a", "of_b")), 1, SKETCH)
    both = F.array_intersect(F.array_intersect("of_a", "of_b"), F.col("union"))
    pairs = pairs.withColumn("union", union)
    return pairs.withColumn("estimate", F.size(both) / F.size("union")).drop("of_a", "of_b", "union")


def _full_sets(reps: DataFrame, classes: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """(rep, hashes): the full sets of the classes in `reps`, from the texts of the documents that stand for them."""
    needed = staged(reps.join(classes.select("rep", "print"), "rep"), "near-needed")
    texts = documents.join(needed.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    sets = texts.mapInArrow(_set_rows(k, None), _SET).select(F.col("doc_id").alias("rep"), "print", "hashes")
    sets = sets.join(needed, ["rep", "print"], "left_semi").dropDuplicates(["rep", "print"]).select("rep", "hashes")
    sets = staged(sets, "near-sets")
    unstaged(needed)
    return sets


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are alike."""
    pairs = pairs.select("a", "b")
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("rep").alias(side), F.col("hashes").alias(f"of_{side}")), side)
    both = F.size(F.array_intersect("of_a", "of_b"))
    alike = F.col("both") * 100 >= (F.size("of_a") + F.size("of_b") - F.col("both")) * percent
    return staged(pairs.withColumn("both", both).where(alike).select("a", "b"), "near-links")


def _links(classes: DataFrame, documents: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified links (a, b) between classes that connect all that are connected by any."""
    lists = staged(_prefix_lists(classes, percent), "near-lists")
    spokes = staged(_spokes(lists, percent), "near-spokes")
    unstaged(lists)
    likely = _estimated(spokes.where("alike").select("a", "b"), classes).where(F.col("estimate") >= ESTIMATE)
    likely = staged(likely.select("a", "b"), "near-likely")
    ends = likely.select(F.col("a").alias("rep")).unionByName(likely.select(F.col("b").alias("rep"))).distinct()
    sets = _full_sets(ends, classes, documents, k)
    first = _verified(likely, sets, percent)
    families = _families(spokes, components(first))
    # Families whose sketches show that two of different components might be alike, without those that can't be in it.
    sketched = families.join(classes.select("rep", "hashes"), "rep")
    open_ = staged(_in_cells(sketched, _Likely(percent), "family long, rep long, component long").distinct(), "near-open")
    more = open_.select("rep").distinct().join(sets.select("rep"), "rep", "left_anti")
    more_sets = _full_sets(more, classes, documents, k)
    confirmed = _in_cells(_counted(open_).join(sets.unionByName(more_sets), "rep"), _Alike(percent), "a long, b long")
    second = staged(confirmed, "near-links")
    unstaged(spokes, likely, sets, more_sets, open_)
    links = staged(first.unionByName(second), "near-links")
    unstaged(first, second)
    return links


def _spokes(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b, alike): each class of a list with its hub, and whether their sizes allow a link.

    Sets that are alike are so in size, so a list falls into bands of sizes: the size of a class puts it into two neighbouring
    ones, and two classes that are alike share one. The smallest id of a band is its hub: the bands that two classes share
    mostly have the same one. Of a band of two that are not alike in size nothing is left to compare.
    """
    # A little wider than the ratio, so that rounding parts no two; at 100 alike sizes are equal ones.
    width = math.log(100 / percent) * (1 + 1e-9)
    step = F.floor(F.ln(F.col("n")) / width) if width else 2 * F.col("n")
    banded = lists.select("value", "rep", "n", F.explode(F.array(step, step + 1)).alias("band")).repartition("value", "band")
    hubs = banded.groupBy("value", "band").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count("*").alias("members"))
    listed = banded.join(hubs.where(F.col("members") > 1), ["value", "band"]).where(F.col("rep") != F.col("hub.rep"))
    alike = _alike_in_size(F.col("n"), F.col("hub.n"), percent).alias("alike")
    spokes = listed.select(F.col("rep").alias("a"), F.col("hub.rep").alias("b"), alike, "members")
    return spokes.where(F.col("alike") | (F.col("members") > 2)).select("a", "b", "alike").distinct()


# ---------------------------------------------------------------- families


def _families(spokes: DataFrame, joined: DataFrame) -> DataFrame:
    """(family, rep, component, inside, outside): what is left to compare, as members of families.

    A family is the component of a hub, and its members are all classes of lists with such a hub. Members of the same
    component need no more links. Members outside it are compared with all others, in blocks.
    """
    part = lambda column: joined.select(F.col("node").alias(column), F.col("component").alias(f"part_{column}"))
    pairs = spokes.select("a", "b").join(part("a"), "a", "left").join(part("b"), "b", "left")
    family, own = F.coalesce("part_b", "b").alias("family"), F.coalesce("part_a", "a").alias("component")
    hubs = pairs.select(family, F.col("b").alias("rep"), F.coalesce("part_b", "b").alias("component"))
    members = pairs.select(family, F.col("a").alias("rep"), own).unionByName(hubs).distinct()
    # A family of a hub and one more is done: the two have been compared.
    return _counted(members).where(F.col("all") > 2)


def _counted(members: DataFrame) -> DataFrame:
    """With the numbers of members of each family, all and outside its component, without families that are in it whole."""
    outside = F.count(F.when(F.col("component") != F.col("family"), 1))
    counts = members.groupBy("family").agg(F.count("*").alias("all"), outside.alias("outside"))
    return members.join(counts.where(F.col("outside") > 0), "family")


def _in_cells(members: DataFrame, compare: Callable, schema: str) -> DataFrame:
    """What `compare` finds between the members outside a family's component, in blocks, and all, in blocks."""
    ours, theirs = (F.ceil(F.col(c) / size).cast("long") for c, size in (("outside", OUTSIDE_BLOCK), ("all", ALL_BLOCK)))
    members = members.withColumns({"_ours": ours, "_theirs": theirs, "_asks": F.col("component") != F.col("family")})
    block = lambda blocks: F.pmod(F.xxhash64("rep"), F.col(blocks))
    cell = lambda a, b, asks, answers: F.struct(a.alias("i"), b.alias("j"), F.lit(asks).alias("asks"), F.lit(answers).alias("answers"))
    every = lambda blocks: F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)
    answering = F.transform(every("_ours"), lambda i: cell(i, block("_theirs"), False, True))
    asking = F.when(F.col("_asks"), F.transform(every("_theirs"), lambda j: cell(block("_ours"), j, True, False)))
    both = F.array(F.struct(block("_ours").alias("i"), block("_theirs").alias("j"), F.col("_asks").alias("asks"), F.lit(True).alias("answers")))
    single = (F.col("_ours") == 1) & (F.col("_theirs") == 1)
    cells = F.when(single, both).otherwise(F.concat(answering, F.coalesce(asking, F.array().cast(_CELLS))))
    rows = members.select("family", "rep", "component", "hashes", F.explode(cells).alias("cell"))
    rows = rows.select("family", "rep", "component", "hashes", "cell.*")
    return rows.groupBy("family", "i", "j").applyInArrow(lambda cell: compare(cell), schema)  # it takes functions only


_CELLS = "array<struct<i:bigint,j:bigint,asks:boolean,answers:boolean>>"


class _Cell:
    """The members of a cell, with the number of values that one shares with each."""

    def __init__(self, cell: pa.Table) -> None:
        lists = cell["hashes"].combine_chunks()
        _, self.values = np.unique(np.asarray(lists.flatten()), return_inverse=True)
        self.starts = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
        self.sizes = np.diff(self.starts)
        self.reps, self.components = np.asarray(cell["rep"]), np.asarray(cell["component"])
        self.asks, self.answers = np.flatnonzero(np.asarray(cell["asks"])), np.asarray(cell["answers"])
        self._mark = np.zeros(int(self.values.max(initial=-1)) + 1, bool)

    def shared(self, i: int) -> np.ndarray:
        own = self.values[self.starts[i] : self.starts[i + 1]]
        self._mark[own] = True
        sums = np.concatenate([[0], np.cumsum(self._mark[self.values])])
        self._mark[own] = False
        return sums[self.starts[1:]] - sums[self.starts[:-1]]


class _Likely:
    """The members (family, rep, component) of a cell that, by their sketches, might be alike another of another component.

    A share of the smaller sketch is at least the estimate's share of the union's, so none that passes that is left out.
    """

    def __init__(self, percent: int) -> None:
        self.percent = percent

    def __call__(self, table: pa.Table) -> pa.Table:
        cell = _Cell(table)
        found = np.zeros(len(cell.reps), bool)
        for i in cell.asks:
            might = cell.answers & (cell.components != cell.components[i])
            might &= cell.shared(i) >= ESTIMATE * np.minimum(SKETCH, np.maximum(cell.sizes, cell.sizes[i]))
            if might.any():
                found |= might
                found[i] = True
        family = np.full(int(found.sum()), table["family"][0].as_py() if len(table) else 0)
        return pa.table({"family": family, "rep": cell.reps[found], "component": cell.components[found]})


class _Alike:
    """Links (a, b) between members of a cell whose full sets are alike: those that join components not joined before."""

    def __init__(self, percent: int) -> None:
        self.percent = percent

    def __call__(self, table: pa.Table) -> pa.Table:
        cell = _Cell(table)
        names, part = np.unique(cell.components, return_inverse=True)
        part = part.copy()  # grows together as links are found
        links = []
        for i in cell.asks:
            both = cell.shared(i)
            alike = cell.answers & (both * 100 >= (cell.sizes + cell.sizes[i] - both) * self.percent)
            for j in np.flatnonzero(alike & (part != part[i])):
                if part[j] != part[i]:
                    links.append((cell.reps[i], cell.reps[j]))
                    part[part == part[j]] = part[i]
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: groups of documents whose shingle sets are alike.

    Words are parted by white space and A-Z count as a-z. Two documents are linked if the intersection of their sets has at
    least `percent` in a hundred of the union; `component_id` is the smallest id that links reach, and the document
    with it is kept. Documents without words, and rows without an id, are linked with nothing and kept (component: their
    own id). Rows that repeat an id are one document; each gets its row. Other columns are ignored. Links are confirmed
    on full sets of 64-bit hashes.
    """
    documents = documents.select(F.col("doc_id").cast("long"), "text")
    sketches = staged(documents.mapInArrow(_set_rows(k, SKETCH), _SET), "near-sketches")
    sets = staged(sketches.select("doc_id", "n", "print"), "near-documents")
    live = sets.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    lowest = live.groupBy("print").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    chosen = sketches.join(lowest.select("print", F.col("rep").alias("doc_id")), ["print", "doc_id"], "left_semi")
    classes = chosen.dropDuplicates(["print", "doc_id"]).withColumnRenamed("doc_id", "rep")
    classes = staged(classes, "near-classes")
    unstaged(sketches)
    groups = components(_links(classes, documents, k, percent)).withColumnRenamed("node", "rep")
    unstaged(classes)
    # Only classes of several documents, or with links, can differ from their own id.
    moved = lowest.join(groups, "rep", "left").where((F.col("copies") > 1) | F.col("component").isNotNull())
    moved = moved.select("print", F.coalesce("component", "rep").alias("found"))
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).otherwise(F.col("doc_id"))
    told = sets.select("doc_id", "n", "print").join(moved, "print", "left").withColumn("component_id", component)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return told.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def drop_near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are kept, with all their columns: one of each group, and all rows without an id."""
    dropped = near_duplicates(documents, k, percent).where(~F.col("kept")).select("doc_id").distinct()
    return documents.join(dropped, "doc_id", "left_anti").select(*documents.columns)
