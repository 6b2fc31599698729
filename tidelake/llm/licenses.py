"""License scan by diagonal voting.

All rolling word pairs of a text are joined with the pairs of the license templates. A pair at word i of the text and at
word j of a template votes for the diagonal i - j: the place where the template would start. Neighbouring diagonals of one
template are merged, which bridges words put in or left out, and a span counts when enough of the template's pairs voted.
Phrases are templates that must be matched whole on one diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.llm._common import PLAIN_WORD, grams, signed, slices, span_hashes, words

#: Words of a gram.
K = 2
#: Votes are bits of longs: one long for so many grams of a template.
BITS = 63
#: Diagonals at most this far apart are merged.
GAP = 3
#: Share of a template's grams that must have voted for a span to count.
SHARE = 0.7


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False


# Phrases and their labels.
PHRASES = [
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
]
# Opening words of well-known license texts and notices.
TEXTS = [
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mit", "released under the mit license"),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("gpl", "this work is licensed under the gnu general public license version"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license"),
    Template("cc", "licensed under cc by"),
    Template("cc", "this work is licensed under a creative commons attribution"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
]
# License texts in whole, after their title and copyright lines, in lower case and without signs.
TEXTS += [
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
        "the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to "
        "the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright "
        "holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or "
        "in connection with the software or the use or other dealings in the software",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims "
        "all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the "
        "author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data "
        "or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or "
        "performance of this software",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
        "are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in "
        "the documentation and or other materials provided with the distribution this software is provided by the copyright holders and "
        "contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and "
        "fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct "
        "indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or "
        "services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract "
        "strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the "
        "possibility of such damage",
    ),
]


def _gram_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By run of rows: its first row, number of words by row, and row, first word and hash of every gram."""
    for low, _, data, offsets in slices(column):
        starts, ends, first = words(data, offsets, PLAIN_WORD)
        h, at = grams(span_hashes(data, starts, ends, lowered=True), first, K)
        row = np.searchsorted(first, at, "right") - 1
        yield low, np.diff(first), row, at - first[row], signed(h)


def _emit_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each gram, and for each text one at place -1 that has its number of words in place of a hash."""
    for batch in batches:
        ids = batch.column("doc_id")
        texts = batch.column("text")
        prints = np.array([xxhash.xxh3_64_intdigest(t.as_buffer() if t.is_valid else b"") for t in texts.cast(pa.binary())], np.uint64).view(np.int64)
        for low, n_words, row, place, h in _gram_hashes(texts):
            rows = np.concatenate([np.arange(len(n_words)), row]) + low
            places = np.concatenate([np.full(len(n_words), -1), place])
            hashes = np.concatenate([n_words, h])
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows)), pa.array(prints[rows]), pa.array(places.astype(np.int64)), pa.array(hashes)],
                names=["doc_id", "text_print", "place", "gram"],
            )


def template_rows(templates: list[Template]) -> list[tuple[int, int, int]]:
    """(gram, template, place in the template) of all grams of the templates."""
    return [
        (int(gram), low + int(row), int(place))
        for low, _, rows, places, hashes in _gram_hashes(pa.array([t.text for t in templates], pa.string()))
        for row, place, gram in zip(rows, places, hashes, strict=True)
    ]


def spans(documents: DataFrame, templates: list[Template], gap: int = GAP, share: float = SHARE) -> DataFrame:
    """(doc_id, text_print, template, start, votes, n_words, n_rows): verified spans, and for each text one row without a template.

    `start` is the word where the template starts (the lowest of the merged diagonals). A null text is an empty one. Rows
    that repeat a doc_id with the same text are found once, and `n_rows` of the row without a template is their number;
    with another text they are another document. Templates may have any length.
    """
    spark = documents.sparkSession
    rows = template_rows(templates)
    sizes = [sum(1 for _, t, _ in rows if t == number) for number in range(len(templates))]
    wanted = spark.createDataFrame(rows, "wanted long, template int, in_template int")
    grams_of = documents.select("doc_id", "text").mapInArrow(_emit_grams, "doc_id long, text_print long, place long, gram long")
    hits = grams_of.join(F.broadcast(wanted), (F.col("gram") == F.col("wanted")) & (F.col("place") >= 0), "left")
    hits = hits.where((F.col("place") < 0) | F.col("template").isNotNull())
    # One shuffle: all that follows keeps the rows of a text together.
    hits = hits.repartition("doc_id", "text_print")
    key = ["doc_id", "text_print", "template"]
    whole_text = F.col("place") < 0
    diagonals = (
        hits.withColumn("diagonal", F.col("place") - F.col("in_template"))
        .withColumn("part", F.floor(F.col("in_template") / BITS))
        .groupBy(*key, "diagonal", "part")
        .agg(
            F.bit_or(F.expr(f"shiftleft(1L, in_template % {BITS})")).alias("voters"),
            F.max(F.when(whole_text, F.col("gram"))).alias("n_words"),
            F.count(F.when(whole_text, 1)).alias("n_rows"),
        )
    )
    whole = F.element_at(F.array(*[F.lit(t.phrase) for t in templates]), F.col("template") + 1)
    size = F.element_at(F.array(*[F.lit(n) for n in sizes]), F.col("template") + 1)
    in_order = Window.partitionBy(*key).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(in_order) > F.when(whole, 0).otherwise(gap), F.lit(True))
    merged = (
        diagonals.withColumn("apart", apart.cast("int"))
        .withColumn("span", F.sum("apart").over(in_order))
        .groupBy(*key, "span", "part")
        .agg(F.min("diagonal").alias("start"), F.bit_or("voters").alias("voters"), F.max("n_words").alias("n_words"), F.max("n_rows").alias("n_rows"))
        .groupBy(*key, "span")
        .agg(
            F.min("start").alias("start"),
            F.sum(F.bit_count("voters")).alias("voted"),
            F.max("n_words").alias("n_words"),
            F.max("n_rows").alias("n_rows"),
        )
        .withColumn("votes", F.col("voted") / size)
    )
    enough = F.col("votes") >= F.when(whole, 1.0).otherwise(share)
    return merged.where(F.col("template").isNull() | enough).select(*key, "start", "votes", "n_words", "n_rows")


def scan(documents: DataFrame, phrases: list[Template] | None = None, texts: list[Template] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document.

    Base: places of phrases, with the first and last word they start at, and their labels; `labels` adds those of license
    texts found by votes. Labels are distinct, sorted and joined by commas; without any, empty. `score` is the
    largest share of a template's grams in a span, 0 without one. An empty text has no words and no places. Rows that repeat
    an id each have their row.
    """
    phrases, texts = PHRASES if phrases is None else phrases, TEXTS if texts is None else texts
    templates = [*phrases, *texts]
    label = F.element_at(F.array(*[F.lit(t.label) for t in templates]), F.col("template") + 1)
    base = F.col("template") < len(phrases)
    joined = lambda column: F.concat_ws(",", F.array_sort(F.collect_set(column)))
    return (
        spans(documents, templates)
        .groupBy("doc_id", "text_print")
        .agg(
            F.max("n_words").alias("n_words"),
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start"))).alias("first_word"),
            F.max(F.when(base, F.col("start"))).alias("last_word"),
            joined(F.when(base, label)).alias("base_labels"),
            joined(label).alias("labels"),
            F.coalesce(F.max("votes"), F.lit(0.0)).alias("score"),
            F.max("n_rows").alias("n_rows"),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_rows"))))
        .drop("text_print", "n_rows", "copy")
    )
