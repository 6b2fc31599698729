"""URL filter: path rules, then a likelihood ratio of two character language models.

Two smoothed variable-order Markov models, one of accepted and one of rejected URLs, give each URL the difference of its
log-likelihoods per byte. Each order's estimate leans on the next lower order's (Dirichlet smoothing), so a context that
was never seen leaves the decision to shorter ones. URLs below a threshold, calibrated on a quarter of the labelled URLs
that the counts leave out, are blocked.

A byte and the five before it are one whole number, so the counts are exact: a table of n-grams that grows with the URLs
and stays with the executors. Lower orders are sums of it over shorter suffixes. What a byte adds to the score of its URL
depends on its n-gram alone; it is worked out once for each different n-gram and joined with the places that hold it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.llm._common import SLICE_BYTES, staged, text_bytes, unstaged

#: Highest order of the models: bytes of context. With the byte itself they fit into a long.
ORDER = 5
#: Stands for the places before a URL; no byte of UTF-8.
BEFORE = 0xFF
#: Scores of n-grams are whole multiples of one in this many, so that their sums do not depend on the order of rows.
FINE = 1 << 20
#: The most common n-grams, this many, meet their places by a broadcast; any other holds less than one in as many places.
COMMON = 4096
#: Weight of the next lower order's estimate, in characters seen.
PRIOR = 4.0
#: Share of accepted URLs, held out from the counts, that the threshold may reject.
FALSE_REJECTS = 0.005
#: The calibration works on scores rounded to this many steps per unit, within the limits below.
STEPS, LIMIT = 100, 8


@dataclass(frozen=True)
class Rule:
    """A rule like `example.org/en/`: the host and its subdomains, paths that start with what follows the host."""

    text: str
    allow: bool

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


@dataclass(frozen=True)
class UrlModels:
    """(gram, accepted, rejected): how often each n-gram of the highest order is in URLs of either kind; and the threshold."""

    counts: DataFrame
    threshold: float


# ---------------------------------------------------------------- rules


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The text of the longest rule that fits, else null; of equally long ones, that with the longer host."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), len(r.host))):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.when(fits, F.lit(rule.text)).otherwise(found)
    return found


# ---------------------------------------------------------------- models


def _places(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every byte the number of its text and its n-gram: the byte itself lowest, the one before it above, and so on."""
    data, offsets = text_bytes(column)
    for low in range(0, len(data), SLICE_BYTES):
        high = min(len(data), low + SLICE_BYTES)
        at = np.arange(low, high)
        row = np.searchsorted(offsets, at, "right") - 1
        place = at - offsets[row]
        gram = data[low:high].astype(np.int64)
        for back in range(1, ORDER + 1):
            gram |= np.where(place >= back, data[np.maximum(at - back, 0)], BEFORE).astype(np.int64) << (8 * back)
        yield row, gram


def _count_labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rejected = np.asarray(batch.column("rejected"), bool)
        for row, gram in _places(batch.column("url")):
            grams, which = np.unique(gram, return_inverse=True)
            n, bad = np.bincount(which), np.bincount(which, rejected[row]).astype(np.int64)
            yield pa.record_batch({"gram": grams, "accepted": n - bad, "rejected": bad})


def _suffix(gram: Column, order: int) -> Column:
    """The last bytes of an n-gram: the n-gram of a lower order."""
    return gram.bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1).cast("long"))


def _gram_scores(counts: DataFrame, seen: DataFrame) -> DataFrame:
    """(gram, score, seen) of every n-gram of `seen`: its log-probability as accepted less that as rejected, in steps of 1 / FINE.

    From order to order: the counts of an order are sums over suffixes, those of its contexts sums over the byte that
    follows (256 rows at most), and the estimate of the order below comes by a join on the suffix. The result is staged.
    """
    none = F.lit(0).cast("long")
    wanted = seen.select("gram", none.alias("accepted"), none.alias("rejected"), "seen")
    known = staged(
        counts.withColumn("seen", none).unionByName(wanted).groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("accepted", "rejected", "seen")]),
        "url-grams",
    )
    below = None
    for order in range(ORDER + 1):
        sums = [F.sum(c).alias(c) for c in ("accepted", "rejected", "seen")]
        level = known.groupBy(_suffix(F.col("gram"), order).alias("gram")).agg(*sums) if order < ORDER else known
        in_context = Window.partitionBy(F.shiftright("gram", 8))
        level = level.select("*", *[F.sum(c).over(in_context).alias(f"all_{c}") for c in ("accepted", "rejected")])
        level = level.where(F.col("seen") > 0)  # what no URL has needs no estimate, here or above
        if below is None:
            level = level.select("*", F.lit(1 / 256).alias("p_accepted"), F.lit(1 / 256).alias("p_rejected"))
        else:
            level = level.withColumn("suffix", _suffix(F.col("gram"), order - 1)).join(below, "suffix")
        p = {c: (F.col(c) + F.lit(PRIOR) * F.col(f"p_{c}")) / (F.col(f"all_{c}") + F.lit(PRIOR)) for c in ("accepted", "rejected")}
        below = level.select(F.col("gram").alias("suffix"), p["accepted"].alias("p_accepted"), p["rejected"].alias("p_rejected"), "seen")
        if order < ORDER:
            below = below.drop("seen")
    score = F.round((F.log("p_accepted") - F.log("p_rejected")) * FINE).cast("long")
    scores = staged(below.select(F.col("suffix").alias("gram"), score.alias("score"), "seen"), "url-gram-scores")
    unstaged(known)
    return scores


def _scored(urls: DataFrame, models: UrlModels, url: str, into: str) -> tuple[DataFrame, list[DataFrame]]:
    """The scored frame and the staged frames that it reads."""
    row_id = "row"
    while row_id in urls.columns:
        row_id += "_"
    rows = staged(urls.drop(into).withColumn(row_id, F.monotonically_increasing_id()), "urls")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, gram in _places(batch.column(0)):
                grams, n = np.unique(gram, return_counts=True)
                yield pa.record_batch({"gram": grams, "seen": n.astype(np.int64)})

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for row, gram in _places(batch.column(1)):
                yield pa.record_batch({"row": ids[row], "gram": gram})

    text = F.col(url).alias("text")
    seen = rows.select(text).mapInArrow(count, "gram long, seen long").groupBy("gram").agg(F.sum("seen").alias("seen"))
    scores = _gram_scores(models.counts, seen)
    common = scores.orderBy(F.desc("seen"), "gram").limit(COMMON).select("gram", F.col("score").alias("common_score"))
    met = rows.select(F.col(row_id).alias("row"), text).mapInArrow(places, "row long, gram long").join(F.broadcast(common), "gram", "left")
    near = met.where(F.col("common_score").isNotNull()).select("row", F.col("common_score").alias("score"))
    far = met.where(F.col("common_score").isNull()).join(scores.select("gram", "score"), "gram").select("row", "score")
    sums = near.unionByName(far).groupBy(F.col("row").alias(row_id)).agg(F.sum("score").alias("url_score_sum"))
    per_byte = F.coalesce(F.col("url_score_sum") / F.lit(float(FINE)) / F.octet_length(url), F.lit(0.0))
    return rows.join(sums, row_id, "left").select(*[c for c in urls.columns if c != into], per_byte.alias(into)), [rows, scores]


def score_urls(urls: DataFrame, models: UrlModels, url: str = "url", into: str = "ratio") -> DataFrame:
    """The frame with the log-likelihood difference per byte of its column `url` (null or empty: 0) as `into`.

    A column that is named like `into` is replaced. Repeated rows each have their score. The rows are staged with a number,
    since their n-grams leave them and come back as a sum; take only the columns that are needed.
    """
    return _scored(urls, models, url, into)[0]


def fit(labelled: DataFrame, false_rejects: float = FALSE_REJECTS) -> UrlModels:
    """Models of the labelled URLs: frame of `url` and boolean `rejected`.

    A quarter of the distinct URLs, by hash, is left out of the counts; on it the threshold is set so that at most
    the share `false_rejects` of accepted URLs falls below. Rows with a null in either column take no part. Without
    URLs on both sides nothing is rejected.
    """
    labelled = labelled.select("url", "rejected").where(F.col("url").isNotNull() & F.col("rejected").isNotNull())
    apart = F.crc32(F.col("url").cast("binary")) % 4 == 2
    counted = labelled.where(~apart).mapInArrow(_count_labelled, "gram long, accepted long, rejected long")
    counts = staged(counted.groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), "url-counts")
    both = counts.agg(F.max("accepted").alias("accepted"), F.max("rejected").alias("rejected")).first()
    if not (both["accepted"] and both["rejected"]):
        return UrlModels(counts, -np.inf)
    step = F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("ratio"))) * STEPS)
    held, read = _scored(labelled.where(apart & ~F.col("rejected")), UrlModels(counts, -np.inf), "url", "ratio")
    steps = sorted(held.groupBy(step.alias("step")).count().collect())  # 2 * LIMIT * STEPS + 1 rows at most
    unstaged(*read)
    allowed, below, threshold = false_rejects * sum(n for _, n in steps), 0, -float(LIMIT)
    for at, n in steps:
        threshold = at / STEPS
        if below + n > allowed:
            break
        below += n
    return UrlModels(counts, min(threshold, 0.0))


def judge(pages: DataFrame, rules: list[Rule], models: UrlModels, key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, ratio, verdict) of every row, whatever other columns there are.

    The longest rule that fits decides; else the models do, by host and path. A null or malformed URL has empty host and
    path, no rule, ratio 0 and is allowed. Repeated rows are judged alike, each on its own; an empty table gives none.
    """
    parts = pages.select(F.col(key), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    scored = score_urls(parts.withColumn("scored_url", F.concat("host", "path")), models, "scored_url")
    verdicts = {rule.text: "allow" if rule.allow else "block" for rule in rules}
    by_rule = F.lit(None).cast("string")
    for text, verdict in verdicts.items():
        by_rule = F.when(F.col("rule") == text, F.lit(verdict)).otherwise(by_rule)
    by_models = F.when(F.col("ratio") < models.threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(key, "host", "path", "rule", F.coalesce(by_rule, by_models).alias("verdict"), "ratio")


def seed_labels(urls: DataFrame, reject_words: list[str]) -> DataFrame:
    """(url, rejected) to start from without labels: a host is rejected if one of its words, split at `.` and `-`, is listed."""
    url = F.col("url")
    listed = F.array(*[F.lit(w) for w in reject_words])
    parts = urls.select(F.concat(host_of(url), path_of(url)).alias("url"), F.split(host_of(url), "[.-]").alias("host_words"))
    return parts.where(F.col("url") != "").select("url", F.arrays_overlap("host_words", listed).alias("rejected"))
