"""Merging the versions of a section over documents: the latest if all are alike, else all that differ.

Pairs are only formed within a group of versions and only between different texts; equal
texts are handled as one by their hash. The ratio of a pair is computed only if lossless bounds
by lengths and shared q-grams allow the threshold. The earlier text is the first argument of the ratio.
"""

from __future__ import annotations

import difflib
import functools
import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from siltstone.operators.sections import group_key
from siltstone.session import ship, written

THRESHOLD = 0.85
RULE = "\n\n---\n\n"
#: Length of the grams and places of their counts; what rounding may take from a bound.
GRAM, WIDTH, SLACK = 4, 4096, 1e-4
#: Texts and characters of a block, about.
BLOCK, BLOCK_CHARS, TILE = 2500, 8_000_000, 64


def ratio(a: str, b: str, threshold: float = 0.0) -> float:
    """Similarity of two texts; a bound of it where that is already not over the threshold."""
    if a == b:
        return 1.0
    m = difflib.SequenceMatcher(None, a, b)
    quick = m.real_quick_ratio()
    if quick <= threshold:
        return quick
    quick = m.quick_ratio()
    return quick if quick <= threshold else m.ratio()


def grams(text: str) -> np.ndarray:
    """Counts of the 4-grams of a text, the repeats of one told apart, in WIDTH places.

    The product of two texts' counts is at least the number of 4-grams that they share.
    """
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(c) - GRAM + 1
    if n <= 0:
        return np.zeros(WIDTH, np.float32)
    k = np.zeros(n, np.uint64)
    for i in range(GRAM):
        k = k * np.uint64(1000003) + c[i : i + n]
    k.sort()
    at = np.arange(n)
    first = np.maximum.accumulate(np.where(np.r_[True, k[1:] != k[:-1]], at, 0))
    k = (k + (at - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xFF51AFD7ED558CCD)
    return np.bincount((k >> np.uint64(40)).astype(np.int64) % WIDTH, minlength=WIDTH).astype(np.float32)


def anchors(text: str) -> int:
    """How many characters of a second text SequenceMatcher looks up: from 200 characters on it leaves out frequent ones."""
    if len(text) < 200:
        return len(text)
    n = Counter(text).values()
    return sum(x for x in n if x <= len(text) // 100 + 1)


def similar(texts: Sequence[str], pairs: Sequence[tuple[np.ndarray, np.ndarray]], before: Callable[[int, int], bool], threshold: float) -> Iterator[tuple[int, int, float]]:
    """(i, j, ratio) over the threshold, i of the first and j of the second numbers of each of the pairs.

    Lossless bounds come first. A ratio over the threshold needs more than m = threshold * (la + lb) / 2
    characters in matching blocks. Each block but a common beginning has an anchor of the second
    text, and there are at most la + lb - 2 m gaps, so there are at most k = 1 + min(anchors, la + lb - 2 m)
    blocks, and the texts share at least m - (q - 1) k of their q-grams.
    """
    size = np.array([len(x) for x in texts], np.float64)
    found = np.array([anchors(x) for x in texts], np.float64)
    counts = np.stack([grams(x) for x in texts])
    thirds = functools.lru_cache(maxsize=256)(lambda i: Counter(texts[i][k : k + 3] for k in range(len(texts[i]) - 2)))
    span = (2 - threshold) / threshold + SLACK
    for left, right in pairs:
        # In the order of lengths a tile only meets the texts whose lengths the threshold allows.
        left, right = left[np.argsort(size[left], kind="stable")], right[np.argsort(size[right], kind="stable")]
        sizes = size[left]
        match, last = difflib.SequenceMatcher(None), -1
        for at in range(0, len(right), TILE):
            part = right[at : at + TILE]
            own = left[np.searchsorted(sizes, size[part[0]] / span - SLACK) : np.searchsorted(sizes, size[part[-1]] * span + SLACK, "right")]
            total = size[own][:, None] + size[part][None]
            m = threshold * total / 2
            k = np.minimum(found[part][None], total - 2 * m) + 1
            shared = counts[own] @ counts[part].T
            maybe = (np.minimum(size[own][:, None], size[part][None]) > m - SLACK) & (shared * (1 + SLACK) + SLACK >= m - (GRAM - 1) * k)
            for y, x in zip(*np.nonzero(maybe.T)):
                i, j = int(own[x]), int(part[y])
                if i == j or not before(i, j) or np.minimum(counts[i], counts[j]).sum() * (1 + SLACK) + SLACK < m[x, y] - (GRAM - 1) * k[x, y]:
                    continue
                if (thirds(i) & thirds(j)).total() + SLACK < m[x, y] - 2 * k[x, y]:
                    continue
                if j != last:
                    match.set_seq2(texts[j])
                    last = j
                match.set_seq1(texts[i])
                if match.quick_ratio() > threshold and (r := match.ratio()) > threshold:
                    yield i, j, r


def similar_pairs(versions: DataFrame, by: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """(by, h1, h2, first1, last2, similarity): different texts of a group whose similarity, earlier first, is over the threshold.

    first1 is the first place of the earlier text, last2 the last one of the later. Both orders are
    judged where a text is earlier in one place and later in another. Groups are split into blocks
    of bounded size, and each pair of blocks is judged by itself.
    """
    ship(versions.sparkSession)
    some = versions.where(F.col("content").isNotNull())
    # Without their contents: which texts have another one of a length that the threshold allows.
    texts = some.groupBy(*by, "h").agg(F.min("o").alias("first"), F.max("o").alias("last"), F.max(F.length("content")).alias("n"))
    # Lengths lie in bands as wide as the threshold allows, so a partner is in the same band or the next one.
    texts = texts.withColumn("band", F.floor(F.log(F.col("n") + 1) / math.log((2 - threshold) / threshold + SLACK)))
    around = texts.groupBy(*by, "band").agg(F.count("*").alias("k")).select(*by, F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "k")
    around = around.groupBy(*by, "band").agg(F.sum("k").alias("k")).where("k > 1").select(*by, "band")
    texts = texts.join(around, [*by, "band"], "left_semi")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_CHARS)).cast("int")
    groups = texts.groupBy(*by).agg(blocks.alias("blocks"))
    own = texts.join(groups, list(by)).withColumn("own", F.pmod("h", F.col("blocks").cast("long")).cast("int"))
    # The contents travel twice: to their hash, where copies become one, and to their cells.
    whole = some.select(*by, "h", F.col("content").alias("c")).join(own, [*by, "h"]).groupBy(*by, "h").agg(F.first("c").alias("c"), *[F.first(x).alias(x) for x in ("first", "last", "own", "blocks")])
    cells = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))
    cells = cells.select(*by, "p", "q", "own", "h", "first", "last", "c")
    names = [*by, "h1", "h2", "first1", "last2", "similarity"]
    order = cells.schema["first"].dataType.simpleString()
    place_type = to_arrow_type(_parse_datatype_string(order))
    schema = ", ".join([*(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in by), "h1 long", "h2 long", f"first1 {order}", f"last2 {order}", "similarity double"])

    def judged(t: pa.Table) -> pa.Table:
        p, q = t["p"][0].as_py(), t["q"][0].as_py()
        place = t["own"].to_numpy()
        first, last = ([tuple((v is not None, v) for v in x.values()) for x in t[c].to_pylist()] for c in ("first", "last"))
        a, b = np.nonzero(place == p)[0], np.nonzero(place == q)[0]
        found = list(similar(t["c"].to_pylist(), [(a, a)] if p == q else [(a, b), (b, a)], lambda i, j: first[i] < last[j], threshold))
        i, j = (pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))
        places = (pa.array(t[c].take(k).to_pylist(), place_type) for c, k in (("first", i), ("last", j)))
        return pa.table([*(t[c].take(i) for c in by), t["h"].take(i), t["h"].take(j), *places, pa.array([x[2] for x in found], pa.float64())], names=names)

    return cells.groupBy(*by, "p", "q").applyInArrow(judged, schema)


def versions(sections: DataFrame, by: Sequence[str]) -> DataFrame:
    order = F.struct("doc_ord", "sec_ord")
    return sections.withColumn("group_key", group_key()).select(*by, "group_key", order.alias("o"), "doc_id", "heading", "section_id", "content", F.xxhash64("content", F.length("content")).alias("h"))


def kept_versions(v: DataFrame, g: Sequence[str], threshold: float | None = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """((g, strategy, n_versions, first_ord, last), (g, o, h)): the groups of versions(), and the places of the versions that stay.

    A version stays if no later one is similar; the last one always stays. threshold None takes
    only equal texts as similar. No contents are in either.
    """
    order = F.struct("o", "h")
    places = v.select(*g, "o", "h", "heading", "section_id")
    heads = places.groupBy(*g).agg(F.count("*").alias("n_versions"), F.min("o").alias("first_ord"), F.max_by(F.struct("heading", "section_id", "o", "h"), order).alias("last"))
    # What is similar to the text h1: itself, and the second texts of its pairs.
    same = places.select(*g, F.col("h").alias("h1"), F.col("h").alias("h2")).distinct()
    alike = same if threshold is None else same.unionByName(written(similar_pairs(v, g, threshold).select(*g, "h1", "h2"), "similar"))
    latest = places.groupBy(*g, F.col("h").alias("h2")).agg(F.max("o").alias("last_o"))
    later = alike.join(latest, [*g, "h2"]).groupBy(*g, F.col("h1").alias("h")).agg(F.max("last_o").alias("later"))
    stays = places.join(later, [*g, "h"]).where(F.col("later") <= F.col("o")).select(*g, "o", "h")
    to_last = alike.join(heads.select(*g, F.col("last.h").alias("h2")), [*g, "h2"]).select(*g, F.col("h1").alias("h"), F.lit(True).alias("near"))
    judged = places.join(to_last, [*g, "h"], "left").groupBy(*g).agg(F.bool_and(F.coalesce("near", F.lit(False))).alias("all_near"))
    heads = heads.join(judged, list(g)).withColumn("strategy", F.when(F.col("all_near"), "latest").otherwise("accumulated"))
    return heads.select(*g, "strategy", "n_versions", "first_ord", "last"), stays


def merged(sections: DataFrame, by: Sequence[str] = ("project",), threshold: float | None = THRESHOLD) -> DataFrame:
    """(by, group_key, heading, section_id, strategy, n_versions, content, first_ord): one section for each group.

    Of one text at one place, delivered repeatedly, the content has one.
    """
    return _merged(written(versions(sections, by), "versions"), [*by, "group_key"], threshold)


def _merged(v: DataFrame, g: Sequence[str], threshold: float | None) -> DataFrame:
    """merged() of versions() that are a table."""
    heads, stays = kept_versions(v, g, threshold)
    # The contents meet the places that stay in the one shuffle that brings a group together.
    places = stays.join(heads.select(*g, "strategy", F.struct("last.o", "last.h").alias("_last")), g).where((F.col("strategy") != "latest") | (F.struct("o", "h") == F.col("_last"))).select(*g, "o", "h", "strategy")
    nothing = F.lit(None).cast("string")
    both = v.select(*g, "o", "h", nothing.alias("strategy"), "doc_id", "content").unionByName(places.select(*g, "o", "h", "strategy", nothing.alias("doc_id"), nothing.alias("content")))
    each = both.repartition(*g).groupBy(*g, "o", "h").agg(F.max("strategy").alias("strategy"), F.max(F.struct("doc_id", "content")).alias("_v")).where("strategy is not null")
    part = F.when(F.col("strategy") == "latest", F.col("_v.content")).otherwise(F.concat(F.lit("*["), F.col("_v.doc_id"), F.lit("]*\n\n"), F.col("_v.content")))
    text = each.groupBy(*g).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "h", part.alias("p")))), lambda x: x["p"]), RULE).alias("content"))
    return heads.join(text, g).select(*g, "last.heading", "last.section_id", "strategy", "n_versions", "content", "first_ord")


def merged_document(sections: DataFrame, by: Sequence[str] = ("project",), threshold: float | None = THRESHOLD) -> DataFrame:
    """(by, document): the merged sections of each project as one text, groups by their first appearance."""
    v = written(versions(sections, by), "versions")
    docs = v.groupBy(*by).agg(F.count_distinct("doc_id").alias("n_docs"))
    blocks = _merged(v, [*by, "group_key"], threshold).select(*by, F.struct("first_ord", F.concat(F.lit("## "), F.col("heading"), F.lit("\n\n"), F.col("content"), F.lit("\n")).alias("b")).alias("x"))
    text = blocks.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda y: y["b"]), "\n").alias("body"))
    head = F.concat(F.lit("# Project Documentation (Merged from "), F.col("n_docs").cast("string"), F.lit(" snapshots)\n\n"))
    return docs.join(text, list(by)).select(*by, F.concat(head, F.col("body")).alias("document"))
