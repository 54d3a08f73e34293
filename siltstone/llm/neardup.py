"""Near-duplicate records by MinHash banding.

A record is the multiset of its words: the first, second, ... occurrence of a word are
different elements, so the Jaccard similarity of two sets of elements is the sum of the
smaller counts over the sum of the larger counts. Records with equal multisets form a class
and are handled once. A class has a number of minimum hashes; each band of them, hashed to one
number, is a bucket, and classes that share a bucket are compared by sketches of one bit a
minimum hash, which tell 0.8 from the 0.3 of unrelated records. What remains is verified on
the full multisets.

Numbers. Up to a million records there are 18 bands of 6 rows. With them a pair of similarity
0.75 shares a bucket with probability 0.971, one of 0.8 with 0.9958, one of 0.85 with 0.9998,
one of 0.9 with 1 - 1e-6; a pair of similarity 0.25 with 0.004. bands_for() gives the numbers
for other thresholds and sizes. The sketches drop a pair of similarity 0.75 with a probability
of about 1e-3, one of 0.8 of 4e-5; sketched=False verifies every pair that shares a bucket.
banding() takes more rows, and bands for the same recall, for more records, so the number of
unrelated pairs compared stays in proportion to them.

Skew. Equal records collapse in the partial aggregate of each task, so copies of one text
don't make a hot bucket. Different texts that share a bucket are joined by sort-merge, which
adaptive execution splits; only pairs that pass the sketches are given on.

Defined results: null heading or content is empty; records without any word are in no pair;
a record delivered several times counts as delivered last, and its earlier texts are in no
pair of its key; a null key is no record.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import map_batches
from siltstone.session import written

WORD = re.compile(r"[^\W_]+")
#: The similarity and the probability for which bands are chosen, and what is taken for that of unrelated records.
TARGET, RECALL, UNRELATED = 0.8, 0.995, 0.22
#: Bits of 64 in which the first sketches of a pair may differ, and of 128 of both sketches.
FIRST_BITS, BOTH_BITS = 17, 32
#: Up to so many rows the keys of candidates are broadcast (24 bytes each); beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000
KEPT_WORDS = 500_000


@dataclass(frozen=True)
class Banding:
    """Bands of rows minimum hashes, and the hashes of the two sketches of 64 bits."""

    rows: int
    bands: int

    @property
    def hashes(self) -> int:
        return max(128, self.rows * self.bands + 32)

    def constants(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rng = np.random.default_rng(20240229)
        multiply = (rng.integers(0, 1 << 31, self.hashes, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        add = rng.integers(0, 1 << 32, self.hashes, dtype=np.uint32)
        return multiply, add, rng.integers(0, 1 << 63, (self.bands, self.rows), dtype=np.uint64) | np.uint64(1)

    def sketches(self) -> tuple[np.ndarray, np.ndarray]:
        """The first takes the hashes that are in no band and some of the bands, the second others of the bands."""
        used = self.rows * self.bands
        spread = np.linspace(0, used - 1, 96).astype(int)
        first = np.concatenate([np.arange(used, used + 32), spread[::3]])
        return first, np.setdiff1d(spread, spread[::3])


def banding(n: int) -> Banding:
    """For n records: as many rows as keep the unrelated partners of a record at about a thousand, but 6 at
    least, and bands for RECALL at TARGET. More records make buckets finer, never smaller."""
    rows = max(6, math.ceil(math.log(max(1, 16 * n / 2000)) / -math.log(UNRELATED)))
    return Banding(rows, bands_for(TARGET, RECALL, rows))


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """Bands of so many rows that a pair of the threshold's similarity shares one with the probability recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def similarity(a: str, b: str) -> float:
    """Sum of the smaller counts over the sum of the larger; 0 if neither has a word."""
    x, y = Counter(words(a)), Counter(words(b))
    same = sum((x & y).values())
    return same / max(1, sum(x.values()) + sum(y.values()) - same)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Signer:
    """Class id, sketches and buckets of a batch of texts. A text without words has the class id 0."""

    def __init__(self, b: Banding = Banding(6, 18)) -> None:
        self.b = b
        self.multiply, self.add, self.fold = b.constants()
        self.sketches = b.sketches()
        self.kept: dict[str, int] = {}

    def hashes(self, ws: list[str]) -> list[int]:
        kept = self.kept
        try:
            return [kept[w] for w in ws]
        except KeyError:
            if len(kept) > KEPT_WORDS:
                kept.clear()
            for w in ws:
                if w not in kept:
                    kept[w] = xxhash.xxh64_intdigest(w)
            return [kept[w] for w in ws]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = len(texts)
        per = [self.hashes(words(t)) for t in texts]
        sizes = np.fromiter(map(len, per), np.int64, n)
        flat = np.fromiter((h for x in per for h in x), np.uint64, int(sizes.sum()))
        cid, one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        rows, bands = self.b.rows, self.b.bands
        buckets = np.zeros((n, bands), np.uint64)
        some = np.flatnonzero(sizes)
        if not some.size:
            return cid, one, two, buckets
        # The occurrences of each word in its text, from 0: position in the run of equal hashes, after sorting.
        doc = np.repeat(np.arange(n), sizes)
        order = np.lexsort((flat, doc))
        flat = flat[order]
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])
        element = _elements(flat, new)
        starts = (np.cumsum(sizes) - sizes)[some]
        cid[some] = _class_id(element, starts)
        small = element.astype(np.uint32)
        least = np.empty((self.b.hashes, len(some)), np.uint32)
        for k in range(self.b.hashes):
            least[k] = np.minimum.reduceat(small * self.multiply[k] + self.add[k], starts)
        bit = (least & np.uint32(1)).astype(np.uint64)
        for out, which in zip((one, two), self.sketches):
            for i, k in enumerate(which):
                out[some] |= bit[k] << np.uint64(i)
        for b in range(bands):
            folded = (_mix(least[b * rows : (b + 1) * rows].astype(np.uint64) * self.fold[b][:, None])).sum(axis=0, dtype=np.uint64)
            # 40 bits: narrow keys make a smaller shuffle, and two unrelated hashes of a band rarely fall together.
            buckets[some, b] = (_mix(folded) >> np.uint64(24)) * np.uint64(bands) + np.uint64(b)
        return cid, one, two, buckets

    def class_ids(self, texts: list[str]) -> np.ndarray:
        """The class ids alone."""
        out = np.zeros(len(texts), np.uint64)
        for i, t in enumerate(texts):
            flat = np.sort(np.array(self.hashes(words(t)), np.uint64))
            if len(flat):
                out[i] = _class_id(_elements(flat, np.r_[True, flat[1:] != flat[:-1]]), [0])[0]
        return out


def _elements(flat: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The elements of sorted word hashes; new says where a word, or a text, begins."""
    at = np.arange(len(flat))
    occurrence = at - np.maximum.accumulate(np.where(new, at, 0))
    return _mix(flat + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _class_id(element: np.ndarray, starts: np.ndarray | list[int]) -> np.ndarray:
    return _mix(np.add.reduceat(_mix(element ^ np.uint64(0x5851F42D4C957F2D)), starts)) | np.uint64(1)


def signed(df: DataFrame, key: str, texts: list[str], at: str, shape: Banding) -> DataFrame:
    """(key, at, cid, one, two, buckets) of each row that has a word."""
    src = df.where(F.col(key).isNotNull()).select(key, at, F.concat_ws("\n", *texts).alias("_t"))

    def make():  # noqa: ANN202
        sign = Signer(shape)

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            cid, one, two, buckets = sign(b.column(2).to_pylist())
            keep = np.flatnonzero(cid)
            some = pa.array(keep)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * shape.bands), pa.array(buckets[keep].ravel().view(np.int64)))
            cols = [b.column(0).take(some), b.column(1).take(some), *[pa.array(x[keep].view(np.int64)) for x in (cid, one, two)], lists]
            return pa.RecordBatch.from_arrays(cols, names=[key, at, "cid", "one", "two", "buckets"])

        return batch

    kind = src.schema
    return map_batches(src, make, f"{key} {kind[key].dataType.simpleString()}, {at} {kind[at].dataType.simpleString()}, cid long, one long, two long, buckets array<long>")


def candidates(classes: DataFrame, sketched: bool = True) -> DataFrame:
    """(a, b): class ids, the smaller first, that share a bucket and whose sketches allow the similarity.

    classes (cid, one, buckets) has each class once, so copies of a text are in no bucket twice.
    """
    places = classes.select("cid", "one", F.explode("buckets").alias("bucket"))
    x = places.select("bucket", F.col("cid").alias("a"), F.col("one").alias("x"))
    y = places.select("bucket", F.col("cid").alias("b"), F.col("one").alias("y"))
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= FIRST_BITS
    return x.join(y, "bucket").where((F.col("a") < F.col("b")) & (near if sketched else F.lit(True))).select("a", "b").distinct()


def near_classes(df: DataFrame, key: str, texts: list[str], at: str, threshold: float = 0.75, shape: Banding | None = None, sketched: bool = True) -> tuple[DataFrame, DataFrame]:
    """((key, cid), (a, b, similarity)): the class of each record, and the pairs of classes.

    Signatures and candidates are written tables of the shared folder, read as often as one likes.
    """
    signs = written(signed(df, key, texts, at, shape or banding(df.count())), "signed")
    member = signs.groupBy(key).agg(F.max_by("cid", F.struct(F.col(at), F.col("cid"))).alias("cid"))
    # Rows of a class have equal sketches and buckets: any row of it will do, the one of the least key here.
    classes = signs.groupBy("cid").agg(F.min(F.struct(F.col(key).alias("key"), "one", "two", "buckets")).alias("_c")).select("cid", "_c.*")
    pairs = candidates(classes, sketched)
    both = classes.select("cid", "one", "two", "key")
    for side in ("a", "b"):
        pairs = pairs.join(both.select(F.col("cid").alias(side), F.struct("one", "two", "key").alias(f"s{side}")), side)
    bits = F.bit_count(F.col("sa.one").bitwiseXOR(F.col("sb.one"))) + F.bit_count(F.col("sa.two").bitwiseXOR(F.col("sb.two")))
    if sketched:
        pairs = pairs.where(bits <= BOTH_BITS)
    pairs = written(pairs.select("a", "b", F.col("sa.key").alias("ka"), F.col("sb.key").alias("kb")), "candidates")
    # The text of each class in a pair: only the rows of the keys that stand for a class are read on.
    wanted = pairs.select(F.col("a").alias("cid"), F.col("ka").alias(key)).union(pairs.select("b", "kb")).distinct()
    if pairs.count() * 2 <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    whole = df.select(key, F.concat_ws("\n", *texts).alias("text")).join(wanted, key).select("cid", "text")

    def own():  # noqa: ANN202
        sign = Signer(Banding(1, 1))

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            same = sign.class_ids(b.column(1).to_pylist()).view(np.int64) == b.column(0).to_numpy()
            return b.filter(pa.array(same))

        return batch

    # A key may have been delivered with other texts, which are of other classes. Texts of one class are equal for words.
    whole = map_batches(whole, own, "cid long, text string").groupBy("cid").agg(F.min("text").alias("text"))
    checked = pairs.select("a", "b").join(whole.select(F.col("cid").alias("a"), F.col("text").alias("ta")), "a").join(whole.select(F.col("cid").alias("b"), F.col("text").alias("tb")), "b")

    def make():  # noqa: ANN202
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            s = [similarity(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())], names=["a", "b", "similarity"])

        return batch

    near = map_batches(checked.select("a", "b", "ta", "tb"), make, "a long, b long, similarity double")
    return member, near.where(F.col("similarity") >= threshold)


def near_pairs(df: DataFrame, key: str = "section_key", texts: tuple[str, ...] = ("heading", "content"), at: str = "loaded_at", threshold: float = 0.75, sketched: bool = True) -> DataFrame:
    """(a, b): all pairs of records of at least the threshold's similarity, the smaller key first."""
    member, near = near_classes(df, key, list(texts), at, threshold, sketched=sketched)
    m = member.select(F.col("cid"), F.col(key).alias("k"))
    equal = m.select("cid", F.col("k").alias("a")).join(m.select("cid", F.col("k").alias("b")), "cid").where("a < b").select("a", "b")
    cross = near.select("a", "b").join(m.select(F.col("cid").alias("a"), F.col("k").alias("ka")), "a").join(m.select(F.col("cid").alias("b"), F.col("k").alias("kb")), "b")
    return equal.unionByName(cross.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")))


def near_members(df: DataFrame, key: str = "section_key", texts: tuple[str, ...] = ("heading", "content"), at: str = "loaded_at", threshold: float = 0.75) -> DataFrame:
    """(key, class, copies, links): one row for each record that has a near-duplicate, copies aren't expanded into pairs.

    class is the least key with its words, copies the number of such keys, links the number of pairs that the record is in.
    """
    member, near = near_classes(df, key, list(texts), at, threshold)
    sizes = member.groupBy("cid").agg(F.min(key).alias("class"), F.count("*").alias("copies"))
    ways = near.select("a", "b").union(near.select("b", "a"))
    other = ways.join(sizes.select(F.col("cid").alias("b"), F.col("copies").alias("n")), "b").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    links = sizes.join(other, "cid", "left").withColumn("links", F.col("copies") - 1 + F.coalesce("n", F.lit(0))).where("links > 0").drop("n")
    return member.join(links, "cid").select(key, "class", "copies", "links")
