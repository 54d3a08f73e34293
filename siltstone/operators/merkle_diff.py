"""What changed between consecutive full snapshots, by Merkle digests over hash ranges.

Every file path falls into one of 2**leaf_bits hash ranges. The digest of a range is the xor
of its rows' hashes and their number, so it adds up in partial aggregates and from level to
level. Two consecutive snapshots of a checkout are compared from the root down; the rows of a
range are only compared if the range's digests differ between some snapshots.

Rows are shuffled once, by checkout and range; one row for each file, with its hash as bytes.
Duplicates, the digests of ranges, their comparison with the snapshot before and at last the
comparison of rows all happen in that partitioning. Only digests go further up the tree. A
checkout that holds a third of all rows lies in as many tasks as it has ranges.

Defined results
* of several rows of one path in one snapshot the one with the latest loaded_at holds; ties
  are broken by the larger hash, size, lines (null lowest), repeated rows count once;
* a row with null path or null snapshot_id, or of a snapshot without header, is no file; a
  header with null snapshot_id or null checkout is none;
* a null loaded_at is older than any other; null size or lines equal only null;
* the first snapshot of a checkout gives no rows, an empty table gives an empty result;
* further columns of either table are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many headers (about 100 bytes each) are broadcast; beyond, rows are joined with them by a shuffle.
BROADCAST_HEADERS = 500_000
ROWS_PER_LEAF, ROWS_PER_TASK = 4, 500_000


def clean_path(path: Column) -> Column:
    """Forward slashes, without leading ./ parts."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./+)+", "")


def leaf_bits_for(rows: int, snapshots: int) -> int:
    """Depth of the tree: few rows of a snapshot in a range, and few of a checkout that holds a third of all rows."""
    of_snapshot = math.log2(max(1.0, rows / max(1, snapshots) / ROWS_PER_LEAF))
    of_checkout = math.log2(max(1.0, rows / 3 / ROWS_PER_TASK))
    return min(20, math.ceil(max(of_snapshot, of_checkout)))


def ordered(headers: DataFrame, checkout: str = "checkout_id", snapshot: str = "snapshot_id", taken: str = "taken_at") -> DataFrame:
    """(snapshot_id, checkout, seq): the snapshots of each checkout numbered from 1 in the order of their time."""
    h = headers.select(F.col(checkout).alias("checkout"), F.col(taken).alias("_t"), F.col(snapshot).alias("snapshot_id")).where("snapshot_id is not null and checkout is not null")
    h = h.groupBy("snapshot_id").agg(F.max(F.struct("_t", "checkout")).alias("_h")).select("snapshot_id", "_h.*")
    w = Window.partitionBy("checkout").orderBy(F.col("_t").asc_nulls_first(), "snapshot_id")
    return h.select("snapshot_id", "checkout", F.row_number().over(w).alias("seq"))


def consecutive(headers: DataFrame) -> DataFrame:
    """(snapshot_id, as_new, as_old): the comparisons that a snapshot takes part in, named by their newer snapshot."""
    w = Window.partitionBy("checkout").orderBy("seq")
    return ordered(headers).select("snapshot_id", F.when(F.col("seq") > 1, F.col("snapshot_id")).alias("as_new"), F.lead("snapshot_id").over(w).alias("as_old"))


def _hash_bytes(h: Column) -> Column:
    """A hash whatever its case, in half the bytes if it is a usual one; null and "" are null."""
    low = F.lower(h)
    usual = low.rlike("^[0-9a-f]{64}$")
    return F.when(usual, F.concat(F.lit(b"\0"), F.unhex(low))).when(F.length(low) > 0, F.concat(F.lit(b"\1"), low.cast("binary")))


def _ranked(rows: DataFrame, leaf_bits: int) -> DataFrame:
    r = rows.where("snapshot_id is not null and path is not null")
    leaf = F.shiftrightunsigned(F.xxhash64("path"), 64 - leaf_bits).cast("int") if leaf_bits else F.lit(0)
    return r.select(
        "snapshot_id", clean_path(F.col("path")).alias("path"), F.col("hash"), F.col("size").cast("long").alias("size"), F.col("lines").cast("long").alias("lines"), F.col("loaded_at").alias("_at")
    ).withColumn("leaf", leaf)


def live_rows(rows: DataFrame, leaf_bits: int) -> DataFrame:
    """(snapshot_id, leaf, path, hash, size, lines): one row for each path of each snapshot, hashes in lower case."""
    r = _ranked(rows, leaf_bits).withColumn("hash", F.lower(F.coalesce("hash", F.lit("")))).repartition("snapshot_id", "leaf")
    last = F.max(F.struct("_at", "hash", "size", "lines"))
    return r.groupBy("snapshot_id", "leaf", "path").agg(last.alias("f")).select("snapshot_id", "leaf", "path", "f.hash", "f.size", "f.lines")


def _placed(rows: DataFrame, order: DataFrame, leaf_bits: int, small: bool) -> DataFrame:
    """(checkout, leaf, seq, path, hash, size, lines) of live rows, partitioned by checkout and leaf."""
    r = _ranked(rows, leaf_bits).join(F.broadcast(order) if small else order, "snapshot_id")
    r = r.select("checkout", "leaf", "seq", "path", _hash_bytes(F.col("hash")).alias("hash"), "size", "lines", "_at").repartition("checkout", "leaf")
    # A larger hash holds among ties: bytes of usual hashes sort as their digits do.
    last = F.max(F.struct("_at", "hash", "size", "lines"))
    return r.groupBy("checkout", "leaf", "seq", "path").agg(last.alias("f")).select("checkout", "leaf", "seq", "path", "f.hash", "f.size", "f.lines")


def _differing(digests: DataFrame, node: str) -> DataFrame:
    """(checkout, node, pair): snapshots whose digest of a node isn't that of the snapshot before.

    digests (checkout, node, seq, d, last) has no row where a node is empty; last is the number of
    the checkout's last snapshot.
    """
    w = Window.partitionBy("checkout", node).orderBy("seq")
    before, after = F.lag(F.struct("seq", "d")).over(w), F.lead("seq").over(w)
    seq = F.col("seq")
    own = F.when((seq > 1) & ~F.coalesce((before["seq"] == seq - 1) & (before["d"] == F.col("d")), F.lit(False)), seq)
    gone = F.when((seq < F.col("last")) & ~F.coalesce(after == seq + 1, F.lit(False)), seq + 1)
    found = digests.select("checkout", node, F.array_compact(F.array(own, gone)).alias("_p"))
    return found.select("checkout", node, F.explode("_p").alias("pair"))


def changed_leaves(live: DataFrame, order: DataFrame, leaf_bits: int, small: bool, fanout_bits: int = 4) -> DataFrame:
    """(checkout, leaf, pair) of the ranges that differ, found from the root down."""
    lasts = order.groupBy("checkout").agg(F.max("seq").alias("last"))
    lasts = F.broadcast(lasts) if small else lasts
    h = [F.xxhash64("path", "hash", "size", "lines"), F.xxhash64(F.lit(7), "lines", "size", "hash", "path")]
    leaves = live.groupBy("checkout", "leaf", "seq").agg(F.bit_xor(h[0]).alias("x"), F.bit_xor(h[1]).alias("y"), F.count("*").alias("n"))
    shifts = sorted({*range(fanout_bits, leaf_bits, fanout_bits), leaf_bits} - {0}, reverse=True)  # root first, leaves apart
    found: DataFrame | None = None
    above = 0
    for s in [*shifts, 0]:
        level = leaves.withColumn("node", F.shiftright("leaf", s))
        if s:
            level = level.groupBy("checkout", "node", "seq").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("n").alias("n"))
        else:
            level = level.drop("node").withColumnRenamed("leaf", "node")
        here = _differing(level.join(lasts, "checkout").withColumn("d", F.struct("x", "y", "n")), "node")
        if found is not None:
            parent = here.withColumn("_p", F.shiftright("node", above - s))
            up = found.withColumnRenamed("node", "_p")
            here = parent.join(up, ["checkout", "_p", "pair"], "left_semi").drop("_p")
        found, above = here, s
    assert found is not None
    return found.withColumnRenamed("node", "leaf")


def snapshot_changes(rows: DataFrame, headers: DataFrame, leaf_bits: int | None = None, broadcast_headers: int = BROADCAST_HEADERS) -> DataFrame:
    """(snapshot_id, path, change): the files added, removed or changed since the snapshot before."""
    n = headers.count()
    if leaf_bits is None:
        leaf_bits = leaf_bits_for(rows.count(), n)
    small = n <= broadcast_headers
    order = ordered(headers)
    live = _placed(rows, order, leaf_bits, small)
    # Where a range differs in some snapshots, its rows are the same in the others and give nothing, so the numbers of the
    # differing pairs needn't meet the rows. Whether there is a snapshot before and after is known from the checkout.
    leaves = changed_leaves(live, order, leaf_bits, small).select("checkout", "leaf").distinct()
    lasts = order.groupBy("checkout").agg(F.max("seq").alias("last"))
    seq = F.col("seq")
    held = live.join(leaves, ["checkout", "leaf"], "left_semi").join(F.broadcast(lasts) if small else lasts, "checkout")
    w = Window.partitionBy("checkout", "leaf", "path").orderBy("seq")
    old = F.lag(F.struct("seq", "hash", "size", "lines")).over(w)
    sides = held.select("checkout", "path", "seq", (seq > 1).alias("as_new"), (seq < F.col("last")).alias("as_old"), "hash", "size", "lines", old.alias("o"), F.lead("seq").over(w).alias("after"))
    o = F.col("o")
    known = F.col("hash").isNotNull() & o["hash"].isNotNull()
    differs = F.when(known, F.col("hash") != o["hash"]).otherwise(~o["size"].eqNullSafe(F.col("size")) | ~o["lines"].eqNullSafe(F.col("lines")))
    has_old = F.coalesce(o["seq"] == seq - 1, F.lit(False))
    new = F.when(F.col("as_new") & ~has_old, "added").when(F.col("as_new") & differs, "changed")
    gone = F.when(F.col("as_old") & ~F.coalesce(F.col("after") == seq + 1, F.lit(False)), "removed")
    out = F.array(F.struct(seq.alias("seq"), new.alias("change")), F.struct((seq + 1).alias("seq"), gone.alias("change")))
    found = sides.select("checkout", "path", F.explode(out).alias("c")).select("checkout", "path", "c.seq", "c.change").where("change is not null")
    named = order.withColumnRenamed("checkout", "_c").withColumnRenamed("seq", "_s")
    return found.join(F.broadcast(named) if small else named, (F.col("checkout") == F.col("_c")) & (seq == F.col("_s"))).select("snapshot_id", "path", "change")


P4_SQL = r"""
WITH f AS (
  SELECT snapshot_id, regexp_replace(replace(path, chr(92), '/'), '^(\./+)+', '') AS path, lower(coalesce(hash, '')) AS hash, size, lines, loaded_at
  FROM snapshot WHERE path IS NOT NULL
), live AS (
  SELECT snapshot_id, path, hash, size, lines FROM f
  QUALIFY row_number() OVER (PARTITION BY snapshot_id, path ORDER BY loaded_at DESC NULLS LAST, hash DESC, size DESC NULLS LAST, lines DESC NULLS LAST) = 1
), p AS (
  SELECT snapshot_id AS new_id, lag(snapshot_id) OVER (PARTITION BY checkout_id ORDER BY taken_at NULLS FIRST, snapshot_id) AS old_id FROM snapshots
), n AS (SELECT p.new_id, live.* FROM p JOIN live ON live.snapshot_id = p.new_id WHERE old_id IS NOT NULL),
o AS (SELECT p.new_id, live.* FROM p JOIN live ON live.snapshot_id = p.old_id)
SELECT snapshot_id, path, change FROM (
  SELECT coalesce(n.new_id, o.new_id) AS snapshot_id, coalesce(n.path, o.path) AS path,
    CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
         WHEN n.hash <> '' AND o.hash <> '' THEN CASE WHEN n.hash <> o.hash THEN 'changed' END
         WHEN n.size IS DISTINCT FROM o.size OR n.lines IS DISTINCT FROM o.lines THEN 'changed' END AS change
  FROM n FULL OUTER JOIN o ON n.new_id = o.new_id AND n.path = o.path)
WHERE change IS NOT NULL
"""
