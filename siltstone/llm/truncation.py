"""Texts that were cut off, found by a self-join by prefix and by their terminal context.

A cut value is a strict prefix of the whole one. Whole copies of a cut text are rare, so the
join takes lines: the closing line of a text, or its lone heading, with numbers masked. All
distinct lines are range-partitioned and sorted; a line is a strict prefix of another one if
and only if it is one of the line that follows. Only the first line of each partition crosses
its border. That decides the texts whose end has the form of a closing line; the terminal
context decides the others (see terminal.py), because most cut texts have no longer copy.

The same join over whole contents, of all deliveries and all keys, and the token limit of the
model's configuration say which cut texts they know as well (ways in defects.py, rates here).
They decide no row: a text with a finished end is complete whatever is longer or full.

Defined results: null and empty texts, refusals and copies of the prompt are no cases; of
several deliveries of one key the last one counts; a null key is no record.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import ship


def strict_prefixes(values: DataFrame) -> DataFrame:
    """(value): the values of a one-column string table that are strict prefixes of another value of it.

    Null is no value; the empty string is a prefix of any other.
    """
    ship(values.sparkSession)
    name = values.columns[0]
    v = values.select(F.col(name).alias("v")).where("v is not null").groupBy("v").agg(F.lit(1).alias("_")).select("v")
    order = v.repartitionByRange(F.col("v")).sortWithinPartitions("v").withColumn("p", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part, first = None, -1, None
        for b in batches:
            out = []
            for x, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if before is None:
                    first, part = x, p
                elif x.startswith(before):
                    out.append(before)
                before = x
            yield _rows(out, "in")
        if before is not None:
            yield _rows([first], "first", part)
            yield _rows([before], "last", part)

    found = order.mapInArrow(run, "v string, kind string, p int")
    # Two rows a partition, "first" before "last": one array of them holds every border.
    ends = found.where("kind <> 'in'").agg(F.array_sort(F.collect_list(F.struct("p", "kind", "v"))).alias("e"))
    border = ends.select(F.explode(F.expr("zip_with(e, slice(e, 2, greatest(size(e) - 1, 0)), (x, y) -> struct(x, y))")).alias("z")).select("z.x", "z.y")
    border = border.where("x.kind = 'last' and y.kind = 'first' and startswith(y.v, x.v)").select("x.v")
    return found.where("kind = 'in'").select("v").union(border.select("v")).toDF("value")


def _rows(values: list, kind: str, part: int = -1) -> pa.RecordBatch:
    n = len(values)
    return pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array([kind] * n, pa.string()), pa.array([part] * n, pa.int32())], names=["v", "kind", "p"])


def cut_units(judged: DataFrame) -> DataFrame:
    """(unit): of the unfinished units of judged (see defects.judged) those that a longer unit
    continues, or whose form, the first word, belongs to lines that mostly end with a sentence mark."""
    units = judged.select("unit", F.col("done").cast("int").alias("done")).where("unit <> ''").groupBy("unit").agg(F.max("done").alias("done"), F.count("*").alias("n"))
    form = F.xxhash64(F.substring_index("unit", " ", 1)).alias("form")
    forms = units.select(form, "done", "n").groupBy("form").agg(F.sum(F.col("done") * F.col("n")).alias("done"), F.sum("n").alias("n")).where("2 * done >= n").select("form")
    open_ = units.where("done = 0").select("unit", form)
    return strict_prefixes(units.select("unit")).withColumnRenamed("value", "unit").union(open_.join(forms, "form", "left_semi").select("unit")).distinct()


#: Lengths of the prefixes whose hashes are compared before whole texts are sorted.
LENGTHS = (1, 4, 16, 64, 256)


def continued(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(id): the asked ids whose text is a strict prefix of another text; texts (id, text), asked (id).

    Each text has the hashes of its prefixes of LENGTHS. Only texts that share the hash of the longest such
    prefix of an asked text are sorted whole, so most texts are never shuffled. The empty text is no case.
    """
    ids = texts.where("text is not null").select("id", F.length("text").alias("n"), *[F.when(F.length("text") >= k, F.xxhash64(F.lit(k), F.substring("text", 1, k))).alias(f"h{k}") for k in LENGTHS])
    ids = ids.dropDuplicates(["id"])
    longest = F.coalesce(*[f"h{k}" for k in reversed(LENGTHS)]).alias("h")
    keys = ids.join(asked.distinct(), "id", "left_semi").select(longest).where("h is not null").distinct()
    needed = ids.select("id", F.explode(F.array_compact(F.array(*[f"h{k}" for k in LENGTHS]))).alias("h")).join(keys, "h", "left_semi").select("id").distinct()
    found = strict_prefixes(texts.join(needed, "id", "left_semi").select("text"))
    return found.select(F.xxhash64("value").alias("id")).join(asked.distinct(), "id", "left_semi")


def rates(found: DataFrame, responses: DataFrame, key: str, group: str) -> DataFrame:
    """(group, records, cut, by_prefix, by_line, at_limit, by_context, rate): how often each source truncates, and what says so.

    found (key, way); a null group is a group.
    """
    own = responses.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(group, F.struct("loaded_at", group)).alias(group))
    hit = own.join(found.select(key, "way"), key, "left")
    ways = [F.count_if(F.col("way") == w).alias(n) for w, n in (("prefix", "by_prefix"), ("line", "by_line"), ("limit", "at_limit"), ("context", "by_context"))]
    return hit.groupBy(group).agg(F.count("*").alias("records"), F.count("way").alias("cut"), *ways).withColumn("rate", F.col("cut") / F.col("records"))
