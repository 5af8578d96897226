"""Joins by contained names and by the longest name that ends a label."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.shipping import ship

#: Names of so many bytes at most are broadcast as one automaton.
BROADCAST_BYTES = 32 << 20


def _automaton(names: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for name in names:
        found.add_word(name, name)
    found.make_automaton()
    return found


def contained(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(key, name, places): each name that stands in a text, also within or across another name, and how often; one row per row of ``texts`` and name.

    All names are looked for at once by an automaton. Its size is counted
    first: up to ``limit`` bytes of names are broadcast, more are dealt into
    blocks of that size, each of which reads the texts in bounded groups.
    Null and empty names stand nowhere, null texts hold nothing.
    """
    spark = texts.sparkSession
    ship(spark)
    wanted = names.select(F.col(name).cast("string").alias("name")).filter("name <> ''").distinct()
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("name") + 16), F.lit(0))).first()[0]
    rows = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, name string, places long"

    def found_in(automaton, keys: pa.Array, bodies: list) -> pa.RecordBatch:
        at, hit, places = [], [], []
        for k, body in enumerate(bodies):
            count: dict[str, int] = {}
            for _, x in automaton.iter(body or ""):
                count[x] = count.get(x, 0) + 1
            at += [k] * len(count)
            hit += count
            places += count.values()
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array(hit, pa.string()), pa.array(places, pa.int64())], names=["key", "name", "places"])

    if size <= limit:
        held = spark.sparkContext.broadcast([r[0] for r in wanted.collect()])

        def scan(batches):
            automaton = _automaton(held.value) if held.value else None
            for b in batches:
                if automaton:
                    yield found_in(automaton, b.column("key"), b.column("text").to_pylist())

        out = rows.mapInArrow(scan, schema)
    else:
        blocks = -(-size // limit)
        bodies = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        groups = max(1, -(-bodies // limit))
        ids = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        by_block = wanted.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int")).withColumn("part", ids(groups))
        # Texts are dealt by hash of key and text: equal rows aside, no group outgrows its share.
        by_part = rows.withColumn("part", F.pmod(F.xxhash64("key", "text"), F.lit(groups)).cast("int")).withColumn("block", ids(blocks))

        def together(texts_of: pa.Table, names_of: pa.Table) -> pa.Table:
            if not names_of.num_rows or not texts_of.num_rows:
                return pa.Table.from_batches([], pa.schema([("key", texts_of.schema.field("key").type), ("name", pa.string()), ("places", pa.int64())]))
            t = texts_of.combine_chunks()
            return pa.Table.from_batches([found_in(_automaton(names_of["name"].to_pylist()), t["key"].combine_chunks(), t["text"].to_pylist())])

        out = by_part.groupBy("block", "part").cogroup(by_block.groupBy("block", "part")).applyInArrow(together, schema)
    return out.withColumnsRenamed({"key": key, "name": name} if key != name else {"key": key})


def longest_suffix(labels: DataFrame, group: str, label: str, names: DataFrame, name: str) -> DataFrame:
    """``labels`` with ``name``: the longest name of the label's group that ends the label, or null.

    A label is cut to the lengths that its group's names have, and each cut is
    looked up by an equi join, so a group with many names of few lengths costs
    a label only those few rows. Null groups and labels get null; an empty
    name ends nothing.
    """
    own = names.select(F.col(group).alias("__g"), F.col(name).alias("__n")).filter("__g is not null and __n <> ''").distinct()
    sizes = own.groupBy("__g").agg(F.collect_set(F.length("__n")).alias("__sizes"))
    # Equal labels are looked up once.
    asked = labels.select(F.col(group).alias("__g"), F.col(label).alias("__l")).filter("__g is not null and __l is not null").distinct()
    cuts = asked.join(sizes, "__g").select("__g", "__l", F.explode(F.filter("__sizes", lambda n: n <= F.length("__l"))).alias("__s")).withColumn("__n", F.expr("right(__l, __s)"))
    best = cuts.join(own, ["__g", "__n"]).groupBy("__g", "__l").agg(F.max_by("__n", "__s").alias(name))
    out = labels.join(best, (labels[group] == best["__g"]) & (labels[label] == best["__l"]), "left")
    return out.select(*[labels[c] for c in labels.columns if c != name], best[name])
