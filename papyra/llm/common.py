"""Helpers that the operators of this folder share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.scratch import release, settle

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="papyra-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = os.path.join(folder, "papyra_src.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"papyra/{p.relative_to(top)}")
    spark.sparkContext.addPyFile(name)


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names: other columns, whatever their names, can't clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: Slots of a broadcast bitmap: 16 MB, whatever the input's size.
BITMAP_SLOTS = 1 << 27


def bitmap_of(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap of fixed size (BITMAP_SLOTS bits) in which each key's slot is set.

    Spark ORs the bits into 64-bit words, so the driver gets at most
    BITMAP_SLOTS / 64 words. Two keys may share a slot: use it only where a
    false hit costs time and never changes a result.
    """
    slot = F.expr(f"`{column}` & {BITMAP_SLOTS - 1}L")
    words = (
        keys.select(slot.alias("s"))
        .groupBy(F.shiftright("s", 6).cast("int").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63L as int))")).alias("b"))
        .toArrow()
    )
    out = np.zeros(BITMAP_SLOTS // 64, np.uint64)
    if words.num_rows:
        out[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return out


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit keys have their slot set."""
    slot = keys & np.uint64(BITMAP_SLOTS - 1)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def components(edges: DataFrame, src: str = "a", dst: str = "b", name: str = "cc") -> DataFrame:
    """Connected components: one row (node, root) per node of ``edges``, root being the component's smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014) as
    DataFrame joins and aggregates, each written to the shared folder; the
    number of steps grows with the logarithm of a component's size. Nothing
    but two figures a step reaches the driver. Nodes may be of any ordered
    type. An empty input gives an empty result.
    """
    cur = settle(
        edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
        .filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        f"{name}-edges",
    )
    while True:
        # Large star: every larger neighbour of a node goes to the smallest of its neighbourhood.
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # An edge gives one row here at most, so equal rows needn't go before the small star.
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: a node and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .filter("u <> v")
            .distinct()
        )
        last, cur = cur, settle(small, f"{name}-step")
        release(last)
        # Settled once each node has one edge and no root has any: nothing would move any more.
        ends = cur.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("low")).union(cur.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("low").alias("low")).filter("up > 1 or (up > 0 and low > 0)").isEmpty():
            break
    root = cur.select(F.col("v").alias("node")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(root.select("node", F.col("node").alias("root")))


def _apart(buckets: DataFrame, comp: DataFrame | None, name: str) -> DataFrame:
    """The bucket rows with their component so far, without buckets that lie in one component."""
    if comp is None:
        rows = buckets.withColumn("c", F.col("node"))
    else:  # written, as two steps read it
        rows = settle(buckets.join(comp.select("node", "root"), "node", "left").withColumn("c", F.coalesce("root", "node")).drop("root"), f"{name}-named")
    split = rows.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("sig")
    out = settle(rows.join(split, "sig"), f"{name}-buckets")
    release(rows)
    return out


#: A ring round deals a bucket into so many parts, in which each node meets the next few.
PARTS, NEXT = 16, 8
#: The last round begins once it has at most so many pairs a bucket row.
EACH = 16


def _pairs_left(rows: DataFrame) -> tuple[int, int]:
    """The bucket rows, and the pairs of different components within them (a pair of several buckets counts in each)."""
    of = rows.groupBy("sig", "c").agg(F.count("*").alias("k")).groupBy("sig").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("own"))
    n, pairs = of.agg(F.sum("n"), F.sum((F.col("n").cast("double") * F.col("n") - F.col("own")) / 2)).first()
    return n or 0, pairs or 0


def _pair(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def _with_pivot(rows: DataFrame, fits, odd, one: bool) -> DataFrame:
    """Each node with the least odd one of each of its buckets, or of all of them together if ``one``."""
    head = rows.groupBy("sig").agg(F.min(F.struct(odd(F.col("n")).alias("odd"), F.xxhash64("node").alias("h"), "node", "n", "c")).alias("p"))
    met = rows.join(head, "sig").filter((F.col("c") != F.col("p.c")) & fits(F.col("n"), F.col("p.n")))
    return _pair(met.groupBy("node").agg(F.min("p").alias("p")) if one else met, "node", "p.node")


def _in_ring(rows: DataFrame, fits, r: int) -> DataFrame:
    """Each node with the next few of its part of the bucket, in an order of hashes that differs between buckets and rounds."""
    order = F.xxhash64("node", "sig", F.lit(r))
    near = Window.partitionBy("sig", F.pmod(F.xxhash64("node", F.lit(r)), F.lit(PARTS))).orderBy(order, "node").rowsBetween(1, NEXT)
    met = rows.withColumn("p", F.collect_list(F.struct("node", "n", "c")).over(near)).withColumn("p", F.explode("p"))
    return _pair(met.filter((F.col("c") != F.col("p.c")) & fits(F.col("n"), F.col("p.n"))), "node", "p.node")


def _all_left(rows: DataFrame, fits) -> DataFrame:
    x, y = (rows.select("sig", *[F.col(c).alias(f"{c}{k}") for c in ("node", "n", "c")]) for k in (1, 2))
    return _pair(x.join(y, "sig").filter((F.col("c1") < F.col("c2")) & fits(F.col("n1"), F.col("n2"))), "node1", "node2")


def bucket_links(signatures: DataFrame, fits, verify, name: str, odd=lambda n: F.lit(0), each: int = EACH) -> DataFrame:
    """(node, root) of all nodes with a link, from rows (sig, node, n): nodes that link share a signature.

    ``fits(n, m)`` tells which sizes (or structs that a pair is judged by) can link, ``verify(pairs)`` adds to pairs
    (a, b) whether they do, ``odd(n)`` how unlike a bucket's others a node is
    (the least odd one is the pivot). A large bucket isn't expanded into pairs:
    its nodes meet one pivot first, then that of each bucket, which joins
    copies of one text, then some others each, which joins groups whose texts
    differ among each other. Once few pairs (``each`` a row) are left in different components,
    or a ring spares less than half of them, a last round compares them all,
    exactly. Pairs inside one component are skipped, as their links change
    nothing. A settled table of signatures is deleted once read.
    """
    tested, comp, rows, before, r = None, None, signatures, 0, 0
    while True:
        last, rows = rows, _apart(rows.select("sig", "node", "n"), comp, name)
        release(last)
        n, left = _pairs_left(rows)
        if comp is not None and not n:
            break
        end = r > 0 and (left <= each * n or (r > 2 and left > 0.5 * before))
        pairs = _all_left(rows, fits) if end else _in_ring(rows, fits, r) if r > 1 else _with_pivot(rows, fits, odd, one=r == 0)
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        done = settle(verify(pairs).select("a", "b", "linked"), f"{name}-verified")
        tested = done if tested is None else tested.unionByName(done)
        last, comp = comp, settle(components(tested.filter("linked").select("a", "b"), name=name), f"{name}-components")
        release(last)
        if end:
            break
        before, r = left, r + 1
    release(rows)
    return comp
