"""N-gram Jaccard join by token-combination prefixes.

A document is its set of word n-grams, as 64-bit hashes. Under one global
order of tokens (frequent ones last), two sets that link share at least k
tokens within prefixes of length n - ceil(t n) + k, for any k they can share.

1. Prefixes extended to a k of 16 or more leave out most sets: those with
   fewer than k prefix tokens that another prefix holds link with nothing.
   Of the others the whole sets are made.
2. Tokens that only one of those sets holds are no part of any overlap: a set
   is then its core, the rest. A core under ceil(t n) links with nothing, and
   sets of one size and one core link with the same sets, so they go on as
   one. What is left of tokens is counted again while that helps.
3. Cores are joined on their prefixes, which are that much shorter: on single
   tokens where few cores hold them, on pairs of tokens where many do. With
   k = 2, two linking sets share two prefix tokens: both frequent, then a pair is shared,
   or one rare, then that one is. Long sets index single tokens of either
   class, as their pairs would be too many; sets near the boundary do both,
   so no link is lost. Candidates are verified on the cores.

Links within a bucket aren't expanded into all pairs: a few rounds compare
each bucket with one pivot, and a last round compares what is left in
different components, exactly. Only pairs inside one component, which can't
change any result, are skipped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm import bytesops as B
from papyra.llm.common import bitmap_of, bucket_links, in_bitmap, ship, text_rows
from papyra.scratch import release, settle

#: A slot of the heavy table is frequent from so many documents on (counted within tasks, see _heavy).
HEAVY = 64
_LOCAL = 4
#: A prefix token is of the frequent class beyond so many sets; sets of up to PAIRED tokens index pairs of those.
FREQUENT, PAIRED = 5000, 120
#: Prefixes are first extended so that linking sets share so many tokens in them (or all that they share), or this part of what may differ.
EXTEND, WIDE = 16, 0.5
#: Tokens are counted again while that leaves out so many of the sets (a part of one).
PEEL = 0.1
_SLOT = (1 << 27) - 1
_BIG = 2**63 - 1


def sets_of(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Each text's sorted distinct n-grams; of a text with fewer words, its whole sequence."""
    w = B.Words(data, offsets, B.SPACED)
    h = w.hashes(lower=True)
    grams = B.grams(h, n)
    out = []
    for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if j - i >= n:
            s = np.sort(grams[i : j - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(B.grams(h[i:j], j - i) if j > i else h[:0])
    return out


def node_of(s: np.ndarray) -> int:
    """A 64-bit name of a set: equal sets have equal names."""
    if not len(s):
        return 0
    total = np.array([B.mix(s).sum(dtype=np.uint64)])
    other = np.array([np.bitwise_xor.reduce(B.mix(s ^ B.U(0x5851F42D4C957F2D)))])
    return int((B.mix(total) ^ B.mix(other + np.array([len(s)], np.uint64))).view(np.int64)[0])


def _ordered(s: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Tokens as non-negative longs in the global order: frequent ones last, else by hash."""
    return np.concatenate([s[~late] >> B.U(2), s[late] >> B.U(2) | B.U(1 << 62)]).view(np.int64)


def _overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _each(docs: DataFrame, n: int, schema: str, make, end=None) -> DataFrame:
    """One pass over the texts: ``make(ids, sets)`` gives a batch for each run, ``end(sets seen)`` the last."""

    def run(batches):
        state = [] if end else None
        for b in batches:
            data, offsets = B.utf8(b.column("text"))
            for i, j, piece, off in B.pieces(data, offsets):
                yield make(b.column("doc_id").slice(i, j - i), sets_of(piece, off, n), state)
        if end:
            yield end(state)

    return docs.mapInArrow(run, schema)


def _fold(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    slots, counts = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    return slots[counts >= _LOCAL], counts[counts >= _LOCAL]


def _summary(docs: DataFrame, n: int) -> DataFrame:
    """Per document its set's size and name; per task one more row of the slots that _LOCAL or more of its sets have.

    A task counts slots 8 million at a time, so the counts are low by at most
    _LOCAL - 1 a turn. They only order the tokens: any order gives right results.
    """
    names = ["doc_id", "n", "node", "slots", "counts"]
    ints = pa.list_(pa.int32())

    def make(ids, sets, state):
        state.append([(s & B.U(_SLOT)).astype(np.uint32) for s in sets])
        if sum(len(x) for x in state[-1]) and len(state) >= 24:
            _turn(state)
        sizes = [len(s) for s in sets]
        none = pa.nulls(len(sets), ints)
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), none, none], names=names)

    def _turn(state):
        parts = [y for x in state if isinstance(x, list) for y in x]
        done = [x for x in state if isinstance(x, tuple)]
        state[:] = [*done, _fold(parts)]

    def end(state):
        _turn(state)
        slots, counts = (np.concatenate([x[k] for x in state]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.nulls(1, pa.int64()), pa.array([slots.astype(np.int32)], ints), pa.array([counts.astype(np.int32)], ints)], names=names)

    return _each(docs, n, "doc_id long, n long, node long, slots array<int>, counts array<int>", make, end)


def _k(percent: int) -> int:
    """Tokens that linking sets share in their prefixes at least: at 50 % and less they may share one in all."""
    return 2 if percent > 50 else 1


def _prefixes(docs: DataFrame, n: int, percent: int, heavy) -> DataFrame:
    """(doc_id, node, least, prefix) of each set that is large enough to link with another: linking sets share ``least`` prefix tokens."""

    def make(ids, sets, _):
        table, keep, nodes, prefix, least = heavy.value, [], [], [], []
        for k, s in enumerate(sets):
            if 100 * len(s) < percent * (len(s) + 1):
                continue
            keep.append(k)
            nodes.append(node_of(s))
            o = _overlap(len(s), percent)
            least.append(min(max(EXTEND, int(WIDE * (len(s) - o))), o))
            prefix.append(_ordered(s, in_bitmap(table, s))[: len(s) - o + least[-1]])
        return pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(nodes, pa.int64()), pa.array(least, pa.int32()), pa.array(prefix, pa.list_(pa.int64()))], names=["doc_id", "node", "least", "prefix"])

    return _each(docs, n, "doc_id long, node long, least int, prefix array<long>", make)


def _full(docs: DataFrame, n: int, wanted, heavy) -> DataFrame:
    """(node, own, tokens) of the sets whose node and id are in the bitmap, tokens in the global order."""

    def make(ids, sets, _):
        own = ids.fill_null(_BIG).to_numpy(zero_copy_only=False)
        named = np.array([node_of(s) for s in sets], np.int64)
        hit = np.flatnonzero(in_bitmap(wanted.value, (named ^ own).view(np.uint64)))
        tokens = [_ordered(sets[k], in_bitmap(heavy.value, sets[k])) for k in hit]
        return pa.RecordBatch.from_arrays([pa.array(named[hit]), pa.array(own[hit]), pa.array(tokens, pa.list_(pa.int64()))], names=["node", "own", "tokens"])

    return _each(docs, n, "node long, own long, tokens array<long>", make)


def _able(prefixes: DataFrame) -> DataFrame:
    """The nodes of which ``least`` prefix tokens or more stand in another such node's prefix: counted again without those left out while that helps."""
    now, size = prefixes, None
    while True:
        rows = now.select("node", "least", F.explode("prefix").alias("sig"))
        often = rows.groupBy("sig").agg(F.count("*").alias("cnt")).filter("cnt > 1").select("sig")
        own = rows.join(often, "sig").groupBy("node", "least").agg(F.collect_list("sig").alias("prefix"))
        last, now = now, settle(own.filter(F.size("prefix") >= F.col("least")), "jaccard-able")
        release(last)
        before, size = size, now.count()
        if before is not None and before - size <= PEEL * before:
            return now.select("node")


def _cores(sets: DataFrame, percent: int) -> DataFrame:
    """(node, n, core, odd): sets whose core is large enough to link; ``odd`` counts the tokens that at most one other holds."""
    now = sets.select("node", F.size("tokens").alias("n"), F.col("tokens").alias("core"), F.lit(0).alias("odd"))
    size = now.count()
    if not size:
        return settle(now, "jaccard-cores")
    while size:
        held = now.select("node", F.explode("core").alias("sig")).groupBy("sig").agg(F.count("*").alias("cnt"), F.min("node").alias("a"), F.max("node").alias("b")).filter("cnt < 3")
        of = held.select("sig", "cnt", F.explode(F.array_distinct(F.array("a", "b"))).alias("node"))
        few = of.groupBy("node").agg(F.collect_list(F.when(F.col("cnt") == 1, F.col("sig"))).alias("alone"), F.count("*").alias("few"))
        core = F.array_except("core", F.coalesce("alone", F.array().cast("array<long>")))
        rest = now.join(few, "node", "left").select("node", "n", core.alias("core"), (F.col("odd") + F.coalesce("few", F.lit(0))).cast("int").alias("odd"))
        last, now = now, settle(rest.filter(100 * F.size("core") >= percent * F.col("n")), "jaccard-cores")
        release(last)
        before, size = size, now.count()
        if before - size <= PEEL * before:
            break
    return now


def _signatures(classes: DataFrame, percent: int) -> DataFrame:
    """(sig, node, (n, most, odd)) of each class: its core's rare prefix tokens and the pairs of its frequent ones.

    ``most`` bounds the overlap with a set that shares this token and none of
    the rare ones before it: those are then missing there. Sets that link meet
    in the bucket of the first rare token they share, so the bound may be
    asked for in every bucket.
    """
    tokens = settle(classes.select("node", "n", F.size("core").alias("c"), "odd", F.explode("prefix").alias("sig")), "jaccard-tokens")
    frequent = tokens.groupBy("sig").agg(F.count("*").alias("cnt")).filter((F.col("cnt") > FREQUENT) & F.lit(_k(percent) > 1)).select("sig", F.lit(True).alias("frequent"))
    rows = settle(tokens.join(frequent, "sig", "left").withColumn("frequent", F.coalesce("frequent", F.lit(False))), "jaccard-named")
    release(tokens)
    before = F.sum(F.when(F.col("frequent"), 0).otherwise(1)).over(Window.partitionBy("node").orderBy("sig").rowsBetween(Window.unboundedPreceding, -1))
    sized = lambda most: F.struct("n", most.cast("int").alias("most"), "odd").alias("n")
    single = rows.withColumn("before", F.coalesce(before, F.lit(0))).filter(~F.col("frequent") | (F.col("n") > PAIRED * percent // 100)).select("sig", "node", sized(F.col("c") - F.col("before")))
    # Pairs of one short set's frequent prefix tokens: a few dozen tokens at most.
    own = rows.filter(F.col("frequent") & (F.col("n") <= PAIRED)).groupBy("node", "n", "c", "odd").agg(F.sort_array(F.collect_set("sig")).alias("t"))
    pairs = F.expr("flatten(transform(t, (x, i) -> transform(slice(t, i + 2, size(t)), y -> xxhash64(x, y))))")
    out = settle(single.unionByName(own.select(F.explode(pairs).alias("sig"), "node", sized(F.col("c")))), "jaccard-signatures")
    release(rows)
    return out


def _linked(i, n, m, percent: int):
    """Whether an overlap of i is enough for sets of n and m tokens."""
    return 100 * i >= percent * (n + m - i)


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose prefixes don't rule a link out: a prefix token up to the end of the other's prefix that the other lacks is in one set only."""
    side = lambda k: classes.select(F.col("node").alias(k), F.col("prefix").alias(f"p{k}"), F.col("n").alias(f"n{k}"), F.size("core").alias(f"c{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("end", F.least(F.element_at("pa", -1), F.element_at("pb", -1)))
    lack = lambda x, y: F.size(F.array_except(F.filter(x, lambda v: v <= F.col("end")), y))
    most = F.least(F.col("ca") - lack("pa", "pb"), F.col("cb") - lack("pb", "pa"))
    return both.filter(_linked(most, F.col("na"), F.col("nb"), percent)).select("a", "b")


def _verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) for each pair that may link, on the whole cores."""
    left, right = (classes.select(F.col("node").alias(k), F.col("core").alias(f"c{k}"), F.col("n").alias(f"n{k}")) for k in ("a", "b"))
    both = _plausible(pairs, classes, percent).join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("ca", "cb")))
    return both.select("a", "b", _linked(F.col("i"), F.col("na"), F.col("nb"), percent).alias("linked"))


def _class_links(cores: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the sets that link, from their cores."""
    kinds = ["n", "c", "x", "y"]
    keyed = cores.select("node", "odd", "n", "core", F.size("core").alias("c"), F.xxhash64("core").alias("x"), F.xxhash64(F.lit(1), "core").alias("y"))
    named = settle(keyed.join(keyed.groupBy(*kinds).agg(F.min("node").alias("class")), kinds).select("node", "class", "n", "c", "odd", F.when(F.col("node") == F.col("class"), F.col("core")).alias("core")), "jaccard-classes")
    heads = named.filter("node = class")
    length = F.col("c") - F.ceil(percent * F.col("n") / 100) + _k(percent)
    classes = settle(heads.select("node", "n", "odd", "core", F.slice("core", F.lit(1), length.cast("int")).alias("prefix")), "jaccard-heads")
    fits = lambda x, y: _linked(F.least(x["most"], y["most"]), x["n"], y["n"], percent)
    root = bucket_links(_signatures(classes, percent), fits, lambda pairs: _verified(pairs, classes, percent), "jaccard", lambda n: n["odd"])
    release(classes)
    # Sets of one class link with each other if their core is enough; else through what their class links with.
    own = named.filter("node <> class").select("class").distinct().join(heads.select("node", "n", "c"), F.col("class") == F.col("node")).filter(_linked(F.col("c"), F.col("n"), F.col("n"), percent)).select("class")
    known = root.select(F.col("node").alias("class"), "root").unionByName(own.join(root, F.col("class") == F.col("node"), "left_anti").select("class", F.col("class").alias("root")))
    return named.select("node", "class").join(known, "class").select("node", "root")


def join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; sets link at Jaccard similarity of ``percent`` % or more.

    A null or empty text has an empty set, links with nothing and is its own
    component. A text with fewer than ``n`` words is one token. Equal sets are
    one node, however many rows have them, so equal rows get equal results.
    component_id is the smallest id reachable; rows with a null id take part,
    and if no id is reachable it is null. Other columns, whatever their names,
    are left out; an empty table gives an empty result. Names of sets are 64
    bits long: among 10^10 different sets fewer than three pairs are expected
    to share one.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = text_rows(docs, id_col, text_col)
    summary = settle(_summary(rows, n), "jaccard-summary")
    known = summary.filter("n >= 0").select("doc_id", "n", "node")
    slots = summary.filter("n < 0").select(F.explode(F.arrays_zip("slots", "counts")).alias("x")).groupBy(F.col("x.slots").cast("long").alias("slot")).agg(F.sum("x.counts").alias("c")).filter(F.col("c") >= HEAVY)
    heavy = spark.sparkContext.broadcast(bitmap_of(slots, "slot"))
    reps = settle(known.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep")), "jaccard-sets")
    # One row of each distinct set goes on.
    first = reps.select("node", F.coalesce("rep", F.lit(_BIG)).alias("own"))
    made = _prefixes(rows, n, percent, heavy).withColumn("own", F.coalesce("doc_id", F.lit(_BIG))).drop("doc_id")
    prefixes = settle(made.join(first, ["node", "own"], "left_semi").dropDuplicates(["node"]).select("node", "least", "prefix"), "jaccard-prefixes")
    able = settle(_able(prefixes).join(first, "node"), "jaccard-able")
    wanted = spark.sparkContext.broadcast(bitmap_of(able.select(F.expr("node ^ own").alias("k")), "k"))
    sets = settle(_full(rows, n, wanted, heavy).join(able, ["node", "own"], "left_semi").dropDuplicates(["node"]).select("node", "tokens"), "jaccard-full")
    release(able)
    cores = _cores(sets, percent)
    release(sets)
    root = _class_links(cores, percent)
    tied = settle(root.join(reps, "node"), "jaccard-tied")
    release(cores)
    least = tied.groupBy("root").agg(F.min("rep").alias("least"))
    # A set without links is its own component.
    names = reps.join(tied.join(least, "root").select("node", "least", F.lit(True).alias("tied")), "node", "left")
    names = names.select("node", F.when(F.col("tied"), F.col("least")).otherwise(F.col("rep")).alias("component_id"))
    linked = known.filter("n > 0").join(names, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(known.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
