"""Which filter removes what, in every order: joint failures, inclusion-exclusion and Shapley shares.

Texts are read once. Each document becomes a mask of the filters it fails, and
each mask counts once for every set of filters inside it, which is where the
product of those filters' flags is 1. These 32 joint counts a part (three of
them: all documents, good and toxic ones) are all that is kept. What survives
a set of filters is their alternating sum (inclusion-exclusion), what fails
exactly one filter its Moebius inverse, and the mean share over all orders
comes from the Harsanyi dividends, which for "removed by any of S" are the
joint counts with alternating sign, divided evenly within S.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.scratch import settle

#: The filters, in order of their bits.
FILTERS = "ABCDE"
#: What separates words, as the trimming function and the pattern want it.
_BLANK, _BLANKS = " \t\n\x0b\f\r", r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """The failure condition of each filter that looks at one text alone."""
    body = F.btrim(text, F.lit(_BLANK))
    words = F.when(body != "", F.split(body, _BLANKS)).otherwise(F.array().cast("array<string>"))
    # A lambda's variable, so that the words are split once.
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("unlike")))[0]
    n, unlike = counts["n"], counts["unlike"]
    return {
        "A": n < 50,
        "B": 100 * unlike.cast("long") < 65 * n.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the set of filters that they fail, one bit a filter.

    A null text is an empty one (no words: it fails A alone of the first four),
    a null part the part ''. Filter E fails a document whose text a smaller id
    has as well; equal ids don't fail each other, and a document without an id
    neither fails E nor makes others fail. Repeated rows count as often as
    they stand. An id is good or toxic if any of its label rows says so; other
    columns aren't read. Texts are compared by SHA-256.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    failed = text_failures(text)
    mask = sum((F.when(failed[f], 1 << FILTERS.index(f)).otherwise(0) for f in failed), F.lit(0))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(text, 256)).alias("same")
    )
    rows = settle(rows, "filter-masks")
    # Ids that are null match no label; the second key deals them out over all tasks.
    rows = rows.withColumn("deal", F.when(F.col("id").isNull(), F.xxhash64("same")).otherwise(F.lit(0).cast("long")))
    judged = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic")
    )
    judged = judged.withColumn("deal", F.lit(0).cast("long"))
    rows = rows.join(judged, ["id", "deal"], "left").fillna(0, ["good", "toxic"])
    # Copies of one text come down to one row per part and label before they meet.
    kinds = ["same", "part", "mask", "good", "toxic"]
    ids = rows.groupBy("id", "deal", *kinds).agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    kind = ids.groupBy(*kinds).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("bare"), least.alias("least"))
    kind = settle(kind, "filter-kinds")
    first = kind.groupBy("same").agg(F.min("least.id").alias("first"), F.sum("n").alias("all"))
    # Only texts that stand more than once are looked up again.
    several = first.filter("all > 1").select("same", "first")
    kind = kind.join(several, "same", "left")
    kept = F.col("bare") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    copies = F.when(F.col("first").isNull(), F.lit(0).cast("long")).otherwise(F.col("n") - kept)
    bit = 1 << FILTERS.index("E")
    both = F.array(F.struct(F.col("mask"), (F.col("n") - copies).alias("n")), F.struct((F.col("mask") + bit).alias("mask"), copies.alias("n")))
    out = kind.select("part", "good", "toxic", F.explode(both).alias("m")).filter("m.n > 0")
    return out.groupBy("part", F.col("m.mask").alias("mask")).agg(
        F.sum("m.n").alias("n"), F.sum(F.col("m.n") * F.col("good")).alias("good"), F.sum(F.col("m.n") * F.col("toxic")).alias("toxic")
    )


def joint_failures(by_mask: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, n, good, toxic): for each part three arrays of joint failure counts, the one of set S at place S (0: all documents)."""
    last = (1 << len(filters)) - 1
    inside = F.filter(F.sequence(F.lit(0), F.lit(last)), lambda s: s.bitwiseAND(F.col("mask")) == s)
    per_set = by_mask.select("part", F.explode(inside).alias("set"), "n", "good", "toxic").groupBy("part", "set").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    got = per_set.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("set", F.struct("n", "good", "toxic")))).alias("at"))
    return got.select("part", *(F.expr(f"transform(sequence(0, {last}), s -> coalesce(at[s].{c}, 0L))").alias(c) for c in ("n", "good", "toxic")))


def audit(joint: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from joint failure counts alone; an empty table gives no rows.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley
    (removals of the step's filter summed over all orders) count documents.
    """
    k = len(filters)
    bits = f"transform(sequence(0, {k - 1}), f -> shiftleft(1, f))"
    # For each bit in turn, a set with it gets what the set without it has, less its own.
    survivors = "aggregate({bits}, {col}, (acc, b) -> transform(acc, (x, m) -> if(m & b > 0, acc[m ^ b] - x, x)))"
    # For each bit in turn, a set without it loses what the set with it has.
    exactly = f"aggregate({bits}, n, (acc, b) -> transform(acc, (x, m) -> if(m & b > 0, x, x - acc[m | b])))"
    # A set's dividend is its joint count, plus for odd sizes and minus for even ones; its filters share it alike.
    dividends = f"transform(n, (x, m) -> if(bit_count(m) % 2 = 1, x, -x) * {factorial(k)}L div greatest(bit_count(m), 1))"
    parts = joint.select(
        "part", F.col("n").alias("fails"), F.expr(exactly).alias("exactly"), F.expr(dividends).alias("dividends"),
        *(F.expr(survivors.format(bits=bits, col=c)).alias(c) for c in ("n", "good", "toxic")),
    ).withColumn("shares", F.expr(f"transform({bits}, b -> aggregate(filter(dividends, (x, m) -> m & b > 0), 0L, (s, x) -> s + x))"))
    orders = ",".join("".join(p) for p in permutations(filters))
    rows = parts.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    rows = rows.withColumn("f", F.expr(f"instr('{filters}', substr(filter_order, step, 1)) - 1"))
    rows = rows.withColumn("before", F.expr(f"aggregate(filter({bits}, (b, f) -> instr(filter_order, substr('{filters}', f + 1, 1)) < step), 0, (m, b) -> m | b)"))
    rows = rows.withColumn("after", F.expr("before | shiftleft(1, f)"))
    return rows.selectExpr(
        "part", "filter_order", "step", "n[after] AS kept", "n[before] - n[after] AS removed", "fails[shiftleft(1, f)] - n[before] + n[after] AS redundant",
        "exactly[shiftleft(1, f)] AS unique_fails", "good[before] - good[after] AS good_lost", "toxic[before] - toxic[after] AS toxic_lost", "shares[f] AS shapley",
    )
