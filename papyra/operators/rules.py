"""Classification rules of each issuer as data, compiled to one expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules are a small table that people write; more is taken as an error.
MOST = 10_000

# Fixed values: (issuer, what is classified, priority, pattern, value); the pattern of a default is empty.
CLASS_RULES = [
    ("마이다스에셋자산운용", "account_type", 1, "퇴직연금", "퇴직연금"),
    ("마이다스에셋자산운용", "account_type", 2, "개인연금", "연금저축"),
    ("마이다스에셋자산운용", "account_type", 9, "", "일반"),
    ("마이다스에셋자산운용", "channel", 1, "온라인슈퍼", "온라인슈퍼"),
    ("마이다스에셋자산운용", "channel", 2, "온라인", "온라인"),
    ("마이다스에셋자산운용", "channel", 3, "오프라인", "오프라인"),
    ("마이다스에셋자산운용", "channel", 9, "", "미분류"),
    ("미래에셋자산운용", "account_type", 1, "P2|rp", "퇴직연금"),
    ("미래에셋자산운용", "account_type", 2, "-P", "연금저축"),
    ("미래에셋자산운용", "account_type", 9, "", "일반"),
    ("미래에셋자산운용", "channel", 1, "e$", "온라인"),
    ("미래에셋자산운용", "channel", 2, "^S$", "온라인슈퍼"),
    ("미래에셋자산운용", "channel", 3, "F|I", "기관"),
    ("미래에셋자산운용", "channel", 9, "", "오프라인"),
]
SCHEMA = "issuer string, kind string, priority int, pattern string, value string"


def compiled(rules: DataFrame, issuer: Column, label: Column, kind: str) -> Column:
    """The value of the first rule (by priority, then pattern) of the row's issuer that its label matches.

    An issuer without rules of the kind is an error that names it, and so is a
    label that no rule matches where the issuer has no default; a null label
    takes the default. Two rules of one priority and pattern are an error here.
    """
    rows = rules.filter(F.col("kind") == kind).select("issuer", "priority", "pattern", "value").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"over {MOST} rules of {kind}")
    of: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["issuer"], r["priority"], r["pattern"] == "", r["pattern"])):
        of.setdefault(r["issuer"], []).append(r)
    out = None
    for name, own in of.items():
        if len({(r["priority"], r["pattern"]) for r in own}) < len(own):
            raise ValueError(f"{name} has two rules of one priority and pattern for {kind}")
        default = next((F.lit(r["value"]) for r in own if not r["pattern"]), None)
        missing = F.raise_error(F.concat(F.lit(f"no rule of {name} for {kind} matches "), F.coalesce(label, F.lit("null"))))
        tests = [(label.rlike(r["pattern"]), r["value"]) for r in own if r["pattern"]]
        end = default if default is not None else missing.cast("string")
        value = reduce(lambda e, t: F.when(t[0], t[1]).otherwise(e), reversed(tests), end)
        out = F.when(issuer == name, value) if out is None else out.when(issuer == name, value)
    unknown = F.raise_error(F.concat(F.lit(f"no rules for {kind} of issuer "), F.coalesce(issuer, F.lit("null")))).cast("string")
    return unknown if out is None else out.otherwise(unknown)


def classified(rows: DataFrame, rules: DataFrame, issuer: str, label: str, kinds: list[str]) -> DataFrame:
    """``rows`` with a column for each kind of classification."""
    return rows.withColumns({k: compiled(rules, F.col(issuer), F.col(label), k) for k in kinds})
