"""Language of web pages by Bayesian fusion of text, declared language, address suffix and host.

Evidence is combined as log probabilities: a naive Bayes model of byte
trigrams for the text, tables of how often a declared language or an address
suffix goes with each language, and a prior of the host that is smoothed
towards its domain's, which is smoothed towards the whole corpus'. The tables
and priors are grouped sums of the text model's posteriors over all pages.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm import bytesops as B
from papyra.llm.common import ship
from papyra.scratch import settle

_BUCKETS = 1 << 14
#: Trigrams that count as independent evidence; more don't make the text surer.
EFFECTIVE = 60.0
SMOOTHING = 5.0
EVIDENCE = "page_id long, host string, domain string, suffix string, declared string, ll array<double>"


def _trigrams(raw: bytes) -> np.ndarray:
    d = np.frombuffer(raw, np.uint8)
    low = B.LOWER[d].astype(np.uint32)
    low[~B.ALNUM[d]] = 32
    if len(low) < 3:
        return np.zeros(0, np.int64)
    h = (low[:-2] * 0x9E3779B1 ^ low[1:-1] * 0x85EBCA77 ^ low[2:] * 0xC2B2AE3D) & 0xFFFFFFFF
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int64)


class TextModel:
    """Naive Bayes over hashed byte trigrams."""

    def __init__(self, langs: list[str], texts: list[str]):
        self.langs = sorted(set(langs))
        counts = np.full((len(self.langs), _BUCKETS), 0.5)
        for lang, text in zip(langs, texts, strict=True):
            counts[self.langs.index(lang)] += np.bincount(_trigrams((text or "").encode()), minlength=_BUCKETS)
        self.weight = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)

    def evidence(self, raw: bytes) -> np.ndarray:
        """Log likelihoods, tempered to EFFECTIVE trigrams, the largest 0; all 0 without text."""
        t = _trigrams(raw)
        if not len(t) or not self.langs:
            return np.zeros(len(self.langs))
        ll = self.weight[:, t].sum(1, dtype=np.float64) * min(1.0, EFFECTIVE / len(t))
        return ll - ll.max()


def train(docs: DataFrame, rows: int = 4000, lang_col: str = "lang", text_col: str = "text") -> TextModel:
    """A model from about ``rows`` whole labelled texts: those of the smallest hashes, so the same ones on every run.

    The hash that bounds the sample is found first, over hashes alone; equal
    texts share a hash and are taken once.
    """
    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null").withColumn("h", F.xxhash64("text", "lang"))
    last = known.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if last is None:
        return TextModel([], [])
    t = known.filter(F.col("h") <= last).dropDuplicates(["h"]).orderBy("h").limit(rows).select("lang", "text").toArrow()
    return TextModel(t["lang"].to_pylist(), t["text"].to_pylist())


_HIDDEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_DECLARED = re.compile(r"<html[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
_META = re.compile(r"<meta[^>]*content-language[^>]*content\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def page_evidence(url: str | None, html: str | None) -> tuple[str, str, str, str, bytes]:
    """Host, domain, suffix, declared language and visible text of a page; what is missing is empty."""
    html = html or ""
    m = _DECLARED.search(html) or _META.search(html)
    declared = m[1].lower() if m else ""
    h = _HOST.match(url or "")
    host = h[1].lower().rstrip(".") if h else ""
    parts = host.split(".")
    text = unescape(_TAG.sub(" ", _HIDDEN.sub(" ", html)))
    return host, ".".join(parts[-2:]), parts[-1], declared, text.encode()


def identify(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, lang, confidence, text_lang, declared, host) of every page.

    A page's own text is taken out of every sum that it is judged by. A null
    address or page, and a page that declares nothing, has no evidence of that
    kind and is judged by the rest, at last by how common the languages are;
    equal rows are judged alike; ties go to the language first by name. A declared
    language that the model doesn't know counts as "other". Without any
    trained language the result's lang is null.
    """
    ship(pages.sparkSession)
    langs = model.langs
    known = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches):
        m = known.value
        for b in batches:
            out = []
            for url, html in zip(b.column("url"), b.column("html"), strict=True):
                host, domain, suffix, declared, raw = page_evidence(url.as_py(), html.as_py())
                out.append((host, domain, suffix, declared if declared in m.langs or not declared else "other", m.evidence(raw)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array(list(c), pa.string()) for c in columns[:4]), pa.array(list(columns[4]), pa.list_(pa.float64()))], names=["page_id", "host", "domain", "suffix", "declared", "ll"])

    read = settle(rows.mapInArrow(run, EVIDENCE), "language-evidence")
    if not langs:
        return read.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"), "declared", "host")
    k = len(langs)
    whole = F.aggregate("ll", F.lit(0.0), lambda a, x: a + F.exp(x))
    soft = read.withColumn("p", F.transform("ll", lambda x: F.exp(x) / whole))
    sums = [F.sum(F.get("p", F.lit(i))) for i in range(k)]

    def table(*keys):
        return soft.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*sums).alias("s"))

    total = table().first()
    n_all, s_all = total["n"] or 0, [x or 0.0 for x in total["s"]]
    # Declared values are one of the known languages, "other" or "": a table of bounded size.
    seen = {r["declared"]: r["s"] for r in table("declared").collect()}
    arr = lambda v: F.array(*[F.lit(float(x)) for x in v])
    by_value = arr([0.0] * k)
    for d, v in sorted(seen.items()):
        by_value = F.when(F.col("declared") == d, arr(v)).otherwise(by_value)
    hosts = table("host", "domain", "suffix").filter("host <> ''")
    domains = hosts.groupBy("domain").agg(F.sum("n").alias("n_domain"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(k)]).alias("s_domain"))
    suffixes = hosts.groupBy("suffix").agg(F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(k)]).alias("s_suffix"))
    n_suffix = suffixes.count()
    hosts = hosts.join(domains, "domain").join(suffixes, "suffix").select("host", F.col("n").alias("n_host"), F.col("s").alias("s_host"), "n_domain", "s_domain", "s_suffix")
    own = soft.join(hosts, "host", "left").withColumn("s_declared", by_value)
    # The page itself is taken out of every sum; a sum that is left empty by rounding is 0.
    rest = lambda sums, i: F.greatest((F.get(sums, i) if isinstance(sums, str) else F.get(arr(sums), i)) - F.get("p", i), F.lit(0.0))
    likely = lambda sums, i, values: F.log((rest(sums, i) + 0.5) / (rest(s_all, i) + 0.5 * values))
    every = lambda i: (rest(s_all, i) + 1) / (n_all - 1 + k)
    domain = lambda i: (rest("s_domain", i) + SMOOTHING * every(i)) / (F.col("n_domain") - 1 + SMOOTHING)
    host = lambda i: (rest("s_host", i) + SMOOTHING * domain(i)) / (F.col("n_host") - 1 + SMOOTHING)
    addressed = F.col("host") != ""
    by_declared = lambda i: F.when(F.col("declared") == "", 0.0).otherwise(likely("s_declared", i, k + 2))
    by_address = lambda i: F.when(addressed, likely("s_suffix", i, n_suffix) + F.log(F.greatest(host(i), F.lit(1e-9)))).otherwise(F.log(every(i)))
    score = F.transform("ll", lambda x, i: x + by_declared(i) + by_address(i))
    best = F.array_max("score")
    name = lambda at: F.get(F.array(*[F.lit(x) for x in langs]), (at - 1).cast("int"))
    return own.withColumn("score", score).select(
        "page_id",
        name(F.array_position("score", best)).alias("lang"),
        (1 / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max(F.col("score"))))).alias("confidence"),
        name(F.array_position("ll", F.array_max("ll"))).alias("text_lang"),
        "declared",
        "host",
    )
