"""Exact token counts of every prefix of a text, found once and stored.

A byte-pair encoding never looks back past its last token: the encoding of a
prefix is that of a shorter prefix and one token, and that token is the only
vocabulary entry that ends the prefix and may follow the token before it. So
one pass over a word's bytes gives the count of all its prefixes. Words are
worked on many at once and remembered by hash; a text's counts are laid out
from those of its words and stored as differences, one a code point. Whatever
is asked afterwards (a prefix's count, where a text must be cut for a budget)
is a running sum over the stored differences.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm import bytesops as B
from papyra.llm.common import ship, text_rows
from papyra.llm.tokens import _BREAK, _LETTER, Encoder

FORMAT = "doc_id long, n_bytes long, n_chars long, n_tokens long, width int, steps binary"
_NEVER = np.int32(1 << 30)
#: Slots of the table of token pairs that were tried before.
_PAIRS = 1 << 20


class Merges:
    """Which tokens may stand side by side, and the last token of every prefix of a word."""

    def __init__(self, model: dict):
        self.closing = model["end_of_word_suffix"]
        vocab = model["vocab"]
        raw = _byte_letters()
        n = max(vocab.values()) + 1
        self.n = n
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        rank, left, right = np.full(n, -1, np.int32), np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        for r, (x, y) in enumerate(pairs):
            t = vocab[x + y]
            rank[t], left[t], right[t] = r, vocab[x], vocab[y]
        key = np.array([vocab[x] * n + vocab[y] for x, y in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int32)
        # What stood at a token's right (left) edge while it was put together, and when each was replaced.
        self.right, self.right_until = self._edge(right, rank)
        self.left, self.left_until = self._edge(left, rank)
        # A trie over the bytes of the tokens that can come out of an encoding; closed ones end a word.
        real = self._reached(left, right, rank)
        spelled = {}
        for token, t in vocab.items():
            ends = token.endswith(self.closing)
            body = token[: -len(self.closing)] if ends else token
            if body and real[t] and all(c in raw for c in body):
                spelled[bytes(raw[c] for c in body), ends] = t
        node = {x: k for k, x in enumerate(sorted({w[:k] for w, _ in spelled for k in range(len(w) + 1)}))}
        self.next, self.plain, self.closed = np.full((len(node), 256), -1, np.int32), np.full(len(node), -1, np.int32), np.full(len(node), -1, np.int32)
        for x, k in node.items():
            if x:
                self.next[node[x[:-1]], x[-1]] = k
            self.plain[k], self.closed[k] = spelled.get((x, False), -1), spelled.get((x, True), -1)
        self.tried, self.answer = np.full(_PAIRS, -1, np.int64), np.zeros(_PAIRS, bool)

    def _reached(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Tokens that their own bytes are encoded to: both parts are, and no merge crosses their border before the one that joins them."""
        made = np.flatnonzero(rank >= 0)
        out = np.ones(len(rank), bool)
        last = self._first_across(left[made], right[made])
        out[made] = last == rank[made]
        for t in made[np.argsort(rank[made])]:
            out[t] &= out[left[t]] and out[right[t]]
        return out

    @staticmethod
    def _edge(part: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token its edge tokens from the first symbol to itself, and the rank of the merge that replaces each (never for the last)."""
        chains = []
        for t in range(len(part)):
            chain = [t]
            while part[chain[-1]] >= 0:
                chain.append(int(part[chain[-1]]))
            chains.append(chain[::-1])
        deep = max(map(len, chains)) + 1
        ids, until = np.zeros((len(part), deep), np.int32), np.full((len(part), deep), _NEVER, np.int32)
        for t, chain in enumerate(chains):
            ids[t, : len(chain)] = chain
            until[t, : len(chain) - 1] = rank[chain[1:]]
        return ids, until

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER)

    def _first_across(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the first merge that crosses the border when the bytes of a and then b are encoded, or _NEVER."""
        out = np.full(len(a), _NEVER, np.int32)
        i, j, todo = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.arange(len(a))
        while len(todo):
            x, y, p, q = a[todo], b[todo], i[todo], j[todo]
            across = self._rank(self.right[x, p], self.left[y, q])
            here, there = self.right_until[x, p], self.left_until[y, q]
            # The merge of the lowest rank comes first, of one rank the leftmost.
            crossed = (across < here) & (across <= there)
            out[todo[crossed]] = across[crossed]
            go = ~crossed & ((here < _NEVER) | (there < _NEVER))
            step = here <= there
            i[todo[go & step]] += 1
            j[todo[go & ~step]] += 1
            todo = todo[go]
        return out

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.n + b
        slot = (B.mix(key.view(np.uint64)) & B.U(_PAIRS - 1)).astype(np.int64)
        out = self.answer[slot]
        miss = np.flatnonzero(self.tried[slot] != key)
        if len(miss):
            new, where, back = np.unique(key[miss], return_index=True, return_inverse=True)
            got = self._first_across(a[miss[where]], b[miss[where]]) == _NEVER
            out[miss] = got[back]
            at = slot[miss[where]]
            self.tried[at], self.answer[at] = new, got
        return out

    def prefixes(self, words: list[bytes]) -> np.ndarray:
        """Tokens of words[w][:k], as a word of its own, for all w and k (from 1): a matrix, 0 past a word's end."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        deep = int(size.max())
        flat = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(size) - size
        # The state at place k is the last token there and the count so far; place 0 is empty.
        last, count, whole = (np.zeros((len(words), deep + 1), np.int32) for _ in range(3))
        word, start, node = (np.zeros(0, np.int64) for _ in range(3))
        for k in range(deep):
            live, keep = np.flatnonzero(size > k), size[word] > k
            word, start = np.concatenate([word[keep], live]), np.concatenate([start[keep], np.full(len(live), k)])
            node = self.next[np.concatenate([node[keep], np.zeros(len(live), np.int64)]), flat[first[word] + k]].astype(np.int64)
            keep = node >= 0
            word, start, node = word[keep], start[keep], node[keep]
            for tokens, closes in ((self.plain[node], False), (self.closed[node], True)):
                c = np.flatnonzero(tokens >= 0)
                w, i, t = word[c], start[c], tokens[c]
                ok = i == 0
                later = np.flatnonzero(~ok)
                ok[later] = self.may_follow(last[w[later], i[later]], t[later])
                w, i, t = w[ok], i[ok], t[ok]
                if closes:
                    whole[w, k + 1] = count[w, i] + 1
                else:
                    last[w, k + 1], count[w, k + 1] = t, count[w, i] + 1
        return whole[:, 1:]

    def by_character(self, words: list[str]) -> list[np.ndarray]:
        """For each word the token counts of its prefixes, one a character."""
        coded = [w.encode() for w in words]
        out: list = [None] * len(words)
        order = sorted(range(len(words)), key=lambda k: len(coded[k]))
        i = 0
        while i < len(order):
            j = i + 1  # so many words at a time that their matrix stays small
            while j < len(order) and (j + 1 - i) * len(coded[order[j]]) <= _CELLS:
                j += 1
            part = order[i:j]
            whole = self.prefixes([coded[k] for k in part])
            size = np.fromiter((len(coded[k]) for k in part), np.int64, len(part))
            flat = np.frombuffer(b"".join(coded[k] for k in part) + b" ", np.uint8)
            ends = (flat[1:] & 0xC0) != 0x80
            counts = whole[np.arange(whole.shape[1]) < size[:, None]][ends]
            cut = np.cumsum(np.add.reduceat(ends.astype(np.int64), np.cumsum(size) - size))
            for k, x in zip(part, np.split(counts, cut[:-1]), strict=True):
                out[k] = x
            i = j
        return out


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones of Latin-1 stand for themselves, the rest follow from 256 in order."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


#: Cells of a matrix of words and prefixes that are worked on at a time.
_CELLS = 1 << 19
#: The tokenizer's words, white space as it knows it.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\x09-\x0D \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\p{L}\p{N}]+")
#: Characters that may change or join what stands before them: marks, conjoining Hangul, and vowel signs that count as letters.
_JOINS = regex.compile(r"[\p{M}\u1100-\u11FF\uA960-\uA97F\uD7B0-\uD7FF\U00016D63\U00016D67-\U00016D6A]")


def _normal(s: str) -> str:
    """NFC and lower case, character by character (no final sigma)."""
    return "".join(c.lower() for c in unicodedata.normalize("NFC", s))


def _plan(unit: str) -> tuple[list[str], list[tuple[int, list[tuple[str, int]]]]]:
    """A unit's words, and for each code point prefix how many of them it holds whole and the (word, characters) that it has besides."""
    # Stretches that nothing after them changes: a character and the marks on it.
    starts = [k for k, c in enumerate(unit) if k == 0 or not _JOINS.match(c)] + [len(unit)]
    parts = [_normal(unit[x:y]) for x, y in zip(starts[:-1], starts[1:], strict=True)]
    ends, text = np.cumsum([len(p) for p in parts]).tolist(), "".join(parts)
    spans = [m.span() for m in _WORD.finditer(text)]
    begins = [s for s, _ in spans]

    def prefix(m: int) -> tuple[int, list[tuple[str, int]]]:
        k = bisect_left(begins, m) - 1
        if k < 0 or m >= spans[k][1]:
            return k + 1, []
        s, e = spans[k]
        if text[s:e] in ("'re", "'ve", "'ll") and m - s == 2:  # such an ending before its last letter: a sign and a letter
            return k, [("'", 1), (text[s + 1], 1)]
        return k, [(text[s:e], m - s)]

    out = []
    for g, (x, y) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        for k in range(x + 1, y):  # a stretch's first marks may differ from their final form: these few words are counted anew
            base = ends[g - 1] if g else 0
            back = max(0, prefix(base)[0] - 1)
            tail = text[begins[back] if back < len(begins) else base : base] + _normal(unit[x:k])
            out.append((back, [(w, len(w)) for w in _WORD.findall(tail)]))
        out.append(prefix(ends[g]))
    return [text[s:e] for s, e in spans], out


class PrefixTable(Encoder):
    """Remembers for each unit of text by how much each code point changes the token count."""

    def __init__(self, spec: str, cached: int = 1_000_000):
        super().__init__(spec, cached)
        if not self.by_unit:
            raise ValueError("prefix counts need a byte-level vocabulary with closing tokens and the word pattern that this module knows")
        self.merges = Merges(json.loads(spec)["model"])
        self.special = [t["content"] for t in json.loads(spec)["added_tokens"]]

    def _encode_units(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        simple, words, odd = [], [], []
        for k, t in enumerate(texts):
            if t.isalpha() and (t.isascii() or max(t) < "\u0250") and len(word := t.lower()) == len(t):
                simple.append(k)
                words.append(word)
            else:
                odd.append(k)
        for k, counts in zip(simple, self.merges.by_character(words), strict=True):
            out[k] = np.diff(counts, prepend=0).astype(np.int32).view(np.uint32)
        plans = [_plan(texts[k]) for k in odd]
        wanted = sorted({w for whole, per in plans for w in (*whole, *(x for _, parts in per for x, _ in parts))})
        count = dict(zip(wanted, self.merges.by_character(wanted), strict=True))
        for k, (whole, per) in zip(odd, plans, strict=True):
            before = np.concatenate([[0], np.cumsum([count[w][-1] for w in whole])])
            counts = [before[n] + sum(count[w][m - 1] for w, m in parts) for n, parts in per]
            out[k] = np.diff(counts, prepend=0).astype(np.int32).view(np.uint32)
        return out

    def steps(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For all texts of a run by how much each code point changes the token count, and the n + 1 places where texts begin."""
        raw = data.tobytes()
        if b"<|" not in raw:
            return self._steps(data, offsets)
        # Special strings are cut out first: what is before one ends there, and it is one token.
        out = []
        for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            part = raw[x:y]
            found = regex.finditer("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))).encode(), part) if b"<|" in part else ()
            at, got = 0, []
            for m in found:
                here = self._steps(np.frombuffer(part[at : m.end() - 1], np.uint8), np.array([0, m.end() - 1 - at]))[0]
                own = self._steps(np.frombuffer(part[at : m.start()], np.uint8), np.array([0, m.start() - at]))[0].sum()
                got += [here, np.array([own + 1 - here.sum()])]
                at = m.end()
            got.append(self._steps(np.frombuffer(part[at:], np.uint8), np.array([0, len(part) - at]))[0])
            out.append(np.concatenate(got))
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])

    def _steps(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.n > self.cached:
            self.reset()
        inside, letter = B.SPACED[data], _LETTER[data]
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        fresh = np.ones(len(data) + 1, bool)
        fresh[1:] = ~inside | letter & np.append(_BREAK[data[1:]], False)
        fresh[offsets] = True
        start = np.flatnonzero(inside & fresh[:-1])
        stop = np.ones(len(data) + 1, bool)
        stop[:-1] = fresh[:-1] | ~inside
        end = np.flatnonzero(inside & stop[1:]) + 1
        out = np.zeros(int(lead[-1]), np.int64)
        if len(start):
            at = self._lookup(data, start, end)
            size = self.length[at]
            total = np.cumsum(size)
            run = np.arange(int(total[-1]))
            out[np.repeat(lead[start] - total + size, size) + run] = self.pool[np.repeat(self.offset[at] - total + size, size) + run].view(np.int32)
        return out, lead[offsets]


_tables: dict[int, PrefixTable] = {}


def _table(spec: str) -> PrefixTable:
    """This worker's table for a tokenizer; it lives as long as the worker."""
    key = zlib.crc32(spec.encode())
    if key not in _tables:
        _tables[key] = PrefixTable(spec)
    return _tables[key]


_WIDTHS = (np.int8, np.int16, np.int32)


def index(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: its bytes, code points and tokens, and the stored steps (``width`` bytes a code point, little-endian).

    A null text is an empty one, which has no code points and no tokens.
    Special strings inside a text are one token each. Repeated rows give
    repeated rows, null ids stay, other columns aren't read, and an empty table
    gives no rows. Texts are whole whatever their length; half a megabyte, or
    one text, is worked on at a time.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    names = [c.split()[0] for c in FORMAT.split(", ")]

    def run(batches):
        table = _table(spec.value)
        for b in batches:
            data, offsets = B.utf8(b.column("text"))
            for i, j, piece, off in B.pieces(data, offsets):
                steps, at = table.steps(piece, off)
                width, stored = [], []
                for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    part = steps[x:y]
                    kind = next(k for k in _WIDTHS if not len(part) or np.iinfo(k).min <= part.min() and part.max() <= np.iinfo(k).max)
                    width.append(kind().itemsize)
                    stored.append(part.astype(kind).tobytes())
                run_ = np.concatenate([[0], np.cumsum(steps)])
                columns = [b.column("doc_id").slice(i, j - i), pa.array(np.diff(off)), pa.array(np.diff(at)), pa.array(run_[at[1:]] - run_[at[:-1]]), pa.array(width, pa.int32()), pa.array(stored, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return text_rows(docs, id_col, text_col).mapInArrow(run, FORMAT)


def _counts(row: dict) -> np.ndarray:
    """The token count of each prefix of one stored text, from the empty one on."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(row["steps"], f"<i{row['width']}"), dtype=np.int64)])


def count_at(index_rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, n_chars, tokens) for rows (doc_id, n_chars) of ``asked``: exact tokens of each prefix of so many code points.

    A prefix longer than its text is the whole text; ids that are null or not
    stored give no row. Stored rows of one id that differ answer one each.
    """
    ship(index_rows.sparkSession)

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                at, counts = np.clip(np.array(row["asked"], np.int64), 0, row["n_chars"]), _counts(row)
                yield pa.RecordBatch.from_arrays([pa.array([row["doc_id"]] * len(at), pa.int64()), pa.array(row["asked"], pa.int64()), pa.array(counts[at])], names=["doc_id", "n_chars", "tokens"])

    want = asked.groupBy("doc_id").agg(F.collect_set(F.col("n_chars").cast("long")).alias("asked"))
    return index_rows.join(want, "doc_id").select("doc_id", "n_chars", "width", "steps", "asked").mapInArrow(run, "doc_id long, n_chars long, tokens long")


def truncate(index_rows: DataFrame, budget: int) -> DataFrame:
    """The index without its steps, and ``fit_chars`` and ``fit_tokens``: the longest prefix, in code points, of at most ``budget`` tokens, and its tokens."""
    ship(index_rows.sparkSession)
    names = ["doc_id", "n_bytes", "n_chars", "n_tokens", "fit_chars", "fit_tokens"]

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            fit = []
            for row in rows:
                if row["n_tokens"] <= budget:
                    fit.append((row["n_chars"], row["n_tokens"]))
                else:
                    counts = _counts(row)
                    k = int(np.flatnonzero(counts <= max(budget, 0))[-1])
                    fit.append((k, int(counts[k])))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:4]), *(pa.array([f[k] for f in fit], pa.int64()) for k in (0, 1))], names=names)

    # A text within the budget is its own longest prefix, so its steps needn't be read from the rows.
    rows = index_rows.withColumn("steps", F.when(F.col("n_tokens") > budget, F.col("steps")))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))
