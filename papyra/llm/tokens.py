"""Token ids on disk as wavelet matrices.

A token data set is a Parquet folder with a file per shard and a row per block
of whole documents. A row holds the documents' ids and lengths and the block's
wavelet matrix: the sorted ids in use, a bit plane for each bit of an id's
place among them, and counts of ones before every 512 bits. That is enough to
read a token, count one, or find its k-th occurrence without decoding the rest.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.llm import bytesops as B
from papyra.llm.common import ship, text_rows

FORMAT = "shard int, block int, n_docs int, n_tokens long, doc_ids binary, doc_lens binary, doc_null binary, alphabet binary, zeros binary, planes binary, ranks binary"
_SUPER = 512


class WaveletMatrix:
    """Rank, select and access over a sequence of token ids."""

    def __init__(self, n: int, alphabet: np.ndarray, zeros: np.ndarray, planes: np.ndarray, ranks: np.ndarray):
        self.n, self.alphabet, self.zeros, self.planes, self.ranks = n, alphabet, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        used = np.zeros(int(ids.max()) + 1 if n else 1, bool)
        used[ids] = True
        alphabet = np.flatnonzero(used).astype("<u4")
        place = np.zeros(len(used), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        place[alphabet] = np.arange(len(alphabet))
        code = place[ids]
        levels = max(1, int(max(0, len(alphabet) - 1)).bit_length())
        width = -(-n // _SUPER) * _SUPER // 8
        planes, zeros = np.zeros((levels, width), np.uint8), np.zeros(levels, "<i8")
        for k in range(levels):
            bit = (code >> (levels - 1 - k)) & 1 != 0
            packed = np.packbits(bit, bitorder="little")
            planes[k, : len(packed)] = packed
            low = code[~bit]
            zeros[k] = len(low)
            code = np.concatenate([low, code[bit]])
        ones = np.bitwise_count(planes.view("<u8")).reshape(levels, -1, _SUPER // 64).sum(2) if width else np.zeros((levels, 0), np.int64)
        ranks = np.zeros((levels, ones.shape[1] + 1), "<u4")
        np.cumsum(ones, axis=1, out=ranks[:, 1:])
        return cls(n, alphabet, zeros, planes, ranks)

    def parts(self) -> list[bytes]:
        return [self.alphabet.tobytes(), self.zeros.tobytes(), self.planes.tobytes(), self.ranks.tobytes()]

    @classmethod
    def from_parts(cls, n: int, alphabet: bytes, zeros: bytes, planes: bytes, ranks: bytes) -> WaveletMatrix:
        z = np.frombuffer(zeros, "<i8")
        return cls(n, np.frombuffer(alphabet, "<u4"), z, np.frombuffer(planes, np.uint8).reshape(len(z), -1), np.frombuffer(ranks, "<u4").reshape(len(z), -1))

    def decode(self) -> np.ndarray:
        """All ids: each level's split is undone, the last first."""
        code = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        levels = len(self.zeros)
        for k in range(levels - 1, -1, -1):
            bit = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            up = np.empty_like(code)
            up[~bit] = code[: self.zeros[k]]
            up[bit] = code[self.zeros[k] :] | code.dtype.type(1 << (levels - 1 - k))
            code = up
        return self.alphabet[code] if self.n else np.zeros(0, "<u4")

    def _ones(self, k: int, i: int) -> int:
        """Ones before place i of level k."""
        block, rest = divmod(i, _SUPER)
        total = int(self.ranks[k, block])
        if rest:
            raw = self.planes[k, block * _SUPER // 8 : block * _SUPER // 8 + -(-rest // 8)].copy()
            if rest % 8:
                raw[-1] &= (1 << rest % 8) - 1
            total += int(np.bitwise_count(raw).sum())
        return total

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for k in range(len(self.zeros)):
            before = self._ones(k, i)
            bit = self._ones(k, i + 1) - before
            code = code << 1 | bit
            i = int(self.zeros[k]) + before if bit else i - before
        return int(self.alphabet[code])

    def _code(self, token: int) -> int | None:
        c = int(np.searchsorted(self.alphabet, token))
        return c if c < len(self.alphabet) and self.alphabet[c] == token else None

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token before place i."""
        c = self._code(token)
        if c is None:
            return 0
        lo, hi = 0, min(i, self.n)
        for k in range(len(self.zeros)):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (int(self.zeros[k]) + a, int(self.zeros[k]) + b) if c >> (len(self.zeros) - 1 - k) & 1 else (lo - a, hi - b)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _find(self, k: int, bit: int, nth: int) -> int:
        """Place of the nth (from 0) such bit of level k."""
        before = self.ranks[k].astype(np.int64) if bit else np.arange(self.ranks.shape[1]) * _SUPER - self.ranks[k]
        block = int(np.searchsorted(before, nth, "right")) - 1
        bits = np.unpackbits(self.planes[k, block * _SUPER // 8 : (block + 1) * _SUPER // 8], bitorder="little")
        return block * _SUPER + int(np.flatnonzero(bits == bit)[nth - int(before[block])])

    def select(self, token: int, nth: int) -> int:
        """Place of the nth (from 0) occurrence of a token."""
        if not 0 <= nth < self.count(token):
            raise IndexError(nth)
        c, lo, levels = self._code(token), 0, len(self.zeros)
        for k in range(levels):
            a = self._ones(k, lo)
            lo = int(self.zeros[k]) + a if c >> (levels - 1 - k) & 1 else lo - a
        i = lo + nth
        for k in range(levels - 1, -1, -1):
            bit = c >> (levels - 1 - k) & 1
            i = self._find(k, bit, i - int(self.zeros[k]) if bit else i)
        return i


# Fixed value: the pre-tokenizer's pattern under which a text may be encoded unit by unit.
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_LETTER = B._table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
_BREAK = B._table(lambda b: b < 0x80 and not (0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)) & B.SPACED
_SLOTS = 1 << 21


class Encoder:
    """Ids of whole texts, equal to those of the tokenizer itself.

    Where the tokenizer drops white space and splits by the pattern above, no
    token crosses white space or the place after an ASCII letter before another
    ASCII character. Texts are cut there, and units met before are looked up
    by hash; A-Z count as a-z. A text with a part like a special token's
    string, and any text under another tokenizer, is encoded whole.
    ``cached`` bounds the units remembered.
    """

    def __init__(self, spec: str, cached: int = 1_500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.cached = Tokenizer.from_str(spec), cached
        j = json.loads(spec)
        pre = (j.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        norm = [x.get("type") for x in (j.get("normalizer") or {}).get("normalizers", [])]
        self.by_unit = pre.get("pattern", {}).get("Regex") == _PATTERN and norm == ["NFC", "Replace", "Lowercase"] and all(x["content"].startswith("<|") for x in j["added_tokens"])
        if self.by_unit:
            j["normalizer"] = None
            j["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, j["pre_tokenizer"]["pretokenizers"][1]]}
            self.plain = Tokenizer.from_str(json.dumps(j))
            closing = j["model"]["end_of_word_suffix"]
            vocab = self.plain.get_vocab()
            self.closes = np.zeros(max(vocab.values()) + 1, bool)
            self.closes[[i for w, i in vocab.items() if w.endswith(closing)]] = True
        self.reset()

    def _encode_units(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each unit. A word of Latin letters is one word to the tokenizer whatever stands beside it: such words go many to a call, normalised here, and each ends at its closing token."""
        out: list = [None] * len(texts)
        simple, odd, words = [], [], []
        for k, t in enumerate(texts):
            if t.isalpha() and (t.isascii() or max(t) < "\u0250"):
                word = t if t.isascii() else unicodedata.normalize("NFC", t).lower()
                if word.isalpha():
                    simple.append(k)
                    words.append(word)
                    continue
            odd.append(k)
        size = 512
        runs = [" ".join(words[i : i + size]) for i in range(0, len(words), size)]
        for i, e in enumerate(self.plain.encode_batch_fast(runs, add_special_tokens=False) if runs else []):
            part, ids = simple[i * size : (i + 1) * size], np.array(e.ids, np.uint32)
            ends = [0, *(np.flatnonzero(self.closes[ids]) + 1).tolist()]
            if len(ends) != len(part) + 1:
                odd += part
                continue
            for k, x, y in zip(part, ends[:-1], ends[1:], strict=True):
                out[k] = ids[x:y]
        for k, e in zip(odd, self.tokenizer.encode_batch_fast([texts[k] for k in odd], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, np.uint32)
        return out

    def reset(self) -> None:
        self.keys, self.offset, self.length = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.n, self.used = np.zeros(1 << 18, np.uint32), 1, 0
        self.first, self.second = np.zeros(_SLOTS, np.int32), np.zeros(_SLOTS, np.int32)
        self.sorted_keys, self.sorted_at = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _grow(self, units: int, tokens: int) -> None:
        while self.n + units > len(self.keys):
            self.keys, self.offset, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.keys, self.offset, self.length))
        while self.used + tokens > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])

    def _put(self, keys: np.ndarray, texts: list[str]) -> None:
        ids = self._encode_units(texts)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self._grow(len(ids), int(size.sum()))
        at = np.arange(self.n, self.n + len(ids))
        self.pool[self.used : self.used + int(size.sum())] = np.concatenate(ids)
        self.keys[at], self.length[at], self.offset[at] = keys, size, self.used + np.cumsum(size) - size
        self.first[(keys & B.U(_SLOTS - 1)).astype(np.int64)] = at
        self.second[(keys >> B.U(40) & B.U(_SLOTS - 1)).astype(np.int64)] = at
        to = np.searchsorted(self.sorted_keys, keys)
        self.sorted_keys, self.sorted_at = np.insert(self.sorted_keys, to, keys), np.insert(self.sorted_at, to, at)
        self.n += len(ids)
        self.used += int(size.sum())

    def _known(self, keys: np.ndarray) -> np.ndarray:
        """Units' places, 0 where a key is new."""
        if not len(self.sorted_keys):
            return np.zeros(len(keys), np.int64)
        to = np.minimum(np.searchsorted(self.sorted_keys, keys), len(self.sorted_keys) - 1)
        return np.where(self.sorted_keys[to] == keys, self.sorted_at[to], 0)

    def _lookup(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        lower = B.LOWER[data]
        h = B.range_hashes(lower, start, end)
        at = self.first[(h & B.U(_SLOTS - 1)).astype(np.int64)]
        miss = np.flatnonzero(self.keys[at] != h)
        at[miss] = self.second[(h[miss] >> B.U(40) & B.U(_SLOTS - 1)).astype(np.int64)]
        miss = miss[self.keys[at[miss]] != h[miss]]
        if len(miss):
            keys, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
            new = np.flatnonzero(self._known(keys) == 0)
            if len(new):
                u = miss[where[new]]
                self._put(keys[new], [lower[s:e].tobytes().decode() for s, e in zip(start[u].tolist(), end[u].tolist(), strict=True)])
            at[miss] = self._known(keys)[back]
        return at

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end_id``, and how many each has."""
        n = len(offsets) - 1
        raw = data.tobytes()
        whole = [d for d in range(n) if not self.by_unit or raw.find(b"<|", offsets[d], offsets[d + 1]) >= 0] if not self.by_unit or b"<|" in raw else []
        if whole:
            return self._by_text(raw, offsets, end_id, set(whole))
        return self._by_unit(data, offsets, end_id)

    def _by_text(self, raw: bytes, offsets: np.ndarray, end_id: int, whole: set[int]) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for d in range(len(offsets) - 1):
            part = raw[offsets[d] : offsets[d + 1]]
            if d in whole:
                out.append(np.array([*self.tokenizer.encode(part.decode(), add_special_tokens=False).ids, end_id], np.uint32))
            else:
                out.append(self._by_unit(np.frombuffer(part, np.uint8), np.array([0, len(part)]), end_id)[0])
        return np.concatenate(out), np.array([len(x) for x in out])

    def _by_unit(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        if self.n > self.cached:
            self.reset()
        inside, letter = B.SPACED[data], _LETTER[data]
        fresh = np.zeros(len(data) + 1, bool)
        fresh[0] = True
        fresh[1:] = ~inside | letter & np.append(_BREAK[data[1:]], False)
        fresh[offsets] = True
        start = np.flatnonzero(inside & fresh[:-1])
        stop = np.zeros(len(data) + 1, bool)
        stop[:-1] = fresh[:-1] | ~inside
        stop[-1] = True
        end = np.flatnonzero(inside & stop[1:]) + 1
        first = np.searchsorted(start, offsets)
        at = self._lookup(data, start, end)
        self.length[0] = 1
        at = np.insert(at, first[1:], 0)
        size = self.length[at]
        total = np.cumsum(size)
        take = np.repeat(self.offset[at] - total + size, size) + np.arange(int(total[-1]) if len(total) else 0)
        ids = self.pool[take]
        last = total[at == 0] - 1
        ids[last] = end_id
        return ids, np.diff(np.concatenate([[0], last + 1]))


_encoders: dict[int, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """This worker's encoder for a tokenizer; it lives as long as the worker."""
    key = zlib.crc32(spec.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 1 << 19) -> None:
    """Encode every text and write the token data set, in ascending order of (id, text hash).

    A null text counts as empty; an empty text has the end id alone. Rows with
    a null id come first; equal ids are ordered by the hash of their text. A
    block ends with the document that fills it, so a document is in one block.
    An empty table gives a folder without rows.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    rows = text_rows(docs, id_col, text_col).withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")

    def run(batches):
        enc, shard, block = encoder(spec.value), TaskContext.get().partitionId(), 0
        held, n = [], 0

        def flush():
            ids, lens, tokens = (np.concatenate([h[k] for h in held]) for k in (0, 2, 3))
            null = np.packbits(np.concatenate([h[1] for h in held]))
            w = WaveletMatrix.build(tokens)
            values = [shard, block, len(ids), len(tokens), ids.astype("<i8").tobytes(), lens.astype("<i8").tobytes(), null.tobytes(), *w.parts()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for b in batches:
            data, offsets = B.utf8(b.column("text"))
            col = b.column("doc_id")
            ids, null = col.fill_null(0).to_numpy(zero_copy_only=False), col.is_null().to_numpy(zero_copy_only=False)
            for i, j, piece, off in B.pieces(data, offsets, B.BLOCK):
                tokens, lens = enc.encode(piece, off, end_id)
                held.append((ids[i:j], null[i:j], lens, tokens))
                n += len(tokens)
                if n >= block_tokens:
                    yield flush()
                    held, n, block = [], 0, block + 1
        if held:
            yield flush()

    names = [c.split()[0] for c in FORMAT.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in FORMAT.split(", ")]
    rows.mapInArrow(run, FORMAT).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a token data set; one of an empty table has none."""
    return spark.read.schema(FORMAT).parquet(path)


def _matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix.from_parts(row["n_tokens"], row["alphabet"], row["zeros"], row["planes"], row["ranks"])


def starts(blocks: DataFrame) -> DataFrame:
    """(shard, block, first): the place of each block's first id among all. Orders blocks within a shard, and shards by their totals."""
    sizes = blocks.select("shard", "block", "n_tokens")
    per = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = per.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    own = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_tokens")
    return sizes.withColumn("own", own).join(before, "shard").select("shard", "block", (F.col("own") + F.col("before")).alias("first"))


def documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the decoded blocks. Null ids stay null, equal ids keep a row each."""
    ship(blocks.sparkSession)

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                lens = np.frombuffer(row["doc_lens"], "<i8")
                raw = memoryview(_matrix(row).decode().astype("<u4").tobytes())
                at = np.concatenate([[0], np.cumsum(lens)])
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                null = np.unpackbits(np.frombuffer(row["doc_null"], np.uint8), count=len(lens)).astype(bool)
                ids = pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=null)
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(lens), pa.int32()), pa.array([row["block"]] * len(lens), pa.int32()), ids, pa.array(at[:-1]), pa.array(lens), pa.array(crc, pa.int64())], names=["shard", "block", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = blocks.mapInArrow(run, "shard int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(starts(blocks), ["shard", "block"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def occurrences(blocks: DataFrame, token: int) -> DataFrame:
    """(position) of every place where the token stands, by select on each block that has it; none for a token that doesn't occur."""
    ship(blocks.sparkSession)

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                w = _matrix(row)
                at = [w.select(token, k) for k in range(w.count(token))]
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(at), pa.int32()), pa.array([row["block"]] * len(at), pa.int32()), pa.array(at, pa.int64())], names=["shard", "block", "at"])

    found = blocks.mapInArrow(run, "shard int, block int, at long")
    return found.join(starts(blocks), ["shard", "block"]).select((F.col("first") + F.col("at")).alias("position"))
