"""PDF files made from rows of placed text."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.shipping import ship


def build(pages: list[list[tuple[float, float, str]]], packed: bool = True) -> bytes:
    """A file with the given pieces of text (x, y, text) on its pages; ``packed`` compresses streams and keeps objects in an object stream."""
    letters = sorted({c for page in pages for c in set().union(*(t for _, _, t in page))})
    points = np.array([ord(c) for c in letters], "<u4")
    objects: dict[int, bytes] = {}

    def coded(page: list[tuple[float, float, str]]):
        """The page's texts in hex, coded all at once."""
        text = "".join(t for _, _, t in page)
        of = np.searchsorted(points, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")) + 1
        shown, at = of.astype(">u2").tobytes().hex().upper(), 0
        for _, _, t in page:
            yield shown[at : at + 4 * len(t)]
            at += 4 * len(t)

    def stream(head: str, body: bytes) -> bytes:
        body, more = (zlib.compress(body, 1), "/Filter /FlateDecode ") if packed else (body, "")
        return f"<< {head} {more}/Length {len(body)} >>\nstream\n".encode() + body + b"\nendstream"

    maps = [f"<{k:04X}> <{c.encode('utf-16-be').hex()}>" for k, c in enumerate(letters, 1)]
    blocks = "\n".join(f"{len(maps[k : k + 100])} beginbfchar\n" + "\n".join(maps[k : k + 100]) + "\nendbfchar" for k in range(0, len(maps), 100))
    first = 7
    kids = " ".join(f"{first + 2 * k} 0 R" for k in range(len(pages)))
    objects[1] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[2] = f"<< /Type /Pages /Count {len(pages)} /Kids [{kids}] /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> >>".encode()
    objects[3] = b"<< /Type /Font /Subtype /Type0 /BaseFont /Plain /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>"
    objects[4] = b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Plain /DW 500 /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> >>"
    objects[5] = stream("", f"1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n{blocks}".encode())
    for k, page in enumerate(pages):
        shown = "\n".join(f"1 0 0 1 {x:g} {y:g} Tm <{code}> Tj" for (x, y, _), code in zip(page, coded(page), strict=True))
        objects[first + 2 * k] = f"<< /Type /Page /Parent 2 0 R /Contents {first + 2 * k + 1} 0 R >>".encode()
        objects[first + 2 * k + 1] = stream("", f"BT /F1 10 Tf\n{shown}\nET".encode())
    if packed:  # plain objects go into one stream
        plain = [n for n in objects if b"stream\n" not in objects[n]]
        head, body = [], b""
        for n in plain:
            head.append(f"{n} {len(body)}")
            body += objects.pop(n) + b"\n"
        index = " ".join(head).encode() + b"\n"
        objects[6] = stream(f"/Type /ObjStm /N {len(plain)} /First {len(index)}", index + body)
    out, at = b"%PDF-1.5\n", {}
    for n in sorted(objects):
        at[n] = len(out)
        out += f"{n} 0 obj\n".encode() + objects[n] + b"\nendobj\n"
    last = first + 2 * len(pages)
    if packed:
        rows = b"".join(bytes([1]) + at[n].to_bytes(4, "big") + bytes(1) if n in at else bytes(6) for n in range(last))
        return out + f"{last} 0 obj\n".encode() + stream(f"/Type /XRef /Root 1 0 R /Size {last} /W [1 4 1]", rows) + f"\nendobj\nstartxref\n{len(out)}\n%%EOF\n".encode()
    table = "".join(f"{at.get(n, 0):010d} 00000 {'n' if n in at else 'f'} \n" for n in range(last))
    return out + f"xref\n0 {last}\n{table}trailer\n<< /Root 1 0 R /Size {last} >>\nstartxref\n{len(out)}\n%%EOF\n".encode()


#: Finished files are handed on once they have so many bytes together.
FLUSH = 4 << 20


def render(placed: DataFrame, packed: bool = True) -> DataFrame:
    """(path, content): a file per path from rows (path, page, x, y, str), pages from 1; pages without rows are empty.

    Pages come in order, one row each, and a task holds one file at a time, however many files it makes.
    """
    ship(placed.sparkSession)
    pages = placed.groupBy("path", "page").agg(F.array_sort(F.collect_list(F.struct(F.negate("y").alias("down"), "x", "str"))).alias("rows"))

    def run(batches):
        path, own, done, size = None, [], [], 0
        for b in batches:
            rows = b.column("rows")
            ends, cells = rows.offsets.to_numpy(), rows.values
            for k, (file, page) in enumerate(zip(b.column("path").to_pylist(), b.column("page").to_pylist(), strict=True)):
                if file != path or not own:
                    if own:
                        done.append((path, build(own, packed)))
                        size += len(done[-1][1])
                    path, own = file, []
                if size > FLUSH:
                    yield _files(done)
                    done, size = [], 0
                part = cells.slice(ends[k], ends[k + 1] - ends[k])
                down, x, text = (part.field(c).to_pylist() for c in ("down", "x", "str"))
                own += [[] for _ in range(page - 1 - len(own))]
                own.append([(right, -d, t) for right, d, t in zip(x, down, text, strict=True)])
        if own:
            done.append((path, build(own, packed)))
        if done:
            yield _files(done)

    return pages.repartition("path").sortWithinPartitions("path", "page").mapInArrow(run, "path string, content binary")


def _files(done: list[tuple[str, bytes]]) -> pa.RecordBatch:
    return pa.record_batch({"path": pa.array([p for p, _ in done], pa.string()), "content": pa.array([c for _, c in done], pa.binary())})
