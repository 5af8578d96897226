import glob
import json

from papyra.functions import text as T
from papyra.operators import audit as A
from papyra.sources import files


def test_csv_bytes(spark, tmp_path):
    rows = [("a,b", None, " x "), ('q"q', "", "line\nend"), ("plain", "#", "cr\rhere")]
    df = spark.createDataFrame(rows, "y string, x string, z string").coalesce(1)
    files.write_csv(df, str(tmp_path / "c"), ["z", "y", "x"])
    (name,) = glob.glob(str(tmp_path / "c" / "part-*"))
    want = '\ufeffz,y,x\r\n x ,"a,b",\r\n"line\nend","q""q",\r\n"cr\rhere",plain,#\r\n'
    assert open(name, "rb").read().decode() == want
    got = files.read_csv(spark, str(tmp_path / "c"))
    assert got.columns == ["z", "y", "x"] and got.count() == 3
    assert files.count_rows(spark, str(tmp_path / "c")) == 3 and files.count_rows(spark, str(tmp_path / "none")) == 0


def test_json(spark, tmp_path):
    assert files.read_optional_json(spark, str(tmp_path / "none.json")) is None
    files.write_report(spark, {"b": {"x": [1]}, "a": "\uac00"}, str(tmp_path / "r"))
    (name,) = glob.glob(str(tmp_path / "r" / "*.txt"))
    assert open(name, encoding="utf-8").read().rstrip("\n") == json.dumps({"b": {"x": [1]}, "a": "\uac00"}, ensure_ascii=False, indent=2)
    assert files.read_optional_json(spark, name).first()["a"] == "\uac00"
    files.write_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "l"))
    assert files.read_jsonl(spark, str(tmp_path / "l"), "a int, b string").collect() == [(1, None)]


def test_seed(spark, tmp_path):
    (tmp_path / "s.csv").write_text("k,n\na,1\nb,\n")
    assert sorted(files.read_seed(spark, str(tmp_path / "s.csv"), "k string, n int").collect()) == [("a", 1), ("b", None)]


def test_audit(spark):
    docs = spark.createDataFrame([(1, 4), (2, 2), (3, None)], "doc_id long, total_pages long")
    chunks = spark.createDataFrame([(1, 1, "t", "risk", None), (1, 2, "t", "fees", 5), (2, 1, "t", "risk", None), (2, 1, " ", "risk", None), (None, 1, "u", "risk", None)], "source_doc_id long, source_page int, source_text string, section string, issue_id long")
    facts = A.chunk_facts(docs, chunks, ["risk", "fees"])
    got = {r.metric: r.value for r in facts.collect()}
    assert got == {"documents_total": 3, "pages_total": 6, "chunks_total": 5, "empty_chunks": 1, "missing_provenance_chunks": 2, "source_issue_chunks": 1, "pages_selected": 3, "within_document_duplicate_hash_groups": 1, "cross_document_duplicate_hash_groups": 1, "documents_chunked": 2, "documents_without_chunks": 1, "documents_missing_core_sections": 1}
    bad = {r.rule_id for r in A.audit_violations(spark, facts, {"documents": docs, "chunks": chunks, "issues": docs.limit(1)}).collect()}
    assert bad == {"V63", "V66", "V67", "V68", "V69", "V70"}
    assert [r.rule_id for r in A.audit_violations(spark, None, {}).collect()] == ["V61"]
    assert set(r.value for r in A.chunk_facts(docs.limit(0), chunks.limit(0), ["risk"]).collect()) == {0}


def test_files_counts_and_labels(spark):
    docs = spark.createDataFrame([("a.pdf",), ("b.pdf",), (None,)], "file string")
    there = spark.createDataFrame([("x/a.pdf",)], "path string")
    assert sorted(str(r.file) for r in A.missing_files(docs, "file", there).collect()) == ["None", "b.pdf"]
    want = spark.createDataFrame([("a.pdf", 1), ("c.pdf", 2)], "value string, expected long")
    assert sorted((str(r.value), r.n, r.expected) for r in A.unexpected_counts(docs, "file", want).collect()) == [("None", 1, 0), ("b.pdf", 1, 0), ("c.pdf", 0, 2)]
    words = spark.createDataFrame([("\ub098",), ("b",), ("\uac00",), ("A",), ("a",)], "w string")
    assert [r.w for r in words.orderBy(T.korean(words.w)).collect()] == ["\uac00", "\ub098", "a", "A", "b"]
    assert [r.segment for r in A.segments(spark.createDataFrame([(1, "x", None)], "k int, a string, b string"), "k", ["a", "b"], {"s": "x", "t": "y"}).collect()] == ["s"]
