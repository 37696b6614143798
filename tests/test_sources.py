import json
import zipfile

import pytest
from pyspark.sql import functions as F

from wane.operators.verification import empty_cache
from wane.plans import study
from wane.schemas import MANIFEST
from wane.sinks.writers import write_lines, write_text
from wane.sources import records, trees
from wane.sources.diagnostics import from_mypy, from_pyright
from wane.streaming.verdicts import verify_stream


def test_tree_scan(spark, tmp_path):
    root = tmp_path / "numpy-1.0" / "numpy"
    (root / "core").mkdir(parents=True)
    (root / "empty").mkdir()
    (root / "__init__.py").write_text("x = 1\n")
    (root / "core" / "a.py").write_bytes(b'def product():\n    """deprecated \xff"""\n')
    (root / "core" / "b.txt").write_text("no")
    files = trees.scan_tree(spark, str(root), "numpy")
    assert sorted(r.prefix for r in files.collect()) == ["numpy", "numpy.core.a"]
    assert [r.error for r in trees.coverage_gaps(files).collect()] == ["undecodable bytes"]
    catalog = study.build_catalog(spark, str(tmp_path), str(tmp_path / "catalog"), {"numpy": ["numpy-1.0"]})
    assert [r.qualified_name for r in catalog.collect()] == ["numpy.core.a.product"]
    with pytest.raises(Exception):
        trees.scan_file(spark, str(root / "missing.py")).collect()
    with zipfile.ZipFile(tmp_path / "w.whl", "w") as z:
        z.writestr("numpy/core/c.py", "y = 2\n")
        z.writestr("numpy/core/d.so", "binary")
    got = trees.from_archives(spark, str(tmp_path / "w.whl"), "numpy").collect()
    assert [(r.prefix, r.source) for r in got] == [("numpy.core.c", "y = 2\n")]


def test_records(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([
        {"function": "f()", "category": "outdated", "deprecated api": "numpy.product", "alias dict": {"p": "numpy.product"}},
        {"function": "g()", "deprecated api": ["a", "b"], "source": "x"}]))
    rows = records.read_corpus(spark, str(tmp_path / "s.json"), "numpy").orderBy("sample_idx").collect()
    assert [(r.sample_id, r.deprecated_api, r.category) for r in rows] == [("numpy_0", ["numpy.product"], "outdated"), ("numpy_1", ["a", "b"], "unknown")]
    assert rows[0].alias_dict == {"p": "numpy.product"}
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert records.read_lines(spark, str(tmp_path / "l.jsonl"), "a int").count() == 2
    assert records.read_lines(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    write_lines(spark.range(10), str(tmp_path / "out"), ["id"])
    write_text(spark.createDataFrame([(2, "b"), (1, "a")], "i int, line string"), str(tmp_path / "md"), ["i"], ["# head"])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "md")).collect()) == ["# head", "a", "b"]


@pytest.mark.parametrize("size", [1, 3, 7, 64, 8_000_000])
def test_one_array_is_read_by_many_tasks(spark, tmp_path, size):
    from wane.sources.arrays import array_records

    odd = ['"', "\\", '\\"', "{", "}]", "[[", "é{\n", '\\\\"', ""]
    rows = [{"k": i, "text": odd[i % 9] + odd[i % 7] * 2, "deep": {"a": [{"b": [odd[i % 5]]}, []]}} for i in range(12)]
    (tmp_path / "a.json").write_text(" [" + ",\n ".join(json.dumps(r, ensure_ascii=i % 2 == 0) for i, r in enumerate(rows)) + "]\n")
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "c.json").write_text('[{"k": 1}]')
    got = array_records(spark, str(tmp_path / "*.json"), size)
    found = sorted((r.path[-6:], r.position, json.dumps(json.loads(r.value))) for r in got.collect())
    assert found == [("a.json", i, json.dumps(r)) for i, r in enumerate(rows)] + [("c.json", 0, '{"k": 1}')]
    if size == 64:
        assert got.select(F.spark_partition_id()).distinct().count() > 1


def test_an_array_that_breaks_off_is_an_error(spark, tmp_path):
    from wane.sources.arrays import array_records

    (tmp_path / "a.json").write_text('[{"k": 1}, {"k": ')
    with pytest.raises(Exception, match="ends within a record"):
        array_records(spark, str(tmp_path / "a.json"), 4).collect()


def test_one_archive_is_read_by_many_tasks(spark, tmp_path):
    import io
    import tarfile

    with zipfile.ZipFile(tmp_path / "w.whl", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(60):
            z.writestr(f"lib/p{i % 4}/m{i}.py", f"x = {i}\n")
            z.writestr(f"lib/p{i % 4}/m{i}.so", "binary")
    with tarfile.open(tmp_path / "s.tar.gz", "w:gz") as t:
        for i in range(5):
            data = f"y = {i}\n".encode()
            info = tarfile.TarInfo(f"lib-1.0/lib/t{i}.py")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    got = trees.from_archives(spark, str(tmp_path / "*.*"), "lib")
    rows = {r.prefix: r.source for r in got.collect()}
    assert rows == {f"lib.p{i % 4}.m{i}": f"x = {i}\n" for i in range(60)} | {f"lib.t{i}": f"y = {i}\n" for i in range(5)}
    assert got.where("source like 'x%'").select(F.spark_partition_id()).distinct().count() > 1


def test_one_root_is_listed_by_many_tasks(spark, tmp_path):
    for i in range(30):
        folder = tmp_path / "lib" / f"p{i % 10}" / f"q{i % 3}" / "deep"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"m{i}.py").write_text("")
        (folder.parent.parent / f"_n{i}.py").write_text("")
    roots = spark.createDataFrame([(str(tmp_path / "lib"),)], "root string")
    listed = trees.list_files(roots)
    assert listed.count() == 60 and listed.where("below like '%deep%'").select(F.spark_partition_id()).distinct().count() > 1
    assert {r.below for r in listed.collect()} == {str(p.relative_to(tmp_path / "lib")) for p in (tmp_path / "lib").rglob("*.py")}
    assert trees.list_files(roots, enough=5).count() == 60


def test_diagnostics(spark):
    lines = ["m.py:3: error: function m.old is deprecated: use new  [deprecated]", "m.py:3: note: m.old is deprecated [deprecated]", "m.py:4: error: bad [misc]"]
    df = spark.createDataFrame([("r", "m", i, t) for i, t in enumerate(lines)], "source string, module string, ord long, value string")
    r, = from_mypy(df, F.lit("pkg")).collect()
    assert (r.qualified_name, r.line, r.message, r.raw_evidence) == ("pkg.old", 3, "use new", "mypy [deprecated]: pkg.old is deprecated (use new)")
    out = {"generalDiagnostics": [
        {"rule": "reportDeprecated", "message": 'The method "x" in class "K" is deprecated\n  use y', "range": {"start": {"line": 4}}},
        {"rule": "reportDeprecated", "message": "strange", "range": {"start": {"line": 0}}}, {"rule": "other", "message": "z"}]}
    rows = from_pyright(spark.createDataFrame([("a.py", "", 1, json.dumps(out))], "source string, module string, ord long, value string")).orderBy("line").collect()
    assert [(r.qualified_name, r.line, r.message) for r in rows] == [("deprecated_symbol", 1, "strange"), ("K.x", 5, "use y")]


def test_verdict_stream(spark, tmp_path):
    arrivals = tmp_path / "in"
    arrivals.mkdir()
    names = [c.split()[0] for c in MANIFEST.split(", ")]
    one = {**dict.fromkeys(names), "candidate_id": "c1", "sample_id": "s", "library": "pandas", "mode": "inference", "target_api": "t",
           "call_site_snippet": "pdf.pad()", "enclosing_code": "x", "client_line": 1}
    args = [str(tmp_path / p) for p in ("out", "cache", "chk")]
    for i in (1, 2):
        (arrivals / f"{i}.json").write_text(json.dumps({**one, "candidate_id": f"c{i}"}) + "\n")
        q = verify_stream(spark, str(arrivals), *args)
        assert q.awaitTermination(60)
    rows = {r.candidate_id: (r.cached, r.is_deprecated_usage) for r in spark.read.json(args[0]).collect()}
    assert rows == {"c1": (False, True), "c2": (True, True)}
    assert empty_cache(spark).count() == 0


def test_text_keeps_its_head_first_and_its_order(spark, tmp_path):
    from wane.sinks.writers import write_text

    rows = spark.range(500).selectExpr("id as n", "concat('row ', id) as line").repartition(7)
    write_text(rows, str(tmp_path / "t"), ["n"], ["# head", "second"])
    lines = [line for f in sorted((tmp_path / "t").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines == ["# head", "second", *(f"row {i}" for i in range(500))]


def test_last_row_per_key_with_maps(spark):
    from pyspark.sql import functions as F

    from wane.operators.ranking import first_per_key, latest_per_key

    rows = spark.createDataFrame([("a", 1, {"x": 1}), ("a", 2, {"y": 2}), ("b", 1, None)], "k string, n int, m map<string,int>")
    assert {(r.k, r.n) for r in latest_per_key(rows, ["k"], [F.col("n")]).collect()} == {("a", 2), ("b", 1)}
    assert {(r.k, r.n) for r in first_per_key(rows, ["k"], [F.col("n")]).collect()} == {("a", 1), ("b", 1)}


def test_reports_caches_and_arrays_read_back(spark, tmp_path):
    import json

    import pytest

    from wane.operators.verification import empty_cache
    from wane.sinks.writers import write_cache, write_report
    from wane.sources.records import read_array, status_of

    write_report(spark.createDataFrame([(3, [1, 2])], "n int, xs array<int>"), str(tmp_path / "report"))
    (line,) = [x for f in (tmp_path / "report").glob("part-*") for x in f.read_text().splitlines()]
    assert json.loads(line) == {"n": 3, "xs": [1, 2]}
    write_cache(empty_cache(spark), str(tmp_path / "cache"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        write_cache(empty_cache(spark), str(tmp_path / "cache"))
    (tmp_path / "a.json").write_text('[{"x": 1},\n {"x": 2}]')
    assert sorted(r.x for r in read_array(spark, str(tmp_path / "a.json"), "x int").collect()) == [1, 2]
    (tmp_path / "empty.jsonl").write_text("")
    rows = status_of(spark, {"empty": str(tmp_path / "empty.jsonl"), "none": str(tmp_path / "none.jsonl")}, "x int").collect()
    assert {(r.input, r.n, r.present) for r in rows} == {("empty", 0, True), ("none", 0, False)}
