"""Files, streams, sinks and the command line."""

import gzip
import io
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathloom import good_and_bad, read_documents, select, select_stream, stream_documents, strictly
from pathloom.cli import main
from pathloom.queries import source_large_array
from pathloom.sources.readers import SPLIT_CHARS, SPLIT_ROWS, _split, plain_quotes, split_documents
from pathloom.sources.sinks import on_rows, stream_values, write_values


def values(df, path="$.a"):
    return sorted(r[0] for r in select(df.select("document"), "document", path).select(F.to_json("value")).collect())


def test_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n\n  \n{"a": 2}\r\n{"a": \n')
    with gzip.open(tmp_path / "b.json.gz", "wt") as f:
        f.write('{"a": 3}\n')
    df = read_documents(spark, str(tmp_path))
    assert values(df) == ["1", "2", "3"]
    good, bad = good_and_bad(df)
    assert good.count() == 3 and [r["text"].strip() for r in bad.collect()] == ['{"a":']
    assert "unexpected end at position" in bad.collect()[0]["error"]
    with pytest.raises(Exception, match="no JSON: unexpected end at position"):
        strictly(df).count()
    assert strictly(good).count() == 3


def test_whole_and_root_array(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n{"a": 1},\n [{"a": 2}]\n]')
    (tmp_path / "b.json").write_text('{\n"a": 3\n}')
    assert values(read_documents(spark, str(tmp_path), "whole")) == ["1", "2", "3"]


def test_concatenated(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}{"a": "}{"}  [{"a": 3}]\n\n{"a":\n 4}{"a": ')
    df = read_documents(spark, str(tmp_path), "concatenated")
    assert values(df) == ['"}{"', "1", "3", "4"]
    assert good_and_bad(df)[1].count() == 1
    with pytest.raises(ValueError):
        read_documents(spark, str(tmp_path), "csv")


def test_split_documents():
    assert list(split_documents("")) == [] and list(split_documents(' , 5 "x{" true,null -1.5e3\n')) == []
    assert list(split_documents("this is not json")) == ["this is not json"]
    assert list(split_documents('{"a":1} garbage 5 {"a":2} ] {"a":3}, 7')) == ['{"a":1}', "garbage 5", '{"a":2}', "]", '{"a":3}']
    assert list(split_documents('{"a":1} "open')) == ['{"a":1}', '"open']
    assert list(split_documents("[" * 100_000 + "]" * 100_000)) == ["[" * 100_000 + "]" * 100_000]
    assert list(split_documents('{"a\\"}": 1}{}')) == ['{"a\\"}": 1}', "{}"]


def test_documents_of_a_file_leave_it_in_parts():
    """One file's documents are never held all at once."""
    for each, n in (('{"a": 1}', 3 * SPLIT_ROWS + 1), ('{"a": "' + "x" * (SPLIT_CHARS // 3) + '"}', 10)):
        parts = list(_split(iter([pd.DataFrame({"file": ["f", "g"], "text": [(each + " no ") * n, each]})])))
        assert all(len(p) <= SPLIT_ROWS and p["text"].str.len().sum() < 2 * SPLIT_CHARS for p in parts)
        found = [(f, t) for p in parts for f, t in zip(p["file"], p["text"], strict=True)]
        assert found == [("f", each), ("f", "no")] * n + [("g", each)]


def test_triple_quotes(spark, tmp_path):
    text = '{"t1": "", "t2": """raw "quoted"\n back\\slash \\n""", "t3": "\\"", "t4": "a \\" b"}'
    (tmp_path / "a.json").write_text(text)
    df = read_documents(spark, str(tmp_path), "whole", triple_quotes=True)
    (found,) = select(df.select("document"), "document", "$").select(F.to_json("value")).collect()[0]
    assert json.loads(found) == {"t1": "", "t2": 'raw "quoted"\n back\\slash \\n', "t3": '"', "t4": 'a " b'}
    plain = spark.createDataFrame([('{"a": "b"}',), (None,)], "t string").select(plain_quotes("t")).collect()
    assert plain[0][0] == '{"a": "b"}' and plain[1][0] is None


def test_sinks(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"a": {"b": 1}}\n{"a": "x"}')
    found = select(read_documents(spark, str(tmp_path / "in.json")).select("document"), "document", "$.a")
    write_values(found, str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ['"x"', '{"b":1}']
    seen = []
    on_rows(found, lambda r: seen.append((r["path"], r["value"])))
    assert sorted(seen) == [(["a"], '"x"'), (["a"], '{"b":1}')]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"x": {"a": 1}}\n{"a": [2, {"a": 3}]}\nnone\n')
    df = stream_documents(spark, str(tmp_path / "in")).select("document")
    found = select_stream(df, "document", "$..a")
    stream_values(found, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    (tmp_path / "in" / "2.json").write_text('{"a": 4}\n')
    stream_values(found, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(["1", "2", "3", '{"a":3}', "4"])
    with pytest.raises(ValueError):
        select_stream(df, "document", "$..a", strategy="recursive")
    with pytest.raises(ValueError):
        select(df, "document", "$..a", strategy="recursive")
    with pytest.raises(ValueError):
        select_stream(spark.range(1).select(F.lit("{}").alias("d")), "d", "$")


def test_stream_udtf(spark, tmp_path):
    (tmp_path / "in").mkdir()
    deep = '{"a": ' * 30 + "1" + "}" * 30
    (tmp_path / "in" / "1.json").write_text(deep)
    df = stream_documents(spark, str(tmp_path / "in")).select("text")
    found = select_stream(df, "text", "$..a", strategy="udtf")
    stream_values(found, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert spark.read.text(str(tmp_path / "out")).count() == 30


def test_command_line(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": {"b": 1}} {"a": 2}')
    out, err = io.StringIO(), io.StringIO()
    assert main(["$.a", str(tmp_path / "a.json")], out, err, spark) == 0
    assert sorted(out.getvalue().split()) == ["2", '{"b":1}']
    out = io.StringIO()
    assert main(["$.", "a", "{b}", str(tmp_path / "a.json")], out, err, spark) == 0
    assert out.getvalue().split() == ['{"b":1}']
    (tmp_path / "b.json").write_text('{"a": 1}{')
    assert main(["$", str(tmp_path / "b.json")], io.StringIO(), err, spark) == 1
    assert main(["$.{"], out, err, spark) == 2
    for text, found, code, said in (("this is not json", [], 1, 'unexpected "t" at position 0'), ('{"a": 1} garbage {"a": 2}', ["1", "2"], 1, 'unexpected "g"'), ('{"a": 1}\n[{"a": 2}] 5', ["1", "2"], 0, ""), ("", [], 0, "")):
        out, err = io.StringIO(), io.StringIO()
        assert main(["$.a"], out, err, spark, io.StringIO(text)) == code
        assert sorted(out.getvalue().split()) == found and said in err.getvalue()
    assert main(["--what", "$"], out, err, spark) == 2


@pytest.mark.parametrize("split", [40, 97, 1000, 10**8])
def test_array_by_element(spark, tmp_path, split):
    """Arrays of odd elements, read in splits that begin anywhere: in strings, escapes and characters of many bytes."""
    rng = random.Random(split)
    odd = ["}", "{", "]", "[", ",", '"', "\\", "é€😀", " ", "\n", "x"]

    def value(depth):
        kind = rng.randrange(6 if depth else 3)
        if kind < 2:
            return "".join(rng.choice(odd) for _ in range(rng.randrange(12)))
        if kind == 2:
            return rng.choice([1, -2.5, None, True])
        return [value(depth - 1) for _ in range(rng.randrange(4))] if kind == 3 else {f"k{i}": value(depth - 1) for i in range(rng.randrange(4))}

    wanted = []
    for f in range(3):
        data = [{"a": value(3), "n": i} for i in range(40)] + [[{"a": 1}], 5, "s", {}]
        wanted += [json.dumps(x) for x in data]
        (tmp_path / f"{f}.json").write_text(json.dumps(data, indent=f or None, ensure_ascii=False))
    (tmp_path / "empty.json").write_text(" [ ] ")
    (tmp_path / "none.json").write_text("")
    with gzip.open(tmp_path / "z.json.gz", "wt") as f:
        f.write('[{"a": "z}"} , {"a": 2}]')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        found = read_documents(spark, str(tmp_path), "array")
        good, bad = good_and_bad(found)
        assert sorted(json.dumps(json.loads(r.text)) for r in good.collect()) == sorted([*wanted, '{"a": "z}"}', '{"a": 2}'])
        assert bad.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_array_with_faults(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": }, nonsense, {"a": 2}] after [{"a": 3}]')
    (tmp_path / "b.json").write_text('[{"a": 4}, {"a": 5, "b": {')
    good, bad = good_and_bad(read_documents(spark, str(tmp_path), "array"))
    assert values(good) == ["1", "2", "3", "4"]
    assert sorted(r["text"].strip() for r in bad.collect()) == sorted(['{"a": }', "nonsense", "after", '{"a": 5, "b": {'])
    with pytest.raises(ValueError):
        read_documents(spark, str(tmp_path), "array", triple_quotes=True)


def test_one_element_over_many_splits(spark, tmp_path):
    long = {"a": "x" * 5000, "b": [{"c": "}" * 300}] * 20}
    (tmp_path / "a.json").write_text(json.dumps([long, {"a": 1}, long]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 512)
    try:
        found = [json.loads(r.text) for r in read_documents(spark, str(tmp_path), "array").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(str, found)) == sorted(map(str, [long, {"a": 1}, long]))


def test_large_array_is_written_without_a_sort(spark, tmp_path):
    """Its one task holds nothing that grows with the lines; the file is one array all the same."""
    d = str(tmp_path)
    spark.range(5000).selectExpr("id AS event_id", "concat('t', id) AS event_type").repartition(3).write.parquet(f"{d}/events.parquet")
    written, write = [], type(spark.range(1).write).text
    type(spark.range(1).write).text = lambda self, path, *a, **b: (written.append((self._df._jdf.queryExecution().executedPlan().toString(), path)), write(self, path, *a, **b))[1]
    try:
        assert source_large_array(spark, d).count() == 5000
    finally:
        type(spark.range(1).write).text = write
    (plan, path) = written[0]
    assert "Sort" not in plan
    (text,) = [r[0] for r in spark.read.text(path, wholetext=True).collect()]
    assert sorted(x["event_id"] for x in json.loads(text)) == list(range(5000))
