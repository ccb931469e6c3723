"""Readers and writers on small files, and round trips between them."""

import json

import pytest

from spanloom.sources import readers, writers


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_jsonl(spark, tmp_path):
    good = json.dumps({"id": "a", "text": "x y", "tags": [{"start": 0, "end": 1, "tag": "T"}], "lang": "nl"})
    path = put(tmp_path / "a.jsonl", good + "\n{bad\n")
    assert rows(readers.jsonl(spark, path, strict=False), "id", "text") == [("a", "x y")]
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        readers.jsonl(spark, path).collect()


def test_brat(spark, tmp_path):
    put(tmp_path / "d1.ann", "T1\tDIS 0 4\tpijn\n#1\tNote T1\tx\nT2\tDIS a 4\tbad\nR1\n")
    assert rows(readers.brat(spark, str(tmp_path)), "filename", "ann_id", "label", "start", "end", "text") == [("d1", "T1", "DIS", 0, 4, "pijn")]


def test_span_tsv(spark, tmp_path):
    path = put(tmp_path / "s.tsv", "name\ttag\tstart_span\tend_span\ttext\nd\tdis\t0\t4\tpijn\nd\tDIS\t0\t4\tpijn\nd\tsym\t5\t9\t\"a\n")
    assert rows(readers.span_tsv(spark, path), "filename", "label", "start_span", "text") == [("d", "DIS", "0", "pijn"), ("d", "SYM", "5", '"a')]
    assert rows(readers.span_tsv(spark, path, ["Sym"]), "label") == [("SYM",)]


def test_mixed_tsv(spark, tmp_path):
    one, two = put(tmp_path / "1.tsv", "filename\tlabel\ttext\na\tX\tq\n"), put(tmp_path / "2.tsv", "filename\tlabel\tstart_span\nb\tY\t3\n")
    assert rows(readers.mixed_tsv(spark, [one, two])) == [("a", "X", "", "", "q"), ("b", "Y", "3", "", "")]
    with pytest.raises(ValueError, match="lacks"):
        readers.mixed_tsv(spark, [put(tmp_path / "3.tsv", "filename\nc\n")])


def test_numbered_lines(spark, tmp_path):
    path = put(tmp_path / "l.txt", "a\n\nb\n")
    assert rows(readers.numbered_lines(spark, path)) == [(0, "a"), (2, "b")]
    assert rows(readers.numbered_lines(spark, path, count_blank=False)) == [(0, "a"), (1, "b")]


def test_folds(spark, tmp_path):
    path = put(tmp_path / "f.json", json.dumps({"folds": [{"train_files": ["a.txt"], "val_files": ["b"]}], "test_files": ["c.txt"]}))
    assert rows(readers.folds(spark, path), "fold", "role", "gid") == [(-1, "test", "c"), (0, "train", "a"), (0, "val", "b")]


def test_concepts(spark, tmp_path):
    path = put(tmp_path / "c.txt", "C1||Pain||Ache\ncui-less||x\nC1+C2||Both\nC3\n")
    assert rows(readers.concepts(spark, path)) == [("C1", "ache", False), ("C1", "pain", False), ("C1+C2", "both", True)]


def test_round_trips(spark, tmp_path):
    table = spark.createDataFrame([("d", "DIS", "0", "4", "pijn")], "filename string, label string, start_span string, end_span string, text string")
    writers.tsv(table, str(tmp_path / "t"))
    assert rows(readers.span_tsv(spark, str(tmp_path / "t")), *table.columns) == rows(table)
    writers.hashed_parquet(table, str(tmp_path / "p"), "filename", 3)
    assert rows(readers.checked_parquet(spark, str(tmp_path / "p"), table.columns)) == rows(table)
    with pytest.raises(ValueError, match="lacks"):
        readers.checked_parquet(spark, str(tmp_path / "p"), ["absent"])


def test_long_file_in_splits(spark, tmp_path):
    """Numbers run on over the splits of a file."""
    path = put(tmp_path / "l.txt", "".join("\n" if i % 7 == 3 else f"line {i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 3
        assert rows(readers.numbered_lines(spark, path)) == sorted(((i, f"line {i}") for i in range(5000) if i % 7 != 3), key=repr)
        kept = [i for i in range(5000) if i % 7 != 3]
        assert rows(readers.numbered_lines(spark, path, count_blank=False)) == sorted(((n, f"line {i}") for n, i in enumerate(kept)), key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ids_in_their_order(spark):
    names = [f"id{i * 37 % 1000:03d}" for i in range(1000)]
    df = spark.createDataFrame([*((n,) for n in [*names, *names[:5]]), (None,)], "id string")
    want = sorted((n, int(n[2:])) for n in [*names, *names[:5]])
    for ranges in (1, 7, 2000):
        assert sorted(tuple(r) for r in readers.encode_ids(df, "id", ranges).select("id", "label").collect()) == want
    assert readers.encode_ids(df.limit(0), "id").count() == 0


def test_nested_reports(spark, tmp_path):
    (tmp_path / "a").mkdir()
    put(tmp_path / "a" / "eval_results.json", json.dumps({"f1": 0.5, "name": "x", "strict": {"p": 1, "note": "y"}, "list": [1]}))
    assert rows(readers.reports(spark, str(tmp_path)), "metric", "value") == [("f1", 0.5), ("strict_p", 1.0)]


def test_more_readers(spark, tmp_path):
    (tmp_path / "t").mkdir()
    put(tmp_path / "t" / "d.1.txt", "one\ntwo")
    assert rows(readers.text_files(spark, str(tmp_path / "t"))) == [("d", "one\ntwo")]
    path = put(tmp_path / "a.json", json.dumps([{"entity_group": "dis", "word": "w", "start": 1, "end": 2}]))
    assert rows(readers.json_array(spark, path)) == [("document", "DIS", 1, 2, "w")]
    path = put(tmp_path / "c.csv", "a,b\n1,2\n")
    assert rows(readers.with_source(spark, path)) == [("1", "2", "c.csv")]
    (tmp_path / "l1.txt").write_bytes("caf\xe9 \"x\n".encode("latin-1"))
    assert rows(readers.latin1_lines(spark, str(tmp_path / "l1.txt"))) == [('café "x',)]
    lines = spark.createDataFrame([(0, "zero"), (2, "two")], "line_num long, text string")
    asked = spark.createDataFrame([(1, 0), (2, -1), (3, None), (4, 9), (5, 2)], "id int, line int")
    assert rows(readers.lookup_by_line(asked, lines, "line"), "id", "text") == [(1, "zero"), (2, None), (3, None), (4, None), (5, "two")]
    docs = spark.createDataFrame([("a", "x"), ("", "y"), ("b", ""), (None, "z")], "id string, text string")
    assert rows(readers.first_split({"dev": docs.limit(0), "test": docs}, "id", "text")) == [("a", "x")]
    docs.write.parquet(str(tmp_path / "p"))
    assert readers.checked_parquet(spark, str(tmp_path / "p"), ["text"]).columns == ["text"]
    with pytest.raises(ValueError, match="lacks"):
        readers.checked_parquet(spark, str(tmp_path / "p"), ["title"])


def test_more_writers(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(3, "c", "x"), (1, "a", "y"), (2, "b", "x")], "n int, s string, k string")
    writers.jsonl(df, out)
    assert rows(spark.read.schema(df.schema).json(out)) == [(1, "a", "y"), (2, "b", "x"), (3, "c", "x")]
    writers.csv_fields(df, out, ["s", "n"])
    assert rows(spark.read.option("header", True).csv(out)) == [("a", "1"), ("b", "2"), ("c", "3")]
    writers.delimited(df, out, ["s", "k"])
    assert rows(spark.read.text(out)) == [("a||y",), ("b||x",), ("c||x",)]
    writers.report_json(df.where("n = 1"), out)
    assert [json.loads(r.value) for r in spark.read.text(out).collect()] == [{"n": 1, "s": "a", "k": "y"}]
    writers.sorted_parquet(df, out, "n")
    assert sorted(r.n for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    writers.tsv(df, out, by="k")
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("k=")) == ["k=x", "k=y"]
    lines = spark.createDataFrame([(i, f"l{i}") for i in range(5)], "line_num long, text string")
    writers.every_n_lines(lines, out, 2)
    assert rows(spark.read.text(out), "part", "value") == [(0, "l0"), (0, "l1"), (1, "l2"), (1, "l3"), (2, "l4")]


def test_text_csv(spark, tmp_path):
    path = put(tmp_path / "t.csv", 'id,text,more\n1,"a\nb ""c""",x\n2,,y\n,z,\n')
    assert rows(readers.text_csv(spark, path)) == [("1", 'a\nb "c"')]
    with pytest.raises(ValueError, match="lacks"):
        readers.text_csv(spark, put(tmp_path / "u.csv", "id,body\n1,a\n"))


def test_predictions_tsv(spark, tmp_path):
    head = "filename\tlabel\tstart_span\tend_span\ttext\tnote\n"
    path = put(tmp_path / "p.tsv", head + "d\tDIS\t0\t4\tpijn\t\n")
    assert rows(readers.predictions_tsv(spark, path)) == [("d", "DIS", 0, 4, "pijn", "")]
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        readers.predictions_tsv(spark, put(tmp_path / "q.tsv", head + "d\tDIS\tx\t4\tpijn\t\n")).collect()


def test_span_tree(spark, tmp_path):
    head = "name\ttag\tstart_span\tend_span\ttext\n"
    for batch, name in (("b1", "one"), ("b2", "two")):
        for kind in readers.TREE_CLASSES:
            folder = tmp_path / batch / "1_validated_without_sugs" / "nl" / kind
            (folder / "tsv").mkdir(parents=True)
            put(folder / "tsv" / "a.tsv", head + f"{name}\t{kind.upper()}\t0\t3\tabc\nlost\tX\t0\t1\tq\n")
        (folder.parent / "dis" / "txt").mkdir()
        put(folder.parent / "dis" / "txt" / f"{name}.txt", f"abc é {name}")
    got = rows(readers.span_tree(spark, str(tmp_path), "nl"), "batch", "class", "name", "tag", "start_span", "end_span", "span", "text")
    assert got == sorted(((b, k, n, k.upper(), 0, 3, "abc", f"abc é {n}") for b, n in (("b1", "one"), ("b2", "two")) for k in readers.TREE_CLASSES), key=repr)
    assert {r.name for r in readers.span_tree(spark, str(tmp_path), "nl", ["two"]).collect()} == {"two"}


def test_listed_ids(spark, tmp_path):
    assert rows(readers.listed_ids(spark, put(tmp_path / "ids.txt", "a.txt\n\n b \na\n"))) == [("a",), ("b",)]
    with pytest.raises(ValueError, match="no .txt"):
        readers.listed_ids(spark, put(tmp_path / "ids.csv", "a\n"))
