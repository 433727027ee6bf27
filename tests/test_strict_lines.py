import pytest

from plumbline.sources import strict_lines
from plumbline.sources.strict_lines import StrictLoad

RAW = "line_id long, manifest_name string, line_no int, raw_line string"
CLASSES = "label string"


def load(spark, lines, header="path,label,split", labels=("cat", "dog")):
    rows = [(0, "m", 1, header), *[(k + 1, "m", k + 2, x) for k, x in enumerate(lines)]]
    return StrictLoad(spark.createDataFrame(rows, RAW), spark.createDataFrame([(x,) for x in labels], CLASSES))


CASES = [
    ("a.jpg,cat,train", None),
    ("a.JPG,cat,Train\r", None),
    (' "a.jpg",cat,train', "quoting"),
    ('"a.jpg",cat,', None),
    ('"a,b.jpg","cat",dev', None),
    ('"a""b.jpg",cat,train', None),
    ('"a.jpg,cat,train', "quoting"),
    ('"a.jpg"x,cat,train', "quoting"),
    ('a"b.jpg,cat,train', "quoting"),
    ('"a.jpg"",cat,train', "quoting"),
    ("", "column_count"),
    (None, "column_count"),
    (" \t", "column_count"),
    ("\r", "column_count"),
    ("a.jpg,cat", "column_count"),
    ("a.jpg,cat,train,", "column_count"),
    ("a.txt,cat,train", "path"),
    ("a.jpg\x01.jpg,cat,train", "path"),
    ("a�.jpg,cat,train", "path"),
    ("a\tb.jpg,cat,train", "path"),
    (" a.jpg\t,\tcat , train ", None),
    ("a.jpg,Cat,train", "label"),
    ("a.jpg,,train", "label"),
    ("a.jpg,cat,holdout", "split"),
    ("a.jpg,cat,  ", None),
    ("a.txt,cow,holdout", "path"),
    ("a.jpg\r\r,cat,train", "path"),
    ("a.jpg,cat,train\r\r", "split"),
    ("a.jpg\n,cat,train", "path"),
]


def test_reasons(spark):
    load_ = load(spark, [c for c, _ in CASES])
    got = {r.line_id: r.reason for r in load_.rejected().collect()}
    assert got == {k + 1: why for k, (_, why) in enumerate(CASES) if why}
    loaded = {r.line_id: r for r in load_.loaded().collect()}
    assert set(loaded) == {k + 1 for k, (_, why) in enumerate(CASES) if not why}
    assert (loaded[5].path, loaded[5].label, loaded[5].split) == ("a,b.jpg", "cat", "val")
    assert loaded[6].path == 'a"b.jpg'
    assert loaded[4].split is None


def test_headers_in_any_spelling_and_order(spark):
    for header in ("﻿Label, PATH ,Group\r", "label,path,group"):
        got = load(spark, ["cat,a.jpg,g1", "cat,a.jpg"], header)
        assert [tuple(r) for r in got.loaded().collect()] == [(1, "a.jpg", "cat", None, "g1", None)]
        assert [tuple(r)[:2] for r in got.rejected().collect()] == [(2, "column_count")]


def test_very_long_lines(spark):
    many = '"' + 'x""' * 200_000 + '.jpg",cat,train'
    got = load(spark, [many, "y" * 500_000 + ".jpg,cat,train", '"' + 'x""' * 200_001 + ',cat,train'])
    assert sorted(r.line_id for r in got.loaded().collect()) == [1, 2]
    assert [r.reason for r in got.rejected().collect()] == ["quoting"]


def test_no_header_no_classes_no_rows(spark):
    classes = spark.createDataFrame([("cat",), (None,)], CLASSES)
    raw = spark.createDataFrame([(1, "m", 2, "a.jpg,cat"), (2, None, 2, "a.jpg,cat"), (3, "m", 2, "a.jpg,cat")], RAW)
    assert {(r.line_id, r.reason) for r in StrictLoad(raw, classes).rejected().collect()} == {(1, "column_count"), (2, "column_count"), (3, "column_count")}
    empty = StrictLoad(raw.limit(0), classes)
    assert empty.loaded().count() == empty.rejected().count() == 0
    got = load(spark, ["a.jpg,cat,train"], labels=())
    assert [r.reason for r in got.rejected().collect()] == ["label"]


def test_extra_columns_with_clashing_names(spark):
    raw = spark.createDataFrame([(1, "m", 1, "path,label", 1, "x"), (2, "m", 2, "a.jpg,cat", 2, "y")], RAW + ", n int, label string")
    classes = spark.createDataFrame([("cat", 1)], "label string, n int")
    assert StrictLoad(raw, classes).loaded().count() == 1


@pytest.mark.parametrize("hot,limit", [(True, 0), (False, 0), (True, 10**7)])
def test_one_manifest_holds_most_lines(spark, monkeypatch, hot, limit):
    """With headers and labels that are few enough to be sent along, and with more."""
    monkeypatch.setattr(strict_lines, "HEADS_BYTES", limit)
    monkeypatch.setattr(strict_lines, "LABELS_LISTED", limit)
    rows = [(0, "big", 1, "path,label")] + [(k, "big" if hot or k % 2 else f"m{k % 300}", 2, "a.jpg,cat" if k % 3 else "a.jpg,cow") for k in range(1, 2000)]
    rows += [(10_000 + k, f"m{k}", 1, "label,path") for k in range(300)]
    got = StrictLoad(spark.createDataFrame(rows, RAW), spark.createDataFrame([("cat",)], CLASSES))
    bad = got.rejected().count()
    assert bad + got.loaded().count() == 1999
    assert not hot or bad == sum(k % 3 == 0 for k in range(1, 2000))
