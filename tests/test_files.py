"""Readers on the file forms the reference data comes in."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.sources import json_scan, npy, readers, writers


def test_reviews_prefer_the_dense_file(spark, tmp_path):
    row = {"reviewerID": "u", "asin": "a", "overall": 5, "unixReviewTime": 3}
    (tmp_path / "Arts.json").write_text(json.dumps(row) + "\n" + json.dumps(row))
    assert readers.read_reviews(spark, folder=str(tmp_path), category="Arts").count() == 2
    (tmp_path / "Arts_5.json").write_text(json.dumps(row))
    got = readers.read_reviews(spark, folder=str(tmp_path), category="Arts").collect()
    assert len(got) == 1 and got[0]["overall"] == 5.0 and got[0]["reviewText"] is None
    with pytest.raises(FileNotFoundError):
        readers.read_reviews(spark, folder=str(tmp_path), category="None")


def test_metadata_titles(spark, tmp_path):
    rows = [{"asin": "a", "title": " T "}, {"asin": "b"}, {"asin": "c", "title": "  "}, {"asin": "d", "title": "<span id", "categories": [["x"], ["y"]]}]
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, rows)))
    meta = readers.read_item_meta(spark, str(tmp_path / "m.json"))
    assert sorted(map(tuple, readers.valid_titles(meta).collect())) == [("a", "T"), ("d", "<span id")]
    assert {r["asin"] for r in readers.invalid_items(meta).collect()} == {"b", "c"}
    assert {r["asin"] for r in readers.valid_titles(meta, strict=True).collect()} == set()


def test_list_text_csv(spark, tmp_path):
    import csv

    with open(tmp_path / "s.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["user_id", "history_item_title", "item_title", "history_item_id", "item_id", "history_item_sid", "item_sid"])
        w.writerow(["A1", str(["it's", 'say "hi"', "a, b"]), "t", str([1, 2]), 3, str(["<a_1>"]), "<a_2>"])
        w.writerow(["A2", "[]", "multi\nline", "[]", 4, "[]", "<a_3>"])
    rows = sorted(readers.read_sid_samples(spark, str(tmp_path / "s.csv")).collect())
    assert rows[0]["history_item_title"] == ["it's", 'say "hi"', "a, b"] and rows[0]["history_item_id"] == [1, 2]
    assert rows[1]["item_title"] == "multi\nline" and rows[1]["history_item_sid"] == []


def test_compact_reader_rejects_bad_lines(spark, tmp_path):
    (tmp_path / "x.inter").write_text("user_id:token\titem_id_list:token_seq\titem_id:token\n1\t5 6\t7\n\n2\t8\n3\t\t9\n")
    good, bad = readers.read_inter(spark, str(tmp_path / "x.inter"))
    assert sorted((r["user_id"], tuple(r["item_id_list"]), r["item_id"]) for r in good.collect()) == [(1, (5, 6), 7), (3, (), 9)]
    assert [r["line"] for r in bad.collect()] == ["2\t8"]


@pytest.mark.parametrize("indent", [None, 2, 4])
def test_keyed_json(spark, tmp_path, indent):
    index = {"0": ["<a_1>", "<b_2>"], "7": ["<a_3>", "<b_4>", "]"]}
    (tmp_path / "i.json").write_text(json.dumps(index, indent=indent))
    got = {r["item_id"]: r["tokens"] for r in readers.read_sid_index(spark, str(tmp_path / "i.json"), indent).collect()}
    assert got == {0: index["0"], 7: index["7"]}
    items = {str(n): {"title": f't"{n}"', "description": "a }\n b", "brand": "", "categories": "x,y"} for n in range(3)}
    (tmp_path / "m.json").write_text(json.dumps(items, indent=indent))
    rows = {r["item_id"]: r["description"] for r in readers.read_item_features(spark, str(tmp_path / "m.json"), indent).collect()}
    assert rows == {n: "a }\n b" for n in range(3)}


@pytest.mark.parametrize("as_array", [True, False])
def test_preferences(spark, tmp_path, as_array):
    rows = [{"user": "a", "split": "train", "user_preference": "p", "context": {"history_items": [1, 2], "target_item": 3}},
            {"user": "b", "split": "train", "user_preference": "p", "context": {"history_items": [1, 2]}},
            {"user": "c", "split": "test", "user_preference": "p", "context": {"history_items": [1], "target_item": 3}},
            {"user": "d", "split": "train", "user_preference": "p", "context": {"history_items": [], "target_item": 3}}]
    (tmp_path / "p.json").write_text(json.dumps(rows, indent=1) if as_array else "\n".join(map(json.dumps, rows)))
    got = readers.preference_histories(readers.read_preferences(spark, str(tmp_path / "p.json"))).collect()
    assert sorted((r["user"], tuple(r["history"]), r["target"]) for r in got) == [("a", (1, 2), 3), ("b", (1,), 2)]


@pytest.fixture
def small_stretches(spark):
    """Files read in stretches of a few bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "40", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_one_line_objects_in_stretches(spark, tmp_path, small_stretches):
    """Quotes, backslashes, brackets and commas inside strings, entries longer than a stretch, several files."""
    want = {}
    for name in "ab":
        whole = {f"{name}{i}": {"t": t, "l": [i, [i, {"x": t}]], "long": "y" * (i * 7)} for i, t in enumerate(
            ['plain', 'a,b', 'q"q,"', '\\', '\\",', '}],{[', 'é,日', '', ',,,', '"', 'x\\"y', "\n,\t"])}
        (tmp_path / f"{name}.json").write_text(json.dumps(whole, ensure_ascii=name == "a"), encoding="utf-8")
        want |= {k: v["t"] + v["long"] for k, v in whole.items()}
    pieces = json_scan.pieces(spark, str(tmp_path))
    assert pieces.select("file", "block").distinct().count() > 20
    rows = readers.read_keyed_json(spark, str(tmp_path), "struct<t: string, long: string>")
    assert {r["key"]: r["value"]["t"] + r["value"]["long"] for r in rows.collect()} == want


@pytest.mark.parametrize("text", ["{}", "[]", " [ ] \n", '{"a": 1}', '[1, 2,\n 3]\n', '["a,b", [1, 2], {"c": [3, 4]}]', '\ufeff[7, 8]'])
def test_entries_of_small_files(spark, tmp_path, small_stretches, text):
    (tmp_path / "x.json").write_text(text, encoding="utf-8")
    got = sorted(json.dumps(json.loads(r["entry"] if text.strip("\ufeff ")[0] == "[" else "{" + r["entry"] + "}")) for r in json_scan.entries(spark, str(tmp_path / "x.json")).collect())
    whole = json.loads(text.strip("\ufeff"))
    assert got == sorted(json.dumps(e) for e in (whole if isinstance(whole, list) else [{k: v} for k, v in whole.items()]))


def test_preference_files_of_both_forms(spark, tmp_path, small_stretches):
    def row(i):
        return {"user": f"u{i}", "split": "train", "user_preference": "likes, [a] and \"b\"", "context": {"history_items": [i, i + 1], "target_item": i + 2}}

    (tmp_path / "a.json").write_text(json.dumps([row(i) for i in range(20)]))
    (tmp_path / "b.json").write_text("\n".join(json.dumps(row(i)) for i in range(20, 30)))
    (tmp_path / "c.json").write_text("\n " + json.dumps([row(i) for i in range(30, 35)], indent=2))
    got = readers.read_preferences(spark, str(tmp_path)).collect()
    assert sorted((r["user"], tuple(r["history_items"]), r["target_item"]) for r in got) == sorted((f"u{i}", (i, i + 1), i + 2) for i in range(35))


@pytest.mark.parametrize("by_column", [False, True])
@pytest.mark.parametrize("dtype", ["float32", "float16", "float64"])
def test_npy_in_ranges(spark, tmp_path, dtype, by_column):
    data = np.arange(60, dtype=dtype).reshape(20, 3)
    np.save(tmp_path / "e.npy", np.asfortranarray(data) if by_column else data)
    df = readers.read_npy(spark, str(tmp_path / "e.npy"), task_bytes=64)
    assert df.rdd.getNumPartitions() > 1
    got = {r["item_id"]: r["embedding"] for r in df.collect()}
    assert got == {i: list(map(float, data[i])) for i in range(20)}


def test_npy_files_written_by_tasks(spark):
    vectors = spark.range(50).select(F.col("id").alias("item_id"), F.array(F.col("id").cast("float"), F.lit(1.5).cast("float")).alias("embedding"))
    for by_column in (False, True):
        files = npy.write_npy_files(vectors, "item_id", "embedding", 2, by_column)
        assert files.count() >= 1
        got = {r["item_id"]: r["embedding"] for r in npy.read_npy_files(files, 40).collect()}
        assert got == {i: [float(i), 1.5] for i in range(50)}


def test_arrow_streams(spark, tmp_path):
    paths = []
    for part in range(2):
        table = pa.table({"a": [part, part + 10], "b": [["x"], []]})
        paths.append(str(tmp_path / f"{part}.arrow"))
        with pa.OSFile(paths[-1], "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
            w.write_table(table)
    got = readers.read_arrow_streams(spark, paths, "a bigint, b array<string>")
    assert sorted((r["a"], tuple(r["b"])) for r in got.collect()) == [(0, ("x",)), (1, ("x",)), (10, ()), (11, ())]


def test_sid_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("A1", ["it's", 'x "y"'], "t", [1], 2, ["<a_1>"], "<b>")],
                               "user_id string, history_item_title array<string>, item_title string, history_item_id array<bigint>, item_id bigint, history_item_sid array<string>, item_sid string")
    writers.write_sid_samples(df, str(tmp_path / "o"))
    assert readers.read_sid_samples(spark, str(tmp_path / "o")).collect() == df.collect()


def test_title_ids_and_catalogue_fallback(spark, tmp_path):
    items = spark.createDataFrame([(1, "One"), (2, None), (3, "Three")], "item_id bigint, title string")
    sids = spark.createDataFrame([(1, "<a_1>"), (2, "<a_2>")], "item_id bigint, sid string")
    writers.write_catalogue(items, sids, str(tmp_path / "c"))
    rows = readers.read_catalogue(spark, str(tmp_path / "c")).orderBy("item_id").collect()
    assert [(r["sid"], r["title"], r["catalogue_id"]) for r in rows] == [("<a_1>", "One", 0), ("<a_2>", "Item_2", 1)]
    writers.write_title_ids(items.filter(F.col("title").isNotNull()), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == 2


def test_first_rows_of_sequences(spark, tmp_path):
    spark.range(5).select(F.col("id").alias("uid"), F.array("id").alias("item_id")).write.parquet(str(tmp_path / "plain"))
    got = readers.read_sequences(spark, str(tmp_path / "plain"), first=2)
    assert got.columns == ["uid", "item_ids"] and got.count() == 2
