import numpy as np
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.sources.corpus import corpus_slice
from tessera.sources.files import (
    NER_RECORD_SCHEMA,
    curated_member_rows,
    parse_jsonl,
    read_curated_points,
    read_jsonl,
    read_ner_records,
)


def test_corpus_slice_checks_arguments(spark):
    df = spark.createDataFrame([("en", i, "t", "x") for i in range(10)], "lang string, idx bigint, title string, text string")
    assert corpus_slice(df, 2, 100).count() == 8
    with pytest.raises(ValueError):
        corpus_slice(df, 5, 5)
    with pytest.raises(ValueError):
        corpus_slice(df, -1, 3)


def test_tolerant_jsonl_read(spark):
    d = tempfile.mkdtemp(prefix="tessera-test-")
    path = os.path.join(d, "selected_data_0.json")
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps({"title": "Wien", "index": 3, "entities": [["Wien", "LOC"]], "lang_code": "de"}) + "\n")
        f.write("{not json\n\n")
        f.write(json.dumps({"title": "Graz", "index": 7, "entities": [], "lang_code": "de"}, ensure_ascii=False) + "\n")
    schema = NER_RECORD_SCHEMA
    rows = read_ner_records(spark, path).orderBy("index").collect()
    assert [r["index"] for r in rows] == [3, 7]
    assert rows[0]["entities"][0]["label"] == "LOC"
    bad = os.path.join(d, "bad.json")
    with open(bad, "w") as f:
        f.write("{oops\n")
    with pytest.raises(ValueError):
        read_jsonl(spark, bad, schema)


def test_good_lines_do_not_depend_on_the_columns_read(spark):
    lines = ['{"title": "A", "index": 1, "entities": [], "lang_code": "de"}', '{"title": "B", "index": "x", "entities": [], "lang_code": "de"}', "[1, 2]", "{oops", "", "  ", None, "null", '"text"']
    good, rejected = parse_jsonl(spark.createDataFrame([(x,) for x in lines], "value string"), NER_RECORD_SCHEMA)
    assert good.count() == good.select("title").count() == good.select("lang_code").count() == 1
    assert sorted((r["line"], r["reason"]) for r in rejected.collect()) == sorted([(lines[1], "bad_field"), ("[1, 2]", "not_an_object"), ("{oops", "not_an_object"), ("null", "not_an_object"), ('"text"', "not_an_object")])


def test_route_round_trip(spark):
    from tessera.plans.ner_selection import run_ner_selection, write_routes

    corpus = spark.createDataFrame(
        [("de", 1, "Wien", "Wien ist eine Stadt"), ("en", 2, "Area 51", "Area is here")],
        "lang string, idx bigint, title string, text string",
    )
    out = tempfile.mkdtemp(prefix="tessera-test-")
    write_routes(run_ner_selection(corpus), out)
    sel = read_ner_records(spark, f"{out}/selected").collect()
    filt = read_ner_records(spark, f"{out}/filtered").collect()
    assert [(r["index"], r["lang_code"]) for r in sel] == [(1, "de")]
    assert [r["index"] for r in filt] == [2]
    assert sel[0]["entities"][0]["text"] == "Wien"


def test_curated_points_reader(spark):
    doc = {
        "en": [{"cluster_id": 1, "cluster_size": 2, "theme": "t", "description": "d", "titles": ["A", "B"], "indices": [20, 100]}],
        "de": [{"cluster_id": 9, "cluster_size": 1, "theme": "u", "description": "e", "titles": ["C"], "indices": [5]}],
    }
    d = tempfile.mkdtemp(prefix="tessera-test-")
    p = os.path.join(d, "points.json")
    with open(p, "w", encoding="utf-8") as f:
        json.dump(doc, f, indent=2)
    cur = read_curated_points(spark, p)
    assert cur.count() == 2
    rows = curated_member_rows(cur).orderBy("lang", "member_pos").collect()
    assert [(r["lang"], r["title"], r["idx"]) for r in rows] == [("de", "C", 5), ("en", "A", 20), ("en", "B", 100)]


def test_checkpoint_dir_comes_from_session(spark):
    from tessera.session import ensure_checkpoint_dir

    d = ensure_checkpoint_dir(spark)
    assert d and d == spark.sparkContext.getCheckpointDir()


def test_cluster_conf_sizes():
    from tessera.session import cluster_conf

    c = cluster_conf(8000)
    assert c["spark.sql.shuffle.partitions"] == "32000"
    assert c["spark.sql.files.maxPartitionBytes"] == "128m"


ELEMENTS = [
    {"a": 1, "t": 'brackets ]}[{ and, commas "quoted" \\\\ end\\\\'},
    {"a": 2, "t": "}"},
    {"a": 3, "t": "ünïcödé 日本 \\u007d \n", "n": {"x": [1, [2, {"y": "}]"}]]}},
    {"a": 4, "t": ""},
    {"a": 5, "t": "x" * 3000 + "}" * 50 + '"'},
    {"a": 6, "t": None},
]
SCHEMA = "a long, t string"


@pytest.fixture()
def tiny_ranges(spark):
    kept = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for c, v in kept.items():
        spark.conf.set(c, v)


@pytest.mark.parametrize("indent", [None, 2])
def test_split_array_equals_the_whole_read(spark, tmp_path, tiny_ranges, indent):
    from pyspark.sql.types import StructType

    from tessera.sources.files import _pieces, read_json_array, read_json_array_split, split_json_array

    path = str(tmp_path / "one.json")
    rows = [e | {"a": 10 * i + e["a"]} for i in range(8) for e in ELEMENTS]
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows, f, indent=indent, ensure_ascii=False)
    assert _pieces(spark, path).select("start").distinct().count() > 25
    got = sorted(r["element"] for r in split_json_array(spark, path).collect())
    assert sorted(map(json.dumps, map(json.loads, got))) == sorted(map(json.dumps, rows))
    schema = StructType.fromDDL(SCHEMA)
    key = lambda r: r["a"]
    assert sorted(read_json_array_split(spark, path, schema).collect(), key=key) == sorted(read_json_array(spark, path, schema).collect(), key=key)


def test_split_arrays_of_other_values_and_empty_ones(spark, tmp_path, tiny_ranges):
    from tessera.sources.files import split_json_array

    texts = {"a": "[]", "b": " [ ] \n", "c": '[1, "two, ]", [3, [4]], null, true]', "d": json.dumps(["}" * 400, {"k": "["}])}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {}
    for r in split_json_array(spark, str(tmp_path)).collect():
        got.setdefault(r["file"][-6], []).append(r["element"])
    assert {k: sorted(map(json.dumps, map(json.loads, v))) for k, v in got.items()} == {k: sorted(map(json.dumps, json.loads(t))) for k, t in texts.items() if json.loads(t)}


def test_json_arrays_round_trip(spark, tmp_path):
    from tessera.sources.files import split_json_array, write_json_arrays

    rows = [(["en", "de", None, "zh/tw"][i % 4], i, f'text "{i}" ]}}, [{{' if i % 3 else None) for i in range(200)]
    out = str(tmp_path / "arrays")
    files = write_json_arrays(spark.createDataFrame(rows, "lang string, idx long, text string").repartition(5), out, "lang", ["idx"])
    assert sorted(os.path.basename(f) for f in files) == ["de.json", "en.json", "null.json", "zh%2Ftw.json"]
    for lang, name in (("en", "en"), ("de", "de"), (None, "null"), ("zh/tw", "zh%2Ftw")):
        with open(f"{out}/{name}.json", encoding="utf-8") as f:
            assert json.load(f) == [{"idx": i, "text": t} for g, i, t in rows if g == lang]
    assert sorted(os.listdir(out), key=str)[-1] != "_pieces"
    assert split_json_array(spark, f"{out}/en.json").count() == 50
    assert write_json_arrays(spark.createDataFrame([], "lang string, idx long"), str(tmp_path / "none"), "lang", ["idx"]) == []


def test_bucketed_corpus_stays_where_it_is(spark, capsys):
    """Lookups by (lang, idx) exchange their narrow side only."""
    from tessera.plans.multi_lang import pool_articles
    from tessera.plans.quality_selection import cluster_members
    from tessera.plans.single_lang import selected_articles
    from tessera.sources.corpus import bucket_corpus

    rows = [(["en", "de", None][i % 3], i, f"T{i}", f"Text number {i} of some length") for i in range(300)]
    corpus = spark.createDataFrame(rows, "lang string, idx bigint, title string, text string")
    fixed = bucket_corpus(corpus)
    keys = spark.createDataFrame([("en", i, "t", 0) for i in range(0, 300, 3)] + [("de", 1, "t", 0), (None, 2, "t", 0)], "lang string, idx bigint, title string, cluster_id int")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lookups = {
            "J1": lambda c: selected_articles(keys.select(F.col("lang").alias("lang_code"), F.col("idx").alias("index")), c),
            "J2": lambda c: cluster_members(keys, c),
            "J3": lambda c: pool_articles(keys, c),
            "texts": lambda c: keys.join(c.select("lang", "idx", "text"), ["lang", "idx"]),
        }
        for name, look in lookups.items():
            assert sorted(map(str, look(fixed).collect())) == sorted(map(str, look(corpus).collect())), name
            look(fixed).explain()
            plan = capsys.readouterr().out
            # one exchange, that of the narrow side, and it does not stand above the corpus
            assert "Bucketed: true" in plan and plan.count("Exchange ") == 1, name
            assert "tessera_corpus_" not in plan[plan.index("Exchange ") :].split("Scan ExistingRDD")[0], name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_byte_ranges_are_scanned_in_bounded_pieces(monkeypatch):
    import pyarrow as pa

    from tessera.sources import files

    monkeypatch.setattr(files, "SCAN_BYTES", 7)
    values = ['[{"a": "x', '\\\\"y"', ', {"a": "' + "é[" * 20 + '"']
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * 3), pa.array([0] * 3), pa.array(values)], names=["file", "start", "value"])
    got = list(files._ranges_of(iter([batch])))
    assert max(len(data) for _, _, data in got) <= 7
    text = "".join(v + "}" for v in values).encode()
    assert b"".join(data.tobytes() for _, _, data in got) == text
    whole = files._Scan(np.frombuffer(text, dtype=np.uint8), files.OUTSIDE)
    state, depth, at, cuts = files.OUTSIDE, 0, 0, []
    for _, _, data in got:
        scan = files._Scan(data, state)
        cuts += (scan.cuts(depth) + at).tolist()
        state, depth, at = scan.end, depth + scan.fall, at + len(data)
    assert (state, depth, cuts) == (whole.end, whole.fall, whole.cuts(0).tolist())
