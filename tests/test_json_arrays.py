"""Top-level JSON arrays read by many tasks (A3, A5)."""

from __future__ import annotations

import json
import random

import pytest

from polytext.sources import json_arrays as JA

SCHEMA = "id long, text string, deep struct<x:array<struct<y:string>>>, sentences array<map<string,string>>"


def _entries(seed, n):
    r = random.Random(seed)
    bits = ['{', '}', '[', ']', '"', '\\', '\\"', '\\\\', ',', ':', ' ', 'é', '漢', '😀', '\n', 'word', '"}', '{"']
    text = lambda k: "".join(r.choice(bits) for _ in range(r.randrange(k)))
    return [{"id": i, "text": text(30), "deep": {"x": [{"y": text(9)} for _ in range(r.randrange(3))]},
             "sentences": [{text(5) + "k": text(8)} for _ in range(r.randrange(3))]} for i in range(n)]


def _plain(row):
    d = row.asDict(recursive=True)
    return json.dumps(d, sort_keys=True, ensure_ascii=False)


@pytest.mark.parametrize("indent,ascii_only", [(None, False), (2, True)])
@pytest.mark.parametrize("split", [37, 500, 1 << 20])
def test_one_file_over_many_tasks_equals_the_whole_parse(spark, tmp_path, indent, ascii_only, split):
    entries = _entries(split, 120)
    entries.append({"id": -1, "text": "long { " * 300, "deep": {"x": []}, "sentences": []})
    (tmp_path / "a.json").write_text(json.dumps(entries, indent=indent, ensure_ascii=ascii_only), encoding="utf-8")
    (tmp_path / "b.json").write_text(" [ ]\n")
    (tmp_path / "c.json").write_text(json.dumps(entries[:3]))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = JA.read_json_array(spark, f"{tmp_path}/*.json", SCHEMA)
        got = sorted(_plain(r) for r in df.collect())
        assert split > 1000 or JA.record_texts(spark, f"{tmp_path}/a.json").rdd.getNumPartitions() > 8
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == sorted(json.dumps(e, sort_keys=True, ensure_ascii=False) for e in entries + entries[:3])


def test_written_arrays_are_json_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(i, f'a "{i}" \\ {{', None if i % 2 else "x") for i in range(50)], "id long, text string, other string").repartition(4)
    JA.write_json_arrays(df, f"{tmp_path}/out")
    parsed = [e for p in (tmp_path / "out").glob("part-*") for e in json.loads(p.read_text())]
    assert len(parsed) == 50
    got = JA.read_json_array(spark, f"{tmp_path}/out", "id long, text string, other string")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    JA.write_json_arrays(df.limit(0), f"{tmp_path}/none")
    assert JA.read_json_array(spark, f"{tmp_path}/none", "id long").collect() == []


def test_an_incomplete_file_is_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id": ')
    with pytest.raises(ValueError, match="not a complete JSON array"):
        JA.read_json_array(spark, f"{tmp_path}/a.json", "id long")
