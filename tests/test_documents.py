"""Array documents cut at record boundaries."""

import json

import pytest
from pyspark.sql import functions as F

from borgata.sources import documents

NASTY = ['plain', 'a } b', '{', '}{', 'say "}" \\', '\\"}', '', 'tail \\\\', '"', '},{"id": 9', '€ } ü']


def _records(n):
    return [{"id": i, "t": NASTY[i % len(NASTY)], "sub": {"x": [{"y": i}, {}], "z": {}} if i % 3 else None} for i in range(n)]


@pytest.fixture(params=[None, 64, 700])
def block(spark, request):
    """Blocks of the default size and tiny ones."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = {n: spark.conf.get(n) for n in names}
    if request.param:
        for n in names:
            spark.conf.set(n, str(request.param))
    yield request.param
    for n, v in old.items():
        spark.conf.set(n, v)


def _read(spark, path, root=None):
    rows = documents.split_records(spark, str(path), root).orderBy("file", "record").collect()
    return [json.loads(r["text"]) for r in rows], rows


@pytest.mark.parametrize("indent", [None, 2])
def test_bare_arrays(spark, tmp_path, block, indent):
    want = _records(60)
    (tmp_path / "a.json").write_text(json.dumps(want, indent=indent))
    got, rows = _read(spark, tmp_path)
    assert got == want and [r["record"] for r in rows] == list(range(1, 61))
    if block == 64:
        assert documents._pieces(spark, str(tmp_path)).select("block").distinct().count() > 20


def test_root_arrays_and_several_documents_in_a_file(spark, tmp_path, block):
    want = _records(25)
    text = "\n".join([json.dumps({"immo.bili": want[:10]}), '{"immo.bili": []}', json.dumps({"immo.bili": want[10:]}, indent=1)])
    (tmp_path / "a.json").write_text(text)
    assert _read(spark, tmp_path, "immo.bili")[0] == want


def test_files_of_nothing_and_cut_off_records(spark, tmp_path):
    for name, text in {"a": "", "b": "[]", "c": " [ ] \n", "d": '[{"id": 1}, {"id": 2, "t": "x'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows = documents.split_records(spark, str(tmp_path)).orderBy("record").select(
        "text", F.try_variant_get("value", "$.id", "int").alias("id")).collect()
    assert [r["id"] for r in rows] == [1, None] and rows[1]["text"].startswith('{"id": 2')


def test_fields_that_drift(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"p": 1}, {"p": "2"}, {"p": {"v": 3}}, {}]))
    rows = documents.split_records(spark, str(tmp_path)).orderBy("record")
    got = rows.select(F.coalesce(F.try_variant_get("value", "$.p.v", "int"), F.try_variant_get("value", "$.p", "int")).alias("p"))
    assert [r["p"] for r in got.collect()] == [1, 2, 3, None]
