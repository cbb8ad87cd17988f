"""Line numbers of files that are read in many splits."""

import gzip

import pytest

from skeinwork.sources import ndjson


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "997", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k in keys:
        spark.conf.unset(k)


def test_line_numbers_across_splits(small_splits, tmp_path):
    files = {
        "a.ndjson": ["" if i % 17 == 0 else f'{{"id": {i}, "t": "{"ش" * (i % 40)}"}}' if i % 10 else f"broken {i}" for i in range(700)],
        "b.ndjson": ['{"id": 1}', "[", '{"id": 2}'], "c.ndjson": [],
    }
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(lines), encoding="utf-8")
    with gzip.open(tmp_path / "d.ndjson.gz", "wt", encoding="utf-8", newline="") as f:
        f.write("\r\n".join(['{"id": 3}', "", "nope", '{"id": 4}', ""]))
    files["d.ndjson.gz"] = ['{"id": 3}', "", "nope", '{"id": 4}']
    every = ndjson.numbered(small_splits, str(tmp_path))
    assert every.rdd.getNumPartitions() > 4
    got = sorted((r.path.rsplit("/", 1)[1], r.line, r.text) for r in every.collect())
    assert got == sorted((name, i + 1, x) for name, lines in files.items() for i, x in enumerate(lines))
    bad = sorted((r.path.rsplit("/", 1)[1], r.line, r.text) for r in ndjson.bad_lines(small_splits, str(tmp_path), "id long, t string").collect())
    assert bad == sorted((n, i, x) for n, i, x in got if x.startswith(("broken", "[", "nope")))
