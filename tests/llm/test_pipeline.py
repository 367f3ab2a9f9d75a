from collections import Counter
from pathlib import Path

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no sample tables")
def test_stages_keep_what_they_should(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    read, columns = docs, docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, read, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        read = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append((name, read))
        assert name == "packing" or read.columns == columns
    assert [n for n, _ in seen] == ["quality", "near_duplicates", "mixing", "packing"]
    kept = {r.doc_id for r in seen[0][1].collect()}
    assert sum((i in kept) != bool(q) for i, q in labels.items()) <= 2
    once = [r.text for r in seen[1][1].collect()]
    assert len(set(once)) == len(once) <= len(kept)
    mixed = Counter(r.doc_id for r in seen[2][1].collect())
    assert max(mixed.values()) <= 3
    packed = Counter(r.doc_id for r in seen[3][1].where("piece = 0").collect())
    assert packed == mixed


def test_whole_run_equals_the_stages(spark):
    if not Path(SF).exists():
        pytest.skip("no sample tables")
    assert corpus_pipeline.ORACLE_SQL is None and corpus_pipeline.run(spark, SF).columns[:3] == ["doc_id", "piece", "start"]
