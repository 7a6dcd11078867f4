import random

import pytest
from pyspark.sql import functions as F

from brevier.operators.dedupe import not_in_inventory
from brevier.sources import key_index as K

ROW = "seq long, url_key string, title_key string"


def rows(spark, keys):
    return spark.createDataFrame([(k, *pair) for k, pair in enumerate(keys)], ROW)


def test_index_equals_the_anti_join(spark, tmp_path):
    rng = random.Random(3)
    key = lambda kind: rng.choice([None, "", f"{kind}{rng.randrange(4000)}", f"{kind}{rng.randrange(4000)}", "é ü"])
    old, more, new = (rows(spark, [(key("u"), key("t")) for _ in range(n)]) for n in (900, 300, 500))
    path = str(tmp_path / "index")
    with pytest.raises(OSError):
        K.not_in_index(new, path)
    K.build_index(old, path, buckets=16)
    seqs = lambda df: sorted(r.seq for r in df.collect())
    assert seqs(K.not_in_index(new, path)) == seqs(not_in_inventory(new, old))
    for _ in range(2):  # a job that runs again changes nothing
        K.add_keys(more, path)
    assert seqs(K.not_in_index(new, path)) == seqs(not_in_inventory(new, old.union(more)))
    K.build_index(old, path, buckets=4)
    assert K.shape_of(spark, path)["folder"] == "generation-1" and seqs(K.not_in_index(new, path)) == seqs(not_in_inventory(new, old))
    assert K.not_in_index(new.limit(0), path).count() == 0
    K.build_index(old.limit(0), path)
    assert K.not_in_index(new, path).count() == new.count()


def test_few_buckets_are_read(spark, tmp_path):
    path = str(tmp_path / "index")
    old = spark.range(40_000).select("id", F.concat(F.lit("u"), "id").alias("url_key"), F.concat(F.lit("t"), "id").alias("title_key"))
    K.build_index(old, path, buckets=64)
    new = spark.range(300).select(F.col("id").alias("seq"), F.when(F.col("id") < 3, F.concat(F.lit("u"), "id")).otherwise(F.concat(F.lit("new"), "id")).alias("url_key"), F.lit(None).cast("string").alias("title_key"))
    shape = K.shape_of(spark, path)
    likely = K.likely_keys(new, path, shape).collect()
    assert 3 <= len(likely) <= 12
    read = K.stored_keys(spark, path, shape, [(r.kind, r.bucket) for r in likely])
    plan = read._jdf.queryExecution().executedPlan()
    assert "PartitionFilters" in plan.toString()
    held = {f.rsplit("/", 1)[0] for f in spark.read.parquet(f"{path}/{shape['folder']}/keys").inputFiles()}
    met = {f"kind={r.kind}/bucket={r.bucket}" for r in likely}
    assert len(held) == 128 and len([f for f in held if f.split("keys/")[1] in met]) <= 12
    assert read.select(F.input_file_name().alias("f")).distinct().count() <= 12
    assert K.not_in_index(new, path).count() == 297
