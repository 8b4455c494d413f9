"""The manifest of the token store finds recipes that are lost, doubled or exchanged."""

from dataclasses import replace

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quakeframe.llm import tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def store(spark):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
        return tokens.write_store(docs.select(F.when(F.col("doc_id") > 0, F.col("doc_id")).alias("doc_id"), "text"), f.read(), 49408, 2)


def swapped(recipes):
    """Rows 0 and 1 of segment 1 have each other's doc_id."""
    ids = {r.place: r.doc_id for r in recipes.where("segment = 1 AND place < 2").collect()}
    return recipes.withColumn("doc_id", F.when((F.col("segment") == 1) & (F.col("place") == 0), ids[1]).when((F.col("segment") == 1) & (F.col("place") == 1), ids[0]).otherwise(F.col("doc_id")))


DAMAGE = {
    "row lost": lambda r: r.where("NOT (segment = 1 AND place = 1)"),
    "row doubled": lambda r: r.unionByName(r.where("segment = 1 AND place = 1")),
    "ids swapped": swapped,
    "segment lost": lambda r: r.where("segment <> 1"),
    "all lost": lambda r: r.where("false"),
    "start moved": lambda r: r.withColumn("start", F.when((F.col("segment") == 1) & (F.col("place") == 1), F.col("start") + 1).otherwise(F.col("start"))),
}


def test_whole_store_is_read(store):
    assert tokens.read_store(store).count() == store.recipes.count() == 40
    assert store.manifest.where("segment = 1").count() == 1


@pytest.mark.parametrize("damage", DAMAGE)
def test_recipe_damage_is_found(store, damage):
    with pytest.raises(Exception, match="segment"):
        tokens.read_store(replace(store, recipes=DAMAGE[damage](store.recipes))).collect()


def test_manifest_damage_is_found(store):
    for m in (store.manifest.where("segment <> 1"), store.manifest.unionByName(store.manifest.where("segment = 1")), store.manifest.withColumn("root", F.reverse(F.col("root").cast("string")).cast("binary"))):
        with pytest.raises(ValueError, match="segment"):
            tokens.read_store(replace(store, manifest=m)).collect()
