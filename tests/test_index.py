"""The trigram index finds what a scan finds, from a small part of its files."""

import random

from pyspark.sql import functions as F

from lexhoard.operators import index
from lexhoard.operators.select import search


def _read(df):
    """Files that the rows of a read come from."""
    return {r["f"] for r in df.select(F.input_file_name().alias("f")).distinct().collect()}


def test_index_equals_scan(spark, tmp_path):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(2, 7))) for _ in range(400)]
    rows = [(i, None if i % 41 == 0 else " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, search_text string")
    at = str(tmp_path / "index")
    index.write_search_index(df, at)
    for query in ["abc", "abcd eda", f"{words[0]} {words[1]}", "ab ce", "", "zzz abc", words[2], "É"]:
        # Accents are folded in the query; these texts keep theirs, so such a term is met as it stands in neither.
        want = sorted(r["id"] for r in search(df.withColumn("search_text", F.coalesce("search_text", F.lit(""))), query).collect())
        assert sorted(r["id"] for r in index.search_indexed(spark, at, query).collect()) == want, query
    files = {str(p) for p in (tmp_path / "index" / "lists").rglob("*.parquet")}
    assert len(_read(index._of(spark, at, "lists", ["abc", "bcd"]))) <= 2 < len(files) / 4
    plan = index.search_candidates(spark, at, "abcd")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [In(gram" in plan or "PushedFilters: [" in plan


def test_empty_index(spark, tmp_path):
    index.write_search_index(spark.createDataFrame([(1, None)], "id long, search_text string"), str(tmp_path / "i"))
    assert index.search_indexed(spark, str(tmp_path / "i"), "abc").count() == 0
    assert index.search_candidates(spark, str(tmp_path / "i"), "ab") is None
    assert index.search_indexed(spark, str(tmp_path / "i"), "ab").count() == 0


def test_trigrams_are_listed_together(spark, tmp_path):
    """A row for each trigram of a group of texts, not for each trigram of each text; ids of any type, that may come twice."""
    texts = [f"common words \U0001f600\U0001f601\U0001f602x number{i}" for i in range(300)]
    rows = [(f"id{i}", t) for i, t in enumerate(texts)] + [("id7", "other number7 row"), ("none", None)]
    df = spark.createDataFrame(rows, "id string, search_text string").coalesce(1)
    at = str(tmp_path / "index")
    index.write_search_index(df, at)
    assert spark.read.parquet(f"{at}/lists").count() < 2500
    counts = {r["gram"]: r["n"] for r in spark.read.parquet(f"{at}/counts").collect()}
    want = {}
    for _, t in rows:
        for g in {w[i : i + 3] for w in (t or "").split(" ") for i in range(len(w) - 2)}:
            want[g] = want.get(g, 0) + 1
    assert counts == want
    found = lambda q: sorted(r["id"] for r in index.search_indexed(spark, at, q).collect())
    assert found("number7") == sorted(["id7", "id7", *(f"id{i}" for i in range(70, 80))])
    assert found("common") == sorted(f"id{i}" for i in range(300))
    assert found("row other") == ["id7"]


def test_marks_are_stripped_as_one_by_one():
    import sys
    import unicodedata

    from lexhoard.functions.text import without_marks

    every = "".join(f"a{chr(c)}" for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    for x in (every, every[::-1], "", "plain"):
        assert without_marks(x) == "".join(y for y in unicodedata.normalize("NFKD", x) if not unicodedata.combining(y))
