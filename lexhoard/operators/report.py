"""Statistics, facets, exports and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexhoard.operators.select import export_order, latest

#: Controlled vocabularies.
VOCABULARIES = {
    "record_type": ["publication", "preprint", "clinical_trial", "regulatory", "news", "conference", "society", "other"],
    "modalities": ["mRNA", "saRNA", "circRNA", "siRNA", "ASO", "aptamer", "miRNA", "RNA editing", "CRISPR RNA", "ribozyme", "RNA nanostructure", "other"],
    "development_stages": ["basic research", "platform development", "preclinical in vitro", "preclinical animal", "IND-enabling", "Phase 1", "Phase 1/2", "Phase 2", "Phase 2/3", "Phase 3", "approved", "post-marketing", "discontinued", "unknown"],
    "evidence_level": ["news or announcement", "conference abstract", "preprint", "peer-reviewed publication", "patent", "trial registration", "trial results", "regulatory document"],
}


def statistics(df: DataFrame, history: str = "change_history") -> DataFrame:
    """One row: total, included, excluded, changed, mean_score (of included, 0 if none)."""
    out = F.coalesce("excluded", F.lit(False))
    changed = F.count_if(F.size(history) > 0) if history in df.columns else F.lit(0).cast("long")
    return df.agg(F.count("*").alias("total"), F.count_if(~out).alias("included"), F.count_if(out).alias("excluded"), changed.alias("changed"), F.coalesce(F.bround(F.avg(F.when(~out, F.col("relevance_score"))), 2), F.lit(0.0)).alias("mean_score"))


def counts_by(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of a column, arrays exploded, ordered without regard to case."""
    value = F.explode(column) if dict(df.dtypes)[column].startswith("array") else F.col(column)
    return df.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.lower("value"), "value")


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) over all columns in one pass."""
    kinds = dict(df.dtypes)
    values = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if kinds[c].startswith("array") else F.array(F.col(c))
    named = lambda c: F.transform(values(c), lambda v: F.struct(F.lit(c).alias("facet"), v.alias("value")))
    entries = F.concat(*[named(c) for c in columns])
    return df.select(F.explode(entries).alias("e")).select("e.*").where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


def facet_values(df: DataFrame, column: str) -> DataFrame:
    return counts_by(df, column).select("value")


def update_report(records: DataFrame, changed: DataFrame, removed: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: total, changed and removed counts, and raw and normalized counts by source (source, raw_count, normalized_count)."""
    tagged = lambda df, kind: df.select(F.lit(kind).alias("kind"))
    rows = tagged(records, "total").union(tagged(changed, "changed")).union(tagged(removed, "removed"))
    named = sources.select(F.lit("source").alias("kind"), F.struct("source", F.struct("raw_count", "normalized_count").alias("counts")).alias("entry"))
    count = lambda kind: F.count_if(F.col("kind") == kind).alias(kind)
    return rows.unionByName(named, allowMissingColumns=True).agg(count("total"), count("changed"), count("removed"), F.map_from_entries(F.array_sort(F.collect_list("entry"))).alias("sources"))


def public_projection(df: DataFrame) -> DataFrame:
    """(id, json) without null fields and without hashes of raw payloads."""
    out = df.withColumn("provenance", F.transform("provenance", lambda p: p.dropFields("raw_sha256"))) if "provenance" in df.columns else df
    return out.select("id", F.to_json(F.struct(*out.columns)).alias("json"))


def export_artifacts(df: DataFrame, path: str, facet_columns: list[str], k: int = 100, when=None) -> None:
    """Writes full, latest, statistics, facets and last_updated as JSON folders below path."""
    export_order(df, when).write.mode("overwrite").json(f"{path}/records")
    latest(df, k, when).write.mode("overwrite").json(f"{path}/latest")
    statistics(df).write.mode("overwrite").json(f"{path}/statistics")
    facets(df, facet_columns).orderBy("facet", F.lower("value"), "value").write.mode("overwrite").json(f"{path}/facets")
    df.agg(F.max("retrieved_at").alias("last_updated"), F.count("*").alias("count")).write.mode("overwrite").json(f"{path}/last_updated")


def validate_records(df: DataFrame, vocabularies: dict[str, list] = VOCABULARIES, ranges: dict[str, tuple[float, float]] | None = None, required: list[str] = ("id",), unique: list[str] = (), id_col: str = "id") -> DataFrame:
    """(id, field, bad_values): values outside vocabularies and ranges, missing required values, and repeated unique ones."""
    kinds, checks = dict(df.dtypes), []
    bad = lambda name, values: F.struct(F.lit(name).alias("field"), F.filter(values, lambda x: x.isNotNull()).alias("bad_values"))
    for c, allowed in vocabularies.items():
        if c in kinds:
            known = F.array(*[F.lit(str(v)) for v in allowed])
            checks.append(bad(c, F.array_except(F.col(c), known) if kinds[c].startswith("array") else F.array(F.when(~F.array_contains(known, F.col(c).cast("string")), F.col(c).cast("string")))))
    for c, (lo, hi) in (ranges or {}).items():
        checks.append(bad(c, F.array(F.when(~F.col(c).between(lo, hi), F.col(c).cast("string")))))
    for c in required:
        checks.append(bad(c, F.array(F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit("missing")))))
    row_wise = df.select(F.col(id_col).cast("string").alias("id"), F.explode(F.filter(F.array(*checks), lambda x: F.size(x["bad_values"]) > 0)).alias("v")).select("id", "v.field", "v.bad_values")
    for c in unique:
        twice = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n"), F.min(F.col(id_col).cast("string")).alias("id")).where("n > 1")
        row_wise = row_wise.union(twice.select("id", F.lit(c).alias("field"), F.array("value").alias("bad_values")))
    return row_wise
