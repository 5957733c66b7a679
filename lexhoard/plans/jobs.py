"""Jobs composed of the operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexhoard.functions import ids
from lexhoard.operators import classify, dedup, history, people, report, select
from lexhoard.operators.merge import merge_records
from lexhoard.plans.store import HashedTable, union_of
from lexhoard.session import saved

#: Fields that works fill in where a record has none.
FILLED = ["publisher", "journal", "issn", "license", "abstract", "publication_date", "url", "journal_or_source", "authors", "published_date", "funders", "license_url", "relations"]


@dataclass(frozen=True)
class Corpus:
    """members: every source row that went into a record: its columns, with `id` naming the row by id and source (see `member_key`),
    `record_id`, its own id, `cluster`, and `version_hash`, the hash of the row as it came in. records: one row per cluster, merged and
    labelled."""

    members: DataFrame
    records: DataFrame


@dataclass(frozen=True)
class Step:
    """What a batch changes: the rows that changed, all members of the clusters they touch, those clusters' records and the
    decisions behind them, and the names of clusters that are no more."""

    changed: DataFrame
    members: DataFrame
    records: DataFrame
    decisions: DataFrame
    gone: DataFrame


@dataclass(frozen=True)
class Update:
    """corpus for the next run; records, those of it scored; decisions of this run's merges; a report of one row."""

    corpus: Corpus
    records: DataFrame
    decisions: DataFrame
    report: DataFrame


def identifiers(df: DataFrame) -> dict[str, Column]:
    """By kind, the identifiers of which equal ones are duplicates, of the columns that df has."""
    found = {}
    if "doi" in df.columns:
        found["DOI"] = dedup.normalize_doi(F.col("doi"))
    if "pmid" in df.columns:
        found["PMID"] = F.trim("pmid")
    if "nct_id" in df.columns:
        found["trial number"] = F.upper(F.trim("nct_id"))
    return found


def _source_ids(df: DataFrame) -> Column:
    entries = F.map_entries("source_ids") if "source_ids" in df.columns else F.lit(None)
    return F.transform(entries, lambda e: F.concat(F.lit("source "), e["key"], F.lit(":"), e["value"])) if "source_ids" in df.columns else F.array().cast("array<string>")


def _published(df: DataFrame) -> Column:
    return dedup.normalize_doi(F.col("preprint")["published_doi"]) if "preprint" in df.columns else F.lit(None).cast("string")


def member_key() -> Column:
    """What tells source rows apart: two sources may give a record of one id. Sorts as the ids do."""
    return F.concat_ws(" @", "id", F.get(F.col("source_types"), F.lit(0)))


def link_keys(df: DataFrame) -> Column:
    """Every text that two records must have in common to be linked by `exact_links`, so that what a new row can touch is found by
    them. A preprint's published DOI is a key like a record's own."""
    named = [F.concat(F.lit(f"{kind}:"), value) for kind, value in identifiers(df).items()]
    of_preprint = F.concat(F.lit("DOI:"), _published(df))
    return ids.array_union_ordered(F.array(*named, of_preprint), _source_ids(df))


def exact_links(df: DataFrame) -> DataFrame:
    """Edges by equal identifiers, equal source ids, and from preprints to the record of the DOI they name."""
    edges = dedup.exact_edges(df, identifiers(df))
    if "source_ids" in df.columns:
        keys = df.select("id", F.explode(_source_ids(df)).alias("key"))
        edges = edges.unionByName(dedup._stars(keys, "same source id", 1.0))
    if "preprint" in df.columns and "doi" in df.columns:
        edges = edges.unionByName(dedup.preprint_edges(df, F.col("preprint")["published_doi"], F.col("doi")))
    return edges


def _filled(incoming: DataFrame, roster: DataFrame, works: DataFrame) -> DataFrame:
    """incoming with `_member`, watched people, and empty fields filled by DOI, as `with_watched_people` and `fill_missing` give them.

    People and works are found with ids and DOIs alone and handed to the rows by their member key, by which they are then told
    apart too, so that whole rows are dealt once. A key's list holds the people and works met by the rows of that key, each once.
    """
    fields = [c for c in FILLED if c in incoming.columns and c in works.columns]
    rows = incoming.select(member_key().alias("_member"), "id", ids.normalize_doi(F.col("doi")).alias("_rkey")).distinct()
    watched = rows.select("_member", "id").distinct().join(people.watched_people(incoming, roster), "id").select("_member", F.struct("id", "watched_people").alias("p"))
    met = rows.select("_member", "_rkey").distinct().join(history.works_by_doi(incoming, works, fields, source="crossref"), F.col("_rkey") == F.col("_key")).select("_member", F.struct("_key", "_w").alias("w"))
    told = watched.unionByName(met, allowMissingColumns=True).groupBy("_member").agg(F.collect_list("p").alias("_people"), F.collect_list("w").alias("_works"))
    joined = incoming.drop("watched_people").withColumn("_member", member_key()).join(told, "_member", "left")
    mine = F.get(F.filter("_people", lambda p: p["id"] == F.col("id")), F.lit(0))["watched_people"]
    doi = ids.normalize_doi(F.col("doi"))
    work = F.get(F.filter("_works", lambda w: w["_key"] == doi), F.lit(0))
    joined = joined.withColumn("watched_people", F.coalesce(mine, F.array().cast("array<string>"))).withColumn("_key", work["_key"]).withColumn("_w", work["_w"])
    return history.filled_from(joined, joined.drop("_people", "_works", "_key", "_w"), works, fields, source="crossref").drop("filled_fields")


def step(existing: Corpus | None, incoming: DataFrame, roster: DataFrame, works: DataFrame, rules: list, links: Callable[[DataFrame], DataFrame] = exact_links) -> Step:
    """Attributes people, fills metadata, keeps changed rows, and merges again the clusters they touch from all their members.

    incoming: id, source_types, authors, excluded and any other columns, all of which stay; the newest row of an id and source counts
    (by retrieved_at, if there is one). A row is changed if no member has its key and version. A cluster is touched if a changed row is or
    was a member of it, or shares a key with one of its members; no other cluster can gain or lose a link, so none is read beyond
    its keys. A changed row that was a member before tells its changes of tracked fields as events.
    """
    filled = _filled(incoming, roster, works)
    stamped = filled.withColumn("version_hash", ids.content_fingerprint(filled.drop("_member"))).withColumn("record_id", F.col("id")).withColumn("id", F.col("_member")).drop("_member")
    newest = Window.partitionBy("id").orderBy(*([F.col("retrieved_at").desc_nulls_last()] if "retrieved_at" in incoming.columns else []), F.col("version_hash"))
    stamped = stamped.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
    if existing is None:
        changed = saved(history.with_events(None, stamped))
        pool, touched, parts = changed, None, [(changed, changed.select("id"))]
    else:
        known = existing.members.select(F.col("id").alias("_id"), F.col("version_hash").alias("_version"))
        fresh = stamped.join(known, F.col("id") == F.col("_id"), "left").where(~F.col("version_hash").eqNullSafe(F.col("_version"))).drop("_id", "_version")
        changed = saved(history.with_events(existing.members, fresh))
        members = existing.members
        mine = members.join(changed.select("id"), "id", "left_semi").select("cluster")
        keys = changed.select(F.explode(link_keys(changed)).alias("key")).distinct()
        near = members.select("cluster", F.explode(link_keys(members)).alias("key")).join(keys, "key", "left_semi").select("cluster")
        touched = saved(mine.union(near).distinct())
        # Which rows go on is told by their ids first, so that each moves once.
        staying = saved(members.select("id", "cluster").join(touched, "cluster", "left_semi").join(changed.select("id"), "id", "left_anti").select("id"))
        pool = union_of(members.drop("cluster").join(staying, "id", "left_semi"), changed)
        parts = [(members.drop("cluster"), staying), (changed, changed.select("id"))]
    edges = saved(links(pool))
    clusters = dedup.cluster(edges)
    joined = union_of(*[rows.join(of.join(clusters, "id", "left"), "id") for rows, of in parts])
    grouped = saved(joined.withColumn("alone", F.col("cluster").isNull()).withColumn("cluster", F.coalesce("cluster", "id")))
    body = [c for c in grouped.columns if c not in ("alone", "version_hash")]
    reasons = edges.select(F.col("left_id").alias("id"), "reason").join(clusters, "id").select("cluster", "reason").distinct()
    merged = merge_records(grouped.where("not alone").select(body), reasons, "record_id")
    single = grouped.where("alone").select(*body, F.lit(1).alias("n_members")).drop("id").withColumnRenamed("record_id", "id")
    records = classify.classify(union_of(merged, single), rules)
    gone = touched.join(grouped.select("cluster"), "cluster", "left_anti") if touched is not None else changed.select(F.col("id").alias("cluster")).limit(0)
    return Step(changed, grouped.drop("alone"), records, dedup.merge_decisions(clusters, edges), gone)


def update(existing: Corpus | None, incoming: DataFrame, roster: DataFrame, works: DataFrame, rules: list, as_of: str, days: int, when=None, links: Callable[[DataFrame], DataFrame] = exact_links) -> Update:
    """One run of the update over whole tables: see `step`. Untouched records stay as they are; all are scored as of the day, and those
    whose date leaves the window of `days` go with their members, so that they count as changed when they come again.

    existing is None or the corpus of an earlier run. A row that comes again as it was changes nothing, merged or not. If a member of
    a merged record changes, comes alone or links elsewhere, the others' values stay, as the record is merged from them again.
    """
    now = step(existing, incoming, roster, works, rules, links)
    records, moves = now.records, existing is None or now.members.limit(1).count() > 0
    if existing is not None:
        old = now.gone.unionByName(now.members.select("cluster").distinct())
        records = union_of(existing.records.join(old, "cluster", "left_anti"), now.records) if moves else existing.records
    scored = saved(classify.score(records, as_of, when))
    kept = select.retain_recent(scored, as_of, days, when)
    pruned = saved(scored.select("cluster").join(kept.select("cluster"), "cluster", "left_anti"))
    prunes = pruned.limit(1).count() > 0
    stays = lambda ids: ids.join(pruned, "cluster", "left_anti") if prunes else ids
    if existing is None or not moves:
        members = now.members if existing is None else existing.members
        members = saved(stays(members)) if prunes else members
    else:
        held = stays(existing.members.select("id", "cluster").join(now.members.select("id"), "id", "left_anti")).select("id")
        members = saved(union_of(existing.members.join(held, "id", "left_semi"), stays(now.members)))
    corpus = Corpus(members, kept)
    n = incoming.count()
    counts = incoming.sparkSession.createDataFrame([("incoming", n, n)], "source string, raw_count long, normalized_count long")
    return Update(corpus, kept, now.decisions, report.update_report(kept, now.changed, pruned, counts))


def foreach_batch_update(members: HashedTable, records: HashedTable, roster: DataFrame, works: DataFrame, rules: list, links: Callable[[DataFrame], DataFrame] = exact_links) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function of the update: `step` against the two stored tables, of which only the folders of touched members and
    clusters are written. `members` is keyed by id, `records` by cluster. A batch that runs again changes nothing. Records are
    scored and pruned when they are read, as both depend on the day."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if members.done(spark, number):
            return
        stored = members.read(spark)
        now = step(None if stored is None else Corpus(stored, records.read(spark)), batch, roster, works, rules, links)
        # Records follow from members alone, so they go first: a batch that fails in between makes the same ones when it runs again.
        records.apply(saved(now.records), number, removed=now.gone)
        members.apply(now.members, number)

    return run


def export(records: DataFrame, path: str, facet_columns: list[str], text_col: str = "abstract", when=None) -> None:
    """Writes the artifacts unless a text holds credentials."""
    select.assert_no_secrets(records, "id", text_col)
    report.export_artifacts(records, path, facet_columns, when=when)


def prune(records: DataFrame, as_of: str, days: int, when=None) -> tuple[DataFrame, int, int]:
    """Recent records, and the numbers before and after."""
    kept = select.retain_recent(records, as_of, days, when)
    return kept, records.count(), kept.count()


def validate(records: DataFrame, text_col: str = "abstract", **checks) -> DataFrame:
    """Violations of the schema and credentials found, as one table (id, field, bad_values)."""
    secrets = select.scan_secrets(records, "id", text_col).select(F.col("id").cast("string").alias("id"), F.lit(text_col).alias("field"), F.array("label").alias("bad_values"))
    return report.validate_records(records, **checks).unionByName(secrets)
