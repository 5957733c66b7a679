"""Revisions, snapshots, change detection and fill-only enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexhoard.functions.ids import content_fingerprint
from lexhoard.functions.text import normalize_doi
from lexhoard.operators.classify import with_evidence

#: Trial fields whose changes are told, in this order.
TRACKED = ["overall_status", "enrollment", "phase", "start_date", "primary_completion_date", "completion_date", "interventions", "outcomes"]


def latest_revision(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The row with the greatest order of each key."""
    last = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def revision_events(df: DataFrame, key: str, order: str) -> DataFrame:
    """Every row but a key's first, with the order value before it as previous_<order>."""
    return df.withColumn(f"previous_{order}", F.lag(order).over(Window.partitionBy(key).orderBy(order))).where(F.col(f"previous_{order}").isNotNull())


def carry_first_date(df: DataFrame, key: str, date: str) -> DataFrame:
    return df.withColumn(date, F.min(date).over(Window.partitionBy(key)))


def snapshot_history(df: DataFrame, key: str, ts: str, tracked: list[str], tie: str | None = None) -> DataFrame:
    """Each snapshot with the tracked fields that differ from the one before (changed_fields) and a running version from 1."""
    order = Window.partitionBy(key).orderBy(ts, *([tie] if tie else []))
    old = lambda f: F.lag(f).over(order)
    first = F.row_number().over(order) == 1
    changed = F.filter(F.array(*[F.when(~F.col(f).eqNullSafe(old(f)), F.lit(f)) for f in tracked]), lambda x: x.isNotNull())
    out = df.withColumn("changed_fields", F.when(first, F.array().cast("array<string>")).otherwise(changed))
    return out.withColumn("version", (F.sum(F.when(F.size("changed_fields") > 0, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("int"))


def coalesce_revisions(df: DataFrame, key: str, version: str, first_date: str, body: list[str]) -> DataFrame:
    """One row per key: the newest revision's body, the earliest first date, the number of revisions as version, and a change
    event per consecutive pair of revisions."""
    revisions = F.array_sort(F.collect_list(version))
    out = df.groupBy(key).agg(F.max_by(F.struct(*body), F.col(version)).alias("_body"), F.min(first_date).alias(first_date), F.count("*").cast("int").alias("version"), revisions.alias("_v"))
    pairs = F.transform(F.slice("_v", 2, F.greatest(F.size("_v") - 1, F.lit(0))), lambda v, i: F.struct(F.get("_v", i).alias("old_version"), v.alias("new_version")))
    return out.select(key, first_date, "version", pairs.alias("change_history"), *[F.col("_body")[c].alias(c) for c in body if c not in (key, first_date, "version")])


def coalesce_preprints(df: DataFrame) -> DataFrame:
    """One row per preprint (DOI, else id) from a row per version, as `normalize_preprints` gives them: the newest version's body with
    the earliest first_date, the number of versions as `version`, provenance of all versions in their order, the URLs of all that
    its own isn't as alternate_urls, and an event per step from one version to the next, with both numbers as values."""
    key = F.coalesce("doi", "id")
    part = F.struct(F.col("preprint.version").alias("number"), "retrieved_at", F.coalesce("preprint.server", F.lit("preprint")).alias("server"), "provenance", F.concat(F.array("url"), "alternate_urls").alias("urls"))
    rest = [c for c in df.columns if c not in ("first_date", "version", "provenance", "alternate_urls", "change_history")]
    held = F.max_by("change_history", F.struct("preprint.version", "url")).alias("_held") if "change_history" in df.columns else F.lit(None).alias("_held")
    out = df.groupBy(key.alias("_key")).agg(F.max_by(F.struct(*rest), F.struct("preprint.version", "url")).alias("_body"), F.min("first_date").alias("first_date"), F.sort_array(F.collect_list(part)).alias("_v"), held)
    value = lambda v: F.create_map(F.lit("version"), F.to_json(F.struct(v["number"].alias("value"))))
    step = lambda v, i: F.struct(v["retrieved_at"].alias("changed_at"), v["server"].alias("source"), F.array(F.lit("preprint.version")).alias("fields"), value(F.get(F.col("_v"), i)).alias("old_values"), value(v).alias("new_values"))
    later = F.slice("_v", F.lit(2), F.greatest(F.size("_v") - 1, F.lit(0)))
    events = F.transform(later, step).cast(f"array<{EVENT}>")
    urls = F.filter(F.array_distinct(F.flatten(F.transform("_v", lambda v: v["urls"]))), lambda u: u != F.col("_body.url"))
    return out.select("_body.*", "first_date", F.size("_v").alias("version"), F.flatten(F.transform("_v", lambda v: v["provenance"])).alias("provenance"), urls.alias("alternate_urls"), F.concat(F.coalesce(F.col("_held").cast(f"array<{EVENT}>"), F.array().cast(f"array<{EVENT}>")), events).alias("change_history"))


def changed_records(existing: DataFrame, incoming: DataFrame, key: str = "id", fingerprint: str | None = None) -> DataFrame:
    """Incoming rows that the stored table lacks or holds with another fingerprint. A stored fingerprint column saves hashing."""
    print_of = lambda df: F.col(fingerprint) if fingerprint else content_fingerprint(df)
    old = existing.select(F.col(key).alias("_id"), print_of(existing).alias("_old"))
    return incoming.withColumn("_new", print_of(incoming)).join(old, (F.col(key) == F.col("_id")) & (F.col("_new") == F.col("_old")), "left_anti").drop("_new")


def fill_missing(records: DataFrame, works: DataFrame, fields: list[str], doi: str = "doi", source: str | None = None) -> DataFrame:
    """Fills empty fields of records from the work of the same DOI and lists them in filled_fields. Records without a DOI don't
    take part in the join, so they make no skew. Of works with one DOI the first by their JSON counts.

    With `source`, records that have a work say so, in those of these columns that they have: source_types and source_ids name the
    source and the DOI, field_sources the source of each filled field, date_precision that of a filled published_date, alternate_urls
    the work's `url`, and provenance gets an entry of the filled fields (with retrieved_at and raw_sha256 if works have them).
    """
    keyed = records.withColumn("_rkey", normalize_doi(F.col(doi)))
    joined = keyed.where("_rkey is not null").join(works_by_doi(records, works, fields, doi, source), F.col("_rkey") == F.col("_key"), "left")
    rest = keyed.where("_rkey is null").select(*records.columns, F.array().cast("array<string>").alias("filled_fields"))
    return filled_from(joined, records, works, fields, source).unionByName(rest)


def _beside(records: DataFrame, works: DataFrame, fields: list[str], source: str | None) -> list[str]:
    return [c for c in ("url", "retrieved_at", "raw_sha256", "date_precision") if source and c in works.columns and c not in fields]


def works_by_doi(records: DataFrame, works: DataFrame, fields: list[str], doi: str = "doi", source: str | None = None) -> DataFrame:
    """(_key, _w): of the works of each DOI the one that counts, with what `filled_from` takes of it."""
    body = F.struct(*fields, *_beside(records, works, fields, source))
    return works.withColumn("_key", normalize_doi(F.col(doi))).where("_key is not null").groupBy("_key").agg(F.min_by(body, F.to_json(body)).alias("_w"))


def filled_from(joined: DataFrame, records: DataFrame, works: DataFrame, fields: list[str], source: str | None = None) -> DataFrame:
    """`fill_missing` for records (of the columns of `records`) that stand beside their work (_key, _w), or nulls if they have none."""
    kinds = dict(records.dtypes)
    empty = lambda c, name: (F.size(c) <= 0) if kinds[name].startswith(("array", "map")) else (F.trim(c) == "") if kinds[name] == "string" else F.lit(False)
    lacks = lambda c, name: c.isNull() | F.coalesce(empty(c, name), F.lit(True))
    mine, theirs = F.col, lambda n: F.col(f"_w.{n}")
    filled = F.filter(F.array(*[F.when(lacks(mine(f), f) & ~lacks(theirs(f), f), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    joined = joined.withColumn("filled_fields", filled)
    values = {c: F.when(lacks(mine(c), c), F.coalesce(theirs(c), mine(c))).otherwise(mine(c)) if c in fields else F.col(c) for c in records.columns}
    if source:
        values |= _told_by(records, source, _beside(records, works, fields, source), values)
    return joined.select(*[values[c].alias(c) for c in records.columns], "filled_fields")


def _told_by(records: DataFrame, source: str, beside: list[str], values: dict[str, Column]) -> dict[str, Column]:
    """The columns by which a record says what a work of `source` gave it."""
    met, out, name, have = F.col("_w").isNotNull(), {}, F.lit(source), records.columns
    extra = lambda c: F.col(f"_w.{c}") if c in beside else F.lit(None)
    texts = "map<string,string>"
    given = lambda c: F.coalesce(values[c], F.create_map().cast(texts))
    if "source_types" in have:
        out["source_types"] = F.when(met, F.array_union(F.coalesce("source_types", F.array().cast("array<string>")), F.array(name))).otherwise(F.col("source_types"))
    if "source_ids" in have:
        out["source_ids"] = F.when(met, F.map_concat(F.map_filter(given("source_ids"), lambda k, v: k != source), F.create_map(name, F.col("_key")))).otherwise(F.col("source_ids"))
    if "field_sources" in have:
        others = F.map_filter(given("field_sources"), lambda k, v: ~F.array_contains("filled_fields", k))
        out["field_sources"] = F.when(met, F.map_concat(others, F.map_from_arrays("filled_fields", F.array_repeat(name, F.size("filled_fields"))))).otherwise(F.col("field_sources"))
    if "date_precision" in have and "date_precision" in beside:
        precise = F.map_concat(F.map_filter(given("date_precision"), lambda k, v: k != "published_date"), F.map_filter(F.coalesce(extra("date_precision"), F.create_map().cast(texts)), lambda k, v: k == "published_date"))
        out["date_precision"] = F.when(F.array_contains("filled_fields", "published_date"), precise).otherwise(F.col("date_precision"))
    if "alternate_urls" in have:
        urls = F.coalesce("alternate_urls", F.array().cast("array<string>"))
        out["alternate_urls"] = F.when(met & extra("url").isNotNull(), F.array_union(urls, F.array(extra("url").cast("string")))).otherwise(F.col("alternate_urls"))
    if "provenance" in have:
        kind = records.schema["provenance"].dataType.elementType
        parts = {"source": name, "source_id": F.col("_key"), "url": F.concat(F.lit("https://api.crossref.org/works/"), F.replace(F.url_encode("_key"), F.lit("+"), F.lit("%20"))), "retrieved_at": extra("retrieved_at"), "fields": F.col("filled_fields"), "raw_sha256": extra("raw_sha256"), "note": F.lit("filled by DOI")}
        entry = F.struct(*[parts.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])
        out["provenance"] = F.when(met, F.concat(F.coalesce("provenance", F.array().cast(records.schema["provenance"].dataType)), F.array(entry))).otherwise(F.col("provenance"))
    return out


def apply_trial_updates(existing: DataFrame, incoming: DataFrame, key: str = "nct_id", tracked: list[str] = TRACKED) -> DataFrame:
    """Incoming snapshots of stored trials: body of the incoming row, version + 1 and one event if any tracked field differs."""
    tracked = [c for c in tracked if c in incoming.columns]
    old = existing.select(F.col(key).alias("_k"), F.col("version").alias("_version"), *[F.col(c).alias(f"_old_{c}") for c in tracked])
    joined = incoming.drop("version").join(old, F.col(key) == F.col("_k"), "left")
    stored = F.col("_k").isNotNull()
    fields = F.filter(F.array(*[F.when(stored & ~F.col(c).eqNullSafe(F.col(f"_old_{c}")), F.lit(f"trial.{c}")) for c in tracked]), lambda x: x.isNotNull())
    as_json = lambda prefix: F.map_from_arrays(F.array(*[F.lit(f"trial.{c}") for c in tracked]), F.array(*[F.to_json(F.struct(F.col(prefix + c).alias("value"))) for c in tracked]))
    kept = lambda m: F.map_filter(m, lambda k, v: F.array_contains("changed_fields", k))
    out = joined.withColumn("changed_fields", fields).withColumn("old_values", kept(as_json("_old_"))).withColumn("new_values", kept(as_json("")))
    version = F.coalesce("_version", F.lit(1)) + F.when(F.size("changed_fields") > 0, 1).otherwise(0)
    return out.withColumn("version", version.cast("int")).select(*incoming.drop("version").columns, "version", "changed_fields", "old_values", "new_values")


#: A change of a record over time: values before and after as JSON by field.
EVENT = "struct<changed_at:timestamp,source:string,fields:array<string>,old_values:map<string,string>,new_values:map<string,string>>"


def _as_json(fields: dict[str, Column]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.to_json(F.struct(c.alias("value"))) for c in fields.values()]))


def with_events(stored: DataFrame | None, incoming: DataFrame, key: str = "id", tracked: list[str] | None = None, source: str = "clinicaltrials") -> DataFrame:
    """incoming with `version` and `change_history` (array of EVENT), carried over from the stored row of the same key.

    If any tracked field differs, the version goes up by one and an event is appended that names the fields, in their order, with old
    and new values. Fields may lie in structs (`trial.phase`); by default those of TRACKED that a struct `trial` has. Provenance of the
    stored row stays in front of the incoming row's. Rows without a stored one start at their own version, else at 1. Tables without
    tracked fields get no columns.
    """
    trial = {f.name for f in incoming.schema["trial"].dataType.fields} if "trial" in incoming.columns else set()
    tracked = [f"trial.{c}" for c in TRACKED if c in trial] if tracked is None else tracked
    if not tracked:
        return incoming
    now = {f: F.col(f) for f in tracked}
    version = F.col("version") if "version" in incoming.columns else F.lit(None).cast("int")
    history = F.col("change_history").cast(f"array<{EVENT}>") if "change_history" in incoming.columns else F.array().cast(f"array<{EVENT}>")
    rest = [c for c in incoming.columns if c not in ("version", "change_history", "provenance")]
    provenance = ["provenance"] if "provenance" in incoming.columns else []
    if stored is None:
        return incoming.select(*rest, *provenance, F.coalesce(version, F.lit(1)).cast("int").alias("version"), F.coalesce(history, F.array().cast(f"array<{EVENT}>")).alias("change_history"))
    kept = [c for c in ("version", "change_history", "provenance") if c in stored.columns]
    old = stored.select(F.col(key).alias("_key"), F.struct(*[F.col(f).alias(f.replace(".", "_")) for f in tracked], *[F.col(c).alias(f"_{c}") for c in kept]).alias("_old"))
    joined = incoming.join(old, F.col(key) == F.col("_key"), "left")
    before = {f: F.col("_old")[f.replace(".", "_")] for f in tracked}
    known = F.col("_key").isNotNull()
    fields = F.filter(F.array(*[F.when(known & ~now[f].eqNullSafe(before[f]), F.lit(f)) for f in tracked]), lambda x: x.isNotNull())
    joined = joined.withColumn("_fields", fields)
    only = lambda m: F.map_filter(m, lambda k, v: F.array_contains("_fields", k))
    at = F.col("retrieved_at").cast("timestamp") if "retrieved_at" in incoming.columns else F.lit(None).cast("timestamp")
    event = F.struct(at.alias("changed_at"), F.lit(source).alias("source"), F.col("_fields").alias("fields"), only(_as_json(before)).alias("old_values"), only(_as_json(now)).alias("new_values"))
    none = F.array().cast(f"array<{EVENT}>")
    held = F.coalesce(F.col("_old")["_change_history"], none) if "change_history" in kept else none
    differs = F.size("_fields") > 0
    of_old = F.coalesce(F.col("_old")["_version"], F.lit(1)) if "version" in kept else F.lit(1)
    columns = [F.when(known, of_old + differs.cast("int")).otherwise(F.coalesce(version, F.lit(1))).cast("int").alias("version"), F.when(known, F.concat(held, F.when(differs, F.array(event)).otherwise(none))).otherwise(F.coalesce(history, none)).alias("change_history")]
    if provenance:
        mine = F.coalesce(F.col("provenance"), F.array().cast(incoming.schema["provenance"].dataType))
        columns.append((F.coalesce(F.concat(F.col("_old")["_provenance"], mine), mine) if "provenance" in kept else mine).alias("provenance"))
    return joined.select(*rest, *columns)


def enrichment_input_hash(fields: list[str], model: str, prompt_version: str) -> Column:
    record = F.to_json(F.struct(*[F.col(f) for f in sorted(fields)]), {"ignoreNullFields": "false"})
    return F.sha2(F.concat_ws("\u001f", F.lit(model), F.lit(prompt_version), record), 256)


def pending_enrichment(records: DataFrame, cache: DataFrame, fields: list[str], model: str, prompt_version: str) -> DataFrame:
    """Records for whose input the cache has no result."""
    return records.withColumn("input_hash", enrichment_input_hash(fields, model, prompt_version)).join(cache.select("input_hash").distinct(), "input_hash", "left_anti")


#: Confidence of a label that a model gave, and what a result says about itself.
MODEL_CONFIDENCE = 0.6
METADATA = ["provider", "model", "prompt_version", "enrichment_timestamp", "input_hash", "validation_status"]


def apply_enrichment(records: DataFrame, results: DataFrame, labels: list[str], vocab: dict[str, list[str]], texts: list[str], replaced: list[str] = ()) -> DataFrame:
    """Adds the results' labels (those of `vocab` fields only from the vocabulary), takes their texts and lists where given and those
    of `replaced` in any case, and notes the method. Results of provider `none` and records without a result change nothing. Needs `id`
    and `input_hash`.

    A record with classification_evidence gets evidence for each of the result's labels that has none, and a record with
    enrichment_metadata what the result says about itself (METADATA, as far as results have it).
    """
    r = lambda c: F.col(f"_r.{c}")
    kept = [c for c in results.columns if c not in ("id", "input_hash")]
    body = F.struct(*kept)
    given = results.where("provider <> 'none'").groupBy("id", "input_hash").agg(F.max_by(body, F.struct("provider", F.to_json(body))).alias("_r"))
    out = records.join(given, ["id", "input_hash"], "left")
    none = F.array().cast("array<string>")
    allowed = lambda c: F.array_intersect(r(c), F.array(*[F.lit(v) for v in vocab[c]])) if c in vocab else r(c)
    kinds, met = dict(records.dtypes), F.col("_r").isNotNull()
    said = lambda c: F.when((F.size(r(c)) > 0) if kinds[c].startswith("array") else (r(c) != ""), r(c))
    entry = lambda x: F.struct(x.alias("label"), F.lit(MODEL_CONFIDENCE).alias("confidence"), none.alias("matched_phrases"), F.array(F.lit("llm_enrichment")).alias("fields"), F.concat(F.lit("llm:"), r("provider")).alias("method"))
    columns = []
    for c in records.columns:
        if c in labels:
            columns.append(F.array_distinct(F.concat(F.coalesce(F.col(c), none), F.coalesce(allowed(c), none))).alias(c))
        elif c in texts:
            columns.append(F.coalesce(said(c), F.col(c)).alias(c))
        elif c in replaced:
            columns.append(F.when(met, r(c)).otherwise(F.col(c)).alias(c))
        elif c == "classification_method":
            columns.append(F.when(met, F.concat(c, F.lit("+llm"))).otherwise(F.col(c)).alias(c))
        elif c == "classification_evidence":
            added = with_evidence(F.col(c), {x: F.transform(F.array_distinct(F.coalesce(allowed(x), none)), entry) for x in labels})
            columns.append(F.when(met, added).otherwise(F.col(c)).alias(c))
        elif c == "enrichment_metadata":
            kind = records.schema[c].dataType
            of = lambda f: F.col("input_hash") if f == "input_hash" else r(f) if f in kept else F.lit(None)
            columns.append(F.when(met, F.struct(*[of(f.name).cast(f.dataType).alias(f.name) for f in kind.fields])).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return out.select(*columns)


def plan_windows(state: DataFrame, until: str, sources: dict[str, tuple[int, int]], since: str | None = None) -> DataFrame:
    """(source, since, until): since as given, else the last boundary less the source's overlap, else until less its days.
    `sources` maps a source to (overlap, days). since after until is an error."""
    spark = state.sparkSession
    rows = spark.createDataFrame([(s, o, d) for s, (o, d) in sources.items()], "source string, overlap int, days int")
    end, given = F.lit(until).cast("date"), F.lit(since).cast("date")
    start = F.coalesce(given, F.date_sub("last_successful_until", F.col("overlap")), F.date_sub(end, F.col("days")))
    if since and since > until:
        raise ValueError("since is after until")
    return rows.join(state, "source", "left").select("source", start.alias("since"), end.alias("until"))


def advance_state(state: DataFrame, results: DataFrame) -> DataFrame:
    """State after a run: results (source, ok, until, retrieved_at, raw_count) advance the sources that were ok."""
    new = results.where("ok").select("source", F.col("until").alias("_u"), F.col("retrieved_at").alias("_t"), F.col("raw_count").alias("_c"))
    return state.join(new, "source", "full").select("source", F.coalesce("_u", "last_successful_until").alias("last_successful_until"), F.coalesce("_t", "last_retrieved_at").alias("last_retrieved_at"), F.coalesce("_c", "raw_count").alias("raw_count"))
