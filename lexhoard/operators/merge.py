"""One record of all members of a cluster, by the survivorship rules of each field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexhoard.functions.ids import canonical_id
from lexhoard.functions.text import empty_to_null, normalize_doi
from lexhoard.operators.dedup import quality

#: Fields that the best member alone decides, be they given or not.
BEST_ONLY = ["record_type", "url", "journal_or_source", "license_url", "evidence_level", "trial", "preprint", "retrieved_at", "date_precision"]
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_STRINGS, _TEXTS, _LISTS = "array<string>", "map<string,string>", "map<string,array<string>>"
#: A relation that a merged preprint leaves behind, and the one record type whose DOI a preprint may name.
HAS_PREPRINT, PUBLICATION = "has-preprint", "publication"


def _entries(i: int, c: str, kind: str) -> Column:
    """Of an array or map field: structs of the field's number, a key that tells values apart, the value as text, and its place."""
    entry = lambda key, value, at: F.struct(F.lit(i).alias("i"), key.alias("k"), value.alias("v"), at.cast("int").alias("at"))
    col = F.col(c)
    if kind == _STRINGS:
        made = F.transform(col, lambda x, at: entry(x, x, at))
    elif kind == _TEXTS:
        made = F.transform(F.map_entries(col), lambda e, at: entry(e["key"], e["value"], at))
    elif kind == _LISTS:
        pair = lambda e, x: F.to_json(F.struct(e["key"].alias("key"), x.alias("value")))
        made = F.flatten(F.transform(F.map_entries(col), lambda e: F.transform(e["value"], lambda x, at: entry(pair(e, x), pair(e, x), at))))
    else:
        said = lambda x: F.to_json(F.struct(x.alias("value")), _TIMES)
        made = F.transform(col, lambda x, at: entry(said(x), said(x), at))
    return F.coalesce(made, F.from_json(F.lit("[]"), "array<struct<i:int,k:string,v:string,at:int>>"))


def merge_records(df: DataFrame, reasons: DataFrame | None = None, name: str = "id") -> DataFrame:
    """One row per cluster. df: cluster, id (once per cluster), source_types and any other columns; reasons: (cluster, reason).
    `name` is the column by which a record goes if that isn't what tells members apart.

    Members rank by source quality, then id, both descending. Fields of BEST_ONLY are the best member's; first_date is the
    least, updated_date and version the greatest; excluded only if all members are; an abstract of a `pubmed` member, the first by
    id, goes before all others; the DOI is that of the publication which a preprint among the members names as its published
    version, if there is one, whose preprints' DOIs are listed as a relation. Arrays and maps of arrays are united in the order of
    members' ids; of maps of texts the better member's value counts. URLs that the record doesn't show become alternate_urls. The
    last provenance of the best member is repeated with a note of the reasons. Other fields are the first that is given, by rank.
    The id is made anew of the identifiers that the record has now; a cluster of one member stays as it is.

    No list is longer than what it unites without repeats, so that copies of a record cost no memory.
    """
    kinds = dict(df.dtypes)
    have = [c for c in df.columns if c not in ("cluster", "id", name)]
    plain = [c for c in have if kinds[c] != "array<string>" and not kinds[c].startswith("map") and not (kinds[c].startswith("array") and c != "authors")]
    united = [c for c in have if c not in plain and c not in (*BEST_ONLY, "alternate_urls")]
    singular = [c for c in have if c not in united and c != "alternate_urls"]
    rank = F.struct("_q", "id")
    given = lambda c: F.when(F.size(c) > 0, F.lit(True)) if kinds[c].startswith("array") else F.when(empty_to_null(F.col(c)).isNotNull(), F.lit(True)) if kinds[c] == "string" else F.when(F.col(c).isNotNull(), F.lit(True))
    first_given = lambda c: F.max_by(c, F.when(given(c), rank))

    def survivor(c: str) -> Column:
        if c in BEST_ONLY:
            return F.max_by(c, rank)
        if c == "first_date":
            return F.min(c)
        if c in ("updated_date", "version"):
            return F.max(c)
        if c == "excluded":
            return F.min(F.coalesce(c, F.lit(False)))
        if c == "abstract":
            return F.coalesce(F.min_by(c, F.when(given(c) & F.array_contains("source_types", "pubmed"), F.col("id"))), first_given(c))
        return first_given(c)

    ranked = df.withColumn("_q", quality(F.col("source_types")))
    has_provenance = kinds.get("provenance", "").startswith("array<struct")
    extra = [F.max_by(F.element_at(F.when(F.size("provenance") > 0, F.col("provenance")), -1), rank).alias("_last")] if has_provenance else []
    # A struct of the cluster is never null, so that tables made by it are joined by it where they lie.
    by_cluster = F.struct("cluster")
    rows = ranked.groupBy(by_cluster.alias("_c")).agg(F.max_by(name, rank).alias("_best"), F.count("*").cast("int").alias("n_members"), *[survivor(c).alias(c) for c in singular], *extra).withColumn("cluster", F.col("_c")["cluster"])

    # Values of arrays and maps, each once: with the first place by id, and by the best member's value.
    made = [_entries(i, c, kinds[c]) for i, c in enumerate(united)]
    urls, own, named = len(united), len(united) + 1, len(united) + 2
    text = lambda i, k, v, at=0: F.struct(F.lit(i).alias("i"), k.alias("k"), v.alias("v"), F.lit(at).alias("at"))
    if "url" in have:
        made += [F.array(text(urls, F.col("url"), F.col("url")))]
    if "alternate_urls" in have:
        made += [F.transform("alternate_urls", lambda u, at: F.struct(F.lit(urls).alias("i"), u.alias("k"), u.alias("v"), (at + 1).cast("int").alias("at")))]
    linked = "preprint" in have and "doi" in have and "record_type" in have
    if linked:
        doi, published = normalize_doi(F.col("doi")), normalize_doi(F.col("preprint")["published_doi"])
        made += [F.array(text(own, F.when(F.col("record_type") == PUBLICATION, doi), doi)), F.array(text(named, F.concat_ws(" ", published, F.coalesce(doi, F.lit(""))), F.to_json(F.struct(published.alias("key"), doi.alias("value")))))]
    made = [F.coalesce(m, F.from_json(F.lit("[]"), "array<struct<i:int,k:string,v:string,at:int>>")) for m in made]
    values = ranked.select("cluster", "_q", "id", F.explode(F.flatten(F.array(*made))).alias("e")).where("e.k is not null and e.k <> '' and e.v is not null")
    values = values.groupBy("cluster", "e.i", "e.k").agg(F.min(F.struct("id", "e.at", "e.v")).alias("lo"), F.max(F.struct("_q", "id", "e.v")).alias("hi"))
    listed = lambda i: F.transform(F.array_sort(F.collect_list(F.when(F.col("i") == i, F.struct("lo", "k")))), lambda x: x["lo"]["v"])
    keyed = lambda i: F.map_from_entries(F.collect_list(F.when(F.col("i") == i, F.struct("k", "hi.v"))))
    lists = values.groupBy(by_cluster.alias("_c")).agg(*[(keyed(i) if i < len(united) and kinds[united[i]] == _TEXTS else listed(i)).alias(f"_u{i}") for i in range(len(united) + 3)])

    out = rows.join(lists, "_c", "left")
    strings = lambda i: F.coalesce(F.col(f"_u{i}"), F.array().cast(_STRINGS))
    pairs = lambda i: F.transform(strings(i), lambda s: F.from_json(s, "key string, value string"))
    journal = F.get(F.filter(strings(own), lambda d: F.exists(pairs(named), lambda p: p["key"] == d)), F.lit(0)) if linked else F.lit(None).cast("string")
    out = out.withColumn("_journal", journal)
    final = {}
    for i, c in enumerate(united):
        if kinds[c] == _TEXTS:
            final[c] = F.coalesce(F.col(f"_u{i}"), F.create_map().cast(_TEXTS))
        elif kinds[c] == _STRINGS:
            final[c] = strings(i)
        elif kinds[c] == _LISTS:
            left = F.transform(F.filter(pairs(named), lambda p: (p["key"] == F.col("_journal")) & (p["value"] != "")), lambda p: F.struct(F.lit(HAS_PREPRINT).alias("key"), p["value"].alias("value"))) if linked and c == "relations" else F.array().cast("array<struct<key:string,value:string>>")
            of = F.array_distinct(F.concat(pairs(i), left))
            keys = F.array_sort(F.array_distinct(F.transform(of, lambda p: p["key"])))
            final[c] = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.transform(F.filter(of, lambda p: p["key"] == k), lambda p: p["value"]))))
        else:
            final[c] = _structs(strings(i), df.schema[c].dataType.elementType.simpleString())
    if "alternate_urls" in have or "url" in have:
        final["alternate_urls"] = F.filter(strings(urls), lambda u: ~u.eqNullSafe(F.col("url"))) if "url" in have else strings(urls)
    if "doi" in have:
        final["doi"] = F.coalesce("_journal", "doi")
    if has_provenance and reasons is not None and "note" in df.schema["provenance"].dataType.elementType.names:
        why = reasons.where("cluster is not null").groupBy(by_cluster.alias("_c")).agg(F.array_join(F.array_sort(F.collect_set("reason")), ", ").alias("_reason"))
        out = out.join(why, "_c", "left")
        noted = F.when(F.col("_last").isNotNull() & F.col("_reason").isNotNull(), F.array(F.col("_last").withField("note", F.concat(F.lit("merged: "), "_reason"))))
        final["provenance"] = F.coalesce(F.concat(final["provenance"], noted), final["provenance"])
    out = out.select("cluster", "_best", "n_members", *[final.get(c, F.col(c)).alias(c) for c in [*have, *([] if "alternate_urls" in have or "url" not in have else ["alternate_urls"])]])
    return out.select("cluster", F.when(F.col("n_members") > 1, _made_id(out)).otherwise(F.col("_best")).alias("id"), *[c for c in out.columns if c not in ("cluster", "_best")])


def _structs(texts: Column, kind: str) -> Column:
    return F.transform(texts, lambda s: F.from_json(s, f"value {kind}", _TIMES)["value"])


def _made_id(df: DataFrame) -> Column:
    """Of the identifiers and names that df has, else the best member's id."""
    if "doi" not in df.columns:
        return F.col("_best")
    of = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    native = F.get(F.array_sort(F.map_entries("source_ids")), F.lit(0)) if dict(df.dtypes).get("source_ids") == _TEXTS else None
    days = [c for c in ("first_date", "published_date", "updated_date") if c in df.columns]
    year = F.year(F.coalesce(*days)).cast("string") if days else F.lit(None).cast("string")
    author = F.get(F.col("authors"), F.lit(0))["name"] if "authors" in df.columns else F.lit(None).cast("string")
    none = F.lit(None).cast("string")
    source, source_id = (native["key"], native["value"]) if native is not None else (none, none)
    strong = F.coalesce(normalize_doi(of("doi")), of("pmid"), of("nct_id"), source_id)
    return F.when(strong.isNotNull(), canonical_id(of("doi"), of("pmid"), of("nct_id"), source, source_id, of("title"), author, year)).otherwise(F.col("_best"))
