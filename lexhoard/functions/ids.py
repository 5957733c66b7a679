"""Identifiers, hashes and identifier URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from lexhoard.functions.text import empty_to_null, normalize_doi, normalize_title

#: Fields that differ from run to run or follow from classification, left out of a fingerprint.
FINGERPRINT_EXCLUDES = [
    "retrieved_at", "provenance", "modalities", "delivery_systems", "disease_areas", "therapeutic_targets", "development_stages", "species", "methods", "topics",
    "companies", "institutions", "classification_method", "classification_evidence", "score_components", "relevance_score", "excluded", "exclusion_reasons",
]
#: Registry phase codes and their labels.
PHASES = {"EARLY_PHASE1": "Phase 1", "PHASE1": "Phase 1", "PHASE1|PHASE2": "Phase 1/2", "PHASE2": "Phase 2", "PHASE2|PHASE3": "Phase 2/3", "PHASE3": "Phase 3"}


def canonical_id(doi: Column, pmid: Column, nct_id: Column, source: Column, source_id: Column, title: Column, first_author: Column, year: Column) -> Column:
    """By DOI, else PMID, else trial number, else source and its id, else a hash of title, author, source and year."""
    given = lambda c: empty_to_null(F.trim(F.coalesce(c, F.lit(""))))
    text = F.concat_ws("|", F.coalesce(normalize_title(title, unicode_forms=False), F.lit("")), F.lower(F.trim(F.coalesce(first_author, F.lit("")))), F.coalesce(source, F.lit("")), F.coalesce(year, F.lit("")))
    return F.coalesce(
        F.concat(F.lit("doi:"), normalize_doi(doi)),
        F.concat(F.lit("pmid:"), given(pmid)),
        F.concat(F.lit("nct:"), F.upper(given(nct_id))),
        F.concat(source, F.lit(":"), given(source_id)),
        F.concat(F.lit("sha256:"), F.sha2(text, 256)),
    )


def _holds_map(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, MapType) or (isinstance(kind, ArrayType) and _holds_map(kind.elementType))


def canonical_form(c: Column, kind: DataType) -> Column:
    """The value with all maps in it, at any depth, as arrays of entries sorted by key, and the fields of structs in name order, so that equal contents have one form."""
    if not _holds_map(kind) and not isinstance(kind, StructType | ArrayType):
        return c
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: canonical_form(x, kind.elementType))
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(c.isNotNull(), F.struct(*[canonical_form(c[f.name], f.dataType).alias(f.name) for f in fields]))
    entry = lambda e: F.struct(canonical_form(e["key"], kind.keyType).alias("key"), canonical_form(e["value"], kind.valueType).alias("value"))
    return F.array_sort(F.transform(F.map_entries(c), entry))


def content_fingerprint(df: DataFrame, excludes: list[str] = FINGERPRINT_EXCLUDES) -> Column:
    """SHA-256 over all other fields in name order, nulls included. Neither the order of columns nor that of the fields of structs
    or of the entries of maps, in whatever they lie, counts."""
    fields = sorted((f for f in df.schema.fields if f.name not in excludes), key=lambda f: f.name)
    return F.sha2(F.to_json(F.struct(*[canonical_form(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields]), {"ignoreNullFields": "false"}), 256)


def raw_sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def phase_label(c: Column) -> Column:
    """Of one registry code; `unknown` for others."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PHASES.items() for x in kv]), F.upper(c)), F.lit("unknown"))


def identifier_urls(doi: Column, pmid: Column, nct_id: Column) -> Column:
    """Array of the URLs that the given identifiers have."""
    urls = F.array(
        F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")),
        F.concat(F.lit("https://doi.org/"), doi),
        F.concat(F.lit("https://clinicaltrials.gov/study/"), nct_id),
        F.concat(F.lit("https://api.crossref.org/works/"), F.replace(F.url_encode(doi), F.lit("+"), F.lit("%20"))),
    )
    return F.filter(urls, lambda u: u.isNotNull())


def array_union_ordered(*cols: Column) -> Column:
    """Union in first-seen order, without nulls and empty strings."""
    none = F.array().cast("array<string>")
    return F.filter(F.array_distinct(F.concat(*[F.coalesce(c, none) for c in cols])), lambda x: x.isNotNull() & (x != ""))


def array_distinct_structs(*cols: Column) -> Column:
    return F.array_distinct(F.concat(*cols))


def map_union_arrays(a: Column, b: Column) -> Column:
    """Union by key; the arrays of a key are joined in order, without repeats."""
    none = F.array().cast("array<string>")
    return F.map_zip_with(a, b, lambda k, x, y: F.array_distinct(F.concat(F.coalesce(x, none), F.coalesce(y, none))))
