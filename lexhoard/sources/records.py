"""The one schema of records, and what brings the sources' tables to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from lexhoard.operators.history import EVENT
from lexhoard.sources.normalize import PROVENANCE

_LABELS = ["modalities", "delivery_systems", "disease_areas", "therapeutic_targets", "development_stages", "species", "methods", "topics", "companies", "institutions", "watched_people", "keywords", "mesh_terms", "publication_types", "exclusion_reasons", "alternate_urls"]
_ORGANIZATIONS = "array<struct<name:string,organization_type:string,ror_id:string>>"
#: Fields of a record. Arrays and maps are empty where a source has none, never null.
RECORD_SCHEMA = f"""
id string, record_type string, source_types array<string>, source_ids map<string,string>, title string, abstract string, description string,
authors array<struct<name:string,given_name:string,family_name:string,orcid:string,affiliations:array<string>>>, organizations {_ORGANIZATIONS}, funders {_ORGANIZATIONS},
journal_or_source string, publisher string, license_url string, relations map<string,array<string>>, doi string, pmid string, nct_id string, url string,
first_date date, published_date date, electronic_published_date date, updated_date date, retrieved_at timestamp, {", ".join(f"{c} array<string>" for c in _LABELS)},
date_precision map<string,string>, evidence_level string, version int, excluded boolean, provenance array<{PROVENANCE}>, field_sources map<string,string>, change_history array<{EVENT}>,
trial struct<official_title:string,brief_title:string,sponsor:string,conditions:array<string>,interventions:array<string>,intervention_aliases:array<string>,study_type:string,phase:array<string>,overall_status:string,enrollment:int,start_date:date,primary_completion_date:date,completion_date:date,
  locations:array<struct<facility:string,city:string,state:string,country:string>>,countries:array<string>,outcomes:array<struct<outcome_type:string,measure:string,description:string,time_frame:string>>,results_available:boolean>,
preprint struct<server:string,version:int,category:string,published_doi:string,publication_status:string>"""


def _conformed(c: Column, have: DataType, want: DataType) -> Column:
    """The value as the wanted type: fields of structs by name, at any depth; those that are missing are null, others are left out."""
    if isinstance(want, ArrayType) and isinstance(have, ArrayType):
        return F.transform(c, lambda x: _conformed(x, have.elementType, want.elementType))
    if isinstance(want, StructType) and isinstance(have, StructType):
        named = {f.name: f.dataType for f in have.fields}
        fields = [(_conformed(c[f.name], named[f.name], f.dataType) if f.name in named else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c.cast(want)


def as_records(df: DataFrame, schema: str = RECORD_SCHEMA) -> DataFrame:
    """df with the columns of the schema, in its order and types. Columns that the schema lacks go."""
    want = DataType.fromDDL(schema)
    have = {f.name: f.dataType for f in df.schema.fields}

    def column(name: str, kind: DataType) -> Column:
        value = _conformed(F.col(name), have[name], kind) if name in have else F.lit(None).cast(kind)
        empty = F.array() if isinstance(kind, ArrayType) else F.create_map() if isinstance(kind, MapType) else None
        value = value if empty is None else F.coalesce(value, empty.cast(kind))
        return F.coalesce(value, F.lit(False)) if name == "excluded" else F.coalesce(value, F.lit(1)) if name == "version" else value

    return df.select(*[column(f.name, f.dataType).alias(f.name) for f in want.fields])


def union_records(*tables: DataFrame) -> DataFrame:
    """The rows of all sources' tables as records."""
    return reduce(DataFrame.union, [as_records(t) for t in tables])
