"""Attribution of watched people to records."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexhoard.functions.text import ascii_fold, empty_to_null, normalize_orcid
from lexhoard.operators.select import clause_condition

#: A roster beyond this many name rows is joined by shuffle and not broadcast.
BROADCAST_NAMES = 200_000


def _parts(name: Column) -> Column:
    return F.split(ascii_fold(name), " ")


def _evidence_text(records: DataFrame) -> Column:
    """What affiliation terms may stand in besides an author's own affiliations: names of organizations, and institutions."""
    found = []
    if "organizations" in records.columns:
        found.append(F.col("organizations")["name"])
    if "institutions" in records.columns:
        found.append(F.col("institutions"))
    return F.concat_ws(" ", *found) if found else F.lit("")


def match_people(records: DataFrame, people: DataFrame) -> DataFrame:
    """(id, person, position): each person whose ORCID an author has, or whose family and full first given name an author has
    with affiliation evidence.

    records: id, authors array<struct<name, orcid, affiliations>>, where authors may have family_name and given_name, which go
    before name, and records organizations (with name) and institutions. people: person, position, orcid, aliases,
    affiliation_terms, require_affiliation, active. Names and affiliations are compared without case, accents and punctuation; an
    initial is no given name. A person without affiliation terms needs none unless required. Two equi-joins; the affiliation
    test runs on their hits only.
    """
    have = records.schema["authors"].dataType.elementType.names
    part = lambda field: F.coalesce(empty_to_null(F.col("a")[field]), F.col("a")["name"]) if field in have else F.col("a")["name"]
    own = F.array_join(F.coalesce(F.col("a")["affiliations"], F.array().cast("array<string>")), " ") if "affiliations" in have else F.lit("")
    authors = records.select("id", _evidence_text(records).alias("of_record"), F.explode("authors").alias("a"))
    authors = authors.select("id", normalize_orcid(F.col("a")["orcid"]).alias("orcid"), F.element_at(_parts(part("family_name")), -1).alias("family"), F.element_at(_parts(part("given_name")), 1).alias("given"), F.concat_ws(" ", own, "of_record").alias("affiliation"))
    active = people.where("active")
    by_orcid = active.select("person", "position", normalize_orcid(F.col("orcid")).alias("orcid")).where("orcid is not null")
    names = active.select("person", "position", "affiliation_terms", "require_affiliation", F.explode("aliases").alias("alias")).withColumn("alias", _parts(F.col("alias")))
    names = names.withColumn("family", F.element_at("alias", -1)).withColumn("given", F.element_at("alias", 1)).where("length(given) > 1 and size(alias) > 1")
    terms = F.transform(F.coalesce("affiliation_terms", F.array().cast("array<string>")), lambda t: t)
    names = _small(names.select("person", "position", "family", "given", F.posexplode_outer(terms).alias("at", "term"), F.coalesce("require_affiliation", F.lit(False)).alias("required")).withColumn("term", ascii_fold(F.col("term"))))
    first = authors.join(_small(by_orcid), "orcid").select("id", "person", "position")
    met = authors.join(names, ["family", "given"]).withColumn("affiliation", ascii_fold(F.col("affiliation")))
    second = met.where(F.when(F.col("term").isNotNull(), F.contains("affiliation", "term")).otherwise(F.col("at").isNull() & ~F.col("required"))).select("id", "person", "position")
    return first.union(second).distinct()


def _small(side: DataFrame) -> DataFrame:
    """Broadcast if it is short; a longer one is joined by shuffle."""
    return F.broadcast(side) if side.count() <= BROADCAST_NAMES else side


def watched_people(records: DataFrame, people: DataFrame) -> DataFrame:
    """(id, watched_people in roster order) of the records that have any."""
    return match_people(records, people).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "person"))), lambda x: x["person"]).alias("watched_people"))


def with_watched_people(records: DataFrame, people: DataFrame) -> DataFrame:
    """records with watched_people in roster order."""
    found = watched_people(records, people)
    return records.drop("watched_people").join(found, "id", "left").withColumn("watched_people", F.coalesce("watched_people", F.array().cast("array<string>")))


def discover_by_people(works: DataFrame, people: DataFrame, order: str | None = None) -> DataFrame:
    """Works with a watched author. With `order`, of works with one id the last one by it is looked at, and its body counts."""
    if order:
        body = F.struct(*works.columns)
        works = works.groupBy("id").agg(F.max_by(body, F.struct(order, F.to_json(body))).alias("_last")).select("_last.*")
    return works.join(match_people(works, people).select("id").distinct(), "id", "left_semi")


def discover(df: DataFrame, clauses: list[list[str]], people: DataFrame, since: date | str, until: date | str, text: Column, published: str, revised: str) -> DataFrame:
    """Records published or revised within the window that meet a clause (see `select.discovery_filter`) or have a watched author. Only
    records of the window are looked at for authors."""
    lo, hi = F.lit(str(since)).cast("date"), F.lit(str(until)).cast("date")
    inside = df.where(F.coalesce(F.col(published).between(lo, hi), F.lit(False)) | F.coalesce(F.col(revised).between(lo, hi), F.lit(False)))
    watched = match_people(inside, people).select("id").distinct().withColumn("_watched", F.lit(True))
    met = F.coalesce(clause_condition(clauses, text), F.lit(False))
    return inside.join(watched, "id", "left").where(met | F.coalesce("_watched", F.lit(False))).drop("_watched")
