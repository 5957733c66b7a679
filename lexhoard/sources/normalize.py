"""Normalizers from landed payloads to record rows. Each takes a DataFrame of payload structs with an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexhoard.functions.dates import parse_date_parts, parse_flexible_date
from lexhoard.functions.ids import identifier_urls, phase_label, raw_sha256
from lexhoard.functions.text import empty_to_null, extract_doi, html_to_text, normalize_doi, normalize_orcid, safe_url
from lexhoard.session import saved

_YMD = "STRUCT<Year:STRING,Month:STRING,Day:STRING>"
#: Titles and abstracts stay strings: the XML reader keeps inline markup in a string and would lose mixed content in a struct.
ARTICLE_SCHEMA = f"""
MedlineCitation STRUCT<PMID:STRUCT<_VALUE:STRING,_Version:STRING>,DateCreated:{_YMD},DateRevised:{_YMD},
  Article:STRUCT<Journal:STRUCT<JournalIssue:STRUCT<PubDate:{_YMD}>,Title:STRING>,ArticleTitle:STRING,Abstract:STRING,
    AuthorList:STRUCT<Author:ARRAY<STRUCT<LastName:STRING,ForeName:STRING,Initials:STRING,CollectiveName:STRING,
      Identifier:ARRAY<STRUCT<_VALUE:STRING,_Source:STRING>>,AffiliationInfo:ARRAY<STRUCT<Affiliation:STRING>>>>>,
    PublicationTypeList:STRUCT<PublicationType:ARRAY<STRING>>,ArticleDate:ARRAY<{_YMD}>>,
  MeshHeadingList:STRUCT<MeshHeading:ARRAY<STRUCT<DescriptorName:STRING>>>,KeywordList:ARRAY<STRUCT<Keyword:ARRAY<STRING>>>>,
PubmedData STRUCT<ArticleIdList:STRUCT<ArticleId:ARRAY<STRUCT<_VALUE:STRING,_IdType:STRING>>>,
  History:STRUCT<PubMedPubDate:ARRAY<STRUCT<_PubStatus:STRING,Year:STRING,Month:STRING,Day:STRING>>>>"""

_OUT, _DATE = "ARRAY<STRUCT<measure:STRING,description:STRING,timeFrame:STRING>>", "STRUCT<date:STRING>"
STUDY_SCHEMA = f"""
protocolSection STRUCT<identificationModule:STRUCT<nctId:STRING,briefTitle:STRING,officialTitle:STRING>,
  statusModule:STRUCT<overallStatus:STRING,startDateStruct:{_DATE},primaryCompletionDateStruct:{_DATE},completionDateStruct:{_DATE},studyFirstPostDateStruct:{_DATE},lastUpdatePostDateStruct:{_DATE}>,
  sponsorCollaboratorsModule:STRUCT<leadSponsor:STRUCT<name:STRING,class:STRING>,collaborators:ARRAY<STRUCT<name:STRING,class:STRING>>>,
  descriptionModule:STRUCT<briefSummary:STRING,detailedDescription:STRING>,conditionsModule:STRUCT<conditions:ARRAY<STRING>>,
  designModule:STRUCT<studyType:STRING,phases:ARRAY<STRING>,enrollmentInfo:STRUCT<count:INT,type:STRING>>,
  armsInterventionsModule:STRUCT<interventions:ARRAY<STRUCT<type:STRING,name:STRING,description:STRING,otherNames:ARRAY<STRING>>>>,
  outcomesModule:STRUCT<primaryOutcomes:{_OUT},secondaryOutcomes:{_OUT},otherOutcomes:{_OUT}>,
  contactsLocationsModule:STRUCT<locations:ARRAY<STRUCT<facility:STRING,city:STRING,state:STRING,country:STRING>>>>,
hasResults BOOLEAN"""

PREPRINT_PAGE_SCHEMA = """
collection ARRAY<STRUCT<doi:STRING,title:STRING,authors:STRING,author_corresponding:STRING,author_corresponding_institution:STRING,
  date:STRING,version:STRING,type:STRING,license:STRING,category:STRING,abstract:STRING,published:STRING>>"""

_PARTS = "STRUCT<`date-parts`:ARRAY<ARRAY<INT>>>"
WORK_SCHEMA = f"""
message STRUCT<DOI:STRING,title:ARRAY<STRING>,`container-title`:ARRAY<STRING>,publisher:STRING,`published-print`:{_PARTS},`published-online`:{_PARTS},
  published:{_PARTS},issued:{_PARTS},author:ARRAY<STRUCT<given:STRING,family:STRING,name:STRING,ORCID:STRING,affiliation:ARRAY<STRUCT<name:STRING>>>>,
  funder:ARRAY<STRUCT<name:STRING,DOI:STRING>>,license:ARRAY<STRUCT<URL:STRING>>,relation:MAP<STRING,ARRAY<STRUCT<id:STRING>>>,URL:STRING>"""

#: Children of an RSS item or an Atom entry; of both, what the other calls differently.
ENTRY_SCHEMA = """guid STRING, id STRING, title STRING, link ARRAY<STRUCT<_VALUE:STRING,_href:STRING,_rel:STRING>>, description STRING, summary STRING, content STRING, author ARRAY<STRING>,
`dc:creator` ARRAY<STRING>, doi STRING, `dc:identifier` STRING, pubDate STRING, published STRING, updated STRING, `dc:date` STRING"""
FEED_SCHEMA = "guid STRING, title STRING, link STRING, description STRING, author STRING, pubDate STRING"

_NONE = "array<string>"
_AUTHOR = "array<struct<name:string,given_name:string,family_name:string,orcid:string,affiliations:array<string>>>"


def _arr(c: Column, kind: str = _NONE) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def _plain(c: Column) -> Column:
    """Inner text of markup, white space collapsed; null if empty."""
    return F.get(F.filter(F.array(html_to_text(c, None)), lambda text: text != ""), F.lit(0))  # the text is worked out once


def _ymd(c: Column) -> Column:
    return parse_date_parts(c["Year"], c["Month"], c["Day"])


def _precision(**dates: Column) -> Column:
    """Map of field to precision, of the dates that are there."""
    return F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), d["precision"].alias("value")) for k, d in dates.items()]), lambda e: e["value"].isNotNull()))


#: Where a record comes from: one entry per source row that went into it.
PROVENANCE = "struct<source:string,source_id:string,url:string,retrieved_at:timestamp,fields:array<string>,raw_sha256:string,note:string>"
_ORGANIZATIONS = "array<struct<name:string,organization_type:string,ror_id:string>>"


def _carried(df: DataFrame) -> list[str]:
    """Columns of the landed row that go with the payload: the string as it came and the time of retrieval."""
    return [c for c in ("raw", "retrieved_at") if c in df.columns]


def _organizations(names: Column, kind: str) -> Column:
    none = F.lit(None).cast("string")
    return _arr(F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("organization_type"), none.alias("ror_id"))), _ORGANIZATIONS)


def _some(*urls: Column) -> Column:
    return F.filter(F.array(*urls), lambda u: u.isNotNull())


def _doi_url(doi: Column) -> Column:
    return F.concat(F.lit("https://doi.org/"), doi)


def _finished(out: DataFrame, source: Column, key: Column, source_id: Column, provenance_url: Column, fields: list[str], of_source: list[str], required: dict[str, Column], rejects: bool, note: Column | None = None) -> DataFrame:
    """Adds source_ids, field_sources, retrieved_at and provenance, with the SHA-256 of the landed string where there is one, and
    leaves out rows that lack what is required. With `rejects` they stay, and `reject` names what they lack."""
    text = F.lit(None).cast("string")
    at = F.col("retrieved_at").cast("timestamp") if "retrieved_at" in out.columns else F.lit(None).cast("timestamp")
    sha = raw_sha256(F.col("raw")) if "raw" in out.columns else text
    entry = F.struct(source.alias("source"), source_id.alias("source_id"), provenance_url.alias("url"), at.alias("retrieved_at"), F.array(*[F.lit(f) for f in fields]).alias("fields"), sha.alias("raw_sha256"), (text if note is None else note).alias("note"))
    lacks = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in required.items()]), lambda x: x.isNotNull())
    out = out.withColumn("reject", F.when(F.size(lacks) > 0, F.concat(F.lit("missing "), F.array_join(lacks, ", "))))
    out = out.withColumn("source_ids", F.when(source_id.isNotNull(), F.create_map(key, source_id))).withColumn("field_sources", F.map_from_arrays(F.array(*[F.lit(f) for f in of_source]), F.array_repeat(key, len(of_source))))
    out = out.withColumn("provenance", F.array(entry)).withColumn("retrieved_at", at)
    return out if rejects else out.where("reject is null").drop("reject", "raw")


def read_pubmed(spark: SparkSession, path: str) -> DataFrame:
    return normalize_pubmed(spark.read.format("xml").option("rowTag", "PubmedArticle").schema(ARTICLE_SCHEMA).load(path))


def normalize_pubmed(df: DataFrame, rejects: bool = False) -> DataFrame:
    """One record per article with a PMID and a title."""
    c, a = F.col("MedlineCitation"), F.col("MedlineCitation")["Article"]
    sections = F.regexp_extract_all(a["Abstract"], F.lit(r"(?s)(<AbstractText[^>]*>.*?</AbstractText>)"), F.lit(1))
    label = lambda s: empty_to_null(F.regexp_extract(s, r'Label="([^"]*)"', 1))
    section = lambda s: F.concat(F.coalesce(F.concat(label(s), F.lit(": ")), F.lit("")), F.coalesce(_plain(s), F.lit("")))
    abstract = F.when(F.size(sections) > 0, F.array_join(F.transform(sections, section), "\n")).otherwise(_plain(a["Abstract"]))
    given = lambda x: F.struct(
        F.coalesce(x["CollectiveName"], empty_to_null(F.trim(F.concat_ws(" ", x["ForeName"], x["LastName"])))).alias("name"),
        x["ForeName"].alias("given_name"),
        x["LastName"].alias("family_name"),
        normalize_orcid(F.get(F.filter(x["Identifier"], lambda i: i["_Source"] == "ORCID"), F.lit(0))["_VALUE"]).alias("orcid"),
        _arr(F.transform(x["AffiliationInfo"], lambda i: i["Affiliation"])).alias("affiliations"),
    )
    authors = _arr(F.filter(F.transform(a["AuthorList"]["Author"], given), lambda x: x["name"].isNotNull()), _AUTHOR)
    ids = F.col("PubmedData")["ArticleIdList"]["ArticleId"]
    of_kind = lambda kind: F.get(F.filter(ids, lambda i: i["_IdType"] == kind), F.lit(0))["_VALUE"]
    history = F.get(F.filter(F.col("PubmedData")["History"]["PubMedPubDate"], lambda h: h["_PubStatus"] == "epublish"), F.lit(0))
    # One lambda for all dates: five times its code would be more than a generated method may hold.
    part = lambda d: F.struct(d["Year"].alias("Year"), d["Month"].alias("Month"), d["Day"].alias("Day"))
    read = df.withColumn("_days", F.transform(F.array(*[part(d) for d in (a["Journal"]["JournalIssue"]["PubDate"], F.get(a["ArticleDate"], F.lit(0)), history, c["DateCreated"], c["DateRevised"])]), _ymd))
    at = lambda i: F.get(F.col("_days"), F.lit(i))
    dates = read.select("*", at(0).alias("_print"), F.coalesce(at(1), at(2)).alias("_online"), at(3).alias("_created"), at(4).alias("_revised")).withColumn("_first", F.array_min(F.filter(F.array("_print", "_online", "_created"), lambda d: d["value"].isNotNull())))
    pmid = F.trim(c["PMID"]["_VALUE"])
    affiliations = F.array_distinct(F.flatten(F.transform("authors", lambda x: x["affiliations"])))
    out = dates.select(
        pmid.alias("pmid"), _plain(a["ArticleTitle"]).alias("title"), abstract.alias("abstract"), authors.alias("authors"), normalize_doi(of_kind("doi")).alias("doi"),
        _plain(a["Journal"]["Title"]).alias("journal_or_source"), _arr(a["PublicationTypeList"]["PublicationType"]).alias("publication_types"),
        _arr(F.transform(c["MeshHeadingList"]["MeshHeading"], lambda m: m["DescriptorName"])).alias("mesh_terms"), _arr(F.flatten(F.transform(c["KeywordList"], lambda k: k["Keyword"]))).alias("keywords"),
        F.col("_print")["value"].alias("published_date"), F.col("_online")["value"].alias("electronic_published_date"), F.col("_revised")["value"].alias("updated_date"),
        F.col("_first")["value"].alias("first_date"),
        _precision(published_date=F.col("_print"), electronic_published_date=F.col("_online"), first_date=F.col("_first"), updated_date=F.col("_revised")).alias("date_precision"), *_carried(df),
    )
    none = F.lit(None).cast("string")
    url = F.get(identifier_urls(none, F.col("pmid"), none), F.lit(0))
    out = out.select(
        F.coalesce(F.concat(F.lit("doi:"), "doi"), F.concat(F.lit("pmid:"), "pmid")).alias("id"), F.lit("publication").alias("record_type"), F.array(F.lit("pubmed")).alias("source_types"), "*", _organizations(affiliations, "affiliation").alias("organizations"),
        affiliations.alias("institutions"), url.alias("url"), _some(_doi_url(F.col("doi"))).alias("alternate_urls"), F.lit("peer-reviewed publication").alias("evidence_level"),
    )
    fields = ["title", "abstract", "authors", "journal_or_source", "publication_types", "mesh_terms", "keywords"]
    of_source = ["title", "abstract", "authors", "journal_or_source", "doi", "published_date"]
    return _finished(out, F.lit("pubmed"), F.lit("pubmed"), F.col("pmid"), url, fields, of_source, {"pmid": F.col("pmid") != "", "title": F.col("title").isNotNull()}, rejects)


def normalize_trials(df: DataFrame, rejects: bool = False) -> DataFrame:
    """One record per study with a registry number and a title."""
    p = F.col("protocolSection")
    i, s, d, o = p["identificationModule"], p["statusModule"], p["designModule"], p["outcomesModule"]
    day = lambda x: parse_flexible_date(x["date"])
    arms = p["armsInterventionsModule"]["interventions"]
    kind = "array<struct<outcome_type:string,measure:string,description:string,time_frame:string>>"
    outcome = lambda name: lambda x: F.struct(F.lit(name).alias("outcome_type"), x["measure"].alias("measure"), x["description"].alias("description"), x["timeFrame"].alias("time_frame"))
    outcomes = F.concat(*[_arr(F.transform(o[f"{n}Outcomes"], outcome(n)), kind) for n in ("primary", "secondary", "other")])
    locations = p["contactsLocationsModule"]["locations"]
    conditions = _arr(p["conditionsModule"]["conditions"])
    organizations = F.filter(
        F.concat(F.array(F.struct(p["sponsorCollaboratorsModule"]["leadSponsor"]["name"].alias("name"), F.lit("sponsor").alias("organization_type"))),
                 _arr(F.transform(p["sponsorCollaboratorsModule"]["collaborators"], lambda c: F.struct(c["name"].alias("name"), F.lit("collaborator").alias("organization_type"))), "array<struct<name:string,organization_type:string>>")),
        lambda x: x["name"].isNotNull(),
    )
    dates = {"start_date": s["startDateStruct"], "primary_completion_date": s["primaryCompletionDateStruct"], "completion_date": s["completionDateStruct"], "first_date": s["studyFirstPostDateStruct"], "updated_date": s["lastUpdatePostDateStruct"]}
    read = df.withColumn("_days", F.transform(F.array(*dates.values()), day))
    base = read.select("*", *[F.get(F.col("_days"), F.lit(at)).alias(f"_{k}") for at, k in enumerate(dates)])
    trial = F.struct(
        i["officialTitle"].alias("official_title"), i["briefTitle"].alias("brief_title"), p["sponsorCollaboratorsModule"]["leadSponsor"]["name"].alias("sponsor"), conditions.alias("conditions"),
        _arr(F.transform(arms, lambda x: x["name"])).alias("interventions"), _arr(F.flatten(F.transform(arms, lambda x: _arr(x["otherNames"])))).alias("intervention_aliases"), d["studyType"].alias("study_type"),
        _arr(F.array_distinct(F.transform(d["phases"], phase_label))).alias("phase"), s["overallStatus"].alias("overall_status"), d["enrollmentInfo"]["count"].alias("enrollment"),
        *[F.col(f"_{k}")["value"].alias(k) for k in ("start_date", "primary_completion_date", "completion_date")], locations.alias("locations"),
        _arr(F.array_sort(F.array_distinct(F.filter(F.transform(locations, lambda x: x["country"]), lambda x: x.isNotNull())))).alias("countries"), outcomes.alias("outcomes"), F.coalesce("hasResults", F.lit(False)).alias("results_available"),
    )
    nct = F.upper(F.trim(i["nctId"]))
    lead, others = p["sponsorCollaboratorsModule"]["leadSponsor"]["name"], _arr(F.transform(p["sponsorCollaboratorsModule"]["collaborators"], lambda c: c["name"]))
    out = base.select(
        F.concat(F.lit("nct:"), nct).alias("id"), F.lit("clinical_trial").alias("record_type"), F.array(F.lit("clinicaltrials")).alias("source_types"), nct.alias("nct_id"),
        F.coalesce(empty_to_null(F.trim(i["officialTitle"])), empty_to_null(F.trim(i["briefTitle"]))).alias("title"), p["descriptionModule"]["briefSummary"].alias("abstract"), p["descriptionModule"]["detailedDescription"].alias("description"),
        conditions.alias("keywords"), organizations.alias("organizations"), trial.alias("trial"), trial["phase"].alias("development_stages"), F.col("_first_date")["value"].alias("first_date"), F.col("_updated_date")["value"].alias("updated_date"),
        _precision(**{k: F.col(f"_{k}") for k in dates}).alias("date_precision"), F.concat(F.lit("https://clinicaltrials.gov/study/"), nct).alias("url"),
        F.when(F.col("hasResults"), "trial results").otherwise("trial registration").alias("evidence_level"), F.lit(1).alias("version"), F.col("_first_date")["value"].alias("published_date"), F.lit("ClinicalTrials.gov").alias("journal_or_source"),
        _some(lead).alias("companies"), F.filter(others, lambda n: n.isNotNull()).alias("institutions"), *_carried(df),
    )
    fields = ["title", "abstract", "description", "organizations", "trial"]
    return _finished(out, F.lit("clinicaltrials"), F.lit("clinicaltrials"), F.col("nct_id"), F.col("url"), fields, fields, {"nct_id": F.col("nct_id") != "", "title": F.col("title").isNotNull()}, rejects)


def normalize_preprints(df: DataFrame, server: str, rejects: bool = False) -> DataFrame:
    """One record per version of a preprint with DOI and title. All dates are the posting date. What is hashed is the item of the
    landed page."""
    x = F.col("x")
    split = F.when(F.contains(x["authors"], F.lit(";")), F.split(x["authors"], ";")).otherwise(F.split(x["authors"], ","))
    names = _arr(F.filter(F.transform(split, lambda n: F.trim(n)), lambda n: n != ""))
    published = F.when(~F.lower(F.trim(x["published"])).isin("", "na", "n/a", "none"), normalize_doi(x["published"]))
    doi, version, day = normalize_doi(x["doi"]), F.greatest(F.coalesce(x["version"].try_cast("int"), F.lit(1)), F.lit(1)), F.try_to_date(x["date"], "yyyy-MM-dd")
    place = F.filter(F.array(empty_to_null(F.trim(x["author_corresponding_institution"]))), lambda n: n.isNotNull())
    kept = [c for c in _carried(df) if c != "raw"]
    precision = F.when(day.isNotNull(), F.create_map(F.lit("first_date"), F.lit("day"), F.lit("published_date"), F.lit("day"))).otherwise(F.create_map().cast("map<string,string>"))
    out = df.select(F.explode("collection").alias("x"), *kept).select(
        F.concat(F.lit("doi:"), doi).alias("id"), F.lit("preprint").alias("record_type"), F.array(F.lit(server)).alias("source_types"), doi.alias("doi"), empty_to_null(F.trim(x["title"])).alias("title"), x["abstract"].alias("abstract"),
        F.transform(names, lambda n: F.struct(n.alias("name"))).alias("authors"), day.alias("first_date"), day.alias("published_date"), day.alias("updated_date"),
        F.struct(F.lit(server).alias("server"), version.alias("version"), x["category"].alias("category"), published.alias("published_doi"), F.when(published.isNotNull(), "published").otherwise("preprint").alias("publication_status")).alias("preprint"),
        F.concat(F.lit(f"https://www.{server}.org/content/"), doi, F.lit("v"), version.cast("string")).alias("url"), F.lit("preprint").alias("evidence_level"), version.alias("version"),
        empty_to_null(F.trim(x["author_corresponding"])).alias("corresponding_author"), _organizations(place, "affiliation").alias("organizations"), place.alias("institutions"), _some(empty_to_null(F.trim(x["category"]))).alias("keywords"), F.lit(server).alias("journal_or_source"),
        _some(_doi_url(doi), _doi_url(published)).alias("alternate_urls"), precision.alias("date_precision"), *kept, *([F.to_json("x").alias("raw")] if "raw" in df.columns or rejects else []),
    )
    fields, of_source = ["title", "abstract", "authors", "published_date", "preprint"], ["title", "abstract", "authors", "published_date", "doi"]
    return _finished(out, F.lit(server), F.lit(server), F.col("doi"), F.col("url"), fields, of_source, {"doi": F.col("doi").isNotNull(), "title": F.col("title").isNotNull()}, rejects)


def normalize_crossref(df: DataFrame, rejects: bool = False) -> DataFrame:
    """One record per work with DOI and title."""
    m = F.col("message")

    def parts(name: str) -> Column:
        part = lambda n: F.get(F.get(m[name]["date-parts"], F.lit(0)), F.lit(n)).cast("string")
        return F.struct(part(0).alias("Year"), part(1).alias("Month"), part(2).alias("Day"))

    # One lambda for all dates, and a column of the one that counts: in each place it is used its code would be too much to compile.
    kinds = ["published-print", "published-online", "published", "issued"]
    read = df.withColumn("_days", F.transform(F.array(*[parts(k) for k in kinds]), _ymd))
    read = read.withColumn("_date", F.get(F.filter("_days", lambda d: d.isNotNull()), F.lit(0)))
    name = lambda a: F.coalesce(empty_to_null(F.trim(F.concat_ws(" ", a["given"], a["family"]))), a["name"])
    author = lambda a: F.struct(name(a).alias("name"), a["given"].alias("given_name"), a["family"].alias("family_name"), F.element_at(F.split(a["ORCID"], "/"), -1).alias("orcid"), _arr(F.transform(a["affiliation"], lambda x: x["name"])).alias("affiliations"))
    authors = _arr(F.filter(F.transform(m["author"], author), lambda a: a["name"].isNotNull()), _AUTHOR)
    relations = F.map_filter(F.transform_values(m["relation"], lambda k, v: F.filter(F.transform(v, lambda r: r["id"]), lambda r: r.isNotNull())), lambda k, v: F.size(v) > 0)
    date, doi = F.col("_date"), normalize_doi(m["DOI"])
    places = F.array_distinct(F.flatten(F.transform(authors, lambda a: a["affiliations"])))
    none = F.lit(None).cast("string")
    funder = lambda f: F.struct(f["name"].alias("name"), F.lit("funder").alias("organization_type"), _doi_url(f["DOI"]).alias("ror_id"))
    url = F.coalesce(m["URL"], _doi_url(doi))
    out = read.select(
        F.concat(F.lit("doi:"), doi).alias("id"), F.lit("publication").alias("record_type"), F.array(F.lit("crossref")).alias("source_types"), doi.alias("doi"), _plain(F.get(m["title"], F.lit(0))).alias("title"),
        F.get(m["container-title"], F.lit(0)).alias("journal_or_source"), m["publisher"].alias("publisher"), authors.alias("authors"), _arr(places).alias("institutions"), _organizations(places, "affiliation").alias("organizations"),
        _arr(F.filter(F.transform(m["funder"], funder), lambda f: f["name"].isNotNull()), _ORGANIZATIONS).alias("funders"), relations.alias("relations"), F.get(m["license"], F.lit(0))["URL"].alias("license_url"), url.alias("url"),
        F.filter(F.array(_doi_url(doi)), lambda u: u != url).alias("alternate_urls"), date["value"].alias("first_date"), date["value"].alias("published_date"), _precision(first_date=date, published_date=date).alias("date_precision"), F.lit("peer-reviewed publication").alias("evidence_level"), *_carried(df),
    )
    fields = ["title", "authors", "journal_or_source", "publisher", "published_date", "doi"]
    api = F.get(F.filter(identifier_urls(F.col("doi"), none, none), lambda u: F.contains(u, F.lit("/works/"))), F.lit(0))
    return _finished(out, F.lit("crossref"), F.lit("crossref"), F.col("doi"), api, fields, fields, {"doi": F.col("doi").isNotNull(), "title": F.col("title").isNotNull()}, rejects)


def _feed_day(c: Column) -> Column:
    """(value, precision) of a feed's date: as mail headers or ISO texts have it, else as `parse_flexible_date` reads it."""
    mail = F.to_date(F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.trim(c), r"^\w{3},\s*", ""), r"(?:GMT|UTC?|Z)$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z")))
    day = F.coalesce(mail, F.try_to_date(F.substring(F.trim(c), 1, 10), "yyyy-MM-dd"))
    return F.when(day.isNotNull(), F.struct(day.alias("value"), F.lit("day").alias("precision"))).otherwise(parse_flexible_date(F.trim(c)))


def normalize_feeds(df: DataFrame, feeds: DataFrame, per_feed: int | None = None, rejects: bool = False) -> DataFrame:
    """One record per item of any feed with a title and an http(s) link.

    df: `feed` and the fields of ENTRY_SCHEMA, RSS items and Atom entries alike. feeds: name, source_type, attribution; a feed that it
    lacks counts as news without attribution. `per_feed`: the newest so many items of each feed (by date, then id).
    """
    # Written, so that its size is known before the join, and the rows aren't shuffled by feed.
    told = saved(feeds.groupBy(F.col("name").alias("feed")).agg(F.min("source_type").alias("_type"), F.min("attribution").alias("_by")))
    joined = df.join(told, "feed", "left").withColumn("_type", F.coalesce("_type", F.lit("news")))
    one = lambda *c: F.coalesce(*[empty_to_null(F.trim(x)) for x in c])
    plain = lambda c, most: empty_to_null(html_to_text(c, most))
    alternate = F.get(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))
    link = one(alternate["_href"], alternate["_VALUE"])
    people = F.filter(F.transform(F.concat(_arr(F.col("author")), _arr(F.col("dc:creator"))), lambda a: plain(F.regexp_replace(a, r"(?s)<(email|uri)>.*?</\1>", " "), 300)), lambda n: n.isNotNull())
    native = F.coalesce(one("guid", "id"), link)
    rows = joined.select(
        "feed", "_type", "_by", native.alias("native"), plain(F.col("title"), 500).alias("title"), plain(one("summary", "description", "content"), 1200).alias("description"), link.alias("url"), F.transform(people, lambda n: F.struct(n.alias("name"))).alias("authors"),
        extract_doi(F.col("doi"), F.col("`dc:identifier`"), F.coalesce("guid", "id"), link).alias("doi"), _feed_day(one("pubDate", "published", "`dc:date`")).alias("_published"), _feed_day(F.col("updated")).alias("_updated"), *_carried(df),
    )
    regulatory = F.col("_type") == "regulatory"
    out = rows.select(
        F.coalesce(F.concat(F.lit("doi:"), "doi"), F.concat(F.lit("rss:"), "native")).alias("id"), F.when(regulatory, "regulatory").otherwise("news").alias("record_type"), F.array(F.lit("rss"), "_type").alias("source_types"), "native", "title", "description", "authors",
        _organizations(_some(F.col("_by")), "publisher").alias("organizations"), F.col("feed").alias("journal_or_source"), F.col("_by").alias("publisher"), "doi", "url", _some(_doi_url(F.col("doi"))).alias("alternate_urls"),
        F.coalesce(F.col("_published")["value"], F.col("_updated")["value"]).alias("first_date"), F.col("_published")["value"].alias("published_date"), F.col("_updated")["value"].alias("updated_date"),
        _precision(published_date=F.col("_published"), first_date=F.col("_published"), updated_date=F.col("_updated")).alias("date_precision"), F.when(regulatory, "regulatory document").otherwise("news or announcement").alias("evidence_level"), *_carried(df),
    )
    fields = ["title", "description", "authors", "published_date", "updated_date"]
    key = F.concat(F.lit("rss:"), "journal_or_source")
    out = _finished(out, F.lit("rss"), key, F.col("native"), F.col("url"), fields, fields, {"title": F.col("title").isNotNull(), "http(s) link": safe_url(F.col("url")).isNotNull()}, True)
    if per_feed is not None:
        newest = Window.partitionBy("journal_or_source", F.col("reject").isNull()).orderBy(F.col("first_date").desc_nulls_last(), "native")
        out = out.withColumn("_n", F.row_number().over(newest)).where(f"_n <= {per_feed} or reject is not null").drop("_n")
    return out.drop("native") if rejects else out.where("reject is null").drop("native", "reject", "raw")


def normalize_feed(df: DataFrame, name: str, source_type: str = "news") -> DataFrame:
    """`normalize_feeds` for plain rows of one RSS feed (FEED_SCHEMA)."""
    none = F.lit(None).cast("string")
    rows = df.select(
        F.lit(name).alias("feed"), "guid", none.alias("id"), "title", F.array(F.struct(F.col("link").alias("_VALUE"), none.alias("_href"), none.alias("_rel"))).alias("link"), "description", none.alias("summary"), none.alias("content"), F.array("author").alias("author"), F.array().cast(_NONE).alias("dc:creator"),
        none.alias("doi"), none.alias("dc:identifier"), "pubDate", none.alias("published"), none.alias("updated"), none.alias("dc:date"), *_carried(df),
    )
    return normalize_feeds(rows, df.sparkSession.createDataFrame([(name, source_type, None)], "name string, source_type string, attribution string"))


def read_records(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines. Strict: a bad line is an error; else it comes out in _corrupt_record."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def write_records(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """In id order over range-partitioned files."""
    df.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").format(fmt).save(path)


__all__ = ["normalize_crossref", "normalize_feed", "normalize_feeds", "normalize_preprints", "normalize_pubmed", "normalize_trials", "read_pubmed", "read_records", "write_records"]
