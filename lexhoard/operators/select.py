"""Filters, faceted search, sorting, paging and flat views over records."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexhoard.functions.dates import display_date, in_last_days, retention_date
from lexhoard.functions.text import search_normalize

#: Credential patterns by label.
SECRETS = {
    "private key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "OpenAI-style API key": r"\bsk-(?:proj-|svcacct-)?[A-Za-z0-9_-]{20,}\b",
    "GitHub token": r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{30,}\b",
    "GitHub fine-grained token": r"\bgithub_pat_[A-Za-z0-9_]{20,}\b",
    "AWS access key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "assigned API key": r"(?im)\b(?:OPENAI_API_KEY|API_KEY|ACCESS_TOKEN|CLIENT_SECRET)\s*[:=]\s*[\"']?(?!\s|false\b|none\b|null\b)[A-Za-z0-9_./+=-]{16,}",
}
#: Words that mark companies and academic bodies.
COMPANY_WORDS = r"(?i)\b(?:inc|incorporated|llc|ltd|limited|corp|corporation|company|pharma|pharmaceuticals|biotech|therapeutics)\b"
ACADEMIC_WORDS = r"(?i)\b(?:university|college|school|institute|hospital|medical center|academy)\b"


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def apply_query_scope(df: DataFrame, include: list[str], exclude: list[str] = (), fields: tuple[str, ...] = ("title", "abstract"), keywords: str | None = "keywords", spared: list[str] = ()) -> DataFrame:
    """Keeps rows whose text holds an include term (plain substring, any case). Rows that also hold exclusion terms get excluded
    = true and sorted reasons, in place of earlier ones. `spared` exclusion terms don't count."""
    parts = [F.coalesce(F.col(f), F.lit("")) for f in fields]
    if keywords:
        parts.append(F.array_join(F.coalesce(F.col(keywords), F.array().cast("array<string>")), " "))
    text = F.lower(F.concat_ws(" ", *parts))
    hits = F.array(*[F.when(F.contains(text, F.lit(t.lower())), F.lit(f"matched exclusion term: {t}")) for t in exclude if t not in spared]) if exclude else F.array().cast("array<string>")
    reasons = F.array_sort(F.array_distinct(F.filter(hits, lambda x: x.isNotNull())))
    kept = df.where(_any([F.contains(text, F.lit(t.lower())) for t in include])).withColumn("_reasons", reasons)
    excluded = F.size("_reasons") > 0
    old = F.col("excluded") if "excluded" in df.columns else F.lit(False)
    before = F.col("exclusion_reasons") if "exclusion_reasons" in df.columns else F.array().cast("array<string>")
    return kept.withColumn("excluded", excluded | old).withColumn("exclusion_reasons", F.when(excluded, F.col("_reasons")).otherwise(before)).drop("_reasons")


def clause_condition(clauses: list[list[str]], text: Column) -> Column:
    """Whether all phrases of any clause stand in the text, as words."""
    quoted = lambda p: r"(?iU)\b" + "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in p) + r"\b"
    every = []
    for clause in clauses:
        c = F.lit(True)
        for phrase in clause:
            c = c & text.rlike(quoted(phrase))
        every.append(c)
    return _any(every)


def discovery_filter(df: DataFrame, clauses: list[list[str]], since: date | str, until: date | str, text: Column, published: str, revised: str) -> DataFrame:
    """Any clause (all of its phrases, as words) in the text, and published or revised within the window. With watched authors
    beside the clauses: `people.discover`."""
    lo, hi = F.lit(str(since)).cast("date"), F.lit(str(until)).cast("date")
    return df.where(clause_condition(clauses, text) & _any([F.col(published).between(lo, hi), F.col(revised).between(lo, hi)]))


def trial_filter(df: DataFrame, terms: list[str], since: date | str, until: date | str, text: Column, study_type: str = "study_type", updated: str = "updated_date") -> DataFrame:
    found = _any([F.contains(F.lower(text), F.lit(t.lower())) for t in terms])
    return df.where(found & (F.upper(study_type) == "INTERVENTIONAL") & F.col(updated).between(F.lit(str(since)).cast("date"), F.lit(str(until)).cast("date")))


def window_filter(df: DataFrame, since: date | str, until: date | str, column: str, keep_null: bool = True) -> DataFrame:
    within = F.col(column).between(F.lit(str(since)).cast("date"), F.lit(str(until)).cast("date"))
    return df.where(F.col(column).isNull() | within if keep_null else within)


def retain_recent(df: DataFrame, as_of: date | str, days: int, when: Column | None = None) -> DataFrame:
    """Rows whose retention date is within the last `days` days up to as_of; rows without one go."""
    return df.where(in_last_days(retention_date() if when is None else when, as_of, days))


def last_days(df: DataFrame, as_of: date | str, n: int, column: str) -> DataFrame:
    return df.where(in_last_days(F.col(column), as_of, n))


def search_text(df: DataFrame) -> Column:
    """Normalised text of the fields that the search covers, for those that the table has."""
    parts = [F.col(c) for c in ("title", "abstract", "description") if c in df.columns]
    parts += [F.array_join(F.col(c)["name"], " ") for c in ("authors", "organizations") if c in df.columns]
    parts += [F.array_join(c, " ") for c in ("companies", "institutions", "watched_people", "therapeutic_targets", "modalities", "delivery_systems", "disease_areas") if c in df.columns]
    parts += [F.col(c) for c in ("doi", "pmid", "nct_id") if c in df.columns]
    return search_normalize(F.concat_ws(" ", *parts))


def search(df: DataFrame, query: str, column: str = "search_text") -> DataFrame:
    """Every word of the query is a substring of the normalised text."""
    import re
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFKD", query) if not unicodedata.combining(c)).lower()
    out = df
    for term in re.findall(r"[^\W_]+", plain):
        out = out.where(F.contains(F.col(column), F.lit(term)))
    return out


def technology(value: str) -> Column:
    has = F.array_contains
    if value in ("mRNA", "siRNA", "ASO"):
        return has("modalities", value)
    if value == "CRISPR":
        return has("modalities", "CRISPR RNA") | has("topics", "CRISPR")
    if value == "base editing":
        return has("topics", "base editing")
    if value == "gene editing":
        return F.arrays_overlap("topics", F.array(*[F.lit(x) for x in ("gene editing", "base editing", "CRISPR")]))
    return F.lit(False)


def industry() -> Column:
    names = F.concat_ws(" ", F.array_join("companies", " "), F.array_join(F.col("organizations")["name"], " "))
    return (F.size("companies") > 0) | names.rlike(COMPANY_WORDS)


def academic() -> Column:
    return (F.size("institutions") > 0) | F.exists("organizations", lambda o: (o["organization_type"] == "affiliation") & o["name"].rlike(ACADEMIC_WORDS))


def presets() -> dict[str, Column]:
    """Conditions of the named views."""
    has, starts = F.array_contains, lambda p: F.exists("development_stages", lambda s: s.startswith(p))
    return {
        "mrna": has("modalities", "mRNA"),
        "sirna": has("modalities", "siRNA"),
        "aso": has("modalities", "ASO"),
        "crispr": technology("CRISPR"),
        "base-editing": technology("base editing"),
        "industry": industry(),
        "academic": academic(),
        "clinical": (F.col("record_type") == "clinical_trial") | starts("Phase"),
        "preclinical": starts("preclinical"),
        "delivery": (F.size("delivery_systems") > 0) | has("topics", "delivery"),
        "regulatory": (F.col("record_type") == "regulatory") | (F.col("evidence_level") == "regulatory document") | has("topics", "regulation"),
        "aptamers": has("modalities", "aptamer"),
        "nanotechnology": has("modalities", "RNA nanostructure"),
        "trial-changes": (F.col("record_type") == "clinical_trial") & (F.size("change_history") > 0),
        "watched-authors": F.size("watched_people") > 0,
    }


def preset(name: str) -> Column:
    """Condition of a named view; unknown names hold for all rows."""
    return presets().get(name, F.lit(True))


#: Technologies that records can be filtered by.
TECHNOLOGIES = ["mRNA", "siRNA", "ASO", "CRISPR", "base editing", "gene editing"]


def matched_views(df: DataFrame) -> DataFrame:
    """df with `views`, the named views and technologies that each record belongs to, found in one pass."""
    named = presets() | {f"technology {t}": technology(t) for t in TECHNOLOGIES}
    return df.withColumn("views", F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in named.items()]), lambda x: x.isNotNull()))


def technology_filter(df: DataFrame, value: str) -> DataFrame:
    return df.where(technology(value))


def preset_filter(df: DataFrame, name: str) -> DataFrame:
    return df.where(preset(name))


def industry_filter(df: DataFrame) -> DataFrame:
    return df.where(industry())


def academic_filter(df: DataFrame) -> DataFrame:
    return df.where(academic())


def filter_records(df: DataFrame, *, text: str | None = None, view: str | None = None, tech: str | None = None, date_from: str | None = None, date_to: str | None = None, min_score: float = 0, equal: dict[str, str] | None = None, member: dict[str, str] | None = None, when: Column | None = None) -> DataFrame:
    """Rows that aren't excluded and meet all criteria given. A row without a date fails date_from and passes date_to."""
    day = display_date() if when is None else when
    out = df.where(~F.coalesce("excluded", F.lit(False))).where(F.coalesce("relevance_score", F.lit(0.0)) >= min_score)
    if date_from:
        out = out.where(day >= F.lit(date_from).cast("date"))
    if date_to:
        out = out.where(day.isNull() | (day <= F.lit(date_to).cast("date")))
    for column, value in (equal or {}).items():
        out = out.where(F.col(column) == value)
    for column, value in (member or {}).items():
        out = out.where(F.array_contains(column, value))
    if tech:
        out = out.where(technology(tech))
    if view:
        out = out.where(preset(view))
    return search(out.withColumn("search_text", search_text(out)), text).drop("search_text") if text else out


def scan_secrets(df: DataFrame, id_col: str, text_col: str, patterns: dict[str, str] = SECRETS) -> DataFrame:
    """(id, label) for each pattern that a text holds."""
    labels = F.array(*[F.when(F.col(text_col).rlike(p), F.lit(label)) for label, p in patterns.items()])
    return df.select(F.col(id_col).alias("id"), F.explode(F.filter(labels, lambda x: x.isNotNull())).alias("label"))


def assert_no_secrets(df: DataFrame, id_col: str, text_col: str, patterns: dict[str, str] = SECRETS) -> None:
    if found := scan_secrets(df, id_col, text_col, patterns).take(5):
        raise ValueError(f"texts hold credentials: {[(r['id'], r['label']) for r in found]}")


def split_valid(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with a `reason` that names the missing fields)."""
    missing = F.filter(F.array(*[F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(c)) for c in required]), lambda x: x.isNotNull())
    marked = df.withColumn("reason", F.concat(F.lit("missing "), F.array_join(missing, ", ")))
    return df.where(F.size(missing) == 0), marked.where(F.size(missing) > 0)


def export_order(df: DataFrame, when: Column | None = None) -> DataFrame:
    """Newest first, undated last, then score, then id. A range-partitioned sort."""
    return df.orderBy((display_date() if when is None else when).desc_nulls_last(), F.col("relevance_score").desc(), F.col("id"))


def latest(df: DataFrame, k: int = 100, when: Column | None = None) -> DataFrame:
    return export_order(df.where(~F.coalesce("excluded", F.lit(False))), when).limit(k)


def sort_records(df: DataFrame, order: str = "date-desc", when: Column | None = None) -> DataFrame:
    day = display_date() if when is None else when
    if order == "score-desc":
        return df.orderBy(F.col("relevance_score").desc(), day.desc_nulls_last(), F.col("id"))
    if order == "title-asc":
        return df.orderBy(F.collate(F.col("title"), "UNICODE"), F.col("id"))
    return export_order(df, when)


def page(df: DataFrame, n: int, size: int = 25) -> DataFrame:
    """Page n (from 0) of an ordered table."""
    return df.offset(n * size).limit(size)


def limit_per_source(df: DataFrame, n: int, source: str, order: list[Column]) -> DataFrame:
    """At most n rows of each source. Spark keeps the n first of each task before it shuffles (a window group limit)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(source).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


FLAT = ["date", "title", "url", "evidence_level", "modalities", "delivery_systems", "disease_areas", "development_stages", "watched_people", "relevance_score", "doi", "pmid", "nct_id"]


def flat_view(df: DataFrame, when: Column | None = None) -> DataFrame:
    """Thirteen plain columns for CSV or JSON, arrays joined by `; `. Fields that the table lacks are null."""
    kinds = dict(df.dtypes)
    day = (display_date() if when is None else when).cast("string").alias("date")
    return df.select(day, *[(F.concat_ws("; ", c) if kinds.get(c, "").startswith("array") else F.col(c) if c in kinds else F.lit(None).cast("string")).alias(c) for c in FLAT[1:]])


def write_flat_csv(df: DataFrame, path: str, when: Column | None = None) -> None:
    """`flat_view` as CSV with a header, every value in quotes and quotes within values doubled; nulls are empty, whole numbers have no
    decimal point."""
    plain = lambda c, kind: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "") if kind in ("double", "float") else F.col(c).cast("string")
    flat = flat_view(df, when)
    out = flat.select(*[F.coalesce(plain(c, kind), F.lit("")).alias(c) for c, kind in flat.dtypes])
    out.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_flat_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\u0000").option("emptyValue", "").schema(", ".join(f"{c} string" for c in FLAT)).csv(path)


def union_sources(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def distinct_ids(df: DataFrame, column: str, order: str) -> DataFrame:
    """Each id once, with the place where it is first seen."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("first_seen"))
