"""Rule classification and relevance scoring. Row-wise Columns only: no shuffle and no Python."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexhoard.functions.dates import display_date

#: Weights of the searchable fields.
FIELD_WEIGHTS = {"title": 3.0, "interventions": 3.0, "keywords": 2.0, "mesh_terms": 1.5, "abstract": 1.0, "description": 0.75, "organizations": 1.5}
#: Points of development stages.
STAGE_POINTS = {
    "basic research": 1.0, "platform development": 3.0, "preclinical in vitro": 4.0, "preclinical animal": 6.0, "IND-enabling": 8.0, "Phase 1": 10.0, "Phase 1/2": 11.0,
    "Phase 2": 12.0, "Phase 2/3": 13.0, "Phase 3": 14.0, "approved": 15.0, "post-marketing": 13.0, "discontinued": 7.0, "unknown": 0.0,
}
#: Fixed value: words that show a therapeutic context.
ANCHOR = r"(?i)\b(?:therapeutic|therapy|treatment|drug|vaccine|clinical trial|approved)\b"

_STRINGS = "array<string>"
EVIDENCE = "array<struct<label:string,confidence:double,matched_phrases:array<string>,fields:array<string>,method:string>>"


@dataclass(frozen=True)
class Rule:
    category: str
    label: str
    patterns: list[str]
    negative_patterns: list[str] = field(default_factory=list)
    weight: float = 1.0
    minimum_score: float = 1.0


def searchable_fields(df: DataFrame, weights: dict[str, float] = FIELD_WEIGHTS) -> Column:
    """Array of (name, weight, text) of the fields that the table has."""

    def text(name: str) -> Column | None:
        if name == "interventions":
            if "trial" not in df.columns:
                return None
            return F.concat_ws(" ", F.col("trial")["interventions"], F.col("trial")["intervention_aliases"])
        if name not in df.columns:
            return None
        if name == "organizations":
            return F.array_join(F.col(name)["name"], " ")
        return F.array_join(name, " ") if dict(df.dtypes)[name].startswith("array") else F.col(name)

    made = [(n, w, text(n)) for n, w in weights.items()]
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), F.coalesce(t, F.lit("")).alias("text")) for n, w, t in made if t is not None])


def _insensitive(pattern: str) -> str:
    return "(?iU)" + pattern


def _bound(value: Column, use) -> Column:
    """use(value), where value is computed once however often it is used: a lambda's variable is not computed anew."""
    return F.transform(F.array(value), use)[0]


def _first_forms(said: Column) -> Column:
    """Of phrases that differ in case only the first, in order. Linear but for a sort."""
    keyed = F.array_sort(F.transform(said, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("x"))))
    firsts = _bound(keyed, lambda s: F.filter(s, lambda e, i: (i == 0) | (F.get(s, i - 1)["low"] != e["low"])))
    return F.transform(F.array_sort(F.transform(firsts, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e["x"])


def rule_evidence(rule: Rule, fields: str = "_fields") -> Column:
    """struct(label, score, matched_phrases, fields) if the rule fires, else null. A negative pattern in any field stops it."""
    matches = lambda f: F.flatten(F.array(*[F.regexp_extract_all(f["text"], F.lit(_insensitive(p)), F.lit(0)) for p in rule.patterns]))
    hits = F.filter(F.transform(fields, lambda f: F.struct(f["name"].alias("name"), f["weight"].alias("weight"), matches(f).alias("found"))), lambda f: F.size(f["found"]) > 0)
    stopped = F.lit(False)
    for p in map(_insensitive, rule.negative_patterns):
        stopped = stopped | F.exists(fields, lambda f: f["text"].rlike(p))  # noqa: B023  called at once

    def judged(hits: Column) -> Column:
        score = F.aggregate(hits, F.lit(0.0), lambda s, f: s + F.size(f["found"]) * f["weight"] * rule.weight)
        confidence = F.bround(F.least(F.lit(1.0), score / max(3 * rule.minimum_score, 1.0)), 3)
        said = _first_forms(F.flatten(F.transform(hits, lambda f: f["found"])))
        out = F.struct(F.lit(rule.label).alias("label"), confidence.alias("confidence"), said.alias("matched_phrases"), F.transform(hits, lambda f: f["name"]).alias("fields"), F.lit("deterministic-rules").alias("method"))
        return F.when((score >= rule.minimum_score) & ~stopped, out)

    return _bound(hits, judged)


def classify(df: DataFrame, rules: list[Rule], weights: dict[str, float] = FIELD_WEIGHTS, recomputed: tuple[str, ...] = ("topics",)) -> DataFrame:
    """Adds the rules' labels to one array column per category and all evidence to `classification_evidence` (category to
    structs by label). Labels a record has stay, but those of recomputed categories. Evidence is made anew, so a second run
    changes nothing."""
    out = df.withColumn("_fields", searchable_fields(df, weights))
    names = list(dict.fromkeys(r.category for r in rules))
    for category in names:  # a projection each bounds the size of the generated code
        found = F.filter(F.array(*[rule_evidence(r) for r in rules if r.category == category]), lambda x: x.isNotNull())
        out = out.withColumn(f"_e_{category}", found)
    for category in names:
        labels = F.transform(f"_e_{category}", lambda e: e["label"])
        before = F.coalesce(F.col(category), F.array().cast(_STRINGS)) if category in df.columns and category not in recomputed else F.array().cast(_STRINGS)
        out = out.withColumn(category, F.array_distinct(F.concat(before, labels)))
    entries = F.array(*[F.struct(F.lit(c).alias("key"), F.array_sort(f"_e_{c}").alias("value")) for c in sorted(names)])
    evidence = F.map_from_entries(F.filter(entries, lambda e: F.size(e["value"]) > 0))
    return out.withColumn("classification_evidence", evidence).withColumn("classification_method", F.lit("deterministic-rules-v1")).drop("_fields", *[f"_e_{c}" for c in names])


def with_evidence(before: Column | None, added: dict[str, Column]) -> Column:
    """The evidence map with further entries (category to EVIDENCE) for labels that it has none for, in the order given."""
    none = F.array().cast(EVIDENCE)
    base = F.coalesce(before if before is not None else F.lit(None), F.create_map().cast(f"map<string,{EVIDENCE}>"))

    def merged(category: str, entries: Column) -> Column:
        have = F.coalesce(F.try_element_at(base, F.lit(category)), none)
        new = F.filter(F.coalesce(entries.cast(EVIDENCE), none), lambda e: ~F.exists(have, lambda h: h["label"] == e["label"]))
        return F.struct(F.lit(category).alias("key"), F.concat(have, new).alias("value"))

    rest = F.map_entries(F.map_filter(base, lambda k, v: ~k.isin(*added)))
    return F.map_from_entries(F.array_sort(F.concat(rest, F.filter(F.array(*[merged(c, e) for c, e in added.items()]), lambda e: F.size(e["value"]) > 0))))


def metadata_labels(df: DataFrame) -> DataFrame:
    """Sponsor organizations become companies, affiliations and collaborators institutions, each with evidence of confidence 1 by its
    name; what rules have found for a label stays its evidence."""
    kinds = {"companies": ("sponsor",), "institutions": ("affiliation", "collaborator")}
    names = {c: F.filter(F.transform(F.filter("organizations", lambda o: o["organization_type"].isin(*of)), lambda o: o["name"]), lambda n: n.isNotNull()) for c, of in kinds.items()}  # noqa: B023
    entry = lambda n: F.struct(n.alias("label"), F.lit(1.0).alias("confidence"), F.array(n).alias("matched_phrases"), F.array(F.lit("organizations")).alias("fields"), F.lit("source-metadata").alias("method"))
    evidence = with_evidence(F.col("classification_evidence") if "classification_evidence" in df.columns else None, {c: F.transform(F.array_distinct(n), entry) for c, n in names.items()})
    add = lambda c, new: F.array_distinct(F.concat(F.coalesce(F.col(c), F.array().cast(_STRINGS)) if c in df.columns else F.array().cast(_STRINGS), F.coalesce(new, F.array().cast(_STRINGS))))
    return df.withColumn("classification_evidence", evidence).withColumns({c: add(c, n) for c, n in names.items()})


def apply_global_negatives(df: DataFrame, patterns: list[str], weights: dict[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """Records without a modality in which a pattern is found are excluded, with a reason for each phrase found."""
    fields = searchable_fields(df, weights)
    said = lambda pattern: F.flatten(F.transform(fields, lambda f: F.regexp_extract_all(f["text"], F.lit(_insensitive(pattern)), F.lit(0))))
    found = F.flatten(F.array(*[said(p) for p in patterns]))
    reasons = F.transform(found, lambda x: F.concat(F.lit("classification negative pattern: "), x))
    hit = (F.size(found) > 0) & (F.size("modalities") == 0)
    before = F.coalesce("exclusion_reasons", F.array().cast(_STRINGS))
    return df.withColumn("exclusion_reasons", F.when(hit, F.array_distinct(F.concat(before, reasons))).otherwise(before)).withColumn("excluded", F.coalesce("excluded", F.lit(False)) | hit)


def score(df: DataFrame, as_of: date | str, when: Column | None = None) -> DataFrame:
    """Adds relevance_score (0 to 100) and score_components, ten of them, with what was counted as reason; excluded records are capped at 15 by an
    eleventh. Fields that the table lacks count as empty."""
    have = dict(df.dtypes)
    arr = lambda c: F.coalesce(F.col(c), F.array().cast(_STRINGS)) if c in have else F.array().cast(_STRINGS)
    txt = lambda c: F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")
    trial = F.array_join(F.coalesce(F.col("trial")["interventions"], F.array().cast(_STRINGS)), " ") if "trial" in have else F.lit("")
    anchor = F.concat_ws(" ", txt("title"), txt("abstract"), txt("description"), trial).rlike(ANCHOR)
    n_modal, n_delivery, n_methods = F.size(arr("modalities")), F.size(arr("delivery_systems")), F.size(arr("methods"))
    specific = F.size(F.filter(arr("modalities"), lambda m: m != "other"))
    stages = F.create_map(*[F.lit(x) for kv in STAGE_POINTS.items() for x in kv])
    human = F.array_contains(arr("species"), "human") | (txt("record_type") == "clinical_trial")
    changes = F.size(F.filter(F.flatten(F.col("change_history")["fields"]), lambda f: f.startswith("trial."))) if "change_history" in have else F.lit(0)
    regulatory = (txt("evidence_level") == "regulatory document") | F.array_contains(arr("topics"), "regulation")
    day = display_date() if when is None else when
    age = F.datediff(F.lit(str(as_of)).cast("date"), day)
    usable = F.coalesce(age >= 0, F.lit(False))
    recency = F.when(~usable, 0.0).when(age <= 7, 5.0).when(age <= 30, 4.0).when(age <= 90, 2.0).when(age <= 365, 1.0).otherwise(0.0)
    sources = F.size(F.array_distinct(F.filter(arr("source_types"), lambda s: s != "crossref")))
    ramp = lambda n, first, cap: F.when(n > 0, F.least(F.lit(cap), first + 2.0 * (n - 1))).otherwise(0.0)
    direct = F.when((n_modal > 0) & anchor, 25.0).when(n_modal > 0, 15.0).when((n_delivery > 0) & anchor, 10.0).otherwise(0.0)
    # What was counted, as name=value: a reader's sentence can be made of it.
    told = lambda **of: F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), c.cast("string")) for k, c in of.items()])
    stage_points = F.coalesce(F.array_max(F.transform(arr("development_stages"), lambda s: F.coalesce(F.try_element_at(stages, s), F.lit(0.0)))), F.lit(0.0))
    # Names of components and their maxima.
    rows = [
        ("direct therapeutic relevance", direct, 25, told(modalities=n_modal, deliveries=n_delivery, context=anchor)),
        ("RNA modality specificity", ramp(specific, 8.0, 12.0), 12, told(modalities=specific)),
        ("delivery relevance", ramp(n_delivery, 6.0, 10.0), 10, told(deliveries=n_delivery)),
        ("translational stage", stage_points, 15, told(stages=F.size(arr("development_stages")))),
        ("human relevance", F.when(human, 10.0).otherwise(0.0), 10, told(human=human)),
        ("clinical status change", F.when(changes > 0, 8.0).otherwise(0.0), 8, told(changes=changes)),
        ("regulatory importance", F.when(regulatory, 8.0).otherwise(0.0), 8, told(regulatory=regulatory)),
        ("methodological relevance", F.when(n_methods > 0, F.least(F.lit(5.0), 3.0 + n_methods)).otherwise(0.0), 5, told(methods=n_methods)),
        ("recency", recency, 5, F.when(usable, told(days=age)).otherwise("days=none")),
        ("source corroboration", F.when(sources >= 2, 2.0).otherwise(0.0), 2, told(sources=sources)),
    ]
    component = lambda n, p, m, r: F.struct(F.lit(n).alias("name"), F.bround(p.cast("double"), 2).alias("points"), F.lit(float(m)).alias("maximum"), r.alias("reason"))
    out = df.withColumn("score_components", F.array(*[component(*r) for r in rows]))
    total = F.aggregate("score_components", F.lit(0.0), lambda s, c: s + c["points"])
    excluded = F.coalesce(F.col("excluded"), F.lit(False)) if "excluded" in have else F.lit(False)
    cap = component("exclusion adjustment", F.least(F.lit(0.0), 15.0 - total), 0, told(cap=F.lit(15)))
    out = out.withColumn("score_components", F.when(excluded, F.concat("score_components", F.array(cap))).otherwise(F.col("score_components")))
    return out.withColumn("relevance_score", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), 2))


def reclassify(df: DataFrame, rules: list[Rule], as_of: date | str) -> DataFrame:
    return score(classify(df, rules), as_of)
