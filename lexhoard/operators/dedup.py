"""Duplicate records: edges, clusters, and one merged record per cluster with a log of the merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexhoard.functions.text import author_parts, empty_to_null, normalize_doi, normalize_title, sequence_ratio_from, token_jaccard
from lexhoard.graph import connected_components
from lexhoard.session import discard, saved

#: Quality of source types.
SOURCE_QUALITY = {"pubmed": 100, "clinicaltrials": 95, "biorxiv": 80, "medrxiv": 80, "crossref": 70, "regulatory": 65, "rss": 40}
OTHER_QUALITY = 20
MIN_RATIO, MIN_JACCARD, MIN_WORDS, EXACT_WORDS, MAX_YEARS = 0.96, 0.72, 8, 5, 2


def quality(source_types: Column, table: dict[str, int] = SOURCE_QUALITY) -> Column:
    points = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.array_max(F.transform(source_types, lambda s: F.coalesce(F.try_element_at(points, s), F.lit(OTHER_QUALITY)))), F.lit(OTHER_QUALITY))


def _stars(keys: DataFrame, reason: str, confidence: float) -> DataFrame:
    """Edges from each member of a key to its smallest id: as many as members, never pairs."""
    hubs = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub")
    return keys.join(hubs, "key").where("id <> hub").select(F.col("hub").alias("left_id"), F.col("id").alias("right_id"), F.lit(reason).alias("reason"), F.lit(confidence).alias("confidence")).distinct()


def exact_edges(df: DataFrame, identifiers: dict[str, Column]) -> DataFrame:
    """Records with an equal identifier (kind to Column, null for none)."""
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value")) for kind, value in identifiers.items()])
    keys = df.select("id", F.explode(pairs).alias("p")).where("p.value is not null and p.value <> ''").select("id", F.col("p.kind").alias("kind"), F.concat_ws(":", "p.kind", "p.value").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    return keys.join(hubs.select("key", "hub"), "key").where("id <> hub").select(F.col("hub").alias("left_id"), F.col("id").alias("right_id"), F.concat(F.lit("same "), "kind").alias("reason"), F.lit(1.0).alias("confidence")).distinct()


def preprint_edges(df: DataFrame, published_doi: Column, doi: Column) -> DataFrame:
    """Preprints (right) and journal records (left) of the DOI they name, as a two-sided star per DOI: its first journal record with
    every preprint, its first preprint with every other journal record. So there are as many edges as members, and the components
    are those of all pairs. A record is no preprint of itself."""
    roles = F.array(F.struct(normalize_doi(doi).alias("d"), F.lit(True).alias("journal")), F.struct(normalize_doi(published_doi).alias("d"), F.lit(False).alias("journal")))
    named = df.select("id", F.explode(roles).alias("r")).select("id", "r.d", "r.journal").where("d is not null").distinct()
    hubs = named.groupBy("d").agg(F.min(F.when(F.col("journal"), F.col("id"))).alias("first"), F.min(F.when(~F.col("journal"), F.col("id"))).alias("preprint")).where("first is not null and preprint is not null")
    ends = named.join(hubs, "d").where("not journal or id <> first")
    out = ends.select(F.when(F.col("journal"), F.col("id")).otherwise(F.col("first")).alias("left_id"), F.when(F.col("journal"), F.col("preprint")).otherwise(F.col("id")).alias("right_id"))
    return out.where("left_id <> right_id").distinct().select("left_id", "right_id", F.lit("published version of preprint").alias("reason"), F.lit(1.0).alias("confidence"))


def _first_author(df: DataFrame) -> DataFrame:
    return df.select("id", "title", "year", F.explode("authors").alias("a")).select("id", "title", "year", author_parts(F.col("a")).alias("a"))


#: Letters that are counted apart for a bound of the ratio; all others count together.
LETTERS = ["a", "e", "i", "o", "n", "r", "s", "t", "l", "c", "dm", "ug"]
#: Rows of a block that one task compares; larger blocks are dealt over a grid of cells.
CELL_ROWS = 2_000


def _bounds(rows: DataFrame) -> DataFrame:
    """Adds what bounds the ratio of two titles without their texts: the length, and counts of letters h0, h1, ..."""
    counts = [(F.length("title") - F.length(F.translate("title", x, ""))).alias(f"h{i}") for i, x in enumerate(LETTERS)]
    return rows.select("*", F.length("title").alias("len"), F.xxhash64("title").alias("hash"), *counts)


def _blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Left and right rows (key columns first) that meet if they share a block, each in one cell: the block's rows are dealt into
    groups of at most about CELL_ROWS, and every two groups make a cell."""
    sizes = rows.groupBy("family", "w").agg(F.count("*").alias("rows")).where(f"rows > {CELL_ROWS}").select("family", "w", F.ceil(F.col("rows") / CELL_ROWS).cast("int").alias("groups"))
    dealt = saved(rows.join(sizes, ["family", "w"], "left").withColumn("groups", F.coalesce("groups", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int")))
    every = F.explode(F.sequence(F.lit(0), F.col("groups") - 1))
    return dealt.withColumn("i", F.col("mine")).withColumn("j", every), dealt.withColumn("j", F.col("mine")).withColumn("i", every)


def title_edges(df: DataFrame) -> DataFrame:
    """Records of near-equal titles with a common author, at most MAX_YEARS apart. df: id, title, authors, year.

    Titles of EXACT_WORDS words match if equal (0.98); titles of MIN_WORDS words by ratio and Jaccard. Blocks are (family name, one
    of the rarest words of the title): as many words as a pair at MIN_JACCARD cannot miss, so blocking loses none. Pairs of a block
    are thinned without their titles: by authors, years, lengths, the places of the common word, after which too few words may be
    left to agree, and counts of letters, which bound the ratio. Titles are fetched for what is left.

    Records of equal title, authors and year are one class: its members have an edge to its smallest id, and classes are
    compared by those, so components are those of all pairs while copies make no pairs.
    """
    rows = df.select("id", normalize_title(F.col("title")).alias("title"), "authors", "year").where("title <> ''")
    words = F.filter(F.array_distinct(F.split("title", " ")), lambda w: w != "")
    # Fewer words never match, nor do authors without an ORCID or a given name.
    rows = rows.withColumn("words", words).where(F.size(F.split("title", " ")) >= EXACT_WORDS)
    parts = _first_author(rows).select("id", "a").where("a.family <> '' and (a.orcid is not null or a.given <> '')").distinct()
    parts = parts.groupBy("id").agg(F.array_sort(F.collect_set("a")).alias("parts"))
    classed = saved(rows.join(parts, "id").withColumn("key", F.struct("title", "year", "parts")).select("id", "key", "words"))
    star = _stars(classed.select("id", "key"), "exact title and author", 0.98)
    rows = saved(_bounds(classed.groupBy("key").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.first("words").alias("words")).select("id", "last", "words", "key.*")))
    rarity = rows.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    ranked = rows.select("id", F.explode("words").alias("w")).join(rarity, "w").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "w"))), lambda x: x["w"]).alias("ranked"))
    prefix = F.slice("ranked", 1, F.greatest(F.lit(1), (F.size("ranked") - F.ceil(F.size("ranked") * MIN_JACCARD) + 1).cast("int")))
    letters = [f"h{i}" for i in range(len(LETTERS))]
    people = rows.select("id", F.explode("parts").alias("a"))
    placed = rows.join(ranked, "id").select("id", "last", "year", "len", "hash", *letters, F.size(F.split("title", " ")).alias("n"), F.size("ranked").alias("k"), F.posexplode(prefix).alias("at", "w")).join(people, "id").withColumn("family", F.col("a.family"))
    left, right = _blocks(placed)
    l, r = left.alias("l"), right.alias("r")
    orcids = F.col("l.a.orcid").isNotNull() & F.col("r.a.orcid").isNotNull()
    given = (F.col("l.a.given") != "") & (F.col("r.a.given") != "")
    initial = (F.col("l.a.given") == F.col("r.a.given")) | ((F.least(F.length("l.a.given"), F.length("r.a.given")) == 1) & (F.substring("l.a.given", 1, 1) == F.substring("r.a.given", 1, 1)))
    same = F.when(orcids, F.col("l.a.orcid") == F.col("r.a.orcid")).otherwise(given & initial)
    years = F.coalesce(F.abs(F.col("l.year") - F.col("r.year")) <= MAX_YEARS, F.lit(True))
    both = F.col("l.len") + F.col("r.len")
    # A ratio of MIN_RATIO leaves at most this many characters without a partner.
    spare = both * (1 - MIN_RATIO) + 1e-9
    apart = F.abs(F.col("l.len") - F.col("r.len"))
    counted = sum((F.abs(F.col(f"l.{h}") - F.col(f"r.{h}")) for h in letters), F.abs((F.col("l.len") - sum(F.col(f"l.{h}") for h in letters)) - (F.col("r.len") - sum(F.col(f"r.{h}") for h in letters))))
    # If no earlier word of either is common, as holds for the first common word, no more than this many are.
    agree = F.least(F.col("l.k") - F.col("l.at"), F.col("r.k") - F.col("r.at"))
    close = (F.least("l.n", "r.n") >= MIN_WORDS) & (apart <= spare) & (agree * (1 + MIN_JACCARD) >= MIN_JACCARD * (F.col("l.k") + F.col("r.k")) - 1e-9) & (counted <= spare)
    met = (F.col("l.w") == F.col("r.w")) & (F.col("l.family") == F.col("r.family")) & (F.col("l.i") == F.col("r.i")) & (F.col("l.j") == F.col("r.j")) & (F.col("l.id") < F.col("r.id")) & years & ((F.col("l.hash") == F.col("r.hash")) | close) & same
    pairs = l.join(r, met).select(F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"), (F.col("r.id") < F.col("l.last")).alias("both"), F.least("l.n", "r.n").alias("n")).distinct()
    of = lambda side, title: rows.select(F.col("id").alias(side), F.col("title").alias(title))
    pairs = pairs.join(of("left_id", "lt"), "left_id").join(of("right_id", "rt"), "right_id")
    pairs = pairs.withColumn("jaccard", token_jaccard(F.col("lt"), F.col("rt"))).where(f"lt = rt or (n >= {MIN_WORDS} and jaccard >= {MIN_JACCARD})")
    # The pairs are small beside the work they make, so they are dealt over as many tasks as a shuffle has.
    pairs = saved(pairs).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "left_id", "right_id")
    # The ratio depends on the order of its titles: where members of two classes stand in both orders, the better one counts.
    ratio_of = sequence_ratio_from(MIN_RATIO)
    ratio = F.greatest(ratio_of(F.col("lt"), F.col("rt")), ratio_of(F.when(F.col("both"), F.col("rt")), F.col("lt")))
    # Written before it is filtered, as a filter would be pushed ahead of the dealing and the ratio be worked out twice.
    pairs = saved(pairs.select("left_id", "right_id", "n", "jaccard", (F.col("lt") == F.col("rt")).alias("equal"), ratio.alias("ratio")))
    exact = F.col("equal") & (F.col("n") >= EXACT_WORDS)
    close = (F.col("n") >= MIN_WORDS) & (F.col("ratio") >= MIN_RATIO) & (F.col("jaccard") >= MIN_JACCARD)
    confidence = F.when(exact, 0.98).when(close, F.bround(F.least(F.lit(0.97), (F.col("ratio") + F.col("jaccard")) / 2), 4))
    return star.unionByName(pairs.where(exact | close).select("left_id", "right_id", F.when(exact, "exact title and author").otherwise("similar title and author").alias("reason"), confidence.alias("confidence")))


def cluster_greedy(edges: DataFrame) -> DataFrame:
    """(id, cluster) of every record in an edge, as if records came one by one in the order of their ids, and each joined the first
    kept one that it has an edge to, or else was kept. So A~B, B~C without A~C keeps A and C.

    Round by round the records without a smaller one that may still be kept are kept, and their neighbours join them; rounds are as
    many as chains of such dependence are long. Only edges between records that are still open go on.
    """
    pairs = saved(edges.select(F.least("left_id", "right_id").alias("u"), F.greatest("left_id", "right_id").alias("v")).where("u < v").distinct())
    live, joined = pairs, []
    while live.limit(1).count():
        kept = live.select("u").distinct().join(live.select(F.col("v").alias("u")), "u", "left_anti")
        joined.append(saved(live.join(kept, "u", "left_semi").select(F.col("v").alias("id")).distinct()))
        was, live = live, saved(live.join(joined[-1].withColumnRenamed("id", "v"), "v", "left_anti").join(joined[-1].withColumnRenamed("id", "u"), "u", "left_anti").select("u", "v"))
        if was is not pairs:
            discard(was)
    ids = edges.select(F.explode(F.array("left_id", "right_id")).alias("id")).where("id is not null").distinct()
    if not joined:
        return ids.select("id", F.col("id").alias("cluster"))
    gone = saved(reduce(DataFrame.union, joined))
    first = pairs.join(gone.withColumnRenamed("id", "u"), "u", "left_anti").groupBy(F.col("v").alias("id")).agg(F.min("u").alias("first"))
    out = ids.join(gone.withColumn("gone", F.lit(True)), "id", "left").join(first, "id", "left")
    return out.select("id", F.when(F.col("gone"), F.col("first")).otherwise(F.col("id")).alias("cluster"))


def cluster(edges: DataFrame) -> DataFrame:
    """(id, cluster) of every record in an edge; cluster is the smallest id of the component."""
    return connected_components(edges, "left_id", "right_id").select(F.col("node").alias("id"), F.col("component").alias("cluster"))


def preferred_member(df: DataFrame, cluster_col: str, rank: list[Column]) -> DataFrame:
    best = Window.partitionBy(cluster_col).orderBy(*rank)
    return df.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def merge_cluster(df: DataFrame, scalars: list[str], arrays: list[str], first: list[str] = (), last: list[str] = ()) -> DataFrame:
    """One row per cluster (df: cluster, id, source_types, excluded and the fields named).

    Members rank by source quality, then id, both descending. Scalars are the first that isn't empty in that order; arrays the
    ordered union; `first` fields the minimum, `last` fields the maximum; excluded only if all members are.
    """
    kinds = dict(df.dtypes)
    given = lambda c: empty_to_null(F.col(c)) if kinds[c] == "string" else F.when(F.size(c) > 0, F.col(c)) if kinds[c].startswith("array") else F.col(c)
    ranked = df.withColumn("_q", quality(F.col("source_types")))
    # Only aggregates with states of one value each, so that a cluster of any size is summed up where its rows are.
    by = lambda value: F.max(F.when(value.isNotNull(), F.struct("_q", "id", value.alias("value"))))["value"]
    out = ranked.groupBy("cluster").agg(F.max(F.struct("_q", "id"))["id"].alias("id"), F.count("*").cast("int").alias("n_members"), *[by(given(c)).alias(c) for c in scalars], *[F.min(c).alias(f"_first_{c}") for c in first], *[F.max(c).alias(f"_last_{c}") for c in last], F.min(F.coalesce("excluded", F.lit(False))).alias("excluded"))
    # Each distinct string of an array field by its best member and place there: what is listed is no longer than the union.
    fields = [*arrays, "source_types"]
    placed = lambda i, c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x, at: F.struct(F.lit(i).alias("i"), (-at).alias("at"), x.alias("x")))
    entries = F.flatten(F.array(*[placed(i, c) for i, c in enumerate(fields)]))
    values = ranked.select("cluster", "_q", "id", F.explode(entries).alias("e")).where("e.x is not null and e.x <> ''")
    values = values.groupBy("cluster", "e.i", "e.x").agg(F.max(F.struct("_q", "id", "e.at")).alias("best"))
    listed = lambda i: F.transform(F.reverse(F.array_sort(F.collect_list(F.when(F.col("i") == i, F.struct("best", "x"))))), lambda y: y["x"])
    unions = values.groupBy(F.col("cluster").alias("_cluster")).agg(*[listed(i).alias(f"_union_{i}") for i in range(len(fields))])
    union = lambda i, alias: F.coalesce(F.col(f"_union_{i}"), F.array().cast("array<string>")).alias(alias)
    out = out.join(unions, F.col("cluster").eqNullSafe(F.col("_cluster")), "left")
    return out.select("cluster", "id", "n_members", *scalars, *[union(i, c) for i, c in enumerate(fields)], *[F.col(f"_first_{c}").alias(c) for c in first], *[F.col(f"_last_{c}").alias(c) for c in last], "excluded")


def merge_decisions(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """(kept_id, merged_id, reason, confidence): each member but the kept one, with its strongest edge."""
    ends = edges.select(F.explode(F.array("left_id", "right_id")).alias("id"), "reason", "confidence")
    best = ends.groupBy("id").agg(F.max(F.struct("confidence", "reason")).alias("e"))
    return clusters.where("id <> cluster").join(best, "id").select(F.col("cluster").alias("kept_id"), F.col("id").alias("merged_id"), "e.reason", "e.confidence")


def deduplicate(df: DataFrame, edges: DataFrame, scalars: list[str], arrays: list[str], first: list[str] = (), last: list[str] = (), mode: str = "components") -> tuple[DataFrame, DataFrame]:
    """(merged records, merge decisions). Order and partitioning of the input don't matter. mode: `components`, or `greedy`."""
    clusters = {"components": cluster, "greedy": cluster_greedy}[mode](edges)
    joined = df.join(clusters, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    return merge_cluster(joined, scalars, arrays, first, last), merge_decisions(clusters, edges)
