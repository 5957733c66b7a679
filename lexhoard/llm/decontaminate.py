"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of all benchmark items.

Each text is normalised (A-Z lower-cased, words joined by single spaces) and scanned once; a match is mapped back to word
numbers and to offsets of the original text. The benchmark is a query set: it is handed to the tasks in blocks of bounded size,
and a benchmark beyond one block takes one scan of the documents per block, so nothing depends on its being small.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexhoard.llm.base import LOWER, NOT_WORD, UPPER, WORD, WORDS_OF, arrow_sized, documents
from lexhoard.session import saved, table

#: Words in a window.
WINDOW = 10
#: Benchmark text, in bytes, that one automaton holds.
BLOCK_BYTES = 4_000_000

_SPANS = "array<struct<word_from:int,word_to:int,char_from:int,char_to:int>>"


def _words(text: str | None) -> list[bytes]:
    return text.encode().translate(WORDS_OF).split() if text else []


def _automaton(items: list[tuple]):
    import ahocorasick

    of = defaultdict(set)
    for item, text in items:
        words = _words(text)
        for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
            of[tuple(words[i : i + WINDOW])].update([] if item is None else [str(item)])
    found = ahocorasick.Automaton()
    for words, ids in of.items():
        found.add_word(" " + b" ".join(words).decode("latin-1") + " ", (len(words), tuple(ids)))
    found.make_automaton()
    return found, len(of)


def _scan(found, text: str | None):
    """n_words, spans and item ids of one text."""
    words = _words(text)
    if not words:
        return 0, [], []
    joined = " " + b" ".join(words).decode("latin-1") + " "
    hits = list(found.iter(joined))
    if not hits:
        return len(words), [], []
    ends = np.cumsum([len(w) + 1 for w in words])  # of the space after each word
    at = np.searchsorted(ends, [end for end, _ in hits]) + 1
    ids, merged = set(), []
    for lo, hi in sorted((int(to) - n, int(to)) for to, (_, (n, _)) in zip(at, hits, strict=True)):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(hi, merged[-1][1])
        else:
            merged.append([lo, hi])
    for _, (_, items) in hits:
        ids.update(items)
    places = [m.span() for m in re.finditer(WORD, text.translate(str.maketrans(UPPER, LOWER)))]
    spans = [{"word_from": lo, "word_to": hi, "char_from": places[lo][0], "char_to": places[hi - 1][1]} for lo, hi in merged]
    return len(words), spans, sorted(ids)


def _scanner(items: list[tuple], text_at: int, schema: pa.Schema):
    def scan(batches):
        found, n = _automaton(items)
        for batch in batches:
            out = [_scan(found, t) if n else (len(_words(t)), [], []) for t in batch.column(text_at).to_pylist()]
            new = [pa.array([x[i] for x in out], schema.field(len(batch.columns) + i).type) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema=pa.schema([*batch.schema, *list(schema)[-3:]]))

    return scan


def _hits(items: list[tuple], schema: pa.Schema):
    """Of (bench_key, bench_check, text): for texts with hits, the keys, spans and item ids."""

    def scan(batches):
        found, n = _automaton(items)
        for batch in batches:
            out = [_scan(found, t)[1:] if n else ([], []) for t in batch.column(2).to_pylist()]
            hit = [i for i, x in enumerate(out) if x[0]]
            new = [pa.array([out[i][j] for i in hit], schema.field(2 + j).type) for j in range(2)]
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(pa.array(hit, pa.int64())) for j in range(2)), *new], schema=schema)

    return scan


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns kept, with three more: bench_words (int), bench_spans and bench_items (sorted).

    A window is WINDOW consecutive words of an item; a shorter item is one window; null or wordless items have none. Windows of
    items without an id are hit like others, and no id is listed for them. Spans are
    the merged places of windows, in words and in characters of the text. Null and empty texts have no words. Rows are never
    dropped, and repeated rows are judged one by one. A column of `docs` whose name starts with bench_ is a ValueError.

    A benchmark of one block is scanned for in one map. Of a larger one, each block is a job of its own that saves its hits by
    text, so that a worker holds one automaton and the driver one block at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if taken := [c for c in docs.columns if c.lower().startswith("bench_")]:
        raise ValueError(f"columns that find_benchmark adds or uses: {taken}")
    spark = docs.sparkSession
    arrow_sized(spark)
    arrow = lambda fields: to_arrow_schema(spark.createDataFrame([], fields).schema)
    total = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    ids = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text"))
    if blocks == 1:
        items = [(r["item"], r["text"]) for r in ids.toLocalIterator()]  # at most block_bytes
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", bench_words int, bench_spans {_SPANS}, bench_items array<string>"
        return docs.mapInArrow(_scanner(items, docs.columns.index(text_col), arrow(fields)), fields)

    keys = [F.xxhash64(text_col).alias("bench_key"), F.xxhash64(F.lit(1), F.col(text_col)).alias("bench_check")]
    texts = docs.where(F.col(text_col).isNotNull()).select(*keys, F.col(text_col).alias("text"))
    fields = f"bench_key long, bench_check long, bench_spans {_SPANS}, bench_items array<string>"
    schema, found = arrow(fields), []
    for b in range(blocks):
        items = [(r["item"], r["text"]) for r in ids.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).toLocalIterator()]  # of about block_bytes
        found.append(saved(texts.mapInArrow(_hits(items, schema), fields)))
    every = lambda n: F.flatten(F.collect_set(n))
    hits = reduce(DataFrame.union, found).groupBy("bench_key", "bench_check").agg(every("bench_spans").alias("bench_spans"), every("bench_items").alias("bench_items"))
    words = F.size(F.filter(F.split(F.coalesce(text_col, F.lit("")), NOT_WORD), lambda w: w != "")).alias("bench_words")
    # Texts without words have no hits; a null key keeps them out of the join.
    some = F.col("bench_words") > 0
    rows = docs.select("*", *keys, words).withColumn("bench_key", F.when(some, F.col("bench_key")))
    none = lambda n, kind: F.coalesce(n, F.array().cast(kind))
    return rows.join(hits, ["bench_key", "bench_check"], "left").select(
        *(F.col(f"`{c}`") for c in docs.columns),
        "bench_words",
        none(_merged(F.col("bench_spans")), _SPANS).alias("bench_spans"),
        none(F.array_sort(F.array_distinct("bench_items")), "array<string>").alias("bench_items"),
    )


def _merged(spans):
    """Joins spans that overlap or touch."""

    def step(done, s):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["word_from"].alias("word_from"), F.greatest(last["word_to"], s["word_to"]).alias("word_to"), last["char_from"].alias("char_from"), F.greatest(last["char_to"], s["char_to"]).alias("char_to"))
        return F.when((F.size(done) > 0) & (last["word_to"] >= s["word_from"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.slice(spans, 1, 0), step)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all `documents` against all of `benchmark`."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = find_benchmark(docs, table(spark, sf_dir, "benchmark"))
    hits = F.aggregate("bench_spans", F.lit(0).cast("long"), lambda n, s: n + s["word_to"] - s["word_from"])
    return found.select(
        "doc_id",
        F.col("bench_words").cast("long").alias("n_words"),
        hits.alias("n_hit"),
        F.size("bench_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("bench_items", ",").cast("binary"), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"

ORACLE_OP3 = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, g FROM (
  SELECT item_id, least(len(w), {WINDOW}) AS n,
    unnest(CASE WHEN len(w) <= {WINDOW} THEN [array_to_string(w, ' ')]
           ELSE [array_to_string(w[i:i + {WINDOW} - 1], ' ') for i in range(1, len(w) - {WINDOW} + 2)] END) AS g
  FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p,
  unnest([array_to_string(w[i:i + n - 1], ' ') for i in range(1, len(w) - n + 2)]) AS g
  FROM d, ns WHERE len(w) >= n),
hit AS (SELECT doc_id, p, n, item_id FROM dw JOIN bw USING (n, g)),
q AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN q USING (doc_id) LEFT JOIN i USING (doc_id)
"""
