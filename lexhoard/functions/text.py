"""Text functions: Columns in, Columns out. Only Unicode normal forms and the sequence ratio need Python (Arrow-batched)."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Fixed value: what a DOI looks like within a text.
DOI_PATTERN = r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b"
#: Entities that are replaced natively, the ampersand last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def empty_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def normalize_doi(c: Column) -> Column:
    """Lower case, without resolver or `doi:` prefix and trailing spaces and full stops; null if nothing is left."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")
    return empty_to_null(F.regexp_replace(bare, "[ .]+$", ""))


@F.pandas_udf(StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


def without_marks(x: str) -> str:
    """Compatibility decomposition without combining marks; plain ASCII is its own. Distinct characters are few, so they are told apart once."""
    if x.isascii():
        return x
    x = unicodedata.normalize("NFKD", x)
    for c in set(x):
        if unicodedata.combining(c):
            x = x.replace(c, "")
    return x


@F.pandas_udf(StringType())
def nfkd_strip(s: pd.Series) -> pd.Series:
    """Without combining marks."""
    return s.map(without_marks, na_action="ignore")


def normalize_title(c: Column, unicode_forms: bool = True) -> Column:
    """Without `version N` or `vN` and punctuation. unicode_forms=False skips NFKC and full case folding and stays in the JVM."""
    folded = nfkc_casefold(c) if unicode_forms else F.lower(c)
    bare = F.regexp_replace(folded, r"(?U)\b(?:version\s*|v)\d+\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def ascii_fold(c: Column) -> Column:
    """Names: no accents, lower case, runs of anything but a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(nfkd_strip(c)), "[^a-z0-9]+", " "))


def search_normalize(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(nfkd_strip(c)), r"[^\p{L}\p{N}]+", " "))


#: Where an entity is left that isn't among ENTITIES, such as a numeric reference.
ENTITY_LEFT = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?"


#: Stands between entities: no entity has it, none is decoded to it, and it ends a name.
BETWEEN = "\uFDD0"


@F.pandas_udf(StringType())
def all_entities(s: pd.Series) -> pd.Series:
    """Every named entity and numeric reference decoded, as HTML has them."""
    return s.map(html.unescape, na_action="ignore")


def html_to_text(c: Column, max_len: int | None = 1200) -> Column:
    """Script and style dropped, tags stripped, common entities decoded, white space collapsed; cut at max_len with an ellipsis.
    See `html_to_text_whole` for all entities."""
    text = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->|<[^>]*>", " ")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return _cut(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), max_len)


def _cut(text: Column, max_len: int | None) -> Column:
    """Cut at max_len with an ellipsis. The text is bound to a lambda's variable, so that it is worked out once."""
    if max_len is None:
        return text
    cut = lambda x: F.when(F.length(x) > max_len, F.concat(F.rtrim(F.substring(x, 1, max_len - 1)), F.lit("…"))).otherwise(x)
    return F.get(F.transform(F.array(text), cut), F.lit(0))


def _decoded(text: Column) -> Column:
    """The text with every entity decoded once. Only the entities go to Python, a row's in one string; they are put back in the JVM."""
    names = F.regexp_extract_all(text, F.lit(ENTITY_LEFT), F.lit(0))
    values = F.split(all_entities(F.array_join(names, BETWEEN)), BETWEEN)
    return F.array_join(F.zip_with(F.split(text, ENTITY_LEFT), values, lambda before, value: F.concat(before, F.coalesce(value, F.lit("")))), "")


def html_to_text_whole(df: DataFrame, column: str, max_len: int | None = 1200) -> DataFrame:
    """df with the column as `html_to_text` has it, but with every named entity and numeric reference decoded, each once. Only rows
    that hold such a one go through Python; the others stay in the JVM. Rows may come in another order."""
    bare = F.regexp_replace(F.regexp_replace(F.col(column), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " "), r"(?s)<!--.*?-->|<[^>]*>", " ")
    rare = F.coalesce(F.regexp_replace(bare, "|".join(e for e, _ in ENTITIES if e != "&amp;"), "").rlike(ENTITY_LEFT), F.lit(False))
    plain = lambda text: F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    left = df.where(~rare).withColumn(column, html_to_text(F.col(column), max_len))
    right = df.where(rare).withColumn(column, bare).withColumn(column, _decoded(F.col(column))).withColumn(column, _cut(plain(F.col(column)), max_len))
    return left.unionByName(right)


def extract_doi(*cols: Column) -> Column:
    """From the first column that has one."""
    return normalize_doi(F.coalesce(*[empty_to_null(F.regexp_extract(c, DOI_PATTERN, 0)) for c in cols]))


def normalize_orcid(c: Column) -> Column:
    return empty_to_null(F.upper(F.regexp_replace(F.trim(c), r"^(?i:https?://orcid\.org/)", "")))


def folded(c: Column) -> Column:
    """Case folded for comparison within the JVM: upper and then lower case, which takes in the letters that lower case alone keeps
    apart (ß and ss, final sigma, ligatures). Full-width forms of ASCII are made plain first."""
    wide, plain = "ẞ" + "".join(chr(0xFF01 + i) for i in range(94)), "ß" + "".join(chr(0x21 + i) for i in range(94))
    return F.lower(F.concat(F.upper(F.translate(c, wide, plain)), F.lit("")))  # lower(upper(x)) would be optimized to lower(x)


def author_parts(author: Column) -> Column:
    """struct(family, given, orcid) of an author struct: missing names from the ends of the full name, word characters only, case
    folded."""
    words = F.split(F.trim(author["name"]), r"\s+")
    plain = lambda c: F.regexp_replace(folded(c), r"(?U)\W", "")
    family = plain(F.coalesce(empty_to_null(author["family_name"]), F.try_element_at(words, F.lit(-1)), F.lit("")))
    given = plain(F.coalesce(empty_to_null(author["given_name"]), F.when(F.size(words) > 1, F.try_element_at(words, F.lit(1))), F.lit("")))
    orcid = F.element_at(F.split(F.lower(F.coalesce(author["orcid"], F.lit(""))), "/"), -1)
    return F.struct(family.alias("family"), given.alias("given"), empty_to_null(orcid).alias("orcid"))


def token_jaccard(a: Column, b: Column) -> Column:
    """Of the words of two normalised titles; 0 if either has none."""
    tokens = lambda c: F.filter(F.array_distinct(F.split(F.coalesce(c, F.lit("")), " ")), lambda x: x != "")
    left, right = tokens(a), tokens(b)
    both = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), both / (F.size(left) + F.size(right) - both)).otherwise(0.0)


def _alike(a: str, b: str, i: int, j: int, n: int) -> int:
    """Characters, n at most, that agree from a[i] and b[j] on: some one by one, then in slices of growing and falling length."""
    same, width = 0, 64
    while same < n and same < 32:
        if a[i + same] != b[j + same]:
            return same
        same += 1
    while same < n and width:
        width = min(width, n - same)
        if a[i + same : i + same + width] == b[j + same : j + same + width]:
            same, width = same + width, 2 * width
        else:
            n, width = same + width - 1, width // 2
    return same


def _longest_by_automaton(a: str, b: str, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """As `_longest_match`, by the suffix automaton of b's part: in time of both lengths, however often pieces recur."""
    follow, link, size, last = [{}], [-1], [0], 0
    for c in b[blo:bhi]:
        now, p = len(size), last
        follow.append({})
        link.append(0)
        size.append(size[last] + 1)
        while p >= 0 and c not in follow[p]:
            follow[p][c] = now
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if size[q] > size[p] + 1:
                copy = len(size)
                follow.append(dict(follow[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                link[q] = copy
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                q = copy
            link[now] = q
        last = now
    state = n = best = end = 0
    for i in range(alo, ahi):
        c = a[i]
        while state and c not in follow[state]:
            state = link[state]
            n = size[state]
        if c in follow[state]:
            state, n = follow[state][c], n + 1
        if n > best:
            best, end = n, i + 1
    return (end - best, b.find(a[end - best : end], blo, bhi), best) if best else (alo, blo, 0)


def _longest_match(a: str, b: str, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest common substring of a[alo:ahi] and b[blo:bhi], the first in a, then in b.

    Every one of 2 * step - 1 characters or more holds a piece of `step` characters that starts at a multiple of step, so the pieces'
    places in b, extended both ways, find it; shorter steps are tried until the longest found is that long. Where pieces have very
    many places, as in repeated words, an automaton finds it.
    """
    # All of the shorter one, which long texts of one repeated word often have in common.
    i, j = (alo, b.find(a[alo:ahi], blo, bhi)) if ahi - alo <= bhi - blo else (a.find(b[blo:bhi], alo, ahi), blo)
    if min(i, j) >= 0:
        return i, j, min(ahi - alo, bhi - blo)
    step = max(2, 1 << max(0, (min(ahi - alo, bhi - blo) + 1).bit_length() - 2))
    left = 4 * (ahi - alo + bhi - blo)  # places and characters to look at
    while step > 1:
        best, ends = (0, 0, 0), {}  # ends: of the match found last on a diagonal
        for i in range(alo, ahi - step + 1, step):
            piece = a[i : i + step]
            j = b.find(piece, blo, bhi)
            while j >= 0:
                left -= 1
                if left < 0:
                    return _longest_by_automaton(a, b, alo, ahi, blo, bhi)
                if ends.get(j - i, -1) < i + step:
                    x, y, end = i, j - i, i + step
                    while x > alo and x + y > blo and a[x - 1] == b[x + y - 1]:
                        x -= 1
                    left -= i - x
                    end += _alike(a, b, end, end + y, min(ahi - end, bhi - end - y))
                    ends[y] = end
                    best = max(best, (end - x, -x, -x - y))
                j = b.find(piece, j + 1, bhi)
        if best[0] >= 2 * step - 1:
            return -best[1], -best[2], best[0]
        step //= 2
    for length in (2, 1):
        for i in range(alo, ahi - length + 1):
            j = b.find(a[i : i + length], blo, bhi)
            if j >= 0:
                return i, j, length
    return alo, blo, 0


def matched_ratio(a: str, b: str) -> float:
    """`difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()`, without its table of every character's places."""
    if a == b:
        return 1.0
    todo, matched = [(0, len(a), 0, len(b))], 0
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        i, j, n = _longest_match(a, b, alo, ahi, blo, bhi)
        matched += n
        if n and alo < i and blo < j:
            todo.append((alo, i, blo, j))
        if n and i + n < ahi and j + n < bhi:
            todo.append((i + n, ahi, j + n, bhi))
    return 2.0 * matched / (len(a) + len(b))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of whole numbers (Hyyrö, 2004). No ratio matches more characters."""
    start = _alike(a, b, 0, 0, min(len(a), len(b)))
    a, b, places = a[start:], b[start:], {}
    for i, c in enumerate(a):
        places.setdefault(c, []).append(i)
    masks = {c: sum(1 << i for i in at) for c, at in places.items()}
    whole = left = (1 << len(a)) - 1
    for c in b:
        met = left & masks.get(c, 0)
        left = (left + met | left - met) & whole
    return start + len(a) - left.bit_count()


def sequence_ratio_from(least: float):
    """`sequence_ratio` where it is at least `least`, else 0: most pairs below are told by their longest common subsequence."""

    @F.pandas_udf(DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        def of(x, y):
            if x is None or y is None:
                return None
            found = matched_ratio(x, y) if 2.0 * common_length(x, y) >= least * (len(x) + len(y)) - 1e-6 else 0.0
            return found if found >= least else 0.0

        return pd.Series([of(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    return ratio


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; the order of the arguments matters. For pairs that cheap filters have left."""
    return pd.Series([matched_ratio(x, y) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype=float)


def escape_html(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def safe_url(c: Column) -> Column:
    """The URL if its scheme is http or https, else null."""
    return F.when(F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))).isin("http", "https"), c)


def snippet(*cols: Column, max_len: int = 360) -> Column:
    """First of the columns that isn't empty, cut to max_len with an ellipsis."""
    text = F.coalesce(*[empty_to_null(c) for c in cols])
    return F.when(F.length(text) > max_len, F.concat(F.substring(text, 1, max_len - 3), F.lit("…"))).otherwise(text)
