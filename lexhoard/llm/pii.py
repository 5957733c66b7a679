"""Personal data by offset-preserving deobfuscation.

Base identifiers are found in the text as it is. Where a text shows a disguise (look-alike characters, spelled digits, written
at and dot), small transducers write a normalised text with a map to source offsets; identifiers found there that touch a
rewritten character are mapped back to source spans and added. Each text is one row's work, linear in its length.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexhoard.llm.base import arrow_sized, documents

#: Kinds in the order in which spans that start together are listed.
KINDS = ["email", "ip", "card", "phone"]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Characters that look like ASCII ones.
HOMOGLYPHS = dict(zip("аеорсухіѕјԁɡοανАВЕКМНОРСТХΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxisjdgoavABEKMHOPCTXABEZHIKMNOPTYX", strict=True))
#: Digits as words.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
#: Words for @ and for a full stop.
AT_WORDS, DOT_WORDS = ["at", "arroba"], ["dot", "punkt", "punto", "point"]
#: Last labels that an address written with bare words must end in, as "at" and "dot" are common words.
LAST_LABELS = ["com", "org", "net", "edu", "gov", "int", "info", "biz", "io", "ai", "app", "dev", "co", "us", "uk", "eu", "de", "fr", "es", "it", "nl", "ch", "at", "ca", "au", "jp", "cn", "in", "br", "mx"]
#: Words that announce an address, and words that stand before "at" in any sentence and name no mailbox.
CUES = ["mail", "email", "e-mail", "contact", "to", "from", "cc", "write", "address", "reach"]
NO_NAMES = ["look", "looking", "looked", "visit", "visiting", "me", "us", "you", "him", "her", "it", "them", "be", "is", "are", "was", "were", "meet", "met", "arrive", "stay", "live", "work", "working", "only", "here", "there", "available", "found", "home", "and", "or", "not", "this", "that"]
#: Digit words in a row that count as a number written out.
MIN_SPELLED = 7
_INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"

_at, _dot, _digit = "|".join(AT_WORDS), "|".join(DOT_WORDS), "|".join(DIGIT_WORDS)
_at_in, _dot_in = _at + "|@", _dot + r"|\."  # within brackets
_LOOK = "".join(HOMOGLYPHS) + "\uff01-\uff5e" + _INVISIBLE
_LOOKS = f"[{_LOOK}]"
_BRACKETED = r"\s?[(\[{{<]\s?(?:{})\s?[)\]}}>]\s?"
_SPELLED = rf"\b(?:plus[\s-]{{1,3}})?(?:{_digit}|[0-9]+)(?:[\s,-]{{1,3}}(?:{_digit}|[0-9]+))+\b"
_LABEL = rf"[A-Za-z0-9{_LOOK}-]+"
_AT = re.compile(rf"(?i)(?P<bracket>{_BRACKETED.format(_at_in)})|(?P<bare>\s(?:{_at})\s)|@")
_DOT = re.compile(rf"(?i)(?P<bracket>{_BRACKETED.format(_dot_in)})|(?P<bare>\s(?:{_dot})\s)|\.")
_NEXT = re.compile(_LABEL)
_PART = rf"(?:{_digit}|[0-9])(?:[\s-]{{0,3}}(?:{_digit}|[0-9])){{0,2}}"
_NUMBERS = re.compile(rf"(?i)(?<![0-9A-Za-z]){_PART}(?:(?:{_BRACKETED.format(_dot_in)}|\s(?:{_dot})\s|\.){_PART}){{3}}(?![0-9A-Za-z])")
_SAID = re.compile(rf"(?i){_digit}|[0-9]")
_LOCAL_SIDE = re.compile(f"[A-Za-z0-9._%+{_LOOK}-]")
_DISGUISE = re.compile(rf"(?i:{_BRACKETED.format(_at_in + '|' + _dot_in)}|\b(?:{_digit})[\s,-]{{1,3}}(?:{_digit}|[0-9])|[0-9][\s,-]{{1,3}}(?:{_digit})\b)|{_LOOKS}|(?i:\s(?:{_dot})\s|\s(?:{_at})\s{_LABEL}\.[A-Za-z0-9])")
_REWRITE = re.compile(rf"(?P<bracket>(?i:{_BRACKETED.format(_at_in + '|' + _dot_in)}))|(?P<spelled>(?i:{_SPELLED}))|(?P<looks>{_LOOKS})")


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _luhn(digits: str) -> bool:
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def find_identifiers(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every identifier that stands in the text undisguised, sorted."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _plain(s: str) -> str:
    return "".join("" if c in _INVISIBLE else HOMOGLYPHS.get(c) or (chr(ord(c) - 0xFEE0) if "\uff01" <= c <= "\uff5e" else c) for c in s)


def _mailbox(text: str, end: int) -> bool:
    """Whether the word that ends there has a digit, or one of ._%+- within it, or follows a word that announces an address and
    isn't one of NO_NAMES."""
    start = end
    while start > 0 and _LOCAL_SIDE.match(text[start - 1]):
        start -= 1
    word = text[start:end].strip("._%+-")
    if any(c.isdigit() or c in "._%+-" for c in word):
        return True
    before = _plain(text[max(0, start - 12) : start]).lower().split()
    return bool(before) and before[-1].strip(":,;(") in CUES and _plain(word).lower() not in NO_NAMES


def _spoken(text: str, start: int, end: int) -> dict[int, tuple[str, int]]:
    """The digits of one part of a number: each takes what separates it from the next."""
    said = list(_SAID.finditer(text, start, end))
    ends = [*[x.start() for x in said[1:]], end]
    return {x.start(): (DIGIT_WORDS.get(x[0].lower(), x[0]), b) for x, b in zip(said, ends, strict=True)}


def _addresses(text: str) -> dict[int, tuple[str, int]]:
    """What the at and the dots of written addresses become, by source start: (character, source end).

    At and dot may each be bracketed, bare or plain. An address with a bare "at" and no bracketed dot must end in one of
    LAST_LABELS and not begin with www, as "at" stands before places and sites too; others may end in any label. If its dots are
    all plain, as in "look at example.com", the word before must look like a mailbox: have a digit, or a sign between letters, or be announced as in "write to".
    Of numbers of four parts, digits may be words.
    """
    out: dict[int, tuple[str, int]] = {}
    for m in _AT.finditer(text):
        if m.start() == 0 or not _LOCAL_SIDE.match(text[m.start() - 1]):
            continue
        label, dots, ends = _NEXT.match(text, m.end()), [], []
        first = label and _plain(label[0]).lower()
        while label and (dot := _DOT.match(text, label.end())) and (label := _NEXT.match(text, dot.end())):
            dots.append(dot)
            if _plain(label[0]).lower() in LAST_LABELS:
                ends.append(len(dots))
        marked = any(d.lastgroup == "bracket" for d in dots)
        if m.lastgroup == "bare" and not marked:
            n = 0 if first == "www" else max(ends, default=0)
            if n and all(d.lastgroup is None for d in dots[:n]) and not _mailbox(text, m.start()):
                n = 0
        else:
            # Bare dots after the last known label are rather words of the sentence.
            n = max(ends, default=0) if ends and all(d.lastgroup == "bare" for d in dots[max(ends) :]) else len(dots)
        if n:
            out[m.start()] = ("@", m.end())
            out.update({d.start(): (".", d.end()) for d in dots[:n]})
    for m in _NUMBERS.finditer(text):
        at = m.start()
        for d in _DOT.finditer(text, m.start(), m.end()):
            out.update(_spoken(text, at, d.start()))
            out[d.start()] = (".", d.end())
            at = d.end()
        out.update(_spoken(text, at, m.end()))
    return {a: (c, b) for a, (c, b) in out.items() if text[a:b] != c}


def _rewritten(m: re.Match) -> list[tuple[str, int, int]]:
    """What a disguise becomes: (characters, source start, source end)."""
    s, a, b = m[0], m.start(), m.end()
    if m.lastgroup == "bracket":
        return [("@" if re.search(rf"(?i)\b(?:{_at})\b|@", s) else ".", a, b)]
    if m.lastgroup == "looks":
        return [] if s in _INVISIBLE else [(_plain(s), a, b)]
    said = list(re.finditer(rf"(?i)\b(?:{_digit})\b|[0-9]", s))
    if len(said) < MIN_SPELLED or all(len(x[0]) == 1 for x in said):
        return [(c, a + i, a + i + 1) for i, c in enumerate(s)]
    out = [("+", a, a + 4)] if s[:4].lower() == "plus" else []
    return out + [(DIGIT_WORDS.get(x[0].lower(), x[0]), a + x.start(), a + x.end()) for x in said]


def find_disguised(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Identifiers that appear in the normalised text only, as source spans that no base span holds whole."""
    if not _DISGUISE.search(text):
        return []
    pieces, starts, ends, fresh, last = [], [], [], [], 0

    def put(chars: str, a: int, b: int, new: bool) -> None:
        pieces.append(chars)
        starts.append(a)
        ends.append(b)
        fresh.append(new)

    def keep(a: int, b: int) -> None:
        pieces.append(text[a:b])
        starts.extend(range(a, b))
        ends.extend(range(a + 1, b + 1))
        fresh.extend(b"\0" * (b - a))

    def rest(a: int, b: int) -> None:
        nonlocal last
        for m in _REWRITE.finditer(text, a, b):
            keep(last, m.start())
            for chars, x, y in _rewritten(m):
                put(chars, x, y, text[x:y] != chars)
            last = m.end()
        keep(last, b)
        last = b

    for a, (c, b) in sorted(_addresses(text).items()):
        if a >= last:
            rest(last, a)
            put(c, a, b, True)
            last = b
    rest(last, len(text))
    # Base spans by start, with the furthest end so far: one lookup tells whether any holds a span whole.
    first, reach = [x for x, _, _ in base], list(accumulate((y for _, _, y in base), max))
    out = []
    for a, kind, b in find_identifiers("".join(pieces)):
        if any(fresh[a:b]) or starts[a] + b - a != ends[b - 1]:
            lo, hi = starts[a], ends[b - 1]
            n = bisect_right(first, lo)
            if not n or reach[n - 1] < hi:
                out.append((lo, kind, hi))
    return out


def _spans(text: str | None) -> list[dict]:
    if not text:
        return []
    base = find_identifiers(text)
    found = [(*x, True) for x in base] + [(*x, False) for x in find_disguised(text, base)]
    return [{"kind": KINDS[k], "start": a, "end": b, "base": given} for a, k, b, given in sorted(found)]


def _find(batches):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_spans(t) for t in batch.column(1).to_pylist()], kind)], ["doc_id", "spans"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): one row per input row; spans is an array of (kind, start, end, base) in code points, end exclusive,
    by start and then kind. Null and empty texts have none."""
    arrow_sized(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_find, f"doc_id {rows.schema[0].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def masked(text: str) -> str:
    """The text with each identifier replaced by its kind; of overlapping spans the first one names the whole."""
    out, last = [], 0
    for s in _spans(text):
        if s["start"] >= last:
            out += [text[last : s["start"]], f"[{s['kind'].upper()}]"]
        last = max(last, s["end"])
    return "".join(out) + text[last:]


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with identifiers in its text replaced; all columns, rows and nulls stay."""
    arrow_sized(docs.sparkSession)
    at = docs.columns.index(text_col)

    def mask(batches):
        for batch in batches:
            new = pa.array([t and masked(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(mask, docs.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all `documents`: counts and digest of base spans, and all spans."""
    found = find_pii(documents(spark, sf_dir))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
