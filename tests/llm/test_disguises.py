"""What a disguise is and what plain prose is; cost of many spans; markers with capitals beyond ASCII."""

import time

import pytest

from lexhoard.llm import pii, toxicity


def _added(text):
    return [(s["kind"], text[s["start"] : s["end"]]) for s in pii._spans(text) if not s["base"]]


@pytest.mark.parametrize("text", ["please look at example.com now", "visit us at home.de", "meet me at noon.it is late", "we met at www.example.com", "come at 9.30 or at noon", "you have to look at example.com", "write to me at example.com", "version one dot two"])
def test_prose_is_left_alone(text):
    assert _added(text) == [] and pii.masked(text) == text


@pytest.mark.parametrize(
    "text,kind,span",
    [
        ("host 192[.]168[.]1[.]1 is up", "ip", "192[.]168[.]1[.]1"),
        ("host 192 dot 168 dot one dot one is up", "ip", "192 dot 168 dot one dot one"),
        ("at one nine two dot one six eight dot one dot one today", "ip", "one nine two dot one six eight dot one dot one"),
        ("write to ada[@]example[.]org soon", "email", "ada[@]example[.]org"),
        ("mail ada.doe at example.com today", "email", "ada.doe at example.com"),
        ("mail ada7 at example.com today", "email", "ada7 at example.com"),
        ("mail ada at example dot com today", "email", "ada at example dot com"),
        ("mail ada (at) mail." + "x" * 80 + " (dot) org", "email", "ada (at) mail." + "x" * 80 + " (dot) org"),
        ("2 dot 300 dot 1 dot 1", None, None),
    ],
)
def test_disguises_are_found(text, kind, span):
    assert _added(text) == ([(kind, span)] if kind else [])


def test_many_spans_in_one_text_take_time_in_proportion():
    one = "ada@example.org and bob [at] example [dot] org and 10 dot 1 dot 2 dot three; "
    took = []
    for n in (4_000, 16_000):
        start = time.process_time()
        spans = pii._spans(one * n)
        took.append(time.process_time() - start)
        assert len(spans) == 3 * n
    assert took[1] < 9 * took[0]


def test_markers_with_other_capitals(spark):
    texts = [(i, f"du bist ein ärsche nummer {i}" if i % 2 else f"das wetter ist heute schön {i}") for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(["ÄRSCHE", "Ärsche hier", "ärsche", "Schön"])], "doc_id long, text string")
    scores = [r["toxicity"] for r in toxicity.score_toxicity(asked, model).orderBy("doc_id").collect()]
    assert min(scores[:3]) > 0.9 and scores[3] < 0.1
    with pytest.raises(ValueError):
        toxicity.score_toxicity(asked.withColumnRenamed("doc_id", "toxicity"), model)


def _forms(token):
    """All readings of a short token by plain listing: each character stands, or is what it may stand for, or is left out."""
    if not token:
        return {""}
    return {x + rest for rest in _forms(token[1:]) for x in {token[0].lower(), *toxicity_options(token[0]), ""}}


def toxicity_options(c):
    return {"1": {"i", "l"}, "0": {"o"}, "3": {"e"}, "@": {"a"}, "$": {"s"}, "4": {"a"}, "5": {"s"}, "7": {"t"}}.get(c, set())


def test_readings_are_among_all_readings():
    model = {f"{a}{b}{c}": -1.0 for a in "^idot" for b in "^idot" for c in "idot^"}
    words = toxicity.lexicon({"idiot": 9.0})
    for token in ("1d10t", "id1ot", "idi0t", "iid1oot", "1D1OT"):
        read = toxicity.decode(token, model, -9.0, words)
        assert read == "idiot" and read in _forms(token)
