import datetime as dt

from pyspark.sql import functions as F

from lexhoard.sources import normalize as N

ARTICLES = """<Set>
<PubmedArticle><MedlineCitation><PMID Version="1">77</PMID><DateCreated><Year>2023</Year><Month>12</Month><Day>30</Day></DateCreated>
<Article><Journal><JournalIssue><PubDate><Year>2024</Year><Month>Feb</Month></PubDate></JournalIssue><Title>Journal of Tests</Title></Journal>
<ArticleTitle>Delivery of <i>small</i> things &amp; more</ArticleTitle>
<Abstract><AbstractText Label="AIM">We <b>test</b> it.</AbstractText><AbstractText Label="END">Done.</AbstractText></Abstract>
<AuthorList><Author><LastName>Doe</LastName><ForeName>Ada</ForeName><Identifier Source="ORCID">https://orcid.org/0000-0001</Identifier>
<AffiliationInfo><Affiliation>Uni One</Affiliation></AffiliationInfo></Author><Author><CollectiveName>The Group</CollectiveName></Author></AuthorList>
<ArticleDate><Year>2024</Year><Month>01</Month><Day>15</Day></ArticleDate></Article></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="doi">10.1000/ABC</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>78</PMID><Article><Journal><Title>J</Title></Journal><ArticleTitle>Plain</ArticleTitle></Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>79</PMID><Article><Journal><Title>J</Title></Journal></Article></MedlineCitation></PubmedArticle>
</Set>"""


def test_articles(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ARTICLES)
    rows = {r["pmid"]: r for r in N.read_pubmed(spark, str(tmp_path / "a.xml")).collect()}
    assert set(rows) == {"77", "78"}  # one has no title
    r = rows["77"]
    assert (r["id"], r["title"], r["abstract"]) == ("doi:10.1000/abc", "Delivery of small things & more", "AIM: We test it.\nEND: Done.")
    assert [a["name"] for a in r["authors"]] == ["Ada Doe", "The Group"] and r["institutions"] == ["Uni One"]
    assert r["published_date"] == dt.date(2024, 2, 1) and r["electronic_published_date"] == dt.date(2024, 1, 15) and r["first_date"] == dt.date(2023, 12, 30)
    assert r["date_precision"] == {"published_date": "month", "electronic_published_date": "day", "first_date": "day"}
    assert rows["78"]["id"] == "pmid:78" and rows["78"]["authors"] == [] and rows["78"]["abstract"] is None


def _json(spark, text, schema):
    return spark.createDataFrame([(text,)], "j string").select(F.from_json("j", schema).alias("x")).select("x.*")


def test_trials(spark):
    study = """{"protocolSection":{"identificationModule":{"nctId":"nct01","briefTitle":"Brief","officialTitle":"Official"},
    "statusModule":{"overallStatus":"RECRUITING","startDateStruct":{"date":"2024-03"},"lastUpdatePostDateStruct":{"date":"2024-05-06"}},
    "sponsorCollaboratorsModule":{"leadSponsor":{"name":"Acme"},"collaborators":[{"name":"Uni"}]},"conditionsModule":{"conditions":["C1"]},
    "designModule":{"studyType":"INTERVENTIONAL","phases":["PHASE1","PHASE2"],"enrollmentInfo":{"count":12}},
    "armsInterventionsModule":{"interventions":[{"name":"drug","otherNames":["d2"]}]},"outcomesModule":{"primaryOutcomes":[{"measure":"m"}],"otherOutcomes":[{"measure":"o"}]},
    "contactsLocationsModule":{"locations":[{"country":"B"},{"country":"A"},{"country":"B"}]}},"hasResults":true}"""
    r = N.normalize_trials(_json(spark, study, N.STUDY_SCHEMA)).first()
    assert (r["id"], r["title"], r["evidence_level"]) == ("nct:NCT01", "Official", "trial results")
    assert r["trial"]["phase"] == ["Phase 1", "Phase 2"] and r["trial"]["countries"] == ["A", "B"] and r["trial"]["start_date"] == dt.date(2024, 3, 1)
    assert [o["outcome_type"] for o in r["trial"]["outcomes"]] == ["primary", "other"] and r["date_precision"]["start_date"] == "month"
    assert [o["organization_type"] for o in r["organizations"]] == ["sponsor", "collaborator"]


def test_preprints(spark):
    page = """{"collection":[{"doi":"10.1/X","title":"T","authors":"Doe, A.; Roe, B.","date":"2024-01-02","version":"2","published":"NA"},
    {"doi":"10.1/Y","title":"U","authors":"Solo","date":"2024-01-03","version":"1","published":"10.2/J"},{"doi":"10.1/Z","title":" "}]}"""
    rows = N.normalize_preprints(_json(spark, page, N.PREPRINT_PAGE_SCHEMA), "biorxiv").orderBy("doi").collect()
    assert [(r["doi"], r["preprint"]["publication_status"], len(r["authors"])) for r in rows] == [("10.1/x", "preprint", 2), ("10.1/y", "published", 1)]
    assert rows[0]["url"] == "https://www.biorxiv.org/content/10.1/xv2"


def test_works(spark):
    work = """{"message":{"DOI":"10.5/W","title":["A <i>b</i>"],"publisher":"P","published-online":{"date-parts":[[2024,5]]},"author":[{"given":"A","family":"B","ORCID":"http://orcid.org/0-1","affiliation":[{"name":"U"}]},{"name":"Team"}],
    "funder":[{"name":"F"}],"relation":{"is-preprint-of":[{"id":"10.6/q"}],"none":[]},"license":[{"URL":"http://l"}],"URL":"http://u"}}"""
    r = N.normalize_crossref(_json(spark, work, N.WORK_SCHEMA)).first()
    assert (r["id"], r["title"], r["published_date"], r["date_precision"]) == ("doi:10.5/w", "A b", dt.date(2024, 5, 1), {"published_date": "month", "first_date": "month"})
    assert [a["name"] for a in r["authors"]] == ["A B", "Team"] and r["authors"][0]["orcid"] == "0-1" and r["relations"] == {"is-preprint-of": ["10.6/q"]} and r["license_url"] == "http://l"


def test_feed(spark):
    rows = [("g1", "News <b>x</b>", "https://e.com/a", "<script>z()</script><p>Hi &amp; by</p>", None, "Tue, 06 Feb 2024 10:00:00 GMT"), ("g2", "Bad", "ftp://e.com", None, None, None), (None, "Doi", "http://e.com/10.1000/q1", None, None, "nonsense")]
    out = {r["title"]: r for r in N.normalize_feed(spark.createDataFrame(rows, N.FEED_SCHEMA), "f", "regulatory").collect()}
    assert set(out) == {"News x", "Doi"}
    assert out["News x"]["description"] == "Hi & by" and out["News x"]["published_date"] == dt.date(2024, 2, 6) and out["News x"]["record_type"] == "regulatory"
    assert out["Doi"]["doi"] == "10.1000/q1" and out["Doi"]["published_date"] is None


def test_feeds_are_joined_where_items_are(spark):
    """A few feeds hold all items; dealt by feed, they would come to as many tasks."""
    feeds = spark.createDataFrame([("f", "regulatory", "Agency")], "name string, source_type string, attribution string")
    items = spark.range(100).select(F.lit("<item/>").alias("raw"), F.lit("f").alias("feed"), F.from_xml(F.lit("<item><title>T</title><link>https://e.com</link></item>"), N.ENTRY_SCHEMA).alias("x")).select("raw", "feed", "x.*")
    out = N.normalize_feeds(items, feeds)
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in out.select("publisher", "record_type").distinct().collect()] == [("Agency", "regulatory")] and out.count() == 100
