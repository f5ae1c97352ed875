import json

from pyspark.sql import functions as F

from resumelake.functions import spans, text
from resumelake.operators import cvjson, exclusion, extraction, profile, redaction
from resumelake.schema import CV


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def texts(spark, f, *values):
    d = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string")
    return [r.y for r in d.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def test_layout_text(spark):
    raw = "Projekt ●Erster Punkt\n\n12\n-\n\n--- Page 2 ---\nText nach dem Strich\nAcme Gmb H, m ail@acme.example\nEnt-\nscheidung\nEin Satz, der\nweiter geht.\nNeuer Satz\n- Liste die\nHier weiter geht\nEingesetzte Technologien:\njava\n02/2020 Beginn\nder Zeile\n\n\n\nENDE GUT\nalles gut"
    want = "Projekt\n- Erster Punkt\n\n--- Page 2 ---\n- Text nach dem Strich Acme GmbH, mail@acme.example Ent-scheidung Ein Satz, der weiter geht.\nNeuer Satz\n- Liste die Hier weiter geht\nEingesetzte Technologien:\njava\n02/2020 Beginn\nder Zeile\n\nENDE GUT alles gut\n"
    assert texts(spark, text.layout_text, raw, "", None, "a\r\nb") == [want, "", "", "a b\n"]


def test_clean_name(spark):
    assert texts(spark, text.clean_name, "Office: Anna Muster", "Anna Muster Mobil", "Anna Kontakt Muster", "Anna  Muster") == ["Anna Muster", "Anna Muster", "Anna Muster", "Anna  Muster"]


def test_technologies_split(spark):
    assert one(spark, text.technologies_split(F.array(*map(F.lit, ["Java Maven", " Go ", "", "Go", "a, b Jira", "java"])))) == ["Java", "Maven", "Go", "a, b Jira", "java"]


def test_technology_words(spark):
    terms = exclusion.lexicon("JavaScript", "Spring Boot", "go")
    assert texts(spark, lambda x: exclusion.is_technology(x, terms), "JavaScript", "Java", "Script", "Anna Go", "Anna", "J", None) == [True, True, False, True, False, False, None]
    assert texts(spark, lambda x: exclusion.is_technology(x, terms, F.lit("uses JAVASCRIPT daily")), "Script", "Spring") == [True, False]


def test_persons_that_are_technologies(spark):
    t = "Anna Muster uses JavaScript in Gießen. " + "x" * 60 + " Skills: Bob Ross " + "y" * 60 + " Carl Go"
    mark = lambda w, kind: (kind, t.index(w), t.index(w) + len(w), 0.8)
    found = [mark("Anna Muster", "PERSON"), mark("Java", "PERSON"), mark("Gießen", "PERSON"), mark("Bob Ross", "PERSON"), mark("Carl Go", "LOCATION"), mark("uses", "EMAIL_ADDRESS")]
    d = spark.createDataFrame([(t, found)], f"t string, s array<{spans.SPAN}>")
    got = d.select(exclusion.without_technologies(F.col("t"), F.col("s"), exclusion.lexicon("javascript", "go"), exclusion.lexicon("giessen")).alias("s")).first().s
    assert [t[s.start : s.end] for s in got] == ["Anna Muster", "uses"]


def test_span_sets(spark):
    s = [("A", 0, 5, 0.5), ("A", 5, 8, 0.9), ("B", 8, 9, 0.1), ("A", 8, 12, 0.2)]
    d = spark.createDataFrame([(s, [("C", 6, 7, 1.0)]), ([], [])], f"s array<{spans.SPAN}>, o array<{spans.SPAN}>")
    got = d.select(exclusion.touching_merged(F.col("s")).alias("m"), exclusion.outside(F.col("s"), F.col("o")).alias("f")).collect()
    assert [tuple(x) for x in got[0].m] == [("A", 0, 8, 0.9), ("B", 8, 9, 0.1), ("A", 8, 12, 0.2)]
    assert [x.start for x in got[0].f] == [0, 8, 8] and got[1].m == [] and got[1].f == []


def test_names_in_lists_of_technologies(spark):
    d = spark.createDataFrame([("Technologien: Anna Muster",), ("x, Anna Muster, y",), ("Anna Muster, Bonn " + "z" * 300 + " kenntnisse: none",), ("no one",), ("ä" * 120 + " a, b, ANNA MUSTER",)], "t string")
    assert [r.x for r in d.select(exclusion.in_technology_list(F.col("t"), F.lit("Anna Muster")).alias("x")).collect()] == [True, True, False, False, True]


def test_anonymized(spark):
    d = spark.createDataFrame([(1, "Anna Muster, anna@mail.example.com, https://www.shop.example.com/a/b. Frau MUSTER, A. M. war da.", "Anna Muster"), (2, None, None), (3, "nobody here", None)], "doc_id long, text string, name string")
    got = redaction.anonymized(d, policy="keep_domain").orderBy("doc_id").collect()
    assert "Anna" not in got[0].redacted and "MUSTER" not in got[0].redacted and "A. M." not in got[0].redacted and "mail.example.com" not in got[0].redacted
    values = {m.value for m in got[0].mapping}
    assert {"anna@mail.example.com", "Anna Muster", "Muster", "A. M."} <= values
    assert len({m.key for m in got[0].mapping}) == len(got[0].mapping)
    assert got[1].redacted is None and got[2].redacted == "nobody here\n" and got[2].mapping == []


CV_JSON = {
    "summary": " A  \n\n\n\nB ",
    "experience": [
        {"start_date": "2020-01", "end_date": "present", "is_current": True, "company": "Acme", "role": "Engineer", "description": "", "technologies": ["Java Maven", "java"]},
        {"start_date": "2018-06", "end_date": "2019-12", "company": "Beta", "description": "Tasks: one ● two", "technologies": None},
    ],
    "projects": [{"start_date": "2021-01", "end_date": "2021-06", "role_description": "Lead", "technologies": ["Go"]}],
    "skills": {"technologies": [" a ", "a", "b"]},
}


def test_polished_and_indexed(spark):
    d = spark.createDataFrame([("1", "a.json", json.dumps(CV_JSON)), ("2", "b.json", None), ("3", "c.json", "{}")], "doc_id string, file_name string, j string").withColumn("cv", F.from_json("j", CV))
    d = d.withColumn("cv", cvjson.polished(F.col("cv")))
    cv = d.first().cv
    assert cv.summary == "A\n\nB" and cv.experience[0].description == "Engineer" and cv.experience[0].technologies == ["Java", "Maven", "java"]
    assert cv.experience[1].description == "Tasks:\n- one\n- two" and cv.experience[1].technologies == [] and cv.skills.technologies == ["a", "b"] and cv.skills.soft_skills == []
    rows = {r.doc_id: r for r in cvjson.index_documents(d, "2025-06", "2025-06-01T00:00:00").collect()}
    assert sorted(rows) == ["1", "3"]
    assert [(t.technology, t.total_months, t.project_count) for t in rows["1"].technology_experience] == [("java", 130, 0), ("maven", 65, 0), ("go", 5, 1)]
    assert rows["3"].technology_experience == [] and set(rows["3"].summary_embedding) == {0.0}
    assert abs(sum(x * x for x in rows["1"].experience_combined_embedding) - 1) < 1e-5 and len(rows["1"].summary_embedding) == 384
    plan = cvjson.index_documents(d, "2025-06", "x")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert plan.count("Exchange hashpartitioning") <= 2


def _replies():
    """A client whose replies depend on the document and on whether it was asked again."""

    def call(prompt):
        if "refuse" in prompt:
            raise RuntimeError("refused")
        if "slow" in prompt and extraction.AGAIN not in prompt:
            return "let me think"
        if "never" in prompt:
            return "no"
        return 'Here: {"summary": "ü"} as asked'

    return call


def test_structured_extraction(spark):
    d = spark.createDataFrame([(1, "fine"), (2, "slow"), (3, "never"), (4, "refuse"), (5, None), (6, " ")], "doc_id long, text string")
    got = {r.doc_id: r for r in extraction.structured(d, _replies(), "Text: {DOCUMENT_TEXT} Schema: {SCHEMA_TEXT}", "{}", wait=0).collect()}
    assert [json.loads(got[k].structured) for k in (1, 2)] == [{"summary": "ü"}] * 2 and "ü" in got[1].structured and got[1].llm_error is None
    assert all(got[k].structured == "" for k in (3, 4, 5, 6)) and "3 attempts" in got[3].llm_error and got[4].llm_error == "refused" and got[5].llm_error == "no text"
    cvs = {r.doc_id: r for r in extraction.documents_to_cvs(d, _replies(), "{DOCUMENT_TEXT}", wait=0).collect()}
    assert cvs[1].cv.summary == "ü" and cvs[1].plain_txt == "fine\n" and cvs[1].mapping is None and cvs[4].cv is None
    hidden = extraction.documents_to_cvs(d.where("doc_id = 1"), _replies(), "{DOCUMENT_TEXT}", redact=True, wait=0).first()
    assert hidden.plain_txt is None and hidden.mapping == "[]"


def test_json_of_replies():
    assert extraction.json_of("[1]") == [1] and extraction.json_of('a {"b": {"c": 1}} d') == {"b": {"c": 1}} and extraction.json_of("{no}") is None and extraction.json_of("") is None
    assert extraction.client("OLLAMA", model="ollama/x").model == "ollama/x" and extraction.client("openai", key="k").model


def test_converted(spark):
    t = "Anna Muster\nBonn, Germany\nanna@mail.example.com\nhttps://github.com/anna\n01/2020 - 03/2020\nAcme GmbH\nSenior Engineer\nTechnologien: Kafka, SQL, Java\n04/2020 - 05/2020\nBeta GmbH and more text\nTechnologien: SQL, Docker, Java\nSkills\nJava, Python, SQL"
    d = spark.createDataFrame([(1, t, "x.pdf"), (2, "", "erika_muster.pdf"), (3, None, "c.pdf")], "doc_id long, text string, file_name string")
    got = {r.doc_id: r for r in profile.converted(d, "2021-01", raw_chars=5).collect()}
    r = got[1]
    assert r.core_profile.name == "Anna Muster" and r.core_profile.email == "anna@mail.example.com" and r.core_profile.links_by_class.github == ["https://github.com/anna"]
    assert [(m.technology, m.months, m.years) for m in r.technology_months] == [("Java", 5, 0.42), ("SQL", 5, 0.42), ("Kafka", 3, 0.25), ("Docker", 2, 0.17)]
    assert r.skills == ["Java", "Python", "SQL"] and r.quality_report.flags.has_skills_section and r.quality_report.flags.has_timeline_chunks and r.raw_text == "Anna \n... [TRIMMED]\n"
    assert got[2].core_profile.name == "erika muster" and got[2].quality_report.confidence.name_confidence == 0.55 and got[2].timeline_chunks == [] and got[3].skills == [] and not got[3].quality_report.flags.has_email
    assert "Exchange" not in profile.converted(spark.range(1).select(F.col("id").alias("doc_id"), F.lit(t).alias("text")), "2021-01")._jdf.queryExecution().executedPlan().toString()
