import json

import pytest
from pyspark.sql import functions as F

from resumelake.operators import experience, identity, layout, profile, redaction, retrieval, timeline
from resumelake.sources import files


def test_technology_experience_by_hand(spark):
    rows = [
        (1, 1, "experience", "2020-01", "present", True, ["Python", "TensorFlow", "AWS", "Docker"]),
        (1, 2, "experience", "2018-06", "2019-12", False, ["Python", "Django", "PostgreSQL"]),
        (1, 3, "project", "2021-01", "2021-06", False, ["python ", "TensorFlow", "Kubernetes", ""]),
    ]
    e = spark.createDataFrame(rows, "doc_id long, seq long, kind string, start_date string, end_date string, is_current boolean, technologies array<string>")
    got = {r.technology: (r.total_months, r.experience_count, r.project_count, r.last_used_date, r.is_current) for r in experience.technology_experience(e, "2025-06").collect()}
    assert got["python"] == (88, 2, 1, "present", True)
    assert got["tensorflow"] == (70, 1, 1, "present", True)
    assert got["aws"] == (65, 1, 0, "present", True)
    assert got["django"] == (18, 1, 0, "2019-12", False)
    assert got["kubernetes"] == (5, 0, 1, "2021-06", False)
    assert len(got) == 7


def test_filter_is_on_one_element(spark):
    df = spark.createDataFrame([(1, [("java", 5), ("go", 90)]), (2, [("java", 40)])], "doc_id long, technology_experience array<struct<technology:string,total_months:long>>")
    assert [r.doc_id for r in experience.search(df, ["Java"], min_months=30).collect()] == [2]
    assert [r.doc_id for r in experience.search(df, ["java"], min_months=1000, min_years=0.25).collect()] == [2, 1]


CV = """[HEADER_AREA] Anna Muster
--- Page 1 ---
[LEFT_COLUMN] 02/2019 - 11/2020
Acme GmbH
Senior Engineer
- Entwicklung einer Plattform mit Java
[RIGHT_COLUMN] sidebar text that is skipped
Technologien: Kafka, k8s, SQL
2017
- never collected since no end date follows
--- Page 2 ---
seit 03/2021
Beta AG
- Migration nach AWS und Docker
Skills
01/2022 - 02/2022
Gamma GmbH with a long enough text
"""


def test_timeline_rules(spark):
    d = spark.createDataFrame([(1, CV), (2, "Profil\n01/2020 - 02/2021\nAcme GmbH, a long line of text"), (3, ""), (4, None)], "doc_id long, text string")
    got = timeline.timeline(d, "2024-01").orderBy("doc_id", "seq").collect()
    assert [(r.doc_id, r.start_date, r.end_date, r.months) for r in got] == [(1, "2019-02", "2020-11", 22)]
    assert got[0].header_lines == ["Acme GmbH", "Senior Engineer"]
    assert got[0].technologies == ["Kafka", "Kubernetes", "SQL"]
    assert got[0].source_pages == [1]
    assert all("sidebar" not in x for x in got[0].body_lines)


def test_profile(spark):
    t = "Anna Muster\nanna@mail.example.com 0176 5550123\nwww.anna-muster.de node.js\nSkills:\nJava, Go, Rust\nEducation\nMaster, University of Bonn 1990 - 1994\nCertificates\nAWS certified\n"
    d = spark.createDataFrame([(1, t)], "doc_id long, text string")
    s = {(r.section, r.line) for r in profile.sections(d).collect()}
    assert ("skills", "Java, Go, Rust") in s and ("unknown", "Anna Muster") in s and ("certifications", "AWS certified") in s
    c = profile.contacts(d).first()
    assert c.email == "anna@mail.example.com" and c.phones == ["01765550123"] and "https://www.anna-muster.de" in c.links and "https://node.js" not in c.links
    assert profile.quality(profile.contacts(d)).first().has_links


def test_identity(spark):
    d = spark.createDataFrame([(1, "Anna Muster\nEngineer\nEmail: anna.muster@mail.de\nAnna Muster works. Anna again, Muster too.")], "doc_id long, text string")
    c = identity.from_header(d).unionByName(identity.from_email(d))
    assert {(r.name, r.source) for r in c.collect()} == {("Anna Muster", "header"), ("Anna Muster", "email")}
    assert identity.primary(identity.scored(c, d)).first().name == "Anna Muster"
    v = d.select(identity.variants(F.lit("Anna-Lena Muster"), F.lit("Anna said")).alias("v")).first().v
    assert v[0] == "Anna-Lena Muster" and {"Muster", "Lena", "Muster Anna-Lena", "Anna"} <= set(v)
    m = d.select(redaction.names_masked(F.col("text"), F.array(), F.array(F.lit("Anna Muster"), F.lit("Anna"))).alias("m")).first().m
    assert "Anna" not in m.text.replace("anna.muster", "") and m.mapping[0].key == "<PERSON1>"


def test_lexicon_filter(spark):
    v = spark.createDataFrame([(1, "Red Hat"), (2, "kube"), (3, "bern"), (4, "ernet")], "id long, value string")
    lex = spark.createDataFrame([("hat",), ("Kubernetes",)], "term string")
    ids = lambda how: sorted(r.id for r in identity.lexicon_filter(v, lex, how).collect())
    assert ids("word") == [2, 3, 4] and ids("prefix") == [1, 3, 4] and ids("substring") == [1]


def test_redaction_modes(spark):
    t = "Call +49 30 12345678 or +49 30 12345678, mail a.b@cd.de; 12345 Stadtheim am See"
    d = spark.createDataFrame([(1, t), (2, None), (3, "")], "doc_id long, text string")
    full = {r.doc_id: r for r in redaction.redacted(d).collect()}
    assert "a.b@cd.de" not in full[1].redacted and "12345678" not in full[1].redacted
    assert full[2].redacted is None
    one = {r.doc_id: r for r in redaction.redacted_values(d, 1000).collect()}[1]
    assert len({m.key for m in one.mapping if m.key.startswith("<PHONE")}) == 1


@pytest.mark.parametrize(("policy", "want"), [("keep_domain", "b.de/<PATH>"), ("redact_all", "<URL>"), ("allowlist_domains_keep_domain", "<URL>")])
def test_url_policy(spark, policy, want):
    d = spark.createDataFrame([("https://www.B.de/x?y",)], "u string")
    assert d.select(redaction.url_shown(F.col("u"), policy, ("c.de",)).alias("o")).first().o == want


def test_layout(spark):
    b = spark.createDataFrame([(1, p, "top", f"Page {p} of 3") for p in (1, 2, 3)] + [(1, p, "bottom", f"x{'y' * p}") for p in (1, 2, 3)] + [(2, 1, "top", "z")], "doc_id long, page long, zone string, text string")
    assert [(r.zone, r.signature, r.n) for r in layout.repeated(b).collect()] == [("top", "page # of #", 3)]
    assert layout.body(b).count() == 4
    w = spark.createDataFrame([(1, 0, 0, 1, 0.0, 0.0, 9.0, 1.0, "ab"), (1, 0, 0, 2, 9.5, 0.0, 12.0, 1.0, "c"), (1, 0, 0, 3, 20.0, 0.0, 25.0, 1.0, "d")], "page long, block_no int, line_no int, word_no int, x0 double, y0 double, x1 double, y1 double, word string")
    assert layout.lines(w).first().text == "abc d"


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 1.0)], "doc_id long, score double")
    b = spark.createDataFrame([(3, 9.0), (4, 8.0)], "doc_id long, score double")
    one, two = ([tuple(r) for r in retrieval.fused(x, y, 3).collect()] for x, y in ((a, b), (b, a)))
    assert one == two and one[0][0] == 3


def test_json_source(spark, tmp_path):
    cv = {"summary": "s", "experience": []}
    (tmp_path / "a.json").write_text(json.dumps(cv))
    (tmp_path / "b.json").write_text(json.dumps({"llm_json": cv}))
    (tmp_path / "c.json").write_text("not json")
    got = {r.doc_id: r.cv for r in files.cv_documents(spark, str(tmp_path)).collect()}
    assert got["a"].summary == "s" and got["b"].summary == "s" and got["c"] is None


def test_upsert_and_delete(spark):
    t = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "doc_id long, v string, seq int")
    up = files.upserted(t, spark.createDataFrame([(2, "c", 1)], t.schema))
    assert {tuple(r) for r in up.collect()} == {(1, "a", 0), (2, "c", 1)}
    assert files.deleted(up, up.where("doc_id = 1")).count() == 1


def test_streaming_ingest(spark, tmp_path):
    from resumelake.streaming import ingest

    spark.createDataFrame([(1, "mail a@bc.de")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    q = ingest.ingest(ingest.documents(spark, str(tmp_path / "in"), "doc_id long, text string"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert "a@bc.de" not in spark.read.parquet(str(tmp_path / "out")).first().redacted
