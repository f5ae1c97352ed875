import random
import re

import pytest
from pyspark.sql import functions as F

from resumelake.functions import dates, spans, text


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_normal_forms(spark):
    x = F.col("x")
    assert values(spark, ["  a\t b\n ", None, ""], text.norm_space(x)) == ["a b", None, ""]
    assert values(spark, ["Straße"], text.casefold(x)) == ["strasse"]
    assert values(spark, ["a–b c’d"], text.norm_matching(x)) == ["a-b c'd"]
    assert values(spark, ["Müller-Lüdenscheidt!"], text.strip_name_token(x)) == ["Müller-Lüdenscheidt"]
    assert values(spark, ["Page 3 of 12 - 2024"], text.page_signature(x)) == ["page # of # - #"]
    assert values(spark, [" und k8s.", "Spring  Boot:", "JS"], text.technology_name(x)) == ["Kubernetes", "Spring Boot", "JavaScript"]
    assert values(spark, ["+49 (30) 123-4567", "12345"], text.phone_digits(x)) == ["+49301234567", None]
    assert values(spark, ["Tools: a; b; c", "- a\n- b"], text.split_bullets(x)) == ["Tools:\n- a\n- b\n- c", "- a\n- b"]


def test_timeline_text(spark):
    got = values(spark, ["Ent-\nwicklung\r\n•  x   y"], text.timeline_text(F.col("x")))
    assert got == ["Entwicklung\n- x y"]


@pytest.mark.parametrize(
    ("token", "month"),
    [("03/2020", "2020-03"), ("3.2020", "2020-03"), ("2019-4", "2019-04"), ("März 2021", "2021-03"), ("Maerz 2021", "2021-03"), ("Oktober 2018", "2018-10"), ("1999", "1999-01"), ("13/2020", None), ("", None), ("1899", None)],
)
def test_date_token(spark, token, month):
    assert values(spark, [token], dates.date_token(F.col("x"))) == [month]


def test_months(spark):
    rows = [("2020-01", "2020-03"), ("2020-03", "2020-01"), ("2020-01", "present"), ("", "2020-01"), ("2020-01", None)]
    got = spark.createDataFrame(rows, "s string, e string").select(dates.months_exclusive(F.col("s"), F.col("e"), "2020-06-15").alias("x"), dates.months_inclusive(F.col("s"), F.col("e")).alias("i")).collect()
    assert [r.x for r in got] == [2, 0, 6, 0, 6]
    assert got[0].i == 3 and got[1].i == 0
    assert values(spark, ["2020-01"], dates.month_before(F.col("x"))) == ["2019-12"]


def test_anchors(spark):
    lines = ["Dev (02/2019 - 11/2020)", "2018 bis 2020", "Talk (2025)", "seit 4/2006", "2017", "no"]
    got = values(spark, lines, dates.date_anchor(F.col("x")))
    assert [g and (g.start, g.end, g.end_missing) for g in got] == [("2019-02", "2020-11", False), ("2018-01", "2020-12", False), ("2025-01", "2025-12", False), ("2006-04", "2006-04", True), ("2017-01", "2017-01", True), None]
    got = values(spark, ["October 2018 - 2020", "seit 03/2020", "2019 - heute"], dates.date_range(F.col("x"), "2024-01"))
    assert got[0] is None and (got[1].start, got[1].end) == ("2020-03", "2024-01") and (got[2].start, got[2].end) == ("2019-01", "2024-01")


def test_dates_are_read_once(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["date_range_parse"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("since|seit|ab") <= 2  # one test, one replacement; not for each column and condition
    got = values(spark, ["1999\u2028", "seit 2001\u2028", "12.2019 – 1.2020 – 3.2020", "2020 -", "a, 2020", "mar, 2020", "20 -2020"], dates.date_range(F.concat(F.col("x"), F.lit(" to 3.2021"))))
    assert [g and (g.start, g.end) for g in got] == [("1999-01", "2021-03"), None, ("2019-12", "2020-01"), None, None, ("2020-03", "2021-03"), None]


def test_found_positions_equal_finditer(spark):
    random.seed(3)
    pattern = r"[0-9]{2,4}"
    texts = ["".join(random.choice("ab1234 ß\n") for _ in range(random.randint(0, 60))) for _ in range(60)] + ["", "12", "x12"]
    got = values(spark, texts, spans.found(F.col("x"), pattern, "N", 0.5))
    for t, g in zip(texts, got, strict=True):
        assert [(s.start, s.end) for s in g] == [m.span() for m in re.finditer(pattern, t)]


def brute_collapse(spans_):
    out = []
    for s in sorted(spans_, key=lambda s: (s[1], -s[2], -s[3], s[0])):
        worth = lambda s: (spans.PRIORITY.get(s[0], 0), s[3], s[2] - s[1])
        if out and s[1] <= out[-1][2]:
            if worth(s) > worth(out[-1]):
                out[-1] = s
        else:
            out.append(s)
    return out


def test_collapse_equals_brute_force(spark):
    random.seed(5)
    rows = []
    for _ in range(80):
        one = []
        for _ in range(random.randint(0, 7)):
            a = random.randint(0, 30)
            one.append((random.choice([*spans.PRIORITY]), a, a + random.randint(1, 9), random.choice([0.5, 0.85])))
        rows.append(("x" * 60, one))
    df = spark.createDataFrame(rows, f"t string, s array<{spans.SPAN}>")
    for r in df.select("s", spans.collapsed(F.col("t"), F.col("s")).alias("c")).collect():
        got = [tuple(x) for x in r.c]
        assert got == brute_collapse([tuple(x) for x in r.s])
        assert all(a[2] < b[1] for a, b in zip(got, got[1:], strict=False))


def test_numbering_starts_at_the_end(spark):
    t = "a@bc.de x d@ef.gh"
    p, score = spans.PATTERNS["EMAIL_ADDRESS"]
    got = values(spark, [t], spans.numbered(F.col("x"), spans.found(F.col("x"), p, "EMAIL_ADDRESS", score)))[0]
    assert got.text == "<EMAIL_ADDRESS2> x <EMAIL_ADDRESS1>"
    assert [(m.key, m.value) for m in got.mapping] == [("<EMAIL_ADDRESS1>", "d@ef.gh"), ("<EMAIL_ADDRESS2>", "a@bc.de")]


def test_dates_are_not_phones(spark):
    x = F.col("x")
    kept = spans.without_dates(x, spans.detected(x, [r for r in spans.RECOGNIZERS if r[0] == "PHONE_NUMBER"]))
    got = values(spark, ["Phone: +49 30 12345678", "Engineer (2020-2024)"], kept)
    assert len(got[0]) == 1 and not got[1]


def test_tidied(spark):
    assert values(spark, ["<URL1> <URL2> x ,y 10.5\n\n\n\nz"], spans.tidied(F.col("x"))) == ["<URL1> x, y 10. 5\n\nz\n"]


def shown(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_timeline_tries_each_pattern_once(spark):
    from resumelake.operators import timeline

    d = spark.createDataFrame([(1, "x", ["x"])], "doc_id long, text string, lines array<string>")
    assert shown(d.select(timeline.technologies_of(F.col("lines")).alias("t"))).count("eingesetzte") <= 2  # a test, a replacement
    lines = shown(d.select(timeline.lines_of(F.col("text"), "2024-01").alias("t")))
    assert lines.count("heute") <= 2 and lines.count("since|seit|ab") <= 5
    text_ = "\n".join(["---Page 3---", "[LEFT_COLUMN] 03/2019 - 04/2020", "Acme GmbH", "Bonn", "Technologien: Kafka,k8s ; SQL|", "[RIGHT_COLUMN] Kenntnisse", "·  ", "seit 05.2020", "Tech Stack", "Java / node", "", "Studium", "2001 - 2002", "x" * 30])
    got = spark.createDataFrame([(1, text_)], "doc_id long, text string")
    rows = [(r.start_date, r.end_date, r.header_lines, r.body_lines, r.technologies, r.source_pages) for r in timeline.timeline(got, "2024-01").orderBy("seq").collect()]
    assert rows == [("2019-03", "2020-04", ["Acme GmbH"], ["Technologien: Kafka,k8s ; SQL|"], ["Kafka", "Kubernetes", "SQL"], [3])]


def test_sections_try_headings_once(spark):
    from resumelake.operators import profile

    d = spark.createDataFrame([(1, "a\n\n Skills \nJava; SQL\n\t\nSkills\nBildung:\n1990 - 1994"), (2, None), (3, ""), (4, "Skills")], "doc_id long, text string")
    assert shown(d.select(profile.section_lines(F.col("text")).alias("t"))).count("kurzprofil") == 1
    got = {r.doc_id: r.s and [tuple(x) for x in r.s] for r in d.select("doc_id", profile.section_lines(F.col("text")).alias("s")).collect()}
    assert got == {1: [("unknown", 0, "a"), ("skills", 3, "Java; SQL"), ("skills", 4, "\t"), ("education", 7, "1990 - 1994")], 2: None, 3: [], 4: []}
