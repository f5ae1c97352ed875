"""Detection, redaction, identity and timeline against plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from resumelake.functions import spans, text
from resumelake.operators import exclusion, extraction, identity, layout, redaction, timeline
from resumelake.sources import files

WORDS = ["Anna", "wort", "a.b@mail.example.com", "me at example dot org", "+49 30 12345678", "2020-2024", "Hauptstraße 5, 12345 Stadt", "10115 Berlin", "www.shop.example/x", "https://example.org/path", "linkedin.com/in/anna-muster7", "node.js", "\n", "ä😀", "0176 5550001", "03/2021", "﷐"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12)))) for k in range(120)] + [(900, ""), (901, " ".join(["a1@b.example.org"] * 700)), (902, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def matches(t):
    """All matches by the pattern strings, read by Python's re."""
    out = []
    for kind, pattern, score, _ in spans.RECOGNIZERS:
        flags = 0
        if m := re.match(r"\(\?([iuU]+)\)", pattern):
            flags, pattern = (re.IGNORECASE if "i" in m[1] else 0), pattern[m.end() :] if "U" in m[1] else pattern[m.end() :].replace(r"\w", "A-Za-z0-9_")
        else:
            pattern = pattern.replace(r"\w", "A-Za-z0-9_")  # letters of ASCII only, though word ends count all letters
        out += [(kind, m.start(), m.end(), score) for m in re.finditer(pattern, t, flags)]
    return out


def collapsed(t, found, longest=160):
    worth = lambda s: (spans.PRIORITY.get(s[0], 0), s[3], s[2] - s[1])
    out = []
    for s in sorted((s for s in found if s[2] - s[1] <= longest and "\n" not in t[s[1] : s[2]]), key=lambda s: (s[1], -s[2], -s[3], s[0])):
        if out and s[1] <= out[-1][2]:
            if worth(s) > worth(out[-1]):
                out[-1] = s
        else:
            out.append(s)
    return out


def dated(t, s):
    return s[0] == "PHONE_NUMBER" and re.search("|".join(spans.DATES), t[s[1] : s[2]])


def numbered(t, found):
    mapping, count = [], {}
    for kind, a, b, _ in sorted(found, key=lambda s: s[1], reverse=True):
        count[kind] = count.get(kind, 0) + 1
        mapping.append((f"<{kind}{count[kind]}>", re.sub(r"\s+", " ", t[a:b]).strip(" ")))
        t = t[:a] + mapping[-1][0] + t[b:]
    return t, mapping


def test_detection_and_tokens(spark, texts):
    d = texts.withColumn("f", spans.detected(F.col("text")))
    d = d.withColumn("c", spans.collapsed(F.col("text"), spans.without_dates(F.col("text"), F.col("f")))).withColumn("n", spans.numbered(F.col("text"), F.col("c")))
    seen = set()
    for r in d.collect():
        if r.text is None:
            assert r.f is None
            continue
        want = matches(r.text)
        assert sorted(tuple(s) for s in r.f) == sorted(want), r.text
        keep = collapsed(r.text, [s for s in want if not dated(r.text, s)])
        assert [tuple(s) for s in r.c] == keep
        out, mapping = numbered(r.text, keep)
        assert r.n.text == out and [tuple(m) for m in r.n.mapping] == mapping
        seen |= {s[0] for s in keep}
    assert seen == {"EMAIL_ADDRESS", "PHONE_NUMBER", "ADDRESS", "LINKEDIN_PROFILE", "URL"}


def test_what_redaction_must_hide_and_keep(spark):
    lines = ["Phone: +49 30 12345678", "Company A, Senior Engineer (2020-2024)", "Adresse: Hauptstraße 5, 12345 Stadt", "Contact: alice@example.com", "write to alice (at) example (dot) com please", "see www.alice.example/cv"]
    d = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    out = {r.doc_id: r.redacted for r in redaction.redacted(d).collect()}
    assert "12345678" not in out[0] and "2020-2024" in out[1] and "Hauptstraße" not in out[2] and "12345" not in out[2]
    assert "alice" not in out[3] + out[4] + out[5] and "<EMAIL_ADDRESS1>" in out[4] and "<URL1>" in out[5]


def ner(x):
    """A stand-in for a model: persons are 'Anna Muster' and 'Java', places 'Bonn'."""
    of = lambda p, k: spans.found(x, p, k, 0.9)
    return F.concat(of("Anna Muster|Java", "PERSON"), of("Bonn", "LOCATION"))


def test_recognizer_is_chained(spark):
    d = spark.createDataFrame([(1, "Anna Muster (Bonn) writes Java, anna@mail.example.com"), (2, None), (3, "x")], "doc_id long, text string")
    got = {r.doc_id: r for r in redaction.redacted(d, ner=ner, technologies=exclusion.lexicon("java")).collect()}
    assert got[1].redacted == "<PERSON1> (<LOCATION1>) writes Java, <EMAIL_ADDRESS1>\n" and got[2].redacted is None and got[3].redacted == "x\n"
    plain = {r.doc_id: r.redacted for r in redaction.redacted(d, ner=ner).collect()}
    assert "Java" not in plain[1]


def test_prefix_and_limited_modes(spark):
    t = "Anna Muster, a@b.example.org, https://example.org/abc. " + "y" * 40 + " ANNA MUSTER A@B.example.org https://example.org/abc c@d.example.org"
    d = spark.createDataFrame([(1, t), (2, None), (3, "short a@b.example.org")], "doc_id long, text string")
    got = {r.doc_id: r for r in redaction.redacted_prefix(d, 60, ner=ner).collect()}
    assert got[1].redacted.startswith("<PERSON1>, <EMAIL_ADDRESS1>, <URL1>") and got[1].redacted.endswith(t[60:]) and got[2].redacted is None
    got = {r.doc_id: r for r in redaction.redacted_values(d, 60, ner=ner).collect()}
    assert got[1].redacted == "<PERSON1>, <EMAIL_ADDRESS1>, <URL1>. " + "y" * 40 + " <PERSON1> <EMAIL_ADDRESS1> <URL1> <EMAIL_ADDRESS2>"
    assert [m.key for m in got[1].mapping] == ["<EMAIL_ADDRESS1>", "<URL1>", "<EMAIL_ADDRESS2>", "<PERSON1>"]


def test_plain_tags(spark, texts):
    for r in texts.select("text", redaction.masked_plainly(F.col("text")).alias("m")).where("text is not null").collect():
        x = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "<EMAIL>", r.text)
        x = re.sub(r"(?<![0-9A-Za-z])\+?[0-9][0-9 ()-]{7,}[0-9](?![0-9A-Za-z])", "<PHONE>", x)
        assert r.m == re.sub(r"(?i)(mein Name ist|my name is|Name:)\s+[^\W\d_]+(?:\s+[^\W\d_]+)?", r"\1 <PERSON>", x)


def test_plain_tags_of_neighbouring_numbers_equal_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    numbers = ("0176 5551234", "+1 (555) 123-4567", "++49 30 1234567", "2020-01-02 10")
    rows = [f"{a}{sep}{b}{end}" for a in numbers for b in numbers for sep in (" ", "\n", ",", " x ") for end in ("", " ", "é")] + ["Name:\x0bAnna", "my name ıs Anna", "mein name iſt\tAnna Ä", "", None]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(c.execute(entry.oracle_sql()["pii_mask_plain"]).fetchall())
    assert len(want) == len(rows) and {r.doc_id: r.masked for r in entry.queries()["pii_mask_plain"](spark, str(tmp_path)).collect()} == want


def test_identity_from_all_sources(spark):
    rows = [
        (1, "Lebenslauf\nAnna Muster\nKontakt: anna.muster@mail.example.com"), (2, "something\nmein Name ist Bernd Beispiel\n"), (3, "see linkedin.com/in/carla-chen42 and info@x.example.com"),
        (4, "d.dorn@mail.example.com"), (5, "Senior Engineer\nErik Ernst\nEmail: e@x.example.com"), (6, "nothing here"), (7, "Technologien: Anna Muster, Kafka, SQL"), (8, None),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.name for r in identity.resolved(d).collect()}
    assert got == {1: "Anna Muster", 2: "Bernd Beispiel", 3: "Carla Chen", 4: "Dorn", 5: "Erik Ernst"}
    named = {r.doc_id: (r.name, r.score) for r in identity.resolved(d, ner).collect()}
    assert named[1][0] == "Anna Muster" and 7 not in named
    out = {r.doc_id: r.redacted for r in redaction.anonymized_documents(d).collect()}
    assert "Anna" not in out[1] and "Muster" not in out[1] and "Bernd" not in out[2] and out[6] == "nothing here\n" and out[8] is None


def test_stop_words_cost_points(spark):
    d = spark.createDataFrame([("header", "Anna Muster", 0, 0), ("header", "Senior Engineer", 0, 0), ("ner", "Anna Muster", 0, 0)], "s string, n string, l int, u int")
    a, b, c = (r.p for r in d.select(identity.score(F.col("s"), F.col("n"), F.col("l"), F.col("u"), F.lit(0.5)).alias("p")).collect())
    assert a - b == 50 and c == 60 + 25 + 15 + 10


def test_stable_ids_in_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(60)]), rng.randint(0, 9), rng.choice(["A", "B"]), f"v{rng.randint(0, 200)}") for _ in range(900)]
    first = {}
    for d, s, e, v in rows:
        at = (-1 if d is None else d, s)
        first[e, v] = min(first.get((e, v), at), at)
    want = {}
    for e in "AB":
        for k, (_, v) in enumerate(sorted((at, v) for (x, v), at in first.items() if x == e)):
            want[e, v] = f"{e.lower()}-{k + 1}"
    df = spark.createDataFrame(rows, "doc_id long, start int, entity string, value string")
    for ranges in (1, 7, 256):
        assert {(r.entity, r.value): r.id for r in redaction.stable_ids(df, ranges).collect()} == want
    docs = spark.createDataFrame([(1, "ab xy cd"), (2, "none"), (3, None)], "doc_id long, text string")
    found = spark.createDataFrame([(1, 0, "A", "ab"), (1, 6, "A", "cd")], "doc_id long, start int, entity string, value string")
    got = {r.doc_id: r.redacted for r in redaction.replaced_by_ids(docs, found, redaction.stable_ids(found)).collect()}
    assert got == {1: "<a-1> xy <a-2>", 2: "none", 3: None}


def test_ordered_distinct(spark):
    rng = random.Random(3)
    rows = [([rng.choice(["a", "A", "b", "B", "ß", None]) for _ in range(n)],) for n in (0, 1, 5, 40)] + [(None,)]
    d = spark.createDataFrame(rows, "x array<string>")

    def plain(xs, key):
        seen, out = set(), []
        for x in xs or []:
            if x is not None and key(x) not in seen:
                seen.add(key(x))
                out.append(x)
        return out if xs is not None else None

    got = d.select("x", text.ordered_distinct(F.col("x")).alias("a"), text.ordered_distinct(F.col("x"), F.lower).alias("b")).collect()
    for r in got:
        assert r.a == plain(r.x, str) and r.b == plain(r.x, str.lower)


#: Line -> (start, end, end missing, now, heading that ends the timeline, skipped, page).
LINES = {
    "01/2020 - 05/2021": ("2020-01", "2021-05", False), "(2019) Talk": ("2019-01", "2019-12", False), "2014 bis 2016 x": ("2014-01", "2016-12", False), "07/2018": ("2018-07", "2018-07", True), "seit 03/2020": ("2020-03", "2020-03", True),
}
OTHERS = ["heute", "Acme Werke GmbH", "- built things for many years", "Technologien: Kafka, k8s", "Berlin", "-", "", "--- Page 2 ---", "--- Page 3 ---", "[RIGHT_COLUMN] side note", "[RIGHT_COLUMN] 07/2018", "[LEFT_COLUMN] a left line", "Lead"]


def machine(lines, asof):
    mode, page, chunks, now = 0, 0, [], None

    def close():
        if mode == 2 and sum(map(len, now["lines"])) >= timeline.LEAST:
            chunks.append((now["start"], now["end"], now["lines"], list(dict.fromkeys(now["pages"]))))

    for raw in lines:
        right, s = raw.startswith("[RIGHT_COLUMN]"), re.sub(r"^\[(LEFT|RIGHT)_COLUMN\]\s*", "", raw)
        if m := re.match(r"--- Page (\d+) ---", raw):
            if mode != 1:
                page = int(m[1])
            if mode == 2:
                now["pages"].append(page)
        elif right and mode < 2:
            continue
        elif s == "Skills":
            close()
            return chunks
        elif s in LINES and right:
            close()
            mode = 0
        elif s in LINES:
            close()
            start, end, missing = LINES[s]
            now, mode = {"start": start, "end": end, "lines": [], "pages": [page] if page else []}, 1 if missing else 2
        elif mode == 1 and s == "heute":
            now["end"], mode = asof, 2
        elif mode == 2 and not right and s not in ("Berlin", "-", "", "Lead", "heute"):
            now["lines"].append(s)
        elif mode == 2 and not right and s in ("heute",):
            now["lines"].append(s)
    close()
    return chunks


def test_timeline_against_a_plain_machine(spark):
    rng, rows = random.Random(11), []
    for k in range(400):
        lines = ["start"] + [rng.choice([*LINES, *OTHERS, *OTHERS]) for _ in range(rng.randint(0, 25))] + (["Skills"] if k % 3 == 0 else []) + ["Acme Werke GmbH", "end of all"]
        rows.append((k, re.sub(r"\n{4,}", "\n\n\n", "\n".join(lines))))
    d = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    got = {r.doc_id: r.c for r in d.select("doc_id", timeline.chunks_of(F.col("text"), "2024-06").alias("c")).collect()}
    some = 0
    for k, t in rows:
        want = machine(t.split("\n"), "2024-06")
        assert [(c.start_date, c.end_date, c.lines, c.pages) for c in got[k]] == want, t
        some += len(want)
    assert some > 200 and not got[1000] and not got[1001]


def test_header_and_body(spark):
    cases = {("Acme GmbH", "Engineer", "did it"): (["Acme GmbH", "Engineer"], ["did it"]), ("- a", "Acme GmbH", "Engineer"): (["Acme GmbH"], ["- a", "Engineer"]), ("- a", "- b"): ([], ["- a", "- b"]), (): ([], []), ("Acme GmbH",): (["Acme GmbH"], [])}
    d = spark.createDataFrame([(list(k),) for k in cases], "x array<string>")
    for r in d.select("x", timeline.header_and_body(F.col("x")).alias("h")).collect():
        assert (r.h.header, r.h.body) == cases[tuple(r.x)]


def test_index_is_upserted(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    rows = lambda *xs: spark.createDataFrame(xs, "doc_id string, cv string")
    assert files.indexed(spark, path) is None
    assert files.index_batch(rows(("a", "1"), ("b", "2"), ("c", None)), path) == {"indexed": 2, "failed": 1, "errors": ["c"]}
    for _ in range(2):  # run again: nothing doubles
        assert files.index_batch(rows(("b", "3"), ("d", "4")), path) == {"indexed": 2, "failed": 0, "errors": []}
        assert sorted(map(tuple, files.indexed(spark, path).collect())) == [("a", "1"), ("b", "3"), ("d", "4")]


def test_documents_without_repeated_headers(spark):
    rows = []
    for page in range(1, 4):
        rows += [(1, page, 0.0, 10.0, 30.0, 1000.0, f"Acme Report page {page} of 3"), (1, page, 0.0, 500.0, 520.0, 1000.0, f"body {page} second"), (1, page, 0.0, 300.0, 320.0, 1000.0, f"body {page} first"), (1, page, 0.0, 950.0, 970.0, 1000.0, f"{page}")]
    rows += [(1, 3, 0.0, 100.0, 120.0, 1000.0, "once only"), (2, 1, 0.0, 10.0, 30.0, 1000.0, "single page header")]
    d = spark.createDataFrame(rows, "doc_id long, page int, x0 double, y0 double, y1 double, height double, text string")
    got = {r.doc_id: r.text for r in layout.document_text(d).collect()}
    assert got[2] == "single page header\n" and "Acme" not in got[1] and "once only" in got[1]
    assert [w for w in got[1].replace("\f", " ").split("\n") if w.strip()][0] == "body 1 first" and got[1].index("body 2 first") < got[1].index("body 2 second")


def test_config_labels_and_candidates(spark):
    d = spark.createDataFrame([(1, "Anna Muster\nwrite to anna.muster@mail.example.com or see https://shop.example.com/a")], "doc_id long, text string")
    r = redaction.anonymized_by(d, redaction.Config()).first()
    assert r.redacted == "<PERSON1>\nwrite to <EMAIL_ADDRESS1> or see <URL1>\n" and json.loads(r.config)["url_policy"] == "keep_domain"
    assert "Anna" in redaction.anonymized_by(d, redaction.Config(propagate_primary_name=False)).first().redacted
    assert "<EMAIL_ADDRESS1>" in redaction.anonymized_by(d, redaction.Config(pii_obfuscation_limit=5)).first().redacted
    x = spark.createDataFrame([("Phone Number",), ("e-mail!",), ("??",)], "x string").select(text.label_key(F.col("x")).alias("y"))
    assert [r.y for r in x.collect()] == ["phone_number", "e_mail", "pii"]
    c = spark.createDataFrame([(1, f"N{k}", "header", k % 7, k) for k in range(30)], "doc_id long, name string, source string, score int, start int")
    assert [r.score for r in identity.top_candidates(c).orderBy("rank").collect()] == [6] * 4 + [5] * 4 + [4] * 2


def test_replies_are_held_against_a_schema():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "items": {"type": ["string", "null"]}}, "b": {"enum": [1, 2]}, "c": {"type": "string", "pattern": "^[0-9]{4}$"}}, "additionalProperties": False}
    bad = {'{"a": ["x", 3]}': "$.a[1] is not of type string or null", "[]": "$ is not of type object", "{}": "$ lacks a", '{"a": [], "b": 3}': "$.b is none of [1, 2]", '{"a": [], "c": "12"}': "$.c does not match ^[0-9]{4}$", '{"a": [], "z": 1}': "$ has z, which the schema doesn't name"}
    for reply, said in bad.items():
        assert extraction.violation(json.loads(reply), schema) == said
    assert extraction.violation({"a": [None, "x"], "b": 2, "c": "2020"}, schema) is None and extraction.violation(True, {"type": "integer"})
    prompts = []

    def call(prompt):
        prompts.append(prompt)
        return ["nothing", '{"a": [3]}', '{"a": ["x"]}'][len(prompts) - 1]

    assert extraction.answered(call, "p", 3, 0, schema) == '{"a": ["x"]}' and "$.a[0]" in prompts[2]
