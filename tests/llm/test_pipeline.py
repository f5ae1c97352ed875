import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as p


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, kept, sf)
        assert out.columns == docs.columns, name
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in kept.select("doc_id").collect()} and len(ids) == out.count()
        kept = out
    packed = p.run(spark, sf).toPandas()
    from resumelake.llm.wordpiece import Encoder, vocabulary_path

    texts = {r.doc_id: r.text for r in kept.collect()}
    raw = dict(zip(texts, (x + np.array([1], "<u4").tobytes() for x in Encoder(vocabulary_path()).encode(list(texts.values()))), strict=True))
    assert packed["length"].sum() * 4 == sum(map(len, raw.values()))
    for r in packed.itertuples():
        assert zlib.crc32(raw[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32


def test_near_copies_go_and_others_stay(spark):
    words = [f"w{k * k % 977}x{k}" for k in range(400)]
    base = " ".join(words)
    near = " ".join([*words[:200], "changed", *words[201:]])
    other = " ".join(f"v{k * 7 % 991}y{k}" for k in range(400))
    rows = [(1, base), (2, base), (3, near), (4, other), (5, None), (6, ""), (None, base)]
    d = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id is None, r.doc_id) for r in p.drop_near_copies(spark, d, "").collect()) == [(False, 1), (False, 4), (False, 5), (True, None)]


def test_rows_of_one_id_with_different_texts_stay(spark):
    long = " ".join(f"w{k}" for k in range(100))
    rows = [(1, long), (5, "another text of seven words it is"), (5, "and yet another text with more words"), (5, long), (7, "same"), (7, "same"), (8, long + " end"), (None, long), (None, long)]
    d = spark.createDataFrame([(*r, "en", "s", 1, "x", 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, t string, d int")
    out = sorted((str(r.doc_id), r.text[:12]) for r in p.drop_near_copies(spark, d, "").collect())
    assert out == [("1", "w0 w1 w2 w3 "), ("5", "and yet anot"), ("5", "another text"), ("7", "same"), ("None", "w0 w1 w2 w3 "), ("None", "w0 w1 w2 w3 ")]


def test_crowds_are_compared_in_blocks(spark, monkeypatch):
    """Texts that share all words but a few, in families: a shingle is shared by more of them than one block holds."""
    from resumelake.llm import simhash

    monkeypatch.setattr(simhash, "CROWD", 8)
    monkeypatch.setattr(simhash, "ORDER_TEXTS", 1)
    rng, rows = np.random.default_rng(4), []
    for n in range(300):
        words = [f"t{k}" for k in range(60)]
        for k in rng.choice(60, rng.integers(0, 3), replace=False):
            words[k] = f"o{n}x{k}"
        rows.append((n, " ".join(words)))
    sets = [frozenset(simhash._shingles(t.encode().split(), 5)) for _, t in rows]
    label = list(range(300))
    for i in range(300):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    monkeypatch.setattr(simhash, "links", lambda nodes, *_: nodes.select(F.col("rep").alias("src"), F.col("rep").alias("dst"), F.lit(0).alias("bits")).where("false"))
    got = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 2, 2, 28, 0.8).collect()}
    assert got == dict(enumerate(label)) and 1 < len(set(label)) < 300


def test_a_block_of_a_crowd_gives_fewer_links_than_sets(spark, monkeypatch):
    """All pairs of a large group of near copies are similar: what comes out of a block doesn't grow with its square, and connects as much as all pairs do."""
    from resumelake.llm import simhash

    rng = np.random.default_rng(8)
    sets = []
    for family in range(4):
        base = rng.integers(0, 1 << 48, 100, dtype=np.uint64)
        for _ in range(60):
            own = base.copy()
            own[rng.choice(100, rng.integers(0, 9), replace=False)] = rng.integers(0, 1 << 48, dtype=np.uint64)
            sets.append(np.unique(own))
    rows, n = np.arange(240), np.array([len(s) for s in sets])
    found = simhash._spanning(rows // 2 * 2, rows[::3], rows, n, np.zeros(240, dtype=np.int64), sets, 0.8)
    label = rows // 2 * 2
    want = label.copy()
    for i in rows[::3]:
        for j in rows:
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= 0.8 * (n[i] + n[j] - both):
                want[want == want[j]] = want[i]
    for i, j in found:
        both = len(np.intersect1d(sets[i], sets[j]))
        assert both >= 0.8 * (n[i] + n[j] - both) and label[i] != label[j]
        label[label == label[j]] = label[i]
    assert len(found) < 120 and len({*zip(label.tolist(), want.tolist(), strict=True)}) == len(set(label.tolist())) == len(set(want.tolist())) < 120


def test_few_links_are_joined_at_the_driver_to_the_same_components(spark):
    from resumelake.llm import graph

    rng = np.random.default_rng(2)
    pairs = [*zip(rng.integers(0, 400, 300).tolist(), rng.integers(0, 400, 300).tolist(), strict=True), (7, 7), (None, 3), (3, None), (-5, 2)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    got = [sorted(map(tuple, graph.components(e, few).collect())) for few in (0, 1000)]
    assert got[0] == got[1] and len(got[0]) > 200 and graph.components(e.where("false"), 1000).count() == 0


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert p.drop_near_copies(spark, d, "").count() == p.replace_personal_data(spark, d, "").count() == p.pack(spark, d, "").count() == 0


def test_equal_fingerprints_of_different_texts_stay_apart(spark):
    from resumelake.llm import simhash

    line = " ".join(f"common{k}" for k in range(9))
    texts = [" ".join([line] * 130 + [f"{own}{k}" for k in range(800)]) for own in "ab"]
    assert simhash.fingerprint(texts[0], 5, 2) == simhash.fingerprint(texts[1], 5, 2)
    rows = [(1, texts[0]), (2, texts[1]), (3, texts[1])]
    d = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in p.drop_near_copies(spark, d, "").collect()) == [1, 2]


def test_all_pairs_at_the_similarity_are_found(spark):
    """Pairs at about 0.81, among others, are together; pairs at about 0.77 aren't."""
    from resumelake.llm import simhash

    rng = np.random.default_rng(9)
    rows, want = [], {}
    for n in range(1500):
        words = [f"w{k}" for k in rng.integers(0, 50_000, 300)]
        near = list(words)
        for k in range(9, 300, 50 if n % 2 else 40):
            near[k] = f"own{n}x{k}"
        a, b = (frozenset(simhash._shingles([w.encode() for w in t], 5)) for t in (words, near))
        together = len(a & b) >= 0.8 * len(a | b)
        assert together == (n % 2 == 1)
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(near))]
        want |= {2 * n: 2 * n, 2 * n + 1: 2 * n + (not together)}
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_groups(d, p.SHINGLE, p.WORDS, p.GUARANTEED, p.SIMILAR, p.JACCARD).collect()}
    assert got == want


def test_near_copies_in_a_crowd_of_less_similar_texts_are_found(spark, monkeypatch):
    """Texts of one template (about 0.7 to each other), a near copy of each: 100 groups of two."""
    from resumelake.llm import pigeonhole, simhash

    monkeypatch.setattr(pigeonhole, "HEAVY", 4)
    rows, sets = [], {}
    for n in range(100):
        words = [f"template{k}" for k in range(300)]
        words[:50] = [f"own{n}x{k}" for k in range(50)]
        near = list(words)
        for k in (100, 140, 180, 220, 260):
            near[k] = f"copy{n}x{k}"
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(near))]
    sets = {i: frozenset(simhash._shingles(t.encode().split(), 5)) for i, t in rows}
    similar = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert similar == {(2 * n, 2 * n + 1) for n in range(100)}
    got = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), p.SHINGLE, p.WORDS, p.GUARANTEED, p.SIMILAR, p.JACCARD).collect()}
    assert got == {i: i - i % 2 for i in sets}


def test_of_a_crowd_only_sets_that_can_have_a_partner_are_read(spark, monkeypatch):
    """Texts that share a passage, and so a crowd, but aren't similar: their maps tell, and their sets, many times longer, aren't dealt."""
    from resumelake.llm import simhash

    rows = [(n, " ".join([f"t{k}" for k in range(60)] + [f"o{n}x{k}" for k in range(40)])) for n in range(80)]
    rows += [(80 + n, f"{rows[n][1]} end") for n in range(2)]
    asked, sets_of = [], simhash._sets_of

    def spy(some, *others):
        asked.append(some.distinct().count())
        return sets_of(some, *others)

    monkeypatch.setattr(simhash, "CROWD", 8)
    monkeypatch.setattr(simhash, "_frequent", lambda *_: np.zeros(1, dtype="<u2"))
    monkeypatch.setattr(simhash, "_sets_of", spy)
    monkeypatch.setattr(simhash, "links", lambda nodes, *_: nodes.select(F.col("rep").alias("src"), F.col("rep").alias("dst"), F.lit(0).alias("bits")).where("false"))
    got = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 2, 2, 28, 0.8).collect()}
    assert got == {n: n % 80 for n in range(82)} and asked and max(asked) <= 4


def test_shingles_of_a_passage_come_last_though_few_texts_have_it(spark, monkeypatch):
    """One text in ten has the passage: a sample that doesn't grow with the table would hardly meet it."""
    from resumelake.llm import simhash

    monkeypatch.setattr(simhash, "ORDER_TEXTS", 1)
    passage = [f"p{k}" for k in range(12)]
    rows = [(n, " ".join([f"o{n}x{k}" for k in range(60)] + passage * (n % 10 == 0))) for n in range(400)]
    common = {int(x) for x in simhash._print(" ".join(passage), 5, 2)[1]}
    prints = simhash._whole_prints(spark.createDataFrame(rows, "doc_id long, text string"), 5, 2, 0.8).collect()
    assert len(prints) == 400 and all(len(r.prefix) > 80 and common.isdisjoint(np.frombuffer(r.prefix, "<i8").tolist()) for r in prints)
