"""What is shuffled and saved follows the input, not users times articles."""

import re

from newsloom.functions.session import saved
from newsloom.operators import joins, stories
from newsloom.registry import QUERIES


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_given_to_members_tells_members_apart_last(spark):
    rows = spark.range(40).selectExpr("array(id % 2) has", "id article_id")
    members = spark.range(25).selectExpr("array(if(id < 20, 0L, 1L)) has", "id user_id")
    for slices, pack in ((64, 1000), (3, 4)):
        got = joins.given_to_members(rows, members, "has", "user_id", slices, pack)
        want = rows.join(members, "has").select("has", "article_id", "user_id")
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_latest_digest_meets_packs_of_users(spark, sf):
    """Users times articles is what the last step makes, in many tasks."""
    df = QUERIES["E1_latest_digest"](spark, sf)
    text = plan(df)
    assert re.search(r"Generate explode\(_members", text) and df.rdd.getNumPartitions() == 64


def test_explained_equals_scores_and_contributions(spark):
    from newsloom.operators import adjust

    rows = spark.createDataFrame([(1, 10, 40, ["a", "b", "b"]), (1, 11, 70, ["c"]), (2, 10, 55, ["a", "c"]), (3, 12, 5, []), (1, 13, 0, None)], "user_id long, article_id long, base int, features array<string>")
    weights = spark.createDataFrame([(1, "a", 0.5), (1, "b", -1.25), (1, "c", 0.0), (2, "c", 2.0)], "user_id long, feature string, weight double")
    found = adjust.explained(rows, weights).collect()
    got = {(r.user_id, r.article_id): r.score for r in found}
    assert got == {(r.user_id, r.article_id): r.score for r in adjust.recommended(rows, weights).collect()}
    parts = {(r.user_id, r.article_id, p.feature, p.contribution, k) for r in found for k, p in enumerate(r.contributions, 1)}
    assert parts == {tuple(r) for r in adjust.contributions(rows, weights).select("user_id", "article_id", "feature", "contribution", "place").collect()} and len(parts) == 3


def test_article_detail_shuffles_no_related_stories_beside_users(spark, sf):
    text = plan(QUERIES["L11_article_detail"](spark, sf))
    join = text[: text.index("Exchange hashpartitioning")] if "Exchange hashpartitioning" in text else text
    assert "article_id" in join and "user_id" not in re.search(r"\w+Join \[([^\]]*)\]", text).group(1)


def test_marks_of_a_user_are_folded_together():
    import pandas as pd

    from newsloom.streaming import keyed

    kinds = ["read", "unread", "bookmark", "unbookmark", "rate"]
    rows = pd.DataFrame([(k % 3, 1000 * k, k, k % 5, kinds[k * 7 % 5], k % 4) for k in range(60)], columns=["story", *keyed.MARK])
    state, want, alone = None, [], {}
    for part in (rows[:25], rows[25:]):
        state, got, _ = keyed._user_marks_step((1,), state, part, 0)
        want = []
        for story, own in part.groupby("story"):
            alone[str(story)], frame, _ = keyed._mark_step((1, story), alone.get(str(story)), own, 0)
            want += frame.astype(str).values.tolist()
        assert sorted(got.astype(str).values.tolist()) == sorted(want) and state == alone


def test_users_with_the_same_profile_are_one_row(spark):
    from newsloom.operators import vectors

    terms = spark.createDataFrame([(u, 0, "interest", 1.0, 7 + u // 10, [1.0, 0.0]) for u in range(30)], "user_id long, pos int, kind string, weight double, vec_id long, vector array<double>")
    users = spark.range(30).selectExpr("id user_id", "if(id < 5, 'a', 'b') has")
    base = spark.createDataFrame([(g, v, 0.1, 0.5) for g in "ab" for v in (7, 8, 9)], "has string, vec_id long, mean double, sd double")
    rows = vectors.shared_profiles(terms, base, users).collect()
    assert sorted(sorted(r.users) for r in rows) == [list(range(5)), list(range(5, 10)), list(range(10, 20)), list(range(20, 30))]


def test_percentile_scores_shuffle_no_row_of_a_user_and_an_article(spark, sf):
    text = plan(QUERIES["K6_percentile_scores"](spark, sf))
    assert "Exchange" not in text[: text.index("MapInArrow")]


def test_a_profile_that_comes_back_has_its_scores_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from newsloom.operators import vectors

    articles = spark.range(4).selectExpr("id article_id", "array(1.0D) vector", "id seq")
    terms = lambda w: spark.createDataFrame([(u, 0, "interest", w, 1, [1.0]) for u in (1, 2)], "user_id long, pos int, kind string, weight double, vec_id long, vector array<double>")
    score = lambda some, used: some.select("article_id").crossJoin(used.select("user_id", (F.col("weight") * 10).cast("int").alias("score"))).select("user_id", "article_id", "score")
    table = vectors.ScoreTable(spark, str(tmp_path / "scores"), buckets=2)
    for w in (1.0, 0.5, 1.0):
        table.update(articles, terms(w), score)
        assert sorted((r.user_id, r.article_id, r.score) for r in table.read().collect()) == [(u, i, int(w * 10)) for u in (1, 2) for i in range(4)]
    assert spark.read.parquet(str(tmp_path / "scores/scores-0")).count() == 12  # for two users, three runs of four articles


def test_stale_sources_deal_days_by_their_number(spark, sf):
    """One table of users and days, from which states, runs and days go to as many tasks as it has rows for."""
    from newsloom.fixtures import Tables
    from newsloom.plans import monitoring

    events = Tables(spark, sf).events
    rows = events.groupBy("user_id", events.ts.cast("date")).count().count()
    found = monitoring.quiet_tables(Tables(spark, sf), 100)
    assert [df.rdd.getNumPartitions() for df in found] == [-(-rows // 100)] * 3 and rows > 100
    want = monitoring.states(events.selectExpr("concat('u', user_id) source_id", "ts", "value"))
    assert sorted(map(str, found[0].collect())) == sorted(map(str, want.collect()))
    assert found[1].selectExpr("sum(total)").first()[0] == events.count()


def test_glossary_hits_look_at_a_text_once(spark):
    """Equal to the check of each source in each text, and sources of plain words need no such check."""
    from pyspark.sql import functions as F

    from newsloom.functions.text import mentions

    texts = ["The  nuclear\nplants, and IAEA's", "nuclear plantes iaea IAEAs (über)", "xnuclear plant", "éa naïve fox-es don't", "Foxes dons", "Kelvin co-op", "a, b", "", None, "a. b c d", "NUCLEAR PLANT", "C++ 　 c++s 7up"]
    words = ["nuclear plant", "IAEA", "Iaea", "über", "ber", "naïve", "fox", "don't", "don", "elvin", "kelvin", "co-op", "co", "a, b", "a", "b c d", "b c x", "b  c", "c++", "++", "7up", "7UP", "", " ", "é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sources = spark.createDataFrame(list(enumerate(words)), "term_id long, source string")
    for some in (sources, sources.filter("source rlike '^[A-Za-z0-9 ]+$'")):
        want = docs.crossJoin(some.filter("source <> ''")).filter(mentions(F.col("text"), F.col("source"))).select("id", "term_id")
        df = joins.glossary_hits(docs, some)
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))
    keyed = {r.source: r for r in joins.keyed_sources(sources).collect()}
    assert keyed["nuclear plant"].whole and keyed["don't"].whole and not keyed["über"].whole and [bytes(k) for k in keyed["IAEA"].keys] == [b"=IAEA", b"=IAEAs", b"=IAEAes"]
    assert "(es|s)?" not in plan(joins.glossary_hits(docs, sources))


def test_leave_one_out_of_users_across_batches(spark):
    """Users that go on in the next batch, dealt by their number and not left to one task, are predicted as by fits of their own."""
    import numpy as np

    from newsloom.operators import adjust

    rng = np.random.default_rng(5)
    rows = [(u, a, int(rng.integers(0, 101)), int(rng.integers(1, 6)), [f"t{k}" for k in rng.choice(6, rng.integers(0, 4), replace=False)]) for u in range(12) for a in range(int(rng.integers(1, 9)))]
    train = spark.createDataFrame(rows, "user_id long, article_id long, base int, stars int, features array<string>")
    name, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(name, 3)
    try:
        got = {(r.user_id, r.article_id): r.prediction for r in adjust.leave_one_out(train, prior=1.0, share=3).collect()}
    finally:
        spark.conf.set(name, before)
    assert len(got) == len(rows)
    for u, a, base, _, own in rows:
        others = [r for r in rows if r[0] == u and r[1] != a]
        names = sorted({f for r in rows if r[0] == u for f in r[4]})
        x = np.array([[float(n in r[4]) for n in names] for r in others]).reshape(len(others), len(names))
        w = adjust.fit_weights(np.array([r[2] for r in others], float), (np.array([r[3] for r in others], float) - 1) / 4, x, 1.0)
        p = min(max(base / 100, 0.005), 0.995)
        assert abs(got[u, a] - 100 / (1 + np.exp(-np.log(p / (1 - p)) - sum(w[names.index(f)] for f in own)))) < 1e-5
    assert adjust.dealt(train, "user_id").rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_pages_go_to_python_in_small_batches(spark):
    from newsloom.functions.session import PAGES
    from newsloom.sources import ingest

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    pages = spark.createDataFrame([(1, "<article><p>a &amp; b</p></article>"), (2, None), (3, "")], "page_id long, html string")
    assert sorted(map(tuple, ingest.article_bodies(pages).collect())) == [(1, "a & b"), (2, None), (3, None)]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == PAGES


def test_compared_pairs_equal_those_one_by_one():
    """Whatever the number of bigrams, those with the same last bits among them; vectors come as bytes, and no pair is intersected for itself."""
    import numpy as np
    import pyarrow as pa

    from newsloom.operators import stories

    rng = np.random.default_rng(1)
    for kinds, space in ((50, 1 << 6), (3000, 1 << 40), (40_000, 1 << 62)):
        pool = np.unique(rng.integers(-space, space, kinds)) << (10 if kinds == 50 else 0)
        sides = [[rng.choice(pool, rng.integers(0, 40), replace=False) for _ in range(700)] for _ in "ab"]
        weights = [[rng.random(len(x)) for x in side] for side in sides]
        columns = [pa.array(range(700)), pa.array(range(700)), *(stories.pack(pa.array(x)) for x in (sides[0], weights[0], sides[1], weights[1]))]
        batch = pa.record_batch(columns, names=["a", "b", "a_terms", "a_weights", "b_terms", "b_weights"])
        want = [sum(w * dict(zip(y, v)).get(t, 0) for t, w in zip(x, u)) for x, u, y, v in zip(sides[0], weights[0], sides[1], weights[1])]
        for part in (batch, batch.slice(13, 300)):
            first = part.column("a")[0].as_py()
            (got,) = stories._compared(0.0)(iter([part]))
            assert np.allclose(got.column("similarity").to_numpy(), want[first : first + part.num_rows], atol=1e-9)
    numbers = stories._Numbers()
    h = rng.integers(-5, 5, 1000) << 16  # all in one place
    assert len(np.unique(numbers.of(h))) == len(np.unique(h)) == numbers.size and (numbers.of(h) == numbers.of(h)).all()


def test_similar_pairs_by_blocks_equal_all_pairs(spark, monkeypatch):
    """Postings of a bigram and slot in several blocks: no similarity bound is computed row by row, no pair is lost."""
    from pyspark.sql import functions as F

    from newsloom.functions.session import saved
    from newsloom.operators import stories

    monkeypatch.setattr(stories, "BLOCK", 3)
    texts = spark.range(40).selectExpr("id", "timestamp'2024-01-01' + make_interval(0, 0, 0, int(id)) at", "concat(substring('the quick brown fox jumps over', 1 + int(id % 4), 20), repeat(char(97 + int(id % 7)), int(id % 3))) text")
    texts = saved(texts)
    vectors = saved(stories.tf_idf(texts))
    for least, some in ((0.17, 100), (0.5, 1)):
        got = stories.similar_pairs(vectors, texts, texts, saved, least, 13)
        l, r = (vectors.join(texts, "id").select(F.col("id").alias(n), F.col("at").alias(f"{n}_at"), "gram", F.col("weight").alias(f"{n}_w")) for n in ("target", "id"))
        want = l.join(r, "gram").filter("target <> id and abs(unix_micros(target_at) - unix_micros(id_at)) <= 13 * 86400000000").groupBy("target", "id").agg(F.round(F.sum(F.col("target_w") * F.col("id_w")), 9).alias("s")).filter(F.col("s") >= least)
        assert sorted((x.target, x.id) for x in got.collect()) == sorted((x.target, x.id) for x in want.collect()) and got.count() > some


def test_links_that_are_stars_need_no_rounds(spark):
    """Groups of near copies are linked with one lead each, so their components are there; each round costs the driver ten stages."""
    saves = []

    def save(df):
        saves.append(saved(df))
        return saves[-1]

    star = [(10 * k, 10 * k + j) for k in range(20) for j in range(1, 5)]
    for edges, rounds in ((star, 0), ([], 0), ([(1, 2), (2, 3)], 1)):
        saves.clear()
        found = stories.labels(spark.createDataFrame(edges, "a long, b long"), save).collect()
        assert {r.node: r.component for r in found} == ({x: 10 * (x // 10) if edges is star else 1 for e in edges for x in e})
        assert len(found) == len({x for e in edges for x in e}) and len(saves) == 1 + 2 * rounds


def test_scores_of_all_users_are_dealt_by_their_rows(spark, sf, monkeypatch):
    """Few bytes become many rows: tasks follow the rows of the result, and a raw score is rounded for a profile, not for each of its users."""
    from newsloom.operators import vectors

    for name, n in (("TASK", 100), ("ARTICLES", 50), ("USERS", 2)):
        monkeypatch.setattr(vectors, name, n)
    for query in ("K4_raw_scores", "K6_percentile_scores", "K8_formula_trials"):
        df = QUERIES[query](spark, sf)
        assert df.rdd.getNumPartitions() > 20
    text = plan(QUERIES["K4_raw_scores"](spark, sf))
    assert "round(" in text[text.index("explode(users") :] and "round(" not in text[: text.index("explode(users")]


def test_similar_texts_equal_all_pairs(spark, monkeypatch):
    """Texts in blocks of slots, few bigrams held by all tasks, copies, texts without bigrams, characters of more than 16 bits; what similar_pairs finds, without a table of vectors or postings."""
    from pyspark.sql import functions as F

    texts = spark.range(60).selectExpr("id", "timestamp'2024-01-01' + make_interval(0, 0, 0, int(id * 2)) at", "case when id % 20 = 7 then 'x ' when id % 20 = 8 then '' else concat(substring('the quick brown fox jumps over 語語の 𠀀𠀁', 1 + int(id % 4), 28), repeat(char(97 + int(id % 7)), int(id % 3))) end text")
    texts = saved(texts)
    vectors = saved(stories.tf_idf(texts.withColumn("text", F.translate("text", "𠀀𠀁", "ΐΰ"))))  # two others that stand alone
    for least, per_block, grams, some in ((0.17, 1000, 1 << 18, 500), (0.17, 3, 5, 500), (0.9, 2, 0, 10)):
        monkeypatch.setattr(stories, "TEXTS", per_block)
        monkeypatch.setattr(stories, "GRAMS", grams)
        tables = []
        got = stories.similar_texts(texts, lambda d: (tables.append(saved(d)), tables[-1])[1], least, 13).collect()
        want = stories.similar_pairs(vectors, texts, texts, saved, least, 13).collect()
        assert {(r.target, r.id): round(r.similarity, 8) for r in got} == {(r.target, r.id): round(r.similarity, 8) for r in want}
        assert len(got) == len(want) > some and not any(kind.startswith("array") for t in tables for _, kind in t.dtypes)
    assert stories.similar_texts(texts.filter("id < 0"), saved).collect() == []


def test_story_queries_save_no_vectors(spark, sf):
    """A vector has ten times the bytes of its text, and its postings as many again."""
    for query in ("C8_similar_pairs", "H15_sparse_cosine", "J4_candidates", "J5_imported_judgments", "J6_automatic_verdicts"):
        assert "explode(_v" not in (text := plan(QUERIES[query](spark, sf))) and "shares" not in text and "weights" not in text


def test_latest_digest_is_dealt_by_its_rows(spark, sf, monkeypatch):
    """Few bytes become a row for each user and article: tasks follow these, and no row is lost."""
    few = QUERIES["E1_latest_digest"](spark, sf)
    monkeypatch.setattr(joins, "TASK", 10)
    monkeypatch.setattr(joins, "MOST", 90)
    many = QUERIES["E1_latest_digest"](spark, sf)
    assert many.rdd.getNumPartitions() == 90 and many.count() == few.count() and many.exceptAll(few).isEmpty()
