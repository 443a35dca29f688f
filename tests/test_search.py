"""Searches by postings and cells, stored indexes and whole plans, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import cells, dictionaries, filters, normalize, search, store
from lodestone.operators.pointindex import PointIndex, token_frequencies
from lodestone.functions import encoders
from lodestone.plans import retrieval
from lodestone.sources.tables import cut

POINT = "point_id long, vector array<double>, content string, " + ", ".join(f"{c} string" for c in store.FILTERABLE)
ALIASES = "kind string, ord int, alias string, canonical string, pattern string"


def point_rows(n=160, size=8, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.gauss(3 if i % 5 == j else 0, 0.4) for j in range(size)]
        rows.append((i, v, rng.choice(["rice grows", "Fish swim, fish!", "", None, "rice fish rice"]), rng.choice("abc"), f"T{i % 7}", rng.choice(["A", "B", None]), None, "k", str(2010 + i % 4)))
    rows[3] = (3, rows[2][1], *rows[3][2:])
    rows[9] = (9, [0.0] * size, *rows[9][2:])
    return rows


def question_rows(n=30, size=8, seed=2):
    rng = random.Random(seed)
    asks = [{}, {"year": ["2011"]}, {"year": ["2011", "2012", "2011"], "author": ["A"]}, {"author": ["B"], "source": ["a", "b"]}, {"advisor": ["x"]}, {"nothing": ["x"]}, {"project_title": ["T1"]}, None]
    return [(i, [rng.gauss(0, 1) for _ in range(size)] if i % 10 else [0.0] * size, asks[i % len(asks)]) for i in range(n)]


def brute(questions, points, k):
    def cosine(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 12) if n else 0.0

    out = set()
    for q, v, wanted in questions:
        fit = [p for p in points if all(dict(zip(store.FILTERABLE, p[3:], strict=True)).get(f) in vs for f, vs in (wanted or {}).items())]
        best = sorted((-cosine(v, p[1]), p[0]) for p in fit)[:k]
        out |= {(q, p, i, round(-s, 9) + 0.0) for i, (s, p) in enumerate(best, 1)}
    return out


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(point_rows(), POINT).repartition(3)


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(question_rows(), "question_id long, qvec array<double>, filters map<string,array<string>>")


def found(hits):
    return {(r["question_id"], r["point_id"], r["rank"], round(r["score"], 9) + 0.0) for r in hits.collect()}


@pytest.mark.parametrize("block", [10_000, 7])
def test_filtered_search_equals_brute_force_without_nested_loops(spark, points, questions, monkeypatch, block):
    monkeypatch.setattr(search, "BROADCAST_QUESTIONS", block)
    monkeypatch.setattr(search, "PAIRS_AT_ONCE", 50)
    hits = search.semantic_topk(questions, points, 6)
    assert found(hits) == brute(question_rows(), point_rows(), 6)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_an_index_grows_with_its_table(spark, points, questions):
    old, new = points.filter("point_id < 90"), points.filter("point_id >= 90")
    whole, grown = PointIndex.build(points), PointIndex.build(old).extended(new)
    for name in ("postings", "values", "tokens"):
        assert sorted(map(tuple, getattr(grown, name).collect())) == sorted(map(tuple, getattr(whole, name).collect()))
    assert grown.n_points == whole.n_points == 160
    assert found(search.semantic_topk(questions, points, 4, grown)) == brute(question_rows(), point_rows(), 4)


def test_pair_scores_with_and_without_the_index(spark, points):
    rows = [(1, p[0], q, p[2]) for p in point_rows()[:9] for q in ["rice or fish?"]] + [(2, 1, "", point_rows()[1][2]), (3, 2, "unheard of", point_rows()[2][2])]
    pairs = spark.createDataFrame(rows, "question_id long, point_id long, question string, content string")
    texts = [set((p[2] or "").lower().replace(",", "").replace("!", "").split()) for p in point_rows()]
    weight = lambda t: math.log(1 + 160 / (1 + sum(t in x for x in texts)))
    want = {}
    for q, p, asked, _ in rows:
        tokens = set(asked.replace("?", "").split())
        want[q, p] = sum(weight(t) for t in tokens & texts[p]) / sum(map(weight, tokens)) if tokens else 0.0
    for index in (None, PointIndex.build(points)):
        got = {(r["question_id"], r["point_id"]): r["pair_score"] for r in search.pair_scores(pairs, points, index).collect()}
        assert got == pytest.approx(want)


def test_reranked_hits_read_written_points(spark, small):
    from lodestone import catalog

    for name in ("rerank_topn", "context_text"):
        assert not [f for f in catalog.QUERIES[name](spark, small).inputFiles() if "documents.parquet" in f], name


def test_frequencies_of_wanted_tokens_alone(spark, points):
    wanted = spark.createDataFrame([("rice",), ("unheard",)], "token string")
    every = {r["token"]: r["df"] for r in PointIndex.build(points).tokens.collect()}
    assert {r["token"]: r["df"] for r in token_frequencies(points, wanted).collect()} == {"rice": every["rice"]}
    assert PointIndex.build(points, False).tokens is None


@pytest.mark.parametrize("k, n_cells, block", [(1, None, 10_000), (6, 40, 7), (50, 3, 10_000), (500, 5, 10_000)])
def test_cells_give_what_all_points_give(spark, points, questions, monkeypatch, k, n_cells, block):
    monkeypatch.setattr(search, "BROADCAST_QUESTIONS", block)
    hits, visits = cells.topk(questions, cells.built(points, n_cells), k)
    assert found(hits) == brute([(q, v, None) for q, v, _ in question_rows()], point_rows(), k)
    assert visits.count() == 30


def test_cells_that_cannot_matter_are_skipped(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(9 if j == i % 16 else 0, 0.3) for j in range(16)]) for i in range(800)]
    points = spark.createDataFrame(rows, "point_id long, vector array<double>")
    asked = points.filter("point_id % 40 = 0").select(F.col("point_id").alias("question_id"), F.col("vector").alias("qvec"))
    hits, visits = cells.topk(asked, cells.built(points, 40), 5)
    assert visits.agg(F.avg(F.col("visited") / F.col("cells"))).first()[0] < 0.4
    assert found(hits) == found(search.semantic_topk_blocks(asked, points, 5))


def test_empty_searches(spark, points, questions):
    none = questions.filter("false")
    assert search.semantic_topk(none, points).count() == search.semantic_topk(questions, points.filter("false")).count() == 0
    assert cells.topk(none, cells.built(points))[0].count() == cells.topk(questions, cells.built(points.filter("false")))[0].count() == 0


@pytest.fixture(scope="module")
def corpus(spark):
    said = "content string, source string, project_title string, author string, advisor string, keywords string, year string"
    points = spark.createDataFrame([("rice grows in water", "a.pdf", "Rice Mill", "John Doe", "Dr. Kim", "iot", "2014"), ("fish swim in rice", "b.pdf", "Fish Pond", "John Roe", None, "bio", "2015")], said)
    points = encoders.embed_documents(points.withColumn("point_id", F.when(F.col("source") == "a.pdf", 1).otherwise(2)))
    return retrieval.Corpus.prepared(points, spark.createDataFrame([("staff", 1, "pat", "Dr. Pat", None)], ALIASES))


def test_named_values_are_read_before_marks_are_stripped(spark, corpus):
    q = spark.createDataFrame([(1, 'author:"John Doe" rice'), (2, "rice Author: john, please"), (3, "year of 2015 'title'='fish pond'")], "question_id long, question string")
    got = {r["question_id"]: (dict(r["filters"]), r["residual"]) for r in corpus.parsed(q).collect()}
    assert got[1] == ({"author": ["John Doe"]}, "rice")
    assert got[2][0]["author"] == ["john,"] and got[2][1] == "rice please"
    strict = {r["question_id"]: (dict(r["filters"]), r["residual"]) for r in corpus.parsed(q, strict=True).collect()}
    assert strict[1] != got[1] and '"' in strict[1][1]


def test_a_quoted_author_is_searched_for(spark, corpus):
    q = spark.createDataFrame([(1, 'author:"john doe" rice'), (2, "rice")], "question_id long, question string")
    _, kept = corpus.searched(q)
    got = {(r["question_id"], r["point_id"]) for r in kept.collect()}
    assert {p for i, p in got if i == 1} == {1} and {p for i, p in got if i == 2} == {1, 2}


def test_terms_that_hold_an_end_of_quotation(spark):
    q = spark.createDataFrame([(1, r"on c:\e\files now"), (2, r"by x\ey z")], "question_id long, question string")
    dictionary = spark.createDataFrame([("project_title", r"C:\E\Files", [r"C:\E\Files"])], "field string, term string, full_values array<string>")
    got = {r["question_id"]: (dict(r["filters"]), r["rest"]) for r in filters.dictionary_hit(filters.start(q), dictionary, "project_title").collect()}
    assert got == {1: ({"project_title": [r"C:\E\Files"]}, "on  now"), 2: ({}, r"by x\ey z")}
    aliases = spark.createDataFrame([("staff", 1, r"x\Ey", "Dr. X", None)], ALIASES)
    got = {r["question_id"]: (dict(r["filters"]), r["rest"]) for r in filters.staff(filters.start(q), aliases).collect()}
    assert got[2] == ({"advisor": ["Dr. X"]}, "by  z")


def test_too_many_patterns_are_refused(spark, monkeypatch):
    monkeypatch.setattr(filters, "MOST_PATTERNS", 1)
    q = spark.createDataFrame([(1, "by joe")], "question_id long, question string")
    aliases = spark.createDataFrame([("author", i, None, "J", "jo+e") for i in range(2)], ALIASES)
    with pytest.raises(ValueError, match="author patterns"):
        filters.author_alias(filters.start(q), aliases)


def test_capped_terms_scan_all_unless_told(spark, points):
    assert store.capped(points).count() == 160 and store.capped(points, 7).agg(F.max("point_id")).first()[0] == 6


def valued_rows(n=200, seed=6):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice([None, "", " ", *xs])
    return [(i, "text", f"s{i % 5}", pick("Rice Mill", " Rice Mill ", "Fish, Pond"), pick("John Doe, Ann Lee", "Ann Lee", "wlan system"), pick("Dr. Kim", "dr. kim"), pick("iot, rice", "rice,,iot ", "bio"), "2014") for i in range(n)]


VALUED = "point_id long, content string, source string, project_title string, author string, advisor string, keywords string, year string"


def test_dictionaries_follow_from_counts_without_their_points(spark):
    rows = valued_rows()
    table = lambda some: spark.createDataFrame(some, VALUED)
    aliases = spark.createDataFrame([("staff", 1, "pat", "Dr. Pat", None)], ALIASES)
    as_set = lambda df: {tuple(map(str, r)) for r in df.collect()}
    counts = dictionaries.value_counts(table(rows[:50]))
    for low, high in ((50, 120), (120, 200)):
        counts = dictionaries.changed(counts, table(rows[low:high]))
    for gone in ([], rows[:150], rows):
        left = dictionaries.valued(dictionaries.changed(counts, gone=table(gone)) if gone else counts)
        kept = table(rows[len(gone) :])
        assert as_set(dictionaries.dictionary(left)) == as_set(dictionaries.dictionary(kept))
        assert as_set(dictionaries.protected(left, aliases)) == as_set(dictionaries.protected(kept, aliases))


def test_a_corpus_grows_by_what_is_new(spark, tmp_path):
    first, more = (encoders.embed_documents(spark.createDataFrame(rows, VALUED)) for rows in (valued_rows()[:150], valued_rows()[150:] + [(900, "new fish", "z", "A New Title", "Joe Moe", None, None, "2001")]))
    aliases = spark.createDataFrame([], ALIASES)
    path = str(tmp_path / "points")
    first.write.parquet(path)
    grown = retrieval.Corpus.prepared(spark.read.parquet(path), aliases).extended(more)
    whole = retrieval.Corpus.prepared(first.unionByName(more), aliases)
    for field in ("dictionary", "protected", "counts"):
        assert {tuple(map(str, r)) for r in getattr(grown, field).collect()} == {tuple(map(str, r)) for r in getattr(whole, field).collect()}
        assert not any(path in f for f in getattr(grown, field).inputFiles())
    q = spark.createDataFrame([(1, "joe moe fish"), (2, "rice mill")], "question_id long, question string")
    hits = [{(r["question_id"], r["point_id"]) for r in c.searched(q)[1].collect()} for c in (grown, whole)]
    assert hits[0] == hits[1] and (1, 900) in hits[0]


def test_tasks_keep_the_best_alone_and_score_a_bounded_number_of_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.integers(0, 3, (400, 4)).astype(float)  # many equal scores
    units = search._units(vectors)
    ids, matrix = np.arange(60) * 10, search._units(rng.integers(0, 3, (60, 4)).astype(float))
    monkeypatch.setattr(search, "PAIRS_AT_ONCE", 500)
    for names in (np.arange(400), np.array([f"p{i:03}" for i in range(400)], object)):
        best = search._Best(ids, matrix, 7)
        for i in range(0, 400, 90):
            best.meet(0, 40, names[i : i + 90], units[i : i + 90])
            best.meet(40, 20, names[i : i + 90], units[i : i + 90])
            assert sum(len(q) for q, _, _ in best.held) <= 60 * 7 + 2 * 500
        (got,) = best.frames()
        scores = np.round(matrix @ units.T, search.DIGITS)
        want = [(int(ids[q]), names[p], scores[q, p]) for q in range(60) for p in sorted(range(400), key=lambda p: (-scores[q, p], names[p]))[:7]]
        assert list(got.itertuples(index=False, name=None)) == want


def test_pages_of_parts_are_made_by_as_many_tasks_as_a_shuffle_has_parts(spark, small):
    from lodestone.sources.fixtures import view

    front = view(spark, small, "front_v")
    assert "REPARTITION_BY_NUM" in front._jdf.queryExecution().executedPlan().toString()
    assert front.count() == 6 * view(spark, small, "part").count()


def test_phrases_of_the_same_words_are_not_all_candidates(spark, monkeypatch):
    """Titles made of few words share all trigrams; a text meets those that it may contain, whether their grams travel to it or not."""
    words = [a + b for a in ("al", "be", "co", "du") for b in ("mond", "rick", "ver")]
    titles = sorted({f"project {a} {b} {c}" for a in words for b in words for c in words if a < b < c})
    texts = spark.createDataFrame([(i, f"of {t} and more") for i, t in enumerate(titles)], "i long, t string")
    phrases = spark.createDataFrame([(t,) for t in [*titles, "more", "du", "absent"]], "p string")
    want = sorted([*enumerate(titles), *[(i, "more") for i in range(len(titles))]])
    made = []
    monkeypatch.setattr(normalize, "cut", lambda df, name="step": made.append((name, cut(df, name))) or made[-1][1])
    for most in (normalize.BROADCAST_GRAMS, 0):
        monkeypatch.setattr(normalize, "BROADCAST_GRAMS", most)
        got = normalize.containing(texts, "t", phrases, "p")
        assert sorted((r["i"], r["p"]) for r in got.collect()) == want
        keys = dict(made)["keys"]
        assert keys.groupBy("_gram").count().agg(F.max("count")).first()[0] < 30  # 220 titles; by trigrams alone one key is of 50 or more
        assert "BroadcastExchange" not in normalize.containing(texts, "t", phrases, "p")._jdf.queryExecution().executedPlan().toString() or most


def test_pairs_are_scored_without_texts(spark, small, monkeypatch):
    """What scoring writes and shuffles holds no text of a point; of texts only those of kept hits are written."""
    from lodestone import catalog

    made = []
    monkeypatch.setattr(catalog, "cut", lambda df, name="step": made.append((name, cut(df, name))) or made[-1][1])
    kept = catalog._kept_with_texts(spark, small)
    assert {name for name, df in made if "content" in df.columns} == {"texts"}
    assert dict(made)["texts"].count() == kept.select("point_id").distinct().count()
    assert not kept.filter("content is null or length(content) <> n_chars").count()


def test_vectors_travel_once_and_meet_only_scored_points(spark, small, monkeypatch):
    """What pair_scores writes holds no vector but those of questions; pairs are keys and scores."""
    from lodestone import catalog

    made = []
    for module in (catalog, search):
        monkeypatch.setattr(module, "cut", lambda df, name="step": made.append((name, cut(df, name))) or made[-1][1])
    hits = catalog._pairs(spark, small)[1]
    assert {name for name, df in made if {"vector", "qvec"} & set(df.columns)} == {"asked"}
    assert {c for name, df in made if name == "pairs" for c in df.columns} == {"question_id", "point_id", "score", "rank"}
    assert hits.count() == spark.read.parquet(f"{small}/documents.parquet").filter("doc_id % 50 = 0").count() * 20


def test_blocks_of_questions_read_points_found_once(spark, points, questions, monkeypatch):
    made = []
    monkeypatch.setattr(search, "cut", lambda df, name="step": made.append((name, cut(df, name))) or made[-1][1])
    monkeypatch.setattr(search, "BROADCAST_QUESTIONS", 7)
    vectors = points.select("point_id", "vector").union(points.filter("point_id < 9").select(F.col("point_id") + 1000, "vector"))
    hits = search.semantic_topk(questions, points.drop("vector"), 6, vectors=vectors)
    assert found(hits) == brute(question_rows(), point_rows(), 6)
    (written,) = [df for name, df in made if name == "found"]
    assert len([1 for name, _ in made if name == "hits"]) > 2
    assert written.count() == written.select("point_id").distinct().count()  # once, however many filters find a point


def test_postings_of_the_fields_that_filters_name(spark, points, questions, monkeypatch):
    from lodestone.operators import pointindex

    made = []
    monkeypatch.setattr(pointindex, "cut", lambda df, name="step": made.append((name, cut(df, name))) or made[-1][1])
    years = questions.filter("filters['year'] is not null and size(filters) = 1")
    want = brute([r for r in question_rows() if r[2] == {"year": ["2011"]}], point_rows(), 4)
    assert found(search.semantic_topk(years, points, 4)) == want
    assert {r["field"] for r in dict(made)["postings"].select("field").distinct().collect()} == {"year"}


def test_metadata_answers_read_no_documents_for_their_questions(spark, small):
    """Ids of questions come from the vectors' table, hits from what is written."""
    from lodestone import catalog

    read = catalog.QUERIES["metadata_answer"](spark, small)
    assert not [f for f in read.inputFiles() if "documents.parquet" in f or "part.parquet" in f]
    assert read.count() == spark.read.parquet(f"{small}/documents.parquet").filter("doc_id % 50 = 0").count()
