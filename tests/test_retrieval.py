"""Hand-computed cases for the retrieval operators."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.functions import chunking, encoders
from lodestone.operators import answers, filters, frontmatter, latency, normalize, pages, search, store, wordindex
from lodestone.plans import retrieval
from lodestone.sources import tables
from lodestone.sources.fixtures import view
from lodestone.streaming import jobs

PAGES = "source string, page_number int, content string"


def fields(spark, *pages):
    df = spark.createDataFrame([("d.pdf", i + 1, p) for i, p in enumerate(pages)], PAGES)
    return [tuple(r[f] for f in frontmatter.FIELDS) for r in frontmatter.with_fields(df).orderBy("page_number").collect()]


def test_front_matter(spark):
    got = fields(spark, "A WRAPPED SYSTEM\nfor growing rice\nANNA WONG\nBEN LEE\nBachelor of Engineering", "Mr. Joe Doe\nx", "", "Supervisory Committee\nDr. Kim\nAdvisor", "Supervisory Committee . Advisor", "Keywords: rice, soil .\nnotes\nKeyword - water\n(2009) 2015 2016")
    assert got[0] == ("A WRAPPED SYSTEM for growing rice", "ANNA WONG, BEN LEE", None, None, None)
    assert got[2] == (None,) * 5
    assert got[3][2] == "Dr. Kim"
    assert got[4][2] == ""  # found, but nothing is left of it
    assert got[5][3:] == ("rice, soil . water", "2015")


def test_carry_forward_keeps_empty_and_stops_after_five(spark):
    rows = [("d", i, "t", None, None, v, None, None) for i, v in enumerate([None, "", "x", None, None, "late"], 1)]
    df = spark.createDataFrame(rows, PAGES + ", project_title string, author string, advisor string, keywords string, year string")
    got = [r["advisor"] for r in frontmatter.carried(df).orderBy("page_number").collect()]
    assert got == [None, "", "", "", "", ""]


def test_chunks_cover_and_overlap():
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "longerword ", "\n", "\n\n", "x" * rng.randint(1, 30) + " "]) for _ in range(rng.randint(1, 400)))
        chunks = chunking.split_text(text, 100, 15)
        assert all(0 < len(c) <= 100 and c in text for c in chunks)
        assert "".join(text.split()) == "".join(text.split()) and set(text.split()) <= set(" ".join(chunks).split())
    assert chunking.split_text("a" * 2500)[0] == "a" * 1000


def test_normaliser_strips_edges_and_replaces_synonyms(spark):
    q = spark.createDataFrame([(1, '  The "CE" Project?  '), (2, "ce. rice")], "question_id long, question string")
    protected = spark.createDataFrame([("token", "rice"), ("phrase", "rice")], "kind string, value string")
    aliases = spark.createDataFrame([("synonym", 1, "ce", "computer engineering")], "kind string, ord int, alias string, canonical string")
    got = {r["question_id"]: r["question"] for r in normalize.apply_synonyms(normalize.basic(q), protected, aliases).collect()}
    assert got == {1: "the computer engineering project", 2: "computer engineering rice"}


def test_spelling_counts_a_swap_once(spark):
    words = spark.createDataFrame([("abdc",), ("zzzzzz",)], "token string")
    lexicon = spark.createDataFrame([("abcd", 5), ("abd", 9)], "term string, n long")
    got = [tuple(r) for r in normalize.spell_correct(words, lexicon).collect()]
    assert got == [("abdc", "abd", 1)]
    assert wordindex.edits_within(["abcd"], ["abdc"])[0] == 1 and wordindex.common_length("abcd", "acbd") == 3


def test_fuzzy_snap(spark):
    words = spark.createDataFrame([("puangkam",), ("tree",)], "token string")
    protected = spark.createDataFrame([("token", "puangkan"), ("token", "treasure")], "kind string, value string")
    got = [tuple(r) for r in normalize.fuzzy_snap(words, protected).collect()]
    assert got == [("puangkam", "puangkan", 87.5)]


def test_blocked_contains_equals_nested_loop(spark):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choice("abc ") for _ in range(20))) for i in range(50)]
    phrases = [("".join(rng.choice("abc ") for _ in range(rng.randint(3, 4))),) for _ in range(30)]
    phrases = sorted(set(phrases))
    got = normalize.containing(spark.createDataFrame(texts, "i long, t string"), "t", spark.createDataFrame(phrases, "p string"), "p")
    assert sorted((r["i"], r["p"]) for r in got.collect()) == sorted((i, p) for i, t in texts for (p,) in phrases if p in t)


def test_phrases_meet_texts_at_their_rarest_trigram(spark):
    """What all phrases begin with is no key: no text meets a phrase by it."""
    texts = spark.createDataFrame([(i, f"project {i:04d} here") for i in range(40)], "i long, t string")
    phrases = spark.createDataFrame([(f"project {i:04d}",) for i in range(0, 400, 10)], "p string")
    got = normalize.containing(texts, "t", phrases, "p")
    assert sorted((r["i"], r["p"]) for r in got.collect()) == [(i, f"project {i:04d}") for i in range(0, 40, 10)]


def test_fuzzy_ties_go_to_the_first_term(spark):
    words = spark.createDataFrame([("abcdefghij",)], "token string")
    protected = spark.createDataFrame([("token", "abcdefghiz"), ("token", "abcdefghia"), ("token", "abcdefghim")], "kind string, value string")
    assert [tuple(r) for r in normalize.fuzzy_snap(words, protected).collect()] == [("abcdefghij", "abcdefghia", 90.0)]


def test_normaliser_without_lexicon_still_snaps(spark):
    q = spark.createDataFrame([(1, "Papers of Puangkam"), (2, None)], "question_id long, question string")
    protected = spark.createDataFrame([("token", "puangkan")], "kind string, value string")
    aliases = spark.createDataFrame([], "kind string, ord int, alias string, canonical string")
    got = {r["question_id"]: r["question"] for r in normalize.normalize(q, protected, aliases).collect()}
    assert got == {1: "papers of puangkan", 2: ""}


ALIASES = "kind string, ord int, alias string, canonical string, pattern string"


def test_author_patterns_come_after_aliases(spark):
    q = spark.createDataFrame([(1, "by joe and teeraat"), (2, "by Teerapaatt, not teeraat"), (3, "by xteeraat"), (4, "author=x teeraat")], "question_id long, question string")
    aliases = spark.createDataFrame([("author", 1, "joe", "JOE A", None), ("author", 2, None, "TEE B", "teer(?:ap)?aat+"), ("author", 3, None, "OTHER", "teer.*")], ALIASES)
    got = {r["question_id"]: (r["filters"].get("author"), r["rest"]) for r in filters.author_alias(filters.named_values(filters.start(q)), aliases).collect()}
    assert got == {1: (["JOE A"], "by  and teeraat"), 2: (["TEE B"], "by , not teeraat"), 3: (None, "by xteeraat"), 4: (["x"], " teeraat")}


def test_questions_are_parsed_step_by_step(spark):
    dictionary = spark.createDataFrame([("project_title", "Rice Mill", ["Rice Mill"]), ("project_title", "Rice", ["Rice"]), ("author", "ANN LEE", ["ANN LEE", "ANN LEE, BO WU"]), ("advisor", "Dr. Kim", ["Dr. Kim"]), ("keywords", "iot", ["iot", "iot, water"])], "field string, term string, full_values array<string>")
    aliases = spark.createDataFrame([("advisor", 1, "kim", "Dr. Kim", None), ("staff", 1, "pat", "Dr. Pat", None)], ALIASES)
    asked = {
        1: ("what did ann lee write on iot in the rice mill of 2014 and 2015?", {"project_title": ["Rice Mill"], "author": ["ANN LEE", "ANN LEE, BO WU"], "keywords": ["iot", "iot, water"], "year": ["2014"]}, "what did write on in the of and ?"),
        2: ("advisor=prof.kim water", {"advisor": ["Dr. Kim"]}, "advisor=prof.kim water"),
        3: ("pat and patrick", {"advisor": ["Dr. Pat"]}, "pat and patrick"),
        4: ("title=rice nothing", {"project_title": ["Rice"]}, "title= nothing"),
        5: ("plain words", {}, "plain words"),
    }
    q = spark.createDataFrame([(i, t) for i, (t, _, _) in asked.items()], "question_id long, question string")
    got = {r["question_id"]: (r["filters"], r["residual"]) for r in filters.parse(q, dictionary, aliases).collect()}
    assert got == {i: (f, r) for i, (_, f, r) in asked.items()}


def test_residual_keeps_years_that_are_no_filter(spark):
    r = lambda *f: filters.residual(F.lit("Rice of 2011 and 2012"), F.create_map(*f).cast(filters.FILTER))
    got = spark.range(1).select(r(F.lit("k"), F.array(F.lit("rice"))), r(F.lit("year"), F.array(F.lit("2012")))).first()
    assert tuple(got) == ("of 2011 and 2012", "rice of and")


def test_questions_to_answers(spark):
    said = "content string, source string, project_title string, author string, advisor string, keywords string, year string"
    points = spark.createDataFrame([("rice grows in water", "a.pdf", "Rice Mill", "ANN LEE", "Dr. Kim", "iot", "2014"), ("fish swim", "b.pdf", "Fish Pond", "BO WU", None, "bio", "2015")], said)
    points = encoders.embed_documents(points.withColumn("point_id", F.when(F.col("source") == "a.pdf", 1).otherwise(2)))
    aliases = spark.createDataFrame([("staff", 1, "pat", "Dr. Pat", None)], ALIASES)
    q = spark.createDataFrame([(1, "Who is the advisor of Rice Mill?"), (2, "how do fish swim in the fish pond"), (3, "anything of 1999")], "question_id long, question string")
    raw = spark.createDataFrame([(2, "Answer: they swim"), (3, "x")], "question_id long, raw_answer string")
    got = {r["question_id"]: (r["answer"], r["route"], r["sources"]) for r in retrieval.answers_to_questions(q, points, aliases, raw).collect()}
    assert got == {1: ("Dr. Kim is associated with this project: Rice Mill.", "metadata", ["a.pdf"]), 2: ("they swim", "model", ["b.pdf"]), 3: (answers.NO_ANSWER, "no_context", [])}


@pytest.mark.parametrize("search_by", [search.semantic_topk, search.semantic_topk_blocks])
def test_many_questions_are_searched_in_blocks(spark, monkeypatch, search_by):
    rng = random.Random(2)
    vector = lambda: [rng.gauss(0, 1) for _ in range(8)]
    fields_ = {c: None for c in store.FILTERABLE}
    points = spark.createDataFrame([{"point_id": i, "vector": vector(), **fields_} for i in range(90)], "point_id long, vector array<double>, " + ", ".join(f"{c} string" for c in fields_))
    q = spark.createDataFrame([(i, vector()) for i in range(50)], "question_id long, qvec array<double>")
    want = sorted(tuple(r) for r in search_by(q, points, 3).select("question_id", "point_id", "rank").collect())
    monkeypatch.setattr(search, "BROADCAST_QUESTIONS", 12)
    blocks = search.blocks_of(q)
    assert len(blocks) == 6 and sum(b.count() for b in blocks) == 50
    assert sorted(tuple(r) for r in search_by(q, points, 3).select("question_id", "point_id", "rank").collect()) == want and len(want) == 150


def test_numbers_in_ranges_are_those_of_a_sort(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.random()) for _ in range(300)] + [("c", 0.5)]
    got = sorted(((r["k"] or "", r["v"], r["nth"], r["n_all"]) for r in tables.numbered(spark.createDataFrame(rows, "k string, v double").repartition(5), "k", [F.col("v")]).collect()))
    want = []
    for k in ("a", "b", "c", None):
        mine = sorted(v for x, v in rows if x == k)
        want += [(k or "", v, i, len(mine)) for i, v in enumerate(mine)]
    assert got == sorted(want)


def test_pages_are_numbered_by_ids_alone(spark):
    rows = [("a", 3, "z"), ("a", 1, " "), ("a", 2, "x"), ("a", 2, "x"), ("a", 2, None), (None, 5, "n"), ("b", None, "u"), ("c", 1, "")]
    df = spark.createDataFrame(rows, "source string, doc_id long, text string").repartition(3)
    got = sorted(((r["source"] or "", r["page_number"], r["total_pages"], r["content"]) for r in pages.page_table(df).collect()))
    assert got == [("", 1, 1, "n"), ("a", 2, 5, "x"), ("a", 3, 5, "x"), ("a", 5, 5, "z"), ("b", 1, 1, "u")]


def test_a_bad_page_does_not_stop_the_others_and_bad_storage_stops_the_batch(spark, tmp_path):
    rows = spark.createDataFrame([("good", 1, "x"), ("bad", 1, "y"), ("bad", 2, "z"), ("fine", 1, "z")], "source string, page_number int, content string")
    rows.write.parquet(str(tmp_path / "in"))

    def split(text):
        if text == "y":
            raise ValueError("broken")
        return [text]

    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    jobs.ingest_stream(stream(), lambda df: chunking.chunked_or_failed(df, split), str(tmp_path / "points"), str(tmp_path / "state"), str(tmp_path / "errors")).awaitTermination()
    points, errors = spark.read.parquet(str(tmp_path / "points")), spark.read.parquet(str(tmp_path / "errors"))
    assert [(r["source"], r["error"]) for r in errors.collect()] == [("bad", "ValueError: broken")] and points.count() == 3
    report = {r["source"]: r["outcome"] for r in pages.ingest_report(rows.select("source").distinct(), rows, points, points, errors).collect()}
    assert report == {"good": "written", "bad": "error", "fine": "written"}
    (tmp_path / "blocked").write_text("a file where the table should be")
    with pytest.raises(Exception, match="(?i)blocked|not a directory|parquet"):
        jobs.ingest_stream(stream(), lambda df: chunking.chunked_or_failed(df, split), str(tmp_path / "blocked"), str(tmp_path / "state2"), str(tmp_path / "errors2")).awaitTermination()
    assert not list((tmp_path / "state2" / "commits").glob("[0-9]*"))


@pytest.mark.parametrize("order", [(1, 2, 0), (0, 1, 2), (2, 0, 1)])
def test_pages_in_three_batches_carry_what_one_batch_carries(spark, small, tmp_path, order):
    front = view(spark, small, "front_v").filter(F.col("source").isin([f"doc{k}.pdf" for k in range(1, 30)]))
    for k in order:
        front.filter(F.col("page_number") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(front.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    job = jobs.carried_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    job.awaitTermination()
    assert len(job.recentProgress) >= 3
    got = sorted(map(repr, map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*front.columns, *frontmatter.FIELDS).collect())))
    want = frontmatter.carried(frontmatter.with_fields(front)).select(*front.columns, *frontmatter.FIELDS)
    assert got == sorted(map(repr, map(tuple, want.collect())))


def test_previews_and_chunk_counts(spark):
    pages_ = spark.createDataFrame([("b", 1, "w" * 30), ("a", 2, "x" * 2500), ("a", 1, "short page")], PAGES)
    chunks = chunking.chunked(pages_)
    assert [(r["source"], r["page_number"], r["chunk_index"], r["head"]) for r in pages.preview(chunks, 2, 5).collect()] == [("a", 1, 0, "short"), ("a", 2, 0, "xxxxx")]
    sizes = {(r["source"], r["page_number"], r["chunk_index"]): len(r["content"]) for r in chunks.collect()}
    assert sizes[("a", 1, 0)] == 10 and sizes[("b", 1, 0)] == 30 and [n for k, n in sorted(sizes.items()) if k[:2] == ("a", 2)] == [1000, 1000, 800]


def test_filters(spark):
    q = spark.createDataFrame([(1, 'author:"john doe" title=x author=jane 1999 rest 2005')], "question_id long, question string")
    got = filters.year(filters.named_values(filters.start(q))).first()
    assert got["filters"] == {"author": ["jane"], "project_title": ["x"], "year": ["1999"]}
    assert got["rest"].split() == ["rest"]
    f = F.create_map(F.lit("a"), F.array(F.lit(" x "), F.lit(" ")), F.lit("b"), F.array(F.lit("")))
    assert spark.range(1).select(filters.validated(f).alias("f")).first()["f"] == {"a": ["x"]}
    text = filters.residual(F.lit("Find Rice rice of 2011"), F.create_map(F.lit("k"), F.array(F.lit("RICE"))))
    assert spark.range(1).select(text.alias("t")).first()["t"] == "find rice of 2011"  # years go only where a year is a filter


def test_filter_predicate_needs_every_field(spark):
    p = F.create_map(F.lit("year"), F.lit("2011"), F.lit("advisor"), F.lit(None).cast("string"))
    ask = lambda **f: F.create_map(*[x for k, v in f.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    got = spark.range(1).select(filters.matches(ask(year=["2010", "2011"]), p), filters.matches(ask(advisor=["x"]), p), filters.matches(ask(other=["x"]), p)).first()
    assert tuple(got) == (True, False, False)


@pytest.mark.parametrize("name", ["semantic_topk", "semantic_topk_filtered"])
def test_topk_limits_before_the_shuffle(spark, small, name):
    plan = catalog.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_block_search_equals_rowwise(spark, small):
    a = catalog.QUERIES["semantic_topk"](spark, small).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, catalog.QUERIES["semantic_topk_blocks"](spark, small).collect()))


def test_minmax_and_ties(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (2, 1, 1.0), (2, 2, 3.0), (2, 3, 2.0)], "question_id long, rank int, pair_score double")
    got = {(r["question_id"], r["rank"]): (r["position"], r["norm_score"]) for r in search.minmax(search.rerank(df)).collect()}
    assert got == {(1, 1): (1, 1.0), (1, 2): (2, 1.0), (2, 2): (1, 1.0), (2, 3): (2, 0.5), (2, 1): (3, 0.0)}


def test_answers(spark):
    hits = spark.createDataFrame([(1, 1, "a\nb", "s1", "T", "Dr. A"), (1, 2, "c", "s2", " t", None), (1, 3, "d", "s3", "U", "Dr. B"), (2, 1, "e", "s4", None, None)], "question_id long, position int, content string, source string, project_title string, advisor string")
    q = spark.createDataFrame([(1, "who supervised it?"), (2, "what?"), (3, "nothing"), (4, "failed")], "question_id long, question string")
    raw = spark.createDataFrame([(2, "Answer:  Not   found!"), (3, "x")], "question_id long, raw_answer string")
    errors = spark.createDataFrame([(4, "boom")], "question_id long, error string")
    got = {r["question_id"]: (r["answer"], r["route"], r["sources"]) for r in answers.answer_questions(q, hits, raw, errors).collect()}
    assert got[1] == ("Dr. A is associated with these projects: T, U.", "metadata", ["s1", "s2", "s3"])
    assert got[2] == (answers.NO_ANSWER, "model", ["s4"])
    assert got[3] == (answers.NO_ANSWER, "no_context", [])
    assert got[4] == (answers.RETRIEVAL_FAILED, "failed", [])
    assert [r["context"] for r in answers.contexts(hits).orderBy("question_id", "position").collect()][0] == "Project title: T | Advisor: Dr. A | Source: s1\na b"


def test_latency_of_one_and_none(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("b", 3.0), ("c", None)], "k string, v double")
    got = {r["k"]: r for r in latency.summary(df, "k", "v").collect()}
    assert got["a"]["stddev_s"] is None and got["a"]["qps"] == 0.5 and got["b"]["p90_s"] == pytest.approx(2.8)
    assert got["c"]["n"] == 0 and got["c"]["median_s"] == 0.0 and got["c"]["qps"] is None


def test_percentiles_of_hot_groups_and_values_are_exact(spark):
    rng = random.Random(9)
    rows = [("hot", float(rng.choice([1, 1, 1, 2, 5, 9]))) for _ in range(4000)] + [("hot", rng.random()) for _ in range(3000)] + [("same", 4.0)] * 900 + [(None, 1.0), (None, 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r["k"]: tuple(r)[1:] for r in latency.percentiles(df, "k", "v", (0, 12.5, 50, 90, 99.9, 100)).collect()}
    for k in {r[0] for r in rows}:
        values = sorted(v for g, v in rows if g == k and v is not None)
        def want(p):
            spot = (len(values) - 1) * p / 100
            low = int(spot)
            return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (spot - low) if values else 0.0
        assert got[k] == pytest.approx([want(p) for p in (0, 12.5, 50, 90, 99.9, 100)])
    ranks = latency.weighted_ranks(df, "k", "v").filter("k = 'hot'")
    assert ranks.select(F.spark_partition_id()).distinct().count() > 1 and ranks.agg(F.max("last")).first()[0] == 6999


def test_streamed_windows_equal_batch_within_the_sketch(spark, small):
    got = {(r["event_type"], r["window_start"]): r for r in catalog.QUERIES["stream_latency"](spark, small).collect()}
    events = view(spark, small, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    whole = {(r["event_type"], r["w"]["start"]): r for r in events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("value").alias("n"), F.min("value").alias("min_s"), F.avg("value").alias("mean_s"), F.sort_array(F.collect_list("value")).alias("all")).collect()}
    assert set(got) <= set(whole) and len(got) > 100
    for k, r in got.items():
        w = whole[k]
        assert (r["n"], r["min_s"]) == (w["n"], w["min_s"]) and r["mean_s"] == pytest.approx(w["mean_s"])
        assert r["median_s"] in w["all"][(w["n"] - 1) // 2 : w["n"] // 2 + 1]


def test_appending_twice_adds_nothing(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 1, 0, "x"), ("a", 1, 1, "y")], "source string, page_number int, chunk_index int, content string")
    for _ in range(2):
        store.append_points(chunks, str(tmp_path / "points"))
    assert spark.read.parquet(str(tmp_path / "points")).count() == 2


def test_encoder_has_unit_norm_or_is_zero(spark):
    df = encoders.embed_documents(spark.createDataFrame([("a b a",), ("...",)], "content string"))
    norms = [round(sum(x * x for x in r["vector"]), 4) for r in df.collect()]
    assert norms == [1.0, 0.0] and len(df.first()["vector"]) == 64


def test_streams_equal_batch(spark, small):
    points = catalog.QUERIES["stream_ingest"](spark, small)
    chunks = catalog.QUERIES["chunk_stats"](spark, small)
    assert {r["source"]: r["n_points"] for r in points.collect()} == {r["source"]: r["n_chunks"] for r in chunks.collect()}
    assert catalog.QUERIES["stream_latency"](spark, small).count() == 145


def test_streams_read_tables_that_are_folders(spark, small, tmp_path):
    for name in ("documents", "conversations"):
        spark.read.parquet(f"{small}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("embeddings", "part", "nation"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    for query in ("stream_ingest", "stream_answers"):
        got, whole = (catalog.QUERIES[query](spark, str(d)).collect() for d in (tmp_path, small))
        assert got and sorted(got) == sorted(whole)


def test_filters_on_fields_do_not_repeat_the_steps_before(spark, small):
    plan = catalog.QUERIES["authors"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("^(Mr") == 1  # each line is tested for a name once
