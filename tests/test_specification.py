"""Small hand-written cases with results worked out by hand."""

import datetime as dt
import json

import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from fitrank.config import FilterRules, Lookback, ScoreStep, Search
from fitrank.functions import fixed_values, labels
from fitrank.functions import text as TX
from fitrank.operators import (
    filters,
    joins,
    plugins,
    ranking,
    report,
    rules,
    scoring,
    shaping,
    tfidf,
)
from fitrank.plans import ingest
from fitrank.plans.scoring import STEPS, apply_steps, register_step, score_postings
from fitrank.sources import blocklists, evaluations, postings, seen

DAY = dt.datetime(2024, 1, 31, 12)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def posting(spark, *items, schema="id string, title string, company string, description string"):
    return spark.createDataFrame(list(items), schema)


def profile(spark, text):
    return spark.createDataFrame([(text,)], "text string")


def test_stop_words_are_those_of_spark(spark):
    listed = StopWordsRemover.loadDefaultStopWords("english")
    assert list(fixed_values.ENGLISH_STOP_WORDS) == listed
    assert len(fixed_values.TECH_TERMS) == len(set(fixed_values.TECH_TERMS)) == 62
    assert len(fixed_values.POSTING_COLUMNS) == 31
    assert not set(fixed_values.TECH_TERMS) & set(listed)


@pytest.mark.parametrize(
    ("text", "wanted", "score"),
    [
        ("python java team", "python spark", 0.35),
        ("team", "team", 0.3),
        ("Python, PYTHON!", "python", 0.7),
        ("", "python", 0.0),
        (None, "python", 0.0),
        ("the and of", "the", 0.0),
        ("python team", "", 0.0),
    ],
)
def test_keyword_match(spark, text, wanted, score):
    df = posting(spark, ("1", "t", "c", text))
    out = scoring.keyword_match(df, profile(spark, wanted))
    assert rows(out, "keyword_match_score")[0][0] == pytest.approx(score)


def test_tokens(spark):
    df = spark.createDataFrame([("Él é a b2 x_y C++ naïve—Straße 東京",)], "t string")
    assert rows(df, TX.tokenize(F.col("t")))[0][0] == ["él", "b2", "x_y", "naïve", "straße", "東京"]
    kept = TX.remove_stop_words(TX.tokenize(F.lit("the cat and the cat")))
    assert rows(df, kept)[0][0] == ["cat", "cat"]


def test_term_counts(spark):
    df = spark.createDataFrame([("bb aa bb, cc bb",), (None,), ("",)], "t string")
    found = [{t.term: t.tf for t in r[0]} for r in rows(df, TX.term_counts(F.col("t")))]
    assert {k: v for k, v in found[0].items() if k} == {"aa": 1, "bb": 3, "cc": 1}
    assert list(found[1]) == list(found[2]) == [""]


@pytest.mark.parametrize(
    ("answer", "score", "why"),
    [
        ("SCORE: 7\nREASON: good fit ", 0.7, "good fit"),
        ("score:12.5\nreason: x", 1.0, "x"),
        ("SCORE: -3\nREASON: neg", 0.3, "neg"),
        ("I give 8/10", 0.8, "I give 8/10"),
        ("no number", 0.5, "no number"),
        ("Rated 42 then 6.5", 0.65, "Rated 42 then 6.5"),
        ("SCORE:\n 9\nREASON: late", 0.9, "late"),
        ("", 0.5, ""),
        ("REASON:\nnext line 4", 0.4, "next line 4"),
        ("  " + "x" * 300, 0.5, "x" * 300),
        ("SCORE: 3 SCORE: 9", 0.3, "SCORE: 3 SCORE: 9"),
    ],
)
def test_answers(spark, answer, score, why):
    df = spark.createDataFrame([("1", answer)], "id string, answer string")
    got = rows(joins.parse_responses(df), "llm_fit_score", "llm_fit_rationale")[0]
    assert got == (pytest.approx(score), why)


def test_answers_without_text_or_with_error(spark):
    df = posting(spark, ("1", "t", "c", None), ("2", "t", "c", ""), ("3", "t", "c", "x"), ("4", "t", "c", "x"))
    answers = spark.createDataFrame(
        [("1", "SCORE: 9", None), ("2", "SCORE: 9", None), ("3", None, "timed out")],
        "id string, answer string, error string",
    )
    got = rows(joins.join_responses(df, answers).orderBy("id"), "llm_fit_score", "llm_fit_rationale")
    assert got == [(0.0, ""), (0.0, ""), (0.0, "error: timed out"), (0.0, "")]


def test_prompt(spark):
    df = posting(spark, ("1", "t", "c", "j" * 2000), ("2", "t", "c", None))
    got = rows(joins.build_prompts(df, profile(spark, "r" * 1900)), "id", "prompt")
    assert len(got) == 1
    assert got[0][1].endswith("JOB DESCRIPTION:\n" + "j" * 2000 + "\n\nCANDIDATE RESUME:\n" + "r" * 1900)
    short = rows(joins.build_prompts(df, profile(spark, "r" * 1900), max_chars=1800), "prompt")[0][0]
    assert short.endswith("j" * 1800 + "\n\nCANDIDATE RESUME:\n" + "r" * 1800)


def test_composite(spark):
    df = spark.createDataFrame([(0.5, 1.0, None)], "a_score double, b_score double, c double")
    steps = [ScoreStep("a", "a_score", 1), ScoreStep("b", "b_score", 3), ScoreStep("x", "missing", 9)]
    assert rows(scoring.composite_score(df, steps), "final_score") == [(0.875,)]
    assert rows(scoring.composite_score(df, [*steps, ScoreStep("c", "c")]), "final_score") == [(None,)]
    off = [ScoreStep("a", "a_score", 1), ScoreStep("b", "b_score", 3, enabled=False)]
    assert rows(scoring.composite_score(df, off), "final_score") == [(0.5,)]
    assert rows(scoring.composite_score(df, [ScoreStep("a", "a_score", 0)]), "final_score") == [(None,)]
    assert "final_score" not in scoring.composite_score(df, [ScoreStep("x", "missing")]).columns
    own_name = [ScoreStep("a", "a_score", 1), ScoreStep("b_score", "b_score", 3)]
    assert rows(scoring.composite_score_by_name(df, own_name), "final_score") == [(0.5,)]


def test_filters(spark):
    df = spark.createDataFrame(
        [
            ("1", "VP of Sales", " DICE ", None, " Windsor, ON", "needs TS/SCI"),
            ("2", "VP office", "dice inc", True, "Detroit", None),
            (None, None, None, False, None, "Python"),
        ],
        "id string, title string, company string, is_remote boolean, location string, description string",
    )

    def ids(out):
        return [r.id for r in out.collect()]

    assert ids(filters.filter_title_blocklist(df, ["VP of "])) == ["2", None]
    assert ids(filters.filter_title_allowlist(df, ["vp OF ", "none"])) == ["1"]
    assert ids(filters.filter_company_blocklist(df, ["Dice"])) == ["2", None]
    assert ids(filters.filter_remote(df, True)) == ["1", "2"]
    assert ids(filters.filter_location_required(df, [" detroit "])) == ["2"]
    assert ids(filters.filter_location_excluded(df, ["WINDSOR"])) == ["2", None]
    assert ids(filters.filter_description_blocklist(df, ["ts/sci"])) == ["2", None]
    assert ids(filters.filter_description_allowlist(df, ["python"])) == [None]
    known = spark.createDataFrame([("2",)], "id string")
    assert ids(filters.filter_seen(df, known)) == ["1", None]
    assert ids(filters.filter_title_blocklist(df, [])) == ids(df)
    with pytest.raises(ValueError, match="empty"):
        filters.filter_title_blocklist(df, [""])
    with pytest.raises(ValueError, match="unknown filter"):
        FilterRules(disabled=frozenset({"no_such"}))


def test_dedup_keeps_first(spark):
    df = spark.createDataFrame(
        [("3", "dev", "acme", "c"), ("2", "Dev ", "ACME", "b"), ("1", None, None, "a"), ("4", None, None, "d")],
        "id string, title string, company string, description string",
    )
    out = ranking.dedup_reposts(df, ("id",))
    assert sorted(rows(out, "id", "description")) == [("1", "a"), ("2", "b")]


def test_lookback_goes_to_the_limit(spark):
    data = [(str(h), f"t{h}", "c", DAY - dt.timedelta(hours=h)) for h in (1, 30, 100, 167, 168, 169, 500)]
    df = spark.createDataFrame(data, "id string, title string, company string, date_posted timestamp")
    from fitrank.operators.lookback import adaptive_lookback

    def run(minimum, **more):
        out = adaptive_lookback(df, F.lit(DAY), Lookback(minimum=minimum, **more)).collect()
        return sorted(int(r.id) for r in out), {r.hours_old for r in out}

    assert run(0) == ([1], {24})
    assert run(1) == ([1], {24})
    assert run(2) == ([1, 30], {48})
    assert run(3) == ([1, 30, 100], {120})
    assert run(99) == ([1, 30, 100, 167, 168], {168})
    assert run(99, start=200) == ([1, 30, 100, 167, 168, 169], {200})
    with pytest.raises(ValueError, match="positive"):
        Lookback(step=0)


def test_hard_rules(spark):
    df = spark.createDataFrame(
        [
            ("1", "Dev", "x", "2 years, then 10 + years", "here"),
            ("2", "AI Trainer", " Mercor", "", "here"),
            ("3", "Lead AI Training", "x", None, "here"),
            ("4", "Dev", "x", "Polygraph needed, on-site", "Austin"),
            ("5", "Dev", "x", "Hybrid", "Austin"),
            ("6", "Dev", "x", "hybrid, 5 yrs", "Detroit, Michigan"),
        ],
        "id string, title string, company string, description string, location string",
    )
    got = rows(rules.hard_rules(df).orderBy("id"), "rule_no", "overall_score")
    assert got == [(1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (None, None)]


def test_report(spark, tmp_path):
    path = tmp_path / "e.json"
    full = {
        "job_id": "1", "company": "émile", "job_link": "[Dev](http://x)", "overall_score": 62,
        "dimensions": {"technical_skills": {"score": 9, "evidence": ["a", "b"]}},
        "must_haves": {"met": ["m"]}, "strengths": ["Kafka"], "gaps": [], "recommendation": "Apply",
    }
    nulls = {"job_id": "2", "company": "zed", "overall_score": 63, "dimensions": None, "must_haves": None,
             "recommendation": None, "summary": "rule"}
    path.write_text(json.dumps([full, nulls, {"job_id": "3", "company": "Ab"}]))
    flat = report.flatten_evaluations(evaluations.read_evaluations(spark, str(path)))
    assert len(flat.columns) == 17
    by_id = {r.job_id: r for r in flat.collect()}
    assert by_id["1"].technical == 9 and by_id["1"].tech_evidence == ["a", "b"]
    assert (by_id["2"].technical, by_id["2"].gaps, by_id["2"].recommendation) == (0, [], "")
    assert [r.job_id for r in report.sort_report(flat, "company").collect()] == ["3", "1", "2"]
    assert [r.job_id for r in report.sort_report(flat, "overall_score").collect()] == ["2", "1", "3"]
    assert [r.job_id for r in report.sort_report(flat, "overall_score", 2).collect()] == ["3", "1", "2"]
    assert [r.job_id for r in report.search(flat, "KAFKA").collect()] == ["1"]
    assert report.filter_recommendation(flat, "apply").count() == 0
    assert rows(report.kpi_counts(flat), "*") == [(3, 1, 0, 0)]
    pair = flat.where(F.col("job_id") != "3")
    assert rows(report.kpi_avg_score(pair), "avg_score") == [(62,)]
    assert rows(report.kpi_avg_score(flat.limit(0)), "avg_score") == [(0,)]
    items = report.explode_evidence(flat.where("job_id = '1'"))
    assert ("tech_evidence", 1, "b") in rows(items, "kind", "pos", "item")
    one = tmp_path / "one.json"
    one.write_text(json.dumps(full, indent=2))
    assert evaluations.read_evaluations(spark, str(one)).count() == 1


def test_bands(spark):
    df = spark.createDataFrame([(79.5,), (80.0,), (39.0,), (100.5,)], "overall_score double")
    badges = rows(report.score_bands(df), "badge")
    assert [b[0] for b in badges] == ["badge-amber", "badge-green", "badge-red", "badge-green"]
    assert sum(report.filter_score_band(df, c).count() for c in ("80", "60", "40", "0")) == 2


def test_links(spark):
    df = spark.createDataFrame(
        [("a b", "http://u(1)"), ("", "http://u"), (None, "http://u")], "title string, job_url string"
    )
    made = shaping.make_job_link(df, keep_parts=False)
    assert made.columns == ["job_link"]
    assert [r.job_link for r in made.collect()] == ["[a b](http://u(1))", None, None]
    parts = made.where("job_link IS NOT NULL").select(
        labels.link_text(F.col("job_link")), labels.link_url(F.col("job_link"))
    )
    assert rows(parts, "*") == [("a b", "http://u(1)")]


def test_clean_numbers(spark):
    df = spark.createDataFrame([(1e15, float("nan")), (2.5, float("-inf")), (1e300, None)], "a double, b double")
    want = [("1000000000000000", None), ("2.5", None), ("1.0E300", None)]
    assert rows(shaping.clean_records(df), "*") == want


def test_markup(spark):
    html = "<p>Hi <b>you</b><script>x<1</script> &amp;lt; <!-- no > --></p># T\n- **bold** [link](u) `c`"
    df = spark.createDataFrame([(html,)], "t string")
    assert rows(df, TX.strip_markup(F.col("t"))) == [("Hi you &lt; # T bold link c",)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        json.dumps({"generated_at": "x", "search_criteria": {}, "total_new_jobs": 1,
                    "jobs": [{"id": "1", "job_link": "[t](u)", "date_posted": "2024-01-02", "min_amount": 5}]})
    )
    (tmp_path / "b.json").write_text(
        json.dumps({"generated_at": "x", "search_criteria": [{}, {}], "total_new_jobs": 0, "jobs": []}, indent=1)
    )
    read = postings.read_postings(spark, str(tmp_path / "*.json"), "envelope")
    assert rows(read, "id", "min_amount", "salary_source") == [("1", 5.0, None)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        postings.read_postings(spark, str(tmp_path / "none.json"), "envelope")

    assert seen.read_seen(spark, str(tmp_path / "no_seen")).count() == 0
    (tmp_path / "ids").write_text('["b",\n "a", "a"]')
    assert sorted(rows(seen.import_seen(spark, str(tmp_path / "ids")), "id")) == [("a",), ("b",)]
    (tmp_path / "broken").write_text('["a", ')
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        seen.import_seen(spark, str(tmp_path / "broken")).collect()

    (tmp_path / "lists").write_text(json.dumps({"title_blocklist": ["VP of "]}))
    lists = blocklists.read_blocklists(spark, str(tmp_path / "lists"))
    assert rows(lists, "*") == [("title_blocklist", "VP of ")]


def test_runs_in_a_row(spark, tmp_path):
    """The second run finds what the first did not; all fetched ids count as seen."""
    data = [
        (str(i), title, f"firm {i}", "Somewhere", DAY - dt.timedelta(hours=i), "fulltime", True, "text")
        for i, title in enumerate(["dev", "Staff dev", "dev", "dev", "cook"])
    ]
    pool = spark.createDataFrame(
        data,
        "id string, title string, company string, location string, date_posted timestamp, job_type string, "
        "is_remote boolean, description string",
    )
    searches = [Search(0, "dev", "", True, 24, 50, "")]
    blocked = FilterRules(title_blocklist=("Staff",))
    out, state = str(tmp_path / "out"), str(tmp_path / "seen")

    def run(rows_):
        known = seen.read_seen(spark, state)
        return ingest.run_ingest(rows_, searches, blocked, known, F.lit(DAY), out, state).first()

    first = run(pool.where("id < '3'"))
    assert (first.total_new_jobs, first.search_criteria[0].hours_old) == (2, 24)
    assert sorted(rows(seen.read_seen(spark, state), "id")) == [("0",), ("1",), ("2",)]
    second = run(pool)
    assert second.total_new_jobs == 1
    got = postings.read_run(spark, out, second.run_id)
    assert rows(got, "id", "description", "search_no") == [("3", "text", 0)]
    assert run(pool).total_new_jobs == 0
    assert seen.read_seen(spark, state).count() == 4


def test_plugins(spark):
    df = posting(spark, ("1", "t", "c", "alpha beta"), ("2", "t", "c", None), ("3", "t", "c", ""))
    got = dict(rows(plugins.embed_postings(df), "id", "embedding"))
    assert got["2"] is None and got["3"] is None and len(got["1"]) == 64
    with pytest.raises(ValueError, match="unknown model"):
        plugins.embed_postings(df, model="nope")
    with pytest.raises(ValueError, match="unknown model"):
        plugins.pair_score(df, profile(spark, "x"), model="nope")

    def lengths():
        return lambda a, b: a.str.len() - b.str.len()

    scored = plugins.pair_score(df, profile(spark, "p" * 3000), factory=lengths, max_chars=10)
    assert dict(rows(scored, "id", "cross_encoder_score"))["1"] == pytest.approx(0.5)


def test_pair_scores_read_whole_texts(spark):
    late = posting(spark, ("1", "t", "c", "filler " * 500 + "python"), ("2", "t", "c", "filler " * 501))
    got = dict(rows(plugins.pair_score(late, profile(spark, "python")), "id", "cross_encoder_score"))
    assert got["1"] == pytest.approx(2 / 4) and got["2"] == pytest.approx(1 / 3)

    def holds():
        return lambda a, b: [5.0 if "python" in text else -5.0 for text in a]

    for window in (None, 100):
        scored = plugins.pair_score(late, profile(spark, "x"), factory=holds, window=window)
        best = dict(rows(scored, "id", "cross_encoder_score"))
        assert best["1"] > 0.99 and best["2"] < 0.01


def test_hashed_vectors_equal_plain_counting(spark):
    import hashlib
    import re

    texts = ["alpha beta alpha", "x", "Größe und größe 42 42 z", None]
    df = posting(spark, *[(str(i), "t", "c", t) for i, t in enumerate(texts)])
    got = dict(rows(plugins.embed_postings(df, use_prefix=False), "id", "embedding"))
    for i, text in enumerate(texts[:3]):
        want = [0.0] * 64
        for term in re.findall(r"\w\w+", text.lower()):
            digest = hashlib.md5(term.encode()).hexdigest()
            want[int(digest[:8], 16) % 64] += 1 if digest[8] < "8" else -1
        assert got[str(i)] == want


def test_repeated_answers_and_vectors_repeat_no_posting(spark):
    df = posting(spark, ("1", "t", "c", "text"), ("1", "u", "c", "text"), (None, "v", "c", "text"))
    answers = spark.createDataFrame([("1", "SCORE: 9"), ("1", "SCORE: 4")], "id string, answer string")
    assert sorted(rows(joins.join_responses(df, answers), "title", "llm_fit_score")) == [
        ("t", 0.4), ("u", 0.4), ("v", 0.0)
    ]
    vectors = spark.createDataFrame([("1", [1.0, 0.0]), ("1", [0.0, 1.0])], "id string, embedding array<double>")
    wanted = F.array(F.lit(1.0), F.lit(0.0))
    scored = scoring.embedding_cosine(df, vectors, wanted)
    assert sorted(rows(scored, "title", "semantic_score")) == [("t", 1.0), ("u", 1.0), ("v", 0.0)]
    with pytest.raises(Exception, match="different sizes"):
        scoring.embedding_cosine(df, vectors, F.array(F.lit(1.0))).collect()


def test_no_profile_row_scores_zero(spark):
    df = posting(spark, ("1", "t", "c", "python"))
    assert rows(scoring.keyword_match(df, profile(spark, "x").limit(0)), "keyword_match_score") == [(0.0,)]


def test_steps(spark):
    df = posting(spark, ("1", "t", "c", "python spark"), ("2", "t", "c", "cook"))
    wanted = profile(spark, "python")
    register_step("title_length", lambda d, p, o: d.withColumn("len_score", F.length("title") * F.lit(o["by"])))
    steps = [
        ScoreStep("keyword_match", "keyword_match_score"),
        ScoreStep("semantic_score", "semantic_score", options={"model": "minilm"}),
        ScoreStep("title_length", "len_score", options={"by": 2.0}),
    ]
    ranked = score_postings(df, wanted, steps, columns=["title", "id"])
    assert ranked.columns == ["title", "id", "keyword_match_score", "semantic_score", "len_score", "final_score"]
    assert [r.id for r in ranked.collect()] == ["1", "2"]
    del STEPS["title_length"]
    with pytest.raises(ValueError, match="unknown step"):
        apply_steps(df, wanted, [ScoreStep("title_length", "x")])


def test_unions(spark):
    a = spark.createDataFrame([("1", "x")], "id string, a string")
    b = spark.createDataFrame([("2", "y")], "id string, b string")
    assert sorted(rows(ranking.union_searches([a, b]), "id")) == [("1",), ("2",)]
    assert ranking.union_searches([a, b]).columns == ["id", "a", "b"]
    mixed = spark.createDataFrame([("1", None, 1.0)], "a string, b string, c double")
    assert shaping.drop_all_null_columns(mixed).columns == ["a", "c"]


def test_filters_by_tables(spark):
    df = posting(spark, ("1", "Staff dev", "Acme", "x"), ("2", "dev", " ACME ", "python"), ("3", "dev", "other", None))
    lists = lambda *rows_: spark.createDataFrame(rows_, "list_name string, keyword string")
    got = lambda *rows_: sorted(r.id for r in filters.filter_by_tables(df, lists(*rows_)).collect())
    assert got(("other", "x")) == ["1", "2", "3"]
    assert got(("title_blocklist", "STAFF"), ("title_blocklist", ""), ("title_blocklist", None)) == ["2", "3"]
    assert got(("company_blocklist", "acme")) == ["3"]
    assert got(("description_allowlist", "Python")) == ["2"]


def test_a_run_written_twice_is_one_run(spark, tmp_path):
    df = posting(spark, ("1", "t", "c", "x"), ("2", "u", "c", "x"))
    out = str(tmp_path / "out")
    for _ in range(2):
        manifest = postings.write_postings(df, out, [Search(0)], run_id="r")
    postings.write_postings(df.limit(1), out, [Search(0)], run_id="other")
    assert manifest.count() == 1 and manifest.first().total_new_jobs == 2
    assert postings.read_run(spark, out, "r").count() == 2
    assert postings.read_manifest(spark, out).count() == 2
    with pytest.raises(ValueError, match="no complete run"):
        postings.read_run(spark, out, "broken off")


def test_seen_ids_by_line(spark, tmp_path):
    (tmp_path / "ids").write_text("b\n a \n\na\n")
    assert sorted(rows(seen.import_seen_lines(spark, str(tmp_path / "ids")), "id")) == [("a",), ("b",)]


def test_odd_ids_lose_and_repeat_no_row(spark):
    df = posting(spark, ("1", "a", "c", "x"), ("1", "b", "c", "y"), (None, "d", "c", "z"), (None, "e", "c", None))
    assert ranking.dedup_reposts(df, ("id",)).count() == 4
    assert sorted(rows(ranking.unique_ids(df, ("title",)), "title")) == [("a",), ("d",), ("e",)]
    assert tfidf.tfidf_cosine(df, profile(spark, "x y z word")).count() >= 4
