import datetime as dt
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.functions import driver_text, html, jsonx, screen, sections, textx, urls
from siftline.operators import capture, evaluate, providers, queue, report, stats
from siftline import __main__ as main
from siftline import programs
from siftline.plans import catalog
from siftline.sources import config, lake, pages
from siftline.streaming import watch

CARD = '<div class="x base-card" data-entity-urn="urn:li:jobPosting:{i}"><a class="base-card__full-link" href="u{i}">T {i}</a><h3 class="base-search-card__title"> Title&amp;  {i}</h3><a class="hidden-nested-link" href="c">Co</a><span class="job-search-card__location">Here</span><time class="job-search-card__listdate--new" datetime="2024-01-0{i}">{i} days ago</time></div>'


def page(*ids):
    return "<ul>" + "".join(CARD.format(i=i) for i in ids) + "</ul>"


def test_cards_and_void_tags():
    cards = html.cards(page(1, 2))
    assert [c["job_id"] for c in cards] == ["1", "2"] and cards[0]["title"] == "Title& 1" and cards[0]["company_url"] == "c" and cards[1]["posted_date"] == "2024-01-02"
    broken = (CARD.format(i=1).replace("<h3", "<img><h3", 1) + CARD.format(i=2))
    assert html.cards(broken) == []  # never closes, swallows the next
    assert html.cards('<div class="base-card" data-entity-urn="a:jobPosting:9"></div>')[0]["title"] == ""
    nested = html.cards('<div class="base-card" data-entity-urn="a:jobPosting:9"><h3 class="base-search-card__title">a<span class="job-search-card__location">b</span>c</h3><a class="hidden-nested-link" href=" /x?a&amp;amp;b ">Co</a></div>')[0]
    assert (nested["title"], nested["location"], nested["company"], nested["company_url"]) == ("ab", "", "Co", "/x?a&b")


def test_details_absent_is_not_empty():
    assert html.details('<h2 class="top-card-layout__title"></h2>') == {"title": "", "company": None, "posted": None, "description": "", "segments": []}


def test_fragment_and_text():
    doc = '<div class="a show-more-less-html__markup b"><div>a<br>b</div><img><p>c</p></div><div>z</div>'
    assert html.fragment(doc) == "<div>a<br>b</div><img><p>c</p>"
    assert html.fragment(doc.replace("</div>", "")) == ""
    assert html.plain("<div>a</div><div>b &amp;lt;</div><li>c") == "ab < c"
    assert [(s["text"], s["tags"]) for s in html.segments("<p><b>Krav</b></p><ul><li>x <i>y</i></li></ul>")] == [("Krav", ["b", "p"]), ("x y", ["i", "li", "ul"])]
    assert [s["text"] for s in html.segments("<h5>Krav</h5>x<section>y</section>z<p>w</p>")] == ["Krav", "x y z", "w"]
    assert [s["tags"] for s in html.segments("<b><i>x</b>y</i>z</q>")] == [["b", "i"]]  # an end tag takes its own start away, not what is inside
    assert [s["tags"] for s in html.segments("<b><i>x</b><p>y</i></p>z")] == [["b", "i"], ["i", "p"], []]


@pytest.mark.parametrize(
    "lines,want",
    [
        (["Intro", "Requirements:", "Python", "We offer", "Cake"], "Requirements:\nPython"),
        (["Om dig", "Snäll", "Ansök nu"], "Om dig\nSnäll"),
        (["About you", "x", "About you", "y"], "About you\nx"),
        (["Requirements."], "Requirements."),
        (["Requirements! ", "x"], ""),
        (["We are looking for someone who:", "x", "Contact our team of many people who will be glad to help you with all of it.", "y"], "We are looking for someone who:\nx\nContact our team of many people who will be glad to help you with all of it.\ny"),
        (["Qualifications", "Build.", "Application details. They are long!", "z"], "Qualifications\nBuild.\nApplication details. They are long!\nz"),
        (["Nothing"], ""),
        ([], ""),
        (["KRAV", "ett", "Önskvärt", "två", "ÖVRIGT", "tre"], "KRAV\nett\nÖnskvärt\ntvå"),
    ],
)
def test_section(spark, lines, want):
    df = spark.createDataFrame([(lines,)], "x array<string>")
    got = df.select(sections.section("x")).first()[0]
    assert got == want


def test_verdict(spark):
    rows = [("Python dev", "", "", "", []), ("", "", "", "Vi söker en LÄRARE", []), ("", "", "", "lärare som kan data", []), ("x", "", "", "y", None), ("", "", "", "", ["developer"]), ("aids", "", "", "lärarens", [])]
    df = spark.createDataFrame(rows, "title string, company string, location string, description string, source_searches array<string>")
    got = [(r.prefilter_pass, r.prefilter_reason) for r in screen.screened(df).collect()]
    assert got == [
        (True, "Matched title keyword: python"),
        (False, "Rejected obvious teaching role: lärare"),
        (True, "Matched description keyword: data"),
        (True, screen.PERMISSIVE),
        (True, "Matched source_searches keyword: developer"),
        (True, screen.PERMISSIVE),
    ]
    assert spark.range(1).select(screen.passes(F.lit(None).cast("boolean"))).first()[0] is True


def test_strip_is_pythons(spark):
    text = " \x1c a b \x85"
    row = spark.createDataFrame([(text,)], "x string").select(textx.strip("x"), textx.collapse("x")).first()
    assert row[0] == text.strip() and row[1] == " ".join(text.split())


def test_urls(spark):
    df = spark.createDataFrame([("https://x.y/s?keywords=a%20b+c&geoId=1&keywords=&start=9#f",), ("https://x.y/s?geoId=1",), ("https://x.y/s",)], "u string")
    assert [r[0] for r in df.select(urls.search_label("u")).collect()] == ["a b c", "geo-only", "https://x.y/s"]
    assert df.select(urls.page_url("b", "u", F.lit(10))).first()[0] == "b?keywords=a+b+c&geoId=1&start=10"


def test_config(tmp_path):
    p = tmp_path / "c.jsonc"
    p.write_text('{ // note\n "search_terms": "a // b", /* x */ "job_types": ["F", "C"], "easy_apply": true, "extra_params": {"z": 0, "n": null}, }')
    c = config.load(str(p))
    assert config.search_urls(c, "b") == ["b?origin=JOB_SEARCH_PAGE_JOB_FILTER&keywords=a+%2F%2F+b&f_JT=F%2CC&f_AL=true&z=0"]
    assert config.search_urls({"searches": [{"search_url": " q "}]}, "b") == ["q"]
    for bad in ({"searches": 3}, {"searches": [1]}, {}):
        with pytest.raises(ValueError):
            config.search_urls(bad, "b")


def test_rtf():
    assert driver_text.rtf_to_text(r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\gen x;}H\'e5\u228?r\par next\~x\-y\tab z}") == "Håär\nnext xy\tz"
    assert driver_text.text_of(" plain ") == "plain"


def test_take_while(spark):
    rows = [(0, "a", 0, 200, page(1, 2)), (0, "a", 1, 200, page(3)), (0, "a", 2, 200, page(4, 5)), (1, "b", 0, 200, page(1, 6)), (1, "b", 1, 429, ""), (1, "b", 2, 200, page(7))]
    df = spark.createDataFrame(rows, "search_ord int, label string, page_no int, status int, html string")
    seen = spark.createDataFrame([("6",)], "job_id string")
    cards, audits = capture.capture(df, seen, F.lit("2024-02-01").cast("date"), 2, page_size=2, max_pages=9)
    got = cards.collect()
    assert [(r.job_id, r.source_searches) for r in got] == [("1", ["a", "b"]), ("2", ["a"])]
    assert {r.search: (r.pages_requested, r.results_seen, r.already_in_memory, r.throttled) for r in audits.collect()} == {"a": (2, 3, 0, False), "b": (2, 2, 1, True)}


def test_live_pages_stop_early():
    bodies = {0: (200, page(1, 2)), 2: (200, page(3)), 4: (200, page(4, 5))}
    got = list(pages.paged("u?x=1", 9, 2, 0, lambda u: bodies[int(u.rsplit("=", 1)[1])]))
    assert [g[0] for g in got] == [0, 1]
    assert [g[1] for g in pages.paged("u", 9, 2, 0, lambda u: (429, ""))] == [429]


def test_details_join(spark):
    cards = spark.createDataFrame([(1, "1", "card", "co", "1 day ago", ["a"]), (2, "2", "card", "co", "", ["a"])], "ord long, job_id string, title string, company string, posted string, source_searches array<string>")
    body = '<h2 class="top-card-layout__title"></h2><div class="show-more-less-html__markup"><p>Intro</p><p><b>Krav</b></p><ul><li>x</li></ul><p>Vi erbjuder</p></div>'
    details = spark.createDataFrame([("1", 200, body), ("2", 429, "")], "job_id string, status int, html string")
    (r,) = capture.with_details(cards, details).collect()
    assert (r.title, r.company, r.requirements_text, r.requirements_extraction_method) == ("", "co", "Krav\nx", "pattern")


def test_audit_rules(spark):
    audits = spark.createDataFrame([(1, "a", 5, 0, False), (2, "a", 4, 0, True), (3, None, 3, 0, None)], "ord long, search string, results_seen long, passed_prefilter long, throttled boolean").withColumns({"pages_requested": F.lit(None).cast("long"), "already_in_memory": F.col("results_seen")})
    got = {r.search: (r.results_seen, r.pages_requested, r.throttled) for r in stats.merge_audits(audits).collect()}
    assert got == {"a": (9, 0, True), "unknown": (3, 0, False)}
    ads = spark.createDataFrame([(["a", "zz"], None), (["a"], False)], "source_searches array<string>, prefilter_pass boolean")
    assert {r.ord: r.passed_prefilter for r in stats.add_passed(audits.where("search = 'a'"), ads).collect()} == {1: 0, 2: 1}


def test_batch_stats(spark):
    ads = spark.createDataFrame([(1, ["developer", "developer"]), (2, None)], "ord long, source_searches array<string>")
    decisions = spark.createDataFrame([(1, "confirmation", True), (2, "prefilter", False)], "ord long, stage string, hit boolean")
    got = {r.search_term: (r.new_ads, r.matches, r.total_batch_ads, r.total_batch_matches) for r in stats.batch_stats(ads, decisions, {"matcher": "llm"}).collect()}
    assert got == {"developer": (2, 2, 2, 1), "unknown": (1, 0, 2, 1)}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([True, False, None]), max_size=8), st.sampled_from([None, -1, 0, 1, 2, 10]))
def test_queue_cap(spark, verdicts, cap):
    df = spark.createDataFrame(list(enumerate(verdicts)), "ord long, prefilter_pass boolean")
    chosen, deferred = (sorted(r.ord for r in x.collect()) for x in queue.split_by_cap(df, cap))
    want, n = [], 0
    for i, v in enumerate(verdicts):
        ok = v is not False
        if not ok or cap is None or n < cap:
            want.append(i)
        n += ok
    assert chosen == want and sorted(chosen + deferred) == list(range(len(verdicts)))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("xyz")), min_size=1, max_size=9))
def test_first_wins_model(spark, rows):
    df = spark.createDataFrame([(i, k, lab) for i, (k, lab) in enumerate(rows)], "ord long, job_id string, label string")
    want = {}
    for i, (k, lab) in enumerate(rows):
        first, labels = want.setdefault(k, (i, []))
        if lab not in labels:
            labels.append(lab)
    assert {r.job_id: (r.ord, r.source_searches) for r in capture.first_wins(df).collect()} == want


def test_report(spark):
    runs = spark.createDataFrame([(1, "2024-01-01T00:00:00Z", 3, "p"), (2, "2023-12-31T23:59:59Z", 5, "q"), (3, "bad", 7, "r"), (4, "2024-01-01T12:00:00Z", 2, "s")], "ord long, matched_at string, job_count long, input_path string")
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    assert report.considered_since(runs, now).first().considered == 5
    assert report.current_run(runs, "q").first().ord == 2 and report.current_run(runs.where("ord <> 3"), "none").first().ord == 4
    assert report.message(1, 2, [{"title": "T", "url": "", "reason": "r"}]).endswith("1. T\nNo URL in scraped ad.\nReason: r")
    long = spark.createDataFrame([("x" * 5000,)], "m string").select(report.truncated("m")).first()[0]
    assert len(long) == 4096 and long.endswith("[truncated]")
    assert report.ascii_table(["a", "bb"], [["ccc", 1]]).split("\n")[1] == "| a   | bb |"


def test_parsers():
    assert jsonx.collect_ids({"job_id": 1, "x": [{"job_id": ""}, {"job_id": {"job_id": "b"}}]})[0] == "1"
    good = json.dumps({"candidates": [{"candidate_id": "a", "reason": " r "}, {"candidate_id": "a", "reason": "s"}]})
    assert jsonx.parse_triage(good, {"a"}) == {"a": "r"}
    for bad in ('{"candidates": [{"candidate_id": "z", "reason": "r"}]}', '{"candidates": 1}', "[]"):
        with pytest.raises(ValueError):
            jsonx.parse_triage(bad, {"a"})


def test_bad_answers_are_value_errors():
    for bad in ('{"candidates": [{"candidate_id": ["a"], "reason": "r"}]}', '{"candidates": [1]}'):
        with pytest.raises(ValueError):
            jsonx.parse_triage(bad, {"a"})
    for bad in ("[]", '{"hit": 1}', "null"):
        with pytest.raises(ValueError):
            jsonx.parse_hit(bad)


def test_service_asks_by_schema_and_once_more():
    calls = []

    def post(url, payload, headers):
        calls.append(payload)
        return {"output": [{"content": [{"type": "output_text", "text": "ok"}]}], "usage": {"n": 1}, "model": "m2"} if len(calls) == 2 else {"incomplete_details": {"reason": "max_output_tokens"}}

    service = providers.Service("k", "m", post)
    assert service.confirm({"title": "T", "description": " "}, "me") == ("ok", '{"n": 1}', "m2")
    assert [c["max_output_tokens"] for c in calls] == [512, 1024] and calls[0]["text"]["format"]["strict"] and calls[0]["reasoning"] == {"effort": "low"}
    assert calls[0]["prompt_cache_key"] == providers.cache_key("me") and "Title: T" in calls[0]["input"] and "Description" not in calls[0]["input"]
    with pytest.raises(ValueError):
        providers.Service("k", post=lambda *a: {"incomplete_details": None}).title_vowel({})
    assert providers.Service("k", post=lambda *a: {"output_text": '{"hit": true, "reason": "x"}'}).matches_title_vowel({"title": "A"})
    assert providers.named("mock") is None
    for bad in (lambda: providers.named("other"), lambda: providers.Service("")):
        with pytest.raises(ValueError):
            bad()


def test_batches_have_ids_of_their_own(spark):
    rows = [(i, None, t, "c", "", "", "", True, None) for i, t in enumerate(["good", "bad", "good"])]
    ads = spark.createDataFrame(rows, "ord long, job_id string, title string, company string, location string, description string, requirements_text string, prefilter_pass boolean, prefilter_reason string")

    class Echo:
        name = model = "echo"

        def triage(self, ads, profile):
            return evaluate.Reply(json.dumps({"candidates": [{"candidate_id": a["candidate_id"], "reason": a["title"]} for a in ads]}), '{"t": 1}')

        def confirm(self, ad, profile):
            return evaluate.Reply(json.dumps({"hit": ad["title"] == "good", "reason": ad["title"]}), '{"t": 2}', "m3")

    for n in (1, 2, None):
        got = {r.ord: (r.hit, r.reason, r.usage, r.triage_usage, r.model, r.triage_candidate_count) for r in evaluate.two_stage(ads, Echo(), "p", lambda df, s: df, n).collect()}
        assert got == {i: (rows[i][2] == "good", rows[i][2], '{"t": 2}', '{"t": 1}', "m3", min(n or 3, 3 - i // (n or 3) * (n or 3))) for i in range(3)}


def test_routing_needs_all_decisions(spark):
    ads = spark.createDataFrame([(1, "a", "t", "d"), (2, "b", "t", "d")], "ord long, job_id string, title string, description string")
    with pytest.raises(Exception, match="decision count"):
        evaluate.routed(ads, spark.createDataFrame([(1, True)], "ord long, hit boolean")).collect()
    with pytest.raises(Exception, match="sentinel"):
        evaluate.assert_sentinel(spark.createDataFrame([("x", "llm", True)], "job_id string, matcher string, hit boolean"), "s", "llm").collect()


def test_lake(spark, tmp_path):
    room = tmp_path / "waiting_room" / "1"
    room.mkdir(parents=True)
    (room / "a.json").write_text('[{"job_id": 1, "source_searches": "x"}, {"title": "no id"}]')
    (room / "b.json").write_text('[{"job_id": "1", "source_searches": ["y", " "]}, {"title": "no id"}]')
    (room / "c.json").write_text("{broken")
    (room / "c_hits.json").write_text('[{"job_id": "7"}]')
    rows = {r.job_id: r.source_searches for r in lake.waiting_ads(spark, str(tmp_path)).collect()}
    assert rows == {"1": ["x", "y"], None: ["unknown"]}
    assert {r.job_id for r in lake.seen_ids(spark, str(tmp_path)).collect()} == {"1", "7"}
    with pytest.raises(Exception, match="array of objects"):
        lake.ads(lake.files(spark, str(room), "c.json"), strict=True).collect()
    chosen = spark.createDataFrame([(1, "a")], "ord long, job_id string")
    root = str(tmp_path / "out")
    assert lake.hand_off(chosen, chosen.limit(0), root, "r1") and not lake.hand_off(chosen.limit(0), chosen, root, "r2")
    lake.drop_runs(spark, f"{root}/bucket=discard", "run_ts=r9")
    assert not list((tmp_path / "out" / "bucket=discard").glob("run*"))


def test_stream(spark, tmp_path):
    spark.createDataFrame([("1", 1), ("1", 2), ("2", 3)], "job_id string, n int").write.parquet(str(tmp_path / "in"))
    seen = []
    stream = watch.first_seen(watch.arriving(spark, str(tmp_path / "in"), "job_id string, n int"))
    q = watch.in_batches(stream, lambda df, i: seen.extend(r.job_id for r in df.collect()), str(tmp_path / "ck"))
    assert q.awaitTermination(60)
    assert sorted(seen) == ["1", "2"]


def test_missing_lake_is_empty(spark, tmp_path):
    gone = str(tmp_path / "none")
    assert lake.seen_ids(spark, gone).count() == lake.waiting_ads(spark, gone).count() == lake.run_metadata(spark, gone).count() == lake.audits(spark, gone + "/x_search_audit.json").count() == 0
    (tmp_path / "a_search_audit.json").write_text('[{"search": "a", "results_seen": 3}, 7, {"search": null, "throttled": true}]')
    assert [(r.search, r.results_seen, r.throttled, r.ord) for r in lake.audits(spark, str(tmp_path / "a_search_audit.json")).orderBy("ord").collect()] == [("a", 3, None, 0), (None, None, True, 2)]
    (tmp_path / "b_search_audit.json").write_text('{"search": "a"}')
    with pytest.raises(Exception, match="not a list"):
        lake.audits(spark, str(tmp_path / "b_search_audit.json")).collect()
    with pytest.raises(ValueError):
        lake.run_from_input("x/hits/1/a.json")
    assert lake.run_from_input("r/discard/7/a.json") == "7" and config.limits(None, None, 5) == (5, 5) and config.limits(3, -1, 5) == (3, 0)


def test_numbered(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("k"))
    got = queue.numbered(rows, "k", keep=lambda df, label: programs.keeper(spark, str(tmp_path), "r")(df, label)).collect()
    assert all(r.k == r.ord for r in got) and len(got) == 1000


def detail(title, *parts):
    return f'<h2 class="top-card-layout__title">{title}</h2><div class="show-more-less-html__markup">' + "".join(f"<p>{p}</p>" for p in parts) + "</div>"


def test_programs_end_to_end(spark, tmp_path):
    root = str(tmp_path / "results")
    searches = [(0, "a", 0, 200, page(1, 2)), (0, "a", 1, 200, page(3)), (1, "geo-only", 0, 200, page(2, 4)), (1, "geo-only", 1, 429, "")]
    found = spark.createDataFrame(searches, "search_ord int, label string, page_no int, status int, html string")
    details = spark.createDataFrame([("1", 200, detail("Python engineer", "Krav", "engineer", "Kontakt", "z")), ("2", 200, detail("Lärare", "Skola")), ("3", 429, ""), ("4", 200, detail("Odd", "Nothing"))], "job_id string, status int, html string")
    today = dt.date(2024, 2, 1)
    made = programs.capture_run(spark, root, found, details, "20240201_000000", today, card_limit=9, bucket="waiting_room", page_size=2)
    assert made.path and "Geo-visible jobs" in made.text and "| geo-only | 0" in made.text
    again = programs.capture_run(spark, root, found, details, "20240201_000001", today, card_limit=9, page_size=2)
    assert again.path and [r.job_id for r in lake.ads(lake.files(spark, again.path)).collect()] == [] or again.path is None  # 3 was throttled before, the rest is in memory
    audits = {r.search: (r.pages_requested, r.results_seen, r.already_in_memory, r.passed_prefilter, r.throttled) for r in lake.audits(spark, f"{root}/waiting_room").collect()}
    assert audits == {"a": (2, 3, 0, 1, False), "geo-only": (2, 2, 0, 1, True)}

    now = dt.datetime(2024, 2, 1, 12, tzinfo=dt.UTC)
    provider = catalog.RuleProvider()
    provider.name, provider.triage = "openai", lambda ads, profile: evaluate.Reply(json.dumps({"candidates": [{"candidate_id": a["candidate_id"], "reason": "t"} for a in ads]}), '{"tokens": 5}')
    provider.confirm = lambda ad, profile: evaluate.Reply(json.dumps({"hit": "Python" in ad["title"], "reason": "because"}))
    done = programs.evaluate_run(spark, root, "20240201_120000", "waiting_room", provider, "me", cap=1, now=now)
    assert (done.metadata["job_count"], done.metadata["hits_count"], done.metadata["discards_count"]) == (2, 1, 1) and "Search evaluation audit" in done.text
    assert {r.job_id: r.bucket for r in lake.ads(lake.files(spark, f"{root}/hits")).select("job_id", F.lit("hits").alias("bucket")).collect()} == {"1": "hits"}
    lines = {r.line for r in done.log.collect()}
    assert "[decision] job_id=1 eval_stage='Eval 3: LLM confirmation' hit=true title='Python engineer' reason='because'" in lines and len(lines) == 2
    waiting = [(r.job_id, r.source_searches) for r in lake.waiting_ads(spark, root).collect()]
    assert waiting == [("4", ["geo-only"])] and lake.runs_in(spark, root, "waiting_room") == ["20240201_120000"]
    rows = spark.read.option("header", True).csv(f"{root}/llm_search_stats.csv").collect()
    assert {(r.search_term, r.new_ads, r.matches, r.total_batch_ads) for r in rows} == {("a", "2", "1", "2"), ("geo-only", "1", "0", "2")}
    text = programs.report_run(spark, root, now, done.input_path)
    assert "Considered in last 12 hours: 2" in text and "Ads in memory: 3" in text and "1. Python engineer" in text and "Reason: because" in text and "New matches in this run: 1" in text
    second = programs.evaluate_run(spark, root, None, done.input_path, now=now)
    assert second.metadata["matcher"] == "mock" and second.metadata["hits_count"] == 1 and second.text == ""
    with pytest.raises(Exception, match="sentinel"):
        programs.evaluate_run(spark, root, None, done.input_path, sentinel=True)
    assert programs.evaluate_run(spark, str(tmp_path / "empty"), source="waiting_room").input_path is None


def test_arguments():
    a = main.arguments(["evaluate", "--waiting-room", "--llm-limit", "3"])
    assert a.input == "waiting_room" and a.llm_limit == 3
    with pytest.raises(SystemExit):
        main.arguments(["evaluate", "--latest", "--input", "x"])
    assert main.arguments(["--results-root", "r", "report", "--dry-run"]).results_root == "r"
