"""Small literal corpora, formulas derived again in Python, and invariants."""

import csv as csvlib
import io
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexmill import sinks, stores
from lexmill.functions import text, urls
from lexmill.operators import corpus, crawl, intent, keyed, quality, sets, signals
from lexmill.plans import enrichment, profile
from lexmill.sources import html, inputs, serp, trends

SOURCES = [(0, "SEO tools for analysis", "page_title", 3.0), (1, "Discover SEO tools and research, seo!", "serp_snippet", 1.5), (2, "Best software and <b>SEO</b> tools for keyword analysis", "body_text", 1.0), (3, "", "body_text", 1.0), (4, None, "h1", 2.5)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(SOURCES, "source_idx long, text string, field string, weight double")


def words(t):
    return [w for w in re.findall(text.WORD, re.sub("<[^>]+>", " ", t or "").lower()) if w not in text.STOPWORDS]


def test_tokens(spark, docs):
    assert len(text.STOPWORDS) == 178
    assert {r.source_idx: r.tokens for r in corpus.token_table(docs).collect()} == {i: words(t) for i, t, _, _ in SOURCES}


def test_lemmas(spark, docs):
    forms = spark.createDataFrame([("tools", "tool"), ("discover", "the"), ("tools", "tooling")], "word string, lemma string")
    for most in (10, 0):
        got = {r.source_idx: r.tokens for r in corpus.with_lemmas(corpus.token_table(docs), forms, most).collect()}
        assert got[0] == ["seo", "tool", "analysis"] and got[1] == ["seo", "tool", "research", "seo"] and got[3] == got[4] == []


def test_ngrams_and_tfidf(docs):
    table = corpus.token_table(docs)
    got = {r.ngram: r for r in corpus.ngrams_with_sources(table, 2, 1, 1).collect()}
    count, weight, where = Counter(), defaultdict(float), defaultdict(set)
    for i, t, _, w in SOURCES:
        ws = words(t)
        for a, b in zip(ws, ws[1:]):
            count[f"{a} {b}"] += 1
            weight[f"{a} {b}"] += w
            where[f"{a} {b}"].add(i)
    assert {k: (r.raw_count, r.weighted_count, r.doc_frequency) for k, r in got.items()} == {k: (count[k], weight[k], len(where[k])) for k in count}
    assert all(sum(r.sources.values()) == r.raw_count for r in got.values())
    terms = {r.term: r for r in corpus.tfidf(table).collect()}
    df = Counter(w for _, t, _, _ in SOURCES for w in set(words(t)))
    for term, r in terms.items():
        idf = math.log((len(SOURCES) + 1) / (df[term] + 1)) + 1
        assert r.tfidf == pytest.approx(sum(words(t).count(term) / len(words(t)) * idf * w for _, t, _, w in SOURCES if term in words(t)))


def test_bm25f_controlled_case(spark, docs):
    got = corpus.bm25f(corpus.token_table(docs.filter("source_idx < 3")), ["SEO", "tools"], {"page_title": 3.0}, {"page_title": 0.5}).orderBy(F.desc("score"), F.desc("query_coverage"), "source_idx").collect()
    assert [r.source_idx for r in got] == [0, 1, 2] and all(r.score == 0 and r.query_coverage == 1 for r in got)
    assert corpus.bm25f(corpus.token_table(docs), []).count() == 0
    one = corpus.bm25f(corpus.token_table(docs), ["research", "nowhere"]).collect()
    lengths = len(words(SOURCES[1][1]))
    w = 1 / (1 - 0.75 + 0.75 * 1)
    assert lengths and one[0].score == pytest.approx(w / (1.2 + w) * math.log((5 - 1 + 0.5) / 1.5 + 1)) and one[0].query_coverage == 0.5


def test_cooccurrence_is_symmetric(docs):
    pairs = {(r.term, r.other): r.n for r in corpus.neighbour_counts(corpus.token_table(docs)).collect()}
    assert pairs and all(pairs[b, a] == n for (a, b), n in pairs.items())
    got = corpus.cooccurrence(corpus.token_table(docs), ["seo"]).collect()
    assert "seo" not in {r.term for r in got} and all(0 <= r.jaccard_similarity <= 1 for r in got)


def test_content_gap(spark):
    df = spark.createDataFrame([(1, "tea tea tea tea best"), (2, None)], "id long, text string")
    got = {r.id: r for r in corpus.content_gap(df, F.array(F.lit("Best"), F.lit("cup"))).collect()}
    assert (got[1].coverage_ratio, got[1].missing_high_value, got[1].overused_low_value) == (0.5, ["cup"], ["tea"])
    assert got[1].cosine_similarity == pytest.approx(1 / (math.sqrt(17) * math.sqrt(2))) and got[2].coverage_ratio == 0
    assert corpus.content_gap(df, F.array().cast("array<string>")).first().missing_high_value == []


def test_intent(spark):
    df = spark.createDataFrame([(0, "How to buy the best tea guide", "title", 3.0), (1, "shop.example.com/cart/buy", "displayed_link", 1.0), (2, "купить чай цена доставка", "snippet", 1.5), (3, "nothing", "body", 1.0)], "source_idx long, text string, field string, weight double")
    got = intent.intent(df).first()
    assert got.intent_type == "transactional" and {"url:buy", "url:cart", "куп", "достав"} <= set(got.signals) and "how" not in got.signals
    assert intent.intent(df.filter("source_idx = 3")).first().intent_type == "undetermined"


@pytest.mark.parametrize("url,domain", [("https://sub.site.kiev.ua", "site.kiev.ua"), ("https://kiev.ua", ""), ("https://shop.amazon.co.uk", "amazon.co.uk"), ("https://shop.example.pp.ru", "example.pp.ru"), ("http://1.2.3.4:80/x", "1.2.3.4"), ("localhost", ""), ("EXAMPLE.com/path?q", "example.com"), (None, ""), ("http://u:p@a.b.example.org:8080/", "example.org")])
def test_registrable_domain(spark, url, domain):
    assert spark.createDataFrame([(url,)], "u string").select(urls.registrable_domain("u").alias("d")).first().d == domain


def test_urls(spark):
    rows = [("http://A.b/c/d", "x?b=2&a=1#f", "http://a.b/c/x?a=1&b=2"), ("http://a.b:81/c", "/r", "http://a.b:81/r"), ("https://a", "//h/p", "https://h/p"), ("http://a", "mailto:x", "")]
    df = spark.createDataFrame(rows, "base string, href string, want string")
    assert df.filter(urls.normalized("href", F.col("base")) != F.col("want")).count() == 0
    safe = {"http://example.com": True, "http://localhost/": False, "http://10.0.0.1": False, "http://172.20.1.1/": False, "ftp://example.com": False, "http://[::1]/": False, "http://x.local": False, "http://8.8.8.8": True}
    got = {r.u: r.s for r in spark.createDataFrame([(u,) for u in safe], "u string").select("u", urls.is_safe("u").alias("s")).collect()}
    assert got == safe


def test_url_match(spark):
    results = spark.createDataFrame([("https://www.a.com/x/",), ("http://a.com/x",), ("https://b.com",), ("https://a.com.evil.com/x",)], "url string")
    sources = spark.createDataFrame([(0, "https://a.com/x?q=1"), (1, "https://a.com/y")], "source_pos long, source_url string")
    got = {r.url: (r.match_type, r.matched_target) for r in keyed.classified(results, sources).collect()}
    assert got == {"https://www.a.com/x/": ("full_url", "https://a.com/x?q=1"), "http://a.com/x": ("domain", "https://a.com/x?q=1"), "https://b.com": ("none", ""), "https://a.com.evil.com/x": ("none", "")}


def test_merge(spark):
    rows = [("купить кофе", "1", "https://a.com/p", ""), ("Купить Кофе", "4", "https://www.b.com", ""), ('"купить кофе"', "2", "https://c.com", ""), ("купить кофе", "x", "https://d.com", ""), ("Tea", "10", "https://d.com", "shown.com ")]
    serp_rows = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "keyword string, position string, url string, displayed_link string, row_idx long")
    ads = spark.createDataFrame([("Купить Кофе", 1), ("tea", 2), ("none", 3)], "keyword string, n long")
    got = {r.keyword: r for r in keyed.with_serp(ads, serp_rows).collect()}
    assert (got["Купить Кофе"].serp_results, got["Купить Кофе"].serp_top_position, got["Купить Кофе"].serp_top3_domains) == (4, 1.0, "a.com, c.com, b.com")
    assert got["tea"].serp_top3_domains == "shown.com" and got["none"].serp_results is None and len(got) == 3
    assert keyed.with_serp(ads, None) is ads


def test_metrics(spark):
    raw = spark.createDataFrame([("k", 10, "LOW", 5, 1_000_000, None, 1), ("k", 30, "HIGH", 9, 500_000, 2_000_000, 2), ("k", 20, "MED", 9, None, None, 3)], "keyword string, searches long, competition string, competition_index long, low_micros long, high_micros long, seq long")
    r = keyed.metric_buckets(raw).first()
    assert (r.avg_monthly_searches, r.competition, r.competition_index, r.low_cpc, r.high_cpc) == (30, "MED", 9, 1.0, 2.0)


def test_title_alignment_and_effort(spark):
    pages = spark.createDataFrame([(1, "Green tea", "Green tea", "about tea"), (2, "Tea green", None, None), (3, "", "x", "y")], "page_id long, title string, h1 string, intro_text string")
    got = {r.page_id: r for r in signals.title_alignment(pages).collect()}
    assert got[1].title_h1_overlap == 1 and got[1].title_intro_overlap == pytest.approx(1 / 3) and got[1].duplicate_title_risk == pytest.approx(1 / 3)
    assert (got[3].title_rewrite_risk, got[3].title_alignment_score) == (1.0, 0.0)
    full = spark.createDataFrame([(1, 900, 2, 2, 6, 4, True), (2, 0, 0, 0, 0, 0, False)], "page_id long, word_count long, list_count long, table_count long, citation_count long, media_count long, has_answer_first boolean")
    assert [(round(r.effort_score, 9), r.effort_level) for r in signals.content_effort(full).orderBy("page_id").collect()] == [(1.0, "high"), (0.0, "low")]


def test_quality(spark):
    t = spark.createDataFrame([(1, "META_TITLE: Best tea to buy\n**H1:** Tea\nmore h1\nDESCRIPTION:\nclick here now\n\nbody", "tea", ["tea", "best tea"], "x", 0.1, 0.9), (2, "<title>T</title><h1>H</h1>", "k", None, None, None, None), (3, None, None, None, None, None, None)], "text_id long, text string, keyword string, top_ngrams array<string>, meta_title string, tfidf_overlap double, cooccurrence_coverage double")
    got = {(r.text_id, r.element): r for r in quality.score_elements(t).collect()}
    assert got[1, "META_TITLE"].score == 80 and got[1, "META_TITLE"].issues == ["meta_title_too_short"]
    assert got[1, "DESCRIPTION"].issues[-1] == "forbidden_phrase_click here" and got[1, "H1"].element_text == "** Tea\nmore h1"
    assert got[2, "H1"].element_text == "H" and quality.quality_report(quality.score_elements(t)).count() == 3


def test_sets(spark):
    a = spark.createDataFrame([("u", "k", 2, "later"), ("u", "k", 1, "first"), ("v", "k", 3, "x")], "source_url string, keyword string, row_idx long, note string")
    assert {r.note for r in sets.first_pairs(a).collect()} == {"first", "x"}
    b = spark.createDataFrame([("v", "k", 1), ("w", "k", 1)], "source_url string, keyword string, row_idx long")
    assert {(r.source_url, r.note) for r in sets.append_absent(sets.first_pairs(a), b).collect()} == {("u", "first"), ("v", "x"), ("w", None)}
    assert sets.union_first([a, b]).count() == 3
    parts = sets.term_overlap(spark.createDataFrame([("Tea", 1), ("tea ", 2), ("cup", 3)], "term string, row_idx long"), spark.createDataFrame([('"TEA"', 1), ("pot", 2)], "term string, row_idx long"))
    assert [tuple(r) for r in parts["both"].collect()] == [("tea", "Tea", '"TEA"')] and parts["left_only"].count() == parts["right_only"].count() == 1


def test_crawl(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e")]
    page = lambda x: f"http://{x}.example.com/"
    links = spark.createDataFrame([(page(a), page(b)) for a, b in edges] + [(page("a"), "http://other.org/")], "url string, target string")
    seeds = spark.createDataFrame([(page("a"), 0)], "url string, seq long")
    got = [(r.url, r.depth) for r in crawl.crawl(links, seeds, 2, 50).collect()]
    assert got == [(page("a"), 0), (page("b"), 1), (page("c"), 1), (page("d"), 2)]
    assert len(crawl.crawl(links, seeds, 9, 2).collect()) == 2


def test_stores(spark, tmp_path):
    assert stores.cache_key("serp", "x", {"b": [2, 1], "a": " Q ", "api_key": "s"}) == stores.cache_key("serp", "x", {"a": "q", "b": [1, 2]})
    rows = spark.createDataFrame([("k", "serp", "2024-01-01 00:00:00", 1), ("k", "serp", "2024-01-02 00:00:00", 2), ("l", "llm_generate", "2024-01-01 00:00:00", 3)], "cache_key string, kind string, created_at string, seq long").withColumn("created_at", F.to_timestamp("created_at"))
    last = stores.latest(stores.with_expiry(rows))
    assert sorted((r.cache_key, r.seq) for r in stores.valid(last, F.lit("2024-01-10").cast("timestamp")).collect()) == [("l", 3)]
    steps = stores.Checkpoints(spark, str(tmp_path / "run"), {"k": [1]})
    assert steps.next_incomplete(["a", "b"]) == "a"
    assert steps.save("a", rows).count() == 3 and steps.is_done("a") and steps.next_incomplete(["a", "b"]) == "b"
    assert not stores.Checkpoints(spark, str(tmp_path / "run"), {"k": [2]}).is_done("a")


def test_inputs(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" one \n\n two\n")
    (tmp_path / "b.csv").write_text("x,Keywords\n1, a \n2,\n")
    assert [r.value for r in inputs.read_lines(spark, str(tmp_path / "a.txt")).collect()] == ["one", "two"]
    assert [r.value for r in inputs.read_column(spark, str(tmp_path / "b.csv")).collect()] == ["a"]
    with pytest.raises(inputs.TooManyRows):
        inputs.read_lines(spark, str(tmp_path / "a.txt"), 1)
    lines = spark.createDataFrame([(0, "a, b; c | d"), (1, "---"), (2, " ; "), (3, "e")], "line_no long, line string")
    assert [(r.group_id, r.keywords) for r in inputs.keyword_groups(lines).orderBy("group_id").collect()] == [(1, ["a", "b", "c", "d"]), (2, ["e"])]
    seeds = inputs.seed_keywords(spark.createDataFrame([('"Tea", tea,cup , ',)], "raw string"))
    assert [r.keyword for r in seeds.orderBy("pos").collect()] == ["Tea", "cup"]


def test_serp_payloads(spark):
    a = '{"organic":[{"title":" T \\\\u0041 ","link":"https://x","snippet":"s","richSnippet":{"price":"9","note":"n"}},{"title":"U","url":"https://y","rank":7,"description":"d"}],"relatedSearches":["r1",{"query":"r2"}],"peopleAlsoAsk":[{"question":"q?"}],"knowledgeGraph":{"title":"K","type":"t"}}'
    p = spark.createDataFrame([("k", "serper", a), ("l", "serpapi", "broken"), ("m", "serpapi", None)], "keyword string, provider string, payload string")
    got = serp.organic_results(p).orderBy("position").collect()
    assert [(r.position, r.title, r.url, r.snippet) for r in got] == [(1, "T A", "https://x", "s"), (7, "U", "https://y", "d")] and got[0].rich_snippet == "Price: 9, Note: n"
    assert sorted((r.related_query, r.type) for r in serp.related_queries(p).collect()) == [("q?", "people_also_ask"), ("r1", "related_search"), ("r2", "related_search")]
    assert [tuple(r) for r in serp.knowledge_graphs(p).collect()] == [("k", "K", "t", "")]
    report = spark.createDataFrame([("k", 0, "Domain;Url;Position"), ("k", 1, "a.com;https://a.com/;3")], "keyword string, line_no long, line string")
    assert [(r.position, r.title, r.url) for r in serp.organic_report(report).collect()] == [(3, "a.com", "https://a.com/")]


def test_trends_payloads(spark):
    widget = ")]}',\n" + '{"default":{"timelineData":[{"time":"1","formattedTime":"Jan","value":[10,20]}],"rankedList":[{"formattedRankType":"Rising","rankedKeyword":[{"query":"q","value":"Breakout"}]}],"geoMapData":[{"geoName":"Kyiv","value":[7]}]}}'
    api = '{"interest_over_time":{"timeline_data":[{"timestamp":"5","date":"Feb","values":[{"query":"a","extracted_value":3},{"value":"1,200"}]}]},"related_queries":{"top":[{"query":"t","value":9}]}}'
    p = lambda x: spark.createDataFrame([(["a", "b"], x)], "keywords array<string>, payload string")
    assert sorted((r.keyword, r.value) for r in trends.widget_points(p(widget)).collect()) == [("a", 10), ("b", 20)]
    assert [(r.label, r.value, r.rising) for r in trends.widget_related(p(widget)).collect()] == [("q", "Breakout", True)]
    assert [tuple(r) for r in trends.widget_regions(p(widget)).collect()] == [("Kyiv", 7, "a")]
    assert sorted((r.keyword, r.value) for r in trends.timeline_points(p(api)).collect()) == [("a", 3), ("b", 1200)]
    assert [(r.label, r.rank_type) for r in trends.section_related(p(api)).collect()] == [("t", "top")]
    content = "﻿Category: All\n\nWeek,tea: (Ukraine)\n2024-01-07 – 2024-01-13,45\n2024-01-14,<1%\nfoot,1\n"
    got = trends.csv_points(spark.createDataFrame([("f", "tea", content)], "file string, keyword string, content string")).orderBy("line_no").collect()
    assert [(r.time, r.value) for r in got] == [("2024-01-07", 45), ("2024-01-14", 0)]


def test_html(spark):
    page = '<html><head><title>A &amp; B</title><meta name="description" content="M"></head><body><nav>skip</nav><article><h1>Head</h1><h2>head</h2><p>Some <b>text</b> here that is long enough to count as a body of text.</p><a href="/x?b=1&amp;a=2#f">l</a><a href="mailto:q">m</a></article></body></html>'
    r = html.scraped(spark.createDataFrame([("http://e.com/d/", page), ("http://f.com", None)], "url string, html string")).withColumn("l", html.links(F.col("html"), F.col("url"))).orderBy("url").collect()
    assert (r[0].title, r[0].meta_description, r[0].headings, r[0].l, r[0].success) == ("A & B", "M", ["Head"], ["http://e.com/x?a=2&b=1"], True)
    assert "skip" not in r[0].body and "Some text here" in r[0].body and not r[1].success


def test_plans(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"Best tea guide {i % 3}", "buy tea online now", "tea.com", "") for i in range(12)], "row_idx long, title string, snippet string, displayed_link string, rich_snippet string")
    related = spark.createDataFrame([(0, "green tea", "related_search"), (1, "why tea", "people_also_ask")], "row_idx long, related_query string, type string")
    p = profile.build_profile(profile.result_corpus(rows, related))
    sheets = profile.export_sheets(p)
    assert p.tfidf.filter("term = 'tea'").count() == 1 and p.intent.first().intent_type != "undetermined" and sheets["bm25f"].count() > 0
    assert profile.candidate_keywords(p).count() > 5 and not profile.has_partial_data(rows, p.sources).first()[0]
    seen = csvlib.reader(io.StringIO(sinks.csv_bytes(sheets["tfidf"]).decode("utf-8-sig")))
    assert next(seen)[0] == "term"
    keywords = spark.createDataFrame([("tea", "u"), ("cup", "u")], "keyword string, source_url string")
    out = enrichment.run_enrichment(enrichment.Inputs(keywords), stores.Checkpoints(spark, str(tmp_path / "c"), {"a": 1}))
    assert out.count() == 2 and sinks.write_report(sinks.named(out), "r.json", "json", str(tmp_path), "t").endswith("r.json")
    with pytest.raises(sinks.UnsafePath):
        sinks.report_path("../x", str(tmp_path / "outputs"))
    assert sinks.file_suffix(["https://a.b/c", "d"]) == "a_b_c_plus_1"


def test_history_keeps_what_has_no_age(spark):
    from pyspark.sql import functions as F

    from lexmill import stores

    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    rows = [(1, "run", "2024-01-31 00:00:00", None), (2, "run", "2023-01-01 00:00:00", None), (3, "run", "no time", None), (4, None, None, None), (5, "cache", "2023-01-01 00:00:00", "2024-03-01 00:00:00"), (6, "cache", "2024-01-31 00:00:00", "2024-01-31 12:00:00"), (7, "cache", "2023-01-01 00:00:00", None), (8, "cache", "2023-01-01 00:00:00", "never")]
    df = spark.createDataFrame(rows, "seq long, record_type string, created_at string, expires_at string")
    left = lambda d: {r.seq for r in d.collect()}
    assert left(stores.trimmed_history(df, now, 30)) == {1, 3, 4, 5, 7, 8}
    assert left(stores.trimmed_history(df, now, 0)) == left(stores.trimmed_history(df, now, -1)) == set(range(1, 9))
    assert left(stores.trimmed_history(df, now, 30, 1)) == {1, 5, 7, 8}
    assert left(stores.trimmed_history(df.limit(0), now, 30)) == set()


def test_hits_and_lifetimes(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    from lexmill import stores

    made = dt.datetime(2024, 1, 1)
    kinds = ["serp", "ads", "llm_extract", "llm_generate", "crawl", "math", "trends", "model_fetch", "other", None]
    rows = stores.with_expiry(spark.createDataFrame([(f"k{i}", k, made, i) for i, k in enumerate(kinds)], "cache_key string, kind string, created_at timestamp, seq long"))
    hours = {r.kind: (r.expires_at - made).total_seconds() / 3600 for r in rows.collect()}
    assert hours == {"serp": 168, "ads": 168, "llm_extract": 720, "llm_generate": 720, "crawl": 168, "math": 168, "trends": 24, "model_fetch": 720, "other": 168, None: 168}
    now = F.lit("2024-01-03 00:00:00").cast("timestamp")
    reads = spark.createDataFrame([("k0",), ("k0",), ("k6",), ("k9",), ("none",), (None,)], "cache_key string")
    once = stores.with_hits(rows, reads, now)
    assert {r.cache_key: r.hits for r in once.collect() if r.hits} == {"k0": 2, "k9": 1}
    twice = stores.with_hits(once, reads, now)
    assert {r.kind: (r.records, r.expired, r.hits) for r in stores.cache_stats(twice, now).collect() if r.kind in ("serp", "trends", "unknown")} == {"serp": (1, 0, 4), "trends": (1, 1, 0), "unknown": (1, 0, 2)}


def test_matches_of_all_sources_as_in_pairs(spark):
    from lexmill.operators import keyed

    serp = [(k, u, p, i) for i, (k, u, p) in enumerate([("a", "https://www.x.com/p/", "3"), ("a", "http://x.com/q", None), ("a", "https://y.org/", "1"), ("b", "https://sub.x.com/p", "2"), ("b", "https://x.com/p?z=1", "9"), ("b", "", "1"), ("c", None, "1")])]
    sources = ["https://x.com/p", " https://x.com/p ", "https://x.com/q", "y.org", "https://none.net", "", None]
    s = spark.createDataFrame(serp, "norm_kw string, url string, position string, row_idx long")
    src = spark.createDataFrame([(x,) for x in sources], "source_url string")
    got = {tuple(r) for r in keyed.match_index_of(s, src).collect()}
    want = {tuple(r) for r in keyed.match_index(s.crossJoin(src)).collect()}
    assert got == want and len(got) >= 5
