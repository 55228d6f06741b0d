"""Quality of generated text: sections, rubrics and their roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains, contains_words, density, forbidden_phrases, tokens

ELEMENTS = ("META_TITLE", "META_DESCRIPTION", "H1", "DESCRIPTION")
CALLS = ("купить", "замовити", "buy", "order", "shop")
HEADER = r"(?i)^(\*\*)?(META_TITLE|META_DESCRIPTION|H1|DESCRIPTION):(\*\*)?"
#: Corpus field and weight of each section. Fixed values.
SECTION_FIELDS = {"META_TITLE": ("page_title", 3.0), "META_DESCRIPTION": ("meta_description", 1.5), "H1": ("h1", 2.5), "DESCRIPTION": ("body_text", 1.0)}


def sections(text: Column) -> Column:
    """A map from ELEMENTS to their text, empty if missing. A line NAME: (or **NAME:**) begins a section, of repeated
    sections the last one with content counts; without any such line, title, description and h1 are taken from HTML or markdown."""
    raw = F.coalesce(text, F.lit(""))
    lines = F.transform(F.split(raw, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    plain = r"(?i)^(\*\*(META_TITLE|META_DESCRIPTION|H1|DESCRIPTION):\*\*|(META_TITLE|META_DESCRIPTION|H1|DESCRIPTION):)"
    marked = F.transform(lines, lambda x: F.when(x.rlike(plain), F.struct(F.upper(F.regexp_extract(x, HEADER, 2)).alias("name"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("line"))).otherwise(F.struct(F.lit(None).cast("string").alias("name"), x.alias("line"))))
    kind = "struct<name:string,done:map<string,string>,now:array<string>>"
    first = F.expr(f"cast(struct(cast(null as string), map(), array()) as {kind})")
    put = lambda a: F.when(a["name"].isNotNull() & (F.size(a["now"]) > 0), F.map_concat(F.map_filter(a["done"], lambda k, v: k != a["name"]), F.create_map(a["name"], F.trim(F.array_join(a["now"], "\n"))))).otherwise(a["done"])
    step = lambda a, x: F.when(x["name"].isNotNull(), F.struct(x["name"].alias("name"), put(a).alias("done"), F.when(x["line"] != "", F.array(x["line"])).otherwise(F.array().cast("array<string>")).alias("now"))).otherwise(F.struct(a["name"].alias("name"), a["done"].alias("done"), F.when(a["name"].isNotNull() & (x["line"] != ""), F.concat(a["now"], F.array(x["line"]))).otherwise(a["now"]).alias("now")))
    done = F.aggregate(marked, first, lambda a, x: step(a, x).cast(kind), lambda a: put(a))
    grab = lambda pattern, g=1: F.trim(F.regexp_extract(raw, pattern, g))
    html = F.create_map(F.lit("META_TITLE"), grab(r"(?is)<title>(.*?)</title>"), F.lit("META_DESCRIPTION"), grab(r'(?i)<meta\s+name="description"\s+content="([^"]*)?"'), F.lit("H1"), F.when(raw.rlike(r"(?is)<h1>.*?</h1>"), grab(r"(?is)<h1>(.*?)</h1>")).otherwise(grab(r"(?m)^#\s+(.+)$")), F.lit("DESCRIPTION"), F.lit(""))
    found = F.map_from_entries(F.transform(F.array(*map(F.lit, ELEMENTS)), lambda e: F.struct(e, F.coalesce(F.try_element_at(done, e), F.lit("")))))
    return F.when(F.exists(marked, lambda x: x["name"].isNotNull()), found).otherwise(html)


def score_elements(texts: DataFrame, wide: bool = False, terms_limit: int = 50) -> DataFrame:
    """texts: text_id, text, keyword, top_ngrams (array), meta_title, tfidf_overlap, cooccurrence_coverage. One row for each text and
    element: element, element_text, score (100 less deductions, 0 at least), issues, keyword_coverage, length_compliant,
    primary_keyword_present. wide: words are compared, not substrings."""
    has = contains_words if wide else contains
    rows = texts.withColumn("all", F.coalesce("text", F.lit(""))).withColumn("parts", sections(F.col("text")))
    rows = rows.withColumn("keyword", F.coalesce("keyword", F.lit(""))).withColumn("terms", F.slice(F.coalesce("top_ngrams", F.array().cast("array<string>")), 1, terms_limit))
    rows = rows.withColumn("density", density(tokens("all"), F.col("keyword"))).withColumn("weak", forbidden_phrases(F.col("all")))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, ELEMENTS))).alias("element")).withColumn("element_text", F.element_at("parts", F.col("element")))
    t, k, n = F.col("element_text"), F.col("keyword"), F.length("element_text")
    rows = rows.withColumn("covered", F.size(F.filter("terms", lambda g: has(t, g)))).withColumn("present", has(t, k))
    asked = k != ""
    is_ = lambda e: F.col("element") == e
    overlap, company = F.coalesce("tfidf_overlap", F.lit(0.0)), F.coalesce("cooccurrence_coverage", F.lit(0.0))
    ladder = [
        (is_("META_TITLE") & (n < 50), "meta_title_too_short", 20), (is_("META_TITLE") & (n > 60), "meta_title_too_long", 10),
        (is_("META_TITLE") & asked & ~has(F.substring(t, 1, 30), k), "meta_title_keyword_not_at_start", 15), (is_("META_TITLE") & (F.col("covered") < 2), "meta_title_low_ngram_coverage", 10),
        (is_("META_DESCRIPTION") & (n < 150), "meta_desc_too_short", 15), (is_("META_DESCRIPTION") & (n > 160), "meta_desc_too_long", 10),
        (is_("META_DESCRIPTION") & asked & ~F.col("present"), "meta_desc_missing_keyword", 15), (is_("META_DESCRIPTION") & ~F.lower(t).rlike("|".join(CALLS)), "meta_desc_no_cta", 10),
        (is_("H1") & (n < 30), "h1_too_short", 15), (is_("H1") & (n > 70), "h1_too_long", 10), (is_("H1") & asked & ~F.col("present"), "h1_missing_keyword", 20),
        (is_("H1") & (F.coalesce("meta_title", F.lit("")) != "") & (F.trim(t) == F.trim("meta_title")), "h1_duplicates_title", 15),
        (is_("DESCRIPTION") & (n < 500), "description_too_short", 20), (is_("DESCRIPTION") & (overlap < 0.3), "description_low_tfidf_overlap", 15),
        (is_("DESCRIPTION") & (overlap > 0.8), "description_too_much_tfidf_overlap", 10), (is_("DESCRIPTION") & (company < 0.5), "description_low_cooccurrence_coverage", 15),
        (is_("DESCRIPTION") & (F.col("density") > 7), "description_keyword_stuffing", 20),
    ]
    found = F.filter(F.array(*(F.when(c, F.struct(F.lit(name).alias("issue"), F.lit(float(cost)).alias("cost"))) for c, name, cost in ladder)), F.isnotnull)
    weak = F.when(is_("DESCRIPTION"), F.transform("weak", lambda p: F.struct(F.concat(F.lit("forbidden_phrase_"), p).alias("issue"), F.lit(5.0).alias("cost")))).otherwise(F.expr("cast(array() as array<struct<issue:string,cost:double>>)"))
    rows = rows.withColumn("found", F.concat(found, weak))
    fits = F.when(is_("META_TITLE"), n.between(50, 60)).when(is_("META_DESCRIPTION"), n.between(150, 160)).when(is_("H1"), n.between(30, 70)).otherwise(n >= 500)
    return rows.select("text_id", "element", "element_text", F.greatest(F.lit(0.0), 100.0 - F.aggregate("found", F.lit(0.0), lambda a, x: a + x["cost"])).alias("score"), F.transform("found", lambda x: x["issue"]).alias("issues"), F.when(F.size("terms") > 0, F.col("covered") / F.size("terms")).otherwise(0.0).alias("keyword_coverage"), fits.alias("length_compliant"), (asked & F.col("present")).alias("primary_keyword_present"))


def quality_report(scores: DataFrame) -> DataFrame:
    """text_id, overall (mean of its elements), status (Good from 70, Fair from 50, else Poor), compliant, suggestions (five issues)."""
    out = scores.groupBy("text_id").agg(F.avg("score").alias("overall"), F.count_if("length_compliant").alias("compliant"), F.sort_array(F.collect_list(F.struct(F.array_position(F.array(*map(F.lit, ELEMENTS)), F.col("element")).alias("i"), "issues"))).alias("l"))
    return out.select("text_id", "overall", F.when(F.col("overall") >= 70, "Good").when(F.col("overall") >= 50, "Fair").otherwise("Poor").alias("status"), "compliant", F.slice(F.flatten(F.transform("l", lambda x: x["issues"])), 1, 5).alias("suggestions"))
