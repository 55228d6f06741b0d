"""Search result payloads of several providers, as tables.

Fetching is not done here: payloads come as rows (keyword, provider, payload), payload being the provider's JSON text. Providers
differ in the names of fields only, which are configuration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rich_snippet
from ..operators.signals import first_rows

#: Where a provider's payload has its parts. Organic, related searches, questions, knowledge graph.
PROVIDERS = {
    "serper": ("organic", "relatedSearches", "peopleAlsoAsk", "knowledgeGraph"),
    "serpapi": ("organic_results", "related_searches", "related_questions", "knowledge_graph"),
    "searchapi": ("organic_results", "related_searches", "people_also_ask", "knowledge_graph"),
    "zenserp": ("organic", "related_searches", "questions", None),
    "scraperapi": ("organic_results", "related_searches", None, None),
    "brave": ("results", None, None, None),
    "serpstack": ("organic_results", None, None, None),
    "scaleserp": ("organic_results", "related_searches", None, "knowledge_graph"),
    "valueserp": ("organic_results", "related_searches", None, "knowledge_graph"),
}
TITLE, URL, SNIPPET = ("title",), ("link", "url"), ("snippet", "description")
DISPLAYED = ("displayed_link", "displayedLink", "display_url", "displayUrl")
RICH = ("richSnippet", "rich_snippet", "snippet_extended", "structured_snippet", "richSnippets", "rich_snippets")


def first_text(item: Column, names: tuple[str, ...]) -> Column:
    """The first of the fields that isn't blank, trimmed, with \\uXXXX written out; "" if all are."""
    return decoded(F.coalesce(*(F.nullif(F.trim(F.try_variant_get(item, f"$.{n}", "string")), F.lit("")) for n in names), F.lit("")))


def decoded(text: Column) -> Column:
    """Literal \\uXXXX escapes as characters; a text with a broken one stays as it is."""
    quoted = F.concat(F.lit('{"x":"'), F.regexp_replace(F.regexp_replace(text, '"', '\\\\\\\\"'), r"\\(?!u[0-9a-fA-F]{4}|\")", r"\\\\\\\\"), F.lit('"}'))
    return F.when(text.rlike(r"\\u[0-9a-fA-F]{4}"), F.coalesce(F.get_json_object(quoted, "$.x"), text)).otherwise(text)


def _part(kind: int) -> Column:
    """The array of one part of the payload, by the row's provider."""
    out = F.lit(None).cast("array<variant>")
    for name, keys in PROVIDERS.items():
        if keys[kind]:
            out = F.when(F.col("provider") == name, F.try_variant_get("v", f"$.{keys[kind]}", "array<variant>")).otherwise(out)
    return out


def organic_results(payloads: DataFrame, most: int | None = None) -> DataFrame:
    """keyword, provider, page, position, title, url, snippet, displayed_link, rich_snippet. payloads may have page (0 if not); pages are put
    together in order, each page's first mention of a URL counts, and most rows of a keyword stay. A missing position is the place in its page."""
    rows = payloads.withColumn("v", F.try_parse_json("payload")).withColumn("page", F.col("page") if "page" in payloads.columns else F.lit(0))
    rows = rows.select("keyword", "provider", "page", F.posexplode(_part(0)).alias("i", "item"))
    rich = F.coalesce(*(F.try_variant_get("item", f"$.{n}", "map<string,string>") for n in RICH))
    place = F.coalesce(F.try_variant_get("item", "$.position", "int"), F.try_variant_get("item", "$.rank", "int"))
    rows = rows.select("keyword", "provider", "page", "i", F.when(place > 0, place).otherwise(F.col("i") + 1).alias("position"), first_text(F.col("item"), TITLE).alias("title"), first_text(F.col("item"), URL).alias("url"), first_text(F.col("item"), SNIPPET).alias("snippet"), first_text(F.col("item"), DISPLAYED).alias("displayed_link"), F.coalesce(rich_snippet(rich), F.lit("")).alias("rich_snippet"))
    if most is not None:
        rows = first_rows(rows, ["keyword", "provider", "url"], ["page", "i"])
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("keyword", "provider").orderBy("page", "i"))).filter(F.col("_k") <= most).drop("_k")
    return rows


def related_queries(payloads: DataFrame) -> DataFrame:
    """keyword, related_query, type: related_search (texts or objects) and people_also_ask, in the payload's order."""
    rows = payloads.withColumn("v", F.try_parse_json("payload"))
    related = rows.select("keyword", F.posexplode(_part(1)).alias("i", "item")).select("keyword", "i", F.when(F.schema_of_variant("item") == "STRING", F.trim(F.try_variant_get("item", "$", "string"))).otherwise(first_text(F.col("item"), ("query", "title", "text", "search"))).alias("related_query"), F.lit("related_search").alias("type"))
    asked = rows.select("keyword", F.posexplode(_part(2)).alias("i", "item")).select("keyword", "i", first_text(F.col("item"), ("question", "title")).alias("related_query"), F.lit("people_also_ask").alias("type"))
    return related.unionByName(asked).filter("related_query <> ''")


def knowledge_graphs(payloads: DataFrame) -> DataFrame:
    """keyword, title, type, description of the payloads that have one."""
    item = F.lit(None).cast("variant")
    for name, keys in PROVIDERS.items():
        if keys[3]:
            item = F.when(F.col("provider") == name, F.try_variant_get("v", f"$.{keys[3]}", "variant")).otherwise(item)
    rows = payloads.withColumn("v", F.try_parse_json("payload")).withColumn("g", item).filter("g is not null")
    rows = rows.select("keyword", first_text(F.col("g"), ("title", "name")).alias("title"), first_text(F.col("g"), ("type", "subtitle", "category")).alias("type"), first_text(F.col("g"), ("description", "snippet")).alias("description"))
    return rows.filter("title <> '' or type <> '' or description <> ''")


def organic_report(rows: DataFrame) -> DataFrame:
    """Lines of a ;-separated organic report (keyword, line_no, line; the header at the least line_no) as results: the domain is the title."""
    heads = rows.groupBy("keyword").agg(F.transform(F.split(F.min_by("line", "line_no"), ";"), lambda c: F.lower(F.trim(c))).alias("head"), F.min("line_no").alias("first"))
    cells = rows.join(heads, "keyword").filter("line_no > first").withColumn("cell", F.map_from_arrays("head", F.slice(F.concat(F.split("line", ";"), F.array_repeat(F.lit(""), F.size("head"))), 1, F.size("head"))))
    of = lambda *names: F.coalesce(*(F.nullif(F.trim(F.try_element_at("cell", F.lit(n))), F.lit("")) for n in names), F.lit(""))
    return cells.select("keyword", F.coalesce(of("position", "po").try_cast("int"), (F.col("line_no") - F.col("first")).cast("int")).alias("position"), of("domain", "dn").alias("title"), of("url", "ur").alias("url"), of("serp features", "serp features by keyword").alias("features"))
