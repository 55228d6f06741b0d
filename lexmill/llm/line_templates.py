"""Line dedup by a fixed-depth tree of log templates, in DataFrame functions only.

A line is parsed by its token count and its first depth tokens; tokens with a digit count as variable from the start. That is
its leaf. The places after the first depth are cut into runs, a fixed grid for each token count, and a template of the line
is what stays if the tokens of two runs are fields: lines of a leaf that differ in no other places share a template. The runs
are as wide as leaves similarity of all places fixed. The line itself is a template too. A template recurs if so many
documents have a line of it; its lines are dropped from all of them but the first.

What a template takes in depends on its lines alone, never on how many others the leaf holds: more documents can only add
support to a template, so they never bring a dropped line back.

Only hashes of lines, of 64 bits, are shuffled. Texts are fetched for one place of each different line of the leaves with
unlike lines and joined with the verdicts; where the row keys or verdicts are few, they go to the texts instead. Lines,
leaves and templates that very many rows share are counted in each task first, or dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._session import FOLDERS, discard, release, staged
from ._skew import salted_join

#: White space inside a line, and what stands for a variable field.
SPACE, FIELD = "[ \t\x0b\f\r]+", "<*>"
#: Row keys and line numbers that are broadcast at most, some 30 MB; beyond that texts are shuffled to them.
MOST_BROADCAST = 1_000_000


def line_tokens(line: Column) -> Column:
    """Tokens of a line, those with a digit as FIELD; a line of nothing else is no template and keeps its digits."""
    tokens = F.filter(F.split(line, SPACE), lambda t: t != "")
    masked = F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t))
    return F.when(line.rlike("[0-9]") & F.exists(tokens, lambda t: ~t.rlike("[0-9]")), masked).otherwise(tokens)


def hidden_places(words: Column, similarity: float) -> Column:
    """Places of a line of so many tokens that may be fields: what similarity, in whole percent, leaves."""
    return F.floor((100 - round(100 * similarity)) * words / 100).cast("int")


def _templates(leaf: Column, tokens: Column, depth: int, similarity: float) -> Column:
    """Hashes of a line's templates, each with two runs of its places as fields (one, where only one place may be a field)."""
    may = hidden_places(F.size(tokens), similarity)
    wide = F.greatest(F.lit(1), F.floor(may / 2)).cast("int")
    n = F.ceil((F.size(tokens) - depth) / wide).cast("int")
    runs = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.xxhash64(j, F.slice(tokens, depth + 1 + j * wide, wide)))
    # The one-element arrays keep the hashes from being made again for each template.
    made = F.transform(F.array(runs), lambda h: F.struct(h.alias("h"), F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x)).alias("all")))
    one = lambda s: F.transform(F.sequence(F.lit(0), n - 1), lambda a: F.xxhash64(leaf, a, a, s["all"].bitwiseXOR(F.get(s["h"], a))))
    two = lambda s: F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda a: F.transform(F.sequence(a + 1, F.greatest(n - 1, a + 1)), lambda b: F.xxhash64(leaf, a, b, s["all"].bitwiseXOR(F.get(s["h"], a)).bitwiseXOR(F.get(s["h"], b))))))
    return F.flatten(F.transform(made, lambda s: F.when((may < 2) | (n < 2), one(s)).otherwise(two(s))))


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """docs: rk, doc_id, text. Returns rk, doc_id, line_no, words, leaf and line (a hash of all tokens, which also tells the leaf)."""
    lines = docs.select("rk", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    # The one-element generator keeps the tokens from being made again for each use.
    lines = lines.select("rk", "doc_id", "line_no", F.explode(F.array(line_tokens(F.col("raw")))).alias("tokens")).filter(F.size("tokens") > 0)
    leaf = F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth))
    return lines.select("rk", "doc_id", "line_no", F.size("tokens").alias("words"), leaf.alias("leaf"), F.xxhash64("tokens").alias("line"))


def recurring_lines(docs: DataFrame, lines: DataFrame, min_docs: int, depth: int, similarity: float, long: int | None) -> DataFrame:
    """line and home (the row key of the first document of a template of the line that recurs), for lines with such a template.

    docs: rk, text; lines: _lines(). Of the first documents of several templates home is the first."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk")
    often = lambda n, words: (n >= min_docs) | (F.lit(False) if long is None else (n > 1) & (words > long))
    # A line that very many documents have, or one document very often, is one row for each document here, then one row.
    held = lines.groupBy("line", "rk").agg(F.first("doc_id").alias("doc_id"), F.first("leaf").alias("leaf"), F.first("words").alias("words"), F.min("line_no").alias("line_no"))
    kinds = held.groupBy("line").agg(F.count(F.lit(1)).alias("docs"), F.min(order).alias("first"), F.max(order).alias("last"), F.first("leaf").alias("leaf"), F.first("words").alias("words"), F.min(F.struct("rk", "line_no")).alias("at"))
    kinds = staged(kinds, "kinds")
    same = kinds.filter(often(F.col("docs"), F.col("words"))).select("line", "first")
    # Templates of one place of each different line, for leaves with two of them at least.
    open_ = kinds.filter((F.col("words") > depth) & (hidden_places(F.col("words"), similarity) > 0))
    mixed = open_.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows"))
    unlike = salted_join(open_, mixed.filter("rows > 1").select("leaf"), "leaf", ["line"], mixed)
    wanted = staged(unlike.groupBy(F.col("at.rk").alias("rk")).agg(F.collect_list(F.struct(F.col("at.line_no").alias("line_no"), "leaf", "line", "words", "docs", "first", "last")).alias("picks")), "wanted")
    texts = docs.join(F.broadcast(wanted.select("rk")), "rk", "left_semi") if wanted.count() <= MOST_BROADCAST else docs
    # Repeated rows share rk; one of them is enough.
    picked = wanted.join(texts.dropDuplicates(["rk"]), "rk").withColumn("all", F.split("text", "\n", -1)).select("all", F.explode("picks").alias("p"))
    picked = picked.select("p.*", F.explode(F.array(line_tokens(F.get("all", F.col("p.line_no"))))).alias("tokens")).filter(F.exists("tokens", lambda t: ~t.rlike("[0-9]") & (t != FIELD)))
    made = staged(picked.select("line", "words", "docs", "first", "last", F.explode(_templates(F.col("leaf"), F.col("tokens"), depth, similarity)).alias("template")), "templates")
    # Of a line in fewer documents than min_docs, at most 3, the first and the last are all: so documents are counted exactly.
    found = made.select("template", "words", "docs", F.explode(F.array("first", "last")).alias("doc"))
    found = found.groupBy("template", "doc").agg(F.max("docs").alias("docs"), F.first("words").alias("words"))
    found = found.groupBy("template").agg(F.greatest(F.count(F.lit(1)), F.max("docs")).alias("docs"), F.min("doc").alias("first"), F.first("words").alias("words"))
    alike = salted_join(made.select("line", "template"), found.filter(often(F.col("docs"), F.col("words"))).select("template", "first"), "template", ["line"]).select("line", "first")
    return same.union(alike).groupBy("line").agg(F.min("first").alias("first")).select("line", F.col("first.rk").alias("home"))


def drop_templates(docs: DataFrame, min_docs: int = 3, depth: int = 4, similarity: float = 0.7, most: float = 1.0, copies: float | None = None, long: int | None = 50) -> DataFrame:
    """Texts without the lines of which a template recurs in min_docs documents (2 or 3) or more; the template's first document
    (least doc_id) keeps its lines.

    docs: doc_id, text and any other columns, which stay. Returns all of docs' columns, text cleaned, with n_lines (lines
    before) and n_dropped; a column of docs with one of these names is replaced. Lines are parted by \\n and put together with
    it again; blank lines are never dropped. long: lines of more tokens than this are passages, which go from two documents on
    (None: as others). most: a text of which more than this share of words would go is a copy rather than a page with
    boilerplate, and is left whole; copies: only if with one other document, the first of its templates, it shares lines of at
    least this share of the words of both.
    Null text stays null, with no lines. Rows of equal doc_id and text are one document; null doc_ids come last. An empty table
    gives an empty result.
    """
    if min_docs not in (2, 3):
        raise ValueError("min_docs must be 2 or 3")
    docs = docs.drop("n_lines", "n_dropped", "_rk")
    docs = docs.withColumn("text", F.col("text").cast("string")).withColumn("_rk", F.xxhash64(F.col("doc_id").cast("string"), F.col("text")))
    texts = docs.filter(F.col("text").isNotNull()).select(F.col("_rk").alias("rk"), "doc_id", "text")
    lines = staged(_lines(texts, depth), "lines")
    since = len(FOLDERS)
    homes = staged(recurring_lines(texts.select("rk", "text"), lines, min_docs, depth, similarity, long), "homes")
    release(docs.sparkSession, since, (homes._folder,))
    gone = salted_join(lines.select("rk", "line_no", "words", "line"), homes, "line", ["rk"])
    away = gone.filter("rk <> home").select("rk", "line_no", "words", "home").distinct()
    gone = away.groupBy("rk").agg(F.collect_list("line_no").alias("gone"), F.sum("words").alias("out"))
    if most < 1:
        total = staged(lines.select("rk", "line_no", "words").distinct().groupBy("rk").agg(F.sum("words").alias("words")), "words")
        gone = gone.join(total, "rk").withColumn("whole", F.col("out") > most * F.col("words"))
        if copies is not None:
            # Words that a text has in lines of one document, its own words and that document's.
            shared = staged(away.groupBy("rk", "home").agg(F.sum("words").alias("shared")), "shared")
            shared = salted_join(shared, total.select(F.col("rk").alias("home"), F.col("words").alias("theirs")), "home", ["rk"]).join(total, "rk")
            near = shared.filter(F.col("shared") >= copies * (F.col("words") + F.col("theirs") - F.col("shared"))).select("rk", F.lit(True).alias("near")).distinct()
            gone = gone.join(near, "rk", "left").withColumn("whole", F.col("whole") & F.coalesce("near", F.lit(False)))
        gone = gone.filter("not whole")
    gone = staged(gone.select(F.col("rk").alias("_rk"), "gone"), "gone")
    discard(lines, homes)
    size = gone.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()[0]
    split = F.split("text", "\n", -1)
    out = docs.join(F.broadcast(gone) if size <= MOST_BROADCAST else gone, "_rk", "left")
    # The numbers that stay are found once, and the text is split once: the work grows with its lines.
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone"))
    kept = F.get(F.transform(F.array(split), lambda all_: F.array_join(F.transform(stay, lambda i: F.get(all_, i)), "\n")), F.lit(0))
    drops = F.col("gone").isNotNull()
    out = out.withColumn("n_lines", F.coalesce(F.when(F.col("text").isNotNull(), F.size(split)), F.lit(0)).cast("long")).withColumn("n_dropped", F.coalesce(F.when(drops, F.size("gone")), F.lit(0)).cast("long"))
    return out.withColumn("text", F.when(drops, kept).otherwise(F.col("text"))).drop("_rk", "gone")


def oracle(min_docs: int = 3, depth: int = 4, similarity: float = 0.7, most: float = 1.0, long: int = 50, documents: str = "documents") -> str:
    """The same for tables of different doc_ids, as DuckDB SQL: doc_id, n_lines, n_dropped, text."""
    raw = "list_filter(regexp_split_to_array(raw, '[ \\t\\x0B\\f\\r]+'), lambda t: t <> '')"
    plain = "len(list_filter(words_, lambda t: NOT regexp_matches(t, '[0-9]'))) > 0"
    return f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM {documents}),
split AS (SELECT doc_id, line_no, {raw} AS words_ FROM lines),
tokens AS (SELECT doc_id, line_no, {plain} AS plain, CASE WHEN {plain} THEN list_transform(words_, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) ELSE words_ END AS tokens FROM split),
leaves AS (SELECT doc_id, line_no, plain, tokens, len(tokens) AS words, array_to_string(tokens, ' ') AS line FROM tokens WHERE len(tokens) > 0),
kinds AS (SELECT DISTINCT line, plain, tokens, words, ({100 - round(100 * similarity)} * words) // 100 AS may FROM leaves),
sized AS (SELECT *, greatest(1, may // 2) AS wide FROM kinds WHERE words > {depth} AND may > 0 AND plain),
runs AS (SELECT *, (words - {depth} + wide - 1) // wide AS n FROM sized),
one AS (SELECT *, unnest(range(n)) AS a FROM runs),
two AS (SELECT *, unnest(CASE WHEN may < 2 OR n < 2 THEN [a] ELSE range(a + 1, n) END) AS b FROM one),
made AS (SELECT line, words || ' ' || a || ' ' || b || ' ' || array_to_string(list_transform(tokens, lambda t, i: CASE WHEN i > {depth} AND (i - 1 - {depth}) // wide IN (a, b) THEN '<*>' ELSE t END), ' ') AS template FROM two
  UNION ALL SELECT line, 'line ' || line FROM kinds),
held AS (SELECT template, l.line, l.doc_id, l.words FROM made m JOIN (SELECT DISTINCT line, doc_id, words FROM leaves) l USING (line)),
often AS (SELECT template, min(doc_id) AS home FROM held GROUP BY template HAVING count(DISTINCT doc_id) >= {min_docs} OR (any_value(words) > {long} AND count(DISTINCT doc_id) > 1)),
homes AS (SELECT line, min(home) AS home FROM made JOIN often USING (template) GROUP BY line),
gone AS (SELECT t.doc_id, t.line_no, t.words FROM leaves t JOIN homes h USING (line) WHERE t.doc_id <> h.home),
share AS (SELECT doc_id, sum(words) AS words FROM leaves GROUP BY doc_id),
out AS (SELECT g.doc_id, list(g.line_no) AS gone FROM gone g GROUP BY g.doc_id HAVING sum(g.words) <= {most} * (SELECT s.words FROM share s WHERE s.doc_id = g.doc_id))
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(o.gone), 0) AS BIGINT) AS n_dropped,
  CASE WHEN o.gone IS NULL THEN d.text ELSE array_to_string(list_transform(list_filter(range(len(string_split(d.text, chr(10)))), lambda i: NOT list_contains(o.gone, i)), lambda i: string_split(d.text, chr(10))[i + 1]), chr(10)) END AS text
FROM {documents} d LEFT JOIN out o USING (doc_id)
""".strip()
