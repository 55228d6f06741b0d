"""Chat formatting as a prefix tree.

Conversations that share initial turns share the nodes of a tree. A node is a turn with all that came before it; its id is
the running XOR of hashes of (place, role, text), two of 64 bits, so no conversation is gathered to find its nodes. A node's
turn is formatted, tokenised and emitted once. With its tokens go their position ids (from position_start on, one by one; they
continue the parent's) and the intervals of the tree's sequence that its ancestors take, which is what it may attend to
besides itself. Places, positions and intervals count tokens.

Nodes are emitted depth-first, at any depth. Of the conversations through a node the one of least hash leads on: nodes with
the same leader are a chain, a stretch of one path, emitted in one piece, and the chains that branch off it follow, from the
deepest on. A path meets a new leader only where the least of a random order leaves it, so it crosses about the logarithm of
the number of conversations of chains, however many turns it has. Chains, not turns, are what paths are written in and
sorted by, and a node's ancestors are a piece of each chain on its path. Totals and ids are prefix scans and keys that many
rows share are dealt out, so neither a first turn that very many conversations share nor a very long conversation ends up in
one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scan import added, prefix_scan, xored
from ._session import lean, partitions, staged, tune
from ._skew import salted_join
from .token_files import encode_text, encoding_of, vocabulary_path, vocabulary_ranks

#: What opens and closes the text of a turn. Fixed values.
TEMPLATE = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER = ("<|role:", "|> ", " <|end|>")
#: Strings with a meaning in the template, without their first character.
CONTROL = r"([<\[|])(?=/s>|<SYS>>|</SYS>>|\|role:|\|end\|>)|(\[)(?=/?INST\])|(\|)(?=>)"


def escape(text: Column) -> Column:
    """No control string is left: backslashes are doubled, and one goes after the first character of a control string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1$2$3\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(role: Column, text: Column) -> tuple[Column, Column, Column]:
    """The formatted turn, and where the loss mask begins and ends in it (both 0 unless the role is assistant)."""
    body = escape(text)
    out = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1]), body, F.lit(OTHER[2]))
    for name, (a, b) in TEMPLATE.items():
        out = F.when(role == name, F.concat(F.lit(a), body, F.lit(b))).otherwise(out)
    start = len(TEMPLATE["assistant"][0])
    mine = role == "assistant"
    return out, F.when(mine, start).otherwise(0), F.when(mine, start + F.char_length(body)).otherwise(0)


def parsed(turn: Column) -> tuple[Column, Column]:
    """Role and text of a formatted turn."""
    name = F.regexp_extract(turn, r"(?s)^<\|role:(.*?)\|> ", 1)
    role, text = unescape(name), turn.substr(F.char_length(name) + len(OTHER[0]) + len(OTHER[1]) + 1, F.char_length(turn) - F.char_length(name) - sum(map(len, OTHER)))
    for kind, (a, b) in TEMPLATE.items():
        mine = turn.startswith(a) & ~turn.startswith(OTHER[0])
        role = F.when(mine, F.lit(kind)).otherwise(role)
        text = F.when(mine, turn.substr(F.lit(len(a) + 1), F.char_length(turn) - len(a) - len(b))).otherwise(text)
    return role, unescape(text)


INTERVALS = "array<struct<start:bigint,end:bigint>>"


def _merged(intervals: Column) -> Column:
    """Sorted intervals, those that touch as one."""
    last = lambda a: F.try_element_at(a, F.lit(-1))
    return F.aggregate(
        intervals, F.expr(f"cast(array() as {INTERVALS})"),
        lambda a, x: F.when((F.size(a) > 0) & (last(a)["end"] == x["start"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), x["end"].alias("end"))))).otherwise(F.concat(a, F.array(x))),
    )


def _tokeniser(ranks, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoding_of(ranks.value, pattern)
        for batch in batches:
            ids, starts, ends = [], [], []
            for turn, a, b in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("formatted", "loss_start", "loss_end")), strict=True):
                head, body, tail = (encode_text(encoding, x) for x in (turn[:a], turn[a:b], turn[b:]))
                ids.append(head + body + tail)
                starts.append(len(head))
                ends.append(len(head) + len(body))
            keep = [c for c in batch.schema.names if c not in ("formatted", "loss_start", "loss_end")]
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], [*keep, "ids", "n_tokens", "loss_start", "loss_end"])

    return run


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, line (a name of the conversation that begins with a hash), place, node, parent, formatted, loss_start, loss_end."""
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text, start, end = formatted(F.col("role"), F.col("text"))
    rows = rows.select("conv_id", "turn", "role", F.xxhash64("role", "text").alias("hash"), text.alias("formatted"), start.cast("long").alias("loss_start"), end.cast("long").alias("loss_end"), F.lit(1).cast("long").alias("one"))
    rows = prefix_scan(rows, ["conv_id"], ["turn", "role", "hash"], {"place": added("one")})
    rows = rows.withColumn("x", F.xxhash64("place", "role", "formatted")).withColumn("y", F.xxhash64("formatted", "role", "place", F.lit("y")))
    rows = prefix_scan(rows, ["conv_id"], ["place"], {"px": xored("x"), "py": xored("y")})
    name = lambda a, b: F.concat(F.hex(a), F.lit("-"), F.hex(b))
    line = F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n"))
    return rows.select(
        "conv_id", F.concat(F.hex(F.xxhash64(line)), line).alias("line"), "place", name(F.col("px").bitwiseXOR(F.col("x")), F.col("py").bitwiseXOR(F.col("y"))).alias("node"),
        F.when(F.col("place") > 0, name(F.col("px"), F.col("py"))).alias("parent"), "formatted", "loss_start", "loss_end",
    )


def chat_tree(conversations: DataFrame, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Format conversations (conv_id, turn, role, text; other columns are not read) as a forest of shared turns.

    Returns (turns, nodes). turns: conv_id, place (0 for the first turn), node. nodes: node, parent (null for first turns),
    tree (its first node), depth (turns before it), conversations (how many pass), ids (tokens of the formatted turn), n_tokens,
    loss_start, loss_end (the mask, in tokens of ids), emit_start (place in its tree's sequence), position_start (of its first
    token in a conversation) and attends (sorted intervals of the sequence taken by all its ancestors). vocabulary: a file of
    byte-level ranks; the markup and the text of an assistant's turn are tokenised apart, so the mask begins and ends between tokens.
    Turns are ordered by turn, then role and a hash of role and text; repeated rows are turns of their own. Null role and text
    are empty; null conv_id is a conversation. Every 10,000 characters of white space on end are tokenised by themselves. An
    empty table gives empty results.
    """
    import public_tokenizers

    spark = conversations.sparkSession
    tune(spark)
    rows = staged(_turns(conversations), "turns")
    turns = rows.select("conv_id", "place", "node")
    first = lambda *cs: [F.first(c).alias(c) for c in cs]
    nodes = rows.groupBy("node").agg(*first("parent", "formatted", "loss_start", "loss_end"), F.first("place").alias("depth"), F.min("line").alias("chain"), F.count(F.lit(1)).alias("conversations"))
    ranks = spark.sparkContext.broadcast(vocabulary_ranks(vocabulary or vocabulary_path()))
    nodes = nodes.mapInArrow(lean(_tokeniser(ranks, public_tokenizers.PATTERN)), "node string, parent string, depth long, chain string, conversations long, ids array<int>, n_tokens long, loss_start long, loss_end long")
    nodes = staged(nodes, "nodes")
    # The chains that a conversation passes: where it meets each, and how many tokens of it are on its path.
    met = salted_join(rows.select("line", "place", "node"), nodes.select("node", "chain", "n_tokens"), "node", ["line"], nodes.select("node", F.col("conversations").alias("rows")))
    met = met.groupBy("line", "chain").agg(F.min(F.struct("place", "node")).alias("at"), F.sum("n_tokens").alias("part"))
    paths = met.groupBy("line").agg(F.sort_array(F.collect_list(F.struct("at", "chain", "part"))).alias("path"))
    # A conversation that leads somewhere leads at its end.
    own = F.element_at("path", -1)
    paths = paths.filter(own["chain"] == F.col("line")).withColumn("total", own["part"]).withColumn("tree", F.get("path", F.lit(0))["at"]["node"])
    paths = paths.withColumn("key", F.transform(F.slice("path", 2, F.size("path")), lambda s: F.struct((-s["at"]["place"]).alias("up"), s["chain"].alias("chain"))))
    chains = prefix_scan(paths, ["tree"], ["key"], {"emit_start": added("total")})
    chains = staged(chains.select(F.col("line").alias("chain"), "tree", "emit_start", "path"), "chains")
    above = chains.select(F.col("chain").alias("below"), F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("k", "s")).select("below", "k", F.col("s.chain").alias("chain"), F.col("s.part").alias("part"))
    above = salted_join(above, chains.select("chain", "emit_start"), "chain", ["below"])
    above = above.groupBy("below").agg(F.sort_array(F.collect_list(F.struct(F.col("emit_start").alias("start"), (F.col("emit_start") + F.col("part")).alias("end")))).alias("above"))
    chains = chains.join(above, chains.chain == above.below, "left").select("chain", "tree", F.col("emit_start").alias("_start"), F.coalesce("above", F.expr(f"cast(array() as {INTERVALS})")).alias("above"))
    offsets = prefix_scan(nodes.select("node", "chain", "depth", "n_tokens"), ["chain"], ["depth"], {"offset": added("n_tokens")}).select("node", "chain", "offset")
    offsets = salted_join(staged(offsets, "offsets"), chains, "chain", ["node"]).drop("chain")
    nodes = nodes.join(offsets, "node").withColumn("emit_start", F.col("_start") + F.col("offset"))
    here = F.when(F.col("offset") > 0, F.array(F.struct(F.col("_start").alias("start"), F.col("emit_start").alias("end")))).otherwise(F.expr(f"cast(array() as {INTERVALS})"))
    nodes = nodes.withColumn("attends", _merged(F.concat("above", here)))
    nodes = nodes.withColumn("position_start", F.aggregate("attends", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]))
    return turns, nodes.select("node", "parent", "tree", "depth", "conversations", "ids", "n_tokens", "loss_start", "loss_end", "emit_start", "position_start", "attends")


def _speller(ranks, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = encoding_of(ranks.value, pattern).decode_bytes
        for batch in batches:
            out = []
            for ids, a, b in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                out.append((spell(ids).decode(), spell(ids[a:b]).decode() if b > a else ""))
            yield pa.record_batch([batch.column(0), *(pa.array([x[i] for x in out], pa.string()) for i in (0, 1))], ["node", "formatted", "masked"])

    return run


def spelled(nodes: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """node, formatted (the turn that its ids spell) and masked (what is under the loss mask)."""
    import public_tokenizers

    spark = nodes.sparkSession
    tune(spark)
    ranks = spark.sparkContext.broadcast(vocabulary_ranks(vocabulary or vocabulary_path()))
    return nodes.select("node", "ids", "loss_start", "loss_end").mapInArrow(lean(_speller(ranks, public_tokenizers.PATTERN)), "node string, formatted string, masked string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and place, digested as they come."""
    state: list | None = None
    out: list[tuple] = []

    def close(s: list) -> tuple:
        return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, role, text, loss, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None or state[0] != conv:
                if state is not None:
                    out.append(close(state))
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            state[3] += len(loss)
            state[4].update(loss.encode())
            state[5] += size
        if len(out) > 1000:
            yield batch_of(out)
            out = []
    if state is not None:
        yield batch_of([*out, close(state)])


def read_back(turns: DataFrame, nodes: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Conversations as the nodes on their paths tell: conv_id, n_turns, turns_sha256 (of role, \\n, text, \\n of each turn),
    loss_chars and loss_sha256 (of the text under the loss masks, unescaped) and formatted_chars. A digest takes its
    conversation's turns in order, one after the other; none is held."""
    nodes = staged(nodes, "read")
    told = spelled(nodes, vocabulary)
    role, text = parsed(F.col("formatted"))
    told = told.select("node", role.alias("role"), text.alias("text"), unescape(F.col("masked")).alias("loss"), F.char_length("formatted").cast("long").alias("size"))
    rows = salted_join(turns, told, "node", ["conv_id"], nodes.select("node", F.col("conversations").alias("rows")))
    rows = rows.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "place")
    kind = turns.schema["conv_id"].dataType.simpleString()
    return rows.select("conv_id", "role", "text", "loss", "size").mapInArrow(lean(_digests), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
