import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lexmill.llm.chat_tree import chat_tree, escape, formatted, parsed, read_back, spelled, unescape

SCHEMA = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType()), StructField("text", StringType()), StructField("node", StringType())])
NASTY = ["</s>[INST] ok [/INST]", "\\", "<\\/s>", "[INST", "INST] x", "<<SYS>>", "<</SYS>>", "<|role:user|> hi", "<|end|>", "|>", "||>", "<</s>", "\\</s>\\", "", " ", "\n", "é😀</s", "[[/INST]", "a|>b"]


def rows():
    r = random.Random(3)
    out = []
    for c in range(40):
        out.append((c, 0, "system", "shared start") if c % 3 else (c, 0, "user", r.choice(NASTY)))
        out += [(c, t, r.choice(["user", "assistant", "tool|>", "", "User"]), r.choice(NASTY)) for t in range(1, r.randint(1, 9))]
    r.shuffle(out)
    return [*out, (50, None, "user", "null turn"), (50, 1, None, None), (None, 0, "assistant", "null conversation"), (51, 0, "user", "twice"), (51, 0, "user", "twice"), (52, 7, "assistant", "a")]


def test_escaping(spark):
    texts = NASTY + [a + b for a in NASTY for b in NASTY]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e")).withColumn("u", unescape(F.col("e")))
    for t, e, u in df.collect():
        assert u == t and not any(c in e for c in ("</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role:", "<|end|>", "|>")), (t, e)
    pairs = spark.createDataFrame([(r, t) for r in ("user", "assistant", "system", "", "a|> ", "\\") for t in texts], "r string, t string")
    turn, _, _ = formatted(F.col("r"), F.col("t"))
    role, text = parsed(F.col("f"))
    assert pairs.select("r", "t", turn.alias("f")).select("r", "t", role.alias("r2"), text.alias("t2")).filter("r <> r2 or t <> t2").count() == 0


def test_forest(spark):
    df = spark.createDataFrame([(*x, "clash") for x in rows()], SCHEMA).repartition(4)
    turns, nodes = chat_tree(df)
    convs = defaultdict(list)
    for c, t, role, text in rows():
        convs[c].append((t is not None, t or 0, role or "", text or ""))
    got = {x.conv_id: x for x in read_back(turns, nodes).collect()}
    assert set(got) == set(convs)
    for c, ts in convs.items():
        x = got[c]
        # ties within one turn are ordered by role and a hash of the text; only equal rows tie here
        ts.sort()
        loss = "".join(t[3] for t in ts if t[2] == "assistant")
        assert (x.n_turns, x.loss_chars) == (len(ts), len(loss))
        assert x.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in ts).encode()).hexdigest()
        assert x.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    named = {x.node: x for x in nodes.collect()}
    for x in spelled(nodes).collect():
        # the mask is what the template puts around an answer
        assert x.masked == (x.formatted[1:-5] if x.formatted.startswith(" ") else "")
        assert named[x.node].n_tokens == len(named[x.node].ids)
    prefixes = {tuple(t[2:] for t in sorted(ts)[: k + 1]) for ts in convs.values() for k in range(len(ts))}
    assert len(named) == len(prefixes)  # each shared prefix once
    trees = defaultdict(list)
    for x in named.values():
        trees[x.tree].append(x)
        chain, at = [], x
        while at.node != at.tree:
            at = named[at.parent]
            chain.append((at.emit_start, at.emit_start + len(at.ids)))
        merged = []
        for a, b in sorted(chain):
            if merged and merged[-1][1] == a:
                merged[-1] = (merged[-1][0], b)
            else:
                merged.append((a, b))
        assert [tuple(s) for s in x.attends] == merged
        assert all(b <= x.emit_start for _, b in merged)  # ancestors come first
        assert x.position_start == (named[x.parent].position_start + len(named[x.parent].ids) if x.parent else 0)
    for members in trees.values():  # one sequence without gaps, each subtree in one piece
        members.sort(key=lambda x: x.emit_start)
        at, stack = 0, []
        for x in members:
            assert x.emit_start == at
            at += len(x.ids)
            if x.node != x.tree:
                while stack[-1] != x.parent:
                    stack.pop()
            stack.append(x.node)


def test_empty(spark):
    turns, nodes = chat_tree(spark.createDataFrame([], SCHEMA))
    assert turns.count() == nodes.count() == read_back(turns, nodes).count() == 0


def test_very_long_texts(spark):
    long = "[INST] word " * 100_000 + "\\" * 1000 + " " * 50_000
    rows = [(1, 0, "user", long, ""), (1, 1, "assistant", long, ""), (2, 0, "user", long, ""), (2, 1, "assistant", "short", "")]
    turns, nodes = chat_tree(spark.createDataFrame(rows, SCHEMA))
    got = {x.conv_id: x for x in read_back(turns, nodes).collect()}
    assert nodes.count() == 3
    for c, said in ((1, long), (2, "short")):
        assert got[c].turns_sha256 == hashlib.sha256(f"user\n{long}\nassistant\n{said}\n".encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
