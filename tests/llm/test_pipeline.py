"""The pipeline's stages against brute force, one after the other, on a small table."""

import random

import corpus_pipeline
from lexmill.llm.sampled_pieces import decode_pieces
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_line_templates import brute as lines
from tests.llm.test_ngram_join import brute as joined

SOUNDS = {"aa": ["ka", "lo", "mi", "ta", "re", "so"], "bb": ["str", "eng", "ung", "cht", "ich", "ver"]}


def text(r, lang, n):
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randint(2, 4))) for _ in range(n))


def table():
    r = random.Random(5)
    line = text(r, "aa", 7)
    items = [(i, text(r, "aa", 14)) for i in range(5)]
    rows = [(i, "\n".join(text(r, lang, r.randint(8, 30)) for _ in range(3)), lang) for i, lang in ((i, r.choice(["aa", "bb"])) for i in range(80))]
    rows += [(100 + i, text(r, "aa", 40) + "\n" + line + "\n" + text(r, "aa", 40), "aa") for i in range(6)]
    base = text(r, "bb", 120)
    rows += [(200 + i, base if i < 2 else base.replace(" ", f" x{i} ", 1), "bb") for i in range(5)]
    rows += [(300 + i, text(r, "aa", 20) + " " + items[i][1] + " " + text(r, "aa", 20), "aa") for i in range(5)]
    rows += [(400, "123 456 -- 789", "aa"), (401, None, "aa"), (402, "", None)]
    return rows, items


def test_as_brute_force(spark, tmp_path):
    rows, items = table()
    spark.createDataFrame([(i, t, k, "s", len(t or "")) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept, stages = spark.read.parquet(str(tmp_path / "documents.parquet")), [(i, t) for i, t, _ in rows], dict(corpus_pipeline.STAGES)
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding"]
    for name, stage in list(stages.items())[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        if name == "language ID":
            kept = [(i, t) for i, t in kept if i < 400]
        elif name == "line dedup":
            kept = [(i, t) for i, t, *_ in lines(kept, most=corpus_pipeline.COPY_SHARE, long=corpus_pipeline.LONG_LINE)]
        elif name == "n-gram Jaccard join":
            kept = [x for x, found in zip(kept, joined(kept)) if found[0] == found[2]]
        else:
            kept = [x for x, found in zip(kept, contaminated(kept, items, 10)) if not found[5]]
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(kept), name
    assert {i for i, _ in kept} & set(range(200, 205)) == {200} and not {i for i, _ in kept} & set(range(300, 305))
    last = stages["SentencePiece encoding"](spark, docs, str(tmp_path))
    assert sorted((r.doc_id, r.decoded) for r in decode_pieces(last).collect()) == sorted(kept)
    assert sorted((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((r.doc_id, r.ids) for r in last.collect())


def test_one_python_worker_a_task_in_the_last_stage(spark, tmp_path):
    """Workers stay for later tasks, so a stage with two Python passes keeps twice as many in an executor's memory from then on."""
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    found = dict(corpus_pipeline.STAGES)["SentencePiece encoding"](spark, docs, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.doc_id, r.lossless) for r in found.collect()) == [(1, True), (2, True)]
