"""What the pipeline's stages leave of texts that are partly the same."""

import random

import corpus_pipeline


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def staged_rows(spark, stage, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.text for r in stage(spark, docs, "").collect()}


def test_repeated_lines_go_unless_the_join_takes_the_text(spark):
    shared = [words(k, 12) for k in range(4)]
    own = {i: words(100 + i, 10) for i in range(20)}
    # 0 to 3 have one line in common, more than half of each; no two of them link
    rows = [(i, own[i] + "\n" + shared[0]) for i in range(4)]
    # exact copies: the first has all lines first
    rows += [(10 + i, shared[1] + "\n" + own[10]) for i in range(3)]
    # lines that were in others before, in copies of one another
    rows += [(4, own[4] + "\n" + shared[2]), (5, own[5] + "\n" + shared[3])]
    rows += [(15 + i, shared[2] + "\n" + shared[3] + "\n" + own[15]) for i in range(3)]
    got = staged_rows(spark, corpus_pipeline.lines, rows)
    assert got == dict(rows) | {i: own[i] for i in (1, 2, 3)} | {15: own[15], 16: "", 17: ""}
    docs = spark.createDataFrame(list(got.items()), "doc_id long, text string")
    left = {r.doc_id: r.text for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    for line in shared:
        assert sum(line in t for t in left.values()) == 1


def test_copies_link_by_five_words(spark):
    base = words(7, 200).split()
    # four and eight words are others
    edited = {n: [w if k % (200 // n) != n else f"new{k}" for k, w in enumerate(base)] for n in (4, 8)}
    inserted = base[:100] + words(8, 37).split() + base[100:]
    rows = [(0, " ".join(base)), (1, " ".join(inserted)), (2, " ".join(edited[4])), (3, " ".join(edited[8]))]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    share = {i: len(sets[0] & sets[i]) / len(sets[0] | sets[i]) for i in sets}
    assert 0.8 <= share[1] < 0.85 and 0.8 <= share[2] < 0.85 and share[3] < 0.8
    assert set(staged_rows(spark, corpus_pipeline.near_copies, rows)) == {0, 3}


def test_passages_go_from_two_documents_on(spark):
    passage, line = words(20, 51), words(21, 50)
    own = {i: words(200 + i, 60) for i in range(4)}
    rows = [(0, own[0] + "\n" + passage), (1, passage + "\n" + own[1]), (2, own[2] + "\n" + line), (3, own[3] + "\n" + line)]
    assert staged_rows(spark, corpus_pipeline.lines, rows) == dict(rows) | {1: own[1]}


def test_pieces_are_decoded(spark):
    rows = [(0, "plain words"), (1, ""), (2, None), (3, " é😀\n\t▁ "), (4, words(30, 90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.lossless for r in corpus_pipeline.pieces(spark, docs, "").collect()} == {i: True for i, _ in rows}


def test_unlike_texts_of_one_id_all_stay(spark):
    a, b = words(31, 60), words(32, 60)
    rows = [(3, a), (3, b), (3, a), (4, a), (None, b), (None, words(33, 60)), (5, None), (5, ""), (6, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((x.doc_id, x.text) for x in corpus_pipeline.near_copies(spark, docs, "").collect()), key=str)
    assert got == sorted([(3, a), (3, b), (None, rows[5][1]), (5, None), (5, ""), (6, " ")], key=str)


def test_empty_table_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, rk string, sid string, _cut string, score string, ids string, n_words string, root string, rest string, n_dropped string"
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    text = words(40, 80)
    for rows in ([], [(1, text, "aa", *"abcdefghi"), (2, text, "aa", *"abcdefghi"), (3, words(41, 80), "aa", *"abcdefghi")]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), schema)
        assert sorted(x.doc_id for x in corpus_pipeline.pieces(spark, docs, "").collect()) == ([1, 3] if rows else [])
