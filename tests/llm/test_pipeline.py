"""The corpus pipeline on a small table, each stage against what it must keep."""

import random

import corpus_pipeline
from docloom.llm import queries as llm
from docloom.llm.common import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice("bdfgklm") + rng.choice("aeiou") + rng.choice("nrst") + rng.choice("aeiou") for _ in range(n))
    item = text(20)
    rows = [(i, "\n".join(text(12) for _ in range(6)), "en", f"src{i % 3}") for i in range(60)]
    base = [text(1) for _ in range(120)]
    near = lambda k: " ".join(w if j != 7 * k else "edit" for j, w in enumerate(base))
    rows += [(100, near(1), "en", "src0"), (101, near(2), "en", "src1"), (102, rows[3][1], "en", "src2"), (103, item, "en", "src1"), (104, "12 34", "en", "src1"), (105, None, None, None), (106, "", "en", None)]
    rows = [(*r, len(r[1] or "")) for r in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, apply in corpus_pipeline.STAGES:
        docs = stage(apply(spark, docs, str(tmp_path)), name)
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "mixing":
            assert docs.columns == COLUMNS
    clean = set(range(60))
    assert kept[0] == clean | {100, 101, 102, 103}
    assert kept[1] - {100, 101} == clean | {103}
    assert kept[2] >= clean | {100, 103} and 101 not in kept[2]
    assert kept[3] == kept[2] - {103}
    assert kept[4] <= kept[3]
    assert sorted(r.mix_order for r in docs.collect()) == sorted(r.mix_order for r in corpus_pipeline.run(spark, str(tmp_path)).collect())


def test_stages_take_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, apply in corpus_pipeline.STAGES:
        assert apply(spark, docs, str(tmp_path)).count() == 0


def test_one_query_of_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in llm.queries()) == list(range(1, 11))
    assert set(llm.oracle_sql()) <= set(llm.queries())
