import corpus_pipeline
from quarryline.llm import decontamination, line_dedup, ngram_join, packing, toxicity
from quarryline.llm.common import table
from tests.llm.test_decontamination import _full, words
from tests.llm.test_line_dedup import brute as repeated
from tests.llm.test_ngram_join import brute as linked

SMALL = "/root/testdata/sf0.001"


def test_stages_are_what_their_operators_decide(spark):
    docs = table(spark, SMALL, "documents")
    columns, ids = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.keep(stage(spark, docs, SMALL))
        if name != "packing":
            assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()} if name != "packing" else None
        if name == "toxicity":
            toxic = {r.doc_id for r in table(spark, SMALL, "labels").where("toxic = 1").collect()}
            gone = before.keys() - after.keys()
            assert all(after[i] == before[i] for i in after) and len(gone - toxic) <= 0.02 * len(before)
        elif name == "line_dedup":
            went = repeated(sorted(before.items()))
            for i, t in before.items():
                rest = [x for k, x in enumerate((t or "").split("\n")) if (i, k) not in went]
                cut = any(j == i for j, _ in went)
                assert (i not in after) if cut and not "".join(rest).strip() else after[i] == ("\n".join(rest) if cut else t)
        elif name == "ngram_jaccard":
            assert after == {i: before[i] for i, _, c in linked(sorted(before.items())) if c == i}
        elif name == "decontamination":
            items = [words(r.text) for r in table(spark, SMALL, "benchmark").collect()]
            bad = {i for i, t in before.items() if any(_full(words(t), x) for x in items)}
            assert not bad & after.keys() and all(after[i] == before[i] for i in after) and len(before) - len(after) <= 2 * len(bad) + 1
        else:
            assert {r.doc_id for r in docs.collect()} == before.keys()
    ids["all"] = docs.count()
    assert ids["all"] and corpus_pipeline.ORACLE_SQL is None
    assert all(hasattr(m, "__doc__") for m in (decontamination, line_dedup, ngram_join, packing, toxicity))


def test_extra_columns_nulls_and_repeats(spark):
    rows = [(1, None, "x", 0), (2, "", "x", 0), (3, "one two three four five six", "x", 0), (3, "one two three four five six", "x", 0), (None, "a b", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic_id string, copy_id int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.keep(stage(spark, docs, SMALL))
        assert docs.columns == ["doc_id", "text", "toxic_id", "copy_id"]
    assert docs.count() == 5 and corpus_pipeline.pack(spark, docs.where("false"), SMALL).count() == 0


def test_rows_without_or_with_the_same_id_are_judged_on_their_own(spark):
    import pyspark.sql.functions as F

    real = table(spark, SMALL, "documents").select("doc_id", "text")
    judged = toxicity.judge(real, table(spark, SMALL, "labels"))
    toxic, clean = (real.join(judged.where(f"predicted = {p}"), "doc_id").orderBy("doc_id").first().text for p in (1, 0))
    for i in (None, 10**9):
        extra = spark.createDataFrame([(i, toxic), (i, clean)], "doc_id long, text string")
        left = corpus_pipeline.drop_toxic(spark, real.union(extra), SMALL).where(F.col("doc_id").eqNullSafe(i)).collect()
        assert [r.text for r in left] == [clean]
        item = table(spark, SMALL, "benchmark").orderBy(F.length("text").desc()).first().text
        docs = spark.createDataFrame([(i, f"so it says {item} there"), (i, "all clean here with nothing to find in it at all"), (5, item[:20])], "doc_id long, text string")
        left = corpus_pipeline.drop_contaminated(spark, docs, SMALL).where(F.col("doc_id").eqNullSafe(i)).collect()
        assert [r.text for r in left] == ["all clean here with nothing to find in it at all"]
        # line 1 of one row repeats an earlier document, line 1 of the others does not
        rows = [(1, "the first line of all is here"), (i, "my very own line of words\nthe first line of all is here"), (i, "another line that nobody else has\nunique words are what this line holds"), (i, "\nunique words are what this line keeps")]
        left = {r.text for r in corpus_pipeline.drop_repeated_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL).where(F.col("doc_id").eqNullSafe(i)).collect()}
        assert left == {"my very own line of words", rows[2][1], rows[3][1]}
        told = sorted(r.removed for r in line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert told == ["", "", "", "1"]
    # of one id, the row that copies an earlier document goes, the other stays
    rows = [(1, "a b c d e f g h i j"), (7, "a b c d e f g h i j"), (7, "quite other words that are nowhere else in here")]
    left = corpus_pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL).collect()
    assert sorted(tuple(r) for r in left) == [rows[0], rows[2]]
