"""Nulls, empty and long texts, repeated rows, empty tables, and extra columns: every operator gives its defined result."""

import public_tokenizers
import pytest

import corpus_pipeline
from factloom.llm import byte_bpe, decontam, divergence, fst_count, html_lstm, langid, oddsketch, quality_ordinal, secret_scan, suffix_dedup

BPE, PIECES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, id int, found_id int, doc int"
LONG = " ".join(f"w{i % 977} the of and" for i in range(9000))
ODD = [None, "", " \n\t ", "a", "²½ Ⅷ", LONG, "The same words again and again in one line of text here", "The same words again and again in one line of text here"]


def rows(spark, texts=ODD, null_id=True):
    out = [(i, t, [None, "en", "de"][i % 3], "s", None, "x", 1, 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(out + [(None, "a text without an id stays where it is", "en", None, None, None, None, None, None)] * null_id, SCHEMA)


def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (5, 0, 0), (6, None, 1), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(1, "the same words again and again in one line"), (2, None), (3, "!!"), (3, "words again and again")], "item_id long, text string")


OPERATORS = {
    "op1": lambda s, d: quality_ordinal.score_documents(d, quality_ordinal.train(d, quality_ordinal.grades_of_labels(labels(s)), 3), 2),
    "op2": lambda s, d: divergence.apply_rules(d, divergence.learn(d)),
    "op4": lambda s, d: langid.identify(d, langid.train(d)),
    "op6": lambda s, d: suffix_dedup.remove_repeats(d),
    "op7": lambda s, d: oddsketch.near_duplicates(d),
    "op8": lambda s, d: byte_bpe.encode_documents(d, BPE),
    "op9": lambda s, d: fst_count.count_tokens(d, PIECES),
    "op10": lambda s, d: secret_scan.find_secrets(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_give_a_row_each(spark, name):
    d = rows(spark)
    got = OPERATORS[name](spark, d).collect()
    assert len(got) == len(ODD) + 1
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == list(range(len(ODD)))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, rows(spark, [], False)).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_and_no_rows(spark, stage, tmp_path):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    run = corpus_pipeline.STAGES[stage][1]
    out = run(spark, rows(spark), str(tmp_path))
    if stage < 4:
        assert out.columns == rows(spark).columns
    assert out.count() <= len(ODD) + 1
    assert run(spark, rows(spark, [], False), str(tmp_path)).count() == 0


def test_matches_of_odd_items(spark):
    got = decontam.contaminated(rows(spark), benchmark(spark)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(6, 1), (7, 1), (6, 3), (7, 3)}
    assert decontam.contaminated(rows(spark), benchmark(spark).limit(0)).count() == 0


def test_pages(spark):
    d = spark.createDataFrame([(1, "u", None), (None, None, ""), (2, "u", "<article><h1>One &amp; two</h1><p>A  text<br>here.<p>More</article><footer>c</footer>"), (2, "u", "<nav>x</nav><!-- <p>no")], "page_id long, url string, html string")
    got = html_lstm.extract(d).collect()
    assert [r["text"] for r in got] == ["", "", "One & two\n\nA text here.\n\nMore", ""]
    assert [r["n_chars"] for r in got] == [len(r["text"]) for r in got]
    assert html_lstm.extract(d.limit(0)).count() == 0


def test_repeated_rows(spark):
    d = spark.createDataFrame([(1, "one two three four five six seven eight nine ten and " * 3)] * 3 + [(2, "other")], "doc_id long, text string")
    near = oddsketch.near_duplicates(d).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near) == [(1, 1, True)] * 3 + [(2, 2, True)]
    assert oddsketch.keep_one(d).count() == 2
    assert {r["n_removed"] for r in suffix_dedup.remove_repeats(d).collect()} == {0}
