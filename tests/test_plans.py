"""The physical plans that the scale of the data depends on."""

import re

from pyspark.sql import functions as F

from lexiloom.operators import corpus, labels, ordered, packing, spans
from lexiloom.plans import catalog, inputs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def table(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_filters_and_columns_reach_the_scan(spark, folder):
    text = plan(corpus.drop_headings(table(spark, folder)).select("doc_id"))
    assert re.search(r"PushedFilters: \[.*Not\(EqualTo\(text,\)\)", text)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    tagged = plan(inputs.tagged_sentences(spark, folder))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in tagged


def test_sentence_counting_shuffles_only_counts(spark, folder):
    rows = spark.createDataFrame([(["O"], ["O"])], "gold array<string>, pred array<string>")
    text = plan(spans.chunk_counts(rows))
    assert text.count("Exchange") == 1 and "partial_sum" in text and "Window" not in text


def test_kshot_is_cut_before_the_shuffle(spark):
    rows = spark.createDataFrame([(1, ["O"])], "sent_id bigint, tags array<string>")
    text = plan(labels.kshot(rows, 16, ["sent_id"]))
    # both ranks read keys alone, and each is cut in the tasks before its shuffle
    assert text.count("WindowGroupLimit") == 4
    assert "tags" not in text[text.index("Window"):text.rindex("WindowGroupLimit")]


def test_rows_are_never_in_one_partition(spark):
    """The single-partition step of the bucketed operators reads bucket summaries, not rows."""
    df = spark.range(100).select(F.col("id").alias("row_id"), F.array(F.lit("a")).alias("tokens"))
    for made in (packing.pack_stream(df, 4), ordered.dense_index(df, "i", ["row_id"]),
                 ordered.neighbours(df, ["row_id"], ["row_id"])):
        lines = plan(made).splitlines()
        for n, line in enumerate(lines):
            if "SinglePartition" in line:
                below = [x for x in lines[n + 1:n + 3]]
                assert any("Aggregate(key" in x for x in below), "\n".join(lines[n:n + 4])


def test_blocks_inside_a_bucket_need_no_second_shuffle(spark):
    df = spark.range(100).select(F.col("id").alias("row_id"), F.array(F.lit("a")).alias("tokens"))
    inner = plan(packing.pack_stream(df, 4)).split("\n+- ")[-1]
    inner = inner[inner.index("Union"):]
    first_child = inner[:inner.index("Window")]
    assert "Exchange" not in first_child


def test_expression_operators_have_no_python(spark, folder):
    python_allowed = {"head_scores", "head_gradient", "crf_gradient", "tokens_by_function"}
    # results that are made while the query is built
    skip = {"corpus_to_blocks", "text_files_read", "processed_split", "head_fit", "head_fit_two_layer", "head_grid", "head_halving", "crf_fit", "tagged_file_round_trip", "prediction_file_eval",
            "tagged_crlf", "prediction_crlf", "run_log_tree", "run_log_resume", "two_layer_gradient", "two_layer_step", "subword_vocab_labels", "backward_trigram_nll",
            "crf_partition_long", "crf_partition_wide", "crf_viterbi_long", "crf_viterbi_wide", "crf_gradient_long",
            "written_splits", "encode", "encode_lines", "span_prf_flat", "backward_bigram_nll"}
    for name, fn in catalog.QUERIES.items():
        if name in skip or name.startswith("stream_"):
            continue
        text = plan(fn(spark, folder))
        found = re.search("Python|Pandas|Arrow", text)
        assert bool(found) == (name in python_allowed), name
