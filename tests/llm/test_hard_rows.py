"""Megabyte texts, and columns named as those that operators make, through every operator on documents."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from loam.llm import bpe, classifier, contamination, line_dedup, lm_scoring, ngram_join, quality_rules, substring_dedup, tokens
from loam.llm.queries import tokenizer_path

NAMES = ["n_words", "word_chars", "kept", "score", "predicted", "n_tokens", "n_bytes", "ids", "ids_sha256", "items", "n_hit", "contaminated", "n_removed", "n_lines", "component_id", "stats", "chunk", "part", "key", "bucket", "p"]


def big(seed, size=1_000_000):
    """A megabyte of lines, with one word of a hundred thousand letters in it."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(5000)}" for _ in range(size // 6)]
    lines = [" ".join(words[k : k + 20]) for k in range(0, len(words), 20)]
    return "\n".join([*lines[:1000], "y" * 100_000, *lines[1000:]])


@pytest.fixture(scope="module")
def docs(spark):
    one, two = big(1), big(2)
    rows = [(1, one), (2, one + " tail"), (3, two), (4, "short text"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.select("*", *(F.lit("own").alias(c) for c in NAMES))


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_near_copies(docs):
    found = rows_of(ngram_join.join_components(docs))
    assert (found[2]["component_id"], found[3]["component_id"], found[5]["n_shingles"]) == (1, 3, 0)


def test_quality_rules(docs):
    found = rows_of(quality_rules.apply_rules(docs))
    assert found[1]["n_words"] + 1 == found[2]["n_words"] and found[1]["score"] == "own" and found[4]["base_failed"]
    assert not quality_rules.apply_rules(docs.limit(0)).collect()


def test_tokens(docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    found = rows_of(tokens.count_tokens(docs, path))
    for r in docs.where("doc_id in (3, 4, 5)").collect():
        assert found[r["doc_id"]]["n_tokens"] == len(Tokenizer.from_file(path).encode(r["text"] or "", add_special_tokens=False).ids)


def test_bpe(docs):
    back = rows_of(bpe.decode(bpe.encode(docs.select("doc_id", "text", "key"), tokenizer_path("byte_bpe_50k.json")), tokenizer_path("byte_bpe_50k.json")))
    assert all((r["text"] or "") == r["decoded"] and r["key"] == "own" for r in back.values())


def test_lines(docs):
    found = rows_of(line_dedup.dedup_lines(docs))
    assert found[1]["n_removed"] == 0 and found[2]["text"] == "" and found[3]["n_removed"] == 1 and found[5]["text"] is None and found[4]["p"] == "own"


def test_classifier(docs):
    rng = zlib.crc32(b"x")
    labelled = classifier.add_statistics(docs.select("doc_id", "text", "p")).withColumn("label", (F.col("doc_id") % 2).cast("int"))
    model = classifier.fit(labelled)
    found = rows_of(classifier.score_texts(docs, model))
    assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) and r["p"] == "own" for r in found.values()) and rng


def test_contamination(docs, spark):
    text = docs.where("doc_id = 3").first()["text"]
    items = spark.createDataFrame([("a", " ".join(text.split()[500:520])), ("b", "nothing of this is anywhere")], "item_id string, text string")
    found = rows_of(contamination.find_contamination(docs, items))
    assert found[3]["items"] == ["a"] and found[3]["n_hit"] == 20 and not found[3]["contaminated"] and found[1]["items"] == [] and found[1]["key"] == "own"


def test_passages(docs):
    found = rows_of(substring_dedup.remove_repeats(docs))
    assert found[1]["n_removed"] == 0 and found[2]["n_words"] - found[2]["n_removed"] < 20 and found[3]["n_removed"] < found[3]["n_words"] / 100


def test_model_scores(docs):
    found = rows_of(lm_scoring.score_texts(docs, F.col("doc_id") != 2))
    assert found[2]["held_out"] and found[2]["n_known"] >= found[2]["n_tokens"] - 1 and found[2]["score"] > found[2]["base_score"]
    assert found[5]["n_tokens"] == 1 and found[5]["score"] == found[6]["score"]
