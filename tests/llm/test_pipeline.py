"""Each stage of the pipeline against a brute-force version on its own input, and run() as a whole."""

import hashlib
import re
import struct

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loam.llm.queries import op8_quality_classifier

from .test_operators import components_of, low, removed_of_all_lines

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and the output of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp(name)}/out"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
        assert [f.dataType for f in df.schema] == [f.dataType for f in stages[0].schema]


def test_quality_stage(spark, stages):
    kept = {r["doc_id"] for r in op8_quality_classifier(spark, SF).where("predicted = 1").collect()}
    before, after = rows_of(stages[0]), rows_of(stages[1])
    assert after == {k: v for k, v in before.items() if k in kept}
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [k for k, q in quality.items() if q == 1]
    junk = [k for k, q in quality.items() if q == 0]
    assert all(k in after for k in clean)
    assert sum(k not in after for k in junk) >= 0.9 * len(junk)  # few labels at this scale


def test_line_stage(stages):
    before, after = rows_of(stages[1]), rows_of(stages[2])
    gone = removed_of_all_lines([(k, v["text"]) for k, v in before.items()])
    text = {k: "\n".join(x for n, x in enumerate(v["text"].split("\n")) if n not in gone.get(k, ())) for k, v in before.items()}
    assert after == {k: v | {"text": text[k], "n_chars": len(text[k])} for k, v in before.items() if k not in gone or text[k].strip()}


def test_near_copy_stage_takes_five_words_at_80_percent(spark, stages):
    text = [f"w{k}" for k in range(500)]
    # scattered changes: word trigrams at 0.9 accept 8, five words at 0.8 accept 11
    rows = [(n + 1, " ".join(f"x{n}" if k % 40 == 7 and k // 40 < n else w for k, w in enumerate(text)), "en", "s", 0) for n in (0, 9, 11, 12)]
    docs = spark.createDataFrame(rows, stages[0].schema)
    want = {k for k, (_, least) in components_of([r[:2] for r in rows], 80, 5).items() if k == least}
    assert rows_of(corpus_pipeline.ngram_jaccard(spark, docs, SF)).keys() == want == {1, 13}
    before, after = rows_of(stages[2]), rows_of(stages[3])
    groups = components_of([(k, v["text"]) for k, v in before.items()], 80, 5)
    assert after == {k: v for k, v in before.items() if groups[k][1] == k}


def test_decontamination_stage(spark, stages):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word.findall(low(r["text"]))
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))}
    sizes = {len(p) for p in windows}

    def clean(text):
        w, hit = word.findall(low(text)), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit.update(range(k, k + m))
        return not hit or 20 * len(hit) < len(w)

    before, after = rows_of(stages[3]), rows_of(stages[4])
    assert after == {k: v for k, v in before.items() if clean(v["text"])}


def test_token_stage(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before, after = rows_of(stages[4]), rows_of(stages[5])
    assert before.keys() == after.keys()
    for k, v in before.items():
        ids = library.encode(v["text"], add_special_tokens=False).ids
        own = after[k]
        assert own["ids"] == ids and own["n_tokens"] == len(ids) and own["lang"] == v["lang"]
        assert own["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert own["decoded_sha256"] == hashlib.sha256(v["text"].encode()).hexdigest()


def test_run_equals_stages(spark, stages):
    assert rows_of(corpus_pipeline.run(spark, SF)) == rows_of(stages[-1])


def test_empty_input(spark, stages):
    docs = stages[0].where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
