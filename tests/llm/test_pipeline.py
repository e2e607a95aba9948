import numpy as np
import public_tokenizers

import corpus_pipeline
from tests.llm.test_queries import classes
from tests.oracle import DATA


def kept_bytes(docs, length=100):
    seen, out = set(), {}
    for i in sorted(docs):
        b = docs[i].encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        out[i] = bytes(x for x, g in zip(b, gone) if not g)
    return out


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, DATA).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
            after = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
            assert set(after) <= set(before)
        if name in ("toxicity", "quality rules"):
            assert all(before[i] == t for i, (t, _) in after.items()) and len(after) > 0.6 * len(before)
        if name == "near duplicates":
            assert set(after) == {i for i, c in classes(before, 5).items() if c[2]}
        if name == "repeated strings":
            want = {i: b.decode("utf-8", "ignore") for i, b in kept_bytes(before).items()}
            assert {i: t for i, (t, _) in after.items()} == {i: t for i, t in want.items() if t} and all(n == len(t) for t, n in after.values())
        if name == "packing":
            from tokenizers import Tokenizer

            coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            total = {r.doc_id: r.n for r in docs.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
            assert total == {i: len(coder.encode(t, add_special_tokens=False).ids) + 1 for i, t in before.items()}
        seen.append(len(before))
    assert corpus_pipeline.run(spark, DATA).count() == docs.count()


def test_stages_on_odd_rows(spark):
    rows = [(None, "word " * 60, "en", "s", 300), (1, None, None, None, None), (2, " ".join(f"w{i}" for i in range(80)), "en", "s", 3)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, DATA)
        assert got.columns == docs.columns and {r.doc_id for r in got.collect()} <= {None, 1, 2}
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_near_duplicates_keep_one_row_of_copies(spark):
    rows = [(None, "word " * 60), (2, " ".join(f"w{i}" for i in range(80))), (3, None)] * 2 + [(None, "other " * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, DATA).collect()]
    assert len(got) == 4 and set(got) == set(rows)
