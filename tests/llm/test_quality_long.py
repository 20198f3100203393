"""Training takes whole texts: what a document is labelled for may stand far below its start."""

import numpy as np
import pyarrow as pa

from presswork.llm import quality


def test_all_lines_reach_the_fit():
    text = "\n".join(["A clean line of plain words, as all are."] * 250 + ["#$%& ||| BUY!!! NOW!!! 9999"] * 50)
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array([0, 1], pa.int32()), pa.array([text, "one\ntwo"])], ["doc_id", "quality", "text"])
    (out,) = quality._features(iter([batch]))
    x, lengths = quality.line_features(np.frombuffer(text.encode(), np.uint8))
    assert [len(v) // 8 for v in out.column("lengths").to_pylist()] == [300, 2]
    own = np.frombuffer(out.column("x")[0].as_py(), "<f4").reshape(-1, quality.N_OWN)
    assert np.allclose(quality.with_neighbours(own), x, atol=1e-6)
    assert np.frombuffer(out.column("lengths")[0].as_py(), "<i8").tolist() == lengths.tolist()


def test_scores_like_a_plain_chain(spark, medium):
    """The whole query's scores against forward-backward sums taken line by line, one document after the other."""
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{medium}/labels.parquet"))
    got = {r.doc_id: (r.score, r.predicted) for r in quality.score(docs, model).collect()}
    move = np.exp(model.step)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == len(texts)
    for doc, text in texts.items():
        x, length = quality.line_features(np.frombuffer(text.encode(), np.uint8))
        emit = [np.array([1.0, np.exp(s)]) for s in x @ model.emit]
        fore, back = [emit[0]], [np.ones(2)]
        for e in emit[1:]:
            fore.append(fore[-1] @ move * e)
            fore[-1] /= fore[-1].sum()
        for e in emit[:0:-1]:
            back.insert(0, move @ (e * back[0]))
            back[0] /= back[0].sum()
        good = [(f * b)[1] / (f * b).sum() for f, b in zip(fore, back, strict=True)]
        score = 1 / (1 + np.exp(-(model.curve[0] + model.curve[1] * np.average(good, weights=length + 1.0))))
        assert abs(score - got[doc][0]) < 1e-6 and got[doc][1] == int(got[doc][0] >= 0.3)


def test_repeated_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two\nthree"), (1, "other"), (1, "other"), (3, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (9, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert quality.score(docs, model).count() == 4
    assert quality.keep_good(docs.where("false"), model).count() == 0
    assert quality.train(docs.where("false"), labels).curve[1] == 0.0
