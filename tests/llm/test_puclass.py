import zlib

import numpy as np

from quillstream.llm import puclass
from quillstream.llm._support import table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels")
    scored = puclass.classify(table(spark, sf, "documents"), labels).toPandas()
    assert (scored.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in scored.doc_id]).all()
    both = scored.merge(labels.toPandas(), on="doc_id")
    out = both[both.held_out]
    good, bad = out[out.quality == 1].score.to_numpy(), out[out.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (out.predicted == out.quality).mean() > 0.95
    assert ((scored.score >= 0.5) == (scored.predicted == 1)).all() and scored.score.between(0, 1).all()


def test_labels_of_the_held_out_fold_do_not_matter(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    flipped = labels.withColumn("quality", puclass.F.when(puclass.held_out("doc_id"), 1 - labels.quality).otherwise(labels.quality))
    a = puclass.classify(docs, labels).orderBy("doc_id").toPandas()
    b = puclass.classify(docs, flipped).orderBy("doc_id").toPandas()
    assert np.array_equal(a.score, b.score)


def test_odd_and_empty(spark, sf, odd_docs, no_docs):
    labels = table(spark, sf, "labels")
    rows = puclass.classify(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert puclass.classify(no_docs, labels).count() == 0
    assert {r.score for r in puclass.classify(odd_docs, labels.limit(0)).collect()} == {1.0}
    with_nulls = labels.union(spark.createDataFrame([(None, 1, 0), (1, None, None)], labels.schema))
    assert puclass.classify(odd_docs, with_nulls).count() == odd_docs.count()


def test_negative_labels_are_never_read(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    a = puclass.classify(docs, labels).orderBy("doc_id").toPandas()
    b = puclass.classify(docs, labels.where("quality = 1")).orderBy("doc_id").toPandas()
    assert np.array_equal(a.score, b.score)


def test_the_prior_of_known_mixtures_is_found():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.9):
        positive = rng.normal(2, 1, 4000)
        good = rng.random(6000) < share
        unlabelled = np.where(good, rng.normal(2, 1, 6000), rng.normal(-2, 1, 6000))
        assert abs(puclass.prior_of(positive, unlabelled) - share) < 0.06


def plain_risk(model, positive, unlabelled, prior):
    """The non-negative risk of the definition, one row at a time."""
    loss = lambda g: float(np.log1p(np.exp(-g)))

    def g(x):
        z = np.clip((x - model.mean) / model.scale, -6, 6)
        return float(sum(np.tanh(sum(z[i] * model.w1[i, h] for i in range(len(z))) + model.b1[h]) * model.w2[h] for h in range(len(model.w2))) + model.b2[0])

    plus, minus = [g(x) for x in positive], [g(x) for x in unlabelled]
    right = prior * np.mean([loss(v) for v in plus])
    wrong = np.mean([loss(-v) for v in minus]) - prior * np.mean([loss(-v) for v in plus])
    return right + max(0.0, wrong)


def test_the_fit_lowers_the_risk_of_the_definition():
    rng = np.random.default_rng(3)
    positive = rng.normal(1, 1, (40, 4))
    unlabelled = np.concatenate([rng.normal(1, 1, (60, 4)), rng.normal(-1, 1, (40, 4))])
    mean, scale = unlabelled.mean(0), unlabelled.std(0)
    risks = [plain_risk(puclass.fit(positive, unlabelled, 0.6, mean, scale, steps=n), positive, unlabelled, 0.6) for n in (1, 10, 60)]
    assert risks[0] > risks[1] > risks[2] and risks[2] < 0.45


def test_other_columns_and_their_names(spark, sf):
    docs = table(spark, sf, "documents").withColumns({"score": puclass.F.lit(1), "a.b": puclass.F.lit(2), "x": puclass.F.lit(3)})
    out = puclass.accepted(docs, table(spark, sf, "labels"))
    assert out.columns == docs.columns and out.where("score = 1 AND `a.b` = 2 AND x = 3").count() == out.count() > 100
