import random
import zlib

import numpy as np
import pyarrow as pa

from patchlore.llm import textcnn, tokens, toxicity
from tests.llm.conftest import CLASHES

PLAIN = "the river runs past our old house and under a small bridge near town".split()
RUDE = ["blorg", "snarf", "grutz", "vlekk"]


def labelled(n, seed=2, share=0.3):
    r = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        words = [r.choice(PLAIN) for _ in range(r.randint(5, 60))]
        toxic = int(r.random() < share)
        if toxic:
            for _ in range(r.randint(1, 3)):
                words.insert(r.randrange(len(words)), r.choice(RUDE) + r.choice(["", ",", "!"]))
        rows.append((i, " ".join(words), r.choice(["en", "xx"])))
        marks.append((i, 0, toxic))
    return rows, marks


def labels(spark, marks):
    return spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_tabled_responses_equal_direct_convolution():
    texts = [["a", "b", "c", "a"], ["b"], [], ["z"] * 50, ["c", "b"]] * 3
    model = textcnn.train([textcnn.buckets_of(t, {}) for t in texts], [1, 0, 0, 0, 1] * 3, epochs=3)
    scorer = textcnn.Scorer(model)
    for t in texts:
        e = model.embed[[int(model.row_of[textcnn.bucket(w)]) for w in t] or [0]]
        e = np.concatenate([e, np.zeros((2, e.shape[1]))])
        n = len(t) or 1
        pooled = np.concatenate([np.maximum((sum(e[o:n + o] @ w[o] for o in range(len(w))) + b).max(axis=0), 0) for w, b in zip(model.conv, model.conv_bias, strict=True)])
        assert abs(scorer.logits([" ".join(t)])[0] - (pooled @ model.out + model.out_bias)) < 1e-4


def test_held_out_texts(spark, docs):
    rows, marks = labelled(500)
    odd = [(9000, None), (9001, ""), (9002, "river " * 30_000 + "blorg"), (9003, "river " * 30_000), (None, "blorg snarf"), (3, rows[3][1])]
    table = docs(rows + odd, CLASHES)
    classifier = toxicity.fit(*toxicity.sample(table, labels(spark, marks + [(None, 0, 1), (77777, 0, 1), (4, 0, None)])))
    got = {r.doc_id: (r.predicted, r.score) for r in toxicity.score(table, classifier).collect()}
    held = [(i, y) for i, _, y in marks if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i][0] == y for i, y in held) / len(held) > 0.95
    assert got[9000][0] == got[9001][0] == got[9003][0] == 0 and got[9002][0] == got[None][0] == 1
    assert all(0 <= s <= 1 and p == int(s >= 0.3) for p, s in got.values())


def test_labels_of_held_out_rows_are_not_used(spark, docs):
    rows, marks = labelled(200)
    table = docs(rows)
    flipped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, q, y in marks]
    assert toxicity.sample(table, labels(spark, marks)) == toxicity.sample(table, labels(spark, flipped))


def test_sample_is_bounded_and_weighted(spark, docs):
    rows, marks = labelled(200)
    got, weight = toxicity.sample(docs(rows), labels(spark, marks), toxic=5, clean=10)
    assert sum(y for _, _, y in got) == 5 and len(got) == 15
    train = [y for i, _, y in marks if zlib.crc32(str(i).encode()) % 4 != 2]
    assert abs(weight - (train.count(0) / 10) / (train.count(1) / 5)) < 1e-9


def test_every_labelled_row_is_learned_from(spark, docs, monkeypatch):
    # A toxic word that stands late in one long text, and one in only three texts out of thousands: no sample of rows or words may miss them.
    rows, marks = labelled(400)
    free = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows += [(i, "river " * 6000 + f"rareword blorg snarf {i}", "en") for i in free[:8]]
    marks += [(i, 0, 1) for i in free[:8]]
    table = docs(rows)
    monkeypatch.setattr(toxicity, "TASK_ROWS", 50)     # several tasks, averaged
    got = toxicity.learnable(table, labels(spark, marks)).collect()
    assert len(got) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i, _, _ in marks)
    assert max(len(r.buckets) // 4 for r in got) == 6004
    classifier = toxicity.fit_all(table, labels(spark, marks))
    assert classifier.model.row_of[textcnn.bucket("rareword")] > 1
    predicted = {r.doc_id: r.predicted for r in toxicity.score(table, classifier).collect()}
    held = [(i, y) for i, _, y in marks if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(predicted[i] == y for i, y in held) / len(held) > 0.95


def test_counted_threshold_equals_that_of_rows():
    r = np.random.default_rng(3)
    y = r.random(500) < 0.3
    logits = np.round(r.normal(0, 1, 500) + y, 3)
    step = np.round(logits * toxicity.GRID).astype(np.int64)
    assert abs(toxicity.best_of_counts(step, y.astype(int), 1 - y) - toxicity.best_threshold(logits, y.astype(int), 1.0)) < 1e-9


def test_without_labels(spark, docs):
    table = docs([(1, "a b"), (2, None)])
    classifier = toxicity.fit(*toxicity.sample(table, labels(spark, [])))
    assert classifier is None
    assert {(r.score, r.predicted) for r in toxicity.score(table, classifier).collect()} == {(0.0, 0)}
    assert toxicity.score(docs([]), classifier).count() == 0


def test_threshold():
    assert 1 < toxicity.best_threshold(np.array([3.0, 2.0, 1.0, 0.0]), np.array([1, 1, 0, 0]), 1.0) < 2
    assert toxicity.best_threshold(np.array([1.0, 1.0]), np.array([1, 1]), 1.0) < 1


def test_stage(spark, docs):
    rows, marks = labelled(300)
    table = docs(rows)
    kept = toxicity.drop_toxic(table, labels(spark, marks))
    assert kept.columns == table.columns
    left = {r.doc_id for r in kept.collect()}
    clean = {i for i, _, y in marks if not y}
    assert len(left & clean) / len(clean) > 0.95 and len(left - clean) < 10


def test_texts_stay_where_they_are(spark, docs):
    # Spark shuffles all texts as soon as it takes the labels for larger than its threshold.
    rows, marks = labelled(200)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = toxicity.learnable(docs(rows), labels(spark, marks))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert got.count() == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i, _, _ in marks)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_training_tasks_drop_the_model_of_the_stage_before(spark, docs):
    # Workers live on from stage to stage, more of them than run at once; what they hold adds up.
    def hold(batches):
        tokens.held(("language", 1), lambda: bytes(1000))
        yield from batches

    def holding(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(tokens._held)] * len(b))], names=["n"])

    rows, marks = labelled(200)
    ids = spark.range(0, 64, 1, 64)
    assert ids.mapInArrow(hold, "id long").count() == 64
    assert toxicity.learnable(docs(rows).repartition(64), labels(spark, marks)).count() > 0
    assert {r.n for r in ids.mapInArrow(holding, "n long").collect()} == {0}
