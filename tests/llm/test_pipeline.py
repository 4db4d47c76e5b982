import random
import zlib
from array import array
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from patchlore.llm import language, lines, neardup, packing, tokens, toxicity
from tests.llm.test_neardup import brute as brute_classes
from tests.llm.test_toxicity import labelled


@pytest.fixture
def corpus(spark, docs, tmp_path):
    rows, marks = labelled(160)
    rows = [(i, t + f"\nFollow us\nand {i} more words to tell this text from any other one {i * 7}", lang, "h") for i, t, lang in rows]
    rows += [(1000, None, "en", "h"), (1001, "12 34", "en", "h"), (1002, "", "en", None), (1003, rows[1][1], "en", "h"), (1004, rows[1][1] + " end", "en", "h")]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows


def repeated_lines(pages):
    """Lines on more of a host's pages than the rule of the pipeline allows."""
    on, total = defaultdict(set), defaultdict(set)
    for text, host in pages:
        total[host].add(text)
        for x in text.split("\n"):
            on[host, x.strip(" \t\r")].add(text)
    r, bad = lines.REPEATED, set()
    for (host, x), where in on.items():
        short = len(x) < lines.SHORT_CHARS and len(x.split(" ")) <= lines.SHORT_WORDS
        if x and len(where) >= (r.short_pages if short else r.pages) and len(where) > (r.short_ratio if short else r.ratio) * len(total[host]):
            bad.add((host, x))
    return bad


def test_near_copies_on_a_small_host_keep_their_article(spark, docs, tmp_path):
    """Three near copies are three of a hundred pages, yet what they share is no boilerplate; the host's own footer is."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    article = "\n".join(" ".join(word() for _ in range(12)) for _ in range(12))
    footer = "the footer that stands below every page of this host"
    rows = [(i, f"{article}\ncopy number {i}\n{footer}", "en", "small.example") for i in range(3)]
    rows += [(10 + i, " ".join(word() for _ in range(40)) + f"\n{footer}", "en", "small.example") for i in range(97)]
    table = docs(rows)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    left = {x.doc_id: x.text for x in stages["near_dedup"](spark, stages["line_dedup"](spark, table, str(tmp_path)), str(tmp_path)).collect()}
    assert len(left) == 98 and left[0] == f"{article}\ncopy number 0" and not any(footer in t for t in left.values())


def test_run_equals_stages_by_hand(spark, corpus):
    """Model decisions taken from the operators; everything between and after them by plain Python."""
    sf, rows = corpus
    table = spark.read.parquet(f"{sf}/documents.parquet")
    langs, model = language.train(table.filter(~language.held_out(table.doc_id)))
    known = {r.doc_id for r in language.identify(table, langs, model).collect() if r.lang_pred != "und" and r.score >= language.LEAST_SCORE}
    assert known >= {i for i, *_ in rows if i < 1000} and not known & {1000, 1001, 1002}
    left = [r for r in rows if r[0] in known]
    one = table.filter(table.doc_id.isin(list(known)))
    classifier = toxicity.fit(*toxicity.sample(one, spark.read.parquet(f"{sf}/labels.parquet")))
    clean = {r.doc_id for r in toxicity.score(one, classifier).collect() if r.predicted == 0}
    left = [r for r in left if r[0] in clean]
    first = {i for (i, head) in brute_classes([r[:2] for r in left]) if i == head}
    bad = repeated_lines([(t, h) for i, t, _, h in left if i in first])
    texts = [(i, "\n".join(x for x in t.split("\n") if (h, x.strip(" \t\r")) not in bad)) for i, t, _, h in left]
    assert all("Follow us" not in t for _, t in texts)
    heads = {i for (i, head) in brute_classes(texts) if i == head}
    texts = [(i, t) for i, t in texts if i in heads]
    want, enc = Counter(), tokens.encoder()
    for i, t in texts:
        ids = array("I", enc.encode([t], tokens.END_ID).ids.tolist())
        for k in range(0, len(ids), packing.CAPACITY):
            want[i, k // packing.CAPACITY, len(ids[k:k + packing.CAPACITY]), zlib.crc32(ids[k:k + packing.CAPACITY].tobytes())] += 1
    got = corpus_pipeline.run(spark, sf)
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got.collect()) == want
    assert neardup.SIMILARITY == 0.8


def test_stages_return_the_columns_of_documents(spark, corpus):
    sf, _ = corpus
    table = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, sf).columns == table.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "line_dedup", "near_dedup", "packing"]


def test_empty_table(spark, docs, tmp_path):
    docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__ as entry
    assert {f"op{i}_" for i in range(1, 14)} == {n.split("_")[0] + "_" for n in entry.queries() if n[:2] == "op" and n[2].isdigit()} and "pipeline" in entry.queries()
