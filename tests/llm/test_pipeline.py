import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__ as entry
from exactdiff.llm import ngram_join


def test_every_operator_has_its_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_stages(spark, table, prose, tmp_path):
    base = prose(60, punctuation=False)
    rows = [(i, prose(50, lang), lang, f"s{i % 3}") for i, lang in enumerate(["en", "de", "fr"] * 15)]
    rows += [(100, base, "en", "s0"), (101, base + " tail", "en", "s1"), (102, base, None, None), (103, "123 456 !!!", "en", "s0"), (104, None, "en", "s0"), (105, "Write to jane [at] example [dot] com or a@b.cc now", "en", "s0"), (106, base, "en", "s2"), (106, base, "en", "s2")]
    docs = table(rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "ngram_join", "pii", "mixing", "packing"]
    one = stages["language_id"](spark, docs, str(tmp_path))
    gone = {r[0] for r in rows} - {r.doc_id for r in one.collect()}
    assert gone == {103, 104} and one.columns == docs.columns and one.where("lang is null").count() == 0
    two = stages["ngram_join"](spark, docs, str(tmp_path))
    kept = [r.doc_id for r in two.collect()]
    want = {r.component_id for r in ngram_join.join_components(docs).collect()}
    assert sorted(kept) == sorted(want) and 100 in kept and not {101, 102, 106} & set(kept)
    three = stages["pii"](spark, docs, str(tmp_path)).where("doc_id = 105").first()
    assert three.text == "Write to [EMAIL] or [EMAIL] now" and three.n_chars == len(three.text)
    four = stages["mixing"](spark, docs, str(tmp_path))
    assert four.columns == docs.columns and 0 < four.count() < len(rows)
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert pieces.where(F.col("length") > 4096).count() == 0 and pieces.count() > 0


def test_repeated_rows_stay_once(spark, table):
    docs = table([(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "z y x w v u t"), (None, "a b c d e f g"), (2, "")])
    found = corpus_pipeline.deduplicate(spark, docs, "")
    assert sorted((r.doc_id or 0, r.text) for r in found.collect()) == [(0, "a b c d e f g"), (1, "a b c d e f g"), (1, "z y x w v u t"), (2, "")]


def test_workers_get_small_batches(spark, table):
    from exactdiff.llm.common import BATCH_KEY, small_batches

    rows = spark.range(0, 6000, 1, 1).selectExpr("id as doc_id", "repeat('word ', 500) as text")
    size = lambda: max(r.n for r in rows.mapInArrow(lambda batches: (b.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect())
    before = spark.conf.get(BATCH_KEY, None)
    try:
        spark.conf.unset(BATCH_KEY)
        corpus_pipeline.redact(spark, table([(1, "a")]), "")
        assert size() < 6_000_000
        spark.conf.set(BATCH_KEY, "32m")
        small_batches(spark)
        assert size() > 10_000_000  # a size of the session's own stays
    finally:
        spark.conf.unset(BATCH_KEY) if before is None else spark.conf.set(BATCH_KEY, before)


def test_few_rows_take_few_tasks(spark, table, prose):
    """The driver keeps a record of each task, whatever its rows."""
    texts = [prose(60, punctuation=False) for _ in range(6)]
    docs = table([(10 * i + k, " ".join([*text.split(), *["tail"] * k])) for i, text in enumerate(texts) for k in range(5)])
    held = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    tracker = spark.sparkContext.statusTracker()
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("few", "few")
        kept = sorted(r.doc_id for r in corpus_pipeline.deduplicate(spark, docs, "").collect())
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert kept == [0, 10, 20, 30, 40, 50]
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("few") for s in tracker.getJobInfo(j).stageIds]
    assert 0 < sum(s.numCompletedTasks for s in stages if s) < 3_500  # 4,761 when small tables kept all shuffle partitions
