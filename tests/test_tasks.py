"""Tasks stay of one size however large the tables are."""

import pytest

from lexweave.plans.base import Source
from lexweave.session import SHUFFLE_SHARE, TASK_BYTES, fit_tasks, in_bytes

SPLIT, ADVISED = "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
FIRST = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def test_sizes_are_read():
    assert [in_bytes(x) for x in ("16m", "64MB", "134217728b", "5", "1GiB", "64k")] == [16 << 20, 64 << 20, 128 << 20, 5, 1 << 30, 64 << 10]


def test_tasks_do_not_grow_with_the_tables(spark):
    held = {c: spark.conf.get(c, None) for c in (SPLIT, ADVISED, FIRST)}
    try:
        spark.conf.set(SPLIT, "128MB")
        spark.conf.set(ADVISED, "1m")
        Source(spark, "/root/testdata/sf0.001").lineitem
        assert in_bytes(spark.conf.get(SPLIT)) == TASK_BYTES and spark.conf.get(ADVISED) == "1m"
        usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert int(spark.conf.get(FIRST)) == usual
        fit_tasks(spark, 10_000 * SHUFFLE_SHARE)
        assert int(spark.conf.get(FIRST)) == 10_000
    finally:
        for c, v in held.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)


def test_words_of_postings_are_not_shuffled(spark):
    from lexweave.plans import QUERIES

    plan = QUERIES["postings"](spark, "/root/testdata/sf0.001")
    assert plan._jdf.queryExecution().sparkPlan().toString().count("Exchange") <= 1
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


@pytest.mark.parametrize("name", ["resolve_as_of", "provisions_as_of", "annotate_temporal", "explain", "attach_evidence"])
def test_history_is_made_once(spark, name):
    from lexweave.plans import QUERIES

    # What reads the history finds it made: it hashes no text again.
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "sha2(" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_evidence_reads_the_texts_of_named_laws(spark, monkeypatch):
    from lexweave.plans import matters

    made = {}
    for name in ("spans", "arrived_wording"):
        monkeypatch.setattr(matters, name, lambda *of, make=getattr(matters, name), name=name: made.setdefault(name, make(*of)))
    src = Source(spark, "/root/testdata/sf0.001")
    matters.evidence(src)
    of = {name: {r.law for r in df.select("law").distinct().collect()} for name, df in made.items()}
    named = {r.law for r in src.answer_results.selectExpr("split_part(substr(canonical_ref, 5), '-art-', 1) AS law").where("canonical_ref LIKE 'law-%'").collect()}
    there = {r.law for r in src.law_source.select("law").distinct().collect()}
    assert of["spans"] == of["arrived_wording"] == named & there and there - named
    # One version is in force on the date of a query; the other versions of its law are not split.
    split, kept = (made[name].select("version_id").distinct().count() for name in ("arrived_wording", "spans"))
    assert split <= src.answer_results.where("canonical_ref LIKE 'law-%'").count() < kept


def test_judgments_of_evidence_are_cut_by_many_tasks(spark, monkeypatch):
    from lexweave.plans import matters

    from lexweave.operators import structure

    kept = []
    monkeypatch.setattr(structure, "stored", lambda df, store=structure.stored: kept.append(df) or store(df))
    monkeypatch.setattr(matters, "SPREAD_ROWS", 5)
    src = Source(spark, "/root/testdata/sf0.001")
    n = -(-src.conversations.count() // 5)
    made = matters.named_paragraphs(src)
    assert n > 8 and f"Repartition {n}" in kept[0]._jdf.queryExecution().optimizedPlan().toString()
    # Their lines are read again, the texts are not cut again.
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(repr, made.collect())) == sorted(map(repr, matters.paragraphs(src).withColumnRenamed("case_id", "canonical_id").collect()))


def test_wording_of_evidence_has_small_tasks(spark, monkeypatch):
    from lexweave.plans import documents

    monkeypatch.setattr(documents, "SPREAD_ROWS", 50)
    src = Source(spark, "/root/testdata/sf0.001")
    wording, n = documents.arrived_wording(src), -(-src.orders.count() // 50)
    assert wording.rdd.getNumPartitions() == n > 8
    # Orders are shuffled there, not the texts made of them.
    below = wording._jdf.queryExecution().optimizedPlan().toString().split("Repartition ")[1]
    assert "preamble" not in below and "o_comment" not in below.splitlines()[1]
