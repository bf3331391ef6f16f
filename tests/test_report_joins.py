"""A report on couples has as many assignments as texts: nothing of them is gathered on the driver."""

from siftmark.operators import evidence, tokens
from siftmark.plans import report_queries
from siftmark.sources import programs

SF = "/root/testdata/sf0.001"


def test_a_report_sends_no_table_to_every_task(spark):
    found = report_queries.text_report(spark, SF)
    assert found.count() > 0
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_facts_of_tokens_come_in_one_go(spark):
    words = tokens.tokenize_any(programs.programs(spark, SF))
    facts = evidence._facts(words)
    rows = lambda frame: sorted(map(str, frame.collect()))
    assert rows(facts.select("assignment_id", "submission_id", "types", "names")) == rows(evidence.beginnings(words))
    assert rows(facts.select("assignment_id", "submission_id", *evidence.STRUCTURES)) == rows(evidence.structure_counts(words))
    assert rows(facts.select("assignment_id", "submission_id", "n_tokens")) == rows(words.groupBy("assignment_id", "submission_id").count().withColumnRenamed("count", "n_tokens"))
