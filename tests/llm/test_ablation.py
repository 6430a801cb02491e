"""The ablation query covers every rule of the ledger."""

from tallyweave.llm import quality, queries


def test_ablation_has_every_rule(spark, tmp_path):
    insults = "In the debate one speaker called the other an idiot and a moron, and the chair asked both of them to keep to the question that the meeting had been called for."
    spark.createDataFrame([(1, insults), (2, "short"), (3, "an idiot"), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["rule"]: (r["n_failed"], r["n_only"]) for r in queries.ledger_ablation(spark, str(tmp_path)).collect()}
    assert set(found) == set(quality.RULES)
    assert found["insults"] == (2, 1) and found["few_words"] == (3, 2)
