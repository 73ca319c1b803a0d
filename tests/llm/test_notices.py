"""Several licence notices in one file."""

from __future__ import annotations

from itertools import combinations

from commitlake.llm import licenses


def test_every_notice_of_a_file(spark):
    notices = {label: text for label, text, _ in licenses.TEMPLATES}
    groups = [("apache", "cc-by-nc", "gpl"), ("cc-by-sa", "gpl", "apache"), tuple(notices), *combinations(notices, 2)]
    texts = [" filler words between ".join(notices[x] for x in g) for g in groups]
    texts.append(notices["apache"] + " gnu public cc nc 2 4 lesser redistribution mozilla permission")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    for i, group in enumerate([*groups, ("apache",)]):
        assert set(group) <= set(rows[i]["labels"].split(",")) and set(group) <= {n["label"] for n in rows[i]["notices"]}
        assert rows[i]["score"] == 1.0


def test_offsets_are_counted_in_the_row(spark):
    """Hits go through no exchange, so that what is shuffled does not grow with them."""
    df = spark.createDataFrame([(i, text) for i, (_, text, _) in enumerate(licenses.TEMPLATES)], "doc_id long, text string")
    found = licenses.scan(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert all(r["labels"] and r["score"] == 1.0 for r in found.collect())
