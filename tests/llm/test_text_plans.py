"""Physical plans of the text operators."""

from __future__ import annotations

import random
import re

from brindle.llm import mixing, secret_scan
from brindle.llm.queries import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_secret_scan_stays_in_the_jvm_and_reads_two_columns(spark, small):
    text = plan(QUERIES["op3_secrets"][0](spark, small))
    assert not re.search("Python|Pandas|Arrow", text)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_index_reads_each_text_once(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    index = secret_scan.build_index(docs, ["abc", "key"], "doc_id", "text")
    assert set(index.columns) == {"gram", "id"}


def test_mixing_stays_in_the_jvm(spark, small):
    text = plan(mixing.take_plan(spark.read.parquet(f"{small}/documents.parquet")))
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", text)


def test_release_leaves_no_catalog_entry(spark):
    from brindle.llm.tables import stage_bucketed

    kept = stage_bucketed(spark.range(10), "catalog", "id")
    assert kept.count() == 10 and any(t.name.startswith("catalog_") for t in spark.catalog.listTables())
    # only this table's entry and files: other tests still read theirs
    from brindle import storage

    app = spark.conf.get("spark.app.id")
    paths, names = storage._WRITTEN[app], storage._NAMED[app]
    storage._WRITTEN[app], storage._NAMED[app] = paths[-1:], names[-1:]
    assert storage.release(spark) == 1
    storage._WRITTEN[app], storage._NAMED[app] = paths[:-1], names[:-1]
    assert not any(t.name.startswith("catalog_") for t in spark.catalog.listTables())


def test_a_turn_of_the_component_search_shuffles_four_times(spark, monkeypatch):
    from brindle.llm import components as search

    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 240)] + [(i, 299) for i in range(260, 299)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)] + [(7, 7), (101, 100), (100, 101)]
    turns = []

    def held(df, label, put=search.stage):
        turns.append(plan(df).count("Exchange hashpartitioning"))
        return put(df, label)

    monkeypatch.setattr(search, "stage", held)
    wide = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = [tuple(r) for r in search.components(spark.createDataFrame(edges, "a long, b long")).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", wide)
    root = {i: i for e in edges if e[0] != e[1] for i in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert sorted(found) == sorted(root.items())
    assert len(turns) > 2 and turns[0] == 1 and max(turns) <= 4
