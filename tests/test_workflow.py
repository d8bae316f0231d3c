"""Connectors, repository and workflow over recordings in files."""

import json

import pytest
from pyspark.sql import functions as F

from attesta.operators import report as P
from attesta.operators import resolve as V
from attesta.plans import connect as C
from attesta.plans import workflow as W
from attesta.sources import documents as D
from attesta.sources import html as H
from attesta.sources import replay as R

SF = "/root/testdata/sf0.001"


def test_recorded_search(spark, tmp_path):
    pages = [{"provider": "bing", "query": "q", "html": C.SERPS[0][1]}, {"provider": "naver", "query": "q", "html": "captcha"}]
    for k, p in enumerate(pages):
        (tmp_path / f"{k}.jsonl").write_text(json.dumps(p) + "\n")
    rows = W.replayed(spark, f"file://{tmp_path}")
    assert [(r.provider, r.rank, r.status) for r in rows.orderBy("provider", "rank").collect()] == [("bing", 1, "success"), ("bing", 2, "success"), ("naver", 0, "blocked")]
    (tmp_path / "none").mkdir()
    assert W.replayed(spark, f"file://{tmp_path}/none").count() == 0


def test_repository(spark, tmp_path):
    r = W.stored(spark, f"file://{tmp_path}/store")
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert r.available() and r.get(keys, 10.0, 5.0).count() == 0
    r.save(spark.createDataFrame([("a", "1", 1.0), ("a", "2", 8.0), ("b", "3", 1.0), ("z", "9", 9.0)], "key string, value string, at double"))
    assert [(x.key, x.value) for x in r.get(keys, 10.0, 5.0).collect()] == [("a", "2")]
    r.delete(keys.filter("key = 'a'"), 9.5)
    assert r.get(keys, 10.0, 100.0).select("key").collect()[0].key == "b" and r.get(keys, 10.0, 100.0).count() == 1
    r.compact(f"file://{tmp_path}/compact")
    assert {x.key for x in spark.read.parquet(f"{tmp_path}/compact").collect()} == {"b", "z"}


def test_verifier(spark, tmp_path):
    requests, services = C._services(spark, SF)
    requests = requests.filter("entity < 3").unionByName(spark.createDataFrame([(99, "no results", "Acme", "QQ900")], requests.schema))
    v = W.Verifier(services, W.stored(spark, f"file://{tmp_path}/v"), C.CONCEPTS)
    first = {r.entity: r for r in v.verify(requests, 100.0).collect()}
    assert not any(r.cached for r in first.values()) and first[99].profile == "[]"
    facts = {a["attribute"]: a["value"] for a in json.loads(first[1].profile)}
    assert facts["power_w"] == "1500" and facts["has_timer"] == "true"
    again = {r.entity: r for r in W.verify_products(requests, services, W.stored(spark, f"file://{tmp_path}/v"), C.CONCEPTS, 200.0).collect()}
    assert all(r.cached for r in again.values()) and {k: r.profile for k, r in again.items()} == {k: r.profile for k, r in first.items()}
    done = spark.createDataFrame([(0, True), (1, False)], "product long, success boolean")
    records = {(r.product, r.success) for r in W.run_batch(requests, done, v, 300.0, retry=True).collect()}
    assert records == {(0, True), (1, False), (1, True), (2, True), (99, False)}


def test_traces_and_baseline(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"products": [{"id": "p1", "confirmed": 3, "coverage": 0.5}]}))
    assert [tuple(r) for r in R.baseline_rows(spark, f"file://{tmp_path}/b.json").collect()] == [("p1", 3, 0.5)]
    assert R.baseline_rows(spark, f"file://{tmp_path}/none.json").count() == 0


def test_empty_tables(spark):
    """No rows give no rows, for what reads tables of its own shape."""
    pages = spark.createDataFrame([], "doc_id long, page int, text string, model string, document_type string")
    assert D.document_facts(pages).count() == 0 and D.spec_blocks(pages).count() == 0 and D.line_pairs(pages).count() == 0
    html = spark.createDataFrame([(1, None, None)], "page_id long, html string, model string")
    assert H.page_facts(html, "model").count() == 0 and H.page_text(html).first().text == "" and R.document_urls(html).count() == 0
    claims = spark.createDataFrame([], "entity long, attribute string, seq long, value string, source_url string, source_type string, authority string, confidence string, identity string, status string")
    assert V.resolve(claims).count() == 0 and V.profile_violations(V.resolve(claims).withColumn("expected", F.lit(True))).count() == 0


def test_stability_asks_for_whole_runs(spark):
    runs = spark.createDataFrame([(0, "p", 1, "ok"), (1, "p", 2, "ok"), (0, "q", 1, "ok")], "run int, product string, confirmed int, status string")
    assert P.stability(runs.filter("product = 'p'"), 2).first().spread == 1
    with pytest.raises(Exception, match="not in every run"):
        P.stability(runs, 2).collect()


def test_budget_config_and_schema(spark):
    now = [0.0]
    b = W.Budget(10, lambda: now[0])
    assert b.remaining() == 10 and b.share(3) == 3 and not b.expired()
    now[0] = 12.0
    assert b.expired() and b.share(3) == 0
    assert W.Config().providers[0] == "bing"
    for bad in ({"fetch_limit": 0}, {"cooldown": 500.0}):
        with pytest.raises(ValueError, match="limits"):
            W.Config(**bad)
    rows = W.schema_rows(spark, [W.Definition("net_weight", ("Weight", "Weight")), W.Definition("ram", level="variant_level", expected=False)])
    assert [(r.place, r.alias) for r in rows.collect()] == [(0, "net weight"), (0, "Weight"), (1, "ram")]
    with pytest.raises(ValueError, match="no valid"):
        W.Definition("x", scope="odd")
