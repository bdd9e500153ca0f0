"""Rows that the other tests leave out: shards of one more by brute force, hot ids, long payloads, repeated pages, long URLs."""

import hashlib
import math
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from strata.llm import hash_tree, poisson_mix, redirects, warc_index


def _shard(key, root):
    number, nodes = {}, [root]
    for node in nodes:
        nodes += node.children
    number = {node.name: n for n, node in enumerate(nodes)}
    node = root
    while node.children:

        def cost(c):
            h = 42 if key is None else xxhash.xxh64_intdigest(key.encode(), seed=42)
            h = xxhash.xxh64_intdigest(c.name.encode(), seed=h)
            return -math.log(((h >> 11) + 0.5) / (1 << 53)) / c.weight, number[c.name]

        node = min(node.children, key=cost)
    return node.shard


def test_shards_and_one_more_by_brute_force(spark):
    rows = [(i * 37 if i else None, f"t{i}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    moved = 0
    for r in hash_tree.place(df, 24, grown=True).collect():
        key = None if r["doc_id"] is None else str(r["doc_id"])
        assert (r["shard"], r["grown_shard"]) == (_shard(key, hash_tree.tree(24)), _shard(key, hash_tree.tree(25)))
        assert r["grown_shard"] in (r["shard"], 24)
        moved += r["grown_shard"] == 24
    assert 0 < moved < 100


def test_rows_of_one_id_are_numbered_in_several_groups(spark, monkeypatch):
    monkeypatch.setattr(hash_tree, "GROUP_ROWS", 10)
    df = spark.range(4000).selectExpr("7L AS doc_id", "concat('text ', id % 1500) AS text")
    out = hash_tree.place(df, 24)
    assert sorted(r["slot"] for r in out.select("slot").collect()) == list(range(4000))
    mixed = poisson_mix.mix(df.withColumn("source", F.lit("s")).drop("n"), budget=9000)
    # One doc_id has one count, and its rows lie in many partitions.
    assert mixed.groupBy("text", "copy").count().select("count").distinct().count() <= 2
    if mixed.count():
        assert mixed.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_archives_of_long_payloads_and_repeated_pages(spark):
    long = "é long\r\n\r\nWARC/1.1 " * 200_000
    pages = [
        (1, "http://a.org/1", long), (2, "http://a.org/2", long), (2, "http://a.org/2", long), (1, "http://a.org/1", long),
        (3, "http://a.org/3", "y" * 150), (3, "http://a.org/3", "z" * 150), (4, "http://a.org/4", "z" * 150), (5, None, "s"), (5, None, "s"),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    rows = warc_index.captures(df).collect()
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows)

    def row(page, html, kind, to):
        data = html.encode()
        return (page, len(data), hashlib.sha256(data).hexdigest(), kind, to)

    assert got == Counter({
        row(1, long, "response", None): 2, row(2, long, "revisit", 1): 2, row(3, "y" * 150, "response", None): 1,
        row(3, "z" * 150, "response", None): 1, row(4, "z" * 150, "revisit", 3): 1, row(5, "s", "response", None): 2,
    })


def test_long_urls(spark):
    long = "http://example.com/de/" + "p/" * 50_000 + "?" + "q=1&" * 20_000
    pages = [(1, long, ""), (2, "http://e.io/x", f"<link rel=canonical href='{long}'>"), (3, "http://" + "h" * 60_000, None)]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in redirects.judge(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got == {1: ("example.com/de/", "block"), 2: (None, "block"), 3: (None, "allow")}
