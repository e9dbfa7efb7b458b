"""Every registered query of the subpackage on small tables: against its SQL, or what it derives from its operator."""

import math
import zlib

import duckdb
import pytest
from test_edges import BENCH, TEXTS, capacity, prose, removed

from lexispark.llm import registry


@pytest.fixture(scope="module")
def at(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", "web", len(t or "")) for i, t in dict((i, t) for i, t in TEXTS if i is not None).items()]
    rows += [(100 + k, prose(50, 3000 + k) + " scumbag" * (k % 3 == 0) + " " + prose(20, k), "de", ("a", None)[k % 2], None) for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([b for b in BENCH if b[0] is not None], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(100 + k, 1, int(k % 3 == 0)) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    turns = [(1, 0, "user", 'a <b> "c" \\'), (1, 1, "assistant", None), (2, 0, "assistant", "</turn>"), (2, 1, None, "x\n"), (3, 0, "user", "é" * 5000)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return str(at), {r[0]: r[1] for r in rows}


def same(x, y):
    return x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=2e-6)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, at, name):
    got = registry.queries()[name](spark, at[0])
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{at[0]}/{t}.parquet/*.parquet'")
    want = c.execute(f"select {', '.join(got.columns)} from ({registry.oracle_sql()[name]})").fetchall()
    mine = [tuple(r) for r in got.collect()]
    assert len(mine) == len(want) and all(same(x, y) for a, b in zip(sorted(mine, key=repr), sorted(want, key=repr)) for x, y in zip(a, b))
    if name.startswith("op4"):
        assert {r.conv_id: r.n_turns for r in got.collect()}[-7] == 2


def test_without_sql(spark, at):
    path, texts = at
    run = lambda n: [r.asDict() for r in next(f for k, f in registry.queries().items() if k.startswith(n))(spark, path).collect()]
    shards = run("op6_")
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in shards) == sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts.items())
    groups, loads = {}, {}
    for i, t in texts.items():
        groups[t or ""] = groups.get(t or "", 0) + len((t or "").encode()) + 16
    for r in shards:
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
    order = sorted(groups, key=lambda t: min(i for i, x in texts.items() if (x or "") == t))
    assert max(loads.values()) == capacity([groups[t] for t in order], 40) and {r["law"] for r in shards} == {"bytes"} and {r["grown_shard"] for r in shards} == {None}

    import hashlib

    want = [(i, n, m, k, hashlib.sha256(b).hexdigest()) for i, n, m, k, b in removed(list(texts.items()), 200)]
    assert sorted(tuple(r.values()) for r in run("op9_")) == sorted(want)

    passages = {r["doc_id"]: r for r in run("op8_")}
    assert set(passages) == set(texts) and passages[2]["n_removed_words"] == passages[2]["n_words"] == passages[2]["n_shared_words"] and passages[2]["class_id"] == 1
    assert all(r["has_repeat"] == (r["n_passages"] > 0) == (r["n_links"] > 0) == (r["n_shared_words"] > 0) and 0 <= r["n_removed_words"] <= r["n_shared_words"] <= r["n_words"] for r in passages.values())

    toxic = {r["doc_id"]: r for r in run("op10_")}
    assert set(toxic) == set(texts)
    for i, r in toxic.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    # So few labelled rows also teach words of chance; accuracy is tested on more.
    assert all(toxic[100 + k]["predicted"] for k in range(0, 40, 3)) and sum(toxic[100 + k]["predicted"] for k in range(40) if k % 3) < 13
