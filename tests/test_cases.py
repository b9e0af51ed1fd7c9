"""Small hand-worked cases."""

from __future__ import annotations

import datetime
import hashlib
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tesserae import catalog
from tesserae.functions import scalars
from tesserae.functions.scalars import checked, jaro_winkler, jaro_winkler_batch, jaro_winkler_of, mod97, strip_accents
from tesserae.functions.sql import define_functions, set_variables
from tesserae.operators import codelists, fingerprint, gates, joins, lineage, packages, profile, reshape, resolution, trending, windows
from tesserae.sources import readers, sinks


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_resolution(spark):
    left = spark.createDataFrame([("1", "Acme Corp."), ("2", "Beta Inc"), ("3", "Gamma Widgets Factory"), ("4", None), ("5", " "), ("6", "The Delta House"), ("7", "AB"), ("8", "Epsilon Ltd")], "uid string, name string")
    right = spark.createDataFrame(
        [
            ("a", "ACME CORPORATION", "US-DE", "US", "ISSUED"),
            ("b", "ACME", "US-DE", "US", "LAPSED"),
            ("c", "BETA", "US-NY", "US", "ISSUED"),
            ("d", "Beta Company", "US-DE", "US", "ISSUED"),
            ("e", "Gamma Widgets Factorx", "DE", "DE", "ISSUED"),
            ("f", "Delta House", "FR", "FR", "RETIRED"),
            ("g", "ab", None, None, "ISSUED"),
            ("h", "Epsilon", "US-DE", "US", "PENDING"),
        ],
        "uid string, legal_name string, jurisdiction string, country string, reg_status string",
    )
    out = {r["l_uid"]: (r["r_uid"], r["method"], r["status"]) for r in resolution.resolve(left, right).collect()}
    assert out["1"] == ("a", "exact_name", "confirmed")
    assert out["2"] == ("c", "exact_name", "ambiguous")
    assert out["3"] == ("e", "jaro_winkler", "candidate")
    assert out["7"] == ("g", "exact_name", "confirmed")
    assert not {"4", "5", "8"} & set(out)
    again = resolution.resolve(left.repartition(7), right.repartition(1))
    assert {r["l_uid"]: (r["r_uid"], r["method"], r["status"]) for r in again.collect()} == out


def test_options_are_closed():
    with pytest.raises(ValueError, match="unknown"):
        resolution.ResolveConfig.of(threshold=1)


def test_jaro_winkler_values():
    assert jaro_winkler_of("MARTHA", "MARHTA") == pytest.approx(0.9611111111)
    assert jaro_winkler_of("DIXON", "DICKSONX") == pytest.approx(0.8133333333)
    assert jaro_winkler_of("", "a") == 0 and jaro_winkler_of("a", "a") == 1


def plain_jaro_winkler(a: str, b: str) -> float:
    """Character by character."""
    if a == b:
        return 1.0
    reach, free, mine = max(max(len(a), len(b)) // 2 - 1, 0), list(range(len(b))), []
    for i, c in enumerate(a):
        if (j := next((j for j in free if abs(i - j) <= reach and b[j] == c), None)) is not None:
            free.remove(j)
            mine.append(c)
    m, theirs = len(mine), [c for j, c in enumerate(b) if j not in free]
    if not m:
        return 0.0
    jaro = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(mine, theirs)) // 2) / m) / 3
    prefix = next((k for k in range(4) if k >= min(len(a), len(b)) or a[k] != b[k]), 4)
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def test_jaro_winkler_of_a_batch(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé日 ") for _ in range(rng.choice([0, 1, 2, 5, 9, 30, 200])))
    a = [word() for _ in range(400)]
    b = [x[::-1] if k % 3 == 0 else x[:-1] + "b" if k % 3 == 1 else word() for k, x in enumerate(a)]
    assert jaro_winkler_batch(a, b).tolist() == pytest.approx([plain_jaro_winkler(x, y) for x, y in zip(a, b)])
    assert not len(jaro_winkler_batch([], []))
    df = spark.createDataFrame([("MARTHA", "MARHTA"), (None, "a"), ("a", None)], "a string, b string")
    assert [r[0] for r in df.select(jaro_winkler(F.col("a"), F.col("b"))).collect()] == [pytest.approx(0.9611111111), None, None]


def test_ranges_of_any_width(spark):
    rng = random.Random(4)
    ranges = [(lo := rng.randint(-(10**6), 10**6), lo + rng.choice([0, 1, 7, 1000, 10**9]), f"r{k}") for k in range(40)] + [(-(1 << 62), 1 << 62, "all"), (5, 4, "none")]
    keys = [rng.randint(-(10**6), 2 * 10**6) for _ in range(200)] + [None, 1 << 62, -(1 << 63)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    r = spark.createDataFrame(ranges, "lo long, hi long, v string")
    want = [(k, min(((lo, v) for lo, hi, v in ranges if k is not None and lo <= k <= hi), default=(0, None))[1]) for k in keys]
    assert rows(joins.covering_range(df, "k", r, "lo", "hi", "v", "found"), "k", "found") == sorted(want, key=str)
    assert joins.covering_range(df, "k", r.limit(0), "lo", "hi", "v", "found").filter("found IS NOT NULL").count() == 0


def test_hot_blocks_keep_their_pairs(spark):
    left = spark.createDataFrame([(k, "x" if k < 30 else str(k), None if k % 5 == 0 else "y") for k in range(60)], "id int, a string, b string")
    rules = [["a"], ["a", "b"], ["b"]]
    plain = rows(joins.block_pairs(left, left, rules, "id", "id"), "l_id", "r_id")
    assert rows(joins.block_pairs(left, left, rules, "id", "id", hot=5, salts=4), "l_id", "r_id") == plain and len(plain) == len(set(plain))


def test_run_history(spark):
    runs = spark.createDataFrame([("r", [("a", "done"), ("b", "skipped")]), ("s", [])], "run_id string, steps array<struct<step: string, state: string>>")
    assert rows(lineage.run_history(runs), "run_id", "step", "state", "seconds", "skip_reason") == [("r", "a", "done", None, None), ("r", "b", "skipped", None, None)]
    assert lineage.run_edges(lineage.run_history(runs)).count() == 0


def test_checked_values(spark):
    df = spark.createDataFrame([(1,), (-1,)], "v int")
    assert df.filter("v > 0").select(checked(F.col("v"), F.col("v") > 0, "too small")).first()[0] == 1
    with pytest.raises(Exception, match="too small: -1"):
        df.select(checked(F.col("v"), F.col("v") > 0, "too small")).collect()


def test_archives_are_bounded(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("big.txt", "x" * 1000)
        z.writestr("small.txt", "y")
    assert rows(readers.read_archive_members(spark, str(tmp_path / "a.zip"), pattern="txt", most_bytes=1000), "member", "bytes") == [("big.txt", 1000), ("small.txt", 1)]
    with pytest.raises(Exception, match="more than 999 bytes"):
        readers.read_archive_members(spark, str(tmp_path / "a.zip"), ["big.txt"], most_bytes=999).collect()
    with pytest.raises(ValueError):
        readers.read_archive_members(spark, str(tmp_path / "a.zip"))


def test_level_probabilities(spark):
    df = spark.createDataFrame([(1.0,), (0.96,), (0.93,), (0.9,), (0.5,), (None,)], "s double")
    p = resolution.fs_probability(resolution.fs_weight(resolution.level_of(F.col("s"))))
    assert [r[1] for r in df.select("s", p).collect()] == pytest.approx([0.999876, 0.991817, 0.801603, 0.168067, 0.000202, 0.01], abs=1e-6)


def test_mod97(spark):
    ids = ["529900T8BM49AURSDO55", " 529900t8bm49aursdo55 ", "6GG1425B5X0SPG36P158", "0" * 20, "52990!", None, ""]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i string").select(mod97(F.col("i"))).collect()]
    assert got[:2] == [1, 1] and got[2] != 1 and got[3] == 0 and got[4:] == [None, None, None]


def test_accents(spark):
    df = spark.createDataFrame([("Société Générale ßŁø é",)], "s string")
    assert df.select(strip_accents(F.col("s"))).first()[0] == "Societe Generale ßŁø e"


def test_links(spark):
    html = '<a href="/r">a</a><a HREF=\'rel?x\'>b</a><a href="//h/p">c</a><a href="mailto:x@y">d</a><a href="#f">e</a><a href="">f</a><a href="/r">g</a>'
    pages = spark.createDataFrame([(1, "https://e.org/dir/page.html?q=/x#z", html), (2, "https://e.org", '<a href="x">'), (3, None, '<a href="x">')], "page_id long, url string, html string")
    got = rows(readers.discover_links(pages), "page_id", "rank", "link")
    assert got == [(1, 1, "https://e.org/r"), (1, 2, "https://e.org/dir/rel?x"), (1, 3, "https://h/p"), (1, 4, "mailto:x@y"), (2, 1, "https://e.org/x")]


def test_code_lists(spark):
    raw = spark.createDataFrame([("31-33", "Manufacturing"), ("11", "Farms"), ("111", "CropsT"), ("311", "Food Manufacturing"), ("1111", "Grain"), ("11111", "Soy"), ("111110", "Soybean Farming")], "code string, title string")
    got = {r["code"]: (r["title"], r["level"], r["parent"]) for r in codelists.industry_list(raw, "2025-01-01").collect()}
    assert got["311"] == ("Food Manufacturing", 2, "31-33") and got["31-33"] == ("Manufacturing", 1, None)
    assert got["111"] == ("Crops", 2, "11") and got["111110"] == ("Soybean Farming", 5, "11111")
    icd = spark.createDataFrame([("A00", "Cholera"), ("S02", "x"), ("S020", "y"), ("S020XXA", "z")], "code string, title string")
    assert {r["code"]: (r["level"], r["parent"]) for r in codelists.diagnosis_list(icd).collect()}["S020XXA"] == (5, "S020")


def test_trend_guards(spark):
    df = spark.createDataFrame([("a", 300, 900), ("b", 300, 900), ("c", None, 10)], "name string, d30 int, d90 int")
    got = {r["name"]: (r["trend_index"], r["d30_scaled"]) for r in trending.trend_measures(df).collect()}
    assert got["a"] == (1.0, 0.0) and got["c"] == (0.0, 0.0)


def test_gates(spark):
    df = spark.createDataFrame([("a", "x", 1, [1]), ("b", None, 2, [2]), ("a", "xyz\n", 3, [3])], "k string, v string, n int, l array<int>")
    report = {r["column_name"]: (r["total"], r["rejects"], r["sample_message"]) for r in gates.validate_contract(df, {"properties": {"k": {"enum": ["a"]}, "v": {"pattern": "^[a-z]+$", "maxLength": 3}, "n": {"minimum": 5}, "l": {}}}).collect()}
    assert report["k"] == (3, 1, "b: not in the list") and report["v"][:2] == (2, 1) and report["n"][:2] == (3, 0)
    assert report["l"] == (0, 0, "skipped: nested")
    with pytest.raises(gates.GateError, match="n_rows=2"):
        gates.enforce(gates.duplicate_keys(df, ["k"]), "keys")
    with pytest.raises(gates.GateError, match="no such columns: zz"):
        gates.check_keys(df, ["zz"])
    child = spark.createDataFrame([(1,), (99,), (None,)], "id int")
    parent = spark.createDataFrame([(1,)], "id2 int")
    assert joins.fk_orphans(child, parent, "id", "id2").count() == 1
    assert joins.fk_orphans(child, parent, "id", "id2", count_nulls=True).count() == 2
    found, review = joins.check_foreign_keys({"c": child, "p": parent}, [{"child": "c", "child_key": "id", "parent": "p", "parent_key": "id2", "status": s} for s in ("accepted", "proposed")])
    assert len(found) == 1 and review == ["c.id->p.id2"]


def test_describe(spark):
    df = spark.createDataFrame([("20240101", "2024-01-01", "a@b.co"), ("20240102", "2024-01-02", None)], "n string, d string, e string")
    kinds = {r[0]: r[1] for r in rows(profile.infer_semantic_types(df), "column_name", "semantic_type")}
    assert kinds == {"n": "integer", "d": "date", "e": "email"}
    with pytest.warns(UserWarning, match="zz"):
        out = json.loads(profile.describe(df, "t", {"fields": {"n": {"type": "code"}, "zz": {}}, "primaryKey": ["n"], "engine": "other"}))
    assert out["resources"][0]["schema"]["fields"][0]["type"] == "code" and out["engine"] == profile.ENGINE
    with pytest.raises(gates.GateError):
        profile.describe(df, "t", {"primaryKey": ["gone"]})


def test_debounce(spark):
    log = [("k", 0, "a", "save"), ("k", 5, "a", "save"), ("k", 15, "b", "save"), ("k", 26, "c", "save"), ("k", 30, "d", "checkpoint"), ("k", 35, "e", "save"), ("k", 45, "f", "save")]
    df = spark.createDataFrame(log, "key string, s long, state string, kind string").withColumn("ts", F.timestamp_seconds("s"))
    assert [r[0] for r in rows(fingerprint.debounce(df, "key", "ts", "state", "kind"), "state")] == ["a", "b", "c", "d", "f"]


def test_fingerprints(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "k int, v string")
    one = lambda d: fingerprint.table_fingerprint(d).first()["fingerprint"]
    assert one(a) == one(a.repartition(3).select("v", "k")) != one(b)
    assert one(a.limit(0)) == one(a.limit(0))
    assert rows(reshape.rowset_diff(a, b), "k", "n_a", "n_b") == [(1, 2, 1), (2, 1, 2)]


def test_closure_and_redaction(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("x", "y")], "parent string, child string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert rows(lineage.downstream(edges, seeds), "node") == [("b",), ("c",), ("d",)]
    assert lineage.downstream(edges.limit(0), seeds).count() == 0
    text = '{"api_key": "a", "x": {"Auth": 1, "k": "v"}, "password": {"p": 1}, "harmless": "token"}'
    got = json.loads(spark.createDataFrame([(text,)], "j string").select(lineage.redact_json(F.col("j"))).first()[0])
    assert got == {"api_key": lineage.REDACTED, "x": {"Auth": lineage.REDACTED, "k": "v"}, "password": lineage.REDACTED, "harmless": "token"}
    deep = lambda t: lineage.redacted_text(t)
    assert deep('{"password":{"a":{"b":"leak"}}}') == deep('{"password":[[1,"leak"]]}') == '{"password":"***REDACTED***"}'
    assert deep('[{"tok\\u0065n": "}\\"leak"}, "secret", {"a": {"AccessToken" :null}}]') == '[{"tok\\u0065n": "***REDACTED***"}, "secret", {"a": {"AccessToken" :"***REDACTED***"}}]'
    assert deep("token=leak") is None and deep('{"token": ') is None and deep("[" * 100_000) is None and deep(' {} ') == " {} "
    line = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(20)], "parent string, child string")
    assert lineage.downstream(line, spark.createDataFrame([("n0",), (None,)], "node string")).count() == 20


def test_ranks_are_layout_free(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    order = [F.col("v").desc(), F.col("id")]
    assert rows(windows.rank_global(df.repartition(1), order), "id", "rank") == rows(windows.rank_global(df.repartition(7), order), "id", "rank")


def test_export_metadata(spark, tmp_path):
    df = spark.range(10).withColumn("s", F.lit("x"))
    sinks.export_parquet(df, str(tmp_path / "out"), ["id"], metadata={"b": "2", "a": "1"}, single_file=True)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.schema["id"].metadata == {"a": "1", "b": "2"} and [r["id"] for r in back.collect()] == list(range(10))


def test_csv_nulls(spark):
    df = spark.createDataFrame([(1, 'a"b', None)], "k int, s string, n string")
    assert sinks.csv_line(df).first()["line"] == '1,"a""b",'


def test_globs(spark, tmp_path):
    for name in ("a/x1.txt", "a/b/x2.txt", "a/b/c/x3.txt", "a/b/_hidden.txt", "a/.dot/x4.txt", "a/b/y[1].csv", "d/x5.txt", "x6.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    found = lambda glob: [p.split(str(tmp_path))[-1].lstrip("/") for p, *_ in readers.glob_files(spark, f"{tmp_path}/{glob}")]
    assert found("**/x?.txt") == ["a/b/c/x3.txt", "a/b/x2.txt", "a/x1.txt", "d/x5.txt", "x6.txt"]
    assert found("*/x[1-4].txt") == ["a/x1.txt"] and found("[!a]/*") == ["d/x5.txt"]
    assert found("a/**") == ["a/b/c/x3.txt", "a/b/x2.txt", "a/b/y[1].csv", "a/x1.txt"]
    assert found("a/**/b/**/*.txt") == ["a/b/c/x3.txt", "a/b/x2.txt"]
    assert found("a/b/_*") == ["a/b/_hidden.txt"] and found("a/.*/*") == ["a/.dot/x4.txt"]
    assert found("a/b/y[[]1].csv") == ["a/b/y[1].csv"] and found("nowhere/*") == [] and found("x6.txt") == ["x6.txt"]
    rows = readers.file_manifest(spark, f"{tmp_path}/**/c/*.txt").collect()
    assert [(r["name"], r["bytes"], r["sha256"]) for r in rows] == [("x3.txt", 12, hashlib.sha256(b"a/b/c/x3.txt").hexdigest())]


def test_headers_of_files(spark, tmp_path):
    for name, text in {"1.tsv": "a\tb\n1\t2\n", "2.tsv": "b\ta\r\n3\t4\r\n", "3.tsv": "", "4.tsv": "c\n5\n"}.items():
        (tmp_path / name).write_text(text)
    rows = readers.read_delimited_by_name(spark, [f"{tmp_path}/*.tsv"]).select("a", "b", "c").collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, [("1", "2", None), ("4", "3", None), (None, None, "5")]))


def test_row_groups_and_sizes(spark, tmp_path):
    rows = spark.range(5_000).select("id", F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 3 == 0, "a").otherwise("b").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    sinks.export_parquet(rows, str(tmp_path / "g"), ["id"], row_group_rows=300)
    groups = readers.row_groups(spark, str(tmp_path / "g")).collect()
    last = {r["path"]: max(g["row_group"] for g in groups if g["path"] == r["path"]) for r in groups}
    assert sum(r["n_rows"] for r in groups) == 5_000 and all(r["n_rows"] == 300 for r in groups if r["row_group"] < last[r["path"]])
    plan = {r["k"]: r["n_files"] for r in sinks.write_sized(rows, str(tmp_path / "s"), 20_000, ["k"], ["id"]).collect()}
    files = readers.row_groups(spark, str(tmp_path / "s")).groupBy("path").agg(F.sum("bytes").alias("b")).collect()
    assert sum(plan.values()) == len(files) and len(plan) == 3 and all(10_000 <= r["b"] <= 30_000 for r in files)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 5_000 and back.filter("k IS NULL").count() == 500
    sinks.write_sized(rows.limit(0), str(tmp_path / "e"), 20_000)
    assert spark.read.schema(rows.schema).parquet(str(tmp_path / "e")).count() == 0
    with pytest.raises(ValueError):
        sinks.export_parquet(rows, str(tmp_path / "x"), ["id"], row_group_rows=0)


def test_sizes_of_small_files(spark, tmp_path):
    """Dictionaries cost a small file more than its share of a large one's bytes."""
    rows = spark.read.parquet("/root/testdata/sf0.1/orders.parquet")
    plan = {r["o_orderstatus"]: r["n_files"] for r in sinks.write_sized(rows, str(tmp_path / "s"), 16_000, ["o_orderstatus"], ["o_orderkey"]).collect()}
    files = readers.row_groups(spark, str(tmp_path / "s")).groupBy("path").agg(F.sum("bytes").alias("b"), F.sum("n_rows").alias("n")).collect()
    assert sum(plan.values()) == len(files) and sum(r["n"] for r in files) == 150_000
    assert all(8_000 <= r["b"] <= 24_000 for r in files), sorted(r["b"] for r in files)
    tiny = sinks.write_sized(rows.limit(5), str(tmp_path / "t"), 1).first()  # no file has less than a row
    assert tiny["n_files"] == 5 and spark.read.parquet(str(tmp_path / "t")).count() == 5


def test_json_arrays_hold_all_rows(spark, data, tmp_path):
    rows = spark.range(0, 1_000, 1, 3).select("id", F.when(F.col("id") % 2 == 0, "a\n").alias("v"))
    sinks.write_json_arrays(rows, str(tmp_path / "a"), 100)
    sizes = [len(json.loads(p.read_text())) for p in (tmp_path / "a").glob("*.txt")]
    assert sum(sizes) == 1_000 and max(sizes) == 64
    back = spark.read.schema(rows.schema).option("multiLine", True).json(str(tmp_path / "a"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    found = {r["name"]: (r["n"], r["total"]) for r in catalog.queries()["src_resources"](spark, data).collect()}
    assert found["json"] == found["ndjson"] == found["csv"] and found["json"][0] == spark.read.parquet(f"{data}/customer.parquet").count()


def test_digest_trees(spark):
    rows = spark.range(9_000).select((F.col("id") % 8_000).alias("a"), F.when(F.col("id") % 7 == 0, None).otherwise("x").alias("b"))
    one = fingerprint.table_fingerprint(rows).first()
    assert one["n_rows"] == 9_000 and fingerprint.tree_digits(9_000) == 2
    assert fingerprint.table_fingerprint(rows.repartition(7).select("b", "a")).first() == one
    assert fingerprint.table_fingerprint(rows.union(rows.limit(1))).first()["fingerprint"] != one["fingerprint"]
    assert fingerprint.table_fingerprint(rows.limit(0)).first()["n_rows"] == 0
    other = rows.withColumn("b", F.when(F.col("a") == 5, "y").otherwise(F.col("b")))
    assert fingerprint.differing_buckets(rows, rows.repartition(3), 2).count() == 0
    found = fingerprint.differing_buckets(rows, other, 4).collect()
    assert 1 <= len(found) <= 4
    diff = sorted(str(tuple(r)) for r in fingerprint.differing_rows(rows, other, 4).collect())
    assert diff == sorted(map(str, [(5, "x", 2, 0), (5, "y", 0, 2)]))


def test_verified_content(spark):
    good = hashlib.sha256(b"x").hexdigest()
    rows = [("1", "x", good), ("2", "x", good.upper() + " "), ("3", "x", None), ("4", "x", ""), ("5", "x", "ab"), ("6", None, good), ("7", "y", good)]
    objects, locators, refused = fingerprint.verified_content(spark.createDataFrame(rows, "l string, c string, d string"), "l", "c", "d")
    assert [(r["sha256"], r["n_locators"]) for r in objects.collect()] == [(good, 2)] and locators.count() == 2
    assert {r["locator"]: r["reason"] for r in refused.collect()} == {"3": "blank", "4": "blank", "5": "malformed", "6": "no content", "7": "mismatch"}


def test_samples_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(windows, "LAST_ROWS", 20)
    monkeypatch.setattr(windows, "RANGE_BITS", 4)
    base = spark.range(3_000).select((F.col("id") % 1_500).alias("k"), F.when(F.col("id") < 1_500, "a").alias("v"))
    same = base.union(spark.createDataFrame([(7, "a")] * 500, "k long, v string"))
    want = [r["h"] for r in same.select(F.xxhash64("k", F.lit(42)).alias("h")).orderBy("h").collect()]
    for n in (0, 1, 19, 700, 2_999, 3_500, 9_999):
        got = windows.seeded_sample(same.repartition(5), n, "k").select(F.xxhash64("k", F.lit(42)).alias("h")).orderBy("h").collect()
        assert [r["h"] for r in got] == want[:n]


def test_sketches_keep_their_bounds(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, (F.col("id") % 40).cast("string")).otherwise(F.col("id").cast("string")).alias("s"), (F.col("id") * 7919 % 60_000).cast("double").alias("x"), F.lit(None).cast("string").alias("none"))
    got = {r["column_name"]: r for r in profile.sketch(rows.repartition(7), top=5, followed=200, accuracy=100).collect()}
    true = {r["s"]: r["count"] for r in rows.groupBy("s").count().collect()}
    s = got["s"]
    assert s["frequent"][0]["value"] == "hot" and s["frequent_error"] > 0 and s["constraints"]["enum"] is None
    assert all(abs(f["n_rows"] - true[f["value"]]) <= s["frequent_error"] for f in s["frequent"])
    listed = {f["value"] for f in s["frequent"]}
    assert all(v in listed for v, n in true.items() if n > s["frequent"][-1]["n_rows"] + s["frequent_error"])
    assert all(abs(q - p * 60_000) <= 601 for q, p in zip(got["x"]["quantiles"], (0.25, 0.5, 0.75)))
    assert got["x"]["constraints"]["minimum"] == 0 and got["x"]["constraints"]["maximum"] == 59_999 and got["x"]["constraints"]["required"]
    assert got["none"]["n_values"] == 0 and got["none"]["frequent"] == [] and not got["none"]["constraints"]["required"]
    few = profile.sketch(spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "v string")).first()
    assert [tuple(f) for f in few["frequent"]] == [("a", 2), ("b", 1)] and few["frequent_error"] == 0
    assert few["constraints"].asDict() == {"required": False, "minimum": None, "maximum": None, "minLength": 1, "maxLength": 1, "enum": ["a", "b"]}
    assert profile.sketch(rows.limit(0)).count() == 3


def test_quantiles_are_exact(spark):
    rows = spark.range(100_000).select(F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") * 7919 % 100_000).alias("x"), F.when(F.col("id") < 90_000, 1.5).otherwise(2.5).cast("decimal(3,1)").alias("few"), F.lit("a").alias("t"), F.lit(None).cast("int").alias("none"))
    shares = (0.0, 0.001, 0.25, 0.5, 0.9, 0.95, 1.0)
    true = sorted(r["x"] for r in rows.filter("x IS NOT NULL").select("x").collect())
    got = {r["column_name"]: r["quantiles"] for r in profile.sketch(rows.repartition(7), quantiles=shares, accuracy=50, exact=True).collect()}
    assert got["x"] == [true[max(1, -(-int(q * 1000) * len(true) // 1000)) - 1] for q in shares]
    assert got["few"] == [1.5] * 5 + [2.5] * 2 and got["t"] is None and got["none"] is None
    assert profile.exact_quantiles(rows, "x", [0.5], bounds=[5.0, 6.0]) == profile.exact_quantiles(rows, "x", [0.5], bounds=[99_000.0, 99_001.0]) == [true[len(true) // 2 - 1]]


def test_patterns_of_contracts(spark):
    cases = [(r"^\$[0-9]+$", ["$5", "$17"], ["5", "$5\n", "$"]), ("^[$]+$", ["$$"], ["a"]), ("^a$|^b$", ["a", "b"], ["a\n", "ab"]), (r"^[^$\]]+[[&]$", ["x[", "x&"], ["$[", "x"]), ("^[]a]+$", ["]a"], ["b"]), (r"x\\$", ["x\\"], ["x$"])]
    for pattern, good, bad in cases:
        df = spark.createDataFrame([(v,) for v in good + bad + [None]], "v string")
        r = gates.validate_contract(df, {"properties": {"v": {"pattern": pattern}}}).first()
        assert (r["total"], r["rejects"]) == (len(good + bad), len(bad)), pattern
    flags = spark.createDataFrame([(True, 1, 1.5), (False, 2, 2.5)], "b boolean, n int, x double")
    rules = {"b": {"enum": [True]}, "n": {"const": 1}, "x": {"enum": [1.5, 2.5]}}
    assert {r["column_name"]: r["rejects"] for r in gates.validate_contract(flags, {"properties": rules}).collect()} == {"b": 1, "n": 1, "x": 0}


def test_operators_by_name_and_version(spark):
    rows = spark.range(5)
    assert packages.operator("table_fingerprint@^2")({"df": rows}).first()["n_rows"] == 5
    assert packages.operator("seeded_sample")({"df": rows}, {"n": 2, "key": "id"}).count() == 2
    for version, met, unmet in [((1, 4, 2), ["1", "^1.2", "~1.4", "1.4.2", "=1.4", ">=1.2, <2", ">1.3", "<=1.4"], ["2", "^1.5", "~1.3", "=1.4.1", ">1.4", "<1.4.2"]), ((0, 2, 3), ["0.2", "^0.2.1"], ["0.1", "^0.3"])]:
        assert all(packages._meets(version, c) for c in met) and not any(packages._meets(version, c) for c in unmet)
    for bad in ("nothing", "seeded_sample@1", "seeded_sample@x"):
        with pytest.raises(ValueError):
            packages.operator(bad)
    for tables, options in (({}, {"n": 1, "key": "id"}), ({"df": rows}, {"n": 1}), ({"df": rows}, {"n": 1, "key": "id", "more": 1}), ({"df": rows, "other": rows}, {"n": 1, "key": "id"})):
        with pytest.raises(ValueError):
            packages.operator("seeded_sample")(tables, options)
    assert "hot_block" in packages.operator("resolve").options


def test_sql_functions_are_the_columns(spark):
    define_functions(spark, "f_")
    odd = ["529900T8BM49AURSDO55", " 529900t8bm49aursdo55 ", "6GG1425B5X0SPG36P158", "0" * 20, "a!b", "", None, "0012", "1,234", "2024-02-30", "2024-02-28T10", "Société ß ł", "  a \n b ", "null", "x" * 64, "ab" * 32]
    df = spark.createDataFrame([(v,) for v in odd], "v string")
    df.createOrReplaceTempView("f_odd")
    c = F.col("v")
    pairs = {"mod97": scalars.mod97(c), "unpad": scalars.unpad(c), "strip_accents": scalars.strip_accents(c), "clean_text": scalars.clean_text(c), "thousands": scalars.thousands(c), "iso_date": scalars.iso_date(c), "valid_digest": fingerprint.valid_digest(c)}
    for name, column in pairs.items():
        got = [r[0] for r in spark.sql(f"SELECT f_{name}(v) FROM f_odd").collect()]
        assert got == [r[0] for r in df.select(column).collect()], name
    set_variables(spark, {"f_text": "it's \\ a", "f_none": "", "f_day": datetime.date(2024, 1, 2), "f_flag": True, "f_n": 3})
    assert tuple(spark.sql("SELECT f_text, f_none, f_day, f_flag, f_n").first()) == ("it's \\ a", None, datetime.date(2024, 1, 2), True, 3)
    with pytest.raises(ValueError):
        set_variables(spark, {"a; b": 1})


def test_hot_blocks_give_the_same_pairs(spark):
    left = spark.range(300).select(F.concat(F.lit("l"), F.col("id").cast("string")).alias("i"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("a"), (F.col("id") % 20).cast("string").alias("b"))
    right = left.withColumn("i", F.concat(F.lit("r"), "i")).union(spark.createDataFrame([("n", None, "1"), ("m", "hot", None)], "i string, a string, b string"))
    pairs = lambda hot: sorted(map(tuple, joins.block_pairs(left, right, [["a"], ["b", "a"], ["b"]], "i", "i", hot).collect()))
    assert pairs(None) == pairs(50) == pairs(10) == pairs(10_000)
