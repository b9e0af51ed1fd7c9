"""Each stage of the pipeline on its own input against a brute-force version, and all of them in a row."""

from __future__ import annotations

import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import language_id
from tesserae.llm.queries import tokenizer_path
from tesserae.session import table, written
from tests_llm_shared import brute_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LONG = "die sehr lange Zeile mit vielen Wörtern und noch mehr davon " * 20_000
STAGES = dict(corpus_pipeline.STAGES)
KEY = "AKIA" + "B" * 16


@pytest.fixture(scope="module")
def docs(spark, data):
    """The table, and nulls, empty and very long texts, ties and repeated rows."""
    base = table(spark, data, "documents")
    words = "and the people of the town said that it was good to be there again in the morning when the sun was over the hills of the land"
    odd = [
        (10_000, None, None, None, None),
        (10_001, "12 34 !!", "en", "s", 8),
        (10_002, "", "en", "s", 0),
        (10_003, "²½① ́", "en", "s", 4),
        (10_004, LONG, "de", "s", len(LONG)),
        (10_005, words, "en", "s", 1),
        (10_006, words, "en", "s", 1),
        (10_006, words, "en", "s", 1),
        (10_007, words.replace("morning", "evening") + f"\n{KEY}\nTHE LINE that repeats  ", "en", None, None),
        (10_008, f"the line THAT repeats\npassword: 'hunter2hunter2' and {KEY}", None, "s", None),
        (None, "the line that repeats\nand a line of its own in this text without an id", "en", "s", 1),
    ]
    return written(base.union(spark.createDataFrame(odd, base.schema)).repartition(3), "documents")


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def counted(text: str | None):
    return None if text is None else len(text)


def test_language_id(spark, docs, data):
    """Kernels by sets of places, landmarks and ridge regression in double precision, nothing folded."""
    keyed = docs.filter("lang IS NOT NULL").select("lang", F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit("text"))).otherwise(F.xxhash64(F.col("doc_id").cast("string"))).alias("h"), F.coalesce("text", F.lit("")).alias("text")).collect()
    by: dict = {}
    for r in keyed:
        at = by.setdefault(r["lang"], {})
        at[r["h"]] = min(r["text"], at.get(r["h"], r["text"]))
    spots = lambda t: frozenset(language_id.places(language_id.letters(t)).tolist())
    chosen = [(lang, k, spots(texts[h])) for lang, texts in sorted(by.items()) for k, h in enumerate(sorted(texts)[: language_id.ROWS]) if language_id.letters(texts[h]).strip()]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    land = [p for _, k, p in chosen if k < language_id.LANDMARKS]
    values, vectors = np.linalg.eigh([[kernel(a, b) for b in land] for a in land])
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    z = np.array([[kernel(p, q) for q in land] for _, _, p in chosen]) @ root
    names = sorted(by)
    y = np.array([[float(lang == n) for n in names] for lang, _, _ in chosen])
    w = np.array([1 / y[:, names.index(lang)].sum() / len(names) for lang, _, _ in chosen])
    mean, base = w @ z, w @ y
    beta = np.linalg.solve((z - mean).T * w @ (z - mean) + language_id.RIDGE * np.eye(z.shape[1]) / z.shape[1], (z - mean).T * w @ (y - base))
    want, near = [], 0
    for r in docs.select(*COLUMNS).collect():
        if not any(c.isalpha() for c in r["text"] or ""):
            continue
        p = spots(r["text"])
        value = min(1.0, ((np.array([kernel(p, q) for q in land]) @ root - mean) @ beta + base).max())
        least = corpus_pipeline.MIN_VALUES[len(r["text"]) >= corpus_pipeline.SHORT]
        near += abs(value - least) < 1e-4
        if value >= least:
            want.append(tuple(r))
    assert not near
    got = rows(STAGES["language_id"](spark, docs, data))
    assert got == sorted(want, key=str) and not {10_000, 10_001, 10_002, 10_003} & {r[0] for r in got} and 10_004 in {r[0] for r in got}


def test_foreign_languages_go(spark, docs, data):
    hu = "Ez egy hosszú magyar szöveg, amelyben sok olyan szó van, hogy egyik tanult nyelvhez sem hasonlít; így nem marad meg. "
    it = "La lingua italiana è una lingua romanza parlata principalmente in Italia. Per ragioni storiche e geografiche, la lingua è meno divergente dal latino. È classificato al ventesimo posto tra le lingue per numero di parlanti nel mondo. "
    more = docs.union(spark.createDataFrame([(20_000, it, None, "s", len(it)), (20_001, "xq zvkj wpqx", None, "s", 12)], docs.schema))
    got = {r["doc_id"]: r["text"] for r in STAGES["language_id"](spark, more, data).collect()}
    assert 20_000 not in got and hu not in got.values()
    few = docs.withColumn("lang", F.when(F.col("lang").isin("en", "de"), F.col("lang")))
    kept = STAGES["language_id"](spark, few.filter("lang IS NOT NULL"), data)
    many = few.withColumn("lang", F.concat("lang", F.lit("-"), (F.col("doc_id") % 4).cast("string"))).filter("lang IS NOT NULL")
    share = kept.count() / few.filter("lang IS NOT NULL").count()
    assert share > 0.9 and STAGES["language_id"](spark, many, data).count() > 0  # two languages, and eight that are alike by fours


def test_line_dedup(spark, docs, data):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    place = lambda i: (i is None, i or 0)
    whole = [tuple(r) for r in docs.select(*COLUMNS).collect()]
    first: dict[str, tuple] = {}
    for i, text, *_ in whole:
        for line in (text or "").split("\n"):
            first[key(line)] = min(first.get(key(line), place(i)), place(i))
    want = []
    for i, text, *rest in whole:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 10 or first[key(x)] == place(i)]
        left = "\n".join(stay)
        if len(stay) == len(lines) or left.strip(" \t\n\x0b\x0c\r"):
            want.append((i, left, *rest[:2], len(left)))
    got = rows(STAGES["line_dedup"](spark, docs, data))
    assert got == sorted(want, key=str) and len(got) < len(whole)


def test_ngram_join(spark, docs, data):
    whole = [tuple(r) for r in docs.filter("doc_id IS NOT NULL").select(*COLUMNS).collect()]
    root = brute_components({r[0]: r[1] for r in whole}, corpus_pipeline.WORDS, corpus_pipeline.PERCENT)
    got = rows(STAGES["ngram_join"](spark, docs, data))
    assert [r for r in got if r[0] is not None] == sorted((r for r in whole if root[r[0]] == r[0]), key=str)
    assert [r[0] for r in got].count(None) == 1 and 10_005 in {r[0] for r in got} and 10_006 not in {r[0] for r in got}


def test_secret_scan(spark, docs, data):
    patterns = [(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8), (r"(AKIA[A-Z0-9]+)", 16), (r"([0-9a-f]+)", 32)]
    want, open_ = {}, set()
    for r in docs.select(*COLUMNS).collect():
        text = r["text"]
        marks = np.zeros(len(text or ""), np.int8)
        for pattern, least in patterns:
            for m in re.finditer(pattern, text or "", re.A):
                if len(m[1]) >= least:
                    marks[m.start() : m.end()] = 1
        if re.search(r"PRIVATE KEY|eyJ[\w-]+\.|b3BlbnNz|\bM[A-P][A-Za-z0-9+/\s]{38}|30[0-9a-f]{62}", text or ""):
            open_.add(r["doc_id"])  # perhaps a key: those have tests of their own
        runs = re.sub("1+", "x", "".join(map(str, marks.tolist())))
        out, at = [], 0
        ends = np.flatnonzero(np.diff(np.concatenate([[0], marks, [0]])))
        for a, b in zip(ends[::2], ends[1::2]):
            out += [text[at:a], "[SECRET]"]
            at = b
        assert runs.count("x") == len(ends) // 2
        clean = None if text is None else "".join([*out, text[at:]])
        want[r["doc_id"], text] = (r["doc_id"], clean, r["lang"], r["source"], counted(clean))
    got = rows(STAGES["secret_scan"](spark, docs, data))
    assert len(got) == docs.count() and len(open_) < 20
    assert {g for g in got if g[0] not in open_} == {w for w in want.values() if w[0] not in open_}
    assert all(KEY not in (g[1] or "") and "hunter2" not in (g[1] or "") for g in got)


def test_packing(spark, docs, data):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    want: dict[tuple, list] = {}
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.setdefault((r["doc_id"], k // 4096), []).append((k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    bins: dict[int, list] = {}
    for r in STAGES["packing"](spark, docs, data).collect():
        want[r["doc_id"], r["piece"]].remove((r["start"], r["length"], r["ids_crc32"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert not any(want.values())
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [sum(n for o, n in b if o < p) for p, _ in sorted(b)] and sum(n for _, n in b) <= 4096
    assert len(bins) <= -(-sum(n for b in bins.values() for _, n in b) // 4096) * 1.05 + 1


@pytest.mark.parametrize("name", STAGES)
def test_clashing_columns(spark, docs, data, name):
    few = docs.filter("doc_id IS NULL OR doc_id >= 10005 OR doc_id < 60")
    clash = few.withColumns({n: F.lit("x") for n in ("doc", "_p", "_id", "_row", "_text", "kept", "id", "component_id", "length", "_n", "_bits")})
    out = STAGES[name](spark, clash, data)
    plain = STAGES[name](spark, few, data)
    if name == "packing":
        key = lambda d: sorted(map(str, d.select("doc_id", "piece", "length", "ids_crc32").collect()))
        assert key(out) == key(plain)
    else:
        assert rows(out) == rows(plain) and out.columns == clash.columns
        assert out.select("_id").distinct().collect() == [("x",)]


def test_stages_of_nothing(spark, docs, data):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), data).count() == 0, name


def test_run(spark, data):
    before = table(spark, data, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, before, data), name)
        assert after.columns == COLUMNS and after.count() <= before.count()
        assert after.filter(F.col("n_chars") != F.length("text")).count() == 0
        before = after
    assert corpus_pipeline.run(spark, data).select("doc_id").distinct().count() == before.select("doc_id").distinct().count() > 100


def test_rows_without_an_id_are_judged_each_by_itself(spark, docs, data):
    base = docs.filter("doc_id IS NOT NULL")
    copied = base.filter("length(text) > 1000").orderBy("doc_id").first()["text"]
    unlike = ["first of its kind " * 3 + "alpha beta gamma delta epsilon", "zeta eta theta iota kappa lambda mu nu xi omicron pi"]
    twin = "rho sigma tau upsilon phi chi psi omega and so on and on to the end"
    texts = [copied + " x", *unlike, twin, twin, None, ""]
    more = base.union(spark.createDataFrame([(None, t, "en", "s", 1) for t in texts], base.schema)).repartition(3)
    got = [r["text"] for r in STAGES["ngram_join"](spark, more, data).collect() if r["doc_id"] is None]
    assert sorted(got, key=str) == sorted([*unlike, twin, None, ""], key=str)
    assert STAGES["ngram_join"](spark, more, data).filter("doc_id IS NOT NULL").count() == STAGES["ngram_join"](spark, base, data).count()
    labelled = more.filter("doc_id IS NOT NULL").select(F.lit(None).cast("long").alias("doc_id"), "text", "lang", "source", "n_chars")
    assert STAGES["language_id"](spark, labelled, data).count() == STAGES["language_id"](spark, base, data).count()
