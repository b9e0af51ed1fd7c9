"""Operators 11 to 13 against brute force, and on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import collocations as co
from tesserae.llm import packed, periodic, substring_dedup
from tesserae.session import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WHITE = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor " * 20_000
PASSAGE = " ".join(f"pass{k}" for k in range(60))
ODD = [
    (5, f"before it {PASSAGE} and after", "en", "s", 1),
    (3, f"{PASSAGE}\nwith\ta tail", "en", "s", 1),
    (3, f"{PASSAGE}\nwith\ta tail", "en", "s", 1),
    (9, None, None, None, None),
    (8, "", "en", "s", 0),
    (11, " \n\t", "en", "s", 3),
    (None, f"nameless {PASSAGE}", "de", "s", 3),
    (None, "another " + " ".join(f"own{k}" for k in range(40)), "de", "s", 3),
    (None, "once more " + " ".join(f"own{k}" for k in range(40)), "de", "s", 3),
    (13, LONG, "en", "s", 3),
    (14, LONG, "en", "s", 3),
    (15, "Ünïcode ÀÉ 日本語 b b b b b b b b b b b b b", "de", "s", 3),
    (-4, "one", "de", "s", 3),
]
OPS = {"op11": substring_dedup.op11, "op12": periodic.op12, "op13": co.op13}


@pytest.fixture(scope="module")
def docs(spark):
    return written(spark.createDataFrame(ODD, SCHEMA), "odd")


def rows_of(df):
    return sorted(str([r[c] for c in sorted(df.columns)]) for r in df.collect())


@pytest.mark.parametrize("op", OPS)
def test_empty_and_clashing(docs, op):
    assert OPS[op](docs.limit(0)).count() == 0
    names = ["kept", "id", "_id", "_row", "_text", "doc", "factors", "runs", "part", "symbol", "word", "n", "a", "key", "phrase", "_h"]
    assert rows_of(OPS[op](docs)) == rows_of(OPS[op](docs.withColumns({n: F.lit("x") for n in names}).repartition(5)))


def test_packed_columns():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        cols = [rng.integers(0, 1 << 63, n, dtype=np.uint64), np.arange(n, dtype=np.uint64), np.zeros(n, np.uint64)]
        assert all((a == b).all() for a, b in zip(cols, packed.unpack(packed.pack(*cols))))


# ---- operator 11


def covered(rows, window):
    """Of rows (id, text): words, and which ones a window of a document with a smaller id covers."""
    key = lambda i: (i is None, i or 0)
    words = [WHITE.findall(t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, key(i)), key(i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < key(i):
                gone[k : k + window] = [True] * window
        out.append((w, gone))
    return out


def check11(df, rows, window=13):
    got = substring_dedup.substring_dedup(df, window).select("doc.doc_id", "n_words", "n_removed", "kept").collect()
    want = [(i, len(w), sum(g), " ".join(x for x, y in zip(w, g) if not y)) for (i, _), (w, g) in zip(rows, covered(rows, window))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_substrings_of_odd_rows(docs):
    check11(docs, [(r[0], r[1]) for r in ODD])


@pytest.mark.parametrize("seed, window", [(1, 13), (2, 3), (3, 1)])
def test_substrings_at_random(spark, seed, window, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 700)  # many blocks in a batch
    words = [f"w{k}" for k in range(30 if window > 1 else 400)]
    passages = [[rng.choice(words) for _ in range(rng.randint(window, 4 * window + 2))] for _ in range(8)]
    rows = []
    for k in range(150):
        text = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p))
            text += rng.choice([p, p[cut:], p[:cut], [rng.choice(words) for _ in range(rng.randint(0, 30))]])
        rows.append((rng.choice([k, k, k, k // 2, None if k % 9 == 0 else k]), rng.choice([" ", "\n", "  "]).join(text)))
    rows += rows[:5]
    assert any(any(g) for _, g in covered(rows, window))
    check11(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows, window)


def test_factors_stand_where_they_say(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(5000)]
    texts = {k: [rng.choice(words) for _ in range(200)] for k in range(20)}
    texts[7][50:120] = texts[3][10:80]
    texts[9][0:40] = texts[7][100:140]  # from two sources, 3 and 7
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    found = {r["id"]: [tuple(f) for f in r["factors"]] for r in substring_dedup.factors(df.coalesce(1)).collect()}
    assert found == {7: [(50, 70, 3, 10)], 9: [(0, 20, 3, 60), (8, 32, 7, 108)]}
    apart = {r["id"]: [tuple(f) for f in r["factors"]] for r in substring_dedup.factors(df.repartition(20)).collect()}
    for i, fs in [*found.items(), *apart.items()]:
        for start, length, source, at in fs:
            assert texts[i][start : start + length] == texts[source][at : at + length] and source < i


# ---- operator 12


def brute_runs(w, least=12):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def test_runs_at_random():
    rng = random.Random(4)
    for _ in range(120):
        texts, least = [], rng.choice([2, 3, 5, 12, 12, 12])
        for _ in range(rng.randint(1, 6)):
            n, k = rng.choice([0, 1, 11, 12, 13, 60, 250]), rng.choice([1, 2, 3, 40])
            w = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.6:
                a, p = rng.randrange(n), 1 + rng.randrange(1 + n // 3)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        hashed = [np.array(w, np.uint64) * np.uint64(0x9E3779B97F4A7C15) for w in texts]
        for w, r in zip(texts, periodic.runs_of(hashed, least)):
            assert [tuple(x) for x in r.tolist()] == sorted(brute_runs(w, least), key=lambda x: (x[0], x[2]))


def test_extensions_by_the_grammar():
    rng = np.random.default_rng(2)
    text = np.concatenate([rng.integers(0, 3, 400), np.tile(rng.integers(0, 50, 37), 30), np.zeros(300, np.int64), rng.integers(0, 2, 300)]).astype(np.uint64) + np.uint64(10)
    symbols = np.concatenate([[1], text, [2]]).astype(np.uint64)
    fences = np.zeros(len(symbols), bool)
    fences[[0, -1]] = True
    grammar = periodic.Grammar(symbols, fences)
    assert len(grammar.symbols[-1]) < len(symbols) / 10
    i = rng.integers(1, len(text), 800)
    j = rng.integers(1, len(text), 800)
    i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
    right, left = grammar.extend(i, j, True), grammar.extend(i, j, False)
    for x, y, r, q in zip(i, j, right, left):
        k = 0
        while symbols[x + k] == symbols[y + k]:
            k += 1
        assert k == r
        k = 0
        while symbols[x - 1 - k] == symbols[y - 1 - k]:
            k += 1
        assert k == q


def test_long_runs_are_fast():
    for w in (np.zeros(60_000, np.uint64), np.tile(np.arange(7, dtype=np.uint64), 9_000)):
        q = 1 if not w.any() else 7
        assert periodic.runs_of([w])[0].tolist() == [[0, len(w), q]]


def planted(doc_id, text):
    w = WHITE.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_runs_of_documents(spark, data, docs):
    base = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    table = base.union(docs.filter("length(text) < 1000 OR text IS NULL").select("doc_id", "text"))
    got, want = [tuple(r) for r in periodic.op12(table).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()], []
    for r in table.collect():
        w = planted(*r)
        runs = sorted(brute_runs(w), key=lambda x: (x[0], x[2]))
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        s, n, q = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        text = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((r[0], len(runs), s, n, q, n and 1000 * n // q, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(r[1] > 0 for r in want) > 15


def test_runs_of_odd_rows(docs):
    got = {(r["doc"]["doc_id"], r["doc"]["text"]): r for r in periodic.collapse_runs(docs).collect()}
    long = got[13, LONG]
    assert [tuple(x) for x in long["runs"]] == [(0, 60_000, 3)] and long["kept"] == "lorem ipsum dolor" and long["n_words"] == 60_000
    odd = got[15, ODD[11][1]]
    assert [tuple(x) for x in odd["runs"]] == [(2, 13, 1)] and odd["kept"] == "Ünïcode ÀÉ 日本語 b"
    assert got[9, None]["runs"] == [] and got[9, None]["kept"] == ""


# ---- operator 13


def brute_phrases(rows, longest, least, top, covered=80):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.update((lang, *w[i : i + m]) for i in range(len(w) - m + 1))
    found = {x: a for x, a in f.items() if len(x) > 2 and a >= least}
    inner = Counter()
    for x, a in found.items():
        for i in range(1, len(x)):
            for j in range(i + 2, len(x) + 1):
                if j - i < len(x) - 1:
                    k = (x[0], *x[i:j])
                    inner[k] = max(inner[k], a)
    out = []
    for lang in n:
        rows = []
        for x, a in found.items():
            if x[0] == lang and 100 * inner[x] < covered * a:
                cuts = [(2_000_000 * a // (f[x[: k + 1]] + f[(lang, *x[k + 1 :])]), k, f[x[: k + 1]], f[(lang, *x[k + 1 :])]) for k in range(1, len(x) - 1)]
                s, _, l, r = min(cuts)  # noqa: E741
                rows.append((-s, -a, " ".join(x[1:]).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]  # noqa: E741
    return out


@pytest.mark.parametrize("seed, longest, least, top", [(1, 4, 30, 2000), (2, 4, 5, 40), (3, 2, 3, 2000), (4, 5, 4, 15)])
def test_phrases_at_random(spark, seed, longest, least, top, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(co, "SHARD_BYTES", 3000)
    words = ["Über", "a", "b", "É", "c-d", "x y", "zz"] + [f"w{k}" for k in range(12)]
    idioms = [[rng.choice(words) for _ in range(rng.randint(2, 6))] for _ in range(8)]
    rows = [(None, None), ("en", ""), ("de", " \t.,;\n")]
    for _ in range(120):
        text = []
        for _ in range(rng.randint(0, 40)):
            text += rng.choice(idioms) if rng.random() < 0.5 else [rng.choice(words)]
            text += rng.choice([[], [], [], ["."], [","], ["\n"], ["\x0b"]])
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), rng.choice([" ", "\t", "  "]).join(text)))
    want = brute_phrases(rows, longest, least, top)
    got = co.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(3), longest, least, top)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == sorted(want)
    assert len(want) > 10


def test_phrases_with_full_filters(spark, monkeypatch):
    """Filters that let everything pass change nothing."""
    rng = random.Random(7)
    rows = [("en", " ".join(rng.choice("abcdefgh") for _ in range(300))) for _ in range(20)]
    monkeypatch.setattr(co, "FILTER_BITS", 4)
    got = co.collocations(spark.createDataFrame(rows, "lang string, text string"), 4, 8, 500)
    assert sorted(map(tuple, got.collect())) == sorted(brute_phrases(rows, 4, 8, 500))


def test_united_transducers():
    rng = random.Random(8)
    symbol = {w: np.uint64(rng.getrandbits(64)) for w in "abcdef"}
    grams, shards = Counter(), []
    for _ in range(4):
        own = []
        for _ in range(200):
            w = [rng.choice("abcdef") for _ in range(rng.choice([2, 3, 4, 4]))]
            own.append(w)
            grams.update(tuple(w[:m]) for m in range(2, len(w) + 1))
        labels = [np.array([symbol[w[k]] if k < len(w) else 0 for w in own], np.uint64) for k in range(4)]
        keys = [packed.joined(labels[0], labels[1])]
        for k in (2, 3):
            keys.append(np.where([len(w) > k for w in own], packed.joined(keys[-1], labels[k]), np.uint64(0)))
        order = np.lexsort(keys[::-1])
        one = co.Transducer.of_sorted([c[order] for c in labels], [c[order] for c in keys], np.array([len(w) for w in own])[order])
        shards += [co.Transducer.unpacked(data) for _, data in one.cut(3)]
    both = co.Transducer.unpacked(co.Transducer.union(shards, 5).packed())
    names = {int(v): k for k, v in symbol.items()}
    found = {}
    for words, keys, weights in both.paths():
        for row, key, a in zip(zip(*words), keys, weights[-1]):
            found[tuple(names[int(x)] for x in row)] = int(a)
            assert both.weights(np.array([key, 1], np.uint64)).tolist() == [int(a), 0]
    assert found == {g: a for g, a in grams.items() if a >= 5}
