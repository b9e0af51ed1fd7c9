"""The ten operators against brute force, and on nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import bpe, components, exact_dedup, fingerprints, language_id, line_dedup, ngram_join, packing, queries, secrets, token_counts, warc
from tesserae.session import fresh_path, table, written
from tests_llm_shared import brute_components, shingles_of

TOKENIZER = queries.tokenizer_path()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor " * 20_000
ODD = [
    (5, "Some words of a text that is here twice\nand a second line", "en", "s", 1),
    (3, "Some words of a text that is here twice\nand a second line", "en", "s", 1),
    (3, "Some words of a text that is here twice\nand a second line", "en", "s", 1),
    (9, "Somewords of a text that is here twice\n  and a second line", None, None, None),
    (7, None, None, None, None),
    (8, "", "en", "s", 0),
    (None, "a text without an id\nand a second line", "de", "s", 3),
    (11, " \n\t", "en", "s", 3),
    (12, "123 !!! ???", "en", "s", 3),
    (13, LONG, "en", "s", 3),
    (14, "Ünïcode ÀÉ 日本語 <|endoftext|> 'S", "de", "s", 3),
    (-4, "one", "de", "s", 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    return written(spark.createDataFrame(ODD, SCHEMA), "odd")


@pytest.fixture(scope="module")
def clash(docs):
    names = ["kept", "id", "n_shingles", "component_id", "_id", "_row", "_text", "doc", "fingerprint", "length", "_p"]
    return docs.withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


OPS = {
    "op1": lambda d: exact_dedup.op1(d),
    "op2": lambda d: ngram_join.op2(d),
    "op3": lambda d: fingerprints.op3(d),
    "op4": lambda d: token_counts.op4(d, TOKENIZER),
    "op5": lambda d: secrets.op5(d),
    "op6": lambda d: packing.op6(d, TOKENIZER),
    "op8": lambda d: line_dedup.op8(d),
    "op9": lambda d: bpe.op9(d, TOKENIZER),
    "op10": lambda d: language_id.op10(d),
}


@pytest.mark.parametrize("op", OPS)
def test_empty_and_clashing(docs, clash, op):
    assert OPS[op](docs.limit(0)).count() == 0
    a, b = OPS[op](docs), OPS[op](clash)
    key = lambda d: sorted(str(r) for r in d.select(*sorted(c for c in a.columns if c != "sequence_id" and c != "offset")).collect())
    assert key(a) == key(b)
    if op not in ("op4", "op6"):
        assert a.count() == len(ODD)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    got = queries.queries()[name](spark, data)
    cols = sorted(got.columns)
    want = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == cols
    want = sorted(str([r[names.index(c)] for c in cols]) for r in want.fetchall())
    assert sorted(str([r[c] for c in cols]) for r in got.collect()) == want


def test_exact_dedup_at_the_ends_of_ids(spark):
    least = -(1 << 63)
    df = spark.createDataFrame([(least, "a b"), (5, "ab"), (least + 1, "a b")], "doc_id long, text string")
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.op1(df).collect()} == {least: least, 5: least, least + 1: least}


def test_exact_dedup_keeps_the_longest(docs):
    out = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.op1(docs).collect()}
    by = {k[0]: v for k, v in out.items()}
    assert by[9]["keep_id"] == 9 and by[9]["kept"] and by[9]["group_size"] == 4  # one more code point
    assert by[5]["keep_id"] == 9 and not by[5]["kept"] and not by[3]["kept"]
    assert by[7]["keep_id"] == by[8]["keep_id"] == 11 and by[7]["group_size"] == 3


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80), (1, 50)])
def test_ngram_join(spark, size, percent):
    rng = random.Random(size)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 14)):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t) + rng.choice(["", " ", " tail"]))
    texts += ["", None, "A  b", "a b", " \n"] + texts[:5]
    rng.shuffle(texts)
    rows = dict(enumerate(texts))
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)
    got = ngram_join.ngram_components(df, size, percent).collect()
    assert {r["id"]: r["component_id"] for r in got} == brute_components(rows, size, percent)
    assert {r["id"]: r["n_shingles"] for r in got} == {i: len(shingles_of(t, size)) for i, t in rows.items()}


@pytest.mark.parametrize("seed, size, percent", [(107, 3, 90), (101, 3, 90), (102, 1, 50), (103, 3, 60)])
def test_ngram_join_of_chains_with_shared_paragraphs(spark, seed, size, percent):
    """Chains of copies that drift word by word and share paragraphs with other chains, many tables as one by a word of their own."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    rows, k, most = {}, 0, 8
    for world in range(most):
        passages = [[rng.choice(words) for _ in range(rng.randint(20, 60))] for _ in range(12)]
        for _ in range(12):
            text = [w for p in rng.sample(passages, 3) for w in p] + [rng.choice(words) for _ in range(rng.randint(10, 60))]
            for _ in range(rng.randint(4, 10)):
                rows[k] = " ".join(f"{w}.{world}" for w in text)
                k += 1
                text = [rng.choice(words) if rng.random() < 1 / rng.randint(70, 100) else w for w in text]
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)
    got = {r["id"]: r["component_id"] for r in ngram_join.ngram_components(df, size, percent).collect()}
    assert got == brute_components(rows, size, percent)


def test_ngram_join_counts_a_pair_over_main_labels(spark):
    """A (of a component of three) and B (alone) share tokens that those two have most of, and a passage of a larger component."""
    rows, k = {}, 0
    for g in range(6):
        own = itertools.count()
        new = lambda n: [f"g{g}w{next(own)}" for _ in range(n)]
        both, passage, near, core, hub = new(6), new(13), new(19), new(27), new(34)
        texts = [both + passage + near + new(2)]  # A, then B
        texts += [both + passage + new(21)]
        texts += [near + new(21) for _ in range(2)]  # with A
        texts += [core + passage for _ in range(10)]  # the larger component
        texts[4:] = [t[:-1] + new(1) if i else t for i, t in enumerate(texts[4:])]
        texts += [both + hub]  # B's central node, with which it doesn't link
        texts += [hub[a : a + 17] + new(23) for a in (0, 17) for _ in range(3)]
        for t in texts:
            rows[k] = " ".join(t)
            k += 1
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in ngram_join.ngram_components(df, 1, 30).collect()}
    assert got == brute_components(rows, 1, 30)


def test_ngram_join_of_repeated_and_null_ids(spark):
    """Rows of one id are one document: whatever links with any of its texts links with it."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(500)]
    bases = [[rng.choice(words) for _ in range(rng.randint(5, 40))] for _ in range(40)]
    rows = []
    for k in range(260):
        t = list(rng.choice(bases))
        t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((rng.choice([k, k, k, k // 2 - 40, None if k % 13 == 0 else k]), " ".join(t)))
    rows += [(7, ""), (None, None), (900, ""), (901, "w1")] + rows[:6] * 3 + [(i, f" {t}") for i, t in rows[:6]]
    # each row its own document in the brute force, those of an id linked by a text they all have
    apart = dict(enumerate(t for _, t in rows))
    of_row = brute_components(apart, 3, 80)
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (i, _), c in zip(rows, of_row.values()):
        a, b = sorted((root(i), root(rows[c][0])), key=lambda x: (x is None, x or 0))
        up[b] = a
    want = sorted(((i, len(shingles_of(t, 3)), root(i)) for i, t in rows), key=str)
    assert len({c for _, _, c in want}) < len({i for i, _, _ in want}) - 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_join.ngram_components(df, 3, 80).collect()
    assert sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == want


def test_counted_runs_over_batches():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    for size in (1, 3, 50, 10_000):
        token = np.sort(rng.integers(0, 60, 3000))
        node = np.zeros(3000, np.int64)
        for t in np.unique(token):
            at = token == t
            node[at] = np.sort(rng.choice(5000, at.sum(), replace=False))
        batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + size]) for c in (token, node, node)], ["t", "v", "n"]) for i in range(0, 3000, size)]
        out = [r for b in ngram_join._counted(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
        assert len(out) == len({(v, t) for v, _, t, _ in out})
        df = {}
        for _, _, t, n in out:
            assert df.setdefault(t, n) == n
        counts = dict(zip(*np.unique(token, return_counts=True)))
        ends = {token[0], token[-1]}
        assert all(df[t] == counts[t] for t in counts if counts[t] > 1 and t not in ends)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + k, 401 + k) for k in range(40)] + [(500, 500 + k) for k in range(1, 60)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {n: n for p in links for n in p}
    for _ in range(500):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {n: m for n, m in label.items() if any(n in p and p[0] != p[1] for p in links)}


def test_fingerprints(spark, data):
    docs = table(spark, data, "documents")
    text = [r["text"] for r in docs.orderBy("doc_id").collect()]
    got = fingerprints.op3(docs).orderBy("doc_id").collect()
    for k, r in enumerate(got):
        nxt = text[(k + 1) % len(text)]
        changed = fingerprints.edited(text[k], nxt)
        a, b, c = (np.unique(fingerprints.signatures(t)) for t in (text[k], changed, nxt))
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprints.packed(a), fingerprints.packed(b))
        plain = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if len(x) or len(y) else 1.0
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(plain(a, b)), pytest.approx(plain(a, c)))
    mean = np.mean([r["near_edited"] for r in got]), np.mean([r["near_next"] for r in got])
    assert mean[0] > 0.5 and mean[1] < 0.05
    assert fingerprints.pruned_jaccard(np.arange(10), np.arange(5), 0.6) == 0


def test_fingerprints_of_texts_without_anchors():
    rng = random.Random(8)
    words = [f"szó{k}" for k in range(300)]
    like = lambda a, b: fingerprints.pruned_jaccard(*(np.unique(fingerprints.signatures(t)) for t in (a, b)))
    for n in (9, 60, 900):
        for few in ([], ["the"]):  # no anchor, or one at the start
            start = few + rng.sample(words, 3)
            a, b = (" ".join(start + [rng.choice(words) for _ in range(n)]) for _ in range(2))
            assert like(a, b) < 0.6 and like(a, a) == 1
            if n > 9:
                assert len(fingerprints.signatures(a)) > n // 8 and like(a, b) < 0.2
                assert 0.4 < like(a, fingerprints.edited(a, b)) < 0.8
                one = a.split()
                one[n // 2] = "other"
                assert like(a, " ".join(one)) > 0.7


def test_near_fingerprints(spark, data):
    docs = table(spark, data, "documents")
    signs = {r["doc_id"]: np.unique(fingerprints.signatures(r["text"])) for r in docs.collect()}
    root = {i: i for i in signs}
    for _ in range(3):
        for a, b in itertools.combinations(sorted(signs), 2):
            if len(signs[a]) and len(signs[b]) and fingerprints.pruned_jaccard(signs[a], signs[b], 0.8):
                root[a] = root[b] = min(root[a], root[b])
    assert {r["id"]: r["component_id"] for r in fingerprints.near_components(docs, 80).collect()} == root


def test_encoding_is_the_librarys(docs, library, spark, data):
    rows = docs.select("doc_id", "text").union(table(spark, data, "documents").select("doc_id", "text"))
    got = sorted(map(tuple, bpe.encode_decode(rows, TOKENIZER).collect()), key=str)
    want = []
    for i, t in rows.collect():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=str)
    text = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op9(rows, TOKENIZER).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert text == {(i, len(ids), sha(" ".join(map(str, ids))), sha(d)) for i, ids, d in want}


def test_speculation_equals_merging():
    m = bpe.encoder(TOKENIZER).merges
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 60))).encode() for _ in range(3000)]
    words += [b"", b"x", b"a" * 300, "é日本".encode()] + ["".join(rng.choice("abcé") for _ in range(200)).encode() for _ in range(5)]
    ids, sizes = m.encode_words(words)
    split = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert split == [m._merged_long(w) if w else [] for w in words] and split[:3000] == m.merged(words[:3000])
    owner, tokens = m.proposed(words)
    assert [x.tolist() for x in np.split(tokens, np.searchsorted(owner, np.arange(1, len(words))))] == [m.longest(w) for w in words]


def test_words_of_odd_texts(library):
    rng = random.Random(3)
    letters = "abcdST'’`srtvemld 0123²½é!? \n\t.É'ß\xa0\x85\x1c_-µ日<|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ["x <|endoftext|>y", "'s'sa", "!'s", "''re", "I'LL'd"]
    enc = bpe.encoder(TOKENIZER)
    for _ in range(2):  # new words, then kept ones
        ids, sizes = enc.batch(texts)
        got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    ids, sizes = enc.batch([""])
    assert not len(ids) and sizes.tolist() == [0]


def test_words_are_forgotten(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 20)
    enc = bpe.Encoder(TOKENIZER)
    rng = random.Random(9)
    for k in range(8):
        texts = ["the <|endoftext|> same " + "".join(rng.choice("abcdefgh日 ") for _ in range(90)) for _ in range(3)] + ["z" * 100] * (k % 2)
        ids, sizes = enc.batch(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    enc._forget()
    assert len(enc.words) <= 20 and "z" * 100 not in enc.words


def test_token_counts(docs, library):
    n = [len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()]
    got = token_counts.op4(docs, TOKENIZER).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(set(n))
    for r in got:
        k = r["n_tokens"]
        assert r["n_docs"] == n.count(k)
        assert r["docs_from"] == sum(x >= k for x in n) and r["docs_within"] == sum(x <= k for x in n)
        assert r["tokens_truncated"] == sum(min(x, k) for x in n)
        assert r["tokens_within"] == sum(x for x in n if x <= k) and r["tokens_from"] == sum(x for x in n if x >= k)
        assert r["share_within"] == pytest.approx(sum(x <= k for x in n) / len(n))


def test_packing(docs, library):
    want = {}
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), packing.CAPACITY):
            part = ids[k : k + packing.CAPACITY]
            want.setdefault((r["doc_id"], k // packing.CAPACITY), []).append((k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    bins: dict[int, list] = {}
    for r in packing.op6(docs, TOKENIZER).collect():
        want[r["doc_id"], r["piece"]].remove((r["start"], r["length"], r["ids_crc32"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert not any(want.values())
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY


def test_plan_is_no_worse_than_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(60):
        cap = rng.choice([10, 30, 100, 4096])
        lengths = [rng.randint(1, cap) if rng.random() < 0.5 else rng.randint(1, max(1, cap // 5)) for _ in range(rng.randint(0, 200))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        used = {first + k for n, a, z, first, _ in packing.plan(counts, cap) for k in range(z - a + 1)}
        gaps: list[int] = []
        for n in sorted(lengths, reverse=True):
            k = min((k for k in range(len(gaps)) if gaps[k] >= n), key=lambda k: gaps[k], default=None)
            if k is None:
                gaps.append(cap - n)
            else:
                gaps[k] -= n
        assert len(used) <= len(gaps)


def der(tag: int, body: bytes) -> bytes:
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def test_only_keys_that_parse_are_reported():
    rng = random.Random(12)
    b64 = lambda b: base64.b64encode(b).decode()
    oid = lambda h: der(6, bytes.fromhex(h))
    null, octets = der(5, b""), rng.randbytes(32)
    digest = der(0x30, der(0x30, oid("608648016503040201") + null) + der(4, octets))  # of a public sha256
    junk = der(0x30, der(2, b"\0") + der(0x30, oid("2a864886f70d010101") + null) + der(4, b"just some plain words that are no key at all"))
    curve = der(0x30, der(2, b"\0") + der(0x30, oid("2b6570")) + der(4, der(4, octets)))
    scheme = der(0x30, oid("2a864886f70d01050d") + der(0x30, der(0x30, oid("2a864886f70d01050c") + der(0x30, der(4, octets[:8]) + der(2, b"\x08"))) + der(0x30, oid("60864801650304012a") + der(4, octets[:16]))))
    sealed = der(0x30, scheme + der(4, rng.randbytes(64)))
    sec1 = der(0x30, der(2, b"\x01") + der(4, octets) + der(0xA0, oid("2a8648ce3d030107")))
    for good in (curve, sealed, sec1):
        assert secrets.listed(secrets.spans_of("k: " + b64(good) + " end")) == f"der:3:{3 + len(b64(good))}"
    for bad in (digest, junk, der(0x30, der(2, b"\x05") + der(4, octets)), der(0x30, der(0x30, oid("2a864886f70d01050d") + null) + der(4, octets)), sec1[:-3]):
        assert not secrets.spans_of("k: " + b64(bad) + " end")
    for kind, body, ok in (("4,ENCRYPTED", rng.randbytes(64), True), ("4,ENCRYPTED", rng.randbytes(63), False), ("4,CLEAR", rng.randbytes(64), False)):
        for by in ("\n", "\r\n", "\\n"):
            text = by.join(["x -----BEGIN RSA PRIVATE KEY-----", f"Proc-Type: {kind}", "DEK-Info: AES-128-CBC," + "0A" * 16, "", *re.findall(".{1,64}", b64(body)), "-----END RSA PRIVATE KEY-----"])
            assert [k for _, k, _ in secrets.spans_of(text)] == [3] * ok


def test_base_secrets_of_the_whole_table(spark, data):
    """Counts and places by the contract's patterns, found here one by one."""
    docs = table(spark, data.replace("sf0.001", "sf0.01"), "documents")
    patterns = [("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8), ("access", r"(AKIA[A-Z0-9]+)", 16), ("hex", r"([0-9a-f]+)", 32)]
    got = {r["doc_id"]: r for r in secrets.op5(docs).collect()}
    for row in docs.collect():
        text, found = row["text"] or "", []
        for order, (kind, pattern, least) in enumerate(patterns):
            found += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text, re.A) if len(m[1]) >= least]
        r = got[row["doc_id"]]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(o == k for _, o, _ in found) for k in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(x for *_, x in sorted(found)).encode()).hexdigest()


def test_secrets(spark):
    rng = random.Random(6)
    number = lambda n: der(2, b"\x01" + rng.randbytes(n))
    rsa = der(0x30, der(2, b"\0") + b"".join(number(k) for k in (128, 3, 128, 64, 64, 64, 64, 64)))
    pkcs8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(4, rsa))
    string = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + string(b"none") + string(b"none") + string(b"") + (1).to_bytes(4, "big") + string(b"pub") + string(b"p" * 80)
    b64 = lambda b: base64.b64encode(b).decode()
    url = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    jwt = f"{url(json.dumps({'alg': 'HS256'}).encode())}.{url(json.dumps({'sub': 1}).encode())}.{url(rng.randbytes(32))}"
    pem = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(re.findall(".{1,64}", b64(pkcs8))) + "\n-----END PRIVATE KEY-----"
    cases = {
        1: ("x Token : 'abcdefgh' y", ["assign:2:19"]),
        2: ("token=short AKIA" + "A" * 12 + " AKIAXX " + "a1" * 16, ["access:12:28", "hex:36:68"]),
        3: ("é " + jwt, [f"jwt:2:{2 + len(jwt)}"]),
        4: ("k " + pem, [f"pem:2:{2 + len(pem)}"]),
        5: ("k " + b64(pkcs8) + " z", [f"der:2:{2 + len(b64(pkcs8))}"]),
        6: ("k " + b64(pkcs8[:-4]), []),
        7: ("k " + rsa.hex(), [f"hex:2:{2 + len(rsa.hex())}", f"derhex:2:{2 + len(rsa.hex())}"]),
        8: ("k " + b64(ssh), [f"sshkey:2:{2 + len(b64(ssh))}"]),
        9: ("eyJhbGciOiJ9.abc.def " + "M" * 60, []),
        10: (None, []),
        11: ("paſſword=abcdefghij", []),
    }
    df = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id long, text string")
    for r in secrets.op5(df).collect():
        spans = cases[r["doc_id"]][1]
        base = [s for s in spans if s.split(":")[0] in ("assign", "access", "hex")]
        assert r["spans"] == ",".join(spans), r["doc_id"]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert r["n_assign"] + r["n_access"] + r["n_hex"] == len(base)
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert clean[4] == "k [SECRET]" and clean[7] == "k [SECRET]" and clean[10] is None and clean[9] == cases[9][0]


def test_bare_keys_end_where_their_lengths_say():
    rng = random.Random(7)
    string = lambda b: len(b).to_bytes(4, "big") + b
    b64 = lambda b: base64.b64encode(b).decode()
    wrapped = lambda t, n, by: by.join(re.findall(f".{{1,{n}}}", t))
    for extra in range(3):  # each number of padding characters
        numbers = b"".join(der(2, b"\x01" + rng.randbytes(n)) for n in (128, 3, 128, 64, 64, 64, 64, 64 + extra))
        rsa = b64(der(0x30, der(2, b"\0") + numbers))
        parts = string(b"none") + string(b"none") + string(b"") + (1).to_bytes(4, "big") + string(b"pub" * 20) + string(rng.randbytes(150 + extra))
        ssh = b64(b"openssh-key-v1\0" + parts)
        for kind, key in (("der", rsa), ("sshkey", ssh)):
            for form in (key, key.rstrip("="), *(wrapped(key, n, by) for n in (64, 76) for by in ("\n", "\r\n", "\n  ", "\\n"))):
                for tail in ("", " and then some prose.", "\nand more words of any kind", ", x", "\n" + "A" * 200):
                    assert secrets.listed(secrets.spans_of("k: " + form + tail)) == f"{kind}:3:{3 + len(form)}"
            two = f"{key.rstrip('=')} then\n{wrapped(key, 64, chr(10))} end"
            assert secrets.redacted(two, secrets.spans_of(two), "*") == "* then\n* end"
            assert not secrets.spans_of("k: " + key.rstrip("=")[:-1] + ". prose")
    assert not secrets.spans_of("MAKE IT SO and MIIEvQ then " + "MIIEpAIBAAKCAQEA " * 50)


def test_keys_in_other_encodings():
    """Keys planted in prose in every form; only their places may be reported."""
    rng = random.Random(21)
    b64 = lambda b: base64.b64encode(b).decode()
    wrapped = lambda t, n, by: by.join(re.findall(f".{{1,{n}}}", t))
    for size in range(60, 72):
        der_key = der(0x30, der(2, b"\0") + b"".join(der(2, b"\x01" + rng.randbytes(n)) for n in (size, 3, size, 32, 32, 32, 32, 33)))
        pem = "-----BEGIN RSA PRIVATE KEY-----\n" + wrapped(b64(der_key), 64, "\n") + "\n-----END RSA PRIVATE KEY-----" + rng.choice(["", "\n"])
        url = base64.urlsafe_b64encode(der_key).decode()
        odd = der_key.hex().upper()
        forms = [("pem64", b64(pem.encode())), ("pem64", wrapped(b64(pem.encode()), 76, "\n")), ("pem64", b64(pem.encode()).rstrip("="))]
        forms += [("der", url), ("der", url.rstrip("="))] if re.search("[-_]", url) else []
        forms += [("derhex", odd), ("derhex", wrapped(odd, 64, "\n")), ("derhex", wrapped(odd, 2, ":"))]
        for kind, form in forms:
            for tail in ("", " then prose, 12 of it", "\nand words"):
                text = f"é key = {form}{tail}"
                assert secrets.listed(secrets.spans_of(text)) == f"{kind}:8:{8 + len(form)}", (kind, tail)
        for tail in ("AB12" * 9, "0"):
            assert secrets.listed(secrets.spans_of(f"k {odd}{tail}")) == f"derhex:2:{2 + len(odd)}"
        broken = pem.replace("END RSA", "END DSA")
        for text in (b64(broken.encode()), b64(b"-----BEGIN RSA PRIVATE KEY-----\nnot a key at all\n-----END RSA PRIVATE KEY-----"), url[:-8], odd[:-4], wrapped(odd, 10, ". ")):
            assert not secrets.spans_of("k " + text + " end.")


def plain_fingerprint(text: str) -> str:
    """The fingerprint by its definition: anchors in order, chains of three content words, anchors by hash where eight content words have none."""
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    if not words:
        rest = "".join(text.split())
        return f"{zlib.crc32(rest.encode()):08x}" if rest else ""
    content = [w for w in words if w not in fingerprints.ANCHORS]
    starts, seen = [("^", 0)], 0
    for w in words:
        if w in fingerprints.ANCHORS:
            starts.append((w, seen))
        else:
            seen += 1
    if not content and len(starts) == 1:
        return ""
    gap = 8 if len(starts) > 1 else 4
    places = [p for _, p in starts] + [len(content)]
    for a, b in zip(places, places[1:]):
        for k in range(a, b - gap + 1):
            best = min(range(k, k + gap), key=lambda i: (zlib.crc32(content[i].encode()), i))
            starts.append((content[best], best + 1))
    chains = {" ".join([w, *content[p : p + 3]]) for w, p in starts}
    return "".join(f"{h:08x}" for h in sorted({zlib.crc32(c.encode()) for c in chains}))


def test_fingerprints_by_their_definition(spark, data):
    docs = table(spark, data, "documents").select("doc_id", "text")
    odd = [(10_000 + k, t) for k, t in enumerate(["", None, "!!! ???", "the of and", "one", "a_b c_d " * 9, "Ünï the ÀÉ 日本語 of x", "word " * 50, "the " + " ".join(f"n{k}" for k in range(40))])]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    text = [r["text"] or "" for r in docs.orderBy("doc_id").collect()]
    got = fingerprints.op3(docs).orderBy("doc_id").collect()
    parts = lambda f: {f[k : k + 8] for k in range(0, len(f), 8)}
    alike = lambda x, y: len(parts(x) & parts(y)) / len(parts(x) | parts(y)) if x or y else 1.0
    for k, r in enumerate(got):
        nxt = text[(k + 1) % len(text)]
        n = len(text[k]) // 4
        changed = text[k][: len(text[k]) - n] + nxt[:n]
        a, b, c = map(plain_fingerprint, (text[k], changed, nxt))
        assert (r["n_chars"], r["fingerprint"], r["edited_fingerprint"]) == (len(text[k]), a, b)
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(alike(a, b)), pytest.approx(alike(a, c)))


def test_ranges_of_one_id_are_cut_by_rows():
    lows = fingerprints.range_cuts([5.0, 7.0, 7.0, 7.0, 9.0])
    assert [i for i, _ in lows] == [5, 7, 7, 7, 9] and lows == sorted(lows)
    rng = np.random.default_rng(3)
    ids, rows = rng.integers(4, 11, 5000), rng.integers(-(1 << 63), (1 << 63) - 1, 5000)
    got = fingerprints.place(lows, ids, rows)
    assert got.tolist() == [sum(c <= (i, r) for c in lows) for i, r in zip(ids.tolist(), rows.tolist())]
    assert min(Counter(got.tolist()).values()) > 100
    assert fingerprints.place([], ids, rows).tolist() == [0] * 5000


def test_operators_with_many_null_ids(spark):
    """Half of the rows have no id; each operator says of every row what it says of the row alone."""
    rng = random.Random(14)
    words = "the of and house tree river stone light morning evening walk run sleep think write".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows = [(None if k % 2 else k, t, "en") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    prints = {r["fingerprint"] for r in fingerprints.op3(df).collect()}
    assert fingerprints.op3(df).count() == 60 and prints == {fingerprints.packed(fingerprints.signatures(t)) for t in texts}
    pieces = packing.op6(df, TOKENIZER).collect()
    assert len(pieces) == 60 and sum(r["doc_id"] is None for r in pieces) == 30
    place = Counter()
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == place[r["sequence_id"]]
        place[r["sequence_id"]] += r["length"]
    assert max(place.values()) <= 4096


def test_languages_of_rows_without_ids(spark):
    """Null and repeated ids lose no language."""
    say = {"en": "the people of the town said that it was good", "de": "die Leute der Stadt sagten dass es gut war und"}
    text = F.concat(F.when(F.col("lang") == "en", say["en"]).otherwise(say["de"]), F.lit(" "), (F.col("id") % 50).cast("string"))
    base = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"))
    for key in (F.lit(None).cast("long"), F.col("id") % 4):
        model = language_id.fit(base.select(key.alias("doc_id"), text.alias("text"), "lang"))
        assert model.langs == ["de", "en"]
        assert model.predict([say["de"], say["en"]])[0] == ["de", "en"]
    many = base.select("id", F.concat("lang", F.lit("-"), (F.col("id") % 100).cast("string")).alias("lang"), text.alias("text"))
    model = language_id.fit(many, id_col="id", most_rows=400, most_landmarks=100)
    assert len(model.langs) == 100  # an even share each


def test_index_asks_for_several_matches(spark, monkeypatch):
    """Where elements differ in frequency, some prefixes ask for more than one shared element, and links stay the same."""
    seen = []
    monkeypatch.setattr(ngram_join, "_labelled", lambda index, links, f=ngram_join._labelled: (seen.append(index), f(index, links))[1])
    rng = random.Random(31)
    texts = []
    for k in range(90):
        base = [f"group{k // 3}word{j}" for j in range(12)] + [f"common{j}" for j in range(60)]
        base[12 + rng.randrange(60)] = f"own{k}"
        texts.append(" ".join(base))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["id"]: r["component_id"] for r in ngram_join.ngram_components(df, 1, 80).collect()}
    assert got == brute_components(dict(enumerate(texts)), 1, 80)
    assert max(r["matches"] for r in seen[0].select("matches").distinct().collect()) > 1


def test_central_rows_over_batches():
    import pyarrow as pa

    rng = random.Random(17)
    rows = sorted((rng.randrange(12), 0, 0, 0, rng.randrange(3), 0) for _ in range(300))
    rows = [(t, k, 50, rng.randrange(5), s, rng.randrange(3)) for k, (t, _, _, _, s, _) in enumerate(sorted(rows, key=lambda r: (r[0], r[4])))]
    want, token = [], None
    for row in rows:
        if row[0] != token:
            token, tops = row[0], []
        to = next((x for x in tops if x[5] != row[5]), None)
        if to is not None and 50 - row[3] >= 45 and 50 - to[3] >= 45:
            want.append((row[1], to[4], to[1]))
        if len(tops) < 2 and all(x[5] != row[5] for x in tops):
            tops.append(row)
    for size in (1, 7, 300):
        made = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + size])], list("abcdef")) for k in range(0, 300, size)]
        got = [t for b in ngram_join._central(80)(iter(made)) for t in zip(*(c.to_pylist() for c in b.columns))]
        assert got == want


PAGES = [(1, "http://a/x y", "<p>é</p>"), (5, None, "<p>é</p>"), (3, "http://b", None), (4, "u\r\nv", ""), (None, "http://c", "<p>é</p>"), (2, "http://d", "z" * 3_000_000), (5, None, "<p>é</p>")]


def test_warc(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    out = sorted(map(tuple, warc.op7(pages).collect()), key=str)
    best = (1 << 63) - 1
    want = []
    for i, _, h in PAGES:
        digest = warc.digest_of((h or "").encode())
        top = {"<p>é</p>": best}.get(h, 4 if not h else i)
        own = best if i is None else i
        want.append((i, len((h or "").encode()), digest, "response" if own == top else "revisit", None if own == top else top))
    assert out == sorted(want, key=str)
    assert warc.op7(pages.limit(0)).count() == 0


def test_warc_of_many_archives(spark, monkeypatch):
    """Archives end at their size, a large one is read in stretches, and extra columns of clashing names do no harm."""
    monkeypatch.setattr(warc, "STRETCH", 700)
    rng = random.Random(2)
    rows = [(k, f"http://u/{k}", "".join(rng.choice("abcdef<>/ ") for _ in range(rng.choice([0, 50, 900]))), "x", "y") for k in range(80)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file string, _id string").repartition(3)
    folder = fresh_path(spark, "warc")
    index = written(warc.write_archives(pages, folder, archive_bytes=5_000), "index")
    files = index.groupBy("file").agg(F.max(F.col("offset")).alias("o"), F.count("file").alias("n")).collect()
    assert len(files) > 6 and all(r["o"] < 5_000 for r in files)
    got = {r["page_id"]: r for r in warc.read_records(index, folder).collect()}
    last = {html: k for k, _, html, *_ in rows}
    for k, url, html, *_ in rows:
        assert got[k]["url"] == url and got[k]["refers_to"] == (None if last[html] == k else last[html])
        assert got[k]["payload"] == (html.encode() if last[html] == k else None)


def test_warc_reads_a_selection(spark, data):
    pages = table(spark, data, "pages")
    folder = fresh_path(spark, "warc")
    index = written(warc.write_archives(pages, folder), "index")
    some = index.filter("page_id % 7 = 3")
    got = {r["page_id"]: bytes(r["payload"]) for r in warc.read_records(some, folder).collect() if r["record_type"] == "response"}
    assert got == {r["page_id"]: r["html"].encode() for r in pages.filter("page_id % 7 = 3").collect()}
    assert list(warc.coalesced([(0, 10), (10, 5), (100_000, 4), (100_004, 2)])) == [(0, 2, 0, 15), (2, 4, 100_000, 100_006)]
    assert list(warc.coalesced([])) == []


def test_line_bitmaps(docs):
    lost = {r["doc_id"]: r["n_dropped"] for r in line_dedup.op8(docs).collect()}
    assert lost[5] == 2 and lost[3] == 0 and lost[9] == 1 and lost[None] == 1
    kept = line_dedup.line_dedup(docs)
    assert kept.columns == docs.columns
    by = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert 5 not in by and by[9] == "Somewords of a text that is here twice" and by[None] == "a text without an id" and by[8] == ""


def test_lines_of_every_document(spark):
    text = "a line that all documents have\nown line number {}\nA LINE that all documents have  "
    df = spark.createDataFrame([(i, text.format(i)) for i in range(500)], "doc_id long, text string").repartition(6)
    out = {r["doc_id"]: r["n_dropped"] for r in line_dedup.op8(df).collect()}
    assert out == {i: 2 * (i > 0) for i in range(500)}


def test_language(spark, data):
    docs = table(spark, data.replace("sf0.001", "sf0.01"), "documents")
    out = language_id.op10(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_of_nothing(docs):
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.op10(docs).collect()}
    assert got[7] == got[8] == got[11] == got[12] == ("und", 0.0) and got[13][0] in ("en", "de")
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.op10(none).collect()} == {"und"}


def test_letters_are_unicodes():
    for text in ("²½①", "Ⅳ ٣ 123", "_-!?", "\u0301"):
        assert language_id.letters(text).strip() == ""
    assert language_id.letters("a²B½é日_c") == " a b é日 c "


def test_kernel_is_folded_exactly():
    texts = ["the cat sat on the mat", "der hund und die katze", "the dog and the cat", "die maus ist im haus"]
    found = [language_id.places(language_id.letters(t)) for t in texts]
    k = np.array([[len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b)) for b in found] for a in found])
    x = language_id.presence(found)
    assert np.allclose(x @ x.T, k, atol=1e-5)
    model = language_id.solve(found, ["en", "de", "en", "de"], [True] * 4)
    assert model.predict(["the cat and the mat", "die katze und der hund", ""])[0] == ["en", "de", "und"]
