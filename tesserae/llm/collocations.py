"""Operator 13, phrase collocations from weighted acyclic automata.

A shard of texts gives its n-grams sorted, and from the sorted list, one after another, a count transducer is built: an
acyclic automaton whose states after two words on are the prefixes of phrases and whose weights are their counts. Equal
right sides are not merged, since their counts differ. A shard's transducer is cut by ranges of the prefix (of the hash
of a phrase's first two words), the parts of a range are united and their weights added, and states lighter than
`least` go with all that follows them. The weights on a phrase's own path are the counts of its first parts; those of
its other parts are looked up by composing a range's transducer with the paths that all others ask it for.

Before, words and then pairs of words are counted, since a phrase is as frequent as each of its pairs at most. What is
frequent is told to the shards as a filter of a fixed number of bits, so that its size doesn't grow with the corpus: a
full filter costs time, not rightness, as the weights decide. Shards count before they send, and no range holds more
of a prefix than one entry for each shard and continuation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import rounds, slots, text_of, tidied, tidy
from tesserae.llm.packed import cuts, joined, pack, range_of, unpack
from tesserae.session import written

#: Words of a phrase at most, its least count, and the phrases that are reported for each language.
LONGEST, LEAST, TOP = 4, 30, 2000
#: A longer candidate with this percentage of a phrase's count or more replaces it.
COVERED = 80
#: Bytes of text in a shard, and bits (as a power of 2) of the filters.
SHARD_BYTES, FILTER_BITS = 1 << 23, 27

#: Fixed set: what ends a piece. Words lie between spaces and tabs.
ENDS = b".,;:!?\n\x0b\x0c\r"
_BREAK = b"\xff"  # in no UTF-8 text
_TO_BREAK = bytes.maketrans(ENDS, b"\n" * len(ENDS))


def _tokens(text: str) -> list[bytes]:
    """Words, A-Z lower-cased, with a mark between pieces and one at the end."""
    return text.encode().lower().translate(_TO_BREAK).replace(b"\n", b" \xff ").split() + [_BREAK]


def _symbols(langs: list[str], texts: list[str]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard: tokens by text, the text of each token, which ones are marks, and 64-bit symbols of language and word."""
    from xxhash import xxh3_64_intdigest

    tokens = [_tokens(t) for t in texts]
    sizes = np.array([len(t) for t in tokens])
    h = np.concatenate([np.fromiter(map(xxh3_64_intdigest, t), np.uint64, len(t)) for t in tokens])
    seed = {x: xxh3_64_intdigest(x.encode()) for x in set(langs)}
    text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    breaks = h == np.uint64(xxh3_64_intdigest(_BREAK))
    return tokens, text, breaks, joined(np.array([seed[x] for x in langs], np.uint64)[text], h)


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[str], list[str]]]:
    for b in batches:
        for part, texts in rounds(b, 1, size):
            yield part.column(0).to_pylist(), texts


def _words(size: int):
    """Counts of a shard's words, (symbol, lang, word, n), and, with a null word, of all words of a language."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _shards(batches, size):
            tokens, text, breaks, symbols = _symbols(langs, texts)
            at = np.flatnonzero(~breaks)
            which, first, n = np.unique(symbols[at], return_index=True, return_counts=True)
            first = at[first]
            begin = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
            words = [tokens[d][i - begin[d]].decode() for d, i in zip(text[first].tolist(), first.tolist())]
            all_of: dict[str, int] = {}
            for lang, k in zip(langs, np.bincount(text[at], minlength=len(texts)).tolist()):
                all_of[lang] = all_of.get(lang, 0) + k
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([which.view(np.int64), np.zeros(len(all_of), np.int64)])),
                    pa.array([langs[d] for d in text[first].tolist()] + list(all_of), pa.string()),
                    pa.array(words + [None] * len(all_of), pa.string()),
                    pa.array(np.concatenate([n, np.array(list(all_of.values()), np.int64)])),
                ],
                ["symbol", "lang", "word", "n"],
            )

    return run


def _bits(hashes: np.ndarray, filter_bits: int) -> pa.Table:
    """The filter bits of hashes that lie near together, as bytes from an offset on."""
    at = np.unique(hashes >> np.uint64(64 - filter_bits)).astype(np.int64)
    if not len(at):
        return pa.table({"offset": pa.array([], pa.int64()), "bits": pa.array([], pa.binary())})
    offset = at[0] >> 3
    bits = np.zeros(((at[-1] >> 3) - offset + 1) * 8, np.uint8)
    bits[at - offset * 8] = 1
    return pa.table({"offset": [offset], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def _filter(slices: DataFrame, filter_bits: int) -> np.ndarray:
    """All slices as one filter: its bits bound what reaches the driver and is broadcast."""
    full = np.zeros(1 << (filter_bits - 3), np.uint8)
    for offset, bits in slices.toLocalIterator():
        part = np.frombuffer(bits, np.uint8)
        full[offset : offset + len(part)] |= part
    return full


def _passes(full: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - (len(full).bit_length() + 2))
    return (full[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _frequent_pairs(langs: list[str], texts: list[str], words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of a shard, the hash of each with the next one, and where both are frequent words of one piece."""
    *_, breaks, symbols = _symbols(langs, texts)
    good = ~breaks & _passes(words, symbols)
    pairs = joined(symbols[:-1], symbols[1:])
    return symbols, pairs, good[:-1] & good[1:]


def _pairs(parts: int, words, size: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _shards(batches, size):
            _, pairs, good = _frequent_pairs(langs, texts, words.value)
            h, n = np.unique(pairs[good], return_counts=True)
            which, at = cuts(range_of(h, parts))
            data = [pack(np.diff(h[i:j], prepend=np.uint64(0)), n[i:j]) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(data, pa.binary())], ["part", "pairs"])

    return run


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, an index of each, and the sums of n."""
    order = np.argsort(keys)
    _, at = cuts(keys[order])
    first = order[at[:-1]]
    return keys[first], first, np.add.reduceat(n[order], at[:-1]) if len(n) else n


def _pair_bits(least: int, filter_bits: int):
    @tidied
    def run(table: pa.Table) -> pa.Table:
        found = [unpack(x.as_buffer()) for x in table.column("pairs")]
        keys, _, n = _added(np.concatenate([np.cumsum(h, dtype=np.uint64) for h, _ in found]), np.concatenate([n for _, n in found]))
        return _bits(keys[n >= least], filter_bits)

    return run


class Transducer:
    """An acyclic automaton over phrases of two to `longest` words, a weight for each phrase.

    levels[0] holds the states after two words, (first, second, weight, arcs), levels[k] the arcs on from the states of
    the level before, in their order: (word, weight, arcs). `arcs` counts a state's own arcs. keys[k] are the hashes of
    the paths to the states of a level.
    """

    def __init__(self, levels: list[list[np.ndarray]]):
        self.levels = levels
        self.keys = [joined(levels[0][0], levels[0][1])]
        for above, level in zip(levels, levels[1:]):
            self.keys.append(joined(np.repeat(self.keys[-1], above[-1].astype(np.int64)), level[0]))

    @classmethod
    def of_sorted(cls, symbols: list[np.ndarray], keys: list[np.ndarray], lengths: np.ndarray) -> Transducer:
        """From n-grams sorted by the keys of their paths: symbols[k] and keys[k - 2] by word, and how many words of each count."""
        levels: list[list[np.ndarray]] = []
        for k, key in enumerate(keys):
            has = np.flatnonzero(lengths >= k + 2)
            _, at = cuts(key[has])
            first = has[at[:-1]]
            labels = [symbols[0][first], symbols[1][first]] if k == 0 else [symbols[k + 1][first]]
            levels.append([*labels, np.diff(at).astype(np.uint64), np.zeros(len(first), np.uint64)])
            if k:
                parent = np.searchsorted(before, first, "right") - 1
                levels[k - 1][-1] = np.bincount(parent, minlength=len(before)).astype(np.uint64)
            before = first
        return cls(levels)

    def cut(self, parts: int) -> Iterator[tuple[int, bytes]]:
        """The transducer by ranges of the prefix."""
        which, at = cuts(range_of(self.keys[0], parts))
        for part, i, j in zip(which.tolist(), at[:-1].tolist(), at[1:].tolist()):
            yield part, self._packed(i, j)

    def _packed(self, i: int, j: int) -> bytes:
        out = []
        for level in self.levels:
            out.append(pack(*(c[i:j] for c in level)))
            ends = np.concatenate([[0], np.cumsum(level[-1].astype(np.int64))])
            i, j = int(ends[i]), int(ends[j])
        return b"".join(len(x).to_bytes(4, "little") + x for x in out)

    def packed(self) -> bytes:
        return self._packed(0, len(self.levels[0][0]))

    @classmethod
    def unpacked(cls, data: bytes) -> Transducer:
        levels, at = [], 0
        while at < len(data):
            n = int.from_bytes(data[at : at + 4], "little")
            levels.append(unpack(data[at + 4 : at + 4 + n]))
            at += 4 + n
        return cls(levels)

    @classmethod
    def union(cls, all_of: list[Transducer], least: int) -> Transducer:
        """One with the sums of the weights, less the states under `least`."""
        levels: list[list[np.ndarray]] = []
        for k in range(len(all_of[0].levels)):
            labels = [np.concatenate([t.levels[k][c] for t in all_of]) for c in range(2 if k == 0 else 1)]
            keys, first, n = _added(np.concatenate([t.keys[k] for t in all_of]), np.concatenate([t.levels[k][-2] for t in all_of]))
            stay = n >= least
            keys, first, n = keys[stay], first[stay], n[stay]
            if k:  # a state is heavy enough where one after it is
                above = np.concatenate([np.repeat(t.keys[k - 1], t.levels[k - 1][-1].astype(np.int64)) for t in all_of])[first]
                parent = rank[np.searchsorted(before, above)]
                order = np.lexsort((keys, parent))
                keys, first, n, parent = keys[order], first[order], n[order], parent[order]
                levels[k - 1][-1] = np.bincount(parent, minlength=len(before)).astype(np.uint64)
            levels.append([*(c[first] for c in labels), n, np.zeros(len(n), np.uint64)])
            rank = np.argsort(keys)  # states are found by key, wherever they stand
            before = keys[rank]
        return cls(levels)

    def weights(self, keys: np.ndarray) -> np.ndarray:
        """The composition with paths, given by their keys: the weight of each, 0 where there is none."""
        out = np.zeros(len(keys), np.uint64)
        for own, level in zip(self.keys, self.levels):
            order = np.argsort(own)
            at = np.minimum(np.searchsorted(own[order], keys), max(len(own) - 1, 0))
            if len(own):
                hit = own[order[at]] == keys
                out[hit] = level[-2][order[at[hit]]]
        return out

    def paths(self) -> Iterator[tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]]:
        """Level by level: the words of each phrase, its key, and the weights of its path from two words on."""
        words, weights = list(self.levels[0][:2]), [self.levels[0][-2]]
        yield words, self.keys[0], weights
        for above, level, keys in zip(self.levels, self.levels[1:], self.keys[1:]):
            times = above[-1].astype(np.int64)
            words = [np.repeat(c, times) for c in words] + [level[0]]
            weights = [np.repeat(c, times) for c in weights] + [level[-2]]
            yield words, keys, weights


def _transducers(parts: int, words, pairs, longest: int, size: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _shards(batches, size):
            symbols, hashes, good = _frequent_pairs(langs, texts, words.value)
            good &= _passes(pairs.value, hashes)
            at = np.flatnonzero(good)
            lengths = np.full(len(at), 2)
            padded = np.concatenate([good, np.zeros(longest, bool)])
            for k in range(1, longest - 1):
                lengths += (lengths == k + 1) & padded[at + k]
            said = np.concatenate([symbols, np.zeros(longest, np.uint64)])
            labels = [said[at + k] for k in range(longest)]
            keys = [hashes[at]]
            for k in range(2, longest):
                keys.append(np.where(lengths > k, joined(keys[-1], labels[k]), np.uint64(0)))
            order = np.lexsort(keys[::-1])
            made = list(Transducer.of_sorted([c[order] for c in labels], [c[order] for c in keys], lengths[order]).cut(parts))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.int32()), pa.array([x for _, x in made], pa.binary())], ["part", "automaton"])

    return run


def _united(least: int):
    @tidied
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        one = Transducer.union([Transducer.unpacked(x.as_py()) for x in table.column("automaton")], least)
        return pa.table({"part": pa.array([part], pa.int32()), "automaton": pa.array([one.packed()], pa.binary())})

    return run


def _tails(words: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each rest of two words or more: the key of its first two words, which names its range, and its own."""
    out = []
    for k in range(1, len(words) - 1):
        prefix = key = joined(words[k], words[k + 1])
        for w in words[k + 2 :]:
            key = joined(key, w)
        out.append((prefix, key))
    return out


def _asked(parts: int):
    """The rests that the phrases of a range ask for, by the range that has them."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(1):
                tails = [t for words, *_ in Transducer.unpacked(x.as_py()).paths() for t in _tails(words)]
                prefix, keys = (np.concatenate([t[k] for t in tails] or [np.zeros(0, np.uint64)]) for k in range(2))
                keys, first = np.unique(keys, return_index=True)
                part = range_of(prefix[first], parts)
                order = np.argsort(part, kind="stable")
                which, at = cuts(part[order])
                data = [pack(keys[order[i:j]]) for i, j in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(data, pa.binary())], ["part", "keys"])

    return run


@tidied
def _composed(asked: pa.Table, automata: pa.Table) -> pa.Table:
    keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(unpack(x.as_buffer())[0] for x in asked.column("keys"))]))
    n = np.zeros(len(keys), np.uint64)
    for x in automata.column("automaton"):
        n += Transducer.unpacked(x.as_py()).weights(keys)
    return pa.table({"key": keys.view(np.int64), "n": n.astype(np.int64)})


def _candidates(longest: int):
    """Rows of the phrases: key, words, weights of the first parts of two words on, keys of the rests, and keys of all parts but the whole."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(1):
                for words, keys, weights in Transducer.unpacked(x.as_py()).paths():
                    inner = []
                    for i in range(len(words) - 1):
                        key = words[i]
                        for j in range(i + 1, len(words)):
                            key = joined(key, words[j])
                            if j - i + 1 < len(words):
                                inner.append(key)
                    lists = [words, weights, [t for _, t in _tails(words)], inner]
                    n = len(keys)
                    columns = [pa.array(keys.view(np.int64)), pa.array(weights[-1].astype(np.int64))]
                    for c in lists:
                        flat = np.stack(c, 1).reshape(-1).view(np.int64) if c else np.zeros(0, np.int64)
                        columns.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(c), pa.int32()), pa.array(flat)))
                    whole = pa.RecordBatch.from_arrays(columns, ["key", "a", "words", "firsts", "rests", "inner"])
                    yield from (whole.slice(i, 50_000) for i in range(0, n, 50_000))

    return run


def _exact(c: Column) -> Column:
    """A count for products that may pass 64 bits."""
    return c.cast("decimal(20,0)")


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, covered: int = COVERED, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """The phrases of each language that stick together most: (lang, rank, phrase, a, l, r, n, score).

    Texts, A-Z lower-cased, are split at ENDS into pieces and these at spaces and tabs into words. Phrases of 2 to
    `longest` words within a piece that occur `least` times or more in their language are candidates. Cut after its
    first k words, a phrase of count a has the score floor(2000000 a / (l + r)), l and r being the counts of its two
    parts; the cut of the lowest score, of these the first, counts. Candidates inside a longer one with `covered`
    percent or more of their count go. Each language's `top` best by score, count, then phrase in byte order, stay;
    n is the number of its words. A null language is `und`, a null text empty; ids play no part, so that repeated rows
    count as often as they occur. An empty table gives no rows. Words and phrases are told apart by 64-bit hashes.
    """
    if longest < 2 or least < 1:
        raise ValueError("longest must be 2 or more and least 1 or more")
    spark, parts, size, bits = docs.sparkSession, slots(docs), SHARD_BYTES, FILTER_BITS
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text"))
    counted = rows.mapInArrow(_words(size), "symbol long, lang string, word string, n long").groupBy("symbol", "lang", "word").agg(F.sum("n").alias("n"))
    vocabulary = written(counted.filter((F.col("n") >= least) | F.col("word").isNull()), "words")
    words = vocabulary.filter("word IS NOT NULL")
    part = F.shiftrightunsigned(F.shiftrightunsigned("symbol", 32) * parts, 32).cast("int")

    def word_bits(table: pa.Table) -> pa.Table:
        return _bits(table.column("symbol").to_numpy().view(np.uint64), bits)

    def pair_filter() -> np.ndarray:
        slices = rows.mapInArrow(_pairs(parts, word_filter, size), "part int, pairs binary").groupBy("part").applyInArrow(_pair_bits(least, bits), "offset long, bits binary")
        return _filter(written(slices, "pair-bits"), bits)

    slices = words.select(part.alias("part"), "symbol").groupBy("part").applyInArrow(word_bits, "offset long, bits binary")
    word_filter = spark.sparkContext.broadcast(_filter(slices, bits))
    frequent = spark.sparkContext.broadcast(pair_filter())
    shards = rows.mapInArrow(_transducers(parts, word_filter, frequent, longest, size), "part int, automaton binary")
    automata = written(shards.groupBy("part").applyInArrow(_united(least), "part int, automaton binary"), "automata")
    word_filter.unpersist()
    frequent.unpersist()

    asked = automata.select("part", "automaton").mapInArrow(_asked(parts), "part int, keys binary")
    parts_of = written(asked.groupBy("part").cogroup(automata.groupBy("part")).applyInArrow(_composed, "key long, n long"), "parts")
    kind = "key long, a long, words array<long>, firsts array<long>, rests array<long>, inner array<long>"
    found = written(automata.select("part", "automaton").mapInArrow(_candidates(longest), kind), "phrases")
    return _ranked(found, words, parts_of, vocabulary.filter("word IS NULL").select("lang", F.col("n").alias("n")), longest, top, covered)


def _ranked(found: DataFrame, words: DataFrame, parts_of: DataFrame, totals: DataFrame, longest: int, top: int, covered: int) -> DataFrame:
    """Candidates less the covered ones, with their cut and score, the best of each language."""
    cover = found.select(F.explode("inner").alias("key"), "a").groupBy("key").agg(F.max("a").alias("_longer"))
    kept = found.join(cover, "key", "left").filter(F.coalesce(_exact(F.col("_longer")) * 100 < _exact(F.col("a")) * covered, F.lit(True)))
    first = words.select(F.col("symbol").alias("_s1"), F.col("n").alias("_f1"), "lang")
    last = words.select(F.col("symbol").alias("_s2"), F.col("n").alias("_f2"))
    kept = kept.withColumn("_s1", F.col("words")[0]).withColumn("_s2", F.element_at("words", -1)).join(first, "_s1").join(last, "_s2")
    rest = [F.lit(None).cast("long")] * (longest + 1)
    for k in range(1, longest - 1):
        kept = kept.withColumn("_key", F.get("rests", F.lit(k - 1))).join(parts_of.select(F.col("key").alias("_key"), F.col("n").alias(f"_r{k}")), "_key", "left").drop("_key")
        rest[k] = F.col(f"_r{k}")
    size = F.size("words")
    for k in range(1, longest):
        left = F.col("_f1") if k == 1 else F.get("firsts", F.lit(k - 2))
        kept = kept.withColumns({f"_left{k}": left, f"_right{k}": F.when(size == k + 1, F.col("_f2")).otherwise(rest[k])})
    cut = "IF(size(words) > {0}, struct(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(_left{0} AS DECIMAL(20,0)) + CAST(_right{0} AS DECIMAL(20,0))) AS score, {0} AS k, _left{0} AS l, _right{0} AS r), NULL)"
    kept = kept.withColumn("_cut", F.array_min(F.array(*[F.expr(cut.format(k)) for k in range(1, longest)])))
    kept = kept.select("key", "lang", "words", "a", "_cut.l", "_cut.r", "_cut.score")
    order = [F.desc("score"), F.desc("a")]
    best = written(kept.withColumn("_rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("_rank") <= top).drop("_rank"), "best")
    spelt = best.select("key", F.posexplode("words").alias("_at", "symbol")).join(words.select("symbol", "word"), "symbol")
    spelt = spelt.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    out = best.join(spelt, "key").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).filter(F.col("rank") <= top)
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13(docs: DataFrame) -> DataFrame:
    """Each language's first 2000 phrases: lang, rank, phrase, a, l, r, n, score."""
    return collocations(docs.select("lang", "text"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT d, lang, generate_subscripts(ps, 1) AS k, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS ws FROM d),
w AS (SELECT d, lang, k, generate_subscripts(ws, 1) AS i, unnest(ws) AS w1 FROM p),
s AS (SELECT lang, w1, lead(w1, 1) OVER q AS w2, lead(w1, 2) OVER q AS w3, lead(w1, 3) OVER q AS w4 FROM w WINDOW q AS (PARTITION BY d, k ORDER BY i)),
g AS (SELECT lang, w1 AS phrase, 1 AS m FROM s UNION ALL SELECT lang, w1 || ' ' || w2, 2 FROM s WHERE w2 IS NOT NULL
UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3 FROM s WHERE w3 IS NOT NULL UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, 4 FROM s WHERE w4 IS NOT NULL),
f AS (SELECT lang, phrase, m, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, phrase, m, a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND a >= 30),
inside AS (SELECT lang, array_to_string(ws[i : i + k - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, ws, m, a, k, unnest(range(1, m - k + 2)) AS i FROM c, (VALUES (2), (3)) AS s(k) WHERE k < m) GROUP BY 1, 2),
cuts AS (SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, CAST(2000000::HUGEINT * c.a // (x.a + y.a) AS BIGINT) AS score
FROM c JOIN (VALUES (1), (2), (3)) AS s(k) ON k < c.m JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1 : k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1 : c.m], ' ')),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT low.* FROM low LEFT JOIN inside USING (lang, phrase) WHERE inside.longer IS NULL OR 100::HUGEINT * inside.longer < 80::HUGEINT * low.a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, score FROM kept)
SELECT lang, rank, phrase, a, l, r, n.n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
