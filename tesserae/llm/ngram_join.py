"""Operator 2, n-gram Jaccard join with adaptive multi-match prefixes.

Two sets whose Jaccard coefficient reaches the threshold share at least l of the first p + l - 1 of
their elements, in any order common to all sets, where p is the length of the plain prefix. So a longer
prefix costs more index rows but asks for more shared elements.

1. Sets that are equal become one class, found by a 128-bit hash of the set.
2. Screening: in hash order, a class stays only if l elements of its prefix occur in another's.
3. The elements of the classes left are counted, the rare put first, those of one class alone left out
   of the index (they only push the prefix along), and each class takes the l of least estimated cost.
4. Groups of near copies would make pairs by the square of their size. So each class is first verified
   against one central class that it meets in the index, in rounds; classes found linked share a label.
   What remains to be compared are pairs with different labels: exactly those pairs that meet in the
   index, in partitions of set length where a set meets its own and the two next ones, whose 256-bit parities don't already differ in more bits than the sets may in elements, and
   that share l elements, are verified on whole sets.

Components come from the verified links. Nothing is capped: all that the rounds do is spare pairs whose
two ends are already known to be connected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import id_back, id_of, rounds, row_hash, slots, text_of, tidy
from tesserae.llm.components import components
from tesserae.session import written

#: What makes a text's sorted distinct 64-bit elements.
Elements = Callable[[str], np.ndarray]
#: Elements counted beyond this are equally frequent for the order; it bounds what a task holds of one run.
FREQUENT = 1000
#: Longest l, and the cost of verifying a pair in index rows.
MOST_MATCHES, VERIFY = 12, 40
#: A plain prefix whose most frequent element is at most so many times as frequent as its rarest is of one
#: group of near copies, which share nearly all; more matches would rule out none of them, so l is 1.
ALIKE = 3
#: Rounds against central classes before the exact rest.
ROUNDS = 1
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)


def _mix(x: np.ndarray, by: np.uint64) -> np.ndarray:
    x = (x ^ (x >> _S32)) * by
    return x ^ (x >> _S29)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space, A-Z lower-cased."""
    from xxhash import xxh3_64_intdigest

    words = text.encode().lower().split()  # of bytes: ASCII alone
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(text: str, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of runs of `size` words; of fewer words the run of all; of none, none."""
    h = word_hashes(text)
    if not len(h):
        return np.zeros(0, np.int64)
    size = min(size, len(h))
    n = len(h) - size + 1
    x = _mix(h[:n] + np.uint64(size), _P)
    for k in range(1, size):
        x = _mix(x * _Q + h[k : k + n], _P)
    return np.unique(x.view(np.int64))


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a set, whatever its order."""
    u = s.view(np.uint64)
    return int(_mix(u, _Q).sum(dtype=np.uint64).view(np.int64)), int(_mix(u + _P, _P).sum(dtype=np.uint64).view(np.int64))


def parity(s: np.ndarray) -> np.ndarray:
    """256 bits in four longs, each the parity of the elements that hash to it: sets differ in as many elements at least as their bits."""
    odd = np.bincount((_mix(s.view(np.uint64), _P) >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def plain_prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def screen_matches(n: int) -> int:
    return 1 + n // 20


def overlap(a: Column, b: Column, percent: int) -> Column:
    """The least overlap of sets of sizes a and b that reaches the threshold."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100.0 + percent) - F.lit(1e-9))


def _sets(docs: DataFrame, elements: Elements, percent: int) -> DataFrame:
    """Of each row: (id, row, n, s1, s2, screen), with the set's size, its hash, and its prefix in hash order."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in (part for whole in batches for part in rounds(whole, 2)):
            n, s1, s2, screen = [], [], [], []
            for text in texts:
                s = elements(text)
                x, y = set_hash(s)
                n.append(len(s))
                s1.append(x)
                s2.append(y)
                screen.append(s[: plain_prefix(len(s), percent) + screen_matches(len(s)) - 1] if len(s) else s)
            made = [pa.array(c, pa.int64()) for c in (n, s1, s2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made, pa.array(screen, pa.list_(pa.int64()))], ["id", "row", "n", "s1", "s2", "screen"])

    return docs.select("_id", "_row", "_text").mapInArrow(run, "id long, row long, n long, s1 long, s2 long, screen array<long>")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (token, node) sorted by both: the nodes of tokens that another node has. Edges of a task count as shared."""
    last = None  # token, node and whether shared of the row before
    for b in batches:
        if not b.num_rows:
            continue
        t, v = b.column(0).to_numpy(), b.column(1).to_numpy()
        same = np.zeros(len(t) + 1, bool)  # whether row i - 1 and i are of one token
        same[1:-1] = t[1:] == t[:-1]
        same[0] = last is None or last[0] == t[0]
        out = v[same[:-1] | same[1:]].tolist()
        if last is not None and same[0] and not last[2]:
            out.append(last[1])
        last = (t[-1], int(v[-1]), bool(same[-2]))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["node"])
    if last is not None and not last[2]:
        yield pa.RecordBatch.from_arrays([pa.array([last[1]], pa.int64())], ["node"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (token, node, n) sorted: each with the number of its token's nodes where there are two.

    At most FREQUENT rows of a run are held; longer runs, and the first and last run of a task, which
    may go on in another, all count as FREQUENT.
    """
    names = ["node", "n", "token", "df"]
    held: list[tuple[np.ndarray, np.ndarray]] = []
    token, count, first, long = None, 0, True, False

    def rows(v, n, t, df) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v), pa.array(n), pa.array(t), pa.array(df.astype(np.int32))], names)

    def flush(df: int) -> Iterator[pa.RecordBatch]:
        if held and df > 1:
            v, n = (np.concatenate(c) for c in zip(*held))
            yield rows(v, n, np.full(len(v), token, np.int64), np.full(len(v), df))
        held.clear()

    prior = None
    for b in batches:
        if not b.num_rows:
            continue
        t, v, n = (b.column(i).to_numpy() for i in range(3))
        again = np.zeros(len(t), bool)
        again[1:] = (t[1:] == t[:-1]) & (v[1:] == v[:-1])
        again[0] = prior == (int(t[0]), int(v[0]))
        prior = (int(t[-1]), int(v[-1]))
        t, v, n = t[~again], v[~again], n[~again]
        if not len(t):
            continue
        cut = np.flatnonzero(t[1:] != t[:-1]) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(t)]])
        if token is not None and t[0] == token:
            i, j = int(starts[0]), int(ends[0])
            held.append((v[i:j], n[i:j]))
            count += j - i
            starts, ends = starts[1:], ends[1:]
            if long or first or count > FREQUENT:
                long = True
                yield from flush(FREQUENT)
        if not len(starts):
            continue
        if token is not None:
            yield from flush(FREQUENT if first or long else count)
            first = False
        whole = slice(1 if token is None else 0, len(starts) - 1)
        lens = ends - starts
        if token is None and len(starts) > 1:
            yield rows(v[: ends[0]], n[: ends[0]], t[: ends[0]], np.full(int(ends[0]), FREQUENT))
            first = False
        df = np.repeat(np.minimum(lens[whole], FREQUENT), lens[whole])
        if len(df):
            a, z = int(starts[whole][0]), int(ends[whole][-1])
            keep = df > 1
            if keep.any():
                yield rows(v[a:z][keep], n[a:z][keep], t[a:z][keep], df[keep])
        i = int(starts[-1])
        token, count, long = int(t[i]), len(t) - i, False
        held.append((v[i:], n[i:]))
    yield from flush(FREQUENT)


def _index(rows: DataFrame, percent: int) -> DataFrame:
    """The prefix of each class, rare elements first, as index rows (token, node, n, pos, matches, score).

    `matches` is the l of least cost, in which a prefix costs its index rows and, for each pair that
    its rows could bring to l matches, a verification. `score` is the share of elements that no other
    class has: low for the centre of a group of near copies.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            lists = b.column(2)
            flat = lists.flatten()
            df_all, token_all = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            for k, (node, n) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                df, token = df_all[bounds[k] : bounds[k + 1]], token_all[bounds[k] : bounds[k + 1]]
                alone = n - len(df)
                plain = plain_prefix(n, percent) - alone
                most = min(MOST_MATCHES, n - plain_prefix(n, percent) + 1)  # no pair can be held to more than the least overlap
                if plain + most - 1 <= 0:
                    continue
                cost = np.concatenate([[0], np.cumsum(df - 1.0)])
                l = np.arange(1, most + 1)  # noqa: E741
                rows_of = cost[np.clip(plain + l - 1, 0, len(df))]
                best = int(l[np.argmin(rows_of + VERIFY * rows_of / l)])
                if plain <= 0 or len(df) < plain or df[plain - 1] <= ALIKE * df[0]:
                    best = 1
                m = min(len(df), plain + best - 1)
                if m < best:
                    continue
                for c, x in zip(out, (token[:m], np.full(m, node), np.full(m, n), alone + np.arange(m), np.full(m, best), np.full(m, alone * 1000 // n))):
                    c.append(x.astype(np.int64))
            cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(cols, types)], ["token", "node", "n", "pos", "matches", "score"])

    per = rows.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("_e"))  # at most one document's elements
    return per.mapInArrow(run, "token long, node long, n int, pos int, matches int, score int")


def _central(percent: int):
    """Of index rows with labels sorted by (token, score, node): the most central node with another label, for each row that may link with it."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # of the run that the last batch ended in: its first row, and its first row of another label
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([c.to_numpy().astype(np.int64) for c in b.columns])
            n_held = held.shape[1] if held is not None and held[0, 0] == rows[0, 0] else 0
            if n_held:
                rows = np.concatenate([held, rows], 1)
            t, v, n, pos, score, label = rows
            i = np.arange(len(t))
            head = np.ones(len(t), bool)
            head[1:] = t[1:] != t[:-1]
            starts = np.flatnonzero(head)
            first = starts[np.cumsum(head) - 1]
            other = label != label[first]
            second = np.minimum.reduceat(np.where(other, i, len(t)), starts)
            turn = second[np.cumsum(head) - 1]
            top = np.where(other, first, np.where(turn < i, turn, -1))
            to = np.flatnonzero((top >= 0) & (i >= n_held))
            by = top[to]
            need = -(-percent * (n[to] + n[by]) // (100 + percent))
            ok = (np.minimum(n[to], n[by]) >= need) & (n[to] - pos[to] >= need) & (n[by] - pos[by] >= need)
            to, by = to[ok], by[ok]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (v[to], score[by], v[by])], ["a", "score", "b"])
            last = [int(starts[-1])] + ([int(second[-1])] if second[-1] < len(t) else [])
            held = rows[:, last]

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose whole sets reach the threshold."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            good = []
            for k in range(batch.num_rows):
                s, t = x[k].values.to_numpy(), y[k].values.to_numpy()
                both = np.concatenate([s, t])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(both) - shared))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("_x"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("_y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "_x", "_y")
    return joined.mapInArrow(run, "a long, b long")


def _labelled(index: DataFrame, links: DataFrame | None) -> DataFrame:
    """Index rows with the label of their class: that of its component, or itself."""
    if links is None:
        return index.withColumn("label", F.col("node"))
    known = written(components(links), "labels")
    return index.join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _links(docs: DataFrame, classes: DataFrame, elements: Elements, percent: int, repeated: bool) -> DataFrame:
    """Links between classes that connect all that are connected. Each class has the id and the row hash of a document, `repeated` where several rows may have both."""
    parts = slots(docs)
    screened = classes.select(F.explode("screen").alias("token"), "node")
    ordered = screened.repartitionByRange(parts, "token", "node").sortWithinPartitions("token", "node")
    hits = ordered.mapInArrow(_shared, "node long").groupBy("node").agg(F.count(F.lit(1)).alias("_hits"))
    least = 1 + F.floor(F.ceil(F.lit(percent) * F.col("n") / 100) / 20)  # l of the smallest set that could be a partner
    left = written(classes.select("node", "id", "row", "n", "s1", "s2").join(hits, "node").filter(F.col("_hits") >= least).drop("_hits"), "screened")

    @tidy
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in (part for batch in batches for part in rounds(batch, 3)):
            nodes, tokens, bits = [], [], []
            for node, s1, s2, text in zip(*(b.column(k).to_pylist() for k in range(3)), found):
                s = elements(text)
                if set_hash(s) == (s1, s2):
                    nodes.append(node)
                    tokens.append(s)
                    bits.append(parity(s))
            bits = np.array(bits, np.int64).reshape(-1, 4)
            parities = [pa.array(np.ascontiguousarray(bits[:, k])) for k in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), *parities], ["node", "tokens", "b0", "b1", "b2", "b3"])

    # a merge join at any size: what is left of the screening grows with the input and is never broadcast
    of = left.select(F.col("id").alias("_id"), F.col("row").alias("_row"), "node", "s1", "s2").hint("merge")
    texts = docs.join(of, ["_id", "_row"]).select("node", "s1", "s2", "_text")
    texts = texts.dropDuplicates(["node"]) if repeated else texts
    sets = written(texts.mapInArrow(whole, "node long, tokens array<long>, b0 long, b1 long, b2 long, b3 long"), "sets")
    rows = sets.select(F.explode("tokens").alias("token"), "node", F.size("tokens").cast("long").alias("n"))
    ordered = rows.repartitionByRange(parts, "token", "node").sortWithinPartitions("token", "node")
    index = written(_index(ordered.mapInArrow(_counted, "node long, n long, token long, df int"), percent), "index")
    links = None
    for _ in range(ROUNDS):
        rows = _labelled(index, links).select("token", "node", "n", "pos", "score", "label")
        ordered = rows.repartitionByRange(parts, "token", "score", "node").sortWithinPartitions("token", "score", "node")
        met = ordered.mapInArrow(_central(percent), "a long, score long, b long").groupBy("a").agg(F.min(F.struct("score", "b")).alias("_b"))
        found = written(_verified(met.select("a", F.col("_b.b").alias("b")), sets, percent), "links")
        if found.isEmpty():
            break
        links = found if links is None else links.union(found)
    rows = _labelled(index, links)
    if links is not None:
        sizes = rows.select("node", "label").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("_size"))
        rows = rows.join(sizes, "label")
    else:
        rows = rows.withColumn("_size", F.lit(1).cast("long"))
    rows = written(rows, "labelled")
    main = rows.groupBy("token").agg(F.max(F.struct("_size", "label")).alias("_m"), F.min("label").alias("_l0"), F.max("label").alias("_l1"))
    main = written(main.filter("_l0 != _l1").select("token", F.col("_m.label").alias("_main")), "mixed")
    bits = sets.select("node", "b0", "b1", "b2", "b3").dropDuplicates(["node"])
    mixed = written(rows.join(main, "token").join(bits, "node"), "mixed-rows")
    x, y = (mixed.select(*[F.col(c).alias(f"{p}{c}") for c in ("token", "node", "n", "pos", "matches", "label", "_main", "b0", "b1", "b2", "b3")]) for p in "xy")
    width = max(log(100 / percent), 0.01) * 1.001  # of the partitions of set length: sets that link are in the same or in neighbouring ones
    part = lambda n: F.floor(F.log(n) / width)
    near = F.explode(F.array(*[part(F.col("xn")) + k for k in (-1, 0, 1)]))
    x = x.filter("xlabel != x_main").withColumn("xpart", near)
    y = y.withColumn("ypart", part(F.col("yn")))
    l = F.least("xmatches", "ymatches")  # noqa: E741
    need = overlap(F.col("xn"), F.col("yn"), percent)
    apart = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"xb{k}").bitwiseXOR(F.col(f"yb{k}"))) for k in range(4)])
    meet = (
        (F.col("xtoken") == F.col("ytoken"))
        & (F.col("xpart") == F.col("ypart"))
        & (F.col("xlabel") != F.col("ylabel"))
        & ((F.col("ylabel") == F.col("y_main")) | (F.col("xnode") < F.col("ynode")))
        & (need <= F.least("xn", "yn"))
        & (apart <= F.col("xn") + F.col("yn") - 2 * need)
        & (F.col("xpos") <= F.col("xn") - need + l - 1)
        & (F.col("ypos") <= F.col("yn") - need + l - 1)
    )
    # a token makes a pair in one direction only, but which one depends on its main label
    pairs = x.join(y, meet).groupBy(F.least("xnode", "ynode").alias("a"), F.greatest("xnode", "ynode").alias("b")).agg(F.count(F.lit(1)).alias("_c"), F.max(l).alias("_l"))
    rest = written(_verified(pairs.filter("_c >= _l").select("a", "b"), sets, percent), "links")
    return rest if links is None else links.union(rest)


def _by_id(sets: DataFrame, keys: DataFrame, links: DataFrame) -> DataFrame:
    """The component of each id, where ids repeat: (id, component), the classes of one id being linked."""
    held = written(sets.select("id", "s1", "s2").distinct().join(keys.select("s1", "s2", "node"), ["s1", "s2"]).select("id", "node"), "held")
    first = held.groupBy("id").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    labels = components(links.union(held.join(written(first, "first"), "id").select(F.col("node").alias("a"), "b")))
    by_id = written(held.join(labels, "node", "left").groupBy("id").agg(F.min(F.coalesce("label", "node")).alias("label")), "id-labels")
    return written(by_id.join(by_id.groupBy("label").agg(F.min("id").alias("component")), "label").select("id", "component"), "by-id")


def set_components(docs: DataFrame, elements: Elements, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The component of each row where texts link whose sets reach percent / 100: (id, n_elements, component_id, class_id).

    `elements` gives a text's sorted distinct 64-bit elements. class_id is the smallest id with an equal
    set, component_id the smallest id reached by links. Empty sets link with nothing. A null id is after
    all others. Rows that repeat an id, as all with a null one do, have their own n_elements and class_id,
    and are one document for the links: what links with the text of any of them links with the id. One row
    for each row; an empty table gives none.
    """
    rows = docs.select(id_of(id_col).alias("_id"), row_hash(text_col).alias("_row"), text_of(text_col).alias("_text"))
    sets = written(_sets(rows, elements, percent), "screens")
    repeated = not sets.groupBy("id").count().filter("count > 1").isEmpty()
    # a class goes by the smallest id that has it, or by a number of its own where one id may have several
    node = F.monotonically_increasing_id() if repeated else F.col("id")
    keys = sets.filter("n > 0").groupBy("s1", "s2").agg(F.min(F.struct("id", "row")).alias("_r")).select("s1", "s2", "_r.id", "_r.row")
    keys = written(keys.withColumn("node", node), "classes")
    classes = sets.join(keys, ["id", "row", "s1", "s2"]).select("node", "id", "row", "n", "s1", "s2", "screen")
    classes = classes.dropDuplicates(["node"]) if repeated else classes
    links = _links(rows, written(classes, "representatives"), elements, percent, repeated)
    # copies hang on their class, so components are found among classes
    out = sets.select("id", "n", "s1", "s2").join(keys.select("s1", "s2", "node", F.col("id").alias("first")), ["s1", "s2"], "left")
    if repeated:
        out = out.join(_by_id(sets, keys, links), "id", "left")
    else:
        out = out.join(components(links), "node", "left").withColumn("component", F.coalesce("label", "node"))
    return out.select(
        id_back("id").alias("id"),
        F.col("n").alias("n_elements"),
        id_back(F.coalesce("component", "id")).alias("component_id"),
        id_back(F.coalesce("first", "id")).alias("class_id"),
    )


def ngram_components(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """set_components of the shingles of `size` words; n_elements is called n_shingles. Documents without words have none."""
    return set_components(docs, partial(shingles, size=size), percent, id_col, text_col).withColumnRenamed("n_elements", "n_shingles")


def op2(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, at three words and 90 percent."""
    return ngram_components(docs, 3, 90).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
