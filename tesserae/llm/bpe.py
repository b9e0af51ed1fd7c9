"""Operator 9, BPE encoding and decoding by speculation and verification.

For each new word the longest vocabulary entries that fit, from left to right, are proposed as its
tokens. A sequence of tokens is what the merges would give exactly if every adjacent pair is: the
first merge across a boundary could only join a node of the right edge of one token's merge tree with
a node of the left edge of the next one's. All adjacent pairs of all new words of a batch are tested
together with array operations, and only words with a failing pair go through the merges one by one.

Words repeat. Texts of Latin-1 characters are cut into words by array operations over a megabyte of text
at a time, each distinct word is looked up or encoded once, and a text's ids are gathered from its words'.
A worker keeps the ids of the words that it has seen, up to a fixed number.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import rounds, shipped, text_of, tidy

#: Words whose ids a worker keeps; when it has more, it starts anew.
KEPT = 120_000
#: Bytes of text whose distinct words are looked up together.
TEXT = 1 << 20
#: Words of at most so many bytes are merged together, longer ones each alone.
SHORT = 32
#: Longer words are proposed one by one, and not kept when a worker starts anew.
LONG = 64

_FAR = np.iinfo(np.int64).max
#: Fixed pattern of the word tokenizer's file; on text of the first 256 code points cut_words gives the same pieces.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What decode() puts between tokens of a file without a decoder.
GAP = " "


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b not in set(hidden) else chr(256 + hidden.index(b)) for b in range(256)]


class Merges:
    """The vocabulary and merges of a BPE model whose alphabet is bytes, perhaps with a mark at word ends."""

    def __init__(self, model: dict):
        self.end = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        chars = byte_chars()
        self.byte = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + self.end] for c in chars], np.int64)
        n = max(vocab.values()) + 1
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.left, self.right, self.rank = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if self.rank[z] >= 0:
                continue  # made by an earlier merge already; checked below like any other token
            self.left[z], self.right[z], self.rank[z] = x, y, rank
            self.pair[x, y] = (rank, z)
        self.size, self.none = n, len(pairs)
        self.made = np.zeros(len(pairs) + 1, np.int32)
        for rank, z in self.pair.values():
            self.made[rank] = z
        keys = np.array([x * n + y for x, y in self.pair], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([r for r, _ in self.pair.values()], np.int64)[order]
        unbyte = {c: b for b, c in enumerate(chars)}
        self.inner: dict[bytes, int] = {}
        self.ending: dict[bytes, int] = {}
        made = [t for t in vocab if self.rank[vocab[t]] >= 0 or len(t.removesuffix(self.end) if self.end else t) == 1]
        spelled = {}
        for t in made:
            ends = bool(self.end) and t.endswith(self.end) and len(t) > len(self.end)
            body = t[: -len(self.end)] if ends else t
            if all(c in unbyte for c in body):
                spelled[vocab[t]] = (bytes(unbyte[c] for c in body), ends)
        for i in self._whole(spelled):
            body, ends = spelled[i]
            if ends or not self.end:
                self.ending[body] = i
            if not ends:
                self.inner[body] = i
        self.most = max(map(len, [*self.inner, *self.ending]))
        self.reach: dict[bytes, int] = {}  # the longest token within words by its first two bytes
        for t in self.inner:
            self.reach[t[:2]] = max(len(t), self.reach.get(t[:2], 1))
        self.names = {i: t for t, i in vocab.items()}
        self._plant()

    def _plant(self) -> None:
        """The proposed tokens as a tree of bytes: sorted (node, byte) keys with the node below each, and the tokens that end at a node."""
        nodes: dict[bytes, int] = {b"": 0}
        keys, below = [], []
        for t in (*self.inner, *self.ending):
            for k in range(1, len(t) + 1):
                if t[:k] not in nodes:
                    keys.append(nodes[t[: k - 1]] * 256 + t[k - 1])
                    nodes[t[:k]] = len(nodes)
                    below.append(nodes[t[:k]])
        order = np.argsort(keys)
        self.edge, self.below = np.append(np.array(keys, np.int64)[order], _FAR), np.append(np.array(below, np.int64)[order], 0)
        self.ends = np.full((2, len(nodes)), -1, np.int32)  # tokens within words, tokens at the end
        for row, tokens in enumerate((self.inner, self.ending)):
            self.ends[row, [nodes[t] for t in tokens]] = list(tokens.values())
        self.second = np.zeros(1 << 16, np.int32)  # the node of each two bytes, 0 for none
        for t, node in nodes.items():
            if len(t) == 2:
                self.second[t[0] << 8 | t[1]] = node

    def proposed(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """`longest` of many words at a time: owners and tokens. One token of every word in a round, one byte of every token in a step."""
        size = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(size)
        at, data = end - size, np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int64)
        live, owners, tokens = np.flatnonzero(size), [], []
        while len(live):
            p, left = at[live], end[live] - at[live]
            best, reach = np.where(left == 1, self.last[data[p]], self.byte[data[p]]), np.ones(len(p), np.int64)
            node = np.where(left > 1, self.second[data[p] << 8 | data[p + 1]], 0)
            some, depth = np.flatnonzero(node), 2
            node = node[some]
            while len(some):
                last = left[some] == depth
                found = self.ends[last.astype(np.int8), node]
                ok = found >= 0
                best[some[ok]], reach[some[ok]] = found[ok], depth
                some, node = some[~last], node[~last]
                key = node * 256 + data[p[some] + depth]
                i = np.searchsorted(self.edge, key)
                hit = self.edge[i] == key
                some, node = some[hit], self.below[i[hit]]
                depth += 1
            owners.append(live)
            tokens.append(best)
            at[live] += reach
            live = live[at[live] < end[live]]
        return by_owner(owners, tokens)

    def _whole(self, spelled: dict[int, tuple[bytes, bool]]) -> list[int]:
        """Tokens that the merges give for their own spelling: base ones, and those whose two halves are whole and fit."""
        ids = np.array(sorted(spelled, key=lambda i: self.rank[i]), np.int64)
        made = ids[self.rank[ids] >= 0]
        ok = np.ones(self.size, bool)
        fits = self.fit(self.left[made], self.right[made], self.rank[made])
        for i, f in zip(made.tolist(), fits.tolist()):
            ok[i] = f and ok[self.left[i]] and ok[self.right[i]]
        return [int(i) for i in ids if ok[i]]

    def fit(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge (of a rank below the given) crosses the boundary of each pair of tokens.

        From the whole tokens back to their edge symbols, the later made of the two nodes at the
        boundary is undone; each two nodes seen stood side by side between their making and their
        parents' making. A merge of the two in that time crosses; at an equal rank the leftmost goes first.
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        px = np.full(len(x), _FAR) if below is None else below.astype(np.int64)
        py = px.copy() if below is None else px - 1
        good, live = np.ones(len(x), bool), np.arange(len(x))
        while len(live):
            u, v = x[live], y[live]
            key = u * self.size + v
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], _FAR)
            crosses = (rank < px[live]) & (rank <= py[live]) & (rank != _FAR)
            good[live[crosses]] = False
            ru, rv = self.rank[u], self.rank[v]
            more = ~crosses & ((ru >= 0) | (rv >= 0))
            live, ru, rv = live[more], ru[more], rv[more]
            undo_x = ru > rv
            i, j = live[undo_x], live[~undo_x]
            px[i], x[i] = ru[undo_x], self.right[x[i]]
            py[j], y[j] = rv[~undo_x], self.left[y[j]]
        return good

    def longest(self, word: bytes) -> list[int]:
        """The longest tokens that fit, from left to right."""
        out, i, n, most = [], 0, len(word), self.most
        inner, ending, reach = self.inner.get, self.ending.get, self.reach.get
        while i < n:
            if n - i <= most and (t := ending(word[i:])) is not None:
                out.append(t)
                break
            for j in range(i + min(reach(word[i : i + 2], 1), n - i - (1 if self.end else 0)), i, -1):
                if (t := inner(word[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
            else:  # the last byte: its token is always there
                out.append(int(self.last[word[i]] if i == n - 1 else self.byte[word[i]]))
                i += 1
        return out

    def merged(self, words: list[bytes]) -> list[list[int]]:
        """The tokens of words by their merges, lowest rank first and leftmost among equals."""
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for i in order:
            if len(words[i]) > SHORT:
                out[i] = self._merged_long(words[i])
        short = [i for i in order if len(words[i]) <= SHORT]
        for k in range(0, len(short), 8192):
            part = short[k : k + 8192]
            for i, ids in zip(part, self._merged_together([words[i] for i in part])):
                out[i] = ids
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], self.none).astype(np.int32)

    def _merged_together(self, words: list[bytes]) -> list[list[int]]:
        """One merge in every word at a time; `ids` and the ranks of adjacent pairs are rows of arrays."""
        n = np.array([len(w) for w in words])
        width = int(n.max()) + 1
        place = np.arange(width)
        symbols = np.zeros((len(words), width), np.uint8)
        symbols[place < n[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        ids = np.where(place < n[:, None], self.byte[symbols], -1).astype(np.int32)
        rows = np.arange(len(words))
        ids[rows, n - 1] = self.last[symbols[rows, n - 1]]
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        done: list[list[int]] = [[]] * len(words)
        while True:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            ended = best == self.none
            if ended.any():
                for r, row in zip(rows[ended].tolist(), ids[ended].tolist()):
                    done[r] = [t for t in row if t >= 0]
                go = ~ended
                rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
            if not len(rows):
                return done
            every = np.arange(len(rows))
            ids[every, at] = self.made[best]
            shift = place[: ids.shape[1] - 1]
            ids = np.take_along_axis(ids, shift + (shift > at[:, None]), 1)
            ids = np.concatenate([ids, np.full((len(rows), 1), -1, np.int32)], 1) if ids.shape[1] < 2 else ids
            shift = place[: ids.shape[1] - 1]
            ranks = np.take_along_axis(ranks, shift + (shift >= at[:, None]), 1) if ranks.shape[1] > ids.shape[1] - 1 else ranks
            here = np.minimum(at, ids.shape[1] - 2)
            ranks[every, here] = self._ranks(ids[every, here], ids[every, here + 1])
            prior = np.flatnonzero(at > 0)
            q = at[prior] - 1
            ranks[prior, q] = self._ranks(ids[prior, q], ids[prior, q + 1])

    def _merged_long(self, word: bytes) -> list[int]:
        """With a heap of the pairs and links between neighbours, so that time stays near linear in the length."""
        ids = [int(self.byte[b]) for b in word[:-1]] + [int(self.last[word[-1]])]
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(m[0], i, m[1]) for i, p in enumerate(zip(ids, ids[1:])) if (m := self.pair.get(p))]
        heapq.heapify(heap)
        while heap:
            _, i, z = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or self.pair.get((ids[i], ids[j]), (0, -1))[1] != z:
                continue
            ids[i], ids[j], after[i] = z, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (m := self.pair.get((ids[k], ids[after[k]]))):
                    heapq.heappush(heap, (m[0], k, m[1]))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' tokens in a row, and how many each has: proposed, tested pair by pair in one go, and merged where a pair fails."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        owner, flat = self.proposed([b"" if len(w) > LONG else w for w in words] if long else words)
        if long:
            lists = [self.longest(words[i]) for i in long]
            owner, flat = by_owner([owner, *(np.full(len(x), i) for i, x in zip(long, lists))], [flat, *lists])
        at = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[at].astype(np.int64) * self.size + flat[at + 1], return_inverse=True)
        bad = ~self.fit(pairs // self.size, pairs % self.size)[back]
        failing = np.unique(owner[at[bad]])
        if len(failing):
            lists = self.merged([words[i] for i in failing.tolist()])
            good = ~np.isin(owner, failing)
            sizes = [len(x) for x in lists]
            owner, flat = by_owner([owner[good], np.repeat(failing, sizes)], [flat[good], np.fromiter((t for x in lists for t in x), np.int64, sum(sizes))])
        return flat.astype(np.int32), np.bincount(owner, minlength=len(words))


def by_owner(owners: list, values: list) -> tuple[np.ndarray, np.ndarray]:
    """Owners in ascending order and their values, those of one owner in the order in which they came."""
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner, value = np.concatenate(owners), np.concatenate(values)
    order = np.argsort(owner, kind="stable")
    return owner[order], value[order]


def _classes() -> np.ndarray:
    """What each of the first 256 code points is to the word pattern: 0 white space, 1 a letter, 2 a number, 3 any other."""
    kinds = (str.isspace, str.isalpha, str.isnumeric)
    return np.array([next((k for k, is_one in enumerate(kinds) if is_one(chr(i))), 3) for i in range(256)], np.uint8)


_CLASS, _LOWER = _classes(), bytes(ord(chr(i).lower()) for i in range(256))
_ONE, _TWO = np.frombuffer(b"stmd", np.uint8), [tuple(w) for w in (b"re", b"ve", b"ll")]
#: What the word pattern of the file and Python take for white space differently.
_DOUBTFUL = re.compile("[\x1c-\x1f]")


def cut_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of Latin-1 text in lower case: their places, their bytes in a row, and where each begins there (and the end).

    Words are maximal runs of letters or of other symbols, and single numbers. An apostrophe that begins
    a run of symbols and stands before the letters of a fixed ending takes them with it.
    """
    x = np.frombuffer(data + b"\n\n", np.uint8)
    kind = _CLASS[x]
    begins = np.empty(len(x), bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= kind == 2
    full = kind != 0
    begins &= full
    mark = np.flatnonzero((x == 39) & begins)
    if len(mark):
        a, b = x[mark + 1], x[mark + 2]
        n = np.isin(a, _ONE).astype(np.int64)
        for c, d in _TWO:
            n[(a == c) & (b == d)] = 2
        mark, n = mark[n > 0], n[n > 0]
        begins[mark + 1] = False
        after = mark + 1 + n
        begins[after] |= kind[after] == 1
    at = np.flatnonzero(begins)
    place = np.cumsum(full, dtype=np.int32)
    return at, x[full], np.append(place[at] - 1, place[-1]).astype(np.int32)


class Encoder:
    """Whole texts to ids like the library's encode(add_special_tokens=False) without truncation or padding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        path = shipped(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = Merges(spec["model"])
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merges.names |= {i: t for t, i in self.special.items()}
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.plain = WORD_PATTERN in json.dumps(spec["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\")
        self._keep([], np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _keep(self, words: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Start with these words alone: their places by word, their ids in a row, how many each has, and the batches that had each."""
        self.words, self.ids, self.sizes = words, ids, sizes
        self.place = {w: i for i, w in enumerate(words)}
        self.batches = np.ones(len(words), np.int64)

    def _forget(self) -> None:
        """Beyond KEPT words or their usual number of ids, keep those that several batches had, or none if these are too many."""
        if len(self.words) <= KEPT and len(self.ids) <= KEPT * 8:
            return
        stays = (self.batches > 1) & np.array([isinstance(w, int) or len(w) <= LONG for w in self.words])
        stays &= stays.sum() <= KEPT // 2
        self._keep([w for w, s in zip(self.words, stays.tolist()) if s], self.ids[np.repeat(stays, self.sizes)], self.sizes[stays])

    def _latin(self, text: str) -> bytes | None:
        """The text in Latin-1 and lower case where cut_words does what the library does, else None."""
        if not self.plain or _DOUBTFUL.search(text) or (self.split and self.split.search(text)):
            return None
        try:
            return text.encode("latin-1").translate(_LOWER)
        except UnicodeEncodeError:
            return None

    def _pieces(self, text: str) -> list[str | int]:
        """The words of any text by the library's own normaliser and splitter; special tokens as their ids."""
        parts: list[str | int] = []
        at = 0
        for m in self.split.finditer(text) if self.split else ():
            parts += self._words(text[at : m.start()])
            parts.append(self.special[m[0]])
            at = m.end()
        return parts + self._words(text[at:])

    def _words(self, text: str) -> list[str]:
        norm = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        return [norm[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(norm)]

    def _places(self, words: list) -> np.ndarray:
        """Where distinct words are kept: Latin-1 bytes, strings, or ids of special tokens. New ones are encoded together."""
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        fresh = np.flatnonzero(at < 0)
        self.batches[at[at >= 0]] += 1
        if len(fresh):
            new = [words[i] for i in fresh.tolist()]
            spelled = [b"" if isinstance(w, int) else w.encode() if isinstance(w, str) else w if w.isascii() else w.decode("latin-1").encode() for w in new]
            ids, sizes = self.merges.encode_words(spelled)
            special = np.array([w if isinstance(w, int) else -1 for w in new])
            if (special >= 0).any():
                ids = np.insert(ids, np.cumsum(sizes)[special >= 0], special[special >= 0])
                sizes[special >= 0] = 1
            at[fresh] = len(self.words) + np.arange(len(new))
            self.place.update(zip(new, at[fresh].tolist()))
            self.words += new
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
            self.batches = np.concatenate([self.batches, np.ones(len(new), np.int64)])
        return at

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        self._forget()
        owners, words, latin, plain = [], [], [], []
        for i, text in enumerate(texts):
            if (data := self._latin(text)) is not None:
                plain.append(i)
                latin.append(data)
            elif parts := self._pieces(text):
                distinct = dict.fromkeys(parts)
                at = dict(zip(distinct, self._places(list(distinct)).tolist()))
                owners.append(np.full(len(parts), i))
                words.append(np.array([at[p] for p in parts]))
        if plain:
            at, letters, bounds = cut_words(b"\n".join(latin))
            found = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
            words.append(self._places(found.dictionary.to_pylist())[found.indices.to_numpy()])
            ends = np.searchsorted(at, np.cumsum([len(d) + 1 for d in latin]))
            owners.append(np.repeat(np.array(plain), np.diff(ends, prepend=0)))
        owner, word = by_owner(owners, words) if len(owners) > 1 else (owners[0], words[0]) if owners else by_owner([], [])
        starts = np.append(0, np.cumsum(self.sizes)) * 4
        packed = pa.Array.from_buffers(pa.large_binary(), len(self.sizes), [None, pa.py_buffer(starts), pa.py_buffer(self.ids)]).take(pa.array(word))
        ids = np.frombuffer(packed.buffers()[2], np.int32) if len(word) else np.zeros(0, np.int32)
        sizes = np.bincount(owner, self.sizes[word], len(texts)).astype(np.int64) if len(word) else np.zeros(len(texts), np.int64)
        return ids, sizes


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of a file in a worker, kept between its tasks."""
    return Encoder(path)


def spelled(ids: np.ndarray, table: pa.BinaryArray) -> tuple[memoryview, np.ndarray]:
    """Table's bytes of each id, in a row, and where each begins there (and the end)."""
    out = table.take(pa.array(ids))
    data = out.buffers()[2]
    return memoryview(data or b""), np.frombuffer(out.buffers()[1], np.int64, len(out) + 1) if len(out) else np.zeros(1, np.int64)


@lru_cache(maxsize=1)
def tables(path: str) -> tuple[pa.BinaryArray, pa.BinaryArray]:
    """Of each id its decimal number and its token, with what stands between them in a text before each."""
    names = encoder(path).merges.names
    last = max(names) + 1
    return tuple(pa.array([f.encode() for f in x], pa.large_binary()) for x in ([f" {i}" for i in range(last)], [GAP + names.get(i, "") for i in range(last)]))


def texts_of(ids: np.ndarray, ends: np.ndarray, table: pa.BinaryArray) -> list[bytes]:
    """What the ids of each text are in a table, without what stands before the first."""
    data, place = spelled(ids, table)
    stops = place[ends].tolist()
    return [bytes(data[a + 1 : b]) for a, b in zip([0, *stops], stops)]


def joined_by_space(path: str) -> None:
    """Refuse files that name a decoder: without one, decode() puts a space between tokens."""
    with open(shipped(path), encoding="utf-8") as f:
        if json.load(f).get("decoder") is not None:
            raise ValueError("only files without a decoder are decoded here")


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each whole text and what they decode to: (id, ids array<int>, decoded string).

    The ids are the library's; special tokens written in a text are those tokens, as there. The
    decoded text is the library's decode(ids, skip_special_tokens=False). A null or empty text gives
    no ids and an empty decoded text. One row for each row; a null id stays null; other columns are
    not read.
    """

    joined_by_space(path)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b, texts in (part for whole in batches for part in rounds(whole, most=TEXT)):
            ids, sizes = enc.batch(texts)
            ends = np.cumsum(sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids))
            decoded = [t.decode() for t in texts_of(ids, ends, tables(path)[1])]
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_decode with the ids and the decoded text as digests: (id, n_tokens, ids_sha256, decoded_sha256)."""

    joined_by_space(path)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b, texts in (part for whole in batches for part in rounds(whole, most=TEXT)):
            ids, sizes = enc.batch(texts)
            digests = [pa.array([hashlib.sha256(t).hexdigest() for t in texts_of(ids, np.cumsum(sizes), table)], pa.string()) for table in tables(path)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), *digests], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_digests(docs, path).withColumnRenamed("id", "doc_id")
