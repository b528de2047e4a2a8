"""BPE encoding and decoding: speculate and verify.

A word's encoding is proposed by greedy longest match over a trie of the
vocabulary.  A token sequence is the BPE encoding of its bytes exactly when
every adjacent pair of tokens is: so the proposals of all new words of a batch
are verified together, one vectorised check over their adjacent token pairs.
Only words with a failing pair go through exact merging.

Null and empty texts encode to no ids and decode to the empty string; a word
of any length is proposed and verified like any other, and if it fails merged
in O(n log n) steps; repeated rows and null ids give their results row by row;
an empty table gives no rows.  Extra columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.merging import NEVER, IntMap, RowMerger
from tessera.llm.runtime import map_arrow

#: Fixed values of the byte-level tokenizer format: the pattern that cuts a text into words.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files, by character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class SpeculativeBPE:
    """A byte-level BPE vocabulary that encodes words in batches."""

    #: Words whose encoding a worker remembers before it starts over.
    REMEMBERED = 150_000
    #: Bytes of a word up to which it walks the trie, and is merged, side by side with others.
    SHORT = 48

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        unprintable = byte_alphabet()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*model["vocab"].values(), *added.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        ids: dict[bytes, int] = {}
        for token, i in model["vocab"].items():
            if token not in added:
                raw = bytes(unprintable[c] for c in token)
                self.token_bytes[i] = raw
                ids[raw] = i
        for token, i in added.items():
            self.token_bytes[i] = token.encode()
        self.added = {t: struct.pack("<I", i) for t, i in added.items()}
        #: Those that hold a space, which no chunk shows.
        self.spaced = [t for t in added if " " in t]
        self._added_cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.byte_id = [ids[bytes([b])] for b in range(256)]
        #: (left, right) -> (rank, merged)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for r, merge in enumerate(model["merges"]):
            a, b = (unprintable_bytes(t, unprintable) for t in (merge if isinstance(merge, list) else merge.split(" ")))
            pair, made = (ids[a], ids[b]), ids[a + b]
            self.merges[pair] = (r, made)
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = r, *pair
        pairs = np.array([a << 32 | b for a, b in self.merges], dtype=np.int64)
        ranks = np.array([r for r, _ in self.merges.values()])
        self._pairs = IntMap(pairs, ranks)
        self._merger = RowMerger(pairs, ranks, np.array([m for _, m in self.merges.values()]))
        self._byte_ids = np.array(self.byte_id, np.int32)
        # a token that its own bytes don't merge to is never part of an encoding
        tokens = list(ids)
        merged, counts = self._merge_short(tokens)
        proposed = [t for t, n in zip(tokens, counts.tolist(), strict=True) if n == 1]
        trie: dict[int, int] = {}
        accept: list[int] = [-1]
        for t in proposed:
            node = 0
            for b in t:
                key = node << 8 | b
                node = trie.get(key, 0)
                if not node:
                    node = trie[key] = len(accept)
                    accept.append(-1)
            accept[node] = ids[t]
        self._trie = IntMap(np.fromiter(trie, np.int64, len(trie)), np.fromiter(trie.values(), np.int64, len(trie)))
        self._accept = np.array(accept, np.int32)
        self._words = regex.compile(BYTE_LEVEL_PATTERN)
        self._known: dict[str, bytes] = {}
        self._chunks: dict[str, bytes] = {}
        self.stats = {"words": 0, "merged": 0}

    def _merge_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        symbols = self._byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        return self._merger.merge(symbols, np.fromiter(map(len, words), np.int64, len(words)))

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match: (tokens, owner), the tokens of all words in order and each one's word.

        All words walk the trie side by side, a byte a step; a word that can't
        go on emits the longest token passed and starts again behind it.
        """
        data = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        at = np.arange(len(words))
        cursor = stop - np.fromiter(map(len, words), np.int64, len(words))
        at, cursor = at[cursor < stop], cursor[cursor < stop]
        node, best, end = np.zeros(len(at), np.int64), np.zeros(len(at), np.int32), cursor.copy()
        stop = stop[at]
        tokens, owners = [], []
        while len(at):
            step = self._trie.get(node << 8 | data[cursor])
            step[cursor >= stop] = -1
            on = step >= 0
            node = np.where(on, step, 0)
            cursor = np.where(on, cursor + 1, end)
            token = self._accept[node]
            passed = on & (token >= 0)
            emit = ~on
            tokens.append(best[emit])
            owners.append(at[emit])
            best = np.where(passed, token, best)
            end = np.where(passed, cursor, end)
            if emit.any():
                left = ~(emit & (end >= stop))
                at, cursor, node, best, end, stop = at[left], cursor[left], node[left], best[left], end[left], stop[left]
        if not tokens:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(tokens)[order], owner[order]

    def propose_long(self, word: bytes) -> np.ndarray:
        """Greedy longest match of one long word: the longest token at all its bytes, side by side, then the chain of those that follow one another."""
        data = np.frombuffer(word, np.uint8)
        best, size = np.zeros(len(data), np.int32), np.zeros(len(data), np.int64)
        at, node, depth = np.arange(len(data)), np.zeros(len(data), np.int64), 0
        while len(at):
            node = self._trie.get(node << 8 | data[at + depth]).astype(np.int64)
            at, node = at[node >= 0], node[node >= 0]
            depth += 1
            token = self._accept[node]
            passed = token >= 0
            best[at[passed]], size[at[passed]] = token[passed], depth
            inside = at + depth < len(data)
            at, node = at[inside], node[inside]
        step, cursor, chain = size.tolist(), 0, []
        while cursor < len(word):
            chain.append(cursor)
            cursor += step[cursor]
        return best[chain]

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        rank = self._pairs.get(a << 32 | b)
        return np.where(rank >= 0, rank, NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For aligned token arrays: is [a, b] the encoding of its bytes?

        The merges that made the two tokens are undone from the latest
        backwards.  The pair fails if, at some point, the two pieces that meet
        at the boundary would have merged before the piece that was undone.
        """
        good = np.ones(len(a), dtype=bool)
        at, a, b = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), np.int64(NEVER))
        while len(at):
            bad = self._pair_rank(a, b) < limit
            good[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            undo_a = ra > rb
            # a merge at the boundary of the same rank as b's own came first, being further left
            limit = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return good

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, lowest rank first and then leftmost."""
        n = len(word)
        ids = [self.byte_id[b] for b in word]
        merges = self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, made, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((made, ids[k])):
                    heapq.heappush(heap, (m[0], i, m[1], made, ids[k]))
            if (p := before[i]) >= 0 and (m := merges.get((ids[p], made))):
                heapq.heappush(heap, (m[0], p, m[1], ids[p], made))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The encodings of words that are cut already, packed as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= self.SHORT]
        tokens, owner = self.propose([words[i] for i in short])
        owner = np.array(short, np.int64)[owner]
        long = [i for i, w in enumerate(words) if len(w) > self.SHORT]
        proposed = [self.propose_long(words[i]) for i in long]
        # the proposals of short words, in order, then those of long ones
        order = np.array(short + long, np.int64)
        tokens = np.concatenate([tokens, *proposed])
        owner = np.concatenate([owner, np.repeat(np.array(long, np.int64), [len(p) for p in proposed])])
        inner = owner[1:] == owner[:-1]
        wide = tokens.astype(np.int64)
        pairs, which = np.unique(wide[:-1][inner] << 32 | wide[1:][inner], return_inverse=True)
        bad = ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[which]
        failing = np.zeros(len(words), bool)
        failing[owner[1:][inner][bad]] = True
        good = ~failing[owner]
        counts = np.bincount(owner[good], minlength=len(words))
        self._pack(tokens[good], counts[order], order.tolist(), out)
        again = np.flatnonzero(failing).tolist()
        few = [i for i in again if len(words[i]) <= self.SHORT]
        self._pack(*self._merge_short([words[i] for i in few]), few, out)
        for i in again:
            if len(words[i]) > self.SHORT:
                ids = self.merge(words[i])
                out[i] = struct.pack(f"<{len(ids)}I", *ids)
        self.stats["words"] += len(words)
        self.stats["merged"] += len(again)
        return out

    @staticmethod
    def _pack(tokens: np.ndarray, counts: np.ndarray, to: list[int], out: list[bytes]) -> None:
        packed = tokens.astype("<u4").tobytes()
        ends = np.cumsum(counts) * 4
        a = 0
        for i, b in zip(to, ends.tolist(), strict=True):
            if b > a:
                out[i] = packed[a:b]
            a = b

    def _cut(self, text: str) -> list[list[str]]:
        """Words between added tokens, and each added token as a list of its own."""
        if self._added_cut is None or not any(t in text for t in self.added):
            return [self._words.findall(text)]
        return [[part] if i % 2 else self._words.findall(part) for i, part in enumerate(self._added_cut.split(text))]

    def _learn(self, words: set[str]) -> None:
        """Make all these words known."""
        known = self._known
        new = list(words.difference(known))
        if len(known) + len(new) > self.REMEMBERED:
            known.clear()
            new = list(words)
        known.update(zip(new, self.encode_words([w.encode() for w in new]), strict=True))

    def _encode_cut(self, texts: list[str]) -> list[bytes]:
        cut = [self._cut(t) for t in texts]
        self._learn({w for parts in cut for i, p in enumerate(parts) if i % 2 == 0 for w in p})
        look = self._known.__getitem__
        return [b"".join(b"".join(map(look, p)) if i % 2 == 0 else self.added[p[0]] for i, p in enumerate(parts)) for parts in cut]

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Encodings of chunks without white space at their ends, each with a space in front."""
        if not chunks:
            return []
        words = self._words.findall(" " + " ".join(chunks))
        self._learn(set(words))
        packed = list(map(self._known.__getitem__, words))
        ends = np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)))
        opens = np.flatnonzero(np.fromiter((w[0] == " " for w in words), bool, len(words)))
        starts = np.append(0, ends)[opens].tolist()
        joined = b"".join(packed)
        return [joined[a:b] for a, b in zip(starts, [*starts[1:], len(joined)], strict=True)]

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers.

        A space in front of anything but white space starts a new word.  So
        the chunks between single spaces are encoded once each, with the space
        in front; a text with other white space around a space, or with an
        added token, is cut as a whole.
        """
        chunks, added = self._chunks, list(self.added)
        split = [t.split(" ") for t in texts]
        new = set().union(*(c[1:] for c in split)).difference(chunks)
        if len(chunks) + len(new) > self.REMEMBERED:
            chunks.clear()
            new = set().union(*(c[1:] for c in split))
        odd = {c for c in new if not c or c[0].isspace() or c[-1].isspace() or any(map(c.__contains__, added))}
        plain = list(new - odd)
        chunks.update(zip(plain, self._encode_chunks(plain), strict=True))
        whole = [i for i, (t, c) in enumerate(zip(texts, split, strict=True)) if odd and not odd.isdisjoint(c) or c[0][-1:].isspace() or any(a in t for a in self.spaced)]
        whole_set = set(whole)
        heads = self._encode_cut([c[0] for c in split])
        look = chunks.__getitem__
        out = [b"" if i in whole_set else head + b"".join(map(look, c[1:])) for i, (head, c) in enumerate(zip(heads, split, strict=True))]
        for i, packed in zip(whole, self._encode_cut([texts[i] for i in whole]), strict=True):
            out[i] = packed
        return out

    def forget(self) -> None:
        """Drop what is remembered: an idle worker shouldn't hold it."""
        self._known.clear()
        self._chunks.clear()

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed([text])[0], "<u4").tolist()

    def decode_bytes(self, packed: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def unprintable_bytes(token: str, alphabet: dict[str, int]) -> bytes:
    return bytes(alphabet[c] for c in token)


_loaded: dict[str, SpeculativeBPE] = {}


def load(path: str) -> SpeculativeBPE:
    """The vocabulary at ``path``, kept for the life of this worker."""
    if path not in _loaded:
        _loaded[path] = SpeculativeBPE(path)
    return _loaded[path]


def _text_groups(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): every whole text encoded."""

    def run(batches):
        codec = load(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in _text_groups(texts):
                packed = codec.encode_packed(texts[i:j])
                sizes = np.cumsum([0, *(len(p) // 4 for p in packed)])
                ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), ids], [id_col, "ids"])
        codec.forget()

    kept = docs.select(id_col, text_col)
    return map_arrow(kept, run, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): every id list decoded, special tokens included; a null list gives the empty text."""

    def run(batches):
        codec = load(path)
        for batch in batches:
            texts = [codec.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kept = encoded.select(id_col, ids_col)
    return map_arrow(kept, run, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode, decode, and digests of both; with_ids: the ids too."""

    def run(batches):
        codec = load(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in _text_groups(texts):
                every = codec.encode_packed(texts[i:j])
                counts, ids_sha, text_sha = [], [], []
                for packed in every:
                    raw = codec.decode_bytes(packed)
                    try:
                        raw.decode()
                    except UnicodeDecodeError:
                        raw = raw.decode("utf-8", "replace").encode()
                    counts.append(len(packed) // 4)
                    ids_sha.append(hashlib.sha256(packed).hexdigest())
                    text_sha.append(hashlib.sha256(raw).hexdigest())
                columns = [batch.column(0).slice(i, j - i), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(counts)])
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(every), "<u4").astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)
        codec.forget()

    kept = docs.select(id_col, text_col)
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 5 if with_ids else 4]
    return map_arrow(kept, run, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
