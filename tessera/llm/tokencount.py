"""Token counts without token ids.

A text's pieces never cross the start of a run of word marks (U+2581): no
vocabulary entry does.  So a count is a sum over pre-tokens, which are the
space-separated chunks of a text.

The pre-tokens are dealt to shares by their hash.  A block of documents gives
each share one packed row: its distinct pre-tokens there, each once, and how
often each document of the block has them.  A share's task sees all blocks: it
counts the pieces of a pre-token once, when it first comes, by merging and
without ids; joins the counts to the documents' frequencies; and sums them for
each document.  A document's sums over the shares meet by block.  So each
distinct pre-token of the whole table is counted once, one that every document
holds is one string a block, and what is shuffled is distinct pre-tokens of
blocks and small numbers, in less bytes than the texts have.

Null and empty texts hold no bytes and no tokens; texts and pre-tokens of any
length are counted whole; rows that repeat an id are rows like others, and so
are null ids; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessera.llm.merging import RowMerger
from tessera.llm.runtime import map_arrow

MARK = "▁"


class PieceCounter:
    """Counts of a SentencePiece BPE model with the identity normalizer."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep the text as it is are supported")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        pieces = [p.piece for p in model.pieces if p.type in (pb.ModelProto.SentencePiece.NORMAL, pb.ModelProto.SentencePiece.USER_DEFINED)]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of this model crosses a word mark")
        if any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in model.pieces):
            raise ValueError("user-defined pieces aren't supported")
        self._cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self._merger, self._symbol, self._weight = self._tables(model, pb)
        self._pairs = self._merger.pairs()

    @staticmethod
    def _tables(model, pb) -> tuple[RowMerger, dict[str, int], np.ndarray]:
        """Merging by score; the number of each character; how many pieces a symbol stands for (an unknown character: its bytes)."""
        kind = pb.ModelProto.SentencePiece
        score = {p.piece: p.score for p in model.pieces if p.type == kind.NORMAL}
        number = {p: i for i, p in enumerate(score)}
        order = {p: r for r, p in enumerate(sorted(score, key=lambda p: -score[p]))}
        splits = [(number[p[:i]], number[p[i:]], order[p], number[p]) for p in score for i in range(1, len(p)) if p[:i] in number and p[i:] in number]
        a, b, rank, made = np.array(splits, np.int64).T
        # characters that are no piece: one symbol for each number of bytes, and merges with none
        weight = np.ones(len(number) + 4, np.int64)
        weight[-4:] = [1, 2, 3, 4] if model.trainer_spec.byte_fallback else 1
        return RowMerger(a << 32 | b, rank, made), {p: i for p, i in number.items() if len(p) == 1}, weight

    #: Characters of a pre-token up to which it is merged together with others.
    SHORT = 64

    def _count_short(self, pretokens: list[str]) -> list[int]:
        """Pieces of each pre-token, without its ids."""
        text = "".join(pretokens)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        distinct, which = np.unique(codes, return_inverse=True)
        unknown = len(self._weight) - 5
        symbol = np.array([self._symbol.get(c, unknown + len(c.encode())) for c in map(chr, distinct.tolist())], np.int32)
        lengths = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        symbols, counts = self._merger.merge(symbol[which], lengths)
        total = np.concatenate([[0], np.cumsum(self._weight[symbols])])
        ends = np.cumsum(counts)
        return (total[ends] - total[ends - counts]).tolist()

    def _count_long(self, pretoken: str) -> int:
        """Pieces of one long pre-token, by a heap of its pairs: the best score first, then the leftmost."""
        unknown = len(self._weight) - 5
        symbols = [self._symbol.get(c, unknown + len(c.encode())) for c in pretoken]
        n, pairs = len(symbols), self._pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1], symbols[i], symbols[i + 1]) for i in range(n - 1) if (m := pairs.get(symbols[i] << 32 | symbols[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, made, x, y = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != x or j >= n or symbols[j] != y:
                continue
            symbols[i], symbols[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := pairs.get(made << 32 | symbols[k]):
                    heapq.heappush(heap, (m[0], i, m[1], made, symbols[k]))
            if (p := before[i]) >= 0 and (m := pairs.get(symbols[p] << 32 | made)):
                heapq.heappush(heap, (m[0], p, m[1], symbols[p], made))
        return int(sum(self._weight[s] for s in symbols if s >= 0))

    def frequencies(self, text: str) -> Counter:
        """How often each pre-token stands in the text.

        A chunk stands for itself behind one mark; every other pre-token is
        written behind an extra mark (no chunk holds one).
        """
        if not text:
            return Counter()
        if self.prefix and MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return Counter(text.split(" "))
        found = self._cut.findall(self.prefix + text.replace(" ", MARK))
        return Counter(p[1:] if p[0] == MARK and len(p) > 1 and p[1] != MARK else MARK + p for p in found)

    def pieces(self, pretokens: list[str]) -> list[int]:
        """How many pieces each pre-token, as ``frequencies`` writes it, is cut into."""
        spelled = [p[1:] if p[0] == MARK else MARK + p for p in pretokens]
        short = [i for i, p in enumerate(spelled) if len(p) <= self.SHORT]
        out = [0] * len(spelled)
        for i, n in zip(short, self._count_short([spelled[i] for i in short]) if short else [], strict=True):
            out[i] = n
        for i, p in enumerate(spelled):
            if len(p) > self.SHORT:
                out[i] = self._count_long(p)
        return out

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each of a few texts."""
        block = [self.frequencies(t) for t in texts]
        distinct = list(set().union(*block))
        known = dict(zip(distinct, self.pieces(distinct), strict=True))
        return [sum(known[p] * n for p, n in freq.items()) for freq in block]


_loaded: dict[str, PieceCounter] = {}


def load(path: str) -> PieceCounter:
    if path not in _loaded:
        _loaded[path] = PieceCounter(path)
    return _loaded[path]


#: Characters of the texts that make up a block.
BLOCK = 4 << 20
#: Bytes of input for each share of the pre-tokens, and shares at most.
SHARE_BYTES, MOST_SHARES = 32 << 20, 20_000

_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _packed(*columns: np.ndarray) -> bytes:
    """Aligned columns of small numbers, in four bytes each before compression."""
    return _PACK.compress(np.concatenate([c.astype("<u4") for c in columns]).tobytes())


def _unpacked(packed: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(_UNPACK.decompress(packed), "<u4").reshape(columns, -1)


def shares(docs: DataFrame, text_col: str = "text") -> int:
    """How many shares the pre-tokens are dealt to, by the size that the plan's statistics give for the input, or else by its texts' bytes."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # not known
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(2 * docs.sparkSession.sparkContext.defaultParallelism, min(MOST_SHARES, -(-size // SHARE_BYTES)))


def deal(docs: DataFrame, path: str, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(share, block, ids, sizes, tokens, entries): each block's distinct pre-tokens of each share with their frequencies in its documents.

    entries: documents (numbers in the block), pre-tokens (numbers in tokens)
    and times.  A row without tokens lists the block's ids and text sizes.
    """

    def pack(block: int, ids: pa.Array, texts: list[str], counter: PieceCounter):
        freq = [counter.frequencies(t) for t in texts]
        distinct = list(set().union(*freq))
        share = np.array([zlib.crc32(p.encode()) % n for p in distinct], np.int64)
        order = np.argsort(share, kind="stable")
        names, share = [distinct[i] for i in order.tolist()], share[order]
        number = dict(zip(names, range(len(names))))
        count = np.fromiter(map(len, freq), np.int64, len(freq))
        total = int(count.sum())
        token = np.fromiter((number[p] for f in freq for p in f), np.int64, total)
        times = np.fromiter((k for f in freq for k in f.values()), np.int64, total)
        doc = np.repeat(np.arange(len(freq)), count)
        at = np.argsort(share[token], kind="stable")
        token, times, doc = token[at], times[at], doc[at]
        heads = np.searchsorted(share, np.arange(n + 1))
        cuts = np.searchsorted(share[token], np.arange(n + 1))
        held = [k for k in range(n) if heads[k + 1] > heads[k]]
        tokens = [" ".join(names[heads[k] : heads[k + 1]]) for k in held]
        entries = [_packed(doc[cuts[k] : cuts[k + 1]], token[cuts[k] : cuts[k + 1]] - heads[k], times[cuts[k] : cuts[k + 1]]) for k in held]
        rows = len(held) + 1
        ends = pa.array([0, *[0] * len(held), len(texts)], pa.int32())
        sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
        columns = [
            pa.array([*held, block % n], pa.int32()),
            pa.array([block] * rows, pa.int64()),
            pa.ListArray.from_arrays(ends, ids),
            pa.ListArray.from_arrays(ends, sizes),
            pa.array([*tokens, None], pa.string()),
            pa.array([*entries, None], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["share", "block", "ids", "sizes", "tokens", "entries"])

    def run(batches):
        counter = load(path)
        # a task that is run again cuts the same blocks
        block = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            own = [t or "" for t in batch.column(1).to_pylist()]
            first = 0
            for i, t in enumerate(own):
                size += len(t)
                texts.append(t)
                if size >= BLOCK:
                    ids.append(batch.column(0).slice(first, i + 1 - first))
                    yield pack(block, pa.concat_arrays(ids), texts, counter)
                    ids, texts, size, first, block = [], [], 0, i + 1, block + 1
            if first < len(own):
                ids.append(batch.column(0).slice(first))
        if texts:
            yield pack(block, pa.concat_arrays(ids), texts, counter)

    kept = docs.select(id_col, text_col)
    return map_arrow(kept, run, f"share int, block long, ids array<{kept.schema[0].dataType.simpleString()}>, sizes array<long>, tokens string, entries binary")


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text; over_limit: more than ``limit`` tokens."""
    n = shares(docs, text_col)
    kind = docs.schema[id_col].dataType
    dealt = deal(docs, path, n, id_col, text_col).repartitionById(n, "share")

    def count(batches):
        """Counts each pre-token of a share when it first comes, and sums the pieces of each document's."""
        counter, known = load(path), {}
        for batch in batches:
            names = [t.split(" ") if t is not None else [] for t in batch.column(4).to_pylist()]
            new = list({p for own in names for p in own if p not in known})
            known.update(zip(new, counter.pieces(new), strict=True))
            sums = []
            for own, packed in zip(names, batch.column(5).to_pylist(), strict=True):
                if packed is None:
                    sums.append(None)
                    continue
                doc, token, times = _unpacked(packed, 3)
                pieces = np.fromiter(map(known.__getitem__, own), np.int64, len(own))
                at = np.flatnonzero(np.diff(doc, prepend=-1))
                sums.append(_packed(doc[at], np.add.reduceat(pieces[token] * times, at)))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), pa.array(sums, pa.binary())], ["block", "ids", "sizes", "sums"])

    counted = map_arrow(dealt, count, f"block long, ids array<{kind.simpleString()}>, sizes array<long>, sums binary")

    def whole(table: pa.Table) -> pa.Table:
        rows = table.column("sums").to_pylist()
        head = table.slice(rows.index(None), 1)
        ids, sizes = (pc.list_flatten(head.column(c)).combine_chunks() for c in ("ids", "sizes"))
        tokens = np.zeros(len(sizes), np.int64)
        for packed in rows:
            if packed is not None:
                doc, pieces = _unpacked(packed, 2)
                tokens[doc] += pieces
        return pa.table({id_col: ids, "n_bytes": sizes, "n_tokens": pa.array(tokens), "over_limit": pa.array(tokens > limit)})

    return counted.groupBy("block").applyInArrow(whole, StructType([StructField(id_col, kind), *StructType.fromDDL("n_bytes long, n_tokens long, over_limit boolean").fields]))
