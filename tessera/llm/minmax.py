"""MinHash near-duplicates by min-max hashing.

Each of ``Params.permutations`` permutations of the shingle hashes is applied
once, and both its minimum and its maximum are kept: two signature values for
one evaluation.  Bands of these values are the keys of candidate buckets.

Documents with equal shingle sets are one node, so copies never pair up with
each other.  In a bucket every node is compared with the bucket's first node,
on the full sets: links in proportion to the nodes, whatever the bucket's
size.  A node meets one first node to begin with, and the others only where
the confirmed links left them in different components.  A first node's set is
sent once for some hundreds of its members, which are dealt over tasks.

Where a bucket still holds several components, the nodes outside the heaviest
component of such buckets are compared with all other components too, so that
no link that bands propose is lost.  That is done block against block, through
an index of the blocks' shingles, and gives one link at most for a node and a
component: no pairs are written, and the work follows the nodes outside times
all nodes, not the square of the group.

Null and empty texts and texts without words have an empty set and are linked
with nothing.  A text of fewer words than a shingle is one shingle.  Rows that
repeat an id and a text are one node; a null id is never a component's
smallest unless all ids of the component are null.  Extra columns are not
read.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import text as tx
from tessera.llm.runtime import discard, drop_rows, keep_ids, map_arrow, materialize, version
from tessera.plans.components import connected_components
from tessera.plans.skew import HOT_KEYS, LEAST_ROWS, join_unique


@dataclass(frozen=True)
class Params:
    """At similarity 0.85 a pair misses all bands once in four million, at 0.8 once in 30 thousand (each document meets many others in a group)."""

    shingle: int = 5
    percent: int = 80  #: least similarity of a link, in per cent
    permutations: int = 65
    rows: int = 5  #: signature values in a band

    @property
    def bands(self) -> int:
        return 2 * self.permutations // self.rows


#: The contract's own: 3-word shingles, 85 per cent.
CONTRACT = Params(shingle=3, percent=85)


def _multipliers(n: int) -> np.ndarray:
    return tx.mix64(np.arange(1, n + 1, dtype=tx.U64) * tx.U64(0xC2B2AE3D27D4EB4F)) | tx.U64(1)


def signature(grams: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The minima, then the maxima, of the permuted hashes."""
    low = np.full(len(multipliers), np.iinfo(np.uint64).max, tx.U64)
    high = np.zeros(len(multipliers), tx.U64)
    for at in range(0, len(grams), 2048):
        permuted = multipliers[:, None] * grams[None, at : at + 2048]
        low, high = np.minimum(low, permuted.min(1)), np.maximum(high, permuted.max(1))
    return np.concatenate([low, high])


def band_keys(signatures: np.ndarray, params: Params) -> np.ndarray:
    """(documents, bands): a band takes every bands-th value, so that a permutation's minimum and maximum are in different ones."""
    used = params.bands * params.rows
    values = signatures[:, :used].reshape(len(signatures), params.rows, params.bands)
    keys = np.arange(params.bands, dtype=tx.U64)[None] * tx.U64(0x9E3779B97F4A7C15)
    for r in range(params.rows):
        keys = tx.mix64(keys ^ values[:, r])
    return keys


def node_of(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else b""


def _document_shingles(column: pa.Array, k: int):
    """The shingle sets of a column's texts, piece by piece."""
    data, off = tx.flat(column)
    for i, j in tx.pieces(off):
        raw, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        starts, ends, first = tx.word_spans(raw, o)
        yield i, j, tx.shingles(tx.RangeHash(raw, fold=True)(starts, ends), first, k)


def signatures(docs: DataFrame, params: Params, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, version, n_shingles, digest, bands): digest is the set's, null for an empty one; version is the text's hash."""
    multipliers = _multipliers(params.permutations)

    def run(batches):
        for batch in batches:
            for i, j, sets in _document_shingles(batch.column(1), params.shingle):
                sizes = [len(s) for s in sets]
                filled = [n for n, s in enumerate(sets) if len(s)]
                sigs = np.array([signature(sets[n], multipliers) for n in filled], tx.U64).reshape(len(filled), 2 * params.permutations)
                counts = np.zeros(len(sets) + 1, np.int32)
                counts[1:][filled] = params.bands
                keys = pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(band_keys(sigs, params).reshape(-1).view(np.int64)))
                digests = pa.array([node_of(s) or None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(sizes, pa.int64()), digests, keys], ["id", "version", "n_shingles", "digest", "bands"])

    kept = docs.select(F.col(id_col).alias("id"), text_col, version(text_col).alias("version"))
    return map_arrow(kept, run, f"id {kept.schema[0].dataType.simpleString()}, version long, n_shingles long, digest binary, bands array<long>")


def node_sets(wanted: DataFrame, docs: DataFrame, params: Params, id_col: str, text_col: str) -> DataFrame:
    """(node, grams) of the wanted (node, digest, id of a document that has it), from the documents' texts."""
    # a null id finds its text through the null-safe comparison below
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    few = keep_ids(texts.filter("id is not null"), wanted.select("id").filter("id is not null").distinct(), "id").unionByName(texts.filter("id is null"))
    held = few.join(wanted.select("node", "digest", F.col("id").alias("want")), F.expr("id <=> want")).select("node", "digest", "text")
    k = params.shingle

    def sets(batches):
        """Drops the texts of a repeated id that make another node."""
        for batch in batches:
            for i, j, found in _document_shingles(batch.column(2), k):
                own = batch.column(1).slice(i, j - i).to_pylist()
                right = [n for n, s in enumerate(found) if node_of(s) == own[n]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i + n for n in right], pa.int64())), pa.array([found[n].tobytes() for n in right], pa.binary())], ["node", "grams"])

    # rows that repeat an id and a text give their node more than once
    return map_arrow(held, sets, "node long, grams binary")


#: Members that meet one copy of their first node's set.
MEMBERS = 256


def near(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Are two sorted sets similar enough?"""
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    small, large = (p, q) if len(p) <= len(q) else (q, p)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(p) + len(q) - common)


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, params: Params, id_col: str, text_col: str) -> DataFrame:
    """Those of the written (a, b) node pairs whose full sets are similar enough; nodes: (node, digest, id).

    Members b are dealt by their first node a, at most about ``MEMBERS`` to
    a copy of a's set, which comes before them.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts"))
    dealt = join_unique(pairs, salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    wanted = lambda end: nodes.join(pairs.select(F.col(end).alias("node")).distinct(), "node")
    members = dealt.join(node_sets(wanted("b"), docs, params, id_col, text_col).withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "grams")
    leads = node_sets(wanted("a"), docs, params, id_col, text_col).withColumnRenamed("node", "a").join(salts, "a")
    leads = leads.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "grams")
    # nulls first: a first node's set stands before its members
    rows = leads.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "b")
    percent = params.percent

    def compare(batches):
        lead = None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            at = []
            for i, g in enumerate(batch.column(3)):
                own = np.frombuffer(g.as_buffer(), tx.U64)
                if b[i] is None:
                    lead = own.copy()
                elif near(lead, own, percent):
                    at.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in at], pa.int64()), pa.array([b[i] for i in at], pa.int64())], ["a", "b"])

    return map_arrow(rows, compare, "a long, b long").distinct()


#: Shingles of one block, about: two blocks meet in a task.
BLOCK = 2_000_000


def cross_links(own: list[np.ndarray], component: np.ndarray, others: list[np.ndarray], other_component: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (own, other) between sets of different components, one for each own set and other component."""
    size = np.array([len(s) for s in others])
    owner = np.repeat(np.arange(len(others)), size)
    grams = np.concatenate(others)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    links = []
    for x, mine in enumerate(own):
        low, high = np.searchsorted(grams, mine, "left"), np.searchsorted(grams, mine, "right")
        n = high - low
        met, common = np.unique(owner[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)], return_counts=True)
        met = met[(100 * common >= percent * (len(mine) + size[met] - common)) & (component[x] != other_component[met])]
        links += [(x, int(met[i])) for i in np.unique(other_component[met], return_index=True)[1]]
    return links


def links_across(members: DataFrame, nodes: DataFrame, docs: DataFrame, params: Params, id_col: str, text_col: str) -> DataFrame:
    """(a, b): links between nodes of different components that share a band, and no fewer than connect these components.

    members: (band, node, n, component) of the bands that hold several
    components.  Nodes that bands join form a group.  A pair of different
    components has an end outside the group's heaviest one: these ends are
    dealt into blocks, all of the group's nodes are too, and each block of
    ends meets each block of nodes in one task with their sets.
    """
    leads = members.groupBy("band").agg(F.min("node").alias("a"))
    groups = connected_components(join_unique(members, leads, "band").select("a", F.col("node").alias("b")).distinct())
    own = materialize(members.select("node", "n", "component").distinct().join(groups.withColumnRenamed("component", "group"), "node"), "minmax-grouped")
    parts = own.groupBy("group", "component").agg(F.sum("n").alias("n"))
    parts = parts.groupBy("group").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("component", "n").alias("heaviest"))
    parts = parts.select("group", "heaviest", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("rows"), F.ceil(F.col("all") / BLOCK).cast("int").alias("columns"))
    placed = join_unique(own, parts, "group").filter("rows > 0")
    block = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outside = placed.filter("component <> heaviest").select("group", block(1, "rows").alias("i"), every("columns").alias("j"), "node", "component", F.lit(True).alias("outside"))
    inside = placed.select("group", every("rows").alias("i"), block(2, "columns").alias("j"), "node", "component", F.lit(False).alias("outside"))
    sets = node_sets(nodes.join(own.select("node"), "node"), docs, params, id_col, text_col).dropDuplicates(["node"])
    rows = outside.unionByName(inside).join(sets, "node")
    percent = params.percent

    def meet(table: pa.Table) -> pa.Table:
        flag = table.column("outside").to_numpy()
        node, component = table.column("node").to_numpy(), table.column("component").to_numpy()
        grams = table.column("grams").combine_chunks()
        held = [[np.frombuffer(grams[int(i)].as_buffer(), tx.U64) for i in np.flatnonzero(f)] for f in (flag, ~flag)]
        found = cross_links(held[0], component[flag], held[1], component[~flag], percent) if all(held) else []
        return pa.table({"a": pa.array([node[flag][x] for x, _ in found], pa.int64()), "b": pa.array([node[~flag][y] for _, y in found], pa.int64())})

    return rows.groupBy("group", "i", "j").applyInArrow(meet, "a long, b long")


def labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of all nodes under the written links."""
    labels = connected_components(links).withColumnRenamed("component", "found")
    return nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("found", "node").alias("component"))


def grouped(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, version, n_shingles, component, component_id) of every row; component, a number of its own, is null for an empty set."""
    signed = materialize(signatures(docs, params, id_col, text_col), "minmax-signatures")
    nodes = signed.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("id"), F.max("n_shingles").cast("int").alias("n"), F.first("bands").alias("bands"))
    # the numbers are fixed by being written
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "minmax-nodes")
    in_bands = nodes.select("node", "n", F.explode("bands").alias("band"))
    # the bands that several nodes share; the first node of each is compared with the others
    shared = in_bands.groupBy("band").agg(F.min("node").alias("lead"), F.min_by("n", "node").alias("lead_n"), F.count("*").alias("members")).filter("members > 1")
    shared = materialize(shared, "minmax-bands")
    bound = max(LEAST_ROWS, (shared.agg(F.sum("members")).first()[0] or 0) // HOT_KEYS)
    hot = [r["band"] for r in shared.filter(F.col("members") > bound).select("band").collect()]
    members = materialize(join_unique(in_bands, shared.drop("members"), "band", hot=hot), "minmax-buckets")
    near_size = f"100 * least(n, lead_n) >= {params.percent} * greatest(n, lead_n)"
    stars = materialize(members.filter("node <> lead").filter(near_size).select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "minmax-pairs")
    ids = nodes.select("node", "digest", "id")
    first = materialize(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "minmax-first-pairs")
    links = materialize(confirmed(first, ids, docs, params, id_col, text_col), "minmax-links")
    labels = materialize(labelled(nodes, links), "minmax-labels")

    # the other first nodes of those whose components differ still
    of = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    one_end = materialize(stars.join(of("b"), "b"), "minmax-ends")
    rest = materialize(join_unique(one_end, of("a"), "a").filter("of_a <> of_b").select("a", "b").join(first, ["a", "b"], "left_anti"), "minmax-more-pairs")
    if rest.limit(1).count():
        links = materialize(links.unionByName(confirmed(rest, ids, docs, params, id_col, text_col)), "minmax-all-links")
        labels = materialize(labelled(nodes, links), "minmax-all-labels")

    # the bands that hold several components
    placed = materialize(members.select("band", "node", "n").join(labels, "node"), "minmax-placed")
    mixed = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("band", F.lit(True).alias("mixed"))
    open_members = materialize(join_unique(placed, mixed, "band").drop("mixed"), "minmax-open")
    if open_members.limit(1).count():
        more = materialize(links_across(open_members, ids, docs, params, id_col, text_col), "minmax-links-across")
        if more.limit(1).count():
            labels = materialize(labelled(nodes, links.unionByName(more)), "minmax-last-labels")

    owned = materialize(nodes.select("node", "digest", "id").join(labels, "node"), "minmax-owned")
    least = owned.groupBy("component").agg(F.min("id").alias("component_id"))
    of_digest = materialize(join_unique(owned, least, "component").select("digest", "component", "component_id"), "minmax-result")
    out = join_unique(signed.select("id", "version", "n_shingles", "digest"), of_digest, "digest", "left")
    discard(nodes, shared, members, stars, first, one_end, rest, placed, open_members, owned)
    # an empty set stands alone
    return out.select("id", "version", "n_shingles", "component", F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: component_id is the smallest id reachable over links, kept is true where it is the row's own."""
    found = grouped(docs, params, id_col, text_col)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))


def one_of_each_group(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows (all columns) that remain when each group of near-duplicates keeps one.

    It is the row with the smallest id (a null id only if there is no other),
    then the smallest hash of its text, then of all its columns.  Rows without
    a word are in no group and stay.
    """
    found = materialize(grouped(docs, params, id_col, text_col).filter("component is not null").select("component", "id", "version"), "minmax-groups")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "version")
    best = found.groupBy("component").agg(F.min(order).alias("best")).select("component", "best.id", "best.version")
    best = materialize(best, "minmax-best")
    gone = materialize(found.select("component", "id", "version").distinct().join(best.withColumnsRenamed({"component": "c", "id": "i", "version": "v"}), F.expr("component = c and id <=> i and version = v"), "left_anti").select("id", "version"), "minmax-gone")
    left = drop_rows(docs, gone, id_col, text_col)
    # a kept row's own repetitions
    again = materialize(found.groupBy("id", "version").agg(F.count("*").alias("n")).filter("n > 1").select("id", "version").join(best.select(F.col("id").alias("i"), F.col("version").alias("v")), F.expr("id <=> i and version = v"), "left_semi"), "minmax-again")
    if not again.limit(1).count():
        return left
    once = left.join(again.toDF("__id", "__version"), F.col(id_col).eqNullSafe(F.col("__id")) & (version(text_col) == F.col("__version")), "left_semi")
    once = once.withColumn("__order", F.xxhash64(*[F.to_json(F.struct(c)) for c in docs.columns])).groupBy(F.col(id_col).alias("__id"), version(text_col).alias("__version")).agg(F.min_by(F.struct(*docs.columns), "__order").alias("__row")).select("__row.*")
    return drop_rows(left, again, id_col, text_col).unionByName(once)


#: What ``op8_near_duplicates`` gives for a table ``documents`` of unique ids, in DuckDB: all pairs that share a shingle are counted.
COMPONENTS_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct([w[i:i + 2] for i in range(1, CAST(len(w) AS BIGINT) - 1)]) WHEN len(w) > 0 THEN [w] ELSE [] END AS s FROM words
), texts AS (
    SELECT list_sort(s) AS s, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY 1
), grams AS (
    SELECT rep, len(s) AS n, unnest(s) AS g FROM texts
), common AS (
    SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
    FROM grams a JOIN grams b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2
), links AS (
    SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c) UNION ALL SELECT b, a FROM common WHERE 100 * c >= 85 * (na + nb - c)
), reach(a, b) AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
    SELECT t.rep, least(t.rep, coalesce(min(r.b), t.rep)) AS component_id FROM texts t LEFT JOIN reach r ON r.a = t.rep GROUP BY t.rep
)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id, coalesce(l.component_id, d.doc_id) = d.doc_id AS kept
FROM sets d LEFT JOIN texts t ON len(d.s) > 0 AND list_sort(d.s) = t.s LEFT JOIN least l ON t.rep = l.rep
"""
