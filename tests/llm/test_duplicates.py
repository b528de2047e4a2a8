"""Ops 3, 4, 5 and 8 against brute force."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tessera.llm import decontam, linededup, minmax, sketch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def shingle_set(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def corpus(seed=0, n=120, vocabulary=400):
    """Originals, exact copies, near copies in chains and a large group."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)]
    out = []
    while len(out) < n:
        base = [rng.choice(vocab) for _ in range(rng.randint(1, 80))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 12])):
            base = list(base)
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = rng.choice(vocab)
            out.append(rng.choice([" ", "  ", "\n"]).join(base).capitalize())
    return out


def components(sets, percent):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("params", [minmax.CONTRACT, minmax.Params()])
def test_near_duplicates(docs, params):
    texts = corpus()
    sets = {i: shingle_set(t, params.shingle) for i, t in enumerate(texts)}
    want = {d: (len(sets[d]), c, c == d) for d, c in components(sets, params.percent).items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minmax.near_duplicates(docs(*texts), params).collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_cross_links(seed):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.choice(60, 40).astype(np.uint64)) for _ in range(40)]
    component, outside = rng.integers(0, 5, 40), rng.random(40) < 0.4
    near = lambda x, y: 2 * len(np.intersect1d(sets[x], sets[y])) >= len(np.union1d(sets[x], sets[y]))
    x_of, y_of = np.flatnonzero(outside), np.flatnonzero(~outside)
    found = minmax.cross_links([sets[x] for x in x_of], component[x_of], [sets[y] for y in y_of], component[y_of], 50)
    found = [(int(x_of[x]), int(y_of[y])) for x, y in found]
    assert all(near(x, y) and component[x] != component[y] for x, y in found)
    want = {(x, int(component[y])) for x in x_of.tolist() for y in y_of.tolist() if component[x] != component[y] and near(x, y)}
    assert {(x, int(component[y])) for x, y in found} == want


def test_near_duplicates_in_small_blocks(docs, monkeypatch):
    monkeypatch.setattr(minmax, "BLOCK", 150)
    monkeypatch.setattr(minmax, "MEMBERS", 3)
    # few permutations: bands leave much to links across components
    params = minmax.Params(shingle=2, percent=60, permutations=40, rows=2)
    texts = corpus(seed=3, n=150, vocabulary=12)
    sets = {i: shingle_set(t, 2) for i, t in enumerate(texts)}
    got = {r["doc_id"]: r["component_id"] for r in minmax.near_duplicates(docs(*texts), params).collect()}
    assert got == components(sets, 60)


def test_one_row_of_each_group_stays(docs):
    a, near_a, b = "one two three four five six seven eight nine ten " * 6, "one two three four five six seven eight nine ten " * 6 + "end", "other words that stand alone in this small table"
    again = (9, a, "en", "s", 1, "x", "y", "z")
    table = docs(None, "", b, a, near_a, extra=[again, again, (2, a, "en", "s", 1, "x", "y", "z"), (2, a, "de", "s", 1, "x", "y", "z"), (None, a, "en", None, 1, "x", "y", "z")])
    left = minmax.one_of_each_group(table)
    assert left.columns == table.columns
    assert sorted((r["doc_id"], r["text"]) for r in left.collect() if r["text"]) == [(2, a), (2, b)]
    assert left.filter("coalesce(text, '') = ''").count() == 2


def test_near_duplicates_at_the_edges(odd, none):
    got = [tuple(r) for r in minmax.near_duplicates(odd).collect()]
    assert len(got) == odd.count()
    by_id = collections.defaultdict(list)
    for d, n, c, kept in got:
        by_id[d].append((n, c, kept))
    assert by_id[0] == [(0, 0, True)] and by_id[2] == [(0, 2, True)]
    assert by_id[3] == [(1, 3, True)] * 2 and by_id[9] == [(1, 3, False)]
    assert by_id[None] == [(1, None, True)]
    assert minmax.near_duplicates(none).count() == 0


def test_estimates_are_unbiased():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 4000).astype(np.uint64)
    multipliers = minmax._multipliers(200)
    x, y = minmax.signature(np.unique(a[:3000]), multipliers), minmax.signature(np.unique(a[1000:]), multipliers)
    assert abs((x == y).mean() - 0.5) < 0.08


def benchmark_overlap(text, item, params):
    """(most equal words, first position, windows) by comparing all windows; None without an overlap."""
    d, b = words(text), words(item)
    k = min(params.window, len(b))
    if len(b) < params.least_item:
        return None
    spare = params.substitutions * k // params.window
    found = {}
    for i in range(len(d) - k + 1):
        for j in range(len(b) - k + 1):
            same = sum(x == y for x, y in zip(d[i : i + k], b[j : j + k]))
            if same >= k - spare:
                found[i] = max(found.get(i, 0), same)
    return (max(found.values()), min(found), len(found)) if found else None


def test_decontamination(docs, spark):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(300)]
    items = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (30, 20, 13, 12, 8, 7, 6, 5, 4, 3)] + [None, ""]
    items.append(items[0])
    texts = []
    for i in range(120):
        w = [rng.choice(vocab) for _ in range(40)]
        b = words(items[i % 10])
        for _ in range(rng.randint(0, 4)):
            b[rng.randrange(len(b))] = "other"
        texts.append(" ".join(w[:20] + b + w[20:]).upper() if i % 7 else " ".join(w))
    texts += [None, "", items[0], texts[1]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    params = decontam.Params()
    want = {(d, i): n for d, t in enumerate(texts) for i, x in enumerate(items) if (n := benchmark_overlap(t, x, params))}
    table = docs(*texts)
    got = {(r["doc_id"], r["item"]): (r["words"], r["position"], r["windows"]) for r in decontam.overlaps(table, bench, params).collect()}
    assert got == want and {i for _, i in want} >= set(range(8))
    # a bitmap that is full changes nothing
    full = decontam.Params(most_bits=8)
    assert {(r["doc_id"], r["item"]): (r["words"], r["position"], r["windows"]) for r in decontam.overlaps(table, bench, full).collect()} == want
    left = decontam.clean(table, bench, params)
    assert left.columns == table.columns
    assert {r["doc_id"] for r in left.collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_decontamination_goes_by_row_where_ids_repeat(docs, spark):
    item = "a benchmark question of thirteen words that a training text must not hold"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = (0, "quite another text under the same id", "en", "s", 1, "x", "y", "z")
    table = docs(f"see {item} there", extra=[clean, clean, (None, item, "en", "s", 1, "x", "y", "z"), (None, "kept", "en", "s", 1, "x", "y", "z")])
    assert sorted(r["text"] for r in decontam.clean(table, bench).collect()) == ["kept", clean[1], clean[1]]
    got = {(r["doc_id"], r["windows"]) for r in decontam.overlaps(table, bench).collect()}
    assert got == {(0, 1), (None, 1)}


@pytest.mark.parametrize("n", range(5, 14))
def test_every_window_within_tolerance_is_hit(n):
    params = decontam.Params()
    for replaced in itertools.combinations(range(n), params.tolerance(n)):
        assert any(not set(replaced) & set(mask) for mask in params.masks(n))


def test_decontamination_at_the_edges(odd, none, spark):
    bench = spark.createDataFrame([(1, "again and again and again now")], "item_id long, text string")
    empty = bench.filter("item_id < 0")
    assert decontam.overlaps(odd, bench).count() == 0 == decontam.overlaps(none, bench).count()
    assert decontam.clean(odd, empty).count() == odd.count()


def held_oracle(texts, least):
    """Every block of neighbouring lines that some earlier document holds, looked for in all pairs of documents."""
    lines = {d: [x.strip() for x in t.split("\n") if x.strip()] for d, t in texts.items()}
    out = {}
    for d, own in lines.items():
        gone = set()
        for e in (e for e in lines if e < d):
            for i in range(len(own)):
                for j in range(len(lines[e])):
                    n = 0
                    while i + n < len(own) and j + n < len(lines[e]) and own[i + n] == lines[e][j + n]:
                        n += 1
                    if sum(len(WORD.findall(x)) for x in own[i : i + n]) >= least:
                        gone.update(range(i, i + n))
        kept, at = [], 0
        for x in texts[d].split("\n"):
            if x.strip():
                at += 1
            if not x.strip() or at - 1 not in gone:
                kept.append(x)
        out[d] = "\n".join(kept)
    return out


def test_line_dedup_against_all_earlier_documents(docs):
    rng = random.Random(12)
    pool = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randint(1, 11))) for _ in range(60)]
    # every third line is first seen alone: the copies' lines have different first holders
    texts = [pool[3 * i] for i in range(10)]
    for d in range(40):
        start = rng.randrange(50)
        own = [rng.choice(pool) for _ in range(rng.randint(0, 6))] + pool[start : start + rng.randint(0, 8)] + [f"only here {d} " * 4]
        texts.append("\n".join(rng.choice([x, f"  {x} ", x + "\n"]) for x in own))
    texts.append(texts[-1])
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs(*texts)).collect()}
    assert got == held_oracle(dict(enumerate(texts)), 8)
    assert not got[len(texts) - 1].strip() and texts[-1].strip()


def test_line_dedup_of_a_repeated_id_goes_by_text(docs):
    passage = "one two three four five\nsix seven eight nine"
    table = docs(passage, "fresh\nown words of this row\nthat nobody else has had", extra=[(1, f"new\n{passage}", "en", "s", 1, "x", "y", "z")])
    got = sorted((r["doc_id"], r["text"]) for r in linededup.dedup_lines(table).collect())
    assert got == [(0, passage), (1, "fresh\nown words of this row\nthat nobody else has had"), (1, "new")]


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_of_moved_and_repeated_blocks(docs, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randint(2, 12))) for _ in range(9)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 25))) for _ in range(25)]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs(*texts)).collect()}
    assert got == held_oracle(dict(enumerate(texts)), 8)


def test_blocks_follow_the_alignment():
    # lines 0 to 4 stand in the other from 10 on; 6 and 7 have moved to the front
    seeds = [(i, 10 + i, True, i) for i in range(5)] + [(6, 2, True, 6), (7, 3, True, 7)]
    assert linededup.blocks(seeds) == [(0, 4, 10), (6, 7, 2)]
    # a run of two lines and one of the first alone are one block
    assert linededup.blocks([(0, 5, True, 1), (0, 5, False, 0), (1, 6, True, 2)]) == [(0, 2, 5)]


def test_orders_are_increasing_and_whole():
    rng = random.Random(3)
    for _ in range(100):
        found = sorted({(rng.randrange(30), rng.randrange(9)) for _ in range(25)})
        out = linededup.orders(found)
        assert sorted(m for o in out for m in o) == found
        assert all(x[1] < y[1] for o in out for x, y in zip(o, o[1:]))


def test_line_dedup_refuses_a_clash(docs):
    with pytest.raises(ValueError):
        linededup.dedup_lines(docs("a").withColumnRenamed("score", "lines_removed"))


def test_line_dedup_at_any_number_of_holders(docs):
    licence = "this line of ten words stands in very many documents"
    got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in linededup.dedup_lines(docs(*[f"own {d}\n{licence}\nend {d}" for d in range(130)])).collect()}
    assert got[0] == (f"own 0\n{licence}\nend 0", 0)
    assert all(got[d] == (f"own {d}\nend {d}", 1) for d in range(1, 130))


def test_longest_increasing_alignment():
    rng = random.Random(9)
    for _ in range(200):
        second = list(range(8))
        rng.shuffle(second)
        pairs = list(enumerate(second))
        best = max(bin(s).count("1") for s in range(256) if (q := [second[i] for i in range(8) if s >> i & 1]) == sorted(q))
        assert len(linededup.increasing(pairs)) == best


def test_line_dedup_at_the_edges(odd, none):
    out = {(r["doc_id"], r["source"], r["text"]) for r in linededup.dedup_lines(odd).collect()}
    assert out == {(r["doc_id"], r["source"], r["text"]) for r in odd.collect()}  # three words are no block
    assert linededup.dedup_lines(none).count() == 0


def test_fingerprints(docs):
    rng = random.Random(6)
    texts = ["\n".join(" ".join(rng.choice("abcdefghijk") * 3 for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 9))) for _ in range(50)]
    texts += [None, "", "short", texts[0], "x\n" * 5000, " ".join(f"n{i}" for i in range(30_000))]
    ids = rng.sample(range(1000), len(texts))
    table = docs(*texts, first=0)
    sent = table.sparkSession.createDataFrame([(i, t) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string")
    order = sorted(zip(ids, [t or "" for t in texts], strict=True), reverse=True)
    params = sketch.Params()

    def pieces(t):
        """Lines, cut behind words whose hash says so; the hash is the operator's, the cutting is not."""
        out = set()
        for line in t.split("\n"):
            own = []
            for w in WORD.findall(line):
                own.append(w)
                raw = np.frombuffer(w.encode(), np.uint8)
                if int(sketch.tx.RangeHash(raw)(np.array([0]), np.array([len(raw)]))[0]) % params.cut == 0:
                    out.add(" ".join(own))
                    own = []
            if own:
                out.add(" ".join(own))
        return out

    def like(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    want = {}
    for k, (d, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        e = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        want[d] = (len(t), hashlib.sha256(e.encode()).hexdigest(), like(pieces(t), pieces(e)), like(pieces(t), pieces(after)))
    got = {r["doc_id"]: r for r in sketch.compare_with_edits(sent).collect()}
    assert {d: (r["n_chars"], r["edited_sha256"]) for d, r in got.items()} == {d: w[:2] for d, w in want.items()}
    for d, w in want.items():
        assert (got[d]["near_edited"], got[d]["near_next"]) == pytest.approx(w[2:])
    assert got[ids[0]]["fingerprint"] == got[ids[53]]["fingerprint"]


def test_recovered_digests_are_those_that_differ(spark):
    lines = [f"paragraph number {i} of some document" for i in range(400)]
    old, new = spark.createDataFrame([(1, "\n".join(lines)), (2, "same"), (3, None)], "doc_id long, text string"), spark.createDataFrame([(1, "\n".join(lines[:390] + ["another"])), (2, "same"), (3, "x")], "doc_id long, text string")
    params = sketch.Params(cut=1 << 62)
    got = {r["doc_id"]: (set(r["removed"]), set(r["added"])) for r in sketch.recovered(old, new, params).collect()}

    def digest(line):
        raw = np.frombuffer(line.encode(), np.uint8)
        return int(sketch.tx.RangeHash(raw)(np.array([0]), np.array([len(raw)])).view(np.int64)[0])

    assert got == {1: ({digest(x) for x in lines[390:]}, {digest("another")}), 2: (set(), set()), 3: (set(), {digest("x")})}


def test_fingerprints_of_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(sketch, "RANGE_BYTES", 200)
    rng = random.Random(2)
    rows = [(rng.choice([None, 7, 7, 7, *range(40)]), " ".join(rng.choice("abcdef") * 3 for _ in range(rng.randint(0, 30)))) for _ in range(300)]
    got = [(r["doc_id"], r["edited_sha256"]) for r in sketch.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()]

    def tie(t):
        return (spark_hash[t] & ((1 << 64) - 1)) >> 1

    spark_hash = {r[0]: r[1] for r in spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "xxhash64(text)").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie(r[1])))
    want = [(d, hashlib.sha256((t[: len(t) - len(t) // 3] + order[(k + 1) % len(order)][1][: len(t) // 3]).encode()).hexdigest()) for k, (d, t) in enumerate(order)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_peeling_recovers_the_difference():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2**63, 9).astype(np.uint64), rng.integers(0, 2**63, 4).astype(np.uint64)
    t = sketch.Tables(1, 48)
    t.add(np.zeros(9, int), a)
    t.add(np.zeros(4, int), b, -1)
    _, digests, signs, done = t.peel()
    assert done.all() and set(digests[signs > 0]) == set(a) and set(digests[signs < 0]) == set(b)


def test_fingerprints_at_the_edges(odd, none, docs):
    assert sketch.compare_with_edits(odd).count() == odd.count()
    assert sketch.compare_with_edits(none).count() == 0
    r = sketch.compare_with_edits(docs("only one text here")).first()
    assert r["near_next"] == 1.0  # its next document is itself
    assert sketch.fingerprint(odd).count() == odd.count()
