"""Near-duplicates and components against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quantloom.llm import minhash
from quantloom.llm.components import connected_components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows)}


def corpus(seed, groups, most):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéÉXYZ") for _ in range(rng.randrange(1, 6)))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(1, 200))]
        for _ in range(rng.randrange(1, most)):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(words) // 60)):
                words[rng.randrange(len(words))] = word()
            rows.append(rng.choice([" ", "\n", "  "]).join(words if rng.random() < 0.7 else [w.upper() if w.isascii() else w for w in words]))
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("percent", [80, 85])
def test_against_brute_force(spark, percent):
    rows = corpus(3, 60, 9) + [(9001, None), (9002, ""), (9003, " \n"), (9004, "one two"), (9005, "ONE two"), (9006, "word " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, percent=percent).collect()}
    assert found == brute(rows, percent)


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = corpus(8, 3, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert found == brute(rows)


def crowd(seed, n, groups):
    """Texts that share a passage of three fifths of their words, so that many of them meet in the same buckets; some are near copies."""
    rng = random.Random(seed)
    passage = " ".join(f"common{k}" for k in range(60))
    own = lambda k, size=40: " ".join(f"w{k}x{j}" for j in range(size))
    rows = [f"{passage} {own(k)}" for k in range(n)]
    expected = list(range(n))
    for k in range(groups):  # one word of the last changed: similar beyond the passage
        rows.append(rows[k].rsplit(" ", 1)[0] + f" changed{k}")
        expected.append(k)
    order = list(range(len(rows)))
    rng.shuffle(order)
    where = {old: new for new, old in enumerate(order)}
    least = {}
    for old, group in enumerate(expected):
        least[group] = min(least.get(group, len(rows)), where[old])
    return [(where[old], text) for old, text in enumerate(rows)], {where[old]: least[group] for old, group in enumerate(expected)}


def test_crowded_buckets_are_cut_by_rare_shingles(spark, monkeypatch):
    """20,000 texts in mixed buckets far beyond a block: the known components, and few comparisons."""
    rows, expected = crowd(4, 20_000, 300)
    sizes, plain = [], minhash.compared

    def counting(placed, mixed, nodes, percent):
        sizes.append(mixed.selectExpr("coalesce(max(size), 0)").first()[0])
        return plain(placed, mixed, nodes, percent)

    monkeypatch.setattr(minhash, "compared", counting)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert found == expected
    assert len(sizes) == 2 and max(sizes) <= minhash.BLOCK


@pytest.mark.parametrize("percent", [80, 85])
def test_rare_shingles_lose_no_link(spark, monkeypatch, percent):
    """Every bucket of two or more counts as crowded, shingles as frequent from two texts on."""
    for name, value in (("BLOCK", 1), ("FREQUENT", 2), ("MOST_FREQUENT", 40)):
        monkeypatch.setattr(minhash, name, value)
    rows = corpus(12, 25, 12) + [(9001, None), (9002, "one two"), (9003, "ONE two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    nodes = minhash.materialize(docs.where("text is not null").selectExpr("doc_id as node", "text"), "t")
    pairs = set()
    for r in minhash.by_rare_shingles(nodes, percent).groupBy("bucket").agg({"node": "collect_set"}).collect():
        pairs |= {(a, b) for a in r[1] for b in r[1] if a < b}
    sets = {d: shingles(t) for d, t in rows if t}
    similar = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert similar <= pairs
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, percent=percent).collect()}
    assert found == brute(rows, percent)


@pytest.mark.parametrize("percent", [80, 85])
def test_cutting_again_loses_no_link(spark, monkeypatch, percent):
    """Every bucket counts as crowded and is cut again while that helps; similar pairs meet where one of them is short."""
    for name, value in (("BLOCK", 1), ("CROWD", 1), ("FREQUENT", 2), ("MOST_FREQUENT", 40)):
        monkeypatch.setattr(minhash, name, value)
    rows = corpus(12, 25, 12) + [(9001, None), (9002, "one two"), (9003, "ONE two")]
    sets = {d: shingles(t) for d, t in rows if t}
    similar = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    nodes = minhash.materialize(docs.where("text is not null").selectExpr("doc_id as node", "text"), "t")
    whole = minhash.materialize(nodes.selectExpr("cast(7 as long) as bucket", "node", "node as component"), "t")
    for placed in (minhash.by_rare_shingles(nodes, percent), minhash.cut_again(whole, nodes, percent)):
        met = set()
        for r in placed.groupBy("bucket").agg(F.collect_list(F.struct("node", "short")).alias("members")).collect():
            met |= {(min(a, b), max(a, b)) for a, short in r.members if short for b, _ in r.members if a != b}
        assert similar <= met
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, percent=percent).collect()}
    assert found == brute(rows, percent)


def test_texts_of_passages_are_cut_again(spark, monkeypatch):
    """20,000 texts of a common passage and two out of ten each, with few words of their own: those with the same three
    are similar, the others are not, though thousands share every shingle that is not a text's own."""
    passage = lambda name, size: " ".join(f"{name}w{j}" for j in range(size))
    text = lambda i, a, b: f"{passage('u', 112)} {passage(f'a{a}', 34)} {passage(f'b{b}', 34)} {passage(f'own{i}', 14)}"
    groups = [(i // 10 % 10, i % 10) for i in range(20_000)]
    nodes = spark.createDataFrame([(i, text(i, a, b)) for i, (a, b) in enumerate(groups)], "node long, text string").repartition(8)
    nodes = minhash.materialize(nodes, "t")
    signed = minhash.signatures(nodes, "node").selectExpr("id as node", "signature").join(nodes.selectExpr("node", "cast(octet_length(text) as long) as bytes", "text"), "node")
    costs, cuts, plain, again = [], [], minhash.compared, minhash.cut_again

    def counting(placed, mixed, nodes, percent):
        costs.append(mixed.selectExpr(f"coalesce(max(size * {'shorts' if 'shorts' in mixed.columns else 'size'}), 0)").first()[0])
        return plain(placed, mixed, nodes, percent)

    def cutting(members, texts, percent):
        cuts.append(members.groupBy("bucket").count().selectExpr("max(count)").first()[0])
        return again(members, texts, percent)

    monkeypatch.setattr(minhash, "compared", counting)
    monkeypatch.setattr(minhash, "cut_again", cutting)
    monkeypatch.setattr(minhash, "CROWD", 1_000)
    component = nodes.selectExpr("node", "node % 100 as component")
    members = nodes.selectExpr("cast(1 as long) as bucket", "node")
    assert minhash.cross_links(members, minhash.materialize(signed, "t"), component).count() == 0
    assert len(cuts) == 1 and cuts[0] >= 2_000
    assert max(costs) <= 1_000**2


def test_near_copies_meet_once_not_in_every_shared_bucket(spark, monkeypatch):
    """Forty texts in two families of near copies, in twelve buckets of 38 each and one of other texts: one comparison of the forty, all links found."""
    base = [[f"t{g}w{k}" for k in range(200)] for g in range(2)]
    texts = [" ".join([*base[i % 2][:-1], f"last{i}"]) for i in range(40)] + [f"other{i} " * 9 for i in range(20)]
    nodes = minhash.materialize(spark.createDataFrame(list(enumerate(texts)), "node long, text string"), "t")
    signed = minhash.signatures(nodes, "node").selectExpr("id as node", "signature").join(nodes.selectExpr("node", "cast(octet_length(text) as long) as bytes", "text"), "node")
    held = [(b, i, i, i % 3 > 0) for b in range(12) for i in range(40) if i not in (b, b + 20)] + [(99, i, i, True) for i in range(40, 60)]
    rows = spark.createDataFrame(held, "bucket long, node long, component long, short boolean")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.count_if("short").alias("shorts"))
    costs, plain = [], minhash.compared

    def counting(placed, mixed, nodes, percent):
        costs.append(sorted((r.size, r.n) for r in placed.join(mixed.select("bucket", "size"), "bucket").groupBy("bucket", "size").agg(F.count("*").alias("n")).collect()))
        return plain(placed, mixed, nodes, percent)

    monkeypatch.setattr(minhash, "compared", counting)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    links = minhash.crowd_links(minhash.materialize(rows, "t"), minhash.materialize(sizes, "t"), nodes, minhash.materialize(signed, "t"), 80)
    found = connected_components(links)
    assert {(r.component, r.n) for r in found.groupBy("component").agg(F.count("*").alias("n")).collect()} == {(0, 20), (1, 20)}
    assert costs == [[(20, 20), (40, 40)]]


def test_groups_bounded_in_bytes(spark, monkeypatch):
    """Groups cut by bytes in both comparisons: the same components, and no group of several texts far above the bound."""
    rows = corpus(21, 12, 40) + [(9001, "w " * 40_000), (9002, " ".join(f"long{k}" for k in range(30_000)))]
    rows.append((9003, rows[-1][1] + " end"))
    monkeypatch.setattr(minhash, "GROUP_BYTES", 4_000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert found == brute(rows)


def test_bucket_of_long_texts_is_cut(spark, monkeypatch):
    """Sixty texts of 20 KB in one bucket, each in its own component, in groups of at most 128 KB: every link is found."""
    monkeypatch.setattr(minhash, "GROUP_BYTES", 128 << 10)
    base = [[f"t{g}w{k}" for k in range(2_500)] for g in range(6)]
    texts = [" ".join([*base[i % 6][:-1], f"last{i}"]) for i in range(60)]
    nodes = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    signed = minhash.signatures(nodes).selectExpr("id as node", "signature").join(nodes.selectExpr("doc_id as node", "cast(octet_length(text) as long) as bytes", "text"), "node")
    placed = nodes.selectExpr("cast(1 as long) as bucket", "doc_id as node", "doc_id as component")
    mixed = spark.createDataFrame([(1, 60)], "bucket long, size long")
    links = minhash.compared(placed, mixed, minhash.materialize(signed, "t"), 80).collect()
    parts = {i: {i} for i in range(60)}
    for r in links:
        merged = parts[r.u] | parts[r.v]
        for x in merged:
            parts[x] = merged
    assert {frozenset(p) for p in parts.values()} == {frozenset(range(g, 60, 6)) for g in range(6)}


def test_documents_keep_columns_and_one_row_each(spark):
    rows = [(1, "a b c d e f", 5, "x"), (1, "a b c d e f", 5, "x"), (2, "A b c d e f", 6, None), (None, "z z z", 7, "y"), (4, None, 8, "y"), (5, "", 8, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, first long, `row` string")
    kept = minhash.near_dedup_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "4", "5", "None"]
    assert minhash.near_dedup_documents(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(100)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: root(x) for e in edges if e[0] != e[1] for x in e}
