"""MinHash near-dedup and its components against brute force."""
import random
import re

from cases import awkward, table

from srcgraph.llm.components import connected_components
from srcgraph.llm.near_dedup import cross_pairs, drop_near_duplicates, near_duplicates


def shingles(text):
    w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows):
    s = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None] if s[i] else [r[0]]
        c = min(ids, default=None) if s[i] else r[0]
        out.append((str(r[0]), len(s[i]), str(c), r[0] == c))
    return sorted(out)


def many_near_copies(seed):
    """Chains of ever more edited texts, some of whose ends are too far apart to be linked themselves."""
    r = random.Random(seed)
    rows = []
    for g in range(6):
        w = [f"g{g}_{r.randrange(60)}" for _ in range(120)]
        for _ in range(25):
            w = list(w)
            w[r.randrange(len(w))] = f"e{r.randrange(9)}"
            rows.append((len(rows), " ".join(w), "en", "a", 1))
    r.shuffle(rows)
    return rows


def test_near_duplicates(spark):
    for rows in (awkward(4), many_near_copies(5)):
        got = near_duplicates(table(spark, rows, clash=True))
        assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id), x.kept) for x in got.collect()) == brute(rows)


def test_pairs_of_edited_copies(spark):
    """Copies edited apart, most of them below the limit to each other: every link between components is a pair, few others are."""
    r = random.Random(9)
    base, sets = list(range(150)), []
    for i in range(1500):
        mine = set(r.sample(base, 150 - r.choice([8, 20, 24, 28])))
        sets.append(sorted(mine | {1000 + 200 * i + k for k in range(150 - len(mine))}))
    label = [0 if i % 8 else i for i in range(len(sets))]
    links = {(a, b) for a in range(len(sets)) for b in range(len(sets)) if label[a] < label[b]
             and 175 * len(set(sets[a]) & set(sets[b])) >= 75 * 300}
    nodes = spark.createDataFrame(list(enumerate(label)), "node long, label long")
    full = spark.createDataFrame([(i, len(s), s) for i, s in enumerate(sets)], "node long, n long, s array<long>")
    got = [(x.a, x.b) for x in cross_pairs(nodes, full).collect()]
    pairs = {tuple(sorted(x, key=lambda i: label[i])) for x in got}
    assert len(pairs) == len(got) and links <= pairs
    assert len(got) < 0.4 * sum(label[a] < label[b] for a in range(len(sets)) for b in range(len(sets)))


def test_ids_of_text_and_rows_that_repeat_one(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [("b", text, 2), ("a", text + " more", 9), ("b", text, 1), ("a", text + " more", None), (None, "alone here", 3)]
    df = spark.createDataFrame(rows, "doc_id string, text string, n long")
    assert sorted((str(x.doc_id), x.component_id or "", x.kept) for x in near_duplicates(df).collect()) == [
        ("None", "", True), ("a", "a", True), ("a", "a", True), ("b", "a", False), ("b", "a", False)]
    got = sorted((str(x.doc_id), x.n) for x in drop_near_duplicates(df).collect())
    assert got == [("None", 3), ("a", None)]


def test_one_of_each_group_stays(spark):
    rows = awkward(6)
    df = table(spark, rows, clash=True)
    got = drop_near_duplicates(df)
    assert got.columns == df.columns
    want = {x[0] for x in brute(rows) if x[3]}
    assert sorted(str(x.doc_id) for x in got.collect() if x.doc_id is not None) == sorted(want - {"None"})
    assert drop_near_duplicates(table(spark, [])).count() == 0


def test_components(spark):
    r = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    edges += [(5, 5), (None, 3), (41, 40), (41, 40)]
    label = {n: n for e in edges if None not in e for n in e}
    for _ in range(300):
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    got = {x.node: x.label for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    lone = {n for n in label if all(n not in e or e[0] == e[1] for e in edges if None not in e)}
    assert got == {n: m for n, m in label.items() if n not in lone}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
