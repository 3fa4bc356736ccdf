"""Operators 11 to 13 against brute force on awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quadgrid.llm import clustering, lexical_search, license_scan

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vectors(spark, rows, dim=4):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string")
    return clustering.integer_vectors(df, dim)


def brute_clusters(rows, k, rounds, dim=4):
    kept = [(i, [math.floor(1024 * float(np.float32(v))) for v in e]) for i, e, _ in rows if e is not None and len(e) == dim and all(v is not None and math.isfinite(v) for v in e)]
    place = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    c = [x for _, x in sorted(kept, key=place)[:k]]
    far = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        at = [far(x)[1] for _, x in kept]
        for j in range(len(c)):
            mine = [x for (_, x), a in zip(kept, at) if a == j]
            if mine:
                c[j] = [sum(v) // len(mine) for v in zip(*mine)]
    return sorted(((i, far(x)[1], far(x)[0]) for i, x in kept), key=repr), c


def test_clusters_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(i % 90, [rng.choice([rng.gauss(0, 1), 0.5, -0.25]) for _ in range(4)], "a") for i in range(120)]
    rows += [(200 + i, [0.5, 0.5, 0.5, 0.5], "copy") for i in range(60)]
    rows += [(None, [1.0, 2.0, 3.0, 4.0], None), (300, None, None), (301, [1.0], None), (302, [1.0, None, 2.0, 3.0], None), (303, [float("nan"), 1.0, 1.0, 1.0], None), (304, [float("inf"), 1.0, 1.0, 1.0], None), (305, [], None)]
    v = vectors(spark, rows)
    found = clustering.cluster(v, clustering.starts(v, 5), 6)
    want, centroids = brute_clusters(rows, 5, 6)
    assert sorted((tuple(r) for r in found.assigned.collect()), key=repr) == want
    assert found.centroids.tolist() == centroids
    out = clustering.with_figures(found).collect()
    assert {r["inertia"] for r in out} == {sum(d for *_, d in want)}
    assert all(r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest() for r in out)


def test_fewer_vectors_than_centroids_and_equal_ones(spark):
    v = vectors(spark, [(1, [1.0] * 4, ""), (2, [1.0] * 4, ""), (3, [0.0] * 4, "")])
    found = clustering.cluster(v, clustering.starts(v, 8), 10)
    near = {r["vec_id"]: (r["cluster"], r["distance"]) for r in found.assigned.collect()}
    assert near[1] == near[2] and all(d == 0 for _, d in near.values())
    assert not len(clustering.starts(vectors(spark, [(1, None, "")])))


def test_products_follow_changed_components_only(spark):
    """A round that moves one component of one centroid changes this centroid's products only."""
    v = vectors(spark, [(i, [i / 7, 1.0, -i / 3, 0.5], "") for i in range(20)])
    c = np.array([[1, 2, 3, 4], [5, 6, 7, 8]], np.int64)
    state = clustering.move(v.selectExpr("vec_id", "x", "0L norm", "array(0L, 0L) dots", "-1 cluster"), c, c)
    step = np.zeros_like(c)
    step[1, 2] = 9
    after = {r["vec_id"]: r for r in clustering.move(state, step, c + step).collect()}
    for r in state.collect():
        x = np.array(r["x"], np.int64)
        assert r["dots"] == (c @ x).tolist() and after[r["vec_id"]]["dots"] == ((c + step) @ x).tolist()


def test_component_out_of_range_is_an_error(spark):
    with pytest.raises(Exception, match="after scaling"):
        vectors(spark, [(1, [1e30, 0.0, 0.0, 0.0], "")]).collect()


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k=10):
    bags = [(i, Counter(TERM.findall((t or "").translate(AZ)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall((t or "").translate(AZ)))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t in terms if t in b)
            scored += [(-s, i is None, i or 0)] if s > 0 else []
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("entries", [1_000_000, 60])
def test_ranked_search_matches_brute_force(spark, monkeypatch, entries):
    rng = random.Random(7)
    words = ["the", "of", "Été", "naïve", "x1", "rare", "blue", "fish", "42", "end"] + [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choices(words, [20, 15] + [3] * 8 + [1] * 40, k=n)) + rng.choice(["", ".", "\x00", "\x1c!"])
    docs = [(i, text(rng.randint(1, 60)).upper() if i % 7 == 0 else text(rng.randint(1, 60))) for i in range(150)]
    docs += [(500 + i, "the blue fish") for i in range(40)]  # ties and copies
    docs += [(3, "the rare fish"), (None, "rare rare blue"), (None, "rare rare blue"), (600, None), (601, ""), (602, "... !"), (603, "blue " * 3000)]
    items = [(i, text(8)) for i in range(12)] + [(20, "the blue fish"), (21, None), (22, "unheard"), (23, "RARE"), (23, "end"), (None, "x1 été")]
    monkeypatch.setattr(lexical_search, "ENTRIES", entries)  # tasks get it with their function
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, rank string").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    got = sorted((tuple(r) for r in lexical_search.ranked_search(d, q).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert got == brute_search(docs, items)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "PAIRS", 3)
    docs = [(i, t) for i, t in enumerate(["a b c", "b c d", "c d e", "a e", None])]
    items = [(1, "a b"), (2, "c d"), (3, "e a"), (4, "b")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in lexical_search.ranked_search(d, q).collect()), key=repr) == brute_search(docs, items)
    assert lexical_search.ranked_search(d.where("false"), q).count() == 0 and lexical_search.ranked_search(d, q.where("false")).count() == 0


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(lexical_search, "PIECE", 5)
    text = "Ab cd-ab \x0b é1\x85é ABCDEFGHIJKLM\tcd"
    want = TERM.findall(text.translate(AZ))
    assert lexical_search.term_counts(text.encode()) == (len(want), Counter(x.encode() for x in want))


@pytest.mark.parametrize("leaf", [1, 3, 32, 500])
def test_trie_finds_the_best_whatever_its_leaves(monkeypatch, leaf):
    monkeypatch.setattr(lexical_search, "LEAF", leaf)
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 12, 400)
    doc = np.repeat(np.arange(400), sizes)
    term = np.concatenate([rng.choice(50, s, replace=False, p=np.linspace(50, 1, 50) / 1275) for s in sizes])
    tf, m = rng.integers(1, 9, len(doc)), rng.integers(10, 300, 400)
    trie = lexical_search.Trie(doc, term, tf, m, list(range(400)))
    assert sorted(trie.ids) == list(range(400)) and max(b - a for a, b, c in zip(trie.lo, trie.hi, trie.children) if not c) <= lexical_search.LEAF
    weight, terms = np.zeros(50, np.int64), np.array([3, 17, 30, 45])
    weight[terms] = [5, 900, 2000, 3000]
    exact = np.bincount(doc, weight[term] * lexical_search.shares(tf, m[doc]), 400)
    best = lexical_search.Best()
    trie.search(terms, weight, best)
    assert [(-s, i) for s, _, i in best.rows] == sorted(((int(s), i) for i, s in enumerate(exact) if s > 0), key=lambda x: (-x[0], x[1]))[:10]
    assert best.floor == -best.rows[-1][0]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def brute_license(text, templates, width):
    w = words_of(text)
    at = lambda p: [i for i in range(len(w)) if w[i : i + len(p)] == p]
    base = [(i, label) for p, label in license_scan.BASE for i in at(p.split())]
    labels, score = {x for _, x in base}, 0.0
    grids = lambda o: {2 * (o // width), 2 * ((o + width // 2) // width) + 1}
    for t in templates:
        wording = t.wording.split()
        begins = []
        for key in (k.split() for k in t.keys):
            q = next(i for i in range(len(wording)) if wording[i : i + len(key)] == key)
            begins.append([i - q for i in at(key)])
        cells = set.intersection(*[{c for o in b for c in grids(o)} for b in begins])
        if cells:
            o = min(x for x in begins[0] if min(cells) in grids(x))
            labels.add(t.label)
            score = max(score, sum(0 <= o + i < len(w) and w[o + i] == x for i, x in enumerate(wording)) / len(wording))
    places = [i for i, _ in base]
    return (len(w), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score)


def test_license_scan_matches_brute_force(spark):
    rng = random.Random(3)
    notices = [t.wording for t in license_scan.TEMPLATES] + [p for p, _ in license_scan.BASE] + ["CC BY CC BY cc-by", "Released, under the (MIT) LICENSE", "version 3 of the GNU General Public License", "mit licenses", "K cc by"]
    noise = ["the", "of", "Éa", "license", "cc", "by", "rights", "42", "\x1f_", "general", "İx"]
    texts = [None, "", " ", "...", "cc by", "by cc", "CC BY" * 3, "version " * 3000 + "gnu general public license version 3", ("mit license " * 2000) + "x"]
    for _ in range(150):
        parts = [" ".join(rng.choices(noise, k=rng.randint(0, 15))) for _ in range(3)]
        n = rng.choice(notices).split(" ")
        if rng.random() < 0.4 and len(n) > 4:
            i = rng.randrange(len(n))
            n[i : i + 1] = rng.choice([[], ["zzz", "yyy"], [n[i].upper(), "qq"] + ["z"] * rng.randrange(14)])
        texts.append(rng.choice([" ", "\n", "-", ", "]).join([parts[0], *n, parts[1], rng.choice(notices), parts[2]]))
    rows = [(None if i == 5 else i // 2, t, "l") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = license_scan.scan(df).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", *license_scan.RESULTS}
    norm = lambda x: tuple(round(v, 12) if isinstance(v, float) else v for v in x)
    have = sorted((norm(r[c] for c in license_scan.RESULTS) for r in got), key=repr)
    assert have == sorted((norm(brute_license(t, license_scan.TEMPLATES, license_scan.WIDTH)) for t in texts), key=repr)
    assert any(r["labels"] != r["base_labels"] for r in got) and license_scan.scan(df.where("false")).count() == 0


def test_license_scan_runs_no_python(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    plan = license_scan.scan(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan.split("== Physical Plan ==")[1])
