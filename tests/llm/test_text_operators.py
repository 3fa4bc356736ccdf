"""The text operators against brute force on small tables with the awkward rows in them."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quadgrid.llm import decontaminate, langid, line_dedup, near_dedup, packing, quality, substring_dedup, token_files
from quadgrid.llm.collection_bwt import CollectionBWT, columns_of, repeated_windows
from quadgrid.llm.common import shared_dir
from quadgrid.llm.components import connected_components, join_components
from quadgrid.llm.line_dedup import index_keys
from quadgrid.llm.tokens import TextEncoder

DATA = "/root/testdata/sf0.001"
WORD = regex.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def rows():
    """sf0.001 and edge cases: null, empty, blank, short, very long, repeated and equal texts."""
    found = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY 1").fetchall()
    long = " ".join(f"w{i % 4001}" for i in range(30_000))
    extra = [None, "", " \n\t ", "one", "one two", "Zwei Wörter und noch drei\n" * 12, "x" * 1000, long, long + " end", "#*$%&|<>" * 20, found[3][1], "a b c d", "A B C D"]
    return found + [(1000 + i, t) for i, t in enumerate(extra)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# --- substring dedup -------------------------------------------------------------------------


def covered_bytes(rows, width):
    texts = {d: (t or "").encode() for d, t in rows}
    n = Counter(t[i : i + width] for t in texts.values() for i in range(len(t) - width + 1))
    out = {}
    for d, t in texts.items():
        cover = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if n[t[i : i + width]] > 1:
                cover[i : i + width] = b"\1" * width
        kept = bytes(b for b, c in zip(t, cover) if not c)
        out[d] = (len(t), sum(cover), sum(c and (i == 0 or not cover[i - 1]) for i, c in enumerate(cover)), kept)
    return out


@pytest.mark.parametrize("width, group", [(80, 4), (400, 96)])
def test_substring_dedup(spark, width, group):
    rng = random.Random(group)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    passage = [" ".join(rng.choice(words) for _ in range(width // 2)) for _ in range(5)]
    passage += [x[: width // 2] for x in passage[:2]]  # shared, but shorter than the width: crowded anchors
    rows = [(i, " ".join(rng.choice([rng.choice(words)] * 20 + passage) for _ in range(120))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "ab" * 6 * width), (103, "ab" * 5 * width), (104, "z" * width), (105, rows[0][1]), (106, rows[0][1]), (107, "é" * 50), (None, rows[1][1])]
    rows += [(108, rows[2][1] + "x"), (108, rows[2][1] + "x"), (109, rows[3][1][: width - 1]), (110, "q" * (width - 1)), (111, " ".join(words * 40))]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, spans long")
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], len(r["spans"]) // 2, bytes(r["kept"])) for r in substring_dedup.dedup_substrings(df, width, group).collect())
    want = covered_bytes(list(enumerate(t for _, t in rows)), width)
    assert got == sorted((str(d), *want[i]) for i, (d, _) in enumerate(rows))


def test_substring_ranges_are_a_row_a_segment(spark, monkeypatch):
    """However many groups find ranges of a segment, joins to its ranges give no more rows than there are segments."""
    rng, found, plain = random.Random(11), [], substring_dedup.cut

    def kept(df, label):
        out = plain(df, label)
        if label in ("ranges", "part-ranges"):
            found.append((label, out))
        return out

    monkeypatch.setattr(substring_dedup, "cut", kept)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, left, right = text(70), [text(50) for _ in range(5)], [text(50) for _ in range(5)]
    rows = [(5 * i + j, text(90) + left[i] + passage + right[j] + text(90)) for i in range(5) for j in range(5)]
    got = {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), 80, 3).collect()}
    assert got == {d: (n, kept_) for d, (_, n, _, kept_) in covered_bytes(rows, 80).items()} and all(n >= 170 for n, _ in got.values())
    assert {label for label, _ in found} == {"ranges", "part-ranges"}
    for _, ranges in found:
        assert ranges.count() == ranges.select("h", "s1", "s2").distinct().count()


def test_substring_dedup_of_nothing(nothing):
    assert substring_dedup.dedup_substrings(nothing).count() == 0


@pytest.mark.parametrize("stride, block", [(1, 1000), (3, 1000), (1, 7), (3, 2), (1, 1)])
def test_collection_transform(stride, block):
    """The transform, prefixes and owners of all suffixes, in blocks of any size."""
    rng = random.Random(stride)
    for _ in range(25):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 15))) for _ in range(rng.randint(1, 9))]
        lengths = np.array(list(map(len, strings)))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(int)
        columns, owner, end = columns_of(np.frombuffer(b"".join(strings), np.uint8), starts, lengths, stride)
        parts = []
        for k in range(columns.shape[1]):
            first = k % stride
            body = strings[owner[k]][first : end[k]]
            parts.append([body[i : i + stride] for i in range(0, len(body), stride)])
        order = sorted((p[i:], k) for k, p in enumerate(parts) for i in range(len(p) + 1))
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        built = CollectionBWT(columns, block)
        bwt, lcp, who, length = map(np.concatenate, zip(*built.rows()))
        assert lcp.tolist() == [0] + [common(a[0], b[0]) for a, b in zip(order, order[1:])]
        assert [(len(t), k) for t, k in order] == list(zip(length.tolist(), who.tolist()))
        assert [c == 0 for c in bwt] == [len(t) == len(parts[k]) for t, k in order]


@pytest.mark.parametrize("stride, width", [(1, 4), (3, 6), (40, 80)])
def test_repeated_windows(stride, width):
    rng = random.Random(width)
    for i in range(30):
        base = bytes(rng.choice(b"ab") for _ in range(3 * width))
        strings = [base[rng.randint(0, width) : rng.randint(width, 3 * width)] for _ in range(rng.randint(1, 6))]
        weights = np.array([rng.choice([1, 1, 2]) for _ in strings])
        n = Counter()
        for s, w in zip(strings, weights):
            n.update({k: c * int(w) for k, c in Counter(s[i : i + width] for i in range(len(s) - width + 1)).items()})
        want = [[i for i in range(len(s) - width + 1) if n[s[i : i + width]] > 1] for s in strings]
        assert [x.tolist() for x in repeated_windows(strings, weights, width, stride, [1, 16, 1 << 16][i % 3])] == want


# --- near dedup ------------------------------------------------------------------------------


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_components(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, b in enumerate(ids):
        for a in ids[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_dedup(docs, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {d: (n, c, c == d) for d, (n, c) in near_components(rows).items()}


def test_near_dedup_chains_and_large_groups(spark):
    """Groups whose members mostly don't reach one another: each is an edit of the one before."""
    rng = random.Random(5)
    rows = []
    for g in range(3):
        words = [f"g{g}w{i}" for i in range(120)]
        for i in range(40):
            rows.append((len(rows) + 10 * g, " ".join(words)))
            words = list(words)
            at = rng.randrange(110)
            words[at : at + 2] = [f"n{rng.random()}"]
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()}
    assert got == near_components(rows)


def test_near_dedup_of_repeated_ids(spark):
    """Each row's set keeps its own links, though its doc_id has a copy of another document too."""
    rng = random.Random(3)
    base = {k: [f"{k}{i}" for i in range(80)] for k in "abcdef"}

    def edited(k):
        w = list(base[k])
        w[rng.randrange(80)] = "edited"
        return " ".join(w)

    text = {k: " ".join(w) for k, w in base.items()}
    rows = [(1, text["a"]), (5, text["a"]), (5, text["b"]), (7, text["b"]), (9, edited("b")), (12, edited("b"))]
    rows += [(20, text["c"]), (20, text["c"]), (21, edited("c")), (30, text["d"]), (31, text["d"]), (31, text["e"]), (32, edited("e")), (40, text["f"]), (41, None), (41, "")]
    sets = defaultdict(list)
    for d, t in rows:
        sets[d].append(shingles(t))
    root = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if any(x and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_dedup.near_duplicates(df).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((d, root[d]) for d, _ in rows)


def test_near_dedup_of_nothing(nothing):
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(a, a + 1) for a in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, 300)]
    more = [(0, 199), (30, 31), (59, 150), (150, 59), (400, 401), (401, 402), (250, 402), (20, 500), (-1, 500), (600, 600)]
    table = lambda links: spark.createDataFrame(links, "a long, b long")

    def solved(links):
        root = {x: x for e in links for x in e}
        for _ in range(200):
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    known = connected_components(table(links))
    assert {r[0]: r[1] for r in known.collect()} == solved(links)
    joined = join_components(known, table(more)).collect()
    want = solved(links + more)
    want.pop(600)  # linked with itself only: it stays its own component, without a row
    assert sorted(map(tuple, joined)) == sorted(want.items())
    assert sorted(map(tuple, join_components(known, table([])).collect())) == sorted(solved(links).items())


# --- language ID -----------------------------------------------------------------------------


def test_langid_held_out_accuracy(spark):
    out = langid.op3_langid(spark, DATA).toPandas()
    truth = duckdb.sql(f"SELECT doc_id, lang FROM '{DATA}/documents.parquet'").df()
    both = out.merge(truth, on="doc_id")
    assert both["held_out"].tolist() == [zlib.crc32(str(d).encode()) % 3 == 1 for d in both["doc_id"]]
    held = both[both["held_out"] & (both["lang_pred"] != "und")]
    assert (held["lang"] == held["lang_pred"]).mean() >= 0.95 and both["score"].between(0, 1).all()


def test_langid_edges(spark, docs, nothing):
    got = {r["doc_id"]: r for r in langid.identify(docs.withColumns({"score": F.lit("own"), "lang_pred": F.lit(1)})).collect()}
    assert [got[1000 + i]["lang_pred"] for i in (0, 1, 2, 9)] == ["und"] * 4
    assert langid.identify(nothing).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[-2:] for r in langid.identify(unlabelled).collect()] == [("und", 0.0)]


def test_langid_model_by_hand(spark):
    """Document frequencies, FTRL weights and temperature against plain loops; equal texts count once in the sample."""
    rng = random.Random(11)
    word = {"a": "abcde", "b": "defgh", "c": "xyzab"}
    text = lambda k: " ".join("".join(rng.choice(word[k]) for _ in range(rng.randint(2, 6))) for _ in range(12))
    rows = [(i, text(k), k) for i, k in enumerate("abc" * 20)] + [(None, "aaa bbb abc cab", "a")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.train(df, epochs=2)
    feats = {t: dict(zip(*(x.tolist() for x in langid.ngram_features(t)))) for _, t, _ in rows}
    n_df = Counter(f for _, t, _ in rows for f in feats[t])
    idf = lambda f: np.log((1 + len(rows)) / (1 + n_df[f])) + 1
    assert all(abs(model.idf[f] - idf(f)) < 1e-5 for f in list(n_df)[:200])
    grams_of = lambda t: Counter(g for n in (2, 3) for i in range(len(t) - n + 1) if (g := t[i : i + n]))
    assert sorted(feats[rows[0][1]].values()) == sorted(grams_of(" " + rows[0][1] + " ").values())
    place = {r["text"]: (r["h"], r["g"]) for r in df.select("text", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), F.col("text")).alias("g")).distinct().collect()}
    own = {k: sorted({t for _, t, x in rows if x == k}, key=place.__getitem__) for k in "abc"}
    aside = [(k, t) for k, ts in own.items() for t in ts[4::5]]
    own = {k: [t for i, t in enumerate(ts) if i % 5 != 4] for k, ts in own.items()}
    most = max(map(len, own.values()))
    shown = [(k, ts[i % len(ts)]) for k, ts in own.items() for i in range(most)]
    shown = [shown[i] for i in np.random.default_rng(0).permutation(len(shown))]
    z, n = defaultdict(lambda: [0.0] * 3), defaultdict(lambda: [0.0] * 3)

    def weight(f, c):
        if abs(z[f][c]) <= langid.L1:
            return 0.0
        return -(z[f][c] - np.sign(z[f][c]) * langid.L1) / ((langid.BETA + n[f][c] ** 0.5) / langid.ALPHA + langid.L2)

    def vector(t):
        v = {f: (1 + np.log(k)) * float(model.idf[f]) for f, k in feats[t].items()}
        size = sum(x * x for x in v.values()) ** 0.5
        return {f: x / size for f, x in v.items()}

    def logits(t):
        return np.array([sum(x * weight(f, c) for f, x in vector(t).items()) + weight("bias", c) for c in range(3)])

    for _ in range(2):
        for k, t in shown:
            v, w = vector(t) | {"bias": 1.0}, {}
            w = {f: [weight(f, c) for c in range(3)] for f in v}
            x = np.array([sum(v[f] * w[f][c] for f in v) for c in range(3)])
            p = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
            for f in v:
                for c in range(3):
                    g = v[f] * (p[c] - (c == "abc".index(k)))
                    z[f][c] += g - ((n[f][c] + g * g) ** 0.5 - n[f][c] ** 0.5) / langid.ALPHA * w[f][c]
                    n[f][c] += g * g
    for f in [*list(n_df)[:300]]:
        assert model.weights[f].tolist() == pytest.approx([weight(f, c) for c in range(3)], abs=1e-5)

    def loss(temperature):
        out = 0
        for k, t in aside:
            x = logits(t) / temperature
            q = np.full(3, 1 / (len(aside) + 2) / 2)
            q["abc".index(k)] = 1 - 1 / (len(aside) + 2)
            out += (np.log(np.exp(x - x.max()).sum()) + x.max()) - q @ x
        return out

    assert loss(model.temperature) <= min(loss(model.temperature * s) for s in (0.8, 0.95, 1.05, 1.25)) + 1e-9
    assert model.predict(rows[1][1])[0] == "b"


def test_langid_of_repeated_texts(spark):
    """One text repeated any number of times is a sample of one; a language of two texts is learnt beside a large one."""
    one = spark.createDataFrame([(i, "der hund und die katze", "de") for i in range(900)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify(one).collect()} == {"de"}
    rng = random.Random(5)
    english = ["the", "and", "with", "house", "there", "which", "thing", "walking", "of", "shall", "would", "they"]
    rows = [(i, " ".join(rng.choices(english, k=12)), "en") for i in range(1200)]
    rows += [(5000 + i, ("Über den Fluß zieht früh der Nebel.", "Schöne Grüße aus dem Süden, schrieb er.")[i % 2], "de") for i in range(2400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = langid.identify(df).groupBy("lang", "lang_pred").count().collect()
    assert all(r["lang"] == r["lang_pred"] for r in got) and len(got) == 2
    sample = langid.sampled(df, 50).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in sample} == {"en": 50, "de": 2}
    assert langid.accepted(df).where("lang = 'de'").count() == 2400


def test_langid_sample_with_long_texts(spark):
    rows = [(1, "ein Haus " * 300_000, "de"), (2, "a house " * 300_000, "en"), (3, "", "en"), (4, "12 34", "de")]
    rows += [(i, *(("a house of the king", "en"), ("ein Haus des Königs", "de"))[i % 2]) for i in range(10, 30)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[1] == "de" and got[2] == "en" and got[3] == got[4] == "und"


# --- tokens and packing ----------------------------------------------------------------------


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name, rows):
    enc = TextEncoder(public_tokenizers.path(name))
    assert enc.ids != enc._whole
    rng = random.Random(1)
    bits = ["a", "B", "c", "the", " ", "  ", "\n", "\t", "'s", "'re", "'", "1", "23", ".", "é", "É", "ñ", "ß", "Σ", "İ", "Ⱥ", "\u0301", "日本", "😀", "\xa0", "\x1c", "\x85", "<|endoftext|>", "²", "½", "ſ", "ﬁ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [t for _, t in rows[:60] if t]
    assert [t for t in texts if enc.ids(t) != enc._whole(t)] == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_added_tokens_in_texts(spark, name):
    path = public_tokenizers.path(name)
    enc, tok = TextEncoder(path), Tokenizer.from_file(path)
    rng = random.Random(4)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "<|", "|>", "foo", " bar", " ", "  ", "\n", "É", "e\u0301", "\u0338", "日本", "\x1c", "'s", "7"]
    texts = ["foo <|endoftext|> bar", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(2000))]
    want = {t: tok.encode(t, add_special_tokens=False).ids for t in texts}
    assert tok.token_to_id("<|endoftext|>") in want[texts[0]]
    assert [t for t in texts if np.frombuffer(enc.ids(t), enc.dtype).tolist() != want[t]] == []
    df = spark.createDataFrame(list(enumerate(texts[:40])), "doc_id long, text string")
    files = token_files.read_token_files(spark, token_files.write_token_files(df, path, 1)).collect()
    packed = packing.pack(df, path).where("start = 0").collect()
    for i, t in enumerate(texts[:40]):
        assert [r["n_tokens"] for r in files if r["doc_id"] == i] == [len(want[t]) + 1] == [r["doc_tokens"] for r in packed if r["doc_id"] == i]
        assert [r["ids_crc32"] for r in files if r["doc_id"] == i] == [zlib.crc32(np.array([*want[t], 1], "<u4").tobytes())]


def test_token_files(spark, docs, rows, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, at, want = Tokenizer.from_file(path), 0, []
    for d, t in sorted(rows, key=lambda r: r[0]):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    files = token_files.write_token_files(docs, path, 1)
    assert sorted(map(tuple, token_files.read_token_files(spark, files).collect())) == want
    assert token_files.read_token_files(spark, token_files.write_token_files(nothing, path, 1)).count() == 0


def test_packing(docs, rows, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, ids = Tokenizer.from_file(path), {}
    for d, t in rows:
        ids[d] = tok.encode(t or "", add_special_tokens=False).ids + [0]
    pieces = packing.pack(docs, path, with_ids=True).cache()
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for p in pieces.collect():
        by_doc[p["doc_id"]].append(p)
        by_window[p["sequence_id"]].append(p)
    for d, own in ids.items():
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p["start"]):
            part = own[at : at + p["length"]]
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(own), zlib.crc32(np.array(part, "<u4").tobytes()))
            assert np.frombuffer(p["ids"], "<u2").tolist() == part
            at += p["length"]
        assert at == len(own)
    for s, own in by_window.items():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 1024 or s == max(by_window) and 0 < at <= 1024
    assert {len(r["ids"]) // 2 for r in packing.sequences(pieces).where(f"sequence_id < {max(by_window)}").collect()} == {1024}
    assert packing.pack(nothing, path).count() == 0


# --- quality ---------------------------------------------------------------------------------


def test_quality(docs, rows, nothing):
    got = {r["doc_id"]: r for r in quality.quality_report(docs).collect()}
    for d, t in rows:
        t = t or ""
        w, r = WORD.findall(t), got[d]
        n = len(w)

        def repeated(k):
            c, cover = Counter(tuple(w[i : i + k]) for i in range(n - k + 1)), [False] * n
            for i in range(n - k + 1):
                if c[tuple(w[i : i + k])] > 1:
                    cover[i : i + k] = [True] * k
            return sum(cover)

        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        base = n < 50 or 100 * repeated(3) > 50 * n
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup)
        assert (r["n_repeat_words"], r["base_failed"], r["repeat_covered"]) == (repeated(3), base, repeated(quality.MIN_REPEAT))
        longest = next((k for k in range(1, n + 1) if k > 60 or not repeated(k)), n + 1) - 1
        assert min(r["repeat_longest"], 60) == min(longest, 60)
        assert r["kept"] == (not base and r["repeat_covered"] <= quality.MAX_COVERED * n and r["repeat_longest"] <= quality.MAX_LONGEST)
    assert quality.quality_report(nothing).count() == 0


def test_quality_texts_that_only_repetition_rejects(spark):
    """A passage of 60 words standing twice in 1,000, and passages of 6 words that cover 45 %, pass the base rules."""
    fresh = iter(f"w{i}" for i in range(10**6))
    take = lambda n: [next(fresh) for _ in range(n)]
    long, short = take(60), [take(6) for _ in range(20)]
    texts = {
        1: take(400) + long + take(400) + long + take(80),
        2: [w for s in short for w in s + take(7)] + [w for s in short for w in s + take(7)],
        3: take(400) + long[:50] + take(400) + long[:50] + take(80),
        4: take(1000),
    }
    got = {r["doc_id"]: r for r in quality.quality_report(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")).collect()}
    assert [got[i]["base_failed"] for i in texts] == [False] * 4 and [got[i]["kept"] for i in texts] == [False, False, True, True]
    assert got[1]["repeat_longest"] == 60 and got[2]["repeat_covered"] == 240 > quality.MAX_COVERED * got[2]["n_words"]


@pytest.mark.parametrize("alphabet", [1, 2, 3, 50])
def test_repeats_of_long_texts_by_a_walk(monkeypatch, alphabet):
    """Above LONG the common prefixes come another way; both give the same lengths."""
    rng = np.random.default_rng(alphabet)
    words, doc = rng.integers(0, alphabet, 700), np.sort(rng.integers(0, 4, 700))
    want = quality.longest_repeats(words, doc)
    monkeypatch.setattr(quality, "LONG", 10)
    assert quality.longest_repeats(words, doc).tolist() == want.tolist()
    monkeypatch.setattr(quality, "PIECE", 4)
    number: dict = {}
    text = b"ab \x0b cde\tab\xc2\xa0 f  " * 5
    assert quality.word_numbers(text, number).tolist() == [{w: i for i, w in enumerate(dict.fromkeys(text.split()))}[w] for w in text.split()]


# --- lines -----------------------------------------------------------------------------------


def test_line_dedup(spark, nothing):
    rng = random.Random(8)
    pool = [("Line number %d of the common pool, quite long " % i) * 2 for i in range(30)] + ["short", "é" * 39, "é" * 40, "  É padded line that has forty characters or more \t"]
    texts = ["\n".join(rng.choice(pool).upper() if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "\n"), (903, "\n".join(pool * 3))]
    key = lambda s: lower(s.strip(" \t\n\x0b\x0c\r"))
    where = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                where[key(line)].add(d)
    df = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, h1 int").withColumn("n_lines", F.lit("own"))
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(where[key(x)]) < 5 or max(where[key(x)]) == d]
        assert (got[d]["n_lines"], got[d]["n_dropped"]) == (len(lines), len(lines) - len(kept))
        assert got[d]["kept_sha256"] == hashlib.sha256("\n".join(kept).encode()).hexdigest()
        assert (got[d]["text"] or "") == "\n".join(kept) and got[d]["h1"] == 7
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_line_dedup_of_repeated_ids(spark):
    """Rows are documents: equal ids share the kept copy, a null ranks below all; as the SQL says."""
    line = ["The first of the lines that are long enough to count here", "Another of the lines that are long enough to count here too"]
    rows = [(1, line[0])] * 3 + [(2, line[0]), (2, f"{line[0]}\n{line[1]}"), (None, line[1]), (None, line[1]), (None, line[1]), (None, line[1]), (3, "short")]
    documents = spark.createDataFrame(rows, "doc_id long, text string").toPandas().astype({"doc_id": "Int64"})
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    con = duckdb.connect()
    con.register("documents", documents)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.execute(line_dedup.SQL["op9_line_dedup"]).fetchall()))
    assert sum(r["n_dropped"] for r in got) == 3 + 4


def test_shard_of_equal_first_halves(tmp_path):
    """Hashes that share a half, counts below and above the limit, and absent keys."""
    rng = np.random.default_rng(1)
    h1, h2 = (rng.integers(0, 1 << 63, 3000, dtype=np.uint64) for _ in range(2))
    h1[:50] = h1[50:100]
    n, keep = rng.integers(1, 9, 3000).astype(np.uint64), rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    (tmp_path / "s").write_bytes(line_dedup.shard_bytes(h1[:2000], h2[:2000], n[:2000], keep[:2000], 5))
    count, kept = line_dedup.Shard(str(tmp_path / "s")).probe(h1, h2)
    assert count[:2000].tolist() == n[:2000].tolist() and not count[2000:].any()
    often = n[:2000] >= 5
    assert kept[:2000][often].tolist() == keep[:2000][often].tolist()


def test_key_index(spark):
    rng = random.Random(3)
    keys = sorted({rng.randrange(-(1 << 63), 1 << 63) for _ in range(5000)})
    index = index_keys(spark.createDataFrame([(k,) for k in keys[::2]], "k long"))
    assert index.contains(np.array(keys)).tolist() == [i % 2 == 0 for i in range(len(keys))]


# --- benchmark -------------------------------------------------------------------------------


def test_decontaminate(spark, nothing, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 5, 12, 20, 20, 41, 60, 60])] + [(50, None), (51, " ... "), (52, "Same, same same. same same same")]
    docs = []
    for i in range(80):
        body = [word() for _ in range(rng.randint(0, 90))]
        item = items[rng.randrange(8)][1].split()
        if i % 2:
            for _ in range(rng.randrange(3)):
                item[rng.randrange(len(item))] = word()
            at = rng.randint(0, len(body))
            body[at:at] = item
        docs.append((i, " ".join(body) if i % 7 else " ".join(body).upper() + "!"))
    docs += [(100, None), (101, ""), (102, items[5][1]), (103, items[5][1] + " " + items[5][1])]
    W = lambda t: decontaminate._WORD.findall((t or "").lower())
    grams = lambda w: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    own = {i: W(t) for i, t in items if W(t)}
    want = {}
    for d, t in docs:
        w = W(t)
        for i, item in own.items():
            n = min(len(item), len(w))
            for k in range(len(w) - n + 1 if n else 0):
                a, b = grams(item), grams(w[k : k + n])
                s = (a & b).total() / (a | b).total()
                if s >= 0.75 - 1e-12:
                    want[d, i] = max(s, want.get((d, i), 0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = spark.createDataFrame(docs, "doc_id long, text string")
    found = lambda: {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(texts, bench).collect()}
    assert found() == pytest.approx(want)
    # Blocks of one or two items, more of them than there are bits to tell them apart.
    monkeypatch.setattr(decontaminate, "ITEMS", 2)
    monkeypatch.setattr(decontaminate, "MASK_BITS", 3)
    assert found() == pytest.approx(want)
    assert decontaminate.contaminated(nothing, bench).count() == 0
    assert decontaminate.contaminated(texts, bench.where("item_id < 0")).count() == 0
    assert decontaminate.contaminated(texts, bench.where("item_id = 51")).count() == 0
    assert decontaminate.contaminated(nothing, bench.where("item_id < 0")).count() == 0


def test_decontaminate_repeated_items(spark, monkeypatch):
    """Items held several times, or made from a template, catch edited copies in any number of blocks."""
    rng = random.Random(9)
    fresh = iter(range(10_000))
    words = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    twice, thrice, lone, frame = words(45), words(60), words(20), words(50)
    filled = [frame[:25] + words(3) + frame[25:] for _ in range(6)]
    items = [(0, twice), (1, twice), (2, thrice), (3, thrice), (4, thrice), (5, lone), *enumerate(filled, 6)]
    docs = []
    for _, item in items:
        edited = list(item)
        edited[len(edited) // 2] = "edited"
        docs.append((len(docs), words(rng.randrange(40)) + edited + words(30)))
    docs.append((len(docs), words(200)))
    grams = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    want = {}
    for d, w in docs:
        for i, item in items:
            a = grams(item)
            for k in range(len(w) - len(item) + 1):
                b = grams(w[k : k + len(item)])
                s = (a & b).total() / (a | b).total()
                if s >= 0.75:
                    want[d, i] = max(s, want.get((d, i), 0))
    assert {(0, 0), (0, 1), (2, 3), (4, 4)} <= set(want)
    text = lambda rows: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    bench = text(items).withColumnRenamed("doc_id", "item_id")
    for size in (decontaminate.ITEMS, 3):
        monkeypatch.setattr(decontaminate, "ITEMS", size)
        got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(text(docs), bench).collect()}
        assert got == pytest.approx(want)


def session_like(master, conf=None, given=None):
    """As much of a session as shared_dir reads, and a list of the checkpoint folders it sets."""
    was_set = []
    folder = SimpleNamespace(isDefined=lambda: given is not None, get=lambda: given)
    java = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: folder))
    context = SimpleNamespace(master=master, _jsc=java, setCheckpointDir=was_set.append)
    return SimpleNamespace(conf=conf or {}, sparkContext=context), was_set


def test_shared_dir_needs_a_shared_folder_on_clusters():
    for master in ("yarn", "spark://host:7077", "k8s://https://host", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session_like(master)[0], "x")
        assert shared_dir(session_like(master, {"spark.checkpoint.dir": "hdfs://a/b/"})[0], "x").startswith("hdfs://a/b/x-")
        assert shared_dir(session_like(master, given="hdfs://a/c")[0], "x").startswith("hdfs://a/c/x-")
    for master in ("local", "local[8]"):
        session, was_set = session_like(master)
        assert shared_dir(session, "x").startswith(was_set[0])
