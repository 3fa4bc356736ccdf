"""URL verdicts, archives and the whole pipeline."""

import base64
import gzip
import hashlib
import io
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quadgrid.llm import decontaminate, langid, url_filter, warc
from quadgrid.llm.common import cut

DATA = "/root/testdata/sf0.001"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_url_rules_and_list(spark, monkeypatch):
    urls = [
        "http://a.COM/en/x",
        "http://a.example.com/en/7?q",
        "http://example.net/de/81",
        "http://example.net/de/9",
        "http://org/es/1#top",
        "http://myorg/es/1",
        "http://WWW.listed.io/a/?utm_source=feed",
        "https://listed.io/a",
        "http://listed.io/b",
        "no scheme",
        "",
        None,
        "x://",
        "http://h\n.io/p",
    ]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, block int").withColumns({"w0": F.lit(1), "_block": F.lit(2), "host": F.lit("own"), "listed": F.lit(3)})
    listed = spark.createDataFrame([("listed.io/a",), ("listed.io/a",), (None,)], "canonical string")
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in url_filter.url_verdicts(pages, listed).collect()}
    assert [got[i][1] for i in range(6)] == ["com/en/", "example.com/en/7", "example.net/de/8", "net/de/", "org/es/", None]
    assert [got[i][2] for i in range(len(urls))] == ["block", "allow", "block", "allow", "block", "allow", "block", "block"] + ["allow"] * 6
    assert got[9][0] == got[11][0] == ""
    out = url_filter.url_verdicts(pages, listed)
    assert sorted(out.columns) == ["_block", "block", "host", "listed", "page_id", "path", "rule", "url", "verdict", "w0"]
    assert out.where("block = 1 AND w0 = 1 AND _block = 2").count() == len(urls)
    assert url_filter.url_verdicts(pages.limit(0), listed.limit(0)).count() == 0
    # A filter too large to broadcast gives the same.
    monkeypatch.setattr(url_filter, "BROADCAST_BLOCKS", 0)
    assert sorted(map(repr, url_filter.url_verdicts(pages, listed).collect())) == sorted(map(repr, out.collect()))


def test_bloom_filter_loses_nothing(spark):
    keys = spark.range(5000).selectExpr("concat('host', id, '.io/p') AS canonical")
    pages = spark.range(10000).selectExpr("id AS page_id", "concat('http://host', id, '.io/p') AS url")
    assert url_filter.url_verdicts(pages, keys).where("listed <> (page_id < 5000)").count() == 0


def test_archives(spark, tmp_path):
    payloads = ["x", "y" * 100_000, None, "", "é\r\n\r\nWARC/1.1", "<html>&</html>"]
    rng = random.Random(1)
    rows = [(i, f"http://A.b.com/{i % 7}?q#f" if i % 5 else None, rng.choice(payloads)) for i in range(200)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r for r in warc.op8_warc(spark, str(tmp_path)).collect()}
    last = {}
    for i, _, h in rows:
        last[h or ""] = i
    order = [i for _, i in sorted((warc.url_key(u), i) for i, u, _ in rows)]
    for i, _, h in rows:
        raw, r = (h or "").encode(), got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if last[h or ""] == i else ("revisit", last[h or ""]))
        assert order[r["index_pos"]] == i
    runs = warc.write_archives(spark.read.parquet(str(tmp_path / "pages.parquet")))
    back = {r["page_id"]: r["payload"] for r in warc.read_archives(runs, with_payload=True).collect()}
    assert all(bytes(back[i]) == (h or "").encode() for i, _, h in rows if got[i]["record_type"] == "response")
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


@pytest.mark.parametrize("fan_in, range_entries", [(256, 100_000), (3, 70), (2, 1)])
def test_index_merge(spark, fan_in, range_entries):
    """Many runs with ties, merged in several passes and ranges, give one order."""
    rng = random.Random(fan_in)
    rows = [(rng.choice([None, *range(900)]), rng.choice([None, "http://b.a/x", "http://c.a/", f"http://h{rng.randrange(99)}.a/p"]), "p" * rng.randrange(3)) for _ in range(1300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    runs = warc.write_archives(df, run_entries=60)
    assert runs.count() >= 20 and warc.fewer_runs(runs, fan_in).count() <= fan_in
    got = sorted(warc.merge_runs(runs, fan_in, range_entries).collect(), key=lambda r: r["index_pos"])
    assert [r["index_pos"] for r in got] == list(range(len(rows)))
    key = lambda r: (r["urlkey"], r["ts"], -1 if r["page_id"] is None else r["page_id"], r["file"], r["at"])
    assert list(map(key, got)) == sorted(map(key, got))
    assert Counter((r["urlkey"], r["page_id"]) for r in got) == Counter((warc.url_key(u), i) for i, u, _ in rows)


def test_members_of_a_stream():
    parts = [random.Random(i).randbytes(n) for i, n in enumerate([0, 1, 70_000, 5, 300_000, 40])]
    packed = [gzip.compress(p) for p in parts]
    for read, step in ((4 << 20, 1 << 15), (1000, 7), (33, 64)):
        found = list(warc.members(io.BytesIO(b"".join(packed)), read, step))
        assert [raw for _, raw in found] == parts and [at for at, _ in found] == [sum(map(len, packed[:i])) for i in range(len(parts))]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(packed[2][:-9])))


def test_repeated_page_rows(spark):
    df = spark.createDataFrame([(1, "http://a/", "p"), (1, "http://a/", "p"), (2, "http://a/", "p"), (None, None, "q")], "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in warc.read_archives(warc.write_archives(df)).collect())
    assert got == [(0, "response", None), (1, "revisit", 2), (1, "revisit", 2), (2, "response", None)]


@pytest.mark.parametrize("k", [1, 2, 3, 7, 16])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(9))) for _ in range(k)]
    assert [x for _, x in warc.LoserTree(runs)] == sorted(x for r in runs for x in r)


def brute_lines(rows):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    where = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        for k in {key(x) for x in t.split("\n")}:
            if len(k) >= 40:
                where[k].append(-1 if d is None else d)
    keep = lambda d, x: len(where[key(x)]) < 5 or max(where[key(x)]) == (-1 if d is None else d)
    return [(d, "\n".join(x for x in t.split("\n") if keep(d, x))) for d, t in rows]


def grams(words):
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()


def brute_near(rows):
    """Rows left when each component of ids keeps its smallest id, and equal rows one."""
    sets = defaultdict(list)
    for d, t in rows:
        if d is not None:
            sets[d].append(set(grams(re.findall(r"[^\x20\x09-\x0D]+", lower(t)))))
    root = {d: d for d in sets}
    for _ in range(20):
        for a, b in combinations(sorted(sets), 2):
            if any(x and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    return [r for r in rows if r[0] is None] + sorted({r for r in rows if r[0] is not None and root[r[0]] == r[0]})


def brute_clean(rows, items):
    W = lambda t: decontaminate._WORD.findall(t.lower())
    out = []
    for d, t in rows:
        w = W(t)
        every = grams(w)
        for item in filter(None, map(W, items)):
            n = min(len(item), len(w))
            a = grams(item)
            if min(len(item), n) >= 5 and not a.keys() & every.keys():
                continue
            if any((a & b).total() >= 0.75 * (a | b).total() for k in range(len(w) - n + 1) if n and (b := grams(w[k : k + n]))):
                break
        else:
            out.append((d, t))
    return out


def test_pipeline_stages_match_brute_force(spark):
    """Every stage on the rows that the one before kept, with awkward rows and clashing columns."""
    texts = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 70").select("doc_id", "text").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rng = random.Random(7)
    line = "A common line that is long enough to count as one of those that repeat "
    extra = [None, "", "  ", "12 34 !?", "z" * 300, texts[0][1], texts[0][1] + " and so on", items[0], items[1] + " tail", *(f"{line}\n{texts[i][1][:300]}" for i in range(20, 27))]
    rows = texts + [(1000 + i, t) for i, t in enumerate(extra)] + [(None, items[2]), (None, texts[5][1]), (1005, texts[9][1] + " other"), (1005, texts[0][1])]
    rng.shuffle(rows)
    lang = dict(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect())
    clash = "score double, lang_pred int, n_lines int, _key int, key int, band int, component int, h1 int, spans int"
    df = spark.createDataFrame([(d, t, lang.get(d), "s", len(t or ""), *[0.5, 1, 2, 3, 4, 5, 6, 7, 8]) for d, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {clash}").repartition(3)
    names = df.columns
    model = langid.train(langid.learning_rows(df))
    sure = lambda t: (p := model.predict(t))[0] != langid.UNKNOWN and p[1] >= langid.MIN_SCORE
    order = lambda rs: sorted(map(tuple, rs), key=repr)
    brute = {
        "language_id": lambda rs: [r for r in rs if sure(r[1])],
        "line_dedup": brute_lines,
        "near_dedup": brute_near,
        "decontaminate": lambda rs: brute_clean(rs, items),
    }
    held = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = cut(stage(spark, df, DATA), f"test-{name}")
        assert df.columns == names
        want, held = brute[name](held), [(r["doc_id"], r["text"]) for r in df.collect()]
        assert order(held) == order(want), name
        assert df.where("n_chars <> length(text) OR _key <> 3 OR score <> 0.5").count() == 0
    assert 50 <= len(held) < len(rows) - 12 and (None, texts[5][1]) in held and (None, items[2]) not in held
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.STAGES[-1][1](spark, df, DATA).collect()
    got = defaultdict(list)
    for p in pieces:
        got[p["sequence_id"]].append(p)
    flat = [p for s in sorted(got) for p in sorted(got[s], key=lambda p: p["offset"])]
    ids = [x for p in flat for x in np.frombuffer(p["ids"], "<u2").tolist()]
    docs, at = [], 0
    for i, x in enumerate(ids):
        if x == 0:
            docs.append(tuple(ids[at:i]))
            at = i + 1
    assert at == len(ids) and sorted(docs) == sorted(tuple(tok.encode(t, add_special_tokens=False).ids) for _, t in held)


def test_pipeline_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, DATA)
    n = duckdb.sql(f"SELECT count(*) FROM '{DATA}/documents.parquet' WHERE regexp_matches(text, '\\p{{L}}')").fetchall()[0][0]
    assert kept.count() >= 0.99 * n
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_id(spark, unlabelled, DATA).count() == n


def test_pipeline_keeps_one_of_equal_rows(spark):
    text = [" ".join(f"{k}{i}" for i in range(40)) for k in "abc"]
    rows = [(1, text[0]), (1, text[0]), (1, text[1]), (2, text[2]), (2, text[2]), (3, text[2]), (None, text[0]), (None, text[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_dedup_stage(spark, df, DATA).collect()
    assert sorted(got, key=str) == sorted([rows[0], rows[2], rows[3], rows[6], rows[7]], key=lambda r: f"Row(doc_id={r[0]}, text={r[1]!r})")


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, DATA), f"empty-{name}")
    assert docs.count() == 0
