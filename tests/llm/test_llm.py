"""Each operator against a brute-force version: nulls, empty texts, ties, repeats, clashing names."""

from __future__ import annotations

import base64
import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter
from urllib.parse import urlparse

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tests.oracle import compare, connect
from tidewell.llm import bpe, jaccard, lines, mixing, queries, sharding, suffixes, topk, toxicity, url_rules, vptree
from tidewell.llm.common import components, numbered, stage

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, mark int"


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(5)
    words = [pick.choice("aeiou") + pick.choice(["rt", "nd", "ß", "é", "lm"]) * pick.randint(1, 3) for _ in range(400)]

    def prose(n):
        return " ".join(pick.choice(words) for _ in range(n))

    base = [prose(pick.randint(30, 120)) for _ in range(12)]
    texts = [None, None, "", "", " \t\n", "x", "One two", "a\nb\na\nb", "naïve café 😀 !!  \r\n  ok", "ab" * 300, " " * 150]
    for text in base:
        parts = text.split(" ")
        texts += [text, text, text.upper() if pick.random() < 0.2 else text + " end"]
        for _ in range(3):
            near = list(parts)
            near[pick.randrange(len(near))] = "zzz"
            texts.append(" ".join(near))
        texts.append(prose(20) + "\n" + text + "\n" + prose(20))
    texts.append(prose(6000))
    out = [(k, t, "en", pick.choice(["b", "a", None, "ä", "c"]), len(t or ""), 1, "s", 2) for k, t in enumerate(texts)]
    out += [out[20], out[20], out[2], (None, base[0], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return stage(spark.createDataFrame(rows, SCHEMA).repartition(3), "test-docs")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF_DIR}/labels.parquet")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_numbered_is_gapless_with_ties(spark):
    frame = spark.createDataFrame([(k % 3, k) for k in range(50)] + [(None, 1)] * 4, "a int, b int")
    got = numbered(frame, ["a", "b"], "n").orderBy("at").collect()
    assert [r["at"] for r in got] == list(range(54))
    assert [r["a"] for r in got] == [None] * 4 + sorted(k % 3 for k in range(50))


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "c").collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((90, 95, 100), 90), 200: 200, 201: 200}


def _least_capacity(sizes, shards):
    low = max(sizes)
    while True:
        used, room = 1, low
        for s in sizes:
            if s > room:
                used, room = used + 1, low
            room -= s
        if used <= shards:
            return low
        low += 1


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_sharding(docs, rows, shards):
    got = sharding.shard(docs, shards).collect()
    assert len(got) == len(rows)
    groups: dict[str, list] = {}
    for r in rows:
        g = groups.setdefault(r[1] or "", [None, 0])
        g[0] = r[0] if g[0] is None else (g[0] if r[0] is None else min(g[0], r[0]))
        g[1] += len((r[1] or "").encode()) + 8
    sizes = [g[1] for g in sorted(groups.values(), key=lambda g: (g[0] is not None, g[0]))]
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert got[0]["capacity"] == _least_capacity(sizes, shards) >= max(load.values())
    for shard in load:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    by_crc = {}
    for r in got:
        assert by_crc.setdefault((r["text_crc32"], r["size"]), r["shard"]) == r["shard"]
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_minimax_cuts_refines_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCKS", 5)
    monkeypatch.setattr(sharding, "FAN_OUT", 2)
    pick = random.Random(3)
    sizes = [pick.choice([1, 2, 5, 90]) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(sizes)), "at long, bytes long")
    capacity, cuts = sharding.minimax_cuts(frame, 7)
    assert capacity == _least_capacity(sizes, 7)
    parts = np.split(np.array(sizes), cuts)
    assert max(p.sum() for p in parts) == capacity and min(p.sum() for p in parts) > 0.7 * capacity


def test_bpe(docs, rows):
    ranks = bpe.ranks(public_tokenizers.path(bpe.VOCABULARY))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.decode(bpe.encode(docs)).collect()
    want = Counter((r[0], tuple(plain.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in rows)
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got) == want


def test_bpe_long_and_odd_pieces():
    coder = bpe.encoder(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    pick = random.Random(1)
    for text in ["e" * 5000, "the" * 900, "<|endoftext|>", "\u200d\u0301" * 40, "".join(pick.choice("etaoins ") for _ in range(4000))] + [
        "".join(chr(pick.choice([pick.randrange(32, 127), pick.randrange(160, 0xD7FF), pick.randrange(0x1F300, 0x1F600)])) for _ in range(80)) for _ in range(60)
    ]:
        assert coder.encode(text).tolist() == plain.encode_ordinary(text)


def test_lexicon_automaton():
    automaton = toxicity.LexiconAutomaton({"moron": 1.0, "scum": 0.9, "vequ*": 0.5, "stupid": 0.7})
    for word, weight in {"moron": 1.0, "mroon": 0.8, "morn": 0.8, "morron": 0.8, "mxron": 0.8, "mxrxn": 0.0, "scum": 0.9,
                         "scam": 0.0, "vequabc": 0.5, "veq": 0.0, "stupidly": 0.0, "stupidd": 0.56, "": 0.0}.items():
        assert automaton.weight(word) == pytest.approx(weight), word


def test_misspelled_stems_and_short_terms():
    automaton = toxicity.LexiconAutomaton({"réeuxa*": 1.0, "réeuxabc": 0.5, "vequ*": 0.6, "scum": 0.9, "as": 0.3})
    for word, weight in {"réeuxan": 1.0, "reeuxan": 0.8, "réuexan": 0.8, "réexan": 0.8, "réeeuxan": 0.8, "rzzuxan": 0.0,
                         "réeux": 0.0, "réeuxon": 0.0, "réeuxbc": 0.4, "réeuxabd": 1.0, "vveque": 0.48, "evque": 0.48,
                         "vaque": 0.0, "scumm": 0.72, "sccum": 0.72, "csum": 0.72, "scums": 0.0, "sum": 0.0, "sa": 0.24}.items():
        assert automaton.weight(word) == pytest.approx(weight), word


def test_words_covered_by_a_stem_stay_terms(spark):
    words = ["vequabc", "vequxyz", "vequmno", "vequrst"]
    rows = [(f"plain text {words[k % 4]} here", 1) for k in range(40)] + [("plain text without here", 0)] * 400
    rows += [("plain text vequxya here", 0)] * 4
    terms, known = toxicity._learn_terms(spark.createDataFrame(rows, "text string, toxic int"))
    assert {*words} <= set(terms) and known == {"vequxya"}
    automaton = toxicity.LexiconAutomaton(terms, known)
    assert automaton.weight("vaquabc") > 0 and automaton.weight("vequxya") == terms.get("vequ*", 0.0)


def test_rare_terms_stay_beside_many_frequent_ones(spark):
    words = [f"{a}{b}zzqqxxyy" for a in "abcdefghij" for b in "klmnopqrst"]
    rows = [(w, 1) for w in words for _ in range(5)] + [("rareword", 1)] * 4 + [("plain", 0)] * 2000
    terms, _ = toxicity._learn_terms(spark.createDataFrame(rows, "text string, toxic int"))
    assert {*words, "rareword"} <= set(terms)


def test_quotation_weighs_less():
    model = toxicity.Model({"moron": 1.0})
    abuse = model.features("you are a moron and you know it")
    quoted = model.features('the letter said "you moron" and was withdrawn')
    assert abuse[0] == 1 and quoted[0] < 0.3 < quoted[1]
    assert model.features(None) == model.features("") == (0.0, 0.0, 0.0)


def test_toxicity_held_out(spark, docs, none, labels, rows):
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    all_labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.score(table, all_labels).join(all_labels, "doc_id").filter("held_out").toPandas()
    toxic = got[got.toxic == 1]
    assert (got.predicted == got.toxic).mean() > 0.98 and toxic.predicted.mean() > 0.9
    odd = toxicity.score(docs, labels).collect()
    assert len(odd) == len(rows) and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["doc_id"]: r["held_out"] for r in odd if r["doc_id"] is not None} == {
        r[0]: zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in rows if r[0] is not None
    }
    assert toxicity.score(none, labels).count() == 0
    assert {r["predicted"] for r in toxicity.score(docs, labels.limit(0)).collect()} == {0}


def _vectors(spark):
    pick = np.random.default_rng(2)
    data = [(int(k), [float(x) for x in pick.normal(size=8)], 1) for k in range(0, 600)]
    data += [(700, None, 1), (800, [None] * 8, 1), (900, [float("nan")] * 8, 1), (1000, [float("inf")] * 8, 1), (1100, [0.0] * 8, 1), (1200, [1.0], 1), (None, [1.0] * 8, 1)]
    data += [(1300, data[5][1], 1), (1301, data[5][1], 1), (1302, data[5][1], 1), (100, data[100][1], 1)]
    return data, spark.createDataFrame(data, "vec_id long, embedding array<float>, score int")


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 200)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    data, frame = _vectors(spark)
    good = [(i, np.floor(np.float32(v).astype(float) * 1024).astype(int)) for i, v, _ in data if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for i, v in good:
        if i % 100 == 0:
            want[i] = sorted(((-int(v @ w), j) for j, w in good if j != i))[:10]
    got: dict = {}
    for r in topk.top_k(frame).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (-r["score"], r["vec_id"])
    assert {q: [g[k] for k in sorted(g)] for q, g in got.items()} == want
    assert topk.top_k(frame.limit(0)).count() == 0


def test_vantage_point_tree(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD", 250)
    data, frame = _vectors(spark)
    good = [(i, np.float32(v).astype(float)) for i, v, _ in data if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    want = {i: sorted((-float(v @ w), j) for j, w in good if j != i)[:20] for i, v in good if i % 20 == 0}
    for factor, least in ((1.0, 1.0), (vptree.FACTOR, 0.9)):
        got: dict = {}
        for r in vptree.nearest(frame, factor=factor).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
            assert r["rank"] <= 20
        hits = [len(got[q] & {j for _, j in w}) / len({j for _, j in w}) for q, w in want.items()]
        assert set(got) == set(want) and np.mean(hits) >= least
    assert vptree.nearest(frame.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [40, 16_384])
def test_vantage_point_tree_copies(spark, monkeypatch, shard):
    """Of equally near vectors the smaller ids are found."""
    monkeypatch.setattr(vptree, "SHARD", shard)
    pick = np.random.default_rng(3)
    kinds = [[float(x) for x in pick.normal(size=8)] for _ in range(4)]
    data = [(int(k), kinds[j % 4]) for j, k in enumerate(pick.permutation(400))]
    data += [(1000 + k, [float(x) for x in pick.normal(size=8)]) for k in range(100)] + [(40, kinds[0])] * 3
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in vptree.nearest(frame, factor=1.0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    good = [(i, np.float32(v).astype(float)) for i, v in data]
    asked = {i: v for i, v in reversed(good) if i % 20 == 0}
    for i in [i for i in asked if i != 40]:  # 40 has rows of its own that may differ
        want = sorted((-round(float(asked[i] @ w), 9), j) for j, w in good if j != i)[:20]
        assert [got[i][k] for k in sorted(got[i])] == [j for _, j in want]


def _brute_components(rows):
    sets = []
    for r in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    names: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            names[find(i)] = min(names.get(find(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), names.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)), find


@pytest.mark.parametrize("block", [2_048, 3])
def test_near_duplicates(docs, rows, none, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    want, find = _brute_components(rows)
    got = jaccard.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    if block == 3:
        empty = sum(not WORD.findall(r[1] or "") for r in rows)
        with_words = {find(i) for i, r in enumerate(rows) if WORD.findall(r[1] or "")}
        kept = jaccard.one_per_group(docs)
        assert kept.columns == docs.columns and kept.count() == len(with_words) + empty
        assert jaccard.near_duplicates(none).count() == 0


def test_chains_of_near_duplicates(spark, monkeypatch):
    """Texts that drift: neighbours link, the ends share nothing; some links are only found block by block."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 700)
    compared, plain = spark.sparkContext.accumulator(0), jaccard._compare

    def counted(table):
        asks = table.column("asks").to_pylist()
        compared.add(1)
        assert sum(asks) <= 16 and len(asks) - sum(asks) <= 16  # dealt by hash: about 4 of each
        return plain(table)

    monkeypatch.setattr(jaccard, "_compare", counted)
    pick = random.Random(11)
    words = [f"w{pick.randrange(10**6)}" for _ in range(900)]
    rows = [(k, " ".join(words[12 * k : 12 * k + 200])) for k in range(50)]
    rows += [(100 + k, " ".join(words[9 * k : 9 * k + 150] + [f"x{k}"] * 60)) for k in range(20)]
    pick.shuffle(rows)
    want, _ = _brute_components(rows)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert compared.value > 1


def test_url_rules(spark):
    urls = ["http://a.example.com/en/x", "http://WWW.example.com/en/", "https://m.www.example.com/en/1?q#f", "http://com/", "http://com", "http://x.net/es/1",
            "http://net/fr/", "http://xnet/fr/", "http://a.net/de/", None, "", "no scheme", "http://", "http://example.com?/en/", "http://example.org/en/", "x://a.b.com-x/", "http://com-x.com/a\nb"]
    pages = [(k % 5 or None, u, "h", "r") for k, u in enumerate(urls)] * 2
    frame = spark.createDataFrame(pages, "page_id long, url string, host string, rule string").repartition(4)
    rules = [*url_rules.RULES, (None, "/", "block"), ("", "", "allow")]

    def judge(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [(len(h) + len(p), h + p, v) for h, p, v in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[1:] if fit else (None, "allow")))

    got = Counter(tuple(r) for r in url_rules.judge(frame, url_rules.rule_table(spark, rules)).collect())
    assert got == Counter((p[0], *judge(p[1])) for p in pages)
    assert url_rules.judge(frame.limit(0), url_rules.rule_table(spark, rules)).count() == 0
    assert {r["verdict"] for r in url_rules.judge(frame, url_rules.rule_table(spark, rules).limit(0), "block").collect()} == {"block"}


def _brute_strings(rows):
    first: dict = {}
    order = [(2**63 - 1 if r[0] is None else r[0], (r[1] or "").encode(), r) for r in rows]
    for key, text, _ in order:
        for s in range(len(text) - 99):
            w = text[s : s + 100]
            first[w] = min(first.get(w, (key, s)), (key, s))
    out = []
    for key, text, r in order:
        gone = bytearray(len(text))
        for s in range(len(text) - 99):
            if first[text[s : s + 100]] < (key, s):
                gone[s : s + 100] = b"\1" * 100
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((r[0], len(text), sum(gone), spans, sha(kept)))
    return Counter(out)


def test_repeated_strings(docs, rows, none, monkeypatch):
    want = _brute_strings(rows)
    got = suffixes.repeated_strings(docs).drop("spans").collect()
    assert Counter(tuple(r) for r in got) == want
    assert sum(n * k[2] for k, n in want.items()) > 5000
    assert suffixes.repeated_strings(none).count() == 0


def test_carried_text_is_staged_once(spark, monkeypatch):
    pick = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 ."
    texts = ["".join(pick.choice(letters) for _ in range(3000)) for _ in range(40)]
    texts += [texts[0], texts[1][:1500] + texts[2][:1500], None, ""]
    rows = [(k, t, "en", "web", None if t is None else len(t), k % 3, "s", k) for k, t in enumerate(texts)]
    docs = stage(spark.createDataFrame(rows, SCHEMA).repartition(3), "test-carried")
    given = sum(os.path.getsize(urlparse(f).path) for f in docs.inputFiles())
    written = {}

    def measured(frame, label):
        out = stage(frame, label)
        written[label] = sum(os.path.getsize(urlparse(f).path) for f in out.inputFiles())
        return out

    monkeypatch.setattr(suffixes, "stage", measured)
    plain = {r["doc_id"]: r for r in suffixes.repeated_strings(docs).collect()}
    carried = suffixes.repeated_strings(docs, carry=True).collect()
    assert written["suffix-met"] < 1.3 * given
    assert {r["row"]["doc_id"]: tuple(r["row"]) for r in carried} == {r[0]: r for r in rows}
    assert {r["doc_id"]: r.asDict() for r in carried if r["row"]} == {
        k: r.asDict() | {"row": carried_row, "kept": kept}
        for k, r in plain.items()
        for carried_row, kept in [next((c["row"], c["kept"]) for c in carried if c["doc_id"] == k)]
    }
    assert sum(r["n_removed"] for r in plain.values()) >= 3000 + 1400


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    pick = random.Random(4)
    text = bytes(pick.choice(b"ab") for _ in range(3000))
    table = suffixes.pa.RecordBatch.from_arrays([suffixes.pa.array([1, 2]), suffixes.pa.array([text, text[500:]])], names=["key", "bytes"])
    monkeypatch.setattr(suffixes, "CHUNK", 700)

    def windows(batches):
        out = set()
        for b in batches:
            for k in range(b.num_rows):
                e = {c: suffixes.unpack([b.column(c)[k].as_py()], w) for c, w in suffixes.SIDE}
                for key, lo, hi in zip(e["key"].tolist(), e["lo"].tolist(), e["hi"].tolist(), strict=True):
                    out |= {(key, s) for s in range(lo, lo + hi + 1)}
        return out

    assert windows(suffixes._find([table], 3)) == {(1, s) for s in range(2901)} | {(2, s) for s in range(2401)}


def test_mixing(docs, rows, none):
    got = mixing.mix(docs).collect()
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        level = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and weight[s] * level > 3 * sizes[s]}
        if not more:
            break
        full |= more
    target = {s: min(3 * sizes[s], weight[s] * level) for s in order}
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    for s in order:
        mine = [r for r in got if r["source"] == s]
        assert {round(r["target"], 6) for r in mine} == {round(target[s], 6)} and mine[0]["source_size"] == sizes[s]
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= max(40, 0.02 * target[s])
    assert all(0 <= r["copies"] <= 3 and r["taken"] == r["size"] * r["copies"] for r in got)
    key = lambda rs: Counter((r["doc_id"], r["source"], r["size"], r["copies"]) for r in rs)
    assert key(got) == key(mixing.mix(docs.repartition(5)).collect())
    again = mixing.remix(docs)
    assert again.columns == docs.columns and again.count() == sum(r["copies"] for r in got)
    assert mixing.mix(none).count() == 0


def test_repeated_lines(docs, rows, none):
    got = lines.repeated_units(docs).collect()
    normal = lambda u: re.sub(r"[\x20\x09-\x0D]+", " ", u.lower()).strip(" ")
    first: dict = {}
    for r in rows:
        for k, u in enumerate((r[1] or "").split("\n")):
            rank = (r[0] is None, r[0] or 0, k)
            first[normal(u)] = min(first.get(normal(u), rank), rank)
    want = Counter()
    for r in rows:
        if r[1] is None:
            want[(r[0], None, 0, 0, ())] += 1
            continue
        units, at, kept, gone, n_bytes = r[1].split("\n"), 0, [], [], 0
        for k, u in enumerate(units):
            if normal(u) and (r[0] is None, r[0] or 0, k) > first[normal(u)]:
                gone.append((at, len(u)))
                n_bytes += len(u.encode())
            else:
                kept.append(u)
            at += len(u) + 1
        want[(r[0], "\n".join(kept), len(units), n_bytes, tuple(gone))] += 1
    assert Counter(
        (r["doc_id"], r["text"], r["n_units"], r["n_removed"], tuple((x["start"], x["length"]) for x in r["removed"])) for r in got
    ) == want
    assert all(r["removed_units"] == len(r["removed"]) for r in got)
    assert lines.repeated_units(none).count() == 0


def test_repeated_lines_of_scripts_without_blanks_and_paragraphs(spark):
    frame = spark.createDataFrame([(1, "全体の一行\nok"), (2, "全体の一行\nnew"), (3, "a\n\n b\n\na")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lines.repeated_units(frame).collect()}
    assert got[2]["text"] == "new" and got[2]["n_removed"] == 15
    assert lines.repeated_units(frame, lines.PARAGRAPH).filter("doc_id = 3").first()["text"] == "a\n\n b"
    few = lines.repeated_units(frame, min_words=2).agg({"n_removed": "sum"}).first()[0]
    assert few == 0


def test_repeated_lines_are_linear_in_a_text(spark):
    text = "\n".join(f"line {k % 100_000} of a long text" for k in range(200_000))
    frame = spark.createDataFrame([(1, text), (2, "line 7 of a long text\nother")], "doc_id long, text string")
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in lines.repeated_units(frame).select("doc_id", "removed_units", "n_units", "text").collect()}
    assert time.perf_counter() - began < 30
    assert got[1]["removed_units"] == 100_000 and got[1]["n_units"] == 200_000 and got[2]["text"] == "other"


def test_toxicity_sample_of_repeated_rows(spark):
    docs = spark.createDataFrame([(k % 4, f"text {k}") for k in range(40)] + [(None, "x")], "doc_id long, text string")
    marks = spark.createDataFrame([(k % 4, k % 2) for k in range(12)] + [(None, 1), (77, 1)], "doc_id long, toxic int")
    got = toxicity.sample(docs, marks).collect()
    outside = [k for k in range(4) if zlib.crc32(str(k).encode()) % 5]
    assert len(got) == len(outside) and all(r["text"] is not None for r in got)


def _one_edit(term, word):
    """Whether one letter added, left out, changed or swapped makes the word from the term."""
    if term == word:
        return True
    a, b = len(term), len(word)
    if a == b:
        odd = [k for k in range(a) if term[k] != word[k]]
        swapped = len(odd) == 2 and odd[1] == odd[0] + 1 and term[odd[0]] == word[odd[1]] and term[odd[1]] == word[odd[0]]
        return len(odd) == 1 or swapped
    if abs(a - b) != 1:
        return False
    long, short = (term, word) if a > b else (word, term)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def test_automaton_matches_plain_edit_distance():
    pick = random.Random(8)
    draw = lambda n: "".join(pick.choice("abcd") for _ in range(n))
    terms = {draw(pick.randint(5, 9)) for _ in range(40)}
    automaton = toxicity.LexiconAutomaton(dict.fromkeys(terms, 1.0))
    words = {draw(pick.randint(3, 11)) for _ in range(3000)} | terms
    for term in sorted(terms):
        for _ in range(30):
            k = pick.randrange(len(term))
            words |= {term[:k] + term[k + 1 :], term[:k] + pick.choice("abcde") + term[k:], term[:k] + "e" + term[k + 1 :]}
            words.add(term[:k] + term[k + 1 : k + 2] + term[k : k + 1] + term[k + 2 :])
    for word in words:
        assert (automaton.weight(word) > 0) == any(_one_edit(t, word) for t in terms), word


def test_empty_tables(none):
    assert sharding.shard(none).count() == 0
    assert bpe.decode(bpe.encode(none)).count() == 0


def test_pipeline_against_plain_version(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard", "suffix_dedup", "mixing", "byte_bpe"]
    kept = stage(corpus_pipeline.STAGES[0][1](spark, docs, SF_DIR), "t0")
    assert 0 < kept.count() <= docs.count()
    rows0 = [tuple(r) for r in kept.collect()]
    want, find = _brute_components(rows0)
    one = stage(corpus_pipeline.STAGES[1][1](spark, kept, SF_DIR), "t1")
    rows1 = [tuple(r) for r in one.collect()]
    assert {r[0] for r in rows1} == {k[2] for k in want}
    cut = stage(corpus_pipeline.STAGES[2][1](spark, one, SF_DIR), "t2")
    brute = {k[0]: k for k in _brute_strings(rows1)}
    for r in cut.collect():
        _, n, gone, _, digest = brute[r["doc_id"]]
        assert r["n_chars"] == len(r["text"]) if gone else sha(r["text"].encode()) == digest
        assert n - gone - 8 <= len(r["text"].encode()) <= n - gone
    assert cut.columns == docs.columns
    mixed = stage(corpus_pipeline.STAGES[3][1](spark, cut, SF_DIR), "t3")
    assert mixed.columns == docs.columns and mixed.count() > 0
    last = corpus_pipeline.STAGES[4][1](spark, mixed, SF_DIR)
    text = Counter((r["doc_id"], sha(r["text"].encode())) for r in mixed.collect())
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in last.collect()) == text


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    assert compare(spark, connect(SF_DIR), queries.QUERIES[name], queries.SQL[name], SF_DIR) == []
