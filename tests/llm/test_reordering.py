"""Fingerprints, fill-in-middle and the filter audit against brute-force versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.test_llm import SCHEMA, docs, none, rows  # noqa: F401
from tidewell.llm import interactions, middles, syncmers

MASK64 = 2**64 - 1


def _hash(values, kind):
    """The hash that Spark gives to a text or an array of longs."""
    out = 42
    for v in values:
        out = xxhash.xxh64(v if kind is bytes else (v & MASK64).to_bytes(8, "little"), seed=out).intdigest()
    return out


def _entries(text, k=5, s=2):
    units = [_hash([u.encode()], bytes) for u in re.findall(r"[!-~\u0080-\u0DFF]{1,8}|[^\x20\x09-\x0D]", text or "")]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    inner = [signed(_hash(units[i : i + s], int)) for i in range(len(units) - s + 1)]
    entry = lambda run, gap: (_hash(run, int) & (2**29 - 1)) << 2 | gap
    out, last = [], None
    for i in range(len(units) - k + 1):
        window = inner[i : i + k - s + 1]
        if min(window) in (window[0], window[-1]):
            out.append(entry(units[i : i + k], 0 if last is None else i - last))
            last = i
    return out or ([entry(units, 0)] if units else [])


def _alike(a, b):
    a, b = set(a), set(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def test_syncmers_match_brute_force(docs, rows):  # noqa: F811
    got = syncmers.edited(docs).collect()
    assert len(got) == len(rows)
    known = {(r[0], r[1] or "") for r in rows}
    by_id = {i: t for i, t in known if i is not None}
    nulls = [t for i, t in known if i is None]
    assert sorted(nulls) == sorted({r[1] or "" for r in rows if r[0] is None}) and len(nulls) == 2
    order = [(i, by_id[i]) for i in sorted(by_id, reverse=True)]
    # the two texts without id come last, in an order that only their hash decides
    found = {(r["doc_id"], r["text"]): r for r in got}
    cycles = []
    for tail in permutations(nulls):
        whole = [*order, *((None, t) for t in tail)]
        good = True
        for (i, text), (_, after) in zip(whole, whole[1:] + whole[:1], strict=True):
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            good &= found[i, text]["edited"] == edited
            if i is not None and i != min(by_id):
                own, new = _entries(text), _entries(edited)
                assert found[i, text]["fingerprint"] == own
                assert found[i, text]["edited_fingerprint"] == new
                assert found[i, text]["near_edited"] == pytest.approx(_alike(own, new))
                assert found[i, text]["near_next"] == pytest.approx(_alike(own, _entries(after)))
        cycles.append(good)
    assert cycles.count(True) == 1


def test_syncmers_of_odd_tables(spark, none):  # noqa: F811
    assert syncmers.edited(none).count() == 0
    lone = spark.createDataFrame([(1, "abcdefgh x", "kept")], "doc_id long, text string, mark string")
    row = syncmers.edited(lone).first()
    assert row["edited"] == "abcde" + "abcde" and row["near_next"] == 1.0
    same = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, None), (None, "")], "doc_id long, text string")
    got = syncmers.edited(same).select("doc_id", "edited", "fingerprint").collect()
    assert len(got) == 4 and len({str(r) for r in got}) == 2
    assert {r["edited"] for r in got} == {"a b", ""}


def test_likeness_follows_shared_text(spark):
    pick = random.Random(3)
    words = ["w%03d" % k for k in range(700)]
    base = [pick.choice(words) for _ in range(400)]
    near = list(base)
    near[200] = "other"
    shifted = ["new"] * 9 + base
    frame = spark.createDataFrame([(" ".join(base), " ".join(x)) for x in (base, near, shifted, base[::-1])], "a string, b string")
    alike = [
        r[0]
        for r in frame.select(
            syncmers.likeness(syncmers.anchors(F.col("a")), syncmers.anchors(F.col("b")))
        ).collect()
    ]
    assert alike[0] == 1.0 and alike[1] > 0.97 and alike[2] > 0.95 and alike[3] == 0.0


def test_one_very_long_text(spark):
    text = " ".join(f"u{k * 7919 % 1000003}" for k in range(400_000))
    frame = spark.createDataFrame([(1, text), (2, "short one")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in syncmers.edited(frame).select("doc_id", "near_edited", F.size("fingerprint").alias("n")).collect()}
    assert 150_000 < got[1]["n"] < 260_000 and 0.6 < got[1]["near_edited"] < 0.7


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(min_size=1, max_size=5), max_size=700))
def test_skip_list_finds_every_rank(units):
    ranks, total = middles.SkipList(units), 0
    assert ranks.locate(0) == 0
    for k, unit in enumerate(units):
        total += len(unit)
        assert ranks.locate(k + 1) == total


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>PSM\na", max_size=40), st.integers())
def test_fill_in_middle_comes_back(text, name):
    n, form, first, middle, output = middles.rearrange(text, str(name))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    assert n == len(units) and middles.reassemble(output, form) == text
    marked = any(m in text for m in ("<P>", "<S>", "<M>"))
    assert (form == "plain") == (not text or marked)
    if form != "plain":
        digest = hashlib.sha256(f"7:{name}".encode()).hexdigest()
        h1, h2, _, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        assert first == len("".join(units[:a])) and middle == len("".join(units[a:b]))
        assert form == ("spm" if h4 % 100 < 50 else "psm")


def test_fill_in_middle_of_tables(spark, docs, rows, none):  # noqa: F811
    assert middles.restore(middles.transform(none)).count() == 0
    got = middles.restore(middles.transform(docs)).collect()
    texts = Counter((r[0], (r[1] or "").encode()) for r in rows)
    assert Counter((r["doc_id"], bytes(r["restored"])) for r in got) == texts
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert {r["form"] for r in middles.transform(docs, rate=0).collect()} == {"plain"}
    odd = spark.createDataFrame([(1, bytes([65, 255, 10, 254, 66, 10, 67]))], "doc_id int, text binary")
    row = middles.restore(middles.transform(odd)).first()
    assert bytes(row["restored"]) == bytes([65, 255, 10, 254, 66, 10, 67]) and row["n"] == 3
    long = spark.createDataFrame([(5, "line\n" * 500_000)], "doc_id long, text string")
    row = middles.restore(middles.transform(long)).selectExpr("n", "prefix_chars % 5 AS x", "length(restored) AS m").first()
    assert tuple(row) == (500_000, 0, 2_500_000)


def _audit(docs_, labels_, letters="ABCDE"):
    """Every order applied document by document."""
    firsts = {}
    for i, text, _ in docs_:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    good = {i for i, q, _ in labels_ if q == 1 and i is not None}
    toxic = {i for i, _, t in labels_ if t == 1 and i is not None}
    cells, shapley = defaultdict(Counter), Counter()
    for i, text, lang in docs_:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        first = firsts.get(text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": first is not None and (i is None or i > first),
        }
        for order in permutations(letters):
            alive = True
            for k, f in enumerate(order):
                cell = cells[lang or "", "".join(order), k + 1, f]
                removed = alive and fails[f]
                cell["removed"] += removed
                cell["redundant"] += fails[f] and not alive
                cell["unique_fails"] += fails[f] and sum(fails.values()) == 1
                cell["good_lost"] += removed and i in good
                cell["toxic_lost"] += removed and i in toxic
                shapley[lang or "", f] += removed
                alive = alive and not fails[f]
                cell["kept"] += alive
    return cells, shapley


def test_audit_matches_brute_force(spark):
    pick = random.Random(11)
    texts = [None, "", "A B C", "x # y", " ".join(f"w{k}" for k in range(130)), "same word " * 70, "UPPER CASE " * 60]
    texts += [" ".join(pick.choice("abcdefgh") * pick.randint(1, 4) for _ in range(pick.randint(60, 140))) for _ in range(6)]
    texts += [" ".join(f"{pick.random():.9f}" for _ in range(120)) + " %" * pick.randint(0, 1) for _ in range(6)]
    some = [(k, pick.choice(texts), pick.choice(["en", "de", None, ""])) for k in range(150)]
    some += [some[3], some[3], (None, texts[4], "en"), (None, texts[5], None)]
    marks = [(k, pick.choice([0, 1, None]), pick.choice([0, 1, None, 2])) for k in range(0, 200, 2)]
    marks += [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    cells, shapley = _audit(some, marks)
    frame = spark.createDataFrame(
        [(*d, "n", 1) for d in some], "doc_id long, text string, lang string, part string, mask int"
    )
    labels = spark.createDataFrame([(*m, 1) for m in marks], "doc_id long, quality int, toxic int, good int")
    got = interactions.audit(interactions.failures(frame, labels)).collect()
    assert len(got) == 3 * 600 == len(cells)
    for r in got:
        cell = cells[r["part"], r["filter_order"], r["step"], r["filter"]]
        for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert r[name] == cell[name], (r, cell)
        assert r["shapley"] == shapley[r["part"], r["filter"]]


def test_audit_of_odd_tables(spark, none):  # noqa: F811
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.audit(interactions.failures(none, labels)).count() == 0


@pytest.mark.parametrize("n", [1, 255, 256, 70_000, 2**40])
def test_packed_counters_do_not_overflow(n):
    found = list(interactions.tally([(0b01, 1, 0, n), (0b11, 0, 1, n)], "AB"))
    by = {(r["filter_order"], r["filter"]): r for r in found}
    assert by["AB", "A"]["removed"] == 2 * n and by["AB", "B"]["redundant"] == n
    assert by["BA", "B"]["removed"] == n and by["BA", "A"]["removed"] == n == by["BA", "A"]["unique_fails"]
    assert by["AB", "A"]["shapley"] == 3 * n and by["AB", "A"]["good_lost"] == n == by["BA", "B"]["toxic_lost"]
