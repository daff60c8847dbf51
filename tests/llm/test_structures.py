"""Prefix trie, token files and Merkle manifest against brute force, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomfield.llm import merkle, prefix_trie, wavelet, word_ids

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


# Prefix trie


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(t, key=lambda x: x[0])] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def brute_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    rows = set()
    for p, ids in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in members) for q in below)
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = sorted(c for c in ids if len(convs[c]) == len(p))
        children = sum(len(q) == len(p) + 1 for q in below)
        rows.add((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), children, leaves, saved, sha(",".join(map(str, ends)))))
    return rows


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string, turns string"


def some_turns(seed):
    """Few texts, so that openings are shared; long common chains, equal conversations, missing and odd cells."""
    r, rows = random.Random(seed), []
    for c in range(90):
        if c % 20 == 0 and r.random() < 0.3:
            continue
        start = [("user", "a b  c"), ("assistant", "x\ty"), ("user", ""), ("assistant", "long " * 50)] if r.random() < 0.5 else []
        turns = start + [(r.choice(["user", "assistant", None]), r.choice(["a", "b c", "", None, " \n", "é ü"])) for _ in range(r.choice([0, 1, 1, 2, 9]))]
        rows += [(c, k if k or r.random() < 0.7 else None, *t, "clash") for k, t in enumerate(turns)]
    rows += [(c, k, "user", f"same {k % 3}", None) for c in (200, 201, 215, 300, 301) for k in range(40)]
    return rows + [(None, 0, "user", "no id", None)]


@pytest.mark.parametrize("seed, few", [(1, 1), (2, 8), (3, 256)])
def test_trie(spark, seed, few):
    rows = some_turns(seed)
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(spark.createDataFrame(rows, TURNS))), few=few)
    assert got.columns == NODE and {tuple(r) for r in got.collect()} == brute_trie(rebuilt([r[:4] for r in rows]))


def test_trie_without_rows_or_turns(spark):
    run = lambda rows: prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(spark.createDataFrame(rows, TURNS)))).collect()
    assert run([]) == []
    # The first two turns give way to those of an absent donor.
    assert zlib.crc32(b"5") % 4 == 2
    assert [tuple(r) for r in run([(5, 0, "user", "gone", None)])] == [(5, 0, None, 1, 0, 1, 0, sha("5"))]


def test_trie_of_many_copies_is_dealt(spark):
    """Equal conversations are one member; ids are hashed in order over blocks."""
    n = 3 * prefix_trie.IDS + 7
    rows = spark.range(n).select(F.col("id").alias("conv_id"), F.expr("sequence(0, 5)").alias("k")).select("conv_id", F.explode("k").alias("turn"))
    rows = rows.select("*", F.lit("user").alias("role"), F.concat(F.lit("w "), F.col("turn").cast("string")).alias("text"))
    got = {r["depth"]: r for r in prefix_trie.trie(prefix_trie.sequences(rows), few=1).collect()}
    assert len(got) == 7 and got[6]["n_convs"] == n and got[0]["saved_tokens"] == 6 * 2 * (n - 1)
    assert got[6]["ends_sha256"] == sha(",".join(map(str, range(n)))) and got[3]["n_leaves"] == 1 and got[3]["ends_sha256"] == sha("")


# Token files


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=300), st.integers(1, 6))
def test_wavelet_matrix(ids, kinds):
    ids = np.array([x % (1 << (3 * kinds)) % 65536 for x in ids], "<u2")
    if not len(ids):
        return
    s = wavelet.Shard(wavelet.built(ids, [None, 7], [len(ids) - 1, 1]))
    assert (s.all() == ids).all() and [s.access(i) for i in range(len(ids))] == ids.tolist() and s.doc_ids() == [None, 7]
    lo, hi = len(ids) // 3, 2 * len(ids) // 3
    for t in {*ids.tolist(), 9}:
        assert s.places(t).tolist() == np.flatnonzero(ids == t).tolist()
        assert s.count(t, lo, hi) == (ids[lo:hi] == t).sum()


def test_wavelet_matrix_over_many_blocks():
    ids = (np.random.default_rng(3).zipf(1.2, 5 * wavelet.BITS + 11) % 40_000).astype("<u2")
    s = wavelet.Shard(wavelet.built(ids, [1], [len(ids)]))
    assert (s.all() == ids).all() and s.access(len(ids) - 1) == ids[-1]
    for t in (1, 2, int(ids[-1]), 39_999):
        assert s.places(t).tolist() == np.flatnonzero(ids == t).tolist() and s.count(t) == (ids == t).sum()
    with pytest.raises(ValueError):
        wavelet.Shard(b"something else")


ODD = [
    "", " ", None, "It's I'LL o'clock don't 'Re", "İstanbul Ǆ ŉ ﬁ Å é", "é àͅ", "١٢٣ ½ ² ⅷ 〇", "日本語 テスト 한국어", "한",
    "<|endoftext|>x", "a<|startoftext|>", "x\x1cy \x1f z\x00", "​ 　\x85\xa0", "😀👨‍👩", "ΑΣ ΣΑ ß ẞ", "a" * 30_000, "-'s 1's '''s _x_", "\n\n", " end ",
]


def test_word_ids_are_the_librarys():
    enc, lib = word_ids.WordIds(), word_ids.WordIds().library
    chars = [chr(c) for c in [*range(0x600), *range(0x1100, 0x1200), *range(0x1E00, 0x2100), 0x1F600, 0x10D4A]]
    texts = ODD + [f"{c}{c}a{c} {c}1{c}-{c}'s" for c in chars] + ODD
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    ids, sizes = enc.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    for t, w in zip(ODD, want):
        assert enc.encode(pa.array([t], pa.string()))[0].tolist() == w


def test_token_files(spark, tmp_path):
    rows = [(k // 2 if k % 11 else None, t, "clash") for k, t in enumerate(ODD * 4)] + [(5, "same text", "x")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    folder = f"file://{tmp_path}/shards"
    wavelet.write(wavelet.tokenised(docs), folder, shard=500)
    got = wavelet.documents(spark, folder).orderBy("start").collect()
    lib = word_ids.WordIds().library
    ids = lambda t: lib.encode(t or "", add_special_tokens=False).ids + [1]
    at, seen = 0, []
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        seen.append((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]))
    assert [x[0] for x in seen] == sorted(x[0] for x in seen)
    crc = lambda t: zlib.crc32(np.array(ids(t), "<u4").tobytes())
    assert sorted(seen) == sorted((-1 if d is None else d, len(ids(t)), crc(t)) for d, t, _ in rows)
    # Occurrences and counts come from the files' ranks.
    token = ids("same")[0]
    found = wavelet.occurrences(spark, folder, [token, 60_000]).collect()
    want = sorted((-1 if d is None else d, k) for d, t, _ in rows for k, x in enumerate(ids(t)) if x == token)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["place"]) for r in found) == want
    assert {(r["token"], r["n"]) for r in wavelet.counts(spark, folder, [token, 60_000]).collect()} == {(token, len(want)), (60_000, 0)}


def test_token_files_of_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    wavelet.write(wavelet.tokenised(docs), f"file://{tmp_path}/none")
    assert wavelet.documents(spark, f"file://{tmp_path}/none").count() == 0


# Merkle manifest


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root with the line breaks deleted from every text)."""
    cell = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    H = lambda *parts: sha("".join(parts))

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
        return levels

    def way(levels, at):
        out = []
        for level in levels[:-1]:
            lo = at - at % 3
            out.append((level[lo:at], level[at + 1 : lo + 3]))
            at //= 3
        return out

    of = defaultdict(list)
    for r in rows:
        changed = r[4].replace("\n", "") if r[4] is not None else None
        of[r[1]].append((r[0], H(*map(cell, r[:5])), H(*map(cell, (*r[:4], changed)))))
    sources = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        of[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = tree([x[1] for x in of[s]])
    over = tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, (doc_id, leaf, now) in enumerate(of[s]):
            path = way(trees[s], at) + way(over, k)
            for before, after in path:
                now = H(*before, now, *after)
            proof = H(*[x for before, after in path for x in (*before, *after)])
            out.append((doc_id, leaf, trees[s][-1][0], over[-1][0], proof, now))
    return out


DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, path string, k string"


@pytest.mark.parametrize("sizes", [{"a": 800, "": 1, None: 4, "é": 243, "b": 244}, {"one": 9}, {None: 1}, {f"s{k}": 1 for k in range(300)}])
def test_manifest(spark, sizes):
    r, rows = random.Random(5), []
    for s, n in sizes.items():
        for k in range(n):
            text = r.choice(["a\nb", "", None, "é\n", "x" * 5000])
            rows.append((r.choice([None, k, k, k, 7]), s, r.choice(["en", None]), r.choice([None, 3]), text, "mine", None, "1"))
    docs = spark.createDataFrame(rows, DOCS)
    got = merkle.manifest(docs, F.translate("text", "\n", ""))
    got = got.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")), merkle.folded(F.col("now"), F.col("path"))).collect()
    order = lambda rows: sorted(tuple(x) for x in rows) if all(x[0] is not None for x in rows) else sorted((str(x[0]), *x[1:]) for x in rows)
    assert order(got) == order(brute_manifest(rows))


def test_manifest_of_no_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []
