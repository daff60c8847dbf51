"""Jaccard join and repeated-string removal against brute force."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomfield.llm import components as linked
from loomfield.llm.components import components
from loomfield.llm.common import Scratch
from loomfield.llm import jaccard_join
from loomfield.llm.jaccard_join import near_duplicates
from loomfield.llm import repeats
from loomfield.llm.repeats import op6_repeats, remaining, whole_points, with_spans
from loomfield.llm.suffix_order import suffix_order


def texts(seed: int) -> list[str | None]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    base = [[word() for _ in range(r.randint(1, 120))] for _ in range(12)]
    out = [" ".join(b) for b in base]
    for b in base:
        for _ in range(4):
            w = list(b)
            for _ in range(r.randint(0, 1 + len(w) // 30)):
                w[r.randrange(len(w))] = word()
            out.append("\n ".join(w).upper() if r.random() < 0.3 else " ".join(w))
    passage = " ".join(word() for _ in range(40))
    out += [f"{word()} {passage} {' '.join(word() for _ in range(30))}" for _ in range(5)]
    return [*out, *out[:3], None, "", " \t\n", "one", "ONE", "one two"]


def shingles(t: str | None, k: int) -> frozenset:
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


@pytest.mark.parametrize(("seed", "words", "num"), [(1, 4, 85), (2, 2, 50), (3, 5, 80)])
def test_components_are_those_of_all_pairs(spark, seed, words, num):
    rows = list(enumerate(texts(seed)))
    sets = {i: shingles(t, words) for i, t in rows}
    root = dict(zip(sets, sets, strict=True))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= num * len(sets[a] | sets[b]) and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, cls string, n long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, words, num, 100).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_links_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "REGION_ROWS", 2)
    base = [f"w{i}" for i in range(120)]
    group = [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(0, 120, 6)]
    rows = list(enumerate([*texts(2), *group, group[0]]))
    sets = {i: shingles(t, 2) for i, t in rows}
    linked = lambda a, b: 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b]) > 0
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if linked(a, b)}
    members, pairs = jaccard_join.exact_links(spark.createDataFrame(rows, "doc_id long, text string"), 2, 50, 100)
    of = {r.doc_id: (r.n_shingles, r.k) for r in members.collect()}
    met = {(r.a, r.b) for r in pairs.collect()}
    assert {i: n for i, (n, _) in of.items()} == {i: len(s) for i, s in sets.items()}
    same = lambda a, b: of[a][1] is not None and (of[a][1] == of[b][1] or (min(of[a][1], of[b][1] if of[b][1] is not None else -1), max(of[a][1], of[b][1] if of[b][1] is not None else -1)) in met)
    assert {(a, b) for a, b in itertools.combinations(sets, 2) if same(a, b)} == want
    n = {r.k: r.n_links for r in jaccard_join.link_counts(members, pairs).collect()}
    assert {i: n[k] for i, (_, k) in of.items() if k is not None} == {i: sum(i in p for p in want) for i, (_, k) in of.items() if k is not None}


def test_join_of_nothing_nulls_and_repeats(spark):
    kind = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], kind), 4, 85, 100).count() == 0
    rows = [(None, "a b c d e"), (None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (9, None)]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, kind), 4, 85, 100).collect())
    assert got == [("7", 2, 7), ("7", 2, 7), ("9", 0, 9), ("None", 2, 7), ("None", 2, 7)]


def test_components_of_a_star(spark):
    """A hub of 10^5 links beside a chain and a small star: its links meet the hub in shares."""
    n = 100_000
    hub = spark.range(1, n + 1).select(F.lit(1_000_000).alias("u"), F.col("id").alias("v"))
    rest = spark.createDataFrame([(2_000_000, 2_000_001), (2_000_001, 2_000_002), (3_000_000, 3_000_001)], "u long, v long")
    links = hub.union(rest)
    got = components(links, Scratch(spark, "t"), "star")
    wanted = {1: n + 1, 2_000_000: 3, 3_000_000: 2}
    assert {r.root: r["count"] for r in got.groupBy("root").count().collect()} == wanted
    assert linked.hubs_of(links, True) == linked.hubs_of(links, False) == [1_000_000]
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    dealt, copies = linked.salted(links, least, [1_000_000])
    shares = [r["count"] for r in dealt.filter("u = 1000000").groupBy("s").count().collect()]
    assert len(shares) == linked.SALTS and max(shares) <= 2 * sorted(shares)[len(shares) // 2]
    assert copies.groupBy("u").count().filter("u <> 1000000 and count > 1").count() == 0
    assert dealt.join(copies, ["u", "s"]).count() == links.count()


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    got = dict(components(links, Scratch(spark, "t"), "chain").collect())
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_suffix_order_is_that_of_sorted_suffixes(spark):
    r = random.Random(5)
    strings = [[r.randint(0, 2) for _ in range(r.randint(1, 40))] for _ in range(12)] + [[1] * 30, [1] * 31]
    df = spark.createDataFrame([(k, s, [1] * len(s)) for k, s in enumerate(strings)], "sid long, v array<long>, c array<long>")
    got = {row.sid: row.less for row in suffix_order(df, 10**6, Scratch(spark, "t")).collect()}
    every = sorted(s[i:] for s in strings for i in range(len(s)))
    first = {}
    for k, s in enumerate(every):
        first.setdefault(tuple(s), k)
    assert got == {k: [first[tuple(s[i:])] for i in range(len(s))] for k, s in enumerate(strings)}


def passages(length: int, seed: int) -> list[str | None]:
    """Texts with shared passages of lengths around ``length``, copies, and stretches of short periods."""
    r = random.Random(seed)
    noise = lambda n: "".join(r.choice("abcdefgh éß\n") for _ in range(n))
    shared = [noise(n) for n in (length - 20, length, length + 1, 2 * length, 3 * length)]
    rows = [noise(r.randint(0, 200)) + r.choice(shared) + noise(r.randint(0, 200)) for _ in range(14)]
    rows += [noise(300)] * 3 + ["=" * (3 * length), "ab" * length, "abcdefg" * length, None, "", noise(length - 1)]
    rows += [noise(n) + "=" * (length - 10) + "xyzuvw" + noise(300) for n in (50, 80)] + ["-" * length, "-" * length + "x", noise(90) + "-" * length + "x"]
    rows += [noise(n) + "abcdefg" * (length // 7 - 3) + noise(30) for n in (40, 70)] + [noise(n) + "=" * 200 + shared[0] + "=" * 150 + x for n, x in ((33, "q"), (35, "r"))]
    rows.append(rows[0][: len(rows[0]) // 2] + noise(50) + rows[0][len(rows[0]) // 2 :])
    return [*rows, rows[0], rows[0]]


def left_over(rows: list[str | None], length: int) -> dict[int, tuple[bytes, int]]:
    """What brute force leaves of each text, and the number of removed runs."""
    raw = {i: (t or "").encode() for i, t in enumerate(rows)}
    seen: dict[bytes, int] = {}
    for b in raw.values():
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] = seen.get(b[s : s + length], 0) + 1
    out = {}
    for i, b in raw.items():
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        out[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g), sum(g and not before for g, before in zip(gone, [False, *gone], strict=False))
    return out


@pytest.mark.parametrize(("length", "joined"), [(60, False), (120, True)])
def test_repeated_strings_are_those_of_all_places(spark, monkeypatch, length, joined):
    if joined:  # as with too many names for a filter, and parts and memories too small
        monkeypatch.setattr(repeats, "MOST_NAMES", 0)
        monkeypatch.setattr(repeats, "PART", 300)
        monkeypatch.setattr(repeats, "FEW", 0)
    rows = passages(length, length)
    names = ("first", "uid", "sha", "raw", "spans", "h1", "row", "kept")
    df = spark.createDataFrame([(i, t, *names) for i, t in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = remaining(with_spans(df, length)).collect()
    assert {x.row.doc_id: bytes(x.kept) for x in got} == {i: b for i, (b, _) in left_over(rows, length).items()}
    assert all(tuple(x.row)[2:] == names for x in got)


def test_the_query_removes_what_brute_force_removes(spark, tmp_path):
    rows = passages(400, 3)
    spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in op6_repeats(spark, str(tmp_path)).collect()}
    want = left_over(rows, 400)
    size = lambda i: len((rows[i] or "").encode())
    assert got == {i: (size(i), size(i) - len(b), n, hashlib.sha256(b).hexdigest()) for i, (b, n) in want.items()}


def test_a_passage_that_all_texts_hold_goes_from_all(spark):
    r = random.Random(8)
    noise = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    passage = noise(900)
    own = [(noise(150), noise(150)) for _ in range(400)]
    df = spark.createDataFrame([(i, a + passage + b) for i, (a, b) in enumerate(own)], "doc_id long, text string")
    got = {x.row.doc_id: bytes(x.kept).decode() for x in remaining(with_spans(df, 400)).collect()}
    assert all(a.startswith(got[i][:140]) and b.endswith(got[i][-140:]) and len(got[i]) > 280 for i, (a, b) in enumerate(own))


def test_no_documents_have_no_repeats(spark):
    assert with_spans(spark.createDataFrame([], "doc_id long, text string"), 400).count() == 0


def test_spans_move_to_whole_code_points():
    raw = "aéßb".encode()
    assert whole_points(raw, [{"a": 2, "b": 4}]) == []
    assert whole_points(raw, [{"a": 1, "b": 4}]) == [{"a": 1, "b": 3}]
    assert whole_points(raw, [{"a": 0, "b": 6}]) == [{"a": 0, "b": 6}]
