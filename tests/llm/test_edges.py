"""Urls, top-k and the pipeline: brute force, odd rows, empty tables, clashing columns."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from loomfield.llm.common import Scratch
from loomfield.llm.topk import top_k
from loomfield.llm.url_filter import filtered, rules_frame

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en/x", "block"), ("b.example.net", "", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.b.c.d", "/", "block"), ("net", "/", "allow"), (None, "/", "block")]
URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://EXAMPLE.net/en/x?y#z", "x://www.example.net/en/", "http://wexample.net/en/", "http://example.net./en/", "http://b.example.net", "http://z.b.example.net/q",
    "http://a..net/", "http://example.com/de", "http://example.com/de/1", "http://example.com?/de/", "http://example.com#/de/", "s://x://org/fr/", "http://a.b.c.d/", "http://b.c.d/", "http://É.Net/\n/x", "http://org/fr/" + "x" * 5000,
]


def judged(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1].split("?")[0].split("#")[0]
    host, slash, path = rest.partition("/")
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path
    fit = [(len(h), len(p), h + p, v) for h, p, v in RULES if h is not None and (h, p, v) != ("net", "/", "block") and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, "allow")))


def test_urls_get_the_longest_rule(spark):
    urls = [*URLS, *[f"http://{random.Random(k).choice(('a.', 'www.', ''))}example.net/{random.Random(k).choice(('en/', 'en/x1', 'fr/'))}" for k in range(300)]]
    df = spark.createDataFrame([(i, u, "mine", f"k{i}") for i, u in enumerate(urls)], "page_id long, url string, rule string, key string")
    rows = filtered(df, rules_frame(spark, RULES), target=20).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == {i: judged(u) for i, u in enumerate(urls)}
    assert len(rows) == len(urls) and all(r.key == f"k{r.page_id}" for r in rows)
    assert filtered(df.limit(0), rules_frame(spark, RULES)).count() == 0
    assert {r.verdict for r in filtered(df, rules_frame(spark, RULES).limit(0)).collect()} == {"allow"}


def test_top_k_is_that_of_all_pairs(spark):
    r = random.Random(3)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(60)] + [(60 + i, [0.5] * 6) for i in range(15)]
    odd = [(100, None), (101, []), (102, [None] * 6), (103, [float("nan")] * 6), (104, [float("inf")] * 6), (None, [1.0] * 6), (110, [1.0, -1.0, 1.0]), (120, [0.5, 0.25, -1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], "vec_id long, embedding array<float>, score int")
    got = {}
    for x in top_k(df, F.col("vec_id") % 10 == 0, k=4).collect():
        got.setdefault(x.query_id, {})[x["rank"]] = (x.vec_id, x.score)
    import numpy as np

    ints = {i: np.floor(np.array(v, np.float32).astype(float) * 1024).astype(int) for i, v in rows + odd[6:]}
    want = {}
    for q in ints:
        if q % 10 == 0:
            best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:4]
            want[q] = {k + 1: (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want
    assert top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_pipeline_keeps_clean_documents(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice(("th", "er", "an", "ing", "on", "re", "st", "ou", "ed")) for _ in range(r.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(80)
    texts = [prose(r.randint(5, 300)) for _ in range(30)]
    near = texts[0] if len(texts[0].split()) > 60 else prose(200)
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    copy = " ".join([*near.split()[:-1], "changed"])
    extra = [near, near, copy, f"{prose(20)} {passage} {prose(20)}", f"{prose(30)} {passage} {prose(10)}", "mail me at someone@example.org today please", None, "", "12345 !!!", prose(9000)]
    rows += [(100 + k, t, "en", None, len(t) if t else None) for k, t in enumerate(extra)] + [(None, prose(50), None, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    base = Scratch(spark, "t").root
    docs.write.parquet(f"{base}/documents.parquet")
    now, kept = spark.read.parquet(f"{base}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, base).write.parquet(f"{base}/{name}")
        now = spark.read.parquet(f"{base}/{name}")
        if name != "packing":
            assert now.columns == docs.columns
            kept[name] = {x.doc_id: x.text for x in now.collect()}
    assert set(kept["language_id"]) == {*range(30), *range(100, 106), 109, None}
    ids = set(kept["jaccard_join"])
    assert {*range(1, 30), 103, 104, 105, 109, None} <= ids and len(ids & {0, 100, 101, 102}) == (1 if near == texts[0] else 2)
    assert spark.read.parquet(f"{base}/jaccard_join").count() == len(ids)
    after = kept["suffix_dedup"]
    assert all(after[i] == texts[i] for i in range(1, 30)) and passage[10:-10] not in after[103] and passage[10:-10] not in after[104] and after[103].split()[0] == extra[3].split()[0]
    assert kept["pii"][105] == "mail me at [EMAIL] today please" and all(kept["pii"][i] == texts[i] for i in range(1, 30))
    assert {x.doc_id for x in now.select("doc_id").distinct().collect()} == ids
    empty = Scratch(spark, "t").root
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_near_copies_go_where_ids_are_null_or_shared(spark):
    r = random.Random(4)
    prose = lambda: [f"w{r.randrange(10**6)}" for _ in range(100)]
    a, b, c, d, e = (prose() for _ in range(5))
    last = lambda w, x: " ".join([*w[:-1], x])
    kept = [(None, last(a, "a")), (None, last(b, "a")), (3, last(c, "a")), (7, last(d, "a")), (7, last(e, "a")), (None, None), (None, None), (7, " "), (9, ""), (9, "")]
    gone = [(None, last(a, "b")), (None, last(c, "b")), (7, last(c, "c")), (7, last(d, "b")), (7, last(d, "A")), (8, last(e, "b")), (7, last(e, "a"))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in kept + gone], "doc_id long, text string, lang string")
    order = lambda rows: sorted(rows, key=str)
    want = [(i, " ".join(t.split(" ")[:-1] + ["A"]) if i == 7 and t == last(d, "a") else t) for i, t in kept]
    assert order((x.doc_id, x.text) for x in corpus_pipeline.without_near_copies(spark, docs, "").collect()) == order(want)


def test_columns_of_any_name_pass_every_stage(spark):
    """Columns that operators add under the same names, null and shared ids, and repeated rows."""
    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choice(("th", "er", "an", "ing", "on", "re")) for _ in range(r.randint(1, 4))) for _ in range(n))
    names = ["score", "rejected", "cls", "root", "row", "key", "spans", "base", "more", "kept", "judged", "lang_pred", "n", "label", "k"]
    texts = [prose(r.randint(20, 120)) for _ in range(25)]
    rows = [(i if i < 20 else (3 if i < 23 else None), t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[24]), (50, None), (51, " ")]
    kinds = ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long", *[f"{c} string" for c in names]])
    docs = spark.createDataFrame([(i, t, "en", "a", None, *[f"{c} of {i}" for c in names]) for i, t in rows], kinds)
    base = Scratch(spark, "t").root
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, base).write.parquet(f"{base}/{name}")
        now = spark.read.parquet(f"{base}/{name}")
        if name != "packing":
            assert now.columns == docs.columns, name
            for x in now.collect():
                assert [x[c] for c in names] == [f"{c} of {x.doc_id}" for c in names], name
    assert {x.doc_id for x in now.select("doc_id").distinct().collect()} == {*range(20), None}
    left = spark.read.parquet(f"{base}/jaccard_join")
    assert sorted(x.text for x in left.collect()) == sorted(texts)


def test_top_k_sends_no_copies_of_blocks_to_the_driver(spark, monkeypatch):
    import numpy as np

    from loomfield.llm import topk

    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "ROW_BLOCK", 10)
    r = random.Random(4)
    # Components in two and four bytes.
    rows = {i: [r.uniform(-1, 1) * (1, 1e3, 1e4)[i % 3] for _ in range(3)] for i in range(90)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    scratch = Scratch(spark, "test")
    packed = [topk.blocks(df.select(F.col("vec_id").alias("id"), topk.quantised(F.col("embedding")).alias("v")).filter(f), n, scratch, name) for f, n, name in (("id % 5 = 0", 4, "q"), ("true", 10, "c"))]
    plan = topk.cells(*packed)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    ints = {i: np.floor(np.array(v) * 1024).astype(np.int64) for i, v in rows.items()}
    want = {(q, k + 1, i, -s) for q in ints if q % 5 == 0 for k, (s, i) in enumerate(sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:3])}
    assert {tuple(x) for x in top_k(df, F.col("vec_id") % 5 == 0, k=3).collect()} == want
