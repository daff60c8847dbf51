"""Personal data: patterns, and information-theoretic sanitisation of the terms around them. DataFrame operations only.

Patterns find the protected entities: e-mail addresses, IP addresses, payment cards, phone numbers. An
entity is protected as itself and as the group it belongs to, which more documents share: the domain of an
address, the first two parts of an IP address, the first six digits of a card, the first five of a phone
number. Of the words of the documents that hold an entity the corpus tells how strongly each reveals it:
with document frequencies over all documents, a term t discloses of an entity e the share

    PMI(t; e) / IC(e)  =  log(p(e | t) / p(e)) / -log p(e)

of e's information. A text is no evidence against itself: its own copies are left out of the counts, and
what is left is smoothed by ``PRIOR`` documents that have e as often as all documents do,

    p(e | t)  =  (n(t, e) - copies + PRIOR p(e)) / (n(t) - copies + PRIOR)

so a term that no other text has beside the entity reveals nothing, and rare entities are judged without a
floor. Documents count as holding both however far apart they stand in the text. Terms are runs of letters
of any script outside the entities. A term is generalised if its share reaches ``GENERALISE`` and removed
if it reaches ``REMOVE``, at all its places in the text. Texts without an entity are never changed.

Scale: only documents with entities that other texts have too make pairs, and of their words only those
rare enough that their share can reach ``GENERALISE`` beside the entity's own frequency, which is known
before pairs are made. Document frequencies come from one pass with counts added up in every task before the shuffle.
What is joined back is keyed by the text's SHA-256, which the engine can split where it is hot.

Defined results: a null text counts as empty; empty texts have no spans. Repeated rows each give a
row and count as documents of their own. Equal texts get equal spans. Very long texts are searched
whole. Other columns are ignored by ``detected`` and kept by ``sanitised``; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.llm.common import Scratch, table
from loomfield.llm.spans import SPAN, count, found, joined

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "generalise", "remove"]
# A failed start of a run of the same characters fails at all its later places, so only the first is tried.
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9]){12,}+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: Documents by which an estimate is drawn towards what holds of all.
PRIOR = 1.0
#: Spans that are broadcast; more are joined.
FEW = 100_000
GENERALISE = 0.8
REMOVE = 0.95
TERM = r"\p{L}[\p{L}\p{M}]*+"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has the check digit of payment cards."""
    d = F.transform(F.regexp_extract_all(F.reverse(number), F.lit("[0-9]"), F.lit(0)), lambda c: c.cast("int"))
    value = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def _is_ip(t: Column) -> Column:
    """Every part at most 255, leading zeros aside; a part may have any number of digits."""
    bare = F.transform(F.split(t, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(bare, lambda p: F.when(F.length(p) <= 3, F.concat(F.lit("0"), p).cast("int") <= 255).otherwise(F.lit(False)))


def base_spans(text: Column) -> Column:
    """All base spans of a text: (place in ``BASE``, start, end, matched text)."""
    keep = (
        lambda x: F.lit(True),
        lambda x: _is_ip(x["t"]),
        lambda x: F.length(digits(x["t"])).between(13, 19) & luhn(digits(x["t"])),
        lambda x: F.length(digits(x["t"])).between(9, 15),
    )
    each = [found(text, p, k) for k, p in enumerate(PATTERNS)]
    return F.concat(each[0], *[F.filter(s, f) for s, f in zip(each[1:], keep[1:], strict=True)])


def blanked(text: Column, spans: Column) -> Column:
    """The text with blanks in place of its spans, so that all other places stay."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))

    def step(a: Column, x: Column) -> Column:
        gap = F.substring(text, (a["at"] + 1).cast("int"), F.greatest(x["s"] - a["at"], F.lit(0)).cast("int"))
        blank = F.repeat(F.lit(" "), F.greatest(x["e"] - F.greatest(x["s"], a["at"]), F.lit(0)).cast("int"))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.concat(a["out"], gap, blank).alias("out"))

    done = F.aggregate(order, start, step)
    return F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.char_length(text)))


def terms(text: Column) -> Column:
    """The distinct words of a text in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda m: F.lower(m)))


def term_places(texts: DataFrame) -> DataFrame:
    """(key, term, s, e) of every word; ``texts`` has key and blank."""
    words = F.regexp_extract_all("blank", F.lit(TERM), F.lit(0))
    each = texts.select("key", F.posexplode(F.zip_with(F.slice(F.split("blank", TERM, -1), F.lit(1), F.size(words)), words, lambda gap, m: F.struct(F.char_length(gap).alias("gap"), m.alias("m")))).alias("i", "x"))
    e = F.sum(F.col("x.gap") + F.char_length("x.m")).over(Window.partitionBy("key").orderBy("i"))
    return each.select("key", F.lower("x.m").alias("term"), (e - F.char_length("x.m")).alias("s"), e.alias("e"))


def entities(spans: Column) -> Column:
    """What the spans of a text protect: each entity, and the group it belongs to."""

    def group(x: Column) -> Column:
        t = F.lower(x["t"])
        parts = F.substring_index(t, "@", -1), F.substring_index(t, ".", 2), F.substring(digits(t), 1, 6), F.substring(digits(t), 1, 5)
        return F.get(F.array(*parts), x["k"])

    kind = lambda x: x["k"].cast("string")
    whole = F.transform(spans, lambda x: F.concat_ws(":", kind(x), F.lower(x["t"])))
    return F.array_distinct(F.concat(whole, F.transform(spans, lambda x: F.concat_ws("/", kind(x), group(x)))))


def revealing_terms(docs: DataFrame, base: DataFrame, scratch: Scratch, prior: float = PRIOR) -> DataFrame:
    """(key, spans): for each text the spans of terms that reveal an entity it holds.

    ``docs`` has a row per document with ``text``; ``base`` has key, text, spans and copies of those with entities.
    """
    whose = base.select("key", "copies", F.explode(entities(F.col("spans"))).alias("entity"))
    n_entity = whose.groupBy("entity").agg(F.sum("copies").alias("n_entity"))
    # An entity that no other text has gives no evidence.
    shared = whose.join(n_entity, "entity").filter(F.col("n_entity") > F.col("copies"))
    held = shared.groupBy("key").agg(F.collect_list(F.struct("entity", "n_entity")).alias("held"))
    held = scratch.write(held, "held")
    texts = base.select("key", "text", "copies", blanked(F.col("text"), F.col("spans")).alias("blank"))
    # Every document's every word, counted once for each document; what stands in an entity is no word.
    words = docs.select(F.explode(terms(F.col("text"))).alias("term"), F.lit(1).cast("long").alias("n"))
    words = words.union(texts.select(F.explode(terms(F.col("text"))), -F.col("copies"))).union(texts.select(F.explode(terms(F.col("blank"))), "copies"))
    n_term = words.groupBy("term").agg(F.sum("n").alias("n_term"))
    total = docs.agg(F.count("*").alias("n"))
    p = F.col("n_entity") / F.col("n")
    # As n(t, e) is n(e) at most, a more frequent term's share stays below GENERALISE.
    most = (F.col("n_entity") + prior) * F.pow(1 / p, F.lit(1 - GENERALISE)) + F.col("copies")
    open_texts = texts.join(held, "key").select("key", "copies", "held", F.explode(terms(F.col("blank"))).alias("term"))
    few = open_texts.join(n_term.filter("n_term > 1"), "term").join(F.broadcast(total))
    few = few.select("key", "copies", "term", "n_term", "n", F.explode("held").alias("h")).select("key", "copies", "term", "n_term", "n", "h.entity", "h.n_entity")
    pairs = scratch.write(few.filter((F.col("n_term") > F.col("copies")) & (F.col("n_term") <= most * (1 + 1e-9))), "pairs")
    both = pairs.groupBy("entity", "term").agg(F.sum("copies").alias("n_both"))
    q = (F.col("n_both") - F.col("copies") + prior * p) / (F.col("n_term") - F.col("copies") + prior)
    share = F.ln(q / p) / F.nullif(-F.ln(p), F.lit(0.0))
    scored = pairs.join(both.filter("n_both > 1"), ["entity", "term"]).filter(F.col("n_both") > F.col("copies")).select("key", "term", share.alias("share"))
    k = F.when(F.max("share") >= REMOVE, KINDS.index("remove")).otherwise(KINDS.index("generalise"))
    hits = scratch.write(scored.filter(F.col("share") >= GENERALISE).groupBy("key", "term").agg(k.alias("k")), "hits")
    at = term_places(texts.join(hits.select("key").distinct(), "key", "left_semi").select("key", "blank")).join(hits, ["key", "term"])
    return at.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "s", "e", F.col("term").alias("t")))).cast(f"array<{SPAN}>").alias("more"))


def detected(docs: DataFrame, text: str = "text", scratch: Scratch | None = None, prior: float = PRIOR, carry: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with a struct ``row`` of the columns ``carry``, or all, and text; key with base spans and those of revealing terms).

    The spans of texts that have any are written once in the shared folder, since four steps read them.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "pii")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"), body.alias("text"))
    found_in = rows.select("text", base_spans(F.col("text")).alias("spans")).filter(F.size("spans") > 0)
    # Equal texts share a key; a task adds up its own copies.
    base = scratch.write(found_in.select(F.sha2("text", 256).alias("key"), "text", "spans").groupBy("key").agg(F.first("text").alias("text"), F.first("spans").alias("spans"), F.count("*").alias("copies")), "base")
    more = scratch.write(revealing_terms(rows, base, scratch, prior), "more")
    return rows, base.select("key", F.col("spans").alias("base")).join(more, "key", "left")


def with_spans(docs: DataFrame, text: str = "text", scratch: Scratch | None = None, prior: float = PRIOR, carry: list[str] | None = None) -> DataFrame:
    """Rows (struct ``row`` of the columns ``carry``, or all, ``text``) with the spans ``base`` and ``more``.

    Where all spans are few they go to the texts; else rows meet them by the text's key.
    """
    rows, spans = detected(docs, text, scratch, prior, carry)
    none = F.array().cast(f"array<{SPAN}>")
    size = spans.agg(F.sum(1 + F.size("base") + F.size(F.coalesce("more", none)))).first()[0] or 0
    hit = rows.withColumn("key", F.sha2("text", 256)).join(F.broadcast(spans) if size <= FEW else spans, "key", "left")
    return hit.select("row", "text", F.coalesce("base", none).alias("base"), F.coalesce("more", none).alias("more"))


def masked(text: Column, spans: Column) -> Column:
    """The text with entities named by their kind, generalised terms by their shape, removed ones left out."""
    label = F.array(*[F.lit(f"[{k.upper()}]") for k in BASE])
    put = lambda x: F.when(x["k"] < len(BASE), F.get(label, x["k"])).when(x["k"] == KINDS.index("generalise"), F.lit("[TERM]")).otherwise(F.lit(""))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    # Of spans that overlap the one that begins first stands, the longer one first; the rest of the other is cut away too.
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("z"), x["k"].alias("k"))))

    def step(a: Column, x: Column) -> Column:
        end = -x["z"]
        gap = F.substring(text, (a["at"] + 1).cast("int"), F.greatest(x["s"] - a["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(a["at"], end).alias("at"), F.when(x["s"] >= a["at"], F.concat(a["out"], gap, put(x))).otherwise(a["out"]).alias("out"))

    done = F.aggregate(order, start, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.char_length(text))))


def sanitised(docs: DataFrame, text: str = "text", scratch: Scratch | None = None, prior: float = PRIOR) -> DataFrame:
    """The same columns with the text masked; null texts stay null."""
    rows = with_spans(docs, text, scratch, prior)
    clean = F.when(F.col(f"row.`{text}`").isNotNull(), masked(F.col("text"), F.concat("base", "more")))
    return rows.select(*[clean.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document and the terms that reveal it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = with_spans(docs, carry=["doc_id"])
    return rows.select(
        "row.doc_id",
        *[count(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(joined(F.col("base"), BASE, False), 256).alias("base_sha256"),
        joined(F.concat("base", "more"), KINDS, False).alias("spans"),
    )


def _oracle() -> str:
    """The same by whole documents: words of the blanked texts, counts over all documents, shares without a text's own copies."""
    term = r"\p{L}[\p{L}\p{M}]*"
    digits_of, luhn_of = "regexp_replace(m, '[^0-9]', '', 'g')", "list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN d[i] WHEN d[i] > 4 THEN 2 * d[i] - 9 ELSE 2 * d[i] END))"
    matches = lambda source, key, text, p: f"""SELECT {key}, s + length(gap) AS s, s + length(gap) + length(m) AS e, m FROM (
      SELECT {key}, gap, m, coalesce(sum(length(gap) + length(m)) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM (
        SELECT {key}, unnest(ms) AS m, unnest(gaps[:len(ms)]) AS gap, generate_subscripts(ms, 1) AS i FROM (
          SELECT {key}, regexp_extract_all({text}, '{p}') AS ms, string_split_regex({text}, '{p}') AS gaps FROM {source} WHERE regexp_matches({text}, '{p}'))))"""  # noqa: E731
    base = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(?:\.[0-9]+){3}", "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR ('0' || ltrim(p, '0'))::HUGEINT > 255)) = 0"),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({digits_of}) BETWEEN 13 AND 19 AND (SELECT {luhn_of} % 10 = 0 FROM (SELECT list_transform(string_split(reverse({digits_of}), ''), lambda c: c::INT) AS d))"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits_of}) BETWEEN 9 AND 15"),
    )
    spans = " UNION ALL ".join(f"SELECT n, {k} AS k, '{name}' AS kind, s, e, m FROM ({matches('docs', 'n', 'text', p)}) WHERE {keep}" for k, (name, p, keep) in enumerate(base))
    group = "CASE k WHEN 0 THEN split_part(lower(m), '@', -1) WHEN 1 THEN split_part(m, '.', 1) || '.' || split_part(m, '.', 2) WHEN 2 THEN regexp_replace(m, '[^0-9]', '', 'g')[:6] ELSE regexp_replace(m, '[^0-9]', '', 'g')[:5] END"
    before = "coalesce(max(e) OVER (PARTITION BY n ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return f"""WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text, count(*) OVER (PARTITION BY coalesce(text, '')) AS copies FROM documents),
base AS MATERIALIZED ({spans}),
pieces AS (SELECT n, s, e, substr(text, before + 1, greatest(s - before, 0)) || repeat(' ', greatest(e - greatest(s, before), 0)) AS piece
  FROM (SELECT n, s, e, {before} AS before FROM base) JOIN docs USING (n)),
blank AS MATERIALIZED (SELECT n, copies, text, parts || substr(text, far + 1) AS blank FROM (SELECT n, string_agg(piece, '' ORDER BY s, e) AS parts, max(e) AS far FROM pieces GROUP BY n) JOIN docs USING (n)),
cleared AS (SELECT n, coalesce(blank, docs.text) AS text FROM docs LEFT JOIN blank USING (n)),
n_term AS (SELECT term, count(*) AS n_term FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '{term}'))) AS term FROM cleared) GROUP BY 1),
whose AS (SELECT DISTINCT n, entity FROM (SELECT n, k || ':' || lower(m) AS entity FROM base UNION ALL SELECT n, k || '/' || {group} FROM base)),
n_entity AS (SELECT entity, count(*) AS n_entity FROM whose GROUP BY 1),
near AS MATERIALIZED (SELECT n, copies, lower(m) AS term, s, e FROM ({matches('blank', 'n', 'blank', term)}) JOIN blank USING (n)),
held AS (SELECT DISTINCT n, copies, entity, term FROM near JOIN whose USING (n)),
both_in AS (SELECT entity, term, count(*) AS n_both FROM held GROUP BY 1, 2),
shares AS (SELECT h.n, h.term, max(ln((n_both - copies + {PRIOR} * p) / (n_term - copies + {PRIOR}) / p) / nullif(-ln(p), 0)) AS share FROM held h JOIN both_in USING (entity, term)
  JOIN n_term USING (term) JOIN (SELECT entity, n_entity / (SELECT count(*) FROM docs)::DOUBLE AS p FROM n_entity) USING (entity) WHERE n_both > copies GROUP BY ALL),
more AS (SELECT n, CASE WHEN share >= {REMOVE} THEN 5 ELSE 4 END AS k, s, e FROM near JOIN shares USING (n, term) WHERE share >= {GENERALISE}),
every AS (SELECT n, k, kind, s, e FROM base UNION ALL SELECT n, k, CASE k WHEN 5 THEN 'remove' ELSE 'generalise' END, s, e FROM more),
per AS (SELECT n, {", ".join(f"count(*) FILTER (k = {k}) AS n_{name}" for k, name in enumerate(BASE))}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (k < 4) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans FROM every GROUP BY n)
SELECT doc_id, {", ".join(f"coalesce(n_{name}, 0) AS n_{name}" for name in BASE)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN per USING (n)"""


ORACLE = _oracle()
