"""Source divergence audit: how differently the sources of a language use its terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, groups_of, kept

#: Bytes as they count: letters in lower case and bytes beyond ASCII stay, all others stand between terms.
LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
STRETCH = 8_000_000  # characters whose terms are counted at once
SALTS = 16  # copies of a language's groups that its histograms are dealt to


def term_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and the documents that have them, summed over all documents."""

    def work(batches):
        for b in batches:
            names = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            number = {x: i for i, x in enumerate(dict.fromkeys(names))}
            keys = list(number)
            texts = b.column(2).to_pylist()
            for lo, hi in groups_of(texts, STRETCH):
                lists = [t.encode().translate(LETTERS).split() for t in texts[lo:hi]]
                size = [len(x) for x in lists]
                coded = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
                v = len(coded.dictionary)
                if not v:
                    continue
                whose = np.repeat(np.arange(hi - lo), size)
                each, n = np.unique(whose * v + coded.indices.to_numpy(), return_counts=True)  # a document's terms
                group = np.array([number[x] for x in names[lo:hi]])[each // v]
                found, at = np.unique(group * v + each % v, return_inverse=True)
                langs, sources = ([keys[g][k] for g in (found // v).tolist()] for k in (0, 1))
                terms = coded.dictionary.take(pa.array(found % v)).cast(pa.string())
                sums = np.bincount(at, n).astype(np.int64), np.bincount(at).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sources, pa.string()), terms, *map(pa.array, sums)], names=["lang", "source", "term", "n", "docs"])

    rows = docs.select("lang", "source", F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("_text"))
    parts = rows.mapInArrow(work, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def priced(count: Column, whole: Column) -> Column:
    """1 + floor(10^9 (count + 5) / whole) in exact whole numbers, where whole is N + 5 V."""
    part = (count + 5).cast("decimal(19,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.call_function("div", part, whole.cast("decimal(20,0)")) + 1


def divergence(docs: DataFrame, least_documents: int = 30, most_terms: int = 50, text_column: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank) for every group (lang, source) of docs.

    Terms are runs of letters and of characters beyond ASCII, A-Z in lower
    case; a language keeps those in at least least_documents of its documents.
    A group gives each kept term a smoothed share p of 10^9.  Part "pair": the
    sum of differences of p over all kept terms for each other source of the
    language.  Part "term": the terms that the group has and gives more than
    its language does, the first most_terms.

    A pair's sum is found without a row for each term and pair.  A histogram
    of each group's counts prices all its terms as if the other had none; a
    join of the terms' postings then corrects those that both have; terms that
    neither has differ by a constant.

    Null lang, source and text are ''.  Groups without terms have pairs and no
    terms; without kept terms all values are 0.  Repeated rows count as often
    as they come; ties are ranked by the item's bytes; an empty table gives no
    rows.  A text is counted whole by one task.  Only the three named columns
    are read.
    """
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], text_column)
    of_term = Window.partitionBy("lang", "term")
    counts = term_counts(named, text_column).withColumn("_in", F.sum("docs").over(of_term)).where(F.col("_in") >= least_documents)
    first = F.row_number().over(of_term.orderBy("source")) == 1
    postings = kept(counts.withColumn("all_n", F.sum("n").over(of_term)).withColumn("first", first).select("lang", "source", "term", "n", "all_n", "first"))

    langs = postings.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("all_whole"))
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("whole"), F.count(F.lit(1)).alias("support"))
    groups = named.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("v", "all_whole", "whole", "support")])
    price = lambda n, whole: F.when(F.col("v") > 0, priced(n, whole + 5 * F.col("v")))
    groups = kept(groups.withColumn("zero", price(F.lit(0), F.col("whole"))))

    rows = postings.join(groups.select("lang", "source", "v", "whole", "all_whole", "zero"), ["lang", "source"])
    rows = kept(rows.select("lang", "source", "term", "n", price(F.col("n"), F.col("whole")).alias("p"), price(F.col("all_n"), F.col("all_whole")).alias("q"), "zero"))
    dropped(postings)

    # each group's terms priced against what every other source gives a term it lacks
    steps = rows.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k")).withColumn("salt", F.pmod(F.xxhash64("source", "p"), F.lit(SALTS)).cast("int"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    sided = steps.join(others, ["lang", "salt"]).where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("k") * F.abs(F.col("p") - F.col("other"))).alias("sided"))

    # what terms of both differ by, less what they were priced at, plus once more the constant that they don't have
    one, two = rows.select("lang", "term", "source", "p", "zero"), rows.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p2"), F.col("zero").alias("zero2"))
    mend = F.abs(F.col("p") - F.col("p2")) - F.abs(F.col("p") - F.col("zero2")) - F.abs(F.col("p2") - F.col("zero")) + F.abs(F.col("zero") - F.col("zero2"))
    both = one.join(two, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(mend).alias("mend"))

    pair = groups.select("lang", "source", "v", "support", "zero").join(groups.select("lang", F.col("source").alias("item"), F.col("support").alias("support2"), F.col("zero").alias("zero2")), "lang").where("source < item")
    back = sided.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("sided").alias("back"))
    on = ["lang", "source", "item"]
    zero = lambda c: F.coalesce(c, F.lit(0))
    neither = zero((F.col("v") - F.col("support") - F.col("support2")) * F.abs(F.col("zero") - F.col("zero2")))
    value = pair.join(sided, on, "left").join(back, on, "left").join(both, on, "left").select(*on, (neither + zero("sided") + zero("back") + zero("mend")).alias("value"))
    value = kept(value)
    value = value.unionByName(value.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = value.select("lang", "source", F.lit("pair").alias("part"), "item", F.col("value").cast("long").alias("value"), place)

    above = rows.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = above.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= most_terms)
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", F.col("value").cast("long").alias("value"), "rank"))


#: The definition itself: every kept term of every pair.
SQL = r"""WITH d AS (SELECT row_number() OVER () i, coalesce(lang, '') lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w FROM documents),
 t AS MATERIALIZED (SELECT i, lang, source, unnest(w) term FROM d),
 keep AS MATERIALIZED (SELECT lang, term, count(*) q FROM t GROUP BY 1, 2 HAVING count(DISTINCT i) >= 30),
 v AS (SELECT lang, count(*)::HUGEINT v, sum(q)::HUGEINT n FROM keep GROUP BY 1),
 c AS (SELECT lang, source, term, count(*) c FROM t SEMI JOIN keep USING (lang, term) GROUP BY 1, 2, 3),
 g AS MATERIALIZED (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
 p AS MATERIALIZED (SELECT g.lang, g.source, keep.term, coalesce(c, 0) c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (g.n + 5 * v.v) p, 1 + (1000000000::HUGEINT * (keep.q + 5)) // (v.n + 5 * v.v) q
  FROM g JOIN keep ON keep.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = keep.term),
 f AS (SELECT a.lang, a.source, b.source item, sum(abs(a.p - b.p)) f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
 pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
 both_parts AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE c > 0 AND p > q)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM both_parts) WHERE part = 'pair' OR rank <= 50"""
