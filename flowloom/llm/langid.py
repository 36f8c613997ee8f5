"""Language identification: text, declared language, address and host weighed together by Bayes' rule."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import groups_of, kept

BITS = 16
#: What is not text in a page.  A block that nothing closes goes to the end; no tag goes beyond the next one.
HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript)\b.*?(?:</\1\s*>|\Z)|<[^<>]*>", re.S | re.I)
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[*range(33, 65), *range(91, 97), *range(123, 127), *range(9, 14)]] = 32  # digits and marks count as blanks


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed three-byte windows of all texts, and where each text's begin."""
    raw = [b" " + t.encode() + b"  " if t else b"   " for t in texts]
    x = _FOLD[np.frombuffer(b"".join(raw), np.uint8)]
    h = ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    return h.astype(np.int64), np.cumsum([0, *map(len, raw)])


def gram_model(docs: DataFrame, languages: list[str], folds: int, text_column: str, lang_column: str, id_column: str) -> np.ndarray:
    """Log probability of each hashed window in each language, from all labelled texts."""
    place = {k: i for i, k in enumerate(languages)}

    def work(batches):
        counts = np.zeros((len(place), 1 << BITS), np.int64)
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in groups_of(texts):
                h, begin = grams(texts[lo:hi])
                which = np.repeat([place.get(k, -1) for k in langs[lo:hi]], np.diff(begin))[: len(h)]
                for k in range(len(place)):
                    counts[k] += np.bincount(h[which == k], minlength=1 << BITS)
        lang, gram = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(gram, pa.int32()), pa.array(counts[lang, gram], pa.int64())], names=["lang", "gram", "n"])

    rows = docs.where(F.coalesce(F.crc32(F.col(id_column).cast("string")) % folds != 0, F.lit(True))) if folds else docs
    rows = rows.select(F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang")).where(F.col("lang").isin(languages))
    table = np.zeros((len(languages), 1 << BITS))
    sums = rows.mapInArrow(work, "lang int, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # at most languages * 2 ** BITS sums; an iterator runs one job a partition, so they come in a few
    for r in sums.repartition(8).toLocalIterator():
        table[r.lang, r.gram] = r.n
    return np.log((table + 0.05) / (table + 0.05).sum(1, keepdims=True))


def evidence(rows: DataFrame, model: np.ndarray, languages: list[str], most_weight: float) -> DataFrame:
    """The columns of rows but text, and ll: each language's log likelihood of the text.

    Neighbouring windows overlap and are no independent witnesses, so a text
    counts as one of at most most_weight windows.
    """

    def work(batches):
        m = np.ascontiguousarray(model.T)
        for b in batches:
            texts, at = b.column(b.schema.get_field_index("text")).to_pylist(), b.schema.get_field_index("text")
            for lo, hi in groups_of(texts):
                h, begin = grams([HIDDEN.sub(" ", t) if t and "<" in t else t for t in texts[lo:hi]])
                sums = np.add.reduceat(np.concatenate([m[h], np.zeros((2, m.shape[1]))]), begin[:-1], axis=0)
                n = np.maximum(1, np.diff(begin) - 2)
                ll = sums / n[:, None] * np.minimum(n / 3, most_weight)[:, None]
                ll -= ll.max(1, keepdims=True)
                ll[[not t for t in texts[lo:hi]]] = 0
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns) if i != at), pa.array(list(ll), pa.list_(pa.float64()))], names=[*(f.name for f in part.schema if f.name != "text"), "ll"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + ", ll array<double>"
    return rows.mapInArrow(work, schema)


def normal(logs: Column) -> Column:
    """Probabilities of logs."""
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def fused(rows: DataFrame, languages: list[str], host_weight: float = 5.0, strength: float = 2.0) -> DataFrame:
    """rows (ll, declared, suffix, host, domain) with the posterior: text, declared language, suffix and host prior.

    How far a declared language or a suffix is to be believed is what the text
    says where it stands, by grouped sums of posteriors.  A host's prior is its
    own sums with the domain's as strength pseudo-counts, the domain's with the
    whole table's; a row's own part is taken out of its host's sums.
    """
    k = len(languages)
    rows = kept(rows.withColumn("own", normal(F.col("ll"))))
    sums = lambda p="own": [F.sum(F.col(p)[i]).alias(f"n{i}") for i in range(k)]
    listed = F.array(*[F.col(f"n{i}") for i in range(k)])
    whole = rows.agg(*sums()).first()
    whole = [(x or 0.0) + 1.0 for x in whole]
    overall = F.array(*[F.lit(x / sum(whole)) for x in whole])
    for name in ("declared", "suffix"):
        table = rows.where(F.col(name).isNotNull()).groupBy(name).agg(*sums()).select(name, listed.alias("n"))
        # log P(value | language), up to a term that all languages share
        weigh = F.zip_with(F.col("n"), F.array(*[F.lit(x) for x in whole]), lambda a, b: F.log((a + 0.5) / (b + 0.5 * k)))
        rows = rows.join(table.select(name, weigh.alias(f"l_{name}")), name, "left")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    domain = rows.where("domain is not null").groupBy("domain").agg(*sums()).select("domain", listed.alias("dn"))
    host = rows.where("host is not null").groupBy("host", "domain").agg(*sums()).select("host", "domain", listed.alias("hn"))
    prior = F.zip_with(F.col("dn"), overall, lambda n, p: (n + strength * p) / (total(F.col("dn")) + strength))
    # written, so that Spark knows its size and can split the join at a host of very many rows; rows without host are spread
    host = kept(host.join(domain, "domain", "left").select(F.col("host").alias("_host"), "hn", F.coalesce(prior, overall).alias("dp")))
    rows = rows.join(host, F.coalesce("host", F.concat(F.lit("\u0000"), F.xxhash64("id").cast("string"))) == F.col("_host"), "left")
    less = F.zip_with("hn", "own", lambda n, o: F.greatest(n - o, F.lit(0.0)))
    of_host = F.zip_with(less, F.col("dp"), lambda n, p: F.log((n + host_weight * p) / (total(less) + host_weight)))
    logs = plus(F.col("ll"), F.coalesce(of_host, F.transform(overall, lambda x: F.log(x))))
    for name in ("declared", "suffix"):
        logs = plus(logs, F.coalesce(F.col(f"l_{name}"), F.array(*[F.lit(0.0)] * k)))
    return rows.withColumn("posterior", normal(logs))


def answer(posterior: Column, languages: list[str]) -> tuple[Column, Column]:
    best = F.array_max(posterior)
    return F.element_at(F.array(*[F.lit(x) for x in languages]), F.array_position(posterior, best).cast("int")), best


def page_languages(pages: DataFrame, labelled: DataFrame, languages: tuple[str, ...] = ("de", "en", "es", "fr"), most_weight: float = 60.0, folds: int = 0, id_column: str = "page_id") -> DataFrame:
    """(page_id, host, declared, suffix, text_lang, lang, probability) for each page (page_id, url, html).

    The text model is learned from labelled (doc_id, text, lang).  declared is
    the lang attribute of the html tag, suffix the last label of the host, host
    and domain (its last two labels) come from the url.  A null or broken url
    has no host and gets the overall prior; null and empty pages have flat text
    evidence.  Ties take the first language.  Repeated rows give rows each, and
    null ids stay.  Long pages are read whole, in time in proportion to their
    length; a comment or script that nothing closes goes to the page's end.  With no labelled text every language is as likely.
    """
    languages = sorted(languages)
    model = gram_model(labelled, languages, folds, "text", "lang", "doc_id")
    host = F.lower(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col("html").cast("string").alias("text"), F.when(host != "", host).alias("host"), F.lower(F.regexp_extract("html", r"(?is)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1)).alias("declared"))
    rows = rows.withColumn("declared", F.when(F.col("declared") != "", F.col("declared"))).withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).withColumn("suffix", F.regexp_extract("host", r"([^.]+)$", 1))
    out = fused(evidence(rows, model, languages, most_weight), languages)
    text_lang, _ = answer(F.col("own"), languages)
    lang, p = answer(F.col("posterior"), languages)
    return out.select(F.col("id").alias(id_column), "host", "declared", "suffix", text_lang.alias("text_lang"), lang.alias("lang"), p.alias("probability"))


def document_languages(docs: DataFrame, languages: tuple[str, ...] = ("de", "en", "es", "fr"), most_weight: float = 60.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, found, probability, text_probability) and the columns in keep for documents (doc_id, text, lang, source).

    The declared language is lang and the host is source; there is no suffix.
    text_probability is the text's alone for the language found.  Null texts
    have flat evidence; repeated rows and null ids give rows of their own.
    """
    languages = sorted(languages)
    model = gram_model(docs, languages, 0, "text", "lang", "doc_id")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), F.lower(F.col("lang").cast("string")).alias("declared"), F.col("source").cast("string").alias("host"), *[F.col(c).alias(f"k{j}") for j, c in enumerate(keep)])
    rows = rows.withColumn("domain", F.col("host")).withColumn("suffix", F.lit(None).cast("string"))
    out = fused(evidence(rows, model, languages, most_weight), languages)
    found, p = answer(F.col("posterior"), languages)
    mine = F.element_at(F.col("own"), F.array_position(F.array(*[F.lit(x) for x in languages]), found).cast("int"))
    return out.select(F.col("id").alias("doc_id"), found.alias("found"), p.alias("probability"), mine.alias("text_probability"), *[F.col(f"k{j}").alias(c) for j, c in enumerate(keep)])
