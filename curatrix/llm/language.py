"""Language ID by Bayesian evidence fusion.

Evidence of four kinds: the likelihood of the text under byte-trigram models of the languages; the language that the
markup declares; the suffix of the address; and the host. Priors are smoothed in levels, each by the one above: all
rows, address suffix, host. They are counts, by grouped aggregation over all rows, of the languages that the text
alone points to; so is the table of how often which language is declared for which.

The trigram models are fitted to a sample of rows by declared language, of about PER_LANGUAGE rows each. Declared codes,
region and script subtags aside, are languages if any of their rows has text with letters; but where there are more than
MOST_LANGUAGES, only those of at least as many rows as keeps them to that number. Codes of fewer rows are page data of any
number then: no evidence and no language, and their rows are judged by all else. So models take at most 128 KB times
MOST_LANGUAGES, however many codes are declared. A row that declares a language of fewer than RARE rows is scored by what
the other rows say of it, so that one mistaken declaration makes no language; if there are none, its text counts as one of
no language does, and the declaration decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatrix.llm.common import SLICE, pieces, slices, written
from curatrix.llm.mixing import unit_hash

PER_LANGUAGE = 1500
RARE = 50
MOST_LANGUAGES = 1024
BITS = 15
EFFECTIVE = 120.0  # a text counts as this many independent trigrams at most
SMOOTH = 0.05
ALPHA, BETA = 20.0, 50.0  # rows' worth of the level above in a host's and in a suffix's prior
LEAST_POSTERIOR = 0.5
UNKNOWN = "und"
LEVELS = ("lid_host", "lid_suffix", "lid_declared")
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_SAME = np.zeros(256, np.uint32)  # digits and ASCII symbols are one class: they tell no language
_SAME[[c for c in range(128) if not chr(c).isalpha()]] = 1
_CODE = np.where(_SAME == 1, 32, _LOWER).astype(np.uint32)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, bucket) of each byte trigram with a letter in it."""
    size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    b = _CODE[np.frombuffer(b"".join(texts), np.uint8)]
    if len(b) < 3:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    h = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    use = (doc[:-2] == doc[2:]) & (h != 0x202020)
    h = (h * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    return doc[:-2][use], h[use].astype(np.int64)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        total: dict[str, np.ndarray] = {}
        for x in slices([whole]):
            lang, raw = np.array(x.column("lang").to_pylist()), x.column("text").cast(pa.binary()).to_pylist()
            for i, j in pieces(raw):
                doc, h = trigrams(raw[i:j])
                for k in set(lang[i:j].tolist()):
                    total[k] = total.get(k, 0) + np.bincount(h[lang[i:j][doc] == k], minlength=1 << BITS)
        for k, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k] * len(at), pa.string()), "gram": pa.array(at.astype(np.int32)), "n": pa.array(n[at].astype(np.int64))})


class Models:
    """Log likelihoods of the languages by trigram bucket, in order of `langs`, with a last row for no language at
    all: trigrams that are all equally likely. rare: number, mass and smoothing of each language of few rows."""

    def __init__(self, langs: list[str], counts: np.ndarray, sizes: dict[str, int]) -> None:
        self.langs = langs
        smooth = SMOOTH * np.minimum(1.0, counts.sum(1) / (1 << BITS - 1))  # a tenth of a model at most, or few words would suit any text
        smooth[-1] = SMOOTH
        counts += smooth[:, None]
        mass = counts.sum(1)
        self.rare = {k: (i, float(mass[i]), float(smooth[i])) for i, k in enumerate(langs) if sizes[k] < RARE}
        self.table = np.log(counts / mass[:, None]).astype(np.float32)

    def scores(self, raw: list[bytes], declared: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods by text and language, and whether the text has a trigram."""
        out = np.zeros((len(raw), len(self.table)))
        doc, h = trigrams(raw)
        if not len(h):
            return out, np.zeros(len(raw), bool)
        ends = np.searchsorted(doc, np.arange(len(raw) + 1))
        n = np.diff(ends)
        has = np.flatnonzero(n)
        for k, row in enumerate(self.table):
            out[has, k] = np.add.reduceat(row[h].astype(np.float64), ends[:-1][has])
        for i in has.tolist() if self.rare else ():
            if declared[i] in self.rare:
                k, mass, smooth = self.rare[declared[i]]
                rest = mass - n[i]
                if rest < smooth * (1 << BITS) + 0.5:
                    out[i, k] = out[i, -1]  # there is no other row
                    continue
                gram, own = np.unique(h[ends[i] : ends[i + 1]], return_counts=True)
                left = np.maximum(np.exp(self.table[k, gram].astype(np.float64)) * mass - own, smooth)
                out[i, k] = (own * np.log(left / rest)).sum()
        out[has] *= np.minimum(1.0, EFFECTIVE / n[has])[:, None]
        return out, n > 0


def languages(rows: DataFrame) -> dict[str, int]:
    """The declared codes of rows (lang) that count as languages, with their numbers of rows: all, or those of the least
    number of rows that no more than MOST_LANGUAGES codes have or exceed."""
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    so_far = F.sum("codes").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0))
    steps = sizes.groupBy("n").agg(F.count("*").alias("codes")).withColumn("so_far", so_far)  # a row for each number of rows that codes have
    least = steps.where(F.col("so_far") <= MOST_LANGUAGES).agg(F.min("n")).first()[0]
    return {} if least is None else {r.lang: r.n for r in sizes.where(F.col("n") >= least).collect()}


def fit(rows: DataFrame, key: Column, per_language: int = PER_LANGUAGE) -> Models:
    """rows: (text, lang) with lang the declared one; key: what decides the sample."""
    rows = rows.where("lang is not null and text is not null").select("text", "lang", key.alias("key"))
    sizes = languages(rows)
    large = {k: n for k, n in sizes.items() if n > per_language}
    some = rows.where(F.col("lang").isin(list(sizes)))
    if large:
        share = F.create_map(*[F.lit(v) for k, n in sorted(large.items()) for v in (k, per_language / n)])
        some = some.where(unit_hash(F.col("key"), "fit") < F.coalesce(share[F.col("lang")], F.lit(1.0)))
    counts = some.select("text", "lang").mapInArrow(_tally, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(counts["lang"]))
    at = {k: i for i, k in enumerate(langs)}
    table = np.zeros((len(langs) + 1, 1 << BITS))
    np.add.at(table, (counts["lang"].map(at).to_numpy(np.int64), counts["gram"].to_numpy(np.int64)), counts["n"].to_numpy(np.float64))
    return Models(langs, table, sizes)


def _likeliest(sent):
    """By text alone: lid_host, lid_suffix, lid_declared and l, the number of the likeliest language. Declared codes that
    are no language are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent.value
        known = set(models.langs)
        for x in slices(batches):
            raw, declared = [t or b"" for t in x.column("lid_text").cast(pa.binary()).to_pylist()], x.column("lid_declared").to_pylist()
            best = [models.scores(raw[i:j], declared[i:j])[0].argmax(1) for i, j in pieces(raw)]
            l = pa.array(np.concatenate([np.zeros(0, np.int64), *best]).astype(np.int32))  # noqa: E741
            said = pa.array([d if d in known else None for d in declared], pa.string())
            yield pa.RecordBatch.from_arrays([x.column("lid_host"), x.column("lid_suffix"), said, l], [*LEVELS, "l"])

    return run


FOUND = "lid_lang string, lid_posterior double, lid_keep boolean"


def _fused(sent):
    """FOUND of rows of text, declared language, host, suffix and the counts of host and suffix, by all evidence."""

    def run(text: pa.Array, declared: pa.Array, host: pa.Array, suffix: pa.Array, on_host: pa.Array, on_suffix: pa.Array) -> pa.Array:
        models, whole, given = sent.value
        labels, none = np.array([*models.langs, UNKNOWN], object), np.zeros(len(whole))
        prior: dict[tuple[str, str], np.ndarray] = {}
        lang, posterior, keep = [], [], []
        for at in range(0, len(text), SLICE):
            raw = [t or b"" for t in text.slice(at, SLICE).cast(pa.binary()).to_pylist()]
            said_as = declared.slice(at, SLICE).to_pylist()
            hosts = list(zip(host.slice(at, SLICE).to_pylist(), suffix.slice(at, SLICE).to_pylist(), strict=True))
            for i, k in enumerate(hosts, at):
                if k not in prior:
                    prior[k] = _level(on_host[i].as_py(), _level(on_suffix[i].as_py(), whole, BETA), ALPHA)
            for i, j in pieces(raw):
                score, said = models.scores(raw[i:j], said_as[i:j])
                score += np.log(np.array([prior[k] for k in hosts[i:j]])) + np.array([given.get(k, none) for k in said_as[i:j]])
                best = score.argmax(1)
                p = 1 / np.exp(score - score.max(1, keepdims=True)).sum(1)
                lang += labels[best].tolist()
                posterior += p.tolist()
                keep += (said & (best < len(models.langs)) & (p >= LEAST_POSTERIOR)).tolist()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(posterior, pa.float64()), pa.array(keep, pa.bool_())], names=[c.split()[0] for c in FOUND.split(", ")])

    return F.arrow_udf(run, FOUND).asNondeterministic()  # or a filter on its result would run it once more


def _level(counts: list[dict] | None, above: np.ndarray, weight: float) -> np.ndarray:
    """The prior of counts (l, n), smoothed by the one above."""
    out = weight * above
    for c in counts or ():
        out[c["l"]] += c["n"]
    return out / (weight + sum(c["n"] for c in counts or ()))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def suffix_of(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1)


def primary(declared: Column) -> Column:
    """The language of a declaration, without region and script: en of en-US, en_GB and EN; null if there is none."""
    found = F.regexp_extract(F.lower(declared), r"^[^-_\s]+", 0)
    return F.when(found != "", found)


def markup_language(html: Column) -> Column:
    """What <html lang> says, its first part, in lower case; null if it says nothing."""
    found = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    return F.when(found != "", found)


def identify(rows: DataFrame, text: Column, declared: Column, host: Column, suffix: Column, key: Column, per_language: int = PER_LANGUAGE) -> DataFrame:
    """`rows` with lid_lang, the likeliest language ("und" if text of no language is likelier), lid_posterior and
    lid_keep: whether a language was found with a posterior of at least LEAST_POSTERIOR. Columns of these names are
    replaced; all others stay. text, declared, host and suffix are columns over `rows`; a null one is no evidence:
    so is a declared code of too few rows; an empty or null text leaves the declaration and the priors, and such a row is not kept, since its text has no
    language. Repeated rows get equal results, as do long and short texts of one make. No rows in, none out;
    without any declared language all rows are "und"."""
    rows = rows.drop("lid_lang", "lid_posterior", "lid_keep")
    return identified(rows, text, declared, host, suffix, key, per_language).select("row.*", "lid.*")


def identified(rows: DataFrame, text: Column, declared: Column, host: Column, suffix: Column, key: Column, per_language: int = PER_LANGUAGE) -> DataFrame:
    """identify() as two structs: row, all columns of `rows`, and lid, what was found."""
    spark: SparkSession = rows.sparkSession
    made = rows.select(F.struct("*").alias("row"), text.alias("lid_text"), key.alias("lid_key"), primary(declared).alias("lid_declared"), F.coalesce(host, F.lit("")).alias("lid_host"), F.coalesce(suffix, F.lit("")).alias("lid_suffix"))
    models = fit(made.select(F.col("lid_text").alias("text"), F.col("lid_declared").alias("lang"), F.col("lid_key").alias("k")), F.col("k"), per_language)
    # on texts alone: the languages each level's prior is made of
    thin = made.select("lid_text", *LEVELS).mapInArrow(_likeliest(spark.sparkContext.broadcast(models)), "lid_host string, lid_suffix string, lid_declared string, l int")
    counts = written(thin.groupBy(*LEVELS, "l").agg(F.count("*").alias("n")), "counts")
    whole = np.ones(len(models.table))
    said = {k: np.ones(len(whole)) for k in models.langs}  # P(declared | language), one row's worth of doubt for each
    for r in counts.groupBy("lid_declared", "l").agg(F.sum("n").alias("n")).collect():
        whole[r.l] += r.n
        if r.lid_declared in said:
            said[r.lid_declared][r.l] += r.n
    total = np.sum(list(said.values()), axis=0)
    given = {k: np.log(v / total) for k, v in said.items()}
    level = lambda name, *by: counts.groupBy(*by, "l").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.collect_list(F.struct("l", "n")).alias(name))
    hosts = level("lid_on_host", "lid_host", "lid_suffix").join(level("lid_on_suffix", "lid_suffix"), "lid_suffix")
    # its size is known from now on, so Spark broadcasts it only if it is small
    hosts = written(hosts.select(F.col("lid_host").alias("lid_h"), F.col("lid_suffix").alias("lid_s"), "lid_on_host", "lid_on_suffix"), "hosts")
    rows = made.join(hosts, (made["lid_host"] == hosts["lid_h"]) & (made["lid_suffix"] == hosts["lid_s"]), "left")
    fused = _fused(spark.sparkContext.broadcast((models, whole / whole.sum(), given)))
    return rows.select("row", fused("lid_text", "lid_declared", "lid_host", "lid_suffix", "lid_on_host", "lid_on_suffix").alias("lid"))


def identify_documents(docs: DataFrame) -> DataFrame:
    """identify over documents: `lang` is the declared language, `source` the host; there is no address."""
    return identify(docs, F.col("text"), F.col("lang"), F.col("source"), F.lit(None).cast("string"), F.col("doc_id"))


def known_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs` of which identify_documents() keeps the language, with all their columns."""
    found = identified(docs, F.col("text"), F.col("lang"), F.col("source"), F.lit(None).cast("string"), F.col("doc_id"))
    return found.where("lid.lid_keep").select("row.*")


def identify_pages(pages: DataFrame) -> DataFrame:
    """identify over pages: language of the markup, host and suffix of the address, text without tags."""
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)", " "), r"<[^>]*(?:>|\z)", " ")  # what has no end goes to that of the page: linear
    host = host_of(F.col("url"))
    return identify(pages, text, markup_language(F.col("html")), host, suffix_of(host), F.col("page_id"))


def op7_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return identify_documents(docs).select("doc_id", F.col("lid_lang").alias("language"), F.round("lid_posterior", 6).alias("posterior"), F.col("lid_keep").alias("kept"))


def language_of_pages(spark, sf_dir: str) -> DataFrame:
    pages = identify_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return pages.select("page_id", "url", F.col("lid_lang").alias("language"), F.round("lid_posterior", 6).alias("posterior"), F.col("lid_keep").alias("kept"))
