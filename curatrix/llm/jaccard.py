"""N-gram Jaccard join with PartEnum signatures.

Sets fall in size bands whose ends are a factor of the similarity apart, so that similar sets lie in one band or in
neighbouring ones. Within a pair of bands, sets as similar as asked differ in at most k elements. Elements are
dealt over n1 partitions such that one of them holds at most k2 differences, each partition over n2 parts, of which
n2 - k2 then agree: each choice of so many parts of a partition makes a signature, and similar sets share one.

Few differences allow all choices from a single partition (n1 = 1, k2 = k); more take k2 = 2 of 5, or k2 = 1 of 3 (of 2 under 0.9).
Under a similarity of 0.9 parts hold few elements, and signatures of fewer than LEAST would join sets that have
nothing in common. Up to MIDDLE differences such a signature is paired with each signature of a second family, a part
for each difference and one more, that is complete by itself: similar sets share one of these too, so no pair is
missed. Beyond, small signatures are left out, and up to LARGE differences a second family of them is added. Sets at
the threshold agree in over a third of their parts, and a pair is missed only if each of those is so small: a chance of
at most one in a billion (with 31 differences two in a hundred thousand by each family, with 60 one in a billion, and
ever less beyond). At 0.9 or more, and under 0.75, no signature is left out.

Sets that share signatures form clusters, usually of a few documents. Within a cluster all intersections are
counted as products of 0/1 matrices. A cluster of more than BLOCK sets or ELEMENTS elements is dealt to a task per pair
of blocks, of one size band or of neighbouring ones: other sizes can't be similar. A block has about so many sets and
elements at most, or a single larger set, so long texts don't fill a task. Equal sets are one node throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import connected, joined, mixed, packs, paired, partitions, pieces, slices, spread, windows_of, words_of, written
from curatrix.llm.embeddings import forest

BLOCK = 512
ELEMENTS = 2 << 20
FULL, MIDDLE, LARGE = 10, 30, 60
_OTHER = np.uint64(0x5851F42D4C957F2D)  # makes the second family
LEAST = 3
COLUMNS = 4096
_BAND = 1 << 20  # a block's number is that of its size band times this, and its own


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, shingle) of each distinct shingle, sorted; at most 4096 texts. A-Z count as a-z; a text
    with fewer words has its whole sequence as one shingle, one without words none."""
    data, at = joined(texts)
    start, _, word = words_of(data, lower=True)
    doc = np.searchsorted(at, start, "right") - 1
    h = windows_of(word, words)
    of = doc[: len(h)]
    whole = of == doc[words - 1 :] if len(h) else np.zeros(0, bool)
    docs, sets = [of[whole]], [h[whole]]
    count = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    first = np.cumsum(count) - count
    for size in range(1, words):
        short = np.flatnonzero(count == size)
        if len(short):
            h = windows_of(word, size)[first[short]]
            docs.append(short)
            sets.append(paired(h, h, size))
    doc, h = np.concatenate(docs).astype(np.uint16), np.concatenate(sets)
    order = np.argsort(h)
    order = order[np.argsort(doc[order], kind="stable")]
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new].astype(np.int64), h[new]


def _sums(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Sum of h by doc (sorted), modulo 2**64."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h, out=total[1:])
    ends = np.searchsorted(doc, np.arange(n + 1))
    return total[ends[1:]] - total[ends[:-1]]


def _describe(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches):
            raw = x.column("text").cast(pa.binary()).to_pylist()
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
            for i, j in pieces(raw, most=4096):
                doc, h = shingle_sets(raw[i:j], words)
                out[0].append(np.bincount(doc, minlength=j - i).astype(np.int64))
                out[1].append(_sums(doc, mixed(h), j - i).view(np.int64))
                out[2].append(_sums(doc, mixed(h + np.uint64(1 << 60)), j - i).view(np.int64))
            yield pa.RecordBatch.from_pydict({"doc_id": x.column("doc_id"), **{c: pa.array(np.concatenate(v)) for c, v in zip(("n", "s1", "s2"), out, strict=True)}})

    return run


def bands_for(largest: int, percent: int) -> list[int]:
    """First size of each band, up to one beyond that of `largest`."""
    out = [1]
    while out[-1] <= largest:
        out.append(out[-1] * 100 // percent + 1)
    return [*out, out[-1] * 100 // percent + 1]


def signatures(doc: np.ndarray, h: np.ndarray, n_docs: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, signature); texts with empty sets have none."""
    size = np.bincount(doc, minlength=n_docs)
    bands = np.array(bands_for(int(size.max(initial=1)), percent))
    band = np.searchsorted(bands, size, "right") - 1
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for of in (band, band + 1):  # each band is joined with itself and with the one below
        k = 2 * (bands[of + 1] - 1) * (100 - percent) // (100 + percent)
        kind = np.where(size == 0, -1, np.where(k <= FULL, k, FULL + 1 + (k > MIDDLE) + (k > LARGE)))
        for c in np.unique(kind[kind >= 0]).tolist():
            mine = np.flatnonzero(kind == c)
            use = (kind == c)[doc]
            place = np.zeros(n_docs, np.int64)
            place[mine] = np.arange(len(mine))
            least = LEAST if c > FULL and 75 <= percent < 90 else 0
            k2, n2 = (c, c + 3) if c <= FULL else (2, 5) if c == FULL + 1 else (1, 2 if least else 3)
            n1 = np.ones(len(mine), np.int64) if c <= FULL else k[mine] // (k2 + 1) + 1
            who, sig, full = _choices(place[doc[use]], h[use], of[mine], n1, n2, k2, least)
            if least and c == FULL + 1:
                _, second, _ = _choices(place[doc[use]], h[use] ^ _OTHER, of[mine], k[mine] + 1, 1, 0, 0)
                few, parts = np.flatnonzero(~full), k[mine] + 1
                ends = np.cumsum(parts) - parts  # the second family's signatures come by text
                pick = np.repeat(few, parts[who[few]])
                inner = np.arange(len(pick)) - np.repeat(np.cumsum(parts[who[few]]) - parts[who[few]], parts[who[few]])
                out.append((mine[who[pick]], paired(sig[pick], second[ends[who[pick]] + inner])))
            out.append((mine[who[full]], sig[full]))
            if least and c == FULL + 2:
                who, sig, full = _choices(place[doc[use]], h[use] ^ _OTHER, of[mine], n1, n2, k2, least)
                out.append((mine[who[full]], ~sig[full]))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _choices(doc: np.ndarray, h: np.ndarray, band: np.ndarray, n1: np.ndarray, n2: int, k2: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, signature, whether of `least` elements): for each partition each choice of n2 - k2 of its
    parts; those of one choice by text."""
    at = np.cumsum(n2 * n1) - n2 * n1
    salted = mixed(h + (band[doc] + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    part = n2 * ((salted >> np.uint64(32)) % n1[doc].astype(np.uint64)).astype(np.int64) + (salted % np.uint64(n2)).astype(np.int64)
    total, count = np.zeros((2, int(n2 * n1.sum())), np.uint64)
    np.add.at(total, at[doc] + part, mixed(salted + np.uint64(17)))
    if least:
        count += np.bincount(at[doc] + part, minlength=len(count)).astype(np.uint64)
    total, count = total.reshape(-1, n2), count.reshape(-1, n2)
    owner = np.repeat(np.arange(len(n1)), n1)
    place = paired(band[owner].astype(np.uint64), np.arange(len(owner), dtype=np.uint64) - np.repeat(at // n2, n1).astype(np.uint64))
    out = []
    for i, chosen in enumerate(combinations(range(n2), n2 - k2)):
        sig = paired(place + np.uint64(i), mixed(total[:, chosen].sum(1, dtype=np.uint64)))
        out.append((owner, sig, count[:, chosen].sum(1) >= least if least else np.ones(len(sig), bool)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _sign(words: int, percent: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets sign once a task
        for whole in slices(batches, 2048):
            sigs, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for x in slices([whole]):
                raw = x.column("text").cast(pa.binary()).to_pylist()
                for i, j in pieces(raw, most=4096):
                    doc, h = shingle_sets(raw[i:j], words)
                    node = _sums(doc, mixed(h), j - i).view(np.int64)
                    fresh = np.zeros(j - i, bool)
                    for k, s in enumerate(node.tolist()):
                        if s not in seen:
                            seen.add(s)
                            fresh[k] = True
                    use = fresh[doc]
                    of, sig = signatures(doc[use], h[use], j - i, percent)
                    sigs.append(sig)
                    nodes.append(node[of])
            s, n = np.concatenate(sigs), np.concatenate(nodes)
            bucket = spread(s, parts)
            order = np.lexsort((n, bucket))
            bucket, n = bucket[order], n[order]
            new = np.ones(len(n), bool)
            new[1:] = (n[1:] != n[:-1]) | (bucket[1:] != bucket[:-1])
            start = np.flatnonzero(new)
            runs = packs(bucket[start], {"node": n[start], "count": np.diff(np.append(start, len(n))).astype(np.int32)})  # a node once for all its signatures
            yield pa.RecordBatch.from_pydict(packs(bucket, {"sig": s[order]}) | {c: runs[c] for c in ("node", "count")})

    return run


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the signatures that two nodes share, edges that join all their nodes."""
    sigs, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for x in batches:
        for s, n, c in zip(*(x.column(k).to_pylist() for k in ("sig", "node", "count")), strict=True):
            sigs.append(np.frombuffer(s, np.uint64))
            nodes.append(np.repeat(np.frombuffer(n, np.int64), np.frombuffer(c, np.int32)))
    sig, node = np.concatenate(sigs), np.concatenate(nodes)
    order = np.argsort(sig)
    sig, node = sig[order], node[order]
    same = np.flatnonzero((sig[1:] == sig[:-1]) & (node[1:] != node[:-1]))
    a, b = forest(node[same], node[same + 1])
    yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})


VERIFIED = "a long, b long, links long"


def _verify(words: int, percent: int):
    def linked(sets: list[np.ndarray], x: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(s) for s in sets])
        row = np.repeat(np.arange(len(sets)), size)
        _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        use = count[col] > 1  # an element of one set alone is in no intersection
        cols, col = np.unique(col[use], return_inverse=True)
        row = row[use]
        left, right = (np.flatnonzero(x == x.min()), np.flatnonzero(x != x.min())) if across else (np.arange(len(sets)),) * 2
        back = [np.full(len(sets), -1) for _ in range(2)]
        back[0][left], back[1][right] = np.arange(len(left)), np.arange(len(right))
        both = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for c in range(0, len(cols), COLUMNS):
            s, e = np.searchsorted(col, (c, c + COLUMNS))
            mats = []
            for side, n in ((back[0], len(left)), (back[1], len(right))):
                m = np.zeros((n, min(COLUMNS, len(cols) - c)), np.float32)
                r = side[row[s:e]]
                m[r[r >= 0], col[s:e][r >= 0] - c] = 1
                mats.append(m)
            both += mats[0] @ mats[1].T
        inter = both.astype(np.int64)
        hit = 100 * inter >= percent * (size[left][:, None] + size[right][None, :] - inter)
        if not across:
            hit &= np.arange(len(sets))[:, None] < np.arange(len(sets))[None, :]
        i, j = np.nonzero(hit)
        return left[i], right[j]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cluster", "ascending"), ("bi", "ascending"), ("bj", "ascending"), ("doc_id", "ascending")])
        cols = table.select(["cluster", "bi", "bj", "x", "doc_id", "n_rows"]).to_pydict()
        raw = table.column("text").cast(pa.binary()).to_pylist()
        key = list(zip(cols["cluster"], cols["bi"], cols["bj"], strict=True))
        a, b, links = [], [], []
        at = 0
        while at < len(key):
            end = at + 1
            while end < len(key) and key[end] == key[at]:
                end += 1
            pick = [i for i in range(at, end) if i == at or cols["doc_id"][i] != cols["doc_id"][i - 1]]
            sets: list[np.ndarray] = []
            for i, j in pieces([raw[k] for k in pick], most=4096):
                doc, h = shingle_sets([raw[k] for k in pick[i:j]], words)
                sets += np.split(h, np.searchsorted(doc, np.arange(1, j - i)))
            ids, n = np.array([cols["doc_id"][k] for k in pick], np.int64), np.array([cols["n_rows"][k] for k in pick], np.int64)
            x = np.array([cols["x"][k] for k in pick])
            across = key[at][1] != key[at][2]
            if len(pick) > 1 and not (across and len(set(x.tolist())) < 2):
                i, j = linked(sets, x, across)
                total = np.zeros(len(ids), np.int64)
                np.add.at(total, i, n[j])
                np.add.at(total, j, n[i])
                lower = forest(ids[i], ids[j])
                a += [*lower[0].tolist(), *ids[total > 0].tolist()]
                b += [*lower[1].tolist(), *ids[total > 0].tolist()]
                links += [0] * len(lower[0]) + total[total > 0].tolist()
            at = end
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array(links, pa.int64())})

    return run


def _block(band: Column, number: Column) -> Column:
    return band * _BAND + number


def _pair(x: Column, y: Column) -> Column:
    return F.struct(F.least(x, y).cast("long").alias("bi"), F.greatest(x, y).cast("long").alias("bj"))


def _partners(x: Column, band: Column, blocks: Column) -> Column:
    """The pairs of blocks that block x takes part in: with those of its own size band and of the two next to it."""
    of = lambda b: F.when(blocks[b].isNotNull(), F.transform(F.sequence(F.lit(0), blocks[b] - 1), lambda y: _pair(x, _block(b, y)))).otherwise(F.array().cast("array<struct<bi: bigint, bj: bigint>>"))
    return F.concat(of(band - 1), of(band), of(band + 1))


def jaccard_join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of `docs` (doc_id, text): the size of its set of
    `words`-word shingles, the smallest doc_id reachable by links, and how many other rows it links with. Rows link
    when the Jaccard similarity of their sets is at least `percent` in 100, in whole numbers; the module says when a pair may be missed. A-Z
    count as a-z; fewer words make one shingle. Null and empty texts have empty sets and link with nothing, nor do
    rows without doc_id, whose component is null. Equal rows link with each other; two texts under one doc_id count
    as one document. Other columns are ignored. No rows in, none out."""
    n_part = partitions(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    info = written(rows.mapInArrow(_describe(words), "doc_id long, n long, s1 long, s2 long"), "sets")
    classes = info.where("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_rows"), F.max("n").alias("n"))
    sent = rows.where("doc_id is not null").mapInArrow(_sign(words, percent, n_part), "bucket int, sig binary, node binary, count binary")
    shared = sent.repartitionById(n_part, "bucket").mapInArrow(_candidates, "a long, b long")
    clusters = connected(shared).withColumnRenamed("id", "s1").withColumnRenamed("component", "cluster")
    members = classes.join(clusters, "s1").withColumn("band", F.floor(F.log("n") / (math.log(100 / percent) * 1.000001)).cast("long"))
    bands = members.groupBy("cluster", "band").agg(F.count("*").alias("m"), F.sum("n").alias("size"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.least(F.col("size") / ELEMENTS, F.col("m"))))
    whole = bands.groupBy("cluster").agg(F.sum("m").alias("m"), F.sum("size").alias("size"), F.map_from_entries(F.collect_list(F.struct("band", blocks.alias("blocks")))).alias("blocks"))  # bands are as many as a set's size has places
    whole = whole.select("cluster", F.when((F.col("m") > BLOCK) | (F.col("size") > ELEMENTS), F.col("blocks")).alias("blocks"))
    members = members.join(whole, "cluster").select(F.col("rep").alias("doc_id"), "cluster", "n_rows", "band", "blocks")
    placed = rows.join(members, "doc_id").withColumn("x", _block(F.col("band"), F.pmod(F.xxhash64("doc_id"), F.col("blocks")[F.col("band")])))
    placed = placed.withColumn("pair", F.explode(F.when(F.col("blocks").isNull(), F.array(_pair(F.lit(0), F.lit(0)))).otherwise(_partners(F.col("x"), F.col("band"), F.col("blocks")))))
    placed = placed.select("doc_id", "text", "n_rows", "cluster", F.coalesce("x", F.lit(0)).alias("x"), "pair.bi", "pair.bj", F.col("blocks").isNull().alias("alone"))
    group = F.when(F.col("alone"), F.pmod(F.xxhash64("cluster"), F.lit(8 * n_part))).otherwise(F.xxhash64("cluster", "bi", "bj"))
    found = written(placed.withColumn("task", group).drop("alone").groupBy("task").applyInArrow(_verify(words, percent), VERIFIED), "links")
    links = found.where("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    part = connected(found.where("links = 0").select("a", "b")).withColumnRenamed("id", "rep")
    classes = classes.drop("n").join(links, "rep", "left").join(part, "rep", "left").withColumnsRenamed({"s1": "c1", "s2": "c2"})
    on = (info["s1"] == classes["c1"]) & (info["s2"] == classes["c2"]) & info["doc_id"].isNotNull() & (info["n"] > 0)
    return info.join(classes, on, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("n_rows") - 1, F.lit(0))).cast("long").alias("n_links"),
    )


def op6_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), words=3, percent=90)


def jaccard_sql(table: str, words: int, percent: int) -> str:
    """jaccard_join over `table` as DuckDB SQL."""
    return rf"""
    WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {table}),
    sets AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i:i + {words} - 1], ' ')) END) AS s FROM words)),
    size AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
    links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
        JOIN size x ON x.doc_id = a.doc_id JOIN size y ON y.doc_id = b.doc_id
        GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= {percent} * (x.n + y.n - count(*))),
    reach AS (SELECT doc_id AS id, doc_id AS other FROM {table} UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
    part AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
    degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY 1)
    SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links
    FROM words w LEFT JOIN size USING (doc_id) LEFT JOIN part ON id = w.doc_id LEFT JOIN degree ON a = w.doc_id"""


OP6_SQL = jaccard_sql("documents", 3, 90)
