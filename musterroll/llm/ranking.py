"""Ranked lexical search with per-term geometric blocking.

Documents are dealt out by hash into shards of about as many postings each.
Within a shard every posting list is clustered by document similarity: some of
its documents stand as representatives, and each document joins the one whose
projected term vector is nearest.  A cluster is a block, and its summary is the
greatest value that any of its documents has in each coordinate, so query times
summary is never below the score of a document in the block.  A block is
skipped only if that bound is below the k-th best score known for the query;
documents of other blocks are scored exactly.

Terms are walked from the rarest to the commonest.  A document that holds an
earlier term of the query has been scored, or skipped by a bound on its whole
score, when a later list meets it again; so bounds need the coordinates from
the walked term on only, and a query ends when all that is left can't reach its
k-th best score.

A first few shards are searched from nothing.  The k-th best scores that they
give are exact floors for all other shards.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from musterroll.llm.common import UPPER, term_table, text_bytes
from musterroll.runtime import written

# The terms of a text, and what is drawn from their counts.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WEIGHT = "CAST(floor(1000 * ln((2 * {N} + 2) / (2 * df + 1))) AS BIGINT)"
_LENGTH = "(100 - 75 + ((75 * n * {N}) {div} {L}))"
_PART = "((1000000000 * tf) {div} (1000 * tf + 8 * {m}))"

_TABLE = term_table(digits=True)
_ROWS = 1 << 17  # postings of an Arrow batch


@dataclass(frozen=True)
class Settings:
    k: int = 10
    shard_postings: int = 500_000  # held by one task
    block: int = 16  # documents of a block, on average
    dimensions: int = 16  # of projected vectors, which only choose the blocks
    query_postings: int = 1_000_000  # terms of the queries that are broadcast at once (16 bytes each)


def _term_rows(texts: DataFrame) -> DataFrame:
    """``row, id, n, term, tf`` for each term of ``texts (row, id, raw)``, and one with term '' per text that has terms."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            terms: list[bytes] = []
            counts: list[int] = []

            def flush() -> pa.RecordBatch:
                sizes = [h[3] for h in held]
                cols = [pa.array([h[i] for h in held], pa.int64()).take(pa.array(np.repeat(np.arange(len(held)), sizes))) for i in range(3)]
                out = [*cols, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())]
                return pa.record_batch(out, names=["row", "id", "n", "term", "tf"])

            for row, key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = raw.as_py().translate(_TABLE).split()
                if not words:
                    continue
                found = Counter(words)
                held.append((row, key, len(words), len(found) + 1))
                terms.append(b"")
                terms.extend(found)
                counts.append(0)
                counts.extend(found.values())
                if len(terms) >= _ROWS:
                    yield flush()
                    held, terms, counts = [], [], []
            if held:
                yield flush()

    return texts.mapInArrow(rows, "row bigint, id bigint, n bigint, term string, tf bigint")


def _numbered(table: DataFrame, key: str) -> DataFrame:
    row = F.monotonically_increasing_id().alias("row")
    return table.select(row, F.col(key).cast("bigint").alias("id"), text_bytes(F.col("text")).alias("raw"))


# --- one shard -------------------------------------------------------------------


class Shard:
    """Postings of some documents, by document and by term.

    Documents are numbered in the order that breaks ties; terms are numbered
    from the rarest to the commonest.
    """

    def __init__(self, doc: np.ndarray, term: np.ndarray, part: np.ndarray, settings: Settings):
        self.settings = settings
        known, index, sizes = np.unique(term, return_inverse=True, return_counts=True)
        order = np.argsort(sizes, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.terms, self.n_terms, self.n_docs = known[order], len(known), int(doc.max()) + 1 if len(doc) else 0
        t = rank[index]
        by_doc = np.lexsort((t, doc))
        self.doc, self.term, self.part = doc[by_doc], t[by_doc], part[by_doc]
        self.key = self.doc * self.n_terms + self.term  # sorted
        by_term = np.argsort(self.term, kind="stable")
        self.list_docs, self.list_at = self.doc[by_term], by_term
        self.list_start = np.concatenate([[0], np.cumsum(np.bincount(self.term, minlength=self.n_terms))])
        self.doc_end = np.cumsum(np.bincount(self.doc, minlength=self.n_docs))
        self.greatest = np.zeros(self.n_terms, np.int64)
        np.maximum.at(self.greatest, self.term, self.part)

    def projected(self, weight: np.ndarray) -> np.ndarray:
        """Unit vectors of few dimensions, one per document: sums of a random direction per term."""
        dims = self.settings.dimensions
        directions = np.random.default_rng(7).standard_normal((self.n_terms, dims)).astype(np.float32)
        directions *= weight[:, None].astype(np.float32) / 1e6
        out = np.zeros((self.n_docs, dims), np.float32)
        for d in range(dims):
            out[:, d] = np.bincount(self.doc, directions[self.term, d] * self.part, minlength=self.n_docs)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def blocks(self, t: int, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a term's list in block order, and where each block starts."""
        docs = self.list_docs[self.list_start[t] : self.list_start[t + 1]]
        n = -(-len(docs) // self.settings.block)
        if n < 2:
            return docs, np.zeros(1, np.int64)
        heads = vectors[docs[np.arange(n) * len(docs) // n]]
        nearest = np.concatenate([np.argmax(vectors[docs[i : i + 4096]] @ heads.T, axis=1) for i in range(0, len(docs), 4096)])
        order = np.argsort(nearest, kind="stable")
        return docs[order], np.flatnonzero(np.diff(nearest[order], prepend=-1))

    def summaries(self, t: int, docs: np.ndarray, starts: np.ndarray, column: np.ndarray, width: int) -> np.ndarray:
        """Greatest value per block and coordinate, of the coordinates from ``t`` on that have a column."""
        first = np.searchsorted(self.key, docs * self.n_terms + t)
        sizes = self.doc_end[docs] - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        block = np.repeat(np.searchsorted(starts, np.arange(len(docs)), side="right") - 1, sizes)
        col = column[self.term[at]]
        used = col >= 0
        out = np.zeros(len(starts) * width, np.int64)
        np.maximum.at(out, block[used] * width + col[used], self.part[at[used]])
        return out.reshape(len(starts), width)

    def scores(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact sums of weight times value over some terms."""
        keys = docs[:, None] * self.n_terms + terms[None, :]
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return np.where(self.key[at] == keys, self.part[at], 0) @ weights


def search(shard: Shard, queries: list[tuple[np.ndarray, np.ndarray]], floors: np.ndarray, k: int) -> tuple[list, tuple[int, int]]:
    """The best documents of each query as (query, documents, scores), and how many blocks were met and skipped.

    A query is its terms as numbers of the shard, ascending, and their weights.
    Documents below the query's floor are left out.
    """
    weight = np.zeros(shard.n_terms, np.int64)
    users: dict[int, list[int]] = {}
    for q, (terms, weights) in enumerate(queries):
        np.maximum.at(weight, terms, weights)
        for t in terms.tolist():
            users.setdefault(t, []).append(q)
    rest = [np.cumsum((w * shard.greatest[t])[::-1])[::-1] for t, w in queries]
    bar = np.maximum(floors, 1)  # a score of 0 is no result
    seen = [np.zeros(0, np.int64) for _ in queries]
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
    vectors, column = shard.projected(weight), np.full(shard.n_terms, -1, np.int64)
    met = skipped = 0
    for t in sorted(users):
        at = {q: int(np.searchsorted(queries[q][0], t)) for q in users[t]}
        live = [q for q in users[t] if rest[q][at[q]] >= bar[q]]
        if not live:
            continue
        docs, starts = shard.blocks(t, vectors)
        wanted = np.unique(np.concatenate([queries[q][0][at[q] :] for q in live]))
        column[wanted] = np.arange(len(wanted))
        summary = shard.summaries(t, docs, starts, column, len(wanted))
        ends = np.append(starts[1:], len(docs))
        for q in live:
            terms, weights = queries[q][0][at[q] :], queries[q][1][at[q] :]
            bound = summary[:, column[terms]] @ weights
            open_blocks = bound >= bar[q]
            met, skipped = met + len(starts), skipped + int((~open_blocks).sum())
            if not open_blocks.any():
                continue
            some = docs[np.repeat(open_blocks, ends - starts)]
            some = some[~np.isin(some, seen[q])]
            score = shard.scores(some, terms, weights)
            seen[q] = np.concatenate([seen[q], some])
            good = score >= bar[q]
            held = np.concatenate([best[q][0], some[good]]), np.concatenate([best[q][1], score[good]])
            order = np.lexsort((held[0], -held[1]))[:k]
            best[q] = held[0][order], held[1][order]
            if len(order) == k:
                bar[q] = max(bar[q], best[q][1][-1])
        column[wanted] = -1
    return [(q, *found) for q, found in enumerate(best) if len(found[0])], (met, skipped)


_FOUND = pa.schema([("item_no", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _searched(postings: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray]], floors: dict[int, int], settings: Settings) -> DataFrame:
    """``item_no, row, doc_id, score``: the best of each shard of ``postings (shard, row, id, term_no, part)``."""
    sent = postings.sparkSession.sparkContext.broadcast((queries, floors))

    def find(held: pa.Table) -> pa.Table:
        asked, least = sent.value
        row = held.column("row").to_numpy()
        known, first, doc = np.unique(row, return_index=True, return_inverse=True)
        ids = held.column("id").take(pa.array(first))
        missing = ids.is_null().to_numpy(zero_copy_only=False)
        plain = ids.fill_null(0).to_numpy()
        order = np.lexsort((known, plain, missing))  # ties go to the smaller id
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        shard = Shard(place[doc], held.column("term_no").to_numpy(), held.column("part").to_numpy(), settings)
        number = {int(t): i for i, t in enumerate(shard.terms)}
        items, local = [], []
        for item, (terms, weights) in asked.items():
            here = sorted((number[t], w) for t, w in zip(terms.tolist(), weights.tolist(), strict=True) if t in number)
            if here:
                items.append(item)
                local.append((np.array([t for t, _ in here]), np.array([w for _, w in here])))
        found, _ = search(shard, local, np.array([least.get(i, 0) for i in items], np.int64), settings.k)
        out = [(items[q], order[docs], scores) for q, docs, scores in found]
        which = np.concatenate([o[1] for o in out]) if out else np.zeros(0, np.int64)
        columns = [
            pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out]).astype(np.int64)),
            pa.array(known[which]),
            ids.combine_chunks().take(pa.array(which)) if isinstance(ids, pa.ChunkedArray) else ids.take(pa.array(which)),
            pa.array(np.concatenate([o[2] for o in out]) if out else np.zeros(0, np.int64)),
        ]
        return pa.table(columns, schema=_FOUND)

    return postings.groupBy("shard").applyInArrow(find, "item_no bigint, row bigint, doc_id bigint, score bigint")


# --- all shards --------------------------------------------------------------------


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _blocks_of(asked: DataFrame, settings: Settings) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Queries in blocks of bounded size, each fit to be broadcast."""
    total = asked.count()
    parts = -(-total // settings.query_postings)
    for i in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("item_no"), F.lit(parts)) == i).toPandas() if parts > 1 else asked.toPandas()
        yield {int(item): (g["term_no"].to_numpy(np.int64), g["weight"].to_numpy(np.int64)) for item, g in rows.groupby("item_no")}


def top_documents(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best documents of ``docs (doc_id, text)`` for each row of ``items (item_id, text)``.

    A null or empty text has no terms: such a document is in no result and no
    count, and such an item has none.  Every row is a document or an item of
    its own, repeated rows too; equal scores are ranked by id, rows without an
    id last.  Queries are broadcast in blocks of a bounded number of terms.
    """
    terms = _term_rows(_numbered(items, "item_id")).withColumnsRenamed({"row": "item_no", "id": "item_id"})
    wanted = written(terms, "ranking-items")
    names = wanted.select("term").distinct().withColumn("term_no", F.monotonically_increasing_id())
    vocabulary = written(names, "ranking-vocabulary")
    postings = written(_term_rows(_numbered(docs, "doc_id")).join(vocabulary, "term").drop("term"), "ranking-postings")
    marker = F.col("tf") == 0
    size = postings.agg(F.count_if(marker).alias("n"), F.sum(F.when(marker, F.col("n"))).alias("l"), F.count_if(~marker).alias("postings")).first()
    if not size["n"]:
        return items.select(F.col("item_id").cast("bigint").alias("item_id")).limit(0).select(
            "item_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score")
        )
    real = postings.filter(~marker)
    df = real.groupBy("term_no").agg(F.count("*").alias("df"))
    weights = vocabulary.join(df, "term_no").select("term", "term_no", F.expr(_WEIGHT.format(N=f"{size['n']}L")).alias("w"))
    asked = written(wanted.join(weights, "term").select("item_no", "term_no", (F.col("tf") * F.col("w")).alias("weight")), "ranking-queries")

    shards = -(-size["postings"] // settings.shard_postings)
    m = _LENGTH.format(N=f"{size['n']}L", L=f"{size['l']}L", div="div")
    part = F.expr(_PART.format(m=m, div="div")).alias("part")
    dealt = real.select(F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), "row", "id", "term_no", part)
    first = max(1, int(shards**0.5))  # shards searched before there are floors
    found = None
    for queries in _blocks_of(asked, settings):
        pilot = written(_searched(dealt.filter(F.col("shard") < first), queries, {}, settings), "ranking-pilot")
        floors = {r["item_no"]: r["score"] for r in _ranked(pilot, settings.k).filter(F.col("rank") == settings.k).collect()}
        part_found = pilot
        if shards > first:
            part_found = pilot.unionByName(_searched(dealt.filter(F.col("shard") >= first), queries, floors, settings))
        found = part_found if found is None else found.unionByName(part_found)
    known = wanted.filter(F.col("tf") == 0).select("item_no", "item_id")
    if found is None:
        found = postings.sparkSession.createDataFrame([], "item_no bigint, row bigint, doc_id bigint, score bigint")
    best = written(_ranked(found, settings.k), "ranking-best")
    return best.join(known, "item_no").select("item_id", "rank", "doc_id", "score")


def _sql_terms(text: str) -> str:
    pattern = TERM.replace("'", "''")
    return f"unnest(regexp_extract_all(translate({text}, '{UPPER}', '{UPPER.lower()}'), '{pattern}'))"


SQL = f"""
WITH d AS (SELECT rowid AS r, doc_id, text FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
i AS (SELECT row_number() OVER () AS r, item_id, text FROM benchmark),
dt AS (SELECT r, term, count(*) AS tf FROM (SELECT r, {_sql_terms('text')} AS term FROM d) GROUP BY r, term),
it AS (SELECT r, term, count(*) AS qtf FROM (SELECT r, {_sql_terms('text')} AS term FROM i) GROUP BY r, term),
len AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM dt GROUP BY r),
size AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM len),
dfs AS (SELECT term, count(*) AS df FROM dt GROUP BY term),
w AS (SELECT term, {_WEIGHT.format(N='docs')} AS w FROM dfs, size),
parts AS (SELECT r, term, {_PART.format(m=_LENGTH.format(N='docs', L='total', div='//'), div='//')} AS part FROM dt JOIN len USING (r), size),
scored AS (SELECT it.r AS item, p.r AS doc, CAST(sum(qtf * w * part) AS BIGINT) AS score
  FROM it JOIN w USING (term) JOIN parts p USING (term) GROUP BY it.r, p.r),
ranked AS (SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored JOIN d ON d.r = scored.doc WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked JOIN i ON i.r = ranked.item WHERE rank <= 10
"""
