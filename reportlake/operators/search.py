"""Filtered lexical and dense search, fusion, reranking and cuts, for batches of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from reportlake import settings
from reportlake.functions import text
from reportlake.functions.vectors import vector_issue
from reportlake.operators.distribution import (
    BROADCAST_BYTES,
    broadcast_if_small,
    fan_out,
    materialize,
    measured_bytes,
    spread,
)

DISTANCES = ("COSINE", "DOT", "EUCLID", "MANHATTAN")
# Chunks that share one bound of what a term can add.
BLOCK = 64
# Chunks looked at for a first bound of a query, as a multiple of k.
SEEDS = 16
# Matches of terms that are added up without bounds.
DIRECT = 20_000_000
# Share of the bound that unmatched terms may add when pairs are judged the second time.
LEFT = 0.25
# Scores are added as whole multiples of 2**-40: the sum does not depend on the order of the rows,
# so equal chunks get equal scores and their ids decide.
FIXED = float(2**40)


@dataclass(frozen=True)
class Filters:
    """Corpus restriction; an empty field does not restrict."""

    domain: str | None = None
    document_types: tuple[str, ...] = ()
    document_ids: tuple[str, ...] = ()
    document_status: str | None = None
    source: str | None = None
    document_number: str | None = None
    effective_on: date | None = None
    exclude_processing_statuses: tuple[str, ...] = field(default=("deleted",))

    @classmethod
    def for_request(cls, **request) -> Filters:
        """Filters of a request: an absent status means active documents."""
        status = request.pop("document_status", None) or settings.DEFAULT_DOCUMENT_STATUS
        return cls(document_status=status, **request)

    def condition(self, corpus: DataFrame, by_processing_status: bool = True) -> Column:
        """The restriction as one predicate over the columns the corpus has.

        The vector store does not look at processing statuses: pass False for it."""
        columns = set(corpus.columns)

        def column(name: str) -> Column:
            return F.col(name) if name in columns else F.lit(None).cast("string")

        keep = F.lit(True)
        for name in ("domain", "document_status", "source", "document_number"):
            value = getattr(self, name)
            if value:
                keep = keep & (column(name) == value)
        if self.document_types:
            keep = keep & column("document_type").isin(*self.document_types)
        if self.document_ids:
            keep = keep & column("document_id").isin(*self.document_ids)
        if by_processing_status and self.exclude_processing_statuses:
            excluded = column("processing_status").isin(*self.exclude_processing_statuses)
            keep = keep & ~F.coalesce(excluded, F.lit(False))
        if self.effective_on:
            day = F.lit(self.effective_on)
            keep = keep & in_force(column("effective_date"), column("expiry_date"), day)
        return keep


def in_force(effective: Column, expiry: Column, day: Column) -> Column:
    """Null or unreadable bounds do not restrict."""
    started = F.try_to_date(effective.cast("string"), "yyyy-MM-dd") <= day
    not_over = F.try_to_date(expiry.cast("string"), "yyyy-MM-dd") >= day
    return F.coalesce(started, F.lit(True)) & F.coalesce(not_over, F.lit(True))


def apply_filters(corpus: DataFrame, filters: Filters | None, **options) -> DataFrame:
    return corpus if filters is None else corpus.filter(filters.condition(corpus, **options))


def rank_by(df: DataFrame, score: list[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """Positions per query, best first, ties by chunk id; Spark cuts to k before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(*score, F.col("chunk_id"))
    ranked = df.withColumn(rank, F.row_number().over(order))
    return ranked if k is None else ranked.filter(F.col(rank) <= k)


# --- lexical search -----------------------------------------------------------------------------


def searchable_text(corpus: DataFrame) -> Column:
    """Name, number and content; a missing number adds nothing."""
    parts = [F.col(c) for c in ("document_name", "document_number", "content") if c in corpus.columns]
    return F.concat_ws(" ", *parts)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, weight): how often a term occurs in its query."""
    words = queries.select("query_id", F.explode(text.tokens(F.col("query"))).alias("term"))
    return words.groupBy("query_id", "term").agg(F.count("*").alias("weight"))


def term_table(corpus: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(chunk_id, term, tf, doc_len) for the terms asked for, and one row per chunk whose term is
    null; a single pass over the texts.

    The join comes before the aggregation, so of all tokens only the asked ones are grouped, and
    the tokens of one chunk meet in their own task before the shuffle."""
    tokenized = (
        spread(corpus.select("chunk_id", searchable_text(corpus).alias("body")), "chunk_id")
        .withColumn("words", text.tokens(F.col("body")))
        .select("chunk_id", "words", F.size("words").alias("doc_len"))
    )
    marked = F.concat(F.array(F.lit(None).cast("string")), F.col("words"))
    exploded = tokenized.select("chunk_id", "doc_len", F.explode(marked).alias("term"))
    kept = exploded.join(vocabulary, exploded["term"] == vocabulary["known_term"], "left").filter(
        F.col("term").isNull() | F.col("known_term").isNotNull()
    )
    return kept.groupBy("chunk_id", "term", "doc_len").agg(F.count("*").alias("tf"))


@dataclass(frozen=True)
class Lexicon:
    """What scoring reads: `postings` (chunk_id, block, term, saturation) and `weights` (query_id, term,
    weight, df), both written tables. A block holds chunks of like length, at most about BLOCK."""

    postings: DataFrame
    weights: DataFrame


def _length_class(length: Column) -> Column:
    return F.floor(2 * F.log2(length + 1)).cast("int")


def lexicon(
    corpus: DataFrame, queries: DataFrame, filters: Filters | None = None, parameters: settings.Bm25 = settings.Bm25(),
) -> Lexicon:
    """Statistics of the filtered corpus for the terms asked for. The reduced term table is written
    once and read for the statistics and for scoring. The query terms are measured once; vocabulary
    and weights have at most as many rows, so they are broadcast too."""
    terms = query_terms(queries)
    small = F.broadcast if measured_bytes(terms) <= BROADCAST_BYTES else (lambda df: df)
    vocabulary = small(terms.select(F.col("term").alias("known_term")).distinct())
    table = materialize(term_table(apply_filters(corpus, filters), vocabulary), even=False)
    postings, chunks = table.filter("term is not null"), table.filter("term is null")
    # Lengths fall into few classes, a hundred at most.
    classes = chunks.groupBy(_length_class(F.col("doc_len")).alias("c")).agg(
        F.count("*").alias("n"), F.sum("doc_len").alias("length")).collect()
    n_docs = sum(r["n"] for r in classes)
    mean_len = (sum(r["length"] for r in classes) / n_docs if n_docs else 0) or 1.0

    frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = terms.join(frequency, "term").select(
        "query_id", "term", (F.col("weight") * idf * (parameters.k1 + 1)).alias("weight"), "df"
    )
    length = 1 - parameters.b + parameters.b * F.col("doc_len") / F.lit(mean_len)
    saturation = F.col("tf") / (F.col("tf") + parameters.k1 * length)
    parts = F.create_map(*[F.lit(int(x)) for r in classes for x in (r["c"], -(-r["n"] // BLOCK))] or [F.lit(0), F.lit(1)])
    in_class = _length_class(F.col("doc_len"))
    block = F.pmod(F.xxhash64("chunk_id"), parts[in_class]) * 128 + in_class
    return Lexicon(
        postings.select("chunk_id", block.alias("block"), "term", saturation.alias("saturation")),
        materialize(weights, even=False),
    )


def _part(saturation: str = "saturation") -> Column:
    """What a term adds to a score, as a whole number; it grows with the saturation."""
    return F.rint(F.col(saturation) * F.col("weight") * FIXED).cast("bigint")


def _grows(df: DataFrame) -> DataFrame:
    """A side that grows with the corpus: never sent through the driver, however small its files are."""
    return df.hint("merge")


def score_pairs(known: Lexicon, pairs: DataFrame) -> DataFrame:
    """(query_id, chunk_id, fixed): full scores of the given pairs."""
    held = _grows(pairs.select("query_id", "chunk_id")).join(known.postings.drop("block"), "chunk_id")
    return (
        held.join(known.weights, ["query_id", "term"])
        .groupBy("query_id", "chunk_id").agg(F.sum(_part()).alias("fixed"))
    )


def score_all(known: Lexicon) -> DataFrame:
    """(query_id, chunk_id, fixed) of all pairs that share a term."""
    # Partitioned by chunk once, the sums per (chunk, query) need no shuffle of their own.
    by_chunk = known.postings.drop("block").repartition("chunk_id")
    return (
        by_chunk.join(known.weights, "term")
        .groupBy("chunk_id", "query_id").agg(F.sum(_part()).alias("fixed"))
    )


def thresholds(known: Lexicon, k: int) -> DataFrame:
    """(query_id, bound): a score that at least k chunks reach, from the chunks that hold a query's rarest
    terms; 0 where there are fewer."""
    rarest = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    seeds = known.weights.withColumn("seen", F.sum("df").over(rarest)).filter(F.coalesce("seen", F.lit(0)) < SEEDS * k)
    partial = (
        known.postings.join(seeds, "term").groupBy("query_id", "chunk_id").agg(F.sum(_part()).alias("fixed"))
    )
    scored = score_pairs(known, rank_by(partial, [F.desc("fixed")], SEEDS * k))
    return rank_by(scored, [F.desc("fixed")], k).groupBy("query_id").agg(
        F.when(F.count("*") >= k, F.min("fixed")).otherwise(F.lit(0)).alias("bound"))


def promising_pairs(known: Lexicon, k: int) -> DataFrame:
    """(query_id, chunk_id): all pairs that may be among the k best of their query.

    A term adds at most what it adds in the chunk of its block that holds it most. In a block, the
    terms of a query are taken from the weakest on as long as their greatest sum stays below the
    bound of the query: a chunk with these terms alone cannot reach it. Only the other terms are
    matched, and only chunks that can still reach the bound with all the weak ones remain. For
    these, weak terms are added until what is left is below a share of the bound, and chunks are
    judged again. Blocks whose terms together stay below the bound are never looked at. Only tables
    that grow with the queries alone may be broadcast."""
    tops = known.postings.groupBy("block", "term").agg(F.max("saturation").alias("top"))
    bounds = materialize(thresholds(known, k), even=False)
    inside = Window.partitionBy("query_id", "block")
    weakest = inside.orderBy("part", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto, bound = F.col("upto"), F.col("bound")
    below = lambda limit: F.coalesce(F.max(F.when(upto < limit, upto)).over(inside), F.lit(0))
    terms = materialize(
        tops.join(known.weights, "term")
        .select("query_id", "block", "term", "weight", _part("top").alias("part"))
        .join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(0)))
        .withColumn("upto", F.sum("part").over(weakest))
        .withColumns({"rest": below(bound), "least": below(bound * LEFT), "total": F.max("upto").over(inside)})
        .filter((F.col("total") >= bound) & (upto >= bound * LEFT))
        .drop("part", "total"), even=False)
    strong = known.postings.join(_grows(terms.filter(upto >= bound)), ["block", "term"])
    partial = strong.groupBy("query_id", "chunk_id", "block").agg(
        F.sum(_part()).alias("fixed"), *[F.first(c).alias(c) for c in ("rest", "least", "bound")])
    first = materialize(partial.filter(F.col("fixed") + F.col("rest") >= bound).drop("rest"), even=False)
    weak = terms.filter(upto < bound).select("query_id", "block", "term", "weight")
    unjudged = first.select(
        "query_id", "chunk_id", "block", F.lit(None).cast("bigint").alias("least"), F.lit(None).cast("bigint").alias("bound"))
    more = (
        _grows(unjudged.join(_grows(weak), ["query_id", "block"]))
        .join(known.postings.drop("block"), ["chunk_id", "term"])
        .select("query_id", "chunk_id", "block", _part().alias("fixed"), "least", "bound")
    )
    judged = first.select(more.columns).unionByName(more).groupBy("query_id", "chunk_id").agg(
        F.sum("fixed").alias("fixed"), F.max("least").alias("least"), F.max("bound").alias("bound"))
    return judged.filter(F.col("fixed") + F.col("least") >= bound).select("query_id", "chunk_id")


def bm25_search(
    corpus: DataFrame,
    queries: DataFrame,
    filters: Filters | None = None,
    k: int | None = settings.CANDIDATE_TOP_K,
    parameters: settings.Bm25 = settings.Bm25(),
    direct: int = DIRECT,
) -> DataFrame:
    """Best chunks per query: (query_id, chunk_id, score, rank).

    Document frequency, corpus size and mean length belong to the filtered corpus. With k, only pairs
    that can be among the k best are scored, unless the terms have at most `direct` matches in all, a
    counted number, where one pass over them costs less than bounds. Both ways give the same rows."""
    known = lexicon(corpus, queries, filters, parameters)
    matches = known.weights.agg(F.sum("df")).first()[0] or 0
    fixed = score_all(known) if k is None or matches <= direct else score_pairs(known, promising_pairs(known, k))
    scores = fixed.select("chunk_id", "query_id", (F.col("fixed") / FIXED).alias("score")).filter(F.col("score") > 0)
    return rank_by(scores, [F.desc("score")], k).select("query_id", "chunk_id", "score", "rank")


# --- dense search -------------------------------------------------------------------------------


# Queries and corpus rows of a tile; a tile of queries is held as one matrix, a tile of the corpus is read
# in batches. The corpus is sent once for every tile of queries, so a tile is as large as a worker holds.
QUERY_TILE = 1 << 18
CORPUS_TILE = 1 << 18
# Bytes of the matrix of a tile of queries.
HELD_BYTES = 1 << 27
# Queries whose scores with a batch of the corpus are computed at once.
SLICE = 512
# Scores count with so many digits after the point; the margin is wider than what rounding moves.
DIGITS, MARGIN = 12, 1e-9


def _similarity(queries: np.ndarray, vectors: np.ndarray, distance: str) -> np.ndarray:
    if distance in ("COSINE", "DOT"):
        return queries @ vectors.T
    if distance == "EUCLID":
        squares = (queries**2).sum(1)[:, None] + (vectors**2).sum(1)[None, :]
        return -np.sqrt(np.maximum(squares - 2 * queries @ vectors.T, 0.0))
    return -np.stack([np.abs(vectors - query).sum(1) for query in queries])


def usable(column: str, distance: str) -> Column:
    """Vectors that can be compared: some components, none null or not finite, and a direction where the
    distance is an angle. The others are named by `refused_vectors`."""
    v = F.col(column)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if distance == "COSINE":
        fine = fine & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def refused_vectors(table: DataFrame, id_column: str, distance: str = "COSINE") -> DataFrame:
    """(id, issue) of rows that dense search leaves out."""
    return table.filter(~usable("vector", distance)).select(id_column, vector_issue(F.col("vector")).alias("issue"))


def dense_search(
    corpus: DataFrame,
    queries: DataFrame,
    filters: Filters | None = None,
    k: int = settings.CANDIDATE_TOP_K,
    distance: str = "COSINE",
    query_tile: int = QUERY_TILE,
    corpus_tile: int = CORPUS_TILE,
) -> DataFrame:
    """Exact nearest chunks: corpus (chunk_id, vector), queries (query_id, vector).

    Both sides are cut into tiles. Every tile of queries meets every tile of the corpus in one task: the
    queries come first and are held, the corpus follows in batches, and the k best per query are kept
    as they come and sent once at the end. Nothing passes the driver but two counts and a length.

    Only vectors of equal length are compared; see `usable` for those left out. For EUCLID and
    MANHATTAN the score is the negative distance, so larger is always better."""
    if distance not in DISTANCES:
        raise ValueError(f"unknown distance: {distance}")
    held = apply_filters(corpus, filters, by_processing_status=False).filter(usable("vector", distance))
    asked = queries.filter(usable("vector", distance))
    kinds = {"query_id": dict(queries.dtypes)["query_id"], "chunk_id": dict(corpus.dtypes)["chunk_id"]}
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    given = {dict(table.dtypes)["vector"] for table in (held, asked)}
    kept = "array<float>" if given == {"array<float>"} else "array<double>"
    sizes = asked.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("longest")).first()
    query_tiles = max(1, -(-sizes["n"] // max(1, min(query_tile, HELD_BYTES // (8 * (sizes["longest"] or 1))))))
    corpus_tiles = max(-(-held.count() // corpus_tile), -(-cores // query_tiles))

    def side(table: DataFrame, own: str, tile: Column, other: Column) -> DataFrame:
        ids = [(F.col(name) if name == own else F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()]
        vector = F.col("vector").cast(kept).alias("vector")
        placed = table.select(*ids, vector, F.size("vector").alias("length"), tile.alias("a"), F.explode(other).alias("b"))
        return placed.withColumn("is_query", F.lit(own == "query_id"))

    sequence = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    place = lambda name, n: F.pmod(F.xxhash64(name), n).cast("int")
    left = side(asked, "query_id", place("query_id", query_tiles), sequence(corpus_tiles))
    right = side(held, "chunk_id", place("chunk_id", corpus_tiles), sequence(query_tiles))
    pairs = left.withColumn("tile", F.struct("length", "a", "b")).unionByName(
        right.withColumn("tile", F.struct("length", F.col("b").alias("a"), F.col("a").alias("b"))))
    pairs = pairs.withColumn("tile", F.concat_ws("/", "tile.length", "tile.a", "tile.b"))
    met = (
        pairs.select("tile", "is_query", *kinds, "vector")
        .repartition(query_tiles * corpus_tiles, "tile").sortWithinPartitions("tile", F.desc("is_query"))
    )
    schema = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double"
    best = rank_by(met.mapInArrow(_nearest(k, distance), schema), [F.desc("score")], k)
    # A chunk stored twice counts once, with its best score.
    distinct = best.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return rank_by(distinct, [F.desc("score")], None)


def _matrix(column: pa.Array, distance: str) -> np.ndarray:
    """Vectors of equal length as rows, of unit length where the distance asks for it."""
    rows = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return rows / np.sqrt((rows**2).sum(1))[:, None] if distance == "COSINE" else rows


class _Best:
    """The k best of every query so far: rows sorted by query, then score, then chunk id."""

    def __init__(self, n: int, k: int, kind: pa.DataType) -> None:
        self.n, self.k = n, k
        self.rows, self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0), pa.array([], kind)
        self.floor = np.full(n, -np.inf)

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        """Scores (queries, chunks). Only what comes near the floor is rounded and looked at."""
        least = self.floor
        if scores.shape[1] > self.k and not np.isfinite(least).all():
            least = np.maximum(np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k], least)
        with np.errstate(invalid="ignore"):
            near = np.where(np.isfinite(least), least - MARGIN * np.maximum(1, np.abs(least)), -np.inf)
        row, column = np.nonzero(scores >= near[:, None])
        if not len(row):
            return
        self.rows = np.concatenate([self.rows, row])
        self.scores = np.concatenate([self.scores, np.round(scores[row, column], DIGITS)])
        self.ids = pa.concat_arrays([self.ids, ids.take(pa.array(column))])
        ranks = np.asarray(pc.rank(self.ids, "ascending", tiebreaker="dense"))
        order = np.lexsort((ranks, -self.scores, self.rows))
        rows = self.rows[order]
        head = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        place = np.arange(len(rows)) - np.repeat(head, np.diff(np.append(head, len(rows))))
        order = order[place < self.k]
        self.rows, self.scores, self.ids = self.rows[order], self.scores[order], self.ids.take(pa.array(order))
        count = np.bincount(self.rows, minlength=self.n)
        full = np.flatnonzero(count >= self.k)
        self.floor[full] = self.scores[np.cumsum(count)[full] - 1]


def _nearest(k: int, distance: str):
    """Rows come tile by tile, queries before chunks."""

    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, names, parts, queries, best = None, [], [], None, None

        def done():
            asked = pa.concat_arrays(names)
            for at, own in enumerate(best):
                found = asked.take(pa.array(own.rows + at * SLICE))
                yield pa.RecordBatch.from_arrays([found, own.ids, pa.array(own.scores)], ["query_id", "chunk_id", "score"])

        for batch in stream:
            if not batch.num_rows:
                continue
            key = batch.column("tile")
            new = np.asarray(pc.not_equal(key[1:], key[:-1])) | np.asarray(pc.not_equal(batch.column("is_query")[1:], batch.column("is_query")[:-1]))
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                piece = batch.slice(a, b - a)
                if piece.column("tile")[0].as_py() != tile:
                    if best is not None:
                        yield from done()
                    tile, names, parts, queries, best = piece.column("tile")[0].as_py(), [], [], None, None
                vectors, ids = _matrix(piece.column("vector"), distance), piece.column("chunk_id")
                if piece.column("is_query")[0].as_py():
                    names.append(piece.column("query_id"))
                    parts.append(vectors)
                elif names:
                    if best is None:
                        queries, parts = np.concatenate(parts), []
                        queries = [queries[at:at + SLICE] for at in range(0, len(queries), SLICE)]
                        best = [_Best(len(own), k, ids.type) for own in queries]
                    for own, found in zip(queries, best):
                        found.add(_similarity(own, vectors, distance), ids)
        if best is not None:
            yield from done()

    return scan


# --- fusion, reranking, cuts --------------------------------------------------------------------


def reciprocal_rank_fusion(
    dense: DataFrame,
    lexical: DataFrame,
    k: int | None = settings.CANDIDATE_TOP_K,
    rrf_k: int = settings.RRF_K,
    dense_weight: float = settings.DENSE_WEIGHT,
    lexical_weight: float = settings.LEXICAL_WEIGHT,
) -> DataFrame:
    """Weighted sum of 1/(rrf_k + rank) over two ranked lists; one shuffle for both."""
    sides = [
        df.select(
            "query_id",
            "chunk_id",
            (F.lit(weight) / (rrf_k + F.col("rank"))).alias("part"),
            (F.col("score") if dense_side else F.lit(None).cast("double")).alias("dense_score"),
            (F.lit(None).cast("double") if dense_side else F.col("score")).alias("lexical_score"),
        )
        for df, weight, dense_side in ((dense, dense_weight, True), (lexical, lexical_weight, False))
    ]
    fused = (
        sides[0]
        .unionByName(sides[1])
        .groupBy("query_id", "chunk_id")
        .agg(
            F.sum("part").alias("fused_score"),
            F.max("dense_score").alias("dense_score"),
            F.max("lexical_score").alias("lexical_score"),
        )
    )
    return rank_by(fused, [F.desc("fused_score")], k)


def single_list(dense: DataFrame, lexical: DataFrame, k: int | None = None) -> DataFrame:
    """Without fusion: the dense list of a query, or its lexical list when the dense is empty."""
    rest = lexical.join(dense.select("query_id").distinct(), "query_id", "left_anti")
    both = dense.unionByName(rest)
    return both if k is None else both.filter(F.col("rank") <= k)


def rerank_by_overlap(
    candidates: DataFrame, queries: DataFrame, corpus: DataFrame, k: int = settings.FINAL_TOP_K
) -> DataFrame:
    """Order candidates by the number of distinct query tokens their content holds."""
    earlier = [F.col(c) for c in ("fused_score", "dense_score", "lexical_score", "score")
               if c in candidates.columns]
    wanted = queries.select("query_id", F.array_distinct(text.tokens(F.col("query"))).alias("asked"))
    found = with_content(candidates, corpus).withColumn("held", text.tokens(F.col("content")))
    # Zero counts as absent in the chain of earlier scores.
    fallback = F.coalesce(*[F.nullif(c, F.lit(0.0)) for c in earlier], F.lit(0.0))
    scored = found.join(wanted, "query_id").select(
        *[c for c in candidates.columns if c != "rank"],
        F.size(F.array_intersect("asked", "held")).cast("double").alias("reranker_score"),
        fallback.alias("_earlier"),
    )
    order = [F.desc("reranker_score"), F.desc("_earlier")]
    return rank_by(scored, order, k).drop("_earlier")


def with_content(candidates: DataFrame, corpus: DataFrame) -> DataFrame:
    """Attach chunk columns to the (few) candidates, at most k per query. They are written first:
    the search runs once, and its size is known when the corpus is cut to the wanted ids."""
    found = materialize(candidates)
    extra = [c for c in corpus.columns if c == "chunk_id" or c not in candidates.columns]
    wanted = broadcast_if_small(found.select("chunk_id").distinct())
    texts = corpus.select(*extra).join(wanted, "chunk_id", "left_semi")
    return found.join(fan_out(texts, "chunk_id"), "chunk_id")


def rerank_by_scores(
    candidates: DataFrame, scores: DataFrame, k: int = settings.FINAL_TOP_K, strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Order candidates by given scores (query_id, chunk_id, reranker_score).

    A query whose scores are incomplete, repeated or not finite keeps its order and yields a
    warning; with `strict` it is left out of the result and the warning is an error."""
    clean = scores.groupBy("query_id", "chunk_id").agg(
        F.max("reranker_score").alias("reranker_score"),
        F.count("*").alias("given"),
        F.bool_and(
            F.col("reranker_score").isNotNull()
            & ~F.isnan("reranker_score")
            & (F.abs("reranker_score") < float("inf"))
        ).alias("finite"),
    )
    paired = candidates.join(clean, ["query_id", "chunk_id"], "left")
    usable = paired.groupBy("query_id").agg(
        F.bool_and(F.coalesce((F.col("given") == 1) & F.col("finite"), F.lit(False))).alias("usable")
    )
    judged = paired.drop("given", "finite").join(usable, "query_id")
    value = F.when(F.col("usable"), F.col("reranker_score"))
    kept = judged.filter("usable") if strict else judged
    first = F.when(F.col("usable"), -value).otherwise(F.col("rank").cast("double"))
    result = rank_by(
        kept.withColumns({"reranker_score": value, "_first": first}).drop("usable"),
        [F.asc("_first")], k, "final_rank",
    ).drop("_first", "rank").withColumnRenamed("final_rank", "rank")
    warnings = usable.filter("not usable").select(
        "query_id",
        F.lit("error" if strict else "warning").alias("severity"),
        F.lit("Reranker failed; retrieval ordering preserved.").alias("message"),
    )
    return result, warnings


def without_reranker(candidates: DataFrame, k: int = settings.FINAL_TOP_K) -> DataFrame:
    """Keep the order, cut, and say so."""
    return candidates.filter(F.col("rank") <= k).withColumn(
        "warning", F.lit("Reranker unavailable; retrieval ordering preserved.")
    )


@dataclass(frozen=True)
class SearchMode:
    """Which lists are used; combinations that cannot work are refused."""

    requested: str = "auto"
    dense: bool = True
    lexical: bool = True
    hybrid: bool = True

    def resolve(self) -> tuple[bool, bool, bool]:
        if self.requested not in ("auto", "dense", "lexical", "hybrid"):
            raise ValueError(f"unknown retrieval mode: {self.requested}")
        use_dense = self.requested != "lexical" and self.dense
        use_lexical = self.requested != "dense" and self.lexical
        wants_both = self.requested == "hybrid" or (self.requested == "auto" and self.hybrid)
        use_both = wants_both and use_dense and use_lexical
        needed = {"dense": use_dense, "lexical": use_lexical, "hybrid": use_both}
        if not needed.get(self.requested, True):
            raise ValueError(f"retrieval mode {self.requested} is unavailable")
        return use_dense, use_lexical, use_both


def valid_queries(queries: DataFrame) -> DataFrame:
    """Normalized, non-blank queries with the identifiers they name."""
    return (
        queries.withColumn("query", text.normalize_query(F.col("query")))
        .filter(F.col("query") != "")
        .withColumn("identifiers", text.identifiers(F.col("query")))
    )


def retrieve(
    corpus: DataFrame,
    queries: DataFrame,
    filters: Filters | None = None,
    mode: SearchMode = SearchMode(),
    candidate_k: int = settings.CANDIDATE_TOP_K,
    final_k: int = settings.FINAL_TOP_K,
    rerank: bool = True,
    rewrite: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """The search pipeline up to the final cut. `corpus` and `queries` carry a `vector` column
    when dense search is used.

    `rewrite` is a user's expression of the normalized query; identifiers are read from what it gives,
    and a query that it makes blank is refused like a blank one."""
    use_dense, use_lexical, use_both = mode.resolve()
    asked = valid_queries(queries)
    if rewrite is not None:
        asked = valid_queries(asked.withColumn("query", rewrite(F.col("query"))))
    dense = dense_search(corpus, asked, filters, candidate_k) if use_dense else None
    lexical = bm25_search(corpus, asked, filters, candidate_k) if use_lexical else None
    if use_both:
        candidates = reciprocal_rank_fusion(dense, lexical, candidate_k)
    elif dense is not None and lexical is not None:
        candidates = single_list(dense, lexical)
    else:
        candidates = dense if dense is not None else lexical
    if not rerank:
        return without_reranker(candidates, final_k)
    return rerank_by_overlap(candidates, asked, corpus, final_k)
