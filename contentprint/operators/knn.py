"""Exact nearest neighbours over records (tenant_id, record_id, embedding) for a batch of queries (qid, tenant_id, vector, k)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import cut, tidy
from .bm25 import ranked, scope

#: Queries that are held at a time, as one matrix a tenant and dimension; more go block by block.
BLOCK = 1024
MOST_QUERIES = 100_000


def search(records: DataFrame, queries: DataFrame, metric: str = "cosine", where: Column | None = None, modality: str | None = None, most_queries: int = MOST_QUERIES) -> DataFrame:
    """qid, tenant_id, record_id, score, rank. score is the cosine, or for metric "l2" the negative distance.

    where: a predicate on the records' columns; modality: the only one that is searched. Both apply before scoring.

    Vectors of another dimension, without length (for cosine), null or not finite are passed over. A task keeps k rows for each query,
    so what is shuffled doesn't depend on the number of records. Of more than `most_queries` queries as many at a time are held, and each
    part's result is written before the next one.
    """
    near = records.filter(scope(where, modality)).filter("embedding IS NOT NULL").select("tenant_id", "record_id", "embedding")
    asked = queries.select("qid", "tenant_id", F.col("vector").cast("array<double>").alias("vector"), F.col("k").cast("int").alias("k"))
    if queries.limit(most_queries + 1).count() <= most_queries:
        return _search(near, asked.collect(), metric)
    return _in_parts(near, asked, metric, most_queries)


@tidy
def _in_parts(near: DataFrame, asked: DataFrame, metric: str, most: int) -> DataFrame:
    rows, out = asked.toLocalIterator(), None
    while part := list(islice(rows, most)):
        found = cut(_search(near, part, metric))
        out = found if out is None else out.unionByName(found)
    return out


def _search(near: DataFrame, rows: list, metric: str) -> DataFrame:
    by: dict[tuple, list] = {}
    for r in rows:
        v = np.array(r["vector"] if r["vector"] is not None else [], float)
        if r["k"] and r["k"] > 0 and len(v) and np.isfinite(v).all() and (metric != "cosine" or np.linalg.norm(v) > 0):
            by.setdefault((r["tenant_id"], len(v)), []).append((r["qid"], r["k"], v))
    blocks = [(key, [q for q, _, _ in part], [k for _, k, _ in part], np.array([v for _, _, v in part])) for key, own in sorted(by.items()) for i in range(0, len(own), BLOCK) for part in [own[i : i + BLOCK]]]
    sent = near.sparkSession.sparkContext.broadcast(blocks)
    tenants = sorted({key[0] for key in by})
    near = near.filter(F.col("tenant_id").isin(tenants)) if tenants else near.limit(0)
    found = near.mapInArrow(_scan(sent, metric), "qid long, tenant_id long, record_id long, score double, k int")
    return ranked(found, max((k for _, _, ks, _ in blocks for k in ks), default=1))


def _scan(sent, metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for batch in batches:
            tenant, ids, lists = batch["tenant_id"].to_numpy(), batch["record_id"].to_numpy(), batch["embedding"]
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for number, ((t, dim), _, ks, matrix) in enumerate(sent.value):
                rows = np.flatnonzero((tenant == t) & (sizes == dim))
                if not len(rows):
                    continue
                v = values[starts[rows][:, None] + np.arange(dim)]
                good = np.isfinite(v).all(axis=1)
                norms = np.linalg.norm(v, axis=1)
                good &= (norms > 0) | (metric != "cosine")
                v, own, norms = v[good], ids[rows[good]], norms[good]
                if metric == "cosine":
                    scores = (matrix @ v.T) / (np.linalg.norm(matrix, axis=1)[:, None] * norms[None, :])
                else:
                    scores = 0 - np.sqrt(np.maximum(0, ((matrix[:, None, :] - v[None, :, :]) ** 2).sum(axis=2))) if len(matrix) * len(v) * dim < 1 << 24 else np.array([0 - np.sqrt(((m - v) ** 2).sum(axis=1)) for m in matrix])
                for j, k in enumerate(ks):
                    old = best.get((number, j), (np.empty(0), np.empty(0, np.int64)))
                    s, i = np.concatenate([old[0], scores[j]]), np.concatenate([old[1], own])
                    top = np.lexsort((i, -s))[:k]
                    best[number, j] = (s[top], i[top])
        for (number, j), (s, i) in best.items():
            (t, _), qids, ks, _ = sent.value[number]
            yield pa.record_batch({"qid": np.full(len(s), qids[j], np.int64), "tenant_id": np.full(len(s), t, np.int64), "record_id": i.astype(np.int64), "score": s.astype(float), "k": np.full(len(s), ks[j], np.int32)})

    return run
