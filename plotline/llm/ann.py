"""Approximate nearest neighbours by inner product: hierarchical k-means tree, best-bin-first.

Largest inner product becomes smallest distance by one added coordinate, the root of what a vector's squared norm
lacks to the largest one. A k-means tree is fitted on a bounded sample; every vector is dealt to its leaf. A query
walks the tree through a priority queue of distances to node centres and so ranks leaves; how many it visits is
widened until the recall of a bounded set of calibration queries, measured against all rows, is reached.
Leaves and their visitors are cut into blocks of bounded size, so a leaf that holds a third of all vectors is many
groups. Scores are inner products of the original vectors in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotline.llm.common import materialise

SAMPLE = 32_768  # vectors that the tree is fitted on, at most
BRANCH = 8
LEAF = 96  # sampled vectors in a leaf
CALIBRATION = 128  # queries whose true neighbours are looked up to set the number of visits
RECALL = 0.94  # aimed at for the calibration queries, so that all queries reach 0.9
WIDEN = 1.2
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048


@dataclass
class Tree:
    """Nodes by number: centre, children (empty for a leaf), leaf number or -1."""

    centres: np.ndarray
    children: list[list[int]]
    leaf_of: list[int]
    largest: float  # squared norm

    @property
    def leaves(self) -> int:
        return max(self.leaf_of) + 1

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.largest - (x * x).sum(axis=1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every vector: the nearest child at each level."""
        lifted, node = self.lift(x), np.zeros(len(x), np.int64)
        open_ = np.arange(len(x)) if self.children[0] else np.empty(0, np.int64)
        while len(open_):
            for n in np.unique(node[open_]):
                at = open_[node[open_] == n]
                kids = np.array(self.children[n])
                node[at] = kids[_nearest(lifted[at], self.centres[kids])]
            open_ = open_[[bool(self.children[n]) for n in node[open_]]]
        return np.array(self.leaf_of)[node]

    def leaf_order(self, q: np.ndarray) -> Iterator[int]:
        """Leaves for one query (scaled to the largest norm), best bin first."""
        norm = np.sqrt((q * q).sum()) or 1.0
        lifted = np.append(q * (np.sqrt(self.largest) / norm), 0.0)
        far = (self.centres * self.centres).sum(axis=1) - 2 * (self.centres @ lifted)
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield self.leaf_of[node]
            for kid in self.children[node]:
                heapq.heappush(queue, (far[kid], kid))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def fit_tree(sample: np.ndarray, largest: float) -> Tree:
    """Split the sample by k-means until a node holds at most ``LEAF`` vectors or only equal ones."""
    tree = Tree(np.empty(0), [], [], largest)
    centres, rng = [], np.random.default_rng(7)
    lifted = tree.lift(sample)
    todo = [(lifted, -1)]
    leaves = 0
    while todo:
        x, parent = todo.pop(0)
        node = len(centres)
        centres.append(x.mean(axis=0))
        tree.children.append([])
        tree.leaf_of.append(-1)
        if parent >= 0:
            tree.children[parent].append(node)
        parts = []
        if len(x) > LEAF:
            start = np.unique(x[rng.permutation(len(x))[:4 * BRANCH]], axis=0)
            c = start[rng.permutation(len(start))[:BRANCH]]
            for _ in range(10):
                near = _nearest(x, c)
                c = np.array([x[near == k].mean(axis=0) for k in range(len(c)) if (near == k).any()])
            near = _nearest(x, c)
            parts = [x[near == k] for k in range(len(c)) if (near == k).any()]
        if len(parts) > 1:
            todo += [(p, node) for p in parts]
        else:
            tree.leaf_of[node] = leaves
            leaves += 1
    tree.centres = np.array(centres)
    return tree


def _best(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best rows for each query: (query position, row, score); ties go to the smaller id."""
    of, rows, scores = [], [], []
    for low in range(0, len(q), 256):
        rough = q[low:low + 256] @ x.T
        slack = 1e-9 * (1 + np.abs(rough).max(initial=0))
        for i in range(len(rough)):
            own = ids != q_ids[low + i]
            r = np.where(own, rough[i], -np.inf)
            near = np.flatnonzero(own)
            if len(near) > k:
                near = np.flatnonzero(r >= np.partition(r, len(r) - k)[len(r) - k] - slack)
            exact = (x[near] * q[low + i]).sum(axis=1)  # equal vectors get equal scores, whatever the block
            top = np.lexsort((ids[near], -exact))[:k]
            of.append(np.full(len(top), low + i))
            rows.append(near[top])
            scores.append(exact[top])
    empty = np.empty(0, np.int64)
    return (np.concatenate(of or [empty]), np.concatenate(rows or [empty]), np.concatenate(scores or [empty.astype(float)]))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.array(col.tolist(), dtype=np.float64)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): one row an id, of the most frequent length; null, zero and non-finite vectors are left out."""
    v = F.col(vector_col)
    if vectors.schema[vector_col].dataType.simpleString() not in ("array<float>", "array<double>"):
        v = v.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fine, v).alias("v"))
            .filter("vec_id is not null and v is not null"))
    width = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("v") == (width.d if width else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def search(vectors: DataFrame, every: int = 20, k: int = 20, recall: float = RECALL, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product for every id divisible by ``every``.

    All rows but the query's own are candidates, and all are indexed. Rows that repeat an id count once (the
    smallest vector); rows with a null id, and vectors that are null, zero, of another length than most or hold
    null or non-finite components, take no part. With at most k other rows all are returned; ties go to the
    smaller id.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = materialise(usable(vectors, id_col, vector_col), "ann-vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    total, largest = rows.agg(F.count("*"), F.max(norm)).first()
    if not total:
        return empty
    share = min(1.0, SAMPLE / total)
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / (1 << 30)
    sample = rows.filter(spread < share).select("vec_id", "v").limit(2 * SAMPLE).toPandas().sort_values("vec_id").head(SAMPLE)
    if not len(sample):
        sample = rows.limit(1000).toPandas()
    tree = fit_tree(_matrix(sample["v"]), largest)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": pdf["v"], "leaf": tree.assign(_matrix(pdf["v"])).astype(np.int32)})

    kind = rows.schema["v"].dataType.simpleString()
    dealt = materialise(rows.mapInPandas(deal, f"vec_id long, v {kind}, leaf int"), "ann-leaves")
    held = np.zeros(tree.leaves, np.int64)
    for r in dealt.groupBy("leaf").count().collect():
        held[r.leaf] = r["count"]
    queries = dealt.filter(F.pmod("vec_id", F.lit(every)) == 0)
    visits = _calibrate(tree, dealt, queries, held, k, recall)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for low in range(0, len(pdf), 1024):
                part = pdf.iloc[low:low + 1024]
                ways = [np.array(_visited(tree, np.asarray(v, float), held, visits, k), np.int32) for v in part["v"]]
                yield pd.DataFrame({"query_id": part["vec_id"], "q": part["v"], "leaves": ways})

    ways = materialise(queries.select("vec_id", "v").mapInPandas(walk, f"query_id long, q {kind}, leaves array<int>"), "ann-visits")
    asked = ways.select("query_id", "q", F.explode("leaves").alias("leaf"))
    sizes = (dealt.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
             .join(asked.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("parts")), "leaf"))
    sizes = F.broadcast(sizes)  # one row a leaf: bounded by the sample
    deal_out = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (dealt.join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks")).withColumn("part", deal_out("parts"))
            .select("leaf", "block", "part", "vec_id", "v"))
    right = (asked.join(sizes, "leaf").withColumn("part", F.pmod(F.xxhash64("query_id"), "parts")).withColumn("block", deal_out("blocks"))
             .select("leaf", "block", "part", "query_id", "q"))

    def compare(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, q_ids = x["vec_id"].to_numpy(), q["query_id"].to_numpy()
        of, row, score = _best(ids, _matrix(x["v"]), q_ids, _matrix(q["q"]), k)
        return pd.DataFrame({"query_id": q_ids[of], "vec_id": ids[row], "score": score})

    near = (left.groupBy("leaf", "block", "part").cogroup(right.groupBy("leaf", "block", "part"))
            .applyInPandas(compare, "query_id long, vec_id long, score double"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _visited(tree: Tree, q: np.ndarray, held: np.ndarray, visits: int, k: int) -> list[int]:
    """The leaves one query visits: ``visits`` that hold rows, more until they hold over k."""
    way, rows = [], 0
    for leaf in tree.leaf_order(q):
        if held[leaf]:
            way.append(leaf)
            rows += held[leaf]
        if len(way) >= visits and rows > k:
            break
    return way


def _calibrate(tree: Tree, dealt: DataFrame, queries: DataFrame, held: np.ndarray, k: int, recall: float) -> int:
    """The number of leaf visits that reaches ``recall`` for the calibration queries, widened until it does."""
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).select("vec_id", "v").toPandas()
    if not len(some):
        return 1
    q_ids, q = some["vec_id"].to_numpy(), _matrix(some["v"])

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:  # a stated set of queries against all rows, block by block
            if len(pdf):
                ids = pdf["vec_id"].to_numpy()
                of, row, score = _best(ids, _matrix(pdf["v"]), q_ids, q, k)
                yield pd.DataFrame({"query": of.astype(np.int32), "vec_id": ids[row], "score": score, "leaf": pdf["leaf"].to_numpy()[row]})

    best = dealt.mapInPandas(exact, "query int, vec_id long, score double, leaf int")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    true = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "leaf").toPandas()
    visits = 1
    while True:
        found = 0
        for i, leaves in true.groupby("query")["leaf"]:
            found += np.isin(leaves.to_numpy(), _visited(tree, q[i], held, visits, k)).sum()
        if found >= recall * len(true) or visits >= tree.leaves:
            return visits
        visits = int(visits * WIDEN) + 1
