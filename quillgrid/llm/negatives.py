"""Hard negatives by inner product, with a multiway hyperplane tree whose split points know the distances of their siblings.

*Tree.* A node has up to ``FANOUT`` split points, rows of a bounded sample that lie far apart; a row goes to the nearest one, so
hyperplanes part the children. For every split point and every sibling subtree the node stores the smallest and largest
distance between the point and the rows below the sibling, taken over all rows, not the sample.

*Search.* Inner products become distances: every row gets one more component that makes all rows equally long, a search has
zero there, and then a higher score is a smaller distance. A window of scores is an annulus around the search. A sibling is left
out if, from any split point, the distances it holds cannot meet the annulus (triangle inequality). Leaves that remain are scored in
full, so results are exact; on data without structure all leaves remain and the search is a scan in blocks.

*Bounds.* The sample's rows are rows: the k-th best of them that fits bounds the window from below before the search starts.

Every row lies in one leaf. A leaf of more than ``BLOCK`` rows is cut into blocks by a hash of the id; a task scores searches that
reach a block in batches and hands on the best of each. Scores are exact below 2**53.

Rows with a null id, label or vector, or any null or non-finite component take no part. Shorter vectors count as filled up
with zeros. Rows that repeat an id, label and vector count once. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.llm.textbatch import bounded_sample
from quillgrid.session import stored

FANOUT = 8
#: Rows that the split points are chosen from, and how many of them a leaf is made for.
SAMPLE = 4096
LEAF_SAMPLE = 64
BLOCK = 1 << 12
#: Searches scored at once against a block.
_BATCH = 512
#: Distances are doubles; so much of the largest is allowed for their rounding.
_SLACK = 1e-9


def usable(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``id``, ``label`` and ``vector`` (doubles) of the rows that take part."""
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    found = rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), v.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return found.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a list column as rows, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    if (size == width).all():
        out[:] = flat.reshape(-1, width)
    else:
        end = np.cumsum(size)
        out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(end - size, size)] = flat
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0))


@dataclass
class Node:
    """Split points and what lies below each: a node or the number of a leaf; ``low[i, j]`` and ``high[i, j]`` are the
    distances from point i to the rows below j (none: an empty range)."""

    number: int
    points: np.ndarray
    below: list = field(default_factory=list)
    low: np.ndarray | None = None
    high: np.ndarray | None = None


@dataclass
class Tree:
    """``square`` is the length all rows have in the tree's space, squared; ``width`` the number of components."""

    width: int
    square: float
    nodes: list[Node]
    root: Node | int
    leaves: int
    #: Blocks by leaf.
    blocks: dict[int, int] = field(default_factory=dict)

    @classmethod
    def fit(cls, sample: np.ndarray, square: float, fanout: int = FANOUT, leaf: int = LEAF_SAMPLE) -> Tree:
        """Split points of all nodes; the ranges are still open (nothing is left out)."""
        tree = cls(sample.shape[1], square, [], 0, 0)
        tree.root = tree._grow(tree.lifted(sample), fanout, leaf)
        return tree

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.square - (vectors * vectors).sum(1), 0))
        return np.concatenate([vectors, rest[:, None]], 1)

    def _grow(self, rows: np.ndarray, fanout: int, leaf: int) -> Node | int:
        points = _far_apart(rows, fanout) if len(rows) > leaf else rows[:0]
        if len(points) < 2:
            self.leaves += 1
            return self.leaves - 1
        node = Node(len(self.nodes), points)
        self.nodes.append(node)
        near = _distances(rows, points).argmin(1)
        node.below = [self._grow(rows[near == j], fanout, leaf) for j in range(len(points))]
        node.low, node.high = np.zeros((len(points),) * 2), np.full((len(points),) * 2, np.inf)
        return node

    def walk(self, vectors: np.ndarray) -> Iterator[tuple[Node | int, np.ndarray, np.ndarray | None]]:
        """The rows at each node with their distances to its split points, and the rows at each leaf."""
        rows = self.lifted(vectors)
        todo = [(self.root, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if isinstance(node, int):
                yield node, at, None
                continue
            d = _distances(rows[at], node.points)
            yield node, at, d
            near = d.argmin(1)
            todo += [(child, at[near == j]) for j, child in enumerate(node.below)]

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        leaf = np.zeros(len(vectors), np.int32)
        for node, at, _ in self.walk(vectors):
            if isinstance(node, int):
                leaf[at] = node
        return leaf

    def reached(self, vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves that may hold a row with a score from low to high, each with the searches that must look there."""
        own = (vectors * vectors).sum(1) + self.square
        slack = _SLACK * (np.sqrt(own.max(initial=1)) + np.sqrt(self.square))
        outer = np.sqrt(np.maximum(own - 2 * np.maximum(low, -own), 0)) + slack
        inner = np.sqrt(np.maximum(own - 2 * np.minimum(high, own), 0)) - slack
        searches = np.concatenate([vectors, np.zeros((len(vectors), 1))], 1)
        todo = [(self.root, np.arange(len(vectors)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if isinstance(node, int):
                yield node, at
                continue
            d = _distances(searches[at], node.points)[:, :, None]
            out = outer[at][:, None, None]
            may = (d - node.high <= out) & (node.low - d <= out) & (d + node.high >= inner[at][:, None, None])
            meets = may.all(1)
            todo += [(child, at[meets[:, j]]) for j, child in enumerate(node.below)]


def _far_apart(rows: np.ndarray, fanout: int) -> np.ndarray:
    """Some rows far from each other: the first, then always the one farthest from those taken; equal rows only once."""
    rows = rows[np.linspace(0, len(rows) - 1, min(len(rows), 8 * fanout)).astype(int)]
    taken, d = [0], _distances(rows, rows[:1])[:, 0]
    while len(taken) < fanout and d.max() > 1e-6 * (1 + np.abs(rows).max()):
        taken.append(int(d.argmax()))
        d = np.minimum(d, _distances(rows, rows[taken[-1:]])[:, 0])
    return rows[taken]


@dataclass
class Index:
    """A fitted tree, all rows with their ``leaf`` and ``block``, and the sample (ids, labels, vectors)."""

    tree: Tree
    rows: DataFrame
    sample: tuple[np.ndarray, np.ndarray, np.ndarray]


def build(rows: DataFrame, sample_rows: int = SAMPLE) -> Index:
    """Index rows of ``usable``. The split points come from some ``sample_rows`` rows, the ranges and leaves from all."""
    spark = rows.sparkSession
    rows = stored(rows)
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    top = rows.agg(F.max(square).alias("square"), F.max(F.size("vector")).alias("width")).first()
    width = top["width"] or 1
    some = bounded_sample(rows, "id", sample_rows).orderBy("id").toArrow()
    taken = _matrix(some["vector"], width) if some.num_rows else np.zeros((0, width))
    tree = Tree.fit(taken, top["square"] or 0.0)
    shared = spark.sparkContext.broadcast(tree)

    def route(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = shared.value.leaf_of(_matrix(batch.column("vector"), width))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    routed = stored(rows.mapInArrow(route, "id bigint, label bigint, vector array<double>, leaf int"))

    def measure(batches):
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for node, _, d in shared.value.walk(_matrix(batch.column("vector"), width)):
                if d is None:
                    continue
                k = d.shape[1]
                low, high = found.setdefault(node.number, (np.full((k, k), np.inf), np.full((k, k), -np.inf)))
                near = d.argmin(1)
                for j in range(k):
                    if (near == j).any():
                        low[:, j] = np.minimum(low[:, j], d[near == j].min(0))
                        high[:, j] = np.maximum(high[:, j], d[near == j].max(0))
        for number, (low, high) in found.items():
            i, j = np.nonzero(low <= high)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), number, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(low[i, j]), pa.array(high[i, j])], ["node", "i", "j", "low", "high"])

    # One row for every two split points of a node: bounded by the sample.
    ranges = routed.mapInArrow(measure, "node int, i int, j int, low double, high double").groupBy("node", "i", "j").agg(F.min("low"), F.max("high"))
    for node in tree.nodes:
        node.low, node.high = np.full(node.low.shape, np.inf), np.full(node.low.shape, -np.inf)
    for number, i, j, low, high in ranges.collect():
        tree.nodes[number].low[i, j], tree.nodes[number].high[i, j] = low, high
    # One row a leaf.
    blocks = {r["leaf"]: -(-r["count"] // BLOCK) for r in routed.groupBy("leaf").count().collect()}
    many = F.create_map(*[F.lit(x) for leaf, n in blocks.items() if n > 1 for x in (leaf, n)]) if any(n > 1 for n in blocks.values()) else None
    pieces = F.lit(1) if many is None else F.coalesce(F.element_at(many, F.col("leaf")), F.lit(1))
    rows = routed.withColumn("blocks", pieces).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    tree.blocks = blocks
    # A row that repeats would count twice among the best.
    ids, first = np.unique(some["id"].to_numpy(), return_index=True)
    return Index(tree, rows.drop("blocks"), (ids, some["label"].to_numpy()[first], taken[first]))


def _best(score: np.ndarray, ids: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k that fit in every row of scores, higher scores and then smaller ids first: rows and columns, in order."""
    q, x = np.nonzero(fits)
    order = np.lexsort((ids[x], -score[q, x], q))
    q, x = q[order], x[order]
    start = np.searchsorted(q, np.arange(len(score)))
    keep = np.arange(len(q)) - start[q] < k
    return q[keep], x[keep]


#: A search: its windows are numbered, each with a lowest and a highest score.
_SEARCH = "id bigint, label bigint, vector array<double>, tag array<bigint>, low array<double>, high array<double>"


def scan(index: Index, searches: DataFrame, k: int, same_label: bool) -> DataFrame:
    """The best k rows of every window of every search: ``anchor_id``, ``tag``, ``id`` and ``score`` (long).

    ``searches`` has ``id``, ``label``, ``vector`` and arrays ``tag``, ``low`` and ``high`` with one entry a window. Rows have the label
    of the search, or another one; a row with the id of the search is none.
    """
    spark, width = searches.sparkSession, index.tree.width
    shared = spark.sparkContext.broadcast((index.tree, index.sample))

    def send(batches):
        tree, (ids, labels, rows) = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, _BATCH):
                part = batch.slice(a, _BATCH)
                vectors = _matrix(part.column("vector"), width)
                score, fits = vectors @ rows.T, _fits(part, ids, labels, same_label)
                tags, low, high = (part.column(c).to_pylist() for c in ("tag", "low", "high"))
                windows = max(map(len, tags), default=0)
                low, high = (np.array([[*w, *[none] * (windows - len(w))] for w in x]).reshape(len(tags), windows) for x, none in ((low, np.inf), (high, -np.inf)))
                reach: dict[int, set[int]] = {}
                for w in range(windows):
                    inside = fits & (score >= low[:, w, None]) & (score <= high[:, w, None])
                    q, x = _best(score, ids, inside, k)
                    full = np.flatnonzero(np.bincount(q, minlength=len(low)) == k)
                    worst = np.full(len(low), -np.inf)
                    worst[q] = score[q, x]  # in order: the last one written is the k-th
                    low[full, w] = np.maximum(low[full, w], worst[full])
                    open_ = np.flatnonzero(low[:, w] <= high[:, w])
                    for leaf, at in tree.reached(vectors[open_], low[open_, w], high[open_, w]):
                        reach.setdefault(leaf, set()).update(open_[at].tolist())
                row, leaf, block = [], [], []
                for to, of in reach.items():
                    for n in range(tree.blocks.get(to, 0)):
                        row += sorted(of)
                        leaf += [to] * len(of)
                        block += [n] * len(of)
                sent = part.set_column(4, "low", pa.array([x[: len(t)].tolist() for x, t in zip(low, tags)], pa.list_(pa.float64())))
                sent = sent.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), pa.array(block, pa.int32()), *sent.columns], ["leaf", "block", *sent.schema.names])

    names = [c.split()[0] for c in _SEARCH.split(", ")]
    sent = searches.select(*names).mapInArrow(send, f"leaf int, block int, {_SEARCH}")
    held = index.rows.select("leaf", "block", *[F.col(c) if c in ("id", "label", "vector") else F.lit(None).alias(c) for c in names])
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(index.tree.blocks), sum(index.tree.blocks.values()) >> 4)
    met = held.unionByName(sent).repartition(tasks, "leaf", "block").sortWithinPartitions("leaf", "block", F.col("tag").isNotNull(), "id")

    def score(batches):
        own = held_ids = held_labels = None
        rows: list[pa.RecordBatch] = []
        for batch in batches:
            for part in _parts(batch):
                here = (part.column("leaf")[0].as_py(), part.column("block")[0].as_py())
                if here != own:
                    own, rows, held_ids = here, [], None
                if part.column("tag").null_count:
                    rows.append(part)
                    continue
                if not rows:
                    continue
                if held_ids is None:
                    whole = pa.Table.from_batches(rows)
                    held_ids, held_labels, matrix = whole["id"].to_numpy(), whole["label"].to_numpy(), _matrix(whole["vector"], width)
                    fresh = np.ones(len(held_ids), bool)
                    fresh[1:] = (held_ids[1:] != held_ids[:-1]) | (held_labels[1:] != held_labels[:-1]) | (matrix[1:] != matrix[:-1]).any(1)
                    held_ids, held_labels, matrix = held_ids[fresh], held_labels[fresh], matrix[fresh]
                for a in range(0, part.num_rows, _BATCH):
                    yield _scored(part.slice(a, _BATCH), held_ids, held_labels, matrix, k, same_label)

    return met.mapInArrow(score, "anchor_id bigint, tag bigint, id bigint, score bigint")


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one block and one kind."""
    if not batch.num_rows:
        return
    kind = batch.column("tag").is_null().to_numpy(zero_copy_only=False)
    key = np.stack([batch.column("leaf").to_numpy(), batch.column("block").to_numpy(), kind])
    cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cut, cut[1:]):
        yield batch.slice(a, b - a)


def _fits(part: pa.RecordBatch, ids: np.ndarray, labels: np.ndarray, same_label: bool) -> np.ndarray:
    alike = part.column("label").to_numpy()[:, None] == labels
    return (alike if same_label else ~alike) & (part.column("id").to_numpy()[:, None] != ids)


def _scored(part: pa.RecordBatch, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, k: int, same_label: bool) -> pa.RecordBatch:
    score, fits = _matrix(part.column("vector"), matrix.shape[1]) @ matrix.T, _fits(part, ids, labels, same_label)
    anchors, tags = part.column("id").to_numpy(), part.column("tag").to_pylist()
    low, high = (part.column(c).to_pylist() for c in ("low", "high"))
    out = []
    for w in range(max(map(len, tags), default=0)):
        bound = [(x[w], y[w]) if w < len(x) else (np.inf, -np.inf) for x, y in zip(low, high)]
        from_, upto = np.array(bound).T
        q, x = _best(score, ids, fits & (score >= from_[:, None]) & (score <= upto[:, None]), k)
        out.append((anchors[q], np.array([tags[i][w] for i in q], np.int64), ids[x], score[q, x].astype(np.int64)))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor_id", "tag", "id", "score"])


def _first(found: DataFrame, *group: str, k: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, sample_rows: int = SAMPLE) -> DataFrame:
    """For every anchor and each of its best rows of the same label, the best rows of other labels whose score lies between
    ``low`` and ``high`` percent of the positive's.

    ``rows`` are those of ``usable``; ``anchors`` is a condition on them (of rows with one id the smallest counts). Columns ``anchor_id``, ``positive_id``, ``rank`` (from
    1), ``negative_id``, ``positive_score`` and ``negative_score``; higher scores come first, then smaller ids.
    """
    index = build(rows, sample_rows)
    asked = index.rows.where(anchors).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("of")).select("id", "of.label", "of.vector")
    asked = stored(asked)
    any_score = asked.withColumns({"tag": F.array(F.lit(0).cast("long")), "low": F.array(F.lit(float("-inf"))), "high": F.array(F.lit(float("inf")))})
    best = stored(_first(scan(index, any_score, positives, True), "anchor_id", k=positives).select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # Scores are whole numbers, and so are the least and the greatest that fit; of a negative positive none does.
    window = best.select("anchor_id", "positive_id", F.ceil(F.col("positive_score") * low / 100).alias("low"), F.floor(F.col("positive_score") * high / 100).alias("high"))
    tagged = window.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("positive_id", "low", "high"))).alias("w"))
    tagged = tagged.select("id", F.col("w.positive_id").alias("tag"), F.transform("w", lambda x: x["low"].cast("double")).alias("low"), F.transform("w", lambda x: x["high"].cast("double")).alias("high"))
    found = _first(scan(index, asked.join(tagged, "id"), negatives, False), "anchor_id", "tag", k=negatives)
    found = found.select("anchor_id", F.col("tag").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(best, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
