"""Product codes of vectors: integer Lloyd rounds over cover trees.

A component x becomes floor(1024 * x); a vector is cut into PARTS equal parts, and each
part position has a codebook of at most ENTRIES entries. All arithmetic on vectors,
distances and sums is in exact integers.

``planted`` puts the vectors of each partition, in blocks of BLOCK, into one cover tree
a part, once: a node covers its points within its radius, its children cover them
within half of it and lie further apart than that, and a node holds the sum and the
number of all points below. A round (``_Tree.assign``) walks down level by level. Let
d1 and d2 be the distances of a node's centre from its nearest and second nearest
entry: if d2 - d1 > 2 * radius, then by the triangle inequality every point below is
nearest to the first, and its sums go there as a whole. Only the ambiguous nodes
descend; at the leaves the exact integers decide, ties to the lower index. Radii are
rounded up, so rounding only costs a descent.

Only codebooks (PARTS * ENTRIES entries) and their sums, added up in each task and then
by Spark, pass the driver: bounded whatever the table. Vectors are never shuffled; a
hot label is pre-aggregated.

Rows: vectors that are null, empty, or hold null or non-finite components are dropped,
so are those whose length isn't a multiple of PARTS or isn't that of the smallest
vec_id left. Null vec_ids come last among the first entries, rows that repeat a vec_id
are ordered by their vectors and coded each; copies of a vector are one point of a tree;
equal entries give their points to the first of them; fewer than ENTRIES vectors make
a codebook of that size; an empty table gives no rows; other columns are ignored.
Components so large that squared distances pass 63 bits raise an error.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import staged

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK = 2048


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x from all rows of y."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    bound = 4 * max(1, x.shape[1]) * top * top
    if bound < 1 << 53:  # every number on the way is a whole double
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)
    if bound >= 1 << 63:
        raise ValueError("components are too large for squared distances of 63 bits")
    return np.stack([((x - row) ** 2).sum(1) for row in y], 1)


class _Tree:
    """A cover tree over the different points of one part of a block."""

    NAMES = ("points", "copies", "inverse", "centre", "radius", "total", "below", "child", "children", "lo", "hi", "order")

    def __init__(self, **arrays: np.ndarray):
        for name in self.NAMES:
            setattr(self, name, arrays[name])

    @classmethod
    def plant(cls, vectors: np.ndarray) -> _Tree:
        points, inverse, copies = np.unique(vectors, axis=0, return_inverse=True, return_counts=True)
        nodes, order = [], []  # a node: centre, radius, members, first child, number of children
        first = _squared(points, points[:1])[:, 0]
        todo = [(0, np.arange(len(points)), first)]
        nodes.append([0, 0.0, todo[0][1], 0, 0])
        at = 0
        while at < len(nodes):  # in order of levels, so that children stand side by side
            centre, members, near = todo[at]
            todo[at] = None
            far = float(np.sqrt(float(near.max())))
            nodes[at][1] = np.nextafter(far, np.inf) * (1 + 1e-12) if far else 0.0
            if far:
                owner, close, heads, square = np.zeros(len(members), np.int64), near.copy(), [centre], [near]
                while True:  # the farthest point becomes the next centre, until half the radius covers all
                    i = int(close.argmax())
                    if 4 * int(close[i]) <= int(near.max()):
                        break
                    d = _squared(points[members], points[members[i]][None])[:, 0]
                    owner[d < close] = len(heads)
                    close = np.minimum(close, d)
                    heads.append(int(members[i]))
                    square.append(d)
                nodes[at][3], nodes[at][4] = len(nodes), len(heads)
                by_owner = np.argsort(owner, kind="stable")
                for h, mine in enumerate(np.split(by_owner, np.searchsorted(owner[by_owner], np.arange(1, len(heads))))):
                    nodes.append([heads[h], 0.0, members[mine], 0, 0])
                    todo.append((heads[h], members[mine], close[mine]))
            at += 1
        # points in the order of a walk, so that every node's are a range
        lo, hi = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        stack, at = [0], 0
        while stack:
            i = stack.pop()
            lo[i], hi[i] = at, at + len(nodes[i][2])
            if nodes[i][4]:
                stack += range(nodes[i][3] + nodes[i][4] - 1, nodes[i][3] - 1, -1)
            else:
                order.append(nodes[i][2])
                at = hi[i]
        order = np.concatenate(order)
        heavy = points * copies[:, None]
        sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(heavy[order], 0)])
        many = np.concatenate([[0], np.cumsum(copies[order])])
        column = lambda j, kind=np.int64: np.asarray([n[j] for n in nodes], kind)
        return cls(points=points, copies=copies, inverse=inverse.reshape(-1), centre=column(0), radius=column(1, np.float64),
                   total=sums[hi] - sums[lo], below=many[hi] - many[lo], child=column(3), children=column(4), lo=lo, hi=hi, order=order)

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(entry of each point, sums and numbers by entry, points compared)."""
        _, first = np.unique(entries, axis=0, return_index=True)
        first.sort()  # equal entries: the first takes all
        unlike = entries[first]
        label = np.zeros(len(self.points), np.int64)
        sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
        front, compared = np.zeros(1, np.int64), 0
        while len(front):
            square = _squared(self.points[self.centre[front]], unlike)
            compared += len(front)
            best = square.argmin(1)
            if len(first) > 1:
                two = np.sqrt(np.partition(square, 1, axis=1)[:, :2].astype(np.float64))
                sure = two[:, 1] * (1 - 1e-12) - two[:, 0] * (1 + 1e-12) > 2 * self.radius[front]
            else:
                sure = np.ones(len(front), bool)
            sure |= self.children[front] == 0
            done, entry = front[sure], first[best[sure]]
            size = self.hi[done] - self.lo[done]
            at = np.repeat(self.lo[done], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            label[self.order[at]] = np.repeat(entry, size)
            np.add.at(sums, entry, self.total[done])
            np.add.at(counts, entry, self.below[done])
            open_ = front[~sure]
            size = self.children[open_]
            front = np.repeat(self.child[open_], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return label, sums, counts, compared

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **{name: getattr(self, name) for name in self.NAMES})
        return out.getvalue()

    @classmethod
    def of_bytes(cls, data: bytes) -> _Tree:
        with np.load(io.BytesIO(data)) as z:
            return cls(**{name: z[name] for name in cls.NAMES})


def quantised(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Usable rows with ``q``, the vector in integers."""
    fine = F.forall(column, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    usable = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0) & (F.size(column) % PARTS == 0) & fine)
    return usable.withColumn("q", F.transform(column, lambda x: F.floor(x.cast("double") * SCALE).cast("long")))


def planted(rows: DataFrame, width: int) -> DataFrame:
    """One row a block of a partition: ids, labels, and the trees of its parts."""
    def run(frames):
        held, n = [], 0

        def block():
            pdf = pd.concat(held, ignore_index=True)
            x = np.stack([np.asarray(v, np.int64) for v in pdf["q"]])
            trees = [_Tree.plant(np.ascontiguousarray(x[:, p * width:(p + 1) * width])).to_bytes() for p in range(PARTS)]
            return pd.DataFrame({"vec_ids": [pdf["vec_id"].astype(object).where(pdf["vec_id"].notna(), None).tolist()],
                                 "labels": [pdf["label"].astype(object).where(pdf["label"].notna(), None).tolist()], "trees": [trees]})

        for pdf in frames:
            for lo in range(0, len(pdf), BLOCK):
                held.append(pdf.iloc[lo:lo + BLOCK])
                n += len(held[-1])
                if n >= BLOCK:
                    yield block()
                    held, n = [], 0
        if n:
            yield block()

    label = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "q").mapInPandas(run, f"vec_ids array<long>, labels array<{label}>, trees array<binary>")


def _round(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one assignment of all points and its means."""
    def run(frames):
        sums, counts = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for pdf in frames:
            for row in pdf["trees"]:
                for p, data in enumerate(row):
                    _, s, c, _ = _Tree.of_bytes(data).assign(books[p])
                    sums[p] += s
                    counts[p] += c
        for p, (s, c) in enumerate(zip(sums, counts)):
            used = np.flatnonzero(c)
            both = np.concatenate([s[used], c[used, None]], 1)  # the last position is the number of points
            yield pd.DataFrame({"part": p, "entry": np.repeat(used, both.shape[1]), "pos": np.tile(np.arange(both.shape[1]), len(used)), "s": both.reshape(-1)})

    added = trees.select("trees").mapInPandas(run, "part int, entry int, pos int, s long").groupBy("part", "entry", "pos").agg(F.sum("s").alias("s"))
    new = [np.concatenate([b, np.zeros((len(b), 1), np.int64)], 1) for b in books]
    for r in added.collect():  # at most PARTS * ENTRIES entries
        new[r["part"]][r["entry"], r["pos"]] = r["s"]
    return [np.where(b[:, -1:] > 0, b[:, :-1] // np.maximum(b[:, -1:], 1), old) for b, old in zip(new, books)]


def encode(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vectors`` (vec_id, embedding, label) coded: vec_id, label, code, error,
    label_error, codebooks_sha256."""
    if entries > 256:
        raise ValueError("a code has two hex digits a part")
    rows = quantised(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")).drop("embedding")
    order = [F.asc_nulls_last("vec_id"), F.asc("q")]
    first = rows.orderBy(*order).select("q").first()
    length = len(first["q"]) if first else PARTS
    rows = rows.where(F.size("q") == length)
    seeds = rows.orderBy(*order).limit(entries).select("q").collect()  # at most `entries` rows
    width = length // PARTS
    start = np.asarray([r["q"] for r in seeds], np.int64).reshape(len(seeds), length)
    books = [np.ascontiguousarray(start[:, p * width:(p + 1) * width]) for p in range(PARTS)]
    trees = staged(planted(rows, width), "cover-trees")
    for _ in range(rounds if seeds else 0):
        books = _round(trees, books)

    def code(frames):
        for pdf in frames:
            for ids, labels, row in zip(pdf["vec_ids"], pdf["labels"], pdf["trees"]):
                codes, error = [], 0
                for p, data in enumerate(row):
                    tree = _Tree.of_bytes(data)
                    label = tree.assign(books[p])[0]
                    d = ((tree.points - books[p][label]) ** 2).sum(1)
                    codes.append(np.asarray([f"{x:02x}" for x in label], object)[tree.inverse])
                    error = error + d[tree.inverse]
                yield pd.DataFrame({"vec_id": pd.array(ids, "Int64"), "label": pd.Series(list(labels), dtype=object), "code": sum(codes[1:], codes[0]), "error": error})

    label = rows.schema["label"].dataType.simpleString()
    coded = staged(trees.mapInPandas(code, f"vec_id long, label {label}, code string, error long"), "vector-codes")
    by_label = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark, sf_dir) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("label")
