"""Embedding near-dedup by product quantisation.

Coarse inverted lists, residuals coded by subspace, asymmetric distances from tables, exact cosine for what is left. Equal
vectors are one entry with a count. Probes and the cut on table distances follow from the triangle inequality and each vector's
coding error, so no link is lost, whatever the directions that vectors spread in: a query probes each list that can hold a vector
so near, on its side of the plane between that list's centre and the query's own. Neighbouring lists share a block, so a query is
sent once to each block that it probes, not once to each list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, with_hot, written

#: Numbers in the vectors of a block of a search, as expected, and distances that are looked up at once.
BLOCK, AT_ONCE = 1 << 18, 1 << 20


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centres of Lloyd's algorithm; an empty centre keeps its place."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


class Quantiser:
    """centres: of the lists; books: for each subspace the code vectors of residuals."""

    def __init__(self, sample: np.ndarray, n_lists: int, parts: int = 8, codes: int = 64):
        self.centres = kmeans(sample, n_lists)
        rest = sample - self.centres[nearest(sample, self.centres)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(parts, sample.shape[1]))
        self.books = [kmeans(rest[:, c], codes) for c in self.cuts]

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, distance from the list's centre, coding error) of each vector."""
        at = nearest(x, self.centres)
        rest = x - self.centres[at]
        codes = np.stack([nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)
        return at, codes, np.linalg.norm(rest, axis=1), np.linalg.norm(rest - self.decoded(codes), axis=1)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], 1)

    def products(self, x: np.ndarray) -> list[np.ndarray]:
        """For each subspace, the products of each query with the code vectors."""
        return [x[:, c] @ b.T for c, b in zip(self.cuts, self.books, strict=True)]

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared, of each query from each centre."""
        return np.maximum((x**2).sum(1)[:, None] + (self.centres**2).sum(1) - 2 * x @ self.centres.T, 0)

    def probes(self, d2: np.ndarray, radius: np.ndarray, reach: float) -> np.ndarray:
        """For each query (row of ``distances``) and list, whether the list can hold a vector within ``reach``. ``radius``: of
        each list, negative if empty."""
        own = d2.argmin(1)
        norm = (self.centres**2).sum(1)
        apart = np.sqrt(np.maximum(norm[own][:, None] + norm - 2 * self.centres[own] @ self.centres.T, 0)) + 1e-7
        return (d2 - d2.min(1)[:, None] <= 2 * reach * apart + 1e-9) & (np.sqrt(d2) <= radius + reach + 1e-7) & (radius >= 0)

    def groups(self, size: np.ndarray, most: int) -> np.ndarray:
        """The group of each list: neighbours, halved along the widest axis until a group has ``most`` vectors or one list."""
        out, todo, n = np.zeros(len(self.centres), np.int32), [np.arange(len(self.centres))], 0
        while todo:
            at = todo.pop()
            if len(at) == 1 or size[at].sum() <= most:
                out[at] = n
                n += 1
                continue
            at = at[np.argsort(self.centres[at, self.centres[at].var(0).argmax()], kind="stable")]
            cut = int(np.clip(np.searchsorted(size[at].cumsum(), size[at].sum() / 2), 1, len(at) - 1))
            todo += [at[:cut], at[cut:]]
        return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows over the power of two above their largest component: cosines stay as they are to the last bit, and no square is too
    large or too small for a double, however long or short a vector is."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _matrix(values: pa.Array) -> np.ndarray:
    return scaled(values.flatten().to_numpy().reshape(len(values), -1))  # of one length, without nulls


def _by_size(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch (with a column size) for each length of vector."""
    sizes = b["size"].to_numpy()
    for d in np.unique(sizes).tolist():
        yield d, b.take(pa.array(np.flatnonzero(sizes == d)))


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, sample_rows: int = 20_000, max_lists: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors`` (vec_id, embedding, label).

    Rows link if their labels and lengths are equal and the cosine is ``cosine`` or more; null, zero or non-finite vectors and
    those with a null component, label or vec_id link with nothing. n_links: other rows linked directly; component_id: the
    smallest vec_id that links reach; kept: vec_id = component_id. Rows with one id share a component and the larger count.
    For each length of vector an index of about sqrt(n) / 5 lists, fitted on about ``sample_rows`` vectors of all lengths
    together; every vector is in one. An empty table gives no rows.
    """
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0)
    good &= ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    plain = F.transform("v", lambda x: x + 0.0)  # no negative zeros, so that equal vectors have equal digests
    clean = rows.where(good).select("vec_id", "label", plain.alias("v"))
    clean = clean.select("*", F.xxhash64("label", "v", F.lit(1)).alias("a"), F.xxhash64("v", "label", F.lit(2)).alias("b"))
    equal = clean.groupBy("a", "b").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"), F.first("label").alias("label"), F.first("v").alias("v"))
    entries = written(equal.withColumn("size", F.size("v")))
    n = entries.count()
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if n:
        links = written(_search(entries, n, kind, cosine, sample_rows, max_lists))
        direct = links.where("times > 0").groupBy(F.col("src").alias("rep"), "label", "size").agg(F.sum("times").alias("n"))
        found = components(links.where("dst is not null").select("src", "dst"))
        total = entries.agg(F.sum("times")).first()[0]
        many = F.col("times") - 1 + F.coalesce("n", F.lit(0))
        known = entries.drop("v").join(direct, ["rep", "label", "size"], "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
        # a thousandth of all vectors or more are equal to a hot one, so there are a thousand at most
        known = known.select("a", "b", many.alias("n_links"), F.coalesce("component", "rep").alias("component_id"), (F.col("times") * 1000 >= total).alias("hot"))
        member = with_hot(clean.select("vec_id", "a", "b"), written(known), ["a", "b"], ["n_links", "component_id"])
        member = member.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    else:
        member = vectors.sparkSession.createDataFrame([], f"vec_id {kind}, n_links long, component_id {kind}")
    out = rows.select("vec_id").join(member, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"))


def _fitted(entries: DataFrame, n: int, sample_rows: int, max_lists: int) -> dict[int, Quantiser]:
    """The quantiser of each length of vector. Lengths that the sample misses get one list around their first vector."""
    part = entries if n <= sample_rows else entries.where(F.pmod(F.xxhash64("rep", "v"), F.lit(1 << 20)) < int(sample_rows / n * (1 << 20)))
    samples: dict[int, list] = {}
    for r in part.select("v").toLocalIterator():
        samples.setdefault(len(r[0]), []).append(r[0])
    sizes = {r["size"]: (r["n"], r["v"]) for r in entries.groupBy("size").agg(F.count("*").alias("n"), F.min("v").alias("v")).toLocalIterator()}
    out = {}
    for d, (many, one) in sorted(sizes.items()):
        sample = scaled(np.array(sorted(samples.get(d) or [one]), np.float64))
        sample /= np.linalg.norm(sample, axis=1, keepdims=True)
        out[d] = Quantiser(sample, int(np.clip(np.sqrt(many) / 5, 1, max(1, max_lists * many // n))))
    return out


def _search(entries: DataFrame, n: int, kind: str, cosine: float, sample_rows: int, max_lists: int) -> DataFrame:
    """(src, dst, label, size, times): for each query and block with links one row with its linked rows, and links that connect
    what a query has found."""
    spark = entries.sparkSession
    fitted = _fitted(entries, n, sample_rows, max_lists)
    shared = spark.sparkContext.broadcast(fitted)  # max_lists centres at most and one for each length, and a few code vectors
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-7

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for d, b in _by_size(whole):
                x = _matrix(b["v"])
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                at, codes, far, error = shared.value[d].code(x)
                made = [pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(far), pa.array(error)]
                yield pa.RecordBatch.from_arrays([*(b[c] for c in of_entry), *made], [*of_entry, "list", "codes", "far", "error"])

    of_entry = ["rep", "label", "size", "times", "v"]
    label = entries.schema["label"].dataType.simpleString()
    kinds = f"rep {kind}, label {label}, size int, times long, v array<double>, list int, codes binary, far double, error double"
    index = written(entries.select(*of_entry).mapInArrow(coded, kinds))
    # one row for each list, of which there are max_lists at most and one for each length; counts are of the label that has most
    radius = {d: np.full(len(q.centres), -1.0) for d, q in fitted.items()}
    size = {d: np.zeros(len(q.centres)) for d, q in fitted.items()}
    for d, at, far in index.groupBy("size", "list").agg(F.max("far")).toLocalIterator():
        radius[d][at] = far
    for d, at, most in index.groupBy("label", "size", "list").count().groupBy("size", "list").agg(F.max("count")).toLocalIterator():
        size[d][at] = most
    rows = {d: max(256, BLOCK // d) for d in fitted}
    group = {d: q.groups(size[d], rows[d]) for d, q in fitted.items()}

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for d, b in _by_size(whole):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(group[d][b["list"].to_numpy()])], [*b.schema.names, "group"])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                for d, b in _by_size(whole.slice(k, 1024)):
                    x, quant = _matrix(b["v"]), shared.value[d]
                    lists = quant.probes(quant.distances(x / np.linalg.norm(x, axis=1, keepdims=True)), radius[d], reach)
                    hit = np.zeros((len(x), group[d].max() + 1), bool)
                    at, to = np.nonzero(lists)
                    hit[at, group[d][to]] = True
                    at, to = np.nonzero(hit)
                    asked = [b[c].take(pa.array(at)) for c in ("rep", "label", "size", "v")]
                    yield pa.RecordBatch.from_arrays([*asked, pa.array(to.astype(np.int32))], ["rep", "label", "size", "v", "group"])

    key = ["label", "size", "group"]
    held = index.mapInArrow(grouped, f"{kinds}, group int")
    blocks = written(held.groupBy(*key).agg(F.ceil(F.count("*") / F.greatest(F.lit(256), F.floor(F.lit(BLOCK) / F.col("size")))).cast("int").alias("blocks")))
    held = held.join(blocks, key).select(*key, F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"), F.lit(0).alias("role"), "rep", "times", "v", "list", "codes", "far", "error")
    asked = index.select("rep", "label", "size", "v").mapInArrow(probed, f"rep {kind}, label {label}, size int, v array<double>, group int").join(blocks, key)
    asked = asked.select(
        *key, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "rep", F.lit(0).cast("long").alias("times"), "v",
        F.lit(0).alias("list"), F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("far"), F.lit(0.0).alias("error"),
    )
    key = [*key, "block"]

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                b = whole.slice(k, 1024)
                keys = list(zip(*(b[c].to_pylist() for c in (*key, "role")), strict=True))
                begin = 0
                while begin < len(keys):
                    end = begin
                    while end < len(keys) and keys[end] == keys[begin]:
                        end += 1
                    run = b.slice(begin, end - begin)
                    if keys[begin][:4] != at:
                        at = keys[begin][:4]
                        block = _Block(shared.value[at[1]])
                    if keys[begin][4] == 0:
                        block.add(run)
                    else:
                        src, dst, times = block.search(run, cosine, reach)
                        kind_of, label_of = b.schema.field("rep").type, b.schema.field("label").type
                        made = [pa.array(src, kind_of), pa.array(dst, kind_of), pa.array([at[0]] * len(src), label_of), pa.array([at[1]] * len(src), pa.int32()), pa.array(times, pa.int64())]
                        yield pa.RecordBatch.from_arrays(made, ["src", "dst", "label", "size", "times"])
                    begin = end

    dealt = held.unionByName(asked).repartition(*key).sortWithinPartitions(*key, "role")
    return dealt.mapInArrow(searched, f"src {kind}, dst {kind}, label {label}, size int, times long")


class _Block:
    """Rows of neighbouring lists; all of them are added before the first search."""

    def __init__(self, quant: Quantiser):
        self.quant = quant
        self.reps: list = []
        self.times, self.far, self.error, self.at, self.codes, self.x = [], [], [], [], [], []
        self.parent: list[int] = []

    def add(self, b: pa.RecordBatch) -> None:
        self.reps += b["rep"].to_pylist()
        for to, name in ((self.times, "times"), (self.far, "far"), (self.error, "error"), (self.at, "list")):
            to.append(b[name].to_numpy())
        self.codes.append(np.frombuffer(b"".join(b["codes"].to_pylist()), np.uint8).reshape(b.num_rows, -1))
        self.x.append(_matrix(b["v"]))

    def close(self) -> None:
        self.times, self.far, self.error, self.at, self.codes, self.x = (np.concatenate(v) for v in (self.times, self.far, self.error, self.at, self.codes, self.x))
        self.norm = np.linalg.norm(self.x, axis=1)
        self.parent = list(range(len(self.reps)))
        by = np.argsort(self.at, kind="stable")
        lists, cut = np.unique(self.at[by], return_index=True)
        self.lists = dict(zip(lists.tolist(), np.split(by, cut[1:]), strict=True))
        self.radius = np.full(len(self.quant.centres), -1.0)
        np.maximum.at(self.radius, self.at, self.far)
        # |x - c - r|^2 = |x - c|^2 + |r|^2 + 2 c r - 2 x r: what doesn't hang on the query
        r = self.quant.decoded(self.codes)
        self.own = (r**2).sum(1) + 2 * (self.quant.centres[self.at] * r).sum(1)

    def root(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def search(self, b: pa.RecordBatch, cosine: float, reach: float) -> tuple[list, list, list]:
        if isinstance(self.x, list):
            self.close()
        raw = _matrix(b["v"])
        norm = np.linalg.norm(raw, axis=1)
        x = raw / norm[:, None]
        d2, products = self.quant.distances(x), self.quant.products(x)
        probed = self.quant.probes(d2, self.radius, reach)
        asks, holds, pairs = [], [], max(1, AT_ONCE // raw.shape[1])
        for at, rows in self.lists.items():
            queries = np.flatnonzero(probed[:, at])
            step = max(1, AT_ONCE // len(rows))
            for k in range(0, len(queries), step):
                part = queries[k : k + step]
                near = d2[part, at][:, None] + self.own[rows] - 2 * sum(t[part][:, self.codes[rows, j]] for j, t in enumerate(products))
                ask, hold = np.nonzero(np.sqrt(np.maximum(near, 0)) <= reach + self.error[rows] + 1e-7)
                ask, hold = part[ask], rows[hold]
                for i in range(0, len(ask), pairs):
                    a, h = ask[i : i + pairs], hold[i : i + pairs]
                    keep = np.einsum("ij,ij->i", raw[a], self.x[h]) / (norm[a] * self.norm[h]) >= cosine
                    asks.append(a[keep]), holds.append(h[keep])
        ask, hold = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (asks, holds))
        by = np.argsort(ask, kind="stable")
        ask, hold = ask[by], hold[by]
        src, dst, times = [], [], []
        for k, rep in enumerate(b["rep"].to_pylist()):
            mine = [h for h in hold[np.searchsorted(ask, k) : np.searchsorted(ask, k, "right")].tolist() if self.reps[h] != rep]
            if not mine:
                continue
            src.append(rep), dst.append(self.reps[mine[0]]), times.append(int(self.times[mine].sum()))
            for h in mine[1:]:
                r, s = self.root(mine[0]), self.root(h)
                if r != s:
                    self.parent[s] = r
                    src.append(self.reps[mine[0]]), dst.append(self.reps[h]), times.append(0)
        return src, dst, times
