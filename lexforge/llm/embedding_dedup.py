"""Near-duplicate embeddings by product quantisation.

Unit vectors go to the inverted list of the nearest coarse centroid and keep a code of their
residual there. Every vector also asks the lists near it; a table of distances from its residual to
the code words gives distances to all codes of a list, and what passes is checked by the exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._plan import checkpointed, hash_sample, row_key
from .components import connected_components

COSINE = 0.93
#: Vectors that the coarse centroids and code books are fitted on: about so many, by hash.
SAMPLE_ROWS = 12_000
MOST_LISTS, SUBSPACE, CODE_WORDS, STEPS = 1024, 4, 16, 8
#: Rows of a coarse list for each finer list that it is cut into, and the most of these.
LIST_ROWS, MOST_FINER = 50_000, 256
#: A list is asked if the plane half-way to its centroid lies within so many deviations of a random step of the link radius.
PROBE_DEVIATIONS = 3.0
#: Rows of a list that one task holds as queries and as members; larger lists are split into blocks.
BLOCK = 2048


@dataclass
class Quantiser:
    """For one dimension: coarse centroids, and a code book for each run of SUBSPACE components of the residuals.

    A list is a centroid and, for large tables, one of the finer centroids of the residuals, which all
    coarse lists share; without them there is one finer centroid at the origin.
    """

    centroids: np.ndarray
    finer: np.ndarray
    books: list[np.ndarray]
    deviations: float = PROBE_DEVIATIONS
    cosine: float = COSINE

    def cuts(self) -> list[slice]:
        return [slice(i, i + SUBSPACE) for i in range(0, self.centroids.shape[1], SUBSPACE)]

    def centre(self, where: np.ndarray | int) -> np.ndarray:
        """The point of a list that residuals are taken from."""
        return self.centroids[where // len(self.finer)] + self.finer[where % len(self.finer)]

    def near(self, x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector, and a table of those whose bisecting plane is near enough to ask them."""
        far = np.maximum(0, (x**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * x @ c.T)
        home = far.argmin(axis=1)
        apart = np.sqrt(np.maximum(0, (c**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * c @ c.T))
        step = self.deviations * radius(self.cosine) / np.sqrt(max(1, x.shape[1]))
        return home, far - far[np.arange(len(x)), home][:, None] <= 2 * step * apart[home] + 1e-12

    def homes_and_probes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each vector's own list, and the lists that all of them ask, as (vector, list), their own among them."""
        home, probes = self.near(x, self.centroids)
        who, where = np.nonzero(probes)
        if len(self.finer) == 1:
            return home, who, where
        own, fine_who, fine_where = np.zeros(len(x), np.int64), [], []
        for s in range(0, len(who), 4096):
            w, at = who[s : s + 4096], where[s : s + 4096]
            fine, asked = self.near(x[w] - self.centroids[at], self.finer)
            mine = at == home[w]
            own[w[mine]] = at[mine] * len(self.finer) + fine[mine]
            i, j = np.nonzero(asked)
            fine_who.append(w[i])
            fine_where.append(at[i] * len(self.finer) + j)
        who, where = np.concatenate(fine_who), np.concatenate(fine_where)
        order = np.lexsort([where, who])
        return own, who[order], where[order]

    def encode(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the length that each code is off."""
        codes = np.stack([((book**2).sum(axis=1) - 2 * residuals[:, cut] @ book.T).argmin(axis=1) for cut, book in zip(self.cuts(), self.books)], axis=1).astype(np.uint8)
        off = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1) - residuals
        return codes, np.sqrt((off**2).sum(axis=1))

    def passing(self, queries: np.ndarray, codes: np.ndarray, off: np.ndarray, home: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) pairs whose table distance allows a link: a true distance is at least that to the code less the length the code is off."""
        total = np.zeros((len(queries), len(codes)))
        residuals = queries - self.centre(home)
        for m, (cut, book) in enumerate(zip(self.cuts(), self.books)):
            part = residuals[:, cut]
            table = (part**2).sum(axis=1)[:, None] + (book**2).sum(axis=1) - 2 * part @ book.T
            total += table[:, codes[:, m]]
        return np.nonzero(np.sqrt(np.maximum(total, 0)) <= radius(self.cosine) + off + 1e-9)

    def plain(self) -> tuple:
        """Arrays only, for a broadcast that workers can read without this package."""
        return self.centroids, self.finer, self.books, self.deviations, self.cosine


def radius(cosine: float) -> float:
    """The distance of unit vectors with this cosine."""
    return float(np.sqrt(max(0.0, 2 - 2 * cosine)))


def centres(x: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """k-means by some steps of Lloyd's method."""
    found = x[random.choice(len(x), k, replace=False)].copy()
    for _ in range(STEPS):
        near = (2 * x @ found.T - (found**2).sum(axis=1)).argmax(axis=1)
        count = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], axis=1)
        found[count > 0] = sums[count > 0] / count[count > 0, None]
    return found


def fit(sample: np.ndarray, rows: int, seed: int = 3, cosine: float = COSINE, list_rows: int = LIST_ROWS) -> Quantiser:
    """A quantiser for unit vectors, with about the root of rows as coarse lists, and finer ones from list_rows rows a coarse list on."""
    random = np.random.default_rng(seed)
    k = int(np.clip(np.sqrt(rows), 1, min(MOST_LISTS, max(1, len(sample) // 20))))
    bare = Quantiser(centres(sample, k, random), np.zeros((1, sample.shape[1])), [], cosine=cosine)
    home, _ = bare.near(sample, bare.centroids)
    residuals = sample - bare.centroids[home]
    finer = int(np.clip(rows // (k * list_rows), 1, min(MOST_FINER, max(1, len(sample) // 20))))
    if finer > 1:
        bare.finer = centres(residuals, finer, random)
        residuals = residuals - bare.finer[bare.near(residuals, bare.finer)[0]]
    bare.books = [centres(residuals[:, cut], min(CODE_WORDS, len(sample)), random) for cut in bare.cuts()]
    return bare


def one_list(dim: int, cosine: float) -> Quantiser:
    """One list and one code word at the origin: every pair passes on to the exact cosine."""
    bare = Quantiser(np.zeros((1, dim)), np.zeros((1, dim)), [], cosine=cosine)
    bare.books = [np.zeros((1, bare.centroids[0, cut].size)) for cut in bare.cuts()]
    return bare


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))


def usable():
    """Not null, without null or non-finite components, not zero, with a label."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce((x.isNotNull()) & ~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.coalesce(F.col("label").isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def smallest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For n nodes and links (a, b), each node's smallest connected node."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def embedding_links(classes: DataFrame, models: dict[int, Quantiser], cosine: float, block: int) -> DataFrame:
    """(a, b, n): links that join classes (b not null), and n more vectors that class a is linked with (b null)."""
    shared = classes.sparkSession.sparkContext.broadcast({dim: m.plain() for dim, m in models.items()})
    # Vectors travel as they came, so that floats take half the room of doubles; they are scaled to length 1 where they are used.
    kind = "float32" if "float" in classes.schema["embedding"].dataType.simpleString() else "float64"

    def model(dim: int) -> Quantiser:
        found = shared.value.get(dim)
        return Quantiser(*found) if found else one_list(dim, cosine)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                raw = np.array(part.column("embedding").flatten().to_numpy(zero_copy_only=False), kind).reshape(-1, dim)
                quantiser, x = model(int(dim)), unit(raw.astype(np.float64))
                home, who, where = quantiser.homes_and_probes(x)
                codes, off = quantiser.encode(x - quantiser.centre(home))
                ends = np.searchsorted(who, np.arange(len(x) + 1)).astype(np.int32)
                asked = pa.ListArray.from_arrays(pa.array(ends), pa.array(where.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("dim"), part.column("label"), part.column("node"), part.column("copies"), pa.array(home.astype(np.int32)), pa.array([v.tobytes() for v in raw], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off), asked],
                    ["dim", "label", "node", "copies", "home", "vector", "code", "off", "probes"],
                )

    schema = "dim int, label string, node long, copies long, home int, vector binary, code binary, off double, probes array<int>"
    rows = checkpointed(classes.select("node", F.col("label").cast("string").alias("label"), "copies", F.size("embedding").alias("dim"), F.col("embedding").cast(f"array<{'float' if kind == 'float32' else 'double'}>").alias("embedding")).mapInArrow(encode, schema))
    at = ["dim", "label", "list"]
    asked = rows.select("*", F.explode("probes").alias("list")).withColumn("member", F.col("home") == F.col("list"))
    sizes = asked.groupBy(*at).agg(F.ceil(F.count("*") / block).cast("int").alias("q_cells"), F.greatest(F.lit(1), F.ceil(F.count_if("member") / block)).cast("int").alias("m_cells"), F.count_if("member").alias("members"))
    asked = asked.join(sizes.where("members > 0").drop("members"), at)
    q_mine, m_mine = F.pmod(F.xxhash64("node"), F.col("q_cells")).cast("int"), F.pmod(F.xxhash64(F.lit(1), "node"), F.col("m_cells")).cast("int")
    cell = lambda q, m, role: F.struct(q.alias("q"), m.alias("m"), F.lit(role).alias("is_query"))
    queries = F.transform(F.sequence(F.lit(0), F.col("m_cells") - 1), lambda m: cell(q_mine, m, True))
    members = F.when(F.col("member"), F.transform(F.sequence(F.lit(0), F.col("q_cells") - 1), lambda q: cell(q, m_mine, False))).otherwise(F.filter(queries, lambda x: F.lit(False)))
    # Codes and probes only travel with members.
    own = lambda c: F.when(~F.col("x.is_query"), F.col(c)).alias(c)
    dealt = asked.withColumn("x", F.explode(F.concat(queries, members))).select(*at, "node", "copies", "home", "vector", own("code"), own("off"), own("probes"), "x.q", "x.m", "x.is_query")

    def compare(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        dim, home_list = key[0].as_py(), key[2].as_py()
        quantiser = model(dim)
        role = group.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
        asks, holds = group.filter(pa.array(role)).combine_chunks(), group.filter(pa.array(~role)).combine_chunks()
        decode = lambda t, c, kind, wide: np.frombuffer(b"".join(t.column(c).to_pylist()), kind).reshape(-1, wide)
        if not (asks.num_rows and holds.num_rows):
            return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "n")})
        x, y = (unit(decode(t, "vector", kind, dim).astype(np.float64)) for t in (asks, holds))
        q, m = quantiser.passing(x, decode(holds, "code", np.uint8, len(quantiser.books)), holds.column("off").to_numpy(), home_list)
        q_node, m_node = asks.column("node").to_numpy(), holds.column("node").to_numpy()
        exact = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", x[q[i : i + 50_000]], y[m[i : i + 50_000]]) for i in range(0, len(q), 50_000))])
        good = (exact >= cosine) & (q_node[q] != m_node[m])
        q, m = q[good], m[good]
        # A member that does not ask the query's list never counts this link itself.
        probes = holds.column("probes").combine_chunks()
        ends = probes.offsets.to_numpy()
        asked_lists = np.repeat(np.arange(len(probes), dtype=np.int64), np.diff(ends)) << 32 | probes.values.to_numpy()[ends[0] : ends[-1]]
        back = ~np.isin(m.astype(np.int64) << 32 | asks.column("home").to_numpy()[q], asked_lists)
        nodes, place = np.unique(np.concatenate([q_node[q], m_node[m]]), return_inverse=True)
        qi, mi = place[: len(q)], place[len(q) :]
        counts = np.bincount(qi, holds.column("copies").to_numpy()[m], len(nodes)) + np.bincount(mi[back], asks.column("copies").to_numpy()[q[back]], len(nodes))
        least = smallest(qi, mi, len(nodes))
        joined = np.flatnonzero(least != np.arange(len(nodes)))
        ends = pa.concat_arrays([pa.nulls(len(nodes), pa.int64()), pa.array(nodes[least[joined]], pa.int64())])
        return pa.table({"a": pa.array(np.concatenate([nodes, nodes[joined]]), pa.int64()), "b": ends, "n": pa.array(np.concatenate([counts, np.zeros(len(joined))]).astype(np.int64))})

    return dealt.groupBy(*at, "q", "m").applyInArrow(compare, "a long, b long, n long")


def embedding_groups(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, sample_rows: int = SAMPLE_ROWS, seed: int = 3, list_rows: int = LIST_ROWS) -> DataFrame:
    """Links and groups of vectors with the same label and a cosine of at least cosine, in double precision.

    vectors needs vec_id, embedding and label. Returns one row per input row: vec_id, n_links (other rows
    linked directly), component_id (smallest vec_id reachable) and kept (vec_id = component_id). Vectors
    that are null, zero, or hold null or non-finite components, and rows without a label, have no links and
    are their own component, whatever else has their vec_id. Vectors of different length never link. Rows
    with equal vectors and labels are one class that counts its copies and is never expanded into pairs.
    Usable rows that share a vec_id are one group with all that any of them is linked with, but each counts
    its own links. A row without a vec_id links as others do, and its component_id is null only if its
    group has no vec_id at all.
    """
    keyed = vectors.select("vec_id", "label", "embedding", usable().alias("usable"), F.monotonically_increasing_id().alias("place"))
    keyed = checkpointed(keyed.select("*", *row_key("label", "embedding")))
    rows = keyed.where("usable")
    classes = rows.groupBy("key0", "key1").agg(F.min("place").alias("node"), F.count("*").alias("copies"))
    members = checkpointed(rows.select("key0", "key1", "place", "vec_id").join(classes, ["key0", "key1"]).select("place", "vec_id", "node", "copies"))
    classes = checkpointed(rows.select("place", "label", "embedding").join(members.where("place = node").select("node", "copies"), F.col("place") == F.col("node")).drop("place"))
    total = classes.count()
    sample = classes.select("embedding", F.size("embedding").alias("dim")).transform(lambda df: hash_sample(df, sample_rows, "embedding", seed=seed)).collect()
    sample.sort(key=lambda r: (r.dim, r.embedding))
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r.dim, []).append(r.embedding)
    models = {dim: fit(unit(np.array(found, np.float64)), max(1, total * len(found) // len(sample)), seed, cosine, list_rows) for dim, found in by_dim.items()}
    links = checkpointed(embedding_links(classes, models, cosine, block))
    counts = links.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    # Classes that share a vec_id are one group.
    named = members.where("vec_id IS NOT NULL").select("vec_id", "node").distinct()
    several = named.groupBy("vec_id").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b <> last").select("vec_id", "b")
    shared = named.join(several, "vec_id").select(F.col("node").alias("a"), "b")
    labels = connected_components(links.where("b IS NOT NULL").select("a", "b").unionByName(shared))
    least_of = members.groupBy("node").agg(F.min("vec_id").alias("least"))
    groups = least_of.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    known = groups.join(least, "component").join(counts, "node", "left").select("node", "component_id", F.coalesce("n", F.lit(0)).alias("n"))
    linked = members.join(known, "node").select("vec_id", (F.col("n") + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    lone = keyed.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
