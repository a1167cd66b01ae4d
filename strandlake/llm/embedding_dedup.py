"""Embedding near-duplicates by PCA-ordered tiles.

Equal vectors of a label are folded to one class first. Classes are rotated to the principal axes of the whole table
and compared tile against tile inside their label: the products of the leading axes are summed first, what the other
axes can still add is bounded by the product of suffix norms, and a tile stops as soon as no pair can reach the
threshold. Survivors are confirmed by the cosine of the unrotated vectors in double precision.

A tile pair returns at most one row per class (its number of links and its root in a local spanning forest), never
the pairs, so a group of thousands of mutual near copies costs rows in proportion to its members. Classes are numbered;
ids come in at the end, so one id may stand on several vectors, each of which has its own links.

Memory: the axes take length**2 doubles per vector length, on the driver and in every task.

Edge cases: null labels, and vectors that are null, empty, zero or hold nulls or non-finite numbers, link with nothing
and stay; vectors of different lengths are never compared; repeated rows are copies of one another; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import materialise, named
from strandlake.llm.components import connected_components, hook

THRESHOLD = 0.93
TILE = 4096
STRIP = 512
SLACK = 1e-9


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length its axes, largest variance first, from the second moments of all rows.

    Partitions send length**2 / 2 sums each, which are added up before the driver sees them.
    """

    def moments(batches):
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for dim, group in pdf.groupby("dim"):
                x = np.stack(group["vec"].to_numpy()).astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                sums[dim] = sums.get(dim, 0) + x.T @ x
        for dim, m in sums.items():
            row, col = np.triu_indices(dim)
            yield pd.DataFrame({"dim": np.int32(dim), "row": row.astype(np.int32), "col": col.astype(np.int32), "value": m[row, col]})

    sums = classes.select("dim", "vec").mapInPandas(moments, "dim int, row int, col int, value double")
    axes: dict[int, np.ndarray] = {}
    for dim, group in sums.groupBy("dim", "row", "col").agg(F.sum("value").alias("value")).toPandas().groupby("dim"):
        m = np.zeros((dim, dim))
        m[group["row"], group["col"]] = m[group["col"], group["row"]] = group["value"]
        axes[int(dim)] = np.linalg.eigh(m)[1][:, ::-1]
    return axes


def tile_links(x: np.ndarray, y: np.ndarray | None, wx: np.ndarray, wy: np.ndarray, axes: np.ndarray, threshold: float = THRESHOLD):
    """Weighted link counts of the rows of x and y and their local component labels (rows of y after those of x).

    y None compares x with itself, each pair once.
    """
    n, own = len(x), y is None
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    y = x if own else y / np.linalg.norm(y, axis=1, keepdims=True)
    px, py = x @ axes, y @ axes
    dim = x.shape[1]
    cuts = sorted({min(dim, c) for c in (8, 24, dim)})
    links_x, links_y = np.zeros(n, np.int64), np.zeros(len(y), np.int64)
    label = np.arange(n if own else n + len(y))
    for lo in range(0, n, STRIP):
        strip = px[lo : lo + STRIP]
        done, start, i, j = np.zeros((len(strip), len(py))), 0, None, None
        for cut in cuts:
            tail = np.linalg.norm(strip[:, cut:], axis=1), np.linalg.norm(py[:, cut:], axis=1)
            if i is None:
                done += strip[:, start:cut] @ py[:, start:cut].T
                i, j = np.nonzero(done + np.outer(*tail) >= threshold - SLACK)
                part = done[i, j]
                if len(i) * 8 > done.size and cut < dim:  # dense: whole tiles are faster than single pairs
                    i = j = None
            else:
                part = part + np.einsum("ij,ij->i", strip[i, start:cut], py[j, start:cut])
                alive = part + tail[0][i] * tail[1][j] >= threshold - SLACK
                i, j, part = i[alive], j[alive], part[alive]
            start = cut
            if i is not None and not len(i):
                break
        i = i + lo
        if own:
            i, j = i[i < j], j[i < j]
        for a in range(0, len(i), 1 << 18):
            s, t = i[a : a + (1 << 18)], j[a : a + (1 << 18)]
            real = np.einsum("ij,ij->i", x[s], y[t]) >= threshold
            s, t = s[real], t[real]
            links_x += np.bincount(s, wy[t], n).astype(np.int64)
            links_y += np.bincount(t, wx[s], len(y)).astype(np.int64)
            label = hook(label, s, t if own else t + n)
    return (links_x + links_y, None, label) if own else (links_x, links_y, label)


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """key, n_links, component_id and kept for every row of df."""
    rows = df.select(named(key).alias("id"), named(label).alias("label"), named(vector).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("id").isNotNull() & finite & F.exists("vec", lambda v: v != 0.0), F.lit(False))
    rows = rows.withColumn("ok", usable).withColumn("h1", F.when(F.col("ok"), F.xxhash64("vec"))).withColumn("h2", F.when(F.col("ok"), F.xxhash64(F.lit(1), "vec")))
    classes = rows.where("ok").groupBy("label", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec")).withColumn("dim", F.size("vec"))
    classes = materialise(classes.withColumn("class", F.monotonically_increasing_id()), "classes")  # read, never made again
    axes = principal_axes(classes)

    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("label", "dim", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "class", "copies", "vec")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf["tile"].to_numpy() == pdf["a"].iloc[0]
        pdf = pd.concat([pdf[first], pdf[~first]])
        x, w, n = np.stack(pdf["vec"].to_numpy()), pdf["copies"].to_numpy(), int(first.sum())
        own = pdf["a"].iloc[0] == pdf["b"].iloc[0]
        if not own and n == len(pdf):
            return pd.DataFrame({"class": [], "links": [], "root": []}).astype("int64")
        lx, ly, lab = tile_links(x[:n], None if own else x[n:], w[:n], w[:n] if own else w[n:], axes[int(pdf["dim"].iloc[0])], threshold)
        links, ids = (lx if own else np.concatenate([lx, ly])), pdf["class"].to_numpy()
        hit = links > 0
        return pd.DataFrame({"class": ids[hit], "links": links[hit], "root": ids[lab][hit]})

    found = dealt.groupBy("label", "dim", "a", "b").applyInPandas(compare, "class long, links long, root long")
    found = materialise(found, "links")
    parts = connected_components(found.select(F.col("class").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    known = classes.drop("vec", "dim").join(links, "class", "left").join(parts.withColumnRenamed("node", "class"), "class", "left")
    known = known.withColumn("component", F.coalesce("component", "class"))
    smallest = known.groupBy("component").agg(F.min("rep").alias("smallest"))
    known = materialise(known.join(smallest, "component").select("label", "h1", "h2", "copies", "links", "smallest"), "known")
    out = rows.drop("vec").join(known, ["label", "h1", "h2"], "left")
    component = F.coalesce("smallest", "id")
    return out.select(F.col("id").alias(key), F.when(F.col("ok"), F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.cast("long").alias("component_id"), (F.col("id") == component).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of a label in SQL; components by a recursive reachability query.
OP6_SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
), ok as (
  select vec_id, label, e, sqrt(list_inner_product(e, e)) as n from v
  where label is not null and vec_id is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as u, b.vec_id as v from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93
), reach(u, v) as (
  select vec_id, vec_id from ok union select r.u, l.v from reach r join links l on r.v = l.u
), comp as (select u, min(v) as c from reach group by u), cnt as (select u, count(*) as n from links group by u)
select vec_id, coalesce(cnt.n, 0)::bigint as n_links, coalesce(comp.c, vec_id)::bigint as component_id, vec_id = coalesce(comp.c, vec_id) as kept
from embeddings left join cnt on cnt.u = vec_id left join comp on comp.u = vec_id
"""
