"""Density clustering of face vectors and the people founded from it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.vectors import l2_normalize
from ..schemas import Library
from .graph import components, cut, settled
from .numbering import number_rows
from .products import drawn, each_block, is_few, near_products
from .recognition import cover_faces, gallery_candidates, person_centroids, refresh_galleries, store_faces, with_quality


def resolve_algorithm(algorithm: str) -> str:
    """auto means dbscan here; hdbscan is refused, as no library for it is at hand and its clusters are others."""
    if algorithm == "hdbscan":
        raise NotImplementedError("hdbscan is not available: choose auto or dbscan")
    if algorithm not in ("auto", "dbscan"):
        raise ValueError(algorithm)
    return "dbscan"


def _hits(a_ids: np.ndarray, a: np.ndarray, b_ids: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which rows of a and b have a cosine of `least` or more and are not one point."""
    hit = a @ b.T >= least
    shared = np.isin(a_ids, b_ids)
    if shared.any():
        hit[shared] &= a_ids[shared][:, None] != b_ids[None, :]
    return hit


def _linked(least: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """`least`, the least place in reach of each place, after links from places x to places y."""
    x, y, reach = least[x], least[y], np.arange(len(least))
    while True:
        low = np.minimum(reach[x], reach[y])
        new = reach.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == reach).all():
            return reach[least]
        reach = new


def _merged(least: np.ndarray, rows: np.ndarray, cols: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """`least` after a table of links, whose rows and columns stand for these places."""
    for lo in range(0, len(rows), 256):
        part = rows[lo : lo + 256]
        # What is in one component already needs no more links, so a dense table has few.
        i, j = np.nonzero(hit[lo : lo + 256] & (least[part][:, None] != least[cols][None, :]))
        if len(i):
            least = _linked(least, part[i], cols[j])
    return least


def _first_look(unit: DataFrame, size: int, least: float, needed: int) -> DataFrame:
    """(id, n, least_id) from the products of each block with itself and with vectors drawn from all: n neighbours were found.

    With `needed` of them a point is core, whatever else is near it, and in one cluster with the core point least_id of its block.
    Rows with n = -1 link these least points and drawn core points of different blocks.
    """
    d_ids, d = drawn(unit)
    near_drawn = _hits(d_ids, d, d_ids, d, least)
    sure = near_drawn.sum(1) >= needed
    places = np.arange(sure.sum())
    roots = d_ids[sure][_merged(places, places, places, near_drawn[sure][:, sure])]
    root_of = dict(zip(d_ids[sure].tolist(), roots.tolist()))

    def look(ids, _, v):
        near, far = _hits(ids, v, ids, v, least), v @ d.T >= least
        n = near.sum(1) + far[:, ~np.isin(d_ids, ids)].sum(1)
        core = n >= needed
        own = ids[core]
        # A drawn point is in one cluster with its root.
        own_roots = np.array([root_of.get(i, i) for i in own.tolist()], dtype=np.int64)
        nodes, at = np.unique(np.concatenate([own, own_roots, roots]), return_inverse=True)
        mine, ours, theirs = np.split(at, [len(own), 2 * len(own)])
        within = _merged(np.arange(len(nodes)), mine, mine, near[core][:, core])
        across = _merged(_linked(within, mine, ours), mine, theirs, far[core][:, sure])
        least_id = ids.copy()
        least_id[core] = nodes[within[mine]]
        ends = np.unique(np.concatenate([within[mine], theirs]))
        ends = ends[across[ends] != ends]
        return pd.DataFrame({
            "id": np.concatenate([ids, nodes[ends]]),
            "n": np.concatenate([n, np.full(len(ends), -1)]),
            "least_id": np.concatenate([least_id, nodes[across[ends]]]),
        })

    return each_block(unit, size, look, "id long, n long, least_id long")


def _labelled(points: DataFrame, edges: DataFrame) -> DataFrame:
    """points (id, label) with the component of each label for it, where edges (a, b) join labels."""
    name = components(edges).select(F.col("id").alias("label"), "component")
    return points.join(name, "label", "left").select("id", F.coalesce("component", "label").alias("label"))


def dbscan(vectors: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """(id, cluster) with cluster -1 for noise, else the least core id of the cluster.

    A core point has at least min_samples points within cosine distance eps, itself among them.  Core points within eps of each
    other are one cluster; a border point joins the cluster with the least core id within its reach.

    A first look multiplies each block of neighbouring vectors with itself and with a bounded draw of all, which is as much work
    as there are vectors: most core points of dense data are known then, and most are in one component.  Three rounds of block
    products do the rest, so the result is exact: the points not known to be core are counted against all, core points outside
    the largest component are joined with all core points of other components, and points that are not core learn the least
    cluster in reach.  No round lets out pairs, so a dense cluster costs its points, not their square.
    """
    least, needed = 1.0 - eps - 1e-12, max(min_samples, 1) - 1
    unit = cut(vectors.select("id", F.lit(0).cast("long").alias("label"), l2_normalize(F.col("embedding")).alias("vector")))
    size = unit.count()
    unsure, known = unit, None
    if not is_few(size):
        found = cut(_first_look(unit, size, least, needed))
        known = found.filter(F.col("n") >= needed).select("id", F.col("least_id").alias("label"))
        known = cut(_labelled(known, found.filter("n = -1").select(F.col("id").alias("a"), F.col("least_id").alias("b"))))
        unsure = unit.join(known, "id", "left_anti")

    few = unsure.count()
    alone = 2 * few > size

    def count(a_ids, _, a, b_ids, __, b, same):
        hit = _hits(a_ids, a, b_ids, b, least)
        own = pd.DataFrame({"id": a_ids, "n": hit.sum(1)})
        return own if same or not alone else pd.concat([own, pd.DataFrame({"id": b_ids, "n": hit.sum(0)})])

    near = near_products(unit, None, least, count, "id long, n long") if alone else near_products(unsure, unit, least, count, "id long, n long")
    more = near.groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= needed).select("id", F.col("id").alias("label"))
    known = cut(more if known is None else known.union(more.join(known, "id", "left_anti")))

    def link(_, a_labels, a, __, b_labels, b, ___):
        nodes, at = np.unique(np.concatenate([a_labels, b_labels]), return_inverse=True)
        if len(nodes) < 2:
            return None
        to = _merged(np.arange(len(nodes)), at[: len(a)], at[len(a) :], a @ b.T >= least)
        linked = to != np.arange(len(nodes))
        return pd.DataFrame({"a": nodes[linked], "b": nodes[to[linked]]})

    labels = known.groupBy("label").count()
    top = labels.orderBy(F.desc("count"), "label").first()
    apart = known.filter(F.col("label") != top["label"]).count() if top else 0
    vector = unit.select("id", "vector")
    if apart:
        core = cut(vector.join(known, "id").select("id", "label", "vector"))
        outside = core.filter(F.col("label") != top["label"])
        some, others = (core, None) if 2 * apart > apart + top["count"] else (outside, core)
        known = cut(_labelled(known, near_products(some, others, least, link, "a long, b long")))

    def join_cluster(a_ids, _, a, __, labels, b, ___):
        hit = a @ b.T >= least
        own = np.where(hit, labels[None, :], np.iinfo(np.int64).max).min(1)
        some = hit.any(1)
        return pd.DataFrame({"id": a_ids[some], "reach": own[some]})

    rest, core = unit.join(known, "id", "left_anti"), vector.join(known, "id").select("id", "label", "vector")
    border = near_products(rest, core, least, join_cluster, "id long, reach long").groupBy("id").agg(F.min("reach").alias("reach"))
    return (
        vectors.select("id")
        .join(known, "id", "left")
        .join(border, "id", "left")
        .select("id", F.coalesce("label", "reach", F.lit(-1)).cast("long").alias("cluster"))
    )


def _people_of(lib: Library, clustered: DataFrame) -> DataFrame:
    """New person ids for clusters, after the highest one there is, in the order of the cluster's least id."""
    first = lib.persons.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new = number_rows(clustered.filter("cluster >= 0").select("cluster").distinct(), ["cluster"], "k")
    return new.crossJoin(F.broadcast(first)).select("cluster", (F.col("top") + 1 + F.col("k")).cast("long").alias("person_id"))  # one row


def _found(lib: Library, clustered: DataFrame) -> tuple[Library, DataFrame]:
    """Persons for all clusters, their faces assigned: the library and the new persons' faces."""
    given = cut(clustered.join(_people_of(lib, clustered), "cluster").select("id", F.col("person_id").alias("_new")))
    members = lib.faces.join(given, "id").withColumn("person_id", F.col("_new")).drop("_new")
    persons = (
        members.groupBy("person_id").agg(F.count(F.lit(1)).cast("int").alias("face_count"))
        .join(cover_faces(members), "person_id")
        .join(person_centroids(members), "person_id")
        .select(
            F.col("person_id").alias("id"), F.lit(None).cast("string").alias("display_name"), "face_count", "cover_face_id",
            F.col("centroid").cast("array<float>").alias("centroid"), F.lit(None).cast("double").alias("adaptive_threshold"),
        )
    )
    out = lib.changed("faces", patch=given.withColumnRenamed("_new", "person_id")).changed("persons", append=persons)
    return settled(out, "faces", "persons"), members


def recluster(lib: Library, config: EngineConfig, algorithm: str = "auto") -> Library:
    """Forget all persons and found one for each cluster of all faces; galleries stay empty until the next update."""
    from .mutations import clear_persons

    resolve_algorithm(algorithm)
    lib = clear_persons(lib)
    found = dbscan(lib.faces.select("id", "embedding"), config.cluster_eps, config.cluster_min_samples)
    return _found(lib, found)[0]


def found_people(lib: Library, config: EngineConfig, algorithm: str = "auto") -> Library:
    """Persons from clusters of ungrouped faces that are good enough to store; their galleries are built at once."""
    resolve_algorithm(algorithm)
    free = with_quality(lib.faces.filter(F.col("person_id").isNull()))
    good = gallery_candidates(free, config, ensure_one=False).select("id", "embedding")
    found = dbscan(good, config.cluster_eps, config.cluster_min_samples)
    lib, members = _found(lib, found)
    new = members.select(F.col("person_id").alias("id")).distinct()
    return refresh_galleries(settled(store_faces(lib, members, config, ensure_one=True), "person_embeddings"), config, new)
