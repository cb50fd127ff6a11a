"""Connected components of a graph of links, in few exchanges.

Links are settled by streams over sorted pairs, so a node's neighbours are never
held together:

* ``settle``: every node is assigned the least of its roots; only links between
  different roots of one node go on.  Links that come as stars (all members of a
  small group with its least member) shrink to the few between groups here.
* ``large`` and ``small`` star rounds over what is left, until a round changes
  nothing: larger neighbours of a node are linked with its least neighbour, then
  smaller ones.  Rounds grow with the logarithm of the number of nodes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut, streamed

LINK = "u long, v long, flag long"


def _by_least(fold):
    """Arrow stream over (u, v, ...) sorted by u and v: fold(u, v, least, first, again, flag) of each batch.

    least: the least v of a row's u; first: whether the row is u's first; again: whether it repeats the row before.
    """

    def run(batches):
        at_u = at_v = least_v = None
        for batch in batches:
            u, v = (batch.column(n).to_numpy() for n in ("u", "v"))
            if not len(u):
                continue
            flag = batch.column("flag").to_numpy() if "flag" in batch.schema.names else np.zeros(len(u), np.int64)
            first = np.ones(len(u), bool)
            first[1:] = u[1:] != u[:-1]
            first[0] = at_u is None or u[0] != at_u
            again = np.zeros(len(u), bool)
            again[1:] = ~first[1:] & (v[1:] == v[:-1])
            again[0] = not first[0] and v[0] == at_v
            begins = np.flatnonzero(first)
            firsts = v[begins]
            if not first[0]:
                begins, firsts = np.r_[0, begins], np.r_[least_v, firsts]
            least = np.repeat(firsts, np.diff(np.r_[begins, len(u)]))
            at_u, at_v, least_v = u[-1], v[-1], least[-1]
            columns = fold(u, v, least, first, again, flag)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["u", "v", "flag"])

    return run


def _settle(u, v, least, first, again, flag):
    """(node, least root, 0) of every node, and (another root, least root, 1)."""
    other = ~first & ~again & (v != least)
    keep = first | other
    return np.where(first, u, v)[keep], least[keep], (~first)[keep]


def _large(u, v, least, first, again, flag):
    """Larger neighbours of u, with the least of u and its neighbours; flag: that is not u."""
    to = np.minimum(u, least)
    keep = ~again & (v > u)
    return v[keep], to[keep], (to < u)[keep]


def _small(u, v, least, first, again, flag):
    """u and its other smaller neighbours, with the least of these; flag: something changed."""
    keep = first | (v != least) | (flag > 0)
    return np.where(first | (v == least), u, v)[keep], least[keep], np.where(v != least, 1, flag)[keep]


def _pass(rows: DataFrame, fold) -> DataFrame:
    return rows.repartition("u").sortWithinPartitions("u", "v").mapInArrow(streamed(_by_least(fold)), LINK)


def components(nodes: DataFrame, links: DataFrame, stars: bool = False) -> DataFrame:
    """(node, comp) with comp the least node reachable; links(a, b) in any direction.

    stars: every link is (member of a group, its least member), the least one's link with itself included.
    """
    rooted = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if not stars:
        rooted = rooted.unionByName(links.select(F.least("a", "b").alias("u")).distinct().withColumn("v", F.col("u")))
    settled = cut(_pass(rooted, _settle))
    edges = settled.where("flag = 1")
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = cut(_pass(_pass(both, _large), _small))
        if not edges.where("flag = 1").limit(1).count():
            break
    assigned = settled.where("flag = 0").select(F.col("u").alias("n"), F.col("v").alias("root"))
    labels = edges.select(F.col("u").alias("r"), F.col("v").alias("label"))
    assigned = assigned.join(labels, F.col("root") == F.col("r"), "left").select("n", F.coalesce("label", "root").alias("comp"))
    return nodes.select("node").distinct().join(assigned, F.col("node") == F.col("n"), "left").select("node", F.coalesce("comp", "node").alias("comp"))
