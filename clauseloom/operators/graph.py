"""Lineage and network operators over edges (src, rel_type, dst)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import GIVEN, cells, from_planes, meet, planes, ranges
from .records import numbered, once, running


def walk(edges: DataFrame, starts: DataFrame, types: list[str] | None = None, reverse: bool = False, depth: int | None = None) -> DataFrame:
    """(start, node, path, hops), one row for each path from a start of (id), no edge twice in a path.

    Frontiers are joined hop by hop, each computed once; a level without rows ends the walk, or depth hops if
    it is given. reverse follows edges from dst to src.
    """
    keep = once(edges.sparkSession)
    e = edges if types is None else edges.where(F.col("rel_type").isin(types))
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = e.select(F.col(a).alias("at"), F.col(b).alias("next"), F.concat_ws("|", "src", "rel_type", "dst").alias("edge")).distinct()
    step = keep(step)
    front = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("path"), F.array().cast("array<string>").alias("used"))
    found = None
    hop = 0
    while depth is None or hop < depth:
        hop += 1
        joined = front.join(step, F.col("node") == F.col("at")).where(~F.array_contains("used", F.col("edge")))
        front = keep(joined.select("start", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"), F.concat("used", F.array("edge")).alias("used")))
        if front.isEmpty():
            break
        level = front.withColumn("hops", F.lit(hop))
        found = level if found is None else found.unionByName(level)
    none = front.withColumn("hops", F.lit(0)).limit(0)
    return (none if found is None else found).select("start", "node", "path", "hops")


def lineage(edges: DataFrame, memo: str) -> DataFrame:
    """(basis, statute, memo, directive): constitution <- statute <- memo -> directive, and order <- memo -> directive; distinct."""
    directive = edges.where((F.col("rel_type") == "IMPLEMENTED_BY_Doc") & (F.col("src") == memo)).select(F.col("dst").alias("directive"))
    statutes = edges.where((F.col("rel_type") == "DERIVES_FROM") & (F.col("src") == memo)).select(F.col("dst").alias("id"))
    up = walk(edges, statutes, ["DERIVES_FROM_Provision"]).where(F.col("node").startswith("CONST_")).select(F.col("node").alias("basis"), F.col("start").alias("statute"))
    orders = edges.where((F.col("rel_type") == "DERIVES_FROM_Doc") & (F.col("src") == memo)).select(F.col("dst").alias("basis"), F.lit("Executive Order").alias("statute"))
    # Both sides are distinct, so their product is; its cells are dealt over tasks.
    bases = up.unionByName(orders).distinct().withColumn("memo", F.lit(memo))
    met = meet(bases.withColumn("_key", F.xxhash64("basis", "statute")), directive.distinct().withColumn("memo", F.lit(memo)), "memo", "_key", "directive")
    return met.select("basis", "statute", "memo", "directive")


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each edge once, without loops."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src != dst").distinct()


def closeness(edges: DataFrame, pairs: DataFrame, depth: int | None = None) -> DataFrame:
    """1 / (d + 1) for pairs (a, b), d the length of the shortest undirected path; 0 without one, or beyond depth edges where it is given."""
    keep = once(edges.sparkSession)
    known = pairs.where("a is not null and b is not null").select("a", "b").distinct()
    apart = _distances(keep(undirected(edges)), known.where("a != b"), keep, depth)
    found = apart.unionByName(known.where("a = b").withColumn("d", F.lit(0)))
    found = found if depth is None else found.where(F.col("d") <= depth)
    return pairs.join(found, ["a", "b"], "left").select("a", "b", F.coalesce(1 / (F.col("d") + 1), F.lit(0.0)).alias("closeness"))


def _distances(net: DataFrame, ends: DataFrame, keep, depth: int | None) -> DataFrame:
    """(a, b, d) of the pairs (a, b), a != b and each once, that a path joins in net (src, dst in both directions).

    A node with one neighbour has all its paths through it. While such leaves are a tenth of the nodes, their pairs move to the neighbours, where
    many pairs become one, and the rest is solved in the smaller net; what has no leaves is walked.
    """
    degree = net.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("up"))
    inner = degree.where("n > 1").select(F.col("src").alias("up"))
    leaf = keep(degree.where("n = 1").join(inner, "up", "left_semi").select(F.col("src").alias("leaf"), "up"))
    if leaf.count() * 10 < degree.count() or leaf.isEmpty():
        return _walked(net, ends, keep, depth)
    rest = net
    for side in ("src", "dst"):
        rest = rest.join(leaf.select(F.col("leaf").alias(side)), side, "left_anti")
    moved = ends
    for side, to in (("a", "x"), ("b", "y")):
        moved = moved.join(leaf.select(F.col("leaf").alias(side), F.col("up").alias(to)), side, "left")
    steps = F.col("x").isNotNull().cast("int") + F.col("y").isNotNull().cast("int")
    moved = keep(moved.select("a", "b", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"), steps.alias("steps")))
    between = _distances(keep(rest.select("src", "dst")), moved.where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), keep, depth)
    far = moved.where("x != y").join(between.select(F.col("a").alias("x"), F.col("b").alias("y"), "d"), ["x", "y"])
    return moved.where("x = y").select("a", "b", F.col("steps").alias("d")).unionByName(far.select("a", "b", (F.col("steps") + F.col("d")).alias("d")))


def _walked(net: DataFrame, pairs: DataFrame, keep, depth: int | None) -> DataFrame:
    """_distances by walks: all nodes reached from the left sides are kept, hop by hop, until every pair has met, nothing new is reached, or depth edges are walked."""
    pairs = keep(pairs)
    reached = pairs.select("a").distinct().select("a", F.col("a").alias("node"), F.lit(0).alias("d"))
    front, hop = reached, 0
    while depth is None or hop < depth:
        hop += 1
        # Left sides whose pairs have all met walk no further.
        open_ = pairs.select("a", F.col("b").alias("node")).join(reached, ["a", "node"], "left_anti").select("a").distinct()
        grown = front.join(open_, "a", "left_semi").join(net, F.col("node") == F.col("src")).select("a", F.col("dst").alias("node")).distinct()
        front = keep(grown.join(reached.select("a", "node"), ["a", "node"], "left_anti").withColumn("d", F.lit(hop)))
        if front.isEmpty():
            break
        reached = keep(reached.unionByName(front))
    return pairs.join(reached.withColumnRenamed("node", "b"), ["a", "b"]).select("a", "b", "d")


#: Pairs of sources, counted once for each common target, that a task of the result stands for, about.
PAIRS = 1 << 21
#: Edges that a block of sources has, about.
EDGES = 1 << 24
#: Names that a task holds before it gives them on, about.
NAMES = 1 << 19
#: A source with fewer shared targets in a block than the block has sources, by this factor, sorts them instead of counting in an array.
SPARSE = 16


def _packed():
    """Rows with ids, in order, as v: their steps, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["ids"]
            ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            v = pa.array([planes(np.diff(flat[lo:hi], prepend=0)) for lo, hi in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            at = b.schema.get_field_index("ids")
            yield b.set_column(at, pa.field("v", pa.binary()), v)

    return run


def _common_targets(least: int, named: bool, rest: bool):
    """Rows of cells: the sources of the earlier block, held as an index of their targets, and those that meet it. What both have adds up in an array."""
    listed = ["common_targets"] * named + ["targets_of_a"] * rest
    out = pa.schema([("a", pa.string()), ("b", pa.string()), *[(c, pa.list_(pa.string())) for c in listed], *[(c, pa.int64()) for c in ("common", "only_a", "only_b")]])

    def index(rows: list) -> dict:
        sizes = np.array([len(r["ids"]) for r in rows])
        ids = np.concatenate([r["ids"] for r in rows])
        order = np.argsort(ids, kind="stable")
        every, starts = np.unique(ids[order], return_index=True)
        held = {"keys": np.array([r["sid"] for r in rows]), "every": every, "starts": np.append(starts, len(ids)), "owner": np.repeat(np.arange(len(rows), dtype=np.int32), sizes)[order]}
        homes = {h: i for i, h in enumerate({r["home"] for r in rows})}
        held |= {"src": pa.array([r["src"] for r in rows], pa.string()), "n": np.array([r["n"] for r in rows]), "homes": homes, "home": np.array([homes[r["home"]] for r in rows])}
        # Edges between sources: who is named, and whom a source names.
        held["at"], held["out"] = {}, {}
        for i, r in enumerate(rows):
            held["at"].setdefault(r["src"], []).append(i)
            for name in r["out"]:
                held["out"].setdefault(name, []).append(i)
        if named:
            held |= {"names": pa.concat_arrays([r["names"] for r in rows]), "flat": order, "first": np.cumsum(sizes) - sizes, "sizes": sizes}
        return held

    def batch(held: dict, found: list) -> pa.RecordBatch:
        near, common = np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found]).astype(np.int64)
        sizes = np.array([len(f[2]) for f in found])
        cols = [held["src"].take(pa.array(near)), pa.array([f[0] for f in found], pa.string()).take(pa.array(np.repeat(np.arange(len(found)), sizes)))]
        for k, counts in [(4, common)] * named + [(5, held["sizes"][near] - common if named else None)] * rest:
            cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), held["names"].take(pa.array(np.concatenate([f[k] for f in found])))))
        cols += [pa.array(c) for c in (common, held["n"][near] - common, np.repeat([f[1] for f in found], sizes) - common)]
        return pa.RecordBatch.from_arrays(cols, schema=out)

    def met(held: dict, r: dict, same: bool) -> Iterator[tuple]:
        place = np.minimum(np.searchsorted(held["every"], r["ids"]), len(held["every"]) - 1)
        place = place[held["every"][place] == r["ids"]]
        at = ranges(held["starts"][place], held["starts"][place + 1] - held["starts"][place])
        owner = held["owner"][at]
        # A source of few targets does not pass over all sources of the block.
        near, score = np.unique(owner, return_counts=True) if len(owner) * SPARSE < len(held["keys"]) else (np.arange(len(held["keys"])), np.bincount(owner, minlength=len(held["keys"])))
        near, score = near[score >= least], score[score >= least]
        # Within a block a pair is met from both sides and counts once.
        good = held["keys"][near] < r["sid"] if same else np.ones(len(near), bool)
        if r["home"] is not None:
            good &= held["home"][near] != held["homes"].get(r["home"], -1)
        linked = [*held["out"].get(r["src"], []), *[i for name in r["out"] for i in held["at"].get(name, [])]]
        if linked:
            good &= ~np.isin(near, linked)
        near, score = near[good], score[good]
        if not len(near):
            return
        if not named:
            yield r["src"], r["n"], near, score
            return
        flat = held["flat"][at]
        # Lists of many names go in parts.
        for part in np.split(np.arange(len(near)), np.flatnonzero(np.diff(np.cumsum(held["sizes"][near]) // NAMES)) + 1):
            common = np.sort(flat[np.isin(owner, near[part])])
            others = np.zeros(0, np.int64)
            if rest:
                mine = ranges(held["first"][near[part]], held["sizes"][near[part]])
                others = np.delete(mine, np.searchsorted(mine, common))
            yield r["src"], r["n"], near[part], score[part], common, others

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, found, many = [], None, [], 0
        for b in batches:
            names = b["names"] if named else None
            plain = b.select([c for c in b.schema.names if c != "names"]).to_pylist()
            for i, r in enumerate(plain):
                r["ids"] = np.cumsum(from_planes(r.pop("v")), dtype=np.int32)
                if r["kind"] == 0:
                    rows.append(r | ({"names": names[i].values} if named else {}))
                    continue
                if held is None:
                    if not rows:
                        return
                    held, rows = index(rows), []
                for f in met(held, r, r["same"]):
                    found.append(f)
                    many += sum(map(len, f[2 if not named else 4 :]))
                    if many > (NAMES if named else GIVEN):
                        yield batch(held, found)
                        found, many = [], 0
        if found:
            yield batch(held, found)

    return run, ", ".join(["a string", "b string", *[f"{c} array<string>" for c in listed], "common long", "only_a long", "only_b long"])


def cousins(edges: DataFrame, least: int = 3, sources: DataFrame | None = None, named: bool = False, rest: bool = False) -> DataFrame:
    """(a, b, common, only_a, only_b) of sources a < b with at least least > 0 common targets and no edge between them.

    sources (id, source), where given, leaves out pairs of the same source. named adds common_targets, in order, and rest with it targets_of_a: those that b
    has not. Targets and sources are numbered in order, and sources lie in blocks of at most about EDGES edges; each pair of blocks is a task, where the
    targets of the earlier one are an index and common ones add up in an array. So an edge moves blocks + 1 times as a step of few bits, no pair is a row
    before it is found, and a pair never moves with its lists.
    """
    spark = edges.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    e = once(spark)(edges.where("src IS NOT NULL").select("src", "dst").distinct())
    ends = e.select(F.col("src").alias("dst")).distinct().withColumn("end", F.lit(True))
    targets = numbered(e.where("dst IS NOT NULL").groupBy("dst").agg(F.count("*").alias("z")).join(ends, "dst", "left"), "did", "dst")
    pairs = targets.where("z > 1").agg(F.sum(F.col("z") * F.col("z"))).first()[0] or 0
    known = e.join(targets.select("dst", F.col("did").cast("int").alias("did"), "z", "end"), "dst", "left")
    # Targets of one source count for its size alone, and among its names.
    mine = F.struct("did", "dst") if named else F.col("did")
    ids = F.sort_array(F.collect_list(F.when(F.col("did").isNotNull() if named else F.col("z") > 1, mine)))
    sets = known.groupBy("src").agg(F.count("*").alias("n"), F.count_if(F.col("z") > 1).alias("shared"), ids.alias("ids"), F.collect_list(F.when(F.col("end"), F.col("dst"))).alias("out"))
    ordered = running(sets.where(F.col("shared") >= least).drop("shared"), {"sid": F.lit(1), "upto": F.size("ids")}, "src")
    total = ordered.agg(F.max("upto")).first()[0] or 1
    blocks = max(1, -(-total // EDGES), math.isqrt(2 * n))
    ordered = ordered.withColumn("block", F.floor((F.col("upto") - F.size("ids")) * blocks / total).cast("int")).drop("upto")
    # A source of several kinds is a row for each of them.
    ordered = ordered.withColumn("home", F.lit(None).cast("string")) if sources is None else ordered.join(sources.select(F.col("id").alias("src"), F.col("source").cast("string").alias("home")).where("home IS NOT NULL"), "src")
    rows = ordered.select("block", "sid", "src", "n", "out", "home", *([F.col("ids.dst").alias("names"), F.col("ids.did").alias("ids")] if named else ["ids"]))
    kinds = ", ".join(f"{'v' if c == 'ids' else c} {'binary' if c == 'ids' else kind}" for c, kind in rows.dtypes)
    packed = once(spark)(rows.mapInArrow(_packed(), kinds))
    met = cells(packed, blocks, "block", "sid", "src", "n", "out", "home", "v", *([F.when(F.col("kind") == 0, F.col("names")).alias("names")] if named else []))
    found = met.mapInArrow(*_common_targets(least, named, rest))
    # Tasks of the result grow in number with the pairs, which lie together in few cells; lists stay where they are.
    return found if named else found.repartition(max(n, pairs // (2 * PAIRS)), "a", "b")


def shared_targets(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) with the sets of common targets and of those that one side alone has, in order.

    Pairs that bring their common_targets (cousins with named) move with these; the sets of a side lie where its pairs come, and never move with a pair.
    """
    sets = edges.select("src", "dst").distinct().groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("t"))
    x, y = sets.select(F.col("src").alias("a"), F.col("t").alias("_x")), sets.select(F.col("src").alias("b"), F.col("t").alias("_y"))
    rest = [c for c in pairs.columns if c != "common_targets"]
    if "common_targets" in pairs.columns:
        mine = pairs.join(y, "b").withColumn("targets_of_b", F.array_except("_y", "common_targets")).drop("_y")
        return mine.join(x, "a").select(*rest, "common_targets", F.array_except("_x", "common_targets").alias("targets_of_a"), "targets_of_b")
    out = pairs.join(x, "a").join(y, "b")
    return out.select(*rest, F.array_intersect("_x", "_y").alias("common_targets"), F.array_except("_x", "_y").alias("targets_of_a"), F.array_except("_y", "_x").alias("targets_of_b"))


def chains(edges: DataFrame) -> DataFrame:
    """Simple paths of two or three edges, one row an edge: (path, position, src, dst)."""
    e = edges.select("src", "dst").where("src != dst").distinct()
    nxt = lambda i: e.select(F.col("src").alias(f"n{i - 1}"), F.col("dst").alias(f"n{i}"))
    two = nxt(1).join(nxt(2), "n1").where("n0 != n2").select("n0", "n1", "n2")
    three = two.join(nxt(3), "n2").where("n3 != n0 and n3 != n1").select("n0", "n1", "n2", "n3")
    paths = two.select(F.array("n0", "n1", "n2").alias("path")).unionByName(three.select(F.array("n0", "n1", "n2", "n3").alias("path")))
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("src"), F.element_at("path", i + 1).alias("dst")))
    return paths.select("path", F.posexplode(steps)).select("path", F.col("pos").alias("position"), "col.src", "col.dst")


def shared_obligations(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Provisions that bind both institutions."""
    bound = edges.where("rel_type = 'BOUND_BY'")
    of = lambda i: bound.where(F.col("src") == i).select("dst").distinct()
    return of(a).join(of(b), "dst").select(F.col("dst").alias("provision"))


def bound_provisions(edges: DataFrame, institution: str, prefixes=("USC_", "CFR_")) -> DataFrame:
    """G10."""
    start = F.lit(False)
    for p in prefixes:
        start |= F.col("dst").startswith(p)
    return edges.where((F.col("rel_type") == "BOUND_BY") & (F.col("src") == institution) & start).select(F.col("dst").alias("provision")).distinct()


def issued(edges: DataFrame, documents: DataFrame, institution: str, kind: str) -> DataFrame:
    """Documents of a type that the institution issues, newest first."""
    d = edges.where((F.col("rel_type") == "ISSUES") & (F.col("src") == institution)).select(F.col("dst").alias("id"))
    return documents.join(d, "id", "left_semi").where(F.col("type") == kind).orderBy(F.col("date").desc(), "id")


def targets(edges: DataFrame, rel_type: str, source: str) -> DataFrame:
    """What one node reaches by one type of edge."""
    return edges.where((F.col("rel_type") == rel_type) & (F.col("src") == source)).select(F.col("dst").alias("id")).distinct()


def influence(edges: DataFrame, documents: DataFrame, memo: str, kind: str, codes: list[str]) -> DataFrame:
    """+2 where the memo names the directive, +1 where it is in a category and its code is listed; only above 0."""
    direct = targets(edges, "IMPLEMENTED_BY_Doc", memo).withColumn("direct", F.lit(2))
    categorised = edges.where("rel_type = 'IN_CATEGORY'").select(F.col("src").alias("id")).distinct().withColumn("cat", F.lit(1))
    d = documents.where(F.col("type") == kind).join(direct, "id", "left").join(categorised, "id", "left")
    d = d.withColumn("direct", F.coalesce("direct", F.lit(0))).withColumn("cat", F.when(F.col("categoryCode").isin(codes), F.coalesce("cat", F.lit(0))).otherwise(0))
    out = d.select("id", (F.col("direct") + F.col("cat")).alias("influence"), F.when(F.col("direct") > 0, "Direct").otherwise("Category").alias("kind"))
    return out.where("influence > 0").orderBy(F.desc("influence"), "id")


def section_parents(sections: DataFrame) -> DataFrame:
    """The nearest earlier shallower section of (doc, pos, level) is the parent: parent_pos or null.

    For each level l that the table has, a running maximum gives the last position of a section above l; levels are few.
    """
    levels = [r.level for r in sections.select("level").distinct().orderBy("level").limit(257).collect()]
    if len(levels) > 256:
        raise ValueError("sections have more than 256 levels")
    w = W.partitionBy("doc").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    parent = F.lit(None).cast(dict(sections.dtypes)["pos"])
    for level in levels[1:]:
        parent = F.when(F.col("level") == level, F.max(F.when(F.col("level") < level, F.col("pos"))).over(w)).otherwise(parent)
    return sections.select("doc", "pos", "level", parent.alias("parent_pos"))


def edge_list(edges: DataFrame, types: list[str]) -> DataFrame:
    """The distinct edges of a view."""
    return edges.where(F.col("rel_type").isin(types)).select("src", "rel_type", "dst").distinct()
