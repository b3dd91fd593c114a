"""Residue graphs: pair distances, nearest neighbours, edge features, decoding order.

No join of points takes a structure alone as its key, so one structure of any size goes over many tasks. All pairs meet tile by tile; where only near ones are asked for, or an order of positions for
each, a structure whose ids fall into a block of 256 is one row, whose points meet there. Nearest neighbours of structures of
up to ``small`` points come from their pairs; in larger ones from a hierarchy of cells whose width halves from level to level: a point is placed at the deepest level
where its cell still holds about a third of k points, and meets the cells around its own by an equi join. A point whose k-th neighbour isn't surely among them
goes up a level, where cells are twice as wide, until all are sure. Results are those of comparing all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..functions.geometry import distance, normal, rbf, virtual_cbeta
from ..scratch import cut
from ..session import ship
from .ranks import copies, with_small


def points(residues: DataFrame, *more: str, at: str = "ca", place: str = "global_pos") -> DataFrame:
    """name, id, x, y, z of the residues that have the atom, and more of their columns."""
    return residues.filter(F.col(at).isNotNull()).select(
        "name",
        F.col(place).cast("long").alias("id"),
        *[F.col(at)[i].alias(c) for i, c in enumerate("xyz")],
        *more,
    )


def _ends(p: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    name = lambda side, key: p.select("name", F.col("id").alias(key), *[F.col(c).alias(side + c) for c in "xyz"], *more)
    return name("a", "src"), name("b", "dst")


def _d() -> Column:
    return distance([F.col("a" + c) for c in "xyz"], [F.col("b" + c) for c in "xyz"])


def tiled(p: DataFrame, tile: int = 512) -> DataFrame:
    """p with _tiles, how many tiles of about ``tile`` points its structure has, and _tile, the one of each."""
    counts = p.groupBy("name").agg(F.ceil(F.count("*") / tile).cast("int").alias("_tiles"))
    return with_small(p, counts).withColumn("_tile", F.pmod(F.xxhash64("id"), F.col("_tiles")).cast("int"))


def pair_distances(p: DataFrame, within: float | None = None, tile: int = 512) -> DataFrame:
    """name, src, dst, dist of all ordered pairs of a structure, self included: pairs of tiles are a join's keys. within: only pairs closer than that.

    With within a structure whose ids fall into one block is one row and its points are compared there; the others' meet in cells of that width.
    """
    if within is None:
        return _pairs_met(p, None, tile)
    blocks, rest = _blocks(p, "id", "x", "y", "z")
    ends = blocks.select("name", "pts", F.explode("pts").alias("_s")).select("name", "_s", F.explode("pts").alias("_q"))
    found = ends.select("name", F.col("_s.id").alias("src"), F.col("_q.id").alias("dst"), _in_block(F.col("_s"), F.col("_q")).alias("dist")).filter(F.col("dist") < within)
    return found if rest is None else found.unionByName(_pairs_met(rest, within, tile))


def _pairs_met(p: DataFrame, within: float | None = None, tile: int = 512) -> DataFrame:
    """pair_distances by joins of points."""
    if within is not None:
        a, b = _ends(p)
        a = a.select("*", *[F.floor(F.col(f"a{c}") / within).cast("long").alias(f"g{c}") for c in "xyz"])
        b = b.select("name", "dst", "bx", "by", "bz", *[F.floor(F.col(f"b{c}") / within).cast("long").alias(f"g{c}") for c in "xyz"])
        near = a.join(_around(b).hint("merge"), ["name", "gx", "gy", "gz"])
        return near.withColumn("dist", _d()).filter(F.col("dist") < within).select("name", "src", "dst", "dist")
    a, b = _ends(tiled(p, tile), "_tile", "_tiles")
    a = copies(a.withColumnRenamed("_tile", "_a"), "_b", F.col("_tiles")).drop("_tiles")
    b = copies(b.withColumnRenamed("_tile", "_b"), "_a", F.col("_tiles")).drop("_tiles")
    return a.join(b.hint("merge"), ["name", "_a", "_b"]).select("name", "src", "dst", _d().alias("dist"))


def _around(cells: DataFrame) -> DataFrame:
    """Each row at its own cell and at the 26 around it."""
    steps = F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y"), F.lit(m).alias("z")) for i in (-1, 0, 1) for j in (-1, 0, 1) for m in (-1, 0, 1)])
    rest = [c for c in cells.columns if c not in ("gx", "gy", "gz")]
    return cells.withColumn("s", F.explode(steps)).select(*rest, *[(F.col(f"g{c}") + F.col(f"s.{c}")).alias(f"g{c}") for c in "xyz"])


def _nearest(pairs: DataFrame, k: int, by: list[str] = ["name"]) -> DataFrame:  # noqa: B006
    rank = F.row_number().over(W.partitionBy(*by, "src").orderBy(F.round("dist", 6), "dst"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


#: Levels looked at in one pass above and below the one that even density asks for; the deepest level there is.
_LEVELS_UP, _LEVELS_DOWN, _DEEPEST = 2, 3, 40


def _cell(level: Column) -> list[Column]:
    """A point's cell at a level: the structure's box is one cell at level 0."""
    return [F.floor((F.col(c) - F.col(f"_{c}0")) / F.col("_wide") * F.pow(F.lit(2.0), level)).cast("long").alias(f"g{c}") for c in "xyz"]


def _placed(sites: DataFrame, k: int) -> DataFrame:
    """Sites (name, id, x, y, z and more) with their structure's box (_x0, _y0, _z0, _wide) and their level, at least 1."""
    box = sites.groupBy("name").agg(F.count("*").alias("_sites"), *[f(c).alias(f"_{c}{i}") for c in "xyz" for i, f in ((0, F.min), (1, F.max))])
    span = [F.col(f"_{c}1") - F.col(f"_{c}0") for c in "xyz"]
    wide = F.greatest(*span, F.lit(1e-3)) * 1.0001
    # Where points fill their box evenly a cell of this width holds about half of k points.
    even = F.cbrt((span[0] + 1) * (span[1] + 1) * (span[2] + 1) * k / 2 / F.col("_sites"))
    start = F.greatest(F.lit(1), F.floor(F.log2(wide / even)).cast("int"))
    todo, done = cut(with_small(sites, box.select("name", "_x0", "_y0", "_z0", wide.alias("_wide"), start.alias("_start"))), "boxed"), None
    least = F.greatest(F.col("_start") - _LEVELS_UP, F.lit(1))
    while True:
        levels = todo.withColumn("level", F.explode(F.sequence(least, F.col("_start") + _LEVELS_DOWN))).select("name", "id", "level", *_cell(F.col("level")))
        cell = ["name", "level", "gx", "gy", "gz"]
        full = levels.groupBy(*cell).agg(F.count("*").alias("_held")).filter(F.col("_held") * 3 >= k)
        deepest = levels.join(full.hint("merge"), cell).groupBy("name", "id").agg(F.max(F.struct("level", "_held")).alias("_best"))
        found = cut(todo.join(deepest.hint("merge"), ["name", "id"], "left").withColumn("level", F.coalesce("_best.level", F.greatest(least - 1, F.lit(1)))), "levels")
        # Where a cell of the deepest level tried holds many points, levels further down are tried.
        crowded = F.coalesce((F.col("_best.level") == F.col("_start") + _LEVELS_DOWN) & (F.col("_best._held") > 8 * k) & (F.col("level") < _DEEPEST), F.lit(False))
        settled = found.filter(~crowded).drop("_best", "_start")
        done = settled if done is None else done.unionByName(settled)
        todo = found.filter(crowded).withColumn("_start", F.col("_start") + _LEVELS_UP + _LEVELS_DOWN + 1).drop("_best", "level")
        least = F.col("_start") - _LEVELS_UP
        if todo.isEmpty():
            return done


def _rings(queries: DataFrame, sites: DataFrame, k: int) -> DataFrame:
    """The k nearest ids (name, src, dst, rank, dist) of each query, of the ids that sites list. queries, sites: placed; sites have ids, up to k of each place."""
    # Tables of points are small as files and large in memory: none is broadcast, which would hold it in the driver.
    found, todo = None, queries
    while True:
        own = ["qx", "qy", "qz"]
        here = todo.select("name", F.col("id").alias("src"), *[F.col(c).alias("a" + c) for c in "xyz"], "level", "_wide", *[g.alias(q) for g, q in zip(_cell(F.col("level")), own, strict=True)])
        cells = here.select("name", "level", *own).distinct()
        wanted = _around(cells.select("*", *[F.col(q).alias("g" + q[1]) for q in own]))
        used = cells.groupBy("name").agg(F.collect_set("level").alias("_levels"))  # _DEEPEST at most
        at = with_small(sites.drop("level"), used).withColumn("level", F.explode("_levels"))
        held = at.select("name", "level", *_cell(F.col("level")), "ids", *[F.col(c).alias("b" + c) for c in "xyz"])
        near = held.join(wanted.hint("merge"), ["name", "level", "gx", "gy", "gz"]).drop("gx", "gy", "gz")
        # Beyond a cell's width there may be sites that weren't met; with two cells a side all are.
        reach = F.when(F.col("level") <= 1, F.lit(float("inf"))).otherwise(F.col("_wide") / F.pow(F.lit(2.0), F.col("level"))).alias("_reach")
        cell = ["name", "level", *own]
        pairs = here.join(near.hint("merge"), cell).select(*cell, "src", reach, _d().alias("dist"), "ids").filter(F.col("dist") < F.col("_reach"))
        # A point has one cell: by cell and point pairs lie as the join left them, and aren't shuffled.
        best = cut(_nearest(pairs.select(*cell, "src", "_reach", "dist", F.explode("ids").alias("dst")), k, cell).drop(*cell[1:]), "neighbours")
        within = F.count_if(F.col("dist") < F.col("_reach") - 2e-6) == k  # with a margin for ties
        sure = best.groupBy("name", "src").agg((within | (F.max("_reach") == float("inf"))).alias("_sure")).filter("_sure").drop("_sure")
        kept = best.join(sure.hint("merge"), ["name", "src"], "left_semi").drop("_reach")
        found = kept if found is None else found.unionByName(kept)
        todo = cut(todo.join(sure.withColumnRenamed("src", "id").hint("merge"), ["name", "id"], "left_anti").withColumn("level", F.col("level") - 1), "unsure")
        if todo.isEmpty():
            return found


#: Points of a structure in one row: a block holds ids from a multiple of this on.
_BLOCK = 256


def _blocks(p: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame | None]:
    """Structures whose ids fall into one block, a row each with its points (pts: id, which comes first, and other columns, by id); the points of all others, None if there are none."""
    each = F.struct(*columns)
    held = p.groupBy("name", F.floor(F.col("id") / _BLOCK).alias("_block")).agg(F.sort_array(F.collect_list(each)).alias("pts"))
    blocks = cut(held, "blocks")
    # Ids given twice make a block no longer bounded by its ids.
    odd = F.max(F.size("pts")) > _BLOCK
    large = cut(blocks.groupBy("name").agg(F.count("*").alias("_n"), odd.alias("_odd")).filter((F.col("_n") > 1) | F.col("_odd")).select("name"), "large")
    if large.isEmpty():
        return blocks.drop("_block"), None
    rest = blocks.join(large.hint("merge"), "name", "left_semi").select("name", F.explode("pts").alias("_p")).select("name", "_p.*")
    return blocks.join(large.hint("merge"), "name", "left_anti").drop("_block"), rest


def _in_block(a: Column, b: Column) -> Column:
    return distance([a[c] for c in "xyz"], [b[c] for c in "xyz"])


def _ranked(candidates: Column, k: int) -> Column:
    """The k first of an array of (r, dst, ...), r the rounded distance."""
    return F.slice(F.sort_array(candidates), 1, k)


def knn_graph(p: DataFrame, k: int = 30, small: int = 256, carried: tuple[str, ...] = ()) -> DataFrame:
    """name, src, dst, rank, dist: the min(k, n) nearest of each point, itself included, ties by dst. carried: columns of p, which come back as s_<column> of src and d_<column> of dst.

    A structure whose ids fall into one block is one row, whose points are compared there (see nearby), all pairs or, with small = 0, those of cells; no pair is shuffled. For the
    other structures see _met.
    """
    blocks, rest = _blocks(p, "id", "x", "y", "z", *carried)
    few = _near(blocks, k, carried, not small)
    return few if rest is None else few.unionByName(_with_ends(_met(rest.select("name", "id", "x", "y", "z"), k, small), rest, carried).select(*few.columns))


def _near(blocks: DataFrame, k: int, carried: tuple[str, ...], cells: bool) -> DataFrame:
    """knn_graph of blocks, each row's points among themselves."""
    ship(blocks.sparkSession)
    of = blocks.schema["pts"].dataType.elementType
    ends = [T.StructField(s + c, of[c].dataType) for s in ("s_", "d_") for c in carried]
    long = [T.StructField(c, of["id"].dataType) for c in ("src", "dst")]
    schema = T.StructType([blocks.schema["name"], *long, T.StructField("rank", T.IntegerType()), T.StructField("dist", T.DoubleType()), *ends])

    def run(batches):
        from strandframe.operators import nearby

        for batch in batches:
            yield from nearby.edges(batch, k, carried, cells)

    return blocks.select("name", "pts").mapInArrow(run, schema)


def _with_ends(edges: DataFrame, p: DataFrame, carried: tuple[str, ...]) -> DataFrame:
    for side, key in (("s_", "src"), ("d_", "dst")) if carried else ():
        edges = edges.join(p.select("name", F.col("id").alias(key), *[F.col(c).alias(side + c) for c in carried]).hint("merge"), ["name", key])
    return edges


def _met(p: DataFrame, k: int, small: int) -> DataFrame:
    """knn_graph by joins of points: pairs of structures of up to ``small`` points, cells for larger ones.

    In structures of over ``small`` points those of equal coordinates are one site, of which only the k least ids can be anyone's neighbours, so copies of a point don't
    meet one another.
    """
    columns = ["name", "src", "dst", "rank", "dist"]
    sized = cut(with_small(p.select("name", "id", "x", "y", "z"), p.groupBy("name").agg(F.count("*").alias("_n"))), "points")
    few = _nearest(_pairs_met(sized.filter(F.col("_n") <= small).drop("_n"), tile=max(small, 1)), k).select(*columns)
    many = sized.filter(F.col("_n") > small).drop("_n")
    if many.isEmpty():
        return few
    xyz = ["name", "x", "y", "z"]
    same = F.row_number().over(W.partitionBy(*xyz).orderBy("id"))
    sites = many.withColumn("_r", same).filter(F.col("_r") <= k).groupBy(*xyz).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    placed = cut(_placed(sites.withColumn("id", F.col("ids")[0]), k), "sites")
    found = _rings(placed.drop("ids"), placed, k).select(*columns)
    others = many.join(placed.select(*xyz, F.col("id").alias("_site")).hint("merge"), xyz).filter(F.col("id") != F.col("_site"))
    alike = others.select("name", F.col("id").alias("_own"), F.col("_site").alias("src")).join(found.hint("merge"), ["name", "src"])
    return few.unionByName(found).unionByName(alike.select("name", F.col("_own").alias("src"), "dst", "rank", "dist"))


def masked_knn(p: DataFrame, k: int = 30, small: int = 256) -> DataFrame:
    """As knn_graph over points with mask (0 or 1): a pair with a masked point is as far as the row's farthest pair without one; a masked row's are all at 0. Ties by dst.

    A structure whose ids fall into one block is one row and is compared there, the k least masked ids with it; for the other structures see _masked_met.
    """
    columns = ["name", "src", "dst", "rank", "dist"]
    blocks, rest = _blocks(p, "id", "x", "y", "z", "mask")
    parted = blocks.select("name", "pts", F.filter("pts", lambda q: q["mask"] == 1).alias("_seen"), F.slice(F.filter("pts", lambda q: q["mask"] == 0), 1, k).alias("_hidden"))
    seen = parted.select("name", "_seen", "_hidden", F.explode("_seen").alias("_s"))
    one = lambda d, q: F.struct(F.round(d, 6).alias("r"), q["id"].alias("dst"), d.alias("dist"))
    near = seen.select("name", "_s.id", "_hidden", F.transform("_seen", lambda q: one(_in_block(F.col("_s"), q), q)).alias("_near"))
    far = F.array_max(F.transform("_near", lambda e: e["dist"]))
    masked = near.withColumn("_far", far).withColumn("_masked", F.transform("_hidden", lambda q: one(F.col("_far"), q)))
    found = masked.select("name", F.col("id").alias("src"), F.posexplode(_ranked(F.concat("_near", "_masked"), k)).alias("_i", "_d"))
    blind = parted.select("name", F.explode(F.filter("pts", lambda q: q["mask"] == 0)).alias("_s"), F.slice("pts", 1, k).alias("_first"))
    nothing = blind.select("name", F.col("_s.id").alias("src"), F.posexplode("_first").alias("_i", "_d"))
    rank = (F.col("_i") + 1).alias("rank")
    few = found.select("name", "src", "_d.dst", rank, "_d.dist").unionByName(nothing.select("name", "src", F.col("_d.id").alias("dst"), rank, F.lit(0.0).alias("dist")))
    return few if rest is None else few.unionByName(_masked_met(rest, k, small).select(*columns))


def _masked_met(p: DataFrame, k: int, small: int) -> DataFrame:
    """masked_knn by joins.

    Masked points come last in an unmasked row's order, so they matter only where k unmasked ones nearer than the farthest aren't there: these rows, a few for each
    structure, are found by its outermost points and compared with all its unmasked points, tile by tile.
    """
    p = cut(p.select("name", "id", "x", "y", "z", "mask"), "masked")
    seen, hidden = p.filter("mask = 1").drop("mask"), p.filter("mask = 0").select("name", "id")
    near = cut(_met(seen, k, small), "seen")
    place = F.struct("x", "y", "z")
    outer = seen.groupBy("name").agg(F.array(*[f(place, c) for c in "xyz" for f in (F.min_by, F.max_by)]).alias("_outer"))
    first = lambda t: t.withColumn("_r", F.row_number().over(W.partitionBy("name").orderBy("id"))).filter(F.col("_r") <= k).groupBy("name").agg(F.array_sort(F.collect_list("id")).alias("_first"))
    masked = first(hidden)
    last = near.groupBy("name", "src").agg(F.count("*").alias("_c"), F.max("dist").alias("_last")).withColumnRenamed("src", "id")
    apart = F.array_max(F.transform("_outer", lambda o: distance([F.col(c) for c in "xyz"], [o[c] for c in "xyz"])))
    rows = with_small(seen, outer.join(masked.select("name"), "name")).join(last, ["name", "id"])
    short = cut(rows.filter((F.col("_c") < k) | (F.round("_last", 6) >= F.round(apart, 6))).select("name", "id", "x", "y", "z"), "short")
    tiles = tiled(seen)
    every = tiles.select("name", "_tile", *[F.col(c).alias("b" + c) for c in "xyz"])
    asked = with_small(short, tiles.select("name", "_tiles").distinct())
    asked = copies(asked, "_tile", F.col("_tiles")).select("name", "_tile", F.col("id").alias("src"), *[F.col(c).alias("a" + c) for c in "xyz"])
    far = asked.join(every, ["name", "_tile"]).groupBy("name", "src").agg(F.max(_d()).alias("dist"))
    more = far.join(masked, "name").select("name", "src", F.explode("_first").alias("dst"), "dist")
    again = near.join(short.select("name", F.col("id").alias("src")), ["name", "src"], "left_semi").select("name", "src", "dst", "dist")
    changed = _nearest(again.unionByName(more), k)
    blind = with_small(hidden, first(p.select("name", "id"))).select("name", F.col("id").alias("src"), F.posexplode("_first").alias("_i", "dst"))
    columns = ["name", "src", "dst", "rank", "dist"]
    return (
        near.join(short.select("name", F.col("id").alias("src")), ["name", "src"], "left_anti").select(*columns)
        .unionByName(changed.select(*columns))
        .unionByName(blind.select("name", "src", "dst", (F.col("_i") + 1).alias("rank"), F.lit(0.0).alias("dist")))
    )


def five_atoms() -> Column:
    """(atom, p) of N, CA, C, O and virtual CB of a complete residue."""
    xyz = {x: [F.col(x)[i] for i in range(3)] for x in ("n", "ca", "c", "o")}
    cb = F.array(*virtual_cbeta(xyz["n"], xyz["ca"], xyz["c"]))
    return F.array(*[F.struct(F.lit(x.upper()).alias("atom"), (F.col(x) if x != "cb" else cb).alias("p")) for x in ("n", "ca", "c", "o", "cb")])


#: Numbers of five_numbers.
FIVE = tuple(f"{a}_{c}" for a in ("n", "ca", "c", "o", "cb") for c in "xyz")


def five_numbers() -> list[Column]:
    """five_atoms as columns of numbers (FIVE), null for residues that aren't complete."""
    xyz = {x: [F.col(x)[i] for i in range(3)] for x in ("n", "ca", "c", "o")}
    xyz["cb"] = virtual_cbeta(xyz["n"], xyz["ca"], xyz["c"])
    return [F.when(F.col("mask") == 1, v).alias(f"{a}_{c}") for a in xyz for c, v in zip("xyz", xyz[a], strict=True)]


def mean_atom_pairs(edges: DataFrame) -> DataFrame:
    """name, a, b, n, mean_dist: the distances of atom_pairs, averaged over each structure's edges, from s_ and d_ numbers (FIVE) of both ends. An edge stays one row, its 25 distances are columns."""
    at = lambda side, a: [F.col(f"{side}_{a}_{c}") for c in "xyz"]
    atoms = list(dict.fromkeys(f.split("_")[0] for f in FIVE))
    whole = edges.filter(F.col(f"s_{FIVE[0]}").isNotNull() & F.col(f"d_{FIVE[0]}").isNotNull())
    means = whole.groupBy("name").agg(F.count("*").alias("n"), *[F.avg(distance(at("s", a), at("d", b))).alias(f"_{a}_{b}") for a in atoms for b in atoms])
    each = F.array(*[F.struct(F.lit(a.upper()).alias("a"), F.lit(b.upper()).alias("b"), F.col(f"_{a}_{b}").alias("mean_dist")) for a in atoms for b in atoms])
    return means.select("name", "n", F.inline(each)).select("name", "a", "b", "n", "mean_dist")


def atom_pairs(edges: DataFrame, of_src: Column, of_dst: Column) -> DataFrame:
    """name, src, dst, a, b, dist of the 25 ordered pairs of atoms (five_atoms of both ends) on each edge; edges without either go."""
    joined = edges.select("name", "src", "dst", of_src.alias("sa"), of_dst.alias("da")).filter("sa IS NOT NULL AND da IS NOT NULL")
    each = joined.select("name", "src", "dst", F.explode("sa").alias("s"), "da").select("name", "src", "dst", "s", F.explode("da").alias("t"))
    return each.select(
        "name",
        "src",
        "dst",
        F.col("s.atom").alias("a"),
        F.col("t.atom").alias("b"),
        distance([F.col("s.p")[i] for i in range(3)], [F.col("t.p")[i] for i in range(3)]).alias("dist"),
    )


def atom_pair_distances(edges: DataFrame, residues: DataFrame, place: str = "global_pos") -> DataFrame:
    """atom_pairs of edges (name, src, dst) between complete residues."""
    whole = residues.filter("mask = 1").select("name", F.col(place).cast("long").alias("id"), five_atoms().alias("atoms"))
    joined = edges.join(
        whole.select("name", F.col("id").alias("src"), F.col("atoms").alias("sa")),
        ["name", "src"],
    ).join(whole.select("name", F.col("id").alias("dst"), F.col("atoms").alias("da")), ["name", "dst"])
    return atom_pairs(joined, F.col("sa"), F.col("da"))


def gather_neighbors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the neighbour's features behind their own; nodes: name, id, features; edges: name, src, dst, features."""
    at = nodes.select("name", F.col("id").alias("dst"), F.col("features").alias("_node"))
    return edges.join(at, ["name", "dst"]).withColumn("features", F.concat("features", "_node")).drop("_node")


def neighbor_sum(messages: DataFrame, scale: float = 30.0) -> DataFrame:
    """Sum of msg * mask over each source's edges, over scale."""
    return messages.groupBy("name", "src").agg((F.sum(F.col("msg") * F.col("mask")) / scale).alias("total"))


def edge_rbf(edges: DataFrame) -> DataFrame:
    return edges.withColumn("rbf", rbf(F.col("dist")))


def decoding_order(positions: DataFrame, keys: list[str] = ["name"], mask: str = "design", noise: str = "noise", last: Column | None = None) -> DataFrame:  # noqa: B006
    """decode_rank: by (mask + 0.0001) * abs(noise), so that fixed positions come first; last: what sorts before that."""
    by = (F.col(mask) + 1e-4) * F.abs(noise)
    order = [by, F.col("pos")] if last is None else [last, by, F.col("pos")]
    return positions.withColumn("decode_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def tied_decoding_order(ranked: DataFrame) -> DataFrame:
    """tied_rank: a group (group_id; null: alone) is decoded at its earliest member, its members one after the other as the group lists them (member)."""
    group = F.coalesce(F.col("group_id").cast("string"), F.concat(F.lit("#"), F.col("pos").cast("string")))
    grouped = ranked.withColumn("_g", group).withColumn("_first", F.min("decode_rank").over(W.partitionBy("name", "_g")))
    return grouped.withColumn("tied_rank", F.row_number().over(W.partitionBy("name").orderBy("_first", "member"))).drop("_g", "_first")


def perturbed(atoms: DataFrame, eps: float, seed: int, keys: list[str]) -> DataFrame:
    """Coordinates plus normal noise of deviation eps, drawn by the keys: the same on every run and partitioning."""
    return atoms.withColumns({c: F.col(c) + eps * normal(F.lit(seed), F.lit(c), *map(F.col, keys)) for c in "xyz"}) if eps > 0 else atoms


def causal_edges(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """backward: 1 if dst is decoded before src; forward: 1 otherwise. ranks: name, id, decode_rank, mask."""
    of = lambda key, r, m: ranks.select("name", F.col("id").alias(key), F.col("decode_rank").alias(r), F.col("mask").alias(m))
    joined = edges.join(of("src", "_rs", "_ms"), ["name", "src"]).join(of("dst", "_rd", "_md"), ["name", "dst"])
    return causal(joined, F.col("_rs"), F.col("_rd"), F.col("_ms")).drop("_rs", "_rd", "_ms", "_md")


def causal(edges: DataFrame, of_src: Column, of_dst: Column, mask: Column) -> DataFrame:
    """causal_edges where an edge has both ends' ranks and the source's mask."""
    seen = (of_dst < of_src).cast("int")
    return edges.withColumn("backward", mask * seen).withColumn("forward", mask * (1 - seen))


def conditional_order(positions: DataFrame, backbone_only: bool = False, tile: int = 512) -> DataFrame:
    """For each designed position (target): all positions of its structure in decoding order, the target last, or first for backbone only.

    The others' order is the same for every target, so each structure is sorted once: a position after the target moves up a place, or for backbone only one before it
    moves down. A structure whose positions fall into one block is one row, where its targets meet them; in the others they meet tile by tile.
    """
    columns = [*positions.columns, "target", "decode_rank"]
    own, rank, at = F.col("pos") == F.col("target"), F.col("decode_rank"), F.col("_rank")
    place = F.when(own, 1).otherwise(rank + (rank < at).cast("int")) if backbone_only else F.when(own, F.col("_n")).otherwise(rank - (rank > at).cast("int"))
    ranked = decoding_order(positions).withColumnRenamed("pos", "id")
    blocks, rest = _blocks(ranked, "id", *[c for c in ranked.columns if c not in ("name", "id")])
    here = blocks.select("name", "pts", F.size("pts").alias("_n"), F.explode(F.filter("pts", lambda t: t["design"] == 1)).alias("_t"))
    few = here.select("name", "_n", F.col("_t.id").alias("target"), F.col("_t.decode_rank").alias("_rank"), F.explode("pts").alias("_p"))
    found = few.select("name", "_n", "target", "_rank", "_p.*").withColumnRenamed("id", "pos").withColumn("decode_rank", place.cast("int")).select(*columns)
    if rest is None:
        return found
    n = rest.groupBy("name").agg(F.count("*").alias("_n"), F.ceil(F.count("*") / tile).cast("int").alias("_tiles"))
    rows = cut(with_small(rest, n).withColumn("_tile", F.pmod(F.xxhash64("id"), F.col("_tiles")).cast("int")), "ranked")
    targets = copies(rows.filter("design = 1").drop("_tile").select("name", F.col("id").alias("target"), F.col("decode_rank").alias("_rank"), "_tiles"), "_tile", F.col("_tiles"))
    met = rows.withColumnRenamed("id", "pos").drop("_tiles").join(targets.drop("_tiles"), ["name", "_tile"])
    return found.unionByName(met.withColumn("decode_rank", place.cast("int")).select(*columns))
