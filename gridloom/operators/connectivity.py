"""Connectivity algebra over long tables (src, pos, dst) with signed dst, and sub-mesh extraction."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from gridloom.functions.geometry import ELEMENT_FACES
from gridloom.functions.predicates import same_cycle
from gridloom.functions.tables import materialise, numbered, spread_join
from gridloom.operators.ids import from_keys


def sign(column: str):
    """-1 for negative references, else 1."""
    return F.when(F.col(column) < 0, F.lit(-1)).otherwise(F.lit(1)).cast("long")


def transpose(conn: DataFrame) -> DataFrame:
    """B to A; the sign goes with the reference."""
    out = conn.select(F.abs("dst").alias("src"), (F.col("src") * sign("dst")).alias("dst"))
    return numbered(out.withColumn("_a", F.abs("dst")), ["_a", "dst"], "pos", ["src"]).drop("_a")


#: References that one list holds before it is cut by hash.
LIST = 1 << 16


#: Buckets in which rows are counted before keys are.
BUCKETS = 1 << 16


def crowded(pairs: DataFrame, key: str, most: int) -> DataFrame | None:
    """(key, _n) of the keys with more than `most` rows, None if there are none. Rows are counted in buckets of keys first, and
    the rows by their keys only in buckets that hold so many."""
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("_b")
    full = materialise(pairs.groupBy(bucket).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("_b"))
    if not full.limit(1).count():
        return None
    near = pairs.select(key, bucket).join(F.broadcast(full), "_b")  # BUCKETS rows at most
    found = materialise(near.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most))
    return found if found.limit(1).count() else None


def lists(pairs: DataFrame, key: str, of: str, out: str, most: int = LIST) -> DataFrame:
    """(key, out): each key's references in arrays of distinct values, several for a key that holds more than about `most`."""
    hot = crowded(pairs, key, most)
    if hot is None:
        # dealt as plain rows: sets begun before the shuffle would be longer than they
        return pairs.select(key, of).repartition(key).groupBy(key).agg(F.collect_set(of).alias(out))
    size = hot.select(key, F.ceil(F.col("_n") / most).cast("int").alias("_m"))
    cut = pairs.join(F.broadcast(size), key, "left").withColumn("_m", F.pmod(F.xxhash64(of), F.coalesce("_m", F.lit(1))))  # few: rows over `most`
    return cut.groupBy(key, "_m").agg(F.collect_set(of).alias(out)).drop("_m")


def packed_lists(found: DataFrame) -> DataFrame:
    """(b, n, cs) of (b, cs), cs an array of numbers of at least 0: how many there are, and their bytes as of `packed`."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                lists = batch.column(1).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pc.list_value_length(lists), packed(lists)], names=["b", "n", "cs"])

    return found.mapInArrow(run, f"b {found.schema['b'].dataType.simpleString()}, n int, cs binary")


def sorted_within(own: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of at least 0 in their order within each list, and whose each is; own is in order."""
    if len(v) and v.max() < 1 << 40 and own[-1] < 1 << 22:  # one number for both sorts several times faster
        both = np.sort(own << 40 | v)
        return both >> 40, both & (1 << 40) - 1
    order = np.lexsort((v, own))
    return own[order], v[order]


def packed(lists: pa.ListArray) -> pa.Array:
    """Each list of numbers as bytes: the numbers in their order, the first one and then the steps from one to the next, seven
    bits a byte, the eighth where more follow."""
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    own, v = np.repeat(np.arange(len(size)), size), pc.list_flatten(lists).to_numpy(zero_copy_only=False)
    v = sorted_within(own, v)[1]
    begin = np.cumsum(size) - size
    step = np.diff(v, prepend=0)
    step[begin[size > 0]] = v[begin[size > 0]]
    width = 1 + sum((step >> 7 * k > 0).astype(np.int64) for k in range(1, 9))
    end = np.concatenate([[0], np.cumsum(width)])
    out = np.zeros(end[-1], np.uint8)
    for k in range(int(width.max(initial=0))):
        on = np.flatnonzero(width > k)
        out[end[on] + k] = (step[on] >> 7 * k & 127) | np.where(width[on] > k + 1, 128, 0)
    offsets = end[np.concatenate([begin, [len(v)]])].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpacked(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many numbers each of some bytes as of `packed` hold, and the numbers."""
    data = data.cast(pa.large_binary())
    at = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    last = raw < 128
    upto = np.concatenate([[0], np.cumsum(last)])[at]
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]) if len(raw) else np.zeros(0, np.int64)
    long = np.diff(first, append=len(raw))
    step = (raw[first] & 127).astype(np.int64)
    for k in range(1, int(long.max(initial=0))):
        on = np.flatnonzero(long > k)
        step[on] |= (raw[first[on] + k] & 127).astype(np.int64) << 7 * k
    size = np.diff(upto)
    sums = np.concatenate([[0], np.cumsum(step)])
    return size, sums[1:] - np.repeat(sums[upto[:-1]], size)


#: Bytes of lists that are put together at a time.
AT_ONCE = 1 << 20


def unions(found: DataFrame) -> DataFrame:
    """(a, dsts) of (a, cs), cs an array of bytes as of `packed`: the distinct numbers in their order."""

    def union(cs: pa.ListArray) -> pa.Array:
        count = pc.list_value_length(cs).to_numpy(zero_copy_only=False).astype(np.int64)
        size, v = unpacked(pc.list_flatten(cs))
        own = np.repeat(np.repeat(np.arange(len(count)), count), size)
        own, v = sorted_within(own, v)
        new = np.ones(len(v), bool)
        new[1:] = (own[1:] != own[:-1]) | (v[1:] != v[:-1])
        own, v = own[new], v[new]
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(len(count) + 1)).astype(np.int32)), pa.array(v))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cs = batch.column(1)
                data = pc.list_flatten(cs).cast(pa.large_binary())
                at = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
                upto = at[np.cumsum(pc.list_value_length(cs).to_numpy(zero_copy_only=False))] - at[0]
                cuts = np.flatnonzero(np.diff(upto // AT_ONCE)) + 1  # a row is never cut
                for begin, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, stop - begin), union(cs.slice(begin, stop - begin))], names=["a", "dsts"])

    return found.mapInArrow(run, f"a {found.schema['a'].dataType.simpleString()}, dsts array<long>")


def combined_lists(ab: DataFrame, bc: DataFrame, most: int = LIST) -> DataFrame:
    """(src, dsts, whole): the distinct C of each A as arrays, in order; an A with more than about `most` of them, repeats
    included, has several arrays without a value in common, in no order, and whole is false.

    A shared B sends its C to each of its A, packed into bytes, and only there do they become rows. Pairs are dealt once by B;
    whether an A has too many is counted only for those that may, by how many B they have and the most C of any B."""
    kind = bc.schema["dst"].dataType
    b = ab.select(F.col("src").alias("a"), F.abs("dst").alias("b")).repartition("b").distinct()
    c = materialise(packed_lists(lists(bc.select(F.col("src").alias("b"), F.abs("dst").cast("long").alias("c")), "b", "c", "cs", most)))
    size = c.groupBy("b").agg(F.sum("n").alias("_n"))
    top = size.agg(F.max("_n")).first()[0] or 0
    met = spread_join(b, c.select("b", "cs"), ["b"])
    some = materialise(ab.groupBy(F.col("src").alias("a")).agg(F.count("*").alias("_n")).where(F.col("_n") * top > most).select("a"))
    wide = None
    if some.limit(1).count():
        wide = b.join(some, "a", "left_semi").join(size, "b").groupBy("a").agg(F.sum("_n").alias("_n")).where(F.col("_n") > most)
        wide = materialise(wide.select("a", F.ceil(F.col("_n") / most).cast("int").alias("_m")))
    held = met if wide is None else met.join(wide, "a", "left_anti")
    every = unions(held.select("a", "cs").repartition("a").groupBy("a").agg(F.collect_list("cs").alias("cs")))
    every = every.select(F.col("a").alias("src"), F.col("dsts").cast(ArrayType(kind)).alias("dsts"), F.lit(True).alias("whole"))
    if wide is None or not wide.limit(1).count():
        return every

    def opened(batches):
        for batch in batches:
            n, v = unpacked(batch.column(2))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(v))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["a", "_m", "cs"])

    many = met.join(wide, "a").select("a", "_m", "cs").mapInArrow(opened, f"a {ab.schema['src'].dataType.simpleString()}, _m int, cs array<long>")
    cut = F.transform(F.sequence(F.lit(0), F.col("_m") - 1), lambda k: F.filter("cs", lambda x: F.pmod(F.xxhash64(x), F.col("_m")) == k))
    each = many.select("a", "_m", F.posexplode(cut).alias("_k", "cs")).where("size(cs) > 0")
    rest = each.groupBy("a", "_m", "_k").agg(F.array_distinct(F.flatten(F.collect_list("cs"))).alias("dsts"))
    return every.unionByName(rest.select(F.col("a").alias("src"), F.col("dsts").cast(ArrayType(kind)).alias("dsts"), F.lit(False).alias("whole")))


def combine_pairs(ab: DataFrame, bc: DataFrame) -> DataFrame:
    """A to C, distinct and without signs or places; a shared B or an A with many neighbours is spread over tasks."""
    return combined_lists(ab, bc).select("src", F.explode("dsts").alias("dst"))


def combine(ab: DataFrame, bc: DataFrame, most: int = LIST) -> DataFrame:
    """A to C, distinct and without signs, in the order of C; only an A of several arrays takes a range sort for that."""
    found = combined_lists(ab, bc, most)
    place = lambda d: d.select("src", F.posexplode("dsts").alias("pos", "dst")).select("src", "dst", (F.col("pos") + 1).cast("long").alias("pos"))
    many = found.where(~F.col("whole"))
    if not many.limit(1).count():
        return place(found.where("whole"))
    return place(found.where("whole")).unionByName(numbered(many.select("src", F.explode("dsts").alias("dst")), ["dst"], "pos", ["src"]))


def dual(conn: DataFrame, keep_self: bool = False) -> DataFrame:
    """A to A over shared B."""
    out = combine_pairs(conn, conn.select(F.abs("dst").alias("src"), F.col("src").alias("dst")))
    return out if keep_self else out.where("src <> dst")


def compress(conn: DataFrame) -> DataFrame:
    """Each src's distinct references, in the order of their first position."""
    first = conn.groupBy("src", "dst").agg(F.min("pos").alias("pos"))
    return numbered(first.withColumnRenamed("pos", "_first"), ["_first", "dst"], "pos", ["src"]).drop("_first")


def pairs_to_rows(pairs: DataFrame) -> DataFrame:
    """(src, first, second) as rows; the second reference has a minus sign, absent ones (0) go."""
    both = F.posexplode(F.array(F.col("first"), -F.col("second")))
    return pairs.select("src", both.alias("pos", "dst")).where("dst <> 0")


def face_vertices(face_edge: DataFrame, edge_vtx: DataFrame) -> DataFrame:
    """Ordered vertices of each face from its signed edges: an edge starts at its first vertex, or at its second one
    if the sign is negative."""
    ends = edge_vtx.groupBy("src").agg(F.min_by("dst", "pos").alias("v1"), F.max_by("dst", "pos").alias("v2"))
    out = face_edge.withColumn("_e", F.abs("dst")).join(ends.withColumnRenamed("src", "_e"), "_e")
    return out.select("src", "pos", F.when(F.col("dst") > 0, F.col("v1")).otherwise(F.col("v2")).alias("dst"))


def group_transpose(groups: DataFrame) -> DataFrame:
    """(kind, group, gnum) as (gnum, pos, kind, group): the groups of each entity."""
    return groups.select("gnum", "kind", "group").distinct().withColumn("pos", F.row_number().over(Window.partitionBy("gnum").orderBy("kind", "group")))


def ridges(edge_face: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges with one grouped face, or with faces of two or more groups; and the id of the sorted set of groups."""
    g = edge_face.withColumn("gnum", F.abs("dst")).join(groups.select("gnum", "group"), "gnum")
    sets = g.groupBy("src").agg(F.array_sort(F.collect_set("group")).alias("groups"), F.count("*").alias("n"))
    kept = sets.where("n = 1 OR size(groups) > 1")
    return from_keys(kept, ["groups"], "ridge").select(F.col("src").alias("edge"), "groups", "ridge")


def extract(conn: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of the chosen src (gnum), with both sides numbered anew: connectivity, src map and dst map (gnum, new)."""
    part = conn.join(chosen.select(F.col("gnum").alias("src")).distinct(), "src", "left_semi")
    src = numbered(part.select(F.col("src").alias("gnum")).distinct(), ["gnum"], "new")
    dst = numbered(part.select(F.abs("dst").alias("gnum")).distinct(), ["gnum"], "new")
    out = part.join(src.select(F.col("gnum").alias("src"), F.col("new").alias("_s")), "src").withColumn("_a", F.abs("dst"))
    out = out.join(dst.select(F.col("gnum").alias("_a"), F.col("new").alias("_d")), "_a")
    return out.select(F.col("_s").alias("src"), "pos", (F.col("_d") * sign("dst")).alias("dst")), src, dst


def extract_mesh(chosen: DataFrame, cell_face: DataFrame, face_vtx: DataFrame) -> dict[str, DataFrame]:
    """The sub-mesh of the chosen cells (gnum), level by level: cell_face and face_vtx with all sides numbered anew, and
    the maps cells, faces and vertices (gnum, new) of what is in it. Places and signs stay."""
    faces, cells, face = extract(cell_face, chosen)
    ring, again, vertices = extract(face_vtx, face)
    of_faces = again.join(face.withColumnRenamed("new", "by_cells"), "gnum")  # one numbering of the faces for both levels
    ring = ring.join(of_faces.select(F.col("new").alias("src"), "by_cells"), "src").select(F.col("by_cells").alias("src"), "pos", "dst")
    return {"cell_face": faces, "face_vtx": ring, "cells": cells, "faces": face, "vertices": vertices}


def groups_of(groups: DataFrame, numbers: DataFrame) -> DataFrame:
    """Groups (kind, group, gnum) of what an extraction kept, under its new numbers."""
    return groups.join(numbers, "gnum").select("kind", "group", F.col("new").alias("gnum"))


def repaired(vertices: DataFrame, face_vtx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices that some face cites, densely renumbered, and the faces over them."""
    used = vertices.join(face_vtx.select(F.abs("dst").alias("gnum")).distinct(), "gnum", "left_semi")
    named = from_keys(used, ["gnum"], "new")
    ring = face_vtx.withColumn("_a", F.abs("dst")).join(named.select(F.col("gnum").alias("_a"), "new"), "_a")
    return named.drop("gnum").withColumnRenamed("new", "gnum").select(*vertices.columns), ring.select("src", "pos", (F.col("new") * sign("dst")).alias("dst"))


def typed_sections(cell_face: DataFrame, face_vtx: DataFrame) -> DataFrame:
    """(gnum, elt_type, vtx) of cells given by faces: tetra, pyramid, prism and hexa by their faces' sizes, with vertices
    in the order of ELEMENT_FACES (a base seen from inside, then the vertex across each of its edges); other cells are
    polyhedra, with their sorted vertices.

    face_vtx: (src, pos, dst), pos in order; cell_face: a positive dst walks its face so that the normal points out.
    """
    ring = face_vtx.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda s: s["dst"]).alias("ring"))
    every = cell_face.select("src", F.abs("dst").alias("face"), (F.col("dst") > 0).alias("out")).join(ring.withColumnRenamed("src", "face"), "face")
    every = every.select("src", "face", F.when(F.col("out"), F.reverse("ring")).otherwise(F.col("ring")).alias("ring"))  # seen from inside
    cells = every.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("face", "ring"))).alias("faces"), F.array_sort(F.collect_list(F.size("ring"))).alias("sizes"))
    n = lambda *sizes: F.col("sizes") == F.array(*[F.lit(s) for s in sizes])
    kind = F.when(n(3, 3, 3, 3), "tetra").when(n(3, 3, 3, 3, 4), "pyramid").when(n(3, 3, 4, 4, 4), "prism").when(n(4, 4, 4, 4, 4, 4), "hexa").otherwise("poly")
    rings = F.transform("faces", lambda f: f["ring"])
    size = F.when(kind.isin("tetra", "prism"), 3).otherwise(4)
    cells = cells.select("src", kind.alias("elt_type"), rings.alias("rings"), size.alias("size"))
    base = F.get(F.filter("rings", lambda r: F.size(r) == F.col("size")), F.lit(0))
    cells = cells.withColumn("base", base)
    # the vertex across a base vertex: its neighbour in a side face that isn't in the base
    def across(v):
        sides = F.filter("rings", lambda r: F.array_contains(r, v) & (F.size(F.array_except(r, "base")) > 0))
        near = lambda r: F.filter(F.array(at(r, v, 1), at(r, v, -1)), lambda w: ~F.array_contains("base", w))
        return F.get(F.flatten(F.transform(sides, near)), F.lit(0))

    top = F.transform("base", across)
    apex = F.array_distinct(top)
    vtx = F.when(F.col("elt_type") == "poly", F.array_sort(F.array_distinct(F.flatten("rings")))).when(F.col("elt_type").isin("tetra", "pyramid"), F.concat("base", apex)).otherwise(F.concat("base", top))
    return cells.select(F.col("src").alias("gnum"), "elt_type", vtx.alias("vtx"))


def at(ring, v, step: int):
    """The vertex `step` places after v in a ring."""
    return F.get(ring, F.pmod(F.array_position(ring, v).cast("int") - 1 + step, F.size(ring)))


def children_of(parents: DataFrame, children: DataFrame) -> DataFrame:
    """(child, parent, way): entities (gnum, vtx) with the same vertices; way is 1 if both walk them alike, else -1."""
    key = lambda d: d.withColumn("key", F.array_sort("vtx"))
    met = key(children).select(F.col("gnum").alias("child"), F.col("vtx").alias("cv"), "key").join(key(parents).select(F.col("gnum").alias("parent"), F.col("vtx").alias("pv"), "key"), "key")
    return met.select("child", "parent", same_cycle(F.col("cv"), F.col("pv")).alias("way"))


def unconnected(vertices: DataFrame, face_vtx: DataFrame) -> DataFrame:
    """Vertices that no face cites."""
    return vertices.join(face_vtx.select(F.abs("dst").alias("gnum")), "gnum", "left_anti")


def descend(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements (gnum, elt_type, vtx) to faces: (face, vtx) and signed (src element, pos, dst face).

    Faces with the same vertex set are one; the first element that names it, by (gnum, pos), gives its orientation, and
    the others get a minus sign if they walk it the other way."""
    tables = {t: F.array(*[F.array(*[F.get(F.col("vtx"), F.lit(i)) for i in f]) for f in faces]) for t, faces in ELEMENT_FACES.items()}
    faces = None
    for t, x in tables.items():
        faces = F.when(F.col("elt_type") == t, x) if faces is None else faces.when(F.col("elt_type") == t, x)
    every = elements.select(F.col("gnum").alias("src"), F.posexplode(faces).alias("pos", "walk"))
    every = every.withColumn("key", F.array_sort("walk"))
    one = every.groupBy("key").agg(F.min(F.struct("src", "pos", "walk")).alias("first"))
    ids = from_keys(one, ["key"], "face")
    low = F.array_min("walk")
    at = F.array_position("walk", low).cast("int")
    turned = F.concat(F.slice("walk", at, F.size("walk")), F.slice("walk", F.lit(1), at - 1))
    own = F.expr("first.walk")
    own_at = F.array_position(own, F.array_min(own)).cast("int")
    own_turned = F.concat(F.slice(own, own_at, F.size(own)), F.slice(own, F.lit(1), own_at - 1))
    signed = every.join(ids, "key").select("src", "pos", F.when(turned == own_turned, F.col("face")).otherwise(-F.col("face")).alias("dst"))
    return ids.select("face", F.col("first.walk").alias("vtx")), signed


def concatenate(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of frames of several domains, ids shifted by the largest id before."""
    out, shift = None, 0
    for f in frames:
        moved = f.withColumn("gnum", F.col("gnum") + shift)
        shift += f.agg(F.max("gnum")).first()[0] or 0
        out = moved if out is None else out.unionByName(moved)
    return out
