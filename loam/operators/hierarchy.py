"""Parent-child links to full hierarchies: leaf peeling, Euler tours and parallel list ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.session import Scratch, small_join, table

#: Rows that one task may take whole: the residue of peeling, and the contracted list that is ranked last. About a megabyte.
LOCAL_ROWS = 16_384
#: One list element in so many stays when a list is contracted.
CONTRACT = 8
#: Children of one parent that one sort takes, about, if that parent holds a third of all nodes.
SIBLINGS = 400_000
#: Places of a tree's tour that one task replays in order, and pieces of that size whose open folders one task puts together.
CHUNK, PIECES = 100_000, 1_000

BROKEN, CYCLE, ROOTED = 0, 1, 2


def latest_entries(entries: DataFrame) -> DataFrame:
    """The row with the highest usn of each (volume, frn); ties go to the greatest parent and name. Rows without frn are dropped."""
    top = F.max(F.struct(F.coalesce("usn", F.lit(-(2**63) + 1)).alias("usn"), "parent_frn", "name")).alias("_top")
    return entries.where(F.col("frn").isNotNull()).groupBy("volume", "frn").agg(top).select("volume", "frn", "_top.parent_frn", "_top.name")


def peel(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Ids of the nodes that lie on cycles, from (id, pid): leaves are peeled until only cycles are left.

    A round drops every node that is nobody's parent. While a round drops half of what is left, rounds grow with the logarithm of the nodes
    only. Where one drops less, as on long chains, every node that is left jumps to its ancestor at twice the distance instead: past the
    number of nodes, jumps have left the chains and end on cycles, and each cycle's node is reached. What is left is peeled in one
    task once it is at most LOCAL_ROWS.
    """
    left = links.where(F.col("pid").isNotNull()).select("id", "pid")
    count = left.count()
    while count > LOCAL_ROWS:
        parents = left.select(F.col("pid").alias("id")).distinct()
        smaller = scratch.keep(left.join(parents, "id", "left_semi"))
        scratch.drop(left)
        before, left, count = count, smaller, smaller.count()
        if count > LOCAL_ROWS and 2 * count > before:
            return on_cycles(left, count, scratch)

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(batches) or [pd.DataFrame({"id": [], "pid": []}, dtype="int64")])
        ids, pids = whole["id"].to_numpy("int64"), whole["pid"].to_numpy("int64")
        if not len(ids):
            return
        order = np.argsort(ids)
        ids, pids = ids[order], pids[order]
        at = np.minimum(np.searchsorted(ids, pids), len(ids) - 1)
        at = np.where(ids[at] == pids, at, -1)
        kids = np.bincount(at[at >= 0], minlength=len(ids))
        gone, leaves = np.zeros(len(ids), bool), np.flatnonzero(kids == 0)
        while len(leaves):
            gone[leaves] = True
            up = at[leaves]
            up = up[up >= 0]
            np.subtract.at(kids, up, 1)
            up = np.unique(up)
            leaves = up[(kids[up] == 0) & ~gone[up]]
        yield pd.DataFrame({"id": ids[~gone]})

    return left.coalesce(1).mapInPandas(rest, "id long")


def on_cycles(left: DataFrame, count: int, scratch: Scratch) -> DataFrame:
    """Ids of the nodes on cycles by doubled jumps, as many rounds as the number of nodes has binary digits."""
    jumps, reach = left, 1
    while reach < count:
        to = jumps.select(F.col("id").alias("pid"), F.col("pid").alias("_to"))
        further = scratch.keep(jumps.join(to, "pid").select("id", F.col("_to").alias("pid")))
        if jumps is not left:
            scratch.drop(jumps)
        jumps, reach = further, reach * 2
    return jumps.select(F.col("pid").alias("id")).distinct()


def siblings(inner: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """From (id, pid) of nodes below others: (id, pid, sib) with the next sibling, and (id, kid) with each parent's first child.

    The order among siblings is free, so children are dealt to buckets by a hash of their id, linked in each bucket and then bucket
    to bucket: a folder with a third of all nodes is no single sort.
    """
    buckets = 1 + total // (3 * SIBLINGS)
    dealt = inner.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    w = W.partitionBy("pid", "b").orderBy("id")
    linked = dealt.withColumn("sib", F.lead("id").over(w)).withColumn("n", F.row_number().over(w))
    if buckets == 1:
        return linked.select("id", "pid", "sib"), linked.where("n = 1").select(F.col("pid").alias("id"), F.col("id").alias("kid"))
    ends = linked.groupBy("pid", "b").agg(F.max(F.when(F.col("n") == 1, F.col("id"))).alias("first"), F.max(F.when(F.col("sib").isNull(), F.col("id"))).alias("last"))
    v = W.partitionBy("pid").orderBy("b")
    chain = ends.withColumn("onward", F.lead("first").over(v)).withColumn("n", F.row_number().over(v))
    joined = linked.join(chain.select(F.col("last").alias("id"), "onward"), "id", "left")
    return (
        joined.select("id", "pid", F.coalesce("sib", "onward").alias("sib")),
        chain.where("n = 1").select(F.col("pid").alias("id"), F.col("first").alias("kid")),
    )


def is_ruler(element: Column, level: int) -> Column:
    return F.pmod(F.xxhash64(element, F.lit(level)), F.lit(CONTRACT)) == 0


def rank(elements: DataFrame, scratch: Scratch, level: int = 0) -> DataFrame:
    """Ranks linked lists: (e, d, last, kind, root), d the summed weight from e to its list's end, from (e, ptr, d, last, kind, root).

    ``ptr`` is the next element or null at an end, where last, kind and root are set; d is the element's weight at first. One
    element in CONTRACT, drawn by a hash of its id, is a ruler. All elements jump along the list, each round twice as far, until
    they point at a ruler or the end; the rulers are then a list of their own, ranked the same way, and at most LOCAL_ROWS of them
    in one task. Rounds grow with the logarithm of the distance between rulers only.
    """
    if elements.count() <= LOCAL_ROWS:
        whole = elements.select("e", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("ptr", "d", "last", "kind", "root")])  # no nulls: pandas would turn them to floats
        return scratch.keep(whole.coalesce(1).mapInPandas(rank_local, "e long, d long, last long, kind int, root long"))
    now = elements
    while True:
        waits = F.col("ptr").isNotNull() & ~is_ruler(F.col("ptr"), level)
        active = now.where(waits)
        if active.isEmpty():
            break
        target = now.select(F.col("e").alias("ptr"), F.col("ptr").alias("p2"), F.col("d").alias("d2"), F.col("last").alias("l2"), F.col("kind").alias("k2"), F.col("root").alias("r2"))
        moved = active.select("e", "ptr", "d").join(target, "ptr").select("e", F.col("p2").alias("ptr"), (F.col("d") + F.col("d2")).alias("d"), F.col("l2").alias("last"), F.col("k2").alias("kind"), F.col("r2").alias("root"))
        after = scratch.keep(now.where(~waits).select(*moved.columns).union(moved))
        scratch.drop(now)
        now = after
    rulers = scratch.keep(now.where(is_ruler(F.col("e"), level)))
    ranked = rank(rulers, scratch, level + 1).select(F.col("e").alias("ptr"), F.col("d").alias("d2"), F.col("last").alias("l2"), F.col("kind").alias("k2"), F.col("root").alias("r2"))
    at_end = now.where(F.col("ptr").isNull()).select("e", "d", "last", "kind", "root")
    onward = now.where(F.col("ptr").isNotNull()).select("e", "ptr", "d").join(ranked, "ptr").select("e", (F.col("d") + F.col("d2")).alias("d"), F.col("l2").alias("last"), F.col("k2").alias("kind"), F.col("r2").alias("root"))
    out = scratch.keep(at_end.union(onward))
    scratch.drop(now)
    return out


def rank_local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pointer jumping over one bounded set of lists in arrays."""
    whole = pd.concat(list(batches) or [pd.DataFrame({c: [] for c in ("e", "ptr", "d", "last", "kind", "root")})])
    if not len(whole):
        return
    whole = whole.sort_values("e", ignore_index=True)
    e, d = whole["e"].to_numpy("int64"), whole["d"].to_numpy("int64").copy()
    ptr = whole["ptr"].to_numpy("int64")
    end = ptr < 0
    at = np.where(end, np.arange(len(e)), np.searchsorted(e, ptr))
    d_end = np.where(end, d, 0)
    d = np.where(end, 0, d)  # an end jumps to itself at no cost; its own weight is added when all have arrived
    while True:
        to = at[at]
        if (to == at).all():
            break
        d, at = d + d[at], to
    take = whole.iloc[at]
    yield pd.DataFrame({"e": e, "d": d + d_end[at], "last": take["last"].to_numpy("int64"), "kind": take["kind"].to_numpy("int32"), "root": take["root"].to_numpy("int64")})


def tours(entries: DataFrame, roots: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nodes (id, volume, frn, name), the leaves (id, pid, kind, root) and the ranked tour elements of all other nodes (e, d, last, kind, root).

    The first round of peeling takes the leaves. A leaf's place in the tour follows from its parent's, so it is no element of its own: the
    list holds inner nodes only, e is 2*id on entry and 2*id+1 on exit, and an entry weighs 1 and 2 more for each leaf below it. ``d`` is
    the weight from an element to the tour's end and falls along the tour; ``last`` names the tree, ``kind`` says how its top ends and
    ``root`` is the root's frn or -1. A leaf without a parent has kind and root itself.
    """
    nodes = scratch.keep(latest_entries(entries).withColumn("id", F.monotonically_increasing_id()))
    total = nodes.count()
    parents = nodes.select("volume", F.col("frn").alias("parent_frn"), F.col("id").alias("pid"))
    tops = roots.where(F.col("frn").isNotNull()).select("volume", F.col("frn").alias("parent_frn"), F.lit(1).alias("top")).distinct()
    joined = small_join(nodes.select("id", "volume", "parent_frn"), tops, ["volume", "parent_frn"]).join(parents, ["volume", "parent_frn"], "left")
    links = scratch.keep(
        joined.select(
            "id",
            F.when(F.col("top").isNull(), F.col("pid")).alias("pid"),
            F.when(F.col("top").isNotNull(), F.lit(ROOTED)).when(F.col("pid").isNull(), F.lit(BROKEN)).cast("int").alias("kind"),
            F.when(F.col("top").isNotNull(), F.col("parent_frn")).otherwise(F.lit(-1)).alias("root"),
        )
    )
    kids = scratch.keep(links.where(F.col("pid").isNotNull()).groupBy(F.col("pid").alias("id")).agg(F.count(F.lit(1)).alias("kids")))
    marked = scratch.keep(links.join(kids, "id", "left"))
    leaves, inner = marked.where(F.col("kids").isNull()).drop("kids"), marked.where(F.col("kids").isNotNull())
    loops = scratch.keep(peel(inner, scratch)).withColumn("loop", F.lit(True))
    cut = inner.join(loops, "id", "left").select(
        "id", F.when(F.col("loop").isNull(), F.col("pid")).alias("pid"), F.coalesce("kind", F.when(F.col("loop"), F.lit(CYCLE))).alias("kind"), "root", "kids", F.col("pid").alias("own"),
    )
    linked, first = siblings(cut.where(F.col("pid").isNotNull()).select("id", "pid"), total)
    # of a node's children those that are inner and not cut off stand in the list; the rest of its count are leaves
    listed = cut.where(F.col("own").isNotNull()).groupBy(F.col("own").alias("id")).agg(F.count(F.lit(1)).alias("listed"))
    whole = scratch.keep(
        cut.select("id", "pid", "kind", "root", "kids").join(linked.select("id", "sib"), "id", "left").join(first, "id", "left").join(listed, "id", "left")
        .withColumn("leaves", F.col("kids") - F.coalesce("listed", F.lit(0)))
    )
    ends = F.col("pid").isNull()
    leave_at = F.col("id") * 2 + 1
    enter = F.struct((F.col("id") * 2).alias("e"), F.coalesce(F.col("kid") * 2, leave_at).alias("ptr"), (2 * F.col("leaves") + 1).alias("d"), F.lit(None).cast("long").alias("last"), F.lit(None).cast("int").alias("kind"), F.lit(None).cast("long").alias("root"))
    onward = F.when(F.col("sib").isNotNull(), F.col("sib") * 2).otherwise(F.col("pid") * 2 + 1)
    leave = F.struct(leave_at.alias("e"), onward.alias("ptr"), F.lit(1).cast("long").alias("d"), F.when(ends, F.col("id")).alias("last"), F.when(ends, F.col("kind")).alias("kind"), F.when(ends, F.col("root")).alias("root"))
    elements = scratch.keep(whole.select(F.explode(F.array(enter, leave)).alias("x")).select("x.*"))
    return nodes, leaves, rank(elements, scratch)


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[int, int], tuple]]:
    for b in batches:
        for row in b.itertuples(index=False):
            yield (row.last, row.chunk), row


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each piece of a tour: how many open folders it closes, and the names it leaves open."""
    key, pops, names, out = None, 0, [], []
    for k, row in _runs(batches):
        if k != key:
            if key:
                out.append((*key, pops, names))
            key, pops, names = k, 0, []
        if row.step == 0:
            names.append(row.name or "")
        elif row.step == 1:
            if names:
                names.pop()
            else:
                pops += 1
    if key:
        out.append((*key, pops, names))
    yield pd.DataFrame(out, columns=["last", "chunk", "pops", "names"])


def _together(pieces: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring pieces of one tree as one piece."""
    pops, names = 0, []
    for row in pieces.sort_values("chunk", ascending=False).itertuples(index=False):
        pops += max(0, row.pops - len(names))
        names = names[: max(0, len(names) - row.pops)] + list(row.names)
    return pd.DataFrame([(pieces["last"].iloc[0], int(pieces["over"].iloc[0]), pops, names)], columns=["last", "chunk", "pops", "names"])


def _stacks(pieces: pd.DataFrame) -> pd.DataFrame:
    """The names open at the start of each of some neighbouring pieces of one tree, in tour order (chunks fall); ``open`` is what is open before them."""
    before = pieces["open"].iloc[0]
    out, stack = [], list(before) if before is not None else []
    for row in pieces.sort_values("chunk", ascending=False).itertuples(index=False):
        out.append((row.last, row.chunk, list(stack)))
        stack = stack[: len(stack) - row.pops] + list(row.names)
    return pd.DataFrame(out, columns=["last", "chunk", "open"])


def opened(pieces: DataFrame, scratch: Scratch) -> DataFrame:
    """(last, chunk, open): the names open at the start of each piece. Pieces are put together PIECES at a time, level by level, so that no task
    takes all of a tree's."""
    over = pieces.withColumn("over", F.floor(F.col("chunk") / PIECES))
    if (pieces.agg(F.max("chunk")).first()[0] or 0) < PIECES:
        seeded = over.withColumn("open", F.lit(None).cast("array<string>"))
    else:
        above = scratch.keep(over.groupBy("last", "over").applyInPandas(_together, "last long, chunk long, pops long, names array<string>"))
        seeded = over.join(opened(above, scratch).select("last", F.col("chunk").alias("over"), "open"), ["last", "over"])
    return seeded.groupBy("last", "over").applyInPandas(_stacks, "last long, chunk long, open array<string>")


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walks each piece of a tour with the stack of open folders and gives each entered node its depth and path."""
    key, stack = None, []
    for b in batches:
        out = []
        for row in b.itertuples(index=False):
            k = (row.last, row.chunk)
            if k != key:
                key, stack = k, [row.root_path or ""]
                for name in row.open if row.open is not None else ():
                    stack.append(f"{stack[-1]}\\{name or ''}")
            if row.step == 1:
                stack.pop()
            elif row.step == 0:
                path = f"{stack[-1]}\\{row.name or ''}"
                out.append((row.id, row.root, len(stack), path))
                stack.append(path)
        yield pd.DataFrame(out, columns=["id", "root_frn", "node_depth", "full_path"])


def hierarchy(entries: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """(volume, frn, outcome, root_frn, node_depth, full_path) of every entry.

    ``rooted``: the chain of parents within the volume reaches a root. ``cycle``: it runs into a loop (a node that is its own parent is
    one). ``broken``: it ends elsewhere, at a null or unknown parent. The latter two have -1, -1 and the empty string. A null name
    counts as empty; a root that is listed twice takes its greatest path. Empty tables give an empty result. Inner nodes get their paths
    from the tour, leaves theirs from their parents.
    """
    nodes, leaves, ranked = tours(entries, roots, scratch)
    paths = roots.where(F.col("frn").isNotNull()).groupBy("volume", F.col("frn").alias("root")).agg(F.max("root_path").alias("root_path"))
    good = ranked.where(F.col("kind") == ROOTED).select("d", "last", "root", F.shiftright("e", 1).alias("id"), (F.col("e") % 2).cast("int").alias("step"), F.floor(F.col("d") / CHUNK).alias("chunk"))
    tour = scratch.keep(good.join(nodes.select("id", "volume", "name"), "id"))
    order = ["last", F.desc("chunk"), F.desc("d")]
    long = tour.groupBy("last").agg(F.max("chunk").alias("c")).where("c > 0").select("last")
    pieces = tour.join(long, "last", "left_semi").select("last", "chunk", "d", "step", "name").repartition("last", "chunk").sortWithinPartitions(*order)
    seeds = opened(scratch.keep(pieces.mapInPandas(_summaries, "last long, chunk long, pops long, names array<string>")), scratch)
    firsts = tour.groupBy("last", "chunk").agg(F.max("root").alias("root"), F.max("volume").alias("volume")).join(seeds, ["last", "chunk"])
    rows = tour.withColumn("open", F.lit(None).cast("array<string>"))
    seed_rows = firsts.select("last", "chunk", F.lit(2**62).alias("d"), "volume", F.lit(-1).cast("long").alias("id"), F.lit(None).cast("string").alias("name"), "root", F.lit(3).alias("step"), "open")
    walk = small_join(rows.unionByName(seed_rows, allowMissingColumns=True), paths, ["volume", "root"])
    walk = walk.select("last", "chunk", "d", "step", "id", "root", "name", "root_path", "open").repartition("last", "chunk").sortWithinPartitions(*order)
    found = walk.mapInPandas(_replay, "id long, root_frn long, node_depth long, full_path string").withColumn("kind", F.lit(ROOTED))
    lost = ranked.where((F.col("kind") != ROOTED) & (F.col("e") % 2 == 0)).select(F.shiftright("e", 1).alias("id"), F.lit(-1).cast("long").alias("root_frn"), F.lit(-1).cast("long").alias("node_depth"), F.lit("").alias("full_path"), "kind")
    inner = scratch.keep(found.unionByName(lost))
    named = nodes.select("id", "volume", "frn", F.coalesce("name", F.lit("")).alias("name"))
    below = leaves.where(F.col("pid").isNotNull()).select("id", "pid").join(named, "id")
    below = small_join(below, inner.withColumnRenamed("id", "pid"), ["pid"], "inner")
    rooted = F.col("kind") == ROOTED
    below = below.select("volume", "frn", "kind", "root_frn", F.when(rooted, F.col("node_depth") + 1).otherwise(F.lit(-1)).alias("node_depth"), F.when(rooted, F.concat_ws("\\", "full_path", "name")).otherwise(F.lit("")).alias("full_path"))
    alone = small_join(leaves.where(F.col("pid").isNull()).select("id", "kind", "root").join(named, "id"), paths, ["volume", "root"])
    alone = alone.select("volume", "frn", "kind", F.when(rooted, F.col("root")).otherwise(F.lit(-1)).alias("root_frn"), F.when(rooted, 1).otherwise(-1).cast("long").alias("node_depth"), F.when(rooted, F.concat_ws("\\", F.coalesce("root_path", F.lit("")), "name")).otherwise(F.lit("")).alias("full_path"))
    outcome = F.when(rooted, "rooted").when(F.col("kind") == CYCLE, "cycle").otherwise("broken")
    whole = inner.join(named, "id").select(*alone.columns).unionByName(below).unionByName(alone)
    return whole.select("volume", "frn", outcome.alias("outcome"), "root_frn", "node_depth", "full_path")


def intervals(entries: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """(volume, frn, tree, entry, exit, descendants, loop): a node lies below another iff its interval lies within the other's in one tree.

    ``tree`` is the id of the top node. Nodes on a cycle (``loop``) each top a tree of their own, made of what hangs from them off the cycle.
    A parent's leaves stand one after the other right behind its entry.
    """
    nodes, leaves, ranked = tours(entries, roots, scratch)
    both = ranked.groupBy(F.shiftright("e", 1).alias("id")).agg(F.max("d").alias("a"), F.min("d").alias("z"), F.max("last").alias("tree"), F.max("kind").alias("kind"))
    inner = scratch.keep(both)
    # leaves are numbered in buckets of their parent, and the buckets behind each other, so a folder with a third of all nodes is no single sort
    total = leaves.count()
    buckets = 1 + total // (3 * SIBLINGS)
    dealt = leaves.where(F.col("pid").isNotNull()).select("id", "pid").withColumn("b", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    sizes = dealt.groupBy("pid", "b").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("pid", "b", F.coalesce(F.sum("n").over(W.partitionBy("pid").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = dealt.withColumn("j", F.row_number().over(W.partitionBy("pid", "b").orderBy("id"))).join(offsets, ["pid", "b"]).select("id", "pid", (F.col("before") + F.col("j") - 1).alias("j"))
    under = small_join(placed, inner.select(F.col("id").alias("pid"), F.col("a").alias("top"), "tree", "kind"), ["pid"], "inner")
    below = under.select("id", (F.col("top") - 1 - 2 * F.col("j")).alias("a"), (F.col("top") - 2 - 2 * F.col("j")).alias("z"), "tree", "kind")
    alone = leaves.where(F.col("pid").isNull()).select("id", F.lit(2).cast("long").alias("a"), F.lit(1).cast("long").alias("z"), F.col("id").alias("tree"), "kind")
    whole = inner.unionByName(below).unionByName(alone).join(nodes, "id")
    return whole.select("volume", "frn", "tree", (-F.col("a")).alias("entry"), (-F.col("z")).alias("exit"), F.floor((F.col("a") - F.col("z")) / 2).cast("long").alias("descendants"), ((F.col("kind") == CYCLE) & (F.col("tree") == F.col("id"))).alias("loop"))


def descendants(spans: DataFrame, of: DataFrame) -> DataFrame:
    """All (volume, ancestor, frn) pairs for the ancestors named in ``of`` (volume, frn): a stated query set against all rows."""
    tops = spans.join(of.select("volume", "frn").distinct(), ["volume", "frn"]).select("tree", F.col("frn").alias("ancestor"), F.col("entry").alias("lo"), F.col("exit").alias("hi"))
    return spans.join(tops, "tree").where((F.col("entry") > F.col("lo")) & (F.col("exit") < F.col("hi"))).select("volume", "ancestor", "frn")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry with the outcome of its chain."""
    entries = table(spark, sf_dir, "frn_entries").select("volume", "frn", "parent_frn", "name", "usn")
    return hierarchy(entries, table(spark, sf_dir, "frn_roots"), Scratch(spark, "tree"))


def p7_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(volume, frn, descendants) of every entry that isn't on a cycle: how many nodes lie below it."""
    entries = table(spark, sf_dir, "frn_entries").select("volume", "frn", "parent_frn", "name", "usn")
    return intervals(entries, table(spark, sf_dir, "frn_roots"), Scratch(spark, "spans")).where(~F.col("loop")).select("volume", "frn", "descendants")


def p7_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(volume, frn, tree, entry, exit, descendants, loop) of every entry; those on a cycle are marked by ``loop``, see ``intervals``."""
    entries = table(spark, sf_dir, "frn_entries").select("volume", "frn", "parent_frn", "name", "usn")
    return intervals(entries, table(spark, sf_dir, "frn_roots"), Scratch(spark, "spans"))


def p7_descendant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(volume, ancestor, frn, loop): all that lies below each entry whose frn is divisible by 100; ``loop`` marks ancestors on a cycle.

    Below an entry on a cycle lies what hangs from it off the cycle, as in its interval; the cycle's other entries are no descendants here.
    """
    scratch = Scratch(spark, "spans")
    entries = table(spark, sf_dir, "frn_entries").select("volume", "frn", "parent_frn", "name", "usn")
    spans = scratch.keep(intervals(entries, table(spark, sf_dir, "frn_roots"), scratch))
    of = spans.where("frn % 100 = 0").select("volume", "frn", "loop")
    return descendants(spans, of).join(of.withColumnRenamed("frn", "ancestor"), ["volume", "ancestor"])


_TREE_SQL = r"""
WITH RECURSIVE e AS (
  SELECT volume, frn, parent_frn, name FROM frn_entries WHERE frn IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY volume, frn ORDER BY usn DESC NULLS LAST, parent_frn DESC NULLS LAST, name DESC NULLS LAST) = 1
), down AS (
  SELECT e.volume, e.frn, r.frn AS root_frn, CAST(1 AS BIGINT) AS node_depth, r.root_path || '\' || coalesce(e.name, '') AS full_path
  FROM e JOIN frn_roots r ON r.volume = e.volume AND r.frn = e.parent_frn
  UNION ALL
  SELECT e.volume, e.frn, d.root_frn, d.node_depth + 1, d.full_path || '\' || coalesce(e.name, '')
  FROM down d JOIN e ON e.volume = d.volume AND e.parent_frn = d.frn
), walk AS (
  SELECT volume, frn AS start, parent_frn AS at FROM e
  UNION
  SELECT w.volume, w.start, e.parent_frn FROM walk w JOIN e ON e.volume = w.volume AND e.frn = w.at
)"""
P7_SQL = _TREE_SQL + r"""
SELECT volume, frn, 'rooted' AS outcome, root_frn, node_depth, full_path FROM down
UNION ALL
SELECT e.volume, e.frn, CASE WHEN EXISTS (
  SELECT 1 FROM walk w WHERE w.volume = e.volume AND w.start = e.frn AND (w.at IS NULL OR NOT EXISTS (SELECT 1 FROM e x WHERE x.volume = w.volume AND x.frn = w.at))
) THEN 'broken' ELSE 'cycle' END, CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), ''
FROM e WHERE NOT EXISTS (SELECT 1 FROM down d WHERE d.volume = e.volume AND d.frn = e.frn)
"""
P7_DESCENDANTS_SQL = r"""
WITH RECURSIVE e AS (
  SELECT volume, frn, parent_frn FROM frn_entries WHERE frn IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY volume, frn ORDER BY usn DESC NULLS LAST, parent_frn DESC NULLS LAST, name DESC NULLS LAST) = 1
), up AS (
  SELECT volume, frn AS start, parent_frn AS above FROM e
  UNION
  SELECT u.volume, u.start, e.parent_frn FROM up u JOIN e ON e.volume = u.volume AND e.frn = u.above
), loops AS (SELECT DISTINCT volume, start AS frn FROM up WHERE above = start)
SELECT e.volume, e.frn, count(u.start) AS descendants FROM e LEFT JOIN up u ON u.volume = e.volume AND u.above = e.frn
WHERE NOT EXISTS (SELECT 1 FROM loops l WHERE l.volume = e.volume AND l.frn = e.frn) GROUP BY ALL
"""
P7_DESCENDANT_PAIRS_SQL = r"""
WITH RECURSIVE e AS (
  SELECT volume, frn, parent_frn FROM frn_entries WHERE frn IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY volume, frn ORDER BY usn DESC NULLS LAST, parent_frn DESC NULLS LAST, name DESC NULLS LAST) = 1
), up AS (
  SELECT volume, frn AS start, parent_frn AS above FROM e
  UNION
  SELECT u.volume, u.start, e.parent_frn FROM up u JOIN e ON e.volume = u.volume AND e.frn = u.above
), loops AS (SELECT DISTINCT volume, start AS frn FROM up WHERE above = start),
tree AS (SELECT volume, frn, parent_frn FROM e WHERE NOT EXISTS (SELECT 1 FROM loops l WHERE l.volume = e.volume AND l.frn = e.frn)),
below AS (
  SELECT volume, frn AS start, parent_frn AS above FROM tree
  UNION
  SELECT b.volume, b.start, t.parent_frn FROM below b JOIN tree t ON t.volume = b.volume AND t.frn = b.above
)
SELECT b.volume, b.above AS ancestor, b.start AS frn, EXISTS (SELECT 1 FROM loops l WHERE l.volume = b.volume AND l.frn = b.above) AS "loop"
FROM below b JOIN e ON e.volume = b.volume AND e.frn = b.above WHERE b.above % 100 = 0
"""
