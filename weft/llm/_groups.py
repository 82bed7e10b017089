"""Links within groups of candidates, verified without ever listing all pairs of a group.

A group is a leader and the members that share a key with it. First every member is compared with
one leader. Groups that this leaves unconnected
are compared in tiles of TILE x TILE members, with two kinds of pairs left out: those already
connected, and those that meet in a larger group too. For the latter every member has a home, the
largest group it is in: a group whose members mostly have one home elsewhere compares only the
others among themselves and with those. So no link that matters to a component is lost, every pair
is met about once, and no task holds more than two tiles. Listed pairs are compared one by one before,
those that the first step connects left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm._components import components, union
from weft.llm._shared import cut

TILE = 1024


@dataclass(frozen=True)
class Alike:
    """many: which of the pairs of two lists of values are alike. all: the same for all pairs of a
    list, as a matrix, where there is a quicker way. may: for a list, a function that gives for places
    of it, and a start, which of those from there on need be compared with each. kind: the type of the values."""

    many: Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray]
    all: Callable[[list[np.ndarray]], np.ndarray] | None = None
    may: Callable[[list[np.ndarray]], Callable[[int], np.ndarray]] | None = None
    kind: type = np.uint64

    def values(self, column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
        return [np.frombuffer(x.as_buffer(), self.kind) for x in column]


def _verified(alike: Alike):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                yield some.select(["a", "b"]).filter(pa.array(alike.many(alike.values(some.column("one")), alike.values(some.column("two"))), pa.bool_()))

    return run


def _linked(alike: Alike, values: list[np.ndarray], group: np.ndarray, may: np.ndarray) -> np.ndarray:
    """Places of pairs that are alike and connect groups, some rows' pairs at a time, and of these ever more
    at a time; pairs that are connected by then aren't compared."""
    n, links, size = len(values), [np.zeros((0, 2), np.int64)], 256
    likely = alike.may(values) if alike.may else None
    step = max(1, (1 << 16) // n)
    for at in range(0, n, step):
        rows = slice(at, at + step)
        open_ = np.triu(may[rows, at:], 1) & (group[rows, None] != group[at:])
        if likely and open_.any():
            open_ &= likely(np.arange(at, min(at + step, n)), at)
        open_ = np.argwhere(open_) + at
        while len(open_):
            some, open_ = open_[:size], open_[size:]
            size = min(2 * size, 4096)
            some = some[alike.many([values[p] for p in some[:, 0]], [values[q] for q in some[:, 1]])]
            if len(some):
                links.append(some)
                made = union(group[some])
                place = np.minimum(np.searchsorted(made[:, 0], group), len(made) - 1)
                group = np.where(made[place, 0] == group, made[place, 1], group)
                open_ = open_[group[open_[:, 0]] != group[open_[:, 1]]]
    return np.concatenate(links)


def _tile(alike: Alike):
    def run(table: pa.Table) -> pa.Table:
        doc, label, tile, led = (table[c].to_numpy() for c in ("doc", "label", "tile", "led"))
        values = alike.values(table["values"])
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        side = led if i < 0 else tile
        may = (label[:, None] != label[None, :]) & (doc[:, None] < doc[None, :])
        if i != j:
            may &= side[:, None] != side[None, :]
        at = np.argwhere(may & alike.all(values)) if alike.all else _linked(alike, values, label, may | may.T)
        links = np.stack([doc[at[:, 0]], doc[at[:, 1]]], 1)
        made = union(links) if len(links) else links
        return pa.table({"a": made[:, 0].astype(np.int64), "b": made[:, 1].astype(np.int64)})

    return run


def _compared(open_: DataFrame, contents: DataFrame, alike: Alike) -> DataFrame:
    """Links between members of a group, other than those within its side ``led``."""
    sides = F.when(F.col("led"), F.col("inside")).otherwise(F.col("outside"))
    open_ = open_.withColumn("tile", F.pmod(F.xxhash64("doc"), F.ceil(sides / TILE)).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.ceil(F.col(n) / TILE).cast("int") - 1)
    task = lambda i, j: F.struct(F.least(i, j).alias("i"), F.greatest(i, j).alias("j"))
    # i < 0: tile -1 - i of the leader's side against tile j of the others
    across = lambda i, j: F.struct((-1 - i).alias("i"), j.alias("j"))
    t = F.col("tile")
    tasks = F.when(F.col("led"), F.transform(upto("outside"), lambda j: across(t, j))).otherwise(F.concat(F.transform(upto("inside"), lambda i: across(i, t)), F.transform(upto("outside"), lambda j: task(t, j))))
    dealt = open_.withColumn("task", F.explode(tasks)).select("a", "doc", "label", "led", "tile", "task.i", "task.j").join(contents, "doc")
    return dealt.groupBy("a", "i", "j").applyInArrow(_tile(alike), "a bigint, b bigint")


def ends(pairs: DataFrame) -> DataFrame:
    """(doc) of everything in pairs."""
    return pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()


def _labelled(pairs: DataFrame, label: DataFrame, *names: str) -> DataFrame:
    """pairs with the component of the ids in each named column, as <name>_in."""
    for name in names:
        pairs = pairs.join(label.toDF(name, f"{name}_in"), name, "left").withColumn(f"{name}_in", F.coalesce(f"{name}_in", name))
    return pairs


def connect(groups: DataFrame, pairs: DataFrame, contents: DataFrame, alike: Alike, listed: bool = True) -> DataFrame:
    """(id, component) of what is connected by links among pairs and within groups.

    groups: a, b (distinct; every member b with its leader a): all pairs of a group are candidates.
    pairs: a, b (distinct; candidates, to be compared unless they are connected already). listed: whether
    there are pairs outside groups; if not, only the first pair of each b is compared by itself.
    contents: doc, values (integers as bytes).
    """

    def verified(some: DataFrame) -> DataFrame:
        both = some.select("a", "b").join(contents.toDF("b", "two"), "b").join(contents.toDF("a", "one"), "a")
        return both.select("a", "b", "one", "two").mapInArrow(_verified(alike), "a bigint, b bigint")

    first = pairs.groupBy("b").agg(F.min("a").alias("a"))
    links = cut(verified(first))
    label = components(links)
    if listed:
        rest = _labelled(pairs.join(first, ["a", "b"], "left_anti"), label, "a", "b").where("a_in != b_in")
        links = cut(links.union(verified(rest)))
        label = components(links)
    grouped = groups.select("a", F.col("b").alias("doc")).union(groups.select("a", F.col("a").alias("doc"))).distinct()
    grouped = cut(_labelled(grouped, label, "doc").withColumnRenamed("doc_in", "label"))
    apart = grouped.groupBy("a").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("g"), F.max(F.when(F.col("a") == F.col("doc"), F.col("label"))).alias("lead")).where("low < high")
    largest = F.max(F.struct("g", "a")).over(Window.partitionBy("doc"))
    grouped = cut(grouped.join(apart.select("a", "g", "lead"), "a").withColumn("home", largest["a"]))
    usual = grouped.groupBy("a", "home").agg(F.count(F.lit(1)).alias("n")).groupBy("a").agg(F.max(F.struct("n", "home")).alias("u")).select("a", F.col("u.home").alias("usual"))
    led = F.when(F.col("usual") == F.col("a"), F.col("label") == F.col("lead")).otherwise(F.col("home") == F.col("usual"))
    grouped = cut(grouped.join(usual, "a").select("a", "doc", "label", led.alias("led")))
    apart = grouped.groupBy("a").agg(F.count_if(F.col("led")).alias("inside"), F.count_if(~F.col("led")).alias("outside")).where("outside > 0")
    more = cut(_compared(grouped.join(apart, "a"), contents, alike))  # two Python workers a task otherwise
    return components(links.union(more))
