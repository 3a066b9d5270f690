"""Pieces that several operators of this subpackage share.

``cut`` ends a lineage by a table in the shared folder that the cluster names in
``spark.checkpoint.dir``; ``components`` labels connected components without
bringing an edge to the driver.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words; a word is a run of anything else.
GAPS = r"[\x20\x09-\x0D]+"
#: Edges that one task joins in memory before it passes its stars on.
LOCAL_EDGES = 200_000
#: The folders that purely local sessions got, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for tables that cut a lineage.

    Read from the session. Only a purely local session (tests) may have none: then
    a temporary folder is made, and removed when the session's process ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = _OWN.get(spark.sparkContext.applicationId)
        if not found:
            found = _OWN[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="marginalia-")
            atexit.register(shutil.rmtree, found, True)
    return found.rstrip("/")


def show_workers(spark: SparkSession) -> None:
    """Python workers on this machine find the package where the driver found it, unless the session says otherwise."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back; lost executors lose nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the table behind a result of ``cut`` that nothing reads any more."""
    if df is not None and hasattr(df, "_cut_path"):
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread_join(many: DataFrame, few: DataFrame, on: list[str], by: list[str], how: str = "inner", deals: int = 8) -> DataFrame:
    """``many`` joined with ``few``, which has a row for each key, where one key may have a great share of ``many``.

    Rows of ``many`` are dealt by a hash of ``by``, and those of ``few`` go to all deals,
    so no task gets all rows of a key.
    """
    deal = "_deal"
    while deal in many.columns or deal in few.columns:
        deal += "_"
    dealt = many.withColumn(deal, F.pmod(F.xxhash64(*by), F.lit(deals)).cast("int"))
    every = few.withColumn(deal, F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    return dealt.join(every.hint("merge"), [*on, deal], how).drop(deal)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAPS), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    show_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _local_stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over bounded runs of edges; each node is linked to the least one it reaches."""
    up: dict = {}

    def root(x):
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def stars() -> pd.DataFrame:
        rows = [(root(x), x) for x in list(up)]
        up.clear()
        return pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["a", "b"])

    seen = 0
    for pdf in batches:
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            a, b = root(a), root(b)
            if a != b:
                low, high = (a, b) if a < b else (b, a)
                up.setdefault(low, low)
                up[high] = low
        seen += len(pdf)
        if seen >= LOCAL_EDGES:
            yield stars()
            seen = 0
    yield stars()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the undirected edges ``a, b`` (of one type).

    Rounds of contraction: each task first joins the edges it holds into stars, then
    every node moves to the least node beside it (by id and by a hash of the id in
    turn, so that long chains shrink too), and the edges between moved nodes remain.
    Groups only ever reduce to a minimum, so a hub isn't gathered in one task. Nulls
    and loops are dropped. No edges: no rows. The root is some node of the component,
    the same for all of its nodes.
    """
    kind = edges.schema["a"].dataType.simpleString()
    left = cut(edges.where("a <> b").mapInPandas(_local_stars, f"a {kind}, b {kind}").distinct())
    nodes = cut(left.select(F.col("a").alias("node")).union(left.select("b")).distinct())
    moves: list[DataFrame] = []
    while not left.isEmpty():
        turn = len(moves)
        rank = (lambda c: F.struct(F.lit(0).alias("k"), c.alias("v"))) if turn % 2 == 0 else (lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("k"), c.alias("v")))  # noqa: B023
        both = left.union(left.select("b", "a"))
        move = cut(
            both.groupBy(F.col("a").alias("node")).agg(F.min(rank(F.col("b"))).alias("m"))
            .select("node", F.least("m", rank(F.col("node")))["v"].alias("to")).where("node <> to")
        )
        first = move.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        second = move.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = left.join(first, "a", "left").join(second, "b", "left").select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b")).where("a <> b")
        after = cut(moved.mapInPandas(_local_stars, f"a {kind}, b {kind}").distinct())
        discard(left)
        left = after
        moves.append(move)
    out = nodes.select("node", F.col("node").alias("root"))
    for i, move in enumerate(moves):
        step = move.select(F.col("node").alias("root"), "to")
        out = out.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        if i % 4 == 3:
            out = cut(out)
    return out
