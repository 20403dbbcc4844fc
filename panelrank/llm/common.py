"""Helpers the operators share: table access, Arrow batches, digests, connected groups."""

from __future__ import annotations

import ctypes
import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelrank.operators.scale import cut_lineage

# Characters of text that one step of a Python worker holds as strings at a time.
CHUNK_CHARS = 700_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """At most ``rows`` rows: all of a small table, else about nine tenths of that many.

    Rows are drawn by a hash of their keys against a share set from the count, so every task
    sends on only what is drawn; the order and limit then work on the draw alone.
    """
    total = df.count()
    scale, drawn = 1 << 40, F.xxhash64(F.lit("draw"), *keys)
    if total > rows:
        df = df.filter(F.pmod(drawn, F.lit(scale)) < int(0.9 * scale * rows / total))
    return df.orderBy(drawn, *keys).limit(rows)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def fold(doc_id: int | None, folds: int = 5) -> int:
    """crc32 of the id as text, modulo ``folds``; a missing id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def fold_column(col: str, folds: int = 5):
    """The same number as a column."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % folds


def ranges(sizes: Iterable[int], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive items that add up to about ``most``, one item at least."""
    start = held = end = 0
    for end, size in enumerate(sizes, 1):
        held += size
        if held >= most:
            yield start, end
            start, held = end, 0
    if start < end:
        yield start, end


def chunks(texts: list[str | None], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts with about ``most`` characters each, one text at least."""
    return ranges((len(text or "") for text in texts), most)


def give_back() -> None:
    """Hand freed memory to the system; Arrow's pool and glibc keep most of it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(
    run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]],
) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow`` that gives memory back when its task ends.

    Spark keeps Python workers for later stages. Without this, a worker keeps the room of the
    largest batch of any stage so far, beside whatever its executor's JVM needs by then.
    """

    def released(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return released


def map_texts(
    df: DataFrame,
    keep: list[str],
    text: str,
    schema: StructType | str,
    work: Callable[[list[str | None], dict[str, list]], dict[str, list]],
    done: Callable[[], None] | None = None,
) -> DataFrame:
    """Run ``work`` over chunks of texts in Arrow batches.

    ``work`` gets the texts (None where missing) and the kept columns of a chunk and returns
    the output columns by name. Nothing but the named columns is read, so further columns of
    the input, whatever their names, do not matter. ``done`` is called once a task has ended.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    names = schema.fieldNames()
    renamed = [f"_k{i}" for i in range(len(keep))]
    narrow = df.select(
        *[F.col(f"`{k}`").alias(r) for k, r in zip(keep, renamed)],
        F.col(f"`{text}`").cast("string").alias("_text"),
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        try:
            for batch in batches:
                sizes = pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_pylist()
                for start, end in ranges(sizes):
                    part = batch.slice(start, end - start)
                    kept = {k: part.column(r).to_pylist() for k, r in zip(keep, renamed)}
                    out = work(part.column("_text").to_pylist(), kept)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[n], type=arrow.field(n).type) for n in names], schema=arrow
                    )
        finally:
            if done:
                done()

    return narrow.mapInArrow(releasing(run), schema)


def components(links: DataFrame) -> DataFrame:
    """Connected groups of the undirected links (a, b): one row (node, root) per node.

    ``root`` is the smallest node of the group. Alternates two star steps: every node hands its
    larger neighbours to its smallest one, then every node joins its smaller neighbours to the
    smallest of them. Both only need a minimum per node (combined before the shuffle) and a join,
    so a node with very many links is never gathered. Ends when a round changes no link.
    """
    links = cut_lineage(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .filter("a <> b")
        .distinct()
    )
    while True:
        both = links.union(links.select("b", "a"))
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.filter("b > a")
            .join(smallest, "a")
            .select(F.col("m").alias("a"), "b")
            .distinct()
        )
        large = cut_lineage(large)
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (
            large.join(least, "b")
            .select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x"))
            .select(F.col("x.m").alias("a"), F.col("x.a").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        small = cut_lineage(small)
        settled = small.count() == links.count() and small.exceptAll(links).isEmpty()
        links = small
        if settled:
            break
    roots = links.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("root"))
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots)
