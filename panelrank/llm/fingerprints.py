"""Fingerprints of documents that can be subtracted: invertible Bloom lookup sketches of paragraphs.

A paragraph is a line; a line over ``LONG`` characters is cut after its sentences. Blank ones do not
count. The i-th occurrence of a paragraph in a text has the digest ``xxhash64(xxhash64(paragraph),
i)``, so a text is a set of digests. A sketch has three subtables; a digest falls into one cell of
each, and a cell holds the number of its digests, their exclusive or, and that of their check codes.

The cells of two versions subtract: what both hold cancels. A cell with one digest left (number 1 or
-1, check code right) names it; it is taken out of its cells in the other subtables, which may leave
further such cells. Subtables take turns, and a digest has one cell in each, so none is taken out
twice. Where cells remain, both versions are sketched again with more cells: ``ROOM`` for each digest
that the two hold together, since no more can differ, and ``GROWTH`` times as many after that. Any two
versions fit a sketch that is large enough for them, so this ends.

Likeness of two fingerprints is the share of their digests that they have in common: with a and b
digests and d that differ, (a + b - d) / (a + b + d), and 1 for two texts without paragraphs.

Everything is DataFrame functions. Texts are told apart by the digest of id and text, so rows alike
in both are worked on once and given out again at the end, in slices. The order of documents comes
from range slices. Half a text and the half that follows it meet by a shuffle on the document; from
then on only digests of paragraphs move, and all rounds of a pair run in the partition that holds
it, without a shuffle between them.

Defined results: a missing text is empty; an empty fingerprint means no paragraphs; documents with
the same id are ordered by the digest of id and text, a missing id comes first; rows alike in both
follow each other, so each but the last has itself as its next document; a lone document is its own
next one; a table without rows gives none; further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrank.operators import scale
from panelrank.operators.scale import cut_lineage

# Characters above which a line is cut after its sentences.
LONG = 500
# Cells of a fingerprint, a multiple of three; cells of a retry per digest, and how many times more
# each further one takes.
CELLS, ROOM, GROWTH = 24, 2, 4
# Cells that one task sketches and peels.
CELLS_PER_TASK = 400_000
# Turns of all three subtables before a pair counts as failed.
CYCLES = 4
# Equal rows that one step gives out at the end.
SLICE = 1000


def paragraphs(text: Column) -> Column:
    """The non-blank paragraphs of a text, as an array."""
    sentences = F.lit("(?<=[.!?])\\s+")
    pieces = F.transform(
        F.split(text, "\n"),
        lambda line: F.when(F.length(line) > LONG, F.split(line, sentences)).otherwise(F.array(line)),
    )
    return F.filter(F.flatten(pieces), lambda p: p.rlike("\\S"))


def _hashes(text: Column) -> Column:
    return F.transform(paragraphs(text), lambda p: F.xxhash64(p))


def members(versions: DataFrame, *keys: str) -> DataFrame:
    """Digests of each version, (keys..., digest), from arrays ``hashes`` of its paragraphs."""
    each = versions.select(*keys, F.explode("hashes").alias("h"))
    times = each.groupBy(*keys, "h").agg(F.count(F.lit(1)).alias("n"))
    numbered = times.select(*keys, "h", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i"))
    return numbered.select(*keys, F.xxhash64("h", "i").alias("digest"))


def _cell(digest: Column, subtable: int, cells: Column) -> Column:
    """The digest's cell in one of three subtables; other sizes place it anew."""
    third = F.floor(cells / 3)
    return (F.pmod(F.xxhash64(digest, cells, F.lit(subtable)), third) + subtable * third).cast("int")


def _check(digest: Column) -> Column:
    return F.hash(digest)


def sketch(digests: DataFrame, cells: Column, *keys: str) -> DataFrame:
    """Cells that are not empty: (keys..., cell, n, k, c)."""
    digest = F.col("digest")
    places = F.explode(F.array(*[_cell(digest, j, cells) for j in range(3)]))
    return (
        digests.select(*keys, "digest", places.alias("cell"))
        .groupBy(*keys, "cell")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.bit_xor("digest").alias("k"),
            F.bit_xor(_check(digest)).alias("c"),
        )
    )


def written(cells: DataFrame, *keys: str) -> DataFrame:
    """A sketch as text: (keys..., size, fingerprint), cells in order, all numbers in hex."""

    def hexed(col: Column, digits: int) -> Column:
        return F.right(F.lpad(F.lower(F.hex(col)), digits, "0"), F.lit(digits))

    first = F.when(F.col("cell") < CELLS // 3, F.col("n")).otherwise(0)
    text = F.transform(
        F.array_sort(F.collect_list(F.struct("cell", "n", "k", "c"))),
        lambda x: F.concat(hexed(x["cell"], 2), hexed(x["n"], 8), hexed(x["k"], 16), hexed(x["c"], 8)),
    )
    return cells.groupBy(*keys).agg(
        F.sum(first).alias("size"), F.concat_ws("", text).alias("fingerprint")
    )


def subtract(cells: DataFrame) -> DataFrame:
    """Cells of the first versions less those of the second, by pair; ``side`` is 1 or -1."""
    return (
        cells.groupBy("pos", "pair", "cells", "cell")
        .agg(F.sum(F.col("n") * F.col("side")).alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c"))
        .filter("n <> 0 OR k <> 0 OR c <> 0")
    )


def peel(cells: DataFrame) -> DataFrame:
    """Recovered digests and what remains: (pos, pair, cells, cell, digest, n, k, c).

    A recovered digest has its own row with cell -1 and n 1 (only in the first version) or -1.
    """
    long = F.lit(None).cast("long")
    rows = cells.withColumn("digest", long)
    kind = "struct<cell: int, digest: bigint, n: bigint, k: bigint, c: int>"

    def entry(cell: Column, digest: Column, n: Column, k: Column, c: Column) -> Column:
        return F.struct(cell, digest, n, k, c).cast(kind)

    n, k, c, cell, size = (F.col(x) for x in ("n", "k", "c", "cell", "cells"))
    zero = F.lit(0)
    for turn in range(3 * CYCLES):
        j = turn % 3
        own = F.floor(cell * 3 / size) == j
        pure = own & (F.abs(n) == 1) & (c == _check(k))
        gone = [entry(_cell(k, i, size), long, -n, k, c) for i in range(3) if i != j]
        named = entry(F.lit(-1), k, n, zero, zero)
        left = F.array(entry(cell, F.col("digest"), n, k, c))
        entries = F.when(pure, F.array(named, *gone)).otherwise(left)
        rows = (
            rows.select("pos", "pair", "cells", F.explode(entries).alias("e"))
            .select("pos", "pair", "cells", "e.*")
            .groupBy("pos", "pair", "cells", "cell", "digest")
            .agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c"))
            .filter("cell = -1 OR n <> 0 OR k <> 0 OR c <> 0")
        )
    return rows


def differences(sides: DataFrame) -> DataFrame:
    """(pos, pair, gone, come): digests only in the first, only in the second version of a pair.

    ``sides``: (pos, pair, side, hashes), a written table. Pairs that do not differ have no row. Both
    versions of a pair are sketched, subtracted and peeled where the pair's hash puts them.
    """
    pair, keys = ["pos", "pair"], ("pos", "pair", "cells", "side")
    digests = sides.agg(F.sum(F.size("hashes"))).first()[0] or 0
    least = int(sides.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, 3 * digests // CELLS_PER_TASK + 1)
    spread = sides.repartition(parts, *pair)
    placed, found = spread.withColumn("cells", F.lit(CELLS)), None
    while True:
        rest = peel(subtract(sketch(members(placed, *keys), F.col("cells"), *keys)))
        named = F.col("cell") == -1
        now = cut_lineage(
            rest.groupBy(*pair, "cells").agg(
                F.collect_list(F.when(named & (F.col("n") > 0), F.col("digest"))).alias("gone"),
                F.collect_list(F.when(named & (F.col("n") < 0), F.col("digest"))).alias("come"),
                F.count(F.when(~named, 1)).alias("left"),
            )
        )
        done = now.filter("left = 0").select(*pair, "gone", "come")
        found = done if found is None else found.unionByName(done)
        failed = now.filter("left > 0").select(*pair, F.col("cells").alias("tried"))
        if failed.isEmpty():
            return found
        both = F.sum(F.size("hashes")).over(Window.partitionBy(*pair))  # two rows
        cells = F.greatest(F.col("tried") * GROWTH, 3 * F.ceil(both * ROOM / 3)).cast("int")
        again = spread.join(failed.repartition(parts, *pair), pair)
        placed = again.select(*pair, "side", "hashes", cells.alias("cells"))


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    name = F.col(f"`{key}`").cast("string")
    named = F.coalesce(F.concat(F.length(name).cast("string"), F.lit(":"), name), F.lit("-"))
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(
        F.md5(F.concat(named, F.lit(" "), body).cast("binary")).alias("id"),
        F.col(f"`{key}`").alias("key"),
        body.alias("text"),
        F.length(body).cast("long").alias("n"),
    )


def ring(rows: DataFrame) -> DataFrame:
    """Distinct documents in order: (id, key, n, copies, pos, total, next_id); the last one's next is the first."""
    distinct = cut_lineage(rows.groupBy("id", "key", "n").agg(F.count(F.lit(1)).alias("copies")))
    one = F.lit(1).cast("long")
    placed = cut_lineage(scale.running_total(distinct, [], ["key", "id"], one, "pos", limit=0))
    total = F.lit(placed.count()).cast("long")
    before = F.pmod(F.col("pos") - 1, total)
    after = placed.select(before.alias("pos"), F.col("id").alias("next_id"))
    return cut_lineage(placed.withColumn("total", total).join(after, "pos"))


def _looked_up(table: DataFrame) -> DataFrame:
    few = scale.fits_one_task(table, scale.BROADCAST_BYTES) and table.count() <= scale.BROADCAST_ROWS
    return F.broadcast(table) if few else table


def versions(rows: DataFrame, order: DataFrame) -> DataFrame:
    """Every text and its edited form: (pos, kind, twice, total, sha256, hashes).

    Kind 0 is the text itself; kind 1 has its last half replaced by the start of the next document;
    kind 2, where rows are alike, is the same with the document itself as the next one.
    """
    half = F.floor(F.col("n") / 2).cast("int")
    after = order.select(F.col("next_id").alias("id"), F.col("id").alias("to"), half.alias("take"), F.lit(1).alias("kind"))
    same = order.filter("copies > 1").select("id", F.col("id").alias("to"), half.alias("take"), F.lit(2).alias("kind"))
    links = cut_lineage(after.unionByName(same))
    nothing = F.lit(None).cast("string")
    own = rows.select(
        "id",
        _hashes(F.col("text")).alias("hashes"),
        F.left("text", (F.col("n") - half).cast("int")).alias("kept"),
        nothing.alias("given1"),
        nothing.alias("given2"),
    )
    start = F.left("text", F.col("take"))
    given = rows.select("id", "text").join(_looked_up(links), "id")
    given = given.select(
        F.col("to").alias("id"),
        F.lit(None).cast("array<bigint>").alias("hashes"),
        nothing.alias("kept"),
        F.when(F.col("kind") == 1, start).alias("given1"),
        F.when(F.col("kind") == 2, start).alias("given2"),
    )
    columns = ("hashes", "kept", "given1", "given2")
    parts = own.unionByName(given).groupBy("id").agg(*[F.max(c).alias(c) for c in columns])
    place = order.select("id", "pos", "total", (F.col("copies") > 1).alias("twice"))
    edited = parts.join(place, "id").withColumns(
        {"edited1": F.concat("kept", "given1"), "edited2": F.concat("kept", "given2")}
    )

    def version(kind: int, text: Column | None, hashes: Column) -> Column:
        sha = nothing if text is None else F.sha2(text, 256)
        return F.struct(F.lit(kind).alias("kind"), sha.alias("sha256"), hashes.alias("hashes"))

    each = F.array(
        version(0, None, F.col("hashes")),
        *[version(i, F.col(f"edited{i}"), _hashes(F.col(f"edited{i}"))) for i in (1, 2)],
    )
    out = edited.select("pos", "twice", "total", F.explode(each).alias("v"))
    return cut_lineage(out.select("pos", "twice", "total", "v.*").filter("kind <> 2 OR twice"))


def pairs(found: DataFrame) -> DataFrame:
    """Versions to compare: pair 1 and 2, a text and its edited forms; pair 3, a text and the next."""
    own = F.col("kind") == 0

    def role(when: Column, pos: Column, pair: Column, side: int) -> Column:
        return F.when(when, F.struct(pos.alias("pos"), pair.cast("int").alias("pair"), F.lit(side).alias("side")))

    here = F.col("pos")
    roles = F.array(
        role(own, here, F.lit(1), 1),
        role(own & F.col("twice"), here, F.lit(2), 1),
        role(own, here, F.lit(3), 1),
        role(own, F.pmod(here - 1, F.col("total")), F.lit(3), -1),
        role(~own, here, F.col("kind"), -1),
    )
    each = F.explode(F.filter(roles, lambda r: r.isNotNull()))
    return found.select(each.alias("r"), "hashes").select("r.*", "hashes")


def _likeness(a: Column, b: Column, d: Column) -> Column:
    return F.when(a + b + d == 0, 1.0).otherwise((a + b - d) / (a + b + d))


def _assembled(order: DataFrame, found: DataFrame, differ: DataFrame) -> DataFrame:
    """One row per distinct document of ``order`` with the sketches and numbers of its versions."""
    keys = ("pos", "kind")
    prints = written(sketch(members(found.repartition("pos"), *keys), F.lit(CELLS), *keys), *keys)

    def pick(by: str, value: str, of: int, name: str) -> Column:
        return F.max(F.when(F.col(by) == of, F.col(value))).alias(name)

    sizes = prints.groupBy("pos").agg(
        *[pick("kind", "size", i, f"size{i}") for i in range(3)],
        *[pick("kind", "fingerprint", i, f"print{i}") for i in range(3)],
    )
    shas = found.groupBy("pos").agg(*[pick("kind", "sha256", i, f"sha{i}") for i in (1, 2)])
    apart = differ.groupBy("pos").agg(*[pick("pair", "d", i, f"d{i}") for i in (1, 2, 3)])
    joined = order.select("pos", "key", "n", "copies", "next_size")
    for more in (sizes, shas, apart):
        joined = joined.join(more, "pos", "left")
    numbers = ("size0", "size1", "size2", "d1", "d2", "d3", "next_size")
    return joined.fillna(0, numbers).fillna("", ("print0", "print1", "print2"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_chars, the edited text's digest, both fingerprints, and both likenesses."""
    rows = _identified(docs, key, text)
    order = ring(rows)
    found = versions(rows, order)
    differ = differences(pairs(found)).select(
        "pos", "pair", (F.size("gone") + F.size("come")).alias("d")
    )
    following = found.filter("kind = 0").select(
        F.pmod(F.col("pos") - 1, F.col("total")).alias("pos"), F.size("hashes").alias("next_size")
    )
    order = cut_lineage(order.select("pos", "key", "n", "copies").join(following, "pos", "left"))
    a, one = F.col("size0"), F.lit(1).cast("long")

    def result(i: int, near_next: Column, times: Column) -> Column:
        return F.struct(
            times.alias("times"),
            F.col(f"sha{i}").alias("edited_sha256"),
            F.col(f"print{i}").alias("edited_fingerprint"),
            _likeness(a, F.col(f"size{i}"), F.col(f"d{i}")).alias("near_edited"),
            near_next.alias("near_next"),
        )

    # Rows alike in id and text: all but the last have themselves as the next document.
    last = result(1, _likeness(a, F.col("next_size"), F.col("d3")), one)
    alike = result(2, F.lit(1.0), F.col("copies") - 1)

    def given_out(joined: DataFrame, slices: bool) -> DataFrame:
        each = joined.select("key", "n", "print0", F.explode(F.array(last, alike)).alias("r")).filter("r.times > 0")
        if slices:
            starts = F.explode(F.sequence(0 * one, F.col("r.times") - 1, F.lit(SLICE).cast("long")))
            each = each.withColumn("start", starts).repartition("key", "start")
            rest = F.least(F.lit(SLICE).cast("long"), F.col("r.times") - F.col("start"))
        else:
            rest = F.col("r.times")
        return each.withColumn("_", F.explode(F.sequence(one, rest))).select(
            F.col("key").alias(key),
            F.col("n").alias("n_chars"),
            "r.edited_sha256",
            F.col("print0").alias("fingerprint"),
            "r.edited_fingerprint",
            "r.near_edited",
            "r.near_next",
        )

    # Documents with very many equal rows are few; theirs are spread slice by slice.
    many = order.filter(F.col("copies") > SLICE)
    few = _assembled(order.filter(F.col("copies") <= SLICE), found, differ)
    out = given_out(few, False)
    if many.isEmpty():
        return out
    own = [table.join(many.select("pos"), "pos", "left_semi") for table in (found, differ)]
    return out.unionByName(given_out(cut_lineage(_assembled(many, *own)), True))
