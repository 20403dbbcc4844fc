"""Line dedup: a segment-partition edit join of all lines, in DataFrame functions only.

A line takes part in the edit join if it has at least ``least`` characters, in exact repeats if it
has at least ``exact`` and is not blank (``least`` if not given); others always stay. Two lines
are near if their edit distance is at most ``tau``. A line is cut into tau + 1 segments, so a
near line must hold one of them unchanged, at a place that differs by no more than the edits
left for either side (the length-aware windows below). Every line writes its own segments, and
the windows in which a line of its length or up to tau less would hold one; lines meet where
length, segment number and content agree.

Most of these keys belong to one line alone. A first pass reduces each key to the smallest and
largest line on it, combined before the shuffle, so a segment that very many lines share costs
one row per task. A second pass keeps the rows of keys with two lines or more. Keys with many
lines are not paired at once: what is left of their lines without the shared segment is again
within tau edits, so it is cut and matched in the same way, for ``LEVELS`` levels. Lines meet
only if sketches of their characters allow tau edits. Pairs of which too few parts agree, or that
use up their edits right after the first difference, are dropped; the others are verified on the
whole lines by a banded bit-parallel edit distance.

Position: documents in order of id (missing last), then of a 128-bit hash of their text, lines in
their order; rows with equal id and text count as one document. A line stays at its first
position, unless a near line comes earlier; all its other occurrences go. A missing text stays
missing and has no lines; an empty text has one empty line. Columns other than id and text are
carried along untouched whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrank.operators.scale import cut_lineage

TAU = 2
LEAST = 20
LEVELS = 3
# Lines on one key, of those found and of those looking, that are paired without further cutting.
MOST = 32
# Characters after the block of the first difference that must fit as well.
STRETCH = 24
# Rows of a few numbers that may go to all executors.
BROADCAST_ROWS = 200_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, _id, _text, _k1, _k2): the hashes stand for the text."""
    return docs.select(
        F.struct("*").alias("_row"),
        F.col(id_col).alias("_id"),
        F.col(text_col).alias("_text"),
        F.xxhash64(F.col(text_col)).alias("_k1"),
        F.xxhash64(F.lit("second"), F.col(text_col)).alias("_k2"),
    )


def _lines(keyed: DataFrame, least: int, exact: int | None) -> DataFrame:
    """(_id, _k1, _k2, no, line, h1, h2) of all lines that take part."""
    return (
        keyed.select("_id", "_k1", "_k2", F.posexplode(F.split("_text", "\n", -1)).alias("no", "line"))
        .filter(
            F.length("line") >= least
            if exact is None
            else (F.length("line") >= least) | (F.length("line") >= exact) & F.col("line").rlike("\\S")
        )
        .withColumns(
            {"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("second"), F.col("line"))}
        )
    )


def _position() -> Column:
    return F.struct(F.col("_id").isNull().alias("none"), "_id", "_k1", "_k2", "no")


def _kinds(tau: int) -> list[tuple[int, int, int]]:
    """(number, less, shift) of the pieces of a line: its segments first, then other windows.

    Segment ``number`` of a line that is ``less`` characters shorter can stand up to ``shift``
    beside its own place: no more than the edits that are left before it, and after it. With
    neither, the window is the line's own segment.
    """
    out = [(number, 0, 0) for number in range(tau + 1)]
    for less in range(tau + 1):
        for number in range(tau + 1):
            low = max(-number, less - (tau - number))
            high = min(number, less + (tau - number))
            out += [(number, less, s) for s in range(low, high + 1) if less or s]
    return out


def _pieces(rows: DataFrame, tau: int, least: int) -> DataFrame:
    """Pieces of the rows (grp, role, id, text): key, role, id, text, start, size.

    Roles: 0 looked up by others, 1 looks others up, 2 both. A row that is only looked up has
    no windows but its segments. The kinds are rows of their own before anything is cut, so all
    arithmetic is compiled with the scan.
    """
    parts = tau + 1
    names = ("number", "less", "shift")
    kinds = F.array(
        *[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, kind)]) for kind in _kinds(tau)]
    )
    cut = (
        rows.select("grp", "role", "id", "text", F.length("text").alias("n"))
        .withColumn("raw", F.col("text").cast("binary"))
        # Where every character is one byte, a piece is found without counting characters.
        .withColumn("plain", F.octet_length("text") == F.col("n"))
        .select("*", F.explode(kinds).alias("k"))
        .select("grp", F.col("role").alias("own"), "id", "text", "n", "raw", "plain", "k.*")
        .withColumn("role", F.expr("IF(less = 0 AND shift = 0, own, IF(own = 0, NULL, 1))"))
        .filter("role IS NOT NULL")
        .withColumn("target", F.col("n") - F.col("less"))
        .withColumn("whole", F.expr(f"CAST(target div {parts} AS INT)"))
        .withColumn("rest", F.col("target") % parts)
        .withColumn(
            "start",
            F.col("whole") * F.col("number")
            + F.greatest(F.lit(0), F.col("number") - parts + F.col("rest"))
            + F.col("shift"),
        )
        .withColumn(
            "size", F.col("whole") + F.when(F.col("rest") >= parts - F.col("number"), 1).otherwise(0)
        )
        .filter(F.expr("start >= 0 AND start + size <= n") & (F.col("target") >= least))
    )
    content = F.expr(
        "IF(plain, substring(raw, start + 1, size),"
        " CAST(substring(text, start + 1, size) AS BINARY))"
    )
    key = F.xxhash64("grp", F.expr("target * 64 + number"), content)
    return cut.select(key.alias("key"), "role", "id", "text", "start", "size")


def _shared(pieces: DataFrame) -> DataFrame:
    """(key, role, id) of the keys that one line looks up and another one is found on."""
    # The lowest bits of a line's number give way to the role; 62 bits tell lines apart.
    mark = F.col("id").bitwiseAND(-4).bitwiseOR(F.col("role").cast("long"))
    several = (
        pieces.select("key", mark.alias("mark"))
        .groupBy("key")
        .agg(F.min("mark").alias("low"), F.max("mark").alias("high"))
        .filter(F.shiftright("low", 2) != F.shiftright("high", 2))
        .select("key")
    )
    live = cut_lineage(
        pieces.select("key", "role", "id")
        .join(_small(cut_lineage(several)), "key", "left_semi")
        .distinct()
    )
    counts = live.groupBy("key").agg(
        F.count_if(F.col("role") != 1).alias("found"), F.count_if(F.col("role") != 0).alias("seek")
    )
    return cut_lineage(live.join(counts.filter("found > 0 AND seek > 0"), "key"))


def _candidates(
    lines: DataFrame, tau: int, least: int, most: int
) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b) of line hashes that share pieces, and the lines (h1, h2, line)."""
    rows = lines.select(
        F.lit(0).cast("long").alias("grp"),
        F.lit(2).alias("role"),
        F.col("h1").alias("id"),
        F.col("line").alias("text"),
    )
    pieces = _pieces(rows, tau, least)
    live = _shared(pieces)
    ids = _small(cut_lineage(live.select(F.col("id").alias("h1")).distinct()))
    texts = cut_lineage(
        lines.select("h1", "h2", "line")
        .join(ids, "h1", "left_semi")
        .groupBy("h1", "h2")
        .agg(F.min("line").alias("line"))
        .withColumn("sketch", _sketch("line"))
    )
    sketches = texts.select(F.col("h1").alias("id"), "sketch")
    # From here on only lines that share a piece matter.
    pieces = _pieces(
        texts.select(
            F.lit(0).cast("long").alias("grp"),
            F.lit(2).alias("role"),
            F.col("h1").alias("id"),
            F.col("line").alias("text"),
        ),
        tau,
        least,
    )
    found = None
    for level in range(LEVELS):
        many = (F.col("found") > most) & (F.col("seek") > most)
        crowded = cut_lineage(live.filter(many).select("key").distinct())
        last = level == LEVELS - 1 or crowded.isEmpty()
        pairing = live if last else live.filter(~many)
        pairing = pairing.select("key", "role", "id").join(sketches, "id")
        ours = pairing.filter("role <> 1").select("key", F.col("id").alias("x"), F.col("sketch").alias("sx"))
        theirs = pairing.filter("role <> 0").select("key", F.col("id").alias("y"), F.col("sketch").alias("sy"))
        alike = _alike(F.col("sx"), F.col("sy"), tau)
        pairs = (
            ours.join(theirs, (ours["key"] == theirs["key"]) & (F.col("x") != F.col("y")) & alike)
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        found = pairs if found is None else found.union(pairs)
        if last:
            break
        without = F.expr("concat(substring(text, 1, start), substring(text, start + size + 1))")
        rest = cut_lineage(
            pieces.join(_small(crowded), "key", "left_semi")
            .select(F.col("key").alias("grp"), "role", "id", without.alias("text"))
            .distinct()
        )
        pieces = _pieces(rest, tau, 1)
        live = _shared(pieces)
    return cut_lineage(found.distinct()), texts


def _sketch(text: str) -> Column:
    """Twice 64 bits: whether the characters, and the pairs of neighbours, of each of 64 classes
    are odd in number.

    An edit changes the number of two characters and of four pairs at most.
    """
    return F.expr(
        f"aggregate(filter(split({text}, ''), c -> c <> ''),"
        " struct(0 AS last, 0L AS ones, 0L AS twos),"
        " (s, c) -> struct(ascii(c) AS last,"
        " s.ones ^ shiftleft(1L, ascii(c) % 64) AS ones,"
        " s.twos ^ shiftleft(1L, (s.last * 31 + ascii(c)) % 64) AS twos))"
    )


def _alike(a: Column, b: Column, tau: int) -> Column:
    """Whether two sketches allow for tau edits."""
    apart = {n: F.bit_count(a[n].bitwiseXOR(b[n])) for n in ("ones", "twos")}
    return (apart["ones"] <= 2 * tau) & (apart["twos"] <= 4 * tau)


def _plausible(x: Column, y: Column, tau: int) -> Column:
    """Whether enough of x is in y: of its parts, tau edits can spoil no more than tau."""
    parts = 4 * tau
    size = F.floor(F.length(x) / parts).cast("int")
    kept = F.lit(0)
    for i in range(parts):
        part = F.substring(x, size * i + 1, size)
        first = F.greatest(F.lit(1), size * i + 1 - tau)
        around = F.substring(y, first, size * i + 1 + tau + size - first)
        kept = kept + F.when(F.contains(around, part), 1).otherwise(0)
    return kept >= parts - tau


def code_points(text: Column) -> Column:
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.ascii(c))


def _errors(a: Column, b: Column, tau: int) -> Column:
    """The bit vectors r0 to r``tau`` after all of ``b``, arrays of code points.

    For every number of errors d there is one bit vector over the 2 * tau + 1 diagonals around
    the main one: bit k is set if the first j + k - tau characters of ``a`` can become the first j
    of ``b`` with at most d errors. A character of ``b`` moves all diagonals at once: a match keeps
    a bit, an error takes bits of one error less from the same diagonal (replaced), the next
    (added) or the one before (left out).
    """
    band, full = 2 * tau + 1, (1 << (2 * tau + 1)) - 1

    def matches(char, j):
        mask = F.lit(0)
        for k in range(band):
            mask = mask + F.when(F.get(a, j + (k - tau)) == char, 1 << k).otherwise(0)
        return mask

    def step(state, match):
        fields, before = [], None
        for d in range(tau + 1):
            new = state[f"r{d}"].bitwiseAND(match)
            if d:
                less = state[f"r{d - 1}"]
                new = new.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1))
                new = new.bitwiseOR(F.shiftleft(before, 1)).bitwiseAND(full)
            fields.append(new.alias(f"r{d}"))
            before = new
        return F.struct(*fields)

    start = F.struct(*[F.lit(((1 << (d + 1)) - 1) << tau & full).alias(f"r{d}") for d in range(tau + 1)])
    return F.aggregate(F.transform(b, matches), start, step)


def edit_distance(a: Column, b: Column, tau: int) -> Column:
    """Edit distance of two texts as arrays of code points if at most ``tau``, else tau + 1.

    Both should be stored columns, not expressions: they are read once for every character.
    """
    end = _errors(a, b, tau)
    diagonal = F.greatest(F.lit(0), F.least(F.size(a) - F.size(b) + tau, F.lit(2 * tau)))
    reached = F.lit(tau + 1)
    for d in range(tau, -1, -1):
        reached = F.when(F.getbit(end[f"r{d}"], diagonal) == 1, d).otherwise(reached)
    return F.when(F.abs(F.size(a) - F.size(b)) > tau, tau + 1).otherwise(reached)


def _around_first_difference(x: Column, y: Column, tau: int) -> list[Column]:
    """The stretches of x and y from the block on in which they first differ."""
    blocks = 16
    size = F.floor(F.greatest(F.length(x), F.length(y)) / blocks).cast("int") + 1
    equal = F.lit(0)
    for i in range(1, blocks + 1):
        same = F.substring(x, F.lit(1), size * i) == F.substring(y, F.lit(1), size * i)
        equal = equal + F.when(same, 1).otherwise(0)
    start = size * equal + 1
    return [F.substring(x, start, size + STRETCH + tau), F.substring(y, start, size + STRETCH)]


def links(
    lines: DataFrame, tau: int = TAU, least: int = LEAST, most: int = MOST
) -> DataFrame:
    """Pairs of different lines at most ``tau`` edits apart: (a1, a2, b1, b2) by their hashes."""
    pairs, texts = _candidates(lines, tau, least, most)
    left = texts.select(F.col("h1").alias("a"), F.col("h2").alias("a2"), F.col("line").alias("x"))
    right = texts.select(F.col("h1").alias("b"), F.col("h2").alias("b2"), F.col("line").alias("y"))
    x, y = F.col("x"), F.col("y")
    close = pairs.join(left, "a").join(right, "b").select(
        F.col("a").alias("a1"), "a2", F.col("b").alias("b1"), "b2", "x", "y"
    ).filter((F.abs(F.length(x) - F.length(y)) <= tau) & _plausible(x, y, tau))
    # Most pairs run out of errors right after the first difference: look there before all else.
    near_x, near_y = _around_first_difference(x, y, tau)
    begun = cut_lineage(close.select("*", code_points(near_x).alias("p"), code_points(near_y).alias("q")))
    alive = _errors(F.col("p"), F.col("q"), tau)[f"r{tau}"] != 0
    whole = cut_lineage(
        begun.filter(alive).select(
            "a1", "a2", "b1", "b2", code_points(x).alias("x"), code_points(y).alias("y")
        )
    )
    return whole.filter(edit_distance(x, y, tau) <= tau).select("a1", "a2", "b1", "b2")


def verdicts(
    lines: DataFrame, tau: int = TAU, least: int = LEAST, most: int = MOST
) -> DataFrame:
    """For every line that occurs twice or has a near one: where it stays, and its near lines.

    (h1, h2, stays, n_links): ``stays`` is the position that stays, missing if all go.
    """
    firsts = cut_lineage(
        lines.groupBy("h1", "h2").agg(F.min(_position()).alias("first"), F.count(F.lit(1)).alias("n"))
    )
    near = cut_lineage(links(lines.filter(F.length("line") >= least), tau, least, most))
    both = near.union(near.select("b1", "b2", "a1", "a2"))
    other = firsts.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("first").alias("theirs"))
    earliest = (
        both.join(other, ["b1", "b2"])
        .groupBy(F.col("a1").alias("h1"), F.col("a2").alias("h2"))
        .agg(F.min("theirs").alias("theirs"), F.count(F.lit(1)).alias("n_links"))
    )
    return cut_lineage(
        firsts.join(cut_lineage(earliest), ["h1", "h2"], "left")
        .filter("n > 1 OR n_links > 0")
        .select(
            "h1",
            "h2",
            F.when(F.col("theirs").isNull() | (F.col("first") < F.col("theirs")), F.col("first")).alias("stays"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
        )
    )


def judged(
    docs: DataFrame,
    tau: int = TAU,
    least: int = LEAST,
    most: int = MOST,
    id_col: str = "doc_id",
    text_col: str = "text",
    exact: int | None = None,
) -> DataFrame:
    """Every row as struct ``_row`` with its new text ``kept`` and counts.

    n_lines: all lines; n_removed: those that went; n_links: near lines of its lines, summed.
    """
    keyed = _keyed(docs, id_col, text_col)
    lines = _lines(keyed, least, exact)
    found = verdicts(lines, tau, least, most)
    gone = F.col("stays").isNull() | (F.col("stays") != _position())
    per_doc = (
        lines.drop("line")
        .join(found, ["h1", "h2"])
        .groupBy("_id", "_k1", "_k2")
        .agg(
            F.collect_set(F.when(gone, F.col("no"))).alias("_gone"),
            # equal rows repeat every line, so lines are counted by their number
            F.collect_set(F.struct("no", "n_links")).alias("_near"),
        )
        .select(
            F.col("_id").alias("_i"),
            F.col("_k1").alias("_a"),
            F.col("_k2").alias("_b"),
            "_gone",
            F.aggregate("_near", F.lit(0).cast("long"), lambda s, x: s + x["n_links"]).alias("_links"),
        )
    )
    same = (
        F.col("_id").eqNullSafe(F.col("_i"))
        & (F.col("_k1") == F.col("_a"))
        & (F.col("_k2") == F.col("_b"))
    )
    joined = keyed.join(_small(cut_lineage(per_doc)), same, "left")
    gone_or_none = F.coalesce("_gone", F.array().cast("array<int>"))
    split = F.split("_text", "\n", -1)
    kept = F.when(
        F.size(gone_or_none) > 0,
        F.array_join(
            F.filter(split, lambda line, i: ~F.array_contains(gone_or_none, i.cast("int"))), "\n"
        ),
    ).otherwise(F.col("_text"))
    return joined.select(
        "_row",
        F.col("_id").alias("_id"),
        kept.alias("kept"),
        F.when(F.col("_text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.size(gone_or_none).cast("long").alias("n_removed"),
        F.coalesce("_links", F.lit(0).cast("long")).alias("n_links"),
    )


def dedup(
    docs: DataFrame,
    tau: int = TAU,
    least: int = LEAST,
    id_col: str = "doc_id",
    text_col: str = "text",
    exact: int | None = None,
) -> DataFrame:
    """``docs`` with the lines that came earlier taken out of its texts; no row is dropped."""
    found = judged(docs, tau, least, id_col=id_col, text_col=text_col, exact=exact)
    return found.select(
        *[
            (F.col("kept") if c == text_col else F.col(f"_row.`{c}`")).alias(c)
            for c in docs.columns
        ]
    )
