"""Mixing sources to target weights by a low-discrepancy schedule.

1. A source's target is its share by weight of all words, at most EPOCHS times
   its own size; the excess is dealt again by weight until no target is above.
2. A source's documents are put in an order by hash and laid end to end; the
   stream is cut in blocks of equal length.
3. A source wants target / block length slots. Slot i, for i = 0, 1, ..., is the
   golden-ratio point i * STEP mod 2^31; where it falls among the cumulative
   wants names the slot's source, so every run of slots holds each source nearly
   in proportion.
4. The slots of a source are ranked; rank r takes block r modulo the number of
   blocks. A document takes its words in a block as often as the block is taken.

Everything is DataFrame code. No window runs over all rows of a source or over
all slots: ranks and positions are counted within cells, about as many as a cell
has rows, and shifted by the cells' totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, table, word_count

EPOCHS = 3
#: Words of a block, at most; it bounds how far a source may miss its target.
BLOCK_WORDS = 64
#: 2^31 / golden ratio, made odd. Points have 31 bits, so products stay exact.
STEP, SPACE = 1327217885, 1 << 31
#: Points are joined to their source by their leading bits.
BIN = 1 << 19
WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Adds place, weight and target to ``sizes(source, source_size, ...)``, one row per source.

    Dealing the excess again ends at min(cap, level * weight) for the one level
    that gives the total. Sorted by cap / weight, the first sources are capped,
    and the level is what the others share of the rest.
    """
    every, order = W.partitionBy(), W.orderBy("ratio", "place").rowsBetween(W.unboundedPreceding, 0)
    df = sizes.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    df = df.withColumns({"weight": weight, "cap": (F.col("source_size") * epochs).cast("double")})
    df = df.withColumn("ratio", F.col("cap") / F.col("weight"))
    rest = F.sum(F.col("source_size").cast("double")).over(every) - (F.sum("cap").over(order) - F.col("cap"))
    open_weight = F.sum("weight").over(every) - (F.sum("weight").over(order) - F.col("weight"))
    # The level if exactly the sources before this one were capped.
    df = df.withColumn("level", rest / open_weight).withColumn("open", F.col("level") <= F.col("ratio"))
    level = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.struct("ratio", "place"))).over(every)
    return df.withColumn("target", F.least("cap", level * F.col("weight"))).drop("cap", "ratio", "level", "open")


def wants(sources: DataFrame, block_words: int) -> DataFrame:
    """Adds the number and length of blocks, the slots wanted, and the points [lo, hi) of each source."""
    every, order = W.partitionBy(), W.orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    blocks = F.ceil(F.col("source_size") / block_words)
    df = sources.withColumn("blocks", blocks).withColumn("length", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.greatest(F.lit(1), F.col("blocks")))))
    df = df.withColumn("want", F.coalesce(F.try_divide(F.col("target") * F.col("blocks"), F.col("source_size").cast("double")), F.lit(0.0)))
    # Rounded, so that the order of the sum does not show.
    df = df.withColumn("wanted", F.sum(F.round(F.col("want") * 1000).cast("long")).over(every))
    points = F.floor(F.coalesce(F.try_divide(F.col("want") * 1000, F.col("wanted").cast("double")), F.lit(0.0)) * SPACE)
    df = df.withColumn("points", F.least(points, F.lit(SPACE)))
    hi = F.sum("points").over(order)
    return df.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("points"))


def in_cells(df: DataFrame, group: str, cell: str, order: list, value) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over earlier rows of the group, cells first, then ``order`` within the cell."""
    totals = df.groupBy(group, cell).agg(F.sum(value).alias("in_cell"))
    ahead = W.partitionBy(group).orderBy(cell).rowsBetween(W.unboundedPreceding, 0)
    totals = totals.select(group, cell, (F.sum("in_cell").over(ahead) - F.col("in_cell")).alias("ahead"))
    inside = W.partitionBy(group, cell).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("inside", F.sum(value).over(inside) - value)
    return df.join(totals, [group, cell]).withColumn("before", F.col("ahead") + F.col("inside")).drop("ahead", "inside", cell)


def schedule(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """(place, block, takes) of every block that is taken."""
    spark = sources.sparkSession
    wanted = sources.agg(F.max("wanted")).first()[0] or 0
    n = (wanted + 500) // 1000
    slots = spark.range(n).select("id", F.pmod((F.col("id") % SPACE) * STEP, F.lit(SPACE)).alias("point"))
    spans = sources.filter("hi > lo").select(
        "place", "lo", "hi", "blocks", F.explode(F.sequence(F.floor(F.col("lo") / BIN), F.floor((F.col("hi") - 1) / BIN))).alias("bin")
    )
    slots = slots.withColumn("bin", F.floor(F.col("point") / BIN)).join(spans, "bin").filter("point >= lo and point < hi")
    cell = max(1, int(n**0.5))
    ranked = in_cells(slots.select("place", "blocks", "id", F.floor(F.col("id") / cell).alias("cell")), "place", "cell", ["id"], F.lit(1).cast("long"))
    ranked = ranked.filter(F.col("before") < F.col("blocks") * epochs)
    return ranked.groupBy("place", (F.col("before") % F.col("blocks")).alias("block")).agg(F.count(F.lit(1)).alias("takes"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, block_words: int = BLOCK_WORDS, seed: int = 0, carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, size, source_size, target, taken) for every row of ``docs``, and the columns that ``carry`` names.

    ``size`` counts words; NULL and empty texts have 0 and take 0. A NULL source
    is a source of its own, last in order. Rows with a NULL id are placed like
    any other. Rows that repeat are placed each; as they are equal, reruns agree.
    Without any word all targets are 0. An empty table gives an empty one; other
    columns are not read. No row takes more than ``epochs`` times its size: the
    few ranks beyond the last epoch stay empty.
    """
    ws = Workspace(docs.sparkSession, "mixing")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), F.md5(text))).alias("h"), *[F.col(c).alias(f"carried_{c}") for c in carry],
    )
    rows = ws.keep(rows, "rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = ws.keep(wants(targets(sizes, weights, epochs), block_words), "sources")
    of = sources.withColumnRenamed("source", "name").select("name", "place", "source_size", "target", "length", "n")
    rows = rows.join(of, F.col("source").eqNullSafe(F.col("name"))).drop("source", "name")
    # The leading 28 bits of the hash cut a source in about as many cells as a cell has rows.
    lead = F.conv(F.substring("h", 1, 7), 16, 10).cast("long")
    cells = F.ceil(F.sqrt("n"))
    rows = rows.withColumn("cell", F.floor(lead * cells / (1 << 28))).drop("n")
    rows = in_cells(rows, "place", "cell", ["h", "id"], F.col("size")).withColumnRenamed("before", "at")
    rows = ws.keep(rows.drop("h"), "positions")
    first, last = F.floor(F.col("at") / F.col("length")), F.floor((F.col("at") + F.col("size") - 1) / F.col("length"))
    pieces = rows.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    start, stop = F.col("block") * F.col("length"), (F.col("block") + 1) * F.col("length")
    words = F.least(F.col("at") + F.col("size"), stop) - F.greatest("at", start)
    # A position belongs to one row, so place and position name the row.
    taken = pieces.withColumn("words", words).join(schedule(sources, epochs), ["place", "block"])
    taken = taken.groupBy("place", "at").agg(F.sum(F.col("words") * F.col("takes")).alias("taken"))
    some = rows.filter("size > 0").join(taken, ["place", "at"], "left")
    none = rows.filter("size = 0").withColumn("taken", F.lit(None).cast("long"))
    return some.unionByName(none).select(
        F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *[F.col(f"carried_{c}").alias(c) for c in carry]
    )


def copies(docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """(row, copies): how often the mix takes each row of ``docs`` as a whole; ``row_col`` tells rows apart.

    A row is taken as often as the mix takes all of its words. What a source then
    lacks of its target goes to its rows, those whose last copy is taken in the
    largest part first, until the next row would miss the target by more than it
    mends. No row is taken more than ``epochs`` times. Rows that repeat add up;
    rows never taken are left out.
    """
    ws = Workspace(docs.sparkSession, "copies")
    rows = docs.select(id_col, text_col, source_col, row_col, F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("")).alias("of"))
    taken = mix(rows, id_col, text_col, source_col, carry=(row_col, "of"), **options).filter("size > 0")
    whole = F.floor(F.col("taken") / F.col("size"))
    part = (F.col("taken") - whole * F.col("size")) / F.col("size")
    taken = ws.keep(taken.select(F.col(row_col).alias("row"), F.col("of").alias("source"), "size", "target", whole.cast("int").alias("whole"), part.alias("part")), "taken")
    lack = taken.groupBy("source").agg((F.max("target") - F.sum(F.col("whole") * F.col("size"))).alias("lack"), F.count(F.lit(1)).alias("n"))
    lack = ws.keep(lack, "lack")
    # Parts in steps of 1/32, and within a step by hash, in about sqrt(n) / 4 cells.
    lead = F.conv(F.substring(F.md5("row"), 1, 7), 16, 10).cast("long")
    open_rows = taken.filter(F.col("whole") < options.get("epochs", EPOCHS)).join(lack, "source").withColumn("turn", F.floor((1 - F.col("part")) * 32))
    cells = F.ceil(F.sqrt("n") / 4)
    open_rows = open_rows.withColumn("cell", F.col("turn") * cells + F.floor(lead * cells / (1 << 28)))
    order = [F.md5("row"), "row"]
    placed = in_cells(open_rows.select("source", "cell", "row", "size", "lack"), "source", "cell", order, F.col("size"))
    more = placed.filter(F.col("before") + F.col("size") / 2 <= F.col("lack")).select("row", F.lit(1).alias("copies"))
    out = taken.filter("whole > 0").select("row", F.col("whole").alias("copies")).unionByName(more)
    return out.groupBy("row").agg(F.sum("copies").cast("int").alias("copies")).withColumnRenamed("row", row_col)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP8_SQL = f"""
with docs as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
         md5(concat_ws(':', '0', cast(doc_id as varchar), md5(coalesce(text, '')))) as h
  from documents),
sizes as (select source, cast(sum(size) as bigint) as source_size from docs group by source),
placed as (select *, row_number() over (order by source nulls last) - 1 as place from sizes),
weighed as (select *, [5.0, 2.0, 1.0][1 + place % 3]::double as weight, (source_size * {EPOCHS})::double as cap from placed),
level as (
  select *, cap / weight as ratio,
    (sum(source_size::double) over () - (sum(cap) over (order by cap / weight, place rows unbounded preceding) - cap))
    / (sum(weight) over () - (sum(weight) over (order by cap / weight, place rows unbounded preceding) - weight)) as level
  from weighed),
final as (select level from level where level <= ratio order by ratio, place limit 1),
targets as (select l.source, l.source_size, l.place, least(l.cap, f.level * l.weight) as target from level l, final f),
wants as (
  select *, cast(ceil(source_size / {BLOCK_WORDS}) as bigint) as blocks,
    greatest(1, cast(ceil(source_size / greatest(1, ceil(source_size / {BLOCK_WORDS}))) as bigint)) as length,
    case when source_size = 0 then 0.0 else target * cast(ceil(source_size / {BLOCK_WORDS}) as bigint) / source_size end as want
  from targets),
total as (select cast(sum(cast(round(want * 1000) as bigint)) as bigint) as wanted from wants),
spans as (
  select w.*, cast(floor(case when wanted = 0 then 0.0 else want * 1000 / wanted end * {SPACE}) as bigint) as points
  from wants w, total),
spans2 as (select *, cast(sum(points) over (order by place rows unbounded preceding) as bigint) as hi from spans),
slots as (select i, (i % {SPACE}) * {STEP} % {SPACE} as point from (select unnest(range((wanted + 500) // 1000)) as i from total)),
ranked as (
  select s.place, s.blocks, row_number() over (partition by s.place order by i) - 1 as rank
  from slots join spans2 s on point >= s.hi - s.points and point < s.hi),
takes as (select place, rank % blocks as block, count(*) as takes from ranked where rank < blocks * {EPOCHS} group by all),
laid as (
  select doc_id, d.size, s.source_size, s.target, s.place, s.length,
    cast(sum(d.size) over (partition by s.place order by h, doc_id rows unbounded preceding) as bigint) - d.size as start
  from docs d join spans2 s on d.source is not distinct from s.source),
named as (select *, row_number() over () as row from laid),
pieces as (select row, place, start, size, length, unnest(range(start // length, (start + size - 1) // length + 1)) as block from named where size > 0),
taken as (
  select row, sum((least(start + size, (block + 1) * length) - greatest(start, block * length)) * takes) as taken
  from pieces join takes using (place, block) group by row)
select doc_id, size, source_size, target, cast(coalesce(taken, 0) as bigint) as taken from named left join taken using (row)
"""
