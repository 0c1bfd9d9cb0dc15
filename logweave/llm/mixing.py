"""Mixing sources to target weights by entropy balancing, in DataFrame expressions only.

Sources, in order of code point with null last, weigh 5, 2, 1, 5, 2, 1 and so on, and share the words of all documents.
A target stops at `most` times its source's words; the excess goes to the others by weight until none is above.

Of all document rates of at most `most` whose words add up to each source's target, those nearest to one copy each in
relative entropy are the exponential tilts min(most, exp(lambda * size)), with one lambda for each source.  Lambda is the
minimum of the convex dual, found by Newton's method: a step sums gradient and curvature over the sizes of all sources
at once, in one grouped aggregation of (source, size, number of documents).  A step that leaves the interval in which the
root must be, or meets no curvature, halves that interval instead.  A source whose target is its cap has rate `most`.

Rates, in millionths, become copies by size: documents of one source, largest first, get the copies that keep the running
total of copies next to the running total of rates.  The words this leaves over or short per source, at most its largest
document, are then mended on one size of each power of two.  Within a size, copies go round the documents.

A size or source of any number of rows is aggregated before it is shuffled, and documents of one size are ranked in parts
of a hash of their ids; windows over whole sources hold one row per distinct size, those over all sources one row per
source.  Null or blank text has size 0 and is taken 0 times, and so are all documents if all are; a text of any length
counts whole; null doc_ids rank first, and rows of one doc_id in any order, as they are alike; repeated rows are documents
of their own; an empty table gives an empty mix; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm import common as c

#: Newton steps planned together, and at most; the gap at which a source is solved, as a part of its target.
TOGETHER, STEPS, GAP = 5, 200, 1e-13
#: Parts of a rate.
UNIT = 1_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(c.WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, *, most: int = 3) -> DataFrame:
    """(place, source, source_size, target, capped) from (source, source_size)."""
    everything = Window.partitionBy(F.lit(0))
    ranked = sources.withColumn("place", F.row_number().over(everything.orderBy(F.col("source").isNull(), "source")))
    ranked = ranked.withColumn("weight", F.element_at(F.array(F.lit(1), F.lit(5), F.lit(2)), (F.col("place") % 3 + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", (F.col("source_size") * most).cast("long")).withColumn("total", F.sum("source_size").over(everything))
    # Sources reach their caps in order of cap over weight.
    before = everything.orderBy(F.col("cap").cast("double") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("double"))
    ranked = ranked.withColumn("left", (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double"))
    share = (F.col("total").cast("double") - F.col("spent")) / F.col("left")
    ranked = ranked.withColumn("level", share).withColumn("capped", F.col("cap").cast("double") <= share * F.col("weight"))
    level = F.min(F.when(~F.col("capped"), F.struct("spent", "level"))).over(everything)["level"]
    ranked = ranked.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level * F.col("weight")))
    return ranked.select("place", "source", "source_size", "target", "capped")


def _newton(state: DataFrame, sizes: DataFrame, most: int, tasks: int) -> DataFrame:
    """One step of every source of state(place, target, lam, low, high, gap); what is solved stays."""
    rate = F.exp(F.least(F.col("lam") * F.col("size"), F.lit(math.log(most) + 1)))
    words = F.col("n").cast("double") * F.col("size")
    at = state.join(sizes, "place").groupBy("place", "target", "lam", "low", "high", "gap").agg(
        (F.sum(words * F.least(rate, F.lit(float(most)))) - F.first("target")).alias("now"),
        F.sum(F.when(rate < most, words * F.col("size") * rate).otherwise(0.0)).alias("bend"),
    )
    at = at.coalesce(tasks).withColumns({"low": F.when(F.col("now") <= 0, F.col("lam")).otherwise(F.col("low")), "high": F.when(F.col("now") >= 0, F.col("lam")).otherwise(F.col("high"))})
    step = F.col("lam") - F.col("now") / F.col("bend")
    inside = (F.col("bend") > 0) & (step > F.col("low")) & (step < F.col("high"))
    middle = (F.col("low") + F.col("high")) / 2
    # Solved, or an interval that cannot be halved any more.
    done = (F.abs("gap") <= F.col("target") * GAP) | (F.abs("now") <= F.col("target") * GAP) | (((middle <= F.col("low")) | (middle >= F.col("high"))) & ~inside)
    lam = F.when(done, F.col("lam")).when(inside, step).otherwise(middle)
    return at.select("place", "target", lam.alias("lam"), "low", "high", F.when(done, 0.0).otherwise(F.col("now")).alias("gap"))


def tilts(targets: DataFrame, sizes: DataFrame, *, most: int = 3) -> DataFrame:
    """(place, lam) of the sources below their caps, from targets and sizes(place, size, n) with size above 0."""
    tasks = c.in_tasks(targets.count())
    least = sizes.groupBy("place").agg(F.min("size").alias("least"))
    share = F.col("target") / F.col("source_size")
    state = targets.where("source_size > 0 and target > 0 and not capped").join(least, "place")
    state = state.select("place", "target", F.lit(0.0).alias("lam"), F.when(share < 1, F.log(share)).otherwise(0.0).alias("low"), F.when(share > 1, F.lit(math.log(most)) / F.col("least")).otherwise(0.0).alias("high"), F.col("target").alias("gap"))
    for _ in range(0, STEPS, TOGETHER):
        for _ in range(TOGETHER):
            state = _newton(state, sizes, most, tasks)
        state = c.stored(state.coalesce(tasks), "tilts")
        if state.where(F.abs("gap") > F.col("target") * GAP).isEmpty():
            break
    return state.select("place", "lam")


def _copies(sizes: DataFrame, *, most: int) -> DataFrame:
    """(place, size, copies of all n documents) from (place, size, n, target, rate: millionths)."""
    by_size = Window.partitionBy("place").orderBy(F.desc("size"))
    rates = F.col("n") * F.col("rate")
    upto = F.sum(rates).over(by_size.rowsBetween(Window.unboundedPreceding, 0))
    first = sizes.withColumn("upto", upto).withColumn("copies", F.expr(f"(upto + {UNIT // 2}) div {UNIT} - (upto - n * rate + {UNIT // 2}) div {UNIT}")).drop("upto")
    parts = F.length(F.bin(F.col("size")))
    per_power = first.groupBy("place", "target", parts.alias("power")).agg(F.sum(F.col("copies") * F.col("size")).alias("words"), F.max(F.struct("n", "size", "copies")).alias("pick"))
    picked = F.struct(F.col("pick.size").alias("size"), F.col("pick.n").alias("n"), F.col("pick.copies").alias("copies"))
    per_source = per_power.groupBy("place", "target").agg(F.sum("words").alias("words"), F.sort_array(F.collect_list(picked), False).alias("picks"))

    def mend(state: Column, p: Column) -> Column:
        wanted = F.floor(state["short"] / p["size"] + 0.5).cast("long")
        add = F.greatest(-p["copies"], F.least(p["n"] * most - p["copies"], wanted))
        return F.struct(
            (state["short"] - (add * p["size"]).cast("double")).alias("short"),
            F.concat(state["made"], F.array(F.struct(p["size"].alias("size"), add.alias("add")))).alias("made"),
        )

    start = F.struct((F.col("target") - F.col("words").cast("double")).alias("short"), F.array().cast("array<struct<size:bigint,add:bigint>>").alias("made"))
    mends = per_source.select("place", F.explode(F.aggregate("picks", start, mend)["made"]).alias("m")).select("place", F.col("m.size").alias("size"), F.col("m.add").alias("add"))
    return first.join(mends, ["place", "size"], "left").select("place", "size", (F.col("copies") + F.coalesce("add", F.lit(0))).alias("copies"))


def mix(docs: DataFrame, *, most: int = 3, row: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row of docs(doc_id, text, source).

    size: words; source_size and target: words of the document's source and those it is to give; copies: 0 to `most`.
    row: a column that tells rows apart, which is returned too.
    """
    own = [row] if row else []
    text = F.col("text").cast("string")
    # Documents of one size rank by a part of a hash of their ids; those of null ids, which are alike, before all others.
    alike = F.xxhash64(*own) if row else F.xxhash64(text)
    part = F.coalesce(F.substring(F.md5(F.col("doc_id").cast("long").cast("string").cast("binary")), 1, 3), F.concat(F.lit(" "), F.pmod(alike, F.lit(4096)).cast("string")))
    sized = c.stored(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(text).alias("size"), part.alias("part"), *own), "sizes")
    parts = sized.groupBy("source", "size", "part").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    targets = c.stored(source_targets(sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), most=most), "targets")
    placed = targets.select(F.col("source").alias("s"), "place", "target", "capped")
    sizes = c.stored(sizes.join(placed, F.col("source").eqNullSafe(F.col("s"))).drop("s"), "by_size")
    words = sizes.where("size > 0").select("place", "size", "n")
    rated = sizes.where("size > 0").join(tilts(targets, words, most=most), "place", "left")
    tilt = F.least(F.exp(F.least(F.col("lam") * F.col("size"), F.lit(math.log(most) + 1))), F.lit(float(most)))
    rate = F.when(F.col("capped"), F.lit(most * UNIT)).otherwise(F.coalesce(F.floor(tilt * UNIT + 0.5), F.lit(0))).cast("long")
    copies = c.stored(_copies(rated.select("place", "size", "n", "target", rate.alias("rate")), most=most), "copies")

    ahead = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "size", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    plan = sizes.join(copies, ["place", "size"], "left").join(targets.select("place", "source_size"), "place")
    plan = plan.select(F.col("source").alias("s"), F.col("size").alias("z"), "n", "target", "source_size", F.coalesce("copies", F.lit(0)).cast("long").alias("copies"))
    plan = plan.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    plan = plan.select(F.col("s"), F.col("z"), F.col("part").alias("p"), "ahead", "n", "target", "source_size", "copies")
    ranked = sized.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("doc_id", *own)))
    out = ranked.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("part") == F.col("p")))
    mine = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("ahead") + F.col("rank") <= F.col("copies") % F.col("n"), 1).otherwise(0)
    out = out.select("doc_id", "source", "size", "source_size", "target", mine.cast("long").alias("copies"), *own)
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_rows(docs: DataFrame, *, most: int = 3) -> DataFrame:
    """docs with each row as often as the mix takes it, also if rows share a doc_id or have none."""
    rows = c.stored(docs.withColumn("row_", F.monotonically_increasing_id()), "rows")
    taken = mix(rows, most=most, row="row_").where("copies > 0").select(F.col("row_").alias("mixed_row"), F.col("copies").alias("mixed_copies"))
    rows = rows.join(taken.hint("shuffle_hash"), F.col("row_") == F.col("mixed_row"))
    return rows.withColumn("mixed_copy", F.explode(F.sequence(F.lit(1), F.col("mixed_copies").cast("int")))).select(*docs.columns)


#: The same in DuckDB's SQL, where each source's lambda comes from halving intervals over its list of sizes.
SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), hist AS (
  SELECT source, size, count(*) AS n FROM sized GROUP BY ALL
), src AS (
  SELECT source, CAST(sum(n * size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM hist GROUP BY source
), weighed AS (
  SELECT *, CASE place % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap, sum(source_size) OVER () AS total FROM src
), levels AS (
  SELECT *, CAST(coalesce(sum(cap) OVER b, 0) AS DOUBLE) AS spent, CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS lft
  FROM weighed WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), shares AS (
  SELECT *, (CAST(total AS DOUBLE) - spent) / lft AS share, CAST(cap AS DOUBLE) <= (CAST(total AS DOUBLE) - spent) / lft * weight AS capped FROM levels
), targets AS (
  SELECT place, source, source_size, capped, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE (arg_min(share, spent) FILTER (WHERE NOT capped) OVER ()) * weight END AS target FROM shares
), lists AS (
  SELECT t.place, any_value(t.target) AS target, any_value(t.source_size) AS total, min(h.size) AS smallest, list({'x': CAST(h.size AS DOUBLE), 'n': CAST(h.n AS DOUBLE)}) AS h
  FROM targets t JOIN hist h ON t.source IS NOT DISTINCT FROM h.source WHERE h.size > 0 AND NOT t.capped AND t.target > 0 GROUP BY t.place
), halved AS (
  SELECT place, target, h, 0 AS k, least(ln(target / total), 0.0) AS lo, CASE WHEN target > total THEN ln(3.0) / smallest ELSE 0.0 END AS hi FROM lists
  UNION ALL
  SELECT place, target, h, k + 1, CASE WHEN below THEN mid ELSE lo END, CASE WHEN below THEN hi ELSE mid END FROM (
    SELECT *, list_sum(list_transform(h, lambda z: z.n * z.x * least(3.0, exp(least(mid * z.x, 2.0))))) < target AS below FROM (SELECT *, (lo + hi) / 2 AS mid FROM halved WHERE k < 120))
), rated AS (
  SELECT t.*, (l.lo + l.hi) / 2 AS lam FROM targets t LEFT JOIN halved l ON l.place = t.place AND l.k = 120
), rates AS (
  SELECT h.source, h.size, CAST(h.n AS BIGINT) AS n, r.target, r.source_size, CASE WHEN r.capped THEN 3000000 ELSE CAST(coalesce(floor(least(exp(least(r.lam * h.size, 2.0)), 3.0) * 1000000 + 0.5), 0) AS BIGINT) END AS rate
  FROM hist h JOIN rated r ON h.source IS NOT DISTINCT FROM r.source WHERE h.size > 0
), running AS (
  SELECT *, CAST(sum(n * rate) OVER (PARTITION BY source ORDER BY size DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM rates
), firstly AS (
  SELECT *, (upto + 500000) // 1000000 - (upto - n * rate + 500000) // 1000000 AS copies FROM running
), powers AS (
  SELECT source, target, max({'n': n, 'size': size, 'copies': copies}) AS pick, sum(copies * size) AS words FROM firstly GROUP BY source, target, length(bin(size))
), picks AS (
  SELECT source, target, pick, row_number() OVER (PARTITION BY source ORDER BY pick.size DESC) AS k, sum(words) OVER (PARTITION BY source) AS words FROM powers
), mends AS (
  SELECT source, CAST(0 AS BIGINT) AS k, any_value(target) - CAST(any_value(words) AS DOUBLE) AS short, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS added FROM picks GROUP BY source
  UNION ALL
  SELECT source, k, short - CAST(added * size AS DOUBLE), size, added FROM (
    SELECT m.source, p.k, m.short, p.pick.size AS size, greatest(-p.pick.copies, least(p.pick.n * 3 - p.pick.copies, CAST(floor(m.short / p.pick.size + 0.5) AS BIGINT))) AS added
    FROM mends m JOIN picks p ON m.source IS NOT DISTINCT FROM p.source AND p.k = m.k + 1)
), plan AS (
  SELECT f.source, f.size, f.n, f.copies + coalesce(m.added, 0) AS copies FROM firstly f LEFT JOIN mends m ON f.source IS NOT DISTINCT FROM m.source AND f.size = m.size AND m.k > 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source, size ORDER BY coalesce(substr(md5(CAST(doc_id AS VARCHAR)), 1, 3), ' '), doc_id NULLS FIRST) AS place FROM sized
)
SELECT d.doc_id, d.size, r.source_size, r.target, CAST(coalesce(p.copies // p.n + CASE WHEN d.place <= p.copies % p.n THEN 1 ELSE 0 END, 0) * d.size AS BIGINT) AS taken
FROM ranked d JOIN targets r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN plan p ON d.source IS NOT DISTINCT FROM p.source AND d.size = p.size
"""
