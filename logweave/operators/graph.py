"""The forest of log statements: statements(event_id, idom_id, ...), where idom_id is the parent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions import text as t
from logweave.sources.tables import stored


def project_statements(rows: DataFrame) -> DataFrame:
    """Statements with the file's base name, the level in capitals and a negative idom as null."""
    return rows.select(F.when(F.col("idom_id") >= 0, F.col("idom_id")).alias("idom_id"), "event_id", t.base_name(F.col("path")).alias("file_name"), F.col("line_number").cast("int").alias("line_number"), F.upper("level").alias("level"), "template")


def roots(statements: DataFrame) -> DataFrame:
    return statements.where("idom_id is null")


def leaves(statements: DataFrame) -> DataFrame:
    parents = statements.where("idom_id is not null").select(F.col("idom_id").alias("parent")).distinct()
    return statements.join(parents, F.col("event_id") == F.col("parent"), "left_anti")


def with_idom(statements: DataFrame, *columns: str) -> DataFrame:
    """Statements with columns of their idom, prefixed idom_; null where there is none or it was never emitted."""
    parent = statements.select(F.col("event_id").alias("parent"), *[F.col(x).alias(f"idom_{x}") for x in columns])
    return statements.join(parent, F.col("idom_id") == F.col("parent"), "left").drop("parent")


def dominator_chain(statements: DataFrame) -> DataFrame:
    """(event_id, ancestor, depth) of every statement's dominators, nearest at depth 1.

    Jumps are doubled: with the ancestors up to depth d and the jump of length d known, one join gives those up to 2 d.
    A forest of height h takes log2 h joins, each written to the shared folder.
    """
    jump = stored(statements.where("idom_id is not null").select(F.col("event_id").alias("node"), F.col("idom_id").alias("far")), "jump")
    chain = jump.select(F.col("node").alias("event_id"), F.col("far").alias("ancestor"), F.lit(1).alias("depth"))
    length = 1
    while True:
        onward = jump.select(F.col("node").alias("event_id"), F.col("far").alias("via"))
        add = onward.join(chain.select(F.col("event_id").alias("via"), "ancestor", (F.col("depth") + length).alias("depth")), "via")
        new = stored(chain.unionByName(add.select("event_id", "ancestor", "depth")), "chain")
        jump = stored(jump.join(jump.select(F.col("node").alias("far"), F.col("far").alias("farther")), "far").select("node", F.col("farther").alias("far")), "jump")
        length *= 2
        chain = new
        if jump.isEmpty():
            return chain
        if not chain.where("event_id = ancestor").isEmpty():
            raise ValueError("the statements' idoms form a cycle")


def paths(statements: DataFrame) -> DataFrame:
    """(event_id, path): for each leaf the event ids from its root to itself."""
    chain = dominator_chain(statements).join(leaves(statements).select("event_id"), "event_id", "left_semi")
    above = chain.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("depth", "ancestor")), False).alias("above"))
    path = F.concat(F.coalesce(F.transform("above", lambda x: x["ancestor"]), F.array().cast("array<int>")), F.array("event_id"))
    return leaves(statements).select("event_id").join(above, "event_id", "left").select("event_id", path.alias("path"))


def ancestor_counts(statements: DataFrame) -> DataFrame:
    """(event_id, n): of statements(event_id, idom_id, flag), how many dominators have the flag.

    Counts over jumps are doubled with the jumps, so a state has one row for each statement, whatever the forest's height.
    """
    flags = statements.select(F.col("event_id").alias("above"), F.col("flag").cast("long").alias("has"))
    state = statements.select("event_id", F.col("idom_id").alias("far")).join(flags, F.col("far") == F.col("above"), "left")
    state = stored(state.select("event_id", "far", F.coalesce("has", F.lit(0)).cast("long").alias("n")), "counts")
    rounds = state.count().bit_length() + 1
    while not state.where("far is not null").isEmpty():
        if not rounds:
            raise ValueError("the statements' idoms form a cycle")
        rounds -= 1
        onward = state.select(F.col("event_id").alias("above"), F.col("far").alias("farther"), F.col("n").alias("more"))
        state = state.join(onward, F.col("far") == F.col("above"), "left")
        state = stored(state.select("event_id", F.col("farther").alias("far"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), "counts")
    return state.select("event_id", "n")


def statement_stats(statements: DataFrame) -> DataFrame:
    """Counts of statements, of those with an identifier variable, of (statement, dominator with one) pairs, and of statements in such pairs."""
    flagged = statements.select("event_id", "idom_id", F.exists(t.variables(F.col("template")), t.is_id).alias("flag"))
    above = ancestor_counts(flagged).select(F.col("event_id").alias("id"), "n")
    rows = flagged.join(above, F.col("event_id") == F.col("id"))
    pairs = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    return rows.agg(F.count("*").alias("stmt_count"), F.count_if("flag").alias("stmt_w_id_count"), pairs.alias("stmt_w_injection_count"), F.count_if(F.col("n") > 0).alias("stmt_injectable_count"))


def ancestor_variables(statements: DataFrame, variable: str = t.PLACEHOLDER) -> DataFrame:
    """(event_id, names, above): a statement's own variables and those of its dominators, nearest first."""
    own = statements.select("event_id", t.variables(F.col("template"), variable).alias("names"))
    chain = dominator_chain(statements).join(own.select(F.col("event_id").alias("ancestor"), F.col("names").alias("theirs")), "ancestor")
    above = chain.groupBy("event_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("depth", "theirs"))), lambda x: x["theirs"])).alias("above"))
    return own.join(above, "event_id", "left").select("event_id", "names", F.coalesce("above", F.array().cast("array<string>")).alias("above"))


def injected_variables(statements: DataFrame, whitelist: DataFrame | None = None) -> DataFrame:
    """(event_id, injected): names of the dominators' variables that a statement does not log itself; only where there are any."""
    rows = ancestor_variables(statements).select("event_id", F.array_distinct(F.array_except("above", "names")).alias("injected"))
    if whitelist is not None:
        names = rows.select("event_id", F.posexplode("injected").alias("place", "name")).join(whitelist.select("name").distinct(), "name", "left_semi")
        rows = names.groupBy("event_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("injected"))
    return rows.where(F.size("injected") > 0)


def assign_ids(rows: DataFrame, within: str, *order: str) -> DataFrame:
    """rows with place: numbers from 0 on in that order, within each value of a column."""
    return rows.withColumn("place", (F.row_number().over(Window.partitionBy(within).orderBy(*order)) - 1).cast("long"))


def lookup(statements: DataFrame, event_id: int) -> DataFrame:
    """The statement of an id; the filter reaches the scan."""
    return statements.where(F.col("event_id") == event_id)


def with_template(events: DataFrame, templates: DataFrame) -> DataFrame:
    """events with the level, path and template of their template_id; one that templates lacks is an error."""
    known = templates.select(F.col("template_id").alias("known_id"), "path", "level", "template")
    rows = events.join(known, F.col("template_id") == F.col("known_id"), "left")
    checked = F.when(F.col("known_id").isNotNull(), F.col("template_id")).otherwise(F.raise_error(F.concat(F.lit("no template "), F.col("template_id").cast("string"))).cast(events.schema["template_id"].dataType))
    return rows.withColumn("template_id", checked).drop("known_id")
