"""Form fields: types, flags, states and text of fields (doc_id, n, ft, ff, name, values, options)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.sources.runtime import table

# fixed values: flag bits of fields
READONLY, REQUIRED, RADIO, PUSH, COMBO, EDIT, MULTI = 1, 2, 1 << 15, 1 << 16, 1 << 17, 1 << 20, 1 << 21


def flag(ff: Column, bits: int) -> Column:
    return F.coalesce(ff, F.lit(0)).cast("long").bitwiseAND(F.lit(bits).cast("long")) != 0


def kind(ft: Column, ff: Column) -> Column:
    """Push buttons count as radio buttons."""
    return (
        F.when(ft == "Btn", F.when(flag(ff, RADIO | PUSH), "Radio").otherwise("CheckBox"))
        .when(ft == "Ch", F.when(flag(ff, COMBO), "ComboBox").otherwise("ListBox"))
        .when(ft == "Tx", "Text")
        .otherwise("Unknown")
    )


def states(fields: DataFrame) -> DataFrame:
    """fields with type, selected, text, is_checked, multiselect, editable, readonly and required; null where a type
    has no such state. values: the field's values, one for all types but lists."""
    t = kind(F.col("ft"), F.col("ff"))
    one = F.coalesce(F.get(F.col("values"), F.lit(0)), F.lit(""))
    return (
        fields.withColumn("type", t)
        .withColumn("selected", F.when(F.col("type") == "Radio", F.array(one)).when(F.col("type").isin("ListBox", "ComboBox"), F.col("values")))
        .withColumn("text", F.when(F.col("type") == "Text", one))
        .withColumn("is_checked", F.when(F.col("type") == "CheckBox", one == "Yes"))
        .withColumn("multiselect", F.when(F.col("type") == "ListBox", flag(F.col("ff"), MULTI)))
        .withColumn("editable", F.when(F.col("type") == "ComboBox", flag(F.col("ff"), EDIT)))
        .withColumn("readonly", F.when(F.col("type") != "Unknown", flag(F.col("ff"), READONLY)))
        .withColumn("required", F.when(F.col("type") != "Unknown", flag(F.col("ff"), REQUIRED)))
    )


def described(states_: DataFrame) -> Column:
    """A field's state as text."""
    some = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ", ")
    t = F.col("type")
    return (
        F.when(t == "Radio", F.concat(F.lit("Radio: Selected: "), F.col("selected")[0], F.lit(", Options: ["), some("options"), F.lit("]")))
        .when(t == "CheckBox", F.concat(F.lit("CheckBox: Checked: "), F.col("is_checked").cast("string")))
        .when(t == "ListBox", F.concat(F.lit("ListBox: Selected: ["), some("selected"), F.lit("], Options: ["), some("options"), F.lit("], Multiselect: "), F.col("multiselect").cast("string")))
        .when(t == "ComboBox", F.concat(F.lit("ComboBox: Selected: ["), some("selected"), F.lit("], Options: ["), some("options"), F.lit("], Editable: "), F.col("editable").cast("string")))
        .when(t == "Text", F.col("text"))
        .otherwise("Unknown")
    )


def form_text(states_: DataFrame) -> DataFrame:
    """doc_id, paragraph: `name: state` lines in the order of n."""
    line = F.concat(F.coalesce("name", F.lit("")), F.lit(": "), described(states_), F.lit(" \n"))
    return states_.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "").alias("paragraph"))


def breadth_first(nodes: DataFrame) -> DataFrame:
    """node, n: the order of a walk by levels over nodes (node, parent, at: place among the parent's kids): by depth,
    then by the parents' order. Levels are joined one by one, until one is empty; forms are as deep as they are nested.
    A level deeper than there are nodes tells of a cycle, which is an error."""
    level = table(nodes.where("parent is null").select("node", F.array(F.col("at").cast("long")).alias("path")), "levels")
    out, left = level, nodes.count()
    while not level.isEmpty():
        if left == 0:
            raise ValueError("nodes form a cycle")
        left -= 1
        up = level.select(F.col("node").alias("parent"), F.col("path").alias("above"))
        level = table(nodes.join(up, "parent").select("node", F.concat("above", F.array(F.col("at").cast("long"))).alias("path")), "levels")
        out = out.unionByName(level)
    return out.select("node", (F.size("path") - 1).alias("depth"), "path")
