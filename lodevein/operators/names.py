"""Names of several words in free text, by a table of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _words(text: Column) -> Column:
    """Words without the marks at their ends."""
    bare = F.transform(F.split(text, r"\s+"), lambda w: F.trim(w, F.lit(" ,.;:()")))
    return F.filter(bare, lambda w: w != "")


def named_windows(texts: DataFrame, names: DataFrame) -> DataFrame:
    """id, value: distinct values of the names(name, value) that stand in texts(id, text) as whole words.

    Windows of one word to as many as the longest name has meet the names in a join.  Longer matches go first, of equal ones the earlier, and what overlaps a
    taken one doesn't count: a country whose name ends like another's isn't both.  A name may have several values.  Null texts, ids and names have none.
    """
    known = names.filter("value is not null").select(_words("name").alias("w"), "value").filter("size(w) > 0").select(F.array_join("w", " ").alias("name"), F.size("w").alias("length"), "value").distinct()
    most = known.agg(F.max("length")).first()[0] or 0
    if not most:
        return texts.select("id").limit(0).join(names.select("value").limit(0), F.lit(True), "cross")
    rows = texts.filter("id is not null and text is not null").select("id", F.sha2("text", 256).alias("of"), _words("text").alias("w")).distinct()
    starts = rows.select("id", "of", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("start")).filter("size(w) > 0").select("id", "of", "start", F.slice("w", F.col("start"), most).alias("w"))
    windows = starts.select("id", "of", "start", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("length"), "w").select("id", "of", "start", F.array_join(F.slice("w", F.lit(1), F.col("length")), " ").alias("name"))
    found = windows.join(known, "name").groupBy("id", "of", (-F.col("length")).alias("rank"), "start").agg(F.collect_set("value").alias("values"))
    ordered = found.groupBy("id", "of").agg(F.array_sort(F.collect_list(F.struct("rank", "start", "values"))).alias("m"))
    apart = lambda t, m: (t["start"] - t["rank"] <= m["start"]) | (m["start"] - m["rank"] <= t["start"])
    taken = F.aggregate("m", F.slice("m", 1, 0), lambda acc, m: F.when(F.forall(acc, lambda t: apart(t, m)), F.concat(acc, F.array(m))).otherwise(acc))
    return ordered.select("id", F.explode(F.flatten(F.transform(taken, lambda t: t["values"]))).alias("value")).distinct()
