"""Entity resolution of mentions: grouping, token-boundary merging, best queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodefuse.sources.shared import stored


def grouped(mentions: DataFrame) -> DataFrame:
    """(canonical, kind, listings): distinct listings of each name (listing_id, canonical, kind); blank names go."""
    return mentions.where("trim(canonical) <> ''").groupBy("canonical", "kind").agg(F.count_distinct("listing_id").alias("listings"))


def contained(names: DataFrame) -> DataFrame:
    """(kind, shorter, longer): names that are a run of another's tokens, tokens being parted by underscores.

    A name meets those it is part of by the runs of tokens the longer ones have, so it is an
    equi-join, linear in the names' tokens.
    """
    tokens = names.select("kind", F.col("canonical").alias("longer"), F.split("canonical", "_").alias("t"))
    n = F.size("t")
    starts = F.sequence(F.lit(1), n)
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice("t", i, k), "_"))))
    spread = tokens.select("kind", "longer", F.explode(F.array_distinct(runs)).alias("canonical")).where("canonical <> longer")
    return spread.join(names.select("kind", "canonical").distinct(), ["kind", "canonical"]).select("kind", F.col("canonical").alias("shorter"), "longer")


def merged(names: DataFrame, rounds: int = 30) -> DataFrame:
    """(kind, canonical, root): names joined through what they contain, transitively; the root is the shortest, then the first.

    Labels spread along the links until none changes; each round is stored.
    """
    pairs = contained(names)
    edges = pairs.select("kind", F.col("shorter").alias("a"), F.col("longer").alias("b"))
    edges = edges.unionByName(edges.select("kind", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    label = F.struct(F.length("canonical").alias("n"), F.col("canonical").alias("root"))
    now = names.select("kind", "canonical").distinct().withColumn("label", label)
    for _ in range(rounds):
        far = now.select("kind", F.col("canonical").alias("b"), F.col("label").alias("offer"))
        offered = edges.join(far, ["kind", "b"]).groupBy("kind", "a").agg(F.min("offer").alias("offer")).withColumnRenamed("a", "canonical")
        step = now.join(offered, ["kind", "canonical"], "left")
        step = step.select("kind", "canonical", F.least("label", F.coalesce("offer", "label")).alias("label"), F.coalesce(F.col("offer") < F.col("label"), F.lit(False)).alias("moved"))
        step = stored(step, "labels")
        if step.where("moved").limit(1).count() == 0:
            return step.select("kind", "canonical", F.col("label.root").alias("root"))
        now = step.select("kind", "canonical", "label")
    raise RuntimeError("the names did not settle")


def best_query(mentions: DataFrame) -> DataFrame:
    """(canonical, name, n): the name to look an entity up by: of those with four letters or more and a capital or digit
    the most frequent, then shortest, then first; without one the canonical name, each word capitalized."""
    counts = mentions.groupBy("canonical", "name").agg(F.count("*").alias("n"))
    fit = (F.length(F.trim("name")) >= 4) & F.rlike("name", F.lit(r"[\p{Lu}0-9]"))
    by = Window.partitionBy("canonical").orderBy(F.desc(F.coalesce(fit, F.lit(False))), F.desc("n"), F.length("name"), "name")
    top = counts.withColumn("fit", F.coalesce(fit, F.lit(False))).withColumn("rn", F.row_number().over(by)).where("rn = 1")
    return top.select("canonical", F.when(F.col("fit"), F.col("name")).otherwise(F.initcap(F.replace("canonical", F.lit("_"), F.lit(" ")))).alias("name"), "n")


def lookup_text(best: DataFrame, cities: DataFrame) -> DataFrame:
    """(canonical, lookup): a best name, and after it the entity's most frequent city unless the name has it; cities: (canonical, city)."""
    counts = cities.where("city IS NOT NULL").groupBy("canonical", "city").agg(F.count("*").alias("n"))
    top = counts.groupBy("canonical").agg(F.min_by("city", F.struct(-F.col("n"), F.col("city"))).alias("city"))
    met = best.join(top, "canonical", "left")
    needs = F.col("city").isNotNull() & ~F.contains(F.lower("name"), F.lower("city"))
    return met.select("canonical", F.when(needs, F.concat_ws(", ", "name", "city")).otherwise(F.col("name")).alias("lookup"))


def described(mentions: DataFrame, cities: DataFrame, names: int = 10, places: int = 5) -> DataFrame:
    """(canonical, kind, listings, names, cities): mentions (listing_id, canonical, kind, name) grouped, with the most
    frequent names and cities (listing_id, city) of each group, of equally frequent ones the first by letter."""
    own = mentions.select("listing_id", F.lower(F.trim("canonical")).alias("canonical"), "kind", F.trim("name").alias("name")).where("canonical <> ''")
    met = own.join(cities.select("listing_id", "city"), "listing_id", "left")

    def top(column: str, most: int) -> DataFrame:
        counts = met.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy("canonical", "kind", column).agg(F.count("*").alias("n"))
        by = Window.partitionBy("canonical", "kind").orderBy(F.desc("n"), column)
        best = counts.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= most)
        return best.groupBy("canonical", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", column))), lambda x: x[column]).alias(f"{column}s"))

    out = own.groupBy("canonical", "kind").agg(F.count_distinct("listing_id").alias("listings"))
    out = out.join(top("name", names), ["canonical", "kind"], "left").join(top("city", places), ["canonical", "kind"], "left")
    none = F.array().cast("array<string>")
    return out.select("canonical", "kind", "listings", F.coalesce("names", none).alias("names"), F.coalesce("citys", none).alias("cities"))
