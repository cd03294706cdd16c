"""Relational work over the catalog: lists, search, facets and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def heads(versions: DataFrame) -> DataFrame:
    """The newest version of each collection."""
    rest = [c for c in versions.columns if c != "collection"]
    best = versions.groupBy("collection").agg(F.max_by(F.struct(*rest), "seq").alias("h"))
    return best.select("collection", *(F.col(f"h.{c}").alias(c) for c in rest))


def visible(collections: DataFrame, orgs: list[int] | None = None) -> DataFrame:
    """Public collections, and those of the caller's organizations."""
    return collections.where(F.col("public") | F.col("org").isin(orgs or []))


def search(columns: list[str], text: str) -> Column:
    """Case-insensitive substring over columns; wildcards are literal, the query is trimmed and cut at 100 characters."""
    q = text.strip()[:100].lower()
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(q)), F.lit(False))
    return found


def list_collections(collections: DataFrame, organizations: DataFrame, versions: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of collections with their owner and head version."""
    h = heads(versions).select("collection", "seq", "records", "bytes")
    rows = collections.join(organizations, "org").join(h, "collection", "left")
    return rows.orderBy(*order).offset(offset).limit(limit)


def schema_intervals(rows: DataFrame) -> DataFrame:
    """(collection, type, hash, from_seq, to_seq) out of (collection, type, seq, hash): half-open, the last one open; a schema that is set again unchanged goes on."""
    w = Window.partitionBy("collection", "type").orderBy("seq")
    changed = rows.withColumn("_b", F.lag("hash").over(w)).where(~F.col("hash").eqNullSafe(F.col("_b"))).drop("_b")
    return changed.withColumn("to_seq", F.lead("seq").over(w)).withColumnRenamed("seq", "from_seq")


def versions_in(intervals: DataFrame, versions: DataFrame, width: int = 64) -> DataFrame:
    """Versions inside half-open intervals of their collection.

    Sequence numbers are cut into buckets of width, open intervals end with their collection's newest version, and an
    interval goes to the buckets that it touches: a version meets intervals of its own bucket only, so a collection of many
    versions and intervals costs what it returns.
    """
    v = versions.select(F.col("collection").alias("_c"), "seq", "version", "created", F.floor(F.col("seq") / width).alias("_b"))
    newest = versions.groupBy(F.col("collection").alias("_c")).agg(F.max("seq").alias("_top"))
    closed = intervals.join(newest, F.col("collection") == F.col("_c")).withColumn("_end", F.least(F.coalesce(F.col("to_seq") - 1, F.col("_top")), F.col("_top")))
    dealt = closed.where(F.col("from_seq") <= F.col("_end")).withColumn("_d", F.explode(F.sequence(F.floor(F.col("from_seq") / width), F.floor(F.col("_end") / width)))).drop("_c")
    inside = (F.col("collection") == F.col("_c")) & (F.col("_d") == F.col("_b")) & F.col("seq").between(F.col("from_seq"), F.col("_end"))
    return dealt.join(v, inside).drop("_c", "_b", "_d", "_top", "_end")


def first_of_each(rows: DataFrame, by: str, order: str, limit: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)


def usage_table(usage: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Sums by key, a column for each metric, zero where there is none."""
    sums = [F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("amount"))), F.lit(0)).alias(m) for m in metrics]
    return usage.groupBy(key).agg(*sums)


def daily_series(usage: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each day of a period, zero where there is no usage."""
    days = usage.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))
    sums = usage.where(F.col("day").between(start, end)).groupBy("day").agg(F.sum("amount").alias("amount"))
    return days.join(sums, "day", "left").select("day", F.coalesce("amount", F.lit(0)).alias("amount"))


def monthly_growth(versions: DataFrame) -> DataFrame:
    return versions.groupBy(F.substring("created", 1, 7).alias("month")).agg(F.count("*").alias("versions"), F.sum("records").alias("records"))


def type_totals(typed: DataFrame, limit: int = 50) -> DataFrame:
    """Totals out of (collection, type_counts map), the largest first."""
    rows = typed.select("collection", F.explode("type_counts").alias("type", "n"))
    return rows.groupBy("type").agg(F.sum("n").alias("records"), F.count("*").alias("collections")).orderBy(F.desc("records"), "type").limit(limit)


def shared_schemas(intervals: DataFrame, limit: int = 20) -> DataFrame:
    """Schemas that several collections use now."""
    now = intervals.where("to_seq IS NULL").groupBy("hash").agg(F.countDistinct("collection").alias("collections"), F.min("type").alias("type"))
    return now.where("collections > 1").orderBy(F.desc("collections"), "hash").limit(limit)


def org_rollup(collections: DataFrame, organizations: DataFrame, versions: DataFrame) -> DataFrame:
    rows = collections.join(heads(versions).select("collection", "seq", "records", "bytes", "created"), "collection", "left")
    sums = rows.groupBy("org").agg(
        F.count("*").alias("collections"), F.count_if(F.col("public")).alias("public_collections"), F.coalesce(F.sum("seq"), F.lit(0)).alias("versions"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.max("created").alias("last_push"),
    )
    return organizations.join(sums, "org", "left").na.fill(0, ["collections", "public_collections", "versions", "records", "bytes"])


def facet(rows: DataFrame, column: str, limit: int) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(limit)


def telling_tags(tagged: DataFrame, limit: int = 8) -> DataFrame:
    """Counts of tags (collection, tags) that not every collection has."""
    total = tagged.agg(F.count("*").alias("total"))  # one row
    n = tagged.select("collection", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(total), F.col("n") < F.col("total")).drop("total").orderBy(F.desc("n"), "tag").limit(limit)


def profile(rows: DataFrame, columns: list[str], listed: int = 6) -> DataFrame:
    """One pass over rows: distinct values, blanks, least, largest, and the values themselves if they are few."""
    def aggregates(i: int, c: str) -> list[Column]:
        x = F.trim(F.col(c).cast("string"))
        v = F.when(x != "", x)
        return [F.countDistinct(v).alias(f"d{i}"), F.count_if(v.isNull()).alias(f"b{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]

    one = rows.agg(*(a for i, c in enumerate(columns) for a in aggregates(i, c)))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("values"), F.col(f"b{i}").alias("blanks"), F.col(f"lo{i}").alias("least"), F.col(f"hi{i}").alias("largest")) for i, c in enumerate(columns)])
    return one.select(F.explode(cells).alias("p")).select("p.*").withColumn("listed", F.col("values") <= listed)


def org_page(rows: DataFrame, tag: str | None, text: str, by: str = "records") -> DataFrame:
    """An organization's collections, filtered and sorted; missing record counts come last."""
    if tag is not None:
        rows = rows.where(F.array_contains("tags", tag))
    hay = F.lower(F.concat_ws(" ", "name", F.concat_ws(" ", "tags"), F.concat_ws(" ", "types")))
    rows = rows.where(F.contains(hay, F.lit(text.strip().lower())))
    order = {"records": [F.desc(F.coalesce("records", F.lit(-1))), F.asc("name")], "recent": [F.desc("created"), F.asc("name")], "name": [F.asc("name")]}[by]
    return rows.orderBy(*order)


def with_tag(rows: DataFrame, summary: str, tag: str) -> DataFrame:
    """Rows whose JSON summary lists a tag."""
    return rows.where(F.array_contains(F.from_json(F.get_json_object(summary, "$.tags"), "array<string>"), tag))


def in_list(rows: DataFrame, column: str, listed: str) -> DataFrame:
    """Rows whose column is in a JSON list, which comes with a request and is small."""
    kind = rows.schema[column].dataType.simpleString()
    wanted = rows.sparkSession.range(1).select(F.explode(F.from_json(F.lit(listed), f"array<{kind}>")).alias(column))
    return rows.join(F.broadcast(wanted.distinct()), column, "left_semi")


def in_pairs(rows: DataFrame, columns: tuple[str, str], listed: str) -> DataFrame:
    """Rows whose two columns are a pair of a JSON list of pairs, which comes with a request and is small."""
    wanted = rows.sparkSession.range(1).select(F.explode(F.from_json(F.lit(listed), "array<array<bigint>>")).alias("_p")).select(*(F.col("_p")[n].alias(c) for n, c in enumerate(columns)))
    return rows.join(F.broadcast(wanted.distinct()), list(columns))


def failed_pushes(versions: DataFrame, collections: DataFrame, organizations: DataFrame, failed: Column, limit: int) -> DataFrame:
    """The newest failed pushes with their collection and its owner."""
    return versions.where(failed).join(collections, "collection").join(organizations, "org").orderBy(F.desc("created"), "version").limit(limit)


def owners_of_lost(tombstones: DataFrame, organizations: DataFrame) -> DataFrame:
    """Tombstones with their owner's name, if the owner is known."""
    return tombstones.join(organizations, "org", "left")


def lost_ids(tombstones: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Ids that were dropped and that no live row has taken again."""
    return tombstones.select(key).distinct().join(live.select(key), key, "left_anti")


def conditional(rows: DataFrame, sums: dict[str, tuple[Column, Column | None]]) -> DataFrame:
    """A row of counts, or of sums of a column, under conditions."""
    cell = lambda on, of: F.count_if(on) if of is None else F.coalesce(F.sum(F.when(on, of)), F.lit(0))
    return rows.agg(*(cell(on, of).alias(n) for n, (on, of) in sums.items()))


def status_counts(rows: DataFrame, by: list[Column]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """A row with the number of rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias(name))  # one row
        out = one if out is None else out.join(F.broadcast(one), F.lit(True))
    return out


def org_version_sums(versions: DataFrame, collections: DataFrame) -> DataFrame:
    """Versions of each organization, and their records and bytes."""
    rows = versions.join(collections.select("collection", "org"), "collection")
    return rows.groupBy("org").agg(F.count("*").alias("versions"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes"))
