"""A whole database copied: tables that refer to each other, and to themselves, under new dense ids.

New ids follow the order of the old ones, 1 upwards, and are given without any one task seeing a table: rows are dealt by ranges of
the old id and numbered within their range, and each range starts where those before it end; only the ranges' sizes come to the driver.
References, to other tables or the same one, are then joined with the old and new ids of the table that they mean.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored


def dense_ids(table: DataFrame, key: str = "id") -> DataFrame:
    """old, new: every distinct key, null ones left out, and its place among them from 1."""
    sorted_keys = table.select(F.col(key).alias("old")).where("old is not null").distinct().repartitionByRange("old").sortWithinPartitions("old")
    numbered = stored(sorted_keys.select("old", F.monotonically_increasing_id().alias("at")))  # partition * 2^33 + place in it
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["part"], r["n"]) for r in numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row a range
    starts = accumulate([0, *(n for _, n in sizes)])
    offset = F.create_map(*(F.lit(x) for (k, _), start in zip(sizes, starts) for x in (k, start))) if sizes else F.create_map(F.lit(0).cast("long"), F.lit(0))
    return numbered.select("old", (F.element_at(offset, part.cast("long")) + place + 1).cast("long").alias("new"))


def _deal(*values) -> Column:
    return F.pmod(F.xxhash64(*values), F.lit(1024))


def renumbered(tables: dict[str, DataFrame], keys: dict[str, str], references: list[tuple[str, str, str]]) -> dict[str, DataFrame]:
    """The tables with new ids in their key columns (``keys``: table -> column) and in what refers to them (table, column, table meant).

    Tables without a key keep their rows as they are but for references. A reference to a row that does not exist becomes null, as a null
    one stays; rows that repeat a key share its new id; rows with a null key keep it. All other columns, whatever their names, stay.
    """
    numbers = {name: dense_ids(tables[name], key) for name, key in keys.items()}
    out = {}
    for name, table in tables.items():
        columns = table.columns
        own = ([(keys[name], name)] if name in keys else []) + [(column, meant) for of, column, meant in references if of == name]
        for nth, (column, meant) in enumerate(own):
            numbered = numbers[meant]
            ids = numbered.select(F.col("old").alias(f"_old_{nth}_"), F.col("new").alias(f"_new_{nth}_"), _deal(F.col("old")).alias(f"_dealt_{nth}_"))
            meaning = F.col(column).cast(numbered.schema["old"].dataType)
            spread = [c for c, kind in tables[name].dtypes if "map<" not in kind and "variant" not in kind]
            # null references would all be one task's: they are dealt by the rest of their rows
            table = table.withColumn("_deal_", F.when(meaning.isNull(), _deal(*spread)).otherwise(_deal(meaning)))
            table = table.join(ids, (table[column] == ids[f"_old_{nth}_"]) & (table["_deal_"] == ids[f"_dealt_{nth}_"]), "left").drop(f"_old_{nth}_", f"_dealt_{nth}_", "_deal_")
        new = {column: F.col(f"_new_{nth}_") for nth, (column, _) in enumerate(own)}
        out[name] = table.select(*(new[c].alias(c) if c in new else F.col(c) for c in columns))
    return out


def copy_tables(tables: dict[str, DataFrame], keys: dict[str, str], references: list[tuple[str, str, str]], path: str, replace: bool = False) -> dict[str, int]:
    """Write the renumbered tables as Parquet below ``path``, each once; the number of rows of each. Without ``replace`` a table that is there already is an error."""
    counts = {}
    for name, table in renumbered(tables, keys, references).items():
        table.write.mode("overwrite" if replace else "errorifexists").parquet(f"{path}/{name}")
        counts[name] = table.sparkSession.read.schema(table.schema).parquet(f"{path}/{name}").count()
    return counts


def unresolved(tables: dict[str, DataFrame], keys: dict[str, str], references: list[tuple[str, str, str]]) -> DataFrame:
    """table, column, rows: for each reference how many rows mean one that does not exist."""
    out = None
    for name, column, meant in references:
        lost = tables[name].where(F.col(column).isNotNull()).join(tables[meant].select(F.col(keys[meant]).alias(column)), column, "left_anti")
        row = lost.agg(F.lit(name).alias("table"), F.lit(column).alias("column"), F.count(F.lit(1)).alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out
