"""Synthetic tool results: tables of a name, a size and a seed, each row made by arithmetic on its number.

A generator gives a row's fields as columns of JSON text; rows, seed and id are in scope. draw() is the same number
wherever it is computed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import json_string, money
from ..functions.extensions import GENERATORS

DRAWN = 100_003
PLACES = ("Aberdeen", "Bergen", "Cadiz", "Dover", "Esbjerg", "Falmouth", "Genoa")
NAMES = ("Alva", "Bruno", "Carla", "Dines", "Edda", "Fritz", "Greta", "Hugo", "Iris", "Jonas", "Karin")
SURNAMES = ("Aalto", "Brandt", "Cruz", "Dahl", "Engel", "Falk", "Gomes", "Holm", "Ivers")
TERMS = ("anchor", "ballast", "cargo", "deck", "engine", "freight", "gauge", "harbour", "island", "jetty", "keel", "lantern", "mast")
STATES = ("open", "paid", "sent", "void")
LEVELS = ("debug", "info", "warn", "error")
DEPARTMENTS = ("crew", "engines", "freight", "office")


def draw(k: int) -> Column:
    """A number from 0 to DRAWN - 1 for a row and a purpose."""
    return (F.col("id") * 7919 + F.col("seed") * 104729 + F.lit(k) * 48271 + F.col("id") * F.col("seed") * 31) % DRAWN


def pick(words: Sequence[str], k: int) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (draw(k) % len(words) + 1).cast("int"))


def day(first: str, span: int, k: int) -> Column:
    return F.date_format(F.date_add(F.lit(first).cast("date"), (draw(k) % span).cast("int")), "yyyy-MM-dd")


def padded(k: int, size: int) -> Column:
    return F.lpad(draw(k).cast("string"), size, "0")


def orders() -> dict[str, Column]:
    return {
        "amount": money(draw(1) + 100), "customer": json_string(F.concat_ws(" ", pick(NAMES, 2), pick(SURNAMES, 3))), "date": json_string(day("2023-01-01", 500, 4)),
        "id": (F.col("id") + 1001).cast("string"), "items": (draw(5) % 9 + 1).cast("string"), "status": json_string(pick(STATES, 6)),
    }


def logs() -> dict[str, Column]:
    at = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 37 + draw(1) % 30), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return {
        "latency_ms": (draw(2) % 900 + 5).cast("string"), "level": json_string(pick(LEVELS, 3)), "message": json_string(F.concat_ws(" ", pick(TERMS, 4), pick(TERMS, 5), pick(TERMS, 6))),
        "service": json_string(F.concat_ws("-", pick(TERMS, 7), F.lit("service"))), "time": json_string(at), "trace_id": json_string(F.concat(F.lit("t"), padded(8, 6))),
    }


def search() -> dict[str, Column]:
    title = F.concat_ws(" ", pick(TERMS, 1), pick(TERMS, 2), F.lit("guide"), (F.col("id") + 1).cast("string"))
    score = F.concat(F.lit("0."), F.lpad((9999 - (F.col("id") * 7) % 9000).cast("string"), 4, "0"))
    return {
        "doc_id": json_string(F.concat(F.lit("D-"), padded(3, 6))), "rank": (F.col("id") + 1).cast("string"), "score": F.regexp_replace(score, "0+$", ""),
        "title": json_string(title), "url": json_string(F.concat(F.lit("https://"), F.lower(pick(PLACES, 4)), F.lit(".example/"), F.replace(title, F.lit(" "), F.lit("-")))),
    }


def employees() -> dict[str, Column]:
    first, last = pick(NAMES, 1), pick(SURNAMES, 2)
    manager = F.when(F.col("id") == 0, F.lit("null")).otherwise((F.lit(5001) + draw(3) % F.greatest(F.col("id"), F.lit(1))).cast("string"))
    return {
        "active": F.when(draw(4) % 10 > 0, F.lit("true")).otherwise(F.lit("false")), "department": json_string(pick(DEPARTMENTS, 5)),
        "email": json_string(F.lower(F.concat(first, F.lit("."), last, F.col("id").cast("string"), F.lit("@example.com")))), "id": (F.col("id") + 5001).cast("string"),
        "location": json_string(pick(PLACES, 6)), "manager_id": manager, "name": json_string(F.concat_ws(" ", first, last)), "salary": (45000 + draw(7) % 150 * 1000).cast("string"),
        "start_date": json_string(day("2015-01-01", 4000, 8)),
    }


for _f in (orders, logs, search, employees):
    GENERATORS.register(_f.__name__, _f)


def generate(spark: SparkSession, names: Sequence[str], sizes: Sequence[int], seed: int, seeds: int = 1) -> DataFrame:
    """Rows of every table of the product of names, sizes and seeds: dataset, rows, seed, id, record (JSON, keys in order)."""
    out = None
    for name in names:
        fields = GENERATORS[name]()
        cases = [(size, seed + k) for size in sizes for k in range(seeds)]
        rows = spark.createDataFrame(cases, "rows long, seed long").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("id"))
        parts = [F.concat(F.lit(f'"{k}":'), fields[k]) for k in sorted(fields)]
        own = rows.select(F.lit(name).alias("dataset"), "rows", "seed", "id", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("record"))
        out = own if out is None else out.unionByName(own)
    return out


def questions(records: DataFrame, field: str) -> DataFrame:
    """Per table the count of rows with each value of a field: a question of how many, with its answer."""
    value = F.get_json_object("record", f"$.{field}")
    return records.groupBy("dataset", "rows", "seed", value.alias("value")).agg(F.count("*").alias("answer")).where(F.col("value").isNotNull())
