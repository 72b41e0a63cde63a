"""Tables of a distribution model from its records (B05): lines, switches, transformers, loads and profiles.

Records are rows of sources.model_files: (file, at, verb, kind, name, properties). Of repeated properties the last counts, but for
windings, whose properties belong to the winding that was named last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Properties of one winding, and of all windings as a list.
OF_WINDING, OF_ALL = ("bus", "kv", "kva", "conn", "%r", "tap"), {"buses": "bus", "kvs": "kv", "kvas": "kva", "conns": "conn", "%rs": "%r", "taps": "tap"}
TRUE = ("y", "yes", "t", "true", "1")


def value(key: str, properties: Column | str = "properties") -> Column:
    """The last value of a property, null if there is none."""
    return F.get(F.reverse(F.filter(properties, lambda p: p["key"] == key)), F.lit(0))["value"]


def number(key: str) -> Column:
    return value(key).try_cast("double")


def listed(x: Column) -> Column:
    """The elements of a value that is a list."""
    return F.filter(F.split(F.trim(x), r"[\s,|]+"), lambda y: y != "")


def bus_name(reference: Column) -> Column:
    """The bus of a reference such as b12.1.2, in lower case."""
    return F.lower(F.split(reference, r"\.")[0])


def is_true(key: str) -> Column:
    return F.lower(value(key)).isin(*TRUE)


def elements(records: DataFrame, kind: str) -> DataFrame:
    """New records of one kind; one that is told twice counts as told last, by file and place."""
    own = records.where((F.col("verb") == "new") & (F.col("kind") == kind))
    return own.groupBy(F.lower("name").alias("name")).agg(F.max_by("properties", F.struct("file", "at")).alias("properties"))


def line_elements(records: DataFrame) -> DataFrame:
    far = lambda key: bus_name(value(key))
    return elements(records, "line").select("name", far("bus1").alias("bus1"), far("bus2").alias("bus2"), number("length").alias("length"), F.lower(value("units")).alias("units"), number("phases").cast("int").alias("phases"), value("linecode").alias("linecode"), F.coalesce(is_true("switch"), F.lit(False)).alias("is_switch"), F.coalesce(is_true("enabled"), F.lit(True)).alias("is_closed"))


def switch_elements(records: DataFrame) -> DataFrame:
    return line_elements(records).where("is_switch").select("name", "bus1", "bus2", F.when(F.col("is_closed"), "closed").otherwise("open").alias("status"))


def transformer_windings(records: DataFrame) -> DataFrame:
    """One row for each winding: (name, winding, bus, kv, kva, conn), and windings, phases and xhl of the transformer."""
    found = elements(records, "transformer").select("name", "properties", number("windings").cast("int").alias("windings"), number("phases").cast("int").alias("phases"), number("xhl").alias("xhl"))
    place = F.struct(F.lit(1).alias("w"), F.array().cast("array<struct<w:int,key:string,value:string>>").alias("out"))
    named = lambda s, p: F.when(p["key"] == "wdg", p["value"].try_cast("int")).otherwise(s["w"])
    each = F.aggregate("properties", place, lambda s, p: F.struct(named(s, p).alias("w"), F.concat(s["out"], F.array(F.struct(named(s, p).alias("w"), p["key"].alias("key"), p["value"].alias("value")))).alias("out")), lambda s: s["out"])
    single = found.select("name", F.posexplode(each).alias("i", "p")).select("name", "i", "p.w", "p.key", "p.value").where(F.col("key").isin(*OF_WINDING))
    whole = found.select("name", F.posexplode("properties").alias("i", "p")).where(F.col("p.key").isin(*OF_ALL))
    names = F.create_map(*(F.lit(x) for kv in OF_ALL.items() for x in kv))
    whole = whole.select("name", "i", names[F.col("p.key")].alias("key"), F.posexplode(listed(F.col("p.value"))).alias("w", "value")).select("name", "i", (F.col("w") + 1).alias("w"), "key", "value")
    said = single.unionByName(whole)
    last = lambda key: F.max_by(F.when(F.col("key") == key, F.col("value")), F.when(F.col("key") == key, F.col("i")))
    rows = said.groupBy("name", F.col("w").alias("winding")).agg(bus_name(last("bus")).alias("bus"), last("kv").try_cast("double").alias("kv"), last("kva").try_cast("double").alias("kva"), F.lower(last("conn")).alias("conn"))
    return rows.join(found.drop("properties"), "name")


def load_elements(records: DataFrame) -> DataFrame:
    """Phases are those given, or as many as the bus reference names."""
    nodes = F.size(F.split(value("bus1"), r"\.")) - 1
    return elements(records, "load").select("name", bus_name(value("bus1")).alias("bus"), F.coalesce(number("phases").cast("int"), F.when(nodes > 0, nodes)).alias("phases"), number("kw").alias("kw"), number("kvar").alias("kvar"), number("kv").alias("kv"), F.coalesce(value("yearly"), value("daily"), value("duty")).alias("profile_id"))


def profile_elements(records: DataFrame) -> DataFrame:
    """(name, npts, interval_h, values, p_file): values, or the file they are in."""
    given = F.coalesce(value("pmult"), value("mult"))
    file = F.regexp_extract(given, r"(?i)^file\s*=\s*(.*)$", 1)
    hours = F.coalesce(number("interval"), number("minterval") / 60, number("sinterval") / 3600)
    values = F.when(file == "", F.transform(listed(given), lambda x: x.try_cast("double")))
    return elements(records, "loadshape").select("name", number("npts").cast("int").alias("npts"), hours.alias("interval_h"), values.alias("values"), F.nullif(file, F.lit("")).alias("p_file"))
