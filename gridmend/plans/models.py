"""Queries over distribution models that are written as text files, with records over several lines, and read in small splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import elements
from ..operators.scratch import scratch_path
from ..sources.model_files import ModelFiles
from .catalog import query
from .views import Tables

R = F.round


def read_back(t: Tables, lines: DataFrame, kinds: str = "") -> DataFrame:
    """The records of text ``lines`` (value), by way of files that are cut into splits of 4 KB."""
    path = scratch_path(t.spark, "model")
    lines.write.text(path)
    t.spark.dataSource.register(ModelFiles)
    return t.spark.read.format("model_files").option("split_bytes", 4096).option("classes", kinds).load(path)


def said(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)).alias("value")


@query("B05 S14 (transformers by winding)", """select 't' || s_suppkey as name, 2 as windings, 3 as phases, cast(s_suppkey % 7 as double) as xhl, w as winding, case w when 1 then 'hv' else 'lv' end || s_nationkey as bus, case w when 1 then 69.0 else 12.47 end as kv, cast(1000 + s_suppkey % 9 * w as double) as kva,
 case w when 1 then 'delta' else 'wye' end as conn from supplier, (values (1), (2)) x(w)""")
def model_transformers(t: Tables) -> DataFrame:
    """Windings one after the other with continuation lines, or as lists; each told twice, the last time right."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    kva = lambda w: 1000 + k % 9 * w
    single = said("New Transformer.T", k, " phases=3 windings=2 XHL=", k % 7, " ! a comment with wdg=9\n~ wdg=1 bus=HV", n, ".1.2.3 kV=69 kVA=", kva(1), " conn=Delta // more\n\n  ~ wdg=2 bus=\"LV", n, "\" kV=12.47\nmore kva=1 kva=", kva(2), " conn=wye")
    whole = said("new object=transformer.t", k, " windings=2\n~ phases=3 buses=[HV", n, ".1.2.3, LV", n, "] kvs=(69 12.47)\n! between\n~ kvas=[", kva(1), " ", kva(2), "] conns=(delta wye) xhl = ", k % 7)
    first = said("New Transformer.t", k, " windings=3 bus=wrong")
    rows = t.supplier.select(first.alias("a"), F.when(k % 2 == 0, whole).otherwise(single).alias("b"))
    x = elements.transformer_windings(read_back(t, rows.select(F.concat_ws("\n", "a", "b").alias("value")), "transformer"))
    return x.select("name", "windings", "phases", "xhl", "winding", "bus", "kv", "kva", "conn")


@query("B05 (switches)", """select 'l' || n_nationkey as name, 'a' || n_nationkey as bus1, 'b' || n_regionkey as bus2, case when n_nationkey % 3 = 0 then 'open' else 'closed' end as status from nation where n_nationkey % 2 = 0""")
def model_switches(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    line = said("New Line.L", k, " bus1=A", k, ".1.2\n~ bus2=b", F.col("n_regionkey"), " switch=", F.when(k % 2 == 0, "y").otherwise("n"), "\n~ enabled=", F.when(k % 3 == 0, "False").otherwise("yes"))
    return elements.switch_elements(read_back(t, t.nation.select(line)))


@query("B05 F22 (loads)", """select 'c' || c_custkey as name, 'n' || c_nationkey as bus, case when c_custkey % 2 = 0 then 3 else 2 end as phases, cast(c_custkey % 50 as double) / 4 as kw, cast(case when c_custkey % 5 > 0 then c_custkey % 11 end as double) as kvar, 12.47::double as kv,
 case c_custkey % 3 when 0 then 'year' || c_custkey % 7 when 1 then 'day' end as profile_id from customer""")
def model_loads(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    nodes = F.when(k % 2 == 0, " bus1=N").otherwise(" phases=2 bus1=n")
    profile = F.when(k % 3 == 0, F.concat(F.lit(" daily=other yearly=year"), (k % 7).cast("string"))).when(k % 3 == 1, " Daily=day").otherwise("")
    line = said("New Load.C", k, nodes, F.col("c_nationkey"), F.when(k % 2 == 0, ".1.2.3").otherwise(""), " kV=12.47\n~ kW=", k % 50 / 4, F.when(k % 5 > 0, F.concat(F.lit(" kvar="), (k % 11).cast("string"))).otherwise(""), profile)
    return elements.load_elements(read_back(t, t.customer.select(line), "load"))


@query("B05 S14 (profiles)", """select 'p' || p_partkey as name, 4 as npts, 0.25::double as interval_h, case when p_partkey % 4 = 0 then 'file' || p_partkey || '.csv' end as p_file, case when p_partkey % 4 > 0 then cast(p_size + p_partkey % 3 as double) + 0.5 end as total from part""")
def model_profiles(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    values = F.when(k % 4 == 0, F.concat(F.lit("(file=file"), k.cast("string"), F.lit(".csv)"))).otherwise(F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit(" "), (k % 3).cast("string"), F.lit(", 0.5 0]")))
    unit = F.when(k % 3 == 0, " interval=0.25").when(k % 3 == 1, " minterval=15").otherwise(" sinterval=900")
    x = elements.profile_elements(read_back(t, t.part.select(said("New LoadShape.P", k, " npts=4\n~", unit, "\n~ ", F.when(k % 2 == 0, "mult=").otherwise("Pmult="), values))))
    return x.select("name", "npts", "interval_h", "p_file", F.when(F.col("values").isNotNull(), F.aggregate("values", F.lit(0.0), lambda a, y: a + y)).alias("total"))
