"""Program files: the intermediate representation as JSON, and the small files beside it.

A module is one JSON document with nested functions and statements.  It is read with
an explicit schema, never inferred, and flattened to one row per statement.
"""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLASS = "struct<class:string,size:bigint>"
SIGNATURE = f"struct<ret:{CLASS},params:array<{CLASS}>,vararg:boolean,cc:string>"
LOCATION = "struct<file:string,line:int,col:int,dir:string,filename:string>"
STATEMENT = (
    "struct<kind:string,dest:string,ty:string,sources:array<string>,op:string,lhs:string,rhs:string,address:string,value:string,access_bytes:bigint,"
    "base:string,byte_off:bigint,lane:struct<modulus:bigint,residue:bigint>,source:string,integer_bits:int,pointer_bits:int,pointer_address_space:int,comparison_only:boolean,"
    "position:struct<kind:string,index:int>,list:string,dst:string,src:string,bytes:bigint,proven_fnptr_init:boolean,operands:array<string>,results:array<string>,reason:string,"
    f"callee:string,operand:string,sig:{SIGNATURE},args:array<string>,global:string,access:string,volatile:boolean,loc:{LOCATION}>"
)
FUNCTION = f"struct<key:string,sig:{SIGNATURE},param_names:array<string>,file:string,line:int,external:boolean,exported:boolean,address_taken:boolean,body:array<{STATEMENT}>>"
GLOBAL = "struct<key:string,file:string,line:int,is_const:boolean,mutable:boolean,exported:boolean,is_definition:boolean,linkage:string,type_spelling:string,source_atomic:boolean,size_bits:bigint,align_bits:bigint,path_error:string,scalar_class:string,signed:boolean,initializer_ir:string,init_refs:array<string>>"
BOUNDARY = f"struct<id:int,block:int,ordinal:int,loc:{LOCATION},insertable:boolean,stmt_indices:array<int>,successors:array<int>,predecessors:array<int>>"
LOWERING = f"struct<semantic_value_kinds:map<string,string>,statement_cfgs:map<string,struct<entry:int,source_mapping_available:boolean,boundaries:array<{BOUNDARY}>>>>"
TARGET = "struct<triple:string,data_layout:string,supported_atomic_widths:array<bigint>>"
PIR = f"module string, source string, target {TARGET}, lowering {LOWERING}, functions array<{FUNCTION}>, globals array<{GLOBAL}>, global_init array<{STATEMENT}>"


def read_pir(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Modules, a row each.  ``multiline`` for pretty-printed files, which are read whole."""
    return spark.read.schema(PIR).option("multiLine", multiline).option("mode", "FAILFAST").json(path)


def functions(pir: DataFrame) -> DataFrame:
    """One row per function, with the defaults that files may leave out."""
    f = pir.select("module", F.posexplode("functions").alias("func", "f"))
    bool_ = lambda c: F.coalesce(F.col(f"f.{c}"), F.lit(False)).alias(c)
    return f.select("module", "func", F.col("f.key").alias("key"), F.col("f.sig").alias("sig"), F.col("f.param_names").alias("param_names"), bool_("external"), bool_("exported"), bool_("address_taken"), F.col("f.file").alias("file"), F.col("f.line").alias("line"))


def globals_(pir: DataFrame) -> DataFrame:
    """One row per global; absent flags mean mutable and defined."""
    g = pir.select("module", F.posexplode("globals").alias("gvar", "g"))
    flag = lambda c, d: F.coalesce(F.col(f"g.{c}"), F.lit(d)).alias(c)
    return g.select("module", "gvar", F.col("g.key").alias("key"), flag("is_const", False), flag("mutable", True), flag("exported", False), flag("is_definition", True), F.col("g.size_bits").alias("size_bits"), F.col("g.init_refs").alias("init_refs"), F.col("g.initializer_ir").alias("initializer_ir"))


def statements(pir: DataFrame) -> DataFrame:
    """One row per statement: module, func (key), idx and the statement's fields."""
    body = pir.select("module", F.explode("functions").alias("f")).select("module", F.col("f.key").alias("func"), F.posexplode("f.body").alias("idx", "s"))
    init = pir.select("module", F.lit("").alias("func"), F.posexplode("global_init").alias("idx", "s"))
    return body.union(init).select("module", "func", "idx", "s.*")


def value_kinds(pir: DataFrame) -> DataFrame:
    """(module, value, vkind): what values may hold, by their spelling; others are unknown."""
    return pir.select("module", F.explode("lowering.semantic_value_kinds").alias("value", "vkind"))


def boundaries(pir: DataFrame) -> DataFrame:
    """One row per boundary of the statement graphs: module, func, entry and the boundary's fields."""
    cfg = pir.select("module", F.explode("lowering.statement_cfgs").alias("func", "c"))
    return cfg.select("module", "func", F.col("c.entry").alias("entry"), F.explode("c.boundaries").alias("b")).select("module", "func", "entry", "b.*")


def odd_spaces(pir: DataFrame) -> DataFrame:
    """(module, targeted, odd): whether a module names its target, and the address spaces whose
    pointers are not plain integers."""
    parts = F.filter(F.split(F.coalesce("target.data_layout", F.lit("")), "-"), lambda p: p.startswith("ni:"))
    spaces = F.transform(F.flatten(F.transform(parts, lambda p: F.split(F.substring(p, 4, 1000), ":"))), lambda x: x.cast("int"))
    return pir.select("module", F.col("target").isNotNull().alias("targeted"), spaces.alias("odd"))


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """(key): a symbol per line; blank lines and what follows # are left out."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    return spark.read.text(path).select(F.regexp_replace(line, "^@", "").alias("key")).where("key <> ''").distinct()


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind, arg, pointee): functions that take an entry function as an argument."""
    schema = "name string, kind string, entry struct<arg:int,pointee_of_arg:int>"
    r = spark.read.schema(schema).option("multiLine", True).json(path)
    return r.select("name", "kind", F.coalesce("entry.arg", "entry.pointee_of_arg").alias("arg"), F.col("entry.pointee_of_arg").isNotNull().alias("pointee"))


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """(caller, idx, target) of a dynamic run; an unresolved target (?) is null."""
    t = spark.read.schema("caller string, idx int, target string").option("sep", "\t").csv(path)
    return t.select("caller", "idx", F.when(F.col("target") != "?", F.col("target")).alias("target"))


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """(scope, key, strategy, accept_risk, reason) of a TOML file of pins, parsed on the driver."""
    text = "\n".join(r[0] for r in spark.read.option("lineSep", "\n").text(path).toLocalIterator())
    found = tomllib.loads(text)
    rows = [(scope, key, pin.get("strategy"), bool(pin.get("accept_risk", False)), pin.get("reason")) for scope in ("global", "group") for key, pin in found.get(scope, {}).items()]
    rows += [("cascade", str(i), s, False, None) for i, s in enumerate(found.get("cascade", {}).get("order", []))]
    schema = T.StructType([T.StructField(n, T.BooleanType() if n == "accept_risk" else T.StringType()) for n in ("scope", "key", "strategy", "accept_risk", "reason")])
    return spark.createDataFrame(rows, schema)
