"""Sources: tables, Parquet, CSV, JSON files and HTTP envelopes, JDBC; typed and read-only."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolith.functions.errors import PlanError

# Names of types in declarations and their Spark names.
TYPES = {
    "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float32": "float", "float64": "double",
    "string": "string", "boolean": "boolean", "date": "date", "timestamp": "timestamp_ntz", "json": "string", "binary": "binary",
}


def spark_type(name: str) -> str:
    """A declared type as Spark's, inside arrays, structs and maps too; a leading ! (not null) is dropped."""
    return re.sub(r"[A-Za-z_][A-Za-z_0-9]*(?!\s*:)", lambda m: TYPES.get(m[0], m[0]), name.replace("!", ""))


def ddl(schema: Mapping[str, str]) -> str:
    return ", ".join(f"`{k}` {spark_type(v)}" for k, v in schema.items())


def table(name: str, *, database: str | None = None, columns: Mapping[str, tuple[str, str]] | None = None):
    """A catalog table; columns maps names to (source column, type)."""

    def read(spark: SparkSession) -> DataFrame:
        df = spark.table(f"{database}.{name}" if database else name)
        return df.select(*(F.col(c).cast(spark_type(t)).alias(n) for n, (c, t) in columns.items())) if columns else df

    return read


def parquet(path: str, *, hive_partitioning: bool = True, columns=None):
    def read(spark: SparkSession) -> DataFrame:
        reader = spark.read if hive_partitioning else spark.read.option("recursiveFileLookup", "true")
        df = reader.parquet(path)
        return df.select(*columns) if columns else df

    return read


def csv(path: str, *, schema: Mapping[str, str], header: bool = True, delimiter: str = ","):
    """The schema is required; malformed rows are an error."""

    def read(spark: SparkSession) -> DataFrame:
        return spark.read.schema(ddl(schema)).csv(path, header=header, sep=delimiter, mode="FAILFAST")

    return read


def _json_path(p: str) -> str:
    if p.count("[*]") > 1:
        raise PlanError("json-path-traversal", p)
    return "$" if p in ("", "$") else p if p.startswith("$") else f"$.{p}"


def from_payload(raw: DataFrame, *, schema, records_path=None, field_paths=None) -> DataFrame:
    """Rows of a column ``value`` of JSON text: unpack a record array, apply paths, cast strictly.

    A records_path that is not an array is an error; one ``[*]`` traverses an array.
    """
    paths = {n: (field_paths or {}).get(n, n) for n in schema}
    if records_path is not None:
        found = F.get_json_object("value", _json_path(records_path))
        array = F.from_json(found, "array<string>")
        bad = F.raise_error(F.lit(f"json-records-not-array: {records_path}")).cast("array<string>")
        raw = raw.select(F.explode(F.when(found.isNull() | ~F.startswith(F.ltrim(found), F.lit("[")), bad).otherwise(array)).alias("value"))
    stars = {p.split("[*]")[0] for p in paths.values() if "[*]" in p}
    if len(stars) > 1:
        raise PlanError("json-path-traversal", ", ".join(sorted(stars)))
    if stars:
        inner = F.explode(F.from_json(F.get_json_object("value", _json_path(stars.pop())), "array<string>"))
        raw = raw.select("value", inner.alias("_item"))

    def pick(p):
        if "[*]" in p:
            tail = p.split("[*]", 1)[1].lstrip(".")
            return F.col("_item") if not tail else F.get_json_object("_item", _json_path(tail))
        return F.get_json_object("value", _json_path(p))

    def typed(n, t):
        t = spark_type(t)
        x = pick(paths[n])
        if t.startswith(("array", "struct", "map")):
            return F.from_json(x, t, {"mode": "FAILFAST"}).alias(n)
        return x.cast(t).alias(n)

    return raw.select(*(typed(n, t) for n, t in schema.items()))


def json_source(path: str, *, schema, format="auto", records_path=None, field_paths=None, query_params=None, method="GET", body=None):
    """Files (one record a line, or a whole array or envelope), or an HTTP URL fetched once by the driver."""

    def read(spark: SparkSession, params: Mapping | None = None) -> DataFrame:
        if path.startswith(("http://", "https://")):
            raw = spark.createDataFrame([(fetch(path, bind(query_params, params), method, bind(body, params)),)], "value string")
        else:
            lines = format == "newline_delimited" or (format == "auto" and path.endswith((".jsonl", ".ndjson")))
            raw = spark.read.text(path, wholetext=not lines)
        whole = records_path
        if whole is None and format == "array":
            whole = "$"
        return from_payload(raw, schema=schema, records_path=whole, field_paths=field_paths)

    return read


@dataclass(frozen=True)
class SourceParam:
    """A value that is bound when the source is read."""

    name: str


def source_param(name: str, /) -> SourceParam:
    return SourceParam(name)


def bind(values: Mapping | None, params: Mapping | None):
    out = {}
    for k, v in (values or {}).items():
        if isinstance(v, SourceParam):
            if v.name not in (params or {}):
                raise PlanError("source-param-unbound", v.name)
            v = params[v.name]
        out[k] = v
    return out


def fetch(url: str, query: Mapping, method: str, body: Mapping | None, timeout: int = 30) -> str:
    """One request without redirects."""
    from urllib import parse, request

    class Still(request.HTTPRedirectHandler):
        def redirect_request(self, *a, **k):
            return None

    full = url + ("?" + parse.urlencode(query, doseq=True) if query else "")
    data = json.dumps(body).encode() if method == "POST" else None
    r = request.Request(full, data=data, method=method, headers={"Content-Type": "application/json"} if data else {})
    with request.build_opener(Still).open(r, timeout=timeout) as answer:
        return answer.read().decode()


def jdbc(url: str, name: str, *, properties: Mapping[str, str] | None = None, partition: tuple[str, int, int, int] | None = None):
    """A table over JDBC, read in parallel ranges of (column, low, high, parts)."""

    def read(spark: SparkSession) -> DataFrame:
        r = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**(properties or {}))
        if partition:
            c, low, high, n = partition
            r = r.option("partitionColumn", c).option("lowerBound", low).option("upperBound", high).option("numPartitions", n)
        return r.load()

    return read


# Kinds of datasources, their JDBC subprotocols and usual ports (None: a file, not a server).
KINDS = {
    "duckdb": ("duckdb", None), "sqlite": ("sqlite", None), "trino": ("trino", 8080), "mysql": ("mysql", 3306),
    "postgres": ("postgresql", 5432), "clickhouse": ("clickhouse", 8123),
}


def spec(kind: str, *, host: str | None = None, port: int | None = None, database: str | None = None, path: str | None = None, user: str | None = None, password_env: str | None = None, **options) -> dict:
    """What ``Registry.register`` keeps of a datasource: kind, JDBC address, options; the password's variable, not the password."""
    if kind not in KINDS:
        raise PlanError("datasource-kind-unknown", kind)
    protocol, usual = KINDS[kind]
    if usual is None:
        if host is not None or path is None:
            raise PlanError("datasource-spec", f"{kind} is a file: path is needed, host is not")
        url = f"jdbc:{protocol}:{path}"
    else:
        if path is not None or not host:
            raise PlanError("datasource-spec", f"{kind} is a server: host is needed, path is not")
        url = f"jdbc:{protocol}://{host}:{port or usual}" + (f"/{database}" if database else "")
    more = {"user": user, "password_env": password_env, **{k: str(v) for k, v in options.items()}}
    return {"kind": kind, "url": url, **{k: v for k, v in more.items() if v is not None}}


def engine_profile(spark: SparkSession) -> dict:
    """What plans may count on; one engine runs them all, so nothing is rewritten by dialect."""
    conf = spark.conf
    return {
        "engine": "spark", "version": spark.version, "quote": "`", "strptime": "java", "timezone": conf.get("spark.sql.session.timeZone"),
        "quantile": ("exact", "sketch"), "read_only": True, "timeout": "job_group", "ansi": conf.get("spark.sql.ansi.enabled") == "true",
        "adaptive": conf.get("spark.sql.adaptive.enabled") == "true",
    }


@dataclass
class Registry:
    """Named datasources of a project: kind and options; secrets are named, not kept."""

    specs: dict[str, dict] = field(default_factory=dict)

    def register(self, name: str, kind: str, **options) -> dict:
        if name in self.specs:
            raise PlanError("duplicate-name", name)
        self.specs[name] = {"kind": kind, **options}
        return self.describe(name)

    def remove(self, name: str) -> bool:
        return self.specs.pop(name, None) is not None

    def list(self) -> list[str]:
        return sorted(self.specs)

    def describe(self, name: str) -> dict:
        if name not in self.specs:
            raise PlanError("datasource-unknown", name)
        return {k: ("***" if "password" in k or "secret" in k else v) for k, v in self.specs[name].items()}

    def connect(self, name: str, relation: str, **how):
        """A reader of one table of a datasource; the password is taken from its variable when the reader is made."""
        s = dict(self.specs.get(name) or self.describe(name))
        if "url" not in s:
            raise PlanError("datasource-not-jdbc", name)
        known = {k: v for k, v in s.items() if k not in ("kind", "url", "password_env")}
        if "password_env" in s:
            if s["password_env"] not in os.environ:
                raise PlanError("datasource-password-missing", s["password_env"])
            known["password"] = os.environ[s["password_env"]]
        return jdbc(s["url"], relation, properties=known, **how)

    def test(self, spark: SparkSession, name: str) -> bool:
        """Whether a trivial read works."""
        self.describe(name)
        try:
            (self.connect(name, "(select 1 as x) t")(spark) if "url" in self.specs[name] else spark.sql("select 1")).first()
            return True
        except Exception:  # the test's answer is the failure itself
            return False
