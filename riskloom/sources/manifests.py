"""Manifests and lock files as relations, from the corpus' files and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.sources.corpus import Corpus

_OPERATOR = r"\s*(===?|~=|!=|<=|>=|<|>|@|\^|~)\s*"
SECTIONS = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")
JS_IMPORT = r"(?:import\s+.*?\s+from\s+|require\()\s*['\"](@?[a-zA-Z0-9_.\-/]+)['\"]"


def normalize(name):
    return F.replace(F.lower(F.trim(name)), F.lit("_"), F.lit("-"))


def _not_vendored(df: DataFrame) -> DataFrame:
    return df.where(~F.concat(F.lit("/"), "path").contains("/node_modules/"))


def python_deps(c: Corpus) -> DataFrame:
    rows = c.bare_lines(F.col("name").startswith("requirements") & F.col("name").endswith(".txt")).where((F.col("s") != "") & ~F.col("s").startswith("#"))
    rows = rows.select("path", "line", F.trim(F.substring_index("s", " #", 1)).alias("l")).where(~F.col("l").rlike(r"^(?:-r |--requirement|-c |--constraint)"))
    found = F.col("l").rlike(_OPERATOR)
    name = F.trim(F.when(found, F.regexp_extract("l", rf"^(.*?){_OPERATOR}", 1)).otherwise(F.col("l")))
    # the operator is the first of its kind; of === only == is split off
    spec = F.when(found, F.concat(F.regexp_extract("l", rf"^.*?{_OPERATOR}", 1), F.trim(F.regexp_extract("l", rf"^.*?{_OPERATOR}(.*)$", 2)))).otherwise(F.lit(""))
    rows = rows.select(name.alias("n"), spec.alias("spec"), F.col("path").alias("file_path"), "line").where((F.col("n") != "") & ~F.col("n").rlike(r"^(?:git\+|http://|https://|file:)"))
    return rows.select(normalize(F.col("n")).alias("name"), "spec", "file_path", "line", F.lit("python").alias("ecosystem"))


def _object_items(df: DataFrame, field: str) -> DataFrame:
    """(path, key, value) of the object at a field path of column j (VARIANT)."""
    return df.sparkSession.sql(
        f"SELECT path, key, value FROM (SELECT path, try_variant_get(j, '$.{field}', 'variant') AS o FROM {{df}}) t, LATERAL variant_explode(CASE WHEN schema_of_variant(o) LIKE 'OBJECT%' THEN o END)", df=df
    )


def _json_files(c: Corpus, name: str) -> DataFrame:
    return _not_vendored(c.files.where((F.col("name") == name) & F.col("text").isNotNull())).select("path", F.try_parse_json("text").alias("j")).where(F.schema_of_variant("j").startswith("OBJECT"))


def node_deps(c: Corpus) -> DataFrame:
    j = _json_files(c, "package.json")
    out = None
    for s in SECTIONS:
        part = _object_items(j, s).where(F.schema_of_variant("value") == "STRING")
        part = part.select(normalize(F.col("key")).alias("name"), F.trim(F.variant_get("value", "$", "string")).alias("spec"), F.col("path").alias("file_path"), F.lit(None).cast("long").alias("line"), F.lit("node").alias("ecosystem"))
        out = part if out is None else out.union(part)
    return out


def deps(c: Corpus) -> DataFrame:
    return python_deps(c).unionByName(node_deps(c))


def js_imports():
    """Array of the package names that a script imports, from columns path, name and text; empty for other files."""
    script = F.col("name").rlike(r"\.(?:js|jsx|ts|tsx|mjs|cjs)$") & ~F.concat(F.lit("/"), "path").contains("/node_modules/")
    found = F.filter(F.regexp_extract_all("text", F.lit(JS_IMPORT), F.lit(1)), lambda n: ~n.startswith("."))
    names = F.transform(found, lambda n: F.lower(normalize(F.when(n.startswith("@"), F.substring_index(n, "/", 2)).otherwise(F.substring_index(n, "/", 1)))))
    return F.when(script & F.col("text").isNotNull(), F.array_distinct(names)).otherwise(F.array().cast("array<string>"))


#: Files whose whole text the relations above need.
MANIFEST = "(startswith(name, 'requirements') AND endswith(name, '.txt')) OR name IN ('package.json', 'package-lock.json', 'poetry.lock') OR path = 'pyproject.toml'"


def _squeeze(x):
    return F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def project_licenses(c: Corpus) -> DataFrame:
    j = _json_files(c, "package.json")
    own = j.where(F.schema_of_variant(F.try_variant_get("j", "$.license", "variant")) == "STRING").select("path", F.try_variant_get("j", "$.license", "string").alias("l"))
    many = c.spark.sql("SELECT path, value FROM (SELECT path, try_variant_get(j, '$.licenses', 'variant') AS o FROM {df}) t, LATERAL variant_explode(CASE WHEN schema_of_variant(o) LIKE 'ARRAY%' THEN o END)", df=j)
    many = many.where(F.schema_of_variant("value").startswith("OBJECT")).select("path", F.coalesce(F.nullif(F.try_variant_get("value", "$.type", "string"), F.lit("")), F.try_variant_get("value", "$.license", "string")).alias("l"))
    toml = c.files.where(F.col("path") == "pyproject.toml")
    inline = toml.select("path", F.explode(F.regexp_extract_all("text_lossy", F.lit(r"(?m)^\s*license\s*=\s*['\"]([^'\"]+)['\"]\s*$"), F.lit(1))).alias("l"))
    text = toml.select("path", F.explode(F.regexp_extract_all("text_lossy", F.lit(r"(?m)^\s*license\s*=\s*\{[^}]*text\s*=\s*['\"]([^'\"]+)['\"][^}]*\}\s*$"), F.lit(1))).alias("l"))
    rows = own.union(many).union(inline).union(text)
    return rows.select(F.col("path").alias("file_path"), _squeeze(F.col("l")).alias("license_expr")).where(F.col("license_expr") != "")


def dep_licenses(c: Corpus) -> DataFrame:
    """(package, license_expr, file_path, line, ord): the first of each (package, licence, file)."""
    j = _json_files(c, "package-lock.json")

    def value(field: str):
        return F.when(F.schema_of_variant(F.try_variant_get("value", f"$.{field}", "variant")) == "STRING", F.try_variant_get("value", f"$.{field}", "string"))

    none = F.lit(None).cast("long")
    packages = _object_items(j, "packages").where(F.schema_of_variant("value").startswith("OBJECT"))
    key_name = F.when(F.col("key").startswith("node_modules/"), F.regexp_extract("key", r"^node_modules/(.*)$", 1))
    packages = packages.select(F.coalesce(F.nullif(F.trim(value("name")), F.lit("")), key_name).alias("p"), value("license").alias("l"), "path", none.alias("line"), F.lit(0).alias("part"))
    flat = _object_items(j, "dependencies").where(F.schema_of_variant("value").startswith("OBJECT"))
    flat = flat.select(F.col("key").alias("p"), value("license").alias("l"), "path", none.alias("line"), F.lit(1).alias("part"))
    # poetry.lock: the name in force carries forward inside its package block
    lock = c.bare_lines(F.col("name") == "poetry.lock", lossy=True)
    by_line = Window.partitionBy("path").orderBy("line")
    lock = lock.withColumn("block", F.sum(F.when(F.col("s") == "[[package]]", 1).otherwise(0)).over(by_line))
    named = F.when(F.col("s").rlike(r'^name\s*=\s*"([^"]+)"\s*$'), F.lower(F.trim(F.regexp_extract("s", r'^name\s*=\s*"([^"]+)"', 1))))
    lock = lock.withColumn("p", F.last(named, ignorenulls=True).over(Window.partitionBy("path", "block").orderBy("line")))
    lock = lock.where(F.col("s").rlike(r'^license\s*=\s*"[^"]*"\s*$')).select("p", F.regexp_extract("s", r'^license\s*=\s*"([^"]*)"', 1).alias("l"), "path", "line", F.lit(2).alias("part"))
    rows = packages.union(flat).union(lock).select(F.lower(F.trim("p")).alias("package"), _squeeze(F.col("l")).alias("license_expr"), F.col("path").alias("file_path"), "line", "part")
    rows = rows.where((F.col("package") != "") & (F.col("license_expr") != ""))
    order = F.struct("part", "file_path", F.coalesce("line", F.lit(0)), "license_expr")
    first = Window.partitionBy("package", F.upper("license_expr"), "file_path").orderBy(order)
    return rows.withColumn("k", F.row_number().over(first)).where("k = 1").select("package", "license_expr", "file_path", "line", order.alias("ord"))
