"""Links between tests, interface descriptions and source files.

files: path, content. Edges: source_id, target_id, edge_kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators import patterns

#: Names of test files, path parts of route files, verbs of an interface description, keys of a template
#: that are tried (fixed values).
TESTS = r"(\.test\.tsx?|\.spec\.tsx?|_test\.go|\.test\.mjs)$"
ROUTES = r"(^|/)routes/.*\.ts$|route[^/]*\.ts$"
VERBS = ("GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD")
KEYS = 3


def test_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").rlike(TESTS)).select("path").distinct()


def tests_to_sources(files: DataFrame) -> DataFrame:
    """TESTS edges to the file beside a test with its name less the mark of a test, else TESTS_HEURISTIC
    edges to the first file (by path) anywhere with that stem that is no test itself."""
    tests = test_files(files)
    plain = F.regexp_replace("path", r"(\.test|\.spec|_test)(\.[a-z]+)$", "$2")
    known = files.select("path").distinct()
    beside = tests.withColumn("plain", plain).join(known.withColumnRenamed("path", "plain"), "plain", "left_semi").select("path", F.col("plain").alias("target"), F.lit("TESTS").alias("edge_kind"))
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.ts$", "")
    sources = known.where(F.col("path").endswith(".ts") & ~F.col("path").rlike(r"\.(test|spec)\.|_test\.|node_modules")).groupBy(stem(F.col("path")).alias("stem")).agg(F.min("path").alias("target"))
    left = tests.join(beside.select("path"), "path", "left_anti").withColumn("stem", F.regexp_replace(F.element_at(F.split(plain, "/"), -1), r"\.[a-z]+$", ""))
    guessed = left.join(sources, "stem").select("path", "target", F.lit("TESTS_HEURISTIC").alias("edge_kind"))
    both = beside.unionByName(guessed)
    return both.select(F.concat(F.lit("test:"), "path").alias("source_id"), F.concat(F.lit("codefile:"), "target").alias("target_id"), "edge_kind")


def openapi_operations(files: DataFrame) -> DataFrame:
    """(spec, method, template, operation_id) of every operation in files named openapi.json; files that
    aren't JSON have none."""
    specs = files.where(F.col("path").rlike(r"(^|/)openapi\.json$"))
    paths = F.from_json(F.get_json_object("content", "$.paths"), "map<string,string>")
    each = specs.select(F.col("path").alias("spec"), F.explode(paths).alias("template", "methods"))
    each = each.select("spec", "template", F.explode(F.from_json("methods", "map<string,string>")).alias("method", "operation"))
    return each.where(F.upper("method").isin(*VERBS)).select("spec", F.upper("method").alias("method"), "template", F.coalesce(F.get_json_object("operation", "$.operationId"), F.lit("")).alias("operation_id"))


def operations_to_routes(operations: DataFrame, files: DataFrame) -> DataFrame:
    """(spec, method, template, target): for each operation the first route file, by path, whose text holds
    its template or one of its first three words of more than two letters. All templates and words are
    looked for in one pass over the route files."""
    keys = F.filter(F.split(F.translate(F.lower("template"), "{}", ""), "/"), lambda k: F.length(k) > 2)
    ops = operations.select("spec", "method", "template").distinct()
    wanted = ops.select("*", F.explode(F.array_distinct(F.concat(F.array(F.lower("template")), F.slice(keys, 1, KEYS)))).alias("pattern"))
    routes = files.where(F.col("path").rlike(ROUTES)).select("path", F.lower("content").alias("text"))
    first = patterns.occurrences(routes, wanted, ["path"]).groupBy("pattern").agg(F.min("path").alias("target"))
    return wanted.join(first, "pattern").groupBy("spec", "method", "template").agg(F.min("target").alias("target"))


def openapi_edges(met: DataFrame) -> DataFrame:
    return met.select(F.concat(F.lit("spec:"), "spec").alias("source_id"), F.concat(F.lit("codefile:"), "target").alias("target_id"), F.concat(F.lit("OPENAPI_"), "method").alias("edge_kind")).distinct()


def flow_hints(operations: DataFrame, met: DataFrame, most: int = 40) -> DataFrame:
    """(spec, method, template, target): the first operations of each description with their route file,
    null where none was found."""
    first = operations.withColumn("r", F.row_number().over(Window.partitionBy("spec").orderBy("template", "method"))).where(F.col("r") <= most)
    return first.select("spec", "method", "template").join(met, ["spec", "method", "template"], "left")


def code_files(edges: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(node_id, path): targets codefile:<path> that are no nodes yet but exist as files."""
    wanted = edges.where(F.col("target_id").startswith("codefile:")).select(F.col("target_id").alias("node_id")).distinct()
    lost = wanted.join(nodes.select("node_id"), "node_id", "left_anti").withColumn("path", F.expr("substring(node_id, 10)"))
    return lost.join(files.select("path").distinct(), "path", "left_semi").select("node_id", "path")


def infra_files(files: DataFrame) -> DataFrame:
    """(path, kind): Terraform and Helm files outside of node_modules and .git."""
    kind = F.when(F.col("path").endswith(".tf"), "terraform").when(F.col("path").rlike(r"\.ya?ml$"), "helm_yaml")
    return files.where(~F.col("path").rlike(r"node_modules|\.git")).select("path", kind.alias("kind")).where("kind IS NOT NULL")
