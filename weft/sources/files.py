"""Source trees as tables: files, symbols, imports, manifests.

A tree is read as a distributed binary scan and decoded in Spark. Symbols and imports come from one
scan of each text that knows nesting, strings and comments (``lexer``), and local imports are resolved by
a join with the files.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import ids
from weft.session import cut
from weft.sources import lexer

#: Languages by suffix, directories that are never read, and suffixes tried for a local import, in
#: order, with index files of a directory (fixed values, but for the index files of .py and the last two scripts).
LANGUAGES = {
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "tsx", "py": "python", "go": "go", "rs": "rust", "java": "java",
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "prisma": "prisma",
}
IGNORED = (
    ".git", ".hg", ".svn", "node_modules", "dist", "build", ".next", ".nuxt", ".turbo", ".cache", ".pytest_cache", ".pytest_tmp", ".mypy_cache", ".ruff_cache", "__pycache__",
    ".venv", ".venv-win", "venv", "env", "ENV", ".tox", ".nox",
)
CANDIDATES = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs", "/index.cjs", "/__init__.py")
def source_files(spark: SparkSession, root: str, repo: str, max_bytes: int | None = None, ignored: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """repo_name, path, language, size, content of every source file below root.

    Foreign suffixes are left out as files are listed. ignored: directories to leave out besides
    IGNORED. Bytes that aren't UTF-8 are dropped. most: an error if there are more files than that.
    """
    suffixes = ",".join(sorted({"".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in x) for x in LANGUAGES}))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{suffixes}}}").load(root)
    base = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/")
    path = F.ltrim(F.substring(base, F.lit(len(root.rstrip("/")) + 1), F.length(base)), F.lit("/"))
    language = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    out = raw.withColumn("rel", path).withColumn("language", language[F.lower(F.substring_index("rel", ".", -1))]).where("language IS NOT NULL")
    out = out.where(~F.arrays_overlap(F.split("rel", "/"), F.array(*(F.lit(x) for x in (*IGNORED, *ignored)))))
    if max_bytes is not None:
        out = out.where(F.col("length") <= max_bytes)
    if most is not None and (n := out.select("path").limit(most + 1).count()) > most:
        raise ValueError(f"{n} source files or more, {most} allowed")
    text = F.col("content").cast("string")
    # the replacement character stands for bytes that aren't UTF-8; texts that hold it themselves are valid
    clean = F.when(F.is_valid_utf8(text), text).otherwise(F.regexp_replace(F.make_valid_utf8(text), "\uFFFD", ""))
    return out.select(F.lit(repo).alias("repo_name"), ids.normalize_relative_path("rel").alias("path"), "language", F.col("length").alias("size"), clean.alias("content"))


def file_nodes(files: DataFrame) -> DataFrame:
    return files.select(ids.file_uri("repo_name", "path").alias("node_id"), F.lit("file").alias("layer"), F.lit("file").alias("kind"), F.col("path").alias("label"), "repo_name", F.col("path").alias("file_path"))


_SCANNED = "repo_name string, path string, language string, name string, kind string, start_line int, start_col int, end_line int, end_col int, parent string, parent_kind string, value string, content string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _SCANNED.split(", ")]
    for batch in batches:
        for repo, path, language, text in zip(*(batch.column(c).to_pylist() for c in ("repo_name", "path", "language", "content")), strict=True):
            text = text or ""
            feeds = [m.start() for m in re.finditer("\n", text)]

            def place(at: int, feeds: list[int] = feeds) -> tuple[int, int]:
                line = bisect.bisect_left(feeds, at)
                return line + 1, at - (feeds[line - 1] + 1 if line else 0) + 1

            found = lexer.symbols(text, language)
            rows = [(s.name, s.kind, *place(s.start), *place(s.end), *((found[q].name, found[q].kind) if q >= 0 else (None, None)), s.value, text[s.start : s.end]) for s, q in zip(found, lexer.parents(found), strict=True)]
            rows += [(spec, "import", *[None] * 8) for spec in lexer.imports(text, language)]
            if rows:
                columns = [[repo] * len(rows), [path] * len(rows), [language] * len(rows), *map(list, zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n.endswith(("_line", "_col")) else pa.string()) for n, c in zip(names, columns, strict=True)], names=names)


def scanned(files: DataFrame) -> DataFrame:
    """All that one scan of each text finds: its symbols with ranges (lines and columns from 1, the end
    exclusive), the symbol around each, what a variable is set to, and their text; and its imports
    (kind ``import``, the name being what is imported). Nothing is taken from comments or strings."""
    return files.select("repo_name", "path", "language", "content").mapInArrow(_scan, _SCANNED)


def _kind_and_node():
    """The refined kind and the id of what scanned finds; imports keep their kind."""
    plain = F.col("kind").isin("route_handler", "db_model", "import")
    kind = F.when(plain, F.col("kind")).otherwise(refined_kind(F.col("name"), F.col("kind"), F.col("path"), F.col("content"), F.col("value")))
    return kind, ids.symbol_id(ids.file_uri("repo_name", "path"), "name", "kind", "start_line")


def code_symbols(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The symbols of files as nodes: node_id, label, kind (refined by name, path and text), repo_name, path,
    language, start_line, start_col, end_line, end_col, parent, content. found: scanned(files), if it is
    at hand."""
    own = (scanned(files) if found is None else found).where("kind <> 'import'")
    kind, node = _kind_and_node()
    own = own.withColumn("kind", kind)
    return own.select(node.alias("node_id"), F.col("name").alias("label"), "kind", "repo_name", "path", "language", "start_line", "start_col", "end_line", "end_col", "parent", "content")


def ingest(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of source files: a surface for each file, its symbols (or a boundary where a file of
    configuration has none), CONTAINS from projects to files and from files to nodes, and imports.

    Texts are scanned once at once, for what edges need of symbols and imports, which is kept without texts, and
    once more when nodes are used.
    """
    found = scanned(files)
    kind, node = _kind_and_node()
    held = cut(found.withColumn("kind", kind).select("repo_name", "path", "language", "name", "kind", node.alias("node_id")))
    own = held.where("kind <> 'import'")
    code = code_symbols(files, found)
    without = files.join(own.select("repo_name", "path").distinct(), ["repo_name", "path"], "left_anti")
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"))) + 1
    boundary = ids.symbol_id(ids.file_uri("repo_name", "path"), "name", F.lit("config_object"), F.lit(1)).alias("node_id")
    bounds = config_boundaries(without)
    whole = bounds.join(files.select("repo_name", "path", "language", "content"), ["repo_name", "path"])
    whole = whole.select(boundary, F.col("name").alias("label"), F.lit("config_object").alias("kind"), "repo_name", "path", "language", F.lit(1).alias("start_line"), F.lit(1).alias("start_col"), lines.cast("int").alias("end_line"), F.lit(1).alias("end_col"), F.lit(None).cast("string").alias("parent"), "content")
    surfaces = file_surfaces(files).withColumns({"start_col": F.lit(0), "end_col": F.lit(0), "parent": F.lit(None).cast("string")}).select(*code.columns)
    nodes = surfaces.unionByName(code).unionByName(whole)
    place = ["repo_name", "path", "node_id"]
    inside = surfaces.select(*place).unionByName(own.select(*place)).unionByName(whole.select(*place))
    return nodes, contains_edges(files, inside).unionByName(import_edges(files, held))


def symbols(files: DataFrame) -> DataFrame:
    """repo_name, path, name, kind: distinct symbols by the declarations of each language."""
    return scanned(files).where("kind <> 'import'").select("repo_name", "path", "name", "kind").distinct()


def import_specs(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """repo_name, path, language, spec: what each file imports, once each."""
    own = scanned(files) if found is None else found
    return own.where("kind = 'import'").select("repo_name", "path", "language", F.col("name").alias("spec"))


def import_edges(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """DEPENDS_ON_FILE edges for imports that name a file of the repository, else IMPORTS_MODULE.

    Candidate paths of a relative import meet the files in a join; the first that exists is taken, else
    the least path below a folder of that name. found: scanned(files), if it is at hand.
    """
    specs = import_specs(files, found)
    here = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    dots = F.length(F.regexp_extract("spec", r"^(\.*)", 1))
    dotted = F.concat(F.when(dots <= 1, "./").otherwise(F.expr("repeat('../', length(regexp_extract(spec, '^([.]*)', 1)) - 1)")), F.translate(F.regexp_replace("spec", r"^\.+", ""), ".", "/"))
    relative = F.when(F.col("language") == "python", dotted).otherwise(F.col("spec"))
    local = specs.where("spec LIKE '.%'").withColumn("base", ids.resolve_relative_path(here, relative))
    tried = local.select("repo_name", "path", "spec", F.posexplode(F.transform(F.array(*(F.lit(s) for s in CANDIDATES)), lambda s: F.concat("base", s))).alias("ord", "candidate"))
    known = files.select("repo_name", F.col("path").alias("candidate"))
    resolved = tried.join(known, ["repo_name", "candidate"]).groupBy("repo_name", "path", "spec").agg(F.min_by("candidate", "ord").alias("target"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    folders = files.where(F.contains("path", F.lit("/"))).select("repo_name", "path", F.explode(above).alias("base")).groupBy("repo_name", "base").agg(F.min("path").alias("below"))
    within = local.join(folders, ["repo_name", "base"]).select("repo_name", "path", "spec", "below")
    out = specs.join(resolved, ["repo_name", "path", "spec"], "left").join(within, ["repo_name", "path", "spec"], "left").withColumn("target", F.coalesce("target", "below"))
    root = F.when(F.col("language") == "python", F.concat(F.lit("module:"), F.substring_index("spec", ".", 1))).otherwise(ids.module_spec("spec"))
    to = F.coalesce(ids.file_uri("repo_name", "target"), root)
    kind = F.when(F.col("target").isNotNull(), "DEPENDS_ON_FILE").otherwise("IMPORTS_MODULE")
    return out.select(ids.file_uri("repo_name", "path").alias("source_id"), to.alias("target_id"), kind.alias("edge_type"), "repo_name").distinct()


def manifest(files: DataFrame) -> DataFrame:
    return files.select("repo_name", "path", "size", F.sha2("content", 256).alias("sha256"))


def stale(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo_name, path): files whose digest differs between two manifests, or that one of them lacks."""
    o, n = old.select("repo_name", "path", F.col("sha256").alias("o")), new.select("repo_name", "path", F.col("sha256").alias("n"))
    return o.join(n, ["repo_name", "path"], "full").where(~F.col("o").eqNullSafe(F.col("n"))).select("repo_name", "path")


def file_surfaces(files: DataFrame, most: int = 4000) -> DataFrame:
    """A node for each whole file: node_id, kind, label, path, start_line, end_line, content (its first
    ``most`` characters), language, repo_name."""
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"))) + 1
    return files.select(F.concat(F.lit("codefile:"), "path").alias("node_id"), F.lit("file_surface").alias("kind"), F.element_at(F.split("path", "/"), -1).alias("label"), "path", F.lit(1).alias("start_line"), lines.cast("int").alias("end_line"), F.substring("content", 1, most).alias("content"), "language", "repo_name")


def contains_edges(files: DataFrame, code: DataFrame) -> DataFrame:
    """CONTAINS edges from the project to its files and from files to their code (repo_name, path, node_id)."""
    edge = lambda df, source, target: df.select(source.alias("source_id"), target.alias("target_id"), F.lit("CONTAINS").alias("edge_type"), "repo_name")
    own = files.select("repo_name", "path").distinct()
    return edge(own, ids.project_id("repo_name"), ids.file_uri("repo_name", "path")).unionByName(edge(code, ids.file_uri("repo_name", "path"), F.col("node_id")))


def route_handlers(files: DataFrame) -> DataFrame:
    """(repo_name, path, label, start_line): calls such as router.get("/x", () => ...) in scripts, whose second
    argument is a function, labelled by their path."""
    return scanned(files).where("kind = 'route_handler'").select("repo_name", "path", F.col("name").alias("label"), "start_line")


def schema_models(files: DataFrame) -> DataFrame:
    """(repo_name, path, name, start_line, end_line): models of schema files, to the line whose braces close them."""
    return scanned(files).where("kind = 'db_model'").select("repo_name", "path", "name", "start_line", "end_line")


def refined_kind(name, kind, path, content, value=None):
    """The architectural kind of a symbol by its name, path and text; kind where no rule applies. value: the
    kind of expression that a variable is set to."""
    n, p, c = F.lower(name), F.lower(path), F.lower(content)
    plain = kind.isin("function", "variable")
    shaped = kind == "function" if value is None else value.isin("object", "call") | (kind == "function")
    rules = (
        ("react_hook", name.rlike("^use[A-Z0-9_]") & path.rlike(r"\.(tsx?|jsx?)$")),
        ("middleware", n.contains("middleware") | (n.rlike("(guard|handler)$") & p.contains("middleware")) | (p.rlike("(middleware|guard)s?/") & plain)),
        ("config_object", (n.rlike("config|env|schema") & shaped) | (p.rlike("/(config|env|schema)") & plain)),
        ("service_boundary", n.rlike("(service|repository|repo|client|adapter|provider)$") | p.rlike("/(services?|repositories|adapters|providers)/") | c.rlike(r"new elysia\(|new express\(|hono<|router\(")),
    )
    return F.coalesce(*(F.when(hit, F.lit(to)) for to, hit in rules), kind)


def config_boundaries(files: DataFrame) -> DataFrame:
    """(repo_name, path, name): files that export a configuration, with a name made from their stem."""
    low = F.lower("content")
    hit = F.lower("path").contains("config") & low.contains("export default") & low.rlike(r"(?U)\b(defineconfig|config|env|schema|database|datasource)\b")
    last = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(last, r"\.[^.]*$", ""), "[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")
    return files.where(hit).select("repo_name", "path", F.when(stem == "", "file_config").otherwise(stem).alias("name"))
