"""Consumption of a symbol index: definitions and references of a project joined with its code nodes.

occurrences: path, ord, symbol, roles, line (from 1), token. info: symbol, display_name, kind. nodes:
node_id, label, path, start_line, end_line, start_col. All of one repository, or with paths that name it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions import ids

#: The role bit of a definition, and kinds of symbols that become nodes of their own (fixed values).
DEFINITION = 1
ADDRESSABLE = ("Class", "Constant", "Constructor", "Enum", "Function", "Interface", "Method", "Module", "Namespace", "StaticMethod", "StaticVariable", "TypeAlias", "Variable")


def cut_out(content: Column, range_: Column, encoding: Column) -> Column:
    """The text of a range (line, start, end) or (line, start, end line, end), lines from 0 and columns in
    code units of the encoding (UTF8, UTF16 or UTF32)."""
    lines = F.split(content, "\n")
    line = lambda i: F.coalesce(F.get(lines, i), F.lit(""))

    def part(text: Column, start: Column, end: Column | None) -> Column:
        def units(name: str, size: int) -> Column:
            raw = F.encode(text, name)
            n = F.octet_length(raw) if end is None else (end - start) * size
            return F.decode(F.substring(raw, (start * size + 1).cast("int"), F.greatest(n, F.lit(0)).cast("int")), name)

        return F.when(encoding == "UTF8", units("UTF-8", 1)).when(encoding == "UTF16", units("UTF-16BE", 2)).otherwise(units("UTF-32", 4))

    at = lambda i: F.get(range_, F.lit(i))
    long = F.size(range_) == 4
    last, end = F.when(long, at(2)).otherwise(at(0)), F.when(long, at(3)).otherwise(at(2))
    middle = F.transform(F.filter(F.sequence(at(0), last), lambda i: (i > at(0)) & (i < last)), lambda i: F.concat(F.lit("\n"), line(i)))
    several = F.concat(part(line(at(0)), at(1), None), F.array_join(middle, ""), F.lit("\n"), part(line(last), F.lit(0), end))
    return F.when(last > at(0), several).otherwise(part(line(at(0)), at(1), end))


def is_definition() -> Column:
    return F.col("roles").bitwiseAND(DEFINITION) != 0


def symbol_information(documents: DataFrame, externals: DataFrame) -> DataFrame:
    """(symbol, display_name, kind): what documents say, or externals where both do."""
    both = documents.select("symbol", "display_name", "kind", F.lit(0).alias("o")).unionByName(externals.select("symbol", "display_name", "kind", F.lit(1).alias("o")))
    return both.groupBy("symbol").agg(F.max_by(F.struct("display_name", "kind"), F.struct("o", "display_name", "kind")).alias("x")).select("symbol", "x.display_name", "x.kind")


def holding(points: DataFrame, spans: DataFrame, on: list[str]) -> DataFrame:
    """(*on, line, best): for every place (*on, line) that a span of the same key holds the best of these, as
    (w, c, i): the narrowest, then by start_col and id.

    A span is cut into the few blocks of 1, 2, 4, ... lines that make it up, and a block keeps its best span only;
    a place looks up the one block of each size around it. So rows grow with spans and places and the
    logarithm of their length, never with pairs of them.
    """
    low, high = F.col("start_line").cast("long"), F.col("end_line").cast("long")
    one = spans.where(low <= high).groupBy(*on, "start_line", "end_line").agg(F.min(F.struct(F.col("start_col").alias("c"), F.col("node_id").alias("i"))).alias("r"))
    one = one.select(*on, low.alias("low"), high.alias("high"), F.struct((F.col("end_line") - F.col("start_line")).alias("w"), "r.c", "r.i").alias("best"))
    longest = one.agg(F.max(F.col("high") - F.col("low") + 1)).first()[0] or 1
    sizes = F.sequence(F.lit(0), F.lit(longest.bit_length() - 1))
    size = lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), j)

    def blocks(j: Column) -> Column:
        first, after = -F.floor(-F.col("low") / size(j)), F.floor((F.col("high") + 1) / size(j))
        block = lambda odd, at: F.when((first < after) & (F.pmod(odd, F.lit(2)) == 1), F.struct(j.alias("size"), at.alias("block")))
        return F.array_compact(F.array(block(first, first), block(after, after - 1)))

    kept = one.select(*on, "best", F.inline(F.flatten(F.transform(sizes, blocks)))).groupBy(*on, "size", "block").agg(F.min("best").alias("best"))
    places = points.select(*on, "line").distinct().withColumn("size", F.explode(sizes)).withColumn("block", F.floor(F.col("line") / size(F.col("size"))))
    return places.join(kept, [*on, "size", "block"]).groupBy(*on, "line").agg(F.min("best").alias("best"))


def definitions(occurrences: DataFrame, nodes: DataFrame, info: DataFrame) -> DataFrame:
    """(path, ord, line, symbol, token, node_id) of every definition: the node of its file with its name, one
    that holds its line before others, the narrowest, then by start_col and id; null if there is none.
    A definition without text has its display name."""
    some = occurrences.where(is_definition() & (F.col("symbol") != "")).join(info.select("symbol", "display_name"), "symbol", "left")
    token = F.when(F.trim(F.coalesce("token", F.lit(""))) != "", F.trim("token")).otherwise(F.coalesce("display_name", F.lit("")))
    some = some.select("path", "ord", "symbol", "line", token.alias("token")).distinct()
    named = nodes.select("path", F.col("label").alias("token"), "node_id", "start_line", "end_line", "start_col")
    rank = F.struct((F.col("end_line") - F.col("start_line")).alias("w"), F.col("start_col").alias("c"), F.col("node_id").alias("i"))
    any_ = named.groupBy("path", "token").agg(F.min(rank)["i"].alias("any"))
    held = holding(some, named, ["path", "token"]).select("path", "token", "line", F.col("best.i").alias("held"))
    out = some.join(held, ["path", "token", "line"], "left").join(any_, ["path", "token"], "left")
    return out.select("path", "ord", "line", "symbol", "token", F.coalesce("held", "any").alias("node_id"))


def resolved(defined: DataFrame) -> DataFrame:
    """(node_id, symbol): the symbol that each matched node is known by: that of its last definition."""
    return defined.where("node_id IS NOT NULL").groupBy("node_id").agg(F.max_by("symbol", F.struct("ord", "line", "symbol")).alias("symbol"))


def renamed(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges with ids replaced by the symbols that nodes resolved to; the old id stays in
    ``original_id``. names: resolved()."""
    new = nodes.join(names, "node_id", "left").withColumn("original_id", F.when(F.col("symbol").isNotNull(), F.col("node_id"))).withColumn("node_id", F.coalesce("symbol", "node_id")).drop("symbol")
    to = names.select(F.col("node_id").alias("target_id"), F.col("symbol").alias("to"))
    return new, edges.join(to, "target_id", "left").withColumn("target_id", F.coalesce("to", "target_id")).drop("to")


def orphans(defined: DataFrame, info: DataFrame) -> DataFrame:
    """(path, symbol, display_name, kind, addressable): definitions without a node, once each; addressable
    ones, which aren't local and have a name and a kind that counts, become nodes."""
    lost = defined.where("node_id IS NULL").groupBy("path", "symbol").agg(F.min("token").alias("token"))
    out = lost.join(info, "symbol", "left")
    name = F.coalesce("display_name", F.lit(""))
    addressable = ~F.col("symbol").startswith("local ") & (name != "") & F.coalesce(F.col("kind").isin(*ADDRESSABLE), F.lit(False))
    return out.select("path", "symbol", name.alias("display_name"), "kind", addressable.alias("addressable"))


def node_kind(kind: Column) -> Column:
    low = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(low.contains("class"), "class").when(low.contains("interface") | low.contains("typealias"), "interface").when(low.contains("method"), "method").when(low.contains("variable") | low.contains("constant"), "variable").otherwise("function")


def language_of(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.endswith(".tsx"), "tsx").when(low.rlike(r"\.([cm]?js|ts|jsx)$"), "typescript").when(low.endswith(".py"), "python").when(low.endswith(".go"), "go").otherwise("text")


def orphan_nodes(lost: DataFrame) -> DataFrame:
    """(node_id, label, kind, path, language) of the addressable orphans."""
    return lost.where("addressable").select(F.col("symbol").alias("node_id"), F.col("display_name").alias("label"), node_kind(F.col("kind")).alias("kind"), "path", language_of(F.col("path")).alias("language"))


def narrowest(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points with node_id: the narrowest span of their path that holds their line, ties by start_col and
    id; null if none does."""
    held = holding(points, spans, ["path"]).select("path", "line", F.col("best.i").alias("node_id"))
    return points.join(held, ["path", "line"], "left").select(*points.columns, "node_id")


def nearest(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points with node_id: the span that narrowest finds, else the nearest of their path (least sum of the
    lines to its start and end, ties by start_col and id); null where the path has none.

    A span beside a place ends before it or starts after it, so of the former that with the greatest
    sum of start and end is nearest, of the latter that with the least: one sorted pass over a path's
    distinct lines each way, and no place meets all spans.
    """
    places = points.select("path", "line").distinct()
    found = narrowest(places, spans)
    rank = lambda sign: F.struct((sign * (F.col("start_line") + F.col("end_line"))).alias("w"), F.col("start_col").alias("c"), F.col("node_id").alias("i"))
    lost = found.where("node_id IS NULL").select("path", "line")
    for side, place, sign in (("before", "end_line", -1), ("after", "start_line", 1)):
        marks = spans.groupBy("path", F.col(place).alias("__at")).agg(F.min(rank(sign)).alias("__r"))
        marks = marks.select("path", "__at", "__r", *(F.lit(None).cast(f.dataType).alias(f.name) for f in lost.schema if f.name != "path"))
        lines = lost.withColumns({"__at": F.col("line"), "__r": F.lit(None).cast(marks.schema["__r"].dataType)})
        order = F.col("__at").asc() if side == "before" else F.col("__at").desc()
        w = Window.partitionBy("path").orderBy(order, F.col("__r").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = marks.unionByName(lines).withColumn(f"__{side}", F.min("__r").over(w)).where("line IS NOT NULL")
        lost = both.drop("__at", "__r")
    # a sum of lines that lies before is negated; with twice the line added, both are distances
    far = lambda side, sign: F.when(F.col(side).isNotNull(), F.struct((F.col(f"{side}.w") + sign * 2 * F.col("line")).alias("w"), F.col(f"{side}.c").alias("c"), F.col(f"{side}.i").alias("i")))
    beside = lost.select("path", "line", F.least(far("__before", 1), far("__after", -1))["i"].alias("node_id"))
    best = found.where("node_id IS NOT NULL").unionByName(beside)
    return points.join(best, ["path", "line"], "left").select(*points.columns, "node_id")


def tokens(occurrences: DataFrame, documents: DataFrame) -> DataFrame:
    """occurrences as the functions here take them (path, ord, symbol, roles, line, token), from rows of an
    index (relative_path, ord, symbol, roles, range, encoding). documents: relative_path, text."""
    texts = documents.groupBy("relative_path").agg(F.max("text").alias("text"))
    encoding = F.when(F.col("encoding").isin("UTF16", "UTF32"), F.col("encoding")).otherwise("UTF8")
    ranged = F.size("range").isin(3, 4)
    token = F.when(ranged, cut_out(F.coalesce("text", F.lit("")), F.col("range"), encoding)).otherwise("")
    line = F.when(F.size("range") > 0, F.get("range", F.lit(0)) + 1).otherwise(1)
    path = ids.normalize_relative_path("relative_path")
    return occurrences.join(texts, "relative_path", "left").select(path.alias("path"), "ord", "symbol", "roles", line.alias("line"), token.alias("token"))


def with_texts(documents: DataFrame, files: DataFrame) -> DataFrame:
    """documents of an index whose text, where it is empty, is that of the file (path, content) they name."""
    known = files.select(F.col("path").alias("__path"), F.col("content").alias("__text"))
    out = documents.withColumn("__path", ids.normalize_relative_path("relative_path")).join(known, "__path", "left")
    return out.withColumn("text", F.when(F.coalesce("text", F.lit("")) == "", F.coalesce("__text", F.lit(""))).otherwise(F.col("text"))).drop("__path", "__text")


def consume(occurrences: DataFrame, information: DataFrame, nodes: DataFrame, edges: DataFrame, foreign: DataFrame, repo: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, orphans): a graph after an index: its nodes known by the symbols that define them,
    addressable definitions without a node as nodes of whole files, and edges DEFINES, IMPLEMENTS,
    CONTAINS of the new nodes, and REFERENCES or CROSS_REFERENCE, once each.

    occurrences: as tokens gives them. information: relative_path (null: external), symbol, display_name,
    kind, relationships. nodes: node_id, label, kind, path, start_line, end_line, start_col. edges:
    source_id, target_id, edge_type. foreign: symbol, repo, node_id, ord.
    """
    own = information.where("relative_path IS NOT NULL")
    info = symbol_information(own, information.where("relative_path IS NULL"))
    defined = definitions(occurrences, nodes, info)
    names = resolved(defined)
    known, rewritten = renamed(nodes, edges, names)
    lost = orphans(defined, info)
    new = orphan_nodes(lost).join(occurrences.groupBy("path").agg(F.max("line").alias("end_line")), "path")
    new = new.select("node_id", "label", "kind", "path", F.lit(1).alias("start_line"), "end_line", F.lit(0).alias("start_col"), F.concat(F.lit("scip-orphan:"), "node_id").alias("original_id"), F.lit("scip_orphan").alias("symbol_source"))
    source = F.when(F.col("original_id").isNull(), "provisional").otherwise("scip")
    all_ = known.select("node_id", "label", "kind", "path", "start_line", "end_line", "start_col", "original_id", source.alias("symbol_source")).unionByName(new)
    edge = lambda df, s, t, kind, by: df.select(s.alias("source_id"), t.alias("target_id"), F.lit(kind).alias("edge_type"), F.lit(None).cast("string").alias("target_repo"), F.lit(by).alias("provenance"))
    to = defined.join(names.select("node_id", F.col("symbol").alias("to")), "node_id")
    implements = own.select("symbol", F.explode("relationships").alias("r")).where("r.is_implementation")
    made = [
        rewritten.select("source_id", "target_id", "edge_type", F.lit(None).cast("string").alias("target_repo"), F.lit("").alias("provenance")),
        edge(to, F.col("symbol"), F.col("to"), "DEFINES", "scip_definition"),
        edge(new, ids.file_uri(F.lit(repo), F.col("path")), F.col("node_id"), "CONTAINS", "scip_orphan_symbol"),
        edge(new, F.col("node_id"), F.col("node_id"), "DEFINES", "scip_orphan_definition"),
        edge(implements, F.col("symbol"), F.col("r.symbol"), "IMPLEMENTS", ""),
        references(occurrences, all_, all_.where("symbol_source <> 'provisional'").select(F.col("node_id").alias("symbol")).distinct(), foreign, repo),
    ]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return all_, out.distinct(), lost


def symbol_index(nodes: DataFrame) -> DataFrame:
    """(symbol, repo, node_id, ord): which nodes (repo, node_id) have a symbol, in the order of repositories."""
    w = Window.partitionBy("symbol").orderBy("repo", "node_id")
    return nodes.where("coalesce(node_id, '') <> ''").select(F.col("node_id").alias("symbol"), "repo", "node_id").distinct().withColumn("ord", F.row_number().over(w) - 1)


def read_symbol_index(spark: SparkSession, path: str) -> DataFrame:
    """The same from a JSON file, a map of symbols to entries or one that has it under ``symbols``; entries
    that aren't lists of nodes are left out."""
    text = spark.read.option("wholetext", "true").text(path).select(F.try_parse_json("value").alias("v"))
    inner = F.coalesce(F.try_variant_get("v", "$.symbols", "map<string,variant>"), F.try_variant_get("v", "$", "map<string,variant>"))
    each = text.select(F.explode(inner).alias("symbol", "x")).where(F.try_variant_get("x", "$[0].node_id", "string").isNotNull())
    entries = F.try_variant_get("x", "$", "array<struct<repo_name:string,node_id:string>>")
    return each.select("symbol", F.posexplode(entries).alias("ord", "e")).select("symbol", F.col("e.repo_name").alias("repo"), "e.node_id", "ord")


def references(occurrences: DataFrame, nodes: DataFrame, known: DataFrame, foreign: DataFrame, repo: str) -> DataFrame:
    """(source_id, target_id, edge_type, target_repo, provenance), once each: from the narrowest node around a
    reference, else the nearest of its file, else the file, to the symbol: one of the repository (known: symbol), else the first entry
    of another repository (foreign: symbol, repo, node_id, ord), else the symbol as it is. A node
    doesn't refer to itself."""
    points = occurrences.where(~is_definition() & (F.col("symbol") != "")).select("path", "line", "symbol").distinct()
    found = nearest(points, nodes.select("path", "node_id", "start_line", "end_line", "start_col"))
    first = foreign.where(F.col("repo") != repo).groupBy("symbol").agg(F.min_by(F.struct("node_id", "repo"), F.struct("ord", "repo", "node_id")).alias("f"))
    out = found.join(known.select("symbol", F.lit(True).alias("own")), "symbol", "left").join(first, "symbol", "left")
    cross = F.col("own").isNull() & F.col("f").isNotNull() & F.col("node_id").isNotNull()
    source = F.coalesce("node_id", F.concat(F.lit(f"repo://{repo}/"), "path"))
    provenance = F.when(F.col("node_id").isNull(), "scip_file_fallback").when(cross, "scip_cross_repo").otherwise("scip_reference_code")
    out = out.select(source.alias("source_id"), F.when(cross, F.col("f.node_id")).otherwise(F.col("symbol")).alias("target_id"), F.when(cross, "CROSS_REFERENCE").otherwise("REFERENCES").alias("edge_type"), F.when(cross, F.col("f.repo")).alias("target_repo"), provenance.alias("provenance"))
    return out.where("source_id <> target_id").distinct()


def document_counts(occurrences: DataFrame) -> DataFrame:
    """(path, occurrences, definitions, references, symbols) of every document."""
    named = F.col("symbol") != ""
    return occurrences.groupBy("path").agg(F.count(F.lit(1)).alias("occurrences"), F.count_if(is_definition() & named).alias("definitions"), F.count_if(~is_definition() & named).alias("references"), F.count_distinct(F.when(named, F.col("symbol"))).alias("symbols"))


def resolution_rate(defined: DataFrame) -> DataFrame:
    """One row: definitions, resolved ones, and their share."""
    out = defined.agg(F.count(F.lit(1)).alias("definitions"), F.count("node_id").alias("resolved"))
    return out.withColumn("rate", F.coalesce(F.try_divide(F.col("resolved").cast("double"), F.col("definitions").cast("double")), F.lit(0.0)))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest of each repository's runs (repo, run, modified)."""
    w = Window.partitionBy("repo").orderBy(F.desc("modified"), F.desc("run"))
    return runs.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
