"""Identity and path functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_repo_name(x: Column | str) -> Column:
    return F.regexp_replace(F.translate(_c(x), "\\", "/"), "^/+|/+$", "")


def normalize_relative_path(x: Column | str) -> Column:
    """Slashes forward, empty parts and '.' parts left out, leading characters of the set './' stripped."""
    parts = F.filter(F.split(F.translate(_c(x), "\\", "/"), "/"), lambda p: ~p.isin("", "."))
    return F.regexp_replace(F.array_join(parts, "/"), "^[./]+", "")


def resolve_relative_path(base_dir: Column | str, spec: Column | str) -> Column:
    """spec against a directory, '.' and '..' parts resolved; '..' above the root is dropped."""
    parts = F.filter(F.split(F.concat_ws("/", _c(base_dir), _c(spec)), "/"), lambda p: ~p.isin("", "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.array_join(walked, "/")


def project_id(repo: Column | str) -> Column:
    return F.concat(F.lit("project:"), F.regexp_replace(normalize_repo_name(repo), "[^a-zA-Z0-9_.-]+", "_"))


def file_uri(repo: Column | str, path: Column | str) -> Column:
    return F.concat(F.lit("repo://"), normalize_repo_name(repo), F.lit("/"), normalize_relative_path(path))


def symbol_id(uri: Column | str, name: Column | str, kind: Column | str, line: Column | str) -> Column:
    return F.concat(_c(uri), F.lit("#"), F.concat_ws(":", _c(name), _c(kind), _c(line).cast("string")))


def module_spec(spec: Column | str) -> Column:
    """The package root of an import: '@a/b/c' gives '@a/b', 'a/b' gives 'a'; blanks and quotes around
    it are stripped, and a query is cut off."""
    bare = F.regexp_replace(F.regexp_replace(_c(spec), "(?U)^\\s+|\\s+$", ""), "^['\"]+|['\"]+$", "")
    s = F.substring_index(bare, "?", 1)
    scoped = F.regexp_extract(s, "^(@[^/]*(?:/[^/]*)?)", 1)
    return F.concat(F.lit("module:"), F.when(s.startswith("@"), scoped).otherwise(F.substring_index(s, "/", 1)))


def split_identifier(x: Column | str) -> Column:
    spaced = F.regexp_replace(F.translate(_c(x), "_-", "  "), "([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(spaced, "\\s+", " "))


def entity_id(category: Column | str, name: Column | str) -> Column:
    return F.concat(F.lit("entity:"), F.substring(F.sha2(F.lower(F.concat_ws(":", _c(category), _c(name))), 256), 1, 16))


def record_id(*parts: Column | str) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *(_c(p) for p in parts)), 256), 1, 32)


def slug(x: Column | str) -> Column:
    dashed = F.regexp_replace(F.lower(_c(x)), "(?U)[^\\p{Alnum}]", "-")
    return F.replace(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("--"), F.lit("-"))


def is_test_path(path: Column | str) -> Column:
    return _c(path).rlike(r"(?i)(^|/)(tests?|__tests__)/|_test\.|\.test\.|\.spec\.")


def snippet(text: Column | str, n: int = 240) -> Column:
    """The first n characters with blanks collapsed and everything outside ASCII as backslash escapes."""
    short = F.trim(F.regexp_replace(F.substring(_c(text), 1, n), "(?U)\\s+", " "))

    def escaped(c: Column) -> Column:
        code = F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")
        digits = lambda width: F.lpad(F.lower(F.hex(code)), width, "0")
        return F.when(code < 128, c).when(code < 256, F.concat(F.lit("\\x"), digits(2))).when(code < 65536, F.concat(F.lit("\\u"), digits(4))).otherwise(F.concat(F.lit("\\U"), digits(8)))

    return F.when(short.rlike("[^\\x00-\\x7F]"), F.array_join(F.transform(F.split(short, ""), escaped), "")).otherwise(short)


def glob_pattern(glob: str) -> str:
    """An anchored regular expression for a file glob whose '*' also matches '/'."""
    import fnmatch

    return fnmatch.translate(glob).replace("\\Z", "\\z")


def glob_regex(glob: Column | str) -> Column:
    """The anchored regular expression of a glob: * (any characters, / too), ?, and classes such as [a-c] and
    [!x], where a bracket that isn't closed stands for itself."""
    parts = F.regexp_extract_all(_c(glob), F.lit(r"(?s)(\[!?\]?[^\]]*\]|.)"), F.lit(1))
    plain = lambda x: F.regexp_replace(x, r"([.^$+(){}\[\]|\\*?&-])", r"\\$1")

    def one(x: Column) -> Column:
        negated = x.startswith("[!")
        inner = F.substring(x, F.when(negated, 3).otherwise(2), F.length(x) - F.when(negated, 3).otherwise(2))
        group = F.concat(F.when(negated, "[^").otherwise("["), F.regexp_replace(inner, r"([\\\[\]^&])", r"\\$1"), F.lit("]"))
        return F.when(x == "*", ".*").when(x == "?", ".").when(x.startswith("[") & (F.length(x) > 2), group).otherwise(plain(x))

    return F.concat(F.lit("(?s)^"), F.array_join(F.transform(parts, one), ""), F.lit(r"\z"))



def infer_edge_provenance(edge_type: Column | str) -> Column:
    return F.when(_c(edge_type).isin("DEFINES", "REFERENCES", "IMPLEMENTS", "CROSS_REFERENCE"), "scip").otherwise("tree_sitter")


def ratio(n: Column, d: Column) -> Column:
    """n / d as double, 0 where d is 0."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def repo_name_of(url: Column | str) -> Column:
    """owner/name of a repository's address or short name; null if it is neither."""
    bare = F.trim(_c(url))
    named = F.regexp_extract(bare, r"(?i)github\.com[:/]([^/\s]+/[^/\s.]+)", 1)
    short = F.when(named != "", named).otherwise(bare)
    return F.when(short.rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"), short)


def change_key(sha: Column | str, path: Column | str, status: Column | str) -> Column:
    return F.concat_ws("|", _c(sha), _c(path), _c(status))


def source_slice(content: Column | str, start_line: Column, start_col: Column, end_line: Column, end_col: Column) -> Column:
    """The text from one place (line from 1, column from 0) to another, in code points."""
    lines = F.slice(F.split(_c(content), "\n"), start_line, F.greatest(end_line - start_line + 1, F.lit(0)))
    text = F.array_join(lines, "\n")
    last = F.length(F.element_at(lines, -1))
    size = F.length(text) - start_col - F.greatest(last - end_col, F.lit(0))
    return F.substring(text, (start_col + 1).cast("int"), F.greatest(size, F.lit(0)).cast("int"))
