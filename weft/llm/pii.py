"""Personal data in texts, by DataFrame functions alone.

Regular expressions propose spans, checksum validators (Luhn, mod 97) or ranges confirm them, and
context words in the 48 code points before a span move its score. The base kinds (email, ip, card,
phone) report every confirmed match whatever its score; the further kinds (iban, national_id,
local_phone, secret) need a score of ``threshold`` and must not overlap a base span. A secret is a
value of 16 characters or more, with letters and digits, that is assigned to a name such as token, or
one of a known form of key.

Every pattern is written so that a text is read in linear time: runs are possessive, and a run is
entered only at its start or where the last match ended, which gives the leftmost non-overlapping
matches of the plain pattern. Nothing shuffles; a row needs only itself.

Defined cases: null text counts as empty and has no spans; nulls elsewhere, repeated rows and
extra columns do not matter, but a column named pii is replaced, as are names that start with __pii_;
ties don't arise, as spans of one kind don't overlap; very long texts are read whole; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm._shared import text_or_empty

#: Code points before a span in which context words count.
WINDOW = 48
#: Prefix sums are taken within blocks of this many matches and then over the blocks.
BLOCK = 256


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    hint: str  # a cheap condition that a text must meet before the pattern is tried
    valid: Callable[[Column], Column]
    base: bool
    score: float
    context: str
    gain: float = 0.2
    against: str = ""


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether a string of digits, counted from its right end, passes the Luhn checksum."""
    value = lambda c, i: F.when(i % 2 == 1, c * 2 - F.when(c > 4, 9).otherwise(0)).otherwise(c)
    each = F.transform(F.split(F.reverse(x), ""), lambda c, i: value(c.cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(x: Column) -> Column:
    """Whether an account number of letters and digits leaves 1 when divided by 97."""
    moved = F.split(F.concat(F.substring(x, 5, 64), F.substring(x, 1, 4)), "")
    step = lambda a, c: F.when(c <= "9", (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(moved, F.lit(0), step) == 1


def _between(x: Column, low: int, high: int) -> Column:
    return F.length(x).between(low, high)


RULES = (
    Rule("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), True, 0.9, r"mail|contact|write|\bto\b"),
    Rule("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", lambda m: ~F.exists(F.split(m, r"\."), lambda p: ~p.rlike("^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$")), True, 0.6, r"\bip\b|address|host|server|login", against=r"version|release|section"),
    Rule("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", r"[0-9][ -]?[0-9]", lambda m: luhn(digits(m)), True, 0.8, r"card|visa|credit|payment|account"),
    Rule("phone", r"\+[0-9][ ().0-9-]+[0-9]", "[+][0-9]", lambda m: _between(digits(m), 9, 15), True, 0.7, r"phone|call|tel|mobile|fax"),
    Rule("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", "[A-Z][A-Z][0-9][0-9]", lambda m: _between(F.replace(m, F.lit(" ")), 15, 34) & mod97(F.replace(m, F.lit(" "))), False, 0.8, r"iban|bank|account"),
    Rule("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9][0-9]-[0-9]", lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), False, 0.4, r"ssn|social security|national id|insurance"),
    Rule("local_phone", r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", "[0-9]{3}[ .-][0-9]{4}", lambda m: F.lit(True), False, 0.4, r"phone|call|\btel\b|mobile|fax"),
    Rule("secret", r"(?<![A-Za-z0-9])(?:(?i:api[_-]?key|access[_-]?key|secret[_-]?key|secret|token|passwd|password|pwd)[\"']?[ \t]*+[:=][ \t]*+[\"']?[A-Za-z0-9_+/=.-]{16,}+|(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36,}+)", "(?i:key|secret|token|passw|pwd)|AKIA|ASIA|gh[pousr]_", lambda m: F.regexp_replace(m, "^.*[:=][ \t\"']*", "").rlike("[0-9]") & m.rlike("[A-Za-z]"), False, 0.8, r"config|login|credential|env"),
)
KINDS = tuple(r.kind for r in RULES)


def prefix_sums(steps: Column) -> Column:
    """Running totals of an array, in blocks so that the work stays near the array's length."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))
    running = lambda xs: F.aggregate(xs, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    inner = F.transform(blocks, running)
    before = running(F.transform(inner, lambda p: F.element_at(p, -1)))
    moved = F.zip_with(inner, F.slice(before, 1, F.size(inner)), lambda p, o: F.transform(F.slice(p, 2, F.size(p) - 1), lambda x: x + o))
    return F.when(F.size(steps) > 0, F.flatten(moved)).otherwise(F.array().cast("array<bigint>"))


def _score(text: Column, start: Column, rule: Rule) -> Column:
    near = F.lower(F.substring(text, F.greatest(start - WINDOW + 1, F.lit(1)), F.least(start, F.lit(WINDOW))))
    score = F.lit(rule.score) + F.when(near.rlike(rule.context), rule.gain).otherwise(0.0)
    return F.round(score - F.when(near.rlike(rule.against), rule.gain).otherwise(0.0) if rule.against else score, 2)


_SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def _confirmed(text: Column, rule: Rule, matches: Column, ends: Column) -> Column:
    """The spans of the matches that the rule's validator accepts, with their scores."""

    def span(x: Column) -> Column:
        start = x["e"] - F.length(x["m"])
        return F.struct(F.lit(rule.kind).alias("kind"), start.alias("start"), x["e"].alias("end"), _score(text, start.cast("int"), rule).alias("score"))

    pairs = F.zip_with(matches, ends, lambda m, e: F.struct(m.alias("m"), e.alias("e")))
    return F.when(F.size(matches) > 0, F.transform(F.filter(pairs, lambda x: rule.valid(x["m"])), span)).otherwise(F.array().cast(_SPAN))


def find_pii(docs: DataFrame, text: str = "text", threshold: float = 0.6) -> DataFrame:
    """docs with a column ``pii``: spans (kind, start, end, score), by kind as in KINDS, then start.

    Positions are code points, the end exclusive.
    """
    body = "__pii_text"
    found = docs.withColumn(body, text_or_empty(text))
    t = F.col(body)
    found = found.withColumns({f"__pii_m_{r.kind}": F.when(t.contains(r.hint) if r.hint == "@" else t.rlike(r.hint), F.regexp_extract_all(t, F.lit(r.pattern), F.lit(0))) for r in RULES})
    ends = {}
    for r in RULES:
        m = F.col(f"__pii_m_{r.kind}")
        steps = F.zip_with(F.slice(F.split(t, r.pattern, -1), F.lit(1), F.size(m)), m, lambda gap, x: F.length(gap) + F.length(x))
        ends[f"__pii_e_{r.kind}"] = F.when(F.size(m) > 0, prefix_sums(steps))
    found = found.withColumns(ends)
    spans = {}
    for r in RULES:
        spans[f"__pii_s_{r.kind}"] = _confirmed(t, r, F.col(f"__pii_m_{r.kind}"), F.col(f"__pii_e_{r.kind}"))
    found = found.withColumns(spans)
    base = F.concat(*(F.col(f"__pii_s_{r.kind}") for r in RULES if r.base))
    more = F.concat(*(F.col(f"__pii_s_{r.kind}") for r in RULES if not r.base))
    clear = lambda x: (x["score"] >= threshold) & ~F.exists(F.col("__pii_base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    found = found.withColumns({"__pii_base": base, "__pii_more": more}).withColumn("pii", F.concat("__pii_base", F.when(F.size("__pii_more") > 0, F.filter("__pii_more", clear)).otherwise(F.array().cast(_SPAN))))
    return found.drop(body, "__pii_base", "__pii_more", *(f"__pii_{a}_{r.kind}" for r in RULES for a in "mes"))


def redact(docs: DataFrame, text: str = "text", threshold: float = 0.6) -> DataFrame:
    """docs with every span of find_pii replaced by its kind in brackets; overlapping spans become one."""
    found = find_pii(docs, text, threshold)
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(F.col(text), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out")))
    ordered = F.array_sort(F.col("pii"), lambda a, b: (a["start"] - b["start"]).cast("int"))
    whole = F.aggregate(ordered, empty, step, lambda a: F.concat(a["out"], F.substring(F.col(text), (a["at"] + 1).cast("int"), F.length(F.col(text)))))
    return found.withColumn(text, F.when(F.size("pii") > 0, whole).otherwise(F.col(text)))


def pii_report(docs: DataFrame) -> DataFrame:
    """Per document: base counts, the digest of its base spans, all spans as text, and how many."""
    found = find_pii(docs.select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("pii", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *(F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in RULES if r.base),
        F.sha2(joined(of(*(r.kind for r in RULES if r.base))), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        F.size("pii").cast("long").alias("n_spans"),
    )
