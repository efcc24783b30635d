"""Text functions as Column expressions. All are null-safe as their docstrings say, and stay in the JVM."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the characters around a text that count as white space, as a regular expression class.
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
#: Keys of an object that may hold its text, first to last.
TEXT_KEYS = ("solution", "answer", "text", "content", "markdown")
#: Headings of model responses by their canonical names; each canonical name is also its own alias.
HEADINGS = {
    "transformation": ("transformation", "mutation", "change", "what changed"),
    "problem": ("problem", "question", "new problem", "proposed problem", "generated problem"),
    "answer": ("answer", "final answer", "result"),
    "solution": ("solution", "proof", "full solution"),
    "why it is new": ("why it is new", "why new", "why this is new", "why sharper"),
    "failure risk": ("failure risk", "risk", "risks"),
    "correct": ("correct", "correctness", "mathematical correctness"),
    "novelty": ("novelty", "novelty score"),
    "depth": ("depth", "depth score", "quality"),
    "seed alignment": ("seed alignment", "alignment"),
    "non stitched": ("non stitched", "nonstitched", "not stitched"),
    "solution economy": ("solution economy", "economy"),
    "decision": ("decision", "verdict", "accepted"),
    "failure kind": ("failure kind", "failure reason", "rejection reason"),
    "notes": ("notes", "reason", "judge notes", "explanation"),
}
#: Headings that end a block.
META_HEADINGS = ("parent problem", "parent answer", "parent lineage problem", "dataset memory", "dataset memory stored on the parent row", "memory from earlier rows in this run", "target iteration", "candidates", "candidates to refine")
ALIASES = {alias: name for name, aliases in HEADINGS.items() for alias in aliases}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space around, no-break spaces and information separators included; null stays null."""
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def rstrip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"{SPACE}+$", "")


def lstrip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"^{SPACE}+", "")


def trim_middle(c: Column | str, limit: int) -> Column:
    """The stripped text; if longer than limit, its first limit - 120 characters, a marker line and its last 100. Null gives ''."""
    t = strip(F.coalesce(col(c), F.lit("")))
    cut = F.concat(rstrip(F.substring(t, 1, limit - 120)), F.lit("\n...[trimmed]...\n"), lstrip(F.substring(t, -100, 100)))
    return F.when(F.length(t) <= limit, t).otherwise(cut)


def field_text(c: Column, kind: T.DataType) -> Column:
    """Text of a column of any type: strings stripped, lists joined by blank lines without blank parts, of an object the
    first key of TEXT_KEYS that its type has (null there gives ''), else its JSON; null gives ''. Chosen by type when the plan is built."""
    if isinstance(kind, T.StringType):
        out = strip(c)
    elif isinstance(kind, T.ArrayType):
        parts = F.filter(F.transform(c, lambda x: field_text(x, kind.elementType)), lambda x: x != "")
        out = strip(F.array_join(parts, "\n\n"))
    elif isinstance(kind, T.StructType):
        key = next((k for k in TEXT_KEYS if k in kind.names), None)
        out = field_text(c[key], kind[key].dataType) if key else F.to_json(c)
    elif isinstance(kind, T.MapType):
        out = F.to_json(c)
        for k in reversed(TEXT_KEYS):
            out = F.when(F.map_contains_key(c, k), field_text(c[k], kind.valueType)).otherwise(out)
    else:
        out = strip(c.cast("string"))
    return F.coalesce(out, F.lit(""))


def json_field_text(c: Column | str) -> Column:
    """field_text of a text that may be JSON: an object or a list (of texts or objects) is read, anything else is plain text."""
    t = col(c)
    obj = F.from_json(t, "map<string,string>")
    items = F.from_json(t, "array<string>")
    inner = F.transform(items, lambda x: F.when(x.startswith("{"), field_text(F.from_json(x, "map<string,string>"), T.MapType(T.StringType(), T.StringType()))).otherwise(x))
    of = lambda c, kind: field_text(c, kind)
    return F.when(lstrip(t).startswith("{") & obj.isNotNull() & (F.size(obj) > 0), of(obj, T.MapType(T.StringType(), T.StringType()))).when(lstrip(t).startswith("[") & items.isNotNull(), of(inner, T.ArrayType(T.StringType()))).otherwise(F.coalesce(strip(t), F.lit("")))


def parse_iteration(c: Column, kind: T.DataType) -> Column:
    """Iteration of a cell: null and booleans give null, whole numbers themselves, fractions their whole part (NaN null), texts their first whole number."""
    if isinstance(kind, T.BooleanType):
        return F.lit(None).cast("int")
    if isinstance(kind, T.IntegralType):
        return c.try_cast("int")
    if isinstance(kind, T.NumericType):
        return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).try_cast("int") if not isinstance(kind, (T.DoubleType, T.FloatType)) else F.when(~F.isnan(c), c).try_cast("int")
    return F.nullif(F.regexp_extract(c.cast("string"), r"-?\d+", 0), F.lit("")).try_cast("int")


def normal_label(c: Column | str) -> Column:
    """Lower case, with everything but a-z and 0-9 turned into single spaces."""
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " "))


def canonical_heading(c: Column | str) -> Column:
    """The canonical name of a heading, null if it is none."""
    table = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.try_element_at(table, normal_label(c))


def is_meta_heading(c: Column | str) -> Column:
    return normal_label(c).isin(*META_HEADINGS)


def score(c: Column | str) -> Column:
    """First signed number in a text, held within 0 and 1; 0 if there is none."""
    x = F.nullif(F.regexp_extract(F.coalesce(col(c), F.lit("")), r"-?\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))


def flag(c: Column | str) -> Column:
    """Whether a text starts with yes, true, 1 or correct."""
    t = F.lower(strip(F.coalesce(col(c), F.lit(""))))
    return t.startswith("yes") | t.startswith("true") | t.startswith("1") | t.startswith("correct")


def two_decimals(c: Column | str) -> Column:
    """A number with two decimals, half to even on its exact binary value (0.155 gives 0.15, 0.125 gives 0.12); null stays null.

    The part below one is a multiple of 2^-60, but for what is too small to count, so it is rounded in whole numbers. Not for
    numbers of 2^53 or more, NaN or infinite ones, which give null.
    """
    unit, half = F.lit(2**60).cast("decimal(20,0)"), F.lit(2**59).cast("decimal(20,0)")

    def parts(x):
        size = F.abs(F.when(F.abs(x) < 2.0**53, x))
        return F.struct((x < 0).alias("below"), F.floor(size).alias("whole"), (((size - F.floor(size)) * 2.0**60).cast("bigint").cast("decimal(20,0)") * 100).alias("part"))

    def divided(p):
        return F.struct(p["below"].alias("below"), (p["whole"] * 100 + ((p["part"] - p["part"] % unit) / unit).cast("bigint")).alias("cents"), (p["part"] % unit).alias("rest"))

    def rounded(p):
        return F.struct(p["below"].alias("below"), (p["cents"] + F.when((p["rest"] > half) | (p["rest"] == half) & (p["cents"] % 2 == 1), 1).otherwise(0)).alias("cents"))

    def written(p):
        return F.concat(F.when(p["below"], "-").otherwise(""), F.floor(p["cents"] / 100).cast("string"), F.lit("."), F.lpad((p["cents"] % 100).cast("string"), 2, "0"))

    one = F.array(col(c).cast("double"))
    for step in (parts, divided, rounded, written):  # each names what the next one uses several times
        one = F.transform(one, step)
    return F.element_at(one, 1)


def bullet_block(title: str, items: Column) -> Column:
    """'title:' and a bullet for each item, 'title: none yet' without items."""
    body = F.concat(F.lit(f"{title}:\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"))
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, F.lit(f"{title}: none yet")).otherwise(body)


def tail(items: Column, n: int | None) -> Column:
    """The last n items; all of them for None and, as slices from -0 do, for 0."""
    return F.when(F.size(items) > n, F.slice(items, -n, n)).otherwise(items) if n else items


def first_text(*cols: Column) -> Column:
    """The first text that is not blank, stripped; '' if there is none."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in cols], F.lit(""))


def flat_content(parts: Column) -> Column:
    """Content parts, array<struct<text, content>>: of each its text, else its content, blank ones left out, a line each."""
    each = F.transform(parts, lambda p: F.coalesce(p["text"], p["content"], F.lit("")))
    return F.coalesce(strip(F.array_join(F.filter(each, lambda x: strip(x) != ""), "\n")), F.lit(""))


def nested_to_json(df, keep: tuple[str, ...] = ()):
    """df with every list, map and object column as JSON text, but for those in keep."""
    made = [F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) and f.name not in keep else F.col(f"`{f.name}`") for f in df.schema]
    return df.select(*made)


#: Parts of messages of errors that no second attempt mends; each tuple must occur as a whole.
FINAL_ERRORS = (("missing", "api key"), ("authentication",), ("unauthorized",), ("invalid api key",), ("incorrect api key",), ("api key", "invalid"), ("api key", "not provided"), ("api key", "required"), ("api key", "must be set"))


def retryable(message: Column | str) -> Column:
    """Whether a call that failed with this message may be tried again: not after errors of authentication or keys."""
    m = F.lower(F.coalesce(col(message), F.lit("")))
    stop = reduce(or_, [reduce(and_, [m.contains(part) for part in parts]) for parts in FINAL_ERRORS])
    return ~stop


def reasoning_model(model: Column | str) -> Column:
    m = F.lower(col(model))
    return m.contains("gpt-5") | m.contains("/o") | m.startswith("o")


def takes_temperature(model: Column | str) -> Column:
    m = F.lower(col(model))
    return ~(m.contains("gpt-5.5") | m.contains("gpt-5.4"))


def token_budget(model: Column | str, requested: Column | str) -> Column:
    """Tokens to ask for: as requested, for reasoning models four times as many and at least 8192."""
    n = col(requested)
    return F.when(reasoning_model(model), F.greatest(F.lit(8192), n * 4)).otherwise(n)


def cache_eligible(use_cache: Column | str, temperature: Column | str) -> Column:
    """Whether a completion may come from the cache: as asked, else if the temperature is 0."""
    return F.coalesce(col(use_cache), col(temperature) == 0, F.lit(False))


def request(model: Column | str, temperature: Column | str, max_tokens: Column | str, json: Column | str) -> Column:
    """Parameters of a call as an object: temperature where the model takes one, the token budget under the name that its family reads, the response format where JSON is asked for."""
    m, budget = col(model), token_budget(model, max_tokens)
    return F.struct(m.alias("model"), F.when(takes_temperature(m), col(temperature)).alias("temperature"), F.when(reasoning_model(m), budget).alias("max_completion_tokens"), F.when(~reasoning_model(m), budget).alias("max_tokens"), F.when(col(json), F.lit("json_object")).alias("response_format"))
