"""Texts that end before their time: cut at a field's limit or in transfer.

The leading test is length: an unfinished value whose length, in characters or bytes, is a spike of its source and column was cut
at that limit. What was cut elsewhere, in transfer, shows by its end: a pushdown parser for fences, formulas, brackets, quotations,
markup and lists tells what is still open, and the last fragment is held against the ways a text may end. Copies of a cut value are cut.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.runtime import Workspace, small

#: Stand-ins for an absent text, in lower case, without white space around.
STAND_INS = ("", "-", "--", "—", "–", ".", "..", "...", "…", "?", "[]", "{}", "()", '""', "''", "null", "none", "nil", "nan", "n/a", "na", "n.a.", "tbd", "todo", "undefined", "unknown", "empty", "blank", "no answer", "(no answer)", "[no answer]", "no answer.", "not available", "missing", "(none)", "(empty)", "<empty>", "<null>", "answer:", "answer", "final answer:", "solution:", "result:", "antwort:", "réponse:", "réponse :", "respuesta:", "lösung:", "xxx", "???", "_", "*", "#")
#: Signs that end a text as a full stop does, marks of a finished proof, closing marks.
STOPS, PROOF_SIGNS, CLOSERS = ".!?。！？؟।", "∎□■◻◼▪", "\"'”’»›)]}*_`」』"
PROOF_WORDS = re.compile(r"(?:^|\W)(?:q\.?\s?e\.?\s?d\.?|w\.?\s?z\.?\s?b\.?\s?w\.?|c\.?\s?q\.?\s?f\.?\s?d\.?|c\.?\s?q\.?\s?d\.?|q\.?\s?e\.?\s?f\.?)$", re.I)
_SPACE = re.compile(r"[\s\u200b\u200c\u200d\u2060\ufeff\u00ad\x00-\x1f]+$")
_LEAD = re.compile(r"^[\s\u200b\u200c\u200d\u2060\ufeff\u00ad\x00-\x1f]+")
#: What a cut in transfer leaves behind: half an escape, entity or code point.
_TRACE = re.compile(r"(?:�|\\u[0-9a-fA-F]{0,3}|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{0,1}|\\|&(?:#\d{0,5}|#x[0-9a-fA-F]{0,5}|[A-Za-z]{1,7})|\[truncated\]|\(truncated\)|<truncated>|\[cut\]|\[…\]|\[\.\.\.\])$", re.I)
_BOUNDARY = re.compile(r"(?<=[.!?。！？])[\"'”’»)\]*_]*(?:\s+|(?<=[。！？]))|\n+")
_MATH = r"(?:\\\([^\n]*?\\\)|\\\[[^\n]*?\\\]|\$\$[^\n$]*\$\$|\$[^\n$]+\$)"
_NUMBER = r"[-+]?[\d][\d.,:/^ \u00a0\u202f]*"
_BARE = re.compile(rf"^\W*(?:[A-Za-z]\s*=\s*)?(?:{_MATH}|{_NUMBER}|\\boxed\{{[^{{}}]*\}})[%°€$]?(?:\s*\(?\s*[^\W\d_]+(?:\s[^\W\d_]+)?\s*\)?)?\W*$")
_LABELLED = re.compile(rf"^\W*[^\W\d_]+(?:\s[^\W\d_]+){{0,3}}\s?:\s*\W*(?:[A-Za-z]\s*=\s*)?(?:{_MATH}|{_NUMBER})\W*((?:[^\W\d_]+\s?){{0,2}})\W*$")
_COPULA = re.compile(rf"(?:\bis|\bare|\bequals|\bbe|\bist|\bsind|\bbeträgt|\bgleich|\best|\bvaut|\bégale|\bes|\bson|\bvale|\bigual a|=|:|→|⇒)\s*\**{_MATH}\W*$", re.I)
_ENDED_MATH = re.compile(rf"^\W*{_MATH}\W*$")
_WORD = re.compile(r"[^\W_]+")


def bare(text: str) -> str:
    """The text without white space and invisible characters around."""
    return _LEAD.sub("", _SPACE.sub("", text))


def is_stand_in(text: str | None) -> bool:
    """Whether a text is null, blank or only stands for nothing."""
    return text is None or bare(text).strip("*_` ").lower() in STAND_INS or bare(text).lower() in STAND_INS


#: Elements of markup without an end, or whose end may be left out.
_OPEN_ENDED = frozenset("area base br col dd dt embed hr img input li link meta option p source tbody td tfoot th thead tr track wbr".split())
_ELEMENT = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s+[\w:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s<>\"']+))*)\s*(/?)>")
_HALF_ELEMENT = re.compile(r"<(?:/[A-Za-z0-9]*|[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?)$")
_CLOSED = re.compile(r"(?:\s*</[A-Za-z][A-Za-z0-9]*\s*>)+$")
_ITEM = re.compile(r"[ \t]*(?:\d+[.)]|[-*+•])(?=[ \t]|$)")
_EMPTY_ITEM = re.compile(r"\s*(?:\d+[.)]|[-*+•])\s*")
_PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "„": "“", "「": "」"}
_WRAPS = ('""', "“”", "«»", "„“", "「」", "()", "[]")
_OPENERS: dict[str, list[str]] = {}
for _open, _close in _PAIRS.items():
    _OPENERS.setdefault(_close, []).append(_open)


def unclosed(text: str) -> list[str]:
    """What is still open at the end: '```', '\\(', '\\[', '$$', '$', brackets, quotation marks and '<name>' of elements, outermost first.

    Within fences and formulas only their own end counts; a closing mark that nothing opened is passed over, one that closes an
    outer bracket drops what was left open within.
    """
    stack: list[str] = []
    have: Counter = Counter()  # of each mark in the stack, so that a stray closing mark is passed over at once

    def push(mark: str) -> None:
        stack.append(mark)
        have[mark] += 1

    def pop_to(mark: str) -> None:
        while True:
            top = stack.pop()
            have[top] -= 1
            if top == mark:
                return

    i, n = 0, len(text)
    while i < n:
        top = stack[-1] if stack else ""
        one, two = text[i], text[i : i + 2]
        if top == "```":
            if text.startswith("```", i):
                pop_to(top)
                i += 2
        elif one == "`" and text.startswith("```", i):
            push("```")
            i += 2
        elif top in ("\\(", "\\["):
            if two == ("\\)" if top == "\\(" else "\\]"):
                pop_to(top)
                i += 1
        elif top in ("$$", "$"):
            if text.startswith(top, i):
                pop_to(top)
                i += len(top) - 1
        elif two in ("\\(", "\\[", "$$"):
            push(two)
            i += 1
        elif two == "\\$":
            i += 1
        elif one == "$":
            push("$")
        elif one == "<" and (m := _ELEMENT.match(text, i)):
            mark = f"<{m[2].lower()}>"
            if m[1]:
                if have[mark]:
                    pop_to(mark)
            elif not m[4] and m[2].lower() not in _OPEN_ENDED:
                push(mark)
            i = m.end() - 1
        elif one == '"':
            if have['"']:
                pop_to('"')
            else:
                push('"')
        elif one in _PAIRS and not (one == "“" and have["„"]):
            push(one)
        elif one in _OPENERS:
            for opener in reversed(stack) if any(have[o] for o in _OPENERS[one]) else ():
                if opener in _OPENERS[one]:
                    pop_to(opener)
                    break
        i += 1
    return stack


def empty_item(text: str) -> bool:
    """Whether a text ends in a list item that says nothing, after at least one that does."""
    above, _, last = text.rpartition("\n")
    return bool(_EMPTY_ITEM.fullmatch(last)) and any(_ITEM.match(x) and not _EMPTY_ITEM.fullmatch(x) for x in above.rsplit("\n", 3)[-3:])


def ending(text: str | None, context: str | None = None) -> str:
    """'whole', 'cut', 'weak' (ends well, but a cut may end so too) or 'none' (stand-ins for nothing) for a text.

    context is the question an answer belongs to; with the text itself it tells whether the last word is known.
    """
    if is_stand_in(text):
        return "none"
    t = bare(text)
    if _TRACE.search(t) and not t.endswith(";"):
        return "cut"
    t = bare(html.unescape(t))
    if len(t) > 2 and t[0] + t[-1] in _WRAPS and not any(x in t[1:-1] for x in (t[0], t[-1])):
        t = bare(t[1:-1]) or t  # the whole text in quotation marks or brackets
    core = t.rstrip("*_` ") or t
    if core.endswith(("...", "…")):
        before = core.rstrip(".… ")
        return "cut" if before else "none"
    if core[-1] in PROOF_SIGNS or PROOF_WORDS.search(core):
        return "whole"
    open_ = unclosed(t)
    if empty_item(t) or _HALF_ELEMENT.search(t) and "</" in t:
        return "cut"
    if t.endswith(">") and (inner := bare(_CLOSED.sub("", t))):
        t, core = inner, inner.rstrip("*_` ") or inner
    last = bare(_BOUNDARY.split(t)[-1] or t).strip()
    alone = len(last) >= len(t) - 1
    inner = core.rstrip(CLOSERS + " ")
    if inner and inner[-1] in STOPS:
        # A stop within a formula or bracket still open is no end, unless the mark was opened long before.
        if open_ and open_[-1] == "```":
            return "cut"
        if open_ and (open_[-1] in _PAIRS or open_[-1] == '"' or open_[-1][0] == "<"):
            return "weak"
        return "weak" if open_ and open_[-1] in ("\\(", "\\[", "$", "$$") and not re.search(r"[^\W\d_]{3,}[.!?]", t[-12:]) else "whole"
    if open_ and open_[-1] in ("\\(", "\\[", "$$", "```"):
        return "cut"
    words = _WORD.findall(last)
    if m := _LABELLED.match(last):
        unit = _WORD.findall(m[1].lower())
        if not unit:
            return "weak"
        rest = {w.lower() for w in _WORD.findall(t[: t.rfind(last)] if not alone else "")} | {w.lower() for w in _WORD.findall(context or "")}
        if all(w in rest for w in unit):
            return "whole"
        return "cut" if any(w.startswith(unit[-1]) for w in rest if len(w) > len(unit[-1])) else "weak"
    if alone and _BARE.match(t) or _ENDED_MATH.match(last) or _COPULA.search(last):
        return "whole"  # brief results and closing formulas
    if alone and len(words) <= 1 and len(t) < 40:
        return "weak"
    if core[-1] in ")]}\"”»" and not open_:
        if t[0] in "\"“«„([{" and alone:
            return "whole"
        if re.match(r"^[(\[\"“«„][^()\[\]]*[)\]\"”»]+$", last):
            return "whole"  # a remark on its own after the last sentence
    return "cut"


@dataclass(frozen=True)
class Spikes:
    """A length is a spike of unfinished values if there are at least `least` of them, `share` of all values of that length,
    and `over` times the mean count of unfinished values at lengths up to `near` away."""

    least: int = 5
    share: float = 0.4
    over: float = 4.0
    near: int = 15


def judged(rows: DataFrame, fields: dict[str, str | None], id_col: str = "id", source_col: str = "dataset") -> DataFrame:
    """(id, source, field, state, chars, bytes, same) of every value that is neither null nor a stand-in.

    fields names the text columns, each with its context column or None; same is a hash that equal values share. A repeated
    id with equal values counts once; rows with a null id take no part; a null source is a source of its own.
    """
    cols = list(fields)

    def run(batches):
        for batch in batches:
            ids, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = {c: batch.column(2 + k).to_pylist() for k, c in enumerate(needed)}
            out = []
            for c in cols:
                ctx = texts[fields[c]] if fields[c] else [None] * len(ids)
                for i, s, t, q in zip(ids, sources, texts[c], ctx):
                    state = ending(t, q)
                    if state != "none":
                        out.append((i, s, c, state, len(t), len(t.encode("utf-8", "surrogatepass")), xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))))
            columns = list(zip(*out)) or [[]] * 7
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["id", "source", "field", "state", "chars", "bytes", "same"])

    needed = list(dict.fromkeys([*cols, *[c for c in fields.values() if c]]))
    source = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(source_col).cast("string").alias("source"), *[F.col(c).cast("string") for c in needed])
    return source.mapInArrow(run, "id string, source string, field string, state string, chars int, bytes int, same binary").distinct()


def spikes(values: DataFrame, s: Spikes = Spikes()) -> DataFrame:
    """(source, field, unit, length, open, n, longer): spikes of the length histograms, in characters and in bytes; longer is how many values of the column are longer."""
    unit = values.select("source", "field", (F.col("state") != "whole").cast("int").alias("open"), F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))).alias("u"))
    hist = unit.groupBy("source", "field", "u.unit", "u.length").agg(F.count("*").alias("n"), F.sum("open").alias("open"))
    # One row for each length that occurs: bounded by the lengths, whatever the number of values.
    by_length = Window.partitionBy("source", "field", "unit").orderBy("length")
    beside = (F.sum("open").over(by_length.rangeBetween(-s.near, s.near)) - F.col("open")) / (2 * s.near)
    longer = F.coalesce(F.sum("n").over(by_length.rangeBetween(1, Window.unboundedFollowing)), F.lit(0))
    return hist.where("length > 0").withColumns({"beside": beside, "longer": longer}).where((F.col("open") >= s.least) & (F.col("open") >= s.share * F.col("n")) & (F.col("open") >= s.over * F.col("beside"))).select("source", "field", "unit", "length", "open", "n", "longer")


def settle(values: DataFrame, s: Spikes = Spikes()) -> DataFrame:
    """values with `cut` and `test`, the first that tells so: 'limit' (unfinished at a spike), 'ending' (by its end), 'copy' (equal to a value cut in any source, column or row)."""
    ws = Workspace(values.sparkSession, "cut")
    values, n = ws.write(values)
    at, k = ws.write(spikes(values, s).select(F.col("source").alias("s"), F.col("field").alias("f"), "unit", "length"), n=F.count("*"))
    at = small(at, k["n"] or 0)
    on = F.col("source").eqNullSafe(F.col("s")) & (F.col("field") == F.col("f"))
    on &= F.when(F.col("unit") == "chars", F.col("chars")).otherwise(F.col("bytes")) == F.col("length")
    unfinished = values.where("state <> 'whole'")
    limit = unfinished.join(at, on, "left_semi").withColumn("test", F.lit("limit"))
    rest = unfinished.join(at, on, "left_anti").unionByName(values.where("state = 'whole'")).withColumn("test", F.when(F.col("state") == "cut", "ending"))
    told, _ = ws.write(limit.unionByName(rest))
    # Hashes of cut values are far fewer than values, and a value has one of them once, so none is hot.
    known = told.where("test is not null").select("same").distinct().withColumn("known", F.lit(True))
    left = told.where("test is null").join(known, "same", "left").withColumn("test", F.when(F.col("known"), "copy")).drop("known")
    return told.where("test is not null").unionByName(left).withColumn("cut", F.col("test").isNotNull())


def rates(settled: DataFrame) -> DataFrame:
    """(source, field, n_values, n_cut, share, n_limit, n_ending, n_copy): how often each source cuts each column, and which test told so."""
    by = [F.count_if(F.col("test") == t).alias(f"n_{t}") for t in ("limit", "ending", "copy")]
    return settled.groupBy("source", "field").agg(F.count("*").alias("n_values"), F.count_if("cut").alias("n_cut"), (F.count_if("cut") / F.count("*")).alias("share"), *by)
