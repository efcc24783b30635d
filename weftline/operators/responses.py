"""Loosely formatted model responses to tables: numbered blocks, fields, candidates.

A response is read where its row is, by one pass over its header lines and one over each block's lines; nothing is shuffled.
The order-dependent rules (first heading wins, a repeated one suspends capture, a foreign heading ends the block) make this a
fold, which is why it is an Arrow function and no expression.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import text

#: Words that head a numbered block, by kind of response.
BLOCK_WORDS = {
    "candidate": ("candidate", "option", "proposal", "problem"),
    "refined": ("refined", "candidate", "option", "proposal", "problem"),
    "judgement": ("judgement", "judgment", "judge", "review", "evaluation", "candidate"),
}
#: What may stand between that word and the block's label, the signs of a label, dashes, the longest heading.
COUNTERS = ("#", "no.", "no", "number", "")
LABEL_SIGNS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-")
DASHES, HEADING_LENGTH = "-–—", 60
META = "\0"
_INITIALS = {kind: {w[0] for w in words} for kind, words in BLOCK_WORDS.items()}


class _Scan:
    """A place in a text, moved on by what is found there."""

    def __init__(self, s: str, at: int):
        self.s, self.at = s, at

    def blanks(self) -> _Scan:
        while self.at < len(self.s) and self.s[self.at].isspace():
            self.at += 1
        return self

    def run(self, sign: str, most: int) -> int:
        """Passes up to `most` of a sign and tells how many there were."""
        start = self.at
        while self.at < len(self.s) and self.s[self.at] == sign and self.at - start < most:
            self.at += 1
        return self.at - start

    def word(self, w: str) -> bool:
        here = self.s[self.at : self.at + len(w)].lower() == w
        self.at += len(w) if here else 0
        return here

    def label(self) -> str:
        start = self.at
        while self.at < len(self.s) and self.s[self.at] in LABEL_SIGNS:
            self.at += 1
        return self.s[start : self.at]

    def at_line_end(self) -> bool:
        while self.at < len(self.s) and self.s[self.at] != "\n" and self.s[self.at].isspace():
            self.at += 1
        return self.at == len(self.s) or self.s[self.at] == "\n"


def _named(s: str, at: int, words: tuple[str, ...]):
    """(label, place behind it) for each way to read a block word and a label from `at`; white space between them may hold a line end."""
    for w in words:
        for counter in COUNTERS:
            scan = _Scan(s, at)
            if scan.word(w) and (not counter or scan.blanks().word(counter)) and (label := scan.blanks().label()):
                yield label, scan.at


def header(s: str, at: int, kind: str) -> tuple[str, int] | None:
    """(label, end) of a header that begins at the line starting at `at`: a block word and a label, plain or within marks.

    A row of two or more equal signs must stand on both sides, one to six number signs in front; asterisks, at most two, may stand on
    either side. A colon may follow but for equal signs, after a plain header also a stop, bracket or hyphen.
    """
    scan = _Scan(s, at).blanks()
    start = scan.at
    opening = s[start : start + 1]
    if opening not in ("=", "#", "*") and opening.lower() not in _INITIALS[kind]:
        return None
    if opening == "=":
        fence, marks = scan.run("=", len(s)), None
    else:
        fence, marks = 0, scan.run("#", 6) if opening == "#" else scan.run("*", 2)
    if opening == "=" and fence < 2:
        return None
    for label, end in _named(s, scan.blanks().at, BLOCK_WORDS[kind]):
        tail = _Scan(s, end)
        if fence:
            ok = tail.blanks().run("=", len(s)) >= 2
        else:
            if opening != "#":
                before = tail.at
                if not tail.blanks().run("*", 2):
                    tail.at = before
            signs = ":" if opening == "#" or marks else ":.)-"
            before = tail.at
            if not any(tail.blanks().run(sign, 1) for sign in signs):
                tail.at = before
            ok = True
        if ok and tail.at_line_end():
            return label, tail.at
    return None


def _listed(s: str, at: int) -> tuple[str, int] | None:
    """(number, end) of a list item that begins at a line: a number, a stop or bracket, space and a Latin letter."""
    scan = _Scan(s, at).blanks()
    start = scan.at
    while scan.at < len(s) and s[scan.at].isdecimal():
        scan.at += 1
    number = s[start : scan.at]
    if not number or not scan.blanks() or s[scan.at : scan.at + 1] not in (".", ")"):
        return None
    scan.at += 1
    end = scan.at
    first = s[scan.blanks().at : scan.at + 1]
    return (number, scan.at) if scan.at > end and first.isascii() and first.isalpha() else None


def _sections(s: str, begins) -> list[tuple[str, str]]:
    """(label, text up to the next beginning) of the lines where begins(place) gives a label and an end; lines before the first are dropped."""
    found: list[tuple[int, str, int]] = []
    at = 0
    while at < len(s):
        got = begins(at)
        if got:
            found.append((at, *got))
        at = s.find("\n", got[1] if got else at)
        at = len(s) if at < 0 else at + 1
    return [(label, s[end:stop].strip()) for (_, label, end), stop in zip(found, [*(x[0] for x in found[1:]), len(s)])]


def blocks(response: str | None, kind: str) -> list[tuple[str, str]]:
    """(label, text) of the numbered blocks of a response; without any header line, of its list items if there are several."""
    s = response or ""
    found = _sections(s, lambda at: header(s, at, kind))
    if found:
        return found
    items = _sections(s, lambda at: _listed(s, at))
    return items if len(items) > 1 else []


def _halves(line: str) -> tuple[str, str] | None:
    """A line's name and value: parted at the first colon, or the first dash after white space, that leaves a name of a heading's length."""
    for i in range(1, len(line)):
        if line[i] == ":" or line[i] in DASHES and line[i - 1].isspace():
            name = line[:i].rstrip()
            if name:
                return (name, line[i + 1 :].strip()) if len(name) <= HEADING_LENGTH else None
    return None


def _unmarked(line: str) -> str:
    """A line without white space around, one bullet or item number, and marks of bold type."""
    line = line.strip()
    head, _, rest = line.partition(" ") if " " in line else (line, "", "")
    if rest and (head in ("-", "*", "+") or head[:-1].isdecimal() and head[-1] in ".)"):
        line = rest
    return line.replace("**", "").replace("__", "").strip()


def heading(line: str) -> tuple[str | None, str]:
    """(canonical name, inline value) of a line, (META, '') of a foreign heading, (None, '') of any other line."""
    clean = _unmarked(line)
    whole = clean.rstrip(":").strip()
    for name, value in filter(None, (_halves(clean), (whole, "") if len(whole) <= HEADING_LENGTH else None)):
        key = " ".join("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in name.lower()).split())
        if key in text.META_HEADINGS:
            return META, ""
        if key in text.ALIASES:
            return text.ALIASES[key], value
    return None, ""


def fields(block: str | None) -> dict[str, str]:
    """Fields of a block by canonical heading: the stretch of lines from a heading to the next, up to a foreign heading; of a heading that returns the first stretch holds."""
    lines = (block or "").splitlines()
    heads = [heading(line) for line in lines]
    end = next((i for i, (key, _) in enumerate(heads) if key == META), len(lines))
    starts = [i for i in range(end) if heads[i][0] is not None]
    out: dict[str, str] = {}
    for i, stop in zip(starts, [*starts[1:], end]):
        key, value = heads[i]
        out.setdefault(key, "\n".join([value, *lines[i + 1 : stop]]).strip())
    return out


FIELDS = ("transformation", "problem", "answer", "solution", "why it is new", "failure risk", "correct", "novelty", "depth", "seed alignment", "non stitched", "solution economy", "decision", "failure kind", "notes")
BLOCKS = T.StructType().add("ord", "integer").add("label", "string").add("block", "string")
for _f in FIELDS:
    BLOCKS = BLOCKS.add(_f.replace(" ", "_"), "string")


def _table(df: DataFrame, key: str, response: str, kind: str, whole: bool) -> DataFrame:
    """One row for each block: key, ord from 0, label, block and its fields (null where absent)."""
    def run(batches):
        for batch in batches:
            out = []
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = blocks(s, kind) or ([("1", s or "")] if whole else [])
                for i, (label, block) in enumerate(got):
                    f = fields(block)
                    out.append((k, i, label, block, *[f.get(name) for name in FIELDS]))
            cols = list(zip(*out)) or [[]] * (4 + len(FIELDS))
            kinds = [batch.schema.field(0).type, pa.int32()] + [pa.string()] * (2 + len(FIELDS))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["key", *BLOCKS.names])

    source = df.select(F.col(key).alias("key"), F.col(response).cast("string").alias("response"))
    schema = T.StructType([T.StructField("key", source.schema["key"].dataType), *BLOCKS.fields])
    return source.mapInArrow(run, schema)


def block_table(df: DataFrame, key: str, response: str, kind: str = "candidate") -> DataFrame:
    """Numbered blocks of each response (kind: candidate, refined or judgement); a response without blocks gives no row."""
    return _table(df, key, response, kind, False)


def candidate_table(df: DataFrame, key: str, response: str, kind: str = "candidate") -> DataFrame:
    """Candidates of each response: blocks (the whole text where there is none) that have a problem and an answer.

    Columns: key, ord (place among the candidates kept), label, question, answer, solution, transformation, why_new, risk;
    absent fields are ''. Null and blank responses give no row.
    """
    from pyspark.sql import Window

    rows = _table(df, key, response, kind, True).where("coalesce(problem, '') <> '' and coalesce(answer, '') <> ''")
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    place = F.row_number().over(Window.partitionBy("key").orderBy("ord")) - 1
    return rows.select("key", place.alias("ord"), "label", F.col("problem").alias("question"), "answer", some("solution").alias("solution"), some("transformation").alias("transformation"), some("why_it_is_new").alias("why_new"), some("failure_risk").alias("risk"))


def format_candidates(c: str = "candidates"):
    """Text of an array of candidates (transformation, question, answer, solution, why_new, risk), numbered from 1, which candidate_table reads back."""
    def one(x, i):
        part = lambda name, f: F.concat(F.lit(f"{name}:\n"), F.coalesce(x[f], F.lit("")), F.lit("\n"))
        return F.concat(F.lit("=== CANDIDATE "), (i + 1).cast("string"), F.lit(" ===\n"), F.concat_ws("\n", part("Transformation", "transformation"), part("Problem", "question"), part("Answer", "answer"), part("Solution", "solution"), part("Why It Is New", "why_new"), part("Failure Risk", "risk")))

    return F.array_join(F.transform(c, one), "\n")


def substitute(first: DataFrame, refined: DataFrame) -> DataFrame:
    """The refined candidates of each key that has as many of them as first ones, the first ones of all other keys."""
    n = first.groupBy("key").agg(F.count("*").alias("n"))
    m = refined.groupBy("key").agg(F.count("*").alias("m"))
    same = n.join(m, "key").where("n = m").select("key")
    return refined.join(same, "key", "left_semi").unionByName(first.join(same, "key", "left_anti"))
