"""Keyword-stuffed and link-list pages, by pointwise mutual information of neighbouring words from corpus counts.

Words and pairs of neighbours are counted over all documents. A page is scored by the mean normalised PMI of its neighbouring
words, to which it does not itself contribute (word salad puts known words beside strangers), and by its repeated collocations:
the share of its pairs that return at least three times, weighted with their normalised PMI. Normalised values lie within -1 and
1 whatever the size of the corpus. Pages without sentences need few repeats; in pages of sentences only collocations of two
content words count, as drills, glossaries and set phrases repeat whole sentences, but not names of goods.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import languages, minhash
from weftline.runtime import Workspace

LINK = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+")
#: Stands for a link while a text is split; a private-use character.
MARK = "\ue000"
#: Letters of scripts written without spaces, each a word of its own.
DENSE = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\u0e00-\u0e7f"
WORD = re.compile(rf"[{DENSE}]|[^\W_{DENSE}]+|{MARK}")
SENTENCE = re.compile(r"([^.?!。！？\n]+)([.?!。！？]*)")
LATIN = re.compile(r"[a-zß-ÿœ]")
DIGITS = re.compile(r"\d+")
TAG = re.compile(r"<[^<>\n]*>|&[a-z]{2,6};|&#\d+;")


@dataclass(frozen=True)
class Rules:
    """prose is the share of words that stand in sentences. A page is spam by any of these limits, all at least:

    links: share of letters in links. repeats_bare: repeats of a page with prose below bare (lists of items). repeats: repeats
    of a page with prose below mixed. stuffed, stuffed_mixed: repeats of content words times 1 - mean normalised PMI, at any prose
    and at prose below loose; a page whose mean is coherent or more, or not known, repeats what others say and is none. salad: a mean
    normalised PMI below this. A mean counts from known_pairs pairs, both words of which other pages have `known` times.
    """

    links: float = 0.4
    bare: float = 0.4
    repeats_bare: float = 0.04
    mixed: float = 0.5
    repeats: float = 0.12
    stuffed: float = 0.09
    loose: float = 0.77
    stuffed_mixed: float = 0.062
    coherent: float = 0.58
    salad: float = -0.6
    known: int = 10
    known_pairs: int = 8
    least_words: int = 20


def plain(text: str) -> tuple[str, int]:
    """The text in lower case without markup and with its links as marks, and the number of letters in the links."""
    t = text.lower().replace(MARK, " ")
    if "&" in t:
        for entity, sign in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
            t = t.replace(entity, sign)
    if "<" in t or "&" in t:
        t = TAG.sub(lambda m: " " + " ".join(LINK.findall(m[0])) + " ", t)
    letters = 0
    if "http" in t or "www." in t:
        found = LINK.findall(t)
        letters = sum(map(len, found))
        t = LINK.sub(f" {MARK} ", t)
    return t, letters


def token(w: str) -> str:
    """Links become one token, numbers another; digits within words become 0."""
    return w if w.isalpha() else "\0link" if w == MARK else "\0number" if w.isdigit() else DIGITS.sub("0", w)


def content(w: str) -> bool:
    return w.isalpha() and w not in languages.FUNCTION


def read(text: str) -> tuple[list[str], float, float]:
    """(tokens, prose, links) of a text: prose is the share of its words in sentences, links that of its letters in links.

    A sentence ends with its mark, has at least four words and is made of function words to a fifth, or is in another script.
    """
    t, letters = plain(text)
    tokens: list[str] = []
    inside = total = chars = 0
    for s, stop in SENTENCE.findall(t):
        found = WORD.findall(s)
        if not found:
            continue
        tokens.extend(map(token, found))
        named = [w for w in found if w != MARK and not w.isdigit()]
        chars += sum(map(len, found))
        total += len(named)
        if not stop or not named:
            continue
        if len(named) >= 4 and sum(map(languages.FUNCTION.__contains__, named)) * 5 >= len(named):
            inside += len(named)
        elif sum(len(w) for w in named if not LATIN.search(w)) * 2 > sum(map(len, named)):
            inside += len(named)
    links = letters + chars - tokens.count("\0link")
    return tokens, inside / total if total else 0.0, letters / links if links else 0.0


PAGE = "same binary, page long, prose double, links double, n int, copies long, k array<long>, a array<long>, b array<long>, v array<int>, va array<int>, vb array<int>, kind array<byte>"
#: Kinds of pairs: number after number or link after link, which is no collocation; two content words; any other.
BLANK, CONTENT, OTHER = 0, 1, 2


def _pages(batches):
    """Each page with its distinct pairs of neighbouring words: hashes of the pair and of both words, how often, and the kind. A text is read once."""
    for batch in batches:
        kept, prose, links, lengths = [], [], [], []
        number: dict[str, int] = {}
        flat: list[int] = []
        for i, text in enumerate(batch.column("text").to_pylist()):
            tokens, p, q = read(text)
            if len(tokens) > 1:
                flat.extend([number.setdefault(w, len(number)) for w in tokens])
                kept.append(i)
                prose.append(p)
                links.append(q)
                lengths.append(len(tokens))
        words = list(number)
        key = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
        kinds = np.array([BLANK if w[0] == "\0" else CONTENT if content(w) else OTHER for w in words], np.int8)
        seq = np.array(flat, np.int64)
        page = np.repeat(np.arange(len(kept)), lengths)
        inner = page[1:] == page[:-1]
        page, x, y = page[1:][inner], seq[:-1][inner], seq[1:][inner]
        pair = (page * len(words) + x) * len(words) + y if len(words) ** 2 * max(1, len(kept)) < 2**62 else None
        if pair is None:  # too many words in one batch for numbers: the same by sorting
            _, at, v = np.unique(np.stack([page, x, y], 1), axis=0, return_index=True, return_counts=True)
        else:
            _, at, v = np.unique(pair, return_index=True, return_counts=True)
        page, x, y = page[at], x[at], y[at]
        # How often the page has the first word of a pair first, and the second one second.
        va, vb = (np.bincount(i, v)[i].astype(np.int32) for i in (np.unique(page * max(1, len(words)) + z, return_inverse=True)[1] for z in (x, y)))
        with np.errstate(over="ignore"):
            k = minhash.mix(key[x] * minhash.STEP ^ minhash.mix(key[y]))
        kind = np.where((kinds[x] == BLANK) & (kinds[y] == BLANK), BLANK, np.where((kinds[x] == CONTENT) & (kinds[y] == CONTENT), CONTENT, OTHER)).astype(np.int8)
        offsets = pa.array(np.searchsorted(page, np.arange(len(kept) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (k.view(np.int64), key[x].view(np.int64), key[y].view(np.int64), v.astype(np.int32), va, vb, kind)]
        of = batch.take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([of.column("same"), of.column("page"), pa.array(prose, pa.float64()), pa.array(links, pa.float64()), pa.array(lengths, pa.int32()), of.column("copies"), *lists], names=["same", "page", "prose", "links", "n", "copies", "k", "a", "b", "v", "va", "vb", "kind"])


def pair_counts(pages: DataFrame) -> tuple[DataFrame, int]:
    """(k, nk, na, nb) of every pair of neighbours: how often it occurs, its first word stands first and its second one second; and their sum."""
    ws = Workspace(pages.sparkSession, "pairs")
    one = pages.select("copies", F.explode(F.arrays_zip("k", "a", "b", "v")).alias("x")).select("x.k", "x.a", "x.b", (F.col("x.v") * F.col("copies")).alias("v"))
    two, got = ws.write(one.groupBy("k", "a", "b").agg(F.sum("v").alias("nk")), total=F.sum("nk"))
    # A pair occurs once here, so the commonest word has no more rows than there are words beside it.
    left, right = two.groupBy("a").agg(F.sum("nk").alias("na")), two.groupBy("b").agg(F.sum("nk").alias("nb"))
    return two.join(left, "a").join(right, "b").select("k", "nk", "na", "nb"), got["total"] or 1


def scores(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(doc_id, prose, links, n, named, n_known, mean_npmi, repeats, stuffed) of every page of two words or more.

    Counts come from all rows of docs (doc_id long, text); equal texts are read once and counted as often as they come. mean_npmi
    is null on a page without pairs of known words; neither a page nor its copies add to the counts that its mean is taken from.
    Null and blank texts and null ids give no row; rows that repeat doc_id and text are scored once; a doc_id with several texts
    has a row for each; other columns are not read.
    """
    ws = Workspace(docs.sparkSession, "spam")
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("same", F.unhex(F.md5("text")))
    texts = rows.groupBy("same").agg(F.first("text").alias("text"), F.count("*").alias("copies")).withColumn("page", F.monotonically_increasing_id())
    pages, _ = ws.write(texts.mapInArrow(_pages, PAGE))
    counts, total = pair_counts(pages)
    # A page's own share of each count, copies included.
    mine = lambda c: (F.col(c) * F.col("copies")).alias(c)
    x = pages.select("page", "copies", mine("n"), F.explode(F.arrays_zip("k", "v", "va", "vb", "kind")).alias("x")).select("page", "n", "x.k", "x.v", "x.va", "x.vb", "x.kind", "copies")
    x = x.select("page", "n", "k", "v", mine("va"), mine("vb"), mine("v").alias("own"), "kind").join(counts, "k")
    other, first, second, rest = F.col("nk") - F.col("own"), F.col("na") - F.col("va"), F.col("nb") - F.col("vb"), F.lit(total) - F.col("n")
    known = (F.col("kind") != BLANK) & (first >= rules.known) & (second >= rules.known)
    npmi = lambda n, a, b, total: F.log(n * total / (a * b)) / -F.log((n - 0.5) / total)
    apart = F.greatest(F.when(other > 0, npmi(other, first, second, rest)).otherwise(-1.0), F.lit(-1.0))
    whole_npmi = npmi(F.col("nk"), F.col("na"), F.col("nb"), F.lit(total))
    again = F.when((F.col("v") >= 3) & (F.col("kind") != BLANK), F.col("v") * F.least(F.greatest(whole_npmi, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    v, word, pair = F.col("v"), F.col("kind") != BLANK, F.col("kind") == CONTENT
    each = x.select("page", "v", F.when(word, v).otherwise(0).alias("named"), F.when(known, v).otherwise(0).alias("known"), F.when(known, v * apart).otherwise(0.0).alias("apart"), again.alias("again"), F.when(pair, again).otherwise(0.0).alias("tight"))
    by = each.groupBy("page").agg((F.sum("named") / F.sum("v")).alias("named"), F.sum("known").alias("n_known"), F.try_divide(F.sum("apart"), F.sum("known")).alias("mean_npmi"), (F.sum("again") / F.sum("v")).alias("repeats"), (F.sum("tight") / F.sum("v")).alias("stuffed"))
    whole = pages.select("same", "page", "prose", "links", "n").join(by, "page")
    return rows.where("doc_id is not null").select("doc_id", "same").distinct().join(whole, "same").select("doc_id", "prose", "links", "n", "named", "n_known", "mean_npmi", "repeats", "stuffed")


def flag(scored: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(doc_id, reason) of the pages that are spam; reason is 'links', 'repeats', 'stuffed' or 'salad'."""
    c = F.col
    bare = (c("prose") < rules.bare) & (c("named") > 0.5) & (c("n") >= rules.least_words)
    reason = F.when(c("links") >= rules.links, "links")
    reason = reason.when(bare & (c("repeats") >= rules.repeats_bare) | (c("prose") < rules.mixed) & (c("repeats") >= rules.repeats), "repeats")
    mean = F.when(c("n_known") >= rules.known_pairs, c("mean_npmi"))
    strange = F.when(mean < rules.coherent, c("stuffed") * (1 - mean))
    reason = reason.when((strange >= rules.stuffed) | (c("prose") < rules.loose) & (strange >= rules.stuffed_mixed), "stuffed")
    reason = reason.when((c("n") >= rules.least_words) & (mean < rules.salad), "salad")
    return scored.select("doc_id", reason.alias("reason")).where("reason is not null")
