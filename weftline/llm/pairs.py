"""Broken question-answer pairs: empty, truncated, refusing, copying or foreign answers."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import completeness, languages

#: The refusal grammar. An answer refuses if every sentence is a decline, an excuse or a courtesy and one is a decline.
DECLINES = (
    r"\b(?:can ?not|can't|cant|could not|couldn't|won't|will not|wouldn't|am (?:not able|unable)|'m (?:not able|unable)|not able|unable|must not|may not|refuse|decline|rather not|prefer not)\b.*\b(?:help|assist|answer|solve|solving|provid\w*|giv\w+|respond|reply|work|do|task|request|comply|that|this|discuss|continue|share)\b",
    r"\b(?:decline|must pass on|pass on the question|have to refuse|must refuse|not going to answer)\b",
    r"\b(?:outside|beyond) (?:of )?what i (?:am|'m) (?:permitted|allowed|able)\b",
    r"\bagainst (?:my|our|the) (?:guidelines|policy|policies|rules|principles)\b",
    r"\bno (?:response|answer|solution) can be (?:given|provided|offered)\b",
    r"\bnot (?:permitted|allowed) to\b",
    r"\b(?:kann|darf|möchte|werde|muss)\b.*\b(?:nicht|keine?n?)\b.*\b(?:helfen|antwort\w*|beantworten|lösen|geben|bearbeiten|erfüllen)\b",
    r"\b(?:kann|darf|möchte|werde|muss)\b.*\b(?:ablehnen|verweigern)\b|\bdabei kann ich nicht\b|\blehne\b.*\bab\b",
    r"\bne (?:peux|puis|suis|veux|pourrai)\b.*\b(?:pas|en mesure)\b|\bm'est interdit\b|\b(?:dois|préfère) (?:décliner|refuser)\b|\bne m'est pas permis\b|\brefuse de\b",
    r"\bno (?:puedo|podré|debo|quiero|voy a)\b.*\b(?:ayudar|responder|resolver|contestar|dar|atender)\w*\b|\bno (?:me )?est[áa] permitido\b|\bdebo (?:rechazar|declinar)\b|\btengo que (?:rechazar|declinar)\b",
    r"\bnon (?:posso|possiamo|sono in grado|mi è permesso)\b.*\b(?:aiutar\w*|risponder\w*|risolver\w*|dare|fornir\w*)\b|\bdevo (?:rifiutare|declinare)\b",
    r"\bnão (?:posso|podemos|consigo|me é permitido)\b.*\b(?:ajud\w*|respond\w*|resolv\w*|dar|fornecer)\b|\b(?:devo|preciso) (?:recusar|declinar)\b",
    r"(?:答え|回答|お手伝い|お答え)(?:することは|は)?(?:でき|いたしかね)(?:ません|ない|ます)|답변(?:할 수 없|드릴 수 없)|\bnie mogę\b.*\b(?:pomóc|odpowiedzieć|rozwiązać)\b|\bkan (?:ik )?niet\b.*\b(?:helpen|beantwoorden)\b",
    r"无法(?:回答|帮助|提供)|不能(?:回答|帮助|提供)|抱歉|не могу (?:помочь|ответить)|вынужден отказаться",
)
COURTESIES = (
    r"^(?:i'?m |i am |we are |my )?(?:so |very )?(?:sorry|apologies|regrettably|unfortunately)\b",
    r"^(?:thank you|thanks)\b|^please\b|^let me know\b|^is there (?:another|anything)\b|^consider\b|^feel free\b|^perhaps\b|^maybe\b|^i hope\b|^as an?\b.*\b(?:assistant|model|ai)\b",
    r"^(?:es tut mir leid|tut mir leid|leider|entschuldigung|bitte|vielen dank|danke|vielleicht|gern)\b",
    r"^(?:je suis désolé|désolé|malheureusement|merci|veuillez|n'hésitez|peut-être|pardon)",
    r"^(?:posez|essayez|demandez|prueba|pruebe|intenta|intente|haz|pregunta|stelle|stellen sie|versuche|frage|try|ask)\b",
    r"^(?:mi dispiace|purtroppo|grazie|prego|desculpe|lamento|infelizmente|obrigad[oa]|przykro mi|przepraszam|helaas|申し訳|すみません|죄송)",
    r"^(?:lo siento|lamentablemente|desafortunadamente|gracias|por favor|perdón|quizás|disculp)",
)
_DECLINE = re.compile("|".join(DECLINES), re.I)
_COURTESY = re.compile("|".join(COURTESIES), re.I)
_SENTENCE = re.compile(r"[^.!?。！？\n]+[.!?。！？]*")
_NOTE = re.compile(r"^[\W_]*(?:note|hinweis|remarque|nota|answer|antwort|réponse|respuesta)\s*:?[\W_]*:?\s*", re.I)
_WORD = re.compile(r"[^\W_]+")


#: What an answer works with, other than the number by which a refusal names its task; a formula is masked by a dollar sign before sentences are split.
_FORMULA = re.compile(r"\\\(.*?\\\)|\\\[.*?\\\]|\$\$.*?\$\$|\$[^$]*\$", re.S)
_TASK = re.compile(r"\b(?:problems?|questions?|exercises?|tasks?|items?|numbers?|aufgaben?|fragen?|übung|problèmes?|exercices?|problemas?|preguntas?|ejercicios?)\s*(?:(?:number|no|nr|num|nummer|numéro|número)\b\.?\s*)?#?\s*\d+", re.I)
_WORKED = re.compile(r"\\\(|\$|=|\d{2,}")
#: A decline may name a formula or number if it is in the first person, starts before that and comes to no result.
_MINE = re.compile(r"\b(?:i|i'm|ich|je|puedo|podré|debo|quiero|tengo)\b", re.I)
_RESULT = re.compile(r"\b(?:but|however|so|thus|hence|therefore|aber|also|daher|mais|donc|pero|luego)\b|(?<!what )\b(?:gives|equals|is|are|ist|sind|est|sont|es|son)\s*[:(]?\s*[-\d$]", re.I)


def _declining(sentence: str) -> bool | None:
    """True for a decline, False for a courtesy, None for a sentence that is neither or works on the question."""
    sentence = _TASK.sub("task", sentence)
    worked = _WORKED.search(sentence)
    if m := _DECLINE.search(sentence):
        return True if not worked or (worked.start() > m.start() and _MINE.search(sentence) and not _RESULT.search(sentence, m.start())) else None
    return False if _COURTESY.search(sentence) and not worked else None


def refuses(answer: str) -> bool:
    """Whether an answer only declines to answer, at any length; one that works on the question does not, whatever its first words."""
    text = _NOTE.sub("", completeness.bare(answer)).replace("’", "'").replace("**", "")
    text = re.sub(r"(?<=\d)\.(?=\d)|(?<=\bno)\.(?=\s*\d)|(?<=\bnr)\.(?=\s*\d)", " ", _FORMULA.sub(" $ ", text), flags=re.I)
    some = False
    for s in _SENTENCE.findall(text):
        if not (_WORD.search(s) or "$" in s):
            continue
        if (kind := _declining(s.strip())) is None:
            return False
        some = some or kind
    return some


def tiles(a: list[str], b: list[str], least: int = 3) -> int:
    """Words of a covered by greedy string tiling with b: the longest common runs of unmarked words first, none under `least` words.

    Runs grow from equal groups of `least` words, from the ends of the texts backwards, so that a round looks at each pair of equal groups once.
    """
    used_a, used_b = bytearray(len(a)), bytearray(len(b))
    at: dict[tuple, list[int]] = {}
    for j in range(len(b) - least + 1):
        at.setdefault(tuple(b[j : j + least]), []).append(j)
    covered = 0
    while True:
        best, found, after = least, [], {}
        for i in range(len(a) - least, -1, -1):
            here: dict[int, int] = {}
            if not any(used_a[i : i + least]):
                for j in at.get(tuple(a[i : i + least]), ()):
                    if not any(used_b[j : j + least]):
                        run = here[j] = after[j + 1] + 1 if j + 1 in after else least
                        if run > best:
                            best, found = run, [(i, j)]
                        elif run == best:
                            found.append((i, j))
            after = here
        if not found:
            return covered
        for i, j in found:
            if not any(used_a[i : i + best]) and not any(used_b[j : j + best]):
                used_a[i : i + best] = used_b[j : j + best] = b"\1" * best
                covered += best


def _ends(a: list[str], b: list[str]) -> int:
    """Words in the common beginning and end of two texts: a tiling by itself, found in one pass."""
    n = min(len(a), len(b))
    k = next((i for i in range(n) if a[i] != b[i]), n)
    m = next((i for i in range(n - k) if a[-1 - i] != b[-1 - i]), n - k)
    return (k if k >= 3 else 0) + (m if m >= 3 else 0)


def copies(question: str, answer: str, share: float = 0.85) -> bool:
    """Whether an answer gives back the question and nothing else: tiles cover `share` of the words of both.

    The words they have in common bound what tiles can cover, so pairs that share too few are not tiled.
    """
    q, a = _WORD.findall(question.lower()), _WORD.findall(answer.lower())
    if len(a) < 4 or len(q) < 4:
        return bool(q) and q == a
    both = sum((Counter(q) & Counter(a)).values())
    if both < share * len(q) or both < share * len(a):
        return False
    n = _ends(a, q)
    if n < share * max(len(a), len(q)):
        n = tiles(a, q)
    return n >= share * len(a) and n >= share * len(q)


def other_language(question: str, answer: str) -> bool:
    """Whether an answer is in a language other than the question's; texts too short to tell, numbers and formulas have none."""
    q, a = languages.language(question), languages.language(answer)
    return q is not None and a is not None and q != a


def defect(question: str | None, answer: str | None) -> str | None:
    """The defect of a pair, but for truncation: the first of 'empty_answer', 'refusal', 'copies_question' and 'other_language' that holds."""
    if completeness.is_stand_in(answer):
        return "empty_answer"
    if refuses(answer):
        return "refusal"
    if question is not None and copies(question, answer):
        return "copies_question"
    if question is not None and other_language(question, answer):
        return "other_language"
    return None


def defects(rows: DataFrame, id_col: str = "id", source_col: str = "dataset", question: str = "question", answer: str = "answer") -> DataFrame:
    """(id, defect) of every unusable pair, at most one for each row.

    Truncation is judged as in completeness over all answers; a pair has it only if it has no other defect. A repeated id with equal
    texts counts once. A null question leaves the answer to be judged alone.
    """
    def run(batches):
        for batch in batches:
            ids, qs, answers = (c.to_pylist() for c in batch.columns)
            out = [(i, d) for i, q, a in zip(ids, qs, answers) if (d := defect(q, a))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.string()), pa.array([d for _, d in out], pa.string())], names=["id", "defect"])

    pair = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(question).cast("string"), F.col(answer).cast("string"))
    plain = pair.mapInArrow(run, "id string, defect string")
    values = completeness.judged(rows, {answer: question}, id_col, source_col)
    cut = completeness.settle(values).where("cut").select("id", F.lit("truncated_answer").alias("defect"))
    # The rank keeps one defect a row without a second join: truncation comes last.
    both = plain.unionByName(cut).withColumn("rank", F.when(F.col("defect") == "truncated_answer", 1).otherwise(0))
    return both.groupBy("id").agg(F.min(F.struct("rank", "defect")).alias("d")).select("id", F.col("d.defect").alias("defect"))
