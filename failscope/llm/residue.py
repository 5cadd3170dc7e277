"""Problem 10: template residue, filler and error-page text.

Texts become messages (cues, or blocks of a text without cues). Numbers, dates, addresses, the slots
of templates and filler words are masked, and equal masked messages of all documents are grouped
by hash across sources, which shows how widely each recurs. Rules then classify the groups, each once:
slots, filler and strict phrases hold by themselves; loose phrases, which dialogue could also speak,
hold only where the message recurs in several documents of several sources. The documents of the
classified groups are the cases.

Scale: one narrow pass over the corpus, whose rows (document, hash, and the message where a task meets
a hash first) are stored once; the groups are an aggregation with map-side combine, so a message
that a third of all documents hold is one row a task. The classified groups meet the rows by a
broadcast while they are few (BROADCAST_GROUPS, counted), else by a shuffled join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.llm.subtitles import STYLING, cue_texts, fold_py
from failscope.session import checkpointed, require, stored, table

#: documents and sources in which a message must recur for a loose phrase to hold
RECUR_DOCS, RECUR_SOURCES = 3, 2
#: classified groups (a hash and a rule each) up to which they are broadcast
BROADCAST_GROUPS = 50_000
#: distinct messages whose hashes a task remembers before it forgets them all
MEMO = 400_000

SLOT, FILLED = "⟦slot⟧", "⟦filler⟧"
_NAME = r"[a-z#][\w.#]*"
#: slots of templates, in folded text: a name between paired signs
SLOTS = [
    r"\{\{[^{}]{1,80}\}\}", r"\{%[^{}%]{1,80}%\}", r"<%[^<>%]{1,80}%>", r"\[\[[^\[\]]{1,80}\]\]", rf"[$#%@]\{{\s*{_NAME}\s*\}}", rf"<<\s*{_NAME}\s*>>", rf"&lt;\s*{_NAME}\s*&gt;",
    rf"(?<!\w)__{_NAME}__(?!\w)", rf"@@{_NAME}@@", rf"%%{_NAME}%%", r"(?<![\w%])%[a-z][\w.#]*%(?![\w%])", r"(?<![\w$])\$[a-z_][\w.#]*\$(?!\w)",
    r"[<{\[]\s*[a-z]+(?:[._][a-z#][\w#]*)+\s*[>}\]]", fold_py(r"\[\s*(?:insert|enter|add)") + rf"\s+(?:\w+\s+)?{_NAME}" + fold_py(r"(?:\s+here)?\s*\]"), rf"\[\s*{_NAME}(?:\s+{_NAME})?\s+" + fold_py(r"goes\s+here\s*\]"),
]
_SLOTS = re.compile("|".join(f"(?:{p})" for p in SLOTS))
#: signs of which every slot holds one
_SIGNS = ("{", "<", "[", "__", "@@", "%", "$", "&lt;")

#: The words of the usual filler passages (Cicero, De finibus 1.32 and 1.33, as typesetters cut them).
FILLER = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam "
    "quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu "
    "fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "vero eos accusamus iusto odio dignissimos ducimus blanditiis praesentium voluptatum deleniti atque corrupti quos dolores quas molestias "
    "similique mollitia animi dolorum fuga harum quidem rerum facilis expedita distinctio nam libero tempore soluta nobis eligendi optio cumque nihil impedit quo minus "
    "quod maxime placeat facere possimus omnis voluptas assumenda repellendus temporibus autem quibusdam officiis debitis aut necessitatibus saepe eveniet voluptates "
    "repudiandae recusandae itaque earum hic tenetur a sapiente delectus reiciendis voluptatibus maiores alias perferendis doloribus asperiores repellat tempora fugit".split()
)
_FILLER = {fold_py(w) for w in FILLER if len(w) > 2}
#: filler words that no living language shares, of which every filler text holds one
_LATIN = [fold_py(w) for w in ("lorem", "ipsum", "dolor", "amet", "elit", "magna", "tempor", "aliqu", "laboris", "quidem", "rerum", "fugi", "minim", "voluptat")]
#: filler words of a message at least, and their share of its words
FILLER_WORDS, FILLER_SHARE = 3, 0.3
#: Words that speech in the usual languages can hardly do without.
_SPOKEN = {fold_py(w) for w in "the and you he she they was were is are into of to i der die das und ich ist der nicht que los las una por con para les des une dans pour nao não um uma com che una per della".split()}
#: Words that stand in for a text; a message of nothing else, with one of the first kind, is filler.
_DUMMY = {fold_py(w) for w in "sample dummy placeholder text test asdf asdfgh qwer qwerty foo bar baz xxx".split()}
_DUMMY_TOO = _DUMMY | {fold_py(w) for w in "example subtitle subtitles caption captions title line number name word words here goes your this is a".split()}
_LETTERS = re.compile(r"[^\W\d_]+")

_SCRIPT = r"(?:javascript|java script|scripts?|scripting)"
#: (words of which a message must hold one, pattern), in plain spelling; a message is matched after folding
STRICT = [
    # notices that scripts are required
    (["script"], rf"^(?:please )?(?:enable|activate|allow|turn on|switch on) {_SCRIPT}\b[^?]*\b(?:to|and)\b"),
    (["script"], rf"^{_SCRIPT} (?:is|are|seems? to be) (?:disabled|required|blocked|switched off|turned off)\b"),
    (["script"], rf"\b(?:page|site|player|content|application|app|browser|download|transcript|view\w*)\b[^?]*\b(?:requires?|needs?|without|not run|not support\w*) [^?]*{_SCRIPT}\b"),
    (["script"], rf"\b{_SCRIPT} (?:must|has to|have to|need to|needs to) be (?:allowed|enabled|on|switched on|turned on)\b"),
    (["script"], rf"^you (?:need|have|must) (?:to )?(?:enable|activate|allow|turn on|switch on) {_SCRIPT}\b"),
    (["script"], rf"^(?:bitte )?(?:aktivieren|erlauben) sie {_SCRIPT}\b"), (["script"], rf"^(?:por favor,? )?activ[ae] {_SCRIPT}\b"), (["script"], rf"^(?:veuillez )?activer? {_SCRIPT}\b"),
    (["script"], rf"^(?:por favor,? )?ativ[ae] o {_SCRIPT}\b"), (["script"], rf"^(?:si prega di )?(?:abilita|abilitare|attiva) {_SCRIPT}\b"), (["script"], rf"включите {_SCRIPT}\b"),
    # error pages
    (["#"], r"^(?:https? )?(?:error )?#:? ?(?:bad request|unauthorized|payment required|forbidden|not found|method not allowed|request timeout|gone|too many requests|internal server error|not implemented|bad gateway|service unavailable|gateway timeout)\b"),
    (["error #"], r"^(?:https? )?error #\b"), (["could not be"], r"\b(?:file|page|document|resource|address|url) could not be (?:found|located|loaded|opened)\b"), (["too many requests"], r"^too many requests\b"),
    (["connection"], r"^(?:database )?connection (?:failed|refused|timed out|reset)\b"), (["fatal error"], r"^fatal error: "), (["uncaught exception"], r"\buncaught exception in\b"), (["traceback"], r"^traceback \(most recent call last\)"),
    (["maintenance"], r"^(?:we are|we're|site is|the site is) (?:currently )?down for maintenance\b"), (["went wrong"], r"^(?:oops!? ?)?something went wrong\.? ?(?:please )?try again\b"),
    (["permission to"], r"^you (?:do not|don't) have permission to (?:access|view|open)\b"), (["your session"], r"^your session has (?:expired|timed out)\b"), (["proxy at"], r"^proxy at \S+$"),
    (["solicitada"], r"\bno se ha encontrado la p\S+ solicitada\b"), (["angeforderte"], r"^die angeforderte seite wurde nicht gefunden\b"), (["introuvable"], r"^le fichier demand\S+ est introuvable\b"),
    (["solicitada"], r"\ba p\S+ solicitada n\S+ foi encontrada\b"), (["richiesta"], r"\bla pagina richiesta non \S+ stata trovata\b"), (["запрошенная"], r"запрошенная страница не найдена"),
    # filler
    (["goes here"], r"^(?:your|the) (?:\w+ )+goes here\W*$"), (["here"], r"^(?:insert|enter|type) (?:\w+ )+here\W*$"), (["lorem ipsum"], r"^lorem ipsum dolor\b"), (["todo", "tbd", "fixme"], r"^(?:todo|tbd|fixme):?$"),
]
LOOSE = [
    (["denied"], r"\b(?:access|permission) denied\b[^?]*$"), (["not found"], r"\b(?:page|file) not found\b[^?]*$"), (["internal server error"], r"^internal server error\W*$"), (["request id"], r"^request id #$"),
]


def _folded(pattern: str) -> re.Pattern:
    """A pattern for folded text; it holds no digits and no escapes but \\b \\w \\W \\s \\S and escaped signs."""
    return re.compile(fold_py(pattern.replace(r"\W", "\u0002").replace(r"\S", "\u0003")).replace("\u0002", r"\W").replace("\u0003", r"\S"))


_RULES = [(rule, [fold_py(w) for w in words], _folded(p)) for rule, rows in (("strict", STRICT), ("loose", LOOSE)) for words, p in rows]

_ADDRESS = re.compile(r"(?i)\b(?:https?://|www\.)\S+|\b[\w.-]+@[\w.-]+\.\w+")
_NUMBER = re.compile(r"\b\d+(?:[.,:/-]\d+)*\b")


def is_filler(m: str) -> bool:
    """A folded message of filler words, or of words that stand in for a text."""
    if any(w in m for w in _DUMMY):
        ws = _LETTERS.findall(m)
        if len(ws) >= FILLER_WORDS and all(w in _DUMMY_TOO for w in ws) and any(w in _DUMMY for w in ws):
            return True
    if not any(w in m for w in _LATIN):
        return False
    ws = _LETTERS.findall(m)
    hits = sum(w in _FILLER for w in ws)
    return hits >= FILLER_WORDS and hits >= FILLER_SHARE * len(ws) and not any(w in _SPOKEN for w in ws)


def mask(m: str) -> str:
    """A folded message without styling, its template slots and filler masked."""
    if "<" in m or "{" in m:
        m = STYLING.sub(" ", m)
    m = " ".join(m.split()).lstrip("-–—>*♪ ")
    if any(x in m for x in _SIGNS):
        m = _SLOTS.sub(SLOT, m)
    return FILLED if is_filler(m) else m


def folded_messages(text: str) -> list[str]:
    """The messages of a text with numbers, dates and addresses masked and recognition errors folded; not yet by `mask`."""
    t = "\n".join(cue_texts(text))
    if "@" in t or "://" in t or "www." in t:
        t = _ADDRESS.sub("@", t)
    return fold_py(_NUMBER.sub("#", t)).split("\n")


def rule_of(m: str) -> str | None:
    """The rule that a masked message falls under: placeholder, filler, strict or loose."""
    if SLOT in m:
        return "placeholder"
    if m == FILLED:
        return "filler"
    for rule, words, pattern in _RULES:
        if any(w in m for w in words) and pattern.search(m):
            return rule
    return None


def _hash(m: str) -> bytes:
    return blake2b(m.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _message_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, source, h, m) of each distinct masked message of a text; m is null where the task has sent the message before."""
    memo: dict[str, bytes] = {}
    sent: set[bytes] = set()
    for b in batches:
        at: list[int] = []
        hashes: list[bytes] = []
        first: list[str | None] = []
        for i, text in enumerate(b.column(2).to_pylist()):
            if not text:
                continue
            own: set[bytes] = set()
            for raw in folded_messages(text):
                h = memo.get(raw)
                new = None
                if h is None:
                    m = mask(raw)
                    h = memo[raw] = _hash(m) if m else b""
                    if h and h not in sent:
                        sent.add(h)
                        new = m
                if not h or h in own:
                    continue
                own.add(h)
                at.append(i)
                hashes.append(h)
                first.append(new)
        if len(memo) > MEMO:
            memo.clear()
            sent.clear()
        place = pa.array(at, pa.int64())
        # lone surrogates can't be written as UTF-8
        texts = pa.array([None if x is None else x.encode("utf-8", "replace").decode() for x in first], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0).take(place), b.column(1).take(place), pa.array(hashes, pa.binary()), texts], names=["id", "source", "h", "m"])


def message_rows(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, h, m), stored: the masked messages of all documents by hash."""
    docs = require(documents, id_col, source_col, text_col)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return stored(docs.mapInArrow(_message_rows, f"id {kinds[id_col]}, source {kinds[source_col]}, h binary, m string"))


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rules = pa.array([rule_of(m) for m in b.column(1).to_pylist()], pa.string())
        keep = rules.is_valid()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), rules], names=["h", "message", "rule"]).filter(keep)


def classified_groups(rows: DataFrame) -> DataFrame:
    """(h, message, rule, n_docs, n_sources, recurs), checkpointed: the groups of equal messages that a rule knows, and how widely each recurs."""
    groups = rows.groupBy("h").agg(F.min("m").alias("m")).filter("m is not null")
    ruled = checkpointed(groups.mapInArrow(_classify, "h binary, message string, rule string"))
    hits = _of_groups(rows.select("id", "source", "h"), ruled.select("h", "rule"))
    spread = hits.groupBy("h", "id", "source").agg(F.count(F.lit(1)).alias("n")).groupBy("h", "source").agg(F.count_distinct("id").alias("n_docs")).groupBy("h").agg(F.sum("n_docs").alias("n_docs"), F.count(F.lit(1)).alias("n_sources"))
    out = ruled.join(spread, "h")
    return checkpointed(out.withColumn("recurs", (F.col("n_docs") >= RECUR_DOCS) & (F.col("n_sources") >= RECUR_SOURCES)))


def _of_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of the groups; the groups are broadcast only while they are few."""
    return rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups, "h")


def residue_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, rules): documents that hold at least one text of a template, filler or error page.

    Defined results: null, empty and blank texts are no cases; repeated rows of one id count once;
    a null source counts as one source; other columns are ignored; the whole text is read.
    """
    rows = message_rows(documents, id_col, text_col, source_col)
    holding = classified_groups(rows).filter("rule <> 'loose' or recurs").select("h", "rule")
    return _of_groups(rows.select("id", "h"), holding).groupBy(F.col("id").alias(id_col)).agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue_documents(table(spark, d, "documents")).select("doc_id")


def p10_messages(spark: SparkSession, d: str) -> DataFrame:
    """The recurring messages by rule, and how widely they recur."""
    return classified_groups(message_rows(table(spark, d, "documents"))).filter("recurs").select("rule", "message", "n_docs", "n_sources")


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    """Documents left after exclusion, per source."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "source").join(p10_found(spark, d), "doc_id", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))


QUERIES = {"p10_found": p10_found, "p10_messages": p10_messages, "p10_clean": p10_clean}
SQL: dict[str, str] = {}
