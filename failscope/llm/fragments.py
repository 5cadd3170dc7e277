"""Texts as sentence fragments, and the sorted search for fragments that lost their end.

A text splits into fragments at sentence ends and line breaks. Every fragment but an unterminated
last one is complete. With numbers and names masked, complete fragments recur all over a corpus, so
an unterminated tail that is a strict prefix of a complete fragment elsewhere, and equals none, was
cut. All masked strings are sorted; the strings that start with a tail follow it directly, so one
look at the next complete string answers for each tail.

Scale: strings are made distinct before sorting, the sort is a range partitioning (balanced by
sampling, no hot key), each task streams with a stack no deeper than a string is long, and what is
open at the end of a partition is settled from one string per partition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: words that keep their capital when names are masked, since sentences start with them
_STARTS = (
    "The|A|An|I|It|If|In|On|Of|At|To|For|From|By|With|When|While|After|Before|Between|Because|Since|So|But|And|Or|Not|No|Now|Then|There|This|That|These|Those|"
    "He|She|We|You|They|My|His|Her|Our|Their|Each|Every|All|Both|Only|One|As|What|Which|Who|How|Why|Where|Let|First|Next|Last|According|Step|Nothing|"
    "Der|Die|Das|Ein|Eine|El|La|Los|Las|Un|Una|Le|Les|Une|O|Os|As|Um|Uma"
)
_NUMBER = re.compile(r"\d+(?:[.,:]\d+)*")
_NAME = re.compile(rf"(?<![^\W_])(?!(?:{_STARTS})(?![^\W_]))[^\W\d_a-zа-яà-öø-ÿ][^\W_]*(?:['’-][^\W_]+)*")
_END = re.compile(r"(?<=[.?!…])[\"”’»)\]]*[ \t ]+|\n+")
_TERMINATED = re.compile(r"[.?!:;][\"'”’»)\]*_`]*$")
#: marks that writers leave where they cut
_MARK = re.compile(r"\s*(?:\.\.\.|…)?\s*[\[(<]\s*(?:cut|truncated|snip|clipped|omitted|output truncated|more)\s*[\])>]\s*$", re.I)

#: words after which no sentence ends
DANGLING = set(
    "a an the and or but nor of to in on at by for from with into onto than that which who whose because if when while as is are was were be been has have had will would "
    "can could should must may might its his her their our my your this these those not so very more each every between after before under over about "
    "der die das ein eine einen und oder aber von zu im am auf mit für dass weil wenn als ist sind war hat "
    "el la los las un una unos y o pero de del al en con por para que porque si cuando es son fue ha "
    "le les une des et ou mais du au dans avec pour qui parce quand est sont os um uma e mas do da no na em com".split()
)


def mask(s: str) -> str:
    """Numbers become #, capitalised words X, runs of white space one blank."""
    return " ".join(_NAME.sub("X", _NUMBER.sub("#", s)).split())


_START = re.compile(rf"(?:{_STARTS})(?![^\W_])")


def starts_sentence(s: str) -> bool:
    """The text starts with a capitalised function word and goes on."""
    return bool(_START.match(s)) and len(s.split()) > 1


def names(s: str) -> list[str]:
    """The words that mask would mask as names."""
    return _NAME.findall(s)


def last_name(tail: str) -> str | None:
    """The name at the very end of an unterminated tail, if one stands there."""
    t = tail.rstrip()
    found = None
    for m in _NAME.finditer(t):
        found = m
    return found.group() if found and found.end() == len(t) else None


def fragments(text: str) -> tuple[list[str], str | None]:
    """(complete fragments, the unterminated tail or None)."""
    parts = [p for p in _END.split(text) if p and not p.isspace()]
    if not parts:
        return [], None
    last = parts[-1].rstrip()
    if _TERMINATED.search(last) or text[-1:] == "\n":
        return parts, None
    return parts[:-1], last


def bare(s: str) -> str:
    """A fragment without its closing punctuation, as it stands in the bank."""
    return s.strip().rstrip(".?!…:;,\"'”’»)]*_` ")


def cut_mark(text: str) -> bool:
    """A mark of cutting stands at the end, or a broken character does."""
    t = text.rstrip()
    return bool(_MARK.search(t)) or t.endswith("�")


def dangling(tail: str) -> bool:
    """The tail ends in a word or sign after which no sentence ends."""
    t = tail.rstrip()
    if not t or t[-1] in ",(-–—/&+=“«":
        return bool(t) and t[-1] != "-"
    word = re.search(r"[^\W\d_]+$", t)
    return bool(word) and len(t.split()) >= 3 and word.group() in DANGLING


def open_stack(text: str) -> bool:
    """Pushdown scan of JSON, a literal or code: brackets or a string are open at the end."""
    stack: list[str] = []
    closes = {")": "(", "]": "[", "}": "{"}
    quote = ""
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if quote:
            if c == "\\":
                i += 2
                continue
            if c == quote:
                quote = ""
        elif c == '"' or (c == "'" and (i == 0 or not text[i - 1].isalnum())):
            quote = c
        elif c in "([{":
            stack.append(c)
        elif c in closes:
            if not stack or stack[-1] != closes[c]:
                return False  # not this grammar
            stack.pop()
        i += 1
    return bool(stack) or bool(quote)


_OPENS, _CLOSES = "([{“„«", {")": "(", "]": "[", "}": "{", "”": "“„", "“": "„", "»": "«"}


def open_prose(text: str) -> bool:
    """A quotation or bracket is open at the end of the last line of a text; closing signs without an opening one don't count."""
    stack: list[str] = []
    line = text.rstrip().rpartition("\n")[2]
    for i, c in enumerate(line):
        before = line[i - 1 : i]
        if c == '"':
            if '"' in stack:
                del stack[stack.index('"') :]
            elif not before.isalnum():  # else inches, or the end of a quotation of an earlier line
                stack.append(c)
        elif c in _CLOSES and stack and stack[-1] in _CLOSES[c]:
            stack.pop()
        elif c in _OPENS and not (c == "(" and before in (":", ";", "-")):
            stack.append(c)
    return bool(stack)


_FENCE = re.compile(r"^ {0,3}(```+|~~~+)(?=[^`\n]*$)", re.M)
_EMPTY_ITEM = re.compile(r"\n[ \t]*(?:[-*+•]|\d{1,3}[.)])[ \t]*$")
_STRONG = re.compile(r"(?<![\w*_\\])(\*\*\*?|__)(?=[^\s*_])|(?<=[^\s*_\\])(\*\*\*?|__)(?![\w*_])")


def after_fences(text: str) -> str | None:
    """What follows the last fence, None where a fence is open; all of a text without fences."""
    fence, end = "", 0
    for m in _FENCE.finditer(text):
        if not fence:
            fence = m.group(1)
        elif m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence):
            fence, end = "", m.end()
    return None if fence else text[end:]


def open_markup(text: str) -> bool:
    """Pushdown scan of a response: a fence, a list item, a strong passage or inline code of the last line, or a quotation or bracket is open at the end."""
    rest = after_fences(text)
    if rest is None or _EMPTY_ITEM.search(rest):
        return True
    line = rest.rstrip().rpartition("\n")[2]
    if line.count("`") % 2:
        return True
    line = re.sub(r"`[^`]*`", "Q", line)
    stack: list[str] = []
    for m in _STRONG.finditer(line):
        if m.group() in stack and (m.group(2) or m.group(1)):
            del stack[stack.index(m.group()) :]
        elif m.group(1):
            stack.append(m.group(1))
    return bool(stack) or open_prose(line)


_INFLECTION = re.compile(r"(?<=\w{2})(?:ings?|ers?|e[sd]|ly|[sdnr])$")


def word_forms(masked: str) -> set[str]:
    """The words of a masked fragment in lower case, and what is left of them without an ending of inflection."""
    ws = {w.lower() for w in re.findall(r"[^\W\d_]+", masked) if w != "X"}
    return ws | {_INFLECTION.sub("", w) for w in ws} | {_INFLECTION.sub("e", w) for w in ws}


#: words of a tail's end that are looked for inside complete fragments
END_WORDS = 4


_CITED = re.compile(r"“[^“”]*”|\"[^\"]*\"")
_END_START = re.compile(rf"(?<=[\w,;:–—][ ])(?:{_STARTS})$")


def end_name(tail: str) -> tuple[str, str | None]:
    """(the tail, its last name). A function word with a capital at the very end of a sentence is no start: it is a name or a part of one."""
    t = tail.rstrip()
    m = _END_START.search(t)
    if m is None or m.group() == "I":
        return t, last_name(t)
    return t[: m.start()] + "Xx", m.group() if len(m.group()) > 1 else None


def end_window(masked: str) -> str | None:
    """The last END_WORDS words of a longer masked tail, a quotation being one word; the last may be a part of a word."""
    ws = bare(_CITED.sub("Q", masked)).split(" ")
    return " ".join(ws[-END_WORDS:]) if len(ws) > END_WORDS else None


def windows(masked: str) -> list[str]:
    """All runs of END_WORDS + 1 words of a complete fragment. Where a fragment or a clause ends, the run ends too: what stands there may be an end."""
    ws = bare(_CITED.sub("Q", masked)).split(" ")
    out = [" ".join(ws[p : p + END_WORDS + 1]) for p in range(len(ws))]
    return out + [bare(" ".join(ws[max(0, p - END_WORDS + 1) : p + 1])) for p in range(len(ws)) if ws[p][-1:] in ",;:–—)”»"]


_SCHEMA = "kind string, pid int, s string"


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (s, is_bank) sorted by s, bank first: ('cut', s), and ('open', s) and ('head', s) at the edges."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    open_tails: list[str] = []
    last_bank = head = None
    for b in batches:
        cut: list[str] = []
        for s, is_bank in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            while open_tails and not s.startswith(open_tails[-1]):
                open_tails.pop()
            if is_bank:
                cut += open_tails
                open_tails.clear()
                last_bank = s
                head = s if head is None else head
            elif s != last_bank:
                open_tails.append(s)
        yield pa.RecordBatch.from_arrays([pa.array(["cut"] * len(cut), pa.string()), pa.array([pid] * len(cut), pa.int32()), pa.array(cut, pa.string())], names=["kind", "pid", "s"])
    rest = [("open", s) for s in open_tails] + ([("head", head)] if head is not None else [])
    yield pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in rest], pa.string()), pa.array([pid] * len(rest), pa.int32()), pa.array([s for _, s in rest], pa.string())], names=["kind", "pid", "s"]
    )


def strict_prefixes(tails: DataFrame, bank: DataFrame) -> DataFrame:
    """(s): the distinct tails that are strict prefixes of a bank string and equal none. Both have one column s."""
    rows = bank.select("s", F.lit(True).alias("is_bank")).unionByName(tails.select("s", F.lit(False).alias("is_bank")))
    rows = rows.filter(F.length("s") > 0).groupBy("s", "is_bank").agg(F.count(F.lit(1)).alias("n")).drop("n")
    parts = rows.repartitionByRange("s").sortWithinPartitions(F.col("s"), F.col("is_bank").desc())
    out = parts.mapInArrow(_adjacent, _SCHEMA)
    # what was open at the end of a partition is settled by the next partition's first bank string: a few rows a partition
    edge = Window.orderBy("pid", F.col("kind").asc()).rowsBetween(1, Window.unboundedFollowing)
    edges = out.filter(F.col("kind") != "cut").withColumn("next", F.first(F.when(F.col("kind") == "head", F.struct("pid", "s")), ignorenulls=True).over(edge))
    # a head of the same partition stands before the open tails of that partition, so only later ones follow
    settled = edges.filter((F.col("kind") == "open") & F.col("next.s").startswith(F.col("s"))).select("s")
    return out.filter(F.col("kind") == "cut").select("s").unionByName(settled).distinct()
