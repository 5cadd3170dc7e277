"""Subtitle texts as messages: cues without their frames, numbers, times and styling."""

from __future__ import annotations

import re

_FRAMES = re.compile(r"\{\d+\}\{\d+\}")


def cue_texts(text: str) -> list[str]:
    """The texts of the cues of a file, or the blocks of a text without cues, in order; line breaks and bars inside a cue become blanks.

    Blank lines, lines of digits, times, headers and frame numbers stand between cues.
    """
    t = text.replace("\r\n", "\n").replace("\r", "\n").replace("|", "\n").replace("﻿", " ")
    if "}{" in t:
        t = _FRAMES.sub("\n\n", t)
    out: list[str] = []
    cue: list[str] = []
    for line in t.split("\n"):
        if not line or line.isspace() or "-->" in line or line.strip().isdigit() or line.lstrip()[:6] == "WEBVTT":
            if cue:
                out.append(" ".join(cue))
                cue = []
        else:
            cue.append(line)
    if cue:
        out.append(" ".join(cue))
    return out


def fold_py(s: str) -> str:
    """Lower case with the letters that character recognition mixes up made one (chained replacing is much faster than translate)."""
    return s.lower().replace("rn", "m").replace("’", "'").replace("c", "e").replace("i", "l").replace("1", "l").replace("0", "o")


#: styling in folded text: known tags and override codes; unknown tags stay, since they may be placeholders
STYLING = re.compile(
    "</?(?:" + "|".join(sorted({fold_py(t) for t in "i b u s c v p br hr em strong font ruby rt lang span div html head body title noscript center h1 h2 h3 h4 h5 h6".split()})) + r")(?:[ .][^<>]*)?/?>|\{\\[^{}]*\}|\{[a-z]:[^{}]*\}"
)
