"""Running prose of a text in typesetting markup."""

from __future__ import annotations

import re

# Environments that hold no prose.
_CLOSED = "comment|verbatim|lstlisting|equation|align|eqnarray|gather|multline|math|displaymath|tabular|array|figure|table|thebibliography|tikzpicture|filecontents"
# Commands whose argument is no prose.
_ARGUMENT = "cite[a-z]*|[a-z]*ref|label|input|include|subfile|includegraphics|bibliography|bibliographystyle|usepackage|footnote|caption|title|author|date|thanks|vspace|hspace|url|newcommand|renewcommand|textbf|paragraph|(?:sub)*section|chapter|part"

_COMMENT = re.compile(r"%(?<!\\%)[^\n]*\n?[ \t]*")
# each alternative begins with a literal, so the search skips from one candidate to the next
_BLOCK = re.compile(
    rf"\\(?<!\\\\)(?:iffalse\b.*?(?:\\fi\b|\Z)|begin\s*\{{({_CLOSED})(\*?)\}}.*?(?:\\end\s*\{{\1\2\}}|\Z)|be\b.*?(?:\\ee\b|\Z)|\[.*?(?:\\\]|\Z)|\(.*?(?:\\\)|\Z)"
    rf"|(?:{_ARGUMENT})\*?(?![a-zA-Z])\s*(?:\[[^\]]*\]\s*)*\{{[^{{}}]*(?:\{{[^{{}}]*\}}[^{{}}]*)*(?:\}}|\Z))"
    r"|\$(?<!\\\$)(?:\$.*?(?:\$\$|\Z)|[^$]*(?:\$|\Z))|\{\\(?:bf|bfseries)\b[^{}]*\}\s*\\par\b",
    re.S,
)
_MARKUP = re.compile(r"\\(?:(?:begin|end)\s*\{[^}]*\}(?:\[[^\]]*\])?|[a-zA-Z@]+\*?|.)|\{|\}")
_BEGIN, _END = "\\begin{document}", "\\end{document}"


def prose(text: str | None) -> str:
    """The text without preamble, headings, captions, formulas, commands, drafts, comments, verbatim and bibliography.

    Blank lines between paragraphs stay. A part that is cut off ends with the text; a text that ends in its preamble has
    no prose; a fragment without preamble is taken whole. '' for null.
    """
    if not text:
        return ""
    # a line break before a comment sign doesn't escape it
    if "%" in text:
        text = _COMMENT.sub(" ", text.replace("\\\\", " "))
    at = text.find(_BEGIN)
    if at >= 0:
        text = text[at + len(_BEGIN) :]
        end = text.find(_END)
        text = text if end < 0 else text[:end]
    elif "\\documentclass" in text or "\\documentstyle" in text:
        return ""
    return _MARKUP.sub(" ", _BLOCK.sub(" ", text)).replace("~", " ")
