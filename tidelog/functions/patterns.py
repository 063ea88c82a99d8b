"""Regular expressions.

Rules use the linear-time dialect (no lookaround, no back-references) with an
unanchored search. Spark runs Java's engine; the few spellings that differ are
rewritten here once, when a rule is built.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.specs import require

# POSIX class names and their Java spelling.
POSIX = {
    "alnum": r"\p{Alnum}",
    "alpha": r"\p{Alpha}",
    "ascii": r"\p{ASCII}",
    "blank": r"\p{Blank}",
    "cntrl": r"\p{Cntrl}",
    "digit": r"\p{Digit}",
    "graph": r"\p{Graph}",
    "lower": r"\p{Lower}",
    "print": r"\p{Print}",
    "punct": r"\p{Punct}",
    "space": r"\s",
    "upper": r"\p{Upper}",
    "word": r"\w",
    "xdigit": r"\p{XDigit}",
}

_FORBIDDEN = re.compile(r"\(\?(?:=|!|<=|<!|>|#)")
# An escape, a POSIX class, a group opening, a repetition, or any single character.
_PIECE = re.compile(r"\\x\{\w+\}|\\[pP]\{\^?\w+\}|\\.|\[:\^?\w+:\]|\(\?P?<\w+>|\(\?[a-zA-Z-]+[:)]|\{\d+(?:,\d*)?\}|.", re.S)

# Letters that may be escaped outside of a class.
ESCAPES = "AbBzadDfnprPstSvwWx0"
# White space as the dialect has it; Java's adds the vertical tab.
BLANKS = r"\t\n\f\r "


def unquoted(pattern: str) -> str:
    """Text between ``\\Q`` and ``\\E`` with its special characters escaped instead; no end means to the end."""
    return re.sub(r"(\\[^Q])|\\Q(.*?)(?:\\E|$)", lambda m: m[1] or re.sub(r"[^\w\s]", r"\\\g<0>", m[2] or ""), pattern, flags=re.S)


def java_pattern(pattern: str) -> str:
    """Check ``pattern`` and return Java's spelling of it.

    Flags hold to the end of their group, so a stack carries whether ``^`` and
    ``$`` stand for lines there; both are spelled out and ``m`` never reaches
    Java, whose ``^`` skips a line that begins at the end of the text.
    """
    require(not _FORBIDDEN.search(unquoted(pattern)), f"pattern {pattern!r}: lookaround is not supported")
    out: list[str] = []
    lines = [False]  # of each open group, whether it is in lines mode
    in_class, repeated = False, False
    for match in _PIECE.finditer(unquoted(pattern)):
        piece, before = match.group(), repeated
        repeated = False
        if piece[0] == "\\":
            require(len(piece) > 1, f"pattern {pattern!r}: trailing backslash")
            require(in_class or piece[1] not in "123456789k", f"pattern {pattern!r}: back-reference")
            require(not piece[1].isascii() or not piece[1].isalnum() or piece[1] in ESCAPES or (in_class and piece[1].isdigit()), f"pattern {pattern!r}: unknown escape {piece}")
            require(not in_class or piece[1] not in "AbBz", f"pattern {pattern!r}: {piece} in a class")
            if piece[1] in "pP" and piece[3:4] == "^":
                piece = ("\\P" if piece[1] == "p" else "\\p") + "{" + piece[4:]
            if piece[2:3] == "{" and piece[1] in "pP" and len(piece) > 6:
                # Longer names are scripts, which Java marks.
                piece = piece[:3] + "Is" + piece[3:]
            blank = {r"\s": BLANKS if in_class else f"[{BLANKS}]", r"\S": f"[^{BLANKS}]", r"\v": r"\x0B"}
            piece = blank.get(piece, piece)
        elif piece.startswith("[:") and in_class:
            name = piece.strip("[:]^")
            require(name in POSIX, f"pattern {pattern!r}: unknown class {piece}")
            piece = POSIX[name] if "^" not in piece else POSIX[name].replace(r"\p", r"\P").replace(r"\s", r"\S").replace(r"\w", r"\W")
        elif in_class:
            first = out[-1] in ("[", "[^")
            if piece == "^" and out[-1] == "[":
                out[-1] = "[^"
                continue
            in_class = piece != "]" or first
            piece = "\\" + piece if piece in "[&" or (piece == "]" and first) else piece
        elif piece.startswith("[:"):
            # Outside of a class this opens one.
            out.append("[")
            piece, in_class = piece[1:-1] if piece.endswith("]") else piece[1:], not piece.endswith("]")
            piece = piece if in_class else piece + "]"
        elif piece == "[":
            in_class = True
        elif re.match(r"\(\?P?<", piece):
            lines.append(lines[-1])
            piece = "(?<" + piece[piece.index("<") + 1 :]
        elif piece.startswith("(?"):
            on, _, off = piece[2:-1].partition("-")
            require(set(on + off) <= set("ims"), f"pattern {pattern!r}: unknown flags {piece}")
            mode = (lines[-1] or "m" in on) and "m" not in off
            if piece[-1] == ":":
                lines.append(mode)
            else:
                lines[-1] = mode
            on, off = (flags.replace("m", "").replace("i", "iu") for flags in (on, off))
            flags = on + (f"-{off}" if off else "")
            piece = f"(?{flags}{piece[-1]}" if flags or piece[-1] == ":" else ""
        elif piece == "(":
            lines.append(lines[-1])
        elif piece == ")":
            require(len(lines) > 1, f"pattern {pattern!r}: unopened group")
            lines.pop()
        elif piece in "*+?" or piece[0] == "{":
            if piece == "{":
                piece = r"\{"
            elif piece == "?" and before:
                pass  # the lazy form of the repetition before it, itself no more to repeat
            else:
                repeated = True
            require(not before or piece in ("?", r"\{"), f"pattern {pattern!r}: a repetition of a repetition")
            if piece == "?" and before == "lazy":
                raise ValueError(f"pattern {pattern!r}: a repetition of a repetition")
            if piece == "?" and before:
                repeated = "lazy"
        elif piece == "$":
            piece = r"(?=\n|\z)" if lines[-1] else r"\z"
        elif piece == "^":
            piece = r"(?:\A|(?<=\n))" if lines[-1] else r"\A"
        out.append(piece)
    require(not in_class, f"pattern {pattern!r}: unclosed class")
    require(len(lines) == 1, f"pattern {pattern!r}: unclosed group")
    # (?d): only a line feed ends a line.
    java = "(?d)" + "".join(out)
    _compile(java, pattern)
    return java


def _compile(java: str, pattern: str) -> None:
    """Compile with the engine that will run it, if a session is up."""
    from pyspark import SparkContext

    context = SparkContext._active_spark_context
    if context is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(java)
        except Exception as error:
            raise ValueError(f"pattern {pattern!r}: {error}") from error


def _groups(pattern: str) -> list[str | None]:
    """The capturing groups in order, with their names."""
    found, in_class = [], False
    for match in _PIECE.finditer(pattern):
        piece = match.group()
        if in_class:
            in_class = piece != "]"
        elif piece == "[":
            in_class = True
        elif re.match(r"\(\?P?<\w+>", piece):
            found.append(piece[piece.index("<") + 1 : -1])
        elif piece == "(" and pattern[match.end() : match.end() + 1] != "?":
            found.append(None)
    return found


def _matches_empty(pattern: str) -> bool:
    """Whether some match may be empty; true when in doubt."""
    try:
        found = [re.search(pattern, probe) for probe in ("", "a", " ", "0", "\n")]
    except re.error:
        return True
    return any(m is not None and m.group() == "" for m in found)


def search(text: Column, pattern: str) -> Column:
    """Whether ``pattern`` is found anywhere in ``text``."""
    return F.rlike(text, F.lit(java_pattern(pattern)))


def literal_replacement(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def template_replacement(template: str, pattern: str) -> str:
    """Java's spelling of a template with ``$1``, ``$name``, ``${name}`` and ``$$``."""
    groups = _groups(unquoted(pattern))

    def part(match: re.Match) -> str:
        text = match.group()
        if text == "$$":
            return "\\$"
        if text == "$":
            return "\\$"
        if text[0] != "$":
            return literal_replacement(text)
        name = text.strip("${}")
        if name.isdigit():
            # Group n; a group that does not exist is empty.
            return f"${{__g{name}}}" if 0 < int(name) <= len(groups) else ("$0" if name == "0" else "")
        return f"${{{name}}}" if name in groups else ""

    return re.sub(r"\$\$|\$\{\w+\}|\$\w+|\$|[^$]+", part, template)


def _name_groups(pattern: str, template: str) -> tuple[str, str]:
    """Turn numbered references into named ones, so digits that follow stay text."""
    wanted = {int(n) for n in re.findall(r"\$\{__g(\d+)\}", template)}
    names = {i: name for i, name in enumerate(_groups(unquoted(pattern)), 1) if name}
    count, out, in_class = 0, [], False
    for match in _PIECE.finditer(pattern := unquoted(pattern)):
        piece = match.group()
        if piece == "[" or piece.startswith("[:"):
            in_class = in_class or piece == "["
        elif piece == "]":
            in_class = False
        elif not in_class and (piece == "(" or re.match(r"\(\?P?<\w+>", piece)):
            if not (piece == "(" and pattern[match.end() : match.end() + 1] == "?"):
                count += 1
                if count in wanted and piece == "(":
                    piece = f"(?P<zg{count}>"
        out.append(piece)
    for n in wanted:
        template = template.replace(f"${{__g{n}}}", f"${{{names.get(n, f'zg{n}')}}}")
    return "".join(out), template


def replace_all(text: Column, pattern: str, replacement: str, template: bool = True) -> Column:
    """Replace every match; ``template`` expands group references."""
    if template:
        pattern, java_text = _name_groups(pattern, template_replacement(replacement, pattern))
    else:
        java_text = literal_replacement(replacement)
    java = java_pattern(pattern)
    if _matches_empty(pattern):
        # Ignore an empty match right after the previous match.
        flag, body = java[:4], java[4:]
        java = rf"{flag}(?:{body})(?:(?!\G)|(?<![\s\S]))"
    return F.regexp_replace(text, F.lit(java), F.lit(java_text))
