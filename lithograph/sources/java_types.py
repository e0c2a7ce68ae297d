"""Declarations of a Java source: types with their members, found by matching braces.

Comments and contents of literals are blanked first, with all offsets kept, so braces match
and texts can be cut from the source as it is.  One pass matches brackets of any depth; the
declarations of a body are then read from bracket to bracket, without recursion into code.
Classes inside method bodies are not looked for.
"""

from __future__ import annotations

import bisect
import re

import numpy as np

# Comments on lines that follow each other are one match.
_BLANKED = re.compile(r'/\*.*?(?:\*/|\Z)|//[^\n]*(?:\n[ \t]*//[^\n]*)*|"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'', re.S)
# What lies before is passed in one step; a pair with no bracket inside is one match.
_BRACKET = re.compile(r"[^(){}]*+(?:(\([^(){}]*+\)|\{[^(){}]*+\}|[{}()])|\Z)")
_STOP = re.compile(r"[^{}();=]*+[{}();=]")
_MODIFIER = re.compile(r"\s*(?:@(?!interface\b)\s*([\w.]+)\s*|(?:public|protected|private|static|final|abstract|default|synchronized|native|strictfp|transient|volatile|sealed|non-sealed)\b)")
_TYPE = re.compile(r"\s*(class|interface|enum|record(?=\s+\w+\s*[<(]))\s+(\w+)")
_CALLABLE = re.compile(r"\b(\w++)\s*+\(")
_FIELD = re.compile(r"\s*([\w.]+)\s*(?:<(.*)>)?((?:\s*\[\s*\])*)\s+(\w+)\s*(?:\[\s*\]\s*)*(?:,|$)", re.S)
_GENERIC = re.compile(r"\s*<[^(]*?>\s*")

TYPE_SCHEMA = (
    "struct<name: string, kind: string, depth: int, annotations: array<string>, header: string, line: int, members: array<struct<name: string, kind: string, "
    "annotations: array<string>, signature: string, text: string, targets: array<string>, line: int>>>"
)
FILE_SCHEMA = f"struct<package: string, imports: array<struct<name: string, line: int>>, annotations: array<string>, types: array<{TYPE_SCHEMA}>, error: string>"

# What ``translate`` makes of a text of ASCII characters alone: blanks and line breaks.
_BLANKS = {k: " " for k in range(128)} | {10: "\n"}


def blank(text: str) -> str:
    """Source with blanks for comments and contents of literals: lengths and line breaks are kept."""

    def clear(m: re.Match) -> str:
        if "\n" not in m[0]:
            empty = " " * len(m[0])
        else:
            empty = m[0].translate(_BLANKS) if m[0].isascii() else "\n".join(" " * len(line) for line in m[0].split("\n"))
        return m[0][0] + empty[1:-1] + m[0][-1] if m[0][0] in "\"'" else empty

    return _BLANKED.sub(clear, text)


def brackets(code: str) -> dict[int, int]:
    """Place of each opening brace or parenthesis -> place of the closing one."""
    out: dict[int, int] = {}
    held: dict[str, list[int]] = {"{": [], "(": []}
    for m in _BRACKET.finditer(code):
        found, end = m[1], m.end()
        if found is None:
            break
        if len(found) > 1:
            out[end - len(found)] = end - 1
        elif found in held:
            held[found].append(end - 1)
        elif stack := held["{" if found == "}" else "("]:
            out[stack.pop()] = end - 1
    return out


class Source:
    """A text, its blanked form and its matching brackets."""

    def __init__(self, text: str):
        self.text, self.code = text, blank(text)
        self.close = brackets(self.code)
        self.breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 10).tolist()

    def line(self, at: int) -> int:
        return bisect.bisect_left(self.breaks, at) + 1

    def declarations(self, lo: int, hi: int):
        """(start, opening brace or None, end) of the declarations directly in [lo, hi)."""
        start = at = lo
        assigned = False
        while m := _STOP.match(self.code, at, hi):
            at = m.end()
            i = at - 1
            found = self.code[i]
            if found == "(":
                at = self.close.get(i, hi) + 1
            elif found == "=":
                assigned = True
            elif found == "{":
                at = min(hi, self.close.get(i, hi) + 1)
                if not assigned:
                    yield self.begin(start, i), i, at
                    start = at
            elif found == ";":
                yield self.begin(start, i), None, at
                start, assigned = at, False

    def begin(self, start: int, end: int) -> int:
        while start < end and self.code[start].isspace():
            start += 1
        return start

    def modifiers(self, start: int, end: int) -> tuple[list[str], int]:
        """Names of the annotations a declaration begins with, and where its modifiers end."""
        names, at = [], start
        while m := _MODIFIER.match(self.code, at, end):
            at = m.end()
            if m[1]:
                names.append(m[1].split(".")[-1])
                if self.code[at : at + 1] == "(":
                    at = self.close.get(at, end) + 1
        return names, min(at, end)

    def parts(self, start: int, end: int) -> list[str]:
        """Arguments of a parameter list without their annotations, as code."""
        out, depth, last = [], 0, start
        for i in range(start, end):
            c = self.code[i]
            depth += (c in "(<") - (c in ")>")
            if c == "," and depth == 0:
                out.append((last, i))
                last = i + 1
        return [self.code[self.modifiers(a, b)[1] : b].strip() for a, b in [*out, (last, end)]]

    def member(self, start: int, brace: int | None, end: int, names: list[str], at: int) -> dict | None:
        """A method, constructor or field whose annotations and end of modifiers are known; None for anything else."""
        stop = end - 1 if brace is None else brace
        head = self.code[at:stop]
        call = _CALLABLE.search(head)
        equals = head.find("=")
        if call and not 0 <= equals < call.start():
            before = head[: call.start()]
            kind = "constructor" if not (_GENERIC.sub("", before) if "<" in before else before).strip() else "method"
            if kind == "constructor" and brace is None:
                return None
            opened = at + call.end() - 1
            closed = self.close.get(opened, stop)
            pieces = [self.text[start:at].strip(), " ".join(before.split()), call[1], self.text[opened : closed + 1], " ".join(self.code[closed + 1 : stop].split())]
            pieces.append(";" if brace is None else self.text[brace:end] if kind == "constructor" else "")
            targets = [m[1] for p in self.parts(opened + 1, closed) if (m := re.fullmatch(r"([A-Z]\w*)\s+\w+", p))] if kind == "constructor" else []
            return {"name": call[1], "kind": kind, "annotations": names, "signature": " ".join(p for p in pieces if p), "text": self.text[start:end], "targets": targets, "line": self.line(start)}
        field = _FIELD.match(head if equals < 0 else head[:equals]) if brace is None else None
        if not field:
            return None
        # The type itself, or the first plain argument of a generic one; none of an array or a dotted name.
        plain = [p for x in field[2].split(",") if re.fullmatch(r"\w+", p := x.strip())] if field[2] else [field[1]] if field[1].isidentifier() else []
        plain = [] if field[3] else [p for p in plain if p[0].isupper()]
        return {"name": field[4], "kind": "field", "annotations": names, "signature": "", "text": self.text[start:end], "targets": plain[:1], "line": self.line(start)}

    def types(self, declared: list[tuple[int, int | None, int]]):
        """Types among the declarations of a file, each followed by those nested in it; a body is gone through once for both its types and its members."""
        held: list[tuple[dict | None, bool, list, int]] = [(None, False, declared, 0)]
        found = []
        while held:
            owner, constants, declared, depth = held.pop()
            for start, brace, end in declared:
                names, at = self.modifiers(start, end if brace is None else brace)
                if brace is not None and (m := _TYPE.match(self.code, at, brace)):
                    tail = " ".join(self.text[m.end() : brace].split())
                    header = " ".join(p for p in (self.text[start:at].strip(), m[1], m[2], tail) if p)
                    one = {"name": m[2], "kind": m[1], "depth": depth, "annotations": names, "header": header, "line": self.line(start), "members": []}
                    found.append((start, one))
                    held.append((one, m[1] == "enum", list(self.declarations(brace + 1, end - 1)), depth + 1))
                elif constants:  # members follow an enumeration's constants
                    constants = brace is not None
                elif owner is not None and (x := self.member(start, brace, end, names, at)):
                    owner["members"].append(x)
        return [one for _, one in sorted(found, key=lambda f: f[0])]


def read(raw: bytes | str | None) -> dict:
    """Package, imports, all annotations and all types of a file (FILE_SCHEMA); a failure is told in ``error``."""
    out: dict = {"package": None, "imports": [], "annotations": [], "types": [], "error": None}
    if raw is None:
        return out | {"error": "no content"}
    try:
        source = Source(raw.decode("utf-8", "replace") if isinstance(raw, (bytes, bytearray)) else raw)
        declared = list(source.declarations(0, len(source.code)))
        for start, brace, end in declared:
            head = source.code[source.modifiers(start, end)[1] : end] if brace is None else ""
            if m := re.match(r"package\s+([\w.]+)\s*;", head):
                out["package"] = out["package"] or m[1]
            elif m := re.match(r"import\s+(?:static\s+)?([\w.]+?)(?:\s*\.\s*\*)?\s*;", source.code[start:end]):
                out["imports"].append({"name": m[1], "line": source.line(start)})
        marks = (m.split(".")[-1] for m in re.findall(r"@\s*(?!interface\b)([A-Za-z_][\w.]*)", source.code))
        out["annotations"] = list(dict.fromkeys(marks))
        out["types"] = source.types(declared)
    except Exception as error:  # noqa: BLE001  a file that cannot be read must not end the scan
        out["error"] = f"{type(error).__name__}: {error}"
    return out
