"""Text of toy programs (`fun f0 ( ipt : W ^ 2 ) -> W ^ 1 { ... }`): layout, and indices within the arrays' sizes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD = re.compile(r"fun\s+f0\s*\(\s*ipt\s*:\s*W\s*\^\s*(\d+)\s*\)\s*->\s*W\s*\^\s*(\d+)\s*\{")
INDENT = "    "
#: What may stand between the braces and semicolons of a program, as tokens joined by blanks.
REF = r"(?:(?:ipt|scr|opt) \[ \d+ \]|[A-Za-z_]\w*)"
PLACE = r"(?:scr|opt) \[ \d+ \]"
SIMPLE = re.compile(rf"hlt|{PLACE} = (?:\d+|{REF}(?: [+*] {REF})?)")
GUARD = re.compile(rf"(ife|whl) {REF}")


def normal_indices(source: str) -> str:
    """The source with each index of ipt and opt taken modulo the array's size."""
    head = HEAD.search(source)
    if head is None:
        raise ValueError("a program begins with its function's head")
    sizes = {"ipt": int(head[1]), "opt": int(head[2])}
    within = lambda m: f"{m[1]}[{int(m[2]) % sizes[m[1]] if sizes[m[1]] else m[2]}]"
    return re.sub(r"\b(ipt|opt)\[(\d+)]", within, source)


def laid_out(source: str) -> str:
    """A program of blank-separated tokens, one statement a line, blocks indented, places written together."""
    tokens = " ".join(source.split())
    head = HEAD.match(tokens)
    if head is None or not tokens.endswith("}"):
        raise ValueError("a program is a function's head and a block in braces")
    lines, depth, wanted = [f"fun f0(ipt: W ^ {head[1]}) -> W ^ {head[2]} {{"], 1, [""]
    piece = ""
    for token in [*tokens[head.end() :].split(), ""]:
        if token not in ("{", "}", ";", ""):
            piece = f"{piece} {token}".strip()
            continue
        told = re.sub(r" \[ (\d+) \]", r"[\1]", piece)
        if token == "{" and (guard := GUARD.fullmatch(piece)):
            lines.append(f"{INDENT * depth}{told} {{")
            wanted.append("else" if guard[1] == "ife" else "")
            depth += 1
        elif token == "{" and not piece and wanted[-1] == "open":
            lines[-1] += " {"
            wanted[-1] = ""
            depth += 1
        elif token in ("}", ";") and (SIMPLE.fullmatch(piece) or not piece and lines[-1].strip() == "}"):
            lines += [INDENT * depth + told] if piece else []
            if token == ";":
                lines[-1] += ";"
            else:
                depth -= 1
                lines.append(INDENT * depth + "}")
                if wanted[-1] == "else":
                    wanted[-1] = "open"
                else:
                    wanted.pop()
        elif token or piece or depth:
            raise ValueError(f"{piece or 'nothing'!r} stands before {token or 'the end'!r}")
        piece = ""
    return "\n".join(lines)


@F.pandas_udf(T.StringType())
def program_text(sources: pd.Series) -> pd.Series:
    """Laid out and with indices in their bounds; null for a text that is no program."""

    def one(source: str | None) -> str | None:
        try:
            return normal_indices(laid_out(source)) if source is not None else None
        except ValueError:
            return None

    return sources.map(one)
