"""Chunkers as table functions: called laterally, a row of a table becomes the rows of its chunks.

Code is cut in one pass over its text: what stands between brackets and semicolons is a head, a stack holds the open ones. A type becomes a chunk of its
text with an index of its members, then each member a chunk. What is in strings and comments opens and closes nothing. Python has no brackets:
its declarations end where the indentation does. Texts without a declaration, and languages that aren't known, are one chunk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = "position int, chunk_type string, symbol string, container string, chunk string"

_TOKEN = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|@"(?:[^"]|"")*(?:"|\Z)|"(?:[^"\\\n]|\\.)*(?:"|\n|\Z)|'(?:[^'\\\n]|\\.)*(?:'|\n|\Z)|`(?:[^`\\]|\\.)*(?:`|\Z)|[{};]""", re.DOTALL)
_COMMENT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)", re.DOTALL)
_ATTRIBUTES = re.compile(r"^(?:\s*\[[^\]]*\])+\s*")
# Key words that begin declarations (fixed values).
_TYPES = {
    "csharp": re.compile(r"^(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|ref|file|unsafe|new)\s+)*(class|interface|record|struct|enum)\s+(?:(?:class|struct)\s+)?(\w+)"),
    "javascript": re.compile(r"^(?:(?:export|default|async)\s+)*(class|function)\s*\*?\s*(\w+)"),
    "typescript": re.compile(r"^(?:(?:export|default|async|declare|abstract|const)\s+)*(class|interface|enum|function|type)\s*\*?\s*(\w+)"),
}
_PYTHON = re.compile(r"^(\s*)(?:async\s+)?(class|def)\s+(\w+)")
_KINDS = {"type": "TypeAlias", "def": "Function"}
_SCRIPT_MEMBER = re.compile(r"^(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+|\*\s*)*(#?\w+)\s*(?:<[^>]*>)?\s*\(")
_NO_MEMBER = re.compile(r"^(?:return|throw|if|for|foreach|while|switch|using|lock|catch|else|do|try|event|delegate|case|new)\b")


def _member(language: str, container: str, head: str, ends: str) -> tuple[str, str] | None:
    """(chunk type, name) of the member that a head in a type's body declares, None if it is none. ends: what stands after the head, a bracket or a semicolon."""
    if language != "csharp":
        found = _SCRIPT_MEMBER.match(head) if ends == "{" else None
        return ("Method", found[1]) if found and not _NO_MEMBER.match(head) else None
    if not head or _NO_MEMBER.match(head):
        return None
    before, paren, _ = head.partition("(")
    if paren and "=" not in before:
        name = re.search(r"(~?\w+)\s*(?:<[^<>]*(?:<[^<>]*>[^<>]*)*>)?\s*$", before)
        if name is None:
            return None
        return ("Destructor", name[1][1:]) if name[1].startswith("~") else ("Constructor" if name[1] == container and len(before.split()) <= 2 + before.count("static") else "Method", name[1])
    body, arrow, _ = head.partition("=>")
    if ends == "{" and "=" not in head or arrow and "=" not in body:
        name = re.search(r"(\w+)\s*$", body)
        return ("Property", name[1]) if name and len(body.split()) > 1 else None
    return None


def _bracketed(text: str, language: str) -> Iterator[tuple]:
    """(kind, name, start, end, members) of the types that are in no other one; members as (kind, name, start, end)."""
    types = _TYPES[language]
    #: Open brackets: (what they are of, its kind, its name, where its text begins, members, where the head before it began).
    stack: list[tuple] = []
    begin = 0

    def head_of(end: int) -> tuple[int, str]:
        """Where the text before a bracket begins, comments and white space before it left out, and the head without comments and attributes."""
        at = begin
        while at < end:
            if text[at].isspace():
                at += 1
            elif (c := _COMMENT.match(text, at, end)) and c.end() > at:
                at = c.end()
            else:
                break
        return at, _ATTRIBUTES.sub("", _COMMENT.sub("", text[at:end]).strip())

    for token in _TOKEN.finditer(text):
        mark = token[0]
        if mark not in "{};" or len(mark) != 1:
            continue
        inside = stack[-1][0] if stack else "outer"
        if mark == "}":
            if stack:
                what, kind, name, start, members, before = stack.pop()
                if what == "type":
                    yield kind, name, start, token.end(), members
                elif what == "member" and stack:
                    stack[-1][4].append((kind, name, start, token.end()))
                begin = before if what == "inner" else token.end()
            else:
                begin = token.end()
            continue
        start, head = head_of(token.start())
        declared = types.match(head) if inside == "outer" else None
        if inside == "type":
            member = None if types.match(head) else _member(language, stack[-1][2], head, mark)
        if mark == ";":
            if declared:
                yield _KINDS.get(declared[1], declared[1].capitalize()), declared[2], start, token.end(), []
            elif inside == "type" and member:
                stack[-1][4].append((*member, start, token.end()))
            if inside != "inner":
                begin = token.end()
        elif declared and declared[1] == "type":
            # A type alias goes on to its semicolon.
            stack.append(("inner", None, None, start, [], begin))
        elif declared:
            stack.append(("type", _KINDS.get(declared[1], declared[1].capitalize()), declared[2], start, [], begin))
            begin = token.end()
        elif inside == "type" and member and "=>" not in head:
            stack.append(("member", *member, start, [], begin))
            begin = token.end()
        elif inside == "inner" or "=" in head:
            # A bracket within a statement: the statement goes on after it.
            stack.append(("inner", None, None, start, [], begin))
        else:
            stack.append(("outer" if inside == "outer" else "body", None, None, start, [], begin))
            begin = token.end()
    # What is still open ends with the text; the outermost type holds the others' members.
    while stack:
        what, kind, name, start, members, _ = stack.pop()
        if what == "type":
            yield kind, name, start, len(text), members
        elif what == "member" and stack:
            stack[-1][4].append((kind, name, start, len(text)))


def _indented(text: str) -> Iterator[tuple]:
    """(kind, name, start, end, members) of Python's outermost classes and functions; they have no members of their own here."""
    at, opened = 0, None
    for line in text.splitlines(keepends=True):
        depth = len(line) - len(line.lstrip())
        if line.strip() and opened and depth <= opened[2]:
            yield *opened[:2], opened[3], opened[4], []
            opened = None
        if opened is None and (found := _PYTHON.match(line)):
            opened = [_KINDS.get(found[2], found[2].capitalize()), found[3], depth, at + len(found[1]), at]
        if opened and line.strip():
            opened[4] = at + len(line.rstrip())
        at += len(line)
    if opened:
        yield *opened[:2], opened[3], opened[4], []


def code_units(text: str | None, language: str | None) -> Iterator[tuple]:
    """Rows of CHUNK of a source text: each type with its members' index, then each of its members; one File chunk where there is none, for null an empty one."""
    text, language = text or "", (language or "").lower()
    found = _bracketed(text, language) if language in _TYPES else _indented(text) if language == "python" else ()
    n = 0
    for kind, name, start, end, members in sorted(found, key=lambda x: (x[2], -x[3])):
        whole = text[start:end]
        # The index's form is a fixed value.
        index = "\n// members:\n" + "\n".join(f"// {k}: {m}" for k, m, _, _ in members) if members else ""
        yield n, kind, name, None, whole + index
        n += 1
        for member_kind, member, a, b in members:
            yield n, member_kind, member, name, text[a:b]
            n += 1
    if not n:
        yield 0, "File", None, None, text


class _CodeUnits:
    def eval(self, text: str, language: str) -> Iterator[tuple]:
        yield from code_units(text, language)


#: The table function code_units(text, language).
CodeUnits = F.udtf(_CodeUnits, returnType=CHUNK)


def code_chunks(docs: DataFrame, id_col: str = "document_id", text_col: str = "content", language_col: str = "language") -> DataFrame:
    """(id, position, chunk_type, symbol, container, chunk) of source texts by their language; each text has one chunk at least. Other columns are not read."""
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"), F.col(language_col).alias("language_"))
    cut = rows.lateralJoin(CodeUnits(F.col("text_").outer(), F.col("language_").outer()))
    return cut.select(F.col("id_").alias(id_col), "position", "chunk_type", "symbol", "container", "chunk")
