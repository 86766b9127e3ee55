"""JSON text in plain Python without recursion, for documents of any depth.

Numbers stay the text they are, so no digit is lost. Of a key that is repeated the last value counts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any


class Number(str):
    """A number as it is written."""


_BLANK = re.compile(r"[ \t\r\n]*+")
_STRING = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
_TOKEN = re.compile(rf"([{{}}\[\],:])|({_STRING})|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+)(?![0-9A-Za-z.+\-])|(true|false|null)\b")
_CONSTANTS = {"true": True, "false": False, "null": None}


class SyntaxFault(ValueError):
    """What is wrong, and the position (from 0) where it is."""


def _fault(text: str, at: int) -> SyntaxFault:
    found = f"unexpected {json.dumps(text[at], ensure_ascii=False)}" if at < len(text) else "unexpected end"
    return SyntaxFault(f"{found} at position {at}")


def _refuse(name: str) -> Any:
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_float=Number, parse_int=Number, parse_constant=_refuse)


def loads(text: str) -> Any:
    """The document of a text: dict, list, str, Number, bool or None. Faults, and texts too deep for json, are left to _by_token()."""
    try:
        return _DECODER.decode(text)
    except (ValueError, RecursionError):
        return _by_token(text)


def _by_token(text: str) -> Any:
    at = _BLANK.match(text, 0).end()
    stack: list[Any] = []  # open containers, and the keys that their values are waited for
    keys: list[str | None] = []
    value: Any = None
    wanted = "value"  # value, first (value or end of array), key, first key, colon, next
    while True:
        m = _TOKEN.match(text, at)
        if m is None:
            raise _fault(text, at)
        token, done = m[1], False
        if wanted == "colon":
            if token != ":":
                raise _fault(text, at)
            wanted = "value"
        elif wanted == "next":
            if token == ",":
                wanted = "key" if isinstance(stack[-1], dict) else "value"
            elif token == ("}" if isinstance(stack[-1], dict) else "]"):
                done, value = True, stack.pop()
                keys.pop()
            else:
                raise _fault(text, at)
        elif wanted in ("key", "first key"):
            if m[2]:
                keys[-1], wanted = json.loads(m[2]), "colon"
            elif token == "}" and wanted == "first key":
                done, value = True, stack.pop()
                keys.pop()
            else:
                raise _fault(text, at)
        elif token == "{":
            stack.append({})
            keys.append(None)
            wanted = "first key"
        elif token == "[":
            stack.append([])
            keys.append(None)
            wanted = "first"
        elif token == "]" and wanted == "first":
            done, value = True, stack.pop()
            keys.pop()
        elif token:
            raise _fault(text, at)
        else:
            done = True
            value = json.loads(m[2]) if m[2] else Number(m[3]) if m[3] else _CONSTANTS[m[4]]
        at = _BLANK.match(text, m.end()).end()
        if done:
            if not stack:
                break
            if isinstance(stack[-1], dict):
                stack[-1][keys[-1]] = value
            else:
                stack[-1].append(value)
            wanted = "next"
    if at < len(text):
        raise _fault(text, at)
    return value


def fault(text: str) -> str | None:
    """Why a text is no JSON document, with the position; None if it is one."""
    try:
        loads(text)
    except SyntaxFault as e:
        return str(e)
    return None


class _Done(str):
    """Text that is written as it is."""


def dumps(value: Any) -> str:
    out: list[str] = []
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, _Done | Number):
            out.append(x)
        elif isinstance(x, dict):
            todo.append(_Done("}"))
            for i, (k, v) in enumerate(reversed(x.items())):
                todo.extend((_Done(","),) * bool(i))
                todo.extend((v, _Done(json.dumps(k) + ":")))
            todo.append(_Done("{"))
        elif isinstance(x, list):
            todo.append(_Done("]"))
            for i, v in enumerate(reversed(x)):
                todo.extend((_Done(","),) * bool(i))
                todo.append(v)
            todo.append(_Done("["))
        else:
            out.append(json.dumps(x))
    return "".join(out)


_PIECE = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\\?\Z)|[\[{]|[\]}]|[^"\[\]{}]++', re.S)
_SCALARS = re.compile(rf"(?:[\s,]*+(?:{_STRING}|-?[0-9]++(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+|true|false|null)(?=[\s,\"]|\Z))*+[\s,]*+")


def documents(text: str) -> Iterator[str]:
    """Objects and arrays that follow each other in a text; white space and commas may be between.

    Scalars between them reach nothing and are passed over. Anything else that is between them, and what is left where the
    text ends inside of a document, is given too, as a document that won't parse.
    """
    depth = begin = after = 0
    for m in _PIECE.finditer(text):
        c = m[0]
        if c in "[{":
            if not depth:
                begin = m.start()
                if not _SCALARS.fullmatch(text, after, begin):
                    yield text[after:begin].strip(" \t\r\n,")
            depth += 1
        elif c in "]}" and depth:
            depth -= 1
            if not depth:
                after = m.end()
                yield text[begin:after]
    if depth:
        yield text[begin:]
    elif not _SCALARS.fullmatch(text, after):
        yield text[after:].strip(" \t\r\n,")
