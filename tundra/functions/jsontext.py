"""JSON text of any depth: the standard reader where it can, an own stack where it would recurse too far."""

from __future__ import annotations

import json
import re

_PIECE = re.compile(r'[ \t\n\r]*([{}\[\],:]|"(?:[^"\\]|\\.)*+"|[^ \t\n\r{}\[\],:"]+)', re.S)


def loads(text: str) -> object:
    """The value of a whole JSON text, or ValueError."""
    try:
        return json.loads(text)
    except RecursionError:
        return _by_stack(text)


def _by_stack(text: str) -> object:
    top: list = []
    holders: list[list | dict] = [top]
    keys: list[str] = []  # of the objects that are open
    wants = {"value"}
    at = 0
    while m := _PIECE.match(text, at):
        at, t = m.end(), m[1]
        holder = holders[-1]
        if t in "{[" and "value" in wants:
            new: list | dict = {} if t == "{" else []
            _put(holder, keys, new)
            holders.append(new)
            wants = {"key", "}"} if t == "{" else {"value", "]"}
        elif t in "}]" and t in wants:
            holders.pop()
            if isinstance(holder, dict) and holder:
                keys.pop()
            wants = _after(holders)
        elif t == "," and "," in wants:
            wants = {"key"} if isinstance(holder, dict) else {"value"}
            if isinstance(holder, dict):
                keys.pop()
        elif t == ":" and ":" in wants:
            wants = {"value"}
        elif "key" in wants and t[0] == '"':
            keys.append(json.loads(t))
            holder[keys[-1]] = None
            wants = {":"}
        elif "value" in wants and t not in "{}[],:":
            _put(holder, keys, json.loads(t))
            wants = _after(holders)
        else:
            raise ValueError("no JSON")
    if text[at:].strip(" \t\n\r") or wants != {"end"}:
        raise ValueError("no JSON")
    return top[0]


def _put(holder: list | dict, keys: list[str], value: object) -> None:
    if isinstance(holder, dict):
        holder[keys[-1]] = value
    else:
        holder.append(value)


def _after(holders: list) -> set[str]:
    """What may follow a finished value."""
    return {"end"} if len(holders) == 1 else {",", "}" if isinstance(holders[-1], dict) else "]"}


def dumps(value: object) -> str:
    """JSON text of a value, as the standard writer gives it without escapes of letters."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        pass
    out: list[str] = []
    todo: list = [("", value)]
    while todo:
        before, v = todo.pop()
        out.append(before)
        if isinstance(v, dict) and v:
            todo.append(("}", _NOTHING))
            todo += [(("{" if i == 0 else ", ") + json.dumps(str(k), ensure_ascii=False) + ": ", x) for i, (k, x) in reversed(list(enumerate(v.items())))]
        elif isinstance(v, list) and v:
            todo.append(("]", _NOTHING))
            todo += [("[" if i == 0 else ", ", x) for i, x in reversed(list(enumerate(v)))]
        elif v is not _NOTHING:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)


_NOTHING = object()
