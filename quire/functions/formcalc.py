"""Calculations that documents carry: field formulas, form calculations, number formats, calculator functions.

A reader for the small language that fields' formulas are written in; nothing is
executed. What it cannot read is left alone and reported.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from typing import Any

_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+\.?\d*|\.\d+)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_$][\w$]*(?:\[\*\])?)|(?P<op>[-+*/%(),.\[\]]))""")
_VALUE = re.compile(r"event\.value\s*=\s*(.*?);?\s*\Z", re.S)
_SIMPLE = re.compile(r"AFSimple_Calculate\(\s*[\"'](\w+)[\"']\s*,\s*(?:new\s+Array\s*)?[\[(](.*?)[\])]\s*\)", re.S)
_FORMAT = re.compile(r"AF(Number|Percent)_Format\(\s*(\d+)")


class Unreadable(ValueError):
    """A formula in words that this reader does not know."""


def number(v: Any) -> float:
    """As a number: decorated text gives what reads as one, else 0."""
    if isinstance(v, int | float):
        return float(v)
    m = re.match(r"-?\d*\.?\d+|-?\d+", re.sub(r"[^0-9.\-]", "", str(v)))
    return float(m.group()) if m else 0.0


class _Reader:
    def __init__(self, text: str, field: Callable[[str], Any], functions: dict[str, Callable]):
        self.tokens, i = [], 0
        while i < len(text.rstrip()):
            m = _TOKEN.match(text, i)
            if not m:
                raise Unreadable(text[i : i + 20])
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            i = m.end()
        self.i, self.field, self.functions = 0, field, functions

    def peek(self) -> str:
        return self.tokens[self.i][1] if self.i < len(self.tokens) else ""

    def take(self, want: str = "") -> tuple[str, str]:
        if self.i >= len(self.tokens) or (want and self.peek() != want):
            raise Unreadable(f"{want or 'more'} expected")
        self.i += 1
        return self.tokens[self.i - 1]

    def sum(self) -> Any:
        v = self.product()
        while self.peek() in ("+", "-"):
            _, op = self.take()
            w = self.product()
            if op == "+" and isinstance(v, str) and not re.fullmatch(r"\s*-?\d*\.?\d+\s*", v):
                v = v + (w if isinstance(w, str) else show(w))
            else:
                v = number(v) + number(w) if op == "+" else number(v) - number(w)
        return v

    def product(self) -> Any:
        v = self.sign()
        while self.peek() in ("*", "/", "%"):
            _, op = self.take()
            a, b = number(v), number(self.sign())
            v = a * b if op == "*" else 0.0 if b == 0 else a / b if op == "/" else math.fmod(a, b)
        return v

    def sign(self) -> Any:
        if self.peek() in ("-", "+"):
            _, op = self.take()
            v = number(self.sign())
            return -v if op == "-" else v
        return self.atom()

    def atom(self) -> Any:
        kind, t = self.take()
        if kind == "number":
            return float(t)
        if kind == "string":
            return re.sub(r"\\(.)", r"\1", t[1:-1])
        if t == "(":
            v = self.sum()
            self.take(")")
            return v
        if kind != "name":
            raise Unreadable(t)
        while self.peek() == ".":
            self.take()
            t += "." + self.take()[1]
        if self.peek() == "(":
            self.take()
            args = []
            while self.peek() != ")":
                args.append(self.sum())
                if self.peek() == ",":
                    self.take()
            self.take(")")
            if t in ("getField", "this.getField") and args:
                while self.peek() == ".":
                    self.take()
                    self.take()
                return self.field(str(args[0]))
            if t not in self.functions:
                raise Unreadable(t)
            return self.functions[t](*args)
        if "." in t or self.functions is _SCRIPT:
            raise Unreadable(t)
        return self.field(t)


def show(v: Any) -> str:
    """A value as text: whole numbers without a point."""
    if isinstance(v, str):
        return v
    return str(int(v)) if float(v).is_integer() and abs(v) < 1e15 else repr(float(v))


def half_up(x: float) -> float:
    return math.floor(x + 0.5)


_SCRIPT: dict[str, Callable] = {
    "Math.round": lambda x: half_up(number(x)),
    "Math.floor": lambda x: math.floor(number(x)),
    "Math.ceil": lambda x: math.ceil(number(x)),
    "Math.abs": lambda x: abs(number(x)),
    "Math.min": lambda *a: min(map(number, a)),
    "Math.max": lambda *a: max(map(number, a)),
    "Number": number,
    "parseFloat": number,
    "parseInt": lambda x, *_: math.trunc(number(x)),
}


def _product(values: list[float]) -> float:
    return math.prod(values) if values else 0.0


_SIMPLE_OPS: dict[str, Callable[[list[float]], float]] = {"SUM": sum, "AVG": lambda v: sum(v) / len(v) if v else 0.0, "PRD": _product, "MIN": lambda v: min(v, default=0.0), "MAX": lambda v: max(v, default=0.0)}


def calculate(script: str, values: dict[str, Any]) -> Any:
    """A field formula's value: event.value = expression, or AFSimple_Calculate over named fields."""
    if m := _SIMPLE.search(script):
        names = [a or b for a, b in re.findall(r"\"([^\"]*)\"|'([^']*)'", m[2])]
        names = [x.strip() for n in names for x in n.split(",")]
        if m[1] not in _SIMPLE_OPS:
            raise Unreadable(m[1])
        return float(_SIMPLE_OPS[m[1]]([number(values.get(n, 0)) for n in names]))
    m = _VALUE.search(script.strip())
    if not m:
        raise Unreadable(script[:40])
    r = _Reader(m[1], lambda n: values.get(n, ""), _SCRIPT)
    v = r.sum()
    if r.i < len(r.tokens):
        raise Unreadable(r.peek())
    return v


def formatted(v: Any, script: str) -> str:
    """A value with as many decimals as its format says."""
    m = _FORMAT.search(script or "")
    if not m or isinstance(v, str):
        return show(v)
    digits = int(m[2])
    scaled = half_up(abs(v) * 10**digits) / 10**digits
    return f"{'-' if v < 0 and scaled else ''}{scaled:.{digits}f}"


def _typed(v: Any) -> Any:
    """What a script sees as a field's value: a number where the text is one."""
    return float(v) if isinstance(v, str) and re.fullmatch(r"\s*[-+]?(?:\d+\.?\d*|\.\d+)\s*", v) else v


def scripted(name: str, script: str, values: dict[str, Any]) -> Any:
    """The value that a script gives its field, run in the sandbox; other fields that it sets are set in values.

    The script sees event (value, name), getField and this.getField, and the simple calculations."""
    from quire.functions.script import run

    seen: dict[str, dict[str, Any]] = {}

    def get(n: str) -> Any:
        return seen.setdefault(n, {"name": n, "value": _typed(values[n])}) if n in values else None

    event: dict[str, Any] = {"value": _typed(values.get(name, "")), "name": name}

    def simple(kind: str, names: Any) -> None:
        listed = [str(x).strip() for n in (names if isinstance(names, list) else [names]) for x in str(n).split(",")]
        event["value"] = float(_SIMPLE_OPS[kind]([number(values.get(n, 0)) for n in listed]))

    got = run(script, {"event": event, "getField": get, "this": {"getField": get}, "AFSimple_Calculate": simple, "AFMakeNumber": lambda v: number(v)})
    if got["error"]:
        raise Unreadable(got["error"])
    for n, x in seen.items():
        if n != name and isinstance(x["value"], str | float) and x["value"] != _typed(values[n]):
            values[n] = show(x["value"])
    v = event["value"]
    if isinstance(v, bool) or not isinstance(v, str | int | float) or isinstance(v, float) and not math.isfinite(v):
        raise Unreadable("no text or number")
    return v


def recalculated(fields: list[dict], order: list[int]) -> tuple[dict[str, str], list[str]]:
    """Values by name after all formulas, in the given order of objects (else twice in file order), and the names skipped.

    What is no simple formula is run as a script."""
    values = {f["name"]: f["value"] for f in fields}
    by = {f["obj"]: f for f in fields if f["calc"]}
    todo = [by[o] for o in order if o in by] if order else [f for f in fields if f["calc"]] * 2
    skipped: list[str] = []
    for f in todo:
        try:
            try:
                v = calculate(f["calc"], values)
            except (Unreadable, TypeError, ValueError):
                v = scripted(f["name"], f["calc"], values)
            values[f["name"]] = formatted(v, f["format"])
        except (Unreadable, TypeError, ValueError, KeyError):
            if f["name"] not in skipped:
                skipped.append(f["name"])
    return values, skipped


def form_calc(text: str, fields: dict[str, list[Any]]) -> Any:
    """A FormCalc expression: Sum, Avg, Min, Max, Count over names and name[*], and arithmetic."""

    def values(args: tuple) -> list[float]:
        return [number(x) for a in args for x in (a if isinstance(a, list) else [a]) if x not in ("", None)]

    functions = {
        "Sum": lambda *a: sum(values(a)),
        "Avg": lambda *a: sum(values(a)) / len(values(a)) if values(a) else 0.0,
        "Min": lambda *a: min(values(a), default=0.0),
        "Max": lambda *a: max(values(a), default=0.0),
        "Count": lambda *a: float(len(values(a))),
        "Round": lambda x, n=0: half_up(number(x) * 10 ** int(n)) / 10 ** int(n),
        "Abs": lambda x: abs(number(x)),
    }

    def field(name: str) -> Any:
        found = fields.get(name.removesuffix("[*]"), [])
        return list(found) if name.endswith("[*]") else (found[0] if found else "")

    r = _Reader(text.rstrip(" ;\n"), field, functions)
    v = r.sum()
    if r.i < len(r.tokens):
        raise Unreadable(r.peek())
    return v


# Functions of colours and shadings.
_PS = re.compile(r"[{}]|[^\s{}]+")


def _program(tokens: list[str], i: int, deep: int = 0) -> tuple[list, int]:
    out: list = []
    if deep > 32:
        raise Unreadable("too deep")
    while i < len(tokens):
        t = tokens[i]
        if t == "{":
            block, i = _program(tokens, i + 1, deep + 1)
            out.append(block)
            continue
        if t == "}":
            return out, i + 1
        out.append(t)
        i += 1
    return out, i


def postscript(text: str, inputs: list[float]) -> list[float]:
    """A calculator function's outputs: the stack after its program."""
    program, _ = _program(_PS.findall(text), 0)
    stack: list = list(map(float, inputs))
    _run(program[0] if program and isinstance(program[0], list) else program, stack, [0])
    return [float(x) for x in stack]


def _run(program: list, s: list, steps: list[int]) -> None:
    i = 0
    while i < len(program):
        t = program[i]
        steps[0] += 1
        if steps[0] > 100_000 or len(s) > 128:
            raise Unreadable("too long")
        if isinstance(t, list):
            other = program[i + 1] if i + 1 < len(program) and isinstance(program[i + 1], list) else None
            word = program[i + (2 if other is not None else 1)]
            if word == "if" and s.pop():
                _run(t, s, steps)
            elif word == "ifelse" and other is not None:
                _run(t if s.pop() else other, s, steps)
            i += 3 if other is not None else 2
            continue
        i += 1
        if re.fullmatch(r"[-+]?(?:\d+\.?\d*|\.\d+)", t):
            s.append(float(t))
        elif t in _ONE:
            s.append(_ONE[t](s.pop()))
        elif t in _TWO:
            b, a = s.pop(), s.pop()
            s.append(_TWO[t](a, b))
        elif t == "pop":
            s.pop()
        elif t == "dup":
            s.append(s[-1])
        elif t == "exch":
            s[-1], s[-2] = s[-2], s[-1]
        elif t == "copy":
            n = int(s.pop())
            s += s[-n:] if n else []
        elif t == "index":
            s.append(s[-1 - int(s.pop())])
        elif t == "roll":
            j, n = int(s.pop()), int(s.pop())
            if n:
                part, j = s[-n:], j % n
                s[-n:] = part[-j:] + part[:-j] if j else part
        elif t in ("true", "false"):
            s.append(t == "true")
        else:
            raise Unreadable(t)


def _logic(a: Any, b: Any, of: Callable[[int, int], int]) -> Any:
    return bool(of(int(a), int(b))) if isinstance(a, bool) else float(of(int(a), int(b)))


_ONE: dict[str, Callable] = {"abs": abs, "neg": lambda a: -a, "ceiling": math.ceil, "floor": math.floor, "round": half_up, "truncate": math.trunc, "cvi": math.trunc, "cvr": float, "sqrt": lambda a: math.sqrt(max(a, 0)), "sin": lambda a: math.sin(math.radians(a)), "cos": lambda a: math.cos(math.radians(a)), "ln": lambda a: math.log(a) if a > 0 else 0.0, "log": lambda a: math.log10(a) if a > 0 else 0.0, "not": lambda a: (not a) if isinstance(a, bool) else ~int(a)}
_TWO: dict[str, Callable] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: a / b if b else 0.0,
    "idiv": lambda a, b: math.trunc(a / b) if b else 0,
    "mod": lambda a, b: math.fmod(a, b) if b else 0.0,
    "exp": lambda a, b: a**b if a > 0 or float(b).is_integer() else 0.0,
    "atan": lambda a, b: math.degrees(math.atan2(a, b)) % 360,
    "bitshift": lambda a, b: float(int(a) << int(b) if b >= 0 else int(a) >> -int(b)),
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "and": lambda a, b: _logic(a, b, lambda x, y: x & y),
    "or": lambda a, b: _logic(a, b, lambda x, y: x | y),
    "xor": lambda a, b: _logic(a, b, lambda x, y: x ^ y),
}


def exponential(t: float, c0: list[float], c1: list[float], n: float) -> list[float]:
    """Type 2: c0 + t^n (c1 - c0)."""
    return [a + t**n * (b - a) for a, b in zip(c0, c1, strict=True)]


def stitched(t: float, domain: tuple[float, float], bounds: list[float], encode: list[float], parts: list[Callable[[float], list[float]]]) -> list[float]:
    """Type 3: the part whose interval holds t, of t carried over to the part's own domain."""
    t = min(max(t, domain[0]), domain[1])
    k = sum(b <= t for b in bounds)
    k = min(k, len(parts) - 1)
    lo, hi = [domain[0], *bounds, domain[1]][k : k + 2]
    a, b = encode[2 * k : 2 * k + 2]
    return parts[k](a if hi == lo else a + (t - lo) * (b - a) / (hi - lo))


def sampled(t: float, samples: list[list[float]], domain: tuple[float, float] = (0.0, 1.0)) -> list[float]:
    """Type 0 of one input: between the two samples beside t."""
    t = (min(max(t, domain[0]), domain[1]) - domain[0]) / (domain[1] - domain[0]) * (len(samples) - 1)
    i = min(int(t), len(samples) - 2) if len(samples) > 1 else 0
    return [a + (t - i) * (b - a) for a, b in zip(samples[i], samples[min(i + 1, len(samples) - 1)], strict=True)]
