"""Attributes and selector tests on tag tokens such as `<a class="x" href='/y'>`."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from webquarry.functions import patterns as P
from webquarry.functions.text import decode_entities, find_all, matches, sub


def _named(tok: Column, name: str) -> Column:
    """Does the tag hold the name at all?  Most do not, and a plain search costs less than the pattern."""
    return F.contains(F.lower(tok), F.lit(name.lower()))


def attr(tok: Column, name: str, decode: bool = True) -> Column:
    """Attribute value, null when the attribute is absent or has no value."""
    quoted = F.when(_named(tok, name), F.regexp_extract(tok, P.attr_pattern(re.escape(name)), 1))
    bare = F.when(matches(quoted, r"""^["']"""), F.substring(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(quoted)
    return F.when(quoted != "", decode_entities(bare) if decode else bare)


def has_attr(tok: Column, name: str) -> Column:
    return _named(tok, name) & matches(tok, P.attr_present(re.escape(name)))


def attr_map(tok: Column) -> Column:
    """All valued attributes of a tag, lower-cased names, the last of equal names wins."""
    pairs = find_all(
        tok, r"""(?s)[\s"']([a-zA-Z_:@][\w:.\-]*\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))""", 1
    )
    entries = F.transform(
        pairs,
        lambda p: F.struct(
            F.lower(F.regexp_extract(p, r"^([^\s=]+)", 1)).alias("k"),
            sub(sub(p, r"^[^=]*=\s*"), r"""\A["']|["']\z""").alias("v"),
        ),
    )
    firsts = F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda earlier: earlier["k"] == e["k"]),
    )
    return F.map_from_entries(firsts)


@dataclass(frozen=True)
class Test:
    """One test; `op` is one of = != *= ^= $= ~= |= has for an attribute, tag for the element's name, root or empty for its state."""

    name: str
    op: str
    value: str = ""
    negated: bool = False

    def column(self) -> Column:
        """The test on the helper columns `with_selectors` adds."""
        return ~self._plain() if self.negated else self._plain()

    def _plain(self) -> Column:
        if self.op == "tag":
            return F.col("tag") == F.lit(self.value)
        if self.op == "has":
            return has_attr(F.col("tok"), self.name)
        if self.op == "root":
            return F.col("parent").isNull()
        if self.op == "empty":
            return (F.col("raw1") == F.col("raw0")) & (F.col("els1") == F.col("els0"))
        value = F.col(f"@{self.name}")
        want = F.lit(self.value)
        tests = {
            "=": lambda: value == want,
            "!=": lambda: value != want,
            "|=": lambda: (value == want) | F.startswith(value, F.lit(self.value + "-")),
            "*=": lambda: F.contains(value, want),
            "^=": lambda: F.startswith(value, want),
            "$=": lambda: F.endswith(value, want),
            "~=": lambda: F.array_contains(F.split(value, F.lit(r"\s+")), want),
        }
        return F.coalesce(tests[self.op](), F.lit(False))


@dataclass(frozen=True)
class Position:
    """A test of the place among the siblings: `first`, and every `step` places on where step is not 0.

    `of` names who is counted: child (all siblings), type (those of the same name), match (those that pass the step's
    earlier tests).  Counted from the end where `from_end`; None asks for the only one.
    """

    of: str
    step: int
    first: int
    from_end: bool | None = False
    negated: bool = False

    def column(self, ahead: Column, behind: Column) -> Column:
        """The test on the place counted from the start and from the end."""
        if self.from_end is None:
            out = ahead + behind == 2
        else:
            n = behind if self.from_end else ahead
            if self.step == 0:
                out = n == self.first
            elif self.step > 0:
                out = (n >= self.first) & ((n - self.first) % self.step == 0)
            else:
                out = (n <= self.first) & ((self.first - n) % -self.step == 0)
        return ~out if self.negated else out


@dataclass(frozen=True)
class AnyOf:
    """At least one of some lists of tests passes."""

    options: tuple[tuple["Test | AnyOf", ...], ...]
    negated: bool = False

    def column(self) -> Column:
        out = F.lit(False)
        for tests in self.options:
            one = F.lit(True)
            for t in tests:
                one = one & t.column()
            out = out | one
        return ~out if self.negated else out


#: How an element stands to the one of the step before: inside it, its child, right behind it, behind it under the same parent,
#: its parent, around it, before it under the same parent.
INSIDE, CHILD, NEXT, LATER, PARENT, AROUND, EARLIER = " ", ">", "+", "~", "<", "^", "-"


@dataclass(frozen=True)
class Step:
    """A compound selector, optionally linked to the step before."""

    tag: str | None = None
    tests: tuple["Test | Position | AnyOf", ...] = ()
    within: "Step | None" = None
    link: str = INSIDE

    def local(self, places: "dict[tuple[Step, int], tuple[Column, Column]] | None" = None, upto: int | None = None) -> Column:
        """The tests on the element itself, other steps not considered; `places` gives the counts that positions test."""
        out = F.lit(True) if self.tag is None else F.col("tag") == F.lit(self.tag)
        for i, test in enumerate(self.tests[:upto]):
            if isinstance(test, Position):
                out = out & test.column(*((places or {})[self, i] if test.of == "match" else (F.col(f"{test.of}_nth"), F.col(f"{test.of}_last"))))
            else:
                out = out & test.column()
        return out

    def chain(self) -> "list[Step]":
        """The step and those before it, innermost first."""
        return [self] + (self.within.chain() if self.within else [])

    def names(self) -> set[str]:
        """Attributes whose values the step's own tests read."""
        def of(tests) -> set[str]:
            return {n for t in tests for n in ({t.name} if isinstance(t, Test) and t.op in VALUED else set().union(*map(of, t.options)) if isinstance(t, AnyOf) else set())}

        return of(self.tests)

    def structural(self) -> bool:
        """Does the step ask for parents or siblings?"""
        return self.link not in (INSIDE, AROUND) or any(isinstance(t, Position) or isinstance(t, Test) and t.op == "root" for t in self.tests)


VALUED = ("=", "!=", "*=", "^=", "$=", "~=", "|=")
_TOKEN = re.compile(
    r"""(?P<comma>\s*,\s*)|(?P<link>\s*[>+~]\s*)|(?P<gap>\s+)|(?P<tag>\*|[a-zA-Z][\w-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)
    |\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$~|]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\s"'\]]+))\s*)?\]
    |:not\(\s*(?P<no>(?:[^()]|\([^()]*\))+?)\s*\)
    |:nth-(?P<end>last-)?(?P<of>child|of-type)\(\s*(?P<arg>[^()]+?)\s*\)
    |:(?P<place>first|last|only)-(?P<kind>child|of-type)(?![\w-])|:(?P<state>root|empty)(?![\w-])""",
    re.X,
)
_NTH = re.compile(r"(?i)^(?:(?P<word>odd|even)|(?P<n>[+-]?\d+)|(?P<a>[+-]?\d*)n(?:\s*(?P<sign>[+-])\s*(?P<b>\d+))?)$")


def _nth(arg: str) -> tuple[int, int]:
    m = _NTH.match(arg.strip())
    if not m:
        raise ValueError(f"place not covered: {arg!r}")
    if m["word"]:
        return 2, int(m["word"].lower() == "odd")
    if m["n"]:
        return 0, int(m["n"])
    a = {"": 1, "+": 1, "-": -1}.get(m["a"]) if m["a"] in ("", "+", "-") else int(m["a"])
    return a, int((m["sign"] or "+") + (m["b"] or "0"))


def css(selector: str) -> tuple[Step, ...]:
    """Lists of compounds of tag, .class, #id, [attr], [attr op "v"], :not(one test), places among siblings (:first-child, :nth-of-type(2n+1)
    and their like), :root and :empty, linked by descendant, child (>), next (+) and later sibling (~) combinators.

    ValueError for every other form.
    """
    lists: list[list[tuple[str, str | None, list]]] = [[]]
    link, at, text = "", 0, selector.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"selector form not covered: {selector!r} at {text[at:]!r}")
        at = m.end()
        if m["comma"]:
            lists.append([])
            link = ""
            continue
        if m["link"] or m["gap"]:
            if link or not lists[-1]:
                raise ValueError(f"selector form not covered: {selector!r}")
            link = (m["link"] or INSIDE).strip() or INSIDE
            continue
        if link or not lists[-1]:
            lists[-1].append((link or INSIDE, None, []))
            link = ""
        elif m["tag"]:
            raise ValueError(f"selector form not covered: {selector!r}")
        before, tag, tests = lists[-1][-1]
        if m["tag"]:
            lists[-1][-1] = (before, None if m["tag"] == "*" else m["tag"].lower(), tests)
        elif m["cls"]:
            tests.append(Test("class", "~=", m["cls"]))
        elif m["id"]:
            tests.append(Test("id", "=", m["id"]))
        elif m["attr"]:
            value = next((m[k] for k in ("dq", "sq", "bare") if m[k] is not None), "")
            tests.append(Test(m["attr"], m["op"] or "has", value))
        elif m["arg"]:
            step, first = _nth(m["arg"])
            tests.append(Position("child" if m["of"] == "child" else "type", step, first, bool(m["end"])))
        elif m["place"]:
            tests.append(Position("child" if m["kind"] == "child" else "type", 0, 1, {"first": False, "last": True, "only": None}[m["place"]]))
        elif m["state"]:
            tests.append(Test("", m["state"]))
        else:
            inner = css(m["no"])
            if len(inner) != 1 or inner[0].within or len(inner[0].tests) + (inner[0].tag is not None) != 1:
                raise ValueError(f"only one simple test can be negated: {selector!r}")
            only = inner[0].tests[0] if inner[0].tests else Test("", "tag", inner[0].tag)
            tests.append(replace(only, negated=not only.negated))
    if link:
        raise ValueError(f"selector form not covered: {selector!r}")
    steps = []
    for compounds in lists:
        if not compounds:
            raise ValueError(f"empty selector in {selector!r}")
        step: Step | None = None
        for before, tag, tests in compounds:
            step = Step(tag, tuple(tests), step, before if step else INSIDE)
        steps.append(step)
    return tuple(steps)


_STEP = re.compile(
    r"""(?P<sep>//?)?(?:(?P<up>\.\.)|@(?P<attr>[\w:-]+)|(?P<text>text\(\))
    |(?:(?P<axis>child|descendant|parent|ancestor|following-sibling|preceding-sibling)::)?(?P<name>\*|node\(\)|[a-zA-Z][\w-]*)(?P<tests>(?:\[(?:[^\[\]"']|"[^"]*"|'[^']*')*\])*))""",
    re.X,
)
_AXES = {"child": CHILD, "descendant": INSIDE, "parent": PARENT, "ancestor": AROUND, "following-sibling": LATER, "preceding-sibling": EARLIER}
_QUOTED = r"""\s*(?:"([^"]*)"|'([^']*)')\s*"""
_PLACES = (
    (re.compile(r"^(\d+)$"), lambda n: (0, int(n), False)),
    (re.compile(r"^last\(\)$"), lambda: (0, 1, True)),
    (re.compile(r"^last\(\)\s*-\s*(\d+)$"), lambda n: (0, int(n) + 1, True)),
    (re.compile(r"^position\(\)\s*=\s*(\d+)$"), lambda n: (0, int(n), False)),
    (re.compile(r"^position\(\)\s*=\s*last\(\)$"), lambda: (0, 1, True)),
    (re.compile(r"^position\(\)\s*<\s*=\s*(\d+)$"), lambda n: (-1, int(n), False)),
    (re.compile(r"^position\(\)\s*<\s*(\d+)$"), lambda n: (-1, int(n) - 1, False)),
    (re.compile(r"^position\(\)\s*>\s*=\s*(\d+)$"), lambda n: (1, int(n), False)),
    (re.compile(r"^position\(\)\s*>\s*(\d+)$"), lambda n: (1, int(n) + 1, False)),
)


def _split(text: str, word: str) -> list[str]:
    """`text` cut at a word or sign that stands outside quotes and brackets."""
    out, depth, quote, at, i = [], 0, "", 0, 0
    while i < len(text):
        c, behind = text[i], text[i + len(word) : i + len(word) + 1]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif depth == 0 and text.startswith(word, i) and (not word.isalpha() or i and text[i - 1] in " \t\n)" and behind in " \t\n("):
            out.append(text[at:i])
            i = at = i + len(word)
            continue
        i += 1
    return [*out, text[at:]]


def _condition(text: str) -> Test | AnyOf:
    """One boolean test of a predicate on attributes."""
    text = text.strip()
    either = _split(text, "or")
    if len(either) > 1:
        return AnyOf(tuple((_condition(e),) for e in either))
    both = _split(text, "and")
    if len(both) > 1:
        return AnyOf((tuple(_condition(b) for b in both),))
    if m := re.match(r"^not\s*\((.*)\)$", text, re.S):
        inner = _condition(m[1])
        return replace(inner, negated=not inner.negated)
    if text.startswith("(") and text.endswith(")"):
        return _condition(text[1:-1])
    if m := re.match(r"^@([\w:-]+)$", text):
        return Test(m[1], "has")
    if m := re.match(rf"^@([\w:-]+)\s*(!?=){_QUOTED}$", text):
        return Test(m[1], m[2], m[3] if m[3] is not None else m[4])
    if m := re.match(rf"^(contains|starts-with)\(\s*@([\w:-]+)\s*,{_QUOTED}\)$", text):
        return Test(m[2], "*=" if m[1] == "contains" else "^=", m[3] if m[3] is not None else m[4])
    raise ValueError(f"path form not covered: {text!r}")


def path(expression: str) -> tuple[tuple[Step, ...], str | None]:
    """Steps of an XPath and the attribute it ends in: child and descendant steps, `..`, the axes parent, ancestor, following-sibling and
    preceding-sibling, tests of attributes with and, or, not(), contains() and starts-with(), positions and last(), unions.

    Positions count among the children of one parent, so they are covered on child and descendant steps.  ValueError for every other form.
    """
    found, own = [], set()
    for part in _split(expression.strip(), "|"):
        part = part.strip()
        step, at, ended = None, 0, None
        while at < len(part):
            m = _STEP.match(part, at)
            if not m or m.end() == at or ended is not None or not m["sep"]:
                raise ValueError(f"path form not covered: {expression!r}")
            at = m.end()
            if m["attr"] or m["text"]:
                if step is None or m["sep"] != "/":
                    raise ValueError(f"path form not covered: {expression!r}")
                ended = m["attr"] or ""
                continue
            if m["axis"] and m["sep"] == "//" or m["up"] and (step is None or m["sep"] == "//") or step is None and m["axis"] not in (None, "child", "descendant"):
                raise ValueError(f"path form not covered: {expression!r}")
            link = PARENT if m["up"] else _AXES[m["axis"]] if m["axis"] else INSIDE if m["sep"] == "//" else CHILD
            tests: list = [Test("", "root")] if step is None and link == CHILD else []
            for text in re.findall(r"""\[((?:[^\[\]"']|"[^"]*"|'[^']*')*)\]""", m["tests"] or ""):
                place = next((make(*hit.groups()) for pattern, make in _PLACES if (hit := pattern.match(text.strip()))), None)
                if place is None:
                    tests.append(_condition(text))
                elif link == CHILD or link == INSIDE and m["axis"] is None:
                    tests.append(Position("match", *place))
                else:
                    raise ValueError(f"positions on this axis are not covered: {expression!r}")
            name = None if m["up"] or m["name"] in ("*", "node()") else m["name"].lower()
            step = Step(name, tuple(tests), step, link if step else INSIDE)
        if step is None:
            raise ValueError(f"path form not covered: {expression!r}")
        found.append(step)
        own.add(ended or None)
    if len(own) > 1:
        raise ValueError(f"the parts of a union must end alike: {expression!r}")
    return tuple(found), own.pop()
