"""robots.txt: parsing, group choice and path decisions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

_UNRESERVED = re.compile(r"[A-Za-z0-9\-._~]")
_ESCAPE = re.compile(r"%([0-9a-fA-F]{2})")


@dataclass
class Group:
    agents: list[str] = field(default_factory=list)
    rules: list[tuple[bool, str]] = field(default_factory=list)  # (allow, pattern)
    delay: float | None = None


@dataclass
class Robots:
    groups: list[Group]
    sitemaps: list[str]

    @property
    def rule_count(self) -> int:
        return sum(len(g.rules) for g in self.groups)


@lru_cache(maxsize=5000)
def parse(text: str) -> Robots:
    groups: list[Group] = []
    sitemaps: dict[str, None] = {}
    for line in re.split(r"\r\n|\r|\n", text.removeprefix("\ufeff")):
        key, colon, value = line.partition("#")[0].partition(":")
        if not colon:
            continue
        key, value = key.strip().lower(), value.strip()
        if key == "sitemap":
            if value:
                sitemaps[value] = None
        elif key == "user-agent":
            if not groups or groups[-1].rules or groups[-1].delay is not None:
                groups.append(Group())
            groups[-1].agents.append(value.lower())
        elif not groups:
            continue
        elif key in ("allow", "disallow"):
            groups[-1].rules.append((key == "allow", value))
        elif key == "crawl-delay":
            try:
                seconds = float(value)
            except ValueError:
                continue
            if 0 <= seconds < float("inf"):
                groups[-1].delay = seconds
    return Robots(groups, list(sitemaps))


def _score(group: Group, token: str) -> int:
    """Length of the longest agent that the product token contains; 0 for '*', -1 for none."""
    return max((0 if a == "*" else len(a) if a and a in token else -1 for a in group.agents), default=-1)


def matching(robots: Robots, token: str) -> list[Group]:
    scored = [(_score(g, token.lower()), g) for g in robots.groups]
    best = max((s for s, _ in scored), default=-1)
    return [g for s, g in scored if s == best] if best >= 0 else []


def normalise(value: str) -> str:
    """Unreserved escapes decoded, other escapes in upper case, non-ASCII encoded."""

    def escape(m: re.Match) -> str:
        char = chr(int(m[1], 16))
        return char if _UNRESERVED.match(char) else m[0].upper()

    value = _ESCAPE.sub(escape, value)
    return "".join(c if c.isascii() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace" if not 0xD800 <= ord(c) <= 0xDFFF else "surrogatepass")) if not 0xD800 <= ord(c) <= 0xDFFF else "%EF%BF%BD" for c in value)


def specificity(pattern: str) -> int:
    """Octets of a pattern; an escape is one, wildcards and the end mark none."""
    body = pattern.removesuffix("$").replace("*", "")
    return len(_ESCAPE.sub("x", normalise(body)))


@lru_cache(maxsize=50_000)
def _regex(pattern: str) -> re.Pattern:
    anchored = pattern.endswith("$")
    body = ".*".join(re.escape(p) for p in normalise(pattern.removesuffix("$")).split("*"))
    return re.compile(body + ("$" if anchored else ""), re.S)


def rules_for(robots: Robots, token: str) -> list[tuple[bool, str]]:
    """The rules that bind a product token; an empty pattern says nothing."""
    return [(allow, pattern) for group in matching(robots, token) for allow, pattern in group.rules if pattern]


def decide(rules: list[tuple[bool, str]], path: str) -> bool:
    """Longest match wins, allow wins ties."""
    path = normalise(path)
    return max(((specificity(pattern), allow) for allow, pattern in rules if _regex(pattern).match(path)), default=(-1, True))[1]


def allowed(robots: Robots, token: str, path: str) -> bool:
    return decide(rules_for(robots, token), path)


def crawl_delay(robots: Robots, token: str) -> float | None:
    return max((g.delay for g in matching(robots, token) if g.delay is not None), default=None)
