"""Small tables and slow, plain versions of the operators."""

import random
import re

WORDS = [w for a in "ba ce di fo gu" .split() for b in "la me ni po ru".split() for w in (a + b, b + a, a + b + a)]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def split(text):
    """Words between U+0020 and U+0009 to U+000D."""
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def components(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}
